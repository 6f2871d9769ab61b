"""Evidence retrieval and verification over tables, written for Spark."""
