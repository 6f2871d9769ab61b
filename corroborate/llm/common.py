"""What the operators of this folder share: table access, written intermediate tables, word and window hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null identifier counts as the largest one and comes back as null.
NULL_ID = 2**63 - 1
#: [\x20\x09-\x0D], which is also what bytes.split() cuts at.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where the session names none and runs in one JVM, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_id(df: DataFrame, id_col: str, **others: str) -> DataFrame:
    """Only the columns needed, under fixed names: the identifier as `id`, with NULL_ID for null.  Other columns may be named anything."""
    return df.select(F.coalesce(df[id_col].cast("long"), F.lit(NULL_ID)).alias("id"), *[df[c].alias(name) for name, c in others.items()])


def id_back(name: str = "doc_id"):
    return F.when(F.col("id") != NULL_ID, F.col("id")).alias(name)


def utf8_rows(column: pa.Array) -> list[bytes | None]:
    """Each row's UTF-8 bytes, null as None."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, so that what a task makes of a batch stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def blocks(ids: list, texts: list, limit: int) -> Iterator[tuple[list, list]]:
    """Consecutive rows whose texts hold at most `limit` bytes together; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if i > start and size + n > limit:
            yield ids[start:i], texts[start:i]
            start, size = i, 0
        size += n
    if start < len(texts):
        yield ids[start:], texts[start:]


# --- hashes ---------------------------------------------------------------------------------------------------------

_N = 1 << 20  # bytes or words that are hashed in one go
_BASES = {"word": 0x9E3779B97F4A7C1B, "window": 0xD1342543DE82EF93}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers modulo 2^64 and their inverses."""
    if kind not in _POWERS:
        both = []
        for base in (_BASES[kind], pow(_BASES[kind], -1, 2**64)):
            steps = np.full(_N + 64, base, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[kind] = tuple(both)
    return _POWERS[kind]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A number for each byte value.
_SYMBOL = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: str) -> np.ndarray:
    """Polynomial (Rabin-Karp) hash modulo 2^64 of values[start:end] for each span; at most _N values."""
    power, inverse = _powers(kind)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * inverse[starts]


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word [^\\x20\\x09-\\x0D]+ of a text of any length."""
    data = np.frombuffer(text, np.uint8)
    edge = np.flatnonzero(np.diff(SPACE[data], prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = int(np.searchsorted(ends, low + _N, "right"))
        if to == at:  # one word of over a million bytes: hashed piece by piece
            h = np.uint64(0)
            for p in range(int(low), int(ends[at]), _N):
                q = min(p + _N, int(ends[at]))
                h = mixed(h + _span_hashes(_SYMBOL[data[p:q]], np.array([0]), np.array([q - p]), "word"))[0]
            out[at] = h
            to = at + 1
        else:
            out[at:to] = _span_hashes(_SYMBOL[data[low : ends[to - 1]]], starts[at:to] - low, ends[at:to] - low, "word")
        at = to
    return starts, ends, mixed(out + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every `width` consecutive word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, step = np.empty(n, np.uint64), _N - width
    for at in range(0, n, step):
        to = min(n, at + step)
        starts = np.arange(to - at)
        out[at:to] = _span_hashes(words[at : to + width - 1], starts, starts + width, "window")
    return mixed(out)


def covered(windows: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a marked window of `width` places."""
    change = np.zeros(n + width + 1, np.int64)
    at = np.flatnonzero(windows)
    np.add.at(change, at, 1)
    np.add.at(change, at + width, -1)
    return np.cumsum(change[:n]) > 0
