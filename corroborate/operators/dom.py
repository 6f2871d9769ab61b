"""Pages as rows of a tree: each node with its place in document order and the last place below it.

Ancestors, siblings, panes and what lies inside what are then predicates on intervals, so sections are found by joins within a
page.  A node's text is a range of the page's text: of two texts no node holds more than its two numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import kept, slices
from ..functions.text import clean_lines, is_arabic_mostly, url_is_clean

#: Fixed values of the HTML standard and of the pages' layout: elements without an end, with hidden text, ending a line, closing
#: an open element of the same kind; classes of page furniture.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
HIDDEN, RAW = {"nav", "footer"}, {"script", "style"}
LINES = {"p", "li", "div", "section", "tr"}
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
CLOSES_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
FURNITURE = r"(?:^|\s)(?:reference|breadcrumb|next-prev|share|social|nav|navbar)(?:\s|$)"
_ATTRS = ["id", "class", "href", "role", "lang", "aria-controls"]
_NODE = ["pre", "last", "parent", "depth", "tag", "id", "class", "href", "role", "lang", "controls", "a", "b", "label"]
NODE_TYPE = "struct<pre:int,last:int,parent:int,depth:int,tag:string,id:string,class:string,href:string,role:string,lang:string,controls:string,a:int,b:int,label:string>"


class _Builder(HTMLParser):
    """Nodes of a page.  The text of navigation and footers stands apart, after the page's own, so that it is theirs alone."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.open: list[int] = []
        self.texts: list[list[str]] = [[]]  # the page's own text, then one for each hidden element
        self.sizes = [0]
        self.into = [0]

    def _say(self, text: str) -> None:
        self.texts[self.into[-1]].append(text)
        self.sizes[self.into[-1]] += len(text)

    def _add(self, tag: str, attrs: dict) -> int:
        at = len(self.nodes)
        self.nodes.append([at, at, self.open[-1] if self.open else -1, len(self.open), tag, *[attrs.get(a) or "" for a in _ATTRS], (self.into[-1], self.sizes[self.into[-1]]), None])
        return at

    def _close(self) -> None:
        node = self.nodes[self.open.pop()]
        node[1] = len(self.nodes) - 1
        if node[4] in HIDDEN:
            self.into.pop()
        elif node[4] in LINES:
            self._say("\n")
        node[12] = (self.into[-1], self.sizes[self.into[-1]])

    def _close_to(self, tags: set, within: set) -> None:
        """Closes the nearest open element of `tags`, unless one of `within` stands before it."""
        for k in range(len(self.open) - 1, -1, -1):
            tag = self.nodes[self.open[k]][4]
            if tag in tags:
                while len(self.open) > k:
                    self._close()
                return
            if tag in within:
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close_to({"p"}, {"table", "td", "th", "button"})
        if tag in CLOSES:
            self._close_to(*CLOSES[tag])
        known: dict = {}
        for name, value in attrs:
            known.setdefault(name, value)
        at = self._add(tag, known)
        if tag == "br":
            self._say("\n")
        if tag in VOID:
            self.nodes[at][12] = (self.into[-1], self.sizes[self.into[-1]])
            return
        self.open.append(at)
        if tag in HIDDEN:
            self.texts.append([])
            self.sizes.append(0)
            self.into.append(len(self.texts) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML

    def handle_endtag(self, tag):
        if tag not in VOID and any(self.nodes[i][4] == tag for i in self.open):
            self._close_to({tag}, set())

    def handle_data(self, data):
        if not self.open or self.nodes[self.open[-1]][4] not in RAW:
            at = self._add("", {})
            self._say(data)
            self.nodes[at][12] = (self.into[-1], self.sizes[self.into[-1]])

    def done(self) -> tuple[str, list[list]]:
        self.close()
        while self.open:
            self._close()
        base, parts = [0], []
        for t in self.texts:
            parts.append("".join(t))
            base.append(base[-1] + len(parts[-1]))
        for node in self.nodes:
            node[11], node[12] = (base[i] + at for i, at in (node[11], node[12]))
        return "".join(parts), self.nodes


def _label(text: str) -> str:
    """A text as a label: spaces tidied, without a colon at its end."""
    lines = re.sub(r" *\n *", "\n", re.sub(r"[\t ]+", " ", text.replace("\r", "")))
    return re.sub("[：:]$", "", lines.strip()).strip()


def tree(html: str | None, most: int = 400) -> tuple[str, Iterator[tuple]]:
    builder = _Builder()
    builder.feed(html or "")
    text, nodes = builder.done()
    return text, (tuple(n) + (_label(text[n[11] : n[12]]) if n[4] and n[12] - n[11] <= most else None,) for n in nodes)


def dom(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", label_chars: int = 400) -> DataFrame:
    """(page_id, text, nodes): a page's text, and its nodes in document order, `pre` from 0, with `last`, the last place below.

    Text nodes have an empty tag; `a` and `b` delimit a node's own text, from 0, end exclusive; label is an element's text as
    a label, null if it is longer than `label_chars`.  Texts of scripts and styles are left out.  A null page has no nodes.
    """

    def run(batches):
        kinds = [pa.int32()] * 4 + [pa.string()] * 7 + [pa.int32()] * 2 + [pa.string()]
        kind = pa.list_(pa.struct(list(zip(_NODE, kinds))))
        for b in slices(batches):
            read = [tree(h, label_chars) for h in b.column("html").to_pylist()]
            nodes = pa.array([[dict(zip(_NODE, n)) for n in found] for _, found in read], kind)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array([t for t, _ in read], pa.string()), nodes], ["page_id", "text", "nodes"])

    return pages.select(pages[id_col].alias("page_id"), pages[html_col].alias("html")).mapInArrow(run, f"page_id long, text string, nodes array<{NODE_TYPE}>")


def closed_references(html: Column) -> Column:
    """html in which only character references with a semicolon count; browsers read many without one too."""
    return F.regexp_replace(html, "&(?=(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+)(?![A-Za-z0-9;]))", "&amp;")


def nodes_of(doms: DataFrame) -> DataFrame:
    return doms.select("page_id", F.inline("nodes"))


def links(doms: DataFrame, pages: DataFrame, hosts: list[str] | None = None, paths: list[str] = (".*",), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, target, allowed): distinct targets of a page's links, made absolute, without fragment; whether a crawl may follow them:
    a clean URL, on one of `hosts` if given, with a path of one of the classes `paths` (patterns of whole paths)."""

    @F.arrow_udf("string")
    def absolute(base: pa.Array, href: pa.Array) -> pa.Array:
        out = []
        for u, h in zip(base.to_pylist(), href.to_pylist()):
            try:
                out.append(urljoin(u or "", h.strip()).partition("#")[0])
            except ValueError:
                out.append(None)
        return pa.array(out, pa.string())

    own = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("_base"))
    found = nodes_of(doms).filter("tag = 'a' and href <> ''").select("page_id", "href").distinct().join(own, "page_id").select("page_id", absolute("_base", "href").alias("target"))
    path = F.coalesce(F.try_parse_url("target", F.lit("PATH")), F.lit(""))
    classes = path.rlike("^(?:" + "|".join(f"(?:{p})" for p in paths) + ")$")
    return found.filter("target <> ''").distinct().withColumn("allowed", url_is_clean(F.col("target"), hosts) & classes)


def sections(doms: DataFrame, wanted: DataFrame, nested: list[str] = (), panes: dict[str, list[str]] | None = None, full_pane: str = "", preferred: dict[str, str] | None = None, within: str | None = None) -> DataFrame:
    """(page_id, label, status, text, items) for every page and each of its wanted labels; wanted(label, stops[, page_id]).

    A section is what follows the innermost element whose whole text is the label: its next siblings, up to a stop label or a
    heading that is no nested label; where it is alone in its wrapper, the wrapper's next siblings.  A label in a tab's link
    stands for the tab's pane.  Without any such element one of `panes`[label], ids in order, may hold the section.  Of several
    sections those outside `full_pane` count, then those in `preferred`[label]; equal texts are one; if several are left the
    label is ambiguous, unless it has a preferred pane, then the first counts.  With `within` only labels inside an element of that
    kind head a section.  Status is ok, missing or ambiguous; items are
    the texts of list items in the section, else its lines.
    """
    panes, preferred = panes or {}, preferred or {}
    nodes = kept(nodes_of(doms), "nodes")
    asked = doms.select("page_id").join(wanted, "page_id") if "page_id" in wanted.columns else doms.select("page_id").crossJoin(F.broadcast(wanted))  # labels of a layout: a few
    asked = kept(asked.select("page_id", F.col("label").alias("name"), "stops").distinct(), "wanted")
    by = lambda prefix, *cols: nodes.select("page_id", *[F.col(c).alias(f"{prefix}_{c}") for c in cols])

    alike = asked.select("page_id", "name").join(nodes.filter("tag <> ''"), (asked["page_id"] == nodes["page_id"]) & (asked["name"] == nodes["label"])).select(asked["page_id"], "name", "pre", "last", "parent", "depth")
    if within:
        around = nodes.filter(F.col("tag") == within).select(F.col("page_id").alias("w_page"), F.col("pre").alias("w_pre"), F.col("last").alias("w_last"))
        alike = alike.join(around, (F.col("page_id") == F.col("w_page")) & (F.col("pre") > F.col("w_pre")) & (F.col("pre") <= F.col("w_last")), "left_semi")
    inner = alike.select(F.col("page_id").alias("i_page"), F.col("name").alias("i_name"), F.col("pre").alias("i_pre"))
    heads = kept(alike.join(inner, (F.col("page_id") == F.col("i_page")) & (F.col("name") == F.col("i_name")) & (F.col("i_pre") > F.col("pre")) & (F.col("i_pre") <= F.col("last")), "left_anti"), "heads")

    up = by("u", "pre", "last", "parent", "depth", "tag", "href", "role", "controls")
    above = heads.join(up, "page_id").filter("u_pre <= pre and pre <= u_last")  # the head and its ancestors
    tabs = above.filter("u_pre < pre and u_tag = 'a' and (startswith(u_href, '#') or u_role = 'tab')").groupBy("page_id", "name", "pre").agg(F.max(F.struct("u_pre", "u_href", "u_controls")).alias("t"))
    ids = nodes.filter("id <> ''").groupBy("page_id", "id").agg(F.min("pre").alias("pane"))
    pane_of = F.when(F.col("t.u_controls") != "", F.col("t.u_controls")).otherwise(F.substring("t.u_href", 2, 1 << 20))
    tabbed = tabs.select("page_id", "name", F.col("pre").alias("head"), pane_of.alias("id")).join(ids, ["page_id", "id"]).select("page_id", "name", "head", F.col("pane").alias("anchor"), F.col("pane").alias("box"), F.lit(-1).alias("after"))

    # the head, or the nearest wrapper with something after it: candidates are the head and wrappers whose only element leads to it
    elements = nodes.filter("tag <> ''").groupBy("page_id", F.col("parent").alias("u_parent")).agg(F.count("*").alias("n"))
    boxes = by("p", "pre", "tag").withColumnRenamed("p_pre", "u_parent")
    plain = above.join(tabs.select("page_id", "name", "pre"), ["page_id", "name", "pre"], "left_anti")
    steps = plain.select("page_id", "name", F.col("pre").alias("head"), "u_pre", "u_last", "u_parent", "u_depth").join(elements, ["page_id", "u_parent"]).join(boxes, ["page_id", "u_parent"], "left")
    ends = (F.col("n") != 1) | F.col("p_tag").isNull() | (F.col("p_tag") == "body")
    outward = Window.partitionBy("page_id", "name", "head").orderBy(F.desc("u_depth"))
    reached = F.coalesce(F.max(ends.cast("int")).over(outward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 0
    steps = steps.withColumn("_ok", reached).filter("_ok").select("page_id", "name", "head", F.col("u_parent").alias("box"), F.col("u_last").alias("after"), F.col("u_depth").alias("level"), ends.alias("final"))

    lone = asked.join(heads.select("page_id", "name").distinct(), ["page_id", "name"], "left_anti").select("page_id", "name")
    known = [(label, i, pane) for label, some in panes.items() for i, pane in enumerate(some)]
    named = doms.sparkSession.createDataFrame(known, "name string, nth int, id string")
    fallback = lone.join(F.broadcast(named), "name").join(ids, ["page_id", "id"]).groupBy("page_id", "name").agg(F.min(F.struct("nth", "pane")).alias("f"))
    fallback = fallback.select("page_id", "name", F.col("f.pane").alias("head"), F.col("f.pane").alias("anchor"), F.col("f.pane").alias("box"), F.lit(-1).alias("after"))

    places = steps.select("page_id", "name", "head", F.col("head").alias("anchor"), "box", "after", "level", "final")
    for other in (tabbed, fallback):
        places = places.unionByName(other.withColumns({"level": F.lit(0), "final": F.lit(True)}))
    places = kept(places.join(asked, ["page_id", "name"]), "places")
    within = by("s", "pre", "last", "parent", "tag", "class", "label", "a", "b").withColumnRenamed("s_parent", "box")
    after = places.join(within, ["page_id", "box"]).filter("s_pre > after")
    label, is_own = F.coalesce("s_label", F.lit("\0")), F.coalesce(F.col("s_label") == F.col("name"), F.lit(False)) & (F.col("s_tag") != "")
    stops = (F.col("s_tag") != "") & ~is_own & (F.array_contains("stops", label) | (F.col("s_tag").isin(HEADINGS) & ~label.isin(*nested)))
    key = ["page_id", "name", "head", "level"]
    until = after.withColumn("_stop", F.when(stops, F.col("s_pre"))).withColumn("until", F.min("_stop").over(Window.partitionBy(*key)))
    body = until.filter(~is_own & (F.col("until").isNull() | (F.col("s_pre") < F.col("until"))))
    body = kept(body.select(*key, "anchor", "final", "s_pre", "s_last", "s_tag", "s_class", "s_a", "s_b"), "bodies")
    full = body.groupBy(*key).agg(F.count("*").alias("n"))
    # the deepest place with a body, or the last place that may be tried
    tried = places.join(full, key, "left").filter("n is not null or final")
    chosen = tried.groupBy("page_id", "name", "head").agg(F.max("level").alias("level"))
    held = body.join(chosen, key)

    texts = doms.select("page_id", "text")
    shown = held.filter(~((F.col("s_tag") != "") & F.col("s_class").rlike(FURNITURE))).groupBy("page_id", "name", "head", "anchor").agg(F.array_sort(F.collect_list(F.struct("s_pre", "s_a", "s_b"))).alias("parts"))
    cut = lambda a, b: F.substring(F.col("text"), a + 1, b - a)
    shown = shown.join(texts, "page_id").select("page_id", "name", "head", "anchor", clean_lines(F.array_join(F.transform("parts", lambda p: cut(p["s_a"], p["s_b"])), "")).alias("text")).filter("text <> ''")
    listed = held.join(by("l", "pre", "tag", "a", "b").filter("l_tag = 'li'"), "page_id").filter("s_pre <= l_pre and l_pre <= s_last").join(texts, "page_id")
    listed = listed.withColumn("item", clean_lines(cut(F.col("l_a"), F.col("l_b")))).filter("item <> ''").groupBy("page_id", "name", "head").agg(F.array_sort(F.collect_list(F.struct("l_pre", "item"))).alias("l"))

    inside = lambda test: by("z", "pre", "last", "id").filter(test)
    in_full = shown.join(inside(F.col("z_id") == full_pane) if full_pane else inside(F.lit(False)), "page_id").filter("z_pre <= anchor and anchor <= z_last").select("page_id", "name", "head").distinct().withColumn("copy", F.lit(True))
    liked = doms.sparkSession.createDataFrame(list(preferred.items()), "name string, z_id string")
    in_liked = shown.join(F.broadcast(liked), "name").join(by("z", "pre", "last", "id"), ["page_id", "z_id"]).filter("z_pre <= anchor and anchor <= z_last").select("page_id", "name", "head").distinct().withColumn("liked", F.lit(True))
    pool = shown.join(in_full, ["page_id", "name", "head"], "left").join(in_liked, ["page_id", "name", "head"], "left").join(listed, ["page_id", "name", "head"], "left")
    rank = F.struct(F.coalesce("copy", F.lit(False)).alias("copy"), (~F.coalesce("liked", F.lit(False))).alias("other"))
    best = Window.partitionBy("page_id", "name")
    pool = pool.withColumn("rank", rank).withColumn("best", F.min("rank").over(best)).filter("rank = best")
    flat = F.trim(F.regexp_replace(F.regexp_replace("text", " ", " "), r"\s+", " "))
    first = F.min(F.struct("head", "text", F.col("l.item").alias("items")))
    found = pool.groupBy("page_id", "name").agg(first.alias("f"), F.count_distinct(flat).alias("kinds"))
    out = asked.select("page_id", "name").join(found, ["page_id", "name"], "left")
    status = F.when(F.col("f").isNull(), "missing").when((F.col("kinds") > 1) & ~F.col("name").isin(*preferred), "ambiguous").otherwise("ok")
    out = out.withColumn("status", status)
    ok = F.col("status") == "ok"
    lines = F.filter(F.split("f.text", "\n"), lambda x: x != "")
    return out.select("page_id", F.col("name").alias("label"), "status", F.when(ok, F.col("f.text")).alias("text"), F.when(ok, F.coalesce("f.items", lines)).alias("items"))


def records(doms: DataFrame, found: DataFrame, required: list[str], optional: list[str] = (), title_for: str | None = None, lang: str = "ar", letters: Column | None = None) -> DataFrame:
    """(page_id, title, reason, fields): a page's record from its sections, or the first reason why it is none.

    Reasons in order: not_<lang>_page (the html element's lang is not `lang` or one of its regions), missing_h1,
    not_<lang>_record (title), missing_ or ambiguous_<label> for each required label in order, ambiguous_<label> for optional
    ones, not_<lang>_record (a required text).  `title_for`: a required label that the title replaces if missing.  `letters`
    says of a column named text whether it is in the language.  fields maps labels to texts; optional ones may be absent.
    """
    nodes = nodes_of(doms)
    good = is_arabic_mostly(F.col("text")) if letters is None else letters
    one = lambda tag, value: nodes.filter(F.col("tag") == tag).groupBy("page_id").agg(F.min(F.struct("pre", *value)).alias(tag))
    heads = doms.select("page_id", "text").join(one("html", ["lang"]), "page_id", "left").join(one("h1", ["a", "b"]), "page_id", "left")
    heads = heads.select("page_id", F.coalesce("html.lang", F.lit("")).alias("lang"), clean_lines(F.coalesce(F.expr("substring(text, h1.a + 1, h1.b - h1.a)"), F.lit(""))).alias("title"))
    said = found.select("page_id", F.struct("label", "status", "text", good.alias("good")).alias("s")).groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("s.label"), F.col("s")))).alias("s"))
    rows = heads.join(said, "page_id", "left").withColumn("text", F.col("title")).withColumn("good_title", good).drop("text")
    status = lambda x: F.coalesce(F.try_element_at("s", F.lit(x))["status"], F.lit("missing"))
    by_title = lambda x: (status(x) == "missing") if x == title_for else F.lit(False)
    reason = F.when(~F.lower("lang").rlike(f"^{lang}(?:-|$)"), f"not_{lang}_page").when(F.col("title") == "", "missing_h1").when(~F.col("good_title"), f"not_{lang}_record")
    for x in required:
        reason = reason.when((status(x) != "ok") & ~by_title(x), F.concat(status(x), F.lit(f"_{x}")))
    for x in optional:
        reason = reason.when(status(x) == "ambiguous", f"ambiguous_{x}")
    for x in required:
        reason = reason.when(~by_title(x) & ~F.coalesce(F.try_element_at("s", F.lit(x))["good"], F.lit(False)), f"not_{lang}_record")
    value = lambda x: F.when(by_title(x), F.col("title")).otherwise(F.try_element_at("s", F.lit(x))["text"])
    pairs = F.filter(F.array(*[F.struct(F.lit(x).alias("key"), value(x).alias("value")) for x in (*required, *optional)]), lambda p: p["value"].isNotNull())
    rows = rows.withColumn("reason", reason)
    return rows.select("page_id", "title", "reason", F.when(F.col("reason").isNull(), F.map_from_entries(pairs)).alias("fields"))
