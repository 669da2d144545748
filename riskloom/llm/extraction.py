"""Main text of web pages by wrapper induction.

The page with the smallest id of each host is its reference. All other pages of the host are aligned with it by simple
tree matching; a text of the reference that stays the same in most pages is template, and so are the texts matched
with it. Varying slots are content, unless they stand in an element that is boilerplate by its name, class, id or role,
or outside the article of a page that has one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm import dom
from riskloom.llm.arrow import slices, texts
from riskloom.session import Scratch

#: A reference text is template if it is the same in so large a part of the group's other pages, and in so many (or all).
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.5, 2
#: Wrappers are broadcast up to so many layouts and bytes; beyond, pages and wrappers are joined by host and layout.
BROADCAST_LAYOUTS, BROADCAST_BYTES = 10_000, 32 << 20
KEY = ["host", "layout"]
KNOWN = 20_000


def host_of(url: Column) -> Column:
    """The host of a URL without user and port, in lower case; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host)


def _is_small(side: DataFrame) -> bool:
    """Rows and bytes of a table with a reference per row are within the limits of a broadcast."""
    size = side.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("reference")).alias("bytes")).first()
    return size["n"] <= BROADCAST_LAYOUTS and (size["bytes"] or 0) <= BROADCAST_BYTES


def _by_layout(pages: DataFrame, side: DataFrame, small: bool, how: str = "left") -> DataFrame:
    return pages.join(F.broadcast(side) if small else side.hint("merge"), KEY, how)


class Aligner:
    """Parses pages and aligns them with the references of their hosts, in a worker."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.shapes: dict[tuple, int] = {}
        self.matcher = dom.TreeMatcher()
        self.references: dict[str, tuple[dom.Node, list[dom.Node]]] = {}

    def forget(self) -> None:
        if len(self.shapes) + len(self.matcher.scores) > KNOWN or len(self.references) > KNOWN // 20:
            self.clear()

    def page(self, text: str) -> dom.Node:
        self.forget()
        root = dom.parse(text)
        dom.finish(root, self.shapes)
        return root

    def laid(self, skeleton: str) -> dom.Node:
        """The tree of a skeleton; many have the reference's shapes, so it is numbered with them."""
        self.forget()
        return dom.from_skeleton(skeleton, self.shapes)[0]

    def aligned(self, root: dom.Node, reference: str) -> list[tuple[dom.Node, int]]:
        """Text nodes of the page and the numbers of the reference's texts they match."""
        if reference not in self.references:
            self.references[reference] = dom.from_skeleton(reference, self.shapes)
        tree, pieces = self.references[reference]
        number = {id(p): i for i, p in enumerate(pieces)}
        return [(x, number[id(y)]) for x, y in self.matcher.texts(root, tree) if id(y) in number]

    def same(self, root: dom.Node, reference: str) -> list[int]:
        """Numbers of the reference's texts that are the same in the page."""
        pairs = self.aligned(root, reference)
        pieces = self.references[reference][1]
        return [i for x, i in pairs if x.digest == pieces[i].digest]


def _different(pages: DataFrame) -> DataFrame:
    """(host, layout, page, n, skeleton): the different pages of every host that have content; ``pages``: host, html."""

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                laid = []
                for host, text in zip(part.column("host").to_pylist(), texts(part.column("html")), strict=True):
                    root = dom.parse(text)
                    dom.finish(root, {})
                    if content := dom.content(root):
                        page = blake2b("".join(content).encode(), digest_size=16).hexdigest()
                        laid.append((host, dom.layout(root), page, len(content), dom.skeleton(root)))
                columns = [*zip(*laid, strict=True)] or [()] * 5
                kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "layout", "page", "n", "skeleton"]
                )

    laid = pages.where("host is not null").select("host", "html").mapInArrow(lay, "host string, layout string, page string, n int, skeleton string")
    return laid.groupBy("host", "layout", "page").agg(F.min("n").alias("n"), F.min("skeleton").alias("skeleton"))


def induce(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, layout, reference, template): the wrapper of every layout of the hosts with several different pages."""
    different = scratch.keep(_different(pages), "different")
    sizes = different.groupBy(KEY).agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("n"))
    largest = sizes.groupBy("host").agg(
        F.max(F.struct("pages", "layout"))["layout"].alias("largest"), F.sum("pages").alias("all_pages")
    )
    group = F.when(F.col("pages") > 1, F.col("layout")).otherwise(F.col("largest"))
    groups = sizes.join(largest, "host").where("all_pages > 1").select(*KEY, group.alias("group"), "pages", "n")
    middling = groups.groupBy("host", "group").agg((F.sum("n") / F.sum("pages")).alias("middling"))
    groups = scratch.keep(groups.join(middling, ["host", "group"]).select(*KEY, "group", "middling"), "groups")
    near = F.struct(F.abs(F.col("n") - F.col("middling")), "page", "layout")
    chosen = different.select(*KEY, "page", "n").join(groups, KEY).groupBy("host", "group").agg(F.min(near).alias("c"))
    chosen = scratch.keep(chosen.select("host", "group", "c.page", "c.layout"), "chosen")
    references = different.join(chosen, [*KEY, "page"]).select("host", "group", "page", F.col("skeleton").alias("reference"))
    references = scratch.keep(references, "references")
    laid = groups.join(references.withColumnRenamed("page", "first"), ["host", "group"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, seen = Aligner(), Counter()
        for batch in batches:
            for part in slices(batch, "skeleton"):
                keys = zip(part.column("host").to_pylist(), part.column("group").to_pylist(), strict=True)
                for key, page, reference in zip(keys, part.column("skeleton").to_pylist(), part.column("reference").to_pylist(), strict=True):
                    seen[*key, -1] += 1
                    seen.update((*key, i) for i in aligner.same(aligner.laid(page), reference))
            if len(seen) > KNOWN:
                yield flush(seen)
                seen.clear()
        yield flush(seen)

    def flush(seen: Counter) -> pa.RecordBatch:
        columns = [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string())]
        columns += [pa.array([k[2] for k in seen], pa.int32()), pa.array(seen.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["host", "group", "piece", "n"])

    others = _by_layout(different, laid, _is_small(laid), "inner").where("page <> first")
    others = others.select("host", "group", "skeleton", "reference")
    counts = others.mapInArrow(count, "host string, group string, piece int, n long")
    by_group = counts.groupBy("host", "group", "piece").agg(F.sum("n").alias("n")).groupBy("host", "group").agg(
        F.max(F.when(F.col("piece") < 0, F.col("n"))).alias("pages"),
        F.collect_list(F.when(F.col("piece") >= 0, F.struct("piece", "n"))).alias("pieces"),
    )  # at most the texts of one page
    enough = lambda p: (p["n"] >= F.least(F.lit(TEMPLATE_PAGES), "pages")) & (p["n"] >= TEMPLATE_SHARE * F.col("pages"))
    template = F.transform(F.filter("pieces", enough), lambda p: p["piece"])
    found = laid.join(by_group.select("host", "group", template.alias("template")), ["host", "group"])
    return scratch.keep(found.where("size(template) > 0").select(*KEY, "reference", "template"), "wrappers")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: ``id_col``, ``url_col``, text (empty if none): the blocks of the main text joined by one space.

    Null html is empty; pages without a host, and those of a host without a second page of other content, have no
    wrapper and are read by their elements alone. Pages with a null id are read like others. Rows that repeat stay.
    Whole pages are read, however long or broken. An empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "extraction")
    source = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")
    )
    wrappers = induce(source, scratch)
    kind = source.schema["id"].dataType.simpleString()
    small = _is_small(wrappers)
    known = None
    if small:
        rows = wrappers.toArrow().to_pylist()  # within the limits of a broadcast
        known = pages.sparkSession.sparkContext.broadcast({(r["host"], r["layout"]): (r["reference"], r["template"]) for r in rows})

    def read(root: dom.Node, aligner: Aligner, reference: str | None, template: list[int] | None) -> str:
        fixed = set()
        if template:
            numbers = set(template)
            pairs, pieces = aligner.aligned(root, reference), aligner.references[reference][1]
            fixed = {id(x) for x, i in pairs if i in numbers and x.digest == pieces[i].digest}
        return " ".join(dom.blocks(dom.main_parts(root), fixed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner()
        for batch in batches:
            for part in slices(batch, "html"):
                roots = map(aligner.page, texts(part.column("html")))
                if small:
                    hosts = part.column("host").to_pylist()
                    out = [read(root, aligner, *known.value.get((h, dom.layout(root)), (None, None))) for h, root in zip(hosts, roots, strict=True)]
                else:
                    found = zip(roots, part.column("reference").to_pylist(), part.column("template").to_pylist(), strict=True)
                    out = [read(root, aligner, reference, template) for root, reference, template in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("url"), pa.array(out, pa.string())], names=["id", "url", "text"]
                )

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                layouts = pa.array([dom.layout(dom.parse(t)) for t in texts(part.column("html"))], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, layouts], names=[*part.schema.names, "layout"])

    if not small:
        laid = source.mapInArrow(lay, f"id {kind}, url string, host string, html string, layout string")
        source = _by_layout(laid, wrappers, small).select("id", "url", "html", "reference", "template")
    return source.mapInArrow(run, f"id {kind}, url string, text string").select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text"
    )
