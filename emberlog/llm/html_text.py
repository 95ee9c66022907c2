"""Main text of web pages by differencing each with the page of the nearest URL.

Pages become lines, one per block. Within each host the pages are put in the order of their paths,
where the path with which a page shares most of its beginning is always next to it; copies of the
page are passed over. The lines of the two are aligned by their longest common subsequence, and
shared lines are deleted. Checks guard that: a shared line of the article itself is a quotation and
stays, unless over half of the host's pages share it; lines of menus, adverts and the like go even
if the neighbour's differ, and so do lines outside the article of a page that marks one. Where
a page marks none, differencing alone decides about the lines outside menus.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from emberlog.llm import lcs
from emberlog.llm.common import let, stored, text_of
from emberlog.llm.urls import host_of, path_of

# Elements of the HTML standard by what they mean here.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
                   "summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset("article aside details dialog div fieldset figure footer form head header hgroup main menu nav ol search section "
                       "table title ul".split())
UNSEEN = frozenset("script style noscript template iframe object svg math canvas audio video select textarea button".split())
ASIDE = frozenset("aside dialog footer form head menu nav search title".split())
ARTICLE = frozenset("article main".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
ASIDE_NAMES = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead "
    "menu modal nav navbar navigation newsletter notice pagination popup promo promoted promotion related replies reply share sidebar "
    "social sponsor sponsored subscribe toolbar widget".split())
#: Kinds of lines.
IN_ARTICLE, BESIDE, OPEN = 0, 1, 2

#: Share of the article's lines from which pages are near copies.
COPY_SHARE = 0.9
#: Pages of a host that must share a line before it can be one that the site repeats.
SITE_PAGES = 4

LINES = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()),
                   ("hashes", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int8()))])
ROW = "struct<page_id:bigint,host:string,path:string,hashes:array<bigint>>"


class _Lines(HTMLParser):
    """Lines of a page with their kinds. Tags that are never closed end with what holds them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int]] = []
        self.open: list[tuple[str, bool, bool]] = []   # container, beside the article, in the article
        self.hidden: list[str] = []
        self.text: list[str] = []

    def end_line(self) -> None:
        line = " ".join("".join(self.text).split())
        self.text.clear()
        if line:
            beside, inside = self.open[-1][1:] if self.open else (False, False)
            self.lines.append((line, BESIDE if beside else IN_ARTICLE if inside else OPEN))

    def handle_starttag(self, tag, attrs):
        if tag in UNSEEN:
            self.hidden.append(tag)
        if self.hidden:
            return
        if tag == "br":
            self.text.append(" ")
        elif tag in BLOCKS:
            self.end_line()
        if tag in CONTAINERS:
            beside, inside = self.open[-1][1:] if self.open else (False, False)
            self.open.append((tag, beside or _is_beside(tag, dict(attrs), inside), inside or tag in ARTICLE))

    def handle_startendtag(self, tag, attrs):
        if tag not in UNSEEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.hidden:
            if tag in self.hidden:
                del self.hidden[self.hidden.index(tag):]
            return
        if tag in BLOCKS:
            self.end_line()
        if tag in CONTAINERS:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == tag:
                    del self.open[i:]
                    break

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def _is_beside(tag: str, attrs: dict[str, str | None], inside: bool) -> bool:
    names = f"{tag} {attrs.get('class') or ''} {attrs.get('id') or ''}".lower().replace("-", " ").replace("_", " ").split()
    # The header of a page is beside its article; that of an article holds its headline.
    if tag in ASIDE or "header" in names and not inside or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if tag in ARTICLE:
        return False
    return (attrs.get("role") or "").lower() in ASIDE_ROLES or not ASIDE_NAMES.isdisjoint(names)


def lines_of(html: str) -> list[tuple[str, int]]:
    """The lines of a page: its blocks, references decoded, white space single, empty ones left out."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    return parser.lines


def kept_lines(lines: list[tuple[str, int]], shared: list[int] | None, of_site: list[int] | None = None) -> list[str]:
    """What remains once the lines shared with the neighbour are deleted and the checks are made; ``of_site``
    are those of them that most pages of the site share."""
    deleted, of_site = (set() if x is None else set(np.asarray(x).tolist()) for x in (shared, of_site))
    has_article = any(kind == IN_ARTICLE for _, kind in lines)
    return [line for i, (line, kind) in enumerate(lines)
            if kind == IN_ARTICLE and i not in of_site or kind == OPEN and not has_article and i not in deleted]


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, kinds = [], []
        for html in batch.column(5):
            lines = lines_of(html.as_py())
            hashes.append([xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63) for line, _ in lines])
            kinds.append([kind for _, kind in lines])
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(hashes, pa.list_(pa.int64())), pa.array(kinds, pa.list_(pa.int8()))],
                                         schema=LINES)


def _own(pages: DataFrame) -> DataFrame:
    """Rows of the table under a key that tells apart all rows that differ."""
    html, url = text_of("html"), F.col("url")
    page = F.col("page_id").cast("bigint")
    return pages.select(F.xxhash64(page, url, html).alias("k1"), F.xxhash64(F.lit("2"), html, url, page).alias("k2"), page.alias("page_id"),
                        host_of(url).alias("host"), path_of(url).alias("path"), html.alias("html"), url.alias("url"))


def _copies(a: Column, b: Column) -> Column:
    """Whether two pages are copies: nearly the same article or, of pages that mark none, the same lines.
    Lines of menus and the like do not count. Pages without a mark that differ in one line are no
    copies: it may be the whole story, the rest the site's."""
    def core(x: Column, kind: int) -> Column:
        return F.array_distinct(F.filter(x["hashes"], lambda h, i: F.get(x["kinds"], i) == kind))

    def alike(kind: int, share: float) -> Column:
        return let(F.struct(core(a, kind).alias("a"), core(b, kind).alias("b")), lambda c: (F.size(c["a"]) > 0) & (
            F.size(F.array_intersect(c["a"], c["b"])) >= share * F.greatest(F.size(c["a"]), F.size(c["b"]))))
    marked = [F.array_contains(x["kinds"], IN_ARTICLE) for x in (a, b)]
    same = (a["hashes"] == b["hashes"]) | alike(IN_ARTICLE, COPY_SHARE) | ~marked[0] & ~marked[1] & alike(OPEN, 1.0)
    return F.coalesce((a["host"] == b["host"]) & same, F.lit(False))


def neighbours(lines: DataFrame) -> DataFrame:
    """``lines(k1, k2, page_id, host, path, hashes, kinds)`` with the rows ``before`` and ``after`` in the
    order of host, path and page_id (null at the ends of a host), copies next to one another
    passed over; ``leads`` marks one row of every such run of copies.

    Rows are cut into even slices of that order; next to a slice's ends stand the end rows of the
    slices around it, of which there is one pair per slice, and the rows where their runs begin and end."""
    order = ["host", "path", "page_id", "k1", "k2"]
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stored(lines.repartitionByRange(n, *order).withColumn("slice", F.spark_partition_id()), "page-order")
    row, place = F.struct("page_id", "host", "path", "hashes", "kinds"), F.struct(*order)

    def last(c: Column, window) -> Column:
        return F.last(c, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
    inside = Window.partitionBy("slice").orderBy(*order)
    back = Window.partitionBy("slice").orderBy(*(F.col(c).desc() for c in order))
    run = cut.withColumn("row", row).withColumn("above", F.lag("row").over(inside))
    run = run.withColumn("leads", F.col("above").isNull() | ~_copies(F.col("row"), F.col("above")))
    run = run.withColumn("before", last(F.when(F.col("leads"), F.col("above")), inside))
    run = run.withColumn("below", F.lag("row").over(back)).withColumn("ends", F.lag("leads").over(back))
    run = run.withColumn("after", last(F.when(F.col("ends"), F.col("below")), back)).drop("above", "below", "ends")
    ends = run.groupBy("slice").agg(F.min_by("row", place).alias("first"), F.max_by("row", place).alias("last"),
                                    F.max_by("before", place).alias("before_last"), F.min_by("after", place).alias("after_first"))
    down, up = Window.partitionBy(F.lit(0)).orderBy("slice"), Window.partitionBy(F.lit(0)).orderBy(F.desc("slice"))  # one row per slice
    ends = ends.withColumn("above", F.lag(F.struct("last", "before_last")).over(down)).withColumn("below", F.lag(F.struct("first", "after_first")).over(up))
    ends = ends.withColumn("goes_on", _copies(F.col("first"), F.col("above.last")))
    # Where a run goes on from the slice above, what stands before it there; if it fills that slice, what stands before that one.
    ends = ends.withColumn("before_slice", last(F.when(F.col("goes_on"), F.col("above.before_last")).otherwise(F.col("above.last")), down))
    ends = ends.withColumn("after_slice", last(F.when(_copies(F.col("last"), F.col("below.first")), F.col("below.after_first"))
                                               .otherwise(F.col("below.first")), up))
    found = run.join(ends.select("slice", "before_slice", "after_slice", "goes_on"), "slice")
    leads = F.col("leads") & ~(F.col("goes_on") & F.col("before").isNull())

    def same_host(c: str) -> Column:
        return F.when(F.col(f"{c}.host") == F.col("host"), F.col(c)).alias(c)
    found = found.withColumn("leads", leads).withColumn("before", F.coalesce("before", "before_slice")).withColumn("after", F.coalesce("after", "after_slice"))
    return found.select("k1", "k2", "host", "path", "hashes", "kinds", "leads", same_host("before"), same_host("after"))


def of_the_site(shared: DataFrame) -> DataFrame:
    """``host, site_lines``: hashes of the lines that a site repeats inside its articles: those that over half
    of the host's pages, and at least SITE_PAGES, share with their neighbours. Copies count once."""
    own = shared.where("leads")
    pages = own.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = own.select("host", F.explode(F.array_distinct("quoted")).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    often = lines.where(F.col("n") >= SITE_PAGES).join(pages, "host").where("2 * n > pages")
    return often.groupBy("host").agg(F.collect_list("line").alias("site_lines"))  # at most twice the lines of a mean page


@F.pandas_udf(T.StructType([T.StructField("shared", T.ArrayType(T.IntegerType())), T.StructField("nearest", T.LongType())]))
def _differenced(path: pd.Series, hashes: pd.Series, before: pd.DataFrame, after: pd.DataFrame) -> pd.DataFrame:
    def common(a: str, b: str) -> int:
        return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    rows = []
    for own_path, own, *others in zip(path, hashes, *(zip(d["page_id"], d["path"], d["hashes"], strict=True) for d in (before, after)), strict=True):
        near = [o for o in others if o[2] is not None]
        if not near:
            rows.append((None, None))
            continue
        best = max(near, key=lambda o: common(own_path, o[1]))
        rows.append((lcs.shared(own.tolist(), best[2].tolist()), None if pd.isna(best[0]) else int(best[0])))
    return pd.DataFrame(rows, columns=["shared", "nearest"]).astype({"nearest": "Int64"})


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()),
                            T.StructField("n_shared", T.LongType())]))
def _text(html: pd.Series, shared: pd.Series, of_site: pd.Series) -> pd.DataFrame:
    rows = []
    for page, own, often in zip(html, shared, of_site, strict=True):
        lines = lines_of(page)
        rows.append(("\n".join(kept_lines(lines, own, often)), len(lines), 0 if own is None else len(own)))
    return pd.DataFrame(rows, columns=["text", "n_lines", "n_shared"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``, and the lines of the page and those shared with the ``nearest`` page.

    Every row of ``pages(page_id, url, html, ...)`` gives one. Null html is empty and gives an empty
    text; a page that is alone on its host (or has no host and no such neighbour) is differenced
    with none. Rows equal in all three columns are treated alike; other columns are not looked at."""
    own = _own(pages)
    lines = stored(own.select("k1", "k2", "page_id", "host", "path", "html").mapInArrow(
        _hashes, "k1 bigint, k2 bigint, page_id bigint, host string, path string, hashes array<bigint>, kinds array<tinyint>"), "page-lines")
    found = neighbours(lines).select("k1", "k2", "host", "leads", "hashes", "kinds", _differenced("path", "hashes", "before", "after").alias("d"))
    place = F.filter("d.shared", lambda i: F.get("kinds", i) == IN_ARTICLE)
    found = stored(found.select("k1", "k2", "host", "leads", "d.shared", "d.nearest", place.alias("places"),
                                F.transform(place, lambda i: F.get("hashes", i)).alias("quoted")), "page-shared")
    found = found.join(stored(of_the_site(found), "site-lines"), "host", "left")
    of_site = F.transform(F.filter(F.arrays_zip("places", "quoted"), lambda p: F.array_contains("site_lines", p["quoted"])), lambda p: p["places"])
    shared = found.select("k1", "k2", "shared", "nearest", of_site.alias("of_site")).dropDuplicates(["k1", "k2"])
    joined = own.join(shared.hint("shuffle_hash"), ["k1", "k2"], "left").select("page_id", "url", "nearest", _text("html", "shared", "of_site").alias("t"))
    return joined.select("page_id", "url", "t.text", F.length("t.text").cast("bigint").alias("n_chars"), "t.n_lines", "t.n_shared", "nearest")
