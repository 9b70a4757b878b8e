"""Page text from page layouts: running headers and footers, tables in the place of their lines.

A layout row is a page: document, page, height and blocks, an array of struct<type, lines>, where
lines is an array of struct<text, bbox> and a bbox is x0, y0, x1, y1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# The band at the top and the bottom of a page, the longest running line, and its share of pages.
BAND, LONGEST, SHARE, MIN_PAGES = 0.08, 150, 0.5, 3


def coverage(pages: DataFrame, images: DataFrame) -> DataFrame:
    """document, page, coverage: the share of a page below its images, overlaps counted twice, 1 at most."""
    side = lambda low, high, limit: F.greatest(F.least(high, limit) - F.greatest(low, F.lit(0.0)), F.lit(0.0))
    box = lambda k: F.col("bbox")[k]
    both = pages.select("document", "page", "width", "height").join(images, ["document", "page"], "left")
    area = F.when(F.col("bbox").isNotNull(), side(box(0), box(2), F.col("width")) * side(box(1), box(3), F.col("height")))  # least and greatest pass over nulls
    whole = F.when(F.col("width") * F.col("height") > 0, F.col("width") * F.col("height")).otherwise(1.0)
    return both.groupBy("document", "page").agg(F.least(F.lit(1.0), F.coalesce(F.sum(area / whole), F.lit(0.0))).alias("coverage"))


def lines(pages: DataFrame) -> DataFrame:
    """document, page, block, line, text, bbox, in_band, key of every line of the text blocks."""
    blocks = pages.select("document", "page", "height", F.posexplode("blocks").alias("block", "b")).where("b.type = 'text'")
    each = blocks.select("document", "page", "height", "block", F.posexplode("b.lines").alias("line", "l"))
    in_band = (F.col("l.bbox")[3] <= F.col("height") * BAND) | (F.col("l.bbox")[1] >= F.col("height") * (1 - BAND))
    return each.select("document", "page", "block", "line", F.col("l.text").alias("text"), F.col("l.bbox").alias("bbox"), in_band.alias("in_band"), X.boilerplate_key(F.col("l.text")).alias("key"))


def running_lines(pages: DataFrame, page_numbers: bool = True) -> DataFrame:
    """document, key of lines in the bands of at least half of a document's pages, three or more.

    Keys of bare page numbers are among them for every document of three pages, unless they are not wanted.
    """
    sizes = pages.groupBy("document").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    band = lines(pages).where(F.col("in_band") & (F.length("text") <= LONGEST) & ~F.col("key").isin("", "#"))
    counts = band.groupBy("document", "key").agg(F.countDistinct("page").alias("on"))
    needed = F.greatest(F.lit(MIN_PAGES), F.floor(F.col("n") * SHARE + 0.5))
    found = counts.join(sizes, "document").where(F.col("on") >= needed).select("document", "key")
    if not page_numbers:
        return found.where(~F.col("key").isin(*X.PAGE_NUMBER_KEYS))
    return found.union(sizes.select("document", F.explode(X.strings(X.PAGE_NUMBER_KEYS)).alias("key"))).distinct()


def assembled(pages: DataFrame, tables: DataFrame | None = None, keep_running: bool = False) -> DataFrame:
    """document, page, text of every page, in the order of its content.

    A running line is kept where it comes first in a document and dropped later; page numbers go.
    Lines whose centre lies in a table (document, page, n, bbox, markdown) give way to its Markdown, once;
    tables without such lines come last.
    """
    rows = lines(pages)
    if not keep_running:
        running = running_lines(pages).withColumn("__running", F.lit(True))
        place = F.struct("page", "block", "line")
        first = rows.where("in_band").groupBy("document", "key").agg(F.min(place).alias("__first"))
        marked = rows.join(running, ["document", "key"], "left").join(first, ["document", "key"], "left")
        gone = F.col("in_band") & F.coalesce("__running", F.lit(False)) & (F.col("key").isin(*X.PAGE_NUMBER_KEYS) | (F.col("__first") != place))
        rows = marked.where(~F.coalesce(gone, F.lit(False)))
    content = rows.groupBy("document", "page").agg(F.array_sort(F.collect_list(F.struct("block", "line", "text", "bbox"))).alias("lines"))  # one page
    whole = pages.select("document", "page").join(content, ["document", "page"], "left")
    none = F.array().cast("array<struct<n:int,bbox:array<double>,markdown:string>>")
    if tables is not None:
        of_page = tables.groupBy("document", "page").agg(F.array_sort(F.collect_list(F.struct(F.col("n").cast("int").alias("n"), F.col("bbox").cast("array<double>").alias("bbox"), "markdown"))).alias("tables"))
        whole = whole.join(of_page, ["document", "page"], "left")
    else:
        whole = whole.withColumn("tables", none)
    tables_of = F.coalesce("tables", none)
    texts = "array<string>"
    empty = F.array().cast(texts)

    def step(s: Column, x: Column) -> Column:
        held = lambda out, h: F.when(F.size(h) > 0, F.concat(out, F.array(F.array_join(h, "\n")))).otherwise(out)
        cx, cy = (x["bbox"][0] + x["bbox"][2]) / 2, (x["bbox"][1] + x["bbox"][3]) / 2
        hits = F.filter(s["tables"], lambda t: cx.between(t["bbox"][0], t["bbox"][2]) & cy.between(t["bbox"][1], t["bbox"][3]))
        new_block = x["block"] != s["block"]
        out, now = F.when(new_block, held(s["out"], s["held"])).otherwise(s["out"]), F.when(new_block, empty).otherwise(s["held"])
        state = lambda o, h, done: F.struct(o.alias("out"), h.alias("held"), x["block"].alias("block"), done.alias("done"), s["tables"].alias("tables"))
        fresh = ~F.array_contains(s["done"], hits[0]["n"])
        table = state(F.concat(held(out, now), F.array(hits[0]["markdown"])), empty, F.concat(s["done"], F.array(hits[0]["n"])))
        return F.when(F.size(hits) == 0, state(out, F.concat(now, F.array(x["text"])), s["done"])).when(fresh, table).otherwise(state(out, now, s["done"]))

    start = F.struct(empty.alias("out"), empty.alias("held"), F.lit(-1).alias("block"), F.array().cast("array<int>").alias("done"), tables_of.alias("tables"))
    items = F.coalesce("lines", F.array().cast("array<struct<block:int,line:int,text:string,bbox:array<double>>>"))
    end = whole.select("document", "page", F.aggregate(items, start, step).alias("s"))
    rest = F.transform(F.filter(F.col("s.tables"), lambda t: ~F.array_contains(F.col("s.done"), t["n"])), lambda t: t["markdown"])
    parts = F.concat(F.col("s.out"), F.when(F.size("s.held") > 0, F.array(F.array_join("s.held", "\n"))).otherwise(empty), rest)
    text = F.regexp_replace(F.array_join(parts, "\n\n"), "\n{3,}", "\n\n")
    return end.select("document", "page", F.regexp_replace(text, r"^\s+|\s+$", "").alias("text"))
