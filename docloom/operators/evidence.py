"""Evidence: display paths, locators, resolving a citation, and previews with what they highlight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as tx

CONTEXT = 160


def display_roots(roots: DataFrame) -> DataFrame:
    """``roots`` (root_id, path) with display_root: the last name, ``root`` or ``x-drive``; a name that an earlier root (by
    root_id) has gets the first part of its own id."""
    p = F.trim(F.replace(F.col("path"), F.lit("\\"), F.lit("/")))
    cut = F.regexp_replace(p, "/+$", "")
    name = F.when(p == "/", "root").when(cut.rlike("^[A-Za-z]:$"), F.concat(F.lower(F.substring(cut, 1, 1)), F.lit("-drive"))).otherwise(F.coalesce(F.nullif(F.regexp_extract(cut, "([^/]*)$", 1), F.lit("")), F.lit("source")))
    rows = roots.withColumn("display_root", name).withColumn("turn", F.row_number().over(W.partitionBy("display_root").orderBy("root_id")))
    taken = F.concat("display_root", F.lit("__"), F.substring_index(F.col("root_id").cast("string"), "-", 1))
    return rows.withColumn("display_root", F.when(F.col("turn") > 1, taken).otherwise(F.col("display_root"))).drop("turn")


def display_path(root: Column, relative: Column) -> Column:
    clean = lambda c: F.regexp_replace(F.trim(F.replace(c, F.lit("\\"), F.lit("/"))), "^/+|/+$", "")
    return F.when(clean(relative) == "", clean(root)).otherwise(F.concat(clean(root), F.lit("/"), clean(relative)))


def paragraph_range(start: Column, end: Column) -> Column:
    """Shown from 1: ``a``, or ``a-b`` where it spans more than one."""
    return F.when(start.isNull(), None).when(end.isNull() | (start == end), (start + 1).cast("string")).otherwise(F.concat_ws("-", start + 1, end + 1))


def parsed_range(c: Column, base: int) -> Column:
    """(start, end) of a shown range; null if it is none. ``base`` is 1 for paragraphs, 0 for characters."""
    start, end = F.regexp_extract(c, r"^(\d+)(?:-\d+)?$", 1), F.regexp_extract(c, r"^(?:\d+-)?(\d+)$", 1)
    return F.when((start != "") & (end != "") & (start.cast("int") >= base) & (end.cast("int") >= start.cast("int")), F.struct((start.cast("int") - base).alias("start"), (end.cast("int") - base).alias("end")))


def citation(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks of active documents as citations: path, page, ranges and quote."""
    rows = chunks.join(docs.where("not is_deleted").select("doc_id", "display_path"), "doc_id")
    has = chunks.columns
    page = F.col("page_no") if "page_no" in has else F.lit(None).cast("int")
    first, last = ("paragraph_start", "paragraph_end") if "paragraph_start" in has else ("chunk_index", "chunk_index")
    return rows.select("doc_id", "chunk_index", "display_path", page.alias("page_no"), paragraph_range(F.col(first), F.col(last)).alias("paragraph_range"), F.concat_ws("-", "char_start", "char_end").alias("char_range"), tx.preview(F.col("text"), 120).alias("quote"))


def located(targets: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """What each target (doc_id, chunk_index) points at: found (null ranges if not), whether it can be opened, and where."""
    c = chunks.select("doc_id", "chunk_index", "char_start", "char_end", *([x for x in ("page_no",) if x in chunks.columns]))
    d = docs.select("doc_id", "path", "file_type", "is_deleted")
    rows = targets.join(c, ["doc_id", "chunk_index"], "left").join(d, "doc_id", "left")
    found = F.col("char_start").isNotNull() & F.coalesce(~F.col("is_deleted"), F.lit(False))
    jump = F.when((F.col("file_type") == "pdf") & F.col("page_no").isNotNull(), F.concat(F.lit("#page="), "page_no")).otherwise("") if "page_no" in chunks.columns else F.lit("")
    return rows.select("doc_id", "chunk_index", found.alias("found"), F.when(found, F.concat_ws("-", "char_start", "char_end")).alias("char_range"), (found & F.col("path").isNotNull()).alias("can_open"), F.when(found, F.concat(F.lit("file://"), "path", jump)).alias("uri"))


def previews(hits: DataFrame, parsed: DataFrame, around: int = 1) -> DataFrame:
    """``hits`` (doc_id, chunk_index, char_start, char_end, page_no, quote) with the text around them and what to highlight.

    ``parsed``: doc_id, raw_text, paragraphs (array of index, start, end, page_no). The preview spans the paragraphs that the hit overlaps
    (the nearest if none) and ``around`` more on each side, of the same page where the hit has one; 160 characters on each
    side where there are no paragraphs, and the quote where there is no text.
    """
    p = parsed.select("doc_id", "raw_text", "paragraphs")
    rows = hits.join(p, "doc_id", "left")
    over = F.filter("paragraphs", lambda x: (x["end"] > F.col("char_start")) & (x["start"] < F.col("char_end")))
    after = F.filter("paragraphs", lambda x: x["end"] > F.col("char_start"))
    near = F.when(F.size(after) > 0, F.element_at(after, 1)["index"]).otherwise(F.size("paragraphs") - 1)
    rows = rows.withColumn("first", F.when(F.size(over) > 0, F.element_at(over, 1)["index"]).otherwise(near)).withColumn("last", F.when(F.size(over) > 0, F.element_at(over, -1)["index"]).otherwise(near))
    same = lambda k: F.col("page_no").isNull() | F.get("paragraphs", k)["page_no"].eqNullSafe(F.col("page_no"))
    for _ in range(around):
        rows = rows.withColumn("first", F.when((F.col("first") > 0) & same(F.col("first") - 1), F.col("first") - 1).otherwise(F.col("first")))
        rows = rows.withColumn("last", F.when((F.col("last") + 1 < F.size("paragraphs")) & same(F.col("last") + 1), F.col("last") + 1).otherwise(F.col("last")))
    has = F.coalesce(F.size("paragraphs") > 0, F.lit(False))
    return _shown(rows, has, F.get("paragraphs", F.col("first"))["start"], F.get("paragraphs", F.col("last"))["end"])


def at_place(hits: DataFrame, spans: DataFrame, place: str, low: str, high: str, bin_chars: int) -> DataFrame:
    """``hits`` with the columns of the one span of their document that holds ``place``. Both meet by (document, bin of characters): a span
    stands in every bin that it touches, so what is joined grows with the text and not with pairs."""
    looked = hits.withColumn("bin", (F.col(place) / bin_chars).cast("int"))
    binned = spans.where(F.col(high) > F.col(low)).withColumn("bin", F.explode(F.sequence((F.col(low) / bin_chars).cast("int"), ((F.col(high) - 1) / bin_chars).cast("int"))))
    return looked.join(binned, ["doc_id", "bin"]).where((F.col(low) <= F.col(place)) & (F.col(place) < F.col(high))).drop("bin")


def stored_previews(hits: DataFrame, paragraphs: DataFrame, texts: DataFrame, around: int = 1, bin_chars: int = 4096) -> DataFrame:
    """What ``previews`` gives, from paragraphs as a table (doc_id, index, start, end, page_no) and texts (doc_id, raw_text).

    The first paragraph of a hit is the one that holds its start, counting the gap before each as its own, and the last is the one
    that holds its last character, counting the gap behind; each is looked up by place, and knows its neighbours. Only
    paragraphs of documents with hits are looked at, and no document's paragraphs are gathered. What is looked up comes back to the
    hits by the place itself: numbers given to rows would differ between the reads of ``hits``.
    """
    place = ["doc_id", "char_start", "char_end"]
    named = hits.select("doc_id", "chunk_index", "char_start", "char_end", F.col("page_no").alias("hit_page"), "quote")
    w = W.partitionBy("doc_id").orderBy("index")
    p = paragraphs.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "index", "start", "end", "page_no")
    neighbours = {}
    for k in range(1, around + 1):
        neighbours |= {f"s{k}": F.lag("start", k).over(w), f"p{k}": F.lag("page_no", k).over(w), f"e{k}": F.lead("end", k).over(w), f"q{k}": F.lead("page_no", k).over(w)}
    p = p.withColumns(neighbours | {"since": F.coalesce(F.lag("end").over(w), F.lit(0)), "until": F.coalesce(F.lead("start").over(w), F.col("end"))})
    whole = p.groupBy("doc_id").agg(F.max("end").alias("doc_end"))
    places = named.select(*place).distinct().join(whole, "doc_id").withColumns({"from_": F.least(F.col("char_start"), F.col("doc_end") - 1), "to_": F.least(F.greatest(F.col("char_end") - 1, F.col("char_start")), F.col("doc_end") - 1)})
    first = at_place(places.select(*place, "from_"), p, "from_", "since", "end", bin_chars).select(*place, F.struct(*p.columns).alias("a"))
    last = at_place(places.select(*place, "to_"), p, "to_", "start", "until", bin_chars).select(*place, F.struct(*p.columns).alias("b"))
    rows = named.join(first, place, "left").join(last, place, "left").join(texts.select("doc_id", "raw_text"), "doc_id", "left")
    rows = rows.withColumn("b", F.when(F.col("b.index") >= F.col("a.index"), F.col("b")).otherwise(F.col("a")))
    start, end, back, on = F.col("a.start"), F.col("b.end"), F.lit(True), F.lit(True)
    same = lambda c: F.col("hit_page").isNull() | F.col(c).eqNullSafe(F.col("hit_page"))
    for k in range(1, around + 1):
        back, on = back & F.col(f"a.s{k}").isNotNull() & same(f"a.p{k}"), on & F.col(f"b.e{k}").isNotNull() & same(f"b.q{k}")
        start, end = F.when(back, F.col(f"a.s{k}")).otherwise(start), F.when(on, F.col(f"b.e{k}")).otherwise(end)
    return _shown(rows, F.col("a").isNotNull(), start, end)


def _shown(rows: DataFrame, has: Column, start: Column, end: Column) -> DataFrame:
    """The text from start to end, or around the hit where it has no paragraph, and what to highlight in it."""
    rows = rows.withColumns({
        "slice_start": F.when(has, start).otherwise(F.greatest(F.lit(0), F.col("char_start") - CONTEXT)),
        "slice_end": F.when(has, end).otherwise(F.least(F.length("raw_text"), F.col("char_end") + CONTEXT)),
    })
    text = F.expr("substring(raw_text, slice_start + 1, slice_end - slice_start)")
    none = F.coalesce(F.length(text), F.lit(0)) == 0
    clamp = lambda c: F.least(F.greatest(F.col(c), F.col("slice_start")), F.col("slice_end")) - F.col("slice_start")
    return rows.select(
        "doc_id", "chunk_index", F.when(none, F.col("quote")).otherwise(text).alias("preview"),
        F.when(none, 0).otherwise(clamp("char_start")).cast("int").alias("highlight_start"), F.when(none, F.length("quote")).otherwise(clamp("char_end")).cast("int").alias("highlight_end"),
    )


def in_roots(docs: DataFrame, roots: DataFrame, wanted: list[str]) -> DataFrame:
    """Documents (root_id) of the roots whose path or display root is wanted."""
    some = roots.where(F.col("path").isin(wanted) | F.col("display_root").isin(wanted)).select("root_id")
    return docs.join(some, "root_id", "left_semi")
