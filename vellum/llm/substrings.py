"""Substring dedup by level-wise doubling: what repeats at one length alone is extended to twice that length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, settle
from .superwindows import ADDED, SEG, as_words, at_documents, occurrences, remove_spans, single_windows, with_rows


def repeated_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """(row, start, end) in words: stretches of docs (doc_id, text, row) covered by windows whose words also start in a
    document with a smaller id. Spans may overlap.

    The lengths are a quarter of the window, half of it and all of it (12, 24 and 50 words). First level: of each window the anchor, its 12
    words with the smallest hash, stands for it; windows whose anchor one document alone holds leave. Second level: anchors that are left are
    extended to 24 words, within their windows; those that one document alone holds leave. Third level: stretches of consecutive windows
    with one extended anchor are compared whole, and where those of an anchor differ, window by window. What is left then has no
    partner; longer lengths would remove nothing else, so levels end here. Only rows that survive a level move at the next.
    """
    found = settle(occurrences(docs, as_words, window, window // 4, double=True).drop("lead"))
    ids = None
    if docs.where("row <> doc_id or doc_id is null").isEmpty():
        named = lambda df: df.withColumn("doc_id", F.col("row"))
    else:
        ids = settle(docs.select("row", "doc_id").distinct())
        named = lambda df: df.join(ids, "row")
    for level in ("first", "anchor"):
        # settled, so that a join may split a hot key
        shared = settle(named(found).groupBy(level).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select(level))
        left = settle(found.join(shared, level).drop("first"))
        release(found, shared)
        found = left
    segs = settle(named(found).groupBy(*SEG).agg(F.min("doc_id").alias("least"), F.min(F.struct("row", "start", "n_windows")).alias("one")))
    several = settle(segs.groupBy("anchor").agg(F.count("*").alias("forms")).where("forms > 1").select("anchor"))
    ours = segs.join(several, "anchor")
    wanted = ours.select("one.row", *SEG, "one.start", "one.n_windows", F.col("least").alias("weight"))
    each = single_windows(at_documents(docs, wanted), as_words, window)
    first = each.groupBy("anchor", "hash").agg(F.min("weight").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    early = each.join(first, ["anchor", "hash"]).where("first < weight").groupBy(*SEG).agg(F.collect_set("place").alias("places"))
    marks = settle(segs.select(*SEG, "least").join(early, SEG, "left"))
    whole = named(found).join(marks, SEG)
    end = F.col("start") + F.col("n_windows") + window - 1
    places = F.coalesce("places", F.array().cast("array<int>"))
    each_place = F.transform(places, lambda p: F.struct((F.col("start") + p).alias("start"), (F.col("start") + p + window).alias("end")))
    spans = whole.select("row", F.explode(F.when(F.col("doc_id") > F.col("least"), F.array(F.struct("start", end.alias("end")))).otherwise(each_place)).alias("span"))
    spans = settle(spans.select("row", "span.start", "span.end"))
    release(found, segs, several, marks, *([ids] if ids else []))
    return spans


def dedup_substrings(docs: DataFrame, window: int = 50, id: str = "doc_id", text: str = "text", extra: tuple[str, ...] = (), same_if_whole: bool = False) -> DataFrame:
    """Each row of docs with doc_id, n_units (words), n_removed, n_spans and kept_text: its words without those that repeated_spans covers.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text, unchanged; kept ones are joined by one space. Null and empty texts, and texts of
    fewer words than the window, keep all their words. Of rows with the same id none counts as smaller than another, nor does one without an id. The columns
    named in extra stay, but for those named like one added; with same_if_whole a text that loses nothing keeps its white space.
    """
    others = [F.col(f"`{c}`") for c in extra if c not in ("doc_id", "row", "text", "kept_text", *ADDED)]
    own = with_rows(docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), *others))
    cut = remove_spans(own, repeated_spans(own.select("doc_id", "text", "row"), window), as_words, b" ", same_if_whole)
    return cut.withColumn("kept_text", F.col("kept").cast("string")).drop("kept")
