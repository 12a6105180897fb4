"""Page text: reading order of recognised lines, cleaning, chunks; and slugs that depend on the order of arrival."""

from __future__ import annotations

from collections.abc import Iterator

import re
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.sources.scratch import settle, spread

# Shares of a page's width and height that tell columns, headings and merged lines apart.
BINS, LEAST_GUTTER, EDGE, CROSSING, BODY, MERGED, TALL, REACH = 200, 0.005, 0.12, 0.1, 1.2, 0.85, 1.5, 14
BOXES = "page_key string, text string, confidence double, x double, y double, width double, height double"


def _upper_median(v: np.ndarray) -> float:
    return float(np.sort(v)[len(v) // 2]) if len(v) else 0.0


def find_gutters(x: np.ndarray, width: np.ndarray) -> list[float]:
    """Middles of the quiet vertical strips between columns."""
    narrow = width <= BODY * _upper_median(width)
    if len(x) < 4 or narrow.sum() < 3:
        return []
    first = np.clip(np.floor(x[narrow] * BINS).astype(int), 0, None)
    last = np.clip(np.ceil((x + width)[narrow] * BINS).astype(int) - 1, None, BINS - 1)
    depth = np.zeros(BINS + 1)
    ok = first <= last
    np.add.at(depth, first[ok], 1)
    np.add.at(depth, last[ok] + 1, -1)
    cover = np.cumsum(depth)[:BINS]
    if not cover.max() > 0:
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (cover < max(2, 0.15 * cover.max())).astype(int), [0]])))
    strips = zip(edges[::2], edges[1::2])
    return [(a + b) / 2 / BINS for a, b in strips if (b - a) / BINS >= LEAST_GUTTER and EDGE < (a + b) / 2 / BINS < 1 - EDGE]


def _halves(text: str, share: float) -> tuple[str, str] | None:
    """A merged line cut at the blank nearest to a share of its length."""
    if not 0 < share < 1:
        return None
    aim = int(np.floor(share * len(text) + 0.5))
    blanks = [(abs(m.start() - aim), m.start() > aim, m.start()) for m in re.finditer(" ", text) if abs(m.start() - aim) < REACH]
    cut = min(blanks)[2] if blanks else aim
    left, right = text[:cut].strip(), text[cut:].strip()
    return (left, right) if left and right else None


def page_lines(text: list, x: np.ndarray, y: np.ndarray, width: np.ndarray, height: np.ndarray, origin: str) -> list[str]:
    """Lines of one page in reading order. origin: where y counts from, `bottom` or `top`."""
    kept = [i for i, t in enumerate(text) if (t or "").strip() != ""]
    if not kept:
        return []
    x, y, width, height = (v[kept] for v in (x, y, width, height))
    top = -(y + height) if origin == "bottom" else y
    order = np.argsort(top, kind="stable")
    splits = find_gutters(x[order], width[order])
    tall, lines_x, lines_w = TALL * _upper_median(height), x.tolist(), width.tolist()
    over = [next((g for g in splits if a < g - CROSSING and a + w > g + CROSSING), None) for a, w in zip(lines_x, lines_w)]
    own = [i for i, g in enumerate(over) if g is None]
    block = float(np.nanmax(x[own] + width[own]) - np.nanmin(x[own])) if own else 1.0
    # a row for each piece: band, then column, then top; a heading is a band of its own
    pieces, band = [], 0
    for i in order.tolist():
        g, said, left, wide, at = over[i], text[kept[i]], lines_x[i], lines_w[i], float(top[i])
        if g is not None and not (wide >= MERGED * block and height[i] <= tall):
            pieces.append((band + 1, 0, at, len(pieces), said))
            band += 2
            continue
        cut = _halves(said, (g - left) / wide) if g is not None else None
        for t, a, w in [(said, left, wide)] if cut is None else [(cut[0], left, g - left), (cut[1], g, left + wide - g)]:
            pieces.append((band, bisect_left(splits, a + w / 2), at, len(pieces), t))
    lines: list[str] = []
    for *_, t in sorted(pieces):
        if lines and re.fullmatch("[A-Z]", lines[-1].strip()) and re.match("[a-z]", t):
            t = lines.pop().strip() + t
        lines.append(t)
    return lines


def reading_order(boxes: DataFrame, origin: str) -> DataFrame:
    """(page_key, text) of line boxes (BOXES), pages each by itself: columns in turn, headings between bands, drop caps joined,
    split words rejoined. origin is `bottom` or `top`: producers differ, so it must be said. A page is a row, and a batch of pages is read at once."""
    if origin not in ("bottom", "top"):
        raise ValueError("origin is 'bottom' or 'top'")
    sides = ("x", "y", "width", "height")
    pages = boxes.groupBy("page_key").agg(F.collect_list(F.struct("text", *[F.col(c).cast("double").alias(c) for c in sides])).alias("boxes"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("boxes")
            ends, flat = (held.offsets.to_numpy() - held.offsets[0].as_py()).tolist(), held.flatten()
            text, box = flat.field("text").to_pylist(), [flat.field(c).to_numpy(zero_copy_only=False) for c in sides]
            read = ["\n".join(page_lines(text[s:e], *[v[s:e] for v in box], origin)) for s, e in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("page_key"), pa.array(read, pa.string())], ["page_key", "text"])

    return pages.mapInArrow(read, "page_key string, text string").withColumn("text", T.dehyphenate(F.col("text")))


def read_page(boxes: DataFrame, origin: str, hallucinates: bool = False) -> DataFrame:
    """(page_key, text, surviving, quality) of recognised boxes; an empty text has no quality."""
    page = reading_order(boxes, origin)
    clean = T.strip_invented(F.col("text")) if hallucinates else F.col("text")
    page = page.withColumn("kept", F.trim(T.dehyphenate(clean)))
    return page.select("page_key", F.col("kept").alias("text"), T.surviving_share(F.col("text"), F.col("kept")).alias("surviving"), F.when(F.col("kept") != "", T.score_text(F.col("kept"))).alias("quality"))


def repair_hyphens(pages: DataFrame, engine: str | None = None) -> DataFrame:
    """Pages whose stored text changes: (material_id, page_number, before, after, joins)."""
    ours = pages.where("text is not null")
    ours = ours.where(F.col("ocr_engine") == engine) if engine else ours
    after = T.dehyphenate(F.col("text"))
    # through an array, so that a text is repaired once and not again for each use of the result
    out = ours.select("material_id", "page_number", F.col("text").alias("before"), F.explode(F.array(after)).alias("after")).where("before <> after")
    return out.withColumn("joins", F.size(F.split("before", "\n")) - F.size(F.split("after", "\n")))


def chunk_material(pages: DataFrame, most: int = 350, overlap: int = 40, least: int = 12, key: str = "material_id", order: str = "page_number", text: str = "text") -> DataFrame:
    """(material_id, page_number, chunk, kind, text): chunks of each material's pages in order.

    Pages of fewer than `least` words are carried into the next; a chunk over pages has no page number and is of kind `span`. What is
    carried at the end is kept. Which pages make a run follows from their word counts alone, which a sorted scan folds page by page; texts only meet within a run, which is one page and less
    than `least` words carried to it, so a material may have any number of pages."""
    words = spread(pages.select(F.col(key).alias("material_id"), F.col(order).cast("int").alias("page"), F.col(text).alias("text"))).where("text is not null").select("material_id", "page", T.plain_words(F.col("text")).alias("w"))
    each = settle(words.where(F.size("w") > 0).withColumn("at", F.row_number().over(W.partitionBy("material_id").orderBy("page", "w"))))
    kind = each.schema["material_id"].dataType.simpleString()

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, open_pages, words_held, run, first, start = None, [], 0, 0, 0, True
        for p in parts:
            out: list[tuple] = []

            def close(label) -> None:
                nonlocal open_pages, words_held, run, first
                out.extend((now, at, run, label, first) for at, _ in open_pages)
                first += 1 if words_held <= most else -(-(words_held - most) // (most - overlap)) + 1
                open_pages, words_held, run = [], 0, run + 1

            for material, at, page, n in p.itertuples(index=False, name=None):
                if start or not (material == now or (material is None and now is None)):
                    if open_pages:
                        close(open_pages[-1][1])
                    now, run, first, start = material, 0, 0, False
                open_pages.append((at, page))
                words_held += n
                if words_held >= least:
                    close(page if len(open_pages) == 1 or open_pages[-2][1] == page else None)
            if out:
                yield _runs_frame(out)
        if open_pages:
            yield _runs_frame([(now, at, run, open_pages[-1][1], first) for at, _ in open_pages])

    # ids go through the scan as text, so that a null is told from the others
    counts = each.select(F.to_json(F.struct("material_id")).alias("m"), "at", "page", F.size("w").alias("n")).repartition("m").sortWithinPartitions("m", "at")
    runs = counts.mapInPandas(fold, "m string, at int, run int, page_number int, first int").withColumnRenamed("m", "j")
    named = each.withColumn("j", F.to_json(F.struct("material_id"))).join(runs, ["j", "at"])
    joined = named.groupBy("j", "material_id", "run", "page_number", "first").agg(F.sort_array(F.collect_list(F.struct("at", "w"))).alias("p")).withColumn("w", F.flatten(F.col("p.w")))
    pieces = joined.select(F.col("material_id").cast(kind).alias("material_id"), "page_number", "first", F.posexplode(T.chunk_words(F.col("w"), most, overlap)).alias("part", "text"))
    return pieces.select("material_id", "page_number", (F.col("first") + F.col("part")).alias("chunk"), F.when(F.col("page_number").isNull(), "span").otherwise("page").alias("kind"), "text")


def _runs_frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["m", "at", "run", "page_number", "first"])
    return out.assign(page_number=out.page_number.astype("Int32"))


def place_in_order(df: DataFrame, by: str, *order: str, into: str = "k") -> DataFrame:
    """df with the place (from 1) of each row among those of the same `by`, in order. Rows are dealt by ranges of by and order, so one `by` with any number of rows spreads over tasks; what is summed
    is a count for each `by` and task."""
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    dealt = settle(df.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("task", F.spark_partition_id()).withColumn("nth", inside))
    each = dealt.groupBy(by, "task").agg(F.min("nth").alias("from_nth"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.partitionBy(by).orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = each.select(by, "task", (before - F.col("from_nth") + 1).alias("shift"))
    return dealt.join(starts, [by, "task"]).withColumn(into, (F.col("nth") + F.col("shift")).cast("long")).drop("task", "nth", "shift")


def assign_slugs(titles: DataFrame, taken: DataFrame) -> DataFrame:
    """(arrival, title, slug) for titles (arrival, title): the first free of base, base-2, base-3, ... in order of arrival; taken: (slug).

    The k-th title of a base takes the k-th number that taken slugs leave free. With the i-th taken number t, t - i numbers are free below it; so titles and taken numbers, put in order by k
    and t - i, give each title its number as its place among both. Places are found over ranges, however many titles or taken slugs a base has. Only where a number meets another base of the batch
    (a title that ends in one) is its root, the base without trailing numbers, numbered row by row."""
    root = lambda c: F.regexp_replace(c, r"(-\d+)+$", "")
    new = titles.select("arrival", "title", T.slugify(F.col("title")).alias("base")).withColumn("root", root(F.col("base")))
    kind = dict(titles.dtypes)["arrival"]
    mixed = new.groupBy("root").agg(F.min("base").alias("x"), F.max("base").alias("y")).where("x <> y").select("root")
    old = taken.select("slug").distinct().withColumn("root", root(F.col("slug")))

    plain = new.join(mixed, "root", "left_anti")
    bases = plain.select("base", "root").distinct()
    # numbers of a base that are taken: 1 is the base itself
    tail = F.regexp_extract(F.expr("substring(slug, length(base) + 1)"), r"^-([1-9]\d{0,8})$", 1)
    number = F.when(F.col("slug") == F.col("base"), 1).otherwise(F.nullif(tail, F.lit("")).cast("int"))
    held = bases.join(old, "root").withColumn("n", number).where("n is not null and startswith(slug, base) and (n > 1 or slug = base)")
    used = place_in_order(held.select("base", F.col("n").cast("long").alias("n")).distinct(), "base", "n", into="i").select("base", (F.col("n") - F.col("i") + 1).alias("at"), F.lit(0).alias("free"), F.lit(None).cast(kind).alias("arrival"), F.lit(None).cast("string").alias("title"))
    ranked = place_in_order(plain.select("base", "arrival", "title"), "base", "arrival")
    both = used.unionByName(ranked.select("base", F.col("k").alias("at"), F.lit(1).alias("free"), "arrival", "title"))
    numbered = place_in_order(both, "base", "at", "free", into="n").where("free = 1")
    simple = numbered.select("arrival", "title", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string"))).alias("slug"))

    def one_by_one(pdf: pd.DataFrame) -> pd.DataFrame:
        used = set(pdf.used.dropna())
        fresh = pdf[pdf.used.isna()].sort_values("arrival")
        out, upto = [], {}
        for base in fresh.base:
            n = upto.get(base, 1)
            slug = base if n == 1 else f"{base}-{n}"
            while slug in used:
                n += 1
                slug = f"{base}-{n}"
            used.add(slug)
            upto[base] = n
            out.append(slug)
        return pd.DataFrame({"arrival": list(fresh.arrival), "title": list(fresh.title), "slug": out})

    rest = new.join(mixed, "root").select("root", "arrival", "title", "base", F.lit(None).cast("string").alias("used"))
    rest = rest.unionByName(old.join(mixed, "root").select("root", F.lit(None).cast(kind).alias("arrival"), F.lit(None).cast("string").alias("title"), F.col("slug").alias("base"), F.col("slug").alias("used")))
    return simple.unionByName(rest.groupBy("root").applyInPandas(one_by_one, f"arrival {kind}, title string, slug string"))
