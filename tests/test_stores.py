"""Sheets, slugs over taken numbers, chunks of long materials, tables on disk and the stream of work spans."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from vellum.operators import layout
from vellum.sources import tables
from vellum.sources.scratch import new_path
from vellum.streaming import incremental


def test_sheet_with_newlines_in_its_header(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text('notes\n"Na\nme","Li\nnk","By\n","To\npics"\n"One, ""two""",https://x.example/a,"Ann\nLee","a, b"\nTwo,https://x.example/b,,\n', newline="")
    got = [tuple(r)[1:] for r in tables.read_sheet(spark, str(path)).orderBy("source_row").collect()]
    assert got == [('One, "two"', "Ann\nLee", "", "https://x.example/a", "a, b"), ("Two", "", "", "https://x.example/b", "")]


def test_slugs_of_many_equal_titles(spark):
    n = 20_000
    titles = spark.range(n).select(F.col("id").alias("arrival"), F.lit("Hope!").alias("title"))
    taken = spark.range(2, 2 * n).where("id % 2 = 0").select(F.concat(F.lit("hope-"), F.col("id").cast("string")).alias("slug")).unionByName(spark.createDataFrame([("hope-x",), ("hope-007",), ("other",)], "slug string"))
    got = layout.assign_slugs(titles, taken).where("arrival in (0, 1, 2, 19999)").collect()
    assert {r.arrival: r.slug for r in got} == {0: "hope", 1: "hope-3", 2: "hope-5", 19999: "hope-39999"}
    few = layout.assign_slugs(spark.createDataFrame([(i, "a b") for i in range(5)], "arrival int, title string"), spark.createDataFrame([("a-b",), ("a-b-3",), ("a-b-4",)], "slug string"))
    assert sorted((r.arrival, r.slug) for r in few.collect()) == [(0, "a-b-2"), (1, "a-b-5"), (2, "a-b-6"), (3, "a-b-7"), (4, "a-b-8")]


def plain_chunks(pages, most=350, overlap=40, least=12):
    out, held, last = [], [], None
    runs = []
    for page, text in pages:
        words = text.split()
        if not words:
            continue
        label = page if not held or last == page else None
        held, last = held + words, page
        if len(held) >= least:
            runs.append((label, held))
            held = []
    if held:
        runs.append((last, held))
    for label, words in runs:
        starts = [0] if len(words) <= most else range(0, len(words) - overlap, most - overlap)
        out += [(label, " ".join(words[s : s + most])) for s in starts]
    return [(label, i, t) for i, (label, t) in enumerate(out)]


def test_chunks_fold_word_counts(spark):
    r = random.Random(9)
    made = {m: [(p, " ".join(f"w{r.randrange(99)}" for _ in range(r.choice((0, 1, 3, 5, 11, 12, 30, 350, 351, 800))))) for p in range(1, r.randrange(2, 40))] for m in range(12)}
    rows = [(m, p, t) for m, pages in made.items() for p, t in pages] + [(None, 1, "one two"), (None, 2, "three"), (99, 1, None), (98, 1, " ")]
    got: dict = {}
    for x in layout.chunk_material(spark.createDataFrame(rows, "material_id int, page_number int, text string").repartition(3)).collect():
        got.setdefault(x.material_id, []).append((x.page_number, x.chunk, x.text))
        assert x.kind == ("span" if x.page_number is None else "page")
    made[None] = [(1, "one two"), (2, "three")]
    assert {m: sorted(v, key=lambda c: c[1]) for m, v in got.items()} == {m: plain_chunks(v) for m, v in made.items() if plain_chunks(v)}


def test_chunks_of_a_hundred_thousand_pages(spark):
    pages = spark.range(100_000).select(F.lit(1).alias("material_id"), F.col("id").cast("int").alias("page_number"), F.concat(F.lit("some words on page "), F.col("id").cast("string")).alias("text"))
    got = layout.chunk_material(pages).agg(F.count("*").alias("n"), F.countDistinct("chunk").alias("d"), F.max("chunk").alias("m"), F.sum(F.size(F.split("text", " "))).alias("w")).first()
    assert tuple(got) == (33_334, 33_334, 33_333, 500_000)


def test_tables_on_disk(spark):
    path, n = new_path(spark), lambda rows: spark.createDataFrame(rows, "material_id int, page int")
    old, new = [(i, p) for i in range(50) for p in (1, 2)], [(i, 9) for i in range(40, 60)]
    for batch in (old, new, new):
        tables.replace_stored(spark, path, n(batch), "material_id", buckets=8)
    assert sorted((r.material_id, r.page) for r in spark.read.parquet(path).collect()) == sorted([x for x in old if x[0] < 40] + new)
    path = new_path(spark)
    assert tables.read_snapshot(spark, path) == (None, None)
    for batch, rows in ((0, old[:6]), (1, [(1, 2), (70, 1)]), (1, [(1, 99)]), (0, [(1, 98)])):
        tables.upsert_stored(spark, path, n(rows).withColumn("note", F.lit(batch)), ["material_id", "page"], ["note"], batch)
    got, last = tables.read_snapshot(spark, path)
    assert last == 1 and sorted(map(tuple, got.collect())) == [(0, 1, 0), (0, 2, 0), (1, 1, 0), (1, 2, 1), (2, 1, 0), (2, 2, 0), (70, 1, 1)]


def test_work_spans_go_on_from_their_checkpoint(spark):
    """A stream that stops between files and starts again gives what the fold of all rows gives."""
    r, zero = random.Random(1), dt.datetime(2024, 1, 1)
    events = sorted((zero + dt.timedelta(minutes=r.randrange(60 * 24 * 2), seconds=i % 60), r.randrange(5), r.choice(("processing", "failed", "review"))) for i in range(300))
    path, schema, span = new_path(spark, "files"), "ts timestamp, material_id int, status string", dt.timedelta(hours=1)
    for part in (events[:150], events[150:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        incremental.in_flight_stream(spark, f"{path}/in", schema, f"{path}/out", f"{path}/state", ("processing",)).awaitTermination()
    spans = spark.read.schema(incremental.SPANS).parquet(f"{path}/out")
    got = sorted((x.key, x.started, x.ended, x.outcome) for x in spans.collect())
    passed, want = events[-1][0] - dt.timedelta(minutes=10), []
    for m in range(5):
        open_at = None
        for at, _, status in [e for e in events if e[1] == m and e[0] <= passed]:
            if open_at and at - open_at > span:
                want.append((str(m), open_at, open_at + span, "stuck"))
                open_at = None
            if status == "processing":
                open_at = open_at or at
            elif open_at:
                want.append((str(m), open_at, at, "done"))
                open_at = None
        if open_at and open_at + span < passed:
            want.append((str(m), open_at, open_at + span, "stuck"))
    assert got == sorted(want) and {x[3] for x in got} == {"done", "stuck"}
    at = zero + dt.timedelta(hours=20)
    assert incremental.in_flight(spans, F.lit(at)).first().n == sum(a <= at < b for _, a, b, _ in want)
