"""Stored postings, cells and hash tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from vellum.operators import ann, postings, vectors
from vellum.sources.scratch import new_path, settle


def test_postings_replace_and_prune(spark):
    path = new_path(spark, "postings")
    store = postings.PostingsTable(spark, path, stem=False, buckets=16)
    docs = lambda rows: spark.createDataFrame(rows, "id long, text string")
    store.add(docs([(1, "the quiet harbour at dawn"), (2, "quiet water"), (3, "harbour of stone"), (4, None), (5, "the of and")]), 0)
    ask = spark.createDataFrame([(1, ["harbour"], [], [], ""), (2, ["quiet"], ["water", "dawn"], [], ""), (3, ["quiet"], [], ["water"], ""), (4, [], ["stone"], [], ""), (5, ["harbour"], [], [], "harbour of stone"), (6, ["harbour"], [], [], "harbour stone"), (7, ["water"], [], [], "")], "query_id int, must array<string>, any array<string>, not array<string>, phrase string")
    hits = lambda: sorted((r.query_id, r.id) for r in store.search(ask).collect())
    assert hits() == [(1, 1), (1, 3), (2, 1), (2, 2), (3, 1), (4, 3), (5, 3), (7, 2)]
    store.add(docs([(3, "a new text of water"), (2, None), (6, "harbour stone")]), 1)
    assert hits() == [(1, 1), (1, 6), (2, 1), (3, 1), (4, 6), (6, 6), (7, 3)]
    before = sorted(map(tuple, store.search(ask).collect()))
    store.add(docs([(3, "a new text of water"), (2, None), (6, "harbour stone")]), 1)
    assert sorted(map(tuple, store.search(ask).collect())) == before
    spark.createDataFrame([("quiet", 1, 1, [0], "wlost", 0)], "term string, id long, tf long, positions array<int>, write string, bucket int").write.mode("append").partitionBy("write", "bucket").parquet(f"{path}/postings")
    assert sorted(map(tuple, store.search(ask).collect())) == before  # postings that no document names are not seen
    assert store.sweep() == 2 and sorted(map(tuple, store.search(ask).collect())) == before  # a replaced write and a lost one
    store.add(docs([(6, "harbour stone"), (2, None), (3, "other words")]), 1)
    assert hits() == [(1, 1), (1, 6), (2, 1), (3, 1), (4, 6), (6, 6)]  # nothing of the text before is left
    plan = store.of_terms(spark.createDataFrame([("quiet",)], "term string"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "bucket#" in plan.split("PartitionFilters", 1)[1][:200]


def test_cells_are_exact_and_hot_cells_are_cut(spark):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=(120, 12)), np.ones((80, 12)) + r.normal(size=(80, 12)) * 0.01])
    items = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(900, None), (901, [0.0] * 12)], "id int, embedding array<double>")
    cells = ann.build_cells(items, cells=9)
    assert cells.rows.sum() == 201
    key = lambda df: sorted((a.query, a.pos, a.item) for a in df.collect())
    true = key(vectors.top_k(items, items, 4))
    assert key(ann.nearest(items, cells, 4, probes=1, block=30)) == true
    assert ann.nearest(items.limit(0), ann.build_cells(items.limit(0)), 3).count() == 0


def test_hash_tables_find_close_pairs_and_copies(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(150, 32))
    rows = [(i, v) for i, v in enumerate(x)] + [(1000 + i, v + r.normal(size=32) * 0.15) for i, v in enumerate(x)] + [(2000 + i, x[0]) for i in range(40)] + [(3000, np.zeros(32))]
    items = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in rows], "id int, embedding array<double>").unionByName(spark.createDataFrame([(4000, None)], "id int, embedding array<double>"))
    true = {(a.a, a.b) for a in vectors.similar_pairs(items, 0.93).collect()}
    got = [(a.a, a.b) for a in ann.lsh_pairs(items, 0.93).collect()]
    assert len(got) == len(set(got)) and set(got) <= true and len(got) >= 0.97 * len(true) and len(true) > 900


def test_postings_are_counted_in_their_rows(spark):
    from vellum.operators import search

    texts = [(i, t) for i, t in enumerate(["the running runs ran a river", "", None, "of the and", "river Rivers river boats boat", "lamp " * 7 + "the lamp"])]
    df = spark.createDataFrame(texts, "id int, text string").repartition(2)
    for stem in (False, True):
        want = {}
        for i, t in texts:
            for at, w in enumerate((t or "").lower().split()):
                if w not in search.STOP:
                    want.setdefault((i, search.porter(w) if stem else w), []).append(at)
        post = search.analyze(df, "id", "text", stem)
        got = {(x.id, x.term): x.positions for x in post.collect()}
        assert got == want and {(x.id, x.term): x.tf for x in post.collect()} == {k: len(v) for k, v in want.items()}
        assert {x.id: x.doc_len for x in post.collect()} == {i: sum(len(v) for k, v in want.items() if k[0] == i) for i in {k[0] for k in want}}
    plan = search.postings_of(search.word_arrays(df, "id", "text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


def test_titles_are_compared_in_batches_and_words_stemmed_once(spark, monkeypatch):
    """Word similarity against brute force, with small bounds too; equal titles are judged once, and postings of asked terms are those of all terms."""
    import random

    from vellum.operators import search

    r = random.Random(1)
    names = ["".join(r.choice("abce1") for _ in range(r.randrange(1, 6))) for _ in range(30)]
    grams = lambda t: [f"  {w} "[i : i + 3] for w in t.split() for i in range(len(w) + 1)]

    def best(q: str, t: str) -> float:
        a, b, top = set(grams(q)), grams(t), 0.0
        for i in range(len(b)):
            seen: set = set()
            for x in b[i:]:
                seen.add(x)
                top = max(top, len(a & seen) / len(a | seen))
        return top

    titles = [" ".join(r.choice(names) for _ in range(r.choice((0, 1, 3, 8, 30)))) for _ in range(60)]
    asked = [" ".join(r.choice(names) for _ in range(r.randrange(1, 4))) for _ in range(9)]
    want = {(q, t) for q, x in enumerate(asked) for t, y in enumerate(titles) if best(x, y) > 0.42}
    for tried, far in ((1, 3), (300, 20), (4_000_000, 256)):
        monkeypatch.setattr(search, "TRIED", tried), monkeypatch.setattr(search, "FAR", far)
        assert {(q, t) for t, y in enumerate(titles) for q in np.flatnonzero(search.similar_words(y, [np.unique(search._codes(x)) for x in asked], 0.42))} == want
    m = spark.createDataFrame([(t + k * 100, y.upper() if k else y) for t, y in enumerate(titles) for k in (0, 1)], "id int, title string")
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, raw string")
    got = {(x.query_id, x.material_id): x.rank for x in search.title_hits(q, m).collect()}
    size = lambda x, y: len(set(grams(x)) & set(grams(y))) / len(set(grams(x)) | set(grams(y)))
    assert got == {(a, b + k): size(asked[a], titles[b]) for a, b in want for k in (0, 100)} and got
    docs = spark.createDataFrame([(1, "running runs a runner the rivers"), (2, "river hopes hoped"), (3, None)], "id int, text string")
    words = settle(search.word_arrays(docs, "id", "text"))
    some = spark.createDataFrame([("run",), ("river",), ("gone",)], "term string")
    every = search.postings_of(words).join(some, "term", "left_semi").select("id", "term", "tf", "doc_len")
    assert sorted(map(tuple, search.asked_postings(words, some).collect())) == sorted(map(tuple, every.collect()))
