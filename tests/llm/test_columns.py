"""Columns that users have are kept whatever their names, and a cut counts no gram twice."""

from __future__ import annotations

import numpy as np

from vellum.llm import fingerprints, langid, pii


def test_users_columns_stay(spark):
    rows = [(i, f"the text number {i} of many words" if i % 4 else None, "aa" if i % 2 else "bb", i, i, i, i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _lang int, _pii int, _w int, found int")
    for made in (langid.predict(docs, langid.train(docs)), pii.find(docs, pii.train(docs)), fingerprints.fingerprint(docs)):
        assert set(docs.columns) <= set(made.columns) and len(made.columns) == len(set(made.columns))
        assert all(r["_lang"] == r["_pii"] == r["_w"] == r["found"] == r["doc_id"] for r in made.collect())


def test_grams_across_a_cut_count_once():
    c = np.array([97 + i * i % 23 for i in range(1000)], np.uint64)
    cut = np.concatenate([langid.grams(c[a : a + 100 + 3], 100) for a in range(0, 1000, 100)])
    assert sorted(cut) == sorted(langid.grams(c))
