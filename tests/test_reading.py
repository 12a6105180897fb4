"""A table behind JDBC, and stems against published pairs."""

from __future__ import annotations

import pytest

from vellum.operators import search
from vellum.sources import tables

# Words and stems as the algorithm's author published them.
STEMS = {"caress": "caress", "cats": "cat", "feed": "feed", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "falling": "fall", "hissing": "hiss", "failing": "fail", "filing": "file", "happy": "happi", "conditional": "condit", "rational": "ration",
         "digitizer": "digit", "radically": "radic", "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "formality": "formal", "sensitivity": "sensit", "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good",
         "revival": "reviv", "allowance": "allow", "inference": "infer", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "communism": "commun", "activate": "activ", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controlling": "control", "roll": "roll"}


def test_published_stems():
    assert {w: search.porter(w) for w in STEMS} == STEMS


def test_jdbc_parts(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/store;create=true"
    try:
        spark.range(100).selectExpr("id", "concat('row ', id) as name").write.jdbc(url, "things", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    except Exception as missing:  # a Spark without this driver
        if "ClassNotFound" in str(missing):
            pytest.skip("no embedded database here")
        raise
    got = tables.load_jdbc(spark, url, "things", "id", 0, 100, 4)
    assert got.rdd.getNumPartitions() == 4 and sorted(r[0] for r in got.select("id").collect()) == list(range(100))


def test_pages_are_read_in_batches(spark):
    """A page is a row of a batch, not a group of its own; many pages at once are read as each alone, with empty lines, nulls and pages of one line."""
    from pyspark.sql import functions as F

    from vellum.operators import layout

    lines = [(f"p{k}", t, 0.9, x, 0.9 - i / 20, w, 0.02 if i else 0.05) for k in range(40) for i, (t, x, w) in enumerate([("Heading over both", 0.1, 0.8), ("Q", 0.1, 0.02), (f"uick {k}", 0.1, 0.35), ("left two", 0.1, 0.35), ("left three", 0.1, 0.35), (f"right {k}", 0.55, 0.35), (None, 0.55, 0.35), ("  ", 0.55, 0.35), ("right two", 0.55, 0.35)][: 9 if k % 5 else k // 5])]
    boxes = spark.createDataFrame(lines, layout.BOXES).repartition(3, F.rand(1))
    found = layout.reading_order(boxes, "bottom")
    assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {x.page_key: x.text for x in found.collect()}
    assert got["p1"] == "Heading over both\nQuick 1\nleft two\nleft three\nright 1\nright two" and got["p5"] == "Heading over both" and "p0" not in got and len(got) == 39
    for k in (3, 10, 15):
        assert layout.reading_order(boxes.where(F.col("page_key") == f"p{k}"), "bottom").first().text == got[f"p{k}"]
