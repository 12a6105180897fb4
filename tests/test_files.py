"""A folder of many files."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.plans import records


def test_files_stand_on_few_shelves_and_keep_their_pages(spark, tmp_path, monkeypatch):
    pages = spark.range(400).select((F.col("id") * 3).alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") != 7, F.expr("repeat('é', cast(id as int))")).alias("html"))
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(records, "scratch", lambda spark: f"{tmp_path}/files")
    got = sorted(tuple(r) for r in records.scanned_files(spark, str(tmp_path)).collect())
    assert got == [(3 * i, 2 * i + 1, False) for i in range(400) if i != 7]
    assert len([f for f in (tmp_path / "files").iterdir() if f.is_dir()]) <= 256
