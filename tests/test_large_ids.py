"""Queries over documents whose ids are far beyond those of the small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.plans import records
from vellum.sources.scratch import new_path


def test_work_in_flight_of_large_ids(spark):
    d = new_path(spark, "files")
    docs = spark.range(700_000, 700_200).select(F.col("id").alias("doc_id"), F.lit("a title").alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(7).cast("long").alias("n_chars"))
    docs.write.parquet(f"{d}/documents.parquet")
    got = sorted(r.id for r in records.work_in_flight(spark, d).collect())
    assert got == [i for i in range(700_000, 700_200) if i % 11 and i % 5 in (2, 3) and i + 1 >= 700_199 - 99]
