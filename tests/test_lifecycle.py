"""Filing, lifecycle decisions, audit, sources and incremental work on small tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from vellum.operators import history, lifecycle, listing, topics
from vellum.sources import tables
from vellum.streaming import incremental

def now():
    return F.lit("2026-05-01 00:00:00").cast("timestamp")


MATERIAL = "id string, slug string, title string, author string, summary string, status string, r2_key_pdf string, sha256 string, view_count int, download_count int, duplicate_of_id string, archived_at timestamp, published_at timestamp, updated_at timestamp, text_public boolean"


def material(id, status="review", key="k", archived=None, dup=None, views=1):
    import datetime as d

    return (id, f"slug-{id}", f"Title {id}", None, None, status, key, f"sha-{id}", views, 0, dup, d.datetime(2026, 1, 1) if archived else None, None, None, False)


def test_decisions(spark):
    m = spark.createDataFrame([material("a"), material("b", "published"), material("c", key=None), material("d", archived=1)], MATERIAL)
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("zz",)], "id string")
    out, refused, audit = lifecycle.publish(m, ids, now())
    assert {r.id: r.status for r in out.collect()} == {"a": "published", "b": "published", "c": "review", "d": "review"}
    assert {r.id: r.reason for r in refused.collect()} == {"b": "already published", "c": "no file", "d": "archived", "zz": "not found"}
    assert [r.entity_id for r in audit.collect()] == ["a"]
    out, refused, _ = lifecycle.archive(m, spark.createDataFrame([("a", "old"), ("b", "x"), ("d", "again")], "id string, reason string"), now())
    assert [r.id for r in out.where("status = 'archived'").collect()] == ["a"] and refused.count() == 2
    out, _, _ = lifecycle.restore(m, ids.where("id = 'd'"), now())
    assert out.where("archived_at is not null").count() == 0
    out, refused, _ = lifecycle.edit(m, spark.createDataFrame([("a", " New ", " ", "s"), ("b", "x", None, None)], "id string, title string, author string, summary string"), now())
    assert out.where("id = 'a'").select("title", "author", "summary").first() == ("New", None, "s") and refused.first().id == "b"


def test_resolve_pairs(spark):
    m = spark.createDataFrame([material("a", views=5), material("b", views=7), material("c"), material("d")], MATERIAL)
    f = spark.createDataFrame([("a", "t1", 0), ("b", "t1", 0), ("b", "t2", 1)], "material_id string, category_id string, ordinal int")
    pairs = spark.createDataFrame([("p1", "a", "b", "pending"), ("p2", "b", "c", "pending"), ("p3", "c", "d", "merged")], "id string, material_a_id string, material_b_id string, status string").withColumn("decided_at", F.lit(None).cast("timestamp"))
    out = lifecycle.resolve_pairs(pairs, m, f, spark.createDataFrame([("p1", "a"), ("p3", "c")], "id string, keep string"), now())
    assert {r.id: r.status for r in out["pairs"].collect()} == {"p1": "merged", "p2": "dismissed", "p3": "merged"}
    got = {r.id: r for r in out["materials"].collect()}
    assert got["a"].view_count == 12 and got["b"].duplicate_of_id == "a" and got["b"].archived_at is not None
    assert {(r.material_id, r.category_id) for r in out["filings"].collect()} == {("a", "t1"), ("a", "t2")}
    assert [r.id for r in out["refused"].collect()] == ["p3"]
    log = {r.action: r for r in out["audit"].collect()}
    assert (log["duplicate.merge"].entity_type, log["duplicate.merge"].entity_id) == ("duplicate", "p1") and json.loads(log["duplicate.merge"].before)["kept"] == "Title a"
    assert json.loads(log["duplicate.merge"].after) == {"keptId": "a", "archivedId": "b", "filingsMoved": 1}
    assert log["material.archive"].entity_id == "b" and json.loads(log["material.archive"].after)["reason"] == "A duplicate of “Title a”, which was kept instead."
    assert history.validate({"filings": out["filings"], "materials": out["materials"]}).count() == 0


def test_topics(spark):
    f = spark.createDataFrame([("m", "x", 0), ("m", "y", 1), ("n", "x", 0)], "material_id string, category_id string, ordinal int")
    merged = topics.merge_topic(f, spark.createDataFrame([("x", "y")], "source string, target string"))
    assert {(r.material_id, r.category_id, r.ordinal) for r in merged.collect()} == {("m", "y", 1), ("n", "y", 0)}
    more, refused = topics.assign(f, spark.createDataFrame([("m", "z", "u", True), ("m", "x", "u", False)], "material_id string, category_id string, assigned_by string, from_suggestion boolean"), now())
    assert more.where("category_id = 'z'").first().ordinal == 2 and refused.count() == 1
    t = spark.createDataFrame([("1", "hope", "Hope", None, None), ("2", "old", "Old", "about", None), ("3", "gone", "Gone", None, "1")], "id string, slug string, name string, blurb string, merged_into_id string")
    entries = spark.createDataFrame([("hope", "b"), ("old", "b"), ("gone", "b"), ("none", "b")], "slug string, blurb string")
    assert {r.slug: r.outcome for r in topics.describe_topics(entries, t).collect()} == {"hope": "write", "old": "already-described", "gone": "merged", "none": "not-found"}
    ok, no = topics.create_topics(spark.createDataFrame([("Hope",), ("Love",), ("love!",)], "name string"), t)
    assert ok.count() == 1 and no.count() == 2


def test_history(spark):
    rows = [(1, "u", "material.archive", "m", None, json.dumps({"reason": " "}), "2026-01-02"), (2, "v", "duplicate.merge", "k", json.dumps({"kept": "k"}), json.dumps({"archivedId": "m"}), "2026-01-01"), (3, "u", "topic.rename", "t", json.dumps({"name": "Old"}), json.dumps({"topic": 5, "name": "New"}), "2026-01-03")]
    a = spark.createDataFrame(rows, "id int, actor_id string, action string, entity_id string, before string, after string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    m = spark.createDataFrame([material("m", archived=1, dup="k"), material("k")], MATERIAL)
    assert history.why_archived(a, m).select("reason", "actor_id", "original_live").first() == ("Merged into k", "v", True)
    assert a.where("id = 3").select(history.changed_name(F.col("before"), F.col("after"))).first()[0] == "New"
    changed = history.derive_audit(m, m.withColumn("status", F.when(F.col("id") == "k", "published").otherwise(F.col("status"))), "id")
    assert [(r.entity_id, json.loads(r.after)) for r in changed.collect()] == [("k", {"status": "published"})]
    assert {r.rule for r in history.validate({"materials": m.unionByName(m)}).collect()} >= {"live slug is unique"}


def test_sheet_and_tables(spark, tmp_path):
    (tmp_path / "s.csv").write_text('junk,,\n"SN","Title","Author","Drive Link (Ctrl + Click)","Topics/Tags"\n1,"A ""b""\nc",Me,https://d.example/file/d/ID_1/view,"Hope; TBD"\n2,,x,https://y,\n3,No link,x,none,\n4,D,,https://x?id=Q,Love\n')
    got = tables.parse_sheet(tables.read_sheet(spark, str(tmp_path / "s.csv"))).orderBy("row").collect()
    assert [(r.row, r.title, r.file_id, r.topics) for r in got] == [(0, 'A "b"\nc', "ID_1", ["Hope"]), (1, "D", "Q", ["Love"])]
    wide = ",".join(f"c{i}" for i in range(60))
    (tmp_path / "w.csv").write_text(f"Name,{wide},Title,Link\nfirst,{wide},second,https://x?id=Q\n")
    assert [r.title for r in tables.read_sheet(spark, str(tmp_path / "w.csv")).collect()] == ["first"]  # the first column that is a title, and all columns
    assert tables.map_columns(["SN", "Title", "Name", "Link"]) == {"title": 1, "url": 3}
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, w int")
    new = spark.createDataFrame([(2, "B", 9), (3, "C", 3)], "k int, v string, w int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(tables.upsert(old, new, ["k"], ["v"])) == [(1, "a", 1), (2, "B", 2), (3, "C", 3)]
    assert rows(tables.insert_ignore(old, new, ["k"], ["w"])) == [(1, "a", 1), (2, "b", 2), (3, "C", 3)]
    assert rows(tables.replace_children(old, new, "k")) == [(1, "a", 1), (2, "B", 9), (3, "C", 3)]


def test_contains_join(spark):
    pages = spark.createDataFrame([("m", 1, "The  quick\nbrown fox"), ("n", 1, "xy a"), ("o", 2, None)], "material_id string, page_number int, text string")
    terms = spark.createDataFrame([(1, "quick brown"), (2, "xy"), (3, "absent thing"), (4, " ")], "query_id int, term string")
    assert sorted((r.query_id, r.material_id) for r in listing.contains_join(terms, pages).collect()) == [(1, "m"), (2, "n")]


def test_stream_replay(spark, tmp_path):
    """Each file is handled once, and handling a batch twice changes nothing."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(b"%PDF-1")
    out, seen = str(tmp_path / "out"), []

    def handle(df, batch):
        seen.append(batch)
        for _ in range(2):
            incremental.write_batch(df.select("path", "length"), out, batch)

    for name in (None, "b.pdf", None):
        if name:
            (folder / name).write_bytes(b"%PDF-22")
        incremental.ingest_stream(spark, str(folder), str(tmp_path / "ck"), handle).awaitTermination()
    assert spark.read.parquet(out).count() == 2 and len(seen) == len(set(seen))


def test_activity_stream(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.repartition(1).write.parquet(str(tmp_path / "e"))
    incremental.activity_stream(spark, str(tmp_path / "e"), src.schema, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    batch = {tuple(r) for r in incremental.activity_windows(src).collect()}
    top = src.agg(F.max("ts")).first()[0]
    import datetime as d

    done = {w for w in batch if w[0] + d.timedelta(hours=2) <= top}  # complete windows, an hour behind the newest row
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "o")).collect()} == done and 0 < len(done) < len(batch)
