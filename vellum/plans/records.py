"""Registered queries of the record operators: sources and sinks, filters, cards, filing, lifecycle, audit, streams; with the SQL that says the same.

Documents stand for materials, labels for their pages, events for the audit log.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions import vectors as V
from vellum.operators import ann, duplicates, history, layout, lifecycle, listing, search, topics, vectors
from vellum.plans.queries import SQL, STOPPED, TITLE, WORDS, first_line, query, table
from vellum.plans.queries import _chunks as chunked
from vellum.plans.queries import _queries as asked
from vellum.sources import tables
from vellum.sources.scratch import new_path, spread
from vellum.streaming import incremental

STATES = ("published", "review", "staged", "processing", "rejected")


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one, for files that a query derives from the tables."""
    return new_path(spark, "files")


def hours(n) -> F.Column:
    return F.timestamp_seconds(n.cast("long") * 3600)  # 3600 times a whole literal would overflow an int


def materials(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    return table(spark, d, "documents").select(
        n.alias("id"), F.concat(F.lit("d-"), n.cast("string")).alias("slug"), first_line().alias("title"), F.col("source").alias("author"), F.col("lang").alias("summary"),
        F.get(F.array(*map(F.lit, STATES)), F.pmod(n, F.lit(5)).cast("int")).alias("status"), F.when(n % 11 == 0, F.lit("2026-01-01").cast("timestamp")).alias("archived_at"), hours(n).alias("created_at"), hours(n + 1).alias("updated_at"),
        F.when(n % 7 != 0, F.concat(F.lit("k/"), n.cast("string"))).alias("r2_key_pdf"), (n % 2 == 0).alias("text_public"), F.when(n % 3 == 0, "text_layer").otherwise("none").alias("ocr_engine"), F.sha2("text", 256).alias("sha256"),
        F.lit(None).cast("long").alias("duplicate_of_id"), (n % 10).alias("view_count"), (n % 4).alias("download_count"), F.lit(None).cast("timestamp").alias("published_at"),
    )


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Two pages of each labelled document."""
    lab = table(spark, d, "labels").withColumn("page_number", F.explode(F.array(F.lit(1), F.lit(2))))
    n, p = F.col("doc_id"), F.col("page_number")
    text = F.when((n + p) % 4 != 0, F.concat(F.lit("page "), p.cast("string"), F.lit(" of "), n.cast("string")))
    return lab.select(n.alias("material_id"), p, F.when(F.col("toxic") == 1, "none").when(n % 3 == 0, "text_layer").otherwise("vision").alias("ocr_engine"), F.when(F.col("quality") == 1, 0.9).otherwise(0.3).alias("ocr_quality"), F.when((n + p) % 3 != 0, F.concat(F.lit("i/"), p.cast("string"))).alias("r2_key_webp"), text.alias("text"))


def filings(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    one = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("material_id"), F.col("source").alias("category_id"), F.lit(0).alias("ordinal"))
    return one.unionByName(docs.where("doc_id % 6 = 1").select(F.col("doc_id").alias("material_id"), F.lit("extra").alias("category_id"), F.lit(1).alias("ordinal"))).withColumn("assigned_by", F.col("material_id") % 50)


def topic_table(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select(F.col("source").alias("id")).distinct().unionByName(spark.createDataFrame([("extra",)], "id string"))
    return s.select("id", F.concat(F.lit("s-"), "id").alias("slug"), F.upper("id").alias("name"), F.lit("about").alias("blurb"), F.lit(None).cast("string").alias("merged_into_id"))


def accounts(spark: SparkSession, d: str) -> DataFrame:
    """Customers, by name and a made-up address."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat(F.col("c_custkey").cast("string"), F.lit("@x.example")).alias("email"))


def audit(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("actor_id"), F.col("event_type").alias("action"), (F.col("event_id") % 97).cast("string").alias("entity_id"), F.lit("material").alias("entity_type"), F.col("ts").cast("timestamp").alias("created_at"), F.lit(None).cast("string").alias("before"), F.col("props").alias("after"))


MAT = """m AS (SELECT doc_id AS id, 'd-' || doc_id AS slug, split_part(text, chr(10), 1) AS title, source AS author, lang AS summary, ['published','review','staged','processing','rejected'][doc_id % 5 + 1] AS status, doc_id % 11 = 0 AS gone,
 doc_id % 7 <> 0 AS has_file, doc_id % 2 = 0 AS text_public, CASE WHEN doc_id % 3 = 0 THEN 'text_layer' ELSE 'none' END AS engine, sha256(text) AS sha256, doc_id % 10 AS views, doc_id % 4 AS downloads FROM documents),
pg AS (SELECT doc_id AS id, p, CASE WHEN toxic = 1 THEN 'none' WHEN doc_id % 3 = 0 THEN 'text_layer' ELSE 'vision' END AS engine, CASE WHEN quality = 1 THEN 0.9 ELSE 0.3 END AS q, (doc_id + p) % 3 <> 0 AS image, CASE WHEN (doc_id + p) % 4 <> 0 THEN 'page ' || p || ' of ' || doc_id END AS text FROM labels, (VALUES (1), (2)) AS v(p)),
f AS (SELECT doc_id AS id, source AS topic, 0 AS o FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'extra', 1 FROM documents WHERE doc_id % 6 = 1),
tp AS (SELECT DISTINCT source AS id FROM documents UNION ALL SELECT 'extra')"""

# ---- sources and sinks -----------------------------------------------------------------------------------------------------------


@query("SELECT row_number() OVER (ORDER BY page_id) - 1 AS \"row\", 'Page ' || page_id AS title, 'Writer \"' || page_id % 7 || '\"' AS author, 'F' || page_id AS file_id, 'Alpha|Beta ' || page_id % 5 || '|alpha' AS topics FROM pages")
def sheet_rows(spark: SparkSession, d: str) -> DataFrame:
    """Pages set down as a sheet with a line above its header, and read from it."""
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("t"), F.concat(F.lit('Writer "'), (F.col("page_id") % 7).cast("string"), F.lit('"')).alias("a"), F.concat(F.lit("https://drive.google.com/file/d/F"), F.col("page_id").cast("string"), F.lit("/view")).alias("l"), F.concat(F.lit("Alpha, Beta "), (F.col("page_id") % 5).cast("string"), F.lit(", alpha")).alias("g"))
    head = spark.createDataFrame([(-2, "", "A sheet\nof pages", "", "", ""), (-1, "SN", "Title", "Author", "Drive Link (Ctrl + Click)", "Topics/Tags")], "k long, c0 string, c1 string, c2 string, c3 string, c4 string")
    body = p.select(F.col("page_id").alias("k"), F.col("page_id").cast("string").alias("c0"), F.col("t").alias("c1"), F.col("a").alias("c2"), F.col("l").alias("c3"), F.col("g").alias("c4"))
    path = scratch(spark)
    head.unionByName(body).orderBy("k").drop("k").coalesce(1).write.csv(path, quoteAll=True, escape='"')
    return tables.parse_sheet(tables.read_sheet(spark, path)).select("row", "title", "author", "file_id", F.array_join("topics", "|").alias("topics"))


@query("SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'labels', count(*) FROM labels")
def loaded_tables(spark: SparkSession, d: str) -> DataFrame:
    found = [df.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, df in tables.load_tables(spark, d, ("nation", "orders", "labels")).items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("SELECT page_id, strlen(html) + 1 AS length, false AS is_pdf FROM pages WHERE html IS NOT NULL")
def scanned_files(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as a file each, and the folder listed with its bytes. Files stand on shelves, whose folders are moved and listed as wholes; the n-th file of a shelf is its n-th page."""
    path = scratch(spark)
    kept = table(spark, d, "pages").where("html is not null").select("page_id", "html", F.pmod(F.xxhash64("page_id"), F.lit(256)).alias("shelf"))
    kept.repartition("shelf").sortWithinPartitions("shelf", "page_id").select("shelf", "html").write.partitionBy("shelf").option("maxRecordsPerFile", 1).text(path)
    found = tables.scan_files(spark, path, ".txt").select(F.regexp_extract("path", "shelf=([0-9]+)", 1).cast("long").alias("shelf"), F.regexp_extract("path", "[.-]c([0-9]+)[.]txt$", 1).cast("int").alias("n"), "length", "is_pdf")
    named = kept.select("shelf", (F.row_number().over(W.partitionBy("shelf").orderBy("page_id")) - 1).alias("n"), "page_id")
    return found.join(named, ["shelf", "n"]).select("page_id", "length", "is_pdf")


@query("SELECT 'f' || doc_id AS file_id, split_part(text, chr(10), 1) AS name, md5(text) AS md5, n_chars AS size FROM documents WHERE text IS NOT NULL")
def manifest(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    docs = table(spark, d, "documents").where("text is not null")
    docs.select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_id"), first_line().alias("name"), F.md5("text").alias("md5"), F.col("n_chars").alias("size"), hours(F.col("doc_id")).alias("modified")).write.json(path)
    return tables.read_manifest(spark, path).select("file_id", "name", "md5", "size")


@query("""WITH l AS (SELECT conv_id || '-' || turn AS page_key, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS t FROM conversations WHERE turn % 5 <> 0 UNION ALL SELECT conv_id || '-' || turn, [text] FROM conversations WHERE turn % 5 = 0)
SELECT page_key, len(t) AS boxes, CASE WHEN page_key LIKE '%0' OR page_key LIKE '%5' THEN 0.25 ELSE round(1 - 1.0::DOUBLE / (len(t) + 1), 9) END AS y FROM l WHERE len(t) > 0""")
def line_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Turns as recognised pages: every fifth has a line with its box, the others text alone; one line of the file is malformed."""
    path = scratch(spark)
    c = table(spark, d, "conversations")
    box = F.struct(F.col("text"), F.lit(0.8).alias("confidence"), F.lit(0.1).alias("x"), F.lit(0.25).alias("y"), F.lit(0.5).alias("width"), F.lit(0.1).alias("height"))
    rows = c.select(F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("page_key"), "text", F.when(F.col("turn") % 5 == 0, F.array(box)).alias("lines"))).alias("value"))
    rows.unionByName(spark.createDataFrame([('{"page_key": "x", "text": ',)], "value string")).write.text(path)
    found = tables.read_line_boxes(spark, path).where("page_key is not null and size(boxes) > 0")
    return found.select("page_key", F.size("boxes").alias("boxes"), F.round(F.col("boxes")[0]["y"], 9).alias("y"))


@query(r"""WITH k AS (SELECT conv_id || '-' || turn AS page_key, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM conversations) SELECT page_key, array_to_string(w, ' ') AS text,
round(CASE WHEN len(w) = 1 THEN 0.9::DOUBLE ELSE list_avg(list_filter(list_transform(range(0, len(w)), lambda i: (i % 3) / 2.0::DOUBLE), lambda c: c > 0)) END, 9) AS confidence, round(((len(w) - 1) * 10 + 8) / 1000.0::DOUBLE, 9) AS width FROM k WHERE len(w) > 0""")
def word_trees(spark: SparkSession, d: str) -> DataFrame:
    """Turns as page - block - paragraph - word - symbol trees in JSON, and the paragraphs read out of them."""
    c = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("page_key"), T.plain_words(F.col("text")).alias("w")).where("size(w) > 0")
    point = lambda i, x, y: F.struct((i * 10 + x).cast("double").alias("x"), F.lit(float(y)).alias("y"))
    word = lambda x, i: F.struct((F.pmod(i, F.lit(3)) / 2).alias("confidence"), F.struct(F.array(point(i, 0, 5), point(i, 8, 9)).alias("vertices")).alias("boundingBox"), F.transform(F.split(x, ""), lambda s: F.struct(s.alias("text"))).alias("symbols"))
    tree = F.array(F.struct(F.lit(1000.0).alias("width"), F.lit(100.0).alias("height"), F.array(F.struct(F.array(F.struct(F.transform("w", word).alias("words"))).alias("paragraphs"))).alias("blocks")))
    found = tables.flatten_word_tree(c.select("page_key", F.to_json(tree).alias("json")), "json")
    return found.select("page_key", "text", F.round("confidence", 9).alias("confidence"), F.round("width", 9).alias("width"))


@query("""WITH l AS (SELECT conv_id || '-' || turn AS page_key, string_split(text, chr(10)) AS t FROM conversations), u AS (SELECT page_key, len(t) AS n, unnest(t) AS x, unnest(range(0, len(t))) AS i FROM l)
SELECT page_key, i, trim(x) AS text, round(0.5::DOUBLE + (i % 2) / 4.0, 9) AS confidence, round((i * 20.0::DOUBLE) / (n * 20 - 5), 9) AS y FROM u""")
def line_trees(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("page_key"), F.split("text", "\n").alias("t"))
    line = lambda x, i: F.struct(x.alias("text"), (50 + F.pmod(i, F.lit(2)) * 25).cast("double").alias("confidence"), F.struct(F.lit(0.0).alias("x0"), (i * 20).cast("double").alias("y0"), F.lit(100.0).alias("x1"), (i * 20 + 15).cast("double").alias("y1")).alias("bbox"))
    tree = F.struct(F.array(F.struct(F.array(F.struct(F.transform("t", line).alias("lines"))).alias("paragraphs"))).alias("blocks"))
    found = tables.flatten_line_tree(c.select("page_key", F.size("t").alias("n"), F.to_json(tree).alias("json")), "json")
    sized = found.join(c.select("page_key", F.size("t").alias("n")), "page_key")
    return sized.select("page_key", F.round(F.col("y") * (F.col("n") * 20 - 5) / 20).cast("long").alias("i"), "text", F.round("confidence", 9).alias("confidence"), F.round("y", 9).alias("y"))


@query(f"WITH {MAT} SELECT id, 9 AS p FROM pg WHERE id % 5 = 0 AND p = 1 UNION ALL SELECT id, p FROM pg WHERE id % 5 <> 0")
def replaced_pages(spark: SparkSession, d: str) -> DataFrame:
    old = pages(spark, d).select("material_id", "page_number")
    new = old.where("material_id % 5 = 0 and page_number = 1").withColumn("page_number", F.lit(9))
    return tables.replace_children(old, new, "material_id").select(F.col("material_id").alias("id"), F.col("page_number").alias("p"))


@query(SQL["replaced_pages"])
def stored_pages(spark: SparkSession, d: str) -> DataFrame:
    """The same from a table on disk whose buckets are replaced, by a batch that comes twice."""
    old, path = pages(spark, d).select("material_id", "page_number"), scratch(spark)
    new = old.where("material_id % 5 = 0 and page_number = 1").withColumn("page_number", F.lit(9))
    for batch in (old, new, new):
        tables.replace_stored(spark, path, batch, "material_id", buckets=16)
    return spark.read.parquet(path).select(F.col("material_id").alias("id"), F.col("page_number").alias("p"))


@query("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey < 10 UNION ALL SELECT c_nationkey, min_by(c_name, c_custkey) FROM customer WHERE c_nationkey >= 10 GROUP BY c_nationkey")
def inserted_rows(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.lit(0).cast("long").alias("seq"))
    new = table(spark, d, "customer").select(F.col("c_nationkey").cast(dict(old.dtypes)["k"]).alias("k"), F.col("c_name").alias("name"), F.col("c_custkey").cast("long").alias("seq"))
    return tables.insert_ignore(old, new, ["k"], ["seq"]).select("k", "name")


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS name, c_custkey % 3 = 0 AND c_custkey % 2 <> 0 AS fresh FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def upserted_rows(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.lit(False).alias("fresh"))
    return tables.upsert(c.where("k % 2 = 0"), c.where("k % 3 = 0").select("k", F.when(F.col("k") % 2 == 0, "new").otherwise(F.col("name")).alias("name"), F.lit(True).alias("fresh")), ["k"], ["name"])


@query(SQL["upserted_rows"])
def snapshot_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same from snapshots that a manifest names; a batch that comes again makes none."""
    c, path = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.lit(False).alias("fresh")), scratch(spark)
    new = c.where("k % 3 = 0").select("k", F.when(F.col("k") % 2 == 0, "new").otherwise(F.col("name")).alias("name"), F.lit(True).alias("fresh"))
    for batch, rows in ((0, c.where("k % 2 = 0")), (1, new), (1, c.limit(0)), (0, c.limit(0))):
        tables.upsert_stored(spark, path, rows, ["k"], ["name"], batch)
    return tables.read_snapshot(spark, path)[0]


@query(f"WITH {MAT} SELECT 'https://x.example/' AS url, NULL::BIGINT AS at UNION ALL SELECT 'https://x.example/topics/s-' || id, NULL FROM tp UNION ALL SELECT 'https://x.example/materials/' || slug, (id + 1) * 3600 FROM m WHERE status = 'published'")
def url_index(spark: SparkSession, d: str) -> DataFrame:
    fixed = spark.createDataFrame([("/",)], "path string")
    return tables.export_url_index(materials(spark, d), topic_table(spark, d), fixed, "https://x.example/").select("url", F.unix_seconds("last_modified").alias("at"))


UUID = "substr(md5({0}), 1, 8) || '-' || substr(md5({0}), 9, 4) || '-' || substr(md5({0}), 13, 4) || '-' || substr(md5({0}), 17, 4) || '-' || substr(md5({0}), 21, 12)"


@query(f"""WITH {MAT}, k AS (SELECT id, CASE WHEN id % 10 = 0 THEN 'no-uuid' ELSE {UUID.format("id::VARCHAR")} END AS u FROM m) SELECT 'original' AS kind, 'originals/' || u || '.pdf' AS key FROM k WHERE id % 10 <> 0
UNION ALL SELECT 'page', 'pages/' || u || '/' || p || '.webp' FROM k JOIN pg ON pg.id = k.id WHERE k.id % 10 <> 0 UNION ALL SELECT 'thumbnail', 'thumbs/' || u || '.webp' FROM k WHERE id % 10 <> 0""")
def stored_objects(spark: SparkSession, d: str) -> DataFrame:
    named = lambda c: F.when(F.col(c) % 10 == 0, "no-uuid").otherwise(F.expr(UUID.format(f"cast({c} as string)")))
    return tables.object_keys(materials(spark, d).select(named("id").alias("id")), pages(spark, d).select(named("material_id").alias("material_id"), "page_number"), "https://x.example").select("kind", "key")


# ---- filters and cards --------------------------------------------------------------------------------------------------------------


@query(f"WITH {MAT} SELECT m.id FROM m WHERE author = 'src1' AND EXISTS (SELECT 1 FROM f WHERE f.id = m.id AND f.topic = 'src1')")
def filtered_library(spark: SparkSession, d: str) -> DataFrame:
    return listing.library_filter(materials(spark, d), filings(spark, d), topic_table(spark, d), "s-src1", "src1").select("id")


@query(f"""WITH {MAT}, k AS (SELECT m.*, EXISTS (SELECT 1 FROM f WHERE f.id = m.id) AS filed, EXISTS (SELECT 1 FROM pg WHERE pg.id = m.id AND engine = 'none') AS unread, EXISTS (SELECT 1 FROM pg WHERE pg.id = m.id AND q < 0.55) AS poor FROM m)
SELECT 'review' AS kind, id FROM k WHERE NOT gone AND status = 'review' UNION ALL SELECT 'archived', id FROM k WHERE gone UNION ALL SELECT 'in-progress', id FROM k WHERE NOT gone AND status IN ('staged', 'processing', 'rejected')
UNION ALL SELECT 'uncategorised', id FROM k WHERE NOT gone AND NOT filed UNION ALL SELECT 'needs-ocr', id FROM k WHERE NOT gone AND unread UNION ALL SELECT 'poorly-read', id FROM k WHERE NOT gone AND poor UNION ALL SELECT 'all', id FROM k WHERE NOT gone""")
def backlogs(spark: SparkSession, d: str) -> DataFrame:
    m, p, f = materials(spark, d), pages(spark, d), filings(spark, d)
    kinds = ("review", "archived", "in-progress", "uncategorised", "needs-ocr", "poorly-read", "all")
    return listing.fuse_lists({k: listing.backlog_filter(m, p, f, k).select("id") for k in kinds}).select(F.col("source").alias("kind"), "id")


@query(f"WITH {MAT} SELECT id FROM m WHERE contains(lower(title), 'the') OR contains(lower(author), 'the') OR contains(lower(summary), 'the')")
def admin_search(spark: SparkSession, d: str) -> DataFrame:
    return listing.ilike_any(materials(spark, d), ("title", "author", "summary"), " THE ").select("id")


@query(f"WITH {MAT}, t AS (SELECT max(id) AS top FROM m) SELECT id FROM m, t WHERE NOT gone AND status IN ('staged', 'processing') AND id + 1 >= top - 99")
def work_in_flight(spark: SparkSession, d: str) -> DataFrame:
    m = materials(spark, d)
    top = m.agg(F.max("id")).first()[0] or 0
    return listing.in_flight(m, hours(F.lit(top + 1)), "100 hours").select("id")


@query(f"WITH {MAT} SELECT id, id % 4 = 0 AS forced FROM m WHERE NOT gone AND EXISTS (SELECT 1 FROM pg WHERE pg.id = m.id AND text IS NOT NULL)")
def embedding_backlog(spark: SparkSession, d: str) -> DataFrame:
    m, p = materials(spark, d), pages(spark, d)
    have = m.where("id % 4 = 0").select(F.col("id").alias("material_id"))
    plain = listing.needs_embedding(m, p, have).select("id", F.lit(False).alias("forced"))
    return plain.unionByName(listing.set_minus(listing.needs_embedding(m, p, have, force=True), plain, ["id"]).select("id", F.lit(True).alias("forced")))


@query(f"""WITH {MAT} SELECT 'new' AS mode, id, p FROM pg WHERE engine = 'none' AND image UNION ALL SELECT 'server', id, p FROM pg WHERE engine = 'none' AND image AND text IS NULL
UNION ALL SELECT 'redo', id, p FROM pg WHERE engine <> 'vision' AND image UNION ALL SELECT 'force', id, p FROM pg WHERE engine = 'vision' AND image""")
def reading_queue(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    lists = {m: listing.needs_reading(p, m) for m in ("new", "redo", "force")} | {"server": listing.needs_reading(p, "new", empty_only=True)}
    return listing.fuse_lists(lists).select(F.col("source").alias("mode"), F.col("material_id").alias("id"), F.col("page_number").alias("p"))


@query(f"WITH {MAT} SELECT id, p FROM pg WHERE text IS NOT NULL AND engine = 'vision'")
def vision_pages(spark: SparkSession, d: str) -> DataFrame:
    return listing.engine_scope(pages(spark, d), "vision").select(F.col("material_id").alias("id"), F.col("page_number").alias("p"))


@query(f"WITH k AS (SELECT DISTINCT {UUID.format('(doc_id % 300)::VARCHAR')} AS id FROM documents WHERE doc_id % 10 <> 0) SELECT id FROM k ORDER BY id LIMIT 100")
def checked_ids(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").select(F.when(F.col("doc_id") % 10 == 0, F.col("doc_id").cast("string")).otherwise(F.expr(UUID.format("cast(doc_id % 300 as string)"))).alias("id"))
    return listing.valid_ids(n)


@query("SELECT event_id AS id FROM events WHERE json_extract_string(props, '$.k') = '3'")
def events_with_field(spark: SparkSession, d: str) -> DataFrame:
    return listing.json_field_equals(audit(spark, d), "after", "k", "3").select("id")


@query(f"WITH {MAT}, l AS (SELECT id, string_agg(upper(topic), '|' ORDER BY o) AS topics, arg_min(upper(topic), o) AS one FROM f GROUP BY id) SELECT m.id, l.topics, coalesce(one, 'uncategorised') AS shelf FROM m LEFT JOIN l ON l.id = m.id")
def shelves(spark: SparkSession, d: str) -> DataFrame:
    named = listing.topics_for(filings(spark, d), topic_table(spark, d)).withColumnRenamed("material_id", "id")
    cards = listing.with_uncategorised(materials(spark, d).select("id").join(named, "id", "left"))
    return cards.select("id", F.array_join("topics", "|").alias("topics"), "shelf")


@query(f"WITH {MAT} SELECT id FROM m WHERE NOT EXISTS (SELECT 1 FROM pg WHERE pg.id = m.id)")
def pageless(spark: SparkSession, d: str) -> DataFrame:
    return listing.no_children(materials(spark, d), pages(spark, d)).select("id")


@query(f"WITH {MAT} SELECT f.id, upper(topic) AS topic, o, c_name AS filed_by FROM f LEFT JOIN customer ON c_custkey = f.id % 50")
def filing_records(spark: SparkSession, d: str) -> DataFrame:
    return listing.filed_by(filings(spark, d), topic_table(spark, d), accounts(spark, d)).select(F.col("material_id").alias("id"), "topic", F.col("ordinal").alias("o"), "filed_by")


@query(f"WITH {MAT}, k AS (SELECT id, count(*) AS stuck FROM pg WHERE engine = 'none' AND NOT image GROUP BY id) SELECT k.id, stuck, title FROM k JOIN m ON m.id = k.id")
def stuck(spark: SparkSession, d: str) -> DataFrame:
    return listing.stuck_pages(materials(spark, d), pages(spark, d)).select(F.col("material_id").alias("id"), "stuck", "title")


@query(f"WITH {MAT}, t AS (SELECT id, trim(string_agg(text, chr(10) || chr(10) ORDER BY p)) AS t FROM pg WHERE text IS NOT NULL GROUP BY id) SELECT m.id, CASE WHEN text_public THEN t END AS text FROM m LEFT JOIN t ON t.id = m.id")
def public_text(spark: SparkSession, d: str) -> DataFrame:
    return listing.readable_text(pages(spark, d), materials(spark, d)).select(F.col("material_id").alias("id"), "text")


@query(f"""WITH {MAT}, h AS (SELECT id, count(text) AS with_text, count(*) FILTER (WHERE q < 0.55) AS poor, avg(length(coalesce(text, ''))) >= 9 AS usable, bool_or(engine = 'vision') AS read FROM pg GROUP BY id)
SELECT h.id, with_text, poor, usable, CASE WHEN m.engine <> 'text_layer' AND read THEN 'vision' ELSE m.engine END AS engine FROM h JOIN m ON m.id = h.id""")
def page_report(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    best = listing.best_engine(materials(spark, d), p).select(F.col("id").alias("material_id"), F.col("ocr_engine").alias("engine"))
    return listing.page_health(p).join(listing.has_usable_text(p, 9), "material_id").join(best, "material_id").withColumnRenamed("material_id", "id")


@query(f"WITH {MAT} SELECT count(*) FILTER (WHERE NOT gone) AS materials, count(*) FILTER (WHERE NOT gone AND id % 4 = 0) AS embedded, coalesce(sum(CASE WHEN NOT gone AND id % 4 = 0 THEN 2 END), 0)::BIGINT AS chunks, count(*) FILTER (WHERE NOT gone AND id % 4 <> 0) AS skipped FROM m")
def embedding_progress(spark: SparkSession, d: str) -> DataFrame:
    m = materials(spark, d)
    parts = m.where("id % 4 = 0").select(F.col("id").alias("material_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk"))
    return listing.embed_progress(m, parts)


@query(f"WITH {MAT} SELECT id FROM m WHERE status = 'published' ORDER BY id DESC LIMIT 8")
def newest(spark: SparkSession, d: str) -> DataFrame:
    return listing.recent(materials(spark, d)).select("id")


@query(f"""WITH {MAT}, r AS (SELECT id, row_number() OVER (ORDER BY id DESC) AS recent, row_number() OVER (ORDER BY id) AS oldest, row_number() OVER (ORDER BY views, id) AS relevance FROM (SELECT id, views FROM m WHERE status = 'published'))
SELECT 'recent' AS sort, id FROM r WHERE recent BETWEEN 11 AND 20 UNION ALL SELECT 'oldest', id FROM r WHERE oldest BETWEEN 11 AND 20 UNION ALL SELECT 'relevance', id FROM r WHERE relevance BETWEEN 11 AND 20""")
def library_browse(spark: SparkSession, d: str) -> DataFrame:
    """The second page of ten of the library in several orders, browsed and as a search's hits."""
    m, f, t = materials(spark, d), filings(spark, d), topic_table(spark, d)
    hits = m.select(F.col("id").alias("material_id"), (F.col("view_count")).cast("int").alias("pos"), F.lit(1).alias("page"))
    lists = {s: search.library(hits if s == "relevance" else None, m, f, t, sort=s, page=2, size=10)[0].select("id") for s in ("recent", "oldest", "relevance")}
    return listing.fuse_lists(lists).select(F.col("source").alias("sort"), "id")


@query(f"WITH {MAT}, k AS (SELECT count(*) AS n FROM m WHERE status = 'published' AND EXISTS (SELECT 1 FROM f WHERE f.id = m.id AND topic = 'src1')) SELECT n AS total, greatest(1, (n + 47) // 48) AS pages, n > 48 AS has_more FROM k")
def library_totals(spark: SparkSession, d: str) -> DataFrame:
    _, about = search.library(None, materials(spark, d), filings(spark, d), topic_table(spark, d), topic="s-src1", sort="no such order")
    return spark.createDataFrame([(about["total"], about["pages"], about["has_more"])], "total long, pages long, has_more boolean")


@query(f"""WITH {MAT}, l AS (SELECT id, string_agg(upper(topic), '|' ORDER BY o) AS topics FROM f GROUP BY id), g AS (SELECT id, count(*) AS pages, trim(string_agg(text, chr(10) || chr(10) ORDER BY p)) AS t FROM pg GROUP BY id)
SELECT m.slug, l.topics, g.pages, CASE WHEN text_public THEN t END AS readable FROM m LEFT JOIN l ON l.id = m.id LEFT JOIN g ON g.id = m.id WHERE status = 'published' AND m.id % 7 = 0""")
def cards_by_slug(spark: SparkSession, d: str) -> DataFrame:
    m = materials(spark, d)
    found = search.by_slug(m.where("id % 7 = 0").select("slug"), m, filings(spark, d), topic_table(spark, d), pages(spark, d))
    return found.select("slug", F.array_join("topics", "|").alias("topics"), F.nullif(F.size("pages"), F.lit(-1)).cast("long").alias("pages"), "readable")


@query(f"WITH {MAT} SELECT 'd-' || x AS slug, x % 2 AS except_id, EXISTS (SELECT 1 FROM m WHERE m.id = x AND m.id <> x % 2) AS taken FROM (SELECT DISTINCT doc_id * 2 AS x FROM documents UNION SELECT 1) q")
def slug_checks(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "documents").select((F.col("doc_id") * 2).alias("x")).union(spark.createDataFrame([(1,)], "x long")).distinct()
    return search.slug_taken(asked.select(F.concat(F.lit("d-"), F.col("x").cast("string")).alias("slug"), (F.col("x") % 2).alias("except_id")), materials(spark, d))


@query(f"WITH {MAT} SELECT id FROM tp WHERE id IN ('src0', 'extra')")
def topics_by_slug(spark: SparkSession, d: str) -> DataFrame:
    return search.topic_by_slug(spark.createDataFrame([("s-src0",), ("s-extra",), ("s-none",)], "slug string"), topic_table(spark, d)).select("id")


# ---- pairs and duplicates ---------------------------------------------------------------------------------------------------------------


def pairs(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    docs = table(spark, d, "documents").where("doc_id % 4 = 0")
    return docs.select(n.alias("id"), n.alias("a"), (n + 1).alias("b"), n.alias("material_a_id"), (n + 1).alias("material_b_id"), ((n % 100) / 100).alias("score"), F.element_at(F.array(*map(F.lit, ("pending", "merged", "dismissed"))), (n / 4 % 3 + 1).cast("int")).alias("status"), hours(n).alias("created_at"), hours(2 * n).alias("decided_at"))


PAIRS = "p AS (SELECT doc_id AS id, doc_id AS a, doc_id + 1 AS b, (doc_id % 100) / 100.0::DOUBLE AS score, ['pending', 'merged', 'dismissed'][(doc_id // 4) % 3 + 1] AS status FROM documents WHERE doc_id % 4 = 0)"


@query(f"""WITH {PAIRS} SELECT 'pending' AS list, id FROM (SELECT id FROM p WHERE status = 'pending' ORDER BY score DESC, id LIMIT 20 OFFSET 5) UNION ALL SELECT 'decided', id FROM (SELECT id FROM p WHERE status <> 'pending' ORDER BY id DESC LIMIT 50)
UNION ALL SELECT 'strongest', id FROM (SELECT id FROM p ORDER BY score DESC, a, b LIMIT 10)""")
def pair_lists(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    found = {"pending": listing.pending_pairs(p, 20, 5), "decided": listing.decided_pairs(p), "strongest": listing.strongest(p)}
    return listing.fuse_lists({k: v.select("id") for k, v in found.items()}).select(F.col("source").alias("list"), "id")


@query(f"WITH {MAT}, {PAIRS} SELECT p.id, x.title AS title_a, y.title AS title_b FROM p JOIN m x ON x.id = p.a JOIN m y ON y.id = p.b")
def pair_cards(spark: SparkSession, d: str) -> DataFrame:
    both = listing.pair_sides(pairs(spark, d).select("id", "material_a_id", "material_b_id"), materials(spark, d).select("id", "title"))
    return both.select("id", F.col("side_a.title").alias("title_a"), F.col("side_b.title").alias("title_b"))


@query(f"WITH {MAT}, {PAIRS} SELECT p.a, p.b FROM p JOIN m x ON x.id = p.a JOIN m y ON y.id = p.b WHERE p.status = 'pending' ORDER BY score DESC, p.a, p.b LIMIT 20")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.pending_review(pairs(spark, d).select("a", "b", "score", "status"), materials(spark, d).select("id", "title")).select("a", "b")


@query("""WITH i AS (SELECT doc_id AS id, sha256(text) AS s FROM documents WHERE doc_id % 2 = 1 AND text IS NOT NULL), h AS (SELECT sha256(text) AS s, min(doc_id) AS e FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL GROUP BY 1), o AS (SELECT s, min(id) AS one FROM i GROUP BY s)
SELECT i.id, h.e AS existing_id, i.id = o.one AS first FROM i LEFT JOIN h ON h.s = i.s JOIN o ON o.s = i.s""")
def incoming_twins(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("arrival"), F.sha2("text", 256).alias("sha256"))
    return duplicates.exact_duplicates(m.where("id % 2 = 1"), m.where("id % 2 = 0")).select("id", "existing_id", "first")


@query("""WITH s AS (SELECT doc_id AS id, CASE WHEN doc_id % 9 <> 1 THEN sha256(text) END AS s, CASE WHEN doc_id % 4 = 1 THEN 'other' ELSE split_part(text, chr(10), 1) END AS t FROM documents WHERE doc_id % 2 = 1 AND text IS NOT NULL),
e AS (SELECT doc_id AS id, sha256(text) AS s, split_part(text, chr(10), 1) AS t FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL),
k AS (SELECT s.id, min(CASE WHEN e.id IS NULL OR lower(trim(e.t)) <> lower(trim(s.t)) THEN 1 ELSE 0 END) AS differs, count(e.id) AS n FROM s LEFT JOIN e ON e.s = s.s GROUP BY s.id)
SELECT s.id, CASE WHEN s.s IS NULL THEN 'no-file' WHEN n = 0 THEN 'not-a-duplicate' WHEN differs = 1 THEN 'mis-titled' ELSE 'duplicate' END AS outcome FROM s JOIN k ON k.id = s.id""")
def stuck_outcomes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    n = F.col("doc_id")
    staged = docs.where("doc_id % 2 = 1").select(n.alias("id"), F.when(n % 4 == 1, "other").otherwise(first_line()).alias("title"), F.when(n % 9 != 1, F.sha2("text", 256)).alias("sha256"))
    there = docs.where("doc_id % 2 = 0").select(n.alias("id"), first_line().alias("title"), F.sha2("text", 256).alias("sha256"))
    return duplicates.settle_stuck(staged, there).select("id", "outcome")


# ---- filing and topics -------------------------------------------------------------------------------------------------------------------


@query("WITH r AS (SELECT doc_id AS row, unnest(['Alpha ' || lang, upper('alpha ' || lang), 'src1', source]) AS name, unnest([0, 1, 2, 3]) AS pos FROM documents), s AS (SELECT replace(lower(name), ' ', '-') AS slug, arg_min(name, (row, pos)) AS name FROM r WHERE name IS NOT NULL GROUP BY 1) SELECT slug, name FROM s WHERE slug <> 'src1'")
def seeded_topics(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    alpha = F.concat(F.lit("Alpha "), "lang")
    rows = docs.select(F.col("doc_id").alias("row"), F.array(alpha, F.upper(alpha), F.lit("src1"), F.col("source")).alias("topics")).withColumn("topics", F.array_compact("topics"))
    return topics.seed_topics(rows, spark.createDataFrame([("src1",)], "slug string"))


@query(f"""WITH {MAT}, f2 AS (SELECT id, CASE WHEN topic = 'src1' AND id % 2 = 0 THEN 'back' ELSE topic END AS topic FROM f) SELECT topic, count(*) AS n FROM f2 GROUP BY 1""")
def unmerged_topics(spark: SparkSession, d: str) -> DataFrame:
    f = filings(spark, d)
    wanted = f.where("material_id % 2 = 0").select("material_id")
    return topics.unmerge_topic(f, "back", "src1", wanted).groupBy(F.col("category_id").alias("topic")).agg(F.count("*").alias("n"))


@query(f"""WITH {MAT}, r AS (SELECT DISTINCT id, 'extra' AS topic FROM m WHERE id % 6 IN (0, 1, 2)), n AS (SELECT r.* FROM r LEFT JOIN f ON f.id = r.id AND f.topic = r.topic WHERE f.id IS NULL), o AS (SELECT id, max(o) AS o FROM f GROUP BY id)
SELECT f.id, topic, o FROM f UNION ALL SELECT n.id, n.topic, coalesce(o.o + 1, 0) FROM n LEFT JOIN o ON o.id = n.id""")
def assigned_topics(spark: SparkSession, d: str) -> DataFrame:
    f = filings(spark, d)
    asked = materials(spark, d).where("id % 6 in (0, 1, 2)").select(F.col("id").alias("material_id"), F.lit("extra").alias("category_id"), F.lit(1).cast("long").alias("assigned_by"), F.lit(True).alias("from_suggestion"))
    now = F.lit("2026-01-01").cast("timestamp")
    return topics.assign(f, asked, now)[0].select(F.col("material_id").alias("id"), F.col("category_id").alias("topic"), F.col("ordinal").alias("o"))


@query(f"""WITH {MAT} SELECT 'renamed' AS what, id AS k, 0::BIGINT AS n FROM tp WHERE id IN ('src0', 'src2') UNION ALL SELECT 'refused', 'src1', 0 UNION ALL SELECT 'deleted', 'src3', count(*) FROM f WHERE topic = 'src3' UNION ALL SELECT 'left', topic, count(*) FROM f WHERE topic NOT IN ('src3', 'extra') GROUP BY topic UNION ALL SELECT 'kept', topic, count(*) FROM f WHERE topic = 'extra' AND id % 2 = 0 GROUP BY topic""")
def topic_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """Renames, of which one takes another's slug; a topic deleted; filings taken away."""
    t = topic_table(spark, d).withColumn("slug", T.slugify(F.col("name")))
    f = filings(spark, d)
    ok, refused = topics.rename_topics(spark.createDataFrame([("src0", "New name"), ("src2", "SRC2"), ("src1", "Src3"), ("none", "x")], "id string, name string"), t)
    left_topics, left, gone = topics.delete_topics(spark.createDataFrame([("src3",)], "id string"), t, f)
    kept = topics.unassign(left, left.where("category_id = 'extra' and material_id % 2 = 1"))
    count = lambda df, what: df.groupBy(F.lit(what).alias("what"), F.col("category_id").alias("k")).agg(F.count("*").alias("n"))
    names = lambda df, what: df.select(F.lit(what).alias("what"), F.col("id").alias("k"), F.lit(0).cast("long").alias("n"))
    return names(ok, "renamed").unionByName(names(refused, "refused")).unionByName(gone.select(F.lit("deleted").alias("what"), F.col("category_id").alias("k"), F.col("filings").cast("long").alias("n"))).unionByName(count(left.where("category_id <> 'extra'"), "left")).unionByName(count(kept.where("category_id = 'extra'"), "kept"))


@query("""WITH r AS (SELECT DISTINCT n_name AS name FROM nation UNION ALL SELECT r_name FROM region), s AS (SELECT regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') AS slug, name FROM r), o AS (SELECT slug, min(name) AS name FROM s GROUP BY slug)
SELECT slug, CASE WHEN slug LIKE 'a%' THEN 'refused' ELSE 'accepted' END AS outcome FROM o""")
def created_topics(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "nation").select(F.col("n_name").alias("name")).distinct().union(table(spark, d, "region").select("r_name"))
    there = r.select(T.slugify(F.col("name")).alias("slug")).where("slug like 'a%'").distinct()
    ok, refused = topics.create_topics(r, there)
    return ok.select("slug", F.lit("accepted").alias("outcome")).unionByName(refused.select("slug", F.lit("refused").alias("outcome")).distinct())


@query("SELECT 's-' || source AS slug, CASE source WHEN 'src0' THEN 'merged' WHEN 'src1' THEN 'already-described' ELSE 'write' END AS outcome FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) q UNION ALL SELECT 's-none', 'not-found'")
def described_topics(spark: SparkSession, d: str) -> DataFrame:
    t = topic_table(spark, d).where("id <> 'extra' and id is not null")
    held = t.withColumn("blurb", F.when(F.col("id") == "src1", "told").otherwise(" ")).withColumn("merged_into_id", F.when(F.col("id") == "src0", "src1"))
    entries = t.select("slug", F.lit("new words").alias("blurb")).union(spark.createDataFrame([("s-none", "x")], "slug string, blurb string"))
    return topics.describe_topics(entries, held).select("slug", "outcome")


@query("""WITH r AS (SELECT page_id AS row, 'f' || page_id AS fid, CASE WHEN page_id % 2 = 0 THEN 'Same' ELSE 'Title ' || page_id END AS title FROM pages WHERE page_id % 3 <> 0), n AS (SELECT row, title, row_number() OVER (PARTITION BY title ORDER BY row) AS k FROM r)
SELECT n.row, CASE WHEN title = 'Same' AND k > 1 THEN 'same-' || k WHEN title = 'Same' THEN 'same' ELSE 'title-' || n.row END AS slug, t.topic_slug, t.ordinal FROM n, (VALUES ('one', 0), ('two', 1)) AS t(topic_slug, ordinal)""")
def imported_sheet(spark: SparkSession, d: str) -> DataFrame:
    p, n = table(spark, d, "pages"), F.col("page_id")
    rows = p.select(n.alias("row"), F.when(n % 2 == 0, "Same").otherwise(F.concat(F.lit("Title "), n.cast("string"))).alias("title"), F.lit(" ").alias("author"), F.lit("").alias("summary"), F.concat(F.lit("f"), n.cast("string")).alias("file_id"), F.array(F.lit("One"), F.lit("Two"), F.lit("one")).alias("topics"))
    there = rows.where("row % 3 = 0").select(F.col("file_id").alias("drive_file_id"), F.concat(F.lit("old-"), F.col("row").cast("string"), F.lit("x")).alias("slug"))
    made, filed = topics.import_materials(rows, there)
    return made.select("row", "slug").join(filed, "slug").select("row", "slug", "topic_slug", "ordinal")


# ---- suggestions, vectors ---------------------------------------------------------------------------------------------------------------


def _named_topics(e: DataFrame) -> DataFrame:
    """A topic for each label, standing where its first vector stands."""
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return first.select(F.col("label").cast("string").alias("id"), "embedding", F.when(F.col("label") == 9, "0").alias("merged_into_id"))


TOPIC_NEAR = """t AS (SELECT label AS l, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label HAVING label <> 9),
nm AS (SELECT e.vec_id AS q, t.l, list_cosine_similarity(e.embedding::DOUBLE[], t.v::DOUBLE[]) AS c, row_number() OVER (PARTITION BY e.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], t.v::DOUBLE[]) DESC, t.l::VARCHAR) AS pos FROM embeddings e, t)"""


@query(f"WITH {TOPIC_NEAR} SELECT q AS material_id, l::VARCHAR AS topic, round(c, 6) AS similarity FROM nm WHERE pos <= 3")
def name_matches(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    docs = e.select(F.col("vec_id").cast("string").alias("id"), "embedding")
    return topics.name_match(docs.withColumn("id", F.concat(F.lit("d"), "id")), _named_topics(e)).select(F.expr("cast(substring(material_id, 2) as bigint)").alias("material_id"), "topic", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH n AS (SELECT x.vec_id AS q, y.label AS l, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS c, row_number() OVER (PARTITION BY x.vec_id ORDER BY list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) DESC, ('d' || y.vec_id)) AS pos FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id),
w AS (SELECT q, sum(c) AS total FROM n WHERE pos <= 15 GROUP BY q), b AS (SELECT n.q, l, sum(c) AS w FROM n WHERE pos <= 15 AND l <> 9 GROUP BY n.q, l), r AS (SELECT b.*, row_number() OVER (PARTITION BY b.q ORDER BY b.w DESC, l::VARCHAR) AS r FROM b),
v AS (SELECT r.q, l, r.w / total AS share, r.w FROM r JOIN w ON w.q = r.q WHERE r <= 3 AND r.w / total >= 0.2), {TOPIC_NEAR},
a AS (SELECT q, l, 0 AS o, w AS g FROM v UNION ALL SELECT nm.q, nm.l, 1, nm.c FROM nm LEFT JOIN v ON v.q = nm.q AND v.l = nm.l WHERE nm.pos <= 3 AND v.q IS NULL), z AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY o, g DESC, l::VARCHAR) AS pos FROM a)
SELECT q AS material_id, l::VARCHAR AS topic, pos::INT AS pos FROM z WHERE pos <= 3""")
def merged_suggestions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    name = F.concat(F.lit("d"), F.col("vec_id").cast("string"))
    docs = e.select(name.alias("id"), "embedding")
    filed = e.select(name.alias("material_id"), F.col("label").cast("string").alias("category_id"))
    out = topics.suggest(docs, docs, filed, _named_topics(e))
    return out.select(F.expr("cast(substring(material_id, 2) as bigint)").alias("material_id"), "topic", "pos")


@query(r"""WITH k AS (SELECT conv_id AS id, turn AS o, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM conversations WHERE text IS NOT NULL), u AS (SELECT id FROM k GROUP BY id HAVING sum(len(w)) > 0) SELECT count(*) AS documents, true AS all_unit FROM u""")
def embedded_corpus(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "conversations").select(F.col("conv_id").alias("material_id"), F.col("turn").alias("page_number"), "text")
    made = vectors.embed_corpus(p)
    whole = vectors.document_vectors(made)
    return whole.agg(F.count("*").alias("documents"), F.bool_and(V.is_normalised(F.col("embedding"))).alias("all_unit"))


@query(f"WITH {MAT} SELECT count(*) AS topics, true AS all_unit FROM tp WHERE id IS NOT NULL")
def embedded_topics(spark: SparkSession, d: str) -> DataFrame:
    t = vectors.embed_topics(topic_table(spark, d).where("id is not null"))
    return t.agg(F.count("*").alias("topics"), F.bool_and(V.is_normalised(F.col("embedding"))).alias("all_unit"))


@query("""WITH n AS (SELECT x.vec_id AS q, y.vec_id % 100 AS m, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS c, row_number() OVER (PARTITION BY x.vec_id ORDER BY list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) DESC, y.vec_id) AS pos
FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE x.vec_id % 20 = 0) SELECT q AS query_id, m AS material_id, round(max(c), 6) AS rank FROM n WHERE pos <= 50 GROUP BY 1, 2""")
def meaning_hits(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    parts = e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 100).alias("material_id"), "embedding")
    found = search.semantic_hits(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("id"), "embedding"), parts, cells=ann.build_cells(parts))
    return found.select("query_id", "material_id", F.round("rank", 6).alias("rank"))


# ---- lifecycle ---------------------------------------------------------------------------------------------------------------------------

NOW = "2026-01-02"


def _now():
    return F.lit(NOW).cast("timestamp")


@query(f"""WITH {MAT} SELECT 'row' AS what, id, 'staged-' || id AS v FROM m UNION ALL SELECT 'filing', id, author || ':0' FROM m WHERE author IS NOT NULL UNION ALL SELECT 'filing', id, 'x:' || CASE WHEN author IS NULL THEN '0' ELSE '1' END FROM m UNION ALL SELECT 'audit', id, 'material.create' FROM m
UNION ALL SELECT 'audit', id, 'material.categorise' FROM m WHERE author IS NOT NULL UNION ALL SELECT 'audit', id, 'material.categorise' FROM m""")
def staged_materials(spark: SparkSession, d: str) -> DataFrame:
    m = materials(spark, d)
    made, filed, log = lifecycle.stage(m.select("id", "title", "author", "summary", F.lit("drive").alias("source"), F.array_compact(F.array("author", F.lit("x"))).alias("topics")), _now())
    one = lambda df, what, id, v: df.select(F.lit(what).alias("what"), F.col(id).alias("id"), v.alias("v"))
    return one(made, "row", "id", F.col("slug")).unionByName(one(filed, "filing", "material_id", F.concat_ws(":", "category_id", "ordinal"))).unionByName(one(log, "audit", "entity_id", F.col("action")))


@query("""WITH s AS (SELECT doc_id AS id, CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE 'Title ' || doc_id END AS title, CASE WHEN doc_id % 7 = 0 THEN 'no ' ELSE '%PDF-' END || (doc_id % 400) AS c FROM documents WHERE doc_id % 2 = 0),
e AS (SELECT doc_id AS id, '%PDF-' || doc_id AS c FROM documents WHERE doc_id % 2 = 1), o AS (SELECT c, min(id) AS one FROM s GROUP BY c), h AS (SELECT c, min(id) AS e FROM e GROUP BY c)
SELECT s.id, CASE WHEN length(trim(title)) < 2 THEN 'the title is too short' WHEN NOT starts_with(s.c, '%PDF-') THEN 'the file is not a PDF' WHEN h.e IS NOT NULL OR o.one <> s.id THEN 'the file is already here' END AS reason,
CASE WHEN length(trim(title)) >= 2 AND starts_with(s.c, '%PDF-') THEN coalesce(h.e, CASE WHEN o.one <> s.id THEN o.one END) END AS twin FROM s JOIN o ON o.c = s.c LEFT JOIN h ON h.c = s.c""")
def ingested(spark: SparkSession, d: str) -> DataFrame:
    docs, n = table(spark, d, "documents"), F.col("doc_id")
    staged = docs.where("doc_id % 2 = 0").select(n.alias("id"), F.when(n % 13 == 0, "x").otherwise(F.concat(F.lit("Title "), n.cast("string"))).alias("title"), F.lit("staged").alias("status"))
    body = lambda head, tail: F.concat(head, tail.cast("string")).cast("binary")
    files = docs.where("doc_id % 2 = 0").select(n.alias("id"), body(F.when(n % 7 == 0, "no ").otherwise("%PDF-"), n % 400).alias("content"))
    there = docs.where("doc_id % 2 = 1").select(n.alias("id"), F.sha2(body(F.lit("%PDF-"), n), 256).alias("sha256"), F.concat(F.lit("d-"), n.cast("string")).alias("slug"), F.lit(None).cast("timestamp").alias("archived_at"))
    own = staged.select(F.col("id").alias("material_id"), F.lit(1).alias("page_number"), F.lit("some words on a page").alias("text"))
    done, _, _ = lifecycle.ingest(staged, files, there, own, _now())
    return done.select("id", "reason", F.col("duplicate_of_id").alias("twin"))


@query(f"""WITH {MAT}, r AS (SELECT id, CASE WHEN gone THEN 'archived' WHEN status = 'published' THEN 'already published' WHEN NOT has_file THEN 'no file' END AS why FROM m WHERE id % 2 = 0)
SELECT id, coalesce(why, 'published') AS outcome FROM r UNION ALL SELECT -1, 'not found'""")
def published_batch(spark: SparkSession, d: str) -> DataFrame:
    m = materials(spark, d)
    asked = m.where("id % 2 = 0").select("id").union(spark.createDataFrame([(-1,)], "id long"))
    _, refused, log = lifecycle.publish(m, asked, _now())
    return refused.select("id", F.col("reason").alias("outcome")).unionByName(log.select(F.col("entity_id").alias("id"), F.lit("published").alias("outcome")))


@query(f"""WITH {MAT} SELECT 'archive' AS what, id, CASE WHEN id % 4 = 0 THEN 'a reason is needed' WHEN gone THEN 'already archived' ELSE 'done' END AS outcome FROM m WHERE id % 2 = 0
UNION ALL SELECT 'restore', id, CASE WHEN gone THEN 'done' ELSE 'not archived' END FROM m WHERE id % 3 = 0 UNION ALL SELECT 'edit', id, CASE WHEN id % 5 = 0 THEN 'the title is too short' ELSE 'done' END FROM m WHERE id % 10 < 6 UNION ALL SELECT 'text', id, 'done' FROM m WHERE id % 7 = 1""")
def lifecycle_batch(spark: SparkSession, d: str) -> DataFrame:
    m = materials(spark, d)
    steps = {
        "archive": lifecycle.archive(m, m.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, " x ").otherwise("torn page").alias("reason")), _now()),
        "restore": lifecycle.restore(m, m.where("id % 3 = 0").select("id"), _now(), to="published"),
        "edit": lifecycle.edit(m, m.where("id % 10 < 6").select("id", F.when(F.col("id") % 5 == 0, "x").otherwise("A new title").alias("title"), F.lit("").alias("author"), F.lit(None).cast("string").alias("summary")), _now()),
        "text": lifecycle.set_text_public(m, m.where("id % 7 = 1").select("id", F.lit(True).alias("text_public")), _now()),
    }
    lists = {k: refused.select("id", F.col("reason").alias("outcome")).unionByName(log.select(F.col("entity_id").alias("id"), F.lit("done").alias("outcome"))) for k, (_, refused, log) in steps.items()}
    return listing.fuse_lists(lists).select(F.col("source").alias("what"), "id", "outcome")


@query(f"WITH {PAIRS} SELECT id, CASE WHEN status = 'pending' AND id % 8 = 0 THEN 'dismissed' ELSE status END AS status FROM p")
def dismissed_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    return lifecycle.dismiss_pairs(p, p.where("id % 8 = 0").select("id"), _now())[0].select("id", "status")


RESOLVED = f"""WITH {MAT}, {PAIRS}, ok AS (SELECT p.id, a AS keep, b AS lose, x.title AS kt, y.title AS lt, score FROM p JOIN m x ON x.id = p.a JOIN m y ON y.id = p.b WHERE p.status = 'pending' AND NOT y.gone AND p.id % 8 = 0)"""


@query(f"""{RESOLVED} SELECT 'pair' AS what, id AS k, CASE WHEN id IN (SELECT id FROM ok) THEN 'merged' ELSE status END AS v FROM p UNION ALL SELECT 'archived', m.id, 'onto ' || keep FROM m JOIN ok ON ok.lose = m.id
UNION ALL SELECT 'views', m.id, (views + y.v)::VARCHAR FROM m JOIN ok ON ok.keep = m.id JOIN (SELECT id, views AS v FROM m) y ON y.id = ok.lose UNION ALL SELECT 'reason', lose, 'A duplicate of “' || kt || '”, which was kept instead.' FROM ok WHERE kt IS NOT NULL
UNION ALL SELECT 'kept', id, kt FROM ok WHERE kt IS NOT NULL UNION ALL SELECT 'filing', CASE WHEN ok.lose IS NULL THEN f.id ELSE keep END, topic FROM f LEFT JOIN ok ON ok.lose = f.id WHERE ok.lose IS NULL OR NOT EXISTS (SELECT 1 FROM f g WHERE g.id = ok.keep AND g.topic = f.topic)""")
def resolved_pairs(spark: SparkSession, d: str) -> DataFrame:
    m, p, f = materials(spark, d), pairs(spark, d).select("id", "material_a_id", "material_b_id", "score", "status", "decided_at"), filings(spark, d)
    out = lifecycle.resolve_pairs(p, m, f, p.where("id % 8 = 0").select("id", F.col("material_a_id").alias("keep")), _now())
    one = lambda df, what, k, v: df.select(F.lit(what).alias("what"), k.alias("k"), v.alias("v"))
    new = out["materials"]
    gone = new.where("duplicate_of_id is not null")
    log = out["audit"]
    return (
        one(out["pairs"], "pair", F.col("id"), F.col("status")).unionByName(one(gone, "archived", F.col("id"), F.concat(F.lit("onto "), F.col("duplicate_of_id").cast("string"))))
        .unionByName(one(new.join(gone.select(F.col("duplicate_of_id").alias("id")), "id", "left_semi"), "views", F.col("id"), F.col("view_count").cast("string")))
        .unionByName(one(log.where("action = 'material.archive'"), "reason", F.col("entity_id"), F.get_json_object("after", "$.reason")).where("v is not null"))
        .unionByName(one(log.where("action = 'duplicate.merge'"), "kept", F.col("entity_id"), F.get_json_object("before", "$.kept")).where("v is not null"))
        .unionByName(one(out["filings"], "filing", F.col("material_id"), F.col("category_id")))
    )


@query(f"WITH {MAT}, g AS (SELECT id FROM m WHERE gone AND id % 2 = 0) SELECT 'plan' AS what, g.id, count(p) AS n FROM g LEFT JOIN pg ON pg.id = g.id GROUP BY g.id UNION ALL SELECT 'missing', id, 0 FROM m WHERE NOT has_file")
def purge_report(spark: SparkSession, d: str) -> DataFrame:
    m, p = materials(spark, d), pages(spark, d)
    text = lambda df, c: df.withColumn(c, F.col(c).cast("string"))
    plan, _, _ = lifecycle.purge_plan(text(text(m, "id"), "duplicate_of_id"), text(p, "material_id"), text(m.where("id % 2 = 0").select("id"), "id"))
    return plan.select(F.lit("plan").alias("what"), F.col("id").cast("long").alias("id"), F.col("pages").cast("long").alias("n")).unionByName(lifecycle.missing_files(m).select(F.lit("missing").alias("what"), "id", F.lit(0).cast("long").alias("n")))


SHORT_STAYS = ", ".join(f"'{w}'" for w in (*T.HYPHEN_PREFIXES, *T.HYPHEN_NUMBERS) if len(w) == 4)


@query(rf"""WITH k AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(0, ceil(len(w) / 60.0)::INT)) AS n FROM k), v AS (SELECT doc_id, n, w[n * 60 + 1 : n * 60 + 60] AS v FROM p),
j AS (SELECT doc_id, n, len(list_filter(v, lambda x: regexp_full_match(x, '[a-z]{{8,}}'))) AS joins, array_to_string(list_transform(v, lambda x: CASE WHEN regexp_full_match(x, '[a-z]{{8,}}') AND x[1:4] IN ({SHORT_STAYS}) THEN x[1:4] || '-' || x[5:] ELSE x END), ' ') AS a FROM v)
SELECT doc_id AS id, (n + 1)::INT AS page, joins::INT AS joins, sha256(a) AS after FROM j WHERE joins > 0""")
def repaired_hyphens(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages of 60 words, each of eight letters or more broken after its fourth by a hyphen and a new line, and repaired."""
    words = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    p = words.select("doc_id", F.posexplode(T.chunk_words(F.col("w"), 60, 0)).alias("n", "text"))
    p = p.select(F.col("doc_id").alias("material_id"), (F.col("n") + 1).alias("page_number"), F.lit("vision").alias("ocr_engine"), F.regexp_replace("text", r"(?<= |^)([a-z]{4})([a-z]{4,})(?= |$)", "$1-\n$2").alias("text"))
    return layout.repair_hyphens(p, "vision").select(F.col("material_id").alias("id"), F.col("page_number").alias("page"), F.col("joins").cast("int").alias("joins"), F.sha2("after", 256).alias("after"))


# ---- history -----------------------------------------------------------------------------------------------------------------------------


@query("WITH k AS (SELECT event_id AS id, user_id, ts FROM events WHERE event_type = (SELECT max(event_type) FROM events)), p AS (SELECT * FROM k ORDER BY ts DESC, id LIMIT 50 OFFSET 50) SELECT p.id, c_name AS actor_name FROM p LEFT JOIN customer ON c_custkey = user_id")
def activity_log(spark: SparkSession, d: str) -> DataFrame:
    a = audit(spark, d)
    last = a.agg(F.max("action")).first()[0]
    return history.activity(a, accounts(spark, d), action=last, page=2)[0].select("id", "actor_name")


@query("WITH k AS (SELECT event_id % 97 AS e, arg_max(event_id, (epoch_us(ts), event_id)) AS id, arg_max(user_id, (epoch_us(ts), event_id)) AS u FROM events GROUP BY 1) SELECT e::VARCHAR AS entity_id, id, c_name AS actor_name FROM k LEFT JOIN customer ON c_custkey = u")
def newest_changes(spark: SparkSession, d: str) -> DataFrame:
    return history.last_changes(audit(spark, d), accounts(spark, d)).select("entity_id", "id", "actor_name")


@query("SELECT DISTINCT c_custkey AS id, c_name AS name FROM customer JOIN events ON user_id = c_custkey")
def actor_list(spark: SparkSession, d: str) -> DataFrame:
    return listing.actors(audit(spark, d), accounts(spark, d)).select("id", "name")


@query("SELECT DISTINCT event_type AS action FROM events WHERE event_type IS NOT NULL")
def action_list(spark: SparkSession, d: str) -> DataFrame:
    return listing.distinct_values(audit(spark, d), "action")


def _told(spark: SparkSession, d: str) -> DataFrame:
    """Events as entries of eight kinds, with payloads that name a topic, or do not."""
    n = F.col("id")
    kinds = ("material.categorise", "material.categorise", "material.uncategorise", "category.create", "category.merge", "material.publish", "user.role_change", "some_thing.odd")
    after = F.when(n % 8 == 0, F.to_json(F.struct(F.concat(F.lit("t"), (n % 5).cast("string")).alias("topic")))).when(n % 8 == 1, F.to_json(F.struct(F.lit("gone").alias("removed")))).when(n % 8 == 4, F.to_json(F.struct(F.lit("big").alias("mergedInto")))).when(n % 8 == 6, F.to_json(F.struct(n.alias("name"))))
    before = F.when(n % 8 == 2, F.to_json(F.struct(F.lit("old").alias("had")))).when(n % 8 == 5, F.to_json(F.struct(F.lit("").alias("name"))))
    return audit(spark, d).select("id", F.element_at(F.array(*map(F.lit, kinds)), (n % 8 + 1).cast("int")).alias("action"), before.alias("before"), after.alias("after"))


@query("""SELECT event_id AS id, CASE event_id % 8 WHEN 0 THEN 'Added to t' || (event_id % 5) WHEN 1 THEN 'Removed from gone' WHEN 2 THEN 'Removed from old' WHEN 3 THEN 'Created the topic' WHEN 4 THEN 'Merged into big' WHEN 5 THEN 'Published' WHEN 6 THEN 'Changed someone''s role' ELSE 'Some thing odd' END AS sentence,
CASE event_id % 8 WHEN 0 THEN 'filed' WHEN 1 THEN 'filed' WHEN 2 THEN 'unfiled' WHEN 3 THEN 'created the topic' WHEN 4 THEN 'merged a topic into another' WHEN 5 THEN 'published' WHEN 6 THEN 'changed someone''s role' ELSE 'some thing odd' END AS phrase FROM events""")
def told_changes(spark: SparkSession, d: str) -> DataFrame:
    return history.describe_change(_told(spark, d)).select("id", "sentence", "phrase")


@query(f"""WITH {MAT} SELECT id, CASE WHEN id % 2 = 0 THEN 'torn ' || id ELSE 'Merged into big' END AS reason FROM m WHERE gone""")
def archive_reasons(spark: SparkSession, d: str) -> DataFrame:
    m = materials(spark, d).where("archived_at is not null").withColumn("id", F.col("id").cast("string")).withColumn("duplicate_of_id", F.lit(None).cast("string"))
    n = F.col("id").cast("long")
    entry = lambda df, id, action, entity, before, after: df.select(id.alias("id"), F.lit(action).alias("action"), entity.alias("entity_id"), F.lit(1).cast("long").alias("actor_id"), hours(n).alias("created_at"), before.alias("before"), after.alias("after"))
    none = F.lit(None).cast("string")
    log = entry(m.where("cast(id as bigint) % 2 = 0"), n, "material.archive", F.col("id"), none, F.to_json(F.struct(F.concat(F.lit("torn "), "id").alias("reason")))).unionByName(entry(m, n + 10_000_000, "duplicate.merge", F.concat(F.lit("pair-"), "id"), F.to_json(F.struct(F.lit("big").alias("kept"))), F.to_json(F.struct(F.col("id").alias("archivedId")))))
    return history.why_archived(log, m).select(F.col("id").cast("long").alias("id"), "reason")


@query("SELECT o_orderkey AS id, c_name AS starter, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS details FROM orders LEFT JOIN customer ON c_custkey = o_custkey ORDER BY o_orderkey DESC LIMIT 10")
def sync_runs(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey")
    runs = table(spark, d, "orders").select(n.alias("id"), F.col("o_custkey").alias("started_by"), F.timestamp_seconds(n).alias("started_at"), F.when(n % 3 != 0, F.timestamp_seconds(n + 5)).alias("finished_at"), F.when(n % 2 == 0, '[{"name": "a", "result": "imported"}]').otherwise("{ }").alias("detail"))
    return history.sync_history(runs, accounts(spark, d)).select("id", "starter", F.size("detail").alias("details"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0")
def unfinished_runs(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey")
    return history.open_runs(table(spark, d, "orders").select(n.alias("id"), F.when(n % 3 != 0, F.timestamp_seconds(n)).alias("finished_at"))).select("id")


def _invitations(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_custkey")
    when = lambda k, i: F.when(n % k == i, hours(n))
    return table(spark, d, "customer").select(n.alias("id"), (n % 20).alias("invited_by"), when(4, 1).alias("accepted_at"), when(5, 2).alias("revoked_at"), hours(n).alias("expires_at"), hours(n).alias("created_at"))


INVITED = "i AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 1 THEN 'accepted' WHEN c_custkey % 5 = 2 THEN 'revoked' WHEN c_custkey <= 100 THEN 'expired' ELSE 'open' END AS state FROM customer)"


@query(f"WITH {INVITED} SELECT i.id, c_name AS inviter FROM i LEFT JOIN customer ON c_custkey = i.id % 20 WHERE state = 'open'")
def open_invitations(spark: SparkSession, d: str) -> DataFrame:
    return history.pending_invitations(_invitations(spark, d), accounts(spark, d), hours(F.lit(100))).select("id", "inviter")


@query(f"WITH {INVITED} SELECT id, state FROM i")
def invitation_states(spark: SparkSession, d: str) -> DataFrame:
    return _invitations(spark, d).select("id", T.invitation_state(F.col("accepted_at"), F.col("revoked_at"), F.col("expires_at"), hours(F.lit(100))).alias("state"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey = 0 THEN 'just now' WHEN c_custkey = 1 THEN '1 min ago' WHEN c_custkey < 60 THEN c_custkey || ' mins ago' WHEN c_custkey < 120 THEN '1 hour ago' WHEN c_custkey < 1440 THEN (c_custkey // 60) || ' hours ago' WHEN c_custkey < 2880 THEN 'yesterday' WHEN c_custkey < 43200 THEN (c_custkey // 1440) || ' days ago' END AS ago,
CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_custkey::VARCHAR ELSE 'unknown' END AS shown FROM customer""")
def names_and_times(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("id")
    now = F.lit("2026-01-01").cast("timestamp")
    ago = T.time_ago(F.timestamp_seconds(F.unix_seconds(now) - n * 60), now)
    return accounts(spark, d).select("id", F.when(n < 43200, ago).alias("ago"), T.display_name(F.when(n % 3 == 0, F.col("name")).otherwise(" "), F.when(n % 3 == 1, F.col("email"))).alias("shown"))


@query(f"""WITH {MAT} SELECT id::VARCHAR AS entity_id, CASE WHEN id % 3 = 0 THEN 'change.delete' WHEN id % 3 = 1 THEN 'change.edit' ELSE 'change.create' END AS action FROM m WHERE id % 3 <> 1 OR id % 2 = 0""")
def derived_audit(spark: SparkSession, d: str) -> DataFrame:
    m = materials(spark, d).select("id", "title", "author")
    old, new = m.where("id % 3 in (0, 1)"), m.where("id % 3 in (1, 2)").withColumn("author", F.when(F.col("id") % 2 == 0, "someone").otherwise(F.col("author")))
    return history.derive_audit(old, new, "id").select("entity_id", "action")


@query(f"""WITH {MAT} SELECT id::VARCHAR AS entity_id, CASE WHEN id % 3 = 0 THEN author END AS author_before, CASE WHEN id % 3 = 0 THEN title END AS title_before, CASE WHEN id % 3 = 2 THEN CASE WHEN id % 2 = 0 THEN 'someone' ELSE author END END AS author_after, CASE WHEN id % 3 = 2 THEN title END AS title_after FROM m WHERE id % 3 <> 1
UNION ALL SELECT id::VARCHAR, author, NULL, 'someone', NULL FROM m WHERE id % 3 = 1 AND id % 2 = 0""")
def audit_payloads(spark: SparkSession, d: str) -> DataFrame:
    """What derived audit rows hold of the rows before and after: all of a row that comes or goes, and of an edited one what changed."""
    m = materials(spark, d).select("id", "title", "author")
    old, new = m.where("id % 3 in (0, 1)"), m.where("id % 3 in (1, 2)").withColumn("author", F.when(F.col("id") % 2 == 0, "someone").otherwise(F.col("author")))
    held = lambda side, c: F.get_json_object(side, f"$.{c}").alias(f"{c}_{side}")
    return history.derive_audit(old, new, "id").select("entity_id", *[held(side, c) for side in ("before", "after") for c in ("author", "title")])


@query(f"""WITH {MAT}, u AS (SELECT id, '00000000-0000-4000-8000-' || lpad(id::VARCHAR, 12, '0') AS k FROM m WHERE gone AND id % 2 = 0) SELECT k AS material_id, 'original' AS kind, 'originals/' || k || '.pdf' AS key FROM u UNION ALL SELECT k, 'thumbnail', 'thumbs/' || k || '.webp' FROM u
UNION ALL SELECT k, 'page', 'pages/' || k || '/' || p || '.webp' FROM u JOIN pg ON pg.id = u.id""")
def purged_objects(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the objects that go with purged materials."""
    uuid = lambda c: F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col(c).cast("string"), 12, "0"))
    m, p = materials(spark, d).withColumn("id", uuid("id")).withColumn("duplicate_of_id", F.lit(None).cast("string")), pages(spark, d).withColumn("material_id", uuid("material_id"))
    _, keys, _ = lifecycle.purge_plan(m, p, m.where("cast(right(id, 12) as long) % 2 = 0").select("id"))
    return keys.select("material_id", "kind", "key")


@query(f"""WITH {MAT} SELECT 'status and author are known values' AS rule, id::VARCHAR AS id FROM m WHERE id % 100 = 1 UNION ALL SELECT 'live sha256 is unique', sha256 FROM m WHERE NOT gone AND sha256 IS NOT NULL GROUP BY sha256 HAVING count(*) > 1
UNION ALL SELECT 'a pair in order', (doc_id + 1) || '|' || doc_id FROM documents WHERE doc_id % 50 = 0""")
def integrity(spark: SparkSession, d: str) -> DataFrame:
    m = materials(spark, d).withColumn("status", F.when(F.col("id") % 100 == 1, "odd").otherwise(F.col("status")))
    n = F.col("doc_id")
    p = table(spark, d, "documents").where("doc_id % 50 = 0").select((n + 1).alias("a"), n.alias("b"))
    return history.validate({"materials": m, "pages": pages(spark, d), "filings": filings(spark, d), "pairs": p})


@query(r"""WITH k AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS w FROM documents), b AS (SELECT doc_id, w, regexp_replace(w, '^[^\w]+|[^\w]+$', '', 'g') AS x FROM k)
SELECT doc_id, round(1 - sum(CASE WHEN x <> '' AND length(x) >= 3 AND regexp_matches(x, '(?i)[a-z]') AND x <> upper(x) AND NOT regexp_matches(x, '(?i)[aeiouy]') THEN 1 WHEN x = '' AND (w = repeat(w[1], length(w)) AND length(w) >= 3) THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) AS share FROM b GROUP BY doc_id""")
def share_read(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("trim(text) <> ''").withColumn("clean", T.strip_invented(F.col("text")))
    return docs.select("doc_id", F.round(T.surviving_share(F.col("text"), F.col("clean")), 6).alias("share"))


@query("SELECT conv_id || '-' || turn AS page_key, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text, true AS scored FROM conversations WHERE trim(text) <> ''")
def page_readings(spark: SparkSession, d: str) -> DataFrame:
    """Turns as recognised lines of one column, shuffled, and read again in order."""
    c = table(spark, d, "conversations").where("trim(text) <> ''").select(F.concat_ws("-", "conv_id", "turn").alias("page_key"), F.posexplode(F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: x != "")).alias("i", "text"))
    boxes = c.select("page_key", "text", F.lit(0.9).alias("confidence"), F.lit(0.1).alias("x"), (1 - (F.col("i") + 1) / 1000).alias("y"), F.lit(0.8).alias("width"), F.lit(0.0005).alias("height"))
    return layout.read_page(boxes.orderBy(F.xxhash64("text")), "bottom").select("page_key", "text", F.col("quality").isNotNull().alias("scored"))


@query(r"""WITH k AS (SELECT conv_id, turn, W AS w FROM (SELECT conv_id, turn, WORDS AS W FROM conversations)), p AS (SELECT conv_id, turn, w, unnest(range(0, ceil(len(w) / 41.0)::INT)) AS p FROM k),
f AS (SELECT conv_id, turn, p, list_transform(range(1, 42), lambda i: coalesce(w[p * 41 + i], 'end')) AS v FROM p)
SELECT conv_id || '-' || turn || '-' || p AS page_key, 'Heading ' || v[1] || chr(10) || 'Q' || CASE WHEN regexp_matches(v[2], '^[a-z]') THEN '' ELSE chr(10) END || array_to_string(list_transform(range(0, 8), lambda i: array_to_string(v[i * 5 + 2 : i * 5 + 6], ' ')), chr(10)) AS text FROM f""".replace("WORDS", WORDS.format("text")))
def column_pages(spark: SparkSession, d: str) -> DataFrame:
    """Turns set as pages of a heading, a drop cap and two columns of four lines, and read again."""
    w = table(spark, d, "conversations").select("conv_id", "turn", T.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    p = w.select("conv_id", "turn", "w", F.explode(F.sequence(F.lit(0), F.ceil(F.size("w") / 41).cast("int") - 1)).alias("p"))
    at = lambda i: F.coalesce(F.get("w", F.col("p") * 41 + i), F.lit("end"))
    box = lambda text, x, y, wide, high: F.struct(text.alias("text"), *[F.lit(v).alias(n) for n, v in (("x", x), ("y", y), ("width", wide), ("height", high))])
    lines = [box(F.concat(F.lit("Heading "), at(0)), 0.1, 0.94, 0.8, 0.05), box(F.lit("Q"), 0.1, 0.91, 0.02, 0.02)]
    lines += [box(F.concat_ws(" ", *[at(1 + 5 * n + j) for j in range(5)]), 0.1 if n < 4 else 0.55, 0.88 - n % 4 / 20, 0.35, 0.02) for n in range(8)]
    boxes = p.select(F.concat_ws("-", "conv_id", "turn", "p").alias("page_key"), F.lit(0.9).alias("confidence"), F.explode(F.array(*lines)).alias("b")).select("page_key", "confidence", "b.*")
    return layout.reading_order(boxes.orderBy(F.xxhash64("text")), "bottom")


@query(f"WITH {MAT} SELECT min(id) AS id FROM m WHERE NOT gone AND id % 3 = 0 AND id <> 3")
def next_unfiled(spark: SparkSession, d: str) -> DataFrame:
    return listing.next_unfiled(materials(spark, d), filings(spark, d), 3).select("id")


@query("SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL")
def known_languages(spark: SparkSession, d: str) -> DataFrame:
    return listing.distinct_keys(table(spark, d, "documents"), "lang")


# ---- streams -----------------------------------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT max(epoch_us(ts)) AS top FROM events) SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, user_id AS actor, event_type AS action, count(*) AS n FROM events, t
WHERE epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) + 3600000000 <= top - 3600000000 GROUP BY 1, 2, 3""")
def streamed_activity(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of one Parquet folder: the windows that are complete when it has been read."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch(spark)
    e.write.parquet(f"{path}/in")
    incremental.activity_stream(spark, f"{path}/in", e.schema, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.schema("window_start timestamp, actor long, action string, n long").parquet(f"{path}/out").select(F.unix_micros("window_start").alias("start_us"), "actor", "action", "n")


@query("""WITH RECURSIVE w AS (SELECT (max(epoch_us(ts)) // 1000 - 600000) * 1000 AS passed FROM events), e AS MATERIALIZED (SELECT user_id::VARCHAR AS key, epoch_us(ts) AS at_us, event_type IN ('view', 'click') AS begins, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type IN ('view', 'click')) AS i FROM events, w WHERE epoch_us(ts) <= passed),
r(key, i, held, started, ended, outcome) AS (SELECT key, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR FROM e WHERE i = 1 UNION ALL
SELECT e.key, e.i, CASE WHEN begins AND (held IS NULL OR at_us - held > 3600000000) THEN at_us WHEN NOT begins OR at_us - held > 3600000000 THEN NULL ELSE held END, CASE WHEN held IS NOT NULL AND (at_us - held > 3600000000 OR NOT begins) THEN held END,
 CASE WHEN held IS NULL THEN NULL WHEN at_us - held > 3600000000 THEN held + 3600000000 WHEN NOT begins THEN at_us END, CASE WHEN held IS NULL THEN NULL WHEN at_us - held > 3600000000 THEN 'stuck' WHEN NOT begins THEN 'done' END FROM r JOIN e ON e.key = r.key AND e.i = r.i + 1),
last AS (SELECT key, max_by(held, i) AS held, arg_max(held IS NULL, i) AS shut FROM r GROUP BY key)
SELECT key, started AS started_us, ended AS ended_us, outcome FROM r WHERE outcome IS NOT NULL UNION ALL SELECT key, held, held + 3600000000, 'stuck' FROM last, w WHERE NOT shut AND held + 3600000000 < passed""")
def streamed_work(spark: SparkSession, d: str) -> DataFrame:
    """Views and clicks of a user begin work, anything else ends it: spans by a stateful stream over files that come one after another."""
    e, path = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), scratch(spark)
    day = F.dayofmonth("ts")
    for part in (day < 10, (day >= 10) & (day < 20), day >= 20):
        e.where(part).coalesce(1).write.mode("append").parquet(f"{path}/in")
    incremental.in_flight_stream(spark, f"{path}/in", e.schema, f"{path}/out", f"{path}/state", ("view", "click"), key="user_id", status="event_type").awaitTermination()
    return spark.read.schema(incremental.SPANS).parquet(f"{path}/out").select("key", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "outcome")


@query(r"""WITH i AS (SELECT item_id, text, row_number() OVER (PARTITION BY text ORDER BY item_id) AS n FROM benchmark), d AS (SELECT DISTINCT split_part(text, chr(10), 1) AS t, doc_id FROM documents WHERE doc_id % 50 = 0),
r AS (SELECT item_id FROM i WHERE n = 1) SELECT 'files' AS what, count(*) AS n FROM benchmark UNION ALL SELECT 'accepted', count(*) FROM r UNION ALL SELECT 'with chunks', count(*) FROM r JOIN benchmark USING (item_id) WHERE length(text) + 1 >= 200
UNION ALL SELECT 'same title', count(*) FROM r JOIN documents ON doc_id = item_id * 7 WHERE split_part(text, chr(10), 1) IS NOT NULL""")
def streamed_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts as files that come in: accepted or refused, cut and embedded, and compared with the documents. Each takes the title of a document."""
    path = scratch(spark)
    b, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    b.select("item_id", F.concat(F.lit("%PDF-"), "text").alias("value")).repartition("item_id").write.partitionBy("item_id").text(f"{path}/in")
    item = lambda p: F.regexp_extract(p, "item_id=([0-9]+)", 1)
    there = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("Unlike "), F.col("doc_id").cast("string"), F.lit(" x"), F.col("doc_id").cast("string")).alias("title"), F.concat(F.lit("d-"), F.col("doc_id").cast("string")).alias("slug"), F.sha2("text", 256).alias("sha256"), F.lit(None).cast("timestamp").alias("archived_at"))
    texts = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    named = lambda p: F.concat(F.lit("Unlike "), (item(p).cast("long") * 7).cast("string"), F.lit(" x"), (item(p).cast("long") * 7).cast("string"))
    handle = incremental.enrich(lambda: (there, texts), f"{path}/out", F.lit("2026-01-01").cast("timestamp"), lambda c: F.expr("substring(cast(content as string), 6)"), named)
    incremental.ingest_stream(spark, f"{path}/in/*", f"{path}/state", handle, ".txt").awaitTermination()
    made = {n: spark.read.parquet(f"{path}/out/{n}") for n in ("materials", "chunks", "findings")}
    count = lambda df, what: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    ours = made["materials"].where("status = 'review'").select("id")
    twins = made["findings"].where("title = 1 and (a like 'd%' and length(a) < 32) <> (b like 'd%' and length(b) < 32)")
    return count(made["materials"], "files").unionByName(count(ours, "accepted")).unionByName(count(made["chunks"].where("kind = 'document'"), "with chunks")).unionByName(count(twins, "same title"))


# ---- search, list by list ------------------------------------------------------------------------------------------------------------------

ASKED = f"""q AS (SELECT DISTINCT item_id AS query_id, unnest({WORDS.format("text")}[1:3]) AS term FROM benchmark), qq AS (SELECT * FROM q WHERE term NOT IN ({STOPPED})), need AS (SELECT query_id, count(*) AS k FROM qq GROUP BY 1)"""


@query(f"""WITH {ASKED}, fl AS (SELECT doc_id, 1.0::DOUBLE AS w, unnest({WORDS.format(TITLE)}) AS term FROM documents UNION ALL SELECT doc_id, 0.4, unnest({WORDS.format("source")}) FROM documents UNION ALL SELECT doc_id, 0.2, unnest({WORDS.format("lang")}) FROM documents),
p AS (SELECT doc_id, term, sum(w) AS tf FROM fl WHERE term NOT IN ({STOPPED}) GROUP BY 1, 2), m AS (SELECT query_id, doc_id, count(*) AS k, sum(tf / (tf + 1)) AS r FROM qq JOIN p USING (term) GROUP BY 1, 2)
SELECT m.query_id, m.doc_id AS material_id, round(r, 6) AS rank FROM m JOIN need ON need.query_id = m.query_id AND need.k = m.k""")
def meta_matches(spark: SparkSession, d: str) -> DataFrame:
    m = materials(spark, d).select("id", "title", "author", "summary")
    return search.meta_hits(asked(spark, d), m, stem=False).select("query_id", "material_id", F.round("rank", 6).alias("rank"))


@query(rf"""WITH {ASKED}, k AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, w, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 350 THEN 1 ELSE ceil((len(w) - 350) / 310.0)::INT + 1 END AS k FROM k),
c AS (SELECT doc_id, i, array_to_string(w[i*310+1 : i*310+350], ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, k)) AS i FROM n)), e AS (SELECT doc_id, i, unnest({WORDS.format("text")}) AS term FROM c), ee AS (SELECT * FROM e WHERE term NOT IN ({STOPPED})),
p AS (SELECT doc_id, i, term, count(*) AS tf FROM ee GROUP BY 1, 2, 3), l AS (SELECT doc_id, i, count(*) AS dl FROM ee GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS mean FROM l),
m AS (SELECT query_id, doc_id, i FROM qq JOIN p USING (term) GROUP BY 1, 2, 3 HAVING count(*) = (SELECT k FROM need WHERE need.query_id = qq.query_id)),
s AS (SELECT m.query_id, m.doc_id, m.i, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))) AS r FROM m JOIN qq USING (query_id) JOIN p ON p.doc_id = m.doc_id AND p.i = m.i AND p.term = qq.term JOIN df ON df.term = p.term JOIN l ON l.doc_id = m.doc_id AND l.i = m.i, st GROUP BY 1, 2, 3)
SELECT query_id, doc_id AS material_id, round(max(r), 6) AS rank, count(*) > 0 AS met FROM s GROUP BY 1, 2""")
def chunk_matches(spark: SparkSession, d: str) -> DataFrame:
    found = search.chunk_hits(asked(spark, d), chunked(table(spark, d, "documents")), stem=False)
    return found.select("query_id", "material_id", F.round("rank", 6).alias("rank"), F.col("page").isNotNull().alias("met"))


@query(f"WITH {MAT}, t AS (SELECT DISTINCT upper(id) AS name, id FROM tp WHERE id IS NOT NULL) SELECT x.n AS query_id, f.id AS material_id FROM (SELECT row_number() OVER (ORDER BY id) AS n, id FROM t) x JOIN f ON f.topic = x.id")
def topic_matches(spark: SparkSession, d: str) -> DataFrame:
    t = topic_table(spark, d).where("id is not null")
    q = t.select("id").distinct().select(F.row_number().over(W.orderBy("id")).cast("long").alias("query_id"), F.array("id").alias("must"))  # topics are few
    return search.topic_hits(q, t, filings(spark, d), stem=False).select("query_id", "material_id")


@query("""WITH h AS (SELECT doc_id % 4 AS q, 'meta' AS s, doc_id AS m, n_chars::DOUBLE AS r, NULL::BIGINT AS page FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id % 4, 'title', doc_id, doc_id % 7, NULL FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id % 4, 'chunk', doc_id, (doc_id * 7) % 11, doc_id % 5 FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY q, s ORDER BY r DESC, m) AS pos FROM h), f AS (SELECT q, m, sum(CASE s WHEN 'meta' THEN 1.6::DOUBLE WHEN 'title' THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END / (60 + pos)) AS score, max(page) AS page, string_agg(DISTINCT s, '|' ORDER BY s) AS sources FROM p GROUP BY q, m),
z AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, m) AS pos FROM f) SELECT q AS query_id, m AS material_id, round(score, 9) AS score, page, sources FROM z WHERE pos <= 500""")
def fused_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Three lists over documents, fused by reciprocal ranks."""
    docs, n = table(spark, d, "documents"), F.col("doc_id")
    one = lambda df, rank, page: df.select((n % 4).alias("query_id"), n.alias("material_id"), rank.cast("double").alias("rank"), page.cast("int").alias("page"))
    lists = {"meta": one(docs.where("doc_id % 2 = 0"), F.col("n_chars"), F.lit(None)), "title": one(docs.where("doc_id % 3 = 0"), n % 7, F.lit(None)), "chunk": one(docs, (n * 7) % 11, n % 5)}
    return search.rrf(listing.fuse_lists(lists)).select("query_id", "material_id", F.round("score", 9).alias("score"), "page", F.array_join("sources", "|").alias("sources"))


@query(r"""WITH q AS (SELECT item_id AS query_id, lower(trim(regexp_replace(substring(text, 1, 24), '\s+', ' ', 'g'))) AS term FROM benchmark WHERE length(trim(substring(text, 1, 24))) > 0), p AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS body FROM documents),
h AS (SELECT item_id AS query_id, item_id * 3 AS m, 0.01::DOUBLE AS score FROM benchmark), s AS (SELECT query_id, doc_id AS m, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS pos FROM q JOIN p ON contains(body, term)),
b AS (SELECT query_id, m, score, 'meta' AS s FROM h UNION ALL SELECT query_id, m, 0.25::DOUBLE / (60 + pos), 'substring' FROM s WHERE pos <= 300) SELECT query_id, m AS material_id, round(sum(score), 9) AS score, string_agg(DISTINCT s, '|' ORDER BY s) AS sources FROM b GROUP BY 1, 2""")
def fallback_hits(spark: SparkSession, d: str) -> DataFrame:
    """Queries with a single hit each, and the documents that merely hold their words."""
    b = table(spark, d, "benchmark")
    q = search.clean_queries(b.select(F.col("item_id").alias("query_id"), F.substring("text", 1, 24).alias("raw")))
    hits = b.select(F.col("item_id").alias("query_id"), (F.col("item_id") * 3).alias("material_id"), F.lit(0.01).alias("score"), F.lit(None).cast("int").alias("page"), F.array(F.lit("meta")).alias("sources"))
    pages_ = table(spark, d, "documents").select(F.col("doc_id").alias("material_id"), F.lit(1).alias("page_number"), "text")
    return search.substring_fallback(q, hits, pages_).select("query_id", "material_id", F.round("score", 9).alias("score"), F.array_join("sources", "|").alias("sources"))
