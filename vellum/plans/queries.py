"""Registered queries of the collection operators, bound to the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions import vectors as V
from vellum.operators import ann, duplicates, history, layout, listing, postings, search, topics, vectors
from vellum.sources.scratch import new_path, spread
from vellum.streaming import incremental

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def first_line(c="text"):
    return F.split_part(F.col(c), F.lit("\n"), F.lit(1))


# ---- SQL pieces ------------------------------------------------------------------------------------------------------------

WORDS = r"list_filter(string_split_regex(regexp_replace(strip_accents(lower({0})), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: x <> '')"
SHINGLED = f"""kw AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM kw),
g3 AS (SELECT doc_id, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS g FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
e0 AS (SELECT DISTINCT doc_id, g FROM g3 WHERE g IS NOT NULL UNION SELECT doc_id, array_to_string(w, ' ') FROM kw WHERE len(w) BETWEEN 1 AND 2),
e AS (SELECT doc_id, hash(g) AS g, count(*) OVER (PARTITION BY doc_id) AS n FROM e0)"""
SHARED = f"""{SHINGLED},
p AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS k FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL)"""
SHARED = SHARED.replace("GROUP BY ALL", "GROUP BY x.doc_id, y.doc_id")
TITLE = "split_part(text, chr(10), 1)"
NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({0})),
 '\.(?:pdf|docx?|jpe?g|png)$', '', 'i'), '^\s*copy\s+of\s+', '', 'i'), '(?:[-–—\s]*\(?\bcopy\b\s*\d*\)?|\s*\(\d+\))\s*$', '', 'i'), '^\d{{4}}[-_]\d{{2}}[-_](?:[a-z]+[-_])?', '', 'i'),
 '[''`]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"""
NOISE = "('the','a','an','of','for','and','to','in','on','is')"
TITLES = f"""t AS (SELECT doc_id, {NORM.format(TITLE)} AS n FROM documents),
tk AS (SELECT doc_id, n, list_filter(string_split(n, ' '), lambda x: x <> '') AS every FROM t),
tt AS (SELECT doc_id, n, list_distinct(CASE WHEN len(list_filter(every, lambda x: x NOT IN {NOISE})) > 0 THEN list_filter(every, lambda x: x NOT IN {NOISE}) ELSE every END) AS k,
 trim(regexp_replace(n, '(?:\\b(?:vol(?:ume)?|part|no)\\.?\\s*)?(\\d{{1,3}})\\s*$', '', 'i')) AS stem, regexp_extract(n, '(\\d{{1,3}})\\s*$', 1) AS num FROM tk),
tp AS (SELECT x.doc_id AS a, y.doc_id AS b, CASE WHEN x.n = '' AND y.n = '' THEN 1.0 WHEN x.n = '' OR y.n = '' THEN 0.0 WHEN x.n = y.n THEN 1.0
  ELSE len(list_intersect(x.k, y.k))::DOUBLE / (len(x.k) + len(y.k) - len(list_intersect(x.k, y.k))) END AS overlap,
  x.n <> '' AND y.n <> '' AND x.n <> y.n AND x.stem = y.stem AND x.num <> y.num AS sequel FROM tt x JOIN tt y ON x.doc_id < y.doc_id AND (len(list_intersect(x.k, y.k)) > 0 OR (x.n = '' AND y.n = '')))"""

# ---- duplicates ------------------------------------------------------------------------------------------------------------


@query(f"WITH {SHARED} SELECT a, b, round(k::DOUBLE / (na + nb - k), 6) AS jaccard, round(k::DOUBLE / least(na, nb), 6) AS containment FROM p WHERE k::DOUBLE / (na + nb - k) >= 0.7")
def shingle_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = duplicates.corpus_near_duplicates(table(spark, d, "documents"))
    return found.select("a", "b", F.round("jaccard", 6).alias("jaccard"), F.round("containment", 6).alias("containment"))


@query(f"WITH {SHARED} SELECT a, b, round(k::DOUBLE / least(na, nb), 6) AS containment FROM p WHERE k::DOUBLE / least(na, nb) >= 0.9")
def containment_pairs(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.containment_pairs(table(spark, d, "documents")).withColumn("containment", F.round("containment", 6))


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", T.fingerprint(F.col("text"))["sha256"].alias("sha256"))
    return docs.groupBy("sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(f"WITH t AS (SELECT {TITLE} AS x, {NORM.format(TITLE)} AS y FROM documents) SELECT x AS title, count(*) AS n, 'exact' AS kind FROM t GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT y, count(*), 'normalised' FROM t GROUP BY 1 HAVING count(*) > 1")
def title_groups(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.title_groups(table(spark, d, "documents").select(first_line().alias("title")))


@query(f"WITH {TITLES} SELECT a, b, round(overlap, 6) AS overlap, round(CASE WHEN sequel THEN 0.0 ELSE overlap END, 6) AS similarity FROM tp WHERE overlap >= 0.35")
def title_pairs(spark: SparkSession, d: str) -> DataFrame:
    met = duplicates.title_pairs(table(spark, d, "documents").select(F.col("doc_id").alias("id"), first_line().alias("title")))
    return met.select("a", "b", F.round("overlap", 6).alias("overlap"), F.round("title", 6).alias("similarity"))


@query(f"""WITH {TITLES}, k AS (SELECT d.doc_id AS id, sha256(d.text) AS sha256, md5(lower(d.text)) AS md5, t.n AS title FROM documents d JOIN t ON t.doc_id = d.doc_id), u AS (SELECT 'sha256' AS kind, id, sha256 AS v FROM k UNION ALL SELECT 'md5', id, md5 FROM k UNION ALL SELECT 'title', id, title FROM k),
c AS (SELECT kind, id, min(id) OVER (PARTITION BY kind, v) AS rep, count(*) OVER (PARTITION BY kind, v) AS n FROM u WHERE v IS NOT NULL) SELECT kind, id, rep, n FROM c WHERE n > 1""")
def duplicate_classes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), first_line().alias("title"), F.sha2("text", 256).alias("sha256"), F.md5(F.lower("text")).alias("md5"))
    return duplicates.duplicate_classes(docs)


@query(f"""WITH {SHINGLED}, s AS (SELECT doc_id, list(g ORDER BY g) AS s FROM e GROUP BY doc_id) SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY s) AS rep, count(*) OVER (PARTITION BY s) AS n FROM s""")
def shingle_classes(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.near_duplicate_classes(table(spark, d, "documents")).members


def _scan(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    cards = docs.select(F.col("doc_id").alias("id"), first_line().alias("title"), F.sha2("text", 256).alias("sha256"), F.lit(None).cast("string").alias("md5"), F.lit(None).cast("int").alias("page_count"))
    return duplicates.scan(cards, docs.select(F.col("doc_id").alias("id"), "text"))


FINDINGS = f"""{TITLES}, {SHARED},
h AS (SELECT doc_id, sha256(text) AS sha, length(text) > 200 AS long FROM documents),
cand AS (SELECT a, b, overlap, sequel FROM tp WHERE overlap >= 0.35 UNION SELECT x.doc_id, y.doc_id, coalesce(tp.overlap, 0), coalesce(tp.sequel, false) FROM h x JOIN h y ON x.sha = y.sha AND x.doc_id < y.doc_id LEFT JOIN tp ON tp.a = x.doc_id AND tp.b = y.doc_id),
sig AS (SELECT cand.a, cand.b, CASE WHEN sequel THEN 0.0 ELSE overlap END AS t, hx.sha = hy.sha AS same,
  CASE WHEN hx.long AND hy.long THEN coalesce(k::DOUBLE / (na + nb - k), 0) ELSE 0 END AS s, CASE WHEN hx.long AND hy.long THEN coalesce(k::DOUBLE / least(na, nb), 0) ELSE 0 END AS c
  FROM cand JOIN h hx ON hx.doc_id = cand.a JOIN h hy ON hy.doc_id = cand.b LEFT JOIN p ON p.a = cand.a AND p.b = cand.b),
sc AS (SELECT *, greatest(CASE WHEN s >= .7 THEN s ELSE s * .6 END, CASE WHEN t >= .55 THEN t * .8 ELSE t * .35 END) + 0 AS base FROM sig),
s2 AS (SELECT *, CASE WHEN t >= .55 AND s >= .7 THEN least(1.0, base + .1) ELSE base END AS b2 FROM sc),
v AS (SELECT *, CASE WHEN same THEN 1.0 WHEN c >= .9 THEN greatest(b2, .55) ELSE b2 END AS f FROM s2)"""


@query(f"WITH {FINDINGS} SELECT a, b, round(f, 3) AS score, CASE WHEN same THEN 'identical' WHEN f >= .85 THEN 'likely' ELSE 'possible' END AS level, round(t, 3) AS title FROM v WHERE f >= .5")
def duplicate_findings(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d).select("a", "b", "score", "level", "title")


FIVE = f"""{TITLES}, {SHARED}, h AS (SELECT doc_id, sha256(text) AS sha, md5(lower(text)) AS m5, doc_id % 7 AS pc, length(text) > 200 AS long FROM documents),
co AS (SELECT x.vec_id AS a, y.vec_id AS b, least(1.0::DOUBLE, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) + 0.5) AS e FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.4),
cand AS (SELECT a, b FROM tp WHERE overlap >= 0.35 UNION SELECT x.doc_id, y.doc_id FROM h x JOIN h y ON x.doc_id < y.doc_id AND x.sha = y.sha UNION SELECT x.doc_id, y.doc_id FROM h x JOIN h y ON x.doc_id < y.doc_id AND x.m5 = y.m5 UNION SELECT a, b FROM co WHERE e >= 0.93),
sig AS (SELECT cand.a, cand.b, CASE WHEN sequel THEN 0.0 ELSE coalesce(overlap, 0.0) END AS t, hx.sha = hy.sha AS same, hx.m5 = hy.m5 AS same5, hx.pc = hy.pc AS pages, coalesce(e, 0) AS e,
  CASE WHEN (coalesce(overlap, 0) >= 0.35 OR hx.sha = hy.sha) AND hx.long AND hy.long THEN coalesce(k::DOUBLE / (na + nb - k), 0) ELSE 0 END AS s, CASE WHEN (coalesce(overlap, 0) >= 0.35 OR hx.sha = hy.sha) AND hx.long AND hy.long THEN coalesce(k::DOUBLE / least(na, nb), 0) ELSE 0 END AS c
  FROM cand JOIN h hx ON hx.doc_id = cand.a JOIN h hy ON hy.doc_id = cand.b LEFT JOIN tp ON tp.a = cand.a AND tp.b = cand.b LEFT JOIN p ON p.a = cand.a AND p.b = cand.b LEFT JOIN co ON co.a = cand.a AND co.b = cand.b),
f1 AS (SELECT *, greatest(CASE WHEN s >= .7 THEN s ELSE s * .6 END, CASE WHEN e >= .93 THEN e * .95 ELSE e * .5 END, CASE WHEN t >= .55 THEN t * .8 ELSE t * .35 END)::DOUBLE AS f, (t >= .55)::INT + (s >= .7)::INT + (e >= .93)::INT AS passed FROM sig),
f2 AS (SELECT *, CASE WHEN passed >= 2 THEN least(1.0, f + .1) ELSE f END AS g FROM f1), f3 AS (SELECT *, CASE WHEN pages AND passed >= 1 THEN least(1.0, g + .03) ELSE g END AS i FROM f2),
v AS (SELECT *, CASE WHEN same OR same5 THEN 1.0 WHEN c >= .9 THEN greatest(i, .55) ELSE i END AS z FROM f3)"""


@query(f"WITH {FIVE} SELECT a, b, round(z, 3) AS score, CASE WHEN same OR same5 THEN 'identical' WHEN z >= .85 THEN 'likely' ELSE 'possible' END AS level, CASE WHEN e <> 0 THEN round(e, 3) END AS embedding, CASE WHEN c <> 0 THEN round(c, 3) END AS containment FROM v WHERE z >= .5")
def five_signals(spark: SparkSession, d: str) -> DataFrame:
    """The scan with titles, texts, cosines, checksums and page counts."""
    docs, e = table(spark, d, "documents"), table(spark, d, "embeddings")
    cards = docs.select(F.col("doc_id").alias("id"), first_line().alias("title"), F.sha2("text", 256).alias("sha256"), F.md5(F.lower("text")).alias("md5"), (F.col("doc_id") % 7).alias("page_count"))
    cosines = vectors.similar_pairs(e.select(F.col("vec_id").alias("id"), "embedding"), 0.4).withColumn("cosine", F.least(F.lit(1.0), F.col("cosine") + 0.5))
    return duplicates.scan(cards, docs.select(F.col("doc_id").alias("id"), "text"), cosines).select("a", "b", "score", "level", "embedding", "containment")


@query(f"""WITH RECURSIVE {SHARED}, pr AS (SELECT a, b FROM p WHERE k::DOUBLE / (na + nb - k) >= 0.7), ed AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr),
r(id, c) AS (SELECT a, a FROM ed UNION SELECT ed.b, r.c FROM r JOIN ed ON ed.a = r.id) SELECT id, min(c) AS cluster FROM r GROUP BY id""")
def duplicate_clusters(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.class_clusters(duplicates.near_duplicate_classes(table(spark, d, "documents")))


@query(f"""WITH {SHARED}, f AS (SELECT a, b, round(k::DOUBLE / (na + nb - k), 3) AS found FROM p WHERE k::DOUBLE / (na + nb - k) >= 0.7),
l AS (SELECT a, b, 0.5::DOUBLE AS score, CASE WHEN a % 3 = 0 THEN 'merged' ELSE 'pending' END AS status FROM f WHERE a % 2 = 0 UNION ALL SELECT doc_id, doc_id + 1, 0.5, 'pending' FROM documents WHERE doc_id % 100 = 7)
SELECT coalesce(l.a, f.a) AS a, coalesce(l.b, f.b) AS b, CASE WHEN status = 'merged' THEN score ELSE coalesce(found, score) END AS score, coalesce(status, 'pending') AS status,
 CASE WHEN status = 'merged' THEN 'kept' WHEN status IS NULL THEN 'raised' WHEN found IS NOT NULL THEN 'rescored' ELSE 'withdrawn' END AS action FROM l FULL JOIN f ON l.a = f.a AND l.b = f.b""")
def ledger_reconcile(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    found = duplicates.settle(duplicates.corpus_near_duplicates(docs).select("a", "b", F.round("jaccard", 3).alias("score")))
    old = found.where("a % 2 = 0").select("a", "b", F.lit(0.5).alias("score"), F.when(F.col("a") % 3 == 0, "merged").otherwise("pending").alias("status"))
    stale = docs.where("doc_id % 100 = 7").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"), F.lit(0.5).alias("score"), F.lit("pending").alias("status"))
    return duplicates.reconcile(old.unionByName(stale), found)


# ---- texts -------------------------------------------------------------------------------------------------------------------

QUALITY = r"""t AS (SELECT doc_id, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS t FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, t, string_split_regex(t, '\s+') AS k FROM t WHERE t <> ''),
q AS (SELECT doc_id, len(k) AS n, len(list_filter(k, lambda w: NOT regexp_matches(w, '(?i)[a-z0-9]') OR (regexp_full_match(w, '(?i)[a-z]+') AND length(w) > 2 AND NOT regexp_matches(w, '(?i)[aeiouy]')) OR (regexp_matches(w, '(?i)[a-z]') AND regexp_matches(w, '[0-9]') AND length(w) <= 6)))::DOUBLE / len(k) AS junk,
 len(list_filter(k, lambda w: regexp_full_match(w, '(?i)[a-z0-9]')))::DOUBLE / len(k) AS single, length(regexp_replace(t, '(?i)[^a-z]', '', 'g'))::DOUBLE / length(t) AS letters FROM k),
z AS (SELECT doc_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - least(0.6::DOUBLE, junk * 2) - least(0.3::DOUBLE, greatest(0.0::DOUBLE, single - 0.05::DOUBLE) * 1.5::DOUBLE) - least(0.3::DOUBLE, greatest(0.0::DOUBLE, 0.75::DOUBLE - letters)) - CASE WHEN n < 20 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END)) AS s FROM q)"""


@query(f"WITH {QUALITY} SELECT doc_id, round(s, 3) AS score, s >= 0.55::DOUBLE AS usable FROM z")
def quality_scores(spark: SparkSession, d: str) -> DataFrame:
    q = spread(table(spark, d, "documents").select("doc_id", "text")).where("text is not null").withColumn("q", T.score_text(F.col("text")))
    return q.where("trim(text) <> ''").select("doc_id", "q.score", "q.usable")


@query(f"WITH {QUALITY} SELECT quality, count(*) AS n, sum(CASE WHEN s >= 0.55::DOUBLE THEN 1 ELSE 0 END)::BIGINT AS usable FROM z JOIN labels USING (doc_id) GROUP BY 1")
def quality_vs_label(spark: SparkSession, d: str) -> DataFrame:
    q = spread(table(spark, d, "documents").select("doc_id", "text")).where("text is not null").select("doc_id", T.score_text(F.col("text"))["usable"].alias("u"))
    return q.join(table(spark, d, "labels"), "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.count_if("u").alias("usable"))


@query(r"""WITH k AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS w FROM documents), b AS (SELECT doc_id, w, regexp_replace(w, '^[^\w]+|[^\w]+$', '', 'g') AS x FROM k)
SELECT doc_id, count(*) AS words, sum(CASE WHEN x <> '' AND length(x) >= 3 AND regexp_matches(x, '(?i)[a-z]') AND x <> upper(x) AND NOT regexp_matches(x, '(?i)[aeiouy]') THEN 1 WHEN x = '' AND (w = repeat(w[1], length(w)) AND length(w) >= 3) THEN 1 ELSE 0 END)::BIGINT AS invented FROM b GROUP BY doc_id""")
def invented_tokens(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select("doc_id", F.explode(T.plain_words(F.col("text"))).alias("w"))
    return w.groupBy("doc_id").agg(F.count("*").alias("words"), F.count_if(T.looks_invented(F.col("w"))).alias("invented"))


@query()
def surviving_share(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("clean", T.strip_invented(F.col("text")))
    return docs.select("doc_id", F.round(T.surviving_share(F.col("text"), F.col("clean")), 6).alias("share"), F.sha2("clean", 256).alias("clean_sha256"))


@query(r"""WITH k AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents), n AS (SELECT doc_id, w, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 350 THEN 1 ELSE ceil((len(w) - 350) / 310.0)::INT + 1 END AS k FROM k),
c AS (SELECT doc_id, w, unnest(range(0, k)) AS i FROM n) SELECT doc_id, i::INT AS chunk, sha256(array_to_string(w[i*310+1 : i*310+350], ' ')) AS sha256 FROM c""")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    c = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(T.chunk_page(F.col("text"))).alias("chunk", "body"))
    return c.select("doc_id", "chunk", F.sha2("body", 256).alias("sha256"))


@query(r"SELECT doc_id, sha256(array_to_string(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')[1:1200], ' ')) AS sha256 FROM documents WHERE text IS NOT NULL")
def document_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(T.document_text(F.col("text")), 256).alias("sha256"))


@query(r"""WITH RECURSIVE k AS (SELECT conv_id, turn::INT AS page, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM conversations WHERE text IS NOT NULL),
n AS MATERIALIZED (SELECT *, len(w) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY page, w) AS place FROM k WHERE len(w) > 0),
r(conv_id, place, total, run) AS (SELECT conv_id, place, n, 0 FROM n WHERE place = 1 UNION ALL SELECT n.conv_id, n.place, CASE WHEN total >= 12 THEN n.n ELSE total + n.n END, CASE WHEN total >= 12 THEN run + 1 ELSE run END FROM r JOIN n ON n.conv_id = r.conv_id AND n.place = r.place + 1),
g AS (SELECT r.conv_id, run, flatten(list(w ORDER BY r.place)) AS w, list(page ORDER BY r.place) AS pages, max(total) AS total FROM r JOIN n ON n.conv_id = r.conv_id AND n.place = r.place GROUP BY 1, 2),
c AS (SELECT *, unnest(range(0, CASE WHEN len(w) <= 350 THEN 1 ELSE ceil((len(w) - 350) / 310.0)::INT + 1 END)) AS i, CASE WHEN total < 12 OR len(pages) = 1 OR pages[-2] = pages[-1] THEN pages[-1] END AS page_number FROM g)
SELECT conv_id AS material_id, page_number, (row_number() OVER (PARTITION BY conv_id ORDER BY run, i) - 1)::INT AS chunk, CASE WHEN page_number IS NULL THEN 'span' ELSE 'page' END AS kind, array_to_string(w[i*310+1 : i*310+350], ' ') AS text FROM c""")
def chunk_conversations(spark: SparkSession, d: str) -> DataFrame:
    return layout.chunk_material(table(spark, d, "conversations"), key="conv_id", order="turn")


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def conversation_text(spark: SparkSession, d: str) -> DataFrame:
    return listing.material_text(table(spark, d, "conversations"), "conv_id", "turn")


SLUG = rf"CASE WHEN {{0}} = '' THEN 'item' ELSE {{0}} END".format(r"regexp_replace(substring(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(" + TITLE + r")), '[''`]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '^-+|-+$', '', 'g')")


@query(f"SELECT doc_id, {SLUG} AS slug FROM documents WHERE text IS NOT NULL")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.slugify(first_line()).alias("slug"))


@query(rf"""WITH s AS (SELECT doc_id, {SLUG} AS b FROM documents WHERE text IS NOT NULL), t AS (SELECT DISTINCT b FROM s WHERE doc_id % 50 = 0), n AS (SELECT s.doc_id, s.b, row_number() OVER (PARTITION BY s.b ORDER BY s.doc_id) + CASE WHEN t.b IS NULL THEN 0 ELSE 1 END AS n FROM s LEFT JOIN t ON t.b = s.b)
SELECT doc_id, CASE WHEN n = 1 THEN b ELSE b || '-' || n END AS slug FROM n""")
def unique_slugs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    taken = docs.where("doc_id % 50 = 0").select(T.slugify(first_line()).alias("slug"))
    return layout.assign_slugs(docs.select(F.col("doc_id").alias("arrival"), first_line().alias("title")), taken).select(F.col("arrival").alias("doc_id"), "slug")


SHED = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({TITLE}), '\.(?:pdf|docx?|jpe?g|png)$', '', 'i'), '^\s*copy\s+of\s+', '', 'i'), '(?:[-–—\s]*\(?\bcopy\b\s*\d*\)?|\s*\(\d+\))\s*$', '', 'i'), '^\d{{4}}[-_]\d{{2}}[-_](?:[a-z]+[-_])?', '', 'i')"""
ABBREVIATED = ", ".join(f"'{x}'" for x in T.ABBREVIATIONS)


@query(rf"""WITH t AS (SELECT doc_id, {TITLE} AS t, trim(regexp_replace(regexp_replace({SHED}, '[-_]+', ' ', 'g'), '\s+', ' ', 'g')) AS bare FROM documents),
f AS (SELECT doc_id, t, bare, regexp_replace(substring(trim(regexp_replace(regexp_replace(strip_accents(t), '["''\\/\n\r\t<>:|?*]', '', 'g'), '\s+', ' ', 'g')), 1, 120), '[\s.]+$', '') AS f, NOT regexp_matches(t, '\p{{Ll}}') AS shouted FROM t)
SELECT doc_id, CASE WHEN bare = '' THEN trim(t) WHEN (NOT contains(t, ' ') AND regexp_matches(t, '[-_]')) OR (bare = upper(bare) AND regexp_matches(bare, '[A-Z]{{4,}}'))
 THEN array_to_string(list_transform(string_split(lower(bare), ' '), lambda w, i: CASE WHEN i > 1 AND w IN {NOISE} THEN w ELSE replace(upper(w[1]), 'ẞ', 'SS') || w[2:] END), ' ') ELSE bare END AS clean, CASE WHEN f = '' THEN 'material' ELSE f END || '.pdf' AS file_name,
 array_to_string(list_transform(string_split(trim(t), ' '), lambda w: CASE WHEN NOT regexp_matches(w, '\p{{L}}') OR regexp_matches(w, '\d') OR regexp_matches(w, '\p{{Ll}}\p{{Lu}}') THEN w WHEN upper(regexp_replace(w, '[^\p{{L}}]', '', 'g')) IN ({ABBREVIATED}) THEN upper(w)
  WHEN NOT shouted AND length(regexp_replace(w, '[^\p{{L}}]', '', 'g')) > 1 AND regexp_replace(w, '[^\p{{L}}]', '', 'g') = upper(regexp_replace(w, '[^\p{{L}}]', '', 'g')) THEN w
  ELSE regexp_extract(w, '^([^\p{{L}}]*)', 1) || replace(upper(regexp_extract(w, '^[^\p{{L}}]*(\p{{L}})', 1)), 'ẞ', 'SS') || lower(regexp_extract(w, '^[^\p{{L}}]*\p{{L}}(.*)$', 1)) END), ' ') AS cased FROM f""")
def titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.clean_title(first_line()).alias("clean"), T.title_case(first_line()).alias("cased"), T.download_name(first_line()).alias("file_name"))


HOSTS = (
    ("http://127.1/", False), ("http://192.168.1/", False), ("http://0177.0.0.1/", False), ("http://0x7f.0.0.1/", False), ("http://[::ffff:7f00:1]/", False), ("http://2130706433/", False), ("http://10.1.2.3:80/x", False), ("http://172.16.0.1/", False),
    ("http://172.32.0.1/", True), ("http://8.8.2056/", True), ("http://[fe80::1]/", False), ("http://[2001:db8::1]/", True), ("http://100.64.0.1/", False), ("http://169.254.169.254/", False), ("http://example.com/", True),
)


@query("SELECT p.page_id, h.url, h.ok FROM pages p, (VALUES " + ", ".join(f"('{u}', {str(ok).lower()})" for u, ok in HOSTS) + ") AS h(url, ok) WHERE p.page_id % 5 = 0")
def vetted_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Addresses in the spellings that browsers take, beside every fifth page: what each is was worked out by hand."""
    p = table(spark, d, "pages").where("page_id % 5 = 0").select("page_id", F.explode(F.array(*(F.lit(u) for u, _ in HOSTS))).alias("url"))
    return p.select("page_id", "url", T.vet_url(F.col("url"))["ok"].alias("ok"))


@query(r"""SELECT page_id, regexp_matches(trim(url), '^https?://[^/?#@]+') AND NOT regexp_matches(url, '^https?://[^/?#]*@') AND NOT regexp_matches(url, '(?i)^https?://([^/?#]*\.)?(localhost|local|internal|intranet|lan|home|corp)([:/?#]|$)') AS ok FROM pages WHERE url IS NOT NULL""")
def url_vetting(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where("url is not null").select("page_id", T.vet_url(F.col("url"))["ok"].alias("ok"))


@query(r"""WITH u AS (SELECT page_id, url_decode(replace(regexp_extract(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '([^/]+)/*$', 1), '+', '%2B')) AS s FROM pages)
SELECT page_id, coalesce(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '\.pdf$', '', 'i'), '[-_]+', ' ', 'g'), '\s*\(\d+\)\s*$', ''), '\s+', ' ', 'g')), '') AS title FROM u""".replace("\\\\", "\\"))
def title_from_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.title_from_url(F.col("url")).alias("title"))


@query()
def rejoined_lines(spark: SparkSession, d: str) -> DataFrame:
    """Texts set in lines of at most 40 signs, words split by hyphens, and put together again."""
    narrow = F.regexp_replace(F.regexp_replace("text", r"(\w{40})", "$1 "), r"([^\n]{37}[a-z])([a-z])", "$1-\n$2")
    return table(spark, d, "documents").select("doc_id", F.sha2(T.dehyphenate(narrow), 256).alias("sha256"))


# ---- vectors and topics ----------------------------------------------------------------------------------------------------------

COS = "list_cosine_similarity(x.embedding, y.embedding)"
NEAR = f"n AS (SELECT x.vec_id AS q, y.vec_id AS i, y.label AS l, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS c, row_number() OVER (PARTITION BY x.vec_id ORDER BY list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) DESC, y.vec_id) AS pos FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id)"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    docs = e.select(F.col("vec_id").alias("id"), "embedding")
    filings = e.select(F.col("vec_id").alias("material_id"), F.col("label").cast("string").alias("category_id"), F.lit(0).alias("ordinal"))
    tops = e.select(F.col("label").cast("string").alias("id")).distinct().select("id", F.concat(F.lit("topic-"), "id").alias("slug"), F.concat(F.lit("Topic "), "id").alias("name"), F.lit(None).cast("string").alias("merged_into_id"))
    return docs, filings, tops


@query(f"WITH {NEAR} SELECT q AS query, i AS item, round(c, 6) AS cosine, pos::INT AS pos FROM n WHERE pos <= 5")
def knn_labels(spark: SparkSession, d: str) -> DataFrame:
    docs, _, _ = _vectors(spark, d)
    return vectors.top_k(docs, docs, 5).withColumn("cosine", F.round("cosine", 6))


@query(f"SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS cosine FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.4")
def similar_vectors(spark: SparkSession, d: str) -> DataFrame:
    docs, _, _ = _vectors(spark, d)
    return vectors.similar_pairs(docs, 0.4).withColumn("cosine", F.round("cosine", 6))


@query(f"""WITH t AS (SELECT doc_id, CASE WHEN lower({TITLE}) = '' THEN ' ' ELSE lower(coalesce({TITLE}, ' ')) END AS s FROM documents), g AS (SELECT doc_id, s, least(3, length(s)) AS k, unnest(range(1, greatest(length(s) - 2, 1) + 1)) AS i FROM t),
c AS (SELECT doc_id, k, list_transform(range(0, k), lambda j: unicode(substr(s, (i + j)::BIGINT, 1))::UBIGINT) AS c FROM g), h1 AS (SELECT doc_id, k, c, (c[1]::UHUGEINT * 1099511628211 % 18446744073709551616)::UBIGINT AS h FROM c),
h2 AS (SELECT doc_id, k, c, CASE WHEN k < 2 THEN h ELSE (xor(h, c[2])::UHUGEINT * 1099511628211 % 18446744073709551616)::UBIGINT END AS h FROM h1), h3 AS (SELECT doc_id, CASE WHEN k < 3 THEN h ELSE (xor(h, c[3])::UHUGEINT * 1099511628211 % 18446744073709551616)::UBIGINT END AS h FROM h2),
b AS (SELECT doc_id, ((xor(h, h >> 29)::UHUGEINT * 13787848793156543929 % 18446744073709551616)::UBIGINT >> 40) % 64 AS b FROM h3), n AS (SELECT doc_id, b, count(*) AS n FROM b GROUP BY 1, 2), l AS (SELECT doc_id, sqrt(sum(n * n)) AS l FROM n GROUP BY 1)
SELECT doc_id, string_agg(b || ':' || round(n / l * 1000000)::BIGINT, ',' ORDER BY b) AS vector FROM n JOIN l USING (doc_id) GROUP BY 1""")
def embedded_titles(spark: SparkSession, d: str) -> DataFrame:
    """The vectors themselves: entries of the embedded first lines that are not 0, in millionths."""
    e = vectors.embed(table(spark, d, "documents").select("doc_id", first_line().alias("title")), "title")
    some = F.filter(F.transform("embedding", lambda x, i: F.when(x != 0, F.concat(i.cast("string"), F.lit(":"), F.round(x * 1000000).cast("long").cast("string")))), lambda s: s.isNotNull())
    return e.select("doc_id", F.array_join(some, ",").alias("vector"))


@query(f"WITH {NEAR} SELECT count(*) AS neighbours, true AS recall_reached FROM n WHERE pos <= 5 AND q % 20 = 0")
def cell_recall(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector against all by an inverted file whose nearest cells alone are searched: how many of the true five nearest there are, and whether 0.9 of them are found."""
    docs, _, _ = _vectors(spark, d)
    asked = docs.where("id % 20 = 0")
    cells = ann.build_cells(docs)
    found = ann.nearest(asked, cells, 5, probes=-(-2 * len(cells.rows) // 3), exact=False).select("query", "item", F.lit(1).alias("hit"))
    true = vectors.top_k(asked, docs, 5).select("query", "item")
    return true.join(found, ["query", "item"], "left").agg(F.count("*").alias("neighbours"), (F.count("hit") >= 0.9 * F.count("*")).alias("recall_reached"))


@query(f"WITH {NEAR} SELECT q AS query, i AS item, round(c, 6) AS cosine, pos::INT AS pos FROM n WHERE pos <= 5 AND q % 20 = 0")
def cell_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector against all by an inverted file, exactly."""
    docs, _, _ = _vectors(spark, d)
    return ann.nearest(docs.where("id % 20 = 0"), ann.build_cells(docs), 5).withColumn("cosine", F.round("cosine", 6))


TWINS = """e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings UNION ALL SELECT vec_id + 10000000, list_transform(embedding, lambda x, i: x::DOUBLE + ((vec_id * 31 + i * i * 7) % 13 - 6) * 0.007 * (1 + vec_id % 3)) FROM embeddings),
p AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.v, y.v) AS c FROM e x JOIN e y ON x.id < y.id WHERE list_cosine_similarity(x.v, y.v) >= 0.93)"""


@query(f"WITH {TWINS} SELECT count(*) AS pairs, true AS all_reach, true AS recall_reached FROM p")
def lsh_recall(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings and a twin of each with known noise: how many pairs reach 0.93, whether all that hash tables find do, and whether they find 0.9 of them."""
    e = table(spark, d, "embeddings")
    noise = lambda x, i: x.cast("double") + (F.pmod(F.col("vec_id") * 31 + (i + 1) * (i + 1) * 7, F.lit(13)) - 6) * 0.007 * (1 + F.col("vec_id") % 3)
    both = e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).unionByName(e.select((F.col("vec_id") + 10000000).alias("id"), F.transform("embedding", noise).alias("embedding")))
    true, found = vectors.similar_pairs(both, 0.93).select("a", "b", F.lit(1).alias("true")), ann.lsh_pairs(both, 0.93).select("a", "b", "cosine")
    met = true.join(found, ["a", "b"], "full_outer")
    return met.agg(F.count("true").alias("pairs"), F.bool_and(F.coalesce(F.col("cosine") >= 0.93, F.lit(True))).alias("all_reach"), (F.count_if(F.col("true").isNotNull() & F.col("cosine").isNotNull()) >= 0.9 * F.count("true")).alias("recall_reached"))


@query("SELECT vec_id, abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) <= 1e-4 AS unit, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS own FROM embeddings")
def vector_checks(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", V.is_normalised(v).alias("unit"), F.round(V.cosine(V.assert_dimensions(v, 64), F.reverse(v).cast("array<double>")), 6).alias("own"))


VOTES = f"""{NEAR}, v AS (SELECT q, l, sum(c) AS w, count(*) AS votes FROM n WHERE pos <= 15 GROUP BY q, l), t AS (SELECT q, sum(w) AS total FROM v GROUP BY q),
b AS (SELECT v.*, row_number() OVER (PARTITION BY v.q ORDER BY w DESC, l::VARCHAR) AS r FROM v), s AS (SELECT b.q, b.l, w, votes, w / total AS share FROM b JOIN t ON b.q = t.q WHERE r <= 3 AND w / total >= 0.2)"""


@query(f"WITH {VOTES} SELECT q AS material_id, l::VARCHAR AS topic, round(w, 6) AS weight, votes, round(share, 6) AS share, share >= 0.4 AS strong FROM s")
def label_suggestions(spark: SparkSession, d: str) -> DataFrame:
    docs, filings, tops = _vectors(spark, d)
    out = topics.neighbour_vote(docs, docs, filings, tops, cells=ann.build_cells(docs))
    return out.select("material_id", "topic", F.round("weight", 6).alias("weight"), "votes", F.round("share", 6).alias("share"), "strong")


@query(f"WITH {VOTES}, h AS (SELECT e.vec_id, bool_or(s.l = e.label) AS hit, count(s.l) > 0 AS offered FROM embeddings e LEFT JOIN s ON s.q = e.vec_id GROUP BY e.vec_id) SELECT count(*) AS filed, count(*) FILTER (WHERE offered) AS offered, count(*) FILTER (WHERE hit) AS \"right\", round(avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share_right FROM h")
def suggestion_accuracy(spark: SparkSession, d: str) -> DataFrame:
    docs, filings, tops = _vectors(spark, d)
    return topics.evaluate_suggestions(topics.neighbour_vote(docs, docs, filings, tops), filings)


@query("""WITH f AS (SELECT doc_id AS material_id, source AS category_id, 0 AS o FROM documents UNION ALL SELECT doc_id, 'src0', 1 FROM documents WHERE source <> 'src0' AND doc_id % 4 = 0),
m AS (SELECT material_id, CASE WHEN category_id = 'src1' THEN 'src0' WHEN category_id = 'src2' THEN 'src3' ELSE category_id END AS category_id FROM f) SELECT category_id, count(DISTINCT material_id) AS n FROM m GROUP BY 1""")
def merge_topics(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    f = docs.select(F.col("doc_id").alias("material_id"), F.col("source").alias("category_id"), F.lit(0).alias("ordinal")).unionByName(docs.where("source <> 'src0' and doc_id % 4 = 0").select(F.col("doc_id").alias("material_id"), F.lit("src0").alias("category_id"), F.lit(1).alias("ordinal")))
    mapping = docs.where("source in ('src1', 'src2')").select(F.col("source").alias("source")).distinct().withColumn("target", F.when(F.col("source") == "src1", "src0").otherwise("src3"))
    return topics.merge_topic(f, mapping).groupBy("category_id").agg(F.count("*").alias("n"))


# ---- listings --------------------------------------------------------------------------------------------------------------------


def _materials(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents as materials: status by id, labelled documents as read pages and filings by source."""
    docs = table(spark, d, "documents")
    status = F.element_at(F.array(*map(F.lit, ("published", "review", "staged", "processing", "rejected"))), (F.col("doc_id") % 5 + 1).cast("int"))
    m = docs.select(F.col("doc_id").alias("id"), first_line().alias("title"), F.col("source").alias("author"), status.alias("status"), F.when(F.col("doc_id") % 11 == 0, F.lit("2026-01-01").cast("timestamp")).alias("archived_at"), F.timestamp_seconds(F.col("doc_id") * 3600).alias("created_at"))
    lab = table(spark, d, "labels")
    pages = lab.select(F.col("doc_id").alias("material_id"), F.lit(1).alias("page_number"), F.when(F.col("toxic") == 1, "none").otherwise("vision").alias("ocr_engine"), F.when(F.col("quality") == 1, 0.9).otherwise(0.3).alias("ocr_quality"), F.when(F.col("doc_id") % 2 == 0, "key").alias("r2_key_webp"), F.lit("text").alias("text"))
    filings = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("material_id"), F.col("source").alias("category_id"), F.lit(0).alias("ordinal"))
    return m, pages, filings


MAT = """m AS (SELECT doc_id AS id, source AS author, ['published','review','staged','processing','rejected'][doc_id % 5 + 1] AS status, doc_id % 11 = 0 AS gone FROM documents),
pg AS (SELECT doc_id AS id, toxic = 1 AS unread, quality <> 1 OR quality IS NULL AS poor FROM labels), f AS (SELECT doc_id AS id, source AS topic FROM documents WHERE doc_id % 3 <> 0)"""


def _topics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("source").alias("id")).distinct().select("id", F.col("id").alias("slug"), F.col("id").alias("name"), F.lit(None).cast("string").alias("merged_into_id"))


@query(f"""WITH {MAT}, x AS (SELECT m.*, EXISTS (SELECT 1 FROM pg WHERE pg.id = m.id AND unread) AS u, EXISTS (SELECT 1 FROM pg WHERE pg.id = m.id AND poor) AS p, EXISTS (SELECT 1 FROM f WHERE f.id = m.id) AS filed FROM m)
SELECT count(*) FILTER (WHERE NOT gone) AS "all", count(*) FILTER (WHERE NOT gone AND status IN ('staged','processing','rejected')) AS in_progress, count(*) FILTER (WHERE NOT gone AND NOT filed) AS uncategorised,
count(*) FILTER (WHERE NOT gone AND u) AS needs_ocr, count(*) FILTER (WHERE NOT gone AND p) AS poorly_read, count(*) FILTER (WHERE NOT gone AND status = 'review') AS review, count(*) FILTER (WHERE gone) AS archived FROM x""")
def backlog_counts(spark: SparkSession, d: str) -> DataFrame:
    return listing.backlog_counts(*_materials(spark, d))


@query(f"WITH {MAT} SELECT f.topic AS category_id, f.topic AS slug, f.topic AS name, count(*) AS n FROM f JOIN m ON m.id = f.id WHERE status = 'published' GROUP BY f.topic")
def topic_list(spark: SparkSession, d: str) -> DataFrame:
    m, _, f = _materials(spark, d)
    return listing.topic_list(_topics(spark, d), f, m)


@query(f"WITH {MAT} SELECT author, count(*) AS n FROM m WHERE status = 'published' AND author IS NOT NULL GROUP BY author")
def author_list(spark: SparkSession, d: str) -> DataFrame:
    return listing.author_list(_materials(spark, d)[0])


@query("SELECT n_nationkey AS id, n_name AS slug, n_name AS name, count(c_custkey) AS total, count(c_custkey) FILTER (WHERE c_acctbal > 0) AS published FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
def topic_admin(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    m = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, "published").otherwise("review").alias("status"))
    f = c.select(F.col("c_custkey").alias("material_id"), F.col("c_nationkey").alias("category_id"))
    return listing.topic_counts_all(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("slug"), F.col("n_name").alias("name")), f, m)


@query("SELECT c_custkey AS id, c_custkey AS slug, c_custkey AS name, count(o_orderkey) AS total, count(o_orderkey) FILTER (WHERE o_totalprice > 100000) AS published FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) <= 1")
def thin_topics(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    m = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_totalprice") > 100000, "published").otherwise("review").alias("status"))
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("slug"), F.col("c_custkey").alias("name"))
    return listing.thin_topics(listing.topic_counts_all(t, o.select(F.col("o_orderkey").alias("material_id"), F.col("o_custkey").alias("category_id")), m))


@query(f"WITH {MAT} SELECT (SELECT count(*) FROM m WHERE status = 'published') AS materials, (SELECT count(DISTINCT topic) FROM f JOIN m ON m.id = f.id WHERE status = 'published') AS topics")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    m, _, f = _materials(spark, d)
    return listing.corpus_stats(m, f)


@query("""WITH p AS (SELECT toxic = 1 AS unread, doc_id % 2 = 0 AS img, quality <> 1 OR quality IS NULL AS poor FROM labels), a AS (SELECT count(*) AS pages, count(*) FILTER (WHERE NOT unread OR unread IS NULL) AS preferred, 0::BIGINT AS text_layer, count(*) FILTER (WHERE unread AND img) AS queue, count(*) FILTER (WHERE unread AND NOT img) AS unreadable, count(*) FILTER (WHERE poor) AS poor FROM p)
SELECT *, round(100.0 * (pages - queue - unreadable) / pages)::BIGINT AS read_percent FROM a""")
def reading_status(spark: SparkSession, d: str) -> DataFrame:
    return listing.reading_status(_materials(spark, d)[1])


@query(f"WITH {MAT} SELECT id FROM m WHERE NOT gone AND NOT EXISTS (SELECT 1 FROM f WHERE f.id = m.id) ORDER BY id LIMIT 48")
def library_page(spark: SparkSession, d: str) -> DataFrame:
    """The oldest page of unfiled materials."""
    m, p, f = _materials(spark, d)
    return listing.paginate(listing.backlog_filter(m, p, f, "uncategorised"), ["created_at", "id"], 1, 48)[0].select("id")


# ---- history, incremental ---------------------------------------------------------------------------------------------------------


def _audit(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("actor_id"), F.col("event_type").alias("action"), (F.col("event_id") % 97).alias("entity_id"), F.col("ts").alias("created_at"), F.col("props").alias("after"))


@query("SELECT event_id AS id FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY ts DESC, event_id LIMIT 50")
def activity_page(spark: SparkSession, d: str) -> DataFrame:
    a = _audit(spark, d)
    first = a.agg(F.min("action").alias("action"))
    return listing.paginate(a.join(first, "action", "left_semi"), [F.desc("created_at"), "id"], 1, 50)[0].select("id")


@query("SELECT event_id % 97 AS entity_id, arg_max(event_id, (epoch_us(ts), event_id)) AS id FROM events GROUP BY 1")
def last_changes(spark: SparkSession, d: str) -> DataFrame:
    return listing.latest_per_key(_audit(spark, d), "entity_id").select("entity_id", "id")


@query("SELECT event_id % 97 AS entity_id, user_id AS actor_id, count(*) AS changes, epoch_us(max(ts)) AS last_us FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2")
def contributors(spark: SparkSession, d: str) -> DataFrame:
    a = _audit(spark, d)
    people = a.select(F.col("actor_id").alias("id"), F.col("actor_id").cast("string").alias("name")).distinct()
    return listing.contributors(a, people).select("entity_id", "actor_id", "changes", F.unix_micros(F.col("last_at").cast("timestamp")).alias("last_us"))


@query("SELECT event_type AS action, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def actions(spark: SparkSession, d: str) -> DataFrame:
    return listing.tally(_audit(spark, d).where("action is not null"), "action")


@query("WITH r AS (SELECT event_id % 97 AS entity_id, event_id AS id, row_number() OVER (PARTITION BY event_id % 97 ORDER BY ts DESC, event_id) AS n FROM events) SELECT entity_id, id FROM r WHERE n <= 20")
def entity_history(spark: SparkSession, d: str) -> DataFrame:
    a = _audit(spark, d)
    return history.history(a, a.select("entity_id").distinct()).select("entity_id", "id")


@query("SELECT event_id AS id, json_extract_string(props, '$.k') AS k FROM events")
def payload_field(spark: SparkSession, d: str) -> DataFrame:
    return _audit(spark, d).select("id", F.get_json_object("after", "$.k").alias("k"))


@query("SELECT c_custkey AS id, count(o_orderkey) FILTER (WHERE o_totalprice > 100000) AS open_sessions, max(o_orderkey) AS last_seen FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def account_rollup(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("updated_at"), F.col("o_totalprice").alias("expires_at"))
    return listing.account_rollup(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), s, F.lit(100000)).select("id", "open_sessions", "last_seen")


@query("""SELECT doc_id::VARCHAR AS file_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 9 = 0 THEN 'skipped' WHEN doc_id % 2 = 0 THEN 'flagged' ELSE 'skipped' END WHEN n_chars > 20000 THEN 'failed' ELSE 'imported' END AS result FROM documents""")
def listing_reconcile(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    sheet = docs.select(F.col("doc_id").cast("string").alias("file_id"), F.md5("text").alias("md5"), F.col("n_chars").alias("size"))
    known = docs.where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("drive_file_id"), F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, "old").otherwise(F.md5("text")).alias("drive_md5"), F.when(F.col("doc_id") % 9 == 0, F.lit("2026-01-01").cast("timestamp")).alias("archived_at"))
    return incremental.reconcile_listing(sheet, known, most_bytes=20000).select("file_id", "result")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, user_id AS actor, event_type AS action, count(*) AS n FROM events GROUP BY 1, 2, 3")
def activity_windows(spark: SparkSession, d: str) -> DataFrame:
    w = incremental.activity_windows(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return w.select(F.unix_micros("window_start").alias("start_us"), "actor", "action", "n")


# ---- search ----------------------------------------------------------------------------------------------------------------------

STOPPED = ", ".join(f"'{w}'" for w in search.STOP)


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """The first three words of each benchmark text as a query."""
    b = table(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.slice(T.words(F.col("text")), 1, 3).alias("must"), F.array_join(F.slice(T.words(F.col("text")), 1, 3), " ").alias("raw"))


@query(f"""WITH q AS (SELECT DISTINCT item_id AS query_id, unnest({WORDS.format("text")}[1:3]) AS term FROM benchmark), qq AS (SELECT * FROM q WHERE term NOT IN ({STOPPED})), need AS (SELECT query_id, count(*) AS k FROM qq GROUP BY 1),
p AS (SELECT doc_id, unnest({WORDS.format("text")}) AS term FROM documents), pp AS (SELECT DISTINCT doc_id, term FROM p), m AS (SELECT query_id, doc_id, count(*) AS k FROM qq JOIN pp USING (term) GROUP BY 1, 2)
SELECT m.query_id, m.doc_id FROM m JOIN need ON need.query_id = m.query_id AND need.k = m.k""")
def search_matches(spark: SparkSession, d: str) -> DataFrame:
    post = duplicates.settle(search.analyze(table(spark, d, "documents"), "doc_id", "text", stem=False))  # read by every use below
    return search.match_terms(_queries(spark, d), post, stem=False).select("query_id", F.col("id").alias("doc_id")).distinct()


@query(f"""WITH q AS (SELECT DISTINCT item_id AS query_id, unnest({WORDS.format("text")}[1:3]) AS term FROM benchmark), qq AS (SELECT * FROM q WHERE term NOT IN ({STOPPED})), need AS (SELECT query_id, count(*) AS k FROM qq GROUP BY 1),
e AS (SELECT doc_id, unnest({WORDS.format("text")}) AS term FROM documents), ee AS (SELECT * FROM e WHERE term NOT IN ({STOPPED})), p AS (SELECT doc_id, term, count(*) AS tf FROM ee GROUP BY 1, 2), l AS (SELECT doc_id, count(*) AS dl FROM ee GROUP BY 1), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS mean FROM l),
m AS (SELECT query_id, doc_id FROM qq JOIN p USING (term) GROUP BY 1, 2 HAVING count(*) = (SELECT k FROM need WHERE need.query_id = qq.query_id)),
s AS (SELECT m.query_id, m.doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))) AS r FROM m JOIN qq USING (query_id) JOIN p ON p.doc_id = m.doc_id AND p.term = qq.term JOIN df ON df.term = p.term JOIN l ON l.doc_id = m.doc_id, st GROUP BY 1, 2)
SELECT query_id, doc_id, round(r, 6) AS rank FROM s""")
def search_bm25(spark: SparkSession, d: str) -> DataFrame:
    docs, asked = table(spark, d, "documents"), _queries(spark, d)
    words = duplicates.settle(search.word_arrays(docs, "doc_id", "text"))  # parsed once
    each = words.select("id", "doc_len", F.posexplode("w").alias("at", "term")).join(search.query_terms(asked, stem=False).select("term").distinct(), "term", "left_semi")
    post = duplicates.settle(each.groupBy("id", "term", "doc_len").agg(F.count("*").alias("tf")))
    hits = search.bm25(search.match_terms(asked, post, stem=False), post, words.select("id", "doc_len"))
    return hits.select("query_id", F.col("id").alias("doc_id"), F.round("rank", 6).alias("rank"))


@query(SQL["search_bm25"])
def stored_search(spark: SparkSession, d: str) -> DataFrame:
    """The same ranks from stored postings: half of the documents first with other texts, then a tenth that is taken out again, then all that differs; what is there equals a table made at once."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    stored = postings.PostingsTable(spark, new_path(spark, "postings"), stem=False)
    stored.add(docs.where("id % 2 = 0").withColumn("text", F.when(F.col("id") % 4 == 0, F.reverse("text")).otherwise(F.col("text"))), 0)
    stored.add(docs.where("id % 10 = 0").withColumn("text", F.lit(None).cast("string")), 1)
    stored.add(docs.where("id % 2 = 1 or id % 4 = 0 or id % 10 = 0"), 2)
    stored.add(docs.where("id % 2 = 1 or id % 4 = 0 or id % 10 = 0"), 2)  # a batch that comes twice changes nothing
    return stored.search(_queries(spark, d)).select("query_id", F.col("id").alias("doc_id"), F.round("rank", 6).alias("rank"))


BOOLEAN = f"""q AS (SELECT item_id AS query_id, {WORDS.format("text")} AS w FROM benchmark), stop AS (SELECT unnest([{STOPPED}]) AS term),
must AS (SELECT query_id, w[1] AS term FROM q WHERE w[1] IS NOT NULL EXCEPT SELECT query_id, w[1] FROM q JOIN stop ON term = w[1]), few AS (SELECT query_id, unnest(w[2:4]) AS term FROM q), anyof AS (SELECT DISTINCT query_id, term FROM few WHERE term NOT IN ({STOPPED})),
ban AS (SELECT query_id, w[6] AS term FROM q WHERE w[6] NOT IN ({STOPPED})), p AS (SELECT DISTINCT doc_id, unnest({WORDS.format("text")}) AS term FROM documents)"""


@query(f"""WITH {BOOLEAN} SELECT q.query_id, d.doc_id FROM q CROSS JOIN (SELECT DISTINCT doc_id FROM p) d WHERE (EXISTS (FROM must m WHERE m.query_id = q.query_id) OR EXISTS (FROM anyof s WHERE s.query_id = q.query_id))
AND NOT EXISTS (FROM must m WHERE m.query_id = q.query_id AND NOT EXISTS (FROM p WHERE p.doc_id = d.doc_id AND p.term = m.term)) AND (NOT EXISTS (FROM anyof s WHERE s.query_id = q.query_id) OR EXISTS (FROM anyof s JOIN p ON p.term = s.term WHERE s.query_id = q.query_id AND p.doc_id = d.doc_id))
AND NOT EXISTS (FROM ban b JOIN p ON p.term = b.term WHERE b.query_id = q.query_id AND p.doc_id = d.doc_id)""")
def boolean_matches(spark: SparkSession, d: str) -> DataFrame:
    """Of each benchmark text the first word as a must, the next three as any, the sixth as a not."""
    w = T.words(F.col("text"))
    at = lambda a, n: F.slice(w, a, n)
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), at(1, 1).alias("must"), at(2, 3).alias("any"), at(6, 1).alias("not"))
    stored = postings.PostingsTable(spark, new_path(spark, "postings"), stem=False)
    stored.add(table(spark, d, "documents"), 0, "doc_id")
    return stored.search(asked).select("query_id", F.col("id").alias("doc_id"))


@query(f"""WITH q AS (SELECT item_id AS query_id, {WORDS.format("text")}[2:6] AS w FROM benchmark), t AS (SELECT query_id, unnest(w) AS term, unnest(range(len(w))) AS nth FROM q), tt AS (SELECT * FROM t WHERE term NOT IN ({STOPPED})), n AS (SELECT query_id, count(*) AS n FROM tt GROUP BY 1),
k AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents), p AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS place FROM k)
SELECT DISTINCT query_id, doc_id FROM (SELECT query_id, doc_id, place - nth AS s, count(*) AS c FROM tt JOIN p USING (term) GROUP BY 1, 2, 3) JOIN n USING (query_id) WHERE c = n""")
def phrase_matches(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold words two to six of a benchmark text in a row, stop words as gaps, from stored positions."""
    phrase = F.slice(T.words(F.col("text")), 2, 5)
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), phrase.alias("must"), F.array_join(phrase, " ").alias("phrase"))
    stored = postings.PostingsTable(spark, new_path(spark, "postings"), stem=False)
    stored.add(table(spark, d, "documents"), 0, "doc_id")
    return stored.search(asked).select("query_id", F.col("id").alias("doc_id"))


def _chunks(docs: DataFrame) -> DataFrame:
    """(chunk_id, material_id, page_number, text): a chunk is named by its document and its number there, however many there are."""
    parts = docs.select("doc_id", F.posexplode(T.chunk_page(F.col("text"))).alias("n", "text"))
    return parts.select(F.struct("doc_id", "n").alias("chunk_id"), F.col("doc_id").alias("material_id"), F.col("n").alias("page_number"), "text")


GRAMS = "flatten(list_transform({0}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))"


@query(f"""WITH b AS (SELECT item_id AS query_id, {WORDS.format("text")}[1:1 + item_id % 3] AS qw FROM benchmark), q AS (SELECT * FROM b WHERE len(qw) > 0), qt AS (SELECT DISTINCT query_id, unnest(qw) AS term FROM q), qq AS (SELECT * FROM qt WHERE term NOT IN ({STOPPED})), need AS (SELECT query_id, count(*) AS k FROM qq GROUP BY 1),
m AS (SELECT doc_id AS id, {WORDS.format(TITLE)}[1:4] AS tw, source AS author, lang AS summary FROM documents WHERE doc_id % 4 <> 0),
k AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), nn AS (SELECT doc_id, w, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 350 THEN 1 ELSE ceil((len(w) - 350) / 310.0)::INT + 1 END AS k FROM k),
c AS (SELECT doc_id, i, array_to_string(w[i*310+1 : i*310+350], ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, k)) AS i FROM nn)), e AS (SELECT doc_id, i, unnest({WORDS.format("text")}) AS term FROM c), ee AS (SELECT * FROM e WHERE term NOT IN ({STOPPED})),
p AS (SELECT doc_id, i, term, count(*) AS tf FROM ee GROUP BY 1, 2, 3), l AS (SELECT doc_id, i, count(*) AS dl FROM ee GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS mean FROM l),
cm AS (SELECT query_id, doc_id, i FROM qq JOIN p USING (term) GROUP BY 1, 2, 3 HAVING count(*) = (SELECT k FROM need WHERE need.query_id = qq.query_id)),
cs AS (SELECT cm.query_id, cm.doc_id, cm.i, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 9) AS r FROM cm JOIN qq USING (query_id) JOIN p ON p.doc_id = cm.doc_id AND p.i = cm.i AND p.term = qq.term JOIN df ON df.term = p.term JOIN l ON l.doc_id = cm.doc_id AND l.i = cm.i, st GROUP BY 1, 2, 3),
cb AS (SELECT query_id, doc_id, r, i, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY r DESC, i) AS o FROM cs), chunk AS (SELECT 'chunk' AS s, query_id, doc_id AS id, r, i AS page FROM cb WHERE o = 1),
fl AS (SELECT id, 1.0::DOUBLE AS w, unnest(tw) AS term FROM m UNION ALL SELECT id, 0.4, unnest({WORDS.format("author")}) FROM m UNION ALL SELECT id, 0.2, unnest({WORDS.format("summary")}) FROM m), fp AS (SELECT id, term, sum(w) AS tf FROM fl WHERE term NOT IN ({STOPPED}) GROUP BY 1, 2),
fm AS (SELECT query_id, id, count(*) AS k, sum(tf / (tf + 1)) AS r FROM qq JOIN fp USING (term) GROUP BY 1, 2), meta AS (SELECT 'meta' AS s, fm.query_id, id, round(r, 9) AS r, NULL::BIGINT AS page FROM fm JOIN need ON need.query_id = fm.query_id AND need.k = fm.k),
tg AS (SELECT id, {GRAMS.format("tw")} AS g FROM m), qg AS (SELECT query_id, list_distinct({GRAMS.format("qw")}) AS g FROM q), tc AS (SELECT query_id, id, qg.g AS a, tg.g AS b FROM qg JOIN tg ON len(list_intersect(qg.g, list_distinct(tg.g))) > 0.42 * len(qg.g)),
tx AS (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM tc), ty AS (SELECT *, unnest(range(i, len(b) + 1)) AS j FROM tx), tz AS (SELECT query_id, id, a, b, list_distinct(b[i:j]) AS e FROM ty),
ts AS (SELECT query_id, id, any_value(a) AS a, any_value(list_distinct(b)) AS b, max(len(list_intersect(a, e))::DOUBLE / (len(a) + len(e) - len(list_intersect(a, e)))) AS best FROM tz GROUP BY 1, 2),
title AS (SELECT 'title' AS s, query_id, id, round(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))), 9) AS r, NULL::BIGINT AS page FROM ts WHERE best > 0.42),
td AS (SELECT query_id FROM qq GROUP BY 1 HAVING count(*) = 1), topic AS (SELECT 'topic' AS s, qq.query_id, d.doc_id AS id, 1.0::DOUBLE AS r, NULL::BIGINT AS page FROM td JOIN qq USING (query_id) JOIN (SELECT doc_id, {WORDS.format(TITLE)}[1] AS name FROM documents) d ON d.name = qq.term),
h AS (SELECT x.* FROM (FROM chunk UNION ALL FROM meta UNION ALL FROM title UNION ALL FROM topic) x JOIN m USING (id)), hr AS (SELECT *, row_number() OVER (PARTITION BY query_id, s ORDER BY r DESC, id) AS pos FROM h),
f AS (SELECT query_id, id, sum(CASE s WHEN 'meta' THEN 1.6::DOUBLE WHEN 'title' THEN 1.3::DOUBLE WHEN 'chunk' THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END / (60 + pos)) AS score, max(page) AS page, list(DISTINCT s) AS sources FROM hr GROUP BY 1, 2),
f1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM f) WHERE pos <= 500), few AS (SELECT query_id, array_to_string(qw, ' ') AS term FROM q WHERE query_id NOT IN (SELECT query_id FROM f1 GROUP BY 1 HAVING count(*) >= 15)),
body AS (SELECT doc_id AS id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS body FROM documents JOIN m ON m.id = doc_id), sub AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS pos FROM few JOIN body ON contains(body, term)),
both_ AS (SELECT query_id, id, score, page, sources FROM f1 UNION ALL SELECT query_id, id, 0.25::DOUBLE / (60 + pos), 1, ['substring'] FROM sub WHERE pos <= 300),
z AS (SELECT query_id, id, sum(score) AS score, max(page) AS page, array_to_string(list_sort(list_distinct(flatten(list(sources)))), '|') AS sources FROM both_ GROUP BY 1, 2)
SELECT query_id, id AS material_id, round(score, 9) AS score, page::INT AS page, sources, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS pos FROM z""".replace("\\\\s", "\\s"))
def search_whole(spark: SparkSession, d: str) -> DataFrame:
    """The whole ranked search without stems: chunks, fields, titles and topics fused, and the substring list where hits are few. Queries are the first one to three words of benchmark texts; three
    documents of four are published, a title is four words, and a topic is named by the first word of a title."""
    docs, b = table(spark, d, "documents"), table(spark, d, "benchmark")
    asked = b.select(F.col("item_id").alias("query_id"), F.slice(T.words(F.col("text")), F.lit(1), (1 + F.col("item_id") % 3).cast("int")).alias("must")).withColumn("raw", F.array_join("must", " "))
    named = F.array_join(F.slice(T.words(first_line()), 1, 4), " ")
    m = docs.select(F.col("doc_id").alias("id"), named.alias("title"), F.col("source").alias("author"), F.col("lang").alias("summary"), F.when(F.col("doc_id") % 4 == 0, "review").otherwise("published").alias("status"))
    name = F.get(T.words(first_line()), F.lit(0))
    filings = docs.select(F.col("doc_id").alias("material_id"), name.alias("category_id")).where("category_id is not null")
    tops = filings.select(F.col("category_id").alias("id")).distinct().select("id", F.col("id").alias("name"), F.lit(None).cast("string").alias("merged_into_id"))
    pages = docs.select(F.col("doc_id").alias("material_id"), F.lit(1).alias("page_number"), "text")
    out = search.ranked_search(asked, m, _chunks(docs), tops, filings, pages, stem=False)
    return out.select("query_id", "material_id", F.round("score", 9).alias("score"), "page", F.array_join("sources", "|").alias("sources"), F.col("pos").cast("int").alias("pos"))


@query()
def search_rrf(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    m = docs.select(F.col("doc_id").alias("id"), first_line().alias("title"), F.col("source").alias("author"), F.col("lang").alias("summary"), F.lit("published").alias("status"))
    parts = _chunks(docs)
    filings = docs.select(F.col("doc_id").alias("material_id"), F.col("source").alias("category_id"))
    pages = docs.select(F.col("doc_id").alias("material_id"), F.lit(1).alias("page_number"), "text")
    out = search.ranked_search(_queries(spark, d), m, parts, _topics(spark, d), filings, pages)
    return out.select("query_id", "material_id", F.round("score", 9).alias("score"), "page", "sources", "pos")


@query(f"""WITH q AS (SELECT item_id AS query_id, lower(trim(regexp_replace(substring(text, 1, 30), '\\s+', ' ', 'g'))) AS term FROM benchmark), p AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS body FROM documents)
SELECT query_id, doc_id AS material_id FROM q JOIN p ON contains(body, term)""")
def substring_hits(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.substring("text", 1, 30).alias("term"))
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("material_id"), F.lit(1).alias("page_number"), "text")
    return listing.contains_join(terms, pages).select("query_id", "material_id")


GRAMS = "flatten(list_transform({0}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))"


@query(f"""WITH t AS (SELECT DISTINCT p_name AS id FROM part), tt AS (SELECT id, {GRAMS.format(WORDS.format("id"))} AS g FROM t), qq AS (SELECT DISTINCT p_name AS id FROM part WHERE p_partkey % 20 = 0), q AS (SELECT id, list_distinct({GRAMS.format(WORDS.format("split_part(id, ' ', 1)"))}) AS g FROM qq),
c AS (SELECT q.id AS query_id, tt.id AS material_id, q.g AS a, tt.g AS b FROM q JOIN tt ON len(list_intersect(q.g, list_distinct(tt.g))) > 0.42 * len(q.g)),
x AS (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM c), y AS (SELECT *, unnest(range(i, len(b) + 1)) AS j FROM x), z AS (SELECT query_id, material_id, a, b, list_distinct(b[i:j]) AS e FROM y),
s AS (SELECT query_id, material_id, any_value(a) AS a, any_value(list_distinct(b)) AS b, max(len(list_intersect(a, e))::DOUBLE / (len(a) + len(e) - len(list_intersect(a, e)))) AS best FROM z GROUP BY 1, 2)
SELECT query_id, material_id, round(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS rank FROM s WHERE best > 0.42""")
def trigram_titles(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select("p_name").distinct()
    m = names.select(F.col("p_name").alias("id"), F.col("p_name").alias("title"))
    q = table(spark, d, "part").where("p_partkey % 20 = 0").select("p_name").distinct().select(F.col("p_name").alias("query_id"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("raw"))
    return search.title_hits(q, m).select("query_id", "material_id", F.round("rank", 6).alias("rank"))
