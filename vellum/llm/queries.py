"""Registered queries of the operators; thin digests over what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import dedup_substrings

    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.expr("crc32(cast(doc_id as string)) % 3 = 1"))
    found = langid.predict(docs, langid.train(docs.where("not held_out")))
    return found.select("doc_id", "held_out", "lang_pred", "score", "lang_rejected")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    placed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import compare_with_next

    found = compare_with_next(table(spark, sf_dir, "documents"))
    hexed = [F.lower(F.hex(c)).alias(a) for c, a in (("hashes", "fingerprint"), ("edited_hashes", "edited_fingerprint"))]
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), *hexed, "near_edited", "near_next", "positions", "edited_positions")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import dedup_suffixes

    found = dedup_suffixes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .segmentations import sample_segmentations

    found = sample_segmentations(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    return found.select("doc_id", "sample", F.expr("octet_length(ids) div 4").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "log_prob", "perturbed", "inclusion", F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster_vectors

    found = cluster_vectors(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))


def op12_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .prefix_bpe import encode_documents

    found = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), decoded=True)
    return found.select("doc_id", "n_tokens", F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_substring_dedup, op2_language_id, op3_packing, op4_fingerprints, op5_suffix_dedup, op6_license_scan, op7_pii, op8_sentencepiece, op9_embedding_near_dedup, op10_jaccard_join, op11_centroids, op12_bpe_trie, op13_whitening)}


# ---- the same in SQL, for what SQL can say -----------------------------------------------------------------------------------

WORD_ROWS = r"""kw AS (SELECT doc_id, list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM kw)"""

OP1 = f"""WITH {WORD_ROWS.format("coalesce(text, '')")},
h1 AS (SELECT *, hash(x) AS a FROM u), h2 AS (SELECT *, hash(a, lead(a, 1) OVER o) AS b FROM h1 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h4 AS (SELECT *, hash(b, lead(b, 2) OVER o) AS c FROM h2 WINDOW o AS (PARTITION BY doc_id ORDER BY i)), h8 AS (SELECT *, hash(c, lead(c, 4) OVER o) AS d FROM h4 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h16 AS (SELECT *, hash(d, lead(d, 8) OVER o) AS e FROM h8 WINDOW o AS (PARTITION BY doc_id ORDER BY i)), h32 AS (SELECT *, hash(e, lead(e, 16) OVER o) AS f FROM h16 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h50 AS (SELECT doc_id, i, x, CASE WHEN lead(i, 49) OVER o IS NOT NULL THEN hash(f, lead(e, 32) OVER o, lead(b, 48) OVER o) END AS g FROM h32 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
first AS (SELECT g, min(doc_id) AS least FROM h50 WHERE g IS NOT NULL GROUP BY g),
flag AS (SELECT h50.doc_id, i, x, coalesce(least < h50.doc_id, false) AS hit FROM h50 LEFT JOIN first ON first.g = h50.g),
gone AS (SELECT doc_id, i, x, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM flag),
kept AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS r, string_agg(x, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS k FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id"""

OP5 = """WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents), u AS (SELECT doc_id, unnest(range(1, n + 1)) AS i, unnest(list_transform(range(0, n), lambda k: substr(h, 2 * k + 1, 2))) AS x FROM b),
h1 AS (SELECT *, hash(x) AS a FROM u), h2 AS (SELECT *, hash(a, lead(a, 1) OVER o) AS b FROM h1 WINDOW o AS (PARTITION BY doc_id ORDER BY i)), h4 AS (SELECT *, hash(b, lead(b, 2) OVER o) AS c FROM h2 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h8 AS (SELECT *, hash(c, lead(c, 4) OVER o) AS d FROM h4 WINDOW o AS (PARTITION BY doc_id ORDER BY i)), h16 AS (SELECT *, hash(d, lead(d, 8) OVER o) AS e FROM h8 WINDOW o AS (PARTITION BY doc_id ORDER BY i)), h32 AS (SELECT *, hash(e, lead(e, 16) OVER o) AS f FROM h16 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h64 AS (SELECT *, hash(f, lead(f, 32) OVER o) AS g FROM h32 WINDOW o AS (PARTITION BY doc_id ORDER BY i)), h200 AS (SELECT doc_id, i, x, CASE WHEN lead(i, 199) OVER o IS NOT NULL THEN hash(g, lead(g, 64) OVER o, lead(g, 128) OVER o, lead(d, 192) OVER o) END AS w FROM h64 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
often AS (SELECT w FROM h200 WHERE w IS NOT NULL GROUP BY w HAVING count(*) > 1), flag AS (SELECT doc_id, i, x, often.w IS NOT NULL AS hit FROM h200 LEFT JOIN often ON often.w = h200.w),
gone AS (SELECT doc_id, i, x, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM flag), edge AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM gone),
kept AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS r, count(*) FILTER (WHERE opens) AS s, string_agg(x, '' ORDER BY i) FILTER (WHERE NOT gone) AS k FROM edge GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_bytes, coalesce(r, 0) AS n_removed, coalesce(s, 0) AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256 FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id"""

CONNECT = """ed AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), r(id, c) AS (SELECT a, a FROM ed UNION SELECT ed.b, r.c FROM r JOIN ed ON ed.a = r.id), m AS (SELECT id, min(c) AS c FROM r GROUP BY id)"""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP10 = f"""WITH RECURSIVE {WORD_ROWS.format(LOWERED)},
g5 AS (SELECT doc_id, CASE WHEN lead(i, 4) OVER o IS NOT NULL THEN hash(x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) END AS g FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
e0 AS (SELECT DISTINCT doc_id, g FROM g5 WHERE g IS NOT NULL UNION SELECT doc_id, hash(array_to_string(w, ' '), len(w)) FROM kw WHERE len(w) BETWEEN 1 AND 4),
e AS (SELECT doc_id, g, count(*) OVER (PARTITION BY doc_id) AS n FROM e0),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS k FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
pr AS (SELECT a, b FROM p WHERE 100 * k >= 75 * (na + nb - k)), {CONNECT}, n AS (SELECT doc_id, count(*) AS n FROM e0 GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.id = d.doc_id"""

OP9 = f"""WITH RECURSIVE pr AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.95), {CONNECT},
l AS (SELECT a, count(*) AS n FROM ed GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept FROM embeddings LEFT JOIN l ON l.a = vec_id LEFT JOIN m ON m.id = vec_id"""

NEAREST = """a{0} AS MATERIALIZED (SELECT rid, (m % 16)::INT AS c, m // 16 AS d FROM (SELECT rid, min(list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - cc.v[i]) * (k.v[i] - cc.v[i])))::HUGEINT * 16 + cc.c) AS m FROM k CROSS JOIN c{0} cc GROUP BY rid))"""
MEANS = """m{1} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (SELECT c, i, sum(x) AS s, count(*)::HUGEINT AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM a{0} JOIN k USING (rid)) GROUP BY c, i) GROUP BY c),
c{1} AS MATERIALIZED (SELECT cc.c, coalesce(m{1}.v, cc.v) AS v FROM c{0} cc LEFT JOIN m{1} ON m{1}.c = cc.c)"""
OP11 = f"""WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM k ORDER BY h NULLS LAST, v LIMIT 16)),
{", ".join(NEAREST.format(r) + ", " + MEANS.format(r, r + 1) for r in range(3))}, {NEAREST.format(3)}
SELECT vec_id, c3.c::INT AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY c3.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256 FROM k JOIN a3 USING (rid) JOIN c3 ON c3.c = a3.c"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1, "op5_suffix_dedup": OP5, "op9_embedding_near_dedup": OP9, "op10_jaccard_join": OP10, "op11_centroids": OP11}
