"""Filters, joins, aggregates, windows, orders and set operations over the tables of a collection.

Tables: materials(id, ...), pages(material_id, page_number, ...), filings(material_id, category_id, ordinal, ...), topics(id,
slug, name, merged_into_id), audit, accounts. Every function takes and returns DataFrames; topics and accounts are small
dimension tables, which Spark broadcasts by their size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions.text import collapse_ws

POOR = 0.55

# ---- filters -------------------------------------------------------------------------------------------------------------


def published(df: DataFrame) -> DataFrame:
    return df.where("status = 'published'")


def live(df: DataFrame, column: str = "archived_at") -> DataFrame:
    return df.where(F.col(column).isNull())


def exists_filter(df: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    return df.join(other.select(F.col(right).alias(left)), left, "left_semi")


def not_exists_filter(df: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    return df.join(other.select(F.col(right).alias(left)), left, "left_anti")


def library_filter(materials: DataFrame, filings: DataFrame, topics: DataFrame, topic: str | None = None, author: str | None = None) -> DataFrame:
    """Materials filed under a topic's slug (`all`: any) and by an author."""
    if topic and topic != "all":
        chosen = topics.where(F.col("slug") == topic).select(F.col("id").alias("category_id"))
        materials = exists_filter(materials, filings.join(chosen, "category_id"), "id", "material_id")
    return materials.where(F.col("author") == author) if author else materials


def backlog_filter(materials: DataFrame, pages: DataFrame, filings: DataFrame, kind: str, poor: float = POOR) -> DataFrame:
    if kind in ("review", "archived"):
        return materials.where(F.col("archived_at").isNotNull()) if kind == "archived" else live(materials).where("status = 'review'")
    out = live(materials)
    if kind == "in-progress":
        return out.where(F.col("status").isin("staged", "processing", "rejected"))
    if kind == "uncategorised":
        return not_exists_filter(out, filings, "id", "material_id")
    if kind == "needs-ocr":
        return exists_filter(out, pages.where("ocr_engine = 'none'"), "id", "material_id")
    if kind == "poorly-read":
        return exists_filter(out, pages.where(F.col("ocr_quality") < poor), "id", "material_id")
    if kind == "all":
        return out
    raise ValueError(f"no such backlog: {kind}")


def ilike_any(df: DataFrame, columns: Sequence[str], term: str | None, like_wildcards: bool = False) -> DataFrame:
    """Rows with the term in any column, whatever its case; a blank term keeps all."""
    if not term or not term.strip():
        return df
    term = term.strip()
    one = (lambda c: F.col(c).ilike(f"%{term}%")) if like_wildcards else (lambda c: F.contains(F.lower(F.col(c)), F.lower(F.lit(term))))
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(one(c), F.lit(False))
    return df.where(found)


def in_flight(materials: DataFrame, now: Column, window: str = "1 hour") -> DataFrame:
    return live(materials).where(F.col("status").isin("staged", "processing") & (F.col("updated_at") >= now - F.expr(f"interval {window}")))


def needs_embedding(materials: DataFrame, pages: DataFrame, chunks: DataFrame, force: bool = False) -> DataFrame:
    out = exists_filter(live(materials), pages.where("trim(text) <> ''"), "id", "material_id")
    out = out if force else not_exists_filter(out, chunks, "id", "material_id")
    return out.orderBy("created_at", "id")


def needs_reading(pages: DataFrame, mode: str = "new", preferred: str = "vision", image: str = "r2_key_webp", empty_only: bool = False) -> DataFrame:
    """Pages with an image that are to be read. empty_only: of new ones only those without text, as a server that reads on demand wants them."""
    if empty_only and mode == "new":
        pages = pages.where("coalesce(trim(text), '') = ''")
    wanted = {"new": F.col("ocr_engine") == "none", "redo": F.col("ocr_engine") != preferred, "force": F.col("ocr_engine") == preferred}[mode]
    return pages.where(wanted & F.col(image).isNotNull())


def engine_scope(pages: DataFrame, engine: str | None = None) -> DataFrame:
    out = pages.where("text is not null")
    return out.where(F.col("ocr_engine") == engine) if engine else out


def valid_ids(df: DataFrame, column: str = "id", most: int = 100) -> DataFrame:
    """The first `most` distinct UUIDs, in order."""
    return df.select(column).where(F.lower(F.col(column)).rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).distinct().orderBy(column).limit(most)


def json_field_equals(df: DataFrame, column: str, path: str, value: str) -> DataFrame:
    return df.where(F.get_json_object(column, f"$.{path}") == value)


def sort_key(name: str | None, searching: bool) -> str:
    known = ("recent", "oldest", "title", "ztitle", "relevance")
    if name not in known:
        return "relevance" if searching else "recent"
    return "recent" if name == "relevance" and not searching else name


def with_uncategorised(df: DataFrame, topics: str = "topics") -> DataFrame:
    """Add shelf: the first topic, or `uncategorised`."""
    return df.withColumn("shelf", F.coalesce(F.get(F.col(topics), F.lit(0)), F.lit("uncategorised")))


# ---- joins ---------------------------------------------------------------------------------------------------------------


def topics_for(filings: DataFrame, topics: DataFrame) -> DataFrame:
    """(material_id, topics): topic names by ordinal. A material has few filings, so its list is short."""
    named = filings.join(topics.select(F.col("id").alias("category_id"), "name"), "category_id")
    lists = named.groupBy("material_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "category_id", "name"))).alias("t"))
    return lists.select("material_id", F.transform("t", lambda x: x["name"]).alias("topics"))


def topic_counts(topics: DataFrame, filings: DataFrame, materials: DataFrame) -> DataFrame:
    ours = published(materials).select(F.col("id").alias("material_id"))
    return filings.join(ours, "material_id").join(topics.select(F.col("id").alias("category_id"), "slug", "name"), "category_id").groupBy("category_id", "slug", "name").agg(F.count("*").alias("n"))


def topic_counts_all(topics: DataFrame, filings: DataFrame, materials: DataFrame) -> DataFrame:
    """Total and published counts of every topic, empty ones included."""
    filed = filings.join(materials.select(F.col("id").alias("material_id"), "status"), "material_id", "left")
    joined = topics.join(filed.withColumnRenamed("category_id", "id").select("id", "material_id", "status"), "id", "left")
    return joined.groupBy("id", "slug", "name").agg(F.count("material_id").alias("total"), F.count_if(F.col("status") == "published").alias("published"))


def with_actor(audit: DataFrame, accounts: DataFrame) -> DataFrame:
    return audit.join(accounts.select(F.col("id").alias("actor_id"), F.col("name").alias("actor_name")), "actor_id", "left")


def no_children(materials: DataFrame, pages: DataFrame) -> DataFrame:
    return not_exists_filter(materials, pages, "id", "material_id")


def pair_sides(pairs: DataFrame, cards: DataFrame, a: str = "material_a_id", b: str = "material_b_id") -> DataFrame:
    """Pairs with the card of each side; a pair that lacks one goes."""
    left, right = (cards.select(F.col("id").alias(k), F.struct(*[c for c in cards.columns]).alias(side)) for k, side in ((a, "side_a"), (b, "side_b")))
    return pairs.join(left, a).join(right, b)


def filed_by(filings: DataFrame, topics: DataFrame, accounts: DataFrame) -> DataFrame:
    named = filings.join(topics.select(F.col("id").alias("category_id"), F.col("name").alias("topic")), "category_id")
    return named.join(accounts.select(F.col("id").alias("assigned_by"), F.col("name").alias("filed_by")), "assigned_by", "left").orderBy("material_id", "ordinal", "category_id")


def lookup_known(manifest: DataFrame, materials: DataFrame, key: str = "file_id", known: str = "drive_file_id") -> DataFrame:
    return manifest.join(materials.select(F.col(known).alias(key), F.col("id").alias("material_id"), "drive_md5", "archived_at"), key, "left")


def contains_join(terms: DataFrame, pages: DataFrame, most: int | None = None) -> DataFrame:
    """(query_id, material_id, page_number): pages whose text, white space collapsed, holds the term.

    A term is looked up by its rarest gram, of three signs or, in shorter terms, of all its signs, and then verified, so rows meet on a key."""
    clean = lambda c: F.lower(F.trim(collapse_ws(c)))
    # as many passes as a gram has signs: substrings by position would each count from the start
    of = lambda c, n: F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(F.substr(c, F.lit(k + 1)), F.lit(f"(?s)(.{{{n}}})"), F.lit(1)) for k in range(n)])))
    t = terms.select("query_id", clean(F.col("term")).alias("term")).where("term <> ''").withColumn("n", F.least(F.lit(3), F.length("term")))
    p = pages.select("material_id", "page_number", clean(F.col("text")).alias("body"))
    wanted = t.select("query_id", "term", F.explode(F.when(F.col("n") == 3, of(F.col("term"), 3)).otherwise(F.array("term"))).alias("gram"))
    sizes = [r["n"] for r in t.select("n").distinct().collect()]  # three at most
    grams = F.flatten(F.array(*[of(F.col("body"), n) for n in sizes])) if sizes else F.array().cast("array<string>")
    # only grams that some term holds leave the pages' side
    post = p.select("material_id", "page_number", F.explode(grams).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi")
    counts = post.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "gram", "left").groupBy("query_id", "term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    met = rarest.select("query_id", "term", F.col("r.gram").alias("gram")).join(post, "gram").join(p, ["material_id", "page_number"])
    out = met.where(F.contains("body", F.col("term"))).select("query_id", "material_id", "page_number").distinct()
    return top_n_per_group(out.groupBy("query_id", "material_id").agg(F.min("page_number").alias("page_number")), ["query_id"], ["material_id"], most) if most else out


# ---- aggregates ----------------------------------------------------------------------------------------------------------


def backlog_counts(materials: DataFrame, pages: DataFrame, filings: DataFrame, poor: float = POOR) -> DataFrame:
    """All backlog counts in one pass; pages and filings are first brought to one row a material."""
    p = pages.groupBy(F.col("material_id").alias("id")).agg(F.bool_or(F.col("ocr_engine") == "none").alias("unread"), F.bool_or(F.col("ocr_quality") < poor).alias("poor"))
    f = filings.select(F.col("material_id").alias("id")).distinct().withColumn("filed", F.lit(True))
    m = materials.join(p, "id", "left").join(f, "id", "left")
    alive = F.col("archived_at").isNull()
    return m.agg(
        F.count_if(alive).alias("all"),
        F.count_if(alive & F.col("status").isin("staged", "processing", "rejected")).alias("in_progress"),
        F.count_if(alive & F.col("filed").isNull()).alias("uncategorised"),
        F.count_if(alive & F.coalesce("unread", F.lit(False))).alias("needs_ocr"),
        F.count_if(alive & F.coalesce("poor", F.lit(False))).alias("poorly_read"),
        F.count_if(alive & (F.col("status") == "review")).alias("review"),
        F.count_if(~alive).alias("archived"),
    )


def topic_list(topics: DataFrame, filings: DataFrame, materials: DataFrame, n: int = 100) -> DataFrame:
    return topic_counts(topics.where("merged_into_id is null"), filings, materials).orderBy(F.desc("n"), "name", "category_id").limit(n)


def author_list(materials: DataFrame, scope: str = "published", n: int = 100) -> DataFrame:
    ours = published(materials) if scope == "published" else live(materials)
    return ours.where("author is not null").groupBy("author").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author").limit(n)


def thin_topics(counts: DataFrame, threshold: int = 1) -> DataFrame:
    return counts.where(F.col("total") <= threshold)


def corpus_stats(materials: DataFrame, filings: DataFrame) -> DataFrame:
    ours = published(materials).select(F.col("id").alias("material_id"))
    topics = filings.join(ours, "material_id", "left_semi").agg(F.countDistinct("category_id").alias("topics"))
    return ours.agg(F.count("*").alias("materials")).join(topics)  # one row each


def reading_status(pages: DataFrame, preferred: str = "vision", poor: float = POOR) -> DataFrame:
    out = pages.agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("ocr_engine") == preferred).alias("preferred"),
        F.count_if(F.col("ocr_engine") == "text_layer").alias("text_layer"),
        F.count_if((F.col("ocr_engine") == "none") & F.col("r2_key_webp").isNotNull()).alias("queue"),
        F.count_if((F.col("ocr_engine") == "none") & F.col("r2_key_webp").isNull()).alias("unreadable"),
        F.count_if(F.col("ocr_quality") < poor).alias("poor"),
    )
    return out.withColumn("read_percent", F.when(F.col("pages") == 0, 0).otherwise(F.round(100 * (F.col("pages") - F.col("queue") - F.col("unreadable")) / F.col("pages")).cast("long")))


def stuck_pages(materials: DataFrame, pages: DataFrame) -> DataFrame:
    stuck = pages.where("ocr_engine = 'none' and r2_key_webp is null").groupBy("material_id").agg(F.count("*").alias("stuck"))
    return stuck.join(materials.select(F.col("id").alias("material_id"), "title"), "material_id").orderBy(F.desc("stuck"), "material_id")


def material_text(pages: DataFrame, key: str = "material_id", order: str = "page_number", text: str = "text", joiner: str = " ") -> DataFrame:
    """One text a material, its pages in order; nulls left out. A material's pages are few."""
    lists = pages.where(F.col(text).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("p"))
    return lists.select(key, F.array_join(F.transform("p", lambda x: x["t"]), joiner).alias("text"))


def readable_text(pages: DataFrame, materials: DataFrame) -> DataFrame:
    whole = material_text(pages, joiner="\n\n")
    return materials.select(F.col("id").alias("material_id"), "text_public").join(whole, "material_id", "left").select("material_id", F.when(F.col("text_public"), F.trim("text")).alias("text"))


def contributors(audit: DataFrame, accounts: DataFrame) -> DataFrame:
    found = audit.where("actor_id is not null").groupBy("entity_id", "actor_id").agg(F.max("created_at").alias("last_at"), F.count("*").alias("changes"))
    return with_actor(found, accounts)


def tally(df: DataFrame, column: str = "result") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def account_rollup(accounts: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    """Last session and unexpired sessions of every account."""
    s = sessions.groupBy(F.col("user_id").alias("id")).agg(F.max("updated_at").alias("last_seen"), F.count_if(F.col("expires_at") > now).alias("open_sessions"))
    return accounts.join(s, "id", "left").withColumn("open_sessions", F.coalesce("open_sessions", F.lit(0)))


def first_spelling(rows: DataFrame) -> DataFrame:
    """(slug, name): the first spelling by row and position."""
    return rows.groupBy("slug").agg(F.min_by("name", F.struct("row", "position")).alias("name"))


def next_ordinal(filings: DataFrame) -> DataFrame:
    return filings.groupBy("material_id").agg((F.coalesce(F.max("ordinal"), F.lit(-1)) + 1).alias("next_ordinal"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def actors(audit: DataFrame, accounts: DataFrame) -> DataFrame:
    """(id, name, email) of everyone who has ever acted, by name."""
    return accounts.join(audit.select(F.col("actor_id").alias("id")), "id", "left_semi").select("id", "name", "email").orderBy("name", "id")


def embed_progress(materials: DataFrame, chunks: DataFrame) -> DataFrame:
    done = chunks.groupBy(F.col("material_id").alias("id")).agg(F.count("*").alias("chunks"))
    m = live(materials).join(done, "id", "left")
    return m.agg(F.count("*").alias("materials"), F.count("chunks").alias("embedded"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.count_if(F.col("chunks").isNull()).alias("skipped"))


def best_engine(materials: DataFrame, pages: DataFrame, preferred: str = "vision") -> DataFrame:
    by = pages.groupBy(F.col("material_id").alias("id")).agg(F.bool_or(F.col("ocr_engine") == preferred).alias("read"))
    engine = F.when((F.col("ocr_engine") != "text_layer") & F.coalesce("read", F.lit(False)), preferred).otherwise(F.col("ocr_engine"))
    return materials.join(by, "id", "left").withColumn("ocr_engine", engine).drop("read")


def page_health(pages: DataFrame, poor: float = POOR) -> DataFrame:
    return pages.groupBy("material_id").agg(F.count("text").alias("with_text"), F.count_if(F.col("ocr_quality") < poor).alias("poor"))


def has_usable_text(pages: DataFrame, least: int = 200) -> DataFrame:
    return pages.groupBy("material_id").agg((F.avg(F.length(F.coalesce("text", F.lit("")))) >= least).alias("usable"))


# ---- windows, orders, pages, sets ---------------------------------------------------------------------------------------


def rank_lists(hits: DataFrame, by: Sequence[str] = ("query_id", "source")) -> DataFrame:
    return hits.withColumn("pos", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("rank"), "material_id")))


def latest_per_key(df: DataFrame, key: str, at: str = "created_at", id: str = "id") -> DataFrame:
    """The newest row of each key, by an aggregate: no sort of a key's rows."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.struct(at, id)).alias("_r")).select(key, "_r.*")


def top_n_per_group(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def recent(materials: DataFrame, n: int = 8) -> DataFrame:
    return published(materials).orderBy(F.desc("created_at"), "id").limit(n)


def paginate(df: DataFrame, order: Sequence[Column | str], page: int = 1, size: int = 48) -> tuple[DataFrame, dict[str, int | bool]]:
    """A page of rows, and total, pages, page, from, to, has_more. One count is the only action."""
    total = df.count()
    pages, page = max(1, -(-total // size)), max(1, page)
    start = (page - 1) * size
    about = {"total": total, "pages": pages, "page": page, "from": start + 1 if total > start else 0, "to": min(total, start + size), "has_more": start + size < total}
    return df.orderBy(*order).offset(start).limit(size), about


def library_order(sort: str, position: str = "pos") -> list[Column]:
    title = F.collate(F.col("title"), "UNICODE_CI")
    order = {"recent": [F.desc("created_at")], "oldest": [F.asc("created_at")], "title": [title.asc(), F.asc("title")], "ztitle": [title.desc(), F.desc("title")], "relevance": [F.asc(position)]}[sort]
    return [*order, F.asc("id")]


def next_unfiled(materials: DataFrame, filings: DataFrame, after: str) -> DataFrame:
    return not_exists_filter(live(materials).where(F.col("id") != after), filings, "id", "material_id").orderBy("created_at", "id").limit(1)


def pending_pairs(pairs: DataFrame, n: int = 20, offset: int = 0) -> DataFrame:
    return pairs.where("status = 'pending'").orderBy(F.desc("score"), "created_at", "id").offset(offset).limit(n)


def decided_pairs(pairs: DataFrame, n: int = 50) -> DataFrame:
    return pairs.where("status <> 'pending'").orderBy(F.desc("decided_at"), "id").limit(n)


def strongest(found: DataFrame, n: int = 10) -> DataFrame:
    return found.orderBy(F.desc("score"), "a", "b").limit(n)


def set_minus(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b.select(*keys), list(keys), "left_anti")


def fuse_lists(lists: dict[str, DataFrame]) -> DataFrame:
    out = None
    for source, df in lists.items():
        df = df.withColumn("source", F.lit(source))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def distinct_keys(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()
