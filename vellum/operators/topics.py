"""Topic suggestion by neighbours and names, filing, and the upkeep of topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators.listing import first_spelling, next_ordinal, top_n_per_group
from vellum.operators.ann import Cells, nearest
from vellum.operators.vectors import top_k
from vellum.sources.scratch import settle


def neighbour_vote(subjects: DataFrame, docs: DataFrame, filings: DataFrame, topics: DataFrame, k: int = 15, n: int = 3, floor: float = 0.2, strong: float = 0.4, cells: Cells | None = None) -> DataFrame:
    """(material_id, topic, weight, votes, share, strong, because): votes of the k nearest others. Shares are of all neighbours' weight, filed or not.
    cells: an index of docs, searched exactly; without it all are compared with all."""
    near = settle(top_k(subjects, docs, k) if cells is None else nearest(subjects, cells, k))  # searched once, read twice
    total = near.groupBy("query").agg(F.sum("cosine").alias("total"), F.count("*").alias("of"))
    named = filings.join(topics.where("merged_into_id is null").select(F.col("id").alias("category_id")), "category_id")
    votes = near.join(named.select(F.col("material_id").alias("item"), "category_id"), "item").groupBy("query", "category_id").agg(F.sum("cosine").alias("weight"), F.count("*").alias("votes"))
    best = top_n_per_group(votes, ["query"], [F.desc("weight"), "category_id"], n).join(total, "query")
    best = best.withColumn("share", F.when(F.col("total") > 0, F.col("weight") / F.col("total")).otherwise(0.0)).where(F.col("share") >= floor)
    because = F.concat(F.col("votes").cast("string"), F.lit(" of the "), F.col("of").cast("string"), F.lit(" nearest are filed here"))
    return best.select(F.col("query").alias("material_id"), F.col("category_id").alias("topic"), "weight", "votes", "share", (F.col("share") >= strong).alias("strong"), because.alias("because"))


def name_match(subjects: DataFrame, topics: DataFrame, n: int = 3) -> DataFrame:
    near = top_k(subjects, topics.where("merged_into_id is null"), n)
    return near.select(F.col("query").alias("material_id"), F.col("item").alias("topic"), F.col("cosine").alias("similarity"))


def suggest(subjects: DataFrame, docs: DataFrame, filings: DataFrame, topics: DataFrame, n: int = 3, **more) -> DataFrame:
    """Votes first, then names not among them, n at most."""
    votes = neighbour_vote(subjects, docs, filings, topics, n=n, **more)
    names = name_match(subjects, topics, n).join(votes.select("material_id", "topic"), ["material_id", "topic"], "left_anti")
    both = votes.select("material_id", "topic", F.lit(0).alias("from"), F.col("weight").alias("by"), "strong").unionByName(names.select("material_id", "topic", F.lit(1).alias("from"), F.col("similarity").alias("by"), F.lit(False).alias("strong")))
    return both.withColumn("pos", F.row_number().over(W.partitionBy("material_id").orderBy("from", F.desc("by"), "topic"))).where(F.col("pos") <= n)


def evaluate_suggestions(suggested: DataFrame, filed: DataFrame) -> DataFrame:
    """Share of filed materials (material_id, category_id) offered anything, and offered their topic."""
    hit = filed.join(suggested.select("material_id", "topic"), "material_id", "left").groupBy("material_id").agg(F.bool_or(F.coalesce(F.col("topic") == F.col("category_id"), F.lit(False))).alias("right"), F.bool_or(F.col("topic").isNotNull()).alias("offered"))
    return hit.agg(F.count("*").alias("filed"), F.count_if("offered").alias("offered"), F.count_if("right").alias("right"), F.round(F.avg(F.col("right").cast("double")), 6).alias("share_right"))


def seed_topics(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """New topics (slug, name) from rows (row, topics array): first spelling wins, known slugs are left."""
    each = rows.select("row", F.posexplode("topics").alias("position", "name")).withColumn("slug", T.slugify(F.col("name")))
    return first_spelling(each).join(existing.select("slug"), "slug", "left_anti")


def import_materials(rows: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New materials with unique slugs, and their filings by topic slug, out of sheet rows (row, title, author, summary, file_id, topics)."""
    from vellum.operators.layout import assign_slugs

    fresh = rows.join(existing.where("drive_file_id is not null").select(F.col("drive_file_id").alias("file_id")), "file_id", "left_anti")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    made = fresh.select("row", T.clean_title(F.col("title")).alias("title"), F.col("title").alias("title_original"), blank("author").alias("author"), blank("summary").alias("summary"), "file_id", "topics")
    slugs = assign_slugs(made.select(F.col("row").alias("arrival"), "title"), existing.select("slug"))
    made = made.join(slugs.select(F.col("arrival").alias("row"), "slug"), "row")
    filings = made.select("slug", F.posexplode("topics").alias("ordinal", "topic")).withColumn("topic_slug", T.slugify(F.col("topic")))
    first = filings.groupBy("slug", "topic_slug").agg(F.min("ordinal").alias("ordinal"))
    return made.drop("topics"), first


def merge_topic(filings: DataFrame, mapping: DataFrame) -> DataFrame:
    """Filings after topics merge by mapping (source, target): moved unless the material is on the target already."""
    m = filings.join(mapping, filings.category_id == mapping.source, "left")
    moved = m.withColumn("was_there", F.col("source").isNull()).withColumn("to", F.coalesce("target", "category_id"))
    best = moved.withColumn("_n", F.row_number().over(W.partitionBy("material_id", "to").orderBy(F.desc("was_there"), "ordinal", "category_id"))).where("_n = 1")
    return best.select(*[F.col("to").alias(c) if c == "category_id" else F.col(c) for c in filings.columns])


def unmerge_topic(filings: DataFrame, source: str, target: str, wanted: DataFrame) -> DataFrame:
    """Filings on target go back to source for the materials that wanted (material_id) lists."""
    w = wanted.select("material_id").distinct().withColumn("_back", F.lit(True))
    back = F.coalesce(F.col("_back"), F.lit(False)) & (F.col("category_id") == target)
    return filings.join(w, "material_id", "left").withColumn("category_id", F.when(back, F.lit(source)).otherwise(F.col("category_id"))).select(*filings.columns)


def create_topics(requests: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) of requests (name): a slug that exists or comes twice is refused."""
    r = requests.withColumn("slug", T.slugify(F.col("name"))).withColumn("_n", F.row_number().over(W.partitionBy("slug").orderBy("name")))
    ok = r.where("_n = 1").drop("_n").join(topics.select("slug"), "slug", "left_anti")
    return ok, r.where("_n > 1").drop("_n").unionByName(r.where("_n = 1").drop("_n").join(topics.select("slug"), "slug", "left_semi"))


def rename_topics(requests: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) of requests (id, name): a slug that another topic has is refused."""
    r = requests.withColumn("slug", T.slugify(F.col("name"))).join(topics.select("id"), "id", "left_semi")
    taken = r.join(topics.select("slug", F.col("id").alias("owner")), "slug").where("owner <> id").select("id")
    return r.join(taken, "id", "left_anti"), r.join(taken, "id", "left_semi")


def delete_topics(ids: DataFrame, topics: DataFrame, filings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(topics left, filings left, deleted with how many filings went)."""
    gone = ids.select(F.col("id").alias("category_id")).distinct()
    counts = filings.join(gone, "category_id", "left_semi").groupBy("category_id").agg(F.count("*").alias("filings"))
    report = topics.join(gone, topics.id == gone.category_id, "left_semi").select(F.col("id").alias("category_id"), "name").join(counts, "category_id", "left").fillna(0, ["filings"])
    return topics.join(gone, topics.id == gone.category_id, "left_anti"), filings.join(gone, "category_id", "left_anti"), report


def describe_topics(entries: DataFrame, topics: DataFrame) -> DataFrame:
    """entries (slug, blurb) with outcome: not-found, merged, already-described, write."""
    t = topics.select("slug", F.col("blurb").alias("old"), "merged_into_id", F.lit(True).alias("found"))
    outcome = F.when(F.col("found").isNull(), "not-found").when(F.col("merged_into_id").isNotNull(), "merged").when(F.trim(F.coalesce("old", F.lit(""))) != "", "already-described").otherwise("write")
    return entries.join(t, "slug", "left").select("slug", "blurb", outcome.alias("outcome"))


def assign(filings: DataFrame, requests: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(filings with the new ones, refused requests) for requests (material_id, category_id, assigned_by, from_suggestion)."""
    r = requests.dropDuplicates(["material_id", "category_id"])
    held = filings.select("material_id", "category_id")
    ok = r.join(held, ["material_id", "category_id"], "left_anti").join(next_ordinal(filings), "material_id", "left")
    nth = F.row_number().over(W.partitionBy("material_id").orderBy("category_id")) - 1
    new = ok.select("material_id", "category_id", (F.coalesce("next_ordinal", F.lit(0)) + nth).cast("int").alias("ordinal"), "assigned_by", F.when(F.col("from_suggestion"), now).alias("suggested"), now.alias("created_at"))
    return filings.unionByName(new, allowMissingColumns=True), r.join(held, ["material_id", "category_id"], "left_semi")


def unassign(filings: DataFrame, requests: DataFrame) -> DataFrame:
    return filings.join(requests.select("material_id", "category_id"), ["material_id", "category_id"], "left_anti")
