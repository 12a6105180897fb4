"""Material lifecycle as batch decisions: each returns the new table, the refused rows with a reason, and the audit rows.

States: staged, processing, review, published, archived, rejected. Requests are DataFrames with an id column; `now` is a Column, so runs repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators.duplicates import exact_duplicates
from vellum.operators.layout import assign_slugs
from vellum.sources.tables import object_keys


def _audit(df: DataFrame, action: str, now: Column, after: Column | None = None, before: Column | None = None, kind: str = "material") -> DataFrame:
    text = lambda c: F.lit(None).cast("string") if c is None else F.to_json(c)
    return df.select(F.lit(action).alias("action"), F.lit(kind).alias("entity_type"), F.col("id").alias("entity_id"), text(before).alias("before"), text(after).alias("after"), now.alias("created_at"))


def _decide(materials: DataFrame, requests: DataFrame, reason: Column, carry: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(materials with _do and the carried columns, refused requests). reason: why a request is refused, null to accept; a request for no material is refused."""
    r = requests.select("id", *carry).dropDuplicates(["id"]).withColumn("_asked", F.lit(True))
    m = materials.join(r, "id", "left").withColumn("_why", F.when(F.col("_asked"), reason)).withColumn("_do", F.coalesce(F.col("_asked"), F.lit(False)) & F.col("_why").isNull())
    unknown = r.join(materials.select("id"), "id", "left_anti").select("id", F.lit("not found").alias("reason"))
    return m, m.where("_why is not null").select("id", F.col("_why").alias("reason")).unionByName(unknown)


def _put(m: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    return m.select(*[F.when(F.col("_do"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in columns])


def stage(incoming: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(materials, filings, audit) of incoming (id, title, author, summary, source, topics)."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    m = incoming.select("id", F.concat(F.lit("staged-"), "id").alias("slug"), F.trim("title").alias("title"), F.col("title").alias("title_original"), blank("author").alias("author"), blank("summary").alias("summary"), "source", F.lit("staged").alias("status"), now.alias("created_at"))
    f = incoming.select(F.col("id").alias("material_id"), F.posexplode(F.coalesce("topics", F.array().cast("array<string>"))).alias("ordinal", "category_id"))
    filed = f.select(F.col("material_id").alias("id"), "category_id")
    return m, f, _audit(m, "material.create", now, F.struct("title")).unionByName(_audit(filed, "material.categorise", now, F.struct(F.col("category_id").alias("topic"))))


def ingest(staged: DataFrame, files: DataFrame, existing: DataFrame, pages: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(materials, pages, audit) of staged (id, title, ...) with files (id, content): fingerprint, twin check, slug, page engines and quality.

    Refused: titles under two signs, content that is no PDF, bytes that a live material or an earlier row has (rejected, duplicate_of_id set)."""
    s = staged.join(files, "id", "left").withColumn("f", T.fingerprint(F.col("content")))
    s = s.select(*staged.columns, F.col("f.sha256").alias("sha256"), F.col("f.byte_size").alias("byte_size"), (F.substring("content", 1, 5) == F.lit("%PDF-").cast("binary")).alias("is_pdf"), F.col("id").alias("arrival"))
    s = exact_duplicates(s, existing.where("archived_at is null"))
    firsts = s.groupBy("sha256").agg(F.min("id").alias("first_id"))
    s = s.join(firsts, "sha256", "left").withColumn("twin", F.coalesce("existing_id", F.when(~F.col("first"), F.col("first_id"))))
    why = F.when(F.length(F.trim("title")) < 2, "the title is too short").when(~F.coalesce("is_pdf", F.lit(False)), "the file is not a PDF").when(F.col("twin").isNotNull(), "the file is already here")
    s = s.withColumn("reason", why)
    slugs = assign_slugs(s.where("reason is null").select(F.col("id").alias("arrival"), "title"), existing.where("archived_at is null").select("slug"))
    s = s.drop("slug", "arrival").join(slugs.select(F.col("arrival").alias("id"), "slug"), "id", "left")
    usable = pages.groupBy("material_id").agg((F.avg(F.length(F.coalesce("text", F.lit("")))) >= 200).alias("usable"))
    p = pages.join(usable, "material_id").withColumn("ocr_engine", F.when(F.col("usable"), "text_layer").otherwise("none")).withColumn("text", F.when(F.col("usable"), F.col("text")))
    p = p.withColumn("ocr_quality", F.when(F.trim(F.coalesce("text", F.lit(""))) != "", T.score_text(F.col("text"))["score"])).drop("usable")
    done = s.withColumn("status", F.when(F.col("reason").isNull(), "review").otherwise("rejected")).withColumn("duplicate_of_id", F.when(F.col("reason") == "the file is already here", F.col("twin"))).withColumn("updated_at", now)
    audit = _audit(done, "material.ingest", now, F.struct("status", "reason"))
    return done.drop("is_pdf", "existing_id", "first", "first_id", "twin"), p.join(done.where("reason is null").select(F.col("id").alias("material_id")), "material_id", "left_semi"), audit


def publish(materials: DataFrame, requests: DataFrame, now: Column):
    why = F.when(F.col("archived_at").isNotNull(), "archived").when(F.col("status") == "published", "already published").when(F.col("r2_key_pdf").isNull(), "no file")
    m, refused = _decide(materials, requests, why)
    out = _put(m, materials.columns, status=F.lit("published"), published_at=F.coalesce("published_at", now), updated_at=now)
    return out, refused, _audit(m.where("_do"), "material.publish", now)


def archive(materials: DataFrame, requests: DataFrame, now: Column):
    """requests (id, reason)."""
    why = F.when(F.length(F.trim(F.coalesce("reason", F.lit("")))) < 3, "a reason is needed").when(F.col("archived_at").isNotNull(), "already archived")
    m, refused = _decide(materials, requests, why, ["reason"])
    out = _put(m, materials.columns, status=F.lit("archived"), archived_at=now, updated_at=now)
    return out, refused, _audit(m.where("_do"), "material.archive", now, F.struct("reason"))


def restore(materials: DataFrame, requests: DataFrame, now: Column, to: str = "review"):
    """to: review, which keeps duplicate_of_id, or published, from duplicate review, which clears it."""
    m, refused = _decide(materials, requests, F.when(F.col("archived_at").isNull(), "not archived"))
    pointer = F.col("duplicate_of_id") if to == "review" else F.lit(None).cast(dict(materials.dtypes)["duplicate_of_id"])
    out = _put(m, materials.columns, status=F.lit(to), archived_at=F.lit(None).cast("timestamp"), duplicate_of_id=pointer, updated_at=now)
    return out, refused, _audit(m.where("_do"), "material.restore", now, F.struct(F.lit(to).alias("status")))


def edit(materials: DataFrame, changes: DataFrame, now: Column):
    """changes (id, title, author, summary): a blank or omitted author or summary becomes null."""
    c = changes.select("id", F.trim("title").alias("_t"), F.nullif(F.trim("author"), F.lit("")).alias("_a"), F.nullif(F.trim("summary"), F.lit("")).alias("_s"))
    m, refused = _decide(materials, c, F.when(F.length(F.coalesce("_t", F.lit(""))) < 2, "the title is too short"), ["_t", "_a", "_s"])
    out = _put(m, materials.columns, title=F.col("_t"), author=F.col("_a"), summary=F.col("_s"), updated_at=now)
    return out, refused, _audit(m.where("_do"), "material.edit", now, F.struct(F.col("_t").alias("title"), F.col("_a").alias("author"), F.col("_s").alias("summary")), F.struct("title", "author", "summary"))


def set_text_public(materials: DataFrame, flags: DataFrame, now: Column):
    m, refused = _decide(materials, flags.select("id", F.col("text_public").alias("_p")), F.lit(None).cast("string"), ["_p"])
    return _put(m, materials.columns, text_public=F.col("_p"), updated_at=now), refused, _audit(m.where("_do"), "material.text", now, F.struct(F.col("_p").alias("textPublic")))


def dismiss_pairs(pairs: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(pairs, refused): pending ones are dismissed."""
    p = pairs.join(ids.select("id").distinct().withColumn("_asked", F.lit(True)), "id", "left")
    do = F.coalesce(F.col("_asked"), F.lit(False)) & (F.col("status") == "pending")
    out = p.withColumn("decided_at", F.when(do, now).otherwise(F.col("decided_at"))).withColumn("status", F.when(do, "dismissed").otherwise(F.col("status")))
    return out.select(*pairs.columns), p.where("_asked and status <> 'pending'").select("id", F.lit("already decided").alias("reason"))


def resolve_pairs(pairs: DataFrame, materials: DataFrame, filings: DataFrame, decisions: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Apply decisions (id, keep): the other side is archived onto the kept one.

    Refused: pairs decided before, keep outside the pair, a side that is no more, a side to be archived that is so already, and a decision whose side another decision of the batch
    archives or keeps in a chain; it can be made in the next batch. Of decisions that archive the same material the one with the smallest pair id holds.
    """
    p = pairs.join(decisions.select("id", "keep").dropDuplicates(["id"]), "id")
    p = p.withColumn("lose", F.when(F.col("keep") == F.col("material_a_id"), F.col("material_b_id")).when(F.col("keep") == F.col("material_b_id"), F.col("material_a_id")))
    cards = materials.select("id", "title", "archived_at")
    fine = p.where("status = 'pending' and lose is not null")
    fine = fine.join(cards.select(F.col("id").alias("keep"), F.col("title").alias("_keep_title")), "keep")
    fine = fine.join(cards.where("archived_at is null").select(F.col("id").alias("lose"), F.col("title").alias("_lose_title")), "lose")
    once = fine.withColumn("_n", F.row_number().over(W.partitionBy("lose").orderBy("id"))).where("_n = 1").drop("_n")
    ok = once.join(once.select(F.col("lose").alias("keep")).distinct(), "keep", "left_anti")
    refused = decisions.select("id").distinct().join(ok.select("id"), "id", "left_anti").withColumn("reason", F.lit("decided, not in the pair, archived, or part of a chain"))

    move = ok.select(F.col("lose").alias("material_id"), F.col("keep").alias("to"))
    filed = filings.join(move, "material_id", "left")
    to = F.coalesce("to", "material_id")
    first = W.partitionBy("_to", "category_id").orderBy(F.col("to").isNotNull(), "ordinal", "material_id")
    new_filings = filed.withColumn("_to", to).withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*[F.col("_to").alias(c) if c == "material_id" else F.col(c) for c in filings.columns])

    counts = ok.join(materials.select(F.col("id").alias("lose"), "view_count", "download_count"), "lose").groupBy(F.col("keep").alias("id")).agg(F.sum("view_count").alias("_v"), F.sum("download_count").alias("_d"))
    losers = ok.select(F.col("lose").alias("id"), F.col("keep").alias("_kept"))
    m = materials.join(counts, "id", "left").join(losers, "id", "left")
    lost = F.col("_kept").isNotNull()
    change = {
        "view_count": F.col("view_count") + F.coalesce("_v", F.lit(0)),
        "download_count": F.col("download_count") + F.coalesce("_d", F.lit(0)),
        "status": F.when(lost, "archived").otherwise(F.col("status")),
        "archived_at": F.when(lost, now).otherwise(F.col("archived_at")),
        "duplicate_of_id": F.coalesce("_kept", "duplicate_of_id"),
    }
    kinds = dict(materials.dtypes)
    new_materials = m.select(*[change[c].cast(kinds[c]).alias(c) if c in change else F.col(c) for c in materials.columns])

    gone = losers.select(F.col("id").alias("_gone"))
    open_ = pairs.where("status = 'pending'")
    near = open_.join(gone, F.col("material_a_id") == F.col("_gone"), "left_semi").union(open_.join(gone, F.col("material_b_id") == F.col("_gone"), "left_semi")).select("id").distinct().withColumn("_near", F.lit(True))
    q = pairs.join(ok.select("id", F.lit(True).alias("_merged")), "id", "left").join(near, "id", "left")
    status = F.when(F.col("_merged"), "merged").when(F.col("_near"), "dismissed").otherwise(F.col("status"))
    new_pairs = q.withColumn("decided_at", F.when(status != F.col("status"), now).otherwise(F.col("decided_at"))).withColumn("status", status).select(*pairs.columns)
    moved = filings.join(move, "material_id").join(filings.select(F.col("material_id").alias("to"), "category_id"), ["to", "category_id"], "left_anti").groupBy(F.col("material_id").alias("lose")).agg(F.count("*").alias("_moved"))
    told = ok.join(moved, "lose", "left")
    merge = told.select("id", F.struct(F.col("_keep_title").alias("kept"), F.col("_lose_title").alias("archived"), (F.col("score") if "score" in pairs.columns else F.lit(None).cast("double")).alias("score")).alias("b"), F.struct(F.col("keep").alias("keptId"), F.col("lose").alias("archivedId"), F.coalesce("_moved", F.lit(0)).alias("filingsMoved")).alias("a"))
    reason = F.concat(F.lit("A duplicate of “"), "_keep_title", F.lit("”, which was kept instead."))
    away = told.select(F.col("lose").alias("id"), F.struct(F.lit("archived").alias("status"), F.col("_lose_title").alias("name"), reason.alias("reason")).alias("a"))
    audit = _audit(merge, "duplicate.merge", now, F.col("a"), F.col("b"), "duplicate").unionByName(_audit(away, "material.archive", now, F.col("a")))
    return {"pairs": new_pairs, "materials": new_materials, "filings": new_filings, "refused": refused, "audit": audit}


def purge_plan(materials: DataFrame, pages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plan, object keys, materials with pointers to purged ones cleared); archived materials only."""
    gone = materials.where("archived_at is not null").join(ids.select("id"), "id", "left_semi")
    mine = gone.select(F.col("id").alias("material_id"))
    n = pages.join(mine, "material_id", "left_semi").groupBy(F.col("material_id").alias("id")).agg(F.count("*").alias("pages"))
    pointing = materials.join(gone.select(F.col("id").alias("duplicate_of_id")), "duplicate_of_id", "left_semi").groupBy(F.col("duplicate_of_id").alias("id")).agg(F.count("*").alias("pointing"))
    plan = gone.select("id", "title").join(n, "id", "left").join(pointing, "id", "left").fillna(0, ["pages", "pointing"])
    dead = gone.select(F.col("id").alias("duplicate_of_id"), F.lit(True).alias("_dead"))
    left = materials.join(gone.select("id"), "id", "left_anti").join(dead, "duplicate_of_id", "left").withColumn("duplicate_of_id", F.when(F.col("_dead"), None).otherwise(F.col("duplicate_of_id"))).select(*materials.columns)
    return plan, object_keys(gone, pages.join(mine, "material_id", "left_semi")), left


def missing_files(materials: DataFrame) -> DataFrame:
    return materials.where("r2_key_pdf is null")
