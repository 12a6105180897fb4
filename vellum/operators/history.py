"""The append-only audit log and what is read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.listing import latest_per_key, paginate, top_n_per_group, with_actor


def activity(audit: DataFrame, accounts: DataFrame, actor: str | None = None, action: str | None = None, entity: str | None = None, page: int = 1, size: int = 50):
    """A page of entries, newest first, and its totals."""
    for column, value in (("actor_id", actor), ("action", action), ("entity_type", entity)):
        if value is not None:
            audit = audit.where(F.col(column) == value)
    rows, about = paginate(audit, [F.desc("created_at"), "id"], page, size)
    return with_actor(rows, accounts), about


def last_changes(audit: DataFrame, accounts: DataFrame) -> DataFrame:
    return with_actor(latest_per_key(audit, "entity_id"), accounts)


def history(audit: DataFrame, ids: DataFrame, n: int = 20) -> DataFrame:
    ours = audit.join(ids.select(F.col(ids.columns[0]).alias("entity_id")), "entity_id", "left_semi")
    return top_n_per_group(ours, ["entity_id"], [F.desc("created_at"), "id"], n)


def why_archived(audit: DataFrame, materials: DataFrame) -> DataFrame:
    """(id, reason, actor_id, at, duplicate_of_id, original_live): the newest archive entry's reason, else the newest merge that archived it."""
    newest = lambda df, key: df.groupBy(key).agg(F.max_by(F.struct("after", "before", "actor_id", "created_at"), F.struct("created_at", "id")).alias("e"))
    reason = F.nullif(F.trim(F.get_json_object("e.after", "$.reason")), F.lit(""))
    own = newest(audit.where("action = 'material.archive'"), "entity_id").select(F.col("entity_id").alias("id"), reason.alias("r1"), F.col("e.actor_id").alias("a1"), F.col("e.created_at").alias("t1"))
    merges = audit.where("action = 'duplicate.merge'").withColumn("gone", F.get_json_object("after", "$.archivedId")).where("gone is not null")
    said = F.concat(F.lit("Merged into "), F.get_json_object("e.before", "$.kept"))
    merged = newest(merges, "gone").select(F.col("gone").alias("id"), F.coalesce(said, F.lit("Merged as a duplicate")).alias("r2"), F.col("e.actor_id").alias("a2"), F.col("e.created_at").alias("t2"))
    kept = materials.select(F.col("id").alias("duplicate_of_id"), F.col("archived_at").isNull().alias("original_live"))
    out = materials.where("archived_at is not null").select("id", "duplicate_of_id").join(own, "id", "left").join(merged, "id", "left").join(kept, "duplicate_of_id", "left")
    first = F.col("r1").isNotNull()
    return out.select("id", F.coalesce("r1", "r2").alias("reason"), F.when(first, F.col("a1")).otherwise(F.col("a2")).alias("actor_id"), F.when(first, F.col("t1")).otherwise(F.col("t2")).alias("at"), "duplicate_of_id", "original_live")


def string_field(json: Column, name: str) -> Column:
    """A field's value if it is a non-empty string; numbers and objects do not count."""
    v = F.try_parse_json(json)
    is_string = F.schema_of_variant(F.variant_get(v, f"$.{name}", "variant")) == "STRING"
    return F.when(is_string, F.nullif(F.try_variant_get(v, f"$.{name}", "string"), F.lit("")))


def changed_name(before: Column, after: Column) -> Column:
    return F.coalesce(*[string_field(after, k) for k in ("topic", "added", "removed", "mergedInto", "name", "email")], *[string_field(before, k) for k in ("topic", "had", "name", "email")])


# How each action reads.
PHRASES = {
    "category.create": "created the topic",
    "category.rename": "renamed a topic",
    "category.describe": "described a topic",
    "category.merge": "merged a topic into another",
    "category.unmerge": "reversed a topic merge",
    "category.delete": "deleted a topic",
    "material.create": "added",
    "material.publish": "published",
    "material.archive": "archived",
    "material.restore": "restored",
    "material.update": "edited",
    "material.categorise": "filed",
    "material.uncategorise": "unfiled",
    "material.text_visibility": "changed text visibility for",
    "material.destroy": "destroyed a material",
    "duplicate.dismiss": "marked a pair as not duplicates",
    "duplicate.merge": "resolved a duplicate pair",
    "invitation.create": "invited someone",
    "invitation.revoke": "withdrew an invitation",
    "invitation.accept": "accepted an invitation",
    "user.role_change": "changed someone's role",
    "user.disable": "suspended an account",
    "user.enable": "restored an account",
    "user.delete": "deleted an account",
    "sync.run": "ran a Drive sync",
    "sync.clear": "cleared a sync that never finished",
}
# What stands before the name, where the payload has one.
LEADS = {"material.uncategorise": "Removed from ", "category.create": "Created the topic ", "category.merge": "Merged into ", "category.unmerge": "Reversed the merge into "}


def describe_change(audit: DataFrame, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Add phrase (the action's own, else its words) and sentence, which names what was changed where before or after tell it. Old filing entries
    tell by their payload whether they removed. before is optional."""
    before = F.col("before") if "before" in audit.columns else F.lit(None).cast("string")
    table = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])[F.col("action")]
    phrase = F.coalesce(table(phrases), F.regexp_replace("action", "[._]", " "))
    capital = F.concat(F.upper(F.substring(phrase, 1, 1)), F.expr("substring(phrase, 2)"))
    name = changed_name(before, F.col("after"))
    removed = F.schema_of_variant(F.variant_get(F.try_parse_json("after"), "$.removed", "variant")).eqNullSafe("STRING") | F.schema_of_variant(F.variant_get(F.try_parse_json(before), "$.had", "variant")).eqNullSafe("STRING")
    filed = F.when(F.col("action") == "material.categorise", F.when(removed, "Removed from ").otherwise("Added to "))
    lead = F.coalesce(filed, table(LEADS), F.concat(capital, F.lit(" ")))
    return audit.withColumn("phrase", phrase).withColumn("sentence", F.when(name.isNull(), capital).otherwise(F.concat(lead, name)))


def sync_history(runs: DataFrame, accounts: DataFrame, n: int = 10) -> DataFrame:
    """Newest runs; a detail that is no JSON array is an empty one."""
    named = runs.join(accounts.select(F.col("id").alias("started_by"), F.col("name").alias("starter")), "started_by", "left")
    is_list = F.coalesce(F.ltrim("detail").startswith("["), F.lit(False))
    detail = F.coalesce(F.when(is_list, F.from_json("detail", "array<struct<name:string,result:string,why:string>>")), F.array())
    return named.withColumn("detail", detail).orderBy(F.desc("started_at"), "id").limit(n)


def open_runs(runs: DataFrame) -> DataFrame:
    return runs.where("finished_at is null")


def pending_invitations(invitations: DataFrame, accounts: DataFrame, now: Column) -> DataFrame:
    still = invitations.where(F.col("accepted_at").isNull() & F.col("revoked_at").isNull() & (F.col("expires_at") > now))
    return still.join(accounts.select(F.col("id").alias("invited_by"), F.col("name").alias("inviter")), "invited_by", "left").orderBy(F.desc("created_at"), "id")


def derive_audit(before: DataFrame, after: DataFrame, key: str, action: str = "change") -> DataFrame:
    """(entity_id, action, before, after) for rows that differ; before and after hold the changed columns as JSON."""
    columns = [c for c in before.columns if c != key]
    both = before.select(F.col(key), F.struct(*columns).alias("x")).join(after.select(F.col(key), F.struct(*columns).alias("y")), key, "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))
    part = lambda s: F.to_json(F.struct(*[F.when(~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) | F.col("x").isNull() | F.col("y").isNull(), F.col(f"{s}.{c}")).alias(c) for c in columns]))
    kind = F.when(F.col("x").isNull(), f"{action}.create").when(F.col("y").isNull(), f"{action}.delete").otherwise(f"{action}.edit")
    return both.select(F.col(key).cast("string").alias("entity_id"), kind.alias("action"), F.when(F.col("x").isNotNull(), part("x")).alias("before"), F.when(F.col("y").isNotNull(), part("y")).alias("after"))


def validate(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, id): rows that break an integrity rule of the tables given (materials, pages, filings, pairs, invitations)."""
    out: list[DataFrame] = []
    twice = lambda df, by, rule: df.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), F.concat_ws("|", *[F.col(c).cast("string") for c in by]).alias("id"))
    if (m := tables.get("materials")) is not None:
        alive = m.where("archived_at is null")
        out.append(twice(alive, ["slug"], "live slug is unique"))
        if "sha256" in m.columns:
            out.append(twice(alive.where("sha256 is not null"), ["sha256"], "live sha256 is unique"))
        if "drive_file_id" in m.columns:
            out.append(twice(m.where("drive_file_id is not null"), ["drive_file_id"], "drive file is unique"))
        out.append(m.where(~F.col("status").isin("staged", "processing", "review", "published", "archived", "rejected") | (F.trim("author") == "")).select(F.lit("status and author are known values").alias("rule"), F.col("id").cast("string").alias("id")))
    if (p := tables.get("pages")) is not None:
        out.append(twice(p, ["material_id", "page_number"], "one row a page"))
    if (f := tables.get("filings")) is not None:
        out.append(twice(f, ["material_id", "category_id"], "one filing a topic"))
    if (d := tables.get("pairs")) is not None:
        out += [twice(d, ["a", "b"], "a pair once"), d.where("a >= b").select(F.lit("a pair in order").alias("rule"), F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string")).alias("id"))]
    if (i := tables.get("invitations")) is not None:
        out.append(twice(i.where("accepted_at is null and revoked_at is null"), ["email"], "one open invitation"))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found
