"""Sources and sinks: sheets, folders, manifests, recognised lines, tables that are replaced or extended, exports."""

from __future__ import annotations

import csv
import re
import uuid
from collections.abc import Sequence
from io import StringIO
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.sources.scratch import settle

# Names that a column of a sheet goes by.
ALIASES = {
    "title": ("title", "name", "nametitle", "material", "materialtitle"),
    "topics": ("topicstags", "topics", "topic", "tags", "tag", "category", "categories", "topictag"),
    "url": ("drivelinkctrlclick", "drivelink", "googledrivelink", "link", "url", "drive", "file", "filelink"),
    "author": ("author", "writer", "by"),
    "summary": ("summary", "description", "about", "notes"),
}


def map_columns(header: Sequence[str | None], aliases: dict[str, Sequence[str]] = ALIASES) -> dict[str, int]:
    """Field to column position: the first column that goes by one of its names; case, blanks and punctuation do not matter."""
    plain = [re.sub("[^a-z0-9]", "", (h or "").lower()) for h in header]
    at = {field: next((i for i, h in enumerate(plain) if h in names), None) for field, names in aliases.items()}
    return {field: i for field, i in at.items() if i is not None}


def read_sheet(spark: SparkSession, path: str, aliases: dict[str, Sequence[str]] = ALIASES, most_lines: int = 5000) -> DataFrame:
    """(source_row, title, author, summary, url, topics): a CSV whose header, with a title and a link, is among its first ten rows.

    A sheet is one file with newlines in its cells, so one task reads it and its rows keep their order. The first ten rows lie within most_lines lines."""
    # cells may hold newlines, so the width is that of the first ten parsed rows, not of lines
    head = "\n".join(r["value"] for r in spark.read.text(path).limit(most_lines).collect())
    width = max((len(row) for row in islice(csv.reader(StringIO(head, newline="")), 10)), default=1)
    raw = spark.read.csv(path, schema=", ".join(f"_c{i} string" for i in range(max(width, 1))), header=False, multiLine=True, quote='"', escape='"')
    raw = raw.withColumn("source_row", F.monotonically_increasing_id())
    cells = [c for c in raw.columns if c != "source_row"]
    for r in raw.orderBy("source_row").limit(10).collect():
        at = map_columns([r[c] for c in cells], aliases)
        if "title" in at and "url" in at:
            clean = lambda f: F.regexp_replace(F.coalesce(F.col(cells[at[f]]), F.lit("")), "\r", "") if f in at else F.lit("")
            return raw.where(F.col("source_row") > r["source_row"]).select("source_row", *[clean(f).alias(f) for f in ("title", "author", "summary", "url", "topics")])
    raise ValueError("no header with a title and a link in the first ten rows")


def parse_sheet(sheet: DataFrame) -> DataFrame:
    """(row, title, author, summary, url, file_id, topics): rows with a title and a web link; row counts kept rows from 0. A sheet is small."""
    kept = sheet.where((F.trim("title") != "") & T.is_link(F.trim("url")))
    row = F.row_number().over(_in_order()) - 1
    return kept.select(row.alias("row"), F.trim("title").alias("title"), F.trim("author").alias("author"), F.trim("summary").alias("summary"), F.trim("url").alias("url"), T.file_id_from_url(F.col("url")).alias("file_id"), T.split_topics(F.col("topics")).alias("topics"))


def _in_order():
    from pyspark.sql import Window

    return Window.orderBy("source_row")


def load_tables(spark: SparkSession, directory: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{directory}/{n}.parquet") for n in names}


def load_jdbc(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, parts: int = 3) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts).load()


def scan_files(spark: SparkSession, directory: str, suffix: str = ".pdf", most_bytes: int = 80 << 20) -> DataFrame:
    """(path, modified, length, content, is_pdf) of the files of a folder and those below it; larger ones keep no content."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(directory)
    return df.select("path", F.col("modificationTime").alias("modified"), "length", F.when(F.col("length") <= most_bytes, F.col("content")).alias("content"), (F.substring("content", 1, 5) == F.lit("%PDF-").cast("binary")).alias("is_pdf"))


MANIFEST = "file_id string, name string, md5 string, size long, modified timestamp"


def read_manifest(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    return spark.read.schema(MANIFEST).format(kind).load(path)


LINES = "page_key string, text string, lines array<struct<text:string,confidence:double,x:double,y:double,width:double,height:double>>, broken string"


def read_line_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(page_key, boxes, broken) of JSON lines; a malformed line loses one page (broken holds it), missing lines fall back to text."""
    df = spark.read.schema(LINES).option("columnNameOfCorruptRecord", "broken").option("mode", "PERMISSIVE").json(path)
    n = F.size(F.filter(F.split("text", "\n"), lambda t: F.trim(t) != ""))
    plain = F.transform(F.filter(F.split("text", "\n"), lambda t: F.trim(t) != ""), lambda t, i: F.struct(t.alias("text"), F.lit(0.9).alias("confidence"), F.lit(0.0).alias("x"), (1 - (i + 1) / (n + 1)).alias("y"), F.lit(1.0).alias("width"), (F.lit(0.5) / (n + 1)).alias("height")))
    return df.select("page_key", F.coalesce("lines", plain).alias("boxes"), "broken")


WORD_TREE = "array<struct<width:double,height:double,blocks:array<struct<paragraphs:array<struct<words:array<struct<confidence:double,boundingBox:struct<vertices:array<struct<x:double,y:double>>>,symbols:array<struct<text:string>>>>>>>>>>"


def flatten_word_tree(df: DataFrame, json: str, key: str = "page_key") -> DataFrame:
    """A row for each paragraph of page - block - paragraph - word - symbol trees: text, confidence and box as shares of the page."""
    pages = df.select(F.col(key).alias("page_key"), F.explode(F.from_json(json, WORD_TREE)).alias("p"))
    paras = pages.select("page_key", "p.width", "p.height", F.explode("p.blocks").alias("b")).select("page_key", "width", "height", F.explode("b.paragraphs").alias("g")).select("page_key", F.col("width").alias("pw"), F.col("height").alias("ph"), F.col("g.words").alias("w"))
    points = F.flatten(F.transform("w", lambda x: x["boundingBox"]["vertices"]))
    span = lambda axis, f: f(F.transform(points, lambda v: F.coalesce(v[axis], F.lit(0.0))))
    sure = F.filter(F.transform("w", lambda x: x["confidence"]), lambda c: c > 0)
    mean = F.when(F.size(sure) > 0, F.aggregate(sure, F.lit(0.0), lambda a, c: a + c) / F.size(sure)).otherwise(0.9)
    text = F.array_join(F.transform("w", lambda x: F.array_join(F.transform(x["symbols"], lambda s: s["text"]), "")), " ")
    return paras.select("page_key", text.alias("text"), mean.alias("confidence"), (span("x", F.array_min) / F.col("pw")).alias("x"), (span("y", F.array_min) / F.col("ph")).alias("y"), ((span("x", F.array_max) - span("x", F.array_min)) / F.col("pw")).alias("width"), ((span("y", F.array_max) - span("y", F.array_min)) / F.col("ph")).alias("height"))


LINE_TREE = "struct<width:double,height:double,blocks:array<struct<paragraphs:array<struct<lines:array<struct<text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>>>>>>"


def flatten_line_tree(df: DataFrame, json: str, key: str = "page_key") -> DataFrame:
    """A row for each line of block - paragraph - line trees in pixels, as shares of the given size or of the furthest extent."""
    p = df.select(F.col(key).alias("page_key"), F.from_json(json, LINE_TREE).alias("p"))
    lines = F.flatten(F.flatten(F.transform("p.blocks", lambda b: F.transform(b["paragraphs"], lambda g: g["lines"]))))
    p = p.select("page_key", "p.width", "p.height", lines.alias("l"))
    far = lambda k: F.array_max(F.transform("l", lambda x: x["bbox"][k]))
    p = p.select("page_key", F.coalesce("width", far("x1")).alias("pw"), F.coalesce("height", far("y1")).alias("ph"), F.explode("l").alias("x"))
    return p.select("page_key", F.trim("x.text").alias("text"), (F.col("x.confidence") / 100).alias("confidence"), (F.col("x.bbox.x0") / F.col("pw")).alias("x"), (F.col("x.bbox.y0") / F.col("ph")).alias("y"), ((F.col("x.bbox.x1") - F.col("x.bbox.x0")) / F.col("pw")).alias("width"), ((F.col("x.bbox.y1") - F.col("x.bbox.y0")) / F.col("ph")).alias("height"))


def replace_children(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Children of the parents in incoming are replaced by theirs."""
    return existing.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def insert_ignore(existing: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows whose key is new are added, the first of each key."""
    struct = F.struct(*order, *[c for c in incoming.columns if c not in key and c not in order])
    fresh = incoming.groupBy(*key).agg(F.min_by(F.struct(*[c for c in incoming.columns if c not in key]), struct).alias("_r")).select(*key, "_r.*")
    return existing.unionByName(fresh.join(existing.select(*key), list(key), "left_anti").select(*existing.columns))


def upsert(existing: DataFrame, incoming: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Known rows take the columns of incoming, unknown ones are added."""
    new = incoming.select(*key, F.struct(*[c for c in incoming.columns if c not in key]).alias("_n"))
    both = existing.withColumn("_old", F.lit(True)).join(new, list(key), "full_outer")
    pick = lambda c: F.when(F.col("_n").isNull(), F.col(c)).when(F.col("_old").isNull() | F.lit(c in columns), F.col(f"_n.{c}")).otherwise(F.col(c)) if c in incoming.columns else F.col(c)
    return both.select(*[F.col(c) if c in key else pick(c).alias(c) for c in existing.columns])


def replace_stored(spark: SparkSession, path: str, incoming: DataFrame, key: str, buckets: int = 64) -> None:
    """replace_children on a Parquet table that stands: partitions are buckets of a hash of the key, and those of incoming's parents alone are read and written again (dynamic partition overwrite). What is written is
    settled first, so a lost writer leaves the table as it was, and a batch that comes again changes nothing."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
    fresh = settle(incoming.select("*", bucket))
    if _exists(spark, path):
        touched = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())  # numbers below buckets
        there = spark.read.parquet(path).where(F.col("bucket").isin(touched)).select(*fresh.columns)
        fresh = settle(replace_children(there, fresh, key))
    fresh.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame | None, int | None]:
    """The table that the last manifest under path names, and the batch that made it."""
    if not _exists(spark, f"{path}/manifest"):
        return None, None
    last = spark.read.schema("batch long, folder string").json(f"{path}/manifest").orderBy(F.desc("batch")).first()
    return (None, None) if last is None else (spark.read.parquet(last["folder"]), last["batch"])


def write_snapshot(spark: SparkSession, path: str, df: DataFrame, batch: int) -> None:
    """df as a new snapshot folder; readers see it from the moment its manifest is there. Folders of earlier snapshots stay for readers that began on them."""
    folder = f"{path}/snapshot-{batch}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    spark.createDataFrame([(batch, folder)], "batch long, folder string").coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").json(f"{path}/manifest/of={batch}")


def upsert_stored(spark: SparkSession, path: str, incoming: DataFrame, key: Sequence[str], columns: Sequence[str], batch: int) -> None:
    """upsert on a table kept as snapshots; batches are numbered upwards, and one that comes again changes nothing."""
    there, last = read_snapshot(spark, path)
    if last is not None and batch <= last:
        return
    write_snapshot(spark, path, incoming if there is None else upsert(there, incoming, key, columns), batch)


def export_url_index(materials: DataFrame, topics: DataFrame, static: DataFrame, base: str) -> DataFrame:
    """(url, last_modified): fixed pages (path), topics and published materials."""
    root = base.rstrip("/")
    s = static.select(F.concat(F.lit(root), "path").alias("url"), F.lit(None).cast("timestamp").alias("last_modified"))
    t = topics.where("merged_into_id is null").select(F.concat(F.lit(root + "/topics/"), "slug"), F.lit(None).cast("timestamp"))
    m = materials.where("status = 'published'").select(F.concat(F.lit(root + "/materials/"), "slug"), "updated_at")
    return s.union(t).union(m)


def object_keys(materials: DataFrame, pages: DataFrame, base: str = "") -> DataFrame:
    """(material_id, kind, key, url) of originals, pages and thumbnails; ids must be UUIDs and page numbers 1 or more."""
    uuid = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
    m = materials.where(F.lower("id").rlike(uuid)).select(F.col("id").alias("material_id"))
    p = pages.where(F.lower("material_id").rlike(uuid) & (F.col("page_number") >= 1))
    one = m.select("material_id", F.lit("original").alias("kind"), F.concat(F.lit("originals/"), "material_id", F.lit(".pdf")).alias("key"))
    many = p.select("material_id", F.lit("page"), F.format_string("pages/%s/%d.webp", "material_id", "page_number"))
    thumbs = m.select("material_id", F.lit("thumbnail"), F.concat(F.lit("thumbs/"), "material_id", F.lit(".webp")))
    return one.union(many).union(thumbs).withColumn("url", F.concat(F.lit(base.rstrip("/") + "/"), "key"))
