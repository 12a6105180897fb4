"""Incremental work: reconciling a listing, ingesting files as they come, and counting activity by event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import duplicates, lifecycle, vectors
from vellum.operators.listing import lookup_known


def reconcile_listing(manifest: DataFrame, materials: DataFrame, limit: int | None = None, most_bytes: int = 80 << 20) -> DataFrame:
    """manifest (file_id, name, md5, size, modified) with result and why: skipped, flagged, failed or imported; limit holds for new files."""
    m = lookup_known(manifest, materials)
    known = F.col("material_id").isNotNull()
    result = F.when(known & F.col("archived_at").isNotNull(), "skipped").when(known & (F.col("md5") != F.col("drive_md5")), "flagged").when(known, "skipped").when(F.col("size") > most_bytes, "failed").otherwise("imported")
    why = F.when(known & F.col("archived_at").isNotNull(), "archived, not brought back").when(result == "flagged", "the file changed").when(known, "already here").when(result == "failed", "too large")
    out = m.withColumn("result", result).withColumn("why", why).select(*manifest.columns, "material_id", "result", "why")
    if limit is None:
        return out
    new = out.where("material_id is null").orderBy("file_id").limit(limit)
    return out.where("material_id is not null").unionByName(new)


def ingest_stream(spark: SparkSession, directory: str, checkpoint: str, handle: Callable[[DataFrame, int], None], suffix: str = ".pdf"):
    """A stream over the files of a folder; each batch of files goes once to handle(files, batch_id), which is to write keyed by the
    batch id, so that a replay changes nothing. Stops when what is there is read."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", f"*{suffix}").load(directory)
    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder for each batch, overwritten by a replay."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def file_title(path: Column) -> Column:
    return T.title_from_filename(F.element_at(F.split(path, "/"), -1))


def enrich(archive: Callable[[], tuple[DataFrame, DataFrame]], out: str, now: Column, read_text: Callable[[Column], Column], title: Callable[[Column], Column] = file_title, embedder=vectors.hashed_vectors) -> Callable[[DataFrame, int], None]:
    """A handler for ingest_stream: new files are fingerprinted and accepted or refused, their text is cut and embedded, and what is accepted is
    compared with the whole archive and with what earlier batches accepted.

    archive: gives (materials: id, title, slug, sha256, archived_at; texts: id, text). Written below out, a folder a batch: materials, pages,
    chunks, findings (pairs, to be reconciled with the ledger). Earlier batches are read back without the one at hand, so a replay changes nothing.
    """
    card = ("id", "title", "slug", "sha256", "archived_at")

    def handle(files: DataFrame, batch_id: int) -> None:
        spark = files.sparkSession
        there, texts = archive()
        for name in ("materials", "pages"):
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/{name}")
            if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
                continue
            before = spark.read.parquet(f"{out}/{name}").where(F.col("batch") != batch_id)
            if name == "materials":
                there = there.select(*card).unionByName(before.where("status = 'review'").select("id", "title", "slug", "sha256", F.lit(None).cast("timestamp").alias("archived_at")))
            else:
                texts = texts.select("id", "text").unionByName(before.where("text is not null").select(F.col("material_id").alias("id"), "text"))
        new = duplicates.settle(files.select(F.md5(F.col("path")).alias("id"), title(F.col("path")).alias("title"), F.lit("staged").alias("status"), "content"))
        read = new.select(F.col("id").alias("material_id"), F.lit(1).alias("page_number"), read_text(F.col("content")).alias("text"))
        done, kept, _ = lifecycle.ingest(new.drop("content"), new.select("id", "content"), there, read, now)
        done, kept = duplicates.settle(done), duplicates.settle(kept)
        write_batch(done, f"{out}/materials", batch_id)
        write_batch(kept, f"{out}/pages", batch_id)
        write_batch(vectors.embed_corpus(kept.select("material_id", "page_number", "text"), embedder), f"{out}/chunks", batch_id)
        ours = done.where("status = 'review'")
        none = F.lit(None).cast("string")
        cards = there.where("archived_at is null").select("id", "title", "sha256").unionByName(ours.select("id", "title", "sha256")).select("id", "title", "sha256", none.alias("md5"), F.lit(None).cast("int").alias("page_count"))
        every = texts.select("id", "text").unionByName(kept.where("text is not null").select(F.col("material_id").alias("id"), "text"))
        write_batch(duplicates.scan(cards, every, new_ids=ours.select("id")), f"{out}/findings", batch_id)

    return handle


def activity_windows(events: DataFrame, late: str = "1 hour", window: str = "1 hour", ts: str = "ts", actor: str = "user_id", action: str = "event_type") -> DataFrame:
    """(window_start, actor, action, n): activity by event time, for a stream or a table; rows later than `late` are dropped by the stream."""
    by = events.withWatermark(ts, late) if events.isStreaming else events
    return by.groupBy(F.window(ts, window).alias("w"), F.col(actor).alias("actor"), F.col(action).alias("action")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "actor", "action", "n")


def activity_stream(spark: SparkSession, directory: str, schema, out: str, checkpoint: str):
    """activity_windows over a folder of Parquet files, in complete windows, to a Parquet table."""
    events = spark.readStream.schema(schema).parquet(directory)
    return activity_windows(events).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", out).start()


SPANS = "key string, started timestamp, ended timestamp, outcome string"


def work_spans(events: DataFrame, begins: tuple[str, ...], limit: str = "1 hour", late: str = "10 minutes", ts: str = "ts", key: str = "material_id", status: str = "status") -> DataFrame:
    """(key, started, ended, outcome) of a stream of status changes: work begins with a status in begins and is done with the next that is not; work that nothing ends within `limit` of its
    start is stuck. Event time alone decides, so the rows do not depend on when files come.

    One state a key: the open start and the events whose time the watermark has not passed, which are taken in order of time once it has."""
    span = int(pd.Timedelta(limit).total_seconds() * 1e6)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        open_at, waiting = state.get if state.exists else (None, [])
        waiting = [tuple(w) for w in waiting]
        for p in parts:
            waiting += list(zip((int(v.value // 1000) for v in p["ts"]), (bool(b) for b in p["begins"])))
        passed = state.getCurrentWatermarkMs() * 1000
        ready, waiting = sorted(w for w in waiting if w[0] <= passed), [w for w in waiting if w[0] > passed]
        out = []
        for at, begin in ready:
            if open_at is not None and at - open_at > span:
                out.append((k[0], open_at, open_at + span, "stuck"))
                open_at = None
            if begin and open_at is None:
                open_at = at
            elif not begin and open_at is not None:
                out.append((k[0], open_at, at, "done"))
                open_at = None
        if open_at is not None and open_at + span < passed:
            out.append((k[0], open_at, open_at + span, "stuck"))
            open_at = None
        if open_at is None and not waiting:
            state.remove()
        else:
            state.update((open_at, waiting))
            due = min([w[0] for w in waiting] + ([open_at + span] if open_at is not None else []))
            state.setTimeoutTimestamp(max(due // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            frame = pd.DataFrame(out, columns=["key", "started", "ended", "outcome"])
            yield frame.assign(started=pd.to_datetime(frame.started, unit="us"), ended=pd.to_datetime(frame.ended, unit="us"))

    each = events.select(F.col(ts).alias("ts"), F.col(key).cast("string").alias("key"), F.col(status).isin(*begins).alias("begins")).withWatermark("ts", late)
    return each.groupBy("key").applyInPandasWithState(step, SPANS, "open_at long, waiting array<struct<at:long,begins:boolean>>", "append", "EventTimeTimeout")


def in_flight_stream(spark: SparkSession, directory: str, schema, out: str, checkpoint: str, begins: tuple[str, ...], files: int = 1, **of):
    """work_spans over a folder of Parquet files, `files` of them a batch, to a Parquet table."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(directory)
    return work_spans(events, begins, **of).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", out).start()


def in_flight(spans: DataFrame, at: Column) -> DataFrame:
    """(n): work in flight at a time, of spans that began by then and had not ended."""
    return spans.where((F.col("started") <= at) & (F.col("ended") > at)).agg(F.count("*").alias("n"))
