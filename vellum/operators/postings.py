"""Stored postings: a table by term bucket that a batch of queries reads its own buckets of, and that takes new documents as segments."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.search import bm25, match_phrase, match_terms, postings_of, query_terms, word_arrays
from vellum.sources.scratch import settle


class PostingsTable:
    """Postings under a path, in two Parquet tables.

    postings/write=/bucket=: (term, id, tf, positions) by a hash of the term. documents/segment=: (id, doc_len, write), doc_len null where the document is taken out. A document is what its latest segment says, with the postings of
    the write that this names, so adding documents replaces theirs and touches nothing else. A segment's documents are written last: what a lost writer left is not seen. Writing a segment again replaces it; sweep drops what
    nothing names any more."""

    def __init__(self, spark: SparkSession, path: str, stem: bool = True, buckets: int = 64):
        self.spark, self.path, self.stem, self.buckets = spark, path.rstrip("/"), stem, buckets

    def _bucket(self, term: str = "term"):
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int").alias("bucket")

    def add(self, docs: DataFrame, segment: int, id: str = "id", text: str = "text") -> None:
        """Documents (id, text) as a segment; a null text takes the document out. segment: a number above those before, or one of them, which is then replaced."""
        words = settle(word_arrays(docs, id, text))
        post = postings_of(words, self.stem)
        write = f"w{uuid.uuid4().hex}"
        post = post.select("term", "id", "positions", self._bucket()).hint("rebalance", "bucket")
        post = post.withColumn("tf", F.size("positions").cast("long")).withColumn("write", F.lit(write))  # what a row says of itself does not move
        post.write.mode("append").option("compression", "zstd").partitionBy("write", "bucket").parquet(f"{self.path}/postings")
        lengths = docs.select(F.col(id).alias("id"), F.col(text).isNull().alias("gone")).join(words.select("id", "doc_len"), "id", "left")
        lengths = lengths.select("id", F.when(~F.col("gone"), F.coalesce("doc_len", F.lit(0))).alias("doc_len"), F.lit(write).alias("write"), F.lit(segment).alias("segment"))
        # of a table that stands this segment alone is replaced
        lengths.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("segment").parquet(f"{self.path}/documents")

    def sweep(self) -> int:
        """Delete the postings of writes that no segment names, and say how many there were. Not while another adds."""
        named = {r["write"] for r in self.spark.read.parquet(f"{self.path}/documents").select("write").distinct().collect()}  # one a segment
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/postings")
        store, gone = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), 0
        for f in store.listStatus(where):
            name = f.getPath().getName()
            if name.startswith("write=") and name.removeprefix("write=") not in named:
                gone += store.delete(f.getPath(), True)
        return gone

    def documents(self) -> DataFrame:
        """(id, write, doc_len): each document by its latest segment, without those taken out and those without words."""
        d = self.spark.read.parquet(f"{self.path}/documents")
        last = d.groupBy("id").agg(F.max(F.struct("segment", "doc_len", "write")).alias("d"))
        return last.select("id", "d.write", "d.doc_len").where("doc_len > 0")

    def of_terms(self, terms: DataFrame) -> DataFrame:
        """Postings (id, term, tf, positions, doc_len) of the terms (term), read from their buckets alone; at most `buckets` numbers come to the driver for that."""
        wanted = terms.select("term").distinct()
        some = sorted(r["bucket"] for r in wanted.select(self._bucket()).distinct().collect())
        post = self.spark.read.parquet(f"{self.path}/postings").where(F.col("bucket").isin(some)).join(wanted, "term", "left_semi")
        return post.join(self.documents(), ["id", "write"]).select("id", "term", "tf", "positions", "doc_len")

    def search(self, queries: DataFrame) -> DataFrame:
        """(query_id, id, rank) by BM25 of the documents that match queries (query_id, must[, any, not, phrase]): all of must, one of any if given, none of not, the words of phrase in a row."""
        has = [c for c in ("must", "any", "not") if c in queries.columns]
        terms = query_terms(queries, has[0], self.stem)
        for c in has[1:]:
            terms = terms.unionByName(query_terms(queries, c, self.stem))
        if "phrase" in queries.columns:
            terms = terms.unionByName(query_terms(queries.select("query_id", F.array("phrase").alias("p")), "p", self.stem))
        post = settle(self.of_terms(terms))  # what the queries ask for, read by every step
        met = match_terms(queries, post, self.stem)
        if "phrase" in queries.columns:
            phrased = queries.where(F.length(F.trim("phrase")) > 0)
            rest = queries.where(~(F.coalesce(F.length(F.trim("phrase")), F.lit(0)) > 0)).select("query_id")
            held = match_phrase(phrased, post, self.stem)
            met = met.join(held, ["query_id", "id"], "left_semi").unionByName(met.join(rest, "query_id", "left_semi"))
        return bm25(met, post, self.documents())
