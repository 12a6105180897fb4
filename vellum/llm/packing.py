"""Packing: shortest-pack-first over the length histogram."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resident, settle, text_bytes

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, part int, local_rank long"
#: Where a solid run ends and ASCII white space begins, and between letters or digits and ASCII punctuation, a token ends.
_RUNS = re.compile(r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
_FINE_RUNS = re.compile(r"[\t-\r ]*[^\t-\r !-/:-@\[-`{-~]+|[\t-\r ]*[!-/:-@\[-`{-~]+|[\t-\r ]+")
#: An apostrophe or a sign outside ASCII may join what stands beside it.
_JOINING = re.compile(r"[^\w\x00-\x1b\x20-\x26\x28-\x7f]")


def _other_space(text: str) -> bool:
    """Holds white space that is not ASCII's, or a control sign that only some libraries count as white space."""
    return any((c.isspace() or "\x1c" <= c <= "\x1f" or ord(c) in (0x180E, 0x200B, 0x2060, 0xFEFF)) for c in set(text) - set("\t\n\v\f\r "))


class ChunkEncoder:
    """Token ids of texts by a byte-level BPE tokenizer, with the ids of chunks seen before kept.

    A byte-level pre-tokenizer never joins a solid run with the white space after it, so ids of chunks put end to
    end are the ids of the text. Texts with other white space than ASCII go to the tokenizer whole.
    """

    def __init__(self, path: str, keep: int = 500_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.keep = keep

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        cut = _FINE_RUNS
        if _JOINING.search(text):
            if _other_space(text):
                return self._raw([text])[0]
            cut = _RUNS
        chunks, known = cut.findall(text), self.known
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            if len(known) > self.keep:
                known.clear()
            new = list({c for c in chunks if c not in known})
            known.update(zip(new, self._raw(new)))
            return b"".join([known.get(c) or self._raw([c])[0] for c in chunks])


def encoder(path: str) -> ChunkEncoder:
    """One for each Python worker, so that chunks stay known from task to task."""
    return resident(("chunks", path), lambda: ChunkEncoder(path))


def tokenize_pieces(docs: DataFrame, tokenizer: str, max_tokens: int = 1024, max_tail: int | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as token ids with id 0 at the end, cut into pieces of max_tokens and a tail.

    Null text counts as empty: one piece that holds id 0. The tail is cut again to max_tail where that is given.
    Rows with the same id are documents of their own. Columns: see PIECES; part and local_rank number the pieces of
    a length within the task that made them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(tokenizer).encode, TaskContext.get().partitionId(), {}
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            names = batch.column(0).to_pylist()
            for lo in range(0, len(names), 64):
                for name, t in zip(names[lo : lo + 64], batch.column(1).slice(lo, 64).to_pylist()):
                    ids = encode(t or "") + b"\0\0\0\0"
                    n = len(ids) // 4
                    cuts = list(range(0, n, max_tokens)) + [n]
                    if max_tail and cuts[-1] - cuts[-2] < max_tokens:
                        cuts[-2:] = [*range(cuts[-2], n, max_tail), n]
                    for a, b in zip(cuts, cuts[1:]):
                        rank = seen.get(b - a, 0)
                        seen[b - a] = rank + 1
                        rows.append((name, a, b - a, ids[4 * a : 4 * b], n, part, rank))
                        held += b - a
                if held > 2_000_000:
                    yield _pieces(rows)
                    rows, held = [], 0
            if rows:
                yield _pieces(rows)

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64())
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def plan_packs(histogram: dict[int, int], capacity: int = 1024) -> tuple[list[tuple[int, int, int, int, int]], int, int]:
    """Packing patterns for {length: count}: rows (length, rank_from, rank_to, first_sequence, offset), the number of
    sequences and the padding.

    Lengths go longest first into the pattern with most room; where the count of a pattern is larger than what is
    left to place, the pattern is split. Where none has room a pattern opens that holds as many copies of the length
    as fit. The work depends on the number of lengths, not of documents.
    """
    open_: list[tuple[int, int, int, tuple]] = []  # -room, tie, count, slots (length, rank_from)
    done: list[tuple[int, tuple]] = []
    ties = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left > 0:
            if open_ and -open_[0][0] >= length:
                room, _, count, slots = heapq.heappop(open_)
                took = min(left, count)
                if took < count:
                    ties += 1
                    heapq.heappush(open_, (room, ties, count - took, tuple((k, r + took) for k, r in slots)))
                slots = (*slots, (length, rank))
                left, rank, room = left - took, rank + took, -room - length
            else:
                copies = min(max(1, capacity // length), left)
                took = left // copies
                slots = tuple((length, rank + i * took) for i in range(copies))
                left, rank, room = left - took * copies, rank + took * copies, capacity - length * copies
            if room:
                ties += 1
                heapq.heappush(open_, (-room, ties, took, slots))
            else:
                done.append((took, slots))
    rows, sequence, padding = [], 0, 0
    for count, slots in [*done, *((c, s) for _, _, c, s in sorted(open_))]:
        offset = 0
        for length, rank in slots:
            rows.append((length, rank, rank + count, sequence, offset))
            offset += length
        sequence += count
        padding += 0 if offset & (offset - 1) == 0 else count * (capacity - offset)
    return rows, sequence, padding


def pack(pieces: DataFrame, max_tokens: int = 1024) -> tuple[DataFrame, float]:
    """Place pieces (length, part, local_rank and any other columns) in sequences: sequence_id and offset are added.

    Only the histogram, at most max_tokens rows, reaches the driver. A piece's rank within its length is its rank
    in the task that made it plus what earlier tasks made of that length. Returns the placed pieces and the share
    of padding. No pieces: no rows, no padding.
    """
    spark = pieces.sparkSession
    pieces = settle(pieces)
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, sequences, padding = plan_packs(histogram, max_tokens)
    plan = spark.createDataFrame(rows or [(1, 0, 0, 0, 0)], "length long, rank_from long, rank_to long, first_sequence long, offset long")
    before = counts.selectExpr("part", "length", "sum(n) over (partition by length order by part) - n as earlier")
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("earlier") + F.col("local_rank"))
    placed = ranked.join(F.broadcast(plan), ["length"]).where("rank >= rank_from and rank < rank_to")
    placed = placed.withColumn("sequence_id", F.expr("first_sequence + rank - rank_from"))
    return placed.drop("part", "local_rank", "rank", "earlier", "rank_from", "rank_to", "first_sequence"), padding / max(1, sequences * max_tokens)


def pack_documents(docs: DataFrame, tokenizer: str, max_tokens: int = 1024, most_padding: float = 0.02, id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """tokenize_pieces and pack. Where whole tails leave more padding than most_padding they are cut to an eighth of
    a sequence and packed again; texts are then tokenized a second time, which costs less than keeping all ids for that case.
    with_ids=False keeps a checksum of each piece's ids in their place."""
    for tail in (None, max_tokens // 8):
        made = tokenize_pieces(docs, tokenizer, max_tokens, tail, id, text).withColumn("ids_crc32", F.crc32("ids"))
        placed, padding = pack(made if with_ids else made.drop("ids"), max_tokens)
        if padding <= most_padding:
            break
    return placed


def sequences(placed: DataFrame, max_tokens: int = 1024, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids): the pieces of a sequence end to end, as little-endian unsigned 32-bit ids, padded to
    max_tokens unless their number is a power of two. A sequence is at most max_tokens long, so its rows stay few."""
    joined = placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))")
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (F.lit(max_tokens) - F.col("n_tokens")).cast("int")))
    whole = F.expr("bit_count(n_tokens) = 1")
    return joined.select("sequence_id", "n_tokens", F.when(whole, ids).otherwise(F.concat(ids, pad)).alias("ids"))
