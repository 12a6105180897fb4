"""N-gram Jaccard join by T-occurrence search: short inverted lists merged by a heap, long ones probed by binary search
(DivideSkip), documents kept that reach the required overlap."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, mix, release, resident, runs_of_rows, settle, text_bytes, windows, words

NGRAM = 5
#: Shingles that one side of a search holds, unless a single document has more; a larger group is searched part by part.
PART_ITEMS = 60_000
#: Of a set's shingles so many in a hundred, beyond the first that a link must share, are looked at before whole sets are.
LEAD = 10
#: Ids of sets that pass are broadcast up to this number (32 MB), and joined by a shuffle of the texts beyond it.
BROADCAST_IDS = 4_000_000


def shingle_sets(b: np.ndarray, offsets: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct n-word shingle, A-Z lower-cased, sorted by row and hash; of a row with fewer words, all of them as one."""
    h, row, _, _ = words(b, offsets, lower=True)
    count = np.bincount(row, minlength=len(offsets) - 1)
    g = windows(h, n)
    inside = row[: len(g)] == row[n - 1 : n - 1 + len(g)] if len(g) else np.empty(0, bool)
    rows, hashes = [row[: len(g)][inside]], [g[inside]]
    first = np.concatenate([[0], np.cumsum(count)])
    for i in np.flatnonzero((count > 0) & (count < n)).tolist():
        part = h[first[i] : first[i + 1]]
        rows.append(np.array([i]))
        hashes.append(windows(part, len(part)) ^ np.uint64(len(part)))
    r, x = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((x, r))
    r, x = r[order], x[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
    return r[new], x[new]


def lead_length(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of the first shingles of a set of n, in one order for all sets, are looked at: two sets that link share at least
    lead_shared of theirs."""
    return np.minimum(n, n + percent * n // -100 + np.maximum(1, -(n * LEAD // -100)))


def lead_shared(n: str, percent: int) -> str:
    """The same least number as SQL, for a column n."""
    return f"greatest(1, ceil({LEAD} * ceil({percent} * {n} / 100) / 100))"


SETS = "doc_id long, n_shingles long, set_a long, set_b long, s array<long>"


def sets_of(docs: DataFrame, percent: int, whole: bool) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set (equal sets, equal hashes) and s: the set, or its lead, ascending by unsigned hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        for batch in batches:
            b, offsets = text_bytes(batch.column(1))
            ids = batch.column(0)
            for lo, hi in runs_of_rows(offsets):
                r, x = shingle_sets(b[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                n = np.bincount(r, minlength=hi - lo)
                a, c = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
                at = np.flatnonzero(n)
                if len(at):
                    heads = np.searchsorted(r, at)
                    a[at] = np.add.reduceat(mix(x), heads)
                    c[at] = np.add.reduceat(mix(x ^ np.uint64(0x9E3779B97F4A7C15)), heads)
                take = n
                if not whole:
                    take = lead_length(n, percent)
                    x = x[np.arange(len(x)) - (np.cumsum(n) - n)[r] < take[r]]
                ends = np.concatenate([[0], np.cumsum(take)])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.view(np.int64)))
                columns = [ids.slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_a", "set_b", "s"])

    return docs.mapInArrow(run, SETS)


def required(n: int, m: int, percent: int) -> int:
    """Least overlap of sets of n and m members whose Jaccard is percent / 100 or more."""
    return -(-percent * (n + m) // (100 + percent))


def t_occurrence(index: dict[int, list[int]], sizes: list[int], query: list[int], percent: int, skip, n: int | None = None) -> list[int]:
    """Indexed sets (by their number) that share with the query what their sizes require. n: the size of the query's set, where shingles
    that no other set has are left out of query.

    index: shingle to ascending set numbers. The longest lists, fewer than the least overlap, are set aside; the short ones are merged by a
    heap, which skips sets that cannot reach the overlap, and the rest of a candidate's count comes from binary probes of the long ones."""
    n = len(query) if n is None else n
    least = required(n, -(-percent * n // 100), percent)
    lists = sorted((index[s] for s in query if s in index), key=len)
    if len(lists) < least:
        return []
    n_long = min(least - 1, int(least / (0.02 * np.log2(len(lists[-1]) + 1) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    heap = [(x[0], k, 0) for k, x in enumerate(short)]
    heapq.heapify(heap)
    need, out = least - n_long, []
    while len(heap) >= need:
        who, count, popped = heap[0][0], 0, []
        while heap and heap[0][0] == who:
            _, k, i = heapq.heappop(heap)
            popped.append((k, i))
            count += 1
        if count >= need:
            if not skip(who):
                t = required(n, sizes[who], percent)
                for left, x in enumerate(long):
                    if count + len(long) - left < t or count >= t:
                        break
                    i = bisect_left(x, who)
                    count += i < len(x) and x[i] == who
                if count >= t:
                    out.append(who)
            for k, i in popped:
                if i + 1 < len(short[k]):
                    heapq.heappush(heap, (short[k][i + 1], k, i + 1))
            continue
        # fewer than needed: jump to the next set that can still be met need times
        while len(popped) < need - 1 and heap:
            _, k, i = heapq.heappop(heap)
            popped.append((k, i))
        if not heap:
            break
        goal = heap[0][0]
        for k, i in popped:
            j = bisect_left(short[k], goal, i)
            if j < len(short[k]):
                heapq.heappush(heap, (short[k][j], k, j))
    return out


class Sets:
    """Sets of one search: ids, sizes and, in place of shingles, their numbers among those met here."""

    def __init__(self, ids: list[int], sizes: list[int], labels: list[int], s: list[np.ndarray]):
        self.ids, self.sizes, self.labels, self.s = ids, sizes, labels, s

    def index(self) -> dict[int, list[int]]:
        found: dict[int, list[int]] = {}
        for k, s in enumerate(self.s):
            for x in s.tolist():
                found.setdefault(x, []).append(k)
        return found


def links_between(left: Sets, right: Sets | None, percent: int) -> list[tuple[int, int]]:
    """A forest of links among left (or between left and right): pairs (id, id), one for each union of two groups. Sets with
    one label are linked already; such pairs need no search."""
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out, index, asked = [], left.index(), left if right is None else right
    for q, s in enumerate(asked.s):
        mine = asked.labels[q]

        def skip(k):
            return (right is None and k >= q) or find(left.labels[k]) == find(mine)  # noqa: B023

        for k in t_occurrence(index, left.sizes, s.tolist(), percent, skip, asked.sizes[q]):
            a, b = find(mine), find(left.labels[k])
            if a != b:
                parent[a] = b
                out.append((asked.ids[q], left.ids[k]))
    return out


def _search(percent: int):
    """Over rows (group, lo, hi, side, node, label, n, s), sorted so that those of a (group, lo, hi) stand together: links between the
    rows of side 0 and those of side 1, or among those of side 0 where no other side is there."""

    def answer(rows: list[tuple]) -> pa.RecordBatch | None:
        codes = np.unique(np.concatenate([r[4] for r in rows]), return_inverse=True)[1]
        ends = np.cumsum([len(r[4]) for r in rows])
        sides: tuple[list, list] = ([], [])
        for r, e in zip(rows, ends.tolist()):
            sides[r[0]].append((r[1], r[3], r[2], codes[e - len(r[4]) : e]))
        left, right = (Sets(*map(list, zip(*x))) if x else None for x in sides)
        out = links_between(left, right, percent) if left else []
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out]), pa.array([y for _, y in out])], ["a", "b"]) if out else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            side, node, label, n = (batch.column(k).to_pylist() for k in range(3, 7))
            lists = batch.column(7)
            o, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for i, key in enumerate(keys):
                if key != at:
                    if rows and (found := answer(rows)) is not None:
                        yield found
                    at, rows = key, []
                rows.append((side[i], node[i], label[i], n[i], flat[o[i] : o[i + 1]].copy()))
        if rows and (found := answer(rows)) is not None:
            yield found

    return run


def _dealt(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Search rows (group, lo, hi, side, node, label), with the sets of their nodes: links (a, b)."""
    held = rows.join(sets.select("node", "n", "s"), "node").select("group", "lo", "hi", "side", "node", "label", "n", "s")
    return held.repartition("group", "lo", "hi").sortWithinPartitions("group", "lo", "hi").mapInArrow(_search(percent), "a long, b long")


def _links(sets: DataFrame, prefix: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what links connect. sets: node, n, s; prefix: node, shingle.

    A group is a node and those it is the least of for a prefix shingle: sets that link share such a shingle, so they meet in a group. In
    every group, whatever its size, the least node is searched for among the others, in parts; then, where that leaves a group with
    several labels, its nodes outside the label of the least are searched for among all of it, part by part. Parts hold PART_ITEMS
    shingles, so those with the label of the least, however many, go each to as many searches as the rest has parts."""
    least = settle(prefix.groupBy("shingle").agg(F.min("node").alias("group"), F.count("*").alias("n")).where("n > 1").select("shingle", "group"))
    member = settle(prefix.join(least, "shingle").where("node <> group").select("group", "node").distinct())
    items = sets.select("node", F.size("s").alias("items"))
    sized = member.join(items, "node")
    parts = settle(sized.groupBy("group").agg(F.ceil(F.sum("items") / PART_ITEMS).cast("int").alias("cut")))
    own = member.join(parts, "group").select("group", F.expr("cast(pmod(xxhash64(node), cut) as int)").alias("lo"), F.lit(0).alias("side"), "node")
    asked = parts.select("group", F.explode(F.expr("sequence(0, cut - 1)")).alias("lo"), F.lit(1).alias("side"), F.col("group").alias("node"))
    first = own.unionByName(asked).withColumn("hi", F.lit(0)).withColumn("label", F.col("node"))
    star = settle(_dealt(first, sets, percent))
    label = components(star).withColumnRenamed("root", "label")

    every = member.unionByName(parts.select("group", F.col("group").alias("node"))).join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    every = settle(every)
    open_ = every.groupBy("group").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("group")
    main = every.where("group = node").select("group", F.col("label").alias("main")).join(open_, "group")
    ours = every.join(main, "group").withColumn("rest", F.expr("label <> main"))
    cuts = ours.join(items, "node").groupBy("group").agg(*(F.ceil(F.sum(F.when(F.col("rest") == of, F.col("items")).otherwise(0)) / PART_ITEMS).cast("int").alias(name) for of, name in ((False, "m"), (True, "r"))))
    cuts = settle(cuts)
    placed = ours.join(cuts, "group").withColumn("at", F.expr("cast(pmod(xxhash64(node), if(rest, r, m)) as int)"))
    to = F.expr("""if(rest,
        concat(transform(sequence(0, m - 1), i -> struct(i as lo, -1 - at as hi, 1 as side)),
               transform(sequence(0, r - 1), j -> struct(least(at, j) as lo, greatest(at, j) as hi, if(at <= j, 0, 1) as side))),
        transform(sequence(0, r - 1), j -> struct(at as lo, -1 - j as hi, 0 as side)))""")
    second = placed.select("group", "node", "label", F.explode(to).alias("to")).select("group", "to.lo", "to.hi", "to.side", "node", "label")
    found = settle(star.unionByName(_dealt(second, sets, percent)))
    release(least, member, parts, star, every, cuts)
    return found


def near_duplicates(docs: DataFrame, percent: int = 75, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, rep): the size of each document's shingle set, the smallest id that links reach, and the
    smallest id with an equal set.

    Documents link when 100 * shared >= percent * union. Null and blank texts have empty sets and link with nothing. Rows that repeat an id are one
    document: each keeps its size, and what one links with counts for the id.

    1. Of each set its lead, the shingles with the smallest hashes, is counted over the corpus; sets that share too little of it with others leave,
    which most do, so whole sets move only for the rest. 2. Equal sets become one. 3. Shingles of whole sets are counted; a set of which less
    than percent occurs in another one leaves. 4. Of each survivor the rarest n - ceil(percent n) + 1 shingles are its prefix: sets that link
    share one. 5. Groups of prefix shingles are searched, DivideSkip (see _links). Counts are partial aggregates, joins leave hot shingles to be split.
    """
    own = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    leads = settle(sets_of(own, percent, whole=False).withColumn("row", F.monotonically_increasing_id()))
    sets = settle(leads.drop("s"))
    filled = sets.where("n_shingles > 0")
    # 48 bits of a hash will do here: two shingles that share them only let a set pass that leaves later
    lead = leads.select("row", F.explode("s").alias("s")).select("row", F.expr("s & 281474976710655").alias("shingle"))
    common = settle(lead.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").select("shingle"))
    seen = lead.join(common, "shingle").groupBy("row").agg(F.count("*").alias("shared"))
    alive = filled.join(seen, "row").where(f"shared >= {lead_shared('n_shingles', percent)}")
    alive = settle(alive.groupBy("set_a", "set_b").agg(F.min_by("row", F.struct("doc_id", "row")).alias("row"), F.min("doc_id").alias("doc_id")))
    release(leads, common)

    names = alive.select("doc_id").distinct()
    if alive.count() <= BROADCAST_IDS:
        names = F.broadcast(names)
    again = sets_of(own.join(names, "doc_id", "left_semi").select("doc_id", "text"), percent, whole=True)
    again = again.join(alive.select("doc_id", "set_a", "set_b"), ["doc_id", "set_a", "set_b"], "left_semi")
    if not filled.groupBy("doc_id").count().where("count > 1").isEmpty():  # rows that repeat an id with its text
        again = again.dropDuplicates(["set_a", "set_b"])
    whole = settle(again.select(F.monotonically_increasing_id().alias("node"), "set_a", "set_b", F.col("n_shingles").alias("n"), "s"))
    post = whole.select("node", F.explode("s").alias("shingle"))
    df = settle(post.groupBy("shingle").agg(F.count("*").cast("int").alias("df")).where("df > 1"))
    ranked = post.join(df, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("p")).join(whole.select("node", "n"), "node")
    ranked = settle(ranked.where(f"100 * size(p) >= {percent} * n"))
    release(df)
    prefix = ranked.select("node", F.explode(F.expr(f"slice(p, 1, size(p) - cast(ceil({percent} * n / 100) as int) + 1)")).alias("p")).select("node", F.col("p.shingle").alias("shingle"))
    links = _links(ranked.select("node", "n", F.col("p.shingle").alias("s")), prefix, percent)
    root = components(links)

    known = whole.select("node", "set_a", "set_b").join(root, "node").select("set_a", "set_b", "root")
    rep = filled.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")).join(known, ["set_a", "set_b"], "left")
    head = rep.where("root is not null").groupBy("root").agg(F.min("rep").alias("head"))
    rep = rep.join(head, "root", "left").select("set_a", "set_b", "rep", F.coalesce("head", "rep").alias("component_id"))
    out = settle(sets.select("doc_id", "n_shingles", "set_a", "set_b").join(rep, ["set_a", "set_b"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("rep", "doc_id").alias("rep")))
    release(sets, alive, whole, ranked, links)
    # an id with several sets joins what they belong to
    several = out.groupBy("doc_id").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b")).where("a < b").select("doc_id", "a")
    if several.isEmpty():
        return out
    ties = components(out.join(several, "doc_id").select("a", F.col("component_id").alias("b"))).select(F.col("node").alias("component_id"), "root")
    return out.join(ties, "component_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "component_id").alias("component_id"), "rep")
