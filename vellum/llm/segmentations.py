"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k without replacement.

A text's segmentations form a lattice over the model's pieces. Each segmentation's log probability gets Gumbel noise;
the k largest are a sample without replacement. They are found best first, without listing segmentations: the
noise of a set of segmentations has a Gumbel maximum located at the log of the set's mass, which backward sums over the lattice
give exactly, so a queue of disjoint sets ordered by their maxima is an A-star search with exact bounds. A popped set
yields its best segmentation, drawn arc by arc, and is split into the sets that leave that one at the first unit that differs.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import MIX_1, MIX_2, mix, resident

#: No piece holds a blank after another sign, so units never share a piece.
UNIT = re.compile("▁*[^▁]+|▁+")
PASS_CHARS, BLOCK = 1_000_000, 24
#: Arcs that a worker keeps from pass to pass, beyond those of the pass at hand.
KEPT_ARCS = 4_000_000


class Pieces:
    """The pieces of a model as a trie over code points, with weights (rank + 2) ** -1 for a piece of that merge rank, and what each decodes to."""

    def __init__(self, path: str):
        import sentencepiece

        self.kept: Kept | None = None
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        usable = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        self.weight = np.zeros(n)
        self.weight[usable] = [1 / (max(0.0, -m.get_score(i)) + 2) for i in usable]
        self.byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_array, self.byte_weight = np.array(self.byte_ids), 1 / (n + 2)
        self.weight[self.byte_array] = self.byte_weight
        self.log_weight = np.log(np.maximum(self.weight, 1e-300))
        self.spelt = np.array([bytes([self.byte_ids.index(i)]) if m.is_byte(i) else b"" if m.is_control(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(n)], object)
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for i in usable:
            at = 0
            for c in m.id_to_piece(i):
                at = nodes.setdefault((at, ord(c)), len(nodes) + 1)
            ends[at] = i
        keys = np.array([s << 21 | c for s, c in nodes], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(nodes.values()), np.int64)[order]
        self.ends = np.full(len(nodes) + 1, -1, np.int64)
        self.ends[list(ends)] = list(ends.values())
        self.longest = max(len(m.id_to_piece(i)) for i in usable)
        self.first = np.full(1 << 16, -1, np.int64)  # the first step, by code point
        for (s, c), t in nodes.items():
            if s == 0 and c < 1 << 16:
                self.first[c] = t


class _Numbers(dict):
    """Numbers in the order of first sight."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def units_of(text: str) -> list[str]:
    """The units of a normalized text, each without the one blank before it; units with more blanks are told by those."""
    if "▁▁" not in text and text[:1] == "▁" and text[-1:] != "▁":
        return text[1:].split("▁")
    return [u[1:] if u[0] == "▁" else "\0" + u for u in UNIT.findall(text)]


class Kept:
    """Units met so far with their lattice. When it has grown beyond KEPT_ARCS, units met once since the last time leave."""

    def __init__(self, p: Pieces):
        self.p, self.known, self.lattice, self.hits = p, _Numbers(), Lattice(p, []), np.zeros(0, np.int64)

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The units of each text, by their numbers in the lattice."""
        if len(self.lattice.ids) > KEPT_ARCS:
            stay = np.flatnonzero(self.hits > 1)
            names = list(self.known)
            self.known = _Numbers(zip([names[i] for i in stay.tolist()], range(len(stay))))
            self.hits = self.hits[stay] // 2
            self.lattice.keep(stay)
        had = len(self.known)
        found = [np.fromiter(map(self.known.__getitem__, units_of(t)), np.int64) for t in self.p.model.normalize(texts)] if texts else []
        fresh = [u[1:] if u[:1] == "\0" else "▁" + u for u in itertools.islice(self.known, had, None)]
        if fresh:
            self.lattice.add(Lattice(self.p, fresh))
        hits = np.bincount(np.concatenate(found), minlength=len(self.known)) if found else np.zeros(len(self.known), np.int64)
        hits[:had] += self.hits
        self.hits = hits
        return found


def pieces(path: str) -> Pieces:
    return resident(("pieces", path), lambda: Pieces(path))


def kept(p: Pieces) -> Kept:
    if p.kept is None:
        p.kept = Kept(p)
    return p.kept


#: An arc: the probability, given its first sign, of it and those before it, its own, that of all others, and its signs (0: it ends its unit).
ARC = np.dtype([("upto", "f8"), ("prob", "f8"), ("other", "f8"), ("size", "i8")])


class Lattice:
    """Arcs of many units at once, by their first sign, with the probability of each given its start."""

    def __init__(self, p: Pieces, units: list[str]):
        text = "".join(units)
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lens = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(lens)
        self.start = ends - lens
        dist = np.repeat(ends, lens) - np.arange(len(c))
        src, size, ids = [], [], []
        at = np.arange(len(c))
        state = np.where(c < 1 << 16, p.first[np.minimum(c, 0xFFFF)], -1)
        single = np.zeros(len(c), bool)
        for n in range(1, p.longest + 1):
            if n > 1:
                live = dist[at] >= n
                at, state = at[live], state[live]
                key = state << 21 | c[at + n - 1]
                j = np.minimum(np.searchsorted(p.keys, key), len(p.keys) - 1)
                state = np.where(p.keys[j] == key, p.to[j], -1)
            live = state >= 0
            at, state = at[live], state[live]
            if not len(at):
                break
            found = p.ends[state]
            hit = found >= 0
            src.append(at[hit])
            size.append(np.full(int(hit.sum()), n))
            ids.append(found[hit])
            if n == 1:
                single[at[hit]] = True
        bare = np.flatnonzero(~single)  # a sign without a piece is spelt in bytes
        src.append(bare)
        size.append(np.ones(len(bare), np.int64))
        ids.append(np.where(c[bare] < 128, p.byte_array[c[bare] & 127], -1 - c[bare]))
        src, size, ids = map(np.concatenate, (src, size, ids))
        n_bytes = 2 + (-1 - ids >= 0x800) + (-1 - ids >= 0x10000)
        w = np.where(ids >= 0, p.log_weight[np.maximum(ids, 0)], np.log(p.byte_weight) * n_bytes)
        order = np.argsort((dist[src] * len(c) + src) * (p.longest + 1) + size)  # by distance to the unit's end, then by sign
        src, size, ids, w = src[order], size[order], ids[order], w[order]
        beta = np.zeros(len(c) + 1)  # log of the mass of what begins at a sign, within its unit
        heads = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]])) if len(src) else np.empty(0, np.int64)
        last = dist[src] == size  # the arc ends its unit
        level = np.searchsorted(dist[src], np.arange(1, int(dist.max(initial=0)) + 2))
        bounds = np.searchsorted(heads, level)
        many = np.diff(np.append(heads, len(src)))
        prob = np.empty(len(src))
        for lo, hi, h_lo, h_hi in zip(level[:-1].tolist(), level[1:].tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            mass = w[lo:hi] + np.where(last[lo:hi], 0.0, beta[src[lo:hi] + size[lo:hi]])
            h, n = heads[h_lo:h_hi] - lo, many[h_lo:h_hi]
            top = np.maximum.reduceat(mass, h)
            share = np.exp(mass - np.repeat(top, n))
            total = np.add.reduceat(share, h)
            beta[src[h + lo]] = top + np.log(total)
            prob[lo:hi] = share / np.repeat(total, n)
        self.ids = ids.astype(np.int32)
        # sums over the arcs before and after an arc at its sign; only what is there is added, so small sums are exact
        before, after = np.zeros(len(src)), np.zeros(len(src))
        for k in range(1, int(many.max(initial=0))):
            at = heads[many > k] + k
            before[at] = before[at - 1] + prob[at - 1]
            at = heads[many > k] + many[many > k] - 1 - k
            after[at] = after[at + 1] + prob[at + 1]
        self.arcs = np.empty(len(src), ARC)
        self.arcs["upto"], self.arcs["prob"], self.arcs["other"] = before + prob, prob, before + after
        self.arcs["upto"][heads + many - 1] = 2.0  # the last arc takes what is left
        self.arcs["size"] = np.where(last, 0, size)
        self.head, self.many = np.full(len(c), -1, np.int64), np.zeros(len(c), np.int32)
        self.head[src[heads]], self.many[src[heads]] = heads, many

    def add(self, more: Lattice) -> None:
        """Put the units of another lattice after these. Arrays have room to grow, so that what is there is seldom copied."""
        more.start = more.start + len(self.head)
        more.head = more.head + np.where(more.head >= 0, len(self.ids), 0)
        for name in ("start", "ids", "arcs", "head", "many"):
            mine, new = getattr(self, name), getattr(more, name)
            room = mine if mine.base is None else mine.base
            n = len(mine) + len(new)
            if len(room) < n:
                room = np.empty(2 * n, mine.dtype)
                room[: len(mine)] = mine
            room[len(mine) : n] = new
            setattr(self, name, room[:n])

    def keep(self, units: np.ndarray) -> None:
        """Leave only the units named, ascending, in the room that is there."""
        ends = np.append(self.start[1:], len(self.head))
        lens = (ends - self.start)[units]
        begin = np.cumsum(lens) - lens
        at = np.repeat(self.start[units] - begin, lens) + np.arange(int(lens.sum()))
        many = self.many[at].astype(np.int64)
        head = np.cumsum(many) - many
        arcs = np.repeat(self.head[at] - head, many) + np.arange(int(many.sum()))
        for name, new in (("start", begin), ("ids", self.ids[arcs]), ("arcs", self.arcs[arcs]), ("head", head), ("many", many)):
            mine = getattr(self, name)
            room = mine if mine.base is None else mine.base
            room[: len(new)] = new
            setattr(self, name, room[: len(new)])

    def draw(self, unit: np.ndarray, uniform) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A segmentation for each unit: number of arcs, arcs end to end, log probability. uniform(step, rows) gives numbers in [0, 1)."""
        n = len(unit)
        count, probs, rests = np.ones(n, np.int64), np.empty(n), np.empty(n)
        rows, at, steps = np.arange(n), self.start[unit], []
        prob, rest = np.ones(n), np.zeros(n)
        while len(rows):
            u = uniform(len(steps), rows)
            arc = self.head.take(at)
            t = self.arcs.take(arc)
            more = np.flatnonzero(t["upto"] <= u)
            while len(more):
                arc[more] += 1
                t[more] = fresh = self.arcs.take(arc[more])
                more = more[fresh["upto"] <= u[more]]
            steps.append((rows, arc))
            rest += prob * t["other"]
            prob *= t["prob"]
            size = t["size"]
            end, go = np.flatnonzero(size == 0), np.flatnonzero(size)
            done = rows[end]
            count[done], probs[done], rests[done] = len(steps), prob[end], rest[end]
            rows, at, prob, rest = rows[go], at[go] + size[go], prob[go], rest[go]
        first = np.cumsum(count) - count
        arcs = np.empty(int(count.sum()), np.int64)
        for k, (r, a) in enumerate(steps):
            arcs[first[r] + k] = a
        log = np.log1p(-np.minimum(rests, 0.5))
        far = np.flatnonzero(rests > 0.5)
        log[far] = np.log(np.maximum(probs[far], 1e-300))
        for i in far[probs[far] < 1e-290].tolist():
            log[i] = np.log(self.arcs["prob"][arcs[first[i] : first[i] + count[i]]]).sum()
        return count, arcs, log

    def without(self, unit: int, out: tuple[tuple[int, ...], ...], uniform) -> tuple[tuple[int, ...], float, float]:
        """A segmentation of the unit that is not in out (arc tuples), its log probability, and the mass of all that are in neither.

        Masses are sums over the arcs that leave the paths of out, so none is a difference. uniform() gives numbers in [0, 1)."""
        steps, masses = self._left(unit, out)
        node, path, log = 0, [], 0.0
        at = int(self.start[unit])
        while True:
            h = int(self.head[at])
            prob = self.arcs["prob"][h : h + int(self.many[at])].tolist()
            if node is not None:
                kids = steps[node][1]
                for arc, kid in kids.items():
                    prob[arc - h] *= masses[kid] if kid is not None else 0.0
            goal = uniform() * sum(prob)
            pick = 0
            for k, x in enumerate(prob):
                if x > 0:
                    pick = k
                    if goal < x:
                        break
                    goal -= x
            path.append(h + pick)
            log += math.log(self.arcs["prob"][h + pick])
            node = steps[node][1].get(h + pick) if node is not None else None
            size = int(self.arcs["size"][h + pick])
            if not size:
                break
            at += size
        got = tuple(path)
        return got, log, self._left(unit, (*out, got))[1][0]

    def _left(self, unit: int, out: tuple[tuple[int, ...], ...]) -> tuple[list, list[float]]:
        """A trie of the paths (sign, arc to child), and for each of its nodes the mass of what goes on from it and is no path of out."""
        steps: list[tuple[int, dict]] = [(int(self.start[unit]), {})]
        for path in out:
            node = 0
            for arc in path[:-1]:
                kids = steps[node][1]
                if arc not in kids:
                    steps.append((steps[node][0] + int(self.arcs["size"][arc]), {}))
                    kids[arc] = len(steps) - 1
                node = kids[arc]
            steps[node][1][path[-1]] = None
        masses = [0.0] * len(steps)
        for node in range(len(steps) - 1, -1, -1):
            at, kids = steps[node]
            h = int(self.head[at])
            for k, x in enumerate(self.arcs["prob"][h : h + int(self.many[at])].tolist()):
                kid = kids.get(h + k, -1)
                if kid is not None:
                    masses[node] += x if kid == -1 else x * masses[kid]
        return steps, masses


_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_ALL = (1 << 64) - 1


def _uniforms(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from counters."""
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _stream(key: np.ndarray, turn: int, place: np.ndarray) -> np.ndarray:
    return key + np.uint64(turn * _ODD[0] & _ALL) + place.astype(np.uint64) * np.uint64(_ODD[1])


class _Search:
    """The queue of one text. Values are Gumbel maxima of disjoint sets of segmentations."""

    def __init__(self, key: int, most: int):
        self.most = most
        self.key, self.drawn, self.queue, self.paths = (key ^ 0x5851F42D4C957F2D) & _ALL, 0, [], []

    def uniforms(self, n: int) -> np.ndarray:
        self.drawn += n
        return _uniforms(np.uint64(self.key) + np.arange(self.drawn - n, self.drawn, dtype=np.uint64) * np.uint64(_ODD[0]))

    def uniform(self) -> float:
        """The next of the same numbers."""
        x = (self.key + self.drawn * _ODD[0]) & _ALL
        self.drawn += 1
        x = (x ^ x >> 30) * int(MIX_1) & _ALL
        x = (x ^ x >> 27) * int(MIX_2) & _ALL
        return (((x ^ x >> 31) >> 11) + 0.5) * 2.0**-53

    def below(self, bound: float, log_mass: float) -> float:
        """A Gumbel at log_mass, given that it is less than bound."""
        x, y = -bound, math.log(-math.log(self.uniform())) - log_mass
        return -(max(x, y) + math.log1p(math.exp(-abs(x - y))))

    def put(self, value: float, *what) -> None:
        heapq.heappush(self.queue, (-value, self.drawn, what))

    def leave(self, path: int, first: int, prefix: float, bound: float, inherit: bool = False) -> None:
        """leave_many for one text. inherit: one of the sets has the value bound itself."""
        block, rest = _blocks([self.paths[path][1]], [first])
        value, before = _maxima(np.array([prefix]), np.array([bound]), block, rest, self.uniforms(block.size + 1)[None, :])
        if inherit:
            mass = np.append(before[0] + _log_rest(block[0]), before[0, -1] + block[0, -1] + _log_rest(rest)[0])
            if not np.isfinite(mass.max()):  # nothing is left to leave the path
                return
            w = np.exp(mass - mass.max())
            value[0, int(np.searchsorted(np.cumsum(w), self.uniform() * w.sum()))] = bound
        self.queue_up(path, first, value[0], before[0], float(before[0, -1] + block[0, -1]))

    def queue_up(self, path: int, first: int, value: np.ndarray, before: np.ndarray, after: float) -> None:
        # of sets queued together no more can come up than segmentations are still to be taken, and the bar
        for i in np.argsort(-value, kind="stable")[: self.most + 1].tolist():
            v = float(value[i])
            if v > -math.inf:
                unit = i < BLOCK
                self.put(v, "unit" if unit else "tail", path, first + i, float(before[i]) if unit else after, ())

    def pop(self) -> tuple | None:
        while self.queue:
            value, _, (kind, path, j, before, out) = heapq.heappop(self.queue)
            if kind == "unit":
                return -value, path, j, before, out
            self.leave(path, j, before, -value, inherit=True)
        return None


def _log_rest(log_p: np.ndarray) -> np.ndarray:
    """log(1 - exp(log_p)), minus infinity for a certain event."""
    with np.errstate(divide="ignore"):
        return np.log(-np.expm1(np.minimum(log_p, 0.0)))


def _blocks(logs: list[np.ndarray], first: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The next BLOCK log probabilities of each path, 0 beyond its end, and the sum of those after."""
    block, rest = np.zeros((len(logs), BLOCK)), np.zeros(len(logs))
    for i, (x, a) in enumerate(zip(logs, first)):
        part = x[a : a + BLOCK]
        block[i, : len(part)] = part
        if len(x) > a + BLOCK:
            rest[i] = x[a + BLOCK :].sum()
    return block, rest


def _maxima(prefix: np.ndarray, bound: np.ndarray, block: np.ndarray, rest: np.ndarray, uniform: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the sets that leave a path at each unit of its block, and for the set that leaves it later (last column): Gumbel maxima
    below the bound; and the log mass of what each shares with the path."""
    upto = prefix[:, None] + np.cumsum(block, 1)
    before = np.concatenate([prefix[:, None], upto[:, :-1]], 1)
    mass = np.concatenate([before + _log_rest(block), (upto[:, -1] + _log_rest(rest))[:, None]], 1)
    return -np.logaddexp(-bound[:, None], np.log(-np.log(uniform)) - mass), before


def sample_texts(keys: np.ndarray, texts: list[str], p: Pieces, k: int) -> list[list[tuple[bytes, float, float, float]]]:
    """For each text at most k distinct segmentations, best first: piece ids (little-endian unsigned 32-bit), log probability,
    perturbed value, and the inclusion score: the chance of a value above the best that was not taken."""
    per_doc = kept(p).numbers(texts)
    lat = kept(p).lattice
    sizes = np.array([len(x) for x in per_doc], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    unit = np.concatenate(per_doc) if per_doc else np.empty(0, np.int64)
    index = np.arange(len(unit)) - np.repeat(bounds[:-1], sizes)
    key = np.repeat(keys, sizes)
    found: list[list] = [[] for _ in texts]
    searches = [_Search(int(x), k) for x in keys]
    jobs: list[tuple] = [(i, None) for i in range(len(texts))]
    for turn in range(k):
        if not jobs:
            break
        pick = np.concatenate([np.arange(bounds[i] + (w[2] + 1 if w else 0), bounds[i + 1]) for i, w in jobs]) if len(unit) else np.empty(0, np.int64)
        stream = _stream(key[pick], turn, index[pick])
        count, arcs, log = lat.draw(unit[pick], lambda step, rows: _uniforms((stream.take(rows) if step else stream) + np.uint64(step * _ODD[2] & _ALL)))  # noqa: B023
        first = np.concatenate([[0], np.cumsum(count)])
        at, after, shared, values, firsts = 0, [], [], [], []
        for i, w in jobs:
            s, n = searches[i], int(sizes[i])
            if w is None:
                value, j, before, base, mid, out = -math.log(-math.log(s.uniform())), -1, 0.0, None, None, ()
            else:
                value, base, j, before, out = w
                mid, mid_log, left = lat.without(int(unit[bounds[i] + j]), out, s.uniform)
            m = n - 1 - j if w else n
            a, b = at, at + m
            at = b
            tail = arcs[first[a] : first[b]]
            if mid is None:
                path, logs, cuts = tail, log[a:b], first[a : b + 1] - first[a]
            else:
                old, old_logs, old_cuts = s.paths[base]
                path = np.concatenate([old[: old_cuts[j]], mid, tail])
                logs = np.concatenate([old_logs[:j], [mid_log], log[a:b]])
                cuts = np.concatenate([old_cuts[: j + 1], old_cuts[j] + len(mid) + first[a : b + 1] - first[a]])
            s.paths.append((path, logs, cuts))
            found[i].append((_ids(p, lat.ids[path]), float(logs.sum()), value))
            if mid is not None:
                if left > 0:
                    s.put(s.below(value, before + math.log(left)), "unit", base, j, before, (*out, mid))
            shared.append(before + (mid_log if mid is not None else 0.0))
            values.append(value)
            firsts.append(j + 1)
        drawn = _uniforms(_stream(keys[[i for i, _ in jobs]], turn + 1000, np.zeros(len(jobs)))[:, None] + np.arange(BLOCK + 1, dtype=np.uint64) * np.uint64(_ODD[2])).reshape(len(jobs), -1)
        block, rest = _blocks([searches[i].paths[-1][1] for i, _ in jobs], firsts)
        value, before = _maxima(np.array(shared), np.array(values), block, rest, drawn)
        ends = before[:, -1] + block[:, -1]
        for row, (i, _) in enumerate(jobs):
            s = searches[i]
            s.queue_up(len(s.paths) - 1, firsts[row], value[row], before[row], float(ends[row]))
            nxt = s.pop()
            if nxt:
                value2, base2, j2, before2, out2 = nxt
                if not out2:  # the path's own segmentation of that unit is what this set leaves out
                    q, _, c = s.paths[base2]
                    nxt = (value2, base2, j2, before2, (tuple(q[c[j2] : c[j2 + 1]].tolist()),))
                after.append((i, nxt))
        jobs = after
    bar = {i: w[0] for i, w in jobs}
    return [[(ids, lp, v, 1.0 if i not in bar else -math.expm1(-math.exp(min(50.0, lp - bar[i])))) for ids, lp, v in f] for i, f in enumerate(found)]


def _ids(p: Pieces, ids: np.ndarray) -> bytes:
    if (ids < 0).any():
        ids = np.array([x for i in ids.tolist() for x in ([i] if i >= 0 else [p.byte_ids[b] for b in chr(-1 - i).encode("utf-8", "replace")])])
    return ids.astype("<u4").tobytes()


def decode(ids: bytes, p: Pieces) -> str:
    """The text of piece ids: pieces end to end, spelt bytes read as UTF-8, without the blank that encoding puts before the first."""
    spelt = b"".join(p.spelt[np.frombuffer(ids, "<u4")].tolist())
    return (spelt[1:] if spelt[:1] == b" " else spelt).decode("utf-8", "replace")


def _decode_all(ids: pa.Array, p: Pieces) -> pa.Array:
    return pa.array([None if x is None else decode(x, p) for x in ids.to_pylist()], pa.string())


def decode_segmentations(df: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text that the ids column decodes to, over Arrow batches. Null ids give null; rows keep all their columns, and one named
    like that added is replaced."""
    held = df.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, _decode_all(part.column(ids), p)], [*part.schema.names, text])

    return held.mapInArrow(run, StructType([*held.schema.fields, StructField(text, StringType())]))


SAMPLES = "doc_id long, sample int, ids binary, log_prob double, perturbed double, inclusion double"


def sample_segmentations(docs: DataFrame, model: str, k: int = 3, seed: int = 1, id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """At most k distinct segmentations of every whole text, numbered from 0 in falling perturbed value.

    Draws depend on the seed, the row's id and the text's units only, not on how rows are grouped. Null and empty texts have one, empty,
    segmentation; a text with fewer than k segmentations gets them all. Rows with the same id and text get the same answer.
    decoded: add what decode_segmentations adds, by the same Python worker, so that a task needs no second one."""
    schema = SAMPLES + ", decoded string" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.float64())
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, held = lo, 0
                while hi < len(texts) and (hi == lo or held + len(texts[hi]) <= PASS_CHARS):
                    held += len(texts[hi])
                    hi += 1
                keys = mix(np.array([x or 0 for x in names[lo:hi]], np.int64).astype(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
                rows = [(n, j, *s) for n, f in zip(names[lo:hi], sample_texts(keys, texts[lo:hi], p, k)) for j, s in enumerate(f)]
                for a in range(0, len(rows), 1024):
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows[a : a + 1024]), kinds)]
                    yield pa.RecordBatch.from_arrays(columns + ([_decode_all(columns[2], p)] if decoded else []), [c.split()[0] for c in schema.split(", ")])
                lo = hi

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
