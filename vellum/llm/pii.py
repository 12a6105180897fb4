"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The tagger is trained in numpy from labelled spans: what the base patterns find in a bounded sample of rows, with the rendering varied
(separators left out or changed, prefixes dropped) and spans and numbers set side by side, so that it learns to find what the patterns
miss: other renderings, and the parts of a run that a pattern takes as one match and then drops.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resident, spare

# The kinds in their order and the base patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every base match, in order. A match is looked for where its pattern's rarest sign stands,
    which gives the leftmost matches of the pattern without trying every start."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            at = a = m.start()
            while a > last and text[a - 1] in _LOCAL_SIGNS:
                a -= 1
            if a < at:
                out.append((a, 0, m.end()))
                last = m.end()
    if text.isascii() and not _ANY_DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(x) <= 3 + x.count("0") and int(x[-400:]) <= 255 and not x[:-400].strip("0") for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


_ANY_DIGIT = re.compile("[0-9]")
_SIGNAL = re.compile("[0-9@]")
#: One of these is in every span that _plausible lets pass.
_SEED = re.compile(r"[0-9@]|\(at\)")

# ---- the tagger -----------------------------------------------------------------------------------------------------

_CLASSES = "@.-+() _%:=\"',;\n/"
N_SIGNS = 12 + len(_CLASSES)
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind


def signs(text: str) -> np.ndarray:
    """A small alphabet: digits, lower and upper letters, accented letters, and punctuation each by itself."""
    out = np.empty(len(text), np.int64)
    for i, c in enumerate(text):
        if "0" <= c <= "9":
            out[i] = 1
        elif "a" <= c <= "f":
            out[i] = 2
        elif "a" <= c <= "z":
            out[i] = 3
        elif "A" <= c <= "F":
            out[i] = 4
        elif "A" <= c <= "Z":
            out[i] = 5
        else:
            k = _CLASSES.find(c)
            out[i] = 12 + k if k >= 0 else 6 + c.isalpha() + 2 * c.isspace()
    return out


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Tagger:
    """Bidirectional LSTM over sign embeddings, a linear layer to tag scores, and CRF transitions."""

    def __init__(self, hidden: int = 16, embed: int = 8, seed: int = 7):
        r = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {"E": r.normal(0, 0.3, (N_SIGNS, embed)), "O": r.normal(0, 0.2, (2 * hidden, TAGS)), "c": np.zeros(TAGS), "T": r.normal(0, 0.1, (TAGS, TAGS))}
        for d in "fb":
            self.p |= {f"W{d}": r.normal(0, 0.25, (embed + hidden, 4 * hidden)), f"v{d}": np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])}

    def _pass(self, x: np.ndarray, d: str, keep: bool):
        n, steps, _ = x.shape
        h, c, k = np.zeros((n, self.hidden)), np.zeros((n, self.hidden)), self.hidden
        out, tape = np.empty((n, steps, k)), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = np.concatenate([x[:, t], h], 1)
            g = z @ self.p[f"W{d}"] + self.p[f"v{d}"]
            i, f, o, u = _sigmoid(g[:, :k]), _sigmoid(g[:, k : 2 * k]), _sigmoid(g[:, 2 * k : 3 * k]), np.tanh(g[:, 3 * k :])
            old, c = c, f * c + i * u
            s = np.tanh(c)
            h = o * s
            out[:, t] = h
            if keep:
                tape.append((t, z, i, f, o, u, old, s))
        return out, tape

    def scores(self, x: np.ndarray) -> np.ndarray:
        e = self.p["E"][x]
        return np.concatenate([self._pass(e, "f", False)[0], self._pass(e, "b", False)[0]], 2) @ self.p["O"] + self.p["c"]

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """CRF loss of a batch and its gradient."""
        n, steps = x.shape
        e = self.p["E"][x]
        (hf, tf), (hb, tb) = self._pass(e, "f", True), self._pass(e, "b", True)
        h = np.concatenate([hf, hb], 2)
        s, trans = h @ self.p["O"] + self.p["c"], self.p["T"]
        lse = lambda v, a: (m := v.max(a, keepdims=True)).squeeze(a) + np.log(np.exp(v - m).sum(a))
        alpha, beta = np.empty_like(s), np.zeros_like(s)
        alpha[:, 0] = s[:, 0]
        for t in range(1, steps):
            alpha[:, t] = s[:, t] + lse(alpha[:, t - 1, :, None] + trans, 1)
        for t in range(steps - 2, -1, -1):
            beta[:, t] = lse(trans + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = lse(alpha[:, -1], 1)
        rows = np.arange(n)[:, None]
        gold = s[rows, np.arange(steps), y].sum(1) + trans[y[:, :-1], y[:, 1:]].sum(1)
        gs = np.exp(alpha + beta - z[:, None, None])
        gs[rows, np.arange(steps), y] -= 1
        gt = np.zeros_like(trans)
        for t in range(1, steps):
            gt += np.exp(alpha[:, t - 1, :, None] + trans + (s[:, t] + beta[:, t])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(gt, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        g = {"O": np.einsum("nth,ntk->hk", h, gs), "c": gs.sum((0, 1)), "T": gt}
        gh, ge, k = gs @ self.p["O"].T, np.zeros_like(e), self.hidden
        for d, tape, part in (("f", tf, gh[:, :, :k]), ("b", tb, gh[:, :, k:])):
            gw, gv, dh, dc = np.zeros_like(self.p[f"W{d}"]), np.zeros(4 * k), np.zeros((n, k)), np.zeros((n, k))
            for t, zin, i, f, o, u, old, th in reversed(tape):
                dh = dh + part[:, t]
                dc = dc + dh * o * (1 - th * th)
                da = np.concatenate([dc * u * i * (1 - i), dc * old * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - u * u)], 1)
                gw += zin.T @ da
                gv += da.sum(0)
                dz = da @ self.p[f"W{d}"].T
                ge[:, t] += dz[:, : e.shape[2]]
                dh, dc = dz[:, e.shape[2] :], dc * f
            g[f"W{d}"], g[f"v{d}"] = gw, gv
        g["E"] = np.zeros_like(self.p["E"])
        np.add.at(g["E"], x.ravel(), ge.reshape(-1, e.shape[2]))
        return float((z - gold).mean()), {k2: v / n for k2, v in g.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 32, rate: float = 0.02, seed: int = 11) -> Tagger:
        r, first, second, n = np.random.default_rng(seed), {}, {}, 0
        for _ in range(max(1, steps * batch // max(1, len(x)))):
            for at in np.array_split(r.permutation(len(x)), max(1, len(x) // batch)):
                _, g = self.step(x[at], y[at])
                n += 1
                for k, v in g.items():
                    first[k] = 0.9 * first.get(k, 0) + 0.1 * v
                    second[k] = 0.99 * second.get(k, 0) + 0.01 * v * v
                    self.p[k] = self.p[k] - rate * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-8)
        return self

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tag path of each row of equal length."""
        s, trans = self.scores(x), self.p["T"]
        best, back = s[:, 0], []
        for t in range(1, s.shape[1]):
            v = best[:, :, None] + trans
            back.append(v.argmax(1))
            best = v.max(1) + s[:, t]
        out = np.empty(x.shape, np.int64)
        out[:, -1] = best.argmax(1)
        for t in range(s.shape[1] - 2, -1, -1):
            out[:, t] = back[t][np.arange(len(x)), out[:, t + 1]]
        return out


WINDOW, STRIDE = 96, 48


def _vary(piece: str, kind: int, r: np.random.Generator) -> str:
    """Another rendering of a labelled span."""
    how = r.integers(4)
    if kind == 0:
        return piece if how < 2 else piece.replace("@", " @ ", 1) if how == 2 else piece.replace("@", "(at)", 1)
    if kind == 1:
        return piece
    if kind == 2:
        digits = re.sub("[^0-9]", "", piece)
        joint = ("", "", "", " ", "-", ".")[r.integers(6)]
        return joint.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return (piece, piece.lstrip("+"), re.sub(r"[ ()]+", "-", piece).strip("-"), re.sub("^[+][0-9]+ ?", "", piece))[how]


def _beside(pool: list[tuple[str, int]], own: int, r: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """What may stand next to a span of kind `own`: one of its kind, any span or, unlabelled, a number."""
    how = r.integers(4)
    if how:
        same = [x for x in pool if x[1] == own]
        piece, kind = same[r.integers(len(same))] if how == 1 else pool[r.integers(len(pool))]
        piece = _vary(piece, kind, r)
        return piece, [(0, kind, len(piece))]
    return "".join(map(str, r.integers(0, 10, int(r.choice((1, 2, 4, 6)))))), []


def examples(texts: list[str], seed: int = 5, most: int = 6000, per_row: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` windows of signs and tags: for each base span of the texts (per_row of a text, drawn) 3 to 16 that hold it,
    as most allows, its rendering varied and in half of them something set beside it, and as many windows without spans at digits or @ signs."""
    r = np.random.default_rng(seed)
    found = [base_spans(t) for t in texts]
    pool = [(t[a:b], kind) for t, spans in zip(texts, found) for a, kind, b in spans if b - a <= WINDOW - 30]
    copies = min(16, max(3, most // (2 * max(1, len(pool)))))
    xs, ys, blank = [], [], []
    for text, spans in zip(texts, found):
        for i in r.permutation(len(spans))[:per_row].tolist():
            a, kind, b = spans[i]
            if b - a > WINDOW - 30:
                continue
            for _ in range(copies):
                piece = _vary(text[a:b], kind, r)
                parts, labels = [piece], [(0, kind, len(piece))]
                if r.integers(2):
                    more, marks = _beside(pool, kind, r)
                    joint = (" ", " ", ", ", "\n")[r.integers(4)]
                    if r.integers(2):
                        parts, shift = [piece, joint, more], len(piece) + len(joint)
                        labels += [(p + shift, k, q + shift) for p, k, q in marks]
                    else:
                        parts, shift = [more, joint, piece], len(more) + len(joint)
                        labels = [*marks, *((p + shift, k, q + shift) for p, k, q in labels)]
                body = "".join(parts)
                lead = int(r.integers(2, max(3, WINDOW - len(piece) - 3)))
                # neighbours in the same text keep their labels
                near = [(p - a + lead, k, q - a + lead) for p, k, q in spans if q <= a]
                near += [(p + lead, k, q + lead) for p, k, q in labels]
                near += [(p - b + lead + len(body), k, q - b + lead + len(body)) for p, k, q in spans if p >= b]
                window = (text[max(0, a - lead) : a].rjust(lead) + body + text[b : b + WINDOW]).ljust(WINDOW)[:WINDOW]
                tags = np.zeros(WINDOW, np.int64)
                for p, k, q in near:
                    if q > 0 and p < WINDOW:
                        tags[max(0, p) : q] = 2 + 2 * k
                        if p >= 0:
                            tags[p] = 1 + 2 * k
                xs.append(signs(window))
                ys.append(tags)
        signals = [m.start() for m in _SIGNAL.finditer(text)]
        for m in r.permutation(len(signals))[:3].tolist():
            a = max(0, signals[m] - int(r.integers(10, 80)))
            if not any(p < a + WINDOW and q > a for p, _, q in spans):
                blank.append(signs(text[a : a + WINDOW].ljust(WINDOW)))
    if not xs:
        return np.zeros((0, WINDOW), np.int64), np.zeros((0, WINDOW), np.int64)
    for i in r.permutation(len(blank))[: len(xs)].tolist():
        xs.append(blank[i])
        ys.append(np.zeros(WINDOW, np.int64))
    pick = r.permutation(len(xs))[:most]
    return np.array(xs)[pick], np.array(ys)[pick]


#: Rows that may hold a base span, as a filter.
LIKELY = r"@[A-Za-z0-9-]+\.|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9](?:[ -]?[0-9]){13}|\+[0-9][ ().0-9-]{8}"


def training_texts(docs: DataFrame, sample_rows: int, stretches: int, seed: int = 7, id: str = "doc_id", text: str = "text") -> list[str]:
    """Of about sample_rows rows that may hold a base span, and a quarter as many others with a digit or an @ sign, taken by a hash of their id, the
    first `stretches` stretches round those signs, joined."""
    t = F.col(text)
    kind = F.when(t.rlike(LIKELY), 0).when(t.rlike("[0-9@]"), 1)
    n = docs.select(kind.alias("k")).agg(*(F.count_if(F.col("k") == k).alias(f"n{k}") for k in (0, 1))).first()
    place = F.pmod(F.xxhash64(F.col(id), F.lit(seed)), F.lit(1 << 40))
    bound = [int((1 << 40) * min(1.0, rows / max(1, have))) for rows, have in ((sample_rows, n.n0), (sample_rows // 4, n.n1))]
    taken = docs.where(place < max(bound)).withColumn("_k", kind).where(((F.col("_k") == 0) & (place < bound[0])) | ((F.col("_k") == 1) & (place < bound[1])))
    near = F.expr(f"array_join(slice(regexp_extract_all(`{text}`, '(?s)(.{{0,60}}[0-9@].{{0,90}})', 1), 1, {stretches}), ' ')")
    return [t for _, t in sorted((r["k"], r["t"]) for r in taken.select(F.xxhash64(F.col(id)).alias("k"), near.alias("t")).collect())]


def train(docs: DataFrame, sample_rows: int = 1500, stretches: int = 12, seed: int = 7, id: str = "doc_id", text: str = "text") -> Tagger:
    """Fit the tagger on a bounded sample of labelled rows: see training_texts for sample_rows and stretches. With fewer than 20
    windows to learn from the tagger stays untrained and tags nothing."""
    x, y = examples(training_texts(docs, sample_rows, stretches, seed, id, text))
    tagger = Tagger(seed=seed)
    if len(x) < 20:
        tagger.p["c"][0] = 1e3
        return tagger
    return tagger.fit(x, y)


def tagged_spans(texts: list[str], tagger: Tagger, least: tuple[int, ...] = (6, 7, 13, 9)) -> list[list[tuple[int, int, int]]]:
    """Spans (start, kind, end) that the tagger finds in whole texts: what decoding every overlapping window gives.

    Windows of WINDOW signs stand every STRIDE, and each position takes its tag from the window in whose middle it stands; then
    spans are read off the whole text, so none is cut at a window's edge. Spans shorter than least or not plausible are
    dropped. A plausible span holds a digit, an @ sign or '(at)', so the windows with those are decoded first, and then
    those beside them for as long as a span may go on there: what is left undecoded holds no plausible span nor a part of one."""
    edge = (WINDOW - STRIDE) // 2
    done: dict[tuple[int, int], np.ndarray] = {}

    def decode(blocks: list[tuple[int, int]]) -> None:
        for lo in range(0, len(blocks), 4096):
            xs = []
            for i, b in blocks[lo : lo + 4096]:
                a = b * STRIDE - edge
                xs.append(signs((" " * max(0, -a) + texts[i][max(0, a) : a + WINDOW]).ljust(WINDOW)))
            done.update(zip(blocks[lo : lo + 4096], tagger.decode(np.array(xs))[:, edge : edge + STRIDE]))

    fresh = sorted({(i, m.start() // STRIDE) for i, text in enumerate(texts) for m in _SEED.finditer(text)})
    reach = 1
    while fresh:
        decode(fresh)
        more: set[tuple[int, int]] = set()
        for i, b in fresh:
            line = done[i, b]
            if line[0] and line[0] % 2 == 0:  # inside a span that began before
                more.update((i, k) for k in range(max(0, b - reach), b))
            if line[-1]:
                more.update((i, k) for k in range(b + 1, min(b + reach, (len(texts[i]) - 1) // STRIDE) + 1))
        fresh = sorted(more - done.keys())
        reach *= 2
    where = sorted(done)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    at = 0
    while at < len(where):
        end = at + 1  # consecutive blocks of one text
        while end < len(where) and where[end] == (where[end - 1][0], where[end - 1][1] + 1):
            end += 1
        i, b = where[at]
        line, text, first = np.concatenate([done[w] for w in where[at:end]]), texts[i], b * STRIDE
        k = 0
        for p in np.flatnonzero(line % 2 == 1):
            kind, q = int(line[p]) // 2, p + 1
            while q < len(line) and line[q] == 2 + 2 * kind:
                q += 1
            a, z = first + int(p), min(first + int(q), len(text))
            body = text[a:z]
            if z - a >= least[kind] and _plausible(body, kind):
                out[i].append((a, kind, z))
            k = q
        at = end
    return out


def _plausible(body: str, kind: int) -> bool:
    """What a span of the kind holds at least, whatever its separators."""
    digits = sum("0" <= c <= "9" for c in body)
    if body != body.strip() or "\n" in body:
        return False
    if kind == 0:
        return "@" in body or "(at)" in body
    if kind == 1:
        return digits >= 4 and body.count(".") == 3 and digits + 3 == len(body)
    if kind == 2:
        return 14 <= digits <= 19 and luhn(re.sub("[^0-9]", "", body))
    return 10 <= digits <= 15 and not any(c.isalpha() for c in body)


def reconcile(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans stay; an added one stays where it overlaps none of them nor an added one before it."""
    out, last = list(base), -1
    for a, kind, b in sorted(more):
        if a >= last and not any(p < b and q > a for p, _, q in base):
            out.append((a, kind, b))
            last = b
    return sorted(out)


SPANS = "base string, spans string, n_email long, n_ip long, n_card long, n_phone long"


def _write(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, tagger: Tagger, text: str = "text") -> DataFrame:
    """Add base and spans (kind:start:end, comma-joined, code points, end exclusive) and the base counts of each kind.

    Null and empty texts have no spans. Whole texts are read, whatever their length. Rows keep all their columns;
    columns named like those added are replaced."""
    model = docs.sparkSession.sparkContext.broadcast(tagger)  # a few thousand numbers

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        resident()
        for part in parts:
            rows = []
            for lo in range(0, len(part), 1000):
                texts = [t if isinstance(t, str) else "" for t in part.iloc[lo : lo + 1000]]
                for t, more in zip(texts, tagged_spans(texts, model.value)):
                    base = base_spans(t)
                    n = [sum(k == i for _, k, _ in base) for i in range(4)]
                    rows.append((_write(base), _write(reconcile(base, more)), *n))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SPANS.split(", ")])

    names = [x.split()[0] for x in SPANS.split(", ")]
    kept = docs.drop(*names)
    found = spare(kept, "found")
    return kept.withColumn(found, F.pandas_udf(run, SPANS).asNondeterministic()(F.col(text))).select("*", f"{found}.*").drop(found)


def mask(docs: DataFrame, spans: str = "spans", text: str = "text") -> DataFrame:
    """Replace every span of the text by its kind in brackets. Overlapping spans are replaced as one, named by the first."""
    pieces = F.expr(f"""aggregate(filter(split({spans}, ','), s -> s <> ''), named_struct('at', 0, 'out', ''),
        (a, s) -> CASE WHEN int(split_part(s, ':', 3)) <= a.at THEN a
          ELSE named_struct('at', int(split_part(s, ':', 3)),
            'out', a.out || CASE WHEN int(split_part(s, ':', 2)) < a.at THEN ''
              ELSE substring({text}, a.at + 1, int(split_part(s, ':', 2)) - a.at) || '[' || split_part(s, ':', 1) || ']' END) END,
        a -> a.out || substring({text}, a.at + 1))""")
    return docs.withColumn(text, F.when(F.col(spans) == "", F.col(text)).otherwise(pieces))
