"""BPE encoding and decoding: distinct words meet in a trie, and each shared prefix is encoded once."""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resident, runs_of_rows, text_bytes

#: ASCII white space ends every word of the pre-tokenizer, and no normal form reaches across it.
_CHUNKS = re.compile(r"[^\t-\r ]+")
_PLAIN = re.compile("[!-~\xa1-\u017f]+")
_LOWERED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_NEVER = 1 << 60


def _byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: itself where it is a visible sign of Latin-1, the next after U+00FF otherwise."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return [chr(b) if b in set(seen) else chr(256 + hidden.index(b)) for b in range(256)]


class PrefixTrie:
    """BPE encodings of words (tuples of symbol ids), with the prefixes that words share encoded once.

    A sequence of tokens is the BPE encoding of a word exactly where each two neighbours are the encoding of what they spell together. So a prefix has
    one last token: the one that spells its end and stands well beside the last token of the prefix before it. A node of the trie keeps that token and
    the node that it begins after; an encoding is read off backwards. Words come sorted, so that nodes are numbered depth first and parents
    precede their children.
    """

    def __init__(self, units: Iterable[int], merges: list[tuple[int, int, int]], shared_depth: int = 64, keep_nodes: int = 800_000):
        """merges: (left, right, merged) by falling priority. Prefixes of up to shared_depth symbols are shared; what a longer word has beyond them is a
        branch that goes when the word is encoded. Past keep_nodes the trie starts again."""
        self.rank = {(a, b): (k, c) for k, (a, b, c) in reversed([*enumerate(merges)])}
        spelt: dict[int, tuple[int, ...]] = {u: (u,) for u in units}
        for a, b, c in merges:
            spelt.setdefault(c, spelt[a] + spelt[b])
        self.spelt, self.fits, self.history = spelt, {}, {}
        self.width = max(spelt, default=0) + 1
        self.length = {t: len(signs) for t, signs in spelt.items()}
        self._suffixes()
        self.shared_depth, self.keep_nodes = shared_depth, keep_nodes
        self._clear()

    def _suffixes(self) -> None:
        """Which tokens end where: states of the tokens' beginnings, from each its longest proper end that is a state, and the longest that is a token."""
        self.go, self.token_at, tokens = {}, [-1], [(t, signs, 0) for t, signs in self.spelt.items()]
        self.fall, self.shorter, depth = array("i", [0]), array("i", [-1]), 0
        go, width, token_at = self.go, self.width, self.token_at
        while tokens:  # a level at a time, so that the shorter ends are known
            longer = []
            for t, signs, state in tokens:
                key = state * width + signs[depth]
                below = go.get(key)
                if below is None:
                    below = len(token_at)
                    token_at.append(-1)
                    self.fall.append(self._next(self.fall[state], signs[depth]) if state else 0)
                    self.shorter.append(-2)
                    go[key] = below
                if len(signs) == depth + 1:
                    token_at[below] = t
                else:
                    longer.append((t, signs, below))
            tokens, depth = longer, depth + 1
        for state in range(1, len(token_at)):
            end = self.fall[state]
            self.shorter[state] = end if token_at[end] >= 0 else self.shorter[end]

    def _next(self, state: int, sign: int) -> int:
        while True:
            found = self.go.get(state * self.width + sign)
            if found is not None or not state:
                return found or 0
            state = self.fall[state]

    def _clear(self) -> None:
        self.child: dict[int, int] = {}
        self.state, self.last, self.begin = array("i", [0]), array("i", [-1]), array("i", [-1])

    def _merged(self, signs: tuple[int, ...]) -> tuple[list[int], list[tuple[int, int, int]]]:
        """Plain BPE: the pair of the best rank, leftmost first, until none is left. Also the merges as they came: rank, first and last token after it."""
        out, rank, steps = list(signs), self.rank, []
        while len(out) > 1:
            best = min(((rank[p][0], i) for i, p in enumerate(zip(out, out[1:])) if p in rank), default=None)
            if best is None:
                break
            r, i = best
            out[i : i + 2] = [rank[out[i], out[i + 1]][1]]
            steps.append((r, out[0], out[-1]))
        return out, steps

    def _steps(self, token: int) -> list[tuple[int, int, int]]:
        """The merges that make a token, with what stands at its ends before the first and after each."""
        known = self.history.get(token)
        if known is None:
            signs = self.spelt[token]
            made, steps = self._merged(signs)
            known = self.history[token] = [(-1, signs[0], signs[-1]), *steps, (_NEVER, 0, 0)] if made == [token] else []
        return known

    def _fit(self, left: int, token: int) -> bool:
        """Whether token may follow left (-1: begin a word): whether no merge across the border comes first while each side makes its own merges."""
        right = self._steps(token)
        good = bool(right)
        if right and left >= 0:
            good = self._apart(self._steps(left), right)
            if good is None:
                good = self._merged(self.spelt[left] + self.spelt[token])[0] == [left, token]
        if len(self.fits) > 400_000:
            self.fits.clear()
        self.fits[left * self.width + token] = good
        return good

    def _apart(self, left: list, right: list) -> bool | None:
        """None: a merge across the border is as good as one inside, and place decides."""
        i = j = 0
        while True:
            across = self.rank.get((left[i][2], right[j][1]))
            best = min(left[i + 1][0], right[j + 1][0])
            if across is not None and across[0] <= best:
                return None if across[0] == best else False
            if best == _NEVER:
                return True
            if left[i + 1][0] <= right[j + 1][0]:
                i += 1
            else:
                j += 1

    def _grow(self, path: list[int], sign: int) -> int:
        """A new node below the path's last: of the tokens that end its prefix, the longest that stands well beside the state it begins after."""
        at = self._next(self.state[path[-1]], sign)
        end = at if self.token_at[at] >= 0 else self.shorter[at]
        while end > 0:
            token = self.token_at[end]
            start = path[-self.length[token]]
            left = self.last[start]
            good = self.fits.get(left * self.width + token)
            if self._fit(left, token) if good is None else good:
                self.state.append(at)
                self.last.append(token)
                self.begin.append(start)
                return len(self.last) - 1
            end = self.shorter[end]
        raise ValueError("no token ends a prefix: the merges are not those of a BPE")

    def encode(self, words: Iterable[tuple[int, ...]]) -> dict[tuple[int, ...], list[int]]:
        """Token ids of each distinct word. In sorted order the words walk the trie depth first."""
        if len(self.last) > self.keep_nodes:
            self._clear()
        out, child, width, state, last, begin = {}, self.child, self.width, self.state, self.last, self.begin
        go, fits, token_at, shorter, length = self.go, self.fits, self.token_at, self.shorter, self.length
        for word in sorted(set(words)):
            path = [0]
            node = 0
            for s in word[: self.shared_depth]:
                key = node * width + s
                below = child.get(key)
                if below is None:
                    below = child[key] = len(last)
                    at = go.get(state[node] * width + s)  # what _grow does, where all is known
                    if at is not None:
                        token = token_at[at]
                        if token < 0:
                            token = token_at[shorter[at]]
                        start = path[-length[token]]
                    if at is not None and fits.get(last[start] * width + token):
                        state.append(at)
                        last.append(token)
                        begin.append(start)
                    else:
                        self._grow(path, s)
                node = below
                path.append(node)
            top = len(last)
            for s in word[self.shared_depth :]:
                node = self._grow(path, s)
                path.append(node)
            ids = []
            while node:
                ids.append(last[node])
                node = begin[node]
            out[word] = ids[::-1]
            if len(word) > self.shared_depth:
                for part in (self.state, last, begin):
                    del part[top:]
        return out


class WordEncoder:
    """Ids of whole texts by a byte-level word-end BPE of the tokenizers library, whose normalizer and pre-tokenizer are applied to distinct chunks between
    ASCII white space; the library's model is not run."""

    def __init__(self, path: str, keep: int = 300_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        odd = [k for k in ("dropout", "continuing_subword_prefix", "ignore_merges") if model.get(k)] + [t["content"] for t in added if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or _CHUNKS.fullmatch(t["content"]) is None]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if model["type"] != "BPE" or odd or spec["decoder"] or spec["post_processor"] or [(c["type"], c.get("add_prefix_space"), c.get("use_regex")) for c in cuts[1:]] != [("ByteLevel", False, False)]:
            raise ValueError(f"not a plain byte-level word-end BPE: {odd or model['type']}")
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        letters = _byte_letters()
        self.inner, self.final = [vocab[c] for c in letters], [vocab[c + end] for c in letters]
        self.byte = {c: b for b, c in enumerate(letters)}
        self.trie = PrefixTrie({*self.inner, *self.final}, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.added = {t["content"]: t["id"] for t in added}
        self.split_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        names = [""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for t, i in (vocab | self.added).items():
            names[i] = t
        self.names = pa.array(names, pa.large_string())
        tokenizer = Tokenizer.from_file(path)
        self.normal, self.cut = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.known: dict[str, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        self.once: set[int] = set()
        self.keep, self.plain = keep, None
        # of simple signs the normal form is the lower case, and which are letters and digits can be listed
        split = cuts[0]
        if (spec["normalizer"] or {}).get("normalizers") == _LOWERED and split["type"] == "Split" and split["invert"] and split["behavior"] == "Removed":
            kind = lambda k: "".join(re.escape(chr(i)) for i in (*range(33, 127), *range(0xA1, 0x180)) if unicodedata.category(chr(i))[0] == k)
            self.plain = re.compile(split["pattern"]["Regex"].replace(r"\p{L}", kind("L")).replace(r"\p{N}", kind("N")))

    def _words(self, text: str) -> list[bytes]:
        """UTF-8 of the words that the pre-tokenizer makes of a text."""
        if self.plain is not None and _PLAIN.fullmatch(text):
            return [w.encode() for w in self.plain.findall(text.lower())]
        if self.normal is not None:
            text = self.normal.normalize_str(text)
        return [bytes([self.byte[c] for c in w]) for w, _ in self.cut.pre_tokenize_str(text) if w]

    def learn(self, chunks: Iterable[str]) -> dict[str, bytes]:
        """Little-endian 32-bit ids of distinct chunks: added tokens stand for themselves, all else is cut to words, and new words go to the trie together."""
        if len(self.words) > self.keep:
            self.words.clear()
        cut: dict[str, list] = {}
        new: set[bytes] = set()
        known, added = self.words, self.added
        for c in chunks:
            if "<" in c and self.split_added and self.split_added.search(c):
                cut[c] = spans = [w for k, s in enumerate(self.split_added.split(c)) for w in ([s] if k % 2 else self._words(s) if s else [])]
            else:
                cut[c] = spans = self._words(c)
            new.update([w for w in spans if w not in known])
        inner, final = self.inner, self.final
        signs = {w: (*[inner[b] for b in w[:-1]], final[w[-1]]) for w in new if isinstance(w, bytes)}
        ids = self.trie.encode(signs.values())
        for w, s in signs.items():
            known[w] = array("i", ids[s]).tobytes()
        out = {c: known[w[0]] if len(w) == 1 and isinstance(w[0], bytes) else b"".join([known[x] if isinstance(x, bytes) else array("i", [added[x]]).tobytes() for x in w]) for c, w in cut.items()}
        for w in [w for w in new if len(w) > 64]:
            del known[w]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Chunks met for the second time stay known."""
        rows, known, once = [_CHUNKS.findall(t) for t in texts], self.known, self.once
        if len(known) > self.keep:
            known.clear()
        if len(once) > 2 * self.keep:
            once.clear()
        new = self.learn({c for row in rows for c in row if c not in known})
        again = {c: ids for c, ids in new.items() if hash(c) in once and len(c) <= 64}
        once.update([hash(c) for c in new if c not in again])
        known.update(new)
        get = known.__getitem__
        out = [b"".join(map(get, row)) for row in rows]
        for c in new.keys() - again.keys():
            del known[c]
        return out

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """What the library's decode gives with special tokens kept: this tokenizer has no decoder, so tokens are joined by a space."""
        signs = pa.LargeListArray.from_arrays(ids.offsets.cast(pa.int64()), self.names.take(ids.values))
        return pc.binary_join(signs, pa.scalar(" ", pa.large_string()))


def encoder(path: str) -> WordEncoder:
    return resident(("word bpe", path), lambda: WordEncoder(path))


def encode_documents(docs: DataFrame, tokenizer: str, decoded: bool = False, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens long, ids array<int>[, decoded string]): the ids of every whole text, as the tokenizers library gives them without adding special tokens.

    One row for each row of docs: null and empty texts have no ids, repeated rows and null ids are kept, other columns are left out, whatever their names. The letters of
    a special token in a text are that token, as in the library. decoded: the text of the ids, made in the same pass. No shuffle; a worker keeps its trie from batch to batch.
    """
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    schema = f"key {kinds[id].simpleString()}, n_tokens long, ids array<int>" + (", decoded string" if decoded else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for lo, hi in runs_of_rows(offsets, 2_000_000):
                some = batch.slice(lo, hi - lo)
                ids = own.encode([t or "" for t in some.column(1).to_pylist()])
                n = np.array([len(x) // 4 for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], n.cumsum()]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                columns = [some.column(0), pa.array(n), lists] + ([own.decode(lists).cast(pa.string())] if decoded else [])
                yield pa.RecordBatch.from_arrays(columns, ["key", "n_tokens", "ids", "decoded"][: len(columns)])

    out = docs.select(F.col(id).alias("key"), F.col(text).alias("body")).mapInArrow(run, schema)
    return out.withColumnRenamed("key", id)


def decode_documents(encoded: DataFrame, tokenizer: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """encoded with a column of the text that its ids spell; null ids give null."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def spelt(column):
        own = encoder(tokenizer)
        lists = pa.array([None if x is None else np.asarray(x, np.int32) for x in column], pa.list_(pa.int32()))
        return own.decode(lists).to_pandas()

    return encoded.withColumn(into, spelt(F.col(ids)))
