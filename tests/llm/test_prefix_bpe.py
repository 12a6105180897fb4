"""BPE by prefix-sharing tries against plain BPE and against the tokenizers library."""

from __future__ import annotations

import random

import pytest

from vellum.llm.prefix_bpe import PrefixTrie, decode_documents, encode_documents


def plain_bpe(word, merges):
    out = list(word)
    while True:
        pairs = [(k, i) for i, p in enumerate(zip(out, out[1:])) for k, (a, b, _) in enumerate(merges) if p == (a, b)]
        if not pairs:
            return out
        k, i = min(pairs)
        out[i : i + 2] = [merges[k][2]]


@pytest.mark.parametrize("seed", range(12))
def test_trie_equals_plain_bpe(seed):
    r = random.Random(seed)
    units, merges, tokens, met = list(range(4)), [], list(range(4)), {}
    while len(merges) < 60:
        a, b = r.choice(tokens), r.choice(tokens)
        spelt = met.get(a, (a,)) + met.get(b, (b,))
        if len(spelt) <= 9 and spelt not in met.values():
            c = 4 + len(merges)
            merges.append((a, b, c))
            met[c] = spelt
            tokens.append(c)
    words = [tuple(r.choice(units) for _ in range(r.randrange(1, 25))) for _ in range(400)] + [(0,) * k for k in range(1, 30)]
    trie = PrefixTrie(units, merges, shared_depth=r.choice((3, 8, 64)), keep_nodes=500)
    for some in (words[:150], words[100:], words):
        assert trie.encode(some) == {w: plain_bpe(w, merges) for w in some}


def test_shared_prefixes_are_encoded_once():
    trie = PrefixTrie(range(3), [(0, 1, 3)])
    trie.encode([(0, 1, 2), (0, 1, 1), (0, 1)])
    assert len(trie.last) == 1 + 4
    trie.encode([(0, 1, 2, 2)])
    assert len(trie.last) == 1 + 5


ODD = ["", None, " ", "Hello, World's END", "<|endoftext|>", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|><|", "E\u0301 \u00c9 \u0130 \u00df \u039f\u0394\u039f\u03a3", "\u65e5\u672c\u8a9e 123 \U0001f642\U0001f642", "\x1c\x85\u00a0\u3000x\u200b y",
       "</w> a</w>", "x" * 3000, "ab" * 400 + " " + "'ll've" * 30, "word " * 20000, "\x00\x7f!?-_'", "\u0301start"]


def test_documents(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    rows = [(i, t, "aa") for i, t in enumerate(ODD)] + [(3, ODD[3], "bb"), (None, "null id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    library = tokenizers.Tokenizer.from_file(path)
    got = encode_documents(docs, path, decoded=True)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    again = decode_documents(got.drop("decoded"), path)
    assert sorted(map(tuple, again.collect()), key=key) == sorted(want, key=key)
    assert encode_documents(docs.limit(0), path).count() == 0
