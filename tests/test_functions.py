"""Text functions against plain Python and cases that people confirmed."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions import vectors as V
from vellum.operators import duplicates, layout, listing, search


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_words_and_shingles(spark):
    assert column(spark, ["Été  à la-plage!", "", "a b"], T.words) == [["ete", "a", "la", "plage"], [], ["a", "b"]]
    assert column(spark, ["a b c d a b c", "x y", ""], T.shingles) == [["a b c", "b c d", "c d a", "d a b"], ["x y"], []]


def test_titles(spark):
    same = [("A Lamp By The Door", "A lamp by The door"), ("The long walk to 'Marlow' bridge", "The long walk to Marlow Bridge"), ("Copy of Rivers.pdf", "rivers (1)"), ("2019-03-QRNotes-The-Mill", "the mill")]
    df = spark.createDataFrame(same + [("Lessons Part 1", "Lessons Part 2"), ("", "x"), ("The Way", "Of")], "a string, b string")
    got = [r[0] for r in df.select(T.title_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[:4] == [1.0] * 4 and got[4:6] == [0.0, 0.0]
    assert column(spark, ["2019-03-QRNotes-The-Art-of-Mending", "RAIN IS NEAR", "Kept As it Was", ".pdf"], T.clean_title) == ["The Art of Mending", "Rain is Near", "Kept As it Was", ".pdf"]
    assert column(spark, ["THE COLOUR OF THE SEA", "the oar", "Watching the TV", "3rd (macNeil) part iv"], T.title_case) == ["The Colour Of The Sea", "The Oar", "Watching The TV", "3rd (macNeil) Part IV"]
    assert column(spark, ["L'Été -- here!", "", "x" * 70], T.slugify) == ["lete-here", "item", "x" * 60]


def test_hyphens_and_invented(spark):
    assert column(spark, ["gar-\nden is", "self-\ntaught", "two-\nthirds", "xy-\n42 Margin", "up-to-\ndate", "a-\nb-\nc"], T.dehyphenate) == ["garden is", "self-taught", "two-thirds", "xy-\n42 Margin", "up-to-date", "abc"]
    assert column(spark, ["the tchw TV of", "a === b", "of"], T.strip_invented) == ["the TV of", "a b", "of"]


def test_quality(spark):
    clean = "the quick brown fox jumps over the lazy dog and then it sleeps under the old apple tree near a quiet river bank"
    got = column(spark, [clean, "", "tchw bdfg |= C— zxc"], T.score_text)
    assert got[0].score == 1.0 and got[0].usable and got[0].notes == [T.NOTE_CLEAN]
    assert got[1].score == 0.0 and not got[1].usable and not got[2].usable and T.NOTE_LITTLE in got[2].notes


def test_chunks(spark):
    texts = [" ".join(str(i) for i in range(n)) for n in (0, 1, 350, 351, 660, 661, 1000)]
    got = column(spark, texts, T.chunk_page)
    for t, c in zip(texts, got):
        w, want = t.split(), []
        at = 0
        while w:
            want.append(" ".join(w[at : at + 350]))
            if at + 350 >= len(w):
                break
            at += 310
        assert c == want
    rows = [("m", 1, "a b c"), ("m", 2, " ".join(["w"] * 15)), ("m", 3, "x " * 4), ("m", 4, None), ("n", 1, "only two")]
    out = layout.chunk_material(spark.createDataFrame(rows, "material_id string, page_number int, text string")).orderBy("material_id", "chunk").collect()
    assert [(r.material_id, r.page_number, r.kind, len(r.text.split())) for r in out] == [("m", None, "span", 18), ("m", 3, "page", 4), ("n", 1, "page", 2)]


@pytest.mark.parametrize(
    ("url", "ok"),
    [("https://example.com/a.pdf", True), ("http://127.0.0.1/x", False), ("http://0x7f000001/", False), ("http://017700000001/", False), ("http://2130706433/", False), ("http://[::1]/", False), ("http://[fe80::1]/", False), ("http://user:pw@example.com/", False), ("ftp://example.com", False), ("", False), ("nonsense", False), ("http://10.0.0.8:80/", False), ("http://8.8.8.8/", True), ("http://a.internal/", False), ("http://100.64.0.1", False),
     ("http://127.1/", False), ("http://192.168.1/", False), ("http://0177.0.0.1/", False), ("http://0x7f.0.0.1/", False), ("http://0x7f.1", False), ("http://[::ffff:7f00:1]/", False), ("http://[::ffff:10.0.0.1]/", False), ("http://[0:0:0:0:0:0:0:1]/", False),
     ("http://\uff11\uff12\uff17.0.0.1/", False), ("http://127\u30020\u30020\u30021/", False), ("http://\uff4c\uff4f\uff43\uff41\uff4c\uff48\uff4f\uff53\uff54/", False), ("http://256.1.1.1/", False), ("http://1.2.3.4.5/", False), ("http://09.1.1.1/", False), ("http://0/", False), ("http://169.254.169.254/x", False), ("http://127.0.0.1./", False),
     ("http://8.8.2056/", True), ("http://0x08.8.8.8/", True), ("http://[::ffff:808:808]/", True), ("http://[2001:db8::1]/", True), ("http://1example.com/", True), ("http://example.com:8080/a", True)],
)
def test_vet_url(spark, url, ok):
    assert column(spark, [url], T.vet_url)[0].ok is ok


def test_links_and_names(spark):
    assert column(spark, ["https://d.example.com/file/d/AB_c-1/view", "https://x/open?id=Q9", "https://x"], T.file_id_from_url) == ["AB_c-1", "Q9", None]
    assert column(spark, ["Hope; TBD, n/a | Faith  now"], T.split_topics) == [["Hope", "n", "a", "Faith now"]]
    assert column(spark, ["https://x.org/a/My%20File-(2).pdf", "not a url"], T.title_from_url)[0].startswith("My File")
    assert column(spark, ["  a/b\"c. ", ""], T.download_name) == ["abc.pdf", "material.pdf"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 0.5**0.5) < 1e-12 and got[1] == 0.0


def test_verdict(spark):
    n = F.lit(None)
    f = lambda t=n, s=n, c=n, e=n, sha=n, md5=n, p=n: duplicates.verdict(t, s, c, e, sha, md5, p)
    r = spark.range(1).select(
        f(sha=F.lit(True)).alias("a"), f(t=F.lit(1.0)).alias("b"), f(s=F.lit(0.778), t=F.lit(0.6)).alias("c"), f(c=F.lit(0.95)).alias("d"), f(t=F.lit(0.5)).alias("e"), f(t=F.lit(1.0), s=F.lit(1.0), p=F.lit(True)).alias("g")
    ).first()
    assert (r.a.level, r.a.score) == ("identical", 1.0) and (r.b.score, r.b.level) == (0.8, "possible")
    assert (r.c.score, r.c.level) == (0.878, "likely") and (r.d.score, r.d.level) == (0.55, "possible") and r.e.level == "distinct" and r.e.reasons == [] and r.g.score == 1.0


def test_candidates_lose_nothing(spark):
    r = random.Random(3)
    names = ["hope", "faith", "love", "the way", "a heart", "part 1", "part 2", ""]
    rows = [(i, " ".join(r.sample(names, 2)).strip() if i % 9 else "", str(i % 37) if i % 5 == 0 else None, None, i % 3) for i in range(80)]
    texts = [(i, " ".join(r.choice("abcdefghij") * 3 for _ in range(90)) if i % 4 else "the same long text " * 20) for i in range(80)]
    docs = spark.createDataFrame(rows, "id int, title string, sha256 string, md5 string, page_count int")
    found = {(x.a, x.b): (x.score, x.level) for x in duplicates.scan(docs, spark.createDataFrame(texts, "id int, text string")).collect()}
    pairs = docs.select(F.col("id").alias("a")).crossJoin(docs.select(F.col("id").alias("b"))).where("a < b")
    side = lambda k: docs.select(F.col("id").alias(k), F.struct("title", "sha256", "page_count").alias(f"d{k}"))
    t = spark.createDataFrame(texts, "id int, text string")
    p = pairs.join(side("a"), "a").join(side("b"), "b").join(t.toDF("a", "xa"), "a").join(t.toDF("b", "xb"), "b")
    sha = F.coalesce(F.col("da.sha256") == F.col("db.sha256"), F.lit(False))
    gate = ((T.title_overlap(F.col("da.title"), F.col("db.title")) >= 0.35) | sha) & (F.length("xa") > 200) & (F.length("xb") > 200)
    v = duplicates.verdict(T.title_similarity(F.col("da.title"), F.col("db.title")), F.when(gate, T.text_similarity(F.col("xa"), F.col("xb"))), F.when(gate, T.containment(F.col("xa"), F.col("xb"))), F.lit(None), sha, F.lit(None), F.col("da.page_count") == F.col("db.page_count"))
    want = {(x.a, x.b): (x.v.score, x.v.level) for x in p.select("a", "b", v.alias("v")).where("v.level <> 'distinct'").collect()}
    assert found == want and found


def test_chunks_of_a_very_long_text(spark):
    """More than 1,000 chunks of one document stay apart from the next document's."""
    from vellum.plans import queries

    long = " ".join(f"word{i % 977}" for i in range(420_000))
    chunks = queries._chunks(spark.createDataFrame([(1, long), (2, "a quiet harbour")], "doc_id long, text string"))
    assert chunks.where("material_id = 1").count() > 1000 and chunks.count() == chunks.select("chunk_id").distinct().count()
    asked = spark.createDataFrame([(7, ["harbour"])], "query_id int, must array<string>")
    assert [(r.query_id, r.material_id, r.page) for r in search.chunk_hits(asked, chunks).collect()] == [(7, 2, 0)]


def test_new_rows_meet_all_others(spark):
    """Candidates of new ids are those of all pairs with a new side, whatever class a copy is in."""
    r = random.Random(8)
    names = ["lamp", "river", "stone", "a boat", "no 4", ""]
    rows = [(i, " ".join(r.sample(names, 2)).strip() if i % 5 else "", f"s{i % 11}" if i % 3 == 0 else None, f"m{i % 7}" if i % 4 == 0 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, "id int, title string, sha256 string, md5 string")
    cos = spark.createDataFrame([(1, 50, 0.97), (2, 3, 0.99), (4, 59, 0.5)], "a int, b int, cosine double")
    every = {(x.a, x.b) for x in duplicates.candidate_pairs(docs, cos).collect()}
    new = spark.createDataFrame([(50,), (59,), (13,)], "id int")
    got = [(x.a, x.b) for x in duplicates.candidate_pairs(docs, cos, new).collect()]
    assert len(got) == len(set(got)) and set(got) == {p for p in every if set(p) & {50, 59, 13}} and all(a < b for a, b in every)


def test_clusters_of_a_long_path(spark):
    path = [(i, i + 1) for i in range(1, 500)] + [(500, 0)]
    got = duplicates.clusters(spark.createDataFrame(path, "a int, b int")).collect()
    assert sorted((r.id, r.cluster) for r in got) == [(i, 0) for i in range(501)]


def test_clusters_and_ledger(spark):
    got = {r.id: r.cluster for r in duplicates.clusters(spark.createDataFrame([(3, 9), (9, 12), (1, 3), (20, 21)], "a int, b int")).collect()}
    assert got == {1: 1, 3: 1, 9: 1, 12: 1, 20: 20, 21: 20}
    ledger = spark.createDataFrame([(1, 2, 0.5, "pending"), (3, 4, 0.6, "dismissed"), (5, 6, 0.7, "pending")], "a int, b int, score double, status string")
    found = spark.createDataFrame([(1, 2, 0.9), (3, 4, 0.9), (7, 8, 0.8)], "a int, b int, score double")
    act = lambda inc: {(r.a, r.b): (r.score, r.status, r.action) for r in duplicates.reconcile(ledger, found, inc).collect()}
    assert act(False) == {(1, 2): (0.9, "pending", "rescored"), (3, 4): (0.6, "dismissed", "kept"), (5, 6): (0.7, "pending", "withdrawn"), (7, 8): (0.8, "pending", "raised")}
    assert act(True)[(5, 6)][2] == "kept"


def test_slugs(spark):
    t = spark.createDataFrame([(1, "Hope"), (2, "hope!"), (3, "Hope 2"), (4, "Hope"), (5, "Other")], "arrival int, title string")
    taken = spark.createDataFrame([("hope-3",), ("other",)], "slug string")
    got = {r.arrival: r.slug for r in layout.assign_slugs(t, taken).collect()}
    assert got == {1: "hope", 2: "hope-2", 3: "hope-2-2", 4: "hope-4", 5: "other-2"}


def test_reading_order(spark):
    line = lambda t, x, y, w, h=0.02: ("p", t, 0.9, x, y, w, h)
    rows = [line("Heading across the page", 0.1, 0.9, 0.8, 0.05)] + [line(f"left {i}", 0.1, 0.8 - i / 20, 0.35) for i in range(6)] + [line(f"right {i}", 0.55, 0.8 - i / 20, 0.35) for i in range(6)]
    out = layout.reading_order(spark.createDataFrame(rows, layout.BOXES), "bottom").first().text.split("\n")
    assert out == ["Heading across the page", *(f"left {i}" for i in range(6)), *(f"right {i}" for i in range(6))]
    with pytest.raises(ValueError):
        layout.reading_order(None, "middle")


def test_stems_and_fusion(spark):
    assert [search.porter(w) for w in ("caresses", "ponies", "running", "relational", "hopping", "sky", "agreed")] == ["caress", "poni", "run", "relat", "hop", "sky", "agre"]
    hits = spark.createDataFrame([("q", "title", "a", 0.9, None), ("q", "title", "b", 0.5, None), ("q", "chunk", "b", 2.0, 4)], "query_id string, source string, material_id string, rank double, page int")
    got = {r.material_id: (round(r.score, 6), r.page, r.sources, r.pos) for r in search.rrf(hits).collect()}
    assert got == {"a": (round(1.3 / 61, 6), None, ["title"], 2), "b": (round(1.3 / 62 + 1 / 61, 6), 4, ["chunk", "title"], 1)}


def test_paging(spark):
    rows, about = listing.paginate(spark.range(95), ["id"], 2, 40)
    assert [r.id for r in rows.collect()] == list(range(40, 80)) and about == {"total": 95, "pages": 3, "page": 2, "from": 41, "to": 80, "has_more": True}
