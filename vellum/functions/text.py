"""Text scalars as Column expressions: no Python on the workers.

Lengths count code points. Unicode white space other than ASCII's counts as white space where a function says so.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def let(c: Column, body) -> Column:
    """body(c) with c worked out once, however often body reads it, also inside lambda functions."""
    return F.element_at(F.transform(F.array(c), body), 1)


# ---- words, shingles, similarity ----------------------------------------------------------------------------------------


@functools.cache
def _folds() -> tuple[str, str]:
    """Letters that decompose to one base letter and accents, and their bases; made from the Unicode tables of this Python."""
    pairs = []
    for c in map(chr, [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not 0x300 <= ord(x) <= 0x36F)
        if len(base) == 1 and base != c:
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_accents(c: Column) -> Column:
    """Accented letters to their bases; loose accents dropped."""
    return F.when(c.rlike("[^\\x00-\\x7f]"), F.regexp_replace(F.translate(c, *_folds()), "[\\u0300-\\u036f]", "")).otherwise(c)


def collapse_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def words(c: Column) -> Column:
    return F.filter(F.split(fold_accents(F.lower(c)), "[^a-z0-9]+"), lambda w: w != "")


def shingles_of(w: Column, k: int = 3) -> Column:
    """Distinct k-word runs of an array of words; fewer than k words: one run of all; none: none."""
    runs = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), " "))
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < k, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(runs))


def shingles(c: Column, k: int = 3) -> Column:
    return let(words(c), lambda w: shingles_of(w, k))


def shingle_ids(c: Column, k: int = 3) -> Column:
    """Hashes of the distinct shingles of a text: what shingles gives, a 64-bit number each, without building the runs."""
    def ids(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < k, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array_distinct(runs))

    return let(words(c), ids)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats: both empty 1, one empty 0."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def jaccard_of_sizes(na: Column, nb: Column, both: Column) -> Column:
    """jaccard of sets of na and nb members, both of them in common."""
    return F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0), 0.0).otherwise(both / (na + nb - both))


def containment_of_sizes(na: Column, nb: Column, both: Column) -> Column:
    return F.when((na == 0) | (nb == 0), 0.0).otherwise(both / F.least(na, nb))


def containment_of(a: Column, b: Column) -> Column:
    """Shared share of the smaller; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def text_similarity(a: Column, b: Column, k: int = 3) -> Column:
    return jaccard(shingles(a, k), shingles(b, k))


def containment(a: Column, b: Column, k: int = 3) -> Column:
    return containment_of(shingles(a, k), shingles(b, k))


# ---- titles ------------------------------------------------------------------------------------------------------------------

# Marks that a title sheds, words that carry no meaning in it, abbreviations that stay upper case.
EXTENSION = r"(?i)\.(?:pdf|docx?|jpe?g|png)$"
COPY_BEFORE = r"(?i)^\s*copy\s+of\s+"
COPY_AFTER = r"(?i)(?:[-–—\s]*\(?\bcopy\b\s*\d*\)?|\s*\(\d+\))\s*$"
DATED_PREFIX = r"(?i)^\d{4}[-_]\d{2}[-_](?:[a-z]+[-_])?"
SERIES = r"(?:\b(?:vol(?:ume)?|part|no)\.?\s*)?(\d{1,3})\s*$"
TITLE_NOISE = ("the", "a", "an", "of", "for", "and", "to", "in", "on", "is")
ABBREVIATIONS = ("KJV", "NIV", "NKJV", "ESV", "NLT", "NASB", "RSV", "ASV", "AMP", "MSG", "TV", "DVD", "CD", "PDF", "UK", "USA", "OT", "NT", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII")


def _shed(c: Column) -> Column:
    for mark in (EXTENSION, COPY_BEFORE, COPY_AFTER, DATED_PREFIX):
        c = F.regexp_replace(c, mark, "")
    return c


def normalise_title(c: Column, fold_curly: bool = False) -> Column:
    """The form in which titles are compared. Only ASCII quotes join what stands beside them, unless fold_curly."""
    quotes = "['`‘’]" if fold_curly else "['`]"
    return F.trim(F.regexp_replace(F.regexp_replace(_shed(F.lower(fold_accents(c))), quotes, ""), "[^a-z0-9]+", " "))


def title_tokens(c: Column) -> Column:
    def pick(every: Column) -> Column:
        kept = F.filter(every, lambda w: ~w.isin(*TITLE_NOISE))
        return F.array_distinct(F.when(F.size(kept) > 0, kept).otherwise(every))

    return let(F.filter(F.split(normalise_title(c), " "), lambda w: w != ""), pick)


def title_overlap_of(na: Column, nb: Column, ta: Column, tb: Column) -> Column:
    """From normalised titles and their tokens."""
    return F.when((na == "") & (nb == ""), 1.0).when((na == "") | (nb == ""), 0.0).when(na == nb, 1.0).otherwise(jaccard(ta, tb))


def title_series(n: Column) -> Column:
    """struct(stem, number) of a normalised title: what is left without a number at its end, and that number."""
    return F.struct(F.trim(F.regexp_replace(n, SERIES, "")).alias("stem"), F.regexp_extract(n, SERIES, 1).alias("number"))


def is_sequel(na: Column, nb: Column, sa: Column, sb: Column) -> Column:
    """Whether titles differ only in their number in a series; from normalised titles and their title_series."""
    return (na != "") & (nb != "") & (na != nb) & (sa.stem == sb.stem) & (sa.number != sb.number)


def title_similarity_of(na: Column, nb: Column, ta: Column, tb: Column) -> Column:
    """title_overlap_of, but 0 for titles that differ only in their number in a series."""
    return F.when(is_sequel(na, nb, title_series(na), title_series(nb)), 0.0).otherwise(title_overlap_of(na, nb, ta, tb))


def title_overlap(a: Column, b: Column) -> Column:
    return title_overlap_of(normalise_title(a), normalise_title(b), title_tokens(a), title_tokens(b))


def title_similarity(a: Column, b: Column) -> Column:
    return title_similarity_of(normalise_title(a), normalise_title(b), title_tokens(a), title_tokens(b))


def _raise_first(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))


def clean_title(c: Column) -> Column:
    """A title that reads as a name again: marks shed, slugs and shouting recased, anything else as typed."""
    raw = F.trim(c)
    bare = F.trim(collapse_ws(F.regexp_replace(_shed(raw), "[-_]+", " ")))
    slug = ~c.contains(" ") & c.rlike("[-_]")
    shouting = (bare == F.upper(bare)) & bare.rlike("[A-Z]{4,}")
    recased = F.array_join(F.transform(F.split(F.lower(bare), " "), lambda w, i: F.when((i > 0) & w.isin(*TITLE_NOISE), w).otherwise(_raise_first(w))), " ")
    return F.when(bare == "", raw).when(slug | shouting, recased).otherwise(bare)


def title_case(c: Column) -> Column:
    """Display case: first letters raised, spacing kept. Words with digits or inner capitals stay; so do all-capital
    words unless the whole title has no small letter; abbreviations are upper."""
    return let(F.struct(F.trim(c).alias("t"), (~c.rlike(r"\p{Ll}")).alias("shouted")), lambda x: _cased(x["t"], x["shouted"]))


def _cased(t: Column, shouted: Column) -> Column:
    def word(w: Column) -> Column:
        letters = F.regexp_replace(w, r"[^\p{L}]", "")
        lead, first, rest = (F.regexp_extract(w, r"(?s)^([^\p{L}]*)(\p{L})(.*)$", i) for i in (1, 2, 3))
        raised = F.concat(lead, F.upper(first), F.lower(rest))
        return (
            F.when(~w.rlike(r"\p{L}") | w.rlike(r"\d") | w.rlike(r"\p{Ll}\p{Lu}"), w)
            .when(F.upper(letters).isin(*ABBREVIATIONS), F.upper(w))
            .when(~shouted & (F.length(letters) > 1) & (letters == F.upper(letters)), w)
            .otherwise(raised)
        )

    return F.array_join(F.transform(F.regexp_extract_all(t, F.lit(r"((?U)\s+|[^\s]+)"), 1), word), "")


def slugify(c: Column) -> Column:
    """ASCII letters and digits joined by hyphens, 60 signs at most; `item` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(fold_accents(c)), "['`]", ""), "[^a-z0-9]+", "-")
    s = F.regexp_replace(F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, 60), "^-+|-+$", "")
    return F.when(s == "", "item").otherwise(s)


def title_from_filename(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(c, r"(?i)\.pdf$", ""), "[-_]+", " ")
    return F.trim(collapse_ws(F.regexp_replace(s, r"\s*\(\d+\)\s*$", "")))


def title_from_url(c: Column) -> Column:
    """The last path segment, decoded, as a title; an address that is none gives an empty one."""
    path = F.try_parse_url(c, F.lit("PATH"))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    last = F.try_url_decode(F.regexp_replace(F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit("")), r"\+", "%2B"))
    return F.coalesce(title_from_filename(last), F.lit(""))


def title_is_usable(c: Column) -> Column:
    return F.length(F.trim(c)) >= 2


# ---- recognised text -------------------------------------------------------------------------------------------------------

# Prefixes and number words whose hyphen stays at a line's end.
HYPHEN_PREFIXES = ("self", "anti", "cross")
HYPHEN_NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand")
# Thresholds and notes of the quality score.
USABLE = 0.55
NOTE_EMPTY = "No text was read from this page."
NOTE_LITTLE = "Very little text was read — the page may be an image or a cover."
NOTE_JUNK = "% of words look like OCR noise."
NOTE_SINGLE = "The text is broken into stray single letters."
NOTE_SIGNS = "Much of the text is punctuation or symbols rather than words."
NOTE_SHORT = "Words are unusually short, which suggests a poor read."
NOTE_CLEAN = "The text reads cleanly."


def dehyphenate(c: Column) -> Column:
    """Join words split over lines; a hyphen that belongs to the word stays. The text is cut where words are split; what a hyphen does depends on the word before it alone, which a fold over the pieces
    hands on where a piece is no more than a part of a word."""
    pieces = F.split(c, r"(?<=\w)[-–]\n(?=[a-z])")

    def join(done: Column, piece: Column) -> Column:
        def judge(tail: Column) -> Column:
            before = F.when(F.length(tail) == F.length(piece), F.concat(done.word, F.when(F.right(done.signs, F.lit(1)) == "-", "-").otherwise(""))).otherwise("")
            return let(F.concat(before, tail), lambda w: F.struct(w.alias("word"), F.concat(done.signs, F.when(_stays(w), "-").otherwise(" ")).alias("signs")))

        return let(F.substring_index(F.translate(piece, "\t\r\u00a0\n", "    "), " ", -1), judge)

    def whole(p: Column) -> Column:
        start = F.struct(F.lit("").alias("word"), F.lit("").alias("signs"))
        signs = F.aggregate(F.slice(p, F.lit(1), F.size(p) - 1), start, join, lambda x: x.signs)
        return let(signs, lambda s: F.array_join(F.transform(p, lambda x, i: F.concat(x, F.when(F.substr(s, i + 1, F.lit(1)) == "-", "-").otherwise(""))), ""))

    return F.when(F.size(pieces) < 2, c).otherwise(let(pieces, whole))


def _stays(w: Column) -> Column:
    return F.lower(w).isin(*HYPHEN_PREFIXES, *HYPHEN_NUMBERS) | w.rlike("[/:]") | w.rlike(r"(?i)\.[a-z]{2,}$") | w.contains("-") | w.rlike(r"\d")


def looks_invented(token: Column) -> Column:
    """Whether a recogniser made the token up: no vowel, or a row of one sign."""
    bare = F.regexp_replace(token, r"^[^\w]+|[^\w]+$", "")
    return F.when(bare == "", token.rlike(r"^([^\w\s])\1{2,}$")).otherwise((F.length(bare) >= 3) & bare.rlike("(?i)[a-z]") & (bare != F.upper(bare)) & ~bare.rlike("(?i)[aeiouy]"))


def strip_invented(c: Column) -> Column:
    """Blank invented tokens, keep the lines."""
    pieces = F.regexp_extract_all(c, F.lit(r"((?U)\s+|[^\s]+)"), 1)
    kept = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^(?U)\s+$") | ~looks_invented(p), p).otherwise("")), "")
    return F.regexp_replace(F.regexp_replace(kept, r"[^\S\n]{2,}", " "), r"(?m)^[^\S\n]+|[^\S\n]+$", "")


def count_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def surviving_share(before: Column, after: Column) -> Column:
    return F.when(count_words(before) == 0, 1.0).otherwise(count_words(after) / count_words(before))


def score_text(c: Column) -> Column:
    """struct(score, notes, usable) of a recognised text. Tokens are counted over the whole text, a pattern each, without cutting it up."""
    solid = r"[^\p{IsWhite_Space}]"
    token = lambda body: rf"(?<!{solid})(?:{body})(?!{solid})"
    junk = rf"(?:(?![a-zA-Z0-9]){solid})+|[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]{{3,}}|(?={solid}{{1,6}}(?!{solid}))(?={solid}*[a-zA-Z])(?={solid}*[0-9]){solid}+"

    def shares(t: Column) -> Column:
        n = F.regexp_count(t, F.lit(rf"{solid}+"))
        share = lambda body: F.regexp_count(t, F.lit(token(body))) / n
        letters = F.length(F.regexp_replace(t, "[^a-zA-Z]+", "")) / F.length(t)
        mean = F.length(F.regexp_replace(t, r"\p{IsWhite_Space}+", "")) / n
        return F.struct(n.alias("n"), share(junk).alias("junk"), share("[a-zA-Z0-9]").alias("single"), letters.alias("letters"), mean.alias("mean"))

    def verdict(x: Column) -> Column:
        score = F.lit(1.0) - F.least(F.lit(0.6), x.junk * 2) - F.least(F.lit(0.3), F.greatest(F.lit(0.0), x.single - 0.05) * 1.5) - F.least(F.lit(0.3), F.greatest(F.lit(0.0), F.lit(0.75) - x.letters)) - F.when(x.n < 20, 0.15).otherwise(0.0)
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
        said = F.filter(
            F.array(
                F.when(x.n < 20, NOTE_LITTLE),
                F.when(x.junk > 0.15, F.concat(F.round(x.junk * 100).cast("int").cast("string"), F.lit(NOTE_JUNK))),
                F.when(x.single > 0.2, NOTE_SINGLE),
                F.when(x.letters < 0.6, NOTE_SIGNS),
                F.when(x.mean < 2.5, NOTE_SHORT),
            ),
            lambda s: s.isNotNull(),
        )
        return F.struct(F.round(score, 3).alias("score"), F.when(F.size(said) == 0, F.array(F.lit(NOTE_CLEAN))).otherwise(said).alias("notes"), (score >= USABLE).alias("usable"))

    empty = F.struct(F.lit(0.0).alias("score"), F.array(F.lit(NOTE_EMPTY)).alias("notes"), F.lit(False).alias("usable"))
    filled = lambda t: let(shares(t), verdict)
    return let(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), lambda t: F.when(t == "", empty).otherwise(filled(t)))


# ---- chunks ----------------------------------------------------------------------------------------------------------------


def chunk_count(n: Column, most: int = 350, overlap: int = 40) -> Column:
    return F.when(n == 0, 0).when(n <= most, 1).otherwise(F.ceil((n - most) / (most - overlap)).cast("int") + 1)


def chunk_words(w: Column, most: int = 350, overlap: int = 40) -> Column:
    """Overlapping runs of an array of words, each as a text."""
    k = chunk_count(F.size(w), most, overlap)
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.array_join(F.slice(w, i * (most - overlap) + 1, most), " ")))


def plain_words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def chunk_page(c: Column, most: int = 350, overlap: int = 40) -> Column:
    return let(plain_words(c), lambda w: chunk_words(w, most, overlap))


def document_text(c: Column, most: int = 1200) -> Column:
    return F.array_join(F.slice(plain_words(c), 1, most), " ")


# ---- sheets and links -----------------------------------------------------------------------------------------------------

# Cells that stand for no topic; names that only mean this machine or network.
PLACEHOLDERS = ("reviewmanually", "review", "tbd", "tba", "na", "none", "pending")
LOCAL_NAMES = r"^(localhost|localhost\.localdomain|metadata\.google\.internal)$|\.(localhost|local|internal|intranet|lan|home|corp)$"
REASONS = {"empty": "That link is empty.", "invalid": "That is not a valid link.", "scheme": "Only http and https links can be imported.", "login": "Links with a username or password are not accepted.", "private": "That address is on a private network."}


def is_placeholder(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "").isin("", *PLACEHOLDERS)


def split_topics(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[,;|/]"), lambda t: F.trim(collapse_ws(t))), lambda t: (t != "") & ~is_placeholder(t))


def file_id_from_url(c: Column) -> Column:
    by_path = F.regexp_extract(c, r"/d/([A-Za-z0-9_-]+)", 1)
    by_query = F.regexp_extract(c, r"[?&]id=([A-Za-z0-9_-]+)", 1)
    return F.when(by_path != "", by_path).otherwise(F.nullif(by_query, F.lit("")))


def is_link(c: Column) -> Column:
    return c.rlike("(?i)^https?://")


def _ipv4(host: Column) -> Column:
    """The address as one number, in any of the spellings that a browser takes (one to four parts, each decimal, octal after a 0 or hexadecimal
    after 0x; the last part fills what is left); null if it is none."""
    parts = F.split(F.regexp_replace(host, r"\.$", ""), r"\.")
    spelt = host.rlike(r"^(0[xX][0-9a-fA-F]*|[0-9]+)(\.(0[xX][0-9a-fA-F]*|[0-9]+)){0,3}\.?$")

    def number(x: Column) -> Column:
        digits = F.when(x.rlike("^0[xX]"), F.conv(F.concat(F.lit("0"), F.substr(x, F.lit(3))), 16, 10)).when(x.rlike("^0[0-7]+$"), F.conv(x, 8, 10)).when(x.rlike("^0[0-9]+$"), None).otherwise(x)
        return digits.try_cast("decimal(30,0)")

    n = F.transform(parts, number)
    low = F.element_at(n, -1)
    room = F.element_at(F.array(*(F.lit(x).cast("decimal(30,0)") for x in (1 << 32, 1 << 24, 1 << 16, 1 << 8))), F.least(F.size(parts), F.lit(4)))
    heads = F.slice(n, 1, F.size(parts) - 1)
    high = F.aggregate(F.transform(heads, lambda x, i: x * F.element_at(F.array(F.lit(1 << 24), F.lit(1 << 16), F.lit(1 << 8)), i + 1)), F.lit(0).cast("decimal(38,0)"), lambda acc, x: (acc + x).cast("decimal(38,0)"))
    fits = F.forall(n, lambda x: x.isNotNull()) & F.forall(heads, lambda x: x <= 255) & (low < room)
    return F.when(spelt, F.when(fits, (high + low).cast("long")))


#: Signs of host names in their full width, and ideographic full stops.
FULL_WIDTH = "".join(chr(0xFEE0 + x) for x in range(0x21, 0x7F)) + "\u3002\uff61"
PLAIN_WIDTH = "".join(map(chr, range(0x21, 0x7F))) + ".."


def _private_ipv4(host: Column) -> Column:
    return _private_number(_ipv4(host))


def _private_number(n: Column) -> Column:
    a, b = F.shiftright(n, 24), F.shiftright(n, 16) % 256
    return F.coalesce(
        a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & b.isin(0, 168)) | ((a == 100) & b.between(64, 127)) | ((a == 198) & b.isin(18, 19)) | (a >= 224),
        F.lit(False),
    )


def is_private_host(c: Column) -> Column:
    host = F.regexp_replace(F.lower(c), r"\.$", "")
    v6 = F.regexp_extract(host, r"^\[(.*)\]$", 1)
    mapped = F.regexp_extract(v6, "^(?:0*:)*:?ffff:([^:]*[.][^:]*)$", 1)
    halves = [F.conv(F.regexp_extract(v6, "^(?:0*:)*:?ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$", k), 16, 10).try_cast("long") for k in (1, 2)]
    mapped_private = F.when(mapped != "", mapped.rlike(LOCAL_NAMES) | _private_ipv4(mapped)).when(halves[0].isNotNull(), _private_number(halves[0] * 65536 + halves[1])).otherwise(False)
    private_v6 = v6.rlike("^[0:]*:[0:]*1?$") | v6.rlike("^f[cd]|^fe[89ab]") | mapped_private
    return F.when(host == "", True).when(host.rlike(LOCAL_NAMES), True).when(host.startswith("[") & host.endswith("]"), private_v6).otherwise(_private_ipv4(host))


def vet_url(c: Column) -> Column:
    """struct(ok, reason): whether a pasted link may be fetched. Hosts are read as a browser reads them: full-width signs are folded, numbers may be
    short, octal or hexadecimal."""
    t = F.trim(c)
    scheme = F.lower(F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(t, r"^[A-Za-z][A-Za-z0-9+.-]*:/*([^/?#\\]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":\d*$", "")
    host = F.translate(host, FULL_WIDTH, PLAIN_WIDTH)
    number = host.rlike(r"(^|\.)(0[xX][0-9a-fA-F]*|[0-9]+)\.?$")
    reason = (
        F.when(t == "", REASONS["empty"])
        .when(scheme == "", REASONS["invalid"])
        .when(~scheme.isin("http", "https"), REASONS["scheme"])
        .when((host == "") | host.rlike(r"[\s<>^|%]"), REASONS["invalid"])
        .when(authority.contains("@"), REASONS["login"])
        .when(number & _ipv4(host).isNull(), REASONS["invalid"])
        .when(is_private_host(host), REASONS["private"])
    )
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


# ---- names, times, states -------------------------------------------------------------------------------------------------


def download_name(c: Column, fallback: str = "material") -> Column:
    """A file name for a title: accents, quotes, separators and reserved signs dropped, 120 signs, no dot or blank at the end."""
    s = F.regexp_replace(fold_accents(c), r"""["'\\/\n\r\t<>:|?*]""", "")
    s = F.regexp_replace(F.substring(F.trim(collapse_ws(s)), 1, 120), r"[\s.]+$", "")
    return F.concat(F.when(s == "", fallback).otherwise(s), F.lit(".pdf"))


def time_ago(ts: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_millis(now) - F.unix_millis(ts)) / 60000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    plural = lambda n, one: F.concat(n.cast("string"), F.when(n == 1, f" {one} ago").otherwise(f" {one}s ago"))
    return F.when(minutes < 1, "just now").when(minutes < 60, plural(minutes, "min")).when(hours < 24, plural(hours, "hour")).when(days == 1, "yesterday").when(days < 30, plural(days, "day")).otherwise(F.date_format(ts, "d MMM yyyy"))


def display_name(name: Column, email: Column) -> Column:
    blank_to_null = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank_to_null(name), blank_to_null(F.split_part(email, F.lit("@"), F.lit(1))), F.lit("unknown"))


def invitation_state(accepted: Column, revoked: Column, expires: Column, now: Column) -> Column:
    return F.when(accepted.isNotNull(), "accepted").when(revoked.isNotNull(), "revoked").when(expires <= now, "expired").otherwise("open")


def fingerprint(content: Column) -> Column:
    """struct(sha256, byte_size) of bytes or text."""
    return F.struct(F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("byte_size"))
