"""Hyphens at line ends against a plain fold, and in texts of one long paragraph."""

from __future__ import annotations

import random
import re
import time

from vellum.functions import text as T


def _plain(text):
    done = []
    for line in text.split("\n"):
        last = done[-1] if done else ""
        if done and re.search(r"^\w[-–]$", last[-2:], re.A) and re.match("[a-z]", line):
            w = re.split("[ \t\r\u00a0]", last[:-1])[-1]
            stays = w.lower() in {*T.HYPHEN_PREFIXES, *T.HYPHEN_NUMBERS} or re.search(r"[/:]|(?i:\.[a-z]{2,}$)|-|\d", w, re.A)
            done[-1] = last[:-1] + ("-" if stays else "") + line
        else:
            done.append(line)
    return "\n".join(done)


def test_pieces_are_the_fold(spark):
    r = random.Random(3)
    some = ["a", "re", "non", "Twenty", "twenty", "wor", "d2", "x.com", "é", "B", "/p", " ", " ", "\t", "\u00a0", "\r", "-\n", "-\n", "–\n", "\n", "-", "\n-\n", "self-\nre-\nmade"]
    texts = ["".join(r.choice(some) for _ in range(r.randrange(30))) for _ in range(3000)] + ["", "-\na", "a-\nb-\nc-\nd", "non-\na-\nb", "a-\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9999, None)], "id int, text string")
    got = {x.id: x.t for x in df.select("id", T.dehyphenate(df.text).alias("t")).collect()}
    assert got.pop(9999) is None
    assert [got[i] for i in range(len(texts))] == [_plain(t) for t in texts]


def test_one_long_paragraph_takes_no_square_of_its_lines(spark):
    line = "some words and then a bro-\nken one "
    df = spark.createDataFrame([(line * 12_000,)], "text string")
    start = time.time()
    assert df.select(T.dehyphenate(df.text).alias("t")).first().t == line.replace("-\n", "") * 12_000
    assert time.time() - start < 30
