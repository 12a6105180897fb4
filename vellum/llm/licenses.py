"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Built of DataFrame and SQL functions alone.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle

# Names and wordings of license notices. Whole texts stand in license_texts.
TEMPLATES = (
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0-line", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0-line", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mit-line", "Released under the MIT License."),
    ("bsd-style-line", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl-2.0-notice", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl-2.1-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense-notice", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

#: Words of a shingle and hash functions. A window is two neighbouring shingles, so windows overlap by half. Each hash function is a band of its
#: own: a window with Jaccard s to a template's window shares a band with probability 1 - (1 - s) ** BANDS. A template of one shingle has
#: s >= 1/2 to both windows that hold it (0.996 in each), and every window inside a longer one has s = 1.
SHINGLE, BANDS = 5, 8
#: Template words up to which band tables are broadcast (a few MB), and ids of texts that hold a band.
BROADCAST_WORDS, BROADCAST_IDS = 200_000, 4_000_000


def texts() -> list[tuple[str, str]]:
    """(name, body) of every template: the notices above and the whole texts beside this module."""
    return [*TEMPLATES, *((f.stem, f.read_text()) for f in sorted(Path(__file__).with_name("license_texts").glob("*.txt")))]


def word_array(text: Column) -> Column:
    """Words of ASCII letters and digits and whatever is not ASCII, lower-cased; signs are left out."""
    return F.filter(F.split(F.lower(text), r"[\x00-/:-@\[-`{-\x7f]+"), lambda w: w != "")


def shingle_hashes(words: str = "w") -> Column:
    """Hashes of the shingles of an array of words, in order; of fewer words than a shingle, one of all of them; of none, none."""
    each = f"transform(sequence(0, size({words}) - {SHINGLE}), k -> xxhash64({', '.join(f'{words}[k + {i}]' for i in range(SHINGLE))}))"
    return F.expr(f"if(size({words}) = 0, cast(array() as array<bigint>), if(size({words}) < {SHINGLE}, array(xxhash64(array_join({words}, ' '))), {each}))")


def bands(texts: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each band of each window of texts (s: shingles, and the columns to keep): k, the window's first shingle, and key, the least value of a
    hash function over the window. A hash function is the shingles' hash with some of its bits turned over."""
    pairs = F.expr("inline(transform(s, (x, k) -> struct(k as k, x as x, coalesce(get(s, k + 1), x) as y)))")
    turned = [0x9E3779B97F4A7C15 * (i + 1) % (1 << 64) for i in range(BANDS)]
    turned = [x - (1 << 64) if x >> 63 else x for x in turned]
    each = [f"xxhash64({i}, least(x ^ {c}L, y ^ {c}L))" for i, c in enumerate(turned)]
    return texts.select(*keep, pairs).select(*keep, "k", F.explode(F.expr(f"array({', '.join(each)})")).alias("key"))


def templates(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """(name, ordered, shingles, n_template): the shingles of each template in order, and the distinct ones."""
    # explode of one-element arrays: what the next expression reads many times is made once
    df = spark.createDataFrame(rows, "name string, body string").select("name", F.explode(F.array(word_array(F.col("body")))).alias("w"))
    df = df.select("name", F.explode(F.array(shingle_hashes())).alias("ordered"))
    return df.withColumn("shingles", F.array_distinct("ordered")).withColumn("n_template", F.size("shingles")).where("n_template > 0")


def retrieve(docs: DataFrame, known: DataFrame, small: bool) -> DataFrame:
    """(doc_id, name, place): windows of docs (doc_id, text) that share a band with a window of a template. place numbers stretches of the
    text as long as the template (four shingles at least)."""
    banded = bands(known.select("name", "n_template", F.col("ordered").alias("s")), ["name", "n_template"]).select("key", "name", "n_template").distinct()
    own = docs.select("doc_id", F.explode(F.array(word_array(F.col("text")))).alias("w")).select("doc_id", F.explode(F.array(shingle_hashes())).alias("s"))
    met = bands(own, ["doc_id"]).join(F.broadcast(banded) if small else banded, "key")
    return met.select("doc_id", "name", F.expr("cast(k div greatest(4, n_template) as int)").alias("place")).distinct()


def scan(docs: DataFrame, containment: float = 0.75, rows: list[tuple[str, str]] | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, name, first_word, n_shared, containment): every template that a document holds, where it holds it best (the first such place).

    Windows of two shingles retrieve templates by equal bands. For each stretch with a hit, the shingles of it and of as much on each side
    are compared with the template's: the pair stays when they hold at least `containment` of the template's distinct shingles. first_word is
    the word at which the first shared shingle begins. Null, empty and unmatched texts give no rows; of rows that repeat an id the best
    place counts; places that are equally good: the first. Whole texts of templates, however long, are one template each.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = texts() if rows is None else list(rows)
    known = templates(spark, rows)
    small = sum(len(b.split()) for _, b in rows) <= BROADCAST_WORDS
    hits = settle(retrieve(own, known, small))
    names = hits.select("doc_id").distinct()
    if hits.count() <= BROADCAST_IDS:
        names = F.broadcast(names)
    held = own.join(names, "doc_id", "left_semi").select("doc_id", F.explode(F.array(word_array(F.col("text")))).alias("words"))
    sides = known.select("name", "shingles", "n_template")
    near = held.join(hits, "doc_id").join(F.broadcast(sides) if small else sides, "name")
    near = near.withColumn("from", F.expr("greatest(0, (place - 1) * greatest(4, n_template))")).withColumn("w", F.explode(F.array(F.expr(f"slice(words, from + 1, 3 * greatest(4, n_template) + {SHINGLE})"))))
    near = near.select("doc_id", "name", "shingles", "n_template", "from", F.explode(F.array(shingle_hashes())).alias("s"))
    found = near.withColumn("shared", F.array_intersect("s", "shingles")).withColumn("n_shared", F.size("shared"))
    found = found.where((F.col("n_shared") > 0) & (F.col("n_shared") >= F.ceil(F.lit(containment) * F.col("n_template"))))
    found = found.withColumn("first_word", F.expr("from + cast(array_position(s, shared[0]) as int) - 1"))
    best = found.groupBy("doc_id", "name").agg(F.max(F.struct("n_shared", (-F.col("first_word")).alias("back"))).alias("b"), F.max("n_template").alias("n_template"))
    return best.select("doc_id", "name", (-F.col("b.back")).alias("first_word"), F.col("b.n_shared").alias("n_shared"), (F.col("b.n_shared") / F.col("n_template")).alias("containment"))
