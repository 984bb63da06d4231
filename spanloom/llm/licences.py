"""License scans: canonical digests of entire texts, joined to the digests of known licences.

A unit of text is the whole document and, so that notices above other prose are seen, each of
its lines.  Units are canonicalised alike on both sides: case folded, copyright lines dropped,
punctuation and white space reduced to single spaces, equivalent spellings made one.  The
SHA-256 of the result is hash-joined to the table of known digests.  A unit whose first word
starts no known licence cannot have a known digest and is not digested; that is exact and
leaves one cheap pass over most text.  Built-in functions only.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.licence_list import more_known

# Public licence notices and short licence texts, with their SPDX identifiers.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MIT", """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Copyright <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
)

# What starts a notice of copyright; a wrapped line of a licence may start with the bare word.  The patterns mean
# the same to Java and to RE2.
NOTICE_LINE = (r"^[^a-z0-9©]*(copyright[ \t:,]*(\(c\)|[©<\[{]|(19|20)[0-9]{2})|©|all rights reserved"
               r"|c\)[ \t]*(copyright|[©<\[{]|(19|20)[0-9]{2}))")
PUNCTUATION = r"[\x00-\x2F:-@\[-`{-\x7F\x{A0}-\x{BF}\x{2000}-\x{206F}\x{3000}-\x{303F}]+"

WORD = PUNCTUATION.replace("[", "[^", 1)

# Spellings that public matching guidelines treat as equal; the second replaces the first.
SPELLINGS = (
    ("licence", "license"), ("authoris", "authoriz"), ("organis", "organiz"), ("recognis", "recogniz"),
    ("utilis", "utiliz"), ("customis", "customiz"), ("initialis", "initializ"), ("merchandis", "merchandiz"),
    ("favour", "favor"), ("honour", "honor"), ("labour", "labor"), ("behaviour", "behavior"),
    ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("catalogue", "catalog"),
    ("analogue", "analog"), ("artefact", "artifact"), ("fulfilment", "fulfillment"), ("whilst", "while"),
    ("programme", "program"), ("https", "http"),
)
# The same, of two words.
PHRASES = (("sub license", "sublicense"), ("non commercial", "noncommercial"), ("non infring", "noninfring"),
           ("per cent", "percent"), ("copyright owner", "copyright holder"))


def _respell(form: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        form = F.replace(form, F.lit(old), F.lit(new))
    return form


def text_lines(text: Column) -> Column:
    """Lower-case lines, without copyright lines and lines that have no word."""
    return F.filter(F.split(F.lower(text), "\n"),
                    lambda x: F.rlike(x, F.lit(WORD)) & ~F.rlike(x, F.lit(NOTICE_LINE)))


def canonical(body: Column) -> Column:
    """Kept lines of a unit with single spaces for punctuation and one spelling."""
    form = F.trim(F.regexp_replace(body, PUNCTUATION, " "))
    return _respell(_respell(form, SPELLINGS), PHRASES)


def first_word(body: Column) -> Column:
    """The first word of the canonical form, before words are joined."""
    return _respell(F.regexp_extract(body, WORD, 0), SPELLINGS)


def known_digests(spark: SparkSession) -> DataFrame:
    """``license_id, digest, first_word`` of the notices above and of ``licence_list``."""
    body = F.array_join(text_lines(F.col("text")), "\n")
    ids, texts = zip(*more_known(NOTICES))
    return (spark.createDataFrame(pa.table({"license_id": ids, "text": texts}))  # of known size, as the join needs
            .select("license_id", F.sha2(canonical(body), 256).alias("digest"), first_word(body).alias("first_word"))
            .distinct())


def scan_licences(docs: DataFrame, known: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``id_col, license_id, notice_ids, n_notices`` per document.

    ``license_id`` is the licence the entire text is (the least if several have the digest),
    ``notice_ids`` the sorted licences whose notice is a line of it, joined by commas, and
    ``n_notices`` the number of such lines.  The join strategy follows the size of ``known``.

    Null and empty text, and text of punctuation or copyright lines only: no licence, no
    notices.  Repeated rows come out as often as they came in; equal ids with different texts
    stay apart.  Empty tables give empty results; further columns are not carried.
    """
    known = known.where(F.col("first_word") != "")
    openings = known.select(F.col("first_word").alias("opening")).distinct()
    by_digest = known.groupBy("digest").agg(F.min("license_id").alias("known_id"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"),
                       F.coalesce(text_lines(F.col(text_col)), F.array().cast("array<string>")).alias("lines"))
    whole = F.array(F.struct(F.lit(True).alias("whole"), F.array_join("lines", "\n").alias("body")))
    lines = F.transform("lines", lambda x: F.struct(F.lit(False).alias("whole"), x.alias("body")))
    units = (rows.select("id", "text_key", F.explode(F.concat(whole, lines)).alias("unit"))
             .select("id", "text_key", "unit.whole", "unit.body", first_word(F.col("unit.body")).alias("first")))
    digested = (units.join(openings, F.col("first") == F.col("opening"), "left")
                .select("id", "text_key", "whole",
                        F.when(F.col("opening").isNotNull(), F.sha2(canonical(F.col("body")), 256)).alias("digest")))
    hit = F.col("known_id").isNotNull() & ~F.col("whole")
    found = (digested.join(by_digest, "digest", "left")
             .groupBy("id", "text_key")
             .agg(F.sum(F.col("whole").cast("int")).alias("copies"),
                  F.min(F.when(F.col("whole"), F.col("known_id"))).alias("license_id"),
                  F.array_join(F.sort_array(F.collect_set(F.when(hit, F.col("known_id")))), ",").alias("notice_ids"),
                  F.sum(hit.cast("bigint")).alias("hits")))
    return (found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select(F.col("id").alias(id_col), "license_id", "notice_ids",
                    F.expr("hits div copies").alias("n_notices")))
