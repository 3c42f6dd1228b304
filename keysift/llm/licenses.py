"""Licence scan by canonical digests, with DataFrame functions only.

A text's canonical form is lower-case ASCII words with single spaces: copyright lines go, equivalent
spellings are made one, punctuation becomes space. Two texts that differ in nothing else have the
same digest, and a table of known digests is joined by hash, never searched by pattern.

The unit that is looked up is an entire text: the document as a whole, and each of its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Notices by which works are put under a licence, and short licences whole.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\");",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache License, Version 2.0.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "This project is licensed under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
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
THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "ISC": [
        "SPDX-License-Identifier: ISC",
        "Licensed under the ISC License.",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "BSD-3-Clause": ["SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 3-Clause License."],
    "BSD-2-Clause": ["SPDX-License-Identifier: BSD-2-Clause", "Licensed under the BSD 2-Clause License."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC0-1.0": ["Licensed under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ],
}

# Spellings that mean the same (of the canonical words, as patterns).
SPELLINGS = [
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("copy right", "copyright"),
    ("per cent", "percent"), ("whilst", "while"), ("favour", "favor"), ("modelled", "modeled"), ("artefact", "artifact"),
    ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("realise", "realize"), ("analyse", "analyze"),
    ("centre", "center"), ("fulfil ", "fulfill "), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"),
]
#: Known texts that a table may hold; it is sent to every task.
MOST_KNOWN = 100_000

COPYRIGHT = r"(?m)^[^a-z0-9\n]*(copyright|copr|\(c\)|©|all rights reserved)[^\n]*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\r", "abcdefghijklmnopqrstuvwxyz"


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line, as an array; null for null."""
    out = F.regexp_replace(F.translate(text, UPPER, LOWER), COPYRIGHT, "")
    out = F.regexp_replace(F.replace(out, F.lit("&"), F.lit(" and ")), r"[^a-z0-9\n]+", " ")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.transform(F.split(out, "\n"), lambda x: F.trim(x))


def one_line(lines: Column) -> Column:
    """A canonical text with its lines joined."""
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def known_licenses(spark: SparkSession, notices: dict[str, list[str]] | None = None) -> DataFrame:
    """``license`` and ``digest`` of the known texts, by default of NOTICES."""
    rows = [(name, text) for name, texts in (notices or NOTICES).items() for text in texts]
    if len(rows) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known texts")
    return spark.createDataFrame(rows, "license string, text string").select(
        "license", F.sha2(one_line(canonical_lines(F.col("text"))), 256).alias("digest")).distinct()


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The licences that documents, or lines of them, state.

    Columns: ``id_col``, ``scope`` ("text": the whole text is the known one; "line": lines of it are),
    ``license`` and ``n`` (lines, or 1), a row per id, scope and license; rows of equal id are
    counted together. A text of one line has both scopes. Null and empty texts, and lines without
    a letter or digit, match nothing; an empty table gives an empty one; other columns are not read.

    Only matches are shuffled. ``known`` (at most MOST_KNOWN rows, as ``known_licenses`` checks) is broadcast.
    """
    lines = docs.select(F.col(id_col).alias("id"), canonical_lines(F.col(text_col)).alias("lines"))
    units = lines.select("id", F.explode(F.concat(
        F.array(F.struct(F.lit("text").alias("scope"), one_line(F.col("lines")).alias("unit"))),
        F.transform("lines", lambda x: F.struct(F.lit("line").alias("scope"), x.alias("unit"))))).alias("u"))
    # coalesce: a digest that can't be null is not worked out a second time to test for it
    digest = F.coalesce(F.sha2("u.unit", 256), F.lit("")).alias("digest")
    units = units.where("u.unit <> ''").select("id", "u.scope", digest)
    return units.join(F.broadcast(known), "digest").groupBy("id", "scope", "license").agg(
        F.count("*").alias("n")).withColumnRenamed("id", id_col)
