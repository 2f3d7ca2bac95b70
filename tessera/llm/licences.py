"""Licence scan by canonical digest lookup.

A text is put into a canonical form: lower case; equivalent spellings made
one (licence / license, sub-licence, (c) and the copyright sign, curly quotes,
hyphens, http / https and www); copyright lines and "all rights reserved"
lines dropped; everything that is not a letter or a digit one space.  The
SHA-256 of the canonical form is hash-joined to the digests of known licence
texts, made by the same expressions, so only an entire text can match.

Entire texts are, for each row: the whole document, and each of its lines,
because short notices ("Released under the MIT License.") stand on lines of
their own.  Lines are exploded without any cap; a pattern that every text of
the list below holds (``HINT``) spares the others the canonical form, and a
length that no known text has spares the digest.  Matches are few; they are
joined to the known table (a fixed list, broadcast) before the only shuffle.

DataFrame functions only.

Defined cases: null, empty or wordless texts match nothing; repeated matches
in a document count once per licence with ``n_matches`` lines; a row without a
match keeps a row with null licence columns; rows with equal ids (repeated
rows) are one document, and so are rows with a null id; an empty table gives
an empty result; extra columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Known notices and short licences, by SPDX identifier.
KNOWN = [
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("MIT", "notice", "This project is licensed under the MIT License."),
    ("MIT", "identifier", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "identifier", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "notice", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "identifier", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "identifier", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "identifier", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "notice", "Released under CC0 1.0."),
    ("BSD-3-Clause", "notice", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "notice", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "identifier", "SPDX-License-Identifier: BSD-3-Clause"),
    ("ISC", "text",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
     "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
     "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
     "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
     "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
     "USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "text",
     "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
     "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
     "the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
     "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
     "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
     "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
     "IN THE SOFTWARE."),
    ("Zlib", "text",
     "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
     "liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software "
     "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
     "following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you "
     "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
     "would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not "
     "be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source "
     "distribution."),
]

# Every text of KNOWN holds one of these, whatever its spelling.
HINT = r"licen[cs]e|cc0|cc by|permission"

# Spellings made one, applied in this order to lower-case text.
SPELLINGS = [
    (r"licence", "license"),
    (r"sub-license", "sublicense"),
    (r"non-infringement", "noninfringement"),
    (r"acknowledgement", "acknowledgment"),
    (r"https?://(www\.)?", ""),
    (r"©|\(c\)", "copyright "),
    (r"\bversion ([0-9])", "$1"),
    (r"\bv([0-9])", "$1"),
]
COPYRIGHT_LINE = r"(?m)^[^a-z0-9]*(copyright .*|all rights reserved.*)$"
NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text (empty for null or wordless texts)."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, to)
    out = F.regexp_replace(out, COPYRIGHT_LINE, "")
    return F.trim(F.regexp_replace(out, NOT_WORD, " "))


def known_digests(spark: SparkSession, known: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(digest, license_id, kind, size) of the known texts, once per digest."""
    rows = spark.createDataFrame(known or KNOWN, "license_id string, kind string, text string")
    rows = rows.withColumn("canon", canonical(F.col("text"))).where("canon != ''")
    return (rows.groupBy(F.sha2("canon", 256).alias("digest"))
            .agg(F.min("license_id").alias("license_id"), F.min("kind").alias("kind"), F.min(F.length("canon")).alias("size")))


def scan(df: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
         hint: str | None = None) -> DataFrame:
    """One row per document, licence, kind and scope (document or line) found,
    and one with nulls for a document without any.  ``hint``: a pattern that
    every lower-case text that matches ``known`` holds; None reads all."""
    if known is None:
        known, hint = known_digests(df.sparkSession), HINT
    sizes = [r["size"] for r in known.select("size").distinct().collect()]          # at most one per known text
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    whole = docs.select("id", F.lit("document").alias("scope"), F.col("t").alias("u"))
    lines = (docs.where(F.instr("t", "\n") > 0)
             .select("id", F.lit("line").alias("scope"), F.explode(F.split("t", "\n", -1)).alias("u")))
    units = whole.unionByName(lines)
    if hint:
        units = units.where(F.lower("u").rlike(hint))
    found = (units.withColumn("canon", canonical(F.col("u"))).where(F.length("canon").isin(sizes))
             .withColumn("digest", F.sha2("canon", 256))
             .join(F.broadcast(known.select("digest", "license_id", "kind")), "digest"))
    hits = found.groupBy("id", "license_id", "kind", "scope").agg(F.count("*").alias("n_matches"))
    everyone = docs.select(F.col("id").alias("own")).distinct()
    return (everyone.join(hits, F.col("own").eqNullSafe(F.col("id")), "left")
            .select(F.col("own").alias(id_col), "license_id", "kind", "scope", "n_matches"))
