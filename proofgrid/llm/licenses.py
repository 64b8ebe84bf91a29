"""Licence scans by canonical digests: whole texts and whole lines are normalised and looked up by hash.

Canonical form: ASCII lower case, copyright statements and "all rights reserved" taken out, every run of characters
that are neither letters nor digits is one space (two while the rules apply, so that each word has its own), equivalent spellings are made equal by rules that hold for the known
texts and the scanned ones alike. The digest (SHA-256) of a document's whole text and of each of its lines is joined
to the digests of known licence texts and notices; that table is written in code, so it is broadcast.

Null and empty texts have the digest of the empty text and no licence. Repeated rows give a row each, null ids too; rows of one id share the licences of their lines. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rules of the canonical form, applied in this order (pattern, replacement).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (
    (r"(^|\n)[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|<|\[|[0-9]{4})|\(c\)|©)[^\n]*", r"$1 "),
    (r"all rights reserved", " "),
    (r"[^\p{L}\p{N}]+", "  "),
    (r"$", " "),
    (r"licenc", "licens"),
    (r"([a-z]{3})is(e|ed|es|ing|ation|ations) ", r"$1iz$2 "),
    (r" (acknowledg|judg)ement", r" $1ment"),
    (r"our(s|ed|ing|able|ite)? ", r"or$1 "),
    (r" https ", " http "),
    (r" copyright  owner", " copyright  holder"),
    (r" sub  licens", " sublicens"),
    (r" non  (commercial|infringement|exclusive)", r" non$1"),
    (r" (version|v)  ([0-9])", r" v$2"),
    (r" +", " "),
)

# Names of licences as notices write them, with their identifiers.
NAMES = (
    ("MIT", ("the MIT License", "MIT License")),
    ("Apache-2.0", ("the Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0")),
    ("GPL-2.0", ("the GNU General Public License, version 2", "GPL v2", "GPL-2.0")),
    ("GPL-3.0", ("the GNU General Public License, version 3", "GPL v3", "GPL-3.0")),
    ("LGPL-3.0", ("the GNU Lesser General Public License, version 3", "LGPL v3", "LGPL-3.0")),
    ("AGPL-3.0", ("the GNU Affero General Public License, version 3", "AGPL v3", "AGPL-3.0")),
    ("MPL-2.0", ("the Mozilla Public License, version 2.0", "MPL 2.0", "MPL-2.0")),
    ("BSD-2-Clause", ("the BSD 2-Clause License", "BSD-2-Clause")),
    ("BSD-3-Clause", ("the BSD 3-Clause License", "BSD-3-Clause")),
    ("ISC", ("the ISC License", "ISC License")),
    ("CC0-1.0", ("CC0 1.0", "CC0 1.0 Universal")),
    ("CC-BY-4.0", ("CC BY 4.0", "the Creative Commons Attribution 4.0 International License")),
    ("CC-BY-SA-4.0", ("CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License")),
    ("CC-BY-NC-4.0", ("CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License")),
)
NOTICES = (
    "Licensed under {}", "Released under {}", "Distributed under {}", "This work is licensed under {}", "This software is licensed under {}",
    "This project is licensed under {}", "This program is licensed under {}", "This file is licensed under {}", "License: {}", "SPDX-License-Identifier: {}",
)

# Whole licence texts.
NO_WARRANTY = (
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON "
    "ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)
REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
TEXTS = (
    ("MIT", (
        "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, '
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
        "THE SOFTWARE.")),
    ("ISC", (
        "ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR "
        "OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")),
    ("BSD-2-Clause", f"{REDISTRIBUTION} {AS_IS} {NO_WARRANTY}"),
    ("BSD-3-Clause", (
        f"{REDISTRIBUTION} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        f"this software without specific prior written permission. {AS_IS} {NO_WARRANTY}")),
    ("Zlib", (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
        "use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
        "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
        "not be removed or altered from any source distribution.")),
)


def canonical(text: Column) -> Column:
    """The canonical form as a column."""
    out = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    for pattern, new in RULES:
        out = F.regexp_replace(out, pattern, new)
    return F.trim(out)


ANY = "*"


def opening(line: Column) -> Column:
    """The first word of the canonical form, from the first word alone; ``ANY`` where the rules join words or may take the first ones out."""
    low = F.translate(line, UPPER, LOWER)
    word = F.regexp_extract(low, r"[\p{L}\p{N}]+", 0)
    return F.when(word.isin("sub", "non", "version", "v") | F.contains(low, F.lit("all rights reserved")), ANY).otherwise(canonical(word))


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of all known licence texts, with and without the title line, and of all notices."""
    texts = [(k, t) for k, t in TEXTS] + [(k, t.removeprefix(f"{k} License ")) for k, t in TEXTS if t.startswith(f"{k} License ")]
    return texts + [(k, form.format(name)) for k, names in NAMES for name in names for form in NOTICES]


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, licence, first word), one row per digest; of licences with equal canonical texts the first by name."""
    rows = spark.createDataFrame(texts if texts is not None else known_texts(), "licence string, body string")
    forms = rows.select("licence", canonical(F.col("body")).alias("form"))
    return forms.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("licence").alias("licence"), F.min(F.get(F.split("form", " "), F.lit(0))).alias("first"))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, digest of the whole text, its licence, and the licences of its lines.

    ``line_licences``: identifiers, sorted, each once. ``n_licence_lines``: lines that are known texts or notices.
    """
    known = F.broadcast(known if known is not None else known_digests(docs.sparkSession))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    lines = F.filter(F.split(F.coalesce(F.col("_text"), F.lit("")), "\n", -1), lambda x: F.length(x) > 0)
    # a line can be a known text only if it starts with the first word of one; the few that do get their canonical form
    split = rows.select("_id", F.explode(lines).alias("_line")).withColumn("first", opening(F.col("_line")))
    firsts = known.select("first").unionByName(docs.sparkSession.createDataFrame([(ANY,)], "first string")).distinct()
    likely = split.join(F.broadcast(firsts), "first", "left_semi")
    found = likely.select("_id", F.sha2(canonical(F.col("_line")), 256).alias("digest")).join(known.select("digest", "licence"), "digest")
    hits = found.groupBy(F.col("_id").alias("_hit")).agg(F.sort_array(F.collect_set("licence")).alias("line_licences"), F.count(F.lit(1)).alias("n_licence_lines"))
    whole = rows.select("_id", F.sha2(canonical(F.col("_text")), 256).alias("digest")).join(known.select("digest", F.col("licence").alias("text_licence")), "digest", "left")
    out = whole.join(hits, F.col("_id").eqNullSafe(F.col("_hit")), "left")
    return out.select(
        F.col("_id").alias(id_col), "digest", "text_licence", F.coalesce("line_licences", F.array().cast("array<string>")).alias("line_licences"),
        F.coalesce("n_licence_lines", F.lit(0)).cast("bigint").alias("n_licence_lines"),
    )
