"""Licence scans by canonical digests, with DataFrame functions.

A text is brought to a canonical form (case, punctuation, title and copyright lines and
equivalent spellings) and its digest is joined with the digests of known
licences. Whole documents are looked up, and single lines as notices.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Known texts, as their authors publish them.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org/>""",
}
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{third}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
KNOWN["BSD-2-Clause"] = _BSD.format(third="")
KNOWN["BSD-3-Clause"] = _BSD.format(
    third="3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
)
# Sha-256 of the canonical form of long texts, as their authors publish them.
DIGESTS = {
    "Apache-2.0": "adf220ee02537f83220e088f4488ca0e7557d614fac1cc48967b41d13911d6e0",
    "GPL-2.0": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-3.0": "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-2.0": "c2713eb9ffe7cf58eeb67ec5410a54ac745b6fb19c51c595bdfd96f92361166b",
}
# One-line notices.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
}
# Spellings that count as equal, the second one stands for both.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sub license", "sublicense"),
    ("sub licence", "sublicense"), ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("organisation", "organization"), ("favour", "favor"),
    ("merchantable", "merchantability"), ("programme", "program"),
]
_COPYRIGHT = r"(?im)^[\s*#/;-]*(copyright\s*(\(c\)|©|[0-9<\[])|\(c\)|©|all rights reserved)[^\n]*$"
# The line above a licence that names it.
_TITLE = (
    r"(?i)^\s*(the )?(mit|isc|((simplified|new|modified|revised) )?bsd( [23][- ]clause)?( \"?(simplified|new|revised|modified)\"?( or \"?(new|revised|modified)\"?)?)?)"
    r" licen[sc]e( \((mit|isc|expat)\))?[ \t]*:?[ \t]*\r?\n"
)
_BROADCAST_ROWS = 200_000
# Every built-in text holds one of these stems, so a text without any is none.
_STEMS = r"(?i)licen[sc]|permission|redistribution"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(text, _TITLE, ""), _COPYRIGHT, "")), r"[^\p{L}\p{N}]+", " ")
    for other, one in SPELLINGS:
        out = F.regexp_replace(out, rf"\b{other}\b", one)
    return F.trim(out)


def known_digests(spark: SparkSession) -> DataFrame:
    """``digest``, ``license`` and ``kind`` of the known texts: a few dozen rows."""
    # Conditions are numbered or bulleted; bullets leave no trace in the canonical form.
    rows = [(k, "text", x) for k, v in KNOWN.items() for x in dict.fromkeys([v, re.sub(r"(?m)^\d\. ", "* ", v)])] + [(k, "notice", v) for k, vs in NOTICES.items() for v in vs]
    listed = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(kind).alias("kind"), F.lit(v).alias("text")) for k, kind, v in rows])
    long = F.array(*[F.struct(F.lit(d).alias("digest"), F.lit(k).alias("license"), F.lit("text").alias("kind")) for k, d in DIGESTS.items()])
    return spark.range(1).select(F.explode(listed).alias("x")).select(
        F.sha2(canonical(F.col("x.text")), 256).alias("digest"), "x.license", "x.kind"
    ).union(spark.range(1).select(F.inline(long))).dropDuplicates(["digest", "kind"])


def licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``license`` (of a document that is a known text as a whole, or
    null), ``notices`` (licences named by lines of their own, sorted, distinct)
    and ``n_notices`` (such lines).

    Null and empty texts match nothing. Rows without ``doc_id`` are dropped,
    repeated rows of a document count once. ``known`` holds ``digest`` (sha-256 of
    the canonical text), ``license`` and ``kind``: ``text`` for whole licences,
    ``notice`` for lines (without the column all are texts). Whole documents are looked up among the texts only, lines
    among the notices only. A list of up to 200,000 rows is broadcast.
    """
    stems = _STEMS if known is None else ""  # nothing is known of the words of a caller's texts
    known = known_digests(docs.sparkSession) if known is None else known
    kind = "kind" if "kind" in known.columns else F.lit("text").alias("kind")
    known = known.select("digest", "license", kind)
    if known.count() <= _BROADCAST_ROWS:
        known = F.broadcast(known)
    texts, notices = (known.filter(F.col("kind") == kind).drop("kind") for kind in ("text", "notice"))
    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    likely = rows.filter(F.col("text").rlike(stems)).distinct()
    whole = (
        likely.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest")).join(texts, "digest")
        .select("doc_id", "license", F.lit(None).cast("string").alias("notice"))
    )
    lines = likely.select("doc_id", F.explode(F.filter(F.split("text", "\n"), lambda x: x.rlike(stems))).alias("line"))
    named = (
        lines.select("doc_id", F.sha2(canonical(F.col("line")), 256).alias("digest")).join(notices, "digest")
        .select("doc_id", F.lit(None).cast("string").alias("license"), F.col("license").alias("notice"))
    )
    found = whole.union(named).groupBy("doc_id").agg(
        F.min("license").alias("license"), F.array_sort(F.collect_set("notice")).alias("notices"), F.count("notice").alias("n_notices")
    )
    none = F.array().cast("array<string>")
    return rows.select("doc_id").distinct().join(found, "doc_id", "left").select(
        "doc_id", "license", F.coalesce("notices", none).alias("notices"), F.coalesce("n_notices", F.lit(0).cast("long")).alias("n_notices")
    )
