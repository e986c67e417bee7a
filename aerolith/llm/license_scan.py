"""License scan by canonical digests (operator 1); DataFrame functions only.

Texts are brought to a canonical form in which renderings of one licence are equal: ASCII lower case, copyright lines
dropped, equivalent spellings unified, runs of punctuation and white space as one space. The SHA-256 of the form is looked
up in a table of known licences' digests by hash join. Looked up are the whole text of a document, each of its
paragraphs (between blank lines), each of its lines, and runs of 2 to ``RUN`` paragraphs that begin as a known text of
several paragraphs does; always entire units against entire known texts. A licence inside a longer document is a run,
however the paragraphs after its first are cut.

The built-in table has the texts of MIT, ISC, BSD-2-Clause, BSD-3-Clause, Zlib, 0BSD, BSL-1.0 and Unlicense, the digests of
Apache-2.0, MPL-2.0, GPL-2.0, GPL-3.0, LGPL-2.1, LGPL-3.0 and CC0-1.0 as their publishers word them, and common one-line
notices. It lacks other licences and other wordings; ``known`` takes any table of texts.

Defined results: null and empty texts have the digest of the empty string and match nothing, as do units without letters
or digits; several known texts with one canonical form count as the one with the least license_id; repeated rows are
answered row by row; an empty known table matches nothing; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm.common import materialise, small_side, text_or_empty

#: Equivalent spellings (fixed values), replaced in this order.
SPELLINGS = [
    ("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("organisation", "organization"),
    ("authoris", "authoriz"), ("recognis", "recogniz"), ("utilis", "utiliz"), ("favour", "favor"), ("whilst", "while"),
    ("percent", "per cent"), ("copyright holder", "copyright owner"), ("(c)", "copyright"), ("©", "copyright"),
    ("https://", "http://"), ("fulfil ", "fulfill "), ("acknowledgement", "acknowledgment"),
]
#: A line that only claims copyright: the word or sign, then a sign or a year.
COPYRIGHT_LINE = r"(?m)^[ \t#*/;-]*(copyright[ \t]*(\(c\)|©|[0-9][0-9][0-9][0-9])|\(c\)[ \t]*[0-9]|©)[^\n]*(\n|$)"

_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice "
    "and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS "
    "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
    "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
    "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
    "SOFTWARE."
)
_BSD2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.\n\n"
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD3 = _BSD2 + (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.\n\n"
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
    "for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any "
    "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
    "restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
    "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
    "is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
    "original software.\n\n3. This notice may not be removed or altered from any source distribution."
)
_ZERO_BSD = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS" + _ISC.split("AND THE AUTHOR DISCLAIMS")[1]
)
_BOOST = (
    "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or "
    "organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to "
    "use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, "
    "and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright "
    "notices in the Software and this entire statement, including the above license grant, this restriction and the following "
    "disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
    "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source "
    "language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
    "SOFTWARE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, "
    "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
    "commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors "
    "of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication "
    "for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be "
    "an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE "
    "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF "
    "OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to "
    "<https://unlicense.org/>"
)
#: Known texts (fixed values): licences short enough to be quoted whole, and notices that stand for longer ones.
KNOWN = [
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT), ("ISC", _ISC), ("ISC", "ISC License\n\n" + _ISC),
    ("BSD-2-Clause", _BSD2 + _BSD_WARRANTY), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD2 + _BSD_WARRANTY), ("BSD-3-Clause", _BSD3 + _BSD_WARRANTY),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD3 + _BSD_WARRANTY), ("Zlib", _ZLIB), ("Zlib", "zlib License\n\n" + _ZLIB), ("0BSD", _ZERO_BSD), ("0BSD", "BSD Zero Clause License\n\n" + _ZERO_BSD),
    ("BSL-1.0", _BOOST), ("Unlicense", _UNLICENSE),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."), ("BSD-3-Clause", "Released under the BSD 3-Clause License."), ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."), ("Proprietary", "All rights reserved."),
]


#: Paragraphs of the longest run looked up.
RUN = 250
#: Licences too long to quote (fixed values): id, canonical first paragraph, SHA-256 of the canonical text.
LONG: list[tuple[str, str, str]] = [
    ("Apache-2.0", "apache license version 2 0 january 2004 http www apache org licenses",
     "ace6a372211f9ce084dc4b0b5b19d927554ce25731212e0da869cb47592a0cf7"),
    ("MPL-2.0", "mozilla public license version 2 0",
     "90b967f7d21c34ca0e1d17522f43d844fea7f0f6b7ffaa71647eb4abf45c68df"),
    ("GPL-2.0-only", "gnu general public license version 2 june 1991",
     "c5626516907c9b28f97a88db36f7dbe90174e04e4e97c6c772f3a44039e7f51d"),
    ("GPL-3.0-only", "gnu general public license version 3 29 june 2007",
     "4b60464ce9d38d5e835b73262d007c8d230bd03a4d91a25acd1065bc092a10dd"),
    ("LGPL-2.1-only", "gnu lesser general public license version 2 1 february 1999",
     "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692"),
    ("LGPL-3.0-only", "gnu lesser general public license version 3 29 june 2007",
     "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("CC0-1.0", "creative commons legal code",
     "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
]


def canonical(text: Column) -> Column:
    """Canonical form that keeps line ends: letters and digits, single spaces, newlines."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = F.regexp_replace(low, COPYRIGHT_LINE, "")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")


def flat(text: Column) -> Column:
    """Canonical text on one line."""
    return F.trim(F.regexp_replace(text, "[ \n]+", " "))


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "license_id string, text string")


def paragraphs(form: Column) -> Column:
    """Paragraphs of a canonical form, each on one line; blank ones are left out."""
    return F.filter(F.transform(F.split(form, r"\n *\n[ \n]*"), flat), lambda p: p != "")


def known_digests(known: DataFrame) -> DataFrame:
    """digest and license_id of each known text that has letters or digits."""
    rows = known.select("license_id", flat(canonical(text_or_empty())).alias("form")).where("form <> '' and license_id is not null")
    return rows.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def known_beginnings(known: DataFrame) -> list[int]:
    """Hashes of the first paragraphs of known texts of several; a million at most, as they travel with the plan."""
    first = known.where("license_id is not null").select(paragraphs(canonical(text_or_empty())).alias("p")).where(F.size("p") > 1)
    found = [r.h for r in first.select(F.xxhash64(F.col("p")[0]).alias("h")).distinct().limit(1_000_001).collect()]
    if len(found) > 1_000_000:
        raise ValueError("more than a million known texts of several paragraphs")
    return sorted(found)


def runs(parts: Column, beginnings: list[int]) -> Column:
    """Runs of 2 to ``RUN`` paragraphs that begin with one of the ``beginnings``, each on one line."""
    if not beginnings:
        return F.array().cast("array<string>")
    begins = F.array(*map(F.lit, beginnings))
    starts = F.filter(F.transform(parts, lambda p, i: F.when(F.array_contains(begins, F.xxhash64(p)), i + 1)), lambda i: i.isNotNull())
    left = lambda i: F.least(F.lit(RUN), F.size(parts) - i + 1)
    several = lambda i: F.when(left(i) >= 2, F.sequence(F.lit(2), left(i))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(starts, lambda i: F.transform(several(i), lambda n: F.concat_ws(" ", F.slice(parts, i, n)))))


def license_scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license_id (whole text, else null), n_license_units (different units that are known texts),
    license_ids (sorted, comma-separated, of all units)."""
    spark = docs.sparkSession
    table = known_digests(known if known is not None else known_licenses(spark))
    beginnings = known_beginnings(known if known is not None else known_licenses(spark))
    if known is None:
        table = table.unionByName(spark.createDataFrame([(d, i) for i, _, d in LONG], "digest string, license_id string"))
        first = spark.createDataFrame([(p,) for _, p, _ in LONG], "p string").select(F.xxhash64("p").alias("h"))
        beginnings = sorted({*beginnings, *(r.h for r in first.collect())})
    side = small_side(materialise(table, "licenses"), 128)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), canonical(text_or_empty()).alias("form"))
    rows = rows.select("row", "doc_id", F.sha2(flat(F.col("form")), 256).alias("digest"), F.split("form", "\n").alias("lines"), paragraphs(F.col("form")).alias("parts"))
    units = F.concat(F.transform("lines", flat), F.col("parts"), runs(F.col("parts"), beginnings))
    rows = rows.select("row", "doc_id", "digest", F.filter(F.array_distinct(units), lambda u: u != "").alias("units"))
    hits = rows.select("row", "doc_id", "digest", F.explode_outer("units").alias("unit")).withColumn("unit", F.sha2("unit", 256))
    unit = side.withColumnsRenamed({"digest": "unit", "license_id": "unit_license"})
    # a row's units stay in one partition, so counting them first moves one small row for each document
    found = hits.join(unit, "unit", "left").groupBy("row", "doc_id", "digest").agg(
        F.count("unit_license").alias("n_license_units"), F.array_join(F.array_sort(F.collect_set("unit_license")), ",").alias("license_ids")
    )
    return found.join(side, "digest", "left").select("doc_id", "digest", "license_id", "n_license_units", "license_ids")


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def canonical_sql(expr: str) -> str:
    """The canonical form as a SQL expression."""
    out = f"translate({expr}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"regexp_replace({out}, {_sql_text(COPYRIGHT_LINE)}, '', 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, {_sql_text(old)}, {_sql_text(new)})"
    return rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"


def flat_sql(expr: str) -> str:
    return rf"trim(regexp_replace({expr}, '[ \n]+', ' ', 'g'))"


def scan_sql() -> str:
    """SQL twin of :func:`license_scan` over ``documents`` with the built-in table."""
    values = ", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in KNOWN)
    long = ", ".join(f"({_sql_text(d)}, {_sql_text(i)}, {_sql_text(p)})" for i, p, d in LONG)
    return rf"""
        WITH kt AS (SELECT license_id, {canonical_sql("text")} AS form FROM (VALUES {values}) AS v(license_id, text)),
        lt AS (SELECT * FROM (VALUES {long}) AS v(digest, license_id, beginning)),
        k AS (
          SELECT digest, min(license_id) AS license_id FROM (
            SELECT sha256({flat_sql("form")}) AS digest, license_id FROM kt WHERE {flat_sql("form")} <> '' UNION ALL SELECT digest, license_id FROM lt) GROUP BY 1),
        kp AS (SELECT license_id, form, [x FOR x IN [{flat_sql("y")} FOR y IN string_split_regex(form, '\n *\n[ \n]*')] IF x <> ''] AS p FROM kt),
        b AS (SELECT DISTINCT p[1] AS beginning FROM kp WHERE len(p) > 1 UNION SELECT beginning FROM lt),
        d AS (SELECT row_number() OVER () AS row, doc_id, {canonical_sql("coalesce(text, '')")} AS form FROM documents),
        pp AS (SELECT row, [x FOR x IN [{flat_sql("y")} FOR y IN string_split_regex(form, '\n *\n[ \n]*')] IF x <> ''] AS p FROM d),
        pi AS (SELECT row, p, unnest(generate_series(1, len(p))) AS i FROM pp WHERE len(p) > 1),
        pr AS (SELECT row, p, i, unnest(generate_series(2, least({RUN}, len(p) - i + 1))) AS n FROM pi JOIN b ON p[i] = beginning),
        u AS (
          SELECT DISTINCT row, {flat_sql("unit")} AS unit FROM (
            SELECT row, unnest(string_split_regex(form, '\n')) AS unit FROM d
            UNION ALL SELECT row, unnest(p) FROM pp
            UNION ALL SELECT row, array_to_string(p[i:i + n - 1], ' ') FROM pr)),
        h AS (
          SELECT row, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids
          FROM u JOIN k ON sha256(unit) = k.digest WHERE unit <> '' GROUP BY row)
        SELECT doc_id, sha256({flat_sql("form")}) AS digest, k.license_id, coalesce(n, 0) AS n_license_units, coalesce(ids, '') AS license_ids
        FROM d LEFT JOIN h USING (row) LEFT JOIN k ON sha256({flat_sql("form")}) = k.digest
    """
