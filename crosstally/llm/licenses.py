"""License scans by canonical digest.

A text is brought to canonical form - lower case, copyright lines dropped, every sign that is no letter and no digit (of whatever script) a
blank, equivalent spellings made one - and the SHA-256 of the entire text is hash-joined to the digests of known licence texts. The texts
that are looked up are the documents and, as short notices stand in lines of their own, each of their lines. A document is brought to its
form once; a line's digest is made only where its length is that of a known text.

Copyright lines are those that begin, after signs, with a copyright sign, or with the word or (c) and then a sign, a year, a placeholder
or "by", and those that begin with "all rights reserved"; a wrapped line of a licence that begins with "copyright notice" stays.
Spellings are replaced wherever they stand, inside longer words too. Titles are part of a text: the usual ones are listed.

Defined cases: null and empty texts match nothing; a text that canonicalises to nothing matches nothing; repeated rows get a row each;
a document without a match has null licences and 0 lines; very long texts are read whole; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_side

# Spellings that count as equal, and what they become.
SPELLINGS = (("licence", "license"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("https", "http"), ("non commercial", "noncommercial"), ("sub license", "sublicense"), ("per cent", "percent"), ("copyright owner", "copyright holder"))

_MIT_BODY = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
)
_MIT_END = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_HEAD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'


def _gnu(name: str, version: str, program: str = "This program") -> str:
    """The notice that the GNU licences ask to put into source files."""
    return (
        f"{program} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.\n\n"
        f"{program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.\n\n"
        f"You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


# Licence texts and usual notices.
KNOWN = (
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.\nIf a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("MIT", f"{_MIT_BODY}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_MIT_END}"),
    ("MIT-0", f"{_MIT_BODY}.\n\n{_MIT_END}"),
    ("ISC", f"{_ISC_HEAD}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("0BSD", f"{_ISC_HEAD}.\n\n{_ISC_END}"),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n\n{_BSD_1}\n\n{_BSD_2}\n\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n\n{_BSD_1}\n\n{_BSD_2}\n\n{_BSD_3}\n\n{_BSD_END}"),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n"
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.\n\n"
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\n"
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\n'
        "For more information, please refer to <https://unlicense.org/>",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n'
        "    http://www.apache.org/licenses/LICENSE-2.0\n\n"
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("GPL-3.0-or-later", _gnu("General Public License", "3")),
    ("GPL-2.0-or-later", _gnu("General Public License", "2")),
    ("AGPL-3.0-or-later", _gnu("Affero General Public License", "3")),
    ("LGPL-3.0-or-later", _gnu("Lesser General Public License", "3")),
)

# Title lines with which the whole texts are usually headed.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)"),
    "MIT-0": ("MIT No Attribution",),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
}

# A copyright line, and a run of signs, in the syntax that Java and RE2 share.
_NOTICE = r"\n[^\p{L}\p{N}\n©]*(copyright[ \t]*(\(c\)|©|[0-9<\[{]|by )|©|\(c\)[ \t]*([0-9<\[{]|copyright|by )|all rights reserved)[^\n]*"
_SIGNS = r"[^\p{L}\p{N}\n]+"


def titled(known=KNOWN) -> list[tuple[str, str]]:
    """known, and its whole texts (those of several lines) under each of their titles."""
    return [*known, *((name, f"{title}\n\n{text}") for name, text in known if "\n" in text for title in TITLES.get(name, ()))]


def canonical_lines(text: Column) -> Column:
    """The canonical form of a text, as its lines that aren't empty."""
    c = F.concat(F.lit("\n"), F.lower(F.coalesce(text, F.lit(""))))
    c = F.regexp_replace(F.regexp_replace(c, _NOTICE, "\n"), _SIGNS, " ")
    for old, new in SPELLINGS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def canonical_lines_sql(text: str) -> str:
    """The same in DuckDB SQL."""
    c = f"concat(chr(10), lower(coalesce({text}, '')))"
    c = f"regexp_replace(regexp_replace({c}, '{_NOTICE}', chr(10), 'g'), '{_SIGNS}', ' ', 'g')"
    for old, new in SPELLINGS:
        c = f"replace({c}, '{old}', '{new}')"
    return f"list_filter(list_transform(string_split({c}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """digest, size, license_id of the list: one row for each of its canonical texts, titled or not."""
    rows = spark.createDataFrame(titled(known), "license_id string, text string")
    whole = rows.select(F.array_join(canonical_lines(F.col("text")), " ").alias("t"), "license_id").filter("t <> ''")
    return whole.groupBy(F.sha2("t", 256).alias("digest")).agg(F.max(F.length("t")).alias("size"), F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known=KNOWN) -> DataFrame:
    """doc_id, digest (canonical whole text), license_id (whole text), line_licenses (sorted, comma-joined), n_lines for every row.

    What is kept of a document is small: its digests, and those of the lines that are as long as a known text.
    """
    spark = docs.sparkSession
    table = known_digests(spark, known)
    sizes = sorted({r["size"] for r in table.select("size").collect()})  # bound: the list
    digests = F.broadcast(table.select(F.col("digest").alias("known_digest"), F.col("license_id")))  # bound: the list
    lines = docs.select("doc_id", F.sha2("text", 256).alias("key"), canonical_lines(F.col("text")).alias("lines"))
    fits = F.transform(F.filter("lines", lambda x: F.length(x).isin(sizes)), lambda x: F.sha2(x, 256))
    kept = cut(lines.select("doc_id", "key", F.sha2(F.array_join("lines", " "), 256).alias("digest"), fits.alias("line_digests")))
    # equal texts have equal lines: each is looked up once
    texts = kept.filter(F.size("line_digests") > 0).groupBy("key").agg(F.first("line_digests").alias("line_digests"))
    found = texts.select("key", F.explode("line_digests").alias("known_digest")).join(digests, "known_digest")
    # stored apart: where it is too large for a broadcast, the join reads two plain sides and a text with very many copies can be split
    found = small_side(cut(found.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("line_licenses"), F.count("*").alias("n_lines"))))
    whole = kept.select("doc_id", "key", "digest").join(digests, F.col("digest") == F.col("known_digest"), "left").drop("known_digest")
    return whole.join(found, "key", "left").select("doc_id", "digest", "license_id", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"))


def scan_sql(known=KNOWN) -> str:
    """The scan in DuckDB SQL."""
    quoted = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in titled(known))
    return f"""
WITH known AS (SELECT sha256(t) AS digest, min(license_id) AS license_id FROM (SELECT license_id, array_to_string({canonical_lines_sql("text")}, ' ') AS t FROM (VALUES {quoted}) AS k(license_id, text)) WHERE t <> '' GROUP BY 1),
docs AS (SELECT row_number() OVER () AS r, doc_id, {canonical_lines_sql("text")} AS lines FROM documents),
lines AS (SELECT r, unnest(lines) AS line FROM docs),
found AS (SELECT r, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids FROM lines JOIN known ON sha256(line) = digest GROUP BY r)
SELECT doc_id, d.digest, known.license_id, coalesce(ids, '') AS line_licenses, CAST(coalesce(n, 0) AS BIGINT) AS n_lines
FROM (SELECT *, sha256(array_to_string(lines, ' ')) AS digest FROM docs) d LEFT JOIN found USING (r) LEFT JOIN known ON d.digest = known.digest"""
