"""Licence scans: the canonical digest of a whole text, and of each of its lines, looked up among known licences by a hash join.

Canonical form: lower case; equivalent spellings made one; everything but letters and digits one blank; copyright lines left out,
which are those that name a year or a holder, wherever other lines are broken. Texts that differ in these alone have one digest. The
known digests come from the licences' texts by the same expressions, with and without a title line, so a caller adds a licence by
adding its text; of long licences only the digests are kept. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Spellings that count as the same, as words of the canonical text.
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sub license": "sublicense", "non commercial": "noncommercial", "organisation": "organization", "https": "http", "v": "version"}

_WARRANTY = "IN NO EVENT SHALL THE {who} BE LIABLE FOR ANY "
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Known licences: whole texts and the notices that stand for them (fixed values, from the licences as published).
LICENCES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        + _WARRANTY.format(who="AUTHORS OR COPYRIGHT HOLDERS")
        + "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "0BSD": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "BSD-2-Clause": ["BSD 2-Clause License\n\n" + _BSD + _BSD_END],
    "BSD-3-Clause": ["BSD 3-Clause License\n\n" + _BSD + _BSD_NAMES + _BSD_END],
    "Unlicense": ["This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"],
    "Zlib": ["zlib License\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License 2.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
}


#: Digests of whole texts that are too long to hold here, as published, in canonical form; Apache-2.0 with and without its appendix (fixed values).
DIGESTS: dict[str, list[str]] = {
    "Apache-2.0": ["b200db14d43f341836ccc14296f66944", "d44d7dd7bb33c43e91c9d5e48b1d489e"],
    "Artistic-1.0": ["01297679267ad921516667ccd889865e"],
    "CC0-1.0": ["dcb3226ed1c311f82507296410434b55"],
    "GFDL-1.3": ["7132e8380bc59358f27c3129a2136bf1"],
    "GPL-1.0": ["738cc3b112640d95d4cd79a58967ecea"],
    "GPL-2.0": ["5e39ace6e62f5a7fe9c17b4da986ad8c"],
    "GPL-3.0": ["b79359b5e391fd47146ff34ae3db7ec0"],
    "LGPL-2.0": ["74cf7fcef3b29a39165a795b2cad3a3a"],
    "LGPL-2.1": ["f998bc436710cfece156aaa84fd26dd4"],
    "LGPL-3.0": ["b31b7335bc37919e8cdd79154e04d88d"],
    "MPL-1.1": ["4ed6600fcf5321eb9dcd2181cde18632"],
    "MPL-2.0": ["bba58d76f66dd9d890110b970536045e"],
}

#: A copyright line in canonical form.
HOLDER = r"^(copyright (c|©) |copyright .*[0-9]{4}|copyright$|all rights reserved$|c [0-9]{4}|©)"
#: A title has so many words at most, and no full stop at its end.
TITLE_WORDS = 8


def known_texts(licences: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(licence, text): every text, and those of several lines without their title line too."""
    out = []
    for name, texts in licences.items():
        for text in texts:
            title, _, rest = text.partition("\n")
            out += [(name, text)] + [(name, rest)] * (rest.strip() != "" and len(title.split()) <= TITLE_WORDS and not title.rstrip().endswith("."))
    return out


def canonical(text: Column) -> Column:
    """The lines of a text in lower case, each with its words between single blanks, without empty ones and copyright lines."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\n\x{80}-\x{10FFFF}]+", " ")
    return F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(HOLDER))


#: Texts without any of these stay as they are.
_SPELT = r"\b(licen[cs]e|sub|non|organisation|https|v)"


def spelt(words: Column) -> Column:
    """Equivalent spellings made one."""
    padded = reduce(lambda x, pair: F.replace(x, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")), SPELLINGS.items(), F.concat(F.lit(" "), words, F.lit(" ")))
    return F.trim(F.when(words.rlike(_SPELT), padded).otherwise(words))


def digest(lines: Column) -> Column:
    """Of a whole text: its lines are joined first, so that spellings of two words are met across line breaks."""
    return F.md5(spelt(F.concat_ws(" ", lines)))


def known(spark, licences: dict[str, list[str]], digests: dict[str, list[str]]) -> DataFrame:
    """digest, licence: as many rows as texts and digests in the dictionaries, and titles."""
    rows = spark.createDataFrame(known_texts(licences), "licence string, text string").select(digest(canonical(F.col("text"))).alias("digest"), "licence")
    more = spark.createDataFrame([(d, name) for name, own in digests.items() for d in own], "digest string, licence string")
    return rows.unionByName(more).groupBy("digest").agg(F.min("licence").alias("licence"))


def licence_scan(docs: DataFrame, licences: dict[str, list[str]] | None = None, digests: dict[str, list[str]] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, key (hash of its text), digest (of its whole text), licence (of its whole text),
    line_licences (sorted, joined by commas), n_lines.

    Rows with the same id and text are one document. A null or empty text has the digest of no words, and no licence. A licence's
    own text names it by its whole text; a notice names it by a line that holds nothing else. n_lines counts such lines, repeated
    ones each time. An empty table gives an empty result; other columns are not looked at. The known digests are broadcast: they are the caller's dictionary, not data.
    """
    table = F.broadcast(known(docs.sparkSession, LICENCES if licences is None else licences, DIGESTS if digests is None else digests))
    units = let(canonical(F.col(text)), lambda x: F.concat(F.array(digest(x)), F.transform(x, lambda y: F.md5(spelt(y)))))
    each = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("key"), F.posexplode(units).alias("pos", "digest"))
    named = each.join(table, "digest", "left").where("pos = 0 OR licence IS NOT NULL")
    whole = F.col("pos") == 0
    found = F.collect_set(F.when(~whole, F.struct("pos", "licence")))  # no more than the text has lines
    out = named.groupBy("doc_id", "key").agg(F.max(F.when(whole, F.col("digest"))).alias("digest"), F.max(F.when(whole, F.col("licence"))).alias("licence"), found.alias("found"))
    return out.select("doc_id", "key", "digest", "licence", F.array_join(F.array_sort(F.array_distinct("found.licence")), ",").alias("line_licences"), F.size("found").cast("long").alias("n_lines"))


def oracle(licences: dict[str, list[str]] | None = None) -> str:
    """The same rows in DuckDB's SQL, for a table documents without repeated rows."""

    def lines(text: str) -> str:
        plain = f"regexp_replace(lower(coalesce({text}, '')), '[^a-z0-9\\n\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g')"
        return f"list_filter(list_transform(string_split({plain}, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '{HOLDER}'))"

    def digest_of(words: str) -> str:
        padded = f"concat(' ', {words}, ' ')"
        for old, new in SPELLINGS.items():
            padded = f"replace({padded}, ' {old} ', ' {new} ')"
        return f"md5(trim(CASE WHEN regexp_matches({words}, '{_SPELT}') THEN {padded} ELSE {words} END))"

    def whole(x: str) -> str:
        return digest_of(f"array_to_string({x}, ' ')")

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(name)}, {quoted(t)})" for name, t in known_texts(licences or LICENCES))
    more = ", ".join(f"('{d}', {quoted(name)})" for name, own in DIGESTS.items() for d in own)
    return f"""WITH k AS (SELECT digest, min(l) AS licence FROM (SELECT {whole(lines("t"))} AS digest, l FROM (VALUES {rows}) AS v(l, t) UNION ALL SELECT * FROM (VALUES {more}) AS w(digest, l)) GROUP BY 1),
d AS (SELECT doc_id, {lines("text")} AS x FROM documents),
n AS (SELECT doc_id, list(licence) AS found FROM (SELECT doc_id, {digest_of("y")} AS digest FROM (SELECT doc_id, unnest(x) AS y FROM d)) JOIN k USING (digest) GROUP BY 1),
w AS (SELECT doc_id, {whole("x")} AS digest FROM d)
SELECT w.doc_id, w.digest, k.licence, coalesce(array_to_string(list_sort(list_distinct(found)), ','), '') AS line_licences, CAST(coalesce(len(found), 0) AS BIGINT) AS n_lines
FROM w LEFT JOIN k ON w.digest = k.digest LEFT JOIN n ON w.doc_id = n.doc_id"""
