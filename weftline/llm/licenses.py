"""License scans: whole texts and notice lines looked up by the digest of a canonical form."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
#: Digests of the canonical form of long licences whose texts are too long to keep here, with and without what follows their terms.
LONG: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "27659ec5818c8f3ad2616507f59cece1"), ("Apache-2.0", "c423529a1bffe64131469f4691c3143b"), ("CC0-1.0", "d2a76f70ce19809695b7fb93c6241c23"),
    ("GFDL-1.2-only", "fc8fd4dca9351a1b1ba045c2a7d3d70f"), ("GFDL-1.3-only", "3564867804d3e20f9506651fedbca0e9"), ("GPL-1.0-only", "5b0d5de72de699a0ba747b00c760bb5a"),
    ("GPL-1.0-only", "738cc3b112640d95d4cd79a58967ecea"), ("GPL-2.0-only", "68380dbeadb093b94ecf563db7312db7"), ("GPL-2.0-only", "5e39ace6e62f5a7fe9c17b4da986ad8c"),
    ("GPL-3.0-only", "444f95dc767ede978b60cfb20fbd0bca"), ("GPL-3.0-only", "5eaa767cc0a56c87c3852144458a3bf1"), ("LGPL-2.0-only", "c396ba2f94537628797123bc12cd2d6e"),
    ("LGPL-2.0-only", "74cf7fcef3b29a39165a795b2cad3a3a"), ("LGPL-2.1-only", "3054b3781b1af43f906dc753acad15ee"), ("LGPL-2.1-only", "f998bc436710cfece156aaa84fd26dd4"),
    ("LGPL-3.0-only", "b31b7335bc37919e8cdd79154e04d88d"), ("MPL-1.1", "c5fe39d916269cd253fd7c01e28b62c5"), ("MPL-2.0", "35fb4d2625087f7fd780039aa7b4ebb2"),
    ("Artistic-1.0-Perl", "01297679267ad921516667ccd889865e"),
)
#: Texts and notices by SPDX identifier; a key may have several.
KNOWN: list[tuple[str, str]] = [
    ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT), ("MIT", "The MIT License\n" + _MIT), ("MIT", _MIT),
    ("ISC", f"ISC License\n{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_AS_IS}"),
    ("ISC", f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_AS_IS}"),
    ("0BSD", f"{_GRANT}.\n{_AS_IS}"),
    *(("BSD-2-Clause", head + _BSD.format("")) for head in ("", "BSD 2-Clause License\n")), *(("BSD-3-Clause", head + _BSD.format(_BSD_3)) for head in ("", "BSD 3-Clause License\n")),
    *((spdx, f"{verb} under {the}{name}{end}") for spdx, the, name in (
        ("MIT", "the ", "MIT License"), ("Apache-2.0", "the ", "Apache License, Version 2.0"), ("GPL-3.0-only", "the ", "GNU General Public License v3.0"), ("GPL-3.0-only", "the ", "GNU General Public License, version 3"), ("GPL-2.0-only", "the ", "GNU General Public License, version 2"),
        ("BSD-3-Clause", "the ", "BSD 3-Clause License"), ("MPL-2.0", "the ", "Mozilla Public License 2.0"), ("CC0-1.0", "", "CC0 1.0"),
        *((f"CC-{k}-{v}", "", f"CC {k} {v}") for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("3.0", "4.0")),
    ) for verb in ("Licensed", "Released", "Distributed", "This work is licensed", "This software is licensed") for end in ("",)),
    *((spdx, f"SPDX-License-Identifier: {spdx}") for spdx in ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-3.0-only", "ISC", "MPL-2.0", "CC-BY-4.0", "CC0-1.0")),
]
#: Lines that name a holder of rights, and spellings that count as equal, in order.
_COPYRIGHT = r"(?m)^[ \t]*(?:copyright\b[^\n]*(?:\d{4}|\(c\)|©|<year>|\[year\]|\[yyyy\])[^\n]*|\(c\)[^\n]*|©[^\n]*|all rights reserved[^\n]*)$"
_SPELLINGS = ((r"\blicence", "license"), (r"\b(organ|author|recogn|util|initial)is(e|ed|es|ation|ing)\b", r"\1iz\2"), (r"\bsub license", "sublicense"), (r"\bnon infringement", "noninfringement"), (r"\bwhilst\b", "while"), (r"\backnowledgement", "acknowledgment"))
_OTHER = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, punctuation and blanks as one space, equivalent spellings made one."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _COPYRIGHT, "")
    out = F.trim(F.regexp_replace(out, _OTHER, " "))
    for old, new in _SPELLINGS:
        out = F.when(F.contains(out, F.lit(_hint(old))), F.regexp_replace(out, old, new.replace("\\", "$"))).otherwise(out) if _hint(old) else F.regexp_replace(out, old, new.replace("\\", "$"))
    return out


def _hint(pattern: str) -> str:
    """A literal that every match holds, to skip texts without it."""
    return pattern.replace(r"\b", "") if re.fullmatch(r"(\\b)?[a-z ]+(\\b)?", pattern) else ""


def canonical_python(text: str) -> str:
    """The same on the driver, for the known texts."""
    out = re.sub(_COPYRIGHT, "", text.lower())
    out = re.sub(r"[^\w]+|_+", " ", out).strip()
    for old, new in _SPELLINGS:
        out = re.sub(old, new, out)
    return out


def known_digests(known=KNOWN) -> dict[str, str]:
    return {digest: spdx for spdx, digest in LONG} | {hashlib.md5(canonical_python(text).encode()).hexdigest(): spdx for spdx, text in known}


def scan(docs: DataFrame, text_col: str = "text", known=KNOWN) -> DataFrame:
    """Adds digest (of the whole text), license (whose text it is, else null) and notices (identifiers of its lines).

    Whole texts are hash-joined to the known digests, a fixed list of the program that is broadcast; lines that speak of
    a licence are looked up in the same list inside the row. No text is shuffled. Null, empty and blank texts have the
    digest of the empty string and no license; notices are distinct, sorted and joined by a comma, null if none.
    """
    spark = docs.sparkSession
    digests = known_digests(known)
    values = ", ".join(f"('{d}', '{s}')" for d, s in sorted(digests.items()))
    lookup = spark.sql(f"SELECT * FROM VALUES {values} AS t(_w_digest, license)")
    table_of = F.create_map(*(F.lit(x) for pair in sorted(digests.items()) for x in pair))
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda x: F.regexp_like(x, F.lit("(?i)licen[sc]e")))
    found = F.array_sort(F.array_distinct(F.filter(F.transform(lines, lambda x: F.try_element_at(table_of, F.md5(canonical(x)))), lambda x: x.isNotNull())))
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("digest", "license", "notices")]
    out = docs.select(*own, F.md5(canonical(F.col(text_col))).alias("digest"), F.nullif(F.array_join(found, ","), F.lit("")).alias("notices"))
    return out.join(F.broadcast(lookup), F.col("digest") == F.col("_w_digest"), "left").drop("_w_digest")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """scan over all documents; nulls, empty texts and repeated rows as there."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "digest", "license", "notices")


def _canonical_sql(x: str) -> str:
    out = f"regexp_replace(lower({x}), '{_COPYRIGHT}', '', 'g')"
    out = rf"trim(regexp_replace({out}, '{_OTHER}', ' ', 'g'))"
    for old, new in _SPELLINGS:
        out = f"regexp_replace({out}, '{old}', '{new}', 'g')"
    return out


def _sql() -> str:
    values = ", ".join(f"('{d}', '{s}')" for d, s in sorted(known_digests().items()))
    return f"""
WITH k(digest, license) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
n AS (SELECT rid, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS notices FROM (SELECT rid, md5({_canonical_sql('line')}) AS digest FROM l WHERE regexp_matches(line, '(?i)licen[sc]e')) x JOIN k USING (digest) GROUP BY rid),
h AS (SELECT rid, doc_id, md5({_canonical_sql('t')}) AS digest FROM d)
SELECT h.doc_id, h.digest, k.license, n.notices FROM h LEFT JOIN k ON k.digest = h.digest LEFT JOIN n ON n.rid = h.rid
"""


OP1_SQL = _sql()
