"""Licence scans by canonical digest: normalised texts joined by hash to known licences.

A text is put in canonical form: ASCII letters in lower case, lines that state a copyright
left out, everything but letters and digits turned into single spaces, and
equivalent spellings made one. The digest of the whole canonical text is looked
up in a table of known digests; each line that forms a whole notice of its own is
looked up in the same way. The table is a parameter of bounded size (checked), so
only it is broadcast, and documents are neither shuffled nor grouped.

Defined cases: a null text has a null digest and no licence, one without a letter or digit the digest of the
empty text, which is never a licence; repeated rows are looked up one by one; an empty table gives
no rows; other columns pass through.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import UPPER

MAX_KNOWN = 10_000
#: A line that states a copyright: it names the mark or a year, so wrapped text that only begins with the word stays.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n©]*(copyright\b[^\n]*((19|20)[0-9][0-9]|\(c\)|©)|copyright( by\b|:)|\(c\)[ \t]*(19|20)[0-9][0-9]|©|all rights reserved)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Equivalent spellings, applied to the canonical words in this order.
SPELLINGS = [
    (r"\blicence", "license"), (r"\bsub license", "sublicense"), (r"\bnon infringement\b", "noninfringement"), (r"\bnon commercial\b", "noncommercial"),
    (r"\bcopyright holder s\b", "copyright holders"), (r"\backnowledgement", "acknowledgment"), (r"\bper cent\b", "percent"), (r"\borganisation", "organization"),
    (r"\bmerchantibility\b", "merchantability"), (r"\bversion 2 0\b", "version 2"), (r"\bversion 3 0\b", "version 3"),
]

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD3_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_MIT0 = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.

""" + _MIT[_MIT.index("THE SOFTWARE IS PROVIDED"):]
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""


def _gnu_notice(name: str, version: str, short: str = "") -> str:
    """The notice that the GNU licences ask for; ``short`` is the name as the last sentence has it."""
    short = short or name
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.

You should have received a copy of the {short} along with this program. If not, see <https://www.gnu.org/licenses/>."""


#: Known licences and notices: (id, text). Longer licences come as a table (see ``scan``).
KNOWN = [
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC), ("ISC", "ISC License\n\n" + _ISC),
    ("BSD-2-Clause", _BSD2 + _BSD_END), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD2 + _BSD_END),
    ("BSD-3-Clause", _BSD2 + _BSD3_NAME + _BSD_END), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD2 + _BSD3_NAME + _BSD_END),
    ("0BSD", _0BSD), ("0BSD", "BSD Zero Clause License\n\n" + _0BSD), ("MIT-0", _MIT0), ("MIT-0", "MIT No Attribution\n\n" + _MIT0), ("Zlib", _ZLIB), ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Unlicense", _UNLICENSE), ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>"),
    ("BSL-1.0", _BOOST), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + _BOOST),
    ("Apache-2.0", _APACHE_NOTICE), ("GPL-3.0-or-later", _gnu_notice("GNU General Public License", "3")), ("GPL-2.0-or-later", _gnu_notice("GNU General Public License", "2")),
    ("AGPL-3.0-or-later", _gnu_notice("GNU Affero General Public License", "3")), ("LGPL-3.0-or-later", _gnu_notice("GNU Lesser General Public License", "3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."), ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def canonical(text: Column) -> Column:
    out = F.translate(text, UPPER, UPPER.lower())
    out = F.regexp_replace(out, COPYRIGHT_LINE, "")
    out = F.trim(F.regexp_replace(out, NOT_WORD, " "))
    for pattern, word in SPELLINGS:
        out = F.regexp_replace(out, pattern, word)
    return out


def canonical_text(text: str) -> str:
    """The same form for the texts of the table, worked out on the driver."""
    out = "".join(c.lower() if c in UPPER else c for c in text)
    out = re.sub(COPYRIGHT_LINE.replace(r"[^\p{L}\p{N}\n©]", r"[^\w\n©]"), "", out)
    out = re.sub(r"[\W_]+", " ", out).strip(" ")
    for pattern, word in SPELLINGS:
        out = re.sub(pattern, word, out)
    return out


def known_digests(known: list[tuple[str, str]] = KNOWN) -> dict[str, str]:
    """Digest -> licence; of two licences with one digest the first counts."""
    out: dict[str, str] = {}
    for name, text in known:
        form = canonical_text(text)
        if form:
            out.setdefault(hashlib.sha256(form.encode()).hexdigest(), name)
    if len(out) > MAX_KNOWN:
        raise ValueError(f"at most {MAX_KNOWN} known texts")
    return out


def scan(docs: DataFrame, known: list[tuple[str, str]] = KNOWN, text: str = "text", more: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``digest``, ``license`` (of the whole text) and ``notices``: (line from 0, license) of each line that is a known notice.

    ``more`` is a table of further whole texts, ``license`` and ``text``, of any size: it is brought into the same form here, joined by
    digest, broadcast if it has ``MAX_KNOWN`` rows at most. Of two licences with one digest the list's counts, then the first by name.
    """
    docs = docs.drop("digest", "license", "notices")  # columns of these names are replaced
    digests = known_digests(known)
    spark = docs.sparkSession
    values = ", ".join(f"('{d}', '{n}')" for d, n in digests.items())
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t(_digest, license)") if digests else spark.sql("SELECT '' AS _digest, '' AS license WHERE false")
    if more is not None:
        form = canonical(F.col("text"))
        given = more.where(form != "").groupBy(F.sha2(form, 256).alias("_digest")).agg(F.min("license").alias("license"))
        table = table.unionByName(given.join(table.select("_digest"), "_digest", "left_anti"))
        table = F.broadcast(table) if table.limit(MAX_KNOWN + 1).count() <= MAX_KNOWN else table
    else:
        table = F.broadcast(table)  # of MAX_KNOWN rows at most
    t = F.col(f"`{text}`")
    whole = docs.withColumn("digest", F.sha2(canonical(t), 256)).join(table, F.col("digest") == F.col("_digest"), "left").drop("_digest")
    # a line can only equal a known text that is as long, so others are not normalised; the lookup is a map of bounded size
    if not digests:
        return whole.withColumn("notices", F.array().cast("array<struct<line:int,license:string>>"))
    lookup = F.create_map(*[F.lit(x) for kv in digests.items() for x in kv])
    marker = F.transform(F.split(t, "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("x")))
    likely = F.filter(marker, lambda s: s["x"].rlike(_stem(known)))
    found = F.transform(likely, lambda s: F.struct(s["line"].alias("line"), F.try_element_at(lookup, F.sha2(canonical(s["x"]), 256)).alias("license")))
    notices = F.filter(found, lambda s: s["license"].isNotNull())
    return whole.withColumn("notices", F.coalesce(notices, F.array().cast("array<struct<line:int,license:string>>")))


def _stem(known: list[tuple[str, str]]) -> str:
    """A pattern that every line equal to a known text must meet: the last canonical word of one of them."""
    ends = {canonical_text(x).split(" ")[-1] for _, x in known} - {""}
    ends |= {e.replace("license", "licence") for e in ends}
    return "(?i)(" + "|".join(re.escape(e) for e in sorted(ends)) + r")[^\p{L}\p{N}]*$"


SQL = """
WITH lowered AS (SELECT doc_id, text, translate(text, '{upper}', '{lower}') AS t FROM documents),
known(digest, license) AS (VALUES {values}),
whole AS (SELECT doc_id, sha256({canon_t}) AS digest FROM lowered),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS line FROM lowered),
notices AS (
  SELECT l.doc_id, count(*) AS n, string_agg(l.line || ':' || k.license, ',' ORDER BY l.line) AS found
  FROM lines l JOIN known k ON sha256({canon_x}) = k.digest WHERE l.x LIKE '%licen_e%' OR l.x LIKE '%cc0%' OR l.x LIKE '%cc by%' OR l.x LIKE '%software%' GROUP BY l.doc_id
)
SELECT w.doc_id, w.digest, k.license, coalesce(n.n, 0)::BIGINT AS n_notices, coalesce(n.found, '') AS notices
FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN notices n USING (doc_id)
"""


def oracle(known: list[tuple[str, str]] = KNOWN) -> str:
    def canon(x: str) -> str:
        out = f"trim(regexp_replace(regexp_replace({x}, '{COPYRIGHT_LINE}', '', 'g'), '{NOT_WORD}', ' ', 'g'), ' ')"
        for pattern, word in SPELLINGS:
            out = f"regexp_replace({out}, '{pattern}', '{word}', 'g')"
        return out

    values = ", ".join(f"('{d}', '{n}')" for d, n in known_digests(known).items())
    return SQL.format(upper=UPPER, lower=UPPER.lower(), values=values, canon_t=canon("t"), canon_x=canon("x"))
