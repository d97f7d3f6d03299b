"""Operator 10: licence scan by canonical digests of entire texts.

A text's canonical form is its lower case without copyright lines, with equivalent
spellings made one, and with every run of anything but letters and digits as one
space.  The SHA-256 of that form is joined to the digests of known licence texts,
which are put into the same form by the same expressions.  The scan is made of
DataFrame functions alone.

``digest`` is that of the canonical form, as the SQL has it.  A text that is not found
by it is looked up by a second form, :func:`body`, which drops only real copyright
notices (a year, (c) or a name follows), so that a wrapped line of a licence that
begins with "copyright" stays, and takes any name in the third clause of BSD.

The known licences are a small table of a parameter's size, checked before it is
broadcast.

Cases: a null text counts as the empty text, and a text whose canonical form is
empty matches nothing; of several known licences with one digest the least id
counts; repeated rows each give a row; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_KNOWN = 10_000

# Equivalent spellings, applied in this order to lower-case text.
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("per cent", "percent"), ("organisation", "organization"),
    ("copyright owner", "copyright holder"), ("whilst", "while"), ("wilful", "willful"), ("favour", "favor"), ("merchantability", "merchantability"),
    ("authorised", "authorized"), ("initialise", "initialize"), ("analogue", "analog"), ("fulfilment", "fulfillment"), ("judgement", "judgment"), ("https://", "http://"),
)

#: A line that begins with a copyright notice, or reserves all rights.
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright([ \t]|\(c\)|©|:|$)|\(c\)[ \t]|©|all rights reserved)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"

# Texts of known licences and notices.
KNOWN = (
    ("Apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("MIT-line", "Released under the MIT License."),
    ("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0-notice", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MPL-2.0-notice", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
)


#: Usual title lines of the texts in KNOWN; the texts of files hold their own.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
}
TEXTS = Path(__file__).parent / "licence_texts"

#: A real notice: a year, (c) or a capital name follows; licences' own lines of that kind (the Foundation's, and those in how-to parts) stay.
NOTICE = (
    r"(?m)^[ \t]*(?!.*(?:(?i)free software foundation|<name of author>|year +name of author|\[yyyy\]))"
    r"(?:(?i:copyright)[ \t:]*(?:(?i:\(c\))|©|<|\d{4})|(?:(?i:\(c\))|©)[ \t]*(?:(?i:copyright)|\d{4})"
    r"|(?:Copyright|COPYRIGHT)[ \t:]+(?!(?i:holders?|owners?|notices?|licen[cs]es?|laws?|and|or|in|is|of|interests?|statements?|permissions?|the|for|treaty|doctrines?|status|disclaimers?|claims?|protection)\b)\p{Lu}"
    r"|(?i:all rights reserved)\.?[ \t]*$)[^\n]*$"
)


def known_texts() -> list[tuple[str, str]]:
    """KNOWN, the third clause of BSD, their titled variants, and the texts of files, with and without what follows their terms."""
    own = dict(KNOWN)
    head, tail = own["BSD-2-Clause"].split("THIS SOFTWARE IS", 1)
    own["BSD-3-Clause"] = head + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS" + tail
    out = list(own.items())
    out += [(i, f"{title}\n\n{own[i]}") for i, titles in TITLES.items() for title in titles]
    for path in sorted(TEXTS.glob("*.txt")):
        text = path.read_text("utf-8")
        out.append((path.stem, text))
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        if end:
            out += [(path.stem, terms), (path.stem, terms + end)]
    return out


def body(text: Column) -> Column:
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    out = F.lower(F.regexp_replace(F.regexp_replace(out, NOTICE, ""), "-\n[ \t]*", "-"))  # a word wrapped at its hyphen is one
    out = F.regexp_replace(out, r"\s+", " ")  # spellings of two words may be wrapped too
    for other, one in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(one))
    out = F.trim(F.regexp_replace(out, NOT_WORD, " "))
    return F.regexp_replace(out, r"neither the name .{1,300}? may be used to endorse", "neither the name may be used to endorse")


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "\r\n?", "\n")
    out = F.regexp_replace(out, COPYRIGHT_LINE, "")
    for other, one in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(one))
    return F.trim(F.regexp_replace(out, NOT_WORD, " "))


def known_licences(spark: SparkSession, known=None) -> DataFrame:
    """digest and license_id of each known text, in both forms."""
    known = known_texts() if known is None else known
    if len(known) > MOST_KNOWN:
        raise ValueError(f"at most {MOST_KNOWN} known licences")
    rows = spark.createDataFrame([tuple(k) for k in known], "license_id string, text string")
    forms = rows.select("license_id", F.explode(F.array(canonical(F.col("text")), body(F.col("text")))).alias("form"))
    return forms.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The operator: doc_id, digest, license_id (null where the text is no known licence) for each document."""
    form = canonical(F.col("text").cast("string"))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(form, 256).alias("digest"), F.sha2(body(F.col("text").cast("string")), 256).alias("body"), (form == "").alias("blank"))
    second = known.select(F.col("digest").alias("body"), F.col("license_id").alias("by_body"))
    joined = found.join(F.broadcast(known), "digest", "left").join(F.broadcast(second), "body", "left")
    return joined.select("doc_id", "digest", F.when(~F.col("blank"), F.coalesce("license_id", "by_body")).alias("license_id"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), known_licences(spark))


def oracle() -> str:
    """The same scan in DuckDB SQL."""
    text = lambda s: "'" + s.replace("'", "''") + "'"

    def form(column: str) -> str:
        out = f"regexp_replace(regexp_replace(lower(coalesce({column}, '')), '\\r\\n?', chr(10), 'g'), {text(COPYRIGHT_LINE)}, '', 'g')"
        for other, one in SPELLINGS:
            out = f"replace({out}, {text(other)}, {text(one)})"
        return f"trim(regexp_replace({out}, {text(NOT_WORD)}, ' ', 'g'))"

    values = ", ".join(f"({text(i)}, {text(t)})" for i, t in KNOWN)
    return f"""WITH known AS (SELECT sha256({form('text')}) AS digest, min(license_id) AS license_id FROM (VALUES {values}) AS k(license_id, text) GROUP BY 1),
formed AS (SELECT doc_id, {form('text')} AS form FROM documents)
SELECT doc_id, sha256(form) AS digest, CASE WHEN form <> '' THEN license_id END AS license_id
FROM formed LEFT JOIN known ON known.digest = sha256(form)"""
