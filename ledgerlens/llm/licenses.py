"""Licence scans by canonical digests (operator 10). DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The wording of well-known licences and of the notices that point to them.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
KNOWN = [
    ("MIT", _MIT_GRANT),
    ("MIT", "MIT License\n\n" + _MIT_GRANT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT_GRANT),
    ("MIT", "The MIT License\n\n" + _MIT_GRANT),
    ("ISC", _ISC_GRANT + "\n\n" + _ISC_END),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + "\n\n" + _ISC_END),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + _BSD_NAME + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_START + _BSD_NAME + _BSD_END),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]
# SHA-256 of the canonical whole texts of longer licences, as the systems' packages ship them.
KNOWN_DIGESTS = [
    ("Apache-2.0", "59fc4bfd310bca26ce67a2ddcefeb4fe9694a70737d94908f69eeb6d0942dba2"),
    ("Artistic-1.0-Perl", "2d660626e0c71ec2936f0c39b004baf073f7a8d645b56b6191daca4bb56a0e3a"),
    ("BSD-3-Clause", "48c8a35a4353dae3524b849cfd2c781b3c935e964f465e15fb0bc23f23cf96ad"),
    ("CC0-1.0", "bd0e52fb1af40ab9797ba72f1d627b83d449e9926f66d21c51209413ac988137"),
    ("GFDL-1.2", "8aeaf5e8e3488d7c9d65e8416c911f7fe37b3bd88429feabc64ec6283117b8eb"),
    ("GFDL-1.3", "fb286966d28cff8aa94a7303127495846303801d66ef183d841d5971038d2aa0"),
    ("GPL-1.0", "3b7c00b08d5c6de2349faf7a31bb6e49ff8a2273a7cfdd16f96859720b00d9ef"),
    ("GPL-2.0", "9aae015a6322bbdec1a61c624a33b2c7d3b56283db1642e6e18d7820d4957b61"),
    ("GPL-3.0", "6ff3a9a8b11f055a64cb21003d19dbe88dd6a41f7487672c402dfe38b6fe2582"),
    ("LGPL-2.0", "2f0a8618627c179dd830ddb8fa74635ae037468a5880f3b46a73915ae1990c24"),
    ("LGPL-2.1", "56d21d93f6012cbd7f1195b72528da245ccf843598ff833a87101eb36863f95b"),
    ("LGPL-3.0", "f0cae4b317f4f263dca8e79625f8d9c7618c87e0ca6665c79b0f1c12ac856938"),
    ("MPL-1.1", "cd5de03902834de96800990f6dd3416470bf9f581eab90fe12aa8f43b6574a9c"),
    ("MPL-2.0", "a90ba5346ad1927fede05edb2d96afdd4948d68d16cef5d29e84239426134356"),
]
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("per cent", "percent"), ("acknowledgement", "acknowledgment"), ("copyright owner", "copyright holder"), ("organisation", "organization"), ("favour", "favor")]
#: Known digests that are sent to every executor, at most (about 100 bytes each).
BROADCAST_ROWS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A copyright line, also behind a comment mark: the word with a sign or a year, the sign alone, or the reservation of rights.
_COPYRIGHT = r"(^|\n)[ \t#/*;%-]*(?:copyright[ \t:]+(?:\(c\)|©|[0-9])|copyright[ \t:][^\n]{0,120}(?:19|20)[0-9][0-9]|(?:\(c\)|©)[ \t]*[0-9a-z]|all rights reserved)[^\n]*"
_MARKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F©‘’“”–—]+"


def canonical(text: Column) -> Column:
    """``text`` in lower case (A to Z), without copyright lines, each run of marks and white space as one blank, with one
    spelling for equivalent ones, and blank at both ends. Null gives a single blank, as does a text without words. Lines that begin
    with (c) count as copyright lines, also items of a list, so a licence with such items must keep its line breaks."""
    out = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    out = F.regexp_replace(out, _COPYRIGHT, "$1")
    out = F.concat(F.lit(" "), F.regexp_replace(out, _MARKS, " "), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.concat(F.lit(" "), F.trim(out), F.lit(" "))


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str]] = KNOWN_DIGESTS) -> DataFrame:
    """license_id and digest of known licence texts and of known digests, one row per digest; two licences with one digest give the
    first by name."""
    rows = spark.createDataFrame(texts, "license_id string, body string")
    given = spark.createDataFrame(digests, "license_id string, digest string")
    return rows.select("license_id", F.sha2(canonical(F.col("body")), 256).alias("digest")).union(given).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text_digest, license_id and line_licenses of every row.

    ``license_id``: the licence whose canonical text is the whole canonical text of the row. ``line_licenses``: the
    licences whose canonical text is one whole line of it, sorted and comma-joined, empty if none. ``known`` (license_id, digest)
    meets the digests in a hash join; it is broadcast if it is counted to have at most BROADCAST_ROWS rows, else both sides are
    shuffled. Null and empty texts match no
    licence. Rows that repeat doc_id and text all stay. Extra columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.sha2(canonical(F.col("text")), 256).alias("text_digest"), F.coalesce("text", F.lit("")).alias("text"))
    units = texts.select("doc_id", "text_digest", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.split("text", "\n"))).alias("line"))
    whole = F.col("whole")
    units = units.select("doc_id", "text_digest", F.col("line").isNull().alias("whole"), F.when(F.col("line").isNull(), F.col("text_digest")).otherwise(F.sha2(canonical(F.col("line")), 256)).alias("digest"))
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    found = units.join(known, "digest", "left").groupBy("doc_id", "text_digest").agg(
        F.count_if(whole).alias("copies"),
        F.max(F.when(whole, F.col("license_id"))).alias("license_id"),
        F.array_join(F.array_sort(F.collect_set(F.when(~whole, F.col("license_id")))), ",").alias("line_licenses"),
    )
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", "text_digest", "license_id", "line_licenses")


def _sql_canonical(text: str) -> str:
    marks = _MARKS.replace("\\u", "\\x{").replace("00A9", "00A9}").replace("2018", "2018}").replace("2019", "2019}").replace("201C", "201C}").replace("201D", "201D}").replace("2013", "2013}").replace("2014", "2014}")
    out = f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"
    out = f"' ' || regexp_replace(regexp_replace({out}, '{_COPYRIGHT}', '\\1', 'g'), '{marks}', ' ', 'g') || ' '"
    for a, b in SPELLINGS:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"' ' || trim({out}, ' ') || ' '"


def sql() -> str:
    values = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
    digests = ", ".join(f"('{i}', '{d}')" for i, d in KNOWN_DIGESTS)
    return f"""
WITH known AS (
  SELECT digest, min(license_id) AS license_id FROM (
    SELECT license_id, sha256({_sql_canonical("body")}) AS digest FROM (VALUES {values}) v(license_id, body) UNION ALL SELECT * FROM (VALUES {digests}) w(license_id, digest)
  ) GROUP BY digest
),
d AS (SELECT row_number() OVER () AS r, doc_id, text, sha256({_sql_canonical("text")}) AS text_digest FROM documents),
l AS (SELECT r, sha256({_sql_canonical("line")}) AS digest FROM (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d)),
f AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS line_licenses FROM l JOIN known USING (digest) GROUP BY r)
SELECT doc_id, text_digest, k.license_id, coalesce(line_licenses, '') AS line_licenses
FROM d LEFT JOIN known k ON d.text_digest = k.digest LEFT JOIN f USING (r)
"""
