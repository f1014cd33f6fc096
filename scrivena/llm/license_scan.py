"""Licence scan by canonical digests, with DataFrame functions only.

A text is made canonical (lower case, copyright lines dropped, equivalent
spellings made one, punctuation and runs of white space made one space) and
its SHA-256 is hash-joined with the digests of known licence texts and
notices, made canonical the same way.  So a document is found that is, as a
whole, a known text; its lines are joined with the same digests.

Every known text has one of a few words, ``ANCHORS``, that making it canonical
neither makes nor destroys; only texts and lines that have one are made
canonical and hashed, as no other can be a known one.  The digests of known
texts are broadcast if there are at most ``BROADCAST_DIGESTS``.

Cases: a null text is empty, an empty text is no licence; very long texts are
read whole; repeated rows are judged each for itself; known texts that are
canonically equal go by the alphabetically first name; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import functools
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivena.plans.staging import stage

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

# Licence texts and notices, by SPDX name.
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-or-later", _GPL),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
]
# Of which each known text has one, whole, in its canonical form and as it stands.
ANCHORS = ["licen", "permission", "reserved", "redistribution", "unencumbered", "cc0"]
BROADCAST_DIGESTS = 10_000
# Fixed values: (pattern, one spelling) over lower-cased text; patterns that Java's and RE2's syntax share.
SPELLINGS = [
    (r"\blicen[cs]es\b", "licenses"),
    (r"\blicence\b", "license"),
    (r"\blicenced\b", "licensed"),
    (r"\bsub-?licen[cs]e\b", "sublicense"),
    (r"\bnon-?infringement\b", "noninfringement"),
    (r"\bnon-?commercial\b", "noncommercial"),
    (r"\bhttp://", "https://"),
    (r"\borganisation\b", "organization"),
    (r"\bunauthorised\b", "unauthorized"),
    (r"\bversion\b", "v"),
]
# A copyright notice's line. A line of prose that is wrapped before "copyright notice" or the like is none, unless it has a year.
COPYRIGHT_LINE = (
    r"(^|\n)[ \t]*(copyright[ \t]+(?![ \t])(?!(?:notices?|holders?|owners?|laws?|licen[cs]es?|statements?|interests?|rights?|claims?|protections?|permissions?|and|or|in|is|to)"
    r"(?![a-z0-9_])(?![^\n]*(?<![0-9])(?:19|20)[0-9][0-9](?![0-9])))(?=[^\n])|©|\(c\)[ \t])[^\n]*"
)
# What the SQL below takes for one: RE2 can't look ahead, so the SQL drops wrapped lines of prose too.
SQL_COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright[ \t]|©|\(c\)[ \t])[^\n]*"
PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F«»“”‘’–—…]+"


def known_texts() -> list[tuple[str, str]]:
    """(name, text): ``KNOWN`` and the whole licences that lie beside this module, each under its SPDX name."""
    files = sorted((f for f in resources.files(__package__).joinpath("licenses").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return [*KNOWN, *((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in files)]


def anchored(low: Column) -> Column:
    """Whether a lower-cased text has one of the words that every known text has one of."""
    return functools.reduce(lambda a, b: a | b, (F.contains(low, F.lit(word)) for word in ANCHORS))


def canonical(low: Column) -> Column:
    """Canonical text, line by line, of a lower-cased text."""
    out = F.regexp_replace(low, COPYRIGHT_LINE, "\n")
    for pattern, spelling in SPELLINGS:
        out = F.regexp_replace(out, pattern, spelling)
    return F.regexp_replace(out, PUNCTUATION, " ")


def digest_of_whole(low: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(canonical(low), "[ \n]+", " ")), 256)


def digests_of_lines(low: Column) -> Column:
    """Digests of the lines that have an anchor, if they aren't copyright lines."""
    lines = F.filter(F.split(low, "\n"), anchored)
    return F.transform(F.filter(F.transform(lines, lambda x: F.trim(canonical(x))), lambda x: x != ""), lambda x: F.sha2(x, 256))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license) of each different known text."""
    rows = spark.createDataFrame(known_texts() if known is None else known, "license string, text string")
    return rows.groupBy(digest_of_whole(F.lower("text")).alias("digest")).agg(F.min("license").alias("license"))


def scanned(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, license, n_license_lines, line_licenses) of each row of ``docs`` (doc_id, text).

    license names the known text that the document as a whole is, else null; line_licenses joins, in
    order, the different names of the known texts that single lines are.
    """
    digests = known_digests(docs.sparkSession, known)
    if len(known_texts() if known is None else known) <= BROADCAST_DIGESTS:
        digests = F.broadcast(digests)
    low = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low")).withColumn("may", anchored(F.col("low")))
    hashed = low.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.when(F.col("may"), digest_of_whole(F.col("low"))).alias("digest"),
        F.when(F.col("may"), digests_of_lines(F.col("low"))).alias("lines"),
    )
    rows = stage(hashed, "license-digests")
    none = F.col("digest").isNull()
    clear = rows.filter(none).select("doc_id", F.lit(None).cast("string").alias("license"), F.lit(0).cast("long").alias("n_license_lines"), F.lit("").alias("line_licenses"))
    some = rows.filter(~none).join(digests, "digest", "left")
    lines = rows.filter(~none).select("row", F.explode("lines").alias("digest")).join(digests, "digest")
    names = lines.groupBy("row").agg(F.count(F.lit(1)).alias("n_license_lines"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("line_licenses"))
    found = some.join(names, "row", "left").select("doc_id", "license", F.coalesce("n_license_lines", F.lit(0)).alias("n_license_lines"), F.coalesce("line_licenses", F.lit("")).alias("line_licenses"))
    return clear.unionByName(found)


def oracle_sql(known: list[tuple[str, str]] | None = None) -> str:
    """The same in DuckDB's SQL, for texts that don't wrap before the word copyright."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def lines(column: str) -> str:
        out = f"regexp_replace(lower(coalesce({column}, '')), {quoted(SQL_COPYRIGHT_LINE)}, chr(10), 'g')"
        for pattern, spelling in SPELLINGS:
            out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(spelling)}, 'g')"
        out = f"regexp_replace({out}, {quoted(PUNCTUATION)}, ' ', 'g')"
        return f"list_transform(string_split({out}, chr(10)), lambda x: trim(x, ' '))"

    def joined(column: str) -> str:
        return f"array_to_string(list_filter({column}, lambda x: x <> ''), ' ')"

    values = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in (known_texts() if known is None else known))
    return f"""
with k as (
  select sha256({joined('l')}) as digest, min(license) as license
  from (select license, {lines('text')} as l from (values {values}) t(license, text)) group by 1
),
d as materialized (select row_number() over () as r, doc_id, {lines('text')} as l from documents),
h as (
  select r, count(*) as n, string_agg(distinct license, ',' order by license) as names
  from (select r, unnest(list_filter(l, lambda x: x <> '')) as line from d) u join k on sha256(u.line) = k.digest group by r
)
select doc_id, k.license, coalesce(n, 0)::bigint as n_license_lines, coalesce(names, '') as line_licenses
from d left join k on sha256({joined('l')}) = k.digest left join h using (r)
"""
