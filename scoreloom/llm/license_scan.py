"""License scans by canonical digests, in DataFrame operations only.

A text goes through one canonical form, once: no copyright lines, no case, letters and digits only, one spelling. It is
then cut at its lines and blank lines. The SHA-256 digests of the whole text, of each line, and of runs of as many
paragraphs as a known licence has then meet the known digests in a hash join. A title before a licence does not count. No
text is shuffled: what travels is at most a row of counts per document and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .license_texts import TEXTS

#: Licence identifiers and short texts that stand for them.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Licensed under the 3-Clause BSD License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Words of several spellings, as whole words of the canonical form.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("v", "version"), ("ver", "version"))
#: A line that names a holder or a year, not one of a licence's own that begins with the word or with a clause (c).
_COPYRIGHT_LINE = (
    r"(?m)^[^a-z0-9\n]*(?:copyright[^\S\n]*(?:\(c\)|©|[0-9]{4}|by\b|<|\[)|(?:\(c\)|©)[^\S\n]*(?:copyright\b|[0-9]{4})"
    r"|all rights reserved[^a-z0-9\n]*$)[^\n]*$"
)
_OTHER = r"[^\p{L}\p{N}\n]+"
_BLANK = r"\n *\n[ \n]*"
#: Titles before a licence's text, in canonical form with words two spaces apart.
TITLES = (
    r"(?:the  )?(?:mit|expat|isc|zlib|unlicense|bsd)(?:  license)?(?:  (?:mit|isc|expat|zlib))?", r"(?:the  )?bsd  [23]  clause(?:  (?:simplified|new|revised))?  license",
    r"(?:the  )?[23]  clause  bsd  license", r"license",
)
_TITLE = rf"^(?:{'|'.join(TITLES)})  ((?:permission|redistribution|this|anyone|copyright|licensed)  )"
#: Digests of licences' published full texts in canonical form.
FULL_TEXTS = (
    ("Apache-2.0", "f3cc1dfc362d7417ac0bf292237d22e1ce49d16823d315a92134a2731d462e9b"),
    ("CC0-1.0", "486461039ee45758464705262c9cdb8e477df64167788c86caed48890c299ded"),
    ("GFDL-1.2", "e9d37f1af9e55d1b29718ff0dd4e2583340a45ba56c062b54ac2bffa6b9184ac"),
    ("GFDL-1.3", "6fbbb28d155387ad69422adfd39ef7b89fc749edfdf997c7dd351c6158bd2298"),
    ("GPL-1.0", "869d156f07824e4287a2959e638586941efcb3774b5e407be30ff180ac13548b"),
    ("GPL-2.0", "64a86f1d3531a8b5c1d2f564c01882c63b58c93fbfb517279bfaa9a261cb1796"),
    ("GPL-3.0", "1762992c0f76994ca6cd4de78ffa1345f8e322e1a230f87cf23660dac7bf8314"),
    ("LGPL-2.0", "4921f4e1e5e73369d202e5c7683c965b4d275ba35f23c50d389e92705d9cc84e"),
    ("LGPL-2.1", "a65b75d251fb56c535ec7079440f5d167ec95725dd20f1d16677176defe487a3"),
    ("LGPL-3.0", "572947626844a56d29ace510237040204d4085696621f319533ca366aa897913"),
    ("MPL-1.1", "cf04365fb54d46ae84a99c759b9e129887c8172790a73e293478decd8b15099b"),
    ("MPL-2.0", "d457835784fb831c7175f5a81d908e3f5a9cc379dfe74ec378ffe9f26f263c3e"),
)


def canonical(text: Column) -> Column:
    """Lower case, letters and digits, words two spaces apart, without copyright lines; line breaks stay."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), _COPYRIGHT_LINE, " "), _OTHER, "  ")
    plain = F.concat(F.lit("  "), F.replace(plain, F.lit("\n"), F.lit("  \n  ")), F.lit("  "))
    for variant, usual in SPELLINGS:
        plain = F.replace(plain, F.lit(f" {variant} "), F.lit(f" {usual} "))
    return plain


def _joined(plain: Column) -> Column:
    """One line of a canonical text."""
    return F.trim(F.regexp_replace(plain, r"[ \n]+", "  "))


def _untitled(plain: Column) -> Column:
    return F.regexp_replace(plain, _TITLE, "$1")


def paragraphs(plain: Column) -> Column:
    """The paragraphs of a canonical text that have words, a line each."""
    return F.filter(F.transform(F.split(plain, _BLANK), _joined), lambda p: p != "")


def digest(plain: Column) -> Column:
    return F.unhex(F.sha2(plain, 256))


def known_digests(known: DataFrame) -> DataFrame:
    """(license_id, digest, paragraphs) of a table of licence texts (license_id, text), titles left out. Of licences with
    one canonical text the smallest identifier counts; texts without words have none."""
    rows = known.select("license_id", canonical(F.col("text")).alias("plain")).select("license_id", _untitled(_joined(F.col("plain"))).alias("whole"), paragraphs(F.col("plain")).alias("parts"))
    title = F.get("parts", F.lit(0)).rlike(rf"^(?:{'|'.join(TITLES)})$").cast("int")
    return rows.where("whole <> ''").groupBy(digest(F.col("whole")).alias("digest")).agg(F.min("license_id").alias("license_id"), F.min(F.size("parts") - title).alias("paragraphs"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, full_texts: tuple[tuple[str, str], ...] = FULL_TEXTS) -> DataFrame:
    """One row per doc_id: doc_id, whole_license, license_ids, n_license_lines, n_lines.

    docs: doc_id, text; known: license_id, text (KNOWN and TEXTS by default; a table of licence texts, joined by
    Spark's choice of strategy); full_texts: (license_id, hex digest) of texts that are only told as whole documents.
    whole_license is the smallest identifier whose text the whole document is, or ''. license_ids lists, sorted and
    comma-joined, every licence that the document, one of its lines or a run of its paragraphs is; paragraphs end at
    lines without letters and digits, so a licence in a comment is found. Null and empty texts have one empty line; empty
    canonical texts match nothing. Rows that share a doc_id, null too, are one document: their lines add up.
    """
    spark = docs.sparkSession
    known = known if known is not None else spark.createDataFrame(list(KNOWN + TEXTS), "license_id string, text string")
    digests = known_digests(known)
    lengths = sorted(r["paragraphs"] for r in digests.select("paragraphs").distinct().collect())  # paragraphs of licences: few
    if full_texts:
        more = spark.createDataFrame(list(full_texts), "license_id string, hex string").select(F.unhex("hex").alias("digest"), "license_id")
        digests = digests.select("digest", "license_id").unionByName(more).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    rows = docs.select("doc_id", canonical(F.coalesce("text", F.lit(""))).alias("plain"))
    rows = rows.select("doc_id", "plain", F.transform(F.split("plain", "\n"), lambda x: F.trim(x)).alias("lines"), paragraphs(F.col("plain")).alias("parts"))
    unit = lambda kind, of: F.struct(F.lit(kind).alias("kind"), digest(of).alias("digest"))
    empty = F.array().cast("array<struct<kind:string,digest:binary>>")

    def runs(length: int) -> Column:
        if length == 1:
            return F.transform("parts", lambda p: unit("block", _untitled(p)))
        starts = F.sequence(F.lit(1), F.size("parts") - length + 1)
        run = F.transform(starts, lambda i: unit("block", _untitled(F.array_join(F.slice("parts", i, F.lit(length)), "  "))))
        return F.when(F.size("parts") >= length, run).otherwise(empty)

    whole = F.array(unit("whole", _untitled(F.array_join("parts", "  "))))
    units = F.concat(whole, F.transform("lines", lambda x: unit("line", x)), *(runs(n) for n in lengths if n > 0))
    units = rows.select("doc_id", F.explode(units).alias("unit")).select("doc_id", "unit.kind", "unit.digest")
    found = units.join(digests.select("digest", "license_id"), "digest", "left").select("doc_id", "license_id", "kind")
    return found.groupBy("doc_id").agg(
        F.coalesce(F.min(F.when(F.col("kind") == "whole", F.col("license_id"))), F.lit("")).alias("whole_license"),
        F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("license_ids"),
        F.count(F.when(F.col("kind") == "line", F.col("license_id"))).alias("n_license_lines"),
        F.count(F.when(F.col("kind") == "line", F.lit(1))).alias("n_lines"),
    )


def query(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


def _canonical_sql(text: str) -> str:
    plain = f"regexp_replace(regexp_replace(lower({text}), '{_COPYRIGHT_LINE}', ' ', 'g'), '{_OTHER}', '  ', 'g')"
    plain = f"'  ' || replace({plain}, chr(10), '  ' || chr(10) || '  ') || '  '"
    for variant, usual in SPELLINGS:
        plain = f"replace({plain}, ' {variant} ', ' {usual} ')"
    return plain


_JOINED_SQL = r"trim(regexp_replace({}, '[ \n]+', '  ', 'g'))"
_PARTS_SQL = f"list_filter(list_transform(regexp_split_to_array(plain, '{_BLANK}'), lambda p: {_JOINED_SQL.format('p')}), lambda p: p <> '')"
_UNTITLED_SQL = f"regexp_replace({{}}, '{_TITLE}', '\\1')"
_VALUES = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN + TEXTS)
_FULL = "".join(f" UNION ALL SELECT '{name}', '{value}', 0" for name, value in FULL_TEXTS)
SQL = f"""
WITH kt AS (SELECT license_id, {_canonical_sql("text")} AS plain FROM (VALUES {_VALUES}) AS v(license_id, text)),
kp AS (SELECT license_id, {_PARTS_SQL} AS parts, {_UNTITLED_SQL.format(_JOINED_SQL.format("plain"))} AS whole FROM kt),
ka AS (SELECT license_id, sha256(whole) AS digest, len(parts) - regexp_matches(parts[1], '^(?:{'|'.join(TITLES)})$')::INT AS n FROM kp{_FULL}),
k AS (SELECT digest, min(license_id) AS license_id FROM ka GROUP BY 1),
lens AS (SELECT DISTINCT m AS n FROM (SELECT digest, min(n) AS m FROM ka WHERE n > 0 GROUP BY 1)),
d AS (SELECT doc_id, row_number() OVER () AS r, {_canonical_sql("coalesce(text, '')")} AS plain FROM documents),
p AS (SELECT doc_id, plain, {_PARTS_SQL} AS parts FROM d),
u AS (SELECT doc_id, 'whole' AS kind, {_UNTITLED_SQL.format("coalesce(list_aggregate(parts, 'string_agg', '  '), '')")} AS unit FROM p
      UNION ALL SELECT doc_id, 'line', trim(unnest(string_split(plain, chr(10)))) FROM p
      UNION ALL SELECT doc_id, 'block', {_UNTITLED_SQL.format("list_aggregate(parts[i:i + n - 1], 'string_agg', '  ')")} FROM p, lens, unnest(range(1, len(parts) - n + 2)) AS x(i)),
m AS (SELECT doc_id, kind, license_id FROM (SELECT doc_id, kind, sha256(unit) AS digest FROM u) LEFT JOIN k USING (digest))
SELECT doc_id, coalesce(min(license_id) FILTER (kind = 'whole'), '') AS whole_license,
       coalesce(string_agg(DISTINCT license_id, ',' ORDER BY license_id), '') AS license_ids,
       count(license_id) FILTER (kind = 'line') AS n_license_lines, count(*) FILTER (kind = 'line') AS n_lines
FROM m GROUP BY doc_id
"""
