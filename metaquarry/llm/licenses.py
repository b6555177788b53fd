"""Licence scan by sentence rules.

Sentences are normalised and mapped to identifiers of known licence sentences. The sequence
of identifiers of a text is then matched against an ordered list of licence rules; a rule
consumes the identifiers it matches, so a specific rule that stands first keeps a general
one from firing on the same sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaquarry.llm.common import BLANKS, let, lower_ascii, query, table

#: Every pattern of SENTENCES implies one of these, whatever blanks and quotes part the words,
#: so a text without them has no known sentence. A new sentence needs its word here.
GATE = (
    r"(?i)licen[cs]e|copyright|permission|redistribut|warrant|liab|spdx|domain|gpl|gnu|hope|cc0"
    r"|cc[^a-z0-9]+by|creative|attribution|endorse|reserved|eupl|altered|unencumbered"
)
#: An SPDX tag; the parts of its expression are sentences of their own.
TAG, OPERATORS = "spdx-license-identifier: ", " (or|and) "
#: What may stand on an operator's right side; other words are text that goes on.
OPERAND = r"^ ?([a-z0-9.+-]*[0-9][a-z0-9.+-]*|mit|isc|zlib|unlicense)( with .*)? ?$"
#: What ends an SPDX identifier, so that none is taken for the start of another.
_STOP = r"([^a-z0-9.+-]|$)"

#: (identifier, pattern) for normalised sentences; the first that matches names the sentence.
SENTENCES = (
    ("SPDX_APACHE2", TAG + r"apache-2\.0" + _STOP),
    ("SPDX_MIT", TAG + "mit" + _STOP),
    ("SPDX_BSD3", TAG + "bsd-3-clause" + _STOP),
    ("SPDX_BSD2", TAG + "bsd-2-clause" + _STOP),
    ("SPDX_LGPL", TAG + r"lgpl-[0-9.]+(-only|-or-later|\+)?" + _STOP),
    ("SPDX_AGPL", TAG + r"agpl-[0-9.]+(-only|-or-later|\+)?" + _STOP),
    ("SPDX_GPL", TAG + r"gpl-[0-9.]+(-only|-or-later|\+)?" + _STOP),
    ("SPDX_MPL2", TAG + r"mpl-2\.0" + _STOP),
    ("SPDX_OTHER", TAG + "[a-z0-9.+-]+"),
    ("APACHE2_GRANT", r"licensed under (the )?apache license,? (version )?2(\.0)?\b"),
    ("APACHE1", r"apache (software )?license,? (version )?1\.[01]\b"),
    ("APACHE2_COMPLY", r"you may not use this (file|work|software) except in compliance with the license"),
    ("APACHE2_COPY", r"you may obtain a copy of the license at"),
    ("APACHE2_ASIS", r"distributed under the license is distributed on an as is basis"),
    ("APACHE2_SEE", r"see the license for the specific language governing permissions"),
    ("AGPL_LATER", r"gnu affero general public license.*version [0-9.]+.*any later version"),
    ("AGPL", r"gnu affero general public license|\bagpl"),
    ("LGPL_LATER", r"gnu (lesser|library) general public license.*version [0-9.]+.*any later version"),
    ("LGPL", r"gnu (lesser|library) general public license|\blgpl"),
    ("GPL3_LATER", r"gnu general public license.*version 3.*any later version"),
    ("GPL2_LATER", r"gnu general public license.*version 2.*any later version"),
    ("GPL3", r"(gnu general public license|\bgpl),? ?(v|version )3|\bgpl-?3"),
    ("GPL2", r"(gnu general public license|\bgpl),? ?(v|version )2|\bgpl-?2"),
    ("GPL_HOPE", r"distributed in the hope that it will be useful"),
    ("GPL_COPY", r"you should have received a copy of the gnu"),
    ("GPL_ANY", r"gnu general public license|\bgnu gpl\b"),
    ("MPL2", r"mozilla public license,? ?(v\. ?|version )2"),
    ("EPL", r"eclipse public license"),
    ("CC0", r"\bcc0\b|creative commons zero"),
    ("CC_BY_NC_SA", r"cc[ -]by-nc-sa|attribution-noncommercial-sharealike"),
    ("CC_BY_NC_ND", r"cc[ -]by-nc-nd|attribution-noncommercial-noderiv"),
    ("CC_BY_NC", r"cc[ -]by-nc|attribution-noncommercial"),
    ("CC_BY_SA", r"cc[ -]by-sa|attribution-sharealike"),
    ("CC_BY_ND", r"cc[ -]by-nd|attribution-noderiv"),
    ("CC_BY", r"cc[ -]by\b|creative commons attribution"),
    ("MIT_NAMED", r"(licensed|released|distributed|available) under (the )?(terms of the )?(mit|expat) license"),
    ("MIT_TITLE", r"^ ?(the )?(mit|expat) license( mit)? ?$|\blicense: (mit|expat) ?$"),
    ("MIT_GRANT", r"permission is hereby granted,? free of charge,? to any person obtaining a copy"),
    ("MIT_NOTICE", r"the above copyright notice and this permission notice shall be included"),
    ("MIT_ASIS", r"the software is provided as is ?,? without warranty"),
    ("MIT_LIABLE", r"in no event shall the authors or copyright holders be liable"),
    ("ISC_GRANT", r"permission to use,? copy,? modify,? and(/or| or)? distribute this software"),
    ("ISC_NAMED", r"under (the )?(terms of the )?isc license|^ ?(the )?isc license ?$"),
    ("ZLIB", r"\bzlib license\b|altered source versions must be plainly marked as such"),
    ("UNLICENSE", r"this is free and unencumbered software released into the public domain|\bthe unlicense\b"),
    ("BOOST", r"boost software license"),
    ("OFL", r"sil open font license"),
    ("ARTISTIC", r"\bartistic license\b"),
    ("EUPL", r"european union public license|\beupl\b"),
    ("BSD_NAMED", r"under (the )?(terms of the )?(new |simplified |modified )?bsd license"),
    ("BSD_GRANT", r"redistribution and use in source and binary forms"),
    ("BSD_SOURCE", r"redistributions of source code must retain"),
    ("BSD_BINARY", r"redistributions in binary form must reproduce"),
    ("BSD_ENDORSE", r"neither the name of .* may be used to endorse or promote"),
    ("BSD_ASIS", r"this software is provided by .* as is and any express or implied warranties"),
    ("PUBLIC_DOMAIN", r"(dedicated|released) (in)?to the public domain|is in the public domain"),
    ("ALL_RIGHTS", r"all rights reserved"),
)

#: (licence, identifiers in their order), tried from first to last. ``?`` marks what may lack.
RULES = (
    ("Apache-2.0", "APACHE2_GRANT APACHE2_COMPLY? APACHE2_COPY? APACHE2_ASIS? APACHE2_SEE?"),
    ("Apache-2.0", "SPDX_APACHE2"),
    ("Apache-1", "APACHE1"),
    ("MIT", "MIT_TITLE? MIT_GRANT MIT_NOTICE? MIT_ASIS? MIT_LIABLE?"),
    ("MIT", "MIT_TITLE"),
    ("MIT", "MIT_NAMED"),
    ("MIT", "SPDX_MIT"),
    ("ISC", "ISC_GRANT MIT_ASIS?"),
    ("ISC", "ISC_NAMED"),
    ("Zlib", "ZLIB"),
    ("Unlicense", "UNLICENSE"),
    ("BSL-1.0", "BOOST"),
    ("OFL", "OFL"),
    ("Artistic", "ARTISTIC"),
    ("EUPL", "EUPL"),
    ("BSD-3-Clause", "BSD_GRANT BSD_SOURCE BSD_BINARY BSD_ENDORSE BSD_ASIS?"),
    ("BSD-2-Clause", "BSD_GRANT BSD_SOURCE BSD_BINARY BSD_ASIS?"),
    ("BSD", "BSD_GRANT"),
    ("BSD", "BSD_NAMED"),
    ("BSD-3-Clause", "SPDX_BSD3"),
    ("BSD-2-Clause", "SPDX_BSD2"),
    ("AGPL-or-later", "AGPL_LATER GPL_HOPE? GPL_COPY?"),
    ("AGPL", "AGPL GPL_HOPE? GPL_COPY?"),
    ("AGPL", "SPDX_AGPL"),
    ("LGPL-or-later", "LGPL_LATER GPL_HOPE? GPL_COPY?"),
    ("LGPL", "LGPL GPL_HOPE? GPL_COPY?"),
    ("LGPL", "SPDX_LGPL"),
    ("GPL-3.0-or-later", "GPL3_LATER GPL_HOPE? GPL_COPY?"),
    ("GPL-2.0-or-later", "GPL2_LATER GPL_HOPE? GPL_COPY?"),
    ("GPL-3.0", "GPL3 GPL_HOPE? GPL_COPY?"),
    ("GPL-2.0", "GPL2 GPL_HOPE? GPL_COPY?"),
    ("GPL", "SPDX_GPL"),
    ("GPL", "GPL_ANY GPL_HOPE? GPL_COPY?"),
    ("MPL-2.0", "MPL2"),
    ("MPL-2.0", "SPDX_MPL2"),
    ("EPL", "EPL"),
    ("CC0-1.0", "CC0"),
    ("CC-BY-NC-SA", "CC_BY_NC_SA"),
    ("CC-BY-NC-ND", "CC_BY_NC_ND"),
    ("CC-BY-NC", "CC_BY_NC"),
    ("CC-BY-SA", "CC_BY_SA"),
    ("CC-BY-ND", "CC_BY_ND"),
    ("CC-BY", "CC_BY"),
    ("Public-Domain", "PUBLIC_DOMAIN"),
    ("Other", "SPDX_OTHER"),
    ("All-Rights-Reserved", "ALL_RIGHTS"),
)

_QUOTES = r"[\x22'`“”‘’*#<>()\[\]]|//"
_END = rf"([.!?;])({BLANKS}+|$)|\n{BLANKS}*\n"


def _rule_pattern(rule: str) -> str:
    """The rule as a pattern on ``<A><B>``; UNKNOWN sentences are not part of the sequence."""
    return "".join(f"(<{part[:-1]}>)?" if part.endswith("?") else f"<{part}>" for part in rule.split())


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known licence sentences of a text, in order, as ``<A><B>``."""
    clean = F.regexp_replace(lower_ascii(text), _QUOTES, " ")
    # the marks of a sentence's end go, the blanks of line breaks inside a sentence too
    cut = F.split(F.regexp_replace(clean, _END, "\u0001"), "\u0001")

    def name_of(s: Column) -> Column:
        named = F.lit("")
        for identifier, pattern in reversed(SENTENCES):
            named = F.when(s.rlike(pattern), f"<{identifier}>").otherwise(named)
        return named

    def parts(s: Column) -> Column:
        expression = F.split(F.regexp_replace(s, f"^.*{TAG}| $", ""), OPERATORS)
        each = F.transform(
            expression,
            lambda p, i: F.when((i == 0) | p.rlike(OPERAND), let(F.concat(F.lit(TAG), p), name_of)).otherwise(""),
        )
        return F.when(s.contains(TAG), F.array_join(each, "")).otherwise(name_of(s))

    def one(s: Column) -> Column:
        return let(F.regexp_replace(F.regexp_replace(s, "licence", "license"), rf"{BLANKS}+", " "), parts)

    return F.array_join(F.transform(cut, one), "")


def licenses_of(ids: Column, rules=RULES) -> Column:
    """Licences of an identifier sequence, in the order in which their rules matched."""
    state = F.struct(ids.alias("left"), F.lit("").alias("found"))
    table_ = F.array(
        *[F.struct(F.lit(lic).alias("name"), F.lit(_rule_pattern(p)).alias("p")) for lic, p in rules]
    )
    return F.aggregate(
        table_,
        state,
        lambda a, r: F.when(
            F.call_function("regexp_like", a["left"], r["p"]),
            F.struct(
                # what a rule took is blanked, so sentences around it do not become neighbours
                F.call_function("regexp_replace", a["left"], r["p"], F.lit("-")).alias("left"),
                F.concat(a["found"], F.lit(","), r["name"]).alias("found"),
            ),
        ).otherwise(a),
        lambda a: F.array_distinct(F.filter(F.split(a["found"], ","), lambda x: x != "")),
    )


def scan_licenses(docs: DataFrame, id_col: str, text_col: str, rules=RULES) -> DataFrame:
    """Identifier sequence and licences of every text.

    Null, empty and unlicensed texts have an empty sequence and no licence; texts of any length
    are read whole. Repeated rows are scanned alike, a null id stays null, and other columns
    are ignored, whatever their names. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    ids = docs.select(
        F.col(id_col),
        F.when(text.rlike(GATE), let(text, sentence_ids)).otherwise("").alias("ids"),
    )
    return ids.select(
        id_col,
        F.col("ids").alias("sentence_ids"),
        F.when(F.col("ids") != "", licenses_of(F.col("ids"), rules))
        .otherwise(F.array().cast("array<string>"))
        .alias("licenses"),
    )


_NAMED = " ".join(f"WHEN regexp_matches(s, '{p}') THEN '<{i}>'" for i, p in SENTENCES)


def _sql_steps() -> str:
    steps, left = [], "ids"
    for i, (lic, rule) in enumerate(RULES):
        p = _rule_pattern(rule)
        steps.append(
            f"s{i} AS (SELECT r, doc_id, sentence_ids, regexp_replace(ids, '{p}', '-', 'g') AS ids, "
            f"CASE WHEN regexp_matches(ids, '{p}') AND NOT list_contains(found, '{lic}') "
            f"THEN list_append(found, '{lic}') ELSE found END AS found FROM {'start' if i == 0 else f's{i - 1}'})"
        )
    return ",\n".join(steps)


_SQL_QUOTES = _QUOTES.replace("'", "''")
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), c AS (
  SELECT r, doc_id, regexp_replace(regexp_replace(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '{_SQL_QUOTES}', ' ', 'g'), '{_END}', chr(1), 'g') AS clean
  FROM d
), whole AS (
  SELECT r, doc_id, unnest(range(len(string_split(clean, chr(1))))) AS pos,
    regexp_replace(replace(unnest(string_split(clean, chr(1))), 'licence', 'license'), '{BLANKS}+', ' ', 'g') AS s
  FROM c
), s AS (
  SELECT r, doc_id, [pos, 0] AS pos, s FROM whole WHERE NOT contains(s, '{TAG}')
  UNION ALL
  SELECT r, doc_id, [pos, place], '{TAG}' || part
  FROM (SELECT r, doc_id, pos, unnest(range(len(parts))) AS place, unnest(parts) AS part FROM (SELECT r, doc_id, pos, string_split_regex(regexp_replace(s, '^.*{TAG}| $', '', 'g'), '{OPERATORS}') AS parts
        FROM whole WHERE contains(s, '{TAG}')))
  WHERE place = 0 OR regexp_matches(part, '{OPERAND}')
), n AS (
  SELECT r, string_agg(CASE {_NAMED} ELSE '' END, '' ORDER BY pos) AS ids FROM s GROUP BY r
), start AS (
  SELECT d.r, d.doc_id, coalesce(n.ids, '') AS sentence_ids, coalesce(n.ids, '') AS ids,
    CAST([] AS VARCHAR[]) AS found
  FROM d LEFT JOIN n USING (r)
), {_sql_steps()}
SELECT doc_id, sentence_ids, array_to_string(found, ',') AS licenses FROM s{len(RULES) - 1}
"""


@query("op1_license_scan", SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    found = scan_licenses(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.withColumn("licenses", F.array_join("licenses", ","))
