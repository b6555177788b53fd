"""Quality rules: a table of thresholds compiled into one Spark projection.

A measure is a count taken from the whole text. A rule bounds the ratio of two measures; the
table of rules becomes one array of failed rule names per row. There is no join, no shuffle
and no user function: the plan is one scan and one projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaquarry.llm.common import BLANK_CHARS, BLANKS, WORD, let, query, table

SYMBOLS = "#*$%&|<>"
MARKS = "!?"
#: Frequent function words of the corpus languages, as they stand or with a capital.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "have", "in", "is", "it", "of", "on",
    "or", "that", "the", "this", "to", "was", "with",
    "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "ist", "mit", "nicht", "und",
    "von", "zu",
    "au", "avec", "dans", "de", "du", "en", "est", "et", "la", "le", "les", "pas", "pour", "que",
    "qui", "sur", "un", "une",
    "con", "del", "el", "las", "los", "no", "para", "por", "se", "una", "y",
)
WINDOW = 5

#: Limits of the fixed base check.
BASE_MIN_WORDS, BASE_MAX_REPEAT_PERCENT = 10, 20


@dataclass(frozen=True)
class Rule:
    """Bounds, in thousandths, on numerator / denominator for texts of ``min_words`` or more."""

    name: str
    numerator: str
    denominator: str
    low: int = 0
    high: int | None = None
    min_words: int = 0


RULES = (
    Rule("word_length", "word_chars", "n_words", 2_000, 14_000),
    Rule("symbols", "n_symbols", "n_words", 0, 100),
    Rule("marks", "n_marks", "n_words", 0, 500),
    Rule("stop_words", "n_stop_words", "n_words", 10, None, min_words=100),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 0, 500, min_words=10),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", 0, 300, min_words=10),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", 0, 900, min_words=10),
)


def _count(values: Column, test) -> Column:
    return F.size(F.filter(values, test)).cast("long")


def _without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of ``window`` words that occur twice or more.

    Windows are compared by a 64-bit hash within one text.
    """

    def marked(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            pairs,
            lambda p: F.sort_array(
                F.transform(
                    F.filter(
                        p,
                        lambda x, k: F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            ),
        )

    def covered(starts: Column) -> Column:
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, i: F.struct(
                (a["n"] + i + window - F.greatest(i, a["end"])).alias("n"), (i + window).alias("end")
            ),
            lambda a: a["n"],
        )

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - window),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]),
    )
    return F.when(
        F.size(words) > window,
        let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(marked(h))),
        ),
    ).otherwise(0)


def measures(text: Column) -> Column:
    """All counts of a text as one struct; a null text counts as an empty one."""

    def of(t: Column) -> Column:
        n_chars = F.char_length(t)
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
        stops = [v for w in STOP_WORDS for v in (w, w.capitalize())]
        return let(
            F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
            lambda words: let(
                lines,
                lambda lines: F.struct(
                    F.size(words).cast("long").alias("n_words"),
                    _without(t, BLANK_CHARS).cast("long").alias("word_chars"),
                    (n_chars - _without(t, SYMBOLS)).cast("long").alias("n_symbols"),
                    (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                    repeat_words(words).cast("long").alias("n_repeat_words"),
                    (n_chars - _without(t, MARKS)).cast("long").alias("n_marks"),
                    _count(words, lambda w: w.isin(stops)).alias("n_stop_words"),
                    F.size(lines).cast("long").alias("n_lines"),
                    _count(lines, lambda x: x.rlike(rf"(\.\.\.|…){BLANKS}*$")).alias("n_ellipsis_lines"),
                    _count(lines, lambda x: x.rlike(rf"^{BLANKS}*[-•‣*]{BLANKS}")).alias("n_bullet_lines"),
                ),
            ),
        )

    return let(F.coalesce(text, F.lit("")), of)


def failed_rules(m: Column, rules=RULES) -> Column:
    """Names of the rules that a struct of measures breaks, in the table's order."""
    broken = []
    for r in rules:
        share, whole = m[r.numerator] * 1000, m[r.denominator]
        bad = share < r.low * whole
        if r.high is not None:
            bad = bad | (share > r.high * whole)
        broken.append(F.when(bad & (m["n_words"] >= r.min_words), F.lit(r.name)))
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def judge_quality(docs: DataFrame, id_col: str, text_col: str, rules=RULES) -> DataFrame:
    """Measures, failed rules and verdict of every text.

    A null, empty or blank text has no words and fails the base check. Repeated rows are
    judged alike; a null id stays null; other columns are ignored, whatever their names.
    """
    m = docs.select(F.col(id_col), measures(F.col(text_col)).alias("m"))
    bad = (F.col("m.n_words") < BASE_MIN_WORDS) | (
        100 * F.col("m.n_repeat_words") > BASE_MAX_REPEAT_PERCENT * F.col("m.n_words")
    )
    out = m.select(id_col, "m", bad.alias("base_failed"), failed_rules(F.col("m"), rules).alias("failed"))
    first = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rest = ["n_marks", "n_stop_words", "n_lines", "n_ellipsis_lines", "n_bullet_lines"]
    return out.select(
        id_col,
        *[f"m.{c}" for c in first],
        "base_failed",
        (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"),
        *[f"m.{c}" for c in rest],
        F.array_join("failed", ",").alias("failed"),
    )


def _sql_rule(r: Rule) -> str:
    tests = [f"{r.numerator} * 1000 < {r.low} * {r.denominator}"]
    if r.high is not None:
        tests.append(f"{r.numerator} * 1000 > {r.high} * {r.denominator}")
    return f"CASE WHEN n_words >= {r.min_words} AND ({' OR '.join(tests)}) THEN '{r.name}' END"


_STOPS = ", ".join(f"'{v}'" for w in STOP_WORDS for v in (w, w.capitalize()))
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '{WORD}') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM d
), windows AS (
  SELECT r, unnest(range(1, greatest(len(words) - 3, 1))) AS pos,
    unnest(list_transform(range(1, greatest(len(words) - 3, 1)),
      lambda i: array_to_string(words[i:i + 4], ' '))) AS gram
  FROM w
), repeated AS (
  SELECT r, pos FROM (SELECT r, pos, count(*) OVER (PARTITION BY r, gram) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT pos + o) AS n FROM repeated, (VALUES (0), (1), (2), (3), (4)) AS offsets(o) GROUP BY r
), m AS (
  SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(text, '{BLANKS}', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words,
    length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_marks,
    len(list_filter(words, lambda x: list_contains([{_STOPS}], x))) AS n_stop_words,
    len(lines) AS n_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…){BLANKS}*$'))) AS n_ellipsis_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^{BLANKS}*[-•‣*]{BLANKS}'))) AS n_bullet_lines
  FROM w LEFT JOIN covered USING (r)
), v AS (
  SELECT *, n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > {BASE_MAX_REPEAT_PERCENT} * n_words AS base_failed,
    array_to_string(list_filter([{", ".join(map(_sql_rule, RULES))}], lambda x: x IS NOT NULL), ',') AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND failed = '' AS kept,
  n_marks, n_stop_words, n_lines, n_ellipsis_lines, n_bullet_lines, failed
FROM v
"""


@query("op6_quality_rules", SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return judge_quality(table(spark, sf_dir, "documents"), "doc_id", "text")
