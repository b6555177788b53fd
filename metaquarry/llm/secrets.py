"""Secret scan: fixed patterns, and windows of high entropy in candidate strings.

A window of fixed width slides over each candidate. Its Shannon entropy follows from the sum
of ``c * log2(c)`` over its symbol counts, which is kept up to date from the counts of the
one symbol that leaves and the one that enters. Sums are whole millionths, so both sides of
a threshold are decided exactly. Everything is one Spark projection without user functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaquarry.llm.common import let, lower_ascii, query, table


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
#: (kind, pattern with the secret in the last group, least length of the secret), in rank order.
BASE = (
    ("assign", rf"(?:{_NAMES})[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)", 6),
    ("access", r"(AKIA[A-Z0-9]+)", 20),
    ("hex", r"([0-9a-f]+)", 24),
)
#: The same, for a quick look: a text without a match has no span of the kind.
_GATES = (BASE[0][1], r"AKIA[A-Z0-9]{16}", r"[0-9a-f]{24}")


@dataclass(frozen=True)
class CharClass:
    """Candidates of one character class, and the least entropy (bits) of their windows."""

    kind: str
    pattern: str
    needs: tuple[str, ...]
    unlike: str
    bits: float


WINDOW = 20
CLASSES = (
    CharClass("entropy_hex", r"[0-9A-Fa-f]{20,}", ("[0-9]", "[A-Fa-f]"), "^$", 3.0),
    CharClass("entropy_base64", r"[A-Za-z0-9+/_-]{20,}", ("[0-9]", "[A-Z]", "[a-z]"), "^[0-9A-Fa-f]+$", 3.6),
)
#: Values, and texts before a value, that are no secrets (in lower case).
ALLOWED = r"example|placeholder|changeme|dummy|sample|xxxx|0123456789|123456789|abcdefgh"
ALLOWED_BEFORE = r"(sha-?1|sha-?256|sha-?384|sha-?512|md5|commit|revision|checksum|digest|base64)[-:,=\x20\x22\x27]*$"
BEFORE = 24

KINDS = tuple(k for k, _, _ in BASE) + tuple(c.kind for c in CLASSES)
WEIGHTS = [round(1e6 * c * math.log2(c)) if c else 0 for c in range(WINDOW + 1)]
_SPAN = "struct<start:int,rank:int,end:int,kind:string,secret:int>"


def _most(bits: float) -> int:
    """The largest sum of weights of a window that has ``bits`` of entropy."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * 1e6)


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def _span(rank: int, start: Column, end: Column, secret: Column) -> Column:
    return F.struct(
        start.cast("int").alias("start"),
        F.lit(rank).alias("rank"),
        end.cast("int").alias("end"),
        F.lit(KINDS[rank]).alias("kind"),
        secret.cast("int").alias("secret"),
    )


def _matches(text: Column, pattern: str, groups: int, to_spans) -> Column:
    """``to_spans(value, secret, start, piece before)`` of all matches, leftmost first."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    secret = F.regexp_extract_all(text, F.lit(pattern), F.lit(groups))
    step = F.struct(F.lit(0).alias("pos"), _none().alias("out"))

    def walk(parts: Column) -> Column:
        def add(a: Column, i: Column) -> Column:
            piece, value = F.get(parts["pieces"], i), F.get(parts["whole"], i)
            start = a["pos"] + F.char_length(piece)
            return F.struct(
                (start + F.char_length(value)).alias("pos"),
                F.concat(a["out"], to_spans(value, F.get(parts["secret"], i), start, piece)).alias("out"),
            )

        return F.when(
            F.size(parts["whole"]) > 0,
            F.aggregate(F.sequence(F.lit(0), F.size(parts["whole"]) - 1), step, add, lambda a: a["out"]),
        ).otherwise(_none())

    parts = F.struct(whole.alias("whole"), secret.alias("secret"), F.split(text, pattern, -1).alias("pieces"))
    return let(parts, walk)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns; a match whose secret is too short is passed over."""
    found = []
    for rank, ((_, pattern, least), gate) in enumerate(zip(BASE, _GATES, strict=True)):

        def to_spans(value, secret, start, piece, rank=rank, least=least):
            end = start + F.char_length(value)
            return F.when(
                F.char_length(secret) >= least,
                F.array(_span(rank, start, end, end - F.char_length(secret))),
            ).otherwise(_none())

        found.append(F.when(text.rlike(gate), _matches(text, pattern, 1, to_spans)).otherwise(_none()))
    return F.concat(*found)


def dense_range(value: Column, bits: float) -> Column:
    """struct(first, last): from the first to the end of the last window of enough entropy.

    ``first`` is null where no window has it. The state holds the sum of weights of the
    window that ends at a position.
    """
    weights = F.array(*map(F.lit, WEIGHTS))

    def body(chars: Column) -> Column:
        def slide(a: Column, i: Column) -> Column:
            before = F.slice(chars, F.greatest(i - WINDOW, F.lit(1)), F.least(i - 1, F.lit(WINDOW)))
            new = F.get(chars, i - 1)
            old = F.when(i > WINDOW, F.get(chars, i - 1 - WINDOW))

            def moved(window: Column) -> Column:
                n_old = F.size(F.filter(window, lambda c: c == old))
                n_new = F.size(F.filter(window, lambda c: c == new)) - F.coalesce((old == new).cast("int"), F.lit(0))
                out = F.when(i > WINDOW, F.get(weights, n_old - 1) - F.get(weights, n_old)).otherwise(0)
                return a["sum"] + out + F.get(weights, n_new + 1) - F.get(weights, n_new)

            return let(
                let(before, moved),
                lambda total: F.struct(
                    total.cast("int").alias("sum"),
                    F.when((i >= WINDOW) & (total <= _most(bits)), F.coalesce(a["first"], i - WINDOW))
                    .otherwise(a["first"])
                    .alias("first"),
                    F.when((i >= WINDOW) & (total <= _most(bits)), i).otherwise(a["last"]).alias("last"),
                ),
            )

        start = F.struct(
            F.lit(0).alias("sum"),
            F.lit(None).cast("int").alias("first"),
            F.lit(None).cast("int").alias("last"),
        )
        return F.aggregate(F.sequence(F.lit(1), F.size(chars)), start, slide)

    return let(F.split(value, ""), body)


def entropy_spans(text: Column) -> Column:
    found = []
    for rank, c in enumerate(CLASSES, len(BASE)):

        def to_spans(value, secret, start, piece, rank=rank, c=c):
            fits = ~value.rlike(c.unlike) & ~lower_ascii(value).rlike(ALLOWED)
            for need in c.needs:
                fits = fits & value.rlike(need)
            fits = fits & ~lower_ascii(F.right(piece, F.lit(BEFORE))).rlike(ALLOWED_BEFORE)
            dense = F.when(fits, dense_range(value, c.bits))
            return let(
                dense,
                lambda d: F.when(
                    d["first"].isNotNull(),
                    F.array(_span(rank, start + d["first"], start + d["last"], start + d["first"])),
                ).otherwise(_none()),
            )

        gate = text.rlike(c.pattern.replace(",}", "}"))
        found.append(F.when(gate, _matches(text, c.pattern, 0, to_spans)).otherwise(_none()))
    return F.concat(*found)


def secret_spans(text: Column) -> Column:
    """All spans of a text by start, then kind; entropy spans inside a base span are left out."""

    def both(found: Column) -> Column:
        more = F.filter(
            found["more"],
            lambda m: ~F.exists(found["base"], lambda b: (b["start"] <= m["start"]) & (b["end"] >= m["end"])),
        )
        return F.sort_array(F.concat(found["base"], more))

    return let(F.struct(base_spans(text).alias("base"), entropy_spans(text).alias("more")), both)


def find_secrets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, spans) of every row: spans is array<struct<start, rank, end, kind, secret>>.

    Offsets count code points, ends are exclusive, ``secret`` is where the value itself
    begins. A null text is an empty one and has no span. Repeated rows are scanned alike, a
    null id stays null, other columns are ignored, and texts of any length are read whole.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), text.alias("text"), let(text, secret_spans).alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with the values of all spans replaced; overlapping values give one mark."""
    return let(spans, lambda s: _redacted(text, s, mark))


def _redacted(text: Column, spans: Column, mark: str) -> Column:
    def add(a: Column, s: Column) -> Column:
        gap = F.substring(text, a["pos"] + 1, s["secret"] - a["pos"])
        out = F.when(s["secret"] >= a["pos"], F.concat(a["out"], gap, F.lit(mark))).otherwise(a["out"])
        return F.struct(F.greatest(a["pos"], s["end"]).alias("pos"), out.alias("out"))

    by_secret = F.array_sort(
        spans,
        lambda x, y: F.when(x["secret"] < y["secret"], -1)
        .when(x["secret"] > y["secret"], 1)
        .otherwise(y["end"] - x["end"]),
    )
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    done = F.aggregate(
        by_secret,
        start,
        add,
        lambda a: F.concat(a["out"], F.substring(text, a["pos"] + 1, F.char_length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact_secrets(docs: DataFrame, text_col: str, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns, with the secrets of the text replaced; null texts stay null."""
    found = F.transform(F.array(F.coalesce(F.col(text_col), F.lit(""))), lambda t: redact(t, secret_spans(t), mark))
    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.element_at(found, 1)))


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


_PATTERN_SQL = [(k, p, n, 1) for k, p, n in BASE] + [(c.kind, c.pattern, 0, 0) for c in CLASSES]


def _sql_matches(rank: int, kind: str, pattern: str, group: int) -> str:
    return rf"""m{rank} AS (
  SELECT r, {rank} AS rank, i, whole, secret, piece,
    sum(length(piece) + length(whole)) OVER (PARTITION BY r ORDER BY i) - length(whole) AS start
  FROM (SELECT r, unnest(range(len(w))) AS i, unnest(w) AS whole, unnest(s) AS secret,
      unnest(list_resize(p, len(w))) AS piece
    FROM (SELECT r, regexp_extract_all(text, '{pattern}', 0) AS w,
        regexp_extract_all(text, '{pattern}', {group}) AS s, string_split_regex(text, '{pattern}') AS p
      FROM d WHERE regexp_matches(text, '{pattern}')))
)"""


def _sql_dense(rank: int, c: CharClass) -> str:
    needs = "".join(f" AND regexp_matches(whole, '{n}')" for n in c.needs)
    return rf"""c{rank} AS (
  SELECT r, i, whole, start FROM m{rank}
  WHERE NOT regexp_matches(whole, '{c.unlike}') AND NOT regexp_matches(lower(whole), '{ALLOWED}')
    AND NOT regexp_matches(lower(right(piece, {BEFORE})), '{ALLOWED_BEFORE}'){needs}
), x{rank} AS (
  SELECT r, {rank} AS rank, start + min(w) AS start, start + max(w) + {WINDOW} AS stop FROM (
    SELECT r, i, start, w, sum(CAST(round(1e6 * n * log2(n)) AS BIGINT)) AS total FROM (
      SELECT r, i, start, w, ch, count(*) AS n FROM (
        SELECT r, i, start, w, substr(whole, w + o + 1, 1) AS ch FROM (
          SELECT r, i, whole, start, unnest(range(length(whole) - {WINDOW - 1})) AS w FROM c{rank}
        ), range({WINDOW}) AS t(o)
      ) GROUP BY ALL
    ) GROUP BY ALL
  ) WHERE total <= {_most(c.bits)} GROUP BY r, i, start
)"""


_SQL_BASE = " UNION ALL ".join(
    f"SELECT r, {k} AS rank, start, start + length(whole) AS stop FROM m{k} WHERE length(secret) >= {BASE[k][2]}"
    for k in range(len(BASE))
)
_SQL_MORE = " UNION ALL ".join(f"SELECT * FROM x{k}" for k in range(len(BASE), len(KINDS)))
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), {", ".join(_sql_matches(k, kind, p, g) for k, (kind, p, _, g) in enumerate(_PATTERN_SQL))},
{", ".join(_sql_dense(k, c) for k, c in enumerate(CLASSES, len(BASE)))},
base AS ({_SQL_BASE}),
more AS (
  SELECT * FROM ({_SQL_MORE}) AS m WHERE NOT EXISTS (
    SELECT 1 FROM base AS b WHERE b.r = m.r AND b.start <= m.start AND b.stop >= m.stop)
), spans AS (
  SELECT r, string_agg({list(KINDS)}[rank + 1] || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM (SELECT * FROM base UNION ALL SELECT * FROM more) GROUP BY r
), n AS (
  SELECT r, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
    count(*) FILTER (rank = 2) AS n_hex,
    string_agg({list(KINDS)}[rank + 1] || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS joined
  FROM base GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(joined, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN n USING (r) LEFT JOIN spans USING (r)
"""


@query("op2_secret_scan", SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the fixed patterns, and all spans."""
    found = find_secrets(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))

    def count(rank: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")

    counts = [count(rank).alias(f"n_{kind}") for rank, (kind, _, _) in enumerate(BASE)]
    return found.select(
        "doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )
