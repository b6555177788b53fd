"""URL filter: path rules, and a Bloom filter cascade that answers the rest exactly.

A Bloom filter of the listed keys has false positives. The corpus holds all keys that will
ever be asked, so they are known: the second filter encodes them, the third encodes the
listed keys that the second one takes by mistake, and so on, until a level makes no mistake
on the corpus. A key's answer is the parity of the first level that does not hold it.
The judging pass is one projection over the urls: the filters are literals in it.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaquarry.llm.common import lower_ascii, query, stored, table

#: (host, path, verdict); a rule holds for its host and all subdomains. Fixed values.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Host labels that put a host on the list of the registered query.
LISTED_LABELS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")

#: A level larger than this is not shipped as a literal (1 MB of bits); ``judge_urls`` then
#: looks the listed keys up with a shuffled join instead, with the same verdicts.
MAX_LEVEL_BITS = 1 << 23
FIRST_RATE, NEXT_RATE = 0.02, 0.5


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty where it is null or has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return (
        lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    )


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null where none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(
            fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        ).otherwise(found)
    return found


@dataclass
class Level:
    bits: int
    hashes: int
    seed: int
    words: list[int]

    def positions(self, key: Column) -> Column:
        """Bit positions of a key, by double hashing."""
        return F.array(*self._each(key))

    def _each(self, key: Column) -> list[Column]:
        first = F.xxhash64(F.lit(2 * self.seed), key)
        step = F.xxhash64(F.lit(2 * self.seed + 1), key)
        return [F.pmod(F.shiftright(first, 8) + i * F.shiftright(step, 8), F.lit(self.bits)) for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        words = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")
        test = F.lit(True)
        for at in self._each(key):
            word = F.get(words, F.shiftright(at, 6).cast("int"))
            test = test & (F.call_function("getbit", word, at.bitwiseAND(63).cast("int")) == 1)
        return test


def _shape(n: int, rate: float) -> tuple[int, int]:
    hashes = max(1, round(-math.log2(rate)))
    return max(64, 64 * math.ceil(n * hashes / math.log(2) / 64)), hashes


def _fill(keys: DataFrame, level: Level) -> Level:
    """Set the bits of ``keys``; at most ``level.bits / 64`` rows reach the driver."""
    at = keys.select(F.explode(level.positions(F.col("key"))).alias("at"))
    rows = (
        at.groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("set"))
        .collect()
    )
    level.words = [0] * (level.bits // 64)
    for row in rows:
        level.words[row["word"]] = row["set"]
    return level


class BloomCascade:
    """Exact membership over a known universe of keys.

    ``universe`` has the columns key (distinct, not null) and listed (boolean).
    """

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def build(cls, universe: DataFrame, max_bits: int = MAX_LEVEL_BITS) -> BloomCascade | None:
        """None where a level would exceed ``max_bits``."""
        levels: list[Level] = []
        # what the next level encodes, and what it could take by mistake
        inside, outside = universe.filter("listed"), universe.filter("not listed")
        while n := inside.count():
            bits, hashes = _shape(n, NEXT_RATE if levels else FIRST_RATE)
            if bits > max_bits:
                return None
            level = _fill(inside, Level(bits, hashes, len(levels), []))
            levels.append(level)
            inside, outside = outside.filter(level.holds(F.col("key"))), inside
        return cls(levels)

    def holds(self, key: Column) -> Column:
        """Is a key of the universe listed? Not meant for keys outside of it."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            answer = F.when(level.holds(key), answer).otherwise(i % 2 == 1)
        return answer


def judge_urls(
    pages: DataFrame, id_col: str, url_col: str, listed, rules=RULES, max_bits: int = MAX_LEVEL_BITS
) -> DataFrame:
    """Host, path, rule and verdict of every url.

    ``listed(host)`` gives the Column that says whether a host is on the list; it is asked
    once per distinct host. A rule's verdict comes first, then ``block`` for listed hosts.
    Null urls and urls without ``://`` have an empty host and path and no rule; the empty
    host is asked like any other. Repeated rows are judged alike; other columns are ignored.
    """
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    keys = parts.groupBy(F.col("host").alias("key")).agg(F.lit(1).alias("one"))
    universe = stored(
        keys.select("key", F.coalesce(listed(F.col("key")), F.lit(False)).alias("listed")), "hosts"
    )
    cascade = BloomCascade.build(universe, max_bits)
    if cascade is None:
        hosts = universe.filter("listed").select(F.col("key").alias("host"), F.lit(True).alias("hit"))
        parts = parts.join(hosts, "host", "left")
        hit = F.coalesce(F.col("hit"), F.lit(False))
    else:
        hit = cascade.holds(F.col("host"))
    return parts.select(id_col, "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("by"), hit.alias("listed")).select(
        id_col,
        "host",
        "path",
        F.col("by.rule").alias("rule"),
        F.coalesce("by.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "listed",
    )


def listed_label(host: Column) -> Column:
    return F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, LISTED_LABELS)))


_FITS = [
    f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in RULES
]
_BY_LENGTH = sorted(range(len(RULES)), key=lambda i: -len(RULES[i][0] + RULES[i][1]))
SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), judged AS (
  SELECT *, list_has_any(string_split(host, '.'), {list(LISTED_LABELS)}) AS listed,
    CASE {' '.join(f"WHEN {_FITS[i]} THEN '{RULES[i][0]}{RULES[i][1]}'" for i in _BY_LENGTH)} END AS rule,
    CASE {' '.join(f"WHEN {_FITS[i]} THEN '{RULES[i][2]}'" for i in _BY_LENGTH)} END AS by_rule
  FROM parts
)
SELECT page_id, host, path, rule,
  coalesce(by_rule, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM judged
"""


@query("op8_url_cascade", SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url: host, path, rule, verdict, and whether the host is listed."""
    return judge_urls(table(spark, sf_dir, "pages"), "page_id", "url", listed_label)
