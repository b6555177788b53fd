"""Phrase collocations: frequent n-grams by mergeable Misra-Gries summaries, then exact counts.

1. Words are counted exactly. An n-gram with a rare word is itself rare, so n-grams count only
   where every word is frequent; a bitmap of fixed size tells tasks which words are.
2. N-grams are dealt by hash into partitions. Every task adds its n-grams up to summaries, one
   per partition, and the summaries of a partition are merged. A summary has room for more
   counters than its partition's mass divided by the threshold, so what it subtracts stays below
   the threshold and every frequent n-gram survives.
3. A second pass over the texts counts exactly the n-grams whose hash survived; a bitmap of fixed
   size holds these. Hashes only choose what is counted: where two meet, more is counted.
4. Scores, cuts and absorption are joins of the exact counts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metaquarry.llm.common import query, stored, table
from metaquarry.llm.shingles import mix
from metaquarry.session import ship_package

U = np.uint64
MIN_COUNT = 30
MAX_WORDS = 4
TOP = 2_000
#: A candidate is absorbed by a longer one that occurs this often, in hundredths of its own count.
ABSORB = 80
#: Bits of the bitmaps of words and of n-grams (2 MB and 16 MB), whatever the corpus. Fuller
#: bitmaps let more through to the exact counts and never less.
WORD_BITS, GRAM_BITS = 24, 27
#: Texts are read in pieces of about this many bytes.
CHUNK_BYTES = 3 << 20
#: Counters that a task holds before it hands them on.
HELD = 1_500_000
#: Phrases that a task counts before it hands them on.
HELD_PHRASES = 1_000_000
#: Counters in a row of a summary.
ROW_COUNTERS = 16_384
#: Hash partitions: at least so many, and one for so much mass.
MIN_PARTS, PART_MASS = 256, 1 << 25

#: Text pieces end at these characters, words at blanks. Fixed values of the contract.
ENDS = ".,;:!?\n\x0b\x0c\r"
_END = b"\xff"  # in no UTF-8 text
_SIGNS = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + ENDS.encode(), b"abcdefghijklmnopqrstuvwxyz " + _END * len(ENDS)
)


def _words(raw: bytes) -> list[bytes]:
    return raw.replace(_END, b" \xff ").split()


def _long(raw: bytes, size: int, carry: int) -> Iterator[tuple[list[bytes], int]]:
    """A long text in pieces; each starts with the last words of the one before."""
    at, before = 0, []
    while at < len(raw):
        end = raw.rfind(b" ", at, at + size)
        end = end if end > at else raw.find(b" ", at + size)
        end = len(raw) if end < 0 or at + size >= len(raw) else end
        words = before + _words(raw[at:end])
        yield words, len(before)
        before, at = words[-carry:], end


def chunks(
    batches: Iterator[pd.DataFrame], size: int = CHUNK_BYTES, carry: int = MAX_WORDS - 1
) -> Iterator[tuple[str, list[bytes], int]]:
    """(lang, words, new): words of about ``size`` bytes of texts, ends of pieces among them.

    The words before ``new`` belong to the chunk before and only complete what starts there.
    """
    for pdf in batches:
        for lang, texts in pdf.groupby("lang", sort=False)["text"]:
            held, room = [], size
            for text in texts:
                if text is None:
                    continue
                if len(text) > room and held:
                    yield lang, _words(_END.join(held)), 0
                    held, room = [], size
                if len(text) > size:
                    yield from ((lang, *piece) for piece in _long(text.translate(_SIGNS), size, carry))
                else:
                    held.append(text.translate(_SIGNS))
                    room -= len(text)
            if held:
                yield lang, _words(_END.join(held)), 0


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()

    def rows() -> pd.DataFrame:
        del_end = [(lang, w, n) for (lang, w), n in counts.items() if w != _END]
        return pd.DataFrame(del_end, columns=["lang", "word", "n"])

    for lang, words, new in chunks(batches):
        for word, n in Counter(words[new:]).items():
            counts[lang, word] += n
        if len(counts) > HELD // 10:
            yield rows()
            counts.clear()
    yield rows()


class _Grams:
    """The n-grams of a chunk: word numbers, and per size the places and hashes."""

    def __init__(self, lang: str, words: list[bytes], new: int, frequent: np.ndarray, parts: int):
        self.distinct = list(dict.fromkeys(words))
        number = dict(zip(self.distinct, range(len(self.distinct)), strict=True))
        self.ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        self.new, self.parts = new, parts
        start = lang.encode() + b"\0"
        hashes = np.array([xxhash.xxh64_intdigest(start + w, 42) for w in self.distinct], U)
        usable = bits_at(frequent, hashes & U(8 * len(frequent) - 1))
        if _END in number:
            usable[number[_END]] = False
        self.hash, self.usable = hashes[self.ids], usable[self.ids]

    def sizes(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, first places, hash partition and 32 bits of the hash)."""
        places = np.flatnonzero(self.usable)
        total = mix(self.hash[places], 1)
        for size in range(2, longest + 1):
            ok = places + size <= len(self.ids)
            ok[ok] = self.usable[places[ok] + size - 1]
            places, total = places[ok], total[ok]
            total = mix(total ^ self.hash[places + size - 1], size)
            full = places + size > self.new  # ends in the new words
            hashes = total[full]
            yield size, places[full], ((hashes >> U(32)) % U(self.parts)) << U(32) | (hashes & U(0xFFFFFFFF))


def bits_at(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> U(3)] >> (at & U(7)).astype(np.uint8)) & 1 == 1


def gram_bits_of(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The two bits of each n-gram."""
    return [mix(keys, salt) >> U(64 - bits) for salt in (11, 12)]


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first, dtype=counts.dtype) if len(first) else counts


class Summary:
    """Misra-Gries counters: a key's count is short by ``error`` at most.

    ``error`` is below mass / capacity, for whatever order summaries are merged in.
    """

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.zeros(0, U), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, error: int = 0) -> None:
        self.keys, self.counts = add_up(np.concatenate((self.keys, keys)), np.concatenate((self.counts, counts)))
        self.error += error
        over = len(self.keys) - self.capacity
        if over > 0:  # subtract the largest count that does not fit
            cut = np.partition(self.counts, over - 1)[over - 1]
            left = self.counts > cut
            self.keys, self.counts = self.keys[left], self.counts[left] - cut
            self.error += int(cut)

    def survivors(self, threshold: int) -> np.ndarray:
        return self.keys[self.counts + self.error >= threshold]


_SUMMARY = "part int, kind int, mass long, keys binary, counts binary"


def _summaries(words, parts: int, longest: int):
    """A task's counters, by hash partition: rows of mass first, then of counters."""

    def hand_on(keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        rows = []
        part = (keys >> U(32)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
            p, low, n = int(part[a]), keys[a:b].astype(np.uint32), counts[a:b].astype(np.int32)
            rows.append((p, 0, int(n.sum()), None, None))
            one, many = low[n == 1], low[n > 1]
            rows += [(p, 1, 0, one[i : i + ROW_COUNTERS].tobytes(), None) for i in range(0, len(one), ROW_COUNTERS)]
            n = n[n > 1]
            for i in range(0, len(many), ROW_COUNTERS):
                rows.append((p, 1, 0, many[i : i + ROW_COUNTERS].tobytes(), n[i : i + ROW_COUNTERS].tobytes()))
        return pd.DataFrame(rows, columns=["part", "kind", "mass", "keys", "counts"])

    def summarize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent = np.frombuffer(words.value, np.uint8)
        keys, counts, waiting, size = np.zeros(0, U), np.zeros(0, np.int32), [], 0
        for lang, tokens, new in chunks(batches):
            for _, _, found in _Grams(lang, tokens, new, frequent, parts).sizes(longest):
                waiting.append(add_up(found, np.ones(len(found), np.int32)))
                size += len(waiting[-1][0])
            if size > HELD:
                keys, counts = add_up(*map(np.concatenate, zip((keys, counts), *waiting, strict=True)))
                waiting, size = [], 0
                if len(keys) > HELD:
                    yield hand_on(keys, counts)
                    keys, counts = keys[:0], counts[:0]
        keys, counts = add_up(*map(np.concatenate, zip((keys, counts), *waiting, strict=True)))
        if len(keys):
            yield hand_on(keys, counts)

    return summarize


def _survivors(threshold: int, bits: int):
    """Bits of the n-grams that survive; rows come by hash partition, those of mass first."""

    def survive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, mass, summary, waiting, size = None, 0, None, [], 0

        def merge():
            nonlocal waiting, size, summary
            if summary is None:
                summary = Summary(mass // threshold + 1)
            if waiting:
                summary.merge(*map(np.concatenate, zip(*waiting, strict=True)))
            waiting, size = [], 0

        def result() -> pd.DataFrame:
            merge()
            keys = summary.survivors(threshold) | U(part) << U(32)
            return pd.DataFrame({"bit": np.concatenate(gram_bits_of(keys, bits)).astype(np.int64)})

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.part != part:
                    if part is not None:
                        yield result()
                    part, mass, summary = row.part, 0, None
                if row.kind == 0:
                    mass += row.mass
                    continue
                keys = np.frombuffer(row.keys, np.uint32).astype(U)
                counts = np.ones(len(keys), np.int64) if row.counts is None else np.frombuffer(row.counts, np.int32)
                waiting.append((keys, counts))
                size += len(keys)
                if size > HELD // 4:
                    merge()
        if part is not None:
            yield result()

    return survive


_PHRASES = "part int, lang string, phrases binary, counts binary"


def _packed(lang: str, counts: dict[bytes, int], parts: int) -> pd.DataFrame:
    """Phrases and counts in one row for each hash partition; no phrase has a line break."""
    start, phrases = lang.encode() + b"\0", np.array(list(counts), object)
    n = np.fromiter(counts.values(), np.int64, len(counts))
    part = np.fromiter((xxhash.xxh32_intdigest(start + p) % parts for p in counts), np.int64, len(counts))
    order = np.argsort(part, kind="stable")
    phrases, n, part = phrases[order], n[order], part[order]
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    pieces = list(zip(first, [*first[1:], len(part)], strict=True))
    return pd.DataFrame(
        {
            "part": part[first].astype(np.int32),
            "lang": lang,
            "phrases": [b"\n".join(phrases[a:b]) for a, b in pieces],
            "counts": [n[a:b].tobytes() for a, b in pieces],
        }
    )


def _count_grams(words, grams, parts: int, longest: int):
    """Exact counts of the n-grams whose bits are set, added up per task."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent, wanted = np.frombuffer(words.value, np.uint8), np.frombuffer(grams.value, np.uint8)
        bits = (8 * len(wanted)).bit_length() - 1
        counts: defaultdict[str, dict[bytes, int]] = defaultdict(dict)
        for lang, tokens, new in chunks(batches):
            chunk, own = _Grams(lang, tokens, new, frequent, parts), counts[lang]
            for size, places, keys in chunk.sizes(longest):
                first, second = gram_bits_of(keys, bits)
                places = places[bits_at(wanted, first) & bits_at(wanted, second)]
                same = chunk.ids[places]
                for i in range(1, size):  # equal numbers for equal words, one word after the other
                    same = np.unique(same << 32 | chunk.ids[places + i], return_inverse=True)[1]
                _, first, n = np.unique(same, return_index=True, return_counts=True)
                columns = [chunk.ids[places[first] + i].tolist() for i in range(size)]
                for ids, m in zip(zip(*columns, strict=True), n.tolist(), strict=True):
                    phrase = b" ".join([chunk.distinct[j] for j in ids])
                    own[phrase] = own.get(phrase, 0) + m
            if sum(map(len, counts.values())) > HELD_PHRASES:
                yield from (_packed(x, c, parts) for x, c in counts.items() if c)
                counts.clear()
        yield from (_packed(x, c, parts) for x, c in counts.items() if c)

    return count


def _add_phrases(threshold: int):
    """Frequent phrases of each partition; rows come by partition and language."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, counts = None, {}

        def rows() -> pd.DataFrame:
            held = [(p, n) for p, n in counts.items() if n >= threshold]
            return pd.DataFrame({"lang": key and key[1], "phrase": [p for p, _ in held], "a": [n for _, n in held]})

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if key != (row.part, row.lang):
                    if counts:
                        yield rows()
                    key, counts = (row.part, row.lang), {}
                for phrase, n in zip(row.phrases.split(b"\n"), np.frombuffer(row.counts, np.int64).tolist(), strict=True):
                    counts[phrase] = counts.get(phrase, 0) + n
        if counts:
            yield rows()

    return add


def bitmap(rows: DataFrame, bit: Column, bits: int) -> bytes:
    """A bitmap of 2**bits bits, those of ``rows`` set; at most 4 KB for each 32,768 bits."""
    at = bit.cast("long") + 1
    cells = rows.groupBy(F.bitmap_bucket_number(at).alias("cell")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")
    )
    out = bytearray(1 << (bits - 3))
    for cell, held in cells.collect():
        out[(cell - 1) << 12 : cell << 12] = held
    return bytes(out)


def _decimal(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def _scored(grams: DataFrame, words: DataFrame) -> DataFrame:
    """Each candidate with its weakest cut: (lang, size, phrase, a, l, r, score)."""
    parts = grams.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    parts = parts.unionByName(words.select("lang", F.col("word").alias("part"), F.col("n").alias("f")))
    w = F.split("phrase", " ")

    def cut(k: Column) -> Column:
        left, right = F.slice(w, F.lit(1), k), F.slice(w, k + 1, F.size(w))
        return F.array(
            F.struct(k.alias("k"), F.lit(True).alias("is_left"), F.array_join(left, " ").alias("part")),
            F.struct(k.alias("k"), F.lit(False).alias("is_left"), F.array_join(right, " ").alias("part")),
        )

    sides = F.flatten(F.transform(F.sequence(F.lit(1), F.col("size") - 1), cut))
    cuts = grams.select("lang", "size", "phrase", "a", F.explode(sides).alias("cut"))
    cuts = cuts.select("lang", "size", "phrase", "a", "cut.*").join(parts, ["lang", "part"])
    both = cuts.groupBy("lang", "size", "phrase", "a", "k").agg(
        F.max(F.expr("if(is_left, f, null)")).alias("l"), F.max(F.expr("if(is_left, null, f)")).alias("r")
    )
    wide = both.withColumn("num", F.lit(2_000_000).cast("decimal(8,0)") * _decimal(F.col("a")))
    wide = wide.withColumn("den", _decimal(F.col("l")) + _decimal(F.col("r")))
    least = F.min(F.struct(F.expr("num div den").alias("score"), "k", "l", "r")).alias("least")
    return wide.groupBy("lang", "size", "phrase", "a").agg(least).select("lang", "size", "phrase", "a", "least.*")


def _absorbed(grams: DataFrame, absorb: int, longest: int) -> DataFrame:
    """Candidates inside a longer one that takes up most of their occurrences."""
    w = F.split("phrase", " ")
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("size") - 1),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice(w, i, n), " ")
            ),
        )
    )
    longer = grams.filter((F.col("size") > 2) & (F.col("size") <= longest))
    most = longer.select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    most = most.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    enough = _decimal(F.col("longer")) * 100 >= _decimal(F.col("a")) * absorb
    return grams.join(most, ["lang", "phrase"]).filter(enough).select("lang", "phrase")


def collocations(
    docs: DataFrame,
    text_col: str,
    group_col: str,
    min_count: int = MIN_COUNT,
    longest: int = MAX_WORDS,
    top: int | None = TOP,
    absorb: int = ABSORB,
) -> DataFrame:
    """Phrases of 2 to ``longest`` words per group: (lang, rank, phrase, a, l, r, n, score).

    Whole texts count; A-Z are lower-cased. Null and empty texts have no words, a null group
    is ``und``. Every row counts, repeated rows too. Equal scores go by count, then phrase, so
    ranks are unique. ``top=None`` returns all. Texts of any length are read in pieces that
    share their edge words. Other columns are ignored, whatever their names; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    sc = spark.sparkContext
    docs = docs.select(
        F.coalesce(F.col(group_col).cast("string"), F.lit("und")).alias("lang"),
        F.col(text_col).cast("binary").alias("text"),
    )
    counted = docs.mapInPandas(_count_words, "lang string, word binary, n long")
    counted = counted.groupBy("lang", F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n"))
    words = stored(counted, "words")
    mass = (words.agg(F.sum("n")).first()[0] or 0) * (longest - 1)
    frequent = words.filter(F.col("n") >= min_count)
    text_hash = F.xxhash64(F.concat("lang", F.lit("\0"), "word"))
    word_bits = sc.broadcast(bitmap(frequent, F.pmod(text_hash, F.lit(1 << WORD_BITS)), WORD_BITS))
    parts = max(MIN_PARTS, -(-mass // PART_MASS))
    rows = docs.mapInPandas(_summaries(word_bits, parts, longest), _SUMMARY)
    rows = rows.repartition("part").sortWithinPartitions("part", "kind")
    bits = rows.mapInPandas(_survivors(min_count, GRAM_BITS), "bit long")
    gram_bits = sc.broadcast(bitmap(bits, F.col("bit"), GRAM_BITS))
    counted = docs.mapInPandas(_count_grams(word_bits, gram_bits, parts, longest), _PHRASES)
    counted = counted.repartition("part").sortWithinPartitions("part", "lang")
    exact = counted.mapInPandas(_add_phrases(min_count), "lang string, phrase binary, a long")
    exact = exact.withColumn("phrase", F.col("phrase").cast("string")).withColumn("size", F.size(F.split("phrase", " ")))
    grams = stored(exact, "grams")
    found = _scored(grams, frequent).join(_absorbed(grams, absorb, longest), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    found = found.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        found = found.filter(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = rf"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS words
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
runs AS (
  SELECT lang, w AS w1, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3, lead(w, 3) OVER p AS w4
  FROM (SELECT lang, piece, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM pieces)
  WINDOW p AS (PARTITION BY piece ORDER BY i)),
f AS (
  SELECT lang, size, phrase, count(*) AS f
  FROM (SELECT lang, 1 AS size, w1 AS phrase FROM runs
        UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM runs
        UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM runs
        UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM runs)
  WHERE phrase IS NOT NULL GROUP BY ALL),
grams AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= {MIN_COUNT}),
cuts AS (
  SELECT g.lang, g.size, g.phrase, g.a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * g.a) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM grams) g
  JOIN f x ON x.lang = g.lang AND x.size = k AND x.phrase = array_to_string(g.w[1:k], ' ')
  JOIN f y ON y.lang = g.lang AND y.size = g.size - k AND y.phrase = array_to_string(g.w[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
absorbed AS (
  SELECT DISTINCT s.lang, s.phrase FROM grams s JOIN (
    SELECT lang, a, array_to_string(w[i:i + n - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, size - n + 2)) AS i
          FROM (SELECT *, unnest(range(2, size)) AS n FROM grams WHERE size > 2))) t USING (lang, phrase)
  WHERE 100::HUGEINT * t.a >= {ABSORB} * s.a),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
         score::BIGINT AS score
  FROM best ANTI JOIN absorbed USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score
FROM ranked JOIN (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang) USING (lang)
WHERE rank <= {TOP}
"""


@query("op11_phrase_mining", SQL)
def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), "text", "lang")
