"""Language of texts by a linear-chain conditional random field over words.

A word's emission score is a sum of learned weights of its affixes, its character n-grams and
the word itself (the lexicon); learned transitions say how languages follow each other. Forward
and backward passes give each word's language in code-switched text; a text's language is
the one with the largest mean over its words. Training texts are in one language each, so
training sequences also join stretches of several languages.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metaquarry.llm.common import query, table
from metaquarry.llm.shingles import U, mix
from metaquarry.session import ship_package

UNKNOWN = "und"
#: The model is fitted on at most this many labelled texts in all, the same number for each
#: language, and on a stretch of at most this many characters of each.
SAMPLE_TEXTS, SAMPLE_CHARS = 1_200, 2_000
#: The most frequent labels are learned, if there are more than this.
MAX_LANGUAGES = 256
#: Weights are kept for this many hashed features.
FEATURE_BITS = 18
SEQUENCE, BATCH, EPOCHS, RATE, DECAY = 40, 128, 2, 0.5, 1e-5
#: Words of a chunk in prediction, texts of a batch, words whose scores a task keeps.
CHUNK, TEXTS, CACHE_WORDS = 32, 512, 300_000


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, first feature of each word) of lower-case words."""
    codes = np.frombuffer(("\x01" + "\x01".join(words) + "\x01").encode("utf-32-le", "surrogatepass"), "<u4").astype(U)
    ends = np.flatnonzero(codes == 1)
    first, last = ends[:-1], ends[1:]  # the marks around each word
    size = last - first - 1
    padded = np.concatenate((codes, np.ones(4, U)))
    rolled = [padded[i : i + len(codes)] for i in range(5)]

    def hashed(kind: int, length: int) -> np.ndarray:
        h = np.full(len(codes), kind, U)
        for i in range(length):
            h = mix(h ^ rolled[i], kind)
        return h

    found, owner = [], []
    number = np.arange(len(words))
    # n-grams, marks included: those at a mark are affixes
    for length in (2, 3, 4):
        count = np.maximum(size + 3 - length, 0)
        who = np.repeat(number, count)
        step = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        found.append(hashed(length, length)[np.repeat(first, count) + step])
        owner.append(who)
    # first and last letter, and the word
    found += [hashed(10, 1)[first + 1], hashed(11, 1)[last - 1]]
    powers = np.cumprod(np.full(len(codes), 0x9E3779B97F4A7C15, U))
    inverse = np.cumprod(np.full(len(codes), pow(0x9E3779B97F4A7C15, -1, 2**64), U))
    sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(codes, 12) * powers)))
    found.append(mix((sums[last] - sums[first + 1]) * inverse[first], 12))
    owner += [number] * 3
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    features = (found[order] >> U(64 - FEATURE_BITS)).astype(np.int64)
    return features, np.searchsorted(owner[order], number)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features x languages
    moves: np.ndarray  # language before x language after

    def emissions(self, words: list[str]) -> np.ndarray:
        features, starts = word_features(words)
        return np.add.reduceat(self.weights[features], starts, axis=0)


def _forward_backward(e: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (batch, time, language) and expected moves of sequences of equal length."""
    b, t, n = e.shape
    emit = np.exp(e - e.max(2, keepdims=True))
    a = np.exp(moves)
    ahead = np.empty((t + 1, b, n))
    ahead[0] = 1.0 / n
    for i in range(t):
        step = (ahead[i] @ a) * emit[:, i]
        ahead[i + 1] = step / step.sum(1, keepdims=True)
    behind = np.ones((b, n))
    marginals, expected = np.empty((b, t, n)), np.zeros((n, n))
    for i in range(t - 1, -1, -1):
        m = ahead[i + 1] * behind
        marginals[:, i] = m / m.sum(1, keepdims=True)
        back = emit[:, i] * behind
        pair = ahead[i][:, :, None] * a[None] * back[:, None, :]
        expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        behind = back @ a.T
        behind /= behind.sum(1, keepdims=True)
    return marginals, expected


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Fit by gradient steps on the log-likelihood, with a step size per weight."""
    languages = sorted(set(labels))
    n = len(languages)
    model = Model(languages, np.zeros((1 << FEATURE_BITS, n), np.float32), np.zeros((n, n)))
    rng = random.Random(seed)
    by: dict[int, list[list[str]]] = {k: [] for k in range(n)}
    for text, label in zip(texts, labels, strict=True):
        words = letter_words(text)
        by[languages.index(label)] += [words[i : i + SEQUENCE] for i in range(0, len(words), SEQUENCE)]
    by = {k: v for k, v in by.items() if v}
    if not by:
        return model
    most = max(map(len, by.values()))
    sequences: list[list[tuple[str, int]]] = []
    for k, stretches in by.items():  # all languages alike
        for i in range(most):
            sequences.append([(w, k) for w in stretches[i % len(stretches)]])
    mixed = []
    for _ in range(len(sequences) // 2):
        own: list[tuple[str, int]] = []
        while len(own) < SEQUENCE:
            k = rng.choice(list(by))
            some = rng.choice(by[k])
            own += [(w, k) for w in some[: rng.randint(3, SEQUENCE // 2)]]
        mixed.append(own[:SEQUENCE])
    sequences = [s for s in sequences if len(s) == SEQUENCE] + [
        (s * SEQUENCE)[:SEQUENCE] for s in sequences if len(s) < SEQUENCE
    ] + mixed
    squares, move_squares = np.full(model.weights.shape, 1e-2, np.float32), np.full((n, n), 1e-2)
    for _ in range(EPOCHS):
        rng.shuffle(sequences)
        for i in range(0, len(sequences), BATCH):
            batch = sequences[i : i + BATCH]
            words = [w for s in batch for w, _ in s]
            gold = np.array([k for s in batch for _, k in s]).reshape(len(batch), SEQUENCE)
            features, starts = word_features(words)
            e = np.add.reduceat(model.weights[features], starts, axis=0).reshape(len(batch), SEQUENCE, n)
            marginals, expected = _forward_backward(e.astype(float), model.moves)
            error = (np.eye(n)[gold] - marginals).reshape(-1, n)
            counts = np.diff(np.append(starts, len(features)))
            who = np.repeat(np.arange(len(words)), counts)
            used, slot = np.unique(features, return_inverse=True)
            step = np.stack([np.bincount(slot, error[who, k], len(used)) for k in range(n)], 1) / len(batch)
            step -= DECAY * model.weights[used]
            squares[used] += step**2
            model.weights[used] += (RATE * step / np.sqrt(squares[used])).astype(np.float32)
            seen = np.zeros((n, n))
            np.add.at(seen, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
            seen += np.bincount(gold[:, 0], minlength=n)[None] / n  # the even start
            move = (seen - expected) / len(batch) - DECAY * model.moves
            move_squares += move**2
            model.moves += RATE * move / np.sqrt(move_squares)
    return model


def letter_words(text: str | None) -> list[str]:
    """Lower-case words that hold a letter."""
    if not text:
        return []
    return [w for w in text.lower().replace("\x01", " ").split() if w.isalpha() or any(map(str.isalpha, w))]


def posteriors(e: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Marginals of all words of texts of ``sizes`` words, one after the other in ``e``.

    Exact, and with few numpy steps for texts of any length: texts are cut into chunks, the
    chunks' transfer matrices give the messages at their borders, and all chunks then run
    forward and backward side by side.
    """
    n = e.shape[1]
    emit = np.exp(e - e.max(1, keepdims=True))
    a = np.exp(moves - moves.max())
    per = -(-sizes // CHUNK)
    text = np.repeat(np.arange(len(sizes)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    begin = np.repeat(np.cumsum(sizes) - sizes, per) + nth * CHUNK
    length = np.minimum(CHUNK, np.repeat(sizes, per) - nth * CHUNK)
    order = np.argsort(-length, kind="stable")  # chunks still running are the first ones
    begin, length = begin[order], length[order]
    running = [int(np.searchsorted(-length, -i, "left")) for i in range(CHUNK)]  # longer than i
    whole = np.broadcast_to(np.eye(n), (len(begin), n, n)).copy()
    for i in range(CHUNK):
        k = running[i]
        if not k:
            break
        step = (whole[:k] @ a) * emit[begin[:k] + i][:, None, :]
        whole[:k] = step / step.sum((1, 2), keepdims=True)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ahead, behind = np.full((len(begin), n), 1.0 / n), np.ones((len(begin), n))
    for i in range(1, int(per.max(initial=0))):
        now = place[np.flatnonzero(nth == i)]
        last = place[np.flatnonzero(nth == i) - 1]
        step = (ahead[last][:, None, :] @ whole[last])[:, 0]
        ahead[now] = step / step.sum(1, keepdims=True)
    for i in range(int(per.max(initial=0)) - 1, 0, -1):
        now = place[np.flatnonzero(nth == i)]
        last = place[np.flatnonzero(nth == i) - 1]
        step = (whole[now] @ behind[now][:, :, None])[:, :, 0]
        behind[last] = step / step.sum(1, keepdims=True)
    out = np.empty((len(e), n))
    for i in range(CHUNK):
        k = running[i]
        step = (ahead[:k] @ a) * emit[begin[:k] + i]
        ahead[:k] = step / step.sum(1, keepdims=True)
        out[begin[:k] + i] = ahead[:k]
    for i in range(CHUNK - 1, -1, -1):
        k = running[i]
        at = begin[:k] + i
        out[at] *= behind[:k]
        step = (emit[at] * behind[:k]) @ a.T
        behind[:k] = step / step.sum(1, keepdims=True)
    return out / out.sum(1, keepdims=True)


class Labeller:
    """Applies a model to batches of texts, keeping the scores of words it has met."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.scores = np.zeros((0, len(model.languages)), np.float32)

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(marginals of all words, words of each text)."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.scores = {}, self.scores[:0]
        known, had = self.known, len(self.known)
        at, sizes = [], []
        for t in texts:
            own = letter_words(t)
            sizes.append(len(own))
            at += [known.setdefault(w, len(known)) for w in own]
        if len(known) > had:
            new = list(known)[had:]
            self.scores = np.concatenate((self.scores, self.model.emissions(new)))
        e = self.scores[np.array(at, np.int64)].astype(float)
        return posteriors(e, np.array(sizes, np.int64), self.model.moves), np.array(sizes, np.int64)

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.model.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        marginals, sizes = self.words(texts)
        out, at = [], 0
        for size in sizes:
            if size:
                share = marginals[at : at + size].mean(0)
                best = int(share.argmax())
                out.append((self.model.languages[best], float(min(1.0, share[best]))))
            else:
                out.append((UNKNOWN, 0.0))
            at += size
        return out


def fit(docs: DataFrame, id_col: str, text_col: str, label_col: str) -> Model:
    """A model of the labelled texts; those of the smallest id hashes are the sample."""
    rows = docs.select(
        F.md5(F.col(id_col).cast("string")).alias("at"), F.col(text_col).alias("text"), F.col(label_col).alias("label")
    ).filter("text is not null and label is not null")
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    counts = counts.orderBy(F.col("n").desc(), "label").limit(MAX_LANGUAGES).collect()
    if not counts:
        return train([], [])
    each = max(1, SAMPLE_TEXTS // len(counts))
    # rows are thinned where they are read, so that few more than the sample are moved
    below = {r["label"]: min(1 << 32, math.ceil((1.3 * each + 30) / r["n"] * (1 << 32))) for r in counts}
    limits = F.create_map(*[F.lit(x) for pair in below.items() for x in pair])
    number = F.conv(F.substring("at", 1, 8), 16, 10).cast("long")
    begin = number % F.greatest(F.lit(1), F.char_length("text") - SAMPLE_CHARS)
    first = Window.partitionBy("label").orderBy("at")
    sample = (
        rows.filter(number < F.element_at(limits, F.col("label")))
        .select("label", F.substring("text", begin.cast("int") + 1, F.lit(SAMPLE_CHARS)).alias("text"), "at")
        .withColumn("n", F.row_number().over(first))
        .filter(F.col("n") <= each)
        .orderBy("label", "at")
        .collect()
    )
    return train([r["text"] for r in sample], [r["label"] for r in sample])


def language(text: Column, model: Model) -> Column:
    """struct(lang_pred, score) of a text: ``und`` and 0 for null texts and texts without a letter."""
    spark = SparkSession.getActiveSession()
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value)
        for column in batches:
            texts = [t if isinstance(t, str) else None for t in column]
            found = [x for i in range(0, len(texts), TEXTS) for x in labeller.texts(texts[i : i + TEXTS])]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    return label.asNondeterministic()(text)


def identify(docs: DataFrame, text_col: str, model: Model) -> DataFrame:
    """All columns of every row, and ``found``: struct(lang_pred, score), score from 0 to 1.

    Null texts and texts without a letter are ``und`` with score 0. Only the text decides.
    Repeated rows are labelled alike; other columns are passed on, one named ``found`` is
    replaced; an empty table gives no rows.
    """
    return docs.withColumn("found", language(F.col(text_col), model))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query("op9_language_crf")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, and whether it was held out of training."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(docs.filter("doc_id is not null and not held_out"), "doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "held_out", "text"), "text", model)
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")
