"""Pluggable models: text encoders and generators, loaded once per Python worker."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaquarry.functions.text import tokens
from metaquarry.functions.words import unpacked, word_chars, word_steps
from metaquarry.schemas import EMBEDDING_DIM
from metaquarry.session import spread


def xxhash_bucket(term: Column, dim: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(dim)).cast("int")


def md5_bucket(term: Column, dim: int) -> Column:
    """Slower than xxhash, but any engine can recompute it."""
    head = F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long")
    return F.pmod(head, F.lit(dim)).cast("int")


#: Words whose bucket a task remembers.
KNOWN_WORDS = 200_000


def md5_slots(words: pa.Array, dim: int, known: dict[str, int]) -> np.ndarray:
    """``md5_bucket`` of every word; each different word of the array is hashed once."""
    coded = words.dictionary_encode()
    found = np.empty(len(coded.dictionary), np.int64)
    for i, word in enumerate(coded.dictionary.to_pylist()):
        slot = known.get(word)
        if slot is None:
            slot = int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big") % dim
            if len(known) < KNOWN_WORDS:
                known[word] = slot
        found[i] = slot
    return found[coded.indices.to_numpy(zero_copy_only=False)]


def word_buckets(words: Column, dim: int, bucket: Callable[[Column, int], Column]) -> Column:
    """The bucket of every word of a list."""
    if bucket is not md5_bucket:
        return F.transform(words, lambda t: bucket(t, dim))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def slots(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, int] = {}
        for lists in batches:
            ends = np.append(0, np.cumsum(_sizes(lists))).astype(np.int32)
            found = md5_slots(lists.flatten(), dim, known).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(found))

    return slots(words)


def _sizes(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def hash_embedding(
    text: Column,
    dim: int = EMBEDDING_DIM,
    instruction: str = "",
    bucket: Callable[[Column, int], Column] = xxhash_bucket,
) -> Column:
    """Default encoder: counts of hashed tokens, scaled to unit length. A text without any
    token has no direction and becomes the zero vector.

    Tokens are hashed by Spark and only small integers reach Python, but for md5, for which
    texts reach Python, where each different word of a step is hashed once. No shuffle takes place.
    """
    full = F.concat(F.lit(instruction), F.coalesce(text, F.lit("")))
    if bucket is md5_bucket:

        chars = word_chars(SparkSession.active())

        @F.arrow_udf(T.ArrayType(T.FloatType()))
        def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known, in_words = {}, unpacked(chars)
            for texts in batches:
                out = np.empty((len(texts), dim), np.float32)
                for at, n, rows, is_word, pieces in word_steps(texts, in_words):
                    slot = rows[is_word] * dim + md5_slots(pieces.filter(pa.array(is_word)), dim, known)
                    counts = np.bincount(slot, minlength=n * dim).reshape(-1, dim).astype(np.float64)
                    norms = np.linalg.norm(counts, axis=1, keepdims=True)
                    out[at : at + n] = counts / np.where(norms == 0, 1.0, norms)
                ends = np.arange(len(texts) + 1, dtype=np.int32) * dim
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

        return counted(F.lower(full))
    buckets = F.transform(tokens(full), lambda t: bucket(t, dim))

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def dense(rows: pd.Series) -> pd.Series:
        n = len(rows)
        lengths = np.fromiter((len(r) for r in rows), dtype=np.int64, count=n)
        flat = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows]) if n else np.empty(0)
        slot = np.repeat(np.arange(n) * dim, lengths) + flat.astype(np.int64)
        counts = np.bincount(slot, minlength=n * dim).reshape(n, dim).astype(np.float64)
        norms = np.linalg.norm(counts, axis=1, keepdims=True)
        return pd.Series(list((counts / np.where(norms == 0, 1.0, norms)).astype(np.float32)))

    return dense(buckets)


def model_embedding(text: Column, load: Callable[[], Callable], instruction: str = "") -> Column:
    """Encode with any model. ``load`` runs once per task and returns a function from a
    list of texts to a matrix; its rows are scaled to unit length."""
    full = F.concat(F.lit(instruction), F.coalesce(text, F.lit("")))

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def dense(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for batch in batches:
            m = np.asarray(encode(batch.tolist()), dtype=np.float64).reshape(len(batch), -1)
            norms = np.linalg.norm(m, axis=1, keepdims=True)
            yield pd.Series(list((m / np.where(norms == 0, 1.0, norms)).astype(np.float32)))

    return dense(full)


def echo_model() -> Callable[[list[str]], list[str]]:
    """Deterministic stand-in generator: answers with a JSON object holding the prompt length."""

    def generate(prompts: list[str]) -> list[str]:
        return [json.dumps({"thought": str(len(p)), "category": "CHAT"}) for p in prompts]

    return generate


def apply_model(
    df: DataFrame,
    prompt_col: str,
    load: Callable[[], Callable[[list[str]], list[str]]] = echo_model,
    response_col: str = "response",
) -> DataFrame:
    """Append the model's response to each prompt; ``load`` runs once per task."""
    schema = T.StructType([*df.schema.fields, T.StructField(response_col, T.StringType())])

    def run(batches):
        generate = load()
        for pdf in batches:
            pdf[response_col] = generate(pdf[prompt_col].tolist())
            yield pdf

    return df.mapInPandas(run, schema)


def group_hash_embedding(
    docs: DataFrame,
    group_col: str,
    text_col: str,
    dim: int = EMBEDDING_DIM,
    bucket: Callable[[Column, int], Column] = xxhash_bucket,
    vector_col: str = "dense_vector",
) -> DataFrame:
    """Hash embedding of every group's texts taken together, from summed bucket counts."""
    words = tokens(F.coalesce(F.col(text_col), F.lit("")))
    buckets = word_buckets(words, dim, bucket)
    # every group keeps a row even when its texts have no token
    counts = (
        spread(docs.select(group_col, text_col))
        .select(group_col, F.explode_outer(buckets).alias("_b"))
        .groupBy(group_col, "_b")
        .agg(F.count("_b").alias("_c"))
        .groupBy(group_col)
        # at most dim entries; a text without words has no bucket, and one null among the
        # numbers would make floats of them all
        .agg(F.collect_list(F.when(F.col("_b").isNotNull(), F.struct("_b", "_c"))).alias("_counts"))
    )

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def dense(rows: pd.Series) -> pd.Series:
        out = []
        for pairs in rows:
            v = np.zeros(dim)
            for p in pairs:
                v[p["_b"]] = p["_c"]
            norm = np.linalg.norm(v)
            out.append((v / norm if norm else v).astype(np.float32))
        return pd.Series(out)

    return counts.select(group_col, dense("_counts").alias(vector_col))
