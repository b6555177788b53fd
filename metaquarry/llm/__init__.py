"""Operators for training-data corpora, and the queries that run them."""

from metaquarry.llm import (  # noqa: F401
    bag_search,
    html_text,
    lang_crf,
    licenses,
    mixing,
    ngram_join,
    packing,
    permutation_index,
    phrases,
    quality_rules,
    run_index,
    secrets,
    url_cascade,
)
from metaquarry.llm.common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
