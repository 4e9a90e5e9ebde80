"""Text folding, tokens and phrase tests."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: combining marks dropped by folding, white space, characters between tokens
MARKS = r"[\u0300-\u036f]"
SPACES = r"[\s\u00a0\u1680\u2028\u2029\ufeff]+"
NOT_TOKEN = r"[^\p{L}\p{N}\p{Co}]+"


@cache
def _base_letters() -> tuple[str, str]:
    """Every composed character whose decomposition is one character plus dropped marks."""
    composed, base = [], []
    for code in range(0xA0, 0x10000):
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if parts == char:
            continue
        kept = "".join(p for p in parts if not 0x300 <= ord(p) <= 0x36F)
        if len(kept) == 1:
            composed.append(char)
            base.append(kept)
    return "".join(composed), "".join(base)


def fold(text: Column) -> Column:
    """Drop accents (U+0300 to U+036F after decomposition) and lower-case."""
    composed, base = _base_letters()
    # Plain ASCII text has as many bytes as characters and nothing to strip.
    plain = F.octet_length(text) == F.length(text)
    stripped = F.regexp_replace(F.translate(text, composed, base), MARKS, "")
    return F.lower(F.when(plain, text).otherwise(stripped))


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC")


def nfkc(text: Column) -> Column:
    """Compatibility normal form; Spark has no built-in for it. ASCII text is its own and never leaves the JVM."""
    other = F.when(F.octet_length(text) != F.length(text), text)
    return F.coalesce(F.pandas_udf(_nfkc, "string")(other), text)


def clean_text(text: Column) -> Column:
    """Compatibility form with single spaces and no outer space."""
    return F.trim(F.regexp_replace(nfkc(text), SPACES, " "))


def valid_prompt(text: Column, longest: int = 500) -> Column:
    return F.length(F.trim(text)).between(1, longest)


def tokens(text: Column) -> Column:
    """Folded tokens in order; anything that is no letter or digit separates."""
    return F.filter(F.split(fold(text), NOT_TOKEN), lambda t: t != "")


def token_string(text: Column) -> Column:
    """Folded tokens, each with a space on both sides, for phrase tests with ``contains``."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(fold(text), NOT_TOKEN, " ")), F.lit(" "))


def text_matches(text: Column, terms: Sequence[str]) -> Column:
    """All terms occur, each as a phrase of whole tokens; a term without tokens matches nothing."""
    if not terms:
        raise ValueError("at least one term is needed")
    padded = token_string(text)
    found = F.lit(True)
    for term in terms:
        phrase = token_string(F.lit(term))
        found = found & (F.length(F.trim(phrase)) > 0) & padded.contains(phrase)
    return F.coalesce(found, F.lit(False))


def has_text(text: Column) -> Column:
    """At least one character that is no space."""
    return F.coalesce(F.length(F.trim(text)) > 0, F.lit(False))


def build_token_index(texts: DataFrame, key: str = "id", text: str = "ocr_text") -> DataFrame:
    """One row per asset and distinct token; distinct per row, so nothing is shuffled."""
    return texts.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("token"))


def lay_out_token_index(index: DataFrame, buckets: int, key: str = "id", spread: int = 8) -> DataFrame:
    """Partition the index by token bucket for writing.

    The spread keeps one very common token from becoming one task.
    """
    return (
        index.withColumn("token_bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
        .repartition("token_bucket", F.pmod(F.xxhash64(key), F.lit(spread)))
        .sortWithinPartitions("token_bucket", "token")
    )


def update_token_index(index: DataFrame, changed: DataFrame, key: str = "id") -> DataFrame:
    """Keep the index in step: entries of changed or deleted texts go, those of present ones come.

    ``changed`` has every touched key; a null text means the text was deleted.
    """
    kept = index.join(changed.select(key).distinct(), key, "left_anti")
    return kept.unionByName(build_token_index(changed.where(F.col("ocr_text").isNotNull()), key))


def indexed_matches(
    index: DataFrame, terms: Sequence[str], key: str = "id", buckets: int | None = None
) -> DataFrame:
    """Keys holding every token of the terms: a candidate set to check with :func:`text_matches`.

    With the number of ``buckets`` of a laid-out index only the directories of
    the wanted tokens are read.
    """
    wanted = F.array_distinct(F.flatten(F.array(*[tokens(F.lit(t)) for t in terms])))
    hits = index.where(F.array_contains(wanted, F.col("token")))
    if buckets is not None:
        read = F.transform(wanted, lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))
        hits = hits.where(F.array_contains(read, F.col("token_bucket")))
    return (
        hits.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_hits"))
        .where(F.col("_hits") == F.size(wanted))
        .select(key)
    )
