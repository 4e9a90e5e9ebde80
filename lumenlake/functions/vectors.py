"""Vector functions: cosine similarity, pooling and prototype scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PROTOTYPES = 10_000


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def _finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two double arrays; null for empty, unequal, non-finite or zero vectors."""
    valid = (F.size(a) > 0) & (F.size(a) == F.size(b)) & _finite(a) & _finite(b)
    norms = _dot(a, a) * _dot(b, b)
    return F.when(valid & (norms > 0), _dot(a, b) / F.sqrt(norms))


def mean_pool_normalize(tokens: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean over the token vectors of a key, scaled to unit length.

    Sums per (key, dimension) are combined before the shuffle, so a key with
    very many tokens is no hot task; only one value per dimension is collected.
    Keys whose norm is zero or not finite are dropped, as they have no direction.
    """
    cells = tokens.select(key, F.posexplode(vector).alias("_dim", "_x"))
    means = cells.groupBy(key, "_dim").agg(F.avg(F.col("_x").cast("double")).alias("_mean"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda acc, c: acc + c["_mean"] * c["_mean"]))
    return (
        means.groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("_dim", "_mean"))).alias("_v"))
        .withColumn("_norm", norm)
        .where((F.col("_norm") > 0) & (F.col("_norm") < float("inf")))
        .select(key, F.transform("_v", lambda c: c["_mean"] / F.col("_norm")).alias(vector))
    )


def concept_scores(vectors: DataFrame, prototypes: DataFrame, vector: str) -> DataFrame:
    """Add ``scores``: for every concept the best cosine over its prototypes, as array of structs.

    Prototypes are a model parameter of a few vectors per concept; their number
    is checked before they are shipped to the tasks, where one matrix product
    per Arrow batch scores every row. Nothing is shuffled and no pair of row and
    prototype is ever a row of its own. Invalid vectors get null. This reads the
    prototypes at planning time.
    """
    rows = prototypes.select("concept", vector).limit(MAX_PROTOTYPES + 1).collect()
    if not rows or len(rows) > MAX_PROTOTYPES:
        raise ValueError(f"1 to {MAX_PROTOTYPES} prototypes expected")
    concepts = sorted({r[0] for r in rows})
    owner = np.array([concepts.index(r[0]) for r in rows])
    order = np.argsort(owner, kind="stable")
    matrix = np.array([rows[i][1] for i in order], dtype=np.float64)
    starts = np.searchsorted(owner[order], np.arange(len(concepts)))
    norms = (matrix**2).sum(axis=1)
    if not np.isfinite(matrix).all() or (norms == 0).any():
        raise ValueError("prototype vectors must be finite and non-zero")
    dims = matrix.shape[1]

    @F.pandas_udf("array<double>")
    def best(batch: pd.Series) -> pd.Series:
        good = np.array([v is not None and len(v) == dims for v in batch], dtype=bool)
        out: list[np.ndarray | None] = [None] * len(batch)
        if good.any():
            x = np.stack(batch.to_numpy()[good]).astype(np.float64)
            square = (x**2).sum(axis=1)
            ok = np.isfinite(x).all(axis=1) & (square > 0)
            with np.errstate(all="ignore"):
                cosine = (x @ matrix.T) / np.sqrt(square[:, None] * norms[None, :])
            top = np.maximum.reduceat(cosine, starts, axis=1)
            for position, valid, scores in zip(np.flatnonzero(good), ok, top):
                out[position] = scores if valid else None
        return pd.Series(out, dtype=object)

    names = F.array(*[F.lit(c) for c in concepts])
    scored = F.zip_with(
        F.col("_best"), names, lambda s, c: F.struct(s.alias("similarity"), c.alias("concept"))
    )
    return vectors.withColumn("_best", best(F.col(vector))).withColumn("scores", scored).drop("_best")
