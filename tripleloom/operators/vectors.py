"""Exact nearest vectors of a query set, in blocks of matrix products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries and base vectors of one product; their product is what a task holds.
QUERY_BLOCK, BASE_BLOCK = 2_048, 8_192
#: Digits to which scores are compared, so that equal vectors tie.
DIGITS = 12


def _unit(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of length one; vectors that are null, empty, zero or of another width become zero."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == width:
            out[i] = v
    norm = np.sqrt((out * out).sum(1))
    norm[norm == 0] = 1.0
    return out / norm[:, None]


def top_similar(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(key, other, raw, place): the ``k`` base rows of greatest cosine of each query row, itself aside.

    Both sides are cut into blocks by the hash of their key. Every pair of blocks is one
    product, of which only the best ``k`` for each query leave the task; a window over
    those few ends the search. Ties go to the smaller key; a vector that is null, zero or
    of another width has cosine 0.
    """
    parts = lambda df, size: max(1, -(-df.count() // size))
    q_blocks, b_blocks = parts(queries, QUERY_BLOCK), parts(base, BASE_BLOCK)
    # a small base still uses all cores
    b_blocks = max(b_blocks, min(base.sparkSession.sparkContext.defaultParallelism, parts(base, 256)))
    block = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(key, vector, block(q_blocks).alias("qb"), every(b_blocks).alias("bb"))
    there = base.select(key, vector, block(b_blocks).alias("bb"), every(q_blocks).alias("qb"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = [key, "other", "raw"]
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in columns})
        widths = pd.Series([len(v) for v in right[vector] if v is not None] or [0])
        width = int(widths.mode().iloc[0])
        right = right.sort_values(key, kind="stable")
        ids = right[key].to_numpy()
        scores = np.round(_unit(left[vector], width) @ _unit(right[vector], width).T, DIGITS)
        out = []
        for own, row in zip(left[key].to_numpy(), scores, strict=True):
            row = np.where(ids == own, -2.0, row)
            least = np.partition(row, -k)[-k] if len(row) > k else -1.5
            near = np.flatnonzero((row >= least) & (row > -1.5))
            best = near[np.argsort(-row[near], kind="stable")][:k]
            out += [(own, ids[i], float(row[i])) for i in best]
        return pd.DataFrame(out, columns=columns)

    kind = dict(base.dtypes)[key]
    some = asked.groupBy("qb", "bb").cogroup(there.groupBy("qb", "bb")).applyInPandas(run, f"{key} {kind}, other {kind}, raw double")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("raw"), "other"))
    return some.withColumn("place", place).where(F.col("place") <= k)
