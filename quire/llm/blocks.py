"""Comparing all rows that share a key, in blocks, with no task holding a whole large group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import join_small, materialize, spread


def block_pairs(rows: DataFrame, keys: list[str], node: str, block: int) -> DataFrame:
    """``rows`` dealt to groups (keys, bi, bj) of at most about 2 * ``block`` rows.

    A key of up to ``block`` rows is one group. A larger one is hashed by ``node`` into blocks, and
    each pair of blocks (and each block by itself) is a group; ``own`` tells the block of a row, so
    that pairs inside one block are compared in the group bi = bj alone.
    """
    counts = rows.groupBy(*keys).count().where(F.col("count") > block)
    large = materialize(counts.select(*keys, F.ceil(F.col("count") / block).cast("int").alias("nb")), "large")
    n = large.count()
    if not n:
        return rows.withColumns({"bi": F.lit(0), "bj": F.lit(0), "own": F.lit(0)})
    out = join_small(rows, large, keys, "left", n).withColumn("nb", F.coalesce("nb", F.lit(1)))
    out = out.withColumn("own", F.pmod(F.xxhash64(node), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return out.select(*rows.columns, F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own")


def compare_groups(rows: DataFrame, keys: list[str], compare: Callable[[pd.DataFrame, np.ndarray], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Sort each partition by group and hand whole groups to ``compare``, many at a time.

    ``compare(pdf, starts)`` gets rows sorted by group and where each group begins, with the
    number of rows at the end. Groups of a single row are left out.
    """
    group = [*keys, "bi", "bj"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush(pdf: pd.DataFrame, last: bool) -> tuple[pd.DataFrame, Iterator[pd.DataFrame]]:
            new = np.ones(len(pdf), bool)
            if len(pdf) > 1:
                new[1:] = np.logical_or.reduce([pdf[c].to_numpy()[1:] != pdf[c].to_numpy()[:-1] for c in group])
            starts = np.append(np.flatnonzero(new), len(pdf))
            end = len(pdf) if last else int(starts[-2])
            rest = pdf.iloc[end:]
            size = np.diff(starts)
            keep = np.repeat(size > 1, size)[:end]
            part = pdf.iloc[:end][keep].reset_index(drop=True)
            edges = np.concatenate([[0], np.cumsum(size[(size > 1) & (starts[:-1] < end)])]).astype(np.int64)
            return rest, compare(part, edges) if len(part) else iter(())

        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            if sum(map(len, held)) >= 8192:
                rest, out = flush(pd.concat(held, ignore_index=True), False)
                yield from out
                held = [rest]
        if held:
            yield from flush(pd.concat(held, ignore_index=True), True)[1]

    return spread(rows, *group).sortWithinPartitions(*group).mapInPandas(run, schema)


def shifted_pairs(starts: np.ndarray, own: np.ndarray, apart: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, of the same group, one distance j - i at a time.

    ``apart``: whether the row's group compares two blocks; then only pairs across them count.
    """
    size = np.repeat(np.diff(starts), np.diff(starts))
    place = np.arange(len(size)) - np.repeat(starts[:-1], np.diff(starts))
    at = np.arange(len(size))
    for s in range(1, int(size.max(initial=0))):
        at = at[place[at] + s < size[at]]
        i, j = at, at + s
        ok = ~apart[i] | (own[i] != own[j])
        yield i[ok], j[ok]
