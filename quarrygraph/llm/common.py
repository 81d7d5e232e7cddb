"""Helpers shared by the training-data operators: lineage cuts, skew-safe joins, components."""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut, shared_folder  # noqa: F401

#: A key with more than this share of the rows is joined by broadcast: at most 1 / share keys can have it.
HEAVY_SHARE = 0.001
#: A table of counted rows, each of some 200 bytes at most, is broadcast up to this many; beyond it joins shuffle.
FEW = 1 << 16
#: So many edges are joined up in one task; more go through rounds of joins.
ALONE = 1 << 14


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few(df: DataFrame, rows: int) -> DataFrame:
    """`df`, to be broadcast if its counted rows are few."""
    return F.broadcast(df) if rows <= FEW else df


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def left_join_by_size(left: DataFrame, groups: DataFrame, key: str, size: str, rows: int) -> DataFrame:
    """`left` joined to one row per key of `groups`, whatever share of `left` one key holds.

    groups[size] is the number of rows that the key has in `left`. Keys with a share of
    HEAVY_SHARE or more number 1 / HEAVY_SHARE at most, so broadcasting them is bounded;
    the others shuffle, and none of those can fill a task. `left` and `groups` are read
    twice and should be cut. Rows whose key is not in `groups` stay, with nulls.
    """
    limit = max(1000.0, rows * HEAVY_SHARE)
    heavy = groups.filter(F.col(size) >= limit)
    light = groups.filter(F.col(size) < limit)
    tried = left.join(F.broadcast(heavy), key, "left")
    return tried.filter(F.col(size).isNotNull()).unionByName(
        tried.filter(F.col(size).isNull()).select(*left.columns).join(light, key, "left")
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (a, b: long); returns (node, root), root the least node reachable.

    Up to ALONE distinct edges are joined up in one task. More go through alternating star
    contraction: each round first hangs every larger neighbour of a node on the least one, then
    every smaller neighbour. Edge counts never grow, paths shrink to stars in O(log^2 n) rounds, and
    each round is one pair of aggregations and joins whose hot nodes adaptive execution splits.
    Rounds end when the edges no longer change. Self-loops are kept out; a node without an edge has
    no row. The result is written to the checkpoint folder.
    """
    e = cut(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u <> v")
        .distinct()
    )
    if e.count() <= ALONE:
        return cut(e.repartition(1).mapInArrow(_joined_up, "node long, root long"))
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u")
            .filter("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.*")
            .filter("u <> v")
            .distinct()
        )
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return cut(e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            ))
        before = now


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the components of all edges (u, v) of a task: labels sink to the least until none moves."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not got:
        return
    u, v = (np.concatenate(c) for c in zip(*got))
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while True:
        now = root.copy()
        np.minimum.at(now, u, root[v])
        np.minimum.at(now, v, root[u])
        np.minimum.at(now, root, now.copy())
        now = now[now]
        if (now == root).all():
            break
        root = now
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root])], names=["node", "root"])


def tidy(f: Callable) -> Callable:
    """`f`, a function that Python workers run, giving freed memory back to the system at its end.

    Workers live on between tasks and stages, and so would what their allocators keep.
    """

    def give_back() -> None:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    def over_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    def over_group(t: pa.Table) -> pa.Table:
        try:
            return f(t)
        finally:
            give_back()

    return over_batches if inspect.isgeneratorfunction(f) else over_group


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
