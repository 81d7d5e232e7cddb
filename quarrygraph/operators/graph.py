"""Graph operators on edge tables: PageRank, bounded reachability, closure, degrees."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import words as W
from ..lineage import cut, written

DAMPING = 0.85
MAX_ITERATIONS = 100
TOLERANCE = 1e-6
#: Up to so many edges and nodes the iteration runs in one task, beyond as joins.
ALONE = 1_000_000
#: Up to so many edges through names are written out, beyond the rounds pass by the names.
MULTIPLIED = 10_000_000
#: Counted rows of a key and a number are broadcast up to this many; beyond it joins shuffle.
FEW = 1 << 18


def collapse(edges: DataFrame) -> DataFrame:
    """Parallel edges (src, dst, weight) as one with their weights' sum, self-loops left out."""
    return edges.where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def pagerank(
    edges: DataFrame,
    nodes: DataFrame,
    personalization: DataFrame | None = None,
    iterations: int = MAX_ITERATIONS,
    tolerance: float = TOLERANCE,
    alone: int = ALONE,
) -> DataFrame:
    """(node, rank): weighted PageRank of `nodes` (node) over `edges` (src, dst, weight); ranks sum to 1.

    `personalization` (node, weight) is normalised; without positive weight teleport is uniform. Mass of
    nodes without outgoing edges goes where teleport goes. Rounds end at `iterations`, or when the
    ranks move by less than `tolerance` in all; a tolerance of 0 runs them all.
    """
    e = collapse(edges)
    few = e.limit(alone + 1).count() <= alone and nodes.limit(alone + 1).count() <= alone
    rank = _alone if few else _distributed
    return rank(e, nodes.select("node").distinct(), personalization, iterations, tolerance)


def _alone(e: DataFrame, nodes: DataFrame, personalization: DataFrame | None, iterations: int, tolerance: float) -> DataFrame:
    """The iteration over a graph of bounded size as a whole, in one task."""
    kind = nodes.schema["node"].dataType.simpleString()
    none = F.lit(None).cast(kind)
    rows = nodes.select("node", none.alias("dst"), F.lit(0.0).alias("w"), F.lit(0).alias("kind"))
    rows = rows.union(e.select("src", "dst", F.col("weight").cast("double"), F.lit(1)))
    if personalization is not None:
        rows = rows.union(personalization.select("node", none, F.col("weight").cast("double"), F.lit(2)))

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat([*batches, pd.DataFrame({"node": [], "dst": [], "w": [], "kind": []})])
        part = [got[got["kind"] == k] for k in range(3)]
        names = np.sort(part[0]["node"].to_numpy())
        n = len(names)
        if not n:
            return
        known = part[1][part[1]["node"].isin(names) & part[1]["dst"].isin(names)]
        src, dst, w = np.searchsorted(names, known["node"].to_numpy()), np.searchsorted(names, known["dst"].to_numpy().astype(names.dtype)), known["w"].to_numpy(float)
        liked = part[2][part[2]["node"].isin(names)]
        p = np.bincount(np.searchsorted(names, liked["node"].to_numpy()), liked["w"].to_numpy(float), n) if len(liked) else np.zeros(n)
        teleport = p / p.sum() if p.sum() > 0 else np.full(n, 1 / n)
        out = np.bincount(src, w, n)
        ranks = np.full(n, 1 / n)
        for _ in range(iterations):
            share = np.divide(ranks, out, out=np.zeros(n), where=out > 0)
            new = (1 - DAMPING + DAMPING * ranks[out <= 0].sum()) * teleport + DAMPING * np.bincount(dst, share[src] * w, n)
            moved = np.abs(new - ranks).sum()
            ranks = new
            if moved < tolerance:
                break
        yield pd.DataFrame({"node": names, "rank": ranks})

    return rows.repartition(1).mapInPandas(rank, f"node {kind}, rank double")


def _distributed(e: DataFrame, nodes: DataFrame, personalization: DataFrame | None, iterations: int, tolerance: float) -> DataFrame:
    """The same with one job a round."""
    base = _teleport(nodes, personalization)
    e = e.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
    out = e.groupBy("src").agg(F.sum("weight").alias("out"))
    base = cut(base.join(out.withColumnRenamed("src", "node"), "node", "left"))
    shares = cut(e.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")))
    return _rounds(base, lambda ranks: ranks.select("node", "rank").join(shares, F.col("node") == F.col("src")).select("dst", (F.col("rank") * F.col("share")).alias("into")), iterations, tolerance)


def _teleport(nodes: DataFrame, personalization: DataFrame | None) -> DataFrame:
    """(node, teleport): where teleport goes, in shares of 1."""
    if personalization is not None:
        p = personalization.join(nodes, "node", "left_semi").groupBy("node").agg(F.sum("weight").alias("p"))
        total = p.agg(F.sum("p")).first()[0] or 0
        if total > 0:
            return nodes.join(p, "node", "left").select("node", (F.coalesce("p", F.lit(0.0)) / total).alias("teleport"))
    return nodes.withColumn("teleport", F.lit(1.0 / max(1, nodes.count())))


def _rounds(base: DataFrame, incoming: Callable[[DataFrame], DataFrame], iterations: int, tolerance: float) -> DataFrame:
    """(node, rank) from `base` (node, teleport, out: null without edges), with one job a round.

    `incoming` gives what nodes receive (dst, into), in any number of rows, from (node, rank) and the columns
    of `base`. Each round's aggregation also carries the loose mass and the movement.
    """
    n = base.count()
    ranks = cut(base.select("*", F.lit(1.0 / max(1, n)).alias("rank"), F.lit(0.0).alias("moved")))
    loose = ranks.where("out is null").agg(F.sum("rank")).first()[0] or 0.0
    for _ in range(iterations):
        into = incoming(ranks).groupBy("dst").agg(F.sum("into").alias("into"))
        new = (1 - DAMPING + DAMPING * loose) * F.col("teleport") + DAMPING * F.coalesce("into", F.lit(0.0))
        ranks = cut(ranks.join(into, F.col("node") == F.col("dst"), "left").select(*base.columns, new.alias("rank"), F.abs(new - F.col("rank")).alias("moved")))
        seen = ranks.agg(F.sum(F.when(F.col("out").isNull(), F.col("rank"))).alias("loose"), F.sum("moved").alias("moved")).first()
        loose = seen["loose"] or 0.0
        if (seen["moved"] or 0.0) < tolerance:
            break
    return ranks.select("node", "rank")


def pagerank_through(
    uses: DataFrame,
    homes: DataFrame,
    nodes: DataFrame,
    personalization: DataFrame | None = None,
    iterations: int = MAX_ITERATIONS,
    tolerance: float = TOLERANCE,
    most: int = MULTIPLIED,
) -> DataFrame:
    """(node, rank): `pagerank` over the edges from each user of a name to all other homes of the name.

    `uses` has one row (src, via, weight) for each node and name, `homes` distinct rows (via, dst). The edges
    number their product, which grows with the square of a name's copies. Beyond `most` edges none is
    written out: a round adds up what reaches each name and hands that to all its homes, less what a
    home sent itself. So it costs the rows of `uses` and `homes`.
    """
    nodes = nodes.select("node").distinct()
    homes = cut(homes.join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").select("via", "dst"))
    names = cut(homes.groupBy("via").agg(F.count("*").alias("homes")))
    small = lambda df, rows: F.broadcast(df) if rows <= FEW else df
    n, n_names = nodes.count(), names.count()
    at_home = homes.select("via", F.col("dst").alias("src"), F.lit(1).alias("own"))
    pairs = uses.join(at_home, ["src", "via"], "left").join(small(names, n_names), "via")
    with written(pairs.select("src", "via", "weight", (F.col("homes") - F.coalesce("own", F.lit(0))).alias("others"), F.col("own").isNotNull().alias("own"))) as u:
        if (u.agg(F.sum("others")).first()[0] or 0) <= most:
            return cut(pagerank(u.join(homes, "via").select("src", "dst", "weight"), nodes, personalization, iterations, tolerance))
        sums = u.groupBy("src").agg(F.nullif(F.sum(F.col("weight") * F.col("others")), F.lit(0.0)).alias("out"), F.sum(F.when(F.col("own"), F.col("weight")).otherwise(0.0)).alias("own"))
        base = cut(_teleport(nodes, personalization).join(sums.withColumnRenamed("src", "node"), "node", "left"))

        def incoming(ranks: DataFrame) -> DataFrame:
            share = ranks.where("out is not null").select(F.col("node").alias("src"), (F.col("rank") / F.col("out")).alias("share"), "own")
            mass = u.join(small(share.drop("own"), n), "src").groupBy("via").agg(F.sum(F.col("weight") * F.col("share")).alias("into"))
            back = share.where("own > 0").select(F.col("src").alias("dst"), (-F.col("share") * F.col("own")).alias("into"))
            return homes.join(small(mass, n_names), "via").select("dst", "into").union(back)

        return _rounds(base, incoming, iterations, tolerance)


def rank_symbols(refs: DataFrame, defs: DataFrame, weight: Column, iterations: int = MAX_ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """(node, rank) of every defined name: edges from caller to callee, headings damped to a tenth afterwards."""
    names = defs.groupBy(F.col("name").alias("node")).agg(F.count("*").alias("def_count"), F.min_by("kind", F.struct("fid", "start")).alias("kind"))
    names = names.where(~F.col("node").isin(W.ALWAYS_FILTERED) & ~((F.col("def_count") == 0) & F.col("node").isin(W.PRELUDE)))
    calls = refs.where("caller is not null and caller <> callee").groupBy("caller", "callee").agg(F.count("*").alias("n"))
    info = names.select(F.col("node").alias("callee"), "def_count")
    edges = calls.join(info, "callee").select(F.col("caller").alias("src"), F.col("callee").alias("dst"), weight.alias("weight"))
    ranks = pagerank(edges, names.select("node"), iterations=iterations, tolerance=tolerance)
    return ranks.join(names.select("node", "kind"), "node").select("node", (F.col("rank") * F.when(F.col("kind") == "heading", 0.1).otherwise(1.0)).alias("rank"))


def reach_back(edges: DataFrame, anchors: DataFrame, depth: int = 2, most: int = 4) -> DataFrame:
    """(anchor, node, depth) of all that reach each anchor (node) over `edges` (src, dst) in at most `depth` steps, with the least depth.

    A frontier advances one join a step, and what was seen before leaves it by an anti-join, so a
    dense graph costs its edges once a step and never its paths.
    """
    e = edges.where("src <> dst").select("src", "dst").distinct()
    frontier = anchors.select(F.col("node").alias("anchor"), "node").distinct()
    seen = frontier.withColumn("depth", F.lit(0))
    for step in range(1, min(depth, most) + 1):
        frontier = (
            frontier.join(e, F.col("node") == F.col("dst")).select("anchor", F.col("src").alias("node")).distinct()
            .join(seen.select("anchor", "node"), ["anchor", "node"], "left_anti")
        )
        if step > 1:
            frontier = cut(frontier)
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(step)))
    return seen.where("depth > 0")


def closure(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor, node): what each anchor refers to directly, itself left out."""
    return edges.join(anchors.select(F.col("node").alias("src")).distinct(), "src", "left_semi").where("src <> dst").select(F.col("src").alias("anchor"), F.col("dst").alias("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out): distinct callers and callees."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    ends = e.select(F.explode(F.array(F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x")).select("x.*")
    return ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
