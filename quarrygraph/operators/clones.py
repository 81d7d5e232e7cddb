"""Clone groups: equal fragments by site, and their greedy cover."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut


def clone_groups(sites: DataFrame, fragment: str, path: str, mass: str) -> DataFrame:
    """(fragment, cluster_id, mass, sites, spread, score) of fragments with two sites or more."""
    g = sites.groupBy(fragment).agg(F.max(mass).alias("mass"), F.count("*").alias("sites"), F.countDistinct(path).alias("spread"))
    return g.where("sites >= 2").withColumn("cluster_id", F.md5(F.col(fragment).cast("string"))).withColumn("score", F.col("mass") * F.col("spread"))


def pair_clusters(pairs: DataFrame) -> DataFrame:
    """Clusters of a pair report (fragment, tokens, first, second: structs of name, start, end)."""
    sides = pairs.select("fragment", "tokens", F.explode(F.array("first", "second")).alias("s"))
    one = sides.groupBy("fragment", "s.name", "s.start").agg(F.max("tokens").alias("tokens"), F.min("s.end").alias("end"))
    return one.groupBy("fragment").agg(F.max("tokens").alias("mass_tokens"), F.sort_array(F.collect_list(F.struct("name", "start", "end"))).alias("sites"), F.countDistinct("name").alias("spread_files")).select(
        F.md5("fragment").alias("cluster_id"), "mass_tokens", "sites", "spread_files", (F.col("mass_tokens") * F.col("spread_files")).alias("score"))


def maximal_clones(candidates: DataFrame) -> DataFrame:
    """Greedy maximal clusters of candidates (hash, mass, path, start, end), heaviest first, hash breaking ties.

    A site inside an accepted cluster's site of the same file is claimed; a cluster needs two sites
    that aren't. Sequential by mass, but only fragments with a site inside another's depend on each
    other: connected groups of those are settled in one task each. All others are accepted as they are.
    """
    shared = candidates.groupBy("hash").agg(F.countDistinct("path", "start").alias("n")).where("n >= 2").select("hash")
    c = cut(candidates.join(shared, "hash", "left_semi").select("hash", F.col("mass").cast("long"), "path", F.col("start").cast("long"), F.col("end").cast("long")))
    inner = c.select("path", F.col("hash").alias("b"), F.col("start").alias("s"), F.col("end").alias("e"))
    within = c.join(inner, "path").where("start <= s and e <= end and hash <> b").select(F.col("hash").alias("a"), "b").distinct()
    label = _groups(cut(within))
    nested = c.join(label, F.col("hash") == F.col("node")).drop("node")
    alone = c.join(label, F.col("hash") == F.col("node"), "left_anti")
    per = alone.groupBy("hash").agg(F.min_by("mass", F.struct("path", "start")).alias("mass"), F.countDistinct("path").alias("spread"))
    whole = alone.drop("mass").join(per, "hash").select("hash", "mass", "path", "start", "end", "spread", (F.col("mass") * F.col("spread")).alias("score"))

    def settle(df: pd.DataFrame) -> pd.DataFrame:
        claimed: dict[str, list[tuple[int, int]]] = {}
        out = []
        groups = sorted(df.groupby("hash"), key=lambda g: (-int(g[1]["mass"].iloc[0]), g[0]))
        for hash_, g in groups:
            free = [r for r in g.sort_values(["path", "start"]).itertuples() if not any(s <= r.start and r.end <= e for s, e in claimed.get(r.path, ()))]
            if len(free) < 2:
                continue
            spread, mass = len({r.path for r in free}), int(free[0].mass)
            for r in free:
                claimed.setdefault(r.path, []).append((r.start, r.end))
                out.append((hash_, mass, r.path, int(r.start), int(r.end), spread, mass * spread))
        return pd.DataFrame(out, columns=["hash", "mass", "path", "start", "end", "spread", "score"])

    return whole.union(nested.groupBy("group").applyInPandas(settle, "hash string, mass long, path string, start long, end long, spread long, score long"))


def _groups(edges: DataFrame) -> DataFrame:
    """(node, group) of the nodes of `edges` (a, b: string): the least node that edges reach.

    Each round takes the least label around a node and then that label's own, until none moves.
    """
    both = cut(edges.union(edges.select("b", "a")).distinct())
    label = cut(both.select(F.col("a").alias("node"), F.col("a").alias("group")).distinct())
    while True:
        around = both.join(label, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("group").alias("least"))
        least = cut(label.join(around, "node").select("node", F.col("group").alias("old"), F.least("group", "least").alias("g")))
        up = least.select(F.col("node").alias("g"), F.col("g").alias("next"))
        new = cut(least.join(up, "g").select("node", F.least("g", "next").alias("group"), "old"))
        label = new.select("node", "group")
        if new.where("group <> old").isEmpty():
            return label


def snapshot(files: DataFrame, defs: DataFrame, clusters: DataFrame, total_tokens: int, degrees: DataFrame) -> DataFrame:
    """One row of codebase metrics: loc, symbols, dup_pct, clone_clusters, mean fan-in and fan-out."""
    loc = files.agg(F.sum("loc").alias("loc"))
    per = clusters.groupBy("hash").agg(F.max("mass").alias("mass"), F.count("*").alias("sites"))
    dup = per.agg(F.round(100 * F.sum(F.col("mass") * F.col("sites")) / total_tokens, 2).alias("dup_pct"), F.count("*").alias("clone_clusters"))
    fan = degrees.agg(F.round(F.avg("fan_in"), 2).alias("mean_fan_in"), F.round(F.avg("fan_out"), 2).alias("mean_fan_out"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(loc).join(one(defs.agg(F.count("*").alias("symbols"))), "_k").join(one(dup), "_k").join(one(fan), "_k").drop("_k")
