"""Lookups, joins, set operations and limits over symbol tables.

Every operator takes its columns by name, so it runs on any tables of the same shape. Joins by span
always carry an equality (the file), which bounds what a span is compared with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def find_exact(defs: DataFrame, name: str, column: str = "name") -> DataFrame:
    return defs.where(F.col(column) == name)


def find_batch(defs: DataFrame, names: DataFrame, column: str = "name") -> DataFrame:
    """Definitions of any of the given names; the planner broadcasts the names where they are few."""
    return defs.join(names.select(column).distinct(), column, "left_semi")


def find_glob(defs: DataFrame, pattern: str, column: str = "name") -> DataFrame:
    """Definitions by name glob. A literal prefix is stated apart, so that the scan can skip by it."""
    prefix = pattern.split("*")[0].split("?")[0]
    found = defs.where(F.col(column).rlike(T.glob_regex(pattern)))
    return found.where(F.col(column).startswith(prefix)) if prefix else found


def filtered(defs: DataFrame, **equal: str | None) -> DataFrame:
    """Equality filters joined by and; a null never equals."""
    for column, value in equal.items():
        if value is not None:
            defs = defs.where(F.col(column) == value)
    return defs


def filter_counts(defs: DataFrame, condition: Column) -> DataFrame:
    """Rows before and after a filter, in one pass: tells `none` from `none left`."""
    return defs.agg(F.count("*").alias("pre_filter_count"), F.count_if(condition).alias("match_count"))


def doc_contains(df: DataFrame, needle: str, column: str = "doc") -> DataFrame:
    """Rows whose documentation contains the text in any case; rows without any go."""
    return df.where(F.lower(column).contains(needle.lower()))


def top(df: DataFrame, limit: int, *order: Column, most: int = 4096) -> DataFrame:
    """The first `limit` rows in a total order, each with `truncated`: whether there were more."""
    if not 0 < limit <= most:
        raise ValueError(f"limit must be from 1 to {most}")
    probe = df.orderBy(*order).limit(limit + 1)
    w = Window.orderBy(*order)
    ranked = probe.withColumn("_nth", F.row_number().over(w)).withColumn("truncated", F.count("*").over(Window.partitionBy()) > limit)
    return ranked.where(F.col("_nth") <= limit).drop("_nth")


def resolve(refs: DataFrame, defs: DataFrame, ref_key: str = "callee", def_key: str = "name") -> DataFrame:
    """References to a name that is defined, each once."""
    return refs.join(defs.select(F.col(def_key).alias(ref_key)).distinct(), ref_key, "left_semi")


def unresolved(refs: DataFrame, defs: DataFrame, ref_key: str = "callee", def_key: str = "name") -> DataFrame:
    """References to names without a definition."""
    return refs.join(defs.select(F.col(def_key).alias(ref_key)), ref_key, "left_anti")


def enclosing(sites: DataFrame, spans: DataFrame, by: str, at: str, start: str, end: str, key: list[str], keep: list[str], closed: bool = False) -> DataFrame:
    """Each site with the `keep` columns of the smallest span of the same `by` that holds it, null if none does.

    `key` tells sites apart. Spans are half open, or closed on both ends; of equal widths the first start wins, then the least
    of the kept columns.
    """
    s = spans.select(F.col(by).alias("_by"), F.col(start).alias("_s"), F.col(end).alias("_e"), *[F.col(k).alias(f"_{k}") for k in keep])
    inside = (F.col("_s") <= F.col(at)) & ((F.col(at) <= F.col("_e")) if closed else (F.col(at) < F.col("_e")))
    best = F.min_by(F.struct(*[F.col(f"_{k}").alias(k) for k in keep]), F.struct(F.col("_e") - F.col("_s"), "_s", *[f"_{k}" for k in keep]))
    found = sites.join(s, (F.col(by) == F.col("_by")) & inside).groupBy(*key).agg(best.alias("_span"))
    return sites.join(found, key, "left").select(*sites.columns, *[F.col(f"_span.{k}").alias(f"enclosing_{k}") for k in keep])


def within(sites: DataFrame, spans: DataFrame, by: str, at: tuple[str, str], span: tuple[str, str]) -> DataFrame:
    """Sites that lie inside any span of the same `by`, both ends included."""
    s = spans.select(F.col(by).alias("_by"), F.col(span[0]).alias("_s"), F.col(span[1]).alias("_e"))
    return sites.join(s, (F.col(by) == F.col("_by")) & (F.col("_s") <= F.col(at[0])) & (F.col(at[1]) <= F.col("_e")), "left_semi")


def first_per(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def callers(refs: DataFrame, defs: DataFrame, files: DataFrame, ranks: DataFrame, name: str) -> DataFrame:
    """Call sites of a name with their file, the enclosing definition and its rank, in file order."""
    info = first_per(defs, ["name", "fid"], "start").select(F.col("name").alias("caller"), "fid", F.col("kind").alias("caller_kind"))
    return (
        refs.where(F.col("callee") == name).join(files.select("fid", "path"), "fid").join(info, ["caller", "fid"], "left")
        .join(ranks.select(F.col("node").alias("caller"), "rank"), "caller", "left")
        .select("path", "start", "start_line", "caller", "caller_kind", F.coalesce("rank", F.lit(0.0)).alias("rank"))
        .orderBy("path", "start")
    )


def docs_preferred(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """Documentation of (name, fid): the file's own if there is one, else the first file's that has any."""
    own = docs.groupBy("name", "fid").agg(F.min("text").alias("_own"))
    any_ = docs.groupBy("name").agg(F.min_by("text", F.struct("fid", "text")).alias("_any"))
    return wanted.join(own, ["name", "fid"], "left").join(any_, "name", "left").select(*wanted.columns, F.coalesce("_own", "_any").alias("doc"))


def full_diff(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """Key, old and new value, and change (removed, added, changed or same); null keys equal null keys."""
    o = old.select(*[F.col(k).alias(f"o_{k}") for k in key], F.col(value).alias("old_value"), F.lit(True).alias("_o"))
    n = new.select(*[F.col(k).alias(f"n_{k}") for k in key], F.col(value).alias("new_value"), F.lit(True).alias("_n"))
    on = F.lit(True)
    for k in key:
        on = on & F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}"))
    change = F.when(F.col("_n").isNull(), "removed").when(F.col("_o").isNull(), "added").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "changed").otherwise("same")
    return o.join(n, on, "full_outer").select(*[F.coalesce(f"o_{k}", f"n_{k}").alias(k) for k in key], "old_value", "new_value", change.alias("change"))


def reconcile(indexed: DataFrame, disk: DataFrame, key: str = "path", version: str = "content_hash") -> DataFrame:
    """What a rescan has to do: touch new and drifted files, remove those gone; (key, op)."""
    d = full_diff(indexed, disk, [key], version)
    return d.where("change <> 'same'").select(key, F.when(F.col("change") == "removed", "removed").otherwise("touched").alias("op"))


def import_segment(path: Column) -> Column:
    """The last segment of an import path, split at : and .; null if there is none."""
    return F.try_element_at(F.filter(F.split(path, "[:.]"), lambda s: s != ""), F.lit(-1))


def resolve_imports(imports: DataFrame, names: DataFrame, path: str = "path", name: str = "name") -> DataFrame:
    """exact if the last segment is a known name; else not_found for one segment, indeterminate for several."""
    segments = F.size(F.filter(F.split(F.col(path), "[:.]"), lambda s: s != ""))
    known = names.select(F.col(name).alias("_segment")).distinct().withColumn("_known", F.lit(True))
    return (
        imports.withColumn("_segment", import_segment(F.col(path))).join(known, "_segment", "left")
        .withColumn("resolution", F.when(F.col("_known"), "exact").when(segments > 1, "indeterminate").otherwise("not_found"))
        .drop("_segment", "_known")
    )


def union_first(pools: list[DataFrame], key: str) -> DataFrame:
    """Union of candidate pools in which the first pool that has a key wins."""
    every = None
    for i, p in enumerate(pools):
        p = p.withColumn("_pool", F.lit(i))
        every = p if every is None else every.unionByName(p)
    rest = [c for c in every.columns if c not in (key, "_pool")]
    return first_per(every, [key], "_pool", *rest).drop("_pool")


def keep_last(events: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    """The last write of each key."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(s) for s in seq])
    return events.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def retained(events: DataFrame, at: str, days: int, now: Column | None = None) -> DataFrame:
    """Rows not older than `days`."""
    return events.where(F.col(at) >= (F.current_timestamp() if now is None else now) - F.make_interval(days=F.lit(days)))
