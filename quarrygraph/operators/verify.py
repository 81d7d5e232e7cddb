"""Verification of claims about code, of proposed edits, and of what they would break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as T
from . import relational as R

FILES_PER_EDIT = 50


def candidates(targets: DataFrame, names: DataFrame, distance: Column | None = None, most: int = 4, limit: int = 5) -> DataFrame:
    """(target, name, distance, position): the nearest defined names of each target, by distance, then rank.

    Names meet targets by length first: a distance of `most` bridges no more than so many characters.
    Distance is that of the optimal string alignment, which a cheaper built-in bound precedes.
    """
    t = targets.select("target").distinct().withColumn("_n", F.char_length("target"))
    t = t.withColumn("_len", F.explode(F.sequence(F.col("_n") - most, F.col("_n") + most)))
    n = names.select("name", "rank").withColumn("_len", F.char_length("name"))
    near = t.join(n, "_len").where((F.col("target") != F.col("name")) & (F.levenshtein("target", "name", 2 * most) >= 0))
    d = near.withColumn("distance", S.osa_distance("target", "name") if distance is None else distance).where(F.col("distance") <= most)
    w = Window.partitionBy("target").orderBy("distance", F.desc("rank"), "name")
    return d.select("target", "name", "distance", "rank").withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def verify_symbols(claims: DataFrame, defs: DataFrame) -> DataFrame:
    """Claims (claim_id, name, and optional kind, file, parent) with resolution and matches.

    The qualified name is looked up first, then its last segment. One match is exact, several are
    indeterminate (ambiguous_overload), none is not_found; a stated qualifier must be the parent.
    """
    c = claims.select("claim_id", "name", *[(F.col(k) if k in claims.columns else F.lit(None).cast("string")).alias(k) for k in ("kind", "file", "parent")])
    c = c.withColumn("_bare", T.final_segment(F.col("name")))
    c = c.withColumn("_qualifier", F.when(F.col("name") != F.col("_bare"), F.element_at(F.split(F.expr("left(name, char_length(name) - char_length(_bare) - 2)"), "::"), -1)))
    d = defs.select(F.col("name").alias("_d"), F.col("kind").alias("_kind"), F.col("path").alias("_path"), F.col("parent").alias("_parent"))
    hit = c.join(d, F.col("_bare") == F.col("_d"), "left")
    ok = (
        F.col("_d").isNotNull() & (F.col("kind").isNull() | (T.normal_kind(F.col("kind")) == F.col("_kind"))) & (F.col("file").isNull() | (F.col("file") == F.col("_path")))
        & (F.col("parent").isNull() | F.coalesce(F.col("parent") == F.col("_parent"), F.lit(False)))
        & (F.col("_qualifier").isNull() | F.coalesce(F.col("_qualifier") == F.col("_parent"), F.lit(False)))
    )
    n = hit.groupBy("claim_id", "name").agg(F.count_if(ok).alias("matches"))
    resolution = F.when(F.col("matches") == 1, "exact").when(F.col("matches") == 0, "not_found").otherwise("indeterminate")
    return n.select("claim_id", "name", "matches", resolution.alias("resolution"), F.when(F.col("matches") > 1, "ambiguous_overload").alias("reason"))


def signature_diff(claims: DataFrame, shapes: DataFrame) -> DataFrame:
    """Claimed and actual signatures (claim_id, name, claimed: arity, params, returns) as issues.

    Issues: arity, unknown_param (each claimed name that isn't there), param_order (same names, other
    order) and return_shape (a claimed return that differs). A signature that can't be decided is
    indeterminate, as is an overloaded name.
    """
    one = shapes.groupBy("name").agg(F.count("*").alias("_n"), F.first("shape").alias("actual"))
    j = claims.join(one, "name", "left")
    c, a = F.col("claimed"), F.col("actual")
    issues = F.concat(
        F.when(c["arity"] != a["arity"], F.array(F.lit("arity"))).otherwise(F.array().cast("array<string>")),
        F.transform(F.array_except(F.coalesce(c["params"], F.array().cast("array<string>")), a["params"]), lambda p: F.concat(F.lit("unknown_param:"), p)),
        F.when((F.array_sort(F.array_distinct(c["params"])) == F.array_sort(F.array_distinct(a["params"]))) & (c["params"] != a["params"]), F.array(F.lit("param_order"))).otherwise(F.array().cast("array<string>")),
        F.when(c["returns"].isNotNull() & ~c["returns"].eqNullSafe(a["returns"]), F.array(F.lit("return_shape"))).otherwise(F.array().cast("array<string>")),
    )
    resolution = F.when(F.col("_n").isNull(), "not_found").when((F.col("_n") > 1) | a.isNull(), "indeterminate").otherwise("exact")
    return j.select("claim_id", "name", resolution.alias("resolution"), F.when(resolution == "exact", issues).alias("diff")).withColumn("match", F.size("diff") == 0)


def verify_locations(claims: DataFrame, defs: DataFrame) -> DataFrame:
    """Claims (claim_id, name, file, line): grounded if a definition of the name in that file spans the line; a name that isn't defined at all is not found."""
    d = defs.select(F.col("name").alias("_n"), F.col("path").alias("_p"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    hit = claims.join(d, (F.col("name") == F.col("_n")) & (F.col("file") == F.col("_p")), "left")
    inside = (F.col("_s") <= F.col("line")) & (F.col("line") <= F.col("_e"))
    return hit.groupBy("claim_id").agg(F.coalesce(F.max(inside), F.lit(False)).alias("grounded")).withColumn("resolution", F.when(F.col("grounded"), "exact").otherwise("not_found"))


def live_callers(refs: DataFrame, patched: DataFrame) -> DataFrame:
    """References from files outside the patch."""
    return refs.join(patched.select("path").distinct(), "path", "left_anti")


def verify_edit(old: DataFrame, new: DataFrame, refs: DataFrame, known: DataFrame, patched: DataFrame) -> DataFrame:
    """Findings of a proposed edit: (severity, kind, symbol, path, line).

    `old` and `new` are the definitions (parent, name, arity) of the edited files before and after,
    `refs` all call sites (callee, path, line), `known` the indexed names. A removed definition with
    live callers breaks each of them and dangles once; a changed arity breaks each live caller; a name new to the index is noted.
    """
    d = R.full_diff(old, new, ["parent", "name"], "arity").withColumn("symbol", T.qualified_name(F.col("name"), F.col("parent")))
    sites = live_callers(refs, patched).select(F.col("callee").alias("name"), "path", "line")
    finding = lambda df, sev, kind, site: df.select(F.lit(sev).alias("severity"), F.lit(kind).alias("kind"), "symbol", *((F.col("path"), F.col("line")) if site else (F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line"))))
    removed = d.where("change = 'removed'").join(sites, "name")
    changed = d.where("change = 'changed' and old_value is not null and new_value is not null").join(sites, "name")
    added = d.where("change = 'added'").join(known.select("name").distinct(), "name", "left_anti")
    return (
        finding(removed, "critical", "broken_caller", True).union(finding(removed.select("symbol").distinct(), "warning", "dangling_ref", False))
        .union(finding(changed, "critical", "signature_break", True)).union(finding(added, "info", "new_symbol", False))
        .orderBy(F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2), "symbol", "path", "line", "kind")
    )


def verdict(findings: DataFrame, skipped_files: int = 0) -> DataFrame:
    """fail if anything is critical; warn if anything is a warning or files were skipped; else pass."""
    worst = findings.agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warning").alias("warning"), F.count_if(F.col("severity") == "info").alias("info"))
    return worst.withColumn("verdict", F.when(F.col("critical") > 0, "fail").when((F.col("warning") > 0) | F.lit(skipped_files > 0), "warn").otherwise("pass"))


def would_break(callers: DataFrame, change: str, old_arity: int | None = None, new_arity: int | None = None) -> DataFrame:
    """Whether a change of a symbol breaks its callers: removal and renaming if there are any, a signature if its arity differs."""
    n = callers.agg(F.count("*").alias("callers"))
    broken = F.col("callers") > 0
    return n.withColumn("would_break", broken if change in ("remove", "rename") else broken & F.lit(old_arity != new_arity))


def gate(verdicts: DataFrame, fail_on: str = "fail") -> DataFrame:
    """Exit policy over verdicts: whether to reject, at `fail` only or at `warn` as well."""
    return verdicts.withColumn("reject", F.col("verdict").isin(*(["fail"] if fail_on == "fail" else ["fail", "warn"])))


def hallucination_report(refs: DataFrame) -> DataFrame:
    """Rates of unresolved references (kind, resolution): symbols, imports and signatures, and grounding of symbols."""
    from .aggregates import resolution_rates

    family = F.when(F.col("kind") == "import", "imports").when(F.col("kind") == "signature", "signatures").otherwise("symbols")
    return resolution_rates(refs.withColumn("family", family), ["family"])


def edit_report(edits: DataFrame) -> DataFrame:
    """Share of edit sets with the expected verdict that pass, and of those that break a caller: (name, verdict, breaks)."""
    return edits.agg(F.count("*").alias("n"), S.rate(F.count_if(F.col("verdict") != "fail"), F.count("*")).alias("edit_valid_rate"), S.rate(F.count_if(F.col("breaks")), F.count("*")).alias("broken_caller_rate"))


# Findings that mean a broken caller.
CALLER_BREAKS = ("broken_caller", "signature_break")


def evaluate_arms(patches: DataFrame, findings: DataFrame, refs: DataFrame) -> DataFrame:
    """Verification of each arm's patches: scored and skipped ones, and four rates with their counts.

    `patches` has arm, patch_id and verdict, null for an empty patch, which is skipped; `findings` has patch_id
    and kind; `refs` has patch_id, kind and resolution. Rates are valid edits (verdict pass), edits that break
    a caller, and references not found among those decided, for imports and for all other kinds.
    """
    kinds = findings.groupBy("patch_id").agg(F.collect_set("kind").alias("_kinds"))
    breaks = F.coalesce(F.arrays_overlap("_kinds", F.array(*map(F.lit, CALLER_BREAKS))), F.lit(False))
    scored = F.col("verdict").isNotNull()
    edits = patches.join(kinds, "patch_id", "left").groupBy("arm").agg(
        F.count_if(scored).alias("scored"), F.count_if(~scored).alias("skipped"), F.count_if(F.col("verdict") == "pass").alias("valid"), F.count_if(scored & breaks).alias("breaking"))
    is_import, missing, found = F.col("kind") == "import", F.col("resolution") == "not_found", F.col("resolution") == "exact"
    counts = [F.count_if(of & what).alias(f"{name}_{part}") for name, of in (("imports", is_import), ("symbols", ~is_import)) for part, what in (("missing", missing), ("decided", missing | found), ("undecided", ~(missing | found)))]
    said = refs.join(patches.where(scored).select("patch_id", "arm"), "patch_id").groupBy("arm").agg(*counts)
    both = edits.join(said, "arm", "left").na.fill(0)
    part = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return both.withColumns({
        "edit_valid_rate": part("valid", "scored"), "broken_caller_rate": part("breaking", "scored"),
        "import_rate": part("imports_missing", "imports_decided"), "symbol_rate": part("symbols_missing", "symbols_decided")})
