"""The query methods over an index: each composes operators and returns a DataFrame.

An Index holds the tables files, defs, refs and docs. Where a method has a limit, it filters and
ranks first and cuts last, in a total order; signatures and documentation join after the cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..lineage import cut
from ..operators import aggregates as A
from ..operators import graph as G
from ..operators import grep as X
from ..operators import relational as R
from ..operators import retrieval as V
from ..operators import verify as Y
from ..sources import store


@dataclass
class Index:
    files: DataFrame
    defs: DataFrame
    refs: DataFrame
    docs: DataFrame
    texts: DataFrame | None = None  # fid, text
    _ranks: DataFrame | None = None

    @classmethod
    def mount(cls, spark: SparkSession, folder: str, generation: int, texts: DataFrame | None = None) -> Index:
        return cls(**store.load(spark, folder, generation), texts=texts)

    @classmethod
    def of(cls, files: DataFrame) -> Index:
        """An index of `files` (fid, path, text), not written anywhere."""
        return cls(**store.build(files), texts=files.select("fid", "text"))

    def placed(self, df: DataFrame) -> DataFrame:
        return df.join(self.files.select("fid", "path"), "fid")

    @property
    def ranks(self) -> DataFrame:
        """(node, rank) of every defined name, computed once for this index."""
        if self._ranks is None:
            weight = T.edge_weight(F.col("callee"), F.col("n"), F.lit(False), F.col("def_count") > 5, F.lit(False))
            self._ranks = G.rank_symbols(self.refs, self.defs, weight).persist()
        return self._ranks

    def ranked(self, df: DataFrame, name: str = "name") -> DataFrame:
        return df.join(self.ranks.select(F.col("node").alias(name), "rank"), name, "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))

    def status(self) -> DataFrame:
        """Counts of the index, with the size bucket."""
        one = lambda df, n: df.agg(F.count("*").alias(n)).withColumn("_k", F.lit(1))
        x = one(self.files, "files").join(one(self.defs, "defs"), "_k").join(one(self.refs, "refs"), "_k").join(one(R.unresolved(self.refs, self.defs), "unresolved"), "_k")
        return x.drop("_k").withColumn("bucket", T.size_bucket(F.col("files")))


def find_symbol(ix: Index, name: str | None = None, pattern: str | None = None, kind: str | None = None, file: str | None = None, parent: str | None = None, doc: str | None = None, limit: int = 256, compat: bool = False) -> DataFrame:
    """Definitions by name or glob, ranked. compat=True cuts the names first, in lexical order, to 4 * limit (16384 with `doc`)."""
    found = R.find_exact(ix.defs, name) if name is not None else R.find_glob(ix.defs, pattern or "*")
    if compat and name is None:
        found = R.find_batch(found, found.select("name").distinct().orderBy("name").limit(16384 if doc else 4 * limit))
    found = R.filtered(ix.placed(found), kind=kind, path=file, parent=parent)
    if doc:
        found = R.doc_contains(R.docs_preferred(found, ix.docs), doc).drop("doc")
    cut = R.top(ix.ranked(found), limit, F.desc("rank"), F.col("path"), F.col("start"))
    return R.docs_preferred(cut, ix.docs).withColumn("qualified_name", T.qualified_name(F.col("name"), F.col("parent")))


def find_callers(ix: Index, name: str, file: str | None = None, kind: str | None = None, limit: int = 256) -> DataFrame:
    x = R.callers(ix.refs, ix.defs, ix.files, ix.ranks, name)
    return R.top(R.filtered(x, path=file, caller_kind=kind), limit, F.col("path"), F.col("start"))


def impact_of(ix: Index, name: str, depth: int = 2, nodes: int = 200, include_tests: bool = False, budget: int | None = None) -> DataFrame:
    """Callers of callers, nearest and highest ranked first. Sites that the test filter drops are not followed."""
    refs = ix.placed(ix.refs.where("caller is not null"))
    if not include_tests:
        refs = refs.where(~T.is_test_path(F.col("path")))
    e = refs.select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    anchor = ix.defs.where(F.col("name") == name).select(F.col("name").alias("node")).distinct()
    got = G.reach_back(e, anchor, depth)
    first = R.first_per(refs.select(F.col("caller").alias("node"), "path", "start", "start_line"), ["node"], "path", "start")
    got = ix.ranked(got.join(first, "node").withColumnRenamed("node", "name"))
    cut = R.top(got, nodes, F.col("depth"), F.desc("rank"), F.col("path"), F.col("start"), F.col("name"), most=10_000)
    order = [F.col("depth"), F.desc("rank"), F.col("path"), F.col("start"), F.col("name")]
    return cut if budget is None else A.budget_prefix(cut, T.token_cost(F.concat("name", "path")), budget, order)


def read_range(ix: Index, path: str, start: int, end: int, token_budget: int | None = None) -> DataFrame:
    return ix.files.where(F.col("path") == path).join(ix.texts, "fid").select("path", X.read_range(F.col("text"), start, end, token_budget).alias("text"))


def _bodies(ix: Index, defs: DataFrame, token_budget: int) -> DataFrame:
    body = F.decode(F.substring(F.encode("text", "UTF-8"), F.col("start") + 1, F.col("end") - F.col("start")), "UTF-8")
    return ix.placed(defs.join(ix.texts, "fid")).withColumn("body", T.truncate_utf8(body, 3 * token_budget)).drop("text")


def read_symbol(ix: Index, name: str, file: str | None = None, kind: str | None = None, token_budget: int = 2000) -> DataFrame:
    """The first definition of a name with its body, and its dependencies' signatures and callers as arrays within the budget."""
    d = R.first_per(R.filtered(ix.placed(R.find_exact(ix.defs, name)), path=file, kind=kind), ["name"], "path", "start").drop("path")
    deps = A.budget_prefix(dependencies(ix, name).withColumn("cost", T.token_cost(F.coalesce("signature", F.lit("")))), F.col("cost"), token_budget, [F.col("cost"), F.col("name")], keep_first=False)
    calls = find_callers(ix, name, limit=max(1, token_budget // 60))
    lists = deps.agg(F.collect_list(F.struct("name", "path", "signature")).alias("dependencies")).withColumn("_k", F.lit(1))
    sites = calls.agg(F.collect_list(F.struct("path", "start_line", "caller")).alias("callers")).withColumn("_k", F.lit(1))
    return _bodies(ix, d, token_budget).withColumn("_k", F.lit(1)).join(lists, "_k").join(sites, "_k").drop("_k")


def read_symbol_at(ix: Index, path: str, line: int, token_budget: int = 2000) -> DataFrame:
    """The innermost definition at a line, by fewest lines, then earliest start."""
    at = ix.placed(ix.defs).where((F.col("path") == path) & (F.col("start_line") <= line) & (F.col("end_line") >= line))
    inner = at.orderBy(F.col("end_line") - F.col("start_line"), "start", "name").limit(1).drop("path")
    return _bodies(ix, inner, token_budget)


def dependencies(ix: Index, name: str) -> DataFrame:
    """What a definition refers to, each by its first definition."""
    called = ix.refs.where((F.col("caller") == name) & (F.col("callee") != name)).select(F.col("callee").alias("name")).distinct()
    return R.first_per(ix.placed(R.find_batch(ix.defs, called)), ["name"], "path", "start").select("name", "path", "signature")


def outline(ix: Index, token_budget: int = 2000, glob: str | None = None, mentioned: list[str] = (), mentioned_files: list[str] = (), kinds: list[str] | None = None) -> DataFrame:
    """Files by rank with their definitions, as far as the budget goes; the first file is always there.

    Ranks are compared to 12 places, so that files of equal rank stand by path whatever order their sums had.
    """
    files = ix.files.select("fid", "path")
    homes = cut(ix.defs.groupBy("name", "fid").agg(F.count("*").alias("n")))
    names = homes.groupBy("name").agg((F.sum("n") > 5).alias("ubiquitous"))
    names = F.broadcast(names) if homes.select("name").distinct().count() <= G.FEW else names
    uses = ix.refs.groupBy(F.col("fid").alias("src"), F.col("callee").alias("name")).agg(F.count("*").alias("n"))
    liked = F.col("name").isin(list(mentioned)) if mentioned else F.lit(False)
    near = files.where(F.col("path").isin(list(mentioned_files))).select(F.col("fid").alias("src"), F.lit(True).alias("near")) if mentioned_files else None
    e = uses.join(names, "name")
    e = e.join(F.broadcast(near), "src", "left") if near is not None else e.withColumn("near", F.lit(False))
    w = T.edge_weight(F.col("name"), F.col("n"), liked, F.col("ubiquitous"), F.coalesce("near", F.lit(False)))
    uses = e.select("src", F.col("name").alias("via"), w.alias("weight"))
    want = None
    if mentioned or mentioned_files:
        by_name = ix.defs.where(liked).select(F.col("fid").alias("node")) if mentioned else None
        by_file = files.where(F.col("path").isin(list(mentioned_files))).select(F.col("fid").alias("node")) if mentioned_files else None
        both = by_name.union(by_file) if by_name is not None and by_file is not None else by_name if by_name is not None else by_file
        want = both.distinct().withColumn("weight", F.lit(100.0))
    rank = G.pagerank_through(uses, homes.select(F.col("name").alias("via"), F.col("fid").alias("dst")), files.select(F.col("fid").alias("node")), want).withColumnRenamed("node", "fid")
    d = ix.defs if kinds is None else ix.defs.where(F.col("kind").isin(kinds))
    order = F.when(F.col("visibility") == "public", 0).when(F.col("visibility") == "private", 1).otherwise(2).alias("o")
    listed = d.groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "start_line", "kind", "name", "signature"))), lambda s: F.struct(s["kind"], s["name"], s["start_line"], s["signature"])).alias("symbols"))
    x = files.join(rank, "fid").join(listed, "fid")
    if glob:
        x = x.where(T.outline_glob(F.col("path"), glob))
    entry = F.concat(F.col("path"), F.lit("\n"), F.array_join(F.transform("symbols", lambda s: F.concat(F.lit("  "), s["kind"], F.lit(" "), s["name"])), "\n"))
    return A.budget_prefix(x.withColumn("entry", entry), T.token_cost(F.col("entry")), token_budget, [F.desc(F.round("rank", 12)), F.col("path")], at_least=1)


def grep(ix: Index, text: str | None = None, regex: str | None = None, ignore_case: bool = True, multiline: bool = False, glob: str | None = None, language: str | None = None, within_symbol: str | None = None, many_defs: bool = False, limit: int = 256, structural: str | None = None, combine: str | None = None) -> DataFrame:
    """Matches with the innermost definition around each, ranked, then cut.

    A structural query (operators.grep.parse_structural) alone gives the nodes it describes, by file and
    place; with combine="intersect" a text's matches stay where they lie inside such a node.
    """
    mode = X.validate(text, regex, structural, language, combine, multiline, limit)
    files = ix.files
    if glob:
        files = files.where(F.col("path").rlike(T.path_glob_regex(glob)))
    if language:
        files = files.where(F.col("lang") == language)
    nodes = None
    if structural:
        every = ix.defs.withColumn("caller", F.lit(None).cast("string")).unionByName(
            ix.refs.select(F.col("callee").alias("name"), "fid", "start", "end", "start_line", "kind", "caller"), allowMissingColumns=True)
        nodes = X.structural_nodes(every.join(files.select("fid", "path"), "fid"), structural, ["fid", "path"])
    if mode == "structural":
        return R.top(nodes, limit, F.col("path"), F.col("start"), F.col("end"))
    p = X.literal_regex(text, ignore_case) if text else ("(?i)" + regex if ignore_case and not multiline else regex)
    hits = X.matches(files.select("fid", "path").join(ix.texts, "fid"), p, ["fid", "path"], multiline=multiline)
    if mode == "intersect":
        hits = R.within(hits, nodes, "fid", ("start", "end"), ("start", "end"))
    if within_symbol:
        spans = ix.defs.where(F.col("name") == within_symbol)
        n = spans.limit(17).count()
        if not n:
            raise X.GrepError("WITHIN_SYMBOL_NOT_FOUND", within_symbol)
        if n > 16 and not many_defs:
            raise X.GrepError("WITHIN_SYMBOL_TOO_MANY_DEFS", within_symbol)
        hits = R.within(hits, spans, "fid", ("start", "end"), ("start", "end"))
    around = R.enclosing(hits, ix.defs, "fid", "line", "start_line", "end_line", ["fid", "ordinal"], ["name", "kind"], closed=True)
    return R.top(ix.ranked(around.withColumnRenamed("enclosing_name", "name")), limit, F.desc("rank"), F.col("path"), F.col("start"))


def verify_symbol(ix: Index, claims: DataFrame) -> DataFrame:
    """Resolution of claims, with the nearest names for those not found."""
    got = Y.verify_symbols(claims, ix.placed(ix.defs))
    missing = got.where("resolution = 'not_found'").select(T.final_segment(F.col("name")).alias("target"))
    near = Y.candidates(missing, ix.ranked(ix.defs.select("name").distinct())).groupBy("target").agg(F.sort_array(F.collect_list(F.struct("position", "name", "distance"))).alias("candidates"))
    return got.join(near, T.final_segment(F.col("name")) == F.col("target"), "left").drop("target")


# Kinds of claims.
CLAIMS = ("symbol", "signature", "import", "location")
MOST_CLAIMS = 256


def verify_claims(ix: Index, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, verdict) of a batch of claims of any kind.

    `claims` has claim_id and type (of CLAIMS), and what the type uses of name, kind, file, parent, line and
    claimed (struct of arity, params, returns); an import's path is its name. Results are claim_id, type,
    resolution, grounded: null if the claim can't be decided, else whether it holds. The verdict counts those
    grounded and those decided, with their rate, null without any.
    """
    if claims.limit(MOST_CLAIMS + 1).count() > MOST_CLAIMS:
        raise ValueError(f"at most {MOST_CLAIMS} claims")
    odd = claims.where(~F.coalesce(F.col("type").isin(list(CLAIMS)), F.lit(False))).select("type").first()
    if odd:
        raise ValueError(f"unknown claim type {odd[0]!r}")
    for c, kind in (("kind", "string"), ("file", "string"), ("parent", "string"), ("line", "int"), ("claimed", "struct<arity:int,params:array<string>,returns:string>")):
        if c not in claims.columns:
            claims = claims.withColumn(c, F.lit(None).cast(kind))
    defs = ix.placed(ix.defs)
    of = lambda t: claims.where(F.col("type") == t)
    result = lambda df, t, held: df.select("claim_id", F.lit(t).alias("type"), "resolution", F.when(F.col("resolution") != "indeterminate", held).alias("grounded"))
    exact = F.col("resolution") == "exact"
    symbols = Y.verify_symbols(of("symbol"), defs)
    from ..sources.extract import extract

    wanted = of("signature").select(T.final_segment(F.col("name")).alias("name")).distinct()
    homes = ix.defs.join(wanted, "name", "left_semi").select("fid").distinct()
    shaped = extract(ix.files.join(homes, "fid", "left_semi").join(ix.texts, "fid").select("fid", "path", "text")).where("record = 'def'")
    decided = F.when(F.col("arity").isNotNull(), F.struct("arity", "params", "returns"))
    shapes = shaped.join(wanted, "name", "left_semi").select("name", decided.alias("shape"))
    signatures = Y.signature_diff(of("signature").withColumn("name", T.final_segment(F.col("name"))), shapes)
    imports = R.resolve_imports(of("import"), ix.defs, path="name")
    locations = Y.verify_locations(of("location"), defs)
    results = (
        result(symbols, "symbol", exact).union(result(signatures, "signature", exact & F.coalesce("match", F.lit(False))))
        .union(result(imports, "import", exact)).union(result(locations, "location", F.col("grounded")))
    )
    counts = results.agg(F.count_if("grounded").alias("grounded"), F.count("grounded").alias("total"))
    return results, counts.withColumn("grounding_rate", F.try_divide(F.col("grounded").cast("double"), F.col("total").cast("double")))


def verify_impact(ix: Index, name: str, change: str, old_arity: int | None = None, new_arity: int | None = None) -> DataFrame:
    return Y.would_break(R.callers(ix.refs, ix.defs, ix.files, ix.ranks, name), change, old_arity, new_arity)


def verify_edit(ix: Index, edits: DataFrame, most: int = Y.FILES_PER_EDIT) -> tuple[DataFrame, DataFrame]:
    """(findings, verdict) of proposed file contents (path, content)."""
    kept = edits.orderBy("path").limit(most)
    skipped = edits.count() - kept.count()
    old = ix.placed(ix.defs).join(kept.select("path"), "path", "left_semi")
    shape = lambda df: df.groupBy("parent", "name").agg(F.first("arity").alias("arity"))
    from ..sources.extract import extract

    fresh = extract(kept.select(F.xxhash64("path").alias("fid"), "path", F.col("content").alias("text"))).where("record = 'def'")
    before = extract(old.select("fid", "path").distinct().join(ix.texts, "fid")).where("record = 'def'")
    sites = ix.placed(ix.refs).select("callee", "path", F.col("start_line").alias("line"))
    findings = Y.verify_edit(shape(before), shape(fresh), sites, ix.defs, kept)
    return findings, Y.verdict(findings, skipped)


def verify_file(ix: Index, path: str, text: str) -> DataFrame:
    """References of a file that nothing defines."""
    from ..sources.extract import extract

    spark = ix.defs.sparkSession
    rec = extract(spark.createDataFrame([(0, path, text)], "fid int, path string, text string")).where("record = 'ref'").select(F.col("name").alias("callee"), "kind", "start_line")
    local = extract(spark.createDataFrame([(0, path, text)], "fid int, path string, text string")).where("record = 'def'").select("name")
    calls = R.unresolved(rec.where("kind <> 'import'"), ix.defs.select("name").union(local))
    imports = R.resolve_imports(rec.where("kind = 'import'"), ix.defs, path="callee").where("resolution <> 'exact'").select("callee", "kind", "start_line")
    return calls.unionByName(imports.select(*calls.columns))


def context(ix: Index, question: str, k: int = 10, token_budget: int = 2000) -> DataFrame:
    """Existing definitions that a task may reuse: lexical score, k best, cut from the tail to the budget."""
    q = F.lit(question)
    x = R.docs_preferred(ix.placed(ix.defs), ix.docs)
    s = x.withColumn("score", V.lexical_score(T.lexical_tokens(q), F.col("name"), F.coalesce("doc", F.lit("")), F.col("path"))).where("score > 0")
    best = s.withColumn("id", F.concat_ws("::", "path", "parent", "name")).orderBy(F.desc("score"), "id").limit(k)
    return A.budget_prefix(best, T.token_cost(F.coalesce("signature", "name"), 4), token_budget, [F.desc("score"), F.col("id")], keep_first=False)


def ask(ix: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """Ranked names for questions (query, text)."""
    one = R.first_per(ix.placed(ix.defs), ["name"], "path", "start")
    c = R.docs_preferred(ix.ranked(one), ix.docs).select("name", F.col("path").alias("file"), "rank", "doc", "kind", "visibility")
    return V.top_k(V.score(queries, c), k)


def latency_report(samples: DataFrame) -> DataFrame:
    return A.latency_stats(samples, ["kind"], "elapsed_micros", "ok")


def arm_report(tasks: DataFrame) -> DataFrame:
    """Outcomes, medians and tokens of each arm; an arm with several models is an error."""
    out = tasks.groupBy("arm").agg(
        F.countDistinct("model").alias("models"), F.count("*").alias("tasks"), F.count_if("success").alias("successes"), A.upper_median("wall_clock_s").alias("median_s"),
        A.upper_rank("wall_clock_s", 0.05).alias("p95_s"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    mixed: Column = F.raise_error(F.concat(F.lit("several models in arm "), F.col("arm")))
    return out.withColumn("tasks", F.when(F.col("models") > 1, mixed.cast("long")).otherwise(F.col("tasks")))
