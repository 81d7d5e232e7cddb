"""The query methods over an index of the test tables, each with its SQL.

Suppliers are files, and parts are definitions, each in the first file that delivers it; parts that
follow each other in an order are call sites in the first part's file. Calls of a name serve as its
rank, so that orders are exact. The first files hold most definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions import words as W
from .operators import aggregates as A
from .operators import graph as G
from .operators import ledger as L
from .operators import relational as R
from .operators import verify as Y
from .plans import methods as M
from .registry import query, read

ANCHOR = "hot_anvil_12"

INDEX = """home AS (SELECT l_partkey AS k, min(l_suppkey) AS fid FROM lineitem GROUP BY 1),
files AS (SELECT s_suppkey AS fid, CASE WHEN s_suppkey % 7 = 6 THEN 'tests/' ELSE 'src/' END || s_name || '.py' AS path, repeat(substr(s_name, 10, 9) || chr(10), 120) AS text FROM supplier),
named AS (SELECT p_partkey AS k, replace(p_name, ' ', '_') || '_' || substr(p_brand, 7) AS name FROM part),
defs AS (SELECT name, fid, (p_partkey % 100) * 10 AS start, (p_partkey % 100 + p_size % 7 + 1) * 10 - 1 AS "end", p_partkey % 100 + 1 AS start_line, p_partkey % 100 + 1 + p_size % 7 AS end_line,
  CASE p_size % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'private' ELSE 'unknown' END AS visibility, lower(p_type) AS kind, p_brand AS parent, 'def ' || name || '()' AS signature
  FROM part JOIN named ON p_partkey = named.k JOIN home ON p_partkey = home.k),
b AS (SELECT l_orderkey, l_linenumber, l_suppkey AS fid, l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem),
refs AS (SELECT d.name AS callee, fid, l_orderkey * 10 + l_linenumber AS start, l_linenumber AS start_line, s.name AS caller FROM b JOIN named s ON src = s.k JOIN named d ON dst = d.k),
docs AS (SELECT defs.name, fid, 'Doc of ' || kind || ' ' || start_line AS text FROM defs WHERE visibility = 'public'),
ranks AS (SELECT callee AS name, CAST(count(*) AS DOUBLE) AS rank FROM refs GROUP BY 1),
own AS (SELECT name, fid, min(text) AS text FROM docs GROUP BY 1, 2), any_doc AS (SELECT name, arg_min(text, ROW(fid, text)) AS text FROM docs GROUP BY 1)"""


def _index(spark: SparkSession, d: str) -> M.Index:
    li, part, supplier = (read(spark, d, t) for t in ("lineitem", "part", "supplier"))
    number = F.substring("s_name", 10, 9)
    place = F.concat(F.when(F.col("s_suppkey") % 7 == 6, "tests/").otherwise("src/"), "s_name", F.lit(".py"))
    files = supplier.select(F.col("s_suppkey").alias("fid"), place.alias("path"), F.lit("python").alias("lang"))
    texts = supplier.select(F.col("s_suppkey").alias("fid"), F.repeat(F.concat(number, F.lit("\n")), F.lit(120)).alias("text"))
    named = part.select("*", F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), F.substring("p_brand", 7, 9)).alias("name"))
    line, more = F.col("p_partkey") % 100, F.col("p_size") % 7
    defs = named.join(li.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("fid")), "p_partkey").select(
        "name", "fid", (line * 10).alias("start"), ((line + more + 1) * 10 - 1).alias("end"), (line + 1).alias("start_line"), (line + 1 + more).alias("end_line"),
        F.when(F.col("p_size") % 3 == 0, "public").when(F.col("p_size") % 3 == 1, "private").otherwise("unknown").alias("visibility"),
        F.lower("p_type").alias("kind"), F.col("p_brand").alias("parent"), F.concat(F.lit("def "), "name", F.lit("()")).alias("signature"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    sites = li.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("fid"), F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where("dst is not null")
    name = lambda at, to: named.select(F.col("p_partkey").alias(at), F.col("name").alias(to))
    refs = sites.join(name("src", "caller"), "src").join(name("dst", "callee"), "dst").select(
        "callee", "fid", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("start"), (F.col("l_orderkey") * 10 + F.col("l_linenumber") + 1).alias("end"),
        F.col("l_linenumber").alias("start_line"), F.lit("call").alias("kind"), "caller")
    docs = defs.where("visibility = 'public'").select("name", "fid", F.concat(F.lit("Doc of "), "kind", F.lit(" "), "start_line").alias("text"))
    ranks = refs.groupBy(F.col("callee").alias("node")).agg(F.count("*").cast("double").alias("rank"))
    return M.Index(files, defs, refs, docs, texts, ranks)


@query(f"""WITH {INDEX}, f AS (SELECT defs.*, path, coalesce(rank, 0) AS rank FROM defs JOIN files USING (fid) LEFT JOIN ranks USING (name) WHERE name LIKE 'hot\\_%' ESCAPE '\\' AND kind = 'promo')
SELECT f.name, kind, path, start, rank, parent || '::' || f.name AS qualified_name, coalesce(own.text, any_doc.text) AS doc, (SELECT count(*) FROM f) > 40 AS truncated
FROM f LEFT JOIN own ON own.name = f.name AND own.fid = f.fid LEFT JOIN any_doc ON any_doc.name = f.name ORDER BY rank DESC, path, start, f.name LIMIT 40""")
def method_find_symbol(spark, d):
    return M.find_symbol(_index(spark, d), pattern="hot_*", kind="promo", limit=40).select("name", "kind", "path", "start", "rank", "qualified_name", "doc", "truncated")


@query(f"""WITH {INDEX}, f AS (SELECT DISTINCT defs.name, defs.fid, path, start FROM defs JOIN files USING (fid) LEFT JOIN own ON own.name = defs.name AND own.fid = defs.fid LEFT JOIN any_doc ON any_doc.name = defs.name
WHERE starts_with(defs.name, 'hot_a') AND contains(lower(coalesce(own.text, any_doc.text)), 'of promo')) SELECT name, path, start FROM f""")
def method_find_symbol_doc(spark, d):
    return M.find_symbol(_index(spark, d), pattern="hot_a*", doc="OF Promo", limit=4096).select("name", "path", "start").distinct()


CALLERS = f"""{INDEX}, info AS (SELECT name, fid, kind, row_number() OVER (PARTITION BY name, fid ORDER BY start) AS n FROM defs),
c AS (SELECT path, refs.start, start_line, caller, kind AS caller_kind, coalesce(rank, 0) AS rank FROM refs JOIN files USING (fid) LEFT JOIN info ON caller = info.name AND refs.fid = info.fid AND n = 1 LEFT JOIN ranks ON caller = ranks.name WHERE callee = '{ANCHOR}')"""


@query(f"WITH {CALLERS} SELECT path, start, start_line, caller, caller_kind, rank, (SELECT count(*) FROM c) > 100 AS truncated FROM c ORDER BY path, start LIMIT 100")
def method_find_callers(spark, d):
    return M.find_callers(_index(spark, d), ANCHOR, limit=100)


@query(f"WITH {CALLERS} SELECT count(*) AS callers, count(*) > 0 AS would_break FROM c")
def method_verify_impact(spark, d):
    return M.verify_impact(_index(spark, d), ANCHOR, "remove")


@query(f"""WITH {INDEX}, r AS (SELECT refs.*, path FROM refs JOIN files USING (fid) WHERE path NOT LIKE 'tests/%'), one AS (SELECT DISTINCT caller FROM r WHERE callee = '{ANCHOR}' AND caller <> callee),
two AS (SELECT DISTINCT r.caller FROM r JOIN one ON r.callee = one.caller WHERE r.caller <> r.callee), n AS (SELECT caller AS name, min(depth) AS depth FROM (SELECT caller, 1 AS depth FROM one UNION ALL SELECT caller, 2 FROM two) WHERE caller <> '{ANCHOR}' GROUP BY 1),
f AS (SELECT caller AS name, path, start, start_line, row_number() OVER (PARTITION BY caller ORDER BY path, start) AS nth FROM r),
x AS (SELECT n.name, depth, coalesce(rank, 0) AS rank, path, start, start_line FROM n JOIN f ON f.name = n.name AND nth = 1 LEFT JOIN ranks ON ranks.name = n.name)
SELECT *, (SELECT count(*) FROM x) > 150 AS truncated FROM x ORDER BY depth, rank DESC, path, start, name LIMIT 150""")
def method_impact(spark, d):
    return M.impact_of(_index(spark, d), ANCHOR, nodes=150).select("name", "depth", "rank", "path", "start", "start_line", "truncated")


@query(f"""WITH {INDEX}, d AS (SELECT defs.*, path, text, row_number() OVER (PARTITION BY name ORDER BY path, start) AS nth FROM defs JOIN files USING (fid)),
called AS (SELECT DISTINCT callee AS name FROM refs WHERE caller = '{ANCHOR}' AND callee <> caller), dep AS (SELECT name, signature, CAST(ceil(strlen(signature) / 3.0) AS BIGINT) AS cost FROM d JOIN called USING (name) WHERE nth = 1),
cut AS (SELECT name, sum(cost) OVER (ORDER BY cost, name ROWS UNBOUNDED PRECEDING) AS run FROM dep), sites AS (SELECT path, refs.start FROM refs JOIN files USING (fid) WHERE callee = '{ANCHOR}' ORDER BY path, refs.start LIMIT 1)
SELECT name, path, substr(text, start + 1, least("end" - start, 180)) AS body, (SELECT string_agg(name, ',' ORDER BY name) FROM cut WHERE run <= 60) AS dependencies, (SELECT string_agg(path, ',') FROM sites) AS callers FROM d WHERE name = '{ANCHOR}' AND nth = 1""")
def method_read_symbol(spark, d):
    x = M.read_symbol(_index(spark, d), ANCHOR, token_budget=60)
    listed = lambda c, f: F.array_join(F.sort_array(F.transform(c, lambda s: s[f])), ",").alias(c)
    return x.select("name", "path", "body", listed("dependencies", "name"), listed("callers", "path"))


AT = """SELECT defs.*, path, text FROM defs JOIN files USING (fid) WHERE path = 'src/Supplier#000000001.py' AND start_line <= 20 AND end_line >= 20"""


@query(f"WITH {INDEX}, x AS ({AT} ORDER BY end_line - start_line, start, name LIMIT 1) SELECT name, start_line, end_line, path, substr(text, start + 1, \"end\" - start) AS body FROM x")
def method_read_symbol_at(spark, d):
    return M.read_symbol_at(_index(spark, d), "src/Supplier#000000001.py", 20).select("name", "start_line", "end_line", "path", "body")


@query(f"""WITH {INDEX}, m AS (SELECT fid, path, i AS line, (i - 1) * 10 + 7 AS start FROM files, range(1, 121) r(i) WHERE substr(text, 8, 2) = '03'),
a AS (SELECT m.fid, line, defs.name, kind, row_number() OVER (PARTITION BY m.fid, line ORDER BY end_line - start_line, start_line, defs.name, kind) AS n FROM m JOIN defs ON m.fid = defs.fid AND start_line <= line AND line <= end_line),
x AS (SELECT path, m.start, m.line, '03' AS "match", a.name, a.kind AS enclosing_kind, coalesce(rank, 0) AS rank FROM m LEFT JOIN a ON a.fid = m.fid AND a.line = m.line AND n = 1 LEFT JOIN ranks ON ranks.name = a.name)
SELECT *, (SELECT count(*) FROM x) > 100 AS truncated FROM x ORDER BY rank DESC, path, start LIMIT 100""")
def method_grep(spark, d):
    return M.grep(_index(spark, d), regex="03$", ignore_case=False, multiline=True, limit=100).select("path", "start", "line", "match", "name", "enclosing_kind", "rank", "truncated")


@query(f"""WITH {INDEX}, l AS (SELECT fid, path, i AS line, (i - 1) * 10 AS start FROM files, range(1, 121) r(i)),
x AS (SELECT path, start, line FROM l WHERE EXISTS (SELECT 1 FROM defs WHERE name = '{ANCHOR}' AND defs.fid = l.fid AND defs.start <= l.start AND l.start + 9 <= "end")) SELECT * FROM x""")
def method_grep_within(spark, d):
    return M.grep(_index(spark, d), regex="[0-9]{9}", limit=4096, within_symbol=ANCHOR, many_defs=True).select("path", "start", "line")


@query(f"""WITH {INDEX}, c AS (SELECT o_orderkey AS claim_id, CASE o_orderkey % 3 WHEN 0 THEN 'Brand#' || o_custkey % 25 || '::' ELSE '' END || n.name AS name, CASE WHEN o_orderkey % 4 = 0 THEN 'src/Supplier#000000000.py' END AS file,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Brand#' || o_custkey % 25 END AS qualifier, n.name AS bare FROM orders JOIN named n ON o_custkey = n.k),
m AS (SELECT claim_id, c.name, count(defs.name) FILTER (WHERE (c.file IS NULL OR c.file = path) AND (qualifier IS NULL OR qualifier = parent)) AS matches FROM c LEFT JOIN (defs JOIN files USING (fid)) ON defs.name = bare GROUP BY 1, 2)
SELECT claim_id, name, matches, CASE matches WHEN 0 THEN 'not_found' WHEN 1 THEN 'exact' ELSE 'indeterminate' END AS resolution, CASE WHEN matches > 1 THEN 'ambiguous_overload' END AS reason FROM m""")
def method_verify_symbols(spark, d):
    ix = _index(spark, d)
    named = read(spark, d, "part").select(F.col("p_partkey").alias("o_custkey"), F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), F.substring("p_brand", 7, 9)).alias("bare"))
    qualifier = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Brand#"), F.col("o_custkey") % 25))
    claims = read(spark, d, "orders").join(named, "o_custkey").select(
        F.col("o_orderkey").alias("claim_id"), F.concat_ws("::", qualifier, "bare").alias("name"), F.when(F.col("o_orderkey") % 4 == 0, "src/Supplier#000000000.py").alias("file"))
    return Y.verify_symbols(claims, ix.placed(ix.defs))


@query(f"""WITH {INDEX}, c AS (SELECT o_orderkey AS claim_id, n.name, 'src/Supplier#' || lpad(CAST(o_orderkey % 5 AS VARCHAR), 9, '0') || '.py' AS file, o_custkey % 100 + 1 AS line FROM orders JOIN named n ON o_custkey = n.k)
SELECT claim_id, coalesce(bool_or(start_line <= line AND line <= end_line), false) AS grounded, CASE WHEN coalesce(bool_or(start_line <= line AND line <= end_line), false) THEN 'exact' ELSE 'not_found' END AS resolution
FROM c LEFT JOIN (defs JOIN files USING (fid)) x ON x.name = c.name AND path = file GROUP BY 1""")
def method_verify_locations(spark, d):
    ix = _index(spark, d)
    named = read(spark, d, "part").select(F.col("p_partkey").alias("o_custkey"), F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), F.substring("p_brand", 7, 9)).alias("name"))
    file = F.concat(F.lit("src/Supplier#"), F.lpad((F.col("o_orderkey") % 5).cast("string"), 9, "0"), F.lit(".py"))
    claims = read(spark, d, "orders").join(named, "o_custkey").select(F.col("o_orderkey").alias("claim_id"), "name", file.alias("file"), (F.col("o_custkey") % 100 + 1).alias("line"))
    return Y.verify_locations(claims, ix.placed(ix.defs))


def _shape_sql(keep: str) -> str:
    return f"SELECT p_brand AS parent, named.name, min(p_size % 5) AS arity FROM part JOIN named ON p_partkey = named.k WHERE {keep} GROUP BY 1, 2"


@query(f"""WITH {INDEX}, o AS ({_shape_sql("p_size <= 45")}), w AS ({_shape_sql("p_size > 5")}), site AS (SELECT callee AS name, path, start_line AS line FROM refs JOIN files USING (fid) WHERE path NOT LIKE 'src/%1.py'),
x AS (SELECT coalesce(o.parent, w.parent) || '::' || coalesce(o.name, w.name) AS symbol, coalesce(o.name, w.name) AS name, o.arity AS a, w.arity AS b, o.name IS NOT NULL AS was, w.name IS NOT NULL AS now FROM o FULL JOIN w ON o.parent = w.parent AND o.name = w.name),
f AS (SELECT 'critical' AS severity, 'broken_caller' AS kind, symbol, path, line FROM x JOIN site USING (name) WHERE was AND NOT now UNION ALL SELECT DISTINCT 'warning', 'dangling_ref', symbol, NULL, NULL FROM x JOIN site USING (name) WHERE was AND NOT now
UNION ALL SELECT 'critical', 'signature_break', symbol, path, line FROM x JOIN site USING (name) WHERE was AND now AND a <> b UNION ALL SELECT 'info', 'new_symbol', symbol, NULL, NULL FROM x WHERE now AND NOT was AND name NOT IN (SELECT name FROM defs WHERE kind = 'small'))
SELECT * FROM f""")
def method_verify_edit(spark, d):
    ix = _index(spark, d)
    name = F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), F.substring("p_brand", 7, 9)).alias("name")
    shape = lambda keep: read(spark, d, "part").where(keep).groupBy(F.col("p_brand").alias("parent"), name).agg(F.min(F.col("p_size") % 5).alias("arity"))
    sites = ix.placed(ix.refs).select("callee", "path", F.col("start_line").alias("line"))
    patched = ix.files.where(F.col("path").startswith("src/") & F.col("path").endswith("1.py"))
    return Y.verify_edit(shape("p_size <= 45"), shape("p_size > 5"), sites, ix.defs.where("kind = 'small'"), patched)


@query(f"""WITH {INDEX}, t AS (SELECT DISTINCT defs.name, path, parent, signature, CASE WHEN contains('_' || defs.name || '_', '_red_') THEN 1.0 ELSE 0.0 END + CASE WHEN contains('_' || defs.name || '_', '_widget_') THEN 1.0 ELSE 0.0 END
  + CASE WHEN regexp_matches(lower(coalesce(own.text, any_doc.text, '')), '\\bpromo\\b') THEN 0.6 ELSE 0.0 END + CASE WHEN starts_with(path, 'tests/') THEN 0.3 ELSE 0.0 END AS points
  FROM defs JOIN files USING (fid) LEFT JOIN own ON own.name = defs.name AND own.fid = defs.fid LEFT JOIN any_doc ON any_doc.name = defs.name),
s AS (SELECT *, round(points / 4, 6) AS score, path || '::' || parent || '::' || name AS id, row_number() OVER (ORDER BY points DESC, path || '::' || parent || '::' || name) AS nth FROM t WHERE points > 0),
r AS (SELECT name, path, score, CAST(sum(CAST(ceil(strlen(signature) / 4.0) AS BIGINT)) OVER (ORDER BY nth) AS BIGINT) AS running_cost FROM s WHERE nth <= 10) SELECT * FROM r WHERE running_cost <= 40""")
def method_context(spark, d):
    ix = _index(spark, d)
    ix.defs = ix.defs.dropDuplicates(["name", "fid"])
    return M.context(ix, "red widget promo tests", 10, 40).select("name", "path", F.round("score", 6).alias("score"), "running_cost")


def _rank_steps(k: int, e: str, nodes: str) -> str:
    """CTEs r0 to rk: PageRank of `nodes` (node) over `e` (src, dst, weight), `k` rounds from equal ranks."""
    steps = [f"e AS MATERIALIZED ({e}), nodes AS MATERIALIZED ({nodes}), o AS MATERIALIZED (SELECT src, sum(weight) AS out FROM e GROUP BY src), n AS MATERIALIZED (SELECT count(*) AS n FROM nodes), r0 AS MATERIALIZED (SELECT node, 1.0 / n AS rank FROM nodes, n)"]
    for i in range(k):
        steps.append(f"""r{i + 1} AS MATERIALIZED (SELECT nodes.node, (0.15 + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE node NOT IN (SELECT src FROM o))) / n + 0.85 * coalesce(m.s, 0) AS rank
FROM nodes CROSS JOIN n LEFT JOIN (SELECT e.dst AS node, sum(r.rank * e.weight / o.out) AS s FROM e JOIN o ON e.src = o.src JOIN r{i} r ON r.node = e.src GROUP BY e.dst) m ON m.node = nodes.node)""")
    return ",\n".join(steps)


_SYMBOLS = """SELECT caller AS src, callee AS dst, sqrt(CAST(count(*) AS DOUBLE)) * 10 * CASE WHEN any_value(c) > 5 THEN 0.1 ELSE 1 END AS weight FROM refs JOIN (SELECT name, count(*) AS c FROM defs GROUP BY 1) ON name = callee
WHERE caller <> callee AND caller IN (SELECT name FROM defs) AND strlen(callee) >= 8 GROUP BY 1, 2 UNION ALL
SELECT caller, callee, sqrt(CAST(count(*) AS DOUBLE)) * CASE WHEN any_value(c) > 5 THEN 0.1 ELSE 1 END FROM refs JOIN (SELECT name, count(*) AS c FROM defs GROUP BY 1) ON name = callee
WHERE caller <> callee AND caller IN (SELECT name FROM defs) AND strlen(callee) < 8 GROUP BY 1, 2"""


@query(f"WITH {INDEX}, {_rank_steps(8, _SYMBOLS, 'SELECT DISTINCT name AS node FROM defs')} SELECT node, round(rank, 8) AS rank FROM r8")
def method_symbol_ranks(spark, d):
    ix = _index(spark, d)
    weight = T.edge_weight(F.col("callee"), F.col("n"), F.lit(False), F.col("def_count") > 5, F.lit(False))
    return G.rank_symbols(ix.refs, ix.defs, weight, iterations=8, tolerance=0.0).select("node", F.round("rank", 8).alias("rank"))


_FILES = """SELECT src, dst, sum(sqrt(CAST(n AS DOUBLE)) * CASE WHEN strlen(name) >= 8 THEN 10 ELSE 1 END * CASE WHEN c > 5 THEN 0.1 ELSE 1 END) AS weight FROM (SELECT fid AS src, callee AS name, count(*) AS n FROM refs GROUP BY 1, 2)
JOIN (SELECT DISTINCT name, fid AS dst FROM defs) USING (name) JOIN (SELECT name, count(*) AS c FROM defs GROUP BY 1) USING (name) WHERE src <> dst GROUP BY 1, 2"""


@query(f"""WITH {INDEX}, {_rank_steps(60, _FILES, 'SELECT fid AS node FROM files')},
x AS (SELECT path, rank, path || chr(10) || string_agg('  ' || kind || ' ' || name, chr(10) ORDER BY CASE visibility WHEN 'public' THEN 0 WHEN 'private' THEN 1 ELSE 2 END, start_line, kind, name, signature) AS entry FROM defs JOIN files USING (fid) JOIN r60 ON node = fid GROUP BY fid, path, rank),
c AS (SELECT path, entry, CAST(sum(CAST(ceil(strlen(entry) / 3.0) AS BIGINT)) OVER w AS BIGINT) AS running_cost, row_number() OVER w AS position FROM x WINDOW w AS (ORDER BY round(rank, 12) DESC, path ROWS UNBOUNDED PRECEDING))
SELECT path, md5(entry) AS entry, running_cost, position FROM c WHERE running_cost <= 9000 OR position = 1""")
def method_outline(spark, d):
    x = M.outline(_index(spark, d), token_budget=9000)
    return x.select("path", F.md5("entry").alias("entry"), "running_cost", F.col("position").cast("long").alias("position"))


@query("""WITH r AS (SELECT CASE WHEN lang = 'en' THEN 'imports' WHEN lang = 'fr' THEN 'signatures' ELSE 'symbols' END AS family, CASE WHEN quality IS NULL THEN 'indeterminate' WHEN quality = 1 THEN 'exact' ELSE 'not_found' END AS res FROM documents LEFT JOIN labels USING (doc_id))
SELECT family, count(*) FILTER (WHERE res = 'not_found') AS numerator, count(*) FILTER (WHERE res <> 'indeterminate') AS denominator, count(*) FILTER (WHERE res = 'indeterminate') AS excluded,
round(count(*) FILTER (WHERE res = 'not_found') * 1.0 / nullif(count(*) FILTER (WHERE res <> 'indeterminate'), 0), 6) AS rate FROM r GROUP BY 1""")
def hallucination_report(spark, d):
    kind = F.when(F.col("lang") == "en", "import").when(F.col("lang") == "fr", "signature").otherwise("call")
    res = F.when(F.col("quality").isNull(), "indeterminate").when(F.col("quality") == 1, "exact").otherwise("not_found")
    x = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left").select(kind.alias("kind"), res.alias("resolution"))
    return Y.hallucination_report(x).select("family", "numerator", "denominator", "excluded", F.round("rate", 6).alias("rate"))


@query("""SELECT count(*) AS n, round(count(*) FILTER (WHERE o_orderstatus <> 'F') * 1.0 / count(*), 6) AS edit_valid_rate, round(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') * 1.0 / count(*), 6) AS broken_caller_rate FROM orders""")
def edit_report(spark, d):
    verdict = F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "P", "warn").otherwise("pass")
    x = Y.edit_report(read(spark, d, "orders").select(F.col("o_orderkey").alias("name"), verdict.alias("verdict"), (F.col("o_orderpriority") == "1-URGENT").alias("breaks")))
    return x.select("n", *[F.round(c, 6).alias(c) for c in ("edit_valid_rate", "broken_caller_rate")])


@query("""WITH p AS (SELECT doc_id, source AS arm, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'fail' ELSE 'pass' END AS verdict FROM documents),
f AS (SELECT DISTINCT o_custkey AS doc_id FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'P'),
e AS (SELECT arm, count(verdict) AS scored, count(*) - count(verdict) AS skipped, count(*) FILTER (WHERE verdict = 'pass') AS valid, count(*) FILTER (WHERE verdict IS NOT NULL AND doc_id IN (SELECT doc_id FROM f)) AS breaking FROM p GROUP BY 1),
r AS (SELECT arm, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0) AS im, count(*) FILTER (WHERE o_orderstatus <> 'P' AND o_orderkey % 3 = 0) AS i, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS ia,
  count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderkey % 3 > 0) AS sm, count(*) FILTER (WHERE o_orderstatus <> 'P' AND o_orderkey % 3 > 0) AS s, count(*) FILTER (WHERE o_orderkey % 3 > 0) AS sa FROM orders JOIN p ON o_custkey = doc_id AND verdict IS NOT NULL GROUP BY 1)
SELECT e.*, coalesce(im, 0) AS imports_missing, coalesce(i, 0) AS imports_decided, coalesce(ia - i, 0) AS imports_undecided, coalesce(sm, 0) AS symbols_missing, coalesce(s, 0) AS symbols_decided, coalesce(sa - s, 0) AS symbols_undecided,
round(valid * 1.0 / nullif(scored, 0), 6) AS edit_valid_rate, round(breaking * 1.0 / nullif(scored, 0), 6) AS broken_caller_rate, round(im * 1.0 / nullif(i, 0), 6) AS import_rate, round(sm * 1.0 / nullif(s, 0), 6) AS symbol_rate FROM e LEFT JOIN r USING (arm)""")
def verify_by_arm(spark, d):
    verdict = F.when(F.col("doc_id") % 5 == 1, "fail").when(F.col("doc_id") % 5 > 1, "pass")
    patches = read(spark, d, "documents").select(F.col("doc_id").alias("patch_id"), F.col("source").alias("arm"), verdict.alias("verdict"))
    o = read(spark, d, "orders").withColumnRenamed("o_custkey", "patch_id")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "broken_caller").when(F.col("o_orderpriority") == "2-HIGH", "signature_break").otherwise("new_symbol")
    resolution = F.when(F.col("o_orderstatus") == "F", "not_found").when(F.col("o_orderstatus") == "O", "exact").otherwise("indeterminate")
    refs = o.select("patch_id", F.when(F.col("o_orderkey") % 3 == 0, "import").otherwise("call").alias("kind"), resolution.alias("resolution"))
    x = Y.evaluate_arms(patches, o.where("o_orderstatus = 'P'").select("patch_id", kind.alias("kind")), refs)
    return x.select(*[F.round(c, 6).alias(c) if c.endswith("_rate") else c for c in x.columns])


#: Shell commands with the class that each must get.
COMMANDS = [("grep -rn foo src", "grep"), ("FOO=1 rg bar", "grep"), ("git grep x", None), ("find . -name '*.py'", "find"), ("find /tmp -name x", None), ("cat src/a.py", "cat"), ("cat > out.txt", None), ("ls src", "ls"), ("ls -la", None), ("make test", None)]
_PICK = "CASE event_id % 10 " + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, c) in enumerate(COMMANDS) if c) + " END"
_USES = f"""u AS (SELECT user_id AS session, event_id AS place, epoch_us(ts) // 1000 AS ms, CASE event_type WHEN 'click' THEN 'Bash' WHEN 'view' THEN 'kg__find' WHEN 'signup' THEN 'kg__grep' ELSE event_type END AS name, CASE WHEN event_type = 'click' THEN {_PICK} END AS class FROM events)"""


def _uses(spark, d):
    command = F.element_at(F.array(*[F.lit(c) for c, _ in COMMANDS]), (F.col("event_id") % 10 + 1).cast("int"))
    name = F.when(F.col("event_type") == "click", "Bash").when(F.col("event_type") == "view", "kg__find").when(F.col("event_type") == "signup", "kg__grep").otherwise(F.col("event_type"))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return read(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("place"), at.alias("timestamp"), name.alias("name"), command.alias("command"))


@query(f"""WITH {_USES} SELECT session, count(*) AS calls, count(*) FILTER (WHERE name LIKE 'kg%') AS own_calls, count(*) FILTER (WHERE class = 'grep') AS grep_commands, count(*) FILTER (WHERE class = 'find') AS find_commands, count(*) FILTER (WHERE class = 'cat') AS cat_commands,
count(*) FILTER (WHERE class = 'ls') AS ls_commands, count(class) AS commands, round(count(*) FILTER (WHERE name LIKE 'kg%') * 1.0 / nullif(count(*) FILTER (WHERE name LIKE 'kg%') + count(class), 0), 6) AS ratio, max(ms) - min(ms) AS duration_ms FROM u GROUP BY 1""")
def tool_sessions(spark, d):
    return L.tool_report(_uses(spark, d), "kg__")[0].withColumn("ratio", F.round("ratio", 6))


@query(f"WITH {_USES} SELECT session, CASE WHEN name LIKE 'kg%' THEN 'kg__*' ELSE name END AS tool, count(*) AS calls FROM u GROUP BY 1, 2")
def tool_buckets(spark, d):
    return L.tool_report(_uses(spark, d), "kg__")[1]


@query(f"WITH {_USES}, r AS (SELECT session, place, class, row_number() OVER (PARTITION BY session ORDER BY place) AS n FROM u WHERE class IS NOT NULL) SELECT session, place, class FROM r WHERE n <= 500")
def tool_details(spark, d):
    return L.tool_report(_uses(spark, d), "kg__")[2].select("session", "place", "class")


@query("""SELECT doc_id, CASE WHEN strlen(text) <= 60 THEN text ELSE left(text, list_max(list_filter(range(0, 61), lambda k: strlen(left(text, k)) <= 60))) || '…' END AS head FROM documents""")
def truncated_text(spark, d):
    return read(spark, d, "documents").select("doc_id", T.truncate_utf8(F.col("text"), 60, "…").alias("head"))


_STEM = "CASE " + " ".join(f"WHEN ends_with(w, '{s}') AND strlen(w) - {len(s)} >= 3 THEN left(w, length(w) - {len(s)})" for s in W.SUFFIXES) + " ELSE w END"
_LEMMA = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in W.LEMMAS.items()) + " END"


@query(f"""WITH t AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM documents)
SELECT w AS word, coalesce({_LEMMA}, regexp_replace({_STEM}, '^(.{{3,}})e$', '\\1')) AS stem FROM t""")
def word_stems(spark, d):
    t = read(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select(F.lower("w").alias("word")).distinct()
    return t.select("word", T.stem(F.col("word")).alias("stem"))
