"""What the second round's findings were about."""

import random
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrygraph import catalog
from quarrygraph.operators import graph
from quarrygraph.plans import methods as M


def test_pagerank_through_names_equals_pagerank_of_the_product(spark):
    rng = random.Random(5)
    homes = {(f"n{rng.randint(0, 7)}", rng.randint(0, 29)) for _ in range(40)} | {("own", 3), ("away", 77)}
    uses = {(rng.randint(0, 29), f"n{rng.randint(0, 9)}"): float(rng.randint(1, 4)) for _ in range(90)} | {(3, "own"): 2.0, (31, "own"): 1.0, (30, "away"): 1.0, (78, "n1"): 9.0}
    product = [(s, d, w) for (s, v), w in uses.items() for x, d in homes if x == v]
    u = spark.createDataFrame([(s, v, w) for (s, v), w in uses.items()], "src long, via string, weight double")
    h, e = spark.createDataFrame(sorted(homes), "via string, dst long"), spark.createDataFrame(product, "src long, dst long, weight double")
    nodes = spark.range(33).select(F.col("id").alias("node"))
    for p in (None, spark.createDataFrame([(3, 2.0), (4, 1.0), (99, 5.0)], "node long, weight double")):
        want = {r.node: r["rank"] for r in graph.pagerank(e, nodes, p, iterations=3, tolerance=0.0).collect()}
        for most in (10**6, 0):
            got = {r.node: r["rank"] for r in graph.pagerank_through(u, h, nodes, p, 3, 0.0, most).collect()}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want), most
    assert graph.pagerank_through(u.limit(0), h.limit(0), nodes.limit(0), most=-1).count() == 0


def test_outline_does_not_write_the_product_of_users_and_homes(spark, monkeypatch):
    """3500 files that define and use one name make 12 million edges; equal ranks go by path."""
    n = 3500
    monkeypatch.setattr(graph, "pagerank", None)
    fid = spark.range(n).withColumnRenamed("id", "fid")
    files = fid.withColumn("path", F.format_string("f%05d", F.lit(n) - F.col("fid")))
    defs = fid.select(F.lit("name").alias("name"), "fid", F.lit("fn").alias("kind"), F.lit("public").alias("visibility"), F.lit(1).alias("start_line"), F.lit("s").alias("signature"))
    refs = fid.select("fid", F.lit("name").alias("callee"))
    got = M.outline(M.Index(files, defs, refs, None), token_budget=60).orderBy("position").select("path").collect()
    assert [r.path for r in got] == [f"f{i:05d}" for i in range(1, 11)]


@pytest.fixture
def same_as_sql(spark, tmp_path):
    """Whether a query gives what its SQL gives, over one table of these rows."""

    def check(name, table, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
        con = duckdb.connect()
        con.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
        want = con.sql(catalog.oracle_sql()[name])
        got = catalog.queries()[name](spark, str(tmp_path)).select(*[c[0] for c in want.description]).collect()
        want = sorted(want.fetchall(), key=repr)
        assert sorted(map(tuple, got), key=repr) == want
        return want

    return check


def test_words_of_the_lexical_query_end_at_accents(same_as_sql):
    texts = ["\u00e8quea\u00e9", "\u00e9que\u00ea", "derK\u00f6r", "der\u212a", "\u212aDer", "\u0130der", "x\u0130Der", "aThat\u00c9There", "que_der", "DER QUE", "", None, "\u5b57der\u5b57", "queue"]
    rows = [(i, t, "en", len(t or "")) for i, t in enumerate(texts)]
    got = same_as_sql("lexical_context_budget", "documents", rows, "doc_id long, text string, lang string, n_chars long")
    assert {r[0] for r in got} >= {1, 2, 7, 8, 9, 12}


def test_paths_are_classified_by_the_rules_of_the_sql(same_as_sql):
    paths = ["en/4913", "en/4913?page=2", "en/4913/", "a.py", "a.MD?x#y", "a.html5", "A.Json", ".x.md", ".md", "a.pem", "a.PEM", "a.key#top", "b.tmp", "b.tmp.1", "b~", "b.swp", ".env", "a.md\n", "a.pem\n", "a.md?x\ny", "a.md#x\ny?z", "a.md?x\ry", "a.md?x\u2028y", "a.md/", "\u00e9.xml"]
    rows = [(i, f"http://h.example.com/{p}") for i, p in enumerate(paths)] + [(100, None), (101, ""), (102, "a.md"), (103, "http://h.md")]
    got = dict(same_as_sql("classify_path", "pages", rows, "page_id long, url string"))
    assert got[0] == got[1] == "skip:unsupported_extension" and got[4] == "index_full" and got[9] == "skip:secrets" and got[12] == "skip:editor_swap"


def test_net_lines_do_not_depend_on_the_order_of_the_sum(spark, tmp_path):
    """Sums that end in 999.50, of which those of doubles fall short one way or the other."""
    rng, rows = random.Random(8), []
    while len({k for k, _ in rows}) < 10:
        cents = [rng.randint(100_000, 50_000_000) for _ in range(13)]
        cents.append(99_950 - sum(cents) % 100_000 + 100_000 * rng.randint(1, 400))
        total = 0.0
        for c in cents:  # sum() compensates
            total += c / 100
        if total < sum(cents) / 100:
            rows += [(len({k for k, _ in rows}), c / 100) for c in cents]
    spark.createDataFrame(rows, "o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.repo: r.net for r in catalog.queries()["net_lines_gate"](spark, str(tmp_path)).collect()}
    for repo in range(10):
        exact = sum(Decimal(str(p)) for k, p in rows if k == repo)
        assert got[repo] == (exact + Decimal("0.5")) // 1000 - 14 * 60
