"""Column functions and statistics against plain Python, and the golden metric fixtures."""

import fnmatch
import json
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrygraph.functions import stats as S
from quarrygraph.functions import text as T
from quarrygraph.functions import words as W
from quarrygraph.operators import aggregates as A
from quarrygraph.operators import clones as C
from quarrygraph.operators import ledger as L
from quarrygraph.operators import relational as R
from quarrygraph.operators import verify as Y
from quarrygraph.schema import LEDGER
from quarrygraph.sources import records, store


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


@given(st.text("ab*?.", max_size=8), st.text("ab.c", max_size=8))
@settings(deadline=None, max_examples=300)
def test_name_glob(pattern, name):
    assert bool(re.search(T.glob_regex(pattern), name)) == fnmatch.fnmatchcase(name, pattern)


def test_path_glob():
    m = lambda p, x: bool(re.search(T.path_glob_regex(p), x))
    assert m("**/*.rs", "a/b/c.rs") and m("**/*.rs", "c.rs") and not m("*.rs", "a/c.rs") and m("a/{b,c}/*.[ch]", "a/b/x.h") and m("a/**", "a/b/c")
    with pytest.raises(ValueError):
        T.path_glob_regex("{a")


def plain_stem(t):
    t = t.lower()
    if t in W.LEMMAS:
        return W.LEMMAS[t]
    for s in W.SUFFIXES:
        if t.endswith(s) and len(t) - len(s) >= 3:
            t = t[: -len(s)]
            break
    return t[:-1] if t.endswith("e") and len(t) > 3 else t


def test_stem_and_tokens(spark):
    words = "parsing parse parsed nodes node analysis connections organization ties sing bees e tree quickly Loggers re-use ring sees".split()
    assert column(spark, words, T.stem) == [plain_stem(w) for w in words]
    assert column(spark, ["find_nodesByKind-x", "HTTPServer2Go", None], T.decompose) == [["find", "nodes", "by", "kind"], ["httpserver2go"], None]
    assert column(spark, ["Where is the parse_file HANDLED, a?"], T.tokens) == [["parse_file"]]


def test_paths(spark):
    paths = ["src/a.rs", "x/.env.local", "a/tests/b.py", "b_test.go", "c.spec.ts", "contest/x.py", "notes.txt", "a/.main.rs.swp", "k.PEM", "Makefile", "my.credentials.json"]
    assert column(spark, paths, T.is_test_path) == [False, False, True, True, True, False, False, False, False, False, False]
    assert column(spark, paths, T.classify_path) == ["index_full", "skip:secrets", "index_full", "index_full", "index_full", "index_full", "skip:unsupported_extension", "skip:editor_swap", "skip:secrets", "skip:unsupported_extension", "skip:secrets"]
    assert column(spark, ["a.rs", "b.hxx", "c", ".py"], T.language) == ["rust", "cpp", None, None]
    places = ["a/b.log", "out/x", "a/out/x", "a/gen/x.py", "node_modules/x.js", "src/x.py"]
    assert column(spark, places, lambda c: store.ignored(c, ["*.log", "/out", "gen/", "# no"])) == [True, True, False, True, True, False]
    assert column(spark, [*places, "a/c.log"], lambda c: store.ignored(c, ["*.log", "!b.log", "!node_modules/"])) == [False, False, False, False, True, False, True]


def test_commands(spark):
    cases = {"grep -r x .": "grep", "env A=1 B=2 rg foo": "grep", "git grep x": None, "find . -name '*.rs'": "find", "find /tmp -name x": None, "find .": None, "cat src/a.rs": "cat", "cat -n x": None, "cat a > b": None, "ls": "ls", "ls -la": None, "ls /etc": None, "grepfor x": None, "A=b ls src": "ls"}
    assert column(spark, list(cases), T.classify_command) == list(cases.values())


@given(st.text("abcd", max_size=7), st.text("abcd", max_size=7))
@settings(deadline=None, max_examples=300)
def test_osa_is_symmetric_and_bounded(a, b):
    d = S.osa(a, b)
    assert d == S.osa(b, a) and abs(len(a) - len(b)) <= d <= max(len(a), len(b)) and (d == 0) == (a == b)


def test_osa_values():
    assert [S.osa(*p) for p in (("abcd", "abdc"), ("CA", "ABC"), ("kitten", "sitting"), ("", "é"))] == [1, 3, 3, 1]


def test_truncation(spark):
    texts = ["héllo wörld", "日本語", "🙂🙂", "abc", ""]
    for n in range(8):
        assert column(spark, texts, lambda c: T.truncate_utf8(c, n)) == [t.encode()[:n].decode("utf-8", "ignore") for t in texts]


def test_weights_and_buckets(spark):
    row = spark.range(1).select(
        T.edge_weight(F.lit("parse_file"), F.lit(4), F.lit(True), F.lit(False), F.lit(False)).alias("a"), T.edge_weight(F.lit("_x"), F.lit(1), F.lit(False), F.lit(True), F.lit(True)).alias("b"),
        S.log2_bucket(F.lit(0)).alias("c"), S.log2_bucket(F.lit(1024)).alias("d"), S.log2_bucket(F.lit(1 << 40)).alias("e"), S.iso_millis(F.lit("2024-01-01T00:00:01.5Z")).alias("f"), T.normal_kind(F.lit(" Record ")).alias("g"), T.normal_visibility(F.lit("pub(crate)")).alias("h")).first()
    assert row.a == 200.0 and math.isclose(row.b, 0.5) and (row.c, row.d, row.e) == (0, 10, 18) and row.f == 1704067201500 and (row.g, row.h) == ("struct", "crate")


def test_mcnemar_and_wilson(spark):
    df = spark.createDataFrame([(0, 0), (1, 5), (20, 10)], "b01 int, b10 int")
    got = [r[0] for r in df.select(S.mcnemar_p("b01", "b10")).collect()]
    assert got[0] == 1.0 and math.isclose(got[1], 14 / 64) and math.isclose(got[2], math.erfc(math.sqrt(81 / 30 / 2)))
    p, lo, hi = S.wilson(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(p, lo, hi).first()) == (0.0, 0.0, 1.0)


def test_golden_rates(spark):
    refs = spark.createDataFrame([("call", r) for r in ["exact"] * 3 + ["not_found"] * 2 + ["indeterminate"]], "kind string, resolution string")
    r = Y.hallucination_report(refs).first()
    assert (r.numerator, r.denominator, r.excluded, r.rate) == (2, 5, 1, 0.4)
    none = A.resolution_rates(spark.createDataFrame([("x", "indeterminate")], "k string, resolution string"), ["k"]).first()
    assert none.rate is None and none.grounding is None
    e = Y.edit_report(spark.createDataFrame([("a", "pass", False), ("b", "warn", False), ("c", "fail", True)], "name string, verdict string, breaks boolean")).first()
    assert math.isclose(e.edit_valid_rate, 2 / 3) and math.isclose(e.broken_caller_rate, 1 / 3)


def test_ledger(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps({"t": "task", "session_id": "s1", "ended_at": "2024-01-05T00:00:00Z", "tokens_out": 10, "lines_added": 0, "lines_removed": 0}), "", "{broken", json.dumps({"t": "other", "session_id": "s9"}), json.dumps({"t": "task", "session_id": "s1", "ended_at": "2024-01-06T00:00:00Z", "tokens_out": 30, "lines_added": 2, "lines_removed": 2}), json.dumps({"t": "snapshot", "week": "w1", "month": "2024-01", "loc": 100, "dup_pct": 1.5}), json.dumps({"t": "task", "session_id": "s2", "ended_at": "2024-02-01T00:00:00Z", "tokens_out": 7, "lines_added": 0, "lines_removed": 0})]))
    lines = records.event_lines(spark, str(tmp_path))
    tasks, snaps = L.read_events(lines, "task"), L.read_events(lines, "snapshot")
    assert tasks.schema.names == LEDGER["task"][0].names and tasks.count() == 2
    got = [tuple(r) for r in L.monthly_report(tasks, snaps).select("m", "tokens_per_diff_line", "sessions", "loc").collect()]
    assert [(m, None if t is None else float(t), s, loc) for m, t, s, loc in got] == [("2024-01", 7.5, 1, 100.0), ("2024-02", None, 1, None)]


def test_telemetry(spark):
    row = dict(schema_version=1, install_id="123e4567-e89b-42d3-a456-426614174000", version="1.2.3", os="linux", arch="x86_64", uptime_hours=3.7, cache_hit_rate=0.5, cold_walk_ms_p50=10.2, workspace_size_bucket="lt_1k", languages_indexed=["rust", "cobol"], method_counts={"grep": 3.0, "evil": 9.0}, method_latency_p50_ms={}, method_latency_p99_ms={}, error_counts={})
    schema = "schema_version int, install_id string, version string, os string, arch string, uptime_hours double, cache_hit_rate double, cold_walk_ms_p50 double, workspace_size_bucket string, languages_indexed array<string>, method_counts map<string,double>, method_latency_p50_ms map<string,double>, method_latency_p99_ms map<string,double>, error_counts map<string,double>"
    bad = row | {"install_id": "nope"}
    good, rejected = L.shape_pings(spark.createDataFrame([row, bad], schema), "salt", ["grep"], [], ["rust"])
    g = good.first()
    assert (g.method_counts, g.languages_indexed, g.uptime_hours, len(g.install_id_hash)) == ({"grep": 3}, ["rust"], 3, 64)
    assert [r.reason for r in rejected.collect()] == ["install-id-shape"]
    calls = spark.createDataFrame([("i", "grep", 3000, None), ("i", "grep", 5000, "TIMEOUT"), ("i", "find", 10, None)], "install string, method string, micros long, error string")
    r = L.roll_up(calls, ["install"]).first()
    assert r.method_counts == {"find": 1, "grep": 2} and r.method_latency_p50_ms == {"grep": 2} and r.error_counts == {"TIMEOUT": 1}


def test_clones(spark):
    rows = [("h1", 50, "a", 1, 9), ("h1", 50, "b", 1, 9), ("h2", 20, "a", 2, 4), ("h2", 20, "b", 2, 4), ("h3", 10, "a", 20, 22), ("h3", 10, "c", 5, 7), ("h4", 5, "d", 1, 2)]
    got = {(r["hash"], r.path) for r in C.maximal_clones(spark.createDataFrame(rows, "hash string, mass int, path string, start int, end int")).collect()}
    assert got == {("h1", "a"), ("h1", "b"), ("h3", "a"), ("h3", "c")}
    pair = spark.createDataFrame([("frag", 30, ("a", 1, 5), ("b", 1, 5)), ("frag", 40, ("a", 1, 5), ("a", 9, 13))], "fragment string, tokens int, first struct<name:string,start:int,end:int>, second struct<name:string,start:int,end:int>")
    r = C.pair_clusters(pair).first()
    assert (r.mass_tokens, r.spread_files, r.score, len(r.sites)) == (40, 2, 80, 3)


def test_corpora(spark):
    q = records.retrieval_corpus(spark, '[[queries]]\ntext = "a"\nexpected_top_k = ["x"]\n[[queries]]\ntext = "b"\n').collect()
    assert [r.expected for r in q] == [["x"], []]
    assert records.report(spark.createDataFrame([(1, "a")], "n int, s string"), "markdown").splitlines()[-1] == "| 1 | a |"


def test_null_parents_meet(spark):
    old = spark.createDataFrame([(None, "f", 1), ("C", "m", 2)], "parent string, name string, arity int")
    new = spark.createDataFrame([(None, "f", 2)], "parent string, name string, arity int")
    assert {(r.name, r.change) for r in R.full_diff(old, new, ["parent", "name"], "arity").collect()} == {("f", "changed"), ("m", "removed")}


def test_maximal_clones_of_a_long_chain(spark):
    """Fragments that hang together over many files are judged as one group would be."""
    rows = []
    for k in range(200):
        # h(k) lies in files k and k + 1; m(k) inside h(k) there, and once more in file k + 2.
        for p in (k, k + 1):
            rows += [("h%03d" % k, 50, "f%03d" % p, 10 * (p == k), 10 * (p == k) + 5), ("m%03d" % k, 9, "f%03d" % p, 10 * (p == k) + 1, 10 * (p == k) + 3)]
        rows += [("m%03d" % k, 9, "f%03d" % (k + 2), 100, 102)]
    got = {(r["hash"], r.path) for r in C.maximal_clones(spark.createDataFrame(rows, "hash string, mass int, path string, start int, end int")).collect()}
    assert got == {(r[0], r[2]) for r in rows if r[0][0] == "h"}
