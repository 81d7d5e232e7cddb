"""Micro-workspaces: extraction, lookups, callers, impact, outline, edits and streaming."""

import pytest
from pyspark.sql import functions as F

from quarrygraph.operators import relational as R
from quarrygraph.operators import verify as Y
from quarrygraph.plans import methods as M
from quarrygraph.sources import extract, store
from quarrygraph.streaming import events as E

FILES = {
    "src/hub.py": "def hub_compute(x, y):\n    \"\"\"Adds the hub's numbers.\"\"\"\n    return x + y\n",
    **{f"src/caller_{c}.py": f"from hub import hub_compute\n\ndef run_{c}():\n    return hub_compute(1, 2)\n" for c in "abcd"},
    "src/top.py": "def top_a():\n    return run_a() + run_b()\n\nclass Box:\n    LIMIT = 3\n    def lid(self, n: int) -> int:\n        return missing_name(n)\n",
    "tests/test_hub.py": "def test_it():\n    assert hub_compute(1, 1) == 2\n",
    "docs/guide.md": "# Guide\n\nIntro text.\n\n## Setup\n\nHow to set up.\n\n```\n# not a heading\n```\n\nUsage\n=====\n",
    "lib/shape.rs": "/// A box.\npub struct Shape { w: u32 }\nimpl Shape {\n    pub fn area(&self, k: u32) -> u32 { helper(k, 2) }\n}\nfn helper(a: u32, b: u32) -> u32 { a * b }\n",
    "lib/main.go": "package main\n\nfunc Run(n int) int { return helper(n, 1) }\n\ntype Store interface { Get() }\n",
    "web/app.ts": "export class App { start(port: number) { listen(port); } }\nfunction listen(p: number) { new Server(p); }\n",
    "c/util.c": "int add(int a, int b) {\n  return a + b;\n}\n",
}


@pytest.fixture(scope="module")
def ix(spark):
    rows = [(i, p, t) for i, (p, t) in enumerate(FILES.items())]
    x = M.Index.of(spark.createDataFrame(rows, "fid int, path string, text string").repartition(2))
    for n in ("files", "defs", "refs", "docs"):
        setattr(x, n, getattr(x, n).cache())
    return x


def names(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_extraction(ix):
    got = {(r.path, r.name): r for r in ix.placed(ix.defs).collect()}
    assert got["src/hub.py", "hub_compute"].kind == "fn" and got["src/hub.py", "hub_compute"].end_line == 3
    assert got["src/top.py", "lid"].parent == "Box" and got["src/top.py", "LIMIT"].kind == "const"
    assert got["lib/shape.rs", "area"].kind == "method" and got["lib/shape.rs", "area"].parent == "Shape"
    assert got["lib/shape.rs", "helper"].visibility == "private" and got["lib/shape.rs", "area"].visibility == "public"
    assert got["lib/main.go", "Run"].visibility == "public" and got["lib/main.go", "Store"].kind == "trait"
    assert got["web/app.ts", "start"].parent == "App" and got["web/app.ts", "listen"].kind == "fn"
    assert got["c/util.c", "add"].kind == "fn"
    assert {n for p, n in got if p == "docs/guide.md"} == {"Guide", "Setup", "Usage"}
    docs = {(r.name): r.text for r in ix.docs.collect()}
    assert docs["Setup"] == "Guide > Setup\n\nHow to set up." and docs["Shape"] == "A box."
    refs = {(r.path, r.callee, r.caller) for r in ix.placed(ix.refs).collect()}
    assert ("lib/shape.rs", "helper", "area") in refs and ("web/app.ts", "Server", "listen") in refs
    assert ("c/util.c", "a", None) in refs or ("c/util.c", "a", "add") in refs  # identifiers, all at byte 0


def test_shapes():
    d = {x.name: x for x in extract.parse(FILES["lib/shape.rs"], "rust").defs}
    assert (d["area"].arity, d["area"].params, d["area"].returns) == (1, ["k"], "u32") and d["helper"].arity == 2
    p = {x.name: x for x in extract.parse("def f(self, a, *rest): pass\nclass C:\n  def m(self, a, b=1): g(a, *b)\n", "python").defs}
    assert p["f"].arity is None and p["m"].arity == 2
    assert extract.parse("def broken(:\n", "python").status == "partial"
    assert extract.mask('a = "x // y" // z\nb', "//").split("\n")[0].strip() == "a ="


def test_lookup_and_rank(ix):
    top = names(M.find_symbol(ix, pattern="*", kind="fn", limit=3), "name")
    assert top[0] == ("hub_compute",)
    assert names(M.find_symbol(ix, pattern="run_?", limit=2).orderBy("name"), "truncated")[0] == (True,)
    assert names(M.find_symbol(ix, name="hub_compute"), "doc") == [("Adds the hub's numbers.",)]
    assert names(M.find_symbol(ix, pattern="*", doc="HUB"), "name") == [("hub_compute",)]
    assert M.find_symbol(ix, pattern="r*", compat=True).count() == 4
    with pytest.raises(ValueError):
        M.find_symbol(ix, name="x", limit=0)


def test_callers_and_impact(ix):
    assert names(M.find_callers(ix, "hub_compute"), "caller") == [("run_a",), ("run_b",), ("run_c",), ("run_d",), ("test_it",)]
    got = {(r.name, r.depth) for r in M.impact_of(ix, "hub_compute").collect()}
    assert got == {("run_a", 1), ("run_b", 1), ("run_c", 1), ("run_d", 1), ("top_a", 2)}
    assert ("test_it", 1) in {(r.name, r.depth) for r in M.impact_of(ix, "hub_compute", depth=1, include_tests=True).collect()}
    assert names(R.unresolved(ix.refs.where("callee = 'missing_name'"), ix.defs), "caller") == [("lid",)]


def test_reading_and_outline(ix):
    assert names(M.read_range(ix, "src/hub.py", 1, 1), "text") == [("def hub_compute(x, y):",)]
    r = M.read_symbol(ix, "run_a").first()
    assert r.body.startswith("def run_a") and r.dependencies[0].name == "hub_compute" and r.callers[0].caller == "top_a"
    assert names(M.read_symbol_at(ix, "src/top.py", 7), "name") == [("lid",)]
    o = M.outline(ix, token_budget=10_000).collect()
    assert min(o, key=lambda r: -r["rank"]).path == "src/hub.py"
    assert len(M.outline(ix, token_budget=1).collect()) == 1
    assert {r.path for r in M.outline(ix, token_budget=10_000, glob="src/**/*.py").collect()} == {p for p in FILES if p.startswith("src/")}
    assert M.outline(ix, 10_000, mentioned=["area"]).count() > 0


def test_grep(ix):
    got = M.grep(ix, text="HUB_compute").collect()
    assert len(got) == 2 * 4 + 2 and {r.name for r in got} >= {"hub_compute", "run_a"}
    assert M.grep(ix, text="HUB_compute", ignore_case=False).count() == 0
    hit = M.grep(ix, regex=r"return \w+\(1", glob="src/caller_a.py").first()
    assert FILES["src/caller_a.py"].encode()[hit.start : hit.end].decode() == hit.match and hit.line == 4
    assert M.grep(ix, text="hub_compute", within_symbol="run_a").count() == 1
    assert M.grep(ix, regex=r"^def run_a.*?\)$", multiline=True).first().match.endswith("(1, 2)")
    for bad in ({"text": "a", "regex": "b"}, {}, {"regex": "("}, {"regex": "(a+)+"}, {"text": "a", "multiline": True}, {"text": "a", "within_symbol": "nope"}):
        with pytest.raises(ValueError):
            M.grep(ix, **bad)


def test_verification(ix, spark):
    claims = spark.createDataFrame([(1, "hub_compute"), (2, "hub_compite"), (3, "Box::lid"), (4, "App::lid"), (5, "helper")], "claim_id int, name string")
    got = {r.claim_id: r for r in M.verify_symbol(ix, claims).collect()}
    assert [got[i].resolution for i in range(1, 6)] == ["exact", "not_found", "exact", "not_found", "exact"]
    assert got[2].candidates[0].name == "hub_compute"
    sig = spark.createDataFrame([(1, "f", (2, ["b", "a"], "int")), (2, "g", (1, ["z"], None)), (3, "h", (0, [], None))], "claim_id int, name string, claimed struct<arity:int,params:array<string>,returns:string>")
    shapes = spark.createDataFrame([("f", (2, ["a", "b"], "str")), ("g", (2, ["x", "y"], None)), ("h", None)], "name string, shape struct<arity:int,params:array<string>,returns:string>")
    d = {r.claim_id: r for r in Y.signature_diff(sig, shapes).collect()}
    assert d[1]["diff"] == ["param_order", "return_shape"] and d[2]["diff"] == ["arity", "unknown_param:z"] and d[3].resolution == "indeterminate"
    edits = spark.createDataFrame([("src/hub.py", "def hub_compute(x):\n    return x\n\ndef brand_new():\n    pass\n")], "path string, content string")
    findings, verdict = M.verify_edit(ix, edits)
    kinds = [r.kind for r in findings.collect()]
    assert kinds.count("signature_break") == 5 and "new_symbol" in kinds and verdict.first().verdict == "fail"
    gone, v = M.verify_edit(ix, spark.createDataFrame([("src/hub.py", "")], "path string, content string"))
    kinds = [r.kind for r in gone.collect()]
    assert kinds.count("broken_caller") == 5 and kinds.count("dangling_ref") == 1
    assert Y.gate(v, "warn").first().reject
    assert M.verify_impact(ix, "hub_compute", "remove").first().would_break and not M.verify_impact(ix, "hub_compute", "signature", 2, 2).first().would_break
    assert {r.callee for r in M.verify_file(ix, "x.py", "import hub_compute\nimport os.nothing\nhub_compute(1)\nghost(2)\n").collect()} == {"ghost", "os.nothing"}


def test_context_and_questions(ix, spark):
    assert M.context(ix, "compute the hub").first().name == "hub_compute"
    q = spark.createDataFrame([("q1", "who computes the hub?"), ("q2", "box type")], "query string, text string")
    got = {(r["query"], r.position): r.name for r in M.ask(ix, q).collect()}
    assert got["q1", 1] == "hub_compute" and got["q2", 1] == "Box"
    assert ix.status().first().files == len(FILES)


def test_snapshots_and_stream(ix, spark, tmp_path):
    base = spark.createDataFrame([(0, "a.py", "def a():\n    later()\n"), (1, "b.py", "def b():\n    a()\n")], "fid int, path string, text string").withColumn("fid", F.xxhash64("path"))
    folder = str(tmp_path / "index")
    store.write(store.build(base), folder, 0)
    assert store.unresolved_count(store.load(spark, folder, 0)).first()[0] == 1
    ev = tmp_path / "events"
    ev.mkdir()
    (ev / "1.json").write_text('{"seq":1,"op":"removed","path":"c.py"}\n{"seq":2,"op":"touched","path":"c.py","text":"def later():\\n    pass\\n"}\n{"seq":3,"op":"touched","path":"b.py","text":"x"}\n{"seq":4,"op":"removed","path":"b.py"}\n')
    q = E.maintain(E.file_events(spark, str(ev)), folder, str(tmp_path / "cp"), {"availableNow": True})
    q.awaitTermination()
    t = store.load(spark, folder, 1)
    assert sorted(r.path for r in t["files"].collect()) == ["a.py", "c.py"]
    assert store.unresolved_count(t).first()[0] == 0
    again = E.reconcile(t, base.where("path = 'a.py'"))
    assert [r.path for r in again["files"].collect()] == ["a.py"]


def test_deltas_are_what_a_rewrite_gives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "COMPACT_AFTER", 3)
    folder, files = str(tmp_path / "index"), {f"{c}.py": f"def {c}():\n    later()\n" for c in "abcd"}
    table = lambda d: spark.createDataFrame([*d.items()], "path string, text string").select(F.xxhash64("path").alias("fid"), "path", "text")
    store.write(store.build(table(files)), folder, 0)
    steps = [({"a.py": "def a1(): pass\n"}, ["b.py"]), ({"b.py": "def b2(): pass\n", "e.py": "def e(): a1()\n"}, []), ({"a.py": ""}, ["c.py", "no.py"]), ({"c.py": "def c4(): e()\n"}, ["d.py"]), ({}, ["a.py"])]
    for g, (changed, removed) in enumerate(steps, 1):
        files = {p: t for p, t in (files | changed).items() if p not in removed}
        gone = spark.createDataFrame([(p,) for p in [*changed, *removed]], "path string").select(F.xxhash64("path").alias("fid"))
        for _ in range(2 if g == 2 else 1):  # a replayed batch writes its generation again
            store.write_delta(store.build(table(changed)), gone, folder, g)
        got, want = store.load(spark, folder, g), store.build(table(files))
        for n in store.TABLES:
            assert sorted(map(repr, got[n].collect())) == sorted(map(repr, want[n].collect())), (g, n)
    assert [store._marker(spark, folder, g) for g in range(6)] == [0, 0, 0, 0, 4, 4]
    with pytest.raises(ValueError, match="not complete"):
        store.load(spark, folder, 9)


def test_stream_counters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"method":"grep","micros":3}\n{"method":"grep","micros":900,"error":"late"}\n{"method":"find","micros":0}\n{"micros":5}\n')
    calls = spark.readStream.schema("method STRING, micros BIGINT, error STRING").json(str(tmp_path / "in"))
    for name, df in (("counters", E.rolling_counters(calls)), ("buckets", E.rolling_histogram(calls))):
        df.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("counters").collect()} == {("grep", 2, 1), ("find", 1, 0), (None, 1, 0)}
    assert {tuple(r) for r in spark.table("buckets").collect()} == {("grep", 1, 1), ("grep", 9, 1), ("find", 0, 1), (None, 2, 1)}


def test_late_references(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "name STRING, record STRING, fid BIGINT, start INT"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    (src / "1.json").write_text('{"name":"f","record":"ref","fid":1,"start":5}\n{"name":"g","record":"ref","fid":1,"start":9}\n')
    (src / "2.json").write_text('{"name":"f","record":"def","fid":2,"start":0}\n')
    import os

    os.utime(src / "1.json", (1, 1))
    q = E.late_references(stream, None).writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("late").collect()] == [("f", 1, 5)]


def test_impact_counts_all_callers(spark):
    calls = "\n".join(["def hub():", "    pass", "", "def user():", *["    hub()"] * 4200]) + "\n"
    ix = M.Index.of(spark.createDataFrame([(1, "a.py", calls)], "fid long, path string, text string"))
    n = ix.refs.where("callee = 'hub'").count()
    assert n == 4200 == M.verify_impact(ix, "hub", "remove").first().callers
