"""Queries that SQL can't express against plain Python, and sources on awkward files."""

import math
import os
import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarrygraph import catalog
from quarrygraph.functions import stats, words
from quarrygraph.operators import clones, graph, grep
from quarrygraph.operators import retrieval as V
from quarrygraph.plans import methods as M
from quarrygraph.sources import extract, store

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain_osa(a, b):
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@needs_data
def test_near_misses(spark):
    names = sorted(set(pq.read_table(f"{DATA}/part.parquet", columns=["p_name"])["p_name"].to_pylist()))
    want = []
    for t in names:
        near = sorted((plain_osa(t, n), n) for n in names if n != t and abs(len(n) - len(t)) <= 4)
        want += [(t, n, d, k) for k, (d, n) in enumerate([x for x in near if x[0] <= 4][:5], 1)]
    got = catalog.queries()["near_miss_osa"](spark, DATA).select("target", "name", "distance", "position").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@needs_data
def test_mcnemar_p(spark):
    x = pq.read_table(f"{DATA}/labels.parquet").to_pandas()
    b01, b10 = int(((x.quality == 0) & (x.toxic == 1)).sum()), int(((x.quality == 1) & (x.toxic == 0)).sum())
    r = catalog.queries()["mcnemar_p_value"](spark, DATA).first()
    assert (r.b01, r.b10) == (b01, b10)
    pairs = [(b01, b10), (0, 0), (3, 9), (12, 12), (12, 13), (40, 10)]
    got = [r.p for r in spark.createDataFrame(pairs, "a long, b long").coalesce(1).select(stats.mcnemar_p("a", "b").alias("p")).collect()]
    for (a, b), p in zip(pairs, got):
        n = a + b
        tail = sum(math.comb(n, i) for i in range(min(a, b) + 1)) / 2**n if n else 1
        # Two tails of the normal distribution by steps, where there are many pairs.
        z = (abs(a - b) - 1) / math.sqrt(n) if n else 0
        area = 2 * sum(math.exp(-((z + (k + 0.5) * 1e-3) ** 2) / 2) for k in range(12_000)) * 1e-3 / math.sqrt(2 * math.pi)
        assert abs(p - (1 if not n else min(1, 2 * tail) if n < 25 else area)) < 1e-6


@needs_data
def test_maximal_clones(spark):
    docs = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "source", "text"]).to_pandas()
    import hashlib

    sites = {}
    for d, s, text in docs.itertuples(index=False):
        for i, line in enumerate((text or "").split("\n")):
            if len(line) >= 40:
                sites.setdefault(hashlib.md5(line.encode()).hexdigest(), []).append((len(line), f"{s}/{d}" if s is not None else str(d), i, i))
    want = plain_cover(sites)
    got = catalog.queries()["clone_maximal"](spark, DATA).select("hash", "path", "start", "end", "spread").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def plain_cover(sites):
    out, claimed = [], {}
    for h, at in sorted(sites.items(), key=lambda x: (-x[1][0][0], x[0])):
        at = sorted(set(at))
        if len({(p, a) for _, p, a, _ in at}) < 2:
            continue
        free = [(p, a, b) for _, p, a, b in at if not any(s <= a and b <= e for s, e in claimed.get(p, ()))]
        if len(free) < 2:
            continue
        for p, a, b in free:
            claimed.setdefault(p, []).append((a, b))
            out.append((h, p, a, b, len({x[0] for x in free})))
    return out


def test_maximal_clones_of_nested_fragments(spark):
    rng = random.Random(3)
    sites = {}
    for f in range(30):
        path = f"f{f % 7}"
        for k in range(12):
            a = rng.randint(0, 40)
            size = rng.choice([2, 5, 11, 20])
            sites.setdefault(f"h{size}-{k % 5}", set()).add((size, path, a, a + size))
    rows = [(h, m, p, a, b) for h, s in sites.items() for m, p, a, b in s]
    got = clones.maximal_clones(spark.createDataFrame(rows, "hash string, mass long, path string, start long, end long")).select("hash", "path", "start", "end", "spread").collect()
    assert sorted(map(tuple, got)) == sorted(plain_cover({h: list(s) for h, s in sites.items()}))


def stem(w):
    w = w.lower()
    if w in words.LEMMAS:
        return words.LEMMAS[w]
    for s in words.SUFFIXES:
        if w.endswith(s) and len(w) - len(s) >= 3:
            return w[: -len(s)]
    return w


def test_semantic_scores(spark):
    """Scores of names by the rules one by one, on names whose parts and stems are plain."""
    names = ["red_ring", "blue_ring", "ring", "open_red_door", "plate", "ringplate", "door_mat"]
    cand = spark.createDataFrame([(n, f"src/{n[:3]}.rs", 0.25 * i, None, "fn" if i % 2 else "struct", "public" if i < 3 else "private") for i, n in enumerate(names)], "name string, file string, rank double, doc string, kind string, visibility string")
    q = spark.createDataFrame([("a", "red ring"), ("b", "which door struct")], "query string, text string")
    got = {(r["query"], r["name"]): r.score for r in V.score(q, cand).collect()}
    parts = {n: n.split("_") for n in names}
    df = {}
    for n in names:
        for p in set(parts[n]):
            df[p] = df.get(p, 0) + 1
    idf = lambda t: math.log((len(names) + 1) / (df.get(t, 0) + 1)) + 1
    for query, tokens in (("a", ["red", "ring"]), ("b", ["door", "struct"])):
        for i, n in enumerate(names):
            gain, nth, touched = 0.0, 0, False
            for t in tokens:
                file = f"src/{n[:3]}.rs"
                if n == t:
                    gain += (1.0 if t in words.COMMON_NOUNS else 10.0) * idf(t)
                elif t in parts[n]:
                    gain += (6.0 / 2**nth if len(parts[n]) >= 4 else 6.0) * idf(t)
                    nth += 1
                elif t in n:
                    gain += 3.0 * idf(t)
                if t in file:
                    gain += idf(t)
                touched |= t in n or t in file
            if not touched:
                assert (query, n) not in got
                continue
            kind = "fn" if i % 2 else "struct"
            factor = (1.15 if i < 3 else 1.0) * math.prod(1.6 for h, kinds in words.KIND_HINTS.items() if h in tokens and kind in kinds)
            assert abs(got[query, n] - (0.25 * i + gain) * factor) < 1e-9, (query, n)


def test_pagerank_by_joins_and_in_one_task(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 30), rng.randint(0, 30), float(rng.randint(1, 4))) for _ in range(120)]
    e = spark.createDataFrame(edges, "src long, dst long, weight double")
    nodes = spark.range(32).select(F.col("id").alias("node"))
    liked = spark.createDataFrame([(3, 2.0), (4, 1.0), (99, 5.0)], "node long, weight double")
    for p in (None, liked):
        one, many = ({r.node: r["rank"] for r in graph.pagerank(e, nodes, p, iterations=6, tolerance=0.0, alone=n).collect()} for n in (10**6, 0))
        rank, n = {i: 1 / 32 for i in range(32)}, 32
        w = {}
        for s, d, x in edges:
            if s != d:
                w[s, d] = w.get((s, d), 0) + x
        out = {s: sum(x for (a, _), x in w.items() if a == s) for s in range(n)}
        t = {i: 1 / n for i in range(n)} if p is None else {i: {3: 2 / 3, 4: 1 / 3}.get(i, 0.0) for i in range(n)}
        for _ in range(6):
            loose = sum(r for i, r in rank.items() if not out[i])
            rank = {i: (0.15 + 0.85 * loose) * t[i] + 0.85 * sum(rank[s] * x / out[s] for (s, d), x in w.items() if d == i) for i in range(n)}
        assert all(abs(one[i] - rank[i]) < 1e-9 and abs(many[i] - rank[i]) < 1e-9 for i in range(n))
    assert graph.pagerank(e.limit(0), nodes.limit(0)).count() == 0


def test_matches_against_re(spark):
    texts = ["aa bb\ncc aé🙂 aa", "", "no", "\n\nxx yy\nzz", "a" * 50, None, "x\x00x aa"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for pattern in (r"(\w)\1", r"\w+|$", r"(a+)(b*)", r"[^ ]+"):
        want = []
        for k, t in enumerate(texts):
            t = t or ""
            n = 0
            for m in re.finditer(pattern, t, re.ASCII):
                if m[0]:
                    n += 1
                    at = len(t[: m.start()].encode())
                    line = t[: m.start()].count("\n")
                    want.append((k, n, m[0], at, at + len(m[0].encode()), line + 1, t.split("\n")[line]))
        got = grep.matches(df, pattern, ["k"]).collect()
        assert sorted(map(tuple, got)) == want, pattern


def test_texts_that_contain(spark):
    texts = [(1, "we saw the quick brown fox run"), (2, "brown foxes"), (3, "a-b"), (4, None), (5, "the quick brownfox")]
    needles = [(10, "quick brown fox"), (11, "brown fo"), (12, "a-b"), (13, "-"), (14, None), (15, "quick brown"), (16, "zebra crossing here")]
    got = V.containing(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(needles, "item_id long, text string"), "doc_id", "item_id")
    assert sorted(map(tuple, got.collect())) == sorted((i, d) for i, n in needles for d, t in texts if n is not None and t is not None and n in t)


def test_scan_of_awkward_files(spark, tmp_path):
    files = {"src/a.py": b"def f(x):\n    return x\n", "src/latin.py": "def g():\n    return 'é'\n".encode("latin-1"), "src/big.py": b"def h(): pass\n" + b"#" * extract.OVERSIZE, "gen/b.py": b"def k(): pass\n", "gen/keep.py": b"def m(): pass\n", "node_modules/c.py": b"x = 1\n"}
    for path, data in files.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(data)
    scan = store.scan_tree(spark, str(tmp_path), ["# made", "gen/*", "!gen/keep.py"])
    got = {r.path: r for r in scan.collect()}
    assert set(got) == {"src/a.py", "src/latin.py", "src/big.py", "gen/keep.py"}
    ix = M.Index.of(scan)
    info = {r.path: r for r in ix.files.collect()}
    import hashlib

    assert all(info[p].content_hash == hashlib.sha256(files[p]).hexdigest() and info[p].mtime_ns for p in info)
    assert [(p, info[p].parse_status, info[p].oversize) for p in sorted(info)] == [("gen/keep.py", "ok", False), ("src/a.py", "ok", False), ("src/big.py", "partial", True), ("src/latin.py", "partial", False)]
    assert {r["name"] for r in ix.defs.collect()} == {"f", "g", "m"}
    folder = str(tmp_path / "index")
    tables = {n: getattr(ix, n) for n in store.TABLES}
    store.write(tables, folder, 3)
    assert store.load(spark, folder, 3)["defs"].count() == 3
    import shutil

    shutil.copytree(f"{folder}/generation=3", f"{folder}/generation=4")
    shutil.rmtree(f"{folder}/generation=4/_ready_")
    with pytest.raises(ValueError):
        store.load(spark, folder, 4)


@pytest.fixture(scope="module")
def code(spark):
    files = [(0, "a.py", "class Box:\n    def get_lid(self, n: int) -> int:\n        return helper(n)\n    def set_lid(self, n): self.n = n\n\ndef helper(a, b=1):\n    return a\n\ndef get_all():\n    return helper(2)\n"), (1, "b.go", "package main\n\nfunc Run(n int) int { return helper(n, 1) }\n")]
    return M.Index.of(spark.createDataFrame(files, "fid int, path string, text string"))


def test_structural_search(code):
    found = lambda q, **kw: [(r.path, {k: v for k, v in r.captures.items()}) for r in M.grep(code, structural=q, language="python", **kw).collect()]
    assert found("(fn name: @n parent: @p)") == [("a.py", {"n": ["get_lid"], "p": ["Box"]}), ("a.py", {"n": ["set_lid"], "p": ["Box"]})]
    assert found('(_ name: @n signature: @s) @d (#match? @n "^get_") (#not-eq? @n "get_all")')[0][1]["n"] == ["get_lid"]
    assert [c["n"] for _, c in found('(call name: @n caller: @c) (#any-of? @c "get_all" "none")')] == [["helper"]]
    assert found("(fn name: @n) (#is? public)", limit=1)[0][1] == {"n": ["get_lid"]}
    assert M.grep(code, structural="(fn name: @n)", language="python", limit=1).first().truncated
    hits = M.grep(code, text="helper", structural='(fn name: @n) (#eq? @n "get_lid")', language="python", combine="intersect").collect()
    assert [(r.path, r.line, r.match) for r in hits] == [("a.py", 3, "helper")]
    for bad, error in (("(fn", "INVALID_STRUCTURAL"), ("(fn size: @n)", "INVALID_STRUCTURAL"), ("(fn name: @n) (#near? @n \"x\")", "UNKNOWN_PREDICATE"), ("(fn name: @n) (#eq? @m \"x\")", "INVALID_PREDICATE")):
        with pytest.raises(grep.GrepError) as e:
            grep.parse_structural(bad)
        assert e.value.code == error


def test_claims_of_all_kinds(code, spark):
    rows = [
        (1, "symbol", "helper", None, None, None), (2, "symbol", "nothing", None, None, None), (3, "signature", "helper", None, None, (2, ["a", "b"], None)),
        (4, "signature", "Box::get_lid", None, None, (2, ["n", "m"], None)), (5, "import", "pkg.helper", None, None, None), (6, "import", "os.path", None, None, None),
        (7, "location", "helper", "a.py", 6, None), (8, "location", "helper", "a.py", 1, None), (9, "import", "absent", None, None, None),
    ]
    claims = spark.createDataFrame(rows, "claim_id long, type string, name string, file string, line int, claimed struct<arity:int,params:array<string>,returns:string>")
    results, verdict = M.verify_claims(code, claims)
    got = {r.claim_id: (r.type, r.grounded) for r in results.collect()}
    assert got == {1: ("symbol", True), 2: ("symbol", False), 3: ("signature", True), 4: ("signature", False), 5: ("import", True), 6: ("import", None), 7: ("location", True), 8: ("location", False), 9: ("import", False)}
    assert tuple(verdict.first()) == (4, 8, 0.5)
    empty, none = M.verify_claims(code, claims.limit(0))
    assert empty.count() == 0 and tuple(none.first()) == (0, 0, None)
    with pytest.raises(ValueError):
        M.verify_claims(code, claims.withColumn("type", F.lit("guess")))
    with pytest.raises(ValueError):
        M.verify_claims(code, spark.range(257).select(F.col("id").alias("claim_id"), F.lit("symbol").alias("type"), F.lit("x").alias("name")))


def test_columns_and_highlights(spark):
    df = spark.createDataFrame([("say foo foo",), ("none",), (None,)], "line string")
    got = [tuple(r) for r in df.select(grep.column_of(F.col("line"), "foo"), grep.highlighted(F.col("line"), "foo", "<", ">")).collect()]
    assert got == [(5, "say <foo> foo"), (0, "none"), (None, None)]
