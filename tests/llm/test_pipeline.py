"""The stages on small documents: each on what its predecessor kept, and the whole."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_operators import PASSAGE, TEXTS, plain_quality, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    clean = [(100 + i, words(120)) for i in range(8)]
    rows = [*TEXTS, *clean, (200, clean[0][1]), (201, clean[1][1] + "  "), (202, clean[2][1] + " " + words(3)), (203, words(40) + " " + PASSAGE), (204, words(40) + " " + PASSAGE)]
    d = str(tmp_path_factory.mktemp("sf"))
    df = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], SCHEMA).select("*", F.lit(1).alias("_row"), F.lit(2).alias("group")).repartition(3)
    df.write.parquet(f"{d}/documents.parquet")
    return d


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    rules = {(r.doc_id, r.text) for r in kept["quality_rules"].collect()}
    assert all((i, t) not in rules for i, t in TEXTS if plain_quality(t)[5])
    assert {100 + i for i in range(8)} <= {i for i, _ in rules}
    exact = [r.doc_id for r in kept["exact_dedup"].collect()]
    assert 200 not in exact and 100 in exact and 201 in exact and 101 not in exact
    near = [r.doc_id for r in kept["simhash_near_dedup"].collect()]
    assert (102 in near) != (202 in near) and ({7, 8, 9, 10} & set(near)) and len({7, 8, 9, 10} & set(near)) == 1
    assert set(range(103, 108)) <= set(near)
    text = {r.doc_id: r for r in kept["suffix_array_dedup"].collect()}
    assert sum(PASSAGE in r.text for r in text.values()) == 1 and all(r.n_chars == len(r.text) for r in text.values())
    packed = kept["best_fit_packing"]
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(text)
    assert corpus_pipeline.run(spark, folder).count() == packed.count()
    assert before.count() == len(text)


def test_empty_and_null(spark):
    docs = spark.createDataFrame([], SCHEMA)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0)], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
        assert stage(spark, odd, "").count() <= 3


def test_odd_rows_by_stage(spark):
    """Rows that are equal in all columns leave one; a null text is an empty one; what no rule speaks against stays."""
    clean = words(120)
    rows = [(None, clean, None, None, None), (None, clean, None, None, None), (5, None, "en", None, None), (5, None, "en", None, None), (6, "", None, "s", 0), (7, words(100), None, None, None)]
    odd = spark.createDataFrame(rows, SCHEMA).repartition(2)
    stage = dict(corpus_pipeline.STAGES)
    got = lambda name: sorted(((r.doc_id, r.text) for r in stage[name](spark, odd, "").collect()), key=repr)
    rest = rows[5][1]
    assert got("quality_rules") == sorted([(None, clean), (None, clean), (7, rest)], key=repr)
    assert got("exact_dedup") == sorted([(None, clean), (5, None), (7, rest)], key=repr)
    near = got("simhash_near_dedup")
    assert len(near) == 3 and (None, clean) in near and (7, rest) in near
    assert got("suffix_array_dedup") == sorted([(None, clean), (None, clean), (5, ""), (5, ""), (6, ""), (7, rest)], key=repr)
    assert stage["best_fit_packing"](spark, odd, "").count() == 6


def test_rows_dropped_do_not_depend_on_splits(spark, folder, monkeypatch):
    """Files are split anew between the jobs of a stage; each row is judged as before."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    docs.repartition(1).sortWithinPartitions("doc_id").write.option("parquet.block.size", 4096).mode("overwrite").parquet(f"{folder}/one")
    want = {}
    for name in ("exact_dedup", "simhash_near_dedup"):
        want[name] = sorted(map(tuple, dict(corpus_pipeline.STAGES)[name](spark, docs, "").collect()), key=repr)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    sizes = iter(["2k", "128m", "512", "64m", "1k"] * 200)
    plain = corpus_pipeline.cut

    def cut(df):
        out = plain(df)
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
        return out

    from quarrygraph.llm import common, exact_dedup, simhash

    for module in (corpus_pipeline, common, exact_dedup, simhash):
        monkeypatch.setattr(module, "cut", cut)
    try:
        for name in want:
            spark.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
            got = dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"{folder}/one"), "")
            assert sorted(map(tuple, got.collect()), key=repr) == want[name]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None
