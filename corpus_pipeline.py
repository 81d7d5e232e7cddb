"""A pipeline over `documents`: quality rules, exact and near deduplication, removal of repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as
the next stage's docs; all but the last return the columns of `documents`. Rows are told apart by
all their columns, so null and repeated ids are documents like others.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm.common import cut, few, shared_folder
from quarrygraph.llm.exact_dedup import exact_dedup
from quarrygraph.llm.packing import pack
from quarrygraph.llm.quality import DEFAULT_POLICY, fails, ledger
from quarrygraph.llm.simhash import similar_groups
from quarrygraph.llm.suffix_dedup import suffix_dedup
from quarrygraph.llm.words import DEFAULT_VOCABULARY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the default policy."""
    return ledger(docs.select(*COLUMNS)).filter(~fails(DEFAULT_POLICY)).select(*COLUMNS)


def _told_apart(docs: DataFrame) -> DataFrame:
    """`docs` with _row, 128 bits of hash over all columns: the same however a scan deals out the rows."""
    parts = [*COLUMNS, *[F.col(c).isNull() for c in COLUMNS]]
    return docs.select(*COLUMNS, F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b")).alias("_row"))


def _without(rows: DataFrame, dropped: DataFrame, kept: DataFrame) -> DataFrame:
    """`rows` but for the _row of `dropped`, and one of each set of equal rows; `kept` has the _row of all rows that may have equals."""
    gone = cut(dropped.select("_row").distinct())
    rest = rows.join(few(gone, gone.count()), "_row", "left_anti")
    several = cut(kept.groupBy("_row").agg(F.count("*").alias("n")).filter("n > 1").select("_row"))
    n = several.count()
    if not n:
        return rest.select(*COLUMNS)
    alone = rest.join(few(several, n), "_row", "left_anti")
    return alone.union(rest.join(few(several, n), "_row", "left_semi").select(*alone.columns).dropDuplicates(["_row"])).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of texts that are equal but for white space: the longest, then the least id.

    Null text counts as empty, so all empty texts are one set; a null id comes last; of rows equal in all
    columns one stays; an empty table gives no rows.
    """
    rows = _told_apart(docs)
    met = exact_dedup(rows, row_col="_row").filter("group_size > 1")
    return _without(rows, met.filter("not kept"), met.filter("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarity 0.8 or more in five-word shingles links: the least by a hash of its columns.

    Null text counts as empty, and texts without a word are one group; ids play no part; of rows equal in
    all columns one stays; an empty table gives no rows.
    """
    rows = _told_apart(docs)
    found = similar_groups(rows, "_row").withColumnRenamed("id", "_row")
    return _without(rows, found.filter("_row <> group"), found.filter("copies > 1 and _row = group"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of any 100-byte string that starts earlier; bytes cut out of a character go with it."""
    return suffix_dedup(docs.select(*COLUMNS), carry=("lang", "source")).select(
        "doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars")
    )


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of at most 1024 tokens."""
    return pack(docs, public_tokenizers.path(DEFAULT_VOCABULARY))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("suffix_array_dedup", repeated_passages),
    ("best_fit_packing", packing),
]

#: SimHash, suffix order and tokens are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all of `documents`, each stage written to the shared folder and read again."""
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
