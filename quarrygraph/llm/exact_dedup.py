"""Exact deduplication: a two-pass Bloom filter decides which rows have to meet at all.

Pass 1 builds a counting filter of the text hashes that keeps, for every bit, whether it was
set at least twice. Pass 2 tests each row against the bits set twice: a row with any bit set
once only cannot have an equal and goes straight through; the rest, every real copy among
them, shuffle on the full hash and are settled exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, left_join_by_size, table, text_or_empty

BLOCK_BITS = 4096
GROUP_BLOCKS = 16
PROBES = 3
WHITE = " \t\n\x0b\x0c\r"
_LAST = 9223372036854775807


def twice_filter(digests: DataFrame, blocks: int) -> DataFrame:
    """The filter's bits that `digests` (h1, h2) sets twice or more: (block, words: 64 longs).

    Every task folds its own rows first, so a hash that a third of all rows share leaves a task
    as one entry. What shuffles is two bytes a probe, dealt by ranges of 16 blocks.
    """
    span = BLOCK_BITS * GROUP_BLOCKS

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = []
        for b in batches:
            h1, h2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            at = (h1 % blocks) * BLOCK_BITS
            codes += [at + ((h2 >> (12 * i)) & (BLOCK_BITS - 1)) for i in range(PROBES)]
        if not codes:
            return
        code, n = np.unique(np.concatenate(codes), return_counts=True)
        group, cell = code // span, (code % span).astype("<u2")
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        last = np.r_[first[1:], len(group)]
        yield pa.RecordBatch.from_pydict(
            {
                "grp": group[first],
                "once": pa.array([cell[a:b][n[a:b] == 1].tobytes() for a, b in zip(first, last)], pa.binary()),
                "twice": pa.array([cell[a:b][n[a:b] > 1].tobytes() for a, b in zip(first, last)], pa.binary()),
            }
        )

    def merge(t: pa.Table) -> pa.Table:
        count = np.zeros(span, np.int32)
        for once, twice in zip(t["once"].to_pylist(), t["twice"].to_pylist()):
            count[np.frombuffer(once, "<u2")] += 1
            count[np.frombuffer(twice, "<u2")] += 2
        words = np.packbits(count > 1, bitorder="little").view("<i8").reshape(GROUP_BLOCKS, -1)
        used = np.flatnonzero(words.any(axis=1))
        return pa.table({"block": t["grp"][0].as_py() * GROUP_BLOCKS + used, "words": pa.array(words[used].tolist(), pa.list_(pa.int64()))})

    return (
        digests.select("h1", "h2")
        .mapInArrow(fold, "grp long, once binary, twice binary")
        .groupBy("grp")
        .applyInArrow(merge, "block long, words array<long>")
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits_per_row: int = 8,
    max_filter_bytes: int = 64 << 20,
    row_col: str | None = None,
) -> DataFrame:
    """Which rows of `docs` repeat another's text, white space aside.

    Returns one row per input row: id_col, keep_id, group_size, kept, text_sha256. Texts are equal
    when identical without the characters [\\x20\\x09-\\x0D]; of equal texts the row with the most
    code points in its original text stays, then the least id, then any one of fully equal rows.

    With row_col, which tells rows apart and has any type with an order, that column comes too and
    settles ties of equal ids; rows equal in it as well stay or go together.

    Null text counts as empty; a null id ranks last; an empty table gives no rows; other columns
    are ignored, so their names cannot clash. A very long text is hashed where it is read and never
    shuffles. The broadcast filter takes bits_per_row bits a row
    and never more than max_filter_bytes: with more rows than that holds, more of them shuffle
    (a digest of some 60 bytes, never the text) and the result stays exact.
    """
    text = text_or_empty(text_col)
    digests = cut(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            F.char_length(text).alias("n"),
            F.unhex(F.sha2(F.translate(text, WHITE, ""), 256)).alias("sha"),
            (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
        )
        .withColumns({"h1": F.xxhash64("sha").bitwiseAND(_LAST), "h2": F.xxhash64("sha", F.lit(1)).bitwiseAND(_LAST)})
    )
    rows = digests.count()
    blocks = max(1, min(rows * bits_per_row // BLOCK_BITS + 1, max_filter_bytes * 8 // BLOCK_BITS))
    bits = twice_filter(digests, blocks)

    def probe(i: int):
        at = F.shiftright("h2", 12 * i).bitwiseAND(BLOCK_BITS - 1)
        return F.getbit(F.element_at("words", (F.shiftright(at, 6) + 1).cast("int")), at.bitwiseAND(63)) == 1

    hit = F.coalesce(probe(0) & probe(1) & probe(2), F.lit(False))
    tested = digests.join(F.broadcast(bits), F.col("h1") % blocks == F.col("block"), "left").select(
        "id", "n", "sha", "row", hit.alias("hit")
    )
    maybe = cut(tested.filter("hit").drop("hit"))
    sure = tested.filter("not hit")
    best = F.max(F.struct("n", (-F.coalesce("id", F.lit(_LAST))).alias("i"), "row", "id"))
    groups = cut(
        maybe.groupBy("sha").agg(F.count("*").alias("size"), best.alias("best")).filter("size > 1")
        .select("sha", "size", F.col("best.id").alias("keep"), F.col("best.row").alias("keep_row"))
    )
    met = left_join_by_size(maybe, groups, "sha", "size", rows)
    alone = F.col("size").isNull()
    out = met.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "row",
    )
    every = out.union(sure.select("id", "id", F.lit(1).cast("long"), F.lit(True), F.lower(F.hex("sha")), "row"))
    return every.withColumnRenamed("row", row_col) if row_col else every.drop("row")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
             row_number() OVER w AS rn
      FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM r
"""
