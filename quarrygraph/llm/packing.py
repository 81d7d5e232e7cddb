"""Best-two-fit packing of token sequences, planned on the histogram of lengths.

Which document goes where depends on lengths only, and there are no more lengths than tokens in
a sequence. So the driver plans on at most `capacity` counts, whatever the number of documents:
it fills a bin greedily, tries to swap the bin's smallest document for two that fit the wider gap
more tightly, and repeats the resulting pattern as often as the counts allow. Executors number
the pieces of each length and look their places up in the plan.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, tidy
from .words import DEFAULT_VOCABULARY, batched, coder_for

END_ID = 2


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths in order, how often) that together hold every length as often as counted."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    while left.any():
        free, used, gap = left.copy(), [], capacity
        while gap and (fits := np.flatnonzero(free[: gap + 1])).size:
            used.append(int(fits[-1]))
            free[used[-1]] -= 1
            gap -= used[-1]
        if gap and len(used) > 1:
            pair = _two(free, gap + used[-1])
            if sum(pair) > used[-1]:
                used[-1:] = pair
        times = min(int(left[length]) // n for length, n in Counter(used).items())
        for length in used:
            left[length] -= times
        out.append((used, times))
    return out


def _two(free: np.ndarray, room: int) -> list[int]:
    """Two lengths left in `free` whose sum comes closest to `room` from below; [0] if there are none."""
    have = np.flatnonzero(free[: room + 1])
    if not have.size:
        return [0]
    at = np.searchsorted(have, room - have, side="right") - 1
    partner = np.where(at >= 0, have[at], 0)
    alone = (partner == have) & (free[have] < 2)
    lower = np.where(at >= 1, have[np.maximum(at - 1, 0)], 0)
    partner = np.where(alone, lower, partner)
    total = np.where(partner > 0, have + partner, 0)
    best = int(total.argmax())
    return sorted([int(have[best]), int(partner[best])], reverse=True) if total[best] else [0]


def places(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: from which number on its pieces take which slot (first sequence, offset there)."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    seen: Counter = Counter()
    base = 0
    for used, times in patterns:
        offset = 0
        for length in used:
            slots.setdefault(length, []).append((seen[length], base, offset))
            seen[length] += times
            offset += length
        base += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in slots.items()}


def cut_lengths(n: int, capacity: int) -> list[int]:
    """A document of n tokens in pieces: whole if it fits, else full ones behind a first one that may be shorter."""
    if n <= capacity:
        return [n]
    head = n % capacity
    return [head] * bool(head) + [capacity] * (n // capacity)


def pack(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    keep_ids: bool = False,
) -> DataFrame:
    """Places every document in sequences of at most `capacity` tokens, few of them.

    Returns one row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset and, with
    keep_ids, ids (binary). A document is its tokens and END_ID; only one longer than `capacity`
    is cut. Offsets in a sequence run gapless from 0.

    Null text counts as empty (END_ID alone); null and repeated ids are packed like others, each row
    by itself; an empty table gives no rows; other columns are ignored. Equal lengths are
    interchangeable, so ties need no rule. A very long text is encoded whole, in its task's memory.
    """
    fields = [(id_col, pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * keep_ids
    schema = f"{id_col} long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    @tidy
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(path)
        end = END_ID.to_bytes(4, "little")
        for b in batches:
            names = b.column(0).to_pylist()
            for first, texts in batched(b.column(1).to_pylist()):
                rows = []
                for i, ids in zip(names[first:], coder.ids(texts)):
                    ids, start = ids + end, 0
                    for k, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + n)]
                        rows.append((i, k, start, n, zlib.crc32(part)) + (part,) * keep_ids)
                        start += n
                yield pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(zip(*rows), fields)], names=[f[0] for f in fields])
        coder.forget()

    made = cut(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(pieces, schema))
    patterns = plan({r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}, capacity)
    slot = places(patterns)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            order = np.argsort(length, kind="stable")
            by = length[order]
            first = np.searchsorted(by, by)
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(by)) - first + seen[by]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nth)], names=[*b.schema.names, "nth"])

    part = made.withColumn("part", F.spark_partition_id())
    before = (
        part.groupBy("part", "length").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
        .select("part", "length", F.coalesce("before", F.lit(0)).alias("before"))
    )
    numbered = part.mapInArrow(number, f"{schema}, part int, nth long").join(before, ["part", "length"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.schema.names
            length, nth = b.column(n.index("length")).to_numpy(), b.column(n.index("nth")).to_numpy() + b.column(n.index("before")).to_numpy()
            seq, off = np.empty(len(nth), np.int64), np.empty(len(nth), np.int64)
            for k in np.unique(length).tolist():
                rows = np.flatnonzero(length == k)
                starts, base, offset = slot[k]
                at = np.searchsorted(starts, nth[rows], side="right") - 1
                seq[rows], off[rows] = base[at] + nth[rows] - starts[at], offset[at]
            yield pa.RecordBatch.from_arrays([*(b.column(n.index(f[0])) for f in fields), pa.array(seq), pa.array(off)], names=[*(f[0] for f in fields), "sequence_id", "offset"])

    return numbered.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(DEFAULT_VOCABULARY))
