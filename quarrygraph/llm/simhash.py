"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if some word lies within r bits of both. So
every distinct fingerprint emits all words within half the radius of it, equal words meet in a
shuffle, and fingerprints that meet are verified and linked to the least of them. A word has at
most as many fingerprints around it as its ball has words, so no group grows with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FEW, components, cut, few, left_join_by_size, partitions, table, tidy
from .words import batched

SEED = 42
_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_STEP = 1 << 16


def fingerprint(text: str, words: int) -> int:
    """64-bit SimHash, unsigned, of all shingles of `words` lower-cased words, each repeat counted."""
    parts = text.encode("utf-8", "replace").translate(_UPPER).split()
    n = len(parts) - words + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return digest(b" ".join(parts), SEED) if parts else 0
    ones = np.zeros(64, np.int64)
    joined, size = b" ".join(parts), np.fromiter(map(len, parts), np.int64, len(parts))
    start = np.r_[0, np.cumsum(size[:-1] + 1)]
    ends = (start + size)[words - 1 :].tolist()
    starts = start.tolist()
    for at in range(0, n, _STEP):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _STEP], ends[at : at + _STEP])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, fp: long) of each row; nulls count as empty, whose fingerprint is 0."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py() or "", words) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(each, "id long, fp long")


def ball(half: int) -> list[int]:
    """Masks of at most `half` of 64 bits, as signed longs."""
    masks = [sum(1 << i for i in bits) for k in range(half + 1) for bits in combinations(range(64), k)]
    return np.array(masks, np.uint64).view(np.int64).tolist()


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between fingerprints `fp` at most `radius` bits apart that connect all such pairs.

    `distinct` holds each fingerprint once. `radius` is even.
    """
    masks = ball(radius // 2)
    variants = distinct.repartition(max(partitions(distinct), distinct.count() * len(masks) // _EMIT), "fp").select(
        "fp", F.explode(F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: F.col("fp").bitwiseXOR(m))).alias("variant")
    )
    met = variants.groupBy("variant").agg(F.collect_list("fp").alias("near")).filter(F.size("near") > 1)
    pairs = met.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).filter("a <> b").distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    radius: int = 2,
) -> DataFrame:
    """The near-duplicate component of every row.

    Returns id_col, fingerprint (16 lowercase hex digits) and component_id, the least id that links
    reach. Rows link when their fingerprints differ in at most `radius` (even) bits; equal
    fingerprints always do.

    Null text counts as empty, and texts without a word share fingerprint 0, linked like any
    other; a text of fewer than `words` words is one shingle. Null ids stay and are never a
    component's id unless all its ids are null; repeated rows keep a row each; an empty table
    gives no rows; other columns are ignored. Copies meet in partial aggregates before the
    shuffle, so a hot fingerprint costs a row a task. A very long text is hashed _STEP shingles at
    a time in one task.
    """
    prints = cut(fingerprints(docs, id_col, text_col, words))
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("size")))
    roots = components(links(distinct.select("fp"), radius))
    linked = distinct.join(roots, distinct.fp == roots.node)
    least = linked.groupBy("root").agg(F.min("least").alias("c"))
    classes = cut(
        linked.join(least, "root").select("fp", "size", "c")
        .union(distinct.join(roots, distinct.fp == roots.node, "left_anti").select("fp", "size", F.col("least").alias("c")))
    )
    rows = classes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return left_join_by_size(prints, classes, "fp", "size", rows).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("c").alias("component_id")
    )


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)


# Similarity far from 1 puts more bits between two fingerprints than a ball can cover, so it takes
# several short fingerprints: similar texts then come within the radius in one of them.
MIN_BITS = 32
#: Bits of a short fingerprint beyond the logarithm of the number of texts, so that strangers seldom meet.
SPARE_BITS = 16
#: Share of the pairs at the threshold that come within the radius in some table.
RECALL = 0.96
#: Variants that a task holds at once, and that a bucket gets on average.
_EMIT = 1 << 20
#: Texts of a block that are compared with as many at once, and bytes of their shingle hashes.
_TILE = 4096
_TILE_BYTES = 24 << 20
#: Words longer than this are hashed alone, blocks of words up to this many bytes together.
_LONG_WORD = 1 << 16
_WORD_BLOCK = 1 << 20

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LETTERS = np.random.default_rng(20240615).integers(0, 2**64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_LANES = np.array([sum((v >> j & 1) << (8 * j) for j in range(8)) for v in range(256)], np.uint64)


def _mixed(h: np.ndarray, t: int) -> np.ndarray:
    """A further hash of hashes: the finalizer of splitmix64 from another start for each t."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((0x9E3779B97F4A7C15 * (t + 1)) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word data[start[i]:end[i]]: a polynomial in random numbers of its bytes, by running sums over blocks of words."""
    out = np.zeros(len(start), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + _WORD_BLOCK, side="right")))
            low, size = int(start[i]), int(end[j - 1] - start[i])
            if j > i + 1 or size <= _LONG_WORD:
                up, down = _powers(_BASE, size + 1), _powers(pow(_BASE, -1, 2**64), size + 1)
                run = np.r_[np.uint64(0), np.cumsum(_LETTERS[data[low : low + size]] * up[:size])]
                out[i:j] = (run[end[i:j] - low] - run[start[i:j] - low]) * down[start[i:j] - low]
            i = j
    for k in np.flatnonzero(end - start > _LONG_WORD).tolist():
        out[k] = xxhash.xxh64_intdigest(data[start[k] : end[k]].tobytes(), SEED)
    return _mixed(out, 0)


def shingle_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): hashes[bounds[i]:bounds[i + 1]] are those of the distinct shingles of text i, sorted.

    Words are lower-cased; a text of fewer than `words` words is one shingle, and so is an empty one.
    """
    raw = [t.encode("utf-8", "replace").translate(_UPPER) for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    begin = np.cumsum([0, *(len(r) + 1 for r in raw)])
    space = _SPACE[data]
    before = np.r_[True, space[:-1]] if len(space) else space
    start, end = np.flatnonzero(before & ~space), np.flatnonzero(~before & space)
    h, doc = word_hashes(data, start, end), np.searchsorted(begin, start, side="right") - 1
    n = np.bincount(doc, minlength=len(texts))
    place = _powers(_BASE, words + 1)[1:]
    with np.errstate(over="ignore"):
        whole = np.flatnonzero(doc[: max(0, len(doc) - words + 1)] == doc[words - 1 :])
        out = np.zeros(len(whole), np.uint64)
        for k in range(words):
            out += h[whole + k] * place[k]
        few = np.flatnonzero(n < words)
        first = np.cumsum(n) - n
        rest = np.array([int((h[first[d] : first[d] + n[d]] * place[: n[d]]).sum(dtype=np.uint64)) for d in few], np.uint64) + n[few].astype(np.uint64)
    out, owner = _mixed(np.concatenate([out, rest]), 1), np.concatenate([doc[whole], few])
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[new], np.r_[0, np.cumsum(np.bincount(owner[new], minlength=len(texts)))]


def signatures(texts: list[str], words: int, bits: int) -> np.ndarray:
    """SimHash of so many bits, rounded up to whole 64, of the set of shingles of each text: (texts, 64-bit words).

    The eight bits of a hash byte are added as the eight lanes of an integer, over 255 hashes at most.
    """
    h, bounds = shingle_sets(texts, words)
    size = np.diff(bounds)
    blocks = -(-size // 255)
    head = np.cumsum(blocks) - blocks
    start = np.repeat(bounds[:-1] - 255 * head, blocks) + 255 * np.arange(int(blocks.sum()))
    out = np.zeros((len(texts), -(-bits // 64)), np.uint64)
    for t in range(out.shape[1]):
        ones = np.empty((len(start), 64), np.uint8)
        for at in range(0, len(start), 256):
            some = start[at : at + 256]
            z = int(start[at + 256]) if at + 256 < len(start) else len(h)
            lanes = _LANES[_mixed(h[some[0] : z], t + 2).view(np.uint8).reshape(-1, 8)]
            ones[at : at + 256] = np.add.reduceat(lanes, some - some[0], axis=0).view(np.uint8).reshape(-1, 64)
        if len(texts):
            total = np.add.reduceat(ones, head, axis=0, dtype=np.int64)
            out[:, t] = np.packbits(2 * total > size[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def signature(text: str, words: int, tables: int, bits: int = MIN_BITS) -> bytes:
    """The fingerprints of one text, `bits` for each table, one behind the other."""
    return signatures([text], words, tables * bits).tobytes()[: -(-tables * bits // 8)]


def bit_chance(similarity: float) -> float:
    """The chance that a bit of the SimHash of two sets of one size and this Jaccard similarity differs."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def bits_apart(similarity: float, bits: int, deviations: float) -> int:
    """Bits in which signatures of such sets differ: what is expected and some deviations."""
    p = bit_chance(similarity)
    return round(bits * p + deviations * (bits * p * (1 - p)) ** 0.5)


def tables_for(texts: int, similarity: float, recall: float) -> tuple[int, int]:
    """(tables, bits of each) by which pairs at the threshold meet with the chance `recall`, and strangers seldom."""
    bits = min(64, max(MIN_BITS, texts.bit_length() + SPARE_BITS))
    p = bit_chance(similarity)
    within = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(3))
    return math.ceil(math.log(1 - recall) / math.log(1 - within)), bits


def similar_groups(docs: DataFrame, id_col: str, text_col: str = "text", words: int = 5, similarity: float = 0.8, recall: float = RECALL) -> DataFrame:
    """(id, group, copies) of every row: the least id of the texts that links of `similarity` or more reach, and how many rows have equal fingerprints.

    Each text has several short fingerprints, whose length follows the number of texts and whose
    number follows `recall` (tables_for). Texts equal in one of them that are far over the threshold
    by all their bits form classes first, so that a group of copies is one class. Then every
    fingerprint emits its ball of radius 1, and texts of different classes that share a variant
    of the same table meet. Two or three that share one are pairs, kept if their bits allow the
    similarity; four or more hang together as a crowd. What hangs together by either is a
    block, and within a block all texts of different classes are compared, by bits and
    then by their shingles themselves, in squares of _TILE by _TILE texts.

    So pairs of the threshold link with the chance `recall`, more similar ones more often (0.85: over
    99 %), and nothing below it links but in classes, where the bits are four deviations off.

    id_col may have any type that has an order. Null text counts as empty; texts of fewer than
    `words` words are one shingle; a very long text takes a task's memory of some 30 times its own
    bytes while it is hashed. Rows of one id are taken to be of one text; ids must not be null. An
    empty table gives no rows; other columns are ignored.
    """
    rows = docs.count()
    tables, bits = tables_for(rows, similarity, recall)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    @tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, some in batched(b.column(1).to_pylist(), _WORD_BLOCK):
                sig = signatures(some, words, tables * bits)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(some)), pa.array([s.tobytes() for s in sig], pa.binary())], names=["id", "sig"])

    signed = cut(texts.mapInArrow(sign, f"id {kind}, sig binary"))
    distinct = cut(signed.groupBy("sig").agg(F.min("id").alias("least"), F.count("*").alias("size")).withColumn("node", F.monotonically_increasing_id()))
    low, high = (bits_apart(similarity, signatures([], words, tables * bits).shape[1] * 64, d) for d in (-4, 4))
    shape = (tables, bits)

    equal = _meeting(distinct.withColumn("label", F.col("node")), rows, *shape, [0], True).where("not crowd")
    partner = F.explode(F.array_distinct(F.array(F.min("a"), F.max("a"))))
    classes = components(_within(equal.groupBy("b").agg(partner.alias("a")).select("a", "b"), distinct, low))
    labelled = distinct.join(few(classes, classes.count()), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    met = cut(_meeting(labelled, rows, *shape, [0, *(1 << i for i in range(bits))], False))
    pairs = _within(met.where("not crowd").select("a", "b").distinct(), distinct, high)
    joined = met.where("crowd").groupBy("a").agg(F.collect_set("b").alias("of"))
    crowds = joined.select(F.explode(F.array_append("of", F.col("a"))).alias("a"), F.array_min("of").alias("b"))
    blocks = components(pairs.union(crowds))
    links = _linked(labelled.join(few(blocks, blocks.count()).withColumnRenamed("root", "block"), "node"), texts, words, similarity, high)
    found = components(classes.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))
    n = found.count()
    of = cut(distinct.join(few(found, n), "node").select("node", "least", "root"))
    firsts = cut(of.groupBy("root").agg(F.min("least").alias("group"), F.count("*").alias("nodes")))
    named = of.join(F.broadcast(firsts), "root") if n <= FEW else left_join_by_size(of, firsts, "root", "nodes", n)
    groups = cut(distinct.join(few(named.select("node", "group"), n), "node", "left").select("sig", "size", "least", F.coalesce("group", "least").alias("group")))
    several = groups.where("size > 1 or group <> least")
    if several.count() <= FEW:
        out = signed.join(F.broadcast(several), "sig", "left")
    else:
        out = left_join_by_size(signed, groups, "sig", "size", rows)
    return out.select("id", F.coalesce("group", "id").alias("group"), F.coalesce("size", F.lit(1)).cast("long").alias("copies"))


def _variants(sig: np.ndarray, tables: int, bits: int, flips: np.ndarray) -> np.ndarray:
    """Hashes of the fingerprints of each row of `sig` under each of `flips`, other ones for each table: (rows, tables * flips)."""
    plain = np.unpackbits(np.ascontiguousarray(sig).view(np.uint8), axis=1, bitorder="little")[:, : tables * bits].reshape(len(sig), tables, bits)
    fp = np.packbits(plain, axis=2, bitorder="little")
    fp = np.concatenate([fp, np.zeros((*fp.shape[:2], 8 - fp.shape[2]), np.uint8)], axis=2).view("<u8")
    out = (fp ^ flips).transpose(1, 0, 2)
    return np.concatenate([_mixed(x, 1000 + t) for t, x in enumerate(out)], axis=1)


def _meeting(nodes: DataFrame, rows: int, tables: int, bits: int, masks: list[int], stars: bool) -> DataFrame:
    """(a, b, crowd) of `nodes` (node, sig, label) of different labels that share a variant, by any of the masks, in a table.

    With `stars`, b pairs with the least node a that shares it. Else two or three that share a variant are
    pairs (a < b); more are a crowd: b is the least of all that overlapping crowds of the bucket join to a.
    A variant travels as 40 bits of its hash, so strangers meet by chance as well, some one pair in a bucket.
    """
    flips = np.array(masks, np.uint64)
    each = tables * len(masks)
    buckets = max(1, rows * each // _EMIT)
    step = max(1, _EMIT // each)
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            node, label = b.column(0).to_numpy(), b.column(2).to_numpy()
            h = _variants(np.frombuffer(b"".join(b.column(1).to_pylist()), "<u8").reshape(len(node), -1), tables, bits, flips).reshape(-1)
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(kind)
            order = np.argsort(bucket, kind="stable")
            bucket, row = bucket[order], order // each
            key = np.ascontiguousarray(h[order].view(np.uint8).reshape(-1, 8)[:, :5])
            turn = np.r_[True, bucket[1:] != bucket[:-1]]
            first = np.flatnonzero(turn)
            run = np.flatnonzero(turn | np.r_[True, row[1:] != row[:-1]])
            count = np.diff(np.r_[run, len(row)]).astype("<u2")
            who = row[run]
            a = [*first.tolist(), len(row)]
            r = [*np.searchsorted(run, first).tolist(), len(run)]
            # Most nodes are their own class: the distance to the label is zeros, which compress away.
            runs = (count, node[who], (node - label)[who])
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[first].astype(np.int64)), pa.array([key[x:z].tobytes() for x, z in zip(a, a[1:])], pa.binary()),
                 *(pa.array([c[x:z].tobytes() for x, z in zip(r, r[1:])], pa.binary()) for c in runs)],
                names=["bucket", "keys", "counts", "owners", "offsets"])

    @tidy
    def meet(t: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(t["keys"].to_pylist()), np.uint8).reshape(-1, 5)
        key = np.zeros((len(raw), 8), np.uint8)
        key[:, :5] = raw
        key, (count, owner, offset) = key.view("<u8")[:, 0], (np.frombuffer(b"".join(t[c].to_pylist()), d) for c, d in (("counts", "<u2"), ("owners", "<i8"), ("offsets", "<i8")))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        several = np.r_[False, same] | np.r_[same, False]
        key, order = key[order][several], order[several]
        who = np.searchsorted(np.cumsum(count), order, side="right")
        owner, label = owner[who], (owner - offset)[who]
        order = np.lexsort((owner, key))
        key, owner, label = key[order], owner[order], label[order]
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        key, owner, label = key[keep], owner[keep], label[keep]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(key)])
        mixed = np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first) if len(first) else np.zeros(0, bool)
        a, b = [], []
        if stars:
            at = np.repeat(mixed, size) & ~new
            a.append(np.repeat(owner[first], size)[at])
            b.append(owner[at])
        else:
            small = first[mixed & (size <= 3)]
            third = first[mixed & (size == 3)]
            for x, y in ((small, small + 1), (third, third + 2), (third + 1, third + 2)):
                apart = label[x] != label[y]
                a.append(owner[x][apart])
                b.append(owner[y][apart])
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
        crowd = np.zeros((2, 0), np.int64)
        if not stars:
            many = mixed & (size > 3)
            crowd = _joined(owner[np.repeat(many, size)], size[many])
        both = np.concatenate([pairs, crowd], axis=1)
        return pa.table({"a": both[0], "b": both[1], "crowd": np.arange(both.shape[1]) >= pairs.shape[1]})

    return (
        nodes.select("node", "sig", "label").repartition(max(partitions(nodes), buckets // 8), "node")
        .mapInArrow(emit, "bucket long, keys binary, counts binary, owners binary, offsets binary")
        .groupBy("bucket").applyInArrow(meet, "a long, b long, crowd boolean")
    )


def _joined(owner: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows (member, least member of what overlapping crowds join) for crowds of `size` that stand in `owner` one after the other."""
    if not len(owner):
        return np.zeros((2, 0), np.int64)
    names, at = np.unique(owner, return_inverse=True)
    crowd, first = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
    root = np.arange(len(names))
    while True:
        least = np.minimum.reduceat(root[at], first)
        now = root.copy()
        np.minimum.at(now, at, least[crowd])
        now = now[now]
        if (now == root).all():
            return np.stack([names, names[root]])
        root = now


def _within(pairs: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """The pairs (a, b), each given once, whose signatures differ in at most `most` bits."""

    @tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u8").reshape(b.num_rows, -1) for i in (2, 3))
                near = pa.array(np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= most)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(near), b.column(1).filter(near)], names=["a", "b"])

    pairs = cut(pairs)
    ends = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    n = ends.count()
    some = nodes.join(few(ends, n), "node", "left_semi")
    left, right = (few(some.select(F.col("node").alias(k), F.col("sig").alias(v)), n) for k, v in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _linked(members: DataFrame, texts: DataFrame, words: int, similarity: float, most: int) -> DataFrame:
    """Links (a, b) that join all nodes of a block whose texts have this Jaccard similarity or more, classes taken as joined.

    members: (node, block, sig, label, least), `least` the id of the node's text in `texts`. A block is dealt
    out in tiles of _TILE nodes and _TILE_BYTES of shingle hashes, and each two tiles are a square.
    """

    @tidy
    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            for first, some in batched(b.column(at).to_pylist(), _WORD_BLOCK):
                h, bounds = shingle_sets(some, words)
                sets = pa.array([h[a:z].tobytes() for a, z in zip(bounds.tolist(), bounds[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([sets if i == at else c.slice(first, len(some)) for i, c in enumerate(b.columns)], names=[*b.schema.names[:at], "set"])

    members = cut(members)
    n = members.count()
    wanted = few(members.select(F.col("least").alias("id"), "node", "block", "label", "sig"), n)
    chosen = texts.join(few(members.select(F.col("least").alias("id")), n), "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))
    sets = cut(chosen.join(wanted, "id").select("node", "block", "label", "sig", "text").mapInArrow(shingles, "node long, block long, label long, sig binary, set binary"))
    tiles = F.greatest(F.ceil(F.count("*") / F.lit(_TILE)), F.ceil(F.sum(F.octet_length("set")) / F.lit(_TILE_BYTES))).cast("long")
    sizes = cut(sets.groupBy("block").agg(F.count("*").alias("n"), tiles.alias("tiles"), F.sum(F.octet_length("set")).alias("bytes")))
    load = sizes.agg(F.sum(F.col("n") * F.col("tiles")).alias("n"), F.sum(F.col("bytes") * F.col("tiles")).alias("bytes")).first()
    buckets = max(1, (load["n"] or 0) // _TILE, (load["bytes"] or 0) // _TILE_BYTES)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, block, tile = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("node", "block", "tiles"))
            mine = (_mixed(node.astype(np.uint64), 3) % tile.astype(np.uint64)).astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), tile)
            other = np.arange(len(row)) - np.repeat(np.cumsum(tile) - tile, tile)
            i, j = np.minimum(mine[row], other), np.maximum(mine[row], other)
            square = _mixed(_mixed(block[row].astype(np.uint64), 4) + i.astype(np.uint64), 5) ^ _mixed(j.astype(np.uint64), 6)
            cols = {"bucket": pa.array((square % np.uint64(buckets)).astype(np.int64)), "square": pa.array(square.view(np.int64)), "side": pa.array((mine[row] == j) & (i != j))}
            for at in range(0, len(row), 1024):
                some = pa.array(row[at : at + 1024])
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(at, 1024) for c in cols.values()), *(b.column(b.schema.get_field_index(c)).take(some) for c in ("node", "label", "sig", "set"))],
                    names=[*cols, "node", "label", "sig", "set"])

    @tidy
    def compare(t: pa.Table) -> pa.Table:
        square, side, node, label = (t[c].to_numpy() for c in ("square", "side", "node", "label"))
        order = np.lexsort((node, side, square))
        square, side, node, label = square[order], side[order], node[order], label[order]
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), "<u8").reshape(len(node), -1)[order]
        held = t["set"].take(pa.array(order))
        first = np.flatnonzero(np.r_[True, square[1:] != square[:-1]]).tolist()
        out = []
        for a, z in zip(first, [*first[1:], len(node)]):
            out += _square(label[a:z], side[a:z], sig[a:z], held.slice(a, z - a), similarity, most, node[a:z])
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), ()))], names=["a", "b"])

    return (
        left_join_by_size(sets, sizes.drop("bytes"), "block", "n", n)
        .mapInArrow(deal, "bucket long, square long, side boolean, node long, label long, sig binary, set binary")
        .groupBy("bucket").applyInArrow(compare, "a long, b long")
    )


def _square(label: np.ndarray, side: np.ndarray, sig: np.ndarray, sets: pa.ChunkedArray, similarity: float, most: int, node: np.ndarray) -> list[tuple[int, int]]:
    """Links (a, b) of nodes of different labels: of one side with the other, or of all with all if there is one side.

    Pairs are taken from the most similar by bits on, and those that links before join are passed over.
    """
    middle = int(np.count_nonzero(~side))
    low = middle if middle < len(side) else 0
    found = []
    for x in range(middle if len(side) > 1 else 0):
        y = np.arange(max(low, x + 1), len(side))
        y = y[label[y] != label[x]]
        bits = np.bitwise_count(sig[y] ^ sig[x]).sum(1, dtype=np.int64)
        near = bits <= most
        if near.any():
            found.append(np.stack([np.full(int(near.sum()), x), y[near], bits[near]]))
    if not found:
        return []
    x, y, bits = np.concatenate(found, axis=1)
    order = np.argsort(bits, kind="stable")
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while (up := root.get(v, v)) != v:
            root[v] = v = root.get(up, up)
        return v

    out, known = [], {}

    def shingles(i: int) -> np.ndarray:
        if i not in known:
            known[i] = np.frombuffer(sets[i].as_py(), np.uint64)
        return known[i]

    for i, j in zip(x[order].tolist(), y[order].tolist()):
        u, v = find(int(label[i])), find(int(label[j]))
        if u == v:
            continue
        p, q = shingles(i), shingles(j)
        if min(len(p), len(q)) < similarity * max(len(p), len(q)):
            continue
        both = len(np.intersect1d(p, q, assume_unique=True))
        if both >= similarity * (len(p) + len(q) - both):
            root[max(u, v)] = min(u, v)
            out.append((int(node[i]), int(node[j])))
    return out
