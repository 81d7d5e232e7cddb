"""Removal of repeated byte strings by column-wise construction over a collection of strings.

A byte goes if it lies in a string of `length` bytes that also starts earlier. Comparing all
suffixes of all documents at once would take as many rounds as the longest document has bytes, so
the collection is cut first, by content: of the `length - GRAM + 1` byte grams in each window the
least by hash is its anchor. Equal windows have equal anchors at equal offsets, so all occurrences
of a repeated window meet among the occurrences of one gram, and each occurrence with
`length - GRAM` bytes on either side holds every window it anchors.

Occurrences whose surroundings are equal too are settled by their hashes: all but the first are
repeats as a whole. What is left, one string for each different surrounding of a repeated gram,
is aligned at the gram and built up column by column from the right: each round inserts one symbol
per string, which turns the collection's order by suffixes into the next (the symbols in that
order are the column's Burrows-Wheeler transform), and carries the common prefixes of neighbours
along. Where a common prefix reaches `length`, neighbours share a window, and all but the first in
the corpus lose it. Rounds are 2 * length - GRAM, whatever the documents' lengths.

Common grams (a line that a third of all documents have) would fill one bucket. Their number is
bounded, so a first scan finds them; their occurrences are dealt by gram and surroundings, and
their strings in four parts by starting column, each dealt by the bytes that all its windows hold.
Equal parts fold to their first in each task.

Between the steps the collection lies in shuffle and checkpoint files, read and written in order;
a task holds one bucket of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions, table, text_or_empty, tidy

LENGTH = 100
GRAM = 32
#: A gram with so many occurrences, and a thousandth of all, is common: its strings are dealt by their parts.
COMMON = 4096
COMMON_SHARE = 0.001
#: Anchors that a bucket gets on average.
BUCKET = 1 << 17
_LAST = 2**63 - 1
_RUN = 1 << 20
_PLACE = 22
_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(0, 2**64, 256, np.uint64)
_MIX = [int(x) | 1 for x in _RANDOM.integers(0, 2**64, 8, np.uint64)]

_ANCHORS = [("bucket", pa.int32()), ("gram", pa.binary()), ("around", pa.binary()), ("id", pa.binary()), ("key", pa.binary()), ("pos", pa.binary()), ("size", pa.binary())]
_STRINGS = [("bucket", pa.int32()), ("id", pa.int64()), ("key", pa.int64()), ("pos", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("data", pa.binary())]
_FOUND = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("gram", pa.int64())])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on, by doubling."""
    h, width, step = _BYTE[data], 1, 0
    with np.errstate(over="ignore"):
        while width < GRAM:
            h = h[:-width] * np.uint64(_MIX[step]) + h[width:]
            h ^= h >> np.uint64(29)
            width, step = 2 * width, step + 1
    return h


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (width - have)], v[width - have :]) if width > have else v


def anchors(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of every anchor of the texts data[bounds[i]:bounds[i + 1]], in order.

    Hashes are compared by the bits above _PLACE, which leaves room for positions in a block; the
    first of equal ones wins, so the choice depends on a window's bytes alone.
    """
    found, step = [np.zeros(0, np.int64)], (1 << _PLACE) - length
    h = gram_hashes(data) if len(data) >= length else np.zeros(0, np.uint64)
    low = np.uint64((1 << _PLACE) - 1)
    for block in range(0, len(data) - length + 1, step):
        v = h[block : block + step + length - GRAM]
        at = (sliding_min((v & ~low) | np.arange(len(v), dtype=np.uint64), length - GRAM + 1) & low).astype(np.int64)
        ok = np.ones(len(at) + length, bool)
        for b in bounds[np.searchsorted(bounds, block) : np.searchsorted(bounds, block + len(ok))].tolist():
            ok[max(0, b - block - length + 1) : max(0, b - block)] = False
        found.append(at[ok[: len(at)]] + block)
    at = np.concatenate(found)
    at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
    return at, h[at]


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges as ranges in order, none touching the next."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > reach[:-1]]
    return start[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(reach) - 1]]


def repeated_windows(strings: np.ndarray, rank: np.ndarray, length: int, starts: int) -> np.ndarray:
    """Which windows of `length` symbols that start in the first `starts` columns another string of lower rank has too.

    strings: one row each, -1 where a string has no symbol. Column by column from the right, `order`
    sorts the strings by their suffixes and `common` holds the common prefix of each with the one
    before, at most `length`.
    """
    n, columns = strings.shape
    order, common = np.arange(n), np.zeros(n + 1, np.int16)
    out = np.zeros((n, starts), bool)
    for j in range(columns - 1, -1, -1):
        symbol = strings[order, j]
        to = np.argsort(symbol, kind="stable")
        symbol, order = symbol[to], order[to]
        same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] >= 0)) + 1
        least = np.zeros(n + 1, np.int16)
        if len(same):
            spans = np.empty(2 * len(same), np.int64)
            spans[::2], spans[1::2] = to[same - 1] + 1, to[same] + 1
            least[same] = np.minimum(np.minimum.reduceat(common, spans)[::2] + 1, length)
        common = least
        if j < starts and (common >= length).any():
            group = np.cumsum(common[:n] < length)
            ranks = rank[order]
            first = np.minimum.reduceat(ranks, np.flatnonzero(common[:n] < length))[group - 1]
            out[order[ranks > first], j] = True
    return out


def _ranges(repeat: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) in bytes of each run of repeated windows; row i's column 0 lies at first[i]."""
    edge = np.diff(np.pad(repeat.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, a = np.nonzero(edge == 1)
    b = np.nonzero(edge == -1)[1]
    return row, first[row] + a, first[row] + b - 1 + length


def _packed(docs: DataFrame) -> DataFrame:
    """`docs` with the column text compressed, as texts travel through shuffles."""
    at = docs.columns.index("text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(1).compress
        for b in batches:
            data = pa.array([press(t.as_py().encode()) for t in b.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([data if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return docs.mapInArrow(pack, ", ".join(f"`{n}` {'binary' if n == 'text' else t}" for n, t in docs.dtypes))


def _found(id_, key, start, end, gram=None) -> pa.RecordBatch:
    n = len(id_)
    return pa.RecordBatch.from_arrays([pa.array(id_, pa.int64()), pa.array(key, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.nulls(n, pa.int64()) if gram is None else pa.array(gram, pa.int64())], schema=_FOUND)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(ids, keys, texts) in runs of about _RUN bytes."""
    ids, keys, texts, size = [], [], [], 0
    for b in batches:
        for i, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            t = t.as_py().encode()
            if texts and size + len(t) > _RUN:
                yield ids, keys, texts
                ids, keys, texts, size = [], [], [], 0
            ids.append(i)
            keys.append(k)
            texts.append(t)
            size += len(t)
    if texts:
        yield ids, keys, texts


def common_grams(docs: DataFrame, length: int) -> tuple[np.ndarray, int]:
    """Hashes of grams that anchor COMMON windows or more and half of COMMON_SHARE of all, so 2 / COMMON_SHARE at most, and how many anchors there are."""

    @tidy
    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for _, _, texts in _documents(batches):
            _, gram = anchors(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), length)
            new, n = np.unique(gram, return_counts=True)
            grams, at = np.unique(np.concatenate([grams, new]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(grams)).astype(np.int64)
        often = counts >= max(2, int(counts.sum() * COMMON_SHARE / 2))
        yield pa.RecordBatch.from_arrays([pa.array(grams[often].view(np.int64)), pa.array(counts[often]), pa.array(np.zeros(int(often.sum()), np.int64))], names=["gram", "n", "total"])
        yield pa.RecordBatch.from_pydict({"gram": [0], "n": [0], "total": [int(counts.sum())]})

    found = cut(docs.mapInArrow(frequent, "gram long, n long, total long"))
    total = found.agg(F.sum("total")).first()[0] or 0
    most = found.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= max(COMMON, total * COMMON_SHARE / 2)).select("gram")
    return np.sort(np.array([r["gram"] for r in most.collect()], np.int64).view(np.uint64)), total


def _parts(side: int, pieces: int) -> list[tuple[int, int]]:
    """The starting columns 0 to side in `pieces` ranges (first, last)."""
    edge = np.linspace(0, side + 1, pieces + 1).round().astype(int).tolist()
    return [(x, y - 1) for x, y in zip(edge, edge[1:])]


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, key, starts, ends) of the bytes to remove from each text of `docs` (id, key, text) that loses any."""
    side = length - GRAM
    common, total = common_grams(docs, length)
    buckets = max(partitions(docs), total // BUCKET)

    @tidy
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, settled = [], []
        for ids, keys, texts in _documents(batches):
            joined = b"".join(texts)
            bounds = np.cumsum([0, *map(len, texts)])
            at, gram = anchors(np.frombuffer(joined, np.uint8), bounds, length)
            if not len(at):
                continue
            doc = np.searchsorted(bounds, at, side="right") - 1
            begin, size = bounds[doc], bounds[doc + 1] - bounds[doc]
            lo, hi = np.maximum(at - side, begin), np.minimum(at + GRAM + side, begin + size)
            digest = xxhash.xxh64_intdigest
            around = np.array([digest(joined[a:b], c) for a, b, c in zip(lo.tolist(), hi.tolist(), (at - lo).tolist())], np.uint64)
            parts.append((gram, around, np.array(ids, np.int64)[doc], np.array(keys, np.int64)[doc], at - begin, np.minimum(size - (at - begin), 65535)))
        if not parts:
            return
        cols = [np.concatenate(c) for c in zip(*parts)]
        parts = None
        cols, repeat = _first_of_equals(cols)
        gone = [c[repeat] for c in cols]
        for i, k, s, e in _by_document(gone, side):
            settled.append((i, k, s, e))
        cols = [c[~repeat] for c in cols]
        where = np.where(np.isin(cols[0], common), cols[0] ^ cols[1], cols[0])
        bucket = (where >> np.uint64(33)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        cols, bucket = [c[order] for c in cols], bucket[order]
        cut_at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        types = ("<u8", "<u8", "<i8", "<i8", "<u4", "<u2")
        for a, b in zip(cut_at.tolist(), [*cut_at[1:].tolist(), len(bucket)]):
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket[a]], pa.int32()), *(pa.array([c[a:b].astype(t).tobytes()], pa.binary()) for c, t in zip(cols, types))],
                names=[n for n, _ in _ANCHORS])
        for i, k, s, e in settled:
            where = int(i[0]) % buckets
            yield pa.RecordBatch.from_arrays(
                [pa.array([where], pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), *(pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in zip((i, k, s, e), ("<i8", "<i8", "<u4", "<u4")))],
                names=[n for n, _ in _ANCHORS])

    @tidy
    def meet(t: pa.Table) -> pa.Table:
        out, rows = [], t.to_pylist()
        for r in rows:
            if r["gram"] is None:
                out.append(_found(*(np.frombuffer(r[n], d).astype(np.int64) for n, d in (("id", "<i8"), ("key", "<i8"), ("pos", "<u4"), ("size", "<u4")))))
        rows = [r for r in rows if r["gram"] is not None]
        if rows:
            cols = [np.frombuffer(b"".join([r[n] for r in rows]), d) for n, d in (("gram", "<u8"), ("around", "<u8"), ("id", "<i8"), ("key", "<i8"), ("pos", "<u4"), ("size", "<u2"))]
            cols = [c.astype(np.int64) if c.dtype.itemsize < 8 else c for c in cols]
            rows = None
            _, n = np.unique(cols[0], return_counts=True)
            cols, repeat = _first_of_equals(cols)
            for i, k, s, e in _by_document([c[repeat] for c in cols], side):
                out.append(_found(i, k, s, e))
            cols = [c[~repeat] for c in cols]
            gram = cols[0]
            several = np.isin(gram, common)
            if len(gram):
                several[1:] |= gram[1:] == gram[:-1]
                several[:-1] |= gram[1:] == gram[:-1]
            g, _, i, k, p, _ = (c[several] for c in cols)
            out.append(_found(i, k, p, p, g.view(np.int64)))
        return pa.Table.from_batches(out, schema=_FOUND)

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                s, e = merged(np.array([x["start"] for x in r["spans"]], np.int64), np.array([x["end"] for x in r["spans"]], np.int64))
                rows.append({"id": r["id"], "key": r["key"], "starts": s.tolist(), "ends": e.tolist(), "asks": r["asks"]})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("id", pa.int64()), ("key", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("asks", pa.list_(pa.struct([("pos", pa.int64()), ("gram", pa.int64())])))]))

    def by_text(found: DataFrame) -> DataFrame:
        ask = F.when(F.col("gram").isNotNull(), F.struct(F.col("start").alias("pos"), "gram"))
        span = F.when(F.col("gram").isNull(), F.struct("start", "end"))
        return (
            found.groupBy("id", "key").agg(F.collect_list(span).alias("spans"), F.collect_list(ask).alias("asks"))
            .mapInArrow(union, "id long, key long, starts array<long>, ends array<long>, asks array<struct<pos:long,gram:long>>")
        )

    first = cut(by_text(docs.mapInArrow(gather, "bucket int, gram binary, around binary, id binary, key binary, pos binary, size binary").groupBy("bucket").applyInArrow(meet, "id long, key long, start long, end long, gram long")))

    @tidy
    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = {int(g) for g in common.view(np.int64)}
        whole, quarters = [(0, side)], _parts(side, 4)
        for b in batches:
            rows, firsts, before = [], {}, None
            texts = sorted(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), range(b.num_rows), b.column(3).to_pylist()), key=lambda r: r[:3])
            for i, k, n, asks in texts:
                if (i, k) == before:
                    continue
                before = (i, k)
                data = zstandard.decompress(b.column(2)[n].as_py())
                for a in sorted(asks, key=lambda a: a["pos"]):
                    pos, gram = a["pos"], a["gram"]
                    spread = gram in few
                    for lo, hi in quarters if spread else whole:
                        start, end = pos - side + lo, pos - side + hi + length
                        part = data[max(0, start) : end]
                        where = gram
                        if spread:
                            if len(part) < length:
                                continue
                            if firsts.setdefault((gram, lo, part), (i, k, pos)) != (i, k, pos):
                                rows.append((int(i) % buckets, i, k, max(0, start), min(end, len(data)), 0, None))
                                continue
                            # What every window of this part holds: the bytes from the last start to the first end.
                            where = xxhash.xxh64_intdigest(data[max(0, pos - side + hi) : max(0, start + length)], gram % 2**32)
                        rows.append(((where % 2**64 >> 33) % buckets, i, k, pos, lo, hi, part))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(zip(*rows), _STRINGS)], names=[f[0] for f in _STRINGS])

    @tidy
    def compare(t: pa.Table) -> pa.Table:
        out = []
        told = pa.compute.is_null(t["data"])
        settled, t = t.filter(told), t.filter(pa.compute.invert(told))
        out.append(_found(*(settled[n].to_numpy().astype(np.int64) for n in ("id", "key", "pos", "lo"))))
        for lo, hi in sorted(set(zip(t["lo"].to_pylist(), t["hi"].to_pylist()))):
            some = t.filter(pa.compute.and_(pa.compute.equal(t["lo"], lo), pa.compute.equal(t["hi"], hi)))
            ids, keys, pos = (some[n].to_numpy() for n in ("id", "key", "pos"))
            # A text that `docs` holds several times counts once.
            order = np.lexsort((pos, keys, ids))
            new = np.ones(len(order), bool)
            new[1:] = np.any([c[order][1:] != c[order][:-1] for c in (ids, keys, pos)], axis=0)
            some = some.take(pa.array(order[new]))
            ids, keys, pos = (c[order[new]] for c in (ids, keys, pos))
            first = pos - side + lo
            strings = np.full((len(ids), hi - lo + length), -1, np.int16)
            for i, (at, d) in enumerate(zip(first.tolist(), some["data"].to_pylist())):
                skip = max(0, -at)
                strings[i, skip : skip + len(d)] = np.frombuffer(d, np.uint8)
            row, start, end = _ranges(repeated_windows(strings, np.arange(len(ids)), length, hi - lo + 1), first, length)
            out.append(_found(ids[row], keys[row], start, end))
        return pa.Table.from_batches(out, schema=_FOUND)

    asked = _packed(docs).join(first.filter(F.size("asks") > 0).select("id", "key", "asks"), ["id", "key"])
    second = (
        asked.select("id", "key", "text", "asks").mapInArrow(surroundings, "bucket int, id long, key long, pos long, lo long, hi long, data binary")
        .groupBy("bucket").applyInArrow(compare, "id long, key long, start long, end long, gram long")
        .select("id", "key", F.array("start").alias("starts"), F.array("end").alias("ends"))
    )
    spans = first.select("id", "key", "starts", "ends").filter(F.size("starts") > 0).union(second)
    return spans.groupBy("id", "key").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))


def _first_of_equals(cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """`cols` in order of gram, surroundings, id, key, position, and in it which rows have an equal with equal surroundings before them.

    Rows of one id, key and position are one text that `docs` holds several times: the first stays.
    """
    gram, around, ids, keys, pos, _ = cols
    order = np.lexsort((pos, keys, ids, around, gram))
    cols = [c[order] for c in cols]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in cols[:5]], axis=0)
    cols = [c[new] for c in cols]
    repeat = np.zeros(len(cols[0]), bool)
    repeat[1:] = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1])
    return cols, repeat


def _by_document(cols: list[np.ndarray], side: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(id, key, start, end) of the surroundings of anchors, merged within each document."""
    _, _, ids, keys, pos, room = cols
    if not len(ids):
        return
    order = np.lexsort((pos, keys, ids))
    ids, keys, pos, room = ids[order], keys[order], pos[order], room[order]
    start, end = np.maximum(pos - side, 0), pos + np.minimum(GRAM + side, room)
    doc = np.cumsum(np.r_[False, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])])
    shift = doc * (int(end.max()) + 2)
    s, e = merged(start + shift, end + shift)
    at = np.searchsorted(start + shift, s)
    yield ids[at], keys[at], s - shift[at], e - shift[at]


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, carry: tuple[str, ...] | None = None) -> DataFrame:
    """Every text of `docs` without the bytes of strings of `length` bytes that start earlier in the corpus.

    Returns id_col, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, with `carry`,
    kept_text (the remaining bytes; those of a character cut apart are left out) and the string
    columns named. Earlier means a smaller id, or the same document and an earlier start; strings are
    judged on the input. Matches never cross documents. `length` is greater than GRAM.

    Null text counts as empty, and a text shorter than `length` loses nothing; a null id comes last;
    documents of equal id come in the order of their texts' hashes, and rows equal in id and text
    count as one document, so each keeps what one would; an empty table gives no rows; other columns
    are ignored. A very long text takes its task some 40 times its bytes while its grams are hashed.
    """
    text = text_or_empty(text_col)
    extra = carry or ()
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"), F.struct(F.col(id_col).cast("long").alias("id"), *extra).alias("own"))
    spans = repeats(keyed.select("id", "key", "text"), length)
    fields = [pa.field(id_col, pa.int64()), *(pa.field(n, pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")), pa.field("kept_sha256", pa.string())]
    schema = f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if carry is not None:
        fields += [pa.field(n, pa.string()) for n in ("kept_text", *extra)]
        schema += "".join(f", `{n}` string" for n in ("kept_text", *extra))

    @tidy
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for own, t, starts, ends in zip(*(b.column(i) for i in range(4))):
                data, own, s, e = zstandard.decompress(t.as_py()), own.as_py(), [], []
                if starts.is_valid:
                    s, e = (x.tolist() for x in merged(np.array(starts.as_py(), np.int64), np.array(ends.as_py(), np.int64)))
                kept = b"".join([data[a:z] for a, z in zip([0, *e], [*s, len(data)])])
                row = (own["id"], len(data), len(data) - len(kept), len(s), hashlib.sha256(kept).hexdigest())
                rows.append(row if carry is None else (*row, kept.decode("utf-8", "ignore"), *(own[n] for n in extra)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=pa.schema(fields))

    return _packed(keyed).join(spans, ["id", "key"], "left").select("own", "text", "starts", "ends").mapInArrow(remove, schema)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
