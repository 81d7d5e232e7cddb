"""BPE encoding and decoding over a table of distinct words.

Documents are taken in chunks of about `chunk_bytes` of text. A first pass splits each chunk into
words and sends the chunk's distinct words, packed, to buckets by word hash. A bucket sees all
occurrences of its words and encodes each distinct word once, then returns their ids to the
chunks. There ids join the words by position. For decoding, the distinct ids of each chunk are
joined to the table of pieces, and the chunk puts the pieces that come back in the order of its
ids. No stage holds more than a chunk, the vocabulary and a bounded table of words, and only
distinct words and ids of a chunk, not occurrences, shuffle.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions, table
from .words import _LONG, DEFAULT_VOCABULARY, WordCoder, byte_characters, keys_of

_LINK = "chunk string, bucket int, kind int, ids array<long>, lens binary, data binary"
#: Bytes that a row counts for beside its text, so that empty texts fill a chunk, too.
_ROW = 64
#: Blocks of ids in which chunks and pieces are joined.
BLOCKS = 16
_DIFFERS = "a chunk differs between two scans of the documents"
_ARROW = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("kind", pa.int32()), ("ids", pa.list_(pa.int64())), ("lens", pa.binary()), ("data", pa.binary())])


def _row(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{f.name: values.get(f.name) for f in _ARROW}], schema=_ARROW)


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, list, list[str]]]:
    """(chunk name, ids, texts). The name follows from ids and texts, so any scan that makes the same chunk names it alike."""
    ids, texts, size = [], [], 0
    name = lambda: hashlib.blake2b(b"".join([repr((i, len(t))).encode() + t.encode() for i, t in zip(ids, texts)]), digest_size=16).hexdigest()
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
        for i, t, n in zip(b.column(0).to_pylist(), b.column(1), sizes):
            if texts and size + n + _ROW > limit:
                yield name(), ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t.as_py() or "")
            size += n + _ROW
    if texts:
        yield name(), ids, texts


def _distinct(coder: WordCoder, texts: list[str], buckets: int) -> list[list[str]]:
    """The chunk's distinct keys by bucket, each bucket sorted."""
    seen: set[str] = set()
    for t in texts:
        for part in coder.segments(t)[::2]:
            seen.update(keys_of(part))
    out: list[list[str]] = [[] for _ in range(buckets)]
    crc = zlib.crc32
    for k in sorted(seen):
        out[crc(k.encode()) % buckets].append(k)
    return out


def _strings(data: bytes, lens: bytes) -> list[str]:
    text, out, at = zstandard.decompress(data), [], 0
    for n in np.frombuffer(lens, "<u4").tolist():
        out.append(text[at : at + n].decode())
        at += n
    return out


def _packed(texts: list[str]) -> dict:
    raw = [t.encode() for t in texts]
    joined = b"".join(raw)
    return {"lens": np.array([len(r) for r in raw], "<u4").tobytes(), "data": zstandard.ZstdCompressor(3).compress(joined)}


def piece_table(path: str) -> list[bytes]:
    """Bytes of every id, special tokens as their own text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    byte = {c: bytes([i]) for i, c in enumerate(byte_characters())}
    out = [b""] * t.get_vocab_size(with_added_tokens=True)
    special = set(t.get_added_tokens_decoder())
    for piece, i in t.get_vocab(with_added_tokens=True).items():
        out[i] = piece.encode() if i in special else b"".join(byte[c] for c in piece)
    return out


def joined_pieces(ids: DataFrame, path: str) -> DataFrame:
    """`ids` (chunk, ids: distinct ints) joined to their pieces by blocks of ids: (chunk, ids, pieces: array<binary>), up to BLOCKS rows a chunk.

    The blocks are as large as the vocabulary, whatever the corpus, and so is a chunk's part of them.
    """
    pieces = piece_table(path)
    size = -(-len(pieces) // BLOCKS)
    block = pa.table({"block": pa.array(range(BLOCKS), pa.int32()), "pieces": pa.array([pieces[i * size : (i + 1) * size] for i in range(BLOCKS)], pa.list_(pa.binary()))})
    of = lambda i: F.floor(i / size).cast("int")
    parts = F.transform(F.array(*[F.lit(i) for i in range(BLOCKS)]), lambda k: F.struct(k.alias("block"), F.filter("ids", lambda i: of(i) == k).alias("ids")))
    asked = ids.select("chunk", F.explode(parts).alias("p")).select("chunk", "p.block", "p.ids").filter(F.size("ids") > 0)
    met = asked.join(F.broadcast(ids.sparkSession.createDataFrame(block)), "block")
    return met.select("chunk", "ids", F.transform("ids", lambda i: F.element_at("pieces", i - F.col("block") * size + 1)).alias("pieces"))


def encode_decode(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = 32 << 20,
    keep: bool = False,
) -> DataFrame:
    """Token ids of every whole text, and the text decoded from them again.

    Returns id_col, n_tokens, ids_sha256, decoded_sha256 and, with `keep`, ids (binary, little-endian
    unsigned 32-bit) and decoded. Ids are those of the tokenizers library for the vocabulary at
    `path` without added special tokens; special strings inside a text are found as its default.

    Null text counts as empty (no tokens); null and repeated ids keep a row each; an empty table
    gives no rows; other columns are ignored. A very long text, of more than chunk_bytes, is a chunk
    of its own in one task.
    `docs` is scanned twice and must give the same partitions both times, as a table does;
    a chunk that differs between the scans raises an error.
    """
    buckets = partitions(docs)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordCoder.at(path)
        for name, _, texts in _chunks(batches, chunk_bytes):
            for bucket, keys in enumerate(_distinct(coder, texts, buckets)):
                if keys or not bucket:
                    yield _row(chunk=name, bucket=bucket, kind=1, **_packed(keys))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, known = WordCoder.at(path), {}
        for b in batches:
            for r in b.to_pylist():
                keys = _strings(r["data"], r["lens"])
                if len(known) > coder.limit:
                    known.clear()
                new = coder.encode_new(k for k in keys if k not in known)
                found = [known.get(k) or new[k] for k in keys]
                known.update((k, v) for k, v in new.items() if len(k) <= _LONG)
                joined = b"".join(found)
                lens = np.array([len(f) // 4 for f in found], "<u4").tobytes()
                yield _row(chunk=r["chunk"], bucket=r["bucket"], kind=2, ids=np.unique(np.frombuffer(joined, "<u4")).tolist(), lens=zstandard.compress(lens), data=zstandard.compress(joined))

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, texts in _chunks(batches, chunk_bytes):
            yield _row(chunk=name, kind=0, ids=ids, **_packed(texts))

    out_schema = f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if keep else 4]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]

    def finish(t: pa.Table) -> pa.Table:
        coder, pieces = WordCoder.at(path), {}
        for r in t.filter(pc.equal(t["kind"], 3)).to_pylist():
            ends = np.cumsum(np.frombuffer(r["lens"], "<u4")).tolist()
            pieces |= {i: r["data"][z - n : z] for i, n, z in zip(r["ids"], np.frombuffer(r["lens"], "<u4").tolist(), ends)}
        rows = t.filter(pc.not_equal(t["kind"], 3)).to_pylist()
        doc = [r for r in rows if r["kind"] == 0]
        coded = {r["bucket"]: r for r in rows if r["kind"] == 2}
        if not doc:
            raise RuntimeError(_DIFFERS)
        texts, known = _strings(doc[0]["data"], doc[0]["lens"]), {}
        for bucket, keys in enumerate(_distinct(coder, texts, buckets)):
            if not keys:
                continue
            if bucket not in coded:
                raise RuntimeError(_DIFFERS)
            ids, at = zstandard.decompress(coded[bucket]["data"]), 0
            for k, n in zip(keys, np.frombuffer(zstandard.decompress(coded[bucket]["lens"]), "<u4").tolist(), strict=True):
                known[k] = ids[at : (at := at + 4 * n)]
        get, piece, cols = known.__getitem__, pieces.__getitem__, [[] for _ in names]
        for i, text in zip(doc[0]["ids"] * len(doc), texts * len(doc)):
            ids = b"".join([b"".join(map(get, keys_of(p))) if n % 2 == 0 else coder.specials[p] for n, p in enumerate(coder.segments(text))])
            back = b"".join(map(piece, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
            for c, v in zip(cols, (i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), ids, back)):
                c.append(v)
        return pa.table([pa.array(c, k) for c, k in zip(cols, types)], names=names)

    coded = cut(source.mapInArrow(words, _LINK).repartition(buckets, "bucket").mapInArrow(encode, _LINK))
    specials = F.array(*[F.lit(i) for i in special_ids(path)]).cast("array<int>")
    used = coded.groupBy("chunk").agg(F.array_union(F.flatten(F.collect_list(F.col("ids").cast("array<int>"))), specials).alias("ids"))
    pieces = joined_pieces(used, path).mapInArrow(_flat, _LINK)
    both = coded.withColumn("ids", F.lit(None).cast("array<long>")).unionByName(pieces).unionByName(source.mapInArrow(texts_of, _LINK))
    return both.groupBy("chunk").applyInArrow(finish, out_schema)


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (chunk, ids, pieces) with the pieces one behind the other."""
    for b in batches:
        for r in b.to_pylist():
            yield _row(chunk=r["chunk"], kind=3, ids=r["ids"], lens=np.array([len(p) for p in r["pieces"]], "<u4").tobytes(), data=b"".join(r["pieces"]))


def special_ids(path: str) -> list[int]:
    return [int.from_bytes(i, "little") for i in WordCoder.at(path).specials.values()]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(DEFAULT_VOCABULARY))
