"""Token counts by prefix dynamic programming.

For a word, let last[i] be the last token of the encoding of its first i bytes. An encoding of a
prefix ends in token t exactly if t is a suffix of it and either is all of it or stands well after
last[i - len(t)], that is if those two tokens alone encode to themselves. So one pass over a word
gives the exact count at every prefix: count[i] = count[i - len(t)] + 1. A text's count at any
prefix is the counts of the words before and one entry of the last word's table; limits and
budgets are answered from these tables without encoding anything again.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from itertools import islice
from operator import itemgetter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .words import _LONG, _PATTERN, DEFAULT_VOCABULARY, LIMIT, RankWordCoder, batched, keys_of, word_of


#: Words of up to so many bytes take the pass together, one column of bytes at a time.
_WIDE = 24
_SLOTS = 1 << 19
_PAIRS = 1 << 21
_LAST_COUNT = itemgetter(-1)


class PrefixCounter(RankWordCoder):
    """Tables of token counts at every prefix of a word, in UTF-8 bytes."""

    _made: dict[str, PrefixCounter] = {}

    def __init__(self, path: str, limit: int = LIMIT) -> None:
        super().__init__(path, limit)
        self.table, self._parts = {}, {}
        self._longest = max(map(len, self.ranks))
        self._single = self._core.encode_single_piece
        self._pair_keys, self._pair_ok, self._pairs = np.full(_PAIRS, -1, np.int64), np.zeros(_PAIRS, bool), 0
        short = [p for p in self.ranks if len(p) <= _WIDE]
        hashes = self._hashes(short)
        self._slot_hash, self._slot_id, self._probes = np.zeros(_SLOTS, np.uint64), np.full(_SLOTS, -1, np.int64), 1
        for piece, h in zip(short, hashes.tolist()):
            at = h % _SLOTS
            for step in range(_SLOTS):
                if self._slot_id[at] < 0:
                    break
                at = (at + 1) % _SLOTS
            self._probes = max(self._probes, step + 1)
            self._slot_hash[at], self._slot_id[at] = h, self.ranks[piece]

    @staticmethod
    def _step(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
        h = (h ^ (byte.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    def _hashes(self, pieces: list[bytes]) -> np.ndarray:
        size = np.array(list(map(len, pieces)))
        data = np.frombuffer(b"".join(p.ljust(_WIDE, b"\0") for p in pieces), np.uint8).reshape(-1, _WIDE)
        h, out = np.zeros(len(pieces), np.uint64), np.zeros(len(pieces), np.uint64)
        for i in range(_WIDE):
            h = self._step(h, data[:, i])
            out[size == i + 1] = h[size == i + 1]
        return out

    def _tokens(self, h: np.ndarray) -> np.ndarray:
        """The token of each hash, -1 if none has it."""
        at = (h % np.uint64(_SLOTS)).astype(np.int64)
        out = np.where(self._slot_hash[at] == h, self._slot_id[at], -1)
        for step in range(1, self._probes):
            again = np.flatnonzero((out < 0) & (self._slot_id[at] >= 0))
            if not len(again):
                break
            at[again] = (at[again] + 1) % _SLOTS
            out[again] = np.where(self._slot_hash[at[again]] == h[again], self._slot_id[at[again]], -1)
        return out

    def _stand(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether each two tokens, side by side, encode to themselves."""
        key = first * (1 << 20) + second
        at = self._pair_place(key)
        new = np.unique(key[self._pair_keys[at] != key])
        if len(new):
            self._pairs += len(new)
            if self._pairs > _PAIRS // 2:
                self._pair_keys[:], self._pairs = -1, 0
                return self._stand(first, second)
            single, piece = self._single, self.bytes_of
            ok = [single(piece[x] + piece[y]) == [x, y] for x, y in zip((new >> 20).tolist(), (new & ((1 << 20) - 1)).tolist())]
            left, ok = new, np.array(ok)
            while len(left):
                where = self._pair_place(left)
                self._pair_keys[where] = left
                won = self._pair_keys[where] == left
                self._pair_ok[where[won]] = ok[won]
                left, ok = left[~won], ok[~won]
            at = self._pair_place(key)
        return self._pair_ok[at]

    def _pair_place(self, key: np.ndarray) -> np.ndarray:
        """The slot of each pair, or the first free one where it belongs."""
        with np.errstate(over="ignore"):
            at = ((key * np.int64(0x1E3779B97F4A7C15)) >> np.int64(20)) & (_PAIRS - 1)
        while True:
            held = self._pair_keys[at]
            other = np.flatnonzero((held != key) & (held != -1))
            if not len(other):
                return at
            at[other] = (at[other] + 1) & (_PAIRS - 1)

    def _together(self, pieces: list[bytes]) -> list[bytes]:
        """Tables of words of one length, from 1 to _WIDE bytes: the pass over all of them at once."""
        n, size = len(pieces), len(pieces[0])
        data = np.frombuffer(b"".join(pieces), np.uint8).reshape(n, size)
        count, last = np.zeros((n, size + 1), np.uint8), np.zeros((n, size + 1), np.int64)
        for start in range(size):
            h = np.zeros(n, np.uint64)
            for end in range(start + 1, size + 1):
                h = self._step(h, data[:, end - 1])
                token = self._tokens(h)
                rows = np.flatnonzero(token >= 0)
                if start and len(rows):
                    rows = rows[self._stand(last[rows, start], token[rows])]
                count[rows, end], last[rows, end] = count[rows, start] + 1, token[rows]
        joined = np.ascontiguousarray(count[:, 1:]).tobytes()
        return [joined[i : i + size] for i in range(0, n * size, size)]

    def forget(self) -> None:
        self.table.clear()
        self._parts.clear()

    def prefixes(self, piece: bytes) -> list[int]:
        """Tokens in each prefix of a word that the split pattern leaves whole, from 1 byte to all."""
        known = self._parts.get(piece)
        if known is not None:
            return list(known)
        rank, longest, single, piece_of = self.ranks.get, self._longest, self._single, self.bytes_of
        count, last, stands = [0], [-1], {}
        for i in range(1, len(piece) + 1):
            for j in range(max(0, i - longest), i):
                t = rank(piece[j:i])
                if t is None:
                    continue
                if j:
                    both = (last[j], t)
                    if both not in stands:
                        stands[both] = single(piece_of[both[0]] + piece_of[t]) == [*both]
                    if not stands[both]:
                        continue
                count.append(count[j] + 1)
                last.append(t)
                break
        if len(piece) <= _WIDE:
            self._parts[piece] = bytes(count[1:])
        return count[1:]

    def encode_new(self, keys: Iterable[str]) -> dict:
        """The table of each key; words that are new take the pass together, by length."""
        parts, out, mixed = self._parts, {}, {}
        if len(parts) > self.limit:
            parts.clear()
        by_size: dict[int, tuple[list[str], list[bytes]]] = {}
        fresh: set[bytes] = set()
        for k in keys:
            if k.isalpha():
                w = (" " + k).encode()
                if len(w) <= _WIDE:
                    names, words = by_size.setdefault(len(w), ([], []))
                    names.append(k)
                    words.append(w)
                else:
                    mixed[k] = [w]
            else:
                mixed[k] = ws = [w.encode() for w in _PATTERN.findall(word_of(k))]
                fresh.update(w for w in ws if len(w) <= _WIDE and w not in parts)
        for names, words in by_size.values():
            for at in range(0, len(words), 1 << 15):
                out.update(zip(names[at : at + (1 << 15)], self._together(words[at : at + (1 << 15)])))
        sized: dict[int, list[bytes]] = {}
        for w in fresh:
            sized.setdefault(len(w), []).append(w)
        for words in sized.values():
            for at in range(0, len(words), 1 << 15):
                some = words[at : at + (1 << 15)]
                parts.update(zip(some, self._together(some)))
        for k, ws in mixed.items():
            counts = list(parts.get(ws[0]) or self.prefixes(ws[0]))
            for w in ws[1:]:
                done = counts[-1]
                counts += [done + n for n in parts.get(w) or self.prefixes(w)]
            out[k] = bytes(counts) if counts[-1] < 256 else np.array(counts, np.uint32)
        return out

    def count(self, texts: list[str], limit: int) -> list[tuple[int, int]]:
        """(tokens, bytes of the longest whole-character prefix with at most `limit` tokens) of each text."""
        if len(self.table) > self.limit:
            self.table.clear()
        table = self.table
        split = [[(part, None if i % 2 else keys_of(part)) for i, part in enumerate(self.segments(t))] for t in texts]
        new: set[str] = set()
        for doc in split:
            for _, keys in doc:
                if keys is not None:
                    new.update(keys)
        new.difference_update(table)
        table.update(self.encode_new(new))
        out = [self._cut(text, doc, limit) for text, doc in zip(texts, split)]
        for k in new:
            if len(k) > _LONG:
                del table[k]
        return out

    def _cut(self, text: str, doc: list[tuple[str, list[str] | None]], limit: int) -> tuple[int, int]:
        """Up to the word that passes the limit, prefixes that end with a word fit; those after it are counted one by one.

        A prefix that ends in a word has more tokens than the text up to the word before the last,
        so two words further none fits any more.
        """
        get = self.table.__getitem__
        total = int(sum([1 if keys is None else sum(map(_LAST_COUNT, map(get, keys))) for _, keys in doc]))
        if total <= limit:
            return total, len(text.encode())
        words = ((part, 1) if keys is None else (word_of(k), int(get(k)[-1])) for part, keys in doc for k in (keys if keys is not None else [part]))
        near, done, at = deque(), 0, 0
        for w, n in words:
            if done + n > limit:
                break
            near.append((w, n))
            done, at = done + n, at + len(w.encode())
            if len(near) > 3:
                near.popleft()
        before = "".join([x for x, _ in near])
        tail = "".join([before, w, *(x for x, _ in islice(words, 2))])
        counts = self.counts_at_characters(tail)[len(before) :] + (done - sum(n for _, n in near))
        fits = np.flatnonzero(counts <= limit)
        return total, at + len(tail[len(before) : len(before) + (int(fits[-1]) + 1 if len(fits) else 0)].encode())

    def counts_at_characters(self, text: str) -> np.ndarray:
        """The token count of text[:i] for i from 1 to len(text), as an encode of each prefix gives it.

        Word tables hold save where a prefix's last word splits otherwise than the whole text's:
        in a contraction, in white space before a word and inside a special token.
        Those few prefixes are counted from their last two words.
        """
        out, done = [], 0
        for i, part in enumerate(self.segments(text)):
            if i % 2:
                tail = before[-1] if before else ""
                base = done - (self._plain(tail) if tail else 0)
                out += [base + self._plain(tail + part[:n]) for n in range(1, len(part))] + [done + 1]
                done, before = done + 1, []
                continue
            before = _PATTERN.findall(part)
            for n, w in enumerate(before):
                known = self.table.get(w[1:] if w[0] == " " and len(w) > 1 and w[1] != " " else " " + w)
                counts, at = self.prefixes(w.encode()) if known is None else known, 0
                prior = before[n - 1] if n and before[n - 1].isspace() else ""
                for m, c in enumerate(w, 1):
                    at += len(c.encode())
                    if m < len(w) and w[0] == "'" and m > 1:
                        out.append(done + self._plain(w[:m]))
                    elif prior and m == 1 and c.isspace():
                        out.append(done - self._plain(prior) + self._plain(prior + c))
                    else:
                        out.append(done + counts[at - 1])
                done += int(counts[-1])
        return np.array(out, np.int64)

    def _plain(self, text: str) -> int:
        return len(self._encode(text))


def token_counts(
    docs: DataFrame,
    path: str,
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
    every_prefix: bool = False,
) -> DataFrame:
    """Tokens of every whole text, whether they pass `limit`, and where the text would be cut for it.

    Returns id_col, n_bytes, n_tokens, over_limit, limit_bytes (of the longest prefix with at most
    `limit` tokens) and, with every_prefix, prefix_counts (array<long>: the count at each character).
    Counts are those of the tokenizers library without added special tokens.

    Null text counts as empty (0 tokens); null and repeated ids keep a row each; an empty table
    gives no rows; other columns are ignored. A very long text is counted whole, in its task's
    memory. `path` must hold a byte-level vocabulary whose ids follow its merges; any other is
    refused. No shuffle takes place.
    """
    schema = f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean, limit_bytes long" + ", prefix_counts array<long>" * every_prefix
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64())]
    names = [id_col, "n_bytes", "n_tokens", "over_limit", "limit_bytes", "prefix_counts"][: 6 if every_prefix else 5]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PrefixCounter.at(path)
        for b in batches:
            ids = b.column(0).to_pylist()
            for first, texts in batched(b.column(1).to_pylist()):
                rows = []
                for i, text, (n, fits) in zip(ids[first:], texts, coder.count(texts, limit)):
                    size = fits if n <= limit else len(text.encode())
                    row = (i, size, n, n > limit, fits)
                    rows.append((*row, coder.counts_at_characters(text).tolist()) if every_prefix else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        coder.forget()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(count, schema)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(DEFAULT_VOCABULARY))
