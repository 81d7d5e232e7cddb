"""Words of byte-level BPE: whole texts cut where no token can cross, each distinct word encoded once.

A text is cut at special tokens, then at white space. Where every white-space character stands
alone between two other characters and is a space or a line feed, a space belongs to the word
after it and a line feed is a word of its own; other stretches go through the vocabulary's own
split pattern. Either way the ids of a text are its words' ids in order.

Words are kept under keys that save a copy: the word " x" is kept as "x", any other word w
(and a space that stands alone or before another space) as " " + w.
"""

from __future__ import annotations

import array
import json
import os
from collections.abc import Iterable

import public_tokenizers
import regex

#: White space other than space and line feed, by any definition of white space.
_OTHER = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_OTHER_WIDE = "\x85\xa0\u1680\u180e\u2028\u2029\u202f\u205f\u2060\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200C)))
_PATTERN = regex.compile(public_tokenizers.PATTERN)

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: Words that a coder remembers, and the longest of them in characters.
LIMIT = 200_000
_LONG = 64


def keys_of(segment: str) -> list[str]:
    """The keys of a text without special tokens, in order."""
    if not segment:
        return []
    out = None if any(c in segment for c in _OTHER) or not segment.isascii() and any(c in segment for c in _OTHER_WIDE) else []
    if out is not None:
        for line in segment.split("\n"):
            parts = line.split(" ")
            if "" in parts:  # white space beside white space or at an end
                out = None
                break
            parts[0] = " " + parts[0]
            out += parts
            out.append(" \n")
    if out is None:
        return [w[1:] if w[0] == " " and len(w) > 1 and w[1] != " " else " " + w for w in _PATTERN.findall(segment)]
    out.pop()
    return out


def word_of(key: str) -> str:
    return key[1:] if key[0] == " " else " " + key


class WordCoder:
    """Encodes words with the tokenizers library, each once while it is remembered.

    Words of up to _LONG characters are remembered, `limit` of them; beyond it the table starts
    anew, which costs time only. One coder lives in each Python worker for each vocabulary, and
    forget() empties it, as tasks do at their end.
    """

    _made: dict[str, WordCoder] = {}

    def __init__(self, path: str, limit: int = LIMIT) -> None:
        self.path, self.limit, self.table = path, limit, {}
        self.specials = self._load()
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def _load(self) -> dict[str, bytes]:
        """Special tokens' ids; makes what encodes words."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(self.path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        return {t.content: i.to_bytes(4, "little") for i, t in self.tokenizer.get_added_tokens_decoder().items()}

    def forget(self) -> None:
        self.table.clear()

    @classmethod
    def at(cls, path: str) -> WordCoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def segments(self, text: str) -> list[str]:
        """Ordinary text and special tokens by turns, ordinary text first and last."""
        if self._special is None or not self._special.search(text):
            return [text]
        return self._special.split(text)

    def encode_new(self, keys: Iterable[str]) -> dict[str, bytes]:
        """Ids of each key as little-endian 32-bit integers; keys hold no special token."""
        keys = list(keys)
        found = self.tokenizer.encode_batch_fast([word_of(k) for k in keys], add_special_tokens=False)
        return {k: array.array("I", e.ids).tobytes() for k, e in zip(keys, found)}

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes; what an encode of the whole text gives."""
        if len(self.table) > self.limit:
            self.table.clear()
        table = self.table
        split = [[(part, None if i % 2 else keys_of(part)) for i, part in enumerate(self.segments(t))] for t in texts]
        new = self.encode_new({k for doc in split for _, keys in doc for k in keys or () if k not in table})
        out = [b"".join([self.specials[part] if keys is None else b"".join([table.get(k) or new[k] for k in keys]) for part, keys in doc]) for doc in split]
        table.update((k, v) for k, v in new.items() if len(k) <= _LONG)
        return out


class RankWordCoder(WordCoder):
    """The same ids from the same vocabulary through its merge ranks, several times as fast.

    Holds for byte-level vocabularies whose ids follow their merges, as follows_merges() tells; the
    tests hold it against the tokenizers library.
    """

    _made: dict[str, RankWordCoder] = {}

    def _load(self) -> dict[str, bytes]:
        import tiktoken

        with open(self.path, encoding="utf-8") as f:
            file = json.load(f)
        if not follows_merges(file):
            raise ValueError(f"{self.path}: not a byte-level vocabulary whose ids follow its merges")
        to_byte = {c: b for b, c in enumerate(byte_characters())}
        self.ranks = {bytes(to_byte[c] for c in piece): i for piece, i in file["model"]["vocab"].items()}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self._core = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})._core_bpe
        self._encode = self._core.encode_ordinary
        self.table = _Filling(self.encode_key)
        return {t["content"]: t["id"].to_bytes(4, "little") for t in file["added_tokens"]}

    def encode_new(self, keys: Iterable[str]) -> dict[str, bytes]:
        return {k: self.encode_key(k) for k in keys}

    def encode_key(self, key: str) -> bytes:
        return array.array("I", self._encode(key[1:] if key[0] == " " else " " + key)).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.table) > self.limit:
            self.table.clear()
        get, out = self.table.__getitem__, []
        for text in texts:
            parts = self.segments(text)
            out.append(b"".join([b"".join(map(get, keys_of(part))) if i % 2 == 0 else self.specials[part] for i, part in enumerate(parts)]))
        return out


class _Filling(dict):
    """A table that makes a missing entry itself, and keeps it unless its key is long."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= _LONG:
            self[key] = value
        return value


def follows_merges(file: dict) -> bool:
    """Whether a vocabulary file is byte-level BPE as RankWordCoder takes it: every id is the place of a byte or of its merge, special tokens apart."""
    model, before = file["model"], file.get("pre_tokenizer") or {}
    vocabulary = model.get("vocab", {})
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    split = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not file.get("normalizer")
    if not (plain and split and all(c in vocabulary for c in byte_characters())):
        return False
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in file.get("added_tokens", [])):
        return False
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    made = [vocabulary.get(a + b, -1) for a, b in merges]
    special = {t["content"] for t in file.get("added_tokens", [])}
    return sorted(made) == made and sorted([*made, *(vocabulary[c] for c in byte_characters())]) == sorted(i for c, i in vocabulary.items() if c not in special)


def byte_characters() -> list[str]:
    """The character by which byte-level vocabularies write each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def batched(texts: list[str | None], limit: int = 4 << 20) -> Iterable[tuple[int, list[str]]]:
    """(first index, texts) of runs of about `limit` characters at most, so memory follows the run, not the batch."""
    start, size, run = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if run and size + len(t) > limit:
            yield start, run
            start, size, run = i, 0, []
        run.append(t)
        size += len(t)
    if run:
        yield start, run


def coder_for(path: str) -> WordCoder:
    """This worker's coder of the vocabulary: through merge ranks where its ids follow them, else the library's."""
    if path in RankWordCoder._made or path in WordCoder._made:
        return RankWordCoder._made.get(path) or WordCoder._made[path]
    try:
        return RankWordCoder.at(path)
    except ValueError:
        return WordCoder.at(path)
