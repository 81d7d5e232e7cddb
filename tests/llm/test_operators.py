"""Each operator against brute force on texts with nulls, empties, copies, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("quarrygraph.llm")

from tokenizers import Tokenizer

from quarrygraph.llm import bpe, chat, exact_dedup, language, packing, quality, simhash, suffix_dedup, token_counts, url_filter
from quarrygraph.llm.common import components
from quarrygraph.llm.words import DEFAULT_VOCABULARY, RankWordCoder, WordCoder

PATH = public_tokenizers.path(DEFAULT_VOCABULARY)
WHITE = r"[\x20\x09-\x0D]"
random.seed(11)
VOCAB = ["".join(random.choice("abcdefgh") for _ in range(random.randint(1, 7))) for _ in range(300)]


def words(n):
    return " ".join(random.choice(VOCAB) for _ in range(n))


PASSAGE = words(60)
BASE = words(300)
NEAR = " ".join("changed" if i in (40, 170) else w for i, w in enumerate(BASE.split(" ")))
TEXTS = [
    (1, "Hello world.\nHello world.\nShort"), (2, None), (3, ""), (4, "a b"), (4, "a b"), (5, "a  b"), (6, " \t\n\x0b "), (7, BASE), (8, NEAR), (9, BASE), (10, BASE + " "),
    (11, words(50) + PASSAGE + words(20)), (12, words(30) + "\n" + PASSAGE), (13, PASSAGE), (14, "é日本 🙂 <|endoftext|> it's 're"), (15, "For " * 800), (16, "x" * 5000),
    (None, "no id here"), (18, words(2000)), (19, "### $$$ *** %%% " * 20), (20, "one two three four five six seven eight nine ten eleven"), (21, "Hello\x00world\x1c\x85 ok"),
]
CLASHING = ["id", "row", "key", "fp", "size", "group", "bucket", "n", "hit", "words", "starts", "own", "kept", "label"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, ["en", "de", None][k % 3]) for k, (i, t) in enumerate(TEXTS)], "doc_id long, text string, lang string").repartition(3)
    df = df.select("*", *[F.lit("clash").alias(c) for c in CLASHING])
    df.write.mode("overwrite").parquet(path := spark.conf.get("spark.checkpoint.dir") + "/docs")
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_word_coders_match_the_library():
    t = Tokenizer.from_file(PATH)
    parts = ["a", " ", "  ", "\n", "\t", "'s", "'re", "1", ".", "é", "<|endoftext|>", "<|", "日本", "🙂", "\x85", "\x1c", " the", "Quick"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 10))) for _ in range(3000)] + [t or "" for _, t in TEXTS]
    want = [array("I", e.ids).tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    assert WordCoder(PATH).ids(texts) == want and RankWordCoder(PATH).ids(texts) == want


def test_bpe_round_trip(docs, none):
    t = Tokenizer.from_file(PATH)
    want = []
    for i, text in TEXTS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    cols = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert rows(bpe.encode_decode(docs, PATH), *cols) == sorted(want, key=repr)
    assert rows(bpe.encode_decode(docs, PATH, chunk_bytes=1), *cols) == sorted(want, key=repr)
    assert rows(bpe.encode_decode(docs, PATH, keep=True), "doc_id", "decoded") == sorted([(i, x or "") for i, x in TEXTS], key=repr)
    assert bpe.encode_decode(none, PATH).count() == 0


def test_prefix_counts(docs, none):
    t = Tokenizer.from_file(PATH)
    count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    got = token_counts.token_counts(docs, PATH, limit=40)
    assert rows(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted([(i, len((x or "").encode()), count(x or ""), count(x or "") > 40) for i, x in TEXTS], key=repr)
    by_id = {r.doc_id: r.limit_bytes for r in got.collect()}
    for i in (7, 14, 16, 18):
        text = dict(TEXTS)[i]
        cut = text.encode()[: by_id[i]].decode()
        assert count(cut) <= 40
    c = token_counts.PrefixCounter(PATH)
    for x in ["it's 're  ok\n\n x", "<|endoftext|>a <|endo", "Unbelievable  things", "x" * 40, "日本語 é", " \t a"]:
        assert c.counts_at_characters(x).tolist() == [count(x[: k + 1]) for k in range(len(x))]
    mixed = ["a", " ", "  ", "\n", "\t", "'s", "'re", "'", "1", "..", "é", "<|endoftext|>", "<|", "日本", "🙂", " the", "word", "it's", "end"]
    for x in ["".join(random.choice(mixed) for _ in range(random.randint(1, 14))) for _ in range(500)] + [" ..\n\né 'rewordit'sit's"]:
        counts = [0] + [count(x[: k + 1]) for k in range(len(x))]
        for limit in (0, 1, 2, 5):
            assert c.count([x], limit)[0] == (counts[-1], len(x[: max(k for k, n in enumerate(counts) if n <= limit)].encode()))
    pieces = [bytes(random.choice(b"etaonishr") for _ in range(random.randint(1, 20))) for _ in range(400)]
    for p in pieces:
        assert c._together([p])[0][-1] == count(p.decode()) and list(c._together([p])[0]) == c.prefixes(p)
    assert token_counts.token_counts(none, PATH).count() == 0


def test_packing(docs, none):
    t = Tokenizer.from_file(PATH)
    got = packing.pack(docs, PATH, capacity=64, keep_ids=True).collect()
    by_seq, seen = defaultdict(list), defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append(r)
        seen[r.doc_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    for i, text in TEXTS:
        if i == 4:
            continue
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        p = sorted(seen[i], key=lambda r: r.piece)
        assert b"".join(r.ids for r in p) == array("I", ids).tobytes() and [r.piece for r in p] == list(range(len(p)))
        assert len(p) == 1 if len(ids) <= 64 else all(r.length == 64 for r in p[1:])
        assert [r.start for r in p] == [sum(x.length for x in p[:k]) for k in range(len(p))]
    total = sum(r.length for r in got)
    assert len(by_seq) <= -(-total // 64) + 3
    assert len([r for r in got if r.doc_id == 4]) == 2
    assert packing.pack(none, PATH).count() == 0


def test_packing_plans():
    for _ in range(200):
        counts = {random.randint(1, 64): random.randint(1, 9) for _ in range(random.randint(0, 20))}
        got = defaultdict(int)
        for used, times in packing.plan(counts, 64):
            assert sum(used) <= 64 and times > 0
            for n in used:
                got[n] += times
        assert got == counts


def brute_suffix(texts, length):
    order = sorted({(i if i is not None else 2**63, t or "") for i, t in texts})
    seen, out = set(), {}
    for i, t in order:
        b = t.encode()
        cover = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                cover[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, c in zip(b, cover) if not c)
        spans = sum(1 for k in range(len(b)) if cover[k] and (not k or not cover[k - 1]))
        out[i, t] = (len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length", [40, 100])
def test_suffix_dedup(docs, none, length):
    want = brute_suffix(TEXTS, length)
    expected = [(i, *want[i if i is not None else 2**63, t or ""]) for i, t in TEXTS]
    got = suffix_dedup.suffix_dedup(docs, length=length)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(expected, key=repr)
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_suffix_dedup_of_common_grams(docs, spark, monkeypatch):
    """With every repeated gram dealt as a common one, the result is the same."""
    monkeypatch.setattr(suffix_dedup, "COMMON", 2)
    monkeypatch.setattr(suffix_dedup, "COMMON_SHARE", 1e-5)
    line = "this very line of some eighty or ninety bytes stands in a good many of all documents ok\n"
    long = "and here comes a passage of well over one hundred bytes, which a good many of the documents share as a whole, too\n"
    texts = [(i, words(30) + "\n" + (line if i % 2 else long) + words(30)) for i in range(60)] + list(TEXTS)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    spaces = spark.conf.get("spark.checkpoint.dir") + "/common"
    df.write.mode("overwrite").parquet(spaces)
    df = spark.read.parquet(spaces)
    keyed = df.select(F.coalesce("doc_id", F.lit(1)).alias("id"), F.lit(0).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    assert len(suffix_dedup.common_grams(keyed, 100)[0]) > 5
    want = brute_suffix(texts, 100)
    expected = [(i, *want[i if i is not None else 2**63, t or ""]) for i, t in texts]
    assert rows(suffix_dedup.suffix_dedup(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(expected, key=repr)


@pytest.mark.parametrize("common", [False, True])
def test_suffix_dedup_of_repeated_rows(spark, monkeypatch, common):
    """Rows equal in id and text, with an id or without one, keep what a single one would."""
    if common:
        monkeypatch.setattr(suffix_dedup, "COMMON", 2)
        monkeypatch.setattr(suffix_dedup, "COMMON_SHARE", 1e-5)
    alone, odd, shared = words(80), words(80), words(40)
    part = words(30) + shared + words(30)
    texts = [(1, alone), (1, alone), (None, odd), (None, odd), (2, part), (2, part), (3, words(20) + shared), (4, words(25) + shared), (4, words(10)), (1, alone)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    df.write.mode("overwrite").parquet(place := spark.conf.get("spark.checkpoint.dir") + "/repeated")
    want = brute_suffix(texts, 100)
    expected = [(i, *want[i if i is not None else 2**63, t]) for i, t in texts]
    assert sum(e[2] == 0 for e in expected) >= 7 and sum(e[2] > 0 for e in expected) == 2
    got = suffix_dedup.suffix_dedup(spark.read.parquet(place))
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(expected, key=repr)


def test_suffix_dedup_of_texts_alike_in_part_of_a_hash(spark):
    """Texts without an id whose hashes share 31 bits keep their own bytes."""
    shared, seen, pairs = words(40), {}, []
    for n in range(250_000):
        t = ("%s %d" % (words(12), n)).ljust(60, ".")
        whole = (t + shared if n % 2 else t + words(60))
        k = xxhash.xxh64_intdigest(whole.encode(), 42) % 2**31
        if k in seen and seen[k][0] != n % 2:
            pairs.append((seen[k][1], whole))
        seen[k] = (n % 2, whole)
    assert pairs
    texts = [(1, shared), *((None, t) for p in pairs for t in p)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    df.write.mode("overwrite").parquet(place := spark.conf.get("spark.checkpoint.dir") + "/alike")
    got = {r.kept_text: r.n_removed for r in suffix_dedup.suffix_dedup(spark.read.parquet(place), carry=()).collect()}
    plain = [t for p in pairs for t in p if shared not in t]
    assert all(got.get(t) == 0 for t in plain) and sum(n > 0 for n in got.values()) == len(pairs)


def test_column_construction():
    """Windows found repeated are those an earlier string has at the same column."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        n, width, length = int(rng.integers(1, 30)), 14, 5
        s = rng.integers(0, 2, (n, width)).astype(np.int16)
        s[rng.random((n, width)) < 0.05] = -1
        rank = rng.permutation(n)
        got = suffix_dedup.repeated_windows(s, rank, length, 6)
        for i in range(n):
            for j in range(6):
                w = s[i, j : j + length]
                want = (w >= 0).all() and any(rank[k] < rank[i] and (s[k, j : j + length] == w).all() for k in range(n))
                assert got[i, j] == want


def test_exact_dedup(docs, none):
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[re.sub(WHITE, "", t or "")].append((-len(t or ""), i if i is not None else 2**63, i))
    want = []
    for norm, g in groups.items():
        best = min(g)[2]
        left = True
        for n, k, i in sorted(g):
            want.append((i, best, len(g), left and i == best, hashlib.sha256(norm.encode()).hexdigest()))
            left = left and i != best
    got = exact_dedup.exact_dedup(docs)
    assert rows(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    assert rows(exact_dedup.exact_dedup(docs, max_filter_bytes=512), "doc_id", "kept") == rows(got, "doc_id", "kept")
    assert exact_dedup.exact_dedup(none).count() == 0


def plain_fingerprint(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(docs, none):
    prints = [(i, plain_fingerprint(t, 3)) for i, t in TEXTS]
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        r = find(k)
        least[r] = min(x for x in (least.get(r), i) if x is not None) if not (least.get(r) is None and i is None) else None
    want = [(i, format(fp, "016x"), least[find(k)]) for k, (i, fp) in enumerate(prints)]
    got = simhash.near_duplicates(docs, words=3, radius=2)
    assert rows(got, "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)
    assert simhash.near_duplicates(none).count() == 0


def test_ball_hashing_finds_every_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, np.int64)
    far = [int(x) ^ sum(1 << int(b) for b in rng.choice(63, k, replace=False)) for x in base for k in (1, 2, 3)]
    fps = sorted({*map(int, base), *far})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r.node: r.root for r in components(simhash.links(df, 2)).collect()}
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 2 and a != b:
                assert got[a] == got[b]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[k] == 100 for k in range(100, 140)) and len(got) == 101
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_groups(spark):
    rng = random.Random(2)
    texts, want = [], []
    for g in range(12):
        w = words(400).split(" ")
        for k in range(4):
            # Each replaced word changes five of some 400 shingles: similarity 0.9 and more to the original.
            at = set(rng.sample(range(400), 2)) if k else ()
            texts.append(" ".join("zz%d" % rng.randint(0, 10**6) if i in at else x for i, x in enumerate(w)))
            want.append(g)
    texts += [words(200) for _ in range(30)] + ["", None, "two words"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(3)
    group = {r.id: r.group for r in simhash.similar_groups(df, "i").collect()}
    assert all(group[i] == 4 * (i // 4) for i in range(48))
    assert all(group[i] == i for i in range(48, 78)) and group[78] == group[79] == 78 and group[80] == 80
    assert simhash.similar_groups(df.limit(0), "i").count() == 0


def test_shingle_sets_and_signatures():
    """Hashes stand for shingles one for one, and signature bits are majorities over them."""
    vocabulary = ["w%d" % i for i in range(30)] + ["A", "é", "日本", "x" * 70_000]
    rng = random.Random(6)
    texts = ["", "a", " a \n b ", "x " * 70_000] + [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    h, bounds = simhash.shingle_sets(texts, 5)
    plain = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        plain.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    got = [set(h[a:z].tolist()) for a, z in zip(bounds, bounds[1:])]
    for a in range(len(texts)):
        for b in range(0, a + 1):
            assert len(got[a] & got[b]) == len(plain[a] & plain[b])
    many = np.arange(70_000, dtype=np.uint64)
    sig = simhash.signatures(texts, 5, 128)
    for i in (1, 10, 50):
        for t in range(2):
            ones = np.unpackbits(simhash._mixed(h[bounds[i] : bounds[i + 1]], t + 2).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
            assert np.packbits(2 * ones > bounds[i + 1] - bounds[i], bitorder="little").view("<u8")[0] == sig[i, t]
    text = " ".join("u%d" % i for i in many)
    h, bounds = simhash.shingle_sets([text], 5)
    ones = np.unpackbits(simhash._mixed(h, 2).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    assert bounds[1] == 69_996 and np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0] == simhash.signatures([text], 5, 64)[0, 0]


def test_similar_groups_reach_all_pairs(spark):
    """Of all pairs of similarity 0.8 and more, found by comparing all with all, at least 0.95 link; strangers and texts apart don't."""
    rng, texts = random.Random(12), []
    for k in [3, 5, 6, 7] * 60:
        w = ["v%d" % rng.randint(0, 4000) for _ in range(300)]
        at = set(range(11, 11 + 8 * k, 8))
        texts += [" ".join(w), " ".join("q%d" % rng.randint(0, 10**9) if i in at else x for i, x in enumerate(w))]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    alike = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) >= 0.8 for i in range(0, len(texts), 2)]
    group = {r.id: r.group for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(3), "i").collect()}
    linked = [group[2 * i + 1] == 2 * i for i in range(len(alike))]
    assert sum(alike) > 150 and not any(x and not a for x, a in zip(linked, alike))
    assert sum(x for x, a in zip(linked, alike) if a) >= 0.95 * sum(alike)


def test_similar_groups_of_long_and_repeated_texts(spark, monkeypatch):
    """A crowd of copies in several tiles by bytes, a text of a million bytes among them, equal rows and ids of another type."""
    monkeypatch.setattr(simhash, "_TILE_BYTES", 1 << 14)
    rng = random.Random(7)
    base = ["c%d" % rng.randint(0, 10**6) for _ in range(400)]
    change = lambda: " ".join("z%d" % rng.randint(0, 10**9) if i in (rng.randint(0, 399),) else x for i, x in enumerate(base))
    long = words(180_000)
    texts = [change() for _ in range(40)] + [long, long + " end", words(50)]
    df = spark.createDataFrame([(("k", i), t) for i, t in enumerate([*texts, texts[0]])], "i struct<a:string,b:long>, text string").repartition(3)
    group = {r.id.b: (r.group.b, r.copies) for r in simhash.similar_groups(df, "i").collect()}
    assert {g for i, (g, _) in group.items() if i < 40 or i == 43} == {0} and group[0][1] == 2 == group[43][1]
    assert group[41][0] == 40 and group[42][0] == 42


def test_crowds_that_overlap_hang_together():
    got = simhash._joined(np.array([5, 6, 7, 8, 8, 9, 10, 11, 1, 2, 3, 4]), np.array([4, 4, 4]))
    assert dict(got.T.tolist()) == {5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 10: 5, 11: 5, 1: 1, 2: 1, 3: 1, 4: 1}


def test_similar_groups_at_the_threshold(spark):
    """What links is similar by its shingles themselves, however close to 0.8."""
    rng = random.Random(8)
    texts = []
    for k in (2, 5, 6, 8, 10, 12) * 4:
        w = words(300).split(" ")
        at = set(range(7, 7 * k + 7, 7))
        texts += [" ".join(w), " ".join("q%d" % rng.randint(0, 10**9) if i in at else x for i, x in enumerate(w))]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    alike = [len(a & b) / len(a | b) >= 0.8 for a, b in zip(sets[::2], sets[1::2])]
    group = {r.id: r.group for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(2), "i").collect()}
    linked = [group[2 * i + 1] == 2 * i for i in range(len(alike))]
    assert not any(x and not a for x, a in zip(linked, alike))
    assert sum(x for x, a in zip(linked, alike) if a) >= 0.8 * sum(alike)


def test_similar_groups_in_a_crowd(spark, monkeypatch):
    """Pairs over the threshold that share a variant link inside a large group that shares boilerplate, too."""
    monkeypatch.setattr(simhash, "_TILE", 16)
    rng, n = random.Random(5), 600
    some = lambda k: ["b%d" % rng.randint(0, 10**9) for _ in range(k)]
    shared = some(300)
    # Any two have similarity 0.6, text k and text n + k 0.86.
    one = [shared + some(100) for _ in range(n)]
    texts = [" ".join(w) for w in [*one, *(w[:-30] + some(30) for w in one)]]
    place = rng.sample(range(2 * n), 2 * n)
    signed = np.array([np.frombuffer(simhash.signature(t, 5, 16), "<u4") for t in texts])
    meet = (np.bitwise_count(signed[:n] ^ signed[n:]) <= 2).any(1)
    df = spark.createDataFrame(list(zip(place, texts)), "i long, text string").repartition(3)
    group = {r.id: r.group for r in simhash.similar_groups(df, "i").collect()}
    linked = np.array([group[place[k]] == group[place[n + k]] for k in range(n)])
    assert meet.sum() > 0.8 * n and (linked | ~meet).all()
    for g in set(group.values()):
        assert sum(x == g for x in group.values()) <= 2


def plain_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = defaultdict(list)
    for i in range(len(w) - 4):
        grams[tuple(w[i : i + 5])].append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_ledger(docs, none):
    x = quality.ledger(docs)
    assert set(CLASHING) <= set(x.columns)
    got = x.select("doc_id", "_m.n_words", "_m.word_chars", "_m.n_symbols", "_m.n_dup_lines", "_m.n_repeat_words", quality.fails("base/1").alias("f"))
    assert rows(got, *got.columns) == sorted([(i, *plain_quality(t)) for i, t in TEXTS], key=repr)
    n = x.count()
    for r in quality.ablations(x).collect():
        bit = quality.mask((r.rule,))
        bits = [b["_bits"] & quality.mask(quality.POLICIES[quality.DEFAULT_POLICY]) for b in x.select("_bits").collect()]
        assert (r.fails, r.fails_alone, r.kept_without) == (sum(b & bit > 0 for b in bits), sum(b == bit for b in bits), sum(b & ~bit == 0 for b in bits)) and n == len(bits)
    assert quality.ledger(none).count() == 0


def test_url_filter(spark):
    hosts = ["example.com", "www.example.com", "example.net", "notexample.com", "a.example.org"]
    urls = [f"https://{h}/{lang}/{n}{tail}" for h in hosts for lang in ("en", "de", "es") for n in (7, 8, 71, 9) for tail in ("", "?q=1", "#x")]
    urls += [None, "", "no scheme/en/", "http://", "HTTP://EXAMPLE.COM/en/7", "x://h?://y/p", "http://com/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").select("*", F.lit(1).alias("host"), F.lit(1).alias("rule")).repartition(3)
    got = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    for i, u in enumerate(urls):
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.name), default=None)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, best.name if best else None)
        assert r.verdict == ("allow" if best.allow else "block") if best else r.verdict in ("allow", "block")
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    alone = url_filter.filter_urls(spark.createDataFrame([(1, "http://q.test/x")], "page_id long, url string")).first()
    assert alone.verdict == "allow"


def test_url_models_carry_over_to_other_hosts(spark):
    """Rules label two hosts; a third host's pages are judged by how their paths are written."""
    rng = random.Random(9)
    style = {True: lambda: "/docs/guide-" + "".join(rng.choice(["read", "learn", "build"]) for _ in range(3)), False: lambda: "/win/cheap-" + "".join(rng.choice(["pill", "x9", "cash"]) for _ in range(3))}
    rules = (url_filter.Rule("ok.test", "/", True), url_filter.Rule("no.test", "/", False))
    data = [(f"https://{'ok' if good else 'no'}.test{style[good]()}", None) for good in (True, False) for _ in range(150)]
    data += [(f"https://third.test{style[good]()}", "allow" if good else "block") for good in (True, False) for _ in range(60)]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(data)], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.filter_urls(df, rules).collect()}
    free = [(want, got[i].verdict) for i, (_, want) in enumerate(data) if want]
    assert sum(a == b for a, b in free) >= 0.95 * len(free)


def test_url_models_are_distributions(spark):
    counts = spark.createDataFrame([(5, 3, 0), (70, 1, 4), (5000, 2, 2)], "g int, yes long, no long")
    assert url_filter.model(spark, counts).count() == url_filter.SIZE**3


def test_language(spark, none):
    rng = random.Random(4)
    alphabets = {"aa": ["lor", "em", "ip", "sum"], "bb": ["xq", "zu", "wyk"], "cc": ["été", "où", "çan"]}
    data = [(i, " ".join("".join(rng.choice(alphabets[k]) for _ in range(3)) for _ in range(rng.randint(3, 60))), k) for i, k in enumerate(rng.choice(list(alphabets)) for _ in range(400))]
    data += [(1000, None, "aa"), (1001, "123 !!", "bb"), (1002, "", None), (None, "loremipsum lorem", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").select("*", *[F.lit(1).alias(c) for c in ("id", "out", "chance", "n")]).repartition(3)
    got = {r.doc_id: r for r in language.identify(df, per_language=40).collect()}
    assert len(got) == len(data)
    held = [i for i, *_ in data if i is not None and zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in held) for i in got if i is not None)
    tested = [(got[i].lang_pred, k) for i, _, k in data[:400] if i in held]
    assert sum(a == b for a, b in tested) >= 0.95 * len(tested)
    assert all(got[i].lang_pred == "und" for i in (1000, 1001, 1002)) and got[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(none).count() == 0
    bare = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language.identify(bare).first().lang_pred == "und"


def test_chat(spark):
    turns = [(1, 1, "assistant", "b"), (1, 0, "user", chat.HOSTILE), (2, 0, None, None), (3, 0, "assistant", "\\<s>"), (3, 0, "assistant", "\\<s>"), (None, 0, "user", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).repartition(2)
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1].turns_sha256 == sha(f"user\n{chat.HOSTILE}\nassistant\nb\n") and got[1].loss_sha256 == sha("b")
    assert (got[2].n_turns, got[2].loss_chars, got[2].loss_sha256) == (1, 0, sha("")) and got[3].loss_sha256 == sha("\\<s>\\<s>") and None in got
    parts = [(1, 0, "user", [("text", "see <|image:0|>", None, None, None, None, None), ("image", None, "a.png", 28, 14, None, None), ("audio", None, "b.wav", None, None, 1.5, None), ("document", None, "c.pdf", None, None, None, 2)])]
    schema = "conv_id long, turn long, role string, content array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
    r = chat.format_conversations(spark.createDataFrame(parts, schema), content_col="content").first()
    assert [(a.place, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "a.png", 3), (1, "audio", "b.wav", 38), (2, "document", "c.pdf", 1024)]
    assert chat.read_turns(r.formatted)[0][1] == "see <|image:0|><|image:0|><|audio:1|><|document:2|>"
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_round_trip():
    parts = ["\\", "<s>", "</s>", "[INST]", "[/INST]", "<|image:0|>", "<|", "|>", "a", "\n", "<", "s>", "é"]
    for _ in range(5000):
        turns = [("".join(random.choice(parts) for _ in range(random.randint(0, 3))), "".join(random.choice(parts) for _ in range(random.randint(0, 8)))) for _ in range(random.randint(0, 4))]
        formatted, _, _ = chat.format_turns(turns)
        assert chat.read_turns(formatted) == turns
