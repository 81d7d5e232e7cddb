"""The methods of packing, language ID and URL models against plain versions of themselves, and operators on odd input."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("quarrygraph.llm")

from quarrygraph.llm import bpe, chat, common, exact_dedup, language, packing, quality, simhash, suffix_dedup, token_counts, url_filter, words

PATH = public_tokenizers.path(words.DEFAULT_VOCABULARY)


def best_two_fit(lengths, capacity):
    """Bin by bin over single documents: fill with the longest that fit, then swap the smallest for the two that fill its gap best."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        used, gap = [], capacity
        for n in list(left):
            if n <= gap:
                used.append(n)
                left.remove(n)
                gap -= n
        if gap and len(used) > 1:
            room = gap + used[-1]
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if a + b <= room]
            total = max((p[0] for p in pairs), default=0)
            if total > used[-1]:
                # Of equally tight pairs that with the smallest document.
                _, a, b = max((p for p in pairs if p[0] == total), key=lambda p: (p[1], -p[2]))
                left.append(used.pop())
                left.remove(a)
                left.remove(b)
                left.sort(reverse=True)
                used += [a, b]
        bins.append(tuple(sorted(used)))
    return Counter(bins)


def test_plans_are_best_two_fit():
    rng = random.Random(3)
    for _ in range(150):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(0, 40))]
        got = Counter()
        for used, times in packing.plan(Counter(lengths), 40):
            got[tuple(sorted(used))] += times
        want = best_two_fit(lengths, 40)
        assert sum(got.values()) == sum(want.values()) and got == want


def test_language_model_is_kernel_ridge_regression():
    """With every text a landmark, scores are those of a plain solve over the full kernel matrix."""
    rng = random.Random(5)
    syllables = {"aa": ["lor", "em", "ip"], "bb": ["xq", "zu", "wyk"], "cc": ["ete", "ou", "can"]}
    texts, labels = [], []
    for _ in range(45):
        k = rng.choice(sorted(syllables))
        texts.append(" ".join("".join(rng.choice(syllables[k]) for _ in range(2)) for _ in range(rng.randint(2, 12))))
        labels.append(k)
    model = language.fit(texts, labels, landmarks=len(texts), ridge=1e-2)
    fresh = ["loremip emip", "zuzu wykxq", "oucan eteou loremzu"]
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    alike = lambda a, b: len(grams(a) & grams(b)) / math.sqrt(len(grams(a)) * len(grams(b)))
    k = np.array([[alike(a, b) for b in texts] for a in texts])
    weight = np.array([1 / labels.count(x) for x in labels])
    y = np.array([[1.0 if x == n else -1.0 for n in model.languages] for x in labels])
    alpha = np.linalg.solve(k + 1e-2 * np.diag(1 / weight), y)
    want = np.array([[alike(a, b) for b in texts] for a in fresh]) @ alpha
    got = model.scores([language.presence(t, model.classes) for t in fresh])
    assert np.abs(got - want).max() < 1e-2 and (got.argmax(1) == want.argmax(1)).all()


def plain_gain(examples, a, b, c):
    """log p(c | a, b) by Witten-Bell over the trigrams of `examples`, from the counts themselves."""
    grams = [tuple(p[i : i + 3]) for p in examples for i in range(len(p) - 2)]
    one = Counter(g[2] for g in grams)
    p = (one[c] + 1) / (len(grams) + url_filter.SIZE)
    for context, follow in (((b,), [g[2] for g in grams if g[1] == b]), ((a, b), [g[2] for g in grams if g[:2] == (a, b)])):
        if follow:
            p = (follow.count(c) + len(set(follow)) * p) / (len(follow) + len(set(follow)))
    return math.log(p)


def codes(url):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url)
    return [0, 0, *[url_filter.ALPHABET.index(c) + 2 if c in url_filter.ALPHABET else 1 for c in low], 0]


def test_url_models_against_plain_counts(spark):
    """Scores and verdicts of URLs without a rule, from plain counts and from every possible threshold."""
    rng = random.Random(9)
    say = {True: ["read", "learn", "Docs"], False: ["pill", "x9", "cash"]}
    rules = (url_filter.Rule("ok.test", "/", True), url_filter.Rule("no.test", "/", False))
    urls = [f"https://{'ok' if good else 'no'}.test/" + "-".join(rng.choice(say[good]) for _ in range(3)) for good in (True, False) for _ in range(40)]
    urls += ["https://c.test/" + "-".join(rng.choice(say[rng.random() < 0.5]) for _ in range(3)) for _ in range(30)] + ["ftp://é.test/Read"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    fold = {r.url: r.f for r in df.select("url", (F.pmod(F.xxhash64("url"), F.lit(url_filter.CALIBRATE_EVERY)) == 0).alias("f")).collect()}
    known = {u: "//ok." in u for u in urls if "//ok." in u or "//no." in u}
    listed = [u for u in urls if u in known]
    train = {good: [codes(u) for u in listed if known[u] is good and not fold[u]] for good in (True, False)}

    def bin_of(u):
        p = codes(u)
        gains = [plain_gain(train[True], *p[i : i + 3]) - plain_gain(train[False], *p[i : i + 3]) for i in range(len(p) - 2)]
        return math.floor(sum(gains) / len(gains) * url_filter.BINS + 1e-9)

    got = {r.page_id: r for r in url_filter.filter_urls(df, rules).collect()}
    bins = {u: bin_of(u) for u in set(urls)}
    assert all(abs(round(got[i].score * url_filter.BINS) - bins[u]) <= 1 for i, u in enumerate(urls))
    held = [(bins[u], known[u]) for u in listed if fold[u]]
    quality_at = lambda t: sum(k for b, k in held if b >= t) / sum(k for _, k in held) + sum(not k for b, k in held if b < t) / sum(not k for _, k in held)
    best = max(quality_at(t) for t in range(min(bins.values()) - 1, max(bins.values()) + 2))
    free = [(bins[u], got[i].verdict) for i, u in enumerate(urls) if u not in known]
    allowed = [b for b, v in free if v == "allow"]
    blocked = [b for b, v in free if v == "block"]
    assert not allowed or not blocked or min(allowed) >= max(blocked)
    assert any(quality_at(t) == best for t in range(max(blocked, default=min(bins.values())), min(allowed, default=max(bins.values())) + 2))


NAMES = ["keep_id", "group_size", "kept", "n_tokens", "length", "sequence_id", "offset", "piece", "start", "fingerprint", "component_id", "held_out", "lang_pred", "score", "host", "rule", "verdict", "turns", "copies", "node", "sig", "chunk", "h1", "gram", "_row"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty texts, rows repeated as a whole, equal ids, and names that operators use themselves."""
    rows = [(None, None, None), (None, None, None), (1, "", None), (1, "", None), (2, "same words here " * 5, "en"), (2, "same words here " * 5, "en"), (2, "other words there", None), (3, "wörter gibt es auch", "de"), (None, "same words here " * 5, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", *[F.lit(7).alias(n) for n in NAMES]).repartition(2)
    df.write.mode("overwrite").parquet(place := spark.conf.get("spark.checkpoint.dir") + "/odd")
    return spark.read.parquet(place)


def test_odd_rows_keep_a_row_each(odd, spark):
    made = {
        "bpe": lambda d: bpe.encode_decode(d, PATH), "suffix": suffix_dedup.suffix_dedup, "pack": lambda d: packing.pack(d, PATH), "language": language.identify,
        "tokens": lambda d: token_counts.token_counts(d, PATH), "quality": quality.ledger, "near": simhash.near_duplicates, "exact": exact_dedup.exact_dedup,
    }
    for name, f in made.items():
        got = f(odd)
        assert got.count() == 9, name
        ids = sorted((r.doc_id for r in got.select("doc_id").collect()), key=repr)
        assert ids == sorted([None, None, 1, 1, 2, 2, 2, 3, None], key=repr), name
        assert f(odd.limit(0)).count() == 0, name
    kept = {(r.doc_id, r.kept) for r in exact_dedup.exact_dedup(odd).filter("group_size = 3").select("doc_id", "kept").collect()}
    assert kept == {(2, True), (2, False), (None, False)}
    pred = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(odd).collect()]
    assert len({p for p in pred if p[0] == 2}) == 2 and all(p[1:] == ("und", 0.0) for p in pred if p[0] == 1)


def test_odd_urls_and_conversations(spark):
    urls = [(None, None), (None, None), (1, "http://example.com/en/7"), (1, "http://example.com/en/7"), (2, "http://q.test/" + "x" * 20_000)]
    got = sorted(((r.page_id, r.host, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(urls, "page_id long, url string")).collect()), key=repr)
    assert [g[0] for g in got].count(1) == 2 and got.count((None, "", None, "allow")) == 2 and (1, "example.com", "example.com/en/7", "allow") in got
    empty = spark.createDataFrame([(None, None, None), (None, None, None)], "conv_id long, formatted string, loss_mask array<struct<start:long,end:long>>")
    back = chat.read_back(empty).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars, r.formatted_chars) for r in back] == [(None, 0, 0, 0)] * 2


def test_components_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(common, "ALONE", 0)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[k] == 100 for k in range(100, 140)) and len(got) == 101


def test_similar_groups_by_shuffles(spark, monkeypatch):
    """With nothing few enough to be broadcast or joined up in one task, groups are the same."""
    rng = random.Random(4)
    rows = []
    for g in range(15):
        w = ["t%d" % rng.randint(0, 10**6) for _ in range(200)]
        rows += [" ".join(w), " ".join([*w[:-1], "end"]), " ".join([*w, "more"])]
    df = spark.createDataFrame(list(enumerate([*rows, "alone", None, ""])), "i long, text string").repartition(3)
    few = sorted(map(tuple, simhash.similar_groups(df, "i").collect()))
    monkeypatch.setattr(common, "ALONE", 0)
    monkeypatch.setattr(common, "FEW", 0)
    monkeypatch.setattr(simhash, "FEW", 0)
    assert sorted(map(tuple, simhash.similar_groups(df, "i").collect())) == few
    assert all(g == 3 * (i // 3) for i, g, _ in few if i < 45) and few[45:] == [(45, 45, 1), (46, 46, 2), (47, 46, 2)]


def test_merge_ranks_are_checked(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        file = json.load(f)
    assert words.follows_merges(file)
    vocabulary = file["model"]["vocab"]
    a, b = ("".join(file["model"]["merges"][k]) for k in (10, 4000))
    vocabulary[a], vocabulary[b] = vocabulary[b], vocabulary[a]
    assert not words.follows_merges(file)
    path = str(tmp_path / "swapped.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(file, f)
    assert type(words.coder_for(path)) is words.WordCoder
    with pytest.raises(ValueError):
        token_counts.PrefixCounter(path)


def test_long_texts(spark):
    """A text of some five million bytes with repeats, and one of 70,000 shingles, in every operator that takes whole texts at once."""
    rng = random.Random(1)
    vocabulary = ["%x" % rng.getrandbits(40) for _ in range(40_000)]
    long = " ".join(rng.choice(vocabulary) for _ in range(480_000))
    passage = long[1_000_000:1_000_300]
    many = " ".join("s%d" % i for i in range(70_000))
    df = spark.createDataFrame([(1, long), (2, "before " + passage + " after"), (3, many), (4, many + " x")], "doc_id long, text string").repartition(2)
    df.write.mode("overwrite").parquet(place := spark.conf.get("spark.checkpoint.dir") + "/long")
    docs = spark.read.parquet(place)
    assert len(long) > 4_500_000
    removed = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert removed[1] == 0 and 300 <= removed[2] <= 302 and removed[3] == 0 and removed[4] == len(many)
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, words=3).collect()}
    assert near == {1: 1, 2: 2, 3: 3, 4: 3}
    group = {r.id: r.group for r in simhash.similar_groups(docs, "doc_id").collect()}
    assert group == {1: 1, 2: 2, 3: 3, 4: 3}
    from tokenizers import Tokenizer

    n = {i: len(Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids) for i, t in ((1, long), (3, many))}
    counts = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, PATH).collect()}
    assert {i: counts[i] for i in n} == n
    assert {r.doc_id: r.n_tokens for r in bpe.encode_decode(docs, PATH, chunk_bytes=1 << 20).collect()} == counts
    packed = packing.pack(docs, PATH).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n - 1 for r in packed} == counts
