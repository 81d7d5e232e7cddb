"""URL filters: listed rules first, then a ratio of two character language models.

URLs that a rule decides are the examples. Character trigrams of accepted and of rejected ones
make two Markov models whose order follows the evidence (Witten-Bell: a context that was seen
often speaks for itself, a rare one leans on the shorter one). A URL without a rule goes by the
difference of the two log-likelihoods over its length, against a threshold calibrated on
examples kept out of the models. Everything is built-in column functions.

Characters fold to a fixed alphabet, so a model has len(ALPHABET) ** 3 rows whatever the corpus,
which bounds what is broadcast.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .quality import let

#: Place 0 stands for the ends of a URL, place 1 for any character not listed.
ALPHABET = string.ascii_lowercase + string.digits + "-._~/:?#=&%+@"
SIZE = len(ALPHABET) + 2
#: One example in so many calibrates the threshold instead of training the models.
CALIBRATE_EVERY = 5
BINS = 1000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/en/", False),
    Rule("example.com", "/en/7", True),
    Rule("net", "/de/", True),
    Rule("example.net", "/de/8", False),
    Rule("org", "/es/", False),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path of a URL; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def matched(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct (rule, allow) of the longest rule that fits, null fields if none does."""
    found = F.lit(None).cast("struct<rule:string,allow:boolean>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.allow).alias("allow"))).otherwise(found)
    return found


def trigrams(url: Column) -> Column:
    """Trigram numbers of a URL, one for each character and one for its end."""
    low = F.translate(url, string.ascii_uppercase, string.ascii_lowercase)
    code = F.transform(F.filter(F.split(low, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) + 1)
    padded = F.concat(F.array(F.lit(0), F.lit(0)), code, F.array(F.lit(0)))
    return let(padded, lambda p: F.transform(
        F.sequence(F.lit(1), F.size(p) - 2),
        lambda i: F.element_at(p, i) * SIZE * SIZE + F.element_at(p, i + 1) * SIZE + F.element_at(p, i + 2)))


def model(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """(g, gain): for each trigram number, log p(accepted) - log p(rejected) of its last character.

    `counts` has g, yes, no: how often each trigram occurs in accepted and in rejected URLs.
    """
    full = spark.range(SIZE**3).select(F.col("id").cast("int").alias("g")).join(F.broadcast(counts), "g", "left").select(
        "g", (F.col("g") / (SIZE * SIZE)).cast("int").alias("a"), ((F.col("g") / SIZE).cast("int") % SIZE).alias("b"), (F.col("g") % SIZE).alias("c"),
        F.coalesce("yes", F.lit(0)).alias("yes"), F.coalesce("no", F.lit(0)).alias("no"))
    full = cut(full)

    def tally(*keys: str, follow: str) -> DataFrame:
        return full.groupBy(*keys).agg(F.sum("yes").alias(f"yes_{follow}"), F.sum("no").alias(f"no_{follow}"))

    one = tally("c", follow="1")
    two = tally("b", "c", follow="2")
    after = lambda df, n, *keys: df.groupBy(*keys).agg(*[
        x for k in ("yes", "no") for x in (F.sum(f"{k}_{n}").alias(f"{k}_n{n}"), F.count_if(F.col(f"{k}_{n}") > 0).alias(f"{k}_t{n}"))])
    three = full.select("a", "b", F.col("yes").alias("yes_3"), F.col("no").alias("no_3"))
    total = one.agg(F.sum("yes_1").alias("yes_n1"), F.sum("no_1").alias("no_n1")).first()
    joined = full
    for part, keys in ((one, ["c"]), (two, ["b", "c"]), (after(two, 2, "b"), ["b"]), (after(three, 3, "a", "b"), ["a", "b"])):
        joined = joined.join(F.broadcast(part), keys)

    def logp(k: str) -> Column:
        p1 = (F.col(f"{k}_1") + 1) / (int(total[f"{k}_n1"] or 0) + SIZE)
        p2 = (F.col(f"{k}_2") + F.col(f"{k}_t2") * p1) / (F.col(f"{k}_n2") + F.col(f"{k}_t2"))
        p2 = F.when(F.col(f"{k}_n2") > 0, p2).otherwise(p1)
        p3 = (F.col(k) + F.col(f"{k}_t3") * p2) / (F.col(f"{k}_n3") + F.col(f"{k}_t3"))
        return F.log(F.when(F.col(f"{k}_n3") > 0, p3).otherwise(p2))

    return joined.select("g", (logp("yes") - logp("no")).alias("gain"))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A verdict on every URL.

    Returns id_col, host, path, rule (of the longest rule that fits, else null), verdict (allow or
    block) and score (the length-normalised log-likelihood difference, rounded). Rules decide where
    one fits; else the score is held against the threshold that separates the calibration
    examples best.

    A null URL has empty host and path, no rule and score 0. Without examples of both kinds the
    models say nothing and URLs without a rule are allowed. Null and repeated ids keep a row each;
    an empty table gives no rows; other columns are ignored. A very long URL is a row a character.
    Of equally good thresholds the lowest, which allows most, is taken.
    """
    spark = pages.sparkSession
    url = F.coalesce(F.col(url_col), F.lit(""))
    host, path = host_and_path(url)
    base = (
        pages.select(F.col(id_col).alias("id"), url.alias("url"), host.alias("host"), path.alias("path"))
        .withColumn("m", matched(F.col("host"), F.col("path"), rules))
        .select("id", "url", "host", "path", "m.rule", "m.allow", (F.pmod(F.xxhash64("url"), F.lit(CALIBRATE_EVERY)) == 0).alias("fold"))
    )
    counts = cut(
        base.filter("allow is not null and not fold").select("allow", F.explode(trigrams(F.col("url"))).alias("g"))
        .groupBy("g").agg(F.count_if("allow").alias("yes"), F.count_if(~F.col("allow")).alias("no"))
    )
    gains = cut(model(spark, counts))
    grams = base.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "host", "path", "rule", "allow", "fold", F.explode(trigrams(F.col("url"))).alias("g"))
    scored = cut(
        grams.join(F.broadcast(gains), "g")
        .groupBy("row", "id", "host", "path", "rule", "allow", "fold")
        .agg(F.floor(F.sum("gain") / F.count("*") * BINS).alias("bin"))
    )
    known = counts.agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).first()
    least = -(2**62)
    if known["yes"] and known["no"]:
        least = threshold(scored.filter("allow is not null and fold"))
    allowed = F.coalesce("allow", F.col("bin") >= least)
    return scored.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.when(allowed, "allow").otherwise("block").alias("verdict"),
        (F.col("bin") / BINS).alias("score"))


def threshold(examples: DataFrame) -> int:
    """The bin from which on to allow: it makes the rates of rightly allowed and rightly blocked examples sum highest.

    It lies midway between the examples on either side of it. Examples come as counts by bin,
    of which there are as many as a rounded mean of log ratios has values, however many examples.
    """
    by = examples.groupBy("bin").agg(F.count_if("allow").alias("yes"), F.count_if(~F.col("allow")).alias("no"))
    bins = sorted((r["bin"], r["yes"], r["no"]) for r in by.collect())
    yes, no = max(1, sum(b[1] for b in bins)), max(1, sum(b[2] for b in bins))
    best, least, below_yes, below_no, last = 1.0, -(2**62), 0, 0, None
    for b, y, n in bins:
        gain = (yes - below_yes) / yes + below_no / no
        if gain > best:
            best, least = gain, b if last is None else (last + b + 1) // 2
        below_yes, below_no, last = below_yes + y, below_no + n, b
    if below_no / no > best:
        least = bins[-1][0] + 1
    return least


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
