"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document and leaves one bit, beside the measurements behind it.
A policy is a named, versioned set of rules: applying it, changing it or asking what each rule
alone is responsible for are bitwise operations on the ledger, never another look at a text.
All of it is built-in column functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

WHITE = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with `value` computed once however often `use` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of `width` words found twice or more in `words`.

    Window hashes are sorted with their positions, so equal ones are neighbours; the words
    covered are then summed over the positions in order.
    """

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            at = F.transform(s, lambda x, k: F.when(
                (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"])), x["i"]))
            return F.array_sort(F.filter(at, lambda i: i.isNotNull()))

        def width_sum(p: Column) -> Column:
            return F.aggregate(
                F.transform(p, lambda i, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - i, F.lit(width)))),
                F.lit(0), lambda a, b: a + b)

        return let(let(pairs, positions), width_sum)

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) < width, F.lit(0)).otherwise(some)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with one struct column _m of a text's measurements; null text counts as empty."""
    text = text_or_empty(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    words = F.filter(F.split(text, SPLIT), lambda w: w != "")
    by_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    bare = F.char_length(F.translate(text, WHITE, ""))
    symbols = F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))
    both = let(F.struct(by_words.alias("w"), by_lines.alias("l")), lambda x: F.struct(
        x["w"]["n_words"].alias("n_words"), bare.cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
        x["l"]["n_lines"].alias("n_lines"), x["l"]["n_dup_lines"].alias("n_dup_lines"), x["w"]["n_repeat_words"].alias("n_repeat_words")))
    return docs.withColumn("_m", both)


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[Callable[[str], Column]], Column]


#: A rule's place is its bit, for good: new rules go to the end.
RULES = (
    Rule("few_words", lambda m: m("n_words") < 10),
    Rule("repeated_windows", lambda m: 100 * m("n_repeat_words") > 20 * m("n_words")),
    Rule("symbols", lambda m: 100 * m("n_symbols") > 10 * m("word_chars")),
    Rule("repeated_lines", lambda m: 100 * m("n_dup_lines") > 30 * m("n_lines")),
    Rule("short_words", lambda m: m("word_chars") < 2 * m("n_words")),
    Rule("long_words", lambda m: m("word_chars") > 25 * m("n_words")),
)
BASE = ("few_words", "repeated_windows")
#: Policies by name and version.
POLICIES = {
    "base/1": BASE,
    "clean/1": (*BASE, "symbols", "short_words", "long_words"),
    "strict/1": tuple(r.name for r in RULES),
}
DEFAULT_POLICY = "clean/1"


def mask(names: tuple[str, ...]) -> int:
    at = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << at[n] for n in names)


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the struct _m of measurements and the long _bits of the rules that failed.

    Null and empty texts fail few_words. A column of `docs` named _m or _bits is replaced; any
    other stays as it is. Rows are kept one for one, so repeated rows and ties need no rule, and an
    empty table gives no rows. A very long text is one row of one task, with its words as an array.
    """
    m = lambda name: F.col(f"_m.{name}")
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(rule.fails(m), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured(docs, text_col).withColumn("_bits", bits)


def fails(policy: str) -> Column:
    """Whether a ledger row fails a rule of the policy."""
    return F.col("_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))) != 0


def ablations(entries: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """What each rule of the policy does: rows it fails, rows only it fails, rows kept without it.

    The ledger folds to one row per distinct bit pattern, at most 2 ** len(RULES), before any
    rule is looked at.
    """
    patterns = entries.groupBy("_bits").agg(F.count("*").alias("n"))
    all_bits = mask(POLICIES[policy])
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(mask((n,))).alias("bit")) for n in POLICIES[policy]])
    hit = F.col("_bits").bitwiseAND(F.lit(all_bits))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return (
        patterns.select(hit.alias("hit"), "n", F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            total(F.col("hit").bitwiseAND(F.col("r.bit")) != 0).alias("fails"),
            total(F.col("hit") == F.col("r.bit")).alias("fails_alone"),
            total(F.col("hit").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0).alias("kept_without"),
        )
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "_m.n_words", "_m.word_chars", "_m.n_symbols", "_m.n_dup_lines", "_m.n_repeat_words",
        fails("base/1").alias("base_failed"), (~fails("base/1") & ~fails(DEFAULT_POLICY)).alias("kept"),
        F.col("_bits").alias("fail_bits"),
    )


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
           FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS win
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
      FROM d LEFT JOIN c ON d.doc_id = c.doc_id),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN 100 * n_symbols > 10 * word_chars THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
             + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END) AS fail_bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       fail_bits % 4 <> 0 AS base_failed, fail_bits % 8 = 0 AND fail_bits < 16 AS kept, CAST(fail_bits AS BIGINT) AS fail_bits FROM b
"""
