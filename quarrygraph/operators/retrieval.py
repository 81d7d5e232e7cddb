"""Ranked retrieval of symbols for questions in prose, and its quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W


def stems(c: Column) -> Column:
    return F.transform(c, T.stem)


def candidate_features(candidates: DataFrame) -> DataFrame:
    """Names lower-cased, stemmed and decomposed, and doc words stemmed, once per candidate (name, file, rank, doc, kind, visibility)."""
    return candidates.select(
        "*", F.lower("name").alias("_name"), T.stem(F.col("name")).alias("_name_stem"), stems(T.decompose(F.col("name"))).alias("_parts"),
        F.array_distinct(stems(T.tokens(F.coalesce("doc", F.lit(""))))).alias("_doc"), F.lower("file").alias("_file"))


def idf_table(features: DataFrame, column: str) -> DataFrame:
    """(stem, w): ln((n + 1) / (df + 1)) + 1 over the candidates' distinct stems."""
    n = features.count()
    return features.select(F.explode(F.array_distinct(column)).alias("stem")).groupBy("stem").agg((F.log(F.lit(n + 1.0) / (F.count("*") + 1)) + 1).alias("w"))


def _grams(c: Column) -> Column:
    """The distinct runs of one to three characters."""
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c), F.lit(1))), lambda i: F.array(*[F.substring(c, i, F.lit(n)) for n in (1, 2, 3)]))))


def score(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query, name, score) of every candidate that a query token touches.

    `queries` has query (key) and text. Tokens meet candidates through their stems, and substrings of
    names and paths through the three characters that a token begins with (two, if it has no more).
    """
    f = candidate_features(candidates)
    n = f.count()
    default = F.log(F.lit(float(n + 1))) + 1
    name_idf, doc_idf = idf_table(f, "_parts"), idf_table(f, "_doc").withColumnRenamed("w", "dw")
    q = queries.select("query", T.tokens(F.col("text")).alias("_tokens"))
    multi = F.size(F.filter("_tokens", lambda t: F.octet_length(t) >= 3)) > 1
    tok = q.select("query", "_tokens", multi.alias("_multi"), F.posexplode("_tokens").alias("pos", "tok")).withColumn("stem", T.stem(F.col("tok")))
    tok = tok.join(name_idf, "stem", "left").join(doc_idf, "stem", "left").withColumns({"w": F.coalesce("w", default), "dw": F.coalesce("dw", default)})
    keys = f.select("name", F.explode(F.array_distinct(F.concat(F.array("_name_stem"), "_parts", "_doc"))).alias("stem"))
    grams = f.select("name", "_name", "_file", F.explode(F.array_union(_grams(F.col("_name")), _grams(F.col("_file")))).alias("gram"))
    inside_of = grams.join(tok.select("query", "tok", F.left("tok", F.lit(3)).alias("gram")).distinct(), "gram")
    touched = tok.select("query", "pos", "stem").join(keys, "stem").select("query", "name").union(
        inside_of.where(F.col("_name").contains(F.col("tok")) | F.col("_file").contains(F.col("tok"))).select("query", "name")).distinct()
    pair = touched.join(f, "name").join(tok, "query")
    exact = (F.col("_name") == F.col("tok")) | (F.col("_name_stem") == F.col("stem"))
    part = ~exact & F.array_contains("_parts", F.col("stem"))
    inside = ~exact & ~part & F.col("_name").contains(F.col("tok"))
    w = Window.partitionBy("query", "name").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    nth = F.sum(part.cast("int")).over(w) - 1
    bonus = F.when(F.size("_parts") >= 4, 6.0 / F.pow(F.lit(2.0), nth)).otherwise(6.0)
    exact_bonus = F.when(F.col("_multi") & F.col("_name").isin(W.COMMON_NOUNS), 1.0).otherwise(10.0)
    gain = (
        F.when(exact, exact_bonus * F.col("w")).when(part, bonus * F.col("w")).when(inside, 3.0 * F.col("w")).otherwise(0.0)
        + F.when(F.col("_file").contains(F.col("tok")), F.col("w")).otherwise(0.0)
        + F.when(F.array_contains("_doc", F.col("stem")), 0.8 * F.col("dw")).otherwise(0.0)
    )
    summed = pair.withColumn("gain", gain).groupBy("query", "name", "file", "rank", "kind", "visibility", "_tokens").agg(F.sum("gain").alias("gain"))
    factor = F.lit(1.0)
    for hint, kinds in W.KIND_HINTS.items():
        factor = factor * F.when(F.array_contains("_tokens", hint) & F.col("kind").isin(kinds), 1.6).otherwise(1.0)
    factor = factor * F.when(F.col("visibility") == "public", 1.15).otherwise(1.0)
    factor = factor * F.when(T.is_test_path(F.col("file")) | T.is_test_name(F.col("name")), 0.35).otherwise(1.0)
    return summed.select("query", "name", ((F.col("rank") + F.col("gain")) * factor).alias("score"))


def top_k(scored: DataFrame, k: int, by: str = "query", item: str = "name", value: str = "score") -> DataFrame:
    """The k best of each query by score, then name, with their position."""
    w = Window.partitionBy(by).orderBy(F.desc(value), item)
    return scored.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def quality(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, k: int, by: str = "query", item: str = "name") -> DataFrame:
    """One row: mean reciprocal rank, coverage, coverage of answerable queries and precision at k.

    Queries without relevant items are controls: they count in all means but answerable coverage.
    """
    hits = ranked.join(relevant.select(by, item).distinct(), [by, item])
    first = hits.groupBy(by).agg(F.min("position").alias("first"), F.count("*").alias("hits"))
    answerable = relevant.select(by).distinct().withColumn("answerable", F.lit(True))
    per = queries.select(by).distinct().join(first, by, "left").join(answerable, by, "left")
    found = F.col("first").isNotNull()
    return per.agg(
        F.avg(F.when(found, 1.0 / F.col("first")).otherwise(0.0)).alias("mrr"),
        F.avg(found.cast("double")).alias("coverage"),
        F.avg(F.when(F.col("answerable"), found.cast("double"))).alias("answerable_coverage"),
        F.avg(F.coalesce("hits", F.lit(0)) / F.lit(k)).alias("precision_at_k"))


def lexical_score(query_tokens: Column, name: Column, doc: Column, path: Column) -> Column:
    """Share of query tokens found: in the name 1, else in the doc 0.6, else in the path 0.3."""
    # An array of one row holds the words, so that they are taken apart once and not for every query token.
    row = F.array(F.struct(query_tokens.alias("q"), *[T.lexical_tokens(c).alias(k) for k, c in (("n", name), ("d", doc), ("p", path))]))

    def share(r: Column) -> Column:
        hit = lambda t: F.when(F.array_contains(r["n"], t), 1.0).when(F.array_contains(r["d"], t), 0.6).when(F.array_contains(r["p"], t), 0.3).otherwise(0.0)
        return F.aggregate(r["q"], F.lit(0.0), lambda a, t: a + hit(t)) / F.size(r["q"])

    return F.element_at(F.transform(row, lambda r: F.when(F.size(r["q"]) == 0, 0.0).otherwise(share(r))), 1)


def containing(texts: DataFrame, needles: DataFrame, by: str, item: str) -> DataFrame:
    """(item, by) of the texts (by, text) that contain a needle (item, text) whole.

    Texts meet needles by the longest word inside a needle, which has other characters on both sides, so
    that a text that contains the needle has the same word; ids alone meet, and the texts of those that met
    are compared. Needles without such a word are held against every text, and null contains nothing.
    """
    word = "(?<=[^A-Za-z])[A-Za-z]+(?=[^A-Za-z])"
    inside = F.array_sort(F.transform(F.regexp_extract_all("text", F.lit(word), F.lit(0)), lambda w: F.struct((-F.char_length(w)).alias("n"), w.alias("w"))))
    n = needles.where("text is not null").select(item, F.col("text").alias("_needle"), F.try_element_at(inside, F.lit(1))["w"].alias("_w"))
    keyed, rest = n.where("_w is not null"), n.where("_w is null")
    words = texts.select(by, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))).alias("_w"))
    met = words.join(keyed.select("_w").distinct(), "_w", "left_semi").join(keyed, "_w").select(by, item, "_needle")
    found = met.join(texts, by).where(F.contains("text", "_needle")).select(item, by)
    if not rest.isEmpty():
        found = found.union(texts.join(rest, F.contains("text", "_needle")).select(item, by))
    return found.distinct()
