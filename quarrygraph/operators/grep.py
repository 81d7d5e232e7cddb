"""Text search: literal, regular expression, multi-line and structural, with lines and byte offsets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MOST = 4096
LINE_BYTES = 512


class GrepError(ValueError):
    """A parameter error, with its code."""

    def __init__(self, code: str, text: str) -> None:
        super().__init__(f"{code}: {text}")
        self.code = code


def validate(text: str | None = None, regex: str | None = None, structural: str | None = None, language: str | None = None, combine: str | None = None, multiline: bool = False, limit: int = 256) -> str:
    """The mode of a search (literal, regex, structural or intersect), or GrepError."""
    if text and regex:
        raise GrepError("CONFLICTING_PATTERNS", "text and regex exclude each other")
    if not (text or regex or structural):
        raise GrepError("MISSING_PATTERN", "one of text, regex and structural is needed")
    if not 0 < limit <= MOST:
        raise GrepError("INVALID_LIMIT", f"limit must be from 1 to {MOST}")
    if multiline and not regex:
        raise GrepError("MULTILINE_WITHOUT_REGEX", "multiline is for regular expressions")
    if structural and not language:
        raise GrepError("MISSING_LANGUAGE", "a structural search needs a language")
    if combine and combine != "intersect":
        raise GrepError("INVALID_COMBINE", f"unknown combination {combine!r}")
    if structural and (text or regex):
        if combine != "intersect":
            raise GrepError("MISSING_COMBINE", "a structural pattern beside a text needs combine")
        return "intersect"
    if combine:
        raise GrepError("COMBINE_WITHOUT_BOTH", "combine needs a structural and a text pattern")
    if regex:
        try:
            re.compile(regex)
        except re.error as e:
            raise GrepError("INVALID_REGEX", str(e)) from e
        if re.search(r"\([^()]*[+*][^()]*\)[+*]", regex):
            raise GrepError("REGEX_TOO_COMPLEX", "nested repetition")
    return "structural" if structural else "regex" if regex else "literal"


def literal_regex(text: str, ignore_case: bool = True) -> str:
    """The expression of a literal; only A-Z fold."""
    if not ignore_case:
        return re.escape(text)
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else re.escape(c) for c in text)


def matches(docs: DataFrame, pattern: str, key: list[str], text: str = "text", multiline: bool = False) -> DataFrame:
    """One row per non-empty match: key, ordinal, match, start and end (bytes), line (from 1), line_text.

    Text without a match leaves before anything is exploded. Byte places follow from the pieces
    between matches: the n-th match starts after the first n pieces and n - 1 matches, which are
    added up once per text. The pattern is used as it is, so its groups keep their numbers.
    """
    p = f"(?sm){pattern}" if multiline else pattern
    hit = docs.where(F.col(text).rlike(p))
    found = F.filter(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)), lambda m: m != "")
    rows = hit.select(*key, F.split(text, "\n").alias("_lines"), F.translate(F.col(text), "\x00", "\x01").alias("_text"), found.alias("_found")).where(F.size("_found") > 0)
    # Each match gets a mark on either side, so every second piece lies between matches; empty matches leave no piece.
    marked = F.split(F.regexp_replace("_text", F.lit(p), F.lit("\x00$0\x00")), "\x00")
    between = F.filter(F.transform(marked, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["i"] % 2 == 0)
    whole = F.filter(F.transform(marked, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: (s["i"] % 2 == 1) & (s["x"] != ""))
    count = lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit("\n"), F.lit("")))
    rows = rows.select(*key, "_lines", "_found", between.alias("_between"), whole.alias("_whole"))
    sizes = F.transform(F.concat("_between", "_whole"), lambda s: F.struct(s["i"].alias("i"), F.octet_length(s["x"]).alias("b"), count(s["x"]).alias("n")))
    rows = rows.withColumn("_sizes", F.array_sort(sizes))
    step = lambda a, s: F.struct(
        (a["b"] + s["b"]).alias("b"), (a["n"] + s["n"]).alias("n"),
        F.when(s["i"] % 2 == 1, F.concat(a["at"], F.array(F.struct(a["b"].alias("b"), a["n"].alias("n"))))).otherwise(a["at"]).alias("at"))
    zero = F.struct(F.lit(0).alias("b"), F.lit(0).alias("n"), F.array().cast("array<struct<b:int,n:int>>").alias("at"))
    places = F.aggregate("_sizes", zero, step, lambda a: a["at"])
    each = rows.select(*key, "_lines", F.posexplode(F.arrays_zip(F.col("_found").alias("m"), places.alias("at"))).alias("_i", "_x"))
    line = F.col("_x.at.n") + 1
    return each.select(
        *key, (F.col("_i") + 1).alias("ordinal"), F.col("_x.m").alias("match"), F.col("_x.at.b").alias("start"), (F.col("_x.at.b") + F.octet_length("_x.m")).alias("end"),
        line.alias("line"), T.truncate_utf8(F.element_at("_lines", line), LINE_BYTES, "…").alias("line_text"))


def line_matches(docs: DataFrame, pattern: str, key: list[str], text: str = "text") -> DataFrame:
    """One row per line that matches: key, line (from 1), line_text, hits."""
    return (
        docs.where(F.col(text).rlike(pattern)).select(*key, F.posexplode(F.split(text, "\n")).alias("_i", "line_text"))
        .where(F.col("line_text").rlike(pattern)).select(*key, (F.col("_i") + 1).alias("line"), "line_text", F.regexp_count("line_text", F.lit(pattern)).alias("hits"))
    )


def read_range(text: Column, start: Column | int, end: Column | int, token_budget: int | None = None) -> Column:
    """Lines start to end of a text, from 1 and inclusive, cut to whole characters within a budget of 3-byte tokens."""
    lines = F.split(text, "\n")
    got = F.array_join(F.slice(lines, F.lit(start), F.greatest(F.lit(end) - F.lit(start) + 1, F.lit(0))), "\n")
    return got if token_budget is None else T.truncate_utf8(got, 3 * token_budget)


def structural(docs: DataFrame, tag: str, key: list[str], text: str = "html", attribute: str | None = None) -> DataFrame:
    """Elements of marked-up text as captures: key, ordinal, captures (map of name to matched texts)."""
    p = rf"<{tag}(?:\s[^>]*)?>(.*?)</{tag}>" if attribute is None else rf"<{tag}\s[^>]*?{attribute}=\"([^\"]*)\""
    rows = docs.where(F.col(text).contains(f"<{tag}")).select(*key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(f"(?s){p}"), F.lit(1))).alias("_i", "_m"))
    return rows.select(*key, (F.col("_i") + 1).alias("ordinal"), F.create_map(F.lit(attribute or "content"), F.array("_m")).alias("captures"))


# --- structural queries over definitions and references

#: What a node of a structural query can bind, by column.
FIELDS = ("name", "parent", "visibility", "signature", "caller")
# Predicates of structural queries; any other is an error.
PREDICATES = ("eq?", "not-eq?", "match?", "not-match?", "any-of?", "is?", "is-not?")
_TOKEN = re.compile(r'"((?:[^"\\]|\\.)*)"|([()])|([^\s()"]+)')


def parse_structural(pattern: str) -> tuple[str, dict[str, str], str | None, list[tuple[str, list[str]]]]:
    """(kind, captures by field, capture of the whole node, predicates) of a query like

    (fn name: @name parent: @owner) @def (#match? @name "^get_") (#is-not? private)

    `kind` is a kind of definition or reference, or _ for any. GrepError for anything else.
    """
    words = [(m[1], "text") if m[1] is not None else (m[2] or m[3], "mark" if m[2] else "word") for m in _TOKEN.finditer(pattern)]
    groups, whole = [], None
    for w in words:
        if w == ("(", "mark"):
            groups.append([])
        elif w == (")", "mark"):
            if not groups or groups[-1][-1:] == [None]:
                raise GrepError("INVALID_STRUCTURAL", pattern)
            groups[-1].append(None)
        elif groups and groups[-1][-1:] != [None]:
            groups[-1].append(w)
        elif len(groups) == 1 and w[0].startswith("@") and whole is None:
            whole = w[0][1:]
        else:
            raise GrepError("INVALID_STRUCTURAL", pattern)
    if not groups or any(len(g) < 2 or g[-1] is not None for g in groups):
        raise GrepError("INVALID_STRUCTURAL", pattern)
    node, rest = [w for w, _ in groups[0][:-1]], groups[1:]
    captures = dict(zip(node[1::2], node[2::2]))
    if len(node) % 2 == 0 or any(not f.endswith(":") or f[:-1] not in FIELDS or not c.startswith("@") for f, c in captures.items()):
        raise GrepError("INVALID_STRUCTURAL", pattern)
    bound = {f[:-1]: c[1:] for f, c in captures.items()}
    predicates = []
    for g in rest:
        name, *args = [w for w, _ in g[:-1]]
        if not name.startswith("#") or name[1:] not in PREDICATES:
            raise GrepError("UNKNOWN_PREDICATE", name)
        tag = name[1:] in ("is?", "is-not?")
        if len(args) < (1 if tag else 2) or not tag and args[0].removeprefix("@") not in bound.values():
            raise GrepError("INVALID_PREDICATE", " ".join([name, *args]))
        predicates.append((name[1:], args))
    return node[0], bound, whole, predicates


def structural_nodes(nodes: DataFrame, pattern: str, key: list[str]) -> DataFrame:
    """Nodes (key, kind, start, end, start_line and FIELDS) that a structural query describes: key, start, end, line, captures (name to texts).

    eq, match and any-of look at a captured text, is and is-not at the node's visibility. A predicate on a
    field that a node doesn't have fails, negated ones too.
    """
    kind, bound, whole, predicates = parse_structural(pattern)
    field = {c: f for f, c in bound.items()}
    got = nodes if kind == "_" else nodes.where(F.col("kind") == kind)
    for f in bound:
        got = got.where(F.col(f).isNotNull())
    for name, args in predicates:
        if name in ("is?", "is-not?"):
            same = F.col("visibility") == args[0]
            got = got.where(same if name == "is?" else ~same)
            continue
        value = F.col(field[args[0].removeprefix("@")])
        other = F.col(field[args[1][1:]]) if args[1].startswith("@") and args[1][1:] in field else F.lit(args[1])
        test = value.isin(args[1:]) if name == "any-of?" else value.rlike(args[1]) if "match" in name else value == other
        got = got.where(~test if name.startswith("not-") else test)
    entries = [x for f, c in bound.items() for x in (F.lit(c), F.array(F.col(f)))] + ([F.lit(whole), F.array(F.coalesce("signature", "name"))] if whole else [])
    captures = F.create_map(*entries) if entries else F.create_map().cast("map<string,array<string>>")
    return got.select(*key, "start", "end", F.col("start_line").alias("line"), captures.alias("captures"))


def column_of(line: Column, needle: str) -> Column:
    """Place of the first occurrence in a line, from 1; 0 without one."""
    return F.locate(needle, line)


def highlighted(line: Column, needle: str, before: str = "\x1b[1m", after: str = "\x1b[0m") -> Column:
    """The line with its first occurrence between two marks."""
    at = column_of(line, needle)
    found = F.concat(F.left(line, at - 1), F.lit(before + needle + after), F.substring(line, at + F.lit(len(needle)), F.char_length(line)))
    return F.when(at > 0, found).otherwise(line)
