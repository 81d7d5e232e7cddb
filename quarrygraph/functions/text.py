"""Column functions on names, paths and prose. All of them are built-in expressions."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def tokens(c: Column) -> Column:
    """Query tokens: lower-cased words of letters, digits and _, longer than a byte, without stop words."""
    parts = F.split(F.lower(c), r"[^\p{L}\p{N}_]+")
    return F.filter(parts, lambda t: (F.octet_length(t) > 1) & ~t.isin(W.STOPWORDS))


def decompose(c: Column) -> Column:
    """Words of an identifier, at separators and from lower to upper case, longer than a byte."""
    split = F.split(ascii_lower(F.regexp_replace(c, r"(?<=\p{Ll})(?=\p{Lu})", "_")), r"[^\p{L}\p{N}]+")
    return F.filter(split, lambda t: F.octet_length(t) > 1)


def lexical_tokens(c: Column) -> Column:
    """Distinct identifier words for lexical retrieval, in order of appearance."""
    parts = F.split(ascii_lower(F.regexp_replace(c, r"(?<=\p{Ll})(?=\p{Lu})", "_")), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(parts, lambda t: (F.octet_length(t) >= 2) & ~t.isin(W.LEXICAL_STOPWORDS)))


def stem(c: Column) -> Column:
    """Stem of a word: a listed lemma, else the first suffix that leaves three bytes goes, then a final e."""
    low = F.lower(c)
    cut = low
    for suffix in reversed(W.SUFFIXES):
        n = len(suffix)
        cut = F.when(low.endswith(suffix) & (F.octet_length(low) - n >= 3), F.left(low, F.char_length(low) - n)).otherwise(cut)
    lemma = F.element_at(F.create_map(*[F.lit(x) for pair in W.LEMMAS.items() for x in pair]), low)
    bare = F.regexp_replace(cut, r"^(.{3,})e$", "$1")
    return F.coalesce(lemma, bare)


def is_compound(c: Column) -> Column:
    return c.rlike("[_-]|[a-z][A-Z]")


def edge_weight(name: Column, refs: Column, mentioned: Column, ubiquitous: Column, open_file: Column) -> Column:
    """Weight of a reference edge: its multiplicity's root times what its name and place tell."""
    factor = lambda cond, by: F.when(cond, F.lit(by)).otherwise(F.lit(1.0))
    return (
        factor(mentioned, 10.0)
        * factor((F.octet_length(name) >= 8) & is_compound(name), 10.0)
        * factor(name.startswith("_"), 0.1)
        * factor(ubiquitous, 0.1)
        * factor(open_file, 50.0)
        * F.sqrt(refs.cast("double"))
    )


def final_segment(c: Column) -> Column:
    return F.substring_index(c, "::", -1)


def qualified_name(name: Column, parent: Column) -> Column:
    """parent::name, or the name alone without a parent."""
    return F.concat_ws("::", parent, name)


def token_cost(c: Column, bytes_per_token: int = 3) -> Column:
    """Estimated tokens of a text: bytes over `bytes_per_token`, rounded up."""
    return F.ceil(F.octet_length(c) / bytes_per_token)


def glob_regex(pattern: str) -> str:
    """The anchored regular expression of a name glob, in which only * and ? are special."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def path_glob_regex(pattern: str) -> str:
    """The regular expression of a path glob: ** crosses folders, * and ? don't, [..] and {a,b} as usual."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
            continue
        if c == "{":
            depth += 1
        elif c == "}":
            if not depth:
                raise ValueError(f"unbalanced }} in glob {pattern!r}")
            depth -= 1
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}.get(c) or ("|" if c == "," and depth else re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"unbalanced {{ in glob {pattern!r}")
    return f"^{out}$"


def outline_glob(path: Column, pattern: str) -> Column:
    """The outline's smaller glob: **, p/**, **/*.ext, p/**/*, p/**/*.ext or an exact path."""
    if pattern in ("**", "**/*"):
        return F.lit(True)
    head, star, tail = pattern.partition("**")
    if not star:
        return path == pattern
    inside = path.startswith(head) if head else F.lit(True)
    if tail in ("", "/*"):
        return inside
    if tail.startswith("/*."):
        return inside & path.endswith(tail[2:])
    return path == pattern


def is_test_path(path: Column) -> Column:
    """Whether a path follows a convention for tests, by folder or by file name."""
    low = ascii_lower(path)
    base = F.regexp_extract(low, r"[^/]*$", 0)
    return low.rlike(r"/(tests|test|__tests__)/|^tests?/") | base.rlike(r"^[^.]*(_test|_tests|_spec)\.|^[^.]*\.(test|spec)(\.|$)")


def is_test_name(name: Column) -> Column:
    return ascii_lower(name).rlike("^(test|bench)_") | name.rlike("^(Test|Benchmark)[A-Z]")


def language(path: Column) -> Column:
    """Language by extension, null if unknown."""
    by = F.create_map(*[F.lit(x) for lang, exts in W.LANGUAGES.items() for e in exts.split() for x in (e, lang)])
    return F.element_at(by, F.nullif(ascii_lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1)), F.lit("")))


def classify_path(path: Column, ignored: Column | None = None, editor: str = W.EDITOR_FILES, secrets: str = W.SECRETS, indexed: Column | None = None) -> Column:
    """What to do with a file, by the first rule that applies; decided before its content is read.

    `editor`, `secrets` and `indexed` are the rules for editors' files, secrets and what has an indexed extension.
    """
    if indexed is None:
        indexed = ascii_lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1)).isin(W.INDEXED_EXTENSIONS)
    return (
        F.when(path.rlike(editor), "skip:editor_swap")
        .when(path.rlike(secrets), "skip:secrets")
        .when(~indexed, "skip:unsupported_extension")
        .when(F.lit(False) if ignored is None else ignored, "skip:ignored")
        .otherwise("index_full")
    )


def _synonym(c: Column, table: dict[str, str], other: str) -> Column:
    by = F.create_map(*[F.lit(x) for name, words in table.items() for w in words.split() for x in (w, name)])
    return F.coalesce(F.element_at(by, ascii_lower(F.btrim(c))), F.lit(other))


def normal_kind(kind: Column) -> Column:
    return _synonym(kind, W.KINDS, "other")


def normal_visibility(visibility: Column) -> Column:
    return _synonym(visibility, W.VISIBILITIES, "unknown")


def size_bucket(files: Column) -> Column:
    return F.when(files < 1_000, "lt_1k").when(files < 10_000, "1k_to_10k").when(files < 100_000, "10k_to_100k").otherwise("gt_100k")


def classify_command(command: Column) -> Column:
    """Which kind of navigation a shell command is: grep, find, cat or ls; null if none."""
    bare = F.regexp_replace(F.btrim(command), r"^(env )?(\s*[^=\s]\S*=\S*(?=\s|$))*\s*", "")
    word = F.regexp_extract(bare, r"^\S+", 0)
    rest = F.btrim(F.regexp_replace(bare, r"^\S+", ""))
    target = F.regexp_extract(rest, r"^\S*", 0)
    system = r"^(/tmp|/var|/dev|/proc|/sys)"
    found = (word == "find") & ~target.rlike(r"^(/tmp|/var|/dev|/proc|/sys|~/Downloads|~/Library|~/\.cache|/Users)") & bare.rlike("-(name|iname|path|regex) ")
    read = (word == "cat") & ~bare.rlike("<<|>|<\\(") & (rest != "") & ~rest.rlike(system) & ~rest.startswith("-")
    listed = (word == "ls") & ~bare.rlike(" -l| -al") & ~(rest.startswith("/") & ~rest.rlike("^/(Users/|home/|workspace|srv)")) & ~rest.rlike("^~/(Downloads|Library)")
    return (
        F.when(word.isin("git", "cargo", "make", "npm", "yarn", "pnpm"), None)
        .when(word.isin("grep", "rg", "egrep", "fgrep", "ack", "ack-grep"), "grep")
        .when(found, "find").when(read, "cat").when(listed, "ls")
    )


def truncate_utf8(c: Column, limit: int, ellipsis: str = "") -> Column:
    """The longest prefix of whole characters within `limit` bytes, and `ellipsis` if that cut anything."""
    whole = F.octet_length(c) <= limit
    raw = F.substring(F.encode(c, "UTF-8"), 1, limit)
    # A cut character leaves a lead byte without all its followers at the end: drop it.
    hexed = F.regexp_replace(F.hex(raw), r"(F[0-7]([89AB][0-9A-F]){0,2}|E[0-9A-F]([89AB][0-9A-F])?|[CD][0-9A-F])$", "")
    return F.when(whole, c).otherwise(F.concat(F.decode(F.unhex(hexed), "UTF-8"), F.lit(ellipsis)))


def clean_heading(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(F.btrim(c), r"^#+", ""), r"\s+#+\s*$", ""))


def collapse_paragraph(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"\s+", " "))


def byte_offset(text: Column, character: Column) -> Column:
    """Bytes before a 0-based character position."""
    return F.octet_length(F.left(text, character))
