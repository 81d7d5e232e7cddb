"""Definitions, references and documentation of source files.

Python goes through the standard library's parser and is exact. Markdown headings come from a line
walker. The other languages have no parser here: comments and strings are masked, rules find
definitions and calls, and blocks are closed by their braces (or `end`), which is precise for
ordinary code and can miss what only a grammar sees, such as definitions that macros make.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

OVERSIZE = 4 << 20
RECORDS = (
    "fid BIGINT, record STRING, name STRING, kind STRING, parent STRING, visibility STRING, start INT, end INT, start_line INT, end_line INT, "
    "signature STRING, arity INT, params ARRAY<STRING>, returns STRING, caller STRING, text STRING, status STRING"
)
_COLUMNS = [c.split()[0] for c in RECORDS.split(", ")]
_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
CONTAINERS = {"class", "struct", "trait", "enum", "impl", "module", "interface"}
CALLERS = {"fn", "method", "module"}


@dataclass
class Definition:
    name: str
    kind: str
    start: int
    end: int
    visibility: str = "public"
    parent: str | None = None
    signature: str | None = None
    arity: int | None = None
    params: list[str] | None = None
    returns: str | None = None
    doc: str | None = None


@dataclass
class Reference:
    name: str
    start: int
    end: int
    kind: str = "call"
    arity: int | None = None


@dataclass
class Parsed:
    defs: list[Definition] = field(default_factory=list)
    refs: list[Reference] = field(default_factory=list)
    status: str = "ok"
    by_identifier: bool = False


@dataclass(frozen=True)
class Rules:
    """How a language marks definitions: (pattern with a group `name`, kind); what stands for a call."""

    definitions: tuple[tuple[str, str], ...]
    line_comment: str = "//"
    public: str = "always"
    calls: tuple[str, ...] = (r"(?P<name>[A-Za-z_]\w*)\s*\(",)
    block: str = "brace"
    identifiers_only: bool = False


_KEYWORDS = frozenset(
    "if for while switch return catch sizeof match fn def func function new in not and or else do when unless elsif elif with using lock foreach await yield throw typeof assert print super self this await".split()
)
_CLASS = r"\bclass\s+(?P<name>\w+)"
_C = Rules(
    ((r"^[ \t]*(?:[\w:*&<>,~]+[ \t*&]+)+(?P<name>[A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:const\s*)?(?=\{)", "fn"), (r"\bstruct\s+(?P<name>\w+)\s*(?=\{)", "struct"), (r"\benum\s+(?:class\s+)?(?P<name>\w+)\s*(?=\{)", "enum"), (r"\btypedef\b[^;{}]*?\b(?P<name>\w+)\s*;", "other"), (_CLASS + r"[^;{]*(?=\{)", "class")),
    identifiers_only=True,
)
RULES = {
    "rust": Rules(
        ((r"\bfn\s+(?P<name>\w+)", "fn"), (r"\bstruct\s+(?P<name>\w+)", "struct"), (r"\benum\s+(?P<name>\w+)", "enum"), (r"\btrait\s+(?P<name>\w+)", "trait"), (r"\bimpl\b(?:<[^>{]*>)?\s*(?:[\w:<>, ]+\s+for\s+)?(?P<name>\w+)", "impl"),
         (r"\bconst\s+(?P<name>[A-Z_]\w*)\s*:", "const"), (r"\bstatic\s+(?:mut\s+)?(?P<name>\w+)\s*:", "static"), (r"\btype\s+(?P<name>\w+)", "type"), (r"\bunion\s+(?P<name>\w+)\s*(?=\{)", "other"), (r"\bmacro_rules!\s*(?P<name>\w+)", "other"), (r"\blet\s+(?:mut\s+)?(?P<name>\w+)", "other")),
        public="pub", calls=(r"(?P<name>[A-Za-z_]\w*)(?:::<[^>()]*>)?\s*\(", r"(?P<name>[A-Za-z_]\w*)!\s*[(\[{]", r"\bimpl\b[^{]*?(?P<name>\w+)(?:<[^>]*>)?\s+for\b")),
    "javascript": Rules(((r"\bfunction\s*\*?\s*(?P<name>[\w$]+)", "fn"), (r"\b(?:const|let|var)\s+(?P<name>[\w$]+)\s*=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=]+)?=>|[\w$]+\s*=>)", "fn"), (_CLASS, "class"), (r"(?:^[ \t]+|[{;}][ \t]*)(?:(?:static|async|get|set|public|private|protected|readonly)\s+)*(?P<name>[\w$]+)\s*\([^()]*\)\s*(?::[^{};]+)?(?=\{)", "method"))),
    "go": Rules(((r"^func\s+(?P<name>\w+)", "fn"), (r"^func\s+\([^)]*\)\s*(?P<name>\w+)", "method"), (r"^type\s+(?P<name>\w+)\s+struct\b", "struct"), (r"^type\s+(?P<name>\w+)\s+interface\b", "trait"), (r"^type\s+(?P<name>\w+)\s+(?!struct\b|interface\b)", "type")), public="upper", calls=(r"(?P<name>[A-Za-z_]\w*)(?:\[[^\]()]*\])?\s*\(",)),
    "java": Rules(((_CLASS, "class"), (r"^[ \t]+(?:[\w<>\[\],.]+\s+)+(?P<name>\w+)\s*\([^()]*\)\s*(?:throws [\w., ]+)?(?=\{)", "method"))),
    "c": _C, "cpp": _C,
    "php": Rules(((_CLASS, "class"), (r"^(?:function)\s+&?(?P<name>\w+)", "fn"), (r"^[ \t]+(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?(?P<name>\w+)", "method"))),
    "ruby": Rules(((r"^[ \t]*class\s+(?P<name>\w+)", "class"), (r"^[ \t]*def\s+(?:self\.)?(?P<name>\w+[?!]?)", "method")), line_comment="#", block="end", calls=(r"(?P<name>[A-Za-z_]\w*[?!]?)\s*\(", r"\.(?P<name>[a-z_]\w*[?!]?)")),
    "swift": Rules(((_CLASS, "class"), (r"\bstruct\s+(?P<name>\w+)", "struct"), (r"\bfunc\s+(?P<name>\w+)", "fn")), public="unknown"),
    "csharp": Rules(((r"\b(?:class|record)\s+(?P<name>\w+)", "class"), (r"\binterface\s+(?P<name>\w+)", "trait"), (r"\bstruct\s+(?P<name>\w+)", "struct"), (r"\benum\s+(?P<name>\w+)", "enum"), (r"^[ \t]+(?:[\w<>\[\],.?]+\s+)+(?P<name>\w+)\s*(?:<[^>()]*>)?\([^()]*\)\s*(?=\{|=>)", "method"))),
}
RULES["typescript"] = RULES["javascript"]


def mask(text: str, line_comment: str) -> str:
    """The text with comments and string contents blanked, place for place."""
    quote = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`'
    both = rf"{re.escape(line_comment)}[^\n]*|/\*.*?\*/|{quote}"
    return re.sub(both, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def parse(text: str, language: str) -> Parsed:
    if language == "python":
        return _python(text)
    if language == "markdown":
        return _markdown(text)
    if language in RULES:
        return _by_rules(text, RULES[language])
    return Parsed(status="failed")


def _python(text: str) -> Parsed:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return Parsed([], [], "partial", True)
    lines = text.splitlines(keepends=True)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line.encode()))
    at = lambda line, column: starts[line - 1] + column
    out = Parsed()

    def visit(node: ast.AST, parent: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            inner = parent
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(child, ast.ClassDef) else "fn"
                d = Definition(child.name, kind, at(child.lineno, child.col_offset), at(child.end_lineno, child.end_col_offset), "private" if child.name.startswith("_") else "public", parent, doc=ast.get_docstring(child))
                body = at(child.body[0].lineno, child.body[0].col_offset)
                d.signature = " ".join(text.encode()[d.start : body].decode("utf-8", "ignore").split()).rstrip(": ")
                if kind == "fn":
                    a = child.args
                    names = [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs)]
                    names = names[1:] if parent and names[:1] in (["self"], ["cls"]) else names
                    d.params, d.returns = names, ast.unparse(child.returns) if child.returns else None
                    d.arity = None if a.vararg or a.kwarg else len(names)
                else:
                    inner = child.name
                out.defs.append(d)
            elif isinstance(child, ast.Assign):
                for t in child.targets:
                    if isinstance(t, ast.Name) and re.fullmatch(r"[A-Z_0-9]*[A-Z][A-Z_0-9]*", t.id):
                        out.defs.append(Definition(t.id, "const", at(child.lineno, child.col_offset), at(child.end_lineno, child.end_col_offset), "private" if t.id.startswith("_") else "public", parent))
            if isinstance(child, ast.Call):
                f = child.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    end = at(f.end_lineno, f.end_col_offset)
                    variadic = any(isinstance(x, ast.Starred) for x in child.args) or any(k.arg is None for k in child.keywords)
                    out.refs.append(Reference(name, end - len(name.encode()), end, "call", None if variadic else len(child.args) + len(child.keywords)))
            elif isinstance(child, ast.Import | ast.ImportFrom):
                base = getattr(child, "module", None)
                for n in child.names:
                    out.refs.append(Reference(f"{base}.{n.name}" if base else n.name, at(child.lineno, child.col_offset), at(child.end_lineno, child.end_col_offset), "import"))
            elif isinstance(child, ast.arg) and isinstance(child.annotation, ast.Name):
                x = child.annotation
                out.refs.append(Reference(x.id, at(x.lineno, x.col_offset), at(x.end_lineno, x.end_col_offset), "type"))
            visit(child, inner)

    visit(tree, None)
    return out


def _markdown(text: str) -> Parsed:
    """Headings (ATX and Setext) with their breadcrumb and first paragraph as documentation; fenced code is skipped."""
    out, stack, fence, at, previous = Parsed(), [], None, 0, ("", 0)
    lines = text.split("\n")
    for i, line in enumerate(lines):
        size = len(line.encode()) + 1
        mark = re.match(r"\s{0,3}(```+|~~~+)", line)
        if mark:
            fence = None if fence and mark[1].startswith(fence) else fence or mark[1]
        elif not fence:
            atx = re.match(r" {0,3}(#{1,6})(?:\s+(.*?))?\s*#*\s*$", line)
            setext = re.match(r" {0,3}(=+|-+)\s*$", line)
            level, title, start = None, "", at
            if atx:
                level, title = len(atx[1]), (atx[2] or "").strip()
            elif setext and previous[0].strip():
                level, title, start = (1 if setext[1][0] == "=" else 2), previous[0].strip(), previous[1]
            if level and title:
                stack = [s for s in stack if s[0] < level] + [(level, title)]
                paragraph = []
                for nxt in lines[i + 1 :]:
                    if paragraph and not nxt.strip() or re.match(r"\s{0,3}(#{1,6}\s|```|~~~)", nxt):
                        break
                    if nxt.strip():
                        paragraph.append(nxt.strip())
                crumb = " > ".join(s[1] for s in stack)
                out.defs.append(Definition(title, "heading", start, at + size - 1, signature="#" * level + " " + title, doc="\n\n".join(x for x in (crumb, " ".join(paragraph)) if x)))
            previous = ("" if atx or setext else line, at)
        at += size
    return out


def _by_rules(text: str, rules: Rules) -> Parsed:
    masked = mask(text, rules.line_comment)
    out, taken = Parsed(by_identifier=rules.identifiers_only), {}
    for pattern, kind in rules.definitions:
        for m in re.finditer(pattern, masked, re.M):
            name = m["name"]
            if m.start("name") in taken or name in _KEYWORDS:
                continue
            taken[m.start("name")] = True
            line_start = text.rfind("\n", 0, m.start("name")) + 1
            start = m.start() + len(m[0]) - len(m[0].lstrip("{;} \t\n"))
            end = _block_end(masked, m.end(), rules.block, line_start)
            head = masked[line_start : m.end()]
            visibility = {"always": "public", "unknown": "unknown", "pub": "public" if re.search(r"\bpub\b", head) else "private", "upper": "public" if name[:1].isupper() else "private"}[rules.public]
            body = next((i for i in (masked.find(c, m.end()) for c in "{;") if 0 <= i <= end), end)
            d = Definition(name, kind, start, end, visibility, signature=" ".join(text[start:body].split()), doc=_doc_above(text, line_start, rules.line_comment))
            if kind in ("fn", "method"):
                d.arity, d.params, d.returns = _shape(masked[m.start("name") + len(name) : body])
            out.defs.append(d)
    out.defs.sort(key=lambda d: (d.start, -d.end))
    for d in out.defs:
        inside = [c for c in out.defs if c is not d and c.kind in CONTAINERS and c.start <= d.start < c.end and (c.start, c.end) != (d.start, d.end)]
        d.parent = min(inside, key=lambda c: c.end - c.start).name if inside else None
        if d.kind == "fn" and d.parent:
            d.kind = "method"
    for d in out.defs:
        d.kind = "other" if d.kind == "impl" else d.kind
    if not rules.identifiers_only:
        seen = set()
        for pattern in rules.calls:
            for m in re.finditer(pattern, masked):
                a, z = m.span("name")
                if m["name"] not in _KEYWORDS and a not in taken and a not in seen:
                    seen.add(a)
                    out.refs.append(Reference(m["name"], a, z, "call", _call_arity(masked, z)))
        out.refs.sort(key=lambda r: r.start)
    return _in_bytes(out, text)


def _block_end(masked: str, at: int, block: str, line_start: int) -> int:
    """Where a definition ends: behind its closing brace, at its `end` by indentation, or with its line."""
    if block == "end":
        indent = re.match(r"[ \t]*", masked[line_start:])[0]
        m = re.compile(rf"^{indent}end\b", re.M).search(masked, at)
        return m.end() if m else len(masked)
    opened, semicolon = masked.find("{", at), masked.find(";", at)
    if opened < 0 or 0 <= semicolon < opened:
        return semicolon + 1 if semicolon >= 0 else (masked.find("\n", at) if "\n" in masked[at:] else len(masked))
    depth = 0
    for m in re.compile(r"[{}]").finditer(masked, opened):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(masked)


def _doc_above(text: str, line_start: int, mark: str) -> str | None:
    """Comment lines right above a definition; blank lines between are skipped, any other line ends them."""
    got = []
    for line in reversed(text[:line_start].split("\n")[:-1]):
        s = line.strip()
        if s.startswith((mark, "/**", "/*", "*", "*/")):
            got.append(re.sub(r"^(///?!?|/\*\*?|\*/|\*|#)\s?|\s*\*/$", "", s))
        elif s:
            break
    return "\n".join(reversed(got)).strip() or None


def _split_top(text: str) -> list[str]:
    parts, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += c in "([{<"
        depth -= c in ")]}" or (c == ">" and text[i - 1 : i] not in ("-", "="))
        if c == "," and not depth:
            parts.append(text[last:i])
            last = i + 1
    return [p.strip() for p in [*parts, text[last:]] if p.strip()]


def _parenthesised(text: str, at: int) -> tuple[str, int] | None:
    opened = text.find("(", at)
    if opened < 0:
        return None
    depth = 0
    for i in range(opened, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if not depth:
            return text[opened + 1 : i], i + 1
    return None


def _shape(head: str) -> tuple[int | None, list[str], str | None]:
    """Arity, parameter names and return of a declaration's head; no arity if it is variadic."""
    found = _parenthesised(head, 0)
    if not found:
        return None, [], None
    inside, end = found
    names, variadic = [], False
    for p in _split_top(inside):
        if re.fullmatch(r"&?\s*(?:'\w+\s+)?(?:mut\s+)?(?:self|this)(?:\s*:.*)?", p):
            continue
        variadic |= "..." in p
        left = p.split(":")[0].split("=")[0].strip().lstrip("&*.$").removeprefix("mut ")
        names.append((_IDENT.findall(left) or [left])[0 if ":" in p else -1])
    returns = re.match(r"\s*(?:->|:)\s*([^{;=]+)", head[end:])
    return None if variadic else len(names), names, returns[1].strip() if returns else None


def _call_arity(masked: str, at: int) -> int | None:
    found = _parenthesised(masked[at : at + 4000], 0) if masked[at : at + 40].lstrip().startswith("(") else None
    return len(_split_top(found[0])) if found else None


def _in_bytes(p: Parsed, text: str) -> Parsed:
    if not text.isascii():
        sizes, total = [0], 0
        for c in text:
            total += len(c.encode())
            sizes.append(total)
        for x in (*p.defs, *p.refs):
            x.start, x.end = sizes[x.start], sizes[min(x.end, len(text))]
    return p


def records(fid: int, text: str, language: str) -> list[dict]:
    """Rows of a file: one `file`, then `def`, `ref` and `doc`. A reference names the smallest function, method or module around it."""
    p = parse(text, language)
    data = text.encode()
    newlines = [i for i, c in enumerate(data) if c == 10]
    from bisect import bisect_left

    line = lambda at: bisect_left(newlines, at) + 1
    out = [{"fid": fid, "record": "file", "status": p.status}]
    callers = [d for d in p.defs if d.kind in CALLERS]
    for d in p.defs:
        out.append({"fid": fid, "record": "def", "name": d.name, "kind": d.kind, "parent": d.parent, "visibility": d.visibility, "start": d.start, "end": d.end, "start_line": line(d.start), "end_line": line(max(d.start, d.end - 1)), "signature": d.signature, "arity": d.arity, "params": d.params, "returns": d.returns})
        if d.doc:
            out.append({"fid": fid, "record": "doc", "name": d.name, "text": d.doc})
    refs = [Reference(n, 0, 0, "identifier") for n in _IDENT.findall(text)] if p.by_identifier else p.refs
    for r in refs:
        around = [d for d in callers if d.start <= r.start < d.end]
        best = min(around, key=lambda d: d.end - d.start) if around else None
        out.append({"fid": fid, "record": "ref", "name": r.name, "kind": r.kind, "start": r.start, "end": r.end, "start_line": line(r.start) if not p.by_identifier else 1, "end_line": line(r.end) if not p.by_identifier else 1, "arity": r.arity, "caller": best.name if best else None})
    return out


def extract(files: DataFrame) -> DataFrame:
    """Records of `files` (fid, path, text), one Python call a batch; see `records`.

    A file over OVERSIZE bytes has its file record only, as partial; one of an unknown language fails.
    """
    x = files.select("fid", F.coalesce(T.language(F.col("path")), F.lit("")).alias("lang"), F.octet_length("text").alias("size"), F.when(F.octet_length("text") <= OVERSIZE, F.col("text")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                rows += records(r.fid, r.text, r.lang) if r.text is not None else [{"fid": r.fid, "record": "file", "status": "partial"}]
            df = pd.DataFrame(rows, columns=_COLUMNS)
            df["fid"] = df["fid"].astype("Int64")
            for c in ("start", "end", "start_line", "end_line", "arity"):
                df[c] = df[c].astype("Int32")
            yield df.astype(object).where(df.notna(), None)

    return x.select("fid", "lang", "text").mapInPandas(run, RECORDS)
