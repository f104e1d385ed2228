"""Source files as tables of symbols, calls and imports: Python by its syntax tree, Go, Java and TypeScript by lexical rules.

Defined results: files that don't parse give no rows for Python; lexical rules skip what they can't read; nested
definitions are qualified by the enclosing ones; a call's caller is the innermost definition around it, '' at top level.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = "path string, row_kind string, name string, target string, line int, end_line int, detail string"
_GO_FUNC = re.compile(r"^func\s+(?:\(\s*\w+\s+\*?(\w+)\s*\)\s*)?(\w+)\s*\(", re.M)
_JAVA_CLASS = re.compile(r"^\s*(?:public\s+|final\s+|abstract\s+)*(?:class|interface|record)\s+(\w+)", re.M)
_JAVA_METHOD = re.compile(r"^\s*(?:public|protected|private)\s+(?:static\s+|final\s+|async\s+)*[\w<>\[\], ?]+\s+(\w+)\s*\([^;{]*\)\s*(?:throws [\w., ]+)?\{", re.M)
_TS_FUNC = re.compile(r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(", re.M)
_CALL = re.compile(r"\b((?:\w+\.)+\w+)\s*\(")


def _python(path: str, text: str):
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    stack: list[tuple[ast.AST, str, str]] = [(tree, "", "")]
    while stack:
        node, scope, caller = stack.pop()
        for child in ast.iter_child_nodes(node):
            inner, who = scope, caller
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner = f"{scope}.{child.name}" if scope else child.name
                kind = "class" if isinstance(child, ast.ClassDef) else "function"
                yield path, "symbol", inner, kind, child.lineno, child.end_lineno, ",".join(ast.unparse(x) for x in child.decorator_list)
                who = inner if kind == "function" else caller
            elif isinstance(child, ast.Call):
                yield path, "call", caller, ast.unparse(child.func), child.lineno, child.end_lineno, ast.unparse(child.args[0]) if child.args else ""
            elif isinstance(child, ast.Import):
                for a in child.names:
                    yield path, "import", a.asname or a.name, a.name, child.lineno, child.end_lineno, ""
            elif isinstance(child, ast.ImportFrom):
                for a in child.names:
                    yield path, "import", a.asname or a.name, f"{child.module or ''}.{a.name}".strip("."), child.lineno, child.end_lineno, ""
            stack.append((child, inner, who))


def _block_end(text: str, at: int) -> int:
    depth, i = 0, text.find("{", at)
    if i < 0:
        return at
    for j in range(i, len(text)):
        depth += (text[j] == "{") - (text[j] == "}")
        if depth == 0:
            return j
    return len(text)


def _lexical(path: str, text: str, language: str):
    line = lambda at: text.count("\n", 0, at) + 1
    found = []
    if language == "Go":
        found = [(m.start(), ".".join(x for x in m.groups() if x)) for m in _GO_FUNC.finditer(text)]
    elif language in ("Java", "Kotlin"):
        classes = [(m.start(), m[1]) for m in _JAVA_CLASS.finditer(text)]
        for m in _JAVA_METHOD.finditer(text):
            owner = next((n for at, n in reversed(classes) if at < m.start()), "")
            found.append((m.start(), f"{owner}.{m[1]}" if owner else m[1]))
    elif language in ("TypeScript", "JavaScript"):
        found = [(m.start(), m[1]) for m in _TS_FUNC.finditer(text)]
    spans = []
    for at, name in found:
        end = _block_end(text, at)
        spans.append((at, end, name))
        yield path, "symbol", name, "function", line(at), line(end), ""
    for m in _CALL.finditer(text):
        caller = min(((e - s, n) for s, e, n in spans if s <= m.start() <= e), default=(0, ""))[1]
        if not any(s <= m.start() < text.find("{", s) for s, _, _ in spans):
            yield path, "call", caller, m[1], line(m.start()), line(m.start()), ""


def parsed(files: DataFrame) -> DataFrame:
    """(path, row_kind symbol|call|import, name, target, line, end_line, detail) of files(path, language, text)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(ROWS))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for p, lang, t in zip(*(c.to_pylist() for c in b.columns)):
                if t:
                    out += _python(p, t) if lang == "Python" else _lexical(p, t, lang or "")
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return files.select("path", "language", "text").mapInArrow(run, ROWS)


def python_routes(rows: DataFrame) -> DataFrame:
    """(path, method, route, handler) from decorators of common Python web frameworks."""
    r = rows.where("row_kind = 'symbol' and detail <> ''").select("path", "name", F.explode(F.regexp_extract_all("detail", F.lit(r"[\w.]+\.(?:get|post|put|patch|delete|route)\('[^']*'"), F.lit(0))).alias("d"))
    verb = F.upper(F.regexp_extract("d", r"\.(get|post|put|patch|delete|route)\(", 1))
    return r.select("path", F.when(verb == "ROUTE", "ANY").otherwise(verb).alias("method"), F.regexp_extract("d", r"\('([^']*)'", 1).alias("route"), F.col("name").alias("handler"))
