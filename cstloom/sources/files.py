"""Source trees: listing on the driver, reading and parsing in tasks.

A plain directory load would skip names that begin with a dot or an underscore,
so paths are listed first and their bytes read in mapInPandas.  Parsers are
plug-ins: a callable from (text, path) to a nested root node.  Python's own ast
is built in; tree-sitter grammars are used where they can be imported.

Defined results: a missing directory raises FileNotFoundError; files over the
size limit are left out of the listing; unreadable, unsupported and unparsable
files become rows with success = false and an error, never a failed task.
"""

from __future__ import annotations

import ast
import bisect
import importlib
import os
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cstloom.functions.words import EXCLUDED_PATHS, EXTENSION_LANGUAGES

MOST_BYTES = 10 * 1024 * 1024
FILES_PER_TASK = 200
RESULT = "filepath string, language string, success boolean, error string, parse_time double, file_size bigint, text string, cst_json string"


def extension(path: Column) -> Column:
    """The suffix with its dot in lower case; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def language_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(EXTENSION_LANGUAGES.items()), "extension string, language string")


def with_language(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds language by extension, null if unknown; the table is a fixed few rows."""
    return files.withColumn("extension", extension(F.col(path))).join(F.broadcast(language_table(files.sparkSession)), "extension", "left").drop("extension")


def not_excluded(path: Column, match: str = "substring") -> Column:
    """Whether none of the excluded parts occurs in a path, anywhere or as a whole segment."""
    if match == "segment":
        return ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in EXCLUDED_PATHS]))
    out = F.lit(True)
    for x in EXCLUDED_PATHS:
        out = out & ~F.contains(path, F.lit(x))
    return out


def list_files(root: str, recursive: bool = True, most_bytes: int = MOST_BYTES) -> list[tuple[str, int]]:
    """(path, size) of the files below a directory, sorted; those whose size can't be read are left out."""
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    out = []
    for folder, dirs, names in os.walk(root):
        dirs.sort()
        for name in names:
            path = os.path.join(folder, name)
            try:
                size = os.path.getsize(path)
            except OSError:
                continue
            if size <= most_bytes:
                out.append((path, size))
        if not recursive:
            break
    return sorted(out)


def scan(spark: SparkSession, root: str, recursive: bool = True, match: str = "substring", extensions: list[str] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, length, language) of the source files of a tree, in the order of their paths."""
    listed = spark.createDataFrame(list_files(root, recursive, most_bytes), "path string, length bigint")
    found = with_language(listed.filter(not_excluded(F.col("path"), match))).filter(F.col("language").isNotNull())
    if extensions is not None:
        found = found.filter(extension(F.col("path")).isin(*extensions))
    return found.orderBy("path")


def decode_bytes(content: Column) -> Column:
    """UTF-8 if the bytes are, Latin-1 otherwise; line ends become newlines."""
    text = content.cast("string")
    return F.regexp_replace(F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1")), r"\r\n?", "\n")


def read_text(path: str) -> str:
    with open(path, "rb") as f:
        raw = f.read()
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
    return text.replace("\r\n", "\n").replace("\r", "\n")


Parser = Callable[[str, str], dict]
_PARSERS: dict[str, Parser] = {}


def register_parser(language: str, parser: Parser) -> None:
    """Parsers registered on the driver travel with the closure of parse_files."""
    _PARSERS[language] = parser


#: Node types that differ from the names of Python's own syntax tree in lower case.
PYTHON_TYPES = {
    "FunctionDef": "function_definition", "AsyncFunctionDef": "async_function_definition", "ClassDef": "class_definition", "Import": "import_statement", "ImportFrom": "import_from_statement", "Expr": "expression_statement",
    "Name": "identifier", "arg": "identifier", "arguments": "parameters", "keyword": "keyword_argument", "Return": "return_statement", "If": "if_statement", "For": "for_statement", "While": "while_statement", "Try": "try_statement",
    "With": "with_statement", "Raise": "raise_statement", "Assert": "assert_statement", "Delete": "delete_statement", "Pass": "pass_statement", "Assign": "assignment", "AugAssign": "augmented_assignment", "BinOp": "binary_operator",
    "BoolOp": "boolean_operator", "UnaryOp": "unary_operator", "Compare": "comparison_operator", "Lambda": "lambda", "Dict": "dictionary", "ListComp": "list_comprehension",
}
_DEFINED = re.compile(rb"\s*(?:async\s+def|def|class)\s+([^\s(:\[]+)")


def _python_type(node: ast.AST) -> str:
    if isinstance(node, ast.Constant):
        return {str: "string", bytes: "string", int: "integer", float: "float", bool: "true", type(None): "none"}.get(type(node.value), "constant")
    name = type(node).__name__
    return PYTHON_TYPES.get(name) or re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower()


def python_tree(text: str, path: str = "") -> dict:
    """A nested root node of a Python text, in the node types of the grammars that chunks are made of.

    The names of definitions and attributes are identifiers, bases and arguments
    stand in an argument list, and the statements of a body in a block.  Besides
    the fields of a node, definitions, calls and identifiers carry ``name``, and
    definitions their cleaned ``docstring``.
    """
    raw = text.encode()
    lines = text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line.encode()) + 1)

    def point(at: int) -> list[int]:
        row = bisect.bisect_right(starts, at, 0, len(lines)) - 1
        return [row, at - starts[row]]

    def made(kind: str, a: int, b: int, **more) -> dict:
        return {"type": kind, "text": raw[a:b].decode("utf-8", "replace"), "start_byte": a, "end_byte": b, "start_point": point(a), "end_point": point(b), "is_named": True, "children": [], **more}

    def span(node: ast.AST) -> tuple[int, int] | None:
        return (starts[node.lineno - 1] + node.col_offset, starts[node.end_lineno - 1] + node.end_col_offset) if hasattr(node, "lineno") else None

    def group(kind: str, nodes: list[ast.AST]) -> list[tuple[dict, list]]:
        """A node around others that stand side by side, and what goes below it."""
        spans = [s for n in nodes if (s := span(n))]
        return [(made(kind, spans[0][0], spans[-1][1]), nodes)] if spans else []

    def below(node: ast.AST, a: int, b: int) -> list:
        """The children of a node: syntax nodes, or pairs of a made node and its children."""
        out: list = []
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            m = _DEFINED.match(raw, a)
            out.append((made("identifier", *m.span(1), name=node.name), []) if m else (made("identifier", a, a, name=node.name), []))
        for field, value in ast.iter_fields(node):
            some = [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, ast.AST) and not isinstance(x, (ast.expr_context, ast.operator, ast.boolop, ast.cmpop, ast.unaryop))]
            if isinstance(value, list) and field in ("body", "orelse", "finalbody") and not isinstance(node, ast.Module):
                out += group("block", some)
            elif field == "bases" or isinstance(node, ast.Call) and field == "args":
                out += group("argument_list", some)
            else:
                out += some
        if isinstance(node, ast.Attribute):
            end = len(node.attr.encode())
            out.append((made("identifier", b - end, b, name=node.attr), []))
        return out

    module = ast.parse(text, path or "<text>")
    root = made("module", 0, len(raw))
    todo: list[tuple[dict, list]] = [(root, below(module, 0, len(raw)))]
    while todo:
        parent, children = todo.pop()
        inside = parent["start_byte"]
        for child in children:
            if isinstance(child, tuple):
                one, rest = child
            else:
                a, b = span(child) or (inside, inside)
                more: dict = {}
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    more = {"name": child.name, "docstring": ast.get_docstring(child)}
                elif isinstance(child, (ast.Name, ast.Attribute, ast.arg)):
                    more = {"name": child.id if isinstance(child, ast.Name) else child.attr if isinstance(child, ast.Attribute) else child.arg}
                elif isinstance(child, ast.Call):
                    more = {"name": getattr(child.func, "id", getattr(child.func, "attr", None))}
                one, rest = made(_python_type(child), a, b, **more), below(child, a, b)
            parent["children"].append(one)
            todo.append((one, rest))
    return root


#: Packages of grammars that aren't called after their language; C is read by the grammar of C++.
GRAMMARS = {"csharp": "c_sharp", "tsx": "typescript", "c": "cpp"}


def _parser_of(language: str, given: dict[str, Parser]) -> Parser | None:
    if language in given:
        return given[language]
    if language == "python":
        return python_tree
    try:
        grammar = importlib.import_module(f"tree_sitter_{GRAMMARS.get(language, language)}")
        ts = importlib.import_module("tree_sitter")
    except ImportError:
        return None
    # the package of TypeScript holds two grammars under names of their own
    language_of = getattr(grammar, "language", None) or getattr(grammar, f"language_{language}")
    parser = ts.Parser(ts.Language(language_of()))

    def run(text: str, path: str) -> dict:
        raw = text.encode()
        top = parser.parse(raw).root_node
        shape = lambda n: {"type": n.type, "text": raw[n.start_byte : n.end_byte].decode("utf-8", "replace"), "start_byte": n.start_byte, "end_byte": n.end_byte, "start_point": list(n.start_point), "end_point": list(n.end_point), "is_named": n.is_named, "children": []}
        root = shape(top)
        todo = [(top, root)]
        while todo:
            node, made = todo.pop()
            for c in node.children:
                one = shape(c)
                made["children"].append(one)
                todo.append((c, one))
        return root

    return run


def parse_files(files: DataFrame, max_text_chars: int | None = 1000) -> DataFrame:
    """A result row for each (path, language): the tree as nested JSON, or an error.  Node texts are cut as in interchange files unless the limit is None."""
    import json

    given = dict(_PARSERS)

    def cut(root: dict) -> dict:
        todo = [root]
        while todo:
            n = todo.pop()
            if max_text_chars and len(n["text"]) > max_text_chars:
                n["text"] = n["text"][: max_text_chars - 3] + "..."
            todo += n["children"]
        return root

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Parser | None] = {}
        for pdf in batches:
            rows = []
            for path, language in zip(pdf["path"], pdf["language"]):
                began, text, tree, error = time.time(), None, None, None
                try:
                    if language is None:
                        error = f"Unsupported extension: {os.path.splitext(path)[1]}"
                    else:
                        if language not in known:
                            known[language] = _parser_of(language, given)
                        if known[language] is None:
                            error = f"No parser for language: {language}"
                        else:
                            text = read_text(path)
                            tree = json.dumps({"filepath": path, "language": language, "cst": cut(known[language](text, path))})
                except Exception as e:  # any failure of a file is data
                    error = f"{type(e).__name__}: {e}" if isinstance(e, SyntaxError) else str(e)
                rows.append((path, language or "unknown", error is None, error, time.time() - began, len(text.encode()) if text else 0, text, tree))
            yield pd.DataFrame(rows, columns=["filepath", "language", "success", "error", "parse_time", "file_size", "text", "cst_json"])

    return files.select("path", "language").mapInPandas(run, RESULT)


def parse_codebase(spark: SparkSession, root: str, **options) -> DataFrame:
    files = scan(spark, root, **options)
    return parse_files(files.repartition(max(1, files.count() // FILES_PER_TASK)))
