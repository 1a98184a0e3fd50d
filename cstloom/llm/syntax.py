"""Source files that do not parse (problem 1).

1. A lexer for the language of the extension turns a file into classes of
   tokens.  Its flat shapes (statements, and what each bracket encloses with
   inner brackets as one symbol), the adjacent pairs in them and its brackets
   become rows.
2. The pairs are anti-joined against those that the language's grammar permits.
3. Brackets are matched by two window reductions: a running sum gives the depth,
   and on one level every closing bracket must follow an opening one of its kind.
4. The distinct shapes of the whole table are matched once each against the
   statement productions; a file with a shape that none derives is invalid.
5. In files that look invalid, those in Python are parsed for confirmation.

The text of a file's ``file`` chunk decides; an empty file is valid.  Without
such a chunk the error of the latest scan decides (greatest scanned_at; null
counts as the smallest, then the greater error text).  Defined results: files
of unsupported extensions are no cases; null and empty texts of a file chunk are
valid; rows delivered twice count once; very long texts are read whole; empty
tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType
from pyspark.sql.window import Window

from cstloom.llm import grammars
from cstloom.llm.common import EXTENSIONS, language_of
from cstloom.session import reliable

_OPEN, _CLOSE = {"(": "p", "[": "b", "{": "c"}, {")": "(", "]": "[", "}": "{"}
#: Python numbers that begin with a zero or end in letters that belong to no number.
_BAD_NUMBER = re.compile(r"0[\d_]*[1-9][\d_]*|(?!0[xX][\da-fA-F_]+$|0[oO][0-7_]+$|0[bB][01_]+$|[\d_]+(?:[eE]\d+)?[jJ]?$)\d+[A-Za-z_]\w*")
_ASI_STARTS = set("ndsFCDTBIRWOSYAMmtfu")
#: Errors of a scan that speak of syntax.
SYNTAX_ERROR = r"(?i)syntax|unexpected|expected|unmatched|unterminated|never closed|indent|ERROR node|MISSING|stray|unclosed|unbalanced|invalid (?:token|character|decimal)|parse error"


def _statements(shape: str, joins: str) -> list[str]:
    """Cut what stands between braces into statements: behind ; and behind a block, unless what follows belongs to it."""
    out, at = [], 0
    for i, c in enumerate(shape):
        if c == ";" or c == "c" and (i + 1 == len(shape) or shape[i + 1] not in joins):
            out.append(shape[at : i + 1])
            at = i + 1
    if at < len(shape):
        out.append(shape[at:])
    return out


_JOINS = {"javascript": ";.,pboa?x:fL:", "typescript": ";.,pboa?x:fL:", "java": ";.,oa?:pb", "csharp": ";.,oa?:pb", "c": ";.,oa?:b", "cpp": ";.,oa?:pbu", "go": ";.,oapb:L?", "rust": ";.,o?apLb"}


def _cut(shape: str, language: str) -> list[str]:
    if language == "go":  # the clauses of for, if and switch hold semicolons of their own
        out: list[str] = []
        for s in _statements(shape, _JOINS[language]):
            if out and re.match(r"(?:L?I|R|S)[^c]*;$", out[-1]):
                out[-1] += s
            else:
                out.append(s)
        return out
    return _statements(shape, _JOINS[language])


def lexed(text: str, language: str) -> tuple[set[str], str]:
    """Shapes of a text, each as context:shape, and its brackets in order."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿")
    if language == "python":
        return _lexed_python(text)
    keywords, shapes, brackets = grammars.KEYWORDS[language], set(), []
    stack: list[list[str]] = [[]]
    opened: list[str] = []
    now, before, newline = stack[-1], "", False
    go, script = language == "go", language in ("javascript", "typescript")

    def close(kind: str, content: str) -> None:
        if kind == "c":
            shapes.add("c:" + content)
        else:
            shapes.add(f"{kind}:{content}")

    for m in grammars.LEXERS[language].finditer(text):
        kind, word = m.lastgroup, m[0]
        if kind == "c":
            if "\n" in word:
                newline = True
            continue
        if kind == "l":
            newline = True
            if go and (before in ("n", "d", "s", "x", "p", "b", "c", "T", "B", "k") or before == "u" and now[-1:] == ["."]):
                now.append(";")
                before = ";"
            continue
        if kind == "n":
            c = keywords.get(word, "n")
            if before == "." and c != "n" and language != "rust":
                c = "n"
        elif kind in "sd":
            c = kind
        elif kind == "o":
            c = grammars.operator(word, before, language)
        else:
            c = "!"
        if c == "":
            continue
        if c == "/" or script and kind == "o" and word == "/" and before not in ("n", "d", "s", "p", "b", "c", "x"):
            c = "!"
        if script and newline and c in _ASI_STARTS and before in ("n", "d", "s", "x", "p", "b", "B", "c") and opened[-1:] != ["("] and opened[-1:] != ["["] and not (before == "c" and c not in "nds"):
            if not (before in "pc" and _controls(now)):
                now.append(";")
        newline = False
        if c in _OPEN:
            brackets.append(c)
            opened.append(c)
            stack.append([])
            now, before = stack[-1], ""
        elif c in _CLOSE:
            brackets.append(c)
            if opened and opened[-1] == _CLOSE[c]:
                symbol = _OPEN[opened.pop()]
                close(symbol, "".join(stack.pop()))
                now = stack[-1]
                now.append(symbol)
                before = symbol
            else:
                now.append("!")
                before = "!"
        else:
            now.append(c)
            before = c
    while len(stack) > 1:  # brackets left open; the nesting tells
        stack.pop()
    shapes.update("top:" + s for s in _cut("".join(stack[0]), language))
    return shapes, "".join(brackets)


def _controls(now: list[str]) -> bool:
    """Whether the parenthesis just read belongs to if, for, while or a function, after which a statement follows."""
    return now[-2:-1] in (["I"], ["R"], ["W"], ["S"], ["Z"]) or now[-1:] == ["c"]


def _lexed_python(text: str) -> tuple[set[str], str]:
    keywords, shapes, brackets = grammars.KEYWORDS["python"], set(), []
    stack: list[list[str]] = [[]]
    opened: list[str] = []
    indents, deeper, start, before = [0], False, True, ""
    column = 0
    for m in grammars.LEXERS["python"].finditer(text):
        kind, word = m.lastgroup, m[0]
        if kind == "l":
            if not opened:
                if stack[0]:
                    line = "".join(stack[0])
                    shapes.add("top:" + line)
                    deeper = line.endswith(":")
                    stack[0].clear()
                start, before, column = True, "", 0
            continue
        if kind == "c":
            if start and word[0] in " \t\f":
                column = len(word.expandtabs(8))
            continue
        if start:
            start = False
            if deeper:
                if column <= indents[-1]:
                    shapes.add("top:!indent")
                else:
                    indents.append(column)
            elif column > indents[-1]:
                shapes.add("top:!indent")
            else:
                while indents and column < indents[-1]:
                    indents.pop()
                if not indents or indents[-1] != column:
                    shapes.add("top:!dedent")
                    indents.append(column)
            deeper = False
        if kind == "n":
            c = keywords.get(word, "n")
        elif kind in "sd":
            c = "!" if kind == "d" and _BAD_NUMBER.fullmatch(word) else kind
        elif kind == "o":
            c = "o" if word == "!=" else "!" if word in ("++", "--", "&&", "||", "!", "===", "!==", "=>", "::", "?", "#", "??", "?.", "$") and word not in ("--",) else grammars.operator(word, before, "python")
            if word == "::":
                stack[-1].append(":")
                c = ":"
            if word == "--" or word == "++":
                c = "o" if before in "ndspbc" and before else "u"
        else:
            c = "!"
        now = stack[-1]
        if c in _OPEN:
            brackets.append(c)
            opened.append(c)
            stack.append([])
            before = ""
        elif c in _CLOSE:
            brackets.append(c)
            if opened and opened[-1] == _CLOSE[c]:
                symbol = _OPEN[opened.pop()]
                shapes.add(f"{symbol}:{''.join(stack.pop())}")
                stack[-1].append(symbol)
                before = symbol
            else:
                now.append("!")
        else:
            now.append(c)
            before = c
    if stack[0]:
        shapes.add("top:" + "".join(stack[0]))
        deeper = stack[0][-1] == ":"
    if deeper:
        shapes.add("top:!indent")
    return shapes, "".join(brackets)


def derivable(language: str, context: str, shape: str) -> bool:
    """Whether a production of the language derives the shape in its context."""
    g = grammars.grammar(language)
    if "!" in shape:
        return False
    if context == "c" and language != "python":
        if g.allows("c", shape) or all(g.allows("block", s) for s in _cut(shape, language)):
            return True
        constants, _, members = shape.partition(";")
        return language == "java" and re.fullmatch(rf"(?:{grammars.ENUM_CONSTANTS})?", constants) is not None and all(g.allows("block", s) for s in _cut(members, language))
    return g.allows(context, shape)


def _lex_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        got = [lexed(text or "", language) for text, language in zip(pdf["text"], pdf["language"])]
        yield pd.DataFrame({"file_id": pdf["file_id"], "language": pdf["language"], "shapes": [sorted(s) for s, _ in got], "pairs": [sorted({s[i : i + 2] for x in shapes for s in [x.partition(":")[2]] for i in range(len(s) - 1)}) for shapes, _ in got], "brackets": [b for _, b in got]})


@F.pandas_udf(BooleanType())
def _underivable(language: pd.Series, shape: pd.Series) -> pd.Series:
    out = []
    for name, x in zip(language, shape):
        context, _, s = x.partition(":")
        out.append(not derivable(name, context, s))
    return pd.Series(out, dtype=bool)


@F.pandas_udf(BooleanType())
def _python_fails(texts: pd.Series) -> pd.Series:
    def fails(text: str) -> bool:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text.replace("\r\n", "\n").lstrip("﻿"))
            return False
        except (SyntaxError, ValueError):
            return True
        except (RecursionError, MemoryError):
            return False

    return texts.map(fails).astype(bool)


def bracket_faults(files: DataFrame) -> DataFrame:
    """(file_id) of files whose brackets don't nest, from (file_id, brackets)."""
    b = files.filter(F.length("brackets") > 0).select("file_id", F.posexplode(F.split("brackets", "")).alias("at", "b")).filter("b <> ''")
    opens = F.col("b").isin("(", "[", "{")
    by_file = Window.partitionBy("file_id").orderBy("at")
    depth = b.withColumn("depth", F.sum(F.when(opens, 1).otherwise(-1)).over(by_file.rowsBetween(Window.unboundedPreceding, 0)))
    level = depth.withColumn("level", F.when(opens, F.col("depth")).otherwise(F.col("depth") + 1))
    by_level = Window.partitionBy("file_id", "level").orderBy("at")
    partner = level.withColumn("prior", F.lag("b").over(by_level)).withColumn("next", F.lead("b").over(by_level))
    wanted = F.when(F.col("b") == ")", "(").when(F.col("b") == "]", "[").when(F.col("b") == "}", "{")
    fault = (F.col("depth") < 0) | (~opens & (F.col("prior").isNull() | (F.col("prior") != wanted))) | (opens & F.col("next").isNull())
    return partner.filter(fault).select("file_id").distinct()


def judged_texts(texts: DataFrame) -> DataFrame:
    """(file_id) of invalid texts, from (file_id, language, text), one row for each file."""
    spark = texts.sparkSession
    lex = reliable(texts.mapInPandas(_lex_all, "file_id bigint, language string, shapes array<string>, pairs array<string>, brackets string"))
    rows = [(name, a + b) for name in sorted(set(EXTENSIONS.values())) for a, b in grammars.permissible_pairs(name)]
    permitted = F.broadcast(spark.createDataFrame(rows, "language string, pair string"))
    pairs = lex.select("file_id", "language", F.explode("pairs").alias("pair"))
    first, second = F.substring("pair", 1, 1), F.substring("pair", 2, 1)
    wild = permitted.filter(F.col("pair").contains("*"))
    odd = pairs.join(permitted, ["language", "pair"], "left_anti")
    odd = odd.withColumn("w1", F.concat(first, F.lit("*"))).withColumn("w2", F.concat(F.lit("*"), second))
    odd = odd.join(F.broadcast(wild.select("language", F.col("pair").alias("w1"))), ["language", "w1"], "left_anti").join(F.broadcast(wild.select("language", F.col("pair").alias("w2"))), ["language", "w2"], "left_anti")
    shapes = lex.select("file_id", "language", F.explode("shapes").alias("shape"))
    kinds = shapes.select("language", "shape").distinct().filter(_underivable("language", "shape"))
    unmatched = shapes.join(kinds, ["language", "shape"], "left_semi")
    return odd.select("file_id").unionByName(unmatched.select("file_id")).unionByName(bracket_faults(lex.select("file_id", "brackets"))).distinct()


def latest_scans(parse_results: DataFrame) -> DataFrame:
    """The latest scan of every file, by scanned_at."""
    cols = [c for c in ("repo", "filepath", "language", "success", "error") if c in parse_results.columns]
    latest = F.max_by(F.struct(*cols), F.struct("scanned_at", F.coalesce("error", F.lit("")), "filepath"))
    return parse_results.filter(F.col("file_id").isNotNull()).groupBy("file_id").agg(latest.alias("r")).select("file_id", *[F.col(f"r.{c}").alias(c) for c in cols])


def _is_syntax_error(error: Column) -> Column:
    return error.rlike(SYNTAX_ERROR) & ~error.rlike(r"(?i)^(?:Unsupported extension|No parser|\[Errno|timed out|file size|worker lost)")


def invalid_files(parse_results: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_id) of files that are syntactically invalid for the language of their extension."""
    files = chunks.filter((F.col("chunk_type") == "file") & F.col("file_id").isNotNull()).withColumn("language", language_of(F.col("filepath")))
    texts = files.filter(F.col("language").isNotNull() & F.col("text").isNotNull()).select("file_id", "language", "text").dropDuplicates(["file_id"])
    suspects = judged_texts(texts)
    python = texts.filter(F.col("language") == "python").join(suspects, "file_id", "left_semi")
    wrong = suspects.join(python.filter(~_python_fails("text")).select("file_id"), "file_id", "left_anti")
    scans = latest_scans(parse_results).filter(language_of(F.col("filepath")).isNotNull())
    untold = scans.join(files.select("file_id"), "file_id", "left_anti").filter((~F.coalesce("success", F.lit(False))) & _is_syntax_error(F.col("error"))).select("file_id")
    return wrong.unionByName(untold)


def invalid_rates(parse_results: DataFrame, chunks: DataFrame) -> DataFrame:
    """(repo, language, files, invalid_files, invalid_share) over all files of supported extensions."""
    scans = latest_scans(parse_results).withColumn("language", language_of(F.col("filepath"))).filter(F.col("language").isNotNull())
    bad = invalid_files(parse_results, chunks).withColumn("bad", F.lit(1))
    grouped = scans.join(bad, "file_id", "left").groupBy("repo", "language").agg(F.count("*").alias("files"), F.count("bad").alias("invalid_files"))
    return grouped.withColumn("invalid_share", F.round(F.col("invalid_files") / F.col("files"), 6))
