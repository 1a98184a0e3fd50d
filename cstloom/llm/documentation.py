"""Functions paired with their documentation comment (problem 4).

Candidates are a function's own ones (docstring field, the comment or docstring in
the head of its text) and the comments of the whole file.  A comment of the file
is offered to every unit, functions and classes alike, that begins on the next
line of code or up to REACH lines further; decorators and attributes may lie
between.  Links are weighed by their kind, parameter tags, the names mentioned,
and distance, the blank and code lines between; links below PLAUSIBLE are
rejected, and so are descriptions that say nothing (see ``says_something``).

What is left is a bipartite graph in which each unit takes one comment and each
comment one unit.  Links without a rival are taken at once.  Rivals are parted
into stretches of a file that share no line, and each stretch gets the assignment
of the greatest total weight (``best_assignment``), in which a unit may also keep
its own comment and leave one of the file to another unit.

Comments meet units in an equi-join on file and line, and a stretch only grows as
long as rivals stand within REACH lines, so no file is ever gathered in a task.
Defined results: null and empty texts have no head; a null docstring or a file
without a file chunk just gives fewer candidates; of equally heavy assignments the
first units keep the first comments; rows delivered twice count once; empty tables
give empty tables; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cstloom.llm.common import FUNCTION_TYPES, functions_of
from cstloom.session import reliable

#: Comments that stand for missing documentation, and words that add nothing to a name.
PLACEHOLDERS = {
    "", "todo", "fixme", "xxx", "hack", "n/a", "na", "none", "tbd", "tba", "docs", "doc", "helper", "description goes here", "description", "auto-generated method stub",
    "auto generated method stub", "see above", "see below", "write this down", "documentation", "comment", "no description", "missing docs", "add docs", "undocumented", "wip", "stub", "foo", "test", "temp",
}
FILLERS = set("a an the this that it is of for to and function method procedure routine helper func fn def constructor class does do".split())
#: Lines of code beyond the next one whose units a comment is offered to, weight of a line between, and the least weight of a link to a comment of the file.
REACH, LINE, PLAUSIBLE = 2, 0.75, 2.0
#: Weights of the kinds of candidates.
KINDS = {"docstring": 4.0, "inner": 3.0, "head": 3.0, "above": 2.0}
#: Descriptions of at most so many words say nothing if half of them are the function's name.
SHORT = 5
_DIRECTIVE = re.compile(r"(?i)^(?:noqa|nosec|pragma\b|pylint\b|flake8\b|mypy\b|type:\s*ignore|eslint|tslint|jshint|prettier|istanbul|nolint|go:|clang-format|cspell|@?inheritdoc|\{@inheritdoc|@ts-|@formatter|region\b|endregion\b|spdx-|copyright\b|todo\b|fixme\b|xxx\b|hack\b|@\w|:\w+[^:]*:|\\(?:param|return|see)|=>)")
_CODE = re.compile(r"""^(?:[\w.\[\]'"]+\s*(?:[-+*/|&:]?=)\s*\S|(?:return|if|for|while|import|from|const|let|var|auto|else|elif|def|func|fn|raise|throw)\b.*[;({=:)\]]\s*$|.*;\s*$|[\w.]+\([^)]*\)\s*$|[{}()\[\]]+$)""")
_LEAD = re.compile(r"^\s*(?:/\*+!?|\*+/|\*+(?!\w)|///*!?|#+!?|--)?\s?")
_TAG = re.compile(r"^\s*(?:[@\\]\w+|:(?:param|type|return|returns|rtype|raises|see)\b)")
_PARAM = re.compile(r"(?:@param|\\param|:param)(?:\s+\{[^}]*\})?\s+([^\W\d]\w*)")
_COMMENT = re.compile(r"\s*(?://|/\*|\*|#(?!\s*(?:include|define|if|ifdef|ifndef|endif|else|elif|undef|pragma|error|line|region|endregion)\b)(?!\[)(?!!))")
_DECORATION = re.compile(r"\s*(?:@\w|#!?\[|\[[A-Z]\w*.*\]\s*$|template\s*<)")
_PY_HEAD = re.compile(r"^[ \t]*(?:async[ \t]+)?def\b", re.M)
_STRING = re.compile(r"""[rRbBuU]{0,2}(\"\"\"|'''|"|')""")


def split_name(name: str) -> set[str]:
    return {w.lower() for w in re.findall(r"[A-Z]?[a-z\d]+|[A-Z]+(?![a-z])|[^\W\d_a-zA-Z]+", name)}


def body_of(comment: str) -> list[str]:
    """The lines of a comment or docstring without its marks, XML tags and quotes."""
    text = re.sub(r"</?[A-Za-z][^<>]*>", " ", comment.replace("\r\n", "\n").replace("\r", "\n"))
    text = re.sub(r"\*+/", " ", text.replace('"""', " ").replace("'''", " "))
    return [_LEAD.sub("", line, count=1).strip() for line in text.split("\n")]


def says_something(comment: str | None, name: str | None) -> bool:
    """Whether a comment tells something of the function.

    Not if it is empty, a placeholder, a reminder, decoration, only tags or
    directives, disabled code, or only repeats the name.
    """
    if not comment:
        return False
    parts = split_name(name or "")
    for line in body_of(comment):
        if _TAG.match(line):
            continue
        line = re.sub(rf"^{re.escape(name)}\s*(?:\([^)]*\))?\s*[:\-–]\s*", "", line) if name else line
        line = re.sub(r"^[^\W\d]\w*[a-z_][A-Z_]\w*:\s+", "", line).strip(" \"'`")
        if not any(c.isalpha() for c in line) or _DIRECTIVE.match(line) or _CODE.match(line) or line.lower().strip(" .:!?-…*=#") in PLACEHOLDERS:
            continue
        words = {w.lower() for w in re.findall(r"[^\W\d_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", line))}
        stems = parts | {p + e for p in parts for e in ("s", "es", "ing", "ed", "d")}
        told = words - FILLERS
        if re.fullmatch(r"\w+", line) or len(told) <= SHORT and 2 * len(told & stems) >= len(told):
            continue  # a name, or little else than the parts of one
        if told - stems:
            return True
    return False


def head_comment(text: str) -> str | None:
    """The comment with which a function's text begins."""
    lines, got, block = text.split("\n"), [], False
    for line in lines:
        if block or _COMMENT.match(line):
            got.append(line)
            block = (block or line.lstrip().startswith("/*")) and "*/" not in line
        elif got or not line.strip() == "":
            break
    return "\n".join(got) or None


def python_docstring(text: str) -> str | None:
    """The string literal with which the body of a Python function begins."""
    m = _PY_HEAD.search(text)
    if not m:
        return None
    at, depth, n = m.end(), 0, len(text)
    while at < n and not (text[at] == ":" and depth == 0):
        if text[at] in "([{":
            depth += 1
        elif text[at] in ")]}":
            depth -= 1
        elif (s := _STRING.match(text, at)) and text[at] in "\"'":
            end = text.find(s[1], s.end())
            at = n if end < 0 else end + len(s[1]) - 1
        at += 1
    rest = re.compile(r"(?:[ \t]*(?:#[^\n]*)?\n)*[ \t]*").match(text, at + 1)
    s = _STRING.match(text, rest.end()) if rest else None
    if not s:
        return None
    end = text.find(s[1], s.end())
    return text[s.end() :] if end < 0 else text[s.end() : end]


def file_comments(text: str) -> list[tuple[int, list[tuple[int, int]], str]]:
    """(first line, offers, text) of every comment block that stands alone on its lines, from 1; an offer is a line and the lines between."""
    lines = text.replace("﻿", "").split("\n")
    out, i, n = [], 0, len(lines)
    while i < n:
        if not _COMMENT.match(lines[i]) or lines[i].lstrip().startswith("*"):
            i += 1
            continue
        start = i
        if lines[i].lstrip().startswith("/*"):
            while i < n and "*/" not in lines[i]:
                i += 1
            i += 1
        else:
            mark = lines[i].lstrip()[:1]
            while i < n and _COMMENT.match(lines[i]) and lines[i].lstrip()[:1] == mark and not lines[i].lstrip().startswith("/*"):
                i += 1
        offers, far, at, open_ = [], 0, i, 0
        while at < n and far <= REACH:
            line = lines[at]
            at += 1
            if not line.strip():
                far += 1
                continue
            offers.append((at, far))
            decoration = open_ > 0 or bool(_DECORATION.match(line))
            open_ = max(0, open_ + sum(map(line.count, "([{")) - sum(map(line.count, ")]}"))) if decoration else 0
            far += not decoration
        out.append((start + 1, offers, "\n".join(lines[start:i])))
    return out


def best_assignment(links: dict[int, list[tuple[int, float]]], own: dict[int, float]) -> dict[int, int]:
    """The comment of every unit in the assignment of the greatest total weight.

    links: the comments of each unit with their weights; own: what a unit is worth
    without one.  Units come in one after another; each takes the chain of changes
    that gains most and ends at a free comment or at a unit that goes without.
    """
    taken: dict[int, int] = {}
    weight = {(u, c): w for u, some in links.items() for c, w in some}
    for unit in links:
        gain, via, todo = {unit: 0.0}, {}, [unit]
        best, end = own.get(unit, 0.0), (unit, None)
        while todo:
            u = todo.pop(0)
            for c, w in links[u]:
                value = gain[u] + w
                other = taken.get(c)
                if other is None:
                    if value > best + 1e-9:
                        best, end = value, (u, c)
                elif other != u:
                    left = value - weight[other, c]
                    if left > gain.get(other, -np.inf) + 1e-9 and other != unit:
                        gain[other], via[other] = left, (u, c)
                        todo.append(other)
                        if left + own.get(other, 0.0) > best + 1e-9:
                            best, end = left + own.get(other, 0.0), (other, None)
        u, c = end
        moves = [(u, c)] if c is not None else []
        while u in via:
            u, c = via[u]
            moves.append((u, c))
        for u, c in moves:
            taken[c] = u
    return {u: c for c, u in taken.items()}


def _own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for no, text, docstring in zip(pdf["chunk_no"], pdf["text"], pdf["docstring"]):
            text = (text or "").replace("\r\n", "\n").lstrip("﻿")
            rows += [(no, s, c) for s, c in (("docstring", docstring), ("head", head_comment(text)), ("inner", python_docstring(text))) if c]
        yield pd.DataFrame(rows, columns=["chunk_no", "source", "comment"])


def _comments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(f, at, line, far, c) for f, text in zip(pdf["file_id"], pdf["text"]) for at, offers, c in file_comments((text or "").replace("\r\n", "\n")) for line, far in offers]
        yield pd.DataFrame(rows, columns=["file_id", "at", "line", "far", "comment"])


def _weights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The useful and plausible links; a comment whose parameter tags all name other things than the function has is implausible."""
    for pdf in batches:
        weights = []
        for name, signature, source, far, comment in zip(pdf["name"], pdf["signature"], pdf["source"], pdf["far"], pdf["comment"]):
            tags = _PARAM.findall(comment)
            known = sum(bool(re.search(rf"\b{re.escape(t)}\b", signature or "")) for t in tags)
            mention = bool(name) and bool(re.search(rf"(?<!\w){re.escape(name)}(?!\w)", comment))
            weight = KINDS[source] + (known / len(tags) if tags else 0.5) + 0.5 * mention - LINE * far
            fits = (not tags or known or mention) and (source != "above" or weight >= PLAUSIBLE)
            weights.append(weight if fits and says_something(comment, name) else None)
        yield pdf.assign(weight=weights)[["chunk_no", "file_id", "line_start", "at", "source", "comment", "weight"]].dropna(subset=["weight"])


def _assigned(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["line_start", "chunk_no", "at"], kind="stable")
    links: dict[int, list[tuple[int, float]]] = {}
    for u, c, w in zip(pdf["chunk_no"].tolist(), pdf["at"].tolist(), pdf["weight"].tolist()):
        links.setdefault(u, []).append((c, w))
    got = best_assignment(links, dict(zip(pdf["chunk_no"].tolist(), pdf["own"].tolist())))
    return pdf[[got.get(u) == c for u, c in zip(pdf["chunk_no"].tolist(), pdf["at"].tolist())]][["chunk_no", "file_id", "at"]]


def assigned(links: DataFrame) -> DataFrame:
    """(chunk_no, file_id, at) from links (chunk_no, file_id, at, line_start, weight, own) that are worth more than the unit's own comment."""
    count = lambda *keys: F.count("*").over(Window.partitionBy(*keys))
    counted = links.withColumn("rivals", F.greatest(count("chunk_no"), count("file_id", "at")))
    rivals = counted.filter("rivals > 1")
    before = Window.partitionBy("file_id").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    begins = rivals.withColumn("new", F.coalesce(F.col("at") > F.max("line_start").over(before), F.lit(True)).cast("int"))
    stretch = begins.withColumn("stretch", F.sum("new").over(Window.partitionBy("file_id").orderBy("at")))
    solved = stretch.groupBy("file_id", "stretch").applyInPandas(_assigned, "chunk_no bigint, file_id bigint, at int")
    return counted.filter("rivals = 1").select("chunk_no", "file_id", "at").unionByName(solved)


def documented(chunks: DataFrame) -> DataFrame:
    """(chunk_no, source, documentation): the useful documentation of every function that has one."""
    fn = functions_of(chunks).select("chunk_no", "text", "docstring")
    units = chunks.filter(F.col("chunk_no").isNotNull() & (F.col("chunk_type") != "file"))
    # the signature is what precedes the body: up to the first brace or the first line end after a colon
    signature = F.regexp_extract("text", r"(?s)^.*?\)[^\n]*?[{:]", 0)
    about = units.select("chunk_no", "file_id", "name", F.col("line_start").cast("int").alias("line_start"), F.col("chunk_type").isin(*FUNCTION_TYPES).alias("function"), F.when(F.length(signature) > 0, signature).otherwise(F.col("text")).alias("signature")).dropDuplicates(["chunk_no"])
    own = fn.mapInPandas(_own, "chunk_no bigint, source string, comment string").distinct()
    files = chunks.filter((F.col("chunk_type") == "file") & F.col("text").isNotNull() & F.col("file_id").isNotNull())
    comments = files.select("file_id", "text").mapInPandas(_comments, "file_id bigint, at int, line int, far int, comment string").distinct()
    above = about.join(comments.withColumnRenamed("file_id", "in_file"), (F.col("file_id") == F.col("in_file")) & (F.col("line_start") == F.col("line"))).select("chunk_no", "file_id", "name", "signature", "line_start", "at", "far", F.lit("above").alias("source"), "comment")
    none = F.lit(None).cast("int")
    inside = about.filter("function").join(own, "chunk_no").select("chunk_no", "file_id", "name", "signature", "line_start", none.alias("at"), F.lit(0).alias("far"), "source", "comment")
    links = reliable(above.unionByName(inside).mapInPandas(_weights, "chunk_no bigint, file_id bigint, line_start int, at int, source string, comment string, weight double"))
    best = F.max_by(F.struct("source", "comment", "weight"), F.struct("weight", "comment"))
    kept = links.filter("at is null").groupBy("chunk_no").agg(best.alias("b"))
    worth = links.filter("at is not null").select("chunk_no", "file_id", "at", "line_start", "weight").join(kept.select("chunk_no", F.col("b.weight").alias("own")), "chunk_no", "left").withColumn("own", F.coalesce("own", F.lit(0.0)))
    taken = assigned(worth.filter("weight > own")).join(links.select("chunk_no", "at", "source", "comment", "weight"), ["chunk_no", "at"])
    some = taken.select("chunk_no", F.struct("source", "comment", "weight").alias("b")).unionByName(kept).groupBy("chunk_no").agg(F.max_by("b", F.col("b.weight")).alias("b"))
    functions = about.filter("function").select("chunk_no")
    return some.join(functions, "chunk_no", "left_semi").select("chunk_no", F.col("b.source").alias("source"), F.col("b.comment").alias("documentation"))


def pairs(chunks: DataFrame) -> DataFrame:
    """(chunk_no, code, documentation) of every documented function."""
    code = functions_of(chunks).select("chunk_no", F.col("text").alias("code")).dropDuplicates(["chunk_no"])
    return code.join(documented(chunks), "chunk_no").select("chunk_no", "code", "documentation")
