"""Definitions and call, inheritance and method edges of Python texts.

A text becomes rows of a node table (see ``sources.files.python_tree`` and
``operators.nested``); definitions are a projection of it, and edges are joins on
the number of a parent, or of the functions whose intervals hold a call.

Names are bare, as written.  Asynchronous functions are neither definitions nor
callers; a call inside a nested function counts for the inner and the outer one;
bases that are not simple names are skipped.  Texts that don't parse become
rejects.  ``upsert_edges`` and ``upsert_nodes`` give the graph in which nodes and
edges of one name collapse and the last attributes win, in the order of paths and,
in a file, of the levels of definitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cstloom.operators import nested
from cstloom.session import reliable
from cstloom.sources.files import python_tree

TABLE = "doc bigint, file string, kind string, pre int, parent_pre int, depth int, type string, name string, lineno int, docstring string, source string, callers array<int>"
#: Node types that definitions and edges are made of, and what definitions are called.
KEPT = {"function_definition": "FunctionDef", "class_definition": "ClassDef", "call": None, "block": None, "argument_list": None, "identifier": None}


def facts(texts: DataFrame, file: str = "filepath", text: str = "text") -> DataFrame:
    """The node table of all texts, written once; kind reject carries the error as docstring.

    doc tells texts of one path apart; callers are the functions around a call.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for doc, path, code in zip(pdf["doc"], pdf[file], pdf[text]):
                try:
                    root = python_tree((code or "").replace("\r\n", "\n").lstrip("﻿"), path or "")
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append((doc, path, "reject", None, None, None, type(e).__name__, None, None, str(e), None, None))
                    continue
                nodes, parents, depths, _ = nested.walk(root)
                around: list[list[int]] = []
                for i, n in enumerate(nodes):
                    outer = around[parents[i]] if i else []
                    around.append([*outer, i] if n["type"] == "function_definition" else outer)
                    if n["type"] in KEPT:
                        defines = KEPT[n["type"]] is not None
                        rows.append((doc, path, "node", i, parents[i], depths[i], n["type"], n.get("name"), n["start_point"][0] + 1, n.get("docstring"), n["text"] if defines else None, around[i] if n["type"] == "call" else None))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in TABLE.split(", ")])
            yield out.astype({c: "Int32" for c in ("pre", "parent_pre", "depth", "lineno")})

    return reliable(texts.select(F.xxhash64(file, text).alias("doc"), file, text).mapInPandas(run, TABLE))


def definitions(table: DataFrame) -> DataFrame:
    """(name, type, lineno, file, docstring, source) of functions and classes."""
    kind = F.when(F.col("type") == "function_definition", KEPT["function_definition"]).when(F.col("type") == "class_definition", KEPT["class_definition"])
    return table.filter("kind = 'node'").withColumn("type", kind).filter(F.col("type").isNotNull()).select("name", "type", "lineno", "file", "docstring", "source")


def edges(table: DataFrame) -> DataFrame:
    """(src, dst, type, file, seq): all edges with the file and the place they come from, repeated ones too."""
    of = lambda kind: table.filter((F.col("kind") == "node") & (F.col("type") == kind))
    owner = lambda kind: of(kind).select("doc", F.col("pre").alias("o_pre"), F.col("depth").alias("o_depth"), F.col("name").alias("src"))
    inside = lambda kind: of(kind).select("doc", F.col("parent_pre").alias("o_pre"), F.col("pre").alias("parent_pre"))

    def between(rows: DataFrame, kind: str, rank: int) -> DataFrame:
        seq = F.struct("o_depth", "o_pre", F.lit(rank).alias("rank"), "depth", "pre")
        return rows.select("src", F.col("name").alias("dst"), F.lit(kind).alias("type"), "file", seq.alias("seq"))

    calls = of("call").filter(F.col("name").isNotNull()).select("doc", "file", "name", "depth", "pre", F.explode("callers").alias("o_pre"))
    through = lambda kind, by: of(kind).select("doc", "file", "name", "depth", "pre", "parent_pre").join(inside(by), ["doc", "parent_pre"]).join(owner("class_definition"), ["doc", "o_pre"])
    called = between(calls.join(owner("function_definition"), ["doc", "o_pre"]), "calls", 0)
    return called.unionByName(between(through("identifier", "argument_list"), "inherits", 0)).unionByName(between(through("function_definition", "block"), "defines_method", 1))


def upsert_edges(all_edges: DataFrame) -> DataFrame:
    """(src, dst, type): one edge for each pair of names, the last type wins; combines on the map side."""
    return all_edges.groupBy("src", "dst").agg(F.max_by("type", F.struct("file", "seq")).alias("type"))


def upsert_nodes(defs: DataFrame, one_edge_each: DataFrame) -> DataFrame:
    """(name, type, file): the last definition of every name; names that only edges know have no attributes."""
    known = defs.groupBy("name").agg(F.max_by(F.struct("type", "file"), F.struct("file", "lineno")).alias("d")).select("name", F.col("d.type").alias("type"), F.col("d.file").alias("file"))
    names = one_edge_each.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    return names.join(known.select("name"), "name", "left_anti").select("name", F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("file")).unionByName(known)


def write_graphml(nodes: DataFrame, one_edge_each: DataFrame, path: str) -> None:
    """A GraphML file written row by row on the driver, for graphs that one tool can open; large ones stay tables."""
    from xml.sax.saxutils import escape, quoteattr

    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        for k, (on, name) in enumerate((("node", "type"), ("node", "file"), ("edge", "type"))):
            f.write(f'<key id="d{k}" for="{on}" attr.name="{name}" attr.type="string"/>\n')
        f.write('<graph edgedefault="directed">\n')
        for r in nodes.orderBy("name").toLocalIterator():
            data = "".join(f'<data key="d{k}">{escape(v)}</data>' for k, v in ((0, r.type), (1, r.file)) if v is not None)
            f.write(f"<node id={quoteattr(r.name)}>{data}</node>\n")
        for r in one_edge_each.orderBy("src", "dst").toLocalIterator():
            f.write(f'<edge source={quoteattr(r.src)} target={quoteattr(r.dst)}><data key="d2">{escape(r.type)}</data></edge>\n')
        f.write("</graph>\n</graphml>\n")
