"""Deeply nested tree records turned into flat, related node tables.

Every node of a record gets interval labels by a depth-first walk: ``pre`` (its
preorder number), ``post`` (its postorder number) and ``last`` (the preorder
number of its last descendant).  ``x`` lies below ``u`` exactly if they share
``file_id`` and ``u.pre < x.pre <= u.last``; the innermost such ``u`` is the
parent, and that is how links are made (``innermost``).  Null entries of
``children`` get no number, one object in place of the array is the only child.

A record is parsed once: the walk gives one row per record, with its nodes as an
array, and the rows of a file are combined on the map side before one is left.

Defined results: records with a null file_id, null or unreadable JSON, or
without a root object that has a type give no rows; of the readable records of
a file the one with the greatest written_at counts (null is the smallest, then
a hash of the text decides); an empty table gives an empty table; further columns
of the input are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from json.decoder import scanstring

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "file_id bigint, pre bigint, post bigint, last bigint, parent_pre bigint, depth int, ord int, type string, text string, "
    "start_byte bigint, end_byte bigint, start_row bigint, start_col bigint, end_row bigint, end_col bigint, is_named boolean"
)
#: Columns that only some operators ask for: the levels below a node, and the nodes of given types whose intervals hold it, itself included, outermost first.
MORE_COLUMNS = "height int, units array<bigint>"
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
_TYPES = dict(x.split() for x in f"{NODE_SCHEMA}, {MORE_COLUMNS}".split(", "))
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?")
_SPACE = re.compile(r"[ \t\r\n]*")
_WORDS = {"true": True, "false": False, "null": None}


def _loads_deep(text: str):
    """JSON without recursion, for records nested deeper than the C scanner goes."""
    stack: list = []
    at = _SPACE.match(text).end()
    while True:
        c = text[at : at + 1]
        if c == "{" or c == "[":
            stack.append([{} if c == "{" else [], None])
            at = _SPACE.match(text, at + 1).end()
            if text[at : at + 1] not in ("}", "]"):
                if c == "{":
                    at = _key(text, at, stack[-1])
                continue
            value = None
        elif c == '"':
            value, at = scanstring(text, at + 1, False)
            value = (value,)
        elif m := _NUMBER.match(text, at):
            value, at = (json.loads(m[0]),), m.end()
        else:
            word = next((w for w in _WORDS if text.startswith(w, at)), None)
            if word is None:
                raise ValueError("unreadable")
            value, at = (_WORDS[word],), at + len(word)
        while True:
            at = _SPACE.match(text, at).end()
            if value is not None:
                if not stack:
                    if at != len(text):
                        raise ValueError("text after the value")
                    return value[0]
                box, key = stack[-1]
                if isinstance(box, dict):
                    box[key] = value[0]
                else:
                    box.append(value[0])
            end = text[at : at + 1]
            if end == "," and value is not None:
                at = _SPACE.match(text, at + 1).end()
                if isinstance(stack[-1][0], dict):
                    at = _key(text, at, stack[-1])
                break
            if end == ("}" if isinstance(stack[-1][0], dict) else "]"):
                value, at = (stack.pop()[0],), at + 1
                continue
            raise ValueError("unreadable")


def _key(text: str, at: int, frame: list) -> int:
    if text[at : at + 1] != '"':
        raise ValueError("unreadable")
    frame[1], at = scanstring(text, at + 1, False)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError("unreadable")
    return _SPACE.match(text, at + 1).end()


def load_root(text: str | None) -> dict | None:
    """The root node of a record, or None if the record is not readable."""
    if not text:
        return None
    try:
        try:
            doc = json.loads(text)
        except RecursionError:
            doc = _loads_deep(text)
    except ValueError:
        return None
    root = doc.get("cst") if isinstance(doc, dict) else None
    return root if isinstance(root, dict) and root.get("type") is not None else None


def children_of(node: dict) -> list[dict]:
    kids = node.get("children")
    if isinstance(kids, dict):
        return [kids]
    return [k for k in kids if isinstance(k, dict)] if isinstance(kids, list) else []


def walk(root: dict) -> tuple[list[dict], list[int], list[int], list[int]]:
    """Nodes in preorder with the number of the parent (-1: none), the depth and the place among the siblings."""
    nodes, parents, depths, ords = [], [], [], []
    stack = [(root, -1, 0, 0)]
    while stack:
        node, parent, depth, place = stack.pop()
        me = len(nodes)
        nodes.append(node)
        parents.append(parent)
        depths.append(depth)
        ords.append(place)
        if node.get("children"):
            kids = children_of(node)
            stack.extend([(kids[i], me, depth + 1, i) for i in range(len(kids) - 1, -1, -1)])
    return nodes, parents, depths, ords


def _whole(x):
    return int(x) if isinstance(x, (int, float)) and not isinstance(x, bool) and x == x and abs(x) < 2**63 else None


def _point(p) -> tuple[int | None, int | None]:
    """Points come as [row, column] or as an object with row and column."""
    if isinstance(p, list):
        return (_whole(p[0]) if p else None, _whole(p[1]) if len(p) > 1 else None)
    if isinstance(p, dict):
        return _whole(p.get("row")), _whole(p.get("column", p.get("col")))
    return None, None


def innermost(last: np.ndarray) -> np.ndarray:
    """The innermost interval around each of a tree's intervals (position, last), -1 for the root.

    The depth of an interval is the number of intervals that are open where it
    begins; the one around it is the latest of the depth above that began before.
    """
    n = len(last)
    pre = np.arange(n)
    depth = np.cumsum(np.bincount(pre + 1, minlength=n + 1)[:n] - np.bincount(last + 1, minlength=n + 1)[:n]) if n else pre
    order = np.lexsort((pre, depth))
    at = np.searchsorted(depth[order] * np.int64(n + 1) + pre[order], (depth - 1) * np.int64(n + 1) + pre) - 1
    return np.where(depth > 0, order[np.maximum(at, 0)], -1)


def _labelled(root: dict, columns: list[str], unit_types: frozenset[str] = frozenset()) -> dict[str, list]:
    nodes, parents, depths, ords = walk(root)
    n = len(nodes)
    size = [1] * n
    for i in range(n - 1, 0, -1):
        size[parents[i]] += size[i]
    last = [i + s - 1 for i, s in enumerate(size)]
    out: dict[str, list] = {"pre": list(range(n)), "last": last, "post": [x - d for x, d in zip(last, depths)], "depth": depths, "ord": ords}
    if "height" in columns:
        out["height"] = [0] * n
        for i in range(n - 1, 0, -1):
            out["height"][parents[i]] = max(out["height"][parents[i]], out["height"][i] + 1)
    if "units" in columns:
        out["units"] = []
        for i, node in enumerate(nodes):
            around = out["units"][parents[i]] if i else []
            out["units"].append([*around, i] if node.get("type") in unit_types else around)
    if "parent_pre" in columns:
        out["parent_pre"] = [None if p < 0 else p for p in innermost(np.array(last)).tolist()]
    for c in ("type", "text"):
        if c in columns:
            out[c] = [x if isinstance(x := node.get(c), str) or x is None else json.dumps(x) for node in nodes]
    for c in ("start_byte", "end_byte"):
        if c in columns:
            out[c] = [_whole(node.get(c)) for node in nodes]
    for side in ("start", "end"):
        if f"{side}_row" in columns or f"{side}_col" in columns:
            points = [_point(node.get(f"{side}_point")) for node in nodes]
            out[f"{side}_row"], out[f"{side}_col"] = [p[0] for p in points], [p[1] for p in points]
    if "is_named" in columns:
        out["is_named"] = [x if isinstance(x := node.get("is_named"), bool) else None for node in nodes]
    return {c: out[c] for c in columns}


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """An Arrow array; halves of surrogate pairs, which UTF-8 can't hold, become question marks."""
    try:
        return pa.array(values, kind)
    except UnicodeEncodeError:
        return pa.array([x if x is None else x.encode("utf-8", "replace").decode() for x in values], kind)


def _rows(keys: list[str], types: list[str], records: list[tuple], parts: list[pa.Array], sizes: list[int]) -> pa.RecordBatch:
    """A batch with the key columns and, per record, its nodes as an array of structs."""
    nodes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.concat_arrays(parts))
    columns = [pa.array([r[i] for r in records], t) for i, t in enumerate(types)]
    return pa.RecordBatch.from_arrays([*columns, nodes], names=[*keys, "nodes"])


def valid_trees(records: DataFrame, columns: list[str], unit_types: Iterable[str] = ()) -> DataFrame:
    """(file_id, nodes): the labelled nodes of the readable record with the greatest written_at of every file."""
    types_of_units = frozenset(unit_types)
    kind = pa.struct([(c, _ARROW[_TYPES[c]]) for c in columns])
    keys, types = ["file_id", "written_at", "tie"], [pa.int64(), pa.timestamp("us", "UTC"), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, parts, sizes = [], [], []
            for file_id, written_at, tie, text in zip(*(batch.column(c) for c in (*keys, "cst_json"))):
                root = load_root(text.as_py())
                if root is None:
                    continue
                nodes = _labelled(root, columns, types_of_units)
                held.append((file_id.as_py(), written_at.as_py(), tie.as_py()))
                parts.append(pa.StructArray.from_arrays([_column(nodes[c], kind.field(c).type) for c in columns], fields=list(kind)))
                sizes.append(len(parts[-1]))
                if sum(sizes) > 50_000:
                    yield _rows(keys, types, held, parts, sizes)
                    held, parts, sizes = [], [], []
            if held:
                yield _rows(keys, types, held, parts, sizes)

    few = records.filter(F.col("file_id").isNotNull() & F.col("cst_json").isNotNull()).select("file_id", F.col("written_at").cast("timestamp").alias("written_at"), F.xxhash64("cst_json").alias("tie"), "cst_json")
    struct = ", ".join(f"{c}: {_TYPES[c]}" for c in columns)
    parsed = few.mapInArrow(run, f"file_id bigint, written_at timestamp, tie bigint, nodes array<struct<{struct}>>")
    return parsed.groupBy("file_id").agg(F.max_by("nodes", F.struct("written_at", "tie")).alias("nodes"))


def valid_records(records: DataFrame) -> DataFrame:
    """(file_id, cst_json): the readable record with the greatest written_at of every file, for those who read the JSON themselves.

    ``max_by`` combines on the map side, so however many records a file has, at
    most one of them per input partition is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([load_root(t.as_py()) is not None for t in batch.column("cst_json")], pa.bool_()))

    few = records.filter(F.col("file_id").isNotNull() & F.col("cst_json").isNotNull()).select("file_id", "written_at", F.xxhash64("cst_json").alias("tie"), "cst_json")
    return few.mapInArrow(run, few.schema).groupBy("file_id").agg(F.max_by("cst_json", F.struct("written_at", "tie")).alias("cst_json"))


def flatten_trees(records: DataFrame, columns: list[str] | None = None, unit_types: Iterable[str] = ()) -> DataFrame:
    """One row per node of every file's valid record, with the columns asked for (see NODE_SCHEMA and MORE_COLUMNS)."""
    names = list(columns or [x.split()[0] for x in NODE_SCHEMA.split(", ")])
    inner = [c for c in names if c != "file_id"]
    return valid_trees(records, inner, unit_types).select("file_id", F.inline("nodes")).select(*names)


def child_links(records: DataFrame) -> DataFrame:
    """(file_id, parent_pre, child_pre): every node but the roots with the innermost interval around it.

    Only the intervals of the valid records are shuffled, and a file's links come
    from them alone.
    """
    schema = pa.schema([("file_id", pa.int64()), ("parent_pre", pa.int64()), ("child_pre", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, last in zip(batch.column("file_id"), batch.column("last")):
                around = innermost(np.array(last.values))
                child = np.flatnonzero(around >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(child), file_id.as_py())), pa.array(around[child]), pa.array(child)], schema=schema)

    intervals = valid_trees(records, ["last"]).select("file_id", F.col("nodes.last").alias("last"))
    return intervals.mapInArrow(run, "file_id bigint, parent_pre bigint, child_pre bigint")


def type_counts(nodes: DataFrame) -> DataFrame:
    """(type, nodes, files, with_parent): how many rows the table of each node type has."""
    per_file = nodes.groupBy("type", "file_id").agg(F.count("*").alias("n"), F.count("parent_pre").alias("p"))
    return per_file.groupBy("type").agg(F.sum("n").alias("nodes"), F.count("*").alias("files"), F.sum("p").alias("with_parent"))


def write_type_tables(nodes: DataFrame, folder: str) -> None:
    """The node tables of all types in one pass, one folder ``type=...`` each; file_id and the intervals relate them."""
    nodes.write.mode("overwrite").partitionBy("type").parquet(folder)


def type_table(nodes: DataFrame, kind: str) -> DataFrame:
    """The table of one node type; its rows relate to any other node table by interval containment."""
    return nodes.filter(F.col("type") == kind).drop("type")


def contained(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """(file_id, outer_pre, inner_pre) for every inner node below an outer node, by interval containment.

    An equi-join on file_id with a range as residual condition; each side needs
    file_id and pre, the outer one also last.
    """
    o = outer.select("file_id", F.col("pre").alias("outer_pre"), F.col("last").alias("outer_last"))
    i = inner.select(F.col("file_id").alias("inner_file"), F.col("pre").alias("inner_pre"))
    on = (o.file_id == i.inner_file) & (i.inner_pre > o.outer_pre) & (i.inner_pre <= o.outer_last)
    return o.join(i, on).select("file_id", "outer_pre", "inner_pre")
