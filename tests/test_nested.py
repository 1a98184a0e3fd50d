import datetime as dt
import json
import random

import numpy as np
import pytest

from cstloom.operators import nested

SCHEMA = "file_id bigint, cst_json string, written_at timestamp, type string, pre int"


def record(root):
    return json.dumps({"filepath": "a.py", "language": "python", "cst": root})


def n(kind, *kids, **more):
    return {"type": kind, "start_byte": 0, "end_byte": 1, **({"children": list(kids)} if kids else {}), **more}


def rows(spark, *records):
    """Records with columns that clash with those of the result."""
    return spark.createDataFrame([(f, t, w, "clash", 7) for f, t, w in records], SCHEMA)


DAY = dt.datetime(2024, 1, 1)


def test_shapes_of_children(spark):
    root = n("module", n("a", n("b")), None, n("c"), **{})
    root["children"].append({"type": "d", "children": n("e")})  # one object in place of the array
    got = {tuple(r) for r in nested.child_links(rows(spark, (1, record(root), DAY))).collect()}
    assert got == {(1, 0, 1), (1, 1, 2), (1, 0, 3), (1, 0, 4), (1, 4, 5)}


def test_valid_record_and_ties(spark):
    old, new = record(n("module", n("a"))), record(n("module", n("a"), n("b")))
    r = rows(spark, (1, old, DAY), (1, new, DAY + dt.timedelta(1)), (1, new[:-9], DAY + dt.timedelta(2)), (1, new, DAY + dt.timedelta(1)), (2, None, DAY), (3, "", DAY), (4, "[]", DAY), (None, new, DAY), (5, old, None), (5, new, DAY))
    assert sorted(tuple(x) for x in nested.child_links(r).collect()) == [(1, 0, 1), (1, 0, 2), (5, 0, 1), (5, 0, 2)]


def test_points_and_labels(spark):
    root = n("module", n("f", n("x", text="x")), n("g"), start_point=[0, 0], end_point={"row": 3, "column": 4}, is_named=True)
    got = {r.pre: r for r in nested.flatten_trees(rows(spark, (1, record(root), DAY))).collect()}
    assert [(got[i].post, got[i].last, got[i].depth, got[i].ord) for i in range(4)] == [(3, 3, 0, 0), (1, 2, 1, 0), (0, 2, 2, 0), (2, 3, 1, 1)]
    assert (got[0].end_row, got[0].end_col, got[0].is_named, got[2].text, got[1].start_row) == (3, 4, True, "x", None)


def test_containment_gives_the_links(spark):
    rng = random.Random(1)

    def grow(depth):
        return n(rng.choice("ab"), *[grow(depth - 1) for _ in range(rng.randint(0, 3) if depth else 0)])

    nodes = nested.flatten_trees(rows(spark, (1, record(grow(5)), DAY), (2, record(grow(5)), DAY)), ["file_id", "pre", "last", "parent_pre"])
    inside = nested.contained(nodes, nodes)
    by_interval = {tuple(r) for r in inside.groupBy("file_id", "inner_pre").agg({"outer_pre": "max"}).collect()}
    assert by_interval == {(r.file_id, r.pre, r.parent_pre) for r in nodes.collect() if r.parent_pre is not None}


@pytest.mark.parametrize("depth", [90, 30_000])
def test_depth(spark, depth):
    text = '{"cst":' + '{"type":"a","children":[' * depth + '{"type":"b"}' + "]}" * depth + "}"
    assert nested.child_links(rows(spark, (1, text, DAY))).count() == depth
    assert nested.load_root(text[:-5]) is None


def test_deep_parser_agrees_with_json():
    for text in ('{"a": [1, -2.5e3, "x\\u00e9", true, null, {}], "b": []}', "[]", " 7 ", '"\\""'):
        assert nested._loads_deep(text) == json.loads(text)
    for bad in ("", "{", "[1,]", '{"a" 1}', "[1] 2", "tru", '{"a":}'):
        with pytest.raises(ValueError):
            nested._loads_deep(bad)


def test_empty_table(spark):
    assert nested.flatten_trees(rows(spark).limit(0)).count() == 0


def test_innermost_intervals_against_parents():
    rng = random.Random(2)

    def grow(depth):
        return n("a", *[grow(depth - 1) for _ in range(rng.randint(0, 4) if depth else 0)])

    for _ in range(20):
        root = grow(5)
        parents = nested.walk(root)[1]
        assert nested.innermost(np.array(nested._labelled(root, ["last"])["last"])).tolist() == parents
    assert nested.innermost(np.array([], np.int64)).tolist() == []


def test_type_tables(spark, tmp_path):
    nodes = nested.flatten_trees(rows(spark, (1, record(n("module", n("a", n("b")), n("a"))), DAY), (2, record(n("module", n("b"))), DAY)))
    assert {tuple(r) for r in nested.type_counts(nodes).collect()} == {("module", 2, 2, 0), ("a", 2, 1, 2), ("b", 2, 2, 2)}
    nested.write_type_tables(nodes, str(tmp_path / "t"))
    a, b = (spark.read.parquet(str(tmp_path / "t" / f"type={x}")) for x in "ab")
    assert [tuple(r) for r in nested.contained(a, b).collect()] == [(1, 1, 2)]


def test_half_surrogates(spark):
    text = record(n("module", n("a", text="x"))).replace('"x"', '"\\ud800x"')
    assert [r.text for r in nested.flatten_trees(rows(spark, (1, text, DAY)), ["pre", "text"]).orderBy("pre").collect()] == [None, "?x"]
