import json

from cstloom.operators import chunking


def node(kind, *kids, text=None, row=0, byte=0):
    return {"type": kind, "text": text, "start_byte": byte, "end_byte": byte + 1, "start_point": [row, 0], "end_point": [row + 1, 0], "is_named": True, "children": list(kids)}


def nodes(spark, root):
    records = spark.createDataFrame([(1, json.dumps({"cst": root}))], "file_id bigint, cst_json string").selectExpr("*", "cast(null as timestamp) as written_at")
    return chunking.tree_nodes(records)


def eight(spark):
    return nodes(spark, node("module", node("class_definition", node("identifier", text="C"), node("function_definition", node("identifier", text="f"), text="def f"), text="class C"), node("function_definition", node("block", node("identifier", text="g")), text="def g"), text="all"))


def test_labels_complexity_names_parents(spark):
    n = eight(spark)
    assert [(r.pre, r.last, r.depth, r.type) for r in n.orderBy("pre").collect()] == [(0, 7, 0, "module"), (1, 4, 1, "class_definition"), (2, 2, 2, "identifier"), (3, 4, 2, "function_definition"), (4, 4, 3, "identifier"), (5, 7, 1, "function_definition"), (6, 7, 2, "block"), (7, 7, 3, "identifier")]
    assert {r.pre: round(r.complexity, 6) for r in chunking.complexity(chunking._units(n)).collect()} == {1: 0.8, 3: 0.4, 5: 0.7}
    assert {r.pre: round(r.complexity, 6) for r in chunking.complexity(n.filter("pre = 0")).collect()} == {0: 1.4}
    assert {r.pre: r.name for r in chunking.first_identifier(n).collect()} == {1: "C", 3: "f", 5: "g"}
    files = spark.createDataFrame([(1, "src/a.py", "python")], "file_id bigint, filepath string, language string")
    made = {r.name: r for r in chunking.chunks_of(n, files, ["all"]).collect()}
    assert "all" in made["a.py"].keywords and "library" in made["a.py"].keywords and "all" not in made["f"].keywords and round(made["a.py"].complexity_score, 6) == 1.4
    assert (made["f"].parent_name, made["C"].parent_name, made["g"].parent_name) == ("C", None, None)
    assert made["f"].summary == "Function Definition: f (in C)" and made["a.py"].id == "file:src/a.py" and made["f"].id.startswith("src/a.py:function_definition:f:1_")


def test_import_names(spark):
    texts = {"import os": "os", "import a, b": "a,", "from a.b import c": "a", "from . import x": "", "import { a } from 'mod'": "{"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(chunking.import_name(df.t)).collect()] == list(texts.values())


def test_dependencies_and_docstrings(spark):
    n = nodes(spark, node("program", node("import_statement", text="import os"), node("function_declaration", node("comment", text="// says so"), node("call_expression", node("identifier", text="run(x)"), node("identifier", text="x")), text="f"), text="p"))
    assert chunking.import_dependencies(n).first().dependencies == ["os"]
    assert chunking.call_dependencies(n).first().calls == ["run"]
    languages = spark.createDataFrame([(1, "javascript")], "file_id bigint, language string")
    assert [(r.pre, r.docstring) for r in chunking.docstrings(n, languages).collect()] == [(2, "// says so")]


def test_unique_ids(spark):
    rows = spark.createDataFrame([("a", "p", "x", i) for i in range(3)] + [("a", "p", "y", 3), ("b", "p", None, 4)], "id string, filepath string, text string, at int")
    got = [r.id for r in chunking.unique_ids(rows, ["at"]).orderBy("at").collect()]
    assert got[0] == "a" and got[4] == "b" and got[2] == got[1] + "_1" and len(set(got)) == 5
    assert chunking.unique_ids(rows.limit(0), ["at"]).count() == 0


def test_plans_walk_the_trees_once(spark):
    n = eight(spark)
    files = spark.createDataFrame([(1, "src/a.py", "python")], "file_id bigint, filepath string, language string")
    plan = chunking.chunks_of(n, files)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_parents_skip_blank_units(spark):
    n = nodes(spark, node("module", node("class_definition", node("identifier", text="Outer"), node("class_definition", node("function_definition", node("identifier", text="f"), text="def f"), text=" "), text="class Outer"), text="all"))
    files = spark.createDataFrame([(1, "a.py", "python")], "file_id bigint, filepath string, language string")
    assert {r.name: r.parent_name for r in chunking.chunks_of(n, files).collect()} == {"a.py": None, "Outer": None, "f": "Outer"}
    assert chunking.chunks_of(n.limit(0), files).count() == 0
