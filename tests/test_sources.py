import json
import os

import pytest
from pyspark.sql import functions as F

from cstloom.operators import chunking, code_graph, collection, nested
from cstloom.sources import files
from cstloom.streaming import ingest


@pytest.fixture
def tree(tmp_path):
    for name, raw in {"__init__.py": b"import os\n", "_p/a.py": b"def f(:\n", "b.py": "x = 'é'\r\n".encode("latin-1"), "builder.py": b"", "c.txt": b"", ".py": b"", "d.go": b"package d\n"}.items():
        path = tmp_path / "src" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(raw)
    return str(tmp_path / "src")


def test_scan(spark, tree):
    names = [os.path.relpath(r.path, tree) for r in files.scan(spark, tree).collect()]
    assert names == ["__init__.py", "_p/a.py", "b.py", "d.go"]
    assert "builder.py" in [os.path.relpath(r.path, tree) for r in files.scan(spark, tree, match="segment").collect()]
    assert files.scan(spark, tree, recursive=False).count() == 3
    with pytest.raises(FileNotFoundError):
        files.scan(spark, tree + "/none")


def test_parse(spark, tree):
    got = {os.path.basename(r.filepath): r for r in files.parse_codebase(spark, tree).collect()}
    assert got["__init__.py"].success and not got["a.py"].success and "SyntaxError" in got["a.py"].error
    assert got["b.py"].text == "x = 'é'\n" and got["d.go"].error == "No parser for language: go"
    assert json.loads(got["__init__.py"].cst_json)["cst"]["children"][0]["text"] == "import os"


def test_decode(spark):
    df = spark.createDataFrame([(bytearray("é\r\n".encode()),), (bytearray("é\r".encode("latin-1")),)], "b binary")
    assert [r[0] for r in df.select(files.decode_bytes(F.col("b"))).collect()] == ["é\n", "é\n"]


CODE = '''
class A(B, m.C):
    """Doc."""
    def run(self):
        def inner():
            helper()
        self.go(inner())
async def later(): pass
'''


def test_graph(spark, tmp_path):
    texts = spark.createDataFrame([("b.py", CODE), ("a.py", "def run(): print()"), ("c.py", "def ("), ("d.py", None)], "filepath string, text string")
    facts = code_graph.facts(texts)
    assert sorted((r.name, r.type) for r in code_graph.definitions(facts).collect()) == [("A", "ClassDef"), ("inner", "FunctionDef"), ("run", "FunctionDef"), ("run", "FunctionDef")]
    edges = code_graph.edges(facts)
    assert {(r.src, r.dst, r.type) for r in edges.collect()} == {("A", "B", "inherits"), ("A", "run", "defines_method"), ("run", "helper", "calls"), ("run", "go", "calls"), ("run", "inner", "calls"), ("inner", "helper", "calls"), ("run", "print", "calls")}
    one = code_graph.upsert_edges(edges)
    nodes = code_graph.upsert_nodes(code_graph.definitions(facts), one)
    assert {r.name: r.file for r in nodes.collect()}["run"] == "b.py" and facts.filter("kind = 'reject'").count() == 1
    code_graph.write_graphml(nodes, one, str(tmp_path / "g.xml"))
    assert "<edge source=" in (tmp_path / "g.xml").read_text()


def test_own_sources_make_chunks(spark):
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "cstloom", "operators")
    parsed = files.parse_codebase(spark, root, match="segment").filter("success").selectExpr("*", "xxhash64(filepath) as file_id", "cast(null as timestamp) as written_at")
    nodes = chunking.tree_nodes(parsed)
    made = chunking.chunks_of(nodes, parsed.select("file_id", "filepath", "language"), chunking.corpus_vocabulary(nodes)).collect()
    assert len([r for r in made if r.chunk_type == "file"]) >= 6
    by_name = {(r.chunk_type, r.name): r for r in made}
    assert ("function_definition", "flatten_trees") in by_name and by_name["function_definition", "write_graphml"].dependencies
    assert all(r.keywords for r in made if r.text.strip() and r.chunk_type != "file")
    assert len({r.id for r in made}) == len(made) and max(r.complexity_score for r in made) == 10


def test_python_trees_have_the_types_of_the_grammars():
    root = files.python_tree(CODE)
    nodes = nested.walk(root)[0]
    named = {(n["type"], n["children"][0]["text"]) for n in nodes if n["type"].endswith("_definition")}
    assert named == {("class_definition", "A"), ("function_definition", "run"), ("function_definition", "inner"), ("async_function_definition", "later")}
    raw = CODE.encode()
    assert all(n["text"] == raw[n["start_byte"] : n["end_byte"]].decode() for n in nodes)
    lines = CODE.split("\n")
    assert all(sum(len(x) + 1 for x in lines[: n["start_point"][0]]) + n["start_point"][1] == n["start_byte"] for n in nodes)
    assert files.python_tree("")["children"] == [] and files.python_tree("x = 'é '\ndef g(): pass")["children"][1]["text"] == "def g(): pass"


def test_stream(spark, tmp_path):
    schema = "id string, text string, chunk_type string, language string, filepath string, name string, parent_name string, summary string, docstring string, keywords array<string>, dependencies array<string>, line_start int, line_end int, complexity_score double"
    rows = [(f"c{i}", "t", "file", "go", "a", "n", None, None, None, None, None, 1, 1, None) for i in range(5)]
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), "m", str(tmp_path / "cp"), df.schema).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "codebase_m")).count() == 5


def test_load_then_ingest_then_open(spark, tmp_path):
    rows = spark.createDataFrame([(f"c{i}", "a.go", "file", "go" if i % 2 else None, "n", None, 1, 1, "words of it", None, None, None, 0.5, None) for i in range(6)], collection.CHUNK)
    db = str(tmp_path / "db")
    collection.write(collection.split_rejects(collection.prepare(rows.filter("id < 'c4'")))[0], db, "m")
    rows.filter("id >= 'c4'").write.parquet(str(tmp_path / "in"))
    ingest.ingest(spark, str(tmp_path / "in"), db, "m", str(tmp_path / "cp"), rows.schema).awaitTermination()
    held = collection.open_collection(spark, db, "m")
    assert sorted(r.id for r in held.select("id").collect()) == [f"c{i}" for i in range(6)]
    hits = collection.search(held, "words", 3)
    assert [r.rank for r in collection.displayed(hits).collect()] == [1, 2, 3] and collection.displayed_briefly(hits, 20).first().preview.endswith("...")
    collection.write(held.filter("id = 'c0'"), str(tmp_path / "db2"), "m")


def test_chunk_files(spark, tmp_path):
    rows = spark.createDataFrame([("c", "a.go", "file", "go", "n", None, 1, 2, "t", "s", ["k"], [], 0.5, None)], collection.CHUNK)
    collection.write_chunks(rows, str(tmp_path / "o"), "src")
    assert collection.read_chunks(spark, str(tmp_path / "o")).collect() == rows.collect()
    summary = spark.read.json(str(tmp_path / "o" / "summary")).first()
    assert summary.total_chunks == 1 and summary.chunk_types.file == 1 and summary.generated_at > 1e9
    whole = {"chunks": [{"id": "c", "text": "t", "metadata": {"chunk_type": "file", "keywords": ["k"], "line_end": 2}}]}
    (tmp_path / "w.json").write_text(json.dumps(whole, indent=1))
    got = collection.read_chunks(spark, str(tmp_path / "w.json"), documents=True).first()
    assert (got.id, got.chunk_type, got.keywords, got.line_end, got.name) == ("c", "file", ["k"], 2, None)
