import numpy as np
from pyspark.sql import functions as F

from cstloom.operators import collection, vectors


def table(spark, n=60, dim=8):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=dim).tolist(), "a" if i % 2 else "b", "clash") for i in range(n)]
    rows += [(n, None, "a", ""), (n + 1, [1.0], "a", ""), (n + 2, rows[3][1], "a", "")]
    return rows, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, language string, distance string")


def test_top_k_against_brute_force(spark):
    rows, df = table(spark)
    q = rows[3][1]
    want = sorted((sum((a - b) ** 2 for a, b in zip(v, q)), i) for i, v, *_ in rows if v and len(v) == 8)
    got = [r.vec_id for r in vectors.top_k(df, q, 5).orderBy("rank").collect()]
    assert got == [i for _, i in want[:5]] and got[:2] == [3, 62]
    assert vectors.top_k(df, q, 1000).count() == 61
    only = vectors.top_k(df, q, 3, where=vectors.metadata_filter("b", None)).collect()
    assert all(r.vec_id % 2 == 0 for r in only)
    assert [r.vec_id for r in vectors.top_k(df, q, 2, metric="cosine").orderBy("rank").collect()] == [3, 62]


def test_batch_equals_single(spark):
    rows, df = table(spark)
    queries = df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r.query_id, r["rank"]): r.vec_id for r in vectors.top_k_batch(df, queries, 4).collect()}
    for q in (0, 20, 40):
        for r in vectors.top_k(df, rows[q][1], 4).collect():
            assert got[q, r["rank"]] == r.vec_id
    assert vectors.top_k_batch(df, queries.limit(0), 4).count() == 0
    assert vectors.top_k_batch(df.limit(0), queries, 4).count() == 0


def test_statistics(spark):
    _, df = table(spark)
    assert tuple(vectors.collection_stats(df).first()) == (63, 1, 8)
    assert vectors.load_summary(df.limit(0), F.lit(True)).first().loaded_percent is None
    numbered = vectors.batch_numbers(df.select("vec_id"), "vec_id", 10).groupBy("batch").count().orderBy("batch").collect()
    assert [tuple(r) for r in numbered] == [(i, 10) for i in range(1, 7)] + [(7, 3)]


def test_query_prefixes():
    assert vectors.parse_query("lang:python open file") == ("open file", "python", None)
    assert vectors.parse_query("type:class tree") == ("tree", None, "class")
    assert vectors.parse_query("lang:python") == ("lang:python", None, None)


def test_collection_round_trip(spark, tmp_path):
    schema = "id string, text string, chunk_type string, language string, filepath string, name string, parent_name string, summary string, docstring string, keywords array<string>, dependencies array<string>, line_start int, line_end int, complexity_score double"
    rows = [(f"c{i}", f"def f{i}(): pass", "function", "python" if i % 2 else "go", "a", f"f{i}", None, "s", "", ["k"] * i, [], 1, 2, 0.5) for i in range(6)] + [(None, "x", "file", "go", "a", "n", None, None, None, None, None, 1, 1, None)]
    good, bad = collection.split_rejects(collection.prepare(spark.createDataFrame(rows, schema)))
    assert (good.count(), bad.count()) == (6, 1)
    collection.write(good, str(tmp_path), "m-1")
    stored = collection.open_collection(spark, str(tmp_path), "m-1")
    hits = collection.search(stored, stored.filter("id = 'c3'").first().document, 2, language="python").collect()
    assert hits[0].id == "c3" and hits[0].code == "def f3(): pass" and len(hits) == 2
    assert collection.displayed(collection.search(stored, "f1", 3)).count() == 3


def test_batch_keeps_the_smallest_ids_of_equal_vectors(spark):
    rng = np.random.default_rng(5)
    ids = rng.permutation(200).tolist()
    near, far = rng.normal(size=8).tolist(), rng.normal(size=8)
    rows = [(i, near) for i in ids[:100]] + [(i, [0.0] * j + [s] + [-0.0] * (7 - j)) for i, (s, j) in zip(ids[100:], [(s, j) for s in (1.0, -1.0) for j in range(8)] * 7)]
    queries = spark.createDataFrame([(1, near), (2, [0.0] * 8), (3, far.tolist())], "query_id bigint, embedding array<double>")
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(parts)
        got = vectors.top_k_batch(df, queries, 5).orderBy("query_id", "rank").collect()
        for q, v in ((1, near), (2, [0.0] * 8), (3, far)):
            want = sorted((((np.array(x) - np.array(v)) ** 2).sum(), i) for i, x in rows)[:5]
            assert [r.vec_id for r in got if r.query_id == q] == [i for _, i in want]
