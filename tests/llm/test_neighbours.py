import numpy as np

from cstloom.llm import neighbours


def brute(rows, k=5):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and len(v) == 64 and np.isfinite(v).all() and np.any(v)}
    out = {}
    for i, v in ok.items():
        out[i] = [j for _, j in sorted((round(float(((v - w) ** 2).sum()), 12), j) for j, w in ok.items() if j != i)[:k]]
    return out


def vectors(n=400, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, 64))
    rows = [(i, (centres[i % 20] + 0.1 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(n)]
    same = rows[5][1]
    rows += [(n + i, same) for i in range(150)]  # one vector fills a good part of the table
    return rows + [(900, None), (901, []), (902, [1.0] * 63), (903, [0.0] * 64), (904, [float("nan")] + [1.0] * 63), (905, [-0.0] * 63 + [1.0]), (906, [0.0] * 63 + [1.0]), rows[0]]


def test_exact_factor_and_default(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id bigint, embedding array<float>, distance string")
    want = brute(dict(rows).items())
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 60)
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 16)
    got = {}
    for r in neighbours.nearest(df, relax=1.0).collect():
        got.setdefault(r.vec_id, {})[r["rank"]] = r.neighbour
    assert {i: [n[k] for k in sorted(n)] for i, n in got.items()} == want
    near = {(r.vec_id, r.neighbour) for r in neighbours.nearest(df).collect()}
    true = {(i, j) for i, n in want.items() for j in n}
    assert len(near & true) / len(true) >= 0.9
    pairs = neighbours.neighbour_pairs(neighbours.nearest(df, relax=1.0)).collect()
    assert {tuple(p) for p in pairs} == {(min(a, b), max(a, b)) for a, b in true} and all(p.vec_a < p.vec_b for p in pairs)


def test_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, [2.0] * 64), (None, [2.0] * 64)], "vec_id bigint, embedding array<float>")
    assert {(r.vec_id, r.neighbour) for r in neighbours.nearest(df).collect()} == {(1, 2), (2, 1)}
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_crowded_regions_are_cut(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=64) if i % 10 == 0 else 0.01 * rng.normal(size=64) + 1).astype(np.float32).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    for name, value in (("SHARD_ROWS", 40), ("LEAF_ROWS", 16), ("MOST_SHARDS", 2), ("CROWDED", 1)):
        monkeypatch.setattr(neighbours, name, value)
    got = {}
    for r in neighbours.nearest(df, relax=1.0).collect():
        got.setdefault(r.vec_id, {})[r["rank"]] = r.neighbour
    assert {i: [n[k] for k in sorted(n)] for i, n in got.items()} == brute(rows)
