"""The k most similar vectors of every vector, by vantage-point trees (problem 3).

1. Equal vectors become one entry that keeps its k+1 smallest ids, so a vector
   that fills a third of the table costs as much as any other.
2. A routing tree of vantage points, fitted on a bounded sample, cuts the space
   into regions of about ``SHARD_ROWS`` entries; every entry is indexed.  A region
   is a shard; one that holds far more is cut into several by a hash, so that no
   task holds more, however large the table and however dense a place in it.
3. A shard builds its own vantage-point tree and answers its own entries.
4. An entry then visits each other shard whose region the triangle inequality
   cannot rule out, and the answers are merged.

A region whose lower bound times ``relax`` exceeds the distance of the k-th
neighbour so far is skipped: 1 gives exact search, larger values search less.

Distances are squared L2 in double precision, rounded to 12 decimals; ties go
to the smaller id.  Defined results: null, empty, short, long, all-zero and
non-finite vectors are neither queries nor answers; repeated rows count once;
with fewer than k+1 valid vectors each one gets all others; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cstloom.session import reliable

#: Entries of a shard and of a leaf of its tree, sampled entries for each shard, and most regions of the routing tree, whose sample is thereby bounded.
SHARD_ROWS, LEAF_ROWS, SAMPLE_EACH, MOST_SHARDS = 8_000, 128, 64, 1_024
#: Regions with more than so many times SHARD_ROWS entries are cut into shards of about SHARD_ROWS.
CROWDED = 4
#: How much the triangle inequality is relaxed.
RELAX = 3.0


def valid_vector(c: str | Column, dim: int) -> Column:
    v = F.col(c) if isinstance(c, str) else c
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2.0 * (a @ b.T)))


class VantageTree:
    """A balanced vantage-point tree whose leaves are index arrays into the fitted rows."""

    def __init__(self, rows: np.ndarray, leaves: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.points: list[np.ndarray] = []  # vantage point of each inner node
        self.cut: list[float] = []
        self.kids: list[list[int]] = []  # inner node: its number; leaf: -1 - number
        self.bounds: list[list[tuple[float, float]]] = []  # distances to the vantage point on either side
        self.leaves: list[np.ndarray] = []
        self.root = self._build(rows, np.arange(len(rows)), leaves, rng)

    def _build(self, rows: np.ndarray, own: np.ndarray, leaves: int, rng: np.random.Generator) -> int:
        if leaves < 2 or len(own) < 4:
            self.leaves.append(own)
            return -len(self.leaves)
        some = rows[rng.choice(own, min(len(own), 200), replace=False)]
        spread = _distances(some[:10], some).std(1)
        point = some[int(spread.argmax())]
        d = _distances(point[None], rows[own])[0]
        cut = float(np.median(d))
        near = d <= cut
        if near.all():
            self.leaves.append(own)
            return -len(self.leaves)
        me = len(self.points)
        self.points.append(point)
        self.cut.append(cut)
        self.kids.append([0, 0])
        self.bounds.append([(float(d[near].min()), float(d[near].max())), (float(d[~near].min()), float(d[~near].max()))])
        self.kids[me] = [self._build(rows, own[near], leaves // 2, rng), self._build(rows, own[~near], leaves // 2, rng)]
        return me

    def open_regions(self) -> None:
        """Let the regions cover the whole space, for a tree fitted on a sample."""
        self.bounds = [[(0.0, c), (c, np.inf)] for c in self.cut]

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row of x, following the cuts."""
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if node < 0:
                out[own] = -1 - node
            elif len(own):
                near = _distances(x[own], self.points[node][None])[:, 0] <= self.cut[node]
                todo += [(self.kids[node][0], own[near]), (self.kids[node][1], own[~near])]
        return out

    def lower_bounds(self, x: np.ndarray) -> np.ndarray:
        """For every row of x and every leaf, a distance that no row of the leaf comes below."""
        out = np.zeros((len(x), len(self.leaves)))
        d = _distances(x, np.stack(self.points)) if self.points else None
        todo = [(self.root, np.zeros(len(x)))]
        while todo:
            node, low = todo.pop()
            if node < 0:
                out[:, -1 - node] = low
                continue
            for kid, (lo, hi) in zip(self.kids[node], self.bounds[node]):
                todo.append((kid, np.maximum(low, np.maximum(lo - d[:, node], d[:, node] - hi))))
        return out


class _Found:
    """The m nearest entries so far of each of n queries."""

    def __init__(self, n: int, m: int):
        self.d, self.i = np.full((n, m), np.inf), np.full((n, m), -1, np.int64)

    def add(self, rows: np.ndarray, d: np.ndarray, i: np.ndarray) -> None:
        m = self.d.shape[1]
        if d.shape[1] > m:
            k = np.argpartition(d, m - 1, 1)[:, :m]
            d, i = np.take_along_axis(d, k, 1), i[k]
        else:
            i = np.broadcast_to(i, d.shape)
        d, i = np.hstack([self.d[rows], d]), np.hstack([self.i[rows], i])
        k = np.argpartition(d, m - 1, 1)[:, :m]
        self.d[rows], self.i[rows] = np.take_along_axis(d, k, 1), np.take_along_axis(i, k, 1)


def search(tree: VantageTree, data: np.ndarray, x: np.ndarray, m: int, relax: float, limit: np.ndarray | None = None) -> _Found:
    """The m nearest rows of data for every row of x; limit: distances beyond which answers are of no use."""
    found = _Found(len(x), m)
    bound, home = tree.lower_bounds(x), tree.place(x)
    most = np.full(len(x), np.inf) if limit is None else limit
    for at_home in (True, False):
        for k, leaf in enumerate(tree.leaves):
            if at_home:
                rows = np.flatnonzero(home == k)
            else:
                rows = np.flatnonzero((home != k) & (bound[:, k] * relax <= np.minimum(most, found.d.max(1))))
            if len(rows) and len(leaf):
                found.add(rows, _distances(x[rows], data[leaf]), leaf)
    return found


#: Entries kept beyond those asked for until distances are computed exactly, in case fast ones order ties wrongly.
SPARE = 4


def _exact(found: _Found, data: np.ndarray, ids: list, x: np.ndarray, k: int) -> list[list[dict]]:
    """Per query the k+1 nearest (distance, id), where an entry stands for all ids it keeps."""
    out = []
    for q in range(len(x)):
        near = found.i[q][found.i[q] >= 0]
        d = np.round(((data[near] - x[q]) ** 2).sum(1), 12)
        out.append([{"d": a, "id": b} for a, b in sorted((float(v), int(i)) for v, e in zip(d, near) for i in ids[e])[: k + 1]])
    return out


_NEAR = "array<struct<d:double,id:bigint>>"


def nearest(vectors: DataFrame, k: int = 5, dim: int = 64, relax: float = RELAX, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, rank, neighbour, distance): the k nearest other vectors of every valid vector."""
    valid = vectors.filter(valid_vector(vector, dim) & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.transform(vector, lambda x: (x + F.lit(0.0)).cast("float")).alias("v"))
    keyed = valid.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("second"), "v").alias("h2"))
    w = Window.partitionBy("h1", "h2").orderBy("id")
    few = keyed.withColumn("r", F.dense_rank().over(w)).filter(F.col("r") <= k + 1)
    entries = few.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.array_sort(F.collect_set("id")).alias("ids"))
    rows = vectors.count()
    n_shards = 1
    while n_shards < MOST_SHARDS and rows > n_shards * SHARD_ROWS:
        n_shards *= 2
    router, parts = None, [1] * n_shards
    if n_shards > 1:
        fit = keyed.select("v", "h1").distinct().orderBy("h1").limit(SAMPLE_EACH * n_shards).collect()
        if len(fit) > 3:
            router = VantageTree(np.array([r.v for r in fit], np.float64), n_shards)
            router.open_regions()

    def route(batches):
        for pdf in batches:
            pdf["shard"] = router.place(np.stack(pdf["v"]).astype(np.float64)) if router is not None and len(pdf) else np.int64(0)
            yield pdf

    def at_home(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = np.stack(pdf["v"]).astype(np.float64), pdf["ids"].tolist()
        tree = VantageTree(x, 1 << max(0, int(np.ceil(np.log2(max(1, len(x) / LEAF_ROWS))))))
        found = search(tree, x, x, k + 1 + SPARE, relax)
        near = _exact(found, x, ids, x, k)
        reach = np.array([np.sqrt(n[-1]["d"]) if len(n) > k else np.inf for n in near])
        if router is None:
            visits = [[] for _ in near]
        else:
            me = int(pdf["shard"].iloc[0])
            open_ = router.lower_bounds(x) * relax <= reach[:, None]
            open_[:, me % n_shards] = True  # the other shards of its own region
            all_shards = [np.array([s + n_shards * p for p in range(parts[s]) if s + n_shards * p != me], np.int64) for s in range(n_shards)]
            visits = [np.concatenate([all_shards[s] for s in np.flatnonzero(o)]) for o in open_]
        return pd.DataFrame({"h1": pdf["h1"], "h2": pdf["h2"], "v": pdf["v"], "near": near, "reach": reach, "visits": visits})

    def abroad(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(data):
            return pd.DataFrame({"h1": [], "h2": [], "near": []})
        x, q = np.stack(data["v"]).astype(np.float64), np.stack(queries["v"]).astype(np.float64)
        tree = VantageTree(x, 1 << max(0, int(np.ceil(np.log2(max(1, len(x) / LEAF_ROWS))))))
        found = search(tree, x, q, k + 1 + SPARE, relax, queries["reach"].to_numpy())
        return pd.DataFrame({"h1": queries["h1"], "h2": queries["h2"], "near": _exact(found, x, data["ids"].tolist(), q, k)})

    sharded = entries.mapInPandas(route, "h1 bigint, h2 bigint, v array<float>, ids array<bigint>, shard bigint")
    if router is None:
        answers = sharded.groupBy("shard").applyInPandas(at_home, f"h1 bigint, h2 bigint, v array<float>, near {_NEAR}, reach double, visits array<bigint>").select("h1", "h2", "near")
    else:
        sharded = reliable(sharded)
        for r in sharded.groupBy("shard").count().collect():  # one row a region
            parts[r["shard"]] = -(-r["count"] // SHARD_ROWS) if r["count"] > CROWDED * SHARD_ROWS else 1
        if max(parts) > 1:
            cuts = F.element_at(F.array(*[F.lit(p) for p in parts]), F.col("shard").cast("int") + 1)
            sharded = sharded.withColumn("shard", F.col("shard") + n_shards * F.pmod("h2", cuts))
        home = reliable(sharded.groupBy("shard").applyInPandas(at_home, f"h1 bigint, h2 bigint, v array<float>, near {_NEAR}, reach double, visits array<bigint>"))
        queries = home.select("h1", "h2", "v", "reach", F.explode("visits").alias("shard"))
        away = queries.groupBy("shard").cogroup(sharded.select("shard", "v", "ids").groupBy("shard")).applyInPandas(abroad, f"h1 bigint, h2 bigint, near {_NEAR}")
        both = home.select("h1", "h2", "near").unionByName(away)
        answers = both.groupBy("h1", "h2").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    members = keyed.select("id", "h1", "h2").distinct()
    others = F.slice(F.filter("near", lambda n: n["id"] != F.col("id")), 1, k)
    return members.join(answers, ["h1", "h2"]).select(F.col("id").alias(key), F.posexplode(others).alias("at", "n")).select(key, (F.col("at") + 1).alias("rank"), F.col("n.id").alias("neighbour"), F.col("n.d").alias("distance"))


def neighbour_pairs(near: DataFrame, key: str = "vec_id") -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b: pairs of which one at least is near the other."""
    return near.select(F.least(key, "neighbour").alias("vec_a"), F.greatest(key, "neighbour").alias("vec_b")).distinct()
