"""Exact nearest-neighbour search in a collection, and its statistics.

Distance is squared L2 in double precision, or one minus the cosine; ties go to
the smaller id.  Null vectors and vectors of another length than the query's are
left out.  k larger than the collection gives the whole collection; an empty
collection gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cstloom.session import reliable

#: Query vectors of a block and rows of a part of the collection; every block meets every part (64 dimensions: 4 MB and 16 MB).
QUERY_BLOCK, PART_ROWS = 8_192, 32_768
#: Entries of a matrix of distances, and differences of vectors, held at once.
MATRIX, DIFFERENCES = 1 << 23, 1 << 22


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def metadata_filter(language: str | None = None, chunk_type: str | None = None) -> Column:
    """Both conditions if both are given, none if neither is."""
    out = F.lit(True)
    for name, value in (("language", language), ("chunk_type", chunk_type)):
        if value is not None:
            out = out & (F.col(name) == value)
    return out


def parse_query(line: str) -> tuple[str, str | None, str | None]:
    """(query, language, chunk_type) of a line that may begin with lang:x or type:x."""
    head, _, rest = line.strip().partition(" ")
    if rest.strip() and head.startswith("lang:"):
        return rest.strip(), head[5:], None
    if rest.strip() and head.startswith("type:"):
        return rest.strip(), None, head[5:]
    return line.strip(), None, None


def vector_of(collection: DataFrame, where: Column, vector: str = "embedding") -> Column:
    """The vector of one row of a collection, as a scalar that is looked up within the query that uses it."""
    return collection.filter(where).agg(F.first(vector)).scalar()


def top_k(collection: DataFrame, query: list[float] | Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", metric: str = "l2", where: Column | None = None, carry: list[str] | None = None) -> DataFrame:
    """(key, distance, *carry, similarity, rank) of the k nearest rows; the filter comes first."""
    rows = collection if where is None else collection.filter(where)
    rows = rows.withColumn("_query", query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query]))
    d = (squared_l2 if metric == "l2" else cosine_distance)(F.col(vector), F.col("_query"))
    near = rows.filter(F.size(vector) == F.size("_query")).select(key, d.alias("distance"), *(carry or [])).orderBy("distance", key).limit(k)
    return near.withColumn("similarity", 1 - F.col("distance")).withColumn("rank", F.row_number().over(Window.orderBy("distance", key)))


def _first(*columns: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k of every group in the order of the columns."""
    order = np.lexsort((*reversed(columns), group))
    g = group[order]
    new = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, bool)
    at = np.arange(len(g))
    return order[at - np.maximum.accumulate(np.where(new, at, 0)) < k]


def _nearest(q: np.ndarray, own: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, id, distance): exactly the k first rows of every query by distance and id.

    Equal vectors are one entry with their k smallest ids.  Rough distances only
    leave out what lies beyond the k-th by more than their rounding can be off.
    """
    x = np.ascontiguousarray(x + 0.0)  # no negative zeros, so that equal vectors have equal bytes
    _, at, group = np.unique(x.view(f"V{x.strides[0]}").ravel(), return_index=True, return_inverse=True)
    members = _first(own, group=group, k=k)
    u, members, sizes = x[at], own[members], np.bincount(group[members], minlength=len(at))
    starts = np.cumsum(sizes) - sizes
    qq, uu = (q * q).sum(1), (u * u).sum(1)
    m, rows = min(k, len(u)), max(1, MATRIX // len(u))
    for a in range(0, len(q), rows):
        scale = qq[a : a + rows, None] + uu[None]
        rough = scale - 2 * q[a : a + rows] @ u.T
        low, high = np.nan_to_num(rough - 1e-9 * scale, nan=-np.inf), np.nan_to_num(rough + 1e-9 * scale, nan=np.inf)
        query, entry = np.nonzero(low <= np.partition(high, m - 1, 1)[:, m - 1 : m])
        step = max(1, DIFFERENCES // x.shape[1])
        d = np.concatenate([((u[entry[i : i + step]] - q[a + query[i : i + step]]) ** 2).sum(1) for i in range(0, len(entry), step)])
        n = sizes[entry]
        member = members[np.repeat(starts[entry], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        query, d = np.repeat(a + query, n), np.repeat(d, n)
        best = _first(d, member, group=query, k=k)
        yield query[best], member[best], d[best]


def top_k_batch(collection: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, distance, similarity, rank) for every row (query_id, vector) of queries against the whole collection.

    Queries are cut into blocks and the collection into parts of bounded size;
    each block meets each part in a task of its own, which keeps the k nearest of
    every query, and these are merged.  Nothing passes through the driver.
    """
    blocks, parts = (max(1, -(-df.count() // n)) for df, n in ((queries, QUERY_BLOCK), (collection, PART_ROWS)))
    place = lambda n: F.monotonically_increasing_id() % n
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    asked = queries.filter(F.col(vector).isNotNull()).select(F.col("query_id").cast("bigint").alias("query_id"), vector, place(blocks).alias("block")).select("*", every(parts).alias("part"))
    held = collection.filter(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias(key), vector, place(parts).alias("part")).select("*", every(blocks).alias("block"))
    columns = ["query_id", key, "distance"]

    def run(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), key: np.zeros(0, np.int64), "distance": np.zeros(0)})]
        for dimension, same in q.groupby(q[vector].map(len)):
            rows = x[x[vector].map(len) == dimension]
            if len(rows) and dimension:
                ids = same["query_id"].to_numpy()
                for query, own, distance in _nearest(np.stack(same[vector]).astype(np.float64), rows[key].to_numpy(), np.stack(rows[vector]).astype(np.float64), k):
                    out.append(pd.DataFrame({"query_id": ids[query], key: own, "distance": distance}))
        return pd.concat(out)[columns]

    met = asked.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInPandas(run, f"query_id bigint, `{key}` bigint, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", key)
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("similarity", 1 - F.col("distance"))


def collection_stats(collection: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vectors, least_dimension, dimension)."""
    return collection.agg(F.count("*").alias("vectors"), F.min(F.when(F.col(vector).isNotNull(), F.size(vector))).alias("least_dimension"), F.max(F.when(F.col(vector).isNotNull(), F.size(vector))).alias("dimension"))


def sample_counts(rows: DataFrame, group: str, order: str, most: int = 100) -> DataFrame:
    """(group, n) over the first rows by an order; missing groups are called unknown."""
    return rows.orderBy(order).limit(most).groupBy(F.coalesce(group, F.lit("unknown")).alias(group)).agg(F.count("*").alias("n"))


def batch_numbers(rows: DataFrame, order: str, size: int = 100) -> DataFrame:
    """Adds batch, from 1, in the given order.

    Rows are ranked within ranges of the order and shifted by the sizes of the
    ranges before, so no task has to hold all rows.
    """
    ranged = reliable(rows.repartitionByRange(order).withColumn("part", F.spark_partition_id()))  # read twice, so the ranges are cut once
    sizes = ranged.groupBy("part").count()
    before = sizes.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = ranged.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(order)))
    return ranked.join(F.broadcast(before), "part").withColumn("batch", (F.floor((F.col("before") + F.col("r") - 1) / size) + 1).cast("bigint")).drop("part", "r", "before")


def load_summary(rows: DataFrame, loaded: Column, elapsed: float | None = None) -> DataFrame:
    """(total, loaded, failed, loaded_percent[, per_second]); the percentage of nothing is null."""
    out = rows.agg(F.count("*").alias("total"), F.coalesce(F.sum(loaded.cast("int")), F.lit(0)).alias("loaded"))
    out = out.withColumn("failed", F.col("total") - F.col("loaded")).withColumn("loaded_percent", F.when(F.col("total") > 0, F.round(100 * F.col("loaded") / F.col("total"), 6)))
    return out if not elapsed else out.withColumn("per_second", F.col("loaded") / elapsed)
