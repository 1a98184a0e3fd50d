"""Near-duplicate records by an exact prefix join (problem 5).

Two records are similar if the words they share, counted with repeats, are at
least ``LEAST`` of the words of the longer one.

1. Records with the same words become one class, whatever the size of the class.
2. The words of a class (the n-th repeat of a word counts as a word of its own)
   are put into one order for all classes, rare ones first.
3. Similar classes of n words share at least LEAST of n, so the first word they
   share is among the first n - LEAST * n + 1 of both.  Only these words are keys:
   every similar pair has a common key, whatever the words are and however many
   records use them.  A pair is left out where too few words follow the common
   key for LEAST.
4. Pairs with a common key are verified exactly on all their words.

The frequencies behind the order are those of a bounded sample; the order decides
how many pairs are verified, never which pairs are found.

Defined results: null texts and texts without a word have no partner; a record
delivered twice counts once; empty tables give empty tables; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from cstloom.session import reliable

LEAST = (7, 10)
#: Classes whose words are counted for the order, and the most words that get a frequency.
SAMPLE, COUNTED = 100_000, 200_000
#: Signatures of SYMBOLS minimum hashes of BITS bits, cut into chunks of WIDE symbols of which ERRORS may differ; pairs that differ in at most MOST_ERRORS symbols share a key.
SYMBOLS, BITS, WIDE, ERRORS = 48, 24, 4, 1
CHUNKS = SYMBOLS // WIDE
MOST_ERRORS = CHUNKS * (ERRORS + 1) - 1
_SUBSETS = list(combinations(range(WIDE), WIDE - ERRORS))
_MUL = np.random.default_rng(23).integers(1, 2**63, SYMBOLS, dtype=np.uint64) | np.uint64(1)


def _keys(signatures: np.ndarray, kind: int) -> np.ndarray:
    """(records, keys): the chunks with ERRORS symbols left out, hashed to 64 bits."""
    out = []
    for c in range(CHUNKS):
        for s, subset in enumerate(_SUBSETS):
            key = np.full(len(signatures), (kind * CHUNKS + c) * len(_SUBSETS) + s, np.uint64)
            for i in subset:
                key = (key ^ signatures[:, c * WIDE + i]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            out.append(key)
    return np.stack(out, 1).astype(np.int64) if out else np.zeros((0, 0), np.int64)


def _repeats(doc: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Tokens that tell the repeats of a word in one record apart; doc and word are sorted."""
    n = len(word)
    new = np.ones(n, bool)
    new[1:] = (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])
    at = np.arange(n)
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    return word.astype(np.int64).astype(np.uint64) + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of a batch of (id, words), the record of each, and the number of tokens of each record."""
    lists = batch.column(1)
    starts = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]]
    size = np.diff(starts)
    doc = np.repeat(np.arange(len(size)), size)
    return _repeats(doc, words).view(np.int64), doc, size


def _all_tokens(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_tokens(batch)[0])], names=["key"])


def _index(known: np.ndarray, uses: np.ndarray):
    """Keys of each record: its first tokens by frequency, then by value. known is sorted; tokens outside it are the rarest."""

    def run(batches):
        for batch in batches:
            tokens, doc, size = _tokens(batch)
            if not len(tokens):
                continue
            often = np.zeros(len(tokens), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                often = np.where(known[at] == tokens, uses[at], 0)
            order = np.lexsort((tokens, often, doc))
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
            keep = place <= (size - (LEAST[0] * size + LEAST[1] - 1) // LEAST[1])[doc]
            own = doc[keep]
            columns = [batch.column(0).take(pa.array(own)), pa.array(tokens[order][keep]), pa.array(size[own].astype(np.int32)), pa.array((size[own] - place[keep]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "size", "left"])

    return run


@F.pandas_udf(BooleanType())
def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y):
        shared = sum((Counter(x.tolist()) & Counter(y.tolist())).values())
        return LEAST[1] * shared >= LEAST[0] * max(len(x), len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=bool)


def classes(records: DataFrame, key: str = "chunk_no", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, class): every record with a word; (id, words): one record of each class with its hashed words, sorted."""
    words = F.array_sort(F.transform(F.regexp_extract_all(F.col(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.hash(w)))
    rows = records.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("id"), words.alias("words")).filter(F.size("words") > 0)
    marked = rows.select("id", "words", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit("second"), "words").alias("h2"))
    classes_ = marked.groupBy("h1", "h2").agg(F.min("id").alias("class"))
    members = marked.select("id", "h1", "h2").distinct().join(classes_, ["h1", "h2"]).select("id", "class")
    ones = marked.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.any_value("words").alias("words")).select("id", "words")
    return members, ones


def similar_classes(ones: DataFrame) -> DataFrame:
    """(a, b), a < b: classes whose words are similar."""
    n = ones.count()
    sample = ones if n <= SAMPLE else ones.sample(SAMPLE / n, 5)
    counted = sample.mapInArrow(_all_tokens, "key bigint").groupBy("key").count().filter("count > 2").orderBy(F.desc("count"), "key").limit(COUNTED).orderBy("key").toPandas()
    keys = ones.mapInArrow(_index(counted["key"].to_numpy(np.int64), counted["count"].to_numpy(np.int64)), "id bigint, key bigint, size int, left int")
    left, right = (keys.select(F.col("id").alias(x), "key", F.col("size").alias(f"size_{x}"), F.col("left").alias(f"left_{x}")) for x in "ab")
    enough = F.least("left_a", "left_b") * LEAST[1] >= F.greatest("size_a", "size_b") * LEAST[0]
    pairs = left.join(right, "key").filter("a < b").filter(enough).select("a", "b").distinct()
    with_a = pairs.join(ones.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a")
    with_b = with_a.join(ones.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
    return with_b.filter(_similar("wa", "wb")).select("a", "b")


def _signed(batches):
    for batch in batches:
        tokens, doc, size = _tokens(batch)
        rows = np.flatnonzero(size)
        if not len(rows):
            continue
        starts = (np.cumsum(size) - size)[rows]
        signatures = np.empty((len(rows), SYMBOLS), np.uint64)
        for k, m in enumerate(_MUL):
            x = tokens.view(np.uint64) * m
            x ^= x >> np.uint64(32)
            signatures[:, k] = np.minimum.reduceat(x * np.uint64(0xD6E8FEB86659FD93), starts) >> np.uint64(64 - BITS)
        as_lists = lambda x, t: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), t), x.shape[1]).cast(pa.list_(t))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), as_lists(signatures.astype(np.int32), pa.int32()), as_lists(_keys(signatures, 0), pa.int64())], names=["id", "signature", "keys"])


def hamming_classes(ones: DataFrame) -> DataFrame:
    """(a, b), a < b: similar classes among the pairs whose signatures differ in at most MOST_ERRORS symbols, by the multi-index Hamming join.

    Every pair up to that distance is found.  Similar pairs beyond it are not, and at
    the very threshold those are many, as signatures only estimate what is shared.
    Its candidates also grow with the square of the records, so ``similar_classes``
    is what the queries use; see the README.
    """
    signed = reliable(ones.mapInArrow(_signed, "id bigint, signature array<int>, keys array<bigint>"))
    left, right = (signed.select(F.col("id").alias(x), F.explode("keys").alias("key")) for x in "ab")
    pairs = left.join(right, "key").filter("a < b").select("a", "b").distinct()
    of = lambda x: signed.select(F.col("id").alias(x), F.col("signature").alias(f"s{x}"))
    off = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x != y).cast("int")), F.lit(0), lambda n, x: n + x)
    near = pairs.join(of("a"), "a").join(of("b"), "b").filter(off <= MOST_ERRORS).select("a", "b")
    words = lambda x: ones.select(F.col("id").alias(x), F.col("words").alias(f"w{x}"))
    return near.join(words("a"), "a").join(words("b"), "b").filter(_similar("wa", "wb")).select("a", "b")


def class_links(records: DataFrame, key: str = "chunk_no", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, class) of every record and (a, b) of similar classes."""
    members, ones = classes(records, key, text)
    ones = reliable(ones)
    return members, similar_classes(ones)


def similar_pairs(records: DataFrame, key: str = "chunk_no", text: str = "text") -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of similar records."""
    members, links = class_links(records, key, text)
    many = members.groupBy("class").count().filter("count > 1").select(F.col("class").alias("a"), F.col("class").alias("b"))
    ma, mb = members.select(F.col("class").alias("a"), F.col("id").alias("x")), members.select(F.col("class").alias("b"), F.col("id").alias("y"))
    both = links.unionByName(many).join(ma, "a").join(mb, "b").filter("a <> b or x < y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
