import random
import re
from collections import Counter

from cstloom.llm import near_duplicates as nd


def brute(rows):
    bags = {i: Counter(re.findall(r"\w+", t)) for i, t in rows if t}
    out = set()
    for a in bags:
        for b in bags:
            if a < b:
                shared, most = sum((bags[a] & bags[b]).values()), max(sum(bags[a].values()), sum(bags[b].values()))
                if most and 10 * shared >= 7 * most:
                    out.add((a, b))
    return out


def test_all_pairs(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(4000)] + ["if", "for", "return"] * 200
    rows = []
    for family in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        for _ in range(rng.randint(1, 4)):
            text = [rng.choice(words) if rng.random() < 0.12 else w for w in base]
            if rng.random() < 0.3:
                rng.shuffle(text)
            rows.append((len(rows), " ".join(text)))
    rows += [(900 + i, "the same few words again") for i in range(120)] + [(2000, "the same few words now"), (2001, None), (2002, ""), (2003, "..."), (2004, "élan élan ü"), (2005, "élan  ü élan"), rows[0]]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "chunk_no bigint, text string, id int")
    want, got = brute(dict(rows).items()), [tuple(r) for r in nd.similar_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(set(got)) >= 0.99 * len(want)
    assert {(900, 901), (2004, 2005)} <= set(got)
    members, links = nd.class_links(df)
    assert members.filter("class = 900").count() == 120 and links.filter("a >= b").count() == 0
    assert nd.similar_pairs(df.limit(0)).count() == 0


def test_pigeonhole_guarantee():
    """Signatures that differ in at most MOST_ERRORS symbols share a key."""
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 1 << nd.BITS, nd.SYMBOLS).astype(np.uint64)
        b = a.copy()
        off = rng.choice(nd.SYMBOLS, nd.MOST_ERRORS, replace=False)
        b[off] ^= np.uint64(1)
        keys = nd._keys(np.stack([a, b]), 0)
        assert set(keys[0]) & set(keys[1])


def test_families_of_common_words(spark):
    """Words that a family of many rows shares are no less words than others."""
    rng = random.Random(8)
    shared = [f"s{i}" for i in range(40)]
    rows = [(i, " ".join(shared + [f"v{i}_{k}" for k in range(10)])) for i in range(60)]
    rows += [(100 + i, " ".join(f"w{rng.randint(0, 3000)}" for _ in range(50))) for i in range(300)]
    df = spark.createDataFrame(rows, "chunk_no bigint, text string")
    got = sorted(tuple(r) for r in nd.similar_pairs(df).collect())
    assert got == sorted(brute(rows)) and len(got) == 60 * 59 // 2


def test_hamming_join(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(60):
        base = [f"w{rng.randint(0, 900)}" for _ in range(rng.randint(25, 60))]
        for share in (0, 0.05, 0.12, 0.25):
            rows.append((len(rows), " ".join(f"v{rng.randint(0, 900)}" if rng.random() < share else w for w in base)))
    _, ones = nd.classes(spark.createDataFrame(rows, "chunk_no bigint, text string"))
    exact, got = ({tuple(r) for r in f(ones).collect()} for f in (nd.similar_classes, nd.hamming_classes))
    kept = {r.id for r in ones.select("id").collect()}
    assert exact == {(a, b) for a, b in brute(rows) if a in kept and b in kept}
    assert got <= exact and len(got) >= 0.9 * len(exact)  # a third of these pairs lie just above the threshold
    assert nd.hamming_classes(ones.limit(0)).count() == 0
