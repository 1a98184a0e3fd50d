import numpy as np
import pyarrow as pa

from cstloom.llm import provenance as pv
from cstloom.llm.common import components

HAND = "import os\n\n# Reads the generated files and checks them.\ndef {0}_one(alpha, beta):\n    gamma = alpha.load(beta)\n    for delta in gamma:\n        if delta > beta:\n            print(\"seen\", delta)\n    return gamma\n\ndef {0}_two(epsilon):\n    query = \"select a, b, c from d where e\"\n    while epsilon:\n        epsilon = {0}_one(epsilon, query)\n    return epsilon - 7\n"
GETTERS = "".join(f"func (x *{{0}}Msg) Get{{0}}{i}() int64 {{{{ if x != nil {{{{ return x.F{i} }}}}; return 0 }}}}\n" for i in range(12))
MINIFIED = "function b(s,x){var e=s.a,n=0;for(;n<x;n++)e[s]^=71;return e?x:b(s-1,x)}var f=o=>o.map(x=>({a:x.b,c:x[2]}));!function(m){m.a=[231,8,57,173,72];m.v=\"q\"}(a);" * 3
DATA = "table = [\n" + "".join(", ".join(str(i * j % 977) for j in range(12)) + ",\n" for i in range(1, 30)) + "]\n"


def test_kinds(spark):
    files = {
        1: ("r/src/a.py", HAND.format("load")), 2: ("r/src/b.go", "package p\n\n" + GETTERS.format("Aba")), 3: ("r/src/c.js", MINIFIED), 4: ("r/src/d.py", DATA), 5: ("r/third_party/x/e.py", HAND.format("take")),
        6: ("r/src/f.py", "# denfiljs 1.0.0 - MIT licensed\n" + HAND.format("give")), 7: ("r/src/g.py", "# uses denfiljs for the rest\n" + HAND.format("make")), 8: ("r/src/h.py", "# Code generated by xgen 2. DO NOT EDIT.\n" + HAND.format("form")), 9: ("r/vendor_portal/i.py", HAND.format("keep")),
        10: ("r/src/j.toml", DATA), 11: ("r/src/k.py", None), 12: ("r/src/l.py", "  "), 13: ("r/src/m.js", "// Do not edit the page while the job runs.\nfunction f(a) { return a; }\n"), 14: ("s/src/n.py", "# denfiljs 1.0.0 - MIT licensed\n" + HAND.format("give").replace("7", "8")), 15: ("t/src/o.py", HAND.format("give")),
    }
    chunks = spark.createDataFrame([(i, p.split("/")[0], p, "file", t, 1) for i, (p, t) in files.items()] + [(1, "r", "r/src/a.py", "file", files[1][1], 1)], "file_id bigint, repo string, filepath string, chunk_type string, text string, marks int")
    scans = spark.createDataFrame([(20, "r", "r/vendor/z/a.js"), (21, "r", "r/src/a.js"), (22, "r", None), (None, "r", "r/vendor/b.js")], "file_id bigint, repo string, filepath string")
    library = spark.createDataFrame([("denfiljs", "1.0.0")], "library string, lib_version string")
    kinds = {r.file_id: [c for c in ("generated", "minified", "vendored", "data") if r[c]] for r in pv.judged_files(scans, chunks, library).collect()}
    assert {i: k for i, k in kinds.items() if k} == {2: ["generated"], 3: ["minified"], 4: ["data"], 5: ["vendored"], 6: ["vendored"], 8: ["generated"], 14: ["vendored"], 15: ["vendored"], 20: ["vendored"]}
    assert pv.not_hand_written(scans.limit(0), chunks.limit(0), library.limit(0)).count() == 0


def test_path_marks():
    assert pv.path_marks("r/lib/3rdparty/x/a.py") == pv.VENDOR and pv.path_marks("r/distance/a.py") == 0 and pv.path_marks("vendor/a.py") == 0


def test_whole_texts_count():
    greek = "table = [\n" + "".join(", ".join(f'"{chr(945 + (i * j) % 24) * 9}"' for j in range(8)) + ",\n" for i in range(1, 60)) + "]\n"
    for text in (greek, "x = 1\n" * 700 + greek * 4):
        assert pv.examine(text, set(), {})[0] & (pv.DATA | pv.REPEATED)
    assert pv.examine(greek, set(), {})[0] & pv.DATA
    binary = "PK\x03\x04" + "".join(chr(128 + i * 37 % 64) + '"ab"' for i in range(2000))
    assert not pv.examine(binary, set(), {})[0]


def test_opening_comments_are_read_to_their_end():
    text = "/*\n" + "Permission is granted to all.\n" * 60 + "@license denfiljs 1.2\n*/\nint a;\n"
    assert pv.header_marks(text, set()) == pv.VENDOR
    assert pv.header_marks("// Terms.\n" * 60 + "// Code generated by xgen. DO NOT EDIT.\nint a;\n", set()) == pv.GEN
    assert pv.header_marks("/* Terms. */\nint a;\n// Code generated by xgen. DO NOT EDIT.\n", set()) == 0
    assert pv.header_marks("<!-- a\nb --> c\nd\n<!-- Code generated by xgen. DO NOT EDIT. -->", set()) == 0


def _files(spark, rows):
    return spark.createDataFrame([(i, p.split("/")[0], p, "file", t) for i, (p, t) in enumerate(rows)], "file_id bigint, repo string, filepath string, chunk_type string, text string")


def test_families_decide_without_marks(spark):
    templates = [GETTERS.format(f"Row{chr(97 + k)}") for k in range(4)]
    rows = [(f"r{k % 2}/src/{k}.go", f"package p{k}\n\n{t}") for k, t in enumerate(templates)] + [(f"q/src/h{k}.py", HAND.format(f"n{k}")) for k in range(3)]
    rows += [(f"{r}/lib/c.py", HAND.format("same") + "\n".join(f"def extra_{k}(a): return a[{k}] or other_{k}" for k in range(6))) for r in ("a", "b")]
    none = spark.createDataFrame([], "file_id bigint, repo string, filepath string")
    library = spark.createDataFrame([], "library string")
    got = {r.file_id: r for r in pv.judged_files(none, _files(spark, rows), library, marks=False).collect()}
    assert all(got[k].generated and got[k].by_family and got[k].family_files == 4 for k in range(4))
    assert not any(got[k].generated or got[k].vendored for k in range(4, 7)) and got[7].vendored and got[8].vendored


def test_links_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base, sets = [np.unique(rng.integers(0, 2**31, int(n))).astype(np.int32) for n in rng.integers(8, 400, 40)], []
    for b in base:
        sets.append(b)
        for share in (0.05, 0.09, 0.3):  # changed shares of the set
            keep = b[rng.random(len(b)) > share]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**31, len(b) - len(keep)).astype(np.int32)])).astype(np.int32))
    sets += [base[0]] * 5
    seen = spark.createDataFrame([(i, 0, *(x.tolist() for x in pv._bands(s)), s.tolist()) for i, s in enumerate(sets)], "file_id bigint, kind int, bands array<bigint>, sketch array<smallint>, shingles array<int>")
    family = {r.file_id: r.family for r in pv.families(seen).collect()}
    want = [(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= pv.LEAST * len(np.union1d(sets[i], sets[j]))]
    assert sum(family[i] == family[j] for i, j in want) >= 0.97 * len(want) and len({family[i] for i in range(0, 160, 4)}) == 40


def _changed(rng, base, share):
    keep = base[rng.random(len(base)) > share]
    return np.unique(np.concatenate([keep, rng.integers(0, 2**31, len(base) - len(keep)).astype(np.int32)])).astype(np.int32)


def test_every_pair_of_a_crowded_bucket_counts(spark):
    rng = np.random.default_rng(8)
    sizes = [int(n) for n in rng.integers(8, 700, 30)]
    sets = [np.unique(rng.integers(0, 2**31, n)).astype(np.int32) for n in sizes]
    sets += [_changed(rng, b, 0.08) for b in sets for _ in range(2)] + [_changed(rng, sets[0], 0.04) for _ in range(40)]
    # one bucket holds them all
    seen = spark.createDataFrame([(i, 0, [5], pv._bands(s)[1].tolist(), s.tolist()) for i, s in enumerate(sets)], "file_id bigint, kind int, bands array<bigint>, sketch array<smallint>, shingles array<int>")
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= pv.LEAST * len(np.union1d(sets[i], sets[j]))]
    want = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    family = {r.file_id: r.family for r in pv.families(seen).collect()}
    assert len(links) > 300 and family == {i: want.get(i, i) for i in range(len(sets))}


def test_sketches_leave_out_no_similar_pair():
    rng = np.random.default_rng(9)
    alike = far = 0
    for n in (1, 5, 40, 255, 256, 257, 420, 512, 900, 3000):
        for share in (0.02, 0.08, 0.1, 0.11, 0.4):
            a = np.unique(rng.integers(0, 2**31, n)).astype(np.int32)
            b = _changed(rng, a, share)[: max(1, n - int(rng.integers(0, 3)))]
            sketches = [pv._bands(a)[1], pv._bands(b)[1]]
            words = pv._words(np.array([len(a), len(b)]))
            assert [len(x) for x in sketches] == [4 * w for w in words]
            apart = pv._differences(np.concatenate(sketches).view(np.uint64), np.cumsum(words) - words, words, np.array([0]), np.array([1]))[0]
            shared = len(np.intersect1d(a, b))
            assert apart <= len(a) + len(b) - 2 * shared
            rows = pa.RecordBatch.from_pydict({"kind": pa.array([0, 0], pa.int32()), "band": [3, 3], "entry": [7, 4], "family": [7, 4], "size": pa.array([len(a), len(b)], pa.int32()), "sketch": pa.array(sketches, pa.list_(pa.int16()))})
            pairs = pa.RecordBatch.from_pydict({"kind": [0], "a": [4], "b": [7], "na": [len(a)], "nb": [len(b)], **{k: pa.array([x], pa.list_(pa.int16())) for k, x in zip(("ka", "kb"), sketches)}})
            met = sum(r.num_rows for r in pv._apart(iter([rows.slice(0, 1), rows.slice(1)])))
            assert met == sum(r.num_rows for r in pv._near(iter([pairs])))
            if shared >= pv.LEAST * (len(a) + len(b) - shared):
                alike += 1
                assert met == 1
            elif share == 0.4 and n > 200:
                far += 1
                assert met == 0
    assert alike > 20 and far >= 6


def test_buckets_are_whole_across_batches():
    band = np.array([1, 1, 2, 3, 3, 3, 3, 3, 4, 5, 5], np.int64)
    rows = pa.RecordBatch.from_pydict({"kind": pa.array([0] * 8 + [1] * 3, pa.int32()), "band": band, "id": np.arange(11)})
    want = [(0, 1, [0, 1]), (0, 3, [3, 4, 5, 6, 7]), (1, 5, [9, 10])]
    for size in range(1, 12):
        got = [tuple(r.values()) for b in pv._crowded(rows.slice(at, size) for at in range(0, 11, size)) for r in b.to_pylist()]
        assert got == want


def test_components_of_long_paths(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(links).collect()}
    assert {got[i] for i in range(61)} == {0} and got[101] == 100 and components(links.limit(0)).count() == 0
