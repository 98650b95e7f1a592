"""Near-duplicates, decontamination, top-k and licences against brute force and DuckDB."""

import hashlib
import re
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from conftest import TEXTS  # noqa: E402

from haetae.llm import components, decontaminate, licenses, queries, simhash, topk  # noqa: E402
from haetae.llm.common import read_table  # noqa: E402

NAMES = "documents embeddings pages benchmark labels conversations".split()


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, linked):
    """Smallest index reachable, by flooding."""
    root = list(range(len(values)))
    for i in range(len(values)):
        if root[i] == i:
            todo = [i]
            while todo:
                a = todo.pop()
                for b in range(i + 1, len(values)):
                    if root[b] == b and linked(values[a], values[b]):
                        root[b] = i
                        todo.append(b)
    return root


def close(a, b):
    return (a ^ b).bit_count() <= 4


def test_fingerprints():
    for _, text in TEXTS:
        assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)
    for text in ("A b\x0bC\x0cd e", "a b c d e f", "É é", "one two three"):
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("frontier", [8, 1 << 20])
def test_trie_join_finds_every_link(frontier):
    rng = np.random.default_rng(5)
    for trial in range(25):
        base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
        keys = base[rng.integers(0, 6, 80)]
        for _ in range(trial % 7):
            keys = keys ^ (np.uint64(1) << rng.integers(0, 64, 80).astype(np.uint64))
        keys = np.unique(keys)
        fixed = (0, 0xFFF << 52, 0xF0)[trial % 3]
        label = simhash.trie_components(keys, np.uint64(fixed), frontier=frontier)
        assert label.tolist() == groups([int(k) for k in keys], lambda a, b: close(a, b) and not (a ^ b) & fixed)


def test_dense_cluster_is_one_component():
    rng = np.random.default_rng(6)
    keys = np.full(6000, 0x123456789ABCDEF0, np.uint64)
    for _ in range(6):
        keys ^= np.uint64(1) << rng.integers(12, 40, 6000).astype(np.uint64)
    label = simhash.trie_components(np.unique(keys), np.uint64(0xFFF << 52))
    assert set(label.tolist()) == {0}


def expected_rows(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    root = groups(prints, close)
    least = {}
    for (doc_id, _), r in zip(rows, root):
        if doc_id is not None:
            least[r] = min(doc_id, least.get(r, doc_id))
    return sorted(((i or 0), f"{p:016x}", least.get(r) or 0) for (i, _), p, r in zip(rows, prints, root))


def test_near_duplicates(spark, small, edge):
    rows = [(r.doc_id, r.text) for r in read_table(spark, small, "documents").collect()]
    rows += [(9000 + i, t) for i, (_, t) in enumerate(rows[:30])] + [(9100, ""), (9101, " \t\n"), (9102, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for group in (simhash.GROUP, 3):
        got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, group=group).collect())
        assert got == expected_rows(rows)
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id or 0) for r in simhash.near_duplicates(edge).collect())
    assert got == expected_rows(TEXTS)
    assert simhash.near_duplicates(edge.limit(0)).collect() == []


def test_keep_one(spark, edge):
    kept = simhash.keep_one(edge)
    assert kept.schema == edge.schema
    ids = [r.doc_id for r in kept.collect()]
    least = {c for _, _, c in expected_rows(TEXTS) if c}
    assert sorted(i for i in ids if i) == sorted(least) and ids.count(None) == 1


def test_keep_one_of_repeated_ids(spark):
    """An id may have several texts, and several copies of one; the rule is the same whether ids are broadcast or joined."""
    base = " ".join(f"w{i}" for i in range(40))
    texts = [base, "another text of its own kind entirely", "a third one that nobody else has written"]
    rows = [(5, base), (5, base), (5, texts[1]), (7, base), (3, texts[2]), (5, texts[2]), (8, "alone and not repeated by anyone here"), (None, base), (None, "no id but its own words"), (None, "no id but its own words"), (9, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for at_once in (simhash.DROPPED, 0):
        kept = sorted(map(str, ((r.doc_id, r.text or "") for r in simhash.keep_one(df, at_once=at_once).collect())))
        assert kept == sorted(map(str, [(5, base), (5, texts[1]), (3, texts[2]), (8, rows[6][1]), (None, rows[8][1]), (9, "")])), at_once
    alone = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts])], "doc_id long, text string")
    for at_once in (simhash.DROPPED, 0):
        assert sorted(r.doc_id for r in simhash.keep_one(alone, at_once=at_once).collect()) == [0, 1, 2]


def test_hot_groups_are_split_until_small(spark):
    """Fingerprints that agree in 40 bits are in one group of every dealing; no link is lost however often it is split."""
    rng = np.random.default_rng(3)
    prints = np.unique(np.concatenate([(rng.integers(0, 1 << 20, 300, dtype=np.uint64) << np.uint64(30)) | np.uint64(5 << 56), rng.integers(0, 1 << 63, 100, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    values = [int(x) for x in prints]
    root = groups(values, close)
    want = {values[i]: values[r] for i, r in enumerate(root)}
    for group in (16, 60, simhash.GROUP):
        label = dict(zip(values, values))
        edges = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.links(df, group=group).collect()]
        assert all(want[a] == want[b] for a, b in edges)
        changed = True
        while changed:
            changed = False
            for a, b in edges:
                least = min(label[a], label[b])
                changed |= label[a] != least or label[b] != least
                label[a] = label[b] = least
        assert label == want, group


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)] + [tuple(map(int, rng.integers(2000, 2200, 2))) for _ in range(150)]
    rows = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    nodes = sorted({x for a, b in edges if a != b for x in (a, b)})
    at = {n: i for i, n in enumerate(nodes)}
    near = {frozenset(e) for e in edges}
    root = groups(nodes, lambda a, b: frozenset((a, b)) in near)
    assert sorted((r.node, r.root) for r in rows) == [(n, nodes[root[at[n]]]) for n in nodes]
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_scan(docs, items):
    """doc -> (n_words, n_hit, items) by comparing every window with every place."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    split = [(str(i), w) for i, t in items if i is not None and t is not None and (w := words(t))]
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, x in split:
            n = min(10, len(x))
            windows = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found.add(item)
        out.append((doc_id or 0, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def digest(found):
    rows = found.select(F.coalesce("doc_id", F.lit(0)), "n_words", "n_hit", F.size("items").cast("long"), F.sha2(F.array_join("items", ",").cast("binary"), 256), F.col("n_hit") > 0)
    return sorted(map(tuple, rows.collect()))


ITEMS = [(1, "a b c d e f g h i j k l"), (2, "x y"), (10, "B C D E F G H I J K"), (3, None), (None, "q r s"), (4, "?!"), (5, "Zwölf zwölf"), (5, "tie"), (2, "x y"), (6, "")]
DOCS = [(1, "z a b c d, e f g h i j k l! x y x y"), (2, "b-c-d-e-f-g-h-i-j-k"), (3, "a b c d e f g h i"), (4, None), (5, ""), (6, "tie"), (6, "tie"), (None, "X\x00Y"), (7, "ZWöLF zwölf q r s"), (8, "x y " * 5000), (9, "a a b c d e f g h i j a b c d e f g h i j k l l")]


def test_decontamination(spark, small):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("items", F.lit("x"))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("n_hit", F.lit(0))
    for at_once in (decontaminate.AT_ONCE, 8):
        assert digest(decontaminate.scan(docs, bench, at_once=at_once)) == plain_scan(DOCS, ITEMS)
    kept = decontaminate.keep_clean(docs, bench, at_once=8)
    clean = [d for d in DOCS if not plain_scan([d], ITEMS)[0][5]]
    assert kept.schema == docs.schema and sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted((i, t or "") for i, t in clean)
    assert decontaminate.scan(docs.limit(0), bench).collect() == []
    assert all(not r.n_hit for r in decontaminate.scan(docs, bench.limit(0)).collect())


def test_wu_manber_skips(spark):
    tool = decontaminate.searches([[b"w%d" % i for i in range(40)]], 10)[0]
    looked = []
    class Watched(dict):
        def get(self, key, default=None):
            looked.append(key)
            return super().get(key, default)
    tool.shift = Watched(tool.shift)
    assert tool.find([b"other"] * 800) == [] and len(looked) <= 800 / 8 + 2
    assert [a for a, _ in tool.find([b"other"] * 13 + [b"w%d" % i for i in range(5, 17)])] == [13, 14, 15]


def plain_top(rows, ids, k=10):
    fine = [(i, [int(np.floor(1024 * np.float64(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for own in sorted(ids):
        mine = [v for i, v in fine if i == own]
        if mine:
            q = min(mine)
            found = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v)))), i) for i, v in fine if i != own and len(v) == len(q))
            out += [(own, rank, i, -s) for rank, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 6)]) for i in range(300)]
    rows += [(400 + i, [0.25, 0.0, -0.5, 0.0, 0.0, 0.0]) for i in range(20)] + [(500, [0.0] * 6), (600, None), (700, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (800, [float("nan")] + [0.0] * 5), (900, [float("inf")] * 6), (1000, [0.5, 0.5]), (1001, [0.25, 0.25]), (1100, []), (1101, []), (None, [1.0] * 6), (100, rows[100][1]), (1200, [1e9] * 6), (1300, [-1e9] * 6), (1400, [3e30] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    asked = {i for i, _ in rows if i is not None and i % 100 == 0}
    expected = plain_top(rows, asked)
    for at_once in (topk.AT_ONCE, 2):
        got = sorted(map(tuple, topk.top_k(df, df.filter("vec_id % 100 = 0"), at_once=at_once).collect()))
        assert got == expected
    assert topk.top_k(df.limit(0), df).collect() == [] and topk.top_k(df, df.limit(0)).collect() == []
    few = topk.top_k(df.filter("vec_id in (1000, 1001, 1100)"), df.filter("vec_id = 1000")).collect()
    assert [tuple(r) for r in few] == [(1000, 1, 1001, 256 * 512 * 2)]


def test_threshold_algorithm_stops_early():
    rng = np.random.default_rng(3)
    vectors = np.floor(rng.normal(0, 1, (20_000, 2)) * 1024)
    lists = topk.Lists(np.arange(20_000), vectors)
    reads = []
    class Watched:
        def __init__(self, a):
            self.a = a
        def __getitem__(self, at):
            reads.append(self.a[at].shape[0])
            return self.a[at]
    lists.vectors = type("V", (), {"dtype": vectors.dtype, "__getitem__": lambda self, at: (reads.append(len(at)), vectors[at])[1]})()
    best, scores = lists.top(-1, np.array([900.0, -300.0]), 10)
    truth = np.lexsort((np.arange(20_000), -(vectors @ np.array([900.0, -300.0]))))[:10]
    assert best.tolist() == truth.tolist() and sum(reads) < 4000


def test_few_embeddings_are_scored_in_full():
    """On the vectors themselves: most are left after a part of their dimensions, and the answer is that of all scores."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, vectors = np.array(table["vec_id"]), np.floor(1024 * np.array(table["embedding"].to_pylist(), float))
    lists, asked = topk.Lists(ids, vectors), np.flatnonzero(ids % 100 == 0)
    for q in asked:
        best, scores = lists.top(int(ids[q]), vectors[q], 10)
        truth = vectors @ vectors[q]
        order = [i for i in np.lexsort((ids, -truth)) if ids[i] != ids[q]][:10]
        assert best.tolist() == order and scores.tolist() == truth[order].tolist()
    pairs = len(ids) * len(asked)
    assert lists.reads.full < 0.15 * pairs and lists.reads.values < 0.65 * pairs * vectors.shape[1]


def test_licenses(spark):
    mit = licenses.KNOWN[0][1]
    texts = [mit, "Copyright (c) 2020 A. B.\nAll rights reserved.\n" + mit.replace("\n\n", "\n").lower(), "The MIT Licence (MIT)\r\n\r\nCopyright © 2001 x\n\n" + mit.split("\n\n", 1)[1].replace("sublicense", "sub-license"), mit + " and more", None, "", "Released under the MIT License.", "x\nreleased under the MIT licence\nLicensed under CC BY-NC 4.0.\nÀÉ ① ©", "(c) 2020\n(c) 2021 z\nISC License\n" + licenses.KNOWN[1][1], "#  SPDX-License-Identifier: Apache-2.0 \n"]
    rows = [*enumerate(texts), (None, mit), (0, mit)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("digest", "license", "notices")})
    got = licenses.scan(df).collect()
    name = {r.doc_id: (r.license, r.notices) for r in got}
    assert len(got) == len(rows) and [name[i][0] for i in range(10)] == ["MIT"] * 3 + [None] * 3 + ["MIT", None, "ISC", "Apache-2.0"]
    assert name[7][1] == "CC-BY-NC-4.0,MIT" and name[4] == (None, "")
    assert all(r.digest == hashlib.sha256(licenses.canonical_text(t or "").encode()).hexdigest() for r, t in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0)), [mit, mit, *texts[1:], mit]) if r.license)
    own = spark.createDataFrame([(got[0].digest, "mine")], "digest string, license string")
    assert {r.license for r in licenses.scan(df, known=own).collect()} == {"mine", None}
    plan = licenses.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert licenses.scan(df.limit(0)).collect() == []


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_duckdb(spark, small, name):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    made = queries.QUERIES[name](spark, small)
    cursor = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(made.columns)
    assert sorted(map(str, cursor.fetchall())) == sorted(map(str, (tuple(r[c] for c in columns) for r in made.collect())))


def test_whole_licenses(spark):
    """Whole texts where the system has them, notices of several lines, and SPDX names."""
    folder = Path("/usr/share/common-licenses")
    files = {"GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "Artistic": "Artistic-1.0"}
    want = [((folder / file).read_text("utf-8"), name) for file, name in files.items() if (folder / file).exists()]
    if not want:
        pytest.skip("this machine has no /usr/share/common-licenses to hold whole texts against")
    want += [(text.split("END OF TERMS AND CONDITIONS")[0] + "END OF TERMS AND CONDITIONS\n", name) for text, name in want if "END OF TERMS AND CONDITIONS" in text]
    want.append(("""# x.c: does y
# Copyright (C) 2020 A. B.
""", None))
    want.append(("""/* Copyright (C) 2020 A. B.
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 *
 * You should have received a copy of the GNU General Public License
 * along with this program.  If not, see <https://www.gnu.org/licenses/>.
 */""", "GPL-3.0-or-later"))
    want += [(f"// SPDX-License-Identifier: {name}", name) for name in ("GPL-3.0-or-later", "AGPL-3.0-only", "EPL-2.0", "LGPL-2.1")]
    rows = licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(want)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.license for r in rows} == {i: name for i, (_, name) in enumerate(want)}


def test_copyright_lines(spark):
    """Lines that name who has the copyright make no difference; clauses that begin alike stay."""
    lines = ["Copyright The X Authors", "Copyright Jane Doe 2020", "  * Portions copyright A. B.", "Portions Copyright (c) 2001 C", "copyright: Noticeboard Ltd.", "Copyright the Softwarehouse Inc", "Copyright Jane\r"]
    mit = licenses.KNOWN[0][1]
    clauses = ["copyright notice, this list of conditions", "copyright holders and contributors", "copyright the software, and", "copyright law", "copyright", "portions copyright notice", "copyright " + "x y " * 40]
    texts = [*(f"{line}\n\n{mit}" for line in lines), "\n".join(lines) + "\n" + mit, *(f"{c}\n{mit}" for c in clauses)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.digest, r.license, r.notices) for r in licenses.scan(df).collect()}
    assert [got[i][1] for i in range(len(texts))] == ["MIT"] * (len(lines) + 1) + [None] * len(clauses)
    assert all(got[i][0] == hashlib.sha256(licenses.canonical_text(t).encode()).hexdigest() for i, t in enumerate(texts))
    con = duckdb.connect()
    documents = df.toArrow()  # noqa: F841  DuckDB reads it by name
    assert {r[0]: r[1:] for r in con.execute(licenses.oracle_sql()).fetchall()} == got
