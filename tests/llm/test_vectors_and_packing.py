"""Whitening, packing and hard negatives against brute force, and their edge cases."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from haetae.llm import negatives, packing, whitening
from haetae.llm.queries import op11_whitening, op12_packing, op13_hard_negatives

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<double>, label int"


def vectors(spark, rows):
    """Rows with columns more whose names clash with results and helpers."""
    return spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("id", "v", "x", "n", "rank", "score", "component")})


def some(n, dims, seed=1, spread=1.0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, dims)) * np.linspace(1, 3, dims) * spread + rng.normal(size=dims)).round(3)


# Whitening


def by_hand(rows, m=4):
    fine = [(i, np.floor(256 * np.array(v))) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.unique(np.array([x for _, x in fine]), axis=0)
    n, mean = len(fit), fit.mean(0)
    cov = (fit - mean).T @ (fit - mean) / n
    e, base = np.linalg.eigh(cov)
    e, base = e[::-1][:m], base[:, ::-1][:, :m]
    total = [int(s) for s in fit.sum(0)]
    return n, fine, {k: [sum((n * int(a) - s) ** 2 for a, s in zip(x, total)) for _, x in fine] for k in ["deviation"]}, np.array([(x - mean) @ base / np.sqrt(e) for _, x in fine]), e / np.trace(cov)


def compare(rows, found, m=4):
    n, fine, deviation, white, share = by_hand(rows, m)
    assert len(found) == len(fine) * m and {r["n"] for r in found} == {n}
    for k in range(m):
        mine = sorted((r["vec_id"], r["deviation"], r["whitened"]) for r in found if r["component"] == k + 1)
        want = sorted((i, d, w) for (i, _), d, w in zip(fine, deviation["deviation"], white[:, k]))
        assert [x[:2] for x in mine] == [x[:2] for x in want]
        a, b = np.array([x[2] for x in mine]), np.array([x[2] for x in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
        assert [r["explained"] for r in found if r["component"] == k + 1] == pytest.approx([share[k]] * len(fine), rel=1e-10)
    assert max(r["identity_error"] for r in found) < 1e-9


def test_whitening_by_hand(spark):
    x = some(300, 7)
    rows = [(i, x[i % 200].tolist()) for i in range(300)]  # a third are copies
    compare(rows, whitening.whiten(vectors(spark, [(i, v, 0) for i, v in rows]).repartition(5)).collect())


def test_whitening_of_the_given_vectors(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    compare(rows, op11_whitening(spark, small).collect())


def test_whitening_leaves_out_what_is_not_finite(spark):
    x = some(40, 5)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(90, None), (91, [1.0, None, 1.0, 1.0, 1.0]), (92, [NAN] * 5), (93, [INF, 0.0, 0.0, 0.0, 0.0]), (94, [1.0]), (95, [])]
    found = whitening.whiten(vectors(spark, [(i, v, 0) for i, v in rows + bad])).collect()
    compare(rows, found)


def test_whitening_of_little(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect() == []  # nothing varies
    assert whitening.whiten(vectors(spark, [(1, [], 0)])).collect() == []
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 5.0], 0) for i in range(9)])).collect()
    assert {r["component"] for r in flat} == {1} and flat[0]["explained"] == pytest.approx(1)  # rank one
    ids = whitening.whiten(vectors(spark, [(None, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (3, [0.0, 5.0], 0)])).collect()
    assert len(ids) == 3 and {r["n"] for r in ids} == {2}


def test_whitening_of_very_large_numbers(spark):
    found = whitening.whiten(vectors(spark, [(1, [1e300, 1.0], 0), (2, [-1e300, 1.0], 0), (3, [1e9, 2.0], 0)])).collect()
    assert {r["deviation"] for r in found} == {(1 << 63) - 1} and all(np.isfinite(r["whitened"]) for r in found)
    exact = whitening.whiten(vectors(spark, [(i, [1e2 * i, 3.0 + i * i % 17], 0) for i in range(200)]).repartition(3)).collect()
    compare([(i, [1e2 * i, 3.0 + i * i % 17]) for i in range(200)], exact, 2)


@pytest.mark.parametrize("rank", [1, 3, 12])
def test_factor_and_rotations(rank):
    a = np.random.default_rng(rank).normal(size=(12, rank)) @ np.diag(np.logspace(0, -4, rank))
    v = a @ a.T
    factor = whitening.pivoted_cholesky(v)
    assert factor.shape[1] == rank and np.allclose(factor @ factor.T, v, atol=1e-12)
    order = np.argsort([int(np.flatnonzero(row).max(initial=-1)) if (row := factor[i]).any() else rank for i in range(12)], kind="stable")
    assert len(order) == 12
    e, base = whitening.one_sided_jacobi(factor)
    assert np.allclose(e, np.linalg.eigvalsh(v)[::-1][:rank], rtol=1e-9, atol=1e-15) and np.allclose(base.T @ base, np.eye(rank), atol=1e-12)


def test_rounds_pair_all_columns_once():
    for n in (1, 2, 5, 8):
        pairs = [tuple(sorted(p)) for a, b in whitening._rounds(n) for p in zip(a.tolist(), b.tolist())]
        assert sorted(pairs) == [(i, j) for i in range(n) for j in range(i + 1, n)]


# Packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def whole(tokenizer, rows, size=4096):
    out = []
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out += [(doc_id, at // size, at, len(ids[at : at + size]), zlib.crc32(ids[at : at + size].tobytes())) for at in range(0, len(ids), size)]
    return sorted(out, key=str)


def check_packed(rows, size=4096):
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence)


def test_pieces_are_the_librarys(spark, small, tokenizer):
    rows = op12_packing(spark, small).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == whole(tokenizer, docs)
    assert check_packed(rows) == -(-sum(r["length"] for r in rows) // 4096)  # no fewer are possible


ODD = ["a<|endoftext|>b <|startoftext|>", "ΣΊΣΥΦΟΣ ΟΔΟΣ İ ﬁ Å é ́x", "x y z\x0bq\x1cw\x85r​s", "don't WE'LL 's 12ab!!", "가나다 가 🎉🏳️‍🌈", "\r\n\t ", "z" * 50_000, "̀́ ͅ"]


def test_odd_texts_and_edges(spark, edge, tokenizer):
    texts = spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    both = edge.select("doc_id", "text", "score", "root").unionByName(texts.withColumns({"score": F.lit("y"), "root": F.lit("z")}))
    rows = packing.pack(both, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == whole(tokenizer, [tuple(r) for r in both.select("doc_id", "text").collect()])
    check_packed(rows)
    assert packing.pack(both.limit(0), public_tokenizers.path("word_bpe_49k.json")).collect() == []


def test_sequences_hold_the_ids(spark, small, tokenizer):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=512, ids=True)
    made = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in packed.drop("ids").collect():
        ids = [*tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
        assert made[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]] == ids[r["start"] : r["start"] + r["length"]]


def test_a_length_in_many_tasks(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one two three").otherwise(F.repeat(F.lit("word "), (F.col("id") % 40).cast("int"))).alias("text")).repartition(16)
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=64).collect()
    assert len(rows) == 3000 and check_packed(rows, 64) <= -(-sum(r["length"] for r in rows) // 64) + 1


def test_words_are_encoded_alone_only_where_that_is_proved():
    for name, by_word in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        with open(public_tokenizers.path(name), encoding="utf-8") as file:
            assert packing.independent(file.read()) is by_word


def lengths(kind, n, seed=3):
    rng = np.random.default_rng(seed)
    x = {"long": rng.integers(1400, 2800, n), "even": rng.integers(1, 4097, n), "short": rng.integers(1, 90, n), "few": rng.choice([1025, 1366, 2049, 700], n), "usual": np.clip(rng.lognormal(6.3, 0.9, n), 1, 4096).astype(int)}[kind]
    return np.bincount(x, minlength=4097)


@pytest.mark.parametrize("kind", ["long", "even", "short", "few", "usual"])
def test_plan_holds_every_piece(kind):
    counts = lengths(kind, 4000)
    patterns, lower = packing.plan(counts, 4096)
    held = np.zeros(4097, np.int64)
    for lot, many in patterns:
        assert sum(length * often for length, often in lot) <= 4096
        for length, often in lot:
            held[length] += often * many
    assert (held == counts).all()
    used, greedy = sum(many for _, many in patterns), sum(many for _, many in packing.best_fit(counts, 4096))
    assert lower <= used + 1e-6 and used <= greedy * 1.015 + 1


def test_program_is_near_its_bound():
    steps, lower, upper = packing.solve(lengths("usual", 20_000), 4096)
    assert lower <= upper <= 1.1 * lower
    for config, length, much in steps:
        assert np.bincount(config, length).max() <= 4096 and len(much) == config.max() + 1


def test_pricing_by_brute_force():
    rng = np.random.default_rng(5)
    kinds, value = np.array([3, 5, 7, 11]), np.array([0.3, 0.55, 0.7, 1.2])
    best, take = packing.price(value, np.ones(4), kinds, 30, 0.0, rng.random(31))
    worth = [0.0] * 31
    for room in range(1, 31):
        worth[room] = max([worth[room - 1], *(worth[room - k] + v for k, v in zip(kinds, value) if k <= room)])
    assert np.allclose(best, worth)
    where, what = packing.follow(take, np.arange(31))
    for room in range(31):
        mine = what[where == room]
        assert mine.sum() <= room and np.isclose(sum(value[np.searchsorted(kinds, k)] for k in mine), best[room])


def test_best_fit_in_lots_is_best_fit():
    def plain(counts, size):
        bins = []
        for length in range(size, 0, -1):
            for _ in range(counts[length]):
                fit = min((b for b in bins if b[0] >= length), key=lambda b: b[0], default=None)
                if fit is None:
                    bins.append([size - length])
                else:
                    fit[0] -= length
        return len(bins)

    for seed in range(8):
        counts = np.bincount(np.random.default_rng(seed).integers(1, 60, 200), minlength=101)
        assert sum(many for _, many in packing.best_fit(counts, 100)) == plain(counts, 100)


def test_plan_does_not_grow_with_the_pieces():
    few, many = (len(packing.plan(lengths("usual", 3000) * k, 4096)[0]) for k in (100, 100_000))
    assert many < 1.5 * few + 5000


# Hard negatives


def mined(rows, n_pos=5, n_neg=3, scale=256):
    fine = [(i, lab, [int(np.floor(scale * c)) for c in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    anchors: dict = {}
    for i, lab, v in fine:
        if i % 50 == 0:
            anchors[i] = min(anchors.get(i, (lab, v)), (lab, v))
    out = []
    for a, (lab, v) in anchors.items():
        others = sorted((-sum(x * y for x, y in zip(v, w)), i, other == lab) for i, other, w in fine if i != a and len(w) == len(v))
        for s, p, _ in [o for o in others if o[2]][:n_pos]:
            good = [(i, -t) for t, i, same in others if not same and 50 * -s <= 100 * -t <= 95 * -s][:n_neg]
            out += [(a, p, k + 1, i, -s, t) for k, (i, t) in enumerate(good)]
    return sorted(out)


def same(found, rows, **more):
    assert sorted(tuple(r) for r in found.collect()) == mined(rows, **more)


def anchors_of(df):
    return df.filter(F.col("vec_id") % 50 == 0)


@pytest.mark.parametrize("at_once", [16384, 3])
def test_negatives_by_hand(spark, at_once):
    x = some(600, 6, seed=2).tolist()
    rows = [(i, x[i], i % 4) for i in range(600)]
    df = vectors(spark, rows).repartition(7)
    same(negatives.mine(df, anchors_of(df), at_once=at_once), rows)


def test_negatives_of_the_given_vectors(spark, small):
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    same(op13_hard_negatives(spark, small), rows)


def test_ties_copies_and_odd_rows(spark):
    base = [[1.0, 0.5], [1.0, 0.5], [0.9, 0.1], [0.6, 0.4], [0.5, 0.5]]
    rows = [(i, base[i % 5], i % 3) for i in range(200)] + [(7, base[0], 1), (7, base[0], 1), (50, base[2], 0), (100, [1.0], 1), (150, [-1.0, -2.0], 2)]
    rows += [(300, None, 1), (350, [1.0, None], 1), (400, [NAN, 1.0], 1), (450, [INF, 1.0], 1), (None, [1.0, 1.0], 1), (500, [1.0, 1.0], None), (550, [], 1), (600, [0.0, 0.0], 1)]
    df = vectors(spark, rows).repartition(4)
    same(negatives.mine(df, anchors_of(df)), rows)


def test_no_rows_and_no_positives(spark):
    assert negatives.mine(vectors(spark, []), vectors(spark, [])).collect() == []
    alone = [(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 2), (2, [0.5, 1.0], 3)]
    assert negatives.mine(vectors(spark, alone), anchors_of(vectors(spark, alone))).collect() == []


def test_scores_beyond_doubles(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(1, 1 << 30, 4) * 1.0).tolist(), i % 3) for i in range(120)]
    df = vectors(spark, rows)
    same(negatives.mine(df, anchors_of(df), scale=1.0), rows, scale=1)


def test_limits_in_whole_numbers():
    scores = np.array([*range(-45, 46), (1 << 63) - 1, 10**15 + 7])
    low, high = negatives.limits(scores)
    for s, a, b in zip(map(int, scores), map(int, low), map(int, high)):
        assert 100 * a >= 50 * s > 100 * (a - 1) and 100 * b <= 95 * s < 100 * (b + 1)


def test_best_of_groups():
    best, rng, all_rows = negatives.Best(5, 3), np.random.default_rng(6), []
    for _ in range(20):
        g, s, i = rng.integers(0, 5, 30), rng.integers(0, 9, 30), rng.integers(0, 1000, 30)
        best.add(g, s, i)
        all_rows += zip(g.tolist(), s.tolist(), i.tolist())
    for group in range(5):
        want = sorted((-s, i) for g, s, i in all_rows if g == group)[:3]
        assert sorted((-s, i) for g, s, i in zip(best.group.tolist(), best.score.tolist(), best.id.tolist()) if g == group) == want
        assert best.kth[group] == -want[-1][0]
