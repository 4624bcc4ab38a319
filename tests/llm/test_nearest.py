import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import nearest as n

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


def brute(ids, vectors, every, k):
    out = {}
    for i, q in zip(ids, vectors, strict=True):
        if i % every == 0:
            scores = vectors @ q
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
            out[int(i)] = [int(ids[j]) for j in order]
    return out


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(0)
    directions, queries = (n.lengths(rng.standard_normal((m, 48)))[1] for m in (2000, 50))
    codes, along, left = n.encode(directions)
    near = n.estimates(queries, codes, along)
    outside = np.abs(near - queries @ directions.T) > n.BOUND * left / np.sqrt(47) + n.ROUNDING
    assert codes.shape == (2000, n.LEVELS * 6) and codes.dtype == np.uint8 and left.max() < 0.05
    assert outside.mean() < 0.01
    assert np.corrcoef(near.ravel(), (queries @ directions.T).ravel())[0, 1] > 0.999
    assert all(np.allclose(n.rotation(48, k) @ n.rotation(48, k).T, np.eye(48)) for k in range(n.LEVELS))


def test_few_pairs_are_left_for_exact_scores(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.standard_normal((4000, 64)))], "row long, embedding array<double>")
    asked = df.where("row % 20 = 0")
    share = n.candidates(df, asked, 20).count() / (200 * 3999)
    assert 20 / 3999 <= share < 0.01


@pytest.mark.parametrize("size", [1e-200, 1e150])
def test_lengths_far_from_one(spark, size):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((300, 16)) * size
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = n.candidates(df.withColumnRenamed("vec_id", "row"), df.withColumnRenamed("vec_id", "row").where("row % 20 = 0"), 20).collect()
    found = {(r.query_row, r.row) for r in got}
    want = {(q, j) for q, js in brute(np.arange(300), vectors / size, 20, 20).items() for j in js}
    assert len(want & found) >= 0.99 * len(want)


@pytest.mark.parametrize("dim", [1, 7, 64])
def test_recall_against_brute_force(spark, dim, monkeypatch):
    rng = np.random.default_rng(dim)
    ids = np.arange(700)
    vectors = (rng.standard_normal((700, dim)) * rng.uniform(0.1, 5, (700, 1))).astype(np.float32)
    df = spark.createDataFrame([(int(i), v.tolist(), 0, 0.5) for i, v in zip(ids, vectors, strict=True)], SCHEMA)
    monkeypatch.setattr(n, "ELEMENTS", 200 * dim)
    monkeypatch.setattr(n, "QUERIES", 10)
    rows = n.nearest(df).collect()
    want, got = brute(ids, vectors.astype(float), 20, 20), {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.score == pytest.approx(float(vectors[r.vec_id].astype(float) @ vectors[r.query_id].astype(float)), rel=1e-12, abs=1e-12)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.97 * 20 * len(want)


def test_table_recall(spark):
    path = "/root/testdata/sf0.01"
    pdf = spark.read.parquet(f"{path}/embeddings.parquet").toPandas()
    want = brute(pdf.vec_id.to_numpy(), np.stack(pdf.embedding).astype(float), 20, 20)
    got = n.op1_nearest(spark, path).toPandas().sort_values(["query_id", "rank"]).groupby("query_id").vec_id.apply(list).to_dict()
    assert np.mean([len(set(got[q]) & set(w)) / 20 for q, w in want.items()]) >= 0.95


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [0.0, 0.0]), (40, [0.5, 0.5]), (40, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, 0, 0.1) for i, v in rows], SCHEMA)
    got = {}
    for r in sorted(n.nearest(df).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got[0] == [(1, 1, 1.0), (2, 2, 1.0), (3, 40, 0.5), (4, 40, 0.5)]
    assert got[40] == sorted(2 * [(1, 0, 0.5), (2, 1, 0.5), (3, 2, 0.5), (4, 40, 0.5)]) and set(got) == {0, 40}
    assert n.nearest(df.limit(0)).collect() == []


def test_copies_by_the_hundred(spark):
    """A third of all rows are one vector: of its copies each query gets those with the smallest ids, and none is lost."""
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((600, 8)).round(2)
    vectors[::3] = vectors[0] * 3
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    numbered = df.withColumnRenamed("vec_id", "row").withColumn("vec_id", F.col("row"))
    assert n.without_surplus(numbered, 20).count() == 400 + 21
    got = {}
    for r in sorted(n.nearest(df).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(np.arange(600), vectors, 20, 20)
    assert got.keys() == want.keys()
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.99 * 20 * len(want)
    assert got[0] == want[0] and got[60] == want[60]  # the copies themselves
