import numpy as np
import pytest
from pyspark.sql import functions as F

from rowgrove.llm import collision_search as c


def exact(vectors, ids, asked, k):
    out = {}
    for q in asked:
        x = vectors[ids.index(q)].astype(np.float64)
        near = sorted((float(np.sqrt(((v.astype(np.float64) - x) ** 2).sum())), i) for v, i in zip(vectors, ids, strict=True) if i != q)
        out[q] = near[:k]
    return out


def rows_of(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("kind", ["uniform", "clusters", "copies", "scaled"])
@pytest.mark.parametrize("blocks", [200, 100_000])
def test_recall_against_brute_force(spark, kind, blocks):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    if kind == "clusters":
        x = (rng.normal(size=(15, 24))[rng.integers(0, 15, 1500)] + 0.1 * x).astype(np.float32)
    if kind == "copies":
        x[:500] = x[0]
    if kind == "scaled":
        x *= np.float32(1000) ** rng.uniform(-1, 1, (1500, 1)).astype(np.float32)
    ids = list(range(1500))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got = rows_of(c.nearest(df, F.col("vec_id") % 50 == 0, block_rows=blocks, query_rows=20))
    want = exact(x, ids, ids[::50], 10)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want]) >= 0.95
    assert all(s == pytest.approx(dict((i, s) for s, i in exact(x, ids, [q], 1500)[q])[i], rel=1e-12) for q in list(want)[:3] for s, i in got[q])


def test_fixture_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = [np.array(r.embedding, np.float32) for r in rows], [r.vec_id for r in rows]
    got, want = rows_of(c.op7_collision_search(spark, sf_dir)), exact(x, ids, ids[::100], 10)
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want]) >= 0.9


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0]), (9, [1.0, 0.1]), (100, [0.0, 0.0]), (200, [2.0]), (1, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("score", F.lit("clash"))
    got = {k: [i for _, i in v] for k, v in rows_of(c.nearest(df, F.col("vec_id") % 100 == 0)).items()}
    assert got == {0: [1, 9], 200: [8]}
    assert c.nearest(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_alone_or_among_copies(spark):
    df = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(30)], "vec_id long, embedding array<double>")
    assert rows_of(c.nearest(df, F.col("vec_id") == 29))[29] == [(0.0, i) for i in range(10)]
    assert c.nearest(df.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0


def test_one_id_has_one_vector(spark):
    """Of rows with one id the smallest vector counts, wherever the rows lie."""
    rows = [(0, [0.0, 0.1]), (0, [5.0, 5.0]), (1, [1.0, 1.0]), (1, [0.5, 9.0]), (1, [0.5, 9.0]), (2, [3.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0])]
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
        got = [(r.query_id, r["rank"], r.vec_id) for r in c.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()]
        assert got == [(0, 1, 3), (0, 2, 1)]
