"""NN-descent against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import nn_descent, queries

THRESHOLD = 0.95


def brute(rows, threshold=THRESHOLD):
    """(id, links, component) of each row."""
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    wide = max((len(rows[i][1]) for i in good), default=1)
    x = np.array([list(rows[i][1]) + [0.0] * (wide - len(rows[i][1])) for i in good]).reshape(len(good), wide)
    u = x / np.abs(x).max(1, keepdims=True)
    u /= np.sqrt((u**2).sum(1, keepdims=True))
    near = u @ u.T >= threshold
    np.fill_diagonal(near, True)
    names = np.array([rows[i][0] for i in good])
    comp = names.copy()
    while True:
        least = np.array([comp[n].min() for n in near]) if len(comp) else comp
        if (least == comp).all():
            break
        comp = least
    found = {i: (int(near[k].sum()) - 1, int(comp[k])) for k, i in enumerate(good)}
    return sorted((r[0], *found.get(i, (0, r[0]))) for i, r in enumerate(rows))


def vectors():
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(150)]
    for c in range(6):  # groups of copies with some noise
        centre = rng.normal(size=16)
        rows += [(1000 + 100 * c + i, (centre + rng.normal(size=16) * (0.02 + 0.04 * c)).tolist()) for i in range(3 + 8 * c)]
    base = rng.normal(size=16).tolist()
    rows += [(2000 + i, base) for i in range(5)] + [(2010, [2 * x for x in base]), (2011, [x * 1e-200 for x in base]), (2012, [x * 1e250 for x in base])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] + base[1:]), (3004, [None] + base[1:]), (3005, [float("inf")] + base[1:]), (3006, [1.0]), (3007, [1.0, 0.01])]
    return rows + [(7, base), (7, base), (5, rows[160][1])]  # ids of several vectors


def got(df):
    rows = df.collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    return sorted((r.vec_id, r.n_links, r.component_id) for r in rows)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, unit string").repartition(3)


def test_against_all_pairs(spark):
    rows = vectors()
    assert got(nn_descent.near_duplicates(frame(spark, rows).union(frame(spark, [(None, [1.0])])))) == brute(rows)


def test_dense_components(spark, monkeypatch):
    """Lists that stay full are counted by shards."""
    monkeypatch.setattr(nn_descent, "LIST", 4)
    monkeypatch.setattr(nn_descent, "WIDEST", 8)
    monkeypatch.setattr(nn_descent, "SHARD", 10)
    rows = vectors()
    assert got(nn_descent.near_duplicates(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("noise", [0.001, 0.07])
def test_count_near(spark, monkeypatch, noise):
    """All, no and some members of two shards are near each other."""
    monkeypatch.setattr(nn_descent, "SHARD", 7)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=8) + rng.normal(size=(40, 8)) * noise for _ in range(3)])
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    rows = [(int(i % 2), i, 1 + i % 3, bytearray(v.tobytes())) for i, v in enumerate(x)]
    members = spark.createDataFrame(rows, "comp long, id long, n long, unit binary")
    found = {r.id: r.near for r in nn_descent.count_near(members, THRESHOLD, rng.normal(size=(8, 4))).collect()}
    near, n = x @ x.T >= THRESHOLD, np.array([r[2] for r in rows])
    assert found == {i: int(sum(n[j] for j in range(len(x)) if near[i, j] and i % 2 == j % 2)) for i in range(len(x))}


def test_audit(spark):
    rows = vectors()[:200]
    reps = frame(spark, [r for r in rows if r[1]]).select(F.col("vec_id").alias("id"), F.lit(1).cast("long").alias("n"), F.col("embedding").alias("vec"))
    reps = reps.mapInArrow(lambda it: nn_descent._units(16, it), "id long, n long, unit binary, code binary").cache()
    want = {i: links + 1 for i, links, _ in brute(rows)}
    full = spark.createDataFrame(list(want.items()), "id long, near long")
    assert nn_descent.audit(reps, full, THRESHOLD) == 1.0
    half = full.withColumn("near", 1 + F.floor((F.col("near") - 1) / 2))
    assert 0.3 < nn_descent.audit(reps, half, THRESHOLD) < 0.6
    assert nn_descent.audit(reps, full.where("false"), THRESHOLD) == 0.0


def test_no_rows(spark):
    assert got(nn_descent.near_duplicates(frame(spark, []))) == []
    rows = [(1, None), (2, [0.0, 0.0]), (2, None)]
    assert got(nn_descent.near_duplicates(frame(spark, rows))) == brute(rows)
    rows = [(3, [1.0, 2.0])]
    assert got(nn_descent.near_duplicates(frame(spark, rows))) == brute(rows)


def test_query(spark, tmp_path):
    rows = vectors()[:230]
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert got(queries.op12_nn_descent(spark, str(tmp_path))) == brute(rows)
