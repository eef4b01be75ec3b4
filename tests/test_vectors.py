"""Moments of vectors against NumPy: large means, masks, hot keys, states cut anywhere."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import intervals, pooling, vectors


@pytest.mark.parametrize("held", [16_384, 2])
def test_moments(spark, monkeypatch, held):
    monkeypatch.setattr(vectors, "HELD_STATES", held)
    rng = np.random.default_rng(1)
    rows = [(None if i % 17 == 0 else "hot" if i % 2 else f"k{i % 5}", i % 3 if i % 7 else None, (1e9 + rng.normal(size=4) * 1e-3).tolist(), float(rng.integers(0, 4)), i) for i in range(3000)]
    rows += [("masked", 0, None, 0.0, 1), ("masked", 0, [float("nan")] * 4, 0.0, 2), ("mixed", 0, None, 0.0, 3), ("mixed", 0, [1.0, 2.0, 3.0, 4.0], 2.0, 4)]
    df = spark.createDataFrame(rows, "k string, j int, x array<double>, w double, i long").repartition(7)
    got = {(r["k"], r["j"]): r for r in vectors.vector_moments(df, ["k", "j"], "x", "w", ("i",)).collect()}
    by = {}
    for k, j, x, w, i in rows:
        by.setdefault((k, j), []).append((x, w, i))
    assert set(got) == set(by)
    for key, own in by.items():
        r, some = got[key], [(x, w) for x, w, _ in own if w]
        assert r["weight"] == sum(w for _, w, _ in own) and r["i"] == sum(i for *_, i in own)
        if some:
            x, w = np.array([x for x, _ in some]), np.array([w for _, w in some])
            shifted = x - x[0]
            mean = (w[:, None] * shifted).sum(0) / w.sum()
            assert np.allclose(np.array(r["mean"]) - x[0], mean, atol=2e-7) and np.allclose(r["m2"], (w[:, None] * (shifted - mean) ** 2).sum(0), rtol=1e-3, atol=1e-9)
        else:
            assert not any(r["mean"])
    one = vectors.vector_moments(df.where("w > 0"), [], "x", "w").collect()
    assert len(one) == 1 and one[0]["weight"] == sum(r[3] for r in rows)
    assert vectors.vector_moments(df.limit(0), ["k"], "x", "w").collect() == []


def test_lists_and_lengths(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], 1.0, 5), ("a", [3.0, 4.0], 3.0, 6), ("b", [7.0, 7.0], 1.0, None)], "k string, x array<double>, w double, i int")
    got = {r["k"]: r for r in vectors.vector_moments(df, ["k"], "x", "w", (), ("i",)).collect()}
    assert sorted(got["a"]["i"]) == [5, 6] and got["b"]["i"] == [None] and got["a"]["mean"] == [2.5, 3.5] and got["a"]["m2"] == [3.0, 3.0]
    with pytest.raises(Exception, match="one length"):
        vectors.vector_moments(df.union(df.withColumn("x", F.array(F.lit(1.0)))), ["k"], "x", "w").collect()


def test_pool_against_plain_sums(spark):
    """Vectors, overlapping observations and long targets over several buckets."""
    rng = np.random.default_rng(2)
    obs = [("x", i, int(a), int(a + rng.integers(1, 40)), (1e7 + rng.normal(size=3)).tolist(), float(rng.integers(0, 3)) / 2) for i, a in enumerate(rng.integers(0, 300, 80))]
    targets = [("x", 0, 0, 350), ("x", 1, 20, 25), ("x", 2, 100, 100), ("x", 3, 900, 950), ("x", 4, -50, 60)]
    t = spark.createDataFrame(targets, "k string, pos int, s long, e long")
    o = spark.createDataFrame(obs, "k string, src_idx int, a long, b long, features array<double>, q double")
    df = pooling.interval_pool(t, o, ["k"], ["pos"], bucket=50)
    got = {r["pos"]: r for r in df.collect()}
    for _, pos, s, e in targets:
        own = [(i, min(e, b) - max(s, a), x, q, max(s, a), min(e, b)) for _, i, a, b, x, q in obs if q > 0 and min(e, b) > max(s, a) and e > s]
        r = got[pos]
        assert r["mask"] == bool(own)
        assert abs(r["coverage"] - (len({p for *_, a, b in own for p in range(a, b)}) / (e - s) if e > s else 0)) < 1e-12
        if own:
            w = np.array([v * q for _, v, _, q, *_ in own])
            x = np.array([v[2] for v in own])
            mean = (w[:, None] * (x - 1e7)).sum(0) / w.sum()
            assert np.allclose(np.array(r["mean"]) - 1e7, mean, atol=1e-7) and np.allclose(r["std"], np.sqrt((w[:, None] * (x - 1e7 - mean) ** 2).sum(0) / w.sum()), atol=1e-7)
            assert [p["src"] for p in r["provenance"]] == sorted(v[0] for v in own) and abs(sum(p["weight"] for p in r["provenance"]) - 1) < 1e-12
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(bucket_#") <= 2 and "posexplode" not in plan
    assert intervals.position_coverage(t, o.where("q > 0").select("k", "a", "b"), ["k"], ["pos"], 50).where("pos = 0").first()["coverage"] == got[0]["coverage"]
