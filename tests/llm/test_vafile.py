"""The clustering against plain numpy, and its bounds against distances."""

import hashlib

import numpy as np
import pytest

from scholia.llm import vafile

INF, NAN = float("inf"), float("nan")


def brute(rows, clusters, rounds, dims):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    v = np.array([x for _, x in kept], object).reshape(len(kept), -1)
    h = [hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest() for i, _ in kept]
    c = np.array([v[k] for k in sorted(range(len(kept)), key=lambda k: (h[k], list(v[k])))[:clusters]], object)
    near = lambda: [min((sum((v[i] - x) ** 2), k) for k, x in enumerate(c)) for i in range(len(v))]
    for _ in range(rounds):
        at = np.array([k for _, k in near()])
        c = np.array([[int(sum(col)) // len(col) for col in v[at == k].T] if (at == k).any() else c[k] for k in range(len(c))], object)
    return sorted(((i is None, i or 0), k, d) for (i, _), (d, k) in zip(kept, near())), c


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, v string")
    got = vafile.cluster(df, **kw).collect()
    return sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["cluster"], r["distance"]) for r in got), got


def f32(x):
    return [float(y) for y in np.asarray(x, np.float32)]


@pytest.mark.parametrize("bits", [1, 4, 6])
def test_clusters_equal_brute_force(spark, bits):
    rnd = np.random.default_rng(bits)
    middle = rnd.normal(size=(5, 6)) * 0.3
    rows = [(i, f32(middle[i % 5] + rnd.normal(size=6) * rnd.choice([0.01, 0.2]))) for i in range(300)]
    rows += [(400 + i, rows[i][1]) for i in range(40)] + [(7, rows[7][1]), (None, rows[8][1]), (500, [0.0] * 6)]  # ties and repeated rows
    got, told = run(spark, rows, dimensions=6, clusters=7, rounds=4, bits=bits)
    want, c = brute(rows, 7, 4, 6)
    assert got == want
    by = {}
    for _, k, d in want:
        by[k] = by.get(k, 0) + d
    assert {(r["cluster"], r["cluster_inertia"], r["inertia"], tuple(r["centroid"])) for r in told} == {(k, n, sum(by.values()), tuple(map(int, c[k]))) for k, n in by.items()}


def test_vectors_that_are_not_kept_and_tiny_tables(spark):
    rows = [(1, f32([1, 2])), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [NAN, 1.0]), (6, [1.0, INF]), (7, [-INF, 0.0]), (8, []), (9, [1.0, 2.0, 3.0]), (10, f32([-0.0001, 0.0]))]
    got, _ = run(spark, rows, dimensions=2, clusters=8, rounds=3)
    assert got == brute(rows, 8, 3, 2)[0] and len(got) == 2
    assert run(spark, [(1, None)], dimensions=2)[0] == [] and run(spark, [], dimensions=2)[0] == []
    same = [(k, [0.5, 0.25]) for k in range(20)]  # all vectors equal: all in the first cluster, the others stay empty
    got, _ = run(spark, same, dimensions=2, clusters=3, rounds=3)
    assert {(k, d) for _, k, d in got} == {(0, 0)} and len(got) == 20


def test_great_components_are_exact_and_greater_ones_an_error(spark):
    rows = [(k, f32([(-1) ** k * 131_000 + k, k * 1_000])) for k in range(40)]
    assert run(spark, rows, dimensions=2, clusters=4, rounds=5)[0] == brute(rows, 4, 5, 2)[0]
    with pytest.raises(Exception, match="beyond"):
        run(spark, [(1, [1e9, 0.0])], dimensions=2)


def test_bounds_hold_and_close_most_rows(spark):
    rnd = np.random.default_rng(3)
    c = rnd.normal(size=(6, 16)) * 300
    m = np.floor(c[rnd.integers(0, 6, 3_000)] + rnd.normal(size=(3_000, 16)) * 60).astype(np.int64)
    c = np.floor(c).astype(np.int64)
    share = [k / 63 for k in range(1, 64)]
    edges = np.stack([np.array([x.min(), *np.floor(np.quantile(x, share)), x.max() + 1], np.int64) for x in m.T])
    packed = vafile.approximate(m, edges, 6)
    assert packed.shape == (3_000, 12)
    cells = vafile.unpack(packed, 16, 6).astype(int)
    j = np.arange(16)
    assert ((edges[j, cells] <= m) & (m < edges[j, cells + 1])).all()
    open_ = vafile.Bounds(edges, c, 6).candidates(packed)
    d = ((m[:, None] - c[None]) ** 2).sum(2)
    assert open_[np.arange(len(m)), d.argmin(1)].all()  # the nearest is never lost
    assert (open_.sum(1) > 1).mean() < 0.05


def test_only_open_and_moved_rows_are_fetched(spark):
    rnd = np.random.default_rng(9)
    middle = rnd.normal(size=(4, 16))
    df = spark.createDataFrame([(k, f32(middle[k % 4] + rnd.normal(size=16) * 0.02)) for k in range(800)], "vec_id long, embedding array<float>")
    told = vafile.Clustering(df, dimensions=16, clusters=4)
    told.run(10).count()
    assert told.fetched and all(asked < scanned / 2 for scanned, asked in told.fetched[1:])
    # fetching shuffles the row numbers, not the vectors
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.range(10).selectExpr("id AS row", "0 AS before")
        plan = told._fetch(asked)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    told.close()
