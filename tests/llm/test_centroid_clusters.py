import hashlib
import math
import random

import pytest

from chainlens.llm.centroid_clusters import centroid_clusters

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, x string, distance string, id string"


def frame(spark, data):
    return spark.createDataFrame([(i, v, 0, "c", "x", "d", "i") for i, v in data], SCHEMA).repartition(4)


def brute(data, dims, k, rounds):
    f32 = lambda x: __import__("numpy").float32(x).item()
    kept = []
    for i, v in data:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * f32(x)) for x in v]))
    name = lambda i: hashlib.sha256(f"2:{'null' if i is None else i}".encode()).hexdigest()
    cents = [x for _, x in sorted((name(i), x) for i, x in kept)[:k]]

    def near(x):
        return min((sum((p - q) ** 2 for p, q in zip(x, c)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(near(x)[1], []).append(x)
        for n, xs in groups.items():
            cents[n] = [sum(col) // len(xs) for col in zip(*xs)]
    got = [(i, *near(x)) for i, x in kept]
    total, by = sum(d for _, d, _ in got), {}
    for _, d, c in got:
        by[c] = by.get(c, 0) + d
    return sorted((str(i), c, d, by[c], total, hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest())
                  for i, d, c in got)


def rows(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)
                  for r in df.collect())


def data(n=90, dims=6, seed=4):
    rng = random.Random(seed)
    out = [(100 - i, [rng.gauss(i % 3, 0.4) for _ in range(dims)]) for i in range(n)]
    out += [out[0], out[0], (None, out[1][1]), (None, out[2][1])]  # repeated rows, NULL ids
    out += [(900 + i, [0.25] * dims) for i in range(n // 2)]  # a third of the rows are one vector
    out += [(801, None), (802, []), (803, [0.1] * (dims - 1)), (804, [0.1] * (dims + 1)),
            (805, [None] + [0.1] * (dims - 1)), (806, [float("nan")] + [0.1] * (dims - 1)),
            (807, [float("inf")] + [0.1] * (dims - 1)), (808, [float("-inf")] * dims), (809, [-0.001] * dims)]
    return out


@pytest.mark.parametrize("k, rounds", [(8, 5), (1, 2), (500, 1), (12, 0)])
def test_brute_force(spark, k, rounds):
    d = data()
    got = rows(centroid_clusters(frame(spark, d), dims=6, k=k, rounds=rounds))
    assert got == brute(d, 6, k, rounds)
    assert not {"801", "802", "803", "804", "805", "806", "807", "808"} & {r[0] for r in got}


def test_reruns_on_other_partitions(spark):
    d = data(seed=9)
    a = rows(centroid_clusters(frame(spark, d), dims=6, k=7))
    assert a == rows(centroid_clusters(frame(spark, d).coalesce(1), dims=6, k=7))


def test_empty_clusters_keep_their_centroids(spark):
    # equal vectors start several centroids; ties go to the smallest number, the others stay empty
    got = rows(centroid_clusters(frame(spark, [(i, [0.5] * 4) for i in range(20)]), dims=4, k=5))
    assert {r[1:5] for r in got} == {(0, 0, 0, 0)} and len(got) == 20


def test_nothing_kept(spark):
    out = centroid_clusters(frame(spark, [(1, None), (2, [1.0])]), dims=4)
    assert out.count() == 0
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        centroid_clusters(frame(spark, [(1, [1e20] * 4), (2, [0.0] * 4)]), dims=4, k=1).collect()


def test_stays_in_the_jvm(spark):
    from chainlens.llm.centroid_clusters import integer_vectors, nearest

    kept = integer_vectors(frame(spark, data()), "vec_id", "embedding", 6, 256.0)
    plan = kept.select(nearest([[0] * 6, [9] * 6]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "zip_with" in plan
