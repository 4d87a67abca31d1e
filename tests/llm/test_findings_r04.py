"""What the fourth round's findings asked for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake.llm import topk


def best(v, q, k):
    s = v @ v[q]
    return [(r + 1, int(i), int(s[i])) for r, i in enumerate([i for i in np.lexsort((np.arange(len(v)), -s)) if i != q][:k])]


def test_top_k_broadcasts_no_vectors(spark):
    """Vectors without clusters, so that all queries meet all blocks. The limit of a broadcast leaves room for a row a pivot,
    but neither for blocks nor for queries."""
    v = np.floor(1024 * np.random.default_rng(8).normal(size=(2000, 32)) / 6).astype(np.int64)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<long>")
    limit = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "2m")
    try:
        rows = topk.top_k(table, F.col("vec_id") % 4 == 0, k=5, block=20, query_block=64).collect()
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", limit)
    got = {}
    for r in sorted(rows):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got == {q: best(v, q, 5) for q in range(0, 2000, 4)}


@pytest.mark.parametrize("scale", [1, 2**14, 2**21])  # single precision, double precision, whole numbers
@pytest.mark.parametrize("spread", [0.02, 1.0])  # clusters that bounds drop, and none
def test_queries_find_the_best_of_all_blocks(scale, spread):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(40, 5))[rng.integers(40, size=3000)] + spread * rng.normal(size=(3000, 5))) * 100
    v = np.floor(x).astype(np.int64) * scale
    v[1000:1300] = v[7]
    asked, k = np.arange(0, 3000, 10), 4
    q = topk.Queries(asked, v[asked], k, np.full(len(asked), np.iinfo(np.int64).min))
    for part in np.array_split(rng.permutation(3000), 3):
        q.meet(topk.Points(part, v[part]))
    ids, who, scores = (x.reshape(-1, k) for x in q.found())
    assert ids[:, 0].tolist() == asked.tolist()
    for i, one in enumerate(asked.tolist()):
        assert [(r + 1, *x) for r, x in enumerate(zip(who[i].tolist(), scores[i].tolist(), strict=True))] == best(v, one, k)
