"""Hard negatives against a look at every pair, with small blocks, odd vectors and ties."""

import numpy as np
import pytest

from assay.llm import hard_negatives as hn
from pyspark.sql import functions as F

ROWS = "vec_id long, embedding array<double>, label int, score string"


def brute(rows, every, scale, positives=5, negatives=5):
    best = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        own = (label, [int(np.floor(x * scale)) for x in v])
        best[i] = min(best.get(i, own), own)
    top = 2**63 - 1
    out = set()
    for a, (label, u) in best.items():
        if a % every:
            continue
        scored = []
        for c, (other, v) in best.items():
            if c != a and len(v) == len(u):
                scored.append((-max(-top, min(top, sum(p * q for p, q in zip(u, v, strict=True)))), c, other))
        scored.sort()
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [(n, m) for n, m, other in scored if other != label and -80 * s <= -100 * n <= -100 * s]
            out |= {(a, p, k + 1, m, -s, -n) for k, (n, m) in enumerate(fit[:negatives])}
    return out


def mined(spark, rows, every, scale=256, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], ROWS)
    out = hn.mine_hard_negatives(df, F.col("vec_id") % every == 0, scale=scale, **more).collect()
    got = {(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in out}
    assert len(got) == len(out)
    return got


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, dim))
    return [(i, [float(x) for x in middle[i % 6] + 0.3 * rng.normal(size=dim)], int(rng.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("block, group", [(8192, 4096), (37, 5)])
def test_equal_to_all_pairs(spark, block, group):
    rows = clustered(500, 8, 1) + [(1000 + i, [0.5] * 8, i % 2) for i in range(200)]
    want = brute(rows, 10, 256)
    assert len(want) > 300
    assert mined(spark, rows, 10, block=block, group=group) == want


def test_odd_vectors(spark):
    rows = clustered(120, 4, 2)
    rows += [(200, None, 1), (210, [1.0, None], 1), (220, [float("nan")] * 4, 0), (None, [1.0] * 4, 0), (230, [1.0] * 4, None)]
    rows += [(300 + i, [], i % 2) for i in range(12)] + [(400 + i, [0.0] * 4, i % 3) for i in range(9)]
    rows += [(500 + i, [-1.0 - i, 2.0], i % 2) for i in range(8)] + [(rows[5][0], rows[5][1], rows[5][2])] * 3
    rows += [(600, [9e7, 1e8, 1e7, -1e8], 1), (601, [9e7, 1e8, 1e7, -1e8], 0), (610, [1e7, 1e8, 1e7, -1e8], 1), (620, [1e300, 1.0, 0.0, 0.0], 1)]
    want = brute(rows, 10, 256)
    assert mined(spark, rows, 10, block=16, group=3) == want
    assert mined(spark, rows[:0], 10) == set()
    assert mined(spark, [(1, [1.0], 1)], 10) == set()


def test_the_walk_ends_before_its_list():
    """Far clusters aren't evaluated: the list is walked up to the first bound below the k-th best."""
    rng = np.random.default_rng(4)
    near = np.floor(256 * (np.array([1.0, 0, 0, 0]) + 0.02 * rng.normal(size=(400, 4))))
    far = np.floor(256 * (np.array([0, 1.0, 0, 0]) + 0.02 * rng.normal(size=(4000, 4))))
    x, a = np.concatenate([near, far]), near[:20]
    ids, labels = np.arange(len(x)), np.zeros(len(x), dtype=int)
    import pandas as pd

    asked = pd.DataFrame({"member": range(20), "low": -hn.LONG, "high": hn.LONG})
    requests = hn.Requests(asked, 5, True, np.arange(20), np.zeros(20, dtype=int))
    evaluated = hn.walk(requests, a, x, ids, labels, np.array([1.0, 0, 0, 0]))
    assert evaluated < 20 * 1000
    request, score, vec_id = requests.hits
    for m in range(20):
        s = x @ a[m]
        order = [i for i in np.lexsort((ids, -s)) if i != m][:5]
        assert list(vec_id[request == m]) == order
