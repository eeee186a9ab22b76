"""Vector bin packing against a plain greedy, and its laws on odd rows."""

import zlib
from collections import Counter, defaultdict

import numpy as np

from assay.llm import sharding

DOCS = "doc_id long, text string, shard string"


def greedy(texts: list[str], shards: int) -> dict[str, int]:
    """Shard per distinct text, by the rule as it is written, over lists of numbers."""
    groups = defaultdict(lambda: [0, 0, 0])
    for t in texts:
        g = groups[t]
        g[0] += len(t.encode()) + 16
        g[1] += len(t.split())
        g[2] += 1
    total = [max(1, sum(g[i] for g in groups.values())) for i in range(3)]
    unit = {t: [g[i] * (shards / total[i]) for i in range(3)] for t, g in groups.items()}
    import hashlib

    order = sorted(unit, key=lambda t: (-max(unit[t]), hashlib.md5(t.encode()).digest()))
    left = [[1.0] * 3 for _ in range(shards)]
    out = {}
    for t in order:
        v = unit[t]
        room = [s for s in range(shards) if all(a >= b - 1e-12 for a, b in zip(left[s], v, strict=True))]
        if room:
            best = max(room, key=lambda s: (round(sum(a * b for a, b in zip(left[s], v, strict=True)), 15), -s))
        else:
            best = min(range(shards), key=lambda s: (max(b - a for a, b in zip(left[s], v, strict=True)), s))
        left[best] = [a - b for a, b in zip(left[best], v, strict=True)]
        out[t] = best
    return out


def check_rows(rows, texts):
    """Sizes, digests, and gapless slots; the rows per shard."""
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    return by


def test_equal_to_a_plain_greedy(spark):
    rng = np.random.default_rng(5)
    # Lengths far apart, so that no order hangs on the last bit of a sum.
    texts = [(i, " ".join(["wé" * int(rng.integers(1, 9))] * int(rng.integers(1, 400)))) for i in range(150)]
    texts += [(200 + i, texts[i][1]) for i in range(0, 40, 4)]
    rows = sharding.pack_shards(spark.createDataFrame([(i, t, "x") for i, t in texts], DOCS), shards=4).collect()
    check_rows(rows, texts)
    by_text = defaultdict(set)
    at = dict(texts)
    for r in rows:
        by_text[at[r.doc_id]].add(r.shard)
    assert {t: {s} for t, s in greedy([t for _, t in texts], 4).items()} == by_text


def test_a_third_of_all_rows_and_parts_of_small_groups(spark):
    rng = np.random.default_rng(6)
    texts = [(i, "copy") for i in range(1000)]
    texts += [(1000 + i, "x" * int(rng.integers(0, 500)) + f" {i}") for i in range(2000)] * 2
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], DOCS)
    rows = sharding.pack_shards(df, shards=8, large=0.05, part=700, bucket=10).collect()
    by = check_rows(rows, texts)
    assert max(map(len, by.values())) / (len(texts) / 8) < 1.03
    size = defaultdict(int)
    where = defaultdict(set)
    at = dict(texts)
    for r in rows:
        size[r.shard] += r.size
        where[at[r.doc_id]].add(r.shard)
    assert max(size.values()) / (sum(size.values()) / 8) < 1.03
    assert len(where["copy"]) == 8
    assert all(len(v) == 1 for t, v in where.items() if t != "copy")


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (2, ""), (None, "a"), (None, "a"), (3, "long " * 50_000)] + [(9, "same row")] * 40
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], DOCS)
    rows = sharding.pack_shards(df, shards=3).collect()
    by = check_rows(rows, texts)
    assert len(by) == 3
    assert len({r.shard for r in rows if r.doc_id in (1, 2)}) == 1
    # One row repeated forty times is more than a shard's share of rows, and is cut.
    assert len({r.shard for r in rows if r.doc_id == 9}) > 1
    assert sharding.pack_shards(df.limit(0)).count() == 0
