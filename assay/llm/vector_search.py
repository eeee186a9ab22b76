"""Exact top-k inner products by pivot-table elimination.

Every vector keeps its distances to many pivots. For a query q and a candidate x the triangle
inequality gives |q - x| >= max over pivots |d(q, p) - d(x, p)|, so the inner product is at most
(|q|^2 + |x|^2 - bound^2) / 2. Candidates are evaluated in the order of that bound, and a query
stops when the next bound is below its k-th best score. The stop is strict, so ties are seen.

Queries and candidates are packed in blocks; every query block meets every candidate block once,
in a task of its own, and the few survivors of each meeting are ranked by Spark. Pivots come from
a bounded sample (`SAMPLE` rows of smallest id hash) and only steer the order: results are exact
for any pivots.

Edge cases: vectors that are null or hold a null or non-finite component, and rows without an id,
take no part. Vectors of different length are never compared; empty ones score 0. Equal scores go by the smaller id.
Repeated rows count once; an id with several vectors keeps the smallest in array order. A query
with fewer candidates than k gets all of them. Scores beyond the range of a long are clipped to
it. Other columns are ignored. An empty table gives no rows.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 4096
PIVOTS = 24
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 16384
#: Candidates that a query evaluates before its first stop test; the steps then double.
FIRST = 128
HITS = "query_id long, vec_id long, score long"
#: Sums of products below these are exact in a double, and in a single.
EXACT, EXACT_SINGLE = 2.0**53, 2.0**24


def integer_vectors(df: DataFrame, vec_id: str, vec: str, scale: int) -> DataFrame:
    """vec_id and floor(scale * x) of every component x of the vectors that take part."""
    x = F.transform(vec, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = F.transform(x, lambda v: F.floor(v * scale).cast("double"))
    return (
        df.filter(F.col(vec_id).isNotNull() & F.col(vec).isNotNull() & finite)
        .select(F.col(vec_id).cast("long").alias("vec_id"), scaled.alias("vec"))
        .groupBy("vec_id")
        .agg(F.min("vec").alias("vec"))
        .withColumn("dim", F.size("vec"))
    )


def choose_pivots(vectors: DataFrame, n: int = PIVOTS) -> dict[int, np.ndarray]:
    """Per length, vectors of the sample far from one another (farthest first)."""
    sample = vectors.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).collect()
    pivots = {}
    for dim in {r.dim for r in sample}:
        own = [r.vec for r in sample if r.dim == dim]
        x = np.array(own, dtype=np.float64).reshape(len(own), dim)
        chosen, gap = [0], np.full(len(x), np.inf)
        while len(chosen) < min(n, len(x)):
            gap = np.minimum(gap, np.linalg.norm(x - x[chosen[-1]], axis=1))
            chosen.append(int(gap.argmax()))
        pivots[dim] = x[chosen]
    return pivots


def _pack(pivots: dict[int, np.ndarray]):
    """A block of vectors as three arrays: ids, components, distances to the pivots."""

    def pack(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        dim = int(key[0])
        vecs = np.array(x["vec"].to_list(), dtype=np.float64).reshape(len(x), dim)
        p = pivots.get(dim, np.zeros((0, dim)))
        with np.errstate(over="ignore", invalid="ignore"):
            far = np.array([np.linalg.norm(vecs - q, axis=1) for q in p]).reshape(len(p), len(x))
        small = not vecs.size or np.abs(vecs).max() < 2**15
        return pd.DataFrame(
            {
                "dim": [key[0]],
                "block": [key[1]],
                "ids": [x["vec_id"].to_numpy(np.int64).tobytes()],
                "kind": ["i2" if small else "f8"],
                "vecs": [vecs.astype("i2" if small else "f8").tobytes()],
                "far": [far.tobytes()],
            }
        )

    return pack


PACKED = "dim int, block int, ids binary, kind string, vecs binary, far binary"


def _blocks(vectors: DataFrame, sizes: dict[int, int], pivots: dict[int, np.ndarray]) -> DataFrame:
    per_dim = F.create_map(*(F.lit(v) for kv in sizes.items() for v in kv))
    block = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.get(F.array(per_dim[F.col("dim")]), F.lit(0)))
    return vectors.withColumn("block", block.cast("int")).groupBy("dim", "block").applyInPandas(_pack(pivots), PACKED)


def _unpack(x: pd.DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row = x.iloc[0]
    ids = np.frombuffer(row["ids"], np.int64)
    vecs = np.frombuffer(row["vecs"], row["kind"]).reshape(len(ids), dim).astype(np.float64)
    far = np.frombuffer(row["far"], np.float64).reshape(-1, len(ids)) if len(row["far"]) else np.zeros((0, len(ids)))
    return ids, vecs, far


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _all_scores(vecs: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact for components of any size."""
    whole = [[int(v) for v in row] for row in vecs]
    other = [int(v) for v in q]
    low, high = -(2**63) + 1, 2**63 - 1
    sums = [min(high, max(low, sum(a * b for a, b in zip(row, other, strict=True)))) for row in whole]
    return np.array(sums, dtype=np.int64)


def _meet(k: int):
    """The k best of one candidate block for every query of one query block."""

    def meet(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(q) and len(c):
            dim = int(key[0])
            q_ids, q_vecs, q_far = _unpack(q, dim)
            ids, vecs, far = _unpack(c, dim)
            top = max(np.abs(q_vecs).max(initial=0), np.abs(vecs).max(initial=0))
            largest = top * top * max(dim, 1)
            if largest < EXACT_SINGLE:
                q_vecs, vecs = q_vecs.astype(np.float32), vecs.astype(np.float32)
            block = _Block(ids, vecs, far) if largest < EXACT else None
            for i, own in enumerate(q_ids):
                if block is not None:
                    hits, scores = block.search(own, q_vecs[i], q_far[:, i], k)
                else:
                    hits = np.flatnonzero(ids != own)
                    scores = _all_scores(vecs[hits], q_vecs[i])
                keep = _best(ids[hits], scores, k)
                out.append(
                    pd.DataFrame(
                        {
                            "query_id": own,
                            "vec_id": ids[hits[keep]],
                            "score": scores[keep].astype(np.int64),
                        }
                    )
                )
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in HITS.split(", ")})

    return meet


class _Block:
    """Candidates with their pivot table, and room for the bounds of one query at a time."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, far: np.ndarray) -> None:
        self.ids, self.vecs, self.far = ids, vecs, far
        self.norms = (vecs.astype(np.float64) ** 2).sum(axis=1)
        self.reach = far.max(axis=0, initial=0.0)
        self.gap, self.most = np.empty((2, len(ids)), dtype=far.dtype)

    def bounds(self, own: int, q: np.ndarray, q_far: np.ndarray) -> np.ndarray:
        """No candidate's score is above its bound; the query's own row is out of reach."""
        self.most[:] = 0
        for distances, d in zip(self.far, q_far, strict=True):
            np.subtract(distances, d, out=self.gap)
            np.abs(self.gap, out=self.gap)
            np.maximum(self.most, self.gap, out=self.most)
        size = self.norms + float(np.dot(q.astype(np.float64), q))
        # Distances are rounded by less than this share of their size, however far a pivot lies off.
        self.most -= 1e-12 * (self.reach + q_far.max(initial=0.0))
        np.maximum(self.most, 0, out=self.most)
        bound = (size - self.most**2) / 2 + 1e-9 * size + 1e-6
        bound[self.ids == own] = -np.inf
        return bound

    def search(self, own: int, q: np.ndarray, q_far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Evaluated candidates and their scores; none left out can be among the k best."""
        bound = self.bounds(own, q, q_far)
        left = np.flatnonzero(bound > -np.inf)
        hits, scores, least, step = [], [], -np.inf, FIRST
        while len(left):
            if 2 * step >= len(left):
                # The rest of the order fits in one step: no need to sort it.
                now, left = left, left[:0]
            else:
                near = np.argpartition(-bound[left], step - 1)
                now, left = left[near[:step]], left[near[step:]]
            # Copying most of the block would cost more than the products it saves.
            found = (self.vecs @ q)[now] if 4 * len(now) > len(bound) else self.vecs[now] @ q
            hits.append(now)
            scores.append(found)
            seen = np.concatenate(scores)
            if len(seen) >= k:
                least = np.partition(seen, len(seen) - k)[len(seen) - k]
                left = left[bound[left] >= least]
            step *= 4
        none = np.zeros(0, dtype=np.int64)
        return (np.concatenate(hits), np.concatenate(scores)) if hits else (none, none.astype(float))


def top_k(
    df: DataFrame,
    is_query: Column,
    k: int = 20,
    vec_id: str = "vec_id",
    vec: str = "embedding",
    scale: int = 64,
    pivots: int = PIVOTS,
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of every query row.

    is_query: a condition on `vec_id` that says which rows ask; all rows but its own answer.
    """
    vectors = integer_vectors(df, vec_id, vec, scale)
    asked = F.coalesce(is_query, F.lit(False))
    counts = vectors.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(asked).alias("q")).collect()
    spark = df.sparkSession
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    far = choose_pivots(vectors, pivots)
    c_sizes = {r.dim: -(-r.n // candidate_block) for r in counts}
    q_sizes = {r.dim: max(1, -(-r.q // query_block)) for r in counts}
    candidates = _blocks(vectors, c_sizes, far)
    asking = _blocks(vectors.filter(asked), q_sizes, far)

    def with_all(blocks: DataFrame, sizes: dict[int, int], own: str, other: str) -> DataFrame:
        """A copy of every block for each block of the other side."""
        n = F.create_map(*(F.lit(v) for kv in sizes.items() for v in kv))[F.col("dim")]
        return blocks.withColumnRenamed("block", own).withColumn(other, F.explode(F.sequence(F.lit(0), n - 1)))

    left = with_all(asking, c_sizes, "qb", "cb").groupBy("dim", "qb", "cb")
    right = with_all(candidates, q_sizes, "cb", "qb").groupBy("dim", "qb", "cb")
    hits = left.cogroup(right).applyInPandas(_meet(k), HITS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
