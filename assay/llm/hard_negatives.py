"""Hard negatives by exact search over lists that a cluster of anchors shares.

Vectors are clustered by angle around a few centroids. For a cluster of anchors whose members lie
within an angle t of its centroid, a candidate x at angle s of that centroid has an inner product of
at most |a| |x| cos(max(0, s - t)) with any member a. A block of candidates is sorted by that bound
(without |a|) once; every member walks the list and stops where the next bound, times |a|, is below
what it still needs: its k-th best so far, or the least score that it accepts. The stop is strict,
so ties are seen.

Three walks, each with one shuffle of the candidates:

1. positives: members meet the candidates of their own cluster, of their own label;
2. members meet those clusters of candidates whose bound can still beat their k-th best;
3. negatives: every positive asks for scores from `floor_percent` percent of its own score up to it,
   of other labels; clusters whose bound is below the least of these aren't met.

Clusters are few (`CLUSTERS` at most), so which meet which is decided on the driver; centroids come
from a bounded sample (`SAMPLE` rows of smallest id hash) and only steer the order: results are exact
for any centroids. Candidates of a cluster are dealt by hash into blocks and anchors into groups, so
a very common vector or label is many tasks' work.

Edge cases: rows without id or label, and vectors that are null or hold a null or non-finite
component take no part. Vectors of different length are never compared; empty ones score 0. Equal
scores go by the smaller id. Repeated rows count once; an id with several rows keeps the smallest by
label, then vector. A positive with a negative score accepts nothing. Scores beyond the range of a
long are clipped to it. Other columns are ignored. An empty table gives no rows.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.scratch import materialize

SAMPLE, CLUSTERS, ROUNDS = 4096, 64, 8
#: Candidates and anchors that meet in one task.
BLOCK, GROUP = 8192, 4096
#: Candidates that a member evaluates before its first stop test; the steps then double.
FIRST = 256
#: Room for the rounding of angles and bounds.
ANGLE_SLACK, SLACK = 1e-6, 1e-9
LONG = 2**63 - 1


# --- vectors and clusters -----------------------------------------------------------------


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths, also of vectors whose squares are out of range."""
    top = np.abs(x).max(axis=1, initial=0.0)
    unit = np.where(top > 0, top, 1.0)[:, None]
    with np.errstate(over="ignore"):
        return top * np.linalg.norm(x / unit, axis=1)


def _units(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, initial=0.0)
    x = x / np.where(top > 0, top, 1.0)[:, None]
    size = np.linalg.norm(x, axis=1)
    return x / np.where(size > 0, size, 1.0)[:, None]


def _angles(units: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centroid, -1.0, 1.0))


def choose_centroids(vectors: DataFrame, clusters: dict[int, int]) -> dict[int, np.ndarray]:
    """Per vector length, unit centroids of a sample: a few rounds of k-means by angle."""
    sample = vectors.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).collect()
    out = {}
    for dim, k in clusters.items():
        own = [r.vec for r in sample if r.dim == dim]
        units = _units(np.array(own, dtype=np.float64).reshape(len(own), dim))
        if not len(units):
            out[dim] = np.zeros((1, dim))
            continue
        centroids = units[:k]
        for _ in range(ROUNDS):
            near = (units @ centroids.T).argmax(axis=1)
            sums = np.zeros_like(centroids)
            np.add.at(sums, near, units)
            centroids = np.where(np.bincount(near, minlength=len(centroids))[:, None] > 0, _units(sums), centroids)
        out[dim] = centroids
    return out


def _packed(vec: np.ndarray) -> bytes:
    small = not vec.size or np.abs(vec).max() < 2**15
    return vec.astype("i2" if small else "f8").tobytes()


def _unpacked(packed: pd.Series, dim: int) -> np.ndarray:
    out = np.empty((len(packed), dim))
    small = packed.str.len().to_numpy() == 2 * dim
    for kind, rows in (("i2", small), ("f8", ~small)):
        out[rows] = np.frombuffer(b"".join(packed[rows]), kind).reshape(rows.sum(), dim)
    return out


PLACED = "vec_id long, label long, dim int, cluster int, angle double, norm double, vec binary"


def place_vectors(vectors: DataFrame, centroids: dict[int, np.ndarray]) -> DataFrame:
    """Each vector with the cluster of the nearest centroid, its angle to that, and its length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, x in batch.groupby("dim"):
                vecs = np.array(x["vec"].to_list(), dtype=np.float64).reshape(len(x), dim)
                units = _units(vecs)
                near = (units @ centroids[dim].T).argmax(axis=1)
                cosine = (units * centroids[dim][near]).sum(axis=1)
                yield pd.DataFrame(
                    {
                        "vec_id": x["vec_id"].to_numpy(),
                        "label": x["label"].to_numpy(),
                        "dim": dim,
                        "cluster": near,
                        "angle": np.arccos(np.clip(cosine, -1.0, 1.0)),
                        "norm": _norms(vecs),
                        "vec": [_packed(v) for v in vecs],
                    }
                )

    return vectors.mapInPandas(run, PLACED)


@dataclass
class Cluster:
    """What is known of the members of a cluster."""

    n: int
    angle: float
    norm: float
    anchors: int


def bound(centroids: np.ndarray, a: int, spread: float, c: int, other: Cluster) -> float:
    """No inner product of a unit vector within `spread` of centroid a and a member of c is above."""
    apart = float(np.arccos(np.clip(centroids[a] @ centroids[c], -1.0, 1.0)))
    angle = max(0.0, apart - spread - other.angle - ANGLE_SLACK)
    cosine = float(np.cos(angle))
    return (other.norm * cosine if cosine > 0 else 0.0) + SLACK * other.norm


# --- the walk -----------------------------------------------------------------------------


def _scores(a: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products of rows; exact ones by integers of any size, clipped to a long."""
    if not exact:
        return (a @ x.T).astype(np.int64)
    left, right = ([[int(v) for v in row] for row in m] for m in (a, x))
    return np.array(
        [[min(LONG, max(-LONG, sum(p * q for p, q in zip(u, v, strict=True)))) for v in right] for u in left],
        dtype=np.int64,
    ).reshape(len(a), len(x))


class Requests:
    """What the members of an anchor group still want: the k best scores from `low` to `high`."""

    def __init__(self, x: pd.DataFrame, k: int, same_label: bool, ids: np.ndarray, labels: np.ndarray) -> None:
        self.k, self.same = k, same_label
        self.member = x["member"].to_numpy()
        self.low = x["low"].to_numpy(np.int64).copy()
        self.high = x["high"].to_numpy(np.int64)
        self.ids, self.labels = ids, labels
        none = np.zeros(0, dtype=np.int64)
        self.hits = (none, none, none)

    def see(self, asking: np.ndarray, scores: np.ndarray, row: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """Take in scores (member rows x candidates) for the requests `asking`."""
        s = scores[row[self.member[asking]]]
        own = self.member[asking]
        alike = self.labels[own][:, None] == labels[None, :]
        fit = (alike if self.same else ~alike) & (self.ids[own][:, None] != ids[None, :])
        at, c = np.nonzero(fit & (s >= self.low[asking][:, None]) & (s <= self.high[asking][:, None]))
        if not len(at):
            return
        new = (asking[at], s[at, c], ids[c])
        request, score, vec_id = (np.concatenate(p) for p in zip(self.hits, new, strict=True))
        order = np.lexsort((vec_id, -score, request))
        request, score, vec_id = request[order], score[order], vec_id[order]
        first = np.flatnonzero(np.r_[True, request[1:] != request[:-1]])
        place = np.arange(len(request)) - np.repeat(first, np.diff(np.r_[first, len(request)]))
        full = place == self.k - 1
        # Scores equal to the k-th best still count: an id may be smaller.
        self.low[request[full]] = np.maximum(self.low[request[full]], score[full])
        keep = place < self.k
        self.hits = (request[keep], score[keep], vec_id[keep])


def walk(
    requests: Requests,
    a: np.ndarray,
    x: np.ndarray,
    ids: np.ndarray,
    labels: np.ndarray,
    centroid: np.ndarray,
) -> int:
    """All members walk one list; gives the number of scores that were evaluated."""
    dim = a.shape[1]
    big = np.sqrt(2.0**52 / max(dim, 1))
    big_x, big_a = (np.abs(m).max(axis=1, initial=0.0) >= big for m in (x, a))
    evaluated = 0

    def everything(members: np.ndarray, chosen: np.ndarray) -> int:
        """Vectors whose products don't fit in a double: no bounds, exact integers."""
        asking = np.flatnonzero(np.isin(requests.member, members))
        if len(asking) and len(chosen):
            row = np.full(len(a), -1)
            row[members] = np.arange(len(members))
            requests.see(asking, _scores(a[members], x[chosen], True), row, ids[chosen], labels[chosen])
        return len(members) * len(chosen)

    plain_a = np.flatnonzero(~big_a)
    evaluated += everything(np.flatnonzero(big_a), np.arange(len(x)))
    evaluated += everything(plain_a, np.flatnonzero(big_x))
    plain = np.flatnonzero(~big_x)
    if not len(plain) or not len(plain_a):
        return evaluated
    spread = _angles(_units(a[plain_a]), centroid).max()
    gap = np.maximum(0.0, _angles(_units(x[plain]), centroid) - spread - ANGLE_SLACK)
    norm = _norms(x[plain])
    most = np.where(np.cos(gap) > 0, norm * np.cos(gap), 0.0) + SLACK * norm
    # The shared list, sorted once.
    order = np.argsort(-most, kind="stable")
    most, listed = most[order], plain[order]
    length = _norms(a)
    asking = np.flatnonzero(np.isin(requests.member, plain_a))
    done, step = 0, FIRST
    while done < len(listed):
        asking = asking[length[requests.member[asking]] * most[done] >= requests.low[asking]]
        if not len(asking):
            break
        now = listed[done : done + step]
        members = np.unique(requests.member[asking])
        row = np.full(len(a), -1)
        row[members] = np.arange(len(members))
        requests.see(asking, _scores(a[members], x[now], False), row, ids[now], labels[now])
        evaluated += len(members) * len(now)
        done += step
        step *= 2
    return evaluated


# --- meetings -----------------------------------------------------------------------------

HITS = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"
COLUMNS = [c.split()[0] for c in HITS.split(", ")]


def _meet(centroids: dict[int, np.ndarray], k: int, same_label: bool):
    def meet(key: tuple, asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(found):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in COLUMNS})
        dim, cluster = int(key[0]), int(key[1])
        # One line per request; the vector of an anchor is the same on all of its lines.
        ids, first, member = np.unique(asked["vec_id"].to_numpy(), return_index=True, return_inverse=True)
        a = _unpacked(asked["vec"].iloc[first], dim)
        requests = Requests(asked.assign(member=member), k, same_label, ids, asked["label"].to_numpy()[first])
        x = _unpacked(found["vec"], dim)
        walk(requests, a, x, found["vec_id"].to_numpy(), found["label"].to_numpy(), centroids[dim][cluster])
        request, score, vec_id = requests.hits
        return pd.DataFrame(
            {
                "anchor_id": asked["vec_id"].to_numpy()[request],
                "positive_id": asked["positive_id"].to_numpy()[request],
                "positive_score": asked["positive_score"].to_numpy()[request],
                "vec_id": vec_id,
                "score": score,
            }
        )

    return meet


class Search:
    """Candidates in clusters, and the rounds in which anchors meet them."""

    def __init__(self, placed: DataFrame, is_anchor: Column, centroids: dict[int, np.ndarray], block: int, group: int) -> None:
        self.spark, self.centroids, self.block, self.group = placed.sparkSession, centroids, block, group
        asked = F.coalesce(is_anchor, F.lit(False))
        self.placed = placed.withColumn("is_anchor", asked)
        # At most CLUSTERS rows for each vector length.
        stats = self.placed.groupBy("dim", "cluster").agg(
            F.count("*").alias("n"),
            F.max("angle").alias("angle"),
            F.max("norm").alias("norm"),
            F.count_if("is_anchor").alias("anchors"),
            F.max(F.when(F.col("is_anchor"), F.col("angle"))).alias("spread"),
        )
        rows = stats.collect()
        self.clusters = {(r.dim, r.cluster): Cluster(r.n, r.angle, r.norm, r.anchors) for r in rows}
        self.spread = {(r.dim, r.cluster): r.spread for r in rows if r.anchors}

    def pairs(self, need: dict[tuple[int, int], float], own: bool | None = None) -> list[tuple]:
        """dim, cluster of anchors, cluster of candidates, for which the bound reaches `need`."""
        out = []
        for (dim, a), least in need.items():
            for (d, c), other in self.clusters.items():
                if d != dim or (own is not None and own != (a == c)):
                    continue
                if bound(self.centroids[dim], a, self.spread[(dim, a)], c, other) >= least:
                    out.append((dim, a, c, -(-other.n // self.block), -(-self.clusters[(dim, a)].anchors // self.group)))
        return out

    def meet(self, requests: DataFrame, pairs: list[tuple], k: int, same_label: bool) -> DataFrame:
        """Hits of `requests` (dim, cluster, vec_id, label, vec, positive_id, positive_score, low,
        high) in the blocks of the paired clusters."""
        if not pairs:
            return self.spark.createDataFrame([], HITS)
        # No more rows than pairs of clusters of one vector length.
        known = F.broadcast(self.spark.createDataFrame(pairs, "dim int, cluster int, other int, blocks int, groups int"))
        key = ["dim", "cluster", "group", "other", "block"]

        def dealt(n: str, seed: int) -> Column:
            return F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n)).cast("int")

        def every(n: str) -> Column:
            return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

        left = requests.join(known, ["dim", "cluster"]).withColumn("group", dealt("groups", 5)).withColumn("block", every("blocks"))
        right = self.placed.select("dim", F.col("cluster").alias("other"), "vec_id", "label", "vec").join(known, ["dim", "other"])
        right = right.withColumn("block", dealt("blocks", 7)).withColumn("group", every("groups"))
        # Both sides come from one table: new names keep Spark from taking them for the same columns.
        right = right.select(*(F.col(c).alias(c) for c in [*key, "vec_id", "label", "vec"]))
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_meet(self.centroids, k, same_label), HITS)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _least(requests: DataFrame) -> dict[tuple[int, int], float]:
    """Per cluster, the least score for a unit anchor that any of its requests accepts."""
    need = F.when(F.col("norm") > 0, F.col("low") / F.col("norm")).otherwise(float("-inf"))
    return {(r.dim, r.cluster): r.need for r in requests.groupBy("dim", "cluster").agg(F.min(need).alias("need")).collect()}


def mine_hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    floor_percent: int = 80,
    vec_id: str = "vec_id",
    vec: str = "embedding",
    label: str = "label",
    scale: int = 256,
    block: int = BLOCK,
    group: int = GROUP,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor: a condition on `vec_id`. Scores are inner products of floor(scale * component).
    """
    x = F.transform(vec, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    vectors = materialize(
        df.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vec).isNotNull() & finite)
        .select(
            F.col(vec_id).cast("long").alias("vec_id"),
            F.struct(F.col(label).cast("long").alias("label"), F.transform(x, lambda v: F.floor(v * scale).cast("double")).alias("vec")).alias("row"),
        )
        .groupBy("vec_id")
        .agg(F.min("row").alias("row"))
        .select("vec_id", "row.*", F.size("row.vec").alias("dim")),
        "neg-vectors",
    )
    sizes = {r.dim: r["count"] for r in vectors.groupBy("dim").count().collect()}
    centroids = choose_centroids(vectors, {d: min(CLUSTERS, -(-n // block)) for d, n in sizes.items()})
    search = Search(materialize(place_vectors(vectors, centroids), "neg-placed"), is_anchor, centroids, block, group)
    anchors = search.placed.filter("is_anchor")

    ask = anchors.withColumns({"positive_id": F.lit(0).cast("long"), "positive_score": F.lit(0).cast("long"), "low": F.lit(-LONG), "high": F.lit(LONG)})
    near = search.pairs({c: float("-inf") for c in search.spread}, own=True)
    near_hits = materialize(search.meet(ask, near, positives, True), "neg-near")
    kth = _ranked(near_hits, positives).filter(F.col("rank") == positives).select(F.col("anchor_id").alias("vec_id"), F.col("score").alias("kth"))
    ask = materialize(ask.join(kth, "vec_id", "left").withColumn("low", F.coalesce("kth", "low")).drop("kth"), "neg-asked")
    far_hits = search.meet(ask, search.pairs(_least(ask), own=False), positives, True)
    found = _ranked(near_hits.unionByName(far_hits), positives)
    found = found.select(F.col("anchor_id").alias("vec_id"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))

    # The least whole score that isn't below the given percentage.
    low = F.ceil(F.col("positive_score").cast("decimal(38,0)") * floor_percent / 100).cast("long")
    wanted = anchors.join(found.filter("positive_score >= 0"), "vec_id").withColumns({"low": low, "high": F.col("positive_score")})
    wanted = materialize(wanted, "neg-wanted")
    hits = search.meet(wanted, search.pairs(_least(wanted)), negatives, False)
    return _ranked(hits, negatives).select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
