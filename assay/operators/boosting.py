"""Gradient-boosted trees on shared histograms: regression, two classes, and any number of classes
in one model (softmax, one tree per class and round).

Features are cut into bins at quantiles once. Rows are kept as blocks of small arrays: bins, label
and margins. Every depth level of a round is one aggregate over the blocks, for the trees of all
classes together: sums of first and second derivatives per (class, feature), node and bin, reduced
by key, and the best cut of each node found where a key's histogram ends up. Only these cuts come to
the driver. Leaves weigh -G / (H + ridge).

Blocks are rebuilt from their lineage when an executor is lost; it is cut by a checkpoint every
`CHECKPOINT_ROUNDS` rounds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.scratch import scratch_path

# Public defaults of the boosting libraries.
RIDGE, MIN_HESSIAN, BINS = 1.0, 1.0, 256
LEAST_GAIN = 1e-6
#: Accuracy of the quantile sketch that bins come from.
SKETCH_ACCURACY = 10_000
CHECKPOINT_ROUNDS = 20
#: Least rows of a block, but for the last of a task: the work per block is spread over its rows.
BLOCK_ROWS = 32_768
#: Sums of a level, over all partitions, that are added on the driver (in numbers of 8 bytes); more
#: are reduced by key.
DRIVER_SUMS = 2**21
OBJECTIVES = ("squared", "logistic", "softmax")


def gradients(objective: str, y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by margin, trees of a round by rows."""
    if objective == "squared":
        return margin - y, np.ones_like(margin)
    if objective == "logistic":
        p = 1 / (1 + np.exp(-margin))
        return p - y, np.maximum(p * (1 - p), 1e-16)
    p = np.exp(margin - margin.max(axis=0))
    p /= p.sum(axis=0)
    own = np.arange(len(margin))[:, None] == y
    return p - own, np.maximum(2 * p * (1 - p), 1e-16)


class Tree:
    """A tree as arrays in heap order: the children of node i are 2 i + 1 and 2 i + 2."""

    def __init__(self, depth: int) -> None:
        n = 2 ** (depth + 1) - 1
        self.depth = depth
        self.feature = np.full(n, -1, dtype=np.int32)
        self.bin = np.zeros(n, dtype=np.int32)
        self.cut = np.zeros(n)
        self.value = np.zeros(n)

    def nodes(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where rows end up: `rows` are bins with `at` = bin, or values with `at` = cut."""
        n, width = rows.shape
        flat, first = np.ascontiguousarray(rows).ravel(), np.arange(0, n * width, width)
        node = np.zeros(n, dtype=np.int64)
        for level in range(self.depth):
            here = self.feature[2**level - 1 : 2 ** (level + 1) - 1]
            if not (here >= 0).any():
                break
            feature = self.feature.take(node)
            own = flat.take(first + np.maximum(feature, 0))
            cut = at.take(node)
            right = own > cut if at is self.bin else own >= cut
            down = 2 * node + 1 + right
            # Rows stay at a leaf; where none was passed so far, all go down.
            node = down if (here >= 0).all() else np.where(feature >= 0, down, node)
        return node


def best_cuts(hist: np.ndarray, ridge: float, least: float) -> np.ndarray:
    """Per node: gain, bin, and G and H of the left and of both sides, of the best cut of a feature."""
    g, h = hist
    total_g, total_h = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
    left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    right_g, right_h = total_g - left_g, total_h - left_h
    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - total_g**2 / (total_h + ridge)
    gain = np.where((left_h >= least) & (right_h >= least), gain, -np.inf)
    at = gain.argmax(axis=1) if gain.shape[1] else np.zeros(len(g), dtype=int)
    every = np.arange(len(g))
    if not gain.shape[1]:
        none = np.full(len(g), -np.inf)
        return np.stack([none, at, at * 0.0, at * 0.0, total_g[:, 0], total_h[:, 0]], axis=1)
    return np.stack(
        [gain[every, at], at, left_g[every, at], left_h[every, at], total_g[:, 0], total_h[:, 0]], axis=1
    )


def _pack(cuts: list[np.ndarray]):
    width = len(cuts)
    kind = np.uint8 if max(map(len, cuts), default=0) < 256 else np.uint16

    def block(held: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        bins, y = (np.concatenate(x) for x in zip(*held, strict=True))
        return pd.DataFrame({"bins": [bins.tobytes()], "y": [y.tobytes()]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for x in batches:
            if not len(x):
                continue
            bins = np.empty((len(x), width), kind)
            for i, c in enumerate(cuts):
                bins[:, i] = np.searchsorted(c, x[f"x{i}"].to_numpy(np.float64), side="right")
            held.append((bins, x["label"].to_numpy(np.float64)))
            rows += len(x)
            if rows >= BLOCK_ROWS:
                yield block(held)
                held, rows = [], 0
        if held:
            yield block(held)

    return run


class BoostedTrees(Estimator):
    """Fits `rounds` rounds on the columns `features` (vector) and `label`.

    Classes are labels 0 to classes - 1. Fits of the same rows agree but for the order of sums.
    """

    def __init__(
        self,
        objective: str,
        rounds: int,
        depth: int,
        rate: float,
        classes: int = 2,
        ridge: float = RIDGE,
        min_hessian: float = MIN_HESSIAN,
        bins: int = BINS,
    ) -> None:
        super().__init__()
        if objective not in OBJECTIVES:
            raise ValueError(f"unknown objective {objective!r}")
        self.objective, self.rounds, self.depth, self.rate = objective, rounds, depth, rate
        self.width = classes if objective == "softmax" else 1
        self.ridge, self.min_hessian, self.bins = ridge, min_hessian, bins

    def cuts(self, rows: DataFrame, features: int) -> list[np.ndarray]:
        """Per feature the distinct quantiles above its least value: a row is left of a cut when its
        value is below it."""
        shares = [float(s) for s in np.arange(1, self.bins) / self.bins]
        value = [F.col("x")[i] for i in range(features)]
        found = rows.agg(
            F.array(*(F.min(v) for v in value)), *(F.percentile_approx(v, shares, SKETCH_ACCURACY) for v in value)
        ).first()
        cuts = [np.unique(np.array(c, dtype=np.float64)) for c in found[1:]]
        return [c[c > least] for c, least in zip(cuts, found[0], strict=True)]

    def _fit(self, dataset: DataFrame) -> BoostedTreesModel:
        rows = dataset.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))
        spark = dataset.sparkSession
        mean, features = rows.agg(F.avg("label"), F.max(F.size("x"))).first()
        if features is None:
            raise ValueError("no training rows")
        base = float(mean) if self.objective == "squared" else 0.0
        cuts, width = self.cuts(rows, features), self.width
        kind = np.uint8 if max(map(len, cuts), default=0) < 256 else np.uint16

        def unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            y = np.frombuffer(row.y, np.float64)
            bins = np.frombuffer(row.bins, kind).reshape(len(y), features)
            return bins, y, np.full((width, len(y)), base)

        # Blocks of arrays with the margins of the rounds so far; a table has no column for these
        # that lives from round to round without being written.
        # Features go to the tasks as plain columns: a list for each row costs more than all else here.
        plain = rows.select(*(F.col("x")[i].alias(f"x{i}") for i in range(features)), "label")
        blocks = plain.mapInPandas(_pack(cuts), "bins binary, y binary").rdd.map(unpack)
        blocks.persist(StorageLevel.MEMORY_AND_DISK)
        scratch_path(spark, "boost")
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
        ensemble, gains, held = Ensemble(self.objective, base, width), np.zeros(features), [blocks]
        try:
            for r in range(self.rounds):
                grown = self._grow(blocks, cuts, gains)
                if all(t.feature[0] < 0 for t in grown):
                    break
                ensemble.trees.append(grown)
                blocks = blocks.map(_moved(grown)).persist(StorageLevel.MEMORY_AND_DISK)
                held.append(blocks)
                if r % CHECKPOINT_ROUNDS == CHECKPOINT_ROUNDS - 1:
                    blocks.checkpoint()
                    blocks.count()
                # The round before this one is still read by the next job.
                while len(held) > 2:
                    held.pop(0).unpersist()
        finally:
            for old in held:
                old.unpersist()
        return BoostedTreesModel(fitted=ensemble.to_json(gains))

    def _grow(self, blocks, cuts: list[np.ndarray], gains: np.ndarray) -> list[Tree]:
        """The trees of one round, level by level."""
        trees = [Tree(self.depth) for _ in range(self.width)]
        active = [np.array([0]) for _ in trees]
        bins = max((len(c) for c in cuts), default=0) + 1
        ridge, least, width, objective = self.ridge, self.min_hessian, len(cuts), self.objective
        # At least one split of the work per core, no more than there are histograms.
        parts = max(1, min(self.width * width, blocks.getNumPartitions()))
        for level in range(self.depth):
            growing = [k for k in range(self.width) if len(active[k])]
            if not growing:
                break
            known, places = trees, active

            def sums(part):
                total = {}
                for x, y, margin in part:
                    g, h = gradients(objective, y, margin)
                    columns = np.ascontiguousarray(x.T)
                    for k in growing:
                        node = known[k].nodes(x, known[k].bin)
                        slot = np.full(len(known[k].feature), -1)
                        slot[places[k]] = np.arange(len(places[k])) * bins
                        at, own = slot.take(node), (g[k], h[k])
                        cells = columns
                        if at.min() < 0:
                            live = np.flatnonzero(at >= 0)
                            at, own, cells = at[live], (g[k][live], h[k][live]), columns[:, live]
                        size = len(places[k]) * bins
                        for f in range(width):
                            cell = at + cells[f]
                            both = np.stack([np.bincount(cell, w, minlength=size) for w in own])
                            if (k, f) in total:
                                total[k, f] += both
                            else:
                                total[k, f] = both
                return iter(total.items())

            def cut(item):
                (k, f), hist = item
                return k, f, best_cuts(hist.reshape(2, -1, bins), ridge, least)

            cells = sum(len(active[k]) for k in growing) * bins * width * 2 * blocks.getNumPartitions()
            if cells <= DRIVER_SUMS:
                # One stage: for a level this small, starting another costs more than the sums.
                total: dict = {}
                for key, hist in blocks.mapPartitions(sums).collect():
                    total[key] = total[key] + hist if key in total else hist
                found = [cut(item) for item in total.items()]
            else:
                found = blocks.mapPartitions(sums).reduceByKey(np.add, parts).map(cut).collect()
            for k in growing:
                own = sorted((f, c) for j, f, c in found if j == k)
                table = np.stack([c for _, c in own])
                which = table[:, :, 0].argmax(axis=0)
                grown = []
                for i, node in enumerate(active[k]):
                    f = own[which[i]][0]
                    gain, at, left_g, left_h, total_g, total_h = table[which[i], i]
                    tree = trees[k]
                    if level == 0:
                        tree.value[0] = -self.rate * total_g / (total_h + ridge)
                    # The empty bins of a feature with fewer cuts hold nothing to cut at.
                    if not (gain > LEAST_GAIN and int(at) < len(cuts[f])):
                        continue
                    gains[f] += gain
                    tree.feature[node], tree.bin[node], tree.cut[node] = f, int(at), cuts[f][int(at)]
                    tree.value[2 * node + 1] = -self.rate * left_g / (left_h + ridge)
                    tree.value[2 * node + 2] = -self.rate * (total_g - left_g) / (total_h - left_h + ridge)
                    grown += [2 * node + 1, 2 * node + 2]
                active[k] = np.array(grown, dtype=int)
        return trees


def _moved(trees: list[Tree]):
    def run(block: tuple) -> tuple:
        x, y, margin = block
        step = np.stack([t.value.take(t.nodes(x, t.bin)) for t in trees])
        return x, y, margin + step

    return run


@dataclass
class Ensemble:
    """What a fit leaves: the trees of every round."""

    objective: str
    base: float
    width: int
    trees: list[list[Tree]] = field(default_factory=list)

    def to_json(self, gains: np.ndarray) -> str:
        trees = [[[t.depth, t.feature.tolist(), t.cut.tolist(), t.value.tolist()] for t in row] for row in self.trees]
        known = {"objective": self.objective, "base": self.base, "width": self.width}
        return json.dumps(known | {"gains": gains.tolist(), "trees": trees})

    @staticmethod
    def from_json(text: str) -> Ensemble:
        known = json.loads(text)
        out = Ensemble(known["objective"], known["base"], known["width"])
        for row in known["trees"]:
            out.trees.append([Tree(depth) for depth, *_ in row])
            for tree, (_, feature, cut, value) in zip(out.trees[-1], row, strict=True):
                tree.feature, tree.cut, tree.value = np.array(feature), np.array(cut), np.array(value)
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Rows by trees of a round."""
        out = np.full((len(x), self.width), self.base)
        for row in self.trees:
            out += np.stack([t.value.take(t.nodes(x, t.cut)) for t in row], axis=1)
        return out

    def predictions(self, x: np.ndarray) -> np.ndarray:
        margin = self.margins(x)
        if self.objective == "softmax":
            return margin.argmax(axis=1).astype(np.float64)
        return (margin[:, 0] > 0).astype(np.float64) if self.objective == "logistic" else margin[:, 0]


class BoostedTreesModel(Model, DefaultParamsWritable, DefaultParamsReadable):
    """Adds `prediction` to rows with `features`; `featureImportances` are shares of the total gain."""

    fitted = Param(Params._dummy(), "fitted", "the trees as JSON", TypeConverters.toString)

    def __init__(self, fitted: str | None = None) -> None:
        super().__init__()
        if fitted is not None:
            self._set(fitted=fitted)

    @property
    def featureImportances(self) -> DenseVector:
        gains = np.array(json.loads(self.getOrDefault(self.fitted))["gains"])
        return DenseVector(gains / gains.sum() if gains.sum() > 0 else gains)

    @property
    def ensemble(self) -> Ensemble:
        return Ensemble.from_json(self.getOrDefault(self.fitted))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fitted = self.getOrDefault(self.fitted)

        def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known = Ensemble.from_json(fitted)
            for x in batches:
                yield pd.Series(known.predictions(np.stack(x.to_list())) if len(x) else x.astype(np.float64))

        return dataset.withColumn("prediction", F.pandas_udf(predict, "double")(vector_to_array("features")))
