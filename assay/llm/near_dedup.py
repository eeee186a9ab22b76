"""Near-duplicate classes by BagMinHash signatures, banding and exact multiset overlap.

A document is the multiset of its runs of five words (lower case, punctuation aside; a shorter
text is one run). Two documents are linked when the weighted Jaccard similarity of their multisets
(sum of smaller counts over sum of larger ones) is at least 0.8; a class is a connected component.

Signature: for every run a Poisson process in time over the weights from 0 to its count. Weights
are discretised in whole counts and split hierarchically, (0,1], (1,2], (2,4], (4,8] ..., each part
with points of its own at the rate of its width; a point in a part that the count only partly
covers falls into one of its unit cells and counts if the cell is covered. Every point goes to one
of the M signature positions, which keeps the earliest. Two documents agree in a position exactly
when the earliest point over both lies in what they share, so with their weighted Jaccard
similarity as probability. Points are made in time order only as far as positions are still open,
so a text costs its length plus about M log M.

Search: equal texts (by 128-bit hash of their words) are one node. A link needs one of the BANDS
groups of ROWS positions to agree; at similarity 0.8 all groups differ with probability
(1 - 0.8^5)^32 = 3e-6. A bucket of nodes with an equal group isn't expanded into pairs: nodes are
compared with a head of the bucket, links are merged into components, and only buckets that still
hold several components go on, with more and other heads (pairs whose whole signatures differ by
far more than those of linked texts do aren't compared); then all pairs of nodes from different
components that remain in a bucket meet in blocks inside a task, so no link between components is
lost. For this last step the nodes that are left get a finer signature (FINE positions); pairs that
agree in it as linked texts do are verified inside tasks (`_last_links`), and only links that join
something become rows. Pairs inside a component can't change the classes and are not compared.

Edge cases: null texts and texts without words are in classes of their own, except that non-blank
texts without words are one class where they are equal. Texts of up to three runs only match equal
ones (3/4 is below 0.8). Rows of one doc_id are versions of one document and share its class. A
row without doc_id has no class and is kept. Other columns are kept.
Columns of the caller may have any name; those named like a result column are replaced by it.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.names import hidden, shown
from assay.llm.workers import releasing
from assay.scratch import materialize

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
M = BANDS * ROWS
#: Heads per bucket in each round, before all pairs that remain are compared. Large buckets mostly
#: hold variants of one text, and a variant misses all of several heads ever less often.
HEADS = (1, 3)
#: Nodes of a bucket or cluster meet in blocks of about this size, with so many runs at most where
#: they bring their multisets.
BLOCK, RUNS_PER_BLOCK = 256, 400_000
#: Positions of the signature that screens the last step.
FINE = 1024
#: Positions of M and of FINE in which linked texts agree at least. At similarity 0.8 the expected
#: numbers are 130 and 832 (four bits of a position are kept); fewer than these are less likely than
#: 1 in 10^6.
LEAST_AGREEING, LEAST_FINE = 100, 766
#: Runs of words whose points are made together.
CHUNK = 150_000
WORD = re.compile(r"\w+")
#: Word hashes that a worker remembers.
CACHE = 60_000
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((x >> U(11)).astype(np.float64) + 1.0) * 2.0**-53


class Shingler:
    """Runs of words as 64-bit hashes."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def word_hashes(self, words: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > CACHE:
            seen.clear()
        out = []
        for w in words:
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)

    def runs(self, words: list[str], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
        """Distinct runs, sorted, and how often each occurs."""
        h = self.word_hashes(words)
        n = max(1, min(n, len(h)))
        out = np.zeros(len(h) - n + 1 if len(h) else 0, dtype=np.uint64)
        for i in range(n if len(h) else 0):
            out = _mix(out ^ h[i : len(h) - n + 1 + i])
        return np.unique(out, return_counts=True)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def signatures(
    hashes: np.ndarray, counts: np.ndarray, doc: np.ndarray, n_docs: int, m: int = M
) -> np.ndarray:
    """BagMinHash signatures (n_docs x m, float32 times of the earliest points) of multisets:
    parallel arrays of runs, their counts, and the document that each belongs to."""
    total = np.bincount(doc, counts, n_docs)
    times = np.full(n_docs * m, np.inf)
    # Parts of the weight range: 0 is (0,1], k is (2^(k-1), 2^k].
    parts = np.ceil(np.log2(counts)).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(hashes)), parts)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    low = np.where(k > 0, 2.0 ** (k - 1), 0.0)
    width = np.where(k > 0, low, 1.0)
    state = _mix(_mix(hashes[owner]) ^ k.astype(np.uint64))
    t = -np.log(_uniform(state)) / width
    # Every process: state and time of its next point, its part, its document and count.
    rows = [state, t, low, width, doc[owner], counts[owner]]
    # Up to this time nearly every position sees a point; where one doesn't, it is doubled.
    horizon = m * (np.log(m) + 4) / np.maximum(total, 1)
    while True:
        waiting = []
        while len(rows[0]):
            due = rows[1] <= horizon[rows[4]]
            waiting.append([x[~due] for x in rows])
            rows = [x[due] for x in rows]
            state, t, low, width, d, count = rows
            cell = low + np.ceil(_uniform(_mix(state ^ U(1))) * width)
            at = d * m + (_mix(state ^ U(2)) % U(m)).astype(np.int64)
            on = cell <= count
            np.minimum.at(times, at[on], t[on])
            rows[0] = _mix(state)
            rows[1] = t - np.log(_uniform(rows[0])) / width
        unseen = np.isinf(times.reshape(n_docs, m)).any(axis=1) & (total > 0)
        if not unseen.any():
            return times.reshape(n_docs, m).astype(np.float32)
        rows = [np.concatenate(x) for x in zip(*waiting, strict=True)]
        rows = [x[unseen[rows[4]]] for x in rows]
        horizon = np.where(unseen, 2 * horizon, 0.0)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key per document and band."""
    bits = signature.view(np.uint32).astype(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(_mix(np.arange(bands, dtype=np.uint64)), bits.shape[:2])
    for i in range(rows):
        key = _mix(key ^ bits[:, :, i])
    return key.view(np.int64)


def marks_of(signature: np.ndarray) -> np.ndarray:
    """Four bits per position, two positions a byte: enough to count agreements."""
    bits = (_mix(signature.view(np.uint32).astype(np.uint64)) >> U(60)).astype(np.uint8)
    return bits[:, ::2] << 4 | bits[:, 1::2]


#: Agreeing positions in the difference of two bytes of marks.
AGREEING = np.array([(x >> 4 == 0) + (x & 15 == 0) for x in range(256)], dtype=np.uint8)


def agreements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many positions marks agree."""
    return AGREEING[a ^ b].sum(axis=-1, dtype=np.int64)


def _marks(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


SKETCH = "_id long, node string, weight long, bands array<long>, marks binary"


def sketches(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """_id, node (hash of the words; null where nothing can match), weight, band keys and marks of
    the signature (null where only equal texts can match)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            ids, nodes, sets = [], [], []
            size = 0
            for i, t in zip(batch["_id"], batch["_text"], strict=True):
                own = words_of(t)
                key = "\x1f".join(own) if own else "\x1e" + t.strip()
                ids.append(i)
                nodes.append(xxhash.xxh3_128_hexdigest(key) if own or t.strip() else None)
                sets.append(shingler.runs(own, words))
                size += len(own)
                if size >= CHUNK:
                    yield _sketch(ids, nodes, sets)
                    ids, nodes, sets, size = [], [], [], 0
            if ids:
                yield _sketch(ids, nodes, sets)

    rows = docs.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    return rows.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).mapInPandas(releasing(run), SKETCH)


def _sketch(ids: list, nodes: list, sets: list) -> pd.DataFrame:
    weight = np.array([int(c.sum()) for _, c in sets], dtype=np.int64)
    out = pd.DataFrame({"_id": ids, "node": nodes, "weight": weight})
    out["bands"] = out["marks"] = None
    # A smaller multiset differs from any other by more than a fifth.
    large = np.flatnonzero(weight > 3)
    if len(large):
        sizes = [len(sets[i][0]) for i in large]
        doc = np.repeat(np.arange(len(large)), sizes)
        h = np.concatenate([sets[i][0] for i in large])
        c = np.concatenate([sets[i][1] for i in large])
        signature = signatures(h, c, doc, len(large))
        values = {"bands": list(band_keys(signature)), "marks": [x.tobytes() for x in marks_of(signature)]}
        for name, own in values.items():
            column = pd.Series([None] * len(ids), dtype=object)
            column.iloc[large] = pd.Series(own, dtype=object)
            out[name] = column
    return out


def _multisets(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """_id with its runs and their counts as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            sets = [shingler.runs(words_of(t), words) for t in batch["_text"]]
            yield pd.DataFrame(
                {
                    "_id": batch["_id"],
                    "runs": [h.tobytes() for h, _ in sets],
                    "counts": [c.astype(np.int32).tobytes() for _, c in sets],
                }
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    return rows.mapInPandas(releasing(run), "_id long, runs binary, counts binary")


def _fine_marks(multisets: DataFrame) -> DataFrame:
    """_id with the marks of a finer signature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                runs = [np.frombuffer(x, np.uint64) for x in part["runs"]]
                counts = np.concatenate([np.frombuffer(x, np.int32) for x in part["counts"]])
                doc = np.repeat(np.arange(len(part)), [len(x) for x in runs])
                # Other points than those of the first signature.
                hashes = _mix(np.concatenate(runs) ^ U(FINE))
                marks = marks_of(signatures(hashes, counts, doc, len(part), FINE))
                yield pd.DataFrame({"_id": part["_id"], "marks": [x.tobytes() for x in marks]})

    return multisets.mapInPandas(releasing(run), "_id long, marks binary")


def overlap(a: tuple[bytes, bytes], b: tuple[bytes, bytes]) -> tuple[int, int]:
    """Sums of the smaller and of the larger counts."""
    h1, h2 = np.frombuffer(a[0], np.uint64), np.frombuffer(b[0], np.uint64)
    c1, c2 = np.frombuffer(a[1], np.int32), np.frombuffer(b[1], np.int32)
    _, i, j = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    common = int(np.minimum(c1[i], c2[j]).sum())
    return common, int(c1.sum()) + int(c2.sum()) - common


def linked(pairs: DataFrame, multisets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity reaches the limit."""

    @F.pandas_udf("boolean")
    def similar(ra: pd.Series, ca: pd.Series, rb: pd.Series, cb: pd.Series) -> pd.Series:
        out = []
        for a, x, b, y in zip(ra, ca, rb, cb, strict=True):
            common, union = overlap((a, x), (b, y))
            out.append(common >= similarity * union - 1e-9)
        return pd.Series(out, dtype=bool)

    ends = [pairs.select(F.col(c).alias("_id")).distinct() for c in "ab"]
    asked = materialize(ends[0].unionByName(ends[1]).distinct(), "asked")
    multisets = multisets.join(asked, "_id", "left_semi")
    left = multisets.select(F.col("_id").alias("a"), F.col("runs").alias("ra"), F.col("counts").alias("ca"))
    right = multisets.select(F.col("_id").alias("b"), F.col("runs").alias("rb"), F.col("counts").alias("cb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.filter(similar("ra", "ca", "rb", "cb")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """id and label (smallest id of its component) of every node of the links (a, b).

    Every node hooks to its smallest neighbour, chains are followed to their ends, links between
    what they end in go on to the next round; each round at least halves the components left.
    """
    links, labels = materialize(links.select("a", "b").filter("a != b"), "links"), None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label"))
        hooks = materialize(hooks, "hooks")
        while True:
            up = hooks.select(F.col("id").alias("label"), F.col("label").alias("_up"))
            jumped = hooks.join(up, "label").select("id", F.col("_up").alias("label"), (F.col("_up") != F.col("label")).alias("_moved"))
            jumped = materialize(jumped, "hooks")
            hooks = jumped.drop("_moved")
            if jumped.filter("_moved").isEmpty():
                break
        if labels is None:
            labels = hooks
        else:
            up = hooks.select(F.col("id").alias("label"), F.col("label").alias("_up"))
            labels = materialize(
                labels.join(up, "label", "left").select("id", F.coalesce("_up", "label").alias("label")), "labels"
            )
        a, b = (hooks.select(F.col("id").alias(c), F.col("label").alias("_" + c)) for c in "ab")
        links = materialize(
            links.join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).filter("a != b").distinct(),
            "links",
        )
    return labels if labels is not None else links.select(F.col("a").alias("id"), F.col("b").alias("label"))


def _labelled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Buckets that still hold several components, with the component of every node."""
    rows = buckets.drop("label").join(labels.withColumnRenamed("id", "_id"), "_id", "left")
    rows = rows.withColumn("label", F.coalesce("label", "_id"))
    several = rows.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high"))
    return rows.join(several.filter("_low != _high").select("key"), "key", "left_semi")


def _head_pairs(buckets: DataFrame, step: int, n: int, similarity: float) -> DataFrame:
    """Pairs of a node and one of up to n heads of its bucket (each the first in an order of its
    own) that are of different components and whose sizes and whole signatures allow a link. A
    bucket's heads come to its nodes as one row, so only pairs that may be links are rows."""
    node = F.struct("_id", "label", "weight", "marks")
    firsts = [F.min_by(node, F.struct(F.xxhash64("_id", F.lit(step), F.lit(i)), "_id")) for i in range(n)]
    heads = buckets.groupBy("key").agg(F.array_distinct(F.array(*firsts)).alias("_h"))
    heads = heads.select("key", *(F.col(f"_h.{c}").alias(f"h_{c}") for c in ("_id", "label", "weight", "marks")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if not len(x):
                continue
            sizes = x["h__id"].map(len).to_numpy()
            row = np.repeat(np.arange(len(x)), sizes)
            ids, labels, weights = (np.concatenate(x[f"h_{c}"].to_list()) for c in ("_id", "label", "weight"))
            heads = _marks(x["h_marks"].explode())
            weight = x["weight"].to_numpy()[row]
            fits = agreements(_marks(x["marks"])[row], heads) >= LEAST_AGREEING
            fits &= x["label"].to_numpy()[row] != labels
            fits &= np.minimum(weight, weights) >= similarity * np.maximum(weight, weights) - 1e-9
            left, right = x["_id"].to_numpy()[row[fits]], ids[fits]
            yield pd.DataFrame({"a": np.minimum(left, right), "b": np.maximum(left, right)}).drop_duplicates()

    met = buckets.join(heads, "key").drop("key")
    return met.mapInPandas(run, "a long, b long").distinct()


def _in_blocks(rows: DataFrame, group: str, runs_per_block: int | None = None) -> DataFrame:
    """Rows of a group dealt into blocks, one copy of a row for each block that its own meets: group,
    i, j (the blocks of a meeting, i <= j) and part (the row's own block)."""
    blocks = F.count("*") / BLOCK
    if runs_per_block:
        blocks = F.greatest(blocks, F.sum("weight") / runs_per_block)
    sizes = rows.groupBy(group).agg(F.ceil(blocks).cast("int").alias("_blocks"))
    dealt = rows.join(sizes, group).withColumn("part", F.pmod(F.xxhash64("_id", F.lit(9)), "_blocks").cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    ends = [F.least("part", "_other").alias("i"), F.greatest("part", "_other").alias("j")]
    return dealt.select(group, *ends, "part", "_id", "label", "weight")


def _meetings(rows: DataFrame, group: str, meet) -> DataFrame:
    """Pairs (a, b) out of every meeting of two blocks, one at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for x in batches:
            x = x if rest is None else pd.concat([rest, x], ignore_index=True)
            if not len(x):
                continue
            names = x[[group, "i", "j"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]).any(axis=1)])
            # The last meeting may go on in the next batch.
            found = [meet(x.iloc[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            rest = x.iloc[starts[-1] :]
            yield _one_table(found)
        if rest is not None:
            yield _one_table([meet(rest)])

    order = [group, "i", "j"]
    met = rows.repartition(*order).sortWithinPartitions(*order)
    return met.mapInPandas(releasing(run), "a long, b long")


def _last_links(buckets: DataFrame, multisets: DataFrame, similarity: float) -> DataFrame:
    """Links that join the components which still share a bucket, a spanning forest of them for each
    meeting of blocks, so that rows grow with the nodes and not with the pairs of a bucket.

    First, nodes that may be linked (of different components, by size and fine signature) are gathered
    into candidate clusters: every meeting gives a star per connected group of its candidate pairs.
    Then the nodes of a cluster meet with their multisets, once for each two blocks and not once for
    each bucket, candidates are verified there, the most alike first, and a pair that its meeting has
    joined already is passed over. Every candidate pair lies in one cluster and so in one meeting.
    """
    asked = materialize(buckets.select("_id").distinct(), "asked")
    fine = materialize(_fine_marks(multisets.join(asked, "_id", "left_semi")), "fine")
    rows = _in_blocks(buckets.select("key", "_id", "label", "weight"), "key")
    stars = _meetings(rows.join(fine, "_id"), "key", lambda x: _stars(x, similarity))
    clusters = components(stars.distinct())
    nodes = buckets.select("_id", "label", "weight").distinct()
    placed = nodes.join(clusters.select(F.col("id").alias("_id"), F.col("label").alias("cluster")), "_id")
    rows = _in_blocks(materialize(placed, "clusters"), "cluster", RUNS_PER_BLOCK)
    rows = rows.join(fine, "_id").join(multisets, "_id")
    return _meetings(rows, "cluster", lambda x: _forest(x, similarity))


def _one_table(found: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    none = np.zeros(0, dtype=np.int64)
    a, b = (np.concatenate([none, *(x[i] for x in found)]) for i in (0, 1))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _candidates(x: pd.DataFrame, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs of one block with itself or another that may be links, and in how many
    positions of the fine signature they agree."""
    part, i, j = x["part"].to_numpy(), x["i"].iat[0], x["j"].iat[0]
    ids, labels, weights = (x[c].to_numpy() for c in ("_id", "label", "weight"))
    left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
    a, b = np.repeat(left, len(right)), np.tile(right, len(left))
    fits = (labels[a] != labels[b]) & (ids[a] < ids[b] if i == j else True)
    fits &= np.minimum(weights[a], weights[b]) >= similarity * np.maximum(weights[a], weights[b]) - 1e-9
    a, b = a[fits], b[fits]
    if not len(a):
        return a, b, a
    marks = _marks(x["marks"])
    alike = np.concatenate([agreements(marks[a[at : at + 4096]], marks[b[at : at + 4096]]) for at in range(0, len(a), 4096)])
    may = alike >= LEAST_FINE
    return a[may], b[may], alike[may]


def _stars(x: pd.DataFrame, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Every node of a connected group of candidates with the first of its group."""
    ids = x["_id"].to_numpy()
    a, b, _ = _candidates(x, similarity)
    group = np.arange(len(ids))
    while len(a):
        low = np.minimum(group[a], group[b])
        before = group.copy()
        np.minimum.at(group, group[a], low)
        np.minimum.at(group, group[b], low)
        group = group[group]
        if (group == before).all():
            break
    moved = np.flatnonzero(group != np.arange(len(ids)))
    return ids[moved], ids[group[moved]]


def _forest(x: pd.DataFrame, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of a meeting that join what no earlier one of it has joined."""
    ids, labels = x["_id"].to_numpy(), x["label"].to_numpy()
    a, b, alike = _candidates(x, similarity)
    order = np.argsort(-alike, kind="stable")
    sets = list(zip(x["runs"], x["counts"], strict=True))
    above = {label: label for label in np.unique(labels).tolist()}

    def top(label: int) -> int:
        while above[label] != label:
            above[label] = above[above[label]]
            label = above[label]
        return label

    kept = []
    for at in order:
        one, two = top(int(labels[a[at]])), top(int(labels[b[at]]))
        if one == two:
            continue
        common, union = overlap(sets[a[at]], sets[b[at]])
        if common >= similarity * union - 1e-9:
            above[max(one, two)] = min(one, two)
            kept.append(at)
    return ids[a[kept]], ids[b[kept]]


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    heads: tuple[int, ...] = HEADS,
) -> DataFrame:
    """doc_id and class_id (smallest doc_id of its class) of every document that has an id."""
    if similarity < SIMILARITY:
        # The bands are laid out for this limit; a lower one would lose links.
        raise ValueError(f"the bands find similarities of {SIMILARITY} or more")
    docs, doc_id, text = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text"
    sketch = materialize(sketches(docs, doc_id, text, words), "sketches")
    # Rows of one id, then equal texts, are tied to their smallest id.
    nodes = materialize(
        sketch.filter("node IS NOT NULL").groupBy("node").agg(F.min("_id").alias("head"), F.first("weight").alias("weight"), F.first("bands").alias("bands"), F.first("marks").alias("marks")),
        "nodes",
    )
    banded = nodes.filter("bands IS NOT NULL").select(F.col("head").alias("_id"), "weight", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("_id").alias("_low"), F.max("_id").alias("_high")).filter("_low != _high")
    buckets = materialize(
        # Marks come last: most nodes share no bucket.
        banded.join(shared.select("key"), "key", "left_semi")
        .join(nodes.select(F.col("head").alias("_id"), "marks"), "_id")
        .withColumn("label", F.col("_id")),
        "buckets",
    )
    # Ids written alone have a known size: Spark broadcasts them if they are few.
    asked = materialize(buckets.select("_id").distinct(), "asked")
    texts = docs.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    texts = texts.join(asked, F.col(doc_id).cast("long") == F.col("_id"), "left_semi")
    multisets = materialize(_multisets(texts, doc_id, text, words), "multisets")
    none = docs.sparkSession.createDataFrame([], "a long, b long")
    links, tried = none, none
    for step in range(len(heads) + 1):
        if buckets.isEmpty():
            break
        if step == len(heads):
            links = materialize(links.unionByName(_last_links(buckets, multisets, similarity)), "links")
            break
        pairs = _head_pairs(buckets, step, heads[step], similarity)
        pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        links = materialize(links.unionByName(linked(pairs, multisets, similarity)), "links")
        tried = tried.unionByName(pairs)
        buckets = materialize(_labelled(buckets, components(links)), "buckets")
    copies = sketch.filter("node IS NOT NULL").join(nodes.select("node", "head"), "node").select("_id", "head")
    repeated = copies.filter("_id != head").select(F.col("_id").alias("a"), F.col("head").alias("b"))
    versions = sketch.groupBy("_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    if versions:
        # Every id is one document, so copies only look up the class of their head.
        labels = components(links).withColumnsRenamed({"id": "head", "label": "class_id"})
        known = copies.join(labels, "head", "left").select("_id", F.coalesce("class_id", "head").alias("class_id"))
    else:
        labels = components(links.unionByName(repeated))
        known = labels.select(F.col("id").alias("_id"), F.col("label").alias("class_id"))
    every = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("_id"))
    return every.join(known, "_id", "left").select(
        F.col("_id").alias("doc_id"), F.coalesce("class_id", "_id").alias("class_id")
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each class: that with the smallest id. Rows without an id stay."""
    classes = near_duplicates(docs, doc_id, text, **options)
    gone = materialize(classes.filter("doc_id != class_id").select("doc_id").distinct(), "copies")
    rows, names = hidden(docs)
    doc_id, text = names[doc_id], names[text]
    left = rows.join(gone.withColumnRenamed("doc_id", "_gone"), F.col(doc_id).cast("long") == F.col("_gone"), "left_anti")
    ids = left.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).count()
    if ids.filter("count > 1").isEmpty():
        return left.select(shown(names))
    # Rows of one id: the first by text stays.
    named = left.filter(F.col(doc_id).isNotNull())
    first = Window.partitionBy(doc_id).orderBy(F.col(text).asc_nulls_last())
    one = named.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return one.unionByName(left.filter(F.col(doc_id).isNull())).select(shown(names))
