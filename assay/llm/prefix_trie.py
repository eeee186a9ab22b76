"""A trie of conversation prefixes, kept as flat arrays behind minimal perfect hashes.

A node is a distinct sequence of the first d turns (role and text) of a conversation. Its digest is
the depth and two 64-bit sums (xor) of hashes of (position, role, md5 of the text), so the digests of
all prefixes of a conversation are running sums, also where its turns are dealt in pieces over tasks.

1. Conversations are cut into pieces of `PIECE` turns; piece sums give every turn's prefix digest.
2. Distinct digests are counted: members, smallest member, words. A node belongs to its smallest
   member, so every turn of a conversation knows, by a join on (conv_id, depth), whether it owns one.
3. Pieces are dealt by hash into shards of about `SHARD` turns. A shard enumerates its distinct
   digests, assigns them slots by a minimal perfect hash, verifies each slot against the digest kept
   there, scatters what its turns own into flat arrays by slot, and adds these up through the array
   of parent slots in order of depth, the deepest first. What a conversation owns in later pieces
   enters at the last slot of the piece before. A node that only lies in one conversation's prefix
   here but is owned elsewhere adds nothing, so sums by digest over all shards are whole.

No conversation, first turn or node needs to fit in a task: pieces bound the turns, and counts by
digest are pre-aggregated in each task. Nodes with very many children are met by a broadcast of
these few (at most `HOT`, since their children add up to all nodes).

Edge cases: rows of a null conv_id take no part. Turns are ordered by number, nulls first, ties by
role, then by the first `TIE` characters of the text, then by its md5; repeated rows all stay. A
null role or text is empty. A conversation without turns after rebuilding is a member of the root.
Other columns are ignored. An empty table gives no nodes.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.scratch import materialize

#: Turns of a conversation that are handled together, and turns of a shard.
PIECE, SHARD = 1024, 8192
#: Conversation ids (by number) that are joined to one text before they are digested.
ID_BLOCK = 4096
#: A node with more than one in so many children is met by broadcast.
HOT = 1000
TIE = 256
#: Repetitions of one row that are written out in one step.
REPEAT = 4096
#: First turns that a conversation can take from the one that begins its family, and its size.
HEAD, FAMILY = 4, 20
NODE = ["depth", "a", "b"]
WORD = r"[^\x20\x09-\x0D]+"


# --- minimal perfect hash -----------------------------------------------------------------


class PerfectHash:
    """Slots 0 to n - 1 of n distinct keys (rows of unsigned integers), verified on lookup.

    Level by level, keys that are alone in their cell keep it and the others go on to a next, smaller
    table with another seed; the slot is the rank of the cell among the kept ones.
    """

    def __init__(self, keys: np.ndarray, room: float = 1.5) -> None:
        self.n, self.levels = len(keys), []
        left, seed, base = np.arange(self.n), 0, 0
        while len(left):
            cells = max(2, int(room * len(left)))
            at = self._cell(keys[left], seed, cells)
            alone = np.bincount(at, minlength=cells) == 1
            rank = np.cumsum(alone) - 1 + base
            self.levels.append((seed, cells, alone, rank))
            base += int(alone.sum())
            left, seed = left[~alone[at]], seed + 1
            if seed > 1000:
                raise ValueError("keys of a perfect hash must be distinct")
        self.keys = np.empty_like(keys)
        slots = self._slots(keys)
        if len(np.unique(slots)) != self.n:
            raise ValueError("two keys share a slot")
        self.keys[slots] = keys

    @staticmethod
    def _cell(keys: np.ndarray, seed: int, cells: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = np.full(len(keys), np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64))
            for column in keys.T:
                x = (x ^ column) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                x ^= x >> np.uint64(29)
        return (x % np.uint64(cells)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for seed, cells, alone, rank in self.levels:
            at = self._cell(keys[left], seed, cells)
            hit = alone[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key; -1 for keys that aren't in the table."""
        out = self._slots(keys)
        if self.n:
            out[(self.keys[out] != keys).any(axis=1)] = -1
        return out


# --- turns --------------------------------------------------------------------------------


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), role, text_md5 and words of every turn, in order.

    Rows are dealt by ranges of their order and numbered inside a range; the few conversations that
    lie in several ranges are moved on by what the ranges before hold.
    """
    text = F.coalesce("text", F.lit(""))
    rows = (
        conversations.filter(F.col("conv_id").isNotNull())
        .select(
            F.col("conv_id").cast("long").alias("conv_id"),
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.substring(text, 1, TIE).alias("tie"),
            F.md5(text.cast("binary")).alias("text_md5"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        )
        .groupBy("conv_id", "turn", "role", "tie", "text_md5", "words")
        .agg(F.count("*").alias("n"))
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "tie", "text_md5"]
    dealt = materialize(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "trie-turns")
    held = dealt.groupBy("conv_id", "range").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # At most one conversation goes on from one range to the next: no more rows than ranges.
    moved = held.withColumn("moved", F.sum("n").over(before)).filter("moved IS NOT NULL").drop("n")
    inside = Window.partitionBy("conv_id", "range").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    numbered = dealt.withColumn("pos", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    numbered = numbered.join(F.broadcast(moved), ["conv_id", "range"], "left")
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(REPEAT).cast("long")))
    repeats = F.explode(F.sequence(F.col("step"), F.least(F.col("step") + REPEAT, F.col("n")) - 1))
    return (
        numbered.withColumn("step", steps)
        .withColumn("again", repeats)
        .select(
            "conv_id",
            (F.col("pos") + F.coalesce("moved", F.lit(0)) + F.col("again")).alias("pos"),
            "role",
            "text_md5",
            "words",
        )
    )


def rebuilt_turns(turns: DataFrame, head: int = HEAD, family: int = FAMILY) -> DataFrame:
    """conv_id, depth (from 1), role, text_md5, words: conversation c begins with the first h turns of
    conversation c - c % family, where h is crc32 of c in decimal, modulo head, and goes on with its
    own turns after its first h. Every conversation also has a row of depth 0, without role."""
    ids = turns.groupBy("conv_id").agg(F.count("*").alias("turns"))
    base = F.col("conv_id") - F.col("conv_id") % family
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % head
    convs = ids.select("conv_id", base.alias("base"), h.alias("h"))
    heads = turns.filter(F.col("pos") < head - 1)
    begun = F.col("conv_id") == F.col("base")
    taken = (
        convs.join(heads.withColumnRenamed("conv_id", "base"), "base")
        .filter(F.col("pos") < F.col("h"))
        .select("conv_id", (F.col("pos") + 1).alias("depth"), "role", "text_md5", "words")
    )
    own = turns.withColumns({"base": base, "h": h}).filter(F.col("pos") >= F.col("h"))
    # A turn keeps its place unless the family's first conversation is shorter than h.
    size = ids.select(F.col("conv_id").alias("base"), F.least("turns", F.lit(head)).alias("size"))
    short = (
        convs.filter(~begun).join(size, "base", "left")
        .select("conv_id", (F.col("h") - F.least("h", F.coalesce("size", F.lit(0)))).alias("less"))
        .filter("less > 0")
    )
    # By pieces, so that a conversation of very many turns is many keys.
    piece = F.floor(F.col("pos") / PIECE)
    pieces = own.select("conv_id", piece.alias("piece")).distinct().join(short, "conv_id")
    kept = own.withColumn("piece", piece).join(pieces, ["conv_id", "piece"], "left")
    kept = kept.select(
        "conv_id", (F.col("pos") + 1 - F.coalesce("less", F.lit(0))).alias("depth"), "role", "text_md5", "words"
    )
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    tops = ids.select("conv_id", zero.alias("depth"), none.alias("role"), none.alias("text_md5"), zero.alias("words"))
    return taken.unionByName(kept).unionByName(tops)


# --- nodes --------------------------------------------------------------------------------


def prefix_digests(rebuilt: DataFrame) -> DataFrame:
    """conv_id, piece, depth, words, the digest a, b of the prefix, own_a, own_b of its last turn, and
    is_end: whether the conversation ends there."""

    def lane(seed: int):
        mixed = F.xxhash64(F.lit(seed), "depth", "role", "text_md5")
        return F.when(F.col("depth") > 0, mixed).otherwise(F.lit(0).cast("long"))

    rows = materialize(
        rebuilt.select(
            "conv_id",
            F.floor(F.col("depth") / PIECE).alias("piece"),
            "depth",
            "words",
            lane(1).alias("own_a"),
            lane(2).alias("own_b"),
        ),
        "trie-lanes",
    )
    key = ["conv_id", "piece"]
    sums = rows.groupBy(*key).agg(F.bit_xor("own_a").alias("xa"), F.bit_xor("own_b").alias("xb"), F.max("depth").alias("last"))
    every = Window.partitionBy("conv_id")
    before = every.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *key,
        F.coalesce(F.bit_xor("xa").over(before), F.lit(0)).alias("xa"),
        F.coalesce(F.bit_xor("xb").over(before), F.lit(0)).alias("xb"),
        F.max("last").over(every).alias("last"),
    )
    inside = Window.partitionBy(*key).orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(sums, key).select(
        *key,
        "depth",
        "words",
        "own_a",
        "own_b",
        F.bit_xor("own_a").over(inside).bitwiseXOR(F.col("xa")).alias("a"),
        F.bit_xor("own_b").over(inside).bitwiseXOR(F.col("xb")).alias("b"),
        (F.col("depth") == F.col("last")).alias("is_end"),
    )


def _parent(df: DataFrame) -> DataFrame:
    """With the digest of the parent; none for the root."""
    inner = F.col("depth") > 0
    return df.withColumns(
        {
            "parent_depth": F.when(inner, F.col("depth") - 1),
            "parent_a": F.when(inner, F.col("a").bitwiseXOR(F.col("own_a"))),
            "parent_b": F.when(inner, F.col("b").bitwiseXOR(F.col("own_b"))),
        }
    )


PARENT = ["parent_depth", "parent_a", "parent_b"]


def distinct_nodes(prefixes: DataFrame) -> DataFrame:
    """Every distinct digest with n_convs, conv_id (the smallest member), words, n_children, and
    parent_conv_id."""
    counted = materialize(
        _parent(
            prefixes.groupBy(*NODE).agg(
                F.count("*").alias("n_convs"),
                F.min("conv_id").alias("conv_id"),
                F.max("words").alias("words"),
                F.max("own_a").alias("own_a"),
                F.max("own_b").alias("own_b"),
            )
        ).drop("own_a", "own_b"),
        "trie-nodes",
    )
    children = counted.filter("depth > 0").groupBy(*(F.col(p).alias(c) for p, c in zip(PARENT, NODE, strict=True)))
    children = children.agg(F.count("*").alias("n_children"))
    nodes = counted.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialize(nodes, "trie-children")
    bar = nodes.count() / HOT
    owners = nodes.filter("n_children > 0").select(
        *(F.col(c).alias(p) for p, c in zip(PARENT, NODE, strict=True)),
        F.col("conv_id").alias("parent_conv_id"),
        (F.col("n_children") > bar).alias("many"),
    )
    many = owners.filter("many").withColumnRenamed("parent_conv_id", "hot_conv_id").drop("many")
    met = nodes.join(F.broadcast(many), PARENT, "left")
    few = owners.filter("NOT many").drop("many")
    hot = met.filter("hot_conv_id IS NOT NULL OR depth = 0").withColumnRenamed("hot_conv_id", "parent_conv_id")
    cold = met.filter("hot_conv_id IS NULL AND depth > 0").drop("hot_conv_id").join(few, PARENT)
    return hot.unionByName(cold).drop(*PARENT)


# --- shards -------------------------------------------------------------------------------

TOTALS = "depth long, a long, b long, n_leaves long, saved_tokens long"


def _unsigned(x: pd.DataFrame, columns: list[str]) -> np.ndarray:
    return np.stack([x[c].to_numpy(np.int64).view(np.uint64) for c in columns], axis=1)


def accumulate(x: pd.DataFrame, piece: int) -> pd.DataFrame:
    """Subtree sums of one shard, one row per distinct digest in it that has any."""
    keys = _unsigned(x, NODE)
    distinct = np.unique(keys, axis=0)
    table = PerfectHash(distinct)
    slot = table.slots(keys)
    parents = keys.copy()
    parents[:, 0] -= np.uint64(1)
    parents[:, 1] ^= x["own_a"].to_numpy(np.int64).view(np.uint64)
    parents[:, 2] ^= x["own_b"].to_numpy(np.int64).view(np.uint64)
    parent = np.full(table.n, -1, dtype=np.int64)
    # A row that only brings what later pieces own has no turn; the turn's own row is here, too. The
    # first turn of a piece ends the way up: what it has reaches earlier pieces by such rows.
    whole = (x["is_turn"] & (x["depth"] % piece > 0)).to_numpy()
    parent[slot[whole]] = table.slots(parents[whole])
    leaves, saved = np.zeros((2, table.n), dtype=np.int64)
    np.add.at(leaves, slot, x["leaves"].to_numpy(np.int64))
    np.add.at(saved, slot, x["saved"].to_numpy(np.int64))
    depth = table.keys[:, 0].view(np.int64) if table.n else np.zeros(0, np.int64)
    order = np.argsort(depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)[::-1]:
        inner = level[parent[level] >= 0]
        np.add.at(leaves, parent[inner], leaves[inner])
        np.add.at(saved, parent[inner], saved[inner])
    some = (leaves != 0) | (saved != 0)
    a, b = (table.keys[:, i].view(np.int64)[some] for i in (1, 2))
    return pd.DataFrame({"depth": depth[some], "a": a, "b": b, "n_leaves": leaves[some], "saved_tokens": saved[some]})


def subtree_totals(prefixes: DataFrame, nodes: DataFrame, shard: int = SHARD) -> DataFrame:
    """n_leaves and saved_tokens by digest."""
    owned = nodes.select(
        "conv_id",
        "depth",
        (F.col("n_children") == 0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    zero = F.lit(0).cast("long")
    turns = materialize(
        prefixes.join(owned, ["conv_id", "depth"], "left").select(
            "conv_id", "piece", *NODE, "own_a", "own_b", F.lit(True).alias("is_turn"),
            F.coalesce("leaves", zero).alias("leaves"), F.coalesce("saved", zero).alias("saved"),
        ),
        "trie-owned",
    )
    # What later pieces own, at the last turn of every piece but the last.
    end = F.max_by(F.struct(*NODE), "depth").alias("end")
    later = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(1, Window.unboundedFollowing)
    carried = (
        turns.groupBy("conv_id", "piece")
        .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), end)
        .select("conv_id", "piece", "end.*", F.sum("leaves").over(later).alias("leaves"), F.sum("saved").over(later).alias("saved"))
        .filter("leaves != 0 OR saved != 0")
        .select("conv_id", "piece", *NODE, zero.alias("own_a"), zero.alias("own_b"), F.lit(False).alias("is_turn"), "leaves", "saved")
    )
    n = max(1, -(-turns.count() // shard))
    dealt = turns.unionByName(carried).withColumn("shard", F.pmod(F.xxhash64("conv_id", "piece"), F.lit(n)))
    piece = PIECE
    parts = dealt.groupBy("shard").applyInPandas(lambda x: accumulate(x, piece), TOTALS)
    return parts.groupBy(*NODE).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def end_digests(prefixes: DataFrame) -> DataFrame:
    """By digest, SHA-256 of the decimal ids of the conversations that end there, in order, with commas.

    Ids are sorted and joined in blocks of their numbers; blocks are fed to the digest one by one.
    """
    ids = F.array_sort(F.collect_list("conv_id"))
    blocks = (
        prefixes.filter("is_end")
        .groupBy(*NODE, F.floor(F.col("conv_id") / ID_BLOCK).alias("block"))
        .agg(F.array_join(F.transform(ids, lambda v: v.cast("string")), ",").alias("ids"))
        .repartition(*NODE)
        .sortWithinPartitions(*NODE, "block")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state, done = None, None, []
        for x in batches:
            for *key, text in zip(x["depth"], x["a"], x["b"], x["ids"], strict=True):
                if key == node:
                    state.update(b"," + text.encode())
                else:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(text.encode())
            if done:
                yield pd.DataFrame(done, columns=[*NODE, "ends_sha256"])
                done = []
        if node is not None:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=[*NODE, "ends_sha256"])

    return blocks.select(*NODE, "ids").mapInPandas(run, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(rebuilt: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. `rebuilt` has the rows of `rebuilt_turns`."""
    prefixes = materialize(prefix_digests(rebuilt), "trie-prefixes")
    nodes = materialize(distinct_nodes(prefixes), "trie-parents")
    none = hashlib.sha256(b"").hexdigest()
    zero = F.lit(0).cast("long")
    return (
        nodes.join(subtree_totals(prefixes, nodes, shard), NODE, "left")
        .join(end_digests(prefixes), NODE, "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            F.coalesce("n_leaves", zero).alias("n_leaves"),
            F.coalesce("saved_tokens", zero).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
        )
    )
