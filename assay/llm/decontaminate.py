"""Benchmark decontamination by latent semantic retrieval.

Texts are read as words (lower case, punctuation aside) and cut in passages of `PASSAGE` words, a
new one every `STRIDE`; benchmark items longer than `STRIDE` words are cut in pieces, so every
piece that a text holds lies whole in one of its passages. Passages are TF-IDF vectors over the
words of the benchmark, with document frequencies counted over all passages of the corpus. A
randomised SVD of all passages and the items (a Gaussian sketch through A'A, summed over Spark's
tasks, and the Nystroem form of its eigenproblem, so that the passages are read once) gives the
latent space. Every passage of every text is searched there: the pieces whose cosine to it reaches
`MIN_COSINE` are its candidates.

The cosine of a few words or of a loose paraphrase can fall below that limit, so pairs under it are
taken up as well if the passage has enough of the piece's rarer words to hold its subsequence (an
exact bound by postings of these words): no pair that meets the rule below is lost. A match whose
`cosine` is below the limit was found this way.

A candidate counts as contaminated if the longest common subsequence of words with the piece has at
least `MIN_LCS` of its words, and, below `SURE_LCS`, if the passage also holds most of the piece's
last words, its answer, in order.
So a copy is found with words left out, put in or replaced here and there.

Words that are in over `COMMON` of the passages carry no weight in the vectors (they do count in
the subsequence), unless an item would be left with too few others.

The items are collected in blocks of `BLOCK` pieces, each with a latent space of its own, so what
is sent to the executors is bounded whatever the benchmark's size.

Edge cases: null and empty texts, and items without words, match nothing. Pieces of fewer than
`SHORT` words must be there word for word. Equal items are found under each of their ids; repeated
rows of a document are judged alike and give one row. A null doc_id gives no row in the matches
and is kept by `decontaminate`. Other columns are kept there and left out of the matches.
Columns of the caller may have any name; those named like a result column are replaced by it.
"""

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.names import hidden, shown
from assay.llm.workers import releasing
from assay.scratch import materialize

PASSAGE, STRIDE = 96, 48
RANK, EXTRA = 96, 16
COMMON = 0.1
MIN_COSINE = 0.4
MIN_LCS, SURE_LCS = 0.6, 0.8
ANSWER_WORDS, MIN_ANSWER = 6, 0.6
SHORT = 8
#: Pieces of items that are searched for at once.
BLOCK = 4096
#: Words of texts that are cut into passages together; passages that are multiplied at once, and
#: those whose cosines are.
CHUNK = 100_000
DENSE, PART = 48, 512
#: Words of over this share of the pieces are frequent in the benchmark; a piece has so many others.
BENCHMARK_COMMON, LEAST_RARE = 0.05, 4
WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass
class Items:
    """A block of benchmark pieces as word numbers."""

    ids: list
    pieces: list[np.ndarray]
    vocabulary: dict[str, int]
    weight: np.ndarray | None = None
    masks: dict = field(default_factory=dict)

    def mask(self, i: int) -> dict[int, int]:
        """For each word of a piece, the bits of its places."""
        if i not in self.masks:
            own: dict[int, int] = {}
            for place, w in enumerate(self.pieces[i].tolist()):
                own[w] = own.get(w, 0) | 1 << place
            self.masks[i] = own
        return self.masks[i]


def pieces_of(words: list) -> list[list]:
    """Pieces of at most STRIDE words, of about equal length."""
    n = math.ceil(len(words) / STRIDE)
    cuts = [round(i * len(words) / n) for i in range(n + 1)] if n else [0]
    return [words[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def item_blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[Items]:
    """The benchmark in blocks of about BLOCK pieces."""
    rows = benchmark.filter(F.col(text).isNotNull()).select(item_id, text).distinct()
    ids, pieces = [], []
    for row in rows.orderBy(item_id, text).toLocalIterator():
        for piece in pieces_of(words_of(row[1])):
            ids.append(row[0])
            pieces.append(piece)
        if len(pieces) >= BLOCK:
            yield _numbered(ids, pieces)
            ids, pieces = [], []
    if pieces:
        yield _numbered(ids, pieces)


def _numbered(ids: list, pieces: list[list[str]]) -> Items:
    vocabulary = {w: i for i, w in enumerate(sorted({w for p in pieces for w in p}))}
    return Items(ids, [np.array([vocabulary[w] for w in p], dtype=np.int32) for p in pieces], vocabulary)


def _index(items: Items) -> tuple[np.ndarray, ...]:
    """For an exact bound on what a passage can share with a piece: postings of the words that are
    rare in the benchmark (first posting and their number per word; piece and count per posting),
    and how many of its rare words a piece needs to be found.

    A piece needs a share of all its words; if at most its frequent ones come for nothing, the rest
    must be rare ones. Words are called rare until every piece needs some.
    """
    size, n = len(items.vocabulary), len(items.pieces)
    owner = np.repeat(np.arange(n), [len(p) for p in items.pieces])
    cell, count = np.unique(np.concatenate(items.pieces).astype(np.int64) * n + owner, return_counts=True)
    word, piece = cell // n, cell % n
    spread = np.bincount(word, minlength=size)
    rare = spread <= max(1, BENCHMARK_COMMON * n)
    wanted = np.array([len(p) if len(p) < SHORT else math.ceil(MIN_LCS * len(p)) for p in items.pieces])
    for p, least in zip(items.pieces, wanted, strict=True):
        for w in sorted(set(p.tolist()), key=lambda w: spread[w]):
            if least - int((~rare[p]).sum()) >= min(LEAST_RARE, least):
                break
            rare[w] = True
    need = wanted - np.array([int((~rare[p]).sum()) for p in items.pieces])
    on = rare[word]
    first = np.searchsorted(word[on], np.arange(size))
    number = np.bincount(word[on], minlength=size)
    return first, number, piece[on], count[on], need


ENCODED = "_id long, n int, at binary, words binary, able binary"


def _pairs(index: tuple, held: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Of passages with their words, each once: the pairs passage * pieces + piece where the passage
    has enough of the piece's rare words to hold its subsequence."""
    first, postings, piece, count, need = index
    times = postings[word]
    at = np.repeat(first[word], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    pair, inverse = np.unique(np.repeat(held, times) * len(need) + piece[at], return_inverse=True)
    return pair[np.bincount(inverse, count[at], len(pair)) >= need[pair % len(need)]]


def _cut(number: np.ndarray, text: np.ndarray, place: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
    """Passage, place and word of all passages of texts, which have `number` of them each, in order.
    Given are the text, place and number of each word of the benchmark in them."""
    base = np.cumsum(number) - number
    # A word lies in the passage of its own stride and in the one that begins a stride before.
    own = base[text] + place // STRIDE
    second = np.flatnonzero(place >= STRIDE)
    passage = np.concatenate([own, own[second] - 1])
    order = np.argsort(passage, kind="stable")
    place, word = (np.concatenate([x, x[second]])[order] for x in (place, word))
    return passage[order], place, word


def _encode(docs: DataFrame, doc_id: str, text: str, items: Items) -> DataFrame:
    """Rows of texts (number of passages, places and word numbers of the words that the benchmark
    has, and the pairs passage * pieces + piece within the exact bound), and from each task a row
    without document: in how many of its passages each word is, and the number of its passages."""
    sent = docs.sparkSession.sparkContext.broadcast((items.vocabulary, _index(items)))
    size, pieces = len(items.vocabulary), len(items.pieces)
    names = ["_id", "n", "at", "words", "able"]

    def rows(ids: list, found: list[np.ndarray], index: tuple, counts: np.ndarray) -> pd.DataFrame:
        number = np.array([-(-len(x) // STRIDE) for x in found])
        places = [np.flatnonzero(x >= 0).astype(np.int32) for x in found]
        words = [x[at] for x, at in zip(found, places, strict=True)]
        text = np.repeat(np.arange(len(found)), [len(x) for x in words])
        passage, _, word = _cut(number, text, np.concatenate(places), np.concatenate(words))
        cell = np.unique(passage * size + word)
        counts[:size] += np.bincount(cell % size, minlength=size)
        counts[size] += number.sum()
        pair = _pairs(index, cell // size, cell % size)
        ends = np.cumsum(number) * pieces
        cuts = [0, *np.searchsorted(pair, ends).tolist()]
        out = [
            (i, n, at.tobytes(), own.tobytes(), (pair[a:b] - (end - n * pieces)).tobytes())
            for i, n, at, own, end, a, b in zip(ids, number.tolist(), places, words, ends, cuts, cuts[1:], strict=False)
            if len(own)
        ]
        return pd.DataFrame(out, columns=names).astype({"_id": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, index = sent.value
        get, counts = vocabulary.get, np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            ids, found, total = [], [], 0
            for i, t in zip(batch["_id"], batch["_text"], strict=True):
                words = words_of(t)
                if words:
                    ids.append(i)
                    found.append(np.fromiter(map(get, words, repeat(-1)), np.int32, len(words)))
                    total += len(words)
                if total >= CHUNK:
                    yield rows(ids, found, index, counts)
                    ids, found, total = [], [], 0
            if ids:
                yield rows(ids, found, index, counts)
        last = pd.DataFrame([(None, 0, b"", counts.tobytes(), b"")], columns=names)
        yield last.astype({"_id": "Int64"})

    texts = docs.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    texts = texts.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    return texts.mapInPandas(releasing(run), ENCODED)


def _passages(x: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Passage, place and word of all passages of encoded texts, in order."""
    text = np.repeat(np.arange(len(x)), x["words"].str.len().to_numpy() // 4)
    place, word = (np.frombuffer(b"".join(x[c]), np.int32) for c in ("at", "words"))
    return _cut(x["n"].to_numpy().astype(np.int64), text, place, word)


def _frequencies(encoded: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Passages that hold each word, and all passages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(size + 1, dtype=np.int64)
        for x in batches:
            for part in x["words"]:
                counts += np.frombuffer(part, np.int64)
        yield pd.DataFrame({"word": np.arange(size + 1), "n": counts})

    parts = encoded.filter("_id IS NULL").mapInPandas(run, "word long, n long")
    total = parts.groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size + 1, dtype=np.int64)
    counts[total["word"].to_numpy()] = total["n"].to_numpy()
    return counts[:size], int(counts[size])


def _vectors(passage: np.ndarray, word: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unit TF-IDF rows, sparse: row number, word, value; and which passage each row is."""
    on = weight[word] > 0
    passage, word = passage[on], word[on]
    if not len(word):
        return (np.zeros(0, np.int64), word, np.zeros(0), np.zeros(0, np.int64))
    size = np.int64(len(weight))
    cell, count = np.unique(passage.astype(np.int64) * size + word, return_counts=True)
    owner, word = cell // size, cell % size
    value = (1 + np.log(count)) * weight[word]
    names, row = np.unique(owner, return_inverse=True)
    norm = np.sqrt(np.bincount(row, value * value))
    return row, word, value / norm[row], names


def _dense(row, word, value) -> Iterator[tuple]:
    """DENSE rows at a time: which rows, the words that they have and their values as a matrix."""
    n = int(row[-1]) + 1 if len(row) else 0
    cuts = np.searchsorted(row, np.arange(0, n + DENSE, DENSE))
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        first = i * DENSE
        words, at = np.unique(word[a:b], return_inverse=True)
        block = np.zeros((min(DENSE, n - first), len(words)), np.float32)
        block[row[a:b] - first, at] = value[a:b]
        yield slice(first, first + len(block)), words, block


def _project(row, word, value, basis: np.ndarray) -> np.ndarray:
    """Rows times basis."""
    out = np.zeros((int(row[-1]) + 1 if len(row) else 0, basis.shape[1]), np.float32)
    for rows, words, block in _dense(row, word, value):
        out[rows] = block @ basis[words]
    return out


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parts of texts with at most about CHUNK words of the benchmark, and passages in proportion."""
    for batch in batches:
        size = batch["words"].str.len() // 4 + STRIDE // 2 * batch["n"].astype("int64")
        part = (size.cumsum() // CHUNK).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.iloc[a:b].reset_index(drop=True)


def word_weights(items: Items, frequency: np.ndarray, passages: int) -> np.ndarray:
    """Inverse passage frequencies; 0 for words in too many passages."""
    weight = np.log((passages + 1) / (frequency + 0.5))
    common = frequency > COMMON * max(1, passages)
    for piece in items.pieces:
        own = np.unique(piece)
        # A piece keeps at least its four rarest words.
        common[own[np.argsort(frequency[own], kind="stable")[:4]]] = False
    return np.where(common, 0.0, np.maximum(weight, 0.1))


def _item_rows(items: Items) -> tuple[np.ndarray, ...]:
    owner = np.repeat(np.arange(len(items.pieces)), [len(p) for p in items.pieces])
    return _vectors(owner, np.concatenate(items.pieces), items.weight)


def _gram_times(encoded: DataFrame, items: Items, basis: np.ndarray) -> np.ndarray:
    """A'A times the basis, A being all unit rows of corpus passages and, as heavy as all of them
    together, of the items."""
    size, rank = basis.shape
    sent = encoded.sparkSession.sparkContext.broadcast((items.weight, basis.astype(np.float32)))

    def add(total: np.ndarray, row, word, value, basis: np.ndarray) -> None:
        basis = basis.astype(np.float32, copy=False)
        for _, words, block in _dense(row, word, value):
            total[words] += block.T @ (block @ basis[words])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, basis = sent.value
        total, rows = np.zeros((size, rank)), 0
        for x in _batches(batches):
            passage, _, word = _passages(x)
            row, word, value, names = _vectors(passage, word, weight)
            add(total, row, word, value, basis)
            rows += len(names)
        if rows:
            used = np.flatnonzero(total.any(axis=1))
            out = pd.DataFrame(total[used], columns=[f"c{i}" for i in range(rank)])
            out.insert(0, "word", used)
            yield out
            yield pd.DataFrame([[-1, float(rows), *[0.0] * (rank - 1)]], columns=out.columns)

    columns = [f"c{i}" for i in range(rank)]
    schema = ", ".join(["word long", *(f"{c} double" for c in columns)])
    parts = encoded.mapInPandas(releasing(run), schema).groupBy("word").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()
    total, rows = np.zeros((size, rank)), 0.0
    if len(parts):
        word = parts["word"].to_numpy()
        values = parts[columns].to_numpy()
        rows = float(values[word < 0, 0].sum())
        total[word[word >= 0]] = values[word >= 0]
    row, word, value, names = _item_rows(items)
    own = np.zeros_like(total)
    add(own, row, word, value, basis)
    return total + own * max(1.0, rows / max(1, len(names)))


def latent_basis(encoded: DataFrame, items: Items, rank: int = RANK, seed: int = 5) -> np.ndarray:
    """Right singular vectors of the passages (words x rank) by randomised SVD."""
    size = len(items.vocabulary)
    rank = min(rank, size, len(items.pieces) + EXTRA)
    wide = min(size, rank + EXTRA)
    sketch, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, wide)))
    times = _gram_times(encoded, items, sketch)
    small = sketch.T @ times
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    on = values > max(values.max(), 0.0) * 1e-6
    root = times @ (vectors[:, on] / np.sqrt(values[on]))
    return np.linalg.svd(root, full_matrices=False)[0][:, :rank].astype(np.float32)


def lcs(mask: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence with a sequence of n words, given as a bit mask per
    word (bit-parallel: a cleared bit marks a row where the length grows)."""
    full = (1 << n) - 1
    v = full
    for w in words:
        hit = v & mask.get(w, 0)
        if hit:
            v = ((v + hit) | (v - hit)) & full
    return n - v.bit_count()


def judge(items: Items, i: int, words: list[int], places: np.ndarray) -> tuple[float, float] | None:
    """Share of a piece's words that a passage has in order, and the same of its answer; None if
    that isn't enough. places: where the passage's words stand (others stand between them)."""
    piece = items.pieces[i]
    n = len(piece)
    if n < SHORT:
        there = any(
            words[k : k + n] == piece.tolist() and places[k + n - 1] - places[k] == n - 1
            for k in range(len(words) - n + 1)
        )
        return (1.0, 1.0) if there else None
    found = lcs(items.mask(i), n, words) / n
    if found < MIN_LCS:
        return None
    tail = piece[-ANSWER_WORDS:].tolist()
    mask: dict[int, int] = {}
    for place, w in enumerate(tail):
        mask[w] = mask.get(w, 0) | 1 << place
    answer = lcs(mask, len(tail), words) / len(tail)
    return (found, answer) if found >= SURE_LCS or answer >= MIN_ANSWER else None


MATCHES = "_id long, piece int, cosine double, lcs double, answer double"


def _search(encoded: DataFrame, items: Items, basis: np.ndarray) -> DataFrame:
    """Contaminated (document, piece) pairs, one row per passage that shows it."""
    row, word, value, names = _item_rows(items)
    latent = np.zeros((len(items.pieces), basis.shape[1]), np.float32)
    if len(row):
        latent[names] = _project(row, word, value, basis)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    sent = encoded.sparkSession.sparkContext.broadcast((items, basis, latent))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, basis, latent = sent.value
        pieces, lengths = len(items.pieces), np.array([len(p) for p in items.pieces])
        for x in _batches(batches):
            passage, place, words = _passages(x)
            number = x["n"].to_numpy().astype(np.int64)
            base, total = np.cumsum(number) - number, int(number.sum())
            cuts = np.searchsorted(passage, np.arange(total + 1))
            row, word, value, own = _vectors(passage, words, items.weight)
            y = np.zeros((total, basis.shape[1]), np.float32)
            y[own] = _project(row, word, value, basis)
            y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
            near = [np.zeros(0, np.int64)]
            for a in range(0, total, PART):
                p, i = np.nonzero(y[a : a + PART] @ latent.T >= MIN_COSINE)
                # No more words can be common than both have.
                enough = np.diff(cuts[a : a + PART + 1])[p] >= MIN_LCS * lengths[i]
                near.append((a + p[enough]) * pieces + i[enough])
            able = np.repeat(base * pieces, x["able"].str.len().to_numpy() // 8)
            able = able + np.frombuffer(b"".join(x["able"]), np.int64)
            doc = x["_id"].to_numpy()[np.repeat(np.arange(len(x)), number)]
            rows, last, text = [], -1, []
            for cell in np.union1d(np.concatenate(near), able).tolist():
                p, i = divmod(cell, pieces)
                a, b = cuts[p], cuts[p + 1]
                if p != last:
                    last, text = p, words[a:b].tolist()
                verdict = judge(items, i, text, place[a:b])
                if verdict:
                    rows.append((doc[p], i, float(y[p] @ latent[i]), *verdict))
            if rows:
                yield pd.DataFrame(rows, columns=["_id", "piece", "cosine", "lcs", "answer"])

    return encoded.mapInPandas(releasing(run), MATCHES)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """doc_id, item_id, cosine, lcs and answer of the best passage, one row per contaminated
    document and item."""
    spark = docs.sparkSession
    kind = benchmark.schema[item_id].dataType.simpleString()
    columns = f"doc_id long, item_id {kind}, cosine double, lcs double, answer double"
    found = spark.createDataFrame([], columns)
    for items in item_blocks(benchmark, item_id, item_text):
        encoded = materialize(_encode(docs, doc_id, text, items), "encoded")
        frequency, passages = _frequencies(encoded, len(items.vocabulary))
        items.weight = word_weights(items, frequency, passages)
        encoded = encoded.filter("_id IS NOT NULL")
        matches = _search(encoded, items, latent_basis(encoded, items))
        names = spark.createDataFrame(list(enumerate(items.ids)), f"piece int, item_id {kind}")
        best = F.max(F.struct("lcs", "answer", "cosine")).alias("m")
        rows = matches.join(F.broadcast(names), "piece").groupBy(F.col("_id").alias("doc_id"), "item_id").agg(best)
        found = found.unionByName(rows.select("doc_id", "item_id", "m.cosine", "m.lcs", "m.answer"))
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without contaminated documents."""
    gone = materialize(contaminated(docs, benchmark, doc_id, text).select(F.col("doc_id").alias("_gone")).distinct(), "leaks")
    rows, names = hidden(docs)
    return rows.join(gone, F.col(names[doc_id]).cast("long") == F.col("_gone"), "left_anti").select(shown(names))
