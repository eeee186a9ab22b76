"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities and counts of words from two lexicons (a short list of English
insults, and words and word beginnings that the labelled training texts show to be typical of
toxic ones), how close such words stand to a second-person word, shares of capitals, shouted words
and punctuation, and rates of obfuscated spelling (digits and signs for letters, stretched
letters), each with the lexicon hits that only appear once the spelling is undone.

The lexicon and the trees are fitted on a bounded sample (`MAX_TOXIC` and `MAX_OTHER` labelled rows
of smallest id hash); each sampled row weighs as many labelled rows of its kind as it stands for, so
trees, calibration and threshold see the toxic share of all labels at any size. Of four folds two fit the trees, one fits the calibration and one is held
out. Every document is scored, on all of its text, inside its row: documents are never shuffled.

Edge cases: null and empty texts have all-zero features and get the score of such a row. A document
with several labels counts as toxic if one says so; null labels and labels of unknown documents are
ignored. Without labels of both kinds every score is the share of toxic labels (0 without labels);
without both kinds in the calibration fold the trees' probability stands. Equal texts get equal
scores. Other columns are kept; result columns replace those of the same names.
Columns of the caller may have any name; those named like a result column are replaced by it.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.names import hidden, shown
from assay.llm.workers import release
from assay.scratch import materialize

FOLDS, HELD_OUT, CALIBRATION = 4, 2, 3
THRESHOLD = 0.3
#: Bounds of the labelled sample that the lexicon and the trees are fitted on.
MAX_TOXIC, MAX_OTHER = 6000, 18000
#: A lexicon entry is in at least this share of the sampled toxic texts, and so many texts.
MIN_SHARE, MIN_TEXTS = 0.002, 5
#: And this many times as frequent (natural log) in toxic texts.
MIN_LOG_ODDS = 2.0
MAX_ENTRIES = 400
STEMS = (4, 5, 6)
NEAR = 5
TREES, DEPTH = 24, 4
#: Calibration gives equal scores to runs of texts; this share of the trees' own order parts them.
ORDER = 0.001

# Insults, second-person words in four languages, signs that stand for letters.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb fool loser losers scum trash garbage filth pathetic "
    "worthless disgusting clown jerk creep freak coward liar pig bastard bitch ass asshole crap "
    "damn hell shit fuck fucking hate kill die ugly retard vermin parasite imbecile".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine euch ihr tu te toi ton ta tes "
    "vous votre vos ti tú usted ustedes vosotros".split()
)
SIGNS = str.maketrans("013457@$!|€", "oieastasiie")
FEATURES = [
    "weight_density",
    "hits",
    "distinct_hits",
    "hit_density",
    "insult_density",
    "second_person_density",
    "hits_near_second_person",
    "undone_hits",
    "obfuscated_share",
    "stretched_share",
    "shouted_share",
    "capital_share",
    "exclamation_share",
    "punctuation_share",
    "words",
]
EDGE = re.compile(r"^\W+|\W+$")
STRETCHED = re.compile(r"(\w)\1\1")
INNER = re.compile(r"[^\w]")
#: Tokens whose features a worker remembers.
CACHE = 50_000


def entries_of(word: str) -> list[str]:
    """Lexicon entries that a word counts for: itself, and its beginnings (written with a dash)."""
    return [word, *(word[:n] + "-" for n in STEMS if len(word) > n)]


def words_of(text: str) -> list[str]:
    return [w for w in (EDGE.sub("", t).lower() for t in text.split()) if w]


class Features:
    """Feature rows of texts, for one lexicon."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.seen: dict[str, tuple | bool] = {}
        self.words = {e: x for e, x in lexicon.items() if not e.endswith("-")}
        self.stems = {e[:-1]: x for e, x in lexicon.items() if e.endswith("-")}

    def _weight(self, word: str) -> float:
        """The largest weight of the word's entries (`entries_of`)."""
        best, get, size = self.words.get(word, 0.0), self.stems.get, len(word)
        for n in STEMS:
            if size <= n:
                break
            best = max(best, get(word[:n], 0.0))
        return max(best, 0.0)

    def _token(self, token: str) -> tuple | bool:
        """weight, insult, second person, only hit once undone, obfuscated, stretched, shouted and the
        word; False if it is none of these, as most are."""
        word = token if token.isalpha() else EDGE.sub("", token)
        low = word.lower()
        weight = self._weight(low) if low else 0.0
        plain, odd = low, False
        # Letters alone hold no sign to undo.
        if not low.isalpha():
            plain = INNER.sub("", low.translate(SIGNS).replace("*", ""))
            odd = plain != low and any(map(str.isalpha, low))
        stretched = bool(STRETCHED.search(low))
        undone = 0.0
        if (odd or stretched) and not weight:
            plain = re.sub(r"(\w)\1\1+", r"\1", plain)
            undone = max(self._weight(plain), float(plain in INSULTS))
        shouted = len(word) > 2 and word.isupper()
        insult, second = low in INSULTS, low in SECOND_PERSON
        if not (weight or undone or insult or second or odd or stretched or shouted):
            return False
        return (weight or undone, insult, second, undone > 0, odd, stretched, shouted, low)

    def _known(self, token: str) -> tuple | bool:
        seen = self.seen
        known = seen.get(token)
        if known is None:
            if len(seen) >= CACHE:
                seen.clear()
            known = seen[token] = self._token(token)
        return known

    def row(self, text: str) -> list[float]:
        tokens = text.split()
        if not tokens:
            return [0.0] * len(FEATURES)
        found = list(map(self.seen.get, tokens))
        found = [self._known(t) if known is None else known for t, known in zip(tokens, found, strict=True)]
        marked = [(i, known) for i, known in enumerate(found) if known]
        at = [i for i, _ in marked]
        nothing = [()] * 8
        weight, insult, second, undone, odd, stretched, shouted, low = zip(*(x for _, x in marked), strict=True) if marked else nothing
        n = len(tokens)
        own = [k for k, (w, x) in enumerate(zip(weight, insult, strict=True)) if w or x]
        hit = [at[k] for k in own]
        you = np.array([i for i, x in zip(at, second, strict=True) if x], dtype=np.int64)
        near = 0
        if hit and len(you):
            place = np.searchsorted(you, hit)
            after = np.abs(you[np.minimum(place, len(you) - 1)] - hit)
            before = np.abs(you[np.maximum(place - 1, 0)] - hit)
            near = int((np.minimum(after, before) <= NEAR).sum())
        chars = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
        capitals, small = chars[65:91].sum(), chars[97:123].sum() + chars[0xC3]
        signs = chars[33:48].sum() + chars[58:65].sum() + chars[91:97].sum() + chars[123:127].sum()
        return [
            sum(weight) / n,
            float(len(hit)),
            float(len({low[k] for k in own})),
            len(hit) / n,
            sum(insult) / n,
            len(you) / n,
            float(near),
            float(sum(undone)),
            sum(odd) / n,
            sum(stretched) / n,
            sum(shouted) / n,
            float(capitals / max(1, capitals + small)),
            float((chars[33] + chars[63]) / len(text)),
            float(signs / len(text)),
            float(np.log1p(n)),
        ]


def feature_column(text: Column, lexicon: dict[str, float]) -> Column:
    """array<double> of `FEATURES`."""

    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rows = Features(lexicon)
        for texts in batches:
            yield pd.Series([rows.row(t) for t in texts])
        rows.seen.clear()
        release()

    return F.pandas_udf(features, "array<double>")(F.coalesce(text, F.lit("")))


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """doc_id, text, label, fold and weight of the sampled labelled documents; none is held out. The
    weight is the number of labelled documents of the same kind for each sampled one."""
    marks = (
        labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("_id"))
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .withColumn("fold", fold_of(F.col("_id")))
        .filter(F.col("fold") != HELD_OUT)
    )
    ids = docs.select(F.col(doc_id).alias("_id")).distinct()
    known = materialize(marks.join(ids, "_id", "left_semi"), "tox-labels")
    order = F.xxhash64("_id", F.lit(4))
    full = {r.is_toxic: r["count"] for r in known.groupBy((F.col("label") == 1).alias("is_toxic")).count().collect()}

    def smallest(is_toxic: bool, most: int) -> DataFrame:
        n = full.get(is_toxic, 0)
        rows = known.filter((F.col("label") == 1) == is_toxic).orderBy(order, "_id").limit(most)
        return rows.withColumn("weight", F.lit(n / max(1, min(n, most))))

    chosen = F.broadcast(smallest(True, MAX_TOXIC).unionByName(smallest(False, MAX_OTHER)))
    texts = docs.select(F.col(doc_id).alias("_id"), F.coalesce(text, F.lit("")).alias("text"))
    return materialize(texts.join(chosen, "_id"), "tox-sample")


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Entries typical of toxic texts with their log odds; at most MAX_ENTRIES."""
    counts = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    toxic, other = counts.get(1, 0), sum(n for k, n in counts.items() if k != 1)
    if not toxic or not other:
        return {}

    def count(only: frozenset | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found: Counter = Counter()
            for x in batches:
                for t in x["text"]:
                    own = {e for w in set(words_of(t)) for e in entries_of(w)}
                    found.update(own if only is None else own & only)
            # A part without such texts has no frame: an empty one has no type for its columns.
            if found:
                yield pd.DataFrame({"entry": list(found), "n": list(found.values())})

        return run

    def texts_with(rows: DataFrame, only: frozenset | None, least: float) -> dict[str, int]:
        parts = rows.select("text").mapInPandas(count(only), "entry string, n long")
        total = parts.groupBy("entry").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        return {r.entry: r.n for r in total.collect()}

    # The first count leaves few entries: each is in MIN_SHARE of a bounded number of texts.
    inside = texts_with(sample.filter("label = 1"), None, max(MIN_TEXTS, MIN_SHARE * toxic))
    outside = texts_with(sample.filter("label != 1"), frozenset(inside), 1)
    odds = {
        e: np.log((n + 0.5) / (toxic + 1)) - np.log((outside.get(e, 0) + 0.5) / (other + 1))
        for e, n in inside.items()
    }
    strong = [e for e, x in odds.items() if x >= MIN_LOG_ODDS]
    # The most telling first; a word or stem whose texts a shorter stem has all but all is left out.
    strong.sort(key=lambda e: (-odds[e] * np.sqrt(inside[e]), e))
    return {e: float(odds[e]) for e in strong[:MAX_ENTRIES]}


@dataclass
class ToxicityModel:
    """A fitted model; `prior` is the score where there was nothing to fit."""

    prior: float
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """`docs` with score (0 to 1) and predicted (1 from THRESHOLD on)."""
        docs, names = hidden(docs, "score", "predicted")
        if self.trees is None:
            scored = docs.withColumn("score", F.lit(self.prior))
        else:
            scored = docs.withColumn("_f", array_to_vector(feature_column(F.col(names[text]), self.lexicon)))
            scored = self.trees.transform(scored).withColumn("_p", vector_to_array("_prob")[1])
            if self.calibration is None:
                scored = scored.withColumn("score", F.col("_p"))
            else:
                scored = self.calibration.transform(scored).withColumn(
                    "score", (1 - ORDER) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_c")) + ORDER * F.col("_p")
                )
        return scored.select(*shown(names), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic"
) -> ToxicityModel:
    """Fit on the labelled documents whose fold isn't held out."""
    sample = labelled_sample(docs, labels, doc_id, text, label)
    kinds = sample.groupBy("fold", (F.col("label") == 1).alias("is_toxic"))
    by = {(r.fold, r.is_toxic): r.weight for r in kinds.agg(F.sum("weight").alias("weight")).collect()}
    n, toxic = sum(by.values()), sum(k for (_, is_toxic), k in by.items() if is_toxic)
    fit = [sum(k for (f, t), k in by.items() if f != CALIBRATION and t == x) for x in (False, True)]
    if not all(fit):
        return ToxicityModel(toxic / n if n else 0.0, {})
    lexicon = learn_lexicon(sample.filter(F.col("fold") != CALIBRATION))
    rows = materialize(
        sample.select("fold", F.col("label").cast("double").alias("label"), "weight", feature_column(F.col("text"), lexicon).alias("f")),
        "tox-features",
    ).select("fold", "label", "weight", array_to_vector("f").alias("_f"))
    cores = sample.sparkSession.sparkContext.defaultParallelism
    trees = GBTClassifier(
        labelCol="label",
        weightCol="weight",
        featuresCol="_f",
        predictionCol="_class",
        maxIter=TREES,
        maxDepth=DEPTH,
        stepSize=0.3,
        minInstancesPerNode=5,
        seed=4,
    )
    grown_on = rows.filter(F.col("fold") != CALIBRATION).coalesce(cores).cache()
    trees = trees.setProbabilityCol("_prob").setRawPredictionCol("_raw").fit(grown_on)
    grown_on.unpersist()
    calibration = None
    if by.get((CALIBRATION, True)) and by.get((CALIBRATION, False)):
        held = trees.transform(rows.filter(F.col("fold") == CALIBRATION)).select("label", "weight", vector_to_array("_prob")[1].alias("_p"))
        calibration = IsotonicRegression(labelCol="label", weightCol="weight", featuresCol="_p", predictionCol="_c").fit(held)
    return ToxicityModel(toxic / n, lexicon, trees, calibration)


def score_documents(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic"
) -> DataFrame:
    """`docs` with held_out, score and predicted."""
    model = fit_toxicity(docs, labels, doc_id, text, label)
    return model.score(docs.withColumn("held_out", F.coalesce(fold_of(F.col(doc_id)) == HELD_OUT, F.lit(False))), text)
