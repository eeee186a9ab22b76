"""URL allow and block rules by a Bloom filter cascade.

Every url has a handful of candidate keys: each suffix of its host with each prefix of its path,
in the shapes (labels of the host, characters of the path) that occur among the rules. The
distinct candidate keys of the whole corpus are the key universe. Level 0 of a cascade is a Bloom
filter of the listed keys, level 1 one of the universe's keys that pass level 0 unlisted, level 2
one of the listed keys that pass level 1, and so on until nothing passes wrongly. A key is then
listed when the first level that rejects it has an odd number: exact over the universe, with no
join when urls are judged. A second cascade, over the listed keys alone, holds which of them block.

Edge cases: a null url or one without `://` has an empty host and path and gets the default
verdict; so does every url where no rule fits. A rule that is both allowed and blocked blocks.
Of several rules that fit, the longest wins, then the one with the longer host. Null rules are
ignored. Repeated urls are judged one by one; other columns are kept, except that the four result
columns replace columns of the same names.
Columns of the caller may have any name; those named like a result column are replaced by it.
"""

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.names import hidden, shown
from assay.scratch import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Largest filter that is sent to every executor; longer lists are looked up by a shuffled join.
MAX_FILTER_BYTES = 256 << 20
#: More levels than any run can need: each is passed wrongly by half of what the last one let by.
MAX_LEVELS = 100
SHARE = 0.5


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; A-Z lower-cased."""
    host = F.regexp_extract(url, URL, 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


def rule_shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """(labels of the host, characters of the path) of all rules; few, whatever their number."""
    host = F.substring_index("rule", "/", 1)
    shape = rules.select(
        _labels(host).alias("labels"), (F.length("rule") - F.length(host)).alias("chars")
    )
    return sorted((r.labels, r.chars) for r in shape.distinct().collect())


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Keys that a rule could have, the longest first."""
    found = []
    for labels, chars in shapes:
        suffix = F.substring_index(host, ".", -labels)
        key = F.concat(suffix, F.substring(path, 1, chars))
        fits = (_labels(host) >= labels) & (F.length(path) >= chars)
        rank = F.struct((-F.length(key)).alias("n"), (-F.length(suffix)).alias("h"), key.alias("key"))
        found.append(F.when(fits, rank))
    return F.transform(F.array_sort(F.array_compact(F.array(*found))), lambda x: x["key"])


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """Other hashes for every level, out of the same two (the finaliser of splitmix64)."""
    x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Level:
    """One Bloom filter."""

    number: int
    n_bits: int
    n_hashes: int
    words: np.ndarray | None = None

    @classmethod
    def of(cls, number: int, n: int, share: float) -> "Level":
        """Sized for n keys and a share of wrong passes."""
        bits = max(64, int(np.ceil(n * np.log2(1 / share) / np.log(2))))
        return cls(number, -(-bits // 64) * 64, max(1, round(np.log2(1 / share))))

    def positions(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        a, b = _mix(h1, 2 * self.number), _mix(h2, 2 * self.number + 1)
        at = np.arange(self.n_hashes, dtype=np.uint64)[:, None]
        return ((a + at * (b | np.uint64(1))) % np.uint64(self.n_bits)).astype(np.int64)

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        p = self.positions(h1, h2)
        return ((self.words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)).all(axis=0)

    def fill(self, keys: DataFrame) -> "Level":
        """Set the bits of all keys: each task ORs its own, Spark ORs the words of the tasks."""
        empty = Level(self.number, self.n_bits, self.n_hashes)

        def words(batches):
            for x in batches:
                p = empty.positions(x["h1"].to_numpy(), x["h2"].to_numpy()).ravel()
                bit = np.left_shift(np.uint64(1), (p & 63).astype(np.uint64)).view(np.int64)
                yield pd.DataFrame({"word": p >> 6, "bits": bit})

        rows = keys.select("h1", "h2").mapInPandas(words, "word long, bits long")
        self.words = np.zeros(self.n_bits // 64, dtype=np.uint64)
        found = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
        self.words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
        return self


@dataclass
class Cascade:
    """Exact membership for every key of the universe it was built over."""

    levels: list[Level] = field(default_factory=list)

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """A key that the first k levels pass and level k rejects is listed when k is odd."""
        member = np.full(len(h1), len(self.levels) % 2 == 1)
        left = np.arange(len(h1))
        for level in self.levels:
            passed = level.holds(h1[left], h2[left])
            member[left[~passed]] = level.number % 2 == 1
            left = left[passed]
        return member


def build_cascade(universe: DataFrame, listed: str) -> Cascade:
    """Cascade of the keys whose boolean column `listed` holds; universe: h1, h2, listed."""
    cascade, inside = Cascade(), True
    counts = {r[0]: r[1] for r in universe.groupBy(listed).count().collect()}
    include = universe.filter(F.col(listed))
    exclude = universe.filter(~F.col(listed))
    n, against = counts.get(True, 0), counts.get(False, 0)
    while n:
        if len(cascade.levels) >= MAX_LEVELS:
            raise RuntimeError("two keys have the same hashes; the cascade can't tell them apart")
        # The first level lets by about as many foreign keys as it lists, the others half.
        share = SHARE if cascade.levels else min(SHARE, max(n / max(against, 1), 2.0**-40))
        level = Level.of(len(cascade.levels), n, share).fill(include)
        cascade.levels.append(level)
        passes = F.pandas_udf(lambda a, b, level=level: pd.Series(level.holds(a.to_numpy(), b.to_numpy())), "boolean")
        wrong = materialize(exclude.filter(passes("h1", "h2")), "cascade")
        include, exclude, inside = wrong, include, not inside
        n = wrong.count()
    return cascade


def filter_urls(
    urls: DataFrame,
    rules: DataFrame,
    url: str = "url",
    default: str = "allow",
    max_filter_bytes: int = MAX_FILTER_BYTES,
) -> DataFrame:
    """`urls` with host, path, rule (the longest that fits, else null) and verdict.

    rules: `rule` (host and path, such as `example.com/en/`) and `action` (allow or block).
    """
    rules = rules.filter(F.col("rule").isNotNull()).select(
        "rule", (F.col("action") == "block").alias("blocks")
    )
    shapes = rule_shapes(rules)
    kept, names = hidden(urls, "host", "path", "rule", "verdict")
    out = [*shown(names), "host", "path", "rule", "verdict"]
    judged = kept.withColumns({"host": host_of(F.col(names[url])), "path": path_of(F.col(names[url]))})
    if not shapes:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)}).select(out)
    keys = candidate_keys(F.col("host"), F.col("path"), shapes)
    corpus = judged.select("host", "path").distinct().select(F.explode(keys).alias("key"))
    # One aggregate tells which keys of the universe are listed: no join here either.
    no = F.lit(None).cast("boolean")
    universe = materialize(
        corpus.distinct()
        .select("key", F.lit(True).alias("seen"), no.alias("blocks"))
        .unionByName(rules.select(F.col("rule").alias("key"), F.lit(False).alias("seen"), "blocks"))
        .groupBy("key")
        .agg(F.bool_or("seen").alias("seen"), F.bool_or("blocks").alias("blocks"))
        .filter("seen")
        .select(
            "key",
            _hashes(F.col("key"))[0].alias("h1"),
            _hashes(F.col("key"))[1].alias("h2"),
            F.col("blocks").isNotNull().alias("listed"),
            F.coalesce("blocks", F.lit(False)).alias("blocks"),
        ),
        "url-keys",
    )
    n = universe.agg(F.count("*"), F.count_if("listed")).first()
    # Bits of the first level; the others together are at most a few times the listed keys.
    if n[1] * (np.log2(max(2.0, n[0] / max(n[1], 1))) * 1.45 + 12) / 8 > max_filter_bytes:
        return _joined(judged, keys, rules, default).select(out)
    listed, blocks = build_cascade(universe, "listed"), build_cascade(universe.filter("listed"), "blocks")
    sent = judged.sparkSession.sparkContext.broadcast((listed, blocks))

    @F.pandas_udf("struct<at:int, blocks:boolean>")
    def first_listed(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        listed, blocks = sent.value
        sizes = a.map(len).to_numpy()
        at, block = np.full(len(a), -1), np.zeros(len(a), dtype=bool)
        if sizes.sum():
            h1, h2 = np.concatenate(a.to_list()), np.concatenate(b.to_list())
            row = np.repeat(np.arange(len(a)), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            hit = np.flatnonzero(listed.holds(h1, h2))
            owner, first = np.unique(row[hit], return_index=True)
            hit = hit[first]
            at[owner], block[owner] = place[hit], blocks.holds(h1[hit], h2[hit])
        return pd.DataFrame({"at": at, "blocks": block})

    hashes = [
        F.transform("_keys", lambda k: _hashes(k)[0]),
        F.transform("_keys", lambda k: _hashes(k)[1]),
    ]
    found = judged.withColumn("_keys", keys).withColumn("_hit", first_listed(*hashes))
    hit = F.col("_hit.at") >= 0
    return found.withColumns(
        {
            "rule": F.when(hit, F.get("_keys", F.col("_hit.at"))),
            "verdict": F.when(~hit, F.lit(default)).when(F.col("_hit.blocks"), "block").otherwise("allow"),
        }
    ).select(out)


def _joined(judged: DataFrame, keys: Column, rules: DataFrame, default: str) -> DataFrame:
    """The same for lists whose filters are too large to send: keys of distinct urls are joined."""
    parts = judged.select("host", "path").distinct()
    best = (
        parts.select("host", "path", F.posexplode(keys).alias("at", "rule"))
        .join(rules.groupBy("rule").agg(F.bool_or("blocks").alias("blocks")), "rule")
        .groupBy("host", "path")
        .agg(F.min_by(F.struct("rule", "blocks"), "at").alias("hit"))
    )
    return judged.join(best, ["host", "path"], "left").select(
        *judged.columns,
        F.col("hit.rule").alias("rule"),
        F.when(F.col("hit").isNull(), F.lit(default)).when(F.col("hit.blocks"), "block").otherwise("allow").alias("verdict"),
    )
