"""Licence scan: the Dice coefficient of word bigrams between texts and licence templates.

A text is normalised (lower case, runs of anything but letters and digits to one space) and looked
at as a whole, by paragraph (between blank lines) and by line. With a bigrams in the unit and b in
the template, both with repeats, Dice is 2 x common / (a + b); since no more than the smaller of
the two can be common, a unit reaches a threshold t only for templates with
t / (2 - t) x b <= a <= (2 - t) / t x b. A small index from size to templates makes that bound an
equality join, and only units of a size in the index get bigrams at all.

DataFrame expressions only. Edge cases: null and empty texts, and units of fewer than two words,
match nothing. A paragraph of one line is looked at as a line, a text of one paragraph as a
paragraph. Of several templates at the best score the first by licence, then template number, is
given. Repeated rows are scanned one by one. All input columns are kept; result columns replace
those of the same names.
Columns of the caller may have any name; those named like a result column are replaced by it.
"""

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from assay.llm.license_templates import TEMPLATES
from assay.llm.names import hidden, shown

THRESHOLD = 0.8
RESULTS = ["unit", "at", "license", "template", "dice"]


def normalised(text: Column) -> Column:
    """Lower case, words parted by one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _bigrams(words: Column) -> Column:
    """Of a column of words (a column, since an expression would be computed for every word)."""
    return F.transform(
        F.slice(words, 1, F.size(words) - 1), lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1))
    )


def template_index(spark: SparkSession, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """size, license, template, b and the template's bigrams with their counts, for every size that
    can reach the threshold. Grows with the templates only."""
    rows = spark.createDataFrame([Row(template=i, license=k, text=v) for i, (k, v) in enumerate(templates)])
    words = F.split(normalised(F.col("text")), " ")
    counted = (
        _once(rows, "_w", words)
        .select("template", "license", _bigrams(F.col("_w")).alias("g"))
        .select("*", F.size("g").alias("b"), F.array_distinct("g").alias("grams"))
        .withColumn("counts", F.transform("grams", lambda x: F.size(F.filter("g", lambda y: y == x))))
        .filter("b > 0")
    )
    # A margin of rounding: the score itself decides.
    low = F.ceil(F.col("b") * (threshold / (2 - threshold)) - 1e-9)
    high = F.floor(F.col("b") * ((2 - threshold) / threshold) + 1e-9)
    sized = counted.select(
        F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("size"),
        "license",
        "template",
        "b",
        "grams",
        "counts",
    )
    return spark.createDataFrame(sized.collect(), sized.schema)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row, however many filters and columns use it: the
    optimizer doesn't copy an expression across a generator."""
    return df.withColumn(name, F.explode_outer(F.array(value)))


def _units(df: DataFrame, text: Column) -> DataFrame:
    """A row per unit that is to be looked at: unit, at and its raw text in _raw."""
    lines, paragraphs = F.split(text, "\n"), F.split(text, r"\n\s*\n")
    several, blank = F.contains(text, F.lit("\n")), text.rlike(r"\n\s*\n")
    none = F.array().cast("array<string>")
    parts = F.concat(
        lines,
        F.when(several, paragraphs).otherwise(none),
        F.when(blank, F.array(text)).otherwise(none),
    )
    pos = F.col("_pos") - F.col("_lines")
    kind = F.when(pos < 0, "line").when(pos < F.col("_paragraphs"), "paragraph").otherwise("text")
    return (
        df.withColumns(
            {"_lines": F.size(lines), "_paragraphs": F.when(several, F.size(paragraphs)).otherwise(0)}
        )
        .select("*", F.posexplode_outer(parts).alias("_pos", "_raw"))
        .withColumn("unit", kind)
        .withColumn(
            "at",
            F.when(pos < 0, F.col("_pos")).when(F.col("unit") == "paragraph", pos).otherwise(0),
        )
        # A paragraph of one line is a line.
        .filter((F.col("unit") == "line") | F.contains(F.trim("_raw"), F.lit("\n")))
        .drop("_lines", "_paragraphs", "_pos")
    )


def scan_licenses(
    df: DataFrame,
    text: str = "text",
    templates: list[tuple[str, str]] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per unit that reaches the threshold: the input's columns with unit (line, paragraph
    or text), at (its number, from 0), license, template and dice."""
    if not 0 < threshold <= 1:
        raise ValueError(f"the threshold is above 0 and at most 1: {threshold}")
    spark = df.sparkSession
    index = template_index(spark, TEMPLATES if templates is None else templates, threshold)
    by_size = index.groupBy("size").agg(
        F.collect_list(F.struct("license", "template", "b", "grams", "counts")).alias("_t")
    )
    known = [r.g for r in index.select(F.explode("grams").alias("g")).distinct().collect()]
    kept, names = hidden(df, *RESULTS)
    units = _once(_units(kept, F.col(names[text])), "_w", F.split(normalised(F.col("_raw")), " ")).drop("_raw")
    sizes = index.agg(F.coalesce(F.min("size"), F.lit(1)), F.coalesce(F.max("size"), F.lit(0))).first()
    sized = units.withColumn("_size", F.size("_w") - 1).filter(F.col("_size").between(*sizes))
    # A template within the size bound shares at least t / (2 - t) of the unit's bigrams, so a unit
    # with fewer bigrams of any template needs no comparison.
    least = threshold / (2 - threshold)
    found = _once(sized, "_g", _bigrams(F.col("_w"))).drop("_w").filter(
        F.size(F.filter("_g", lambda g: g.isin(known))) >= F.col("_size") * least - 1e-9
    )
    found = found.join(F.broadcast(by_size.withColumnRenamed("size", "_size")), "_size")

    def common(t: Column) -> Column:
        each = F.transform(
            t["grams"], lambda x, i: F.least(F.size(F.filter("_g", lambda y: y == x)), F.get(t["counts"], i))
        )
        return F.aggregate(each, F.lit(0), lambda a, b: a + b)

    scored = F.transform(
        "_t",
        lambda t: F.struct(
            (-2.0 * common(t) / (F.col("_size") + t["b"])).alias("minus"),
            t["license"].alias("license"),
            t["template"].alias("template"),
        ),
    )
    return (
        _once(found, "_best", F.array_min(scored))
        .filter(F.col("_best.minus") <= -threshold)
        .select(
            *shown(names),
            "unit",
            F.col("at").cast("int").alias("at"),
            F.col("_best.license").alias("license"),
            F.col("_best.template").cast("int").alias("template"),
            (-F.col("_best.minus")).alias("dice"),
        )
    )
