"""Typed CSV scan, table reads by path, split choice and file search."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# CSV fields that mean "missing", and the spellings of booleans.
NA_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]
BOOLEANS = ["True", "TRUE", "true", "False", "FALSE", "false"]
INTEGER = r"^\s*[+-]?\d+\s*$"
DECIMAL = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|inf|Inf|INF|infinity|Infinity)\s*$"


def _present(column: str) -> Column:
    """The text of a field, null when it is a missing-value token."""
    return F.when(~F.col(column).isin(NA_TOKENS), F.col(column))


def _as(column: str, dtype: T.DataType) -> Column:
    text = _present(column)
    if isinstance(dtype, T.LongType):
        return F.when(text.rlike(INTEGER), text.try_cast("bigint"))
    if isinstance(dtype, T.DoubleType):
        return F.when(text.rlike(DECIMAL), text.try_cast("double"))
    if isinstance(dtype, T.BooleanType):
        return F.when(text.isin(BOOLEANS), F.lower(text) == "true")
    return text


def infer_schema(raw: DataFrame) -> T.StructType:
    """Narrowest type that holds every value of a string column, one scan for all.

    Dates stay strings; a column without values is a double.
    """
    kinds = [T.LongType(), T.DoubleType(), T.BooleanType()]
    counts = raw.agg(
        *(F.count(_present(c)).alias(f"{i}_n") for i, c in enumerate(raw.columns)),
        *(
            F.count(_as(c, k)).alias(f"{i}_{j}")
            for i, c in enumerate(raw.columns)
            for j, k in enumerate(kinds)
        ),
    ).first()
    fields = []
    for i, c in enumerate(raw.columns):
        n = counts[f"{i}_n"]
        fits = [k for j, k in enumerate(kinds) if counts[f"{i}_{j}"] == n]
        dtype = T.DoubleType() if n == 0 else fits[0] if fits else T.StringType()
        fields.append(T.StructField(c, dtype))
    return T.StructType(fields)


def has_multiline_fields(spark: SparkSession, path: str | list[str]) -> bool:
    """True when a quoted field spans lines: some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """CSV with a header, missing-value tokens as nulls and typed columns.

    A given schema saves the inference scan. Files whose fields span lines
    cannot be split between tasks; unless told, the reader checks for them and
    splits all others.
    """
    if multi_line is None:
        multi_line = has_multiline_fields(spark, path)
    raw = spark.read.csv(path, header=True, multiLine=multi_line, escape='"')
    schema = schema or infer_schema(raw)
    return raw.select(*(_as(f.name, f.dataType).alias(f.name) for f in schema))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True, escape='"')


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, ORC, JSON or CSV by suffix; local, file:// or object-store path."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return read_csv(spark, path)
    if kind in ("json", "jsonl", "ndjson"):
        return spark.read.json(path)
    if kind == "orc":
        return spark.read.orc(path)
    return spark.read.parquet(path)


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Use all cores for costly per-row work on a table that is read in fewer parts.

    For scanned tables. One that has a part per core already is left as it is,
    so nothing large is shuffled.
    """
    tasks = tasks or df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def first_csv(spark: SparkSession, directory: str) -> str | None:
    """Smallest path of a CSV file under a directory, at any depth."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .load(directory)
    )
    return files.agg(F.min("path")).first()[0]


def pick_split(df: DataFrame, column: str = "split") -> DataFrame:
    """Rows of the `train` split, or of the first split when there is no `train`.

    The choice is read first, so the filter is a constant that prunes partitions.
    """
    name = F.col(column)
    chosen = df.agg(
        F.coalesce(F.max(F.when(name == "train", name)), F.min(name)).alias("s")
    ).first()[0]
    return df.filter(name == chosen)
