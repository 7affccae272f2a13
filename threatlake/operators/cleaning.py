"""Cleaning and reshaping of labelled flow data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threatlake.session import materialise


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def rename_known(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def infinite_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.withColumns({c: F.when(~bad(c), F.col(c)) for c in columns})


def clean(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Infinities and missing values removed, exact duplicate rows kept once."""
    return infinite_to_null(df, numeric).na.drop().dropDuplicates()


def fill_zero(df: DataFrame, numeric: list[str]) -> DataFrame:
    return infinite_to_null(df, numeric).na.fill(0, subset=numeric)


def _ranked(values: DataFrame, column: str) -> DataFrame:
    """Distinct values with ``rank``, from 0 in their order.

    Values are dealt to ranges between splitters that are sampled from them, ranked in their range,
    and the ranges' sizes are added up; values that all begin alike are spread like any others. The
    ranges are stored, as another deal need not cut at the same values.
    """
    dealt = values.repartitionByRange(max(1, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))), column)
    placed = materialise(dealt.withColumn("_range", F.spark_partition_id()), "values")
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(F.col("_range").alias("_of")).agg(F.count("*").alias("_n"))
    sizes = F.broadcast(sizes.select("_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))  # a row for each range
    within = F.row_number().over(Window.partitionBy("_range").orderBy(column)) - 1
    return placed.join(sizes, F.col("_range") == F.col("_of")).select(column, (F.col("_before") + within).alias("rank"))


def _values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias(column)).distinct()


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """Dictionary of a categorical column: codes in sorted order of the text form."""
    return _ranked(_values(df, column), column).select(column, F.col("rank").cast("int").alias("code"))


def grown_codes(dictionary: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """The dictionary with the values of ``df`` that it lacks. Codes that are given stay as they are; new
    values follow the highest, in sorted order among themselves."""
    new = _ranked(_values(df, column).join(dictionary.select(column), column, "left_anti"), column)
    following = F.coalesce(dictionary.agg(F.max("code")).scalar(), F.lit(-1)) + 1
    return dictionary.select(column, "code").unionByName(new.select(column, (following + F.col("rank")).cast("int").alias("code")))


def encode_categories(df: DataFrame, columns: list[str], dictionaries: dict[str, DataFrame] | None = None) -> DataFrame:
    """Replace categories by their codes; a stored dictionary gives -1 to unseen values."""
    for column in columns:
        codes = (dictionaries or {}).get(column)
        codes = category_codes(df, column) if codes is None else codes
        key = F.coalesce(F.col(column).cast("string"), F.lit("nan"))
        codes = codes.select(F.col(column).alias("_value"), F.col("code").alias("_code"))
        df = df.withColumn("_key", key).join(codes, F.col("_key") == F.col("_value"), "left").withColumn(
            column, F.coalesce("_code", F.lit(-1))).drop("_key", "_value", "_code")
    return df


def _drawn(df: DataFrame, row_id: str, by: list[str], seed: int, most: int | None = None) -> DataFrame:
    """Add ``_place``, a row's rank from 1 in the draw of its class, and ``_class``, the size of that.

    The draw orders rows by a hash of the id and the seed. Rows are ranked inside a prefix of the
    hash; counts by prefix, at most 65 536 a class, say how many rows come before it. Of ``most``
    places of each class, if given, rows whose prefix begins later are dropped where they are read.
    """
    lottery = F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))
    drawn = df.withColumn("_draw", lottery).withColumn("_prefix", F.substring("_draw", 1, 4))
    prefixes = drawn.groupBy(*by, "_prefix").agg(F.count("*").alias("_n"))
    whole, before = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    prefixes = prefixes.select(*(F.col(c).alias(f"_of_{c}") for c in by), F.col("_prefix").alias("_at"),
                               F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_below"), F.sum("_n").over(whole).alias("_class"))
    match = F.col("_prefix") == F.col("_at")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    if most is not None:  # a class has no more prefixes left than places
        prefixes = F.broadcast(prefixes.where(F.col("_below") < most))
    within = F.row_number().over(Window.partitionBy(*by, "_prefix").orderBy("_draw", row_id))
    return drawn.join(prefixes, match).withColumn("_place", F.col("_below") + within).drop("_prefix", "_at", "_below", *(f"_of_{c}" for c in by))


def balanced_sample(df: DataFrame, label: str, row_id: str, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows, half per class, chosen by a hash of the id and the seed: repeatable anywhere.
    Only rows that may be among them are shuffled."""
    return _drawn(df, row_id, [label], seed, size // 2).where(F.col("_place") <= size // 2).orderBy("_draw").select(*df.columns)


def split(df: DataFrame, row_id: str, label: str | None = None, train_percent: int = 80, seed: int = 42) -> DataFrame:
    """Add ``is_train``: exactly ``train_percent`` of the rows, rounded down, of each class when a
    label is given, chosen by a hash of the id and the seed."""
    drawn = _drawn(df, row_id, [label] if label else [], seed)
    return drawn.select(*df.columns, (F.col("_place") <= F.floor(F.col("_class") * train_percent / 100)).alias("is_train"))
