"""Labelled flow data sets in CSV: two header layouts, one unified output."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatlake.functions.scalars import attack_label, derived_rate, number_or
from threatlake.operators.cleaning import encode_categories, fill_zero, strip_headers

# Column names of the two layouts and the log columns they map to.
LAYOUT_A = {
    "Source IP": "source_ip", "Destination IP": "dest_ip", "Destination Port": "dest_port", "Protocol": "protocol",
    "Flow Duration": "duration_seconds", "Total Fwd Packets": "bytes_sent", "Total Backward Packets": "bytes_received", "Label": "label",
}
LAYOUT_B = {
    "srcip": "source_ip", "dstip": "dest_ip", "dsport": "dest_port", "proto": "protocol", "dur": "duration_seconds",
    "sbytes": "bytes_sent", "dbytes": "bytes_received", "label": "label",
}
CATEGORIES_B = ["proto", "service", "state"]
UNIFIED = ["duration", "protocol", "src_bytes", "dst_bytes", "src_port", "dst_port", "packets", "rate", "label"]


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """Files of one header line, or, with ``schema``, without any. Columns are read as text."""
    reader = spark.read.option("header", schema is None)
    if schema is not None:
        reader = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields]))
    return strip_headers(reader.csv(path))


def header_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``header, files``: the files of each header line, by one pass over the lines.

    A file's header is the first line of its first block. Files are named, not read, on the driver's side.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            files, starts = batch.column("file"), batch.column("start").to_numpy()
            coded = files.dictionary_encode()
            at, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            begins = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1]))) if len(at) else []
            keep = [k for k in begins if starts[k] == 0 and (k > 0 or (names[at[k]], 0) != last)]
            if len(at):
                last = names[at[-1]], starts[-1]
            yield pa.record_batch({"header": batch.column("value").take(pa.array(keep, pa.int64())), "file": files.take(pa.array(keep, pa.int64()))})

    return lines.mapInArrow(first, "header string, file string").groupBy("header").agg(F.sort_array(F.collect_set("file")).alias("files"))


def read_folder(spark: SparkSession, path: str | list[str]) -> dict[str, DataFrame]:
    """Files of differing headers: one read for each header line, stacked by column name for each layout (``a``, ``b``).

    A layout is told by its columns; files of neither raise an error, as their rows would be lost.
    """
    out: dict[str, DataFrame] = {}
    for row in header_lines(spark, path).orderBy("header").collect():
        names = {c.strip().strip('"') for c in row.header.split(",")}
        layout = "a" if len(names & set(LAYOUT_A)) > len(names & set(LAYOUT_B)) else "b" if names & set(LAYOUT_B) else None
        if layout is None:
            raise ValueError(f"no known layout: {row.header[:200]} ({row.files[0]} and {len(row.files) - 1} more)")
        part = read_csv(spark, row.files)
        out[layout] = out[layout].unionByName(part, allowMissingColumns=True) if layout in out else part
    return out


def register(spark: SparkSession, path: str | list[str], dictionaries: dict[str, DataFrame] | None = None) -> DataFrame:
    """All rows of a folder in the unified layout."""
    found = read_folder(spark, path)
    parts = [*([unify_a(found["a"])] if "a" in found else []), *([unify_b(found["b"], dictionaries)] if "b" in found else [])]
    if not parts:
        raise ValueError(f"no files below {path}")
    return merge(parts[0], parts[1] if len(parts) > 1 else parts[0].limit(0))


def _number(df: DataFrame, name: str) -> Column:
    return number_or(name) if name in df.columns else F.lit(0.0)


def unify_a(df: DataFrame) -> DataFrame:
    """First layout. Rows whose duration is missing or infinite are dropped."""
    if "Flow Duration" in df.columns:
        duration = F.col("Flow Duration").try_cast("double")
        missing = F.col("Flow Duration").isNull() | F.coalesce(F.isnan(duration) | (F.abs(duration) == float("inf")), F.lit(False))
        df = df.where(~missing)
    n = lambda c: _number(df, c)
    label = attack_label(F.coalesce("Label", F.lit(""))) if "Label" in df.columns else F.lit(0)
    return df.select(
        n("Flow Duration").alias("duration"), n("Protocol").alias("protocol"), n("Total Fwd Packets").alias("src_bytes"),
        n("Total Backward Packets").alias("dst_bytes"), n("Source Port").cast("int").alias("src_port"), n("Destination Port").cast("int").alias("dst_port"),
        n("Total Fwd Packets").alias("packets"), n("Flow Packets/s").alias("rate"), label.alias("label"))


def unify_b(df: DataFrame, dictionaries: dict[str, DataFrame] | None = None) -> DataFrame:
    """Second layout: categories become codes, the rate is derived, the label is numeric."""
    present = [c for c in CATEGORIES_B if c in df.columns]
    df = encode_categories(df, present, dictionaries)
    n = lambda c: _number(df, c)
    label = next((c for c in ("label", "Label") if c in df.columns), None)
    return df.select(
        n("dur").alias("duration"), (F.col("proto").cast("double") if "proto" in df.columns else F.lit(0.0)).alias("protocol"),
        n("sbytes").alias("src_bytes"), n("dbytes").alias("dst_bytes"), n("sport").cast("int").alias("src_port"), n("dsport").cast("int").alias("dst_port"),
        n("spkts").alias("packets"), derived_rate(n("spkts"), n("dur")).alias("rate"),
        (number_or(label).cast("int") if label else F.lit(0)).alias("label"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return fill_zero(a.unionByName(b), ["duration", "src_bytes", "dst_bytes", "packets", "rate"]).select(*UNIFIED)
