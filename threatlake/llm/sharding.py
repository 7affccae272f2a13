"""Contiguous shards of nearly equal bytes, cut at equal targets of the global prefix sum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlake.llm.common import range_parts, with_offsets

#: Bytes added to every document's text, for its id and framing.
FRAME_BYTES = 16


def shard_documents(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Rows are taken in ascending id (null ids first; repeated ids by checksum and size, so equal
    rows are next to each other and interchangeable). A row whose bytes start at position s of
    all T bytes goes to shard ``floor(s * shards / T)``, so every shard holds T / shards give or
    take one row. ``slot`` counts from 0 inside a shard. Null and empty texts have the frame's
    size alone and the checksum 0. An empty table gives no rows; other columns are not read.
    ``grown_shard`` is null: the law is ``bytes``, not ``key``. Copies are not kept together:
    a group of copies larger than a shard could not be.

    Only ids, sizes and checksums are shuffled. Totals of the ranges, one number a range, are
    summed in order; the rest is done range by range.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(FRAME_BYTES)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    parts = range_parts(narrow, order, "shard-ranges")
    placed = with_offsets(parts, order, {"_start": F.col("size"), "_row": F.lit(1)})
    # In decimals: the product can pass 2^63.
    total = parts.agg(F.sum("size").cast("decimal(20,0)").alias("_total"))
    sharded = placed.join(F.broadcast(total), F.lit(True)).withColumn(
        "shard", F.floor((F.col("_start").cast("decimal(20,0)") * F.lit(shards)) / F.col("_total")).cast("int"))
    sharded = sharded.withColumn("shard", F.least(F.col("shard"), F.lit(shards - 1)))
    # The first row of each shard: at most ``shards`` rows.
    first = sharded.groupBy("shard").agg(F.min("_row").alias("_first")).withColumnRenamed("shard", "_of")
    return sharded.join(F.broadcast(first), F.col("shard") == F.col("_of")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_row") - F.col("_first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents themselves as ``path/shard=N/``, ordered by slot; return the placement.

    Ids must be unique: they tie a document to its place.
    """
    placed = shard_documents(df, shards, id_col, text_col).select("doc_id", "shard", "slot")
    with_place = df.join(placed.withColumnRenamed("doc_id", "_placed_id"), F.col(id_col).eqNullSafe(F.col("_placed_id"))).drop("_placed_id")
    with_place.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return placed
