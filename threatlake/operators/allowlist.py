"""Trusted sources: exact addresses and CIDR blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlake.config import DEFAULT, Config
from threatlake.functions.scalars import ipv4_network, ipv4_number, ipv6_groups, ipv6_network
from threatlake.operators.running import salted_lookup


def _networks(entries: DataFrame) -> DataFrame:
    """Active CIDR entries as (family, prefix, network); bad entries and set host bits are handled
    as a lenient parse would: host bits are cleared, unreadable entries dropped."""
    address = F.split_part("value", F.lit("/"), F.lit(1))
    prefix = F.split_part("value", F.lit("/"), F.lit(2)).try_cast("int")
    v4, v6 = ipv4_number(F.col("address")), ipv6_groups(F.col("address"))
    return (
        entries.where((F.col("entry_type") == "CIDR") & F.col("is_active"))
        .select(address.alias("address"), prefix.alias("prefix"))
        .withColumns({"v4": v4, "v6": v6})
        .select(
            F.when(F.col("v4").isNotNull() & F.col("prefix").between(0, 32), F.struct(F.lit(4).alias("family"), F.col("prefix"), ipv4_network("v4", "prefix").cast("string").alias("network")))
            .when(F.col("v6").isNotNull() & F.col("prefix").between(0, 128), F.struct(F.lit(6).alias("family"), F.col("prefix"), ipv6_network(F.col("v6"), F.col("prefix")).alias("network")))
            .alias("n")
        )
        .where(F.col("n").isNotNull())
        .select("n.*")
        .distinct()
    )


def trusted_sources(ips: DataFrame, entries: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Distinct ``source_ip`` values that are trusted.

    CIDR containment is an equality on (prefix length, masked address): each distinct source is
    expanded once per prefix length in use (at most 33 for IPv4, 129 for IPv6), never compared
    with every network.
    """
    sources = ips.select("source_ip").distinct().withColumns(
        {"v4": ipv4_number("source_ip"), "v6": ipv6_groups("source_ip")}
    ).where(F.col("v4").isNotNull() | F.col("v6").isNotNull())
    nets = _networks(entries)
    lengths = nets.agg(F.collect_set(F.struct("family", "prefix"))).scalar()
    keyed = sources.withColumn("_l", F.explode(lengths)).select(
        "source_ip", F.col("_l.family").alias("family"), F.col("_l.prefix").alias("prefix"),
        F.when((F.col("_l.family") == 4), ipv4_network("v4", F.col("_l.prefix")).cast("string"))
        .otherwise(ipv6_network(F.col("v6"), F.col("_l.prefix"))).alias("network"),
    )
    by_network = keyed.join(nets, ["family", "prefix", "network"], "left_semi").select("source_ip")
    exact = entries.where((F.col("entry_type") == "IP") & F.col("is_active")).select(F.col("value").alias("source_ip"))
    by_address = sources.join(exact, "source_ip", "left_semi").select("source_ip")
    listed = sources.where(F.col("source_ip").isin(list(cfg.trusted_ips))).select("source_ip")
    return by_network.unionByName(by_address).unionByName(listed).distinct()


def flag_trusted(df: DataFrame, entries: DataFrame, cfg: Config = DEFAULT, row_id: str = "log_id") -> DataFrame:
    trusted = trusted_sources(df, entries, cfg).withColumn("_t", F.lit(True))
    return salted_lookup(df, trusted, "source_ip", row_id, cfg).withColumn("is_trusted", F.coalesce("_t", F.lit(False))).drop("_t")


def drop_trusted(df: DataFrame, entries: DataFrame, cfg: Config = DEFAULT, row_id: str = "log_id") -> DataFrame:
    return flag_trusted(df, entries, cfg, row_id).where(~F.col("is_trusted")).drop("is_trusted")


def merge_entries(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply add / deactivate change rows: the newest version of an entry wins.

    Both sides carry ``entry_type, value, is_active, version``.
    """
    columns = ["entry_type", "value", "is_active", "version"]
    both = current.select(*columns).unionByName(changes.select(*columns))
    return both.groupBy("entry_type", "value").agg(F.max_by("is_active", "version").alias("is_active"), F.max("version").alias("version"))


def active_entries(entries: DataFrame) -> DataFrame:
    return entries.where("is_active").orderBy("entry_type", "value")
