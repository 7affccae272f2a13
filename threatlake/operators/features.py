"""Behavioural features: five-minute history per source, flow heuristics, scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake.config import DEFAULT, Config
from threatlake.functions.scalars import (
    clip, packet_rate, protocol_anomaly, session_heuristic, time_of_day, two_port_entropy,
)
from threatlake.operators.running import micros, running, salted_lookup

UNIFIED8 = ["duration", "protocol", "src_bytes", "dst_bytes", "src_port", "dst_port", "packets", "rate"]
BEHAVIOUR6 = ["packet_rate", "port_entropy", "session_z", "ip_frequency", "protocol_anomaly", "time_of_day"]
DETECT7 = ["request_rate", "pair_entropy", "session_deviation", "ip_share", "bytes_sent", "packets", "duration_seconds"]
RETRAIN4 = ["isolation_forest_score", "svm_score", "combined_score", "behavioral_deviation"]

# c*log2(c) is kept as an integer in units of 2**-30, so adding and taking back is exact
_FIXED = float(2**30)


def _weight(count: Column) -> Column:
    scaled = F.round(count * F.log2(F.greatest(count, F.lit(1)).cast("double")) * _FIXED)
    return F.when(count > 1, scaled.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def history(flows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Add what each flow's source did in ``[t - lookback, t)``.

    ``hist_rows``, ``hist_bytes``, ``hist_squares`` summarise the earlier flows; ``port_rows``,
    ``port_kinds`` and ``port_weight`` (the sum of c*log2 c over destination ports) give the
    port entropy without listing ports. All six are running sums of signed changes.
    """
    step = cfg.lookback_seconds * 1_000_000
    payload = [c for c in flows.columns if c not in ("log_id", "source_ip")]
    own = F.col("_own")
    # one pass over the flows: every flow is exploded into its entry and its exit
    signed = flows.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("_own")).select(
        "log_id", "source_ip",
        F.coalesce(F.col("dest_port"), F.lit(-1)).alias("_port"),
        F.coalesce(F.col("bytes_sent"), F.lit(0)).cast("decimal(19,0)").alias("_size"),
        (F.when(own, micros("ts")).otherwise(micros("ts") + step) * 2).alias("_pos"),
        F.when(own, 1).otherwise(-1).cast("bigint").alias("_sign"),
        "_own",
        *[F.when(own, F.col(c)).alias(c) for c in payload],  # kept apart, so unused ones are pruned
    )

    per_port = running(
        signed, ["source_ip", "_port"], "_pos", {"_before": ("sum", F.col("_sign"))}, tie="log_id", cfg=cfg, scale=2
    )
    before = F.coalesce(F.col("_before"), F.lit(0))
    after = before + F.col("_sign")
    real = F.col("_port") >= 0
    zero = F.lit(0).cast("bigint")
    changes = per_port.select(
        "log_id", "source_ip", "_pos", "_own", *payload,
        F.col("_sign").alias("_rows"),
        (F.col("_size") * F.col("_sign")).cast("decimal(38,0)").alias("_bytes"),
        (F.col("_size") * F.col("_size") * F.col("_sign")).cast("decimal(38,0)").alias("_squares"),
        F.when(real, F.col("_sign")).otherwise(zero).alias("_port_rows"),
        F.when(real, (after > 0).cast("bigint") - (before > 0).cast("bigint")).otherwise(zero).alias("_port_kinds"),
        F.when(real, _weight(after) - _weight(before)).otherwise(zero).alias("_port_weight"),
    )
    names = ["rows", "bytes", "squares", "port_rows", "port_kinds", "port_weight"]
    sums = {f"s_{n}": ("sum", F.col(f"_{n}")) for n in names}
    done = running(changes, ["source_ip"], "_pos", sums, cfg=cfg, scale=2).where("_own")
    out = {"rows": "hist_rows", "bytes": "hist_bytes", "squares": "hist_squares"}
    return done.select(
        "log_id", "source_ip", *payload,
        *[F.coalesce(F.col(f"s_{n}"), F.lit(0)).alias(out.get(n, n)) for n in names],
    )


def port_entropy() -> Column:
    """Shannon entropy of the history's ports over log2 of the number of distinct ports."""
    rows, kinds = F.col("port_rows").cast("double"), F.col("port_kinds").cast("double")
    entropy = F.log2(rows) - F.col("port_weight").cast("double") / F.lit(_FIXED) / rows
    return F.when((F.col("port_rows") >= 2) & (F.col("port_kinds") >= 2), entropy / F.log2(kinds)).otherwise(F.lit(0.0))


def session_z() -> Column:
    """Population z-score of the flow's bytes against its history, within [-5, 5]."""
    n = F.col("hist_rows").cast("decimal(19,0)")
    size = F.coalesce(F.col("bytes_sent"), F.lit(0)).cast("decimal(19,0)")
    spread = (n * F.col("hist_squares") - F.col("hist_bytes") * F.col("hist_bytes")).cast("double")
    z = (n * size - F.col("hist_bytes")).cast("double") / F.sqrt(F.nullif(spread, F.lit(0.0)))
    return F.when((F.col("hist_rows") < 2) | (spread <= 0), F.lit(0.0)).otherwise(clip(z, -5.0, 5.0))


def ip_frequency() -> Column:
    return F.ln(F.col("hist_rows").cast("double") + 1.0)


def behaviour6(flows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The six behaviour features of every flow, from two shuffles."""
    return history(flows, cfg).select(
        *flows.columns,
        packet_rate("packets", "duration_seconds").alias("packet_rate"),
        port_entropy().alias("port_entropy"),
        session_z().alias("session_z"),
        ip_frequency().alias("ip_frequency"),
        protocol_anomaly("protocol").alias("protocol_anomaly"),
        time_of_day("ts").alias("time_of_day"),
    )


def ip_share(flows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Add the share of all flows that come from the flow's source (rows counted once, not per flow)."""
    total = flows.agg(F.count("*")).scalar()
    per_ip = flows.groupBy("source_ip").agg(F.count("*").alias("ip_rows"))
    share = F.least(F.col("ip_rows").cast("double") / F.greatest(total, F.lit(1)).cast("double"), F.lit(1.0))
    joined = salted_lookup(flows, per_ip, "source_ip", "log_id", cfg)
    return joined.select(*flows.columns, share.alias("ip_share"))


def detect7(flows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Stateless detection features plus the source's share of traffic."""
    shared = ip_share(flows, cfg)
    return shared.withColumns(
        {
            "request_rate": F.coalesce("request_rate", F.lit(0.0)),
            "bytes_sent": F.coalesce("bytes_sent", F.lit(0)),
            "packets": F.coalesce("packets", F.lit(0)),
            "duration_seconds": F.coalesce("duration_seconds", F.lit(0.0)),
            "pair_entropy": two_port_entropy("dest_port", "src_port"),
            "session_deviation": session_heuristic("duration_seconds", "bytes_sent"),
        }
    )


# --- standard scaling ------------------------------------------------------------------------


def fit_scaler(train: DataFrame, features: list[str]) -> DataFrame:
    """One-row table of mean and population deviation per feature; a zero deviation becomes 1."""
    columns = []
    for name in features:
        deviation = F.stddev_pop(F.col(name).cast("double"))
        columns += [
            F.avg(F.col(name).cast("double")).alias(f"{name}_mean"),
            F.when(deviation == 0, F.lit(1.0)).otherwise(deviation).alias(f"{name}_std"),
        ]
    return train.agg(*columns)


def apply_scaler(df: DataFrame, scaler: DataFrame, features: list[str]) -> DataFrame:
    missing = [f for f in features if f"{f}_mean" not in scaler.columns]
    if missing:
        raise ValueError(f"scaler was not fitted on {missing}")
    fitted = scaler.select(F.struct("*").alias("s")).scalar()
    with_fit = df.withColumn("_fit", fitted)
    return with_fit.withColumns(
        {f: (F.col(f).cast("double") - F.col(f"_fit.{f}_mean")) / F.col(f"_fit.{f}_std") for f in features}
    ).drop("_fit")
