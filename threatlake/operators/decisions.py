"""From a scored threat and its context to an action and its explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatlake.config import DEFAULT, Config
from threatlake.functions.scalars import clip, off_hours, pattern_title
from threatlake.operators.killchain import stage_multiplier
from threatlake.operators.running import lookback, micros, running, trailing

ALERT_OR_STRONGER = ["ALERT", "RATE_LIMIT", "BLOCK", "PORT_CLOSE"]
# Severity per action.
SEVERITY = {"MONITOR": 1, "ALERT": 2, "RATE_LIMIT": 3, "BLOCK": 4, "PORT_CLOSE": 5}
# Action, ordinal, severity, reversible, escalation cost.
ACTION_SPACE = [
    ("MONITOR", 1, 1, True, 0.0),
    ("ALERT", 2, 2, True, 0.1),
    ("RATE_LIMIT", 3, 3, True, 0.4),
    ("BLOCK", 4, 4, False, 0.8),
    ("PORT_CLOSE", 5, 5, False, 0.9),
]
# Texts of the false-positive assessment.
FP_COOLDOWN = "IP in cooldown (recently alerted)"
FP_ISOLATED = "Single isolated event (no emerging pattern)"
FP_FIRST = "Zero prior incidents (first time seen)"
FP_HIGH = "High FP risk. Downgrade response to MONITOR or ALERT."
FP_MODERATE = "Moderate FP risk. Consider ALERT."
FP_LOW = "Low FP risk. Proceed with autonomous response."


def severity(action: Column | str) -> Column:
    action = F.col(action) if isinstance(action, str) else action
    chain = F
    for name, value in SEVERITY.items():
        chain = chain.when(action == name, F.lit(value))
    return chain.otherwise(F.lit(0))


def threat_type(rate: Column | str, entropy: Column | str, deviation: Column | str, repeat: Column) -> Column:
    """First matching pattern. The five texts."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return (
        F.when(c(rate) > 500, "DDoS / Volumetric Flood")
        .when(c(entropy) > 0.9, "Port Scan / Reconnaissance")
        .when(c(deviation) > 0.8, "Session Hijack / Anomalous Burst")
        .when(repeat, "Persistent Threat / Repeat Offender")
        .otherwise("Unknown Anomaly")
    )


def simple_action(score: Column | str, risk: Column | str, repeat: Column) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    risk = F.col(risk) if isinstance(risk, str) else risk
    return (
        F.when((risk == "CRITICAL") | (repeat & (score > 0.75)), "BLOCK")
        .when(risk == "HIGH", F.when(repeat, "BLOCK").otherwise("RATE_LIMIT"))
        .when(risk == "MEDIUM", "ALERT")
        .otherwise("MONITOR")
    )


# --- context over time -------------------------------------------------------------------------


def prior_threats(threats: DataFrame, cfg: Config = DEFAULT, ts: str = "ts", row_id: str = "log_id") -> DataFrame:
    """Add ``prior``: how many threats the source had before this one."""
    rows = threats.withColumn("_pos", micros(ts))
    counted = running(rows, ["source_ip"], "_pos", {"_n": ("sum", F.lit(1).cast("bigint"))}, tie=row_id, cfg=cfg)
    return counted.withColumn("prior", F.coalesce("_n", F.lit(0)).cast("bigint")).drop("_pos", "_n")


def correlation(scores: DataFrame, cfg: Config = DEFAULT, ts: str = "ts") -> DataFrame:
    """Add ``recent_events`` (the event itself included) and ``correlated``."""
    counted = lookback(
        scores, ["source_ip"], ts, cfg.lookback_seconds, {"recent_events": F.lit(1).cast("bigint")}, include_now=True, cfg=cfg
    )
    return counted.withColumn("correlated", F.col("recent_events") >= cfg.correlation_min_events)


def cooldown(threats: DataFrame, cfg: Config = DEFAULT, ts: str = "created_at") -> DataFrame:
    """Add ``in_cooldown``: the source was alerted on shortly before, per the recorded threats."""
    alerted = F.when(F.col("action_taken").isin(ALERT_OR_STRONGER), 1).otherwise(0).cast("bigint")
    counted = lookback(threats, ["source_ip"], ts, cfg.cooldown_seconds, {"_alerts": alerted}, cfg=cfg)
    return counted.withColumn("in_cooldown", F.col("_alerts") > 0).drop("_alerts")


def recent_severity(threats: DataFrame, cfg: Config = DEFAULT, ts: str = "created_at", row_id: str = "log_id", depth: int = 10) -> DataFrame:
    """Add ``past_severity``: the strongest of the source's last ``depth`` actions, 0 if none."""
    rows = threats.withColumn("_pos", micros(ts)).withColumn("_sev", severity("action_taken"))
    build = lambda w: {"past_severity": F.coalesce(F.max("_sev").over(w.rowsBetween(-depth, -1)), F.lit(0))}
    return trailing(rows, ["source_ip"], "_pos", row_id, depth, build, cfg=cfg).drop("_pos", "_sev")


# --- false-positive risk ------------------------------------------------------------------------


def fp_risk(df: DataFrame, score: str = "confidence_score") -> DataFrame:
    """Add risk, factors, recommendation and adjusted confidence from the three context flags."""
    isolated, first = ~F.col("correlated"), F.col("prior") == 0
    amount = lambda flag, value: F.when(flag, F.lit(value)).otherwise(F.lit(0.0))
    risk = F.least(amount(F.col("in_cooldown"), 0.3) + amount(isolated, 0.4) + amount(first, 0.2), F.lit(0.9))
    return (
        df.withColumn("fp_risk", risk)
        .withColumn("fp_factors", F.array_compact(F.array(
            F.when(F.col("in_cooldown"), FP_COOLDOWN), F.when(isolated, FP_ISOLATED), F.when(first, FP_FIRST))))
        .withColumn("fp_recommendation", F.when(F.col("fp_risk") > 0.5, FP_HIGH).when(F.col("fp_risk") > 0.2, FP_MODERATE).otherwise(FP_LOW))
        .withColumn("adjusted_confidence", F.col(score) * (1.0 - F.col("fp_risk")))
    )


# --- deterministic score decision ------------------------------------------------------------------


def score_decision(df: DataFrame, cfg: Config = DEFAULT, score: str = "confidence_score", stage: str = "stage") -> DataFrame:
    """Score × stage × (1 − fp) to an action, with the escalation guard and a breakdown map."""
    multiplier, keep = stage_multiplier(stage), 1.0 - F.col("fp_risk")
    final = clip(F.col(score) * multiplier * keep, 0.0, 1.0)
    value = F.col("final_score")
    raw = (
        F.when(value >= cfg.high_confidence, "BLOCK").when(value >= 0.65, "RATE_LIMIT")
        .when(value >= cfg.medium_confidence, "ALERT").otherwise("MONITOR")
    )
    guarded = F.col("_raw").isin("BLOCK", "RATE_LIMIT") & (value <= 0.9) & (F.col("prior") < 2)
    return (
        df.withColumn("final_score", final)
        .withColumn("_raw", raw)
        .withColumn("guard_applied", guarded)
        .withColumn("action", F.when(~guarded, F.col("_raw")).when(F.col("_raw") == "BLOCK", "RATE_LIMIT").otherwise("ALERT"))
        .withColumn("score_breakdown", F.create_map(
            F.lit("base_score"), F.col(score),
            F.lit("kill_chain_multiplier"), multiplier,
            F.lit("fp_adjustment"), keep,
            F.lit("escalation_guard_applied"), F.col("guard_applied").cast("double")))
        .drop("_raw")
    )


# --- multi-factor choice among five actions ----------------------------------------------------------


def choose_action(
    df: DataFrame, row_id: str = "log_id", score: str = "confidence_score", ts: str = "created_at",
    *, kill_chain: bool = True, fp: bool = True, confidence: str | None = None,
) -> DataFrame:
    """Score all five actions per case and keep the best; runner-up, margin and alternatives attached.

    The five candidates are an array inside the row, so a case is decided where it is, without
    a join or a shuffle. ``fp=False`` takes the given ``confidence``; ``kill_chain=False``
    ignores the stage.
    """
    trust = F.col("adjusted_confidence") if fp else F.col(confidence or score)
    base = F.col(score)
    target = base * stage_multiplier("stage") + F.when(F.col("is_progressing"), 0.15).otherwise(0.0) if kill_chain else base
    repeats = F.col("prior").cast("double")

    def utility(sev: int, reversible: bool, cost: float) -> Column:
        u = (
            F.when((base >= 0.8) & F.lit(sev >= 4), F.lit(1.0))
            .when((base < 0.4) & F.lit(sev <= 2), F.lit(1.0))
            .otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(F.lit(sev / 5.0) - target) * 2.0))
        )
        # each rule is one factor or summand, neutral when it does not apply: the expression stays small
        when = lambda rule, value, neutral: F.when(rule, value).otherwise(F.lit(neutral))
        if sev >= 3:
            u = u * when(repeats > 0, F.lit(1.0) + F.lit(0.15) * repeats, 1.0) * when(off_hours(ts), F.lit(1.2), 1.0)
        if sev >= 4:
            u = u * when(trust < 0.5, F.lit(0.5), 1.0)
        if reversible:
            u = u + when(trust < 0.7, F.lit(0.3), 0.0)
        if sev >= 4:
            u = u - when((F.col("past_severity") < 3) & (F.col("risk_level") != "CRITICAL"), F.lit(cost), 0.0)
        return u

    options = F.array(*[
        F.struct(utility(sev, rev, cost).alias("utility"), F.lit(-ordinal).alias("order"), F.lit(name).alias("action"),
                 F.lit(sev).alias("severity"))
        for name, ordinal, sev, rev, cost in ACTION_SPACE
    ])
    ranked = df.withColumn("_ranked", F.sort_array(options, asc=False))
    best, second = F.get("_ranked", F.lit(0)), F.get("_ranked", F.lit(1))
    decided = (
        ranked.withColumn("margin", best["utility"] - second["utility"])
        .withColumn("_trust", trust)
        .withColumn("_confidence", F.least(F.lit(1.0), F.col("_trust") * (F.lit(1.0) + F.col("margin") * 0.1)))
        .withColumn("action", best["action"])
        .withColumn("runner_up", second["action"])
        .withColumn("decision_confidence", F.round("_confidence", 4))
        .withColumn("risk_reduction", F.round(best["severity"] / F.lit(5.0) * F.col("_confidence"), 4))
        .withColumn("alternatives", F.transform(F.slice("_ranked", 2, 4), lambda o: F.struct(o["action"].alias("action"), o["utility"].alias("utility"))))
    )
    hour = F.hour(F.col(ts))
    empty = F.array().cast("array<string>")
    fp_lines = F.array_compact(F.array(
        F.when(F.size("fp_factors") > 0, F.format_string("FP Risk %.2f Factors: %s", F.col("fp_risk"), F.array_join("fp_factors", ", "))),
        F.concat(F.lit("FP Mitigation Recommendation: "), F.col("fp_recommendation")))) if fp else empty
    stage_lines = F.array_compact(F.array(
        F.when(F.col("stage").isNotNull(), F.concat(F.lit("Stage "), F.col("stage"), F.lit(" detected → "), stage_multiplier("stage").cast("string"), F.lit("x multiplier applied"))),
        F.when(F.col("is_progressing"), F.lit("Progressing attacker profile → is_progressing=True (+0.15 score)")))) if kill_chain else empty
    score_lines = F.array(F.format_string("Anomaly score %.4f → %s risk", base, F.col("risk_level")))
    def guard_line(name: str, cost: float) -> Column:
        strong = F.exists("_ranked", lambda o: (o["action"] == name) & (o["utility"] + cost > 1.5))
        return F.when((F.col("past_severity") < 3) & (F.col("risk_level") != "CRITICAL") & strong,
                      F.lit(f"{name} penalized (escalation_guard active: no prior severe actions)"))

    guard_by_action = [guard_line(name, cost) for name, _, sev, _, cost in ACTION_SPACE if sev >= 4]
    rest = F.array_compact(F.array(
        F.when(F.col("prior") > 0, F.format_string("IP %s has %d prior incidents (multiplier: %.2f)", F.col("source_ip"), F.col("prior"), 1.0 + 0.15 * repeats))
        .otherwise(F.concat(F.lit("IP "), F.col("source_ip"), F.lit(" is a first-time offender"))),
        F.when(off_hours(ts), F.format_string("Time %02d:00 → elevated threat weight applied (off-hours)", hour)),
        F.when(F.col("_trust") < 0.5, F.format_string("Low confidence (%.2f) → penalizing severe actions", F.col("_trust"))),
        F.when(F.col("_trust") < 0.7, F.format_string("Confidence %.2f < 0.70 → preferring reversible actions", F.col("_trust"))),
        *guard_by_action,
        F.concat(F.col("action"), F.lit(" selected over "), F.col("runner_up"))))
    return decided.withColumn("reasoning_chain", F.concat(fp_lines, score_lines, stage_lines, rest)).drop("_ranked", "_confidence", "_trust")


# --- execution gate -----------------------------------------------------------------------------------


def execution_gate(df: DataFrame, cfg: Config = DEFAULT, action: str = "action", confidence: str = "confidence_score") -> DataFrame:
    """Add ``allowed``, ``mode``, ``reason``. Needs a boolean ``is_trusted``. The texts."""
    conf = F.col(confidence)
    step = (
        F.when(F.col("is_trusted"), F.struct(F.lit(False), F.lit("AUTONOMOUS"), F.lit("IP in allowlist")))
        .when(F.lit(cfg.shadow_mode), F.struct(F.lit(False), F.lit("SHADOW"), F.lit("Shadow mode enabled")))
        .when(F.lit(cfg.human_approval) & F.col(action).isin("BLOCK", "RATE_LIMIT"),
              F.struct(F.lit(False), F.lit("HUMAN_APPROVAL"), F.lit("Queued for human approval")))
        .when(conf >= cfg.high_confidence, F.struct(F.lit(True), F.lit("AUTONOMOUS"), F.lit("High confidence autonomous action")))
        .when(conf >= cfg.medium_confidence, F.struct(F.lit(False), F.lit("AUTONOMOUS"), F.lit("Medium confidence downgraded to ALERT")))
        .otherwise(F.struct(F.lit(False), F.lit("AUTONOMOUS"), F.lit("Low confidence downgraded to MONITOR")))
    )
    return df.withColumn("_g", step).select("*", F.col("_g.col1").alias("allowed"), F.col("_g.col2").alias("mode"), F.col("_g.col3").alias("reason")).drop("_g")


def shadow_rows(gated: DataFrame) -> DataFrame:
    return gated.where(F.col("mode") == "SHADOW").select(
        "log_id", "source_ip", F.col("created_at").alias("timestamp"), F.col("confidence_score").alias("anomaly_score"),
        "risk_level", F.col("action").alias("would_have_taken_action"), F.lit(None).cast("boolean").alias("was_approved_by_human"))


def approval_rows(gated: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return gated.where(F.col("mode") == "HUMAN_APPROVAL").select(
        "log_id", "source_ip", F.col("action").alias("proposed_action"), "confidence_score", F.lit("PENDING").alias("status"),
        (F.col("created_at") + F.make_dt_interval(secs=F.lit(cfg.approval_expiry_seconds))).alias("expires_at"))


# --- explanations --------------------------------------------------------------------------------------


def decision_chain() -> Column:
    """Reasoning lines of the score decision, in order. The line labels."""
    b = F.col("score_breakdown")
    return F.array(
        F.format_string("Base Score: %.4f", b["base_score"]),
        F.concat(F.lit("Kill Chain Multiplier: "), b["kill_chain_multiplier"].cast("string"), F.lit("x")),
        F.format_string("FP Adjustment: %.2f", b["fp_adjustment"]),
        F.concat(F.lit("Escalation Guard Applied: "), b["escalation_guard_applied"].cast("string")),
        F.concat(F.lit("FP Risk Factors: "), F.array_join("fp_factors", ", ")),
    )


def explanation(chain: Column, action: Column, score: Column, risk: Column, ip: Column, incidents: Column, pattern: Column) -> Column:
    """Analyst text of a decision. The sentence templates."""
    lines = F.filter(chain, lambda r: F.lower(r).contains("escalation") | F.lower(r).contains("time") | F.lower(r).contains("multiplier"))
    return F.concat(
        F.format_string("Detected %s risk anomaly (score: %.2f). ", F.coalesce(risk, F.lit("UNKNOWN")), score),
        F.when(F.length(pattern) > 0, F.concat(F.lit("Matches known pattern: "), pattern_title(pattern), F.lit(". "))).otherwise(""),
        F.when(incidents > 0, F.format_string("IP %s has a history of %d prior threat events. ", ip, incidents)).otherwise("First time offense for this IP. "),
        F.when(F.size(lines) > 0, F.concat(F.lit("Key factors: "), F.array_join(lines, "; "), F.lit(". "))).otherwise(""),
        F.lit("Automated response executed: "), action, F.lit("."),
    )


def with_breakdown(text: Column, breakdown: str = "score_breakdown") -> Column:
    """Explanation followed by the score breakdown, one line per entry."""
    lines = F.transform(F.map_entries(breakdown), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"].cast("string")))
    return F.concat(text, F.lit("\n\nScore Breakdown:\n"), F.array_join(lines, "\n"))


def auto_text(df_score: Column, risk: Column, action: Column, ip: Column, prior: Column) -> Column:
    """One-line generated text. The template."""
    return F.concat(
        F.format_string("[Auto-generated] Anomaly detected from %s with combined score %.4f (risk: %s). ", ip, df_score, risk),
        F.concat(F.lit("Action taken: "), action, F.lit(". ")),
        F.format_string("IP has %d prior incident(s). ", prior),
        F.concat(F.lit("Repeated offender: "), F.when(prior >= 3, "True").otherwise("False"), F.lit(".")),
    )
