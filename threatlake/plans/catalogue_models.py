"""The registered queries, part 3: model training and scoring (checked by row counts and tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatlake.operators import cleaning, features, iforest, ocsvm
from threatlake.operators.scoring import ensemble, offset_score
from threatlake.plans import training
from threatlake.plans.derived import Derived
from threatlake.plans.registry import query
from threatlake.session import materialise


def _rows(d: Derived):
    names = features.DETECT7
    rows = features.detect7(d.flows, d.cfg).select("log_id", "ts", F.col("is_attack").cast("int").alias("label"), *names)
    return materialise(rows, "features"), names  # fitting passes over the rows many times


@query
def m4_train_split(d: Derived):
    rows = d.flows.select("log_id", F.col("is_attack").cast("int").alias("label"))
    return cleaning.split(rows, "log_id", "label")


@query
def m5_isolation_forest(d: Derived):
    rows, names = _rows(d)
    model = iforest.fit(rows, names, "log_id")
    return rows.select("log_id", iforest.raw_score(model).alias("raw")).select("log_id", "raw", offset_score("raw").alias("iso_score"), (F.col("raw") < 0).alias("outlier"))


@query
def m6_one_class_svm(d: Derived):
    rows, names = _rows(d)
    normal = rows.where("label = 0")
    scaled = features.apply_scaler(rows, features.fit_scaler(normal, names), names)
    model = ocsvm.fit(scaled.where("label = 0"), names, "log_id")
    return scaled.select("log_id", ocsvm.raw_score(model).alias("raw")).select("log_id", "raw", offset_score("raw").alias("svm_score"), (F.col("raw") < 0).alias("outlier"))


@query
def m8_model_ensemble(d: Derived):
    rows, names = _rows(d)
    made = training.train(rows, names, "log_id", steps=8)
    ready = features.apply_scaler(rows, made.scaler, names)
    return ensemble(training.scored(ready, made.forest, made.svm)).select("log_id", "combined_score", "confidence", "is_anomaly", "risk_level")


@query
def m12_retrain(d: Derived):
    names = ["iso_score", "svm_score", "combined", "session_deviation"]
    rows = d.scores.select("log_id", "ts", F.col("is_attack").cast("int").alias("label"), *names)
    return training.retrain(rows, names, "log_id", "ts", "label")[1]


@query
def m13_training_report(d: Derived):
    rows, names = _rows(d)
    return training.train(rows, names, "log_id", steps=8).report


@query
def m13_registered_report(d: Derived):
    """Training on the registered folder: the rows that each detector's report stands for."""
    names = ["duration", "src_bytes", "dst_port", "packets"]
    rows = materialise(d.registered.select("label", *(F.col(c).cast("double").alias(c) for c in names)).withColumn("row_id", F.monotonically_increasing_id()), "registered-rows")
    report = training.train(rows, names, "row_id", trees=20, steps=4).report
    rates = F.greatest("precision", "recall", "f1").between(0, 1) & F.least("precision", "recall", "f1").between(0, 1)
    return report.select("detector", "class", "support", rates.alias("rates_hold"))
