"""Training and retraining jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlake.functions.scalars import ratio
from threatlake.operators import cleaning, features, iforest, ocsvm, reports
from threatlake.operators.scoring import ensemble, offset_score
from threatlake.session import materialise
from threatlake.sources import model_store


@dataclass(frozen=True)
class Trained:
    scaler: DataFrame
    forest: iforest.IsolationForest
    svm: ocsvm.OneClassSVM
    report: DataFrame


def _need(df: DataFrame, names) -> None:
    if missing := [f for f in names if f not in df.columns]:
        raise ValueError(f"rows lack the models' features {missing}")


def scored(df: DataFrame, forest, svm) -> DataFrame:
    """Raw decision values of both models and their [0, 1] scores. Models of other features are refused."""
    model_store.require_features(svm, list(forest.features))
    _need(df, forest.features)
    return (
        df.withColumn("iso_raw", iforest.raw_score(forest)).withColumn("svm_raw", ocsvm.raw_score(svm))
        .withColumn("iso_score", offset_score("iso_raw")).withColumn("svm_score", offset_score("svm_raw"))
    )


def evaluate(df: DataFrame, forest, svm, label: str = "label") -> DataFrame:
    """Classification reports of each detector and of either one firing."""
    flagged = scored(df, forest, svm).select(label, (F.col("iso_raw") < 0).alias("isolation_forest"), (F.col("svm_raw") < 0).alias("one_class_svm"))
    flagged = flagged.withColumn("either", F.col("isolation_forest") | F.col("one_class_svm"))
    out = None
    for name in ("isolation_forest", "one_class_svm", "either"):
        part = reports.classification_report(flagged, label, name).withColumn("detector", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def train(df: DataFrame, names: list[str], row_id: str, label: str = "label", seed: int = 42, **sizes) -> Trained:
    """Split, scale on the training rows, fit both detectors (the second on normal rows), evaluate on the rest."""
    parts = cleaning.split(df, row_id, label, seed=seed)
    fitted = features.fit_scaler(parts.where("is_train"), names)
    # the fitted statistics are one row; pin them so later passes do not refit
    scaler = df.sparkSession.createDataFrame([fitted.first()], fitted.schema)
    # both fits and the evaluation pass over these rows many times: store them once
    ready = materialise(features.apply_scaler(parts, scaler, names), "training")
    train_rows, test_rows = ready.where("is_train"), ready.where("not is_train")
    forest = iforest.fit(train_rows, names, row_id, seed=seed, **{k: v for k, v in sizes.items() if k in ("trees", "subsample")})
    svm = ocsvm.fit(train_rows.where(F.col(label) == 0), names, row_id, seed=seed, **{k: v for k, v in sizes.items() if k in ("cap", "steps", "dimension")})
    return Trained(scaler, forest, svm, evaluate(test_rows, forest, svm, label))


def save(trained: Trained, root: str) -> int:
    """Publish what was trained as one release."""
    return model_store.publish(trained.scaler.sparkSession, root, trained.scaler, trained.forest, trained.svm)


def score_release(rows: DataFrame, release: model_store.Release) -> DataFrame:
    """Rows with their features scaled and scored by the models of one release, and its number."""
    _need(rows, release.features)
    scaled = features.apply_scaler(rows, release.scaler, list(release.features))
    return ensemble(scored(scaled, release.forest, release.svm)).withColumn("release", F.lit(release.version))


def score_stream(stream: DataFrame, root: str, path: str, checkpoint: str, keep: list[str], **trigger):
    """Score a stream of rows with features; each micro-batch takes the release that is current when it starts.

    Results go to ``path``, a folder a micro-batch, which one that is repeated replaces as a whole; until
    there is a release, micro-batches fail and wait to be repeated.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        release = model_store.load_release(batch.sparkSession, root)
        if release is None:
            raise ValueError(f"no release below {root}")
        score_release(batch, release).select(*keep, "combined_score", "release").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _f1(df: DataFrame, label: str) -> DataFrame:
    tp, fp, fn = (F.count_if(c) for c in ((F.col(label) == 1) & F.col("hit"), (F.col(label) == 0) & F.col("hit"), (F.col(label) == 1) & ~F.col("hit")))
    return df.agg(ratio(tp * 2, tp * 2 + fp + fn).alias("f1"))


def retrain(scores: DataFrame, names: list[str], row_id: str, ts: str, label: str, current=None, rows: int = 10_000, minimum: int = 100, tolerance: float = 0.02, seed: int = 42):
    """Refit the forest on the latest scores; deploy only if its F1 does not fall by the tolerance.

    Returns ``(model or None, one-row outcome)``.
    """
    latest = materialise(reports.newest(scores.select(row_id, ts, label, *names), ts, row_id, rows), "retrain")
    parts = cleaning.split(latest, row_id, seed=seed)
    spark = scores.sparkSession
    have = latest.count()
    schema = "status string, rows bigint, new_f1 double, current_f1 double"
    if have < minimum:
        return None, spark.createDataFrame([("insufficient_data", have, 0.0, 0.0)], schema)
    model = iforest.fit(parts.where("is_train"), names, row_id, seed=seed)
    held_out = parts.where("not is_train")
    new_f1 = _f1(held_out.withColumn("hit", iforest.raw_score(model) < 0), label).first().f1
    old_f1 = _f1(held_out.withColumn("hit", iforest.raw_score(current) < 0), label).first().f1 if current is not None else 0.0
    deploy = new_f1 > old_f1 - tolerance
    return (model if deploy else None), spark.createDataFrame([("deployed" if deploy else "rejected", have, new_f1, old_f1)], schema)
