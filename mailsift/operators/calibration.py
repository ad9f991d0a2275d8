"""Reliability curves, calibration error and the calibration gate; isotonic fit on the train side."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, Window, functions as F

from mailsift import vocabulary as V
from mailsift.functions.numeric import clamp_unit
from mailsift.operators.ordered import CHUNK, ordered_chunks
from mailsift.session import cut_lineage


def reliability_curve(
    scored: DataFrame, score: str, positive: str, bins: int = V.CALIBRATION_BINS, by: tuple[str, ...] = ()
) -> DataFrame:
    """Equal-width bins with 1.0 in the last one; empty bins are kept with zeros."""
    index = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    counted = scored.groupBy(*by, index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("mean_predicted"),
        F.avg(F.col(positive).cast("double")).alias("observed"),
    )
    spine = counted.select(*by).distinct() if by else scored.sparkSession.range(1).select()
    spine = spine.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    zero = lambda name, value: F.coalesce(name, F.lit(value)).alias(name)
    return spine.join(counted, [*by, "bin"], "left").select(
        *by, "bin", (F.col("bin") / bins).alias("lower_edge"), ((F.col("bin") + 1) / bins).alias("upper_edge"),
        zero("n", 0), zero("mean_predicted", 0.0), zero("observed", 0.0),
    )


def calibration_error(curve: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    gap = F.sum(F.col("n") * F.abs(F.col("mean_predicted") - F.col("observed")))
    total = F.sum("n")
    return curve.groupBy(*by).agg(
        total.alias("samples"), F.when(total == 0, F.lit(0.0)).otherwise(gap / F.nullif(total, F.lit(0))).alias("ece")
    )


def reliability_report(
    scored: DataFrame, raw: str, calibrated: str, positive: str, bins: int = V.CALIBRATION_BINS
) -> DataFrame:
    """Raw and calibrated error of the same rows, and what calibration gained."""
    one = lambda score: calibration_error(reliability_curve(scored, score, positive, bins))
    before, after = one(raw), one(calibrated)
    return before.select("samples", F.col("ece").alias("ece_raw")).withColumn(
        "ece_calibrated", after.select("ece").scalar()
    ).withColumn("improvement", F.col("ece_raw") - F.col("ece_calibrated"))


def calibration_gate(report: DataFrame, model_version: str, max_ece: float = V.MAX_ECE) -> DataFrame:
    passed = F.col("ece_calibrated") <= max_ece
    # Fixed value: the wording of the message.
    reason = F.format_string(
        "calibrated ECE %.4f %s ceiling %.4f for model %s (raw ECE was %.4f)",
        F.col("ece_calibrated"), F.when(passed, F.lit("within")).otherwise(F.lit("exceeds")),
        F.lit(max_ece), F.lit(model_version), F.col("ece_raw"),
    )
    return report.withColumn("passed", passed).withColumn("reason", reason)


def enough_samples(split: DataFrame, minimum: int = V.MIN_CALIBRATION_SAMPLES) -> DataFrame:
    """One row: whether both sides hold enough labelled scores to fit and to measure."""
    side = F.col("split_side")
    return split.agg(
        F.count_if(side == "train").alias("train_samples"), F.count_if(side == "eval").alias("eval_samples")
    ).withColumn("enough", F.least("train_samples", "eval_samples") >= minimum)


def fit_isotonic(scored: DataFrame, raw: str, positive: str) -> IsotonicRegressionModel:
    """Isotonic fit of polarity on the raw score.

    Equal scores are pooled into one weighted point first, so the fit sees one row per distinct score.
    """
    points = scored.groupBy(F.col(raw).alias("_x")).agg(
        F.avg(F.col(positive).cast("double")).alias("_y"), F.count(F.lit(1)).cast("double").alias("_w")
    )
    return IsotonicRegression(featuresCol="_x", labelCol="_y", weightCol="_w").fit(points)


def pool(low: np.ndarray, high: np.ndarray, weight: np.ndarray, total: np.ndarray) -> list[tuple[float, float, float, float, int]]:
    """Blocks in rising order of scores with every pair of adjacent violators pooled: (low, high, weight, total, first row)."""
    done: list[tuple[float, float, float, float, int]] = []
    for at, (a, b, w, t) in enumerate(zip(low.tolist(), high.tolist(), weight.tolist(), total.tolist())):
        block = (a, b, w, t, at)
        # Means are compared by cross products, which are exact for counts.
        while done and done[-1][3] * block[2] >= block[3] * done[-1][2]:
            last = done.pop()
            block = (last[0], block[1], last[2] + block[2], last[3] + block[3], last[4])
        done.append(block)
    return done


def isotonic_blocks(scored: DataFrame, raw: str, positive: str) -> DataFrame:
    """low, high, n and value of the blocks of the isotonic fit, in which no rows reach the driver.

    Equal scores are one weighted point. Points lie in range chunks; a round pools adjacent violators inside every two
    neighbouring chunks, the pairs shifted by one from round to round, until no chunk begins at or below the mean its
    neighbour ends with. Pooling may go in any order, so the blocks are those of one pass over all points; a task
    holds two chunks, and a block that spans many chunks is one row. Rows without a score or a label teach nothing.
    """
    known = scored.filter(F.col(raw).isNotNull() & F.col(positive).isNotNull())
    points = known.groupBy(F.col(raw).cast("double").alias("low")).agg(
        F.count(F.lit(1)).cast("double").alias("weight"), F.sum(F.col(positive).cast("double")).alias("total")
    )
    layout = f"low double, high double, weight double, total double, {CHUNK} int"
    blocks = ordered_chunks(points.withColumn("high", F.col("low")), ["low"]).select("low", "high", "weight", "total", CHUNK)

    def pooled(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("low")
        found = pool(*(frame[n].to_numpy() for n in ("low", "high", "weight", "total")))
        rows = pd.DataFrame([b[:4] for b in found], columns=["low", "high", "weight", "total"])
        return rows.assign(**{CHUNK: frame[CHUNK].to_numpy()[[b[4] for b in found]]})

    turn = 0
    while True:
        # Chunks that still hold blocks, numbered in order; one row a chunk.
        ends = blocks.groupBy(CHUNK).agg(
            F.min_by(F.struct("weight", "total"), "low").alias("first"), F.max_by(F.struct("weight", "total"), "low").alias("last")
        )
        along = Window.partitionBy(F.lit(0)).orderBy(CHUNK)
        placed = cut_lineage(ends.withColumn("place", F.row_number().over(along)).withColumn("before", F.lag("last").over(along)))
        falls = F.col("before.total") * F.col("first.weight") >= F.col("first.total") * F.col("before.weight")
        if turn > 1 and placed.filter(falls).isEmpty():
            break
        pair = F.floor((F.col("place") + turn % 2) / 2)
        dealt = blocks.join(placed.select(CHUNK, pair.alias("pair")), CHUNK)
        blocks = cut_lineage(dealt.groupBy("pair").applyInPandas(pooled, layout))
        turn += 1
    return blocks.select("low", "high", F.col("weight").cast("long").alias("n"), (F.col("total") / F.col("weight")).alias("value"))


def apply_isotonic(model: IsotonicRegressionModel, df: DataFrame, raw: str, out: str = "calibrated_confidence") -> DataFrame:
    """Clamped outside the fitted range, linear between fitted points."""
    return (
        model.setFeaturesCol(raw).setPredictionCol("_fit").transform(df)
        .withColumn(out, clamp_unit(F.col("_fit"))).drop("_fit")
    )


def interpolated(raw: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Value on the line through given (raw, calibrated) points, in rising order; clamped outside them."""
    value = F.lit(float(points[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:]))):
        value = F.when(raw <= x1, F.lit(float(y0)) + (raw - F.lit(float(x0))) * F.lit((y1 - y0) / (x1 - x0))).otherwise(value)
    return F.when(raw <= points[0][0], F.lit(float(points[0][1]))).otherwise(value)


def calibrate(scored: DataFrame, raw: str, model_version: str, max_ece: float = V.MAX_ECE) -> tuple[IsotonicRegressionModel, DataFrame]:
    """Fit on the train side, measure on the eval side, and judge. Reads split_side and positive."""
    check = enough_samples(scored).first()
    if not check["enough"]:
        raise ValueError(f"too few samples: {check['train_samples']} to fit, {check['eval_samples']} to measure")
    model = fit_isotonic(scored.filter("split_side = 'train'"), raw, "positive")
    held_out = apply_isotonic(model, scored.filter("split_side = 'eval'"), raw, "calibrated")
    report = reliability_report(held_out, raw, "calibrated", "positive")
    return model, calibration_gate(report, model_version, max_ece)
