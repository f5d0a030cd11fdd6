"""Confidence that can be trusted for routing (J3, J5): isotonic calibration and thresholds.

A model's own confidence is seldom the share of right answers (naive Bayes is far too sure).
Held-out rows give a histogram of confidences with the right answers of each bin, combined
within tasks; the pool-adjacent-violators rule fits the non-decreasing step function of least
squares to it. The fit's input is the histogram, ``bins`` rows at most whatever the data, and
its result is a constant in the plan, so calibrated routing works row by row, streams included.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 100


def confidence_bin(confidence: Column, bins: int = BINS) -> Column:
    """Bin 0 to bins - 1 of a confidence from 0 to 1 (rounded to six digits first, so that the
    order in which a model added its terms decides no bin); null for a null one."""
    c = F.round(confidence, 6)
    # least and greatest pass over nulls
    return F.when(c.isNotNull(), F.greatest(F.lit(0), F.least(F.floor(c * bins), F.lit(bins - 1)))).cast("int")


def histogram(df: DataFrame, correct: Column, conf_col: str = "confidence", bins: int = BINS,
              by: list[str] | None = None) -> DataFrame:
    """(by..., bin, n_rows, n_correct, mean_confidence); rows without a confidence are left to
    no bin."""
    return df.where(F.col(conf_col).isNotNull()).groupBy(
        *(by or []), confidence_bin(F.col(conf_col), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(correct, 1)).alias("n_correct"),
        F.avg(F.round(conf_col, 6)).alias("mean_confidence"))


def pool(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Blocks (first bin, rows, right ones) of the isotonic fit to (bin, rows, right ones) in
    order of bins: neighbours are pooled while the right one's share is not the larger."""
    out: list[tuple[int, int, int]] = []
    for b, n, k in counts:
        out.append((b, n, k))
        while len(out) > 1 and out[-2][2] * out[-1][1] >= out[-1][2] * out[-2][1]:
            (_, n2, k2), (b1, n1, k1) = out.pop(), out.pop()
            out.append((b1, n1 + n2, k1 + k2))
    return out


@dataclass
class Calibration:
    """The blocks of an isotonic fit over ``bins`` bins, with increasing shares."""
    bins: int
    blocks: list[tuple[int, int, int]]

    def calibrated(self, confidence: Column) -> Column:
        """The share of right answers to expect (that of the block of the next lower bin that
        had rows; of the first block below all). Null without a confidence or a fit."""
        if not self.blocks:
            return F.lit(None).cast("double")
        values, at = [], 0
        for b in range(self.bins):
            while at + 1 < len(self.blocks) and self.blocks[at + 1][0] <= b:
                at += 1
            values.append(self.blocks[at][2] / self.blocks[at][1])
        return F.get(F.array(*map(F.lit, values)), confidence_bin(confidence, self.bins))

    def threshold_bin(self, wanted: float) -> int | None:
        """The least bin from which on the fitted rows were right in ``wanted`` of all cases
        or more; None if no block is good enough. Blocks are taken whole, and as later
        ones are better, every higher threshold is at least as accurate."""
        n = k = 0
        best = None
        for b, rows, right in reversed(self.blocks):
            n, k = n + rows, k + right
            if k < wanted * n:
                break
            best = b
        return best

    def auto(self, confidence: Column, wanted: float) -> Column:
        """Is a prediction sure enough to be right in ``wanted`` of all cases?"""
        b = self.threshold_bin(wanted)
        return F.lit(False) if b is None else F.coalesce(confidence_bin(confidence, self.bins) >= b, F.lit(False))


def fit(df: DataFrame, correct: Column, conf_col: str = "confidence", bins: int = BINS) -> Calibration:
    """The isotonic fit to held-out rows: not those that the model was fitted on."""
    counts = histogram(df, correct, conf_col, bins).select("bin", "n_rows", "n_correct").collect()
    return Calibration(bins, pool(sorted(map(tuple, counts))))


def reliability(df: DataFrame, correct: Column, calibration: Calibration, conf_col: str = "confidence",
                by: list[str] | None = None) -> DataFrame:
    """(by..., bin, n_rows, n_correct, mean_confidence, accuracy, calibrated): what a model
    says, what is right, and what the calibration expects, for each bin that has rows."""
    h = histogram(df, correct, conf_col, calibration.bins, by)
    # the middle of a bin falls into that bin
    expected = calibration.calibrated((F.col("bin") + 0.5) / calibration.bins)
    return h.select(*(by or []), "bin", "n_rows", "n_correct", F.round("mean_confidence", 6).alias("mean_confidence"),
                    F.round(F.col("n_correct") / F.col("n_rows"), 6).alias("accuracy"),
                    F.round(expected, 6).alias("calibrated"))


def calibrated_routing(df: DataFrame, correct: Column, calibration: Calibration, wanted: list[float],
                       conf_col: str = "confidence") -> DataFrame:
    """(wanted, threshold, n_rows, n_auto, auto_rate, auto_accuracy) of rows that the fit has
    not seen, for each wanted accuracy. Rows below the threshold, or without a confidence,
    are left to people; without a threshold all are, and there is no accuracy."""
    def cut(w: float) -> Column:
        b = calibration.threshold_bin(w)
        return F.lit(None if b is None else b / calibration.bins).cast("double")

    each = df.select(correct.alias("_ok"), F.inline(F.array(*[F.struct(
        F.lit(w).alias("wanted"), cut(w).alias("threshold"),
        calibration.auto(F.col(conf_col), w).alias("_auto")) for w in wanted])))
    n_auto = F.count(F.when(F.col("_auto"), 1))
    return each.groupBy("wanted", "threshold").agg(
        F.count(F.lit(1)).alias("n_rows"), n_auto.alias("n_auto"),
        F.round(n_auto / F.count(F.lit(1)), 6).alias("auto_rate"),
        F.round(F.count(F.when(F.col("_auto") & F.col("_ok"), 1)) / F.when(n_auto > 0, n_auto), 6).alias("auto_accuracy"))
