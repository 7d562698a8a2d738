"""Scalars on counts, intervals, probabilities and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: bands of F1, half-open
BANDS = [("broken", 0.0, 0.2), ("weak", 0.2, 0.45), ("baseline", 0.45, 0.6), ("competitive", 0.6, 0.75), ("strong", 0.75, 0.85), ("excellent", 0.85, 1.01)]


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; 0 where undefined."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, ratio(2 * p * r, p + r)


def iou(sa: Column, ea: Column, sb: Column, eb: Column) -> Column:
    """Overlap of two half-open intervals over their union; 0 if apart."""
    both = F.greatest(F.least(ea, eb) - F.greatest(sa, sb), F.lit(0))
    return ratio(both, F.greatest(ea, eb) - F.least(sa, sb))


def shift_span(start: Column, end: Column, d_start: Column, d_end: Column, n: Column) -> Column:
    """struct(start, end) less the offsets, clamped to [0, n]; unchanged if that leaves nothing."""
    s = F.greatest(F.least(start - d_start, n), F.lit(0))
    e = F.greatest(F.least(end - d_end, n), F.lit(0))
    ok = s < e
    return F.struct(F.when(ok, s).otherwise(start).alias("start"), F.when(ok, e).otherwise(end).alias("end"))


def window_count(n: Column, length: int, stride: int, special: int = 2) -> Column:
    """Windows that n tokens need: bodies of ``length - special`` that overlap by ``stride``."""
    body = max(length - special, 1)
    step = max(body - min(stride, body - 1), 1)
    return F.when(n <= body, 1).otherwise(1 + F.ceil((n - body) / step)).cast("long")


def max_positions(requested: int, positions: int, pad: int, kind: str, roberta: tuple[str, ...] = ("roberta", "xlm-roberta", "camembert")) -> int:
    """The usable length: models that count positions from the padding lose ``pad + 1``."""
    budget = positions - pad - 1 if kind in roberta else positions
    if requested < 1 or budget < 8:
        raise ValueError("no usable length")
    return min(requested, budget)


def band(f1: Column) -> Column:
    """The band of an F1; below the first is the first, above the last the last."""
    out = F.lit(BANDS[0][0])
    for name, low, _ in BANDS[1:]:
        out = F.when(f1 >= low, name).otherwise(out)
    return out


def confidence_reading(gap: Column) -> Column:
    return F.when(gap > 0.02, "overconfident").when(gap < -0.02, "underconfident").otherwise("calibrated")


def error_reading(exact: Column, mismatch: Column, same: Column, diff: Column, missed: Column, spurious: Column, type_accuracy: Column, boundary_f1: Column) -> Column:
    """The main kind of error; the questions are asked in this order."""
    found = exact + mismatch + same + diff
    gold = found + missed
    return (
        F.when((gold == 0) & (spurious == 0), "empty")
        .when((mismatch >= 1) & (ratio(mismatch, found) >= 0.25) & (mismatch >= same), "type_confusion")
        .when((same >= 1) & (ratio(same + diff, gold) >= 0.15) & (same >= mismatch), "boundary_jitter")
        .when((ratio(missed, gold) >= 0.35) | ((spurious > exact) & (exact < gold * 0.5)), "detection_gap")
        .when((type_accuracy >= 0.9) & (boundary_f1 >= 0.7), "healthy")
        .otherwise("mixed")
    )


def bin_of(confidence: Column, n_bins: int) -> Column:
    """Equal-width bin of a confidence in [0, 1]; 1.0 is in the last."""
    c = F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1 - 1e-12))
    return F.least(F.floor(c * n_bins), F.lit(n_bins - 1)).cast("int")


def parse_instant(text: Column) -> Column:
    """Seconds since the epoch; 0 if the text is no instant."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(text)) / 1e6, F.lit(0.0))


def mean_std(x: Column) -> tuple[Column, Column]:
    """Mean and sample standard deviation, 0 for one value."""
    return F.avg(x), F.coalesce(F.stddev_samp(x), F.lit(0.0))


def throughput_batch(cap: Column) -> Column:
    """The largest of 8, 4, 2, 1 not above a cap."""
    return F.when(cap >= 8, 8).when(cap >= 4, 4).when(cap >= 2, 2).otherwise(1)


def wallclock_hours(windows: Column, batch: Column, steps_per_second: Column, epochs: int = 3, tax: float = 0.15) -> Column:
    return F.ceil(windows / batch) * epochs / steps_per_second * (1 + tax) / 3600


def size_product(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x)


def gigabytes(size: Column) -> Column:
    return F.round(size / F.lit(1024.0**3), 3)


def hours_text(hours: Column) -> Column:
    """Whole minutes below one hour, else hours with two decimals; n/a for null."""
    return F.when(hours.isNull(), "n/a").when(hours < 1, F.format_string("%.0f min", hours * 60)).otherwise(F.format_string("%.2f h", hours))


def training_recipe(fit_512: Column, fit_512_saving: Column, fit_256: Column, reserved: Column) -> Column:
    """struct(verdict, max_length, micro_batch, grad_accum, checkpointing) from the largest batches that fit.

    The columns are the largest batch at 512 tokens, the same with recomputed activations, at
    256 tokens (null or 0: none fits), and the GB reserved at the one that is taken.
    """
    ok = lambda c: F.coalesce(c > 0, F.lit(False))
    fit = F.when(ok(fit_512), fit_512).when(ok(fit_512_saving), fit_512_saving).when(ok(fit_256), fit_256)
    length = F.when(ok(fit_512) | ok(fit_512_saving), 512).otherwise(256)
    gb = F.coalesce(reserved, F.lit(0.0))
    short = (length == 512) & (fit <= 2)
    less = F.when((fit >= 16) & (gb >= 4.5), 16).when((fit >= 4) & (gb >= 5.2), F.greatest(F.floor(fit / 2), F.lit(2))).otherwise(fit)
    micro = F.when(short, fit).otherwise(less).cast("int")
    verdict = F.when(fit.isNull(), "impossible").when(short, "tight").when((micro >= 8) & (gb <= 5.2), "easy").otherwise("tight")
    steps = F.when(micro.isNull() | (micro >= 16), 1).otherwise(F.ceil(16 / micro)).cast("int")
    return F.struct(verdict.alias("verdict"), length.alias("max_length"), F.coalesce(micro, F.lit(0)).alias("micro_batch"), steps.alias("grad_accum"), (~ok(fit_512) & ok(fit_512_saving)).alias("checkpointing"))


def json_text(value: Column) -> Column:
    """Any struct, map or array as JSON, nulls included."""
    return F.to_json(value, {"ignoreNullFields": "false"})
