"""Statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The normal quantile of a two-sided 95 % interval; fixed value.
Z_95 = 1.959963984540054
#: Length bands: name, and the first length beyond it; fixed values.
BANDS = (("chars-1-499", 500), ("chars-500-999", 1000), ("chars-1000-1999", 2000), ("chars-2000-3999", 4000), ("chars-4000-plus", None))


def wilson(successes: Column, total: Column, side: str) -> Column:
    """The ``lower`` or ``upper`` bound of Wilson's 95 % interval; null for no trials."""
    n = F.nullif(total.cast("double"), F.lit(0.0))
    p, z2 = successes / n, Z_95**2
    centre = p + z2 / (2 * n)
    margin = Z_95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    value = (centre - margin if side == "lower" else centre + margin) / (1 + z2 / n)
    clamped = F.greatest(F.lit(0.0), value) if side == "lower" else F.least(F.lit(1.0), value)
    return F.when(n.isNotNull(), clamped)


def half_open(day: Column, lo: str, hi: str) -> Column:
    """Whether a date lies in [lo, hi)."""
    day = day.cast("date")
    return (day >= F.lit(lo).cast("date")) & (day < F.lit(hi).cast("date"))


def calibration_part(day: Column, fit: str, evaluation: str) -> Column:
    """fit or evaluation by the month (YYYY-MM) of a date; null in any other."""
    month = F.date_format(day, "yyyy-MM")
    return F.when(month == fit, "fit").when(month == evaluation, "evaluation")


def metric(value: Column) -> Column:
    """A metric at 6 digits, with an error unless it is finite and in [0, 1]."""
    sound = value.isNotNull() & ~F.isnan(value.cast("double")) & (value >= 0) & (value <= 1)
    return F.when(sound, F.round(value.cast("double"), 6)).otherwise(F.raise_error(F.lit("metric_out_of_range")).cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b at 6 digits; null for b = 0."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)


def spread(key: Column, seed: int) -> Column:
    """A whole number below 2^60 by the MD5 of a key and a seed: the same on any engine."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 15), 16, 10).cast("long")


def nearest_rank(column: str, share: float) -> Column:
    """The smallest value with at least this share of the values at or below it."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {column})")


def length_band(length: Column) -> Column:
    out = F.when(length < 1, F.lit(None).cast("string"))
    for name, beyond in BANDS:
        out = out.when(F.lit(True) if beyond is None else length < beyond, name)
    return out


def temporal_assignment(day: Column, validation: str, test: str, start: str, end: str) -> Column:
    """train, validation or test by half-open windows; an error outside all of them."""
    day = day.cast("date")
    return (
        F.when(~half_open(day, start, end) | day.isNull(), F.raise_error(F.lit("split_date_outside_window")).cast("string"))
        .when(day < F.lit(validation).cast("date"), "train")
        .when(day < F.lit(test).cast("date"), "validation")
        .otherwise("test")
    )


def softmax(scores: Column, temperature: float = 1.0) -> Column:
    """Probabilities of an array of scores, stable for large ones."""
    top = F.array_max(scores)
    grown = F.transform(scores, lambda z: F.exp((z - top) / F.lit(temperature)))
    total = F.aggregate(grown, F.lit(0.0), lambda a, x: a + x)
    return F.transform(grown, lambda x: x / total)


def log_loss(scores: Column, label: Column, temperature: float = 1.0) -> Column:
    """Negative log-likelihood of the label (from 0) under the softmax of scores."""
    scaled = F.transform(scores, lambda z: z / F.lit(temperature))
    top = F.array_max(scaled)
    total = F.aggregate(scaled, F.lit(0.0), lambda a, z: a + F.exp(z - top))
    return top + F.log(total) - F.element_at(scaled, label.cast("int") + 1)


def brier(probabilities: Column, label: Column) -> Column:
    """Squared distance of probabilities from the label's one-hot vector."""
    return F.aggregate(F.transform(probabilities, lambda p, i: F.pow(p - (i == label).cast("double"), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)


def first_of_top(values: Column) -> Column:
    """The index, from 0, of the largest value; the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def in_top_two(values: Column, label: Column) -> Column:
    """Whether the label's index is among the two largest values, smaller indices first on ties."""
    ranked = F.reverse(F.array_sort(F.transform(values, lambda v, i: F.struct(v.alias("v"), (-i).alias("i")))))
    return F.exists(F.slice(ranked, 1, 2), lambda x: -x["i"] == label)


def share_to_weight(count: Column, total: Column, classes: Column) -> Column:
    """Square-root balanced class weight."""
    return F.sqrt(total / (classes * count))


def warmup_linear(step: Column, total: int, warmup_share: float = 0.06) -> Column:
    """Learning-rate factor: linear rise over the warm-up steps, then linear fall to 0."""
    warm = int(total * warmup_share)
    rise = step / F.lit(max(1, warm))
    fall = F.greatest(F.lit(0.0), (total - step) / F.lit(max(1, total - warm)))
    return F.when(step < warm, rise).otherwise(fall)


def optimizer_steps(rows: Column, batch: int = 16, accumulation: int = 2) -> Column:
    """Steps of an epoch: batches, the last one short, gathered ``accumulation`` at a time."""
    return F.ceil(F.ceil(rows / batch) / accumulation)


def winner(ours: Column, theirs: Column) -> Column:
    return F.when(ours > theirs, "baseline").when(theirs > ours, "candidate").otherwise("tie")
