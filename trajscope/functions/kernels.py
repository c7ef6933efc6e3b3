"""Model-free kernels of the predictors: which frames they see, and how answers become values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator of whole numbers, exact, halves up."""
    return F.floor((2 * numerator + denominator) / (2 * denominator)).cast("long")


def whole_ratio(numerator: Column, denominator: Column) -> Column:
    """Floor division of whole numbers."""
    return (numerator - F.pmod(numerator, denominator)) / denominator


def linspace_rint(n: Column, count: Column) -> Column:
    """count frames from 0 to n - 1 at equal distances, rounded to even; the last frame for a count of 1."""
    step = (n - 1).cast("double") / (count - 1)
    return F.when(count == 1, F.array(n - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.rint(i * step).cast("int")))


def clamped_count(n: Column, fps: Column, sample_fps: float, least: int, most: int) -> Column:
    """Frames at sample_fps, whole ones only, within [least, most] and n."""
    return F.least(F.greatest((n / fps * F.lit(sample_fps)).cast("int"), F.lit(least)), F.lit(most), n)


def prefix_pair(anchor: Column) -> Column:
    """All frames up to the anchor; the first frame twice where there is no other."""
    return F.when(anchor == 0, F.array(F.lit(0), F.lit(0))).otherwise(F.sequence(F.lit(0), anchor))


def ratio_grid(anchor: Column, ratio_top: Column, ratio_bottom: Column) -> Column:
    """Frames round(i * top / bottom) (exact, halves up) up to the anchor, and the anchor."""
    most = F.floor(anchor * ratio_bottom / ratio_top).cast("int") + 1
    every = F.transform(F.sequence(F.lit(0), most), lambda i: round_half_up(i * ratio_top, ratio_bottom).cast("int"))
    return F.array_union(F.array_distinct(F.filter(every, lambda f: f <= anchor)), F.array(anchor))


def uniform_limit(frames: Column, most: int) -> Column:
    """`most` of the frames, equally spaced by place (halves up) with both ends; all if there are no more."""
    last = F.size(frames) - 1
    picked = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(frames, round_half_up(i * last, F.lit(most - 1)).cast("int")))
    return F.when(F.size(frames) <= most, frames).otherwise(picked)


def uniform_indices(n: Column, count: int) -> Column:
    """At most count distinct frames of n, from the first to the last, rounded to even."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.rint(i * (n - 1) / F.lit(float(max(count - 1, 1)))).cast("int"))
    return F.when(n <= count, F.sequence(F.lit(0), n - 1)).otherwise(F.array_distinct(spread))


def history_window(n: Column, anchor: Column, width: int, count: int = 512) -> Column:
    """The last `width` of the uniform frames up to the anchor, with the anchor, padded on the left with the first of them."""
    seen = F.array_union(F.filter(uniform_indices(n, count), lambda f: f <= anchor), F.array(anchor))
    kept = F.slice(seen, F.greatest(F.size(seen) - width + 1, F.lit(1)), F.lit(width))
    return F.concat(F.array_repeat(F.get(kept, F.lit(0)), F.greatest(width - F.size(kept), F.lit(0))), kept)


def step_frames(anchor: Column, step: Column) -> Column:
    """0, step, 2 * step, ... up to the anchor, and the anchor."""
    return F.array_union(F.sequence(F.lit(0), anchor, F.greatest(step, F.lit(1))), F.array(anchor))


def incremental_frames(anchor: Column, fps: Column, hz: float) -> Column:
    return step_frames(anchor, F.rint(fps / F.lit(hz)).cast("int"))


def sample_step(fps: Column, sample_fps: float = 5.0) -> Column:
    """Whole frames between samples at sample_fps; 1 for slower videos."""
    return F.when(fps > sample_fps, F.floor(fps / F.lit(sample_fps)).cast("int")).otherwise(1)


def grid_end(anchor: Column, stride: Column) -> Column:
    """The last grid frame at or before the anchor; what lies beyond is the terminal step."""
    return anchor - F.pmod(anchor, stride)


def hop_progress(hops: Column) -> Column:
    """The first hop, then gains as a share of what is left and losses of what is there; 0 without hops."""
    rest = F.slice(hops, F.lit(2), F.greatest(F.size(hops) - 1, F.lit(0)))
    fold = F.aggregate(rest, F.get(hops, F.lit(0)).cast("double"), lambda v, d: F.when(d >= 0, v + (F.lit(1.0) - v) * d).otherwise(v + v * d))
    return F.when(F.size(hops) > 0, fold).otherwise(0.0)


def three_way_value(forward: Column, backward: Column, hops: Column) -> Column:
    """Mean of the progress from the start, that to the goal, and that of the hops between."""
    return (forward + (F.lit(1.0) + backward) + hop_progress(hops)) / 3


def ensemble_mean(values: Column) -> Column:
    """Mean of the estimates of several predictors; null without any."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, v: s + v), F.size(values).cast("double"))


def log_softmax_at(logits: Column, place: Column) -> Column:
    """Log-probability of one of the logits."""
    top = F.array_max(logits)
    return F.get(logits, place) - top - F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def is_close(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))


def remaining_value(remaining: Column) -> Column:
    """Less remaining time is more value."""
    return -remaining
