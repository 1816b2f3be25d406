"""Interval scores, frame choice and clip arithmetic over ``array<array<double>>`` and numbers, as native columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIRS = "cast(array() as array<array<double>>)"


def ngiou(a: Column, b: Column) -> Column:
    """Generalised IoU of two ``[start, end]`` moved to [0, 1]."""
    inter = F.greatest(F.lit(0.0), F.least(a[1], b[1]) - F.greatest(a[0], b[0]))
    union = (a[1] - a[0]) + (b[1] - b[0]) - inter
    hull = F.greatest(a[1], b[1]) - F.least(a[0], b[0])
    return F.when((union > 0) & (hull > 0), (inter / union - (hull - union) / hull + 1) / 2).otherwise(0.0)


def merged(segments: Column) -> Column:
    """Overlapping or touching segments as one, in order."""

    def add(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.array(last[0], F.greatest(last[1], s[1]))))
        return F.when((F.size(acc) > 0) & (s[0] <= last[1]), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(segments), F.expr(PAIRS), add)


def total_length(segments: Column) -> Column:
    return F.aggregate(segments, F.lit(0.0), lambda acc, s: acc + s[1] - s[0])


def coverage_iou(a: Column, b: Column) -> Column:
    """IoU of two unions of segments; 0 if both are empty."""
    both = F.flatten(F.transform(merged(a), lambda x: F.transform(merged(b), lambda y: F.greatest(F.lit(0.0), F.least(x[1], y[1]) - F.greatest(x[0], y[0])))))
    inter = F.aggregate(both, F.lit(0.0), lambda acc, x: acc + x)
    union = total_length(merged(a)) + total_length(merged(b)) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def local_ngiou(a: Column, b: Column) -> Column:
    """Mean NGIoU of segments paired by their order of start; those without a partner count 0."""
    paired = F.zip_with(F.array_sort(a), F.array_sort(b), lambda x, y: F.coalesce(ngiou(x, y), F.lit(0.0)))
    return F.when(F.size(paired) > 0, F.aggregate(paired, F.lit(0.0), lambda acc, x: acc + x) / F.size(paired)).otherwise(0.0)


def count_reward(n_pred: Column, n_true: Column, sigma: float = 1.0) -> Column:
    """``exp(-|difference| / (min(n_true, 3) * sigma))``; 0 without a truth."""
    return F.when(n_true > 0, F.exp(-F.abs(n_pred - n_true) / (F.least(n_true, F.lit(3)) * F.lit(sigma)))).otherwise(0.0)


def frame_span(start: Column, end: Column, fps: Column) -> Column:
    """``struct<first, last>`` of the 0-based frames from ``start`` to before ``end`` at ``fps``; one frame at least."""
    first = F.greatest(F.lit(0), F.ceil(start * fps - F.lit(1e-6)).cast("long"))
    last = F.greatest(first, F.ceil(end * fps - F.lit(1e-6)).cast("long") - 1)
    return F.struct(first.alias("first"), last.alias("last"))


def uniform_indices(n: Column, k: Column) -> Column:
    """At most ``k`` indices of ``0..n-1``, evenly spread with half-even rounding, without repeats."""
    last = F.when(k > 1, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(k.cast("long") - 1, F.lit(0).cast("long"))), lambda i: F.bround(i * (n - 1) / (k - 1).cast("double"), 0).cast("long")))
    every = F.sequence(F.lit(0).cast("long"), F.greatest(n.cast("long") - 1, F.lit(0).cast("long")))
    none = F.expr("cast(array() as array<bigint>)")
    return F.when((n <= 0) | (k <= 0), none).when(k >= n, every).when(k == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(last))


def strided_indices(n: Column, source_fps: Column, target_fps: Column) -> Column:
    """Indices of ``n`` frames thinned from one rate to another, by a whole stride where that is exact, else by the nearest frame in time."""
    ratio = source_fps / target_fps
    every = F.sequence(F.lit(0).cast("long"), F.greatest(n.cast("long") - 1, F.lit(0).cast("long")))
    stride = F.bround(ratio, 0).cast("long")
    count = F.greatest(F.lit(1).cast("long"), F.ceil(n / ratio - F.lit(1e-9)).cast("long"))
    nearest = F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.least(n.cast("long") - 1, F.bround(i * ratio, 0).cast("long"))))
    return F.when(n <= 0, F.expr("cast(array() as array<bigint>)")).when(ratio <= 1, every).when(
        F.abs(ratio - stride) < 1e-6, F.filter(every, lambda i: i % stride == 0)
    ).otherwise(nearest)


def parse_policy(text: str) -> list[tuple[float, float, float]]:
    """Rules ``low:high:fps`` separated by commas; ``inf`` is allowed as an upper bound."""
    rules = []
    for part in text.split(","):
        low, high, fps = (float(x) for x in part.strip().split(":"))
        if low > high or fps <= 0:
            raise ValueError(f"bad rule {part!r}")
        rules.append((low, high, fps))
    return rules


def policy_fps(duration: Column, rules: Sequence[tuple[float, float, float]]) -> Column:
    """The rate of the first rule whose bounds, both inclusive, hold the duration; null if none does."""
    out = None
    for low, high, fps in rules:
        fits = duration.between(F.lit(low), F.lit(high))
        out = F.when(fits, F.lit(fps)) if out is None else out.when(fits, F.lit(fps))
    return out


def shared_fps(duration: Column, target: float, fallback: float, budget: int, least: float) -> Column:
    """The target rate if its frames fit the budget, else the fallback, else what fits, but ``least`` at least."""
    return (
        F.when(duration * F.lit(target) <= budget, F.lit(target)).when(duration * F.lit(fallback) <= budget, F.lit(fallback)).otherwise(F.greatest(F.lit(least), F.lit(float(budget)) / duration))
    )


def padded_bounds(start: Column, end: Column, pad: int, most: int, duration: Column) -> Column:
    """``struct<s, e>`` in whole seconds: padded at both ends within the clip, then trimmed to ``most`` seconds, from the start by
    half of what is over, but not into the event."""
    s = F.greatest(F.lit(0).cast("long"), start.cast("long") - pad)
    e = F.least(duration.cast("long"), end.cast("long") + pad)
    over = F.greatest(F.lit(0).cast("long"), e - s - most)
    moved = s + F.least(F.floor(over / 2).cast("long"), start.cast("long") - s)
    return F.struct(F.when(over > 0, moved).otherwise(s).alias("s"), F.when(over > 0, moved + most).otherwise(e).alias("e"))


def zero_based(children: Column, start: Column, end: Column) -> Column:
    """``[s, e]`` children cut to a parent's span and counted from its start; what is then empty is dropped."""
    cut = F.transform(children, lambda c: F.array(F.greatest(c[0], start) - start, F.least(c[1], end) - start))
    return F.filter(cut, lambda c: c[0] < c[1])


def boundary_segments(boundaries: Column, duration: Column) -> Column:
    """Consecutive segments between boundaries, from 0 to the duration; empty ones are dropped."""
    inside = F.array_sort(F.array_distinct(F.filter(boundaries, lambda b: (b > 0) & (b < duration))))
    cuts = F.concat(F.array(F.lit(0.0)), inside, F.array(duration))
    pairs = F.zip_with(F.slice(cuts, 1, F.size(cuts) - 1), F.slice(cuts, 2, F.size(cuts)), lambda a, b: F.array(a, b))
    return F.filter(pairs, lambda p: p[0] < p[1])


def sliding_windows(total: Column, width: int = 128, stride: int = 64, least: int = 32) -> Column:
    """``[s, e]`` windows over whole seconds; the last may be shorter, but not than ``least``."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(total.cast("long") - 1, F.lit(0).cast("long")), F.lit(stride).cast("long"))
    spans = F.transform(starts, lambda s: F.array(s, F.least(s + width, total.cast("long"))))
    kept = F.filter(spans, lambda w, i: (w[1] - w[0] >= least) & ((i == 0) | (w[0] + width - stride < total)))
    return F.when(total <= 0, F.expr("cast(array() as array<array<bigint>>)")).otherwise(kept)


def second_to_frame(second: Column, fps: Column, n: Column) -> Column:
    """The 1-based frame of a second, within ``1..n``."""
    return F.least(n.cast("long"), F.greatest(F.lit(1).cast("long"), F.bround(second * fps, 0).cast("long") + 1))
