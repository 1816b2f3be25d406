"""Arithmetic over token arrays: masks, padding, recurrences, losses. Arrays of one row have one length; native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def masked_sum(values: Column, mask: Column) -> Column:
    return _sum(F.zip_with(values, mask, lambda v, m: v * m))


def masked_mean(values: Column, mask: Column) -> Column:
    return masked_sum(values, mask) / (_sum(F.transform(mask, lambda m: m.cast("double"))) + F.lit(1e-8))


def masked_var(values: Column, mask: Column) -> Column:
    """Variance over masked values with Bessel's correction; null for fewer than two."""
    n = _sum(F.transform(mask, lambda m: m.cast("double")))
    mean = masked_mean(values, mask)
    spread = masked_mean(F.transform(values, lambda v: (v - mean) * (v - mean)), mask)
    return F.when(n > 1, spread * n / (n - 1))


def whitened(values: Column, mask: Column) -> Column:
    """Values less their masked mean over their masked deviation."""
    return F.transform(values, lambda v: (v - masked_mean(values, mask)) / F.sqrt(masked_var(values, mask) + F.lit(1e-8)))


def eos_mask(ids: Column, eos: int) -> Column:
    """1 up to and with the first end token, then 0; all 1 without one."""
    at = F.array_position(ids, F.lit(eos))
    return F.transform(ids, lambda x, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def padded(values: Column, length: int, pad: Column, left: bool = False) -> Column:
    """An array filled up to ``length``; a longer one stays."""
    fill = F.array_repeat(pad, F.greatest(F.lit(length) - F.size(values), F.lit(0)))
    return F.concat(fill, values) if left else F.concat(values, fill)


def truncated(values: Column, length: int, side: str = "right") -> Column:
    """At most ``length`` values: cut on the named side, or an error for a longer array."""
    over = F.size(values) > length
    if side == "error":
        return F.when(over, F.raise_error(F.lit(f"longer than {length}"))).otherwise(values)
    cut = F.slice(values, 1, length) if side == "right" else F.slice(values, F.size(values) - length + 1, length)
    return F.when(over, cut).otherwise(values)


def at_last_valid(score: Column, mask: Column) -> Column:
    """Zeros, with the score at the mask's last 1."""
    last = F.array_max(F.transform(mask, lambda m, i: F.when(m > 0, i)))
    return F.transform(mask, lambda m, i: F.when(i == last, score).otherwise(F.lit(0.0)))


def masked_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """Discounted sums from the end, which start anew after masked-out tokens."""
    pairs = F.reverse(F.arrays_zip(rewards.alias("r"), mask.alias("m")))

    def step(acc: Column, p: Column) -> Column:
        return F.struct((p["r"] + F.lit(gamma) * acc["run"]).alias("y"), ((p["r"] + F.lit(gamma) * acc["run"]) * p["m"]).alias("run"), acc["all"].alias("all"))

    start = F.struct(F.lit(0.0).alias("run"), F.expr("cast(array() as array<double>)").alias("all"))
    folded = F.aggregate(pairs, start, lambda acc, p: F.struct(step(acc, p)["run"].alias("run"), F.concat(F.array(step(acc, p)["y"]), acc["all"]).alias("all")))
    return folded["all"]


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Generalised advantage estimates from the end; returns are these plus the values."""
    following = F.concat(F.slice(values, 2, F.size(values)), F.array(F.lit(0.0)))
    deltas = F.transform(F.arrays_zip(rewards.alias("r"), values.alias("v"), following.alias("n")), lambda p: p["r"] + F.lit(gamma) * p["n"] - p["v"])
    step = lambda acc, d: F.concat(F.array(d + F.lit(gamma * lam) * F.coalesce(F.get(acc, 0), F.lit(0.0))), acc)
    return F.aggregate(F.reverse(deltas), F.expr("cast(array() as array<double>)"), step)


def kl(log_probs: Column, reference: Column, kind: str) -> Column:
    """Per-token divergence estimates: ``kl``, ``abs``, ``mse``, ``low_var_kl``, the last clamped to [-10, 10] from a difference within 20."""
    kinds = {
        "kl": lambda p, q: p - q,
        "abs": lambda p, q: F.abs(p - q),
        "mse": lambda p, q: (p - q) * (p - q) / 2,
        "low_var_kl": lambda p, q: _clamp(F.exp(_clamp(q - p, 20.0)) - _clamp(q - p, 20.0) - 1, 10.0),
    }
    return F.zip_with(log_probs, reference, kinds[kind])


def _clamp(x: Column, most: float) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), x))


def clipped_losses(log_probs: Column, old: Column, advantage: Column, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> Column:
    """Per-token ``struct<loss, clipped, lower>`` of the clipped policy loss with its dual clip for negative advantages."""

    def one(p: Column, q: Column) -> Column:
        ratio = F.exp(_clamp(p - q, 20.0))
        plain = -advantage * ratio
        cut = -advantage * F.least(F.lit(1 + high), F.greatest(F.lit(1 - low), ratio))
        upper = F.greatest(plain, cut)
        dual_cut = F.least(upper, -advantage * F.lit(dual))
        return F.struct(F.when(advantage < 0, dual_cut).otherwise(upper).alias("loss"), (plain < cut).cast("int").alias("clipped"), ((advantage < 0) & (upper > -advantage * F.lit(dual))).cast("int").alias("lower"))

    return F.zip_with(log_probs, old, one)


def value_losses(values: Column, returns: Column, old: Column, clip: float = 0.5) -> Column:
    """Per-token half of the larger squared error of a value and of the value clipped around the old one."""
    both = F.arrays_zip(values.alias("v"), returns.alias("r"), old.alias("o"))
    return F.transform(both, lambda p: F.greatest((p["v"] - p["r"]) * (p["v"] - p["r"]), F.pow(F.least(p["o"] + clip, F.greatest(p["o"] - clip, p["v"])) - p["r"], F.lit(2.0))) / 2)


def explained_variance(returns: Column, values: Column, mask: Column) -> Column:
    """1 less the share of the returns' variance that the values leave."""
    rest = F.zip_with(returns, values, lambda r, v: r - v)
    return 1 - masked_var(rest, mask) / (masked_var(returns, mask) + F.lit(1e-5))
