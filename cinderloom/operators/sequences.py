"""Recurrences and matchings over ordered sequences inside a group, as array folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EMPTY = "cast(array() as array<double>)"


def ordered_values(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """One row per group with ``ids`` and ``xs`` in the order of ``order``. Groups must be batch-sized."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("x"))))
    return df.groupBy(*keys).agg(listed.alias("_l")).select(
        *keys, F.transform("_l", lambda s: s["o"]).alias("ids"), F.transform("_l", lambda s: s["x"]).alias("xs")
    )


def discounted(xs: Column, gamma: float) -> Column:
    """``y[t] = x[t] + gamma * y[t + 1]`` from the end of the array."""
    step = lambda acc, x: F.concat(F.array(x + F.lit(gamma) * F.coalesce(F.get(acc, 0), F.lit(0.0))), acc)
    return F.aggregate(F.reverse(xs), F.expr(_EMPTY), step)


def smoothed(xs: Column, decay: float) -> Column:
    """``y[0] = x[0]``, then ``decay * y + (1 - decay) * x``; a null repeats the last value."""

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        return F.concat(acc, F.array(F.when(x.isNull(), last).when(last.isNull(), x).otherwise(last * decay + x * (1 - decay))))

    return F.aggregate(xs, F.expr(_EMPTY), step)


def iou(a: Column, b: Column) -> Column:
    """Overlap of two ``[start, end]`` arrays over their union; 0 when the union is empty."""
    inter = F.greatest(F.lit(0.0), F.least(a[1], b[1]) - F.greatest(a[0], b[0]))
    union = (a[1] - a[0]) + (b[1] - b[0]) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def sound_segments(segments: Column) -> Column:
    """The ``[start, end]`` pairs with 0 <= start < end; null elements and broken pairs are dropped."""
    return F.filter(
        F.coalesce(segments, F.expr("cast(array() as array<array<double>>)")),
        lambda s: F.coalesce((F.size(s) == 2) & (F.get(s, 0) >= 0) & (F.get(s, 0) < F.get(s, 1)) & ~F.isnan(F.get(s, 1)), F.lit(False)),
    )


def suppressed(segments: Column, threshold: float = 0.7) -> Column:
    """Non-maximum suppression: longest first, kept if below ``threshold`` with all kept, then by start."""
    by_length = F.transform(
        F.array_sort(F.transform(segments, lambda s, i: F.struct((s[0] - s[1]).alias("l"), i.alias("i"), s.alias("s")))), lambda t: t["s"]
    )
    keep = lambda acc, s: F.when(F.exists(acc, lambda k: iou(k, s) >= threshold), acc).otherwise(F.concat(acc, F.array(s)))
    return F.array_sort(F.aggregate(by_length, F.expr("cast(array() as array<array<double>>)"), keep))


def ordered_match(a: Column, b: Column) -> Column:
    """Largest sum of IoU over order-preserving pairings of two segment arrays."""
    zero = F.array_repeat(F.lit(0.0), F.size(b) + 1)

    def row(prev: Column, x: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            take = F.get(prev, j - 1) + iou(x, F.get(b, j - 1))
            return F.concat(acc, F.array(F.greatest(take, F.get(prev, j), F.get(acc, j - 1))))

        return F.when(F.size(b) == 0, prev).otherwise(
            F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(b), F.lit(1))), F.array(F.lit(0.0)), cell)
        )

    return F.element_at(F.aggregate(a, zero, row), -1)


def f1_of(total: Column, n_a: Column, n_b: Column) -> Column:
    """Harmonic mean of total/n_a and total/n_b; 0 if either side is empty."""
    return F.when((n_a > 0) & (n_b > 0), F.lit(2.0) * total / (n_a + n_b)).otherwise(0.0)


def best_assignment_sum(a: Column, b: Column, general: bool = False, margin: float = 0.0) -> Column:
    """Largest sum of IoU over one-to-one pairings, by shortest augmenting paths; an Arrow-batched function.

    With ``general`` the scores are generalised IoU moved to [0, 1], of the better of ``b``'s segment and the same
    ``margin`` wider at both ends, but not below 0.
    """

    @F.pandas_udf("double")
    def solve(left, right):
        import numpy as np
        import pandas as pd

        def scores(p, q):
            inter = np.clip(np.minimum(p[:, None, 1], q[None, :, 1]) - np.maximum(p[:, None, 0], q[None, :, 0]), 0, None)
            union = (p[:, 1] - p[:, 0])[:, None] + (q[:, 1] - q[:, 0])[None, :] - inter
            if not general:
                return inter / union
            hull = np.maximum(p[:, None, 1], q[None, :, 1]) - np.minimum(p[:, None, 0], q[None, :, 0])
            return (inter / union - (hull - union) / hull + 1) / 2

        def best(xs, ys) -> float:
            if xs is None or ys is None or not len(xs) or not len(ys):
                return 0.0
            p, q = np.array([list(s) for s in xs], float), np.array([list(s) for s in ys], float)
            cost = -scores(p, q)
            if general and margin:
                cost = np.minimum(cost, -scores(p, np.stack([np.maximum(q[:, 0] - margin, 0), q[:, 1] + margin], axis=1)))
            cost = cost if len(xs) <= len(ys) else cost.T
            n, m = cost.shape
            dual_row, dual_col, owner = np.zeros(n + 1), np.zeros(m + 1), np.full(m + 1, -1)
            for i in range(n):
                slack, back, done, j = np.full(m + 1, np.inf), np.full(m + 1, m), np.zeros(m + 1, bool), m
                owner[m] = i
                while owner[j] != -1:
                    done[j] = True
                    r = owner[j]
                    reduced = cost[r] - dual_row[r] - dual_col[:m]
                    better = ~done[:m] & (reduced < slack[:m])
                    slack[:m][better], back[:m][better] = reduced[better], j
                    free = np.where(done[:m], np.inf, slack[:m])
                    k = int(free.argmin())
                    delta = free[k]
                    dual_row[owner[done]] += delta
                    dual_col[done] -= delta
                    slack[:m][~done[:m]] -= delta
                    j = k
                while j != m:
                    owner[j] = owner[back[j]]
                    j = back[j]
            used = owner[:m] >= 0
            return float(-cost[owner[:m][used], np.nonzero(used)[0]].sum())

        return pd.Series([best(x, y) for x, y in zip(left, right)])

    return solve(a, b)


def length_balanced(df: DataFrame, keys: list[str], item: str, size: str, parts: int) -> DataFrame:
    """``keys, item, size, part``: each batch-sized group split into ``parts`` of near-equal total by largest differencing."""

    def split(pdf):
        import heapq

        rows = sorted(zip(pdf[size].fillna(0), pdf[item]), key=lambda t: (-t[0], t[1]))
        heap = []
        for k, (n, it) in enumerate(rows):
            sets = [(n, [it])] + [(0, [])] * (parts - 1)
            heap.append((-n, k, sets))
        heapq.heapify(heap)
        k = len(heap)
        while len(heap) > 1:
            _, _, a = heapq.heappop(heap)
            _, _, b = heapq.heappop(heap)
            merged = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))), key=lambda t: -t[0])
            heapq.heappush(heap, (merged[-1][0] - merged[0][0], k, merged))
            k += 1
        place = {it: p for p, (_, items) in enumerate(heap[0][2]) for it in items}
        pdf["part"] = pdf[item].map(place)
        return pdf

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, item, size]) + ", part int"
    return df.select(*keys, item, size).groupBy(*keys).applyInPandas(split, schema)


def budgeted_batches(df: DataFrame, keys: list[str], item: str, size: str, budget: int, most: int = 1_000_000) -> DataFrame:
    """``keys, item, size, part``: each group in the fewest balanced parts its total needs at ``budget`` a part, the part with the largest sum of
    squares first. A group is one step's batch and is handled in one task; one of more than ``most`` rows is refused."""

    def split(pdf):
        import heapq

        if len(pdf) > most:
            raise ValueError(f"a batch of more than {most} rows")
        rows = sorted(zip(pdf[size], pdf[item]), key=lambda t: (-t[0], t[1]))
        parts = max(1, min(len(rows), -(-int(sum(n for n, _ in rows)) // budget)))
        # Longest first onto the lightest part.
        heap = [(0, k) for k in range(parts)]
        squares, place = [0] * parts, {}
        for n, it in rows:
            total, k = heapq.heappop(heap)
            place[it] = k
            squares[k] += int(n) * int(n)
            heapq.heappush(heap, (total + int(n), k))
        rank = {k: r for r, k in enumerate(sorted(range(parts), key=lambda k: (-squares[k], k)))}
        pdf["part"] = [rank[place[it]] for it in pdf[item]]
        return pdf

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, item, size]) + ", part int"
    return df.select(*keys, item, size).groupBy(*keys).applyInPandas(split, schema)
