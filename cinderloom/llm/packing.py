"""Putting texts of varying length into containers of fixed capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderloom.session import ensure_checkpoint_dir

OPEN_WINDOWS = 64
MERGED_PARTITIONS = 64
#: Tokens a packer should get, the most packers there are, and the most plans, by which every text is multiplied.
TOKENS_PER_PARTITION = 8_000_000
MOST_PARTITIONS = 20_000
MOST_PLANS = 100
PLACED = "plan_id string, container string, doc_id long, piece long, n_tokens long, part long, closed boolean"


def _packed(windows: int):
    def pack(batches):
        import bisect

        import pandas as pd
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        plans: dict = {}

        def emit(state, window, closed, out):
            for doc, piece, n in window[1]:
                out.append((state["plan"], f"{part}-{state['n']}", doc, piece, n, part, closed))
            state["n"] += 1

        for batch in batches:
            out: list = []
            for plan, capacity, doc, piece, n in zip(batch["plan_id"], batch["capacity"], batch["doc_id"], batch["piece"], batch["n_tokens"]):
                state = plans.setdefault(plan, {"plan": plan, "n": 0, "fill": [], "open": [], "capacity": capacity})
                fill, opened = state["fill"], state["open"]
                at = bisect.bisect_right(fill, capacity - n) - 1  # the fullest window that still fits
                if at >= 0:
                    used, window = fill.pop(at) + n, opened.pop(at)
                    window[1].append((doc, piece, n))
                else:
                    if len(fill) >= windows:
                        fill.pop()
                        emit(state, opened.pop(), True, out)
                    used, window = n, [0, [(doc, piece, n)]]
                if used >= capacity:
                    emit(state, window, True, out)
                    continue
                at = bisect.bisect_right(fill, used)
                fill.insert(at, used)
                opened.insert(at, window)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PLACED.split(", ")])
        out = []
        for state in plans.values():
            for window in state["open"]:
                emit(state, window, False, out)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PLACED.split(", ")])

    return pack


def _merged():
    # Defined inside, so that workers get it by value and need not import this package.
    def merge(key, rows):
        """Leftover windows of some partitions: largest first, each onto the fullest container that takes it."""
        import bisect

        import pandas as pd

        capacity = int(rows["capacity"].iloc[0])
        used = rows.groupby("container")["n_tokens"].sum().sort_values(ascending=False, kind="stable")
        fill: list = []
        names: list = []
        target = {}
        for name, n in sorted(used.items(), key=lambda x: (-x[1], x[0])):
            at = bisect.bisect_right(fill, capacity - n) - 1
            onto = names.pop(at) if at >= 0 else name
            total = (fill.pop(at) if at >= 0 else 0) + n
            target[name] = onto
            at = bisect.bisect_right(fill, total)
            fill.insert(at, total)
            names.insert(at, onto)
        rows["container"] = rows["container"].map(target)
        rows["half"] = rows.groupby("container")["n_tokens"].transform("sum") * 2 <= capacity
        return pd.DataFrame(rows[["plan_id", "capacity", "container", "doc_id", "piece", "n_tokens", "half"]])

    return merge


def pack_texts(sizes: DataFrame, plans: DataFrame, windows: int = OPEN_WINDOWS, partitions: int | None = None) -> DataFrame:
    """``plan_id, container, doc_id, piece, n_tokens`` for ``sizes(doc_id, n_tokens)`` and ``plans(plan_id, capacity_tokens)``.

    A text above the capacity is cut into pieces numbered from 1, all full but the last; no other text is
    split. Texts of 0 or null tokens, and plans with a null or non-positive capacity, are left out.
    Bounded-space online packing: every partition keeps ``windows`` open containers a plan, places each
    item best-fit, and closes the fullest when none fits. Containers still open at the end are
    merged with those of neighbouring partitions, at most ``windows`` times MERGED_PARTITIONS to a task; what
    is then not half full, a container or so of each such block, is merged once more. The
    number of packers follows from the tokens, so contents depend on sizes and plans alone.
    """
    ensure_checkpoint_dir(sizes.sparkSession)
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    parts = partitions or max(1, min(MOST_PARTITIONS, -(-total // TOKENS_PER_PARTITION)))
    capacity = F.col("capacity_tokens").cast("long")
    items = sizes.where("n_tokens > 0").withColumn("plan", F.explode(_plan_list(plans)))
    n, cap = F.col("n_tokens"), F.col("plan.capacity")
    pieces = F.sequence(F.lit(1).cast("long"), F.ceil(n / cap).cast("long"))
    spread = (
        items.select("plan", "doc_id", "n_tokens", F.explode(pieces).alias("piece"))
        .select(
            F.col("plan.plan_id").alias("plan_id"), F.col("plan.capacity").alias("capacity"), "doc_id", "piece",
            F.least(cap, n - (F.col("piece") - 1) * cap).alias("n_tokens"),
        )
    )
    placed = (
        spread.repartition(parts, "doc_id").sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "plan_id", "piece")
        .mapInPandas(_packed(windows), PLACED)
        .checkpoint()
    )
    columns = ["plan_id", "container", "doc_id", "piece", "n_tokens"]
    merged = "plan_id string, capacity long, container string, doc_id long, piece long, n_tokens long, half boolean"
    left = (
        placed.where("not closed")
        .join(plans.select("plan_id", capacity.alias("capacity")), "plan_id")
        .withColumn("block", F.floor(F.col("part") / F.lit(MERGED_PARTITIONS)))
        .groupBy("plan_id", "block")
        .applyInPandas(_merged(), merged)
        .checkpoint()
    )
    last = left.where("half").groupBy("plan_id").applyInPandas(_merged(), merged)
    return placed.where("closed").select(columns).unionByName(left.where("not half").select(columns)).unionByName(last.select(columns))


def _plan_list(plans: DataFrame):
    """The plans as one array literal: settings, a handful of rows, read on the driver; more than MOST_PLANS are refused."""
    rows = plans.where("capacity_tokens > 0 and plan_id is not null").select("plan_id", F.col("capacity_tokens").cast("long")).limit(MOST_PLANS + 1).collect()
    if len(rows) > MOST_PLANS:
        raise ValueError(f"more than {MOST_PLANS} plans")
    made = [F.struct(F.lit(r[0]).alias("plan_id"), F.lit(r[1]).cast("long").alias("capacity")) for r in rows]
    return F.array(*made) if made else F.expr("cast(array() as array<struct<plan_id:string,capacity:bigint>>)")


def packing_report(packed: DataFrame, plans: DataFrame) -> DataFrame:
    """Containers, split texts, and the share of the capacity that is used, for each plan."""
    by_plan = (
        packed.groupBy("plan_id", "container").agg(F.sum("n_tokens").alias("used"), F.count_if(F.col("piece") == 2).alias("split"))
        .groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), F.sum("split").alias("n_split_texts"))
    )
    return by_plan.join(plans.select("plan_id", "capacity_tokens"), "plan_id").withColumn(
        "fill", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))
    )
