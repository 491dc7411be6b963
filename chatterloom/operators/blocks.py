"""Ordered per-key scans that stay balanced when one key is huge.

A window partitioned by thread puts a thread with a third of all rows into one
task. Here every key that is large is cut into blocks of its own order, the
window runs per (key, block), and block totals supply what came before.

* Cuts are values of the order column picked by hash (one row in
  ``sample_mod``), so they are a pure function of the data: recomputing a lost
  task gives the same blocks, and any set of cuts gives the same result.
* All keys are cut at the same distance, so a key has cuts in proportion to its
  rows and no number of large keys is too many. The distance is ``sample_mod``
  rows, or as much more as it takes to leave about ``max_cuts`` cuts in the whole
  table: the broadcast tables have a fixed bound, and a block holds about one row
  in ``max_cuts`` of the table at most. A key below ``min_cuts`` blocks stays whole.
* With no large key the cut table is empty and adaptive execution drops the
  totals branch; what is left is one exchange and one window.
* Order columns are read once to count the picked rows and once to pick them, the
  input once for the rows and, for large keys, once for totals. Callers that scan the result of a shuffle write it first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterloom.session import written


@dataclass(frozen=True)
class SplitPolicy:
    sample_mod: int = 65_536
    min_cuts: int = 4
    max_cuts: int = 524_288


DEFAULT_SPLIT = SplitPolicy()


def _order_value(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def hot_key_cuts(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], policy: SplitPolicy = DEFAULT_SPLIT
) -> DataFrame:
    """``keys, _cuts``: sorted order values at which a large key is split."""
    # The hash takes the key in, or an order value that many keys share would be picked for all of them.
    hashed = df.select(*keys, _order_value(order).alias("_o"), F.xxhash64(*keys, *order).alias("_h"))
    picked = hashed.filter(F.pmod("_h", F.lit(policy.sample_mod)) == 0)
    many = picked.agg(F.count(F.lit(1))).scalar()
    step = F.greatest(F.ceil(many / F.lit(policy.max_cuts)), F.lit(1)).cast("bigint")
    return (
        picked.filter(F.pmod(F.expr(f"_h div {policy.sample_mod}"), step) == 0)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("_o")).alias("_cuts"))
        .filter(F.size("_cuts") >= policy.min_cuts)
    )


def _block_of(order: Column, policy: SplitPolicy) -> Column:
    """Number of cuts at or below ``order``, by halving steps."""
    cuts, steps, step = F.col("_cuts"), [], 1
    while step <= policy.max_cuts:
        step *= 2
    while step:
        steps.append(F.lit(step))
        step //= 2
    found = F.aggregate(
        F.array(*steps),
        F.lit(0),
        lambda low, jump: F.when(F.get(cuts, low + jump - 1) <= order, low + jump).otherwise(low),
    )
    return F.when(cuts.isNull(), F.lit(0)).otherwise(found)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    *,
    after: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    policy: SplitPolicy = DEFAULT_SPLIT,
) -> DataFrame:
    """Add running values over ``keys`` in ``order`` (unique within a key).

    ``sums``: inclusive running sum; ``after``: inclusive sum from this row to
    the end; ``previous``: value of the preceding row, null on the first.
    """
    sums, after, previous = dict(sums or {}), dict(after or {}), dict(previous or {})
    keys, order = list(keys), list(order)
    kept = df.columns
    values = {f"_s_{n}": e.cast("bigint") for n, e in {**sums, **after}.items()}
    values |= {f"_p_{n}": e for n, e in previous.items()}
    rows = df.withColumns(values)

    cuts = F.broadcast(hot_key_cuts(df, keys, order, policy))
    block = _block_of(_order_value(order), policy)

    def blocked(how: str, columns: Sequence[str]) -> DataFrame:
        joined = rows.select(*columns).join(cuts, keys, how)
        return joined.withColumn("_blk", block).drop("_cuts")

    inside = Window.partitionBy(*keys, "_blk").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # From here to the end is from the end to here: a frame that only grows is summed in one pass.
    backward = Window.partitionBy(*keys, "_blk").orderBy(*[F.desc(c) for c in order])
    onward = backward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {f"_w_{n}": F.sum(f"_s_{n}").over(upto) for n in sums}
    local |= {f"_w_{n}": F.sum(f"_s_{n}").over(onward) for n in after}
    local |= {f"_w_{n}": F.lag(f"_p_{n}").over(inside) for n in previous}
    if previous:
        local["_first"] = F.row_number().over(inside) == 1
    windowed = blocked("left", rows.columns).withColumns(local)

    # Totals exist only for keys with cuts: at most a row per cut and one per such key.
    totals = blocked("inner", list(dict.fromkeys([*keys, *order, *values]))).groupBy(*keys, "_blk")
    measures = [F.sum(f"_s_{n}").alias(f"_t_{n}") for n in {**sums, **after}]
    measures += [
        F.max(F.struct(*order, F.col(f"_p_{n}").alias("_v"))).alias(f"_t_{n}") for n in previous
    ]
    across = Window.partitionBy(*keys).orderBy("_blk")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    later = across.rowsBetween(1, Window.unboundedFollowing)
    offsets = totals.agg(*measures).select(
        *keys,
        "_blk",
        *[F.sum(f"_t_{n}").over(earlier).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(later).alias(f"_o_{n}") for n in after],
        *[F.lag(f"_t_{n}").over(across)["_v"].alias(f"_o_{n}") for n in previous],
    )
    out = windowed.join(F.broadcast(offsets), [*keys, "_blk"], "left")
    summed = [
        (F.col(f"_w_{n}") + F.coalesce(F.col(f"_o_{n}"), F.lit(0))).alias(n) for n in {**sums, **after}
    ]
    lagged = [
        F.when(F.col("_first"), F.col(f"_o_{n}")).otherwise(F.col(f"_w_{n}")).alias(n) for n in previous
    ]
    replaced = {*sums, *after, *previous}
    return out.select(*[c for c in kept if c not in replaced], *summed, *lagged)


def rows_in_spans(
    rows: DataFrame, spans: DataFrame, *, key: str = "thread_id", at: str = "position", width: int = 4096
) -> DataFrame:
    """Rows whose ``at`` lies in ``[lo, hi)`` of a span of the same key.

    Both sides carry a tile number (``at div width``), so the join is on
    (key, tile): at most ``width`` dense positions meet per key and task, however
    long the thread. ``hi`` must not exceed the thread length, which keeps the
    number of tiles per span at length / width.
    """
    tiled = spans.filter("lo < hi").withColumn(
        "_tile", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})"))
    )
    placed = rows.withColumn("_tile", F.expr(f"{at} div {width}"))
    return (
        placed.join(tiled, [key, "_tile"])
        .filter((F.col(at) >= F.col("lo")) & (F.col(at) < F.col("hi")))
        .drop("_tile")
    )


def byte_pages(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: Column, page_bytes: int,
    policy: SplitPolicy = DEFAULT_SPLIT,
) -> DataFrame:
    """``keys, order, page, pages``: rows packed in order into pages by their bytes.

    A page starts where the running size passes a multiple of ``page_bytes``, so it
    holds at most that much and one row more. Pages are numbered from 0 without
    gaps. Only keys and sizes are read; texts join the result on their key.
    """
    keys, order = list(keys), list(order)
    sized = written(rows.select(*keys, *order, size.cast("bigint").alias("_bytes")), "row-sizes")
    placed = written(
        running(sized, keys, order, {"_upto": F.col("_bytes")}, policy=policy).select(
            *keys, *order, F.expr(f"(_upto - _bytes) div {page_bytes}").alias("_bin")
        ),
        "row-bins",
    )
    # A key has a bin for every ``page_bytes`` of its text at most: few enough for one window, however many rows it has.
    bins, of_key = placed.select(*keys, "_bin").distinct(), Window.partitionBy(*keys)
    pages = bins.select(
        *keys, "_bin", (F.row_number().over(of_key.orderBy("_bin")) - 1).cast("bigint").alias("page"),
        F.count(F.lit(1)).over(of_key).alias("pages"),
    )
    return placed.join(pages, [*keys, "_bin"]).drop("_bin")
