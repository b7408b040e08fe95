"""Values along an order that no task sees whole.

Rows are range-partitioned by the whole order, written once, and numbered by prefix counts of the
partitions, so equal or hot keys spread like any others. What runs along a key then works on
blocks of consecutive rows: inside a block by window functions, between blocks by a scan of
one row a block, and blocks that an answer cannot lie in are pruned by their extremes.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import written

#: Rows in a block; with a weight of at most 0.75 its powers stay inside a double.
SIZE = 512
#: Rows in a block, and blocks in a block of blocks, where extremes are looked up.
FAN = 256


def in_order(rows: DataFrame, *order: Column, parts: bool = False) -> DataFrame:
    """All rows and ``place_``: their number from 0 in the order. With ``parts`` also ``part_``, the task that sorted them.

    Rows that are equal in the whole order come in any order, but always in the same. One
    count for each partition reaches the driver.
    """
    spark = rows.sparkSession
    held = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id_", F.monotonically_increasing_id()), "ordered")
    part = F.shiftrightunsigned("id_", 33).cast("int")
    counts = sorted((r.part, r.rows) for r in held.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows")).collect())
    ends = list(accumulate((n for _, n in counts), initial=0))
    firsts = F.broadcast(spark.createDataFrame([(p, n) for (p, _), n in zip(counts, ends, strict=False)], "part_ int, start_ long"))
    out = held.withColumn("part_", part).join(firsts, "part_").withColumn("place_", F.col("start_") + F.col("id_").bitwiseAND(F.lit((1 << 33) - 1)))
    return out.drop("id_", "start_", *([] if parts else ["part_"]))


def ordered(rows: DataFrame, by: str = "symbol", order: str = "day", size: int = SIZE) -> DataFrame:
    """Rows with ``key_`` (of ``by``, so that null is a key too), ``place_`` and ``block_``, a block being ``size`` consecutive rows."""
    key = rows.withColumn("key_", F.struct(by))
    return in_order(key, F.col("key_"), F.col(order)).withColumn("block_", F.floor(F.col("place_") / size))


def inside() -> W:
    return W.partitionBy("key_", "block_").orderBy("place_")


def with_rows_before(rows: DataFrame, n: int, columns: dict[str, Column], size: int = SIZE) -> DataFrame:
    """``columns``, window expressions over ``inside()`` that look back at most ``n`` rows, across blocks: the last ``n`` rows of a block are lent to the next."""
    lent = F.when(F.col("place_") % size >= size - n, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    both = rows.withColumn("lent_", F.explode(lent)).withColumn("block_", F.col("block_") + F.col("lent_"))
    return both.withColumns(columns).where("lent_ = 0").drop("lent_")


def _power(base: float, n: Column) -> Column:
    return F.pow(F.lit(base), n)


def smoothed(rows: DataFrame, value: str, fast: dict[str, tuple[float, float]], slow: tuple[str, float], first: float | None = None) -> DataFrame:
    """Exponential averages of ``value`` along each key of ``ordered`` rows, and the average of their sum.

    ``fast``: name to (weight, sign). Each moves towards every new value by its weight; ``slow`` (name, weight)
    moves the same way towards the signed sum of the fast ones. They start at ``first``, or at
    the first value; nulls leave them. Every step is affine, so a block of rows is one affine
    map, known from its number of values and its result from zero. Maps are composed by doubling
    distances until what lies further back weighs less than a double shows. All is reckoned from the
    block's, then the key's first value, so that equal values leave the states exactly equal.
    ``before_`` is the state before the row's block, null if there is none.
    """
    x, signs = F.col(value).cast("double"), {n: s for n, (_, s) in fast.items()}
    keep, (last, weight) = {n: 1 - w for n, (w, _) in fast.items()} | {slow[0]: 1 - slow[1]}, slow
    if not all(0.25 <= r < 1 for r in keep.values()):
        raise ValueError("weights must lie above 0 and not above 0.75")
    r, names, net = keep[last], [*fast, last], float(sum(signs.values()))

    def carried(n: Column, name: str) -> Column:
        """What a fast state before ``n`` values adds to the slow one after them."""
        f = keep[name]
        return weight * n * _power(r, n) if abs(f - r) < 1e-9 else weight * f / (r - f) * (_power(r, n) - _power(f, n))

    def after(n: Column, states: dict[str, Column], added: dict[str, Column]) -> dict[str, Column]:
        out = {f: _power(keep[f], n) * states[f] + added[f] for f in fast}
        return out | {last: _power(r, n) * states[last] + sum(s * carried(n, f) * states[f] for f, s in signs.items()) + added[last]}

    upto, block = inside().rowsBetween(W.unboundedPreceding, 0), inside().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    k = F.col("count_")
    own = rows.withColumns({"count_": F.count(x).over(upto), "from_": F.first(x, ignorenulls=True).over(block)})
    zero = lambda v, f: _power(f, k) * F.coalesce(F.sum(v * _power(f, -k)).over(upto), F.lit(0.0))
    own = own.withColumns({f"zero_{n}": zero(w * (x - F.col("from_")), keep[n]) for n, (w, _) in fast.items()})
    own = own.withColumn(f"zero_{last}", zero(F.when(x.isNotNull(), sum(s * F.col(f"zero_{n}") for n, s in signs.items())) * weight, r))
    maps = own.groupBy("key_", "block_").agg(F.max("count_").alias("n_"), F.first("from_").alias("from_"), *(F.max_by(f"zero_{n}", "place_").alias(n) for n in names))
    maps, n, whole = maps.withColumn("some_", F.col("n_") > 0), F.col("n_"), W.partitionBy("key_").orderBy("block_")
    start = F.lit(first) if first is not None else F.first("from_", ignorenulls=True).over(whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    maps = maps.withColumn("first_", start).withColumn("off_", F.coalesce(F.col("from_") - F.col("first_"), F.lit(0.0)))
    back = after(n, {f: -F.col("off_") for f in fast} | {last: -F.col("off_") * net}, {f: F.col(f) for f in names})
    maps = maps.withColumns({f: back[f] + F.col("off_") * (1.0 if f != last else net) for f in names})
    w = W.partitionBy("key_", "some_").orderBy("block_")
    for step in range(math.ceil(math.log2(64 * math.log(2) / -math.log(max(keep.values())))) + 1):
        old = {c: F.coalesce(F.lag(c, 1 << step).over(w), F.lit(0)) for c in ("n_", *names)}
        maps = maps.withColumns({"n_": n + old["n_"], **after(n, old, {f: F.col(f) for f in names})})
    state = F.when(F.col("some_"), F.struct(*(F.col(f).alias(f) for f in names)))  # from the key's first value
    before = F.last(state, ignorenulls=True).over(whole.rowsBetween(W.unboundedPreceding, -1))
    found = own.drop("from_").join(maps.select("key_", "block_", "first_", "off_", before.alias("state_")), ["key_", "block_"])
    since = {f: F.coalesce(F.col("state_")[f], F.lit(0.0)) for f in names}
    base = {f: F.col("first_") * (1.0 if f != last else net) for f in names}
    moved = {f: F.col("off_") * (1.0 if f != last else net) for f in names}
    now = after(k, {f: since[f] - moved[f] for f in names}, {f: F.col(f"zero_{f}") for f in names})
    seen = F.lit(True) if first is not None else (k > 0) | F.col("state_").isNotNull()
    out = {f: F.when(seen, base[f] + (moved[f] + now[f])) for f in names}
    out["before_"] = F.when(F.col("state_").isNotNull(), F.struct(*((base[f] + F.col("state_")[f]).alias(f) for f in names)))
    return found.withColumns(out).drop("count_", "first_", "off_", "state_", *(f"zero_{f}" for f in names))


def lowest_earlier_above(rows: DataFrame, value: Column, bound: Column, out: str) -> DataFrame:
    """``key_, place_`` and ``out``: the lowest ``value`` of the key's earlier rows that is above the row's ``bound``; rows without one are left out.

    Values and bounds stand in one order of value. The answer is the first value behind the
    bound whose place is smaller: looked for in the bound's own block, else in the first block
    behind it whose smallest place is smaller, which is found in the block of blocks or, beyond it, by the
    smallest places of blocks of blocks (one number for ``FAN`` squared rows of a key). So of all blocks a row
    opens its own and one more.
    """
    one = lambda c, asks: rows.where(c.isNotNull()).select("key_", F.col("place_").alias("t_"), c.alias("v_"), F.lit(asks).alias("asks_"))
    line = in_order(one(value, False).unionByName(one(bound, True)), F.col("key_"), F.col("v_"), F.col("asks_"), F.col("t_"))
    line = line.withColumn("block_", F.floor(F.col("place_") / FAN))
    blocks = line.where("NOT asks_").groupBy("key_", "block_").agg(F.sort_array(F.collect_list(F.struct("place_", "t_", "v_"))).alias("in_"), F.min("t_").alias("least_"))
    above = blocks.groupBy("key_", F.floor(F.col("block_") / FAN).alias("above_")).agg(F.sort_array(F.collect_list(F.struct("block_", "least_"))).alias("of_"), F.min("least_").alias("least_"))
    top = above.groupBy("key_").agg(F.sort_array(F.collect_list(F.struct("above_", "least_"))).alias("top_"))

    def first(found: str, fits) -> Column:
        return F.get(F.filter(found, fits), F.lit(0))

    none = -1 - F.col("place_") % 4096  # a block that no row has: rows that need no join are spread
    asks = line.where("asks_").select("key_", "t_", "place_", "block_", F.floor(F.col("block_") / FAN).alias("above_"))
    asks = asks.join(blocks.select("key_", "block_", "in_"), ["key_", "block_"], "left")
    asks = asks.withColumn("own_", first("in_", lambda m: (m["place_"] > F.col("place_")) & (m["t_"] < F.col("t_")))["v_"]).drop("in_")
    asks = asks.withColumn("above_", F.when(F.col("own_").isNull(), F.col("above_")).otherwise(none))
    asks = asks.join(above.select("key_", "above_", "of_"), ["key_", "above_"], "left")
    asks = asks.withColumn("to_", first("of_", lambda m: (m["block_"] > F.col("block_")) & (m["least_"] < F.col("t_")))["block_"]).drop("of_")
    asks = asks.withColumn("open_", F.when(F.col("own_").isNull() & F.col("to_").isNull(), F.lit(0)).otherwise(none))
    asks = asks.join(top.withColumn("open_", F.lit(0).cast("long")), ["key_", "open_"], "left").drop("open_")
    asks = asks.withColumn("far_", F.coalesce(first("top_", lambda m: (m["above_"] > F.col("above_")) & (m["least_"] < F.col("t_")))["above_"], none)).drop("top_", "above_")
    asks = asks.join(above.select("key_", F.col("above_").alias("far_"), "of_"), ["key_", "far_"], "left")
    asks = asks.withColumn("to_", F.coalesce("to_", first("of_", lambda m: m["least_"] < F.col("t_"))["block_"], none)).drop("of_", "far_")
    asks = asks.join(blocks.select("key_", F.col("block_").alias("to_"), "in_"), ["key_", "to_"], "left")
    asks = asks.withColumn(out, F.coalesce("own_", first("in_", lambda m: m["t_"] < F.col("t_"))["v_"]))
    return asks.where(F.col(out).isNotNull()).select("key_", F.col("t_").alias("place_"), out)
