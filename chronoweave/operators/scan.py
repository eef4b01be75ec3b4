"""Running aggregates over an entity of any length: a prefix scan in two levels.

A plain window by entity puts all rows of an entity into one task.  Here an entity's rows are dealt to buckets of the first order column.
Each bucket gives one carry for each running value; carries are summed up along the entity, which has as many rows as the entity has
buckets; then a row's value is that of the rows of its bucket and of what its bucket was handed.  Rows are shuffled once, by entity and
bucket, and both levels read that shuffle where the rows hold no other columns than those that the scan needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import written

_FUNCTIONS = {"max": F.max, "min": F.min, "sum": F.sum}
#: Which rows a value is of: those before the row or up to it, those after it or from it on, or all of its entity.
ROWS = ("before", "upto", "after", "from", "all")


def _both(fn: str, x: Column, y: Column) -> Column:
    if fn == "sum":
        return F.coalesce(x + y, x, y)
    return F.greatest(x, y) if fn == "max" else F.least(x, y)


def running(df: DataFrame, by: list[str], order: list[str], width: int | Column, values: dict[str, tuple[str, ...]]) -> DataFrame:
    """``df`` with a column for each of ``values``: name to ``(function, column, rows)`` or ``("lag" or "lead", column)``.

    ``function`` is max, min or sum and leaves nulls out; a value of no rows is null.  ``order`` names the columns that put an entity's
    rows in order, nulls first; the first one is a number, of which a bucket takes ``width``, or ``width`` is the bucket's number itself, which
    must not fall in that order.  Null is an entity like any other.
    """
    bucket = width if isinstance(width, Column) else F.floor(F.col(order[0]) / width)
    # Nulls are equal inside a struct, and rows without a place come first.
    rows = df.withColumn("entity_", F.struct(*by)).withColumn("bucket_", F.coalesce(bucket.cast("long"), F.lit(-(1 << 63))))
    place = ["entity_", "bucket_"]
    needed = {*by, *order, *(v[1] for v in values.values())}
    dealt = rows.repartition(*place)
    narrow = set(df.columns) <= needed
    totals = {}
    for name, (fn, column, *_) in values.items():
        at = F.struct(*order)
        totals[name] = _FUNCTIONS[fn](column) if fn in _FUNCTIONS else (F.max_by if fn == "lag" else F.min_by)(F.struct(F.col(column).alias("x")), at)
    carries = (dealt if narrow else rows).groupBy(*place).agg(*(c.alias(f"carry_{n}_") for n, c in totals.items()))
    # Along the entity's buckets: what comes before or after each.
    up, down = Window.partitionBy("entity_").orderBy("bucket_"), Window.partitionBy("entity_").orderBy(F.desc("bucket_"))
    handed = []
    for name, (fn, _, *of) in values.items():
        c, along = f"carry_{name}_", down if fn == "lead" or of and of[0] in ("after", "from") else up
        if fn not in _FUNCTIONS:
            handed.append(F.lag(c).over(along)["x"].alias(c))
        elif of[0] == "all":
            handed.append(_FUNCTIONS[fn](c).over(Window.partitionBy("entity_")).alias(c))
        else:
            handed.append(_FUNCTIONS[fn](c).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias(c))
    carries = carries.select(*place, *handed)
    forth = Window.partitionBy(*place).orderBy(*order)
    back = Window.partitionBy(*place).orderBy(*(F.desc(c) for c in order))
    local = {}
    for name, (fn, column, *of) in values.items():
        w = back if fn == "lead" or of and of[0] in ("after", "from") else forth
        if fn not in _FUNCTIONS:
            local[f"first_{name}_"] = F.row_number().over(w) == 1
            local[f"local_{name}_"] = F.lag(column).over(w)
        elif of[0] != "all":
            local[f"local_{name}_"] = _FUNCTIONS[fn](column).over(w.rowsBetween(Window.unboundedPreceding, -1 if of[0] in ("before", "after") else 0))
    out = dealt.select("*", *(c.alias(n) for n, c in local.items())).join(carries, place)
    told = []
    for name, (fn, _, *of) in values.items():
        carry, here = F.col(f"carry_{name}_"), F.col(f"local_{name}_")
        if fn not in _FUNCTIONS:
            told.append(F.when(F.col(f"first_{name}_"), carry).otherwise(here).alias(name))
        else:
            told.append((carry if of[0] == "all" else _both(fn, here, carry)).alias(name))
    return out.select(*(F.col(c) for c in df.columns if c not in values), *told)


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """All rows with their place, from 1, in the order of ``order``: ranges of rows in order, each row's place in its range, and the ranges' sizes.

    No task holds more than its range, and the one window there is has a row for each range.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(dealt.withColumn("id_", F.monotonically_increasing_id()), "ranked")  # the range, and the place in it in 33 bits
    placed = placed.withColumns({"range_": F.shiftright("id_", 33), "at_": F.col("id_").bitwiseAND((1 << 33) - 1)}).drop("id_")
    sizes = placed.groupBy("range_").agg(F.count("*").alias("n_")).withColumn("one_", F.lit(0))
    before = F.sum("n_").over(Window.partitionBy("one_").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("range_", F.coalesce(before, F.lit(0)).alias("before_"))
    return placed.join(F.broadcast(starts), "range_").select(*df.columns, (F.col("before_") + F.col("at_") + 1).alias(name))
