"""Running values over (key, order) that do not put a whole key into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. Here each key is
cut into order-consistent blocks: windows run inside (key, block), one summary row per block
carries the state, and only the summaries meet per key. A key that holds a third of the data
is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK_ROWS = 65536


def block_of(order: Column | str, size: float = BLOCK_ROWS) -> Column:
    """Order-consistent block number of a numeric order column."""
    c = F.col(order) if isinstance(order, str) else order
    return F.floor(c / F.lit(size)).cast("bigint")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    *,
    block: Column | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Add running sums (0 before the first row) and running maxima (NULL before it) per key.

    ``order`` must be unique inside a key; exclusive values leave out the row itself."""
    keys, order = list(keys), list(order)
    sums, maxes = sums or {}, maxes or {}
    block = block_of(order[0]) if block is None else block
    inside = Window.partitionBy(*keys, "__block").orderBy(*order)
    frame = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    d = df.withColumn("__block", block)
    d = d.withColumns({f"__v_{n}": v for n, v in {**sums, **maxes}.items()})
    totals = d.groupBy(*keys, "__block").agg(
        *[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums], *[F.max(f"__v_{n}").alias(f"__t_{n}") for n in maxes]
    )
    prior = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, "__block",
        *[F.sum(f"__t_{n}").over(prior).alias(f"__c_{n}") for n in sums],
        *[F.max(f"__t_{n}").over(prior).alias(f"__c_{n}") for n in maxes],
    )
    d = d.withColumns({
        **{f"__r_{n}": F.sum(f"__v_{n}").over(frame) for n in sums},
        **{f"__r_{n}": F.max(f"__v_{n}").over(frame) for n in maxes},
    })
    d = _join(d, carry, keys)
    zero = F.lit(0)
    for n in sums:
        d = d.withColumn(n, F.coalesce(f"__r_{n}", zero) + F.coalesce(f"__c_{n}", zero))
    for n in maxes:
        d = d.withColumn(n, F.greatest(f"__r_{n}", f"__c_{n}"))
    return _clean(d)


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, *, block: Column | None = None
) -> DataFrame:
    """Dense 1-based position per key."""
    return running(df, keys, order, {name: F.lit(1).cast("bigint")}, block=block)


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    *,
    block: Column | None = None,
    starts: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
    island: str = "island",
) -> DataFrame:
    """Add ``prev`` (struct of ``values`` of the preceding row) and, with ``starts``, islands.

    ``starts(cur, prev)`` tells whether a row opens a new island; a key's first row always does.
    """
    keys, order, values = list(keys), list(order), list(values)
    block = block_of(order[0]) if block is None else block
    inside = Window.partitionBy(*keys, "__block").orderBy(*order)
    row = F.struct(*values)
    d = df.withColumn("__block", block).withColumns({
        "__prev": F.lag(row).over(inside), "__last": F.lead(F.lit(1)).over(inside).isNull(),
    })

    def opens(cur, prev, missing: Column, default: int) -> Column:
        if starts is None:
            return F.lit(0).cast("bigint")
        opened = F.when(F.coalesce(starts(cur, prev), F.lit(True)), 1).otherwise(0)
        return F.when(missing, default).otherwise(opened).cast("bigint")

    named = lambda n: F.col(n)
    d = d.withColumn("__flag", opens(named, lambda n: F.col("__prev")[n], F.col("__prev").isNull(), 0))
    d = d.withColumn("__run", F.sum("__flag").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # First and last row of every block, in order: the state that crosses block borders.
    across = Window.partitionBy(*keys).orderBy(*order)
    edges = d.filter("__last OR __prev IS NULL").withColumn("__cprev", F.lag(row).over(across))
    edges = edges.withColumn(
        "__add",
        F.when(F.col("__prev").isNull(), opens(named, lambda n: F.col("__cprev")[n], F.col("__cprev").isNull(), 1))
        .otherwise(F.lit(0)) + F.when(F.col("__last"), F.col("__run")).otherwise(F.lit(0)),
    )
    edges = edges.withColumn("__off", F.sum("__add").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    carry = edges.filter("__prev IS NULL").select(*keys, "__block", "__cprev", "__off")
    d = _join(d, carry, keys).withColumn("prev", F.coalesce("__prev", "__cprev"))
    if starts is not None:
        d = d.withColumn(island, F.col("__run") + F.col("__off"))
    return _clean(d)


def _join(d: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    return d.join(carry, [*keys, "__block"]) if keys else d.join(carry, "__block")


def _clean(d: DataFrame) -> DataFrame:
    return d.drop(*[c for c in d.columns if c.startswith("__")])
