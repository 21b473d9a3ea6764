"""Ordered per-key computations that stay parallel when one key holds a large share of the rows.

A plain window over ``partitionBy(key)`` sorts a whole key in one task. Here the key is split into
order-preserving chunks and the window runs inside ``(key, chunk)``. One row per chunk, built with map-side
aggregation, brings along the counts, sums, extremes and last values of the chunks before it; it joins the
chunk's rows in the same shuffle and is dropped afterwards. The data itself is shuffled once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CHUNK, _ROW = "__chunk", "__row"


def time_chunk(ts: Column | str, seconds: int = 3600) -> Column:
    """Order-preserving chunk number of a timestamp."""
    return F.floor(F.unix_micros(F.col(ts) if isinstance(ts, str) else ts) / F.lit(seconds * 1_000_000))


def number_chunk(value: Column | str, width: float = 4096) -> Column:
    """Order-preserving chunk number of a numeric order column."""
    return F.floor((F.col(value) if isinstance(value, str) else value) / F.lit(width))



def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    *,
    lag: Mapping[str, str] | None = None,
    running_sum: Mapping[str, str] | None = None,
    running_max: Mapping[str, str] | None = None,
    before_only: bool = False,
    rank: str | None = None,
    last_flag: str | None = None,
) -> DataFrame:
    """Add lag, running and rank columns per key, in the total order given by ``order``.

    ``chunk`` must not decrease along ``order``. ``lag`` and the running columns map an output name to
    an input column; running columns include the current row unless ``before_only``. ``rank`` numbers
    rows from 1; ``last_flag`` marks the last row of each key.
    """
    lag, running_sum, running_max = dict(lag or {}), dict(running_sum or {}), dict(running_max or {})
    inputs = {f"__lag_{a}": F.col(c) for a, c in lag.items()}
    inputs |= {f"__sum_{a}": F.col(c).cast(_sum_type(df, c)) for a, c in running_sum.items()}
    inputs |= {f"__max_{a}": F.col(c) for a, c in running_max.items()}
    tagged = df.select("*", chunk.alias(_CHUNK), F.lit(1).alias(_ROW), *[c.alias(n) for n, c in inputs.items()])

    aggs = [F.count(F.lit(1)).alias("__n")]
    if lag:
        aggs.append(F.max_by(F.struct(*[f"__lag_{a}" for a in lag]), F.struct(*order)).alias("__last"))
    aggs += [F.sum(f"__sum_{a}").cast(_sum_type(df, c)).alias(f"__sum_{a}") for a, c in running_sum.items()]
    aggs += [F.max(f"__max_{a}").alias(f"__max_{a}") for a in running_max]
    per_chunk = tagged.groupBy(*keys, _CHUNK).agg(*aggs)

    # What has come before each chunk, as one row that sorts in front of the chunk's own rows.
    along = Window.partitionBy(*keys).orderBy(_CHUNK)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.select(
        *keys, _CHUNK, F.lit(0).alias(_ROW),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"),
        F.when(F.lead(_CHUNK).over(along).isNull(), F.col("__n")).alias("__rows_if_last"),
        *([F.lag("__last").over(along).alias("__last")] if lag else []),
        *[F.sum(f"__sum_{a}").over(earlier).cast(_sum_type(df, c)).alias(f"__sum_{a}") for a, c in running_sum.items()],
        *[F.max(f"__max_{a}").over(earlier).alias(f"__max_{a}") for a in running_max],
    )
    if lag:
        carried = carried.select("*", *[F.col(f"__last.__lag_{a}").alias(f"__lag_{a}") for a in lag]).drop("__last")

    within = Window.partitionBy(*keys, _CHUNK).orderBy(_ROW, *order)
    upto = within.rowsBetween(Window.unboundedPreceding, -1 if before_only else Window.currentRow)
    place = F.row_number().over(within) - 1
    extra = [F.lag(f"__lag_{a}").over(within).alias(a) for a in lag]
    extra += [F.sum(f"__sum_{a}").over(upto).alias(a) for a in running_sum]
    extra += [F.max(f"__max_{a}").over(upto).alias(a) for a in running_max]
    if rank:
        extra.append((F.max("__offset").over(within) + place).alias(rank))
    if last_flag:
        extra.append(F.coalesce(F.max("__rows_if_last").over(within) == place, F.lit(False)).alias(last_flag))
    merged = tagged.unionByName(carried, allowMissingColumns=True)
    return merged.select(*df.columns, *extra, _ROW).where(F.col(_ROW) == 1).drop(_ROW)


def _sum_type(df: DataFrame, column: str) -> str:
    """Type a running sum of a column is kept in."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.IntegralType):
        return "bigint"
    return f"decimal(38,{kind.scale})" if isinstance(kind, T.DecimalType) else "double"


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str], prefix: str) -> DataFrame:
    """One row per key: the ``carry`` columns of its first row by ``order``, named with ``prefix``.

    A partial aggregate (no sort, no window), so a key with very many rows costs one row per map task.
    """
    same = list(carry) == list(order)
    picked = F.min(F.struct(*order)) if same else F.min_by(F.struct(*carry), F.struct(*order))
    return (
        df.groupBy(*keys).agg(picked.alias("__first"), F.count(F.lit(1)).alias(f"{prefix}rows"))
        .select(*keys, *[F.col(f"__first.{c}").alias(prefix + c) for c in carry], f"{prefix}rows")
    )
