"""Running totals and positions over a global order, without a single-task window.

Rows are range-partitioned by the order, each range is a chunk, and chunk totals carry the prefix.
A period, sender or family that holds most of the rows is spread over many chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from mailsift.session import cut_lineage

CHUNK = "_chunk"


def ordered_chunks(df: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
    """``df`` range-partitioned by ``order_by``, with the range number written out as a column.

    The number is checkpointed: range bounds are sampled, so it must not be computed twice.
    """
    return cut_lineage(df.repartitionByRange(*order_by).withColumn(CHUNK, F.spark_partition_id()))


def running_totals(
    df: DataFrame, totals: dict[str, Column], order_by: Sequence[str | Column], period: Sequence[str] = (),
    inclusive: bool = True,
) -> DataFrame:
    """Adds one running sum per entry of ``totals``, restarted in every ``period``.

    ``order_by`` must end with a unique column so that equal moments can be split over chunks. A frame
    that already went through ``ordered_chunks`` with this order keeps its chunks and is not moved again.
    """
    inputs = {f"_in_{name}": value for name, value in totals.items()}
    ready = df.withColumns(inputs)
    chunked = ready if CHUNK in df.columns else ordered_chunks(ready, order_by)
    sums = chunked.groupBy(*period, CHUNK).agg(*[F.sum(i).alias(i.replace("_in_", "_sum_")) for i in inputs])
    # Bounded: one row per chunk and period that meet.
    before = Window.partitionBy(*(period or [F.lit(0)])).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *period, CHUNK, *[F.sum(f"_sum_{n}").over(before).alias(f"_before_{n}") for n in totals]
    )
    inside = (
        Window.partitionBy(*period, CHUNK)
        .orderBy(*order_by)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (
        chunked.withColumns({f"_part_{n}": F.sum(f"_in_{n}").over(inside) for n in totals})
        .join(offsets, [*period, CHUNK])
        .withColumns({n: zero(F.col(f"_part_{n}")) + zero(F.col(f"_before_{n}")) for n in totals})
        .select(*df.columns, *totals)
    )


def positions(df: DataFrame, order_by: Sequence[str | Column], period: Sequence[str] = (), out: str = "position") -> DataFrame:
    """1-based position of every row in the order, restarted in every ``period``."""
    return running_totals(df, {out: F.lit(1).cast("bigint")}, order_by, period)
