"""Column helpers of the operators that use DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII takes the fast path."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bit_table(spark: SparkSession, codes: DataFrame, column: str, bits: int) -> Column:
    """A scalar of ``bits / 64`` longs in which the slot of every code is set: fixed in size, whatever the table."""
    slot = F.pmod(F.col(column), F.lit(bits))
    filled = codes.select(
        F.shiftrightunsigned(slot, 6).alias("id"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("bit")
    ).groupBy("id").agg(F.bit_or("bit").alias("bit"))
    dense = spark.range(0, bits // 64, 1, 1).join(filled, "id", "left")
    packed = dense.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("bit", F.lit(0).cast("long")).alias("bit")))).alias("all"))
    return packed.select(F.col("all.bit")).scalar()


def in_table(table: Column, code: Column, bits: int) -> Column:
    """Whether the slot of ``code`` is set; true for every code the table was made of."""
    slot = F.pmod(code, F.lit(bits))
    held = F.get(table, F.shiftrightunsigned(slot, 6).cast("int"))
    return F.coalesce(F.getbit(held, (slot % 64).cast("int")) == 1, F.lit(False))


BITS = 1 << 22


def likely_in(code: Column, keys: DataFrame, key: Column, bits: int = BITS) -> Column:
    """False only where ``code`` is certainly none of the ``key`` codes of ``keys``.

    For use before a join that decides: rows that cannot match are kept out of the shuffle. The table is fixed in
    size; once it fills up more rows pass, and the join's result stays the same.
    """
    table = bit_table(keys.sparkSession, keys.select(key.alias("code")), "code", bits)
    return in_table(table, code, bits)
