"""A ledger of keys that reads only the parts a batch can meet.

Rows lie in ``parts`` folders by the hash of their key. Beside them lies a sketch: for each part, bitmaps in which every
stored key has set one of ``SKETCH_BITS`` bits. A batch asks the sketches of its own parts first. A key whose bit is unset was
never stored, so it is new without a look at any row; only parts in which some key's bit is set are read, by a filter on
the partition column, and decide exactly. A sketch is written before its rows, so a writer that dies between the two
leaves bits that cost a look and never hides a key.

What the driver sees is part numbers, ``parts`` of them at most. Choose ``parts`` for about a million keys each; beyond
that sketches fill up and more parts are read, with the same answer. ``rebuilt`` writes a ledger anew with another number
of parts and one bitmap for many.

Nulls, ties, repeats: null keys equal each other and are stored once. Of rows with one key the first by ``order`` is
kept; rows equal in ``order`` too are interchangeable. A batch without rows stores nothing. A column named like the
ledger's own (``part``, ``batch`` where batches are numbered) cannot be stored and is refused. Keys keep their types from
batch to batch, as the hash tells an integer from a long.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailsift.sources.sinks import first_per_key, read_or_empty

PARTS = 64
#: Bits of one part's sketch; bitmaps of 4 KB that hold no key are not stored.
SKETCH_BITS = 1 << 23


def sketch_path(path: str) -> str:
    return f"{path}.sketch"


def _placed(rows: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """``rows`` with their part and their bit, which come from different halves of the key's hash."""
    code = F.xxhash64(*keys)
    bit = F.pmod(F.shiftrightunsigned(code, 32), F.lit(SKETCH_BITS))
    return rows.withColumns({"part": F.pmod(code, F.lit(parts)).cast("int"), "_slot": F.bitmap_bucket_number(bit), "_at": F.bitmap_bit_position(bit)})


def _sketches(placed: DataFrame) -> DataFrame:
    """Bitmaps per part and slot. Rows move to their part first: a bitmap per task and slot would be larger than its keys."""
    return placed.select("part", "_slot", "_at").repartition("part").groupBy("part", "_slot").agg(F.bitmap_construct_agg("_at").alias("_bits"))


def _is_set() -> Column:
    """Whether bit ``_at`` of ``_bits`` is set; eight bits to a byte, lowest first."""
    byte = "CAST(conv(hex(substring(_bits, CAST(_at DIV 8 + 1 AS INT), 1)), 16, 10) AS INT)"
    return F.coalesce(F.expr(f"(shiftright({byte}, CAST(_at % 8 AS INT)) & 1) = 1"), F.lit(False))


def _numbers(rows: DataFrame) -> list[int]:
    """Distinct parts, at most as many as the ledger has."""
    return [r["part"] for r in rows.select("part").distinct().collect()]


def _begun(spark: SparkSession, path: str) -> bool:
    """Whether anything was stored at ``path``; a sketch is there before any row."""
    try:
        spark.read.schema("part int").parquet(sketch_path(path))
        return True
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def suspects(first: DataFrame, path: str, keys: list[str], parts: int = PARTS) -> DataFrame:
    """``first`` (one row per key) with ``part`` and ``_maybe``: false where the sketch rules out that the key is stored."""
    placed = _placed(first, keys, parts)
    stored = read_or_empty(first.sparkSession, sketch_path(path), _sketches(placed))
    mine = stored.filter(F.col("part").isin(_numbers(placed))).groupBy("part", "_slot").agg(F.bitmap_or_agg("_bits").alias("_bits"))
    return placed.join(mine, ["part", "_slot"], "left").withColumn("_maybe", _is_set()).drop("_bits", "_slot", "_at")


def unseen(
    batch: DataFrame, path: str, keys: list[str], order: list[str], parts: int = PARTS, number: int | None = None
) -> DataFrame:
    """First row of every key that no batch, or no batch but ``number``, has stored."""
    own = {"part"} if number is None else {"part", "batch"}
    if own & {name.lower() for name in batch.columns}:
        raise ValueError(f"columns {sorted(own)} are the ledger's own")
    first = first_per_key(batch, keys, order)
    if not _begun(batch.sparkSession, path):
        return first.select(*batch.columns)
    asked = suspects(first, path, keys, parts)
    like = asked.select(*keys, "part", *([] if number is None else [F.lit(number).alias("batch")]))
    stored = read_or_empty(batch.sparkSession, path, like).filter(F.col("part").isin(_numbers(asked.filter("_maybe"))))
    if number is not None:
        stored = stored.filter(F.col("batch") != number)
    held = stored.select(F.col("part").alias("_part"), *[F.col(k).alias(f"_held_{i}") for i, k in enumerate(keys)])
    same = F.col("part") == F.col("_part")
    for i, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"_held_{i}"))
    new = asked.filter("_maybe").join(held, same, "left_anti").unionByName(asked.filter("NOT _maybe"))
    return new.select(*batch.columns)


def record(fresh: DataFrame, path: str, keys: list[str], parts: int = PARTS, number: int | None = None) -> None:
    """Stores rows of new keys, sketch first; a numbered batch replaces itself."""
    placed = _placed(fresh, keys, parts)
    mode, under = ("append", "") if number is None else ("overwrite", f"/batch={number}")
    _sketches(placed).write.mode(mode).partitionBy("part").parquet(sketch_path(path) + under)
    placed.drop("_slot", "_at").repartition("part").write.mode(mode).partitionBy("part").parquet(path + under)


def insert(batch: DataFrame, path: str, keys: list[str], order: list[str], parts: int = PARTS) -> None:
    """Stores the first row of every key that is not stored yet."""
    rows = batch.persist()  # looked at several times, and a streaming batch is computed again each time it is read
    try:
        fresh = unseen(rows, path, keys, order, parts).persist()
        try:
            record(fresh, path, keys, parts)
        finally:
            fresh.unpersist()
    finally:
        rows.unpersist()


def rows(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    """What the ledger holds; with ``like``, a frame of the stored columns, also where nothing was ever stored."""
    table = spark.read.parquet(path) if like is None else read_or_empty(spark, path, like)
    return table.drop("part", "batch")


def rebuilt(spark: SparkSession, path: str, to: str, keys: list[str], parts: int = PARTS) -> None:
    """The same rows as a new ledger at ``to`` with ``parts`` parts, its files and sketches merged."""
    record(rows(spark, path), to, keys, parts)
