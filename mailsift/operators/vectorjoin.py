"""All pairs of vectors above a cosine, and the components they form, by exact pivot partitioning.

Angles between unit vectors obey the triangle inequality. Every vector has a home cell, that of its nearest pivot.
Two vectors within an angle ``t`` of each other whose homes are p and q satisfy ``angle(x, q) <= angle(x, p) + 2t``, so it
is enough to send a vector to its home and to the later cells within that bound: each close pair meets in exactly
one cell, the later of its two homes. Cells of more than ``block`` rows are dealt into blocks by hash and the blocks
meet pair by pair, so a crowded cell is many tasks of one size. Inside a tile rows are sorted by their angle to the cell's
pivot and scored strip by strip; strips whose angles differ by more than ``t`` are never scored.

Equal vectors are folded before, so any number of copies is one row; ``vector_classes`` says who belongs to it.
Pivots are a fixed number of rows chosen by hash; which they are changes the cost, never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructType

from mailsift.session import cut_lineage

PIVOTS = 256
BLOCK = 4096
STRIP = 256
#: Scores that a task holds at once outside tiles.
PLACED = 1 << 18
#: Rows that a task hands on at once, each with its vector, while it places them in cells.
PLACED_ROWS = 1 << 14
#: Close pairs that a tile hands on at once.
HANDED = 1 << 16
#: Rows outside the largest component that may meet every row in place of a join in cells.
REST = 4096
#: Rounding of angles; widens every bound.
SLACK = 1e-6


def vector_classes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """class_id (the smallest key), key and the vector as doubles of every row that has a direction."""
    usable = vectors.select(key, F.col(vector).cast("array<double>").alias("v"))
    pointing = usable.filter(F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: F.abs(x) < float("inf")))
    first = pointing.groupBy("v").agg(F.min(key).alias("class_id"))
    return pointing.join(first, "v").select("class_id", key, "v")


def _unit_matrix(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    if len(set(vectors.value_lengths().to_pylist())) > 1:
        raise ValueError("vectors differ in length")
    return np.asarray(vectors.flatten()).reshape(len(vectors), -1)


def _unit(rows: list) -> np.ndarray:
    return _unit_matrix(np.stack(rows).astype(np.float64))


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _placed(rows: DataFrame, threshold: float, pivots: int) -> DataFrame:
    """Every row in its home cell and, as a guest, in the later cells its close pairs may live in."""
    # A fixed number of rows of one vector each: this is all that reaches the driver.
    chosen = rows.orderBy(F.xxhash64("v")).select("v").limit(pivots).collect()
    if not chosen:
        return rows.select(F.lit(0).alias("cell"), F.lit(True).alias("home"), F.lit(0.0).alias("angle"), "id", "v")
    centre = rows.sparkSession.sparkContext.broadcast(_unit([r.v for r in chosen]))
    reach = 2 * float(np.arccos(min(1.0, threshold))) + SLACK

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PLACED_ROWS // len(centre.value))
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                some = batch.slice(first, step)
                angle = _angles(_unit_matrix(_matrix(some.column("v"))), centre.value)
                home = angle.argmin(axis=1)
                near = angle <= angle[np.arange(len(home)), home][:, None] + reach
                near &= np.arange(angle.shape[1]) >= home[:, None]
                row, cell = np.nonzero(near)
                sent = some.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array(cell == home[row]), pa.array(angle[row, cell]), sent.column("id"), sent.column("v")],
                    names=["cell", "home", "angle", "id", "v"],
                )

    added = StructType().add("cell", IntegerType()).add("home", BooleanType()).add("angle", DoubleType())
    return rows.select("id", "v").mapInArrow(place, StructType([*added.fields, *rows.select("id", "v").schema.fields]))


def _tiles(placed: DataFrame, block: int) -> DataFrame:
    """Rows with the tiles they take part in: ``first`` and ``second`` block of a cell, and on which side they are.

    Home blocks meet each other once and every block of guests; a tile holds at most about two blocks.
    """
    sizes = placed.groupBy("cell").agg(
        F.ceil(F.count_if("home") / block).cast("int").alias("homes"), F.ceil(F.count_if(~F.col("home")) / block).cast("int").alias("guests")
    )
    sized = placed.join(sizes, "cell")
    dealt = lambda n: F.pmod(F.xxhash64("id", F.lit(3)), F.greatest(n, F.lit(1))).cast("int")
    own = F.when(F.col("home"), dealt(F.col("homes"))).otherwise(dealt(F.col("guests")))
    tile = lambda a, b, side: F.struct(a.alias("first"), b.alias("second"), F.lit(side).alias("side"))
    up_to = lambda n, make: F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), make))
    me, homes, guests = F.col("own"), F.col("homes"), F.col("guests")
    as_home = F.concat(
        up_to(homes, lambda k: F.struct(F.least(me, k).alias("first"), F.greatest(me, k).alias("second"), F.when(k < me, 1).otherwise(0).alias("side"))),
        F.coalesce(up_to(guests, lambda k: tile(me, homes + k, 0)), F.array().cast("array<struct<first:int,second:int,side:int>>")),
    )
    as_guest = up_to(homes, lambda k: tile(k, homes + me, 1))
    spread = sized.withColumn("own", own).withColumn("t", F.explode(F.when(F.col("home"), as_home).otherwise(as_guest)))
    return spread.select("cell", "t.first", "t.second", "t.side", "angle", "id", "v")


def scored_strips(
    ids: tuple[np.ndarray, np.ndarray], units: tuple[np.ndarray, np.ndarray], angles: tuple[np.ndarray, np.ndarray], reach: float, same: bool,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left rows, right rows, scores) of the strips that may hold close pairs; both sides sorted by angle."""
    for a in range(0, len(ids[0]), STRIP):
        left = slice(a, a + STRIP)
        low, high = angles[0][left][0] - reach, angles[0][left][-1] + reach
        begin, end = np.searchsorted(angles[1], low, "left"), np.searchsorted(angles[1], high, "right")
        if same:
            begin = max(begin, a)
        for b in range(begin, end, STRIP):
            right = slice(b, min(b + STRIP, end))
            yield np.arange(len(ids[0]))[left], np.arange(len(ids[1]))[right], units[0][left] @ units[1][right].T


def _close(frame: pd.DataFrame, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Strip by strip of a tile: ids of the close pairs, their rounded cosines, and how many pairs were scored."""
    same = bool(frame["first"].iat[0] == frame["second"].iat[0])
    frame = frame.sort_values("angle", kind="stable")
    sides = [frame[frame["side"] == side] for side in (0, 1)]
    if same:
        sides[1] = sides[0]
    if any(side.empty for side in sides):
        return
    ids = tuple(side["id"].to_numpy() for side in sides)
    units = tuple(_unit(side["v"].tolist()) for side in sides)
    angles = tuple(side["angle"].to_numpy() for side in sides)
    for left, right, score in scored_strips(ids, units, angles, float(np.arccos(min(1.0, threshold))) + SLACK, same):
        scored = score.size
        score = np.round(score, 9)
        row, column = np.nonzero(score >= threshold)
        if same:
            once = left[row] < right[column]
            row, column = row[once], column[once]
        a, b = ids[0][left[row]], ids[1][right[column]]
        yield np.minimum(a, b), np.maximum(a, b), score[row, column], scored


def _joined(classes: DataFrame, threshold: float, pivots: int, block: int, judge: Callable, layout: str) -> DataFrame:
    """What ``judge`` hands on of every tile, frame by frame."""
    if not 0.0 < threshold <= 1.0:
        raise ValueError("the similarity threshold must be in (0, 1]")
    rows = cut_lineage(classes.groupBy(F.col("class_id").alias("id")).agg(F.first("v").alias("v")))
    placed = cut_lineage(_placed(rows, threshold, pivots))

    def judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from judge(pd.concat(frames, ignore_index=True))

    return _tiles(placed, block).groupBy("cell", "first", "second").applyInPandas(judged, layout)


def cosine_join(classes: DataFrame, threshold: float, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """id_a < id_b and similarity of all pairs of classes whose cosine, rounded to 1e-9, reaches the threshold."""
    kind = classes.schema["class_id"].dataType.simpleString()

    def judge(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for *found, _ in _close(frame, threshold):
            held.append(found)
            if sum(len(part[0]) for part in held) >= HANDED:
                yield pd.DataFrame(dict(zip(("id_a", "id_b", "similarity"), map(np.concatenate, zip(*held)))))
                held = []
        if held:
            yield pd.DataFrame(dict(zip(("id_a", "id_b", "similarity"), map(np.concatenate, zip(*held)))))

    return _joined(classes, threshold, pivots, block, judge, f"id_a {kind}, id_b {kind}, similarity double")


def join_cost(classes: DataFrame, threshold: float, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """Per tile: its rows, the pairs it scored and those it found."""

    def judge(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        strips = [(scored, len(a)) for a, _, _, scored in _close(frame, threshold)]
        scored, found = map(sum, zip(*strips)) if strips else (0, 0)
        yield pd.DataFrame({"rows": [len(frame)], "scored": [scored], "found": [found]})

    return _joined(classes, threshold, pivots, block, judge, "rows long, scored long, found long")


def _forest(a: np.ndarray, b: np.ndarray, parent: dict | None = None) -> list[tuple]:
    """Links that join what earlier ones had not joined; ``parent`` remembers these from call to call."""
    parent = {} if parent is None else parent

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            kept.append((x, y))
    return kept


def _links_to(rows: DataFrame, few: list, threshold: float) -> DataFrame:
    """Links that have the components of all close pairs between ``rows`` and a few of them.

    Each row is linked to the first it is close to; others it is close to are linked to that one, once a batch if at all.
    """
    kind = rows.schema["id"].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast((np.array([r.id for r in few]), _unit([r.v for r in few])))

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, units = sent.value
        step = max(1, PLACED // len(names))
        for frame in frames:
            for begin in range(0, len(frame), step):
                some = frame.iloc[begin : begin + step]
                near = np.round(_unit(some["v"].tolist()) @ units.T, 9) >= threshold
                first, linked = near.argmax(axis=1), near.any(axis=1)
                row, other = np.nonzero(near)
                a, b = np.divmod(np.unique(first[row] * len(names) + other), len(names))
                among = _forest(names[a], names[b])
                own = pd.DataFrame({"id_a": names[first[linked]], "id_b": some["id"].to_numpy()[linked]})
                yield pd.concat([own[own["id_a"] != own["id_b"]], pd.DataFrame(among, columns=["id_a", "id_b"]).astype(own.dtypes)])

    return rows.select("id", "v").mapInPandas(link, f"id_a {kind}, id_b {kind}")


def _outside(rows: DataFrame, links: DataFrame, few: list) -> DataFrame:
    """The rows that links to a few rows leave outside the largest component; of the links only those among the few pass the driver."""
    names = rows.sparkSession.createDataFrame([(r.id,) for r in few], rows.select("id").schema)
    inner = links.join(F.broadcast(names.withColumnRenamed("id", "id_a")), "id_a").join(F.broadcast(names.withColumnRenamed("id", "id_b")), "id_b")
    among = inner.select("id_a", "id_b").distinct().collect()
    top = {r.id: r.id for r in few}
    for x, y in _forest(np.array([r.id_a for r in among]), np.array([r.id_b for r in among])):
        old, new = top[y], top[x]
        top = {name: new if label == old else label for name, label in top.items()}
    labels = rows.sparkSession.createDataFrame(list(top.items()), rows.select("id", F.col("id").alias("label")).schema)
    own = links.select(F.col("id_b").alias("id"), F.col("id_a").alias("few")).unionByName(names.select("id", F.col("id").alias("few")))
    labelled = own.join(F.broadcast(labels.withColumnRenamed("id", "few")), "few").select("id", "label").distinct()
    largest = labelled.groupBy("label").count().orderBy(F.desc("count"), "label").select("label").limit(1)
    return rows.join(labelled.join(F.broadcast(largest), "label").select("id"), "id", "left_anti")


def joining_links(classes: DataFrame, threshold: float, pivots: int = PIVOTS, block: int = BLOCK, rest: int = REST) -> DataFrame:
    """id_a and id_b of links that have the components of all close pairs.

    Rows are linked to the pivots they are close to first. If at most ``rest`` rows stay outside the largest component so found,
    these meet every row, which is all that can be missing: pairs inside a component join nothing. Otherwise close pairs are
    found in cells, where a tile hands on fewer links than it has rows.
    """
    kind = classes.schema["class_id"].dataType.simpleString()

    def judge(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        parent: dict = {}
        for a, b, _, _ in _close(frame, threshold):
            yield pd.DataFrame(_forest(a, b, parent), columns=["id_a", "id_b"])

    if not 0.0 < threshold <= 1.0:
        raise ValueError("the similarity threshold must be in (0, 1]")
    rows = cut_lineage(classes.groupBy(F.col("class_id").alias("id")).agg(F.first("v").alias("v")))
    few = rows.orderBy(F.xxhash64("v")).limit(pivots).collect()
    if few:
        links = cut_lineage(_links_to(rows, few, threshold))
        # At most ``rest`` rows and one reach the driver.
        left = _outside(rows, links, few).limit(rest + 1).collect()
        if len(left) <= rest:
            return links.unionByName(_links_to(rows, left, threshold)) if left else links
    return _joined(classes, threshold, pivots, block, judge, f"id_a {kind}, id_b {kind}")


def close_counts(classes: DataFrame, threshold: float, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """id and links of the classes that are close to another: ``link_counts`` of the join, counted where pairs are found.

    A tile hands on at most one count a row, however many pairs it holds.
    """
    kind = classes.schema["class_id"].dataType.simpleString()

    def judge(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ids = np.unique(frame["id"].to_numpy())
        links = np.zeros(len(ids), np.int64)
        for a, b, _, _ in _close(frame, threshold):
            links += np.bincount(np.searchsorted(ids, np.concatenate([a, b])), minlength=len(ids))
        yield pd.DataFrame({"id": ids[links > 0], "links": links[links > 0]})

    return _joined(classes, threshold, pivots, block, judge, f"id {kind}, links long").groupBy("id").agg(F.sum("links").alias("links"))


def link_counts(pairs: DataFrame) -> DataFrame:
    """id and how many close classes it has; both sides of a pair count."""
    sides = F.explode(F.array("id_a", "id_b"))
    return pairs.select(sides.alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("links"))


