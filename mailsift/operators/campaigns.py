"""Campaign clusters over message vectors, their centroids and membership."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from mailsift import vocabulary as V
from mailsift.functions.hashing import name_uuid
from mailsift.functions.vectors import cosine, unit
from mailsift.operators.graph import component_labels
from mailsift.operators.similarity import _unit_rows
from mailsift.operators.vectorjoin import joining_links, vector_classes
from mailsift.session import cut_lineage

LEADER_BATCH = 4096
ROW_BLOCK = 8192
ARRIVALS = 256
#: Similarities that a task holds at once.
SCORES = 1 << 20


def centroids(assigned: DataFrame, cluster: str, vector: str = "embedding") -> DataFrame:
    """Unit-length mean of each cluster's unit vectors, from mergeable partial sums."""
    mean = assigned.groupBy(cluster).agg(
        Summarizer.mean(array_to_vector(unit(F.col(vector)))).alias("_mean"), F.count(F.lit(1)).alias("size")
    )
    return mean.select(cluster, "size", unit(vector_to_array("_mean")).alias("centroid"))


def _greedy(ids: list, rows: np.ndarray, threshold: float) -> tuple[list, np.ndarray]:
    """Leaders among a bounded batch, in order: a row leads when no earlier leader is close enough."""
    chosen: list[int] = []
    for i in range(len(rows)):
        if not chosen or (np.round(rows[chosen] @ rows[i], 9) < threshold).all():
            chosen.append(i)
    return [ids[i] for i in chosen], rows[chosen]


def _met(rows: DataFrame, leaders: DataFrame, key: str, judge, layout: str, block: int) -> DataFrame:
    """``judge(rows, leaders)`` for every block of rows, each of which meets all of the given leaders in a task of its own."""
    blocks = max(1, -(-rows.count() // block))
    own = rows.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_block"), F.lit(False).alias("_leads"), key, "_v")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sent = leaders.select(every.alias("_block"), F.lit(True).alias("_leads"), key, "_v")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(frames, ignore_index=True)
        leads = pdf["_leads"].to_numpy(bool)
        yield from judge(pdf[~leads], pdf[leads].sort_values(key))

    return own.unionByName(sent).groupBy("_block").applyInPandas(run, layout)


def _strips(rows: pd.DataFrame, leaders: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows with their similarity to each leader, at most about ``SCORES`` numbers at a time."""
    step = max(1, SCORES // max(1, len(leaders)))
    for begin in range(0, len(rows), step):
        some = rows.iloc[begin : begin + step]
        yield some, _scores(some, leaders)


def _scores(rows: pd.DataFrame, leaders: pd.DataFrame) -> np.ndarray:
    """Similarity of each row to each leader."""
    if rows.empty or leaders.empty:
        return np.zeros((len(rows), len(leaders)))
    return np.round(_unit_rows(np.stack(rows["_v"].to_numpy())) @ _unit_rows(np.stack(leaders["_v"].to_numpy())).T, 9)


def campaign_leaders(
    vectors: DataFrame, threshold: float = V.CAMPAIGN_SIMILARITY, key: str = "email_id", vector: str = "embedding",
    batch: int = LEADER_BATCH, block: int = ROW_BLOCK,
) -> DataFrame:
    """The (leader, member, similarity) table of greedy clustering in id order.

    A message leads a campaign when no earlier leader is within the threshold, and otherwise joins the
    nearest leader that is. A round takes the first ``batch`` undecided messages and finds the leaders among them in
    one task of that size; only rows that none of those leaders is close to stay for the next round. Once all leaders
    are known every row meets them, in batches, and keeps its best. Rows are compared with leaders only, never with each other.
    """
    if not 0.0 < threshold <= 1.0:
        raise ValueError("the similarity threshold must be in (0, 1]")
    key_type = vectors.schema[key].dataType.simpleString()
    layout = f"{key} {key_type}, _v array<double>"
    everything = cut_lineage(vectors.select(key, F.col(vector).cast("array<double>").alias("_v")))

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        names, _ = _greedy(pdf[key].tolist(), _unit_rows(np.stack(pdf["_v"].to_numpy())), threshold)
        return pdf.loc[pdf[key].isin(names), [key, "_v"]]

    def undecided(rows: pd.DataFrame, leaders: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for some, scores in _strips(rows, leaders):
            yield some.loc[~(scores >= threshold).any(axis=1), [key, "_v"]]

    def best(rows: pd.DataFrame, leaders: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ids = leaders[key].to_numpy()
        for some, scores in _strips(rows, leaders):
            keys = some[key].to_numpy()
            scores[ids[None, :] > keys[:, None]] = -2.0  # a leader is never later than its members
            scores[ids[None, :] == keys[:, None]] = 1.0
            top = scores.max(axis=1, initial=-2.0)
            found = top >= threshold
            at = scores.argmax(axis=1)[found] if found.any() else np.zeros(0, int)
            yield pd.DataFrame({"cluster_id": ids[at], key: keys[found], "similarity": top[found]})

    chosen: list[DataFrame] = []
    left = everything
    while not left.isEmpty():
        head = cut_lineage(left.orderBy(key).limit(batch))
        leaders = cut_lineage(head.groupBy().applyInPandas(lead, layout))
        chosen.append(leaders)
        left = cut_lineage(_met(left.join(head.select(key), key, "left_anti"), leaders, key, undecided, layout, block))
    assigned = f"cluster_id {key_type}, {key} {key_type}, similarity double"
    if not chosen:
        return everything.select(F.col(key).alias("cluster_id"), key, F.lit(1.0).alias("similarity"), F.col("_v").alias(vector))
    parts = [_met(everything, leaders, key, best, assigned, block) for leaders in chosen]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionByName(part)
    nearest = F.min(F.struct((-F.col("similarity")).alias("apart"), "cluster_id")).alias("_best")
    kept = joined.groupBy(key).agg(nearest).select("_best.cluster_id", key, (-F.col("_best.apart")).alias("similarity"))
    return kept.join(everything.withColumnRenamed("_v", vector), key).select("cluster_id", key, "similarity", vector)


class RunningCampaigns:
    """Campaigns of one component, row after row: a row joins the campaign whose running centroid is nearest, or founds one.

    Rows come in blocks: a block meets all centroids in one product, and only centroids that moved since are scored again.
    """

    def __init__(self, threshold: float, dimension: int) -> None:
        self.threshold = threshold
        self.founders: list = []
        self.sums = np.zeros((0, dimension))
        self.units = np.zeros((0, dimension))

    def add(self, ids: list, rows: np.ndarray) -> tuple[list, np.ndarray]:
        """Founder and similarity on joining of every row of the block."""
        known = len(self.founders)
        before = np.round(rows @ self.units.T, 9)
        room = np.zeros((len(rows), rows.shape[1]))
        sums, units = np.concatenate([self.sums, room]), np.concatenate([self.units, room])
        moved: list[int] = []
        joined, found = [], np.ones(len(rows))
        for i, row in enumerate(rows):
            score = np.full(len(self.founders), -2.0)
            score[:known] = before[i]
            if moved:
                score[moved] = np.round(units[moved] @ row, 9)
            best = int(score.argmax()) if len(score) else -1
            if best >= 0 and score[best] >= self.threshold:
                found[i] = score[best]
            else:
                best = len(self.founders)
                self.founders.append(ids[i])
            sums[best] += row
            length = np.linalg.norm(sums[best])
            units[best] = sums[best] / length if length > 0 else 0.0
            if best not in moved:
                moved.append(best)
            joined.append(self.founders[best])
        self.sums, self.units = sums[: len(self.founders)], units[: len(self.founders)]
        return joined, found


def independent_parts(vectors: DataFrame, threshold: float, key: str = "email_id", vector: str = "embedding") -> DataFrame:
    """key and part of every row with a direction, such that no campaign spans two parts.

    A row joins only where its cosine with the centroid reaches the threshold t. The sum of k members that each joined at t or
    more is at least 1 + (k - 1)t long, so a row that joins has a mean product with the members above t * t, hence a member
    that close. Components of the pairs with a cosine of t * t or more are therefore independent.
    """
    classes = cut_lineage(vector_classes(vectors, key, vector))
    links = cut_lineage(joining_links(classes.select("class_id", "v"), threshold * threshold - 1e-8))
    sides = links.select(F.concat_ws("-", "id_a", "id_b").alias("relation_id"), F.explode(F.array("id_a", "id_b")).alias("class_id"))
    labels = component_labels(sides, "relation_id", "class_id")
    return classes.join(labels, "class_id", "left").select(key, F.coalesce("component", "class_id").alias("part"))


def running_campaigns(
    vectors: DataFrame, threshold: float = V.CAMPAIGN_SIMILARITY, key: str = "email_id", vector: str = "embedding", block: int = ARRIVALS,
) -> DataFrame:
    """The (cluster_id, member, similarity) table of greedy clustering in id order around running centroids.

    A row joins the campaign with the nearest running centroid (unit mean of its members so far; ties to the older campaign) if
    that is within the threshold, and otherwise founds one. Independent parts run side by side; a part's rows pass one task in id
    order, a block at a time, because each depends on all before it. Such a task holds the part's centroids and one block of
    rows, never the part. A row without a direction is a campaign of its own.
    """
    if not 0.0 < threshold <= 1.0:
        raise ValueError("the similarity threshold must be in (0, 1]")
    kind = vectors.schema[key].dataType.simpleString()
    everything = cut_lineage(vectors.select(key, F.col(vector).cast("array<double>").alias("_v")))
    parts = cut_lineage(independent_parts(everything, threshold, key, "_v"))
    alone = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("part")
    crowd = parts.join(alone, "part", "left_anti").join(everything, key)
    ordered = crowd.repartition("part").sortWithinPartitions("part", key).select("part", key, "_v")

    def follow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, now = None, None
        for frame in frames:
            edges = np.flatnonzero(frame["part"].to_numpy()[1:] != frame["part"].to_numpy()[:-1]) + 1
            for first, last in zip([0, *edges], [*edges, len(frame)]):
                if first == last:
                    continue
                if now is None or frame["part"].iat[first] != part:
                    part, now = frame["part"].iat[first], RunningCampaigns(threshold, len(frame["_v"].iat[first]))
                for begin in range(first, last, block):
                    some = frame.iloc[begin : min(begin + block, last)]
                    joined, score = now.add(some[key].tolist(), _unit_rows(np.stack(some["_v"].to_numpy())))
                    yield pd.DataFrame({"cluster_id": joined, key: some[key], "similarity": score})

    followed = ordered.mapInPandas(follow, f"cluster_id {kind}, {key} {kind}, similarity double")
    rest = everything.select(key).join(crowd.select(key), key, "left_anti")
    single = rest.select(F.col(key).alias("cluster_id"), key, F.lit(1.0).alias("similarity"))
    return followed.unionByName(single).join(everything.withColumnRenamed("_v", vector), key).select("cluster_id", key, "similarity", vector)


def campaign_clusters(assigned: DataFrame, key: str = "email_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(clusters, members): centroid and size per campaign, and each member's similarity to the centroid."""
    clusters = centroids(assigned, "cluster_id", vector)
    members = assigned.join(clusters.select("cluster_id", "centroid"), "cluster_id").select(
        "cluster_id", key, cosine(F.col(vector), F.col("centroid")).alias("similarity")
    )
    return clusters, members


def campaign_ids(assigned: DataFrame, key: str = "email_id") -> DataFrame:
    """A name per cluster that depends on its members only.

    Member digests are added up in 32-bit parts, so the name needs no order and no task gathers a cluster.
    """
    digest = F.sha2(F.col(key).cast("string"), 256)
    part = lambda i: F.sum(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)"))
    joined = F.concat_ws("-", F.count(F.lit(1)), *[part(i) for i in range(8)])
    return assigned.groupBy("cluster_id").agg(joined.alias("_all")).select("cluster_id", name_uuid(F.col("_all")).alias("campaign_id"))


def membership(members: DataFrame, clusters: DataFrame, ids: DataFrame, version: str, key: str = "email_id") -> DataFrame:
    """Cluster, size and similarity of each requested message under one model version."""
    wanted = members.filter(F.col("model_version") == version).join(ids.select(key).distinct(), key, "left_semi")
    sized = clusters.filter(F.col("model_version") == version).select("cluster_id", "size")
    return wanted.join(sized, "cluster_id").select(key, "cluster_id", "size", "similarity")
