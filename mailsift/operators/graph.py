"""Families: connected components over relations that share members."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from mailsift.session import cut_lineage


#: Members of a relation, or relations of a node, beyond which it is cut into parts.
HUB = 512
#: Tasks that the rows of one crowded key are dealt to.
SALTS = 64


def _crowded(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows and the number of parts they are cut into; at most one for every ``limit`` rows."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > limit)
    return cut_lineage(counted.select(key, F.ceil(F.col("n_rows") / limit).cast("long").alias("parts")))


def salted_left_join(rows: DataFrame, few: DataFrame, key: str, spread_by: str, salts: int = SALTS) -> DataFrame:
    """``rows`` left joined with ``few`` (one row a key): the rows of one key are dealt to ``salts`` tasks, ``few`` is repeated as often."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def _without_hubs(members: DataFrame, limit: int) -> DataFrame:
    """(r, n, alias) with the same components, where no r and no (n, alias) has many more than ``limit`` rows.

    A node in many relations becomes aliases, held together by a relation of its own. A relation of many members becomes
    a tree: parts of about ``limit`` members, whose least members form the relation of the next level.
    """
    key = lambda kind, name, level, part: F.struct(
        F.lit(kind).alias("kind"), name.cast("string").alias("name"), F.lit(level).alias("level"), part.cast("long").alias("part")
    ).alias("r")
    zero = F.lit(0).cast("long")
    busy = _crowded(members, "n", limit)
    edges = members.withColumn("alias", zero)
    if not busy.isEmpty():
        marked = salted_left_join(members, busy, "n", "r")
        edges = marked.select("r", "n", F.coalesce(F.pmod(F.xxhash64("r"), F.col("parts")), zero).alias("alias"))
        ties = busy.select(key("node", F.col("n"), 0, zero), "n", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("alias"))
    edges = edges.select(key("relation", F.col("r"), 0, zero), "n", "alias")
    left = cut_lineage(edges if busy.isEmpty() else edges.unionByName(ties))
    done, level = [], 0
    while True:
        hubs = _crowded(left, "r", limit)
        if hubs.isEmpty():
            done.append(left)
            break
        level += 1
        marked = cut_lineage(salted_left_join(left.withColumn("m", F.struct("n", "alias")), hubs, "r", "m"))
        done.append(marked.filter("parts IS NULL").select("r", "n", "alias"))
        part = F.pmod(F.xxhash64("n", "alias", F.lit(level)), F.col("parts"))
        inner = F.struct(F.col("r.kind"), F.col("r.name"), F.lit(level).alias("level"), (part + 1).alias("part"))
        cut = marked.filter("parts IS NOT NULL").select(F.col("r").alias("whole"), inner.alias("r"), "n", "alias")
        done.append(cut.select("r", "n", "alias"))
        least = cut.groupBy("whole", "r").agg(F.min(F.struct("n", "alias")).alias("m"))
        left = cut_lineage(least.select(F.col("whole").alias("r"), "m.n", "m.alias"))
    return cut_lineage(reduce(DataFrame.unionByName, done))


def linking(members: DataFrame) -> DataFrame:
    """The rows (r, n), each there once, of relations with several members; joined by both columns, so no relation gathers in one task."""
    single = members.groupBy("r").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("rows")).filter(F.col("rows") == 1)
    return cut_lineage(members.join(single.select("r", "n"), ["r", "n"], "left_anti"))


def component_labels(members: DataFrame, relation: str = "relation_id", node: str = "email_id", hub: int = HUB) -> DataFrame:
    """Smallest node of the component each node belongs to.

    ``members`` lists which node is in which relation. Crowded relations and nodes are cut into parts first, so every
    join below deals in keys of bounded size. A round takes the smallest label inside every relation, hands it back, and follows
    each label one step further, so long chains halve; a label that very many nodes have is looked up by salted keys.
    A relation of one member links nothing and takes no part in the rounds; a node in no other is a component of its own.
    A row without a node or a relation joins nothing and is left out.
    """
    if hub < 2:
        raise ValueError("a part needs at least two members")
    named = members.select(F.col(relation).alias("r"), F.col(node).alias("n")).filter("r IS NOT NULL AND n IS NOT NULL").distinct()
    named = cut_lineage(named)
    edges = _without_hubs(linking(named), hub)
    labels = edges.select("n", "alias").distinct().withColumn("label", F.col("n"))
    while True:
        held = edges.join(labels, ["n", "alias"])
        per_relation = held.groupBy("r").agg(F.min("label").alias("lower"))
        lowered = cut_lineage(held.join(per_relation, "r").groupBy("n", "alias").agg(F.min("lower").alias("label"), F.min("label").alias("old")))
        hop = lowered.filter("alias = 0").select(F.col("n").alias("label"), F.col("label").alias("further"))
        shared = _crowded(lowered, "label", hub).select("label")
        if shared.isEmpty():
            moved = lowered.join(hop, "label")
        else:
            first = salted_left_join(lowered.withColumn("m", F.struct("n", "alias")), hop.join(shared, "label", "left_semi"), "label", "m").drop("m")
            first = cut_lineage(first)
            rest = first.filter("further IS NULL").drop("further").join(hop, "label")
            moved = first.filter("further IS NOT NULL").unionByName(rest)
        moved = cut_lineage(moved.select("n", "alias", F.col("further").alias("label"), "old"))
        labels = moved.select("n", "alias", "label")
        if moved.filter("label <> old").isEmpty():
            found = labels.filter("alias = 0").select("n", F.col("label").alias("component"))
            alone = named.select("n").distinct().join(found, "n", "left_anti").select("n", F.col("n").alias("component"))
            return found.unionByName(alone).withColumnRenamed("n", node)


def resolve_families(
    universe: DataFrame, members: DataFrame, relation: str = "relation_id", node: str = "email_id",
    prefix: str = "fam:",
) -> DataFrame:
    """Family key of every node of ``universe``; null when no relation touches it.

    Members outside the universe still bridge families but get no key.
    """
    components = component_labels(members, relation, node)
    return (
        universe.select(node).distinct().join(components, node, "left")
        .select(node, F.concat(F.lit(prefix), F.col("component").cast("string")).alias("family_key"))
    )


def relations_of(df: DataFrame, key: str, node: str, kind: str) -> DataFrame:
    """Membership rows for every non-blank value of ``key``."""
    value = F.col(key).cast("string")
    return df.filter(F.length(F.trim(value)) > 0).select(
        F.concat_ws(":", F.lit(kind), value).alias("relation_id"), F.col(node).alias("email_id")
    )


def lineage_relations(pairs: DataFrame, child: str, parent: str) -> DataFrame:
    """Each child/parent pair as a two-member relation."""
    name = F.concat_ws(":", F.lit("lineage"), F.col(child).cast("string"), F.col(parent).cast("string"))
    return pairs.select(name.alias("relation_id"), F.explode(F.array(child, parent)).alias("email_id"))
