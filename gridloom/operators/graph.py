"""Dependency graphs: depth, cycles, components and their descriptions.

Nodes have ``address``; edges have ``source`` and ``target`` and are distinct.
"""

from __future__ import annotations

import itertools
import random

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gridloom.session import cut_lineage, discard, keep, passing_tables, per_key, scratch_path, shuffles_freed


def node_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct incoming and outgoing edges of every node, in one aggregation."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("target").alias("address"), F.lit(1).alias("i"), F.lit(0).alias("o")),
        F.struct(F.col("source").alias("address"), F.lit(0).alias("i"), F.lit(1).alias("o")),
    )).alias("e")).select("e.*")
    counted = ends.groupBy("address").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.join(counted, "address", "left").fillna(0, ["in_degree", "out_degree"])


def _collapsed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with one parent that matters, as ``address, root, steps``, and the edges of all other nodes.

    A parent without parents of its own matters only where all parents are such: otherwise another one
    lies deeper. A node with a single parent is one step below it, whatever else the parent feeds, so its
    place follows from the nearest ancestor of another kind, found by pointer doubling.
    """
    fed = per_key(edges.select(F.col("target").alias("source")).distinct().withColumn("_deep", F.lit(True)))
    marked = edges.join(fed, "source", "left").fillna(False, ["_deep"])
    deep = per_key(marked.groupBy("target").agg(F.max("_deep").alias("_any"), F.min("source").alias("_one")))
    # Among parents of depth 0 one stands for all.
    kept = marked.join(deep, "target").filter(F.col("_deep") | (~F.col("_any") & (F.col("source") == F.col("_one"))))
    kept = cut_lineage(kept.select("source", "target"), "deep-edges")
    parents = kept.groupBy("target").agg(F.count("*").alias("n"), F.min("source").alias("root"))
    links = cut_lineage(
        parents.filter("n = 1").select(F.col("target").alias("address"), "root", F.lit(1).cast("bigint").alias("steps")), "links"
    )
    rounds = max(1, links.count()).bit_length() + 1
    for _ in range(rounds):
        up = links.select(F.col("address").alias("root"), F.col("root").alias("_r"), F.col("steps").alias("_s"))
        hop = links.join(up, "root", "left")
        with shuffles_freed(edges.sparkSession):
            done = hop.filter("_r IS NOT NULL").isEmpty()
        if done:
            break
        shorter, links = links, cut_lineage(
            hop.select("address", F.coalesce("_r", "root").alias("root"), (F.col("steps") + F.coalesce("_s", F.lit(0))).alias("steps")), "links"
        )
        discard(shorter)
    many = kept.join(per_key(parents.filter("n > 1").select("target")), "target", "left_semi")
    return links, many


def topological_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Depth of each node: 0 without parents, else one more than its deepest parent.

    Chains are collapsed first, so a running total over a million rows costs twenty joins. What is left
    are the nodes with several parents; each round releases those whose parents are all released and
    touches only what the last round released. Nodes on a cycle or below one are never released and do
    not appear.
    """
    spark = nodes.sparkSession
    out = scratch_path(spark, "depth")
    schema = "address string, depth bigint"
    with passing_tables(spark):
        links, many = _collapsed(nodes, edges)
        keep(links)
        ends = links.select(F.col("address").alias("source"), "root", "steps")
        # Edges between the remaining nodes, with the steps that lie on the chain between them.
        short = many.join(ends, "source", "left").select(
            F.coalesce("root", "source").alias("source"), "target", (F.coalesce("steps", F.lit(0)) + 1).alias("steps")
        )
        short = cut_lineage(short.groupBy("source", "target").agg(F.max("steps").alias("steps")), "short-edges")
        need = cut_lineage(short.groupBy(F.col("target").alias("address")).agg(F.count("*").alias("need")), "need")
        chained = per_key(links.select("address"))
        start = nodes.select("address").join(chained, "address", "left_anti").join(need.select("address"), "address", "left_anti")
        with shuffles_freed(spark):
            start.withColumn("depth", F.lit(0).cast("bigint")).write.parquet(f"{out}/round=0")
        frontier = spark.read.schema(schema).parquet(f"{out}/round=0")
        waiting, older = spark.createDataFrame([], "address string, left bigint, depth bigint"), None
        number = 0
        while not frontier.isEmpty():
            served = (
                short.join(frontier.withColumnRenamed("address", "source"), "source")
                .groupBy(F.col("target").alias("address"))
                .agg(F.count("*").alias("done"), F.max(F.col("depth") + F.col("steps")).alias("reached"))
            )
            # Only nodes reached so far are carried; their number of parents is looked up once.
            fresh = served.join(waiting.select("address"), "address", "left_anti").join(need, "address").select(
                "address", (F.col("need") - F.col("done")).alias("left"), F.col("reached").alias("depth")
            )
            again = waiting.join(served, "address", "left").select(
                "address", (F.col("left") - F.coalesce("done", F.lit(0))).alias("left"), F.greatest("depth", "reached").alias("depth")
            )
            reached = cut_lineage(fresh.unionByName(again), "waiting")
            if older is not None:
                discard(older)
            number += 1
            reached.filter("left = 0").select("address", "depth").write.parquet(f"{out}/round={number}")
            frontier = spark.read.schema(schema).parquet(f"{out}/round={number}")
            waiting, older = reached.filter("left > 0"), reached
    released = spark.read.schema(f"{schema}, round int").parquet(out).select("address", "depth")
    below = links.join(released.select(F.col("address").alias("root"), F.col("depth").alias("_d")), "root").select(
        "address", (F.col("_d") + F.col("steps")).alias("depth")
    )
    return released.unionByName(below).select("address", F.col("depth").cast("int").alias("depth"))


def cycle_nodes(nodes: DataFrame, depths: DataFrame) -> DataFrame:
    """Nodes that never got a depth: members of cycles and everything below them."""
    return nodes.select("address").join(depths.select("address"), "address", "left_anti")


def _seed_without_clash(nodes: DataFrame, edges: DataFrame) -> int:
    """A seed under which no two addresses share their 64-bit hash, as told by a second hash beside it."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("address"))
    every = nodes.select("address").unionByName(ends)
    for seed in itertools.count():
        hashed = every.select(_number(seed, "address").alias("id"), F.xxhash64("address", F.lit(seed)).alias("other"))
        with shuffles_freed(nodes.sparkSession):
            alone = hashed.groupBy("id").agg(F.min("other").alias("a"), F.max("other").alias("b")).filter("a <> b").isEmpty()
        if alone:
            return seed
    raise AssertionError("unreachable")


def _number(seed: int, address: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(address))


def _written(pairs: DataFrame, label: str) -> tuple[DataFrame, int]:
    """The pairs written, and their number, counted on the way."""
    seen = Observation()
    stored = cut_lineage(pairs.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return stored, seen.get["n"]


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Weakly connected components; the cluster is the smallest address in it.

    Randomised contraction (Bögeholz et al., 2020) on numbered nodes: each round a node gives way to the first of itself
    and its neighbours, in an order drawn anew, and the edges between those that remain are made distinct. At least a
    quarter of the linked nodes is expected to go each round, so the rounds get smaller, and all of them together cost a
    few times the first. Each is a ``min`` aggregate and two equality joins; no neighbour list is gathered. Then
    every node is led to the last one that stood for it, and addresses come back once, at the end.
    """
    linked = edges.filter("source <> target")
    seed = _seed_without_clash(nodes, linked)
    with passing_tables(nodes.sparkSession):
        named = _contracted(linked, seed)
    if named is None:
        return nodes.select("address", F.col("address").alias("cluster"))
    return nodes.select("address", _number(seed, "address").alias("u")).join(named, "u", "left").select(
        "address", F.coalesce("cluster", "address").alias("cluster")
    )


def _contracted(linked: DataFrame, seed: int) -> DataFrame | None:
    """The cluster of each number of a linked node; None without edges. What a round no longer needs is deleted."""
    a, b = _number(seed, "source"), _number(seed, "target")
    pairs, count = _written(linked.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "pairs")
    steps, draw = [], random.Random(seed)
    while count:
        # Numbers compared after flipping the same drawn bits: another order each round.
        bits = F.lit(draw.getrandbits(63))
        flip = lambda c: F.col(c).bitwiseXOR(bits)  # noqa: E731,B023
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy("u").agg(F.min(flip("v")).alias("m")).select("u", F.least(flip("u"), "m").alias("m"))
        step = per_key(first.select("u", flip("m").alias("to")))
        moved = (
            pairs.join(step.withColumnRenamed("to", "a"), "u")
            .join(step.select(F.col("u").alias("v"), F.col("to").alias("b")), "v")
            .filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        )
        before, (pairs, count) = pairs, _written(moved, "pairs")
        discard(before)
        steps.append(step)
    discard(pairs)
    if not steps:
        return None
    root = steps.pop()
    while steps:
        step, after = steps.pop(), root
        ahead = after.select(F.col("u").alias("to"), F.col("to").alias("_on"))
        root = per_key(step.join(ahead, "to", "left").select("u", F.coalesce("_on", "to").alias("to")))
        discard(step)
        discard(after)
    # Both ends of an edge lie in one component, and every address of it is an end: the smaller ones tell its name.
    ends = linked.select(a.alias("u"), F.least("source", "target").alias("address"))
    names = per_key(ends.join(root, "u").groupBy("to").agg(F.min("address").alias("cluster")))
    return keep(per_key(root.join(names, "to").select("u", "cluster")))


def cluster_summary(members: DataFrame) -> DataFrame:
    """Size and roles of each cluster; needs ``cluster`` and ``role``."""
    return members.groupBy("cluster").agg(
        F.count("*").alias("nodes"),
        F.count_if(F.col("role") == "input").alias("inputs"),
        F.count_if(F.col("role") == "output").alias("outputs"),
        F.count_if(~F.col("role").isin("input", "output")).alias("others"),
    )


# Words counted in the formulas of a cluster; the first best group wins.
PURPOSES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("lookup", ("VLOOKUP", "XLOOKUP", "INDEX", "MATCH")),
    ("aggregation", ("SUM", "SUMIF", "SUMIFS", "AVERAGE", "COUNT", "COUNTIF")),
    ("conditional_logic", ("IF", "AND", "OR", "NOT", "IFERROR", "IFS", "SWITCH")),
    ("date_calculation", ("DATE", "TODAY", "NOW", "YEAR", "MONTH", "DAY", "DATEDIF", "EOMONTH")),
    ("financial_formula", ("NPV", "IRR", "PMT", "FV", "PV", "RATE")),
    ("percentage", ("%",)),
    ("rounding", ("ROUND", "ROUNDUP", "ROUNDDOWN")),
    ("text", ("CONCAT", "CONCATENATE", "LEFT", "RIGHT", "MID", "TEXT")),
)


def occurrences(text: Column, word: str) -> Column:
    """How often ``word`` occurs, also inside longer words."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("bigint")


def cluster_purpose(members: DataFrame) -> DataFrame:
    """What the formulas of each cluster mostly do; NULL when no word occurs."""
    upper = F.upper("formula")
    sums = [
        F.sum(sum((occurrences(upper, w) for w in words), F.lit(0))).alias(name) for name, words in PURPOSES
    ]
    counts = members.filter(F.col("formula").isNotNull()).groupBy("cluster").agg(*sums)
    best = F.greatest(*[F.col(n) for n, _ in PURPOSES])
    purpose = F.coalesce(*[F.when((F.col(n) == best) & (best > 0), n) for n, _ in PURPOSES])
    return counts.select("cluster", purpose.alias("purpose"), best.cast("bigint").alias("hits"))


def cluster_names(members: DataFrame) -> DataFrame:
    """Name from the first labelled output, else input, in address order."""
    clean = F.trim(F.regexp_replace("label", "[^a-zA-Z0-9 _-]", ""))
    rank = F.when(F.col("role") == "output", 0).otherwise(1)
    ranked = members.filter(F.col("role").isin("output", "input") & (clean != "")).select(
        "cluster", clean.alias("clean"), F.struct(rank, F.col("address")).alias("rank")
    )
    return ranked.groupBy("cluster").agg(
        F.min_by(F.lower(F.replace("clean", F.lit(" "), F.lit("_"))), "rank").alias("name")
    )


def links(edges: DataFrame, side: Column, other: Column) -> DataFrame:
    """Number of edges between different groups of nodes."""
    return (
        edges.select(side.alias("from_group"), other.alias("to_group")).filter("from_group <> to_group")
        .groupBy("from_group", "to_group").agg(F.count("*").alias("weight"))
    )


def connection_weight(linked: DataFrame) -> DataFrame:
    """Total link weight at each group, both directions."""
    ends = linked.select(F.explode(F.array("from_group", "to_group")).alias("member"), "weight")
    return ends.groupBy("member").agg(F.sum("weight").alias("weight"))


def sheet_stats(members: DataFrame) -> DataFrame:
    """Inputs, outputs and the most frequent cluster of each sheet; ties go to the smaller name."""
    kept = members.filter(F.col("role").isin("input", "output"))
    per_cluster = kept.groupBy("sheet", "cluster").agg(
        F.count_if(F.col("role") == "input").alias("i"), F.count_if(F.col("role") == "output").alias("o")
    )
    return per_cluster.groupBy("sheet").agg(
        F.sum("i").alias("inputs"), F.sum("o").alias("outputs"),
        F.min_by("cluster", F.struct(-(F.col("i") + F.col("o")), F.col("cluster"))).alias("primary_cluster"),
    )


def unsupported(formulas: DataFrame, formula: str, names: tuple[str, ...]) -> DataFrame:
    """One row per formula and unsupported function in it."""
    hits = F.filter(
        F.array(*[F.when(F.upper(formula).rlike(rf"\b{n}\s*\("), F.lit(n)) for n in names]), lambda n: n.isNotNull()
    )
    return formulas.withColumn("function", F.explode(hits))
