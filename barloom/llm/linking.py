"""Components of all links between members of common lists, without comparing all their pairs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.components import components
from barloom.session import discard, materialized

#: Leaders are tried again until fewer than one in so many of a turn's nodes joins one; this
#: decides how the pairs are found, not which.
JOINED = 20


def link(
    entries: DataFrame,
    compare: Callable[[DataFrame], DataFrame],
    block: list[str],
    rest: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """(node, component) of all nodes of materialized entries (list, node, ...), by the links in
    any list; the entries are discarded.

    compare(pairs a, b) returns the linked ones. First, in turns, each node is compared with a
    leader of its block (`list` and the columns named), one of another component; what hangs
    together by then is one component. rest(entries with label) then returns the linked pairs
    of different labels in one list, by `across` or a join of its own.
    """
    reached = materialized(entries.select("node").distinct().withColumn("label", F.col("node")))
    founds, turn = [], 0
    block = ["list", *block]
    while True:
        open_ = materialized(_open(entries, reached))
        # A node's leader: of the lowest other label in one of its blocks, a node that changes by turn.
        key = F.struct("label", F.xxhash64("node", F.lit(turn)).alias("random"), "node")
        dealt = open_.repartition(*block)
        led = dealt.groupBy(*block).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo.label < hi.label")
        leader = F.when(F.col("label") == F.col("lo.label"), F.col("hi.node")).otherwise(F.col("lo.node"))
        pairs = materialized(
            dealt.join(led, block)
            .groupBy(F.col("node").alias("a"))
            .agg(F.min(F.struct(F.xxhash64("list", F.lit(turn)).alias("random"), leader.alias("b"))).alias("best"))
            .select("a", "best.b")
        )
        found = materialized(compare(pairs))
        founds.append(found)
        hooked = materialized(_hooked(reached, found))
        turn += 1
        ended = found.count() * JOINED <= pairs.count()
        discard(open_, pairs, reached)
        reached = hooked
        if ended:
            break
    open_ = materialized(_open(entries, reached))
    linked = rest(open_)
    links = _by_label(reduce(DataFrame.unionByName, [*founds, linked]), reached)
    joined = components(links, "a", "b").select(F.col("node").alias("label"), "component")
    discard(entries, open_, *founds)
    return reached.join(joined, "label", "left").select("node", F.coalesce("component", "label").alias("component"))


def across(entries: DataFrame, allowed: Column) -> DataFrame:
    """Pairs (a, b) of entries x and y of one list with different labels for which `allowed` holds."""
    same = (F.col("x.list") == F.col("y.list")) & (F.col("x.label") < F.col("y.label"))
    pairs = entries.alias("x").join(entries.alias("y"), same & allowed)
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _by_label(links: DataFrame, reached: DataFrame) -> DataFrame:
    """Links between the labels of their ends."""
    for end in "ab":
        links = links.join(reached.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}")), end)
    return links.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).where("a <> b").distinct()


def _hooked(reached: DataFrame, found: DataFrame) -> DataFrame:
    """Labels after each linked label is hung to its smallest neighbour, and that to its own."""
    ends = [F.col("a"), F.col("b")]
    hook = _by_label(found, reached).groupBy(F.greatest(*ends).alias("label")).agg(F.min(F.least(*ends)).alias("parent"))
    hook = materialized(hook)
    up = hook.select(F.col("label").alias("parent"), F.col("parent").alias("above"))
    hook = hook.join(up, "parent", "left").select("label", F.coalesce("above", "parent").alias("parent"))
    return reached.join(hook, "label", "left").select("node", F.coalesce("parent", "label").alias("label"))


def _open(entries: DataFrame, reached: DataFrame) -> DataFrame:
    """Entries with their node's label, of lists that hold several labels."""
    labelled = entries.join(reached, "node").repartition("list")
    several = labelled.groupBy("list").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    return labelled.join(several.select("list"), "list")
