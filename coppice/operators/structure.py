"""Layered structure graphs and parameter dependencies as node and edge tables over many problems.

nodes(problem_id, li, ni, name), edges(problem_id, li, ni, lj, nj), categories(li, category). Every operator is
a join or aggregate over all problems at once, keyed by problem and node, so one huge problem is spread too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import attach


def instance_id(li: Column, ni: Column, lj: Column, nj: Column) -> Column:
    return F.format_string("i:%d.%d-%d.%d", li, ni, lj, nj)


def abstract_id(li: Column, lj: Column, nj: Column) -> Column:
    return F.format_string("a:%d-%d.%d", li, lj, nj)


def instance_params(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One parameter per edge: how many lower items each upper node has."""
    lower = nodes.select("problem_id", "li", "ni", F.col("name").alias("item"))
    upper = nodes.select("problem_id", F.col("li").alias("lj"), F.col("ni").alias("nj"), F.col("name").alias("owner"))
    named = attach(attach(edges, lower, ["problem_id", "li", "ni"]), upper, ["problem_id", "lj", "nj"])
    return named.select("problem_id", instance_id(F.col("li"), F.col("ni"), F.col("lj"), F.col("nj")).alias("param_id"),
                        F.lit("instance").alias("kind"), "li", "ni", "lj", "nj",
                        F.concat(F.lit("each "), "owner", F.lit("'s "), "item").alias("name"))


def abstract_params(nodes: DataFrame, categories: Sequence[str]) -> DataFrame:
    """For each node and each lower layer: the total of that layer's category in the node."""
    lower = nodes.where(F.col("li") > 0).select(
        "problem_id", F.col("li").alias("lj"), F.col("ni").alias("nj"), "name",
        F.explode(F.sequence(F.lit(0), (F.col("li") - 1).cast("int"))).alias("li"))
    category = F.element_at(F.array(*[F.lit(c) for c in categories]), F.col("li") + 1)
    return lower.select("problem_id", abstract_id(F.col("li"), F.col("lj"), F.col("nj")).alias("param_id"),
                        F.lit("abstract").alias("kind"), "li", F.lit(None).cast("int").alias("ni"), "lj", "nj",
                        F.concat(F.lit("each "), "name", F.lit("'s "), category).alias("name"))


def difficulty_level(kind: Column, li: Column, lj: Column) -> Column:
    return F.when(kind == "abstract", lj - li).otherwise(F.lit(-1))


def param_parents(abstract: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem_id, child, pos, parent, parent_kind): the instance parameter of every edge into the node,
    followed by the lower abstract parameter when the layers are more than one apart."""
    ranked = edges.withColumn("__rank", F.row_number().over(
        Window.partitionBy("problem_id", "lj", "nj").orderBy("ni")) - 1).select(
        "problem_id", F.col("li").alias("pi"), F.col("ni").alias("pn"), "lj", "nj", "__rank")
    level = F.col("lj") - F.col("li")
    checked = abstract.withColumn("__level", F.when(level > 0, level).otherwise(
        F.raise_error(F.lit("an abstract parameter must look down")).cast("int")))
    joined = attach(checked.select("problem_id", "param_id", "li", "lj", "nj", "__level"), ranked, ["problem_id", "lj", "nj"])
    width = F.when(F.col("__level") > 1, 2).otherwise(1)
    of_edge = F.struct((F.col("__rank") * width).alias("pos"), instance_id(F.col("pi"), F.col("pn"), F.col("lj"), F.col("nj")).alias("parent"),
                       F.lit("instance").alias("parent_kind"))
    below = F.struct((F.col("__rank") * width + 1).alias("pos"), abstract_id(F.col("li"), F.col("pi"), F.col("pn")).alias("parent"),
                     F.lit("abstract").alias("parent_kind"))
    parents = F.when(F.col("__level") > 1, F.array(of_edge, below)).otherwise(F.array(of_edge))
    return joined.select("problem_id", F.col("param_id").alias("child"), F.explode(parents).alias("p")).select(
        "problem_id", "child", "p.pos", "p.parent", "p.parent_kind")


def abstract_equations(parents: DataFrame) -> DataFrame:
    """Equation template of every abstract parameter: {0} + {1} or {0} * {1} + {2} * {3}."""
    counted = parents.groupBy("problem_id", "child").agg(
        F.count(F.lit(1)).alias("n"), F.max((F.col("parent_kind") == "abstract").cast("int")).alias("products"))
    slot = lambda i: F.concat(F.lit("{"), i.cast("string"), F.lit("}"))
    sums = F.transform(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), slot)
    pairs = F.transform(F.sequence(F.lit(0), (F.col("n") / 2 - 1).cast("int")),
                        lambda i: F.concat(slot(i * 2), F.lit(" * "), slot(i * 2 + 1)))
    return counted.select("problem_id", F.col("child").alias("param_id"), F.array_join(
        F.when(F.col("products") == 1, pairs).otherwise(sums), " + ").alias("equation"))


def hierarchy_rollup(edges: DataFrame, quantity: str, layers: int | None = None) -> DataFrame:
    """Value of every abstract parameter: quantities multiplied down the layers and summed up.

    One join and one map-side-combined sum per level of difference. The number of layers is the deepest edge's
    (one small aggregate) unless given; edges above ``layers`` raise an error.
    """
    if layers is None:
        layers = (edges.agg(F.max("lj")).first()[0] or 0) + 1
    else:
        edges = edges.withColumn("lj", F.when(F.col("lj") < layers, F.col("lj")).otherwise(
            F.raise_error(F.lit("an edge lies above the given number of layers")).cast(edges.schema["lj"].dataType)))
    totals = edges.groupBy("problem_id", "li", "lj", "nj").agg(F.sum(quantity).alias("total"))
    out = totals
    for _ in range(layers - 2):
        below = totals.select("problem_id", F.col("li").alias("base"), F.col("lj").alias("li"), F.col("nj").alias("ni"), "total")
        stepped = attach(edges.select("problem_id", "li", "ni", "lj", "nj", quantity), below, ["problem_id", "li", "ni"])
        totals = stepped.groupBy("problem_id", F.col("base").alias("li"), "lj", "nj").agg(
            F.sum(F.col(quantity) * F.col("total")).alias("total"))
        out = out.unionByName(totals)
    return out


def unused_params(params: DataFrame, used: DataFrame, keys: Sequence[str] = ("problem_id", "param_id")) -> DataFrame:
    return params.join(used.select(*keys).distinct(), list(keys), "left_anti")


def candidate_nodes(first: DataFrame, second: DataFrame, keys: Sequence[str] = ("problem_id", "node")) -> DataFrame:
    """Nodes of the first set that are in the second one too."""
    return first.join(second.select(*keys), list(keys), "left_semi")


def computable_params(parents: DataFrame, present: DataFrame) -> DataFrame:
    """Parameters all of whose parents are present."""
    have = present.select("problem_id", F.col("param_id").alias("parent"), F.lit(1).alias("__have")).distinct()
    counted = attach(parents, have, ["problem_id", "parent"], "left").groupBy("problem_id", "child").agg(
        F.sum(F.when(F.col("__have").isNull(), 1).otherwise(0)).alias("missing"))
    return counted.where(F.col("missing") == 0).select("problem_id", F.col("child").alias("param_id"))


def operation_cost(in_degree: Column) -> Column:
    """Operations a node takes: one less than its inputs, at least one."""
    return F.greatest(F.lit(1), in_degree - 1)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In- and out-degree of every dependency node, zero included."""
    keys = ["problem_id", "node"]
    tally = (nodes.select(*keys, F.lit(0).alias("i"), F.lit(0).alias("o"))
             .unionByName(edges.select("problem_id", F.col("child").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
             .unionByName(edges.select("problem_id", F.col("parent").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"))))
    return tally.groupBy(*keys).agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def op_count(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(nodes, edges).groupBy("problem_id").agg(F.sum(operation_cost(F.col("in_degree"))).alias("num_ops"))


def ancestor_closure(roots: DataFrame, parents: DataFrame, present: DataFrame | None = None,
                     max_depth: int | None = None) -> DataFrame:
    """(problem_id, root, node): each root with all its ancestors, not going through nodes already present.

    With ``max_depth`` (a layered graph has at most layers - 1) the rounds are one lazy plan, which fails when an ancestor
    is left beyond it. Without it, rounds run until the frontier is empty and the lineage is cut by a reliable
    checkpoint every round.
    """
    up = parents.select("problem_id", F.col("child").alias("node"), "parent")  # a repeated edge gives no new node
    if present is not None:
        known = present.select("problem_id", F.col("node").alias("parent"))
        up = up.join(known, ["problem_id", "parent"], "left_anti")
    keys = ["problem_id", "root", "node"]
    frontier = roots.select("problem_id", F.col("node").alias("root"), "node").distinct()
    if max_depth is None:
        frontier, up = cut_lineage(frontier), cut_lineage(up)
    closure, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        step = attach(frontier, up, ["problem_id", "node"]).select("problem_id", "root", F.col("parent").alias("node")).distinct()
        if max_depth is None:
            step = cut_lineage(step.join(closure, keys, "left_anti"))
            if step.isEmpty():
                break
        closure = closure.unionByName(step)
        frontier, depth = step, depth + 1
    if max_depth is None:
        return closure
    beyond = attach(frontier, up, ["problem_id", "node"]).select("problem_id", "root", F.raise_error(
        F.lit("an ancestor lies beyond max_depth")).cast(dict(closure.dtypes)["node"]).alias("node"))
    return closure.unionByName(beyond).distinct()


def closure_budget(closure: DataFrame, in_degrees: DataFrame, used_ops: int, max_ops: int, size: str | None = None) -> DataFrame:
    """Operations every root would add, and whether they fit the budget; ``size`` names a column with its number of nodes.

    ``in_degrees`` has a row per node at most.
    """
    sized = attach(closure, in_degrees, ["problem_id", "node"], "left")
    cost = operation_cost(F.coalesce("in_degree", F.lit(0)))
    counted = [F.count(F.lit(1)).alias(size)] if size else []
    return sized.groupBy("problem_id", "root").agg(F.sum(cost).alias("new_ops"), *counted).withColumn(
        "accepted", (F.col("new_ops") + used_ops <= max_ops).cast("int"))


def topo_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem_id, node, level): level = longest path from a node without parents; null level = on or behind a cycle.

    Peels nodes by in-degree: a node leaves in the round in which its last parent has left, so every node and every
    edge is visited once, and rounds end when nothing is free. What never leaves is on or behind a cycle.
    """
    keys = ["problem_id", "node"]
    down = cut_lineage(edges.select("problem_id", F.col("parent").alias("node"), "child").distinct())
    waiting = cut_lineage(down.groupBy("problem_id", F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("open")))
    free = cut_lineage(nodes.select(*keys).distinct().join(waiting, keys, "left_anti").withColumn("level", F.lit(0)))
    done, level = [free], 0
    while not free.isEmpty():
        level += 1
        reached = attach(free, down, keys).groupBy("problem_id", F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("closed"))
        waiting = cut_lineage(attach(waiting, reached, keys, "left").select(*keys, (F.col("open") - F.coalesce("closed", F.lit(0))).alias("open")))
        free = cut_lineage(waiting.where("open = 0").select(*keys, F.lit(level).alias("level")))
        waiting = waiting.where("open > 0")
        done.append(free)
    levels = done[0]
    for step in done[1:]:
        levels = levels.unionByName(step)
    return attach(nodes.select(*keys), levels, keys, "left")


def necessary_nodes(questions: DataFrame, edges: DataFrame, nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Every node with ``necessary`` = 1 when the question depends on it (the question itself included)."""
    closure = ancestor_closure(questions, edges, max_depth=max_depth).select("problem_id", "node").distinct()
    marked = attach(nodes, closure.withColumn("necessary", F.lit(1)), ["problem_id", "node"], "left")
    return marked.withColumn("necessary", F.coalesce("necessary", F.lit(0)))
