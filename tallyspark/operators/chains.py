"""Succession chains and layers over directed edges, in rounds of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.lineage import cut_lineage
from tallyspark.operators.graph import connected_components


def one_to_one_edges(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """Edges that are their source's only way out and their target's only way in; loops are left out."""
    e = edges.select(F.col(source).alias("src"), F.col(target).alias("dst")).where("src <> dst").distinct()
    out = e.groupBy("src").agg(F.count("*").alias("n_out")).where("n_out = 1").select("src")
    into = e.groupBy("dst").agg(F.count("*").alias("n_in")).where("n_in = 1").select("dst")
    return e.join(out, "src", "left_semi").join(into, "dst", "left_semi")


def one_to_one_chains(edges: DataFrame, source: str = "src", target: str = "dst", rounds: int = 40) -> DataFrame:
    """(node, root, step) for every node of a one-to-one chain; cycles have no root and are left out.

    Every node points to its predecessor, and pointers double each round, so a chain of n nodes takes log2(n)
    joins.
    """
    kept = cut_lineage(one_to_one_edges(edges, source, target))
    nodes = kept.select(F.col("src").alias("node")).unionByName(kept.select(F.col("dst").alias("node"))).distinct()
    jump = nodes.join(kept.select(F.col("dst").alias("node"), F.col("src").alias("up")), "node", "left").select("node", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("step"), F.coalesce("up", "node").alias("root"))
    before = None
    for _ in range(rounds):
        jump = cut_lineage(jump)
        left = jump.where("up is not null").count()
        if left in (0, before):  # done, or only cycles are left
            break
        before = left
        above = jump.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("step").alias("step2"), F.col("root").alias("root2"))
        moved = jump.join(above, "up", "left")
        jump = moved.select("node", F.col("up2").alias("up"), (F.col("step") + F.coalesce("step2", F.lit(0))).alias("step"), F.coalesce("root2", "root").alias("root"))
    return jump.where("up is null").select("node", "root", "step")


def merge_tiers(strong: DataFrame, weak: DataFrame, pair: list[str]) -> DataFrame:
    """All strong edges and the weak ones whose pair no strong edge has."""
    return strong.unionByName(weak.join(strong.select(*pair).distinct(), pair, "left_anti"), allowMissingColumns=True)


def drop_mirrored(edges: DataFrame, source: str, target: str, period: str) -> DataFrame:
    """Edges without a later edge the other way round."""
    back = edges.select(F.col(source).alias("m_dst"), F.col(target).alias("m_src"), F.col(period).alias("m_period"))
    later = (F.col(source) == F.col("m_src")) & (F.col(target) == F.col("m_dst")) & (F.col("m_period") > F.col(period))
    return edges.join(back, later, "left_anti")


# Where a node's step hangs: on another node, on the starts (steps count from there), or on a cycle.
NODE, START, CYCLE = 0, 1, 2


def _anchored(only: DataFrame) -> DataFrame:
    """Nodes with one predecessor (node, kind, up, far) tied to the nearest one that has several or none, by doubling pointers.

    ``far`` adds up on the way. Nodes whose pointers run in a ring hang on a cycle.
    """
    jump, before = cut_lineage(only.withColumn("open", F.col("kind") == NODE)), None
    while True:
        left = jump.where("open").count()
        if left in (0, before):
            break
        before = left
        ahead = jump.select(F.col("node").alias("up"), F.col("kind").alias("kind2"), F.col("up").alias("up2"), F.col("far").alias("far2"), F.col("open").alias("more"))
        moving = jump.where("open").join(ahead, "up", "left")
        moved = moving.select(
            "node", F.coalesce("kind2", "kind").alias("kind"), F.when(F.col("more").isNotNull(), F.col("up2")).otherwise(F.col("up")).alias("up"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"),
            F.coalesce("more", F.lit(False)).alias("open"),
        )
        jump = cut_lineage(jump.where("NOT open").unionByName(moved))
    return jump.select("node", F.when(F.col("open"), F.lit(CYCLE)).otherwise(F.col("kind")).alias("kind"), F.when(~F.col("open"), F.col("up")).alias("up"), "far")


def longest_path_steps(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """(node, step, cyclic): the longest path to each node; nodes on or behind a cycle stand one past the deepest.

    A node with one predecessor stands ``far`` behind it. All such nodes are tied to the nearest node that has several
    predecessors or none by doubling pointers, and their edges start there from then on, the longest of equals kept.
    Starts count as one, so what only starts lead to is settled. A path or tree of n nodes takes log2(n) joins; a round is
    needed for each layer of nodes that several others lead to. When nothing has one predecessor any more, all that is left
    lies on or behind a cycle.
    """
    given = edges.select(F.col(source).alias("src"), F.col(target).alias("dst"))
    nodes = cut_lineage(given.select(F.explode(F.array("src", "dst")).alias("node")).where("node IS NOT NULL").distinct())
    links = cut_lineage(given.where("src <> dst").distinct())
    starts = nodes.join(links.select(F.col("dst").alias("node")), "node", "left_anti")
    is_start = starts.select(F.col("node").alias("src"), F.lit(True).alias("first"))
    left = links.join(is_start, "src", "left").select(F.when(F.col("first"), F.lit(START)).otherwise(F.lit(NODE)).alias("kind"), F.when(F.col("first").isNull(), F.col("src")).alias("src"), "dst", F.lit(1).cast("bigint").alias("far"))
    settled = starts.select("node", F.lit(START).alias("kind"), F.lit(None).cast(nodes.schema["node"].dataType).alias("up"), F.lit(0).cast("bigint").alias("far"))
    rounds = [settled]
    while True:
        left = cut_lineage(left.groupBy("kind", "src", "dst").agg(F.max("far").alias("far")))
        # a predecessor on a cycle decides, whatever the others are
        ups = left.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.max("kind").alias("most"), F.max(F.struct("kind", "src", "far")).alias("x"))
        only = ups.where((F.col("n") == 1) | (F.col("most") == CYCLE)).select("node", "x.kind", F.when(F.col("most") != CYCLE, F.col("x.src")).alias("up"), "x.far")
        tied = _anchored(only)
        if tied.isEmpty():
            break
        rounds.append(tied)
        rest = left.join(tied.select(F.col("node").alias("dst")), "dst", "left_anti")
        moved = rest.join(tied.select(F.col("node").alias("src"), F.col("kind").alias("kind2"), F.col("up").alias("up2"), F.col("far").alias("far2")), "src", "left")
        left = moved.select(F.coalesce("kind2", "kind").alias("kind"), F.when(F.col("kind2").isNull(), F.col("src")).otherwise(F.col("up2")).alias("src"), "dst", (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"))
    # from the last round back: what hangs on a node takes that node's place
    known = cut_lineage(left.select(F.col("dst").alias("node")).distinct().select("node", F.lit(None).cast("bigint").alias("step")))
    for tied in reversed(rounds):
        behind = tied.where(F.col("kind") == NODE).join(known.select(F.col("node").alias("up"), F.col("step").alias("above")), "up").select("node", (F.col("above") + F.col("far")).alias("step"))
        direct = tied.where(F.col("kind") != NODE).select("node", F.when(F.col("kind") == START, F.col("far")).alias("step"))
        known = cut_lineage(known.unionByName(behind).unionByName(direct))
    deepest = known.agg(F.coalesce(F.max("step"), F.lit(-1)).alias("deepest"))
    placed = known.crossJoin(F.broadcast(deepest))  # one row
    return placed.select("node", F.coalesce("step", F.col("deepest") + 1).cast("int").alias("step"), F.col("step").isNull().alias("cyclic"))


def cycle_components(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """(node, component) for every node on a cycle: the smallest node that it reaches and that reaches it.

    What lies before, behind or between no cycles is trimmed by ``longest_path_steps`` both ways. Stretches of nodes with
    one way in and one way out become edges by doubling pointers; a ring of such nodes is a component at once. In what
    is left the smallest node's name spreads forwards, and nodes that reach its owner backwards within its spread are the
    owner's component; they are taken out and the rest goes on. Loops are no cycles.
    """
    given = cut_lineage(edges.select(F.col(source).alias("src"), F.col(target).alias("dst")).where("src <> dst").distinct())
    core = _core(given)
    ins, outs = core.groupBy(F.col("dst").alias("node")).count().where("count = 1"), core.groupBy(F.col("src").alias("node")).count().where("count = 1")
    inner = cut_lineage(ins.select("node").join(outs.select("node"), "node"))
    ends = []
    for near, far in (("dst", "src"), ("src", "dst")):
        steps = inner.join(core.select(F.col(near).alias("node"), F.col(far).alias("up")), "node")
        ends.append(cut_lineage(_anchored(steps.select("node", F.lit(NODE).alias("kind"), "up", F.lit(1).cast("bigint").alias("far")))))
    rings = core.join(ends[0].where(F.col("kind") == CYCLE).select(F.col("node").alias("src")), "src", "left_semi")
    found = [connected_components(rings, "src", "dst")]
    inside = ends[0].where(F.col("kind") == NODE).select("node", F.col("up").alias("first")).join(ends[1].where(F.col("kind") == NODE).select("node", F.col("up").alias("last")), "node")
    inside = cut_lineage(inside)
    outer = core.join(inner.select(F.col("node").alias("src")), "src", "left_anti").join(inner.select(F.col("node").alias("dst")), "dst", "left_anti")
    bridges = inside.select(F.col("first").alias("src"), F.col("last").alias("dst"))
    left = cut_lineage(outer.select("src", "dst").unionByName(bridges).where("src <> dst").distinct())
    own_loops = inside.where("first = last").select(F.col("first").alias("node"), F.col("first").alias("component"))
    while not left.isEmpty():
        nodes = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        name = _spread(nodes.select("node", F.col("node").alias("name")), left)
        same = left.join(name.select(F.col("node").alias("src"), F.col("name").alias("a")), "src").join(name.select(F.col("node").alias("dst"), F.col("name").alias("b")), "dst").where("a = b")
        back = cut_lineage(same.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("a").alias("name")))
        reached = _reached(name.where("node = name"), back)
        found.append(reached.select("node", F.col("name").alias("component")))
        gone = reached.select("node")
        rest = left.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti")
        left = _core(cut_lineage(rest))
    named = reduce(DataFrame.unionByName, found).unionByName(own_loops).groupBy("node").agg(F.min("component").alias("component"))
    named = cut_lineage(named)
    at = lambda end: named.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    between = inside.join(at("first"), "first").join(at("last"), "last").where("of_first = of_last").select("node", F.col("of_first").alias("component"))
    both = cut_lineage(named.unionByName(between))
    smallest = both.groupBy("component").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
    return both.join(smallest, "component").select("node", F.col("least").alias("component"))


def _core(edges: DataFrame) -> DataFrame:
    """The edges between nodes that lie on a cycle, or on a way from one cycle to another."""
    kept = edges
    for ends in (("src", "dst"), ("dst", "src")):
        cyclic = longest_path_steps(kept, *ends).where("cyclic").select("node")
        kept = cut_lineage(kept.join(cyclic.select(F.col("node").alias("src")), "src", "left_semi").join(cyclic.select(F.col("node").alias("dst")), "dst", "left_semi"))
    return kept


def _spread(names: DataFrame, edges: DataFrame) -> DataFrame:
    """The smallest name that reaches each node along the edges."""
    current, before = cut_lineage(names), None
    while True:
        sent = edges.join(current.select(F.col("node").alias("src"), "name"), "src").select(F.col("dst").alias("node"), "name")
        current = cut_lineage(current.unionByName(sent).groupBy("node").agg(F.min("name").alias("name")))
        state = current.agg(F.sum(F.xxhash64("node", "name").cast("decimal(38,0)"))).first()[0]
        if state == before:
            return current
        before = state


def _reached(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, name) of all nodes that edges of a name lead to from the node of that name."""
    done = fresh = cut_lineage(roots.select("node", "name"))
    while True:
        sent = edges.join(fresh.select(F.col("node").alias("src"), "name"), ["src", "name"]).select(F.col("dst").alias("node"), "name").distinct()
        fresh = cut_lineage(sent.join(done.select("node"), "node", "left_anti"))
        if fresh.isEmpty():
            return done
        done = cut_lineage(done.unionByName(fresh))
