"""River-network operators on edge tables with at most one downstream edge per node.

Long walks use pointer doubling: after round k every pointer spans 2^k steps, so a
chain of n nodes is done in ceil(log2 n) rounds. What still moves then is on or above a
cycle. Each round ends in a checkpoint, which keeps the plan short and lets lost
executors be replaced without replaying the loop.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headrace.functions.core import BROADCAST_ROWS
from headrace.session import reliable_checkpoint

#: Longest walk below a dam that G-1 follows, unless another limit is given.
MAX_STEPS = 5000


def _doublings(max_steps: int) -> int:
    return max(1, max_steps.bit_length())  # steps up to max_steps itself, so that a cut shows


def downstream_walk(starts: DataFrame, network: DataFrame, eps: float | None = 0.01,
                    max_steps: int = MAX_STEPS, stop_at_starts: bool = True) -> DataFrame:
    """G-1: (dam, river_id, step) for the reaches below each start.

    ``starts``: dam. ``network``: river_id, next_down (0 or NULL is the mouth),
    upland_skm. A walk stops before the next dam, at the mouth, or where the dam's
    upstream area is less than ``eps`` of the local one, or after ``max_steps``; a walk
    that meets this last limit raises a warning.
    """
    starts = starts.select("dam").distinct()
    known = network.select(F.col("river_id").alias("next_down"))
    hops = network.filter("next_down <> 0").select("river_id", "next_down").join(known, "next_down", "left_semi")
    if stop_at_starts:
        hops = hops.join(starts.select(F.col("dam").alias("next_down")), "next_down", "left_anti")
    jumps = reliable_checkpoint(hops.select(F.col("river_id").alias("a"), F.col("next_down").alias("b")))
    on_net = network.select(F.col("river_id").alias("dam"))
    found = starts.join(on_net, "dam", "left_semi").select("dam", F.col("dam").alias("river_id"),
                                                           F.lit(0).alias("step"))
    for k in range(_doublings(max_steps)):
        # An empty jump table means that no walk is 2^k steps long.
        if jumps.limit(1).count() == 0:
            break
        ahead = found.join(jumps, found.river_id == jumps.a).select(
            "dam", F.col("b").alias("river_id"), (F.col("step") + 2**k).alias("step"))
        found = reliable_checkpoint(
            found.unionByName(ahead).groupBy("dam", "river_id").agg(F.min("step").alias("step")))
        right = jumps.select(F.col("a").alias("b"), F.col("b").alias("c"))
        jumps = reliable_checkpoint(jumps.join(right, "b").select("a", F.col("c").alias("b")))
    if found.filter(F.col("step") >= max_steps).limit(1).count():
        warnings.warn(f"walks were cut after {max_steps} steps", stacklevel=2)
    found = found.filter(F.col("step") < max_steps)
    if eps is None:
        return found
    area = network.select("river_id", "upland_skm")
    at = found.join(area, "river_id")
    own = area.select(F.col("river_id").alias("dam"), F.col("upland_skm").alias("own_skm"))
    at = at.join(own, "dam")
    thin = (F.col("own_skm") > 0) & (F.try_divide("own_skm", "upland_skm") < eps) & (F.col("step") > 0)
    first = at.filter(thin).groupBy("dam").agg(F.min("step").alias("thin_step"))
    kept = at.join(first, "dam", "left").filter(F.coalesce(F.col("step") < F.col("thin_step"), F.lit(True)))
    return kept.select("dam", "river_id", "step")


def segments(reaches: DataFrame, network: DataFrame) -> DataFrame:
    """G-2: reaches grouped by the exact set of controlling dams.

    The sets are small by construction: dams that share a reach have disjoint
    upstream areas, each at least ``eps`` of the reach's, so 100 at eps = 0.01.
    """
    sets = reaches.groupBy("river_id").agg(F.array_sort(F.collect_set("dam")).alias("dams"))
    facts = network.select("river_id", "length_km", "catch_skm", "upland_skm", "irrigated_pct")
    grouped = sets.join(facts, "river_id").groupBy("dams").agg(
        F.count(F.lit(1)).alias("n_reaches"), F.sum("length_km").alias("length_km"),
        F.sum(F.col("irrigated_pct") / 100 * F.col("catch_skm")).alias("irrigated_km2"),
        F.max("upland_skm").alias("a_outlet_skm"),
    )
    text = F.concat_ws("|", F.transform("dams", lambda d: d.cast("string")))
    return grouped.select(F.sha2(text, 256).alias("seg"), "*")


def _jumps(network: DataFrame) -> Iterator[DataFrame]:
    """Pointers (a, b) over 1, 2, 4, ... steps, until none is left or, with cycles, all chains are spanned."""
    jumps = reliable_checkpoint(
        outflows(network).select(F.col("river_id").alias("a"), F.col("next_down").alias("b")))
    for _ in range(jumps.count().bit_length() + 1):
        if jumps.limit(1).count() == 0:
            return
        yield jumps
        right = jumps.select(F.col("a").alias("b"), F.col("b").alias("c"))
        jumps = reliable_checkpoint(jumps.join(right, "b").select("a", F.col("c").alias("b")))


def resolve_pointers(edges: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """Follow ``next`` from every node to the first stop node, or to the end of its chain.

    ``edges``: node, next (NULL at the end), w. Returns node, end (NULL if no stop
    was met), total (sum of w), steps, open (still walking: on or above a cycle).
    Chains of any length are followed.
    """
    base = edges.select("node", F.col("next").alias("to"), F.col("w").cast("double").alias("total"))
    known = edges.select(F.col("node").alias("to"), F.lit(True).alias("__known"))
    base = base.join(known, "to", "left").withColumn("to", F.when(F.col("__known"), F.col("to")))
    if stops is not None:
        halt = stops.select(F.col("node").alias("to"), F.lit(True).alias("__stop"))
        base = base.join(halt, "to", "left")
    else:
        base = base.withColumn("__stop", F.lit(None).cast("boolean"))
    done = F.col("to").isNull() | F.coalesce("__stop", F.lit(False))
    step = F.when(F.col("to").isNull(), 0).otherwise(1)
    weight = F.when(F.col("to").isNull(), F.lit(0.0)).otherwise(F.col("total"))
    state = reliable_checkpoint(base.select("node", "to", weight.alias("total"), step.alias("steps"),
                                            done.alias("done")))
    for _ in range(state.count().bit_length() + 1):
        if state.filter(~F.col("done")).limit(1).count() == 0:
            break
        onward = state.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("total").alias("total2"),
                              F.col("steps").alias("steps2"), F.col("done").alias("done2"))
        moving = state.filter(~F.col("done")).join(onward, "to").select(
            "node", F.col("to2").alias("to"), (F.col("total") + F.col("total2")).alias("total"),
            (F.col("steps") + F.col("steps2")).alias("steps"), F.col("done2").alias("done"))
        state = reliable_checkpoint(state.filter("done").unionByName(moving))
    return state.select("node", F.col("to").alias("end"), "total", "steps", (~F.col("done")).alias("open"))


def downstream_depth(network: DataFrame) -> DataFrame:
    """G-6: steps from a node to its outlet; NULL on or above a cycle."""
    ends = resolve_pointers(_as_edges(network))
    return ends.select(F.col("node").alias("river_id"), F.when(~F.col("open"), F.col("steps")).alias("depth"))


def _as_edges(network: DataFrame) -> DataFrame:
    return network.select(F.col("river_id").alias("node"),
                          F.when(F.col("next_down") != 0, F.col("next_down")).alias("next"), F.lit(1.0).alias("w"))


def outlets(network: DataFrame) -> DataFrame:
    """G-8: nodes whose downstream node is 0 or outside the table."""
    known = network.select(F.col("river_id").alias("next_down"))
    return network.join(known, "next_down", "left_anti").select("river_id")


def upstream_trace(starts: DataFrame, network: DataFrame) -> DataFrame:
    """G-3: every node that drains to a start, the starts included.

    Walks down from all nodes at once: a node is kept when a start lies within 2^k
    steps below it, so the rounds grow with the logarithm of the longest river.
    """
    start_ids = starts.select("river_id").distinct()
    hit = reliable_checkpoint(start_ids.join(network.select("river_id"), "river_id", "left_semi"))
    for jumps in _jumps(network):
        above = jumps.join(hit.select(F.col("river_id").alias("b")), "b", "left_semi").select(
            F.col("a").alias("river_id"))
        hit = reliable_checkpoint(hit.unionByName(above).distinct())
    return hit


def outflows(network: DataFrame) -> DataFrame:
    """Edges whose downstream node is in the table."""
    known = network.select(F.col("river_id").alias("next_down"))
    return network.filter("next_down <> 0").join(known, "next_down", "left_semi")


def affected_downstream(sources: DataFrame, network: DataFrame) -> DataFrame:
    """G-11: (river_id, step) for nodes below a source, with the steps to the nearest one.

    A source counts if it lies below a source; on a cycle it lies below itself. One
    number per node is carried, however many sources lie above it.
    """
    near = reliable_checkpoint(network.select("river_id").join(sources.select("river_id").distinct(), "river_id", "left_semi")
                               .withColumn("step", F.lit(0).cast("long")))
    for k, jumps in enumerate(_jumps(network)):
        ahead = near.join(jumps, near.river_id == jumps.a).select(F.col("b").alias("river_id"), (F.col("step") + 2**k).alias("step"))
        near = reliable_checkpoint(near.unionByName(ahead).groupBy("river_id").agg(F.min("step").alias("step")))
    below = near.join(outflows(network), "river_id").groupBy(F.col("next_down").alias("river_id"))
    return below.agg((F.min("step") + 1).cast("int").alias("step"))


def topological_level(network: DataFrame) -> DataFrame:
    """G-5: longest number of steps from a head node; NULL for nodes on a cycle.

    The longest path of under 2^(k+1) steps into a node is one of under 2^k steps, or 2^k
    steps from a node with such a path: one number per node in every round.
    """
    best = reliable_checkpoint(network.select("river_id").distinct().withColumn("level", F.lit(0).cast("long")))
    for k, jumps in enumerate(_jumps(network)):
        ahead = best.join(jumps, best.river_id == jumps.a).select(F.col("b").alias("river_id"), (F.col("level") + 2**k).alias("level"))
        best = reliable_checkpoint(best.unionByName(ahead).groupBy("river_id").agg(F.max("level").alias("level")))
    looping = resolve_pointers(_as_edges(network)).filter("open").select(F.col("end").alias("river_id")).distinct()
    marked = network.select("river_id").join(best, "river_id", "left").join(
        looping.withColumn("on_cycle", F.lit(True)), "river_id", "left")
    return marked.select(
        "river_id", F.when(F.col("on_cycle").isNull(), F.col("level").cast("int")).alias("level"),
        F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


def contract_excluded(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """G-7: drop nodes and reconnect each kept node to the next kept one, travel times summed.

    ``edges``: up, down, tau_h. ``kept``: node. Parallel edges keep the least time.
    """
    pointers = edges.groupBy("up").agg(F.min_by(F.struct("down", "tau_h"), F.struct("down", "tau_h")).alias("e"))
    pointers = pointers.select(F.col("up").alias("node"), F.col("e.down").alias("next"), F.col("e.tau_h").alias("w"))
    ends = edges.select(F.col("down").alias("node")).distinct().join(pointers.select("node"), "node", "left_anti")
    every = pointers.unionByName(ends.select("node", F.lit(None).cast(pointers.schema["next"].dataType).alias("next"),
                                             F.lit(0).alias("w")))
    resolved = resolve_pointers(every, kept)
    return (resolved.filter(F.col("end").isNotNull() & ~F.col("open") & (F.col("end") != F.col("node")))
            .join(kept, "node", "left_semi").groupBy(F.col("node").alias("up"), F.col("end").alias("down"))
            .agg(F.min("total").cast("int").alias("tau_h")))


#: Salts of the rows of a hub in the join that gives each edge the minimum of its node, when there are too many nodes to
#: broadcast. A hub has over 1 / HUB_SHARE of the rows, so there are fewer than HUB_SHARE of them.
HUB_SALTS, HUB_SHARE = 64, 1000


def _with_minimum(rows: DataFrame, least: DataFrame, n_rows: int) -> DataFrame:
    """Join the minimum ``m`` of ``u`` (``least``: u, m, n rows) to every row. The rows of a hub are spread over salts, all others are not copied."""
    if n_rows <= BROADCAST_ROWS:
        return rows.join(F.broadcast(least.drop("n")), "u")
    hubs = F.broadcast(least.filter(F.col("n") * HUB_SHARE > n_rows).select("u", F.lit(True).alias("__hub")))
    salted = rows.join(hubs, "u", "left").withColumn(
        "__s", F.when(F.col("__hub"), F.pmod(F.xxhash64("v"), F.lit(HUB_SALTS)).cast("int")).otherwise(0)).drop("__hub")
    return salted.join(_salt_copies(least, n_rows), ["u", "__s"]).drop("__s")


def _salt_copies(least: DataFrame, n_rows: int) -> DataFrame:
    last = F.when(F.col("n") * HUB_SHARE > n_rows, HUB_SALTS - 1).otherwise(0)
    return least.select("u", "m", F.explode(F.sequence(F.lit(0), last)).alias("__s"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """G-4: (node, component) with the least node id of each component.

    Alternates two star steps (neighbours move to the least neighbour); both are a
    minimum with map-side combine and a broadcast or salted join back, so a hub with a
    third of all edges is never gathered. Ends when the edge set stops changing; the
    rounds grow with the logarithm of the longest path.
    """
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v")
    stars = reliable_checkpoint(
        pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = (stars.count(), None)
    for _ in range(max_rounds):
        both = stars.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _with_minimum(both, least, 2 * seen[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _with_minimum(large, least, 2 * seen[0]).select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        stars = reliable_checkpoint(small.filter("u <> v").distinct())
        digest = tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if digest == seen:
            break
        seen = digest
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    return nodes.join(stars.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))


def reach_paint(walks: DataFrame, effects: DataFrame) -> DataFrame:
    """G-9, A-11: every controlled reach takes the effect of largest size among its dams."""
    painted = walks.join(effects.filter(F.col("eff").isNotNull()), "dam")
    return painted.groupBy("river_id").agg(
        F.max_by("eff", F.struct(F.abs("eff"), -F.col("dam"))).alias("eff"))


def cascade_inflow(flow: DataFrame, edges: DataFrame, first_year: int, last_year: int,
                   keys: Sequence[str] = ()) -> DataFrame:
    """G-10: inflow of stations below others.

    ``flow``: keys, station, year, hoy, q_nat, q_out. ``edges``: up, down, tau_h.
    Lateral flow is the natural flow less the delayed upstream natural flow, not
    below 0; the delayed upstream releases are added. The raw lateral is kept.
    """
    from headrace.operators.series import lagged_value

    routed = flow.join(edges.withColumnRenamed("up", "station"), "station")
    moved = routed.withColumn("v", F.struct("q_nat", "q_out"))
    arrived = lagged_value(moved, [*keys, "down"], "tau_h", first_year, last_year, value="v")
    upstream = arrived.groupBy(*keys, F.col("down").alias("station"), "year", "hoy").agg(
        F.sum("v.q_nat").alias("up_nat"), F.sum("v.q_out").alias("up_out"))
    at = flow.join(upstream, [*keys, "station", "year", "hoy"], "left")
    lateral = F.col("q_nat") - F.coalesce("up_nat", F.lit(0.0))
    inflow = F.greatest(lateral, F.lit(0.0)) + F.coalesce("up_out", F.lit(0.0))
    return at.select(*keys, "station", "year", "hoy", "q_nat", lateral.alias("lateral"),
                     F.when(F.col("q_nat").isNotNull(), inflow).alias("q_in"))


def lateral_diagnostics(inflow: DataFrame, keys: Sequence[str] = ("station",)) -> DataFrame:
    """G-10: share of hours with negative lateral flow and their mean deficit."""
    negative = F.when(F.col("lateral") < 0, F.col("lateral"))
    return inflow.groupBy(*keys).agg(
        (F.try_divide(F.count(negative), F.count("lateral")) * 100).alias("negative_pct"),
        F.avg(negative).alias("mean_deficit"))
