"""Query-aware flow diffusion in synchronous rounds, all seeds in one loop.

Where a seed's mass fits into the sinks it reaches, the order of pushes doesn't change the result,
so pushing all active nodes at once is a correct parallel form. Where it doesn't fit, rounds are
capped and the seed is reported as not converged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.graph import by_end, cut, few, written

#: What gives all edges (u, v, w) of nodes (node).
Near = Callable[[DataFrame], DataFrame]

#: Rounds whose plans are kept one in another, each read twice by the next, before the state is cut.
CUT = 3


def edge_weight(w: Column, s_u: Column, s_v: Column, kind: str = "original") -> Column:
    """Weight of an edge whose ends are s_u and s_v like the query. Not positive: 0."""
    made = {"multiply": w * s_u * s_v, "add": (w + s_u + s_v) / 3}.get(kind, w * (1 + 0.5 * (s_u + s_v) / 2))
    return F.when(w <= 0, F.lit(0.0)).otherwise(made)


def weighted(projection: DataFrame, similarity: DataFrame, kind: str = "original") -> DataFrame:
    """projection (u, v, w) with w by similarity (node, s); a node without one is unlike (0)."""
    a, b = similarity.select(F.col("node").alias("u"), F.col("s").alias("su")), similarity.select(F.col("node").alias("v"), F.col("s").alias("sv"))
    wide = projection.join(a, "u", "left").join(b, "v", "left")
    return wide.select("u", "v", edge_weight(F.col("w"), F.coalesce("su", F.lit(0.0)), F.coalesce("sv", F.lit(0.0)), kind).alias("w"))


def start(adj: DataFrame, seeds: DataFrame, alpha: float, confidence: float, dealt: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(moves, sinks, state): sinks are degrees, a seed's mass is alpha * sink * (1 + confidence). Moves and
    sinks are dealt by node once; a round brings what is active to them."""
    moves = adj if dealt else by_end(adj.select("u", "v", "w"))
    sinks = by_end(sums(moves), "node")
    return moves, sinks, cut(loaded(seeds, sinks, alpha, confidence))


def sums(moves: DataFrame) -> DataFrame:
    """(node, sink, total): a node's degree and its edges' weight."""
    return moves.groupBy(F.col("u").alias("node")).agg(F.count("*").cast("double").alias("sink"), F.sum("w").alias("total"))


def loaded(seeds: DataFrame, sinks: DataFrame, alpha: float, confidence: float) -> DataFrame:
    """The first state: all mass on the seeds."""
    return seeds.join(sinks, F.col("seed") == F.col("node")).select("seed", "node", (F.lit(alpha * (1 + confidence)) * F.col("sink")).alias("m"), F.lit(0.0).alias("x"), "sink", "total")


def push_round(moves: DataFrame, sinks: DataFrame, state: DataFrame, dealt: bool = True) -> DataFrame:
    """All nodes above their sink send the excess to their neighbours by weight share: one join of the
    active nodes, one sum of what stays and what is sent, and the sinks of the nodes reached. Moves, which
    lie by node (dealt), stream past the active nodes and aren't dealt or sorted; moves that don't lie so
    stream past them too, as long as those are few."""
    active = (F.col("m") > F.col("sink")) & (F.col("total") > 0)
    over = F.col("m") - F.col("sink")
    stays = state.select("seed", "node", F.when(active, F.col("sink")).otherwise(F.col("m")).alias("m"), (F.col("x") + F.when(active, over / F.col("total")).otherwise(0.0)).alias("x"))
    sends = state.filter(active).select("seed", F.col("node").alias("u"), over.alias("e"), "total")
    sent = moves.join(sends.hint("shuffle_hash") if dealt else few(sends), "u").select("seed", F.col("v").alias("node"), (F.col("e") * (F.col("w") / F.col("total"))).alias("m"), F.lit(0.0).alias("x"))
    now = stays.union(sent).groupBy("seed", "node").agg(F.sum("m").alias("m"), F.sum("x").alias("x"))
    return now.join(sinks.hint("merge"), "node", "left").select("seed", "node", "m", "x", "sink", "total")


def excess(state: DataFrame) -> Column:
    return F.greatest(F.lit(0.0), state["m"] - state["sink"])


def diffuse(adj: DataFrame, seeds: DataFrame, alpha: float = 50.0, confidence: float = 0.7, rounds: int = 100, tolerance: float = 0.05, check_every: int = 5, dealt: bool = False) -> DataFrame:
    """(seed, node, m, x): mass left and flow through each node that mass reached.

    adj: symmetric (u, v, w); dealt says that graph.by_end made it. Stops once the excess over all seeds is below tolerance, else after
    `rounds`. converged tells which seeds hold no excess above tolerance. Rounds are kept in memory,
    where a lost executor's part is computed again, and cut in the shared folder at each check.
    """
    moves, sinks, state = start(adj, seeds, alpha, confidence, dealt)
    held: list[DataFrame] = []
    for k in range(1, rounds + 1):
        state = push_round(moves, sinks, state)
        if k % check_every and k % CUT and k < rounds:
            held.append(state.persist())
            continue
        state = cut(state)
        for old in held:
            old.unpersist()
        held = []
        if k % check_every == 0 and k < rounds and (state.agg(F.sum(excess(state))).head()[0] or 0.0) < tolerance:
            break
    return told(state, tolerance)


def told(state: DataFrame, tolerance: float) -> DataFrame:
    """(seed, node, m, x, converged)."""
    left = state.groupBy("seed").agg((F.sum(excess(state)) < tolerance).alias("converged"))
    return state.join(left, "seed").select("seed", "node", "m", "x", "converged")


def diffuse_near(near: Near, seeds: DataFrame, alpha: float = 50.0, confidence: float = 0.7, rounds: int = 100, tolerance: float = 0.05, check_every: int = 5) -> DataFrame:
    """What diffuse returns, on a graph whose edges are made where mass arrives.

    Every active node holds its sink back, so mass bounds how many nodes are reached, and what a round
    deals doesn't grow with the graph. A node's edges are made once, when mass first reaches it.
    """
    moves = written(near(cut(seeds.select(F.col("seed").alias("node")).distinct())), "moves")
    sinks = cut(sums(moves))
    state = cut(loaded(seeds, sinks, alpha, confidence))
    for k in range(1, rounds + 1):
        state = cut(push_round(moves, sinks, state, dealt=False))
        fresh = cut(state.filter("sink is null").select("node").distinct())
        if not fresh.isEmpty():
            made = written(near(fresh), "moves")
            moves, sinks = moves.union(made), sinks.union(cut(sums(made)))
            state = cut(state.select("seed", "node", "m", "x").join(sinks, "node", "left").select("seed", "node", "m", "x", "sink", "total"))
        if k % check_every == 0 and k < rounds and (state.agg(F.sum(excess(state))).head()[0] or 0.0) < tolerance:
            break
    return told(state, tolerance)


def clusters(flow: DataFrame, min_flow: float = 0.1) -> DataFrame:
    """(seed, size, max_flow): supports of more than one node with enough flow."""
    kept = flow.filter("x > 0").groupBy("seed").agg(F.count("*").alias("size"), F.max("x").alias("max_flow"))
    return kept.filter((F.col("size") > 1) & (F.col("max_flow") >= min_flow))


def path_score(confidence: Column, mean_flow: Column, nodes: Column) -> Column:
    return F.when(nodes < 2, F.lit(0.0)).otherwise(0.7 * confidence + 0.3 * mean_flow / (mean_flow + 1))
