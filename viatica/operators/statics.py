"""Static user equilibrium: strategies by name over all-or-nothing loads, BPR times, and the step of each, and the routes and shares that come of it.

Links' state is a table that is cut every turn; searches run per origin (`search.one_to_many`, turns respected). What the driver sees is a row of sums a turn, and in a line search
a row a probe.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viatica.functions.lineage import kept
from viatica.operators.search import one_to_many


def bpr_time(flow: Column, alpha: float = 0.15, beta: float = 4.0) -> Column:
    return F.col("free_s") * (1 + alpha * F.pow(flow / F.col("capacity"), F.lit(float(beta))))


@dataclass
class Report:
    turn: int
    step: float
    total: float
    shortest: float
    gap: float
    time_change: float | None


@dataclass
class Solution:
    links: DataFrame  # link, flow, seconds
    routes: DataFrame  # origin, destination, links, flow
    reports: list[Report] = field(default_factory=list)
    converged: bool = False


def msa(turn: int, offset: float = 0.0) -> float:
    """The share that moves in a turn, from the first move on."""
    return 1.0 / (turn + 2.0 + offset)


def line_search(state: DataFrame, rounds: int = 2, steps: int = 64) -> float:
    """The step from flow to target at which the cost to all (the sum of integrals of the links' times) is least: where its slope, a sum over links, changes its sign.

    The slope at `steps` even steps is one aggregate; where it turns is looked at again as finely, so the step is found to 1 / steps^rounds by as many jobs.
    """
    moving = kept(state.select("free_s", "capacity", "flow", (F.col("target") - F.col("flow")).alias("d")).filter("d <> 0"))
    low, high = 0.0, 1.0
    for _ in range(rounds):
        width = (high - low) / steps
        slopes = moving.agg(*[F.coalesce(F.sum(F.col("d") * bpr_time(F.col("flow") + (low + width * (i + 1)) * F.col("d"))), F.lit(0.0)) for i in range(steps)]).first()
        turns = next((i for i, x in enumerate(slopes) if x > 0), None)
        if turns is None:
            return high
        low, high = low + width * turns, low + width * (turns + 1)
    return (low + high) / 2


def _load(state: DataFrame, demand: DataFrame, allowed: DataFrame | None) -> DataFrame:
    routes = one_to_many(state, demand, "seconds", allowed=allowed)
    return kept(routes.join(demand, ["origin", "destination"]).select("origin", "destination", "cost", "links", "people"))


def _on_links(routes: DataFrame) -> DataFrame:
    return routes.select(F.explode("links").alias("link"), "people").groupBy("link").agg(F.sum("people").alias("target"))


def solve(links: DataFrame, demand: DataFrame, strategy: str = "frank_wolfe", turns: int = 20, tolerance: float = 0.0, increments: int = 5, offset: float = 0.0, fell: float = 0.2, rose: float = 1.5, allowed: DataFrame | None = None) -> Solution:
    """links (link, from_node, to_node, length_m, free_s, capacity), demand (origin, destination, people).

    `frank_wolfe`: the step that costs all least; `msa`: 1 / (turn + 2 + offset); `sra`: 1 / eta, eta being 2, then growing by `rose`, and then each turn by `fell` if the gap of the turn before was under the one before it, else by `rose`; `free_flow`: one
    loading in `increments` equal parts, each on the times of those before, and no more turns. The gap is how much longer than on shortest routes all travel; a turn whose gap is under
    the tolerance is the last.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy {strategy}: {', '.join(STRATEGIES)}")
    demand = kept(demand.filter("origin <> destination and people > 0").groupBy("origin", "destination").agg(F.sum("people").cast("double").alias("people")))
    state = kept(links.select("link", "from_node", "to_node", "length_m", "free_s", "capacity", F.lit(0.0).alias("flow"), F.col("free_s").cast("double").alias("seconds")))
    parts = increments if strategy == "free_flow" else 1
    routes = None
    for part in range(parts):
        found = _load(state, demand.withColumn("people", F.col("people") / parts), allowed)
        routes = _merged(routes, found, 1.0, keep=True)
        state = _moved(state, _on_links(found), lambda flow, target: flow + target)
    out, eta, last, before_last = Solution(state, routes), 2.0, None, None
    for turn in range(turns):
        found = _load(state, demand, allowed)
        sums = state.join(_on_links(found), "link", "left").agg(F.sum(F.col("flow") * F.col("seconds"))).first()[0] or 0.0
        shortest = found.agg(F.sum(F.col("cost") * F.col("people"))).first()[0] or 0.0
        gap = (sums - shortest) / shortest if shortest else 0.0
        if turn and strategy == "sra":  # as choice.self_regulated_steps: a turn makes the loading after the next, and knows the gaps before its own
            eta += fell if turn > 1 and last < before_last else rose
        report = Report(turn, 1.0, sums, shortest, gap, None)
        out.reports.append(report)
        last, before_last = gap, last
        if tolerance > 0 and gap < tolerance:
            out.converged = True
            break
        if strategy == "free_flow" or turn + 1 >= turns:
            break
        aimed = kept(state.join(_on_links(found), "link", "left").withColumn("target", F.coalesce("target", F.lit(0.0))))
        step = STRATEGIES[strategy](turn, eta, offset, aimed)
        before = state
        state = _moved(state, _on_links(found), lambda flow, target, s=step: flow + s * (target - flow))
        moved = state.join(before.select("link", F.col("seconds").alias("was")), "link").agg(F.sum(F.col("flow") * F.abs(F.col("seconds") - F.col("was"))) / F.sum(F.col("flow") * F.col("was"))).first()[0]
        report.step, report.time_change = step, moved
        routes = _merged(routes, found, step)
    out.links, out.routes = state.select("link", "flow", "seconds"), routes
    return out


STRATEGIES: dict[str, Callable[[int, float, float, DataFrame], float]] = {
    "frank_wolfe": lambda turn, eta, offset, aimed: line_search(aimed),
    "msa": lambda turn, eta, offset, aimed: msa(turn, offset),
    "sra": lambda turn, eta, offset, aimed: 1.0 / eta,
    "free_flow": lambda turn, eta, offset, aimed: 0.0,
}


def _moved(state: DataFrame, targets: DataFrame, new: Callable[[Column, Column], Column]) -> DataFrame:
    rows = state.join(targets, "link", "left").withColumn("flow", new(F.col("flow"), F.coalesce("target", F.lit(0.0)))).drop("target")
    return kept(rows.withColumn("seconds", bpr_time(F.col("flow"))))


def _merged(routes: DataFrame | None, found: DataFrame, step: float, keep: bool = False) -> DataFrame:
    """Route flows after a step to the routes found: those there keep 1 - step of theirs (all, with keep)."""
    new = found.select("origin", "destination", "links", (F.col("people") * step).alias("flow"))
    if routes is None:
        return new
    both = routes.withColumn("flow", F.col("flow") * (1.0 if keep else 1 - step)).unionByName(new)
    return kept(both.groupBy("origin", "destination", "links").agg(F.sum("flow").alias("flow")))


def route_shares(routes: DataFrame) -> DataFrame:
    """(origin, destination, route, share, links): routes in order of their flow, and its share of the pair's."""
    w = Window.partitionBy("origin", "destination")
    return routes.withColumns({"route": F.row_number().over(w.orderBy(F.desc("flow"), "links")) - 1, "share": F.col("flow") / F.sum("flow").over(w)}).select("origin", "destination", F.col("route").cast("long").alias("route"), "share", "links")
