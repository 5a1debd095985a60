"""Searches over links that respect turns: one to many, with equal-cost twins, in time, by generalised cost, and on after a link.

A search's states are links, so a turn that the turn table lacks is not taken and going back is possible only at a dead end. It runs per origin (or ask) over Arrow
batches, on a network that is broadcast behind a check of its size. Of equal costs the shorter in millimetres wins, then the one of fewer links, then the
one whose nodes, read back from its end, have the lesser coordinates, then the lesser links.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viatica.operators.network import turns
from viatica.operators.routing import small_network


class TurnNet:
    """Links with the links that may follow each. Columns link, from_node, to_node, cost, mm (length), x, y (of to_node); turns (in_link, out_link)."""

    def __init__(self, links: pd.DataFrame, allowed: pd.DataFrame):
        self.cost = dict(zip(links["link"].tolist(), links["cost"].tolist(), strict=True))
        self.ends = {int(k): (int(a), int(b)) for k, a, b in zip(links["link"], links["from_node"], links["to_node"], strict=True)}
        self.mm = dict(zip(links["link"].tolist(), links["mm"].tolist(), strict=True))
        self.place = dict(zip(links["to_node"].tolist(), zip(links["x"].tolist(), links["y"].tolist(), strict=True), strict=True))
        self.next: dict[int, list[int]] = {}
        for i, o in zip(allowed["in_link"].tolist(), allowed["out_link"].tolist(), strict=True):
            self.next.setdefault(i, []).append(o)
        self.out: dict[int, list[int]] = {}
        for k, (a, _) in self.ends.items():
            self.out.setdefault(a, []).append(k)

    def order(self, route: tuple[int, ...]) -> tuple:
        """What decides between routes of one cost."""
        return (sum(self.mm[x] for x in route), len(route), tuple(self.place.get(self.ends[x][1], (0, 0)) for x in reversed(route)), tuple(reversed(route)))

    def grow(self, starts: list[int], at: float, seconds: Callable[[int, float], float], extra: Callable[[int], float] | None = None, wanted: set[int] | None = None, bound: float = float("inf")) -> dict[int, tuple]:
        """From entering any of `starts` at `at`: for each node reached (cost, clock, route), the least cost, seconds(link, clock) plus extra(link) a link."""
        add = extra or (lambda _: 0.0)
        heap = []
        for k in starts:
            t = seconds(k, at)
            heapq.heappush(heap, (t + add(k), self.order((k,)), at + t, (k,)))
        closed: set[int] = set()
        nodes: dict[int, tuple] = {}
        left = set(wanted) if wanted is not None else None
        while heap and (left is None or left):
            cost, _, clock, route = heapq.heappop(heap)
            last = route[-1]
            if last in closed or cost > bound:
                continue
            closed.add(last)
            node = self.ends[last][1]
            if node not in nodes:
                nodes[node] = (cost, clock, route)
                if left is not None:
                    left.discard(node)
            for k in self.next.get(last, ()):
                if k not in closed:
                    t = seconds(k, clock)
                    longer = (*route, k)
                    heapq.heappush(heap, (cost + t + add(k), self.order(longer), clock + t, longer))
        return nodes

    def twins(self, origin: int, destination: int, best: tuple, tolerance: float, most: int) -> list[tuple[float, tuple[int, ...]]]:
        """Other routes at most `tolerance` dearer that part from the best one once and come back to it once, and repeat no node; those that part first come first."""
        cost, _, route = best
        found = []
        for cut in range(len(route), 0, -1):
            rest, into = route[cut:], route[cut - 1]
            node = self.ends[into][1]
            for k, (_, b) in self.ends.items():
                if b != node or k == into or (rest and rest[0] not in self.next.get(k, ())):
                    continue
                before = self._to_link(origin, k)
                if before is None:
                    continue
                whole = (*before, *rest)
                nodes = [origin, *[self.ends[x][1] for x in whole]]
                dear = sum(self.cost[x] for x in whole)
                if dear <= cost + tolerance and len(set(nodes)) == len(nodes) and whole != route:
                    parts = next(i for i, (a, b_) in enumerate(zip(whole, route, strict=False)) if a != b_)
                    found.append((parts, dear, self.order(whole), whole))
        out: list[tuple[float, tuple[int, ...]]] = []
        for _, dear, _, whole in sorted(set(found)):
            if whole not in [w for _, w in out] and len(out) < most:
                out.append((dear, whole))
        return out

    def _to_link(self, origin: int, link: int) -> tuple[int, ...] | None:
        """The cheapest route from origin that ends with a link."""
        heap = [(self.cost[k], self.order((k,)), (k,)) for k in self.out.get(origin, ())]
        heapq.heapify(heap)
        closed: set[int] = set()
        while heap:
            cost, _, route = heapq.heappop(heap)
            if route[-1] == link:
                return route
            if route[-1] in closed:
                continue
            closed.add(route[-1])
            for k in self.next.get(route[-1], ()):
                if k not in closed:
                    heapq.heappush(heap, (cost + self.cost[k], self.order((*route, k)), (*route, k)))
        return None


def _shared(links: DataFrame, cost: str, nodes: DataFrame | None, allowed: DataFrame | None):
    """The network, broadcast: links with costs, lengths in millimetres and their end's coordinates in millimetres, and turns."""
    rows = links if nodes is None else links.join(nodes.select(F.col("node").alias("to_node"), "x", "y"), "to_node", "left")
    x, y = (F.lit(0), F.lit(0)) if nodes is None else ("x", "y")
    mm = lambda c: F.round((F.col(c) if isinstance(c, str) else c) * 1000).cast("long")
    table = small_network(rows, "link", "from_node", "to_node", F.col(cost).cast("double").alias("cost"), mm("length_m").alias("mm"), F.coalesce(mm(x), F.lit(0)).alias("x"), F.coalesce(mm(y), F.lit(0)).alias("y"))
    ways = small_network(allowed if allowed is not None else turns(links), "in_link", "out_link", most=20_000_000)
    if table is None or ways is None:
        raise ValueError("the network is too large to broadcast: search it by region, or by network.relaxed_routes where turns do not matter")
    return links.sparkSession.sparkContext.broadcast((table, ways))


ROUTE = "origin long, destination long, cost double, seconds double, links array<long>"


def one_to_many(links: DataFrame, pairs: DataFrame, cost: str, nodes: DataFrame | None = None, allowed: DataFrame | None = None, bound: float = float("inf")) -> DataFrame:
    """(origin, destination, cost, seconds, links) of pairs, one tree an origin, up to a bound; a node has no route to itself."""
    shared = _shared(links, cost, nodes, allowed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = TurnNet(*shared.value)
        for rows in batches:
            out = []
            for origin, ends in rows.groupby("origin")["destination"]:
                found = net.grow(net.out.get(int(origin), []), 0.0, lambda k, _: net.cost[k], wanted={int(d) for d in ends if d != origin}, bound=bound)
                out += [(int(origin), int(d), found[d][0], found[d][1], list(found[d][2])) for d in sorted(set(ends)) if d in found and d != origin]
            yield pd.DataFrame(out, columns=["origin", "destination", "cost", "seconds", "links"])

    return pairs.select("origin", "destination").distinct().repartition("origin").sortWithinPartitions("origin").mapInPandas(run, ROUTE)


def with_twins(links: DataFrame, pairs: DataFrame, cost: str, tolerance: float, most: int, nodes: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(origin, destination, route, cost, links): the best route and its twins, numbered."""
    shared = _shared(links, cost, nodes, allowed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = TurnNet(*shared.value)
        for rows in batches:
            out = []
            for origin, ends in rows.groupby("origin")["destination"]:
                found = net.grow(net.out.get(int(origin), []), 0.0, lambda k, _: net.cost[k], wanted={int(d) for d in ends if d != origin})
                for d in sorted(set(ends)):
                    if d in found and d != origin:
                        routes = [(found[d][0], found[d][2]), *net.twins(int(origin), int(d), found[d], tolerance, most)]
                        out += [(int(origin), int(d), n, c, list(r)) for n, (c, r) in enumerate(routes)]
            yield pd.DataFrame(out, columns=["origin", "destination", "route", "cost", "links"])

    return pairs.select("origin", "destination").distinct().repartition("origin").sortWithinPartitions("origin").mapInPandas(run, "origin long, destination long, route long, cost double, links array<long>")


class _Times:
    """Seconds of links by bin of entry, free flow outside."""

    def __init__(self, free: dict[int, float], rows: pd.DataFrame, width: int):
        self.width, self.free = width, free
        self.first = int(rows["bin"].min()) if len(rows) else 0
        self.bins = int(rows["bin"].max()) - self.first + 1 if len(rows) else 0
        self.row = {k: n for n, k in enumerate(free)}
        self.table = np.repeat(np.array(list(free.values()), float)[:, None], max(1, self.bins), 1)
        if len(rows):
            rows = rows[rows["link"].isin(self.row.keys())]
            self.table[rows["link"].map(self.row).to_numpy(int), rows["bin"].to_numpy(int) - self.first] = rows["seconds"].to_numpy(float)

    def __call__(self, link: int, at: float) -> float:
        n = int(at // self.width) - self.first
        return float(self.table[self.row[link], n]) if 0 <= n < self.bins else self.free[link]


def in_time(links: DataFrame, times: DataFrame, asks: DataFrame, cost: str, width: int, extra: str | None = None, nodes: DataFrame | None = None, allowed: DataFrame | None = None, most_bins: int = 50_000_000) -> DataFrame:
    """(ask, destination, cost, arrive_s, links) of asks (ask, origin, depart_s, destinations array, after: a link just left, or null), by link times of the bin of entry.

    The cost is seconds, plus a static extra a link in seconds if one is named: then the route is of least generalised cost. An ask after a link starts with the
    turns out of it. One search an ask serves all its destinations.
    """
    rows = links if extra is None else links.withColumn("_extra", F.col(extra).cast("double"))
    shared = _shared(rows, cost, nodes, allowed)
    extras = small_network(rows, "link", "_extra") if extra else None
    known = times.select("link", "bin", F.col("seconds").cast("double").alias("seconds"))
    if known.count() > most_bins:
        raise ValueError("the link times are too many to broadcast: search by region or by part of the day")
    table = links.sparkSession.sparkContext.broadcast((known.toPandas(), None if extras is None else dict(zip(extras["link"].tolist(), extras["_extra"].tolist(), strict=True))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = TurnNet(*shared.value)
        known_, add = table.value
        seconds = _Times(net.cost, known_, width)
        for own in batches:
            out = []
            for r in own.itertuples():
                after = None if pd.isna(r.after) else int(r.after)
                starts = net.out.get(int(r.origin), []) if after is None else net.next.get(after, [])
                wanted = {int(d) for d in r.destinations if d != r.origin}
                found = net.grow(starts, float(r.depart_s), seconds, None if add is None else add.__getitem__, wanted)
                out += [(r.ask, d, found[d][0], found[d][1], list(found[d][2])) for d in sorted(wanted) if d in found]
            yield pd.DataFrame(out, columns=["ask", "destination", "cost", "arrive_s", "links"])

    after = F.col("after") if "after" in asks.columns else F.lit(None)
    return asks.select("ask", "origin", F.col("depart_s").cast("double").alias("depart_s"), "destinations", after.cast("double").alias("after")).mapInPandas(run, "ask long, destination long, cost double, arrive_s double, links array<long>")
