"""Route sets by search kernels, time-dependent search, user choice models and the equilibrium loop.

Kernels run per origin or pair over Arrow batches, with one city's network broadcast as arrays; the pairs are what grows.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viatica.functions.lineage import kept


class Net:
    """Out-links by node."""

    def __init__(self, table: pd.DataFrame):
        self.out: dict[int, list[tuple[int, int]]] = {}
        self.cost: dict[int, float] = {}
        self.bias: dict[int, float] = dict(zip(table["link"].tolist(), table["bias"].tolist(), strict=True)) if "bias" in table else {}
        for link, a, b, c in zip(table["link"], table["from_node"], table["to_node"], table["cost"], strict=True):
            self.out.setdefault(int(a), []).append((int(link), int(b)))
            self.cost[int(link)] = float(c)

    def search(self, origin: int, destination: int, cost: Callable[[int, float], float], start: float = 0.0) -> tuple[float, list[int]] | None:
        """Least arrival and its links; cost(link, at) is a link's cost if it is entered at that value. Ties: fewer links, then lower link."""
        heap = [(start, 0, -1, origin, -1)]
        came: dict[int, tuple[int, int]] = {}
        while heap:
            at, n, link, node, before = heapq.heappop(heap)
            if node in came:
                continue
            came[node] = (before, link)
            if node == destination:
                path = []
                while came[node][1] >= 0:
                    path.append(came[node][1])
                    node = came[node][0]
                return at, path[::-1]
            for out, to in self.out.get(node, ()):
                if to not in came:
                    heapq.heappush(heap, (at + cost(out, at), n + 1, out, to, node))
        return None


def _draw(*key: object) -> float:
    """A draw in (0, 1) addressed by its key."""
    return (int.from_bytes(hashlib.md5(":".join(map(str, key)).encode()).digest()[:6], "big") + 0.5) / (1 << 48)


def by_penalty(net: Net, o: int, d: int, most: int = 5, detour: float = 1.3, overlap: float = 0.75, factor: float = 1.5, attempts: int = 15) -> list[tuple[float, list[int]]]:
    """Searches again and again, each time with the links of the route just found made dearer; keeps what is neither too long nor too alike."""
    raised: dict[int, float] = {}
    found: list[tuple[float, list[int]]] = []
    for _ in range(attempts):
        hit = net.search(o, d, lambda link, _at: net.cost[link] * raised.get(link, 1.0))
        if hit is None:
            break
        links = hit[1]
        true = sum(net.cost[x] for x in links)
        alike = max((sum(net.cost[x] for x in set(links) & set(other)) / max(true, 1e-9) for _, other in found), default=0.0)
        if not found or true <= detour * found[0][0] and alike <= overlap:
            found.append((true, links))
        for x in links:
            raised[x] = raised.get(x, 1.0) * factor
        if len(found) == most:
            break
    return sorted(found, key=lambda r: (r[0], len(r[1]), r[1]))


def by_draws(net: Net, o: int, d: int, draws: int = 16, sigma: float = 4.0, detour: float = 2.0, overlap: float = 0.9, most: int = 10, seed: int = 0) -> list[tuple[float, list[int]]]:
    """Shortest routes when links' costs are raised by up to sigma times themselves, by a seeded draw times the link's bias (0 to 1, its propensity to congest; 1 if the network has none).

    The shortest route comes first. A route stays if it is new, costs no more than `detour` times the best and shares no more than `overlap` of its cost with any that stayed before it.
    """
    best = net.search(o, d, lambda link, _at: net.cost[link])
    if best is None:
        return []
    found = [(sum(net.cost[x] for x in best[1]), best[1])]
    for n in range(draws):
        if len(found) >= most:
            break
        raised: dict[int, float] = {}

        def cost(link: int, _at: float, raised: dict[int, float] = raised, n: int = n) -> float:
            if link not in raised:
                raised[link] = net.cost[link] * (1 + sigma * _draw(seed, o, d, n, link) * net.bias.get(link, 0.0 if net.bias else 1.0))
            return raised[link]

        links = (net.search(o, d, cost) or best)[1]
        true = sum(net.cost[x] for x in links)
        alike = max(sum(net.cost[x] for x in set(links) & set(other)) / max(true, 1e-9) for _, other in found)
        if true <= detour * found[0][0] and alike <= overlap and all(links != other for _, other in found):
            found.append((true, links))
    return sorted(found, key=lambda r: (r[0], len(r[1]), r[1]))


METHODS = {"link_penalty": by_penalty, "simulation": by_draws, "shortest": lambda net, o, d, **_: [x for x in [net.search(o, d, lambda link, _at: net.cost[link])] if x]}


#: A network of at most so many links is searched in memory and broadcast (some 100 MB); a larger one is searched by joins.
MOST_LINKS = 2_000_000


def small_network(links: DataFrame, *columns, most: int = MOST_LINKS) -> pd.DataFrame | None:
    """These columns of the links, if there are few enough to broadcast."""
    return links.select(*columns).toPandas() if links.limit(most + 1).count() <= most else None


def route_sets(links: DataFrame, pairs: DataFrame, cost: str, method: str = "link_penalty", bias: DataFrame | None = None, **options) -> DataFrame:
    """(origin, destination, route, cost, links) by one of METHODS, routes numbered from the best. bias: (link, propensity), for `simulation`.

    Search kernels need the network in memory; one beyond MOST_LINKS is refused, but for `shortest`, which has `network.shortest_routes`.
    """
    build = METHODS[method]
    rows, columns = links, ["link", "from_node", "to_node", F.col(cost).cast("double").alias("cost")]
    if bias is not None:
        rows = links.join(bias, "link", "left")
        columns.append(F.coalesce("propensity", F.lit(0.0)).alias("bias"))
    table = small_network(rows, *columns)
    if table is None:
        raise ValueError(f"the network has more than {MOST_LINKS} links: build route sets by region, or use shortest_routes")
    shared = links.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = Net(shared.value)
        for rows in batches:
            out = [(o, d, n, c, path) for o, d in zip(rows["origin"], rows["destination"], strict=True) for n, (c, path) in enumerate(build(net, int(o), int(d), **options))]
            yield pd.DataFrame(out, columns=["origin", "destination", "route", "cost", "links"])

    return pairs.select("origin", "destination").distinct().repartition("origin").mapInPandas(run, "origin long, destination long, route long, cost double, links array<long>")


def fastest_at(links: DataFrame, times: DataFrame, asks: DataFrame, width: int, most_bins: int = 50_000_000) -> DataFrame:
    """(ask, arrive_s, links): the fastest route of asks (ask, origin, destination, depart_s) with link times by bin of entry; free flow where a bin has none.

    Times are broadcast as one matrix of links and bins, of at most `most_bins` numbers; a larger network or day is refused.
    """
    spark = links.sparkSession
    table = small_network(links, "link", "from_node", "to_node", F.col("free_s").cast("double").alias("cost"))
    span = times.agg(F.min("bin"), F.max("bin")).first()
    first, last = (int(x) if x is not None else 0 for x in span)
    if table is None or len(table) * (last - first + 1) > most_bins:
        raise ValueError("the network's link times are too many to broadcast: search it by region or by part of the day")
    place = {int(x): n for n, x in enumerate(table["link"])}
    matrix = np.repeat(table["cost"].to_numpy(np.float64)[:, None], last - first + 1, 1)
    known = times.select("link", "bin", F.col("seconds").cast("double").alias("seconds")).toPandas()
    known = known[known["link"].isin(place.keys())]
    matrix[known["link"].map(place).to_numpy(np.int64), known["bin"].to_numpy(np.int64) - first] = known["seconds"].to_numpy()
    shared = spark.sparkContext.broadcast((table, place, matrix, first))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, row, at_bin, start = shared.value
        net, bins = Net(own), at_bin.shape[1]

        def seconds(link: int, at: float) -> float:
            n = int(at // width) - start
            return float(at_bin[row[link], n]) if 0 <= n < bins else net.cost[link]

        for rows in batches:
            out = []
            for r in rows.itertuples():
                hit = net.search(int(r.origin), int(r.destination), seconds, float(r.depart_s))
                if hit:
                    out.append((r.ask, hit[0], hit[1]))
            yield pd.DataFrame(out, columns=["ask", "arrive_s", "links"])

    return asks.select("ask", "origin", "destination", "depart_s").mapInPandas(run, "ask long, arrive_s double, links array<long>")


def choose_with(alternatives: DataFrame, model: Callable[[pd.DataFrame], pd.Series], most: int = 32_768) -> DataFrame:
    """A user's model over whole situations: model gets a frame of up to `most` situations sorted by situation and alternative, and returns which rows are chosen."""

    def picked(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        return rows.loc[model(rows).astype(bool).to_numpy(), ["situation", "alternative"]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        count = 0
        for frame in frames:
            held.append(frame)
            count += frame["situation"].nunique()
            if count > most:  # the last situation may go on in the next frame
                rows = pd.concat(held, ignore_index=True)
                new = rows["situation"].ne(rows["situation"].shift()).cumsum()
                for start in range(1, int(new.iloc[-1]), most):
                    yield picked(rows[(new >= start) & (new < min(start + most, int(new.iloc[-1])))])
                held, count = [rows[new == new.iloc[-1]]], 1
        if held:
            yield picked(pd.concat(held, ignore_index=True))

    return alternatives.repartition("situation").sortWithinPartitions("situation", "alternative").mapInPandas(run, "situation long, alternative long")


def equilibrium(routes: DataFrame, links: DataFrame, people: DataFrame, turns: int, beta: float, tolerance: float = 0.0) -> tuple[DataFrame, list[tuple[int, float]]]:
    """Logit shares over route sets and BPR times, averaged by 1 / (turn + 1): link flows, and the gap of each turn.

    Each turn is tables in, tables out: route costs from link seconds, probabilities, flows, new seconds; its state is cut.
    """
    state = kept(links.select("link", "free_s", "capacity", F.lit(0.0).alias("flow"), F.col("free_s").cast("double").alias("seconds")))
    own = routes.select("pair", "route", "link").distinct()
    gaps = []
    for i in range(turns):
        costs = own.join(state.select("link", "seconds"), "link").groupBy("pair", "route").agg(F.round(F.sum("seconds"), 6).alias("cost"))
        w = Window.partitionBy("pair")
        e = F.exp(beta * (F.col("cost") - F.min("cost").over(w)))
        rows = costs.withColumns({"e": e, "least": F.min("cost").over(w)})
        rows = kept(rows.withColumn("p", F.col("e") / F.sum("e").over(w)).join(people, "pair").select("pair", "route", "cost", "least", F.round(F.col("p") * F.col("people"), 6).alias("flow")))
        new = own.join(rows.select("pair", "route", F.col("flow").alias("f")), ["pair", "route"]).groupBy("link").agg(F.sum("f").alias("new"))
        flow = F.round(F.col("flow") + (F.coalesce("new", F.lit(0.0)) - F.col("flow")) / (i + 1), 6)
        state = state.join(new, "link", "left").withColumn("flow", flow).drop("new")
        state = kept(state.withColumn("seconds", F.round(F.col("free_s") * (1 + 0.15 * F.pow(F.col("flow") / F.col("capacity"), F.lit(4.0))), 6)))
        gap = rows.agg((F.sum(F.col("flow") * (F.col("cost") - F.col("least"))) / F.sum(F.col("flow") * F.col("least"))).alias("g")).first()["g"]
        gaps.append((i, float(gap or 0.0)))
        if gap is not None and i >= 3 and sum(g for _, g in gaps[-3:]) / 3 < tolerance:
            break
    return state.select("link", "flow", "seconds"), gaps
