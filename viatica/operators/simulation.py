"""Loading by events: vehicles move over links by free-flow time, discharge, storage and backward waves, one scenario a task.

Level 2 has queues without size. At level 3 a link holds no more than its storage, and what leaves it makes room at once; at level 4 room comes back one wave's lag later. A vehicle at the
front of its link goes on when it has travelled the link, the link's saturation headway since the last one has passed, the next link has room and its own headway since its last
entrant has passed. Of links that wait for one, the one that has waited longest goes first. Not in here: vehicles that straddle links, signals' delay beside their headway,
roundabouts, pockets and rerouting.

A link of a day is far smaller than a task's memory; days, scenarios and seeds are what grows, and they are dealt over the cluster. Of a scenario a task holds numbers in arrays, of no more vehicles than can
start before the end.
"""

from __future__ import annotations

import heapq
from array import array
from collections import deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viatica.functions.lineage import spread

MOVES = "scenario long, vehicle long, pos long, link long, enter_s double, exit_s double"


class Road:
    """One link: seconds at free flow, headway a pcu, storage, lag of the backward wave."""

    __slots__ = ("free", "headway", "storage", "lag", "queue", "last_out", "last_in", "held", "leaving", "waiting")

    def __init__(self, free: float, headway: float, storage: float, lag: float):
        self.free, self.headway, self.storage, self.lag = free, headway, storage, lag
        self.queue: deque = deque()  # (vehicle, when it has travelled the link), in order
        self.last_out = self.last_in = float("-inf")
        self.held = 0.0  # pcu on it, or left too recently to make room
        self.leaving: deque = deque()  # (when room comes back, pcu)
        self.waiting: list = []  # (since, who) to be told of room


def load(links: pd.DataFrame, routes: pd.DataFrame, level: int = 4, end_s: float = float("inf")) -> list[tuple]:
    """(vehicle, pos, link, enter_s, exit_s) of vehicles (vehicle, pos, link, depart_s, pcu) over links (link, free_s, headway_s, storage_pcu, lag_s); exit_s is None if the window ends before."""
    path: dict[int, list[int]] = {}
    start: dict[int, tuple[float, float]] = {}
    for r in routes.sort_values(["vehicle", "pos"]).itertuples():
        path.setdefault(int(r.vehicle), []).append(int(r.link))
        start[int(r.vehicle)] = (float(r.depart_s), float(r.pcu))
    who = sorted(path, key=lambda x: (start[x][0], x))
    return list(play(links, who, [start[v][0] for v in who], [start[v][1] for v in who], [len(path[v]) for v in who], [k for v in who for k in path[v]], level, end_s))


def play(links: pd.DataFrame, who, depart, pcu, sizes, path, level: int, end_s: float) -> Iterator[tuple]:
    """What load returns, as it happens, of vehicles in order of departure and number: their numbers, departures, pcu, how many links each goes along, and these links one vehicle after another."""
    road = {int(r.link): Road(float(r.free_s), float(r.headway_s), float(r.storage_pcu) if level >= 3 else float("inf"), float(r.lag_s) if level >= 4 else 0.0) for r in links.itertuples()}
    ids, departs, weights, path = _packed("q", who), _packed("d", depart), _packed("d", pcu), _packed("q", path)
    begins = _packed("q", np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype="int64"))]))
    del who, depart, pcu, sizes
    at = array("i", [-1]) * len(ids)  # place of each vehicle on its path
    entered: dict[int, float] = {}
    heap: list[tuple] = []
    count = 0

    def call(t: float, kind: int, who: int) -> None:
        nonlocal count
        count += 1
        heapq.heappush(heap, (t, count, kind, who))

    queues: dict[int, array] = {}  # by first link
    for v in range(len(ids)):
        queues.setdefault(path[begins[v]], array("i")).append(v)
    gone = dict.fromkeys(queues, 0)  # how many of a queue have started
    for k, vs in queues.items():
        call(departs[vs[0]], 0, k)

    def room(k: int, t: float) -> bool:
        own = road[k]
        while own.leaving and own.leaving[0][0] <= t:
            own.held -= own.leaving.popleft()[1]
        return own.held < own.storage

    def enter(v: int, k: int, t: float) -> None:
        own = road[k]
        at[v] += 1
        entered[v] = t
        own.held += weights[v]
        own.last_in = t
        own.queue.append((v, t + own.free))
        if len(own.queue) == 1:
            call(t + own.free, 1, k)

    def refused(k: int, t: float, pcu: float, who: tuple[int, int]) -> bool:
        """Whether a vehicle may not enter link k now; if so it is told when to ask again."""
        own = road[k]
        ready = own.last_in + own.headway * pcu
        if ready > t + 1e-9:
            call(ready, *who)
            return True
        if not room(k, t):
            if all(w != who for _, w in own.waiting):
                heapq.heappush(own.waiting, (t, who))
            if own.leaving:
                call(own.leaving[0][0], 2, k)
            return True
        if own.waiting and own.waiting[0][1] != who:  # another has waited longer
            if all(w != who for _, w in own.waiting):
                heapq.heappush(own.waiting, (t, who))
            call(t, 2, k)
            return True
        if own.waiting:
            heapq.heappop(own.waiting)
        return False

    while heap:
        t, _, kind, who = heapq.heappop(heap)
        if t >= end_s:
            break
        if kind == 0:  # the first of those who want to start on a link
            own, n = queues[who], gone[who]
            if n == len(own) or departs[own[n]] > t + 1e-9:
                continue
            v = own[n]
            if refused(who, t, weights[v], (0, who)):
                continue
            gone[who] = n + 1
            enter(v, who, t)
            if n + 1 < len(own):
                call(max(t, departs[own[n + 1]]), 0, who)
            if road[who].waiting:
                call(t, 2, who)
        elif kind == 1:  # the front of a link
            here = road[who]
            if not here.queue:
                continue
            v, ready = here.queue[0]
            size = weights[v]
            ready = max(ready, here.last_out + here.headway * size)
            if ready > t + 1e-9:
                call(ready, 1, who)
                continue
            on = begins[v] + at[v] + 1
            last = on == begins[v + 1]
            if not last and refused(path[on], t, size, (1, who)):
                continue
            here.queue.popleft()
            here.last_out = t
            if here.lag:
                here.leaving.append((t + here.lag, size))
            else:
                here.held -= size
            yield ids[v], at[v], who, entered.pop(v), t
            if not last:
                to = path[on]
                enter(v, to, t)
                if road[to].waiting:
                    call(t, 2, to)
            if here.queue:
                call(max(t, here.queue[0][1]), 1, who)
            if here.waiting:
                call(t + here.lag, 2, who)
        else:  # room, or somebody's turn, on a link
            own = road[who]
            if own.waiting and room(who, t):
                call(max(t, own.last_in), *own.waiting[0][1])
            elif own.waiting and own.leaving:
                call(own.leaving[0][0], 2, who)
    for v, t in entered.items():
        yield ids[v], at[v], path[begins[v] + at[v]], t, None


def _packed(kind: str, values) -> array:
    """values as an array whose items are plain numbers."""
    out = array(kind)
    out.frombytes(np.ascontiguousarray(values, dtype="int64" if kind == "q" else "float64").tobytes())
    return out


def can_start(vehicles: DataFrame, links: DataFrame, end_s: float, slack_s: float = 1.0) -> DataFrame:
    """Those of the vehicles (scenario, vehicle, first, depart_s, pcu, ...) that may come to the head of the queue at their first link before the end.

    Whoever starts on a link keeps its headway from the one who started there before, so nobody starts earlier than in a queue that nothing else holds up: a running sum and a running maximum. Who comes after
    one that does not start before the end waits behind it all the time and moves nothing. The slack is for sums of rounded numbers and the tolerance of every start.
    """
    order = Window.partitionBy("scenario", "first").orderBy("depart_s", "vehicle")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    queue = vehicles.join(F.broadcast(links.select(F.col("link").alias("first"), F.col("headway_s").cast("double").alias("h"))), "first", "left")
    queue = queue.withColumn("sum", F.sum(F.col("h") * F.col("pcu")).over(so_far)).withColumn("starts", F.col("sum") + F.max(F.col("depart_s") - F.col("sum")).over(so_far))
    return queue.withColumn("before", F.lag("starts").over(order)).filter(F.coalesce(F.col("before") < end_s + slack_s, F.lit(True))).select(*vehicles.columns)


def simulate(links: DataFrame, routes: DataFrame, level: int = 4, end_s: float = float("inf")) -> DataFrame:
    """MOVES of every scenario (scenario, vehicle, pos, link, depart_s, pcu) over one network, which is broadcast behind a check of its size. A task streams one scenario after another."""
    from viatica.operators.routing import small_network

    table = small_network(links, "link", "free_s", "headway_s", "storage_pcu", "lag_s")
    if table is None:
        raise ValueError("the network is too large for one task: load it by region")
    shared = links.sparkSession.sparkContext.broadcast(table)
    names = [c.split()[0] for c in MOVES.split(", ")]

    def moved(key: int, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        parts.clear()
        moves = play(shared.value, *columns, level, end_s)
        del columns
        while some := list(islice(moves, 20_000)):
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(some), pa.int64()), *[pa.array(x, pa.int64() if n < 3 else pa.float64()) for n, x in enumerate(zip(*some, strict=True))]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            scenario = batch.column("scenario").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(scenario)) + 1).tolist(), len(scenario)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if parts and scenario[a] != key:
                    yield from moved(key, parts)
                key, rows = int(scenario[a]), batch.slice(a, b - a)
                path = rows.column("path")
                parts.append((*[rows.column(c).to_numpy(zero_copy_only=False) for c in ("vehicle", "depart_s", "pcu")], path.value_lengths().to_numpy(zero_copy_only=False), path.flatten().to_numpy(zero_copy_only=False)))
        if parts:
            yield from moved(key, parts)

    at = F.array_sort(F.collect_list(F.struct("pos", F.col("link").cast("long").alias("link"), F.col("depart_s").cast("double").alias("depart_s"), F.col("pcu").cast("double").alias("pcu"))))
    whole = routes.groupBy(F.col("scenario").cast("long").alias("scenario"), F.col("vehicle").cast("long").alias("vehicle")).agg(at.alias("x"))
    last = F.element_at("x", -1)
    vehicles = whole.select("scenario", "vehicle", last["depart_s"].alias("depart_s"), last["pcu"].alias("pcu"), F.col("x.link").alias("path"), F.col("x")[0]["link"].alias("first"))
    if end_s < float("inf"):
        vehicles = can_start(vehicles, links, end_s)
    dealt = vehicles.drop("first").repartition(spread(vehicles), "scenario").sortWithinPartitions("scenario", "depart_s", "vehicle")
    return dealt.mapInArrow(run, MOVES)
