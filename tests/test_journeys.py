"""Searches in timetables that asks share, and journeys leg by leg."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from viatica.operators import itineraries, transit

CALLS = "line long, run long, stop long, pos long, arrive_s long, depart_s long"


@pytest.fixture(scope="module")
def timetable(spark):
    draw = random.Random(4)
    rows, run = [], 0
    for line in range(6):
        stops, takes = draw.sample(range(12), 5), [draw.randint(30, 120) for _ in range(5)]  # so no run overtakes another
        for start in sorted(draw.sample(range(0, 3000, 10), 9)):
            t = start
            for pos, stop in enumerate(stops):
                rows.append((line, run, stop, pos, t, t + 5))
                t += takes[pos]
            run += 1
    walks = [(a, b, draw.randint(20, 90)) for a in range(12) for b in draw.sample(range(12), 2) if a != b]
    asks = [(n, draw.randrange(12), draw.randrange(3200)) for n in range(150)]
    more = [(n, draw.randrange(12), draw.randrange(3200)) for n in range(0, 150, 2)]
    ends = [(n, s, draw.randint(5, 70)) for n in range(150) for s in draw.sample(range(12), 2)]
    return (rows, walks, asks, more, ends), (spark.createDataFrame(rows, CALLS), spark.createDataFrame(walks, "a long, b long, walk_s long"), spark.createDataFrame(asks, "ask long, stop long, at_s long"), spark.createDataFrame(more, "ask long, stop long, at_s long"), spark.createDataFrame(ends, "ask long, stop long, walk_s long"))


def test_sharing_changes_no_arrival(timetable):
    _, (calls, walks, asks, _, _) = timetable
    own = {tuple(r) for r in transit.arrivals(asks, calls, walks, 3, 20).select("ask", "stop", "t", "rides").collect()}
    shared = {tuple(r) for r in transit.shared_arrivals(asks, calls, walks, 3, 20).select("ask", "stop", "t", "rides").collect()}
    assert own == shared and len(own) > 500
    assert transit.shared_starts(asks, calls)[1].count() < 54 * 5


def test_arrivals_by_a_plain_search(timetable):
    (rows, walks, asks, _, _), (calls, walks_, asks_, _, _) = timetable
    by_run: dict = {}
    for line, run, stop, _, a, d in rows:
        by_run.setdefault((line, run), []).append((stop, a, d))
    got = {(r.ask, r.stop): (r.t, r.rides) for r in transit.shared_arrivals(asks_, calls, walks_, 3, 20).collect()}
    for n, stop, at in asks[:40]:
        best = {stop: (at, 0)}
        fresh = {stop: at}
        for ride in range(1, 4):
            new: dict = {}
            for s, t in fresh.items():
                ready = t + (20 if ride > 1 else 0)
                for run in by_run.values():  # any run, not the first alone
                    for i, (x, _, d) in enumerate(run):
                        if x == s and d >= ready:
                            for y, a, _ in run[i + 1 :]:
                                new[y] = min(new.get(y, 10**9), a)
            for a, b, w in walks:
                if a in new:
                    new.setdefault(("walk", b), 10**9)
                    new["walk", b] = min(new["walk", b], new[a] + w)
            for k, t in list(new.items()):
                if isinstance(k, tuple):
                    new[k[1]] = min(new.get(k[1], 10**9), new.pop(k))
            fresh = {s: t for s, t in new.items() if s not in best or t < best[s][0]}
            best |= {s: (t, ride) for s, t in fresh.items()}
        mine = {s: x for (a, s), x in got.items() if a == n}
        assert mine == best


def test_journeys_of_several_starts_are_those_of_one_search(timetable):
    _, (calls, walks, asks, more, ends) = timetable
    starts = asks.unionByName(more)
    whole = itineraries.journeys(transit.rounds(starts, calls, walks, 3, 20), ends, 60)
    shared, _ = transit.shared_journeys(starts, ends, calls, walks, 3, 20, 60)
    assert sorted(map(tuple, whole.select("ask", "rides", "arrive_s").collect())) == sorted(map(tuple, shared.select("ask", "rides", "arrive_s").collect()))


def test_legs_lead_from_start_to_end(timetable):
    (rows, walks, asks, more, ends), (calls, walks_, asks_, more_, ends_) = timetable
    found, labels = transit.shared_journeys(asks_.unionByName(more_), ends_, calls, walks_, 3, 20, 60)
    journeys = {(r.ask, r.rides): r for r in found.collect()}
    legs: dict = {}
    for r in transit.legs(found, labels, calls, 3).collect():
        legs.setdefault((r.ask, r.rides), []).append(r)
    assert set(legs) == set(journeys) and any(n == 3 for _, n in legs)
    starts: dict = {}
    for n, stop, at in asks + more:
        starts.setdefault(n, []).append((stop, at))
    on_foot = {(a, b): w for a, b, w in sorted(walks, reverse=True)}
    on_foot = {k: min(w for a, b, w in walks if (a, b) == k) for k in on_foot}
    times = {(run, stop): (line, a, d) for line, run, stop, _, a, d in rows}
    for (ask, n), own in legs.items():
        own.sort(key=lambda r: r.leg)
        assert [r.leg for r in own] == list(range(1, n + 1))
        at, here = min((t, s) for s, t in starts[ask] if s == own[0].board), own[0].board
        clock = at[0]
        for r in own:
            assert r.board == here and r.depart_s >= clock and times[r.run, r.board][0] == r.line and times[r.run, r.board][2] == r.depart_s and times[r.run, r.alight][1] == r.arrive_s > r.depart_s
            clock, here = r.arrive_s, r.alight
            if r.walk_s:  # on foot to where the next leg starts, or to the last stop
                to = own[r.leg].board if r.leg < n else journeys[ask, n].stop
                assert on_foot[here, to] == r.walk_s
                clock, here = clock + r.walk_s, to
            if r.leg < n:
                clock += 20
        end = journeys[ask, n]
        assert here == end.stop and clock + min(w for a, s, w in ends if (a, s) == (ask, here)) == end.arrive_s


def test_nothing_departs_any_more(spark, timetable):
    _, (calls, walks, _, _, ends) = timetable
    late = spark.createDataFrame([(1, 3, 99_999), (2, 777, 0)], "ask long, stop long, at_s long")
    assert sorted(map(tuple, transit.shared_arrivals(late, calls, walks, 3, 20).collect())) == [(1, 3, 99_999, 0), (2, 777, 0, 0)]
    found, labels = transit.shared_journeys(late, ends, calls, walks, 3, 20, 60)
    assert found.count() == 0 and transit.legs(found, labels, calls, 3).count() == 0
    assert transit.shared_arrivals(late.limit(0), calls, walks, 3, 20).filter(F.col("rides") >= 0).count() == 0
