"""The operators on keyed state driven by hand, batch by batch, and what streams report of themselves."""

import random

import pandas as pd
import pytest

from helpers import lines
from loglark.operators import counts
from loglark.operators.parse import parse_logs
from loglark.streaming import state
from test_stream import LOG, drain, folders, parsed  # noqa: F401


class Handle:
    """A state store of one key."""

    def __init__(self):
        self.values = {}

    def getValueState(self, name, schema):
        values = self.values

        class Value:
            def exists(self):
                return name in values

            def get(self):
                return values[name]

            def update(self, value):
                values[name] = value

        return Value()


def run(make, batches, key=("k",)):
    """The output of each batch, with a new processor for each as after a restart."""
    handle, out = Handle(), []
    for batch in batches:
        processor = make()
        processor.init(handle)
        out += list(processor.handleInputRows(key, iter(batch), None))
    return (pd.concat(out) if out else pd.DataFrame()), handle.values


def split(rows, cuts):
    edges = [0, *sorted(cuts), len(rows)]
    return [rows[a:b] for a, b in zip(edges, edges[1:]) if a < b]


@pytest.mark.parametrize("seed", range(5))
def test_late_events_are_the_same_for_every_split(seed):
    rng = random.Random(seed)
    rows = [(i, i // 3, i, rng.choice([None, 100 + i // 4 - rng.choice([0, 0, 1, 4, 9])])) for i in range(60)]
    want, newest = [], None
    for _, _, _, sec in rows:
        want.append(sec is not None and newest is not None and sec < newest - 2)
        newest = sec if newest is None else max(newest, sec if sec is not None else newest)
    for cuts in ([], [30], rng.sample(range(1, 60), 9)):
        batches = []
        for part in split(rows, cuts):
            rng.shuffle(part)  # rows of a batch come in any order
            frame = pd.DataFrame(part, columns=["id", "arrival_key", "tie_key", "second_key"])
            half = len(frame) // 2
            batches.append([frame[:half], frame[half:]])
        got, kept = run(lambda: state.LateMarks(3, ["id"]), batches)
        assert got.sort_values("id")["late"].tolist() == want and kept == {"newest": (newest,)}


def plain_rates(added, n):
    totals = {}
    for sec, w in added:
        totals[sec] = totals.get(sec, 0) + w
    return {s: sum(w for t, w in totals.items() if s - n < t <= s) / n for s in totals}


@pytest.mark.parametrize("n,delay", [(1, 0), (5, 0), (5, 3), (60, 2)])
def test_each_closed_second_gives_its_rate_once(n, delay):
    rng = random.Random(n)
    now, added, batches, closed = 1000, [], [], 999
    for _ in range(12):
        now += rng.randint(0, 6)
        part = [(now - rng.randint(0, delay), rng.randint(1, 4)) for _ in range(rng.randint(1, 5))]
        part = [(s, w) for s, w in part if s > closed]
        closed = max([closed, *(s - delay - 1 for s, _ in part)])
        added += part
        too_late = [(closed - 1, 9)] if rng.random() < 0.3 and closed > 1000 and part else []
        if part:
            batches.append([pd.DataFrame([(str(s), w) for s, w in part], columns=["key", "w"])])
        if too_late:
            batches.append([pd.DataFrame([(str(s), w) for s, w in too_late], columns=["key", "w"])])
    got, kept = run(lambda: state.RunningRate(n, delay), batches)
    until, secs, ns = kept["ring"]
    want = {s: r for s, r in plain_rates(added, n).items() if s <= until}
    given = [int(t.timestamp()) for t in got["sec"]]
    assert len(given) == len(set(given)) and dict(zip(given, got["rate"])) == pytest.approx(want)
    # What is open goes by the ring alone, which holds no more than it needs.
    open_rates = {s: r for s, r in plain_rates(zip(secs, ns), n).items() if s > until}
    assert open_rates == pytest.approx({s: r for s, r in plain_rates(added, n).items() if s > until})
    assert len(secs) <= n + delay + 1


def test_seconds_hold_one_window_of_each_salt():
    batches = [[pd.DataFrame({"key": [str(s)], "w": [2]})] for s in (5, 3, 9, 40, 31, 30, 5)]
    _, kept = run(lambda: state.Seconds(10), batches, (0,))
    assert kept["seconds"] == ([31, 40], [2, 2])


def test_totals_of_a_stream_reach_listeners(spark, folders):  # noqa: F811
    for k in range(2):
        folders.add(LOG[k * 60 : k * 60 + 60 + k])
    watched = counts.observed_stream(parsed(spark, folders, max_files=1), "lines")
    query = drain(watched.writeStream.format("noop").option("checkpointLocation", folders.checkpoint).trigger(availableNow=True).start())
    found = [p.observedMetrics["lines"].asDict() for p in query.recentProgress if "lines" in p.observedMetrics]
    assert [sum(f.values()) for f in found] == [60, 61]
    assert sum(f["parse_errors"] for f in found) == sum(v.startswith("bad") for v in LOG[:121])


def test_observed_totals_need_no_job_of_their_own(spark):
    watched, found = counts.observed(parse_logs(lines(spark, *LOG)))
    assert watched.where("status = 200").count() > 0
    assert found.get == counts.totals(parse_logs(lines(spark, *LOG))).first().asDict()
