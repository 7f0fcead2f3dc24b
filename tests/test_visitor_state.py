"""A visitor's state, with its store played by dictionaries that count the calls."""

import datetime
from types import SimpleNamespace

from haneul.streaming import beacons

HOUR = 3_600_000


class Store:
    """One visitor's value, map and timers."""

    def __init__(self):
        self.calls, self.value, self.map, self.timers = 0, None, {}, set()

    def call(self, f):
        def counted(*a):
            self.calls += 1
            return f(*a)

        return counted

    def getValueState(self, *_):
        put = lambda v: setattr(self, "value", v)
        return SimpleNamespace(exists=self.call(lambda: self.value is not None), get=self.call(lambda: self.value), update=self.call(put), clear=self.call(lambda: put(None)))

    def getMapState(self, *_):
        m = self.map
        return SimpleNamespace(containsKey=self.call(m.__contains__), getValue=self.call(m.get), updateValue=self.call(m.__setitem__), removeKey=self.call(m.pop), keys=self.call(lambda: list(m)), clear=self.call(m.clear))

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


def at(day, hour=3):
    return int(datetime.datetime(2024, 1, 1, hour, tzinfo=datetime.UTC).timestamp() * 1000) + (day - 1) * 24 * HOUR


def run(batches, late):
    """Each batch of days, and then what timers are due, as Spark runs them; the watermark is `late` behind the newest hit."""
    store, now, i, out = Store(), 0, 0, []
    state = beacons.VisitorDays(2, visitor_kept=datetime.timedelta(days=20), late=datetime.timedelta(hours=late))
    state.init(store)
    for days in [*batches, []]:
        rows = [{"id": (i := i + 1), "day": f"2024-01-{d:02d}", "ts": datetime.datetime(2024, 1, d, 3), "at": at(d)} for d in days]
        if rows:
            out += [(r["day"], r["kept"], r["hits"]) for r in map(lambda r: r.asDict(), state.handleInputRows(("v",), iter(rows), SimpleNamespace(getCurrentWatermarkInMs=lambda: now)))]
        for due in sorted(t for t in store.timers if t <= now):
            store.timers.remove(due)
            list(state.handleExpiredTimer(("v",), SimpleNamespace(getCurrentWatermarkInMs=lambda: now), None))
        now = max([now, *(r["at"] - late * HOUR for r in rows)])
    return store, out


def test_a_month_at_once_takes_few_calls():
    store, out = run([[d for d in range(1, 31) for _ in range(3)]], 48)
    assert [k for _, k, _ in out] == [True, True, False] * 30 and out[-1] == ("2024-01-30", False, 90)
    assert sorted(d for (d,) in store.map) == [f"2024-01-{d}" for d in range(26, 31)] and store.calls < 20


def test_days_end_though_their_visitor_comes_back():
    store, out = run([[1, 2], [2, 2, 3], [8], [8, 8], [9]], 24)
    assert [k for _, k, _ in out] == [True, True, True, False, True, True, True, False, True]
    assert sorted(d for (d,) in store.map) == ["2024-01-08", "2024-01-09"] and min(store.timers) == at(8, 15) + 48 * HOUR


def test_a_visitor_is_given_up():
    store, _ = run([[1], [30]], 0)
    assert store.value[:2] == ("2024-01-01", 2)
    state = beacons.VisitorDays(2, visitor_kept=datetime.timedelta(days=20), late=datetime.timedelta(0))
    state.init(store)
    later = SimpleNamespace(getCurrentWatermarkInMs=lambda: at(30) + 21 * 24 * HOUR)
    store.value = (*store.value[:3], min(store.timers))
    list(state.handleExpiredTimer(("v",), later, None))
    assert store.value is None and not store.map
