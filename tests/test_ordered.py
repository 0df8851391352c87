"""Work that must not pile up: store calls of keyed streams, broadcasts of tables from small files."""

import pandas as pd

from cutledger.streaming.billing import LockClock


class Store:
    """A state store in memory that counts its calls."""

    def __init__(self):
        self.calls, self.rows, self.timers = 0, [], []

    def getListState(self, name, schema):
        return self._part()

    getValueState = getListState

    def _part(self):
        store, held = self, []

        class Part:
            def exists(self):
                store.calls += 1
                return bool(held)

            def get(self):
                store.calls += 1
                return list(held) if self.many else held[0]

            many = True

            def appendValue(self, value):
                store.calls += 1
                held.append(value)

            def put(self, values):
                store.calls += 1
                held[:] = values

            def update(self, value):
                self.many = False
                self.put([value])

            def clear(self):
                self.put([])

        return Part()

    def listTimers(self):
        self.calls += 1
        return iter(self.timers)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class Mark:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_a_thousand_keys_share_their_calls():
    store, clock = Store(), LockClock(900_000)
    clock.key_column = "payment_id"
    clock.init(store)
    rows = [(k, k * 1_000_000, 0) for k in range(1_000)] + [(k, k * 1_000_000 + 1, 1) for k in range(0, 1_000, 2)]
    batch = pd.DataFrame(rows, columns=["payment_id", "at_us", "closing"])
    list(clock.handleInputRows((0,), iter([batch]), None))
    # halfway, later rows keep waiting and open locks stay
    early = list(clock.handleExpiredTimer((0,), Mark(500_000), None))
    rest = list(clock.handleExpiredTimer((0,), Mark(10_000_000), None))
    out = pd.concat(early + rest)
    assert list(out.payment_id) == list(range(1, 1_000, 2))
    assert list(out.released_us) == [k * 1_000_000 + 900_000_000 for k in range(1, 1_000, 2)]
    assert store.calls < 40


def test_gaps_match_once_and_without_a_broadcast(spark):
    from cutledger.operators import drawings as drw

    gaps = spark.createDataFrame([(1, 1, "a", [0.0, 0.0], [0.5, 0.0])], "drawing_id int, id int, layer string, start array<double>, end array<double>")
    lines = [(1, 7, "a", [[0.1, 0.0], [5.0, 5.0], [0.1, 0.0]]), (1, 8, "a", [[0.4, 0.0], [0.2, 0.0]]), (1, 9, "a", [[0.1, 0.0], [9.0, 9.0]])]
    out = drw.match_gaps(gaps, spark.createDataFrame(lines, "drawing_id int, id int, layer string, points array<array<double>>"))
    assert sorted((r.gap_id, r.polyline_id) for r in out.collect()) == [(1, 7), (1, 8)]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_links_of_a_cell_lead_to_one_box():
    from cutledger.operators import spatial

    chain = [(n, 10.0 * n, 0.0, 10.0 * n + 10, 5.0) for n in range(50)]
    assert sorted(spatial.sweep(chain)) == [(n, 0) for n in range(1, 50)]
