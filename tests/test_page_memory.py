import random
from types import SimpleNamespace

import pandas as pd
import pytest

from revlens.streaming import pages as P


class Value:
    def __init__(self):
        self.held = {}

    def exists(self):
        return None in self.held

    def get(self):
        return self.held[None]

    def update(self, value):
        self.held[None] = value

    def keys(self):
        return list(self.held)

    def getValue(self, key):
        return self.held.get(key)

    def updateValue(self, key, value):
        self.held[key] = value

    def removeKey(self, key):
        del self.held[key]


class Handle:
    def __init__(self):
        self.timers = []

    def getMapState(self, *_):
        return Value()

    getValueState = getMapState

    def registerTimer(self, at):
        self.timers.append(at)


class Horizon(P.PageHorizon):
    def apply(self, key, rows, place, previous, late):
        self.sizes.append(rows.num_rows)
        yield from super().apply(key, rows, place, previous, late)


@pytest.mark.parametrize("slot_bytes", [0, 64 << 10])
@pytest.mark.parametrize("ordered", [True, False])
def test_a_page_passes_through_memory_in_parts(monkeypatch, slot_bytes, ordered):
    monkeypatch.setattr(P, "HELD_BYTES", 30_000, raising=False)
    monkeypatch.setattr(P, "SLOT_BYTES", slot_bytes, raising=False)
    n, hour = 20_000, P.SLOT_MICROS
    rows = [(k * hour // 100, k % 2, k, float(k % 7)) for k in range(n)]
    if not ordered:
        random.Random(3).shuffle(rows)
    processor, handle = Horizon(n=3), Handle()
    processor.sizes = []
    processor.init(handle)
    frame = pd.DataFrame(rows, columns=["micros", "kind", "event", "value"])
    for part in (frame[: n // 2], frame[n // 2 :]):
        list(processor.handleInputRows(("a",), iter([part[k : k + 500] for k in range(0, len(part), 500)]), None))
    out = []
    for now in (75 * 3_600_000 + 1_234_567, n * hour // 100_000 + 10**6):
        fired = SimpleNamespace(getExpiryTimeInMs=lambda: 0), SimpleNamespace(getCurrentWatermarkInMs=lambda now=now: now)
        out += list(processor.handleExpiredTimer(("a",), fired[1], fired[0]))
    told = pd.concat([o for o in out if len(o)])
    values = [float(k % 7) for k in range(n)]
    assert told["event"].tolist() == list(range(n))
    assert told["in_horizon"].tolist() == [sum(values[max(0, k - 2) : k + 1]) for k in range(n)]
    assert processor.place.get()[0] == n and not processor.held.keys()
    if slot_bytes == 0:
        assert max(processor.sizes) < n / 4  # before: all that was due at once
