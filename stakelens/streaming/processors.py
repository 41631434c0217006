"""Keyed state for the rules on a stream.

Events of a key come in any order within the watermark's delay. A processor keeps them in a reorder buffer until the
watermark has passed them, after which no earlier event can come, and only then walks them in order of (us, seq,
entity_id): across micro-batches in the very order in which the batch rules see them.

Every access to state is a round trip to the JVM, which costs more than a hundred events do. So keys are dealt out to
buckets, and the state is that of a bucket: its buffer and what its rules remember of its keys are read once and written
once per release, however many of its keys have events. The buffer holds the bucket's events of the last ``delay`` and no
others.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import islice
from operator import itemgetter
from typing import Any, NamedTuple

from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SECOND = 1_000_000  # microseconds
ROWS_AT_ONCE = 1000

FLAG_OUT = T.StructType([
    T.StructField("scenario_type", T.StringType()),
    T.StructField("entity_type", T.StringType()),
    T.StructField("entity_id", T.StringType()),
    T.StructField("player_id", T.StringType()),
    T.StructField("triggering_us", T.LongType()),
    T.StructField("raised_us", T.LongType()),
    T.StructField("raised_by", T.StringType()),
])


class PlayerRules(NamedTuple):
    """Thresholds of the rules keyed by player."""

    card_window_seconds: float = 600
    min_bins: int = 3
    pending_seconds: float = 900
    known_ttl_days: float = 400
    near_threshold_gbp: float = 9_000
    structuring_window_seconds: float = 86_400
    min_deposits: int = 2


class InOrder(StatefulProcessor):
    """Releases the events of a key in order, and forgets a key that has been quiet for ``quiet_us``.

    A further rule derives from this: ``columns`` names the text columns that it reads, ``begin`` what it remembers of
    a new key (plain values and containers of them), ``step`` takes one event and returns flags.
    """

    columns: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()  # set for the stream
    id_type = "string"  # ids are ordered as they are in the events
    quiet_us: int

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Each element holds many events: (key, (us, seq, entity_id, *columns)).
        self.arrivals = handle.getListState("arrivals", "events binary")
        # Key to (time of its last event, memory). ``due`` is when the timer rings that asks which keys have gone quiet.
        self.memory = handle.getValueState("memory", "due bigint, body binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = None
        while some := list(islice(rows, ROWS_AT_ONCE)):
            at = some[0].__fields__.index
            keys = [at(k) for k in self.keys]
            values = itemgetter(*[at(n) for n in ("us", "seq", "entity_id", *self.columns)])
            events = [(tuple([r[k] for k in keys]), values(r)) for r in some]
            self.arrivals.appendValue((pickle.dumps(events),))
            earliest = min(e[0] for _, e in events)
            first = earliest if first is None else min(first, earliest)
        self.handle.registerTimer(self._after(first))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready: dict[tuple, list] = {}
        waiting = []
        for (events,) in self.arrivals.get() if self.arrivals.exists() else ():
            for k, e in pickle.loads(events):
                if e[0] <= passed:
                    ready.setdefault(k, []).append(e)
                else:
                    waiting.append((k, e))
        due, body = self.memory.get() if self.memory.exists() else (None, None)
        rung = due is None or expiredTimerInfo.getExpiryTimeInMs() >= due
        if not ready and (due is None or not rung):
            return
        known = {} if body is None else pickle.loads(body)
        if ready:
            event = Row("us", "seq", "entity_id", *self.columns)
            for k, events in ready.items():
                events.sort(key=itemgetter(0, 1, 2))
                last, memory = known.get(k, (None, None))
                for us, seq, entity, *others in events:
                    if last is None or us > last + self.quiet_us:
                        memory = self.begin()
                    last = us
                    for flag in self.step(memory, event(us, seq, str(entity), *others)) or ():
                        yield Row(**dict(zip(FLAG_OUT.names, flag, strict=True)))
                known[k] = last, memory
            self.arrivals.clear()
            for n in range(0, len(waiting), ROWS_AT_ONCE):
                self.arrivals.appendValue((pickle.dumps(waiting[n:n + ROWS_AT_ONCE]),))
            if waiting:
                self.handle.registerTimer(self._after(min(e[0] for _, e in waiting)))
        # An event after so long a time starts afresh anyway.
        known = {k: v for k, v in known.items() if v[0] + self.quiet_us >= passed}
        if not known and rung:
            self.memory.clear()
            return
        if rung:
            due = max(self._after(min(last for last, _ in known.values()) + self.quiet_us), passed // 1000 + 1)
            self.handle.registerTimer(due)
        self.memory.update((due, pickle.dumps(known)))

    @staticmethod
    def _after(us: int) -> int:
        """The time of a timer that rings once the watermark has passed ``us``."""
        return -(-us // 1000) + 1

    def begin(self) -> Any:
        raise NotImplementedError

    def step(self, memory: Any, e: Row) -> Iterator[tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class PlayerProcessor(InOrder):
    """Card testing, account takeover and structuring, which all follow one player."""

    columns = ("event_type", "player_id", "device_id", "payment_type", "amount_gbp", "card_bin", "country_from_ip")

    def __init__(self, rules: PlayerRules):
        self.rules = rules
        self.quiet_us = int(max(
            rules.card_window_seconds, rules.pending_seconds, rules.structuring_window_seconds,
            rules.known_ttl_days * 86_400,
        ) * SECOND)

    def begin(self) -> dict:
        # Newest BINs and large deposits first; the known values, and when each set of them was written last.
        return {"bins": [], "large": [], "pending": None, "devices": set(), "geos": set(), "devices_us": None, "geos_us": None}

    def step(self, memory: dict, e: Row) -> Iterator[tuple]:
        if e.event_type == "login":
            self._login(memory, e)
        elif e.payment_type == "withdrawal":
            yield from self._withdrawal(memory, e)
        elif e.payment_type == "deposit":
            yield from self._deposit(memory, e)

    def _login(self, memory: dict, e: Row) -> None:
        ttl = int(self.rules.known_ttl_days * 86_400 * SECOND)
        for known, written in (("devices", "devices_us"), ("geos", "geos_us")):
            if memory[written] is not None and e.us > memory[written] + ttl:
                memory[known].clear()
                memory[written] = None
        has_history = memory["devices_us"] is not None
        new_device = not has_history or e.device_id not in memory["devices"]
        no_geo = e.country_from_ip is None
        new_geo = no_geo or memory["geos_us"] is None or e.country_from_ip not in memory["geos"]
        if new_device:
            memory["devices"].add(e.device_id)
            memory["devices_us"] = e.us
        if new_geo and not no_geo:
            memory["geos"].add(e.country_from_ip)
            memory["geos_us"] = e.us
        if new_device and new_geo and has_history:
            memory["pending"] = (e.device_id, e.entity_id, e.us)

    def _withdrawal(self, memory: dict, e: Row) -> Iterator[tuple]:
        if not memory["pending"]:
            return
        device, login, us = memory["pending"]
        if device == e.device_id and e.us <= us + int(self.rules.pending_seconds * SECOND):
            at = (e.us, e.entity_id)
            yield "account_takeover", "payment", e.entity_id, e.player_id, e.us, *at
            yield "account_takeover", "login", login, e.player_id, us, *at
            memory["pending"] = None

    def _deposit(self, memory: dict, e: Row) -> Iterator[tuple]:
        r, raised = self.rules, (e.player_id, e.us, e.us, e.entity_id)
        # The most recent distinct BINs; one that is seen again moves to the front.
        bins = [[e.card_bin, e.us], *[b for b in memory["bins"] if b[0] != e.card_bin]][:r.min_bins]
        memory["bins"] = bins
        if len(bins) == r.min_bins and bins[-1][1] >= e.us - int(r.card_window_seconds * SECOND):
            yield "card_testing", "payment", e.entity_id, *raised
        if e.amount_gbp is not None and e.amount_gbp >= r.near_threshold_gbp:
            large = [e.us, *memory["large"]][:r.min_deposits]
            memory["large"] = large
            if len(large) == r.min_deposits and large[-1] >= e.us - int(r.structuring_window_seconds * SECOND):
                yield "structuring", "payment", e.entity_id, *raised


class RingProcessor(InOrder):
    """Bonus claims per (device, bonus type). Every claim extends the memory of who claimed."""

    columns = ("player_id",)

    def __init__(self, gap_seconds: float = 6 * 3600):
        self.quiet_us = int(gap_seconds * SECOND)

    def begin(self) -> dict:
        return {"claimants": set(), "last": None}

    def step(self, memory: dict, e: Row) -> Iterator[tuple]:
        if memory["last"] is not None and e.us > memory["last"] + self.quiet_us:
            memory.update(self.begin())
        if e.player_id not in memory["claimants"]:
            if memory["last"] is not None:
                yield "bonus_abuse_ring", "bonus_claim", e.entity_id, e.player_id, e.us, e.us, e.entity_id
            memory["claimants"].add(e.player_id)
        memory["last"] = e.us


class SessionProcessor(InOrder):
    """Sums of the gaps between a session's rounds and of their squares. Whole numbers, so that they are exact."""

    columns = ("player_id", "session_id")

    def __init__(self, min_gaps: int = 100, max_sd: float = 0.3, ttl_seconds: float = 6 * 3600):
        self.min_gaps = min_gaps
        self.max_sd = max_sd
        self.quiet_us = int(ttl_seconds * SECOND)

    def begin(self) -> dict:
        return {"n": 0, "sum": 0, "squares": 0, "last": None, "flagged": False}

    def step(self, memory: dict, e: Row) -> Iterator[tuple]:
        if memory["last"] is None or e.us > memory["last"] + self.quiet_us:
            memory.update(self.begin())
        else:
            gap = e.us - memory["last"]
            memory["n"] += 1
            memory["sum"] += gap
            memory["squares"] += gap * gap
        memory["last"] = e.us
        if memory["n"] >= max(self.min_gaps, 1) and not memory["flagged"] and self._deviation(memory) < self.max_sd:
            memory["flagged"] = True
            yield "bot_betting", "session", e.session_id, e.player_id, e.us, e.us, e.entity_id

    @staticmethod
    def _deviation(memory: dict) -> float:
        n, total, squares = memory["n"], memory["sum"], memory["squares"]
        return ((n * squares - total * total) / (n * (n - 1))) ** 0.5 / SECOND if n > 1 else 0.0
