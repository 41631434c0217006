"""Random events with ties, retries, nulls and one player who has most of them."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

from stakelens.schemas import EVENT

START = datetime(2024, 3, 1)
SEQ = {"login": 0, "payment": 1, "bonus_claim": 2, "game_round": 3}


def make(seed: int, n: int = 600, minutes: int = 600, start: datetime = START) -> list[dict]:
    rng = random.Random(seed)
    events = []
    for i in range(n):
        kind = rng.choice(list(SEQ))
        player = "hot" if rng.random() < 0.6 else f"p{rng.randrange(4)}"
        e = dict.fromkeys(EVENT.fieldNames())
        e.update(
            event_type=kind, entity_id=f"{kind[0]}{i:05d}", player_id=player, seq=SEQ[kind],
            ts=start + timedelta(seconds=rng.randrange(minutes) * 60),  # minute steps make many ties
        )
        if kind != "game_round":
            e["device_id"] = f"d{rng.randrange(6)}"
        if kind == "login":
            e["country_from_ip"] = rng.choice([None, "GB", "IE", "SE", "DK"])
        elif kind == "payment":
            e["payment_type"] = rng.choice(["deposit", "deposit", "withdrawal"])
            e["amount"] = e["amount_gbp"] = Decimal(rng.choice(["100.00", "8999.99", "9000.00", "12000.00"]))
            e["currency"] = "GBP"
            e["card_bin"] = rng.choice([None, "400000", "510000", "520000", "530000"])
        elif kind == "bonus_claim":
            e["bonus_type"] = rng.choice(["welcome", "reload"])
        else:
            e["session_id"] = f"s-{player}-{rng.randrange(2)}"
        events.append(e)
        if rng.random() < 0.05:
            events.append(dict(e))
    return events


def frame(spark, events: list[dict]):
    return spark.createDataFrame([tuple(e[c] for c in EVENT.fieldNames()) for e in events], EVENT)


def registry(spark, since: dict[str, datetime]):
    return spark.createDataFrame(list(since.items()), "player_id string, excluded_since timestamp")


FLAG_COLUMNS = [
    "scenario_type", "entity_type", "entity_id", "player_id", "triggering_event_ts", "raised_ts", "raised_by",
]


def collected(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*FLAG_COLUMNS).collect()), key=str)
