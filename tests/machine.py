"""Event-at-a-time model of the rules, for checking the declarative forms on small inputs.

Deliberately naive: it keeps whole histories and looks back through them.
"""

from __future__ import annotations

import statistics
from collections import defaultdict
from datetime import timedelta

HOUR = timedelta(hours=1)


def run(events, registry, *, window=600, bins=3, ring=6 * 3600, pending=900, known_days=400,
        gaps=100, sd=0.3, ttl=6 * 3600, floor=9000.0, span=86400, deposits=2):
    past = defaultdict(list)  # deposits per player
    claims = defaultdict(list)  # live claimants per place, with the time of the last claim
    known = defaultdict(lambda: {"device": ({}, None), "geo": ({}, None)})
    waiting = {}
    rounds = defaultdict(lambda: {"last": None, "gaps": [], "done": False})
    out = []

    def flag(scenario, kind, entity, e, at=None):
        out.append((scenario, kind, entity, e["player_id"], at or e["ts"], e["ts"], e["entity_id"]))

    def remembered(player, what, now):
        values, written = known[player][what]
        if written is not None and now > written + timedelta(days=known_days):
            values, written = {}, None
            known[player][what] = (values, written)
        return values

    for e in sorted(events, key=lambda e: (e["ts"], e["seq"], e["entity_id"])):
        now, player = e["ts"], e["player_id"]
        if e["event_type"] == "login":
            if player in registry and now > registry[player]:
                flag("self_exclusion_breach", "login", e["entity_id"], e)
            devices, geos = remembered(player, "device", now), remembered(player, "geo", now)
            had_any = len(devices) > 0
            new_device = e["device_id"] not in devices
            new_geo = e["country_from_ip"] is None or e["country_from_ip"] not in geos
            if new_device:
                known[player]["device"] = ({**devices, e["device_id"]: 1}, now)
            if new_geo and e["country_from_ip"] is not None:
                known[player]["geo"] = ({**geos, e["country_from_ip"]: 1}, now)
            if new_device and new_geo and had_any:
                waiting[player] = e
        elif e["event_type"] == "payment" and e["payment_type"] == "withdrawal":
            first = waiting.get(player)
            if first and first["device_id"] == e["device_id"] and now <= first["ts"] + timedelta(seconds=pending):
                flag("account_takeover", "payment", e["entity_id"], e)
                flag("account_takeover", "login", first["entity_id"], e, first["ts"])
                del waiting[player]
        elif e["event_type"] == "payment":
            past[player].append(e)
            seen = {p["card_bin"] for p in past[player] if now - p["ts"] <= timedelta(seconds=window)}
            if len(seen) >= bins:
                flag("card_testing", "payment", e["entity_id"], e)
            if e["amount_gbp"] >= floor:
                large = [p for p in past[player] if p["amount_gbp"] >= floor
                         and now - p["ts"] <= timedelta(seconds=span)]
                if len(large) >= deposits:
                    flag("structuring", "payment", e["entity_id"], e)
        elif e["event_type"] == "bonus_claim":
            place = (e["device_id"], e["bonus_type"])
            if claims[place] and now > claims[place][-1][1] + timedelta(seconds=ring):
                claims[place] = []
            if claims[place] and player not in [p for p, _ in claims[place]]:
                flag("bonus_abuse_ring", "bonus_claim", e["entity_id"], e)
            claims[place].append((player, now))
        else:
            s = rounds[e["session_id"]]
            if s["last"] is not None and now > s["last"] + timedelta(seconds=ttl):
                s.update(last=None, gaps=[], done=False)
            if s["last"] is not None:
                s["gaps"].append((now - s["last"]).total_seconds())
            s["last"] = now
            if len(s["gaps"]) >= max(gaps, 1) and not s["done"]:
                spread = statistics.stdev(s["gaps"]) if len(s["gaps"]) > 1 else 0.0
                if spread < sd:
                    s["done"] = True
                    flag("bot_betting", "session", e["session_id"], e)
    return sorted(out, key=str)
