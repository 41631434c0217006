"""Fraud and abuse rules over a frame of events, each one declarative.

Every rule sees events in (ts, seq, entity_id) order per key, exactly as a stateful detector would, and takes the
frame as given: retried copies count, unless the caller removes them first. Flags carry ``raised_ts`` and
``raised_by``, the event that made the rule fire, which differs from the flagged entity for account takeover.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import durable, keep_first, lag, last_value, lead, ordered, running_sum
from ..operators.ordered import DAY, SLICE, YEAR, Ordered

ORDER = ["ts", "seq", "entity_id"]


def _flags(hits: DataFrame, scenario: str, entity_type: str, entity: str = "entity_id") -> DataFrame:
    return hits.select(
        F.lit(scenario).alias("scenario_type"),
        F.lit(entity_type).alias("entity_type"),
        F.col(entity).alias("entity_id"),
        "player_id",
        F.col("ts").alias("triggering_event_ts"),
        F.lit("high").alias("severity"),
        F.col("ts").alias("raised_ts"),
        F.col("entity_id").alias("raised_by"),
    )


def _seconds(n: float) -> Column:
    return F.expr(f"interval {n} seconds")


def _recent_bins(rows: Ordered, places: int) -> Ordered:
    """Columns ``_bin1`` .. ``_binN``: the latest uses of the N most recent distinct BINs, newest first.

    A deposit whose BIN is not among the first q-1 pushes the (q-1)th entry down to place q; otherwise place q stays.
    Linear in the deposits, no arrays, and a null BIN is a value like any other.
    """
    rows = rows.with_columns(_bin1=F.struct("card_bin", *rows.order))
    unseen = F.lit(True)
    for place in range(2, places + 1):
        above = f"_was{place - 1}"
        rows = rows.add(**{above: lag(f"_bin{place - 1}")})
        unseen = unseen & ~F.col("card_bin").eqNullSafe(F.col(above)["card_bin"])
        rows = rows.add(**{f"_bin{place}": last_value(F.when(F.col(above).isNotNull() & unseen, F.col(above)))})
    return rows


def _seeded_slices(rows: Ordered, places: int) -> Ordered:
    """Put the recent BINs at the end of each slice in front of the player's next slice.

    A slice is summed up by its most recent distinct BINs, a handful of rows, and the recent BINs after every slice
    follow from these alone. With them as seed rows, slices no longer depend on each other.
    """
    newest_first = Window.partitionBy("player_id", SLICE).orderBy(F.desc("_at"))
    tails = (
        rows.df.groupBy("player_id", SLICE, "card_bin").agg(F.max(F.struct(*rows.order)).alias("_at"))
        .withColumn("_rank", F.row_number().over(newest_first)).filter(F.col("_rank") <= places)
        .select("player_id", SLICE, "card_bin", "_rank", "_at.*")
    )
    after = _recent_bins(Ordered(tails, ["player_id"], [SLICE, *rows.order], sliced=False), places).df
    ends = after.filter("_rank = 1").select(
        "player_id", SLICE, F.array(*[f"_bin{n}" for n in range(1, places + 1)]).alias("_bins")
    )
    following = Ordered(ends, ["player_id"], [SLICE], sliced=False).add(_next=lead(SLICE)).df
    seeds = (
        following.filter("_next is not null").select("player_id", F.col("_next").alias(SLICE), F.explode("_bins").alias("_b"))
        .filter("_b is not null")
        .select("player_id", SLICE, "_b.card_bin", *[F.col(f"_b.{c}") for c in rows.order], F.lit(True).alias("_seed"))
    )
    both = rows.df.withColumn("_seed", F.lit(False)).unionByName(seeds)
    return Ordered(both, [SLICE, "player_id"], rows.order, sliced=False)


def card_testing(
    events: DataFrame, window_seconds: int = 600, min_bins: int = 3, width: float = DAY
) -> DataFrame:
    """Deposits that see at least ``min_bins`` distinct card BINs in the trailing window.

    Instead of collecting each window, keep the player's ``min_bins`` most recent distinct BINs with their latest use.
    The window holds enough BINs when the last of them is young enough.
    """
    deposits = events.filter("event_type = 'payment' and payment_type = 'deposit'").select(
        "player_id", "card_bin", *ORDER
    )
    rows = ordered(deposits, ["player_id"], ORDER, width)
    found = _recent_bins(_seeded_slices(rows, min_bins), min_bins).df.filter("not _seed")
    oldest = F.col(f"_bin{min_bins}")["ts"]
    return _flags(found.filter(oldest >= F.col("ts") - _seconds(window_seconds)), "card_testing", "payment")


def bonus_ring(events: DataFrame, gap_seconds: int = 6 * 3600, width: float = DAY) -> DataFrame:
    """Claims of one bonus type on one device by a player other than the first, while claims keep coming.

    Every claim extends the device's memory by ``gap_seconds``, so claims fall into gap sessions.
    """
    claims = events.filter("event_type = 'bonus_claim'").select("device_id", "bonus_type", "player_id", *ORDER)
    place = ["device_id", "bonus_type"]
    rows = ordered(claims, place, ORDER, width).add(_prev=lag("ts"))
    starts = F.col("_prev").isNull() | (F.col("ts") > F.col("_prev") + _seconds(gap_seconds))
    live = rows.add(_live=running_sum(starts.cast("int"))).result()
    # Aggregates, not windows, from here: a hot device pre-aggregates before its rows move.
    first_of_player = keep_first(live, [*place, "_live", "player_id"], ORDER)
    first_of_all = live.groupBy(*place, "_live").agg(F.min(F.struct(*ORDER)).alias("_first"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"f.{k}")) for k in [*place, "_live"]]
    later = first_of_player.alias("c").join(first_of_all.alias("f"), same).select("c.*", "f._first")
    return _flags(later.filter(F.struct(*ORDER) > F.col("_first")), "bonus_abuse_ring", "bonus_claim")


def _lifetimes(logins: DataFrame, ttl_days: int) -> int:
    """How many times a list that lasts ``ttl_days`` can be forgotten within the history."""
    span = logins.agg(F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).first()[0] or 0
    return int(span // (ttl_days * DAY * 1_000_000))


def _memory_epochs(logins: DataFrame, what: str, ttl_days: int, lifetimes: int, name: str) -> DataFrame:
    """Number the lifetimes of a player's list of known ``what``.

    The list is rewritten when a new value appears and forgotten ``ttl_days`` after its last rewrite; the next login
    starts a new list. Each pass over the data settles one more lifetime of every player at once, so the number of
    passes is the length of the history divided by the lifetime: none for histories shorter than that.
    """
    rows = logins.withColumn(name, F.lit(0))
    ttl = F.expr(f"interval {int(ttl_days)} days")
    for epoch in range(lifetimes):
        known = rows.filter((F.col(name) == epoch) & F.col(what).isNotNull())
        fresh = keep_first(known, ["player_id", what], ORDER).select("player_id", *ORDER)
        spans = ordered(fresh, ["player_id"], ORDER, YEAR).add(_next=lead("ts")).result()
        forgotten = (
            spans.filter(F.col("_next").isNull() | (F.col("_next") > F.col("ts") + ttl))
            .groupBy("player_id")
            .agg((F.min("ts") + ttl).alias("_end"))
        )
        moved = F.when((F.col(name) == epoch) & (F.col("ts") > F.col("_end")), epoch + 1).otherwise(F.col(name))
        rows = durable(rows.join(forgotten, "player_id", "left").withColumn(name, moved).drop("_end"))
    return rows


def suspicious_logins(events: DataFrame, known_ttl_days: int | None = 400) -> DataFrame:
    """Logins on a device new to the player and from a country new to the player, who has logged in before.

    A missing country is always new and never remembered.
    """
    logins = events.filter("event_type = 'login'").select("player_id", "device_id", "country_from_ip", *ORDER)
    if known_ttl_days is None:
        logins = logins.withColumns({"_devices": F.lit(0), "_geos": F.lit(0)})
    else:
        lifetimes = _lifetimes(logins, known_ttl_days)
        logins = _memory_epochs(logins, "device_id", known_ttl_days, lifetimes, "_devices")
        logins = _memory_epochs(logins, "country_from_ip", known_ttl_days, lifetimes, "_geos")
    at = F.struct(*ORDER)
    new_device = keep_first(logins, ["player_id", "_devices", "device_id"], ORDER)
    # A player's first login is on a new device too, so the few new-device rows are enough to find it.
    first_login = new_device.groupBy("player_id", "_devices").agg(F.min(at).alias("_first"))
    first_geo = (
        logins.filter("country_from_ip is not null")
        .groupBy("player_id", "_geos", "country_from_ip")
        .agg(F.min(at).alias("_first_geo"))
    )
    return (
        new_device.join(first_login, ["player_id", "_devices"])
        .filter(at > F.col("_first"))
        .join(first_geo, ["player_id", "_geos", "country_from_ip"], "left")
        .filter(F.col("_first_geo").isNull() | (at == F.col("_first_geo")))
        .select("player_id", "device_id", *ORDER)
    )


def account_takeover(
    events: DataFrame,
    pending_seconds: int = 900,
    known_ttl_days: int | None = 400,
    width: float = DAY,
) -> DataFrame:
    """A withdrawal on the device of the latest suspicious login, soon after it. Flags the payment and the login.

    A newer suspicious login replaces the pending one, a withdrawal elsewhere leaves it, a match consumes it.
    """
    # Rare, expensive to find and read twice below: written once, after which the planner knows how small it is.
    suspects = durable(suspicious_logins(events, known_ttl_days), "suspicious-logins")
    pending = F.struct("device_id", F.col("entity_id").alias("login_id"), F.col("ts").alias("login_ts"))
    # Only players with a suspicious login can match, so few withdrawals reach the sort.
    withdrawals = (
        events.filter("event_type = 'payment' and payment_type = 'withdrawal'")
        .select("player_id", "device_id", *ORDER)
        .join(suspects.select("player_id").distinct(), "player_id", "left_semi")
    )
    both = suspects.withColumn("_pending", pending).unionByName(withdrawals, allowMissingColumns=True)
    seen = both.select("*", F.col("_pending").isNull().alias("_out"))
    carried = ordered(seen, ["player_id"], ORDER, width).add(_pending=last_value(F.col("_pending"))).result()
    hits = carried.filter(
        F.col("_out")
        & F.col("_pending").isNotNull()
        & F.col("_pending.device_id").eqNullSafe(F.col("device_id"))
        & (F.col("ts") <= F.col("_pending.login_ts") + _seconds(pending_seconds))
    ).select("player_id", *ORDER, "_pending.login_id", "_pending.login_ts")
    fired = keep_first(hits, ["player_id", "login_id"], ORDER)
    flagged = F.array(
        F.struct(F.lit("payment").alias("entity_type"), F.col("entity_id"), F.col("ts").alias("at")),
        F.struct(F.lit("login").alias("entity_type"), F.col("login_id").alias("entity_id"), F.col("login_ts").alias("at")),
    )
    return fired.select("player_id", "ts", F.col("entity_id").alias("by"), F.explode(flagged).alias("f")).select(
        F.lit("account_takeover").alias("scenario_type"),
        "f.entity_type",
        "f.entity_id",
        "player_id",
        F.col("f.at").alias("triggering_event_ts"),
        F.lit("high").alias("severity"),
        F.col("ts").alias("raised_ts"),
        F.col("by").alias("raised_by"),
    )


def self_exclusion_breach(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Logins strictly after the player's earliest self-exclusion.

    No broadcast hint: the registry grows with the players, so AQE decides from its measured size.
    """
    logins = events.filter("event_type = 'login'").select("player_id", *ORDER)
    late = logins.join(registry, "player_id").filter(F.col("ts") > F.col("excluded_since"))
    return _flags(late, "self_exclusion_breach", "login")


def bot_betting(
    events: DataFrame,
    min_gaps: int = 100,
    max_sd: float = 0.3,
    ttl_seconds: int = 6 * 3600,
    width: float = DAY,
) -> DataFrame:
    """First round at which a session has enough gaps and their running sample deviation is below ``max_sd``.

    A pause longer than ``ttl_seconds`` starts the statistics afresh; a stretch is flagged once.
    """
    rounds = events.filter("event_type = 'game_round'").select("session_id", "player_id", *ORDER)
    rows = ordered(rounds, ["session_id"], ORDER, width).add(_prev=lag("ts"))
    gap = (F.unix_micros("ts") - F.unix_micros("_prev")).cast("decimal(20,0)")  # whole numbers: sums are exact
    fresh = F.col("_prev").isNull() | (gap > int(ttl_seconds * 1_000_000))
    none = F.lit(0).cast("decimal(20,0)")
    rows = rows.with_columns(
        _fresh=fresh.cast("int"), _gap=F.when(fresh, none).otherwise(gap), _is_gap=(~fresh).cast("int")
    ).add(
        _stretch=running_sum(F.col("_fresh")),
        _n=running_sum(F.col("_is_gap")),
        _sum=running_sum(F.col("_gap")),
        _squares=running_sum((F.col("_gap") * F.col("_gap")).cast("decimal(38,0)")),
    )
    # Sums of a stretch are those of the session less those at its start, where they are smallest.
    stretch = rows.result()
    place = ["session_id", "_stretch"]
    starts = stretch.groupBy(*place).agg(*[F.min(c).alias(f"{c}0") for c in ("_n", "_sum", "_squares")])
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in place]
    inside = stretch.alias("r").join(starts.alias("s"), same).select(
        "r.*", *[(F.col(c) - F.col(f"{c}0")).cast("double").alias(f"{c}_here") for c in ("_n", "_sum", "_squares")])
    n = F.col("_n_here")
    spread = (F.col("_squares_here") - F.col("_sum_here") * F.col("_sum_here") / n) / (n - 1)
    deviation = F.sqrt(F.greatest(F.when(n > 1, spread).otherwise(0.0), F.lit(0.0))) / 1e6
    even = inside.filter((n >= max(min_gaps, 1)) & (deviation < max_sd))
    return _flags(keep_first(even, place, ORDER), "bot_betting", "session", "session_id")


def structuring(
    events: DataFrame,
    threshold_gbp: float = 10_000,
    near_ratio: float = 0.9,
    window_seconds: int = DAY,
    min_deposits: int = 2,
    width: float = DAY,
) -> DataFrame:
    """Deposits at or above the near-threshold amount with enough earlier ones inside the window."""
    floor = threshold_gbp * near_ratio
    large = events.filter(
        (F.col("event_type") == "payment") & (F.col("payment_type") == "deposit") & (F.col("amount_gbp") >= floor)
    ).select("player_id", *ORDER)
    rows = ordered(large, ["player_id"], ORDER, width).with_columns(_back0=F.col("ts"))
    for step in range(1, min_deposits):
        rows = rows.add(**{f"_back{step}": lag(f"_back{step - 1}")})
    earliest = F.col(f"_back{min_deposits - 1}")
    return _flags(
        rows.result().filter(earliest >= F.col("ts") - _seconds(window_seconds)), "structuring", "payment"
    )


KEYED_RULES = (card_testing, bonus_ring, account_takeover, bot_betting, structuring)


def run_rules(
    events: DataFrame,
    registry: DataFrame,
    settings: dict[str, dict] | None = None,
    rules: Sequence[Callable[..., DataFrame]] = KEYED_RULES,
) -> DataFrame:
    """All rules. ``settings`` overrides thresholds by rule name, e.g. ``{"card_testing": {"min_bins": 4}}``.

    A rule is any function from the event frame to flags in the columns of the built-in ones, so further rules are
    added by passing them. The event kind is a literal in each branch of the unified frame, hence each rule scans
    only its own tables.
    """
    settings = settings or {}
    out = self_exclusion_breach(events, registry)
    for rule in rules:
        out = out.unionByName(rule(events, **settings.get(rule.__name__, {})))
    return out


def stamp_detection(flags: DataFrame, low: float = 0.2, high: float = 1.5) -> DataFrame:
    """Flag id and simulated detection time, both functions of the flag, so that a rerun writes the same rows."""
    raised = F.concat_ws("|", F.col("raised_by").cast("string"), F.unix_micros("raised_ts").cast("string"))
    spread = F.conv(F.substring(F.md5(raised), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
    delay = F.lit(low) + spread * F.lit(high - low)
    identity = [F.col(c).cast("string") for c in ("scenario_type", "entity_type", "entity_id", "raised_by")]
    return flags.select(
        F.sha2(F.concat_ws("|", *identity, F.unix_micros("triggering_event_ts").cast("string")), 256).alias("flag_id"),
        "scenario_type", "entity_type", "entity_id", "player_id", "triggering_event_ts",
        F.timestamp_micros(F.unix_micros("raised_ts") + F.round(delay * 1e6).cast("bigint")).alias("detected_ts"),
        "severity",
    )
