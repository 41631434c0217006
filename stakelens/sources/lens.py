"""Views that read the star-schema test tables as the operator's raw tables.

The SQL is plain enough for Spark and for any other engine; ``{events}``, ``{customer}`` and ``{orders}`` stand for
the input tables. Keys stay BIGINT. Low-value events arrive twice, which stands in for at-least-once delivery.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare

_CURRENCY = (
    "case c_nationkey % 7 when 0 then 'gbp' when 1 then 'eur' when 2 then 'sek' when 3 then 'dkk'"
    " when 4 then 'eur' when 5 then 'cad' else 'usd' end"
)
_IP = "concat('10.', cast(user_id % 250 as varchar(10)), '.', cast(day(ts) as varchar(10)), '.1')"
_IS_ROUND = "event_type in ('click', 'view', 'error')"

_ROUND = f"""
select event_id as round_id, user_id * 100 + day(ts) as session_id, user_id as player_id,
       case event_id % 4 when 0 then 'slots' when 1 then 'table_games' when 2 then 'live_casino'
            else 'sports_betting' end as game_type,
       cast(value as decimal(18,2)) as stake_amount,
       case when event_type = 'view' then cast(cast(value as decimal(18,2)) * 0.9 as decimal(18,2))
            else cast(0 as decimal(18,2)) end as payout_amount,
       ts
from {{events}} where {_IS_ROUND}"""

_PAYMENT = f"""
select e.event_id as payment_id, e.user_id as player_id,
       case when e.event_type = 'purchase' then 'deposit' else 'withdrawal' end as payment_type,
       cast(e.value as decimal(18,2)) as amount, {_CURRENCY} as currency,
       case e.event_id % 4 when 0 then 'debit_card' when 1 then 'credit_card' when 2 then 'e_wallet'
            else 'bank_transfer' end as method,
       regexp_extract(e.props, '[0-9]+', 0) as card_bin, e.user_id * 10 + e.event_id % 3 as device_id, e.ts,
       case when e.event_id % 10 = 0 then 'declined' else 'completed' end as status
from {{events}} e join {{customer}} c on e.user_id = c.c_custkey
where e.event_type in ('purchase', 'signup')"""

VIEWS: dict[str, str] = {
    "raw_players": f"""
select c_custkey as player_id,
       timestamp '2023-01-01 00:00:00' + interval '1' day * cast(c_custkey % 330 as int) as signup_ts,
       case c_nationkey % 6 when 0 then 'gb' when 1 then 'ie' when 2 then 'se' when 3 then 'dk' when 4 then 'de'
            else 'ca' end as country,
       {_CURRENCY} as currency, c_mktsegment as acquisition_channel,
       case c_custkey % 3 when 0 then 'casual' when 1 then 'regular' else 'vip' end as activity_segment,
       date '1940-02-29' + cast((c_custkey * 7919) % 18000 as int) as date_of_birth
from {{customer}}""",
    "raw_player_attribute_history": """
select o_custkey as player_id, o_orderdate + interval '25' year as effective_ts, o_orderkey as change_seq,
       case when o_totalprice < 100000 then 'bronze' when o_totalprice < 200000 then 'silver'
            when o_totalprice < 350000 then 'gold' else 'platinum' end as vip_tier,
       case o_orderstatus when 'O' then 'pending' when 'F' then 'verified' else 'rejected' end as kyc_status,
       case o_orderpriority when '1-URGENT' then 'self_excluded' when '2-HIGH' then 'cooling_off'
            else 'none' end as self_exclusion_status,
       case o_orderpriority when '1-URGENT' then 'high' when '2-HIGH' then 'medium' else 'low' end as risk_segment
from {orders}""",
    "raw_game_rounds": f"{_ROUND} union all {_ROUND} and value < 5",
    "raw_sessions": f"""
select user_id * 100 + day(ts) as session_id, user_id as player_id, min(user_id * 10 + event_id % 3) as device_id,
       {_IP} as ip_address, case min(event_id % 5) when 0 then 'GB' when 1 then 'IE' when 2 then 'SE'
       when 3 then 'DK' end as country_from_ip, min(ts) as start_ts, max(ts) as end_ts
from {{events}} where {_IS_ROUND} group by user_id, day(ts)""",
    "raw_login_events": f"""
select event_id as login_id, user_id as player_id, user_id * 10 + event_id % 3 as device_id, {_IP} as ip_address,
       case event_id % 5 when 0 then 'GB' when 1 then 'IE' when 2 then 'SE' when 3 then 'DK' end as country_from_ip,
       ts, case when event_id % 4 = 0 then null else true end as success_flag
from {{events}} where event_type = 'view'""",
    "raw_payments": f"{_PAYMENT} union all {_PAYMENT} and e.value < 5",
    "raw_bonuses": """
select event_id as bonus_id, user_id as player_id, case event_id % 2 when 0 then 'welcome' else 'reload' end
       as bonus_type, ts as claim_ts, 35 as wagering_requirement_multiple,
       cast(value as decimal(18,2)) as bonus_amount, event_id % 20 as device_id
from {events} where event_type = 'signup'""",
    "raw_devices": """
select user_id * 10 + event_id % 3 as device_id, min(user_id) as player_id, min(ts) as first_seen_ts,
       case (user_id * 10 + event_id % 3) % 4 when 0 then 'iOS' when 1 then 'Android' when 2 then 'Windows'
            else 'macOS' end as os, cast(null as boolean) as is_shared_fraud_ring
from {events} group by user_id * 10 + event_id % 3""",
    "raw_fraud_ground_truth": f"""
select 'payment' as entity_type, event_id as entity_id, 'card_testing' as scenario_type, ts as injected_ts
from {{events}} where event_type = 'purchase' and value >= 60
union all select 'payment', event_id, 'structuring', ts from {{events}}
where event_type = 'purchase' and value >= 90
union all select 'login', event_id, 'account_takeover', ts from {{events}}
where event_type = 'view' and value >= 80
union all select 'bonus_claim', event_id, 'bonus_abuse_ring', ts from {{events}}
where event_type = 'signup' and value >= 70
union all select 'session', user_id * 100 + day(ts), 'bot_betting', max(ts) from {{events}}
where {_IS_ROUND} group by user_id, day(ts) having count(*) >= 4
union all select 'player', user_id, 'card_testing', min(ts) from {{events}}
where event_type = 'purchase' and value >= 60 group by user_id""",
    "raw_streaming_fraud_flags": """
select event_id as flag_id, 'card_testing' as scenario_type, 'payment' as entity_type, event_id as entity_id,
       user_id as player_id, ts as triggering_event_ts,
       ts + interval '1' second * cast(event_id % 3 as int) as detected_ts, 'high' as severity
from {events} where event_type = 'purchase' and value >= 50
union all select event_id, 'account_takeover', 'login', event_id, user_id, ts,
       ts + interval '1' second * cast(event_id % 500 as int), 'high'
from {events} where event_type = 'view' and value between 70 and 200
union all select event_id, 'bonus_abuse_ring', 'bonus_claim', event_id, user_id, ts,
       ts + interval '1' second * cast(event_id % 2 as int), 'high'
from {events} where event_type = 'signup' and value >= 65""",
}

# Declared schemas read zone-less timestamps as UTC instants.
_TABLES = {
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp",
}


class Lens:
    """The raw tables, read through the views above. ``lens.payments`` and so on are lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str, stream: bool = False):
        self.spark = prepare(spark)
        self.folder = folder
        self.stream = stream

    def table(self, name: str) -> DataFrame:
        if self.stream and name == "events":
            # A glob, because a streaming source wants a folder or pattern.
            return self.spark.readStream.schema(_TABLES[name]).parquet(f"{self.folder}/{name}.parque[t]")
        return self.spark.read.schema(_TABLES[name]).parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        inputs = {t: self.table(t) for t in ("events", "customer", "orders") if f"{{{t}}}" in VIEWS[name]}
        return self.spark.sql(VIEWS[name], **inputs)

    @cached_property
    def players(self) -> DataFrame:
        return self.view("raw_players")

    @cached_property
    def player_attribute_history(self) -> DataFrame:
        return self.view("raw_player_attribute_history")

    @cached_property
    def game_rounds(self) -> DataFrame:
        return self.view("raw_game_rounds")

    @cached_property
    def sessions(self) -> DataFrame:
        return self.view("raw_sessions")

    @cached_property
    def login_events(self) -> DataFrame:
        return self.view("raw_login_events")

    @cached_property
    def payments(self) -> DataFrame:
        return self.view("raw_payments")

    @cached_property
    def bonuses(self) -> DataFrame:
        return self.view("raw_bonuses")

    @cached_property
    def devices(self) -> DataFrame:
        return self.view("raw_devices")

    @cached_property
    def fraud_ground_truth(self) -> DataFrame:
        return self.view("raw_fraud_ground_truth")

    @cached_property
    def streaming_fraud_flags(self) -> DataFrame:
        return self.view("raw_streaming_fraud_flags")
