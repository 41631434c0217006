"""SQL twins of the quality, governance, distortion and report queries. They build on the models in ``oracles``."""

from __future__ import annotations

from . import schemas as s
from .plans.governance import RETAINED_TABLES, RETENTION_POLICY, classification

_SALT = "bench-salt"


def _d(expression: str, name: str) -> str:
    return f"round(cast({expression} as double), 6) as {name}"


def _listed(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _checks(table: str, source: str, checks: list[tuple[str, str | None, str | None]]) -> list[str]:
    """Each check as its own query: (name, column shown as sample, condition of an unexpected row)."""
    out = []
    for name, column, bad in checks:
        if bad is None:
            rows = f"(select {column} as v, count(*) over (partition by {column}) as n from {source}) q"
            bad, sample = "n > 1 and v is not null", "cast(v as varchar)"
        else:
            rows, sample = source, f"cast({column} as varchar)" if column else "cast(null as varchar)"
        out.append(f"""
select '{table}' as table_name, '{name}' as expectation, count(*) filter (where {bad}) = 0 as success,
       count(*) filter (where {bad}) as unexpected_count,
       round(100.0 * count(*) filter (where {bad}) / count(*), 6) as unexpected_percent,
       min({sample}) filter (where {bad}) as sample_min, max({sample}) filter (where {bad}) as sample_max
from {rows}""")
    return out


def _not_null(c):
    return (f"not_null({c})", c, f"{c} is null")


def _unique(c):
    return (f"unique({c})", c, None)


def _in_set(c, values):
    return (f"in_set({c})", c, f"{c} not in {_listed(values)}")


_RAW_CHECKS = {
    "players": [_not_null("player_id"), _unique("player_id"), _not_null("signup_ts"), _in_set("country", s.COUNTRIES),
                _in_set("currency", s.CURRENCIES), _in_set("acquisition_channel", s.ACQUISITION_CHANNELS),
                _in_set("activity_segment", s.ACTIVITY_SEGMENTS)],
    "devices": [_not_null("device_id"), _unique("device_id"), _not_null("first_seen_ts"),
                ("null_player_id_only_on_shared_fraud_ring_devices", None,
                 "player_id is null and not coalesce(is_shared_fraud_ring, false)")],
    "player_attribute_history": [
        _not_null("player_id"), _not_null("effective_ts"), _in_set("vip_tier", s.VIP_TIERS),
        _in_set("kyc_status", s.KYC_STATUSES), _in_set("self_exclusion_status", s.SELF_EXCLUSION_STATUSES),
        _in_set("risk_segment", s.RISK_SEGMENTS)],
    "sessions": [_not_null("session_id"), _unique("session_id"), _not_null("player_id"),
                 ("not_before(end_ts, start_ts)", "end_ts", "end_ts < start_ts")],
    "login_events": [_not_null("login_id"), _unique("login_id"), _not_null("player_id"), _not_null("ts")],
    "game_rounds": [_not_null("round_id"), ("at_least(stake_amount, 0)", "stake_amount", "stake_amount < 0"),
                    ("at_least(payout_amount, 0)", "payout_amount", "payout_amount < 0"),
                    _in_set("game_type", s.GAME_TYPES)],
    "payments": [_not_null("payment_id"), ("above(amount, 0)", "amount", "amount <= 0"),
                 _in_set("currency", s.CURRENCIES), _in_set("payment_type", s.PAYMENT_TYPES),
                 _in_set("method", s.PAYMENT_METHODS), _in_set("status", s.PAYMENT_STATUSES)],
    "bonuses": [_not_null("bonus_id"), _unique("bonus_id"), ("above(bonus_amount, 0)", "bonus_amount",
                "bonus_amount <= 0"), _in_set("bonus_type", s.BONUS_TYPES)],
}
_MODEL_CHECKS = {
    "stg_players": [_not_null("player_id"), _unique("player_id"), _in_set("country", s.COUNTRIES)],
    "stg_devices": [_not_null("device_id"), _unique("device_id")],
    "stg_player_attribute_history": [_in_set("kyc_status", s.KYC_STATUSES),
                                     _in_set("self_exclusion_status", s.SELF_EXCLUSION_STATUSES)],
    "stg_sessions": [_not_null("session_id"), _unique("session_id")],
    "stg_game_rounds": [_not_null("round_id"), _unique("round_id"),
                        ("at_least(stake_amount, 0)", "stake_amount", "stake_amount < 0")],
    "stg_payments": [_not_null("payment_id"), _unique("payment_id"), _in_set("payment_type", s.PAYMENT_TYPES),
                     ("at_least(amount_gbp, 0)", "amount_gbp", "amount_gbp < 0")],
    "stg_fraud_ground_truth": [_in_set("scenario_type", s.SCENARIOS)],
    "dim_players_scd2": [_not_null("player_dimension_key"), _unique("player_dimension_key"), _not_null("player_id")],
    "player_ltv": [_not_null("player_id"), _unique("player_id")],
    "churn_labels": [_not_null("player_id"), _unique("player_id")],
    "fraud_summary": [_not_null("scenario_type")],
}


def _erased(table: str, column: str, value: str) -> str:
    return (f"select * replace (case when player_id in (select player_id from self_exclusion_registry)"
            f" then {value} else cast({column} as varchar) end as {column}) from {table}")


def _audit(requests: str, at: str, expires: str) -> str:
    return f"""
select substr(sha256(who || '|' || epoch_us(done)), 1, 32) as erasure_id, who as player_id_pseudonym,
       done as processed_at,
       '{{"sessions":["ip_address"],"login_events":["ip_address"],"players":["date_of_birth"]}}'
         as pseudonymised_fields,
       '{{{",".join(f'"{t}":"{r}"' for t, r in RETAINED_TABLES.items())}}}' as retained_tables,
       '{expires}' as retention_expires_at
from (select 'erased:' || substr(sha256('{_SALT}:' || player_id), 1, 32) as who,
             timestamp '{at}' as done from {requests}) r"""


_HASHED = f"'erased:' || substr(sha256('{_SALT}:' || ip_address), 1, 32)"
_KEPT = [t for t in RETAINED_TABLES if t != "devices"]
_KEPT_IDS = " union all ".join(
    f"select entity_id as player_id, '{t}' as t from raw_{t} where entity_type = 'player'"
    if t in ("fraud_ground_truth", "streaming_fraud_flags") else f"select player_id, '{t}' as t from raw_{t}"
    for t in _KEPT)
_MART = {"fct_player_ltv": "player_ltv", "fct_churn_labels": "churn_labels", "fct_fraud_summary": "fraud_summary"}
_TOUCHED = [("sessions", "ip_address"), ("login_events", "ip_address"), ("players", "date_of_birth")]

REPORT_MODELS: dict[str, str] = {
    "gate": " union all ".join(q for t, c in _RAW_CHECKS.items() for q in _checks(t, f"raw_{t}", c)),
    "tests": " union all ".join(q for t, c in _MODEL_CHECKS.items() for q in _checks(t, t, c)),
    "touched": " union all ".join(
        f"select r.player_id, '{t}.{c}' as field, (select count(*) from raw_{t} x where x.player_id = r.player_id"
        f" and {c} is not null) as rows_affected from self_exclusion_registry r" for t, c in _TOUCHED),
    "kept": "select p.player_id, "
    + ", ".join(f"count(*) filter (where t = '{t}') as {t}" for t in _KEPT)
    + f" from raw_players p left join ({_KEPT_IDS}) k on p.player_id = k.player_id group by p.player_id",
    "governed": " union all ".join(
        f"select '{model}' as model, '{c}' as column_name, '{m['classification']}' as classification,"
        f" {str(m['pii']).lower()} as pii, '{m['retention_category']}' as retention_category,"
        f" count({c}) as populated from {_MART.get(model, model)}"
        for model, columns in classification().items() for c, m in columns.items()),
    "naive": """
with played as (
  select player_id, count(*) filter (stake_amount > 0) as rounds, sum(stake_amount) as stake, min(ts) as early, max(ts) as late
  from raw_game_rounds group by player_id),
paid as (
  select player_id, sum(amount) filter (payment_type = 'deposit') as deposits,
         sum(amount) filter (payment_type = 'withdrawal') as withdrawals, min(ts) as early, max(ts) as late
  from raw_payments group by player_id),
lives as (
  select player_id, ifnull(rounds, 0) as total_rounds_naive, ifnull(stake, 0) as total_stake_naive,
         ifnull(deposits, 0) as total_deposits_naive, ifnull(withdrawals, 0) as total_withdrawals_naive,
         least(played.early, paid.early) as first_activity, greatest(played.late, paid.late) as last_activity
  from played full join paid using (player_id))
select lives.*, signup_ts, greatest(0, epoch_us(last_activity) - epoch_us(signup_ts)) // 86400000000 as tenure_days,
       last_activity <= as_of_date as is_churned_naive
from lives join raw_players using (player_id), as_of
where first_activity <= as_of_date""",
    "engineered": """
select l.player_id, l.total_sessions, l.total_stake as total_stake_engineered, l.total_deposits_gbp,
       l.total_withdrawals_gbp, l.ltv_gbp, l.signup_ts, l.last_active_date, c.is_churned, c.is_self_excluded_as_of,
       cast(greatest(floor((epoch_us(last_active_date) - epoch_us(signup_ts)) / 86400000000.0), 0) as bigint)
         as tenure_days
from player_ltv l join churn_labels c using (player_id)""",
    "dedup_effect": """
with copies as (
  select payment_id, sum(amount * rate_to_gbp) as every, arg_min(amount * rate_to_gbp, ts) as one
  from raw_payments join fx on fx.currency = upper(raw_payments.currency)
  where payment_type = 'deposit' group by payment_id)
select sum(every) as raw_with_dupes_gbp, sum(one) as deduped_gbp from copies""",
    "declined_effect": """
with by_status as (select status, sum(amount_gbp) as gbp from stg_payments where payment_type = 'deposit' group by status)
select sum(gbp) as with_declined_gbp, sum(if(status = 'completed', gbp, null)) as completed_only_gbp from by_status""",
    "deposit_effects": """
select *, combined - dedup - declined as currency_mixing from (
    select n, e, (n - e) / e * 100 as combined,
           (select (cast(raw_with_dupes_gbp as double) - cast(deduped_gbp as double)) / cast(deduped_gbp as double)
                   * 100 from dedup_effect) as dedup,
           (select (cast(with_declined_gbp as double) - cast(completed_only_gbp as double))
                   / cast(completed_only_gbp as double) * 100 from declined_effect) as declined
    from (select (select cast(sum(total_deposits_naive) as double) from naive) as n,
                 (select cast(sum(total_deposits_gbp) as double) from engineered) as e) t) u""",
    "then_now": """
select p.payment_id, p.player_id, p.ts, d.vip_tier, d.risk_segment, d.is_current,
       p.ts >= d.valid_from and (d.valid_to is null or p.ts < d.valid_to) as covers
from stg_payments p join dim_players_scd2 d on p.player_id = d.player_id""",
    "score_steps": """
select score, sum(label) as pos, sum(1 - label) as neg,
       sum(sum(label)) over (order by score desc) as cum_pos, sum(sum(1 - label)) over (order by score desc) as cum_neg
from (select cast(is_churned as int) as label, 1 / (1 + cast(total_sessions as double)) as score from engineered) s
group by score""",
    "fanout": """
select (select count(*) from raw_players) as players, (select count(*) from raw_payments) as payments,
       (select count(*) from raw_game_rounds) as game_rounds,
       (select cast(count(*) as double) from raw_payments p join raw_game_rounds g using (player_id))
         as naive_join_rows""",
    "timeline": """
with busy as (
  select player_id, row_number() over (order by count(*) desc, player_id) as place from dim_players_scd2 group by player_id)
select player_id, country, valid_from, valid_to, is_current, vip_tier, kyc_status, self_exclusion_status, risk_segment
from busy join dim_players_scd2 using (player_id) where place <= 15""",
    "drawn": """
select *, coalesce(valid_to, (select greatest(max(valid_to), max(valid_from)) + interval 14 day
                              from dim_players_scd2)) as valid_to_display from dim_players_scd2""",
    "at_risk": """
with worth as (
  select 'payment' as entity_type, payment_id as entity_id, cast(amount_gbp as decimal(29,8)) as gbp from stg_payments
  union all select 'bonus_claim', bonus_id, bonus_amount from raw_bonuses
  union all select 'session', session_id, sum(stake_amount) from raw_game_rounds group by session_id)
select scenario_type, entity_type, count(*) as n_events, round(sum(gbp)::double / count(gbp), 2) as avg_amount_gbp
from stg_fraud_ground_truth join worth using (entity_type, entity_id) group by all""",
}

_REPLACE_NAIVE = "total_stake_naive total_deposits_naive total_withdrawals_naive".split()
_REPLACE_ENGINEERED = "total_stake_engineered total_deposits_gbp total_withdrawals_gbp ltv_gbp".split()
_LONG = " union all ".join(
    f"select player_id, valid_from, valid_to_display, '{a}' as attribute, {a} as value from shown"
    for a in ("vip_tier", "kyc_status", "self_exclusion_status", "risk_segment"))
_MONTHS = "case retention_category " + " ".join(
    f"when '{c}' then {m}" for c, (m, _) in RETENTION_POLICY.items()) + " end"
_BASIS = "case retention_category " + " ".join(
    f"when '{c}' then '{b}'" for c, (_, b) in RETENTION_POLICY.items()) + " end"

REPORT_SELECTS: dict[str, str] = {
    "flags_stamped": """
select sha256(scenario_type || '|' || entity_type || '|' || entity_id || '|' || raised_by || '|'
              || epoch_us(triggering_event_ts)) as flag_id,
       scenario_type, entity_type, entity_id, player_id, triggering_event_ts,
       make_timestamp(epoch_us(raised_ts) + cast(round((0.2::double + ('0x' || substr(md5(raised_by || '|'
         || epoch_us(raised_ts)), 1, 8))::bigint / 4294967296.0::double * 1.3::double) * 1e6) as bigint)) as detected_ts,
       severity
from flags_all_rules""",
    "replayed_events": """
select event_type, entity_id, player_id, device_id, session_id, payment_type,
       round(cast(amount as double), 6) as amount, currency, round(cast(amount_gbp as double), 6) as amount_gbp,
       card_bin, bonus_type, country_from_ip,
       timestamp '2024-06-01 00:00:00' + (ts - (select max(ts) - interval 6 hour from raw_game_rounds)) as ts,
       cast(seq as bigint) as seq
from unified_events where ts >= (select max(ts) - interval 6 hour from raw_game_rounds)""",
    "keep_first_lineitem": """
select * exclude (rn) replace (cast(l_linenumber as bigint) as l_linenumber)
from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate, l_partkey, l_suppkey,
             l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) as rn from lineitem) t
where rn = 1""",
    "payments_with_status_then": "select payment_id, player_id, ts, vip_tier, risk_segment from then_now where covers",
    "payments_with_status_now":
        "select payment_id, player_id, ts, vip_tier, risk_segment from then_now where is_current",
    "raw_gate": "select * from gate",
    "raw_gate_by_table": "select table_name, count(*) filter (where success) as passed, count(*) as checks,"
    " bool_and(success) as table_passed from gate group by table_name",
    "raw_duplicate_rates": """
select 'game_rounds' as table_name, 'round_id' as column_name,
       round(1 - count(distinct round_id) / count(*), 6) as duplicate_rate from raw_game_rounds
union all
select 'payments', 'payment_id', round(1 - count(distinct payment_id) / count(*), 6) from raw_payments""",
    "model_tests": "select * from tests",
    "scd2_overlaps": """
select distinct b.player_id, b.valid_from, max(coalesce(a.valid_to, timestamp '9999-12-31')) over
       (partition by b.player_id, b.valid_from) as covered_until
from dim_players_scd2 a join dim_players_scd2 b on a.player_id = b.player_id and a.valid_from < b.valid_from
where a.valid_to is null or a.valid_to > b.valid_from""",
    "overlapping_quarters": """
select b.player_id, b.effective_ts as valid_from, max(a.effective_ts + interval 90 day) as covered_until
from raw_player_attribute_history a join raw_player_attribute_history b
  on a.player_id = b.player_id and a.effective_ts < b.effective_ts
where a.effective_ts + interval 90 day > b.effective_ts group by 1, 2""",
    "erased_sessions": _erased("raw_sessions", "ip_address", _HASHED),
    "erased_login_events": "select * replace (cast(success_flag as varchar) as success_flag) from ("
    + _erased("raw_login_events", "ip_address", _HASHED) + ") e",
    "erased_players": _erased("raw_players", "date_of_birth", "null"),
    "erasure_committed": "select 'sessions' as table_name, cast(session_id as varchar) as row_id,"
    " cast(player_id as varchar) as player_id, ip_address as value from ("
    + _erased("raw_sessions", "ip_address", _HASHED) + ") s union all"
    " select 'login_events', cast(login_id as varchar), cast(player_id as varchar), ip_address from ("
    + _erased("raw_login_events", "ip_address", _HASHED) + ") l union all"
    " select 'players', cast(player_id as varchar), cast(player_id as varchar), cast(date_of_birth as varchar) from ("
    + _erased("raw_players", "date_of_birth", "null") + ") p union all"
    " select 'erasure_audit_log', erasure_id, player_id_pseudonym, retention_expires_at from ("
    + _audit("self_exclusion_registry", "2024-02-29 12:00:00", "2029-02-28") + ") a",
    "erasure_refused": "select distinct -player_id as player_id from raw_players where player_id % 2 = 1",
    "erasure_dry_run": "select * from touched",
    "erasure_audit": _audit("self_exclusion_registry", "2024-02-29 12:00:00", "2029-02-28"),
    "appended_audit": _audit("self_exclusion_registry", "2024-02-29 12:00:00", "2029-02-28")
    + " union all " + _audit("raw_players", "2024-03-01 12:00:00", "2029-03-01"),
    "replaced_table": "select * from self_exclusion_registry",
    "metrics_document": "select * from fanout",
    "retained_row_counts": "select * from kept",
    "erasure_sample": """
select d.player_id, d.vip_tier, d.kyc_status, d.self_exclusion_status, d.risk_segment,
       (select min(ip_address) from raw_sessions s where s.player_id = d.player_id) as sample_ip_address,
       (select cast(min(date_of_birth) as varchar) from raw_players p where p.player_id = d.player_id)
         as date_of_birth,
       (select count(ip_address) from raw_sessions s where s.player_id = d.player_id) as sessions_ip_address,
       (select count(ip_address) from raw_login_events s where s.player_id = d.player_id) as login_events_ip_address,
       (select count(date_of_birth) from raw_players p where p.player_id = d.player_id) as players_date_of_birth,
       k.* exclude (player_id)
from (select *, row_number() over (partition by kyc_status, self_exclusion_status order by player_id) as rn
      from dim_players_scd2 where is_current) d join kept k on k.player_id = d.player_id where rn = 1""",
    "classified_columns": "select * from governed",
    "classification_rollup": "select classification, retention_category, count(*) as columns,"
    " count(*) filter (where pii) as pii_columns, cast(sum(populated) as bigint) as populated from governed"
    " group by 1, 2",
    "retention_schedule": f"select *,"
    f" cast({_MONTHS} as bigint) as retention_months, {_BASIS} as basis from governed",
    "retention_due": """
select player_id, last_active_date, cast(cast(last_active_date + interval 72 month as date) as varchar)
       as retention_due
from player_ltv where last_active_date is not null""",
    "expired_archive_days": """
select cast(cast(ts as date) as varchar) as day, count(*) as events from unified_events
where cast(ts as date) < date '2024-04-15' - 90 group by 1""",
    "general_view_dim_players": "select * exclude (kyc_status, self_exclusion_status, risk_segment)"
    " from dim_players_scd2",
    "naive_features": f"select * replace ({', '.join(_d(c, c) for c in _REPLACE_NAIVE)}) from naive",
    "engineered_features": f"select * replace ({', '.join(_d(c, c) for c in _REPLACE_ENGINEERED)},"
    " cast(total_sessions as bigint) as total_sessions,"
    " cast(is_self_excluded_as_of as varchar) as is_self_excluded_as_of) from engineered",
    "dedup_distortion": f"select {_d('raw_with_dupes_gbp', 'raw_with_dupes_gbp')}, {_d('deduped_gbp', 'deduped_gbp')},"
    f" {_d('(select dedup from deposit_effects)', 'dedup_only_distortion_pct')} from dedup_effect",
    "declined_distortion": f"select {_d('with_declined_gbp', 'with_declined_gbp')},"
    f" {_d('completed_only_gbp', 'completed_only_gbp')},"
    f" {_d('(select declined from deposit_effects)', 'declined_payments_distortion_pct')} from declined_effect",
    "deposit_distortion": f"select {_d('n', 'naive_total_deposits')}, {_d('e', 'engineered_total_deposits')},"
    f" {_d('dedup', 'dedup_only_distortion_pct')}, {_d('declined', 'declined_payments_distortion_pct')},"
    f" {_d('combined', 'combined_distortion_pct')}, {_d('currency_mixing', 'currency_mixing_distortion_pct')}"
    " from deposit_effects",
    "deposit_scenarios": f"""
select a.fixed as dedup_fixed, b.fixed as currency_fixed, c.fixed as declined_fixed,
       {_d('e + (n - e) * share', 'reported_total')}, {_d('combined * share', 'distortion_pct')}
from (values (false), (true)) a(fixed), (values (false), (true)) b(fixed), (values (false), (true)) c(fixed),
     deposit_effects d,
     lateral (select (case when a.fixed then 0 else d.dedup / d.combined end)
                   + (case when b.fixed then 0 else d.currency_mixing / d.combined end)
                   + (case when c.fixed then 0 else d.declined / d.combined end) as share) r""",
    "self_exclusion_contamination": """
select count(*) filter (where is_self_excluded_as_of and is_churned) as mislabelled_as_churn,
       count(*) filter (where is_self_excluded_as_of) as total_self_excluded from engineered""",
    "bot_contamination": f"""
select {_d('sum(r.stake_amount)', 'naive_total_stake_incl_bots')},
       {_d('sum(r.stake_amount) filter (where b.entity_id is null)', 'engineered_total_stake_excl_bots')},
       count(distinct b.entity_id) as bot_session_count
from raw_game_rounds r left join (
    select entity_id from stg_fraud_ground_truth where entity_type = 'session' and scenario_type = 'bot_betting') b
  on b.entity_id = r.session_id""",
    "point_in_time_mismatches": """
select count(*) as total_lookups, count(*) filter (where then_value <> now_value) as mismatches
from (select e.entity_id, e.injected_ts, d.risk_segment as then_value
      from stg_fraud_ground_truth e join dim_players_scd2 d on d.player_id = e.entity_id
       and e.injected_ts >= d.valid_from and (d.valid_to is null or e.injected_ts < d.valid_to)
      where e.entity_type = 'player') a
join (select e.entity_id, e.injected_ts, d.risk_segment as now_value
      from stg_fraud_ground_truth e join dim_players_scd2 d on d.player_id = e.entity_id and d.is_current
      where e.entity_type = 'player') b using (entity_id, injected_ts)""",
    "join_fanout": "select * from fanout",
    "totals_before_join": f"""
select p.player_id, {_d('d.deposits', 'deposits')}, {_d('s.stake', 'stake')} from raw_players p
left join (select player_id, sum(amount) as deposits from raw_payments group by 1) d using (player_id)
left join (select player_id, sum(stake_amount) as stake from raw_game_rounds group by 1) s using (player_id)""",
    "bonus_average": f"select {_d('cast(sum(coalesce(bonus_amount, 0)) as double) / count(*)', 'avg_bonus')},"
    " count(*) filter (where bonus_amount is null) as missing_bonus_amounts from raw_bonuses",
    "sessions_per_utc_day": "select cast(cast(start_ts as date) as varchar) as day_utc, count(*) as sessions"
    " from raw_sessions group by 1",
    "money_sum": "select round(cast(sum(amount) as double), 6) as exact_total,"
    " round(sum(cast(amount as double)), 2) as float_total from raw_payments",
    "churn_score_metrics": """
select cast(sum(pos) + sum(neg) as bigint) as n_test,
       round(1 - sum(pos * (cum_neg - neg / 2)) / (sum(pos) * sum(neg)), 6) as auc,
       round(sum(pos * cum_pos / (cum_pos + cum_neg)) / sum(pos), 6) as average_precision,
       round(coalesce(sum(pos) filter (where score >= 0.5) / nullif(sum(pos + neg) filter (where score >= 0.5), 0), 0),
             6) as precision,
       round(coalesce(sum(pos) filter (where score >= 0.5), 0) / sum(pos), 6) as recall
from score_steps""",
    "bi_kpis": f"""
select count(*) as players, {_d('sum(ltv_gbp)', 'total_ltv_gbp')},
       cast(coalesce(sum(total_sessions), 0) as bigint) as total_sessions,
       (select round(avg(cast(is_churned as int)), 6) from churn_labels
        where not coalesce(is_self_excluded_as_of, false)) as churn_rate from player_ltv""",
    "bi_scd_summary": "select vip_tier, kyc_status, self_exclusion_status, risk_segment, is_current, count(*) as n"
    " from dim_players_scd2 group by all",
    "bi_current_split": """
select 'vip_tier' as attribute, vip_tier as value, count(*) as n from dim_players_scd2 where is_current group by 2
union all
select 'self_exclusion_status', self_exclusion_status, count(*) from dim_players_scd2 where is_current group by 2""",
    "bi_scd_timeline": "select * from timeline",
    "bi_attribute_timeline": f"""
select * from (with shown as (
    select *, coalesce(valid_to, (select greatest(max(valid_to), max(valid_from)) + interval 14 day from timeline))
              as valid_to_display from timeline) {_LONG}) t""",
    "bi_point_in_time_vs_current": """
select n.player_id, t.risk_segment as risk_segment_then, t.kyc_status as kyc_status_then,
       n.risk_segment as risk_segment_now, n.kyc_status as kyc_status_now,
       coalesce(t.risk_segment <> n.risk_segment or t.kyc_status <> n.kyc_status, false) as mismatch
from dim_players_scd2 n left join (
    select *, row_number() over (partition by player_id order by valid_from) as rn from drawn
    where cast(valid_from as date) <= date '2022-06-15' and cast(valid_to_display as date) >= date '2022-06-15') t
  on t.player_id = n.player_id and t.rn = 1 where n.is_current""",
    "bi_recent_flags": """
select scenario_type, entity_type, entity_id, player_id, triggering_event_ts, detected_ts,
       round(detection_latency_seconds, 6) as detection_latency_seconds, severity
from stg_streaming_fraud_flags order by detected_ts desc, flag_id limit 200""",
    "bi_value_at_risk": "select * from at_risk",
    "bi_exposure": f"""
select scenario_type, entity_type, check_interval, {_d('per_day', 'events_per_day')},
       {_d('wait', 'expected_wait_hours')}, {_d('greatest(per_day * wait / 24, 0)', 'extra_events')},
       {_d('greatest(per_day * wait / 24, 0) * coalesce(avg_amount_gbp, 1)', 'exposure')},
       avg_amount_gbp is not null as in_gbp
from (select f.scenario_type, f.entity_type, i.check_interval, a.avg_amount_gbp,
             f.ground_truth_count / 30 as per_day,
             case when i.hours = 0 then f.avg_detection_latency_seconds / 3600 else i.hours / 2 end as wait
      from fraud_summary f left join at_risk a using (scenario_type, entity_type)
      cross join (values ('Real-time (streaming, as deployed)', 0.0::double), ('Every 1 minute', 1 / 60),
                         ('Every 15 minutes', 0.25), ('Every hour', 1), ('Every 6 hours', 6),
                         ('Once a day (daily batch)', 24)) i(check_interval, hours)) x""",
    "bi_ltv_histogram": f"""
select b as bin, count(v) as players, {_d('min(v)', 'lowest')}, {_d('max(v)', 'highest')}
from range(50) bins(b) left join (select * from (select cast(ltv_gbp as double) as v from player_ltv where ltv_gbp is not null) k cross join (select cast(min(ltv_gbp) as double) as low, cast(max(ltv_gbp) as double) as high from player_ltv) e)
     on least(floor((v - low) * 50 / (high - low)), 49) = b
group by b""",
    "bi_ltv_by_country": f"select country, count(*) as players, {_d('sum(ltv_gbp)::double / count(*)', 'avg_ltv_gbp')}"
    " from player_ltv where ltv_gbp is not null group by country",
    "bi_churn_composition": """
select case when is_self_excluded_as_of then 'Self-excluded' else 'Churned' end as population, count(*) as players
from churn_labels where is_self_excluded_as_of or (not is_self_excluded_as_of and is_churned) group by 1""",
    "synced_flags": "select cast(flag_id as varchar) as flag_id, scenario_type, entity_type,"
    " cast(entity_id as varchar) as entity_id, cast(player_id as varchar) as player_id, triggering_event_ts,"
    " detected_ts, severity from raw_streaming_fraud_flags",
    "exported_reports": """
select 'fraud_summary' as report, count(*) as rows from fraud_summary
union all select 'recent_flags', least(count(*), 200) from stg_streaming_fraud_flags
union all select 'player_ltv', count(*) from player_ltv
union all select 'churn_labels', count(*) from churn_labels
union all select 'scd_summary', count(*) from (select distinct vip_tier, kyc_status, self_exclusion_status,
                                               risk_segment, is_current from dim_players_scd2) d
union all select 'scd_timeline', count(*) from timeline
union all select 'scenario_exposure', count(*) from at_risk""",
    "exported_timeline": "select * from timeline",
    "stream_flags": "select * from flags_all_rules",
    "stream_archive": "select strftime(ts, '%Y') as year, strftime(ts, '%m') as month, strftime(ts, '%d') as day,"
    " event_type, count(*) as events from unified_events group by all",
    "stream_without_retries": "select distinct event_type, entity_id, ts from unified_events",
    "stream_rolling_large_deposits": """
select player_id, start as window_start, start + interval 72 hour as window_end, count(*) as deposits
from (select player_id, ts, unnest([date_trunc('day', ts), date_trunc('day', ts) - interval 1 day,
                                    date_trunc('day', ts) - interval 2 day]) as start
      from unified_events where event_type = 'payment' and payment_type = 'deposit' and amount_gbp >= 45) d
group by 1, 2 having count(*) >= 2""",
    "stream_messages": "select * replace (round(cast(amount as double), 6) as amount,"
    " round(cast(amount_gbp as double), 6) as amount_gbp, cast(seq as bigint) as seq) from unified_events",
}
