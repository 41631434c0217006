"""Declared schemas of the raw tables, events and flags, the domain value sets and the column classification."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
RATE = T.DecimalType(10, 6)

_S, _TS, _B, _I, _L = T.StringType(), T.TimestampType(), T.BooleanType(), T.IntegerType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


RAW: dict[str, T.StructType] = {
    "players": _struct(
        player_id=_S, signup_ts=_TS, country=_S, currency=_S,
        acquisition_channel=_S, activity_segment=_S, date_of_birth=T.DateType(),
    ),
    "devices": _struct(device_id=_S, player_id=_S, first_seen_ts=_TS, os=_S, is_shared_fraud_ring=_B),
    "player_attribute_history": _struct(
        player_id=_S, effective_ts=_TS, vip_tier=_S, kyc_status=_S, self_exclusion_status=_S, risk_segment=_S,
    ),
    "sessions": _struct(
        session_id=_S, player_id=_S, device_id=_S, ip_address=_S, country_from_ip=_S, start_ts=_TS, end_ts=_TS,
    ),
    "login_events": _struct(
        login_id=_S, player_id=_S, device_id=_S, ip_address=_S, country_from_ip=_S, ts=_TS, success_flag=_B,
    ),
    "game_rounds": _struct(
        round_id=_S, session_id=_S, player_id=_S, game_type=_S, stake_amount=MONEY, payout_amount=MONEY, ts=_TS,
    ),
    "payments": _struct(
        payment_id=_S, player_id=_S, payment_type=_S, amount=MONEY, currency=_S, method=_S,
        card_bin=_S, device_id=_S, ts=_TS, status=_S,
    ),
    "bonuses": _struct(
        bonus_id=_S, player_id=_S, bonus_type=_S, claim_ts=_TS,
        wagering_requirement_multiple=_I, bonus_amount=MONEY, device_id=_S,
    ),
    "fraud_ground_truth": _struct(entity_type=_S, entity_id=_S, scenario_type=_S, injected_ts=_TS, ring_id=_S),
    "streaming_fraud_flags": _struct(
        flag_id=_S, scenario_type=_S, entity_type=_S, entity_id=_S, player_id=_S,
        triggering_event_ts=_TS, detected_ts=_TS, severity=_S,
    ),
}

FX_RATES = _struct(currency=_S, rate_to_gbp=RATE)
SELF_EXCLUSION_REGISTRY = _struct(player_id=_S, excluded_since=_TS)
AUDIT_LOG = _struct(
    erasure_id=_S, player_id_pseudonym=_S, processed_at=_TS,
    pseudonymised_fields=_S, retained_tables=_S, retention_expires_at=T.DateType(),
)

# One flat record for all four event kinds; fields of other kinds are null. ``seq`` orders events of equal ts.
EVENT = _struct(
    event_type=_S, entity_id=_S, player_id=_S, device_id=_S, session_id=_S, payment_type=_S, amount=MONEY,
    currency=_S, amount_gbp=T.DecimalType(29, 8), card_bin=_S, bonus_type=_S, country_from_ip=_S, ts=_TS, seq=_I,
)

FLAG = _struct(
    scenario_type=_S, entity_type=_S, entity_id=_S, player_id=_S, triggering_event_ts=_TS, severity=_S,
)

# The category sets every table is checked against.
COUNTRIES = ["GB", "IE", "SE", "DK", "DE", "CA"]
CURRENCIES = ["GBP", "EUR", "SEK", "DKK", "CAD"]
ACQUISITION_CHANNELS = ["affiliate", "paid_search", "organic", "referral"]
GAME_TYPES = ["slots", "table_games", "live_casino", "sports_betting"]
PAYMENT_METHODS = ["debit_card", "credit_card", "e_wallet", "bank_transfer"]
PAYMENT_TYPES = ["deposit", "withdrawal"]
PAYMENT_STATUSES = ["completed", "declined"]
BONUS_TYPES = ["welcome", "reload"]
VIP_TIERS = ["bronze", "silver", "gold", "platinum"]
KYC_STATUSES = ["pending", "verified", "rejected"]
SELF_EXCLUSION_STATUSES = ["none", "cooling_off", "self_excluded"]
RISK_SEGMENTS = ["low", "medium", "high"]
ACTIVITY_SEGMENTS = ["casual", "regular", "vip"]
SCENARIOS = [
    "bonus_abuse_ring", "card_testing", "account_takeover", "self_exclusion_breach", "bot_betting", "structuring",
]

# Classification tier, whether it is personal data, and retention category of each governed column.
CLASSIFICATION = """
stg_players.player_id                           confidential  pii  account_lifetime_plus_aml
stg_players.signup_ts                           internal      -    account_lifetime_plus_aml
stg_players.country                             internal      -    account_lifetime_plus_aml
stg_players.currency                            internal      -    account_lifetime_plus_aml
stg_players.acquisition_channel                 internal      -    account_lifetime_plus_aml
stg_players.activity_segment                    internal      -    account_lifetime_plus_aml
stg_players.date_of_birth                       restricted    pii  kyc_regulatory
stg_players.age_at_signup                       internal      -    account_lifetime_plus_aml
stg_devices.device_id                           confidential  pii  fraud_signal
stg_devices.first_seen_player_id                confidential  pii  fraud_signal
stg_devices.first_seen_ts                       internal      -    fraud_signal
stg_devices.os                                  internal      -    fraud_signal
stg_devices.is_shared_fraud_ring                restricted    -    fraud_signal
stg_player_attribute_history.player_id          confidential  pii  account_lifetime_plus_aml
stg_player_attribute_history.effective_ts       internal      -    account_lifetime_plus_aml
stg_player_attribute_history.vip_tier           internal      -    account_lifetime_plus_aml
stg_player_attribute_history.kyc_status         restricted    pii  kyc_regulatory
stg_player_attribute_history.self_exclusion_status  restricted  pii  responsible_gambling
stg_player_attribute_history.risk_segment       restricted    pii  kyc_regulatory
stg_sessions.session_id                         internal      -    fraud_signal
stg_sessions.player_id                          confidential  pii  fraud_signal
stg_sessions.device_id                          confidential  pii  fraud_signal
stg_sessions.ip_address                         confidential  pii  fraud_signal
stg_sessions.country_from_ip                    internal      -    fraud_signal
stg_login_events.login_id                       internal      -    fraud_signal
stg_login_events.player_id                      confidential  pii  fraud_signal
stg_login_events.device_id                      confidential  pii  fraud_signal
stg_login_events.ip_address                     confidential  pii  fraud_signal
stg_login_events.country_from_ip                internal      -    fraud_signal
stg_game_rounds.round_id                        internal      -    financial_aml
stg_game_rounds.player_id                       confidential  pii  financial_aml
stg_game_rounds.game_type                       public        -    financial_aml
stg_game_rounds.stake_amount                    confidential  -    financial_aml
stg_payments.payment_id                         internal      -    financial_aml
stg_payments.player_id                          confidential  pii  financial_aml
stg_payments.payment_type                       internal      -    financial_aml
stg_payments.amount_gbp                         confidential  -    financial_aml
stg_payments.card_bin                           confidential  pii  financial_aml
stg_payments.device_id                          confidential  pii  financial_aml
stg_bonuses.bonus_id                            internal      -    financial_aml
stg_bonuses.player_id                           confidential  pii  financial_aml
stg_bonuses.device_id                           confidential  pii  financial_aml
stg_fraud_ground_truth.scenario_type            internal      -    fraud_signal
stg_fraud_ground_truth.entity_id                confidential  pii  fraud_signal
stg_streaming_fraud_flags.entity_id             confidential  pii  fraud_signal
stg_streaming_fraud_flags.scenario_type         internal      -    fraud_signal
dim_players_scd2.player_dimension_key           internal      -    account_lifetime_plus_aml
dim_players_scd2.player_id                      confidential  pii  account_lifetime_plus_aml
dim_players_scd2.kyc_status                     restricted    pii  kyc_regulatory
dim_players_scd2.self_exclusion_status          restricted    pii  responsible_gambling
dim_players_scd2.risk_segment                   restricted    pii  kyc_regulatory
fct_player_ltv.player_id                        confidential  pii  financial_aml
fct_player_ltv.ltv_gbp                          confidential  -    financial_aml
fct_player_ltv.total_deposits_gbp               confidential  -    financial_aml
fct_churn_labels.player_id                      confidential  pii  account_lifetime_plus_aml
fct_churn_labels.self_exclusion_status_as_of    restricted    pii  responsible_gambling
fct_fraud_summary.scenario_type                 internal      -    fraud_signal
"""
