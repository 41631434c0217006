"""The models wired together over one set of raw tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import durable
from ..schemas import RAW
from ..sources import events as ev
from ..sources.raw import fx_rates, read_raw
from . import marts, rules, staging
from .governance import classification, classified


class RawTables:
    """Raw tables found under one or more folders, by attribute."""

    def __init__(self, spark: SparkSession, *dirs: str):
        self.spark = spark
        self.dirs = list(dirs)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        found = read_raw(self.spark, self.dirs, name)
        if found is None:
            raise FileNotFoundError(f"{name}.parquet is in none of {self.dirs}")
        setattr(self, name, found)
        return found

    def has(self, name: str) -> bool:
        return read_raw(self.spark, self.dirs, name) is not None


@dataclass(frozen=True)
class Thresholds:
    """Arguments of the models that scale with the data at hand. The defaults are the production values."""

    bot_min_gaps: int = 100
    bot_max_sd: float = 0.3
    churn_window_days: int = 28
    rules: dict[str, dict] = field(default_factory=dict)


class Warehouse:
    """Models by attribute, each built on first use from those it reads. Only :meth:`share` starts jobs."""

    def __init__(self, raw, thresholds: Thresholds = Thresholds(), fx_path: str | None = None):
        self.raw = raw
        self.spark: SparkSession = raw.spark
        self.at = thresholds
        self.fx_path = fx_path
        self._shared: set[str] = set()
        self.written = False  # set once all models are tables, after which there is nothing left to share

    def share(self, *models: str) -> Warehouse:
        """Write models once that several parts of one query read. Runs a job per model not yet shared."""
        for model in models:
            if model not in self._shared and not self.written:
                setattr(self, model, durable(getattr(self, model), model))
                self._shared.add(model)
        return self

    @cached_property
    def fx(self) -> DataFrame:
        return fx_rates(self.spark, self.fx_path)

    @cached_property
    def stg_players(self) -> DataFrame:
        return staging.stg_players(self.raw.players)

    @cached_property
    def stg_devices(self) -> DataFrame:
        return staging.stg_devices(self.raw.devices)

    @cached_property
    def stg_player_attribute_history(self) -> DataFrame:
        return staging.stg_player_attribute_history(self.raw.player_attribute_history)

    @cached_property
    def stg_sessions(self) -> DataFrame:
        return staging.stg_sessions(self.raw.sessions)

    @cached_property
    def stg_login_events(self) -> DataFrame:
        return staging.stg_login_events(self.raw.login_events)

    @cached_property
    def stg_game_rounds(self) -> DataFrame:
        return staging.stg_game_rounds(self.raw.game_rounds)

    @cached_property
    def stg_payments(self) -> DataFrame:
        return staging.stg_payments(self.raw.payments, self.fx)

    @cached_property
    def stg_bonuses(self) -> DataFrame:
        return staging.stg_bonuses(self.raw.bonuses)

    @cached_property
    def stg_fraud_ground_truth(self) -> DataFrame:
        return staging.stg_fraud_ground_truth(self.raw.fraud_ground_truth)

    @cached_property
    def stg_streaming_fraud_flags(self) -> DataFrame:
        return staging.stg_streaming_fraud_flags(self.raw.streaming_fraud_flags)

    @cached_property
    def session_stats(self) -> DataFrame:
        return marts.session_stats(self.stg_game_rounds, self.at.bot_min_gaps, self.at.bot_max_sd)

    @cached_property
    def session_activity(self) -> DataFrame:
        return marts.session_activity(self.stg_sessions, self.session_stats)

    @cached_property
    def bot_sessions(self) -> DataFrame:
        return marts.bot_sessions(self.session_stats)

    @cached_property
    def player_daily_activity(self) -> DataFrame:
        return marts.player_daily_activity(self.session_activity, self.stg_payments)

    @cached_property
    def dim_players_scd2(self) -> DataFrame:
        return marts.dim_players_scd2(self.stg_player_attribute_history, self.stg_players)

    @cached_property
    def player_ltv(self) -> DataFrame:
        return marts.player_ltv(self.stg_players, self.player_daily_activity)

    @cached_property
    def churn_labels(self) -> DataFrame:
        return marts.churn_labels(
            self.player_daily_activity, self.dim_players_scd2, self.stg_players, self.at.churn_window_days
        )

    @cached_property
    def fraud_summary(self) -> DataFrame:
        return marts.fraud_summary(self.stg_fraud_ground_truth, self.stg_streaming_fraud_flags)

    @cached_property
    def self_exclusion_registry(self) -> DataFrame:
        return marts.self_exclusion_registry(self.raw.player_attribute_history)

    @cached_property
    def events(self) -> DataFrame:
        raw = self.raw
        return ev.unified_events(raw.login_events, raw.payments, raw.bonuses, raw.game_rounds, self.fx)

    @cached_property
    def flags(self) -> DataFrame:
        return rules.run_rules(self.events, self.self_exclusion_registry, self.at.rules)

    def governed_models(self) -> dict[str, DataFrame]:
        """Models by the name the classification knows them under, with its metadata attached."""
        marts = {"fct_player_ltv": "player_ltv", "fct_churn_labels": "churn_labels", "fct_fraud_summary": "fraud_summary"}
        return {m: classified(getattr(self, marts.get(m, m)), m) for m in classification()}
