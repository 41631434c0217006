"""Right to erasure, retention and column classification."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import pseudonym
from ..operators import durable, keep_first
from ..sources.versions import TableSet

AML_RETENTION_MONTHS = 60

# Identifiers without regulatory value of their own, and the tables kept in full with the reason.
HASHED_COLUMNS = {"sessions": ["ip_address"], "login_events": ["ip_address"]}
NULLED_COLUMNS = {"players": ["date_of_birth"]}
RETAINED_TABLES = {
    "payments": "AML transaction record-keeping (Money Laundering Regulations 2017, reg. 40)",
    "game_rounds": "gameplay/RTP audit trail (UK Gambling Commission LCCP requirement)",
    "bonuses": "bonus/promotional abuse audit trail",
    "player_attribute_history": "KYC status and self-exclusion history (regulatory record)",
    "fraud_ground_truth": "fraud/AML investigation record",
    "streaming_fraud_flags": "fraud/AML investigation record",
    "devices": "fraud-ring linkage evidence; device_id is an opaque fingerprint, not a direct identifier",
}
ENTITY_KEYED = ("fraud_ground_truth", "streaming_fraud_flags")

# Months of retention per category, counted from the end of the business relationship.
RETENTION_POLICY = {
    "financial_aml": (60, "Money Laundering Regulations 2017, reg. 40"),
    "kyc_regulatory": (60, "MLR 2017, reg. 40; UK Gambling Commission LCCP"),
    "responsible_gambling": (72, "LCCP social responsibility code provisions"),
    "fraud_signal": (60, "Legitimate interest in fraud/AML prevention (UK GDPR Art. 6(1)(f))"),
    "account_lifetime_plus_aml": (60, "MLR 2017, reg. 40"),
}
RAW_ARCHIVE_DAYS = 90

# Tiers from open to strict, and the governed columns that a model's other columns are made of.
TIERS = ("public", "internal", "confidential", "restricted")
LINEAGE = {
    "dim_players_scd2": {
        **{c: [f"stg_players.{c}"] for c in ("country", "currency", "acquisition_channel", "activity_segment", "signup_ts")},
        **{c: ["stg_player_attribute_history.effective_ts"] for c in ("valid_from", "valid_to", "is_current")},
        "vip_tier": ["stg_player_attribute_history.vip_tier"],
    },
}


class UnknownPlayerError(LookupError):
    pass


def unknown_players(requests: DataFrame, players: DataFrame) -> DataFrame:
    """Requested players that do not exist."""
    return requests.join(players, "player_id", "left_anti").select("player_id").distinct()


def check_requests(requests: DataFrame, players: DataFrame) -> None:
    """Refuse the whole batch before anything is written if a requested player does not exist.

    All such players are named; there are at most as many as requests, which people make one by one.
    """
    unknown = unknown_players(requests, players).collect()
    if unknown:
        raise UnknownPlayerError(f"not in players: {[r.player_id for r in unknown]}")


def erase_table(df: DataFrame, requests: DataFrame, hashed: list[str], nulled: list[str], salt: str) -> DataFrame:
    """One table with the requested players' identifiers pseudonymised or nulled; all other rows unchanged.

    One join for any number of requests. The requests are not hinted: AQE broadcasts them when they are small.
    """
    marked = df.join(requests.select("player_id").distinct().withColumn("_erase", F.lit(True)), "player_id", "left")
    changed: dict[str, Column] = {}
    for c in hashed:
        changed[c] = F.when(F.col("_erase"), pseudonym(c, salt)).otherwise(F.col(c))
    for c in nulled:
        changed[c] = F.when(F.col("_erase"), F.lit(None)).otherwise(F.col(c))
    return marked.withColumns(changed).select(*df.columns)


def erase(tables: Mapping[str, DataFrame], requests: DataFrame, salt: str) -> dict[str, DataFrame]:
    """The governed tables after erasure. Doing it again changes nothing."""
    return {
        name: erase_table(tables[name], requests, HASHED_COLUMNS.get(name, []), NULLED_COLUMNS.get(name, []), salt)
        for name in (*HASHED_COLUMNS, *NULLED_COLUMNS)
    }


def erase_dry_run(tables: Mapping[str, DataFrame], requests: DataFrame) -> DataFrame:
    """Per requested player and governed column, the values an erasure would touch."""
    wanted = requests.select("player_id").distinct()
    parts = []
    for name, columns in {**HASHED_COLUMNS, **NULLED_COLUMNS}.items():
        for column in columns:
            counts = (
                tables[name].filter(F.col(column).isNotNull()).groupBy("player_id").agg(F.count("*").alias("n"))
            )
            parts.append(
                wanted.join(counts, "player_id", "left").select(
                    "player_id", F.lit(f"{name}.{column}").alias("field"),
                    F.coalesce("n", F.lit(0)).alias("rows_affected"),
                )
            )
    return reduce(DataFrame.unionByName, parts)


def retained_row_counts(tables: Mapping[str, DataFrame], players: DataFrame) -> DataFrame:
    """Rows kept per player and retained table. Entity-keyed tables count their player-level rows only."""
    parts = []
    for name in RETAINED_TABLES:
        if name == "devices":
            continue
        df = tables[name]
        if name in ENTITY_KEYED:
            df = df.filter("entity_type = 'player'").select(F.col("entity_id").alias("player_id"))
        parts.append(df.groupBy("player_id").agg(F.count("*").alias("n")).withColumn("table_name", F.lit(name)))
    counts = reduce(DataFrame.unionByName, parts)
    names = [n for n in RETAINED_TABLES if n != "devices"]
    wide = counts.groupBy("player_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("table_name") == n, F.col("n"))), F.lit(0)).alias(n) for n in names]
    )
    return players.select("player_id").distinct().join(wide, "player_id", "left").na.fill(0, names)


def audit_rows(requests: DataFrame, salt: str, processed_at: str | None = None) -> DataFrame:
    """One audit record per request: who (pseudonymised), what changed, what was kept and why, and until when."""
    at = F.current_timestamp() if processed_at is None else F.lit(processed_at).cast("timestamp")
    fields = F.create_map(*[
        part for name, cols in {**HASHED_COLUMNS, **NULLED_COLUMNS}.items()
        for part in (F.lit(name), F.array(*map(F.lit, cols)))
    ])
    kept = F.create_map(*[F.lit(part) for pair in RETAINED_TABLES.items() for part in pair])
    who = pseudonym("player_id", salt)
    return requests.select("player_id").distinct().select(
        F.sha2(F.concat_ws("|", who, F.unix_micros(at).cast("string")), 256).substr(1, 32).alias("erasure_id"),
        who.alias("player_id_pseudonym"),
        at.alias("processed_at"),
        F.to_json(fields).alias("pseudonymised_fields"),
        F.to_json(kept).alias("retained_tables"),
        F.add_months(F.to_date(at), AML_RETENTION_MONTHS).alias("retention_expires_at"),
    )


AUDIT_LOG = "erasure_audit_log"


def run_erasure(spark: SparkSession, folder: str, requests: DataFrame, salt: str, processed_at: str | None = None) -> int:
    """Erase in the governed tables under ``folder`` and append to the audit log there, in one commit; its version.

    Only files with rows of requested players are rewritten. The new files and the audit records become live
    together (see ``sources.versions``): whoever reads the set sees an erasure with its record, or neither. The replaced
    files hold identifiers, so they are deleted right after, or, if that was cut short, before the next run does
    anything. Erasing what is erased changes no value, and is recorded again.
    """
    tables = TableSet(spark, folder)
    tables.clean()
    base = tables.version()[0]
    check_requests(requests, tables.read("players"))
    asked = requests.select("player_id").distinct()
    added, replaced = {}, {}
    for name in (*HASHED_COLUMNS, *NULLED_COLUMNS):
        touched = tables.files_with(name, asked)
        if touched:
            hashed, nulled = HASHED_COLUMNS.get(name, []), NULLED_COLUMNS.get(name, [])
            added[name] = tables.add(name, erase_table(tables.read(name, touched), asked, hashed, nulled, salt))
            replaced[name] = touched
    added[AUDIT_LOG] = tables.add(AUDIT_LOG, audit_rows(asked, salt, processed_at))
    version = tables.commit(base, added, replaced)
    tables.clean()
    return version


def audit_log(spark: SparkSession, folder: str) -> DataFrame:
    """The audit records of all erasures committed under ``folder``."""
    return TableSet(spark, folder).read(AUDIT_LOG)


def erasure_sample(dim: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One current player per (KYC, exclusion) status with what an erasure would change and keep."""
    columns = ["player_id", "vip_tier", "kyc_status", "self_exclusion_status", "risk_segment"]
    current = dim.filter("is_current").select(*columns)
    # A row per pair of statuses, read by every join below.
    picked = durable(keep_first(current, ["kyc_status", "self_exclusion_status"], ["player_id"]))
    touched = erase_dry_run(tables, picked).groupBy("player_id").agg(
        *[
            F.sum(F.when(F.col("field") == f"{n}.{c}", F.col("rows_affected"))).alias(f"{n}_{c}")
            for n, cols in {**HASHED_COLUMNS, **NULLED_COLUMNS}.items() for c in cols
        ]
    )
    ip = tables["sessions"].join(picked.select("player_id"), "player_id", "left_semi").groupBy("player_id").agg(
        F.min("ip_address").alias("sample_ip_address")
    )
    born = tables["players"].join(picked.select("player_id"), "player_id", "left_semi").groupBy("player_id").agg(
        F.min("date_of_birth").alias("date_of_birth")
    )
    return (
        picked.join(ip, "player_id", "left").join(born, "player_id", "left")
        .join(touched, "player_id", "left").join(retained_row_counts(tables, picked), "player_id", "left")
    )


# Classification ---------------------------------------------------------------------------------------------------


def classification() -> dict[str, dict[str, dict]]:
    """Model -> column -> metadata."""
    out: dict[str, dict[str, dict]] = {}
    for line in schemas.CLASSIFICATION.strip().splitlines():
        name, tier, pii, category = line.split()
        model, column = name.split(".")
        out.setdefault(model, {})[column] = {
            "classification": tier, "pii": pii == "pii", "retention_category": category,
        }
    return out


def classified(df: DataFrame, model: str) -> DataFrame:
    """Attach each governed column's metadata to the frame itself; it survives writing and renaming."""
    meta = classification().get(model, {})
    return df.select(*[F.col(c).alias(c, metadata=meta[c]) if c in meta else F.col(c) for c in df.columns])


def catalogue(spark: SparkSession, models: Mapping[str, DataFrame]) -> DataFrame:
    """Governed columns of the given frames, read back from their schemas."""
    rows = [
        (
            model, f.name, f.metadata.get("classification", "unclassified"), bool(f.metadata.get("pii", False)),
            f.metadata.get("retention_category", "unspecified"),
        )
        for model, df in models.items() for f in df.schema.fields if f.metadata
    ]
    return spark.createDataFrame(
        rows, "model string, column_name string, classification string, pii boolean, retention_category string"
    )


def populated_values(models: Mapping[str, DataFrame]) -> DataFrame:
    """How many values each governed column holds: one aggregation per model, no shuffle of its rows."""
    parts = []
    for model, df in models.items():
        governed = [f.name for f in df.schema.fields if f.metadata]
        counts = df.agg(*[F.count(c).alias(c) for c in governed])
        parts.append(counts.unpivot([], governed, "column_name", "populated").withColumn("model", F.lit(model)))
    return reduce(DataFrame.unionByName, parts)


def classified_columns(spark: SparkSession, models: Mapping[str, DataFrame]) -> DataFrame:
    """The catalogue with the amount of data under each column."""
    columns = catalogue(spark, models)
    return F.broadcast(columns).join(populated_values(models), ["model", "column_name"])  # a row per governed column


def classification_rollup(columns: DataFrame) -> DataFrame:
    return columns.groupBy("classification", "retention_category").agg(
        F.count("*").alias("columns"), F.count_if("pii").alias("pii_columns"), F.sum("populated").alias("populated")
    )


def retention_schedule(spark: SparkSession, columns: DataFrame) -> DataFrame:
    """Each governed column with its retention period and legal basis."""
    policy = spark.createDataFrame(
        [(category, months, basis) for category, (months, basis) in RETENTION_POLICY.items()],
        "retention_category string, retention_months int, basis string",
    )
    return columns.join(F.broadcast(policy), "retention_category", "left")  # five rows


def retention_due(df: DataFrame, category: str, closed: str) -> DataFrame:
    """When each row may be deleted, given the date its business relationship ended."""
    months = RETENTION_POLICY[category][0]
    return df.withColumn("retention_due", F.add_months(F.to_date(closed), months))


def expired_days(archive: DataFrame, today: str, ts: str = "ts") -> DataFrame:
    """Days of the raw event archive that are past its 90-day life, with the events in them."""
    day = F.to_date(ts)
    return (
        archive.groupBy(day.alias("day")).agg(F.count("*").alias("events"))
        .filter(F.col("day") < F.date_sub(F.lit(today).cast("date"), RAW_ARCHIVE_DAYS))
    )


def _tier(model: str, column: str) -> str | None:
    """A column's own tier, or else the strictest of the columns it is made of; None if one of those has none."""
    own = classification().get(model, {}).get(column)
    if own:
        return own["classification"]
    found = [_tier(*name.split(".")) for name in LINEAGE.get(model, {}).get(column, ())]
    return max(found, key=TIERS.index) if found and None not in found else None


def general_view(df: DataFrame, model: str) -> DataFrame:
    """What the general BI layer may see of a model: every column that is not restricted.

    Columns without a tier of their own have that of the columns they are made of (``LINEAGE``). A column that nobody
    has classified yet, there or here, stays hidden.
    """
    frame = classified(df, model)
    return frame.select(*[F.col(f"`{c}`") for c in frame.columns if _tier(model, c) not in (None, "restricted")])
