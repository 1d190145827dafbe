"""Schemas of the layers, and checks that need no data."""

from __future__ import annotations

from pyspark.sql import types as T

# Field and decision names.
FIELDS = ("OPEN", "HIGH", "LOW", "CLOSE", "ADJ_CLOSE", "VOLUME", "SHARES")
PRICE_FIELDS = ("OPEN", "HIGH", "LOW", "CLOSE", "ADJ_CLOSE")
DECISIONS = ("INGEST", "CONTRACT", "DQ", "CORP_ACTION", "RECONCILE", "REMEDIATE", "ESCALATE")
# Topics of the event log.
TOPICS = (
    "run.started", "run.complete", "ingestion.complete", "ingestion.failed", "contract.violation", "contract.passed", "dq.failure", "dq.passed",
    "anomaly.detected", "corporate_action.detected", "reconciliation.complete", "reconciliation.break", "remediation.refetch_requested",
    "remediation.started", "remediation.complete", "remediation.failed", "escalation", "lineage.decision", "reference_data.complete",
)
#: Wide feed columns and the fields that they become.
WIDE_FIELDS = {"Open": "OPEN", "High": "HIGH", "Low": "LOW", "Close": "CLOSE", "Adj Close": "ADJ_CLOSE", "Volume": "VOLUME"}


_TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "decimal": T.DecimalType(28, 6),
    "strings": T.ArrayType(T.StringType()),
    "doubles": T.MapType(T.StringType(), T.DoubleType()),
    "counts": T.MapType(T.StringType(), T.LongType()),
}


def _struct(text: str) -> T.StructType:
    """A schema from ``name type`` pairs; made without a session, so that importing needs none."""
    pairs = (pair.strip().rsplit(" ", 1) for pair in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


BRONZE = _struct("Date timestamp, Open double, High double, Low double, Close double, Adj Close double, Volume bigint, instrument_id string, source_symbol string, fetch_ts timestamp")
SILVER = _struct("instrument_id string, business_date date, field string, value double, currency string, source_id string, source_symbol string, fetch_ts timestamp, event_ts timestamp, content_hash string, ca_adjusted boolean")
GOLD = _struct("instrument_id string, business_date date, field string, golden_value decimal, confidence string, quorum_sources strings, dissenting_sources strings, tolerance_band string, currency string, decision_id string")
DECISIONS_LOG = _struct("decision_id string, ts timestamp, agent string, instrument_id string, business_date date, decision_type string, inputs doubles, outcome string, rule_applied string, verified boolean")
SCORECARD = _struct("run_id string, business_date date, source_id string, records_ingested bigint, dq_failures_by_rule counts, breaks_detected bigint, remediations_attempted bigint, remediations_succeeded bigint, escalations bigint, corporate_actions_detected bigint, overall_status string")
EVENTS = _struct("event_id string, topic string, ts timestamp, agent string, run_id string, payload string")
KEYS = ("instrument_id", "business_date", "field")


def missing_columns(columns: list[str], required: list[str]) -> list[str]:
    """Required columns that are absent, in the order required: schema drift, known before anything runs."""
    return [c for c in required if c not in columns]
