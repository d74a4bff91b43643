"""Semantic type of each column, decided from the counts the profile scan gathered."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.names import words
from plumbline.functions.scalars import BOOLEAN_PAIRS
from plumbline.operators.profile import Profile, profile
from plumbline.sources.tables import Table

DETECTION_SCHEMA = (
    "column_name string, storage_type string, detected_type string, confidence double, "
    "evidence string, status string, recommended_action string"
)

# Name words of keys, and storage types each semantic type may be stored in.
ID_WORDS = {"id", "key", "pk", "fk", "code", "number", "no", "num"}
FITTING_STORAGE = {
    "Integer": ("int", "int64", "int32", "int16", "int8", "uint"),
    "Decimal": ("float", "float64", "float32", "decimal"),
    "Boolean": ("bool", "boolean"),
    "Date": ("datetime", "datetime64", "date"),
    "DateTime": ("datetime", "datetime64"),
    "String": ("object", "string", "str"),
    "Category": ("object", "string", "str", "category"),
    "ID": ("object", "string", "str", "int", "int64"),
    "Email": (),
    "Phone": (),
    "URL": (),
    "Currency": ("float", "float64"),
    "Percentage": ("float", "float64"),
}
# What is reported as evidence of each type.
EVIDENCE = {
    "Email": "email pattern match",
    "URL": "URL pattern match",
    "Phone": "phone pattern match",
    "Boolean": "boolean value set",
    "DateTime": "datetime with time component",
    "Date": "date-only values",
    "Integer": "whole numbers only",
    "Percentage": "% symbol or 0-100 numeric",
    "ID": "high-cardinality key-like column",
    "Currency": "currency pattern or 2-decimal numeric",
    "Category": "low cardinality",
    "Decimal": "mostly numeric with decimals",
    "String": "fallback for any string data",
    "Unknown": "All values are null",
}
TENTATIVE = {"Decimal", "String", "Category", "ID"}


@dataclass
class TypeDetection:
    column_name: str
    storage_type: str
    detected_type: str
    confidence: float
    evidence: str
    status: str
    recommended_action: str


def semantic_type(
    name: str, kind: str, integral: bool, facts: dict[str, Any], min_parse_rate: float = 0.0
) -> str:
    """First type, most specific first, whose test the counts pass.

    ``min_parse_rate`` is the share of values that must parse before a column counts as Date, DateTime
    or Integer; at 0 one parseable value is enough.
    """
    nn, unique = facts["nn"], facts["unique"]
    if not nn:
        return "Unknown"

    def share(key: str, of: str | None = None) -> float:
        base = facts.get(of, 0) if of else nn
        return facts.get(key, 0) / base if base else 0.0

    parsed_dates = facts.get("ts", 0)
    dates = kind != "number" and parsed_dates > 0 and parsed_dates / nn >= min_parse_rate
    all_midnight = facts.get("midnight", 0) == parsed_dates
    numbers = nn if integral else facts.get("num", 0)
    whole = numbers > 0 and numbers / nn >= min_parse_rate and (integral or facts["whole"] == numbers)
    ratio = unique / nn
    marked = facts.get("marked", 0) > 0 and share("percent") >= 0.8
    tests = {
        "Email": share("email") >= 0.8,
        "URL": share("url") >= 0.8,
        "Phone": share("phone") >= 0.7,
        "Boolean": kind == "flag" or 0 < (facts.get("pairs") or 0) < 1 << len(BOOLEAN_PAIRS),
        "DateTime": dates and not all_midnight,
        "Date": dates and all_midnight,
        "Integer": whole,
        "Percentage": marked or share("pin", "pnum") >= 0.9,
        "ID": bool(ID_WORDS.intersection(words(name))) and ratio > 0.95,
        "Currency": share("currency") >= 0.7 or share("cents", "num") >= 0.8,
        "Category": ratio < 1 and (unique <= 20 and ratio <= 0.8 or ratio < 0.05),
        "Decimal": numbers / nn > 0.8,
    }
    return next((t for t, hit in tests.items() if hit), "String")


def confidence_of(detected: str) -> float:
    if detected == "Unknown":
        return 0.0
    return 0.7 if detected in TENTATIVE else 0.95


def status_and_action(storage: str, detected: str, confidence: float) -> tuple[str, str]:
    # The three statuses and their sentences.
    if confidence < 0.7:
        return "AMBIGUOUS", "Manual review required - low confidence detection"
    if any(part in storage.lower() for part in FITTING_STORAGE.get(detected, ())):
        return "OK", "No action needed"
    return "MISMATCH", f"Convert from {storage} to {detected}"


def detect_types(
    table: Table, profiled: Profile | None = None, min_parse_rate: float = 0.0
) -> list[TypeDetection]:
    profiled = profiled or profile(table)
    out = []
    for c in table.columns:
        facts = profiled.evidence[c.name]
        integral = c.storage.startswith("int")
        kind = semantic_type(c.name, c.kind, integral, facts, min_parse_rate)
        confidence = confidence_of(kind)
        status, action = status_and_action(c.storage, kind, confidence)
        out.append(TypeDetection(c.name, c.storage, kind, confidence, EVIDENCE[kind], status, action))
    return out


def detections_frame(spark: SparkSession, detections: list[TypeDetection]) -> DataFrame:
    return spark.createDataFrame([vars(d) for d in detections], DETECTION_SCHEMA)
