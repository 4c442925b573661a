"""Detection rules: the built-in pack and drop-in packs."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: The built-in pack (fixed values): one plain record per rule.
PACK = Path(__file__).with_name("rule_pack.json")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    languages: tuple[str, ...]
    cwe: str
    category: str
    confidence: str
    impact: str
    owasp: str
    pattern: str | None = None
    multiline: bool = False
    message: str = ""
    needles: tuple[str, ...] = ()


def built_in_rules(namespace: str = "") -> list[Rule]:
    """The pack; *namespace* is put before every rule id."""
    return [replace(r, rule_id=namespace + r.rule_id) for r in read_pack(PACK)]


def executable(rules: list[Rule]) -> list[Rule]:
    return [r for r in rules if r.pattern]


def read_pack(path: Path) -> list[Rule]:
    return [Rule(**{**d, "languages": tuple(d["languages"]), "needles": tuple(d.get("needles", ()))})
            for d in json.loads(path.read_text(encoding="utf-8"))]


def load_rules(directory: str) -> list[Rule]:
    """Drop-in packs: ``*.json`` files holding a list of rule objects. A pack is
    configuration, read once on the driver and compiled into the plan."""
    return [r for path in sorted(Path(directory).glob("*.json")) for r in read_pack(path)]


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame(
        [(r.rule_id, r.severity, list(r.languages), r.cwe, r.category, r.confidence,
          r.impact, r.owasp, r.pattern, r.multiline) for r in rules],
        "rule string, severity string, languages array<string>, cwe string,"
        "category string, confidence string, impact string, owasp string,"
        "pattern string, multiline boolean")
