"""Registry of queries and the stand-in views both engines share.

A view is SQL text that Spark and DuckDB read alike; ``@name`` stands for a base
table. Every view derives from whole tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
VIEWS: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VIEWS["v_scans"] = """
SELECT o_orderkey AS scan_id, o_custkey AS project_id, o_orderdate AS created_at,
       o_orderstatus AS status FROM @orders"""
VIEWS["v_findings"] = """
SELECT l_orderkey AS scan_id,
  concat(l_orderkey,'-',l_linenumber,'-',l_partkey,'-',l_suppkey) AS finding_id,
  concat('issue type ', l_partkey % 3) AS title,
  CASE WHEN l_quantity<=5 THEN 'critical' WHEN l_quantity<=15 THEN 'high'
       WHEN l_quantity<=30 THEN 'medium' WHEN l_quantity<=43 THEN 'low' ELSE 'info' END AS severity,
  l_discount*10 AS confidence,
  CASE l_suppkey % 6 WHEN 0 THEN 'semgrep' WHEN 1 THEN 'sonarqube' WHEN 2 THEN 'ai'
       WHEN 3 THEN 'correlated' WHEN 4 THEN 'access' ELSE 'dast' END AS source,
  CASE WHEN l_returnflag='R' THEN 'dismissed' WHEN l_returnflag='A' THEN 'confirmed'
       WHEN l_linestatus='O' THEN 'proposed' ELSE 'needs_info' END AS state,
  CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE concat('CWE-', 70 + l_partkey % 3) END AS cwe,
  CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE concat('cat', l_suppkey % 4) END AS category,
  concat('src/f', l_partkey % 5, '.py') AS file_path,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity AS INT) END AS line_start,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity AS INT) + l_linenumber END AS line_end,
  concat('rev', l_suppkey % 3) AS reviewed_by,
  CASE WHEN l_suppkey % 4 = 0 THEN concat('R', l_partkey % 4) END AS rule,
  CASE WHEN l_suppkey % 6 = 4 THEN concat(CASE l_partkey % 3 WHEN 0 THEN 'get' WHEN 1 THEN 'POST'
       ELSE 'ANY' END, ' /res', l_partkey % 25, CASE l_suppkey % 2 WHEN 0 THEN '/{id}' ELSE '/:key/' END) END AS endpoint,
  CASE WHEN l_linenumber % 2 = 0 THEN concat('call_', l_partkey % 9, '(x)') END AS code_snippet,
  CASE WHEN l_suppkey % 9 = 0 THEN concat('why ', l_partkey % 5) END AS human_question,
  CAST(NULL AS VARCHAR(10)) AS triage_note
FROM @lineitem"""
VIEWS["v_files"] = """
SELECT doc_id, source AS artifact_id,
  concat(CASE doc_id % 10 WHEN 0 THEN 'pkg/tests/' WHEN 1 THEN 'vendor/lib/'
         WHEN 2 THEN 'app/dist/' ELSE 'app/core/' END, 'd', doc_id,
         CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.java' WHEN 'fr' THEN '.min.js' ELSE '.txt' END) AS path,
  text AS content, n_chars AS size_bytes FROM @documents"""
VIEWS["v_events"] = """
SELECT event_id, user_id AS scan_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'status' WHEN 'click' THEN 'stage'
       WHEN 'view' THEN 'token' ELSE 'log' END AS type,
  concat('stage', event_id % 16) AS stage, value, props FROM @events"""
VIEWS["v_responses"] = """
SELECT event_id, CAST(floor(event_id / 4) AS BIGINT) AS finding_id,
  CASE user_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'userA' WHEN 2 THEN 'userB' ELSE 'admin' END AS role,
  CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 403 WHEN 'purchase' THEN 201 WHEN 'signup' THEN 401 ELSE 500 END AS status,
  substring(md5(concat(event_type, event_id % 3)), 1, 16) AS body_hash, value AS elapsed_ms, ts FROM @events"""


def view_names(sql: str) -> list[str]:
    """Views a text needs, dependencies first."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_[a-z_]+\b", text):
            if name in VIEWS and name not in out:
                visit(VIEWS[name])
                out.append(name)

    visit(sql)
    return out


def with_views(sql: str) -> str:
    names = view_names(sql)
    if not names:
        return sql
    head = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark_sql(spark, sf, f"SELECT * FROM {name}")


def spark_sql(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    text = with_views(sql)
    return spark.sql(re.sub(r"@(\w+)", lambda m: f"parquet.`{sf}/{m.group(1)}.parquet`"
                            if m.group(1) in TABLES else m.group(0), text))


def duck_sql(sql: str) -> str:
    return re.sub(r"@(\w+)", lambda m: m.group(1) if m.group(1) in TABLES else m.group(0),
                  with_views(sql))


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = duck_sql(sql)
        return fn
    return register


def quoted(pattern: str) -> str:
    """A pattern as a SQL string literal."""
    return "'" + pattern.replace("'", "''") + "'"
