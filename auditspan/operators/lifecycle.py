"""Replacing and removing parts of the finding and scan tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_sources(old: DataFrame, new: DataFrame, sources, keys=("scan_id",)) -> DataFrame:
    """The table after a set of sources was replaced in the scans of *new*; scans
    that are not re-run keep everything (S24)."""
    touched = new.select(*keys).distinct()
    hit = old.where(F.col("source").isin(*sources))
    keep = old.where(~F.col("source").isin(*sources)).unionByName(
        hit.join(touched, list(keys), "left_anti").select(*old.columns))
    return keep.unionByName(new.select(*old.columns))


def cascade(clients_gone: DataFrame, projects: DataFrame, artifacts: DataFrame,
            scans: DataFrame, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Rows that go when clients are deleted, per table."""
    p = projects.join(clients_gone.select("client_id"), "client_id", "left_semi")
    a = artifacts.join(p.select("project_id"), "project_id", "left_semi")
    s = scans.join(p.select("project_id"), "project_id", "left_semi")
    gone = {"projects": p, "artifacts": a, "scans": s}
    for name, table in children.items():
        gone[name] = table.join(s.select("scan_id"), "scan_id", "left_semi")
    return gone


def remaining(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")


def targeted_files(files: DataFrame, candidates: DataFrame, endpoints: DataFrame,
                   keys=("artifact_id",)) -> DataFrame:
    """Files a candidate, an endpoint or a handler mentions; artifacts without any
    mention keep all their files (J20, U3)."""
    keys = list(keys)
    named = lambda df, c: df.select(*keys, F.col(c).alias("path"))
    focus = named(candidates, "file_path").unionByName(
        named(endpoints, "file_path")).unionByName(named(endpoints, "handler_file")) \
        .where("path is not null and path <> ''").distinct()
    some = focus.select(*keys).distinct()
    return files.join(focus, [*keys, "path"], "left_semi").unionByName(
        files.join(some, keys, "left_anti").select(*files.columns))


def guard_members(members: DataFrame, keys=("archive",), order: str = "ord",
                  max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Archive members with the first limit each one breaks.

    Links and directories are skipped. Counts and sizes run in member order, cut
    into blocks of the order column so one archive may be arbitrarily long.
    """
    from ..functions import fixed, paths
    from .ordered import running_totals
    max_files = fixed.MAX_EXTRACT_FILES if max_files is None else max_files
    max_bytes = fixed.MAX_EXTRACT_BYTES if max_bytes is None else max_bytes
    rows = running_totals(members.where("kind = 'file'"), keys, [F.col(order)],
                          F.floor(F.col(order) / 100_000), n=F.lit(1),
                          total_bytes=F.col("size"))
    return rows.withColumn("violation", F.when(F.col("n") > max_files, "file count")
                           .when(F.col("total_bytes") > max_bytes, "extracted size")
                           .when(paths.escapes_root(F.col("member")), "path escape"))
