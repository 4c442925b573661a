"""File trees and stored tables as DataFrames."""

from __future__ import annotations

import os
import sys
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import labels, paths
from ..operators.ordered import pin

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def tree_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, uri, size_bytes) of every file under *root*, hidden names included, links
    left out, pruned folders never entered.

    Tasks list the folders of one level at a time, so the driver holds no listing; only
    the number of folders of a level comes back.
    """
    def listing(batches):
        from pyarrow import fs
        for batch in batches:
            for folder, below in zip(batch.column("uri").to_pylist(), batch.column("path").to_pylist(), strict=True):
                store, place = fs.FileSystem.from_uri(folder)
                found = [x for x in store.get_file_info(fs.FileSelector(place))
                         if store.type_name != "local" or not os.path.islink(x.path)]
                names = [f"{below}/{x.base_name}" if below else x.base_name for x in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()),
                     pa.array([f"{folder.rstrip('/')}/{quote(x.base_name)}" for x in found], pa.string()),
                     pa.array([x.size for x in found], pa.int64()),
                     pa.array([x.type == fs.FileType.Directory for x in found], pa.bool_())],
                    names=["path", "uri", "size_bytes", "folder"])

    uri = root if "://" in root else Path(root).resolve().as_uri()
    level = spark.createDataFrame([("", uri)], "path string, uri string")
    files = None
    while True:
        seen = pin(level.repartition("uri").mapInArrow(
            listing, "path string, uri string, size_bytes long, folder boolean")
            .where(~F.when(F.col("folder"), paths.is_pruned(F.concat("path", F.lit("/x")))).otherwise(
                paths.is_pruned(F.col("path")))))
        here = seen.where("NOT folder").select("path", "uri", "size_bytes")
        files = here if files is None else files.unionByName(here)
        level = seen.where("folder").select("path", "uri")
        if not level.limit(1).count():
            return files


def source_tree(spark: SparkSession, root: str | None, artifact_id: str, cap: int | None = None,
                manifest: DataFrame | None = None) -> DataFrame:
    """Files of a tree: path, size_bytes, content, artifact_id.

    A stored *manifest* (path, uri, size_bytes) is the source at scale; else *root* is
    listed. Contents are read once, by the tasks; files beyond *cap* bytes, if given, are
    listed with NULL content and never opened.
    """
    def fetch(batches):
        from pyarrow import fs
        for batch in batches:
            for k, (uri, size) in enumerate(zip(batch.column("uri").to_pylist(),
                                                batch.column("size_bytes").to_pylist(), strict=True)):
                data = None
                if cap is None or size <= cap:
                    store, place = fs.FileSystem.from_uri(uri)
                    with store.open_input_stream(place) as stream:
                        data = stream.read()
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays(
                    [one.column("path"), one.column("size_bytes"), pa.array([data], pa.binary())],
                    names=["path", "size_bytes", "content"])

    listed = tree_manifest(spark, root) if manifest is None else manifest.where(~paths.is_pruned(F.col("path")))
    read = listed.select("path", "uri", "size_bytes").mapInArrow(
        fetch, "path string, size_bytes long, content binary")
    return read.withColumn("artifact_id", F.lit(artifact_id))


def as_text(files: DataFrame) -> DataFrame:
    """Readable files with decoded content (invalid bytes become U+FFFD)."""
    readable = files.where(F.col("content").isNotNull()
                           & ~paths.is_binary(F.col("content"), 1024))
    return readable.withColumn("content", F.decode("content", "UTF-8"))


def archives(files: DataFrame) -> DataFrame:
    """Files that are archives by name or magic bytes."""
    head = F.hex(F.substring(F.col("content").cast("binary"), 1, 8))
    return files.where(paths.is_archive(F.col("path"), head))


def findings_of(spark: SparkSession, table: str, scan_ids=None, severity: str | None = None):
    """Stored findings, pruned by scan and severity, critical first."""
    rows = spark.read.schema(schema.FINDING).parquet(table)
    if scan_ids is not None:
        rows = rows.where(F.col("scan_id").isin(list(scan_ids)))
    if severity is not None:
        rows = rows.where(F.col("severity") == severity)
    return rows.orderBy(labels.severity_rank(F.col("severity"), 99), "finding_id")


def events_after(spark: SparkSession, table: str, last_seq: int = 0) -> DataFrame:
    """Events behind an offset (batch replay, S14)."""
    return spark.read.schema(schema.EVENT).parquet(table).where(F.col("seq") > last_seq)


def event_stream(spark: SparkSession, table: str, files_per_batch: int = 100) -> DataFrame:
    """The same log followed as a stream; the checkpoint keeps the offset (R2)."""
    return (spark.readStream.schema(schema.EVENT)
            .option("maxFilesPerTrigger", files_per_batch).parquet(table))


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """Freeze an input table so that a resumed run sees identical rows."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
