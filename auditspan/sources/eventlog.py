"""The event log as a data source with offsets: ``spark.read`` and ``spark.readStream`` of
``audit_events``, from any sequence number on.

A log is a folder of Parquet files, dealt by scan to slots and sorted by (scan_id, seq). A stream
follows one scan; its offset is the last sequence number it handed out, so the checkpoint alone says where to go on,
and a range of numbers always reads the same events.
"""

from __future__ import annotations

import json
import sys
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .. import schema as layouts

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT, SLOTS = "audit_events", 32
ROWS_PER_TASK = 100_000
NAMES = tuple(layouts.EVENT.names)


def append_events(events: DataFrame, path: str, slots: int = SLOTS) -> None:
    """Appends events (the columns of ``schema.EVENT``; missing ones are null) to the log. Later events of a scan have larger numbers."""
    rows = events.select(*[(F.col(f.name) if f.name in events.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                           for f in layouts.EVENT])
    slot = F.pmod(F.crc32(F.col("scan_id").cast("binary")), F.lit(slots)).cast("int")
    rows = rows.withColumn("slot", slot).repartitionByRange("slot", "scan_id", "seq").sortWithinPartitions("slot", "scan_id", "seq")
    rows.write.mode("append").partitionBy("slot").parquet(path)


def _dataset(path: str, scan_id: str | None, slots: int):
    """The files of a log, of one slot if a scan is named; None before the first append."""
    where = path if scan_id is None else f"{path.rstrip('/')}/slot={zlib.crc32(scan_id.encode()) % slots}"
    system, root = fs.FileSystem.from_uri(where) if "://" in where or where.startswith("file:") else (fs.LocalFileSystem(), where)
    if system.get_file_info(root).type == fs.FileType.NotFound:
        return None
    return ds.dataset(root, filesystem=system, format="parquet", exclude_invalid_files=False)


def _wanted(scan_id: str | None, after: int, upto: int | None = None):
    found = ds.field("seq") > after
    if upto is not None:
        found &= ds.field("seq") <= upto
    return found if scan_id is None else found & (ds.field("scan_id") == scan_id)


@dataclass
class Piece(InputPartition):
    """Events with after < seq <= upto, of one file or of the whole slot."""

    after: int
    upto: int | None = None
    file: str | None = None


class _Options:
    def __init__(self, options):
        self.path = options["path"]
        self.scan_id = options.get("scan_id")
        self.after = int(options.get("after", 0))
        self.slots = int(options.get("slots", SLOTS))
        self.rows = int(options.get("rows_per_task", ROWS_PER_TASK))

    def batches(self, files, piece: Piece):
        for batch in files.to_batches(columns=list(NAMES), filter=_wanted(self.scan_id, piece.after, piece.upto)):
            if batch.num_rows:
                # timestamps as Spark takes them: microseconds in UTC
                at = batch.schema.get_field_index("ts")
                yield batch.set_column(at, "ts", batch.column(at).cast(pa.timestamp("us", "UTC")))


class EventReader(_Options, DataSourceReader):
    """One task a file; files and row groups without wanted numbers are skipped by their statistics."""

    def partitions(self):
        files = _dataset(self.path, self.scan_id, self.slots)
        return [Piece(self.after, None, f) for f in (files.files if files else [])] or [Piece(self.after)]

    def read(self, partition: Piece):
        if partition.file is not None:
            whole = _dataset(self.path, self.scan_id, self.slots)
            yield from self.batches(ds.dataset(partition.file, filesystem=whole.filesystem, format="parquet"), partition)


class EventStream(_Options, DataSourceStreamReader):
    """Follows one scan from a sequence number on."""

    def __init__(self, options):
        super().__init__(options)
        if self.scan_id is None:
            raise ValueError("a stream follows one scan: set the option scan_id")

    def initialOffset(self) -> dict:
        return {"seq": self.after}

    def latestOffset(self) -> dict:
        files = _dataset(self.path, self.scan_id, self.slots)
        last = self.after
        if files is not None:
            for batch in files.to_batches(columns=["seq"], filter=_wanted(self.scan_id, last)):
                last = max([last, *batch.column("seq").to_pylist()[-1:]]) if _ordered(batch) else max([last, *batch.column("seq").to_pylist()])
        return {"seq": last}

    def partitions(self, start: dict, end: dict):
        cuts = [*range(start["seq"], end["seq"], self.rows), end["seq"]]
        return [Piece(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def read(self, partition: Piece):
        files = _dataset(self.path, self.scan_id, self.slots)
        if files is not None:
            yield from self.batches(files, partition)

    def commit(self, end: dict) -> None:
        """Nothing to do: the log keeps its events, the checkpoint keeps the offset."""


def _ordered(batch: pa.RecordBatch) -> bool:
    seq = batch.column("seq").to_numpy()
    return bool((seq[1:] >= seq[:-1]).all())


class EventLog(DataSource):
    """Options: path, scan_id (needed by streams), after (0), slots, rows_per_task."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        return layouts.EVENT

    def reader(self, schema):
        return EventReader(self.options)

    def streamReader(self, schema):
        return EventStream(self.options)


def events_after(spark: SparkSession, path: str, after: int = 0, scan_id: str | None = None) -> DataFrame:
    """Events behind a sequence number, of one scan or of each."""
    spark.dataSource.register(EventLog)
    options = {"path": path, "after": str(after)} | ({} if scan_id is None else {"scan_id": scan_id})
    return spark.read.format(FORMAT).options(**options).load()


def event_stream(spark: SparkSession, path: str, scan_id: str, after: int = 0) -> DataFrame:
    """The events of a scan as they are appended, from a sequence number on; a restarted query goes on at its checkpoint (R2)."""
    spark.dataSource.register(EventLog)
    return spark.readStream.format(FORMAT).options(path=path, scan_id=scan_id, after=str(after)).load()


def offset_of(checkpoint_offset: str) -> int:
    """The sequence number in an offset as Spark writes it."""
    return int(json.loads(checkpoint_offset)["seq"])
