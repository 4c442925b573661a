"""A sink that packs many documents into few files: ``df.write.format("audit_documents")``.

Rows are text fragments in order. Every task writes one file with the fragments of its partition one after the
other and, beside it, an index of where each document's part lies. Files only count once the
job's manifest names them, so a failed or repeated task leaves nothing behind that a reader sees. A document that spans
tasks has a part in several files.
"""

from __future__ import annotations

import json
import sys
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "audit_documents"
INDEX = pa.schema([("document", pa.string()), ("part", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("length", pa.int64())])


def _system(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    #: Place of the partition in the order of the job.
    partition: int = 0


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, job: str):
        self.path, self.job = path.rstrip("/"), job

    def write(self, batches) -> Written:
        """Columns document, text and partition; the rows of a document are neighbours."""
        system, root = _system(self.path)
        name, partition, out = uuid.uuid4().hex, 0, None
        entries: list[list] = []
        for batch in batches:
            if out is None:
                system.create_dir(f"{root}/{self.job}", recursive=True)
                out = system.open_output_stream(f"{root}/{self.job}/{name}.txt", compression=None)
            for document, text, at in zip(*(batch.column(c).to_pylist() for c in ("document", "text", "partition")), strict=True):
                data, partition = (text or "").encode(), at
                if not entries or entries[-1][0] != document:
                    entries.append([document, at, f"{self.job}/{name}.txt", out.tell(), 0])
                out.write(data)
                entries[-1][4] += len(data)
        if out is None:
            return Written(None)
        out.close()
        pq.write_table(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*entries, strict=True), INDEX.types, strict=True)], schema=INDEX),
                       f"{root}/{self.job}/{name}.index.parquet", filesystem=system)
        return Written(name, partition)

    def commit(self, messages) -> None:
        system, root = _system(self.path)
        names = [m.name for m in messages if m is not None and m.name]
        system.create_dir(f"{root}/jobs", recursive=True)
        with system.open_output_stream(f"{root}/jobs/.{self.job}.tmp", compression=None) as out:
            out.write(json.dumps({"job": self.job, "files": sorted(names)}).encode())
        system.move(f"{root}/jobs/.{self.job}.tmp", f"{root}/jobs/{self.job}.json")

    def abort(self, messages) -> None:
        system, root = _system(self.path)
        for m in messages:
            if m is not None and m.name:
                for end in (".txt", ".index.parquet"):
                    system.delete_file(f"{root}/{self.job}/{m.name}{end}")


class Documents(DataSource):
    """Options: path."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "document string, text string, partition long"

    def writer(self, schema, overwrite: bool):
        if overwrite:
            raise ValueError("documents are appended; take a new path instead of overwriting")
        return _Writer(self.options["path"], uuid.uuid4().hex)


def write_documents(fragments: DataFrame, path: str, keys=("scan_id",), partitions: int | None = None) -> None:
    """Stores ordered fragments (keys, order columns, text) as documents, one for each value of *keys*, in as many files
    as there are partitions. Fragments are range-partitioned, so that no document is gathered in one place."""
    spark = fragments.sparkSession
    spark.dataSource.register(Documents)
    order = [*keys, *[c for c in fragments.columns if c not in (*keys, "text")]]
    laid_out = fragments.repartitionByRange(partitions, *order) if partitions else fragments.repartitionByRange(*order)
    rows = laid_out.sortWithinPartitions(*order).select(
        F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).alias("document"), "text",
        F.spark_partition_id().cast("long").alias("partition"))
    rows.write.format(FORMAT).option("path", path).mode("append").save()


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """(document, part, file, start, length) of all committed jobs."""
    system, root = _system(path.rstrip("/"))
    jobs = [json.loads(system.open_input_stream(f.path, compression=None).read().decode())
            for f in system.get_file_info(fs.FileSelector(f"{root}/jobs", allow_not_found=True)) if f.path.endswith(".json")]
    files = [f"{path.rstrip('/')}/{j['job']}/{n}.index.parquet" for j in jobs for n in j["files"]]
    if not files:
        return spark.createDataFrame([], "document string, part long, file string, start long, length long")
    return spark.read.parquet(*files)


def read_documents(index: DataFrame, path: str) -> DataFrame:
    """(document, part, text) of the wanted rows of an index; the parts of a document in order are its text. Only the
    bytes of these parts are read."""
    place = path.rstrip("/")

    def cut(batches):
        system, root = _system(place)
        for batch in batches:
            texts = []
            for file, start, length in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "length")), strict=True):
                with system.open_input_file(f"{root}/{file}") as source:
                    texts.append(source.read_at(length, start).decode())
            yield pa.RecordBatch.from_arrays([batch.column("document"), batch.column("part"), pa.array(texts, pa.string())],
                                             names=["document", "part", "text"])
    return index.mapInArrow(cut, "document string, part long, text string")
