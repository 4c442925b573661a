"""A finding table in versions: batches are appended, whole sources are swapped, and a reader sees
one committed version.

Rows live in folders that are never changed. A version is a small manifest that names the folders which
count, published by creating a file that must not exist yet; whatever fails before that leaves the old
version as it is. A swap adds two folders: the new rows, and the (scan, source) pairs whose older rows no
longer count, so no data is rewritten and two scans can finish at the same time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("scan_id", "source")


class VersionConflict(RuntimeError):
    """Another writer published this version first."""


class FindingTable:
    """Versions of findings under *path*, a folder that Spark and the driver reach by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str, attempts: int = 20):
        self.spark, self.path, self.attempts = spark, path.rstrip("/"), attempts
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- manifests ----------------------------------------------------------------
    def _file(self, version: int):
        return self._path(f"{self.path}/versions/{version:012d}.json")

    def version(self) -> int:
        """The last published version, 0 for an empty table."""
        folder = self._path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"rows": [], "gone": [], "batches": []}
        stream = self._fs.open(self._file(version))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, version: int, manifest: dict) -> None:
        """Writes the manifest aside and renames it to the version's name, which must be free."""
        aside = self._path(f"{self.path}/versions/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        target = self._file(version)
        if self._fs.exists(target) or not self._fs.rename(aside, target):
            self._fs.delete(aside, False)
            raise VersionConflict(f"version {version}")

    def _commit(self, change) -> int:
        """Publishes ``change(manifest, version)`` on top of the last version, again if another writer was faster."""
        for _ in range(self.attempts):
            before = self.version()
            manifest = change(self.manifest(before), before + 1)
            if manifest is None:
                return before
            try:
                self._publish(before + 1, manifest)
                return before + 1
            except VersionConflict:
                continue
        raise VersionConflict(f"{self.path}: {self.attempts} attempts")

    def _store(self, rows: DataFrame, kind: str) -> str:
        folder = f"{kind}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    # ---- writing --------------------------------------------------------------------
    def append(self, findings: DataFrame, batch: str | None = None) -> int:
        """Adds rows; a *batch* that is there already is not added again."""
        if batch is not None and batch in self.manifest()["batches"]:
            return self.version()
        folder = self._store(findings, "rows")

        def change(old: dict, version: int):
            if batch is not None and batch in old["batches"]:
                return None
            return {**old, "rows": [*old["rows"], [folder, version]], "batches": old["batches"] + ([batch] if batch is not None else [])}
        return self._commit(change)

    def swap(self, findings: DataFrame, sources, scans: DataFrame | None = None) -> int:
        """*findings* in place of all rows of *sources* in the scans of *findings* and of *scans* (scan_id)."""
        touched = findings.select("scan_id") if scans is None else findings.select("scan_id").unionByName(scans.select("scan_id"))
        pairs = touched.distinct().select("scan_id", F.explode(F.array(*[F.lit(s) for s in sources])).alias("source"))
        gone, rows = self._store(pairs, "gone"), self._store(findings, "rows")
        return self._commit(lambda old, version: {
            **old, "rows": [*old["rows"], [rows, version]], "gone": [*old["gone"], [gone, version]]})

    def append_stream(self, findings: DataFrame, checkpoint: str):
        """Micro-batches appended while a run goes on (R13); a retried one counts once."""
        name = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex
        return findings.writeStream.foreachBatch(lambda rows, n: self.append(rows, f"{name}/{n}")).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start()

    # ---- reading ------------------------------------------------------------------
    def _union(self, folders) -> DataFrame | None:
        out = None
        for folder, version in folders:
            part = self.spark.read.parquet(f"{self.path}/{folder}").withColumn("_version", F.lit(version))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last by default: those that no later swap replaced."""
        manifest = self.manifest(version)
        rows, gone = self._union(manifest["rows"]), self._union(manifest["gone"])
        if rows is None:
            raise FileNotFoundError(f"{self.path} has no version yet")
        if gone is None:
            return rows.drop("_version")
        last = gone.groupBy(*KEYS).agg(F.max("_version").alias("_gone"))
        return rows.join(last, list(KEYS), "left").where(
            F.col("_gone").isNull() | (F.col("_version") >= F.col("_gone"))).select(*[c for c in rows.columns if c != "_version"])

    def compact(self) -> int:
        """One folder for all rows of the last version. Older versions stay readable."""
        at = self.version()
        folder = self._store(self.read(at), "rows")

        def change(old: dict, version: int):
            later = lambda entries: [e for e in entries if e[1] > at]
            return {**old, "rows": [[folder, at], *later(old["rows"])], "gone": later(old["gone"])}
        return self._commit(change)
