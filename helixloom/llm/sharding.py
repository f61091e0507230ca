"""Size-tiered shards under a versioned manifest.

Arrivals are appended as runs of small immutable Parquet files. Runs whose
sizes lie in one tier - powers of ``fan_in`` - are merged, once there are
``fan_in`` of them, into files of the target size. What a table is at a
version is said by one manifest file alone: a commit writes the next
version's file aside and renames it into place, which fails if another
writer was first, so readers see the old or the new list of runs and nothing
between. Merged runs are deleted after the commit by :func:`vacuum`.

Built-in functions only; merging reads files side by side without a shuffle.
The manifest has a line per run, not per row or file.

Runs may have different columns. A manifest line holds its run's schema, and
a version is read with the columns of all its runs, in the order in which they
came: rows of a run without a column have null there. A run whose column has
another type than before is refused.

Defined results: appending no rows commits nothing; rows are stored as they
are, nulls, empty and long texts, repeats and columns of any name included; a
job that fails leaves files that no manifest names.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TARGET_BYTES = 64 << 20
FAN_IN = 4
LEAST_BYTES = 1 << 20
ARRIVAL = "_arrival"


def union_schema(runs: list[dict]) -> StructType:
    """The columns of all runs in the order in which they came."""
    found: dict[str, object] = {}
    for r in runs:
        for f in StructType.fromJson(r["schema"]):
            had = found.setdefault(f.name.lower(), f)
            if had.dataType.simpleString() != f.dataType.simpleString():
                raise ValueError(f"column {f.name} is {f.dataType.simpleString()} and was {had.dataType.simpleString()}")
    return StructType([StructType().add(f.name, f.dataType, True)[0] for f in found.values()])


class ShardStore:
    """A table of runs below one folder of any file system Spark can write."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, least_bytes: int = LEAST_BYTES):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fan_in, self.least_bytes = target_bytes, fan_in, least_bytes

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        folder = self._path("_manifest")
        if not self._fs().exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._fs().listStatus(folder)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def runs(self, version: int | None = None) -> list[dict]:
        version = self.version() if version is None else version
        if not version:
            return []
        with_lines = self._fs().open(self._path(f"_manifest/v{version:020d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(with_lines, "UTF-8")
        finally:
            with_lines.close()
        return [json.loads(line) for line in text.splitlines()]

    def commit(self, runs: list[dict], after: int) -> int:
        """Makes ``runs`` version ``after + 1``, unless there is one."""
        jvm = self.spark._jvm
        aside, final = self._path(f"_manifest/.{uuid.uuid4().hex}"), self._path(f"_manifest/v{after + 1:020d}.json")
        out = self._fs().create(aside, False)
        try:
            out.write(bytearray("".join(json.dumps(r, sort_keys=True) + "\n" for r in runs).encode()))
        finally:
            out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, final, none)
        return after + 1

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(1, size) / self.least_bytes, self.fan_in)))

    def _written(self, folder: str, schema: StructType, arrival: str = "") -> list[dict]:
        """Runs in a folder just written: one to a value of ``arrival``."""
        files = self.spark.read.parquet(f"{self.root}/{folder}").groupBy("_metadata.file_path", "_metadata.file_size").agg(F.count("*").alias("n"))
        part = F.regexp_extract("file_path", f"/({arrival}=[^/]*)/", 1) if arrival else F.lit("")
        found = files.groupBy(part.alias("part")).agg(F.sum("n").alias("rows"), F.sum("file_size").alias("bytes"), F.count("*").alias("files")).orderBy("part").collect()
        return [{"path": f"{folder}/{r.part}".rstrip("/"), "rows": r.rows, "bytes": r.bytes, "files": r.files, "tier": self.tier(r.bytes), "schema": schema.jsonValue()} for r in found]

    def append(self, arrivals: DataFrame, arrival: Column | None = None) -> int:
        """Adds rows as a run, or as a run for each value of ``arrival``.

        Each task writes what it has read; nothing is shuffled. A commit that
        another writer overtakes is tried again on top of the other's."""
        folder, schema = f"run-{uuid.uuid4().hex}", arrivals.schema
        union_schema([*self.runs(), {"schema": schema.jsonValue()}])  # refuses before anything is written
        name = ARRIVAL
        while name.lower() in {c.lower() for c in arrivals.columns}:
            name += "_"
        if arrival is None:
            arrivals.write.parquet(f"{self.root}/{folder}")
            runs = self._written(folder, schema)
        else:
            # folders are named by a hash, so that any value makes a path
            dealt = arrivals.withColumn(name, F.md5(F.coalesce(arrival.cast("string"), F.lit(""))))
            dealt.write.partitionBy(name).parquet(f"{self.root}/{folder}")
            some = any(f.isDirectory() for f in self._fs().listStatus(self._path(folder)))
            runs = self._written(folder, schema, name) if some else []
        return self._committed(lambda old: [*old, *runs]) if any(r["rows"] for r in runs) else self.version()

    def _committed(self, change) -> int:
        for _ in range(20):
            version = self.version()
            try:
                runs = change(self.runs(version))
                union_schema(runs)  # another writer may have brought a column of another type
                return self.commit(runs, version)
            except Exception as e:
                if "FileAlreadyExists" not in str(e):
                    raise
        raise RuntimeError(f"{self.root}: other writers committed first each time")

    def due(self) -> list[list[dict]]:
        """The groups of similarly sized runs that are ready to be merged."""
        tiers: dict[int, list[dict]] = {}
        for r in self.runs():
            tiers.setdefault(r["tier"], []).append(r)
        return [group for group in tiers.values() if len(group) >= self.fan_in and any(r["bytes"] < self.target_bytes * r["files"] / 2 for r in group)]

    def compact(self) -> int:
        """Merges until no tier is due; returns the version reached."""
        while groups := self.due():
            for group in groups:
                self.merge(group)
        return self.version()

    def merge(self, group: list[dict]) -> int:
        """One merge: files of the target size from all files of ``group``."""
        folder = f"run-{uuid.uuid4().hex}"
        count = max(1, math.ceil(sum(r["bytes"] for r in group) / self.target_bytes))
        self._rows(group).coalesce(count).write.parquet(f"{self.root}/{folder}")
        made, gone = self._written(folder, union_schema(group)), {r["path"] for r in group}

        def change(old: list[dict]) -> list[dict]:
            if not gone <= {r["path"] for r in old}:
                raise RuntimeError("another compaction has merged these runs")
            return [*(r for r in old if r["path"] not in gone), *made]

        return self._committed(change)

    def _rows(self, runs: list[dict]) -> DataFrame:
        return self.spark.read.schema(union_schema(runs)).parquet(*[f"{self.root}/{r['path']}" for r in runs])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by its manifest."""
        return self._rows(self.runs(version))

    def vacuum(self, keep_versions: int = 1) -> None:
        """Deletes runs that none of the last ``keep_versions`` versions names
        and the older manifests; not to be run beside writers."""
        newest = self.version()
        kept = range(max(1, newest - keep_versions + 1), newest + 1)
        named = {r["path"] for v in kept for r in self.runs(v)}
        for f in self._fs().listStatus(self._path(".").getParent()) if newest else []:
            name = f.getPath().getName()
            if not name.startswith("run-"):
                continue
            below = [f"{name}/{x.getPath().getName()}" for x in self._fs().listStatus(f.getPath()) if x.isDirectory()]
            if name in named:
                continue
            for sub in below:
                if sub not in named:
                    self._fs().delete(self._path(sub), True)
            if not any(sub in named for sub in below):
                self._fs().delete(f.getPath(), True)
        for v in range(1, kept.start if newest else 1):
            self._fs().delete(self._path(f"_manifest/v{v:020d}.json"), False)
