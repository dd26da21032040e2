"""Size-tiered sharding with a versioned manifest, in DataFrame operations only.

Method. Arrivals are written as small immutable shards, one Parquet file each. Compaction sorts shards into tiers by
size; a tier's run of neighbours is merged into files of the target size, and shards of about the target size or more
are left alone. Each append or compaction commits a new manifest version: the list of shards is written first, then a
pointer file appears under the version's name in one step that fails if the name is taken (a hard link on a local file
system, a rename without overwriting elsewhere). So of two writers one wins, the other's data is removed and it has to
start again, and readers see either the old version or the new one, which stay readable until vacuum() removes the files
that no kept version lists. A store whose rename overwrites needs a committer of its own (the `commit` parameter).

Scale. The driver plans on shard totals (one row for each file, so 400,000 rows at 100 TB in files of 256 MB); the
plan itself is window sums over them. Rows are shuffled once, by ranges of run numbers, so each run goes to a task.

Defined cases. All columns are kept as they are, nulls too; sizes count the bytes of the text column and 64 a row. The
text's length doesn't matter: a row is never split. An empty arrival commits a version without new shards, and a store
without rows reads as an empty table with the columns of its arrivals (a store that nothing was ever appended to has no
columns and is refused). Repeated rows stay; ties in size go by path. Columns named shard, shard_rows, shard_bytes or
shard_run are refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.llm.scratch import drop_path

TARGET_BYTES = 64 << 20
ARRIVAL_ROWS = 4000
FAN_IN = 4
ROW_BYTES = 64
RUN = "shard_run"
SHARDS = "path string, rows long, bytes long"
RESERVED = {RUN, "shard", "shard_rows", "shard_bytes"}


class ConflictError(RuntimeError):
    """Another writer has committed this version."""


def place_once(spark: SparkSession, hidden: str, name: str) -> bool:
    """Give a finished file its name; false, and nothing changed, where the name is taken."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(hidden), jvm.org.apache.hadoop.fs.Path(name)
    at = target.getFileSystem(conf).makeQualified(target).toUri()
    try:
        if at.getScheme() == "file":
            here = source.getFileSystem(conf).makeQualified(source).toUri().getPath()
            jvm.java.nio.file.Files.createLink(jvm.java.io.File(at.getPath()).toPath(), jvm.java.io.File(here).toPath())
        else:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(at, conf).rename(source, target, options)
    except Exception as error:
        if target.getFileSystem(conf).exists(target):
            return False
        raise error
    return True


class ShardStore:
    """Shards below one folder of the shared store."""

    def __init__(self, spark: SparkSession, root: str, text_col: str = "text", target: int = TARGET_BYTES, fan_in: int = FAN_IN, commit: Callable[[SparkSession, str, str], bool] = place_once) -> None:
        self.commit = commit
        self.spark, self.root, self.text_col, self.target, self.fan_in = spark, root.rstrip("/"), text_col, target, fan_in

    # --- versions -------------------------------------------------------------------------------------------------

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def versions(self) -> list[int]:
        """The committed versions that vacuum() has left."""
        fs, folder = self._fs(f"{self.root}/versions")
        if not fs.exists(folder):
            return []
        return sorted(int(x.getPath().getName()[1:]) for x in fs.listStatus(folder) if x.getPath().getName().startswith("v"))

    def version(self) -> int:
        """The latest committed version; 0 where there is none."""
        return max([0, *self.versions()])

    def _pointer(self, version: int) -> tuple[str, str]:
        """Where a version's list of shards is, and the schema of its rows."""
        listed, schema = self.spark.read.text(f"{self.root}/versions/v{version:08d}", wholetext=True).first()[0].split("\n", 1)
        return listed, schema

    def manifest(self, version: int | None = None) -> DataFrame:
        """(path, rows, bytes) of a version's shards."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], SHARDS)
        return self.spark.read.schema(SHARDS).parquet(self._pointer(version)[0])

    def _commit(self, shards: DataFrame, version: int, schema: str) -> int:
        """Make shards the given version, if nobody else has."""
        listed = f"{self.root}/manifests/{uuid.uuid4().hex}"
        shards.coalesce(1).write.parquet(listed)
        name, hidden = f"{self.root}/versions/v{version:08d}", f"{self.root}/versions/.{uuid.uuid4().hex}"
        fs, path = self._fs(hidden)
        out = fs.create(path, False)
        out.write(bytearray(f"{listed}\n{schema}".encode()))
        out.close()
        won = self.commit(self.spark, hidden, name)
        fs.delete(path, False)
        if not won:
            drop_path(self.spark, listed)
            raise ConflictError(f"version {version} is taken")
        return version

    # --- writing --------------------------------------------------------------------------------------------------

    def _totals(self, folder: str) -> DataFrame:
        """(path, rows, bytes) of the files that were just written."""
        size = F.coalesce(F.octet_length(self.text_col), F.lit(0)).cast("long") + ROW_BYTES
        rows = self.spark.read.parquet(folder).select(F.col("_metadata.file_path").alias("path"), size.alias("size"))
        return rows.groupBy("path").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))

    def append(self, arrivals: DataFrame, shard_rows: int = ARRIVAL_ROWS) -> int:
        """Write arrivals as small shards, without a shuffle, and commit them; returns the version."""
        if taken := RESERVED & set(arrivals.columns):
            raise ValueError(f"reserved names: {sorted(taken)}")
        version = self.version()
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        arrivals.write.option("maxRecordsPerFile", shard_rows).option("compression", "zstd").parquet(folder)
        return self._commit_data(folder, self.manifest(version), version, arrivals.schema.json())

    def _commit_data(self, folder: str, stay: DataFrame, version: int, schema: str) -> int:
        """Commit the files of a folder beside the shards that stay; they go if another writer was first."""
        try:
            return self._commit(stay.unionByName(self._totals(folder)), version + 1, schema)
        except ConflictError:
            drop_path(self.spark, folder)
            raise

    def plan(self, shards: DataFrame) -> DataFrame:
        """shards with their tier and the run that they are merged in; run is null for those that stay."""
        shards.createOrReplaceTempView("pagelode_shards")
        return self.spark.sql(
            f"""
            WITH tiers AS (
              SELECT *, CASE WHEN bytes >= {3 * self.target // 4} THEN -1
                             ELSE CAST(floor(ln(greatest(bytes, 1)) / ln({self.fan_in})) AS INT) END AS tier
              FROM pagelode_shards),
            small AS (SELECT *, sum(bytes) OVER (PARTITION BY tier ORDER BY bytes, path) - bytes AS before FROM tiers WHERE tier >= 0),
            runs AS (SELECT *, CAST(floor(before / {self.target}) AS INT) AS run FROM small),
            sized AS (SELECT *, count(*) OVER (PARTITION BY tier, run) AS members FROM runs)
            SELECT path, rows, bytes, tier, CASE WHEN members > 1 THEN concat_ws('-', tier, run) END AS run FROM sized
            UNION ALL SELECT path, rows, bytes, tier, NULL FROM tiers WHERE tier < 0
            """
        )

    def compact(self) -> int:
        """Merge runs of similarly sized shards until no tier has two that fit one run; returns the version."""
        while True:
            version = self.version()
            plan = self.plan(self.manifest(version)).collect()  # one row for each file
            merged = [r for r in plan if r.run is not None]
            if len(merged) < 2:
                return version
            runs = {name: n for n, name in enumerate(sorted({r.run for r in merged}))}
            where = self.spark.createDataFrame([(r.path, runs[r.run]) for r in merged], f"path string, {RUN} int")
            rows = self.spark.read.parquet(*[r.path for r in merged]).withColumn("_path", F.col("_metadata.file_path"))
            rows = rows.join(F.broadcast(where), rows["_path"] == where["path"]).drop("_path", where["path"])
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            rows.repartitionByRange(len(runs), RUN).write.option("compression", "zstd").partitionBy(RUN).parquet(folder)
            stay = self.spark.createDataFrame([(r.path, r.rows, r.bytes) for r in plan if r.run is None], SHARDS)
            version = self._commit_data(folder, stay, version, self._pointer(version)[1])

    def vacuum(self, keep: int = 1) -> None:
        """Forget all but the latest versions, and remove the files that only forgotten ones list."""
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        if not old:
            return
        listed = {r.path for v in kept for r in self.manifest(v).select("path").collect()}
        gone = {r.path for v in old for r in self.manifest(v).select("path").collect()} - listed
        for version in old:
            where = self._pointer(version)[0]
            drop_path(self.spark, f"{self.root}/versions/v{version:08d}")
            drop_path(self.spark, where)
        for path in sorted(gone):
            drop_path(self.spark, path)

    # --- reading --------------------------------------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with shard (path), shard_rows and shard_bytes."""
        version = self.version() if version is None else version
        if not version:
            raise ValueError("nothing was ever appended")
        shards = self.manifest(version)
        paths = [r.path for r in shards.select("path").collect()]
        if not paths:
            schema = T.StructType.fromJson(json.loads(self._pointer(version)[1]))
            return self.spark.createDataFrame([], schema).selectExpr("CAST(NULL AS string) AS shard", "*", "CAST(NULL AS long) AS shard_rows", "CAST(NULL AS long) AS shard_bytes")
        rows = self.spark.read.option("recursiveFileLookup", "true").parquet(*paths).withColumn("shard", F.col("_metadata.file_path"))
        told = shards.select(F.col("path").alias("shard"), F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"))
        return rows.join(F.broadcast(told), "shard")
