"""Sharding by size-tiered compaction.

An arrival is appended as a run: a folder of small immutable shards, one file a task. Runs are in tiers by the power of
FAN of their bytes; FAN runs of a tier, and all smaller ones, are merged into one run of target-sized files: whole files
are read together and written again by one task each, without a shuffle. A run of target-sized files is not merged again.

Every change is one new manifest, a list of runs, so its length follows the number of arrivals and not of files. A
commit first claims the version by creating claim-<version>, which fails if it exists, checks that its runs are there,
and then renames a finished file to manifest-<version>: of two writers one starts over, readers see the old or the new
list and nothing between. A claim older than `grace` seconds without a manifest is of a writer that is gone, and may be
taken over by claim-<version>.<k>. `vacuum` removes runs that none of the last manifests names and that are older than
`grace`, so that neither a run about to be committed nor a reader of a recent version loses its files.

Rows keep all columns and repeated rows; null and empty texts are rows like others; an empty arrival adds no shard.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections import defaultdict

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import fresh, new_path

TARGET, FAN = 128 << 20, 4
#: Seconds for which a file that no manifest names may still be about to be committed, or read.
GRACE, KEEP = 86_400.0, 10


class Shards:
    """A table of shards in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, target: int = TARGET, fan: int = FAN, grace: float = GRACE):
        self.spark, self.folder, self.target, self.fan, self.grace = spark, folder, target, fan, grace
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(folder))

    def _listed(self, folder: str = "") -> list:
        return list(self._fs.listStatus(self._path(f"{self.folder}/{folder}" if folder else self.folder)))

    def _created(self, name: str, content: str) -> bool:
        """Whether the file was made; False if there is one of that name."""
        try:
            out = self._fs.create(self._path(f"{self.folder}/{name}"), False)
        except Py4JJavaError as error:
            if "AlreadyExists" in str(error.java_exception.getClass()) or "already exists" in str(error.java_exception):
                return False
            raise
        out.write(bytearray(content.encode()))
        out.close()
        return True

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._listed()]
        return sorted(int(n[9:]) for n in names if n.startswith("manifest-") and n[9:].isdigit())

    def version(self) -> int:
        return max([0, *self.versions()])

    def manifest(self, version: int | None = None) -> dict:
        """version, and its runs: run (folder), files, bytes."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "runs": []}
        rows = self.spark.read.text(f"{self.folder}/manifest-{version}").collect()
        return {"version": version, "runs": [json.loads(r["value"]) for r in rows]}

    def _claimed(self, version: int) -> bool:
        name, own = f"claim-{version}", uuid.uuid4().hex
        held = [s for s in self._listed() if s.getPath().getName().split(".")[0] == name]
        if held:
            newest = max(s.getModificationTime() for s in held) / 1000
            if time.time() - newest < self.grace:
                return False
            name = f"{name}.{len(held)}"
        return self._created(name, own)

    def commit(self, last: int, runs: list[dict]) -> bool:
        """Whether the manifest after `last` became this list; False if another writer was first."""
        name = f"manifest-{last + 1}"
        if self._fs.exists(self._path(f"{self.folder}/{name}")) or not self._claimed(last + 1):
            return False
        for r in runs:
            if not self._fs.exists(self._path(f"{self.folder}/{r['run']}/_SUCCESS")):
                raise FileNotFoundError(f"run {r['run']} is not there")
        aside = f".{uuid.uuid4().hex}"
        self._created(aside, "\n".join(json.dumps(r, sort_keys=True) for r in runs))
        if self._fs.exists(self._path(f"{self.folder}/{name}")) or not self._fs.rename(self._path(f"{self.folder}/{aside}"), self._path(f"{self.folder}/{name}")):
            self._fs.delete(self._path(f"{self.folder}/{aside}"), False)
            return False
        return True

    def written(self, df: DataFrame, kind: str = "run") -> list[dict]:
        """df as a run that no manifest names yet (none if it has no rows)."""
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        sizes = [int(s.getLen()) for s in self._listed(name) if s.getPath().getName().startswith("part-")]
        if not sizes or self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}").isEmpty():
            return []
        return [{"run": name, "files": len(sizes), "bytes": sum(sizes)}]

    def append(self, arrival: DataFrame) -> int:
        """The version that has the arrival's shards."""
        new = self.written(arrival)
        while True:
            now = self.manifest()
            if not new:
                return now["version"]
            if self.commit(now["version"], now["runs"] + new):
                return now["version"] + 1
            time.sleep(0.05)

    def tier(self, size: int) -> int:
        return max(0, int(math.log(max(size, 1) / self.target * self.fan**4, self.fan)))

    def sealed(self, run: dict) -> bool:
        """Whether its files are of the target's size."""
        return run["bytes"] >= self.target * 3 // 4 * run["files"]

    def compact(self) -> int:
        """Merge full tiers until none is left; the last version."""
        while True:
            now, tiers = self.manifest(), defaultdict(list)
            for r in now["runs"]:
                if not self.sealed(r):
                    tiers[self.tier(r["bytes"])].append(r)
            full = next((t for t in sorted(tiers) if len(tiers[t]) >= self.fan), None)
            if full is None:
                return now["version"]
            # all smaller runs go along, so that a row is written a few times at most
            old = [r for t in tiers if t <= full for r in tiers[t]]
            gone = {r["run"] for r in old}
            files = max(1, round(sum(r["bytes"] for r in old) / self.target))
            merged = self.written(self._read(old).coalesce(files), "merged")
            if not self.commit(now["version"], [r for r in now["runs"] if r["run"] not in gone] + merged):
                time.sleep(0.05)

    def _read(self, runs: list[dict]) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.folder}/{r['run']}" for r in runs])

    def rows(self, version: int | None = None, shard: str = "shard") -> DataFrame:
        """The rows of a version, with the shard (run/file) each is in; the name gives way to a column of the rows."""
        runs = self.manifest(version)["runs"]
        if not runs:
            return self.spark.createDataFrame([], f"{shard} string")
        df = self._read(runs)
        parts = F.split(F.col("_metadata.file_path"), "/")
        return df.select("*", F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1)).alias(fresh(df, shard)[0]))

    def vacuum(self, keep: int = KEEP, grace: float | None = None) -> list[str]:
        """Remove runs older than `grace` that none of the last `keep` manifests names; their names."""
        grace, out = self.grace if grace is None else grace, []
        versions = self.versions()[-keep:]
        found = self._listed()  # before the manifests are read: what is committed meanwhile is not in it, or is named
        named = {r["run"] for v in versions for r in self.manifest(v)["runs"]}
        for s in found:
            name = s.getPath().getName()
            if s.isDirectory() and name not in named and time.time() - s.getModificationTime() / 1000 >= grace and self.version() in versions:
                self._fs.delete(s.getPath(), True)
                out.append(name)
        return out


def digest(docs: DataFrame, arrivals: int = 4, target: int = TARGET) -> DataFrame:
    """docs taken in as some arrivals (by doc_id), compacted after each and read back.

    Per row: doc_id, n_chars_read and text_sha256 of the text as read back.
    """
    spark = docs.sparkSession
    shards = Shards(spark, new_path(spark, "shards"), target)
    for k in range(arrivals):
        shards.append(docs.where(F.pmod(F.coalesce(F.hash("doc_id"), F.lit(0)), F.lit(arrivals)) == k))
        shards.compact()
        shards.vacuum(keep=1, grace=0)  # a folder of its own: no other writer, no reader yet
    rows = shards.rows()
    if "doc_id" not in rows.columns:
        rows = docs.limit(0)
    return rows.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_read"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
