"""Replay of a stream of commands with per-key state: the batch fold's semantics, one micro-batch after another."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..plans import commands as cmd

#: The fold of each structure, and its verbs.
FOLDS = {
    "kv": (cmd.replay_kv, ("PUT", "DELETE")),
    "zset": (cmd.replay_zset, ("Z_ADD", "Z_INCR", "Z_RM", "Z_DEL")),
    "hash": (cmd.replay_hash, ("H_SET", "H_RM", "H_DEL")),
    "geo": (cmd.replay_geo, ("GEO_ADD", "GEO_RM", "GEO_DEL")),
}


class Replay:
    """The state of a structure as versions in a shared folder; each micro-batch makes the next one.

    Keys are dealt to buckets by hash. A version writes the buckets that its
    commands touch (all, on CLEAR) and lists where each bucket's newest table
    is; others aren't read. A batch that is delivered again finds its version
    and does nothing; another batch under a version's number, or a missing
    version before it, is an error. Commands up to the greatest seq already
    applied are repeats or late: they change nothing and are written beside the
    version (late()).
    """

    def __init__(self, spark, folder: str, kind: str = "kv", buckets: int = 64):
        self.spark, self.folder, self.kind, self.buckets = spark, folder.rstrip("/"), kind, buckets

    def _path(self, version: int, name: str) -> str:
        return f"{self.folder}/v={version}/{name}"

    def _read(self, version: int) -> dict | None:
        """The note of a version, which is written last: where the buckets are, the last seq, a digest of the batch."""
        jvm = self.spark.sparkContext._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{self._path(version, 'note')}/_SUCCESS")
        if not done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            return None
        return json.loads(self.spark.read.text(self._path(version, "note")).first()["value"])

    def _tables(self, note: dict, some: list[int] | None = None) -> DataFrame | None:
        """The tables of some buckets, read by version."""
        of: dict[int, list[int]] = {}
        for bucket, version in note["at"].items():
            if some is None or int(bucket) in some:
                of.setdefault(version, []).append(int(bucket))
        out = None
        for version, own in sorted(of.items()):
            part = self.spark.read.schema(note["schema"] + ", bucket int").parquet(self._path(version, "state")).where(F.col("bucket").isin(own)).drop("bucket")
            out = part if out is None else out.unionByName(part)
        return out

    def apply(self, batch: DataFrame, version: int) -> None:
        fold, verbs = FOLDS[self.kind]
        own = batch.where(F.col("command").isin(*verbs, "CLEAR"))
        sums = own.agg(F.count("*").alias("n"), F.sum(F.xxhash64("seq", "command", "key").cast("decimal(38, 0)")).cast("string").alias("h"), F.max("seq").alias("top"), F.count_if(F.col("command") == "CLEAR").alias("clears")).first()
        digest = f"{sums['n']}:{sums['h']}"
        there = self._read(version)
        if there is not None:
            if there["digest"] != digest:
                raise ValueError(f"version {version} in {self.folder} was made by another batch: a new checkpoint needs a new folder")
            return
        before = self._read(version - 1) if version else {"at": {}, "last": cmd.FIRST - 1, "schema": None}
        if before is None:
            raise ValueError(f"version {version - 1} is missing in {self.folder}: the folder isn't that of this checkpoint")
        late = F.coalesce(F.col("seq") <= before["last"], F.lit(True))
        own.where(late).write.mode("overwrite").parquet(self._path(version, "late"))
        new = own.where(~late)
        bucket = F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")
        if sums["clears"]:
            touched, state = list(range(self.buckets)), None
        else:
            touched = [r["bucket"] for r in new.select(bucket.alias("bucket")).distinct().collect()]  # at most `buckets`
            state = self._tables(before, touched)
        if sums["clears"] and new.where("command = 'CLEAR'").isEmpty():  # a repeated CLEAR clears nothing
            state = self._tables(before)
        made = fold(new, state)
        made.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._path(version, "state"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields)
        note = {"at": before["at"] | {str(b): version for b in touched}, "last": max(before["last"], sums["top"] if sums["top"] is not None else before["last"]), "schema": schema, "digest": digest}
        self.spark.createDataFrame([(json.dumps(note),)], "value string").coalesce(1).write.mode("overwrite").text(self._path(version, "note"))

    def start(self, commands: DataFrame, checkpoint: str) -> StreamingQuery:
        """commands: a streaming frame of the command schema, in batches whose seq rise."""
        return commands.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def version(self) -> int | None:
        """The newest version, found by doubling and halving."""
        if self._read(0) is None:
            return None
        low, high = 0, 1
        while self._read(high) is not None:
            low, high = high, 2 * high
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self._read(middle) is not None else (low, middle)
        return low

    def state(self) -> DataFrame | None:
        """The newest version's state; None before the first one."""
        newest = self.version()
        return None if newest is None else self._tables(self._read(newest))

    def late(self, version: int) -> DataFrame:
        """What a version's batch had of repeated and late commands."""
        return self.spark.read.parquet(self._path(version, "late"))
