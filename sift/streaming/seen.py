"""The seen table of a stream: runs of batches, compacted by size tiers.

A run is one folder, ``run=<first>-<last>``, with the keys that the batches of
that range were the first to see, sorted by bucket of the key's hash in as few
files as their number needs.  A batch adds a run of its own.  Before that, when
all earlier batches are committed, every ``fan`` neighbouring runs of one tier
(a run of up to ``fan ** t`` batches is of tier t) are merged into one run, and runs
that a complete longer run holds are removed.  So a table of n batches has
about ``fan * log(n)`` folders, and each key is rewritten ``log(n)`` times.

Replays: a run counts once its ``_SUCCESS`` file is there.  Batch m reads only
runs that end before m, and merges only those; what it wrote itself before it
was stopped is overwritten when it runs again, and a merge that was cut short
leaves its inputs in place.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sift.sources.tables import path_exists

#: Ranges of hashes that readers prune by; fixed for the life of a table.
BUCKETS = 64
#: Runs of a tier that are merged into one of the next.
FAN = 8
#: Keys in a file, about.
FILE_KEYS = 1_000_000
#: Batch number of what was seen before the stream began.
INITIAL_BATCH = -1
SCHEMA = "key string, bucket int"


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class SeenTable:
    """The keys that earlier batches have seen, under ``path``."""

    def __init__(self, spark: SparkSession, path: str, fan: int = FAN):
        self.spark, self.path, self.fan = spark, path, fan

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folder(self, first: int, last: int) -> str:
        return f"{self.path}/run={first + 1:012d}-{last + 1:012d}"      # from 0, the initial batch

    def runs(self) -> list[tuple[int, int]]:
        """(first, last) batch of every complete run: a few folder names, whatever the table holds."""
        if not path_exists(self.spark, self.path):
            return []
        p, fs = self._fs(self.path)
        found = [re.fullmatch(r"run=(\d+)-(\d+)", s.getPath().getName()) for s in fs.listStatus(p)]
        runs = [(int(m[1]) - 1, int(m[2]) - 1) for m in found if m]
        return sorted(r for r in runs if path_exists(self.spark, f"{self._folder(*r)}/_SUCCESS"))

    def _cover(self, before: int) -> list[tuple[int, int]]:
        """The longest runs that end before the batch, none inside another."""
        runs = [r for r in self.runs() if r[1] < before]
        return [r for r in runs if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in runs)]

    def read(self, before: int, buckets: list[int] | None = None) -> DataFrame | None:
        """``key`` of all earlier batches, only of the given buckets (a filter on sorted files); None if there are none."""
        runs = self._cover(before)
        if not runs:
            return None
        rows = self.spark.read.schema(SCHEMA).parquet(*[self._folder(*r) for r in runs])
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).select("key")

    def _write(self, keys: DataFrame, first: int, last: int, n_keys: int) -> None:
        files = max(1, -(-n_keys // FILE_KEYS))
        (keys.select("key", bucket_of(F.col("key")).alias("bucket")).repartitionByRange(files, "bucket", "key")
             .sortWithinPartitions("bucket", "key").write.mode("overwrite").parquet(self._folder(first, last)))

    def add(self, keys: DataFrame, batch: int) -> None:
        """The keys that a batch was the first to see, as its run."""
        keys = keys.select("key").persist()
        try:
            self._write(keys, batch, batch, keys.count())
        finally:
            keys.unpersist()

    def _tier(self, run: tuple[int, int]) -> int:
        tier, reach = 0, 1
        while reach < run[1] - run[0] + 1:
            tier, reach = tier + 1, reach * self.fan
        return tier

    def compact(self, before: int) -> None:
        """Merge full tiers of the runs that end before the batch, and remove what they hold."""
        while True:
            runs = self._cover(before)
            full = next((runs[k:k + self.fan] for k in range(len(runs) - self.fan + 1)
                         if len({self._tier(r) for r in runs[k:k + self.fan]}) == 1), None)
            if full is None:
                break
            rows = self.spark.read.schema(SCHEMA).parquet(*[self._folder(*r) for r in full]).select("key")
            self._write(rows, full[0][0], full[-1][1], rows.count())
        keep = set(self._cover(before))
        for run in self.runs():
            if run[1] < before and run not in keep:
                p, fs = self._fs(self._folder(*run))
                fs.delete(p, True)
