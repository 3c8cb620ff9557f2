"""A keyed table in hash buckets: a batch rewrites the buckets it touches and no other.

A bucket is ``pmod(xxhash64(key), buckets)``.  Batch n writes the whole new state of its buckets under ``data/version=n`` and
then a small list of the version each bucket is in (``log/version=n``, one row per bucket).  Readers take the newest
list, so a batch is seen whole or not at all, and a batch that is run again after a failure starts from the state before
it and writes the same rows.  Old versions stay readable until ``vacuum``.

Of the rows of a key, the one of greatest ``order`` stays; at equal order (or without one) the row that is already stored stays,
so a replayed or outdated change changes nothing.

Cases: null keys share one bucket and count as one key; several rows of a key in one batch follow the same rule, ties among them by a
digest of the row; an empty batch changes no bucket; an empty table has the given schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hygeia.session import measured

_LOG = "_bucket int, version bigint"


def digest_of_ties(rows: DataFrame, keys: list, names: list[str]) -> DataFrame:
    """``rows`` with ``_tie``, a digest of the columns ``names`` where several rows have the same ``keys`` (else 0): few rows need one,
    and it costs more than the rest of a merge."""
    same = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    digest = F.xxhash64(*[F.to_json(F.struct(n)) for n in names])
    return rows.withColumn("_same", same).withColumn("_tie", F.when(F.col("_same") > 1, digest).otherwise(F.lit(0))).drop("_same")


class KeyedTable:
    """``path``: a folder that all executors share; ``buckets``: fixed for the table's life, at most 100,000."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: list[str], order: str | None = None,
                 buckets: int = 200):
        if not 1 <= buckets <= 100_000:
            raise ValueError("a keyed table has 1 to 100,000 buckets")
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets
        # what is read back from parquet may be null in any column
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])

    def _folders(self, path: str) -> list[str]:
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        sc = self.spark.sparkContext
        found = []
        for name in self._folders(f"{self.path}/log"):
            done = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{name}/_SUCCESS")
            if name.startswith("version=") and done.getFileSystem(sc._jsc.hadoopConfiguration()).exists(done):
                found.append(int(name.split("=", 1)[1]))
        return sorted(found)

    def state(self, before: int | None = None) -> dict[int, int]:
        """bucket -> the version it is in: one entry per bucket, in the newest list (older than ``before``)."""
        known = [v for v in self.versions() if before is None or v < before]
        if not known:
            return {}
        return {r["_bucket"]: r["version"]
                for r in self.spark.read.schema(_LOG).parquet(f"{self.path}/log/version={known[-1]}").collect()}

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _read(self, state: dict[int, int]) -> DataFrame:
        if not state:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/data/version={v}/_bucket={b}" for b, v in sorted(state.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The table now, or as it was after ``version``."""
        return self._read(self.state(None if version is None else version + 1))

    def touched(self, changes: DataFrame) -> list[int]:
        """Buckets of the changed keys: at most ``buckets`` numbers reach the driver."""
        return sorted(r["b"] for r in changes.select(self._bucket().alias("b")).distinct().collect())

    def stored(self, changes: DataFrame, before: int | None = None) -> DataFrame:
        """Stored rows of the changed keys, from the touched buckets only."""
        state = self.state(before)
        own = self._read({b: state[b] for b in self.touched(changes) if b in state})
        keys = measured(changes.select(*self.key))
        same = [own[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.key)]
        return own.join(keys.toDF(*[f"_k{i}" for i in range(len(self.key))]), same, "left_semi")

    def merge(self, changes: DataFrame, version: int) -> list[int]:
        """Put rows in as ``version`` and return the rewritten buckets. Versions grow; the newest may be run again."""
        versions = self.versions()
        if versions and version < versions[-1]:
            raise ValueError(f"version {version} is older than the table's version {versions[-1]}")
        state = self.state(before=version)
        hit = self.touched(changes)
        names = self.schema.names
        if hit:
            old = self._read({b: state[b] for b in hit if b in state}).withColumn("_new", F.lit(0))
            rows = old.unionByName(changes.select(*names).withColumn("_new", F.lit(1))).withColumn("_bucket", self._bucket())
            # one shuffle: rows of a key lie in a part of its bucket, a task of its own, and so do the windows
            parts = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // len(hit))
            part = F.pmod(F.shiftright(F.xxhash64(*self.key), 32), F.lit(parts)).cast("int")
            at = F.array_position(F.lit(hit), F.col("_bucket")).cast("int") - 1
            rows = rows.withColumn("_part", at * parts + part).repartitionById(len(hit) * parts, F.col("_part"))
            own = ["_bucket", "_part", *self.key]
            rows = digest_of_ties(rows, [*own, *([self.order] if self.order else []), "_new"], names)
            first = [F.col(self.order).desc_nulls_last()] if self.order else []
            w = Window.partitionBy(*own).orderBy(*first, "_new", "_tie")
            kept = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*names, "_bucket")
            kept.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/version={version}")
        new = state | {b: version for b in hit}
        log = self.spark.createDataFrame(sorted(new.items()), _LOG)
        log.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/version={version}")
        return hit

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove what none of the ``keep`` newest versions names; returns the removed folders."""
        sc = self.spark.sparkContext
        versions = self.versions()
        kept, old = versions[-keep:], versions[:-keep]
        used = {(b, v) for k in kept for b, v in self.state(k + 1).items()}
        gone = [f"log/version={v}" for v in old]
        for name in self._folders(f"{self.path}/data"):
            v = int(name.split("=", 1)[1])
            for sub in self._folders(f"{self.path}/data/{name}"):
                if v in old and sub.startswith("_bucket=") and (int(sub.split("=", 1)[1]), v) not in used:
                    gone.append(f"data/{name}/{sub}")
        for g in gone:
            p = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{g}")
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        return gone
