"""A collection of passages and vectors as a Parquet table that is partitioned by a hash of its key.

A change reads and writes the buckets of its keys alone, by dynamic partition overwrite: a bucket's files are exchanged
when the job commits, so a write that is done again changes nothing more. Rows without a key are left out. One writer a
bucket at a time; a reader during a commit may see some buckets before and some after it. An empty table next to the
rows tells the schema and how many buckets there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gleaner.operators import manifest
from gleaner.operators.ordering import checkpointed

KEPT = 3
#: The column that names a row's bucket, in the table's folders only.
BUCKET = "__bucket"


class Collection:
    def __init__(self, spark: SparkSession, folder: str, key: str = "id", buckets: int = 64):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        self._rows, self._shape = f"{self.folder}/rows", f"{self.folder}/shape"

    def schema(self) -> StructType | None:
        """The stored schema, none where there is no collection; the number of buckets follows the stored one."""
        try:
            found = self.spark.read.parquet(self._shape).schema
        except AnalysisException:
            return None
        self.buckets = found[self.key].metadata.get("buckets", self.buckets)
        return found

    def healthy(self) -> bool:
        return self.schema() is not None

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.filter(F.col(self.key).isNotNull()).withColumn(BUCKET, F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int"))

    def _read(self) -> DataFrame:
        schema = self.schema()
        if schema is None:
            raise FileNotFoundError(f"there is no collection in {self.folder}")
        return self.spark.read.schema(StructType([*schema.fields, StructField(BUCKET, IntegerType())])).parquet(self._rows)

    def read(self) -> DataFrame:
        return self._read().drop(BUCKET).filter(F.col(self.key).isNotNull())

    def _shaped(self, schema: StructType) -> None:
        fields = [StructField(f.name, f.dataType, True, {"buckets": self.buckets} if f.name == self.key else {}) for f in schema.fields if f.name != BUCKET]
        self.spark.createDataFrame([], StructType(fields)).write.mode("overwrite").parquet(self._shape)

    def _put(self, rows: DataFrame, buckets: int, mode: str) -> None:
        rows.repartition(max(1, buckets), BUCKET).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(BUCKET).parquet(self._rows)

    def write(self, rows: DataFrame) -> None:
        """All rows anew; they must not come from the collection itself."""
        self.schema()
        self._put(self._bucketed(rows), self.buckets, "static")
        self._shaped(rows.schema)

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace those with their key in the buckets of their keys; other buckets are neither read nor written. Of
        rows with the same key one counts. Columns that are new are null in earlier rows."""
        schema = self.schema()
        if schema is None:
            return self.write(rows.dropDuplicates([self.key]))
        fresh = checkpointed(self._bucketed(rows).dropDuplicates([self.key]))
        touched = self._touched(fresh)
        if touched:
            old = self._read().filter(F.col(BUCKET).isin(touched)).join(fresh.select(self.key), self.key, "left_anti")
            self._put(old.unionByName(fresh, allowMissingColumns=True), len(touched), "dynamic")
            if set(fresh.columns) - {BUCKET} - set(schema.names):
                self._shaped(StructType([*schema.fields, *(f for f in fresh.schema.fields if f.name not in schema.names)]))

    def _touched(self, bucketed: DataFrame) -> list[int]:
        return [r[0] for r in bucketed.select(BUCKET).distinct().collect()]  # as many as there are buckets at most

    def delete(self, keys: DataFrame) -> int:
        """Delete by keys; returns how many were asked for. Only the buckets of the keys are read and written."""
        self.schema()  # the stored number of buckets
        asked = checkpointed(self._bucketed(keys.select(self.key)))
        touched = self._touched(asked)
        if touched:
            left = manifest.deleted(self._read().filter(F.col(BUCKET).isin(touched)), asked, self.key)
            # A bucket that loses its last row must still be written: a row without a key stands for it.
            kept = self.spark.createDataFrame([(b,) for b in touched], f"{BUCKET} int")
            self._put(left.unionByName(kept, allowMissingColumns=True), len(touched), "dynamic")
        return keys.count()

    def backup(self, folder: str, name: str, keep: int = KEPT) -> list[str]:
        """Copy the rows to ``folder/name``; of all backups there the ``keep`` with the last names stay."""
        self.read().write.mode("overwrite").parquet(f"{folder}/{name}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = path(folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = sorted((s.getPath().getName() for s in files.listStatus(path(folder))), reverse=True)
        for old in names[keep:]:
            files.delete(path(f"{folder}/{old}"), True)
        return names[:keep]

    def restore(self, folder: str, name: str) -> None:
        self.write(self.spark.read.parquet(f"{folder}/{name}"))

    def migrate(self, target: Collection, change: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> int:
        """Write all rows to another collection, changed on the way (embedded by another model); returns how many.

        The keys must stay as they are: if some are lost, new or repeated, this is an error and the target is incomplete.
        """
        target.write(change(self.read()))
        had, has = self.read().select(self.key), target.read().select(target.key)
        rows = has.count()
        if rows != had.count() or not had.join(has, had[self.key] == has[target.key], "left_anti").isEmpty():
            raise ValueError("the keys of the target are not those of the source")
        return rows

    def ensure(self, schema: str) -> None:
        """Make an empty collection where there is none."""
        if self.schema() is None:
            self.write(self.spark.createDataFrame([], schema))

    def count(self, **equal: object) -> int:
        rows = self.read()
        for column, value in equal.items():
            rows = rows.filter(F.col(column) == value)
        return rows.count()

    def ids(self) -> DataFrame:
        return self.read().select(self.key)
