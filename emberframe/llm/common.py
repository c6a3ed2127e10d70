"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that cross to Python at once at most; texts of a batch are worked on one after the other.
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own if Spark runs in
    one machine, and else one in the warehouse, as a cluster's machines don't see each other's temporary folders."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # one process; local-cluster has several
            import tempfile

            base = tempfile.mkdtemp(prefix="shared-")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.scratch"
    return base.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; what is not dropped goes when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.tables = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", []
        atexit.register(self.close)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        if jvm is not None:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def put(self, df: DataFrame, name: str, dealt_by: str | None = None) -> DataFrame:
        """The table as written. dealt_by: a column by which it is bucketed, so that joins and groups by it need no shuffle."""
        path = f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"
        out = df.write.option("compression", "zstd")
        if dealt_by:
            table = f"scratch_{uuid.uuid4().hex}"
            out.format("parquet").bucketBy(parts(df), dealt_by).option("path", path).saveAsTable(table)
            self.tables.append(table)
            read = self.spark.table(table)
        else:
            out.parquet(path)
            read = self.spark.read.schema(df.schema).parquet(path)
        read._scratch = path
        return read

    def drop(self, *tables: DataFrame) -> None:
        """Only for tables that no later plan reads."""
        for t in tables:
            self._delete(t._scratch)

    def close(self) -> None:
        try:
            for t in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {t}")
            self._delete(self.base)
        except Exception:  # noqa: BLE001  the session has ended
            pass


def small_batches(spark: SparkSession) -> None:
    """For a job that this package starts itself: rows cross to Python by BATCH_ROWS, which keeps Python workers and what they
    hold small. Operators work at any setting and leave a user's alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def by_batch(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over batches of a bounded number of rows, whatever the session's own bound."""

    def run(batches):
        return f(b.slice(at, BATCH_ROWS) for b in batches for at in range(0, b.num_rows, BATCH_ROWS))

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def ident(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, so that others' names cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def parts(df: DataFrame, least: int = 1) -> int:
    """Partitions for a shuffle: what the session says."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


WORD = re.compile(r"\S+")
