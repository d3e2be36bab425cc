"""Tables kept between jobs, in the folder that the cluster shares."""

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch while a table is written: with the usual 64 MB, most of a task's texts stand in the JVM and in its Python worker at once.
BATCH_BYTES, BATCH_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of text that one task takes, about.
TASK_BYTES = 64 << 20


@functools.cache
def own_folder() -> str:
    return tempfile.mkdtemp(prefix="fairline-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset (tests, one machine), a folder of our own."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return own_folder()


#: Tables written by this application and not forgotten yet.
WRITTEN: list[str] = []


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    usual = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, BATCH_BYTES)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_CONF, usual)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, since: int, *, but: int = 0) -> None:
    """Deletes the tables that were kept since WRITTEN had some length, except the last few; only for a caller that no longer reads them."""
    for path in WRITTEN[since : len(WRITTEN) - but]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    del WRITTEN[since : len(WRITTEN) - but]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(docs: DataFrame, column: str = "text") -> int:
    """How many tasks to deal the texts to: one a TASK_BYTES, and no fewer than the session's shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
