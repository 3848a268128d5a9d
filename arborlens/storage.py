"""Tables in the folder that all executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the checkpoint folder of the context. Only a local session, as in tests, may leave both unset
    and gets a new temporary folder; on a cluster that would be another one on every machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = current.get() if current.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df into the shared folder and read it back: its lineage ends here and it survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(table: DataFrame) -> bool:
    """Whether the files of a materialized table, or of a selection of it, are still there."""
    spark = table.sparkSession
    for name in table.inputFiles()[:1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return False


def delete(table: DataFrame) -> None:
    """Deletes the folders of a materialized table."""
    spark = table.sparkSession
    for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def files_state(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the names, sizes and times of all files below the paths, by which a copy of what they hold is known to be up to date."""
    digest = hashlib.sha256()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        store = path.getFileSystem(conf)
        if not store.exists(path):
            continue
        found = store.listFiles(path, True)
        while found.hasNext():
            f = found.next()
            digest.update(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}\n".encode())
    return digest.hexdigest()


def remove(spark: SparkSession, files: list[str]) -> None:
    for name in files:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)
