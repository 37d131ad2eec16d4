"""What the operators of this subpackage share: the shared folder, written intermediate tables, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where that is unset, a temporary
    folder serves a local master; any other master is refused, since its executors couldn't see such a folder."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="lexmill-")
        fs, p = _fs(spark, _own_dir[app])
        fs.deleteOnExit(p)
    return _own_dir[app]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def stash(df: DataFrame, tag: str, few: bool = False) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: the lineage ends there, and a lost executor
    costs no recomputation. The files go when the application ends. few: a small table, which its shuffle has spread over
    many tasks, is dealt to as many as there are cores, for a file each."""
    spark = df.sparkSession
    if few:
        df = df.repartition(spark.sparkContext.defaultParallelism)
    path = f"{shared_dir(spark)}/llm-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def put_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Puts a file into the shared folder, once for each name (which names its content) and application, and registers it
    with Spark, which copies it to each executor, those that start later included. It goes when the application ends."""
    path = f"{shared_dir(spark)}/llm-files-{spark.sparkContext.applicationId}/{name}"
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(part)
        out.write(bytearray(data))
        out.close()
        if not fs.rename(part, p) and not fs.exists(p):
            raise OSError(f"can't write {path}")
        fs.deleteOnExit(p)
    spark.sparkContext.addFile(path)
    return path


def small(df: DataFrame, most_rows: int) -> bool:
    """True if df has at most so many rows; looks at no more than that."""
    return df.limit(most_rows + 1).count() <= most_rows


def bounded(df: DataFrame, most_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else df itself, for a shuffled join."""
    return F.broadcast(df) if small(df, most_rows) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; documents of fewer partitions than there are cores, as of one row group, are dealt to all cores."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df


def free_name(columns: list[str], wanted: str) -> str:
    """A name that none of the columns has: wanted, with as many underscores as it takes."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def text_slices(batch, text: str):
    """(row number, bytes of its text, or None for null) of an Arrow record batch."""
    col = batch.column(text)
    for i, s in enumerate(col):
        yield i, (s.as_buffer().to_pybytes() if s.is_valid else None)
