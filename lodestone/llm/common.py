"""What the operators share: table access, a shared work folder, ASCII folding and bounded hot-key sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Where it is unset, local mode gets a folder of its own and a cluster an error, as its machines share no temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{work_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df in the shared folder and reads it back: cuts lineage, keeps column pruning, survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Writes df in the shared folder as a table of so many buckets by key, each sorted: what joins or groups several such tables by key needs no exchange."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    table_name = f"lodestone_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table_name)
    out = spark.table(table_name)
    out.scratch_path, out.scratch_table = path, table_name
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes what written() or bucketed() wrote for these tables; nothing that is still to run may read them."""
    for df in tables:
        path = vars(df).get("scratch_path") if df is not None else None
        if path:
            if name := vars(df).get("scratch_table"):
                df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else. Text that is ASCII throughout takes the fast built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

#: A key above this share of the rows, and above LEAST_HOT rows, is hot; there are fewer than so many of them, which bounds their broadcast.
HOT_KEYS = 2048
LEAST_HOT = 1000


def hot_limit(total: int) -> int:
    return max(LEAST_HOT, total // HOT_KEYS)


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows with one row a group (a written table), where groups[size] counts the rows of each and total all of them: hot groups, if any, are broadcast (fewer than HOT_KEYS), the others meet by shuffle with few rows a key."""
    limit = hot_limit(total)
    hot = groups.where(F.col(size) > limit)
    if not hot.limit(1).count():
        return rows.join(groups, key)
    small = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(groups.where(F.col(size) <= limit), key)
    return rows.join(F.broadcast(hot), key).unionByName(small)
