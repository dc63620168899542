"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.files import own_dir

#: White space of the text contracts: U+0020 and U+0009 to U+000D.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null id where ids are compared: after every other id.
LAST_ID = (1 << 63) - 1


#: Rows of a table that aren't worth a task and a file of their own.
FILE_ROWS = 20_000


def materialize(df: DataFrame, tag: str, codec: str = "snappy", most_rows: int | None = None) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: cuts the lineage, computes df once, gives the planner real sizes.
    most_rows, if that is known of df, spares small tables hundreds of tasks and files. The driver deletes these tables when it ends,
    or when files.clear is called."""
    spark = df.sparkSession
    if most_rows is not None:
        df = df.coalesce(max(1, -(-most_rows // FILE_ROWS)))
    path = f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", codec).parquet(path)
    tidy_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def tidy() -> None:
    """In a Python process: give memory that is free back to the system. Workers outlive their tasks, and so does the driver."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def tidy_driver(spark: SparkSession) -> bool:
    """In the driver's JVM: give native memory that is free back to the system; whether it could. The hundreds of threads that Spark
    plans, compiles and sends with free it into arenas of their own, where it stays: a chain of many small queries holds more and more."""
    try:
        lang, gateway = spark._jvm.java.lang, spark.sparkContext._gateway
        # by reflection, as the server's class is hidden: only its interface may be called
        kinds = gateway.new_array(lang.Class, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = lang.Class.forName(kind)
        given = gateway.new_array(lang.Object, 4)
        given[0], given[1] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = lang.management.ManagementFactory.getPlatformMBeanServer()
        lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, given)
    except (AttributeError, TypeError, Py4JError):  # no JVM beside this process, or one that can't: Java before 17.0.9, another C library
        return False
    return True


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def col(df: DataFrame, name: str) -> Column:
    """df's column of that very name, dots and all."""
    return df[f"`{name}`"]


def whole(text: Column) -> Column:
    """A text with null as empty."""
    return F.coalesce(text, F.lit(""))


def drop_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is in ids (one column, a materialized table, so the planner
    broadcasts it only if its real size is below the session's limit). Rows with a null id stay."""
    (key,) = fresh(docs, "dropped_id")
    gone = ids.toDF(key)
    return docs.join(gone, col(docs, id_col) == gone[key], "left_anti")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key with fewer rows than this is never split.
LEAST_HOT = 1000


def hot_keys(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """(key, salts) of the keys of counts (key, n) that hold more than a quarter of a partition's even share, and into how many
    parts of that size each is to go. There are four a shuffle partition at most, whatever the input, so this may be broadcast."""
    spark = counts.sparkSession
    total = counts.agg(F.sum(n)).first()[0] or 0
    per = max(int(total) // (4 * partitions(spark)), LEAST_HOT)
    return materialize(counts.where(F.col(n) > per).select(key, F.ceil(F.col(n) / per).cast("int").alias("salts")).coalesce(1), "hot-keys")


def salted(rows: DataFrame, key: str, hot: DataFrame, *identity: str) -> DataFrame:
    """rows with salt: 0, or for a hot key one of its salts by a hash of the row's identity."""
    part = F.pmod(F.xxhash64(*identity), F.coalesce("salts", F.lit(1)).cast("long")).cast("int")
    return rows.join(F.broadcast(hot), key, "left").withColumn("salt", part).drop("salts")


def replicated(rows: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """rows, one of each key, with salt: once for every salt of its key."""
    every = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    return rows.join(F.broadcast(hot), key, "left").withColumn("salt", every).drop("salts")
