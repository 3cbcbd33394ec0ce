"""Tables written to the shared folder, where a plan has to be cut or a format is written and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings of a staged step: its shuffle files go with it, and nothing is broadcast without a hint, as Spark's estimates see neither what explodes
#: make of a row nor how far Parquet has packed it: tables of millions of rows would pass through the driver.
_STEP = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; where that is unset on a local master, in a temporary one set for the session."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="skyroute-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/skyroute/{name}-{uuid.uuid4().hex}"


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is not to be broadcast, whatever its estimated size; for joins of rows made by explodes that no ``cut`` runs."""
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as a shuffle has, however few its files are: for short rows of which much is made."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: In place of 4 MB, with which a task would be planned for every 32 short files: what it takes to open a file, in bytes read meanwhile.
_MANY_FILES = {"spark.sql.files.openCostInBytes": "65536"}


def cut(df: DataFrame, name: str, *, many_files: bool = False) -> DataFrame:
    """``df`` written and read back: the lineage ends here, the files outlive any executor, and the step's shuffle files go.

    With ``many_files``, tasks read as many short files as one should.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    settings = _STEP | (_MANY_FILES if many_files else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)
