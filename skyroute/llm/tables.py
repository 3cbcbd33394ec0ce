"""Reading the given tables, and staging intermediate tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset on a local master (tests), a new temporary one, set for the session."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="skyroute-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    This cuts the lineage; unlike executor-local storage, the files outlive any executor.
    Spark is told to delete the shuffle files of the step at its end, so that disks hold one step's shuffles and not all.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/skyroute/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def packed(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """The table with its text column compressed, for a shuffle of whole texts; ``words.unpacked`` restores it."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == text_col else f.dataType) for f in texts.schema])

    def run(batches):
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            values = batch.column(at).cast(pa.binary())
            yield batch.set_column(at, text_col, pa.array([None if v is None else pack(v) for v in (x.as_buffer() for x in values)], pa.binary()))

    return texts.mapInArrow(run, schema)
