"""Cuts the lineage of iterative operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df written to the folder of spark.checkpoint.dir and read back; computed once. A local folder is made only where that setting is
    missing and the master is this machine (tests); on a cluster that raises."""
    spark = df.sparkSession
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="loomwork-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{top.rstrip('/')}/loomwork-{uuid.uuid4().hex}-cut")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.option("compression", "zstd").parquet(path.toString())
    return spark.read.schema(df.schema).parquet(path.toString())
