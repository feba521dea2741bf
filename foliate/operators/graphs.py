"""Connected components over tables, and the cut of lineage that loops need."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the folder in ``spark.checkpoint.dir`` and read from there: a lost executor costs a reread.

    Where the setting is unset a local master gets a temporary folder; on a cluster that is an error.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="foliate-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint()


def components(links: DataFrame) -> DataFrame:
    """``id, component``: for each id in ``links(a, b)`` the smallest id that it reaches.

    Each round hooks every id onto the smallest of its neighbours, and larger neighbours of
    an id onto that id's smallest; rounds end when links are stars. Both halves are a
    minimum and a join, so a hub's neighbours are never gathered.
    """
    a, b = F.col("a"), F.col("b")
    loops = links.where(a == b).select(a.alias("id"), b.alias("component"))
    now = cut(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    sign = None
    while True:
        both = now.union(now.select(b.alias("a"), a.alias("b")))
        smallest = both.groupBy("a").agg(F.least(F.min("b"), a).alias("m"))
        hooked = both.where(b > a).join(smallest, "a").select(b.alias("a"), F.col("m").alias("b"))
        lowest = hooked.groupBy("a").agg(F.min("b").alias("m"))
        met = hooked.join(lowest, "a")
        now = cut(met.select(b.alias("a"), F.col("m").alias("b")).union(met.select("a", F.col("m").alias("b"))).where(a != b).distinct())
        before, sign = sign, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == before:
            break
    roots = now.select(b.alias("id"), b.alias("component"))
    return now.select(a.alias("id"), b.alias("component")).union(roots).union(loops).groupBy("id").agg(F.min("component").alias("component"))
