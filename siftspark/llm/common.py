"""Shared helpers of the training-data operators: tables, durable cuts of lineage, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes handled at once inside a task; longer texts are cut into overlapping stretches.
CHUNK_BYTES = 1 << 20
#: Spark's setting by which the shuffle files of a query go when it ends; a saved table needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def spare(docs: DataFrame, *names: str) -> list[str]:
    """Names for private columns that no column of docs has, in any case: underscores are added to those that are taken."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the shared checkpoint folder, to cut lineage and survive lost executors.

    The folder comes from ``spark.checkpoint.dir``; where the session names none, one is made for a
    driver without executors, and a cluster is refused, as its executors don't share a folder of the driver's.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if root is None:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="siftspark-")
            spark.sparkContext.setCheckpointDir(root)
        self.root = f"{root.rstrip('/')}/siftspark-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back; the result has no lineage but the files."""
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def read_all(self, prefix: str, like: DataFrame) -> DataFrame:
        """Every table saved under ``prefix/...``, as one."""
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{prefix}/*")

    def drop(self, name: str) -> None:
        """Delete one of this object's own tables, once nothing reads it any more."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Connected components of the undirected edges (u, v): returns (node, component).

    ``component`` is the smallest node reachable. Rounds of large-star and small-star, each made of
    a minimum per node and an equality join, so a node of any degree is handled by map-side
    combining and by skew-join splitting. Null ends and loops are ignored; no edges, no rows.
    """
    e = edges.select(F.col(edges.columns[0]).alias("u"), F.col(edges.columns[1]).alias("v"))
    e = e.where("u is not null and v is not null and u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = scratch.save(e, f"{name}/0")
    seen, step = None, 0
    while True:
        mark = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or mark.n == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                e.select("v", "v").distinct()
            )
        seen, step = mark, step + 1
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.save(large.where("u <> v").distinct(), f"{name}/{step}l")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch.save(small.union(low).where("u <> v").distinct(), f"{name}/{step}s")
        scratch.drop(f"{name}/{step}l")
