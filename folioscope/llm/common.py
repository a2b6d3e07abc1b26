"""What the training-data operators share: word splitting, staging, checked broadcasts, components."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest row count of a side that join_small() broadcasts; beyond it Spark shuffles.
BROADCAST_ROWS = 50_000

#: Largest row count of a table that held() takes through the driver.
HELD_ROWS = 10_000

#: Internal columns start with this, so they never clash with a caller's own.
OWN = "__fs_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one on a local master (tests); on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables that staged() has written in this process and that are still there, in order.
_written: list[str] = []


def staged(df: DataFrame, rows_a_file: int = 0, dealt: bool = False) -> DataFrame:
    """df written as Parquet into the shared folder and read again: lineage is cut, any executor may be lost. Tables of large rows may bound the rows a file.

    dealt: rows that are small next to the texts they are made of are dealt to one file a core first, whatever the number of partitions that texts are read in.
    """
    spark = df.sparkSession
    if dealt:
        df = df.repartition(spark.sparkContext.defaultParallelism)
    path = f"{shared_dir(spark)}/staged/{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def held(df: DataFrame, limit: int = HELD_ROWS) -> DataFrame:
    """df computed once, its lineage cut. At most limit rows go through the driver, no file is written; a table of more rows is computed again and staged."""
    rows = df.limit(limit + 1).toArrow()
    return df.sparkSession.createDataFrame(rows, df.schema) if rows.num_rows <= limit else staged(df)


def staged_so_far() -> int:
    """A mark for clear_staged()."""
    return len(_written)


def clear_staged(spark: SparkSession, since: int = 0) -> None:
    """Remove what staged() has written since a mark; call it when no result built on it is needed any more."""
    remove(spark, _written[since:])
    del _written[since:]


def remove(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts right only after counting at most limit rows in it; right should be staged or cheap."""
    if right.limit(limit + 1).count() <= limit:
        right = F.broadcast(right)
    return left.join(right, on, how)


#: Longs of a filter of ids, 64 bits each: its size whatever the number of ids. More ids mean more rows that may match, never one less.
FILTER_LONGS = 1 << 17


def marked(df: DataFrame, column: str, ids: DataFrame, longs: int = FILTER_LONGS) -> DataFrame:
    """df with a boolean OWN + maybe: false only where column (long) is none of ids (one column of longs, repeats allowed).

    A filter of at most `longs` rows is broadcast, so the rows that cannot match need not be shuffled with their texts to be joined to ids.
    """
    place = lambda c: F.expr(f"pmod(shiftrightunsigned(xxhash64(`{c}`), 6), {longs})")
    bit = lambda c: F.expr(f"shiftleft(1L, cast(xxhash64(`{c}`) & 63L AS int))")
    own = ids.columns[0]
    bits = ids.select(place(own).alias(f"{OWN}place"), bit(own).alias("b")).groupBy(f"{OWN}place").agg(F.bit_or("b").alias(f"{OWN}bits"))
    d = df.withColumn(f"{OWN}place", place(column)).join(F.broadcast(bits), f"{OWN}place", "left")
    return d.withColumn(f"{OWN}maybe", F.coalesce(F.col(f"{OWN}bits").bitwiseAND(bit(column)) != 0, F.lit(False))).select(*df.columns, f"{OWN}maybe")


def nullable_key(name: str) -> Column:
    """A string key that tells null from every string, for equi-joins on nullable columns."""
    return F.when(F.col(name).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(name).cast("string")))


def text_key() -> list[Column]:
    """Fingerprint of a text (null as empty): results that depend on the text alone are joined by it."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(t).alias(f"{OWN}k"), F.hash(t, F.length(t)).alias(f"{OWN}k2")]


TEXT_KEY = [f"{OWN}k", f"{OWN}k2"]


def slices(batches, rows: int = 512):
    """Arrow batches in pieces of few rows, so that a task holds few texts as Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 of a string column, null as empty. bytes.split() then splits on 0x20 and 0x09-0x0D exactly."""
    return [v or b"" for v in batch.column(name).cast(pa.binary()).to_pylist()]


def as_text(batch: pa.RecordBatch, name: str) -> list[str]:
    return [v or "" for v in batch.column(name).to_pylist()]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b) of longs: (node, label), label the smallest node reachable.

    Alternates the large-star and small-star steps; each is one aggregation and one
    equi-join, so a node with very many edges is pre-aggregated and split by AQE.
    Every round is staged in the shared folder; rounds end once each node has one edge down, to a
    node that has none. Nodes without an edge are absent.
    """
    e = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        ends = e.select(F.col("a").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(e.select("b", F.lit(0), F.lit(1)))
        if not ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR down = 1 AND up = 1").count():
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.union(low.where("a <> m").select("a", F.col("m").alias("b"))).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.explode(F.array(
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s")).select("s.*")
        e = staged(small.where("a <> b").distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(e.select(F.col("b"), F.col("b")).distinct())
