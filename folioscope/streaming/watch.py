"""A folder watched by a stream: each trigger lists it anew and publishes the next snapshot."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest
from ..settings import Settings
from ..sources import files


class Snapshots:
    """Versioned documents and chunks tables; readers see the last version that was published whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def version(self) -> int | None:
        if not self.fs.exists(self._path("published")):
            return None
        found = [int(s.getPath().getName()) for s in self.fs.listStatus(self._path("published"))]
        return max(found, default=None)

    def read(self, name: str) -> DataFrame | None:
        v = self.version()
        return None if v is None else self.spark.read.parquet(f"{self.root}/v{v}/{name}")

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """A table of the next version, written before that is published, and read again."""
        path = f"{self.root}/v{(self.version() or 0) + 1}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def publish(self, staged: tuple[str, ...] = (), **tables: DataFrame) -> int:
        """Write all tables of the next version (but those staged), then its mark: a failed write leaves the old version in place.

        Two writers of one version: the mark is a folder made once, and the second to make it fails.
        """
        v = (self.version() or 0) + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/v{v}/{name}")
        if self.fs.exists(self._path(f"published/{v}")):
            raise RuntimeError(f"version {v} was published by another writer")
        self.fs.mkdirs(self._path(f"published/{v}"))
        return v


DOCUMENTS = ("document_id string, source_path string, title string, content string, content_hash string, source_modified_at timestamp, effective_at timestamp, metadata_json string, "
             "indexed_profile_hash string, is_active boolean, created_at timestamp, updated_at timestamp")


def scan(spark: SparkSession, folder: str, snapshots: Snapshots, provider: ingest.EmbeddingProvider, s: Settings = Settings(), force: bool = False, now: datetime.datetime | None = None, engine=None) -> dict:
    """One listing against the last snapshot: counts of added, updated, unchanged, removed, failed, skipped and duplicate documents.

    Files are read only if their signature is not in the last version's extractions (force reads all). An index of another
    profile is embedded anew from the text that is stored, before the listing is looked at.
    """
    now = now or datetime.datetime.now(datetime.timezone.utc)
    profile = ingest.index_profile(provider, s)["fingerprint"]
    old = snapshots.read("documents")
    if old is not None and not old.where(F.col("is_active") & ~F.col("indexed_profile_hash").eqNullSafe(F.lit(profile))).isEmpty():
        reindex(spark, snapshots, provider, s)
        old = snapshots.read("documents")
    old = spark.createDataFrame([], DOCUMENTS) if old is None else old
    listed = files.discover(files.listing(spark, folder))
    extractions = snapshots.stage("extractions", files.extract(listed, snapshots.read("extractions"), force, engine, s.ocr_max_images))
    new = ingest.deduplicated(ingest.parse(extractions))
    diff = ingest.snapshot_diff(old, new, profile, force)
    counts = ingest.outcome_counts(diff).first().asDict()
    counts |= ingest.headed(extractions).agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in ("failed", "skipped")]).first().asDict()
    counts["duplicates"] = new.agg(F.sum("duplicate_count")).first()[0] or 0
    if any(counts[x] for x in ("added", "updated", "removed")) or snapshots.version() is None:
        moved = diff.where("outcome IN ('added', 'updated')").select("source_path")
        fresh = new.join(moved, "source_path", "left_semi")
        chunks = ingest.embedded(ingest.chunked(fresh, s), provider, profile)
        before = snapshots.read("chunks")
        if before is not None:
            gone = diff.where("outcome = 'removed'").select(F.sha2("source_path", 256).alias("document_id"))
            chunks = ingest.replaced_chunks(before, chunks, fresh, gone)
        documents = ingest.next_snapshot(old, new.drop("all_source_paths", "duplicate_source_paths", "duplicate_count"), profile, now)
        snapshots.publish(staged=("extractions",), documents=documents, chunks=chunks)
    return counts


def scan_once(spark: SparkSession, folder: str, snapshots: Snapshots, provider: ingest.EmbeddingProvider, s: Settings = Settings(), **how) -> dict:
    """scan(), by what happened to documents only."""
    counts = scan(spark, folder, snapshots, provider, s, **how)
    return {x: counts[x] for x in ("added", "updated", "unchanged", "removed")}


def reindex(spark: SparkSession, snapshots: Snapshots, provider: ingest.EmbeddingProvider, s: Settings = Settings()) -> dict:
    """The next version: stored documents, embedded anew under the provider's profile."""
    documents, chunks = ingest.reindexed(snapshots.read("documents"), provider, s)
    snapshots.publish(documents=documents, chunks=chunks, extractions=snapshots.read("extractions"))
    return {"documents": snapshots.read("documents").where("is_active").count(), "chunks": snapshots.read("chunks").count()}


def watch(spark: SparkSession, folder: str, snapshots: Snapshots, provider: ingest.EmbeddingProvider, checkpoint: str, s: Settings = Settings()) -> StreamingQuery:
    """Scan at every trigger. A file stream doesn't see edits and removals, so a rate source only keeps the time."""

    def tick(_, batch_id):
        try:
            scan_once(spark, folder, snapshots, provider, s)
        except Exception as e:  # noqa: BLE001  the next trigger tries again
            print(f"scan {batch_id} failed: {e}")

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=f"{s.scan_interval_seconds} seconds").start()
