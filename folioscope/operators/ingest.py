"""From extracted text to a searchable snapshot: parse, deduplicate, compare, chunk, embed."""

from __future__ import annotations

import hashlib
import json
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import search, text
from ..settings import Settings


class EmbeddingProvider(Protocol):
    name: str

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedding:
    """A deterministic stand-in for a model: words hashed into a unit vector."""

    def __init__(self, dimensions: int = 64):
        self.dimensions, self.name = dimensions, f"hash-{dimensions}"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                out[i, int.from_bytes(h[:4], "little") % self.dimensions] += 1 if h[4] & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def index_profile(provider: EmbeddingProvider, s: Settings = Settings()) -> dict:
    """What the vectors depend on, and its fingerprint; another fingerprint means embedding all anew."""
    profile = {"embedding": provider.name, "chunk_size": s.chunk_size, "chunk_overlap": s.chunk_overlap}
    return profile | {"fingerprint": hashlib.sha256(json.dumps(profile, sort_keys=True).encode()).hexdigest(), "status": "ready"}


def headed(extracted: DataFrame) -> DataFrame:
    """source_path, modificationTime, metadata_json, header, content and outcome: read, skipped (nothing in it) or failed (a reader or a header broke)."""

    def split(batches):
        for pdf in batches:
            rows = []
            for t, why in zip(pdf["text"], pdf["skipped"]):
                if t is None:
                    rows.append((None, None, "failed" if str(why).startswith("failed") else "skipped"))
                    continue
                try:
                    header, body = front_matter(t)
                    body = body.strip() or rendered(header)
                except Exception:  # noqa: BLE001  a note with a bad header must not stop a scan
                    rows.append((None, None, "failed"))
                else:
                    rows.append((header, body, "read" if body else "skipped"))
            yield pdf[["source_path", "modificationTime", "metadata_json"]].assign(**{n: [r[i] for r in rows] for i, n in enumerate(("header", "content", "outcome"))})

    d = extracted.select("source_path", "modificationTime", "metadata_json", "text", "skipped")
    return d.mapInPandas(split, "source_path string, modificationTime timestamp, metadata_json string, header string, content string, outcome string")


def parse(extracted: DataFrame) -> DataFrame:
    """Documents from extracted text: front matter, inferred and extracted metadata, title, date, hash.

    Metadata of the header wins over what is inferred, and that over what the format gave.
    """

    d = headed(extracted).where("outcome = 'read'").drop("outcome")
    name = F.element_at(F.split("source_path", "/"), -1)
    head = lambda k: F.get_json_object("header", f"$.{k}")
    notes, who = text.note_fields(F.col("content")), text.speakers(F.col("content"))
    vtt = text.is_webvtt(F.col("content")) | (F.size(who) > 0)
    dated = text.labelled(F.col("content"), "date")
    d = d.withColumns({
        "m_title": F.coalesce(head("title"), text.labelled(F.col("content"), "title"), F.get_json_object("metadata_json", "$.title")),
        "m_date": F.coalesce(head("effective_at"), head("date"), dated, F.get_json_object("metadata_json", "$.date")),
        "stem": F.regexp_replace(name, r"\.[^.]*$", "")})
    inferred = F.to_json(F.struct(
        F.when(vtt, "meeting_transcript").alias("source_type"), F.when(text.is_webvtt(F.col("content")), "webvtt").alias("transcript_format"),
        F.try_element_at(notes, F.lit("language")).alias("language"), F.when(F.map_contains_key(notes, "duration"), text.seconds_of(F.try_element_at(notes, F.lit("duration")))).otherwise(text.duration(F.col("content"))).alias("duration_seconds"),
        F.when(F.size(who) > 0, who).alias("speakers"), F.when(F.size(who) > 0, F.size(who)).alias("speaker_count"),
        F.when(vtt & F.contains(F.lower(name), F.lit("teams")), "microsoft_teams").alias("source_app")))

    def merged(batches):
        for pdf in batches:
            out = []
            for x, y, z, t, e in zip(pdf["metadata_json"], pdf["inferred"], pdf["header"], pdf["title"], pdf["ext"]):
                m = {**json.loads(x or "{}"), **json.loads(y or "{}"), **json.loads(z or "{}")}
                m.setdefault("title", t)
                m.setdefault("extension", e)
                out.append(json.dumps(m, ensure_ascii=False, sort_keys=True, default=str))
            when = pd.to_datetime(pdf["m_date"].map(_date)).fillna(pdf["fallback"])
            yield pdf[["document_id", "source_path", "title", "content", "content_hash", "source_modified_at"]].assign(effective_at=when, metadata_json=out)

    d = d.select(F.sha2("source_path", 256).alias("document_id"), "source_path", text.title_of(F.col("m_title"), F.col("content"), F.col("stem")).alias("title"), "content", F.sha2("content", 256).alias("content_hash"),
                 F.col("modificationTime").alias("source_modified_at"), F.coalesce(text.name_date(name), F.col("modificationTime")).alias("fallback"), "m_date", "metadata_json", inferred.alias("inferred"), "header",
                 F.lower(F.regexp_extract("source_path", r"(\.[^./]+)$", 1)).alias("ext"))
    return d.mapInPandas(merged, "document_id string, source_path string, title string, content string, content_hash string, source_modified_at timestamp, effective_at timestamp, metadata_json string")


def _date(value):
    from dateutil import parser

    try:
        t = parser.parse(str(value), fuzzy=True) if value else None
    except (ValueError, OverflowError):
        return pd.NaT
    return pd.NaT if t is None else pd.Timestamp(t if t.tzinfo is None else t.astimezone(__import__("datetime").timezone.utc).replace(tzinfo=None))


def front_matter(t: str) -> tuple[str, str]:
    """The YAML header of a note as JSON (an empty mapping if none) and what follows it."""
    import re

    # How a header is set off from the text
    m = re.match(r"---[^\S\n]*\s*\n(.*?)\n---[^\S\n]*\s*\n?", t, re.DOTALL)
    if not m:
        return "{}", t
    try:
        import yaml

        loaded = yaml.safe_load(m[1]) or {}
    except ImportError:  # flat key: value headers need no YAML
        loaded = {k.strip(): v.strip().strip("\"'") for k, _, v in (x.partition(":") for x in m[1].splitlines()) if k.strip() and _}
    if not isinstance(loaded, dict):
        raise ValueError("the header of a note must be a mapping")
    return json.dumps(loaded, ensure_ascii=False, default=str), t[m.end():]


def rendered(header: str) -> str:
    """A header alone as text: key: value lines."""
    return "\n".join(f"{k}: {', '.join(map(str, v)) if isinstance(v, list) else v}" for k, v in json.loads(header).items() if v not in (None, "")).strip()


def deduplicated(documents: DataFrame) -> DataFrame:
    """One document of each content hash, the first path; the other paths go into duplicate_source_paths.

    Paths of a hash are gathered without their contents, so a group of copies carries only names.
    """
    g = documents.groupBy("content_hash").agg(F.sort_array(F.collect_set("source_path")).alias("all_source_paths"))
    d = documents.join(g, "content_hash").where(F.col("source_path") == F.col("all_source_paths")[0])
    return d.withColumn("duplicate_source_paths", F.slice("all_source_paths", 2, F.greatest(F.lit(1), F.size("all_source_paths")))).withColumn("duplicate_count", F.size("duplicate_source_paths"))


def snapshot_diff(old: DataFrame, new: DataFrame, profile: str | None = None, force: bool = False) -> DataFrame:
    """source_path, outcome (added, updated, unchanged, removed), was_active."""
    o = old.select("source_path", F.struct("title", "content_hash", "effective_at", "metadata_json").alias("o"), F.col("is_active"), F.col("indexed_profile_hash"))
    n = new.select("source_path", F.struct("title", "content_hash", "effective_at", "metadata_json").alias("n"))
    same = F.col("o").eqNullSafe(F.col("n")) & F.coalesce("is_active", F.lit(False)) & F.lit(not force)
    if profile is not None:
        same &= F.col("indexed_profile_hash").eqNullSafe(F.lit(profile))
    d = o.join(n, "source_path", "full_outer")
    out = F.when(F.col("n").isNull(), F.when(F.col("is_active"), "removed")).when(F.col("o").isNull(), "added").when(same, "unchanged").otherwise("updated")
    return d.select("source_path", out.alias("outcome"), F.coalesce("is_active", F.lit(False)).alias("was_active")).where("outcome IS NOT NULL")


def outcome_counts(diff: DataFrame) -> DataFrame:
    return diff.agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in ("added", "updated", "unchanged", "removed")])


def next_snapshot(old: DataFrame, new: DataFrame, profile: str, now) -> DataFrame:
    """The documents table after a scan: changed rows replaced, missing ones inactive, created_at kept."""
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns])
    d = new.join(o, F.col("source_path") == F.col("o_source_path"), "full_outer")
    data = ["title", "content", "content_hash", "source_modified_at", "effective_at", "metadata_json"]
    gone = F.col("source_path").isNull()
    same = F.struct(*[F.col(c) for c in ("title", "content_hash", "effective_at", "metadata_json")]).eqNullSafe(F.struct(*[F.col(f"o_{c}").alias(c) for c in ("title", "content_hash", "effective_at", "metadata_json")])) & F.col("o_is_active")
    return d.select(F.coalesce("document_id", "o_document_id").alias("document_id"), F.coalesce("source_path", "o_source_path").alias("source_path"),
                    *[F.when(gone, F.col(f"o_{c}")).otherwise(F.col(c)).alias(c) for c in data],
                    F.when(gone, F.col("o_indexed_profile_hash")).otherwise(F.lit(profile)).alias("indexed_profile_hash"), (~gone).alias("is_active"),
                    F.coalesce("o_created_at", F.lit(now)).alias("created_at"), F.when(~gone & F.coalesce(same, F.lit(False)), F.col("o_updated_at")).when(gone & ~F.col("o_is_active"), F.col("o_updated_at")).otherwise(F.lit(now)).alias("updated_at"))


def reindexed(documents: DataFrame, provider: EmbeddingProvider, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks embedded anew from the text that is stored, under the provider's profile; inactive documents have no chunks."""
    profile = index_profile(provider, s)["fingerprint"]
    chunks = embedded(chunked(documents.where("is_active"), s), provider, profile)
    return documents.withColumn("indexed_profile_hash", F.when(F.col("is_active"), F.lit(profile)).otherwise(F.col("indexed_profile_hash"))), chunks


def chunked(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """document_id, chunk_id, chunk_index, content, start_char, end_char, approx_tokens."""
    d = documents.select("document_id", "title", F.explode(search.chunks_of(F.col("content"), s.chunk_size, s.chunk_overlap)).alias("c"))
    return d.select("document_id", "title", F.sha2(F.concat_ws("#", "document_id", F.col("c.chunk_index")), 256).alias("chunk_id"), "c.*")


def embedded(chunks: DataFrame, provider: EmbeddingProvider, profile: str, batch: int = 16) -> DataFrame:
    """Chunks with vectors of their passages; the provider must give as many as it was asked for."""

    @F.pandas_udf("array<float>")
    def run(p: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(p), batch):
            part = list(p[i:i + batch])
            got = np.asarray(provider.embed(part), np.float32)
            if len(got) != len(part):
                raise ValueError(f"{len(got)} vectors for {len(part)} passages")
            out += got.tolist()
        return pd.Series(out)

    return chunks.withColumn("embedding", run(text.passage(F.col("title"), F.col("content")))).withColumn("embedding_profile_hash", F.lit(profile)).drop("title")


def replaced_chunks(old: DataFrame, new: DataFrame, changed: DataFrame, gone: DataFrame) -> DataFrame:
    """The chunks table after a scan: chunks of changed and gone documents leave, the new ones enter."""
    out = changed.select("document_id").union(gone.select("document_id")).distinct()
    return old.join(out, "document_id", "left_anti").unionByName(new)
