"""Batch commands: python -m folioscope ingest-once | reindex | rebuild | status | query | eval."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .operators import ingest, retrieval
from .sources import questions
from .streaming.watch import Snapshots, reindex, scan


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioscope")
    p.add_argument("--index", required=True, help="folder of the index, as Spark names it")
    p.add_argument("--dimensions", type=int, default=64, help="of the stand-in embedding")
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("ingest-once", "rebuild"):
        commands.add_parser(name).add_argument("folder")
    for name in ("reindex", "status"):
        commands.add_parser(name)
    q = commands.add_parser("query")
    q.add_argument("question")
    q.add_argument("--top-k-chunks", type=int, default=10)
    q.add_argument("--top-k-documents", type=int, default=7)
    q.add_argument("--max-context-chars", type=int)
    for name in ("project", "since", "until"):
        q.add_argument(f"--{name}")
    e = commands.add_parser("eval")
    e.add_argument("questions")
    e.add_argument("--top-k", type=int, default=7)
    e.add_argument("--verbose", action="store_true")
    return p


def run(spark: SparkSession, arguments: list[str]) -> dict:
    a = parser().parse_args(arguments)
    snapshots, provider = Snapshots(spark, a.index), ingest.HashEmbedding(a.dimensions)
    if a.command in ("ingest-once", "rebuild"):
        return scan(spark, a.folder, snapshots, provider, force=a.command == "rebuild")
    if a.command == "reindex":
        return reindex(spark, snapshots, provider)
    chunks, documents = snapshots.read("chunks"), snapshots.read("documents")
    if documents is None:
        raise SystemExit("the index is empty: run ingest-once first")
    if a.command == "status":
        return retrieval.status(documents, chunks).first().asDict()
    profile = ingest.index_profile(provider)["fingerprint"]
    asked = [vars(a)] if a.command == "query" else questions.load(a.questions)
    cases = retrieval.requests(spark, provider, asked)
    top = a.top_k_documents if a.command == "query" else a.top_k
    got = retrieval.retrieve(chunks, documents, cases, getattr(a, "top_k_chunks", None), top, getattr(a, "max_context_chars", None), profile)
    rows = lambda d, *keys: [r.asDict() for r in d.orderBy(*keys).collect()]  # noqa: E731  bounded by the limits of a request
    if a.command == "query":
        context = got["context"].first()
        return {"chunks": rows(got["chunks"], "final_pos"), "documents": rows(got["documents"], "doc_rank"), "context": context["context"] if context else ""}
    expected = spark.createDataFrame([(i, q["question"], q["expect"]) for i, q in enumerate(asked)], "query_id long, question string, expect array<string>")
    found = got["documents"].select("query_id", "doc_rank", "source_path", "doc_score")
    report = {"questions": len(asked), "top_k": top, **retrieval.evaluate(found, expected).first().asDict()}
    if a.verbose:
        ranks = {r["query_id"]: r["rank"] for r in retrieval.case_ranks(found, expected).collect()}
        best: dict = {}
        for r in rows(found, "query_id", "doc_rank"):
            best.setdefault(r["query_id"], []).append(r)
        report["results"] = [{"question": q["question"], "expect": q["expect"], "rank": ranks.get(i), "hit": ranks.get(i) is not None, "top_documents": [r["source_path"] for r in best.get(i, [])],
                              "top_score": best[i][0]["doc_score"] if i in best else None} for i, q in enumerate(asked)]
    return report


def main() -> None:
    spark = SparkSession.builder.appName("folioscope").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    json.dump(run(spark, sys.argv[1:]), sys.stdout, default=str, ensure_ascii=False, indent=2)
    print()


if __name__ == "__main__":
    main()
