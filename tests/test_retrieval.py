import datetime
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope.functions import search, text
from folioscope.operators import ingest, retrieval
from folioscope.plans import registry
from folioscope.settings import Settings
from folioscope.sources import files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", ["hybrid_search", "rerank_fusion", "checksum_dedupe", "snapshot_diff", "question_terms", "transcript_metadata", "ocr_lines", "evaluation"])
def test_query_matches_its_sql(spark, name):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = c.execute(f"SELECT {', '.join(cols)} FROM ({registry.SQL[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(*cols).collect())


def test_lexical_scores_are_those_of_the_sql_to_the_last_bit(spark):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(f"WITH {registry.POOL} SELECT query_id, chunk_id, lexical_score FROM pool").fetchall()
    got = registry._pool(spark, SF).select("query_id", "chunk_id", "lexical_whole").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_rounding_next_to_a_half(spark):
    for x in (0.28343749999999995, 0.2834375, 0.2834374999996, 1.0000005, 2.675e-4, -0.2834375):
        assert one(spark, registry.rounded("x", 6), x=x) == duckdb.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0]


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_terms(spark):
    assert one(spark, text.query_terms(F.col("q")), q="Who is Ada Lovelace_ and what was her ROLE?") == ["ada", "lovelace", "role"]
    assert one(spark, text.query_terms(F.col("q")), q="what is this?") == []
    assert len(one(spark, text.query_terms(F.col("q")), q=" ".join(f"term{i}" for i in range(40)))) == 12


def test_titles_dates_notes(spark):
    vtt = "WEBVTT\n\nNOTE language: en\nNOTE Duration: \"00:12:05.5\"\nMeeting title: Plan\nDate: 3 May 2026\n\n00:00:01.000 --> 00:00:02.500\n<v Ann>Title: no\n00:01:00.000 --> 00:02:03.250\n<v Bob>x<v Ann>y"
    assert one(spark, text.note_fields(F.col("c")), c=vtt) == {"language": "en", "duration": "00:12:05.5"}
    assert one(spark, text.duration(F.col("c")), c=vtt) == 123.25
    assert one(spark, text.speakers(F.col("c")), c=vtt) == ["Ann", "Bob"]
    assert one(spark, text.labelled(F.col("c"), "title"), c=vtt) == "Plan"
    assert [one(spark, text.looks_like_date(F.col("c")), c=x) for x in ("3 May 2026", "2026-05-03", "05/06/2026", "25/06/2026", "soon")] == [True, True, False, True, False]
    assert one(spark, text.name_date(F.col("c")), c="a-2026_05_03.md") == datetime.datetime(2026, 5, 3)
    assert one(spark, text.name_date(F.col("c")), c="a-2026-13-03.md") is None


def test_table_lines_agree(spark):
    for rows in ([["a", "b"], ["1", ""], ["", ""], ["", "2"]], [["a", "a"], ["1", "2"]], [["x"], ["y"]], [[""]]):
        assert one(spark, text.table_lines(F.col("r")), r=rows) == files.table_text(rows)


def test_html():
    assert search.html_text("<html><head><title>t</title></head><p>a&amp;b</p><script>x</script><table><tr><td>1</td><td>2</td></tr></table>") == "a&b\n\n | 1 | 2"


def test_chunks_cover_and_overlap():
    words = " ".join(f"word{i}" for i in range(2000))
    chunks = search.split_chunks(words, 300, 60)
    assert all(words[c["start_char"]:c["end_char"]] == c["content"] and len(c["content"]) <= 300 for c in chunks)
    assert chunks[0]["start_char"] == 0 and chunks[-1]["end_char"] == len(words)
    assert all(b["start_char"] <= a["end_char"] + 1 for a, b in zip(chunks, chunks[1:]))
    assert search.split_chunks("x" * 1000, 300, 60)[0]["content"] == "x" * 300 and search.split_chunks("  ") == []


def test_word_similarity_against_every_stretch():
    q, t = "cat nap", "a catnap, or a long cat nip nap"
    want, grams = set(search._ordered_trigrams(q)), search._ordered_trigrams(t)
    brute = max(len(want & set(grams[i:j])) / len(want | set(grams[i:j])) for i in range(len(grams)) for j in range(i + 1, len(grams) + 1))
    assert search.word_similarity_of(q, t) == pytest.approx(brute)


def test_websearch():
    assert search.cover_rank([("red fox", 1.0)], "red fox") > search.cover_rank([("red a b c fox", 1.0)], "red fox") > 0
    assert search.cover_rank([("red fox", 1.0)], "red -fox") == 0 and search.cover_rank([("red fox", 1.0)], 'blue or "red fox"') > 0


def test_rerank_and_context(spark):
    t = datetime.datetime(2026, 1, 1)
    # pool positions, signals and scores chosen so that the best-case position decides
    rows = [("q", x, x, "/p", "d", "{}", f"{x} body one two three four five six", t, s, lex, 0.5, 0.5 - i / 10, i, sc) for i, (x, s, lex, sc) in enumerate([("a", .9, .1, .1), ("b", .8, .2, .0), ("c", .7, .9, .9)])]
    pool = spark.createDataFrame(rows, "query_id string, chunk_id string, document_id string, source_path string, document_title string, metadata string, content string, effective_at timestamp, semantic_score double, lexical_score double, recency_score double, score double, pool_pos int, sc double")
    got = retrieval.reranked(pool, F.col("sc")).orderBy("final_pos").collect()
    assert [r["chunk_id"] for r in got] == ["c", "a", "b"]
    same = pool.withColumn("content", F.lit("One  two three four five six"))
    assert [r["chunk_id"] for r in retrieval.context_order(same).collect()] == ["a"]
    pack = retrieval.context_pack(retrieval.context_order(pool), 10_000).first()["context"]
    assert pack.count("[SOURCE ") == 3 and "score=0.5000" in pack
    cut = retrieval.context_pack(retrieval.context_order(pool.withColumn("content", F.concat("content", F.repeat(F.lit("z"), 900)))), 500).first()["context"]
    assert cut.count("[SOURCE ") == 1 and cut.endswith("[TRUNCATED]\n")


def test_settings_bounds():
    with pytest.raises(ValueError):
        Settings(chunk_size=100, chunk_overlap=100)
    with pytest.raises(ValueError):
        Settings(rrf_k=0)


def test_scan_of_a_folder(spark, tmp_path):
    from folioscope.streaming.watch import Snapshots, scan_once

    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "example-knowledge.md").write_text("only a placeholder")
    (inbox / "README.md").write_text("no")
    (inbox / "a.md").write_text("---\ntitle: Given\nproject: p\ndate: 2026-02-03\n---\n# Heading\nbody")
    (inbox / "b-2026-01-02.txt").write_bytes("zażółć".encode("cp1250"))
    (inbox / "copy.md").write_text("---\ntitle: Other\n---\n# Heading\nbody")
    (inbox / "empty.md").write_text("")
    snaps, p = Snapshots(spark, f"file://{tmp_path}/index"), ingest.HashEmbedding(8)
    assert scan_once(spark, str(inbox), snaps, p) == {"added": 2, "updated": 0, "unchanged": 0, "removed": 0}
    docs = {r["source_path"]: r for r in snaps.read("documents").collect()}
    assert set(docs) == {"a.md", "b-2026-01-02.txt"} and docs["a.md"]["title"] == "Given" and docs["a.md"]["effective_at"] == datetime.datetime(2026, 2, 3)
    assert docs["b-2026-01-02.txt"]["content"] == "zażółć" and docs["b-2026-01-02.txt"]["effective_at"] == datetime.datetime(2026, 1, 2)
    assert scan_once(spark, str(inbox), snaps, p)["unchanged"] == 2
    (inbox / "b-2026-01-02.txt").unlink()
    (inbox / "c.md").write_text("new text")
    assert scan_once(spark, str(inbox), snaps, p) == {"added": 1, "updated": 0, "unchanged": 1, "removed": 1}
    assert {r["source_path"] for r in snaps.read("documents").where("is_active").collect()} == {"a.md", "c.md"} and snaps.read("chunks").count() == 2


def test_json_metadata_covers_all_events(spark):
    want = duckdb.sql(f"SELECT event_id, event_type, json_extract_string(props, '$.page') AS page, length(props) > 30 AS truncated, substr(props, 1, 30) AS preview FROM '{SF}/events.parquet'").fetchall()
    got = registry.QUERIES["json_metadata"](spark, SF).select("event_id", "event_type", "page", "truncated", "preview").collect()
    assert len(want) > 900 and sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_ocr_lines_cover_all_orders(spark):
    words: dict = {}
    for order, number, part, quantity in duckdb.sql(f"SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS DOUBLE) FROM '{SF}/lineitem.parquet'").fetchall():
        kept = words.setdefault(order, [])
        if number % 4 != 3 and quantity * 2 >= 60:
            kept.append((number // 3, number, f"w{part}"))
    want = {}
    for order, kept in words.items():
        lines: dict = {}
        for line, _, word in sorted(kept):
            lines.setdefault(line, []).append(word)
        text_ = "\n".join(" ".join(x) for _, x in sorted(lines.items()))
        want[order] = text_ if len(kept) >= 2 and len(text_) >= 12 else ""
    got = [tuple(r) for r in registry.QUERIES["ocr_lines"](spark, SF).select("img", "text").collect()]
    assert len(want) > 1000 and sorted(got) == sorted(want.items())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    assert sorted(c.execute(f"SELECT img, text FROM ({registry.SQL['ocr_lines']})").fetchall()) == sorted(got)


def test_all_questions_whole(spark):
    asked = {r["query_id"]: r["query"] for r in registry.questions(spark, SF).collect()}
    assert asked == dict(duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall())
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    whole = f"questions AS (SELECT item_id AS query_id, text AS query, embedding AS q_vec, {registry._terms('text')} AS terms FROM embeddings JOIN benchmark ON item_id = vec_id)"
    for name in ("hybrid_search", "rerank_fusion"):
        got = registry.QUERIES[name](spark, SF)
        cols = sorted(got.columns)
        want = c.execute(f"SELECT {', '.join(cols)} FROM ({registry.SQL[name].replace(registry.QUESTIONS, whole)})").fetchall()
        assert len({r[cols.index("query_id")] for r in want}) == len(asked)
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(*cols).collect())


def test_trigram_similarity_of_all_pairs(spark):
    grams = {i: {f"  {w} "[k:k + 3] for w in re.split(r"[\W_]+", t.lower()) if w for k in range(len(w) + 1)} for i, t in duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()}
    want = {(a, b): len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for a in grams for b in grams if a < b}
    got = {(r["a"], r["b"]): r["sim"] for r in registry.QUERIES["trigram_similarity"](spark, SF).collect()}
    assert got == pytest.approx(want, abs=1e-8)
