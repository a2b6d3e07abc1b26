"""Each operator against brute force, and on nulls, empties, long texts, ties, repeats and clashing columns."""

import datetime  # noqa: F401
import random
import zlib

import numpy as np
import pytest

from folioscope.llm import gru, mixing, outliers, packing, pii, quality, repeats, simhash, topk, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, k long, score double"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ROWS = [(1, "alpha beta gamma " * 30, "en", "a"), (1, "alpha beta gamma " * 30, "en", "a"), (2, None, "en", None), (3, "", None, "b"), (None, "x y z", "de", "b"),
        (4, LONG, "en", "a"), (5, "mail me at Bob.Smith@example.com or +48 600 700 800 now", "en", "c"), (6, "ip 10.0.0.1 card 4111 1111 1111 1111 é", "en", "c"), (7, "  \n ", "en", "a")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), 9, 9, 9, 0.5) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (5, 0, 1), (6, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")


RUNS = {
    "pii": lambda d, _: pii.find_personal_data(d), "repeats": lambda d, _: repeats.remove_repeats(d), "quality": lambda d, lab: quality.classify(d, lab), "outliers": lambda d, _: outliers.judge(d),
    "mixing": lambda d, _: mixing.mix(d), "simhash": lambda d, _: simhash.near_duplicates(d), "gru": lambda d, _: gru.score(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_a_row_a_document(docs, labels, name):
    got = RUNS[name](docs, labels).collect()
    key = lambda v: (v is not None, v or 0)
    assert sorted((r["doc_id"] for r in got), key=key) == sorted((r[0] for r in ROWS), key=key)
    first, second = [r for r in got if r["doc_id"] == 1]
    assert first == second
    assert RUNS[name](docs.where("false"), labels).count() == 0


def test_base_personal_data():
    spans = pii.base_spans("a.b@c.d@e.f.g x 1.2.3.4.5 256.1.1.1 x 4111-1111 1111-1111 +1 (2) 345.678-90 a@b")
    assert spans[0] == ("email", 0, 7)
    assert ("ip", 16, 23) in spans and not any(k == "ip" and s == 26 for k, s, e in spans)
    assert [k for k, _, _ in spans].count("card") == 1 and spans[-1][0] == "phone"
    import re
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice("a1.@- 9é") for _ in range(30))
        assert [x[1:] for x in pii.base_spans(t) if x[0] == "email"] == [m.span() for m in mail.finditer(t)]
        assert [x[1:] for x in pii.base_spans(t) if x[0] == "ip"] == [m.span() for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    pii.base_spans("a" * 500_000 + " " + "1" * 500_000)  # linear


def test_revealing_terms(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("one two three four five six".split()) for _ in range(20))) for i in range(60)]
    rows += [(100 + i, f"{rng.random()} three zyx reaches ada@x.org {rng.random()} two") for i in range(6)]
    rows.append((200, "the name zyx alone"))
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), texts=True).collect()}
    assert "zyx" not in got[200]["text"] and "ada@x.org" not in got[100]["text"] and "two" in got[100]["text"]
    assert all(got[i]["text"] == rows[i][1] for i in range(60))


def test_repeats_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    shared = [word(150), word(260), word(600)]
    texts = [word(rng.randrange(0, 400)) + rng.choice(shared) + word(rng.randrange(0, 300)) + rng.choice(shared)[:rng.randrange(100, 600)] for _ in range(40)] + ["the " * 300, word(10), "ab" * 400]
    got = {r["doc_id"]: r for r in repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), texts=True).collect()}
    data = [t.encode() for t in texts]
    seen: dict = {}
    for t in data:
        for i in range(len(t) - 199):
            seen[t[i:i + 200]] = seen.get(t[i:i + 200], 0) + 1
    for d, t in enumerate(data):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i:i + 200]] > 1:
                gone[i:i + 200] = True
        assert bytes(got[d]["kept"]) == bytes(b for b, g in zip(t, gone) if not g) and got[d]["n_removed"] == gone.sum()


def test_large_groups_of_contexts_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    common = "".join(rng.choice("abcdef") for _ in range(190))
    texts = ["".join(rng.choice("xyz") for _ in range(200)) + "".join(rng.choice("uv") for _ in range(3)) + common + "".join(rng.choice("uv") for _ in range(9)) + "!" * 50 for _ in range(30)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    normal = sorted(map(tuple, repeats.remove_repeats(d).collect()))
    monkeypatch.setattr(repeats.repeated_windows, "__defaults__", (2,))
    assert sorted(map(tuple, repeats.remove_repeats(d).collect())) == normal


def test_base_statistics_against_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        t = "".join(rng.choice(["a ", "b\n", "é ", "a b c d e f g h i ", "#", "\n", "\x1c"]) for _ in range(40))
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", t) if x]
        grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
        covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        assert outliers.base_statistics(t.encode())[:5] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_outliers(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alpha", "be", "gamma", "de"]) + str(rng.random())[2:6] for _ in range(60)), "en", "s") for i in range(300)]
    rows += [(1000 + i, " ".join("#" + str(rng.random())[2:6] + "%%%" for _ in range(60)), "en", "s") for i in range(10)]
    got = {r["doc_id"]: r["kept"] for r in outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(10))


def test_packing(docs):
    got = packing.pack(docs, ids=True).collect()
    encode = packing.Encoder()
    by_seq: dict = {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) > 0
    for rs in by_seq.values():
        rs.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rs] == [sum(x["length"] for x in rs[:i]) for i in range(len(rs))]
        total = sum(r["length"] for r in rs)
        assert total <= 2048 and total & (total - 1) == 0 and len(rs) <= packing.SEGMENTS
    text = {r[0]: r[1] for r in ROWS if r[0] not in (1,)}
    for d, t in text.items():
        ids = [i for r in sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["start"]) for i in r["ids"]]
        assert ids == [*encode(t or "").tolist(), 1]
    assert packing.pack(docs.where("false")).count() == 0
    slow = packing.Encoder()
    slow.fast = None
    for t in ("a<|endoftext|>b", "漢字 \x85 x", "it's 123  \n\n z"):
        if packing._RARE.search(t) or packing._SPECIAL in t:
            assert slow(t).tolist() == encode(t).tolist()


def test_packer_keeps_all_three_limits():
    rng, out = random.Random(7), []
    p = packing.Packer(100, 5, 60, 16)
    sizes = {i: (rng.randrange(1, 250), 0) for i in range(200)}
    for i, (n, _) in sizes.items():
        out += list(p.add(i, n, n // 2))
    out += list(p.finish())
    assert all(sum(x[2] for x in b) <= 100 and len(b) <= 5 for b in out)
    assert {i: sum(x[2] for b in out for x in b if x[0] == i) for i in sizes} == {i: n for i, (n, _) in sizes.items()}


def test_url_rules(spark):
    rows = [(1, "https://Blog.Example.COM/en/x?q#f"), (2, "http://www.example.com/en/"), (3, "x://net/es/"), (4, "x://a.net/fr"), (5, "x://notnet/es/"), (6, None), (7, "no scheme"), (8, "x://a.com"), (9, "x://com/"), (9, "x://com/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' AS host", "true AS hit", "1 AS tokens")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge(pages, none).collect()}
    assert got == {1: ("blog.example.com", "/en/x", "example.com/en/", "block"), 2: ("www.example.com", "/en/", "www.example.com/en/", "allow"), 3: ("net", "/es/", "net/es/", "block"), 4: ("a.net", "/fr", None, "allow"),
                   5: ("notnet", "/es/", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("a.com", "", None, "allow"), 9: ("com", "/", "com/", "allow")}
    assert urls.judge(pages.where("false"), none).count() == 0


def test_mined_url_rules(spark):
    rows = [(i, f"http://{'casino' if i % 4 == 0 else 'books'}.org/{'win' if i % 2 else 'read'}/{i}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(100)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, labels).collect()}
    assert got == {i: "block" if i % 4 == 0 else "allow" for i in range(200)}


def test_topk_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(topk, "BLOCK", 40)
    x = rng.normal(size=(400, 6)) / 3 + rng.integers(-4, 5, size=(400, 1))
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x.astype(np.float32))]
    rows += [(1000, None, 0), (1050, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (1100, [float("nan")] * 6, 0), (1150, [1.0, 2.0], 0), (1151, [2.0, 2.0], 0), (50, rows[50][1], 0), (1200, [], 0), (None, rows[3][1], 0)]
    got = sorted(tuple(r) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    ok = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v, _ in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    want = []
    for a, (i, q) in enumerate(ok):
        if i % 50 == 0:
            best = sorted((-int(q @ r), j) for b, (j, r) in enumerate(ok) if b != a and len(r) == len(q))[:5]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)
    assert topk.products(np.array([[2.0 ** 60]]), np.array([[2.0 ** 60]]))[0, 0] == (1 << 63) - 1


def test_mix_targets(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), None if i % 17 == 0 else f"s{min(i % 11, 6)}") for i in range(1500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    source = {r[0]: r[2] for r in rows}
    size: dict = {}
    for i, t, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = dict(zip(order, [3, 1, 2] * 9))
    target, full = {}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        share = {s: left * w[s] / sum(w[x] for x in order if x not in full) for s in order if s not in full}
        over = {s for s in share if share[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    target = share | {s: 2.0 * size[s] for s in full}
    taken = dict.fromkeys(order, 0)
    for r in got:
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - target[s]) < 2 for s in order)


def test_fingerprints_and_links_against_brute_force(spark, monkeypatch):
    import xxhash
    t = "The quick BROWN fox É the quick brown"
    words = t.encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(t.encode()) % (1 << 64) == want and simhash.fingerprint(b" ") == 0
    rng = random.Random(10)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values):
        for _ in range(8):
            v ^= 1 << rng.randrange(64)
            values.add(v)
    fps = [simhash._signed(v) for v in values]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")

    def groups(edges):
        up = {f: f for f in fps}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x
        for a, b in edges:
            up[max(root(a), root(b))] = min(root(a), root(b))
        return {f: root(f) for f in fps}

    near = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    for bucket in (256, 1):  # pairs inside buckets; one-bit neighbours
        got = [tuple(r) for r in simhash.links(df, bucket=bucket).collect()]
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in got) and groups(got) == groups(near)
    assert simhash.allocate([{0: 1, 1: 9, 2: 99}, {0: 5, 1: 6, 2: 7}, {0: 50, 1: 60, 2: 70}], 2) == [-1, 2, -1]


def test_recurrent_scores(spark):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        lang = rng.choice([("a b c d e", "e"), ("v w x y z", "z")])
        rows.append((i, " ".join(rng.choice(lang[0].split()) for _ in range(rng.randrange(1, 80)))))
    got = gru.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 1}
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_gradients():
    v = gru.Vocabulary(np.arange(50), np.arange(60, 10, -1), 10, 2000, 60)
    net = gru.Network.initial(v)
    net.flat += np.random.default_rng(0).normal(0, 0.05, gru.Network.SIZE).astype(np.float32)
    net.p["bh"][50:] = -30
    ids = np.random.default_rng(1).integers(0, 52, (6, 3))
    x, h, keep = v.input_of[np.vstack([np.full((1, 3), 51), ids[:-1]])], np.zeros((3, gru.HIDDEN), np.float32), np.ones((6, 3), np.float32)
    keep[3, 1] = 0
    grad, _ = net.gradients(x, ids, h, keep, v)

    def loss():
        s, _ = net.forward(x, h, keep, net.project())
        return -float(net.log_probability(s.reshape(-1, gru.HIDDEN).astype(np.float64), ids.reshape(-1), v)[0].mean())

    for name, at in (("u", (3, 5)), ("wx", (2, 40)), ("wc", (1, 0)), ("bx", (7,)), ("wh", (4, 2))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-2
        up = loss()
        net.p[name][at] = old - 1e-2
        down = loss()
        net.p[name][at] = old
        assert grad[name][at] == pytest.approx((up - down) / 2e-2, rel=0.08, abs=2e-4), name


def test_similar_documents_against_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 40, 150, 400]))]
        texts.append(" ".join(words))
        for rate in (0, 0.005, 0.02, 0.05):
            texts.append(" ".join(w if rng.random() >= rate else "other" for w in words))
    hot = [f"h{i}" for i in range(200)]
    texts += [" ".join(hot[:i] + [f"edit{i}"] + hot[i + 1 :]) for i in range(100)]  # a large group of near copies
    texts += [None, "", " \n", "ONE two", "one  TWO"]
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = sorted(i for i in range(len(texts)) if find(i) == i)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (0, texts[0], "x")], "doc_id long, text string, fp string").repartition(4)
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(None) == 1 and sorted(i for i in ids if i is not None) == want
    assert simhash.deduplicated(df.where("false")).count() == 0


def test_crowded_buckets_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BAND", 1)
    monkeypatch.setattr(simhash, "BANDS", 1)
    rows = []
    for family in range(30):  # chains: each text resembles the next, not the one after it
        words = [f"f{family}w{i}" for i in range(100)]
        for step in range(6):
            rows.append((len(rows), " ".join([f"f{family}new{i}" if i < 6 * step else w for i, w in enumerate(words)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for _, t in rows]
    band = {r["doc_id"]: r["bands"][0] for r in simhash.signatures(df).collect()}
    want = [(i, j) for i in range(len(rows)) for j in range(i) if band[i] == band[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(want) > 60
    for block in (3, 256):
        got = {r["node"]: r["component_id"] for r in simhash.similar(df, block=block).collect()}
        assert [(i, j) for i, j in want if got[i] != got[j]] == []


def test_the_network_trains_on_every_token(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 400)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    few = df.where("doc_id = 0").selectExpr("doc_id", "substring(text, 1, 40) AS text")
    v, _ = gru.vocabulary(gru.word_counts(gru.segments(df)))
    start = gru.Network.initial(v).flat
    moved = gru.trained(gru.segments(few), v).flat
    assert np.isfinite(moved).all() and (moved != start).any()

    def count(net, chunks, v, optimiser):
        net.flat[0] += (chunks >= 0).sum()

    monkeypatch.setattr(gru, "train_on", count)
    monkeypatch.setattr(gru, "SCORE_TOKENS", 1000)
    assert round(float(gru.trained(gru.segments(df), v).flat[0] - start[0])) == v.total


def test_mix_prefers_longer_documents_at_unequal_probabilities(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * rng.choice([3, 40, 700])), "a" if i % 3 else "b") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = mixing.word_sizes(df)
    classes = mixing.shares(sizes).collect()
    for s in {r["__fs_s"] for r in classes}:
        own = sorted((r for r in classes if r["__fs_s"] == s), key=lambda r: r["__fs_c"])
        expected = [r["copies"] + r["inclusion"] for r in own]
        assert expected == sorted(expected) and len({round(x, 6) for x in expected}) > 1
        words = {r["__fs_c"]: sum(len(t.split()) for _, t, src in rows if f"s{src}" == s and len(t.split()).bit_length() == r["__fs_c"]) for r in own}
        assert sum(e * words[r["__fs_c"]] for e, r in zip(expected, own)) == pytest.approx(own[0]["target"])
    got = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    share = lambda n: np.mean([got[i]["taken"] / n for i, t, s in rows if s == "b" and len(t.split()) == n])
    by = {r["__fs_c"]: r["copies"] + r["inclusion"] for r in classes if r["__fs_s"] == "sb"}
    assert all(share(n) == pytest.approx(by[n.bit_length()], abs=0.12) for n in (3, 40, 700))


def test_mixed_documents_keep_their_layout(spark):
    rows = [(i, f"  line {i}\n\tnext  line\n\nlast", "s" if i % 2 else None, i) for i in range(50)] + [(90, None, "s", 1), (91, " ", "s", 1), (None, "a b", "s", 2), (3, rows_text := "x\ny", "s", 5), (3, rows_text, "s", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target long")
    taken = {r["doc_id"]: r for r in mixing.mix(df).collect() if r["doc_id"] not in (None, 3)}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    kept: dict = {}
    for r in out.collect():
        kept.setdefault(r["doc_id"], []).append(r["text"])
    text = {r[0]: r[1] for r in rows}
    for i, r in taken.items():
        parts = kept.get(i, [])
        assert sum(len(t.split()) for t in parts) == r["taken"] and all(text[i].startswith(t) for t in parts)
    assert 90 not in kept and 91 not in kept
    assert mixing.mixed_documents(df.where("false")).count() == 0


def test_cover_trees_are_nested_covering_and_separated():
    rng = np.random.default_rng(13)
    for x in (np.floor(rng.normal(size=(500, 5)) * 100), np.repeat(np.floor(rng.normal(size=(9, 3)) * 50), 40, axis=0), np.zeros((70, 4)), np.full((3, 2), 1e300)):
        order, nodes = topk.grow(x, 16)
        y = x[order]
        assert sorted(order) == list(range(len(x))) and (nodes[0, 1:3] == [0, len(x)]).all()
        if len(nodes) == 1:
            continue
        top = np.sqrt(((y - y[int(nodes[0, topk.CENTRE])]) ** 2).sum(axis=1)).max()
        for i in range(int(nodes[:, topk.LEVEL].max()) + 1):
            level = nodes[nodes[:, topk.LEVEL] == i]
            assert level[0, topk.START] == 0 and (level[1:, topk.START] == level[:-1, topk.END]).all() and level[-1, topk.END] == len(x)
            c = y[level[:, topk.CENTRE].astype(int)]
            apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(axis=2))[~np.eye(len(c), dtype=bool)]
            assert i == 0 or apart.min() > top / 2 ** i
            if i:
                above = {tuple(v) for v in y[nodes[nodes[:, topk.LEVEL] == i - 1][:, topk.CENTRE].astype(int)]}
                assert above <= {tuple(v) for v in c}
            for n in level:
                far = np.sqrt(((y[int(n[topk.START]):int(n[topk.END])] - y[int(n[topk.CENTRE])]) ** 2).sum(axis=1)).max()
                assert far <= n[topk.RADIUS] + 1e-6


def test_clustered_vectors_are_pruned_at_the_usual_sizes(spark):
    rng = np.random.default_rng(14)
    heart = rng.normal(size=(40, 16))
    x = heart[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>")
    got = topk.pruning(df)
    assert got["data_blocks"] > 20 and got["query_blocks"] > 1 and got["block_pairs_pruned"] + got["node_pairs_pruned"] > 100, got
    v = np.floor(256 * x.astype(np.float32).astype(float)).astype(int)
    want = sorted((q, n, j, -s) for q in range(0, 3000, 50) for n, (s, j) in enumerate(sorted((-int(a), j) for j, a in enumerate(v @ v[q]) if j != q)[:5], 1))
    assert sorted(tuple(r) for r in topk.search(df).collect()) == want


def test_long_urls_and_few_labels_end_soon(spark):
    long_url = "http://a.org/" + "/".join(f"word{i}" for i in range(500))
    rows = [(1, long_url + "/1"), (2, "http://b.org/x/2")] + [(100 + i, f"{long_url}/{100 + i}") for i in range(40)] + [(300 + i, f"http://c.org/fine/{300 + i}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    few = spark.createDataFrame([(1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r["verdict"] for r in urls.judge(pages, few).collect()} == {"allow"}
    many = spark.createDataFrame([(i, int(i >= 300), 0) for i, _ in rows if i >= 100], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, many).collect()}
    assert got == {i: "block" if "word3" in u else "allow" for i, u in rows}


def test_mined_rules_against_brute_force(spark):
    from itertools import combinations

    rng = random.Random(15)
    rows = []
    for i in range(600):
        words = rng.sample("a1 b2 c3 d4 e5 f6".split(), 3)
        rows.append((f"http://h.org/{'/'.join(words)}/{i}", {"a1", "b2"} <= set(words) or rng.random() < 0.1))
    got = {tuple(r["antecedent"]): (r["confidence"], r["bad_rows"]) for r in urls.mine_rules(spark.createDataFrame(rows, "url string, bad boolean")).collect()}
    sets = [({f"p:{w}" for w in u.split("/")[3:6]} | {"h:h", "h:org"}, bad) for u, bad in rows]
    base = sum(b for _, b in sets) / len(sets)
    want = {}
    for size in (1, 2, 3):
        for c in combinations([f"p:{w}" for w in "a1 b2 c3 d4 e5 f6".split()], size):
            held = [b for t, b in sets if set(c) <= t]
            if sum(held) >= 20 and sum(held) / len(held) >= max(0.7, 1.5 * base):
                want[c] = (sum(held) / len(held), sum(held))
    want = {c: v for c, v in want.items() if not any(set(o) < set(c) and len(o) == len(c) - 1 and want[o][0] >= v[0] for o in want)}
    assert {k: pytest.approx(v) for k, v in want.items()} == got
    assert ("p:a1", "p:b2") in got


def test_rows_that_stay_are_not_moved(spark):
    from pyspark.sql import functions as F

    from folioscope.llm import common

    rng = random.Random(23)
    rows = [(i, " ".join(rng.choice(NEAR_WORDS) for _ in range(40))) for i in range(300)]
    rows += [(300 + i, rows[i][1] + " more") for i in range(20)] + [(5, "another text of five")] + rows[7:9] + [(None, "no id"), (None, "no id"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6, F.spark_partition_id()).select("doc_id", "text")
    out = [tuple(r) for r in simhash.deduplicated(common.staged(df)).collect()]
    assert sorted(out, key=repr) == sorted({*rows[:300], (5, "another text of five"), (None, "no id"), (None, None)}, key=repr)
    source = common.staged(df)
    before = {r["doc_id"]: r["p"] for r in source.withColumn("p", F.spark_partition_id()).collect()}
    after = {r["doc_id"]: r["p"] for r in simhash.deduplicated(source).withColumn("p", F.spark_partition_id()).collect()}
    assert all(after[i] == before[i] for i in range(300) if i not in (5, 7, 8)) and len(set(before.values())) > 1
    ids = spark.createDataFrame([(i,) for i in range(0, 5000, 7)] * 2, "x long")
    got = {r["id"]: r["__fs_maybe"] for r in common.marked(spark.range(5000), "id", ids, 1 << 10).collect()}
    assert all(got[i] for i in range(0, 5000, 7)) and sum(got.values()) < 1000 and len(got) == 5000


NEAR_WORDS = [f"word{i}" for i in range(500)]


def test_segments_are_read_a_few_at_a_time(spark):
    import glob

    import pyarrow.parquet as pq

    many = " ".join(f"w{i}" for i in range(70_000))  # more words than two bytes can tell apart
    texts = [many, "b a b", None, *["x " * 250_001] * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    tokens = gru.staged(gru.segments(df), gru.SEGMENTS_A_FILE)
    files = [f for p in tokens.inputFiles() for f in glob.glob(p.removeprefix("file://"))]
    rows = [pq.ParquetFile(f).metadata.num_rows for f in files]
    assert sum(rows) == 20 and max(rows) == gru.SEGMENTS_A_FILE
    got, v = {}, gru.Vocabulary(np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0, 0)
    for _, local, words, (ids,) in gru._documents(tokens.toArrow().to_batches(), v, ["doc_id"]):
        got |= {i: (x.dtype.itemsize, words[x].tolist()) for i, x in zip(ids.to_pylist(), local)}
    for i, t in enumerate(texts):
        assert got[i] == (4 if i < 4 else 2, [*(gru.word_hash(w.encode()) for w in (t or "").split()), 0])


def _rules_by_brute_force(rows, sizes):
    from itertools import combinations

    sets = [({f"p:{w}" for w in u.split("/")[3:-1]}, bad) for u, bad in rows]
    base, words = sum(b for _, b in sets) / len(sets), sorted(set().union(*(t for t, _ in sets)))
    want = {}
    for size in sizes:
        for c in combinations(words, size):
            held = [b for t, b in sets if t.issuperset(c)]
            if sum(held) >= 20 and sum(held) / len(held) >= max(0.7, 1.5 * base):
                want[c] = (sum(held) / len(held), sum(held))
    return {c: pytest.approx(v) for c, v in want.items() if not any(set(o) < set(c) and len(o) == len(c) - 1 and want[o][0] >= v[0] for o in want)}


def test_rules_of_urls_with_many_items_against_brute_force(spark):
    rng, rows = random.Random(21), []
    for i in range(900):
        both = rng.random()
        bad = both < 0.08 or rng.random() < 0.3
        words = [f"n{k:02d}" for k in range(22) if rng.random() < (0.65 if bad else 0.3)]
        words += ["pair1", "pair2"] if both < 0.08 else [f"pair{1 + i % 2}"]  # each alone is mostly good
        rng.shuffle(words)
        rows.append((f"http://h.org/{'/'.join(words)}/{i}", bad))
    got = {tuple(r["antecedent"]): (r["confidence"], r["bad_rows"]) for r in urls.mine_rules(spark.createDataFrame(rows, "url string, bad boolean"), support=0.07).collect()}
    want = {c: v for c, v in _rules_by_brute_force(rows, (1, 2, 3)).items() if v.expected[1] >= 63}
    assert {c: v for c, v in got.items() if len(c) <= 3} == want
    assert ("p:pair1", "p:pair2") in got


def test_both_ways_to_mine_give_the_same_rules(spark):
    rng, rows = random.Random(22), []
    for i in range(500):
        words = rng.sample("a1 b2 c3 d4 e5 f6 g7".split(), 4)
        rows.append((f"http://h.org/{'/'.join(words)}/{i}", len({"a1", "b2", "c3"} & set(words)) > 1 and rng.random() < 0.9 or rng.random() < 0.1))
    df = spark.createDataFrame(rows, "url string, bad boolean")
    one, other = ({tuple(r["antecedent"]): tuple(r)[1:] for r in urls.mine_rules(df, items=k).collect()} for k in (urls.ITEMS, 2))
    assert one == other and len(one) > 3


def test_personal_data_with_clashing_columns(spark):
    rows = [(i, f"write to ada{i}@x.org please", "n", 7, 1) for i in range(4)] + [(9, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, added string, spans int, term int")
    out = pii.find_personal_data(df, texts=True)
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(df.columns) <= set(out.columns) and got[2]["text"] == "write to [EMAIL] please" and got[2]["added"] == "n" and got[9]["text"] in (None, "")


def test_revealing_share_against_brute_force(spark):
    rng = random.Random(16)
    rows = [f"noise {rng.random()} the end" for _ in range(50)] + [f"{rng.random()} agent zorro answers bond@mi.org daily {rng.random()}" for _ in range(5)] + [f"zorro was seen {rng.random()}" for _ in range(3)]
    df = spark.createDataFrame(list(enumerate(rows + rows[-4:])), "doc_id long, text string")
    got = {r["term"]: r["share"] for r in pii.revealing_terms(df, threshold=0.0).collect()}
    n, n_e = len(set(rows)), 5
    for term, n_t in (("zorro", 8), ("agent", 5), ("daily", 5)):
        assert got[term] == pytest.approx(min(1.0, np.log(n * 5 / (n_t * n_e)) / np.log(n / n_e)))


def test_outliers_of_sparse_groups_and_two_clusters(spark):
    rng = random.Random(17)
    clean = lambda: " ".join(rng.choice(["alpha", "be", "gamma", "de"]) + str(rng.random())[2:6] for _ in range(60))
    rows = [(i, clean(), "en", "big") for i in range(300)] + [(400 + i, clean(), "en", "tiny") for i in range(5)] + [(500, " ".join("#" + str(rng.random())[2:6] + "%%%" for _ in range(60)), "en", "tiny")]
    rows += [(600 + i, " ".join("#" + str(rng.random())[2:6] + "%%%" for _ in range(60)), "en", "big") for i in range(60)]  # a sixth of the group, all alike
    got = {r["doc_id"]: r["kept"] for r in outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(300)) and all(got[400 + i] for i in range(5)) and not got[500] and not any(got[600 + i] for i in range(60))


def test_sparse_sites_are_shrunk_and_rates_match_brute_force(spark):
    rng = random.Random(18)
    good = lambda: " ".join(rng.choice("plain words of a calm and even text here".split()) + str(rng.randrange(99)) for _ in range(60))
    bad = lambda: " ".join(["win $$$ ### |||"] * 15)
    rows = [(i, good(), "en", "fair") for i in range(150)] + [(200 + i, bad(), "en", "foul") for i in range(150)] + [(400, bad(), "en", "one"), (401, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in (*range(0, 150, 3), *range(200, 350, 3))], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels, texts=False).collect()}
    assert len(got) == len(rows) and "text" not in quality.classify(docs, labels, texts=False).columns
    assert all(got[i]["__fs_kept"] for i in range(150)) and not any(got[200 + i]["__fs_kept"] for i in range(150))
    p = {i: r["__fs_doc"] for i, r in got.items()}
    site = {r[0]: r[3] for r in rows}
    hosts: dict = {}
    for i in p:
        hosts.setdefault(site[i], []).append(p[i])
    rate = sum(p.values()) / len(p)
    n = {h: len(v) for h, v in hosts.items()}
    spread = np.mean([(np.mean(v) - rate) ** 2 for v in hosts.values()]) / (rate * (1 - rate)) - np.mean([1 / x for x in n.values()])
    worth = 1e6 if spread <= 1e-6 else min(1e6, max(2.0, 1 / spread - 1))
    for i, r in got.items():
        assert r["__fs_host"] == pytest.approx((sum(hosts[site[i]]) + worth * rate) / (n[site[i]] + worth))
    assert abs(got[400]["__fs_host"] - p[400]) > abs(got[200]["__fs_host"] - np.mean(hosts["foul"]))  # one document moves its host less than many
    both = quality.classify(docs, labels).drop("text").collect()
    assert {r["doc_id"]: r["__fs_good"] for r in both} == pytest.approx({i: r["__fs_good"] for i, r in got.items()})
    assert quality.classify(docs, labels.where("false")).where("NOT __fs_kept").count() == 0


def test_base_scores_against_brute_force(spark):
    rng = random.Random(19)
    rows = [(i, " ".join(rng.choice(["The", "the", "cat", f"rare{rng.randrange(400)}", "É"]) for _ in range(rng.randrange(0, 50)))) for i in range(200)] + [(300, None), (None, "the cat"), (5, "the\x1fcat x")]
    got = gru.score(spark.createDataFrame(rows, "doc_id long, text string"), size=20).collect()
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    tokens = [[w for w in __import__("re").split("[\x20\x09-\x0d]+", low(t)) if w] + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    count: dict = {}
    for t, h in zip(tokens, held):
        for w in () if h else t:
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    want = sorted((i if i is not None else -1, h, len(t), sum(w in count for w in t), round(sum(np.log10((count.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for (i, _), t, h in zip(rows, tokens, held))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_both_encoders_give_the_same_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    slow, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.Encoder()
    rng = random.Random(20)
    texts = ["a<|endoftext|>b", "漢字 \x85 x", "it's 123  \n\n z", "x" * 5000, "Ärger  über\t\tdas\r\n'LL we'll", "", " ", "a b ÿ ˿ ́", *(t for _, t, *_ in ROWS if t)]
    texts += ["".join(rng.choice(" \n\tabcXYZ019.,'!-éßñ" + "€" * (i % 2)) for _ in range(rng.randrange(1, 300))) for i in range(300)]
    fast = 0
    for t in texts:
        fast += not (packing._RARE.search(t) or packing._SPECIAL in t)
        assert encode(t).tolist() == slow.encode(t, add_special_tokens=False).ids, t[:50]
    assert fast > 50


def test_cards_and_phones_against_the_patterns():
    import re

    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def passes(digits):
        total = 0
        for i, c in enumerate(reversed([int(x) for x in digits])):
            total += c if i % 2 == 0 else (2 * c - 9 if c > 4 else 2 * c)
        return total % 10 == 0

    rng = random.Random(21)
    hits = 0
    for _ in range(4000):
        t = "".join(rng.choice("0123456789" * 4 + " -+().x") for _ in range(60))
        got = pii.base_spans(t)
        want = [m.span() for m in card.finditer(t) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and passes(d)]
        assert [x[1:] for x in got if x[0] == "card"] == want
        hits += len(want)
        assert [x[1:] for x in got if x[0] == "phone"] == [m.span() for m in phone.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    assert hits > 20


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(22)
    text = lambda: " ".join(rng.choice("plain words of a calm and even text here".split()) + str(rng.randrange(999)) for _ in range(80))
    twin = text()
    rows = [(i, text(), "en", f"s{i % 4}") for i in range(60)] + [(100, twin, "en", "s1"), (101, twin, "en", "s2"), (102, twin + " more", "en", "s2"), (102, twin + " more", "en", "s2")]
    rows += [(200 + i, " ".join(["win $$$ ### |||"] * 20), "en", "foul") for i in range(30)] + [(300, None, None, None), (301, "", "en", "s1"), (None, text(), "en", "s1"), (302, f"{text()} a.b@c.org", "en", "s3")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "x", 1.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, added string, node double")
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in (*range(0, 60, 2), *range(200, 230, 2))], "doc_id long, quality int, toxic int")
    d = tmp_path / "sf"
    docs.write.parquet(f"file://{d}/documents.parquet")
    labels.write.parquet(f"file://{d}/labels.parquet")
    at = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, f"file://{d}")
        if name != "packing":
            assert out.columns == docs.columns and stage(spark, docs.where("false"), f"file://{d}").count() == 0
        out.write.parquet(f"file://{tmp_path}/{name}")
        at = spark.read.parquet(f"file://{tmp_path}/{name}")
        seen[name] = at.collect()
    ids = lambda name: [r["doc_id"] for r in seen[name]]
    assert not [i for i in ids("quality") if i is not None and 200 <= i < 230] and {*range(60), 100, 101, 102, 302} <= set(ids("quality"))
    assert {*range(60), 100, 302} <= set(ids("near_duplicates")) and not {101, 102} & set(ids("near_duplicates")) and len(ids("near_duplicates")) == len(set(ids("near_duplicates")))
    one = next(r for r in seen["personal_data"] if r["doc_id"] == 302)
    assert one["text"].endswith(" [EMAIL]") and one["n_chars"] == len(one["text"]) and one["added"] == "x"
    words: dict = {}
    for r in seen["personal_data"]:
        words[r["source"]] = words.get(r["source"], 0) + len((r["text"] or "").split())
    assert sum(len(r["text"].split()) for r in seen["mix"]) == pytest.approx(1.5 * sum(words.values()), rel=0.02)
    assert sum(r["length"] for r in seen["packing"]) == sum(len(packing.Encoder()(r["text"])) + 1 for r in seen["mix"])
    total = corpus_pipeline.run(spark, f"file://{d}")
    assert sorted(map(tuple, total.select("doc_id", "start", "length", "ids_crc32").collect()), key=repr) == sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in seen["packing"]), key=repr)


def test_mix_counts_words_without_python_workers_and_stages_one_table(spark):
    import re

    from pyspark.sql import functions as F

    from folioscope.llm import common

    texts = [None, "", " \t\n", "a", " a\x0bb ", "\x1cé x 　 y\x0c\r", "𝄞 𝄞\n\n𝄞", " " * 5000 + "z" * 70_000 + " " * 5000, LONG, "\x00 \x1f a"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    sizes = {r["doc_id"]: r["size"] for r in mixing.word_sizes(df).collect()}
    word = re.compile(r"[^\x20\x09-\x0D]+")
    ends = [[m.end() for m in word.finditer(t or "")] for t in texts]
    assert [sizes[i] for i in range(len(texts))] == [len(e) for e in ends]
    asked = [(t, n, t[:e[min(n, len(e)) - 1]]) for t, e in zip(texts, ends) if e for n in {1, (len(e) + 1) // 2, len(e)}]
    got = spark.createDataFrame(asked, "t string, n long, want string").select("want", mixing.first_words(F.col("t"), F.col("n")).alias("got")).collect()
    assert len(got) == len(asked) and all(r["want"] == r["got"] for r in got)
    mark = common.staged_so_far()
    plan = mixing.mix(df)._jdf.queryExecution().toString()
    assert "InArrow" not in plan and "Python" not in plan
    assert common.staged_so_far() - mark == 1


def test_held_tables_keep_their_rows_however_many(spark):
    from folioscope.llm import common

    df = spark.range(25).selectExpr("id", "IF(id % 3 = 0, null, id / 7) x", "IF(id % 2 = 0, null, concat('s', id)) s")
    want = sorted(map(str, df.collect()))
    for limit, files in ((25, 0), (24, 1), (0, 1)):
        mark = common.staged_so_far()
        assert sorted(map(str, common.held(df, limit).collect())) == want and common.staged_so_far() - mark == files
    assert common.held(df.where("id < 0")).count() == 0


def test_the_mix_stage_needs_no_python_workers_and_stages_one_table(spark):
    import corpus_pipeline
    from folioscope.llm import common

    df = spark.createDataFrame([(i, "a b  c " * (i % 5), "en", "s" if i % 2 else None, 0) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    mark = common.staged_so_far()
    out = corpus_pipeline.mix(spark, df, "")
    plan = out._jdf.queryExecution().toString()
    assert "InArrow" not in plan and common.staged_so_far() - mark == 1
    assert out.columns == df.columns and all(r["n_chars"] == len(r["text"]) > 0 for r in out.collect())


def test_outliers_stage_nothing_but_texts_statistics_and_vectors(spark):
    from folioscope.llm import common

    df = spark.createDataFrame([(i, f"alpha{i} beta{i % 7} gamma " * 8 if i % 9 else None, "en" if i % 2 else None, f"s{i % 3}") for i in range(60)], "doc_id long, text string, lang string, source string")
    mark = common.staged_so_far()
    got = outliers.judge(df, least_group=10)
    assert common.staged_so_far() - mark == 2 and got.count() == 60


@pytest.mark.parametrize("side", (4, 4096))
def test_open_buckets_are_compared_in_few_rows(spark, monkeypatch, side):
    monkeypatch.setattr(simhash, "SIDE", side)
    sizes = {1: (600, 40), 2: (5, 2), 3: (90, 60), 4: (1, 30), 5: (2000, 3)}  # members of the usual label, and of others
    label, left = {}, []
    for key, (usual, others) in sizes.items():
        for i in range(usual + others):
            node = key * 10_000 + i
            label[node] = key * 10_000 if i < usual else node - i % 2
            left.append((key, node))
    labels = spark.createDataFrame(list(label.items()), "node long, label long")
    rows = simhash.cells(spark.createDataFrame(left, "key long, node long"), labels, 16).collect()
    met, members = {}, {}
    for r in rows:
        members.setdefault((r["key"], r["i"], r["j"]), []).append((r["node"], r["own"]))
        assert r["label"] == label[r["node"]]
    for (_, _, j), cell in members.items():
        for at, (a, own) in enumerate(cell):
            for b, other in cell[:at]:
                if label[a] != label[b] and (j == 0 or own != other):
                    met[frozenset((a, b))] = met.get(frozenset((a, b)), 0) + 1
    nodes = {key: [n for k, n in left if k == key] for key in sizes}
    want = {frozenset((a, b)) for n in nodes.values() for i, a in enumerate(n) for b in n[:i] if label[a] != label[b]}
    assert set(met) == want and set(met.values()) == {1}
    for key, (usual, others) in sizes.items():  # pairs of blocks of 16 made 126 rows a member of bucket 5
        if others <= side:
            assert sum(r["key"] == key for r in rows) <= 2 * (usual + others)


def test_few_others_in_a_large_bucket_lose_no_pair(spark, monkeypatch):
    from folioscope.llm import common

    monkeypatch.setattr(simhash, "BAND", 1)
    monkeypatch.setattr(simhash, "BANDS", 1)
    rng = random.Random(31)
    words = [f"t{i}" for i in range(120)]
    texts = [" ".join(words[:i % 110] + [f"own{i}"] + words[i % 110 + 1 :]) for i in range(150)]
    for i in range(40):  # too far from the template, some close to each other
        far = words[:60] + [f"far{i // 2}x{k}" for k in range(60)]
        texts.append(" ".join(far if i % 2 else far[:-1] + [f"end{rng.random()}"]))
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    df = common.staged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    band = {r["doc_id"]: r["bands"][0] for r in simhash.signatures(df).collect()}
    want = [(i, j) for i in range(len(texts)) for j in range(i) if band[i] == band[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for side in (4, 4096):
        monkeypatch.setattr(simhash, "SIDE", side)
        got = {r["node"]: r["component_id"] for r in simhash.similar(df, block=8).collect()}
        assert [(i, j) for i, j in want if got[i] != got[j]] == []
        assert len(set(got.values())) >= 20


def test_softmaxes_run_over_few_states_and_match_brute_force(monkeypatch):
    rng = np.random.default_rng(9)
    counts = np.sort(rng.integers(2, 400, 3000))[::-1]
    v = gru.Vocabulary(np.arange(3000), counts, 50, int(counts.sum()) + 90, 3041)
    net = gru.Network.initial(v)
    net.flat += rng.normal(0, 0.05, net.flat.shape).astype(np.float32)
    ids = rng.integers(0, v.n + 2, (gru.WINDOW, 64))
    before = np.vstack([np.full((1, 64), v.n + 1), ids[:-1]])
    ids[20:, :5] = -1  # padding
    seen = []
    plain = gru._exponentials
    monkeypatch.setattr(gru, "_exponentials", lambda logits, safe: seen.append(logits.shape) or plain(logits, safe))
    x, keep = v.input_of[before], (before != v.n + 1).astype(np.float32)
    h = np.zeros((64, gru.HIDDEN), np.float32)
    grad, _ = net.gradients(x, ids, h, keep, v)
    assert max(n for n, width in seen if width == gru.CLASSES) <= 512  # all 1,988 at once before
    states, _ = net.forward(x, h, keep, net.project())
    real = ids >= 0
    s, want, by_class = states[real].astype(np.float64), ids[real], np.zeros((gru.HIDDEN, gru.CLASSES))
    logits = s @ net.p["wc"] + net.p["bc"]
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    expected = []
    for state, i, c in zip(s, want, p):
        k = v.class_of[i]
        by_class += np.outer(state, (c - np.eye(gru.CLASSES)[k]) / len(want))
        within = v.within[i]
        if k < gru.HEAD_CLASSES:
            words = slice(k * gru.MEMBERS, (k + 1) * gru.MEMBERS)
            one = net.p["wh"][words] @ state + net.p["bh"][words]
            within = one[i % gru.MEMBERS] - np.log(np.exp(one).sum())
        expected.append(np.log(c[k]) + within)
    for given in (states[real], states[real][None]):
        assert np.allclose(net.log_probability(given, want, v)[0], expected, atol=1e-4)
    assert np.allclose(grad["wc"], by_class, atol=1e-5)
    by_input = {i for i in np.unique(x[:20]).tolist()}
    assert all(np.abs(grad["e"][i]).max() > 0 for i in by_input) and not np.abs(np.delete(grad["e"], np.unique(x), axis=0)).any()
