"""SimHash near-duplicates: fingerprints, generalised pigeonhole search, components."""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, as_bytes, components, marked, slices, staged, table

SHINGLE, DISTANCE, PARTS = 3, 2, 3
#: Near-duplicates by similarity: words a shingle and least Jaccard similarity.
WIDE, SIMILAR = 5, 0.8
#: Minima a band and bands. Texts of similarity 0.8 share a band with probability 0.9995.
BAND, BANDS = 6, 25
#: Members of a bucket that are compared in one cell at least, members of a side up to which a cell grows with its bucket, and residue classes in which a text's shingles are counted.
BLOCK, SIDE, CLASSES = 256, 2048, 256
BUCKET_KEY = ["key", "i", "j"]
#: Buckets of up to so many fingerprints are compared inside; larger ones go through one-bit neighbours.
BUCKET = 256

_LANES = np.uint64(0x0101010101010101)


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def bit_majority(hashes: np.ndarray) -> int:
    """64-bit majority of uint64 hashes: a bit is 1 if set in over half of them."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros((8, 8), np.int64)  # [shift, byte lane]
    starts = np.arange(0, n, 255)
    for s in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(s)) & _LANES, starts)  # lanes hold 255 at most
        counts[s] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    on = 2 * counts > n
    return int(sum(1 << (8 * lane + s) for s in range(8) for lane in range(8) if on[s, lane]))


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a UTF-8 text, repeats included; fewer words are one shingle, no words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h = xxhash.xxh64_intdigest
    return np.array([h(g, 42) for g in grams], np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text, as a signed 64-bit integer."""
    return _signed(bit_majority(shingle_hashes(text, shingle)))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp."""

    def run(batches):
        for b in slices(batches):
            fp = pa.array([fingerprint(t, shingle) for t in as_bytes(b, "text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), fp], names=["doc_id", "fp"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, fp long")


def correlated_parts(fps: DataFrame, parts: int = PARTS) -> list[list[int]]:
    """The 64 bits in groups of near equal size, correlated bits together.

    Bit and bit-pair counts are summed over all fingerprints; only 65 x 64 sums reach the driver.
    """

    def count(batches):
        both, ones, n = np.zeros((64, 64), np.int64), np.zeros(64, np.int64), 0
        for pdf in batches:
            bits = np.unpackbits(pdf["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += np.rint(bits.T @ bits).astype(np.int64)
            n += len(bits)
        i, j = np.divmod(np.arange(4096), 64)
        yield pd.DataFrame({"i": np.append(i, 64), "j": np.append(j, 0), "n": np.append(both.ravel(), n)})

    sums = fps.select("fp").mapInPandas(count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()
    both, n = np.zeros((64, 64)), 1
    for i, j, v in zip(sums["i"], sums["j"], sums["n"]):
        if i == 64:
            n = max(1, v)
        else:
            both[i, j] = v
    p = both / n
    mean = np.diag(p).copy()
    sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    link = np.abs((p - np.outer(mean, mean)) / np.outer(sd, sd))
    free, out = set(range(64)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        seed = max(free, key=lambda b: (link[b, list(free)].sum(), -b))
        group = [seed]
        free.discard(seed)
        while len(group) < size:
            best = max(free, key=lambda b: (link[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def allocate(costs: list[dict[int, float]], distance: int) -> list[int]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = distance + 1 at least cost (dynamic programming).

    Two fingerprints within the distance differ in at most t_i bits of some part i, for any such
    allocation: else they would differ in sum(t_i + 1) > distance bits. -1 leaves a part out.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, distance + 1 - used):
                if t in cost or t == -1:
                    total = c + (cost[t] if t >= 0 else 0.0)
                    if used + t + 1 not in new or total < new[used + t + 1][0]:
                        new[used + t + 1] = (total, [*ts, t])
        best = new
    return best[distance + 1][1]


def part_value(bits: list[int]) -> F.Column:
    mask = sum(1 << b for b in bits)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def links(fps: DataFrame, distance: int = DISTANCE, parts: int = PARTS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all pairs within the distance.

    fps has one row a fingerprint. Distances up to 2 (two one-bit neighbourhoods meet exactly
    then). Candidates share a key of some part: the part's bits, or, for a threshold over 0,
    a one-bit neighbour of them. Buckets of up to `bucket` fingerprints are verified
    inside, which leaves a spanning forest. In larger ones each fingerprint stands under its 65
    neighbours: those under one neighbour, 65 at most, are all within 2 bits, and each
    pair within 2 bits meets under one.
    """
    if not 1 <= distance <= 2:
        raise ValueError("distance must be 1 or 2")
    groups = correlated_parts(fps, parts)
    n = fps.count()
    costs = []
    for bits in groups:
        same = fps.groupBy(part_value(bits).alias("v")).count().agg(F.sum(F.col("count").cast("double") * F.col("count"))).first()[0] or 0.0
        m = len(bits) + 1
        costs.append({0: n + same, **{t: n * m + same * m * m for t in range(1, distance + 1)}})
    keyed = []
    for i, (bits, t) in enumerate(zip(groups, allocate(costs, distance))):
        if t < 0:
            continue
        flips = [0] + ([1 << b for b in bits] if t else [])
        key = F.explode(F.array(*[part_value(bits).bitwiseXOR(F.lit(_signed(f))) for f in flips])) if t else part_value(bits)
        keyed.append(fps.select(F.lit(i).alias("part"), key.alias("key"), "fp"))
    rows = keyed[0]
    for k in keyed[1:]:
        rows = rows.union(k)
    counts = rows.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = staged(rows.join(counts, ["part", "key"]))

    def inside(batches):
        for pdf in batches:
            out = []
            for members in pdf["fps"]:
                x = np.unique(np.asarray(members, np.int64)).view(np.uint64)
                near = np.bitwise_count(x[:, None] ^ x[None, :]) <= distance
                seen = np.zeros(len(x), bool)
                for start in range(len(x)):
                    if seen[start]:
                        continue
                    seen[start] = True
                    todo = [start]
                    while todo:
                        u = todo.pop()
                        for v in np.flatnonzero(near[u] & ~seen):
                            seen[v] = True
                            todo.append(v)
                            out.append((int(x[u].astype(np.int64)), int(x[v].astype(np.int64))))
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    small = rows.where(F.col("n") <= bucket).groupBy("part", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInPandas(inside, "a long, b long")
    balls = rows.where(F.col("n") > bucket).select("fp").distinct().select("fp", F.explode(F.array(*[
        F.col("fp").bitwiseXOR(F.lit(_signed(f))) for f in [0, *[1 << b for b in range(64)]]])).alias("c"))
    hubs = balls.groupBy("c").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    if distance == 2:
        large = hubs.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    else:  # within 1 bit: the neighbour itself must be one of them
        large = hubs.where(F.array_contains("fps", F.col("c"))).select(F.col("c").alias("a"), F.explode("fps").alias("b"))
    return small.union(large.where("a <> b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links of at most `distance` bits).

    Copies share a fingerprint and are one node, however many; only distinct fingerprints are
    searched. Nulls: a null text is empty (fingerprint zero, linked like any other); null
    doc_ids get a row each and never name a component unless it has nothing else (then null).
    Repeated rows keep a row each. Empty tables give none. Extra columns are not read.
    """
    d = staged(fingerprints(docs, shingle))
    fps = staged(d.groupBy("fp").agg(F.min("doc_id").alias("low")))
    labels = components(links(fps, distance)).select(F.col("node").alias("fp"), "label")
    named = fps.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    lows = named.groupBy("label").agg(F.min("low").alias("component_id"))
    return d.join(staged(named.join(lows, "label").select("fp", "component_id")), "fp").select("doc_id", "fp", "component_id")


def minima(hashes: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Smallest value of the hashes under each odd multiplier, mod 2^64 (all ones for no hashes)."""
    low = np.full(len(scales), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        np.minimum(low, (hashes[at : at + 1024, None] * scales).min(axis=0), out=low)
    return low


def signatures(docs: DataFrame, shingle: int = WIDE) -> DataFrame:
    """doc_id, fp (SimHash), k and k2 (equal for equal shingle sets), n (different shingles) and bands; no null doc_ids."""
    scales = np.random.default_rng(7).integers(0, 1 << 63, BAND * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("k", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for b in slices(batches):
            rows = []
            for i, t in zip(b.column("doc_id").to_pylist(), as_bytes(b, "text")):
                every = shingle_hashes(t, shingle)
                one = np.unique(every)
                low = minima(one, scales)
                bands = [_signed(xxhash.xxh64_intdigest(x.tobytes())) for x in low.reshape(BANDS, BAND)]
                whole = xxhash.xxh3_128_digest(one.tobytes())
                k, k2 = np.frombuffer(whole, np.int64).tolist()
                rows.append((i, _signed(bit_majority(every)), k, k2, len(one), bands))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, schema)], schema=schema)

    d = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, fp long, k long, k2 long, n long, bands array<long>")


def sketches(docs: DataFrame, wanted: DataFrame, shingle: int = WIDE) -> DataFrame:
    """For wanted (node, k): node, k, n and sketch, its shingles counted by residue class. Only these texts are walked again."""

    def run(batches):
        for b in slices(batches):
            rows = []
            for i, t in zip(b.column("node").to_pylist(), as_bytes(b, "t")):
                one = np.unique(shingle_hashes(t, shingle))
                k = int(np.frombuffer(xxhash.xxh3_128_digest(one.tobytes()), np.int64)[0])
                rows.append((i, k, len(one), np.bincount(one & np.uint64(CLASSES - 1), minlength=CLASSES).astype(np.int32).tobytes()))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["node", "k", "n", "sketch"])

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("t"))
    texts = marked(texts, "node", wanted.select("node")).where(f"{OWN}maybe").join(wanted.select("node").distinct(), "node", "left_semi").select("node", "t")
    found = texts.mapInArrow(run, "node long, k long, n long, sketch binary").groupBy("node", "k").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    return found.join(wanted.select("node", "k").distinct(), ["node", "k"], "left_semi")


def verified(edges: DataFrame, docs: DataFrame, similarity: float = SIMILAR, shingle: int = WIDE) -> DataFrame:
    """a, b, ok: whether the texts of doc_ids a and b share so much of their shingle sets (Jaccard), counted exactly.

    Edges of a group have one end, a, in common, as a rule: its shingles are made once for all of them.
    """

    def run(batches):
        last, held = None, None
        for b in slices(batches, 64):
            ok = []
            for ta, tb in zip(as_bytes(b, "ta"), as_bytes(b, "tb")):
                if ta != last:
                    last, held = ta, np.unique(shingle_hashes(ta, shingle))
                other = np.unique(shingle_hashes(tb, shingle))
                both = len(np.intersect1d(held, other, assume_unique=True))
                ok.append(both >= similarity * (len(held) + len(other) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    # texts stand once an id and different text, however often the row is repeated, and go once to each edge's end b and once to each a
    need = staged(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("t"))
    texts = marked(texts, "id", need).where(f"{OWN}maybe").select("id", "t")
    texts = staged(texts.join(need, "id", "left_semi").withColumn("h", F.xxhash64("t")).dropDuplicates(["id", "h"]))
    pairs = edges.join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a")
    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, ok boolean").groupBy("a", "b").agg(F.max("ok").alias("ok"))


def open_buckets(left: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (key, node) of the buckets whose members are not all in one component; once joined, a bucket stays closed."""
    rows = left.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = rows.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h")
    return left.join(mixed.select("key"), "key", "left_semi")


def cells(left: DataFrame, labels: DataFrame, block: int = BLOCK) -> DataFrame:
    """key, i, j, own, node, label: the members of open buckets, dealt so that each two of a bucket with different labels meet in one cell (key, i, j).

    Members of a bucket's most frequent label need no comparison with each other: they are dealt to strips (own -1), the
    others to tiles (own is the tile). A tile meets each strip (i, j >= 0), itself in the first of them, and each other
    tile (j < 0). Of m members s have other labels; strips and tiles are as long as s, so up to s = SIDE a bucket makes 2 m rows
    at most. Beyond that their length grows with the root of s, and rows a member with the other root of it.
    """
    rows = left.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    sizes = rows.groupBy("key", "label").agg(F.count("*").alias("c"))
    sizes = sizes.groupBy("key").agg(F.sum("c").alias("m"), F.max("c").alias("c"), F.max_by("label", F.struct("c", "label")).alias("top"))
    s = F.col("m") - F.col("c")
    sizes = sizes.withColumn("side", F.greatest(F.lit(block), F.least(s, F.ceil(F.sqrt(s * SIDE)))))
    sizes = sizes.select("key", "top", F.ceil(F.col("c") / F.col("side")).cast("int").alias("strips"), F.greatest(F.lit(1), F.ceil(s / F.col("side"))).cast("int").alias("tiles"))
    rows = rows.join(sizes, "key").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int")).withColumn("strip", F.pmod(F.xxhash64("node"), "strips").cast("int"))
    cell = lambda i, j: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"))
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    across = F.transform(up_to("tiles"), lambda t: cell(t, F.col("strip")))
    along = F.transform(up_to("strips"), lambda p: cell(F.col("tile"), p))
    others = F.filter(up_to("tiles"), lambda t: t != F.col("tile"))
    along = F.concat(along, F.transform(others, lambda t: cell(F.least(t, "tile"), -1 - F.greatest(t, "tile"))))
    rows = rows.withColumn("cell", F.explode(F.when(F.col("label") == F.col("top"), across).otherwise(along)))
    return rows.select("key", "cell.i", "cell.j", F.when(F.col("label") == F.col("top"), -1).otherwise(F.col("tile")).cast("long").alias("own"), "node", "label")


def unlinked(left: DataFrame, sketched: DataFrame, labels: DataFrame, decided: DataFrame, most: int, similarity: float, block: int) -> DataFrame:
    """Pairs (a, b) of nodes of one open bucket but different labels, not decided yet, that can be so similar; more: whether their cell has others.

    Two sets share at most the sum of the lesser of their counts by residue class, so no pair
    that is left out is similar. Buckets are compared in cells; in each, the `most` likeliest pairs of
    two labels are given.
    """
    missed = decided.where("NOT ok").select(F.explode(F.array(F.struct(F.col("a").alias("node"), "b"), F.struct(F.col("b").alias("node"), F.col("a").alias("b")))).alias("p"))
    missed = missed.groupBy("p.node").agg(F.collect_set("p.b").alias("missed"))
    rows = cells(left, labels, block).join(sketched.select("node", "n", "sketch"), "node").join(missed, "node", "left")

    def compare(x: pa.Table):
        node, n, label, own = (x.column(c).to_numpy() for c in ("node", "n", "label", "own"))
        inside = x.column("j")[0].as_py() == 0
        if len(node) < 2 or (label == label[0]).all():
            return []
        order = np.lexsort((label, own < 0))  # by label, the most frequent one last: it has no later one to meet
        counts = np.frombuffer(b"".join(x.column("sketch").to_pylist()), np.int32).reshape(-1, CLASSES)[order]
        not_again = x.column("missed").take(pa.array(order)).to_pylist()
        node, n, label, own = (c[order] for c in (node, n, label, own))
        cuts = [*np.flatnonzero(np.append(True, label[1:] != label[:-1])).tolist(), len(node)]
        out, more = [], False
        for start, end in zip(cuts, cuts[1:]):  # all pairs of two labels are found with the first of them, so no more are held at a time
            if own[start] < 0:
                break
            found = []
            for at in range(start, end):
                to = np.arange(end, len(node))
                to = to[(inside | (own[to] != own[at])) & (np.minimum(n[to], n[at]) >= similarity * np.maximum(n[to], n[at]))]
                both = np.minimum(counts[at], counts[to]).sum(axis=1, dtype=np.int64)
                fit = both >= similarity * (n[to] + n[at] - both)
                if not_again[at]:
                    fit &= ~np.isin(node[to], not_again[at])
                to, both = to[fit], both[fit]
                found.append((np.full(len(to), at), to, both / np.maximum(n[to] + n[at] - both, 1)))
            at, to, share = (np.concatenate(c) for c in zip(*found))
            if not len(at):
                continue
            low, high = np.minimum(node[at], node[to]), np.maximum(node[at], node[to])
            order = np.lexsort((high, low, -share, label[to]))
            other = label[to][order]
            first = np.flatnonzero(np.append(True, other[1:] != other[:-1]))
            given = order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < most]
            more |= len(given) < len(order)
            out.append((low[given], high[given]))
        return [(a, b, np.full(len(a), more)) for a, b in out]

    def batch_of(pairs):
        found = zip(*pairs) if pairs else [[np.zeros(0)]] * 3
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t)) for c, t in zip(found, (np.int64, np.int64, bool))], names=["a", "b", "more"])

    def run(batches):
        held: list = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in BUCKET_KEY], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            pairs = []
            for s, e in zip(cuts, cuts[1:]):
                if held and last != tuple(keys[s]):
                    pairs += compare(pa.Table.from_batches(held).combine_chunks())
                    held = []
                held.append(batch.slice(s, e - s))
                last = tuple(keys[s])
            yield batch_of(pairs)
        yield batch_of(compare(pa.Table.from_batches(held).combine_chunks()) if held else [])

    rows = rows.select(*BUCKET_KEY, "own", "node", "n", "label", "sketch", "missed")
    found = rows.repartition(*BUCKET_KEY).sortWithinPartitions(*BUCKET_KEY).mapInArrow(run, "a long, b long, more boolean")
    return found.groupBy("a", "b").agg(F.max("more").alias("more"))


def similar(docs: DataFrame, similarity: float = SIMILAR, shingle: int = WIDE, block: int = BLOCK) -> DataFrame:
    """node, component_id: a row for each different shingle set, node the smallest doc_id that has it.

    Candidates share a SimHash class (fingerprints linked within 2 bits by generalised
    pigeonhole) or a band of minima: at similarity 0.8 fingerprints of 64 bits differ in about
    10, which no partition of them can select. Each text is compared with one smallest member of
    its buckets first, which joins most of a group. Then all members of a bucket that
    are still in different components are compared by unlinked(), and what can be similar is counted
    on whole shingle sets, until no pair of a bucket is open. So the components are those of all
    similar pairs in buckets, and no bucket emits all its pairs.
    Nulls: a null text is empty, texts without words are alike; null doc_ids take no part.
    Two texts under one doc_id count as linked. Empty tables give none; extra columns are not read.
    """
    nodes = staged(signatures(docs, shingle).groupBy("k", "k2").agg(F.min("doc_id").alias("node"), F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    classes = components(links(staged(nodes.select("fp").distinct()))).select(F.col("node").alias("fp"), "label")
    # buckets are long tables: a row is a key and a node, whatever else is known of a text is joined to what is left of them
    left = nodes.select(F.explode("bands").alias("key"), "node")
    left = left.unionByName(nodes.join(classes, "fp", "left").select(F.xxhash64(F.lit("class"), F.coalesce("label", "fp")).alias("key"), "node"))
    ends = left.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("c")).where("c > 1").drop("c")
    left = staged(left.join(ends, "key"))
    # of the smallest members of its buckets, each text meets the one that it shares most buckets with: one edge a text
    hubs = left.where("node <> hub").groupBy(F.col("node").alias("b"), F.col("hub").alias("a")).agg(F.count("*").alias("shared"))
    sizes = nodes.select("node", "n")
    hubs = hubs.join(sizes.toDF("b", "nb"), "b").join(sizes.toDF("a", "na"), "a").where(F.least("na", "nb") >= similarity * F.greatest("na", "nb"))
    edges = hubs.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b")
    decided = staged(verified(staged(edges), docs, similarity, shingle))
    labels = staged(components(decided.where("ok").select("a", "b")))
    left = staged(open_buckets(left.select("key", "node").distinct(), labels))
    wanted = staged(nodes.select("node", "k").join(left.select("node").distinct(), "node", "left_semi"))  # its size is known then
    sketched = staged(sketches(docs, wanted, shingle))
    most = 1
    while True:
        edges = staged(unlinked(left, sketched, labels, decided, most, similarity, block))
        more = edges.agg(F.max("more")).first()[0]
        if more is None:
            break
        new = staged(verified(edges.select("a", "b"), docs, similarity, shingle))
        decided = decided.union(new)
        if not new.where("ok").isEmpty():
            labels = staged(components(decided.where("ok").select("a", "b")))
            left = staged(open_buckets(left, labels))
        if not more:  # every pair that can be similar was given
            break
        most *= 64
    return nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("component_id"))


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """One document of each group of similar(): the one with the smallest doc_id (all rows of a null id, same texts once).

    Only ids that occur twice or are not kept need a join and a comparison of rows; rows of all others stay where they are.
    """
    kept = staged(similar(docs, **how).where("node = component_id").select(F.col("node").alias(f"{OWN}id")).distinct())
    first = docs.withColumn(f"{OWN}d", F.col("doc_id").cast("long"))
    ids = first.where(F.col(f"{OWN}d").isNotNull()).groupBy(F.col(f"{OWN}d").alias("id")).agg(F.count("*").alias("n"))
    doubtful = staged(ids.join(kept, F.col("id") == F.col(f"{OWN}id"), "left").where(f"n > 1 OR {OWN}id IS NULL").select("id"))
    known = marked(first.where(F.col(f"{OWN}d").isNotNull()), f"{OWN}d", doubtful)
    rest = known.where(f"{OWN}maybe").join(kept, F.col(f"{OWN}d") == F.col(f"{OWN}id"), "left_semi").dropDuplicates([f"{OWN}d", "text"])
    out = known.where(f"NOT {OWN}maybe").select(*docs.columns).unionByName(rest.select(*docs.columns))
    return out.unionByName(first.where(F.col(f"{OWN}d").isNull()).dropDuplicates(["text"]).select(*docs.columns))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each of documents; nulls, empties and repeats as in near_duplicates()."""
    d = near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
