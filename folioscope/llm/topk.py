"""Exact top-k inner products by a dual-tree search over a shared cover tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

K, EVERY, SCALE = 5, 50, 256
#: The upper tree is grown over at most SAMPLE rows (all rows are indexed), down to at most CENTRES cells of about CELL rows.
SAMPLE, CENTRES, CELL = 4096, 256, 64
#: Most vectors of a cell in one block; queries that share a centre, about.
BLOCK, GROUP = 1024, 256
#: Vectors in a leaf of a block's own tree, about: of data, of queries.
LEAF, QUERY_LEAF = 32, 8
_EXACT = float(1 << 53)
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (floor(scale * x) as doubles), dim; vectors null or with null or non-finite components are left out."""

    def run(batches):
        for b in batches:
            ids, out = [], []
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding")):
                if not v.is_valid or i is None or v.values.null_count:
                    continue
                x = np.floor(float(scale) * np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64))
                if np.isfinite(x).all():
                    ids.append(i)
                    out.append(x)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.float64())), pa.array([len(x) for x in out], pa.int32())], names=["vec_id", "v", "dim"])

    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return d.mapInArrow(run, "vec_id long, v array<double>, dim int")


def cover_order(x: np.ndarray, m: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Farthest-first: up to m rows, each one's distance to those before it, and the distance of all rows from the first.

    All rows lie within the next distance of those picked, and those picked further apart than it: so the
    rows of distance over R / 2^i are level i of a cover tree (nested, covering, separated).
    """
    picked = [int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))]
    first = far = np.sqrt(((x - x[picked[0]]) ** 2).sum(axis=1))
    apart = [np.inf]
    while len(picked) < m:
        at = int(np.argmax(far))
        if not far[at] > 0:
            break
        picked.append(at)
        apart.append(far[at])
        far = np.minimum(far, np.sqrt(((x - x[at]) ** 2).sum(axis=1)))
    return picked, np.array(apart), first


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1)[None, :] - 2 * (x @ c.T), axis=1)


#: Columns of a tree's nodes: level, rows [start, end), row of the centre, covering radius, first child and how many (0: a leaf).
LEVEL, START, END, CENTRE, RADIUS, CHILD, CHILDREN = range(7)


def grow(x: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """A cover tree over rows x: an order of the rows in which every node is a range, and the nodes, level by level.

    Level i has a node for each picked row of distance over R / 2^i; a node's parent is the nearest of the level above,
    itself where it stands there too. Radii are those that really cover the node's rows.
    """
    n = len(x)
    with np.errstate(over="ignore", invalid="ignore"):
        picked, apart, first = cover_order(x, -(-n // leaf))
        top = float(first.max(initial=0.0))
        if len(picked) < 2 or not np.isfinite(top):
            return np.arange(n), np.array([[0, 0, n, picked[0], top if np.isfinite(top) else np.inf, 0, 0]], float)
        c = x[picked]
        level = np.zeros(len(picked), int)
        level[1:] = np.floor(np.log2(np.maximum(top / apart[1:], 1))).astype(int) + 1
        depth = int(level.max())
        at = [nearest(x, c)]
        for i in range(depth - 1, -1, -1):
            above = np.flatnonzero(level <= i)
            parent = np.where(level <= i, np.arange(len(picked)), above[nearest(c, c[above])])
            at.append(parent[at[-1]])
        at = at[::-1]
        order = np.lexsort(at[::-1])
        where = np.empty(n, int)
        where[order] = np.arange(n)
        x, nodes = x[order], []
        for i, own in enumerate(at):
            own = own[order]
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            far = np.sqrt(((x - c[own]) ** 2).sum(axis=1))
            rows = np.zeros((len(starts), 7))
            rows[:, LEVEL], rows[:, START], rows[:, END] = i, starts, np.append(starts[1:], n)
            rows[:, CENTRE], rows[:, RADIUS] = where[np.array(picked)[own[starts]]], np.maximum.reduceat(far, starts)
            nodes.append(rows)
        done = 0
        for upper, lower in zip(nodes, nodes[1:]):
            done += len(upper)
            at_ = np.searchsorted(lower[:, START], np.append(upper[:, START], n))
            upper[:, CHILD], upper[:, CHILDREN] = done + at_[:-1], np.diff(at_)
        return order, np.concatenate(nodes)


def centres(vectors: DataFrame, dim: int, n: int, sample: int = SAMPLE) -> np.ndarray:
    """The upper cover tree's picked rows in farthest-first order, from a bounded sample: every prefix is a level of it.

    Data cells hang under all of them, query groups under a prefix.
    """
    rows = vectors.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()["v"]
    x = np.unique(np.array([np.asarray(r) for r in rows]).reshape(len(rows), dim), axis=0)
    with np.errstate(over="ignore", invalid="ignore"):
        return x[cover_order(x, n)[0]]


def _packed(x: np.ndarray) -> bytes:
    """Vectors in single precision where that is exact."""
    return x.astype(np.float32).tobytes() if np.abs(x).max(initial=0.0) < 1 << 24 else x.tobytes()


def _unpacked(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.float32 if len(data) == 4 * n * dim else np.float64).reshape(n, dim).astype(np.float64)


def packed(vectors: DataFrame, cs: np.ndarray, leaf: int, block: int | None = None) -> DataFrame:
    """Blocks: node, c (its cell), n, ids and xs (binary, in the tree's order), tree (its own cover tree) and radius around the cell's centre.

    Rows are ordered by cell and distance from its centre over all partitions, so a hot cell is cut into shells by distance, each of
    at most `block` rows, and no cell has to fit into a task.
    """
    block = block or BLOCK

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy())
                with np.errstate(over="ignore", invalid="ignore"):
                    at = nearest(x, cs)
                    far = np.sqrt(((x - cs[at]) ** 2).sum(axis=1))
                yield pdf[["vec_id", "v"]].assign(c=at.astype(np.int32), far=far)

    def build(batches):
        held: list[pd.DataFrame] = []
        part, count = TaskContext.get().partitionId(), 0

        def out(pdf):
            nonlocal count
            pdf = pdf.sort_values("vec_id", kind="stable")
            x = np.stack(pdf["v"].to_numpy())
            order, nodes = grow(x, leaf)
            count += 1
            return {"node": f"{part}.{count}", "c": int(pdf["c"].iloc[0]), "n": len(x), "ids": pdf["vec_id"].to_numpy(np.int64)[order].tobytes(), "xs": _packed(x[order]), "tree": nodes.tobytes(), "radius": float(pdf["far"].max())}

        for pdf in batches:
            rows = []
            for _, own in pdf.groupby("c", sort=False):
                if held and held[0]["c"].iloc[0] != own["c"].iloc[0]:
                    rows.append(out(pd.concat(held)))
                    held = []
                held.append(own)
                while sum(map(len, held)) >= block:
                    whole = pd.concat(held)
                    rows.append(out(whole.iloc[:block]))
                    held = [whole.iloc[block:]] if len(whole) > block else []
            if rows:
                yield pd.DataFrame(rows)
        if held:
            yield pd.DataFrame([out(pd.concat(held))])

    d = staged(vectors.select("vec_id", "v").mapInPandas(assign, "vec_id long, v array<double>, c int, far double"))
    keys = ["c", "far", "vec_id"]
    return staged(d.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInPandas(build, "node string, c int, n long, ids binary, xs binary, tree binary, radius double"))


def products(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Integer inner products: through doubles while they are exact, else through Python's integers, held to a long."""
    if not q.size or not r.size:
        return np.zeros((len(q), len(r)), np.int64)
    if np.abs(q).max() * np.abs(r).max() * q.shape[1] < _EXACT:
        return (q @ r.T).astype(np.int64)
    a, b = ([[int(v) for v in row] for row in m] for m in (q, r))
    return np.array([[min(_HIGH, max(_LOW, sum(x * y for x, y in zip(u, v)))) for v in b] for u in a], np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """Positions of each row's k highest scores, ties to smaller ids (ids ascend)."""
    out = []
    for s in scores:
        if len(s) > 4 * k:
            edge = np.partition(s, len(s) - k)[len(s) - k]
            at = np.flatnonzero(s >= edge)
        else:
            at = np.arange(len(s))
        out.append(at[np.lexsort((ids[at], -s[at]))][:k])
    return out


def _widest(x: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms of the nodes' centres, and the largest norm of the rows of each node."""
    norm = np.sqrt((x * x).sum(axis=1))
    return norm[nodes[:, CENTRE].astype(int)], np.array([norm[int(s):int(e)].max() for s, e in nodes[:, [START, END]]])


def descend(qx: np.ndarray, q: np.ndarray, worst: np.ndarray, rx: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Leaf pairs (query nodes, data nodes) that may hold a score of at least the query's worst; node pairs met and pruned.

    Both trees are gone down together from their roots, whole fronts of pairs at a time. Each query subtree has a bound of its own:
    the least kth score of its queries. No score in a pair exceeds <cq, cr> + |cq| rr + |cr| rq + rq rr, nor half of the squared
    norms less the squared gap between the two balls.
    """
    (nq, wq), (nr, wr) = _widest(qx, q), _widest(rx, r)
    dots = qx[q[:, CENTRE].astype(int)] @ rx[r[:, CENTRE].astype(int)].T
    low = np.array([worst[int(s):int(e)].min() for s, e in q[:, [START, END]]])
    u, v = np.zeros(1, int), np.zeros(1, int)
    met = pruned = 0
    left, right = [], []
    while len(u):
        rq, rr, d = q[u, RADIUS], r[v, RADIUS], dots[u, v]
        with np.errstate(over="ignore", invalid="ignore"):
            ball = d + nq[u] * rr + nr[v] * rq + rq * rr
            gap = np.maximum(0, np.sqrt(np.maximum(0, nq[u] ** 2 + nr[v] ** 2 - 2 * d)) - rq - rr)
            bound = np.minimum(ball, (wq[u] ** 2 + wr[v] ** 2 - gap ** 2) / 2)
            bound += np.abs(bound) * 1e-6 + 1
        gone = bound < low[u]
        met, pruned = met + len(u), pruned + int(gone.sum())
        u, v, rq, rr = u[~gone], v[~gone], rq[~gone], rr[~gone]
        leaf_q, leaf_r = q[u, CHILDREN] == 0, r[v, CHILDREN] == 0
        both = leaf_q & leaf_r
        left.append(u[both])
        right.append(v[both])
        first = ~leaf_q & (leaf_r | (rq >= rr))
        fronts = []
        for which, of, nodes in ((first, u, q), (~both & ~first, v, r)):
            many = nodes[of[which], CHILDREN].astype(int)
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            fronts.append((np.repeat(u[which], many), np.repeat(v[which], many), np.repeat(nodes[of[which], CHILD].astype(int), many) + step))
        u = np.concatenate([fronts[0][2], fronts[1][0]])
        v = np.concatenate([fronts[0][1], fronts[1][2]])
    return np.concatenate(left), np.concatenate(right), met, pruned


FOUND = "q_node string, row int, query_id long, own long, vec_id long, score long, met long, pruned long"


def leaf_join(pairs: DataFrame, k: int, dim: int) -> DataFrame:
    """query node, row in it, candidates: up to k + 1 of each query in one data block (its own row may be among them), if they reach its worst kth score.

    And a row a pair of blocks, row -1, with the node pairs that were met and pruned in it.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for x in pdf.itertuples(index=False):
                qi, ri = np.frombuffer(x.q_ids, np.int64), np.frombuffer(x.ids, np.int64)
                qx, rx = _unpacked(x.q_xs, len(qi), dim), _unpacked(x.xs, len(ri), dim)
                q, r = (np.frombuffer(t, np.float64).reshape(-1, 7) for t in (x.q_tree, x.tree))
                worst = np.full(len(qi), -np.inf) if x.kth is None else np.frombuffer(x.kth, np.float64)
                left, right, met, pruned = descend(qx, q, worst, rx, r)
                for u in np.unique(left):
                    s, e = q[u, [START, END]].astype(int)
                    rows = np.sort(np.concatenate([np.arange(int(r[v, START]), int(r[v, END])) for v in right[left == u]]))
                    scores, ids = products(qx[s:e], rx[rows]), ri[rows]
                    for row, at in zip(range(s, e), best(scores, ids, k + 1)):
                        own = int(products(qx[row][None], qx[row][None])[0, 0])
                        out += [(x.q_node, row, int(qi[row]), own, int(ids[i]), int(scores[row - s, i]), 0, 0) for i in at if not scores[row - s, i] < worst[row]]
                out.append((x.q_node, -1, None, None, None, None, met, pruned))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")]).astype({c: "Int64" for c in ("query_id", "own", "vec_id", "score")})

    return pairs.select("q_node", "q_ids", "q_xs", "q_tree", "kth", "ids", "xs", "tree").mapInPandas(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all leaves, without its own row."""
    order = Window.partitionBy("q_node", "row").orderBy(F.desc("score"), "vec_id")
    top = found.where("row >= 0").drop("met", "pruned").withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    mine = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    first = F.min(F.when(mine, F.col("at"))).over(Window.partitionBy("q_node", "row"))
    top = top.withColumn("self", first).where(F.col("self").isNull() | (F.col("at") != F.col("self")))
    top = top.withColumn("rank", (F.col("at") - F.when(F.col("at") > F.col("self"), 1).otherwise(0)).cast("int"))
    return top.where(F.col("rank") <= k)


def search(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products over all other rows.

    Queries are the rows whose vec_id is divisible by `every`. Queries and data hang under one upper cover tree, grown over a bounded
    sample; all rows are routed to its cells, and each block of a cell grows a cover tree of its own down to small leaves. First the
    queries of each cell meet the nearest data block, which gives every query a kth score. Then pairs of blocks whose bound
    <cq, cr> + |cq| r + |cr| q + q r can't reach the worst of them are dropped by their few numbers only; in the others both trees
    are descended (descend()).

    Vectors null, with null or non-finite components or a null id take no part; those of another
    length are searched among their own. Repeated rows are rows: a repeated query is answered
    once for each, and only one row, its own, is left out. Ties go to the smaller vec_id. Fewer
    rows than k give fewer ranks, empty tables none. Scores beyond a long are held to its ends.
    """
    out = None
    d = staged(quantised(vectors, scale))
    for found, _ in _searches(d, k, every):
        top = ranked(found, k).select("query_id", "rank", "vec_id", "score")
        out = top if out is None else out.union(top)
    return out if out is not None else d.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where("false")


def pruning(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> dict[str, int]:
    """How much of the search was spared: blocks of data and of queries, pairs of blocks and those dropped unseen, node pairs met and pruned."""
    total = dict.fromkeys(("data_blocks", "query_blocks", "block_pairs", "block_pairs_pruned", "node_pairs", "node_pairs_pruned"), 0)
    for found, sizes in _searches(staged(quantised(vectors, scale)), k, every):
        seen, met, gone = found.where("row < 0").agg(F.count("*"), F.sum("met"), F.sum("pruned")).first()
        pairs = sizes[0] * sizes[1]
        for name, more in zip(total, (*sizes, pairs, pairs - seen, met, gone)):
            total[name] += more
    return total


def _searches(d: DataFrame, k: int, every: int):
    """For each length of vectors with queries: what the search has found, and how many blocks of data and of queries it has."""
    for dim in [r["dim"] for r in d.where(F.col("vec_id") % every == 0).select("dim").distinct().collect()]:
        if dim:
            yield _search(d.where(F.col("dim") == dim), dim, k, every)


def _search(d: DataFrame, dim: int, k: int, every: int) -> tuple[DataFrame, tuple[int, int]]:
    queries = d.where(F.col("vec_id") % every == 0)
    n, n_q = d.count(), queries.count()
    cs = centres(d, dim, max(1, min(CENTRES, n // CELL)))
    data = packed(d, cs, LEAF)
    norm = np.sqrt((cs * cs).sum(axis=1))
    gram = cs @ cs.T
    # a row for each two of at most CENTRES centres
    meta = F.broadcast(d.sparkSession.createDataFrame(
        [(i, j, float(gram[i, j]), float(norm[i]), float(norm[j])) for i in range(len(cs)) for j in range(len(cs))], "qc int, c int, dot double, nq double, nr double"))
    named = {"node": "q_node", "c": "qc", "n": "q_n", "ids": "q_ids", "xs": "q_xs", "tree": "q_tree", "radius": "q_radius"}

    def meet(pairs, blocks):
        p = pairs.select("q_node", "node", "kth").join(blocks, "q_node").join(data.select("node", "ids", "xs", "tree"), "node")
        return staged(leaf_join(p.repartition("q_node", "node"), k, dim))

    # 1. queries by data cell meet the nearest block that holds enough rows: a kth score for each query
    own = packed(queries, cs, QUERY_LEAF, GROUP).withColumnsRenamed(named)
    gap = F.col("nq") * F.col("nq") + F.col("nr") * F.col("nr") - 2 * F.col("dot")
    near = own.select("q_node", "qc").join(meta, "qc").join(data.select("node", "c", "n", "radius"), "c")
    near = near.groupBy("q_node").agg(F.min_by("node", F.struct(F.col("n") < 4 * k, gap, F.col("radius"), F.col("node"))).alias("node"))
    kth = ranked(meet(near.withColumn("kth", F.lit(None).cast("binary")), own), k).groupBy("q_node", "row", "query_id", "own").agg(F.count("*").alias("m"), F.min("score").alias("s"))
    # a repeated id may name different vectors: the lesser score holds for both
    kth = kth.groupBy("query_id", "own").agg(F.min(F.when(F.col("m") == k, F.col("s")).otherwise(F.lit(_LOW))).alias("s"))

    # 2. queries in larger groups, under an upper level of the tree, meet all blocks that can hold as much
    groups = packed(queries, cs[:max(1, min(len(cs), max(n_q // GROUP, min(4, n_q // QUERY_LEAF))))], QUERY_LEAF, GROUP).withColumnsRenamed(named)

    def rows(batches):
        for pdf in batches:
            for node, ids, xs in zip(pdf["q_node"], pdf["q_ids"], pdf["q_xs"]):
                i = np.frombuffer(ids, np.int64)
                yield pd.DataFrame({"q_node": node, "row": np.arange(len(i)), "query_id": i, "own": [int(products(v[None], v[None])[0, 0]) for v in _unpacked(xs, len(i), dim)]})

    def as_bounds(batches):
        for pdf in batches:
            low = [np.array([float(r["s"]) if r["s"] > _LOW else -np.inf for r in sorted(found, key=lambda r: r["row"])]) for found in pdf["found"]]
            yield pdf[["q_node"]].assign(kth=[x.tobytes() for x in low], worst=[float(x.min()) for x in low])

    bounds = groups.select("q_node", "q_ids", "q_xs").mapInPandas(rows, "q_node string, row int, query_id long, own long").join(kth, ["query_id", "own"])
    bounds = bounds.groupBy("q_node").agg(F.collect_list(F.struct("row", "s")).alias("found"))  # at most GROUP rows a block
    bounds = staged(bounds.mapInPandas(as_bounds, "q_node string, kth binary, worst double"))
    # pairs of blocks by their centres: numbers only
    bound = F.col("dot") + F.col("nq") * F.col("radius") + F.col("nr") * F.col("q_radius") + F.col("radius") * F.col("q_radius")
    pairs = groups.select("q_node", "qc", "q_radius").join(meta, "qc").join(data.select("node", "c", "radius"), "c").withColumn("bound", bound + F.abs(bound) * 1e-6 + 1)
    pairs = pairs.join(bounds, "q_node").where(~(F.col("bound") < F.col("worst")))
    return meet(pairs, groups), (data.count(), groups.count())


def op7_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all embeddings for each whose vec_id is divisible by 50; nulls, ties and repeats as in search()."""
    return search(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.v) = len(r.v)
  WHERE q.vec_id % 50 = 0
), t AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5
"""
