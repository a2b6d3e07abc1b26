"""Quality classifier: document evidence pooled with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, as_bytes, join_small, nullable_key, slices, staged, table

#: The document classifier is fitted on at most so many labelled rows, those of the smallest hashes.
LABELLED = 20_000
#: A document is kept if its pooled probability of being good is so much.
KEEP = 0.5
#: Bounds on how many documents a global or host prior is worth.
PRIOR = (2.0, 1e6)
SYMBOLS = b"#*$%&|<>!"
FEATURES = ("log_words", "symbols", "pipes", "marked", "distinct", "runs", "word_len", "upper", "digits", "dup_lines", "links", "boiler")
_BOILER = (b"all rights reserved", b"copyright", b"terms of use", b"cookie", b"license")


_MARKED = frozenset(s * 3 for s in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))


def features(text: bytes) -> list[float]:
    """Shape of a whole text, cheap to count."""
    words = text.split()
    n, size = len(words), max(1, len(text))
    if not n:
        return [0.0] * len(FEATURES)
    kinds = set(words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    low = text.lower()
    marks = sum(text.count(SYMBOLS[i:i + 1]) for i in range(len(SYMBOLS)))
    tail = sum(w[-3:] in _MARKED for w in words) / n
    return [
        np.log1p(n), marks / size, text.count(b"|") / n, tail, len(kinds) / n, same / n,
        sum(map(len, words)) / n / 10, 1 - sum(map(bytes.__eq__, words, low.split())) / n, sum(text.count(b"%d" % i) for i in range(10)) / size,
        1 - len(set(lines)) / max(1, len(lines)), (low.count(b"http") + low.count(b"www.")) / n, float(sum(low.count(x) for x in _BOILER)) / np.sqrt(n)]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps on standardised features and their squares: (mean, scale, weights)."""
    z = np.hstack([x, x * x])
    mean, scale = z.mean(axis=0), z.std(axis=0) + 1e-6
    z = np.hstack([(z - mean) / scale, np.ones((len(z), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) / len(y) + ridge * w
        h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + (ridge + 1e-6) * np.eye(z.shape[1])
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / (1e-12 + np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def logits(x: np.ndarray, model: tuple) -> np.ndarray:
    mean, scale, w = model
    z = np.hstack([x, x * x])
    return np.clip(np.hstack([(z - mean) / scale, np.ones((len(z), 1))]) @ w, -12, 12)


def evidence(docs: DataFrame, model: tuple) -> DataFrame:
    """docs' columns and the document classifier's log odds, __fs_z."""
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches):
        for b in slices(batches):
            x = np.array([features(t) for t in as_bytes(b, "text")], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(logits(x, model))], names=[*names, f"{OWN}z"])

    return docs.mapInArrow(run, f"{schema}, {OWN}z double")


def train(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> tuple | None:
    """The document classifier from at most `limit` labelled documents; None without both classes."""
    y = labels.select(F.col("doc_id").cast("long").alias(f"{OWN}id"), F.col("quality").alias("y")).where("y IS NOT NULL")
    y = y.groupBy(f"{OWN}id").agg(F.min("y").alias("y")).orderBy(F.xxhash64(f"{OWN}id"), f"{OWN}id").limit(limit)
    d = docs.select(F.col("doc_id").cast("long").alias(f"{OWN}id"), F.col("text").cast("string").alias("text"))

    def shapes(batches):
        for b in slices(batches):
            x = [features(t) for t in as_bytes(b, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(b.column("y").to_pylist(), pa.float64())], names=["x", "y"])

    # at most `limit` ids, so this side is bounded
    rows = d.join(F.broadcast(y), f"{OWN}id").select("text", F.col("y").cast("double").alias("y")).mapInArrow(shapes, "x array<double>, y double")
    # repeated ids could exceed the bound; their rows beyond it are not needed to fit
    pdf = rows.limit(2 * limit).toPandas()
    if pdf["y"].nunique() < 2:
        return None
    return fit(np.stack(pdf["x"].to_numpy()), (pdf["y"].to_numpy() > 0).astype(float))


def _prior(df: DataFrame, keys: list[str], mean: str, name: str) -> DataFrame:
    """Worth (in documents) of the prior for groups of `keys` around `mean`, by the method of moments over the groups.

    Var(rate) = m (1 - m) (1 / (s + 1) + E[1 / n]) gives s; sparse groups are pulled by s documents to the mean.
    """
    m = F.col(mean)
    spread = F.avg((F.col("good") / F.col("n") - m) ** 2) / F.greatest(F.avg(m * (1 - m)), F.lit(1e-6)) - F.avg(1 / F.col("n"))
    agg = df.groupBy(*keys) if keys else df.groupBy()
    worth = F.when(spread <= 1e-6, PRIOR[1]).otherwise(F.greatest(F.lit(PRIOR[0]), F.least(F.lit(PRIOR[1]), 1 / spread - 1)))
    return agg.agg(worth.alias(name))


def posteriors(scored: DataFrame) -> DataFrame:
    """Per (host, path): host_rate and path_rate, each group's share of good documents shrunk towards the level above."""
    soft = 1 / (1 + F.exp(-F.col(f"{OWN}z")))
    paths = scored.groupBy(f"{OWN}h", f"{OWN}p").agg(F.count("*").cast("double").alias("n"), F.sum(soft).alias("good"))
    paths = staged(paths)
    hosts = paths.groupBy(f"{OWN}h").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    rate = hosts.agg((F.sum("good") / F.sum("n")).alias("rate"))
    hosts = hosts.join(F.broadcast(rate))  # one row
    hosts = hosts.join(F.broadcast(_prior(hosts, [], "rate", "worth")))
    hosts = staged(hosts.select(f"{OWN}h", "rate", ((F.col("good") + F.col("worth") * F.col("rate")) / (F.col("n") + F.col("worth"))).alias("host_rate")))
    both = paths.join(hosts, f"{OWN}h")
    both = both.join(F.broadcast(_prior(both, [], "host_rate", "worth")))
    return staged(both.select(f"{OWN}h", f"{OWN}p", "rate", "host_rate", ((F.col("good") + F.col("worth") * F.col("host_rate")) / (F.col("n") + F.col("worth"))).alias("path_rate")))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", keep: float = KEEP, limit: int = LABELLED, texts: bool = True) -> DataFrame:
    """docs' columns with __fs_doc, __fs_host, __fs_path, __fs_good (probabilities) and __fs_kept.

    The classifier gives log odds z of a document from the shape of its whole text. Sums of its
    probabilities by host and by path within host, over all documents, are beta-binomial
    evidence: a host is shrunk to the global rate, a path to its host, each by a prior fitted to
    the spread between groups. Pooled log odds: z - logit(global) + logit(path rate).

    Nulls: null text is empty (its features are zero), null hosts and paths are groups of their
    own, null doc_ids are kept as rows. Repeated rows keep a row each. Empty tables give none;
    without labels of both classes everything is kept. Extra columns pass through. A hot host
    is summed before the shuffle and its rate, one row, is broadcast after its count is checked.
    A document at the threshold is kept. texts=False leaves the text out of the result, and texts are then walked once only.
    """
    model = train(docs, labels, limit)
    names = [c for c in docs.columns if texts or c != "text"]
    if model is None:
        one = F.lit(1.0)
        return docs.select(*names, one.alias(f"{OWN}doc"), one.alias(f"{OWN}host"), one.alias(f"{OWN}path"), one.alias(f"{OWN}good"), F.lit(True).alias(f"{OWN}kept"))
    keyed = docs.withColumn(f"{OWN}h", nullable_key(host)).withColumn(f"{OWN}p", nullable_key(path))
    keyed = keyed.withColumn("text", F.col("text").cast("string"))
    full = evidence(keyed, model) if texts else staged(evidence(keyed, model).drop("text"))
    rates = posteriors(evidence(keyed.select(f"{OWN}h", f"{OWN}p", "text"), model).drop("text") if texts else full)
    full = join_small(full, rates, [f"{OWN}h", f"{OWN}p"])
    logit = lambda c: F.log(F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col(c)))) - F.log1p(-F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col(c))))
    good = 1 / (1 + F.exp(-(F.col(f"{OWN}z") - logit("rate") + logit("path_rate"))))
    full = full.withColumn(f"{OWN}good", good)
    return full.select(*names, (1 / (1 + F.exp(-F.col(f"{OWN}z")))).alias(f"{OWN}doc"), F.col("host_rate").alias(f"{OWN}host"), F.col("path_rate").alias(f"{OWN}path"),
                       f"{OWN}good", (F.col(f"{OWN}good") >= keep).alias(f"{OWN}kept"))


def op3_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document with its own, its host's and its path's probability of being good; nulls, ties and repeats as in classify()."""
    d = classify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), table(spark, sf_dir, "labels"), texts=False)
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"{OWN}doc").alias("doc_good"), F.col(f"{OWN}host").alias("host_good"),
                    F.col(f"{OWN}path").alias("path_good"), F.col(f"{OWN}good").alias("good"), F.col(f"{OWN}kept").alias("kept"))

