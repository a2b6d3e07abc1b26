"""Quality rules: fixed base rules, then robust multivariate outliers per language and source."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, as_bytes, held, join_small, nullable_key, slices, staged, table

LEAST_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Share of a group that the smallest-determinant subset holds, and its consistency factor for 4 dimensions:
#: share / P(chi2 with 6 degrees < the share's quantile with 4).
SHARE, FACTOR = 0.75, 1.485
STEPS = 4
#: Groups of fewer documents use their language's estimate, then that of all.
LEAST_GROUP = 100
#: Squared distance beyond which a document goes (4 degrees of freedom: 1e-6 of clean normal data).
CUT = 33.4
#: Smallest standard deviation that a statistic is given; many are constant in clean text.
FLOORS = (0.35, 0.08, 0.06, 0.06)
P = len(FLOORS)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(WINDOW)], np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words within 8-word windows that occur twice or more in the text, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    at = [ids.setdefault(w, len(ids)) for w in words]
    if len(ids) == len(words):
        return 0
    x = np.array(at, np.uint64) + np.uint64(1)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    h = x[:n] * _POWERS[0]
    for i in range(1, WINDOW):
        h = h + x[i:n + i] * _POWERS[i]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_statistics(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the number of lines with a word."""
    words = text.split()
    codes = np.frombuffer(text, np.uint8)
    chars = sum(map(len, words)) - int(np.count_nonzero((codes & 0xC0) == 0x80))
    lines = [x for x in text.split(b"\n") if x.strip()]  # bytes.strip() strips the same white space
    return len(words), chars, int(np.count_nonzero(_SYMBOL[codes])), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base statistics of each whole text, and n_lines."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

    def run(batches):
        for b in slices(batches):
            rows = [base_statistics(t) for t in as_bytes(b, "text")]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("source"), *[pa.array(c, pa.int64()) for c in cols]], names=["doc_id", "lang", "source", *names])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")])
    return d.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in names))


def transformed() -> list[Column]:
    """The vector judged: mean word length, root of symbols a word, shares of copied lines and of repeated words.

    Each ratio is drawn towards a usual value by a fixed number of words or lines, so that short texts are no outliers by chance.
    """
    n = F.col("n_words") + 50.0
    return [(F.col("word_chars") + 300.0) / n, F.sqrt(F.col("n_symbols") / n), F.col("n_dup_lines") / (F.col("n_lines") + 5.0), F.col("n_repeat_words") / n]


def _distance() -> Column:
    d = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(P)]
    out = F.lit(0.0)
    for i in range(P):
        for j in range(i, P):
            out = out + d[i] * d[j] * F.col(f"p{i}{j}") * (1 if i == j else 2)
    return out


def _inverted(batches):
    """Means and inverse scatter of each group from its sums."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            n = max(1.0, float(r.n))
            m = np.array([getattr(r, f"s{i}") for i in range(P)]) / n
            c = np.array([[getattr(r, f"c{min(i, j)}{max(i, j)}") for j in range(P)] for i in range(P)]) / n - np.outer(m, m)
            c = FACTOR * c + np.diag(np.array(FLOORS) ** 2)
            inv = np.linalg.inv(c)
            out.append((r.g, r.start, *m, *[inv[i, j] for i in range(P) for j in range(i, P)], float(np.linalg.slogdet(c)[1])))
        yield pd.DataFrame(out, columns=["g", "start", *_PARAMS[1:]])


_PARAMS = ["g", *[f"m{i}" for i in range(P)], *[f"p{i}{j}" for i in range(P) for j in range(i, P)], "logdet"]


def covariance_estimates(vectors: DataFrame, steps: int = STEPS, share: float = SHARE) -> DataFrame:
    """Per group g the centre and inverse scatter of its smallest-determinant subset (g, x0.. -> m.., p.., logdet).

    Three starts: medians with median deviations, medians with the floors alone, and the plain mean and covariance. From each,
    concentration steps: keep the `share` nearest of the group (its distance quantile, to 1 in 10,000 of the rows; ties at it stay in),
    take mean and covariance, measure again; a step lowers the determinant or leaves it. The start that ends with the smallest determinant gives the
    estimate. All are grouped sums; nothing but three rows a group is ever held.
    """
    xs = [f"x{i}" for i in range(P)]
    names = ["g", "start", *_PARAMS[1:]]

    def estimated(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy("g", "start").agg(F.count("*").cast("double").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)],
                                              *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"c{i}{j}") for i in range(P) for j in range(i, P)])
        return sums.mapInPandas(_inverted, "g string, start int, " + ", ".join(f"{c} double" for c in _PARAMS[1:]))

    med = held(vectors.groupBy("g").agg(*[F.percentile_approx(x, 0.5, 10_000).alias(f"m{i}") for i, x in enumerate(xs)]))
    dev = join_small(vectors, med, ["g"]).groupBy("g").agg(*[F.first(f"m{i}").alias(f"m{i}") for i in range(P)], *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 10_000).alias(f"d{i}") for i, x in enumerate(xs)])
    dev = held(dev)
    starts = estimated(vectors.withColumn("start", F.lit(2))).select(*names)
    for start, own in ((0, True), (1, False)):
        scale = [1 / ((F.pow(F.col(f"d{i}") * 1.4826, 2) if own else F.lit(0.0)) + f * f) for i, f in enumerate(FLOORS)]
        diagonal = [(scale[i] if i == j else F.lit(0.0)).alias(f"p{i}{j}") for i in range(P) for j in range(i, P)]
        starts = starts.union(dev.select("g", F.lit(start).alias("start"), *[f"m{i}" for i in range(P)], *diagonal, F.lit(0.0).alias("logdet")))
    params = held(starts)
    for _ in range(steps):
        far = join_small(vectors, params, ["g"], "inner").withColumn("far", _distance()).select("g", "start", "far", *xs)
        cut = held(far.groupBy("g", "start").agg(F.percentile_approx("far", share, 10_000).alias("cut")))
        params = held(estimated(join_small(far, cut, ["g", "start"]).where("far <= cut")))
    best = params.groupBy("g").agg(F.min_by(F.struct(*_PARAMS[1:]), F.struct("logdet", "start")).alias("p"))
    return held(best.select("g", "p.*"))


def judge(docs: DataFrame, cut: float = CUT, least_group: int = LEAST_GROUP, **how) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and distance (squared, null where base rules fail).

    kept is false if base_failed, else true unless the text's statistic vector is further than
    `cut` from its language and source's robust centre. Estimates are over all texts that pass
    the base rules. A language and source of fewer than `least_group` such texts is judged by the estimate of its whole
    language, and that, if it has fewer too, by the estimate of all texts.

    Nulls: a null text has no words and fails; null lang or source are groups of their own; null
    doc_ids keep their rows. Repeated rows count each. Empty tables give none. Extra columns are
    not read. Hot groups are summed before the shuffle and their one row of estimates is joined.
    """
    d = statistics(docs).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    d = d.select("*", *[x.alias(f"x{i}") for i, x in enumerate(transformed())])
    d = staged(d.withColumn(f"{OWN}l", nullable_key("lang")).withColumn("g", F.concat(f"{OWN}l", F.lit("\u0001"), nullable_key("source"))), dealt=True)
    n = held(d.where("NOT base_failed").groupBy("g", f"{OWN}l").agg(F.count("*").alias("n")))
    langs = n.groupBy(f"{OWN}l").agg(F.sum("n").alias("n_lang"))
    to = held(n.join(langs, f"{OWN}l").select("g", F.when(F.col("n") >= least_group, F.col("g")).when(F.col("n_lang") >= least_group, F.col(f"{OWN}l")).alias("to")))
    levels = [F.col("g"), F.col(f"{OWN}l"), F.lit("all")]
    xs = [f"x{i}" for i in range(P)]
    d = join_small(d, to, ["g"]).withColumn("to", F.coalesce("to", F.lit("all")))
    # a group's own estimate, its language's and that of all: a level is estimated where it is used, from all its rows
    ok = d.where("NOT base_failed")
    used = held(to.select(F.coalesce("to", F.lit("all")).alias("g")).distinct())
    rows = ok.select(F.explode(F.array(*levels)).alias("g"), *xs)
    params = covariance_estimates(staged(join_small(rows, used, ["g"], "left_semi")), **how)
    d = join_small(d.drop("g").withColumnRenamed("to", "g"), params, ["g"])
    d = d.withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut)).alias("kept"), "distance")


def op4_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and robust outliers of documents; nulls, empties and repeats as in judge()."""
    return judge(table(spark, sf_dir, "documents"))
