"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import OWN, held, join_small, nullable_key, staged, table

#: Shares given to the sources in order of name, repeating.
WEIGHTS = (3, 1, 2)
#: Budget as a multiple of all words, and the most copies that a source may get.
TOTAL, MOST = 1.5, 2
#: A rank is a long below 2**54; the threshold search reads 12 bits of it at a time.
RANK_BITS, STEP, LEVELS = 54, 12, 3
#: White space as a character class, and as characters.
_SPACE, _SPACES = "\\x20\\x09-\\x0D", " \t\n\x0b\f\r"


def n_words(text: Column) -> Column:
    """Words of a text, null: 0. One character is left of each word and the space after it, so no list of words is held."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{_SPACE}]+[{_SPACE}]*+", "w")
    return F.length(F.ltrim(marks, F.lit(_SPACES))).cast("long")


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: words of each whole text (null: 0)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"))


def _level(over: list[str], amount: Column, cap: Column, weight: Column, tie: str) -> Column:
    """The height of water poured into the rows of a group: what a unit of weight gets, when no row holds more than its cap.

    The group's is the least of the structs given.

    Resharing the excess by weight until none is above its cap comes to this: with the rows in order of
    cap / weight, those below the level are full, and the first that is not gives the level. Null where all rows are full.
    """
    ratio = cap / weight
    order = Window.partitionBy(*over).orderBy(ratio, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(*over)
    level = F.try_divide(F.greatest(F.lit(0.0), amount - F.sum(cap).over(order) + cap), F.sum(weight).over(every) - F.sum(weight).over(order) + weight)
    return F.when(level < ratio, F.struct(ratio.alias("ratio"), F.col(tie).alias("tie"), level.alias("level")))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """Target words of each source: weights share total x all words; none exceeds most x its own words.

    One row a source goes through one window, already summed: the contract ranks all sources by name.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("g", F.lit(0))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(most)).withColumn("all", F.sum("source_size").over(Window.partitionBy("g")) * float(total))
    s = s.withColumn("level", _level(["g"], F.col("all"), F.col("cap"), F.col("w"), "i")).withColumn("level", F.min("level").over(Window.partitionBy("g"))["level"])
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def length_class(size: Column) -> Column:
    """Binary digits of a document's words, 0 for none: documents of a class are as likely to be taken as each other."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(F.lit(0)).cast("int")


def _rank(doc_id: Column, inclusion: Column, seed: int) -> Column:
    """Pareto order: odds of a uniform number made of doc_id over the odds of inclusion, as a long that orders like it."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(doc_id, F.lit(-1))), 11) + 0.5) / float(1 << 53)
    odds = F.ln(u / (1 - u)) - F.ln(inclusion / (1 - inclusion))
    return F.least(F.lit((1 << RANK_BITS) - 1), F.greatest(F.lit(0), F.floor((odds + 100) * float(1 << 46)))).cast("long")


def shares(sizes: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """A row a source and length class: __fs_s, __fs_c, source_size, target, copies (whole, certain), inclusion (of one more) and rest.

    Expected copies of a document grow with its length class, up to `most`: a = min(most, level x class), with the level
    such that the source's words come to its target. floor(a) copies are certain, the rest of a is the inclusion
    probability. rest is the source's words that the sampled copies come to.
    """
    t = source_targets(sizes, weights, total, most).withColumn(f"{OWN}s", nullable_key("source")).drop("source")
    c = sizes.groupBy(nullable_key("source").alias(f"{OWN}s"), length_class(F.col("size")).alias(f"{OWN}c")).agg(F.sum("size").cast("double").alias("words"))
    c = held(join_small(c, held(t), [f"{OWN}s"]))
    own = Window.partitionBy(f"{OWN}s")
    weight = F.col("words") * F.col(f"{OWN}c")
    live = c.where("words > 0").withColumn("level", _level([f"{OWN}s"], F.col("target"), F.col("words") * float(most), weight, f"{OWN}c"))
    live = live.withColumn("level", F.min("level").over(own)["level"])
    a = F.coalesce(F.least(F.lit(float(most)), F.col("level") * F.col(f"{OWN}c")), F.lit(float(most)))
    live = live.withColumn("copies", F.floor(a + 1e-9)).withColumn("inclusion", F.greatest(F.lit(0.0), a - F.col("copies")))
    live = live.withColumn("inclusion", F.when(F.col("inclusion") > 1e-9, F.col("inclusion")).otherwise(F.lit(0.0)))
    rest = F.floor(F.col("target") - F.sum(F.col("copies") * F.col("words")).over(own) + 1e-6)
    live = live.withColumn("rest", F.when(F.col("inclusion") > 0, F.greatest(F.lit(0), rest)).otherwise(F.lit(0)).cast("long"))
    empty = c.where("words <= 0").withColumns({"copies": F.lit(0), "inclusion": F.lit(0.0), "rest": F.lit(0)})
    names = [f"{OWN}s", f"{OWN}c", "source_size", "target", F.col("copies").cast("long").alias("copies"), "inclusion", F.col("rest").cast("long").alias("rest")]
    return held(live.select(*names).union(empty.select(*names)))


def thresholds(sizes: DataFrame, classes: DataFrame, seed: int) -> DataFrame:
    """A row a source whose sample is cut: __fs_s, bin (of ranks), left (words to take from the bin) and bin_words.

    Three rounds of sums over 4,096 bins find the bin where the words of a source's documents in Pareto
    order reach its rest, so no source, however large, is ordered in one task.
    """
    d = sizes.select("doc_id", "size", nullable_key("source").alias(f"{OWN}s"), length_class(F.col("size")).alias(f"{OWN}c"))
    d = join_small(d.where("size > 0"), classes.where("inclusion > 0").select(f"{OWN}s", f"{OWN}c", "inclusion", "rest"), [f"{OWN}s", f"{OWN}c"], "inner")
    d = d.withColumn("rank", _rank(F.col("doc_id"), F.col("inclusion"), seed))
    at = None
    for level in range(LEVELS):
        shift = RANK_BITS - STEP * (level + 1)
        live = d.withColumn("left", F.col("rest")) if at is None else join_small(d, at, [f"{OWN}s"], "inner").where(F.shiftright("rank", shift + STEP) == F.col("bin")).drop("bin")
        bins = live.groupBy(f"{OWN}s", F.shiftright("rank", shift).alias("bin")).agg(F.sum("size").alias("words"), F.max("left").alias("left"))
        upto = F.sum("words").over(Window.partitionBy(f"{OWN}s").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        at = bins.withColumn("upto", upto).where("upto >= left AND upto - words < left")
        at = held(at.select(f"{OWN}s", "bin", (F.col("left") - F.col("upto") + F.col("words")).alias("left"), *[F.col("words").alias("bin_words")] * (level == LEVELS - 1)))
    return at


def with_taken(docs: DataFrame, doc_id: Column, source: str, size: Column, classes: DataFrame, at: DataFrame, seed: int) -> DataFrame:
    """docs with __fs_taken, source_size and target. Both small tables are broadcast after their rows are counted; docs isn't shuffled then."""
    d = docs.withColumns({f"{OWN}s": nullable_key(source), f"{OWN}c": length_class(size)})
    d = join_small(d, classes.select(f"{OWN}s", f"{OWN}c", *[F.col(c).alias(f"{OWN}{c}") for c in ("source_size", "target", "copies", "inclusion", "rest")]), [f"{OWN}s", f"{OWN}c"])
    d = join_small(d, at.select(f"{OWN}s", *[F.col(c).alias(f"{OWN}{c}") for c in ("bin", "left", "bin_words")]), [f"{OWN}s"])
    own = F.shiftright(_rank(doc_id, F.col(f"{OWN}inclusion"), seed), RANK_BITS - STEP * LEVELS)
    cut = F.floor(size.cast("decimal(38,0)") * F.col(f"{OWN}left") / F.col(f"{OWN}bin_words")).cast("long")
    part = F.when((F.col(f"{OWN}rest") <= 0) | (F.col(f"{OWN}inclusion") <= 0) | (size <= 0), F.lit(0)).when(F.col(f"{OWN}bin").isNull() | (own < F.col(f"{OWN}bin")), size).when(own > F.col(f"{OWN}bin"), F.lit(0)).otherwise(cut)
    return d.withColumn(f"{OWN}taken", (F.col(f"{OWN}copies") * size + part).cast("long"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes of each document.

    A source's target is divided by shares(): documents of more words are expected in more copies. Certain whole
    copies come first. The rest goes by Pareto order sampling at unequal probabilities: rank = odds(u) /
    odds(inclusion) with u a hash of doc_id, smallest first up to the words that are left (thresholds()).
    Documents that share the threshold's last bin (one, as a rule; all rows of a repeated id) share what is left.

    Nulls: a null text has size 0, a null source is a source of its own, last in order, a null
    doc_id hashes like a value. Empty texts take 0. Repeated rows count each and get equal parts.
    Empty tables give none. Extra columns are not read. Reruns agree: nothing depends on row order.
    """
    d = staged(word_sizes(docs), dealt=True)
    classes = shares(d, weights, total, most)
    out = with_taken(d, F.col("doc_id"), "source", F.col("size"), classes, thresholds(d, classes, seed), seed)
    return out.select("doc_id", "size", F.col(f"{OWN}source_size").alias("source_size"), F.col(f"{OWN}target").alias("target"), F.col(f"{OWN}taken").alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its nth word, as it stands: it is split where words end."""
    return F.array_join(F.slice(F.split(text, f"(?<=[^{_SPACE}])(?=[{_SPACE}])", -1), F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST, seed: int = 7) -> DataFrame:
    """documents as the mix takes them: a row for each copy; a copy taken in part is the text up to the last word taken.

    Texts are read where they stand: only sums by source and length class are shuffled. Null texts and texts without words
    are never taken. Nulls otherwise, repeated rows and empty tables as in mix(); extra columns pass through.
    """
    sizes = staged(word_sizes(docs), dealt=True)
    classes = shares(sizes, weights, total, most)
    at = thresholds(sizes, classes, seed)
    text = F.col("text").cast("string")
    d = with_taken(docs.withColumn(f"{OWN}n", n_words(text)), F.col("doc_id").cast("long"), "source", F.col(f"{OWN}n"), classes, at, seed).where(f"{OWN}taken > 0")
    d = d.withColumn(f"{OWN}copy", F.explode(F.expr(f"sequence(1L, CAST(ceil({OWN}taken / {OWN}n) AS BIGINT))")))
    d = d.withColumn(f"{OWN}words", F.expr(f"CASE WHEN {OWN}copy * {OWN}n > {OWN}taken THEN {OWN}taken - ({OWN}copy - 1) * {OWN}n END"))
    cut = F.when(F.col(f"{OWN}words").isNull(), F.col("text")).otherwise(first_words(text, F.col(f"{OWN}words")).cast(docs.schema["text"].dataType))
    return d.select(*[cut.alias(c) if c == "text" else c for c in docs.columns])


def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each of documents; nulls, empties and repeats as in mix()."""
    return mix(table(spark, sf_dir, "documents"))
