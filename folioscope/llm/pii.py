"""Personal data: base patterns, and terms that give away protected entities by what they keep company with."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, TEXT_KEY, as_bytes, as_text, join_small, slices, staged, table, text_key

KINDS = ("email", "ip", "card", "phone")
#: Words on each side of an entity that count as its company.
WINDOW = 8
#: A term must keep an entity's company in so many different contexts, and give away such a share of its information.
CONTEXTS, GENERALISE, REMOVE = 3, 0.85, 0.97
#: Bits of the word filter sent to all tasks (1 MB whatever the corpus).
FILTER_BITS = 1 << 23

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A digit run that starts a match starts it at the run's first digit, so the look-behind loses none and keeps it linear.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += _DOUBLED[int(c)] if i % 2 else int(c)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches; the part before @ is found backwards, so long runs cost no more than once."""
    out, end = [], 0
    for m in _AT.finditer(text):
        low = s = m.start()
        while s > end and text[s - 1] in _LOCAL:
            s -= 1
        if s < low:
            out.append((s, m.end()))
            end = m.end()
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in KINDS, then start; failing matches are dropped without another try."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if text.count(".") >= 3:
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def entity(kind: str, value: str) -> str:
    """What spellings of one entity have in common."""
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else _NOT_DIGIT.sub('', value)}"


def _hash(word: str) -> int:
    h = xxhash.xxh64_intdigest(word.encode(), 0)
    return h - (1 << 64) if h >> 63 else h


def company(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row a mention: entity, text key, context and terms, the different words around it; context is a hash of them in order."""

    def run(batches):
        for b in slices(batches):
            rows = []
            for k, k2, text in zip(b.column(TEXT_KEY[0]).to_pylist(), b.column(TEXT_KEY[1]).to_pylist(), as_text(b, "text")):
                spans = base_spans(text)
                if not spans:
                    continue
                words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
                starts = [w[0] for w in words]
                hit = set()
                for _, s, e in spans:
                    at = int(np.searchsorted(starts, s, "right")) - 1
                    while at < len(words) and words[max(at, 0)][0] < e:
                        hit.add(max(at, 0))
                        at += 1
                for kind, s, e in spans:
                    at = max(0, int(np.searchsorted(starts, s, "right")) - 1)
                    near = [i for i in range(max(0, at - window), min(len(words), at + window + 1)) if i not in hit]
                    terms = [text[words[i][0]:words[i][1]].lower() for i in near]
                    rows.append((entity(kind, text[s:e]), k, k2, _hash(" ".join(terms)), sorted(set(terms))))
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["entity", *TEXT_KEY, "context", "terms"])

    keyed = docs.select(F.col("text").cast("string").alias("text")).select("text", *text_key())
    return keyed.mapInArrow(run, f"entity string, {TEXT_KEY[0]} long, {TEXT_KEY[1]} int, context long, terms array<string>")


def word_filter(hashes: DataFrame) -> bytes:
    """A bitmap of FILTER_BITS over column h: built by Spark, of one size for any corpus."""
    at = F.pmod(F.col("h"), F.lit(FILTER_BITS)) + 1  # Spark numbers buckets and bits from value 1
    rows = hashes.groupBy(F.bitmap_bucket_number(at).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("b")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        b = np.frombuffer(r["b"], np.uint8)
        out[(r["n"] - 1) * 4096: (r["n"] - 1) * 4096 + len(b)] = b
    return out.tobytes()


def _passes(bits: bytes, h: int) -> bool:
    at = h % FILTER_BITS
    return bool(bits[at >> 3] >> (at & 7) & 1)


def occurrences(docs: DataFrame, bits: bytes, places: bool) -> DataFrame:
    """Texts (by key) and the words in them that pass the filter: term, and start and end if places, else a row a term."""

    def run(batches):
        seen: set[bytes] = set()
        held: dict[bytes, str] = {}  # words that pass, and their terms
        for b in slices(batches):
            rows = []
            for k, k2, text in zip(b.column(TEXT_KEY[0]).to_pylist(), b.column(TEXT_KEY[1]).to_pylist(), as_bytes(b, "text")):
                words = set(text.split())
                if len(seen) > 250_000:
                    seen.clear()
                    held.clear()
                for w in words.difference(seen):
                    low = w.decode().lower()
                    if _passes(bits, _hash(low)):
                        held[w] = low
                seen |= words
                found = words.intersection(held)
                if not found:
                    continue
                if not places:
                    rows += [(k, k2, t, 0, 0) for t in {held[w] for w in found}]
                    continue
                terms = {w.decode(): held[w] for w in found}
                rows += [(k, k2, terms[m[0]], m.start(), m.end()) for m in _WORD.finditer(text.decode()) if m[0] in terms]
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[*TEXT_KEY, "term", "s", "e"])

    keyed = docs.select(F.col("text").cast("string").alias("text")).select("text", *text_key())
    return keyed.mapInArrow(run, f"{TEXT_KEY[0]} long, {TEXT_KEY[1]} int, term string, s int, e int")


def revealing_terms(docs: DataFrame, window: int = WINDOW, contexts: int = CONTEXTS, threshold: float = GENERALISE) -> DataFrame:
    """term, share, entity: terms that give away an entity.

    One unit throughout, different texts: with n of them in all, n(e) naming entity e, n(t) holding term t and n(t, e) where t keeps
    e's company: PMI = log(n n(t,e) / (n(t) n(e))), information IC = log(n / n(e)), share = PMI / IC, at most 1. A term
    counts only if it keeps that company in `contexts` different contexts, so that a chance neighbour or a passage copied into
    several texts reveals nothing; an entity of fewer texts can't have such a term and is left out first.
    """
    near = staged(company(docs, window))
    n_e = near.select("entity", *TEXT_KEY).distinct().groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= contexts)
    near = join_small(near, staged(n_e), ["entity"], "inner")
    pairs = near.select("entity", "n_e", "context", *TEXT_KEY, F.explode("terms").alias("term"))
    both = pairs.groupBy("entity", "n_e", "term", *TEXT_KEY).agg(F.min("context").alias("context")).groupBy("entity", "n_e", "term").agg(F.count("*").alias("n_te"), F.countDistinct("context").alias("contexts"))
    pairs = staged(both.where(F.col("contexts") >= contexts).drop("contexts"))
    bits = word_filter(staged(pairs.select("term").distinct().mapInArrow(_hashes, "h long")))
    held = occurrences(docs, bits, False).distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    n = docs.select(F.col("text").cast("string").alias("text")).select(*text_key()).distinct().count()
    scored = pairs.join(held, "term")
    pmi = F.log(F.lit(float(n)) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    share = F.expr("CASE WHEN ic > 0 THEN least(1D, pmi / ic) ELSE 0D END")
    scored = scored.withColumn("pmi", pmi).withColumn("ic", F.log(F.lit(float(n)) / F.col("n_e"))).withColumn("share", share)
    return scored.groupBy("term").agg(F.max("share").alias("share"), F.max_by("entity", F.struct("share", "entity")).alias("entity")).where(F.col("share") >= threshold)


def _hashes(batches):
    for b in slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array([_hash(t) for t in b.column("term").to_pylist()], pa.int64())], names=["h"])


def term_spans(docs: DataFrame, terms: DataFrame, remove: float = REMOVE) -> DataFrame:
    """Per distinct text with any: __fs_added, an array of (kind, start, end); kind term_removed or term_generalised."""
    bits = word_filter(staged(terms.select("term").mapInArrow(_hashes, "h long")))
    kind = F.when(F.col("share") >= remove, "term_removed").otherwise("term_generalised")
    found = join_small(occurrences(docs, bits, True).distinct(), terms.select("term", kind.alias("kind")), ["term"], "inner")
    return found.groupBy(*TEXT_KEY).agg(F.array_sort(F.collect_list(F.struct("kind", "s", "e"))).alias(f"{OWN}added"))


def shape(word: str) -> str:
    """What a generalised term is replaced by."""
    return "[NUMBER]" if any(c.isdigit() for c in word) else "[NAME]" if word[:1].isupper() else "[TERM]"


def sanitised(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with base spans and removed terms replaced by their kind, generalised ones by their shape."""
    out, end = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s < end:
            end = max(end, e)
            continue
        out.append(text[end:s])
        out.append("[REDACTED]" if kind == "term_removed" else shape(text[s:e]) if kind == "term_generalised" else f"[{kind.upper()}]")
        end = e
    return "".join([*out, text[end:]])


def find_personal_data(docs: DataFrame, texts: bool = False, **how) -> DataFrame:
    """doc_id, counts, base_sha256, spans; with texts also every column of docs, text being sanitised.

    Corpus statistics need two passes over the texts before this one; only a fixed-size filter and
    joins reach the tasks. Base spans stay; spans of revealing terms that overlap one are left out.

    Nulls: a null text is empty, a null doc_id stays null. Repeated rows keep a row each and get
    the same spans (they depend on the text). Empty tables give none. Very long texts are scanned
    whole in linear time. Extra columns are read only for texts=True.
    """
    terms = staged(revealing_terms(docs, **how))
    added = staged(term_spans(docs, terms))
    names = docs.columns if texts else ["doc_id", "text"]
    d = docs.select(*names) if texts else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = join_small(d.select("*", *text_key()), added, TEXT_KEY)
    d = d.select(*names, f"{OWN}added")

    def run(batches):
        for b in slices(batches):
            rows = []
            for text, more in zip(as_text(b, "text"), b.column(f"{OWN}added").to_pylist()):
                base = base_spans(text)
                taken = sorted((s, e) for _, s, e in base)
                starts = [s for s, _ in taken]
                extra = []
                for x in more or ():
                    at = int(np.searchsorted(starts, x["e"], "left"))
                    if not any(e > x["s"] for _, e in taken[max(0, at - len(KINDS) * 2):at]):
                        extra.append((x["kind"], x["s"], x["e"]))
                extra.sort(key=lambda x: (x[0], x[1]))
                text_of = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(text_of(base).encode()).hexdigest(), text_of(base + extra), sanitised(text, base + extra) if texts and (base or extra) else text if texts else None))
            cols = list(zip(*rows)) if rows else [[]] * 7
            more = [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()] * 2)]
            if texts:
                at = b.schema.get_field_index("text")
                keep = [pa.array(cols[6], pa.string()) if i == at else b.column(i) for i in range(len(names))]
            else:
                keep = [b.column(0)]
            yield pa.RecordBatch.from_arrays([*keep, *more], names=[*(names if texts else ["doc_id"]), *found])

    found = [f"n_{k}" for k in KINDS] + ["base_sha256", "spans"]
    own = [f"{OWN}{x}" for x in found] if texts else found
    found = own
    schema = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema) if texts else "doc_id long"
    return d.mapInArrow(run, schema + "".join(f", {n} long" for n in own[:4]) + "".join(f", {n} string" for n in own[4:]))


def op1_information_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents; nulls, empties and repeats as in find_personal_data()."""
    return find_personal_data(table(spark, sf_dir, "documents"))

