"""Exact substring duplicates by distributed prefix doubling over synchronised positions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, slices, staged, table
from .pii import FILTER_BITS, word_filter

#: Shortest repeated string, and the prefix that positions are ranked by first; both doubled lengths of one unit.
LENGTH, PREFIX = 200, 50
#: Windows handled at a time, so that a very long text needs no more memory.
SEGMENT = 1 << 19

_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POSITION = np.uint64(0xFFFFFFFF)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        out[done:2 * done] = out[:min(done, n - done)] * step
        done *= 2
    return out


_up = _down = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _up, _down
    if len(_up) < n:
        n = max(n, 1 << 16)
        _up, _down = _powers(_BASE, n), _powers(_INVERSE, n)
    return _up, _down


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Ranks:
    """Names of the substrings of a segment: equal strings have equal names, whatever stands around them."""

    def __init__(self, data: bytes):
        self.n = len(data)
        up, self.down = _tables(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_CODES[np.frombuffer(data, np.uint8)] * up[:self.n], out=self.sums[1:])

    def names(self, start, end) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (np.asarray(end) - start).astype(np.uint64))

    def every(self, length: int) -> np.ndarray:
        m = self.n - length + 1
        return mixed((self.sums[length:] - self.sums[:m]) * self.down[:m] + np.uint64(length))


def window_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbouring values: running minima of blocks from both sides."""
    m = len(x) - w + 1
    blocks = -(-len(x) // w)
    padded = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:len(x)] = x
    grid = padded.reshape(blocks, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:m], left[w - 1:w - 1 + m])


def segments(text: bytes, length: int = LENGTH) -> Iterator[tuple[int, bytes]]:
    for s in range(0, len(text) - length + 1, SEGMENT):
        yield s, text[s:s + SEGMENT + length - 1]


def anchors(data: bytes, length: int = LENGTH, prefix: int = PREFIX):
    """Runs of window starts that choose the same position: (ranks, first, last, anchor).

    A window of `length` bytes chooses the position in it whose `prefix`-byte name is smallest, the first
    of equals. Equal windows choose equal places, so repeats are found among chosen positions alone:
    one in about (length - prefix) / 2.
    """
    r = Ranks(data)
    key = (r.every(prefix) & ~_POSITION) | np.arange(r.n - prefix + 1, dtype=np.uint64)
    at = (window_minimum(key, length - prefix + 1) & _POSITION).astype(np.int64)
    cut = np.flatnonzero(at[1:] != at[:-1]) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut - 1, [len(at) - 1]])
    return r, first, last, at[first]


def doubled(r50: np.ndarray, prefix: int, length: int) -> np.ndarray:
    """Ranks of `length`-byte strings from those of their prefixes: pairs at offsets that double until past the length."""
    h, ranks = prefix, r50
    while h < length:
        step = min(h, length - h)
        ranks = mixed(ranks[:len(ranks) - step] * np.uint64(_BASE) + ranks[step:])
        h += step
    return ranks


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def _keyed(docs: DataFrame) -> DataFrame:
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("k"))


#: A place: length of the text (23 bits, tells texts of one hash apart), window start (32), windows after it (8).
def _place(n: int, start: np.ndarray, more: np.ndarray) -> np.ndarray:
    return (np.int64((n & 0x7FFFFF) << 40)) | (start.astype(np.int64) << 8) | more.astype(np.int64)


def ranked_positions(docs: DataFrame, length: int, prefix: int) -> DataFrame:
    """rank (of the prefix at the chosen position), around (of all that its windows cover), k, place."""

    def run(batches):
        for b in slices(batches):
            parts = []
            for k, text in zip(b.column("k").to_pylist(), as_bytes(b, "text")):
                for s, data in segments(text, length):
                    r, first, last, at = anchors(data, length, prefix)
                    around = r.names(first, last + length) ^ mixed((at - first).astype(np.uint64) + np.uint64(1))
                    parts.append((r.names(at, at + prefix), around, np.full(len(at), k, np.int64), _place(len(text), first + s, last - first)))
            if parts:
                yield pa.RecordBatch.from_arrays([_long(np.concatenate(c)) for c in zip(*parts)], names=["rank", "around", "k", "place"])

    return _keyed(docs).select("k", "text").mapInArrow(run, "rank long, around long, k long, place long")


def chosen(batches, bits: bytes, inside: bool):
    """Rows whose k is (or isn't) in a fixed-size filter: spares the others a shuffle."""
    table_ = np.frombuffer(bits, np.uint8)
    for b in batches:
        at = b.column("k").to_numpy() % FILTER_BITS
        yield b.filter(pa.array((table_[at >> 3] >> (at & 7) & 1).astype(bool) == inside))


def in_filter(docs: DataFrame, bits: bytes) -> DataFrame:
    """doc_id, text, k of the texts whose k is in the filter."""
    return _keyed(docs).mapInArrow(lambda batches: chosen(slices(batches), bits, True), "doc_id long, text string, k long")


def _text_id(text: str = "text") -> Column:
    return F.octet_length(text).bitwiseAND(0x7FFFFF).cast("long")


def contexts(docs: DataFrame, wanted: DataFrame, length: int, prefix: int) -> DataFrame:
    """For wanted (rank, k, place, edge): with the bytes that the place's windows cover, and where the prefix stands in them."""
    bits = word_filter(wanted.select(F.col("k").alias("h")))
    lists = wanted.groupBy("k", F.shiftright("place", 40).alias("n")).agg(F.collect_list(F.struct("rank", "place", "edge")).alias("wanted"))
    texts = in_filter(docs, bits).select("k", _text_id().alias("n"), "text").dropDuplicates(["k", "n"])

    def run(batches):
        for b in slices(batches, 64):
            for k, text, places in zip(b.column("k").to_pylist(), as_bytes(b, "text"), b.column("wanted").to_pylist()):
                out = []
                for w in places:
                    start, more = w["place"] >> 8 & 0xFFFFFFFF, w["place"] & 0xFF
                    out.append((w["rank"], k, w["place"], w["edge"], text[start:start + more + length]))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], names=["rank", "k", "place", "edge", "bytes"])

    return texts.join(lists, ["k", "n"]).select("k", "text", "wanted").mapInArrow(run, "rank long, k long, place long, edge boolean, bytes binary")


#: Groups of up to so many different contexts are compared at once; larger ones by Spark, window by window.
GROUP = 2048


def _windows(rows: list[tuple], length: int, prefix: int):
    """Ranks of every window of rows (rank, bytes): with the prefix's rank and its offset; and lengths of the rows."""
    names, sizes = [], []
    for rank, data in rows:
        r = Ranks(data)
        short = r.every(prefix)
        # the offset of the prefix in the windows: where its own rank stands
        at = int(np.flatnonzero(short == np.uint64(rank & 0xFFFFFFFFFFFFFFFF))[0])
        long_ = doubled(short, prefix, length)
        d = np.uint64(at + (1 << 20)) - np.arange(len(long_), dtype=np.uint64)
        names.append(mixed(long_ ^ mixed(d) ^ np.uint64(rank & 0xFFFFFFFFFFFFFFFF)))
        sizes.append(len(long_))
    return np.concatenate(names), np.array(sizes)


def repeated_windows(seen: DataFrame, length: int, prefix: int, group: int = GROUP) -> DataFrame:
    """k, n, start, end (of window starts) of the edge places' windows that also stand in another context."""
    counts = seen.groupBy("rank").agg(F.count("*").alias("members"))
    sized = staged(seen.join(counts, "rank"))
    kinds = (pa.int64(),) * 4
    names = ["k", "n", "start", "end"]

    def within(batches):
        for b in slices(batches, 1024):
            rows = [(rank, m) for rank, ms in zip(b.column("rank").to_pylist(), b.column("of").to_pylist()) for m in ms]
            out = []
            if rows:
                ranks, sizes = _windows([(rank, m["bytes"]) for rank, m in rows], length, prefix)
                order = np.argsort(ranks, kind="stable")
                same = ranks[order[1:]] == ranks[order[:-1]]
                twice = np.zeros(len(ranks) + 1, bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                ends = np.cumsum(sizes)
                for (_, m), s, e in zip(rows, ends - sizes, ends):
                    if m["edge"] and twice[s:e].any():
                        flags = np.flatnonzero(np.diff(np.concatenate([[0], twice[s:e].view(np.int8), [0]])))
                        first = m["place"] >> 8 & 0xFFFFFFFF
                        out += [(m["k"], m["place"] >> 40, first + int(x), first + int(y) - 1) for x, y in zip(flags[::2], flags[1::2])]
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    def spread(batches):
        for b in slices(batches, 1024):
            rows = list(zip(b.column("rank").to_pylist(), b.column("bytes").to_pylist()))
            if not rows:
                continue
            ranks, sizes = _windows(rows, length, prefix)
            place = np.repeat(b.column("place").to_numpy(), sizes)
            offset = np.arange(len(ranks)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            start = (place >> 8 & 0xFFFFFFFF) + offset
            edge = np.repeat(np.array(b.column("edge").to_pylist(), bool), sizes)
            yield pa.RecordBatch.from_arrays([_long(ranks), _long(np.repeat(b.column("k").to_numpy(), sizes)), _long(place >> 40), _long(start), pa.array(edge)], names=["w", "k", "n", "start", "edge"])

    few = sized.where(F.col("members") <= group).groupBy("rank").agg(F.collect_list(F.struct("k", "place", "edge", "bytes")).alias("of"))
    few = few.where(F.size("of") > 1).mapInArrow(within, "k long, n long, start long, end long")
    many = sized.where(F.col("members") > group).select("rank", "k", "place", "edge", "bytes").mapInArrow(spread, "w long, k long, n long, start long, edge boolean")
    again = many.groupBy("w").agg(F.count("*").alias("c")).where("c > 1")
    many = many.where("edge").join(again, "w").select("k", "n", "start", F.col("start").alias("end"))
    return few.union(many)


def repeated_runs(docs: DataFrame, length: int = LENGTH, prefix: int = PREFIX) -> DataFrame:
    """k, n, runs: per distinct text with any, the runs [start, end] of window starts whose string also starts elsewhere.

    1. Synchronised positions of every text are ranked by their 50-byte prefix; Spark counts
       ranks, and positions of a unique rank are finished.
    2. The others are reranked by the pair of that rank and the rank of all that the position's windows
       cover. A pair that occurs twice repeats all its windows. If a prefix stands
       in one context only, that is settled too.
    3. What is left are edges of repeats: there one place of each context gives its windows, whose
       ranks double from 50 to 100 to 200 bytes, and windows of equal rank are repeats.
    """
    positions = ranked_positions(docs, length, prefix)
    alive = positions.groupBy("rank").agg(F.count("*").alias("c")).where("c > 1").select("rank")
    alive = staged(positions.join(alive, "rank"))
    pairs = staged(alive.groupBy("rank", "around").agg(F.count("*").alias("c"), F.min(F.struct("k", "place")).alias("one")))
    whole = alive.join(pairs.where("c > 1").select("rank", "around"), ["rank", "around"], "left_semi")
    mixed_ranks = pairs.groupBy("rank").agg(F.count("*").alias("contexts")).where("contexts > 1").select("rank")
    wanted = staged(pairs.join(mixed_ranks, "rank").select("rank", "one.k", "one.place", (F.col("c") == 1).alias("edge")))
    at = F.shiftrightunsigned("place", 8).bitwiseAND(0xFFFFFFFF)
    whole = whole.select("k", F.shiftright("place", 40).alias("n"), at.alias("start"), (at + F.col("place").bitwiseAND(0xFF)).alias("end"))
    edges = repeated_windows(contexts(docs, wanted, length, prefix), length, prefix)
    return whole.union(edges).groupBy("k", "n").agg(F.collect_set(F.struct("start", "end")).alias("runs"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, prefix: int = PREFIX, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes, spans) of each whole text as UTF-8.

    Every byte covered by a `length`-byte string that also starts anywhere else, in the same or another
    document, is removed; copies of a text repeat each other. Results depend on the text alone, so they
    are found per distinct text and joined by its hash.

    Nulls: a null text is empty, a null doc_id stays null. Texts under `length` bytes keep all. Repeated
    rows are documents that repeat each other. Empty tables give none. Very long texts are read in
    segments that overlap. Extra columns are not read.
    """
    runs = staged(repeated_runs(docs, length, prefix))
    bits = word_filter(runs.select(F.col("k").alias("h")))

    def removed(text: bytes, found) -> list[tuple[int, int]]:
        out: list[list[int]] = []
        for s, e in sorted((r["start"], r["end"] + length) for r in found or ()):
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        return [(s, e) for s, e in out]

    def run(batches):
        for b in slices(batches):
            rows = []
            found = b.column("runs").to_pylist() if "runs" in b.schema.names else [None] * b.num_rows
            for doc, text, f in zip(b.column("doc_id").to_pylist(), as_bytes(b, "text"), found):
                spans = removed(text, f)
                kept, at = [], 0
                for s, e in spans:
                    kept.append(text[at:s])
                    at = e
                left = b"".join([*kept, text[at:]])
                rows.append((doc, len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), *([left, [{"start": s, "end": e} for s, e in spans]] if texts else [])))
            cols = list(zip(*rows)) if rows else [[]] * (5 + 2 * texts)
            types = [pa.int64()] * 4 + [pa.string()] + [pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))] * texts
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=out_names)

    out_names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept", "spans"] * texts]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<start: long, end: long>>" * texts
    clean = _keyed(docs).mapInArrow(lambda batches: run(chosen(slices(batches), bits, False)), schema)
    touched = in_filter(docs, bits).withColumn("n", _text_id()).join(runs, ["k", "n"], "left").select("doc_id", "text", "runs").mapInArrow(run, schema)
    return clean.union(touched)


def op2_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of documents that repeat elsewhere removed; nulls, empties and repeats as in remove_repeats()."""
    return remove_repeats(table(spark, sf_dir, "documents"))
