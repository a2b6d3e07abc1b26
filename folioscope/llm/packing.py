"""Vector bin packing of token sequences by the dot-product heuristic."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, slices, table

TOKENS, SEGMENTS, END = 2048, 256, 1
#: Items that wait at a time in a task; the next one to place is chosen among them.
POOL = 256
VOCABULARY = "byte_bpe_50k"

#: Characters for which both libraries' patterns are known to agree; other texts go through the slower one.
_RARE = re.compile("[^\t\n\r\x20-\x7e\xa1-˿]")
_SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of byte_bpe_50k as tokenizers gives them (add_special_tokens=False), mostly by tiktoken, which is faster."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb"))}
        self.fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path = public_tokenizers.path(f"{vocabulary}.json")
        self.slow = None

    def __call__(self, text: str) -> np.ndarray:
        if _SPECIAL not in text and not _RARE.search(text):
            try:
                return np.array(self.fast.encode_ordinary(text), np.uint32)
            except BaseException as e:  # the pattern gives up on some very long runs; its panic is no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


class Packer:
    """Fills bins under three limits: tokens, segments and loss-bearing tokens.

    Of the waiting items that fit what is left of the open bin, the one with the largest dot product
    of its size vector with the bin's remaining vector (both as shares of the limits) goes in. If
    none fits and items may be cut, the one with the largest product is cut to fill the bin; else the bin
    is closed. Items with few segments and many tokens thus go first where segments are short, and
    the other way round.
    """

    def __init__(self, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = TOKENS, pool: int = POOL, cut: bool = True):
        self.limits = np.array([tokens, segments, loss], float)
        self.pool, self.cut = pool, cut
        self.items: list[tuple] = []  # (name, start, length, loss tokens, payload)
        self.sizes = np.zeros((pool, 3))
        self.bin: list[tuple] = []
        self.left = self.limits.copy()
        self.n = 0

    def add(self, name, length: int, loss: int, payload=None) -> Iterator[list[tuple]]:
        """Take an item in; bins that become full come out, as lists of (name, start, length, payload)."""
        if not self.cut and (length > self.limits[0] or loss > self.limits[2]):
            raise ValueError(f"{name}: {length} tokens, {loss} with loss, don't fit a bin and may not be cut")
        start = 0
        most = int(min(self.limits[0], self.limits[2])) if self.cut else length
        while self.cut and length - start > most:  # full bins straight away
            yield [(name, start, most, payload)]
            start += most
            loss = min(loss, length - start)
        self._wait((name, start, length - start, min(loss, length - start), payload))
        while len(self.items) >= self.pool:
            yield from self._place()

    def finish(self) -> Iterator[list[tuple]]:
        while self.items:
            yield from self._place()
        if self.bin:
            yield self._close()

    def _wait(self, item: tuple) -> None:
        self.sizes[len(self.items)] = (item[2], 1, item[3])
        self.items.append(item)

    def _take(self, i: int) -> tuple:
        item, last = self.items[i], len(self.items) - 1
        self.items[i], self.sizes[i] = self.items[last], self.sizes[last]
        self.items.pop()
        return item

    def _close(self) -> list[tuple]:
        out, self.bin, self.left = self.bin, [], self.limits.copy()
        return out

    def _put(self, name, start: int, length: int, loss: int, payload) -> None:
        self.bin.append((name, start, length, payload))
        self.left -= (length, 1, loss)

    def _place(self) -> Iterator[list[tuple]]:
        sizes = self.sizes[:len(self.items)]
        dots = (sizes / self.limits) @ (self.left / self.limits)
        fits = (sizes <= self.left).all(axis=1)
        if fits.any():
            self._put(*self._take(int(np.argmax(np.where(fits, dots, -1)))))
        elif self.cut and self.left.min() >= 1:
            name, start, length, loss, payload = self._take(int(np.argmax(dots)))
            part = int(min(self.left[0], self.left[2], length))
            self._put(name, start, part, min(loss, part), payload)
            if length > part:
                self._wait((name, start + part, length - part, max(0, loss - part), payload))
        else:
            yield self._close()
            return
        if self.left.min() < 1:
            yield self._close()


def power_parts(bin_: list[tuple], full: int) -> Iterator[list[tuple]]:
    """A bin short of `full` tokens as bins whose lengths are powers of two: these need no padding."""
    total = sum(x[2] for x in bin_)
    if total == full:
        yield bin_
        return
    queue = list(bin_)
    for bit in range(total.bit_length() - 1, -1, -1):
        if not total >> bit & 1:
            continue
        room, out = 1 << bit, []
        while room:
            name, start, length, payload = queue.pop(0)
            part = min(room, length)
            out.append((name, start, part, payload))
            if length > part:
                queue.insert(0, (name, start + part, length - part, payload))
            room -= part
        yield out


def pack(docs: DataFrame, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, pool: int = POOL, ids: bool = False) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Documents are token ids and a closing id 1; every token of a document bears loss. Each task
    packs the rows of its own input partition, so nothing is shuffled or sorted and a lost task is
    repeated alone; sequence_id is partition * 2**40 + count. Bins are cut to be full; a task's last, short
    one is split into powers of two.

    Nulls: a null text is empty (only the closing id), a null doc_id stays null. Repeated rows
    are packed each. Empty tables give none. Very long texts are cut over many sequences. Extra
    columns are not read.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        encode = Encoder()
        first = TaskContext.get().partitionId() << 40
        packer = Packer(tokens, segments, loss or tokens, pool)
        rows: list[tuple] = []
        count = 0

        def put(bin_):
            nonlocal count
            for sequence in power_parts(bin_, tokens):
                at = 0
                for doc, start, length, x in sequence:
                    part = x[start:start + length].astype("<u4", copy=False).tobytes()
                    rows.append((doc, start, length, zlib.crc32(part), len(x), first + count, at, *([np.frombuffer(part, "<u4").tolist()] if ids else [])))
                    at += length
                count += 1

        def out():
            cols = list(zip(*rows)) if rows else [[]] * (7 + ids)
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + ([pa.array(cols[7], pa.list_(pa.int64()))] if ids else [])
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[*names, *["ids"] * ids])

        for b in slices(batches):
            for doc, text in zip(b.column("doc_id").to_pylist(), as_text(b, "text")):
                x = np.append(encode(text), np.uint32(END))
                for bin_ in packer.add(doc, len(x), len(x), x):
                    put(bin_)
                if len(rows) > (500 if ids else 20_000):
                    yield out()
        for bin_ in packer.finish():
            put(bin_)
        yield out()

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", ids array<long>" * ids)


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents packed into sequences of at most 2,048 tokens; nulls, empties and repeats as in pack()."""
    return pack(table(spark, sf_dir, "documents"))
