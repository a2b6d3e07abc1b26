"""Language-model scoring: a gated recurrent network in numpy with a class-factored softmax."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TEXT_KEY, as_bytes, slices, staged, table, text_key

#: Most words with a count of their own in every task; rarer ones are joined. A bound, not a share.
TABLE = 100_000
#: Head words have vectors of their own, in classes of equal size; the rest of the table is classed by frequency.
HEAD, MEMBERS, TAIL_CLASSES = 1024, 32, 30
HIDDEN = 24
#: Truncated backpropagation over WINDOW tokens, state carried on over the CHUNK.
WINDOW, CHUNK = 32, 128
#: Chunks side by side: few at first, so that the first steps are many, then twice as many after each BATCHES steps.
LANES, MOST_LANES, BATCHES = 16, 256, 64
RATE = 6e-3
#: Logits below this need no maximum taken out before exp() in single precision.
SAFE = 80.0
#: Lanes, tokens a window and tokens held at a time when scoring; softmaxes over classes run over ROWS states at a time, which the cache holds.
SCORE_LANES, SCORE_WINDOW, SCORE_TOKENS, ROWS = 256, 96, 500_000, 512

HEAD_CLASSES = HEAD // MEMBERS
RARE_CLASS, END_CLASS = HEAD_CLASSES + TAIL_CLASSES, HEAD_CLASSES + TAIL_CLASSES + 1
CLASSES = END_CLASS + 1
_LN10 = np.log(10.0)


def word_hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word, 1)
    return h - (1 << 64) if h >> 63 else h


class Vocabulary:
    """The most frequent training words that occur twice or more: ids by rank, 0 .. n - 1; n is any other word, n + 1 the end."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, ends: int, total: int, types: int):
        self.hashes, self.counts = hashes, counts.astype(np.float64)
        self.n, self.ends, self.total, self.types = len(hashes), ends, total, types
        self.rare = max(0.0, total - ends - float(self.counts.sum()))
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = np.asarray(hashes, np.int64)[self.order]
        n, head = self.n, min(HEAD, self.n)
        self.class_of = np.full(n + 2, RARE_CLASS, np.int32)
        self.class_of[:head] = np.arange(head) // MEMBERS
        self.class_of[n + 1] = END_CLASS
        tail = self.counts[head:]
        if len(tail):
            share = (np.cumsum(tail) - tail) / tail.sum()
            self.class_of[head:n] = HEAD_CLASSES + np.minimum(TAIL_CLASSES - 1, (share * TAIL_CLASSES).astype(int))
        self.input_of = np.where(np.arange(n + 2) < head, np.arange(n + 2), HEAD + self.class_of)
        mass = np.append(self.counts, [self.rare, ends])
        self.class_mass = np.bincount(self.class_of, mass, CLASSES)
        # within a class by counts; the network adds to it for head words
        self.within = np.zeros(n + 2)
        if n:
            self.within[:n] = np.log(self.counts / self.class_mass[self.class_of[:n]])
        scale = total + 0.5 * (types + 1)
        self.base = np.log10(np.append(self.counts + 0.5, [1.0, ends + 0.5]) / max(scale, 1.0))
        self.known = np.append(np.ones(n), [0.0, float(ends > 0)])

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of words by hash."""
        if not self.n:
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.sorted, hashes), self.n - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], self.n).astype(np.int32)


def _exponentials(logits: np.ndarray, safe: bool) -> np.ndarray:
    """exp() of logits in place, up to a factor a row, and its row sums."""
    if not safe:
        logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], logits.dtype)  # sums of short rows are slow otherwise


def _safe(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether exp() of the logits stays in single precision: states lie within -1 and 1, so the weights (a row a logit) bound them."""
    return bool((np.abs(weights).sum(axis=1) + np.abs(bias)).max(initial=0.0) < SAFE)


class Network:
    """Gated recurrent unit; P(token) = P(class | state) P(token | class, state)."""

    SHAPES = {"e": (HEAD + CLASSES, HIDDEN), "wx": (HIDDEN, 3 * HIDDEN), "bx": (3 * HIDDEN,), "u": (HIDDEN, 3 * HIDDEN),
              "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "wh": (HEAD, HIDDEN), "bh": (HEAD,)}
    SIZE = sum(int(np.prod(s)) for s in SHAPES.values())

    def __init__(self, flat: np.ndarray):
        self.flat = flat.astype(np.float32)
        self.p, at = {}, 0
        for k, s in self.SHAPES.items():
            n = int(np.prod(s))
            self.p[k] = self.flat[at:at + n].reshape(s)
            at += n

    @classmethod
    def initial(cls, vocabulary: Vocabulary, seed: int = 5) -> Network:
        """Untrained, it gives each token its share of the training tokens."""
        rng = np.random.default_rng(seed)
        net = cls(np.zeros(cls.SIZE))
        for k, scale in (("e", 0.3), ("wx", 0.3), ("u", 0.2)):
            net.p[k][...] = rng.normal(0, scale, cls.SHAPES[k])
        mass = np.maximum(vocabulary.class_mass, 0.5)
        net.p["bc"][...] = np.log(mass / mass.sum())
        head = min(HEAD, vocabulary.n)
        net.p["bh"][...] = -30.0
        net.p["bh"][:head] = vocabulary.within[:head]
        return net

    def forward(self, x: np.ndarray, h: np.ndarray, keep: np.ndarray | None, projected: np.ndarray, trace: list | None = None):
        """States after each of x (T, B) input ids from h (B, HIDDEN); keep (T, B) is 0 where a document starts.

        Inside, units run down and lanes along, so that each gate is one piece of memory. projected and the
        recurrent weights of the gates are halved: a logistic function is a tanh() of half its input.
        """
        m = HIDDEN
        u = np.ascontiguousarray(self.p["u"].T)
        u[:2 * m] *= 0.5
        whole = np.ones(len(x), bool) if keep is None else keep.all(axis=1)
        out = np.empty((len(x), m, len(h)), np.float32)
        h = np.ascontiguousarray(h.T)
        for t in range(len(x)):
            if not whole[t]:
                h = h * keep[t]
            g = u @ h
            a = np.ascontiguousarray(projected.take(x[t], axis=0).T)  # a step at a time stays in the cache
            gates = a[:2 * m]
            gates += g[:2 * m]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            r, z = gates[:m], gates[m:]
            c = r * g[2 * m:]
            c += a[2 * m:]
            np.tanh(c, out=c)
            if trace is not None:
                trace.append((h, g[2 * m:], r, z, c))
            new = out[t]
            np.subtract(h, c, out=new)
            new *= z
            new += c
            h = new
        return out.transpose(0, 2, 1), h.T.copy()

    def project(self) -> np.ndarray:
        """What each input id adds to the gates (halved) and to the candidate."""
        out = self.p["e"] @ self.p["wx"] + self.p["bx"]
        out[:, :2 * HIDDEN] *= 0.5
        return out

    def log_probability(self, states: np.ndarray, ids: np.ndarray, v: Vocabulary, grad: dict | None = None):
        """Natural log P of ids (N) from N states (..., HIDDEN); with grad also d loss / d states (N, HIDDEN)."""
        y = v.class_of[ids]
        n = len(ids)
        own = np.empty((*states.shape[:-1], HIDDEN + 1), states.dtype)  # a last column of ones takes the biases along
        own[..., :HIDDEN] = states
        own[..., HIDDEN] = 1
        own = own.reshape(n, HIDDEN + 1)
        wc = np.vstack([self.p["wc"], self.p["bc"]])
        safe = _safe(self.p["wc"].T, self.p["bc"])
        shares = np.empty(n, states.dtype)
        back = None if grad is None else np.empty((n, HIDDEN), states.dtype)
        firsts = np.arange(ROWS) * CLASSES
        for s in range(0, n, ROWS):
            rows = own[s:s + ROWS]
            logits = rows @ wc
            total = _exponentials(logits, safe)
            flat, at = logits.reshape(-1), firsts[:len(rows)] + y[s:s + ROWS]
            shares[s:s + ROWS] = flat[at] / total
            if grad is not None:
                logits *= (1 / (n * total))[:, None]
                flat[at] -= np.float32(1 / n)
                pull = rows.T @ logits
                grad["wc"] += pull[:HIDDEN]
                grad["bc"] += pull[HIDDEN]
                np.matmul(logits, self.p["wc"].T, out=back[s:s + ROWS])
        out = np.log(shares) + v.within[ids]
        head = np.flatnonzero(y < HEAD_CLASSES)
        order = head[np.argsort(y[head].astype(np.uint8), kind="stable")]
        cuts = np.searchsorted(y[order], np.arange(HEAD_CLASSES + 1))
        ordered, member = own.take(order, axis=0), ids[order] % MEMBERS
        shares = np.empty(len(order))
        pulled = None if grad is None else np.empty((len(order), HIDDEN), states.dtype)
        wh = np.hstack([self.p["wh"], self.p["bh"][:, None]])
        safe = _safe(self.p["wh"], self.p["bh"])
        firsts = np.arange(np.diff(cuts).max(initial=0)) * MEMBERS
        for k in range(HEAD_CLASSES):
            part = slice(cuts[k], cuts[k + 1])
            m = part.stop - part.start
            if not m:
                continue
            words = slice(k * MEMBERS, (k + 1) * MEMBERS)
            rows = ordered[part]
            w = rows @ wh[words].T
            sums = _exponentials(w, safe)
            flat, at = w.reshape(-1), firsts[:m] + member[part]
            shares[part] = flat[at] / sums
            if grad is not None:
                w *= (1 / (n * sums))[:, None]
                flat[at] -= np.float32(1 / n)
                pull = w.T @ rows
                grad["wh"][words] += pull[:, :HIDDEN]
                grad["bh"][words] += pull[:, HIDDEN]
                np.matmul(w, self.p["wh"][words], out=pulled[part])
        out[order] += np.log(np.maximum(shares, 1e-30)) - v.within[ids[order]]
        if grad is not None:
            back[order] += pulled
        return out, back

    def gradients(self, x: np.ndarray, ids: np.ndarray, h: np.ndarray, keep: np.ndarray, v: Vocabulary):
        """Loss gradients over one window, truncated at its start; and the state at its end. Negative ids are padding."""
        grad = {k: np.zeros(s, np.float32) for k, s in self.SHAPES.items()}
        trace: list = []
        projected = self.project()
        states, last = self.forward(x, h, keep, projected, trace)
        t_n, b_n, m = states.shape
        real = ids >= 0
        if real.all():
            back = self.log_probability(states, ids.reshape(-1), v, grad)[1]
        else:
            back = np.zeros((t_n * b_n, m), np.float32)
            back[real.reshape(-1)] = self.log_probability(states[real], ids[real], v, grad)[1]
        back = np.ascontiguousarray(back.reshape(t_n, b_n, m).transpose(0, 2, 1))
        da = np.empty((t_n, 3 * m, b_n), np.float32)
        dh = np.zeros((m, b_n), np.float32)
        dg = np.empty((3 * m, b_n), np.float32)
        u = self.p["u"]
        whole = keep.all(axis=1)
        for t in range(t_n - 1, -1, -1):
            prev, g, r, z, c = trace[t]
            dh += back[t]
            dr, dz, dc = da[t, :m], da[t, m:2 * m], da[t, 2 * m:]
            np.multiply(c, c, out=dc)
            np.subtract(1, dc, out=dc)
            left = 1 - z
            dc *= left
            dc *= dh
            left *= z
            np.subtract(prev, c, out=dz)
            dz *= dh
            dz *= left
            np.subtract(1, r, out=dr)
            dr *= r
            dr *= g
            dr *= dc
            dg[:2 * m] = da[t, :2 * m]
            np.multiply(dc, r, out=dg[2 * m:])
            grad["u"] += prev @ dg.T
            dh *= z
            dh += u @ dg
            if not whole[t]:
                dh *= keep[t]
        pull = np.matmul(da.transpose(0, 2, 1), self.p["wx"].T).reshape(-1, m)
        inputs = x.reshape(-1).astype(np.int16)
        order = np.argsort(inputs, kind="stable")
        first = np.flatnonzero(np.diff(inputs[order], prepend=-1))
        grad["e"][inputs[order[first]]] = np.add.reduceat(pull.take(order, axis=0), first, axis=0)
        e = np.hstack([self.p["e"], np.ones((HEAD + CLASSES, 1), np.float32)])  # the last column is the bias's
        pull = np.matmul(da, e.take(x, axis=0)).sum(axis=0)
        grad["wx"] += pull[:, :m].T
        grad["bx"] += pull[:, m]
        return grad, last


class Adam:
    def __init__(self, net: Network, rate: float = RATE):
        self.net, self.rate, self.t = net, rate, 0
        self.m, self.v = np.zeros_like(net.flat), np.zeros_like(net.flat)

    def step(self, grad: dict) -> None:
        g = np.concatenate([grad[k].ravel() for k in Network.SHAPES])
        norm = float(np.sqrt((g * g).sum()))
        if not np.isfinite(norm):
            return
        g *= min(1.0, 1.0 / (norm + 1e-12))
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        self.net.flat -= self.rate * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.99 ** self.t)) + 1e-6)


def train_on(net: Network, chunks: np.ndarray, v: Vocabulary, optimiser: Adam) -> None:
    """chunks (n, CHUNK) of ids, -1 after the last: windows in turn, the state carried over from one to the next."""
    end = v.n + 1
    s = 0
    while s < len(chunks):
        lanes = min(MOST_LANES, LANES << min(16, optimiser.t // BATCHES))
        ids = chunks[s:s + lanes].T
        s += lanes
        before = np.vstack([np.full((1, ids.shape[1]), end), np.where(ids[:-1] < 0, end, ids[:-1])])
        keep = (before != end).astype(np.float32)
        x = v.input_of[before]
        h = np.zeros((ids.shape[1], HIDDEN), np.float32)
        for w in range(0, CHUNK, WINDOW):
            if (ids[w:w + WINDOW] < 0).all():
                break
            grad, h = net.gradients(x[w:w + WINDOW], ids[w:w + WINDOW], h, keep[w:w + WINDOW], v)
            optimiser.step(grad)


def score_documents(net: Network, documents: list[np.ndarray], v: Vocabulary, lanes: int = SCORE_LANES) -> np.ndarray:
    """log10 P of each whole document (ids that end with the end token).

    Documents are laid end to end in lanes; windows run over all lanes, the state goes on from window
    to window and starts anew with a document.
    """
    out = np.zeros(len(documents))
    if not documents:
        return out
    end = v.n + 1
    lanes = min(lanes, len(documents))
    order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    load, rows = [0] * lanes, [[] for _ in range(lanes)]
    heap = [(0, i) for i in range(lanes)]
    for d in order:
        n, i = heapq.heappop(heap)
        rows[i].append(d)
        load[i] = n + len(documents[d])
        heapq.heappush(heap, (load[i], i))
    by = sorted(range(lanes), key=lambda i: -load[i])
    lengths = np.array([load[i] for i in by])
    streams = [np.concatenate([documents[d] for d in rows[i]]) for i in by]
    owners = [np.repeat(rows[i], [len(documents[d]) for d in rows[i]]) for i in by]
    projected = net.project()
    h = np.zeros((lanes, HIDDEN), np.float32)
    last = np.full(lanes, end)
    for w in range(0, int(lengths[0]), SCORE_WINDOW):
        live = int(np.searchsorted(-lengths, -w, "left"))
        t_n = int(min(SCORE_WINDOW, lengths[0] - w))
        ids = np.full((live, t_n), -1, np.int64)
        doc = np.zeros((live, t_n), np.int64)
        for b in range(live):
            part = streams[b][w:w + t_n]
            ids[b, :len(part)] = part
            doc[b, :len(part)] = owners[b][w:w + t_n]
        ids = ids.T
        real = ids >= 0
        safe = np.where(real, ids, end)
        before = np.vstack([last[None, :live], safe[:-1]])
        states, h_new = net.forward(v.input_of[before], h[:live], (before != end).astype(np.float32), projected)
        h[:live], last[:live] = h_new, safe[-1]
        wanted = ids[real]
        if len(wanted) < ids.size:
            states = states[real]
        out += np.bincount(doc.T[real], net.log_probability(states, wanted, v)[0], len(documents))
    return out / _LN10


def _held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def _prepared(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.select("doc_id", "text", _held_out().alias("held_out"), *text_key())


#: Tokens of a segment, about: a document is never cut, so a very long one is a segment by itself.
SEGMENT_TOKENS = 250_000
#: Segments a file when staged: Spark's reader holds up to 4,096 rows of a file at once, which would be all segments of a task.
SEGMENTS_A_FILE = 8
DOCUMENT_FIELDS = [("doc_id", pa.int64(), "long"), ("held_out", pa.bool_(), "boolean"), (TEXT_KEY[0], pa.int64(), "long"), (TEXT_KEY[1], pa.int32(), "int"), ("size", pa.int32(), "int")]


class _Local(dict):
    """Words of a segment by order of appearance, from 1 on; 0 is the end."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self) + 1
        return found


def segments(docs: DataFrame) -> DataFrame:
    """Texts as ids, walked once: a row holds some documents, their ids end to end (an end after each), and what its ids mean.

    ids are bytes, of 2 each where that will do, else of 4: Spark moves them whole, not one by one. words are hashes by local id from 1 on, counts how often the row's training documents have them, ends how many these are.
    """
    schema = pa.schema([("words", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("ends", pa.int64()), ("ids", pa.binary()), *[(n, pa.list_(t)) for n, t, _ in DOCUMENT_FIELDS]])

    def run(batches):
        local, ids, rows, size = _Local(), [], [], 0
        end = np.zeros(1, np.int32)

        def out():
            nonlocal local, ids, rows, size
            every, columns = np.concatenate(ids), list(zip(*rows))
            learnt = np.repeat(~np.array(columns[1], bool), columns[4])
            counts = np.bincount(every[learnt], minlength=len(local) + 1)
            words = np.fromiter(map(word_hash, local), np.int64, len(local))
            packed = every.astype("<u2" if len(local) < 1 << 16 else "<i4").tobytes()
            arrays = [words, counts[1:], int(counts[0]), packed, *columns]
            one = pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(arrays, schema)], schema=schema)
            local, ids, rows, size = _Local(), [], [], 0
            return one

        for b in slices(batches, 256):
            held, k, k2, doc = (b.column(c).to_pylist() for c in ("held_out", *TEXT_KEY, "doc_id"))
            for i, text in enumerate(as_bytes(b, "text")):
                words = text.lower().split()
                ids += [np.fromiter(map(local.__getitem__, words), np.int32, len(words)), end]
                rows.append((doc[i], held[i], k[i], k2[i], len(words) + 1))
                size += len(words) + 1
                if size > SEGMENT_TOKENS:
                    yield out()
        if rows:
            yield out()

    kinds = "words array<long>, counts array<long>, ends long, ids binary, " + ", ".join(f"{n} array<{t}>" for n, _, t in DOCUMENT_FIELDS)
    return _prepared(docs).mapInArrow(run, kinds)


def word_counts(tokens: DataFrame) -> DataFrame:
    """h, c of all words of the training documents of segments(), counted in full; a null h counts the documents."""
    words = tokens.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).where("w.counts > 0").groupBy(F.col("w.words").alias("h")).agg(F.sum("w.counts").alias("c"))
    return words.union(tokens.agg(F.coalesce(F.sum("ends"), F.lit(0)).alias("c")).select(F.lit(None).cast("long").alias("h"), "c"))


def vocabulary(counts: DataFrame, size: int = TABLE) -> tuple[Vocabulary, float]:
    """The vocabulary, and the probability that a rare word is one never seen (singletons' share of rare tokens).

    It holds every word that occurs at least as often as a least count, the smallest for which that is at most `size`
    words. The count comes from a histogram of counts (exact below 4,096, 12 leading bits above), so the driver gets
    a row for each bin and then the table itself, never a share of it from each partition.
    """
    words = counts.where("h IS NOT NULL AND c > 0")
    ends = counts.where("h IS NULL").agg(F.sum("c")).first()[0] or 0
    n, types, ones = words.agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1)).first()
    low = F.greatest(F.lit(0), F.floor(F.log2(F.col("c").cast("double"))) - 11).cast("int")
    at = words.where("c > 1").select("c", low.alias("low")).select(F.expr("shiftleft(shiftright(c, low), low)").alias("at"))
    held, least = 0, None
    for value, many in sorted(map(tuple, at.groupBy("at").count().collect()), reverse=True):
        held += many
        if held > size:
            break
        least = value
    top = words.where(F.col("c") >= least).toPandas() if least is not None else pd.DataFrame({"h": [], "c": []})
    top = top.sort_values(["c", "h"], ascending=[False, True])
    v = Vocabulary(top["h"].to_numpy(np.int64), top["c"].to_numpy(np.int64), int(ends), int((n or 0) + ends), int(types + (ends > 0)))
    return v, float(min(0.9, max(0.01, ones / v.rare))) if v.rare else 0.9


def _documents(batches, v: Vocabulary, names: list[str]):
    """Of each segment: its documents' ids in the vocabulary, its local ids, hashes by local id (0: the end), and columns of its documents."""
    for b in batches:
        for i in range(b.num_rows):
            words, size = (b.column(c)[i].values.to_numpy() for c in ("words", "size"))
            packed = b.column("ids")[i].as_buffer()
            local = np.frombuffer(packed, "<u2" if packed.size == 2 * size.sum() else "<i4")
            cuts = np.cumsum(size)[:-1]
            known = np.append(np.int32(v.n + 1), v.ids(words))[local]
            yield np.split(known, cuts), np.split(local, cuts), np.append(0, words), [b.column(c)[i].values for c in names]


def trained(tokens: DataFrame, v: Vocabulary) -> Network:
    """The network: each partition trains a copy on all tokens of its training documents, weights are averaged by tokens.

    tokens are those of segments(). Only sums by parameter are shuffled; the driver gets as many numbers as the network
    has. The weights depend on how the table is cut into partitions, as each trains from the same start.
    """
    start = Network.initial(v)

    def run(batches):
        net = Network(start.flat.copy())
        optimiser, seen = Adam(net), 0
        parts, size = [], 0

        def use(last: bool = False):
            nonlocal parts, size, seen
            stream = np.concatenate(parts)
            if last:
                stream = np.append(stream, np.full(-len(stream) % CHUNK, -1, stream.dtype))
            cut = len(stream) // CHUNK * CHUNK
            chunks, rest = stream[:cut].reshape(-1, CHUNK), stream[cut:]
            seen += int((chunks >= 0).sum())
            train_on(net, chunks, v, optimiser)
            parts, size = [rest] if len(rest) else [], len(rest)

        for documents, _, _, (held,) in _documents(batches, v, ["held_out"]):
            for x, out in zip(documents, held.to_pylist()):
                if not out:
                    parts.append(x)
                    size += len(x)
            if size > SCORE_TOKENS:
                use()
        if parts:
            use(last=True)
        if seen:
            yield pd.DataFrame({"i": np.arange(Network.SIZE), "w": net.flat.astype(np.float64) * seen, "n": np.full(Network.SIZE, float(seen))})

    def frames(batches):
        for pdf in run(batches):
            yield pa.RecordBatch.from_pandas(pdf, preserve_index=False)

    sums = tokens.select("words", "ids", "size", "held_out").mapInArrow(frames, "i long, w double, n double").groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w")).toPandas()
    if sums.empty:
        return start
    flat = np.zeros(Network.SIZE)
    flat[sums["i"].to_numpy()] = sums["w"].to_numpy()
    return Network(flat)


def scored(tokens: DataFrame, v: Vocabulary, net: Network) -> DataFrame:
    """A row a document of segments(): its sums over the words of the table, and hashes of its other words, repeats included."""
    names = [n for n, _, _ in DOCUMENT_FIELDS[:4]]
    more = pa.schema([("times", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64()))])

    def run(batches):
        held, ids, rare, size = [], [], [], 0

        def flush():
            nonlocal held, ids, rare, size
            rows = [(len(x), int(v.known[x].sum()), float(v.base[x[x != v.n]].sum()), float(s), r) for x, s, r in zip(ids, score_documents(net, ids, v), rare)]
            own = [pa.concat_arrays(c) for c in zip(*held)] + [pa.array(c, f.type) for c, f in zip(zip(*rows), more)]
            held, ids, rare, size = [], [], [], 0
            return pa.RecordBatch.from_arrays(own, names=[*names, *more.names])

        for documents, local, words, columns in _documents(batches, v, names):
            held.append(columns)
            ids += documents
            rare += [words[y[x == v.n]] for x, y in zip(documents, local)]
            size += sum(map(len, documents))
            if size > SCORE_TOKENS:
                yield flush()
        if ids:
            yield flush()

    kinds = ", ".join(f"{n} {t}" for n, _, t in DOCUMENT_FIELDS[:4]) + ", times long, known long, base double, score double, rare array<long>"
    return tokens.select("words", "ids", "size", *names).mapInArrow(run, kinds)


def score(docs: DataFrame, size: int = TABLE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each whole text.

    Training documents (all but those whose crc32(doc_id) mod 5 is 1) give the counts of every
    word, the classes, and the network's training. A text's log10 probability is summed over
    its words and one end. Words outside the most frequent `size` are one class for the
    network; their own counts are joined by hash, never sent to all tasks: given that class a word
    seen c times has (1 - u) c / (all rare tokens), unseen words together u.

    Nulls: a null text is empty (the end alone), a null doc_id is not held out. Repeated rows are
    documents that count and are scored each. Empty tables give none; without training documents
    counts are 0. Very long texts run through window by window. Extra columns are not read.
    """
    tokens = staged(segments(docs), SEGMENTS_A_FILE)
    counts = staged(word_counts(tokens))
    v, unseen = vocabulary(counts, size)
    d = staged(scored(tokens, v, trained(tokens, v)))
    scale = max(v.total + 0.5 * (v.types + 1), 1.0)
    # copies of a text have the same rare words, so these are joined once a text
    rare = d.where("size(rare) > 0").groupBy(*TEXT_KEY).agg(F.any_value("rare").alias("rare")).select(*TEXT_KEY, F.explode("rare").alias("h"), F.lit(1).alias("times"))
    rare = rare.join(counts.where("h IS NOT NULL AND c > 0"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    within = F.when(F.col("c") > 0, F.log10(F.col("c") * F.lit((1 - unseen) / max(v.rare, 1.0)))).otherwise(F.lit(float(np.log10(unseen))))
    texts = rare.groupBy(*TEXT_KEY).agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("r_known"),
                                         F.sum(F.col("times") * F.log10((F.col("c") + 0.5) / F.lit(scale))).alias("r_base"), F.sum(F.col("times") * within).alias("r_score"))
    # single precision differs in the last digits by a text's neighbours: its copies get one score
    own = d.groupBy(*TEXT_KEY).agg(F.max("score").alias("score")).join(texts, TEXT_KEY, "left")
    d = d.drop("score", "rare").join(own, TEXT_KEY)
    share = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return d.select("doc_id", "held_out", F.col("times").alias("n_tokens"), (F.col("known") + F.coalesce("r_known", F.lit(0))).alias("n_known"),
                    F.lit(v.total).cast("long").alias("train_tokens"), (F.col("base") + share("r_base")).alias("base_score"), (F.col("score") + share("r_score")).alias("score"))


def op10_recurrent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of each whole text of documents; nulls, empties and repeats as in score()."""
    return score(table(spark, sf_dir, "documents"))
