"""Language-model scores by masked pseudo-likelihood.

Every word of a text is predicted from the two words on each side; a document's score is the sum of the words'
conditional log-probabilities. Two things predict, and both come from the whole corpus:

1. A bidirectional window network, trained in numpy inside Spark's tasks. Its vocabulary is the most frequent words and
   buckets of hashed ones. The four words around give a hidden layer; that gives the probability of a class of words,
   then of the word in its class (a hierarchical output layer). Every task trains a copy on every word of all its
   documents, copies are averaged by their words, in rounds.
2. Counts of windows, keyed by the words themselves: how often the same four words surround this word elsewhere, and
   surround anything elsewhere. They grow with the corpus and are shuffled to buckets by the surrounding words. The
   word's own occurrence doesn't count, so that a text isn't predicted from itself.

Where the surrounding words occur elsewhere, the counts are blended with the network's probability (``STRENGTH`` counts'
worth); elsewhere the network alone decides. Windows that are common in some batch of texts are counted beforehand and
looked up, so that a line in a large share of all documents never comes together in one task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.common import saved

#: Classes and words in each: the vocabulary; the last WORDS entries of it are hashed words, the very last the text's end.
CLASSES, WORDS = 64, 64
SIZE, HASHED = CLASSES * WORDS, 512
END = SIZE - 1
#: Numbers of the hidden layer; words of a step of training, and its size; parts of the corpus after which copies are averaged.
HIDDEN, STEP, RATE, ROUNDS = 32, 32_768, 0.02, (0.125, 1.0)
#: Words handled at once; counts of words that a task holds before it adds them up.
CHUNK, HELD = 1024, 500_000
#: Words on each side; counts that the network's probability weighs as much as.
SIDE, STRENGTH = 2, 1.0
#: Bytes of text in a batch and a bucket, about; buckets at least.
BATCH, BUCKET, LEAST_BUCKETS = 1_500_000, 8_000_000, 64
#: Bytes of text, about, that one copy of the network is trained on.
SHARE = 32_000_000
#: A window is common if a batch holds it so often; entries of the table of common windows at most (others are dealt).
COMMON, MOST_COMMON = 64, 65_536
_FAR = np.uint64(0x5851F42D4C957F2D)
_SIDES = W.mixed(np.arange(101, 105, dtype=np.uint64)) | np.uint64(1)
Params = list[np.ndarray]


def texts_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, list[bytes]]]:
    """(rows, hash of each word, row of each word, UTF-8 bytes of each row) for about BATCH bytes of text at once."""
    for batch in batches:
        for at, raws in W.batches(batch["text"].tolist(), BATCH):
            hashes, owner, _ = W.words(raws, fold=True)
            yield batch.iloc[at : at + len(raws)], hashes, owner, raws


def around(values: np.ndarray, owner: np.ndarray, beyond) -> np.ndarray:
    """A row per word: the values of the two words before and the two after it, ``beyond`` outside the text."""
    n = len(values)
    out = np.full((4, n), beyond, values.dtype)
    for row, shift in zip(out, (-2, -1, 1, 2), strict=True):
        k = abs(shift)
        if n > k:
            same = owner[k:] == owner[:-k]
            if shift < 0:
                row[k:][same] = values[:-k][same]
            else:
                row[:-k][same] = values[k:][same]
    return out


def windows(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A 64-bit name of the words around each word."""
    near = around(hashes, owner, _FAR)
    return W.mixed((near * _SIDES[:, None]).sum(axis=0, dtype=np.uint64))


def whole(window: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A name of the word and the words around it."""
    return W.mixed(window ^ W.mixed(hashes + np.uint64(1)))


class Vocabulary:
    """Entries of words: the most frequent have their own, in order of frequency, others share HASHED ones."""

    def __init__(self, top: np.ndarray, share: np.ndarray):
        order = np.argsort(top)
        # a last name that no word stands for, and where the names of each first 16 bits begin
        self.order, self.sorted = np.append(order, -1), np.append(top[order], ~np.uint64(0))
        begin = np.searchsorted(self.sorted[:-1] >> np.uint64(48), np.arange((1 << 16) + 1, dtype=np.uint64))
        self.begin, self.most = begin[:-1], int(np.diff(begin).max())
        self.share = share  # of each entry's occurrences, about, that one of its words has (log)

    def entries(self, hashes: np.ndarray) -> np.ndarray:
        out = (SIZE - HASHED + (hashes >> np.uint64(40)) % np.uint64(HASHED - 1)).astype(np.int64)
        at = self.begin[(hashes >> np.uint64(48)).view(np.int64)]
        for _ in range(self.most):  # names of the same first bits, few in a table of hashes
            at += self.sorted[at] < hashes
        order = self.order[at]
        return np.where((self.sorted[at] == hashes) & (order >= 0), order, out)


def start(counts: np.ndarray) -> Params:
    """Parameters before training: tables of the four sides, class and word weights, and biases from the counts."""
    g = np.random.default_rng(0)
    total = counts.reshape(CLASSES, WORDS).sum(axis=1)
    shapes = [g.normal(0, 0.1, (4, SIZE, HIDDEN)), g.normal(0, 0.1, (HIDDEN, CLASSES)), g.normal(0, 0.1, (CLASSES, HIDDEN, WORDS))]
    bias = [np.log(total + 1.0) - np.log(total.sum() + CLASSES), np.log(counts + 1.0).reshape(CLASSES, WORDS) - np.log(total + WORDS)[:, None]]
    return [x.astype(np.float32) for x in (*shapes, *bias)]


def _softmaxes(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, clipped: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exponentials of h @ weights + bias by row, and their sums over the first CLASSES columns and over the others."""
    e = h @ weights
    e += bias
    if clipped:
        np.clip(e, -60, 60, out=e)  # a step too far mustn't overflow
    np.exp(e, out=e)
    one = np.ones(max(CLASSES, WORDS), e.dtype)
    return e, e[:, :CLASSES] @ one[:CLASSES], e[:, CLASSES:] @ one[:WORDS]


def _summed(rows: np.ndarray, entry: np.ndarray, size: int) -> np.ndarray:
    """The sum of the rows of each entry. Numbers are added two at a time, as complex ones: half the passes over the rows."""
    by = np.argsort(entry.astype(np.int16), kind="stable")
    own = entry[by]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    pairs = rows.view(np.result_type(rows.dtype, np.complex64))
    out = np.zeros((size, pairs.shape[1]), pairs.dtype)
    out[own[first]] = np.add.reduceat(pairs.take(by, axis=0), first, axis=0)
    return out.view(rows.dtype)


def forward(p: Params, near: np.ndarray, target: np.ndarray, grads: Params | None = None) -> np.ndarray:
    """Log-probability of each target entry given the entries around it; adds the mean loss's gradients to ``grads``.

    Words of one class are handled together, CHUNK at once; the probabilities of all classes and of the words of this one
    come from one product."""
    order = np.argsort((target // WORDS).astype(np.int16), kind="stable")
    near, target = near[:, order], target[order]
    cls, word, n = target // WORDS, target % WORDS, len(target)
    out = np.empty(n, np.float32)
    dh = np.empty((n if grads is not None else 0, HIDDEN), p[0].dtype)
    # numbers of the hidden layer are within 1, so no sum exceeds this bound
    clipped = max(float((np.abs(w).sum(axis=-2) + np.abs(b)).max()) for w, b in ((p[1], p[3]), (p[2], p[4]))) > 60
    cuts = np.searchsorted(cls, np.arange(CLASSES + 1))
    for c in np.flatnonzero(np.diff(cuts)).tolist():
        weights, bias = np.concatenate([p[1], p[2][c]], axis=1), np.concatenate([p[3], p[4][c]])
        for i in range(cuts[c], cuts[c + 1], CHUNK):
            at = slice(i, min(i + CHUNK, cuts[c + 1]))
            own, row = word[at] + CLASSES, np.arange(at.stop - i)
            h = p[0][0].take(near[0, at], axis=0)
            for side in (1, 2, 3):
                h += p[0][side].take(near[side, at], axis=0)
            np.tanh(h, out=h)
            e, sx, sy = _softmaxes(h, weights, bias, clipped)
            out[at] = np.log(e[:, c] / sx) + np.log(e[row, own] / sy)
            if grads is None:
                continue
            e[:, :CLASSES] *= (1 / sx)[:, None]
            e[:, CLASSES:] *= (1 / sy)[:, None]
            e[:, c] -= 1
            e[row, own] -= 1
            product, total = h.T @ e / n, np.ones(len(e), e.dtype) @ e / n
            grads[1] += product[:, :CLASSES]
            grads[2][c] += product[:, CLASSES:]
            grads[3] += total[:CLASSES]
            grads[4][c] += total[CLASSES:]
            np.multiply(h, h, out=h)
            np.matmul(e, weights.T, out=dh[at])
            dh[at] *= 1 - h
    if grads is not None:
        for side in range(4):
            grads[0][side] += _summed(dh, near[side], SIZE) / n
    result = np.empty(n, np.float32)
    result[order] = out
    return result


class Trainer:
    """Adam over steps of STEP words."""

    def __init__(self, params: Params):
        self.p = [x.copy() for x in params]
        self.m, self.v = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
        self.steps = 0

    def step(self, near: np.ndarray, target: np.ndarray) -> float:
        grads = [np.zeros_like(x) for x in self.p]
        loss = -float(forward(self.p, near, target, grads).mean())
        self.steps += 1
        rate = RATE * math.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        for p, g, m, v in zip(self.p, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * m / (np.sqrt(v) + 1e-7)
        return loss


def _flat(p: Params) -> np.ndarray:
    return np.concatenate([x.reshape(-1) for x in p])


def _shaped(flat: np.ndarray, like: Params) -> Params:
    ends = np.cumsum([x.size for x in like])
    return [part.reshape(x.shape) for part, x in zip(np.split(flat, ends[:-1]), like, strict=True)]


def _averaged(copies: DataFrame) -> np.ndarray | None:
    """The mean of all copies by their weights; rows: part, task, weight, values. Added up in two levels, so no task
    gets the copies of all others; the driver gets one."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        weight = float(pdf["weight"].sum())
        mean = sum(np.frombuffer(v, np.float32) * np.float64(w / weight) for v, w in zip(pdf["values"], pdf["weight"], strict=True))
        return pd.DataFrame([(int(pdf["part"].iloc[0]), 0, weight, mean.astype(np.float32).tobytes())], columns=["part", "task", "weight", "values"])

    schema = "part int, task int, weight double, values binary"
    some = copies.groupBy("part", F.pmod("task", F.lit(64)).alias("some")).applyInPandas(add, schema)
    rows = sorted(some.groupBy("part").applyInPandas(add, schema).collect(), key=lambda r: r["part"])
    return np.concatenate([np.frombuffer(r["values"], np.float32) for r in rows]) if rows else None


def trained(docs: DataFrame, vocabulary: Vocabulary, params: Params, common: np.ndarray) -> tuple[Params, np.ndarray, np.ndarray]:
    """The network after all rounds; and how often each common window, and each common window with its word, occurs.

    Each round takes the documents whose hash is in its range; all rounds together take every document once."""
    spark, low, counts = docs.sparkSession, 0.0, []
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    few = docs.select("text").coalesce(max(1, -(-size // SHARE)))  # copies in proportion to the text, not to the partitions
    for high in ROUNDS:
        shared = spark.sparkContext.broadcast((vocabulary, params, common))
        share = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
        part = few.filter((share >= low) & (share < high))

        def learn(it: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            vocabulary, params, common = shared.value
            trainer, total = Trainer(params), 0
            for _, hashes, owner, _ in texts_of(it):
                entry = vocabulary.entries(hashes)
                near = around(entry, owner, END)
                for i in range(0, len(entry), STEP):
                    trainer.step(near[:, i : i + STEP], entry[i : i + STEP])
                total += len(entry)
                if len(common):
                    window = windows(hashes, owner)
                    at, _ = _found(common, window)
                    for level, names in ((0, window[at]), (1, whole(window[at], hashes[at]))):
                        name, n = np.unique(names, return_counts=True)
                        yield pd.DataFrame({"part": -1 - level, "task": 0, "weight": n.astype(float), "values": None, "name": name.view(np.int64)})
            if total:
                task = TaskContext.get().partitionId()
                for i, x in enumerate(np.array_split(_flat(trainer.p), 16)):
                    yield pd.DataFrame({"part": [i], "task": [task], "weight": [float(total)], "values": [x.tobytes()], "name": [0]})

        told = saved(part.mapInPandas(learn, "part int, task int, weight double, values binary, name long"))
        mean = _averaged(told.filter("part >= 0").select("part", "task", "weight", "values"))
        params = params if mean is None else _shaped(mean, params)
        counts.append(told.filter("part < 0").groupBy("part", "name").agg(F.sum("weight").alias("n")))
        low = high
    every = counts[0]
    for more in counts[1:]:
        every = every.union(more)
    # windows of the bounded table; with their words only what may matter
    rows = every.groupBy("part", "name").agg(F.sum("n").alias("n")).filter("part = -1 or n > 1").toPandas() if len(common) else pd.DataFrame({"part": [], "name": [], "n": []})
    tables = [rows[rows["part"] == k].sort_values("name")[["name", "n"]].to_numpy(np.int64).T.reshape(2, -1) for k in (-1, -2)]
    return params, tables[0], tables[1]


def counted(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often each word (kind 0) and each common window (kind 1) occurs; words are added up over batches before they leave."""
    some, held = [], 0

    def summed() -> pd.DataFrame:
        name, which = np.unique(np.concatenate([x for x, _ in some]), return_inverse=True)
        n = np.bincount(which, weights=np.concatenate([n for _, n in some])).astype(np.int64)
        return pd.DataFrame({"kind": 0, "name": name.view(np.int64), "n": n})

    for _, hashes, owner, _ in texts_of(it):
        some.append(np.unique(hashes, return_counts=True))
        held += len(some[-1][0])
        if held > HELD:
            yield summed()
            some, held = [], 0
        name, n = np.unique(windows(hashes, owner), return_counts=True)
        many = n >= COMMON
        if many.any():
            yield pd.DataFrame({"kind": 1, "name": name[many].view(np.int64), "n": n[many]})
    if some:
        yield summed()


def learn(docs: DataFrame) -> tuple[Vocabulary, Params, np.ndarray, np.ndarray]:
    """Vocabulary, network, and counts of common windows: three passes over all documents."""
    seen = saved(docs.select("text").mapInPandas(counted, "kind int, name long, n long").groupBy("kind", "name").agg(F.sum("n").alias("n")))
    top = seen.filter("kind = 0").orderBy(F.desc("n"), "name").limit(SIZE - HASHED).toPandas()
    names = top["name"].to_numpy(np.int64)
    common = seen.filter("kind = 1").orderBy(F.desc("n"), "name").limit(MOST_COMMON).toPandas()["name"].to_numpy(np.int64)
    vocabulary = Vocabulary(names.view(np.uint64), np.zeros(SIZE, np.float32))
    # counts of hashed entries and of the different words in them
    entry = F.lit(SIZE - HASHED) + F.pmod(F.shiftrightunsigned("name", 40), F.lit(HASHED - 1))
    least = int(top["n"].min()) if len(top) else 0
    rest = seen.filter((F.col("kind") == 0) & (F.col("n") <= least)).groupBy(entry.alias("entry")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).toPandas()
    counts, kinds = np.zeros(SIZE), np.ones(SIZE)
    counts[: len(top)] = top["n"].to_numpy()
    counts[rest["entry"].to_numpy(np.int64)] = rest["n"].to_numpy()
    kinds[rest["entry"].to_numpy(np.int64)] = rest["words"].to_numpy()
    vocabulary.share = -np.log(kinds).astype(np.float32)
    params, near, full = trained(docs, vocabulary, start(counts), np.sort(common.view(np.uint64)))
    return vocabulary, params, near, full


def _found(table: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which names are in the sorted table, and where. Most aren't: their first 20 bits tell."""
    first = lambda x: (x.view(np.uint64) >> np.uint64(44)).view(np.int64)
    seen = np.zeros(1 << 20, bool)
    seen[first(table)] = True
    some = np.flatnonzero(seen[first(names)])
    at = np.searchsorted(table, names[some])
    hit = np.flatnonzero(np.append(table, table[-1:])[at] == names[some])
    return some[hit], at[hit]


def _looked_up(table: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Counts of names in a table of (name, count), 0 where a name isn't there."""
    out = np.zeros(len(names), np.int64)
    which, at = _found(np.ascontiguousarray(table[0]), names)
    out[which] = table[1][at]
    return out


def blended(logp: np.ndarray, around_: np.ndarray, with_word: np.ndarray) -> np.ndarray:
    """Log-probability from the network's, the other occurrences of the surrounding words, and those with the word."""
    return np.log((with_word + STRENGTH * np.exp(logp)) / (around_ + STRENGTH))


def score(docs: DataFrame, model: tuple[Vocabulary, Params, np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """doc_id, n_tokens, log_prob (the sum) and mean_log_prob (null without tokens) for every row of ``docs``.

    Null, empty and blank texts have no tokens and log_prob 0. Equal texts score alike. Whole texts of any length count.
    Repeated rows are rows of their own, and occurrences of their words. Empty tables give no rows; other columns are
    ignored. Windows are counted over ``docs`` also where a model is given.
    """
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs) if model is None else model)  # about 3 MB, and the common windows
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET))
    columns = ["bucket", "doc_id", "batch", "row", "n", "value", "windows", "words", "logs", "rows", "counts"]

    def deal(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, params, near, full = shared.value
        for rows, hashes, owner, raws in texts_of(it):
            entry = vocabulary.entries(hashes)
            sides = around(entry, owner, END)
            logp = forward(params, sides, entry) + vocabulary.share[entry]
            window = windows(hashes, owner)
            known = _looked_up(near, window.view(np.int64))
            at, best = np.flatnonzero(known), logp.astype(np.float64)
            with_word = _looked_up(full, whole(window[at], hashes[at]).view(np.int64))
            best[at] = blended(logp[at], np.maximum(known[at] - 1, 0), np.maximum(with_word - 1, 0))
            n = np.bincount(owner, minlength=len(raws))
            total = np.bincount(owner, weights=best, minlength=len(raws))
            ids = rows["doc_id"].tolist()
            batch = int.from_bytes(hashlib.blake2b(repr(ids).encode() + b"\0".join(raws), digest_size=8).digest(), "little", signed=True)
            out = pd.DataFrame({c: None for c in columns}, index=range(len(ids)))
            out["bucket"] = -1 - abs(batch % buckets)
            out["doc_id"], out["batch"], out["row"], out["n"], out["value"] = ids, batch, np.arange(len(ids)), n, total
            yield out
            rest = np.flatnonzero(known == 0)
            to = (window[rest] % np.uint64(buckets)).astype(np.int16 if buckets < 1 << 15 else np.int64)
            order = np.argsort(to, kind="stable")
            rest, to = rest[order], to[order]
            inner = ((window[rest] // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)).astype("<u4")
            word = (hashes[rest] >> np.uint64(48)).astype("<u2")
            logs = logp[rest].astype("<f2")
            cuts = np.searchsorted(to, np.arange(buckets + 1))
            dealt = []
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                i, j = cuts[b], cuts[b + 1]
                own = owner[rest[i:j]]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                dealt.append((b, None, batch, None, None, None, inner[i:j].tobytes(), word[i:j].tobytes(), logs[i:j].tobytes(), np.diff(own[first], prepend=0).astype("<u4").tobytes(), np.diff(np.append(first, j - i)).astype("<u4").tobytes()))
            yield pd.DataFrame(dealt, columns=columns)

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        if int(pdf["bucket"].iloc[0]) < 0:
            return pdf[["doc_id", "batch", "row", "n", "value"]]
        join = lambda c, kind: np.frombuffer(b"".join(pdf[c]), kind)
        rows = [np.cumsum(np.frombuffer(x, "<u4"), dtype=np.int64) for x in pdf["rows"]]
        nth = np.repeat(np.arange(len(rows)), [len(x) for x in rows])  # the batch of each row
        own = np.repeat((nth << 32) | np.concatenate(rows), join("counts", "<u4"))
        name = (join("windows", "<u4").astype(np.uint64) << np.uint64(32)) | join("words", "<u2")
        order = np.argsort(name)
        name = name[order]
        head = name >> np.uint64(32)
        starts = np.flatnonzero(np.append(True, head[1:] != head[:-1])) if len(name) else np.zeros(0, np.int64)
        count = np.diff(np.append(starts, len(name)))
        many = np.repeat(count > 1, count)
        n4 = np.repeat(count, count)[many]
        name, order = name[many], order[many]
        starts = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else np.zeros(0, np.int64)
        count = np.diff(np.append(starts, len(name)))
        n5 = np.repeat(count, count)
        logp = join("logs", "<f2").astype(np.float64)[order]
        more = blended(logp, n4 - 1, n5 - 1) - logp
        row, which = np.unique(own[order], return_inverse=True)
        return pd.DataFrame({"doc_id": None, "batch": pdf["batch"].to_numpy()[row >> 32], "row": row & 0xFFFFFFFF, "n": None, "value": np.bincount(which, weights=more, minlength=len(row))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.mapInPandas(deal, f"bucket long, doc_id {kind}, batch long, row long, n long, value double, windows binary, words binary, logs binary, rows binary, counts binary")
    told = saved(dealt.groupBy("bucket").applyInPandas(find, f"doc_id {kind}, batch long, row long, n long, value double"))
    # batches of the same rows have one name: each has a share of what was found for both
    more = told.groupBy("batch", "row").agg((F.sum(F.when(F.col("n").isNull(), F.col("value"))) / F.count("n")).alias("more"))
    out = told.filter("n is not null").join(more, ["batch", "row"], "left")
    total = F.col("value") + F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", F.col("n").alias("n_tokens"), total.alias("log_prob"), F.try_divide(total, "n").alias("mean_log_prob"))
