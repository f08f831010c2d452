"""Removal of repeated passages: byte strings of a minimum length that also start in an earlier document.

Texts stay where they are; only what may repeat is brought together:

1. Every ``LEAST``-byte window has a seed, its smallest hash of ``SEED`` bytes. Equal windows have equal seeds. Each batch
   of texts deals each of its seeds once, however often it holds it, to the seed's bucket, and learns which seeds occur
   in two or more documents.
2. A stretch of windows with one shared seed is a body. Documents are grouped by hash; each group deals its different
   bodies, with the smallest document of each, to the seed's bucket.
3. A bucket's bodies, equal ones as one, are indexed by a suffix array and its Burrows-Wheeler transform. Breadth first,
   all intervals of suffixes that share ``l`` bytes are extended by one byte to the left, which fixes the common prefixes
   of length ``l`` before those of ``l + 1``; it stops at ``LEAST``. What is then still together shares a window, and the
   smallest document of an interval goes back to the groups, which cut their texts.

A seed, text or passage that very many documents share is one row for each batch or group, not for each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.common import saved

#: Bytes that a repeat has at least, and bytes hashed to a seed.
LEAST, SEED = 50, 28
#: Parts that rows of one text are dealt to.
SALTS = 32
#: Bytes of text for a bucket or group, about; buckets at least; bytes of texts in a batch; bytes of bodies in an index; bytes hashed at once.
BUCKET, LEAST_BUCKETS, BATCH, INDEX, HASHED = 8_000_000, 64, 4_000_000, 100_000, 200_000


def stretches(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seed, text, first window, windows) of each stretch of windows of one text that have one seed."""
    found = []
    for at, part in _parted(raws, HASHED):
        seed, text, begin, count = _stretches(part)
        found.append((seed, text + at, begin, count))
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else [()] * 4))


def _parted(raws: list[bytes], most: int) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts), in parts of at most ``most`` bytes or one text."""
    at, size = 0, 0
    for i, raw in enumerate(raws):
        if i > at and size + len(raw) > most:
            yield at, raws[at:i]
            at, size = i, 0
        size += len(raw)
    if raws:
        yield at, raws[at:]


def _stretches(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    lens = np.array([len(r) for r in raws], np.int64)
    flat = np.frombuffer(b"".join(raws), np.uint8)
    n = len(flat)
    if n < LEAST:
        return none, none, none, none
    p, q = W.powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * p[:n], out=sums[1:])
    low = W.mixed((sums[SEED:] - sums[:-SEED]) * q[: n - SEED + 1])
    del sums
    width, step = LEAST - SEED + 1, 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if width > step:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    ends = np.cumsum(lens)
    starts = ends - lens
    long = lens >= LEAST
    edge = np.zeros(n + 1, np.int8)
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - LEAST + 1, -1)
    inside = np.cumsum(edge, dtype=np.int8)[: len(low)] > 0
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (inside[1:] != inside[:-1])
    new[starts[starts < len(low)]] = True
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(low)))
    use = inside[begin]
    begin, count = begin[use], count[use]
    text = np.searchsorted(ends, begin, side="right")
    return low[begin].view(np.int64), text, begin - starts[text], count


def _home(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (W.mixed(ids.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _parts(to: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices that go to it), for buckets that get any."""
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, order[cuts[b] : cuts[b + 1]]


def _lean(ids: np.ndarray) -> bytes:
    """Whole numbers in four bytes each, as distances from the smallest, where that is enough, else in eight."""
    base = int(ids.min()) if len(ids) else 0
    if len(ids) and int(ids.max()) - base < 1 << 32:
        return b"4" + base.to_bytes(8, "little", signed=True) + (ids - base).astype("<u4").tobytes()
    return b"8" + np.ascontiguousarray(ids, np.int64).tobytes()


def _wide(cell: bytes) -> np.ndarray:
    if cell[:1] == b"4":
        return np.frombuffer(cell, "<u4", offset=9).astype(np.int64) + int.from_bytes(cell[1:9], "little", signed=True)
    return np.frombuffer(cell[1:], np.int64)


def _joined(column: pd.Series) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[_wide(x) for x in column if x is not None]])


def _short(seed: np.ndarray, buckets: int) -> np.ndarray:
    """Seeds as bucket * 2 ** 32 and 32 further bits: seeds of a bucket that agree in these only mean a body more."""
    own = seed.view(np.uint64)
    return (((own % np.uint64(buckets)) << np.uint64(32)) | ((own // np.uint64(buckets)) & np.uint64(0xFFFFFFFF))).view(np.int64)


def _grouped(docs: DataFrame, buckets: int) -> DataFrame:
    @F.pandas_udf("int")
    def home(ids: pd.Series) -> pd.Series:
        return pd.Series(_home(ids.to_numpy(), buckets).astype(np.int32))

    return docs.select("doc_id", "text", home("doc_id").alias("home"))


def seeds(docs: DataFrame, buckets: int) -> DataFrame:
    """Seeds by bucket (with a document of the batch), and, at -1 - group, seeds already known to be shared."""

    def told(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            ids = batch["doc_id"].to_numpy(np.int64)
            for at, raws in W.batches(batch["text"].tolist(), BATCH):
                first: dict[bytes, int] = {}
                for i, raw in enumerate(raws):  # of equal texts, the smallest document
                    if len(raw) >= LEAST and ((j := first.get(raw)) is None or ids[at + i] < ids[at + j]):
                        first[raw] = i
                mine = np.array(list(first.values()), np.int64)
                seed, text, _, _ = stretches(list(first))
                if not len(seed):
                    continue
                seed = _short(seed, buckets)
                doc = ids[at + mine[text]]
                order = np.lexsort((doc, seed))
                seed, doc = seed[order], doc[order]
                new = np.ones(len(seed), bool)
                new[1:] = (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])
                seed, doc = seed[new], doc[new]
                head = np.ones(len(seed), bool)
                head[1:] = seed[1:] != seed[:-1]
                both = ~head | ~np.append(head[1:], True)
                rows = []
                one, own = seed[head], doc[head]
                for b, o in _parts(one >> 32, buckets):
                    o = o[np.argsort(own[o], kind="stable")]  # documents in order take less room
                    rows.append((b, _lean(one[o]), _lean(own[o])))
                rows += [(-1 - b, _lean(seed[both][o]), _lean(doc[both][o])) for b, o in _parts(_home(doc[both], buckets), buckets)]
                yield pd.DataFrame(rows, columns=["bucket", "seeds", "docs"])

    return docs.select("doc_id", "text").mapInPandas(told, "bucket int, seeds binary, docs binary")


def shared(dealt: DataFrame, buckets: int) -> DataFrame:
    """By group of documents: seeds that two or more documents have, with a document that has them."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, seed, doc = int(pdf["bucket"].iloc[0]), _joined(pdf["seeds"]), _joined(pdf["docs"])
        if bucket < 0:
            return pd.DataFrame([(-1 - bucket, _lean(seed), _lean(doc))], columns=["home", "seeds", "docs"])
        order = np.argsort(seed)
        seed, doc = seed[order], doc[order]
        starts = np.flatnonzero(np.append(True, seed[1:] != seed[:-1]))
        counts = np.diff(np.append(starts, len(seed)))
        many = np.repeat(np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts), counts)
        seed, doc = seed[many], doc[many]
        return pd.DataFrame([(b, _lean(seed[o]), _lean(doc[o])) for b, o in _parts(_home(doc, buckets), buckets)], columns=["home", "seeds", "docs"])

    return dealt.groupBy("bucket").applyInPandas(find, "home int, seeds binary, docs binary")


class Group:
    """The texts of a group that have shared seeds, their stretches with such a seed, and their different bodies."""

    def __init__(self, texts: pd.DataFrame, seed: np.ndarray, doc: np.ndarray, buckets: int):
        known = set(np.unique(doc).tolist())
        rows = sorted({(int(k), (t or "").encode("utf-8", "replace")) for k, t in zip(texts["doc_id"], texts["text"], strict=True) if int(k) in known})
        self.ids = np.array([k for k, _ in rows], np.int64)
        self.raws = [raw for _, raw in rows]
        order = np.lexsort((seed, doc))
        pairs = W.mixed(seed[order].view(np.uint64)) ^ W.mixed(doc[order].view(np.uint64) + np.uint64(1))
        pairs = np.unique(pairs)  # a false pair only means a body more
        found: list[list[np.ndarray]] = [[], [], [], []]
        for at, part in _parted(self.raws, BATCH):
            s, t, b, n = stretches(part)
            s = _short(s, buckets)
            held = np.isin(W.mixed(s.view(np.uint64)) ^ W.mixed(self.ids[at + t].view(np.uint64) + np.uint64(1)), pairs) if len(s) else np.zeros(0, bool)
            for column, x in zip(found, (s, t + at, b, n), strict=True):
                column.append(x[held])
        self.seed, self.text, self.begin, self.count = [np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in found]
        self.bodies: dict[bytes, int] = {}
        which = [self.bodies.setdefault(self.raws[t][b : b + n + LEAST - 1], len(self.bodies)) for t, b, n in zip(self.text.tolist(), self.begin.tolist(), self.count.tolist(), strict=True)]
        self.which = np.array(which, np.int64)

    def dealt(self) -> tuple[np.ndarray, np.ndarray]:
        """The seed and the smallest document of each body."""
        seed, low = np.zeros(len(self.bodies), np.int64), np.full(len(self.bodies), np.iinfo(np.int64).max)
        seed[self.which] = self.seed
        np.minimum.at(low, self.which, self.ids[self.text])
        return seed, low

    def cut(self, body: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray) -> list[tuple]:
        """doc_id, hash of the text, n_removed, n_spans, kept_sha256, from runs of windows of bodies (start to end) and
        the smallest document that has them."""
        order = np.argsort(body, kind="stable")
        body, start, end, low = body[order], start[order], end[order], low[order]
        first, last = np.searchsorted(body, self.which), np.searchsorted(body, self.which, side="right")
        n = last - first
        run = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        text = np.repeat(self.text, n)
        use = low[run] < self.ids[text]
        text, run, shift = text[use], run[use], np.repeat(self.begin, n)[use]
        begin, stop = shift + start[run], shift + end[run] + LEAST - 1
        out = []
        order = np.lexsort((begin, text))
        text, begin, stop = text[order], begin[order], stop[order]
        cuts = np.searchsorted(text, np.arange(len(self.raws) + 1))
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            raw, at, kept, removed, spans = self.raws[i], 0, [], 0, 0
            for b, e in zip(begin[cuts[i] : cuts[i + 1]].tolist(), stop[cuts[i] : cuts[i + 1]].tolist(), strict=True):
                if spans and b <= at:
                    removed += max(0, e - at)
                    at = max(at, e)
                else:
                    kept.append(raw[at:b])
                    removed, spans, at = removed + e - b, spans + 1, e
            kept.append(raw[at:])
            rest = b"".join(kept)
            out.append((int(self.ids[i]), hashlib.sha256(raw).hexdigest(), removed, spans, hashlib.sha256(rest).hexdigest(), rest))
        return out


def suffixes(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, text) of bodies joined by zeros, which count as different; sorted by more than LEAST bytes."""
    text = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    n = len(text)
    ends = np.cumsum([len(b) + 1 for b in bodies]) - 1
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # bytes before the body's end
    key = np.zeros(n, np.int64)
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(7, np.int64)])
    for i in range(7):
        key = key * 257 + np.where(left > i, padded[i : n + i], 0)
    depth = 7
    while True:
        order = np.argsort(key)  # equal keys in any order: they reach their bodies' ends, or share LEAST bytes
        ordered = key[order]
        new = np.append(True, ordered[1:] != ordered[:-1])
        new |= left[order] < depth  # reaches its body's end: like no other
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if depth >= LEAST:
            return order, text
        key = rank * (n + 1) + np.where(left >= depth, rank[np.minimum(np.arange(n) + depth, n - 1)], 0)
        depth *= 2


def together(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(interval by rank, rank by position) of all suffixes: one interval for those that share LEAST bytes.

    Breadth first over intervals of the suffix array: those of all strings of ``l`` bytes that were new at their level
    are extended to the left by every byte that the transform holds in them, each by the first and the last place where
    it stands there (last-to-first mapping). The end of an extended interval that no shorter string has set is where two
    neighbours share just ``l`` bytes; so common prefixes come by increasing value, and intervals that bring no new end
    aren't followed. At LEAST it stops: neighbours without an end between them share more.
    """
    order, text = suffixes(bodies)
    n = len(order)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    symbol = text.astype(np.int16) + 1
    symbol[np.cumsum([len(b) + 1 for b in bodies]) - 1] = 0  # ends of bodies, each unlike all others
    bwt = symbol[order - 1]
    sorted_ = np.argsort(bwt, kind="stable")
    to = np.empty(n, np.int64)  # C[c] + Occ(c, place)
    to[sorted_] = np.arange(n)
    same = bwt[sorted_[1:]] == bwt[sorted_[:-1]]
    after, before = np.full(n, n), np.full(n, -1)  # the next and the last place of the same byte in the transform
    after[sorted_[:-1][same]] = sorted_[1:][same]
    before[sorted_[1:][same]] = sorted_[:-1][same]
    inner = bwt > 0
    parted = np.zeros(n + 1, bool)
    parted[[0, n]] = True
    lb, rb = np.zeros(1, np.int64), np.full(1, n - 1)
    for level in range(LEAST):
        size = rb - lb + 1
        which = np.repeat(np.arange(len(lb)), size)
        at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + lb[which]
        keep = inner[at]
        at, which = at[keep], which[keep]
        first, last = np.sort(to[at[before[at] < lb[which]]]), np.sort(to[at[after[at] > rb[which]]])
        if not level:  # the ends of bodies are intervals of one suffix each
            first, last = np.append(np.arange(len(bodies)), first), np.append(np.arange(len(bodies)), last)
        new = ~parted[last + 1]
        parted[last + 1] = True
        lb, rb = first[new], last[new]
        if not len(lb):
            break
    return np.cumsum(parted[:n]) - 1, rank


def smallest(bodies: list[bytes], low: np.ndarray) -> list[np.ndarray]:
    """For each body and each of its windows, the smallest document (``low`` by body) that has the window."""
    interval, rank = together(bodies)
    lens = np.array([len(b) for b in bodies])
    starts = np.cumsum(lens + 1) - (lens + 1)
    counts = lens - LEAST + 1
    which = np.repeat(np.arange(len(bodies)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + starts[which]
    own = interval[rank[at]]
    best = np.full(int(interval[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(best, own, low[which])
    return np.split(best[own], np.cumsum(counts)[:-1])


def _by_seed(order: np.ndarray, kind: np.ndarray, bodies: list[bytes]) -> Iterator[list[int]]:
    """``order`` (bodies sorted by seed) in parts of about INDEX bytes. Bodies of one seed stay together: only they can
    share a window."""
    part, size = [], 0
    for i in order.tolist():
        if size > INDEX and kind[i] != kind[part[-1]]:
            yield part
            part, size = [], 0
        part.append(i)
        size += len(bodies[i])
    if part:
        yield part


def answers(bodies: DataFrame) -> DataFrame:
    """By group: runs of windows of its bodies, with the smallest document that has them."""

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        grow = zstandard.ZstdDecompressor().decompress
        text = [grow(x) for x in pdf["bodies"]]
        home = np.repeat(pdf["home"].to_numpy(), [len(_wide(x)) for x in pdf["lens"]])
        at, low, lens, seed = _joined(pdf["at"]), _joined(pdf["low"]), _joined(pdf["lens"]), _joined(pdf["seeds"])
        names: dict[bytes, int] = {}
        flat, ends = b"".join(text), np.cumsum(lens)
        which = np.array([names.setdefault(flat[e - n : e], len(names)) for e, n in zip(ends.tolist(), lens.tolist(), strict=True)], np.int64)
        every = list(names)
        least = np.full(len(every), np.iinfo(np.int64).max)
        np.minimum.at(least, which, low)
        kind = np.zeros(len(every), np.int64)
        kind[which] = seed
        order = np.argsort(kind, kind="stable")
        alone = np.ones(len(every), bool)  # the one body of its seed has nothing to be compared with
        same = kind[order][1:] == kind[order][:-1]
        alone[order[1:][same]] = alone[order[:-1][same]] = False
        rows_at, start, end, best = [], [], [], []
        found: dict[int, np.ndarray] = {}
        for part in _by_seed(order[~alone[order]], kind, every):
            found.update(zip(part, smallest([every[i] for i in part], least[part]), strict=True))
        for i, raw in enumerate(every):
            if alone[i]:
                cuts, value = [0, len(raw) - LEAST + 1], [int(least[i])]
            else:
                w = found[i]
                edge = np.flatnonzero(w[1:] != w[:-1]) + 1
                cuts, value = [0, *edge.tolist(), len(w)], w[np.append(0, edge)].tolist()
            start += cuts[:-1]
            end += cuts[1:]
            best += value
            rows_at.append(len(value))
        n = np.array(rows_at, np.int64)
        base = np.cumsum(n) - n
        start, end, best = np.array(start, np.int64), np.array(end, np.int64), np.array(best, np.int64)
        rows = []
        for h in np.unique(home).tolist():
            own = np.flatnonzero(home == h)
            k = n[which[own]]
            run = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(base[which[own]], k)
            rows.append((h, _lean(np.repeat(at[own], k)), _lean(start[run]), _lean(end[run]), _lean(best[run])))
        return pd.DataFrame(rows, columns=["home", "at", "start", "end", "low"])

    return bodies.groupBy("bucket").applyInPandas(answer, "home int, at binary, start binary, end binary, low binary")


def spans(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, sha, n_removed, n_spans, kept_sha256 (and the kept text) of documents that share a window with an
    earlier one; of documents with equal texts perhaps only some. Rows without a doc_id take no part."""
    docs = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET))
    known = saved(shared(seeds(docs, buckets), buckets))
    texts = _grouped(docs.filter(F.octet_length("text") >= LEAST), buckets)

    def deal(own: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        names = ["bucket", "home", "at", "seeds", "low", "lens", "bodies"]
        if not len(own) or not len(keys):
            return pd.DataFrame([], columns=names)
        group = Group(own, _joined(keys["seeds"]), _joined(keys["docs"]), buckets)
        seed, low = group.dealt()
        every = list(group.bodies)
        rows = []
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b, o in _parts(seed >> 32, buckets):
            part = [every[i] for i in o.tolist()]
            rows.append((b, int(own["home"].iloc[0]), _lean(o), _lean(seed[o]), _lean(low[o]), _lean(np.array([len(x) for x in part])), squeeze(b"".join(part))))
        return pd.DataFrame(rows, columns=names)

    bodies = texts.groupBy("home").cogroup(known.groupBy("home")).applyInPandas(deal, "bucket int, home int, at binary, seeds binary, low binary, lens binary, bodies binary")
    told = answers(bodies)
    both = known.select("home", "seeds", "docs", *[F.lit(None).cast("binary").alias(c) for c in ("at", "start", "end", "low")]).unionByName(told.select("home", *[F.lit(None).cast("binary").alias(c) for c in ("seeds", "docs")], "at", "start", "end", "low"))

    def cut(own: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "sha", "n_removed", "n_spans", "kept_sha256", "kept"]
        if not len(own) or not len(rest):
            return pd.DataFrame([], columns=names)
        group = Group(own, _joined(rest["seeds"]), _joined(rest["docs"]), buckets)
        rows = group.cut(*[_joined(rest[c]) for c in ("at", "start", "end", "low")])
        return pd.DataFrame([(*r[:5], r[5].decode("utf-8", "replace") if keep_text else None) for r in rows], columns=names)

    return texts.groupBy("home").cogroup(both.groupBy("home")).applyInPandas(cut, "doc_id long, sha string, n_removed long, n_spans long, kept_sha256 string, kept string")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of ``docs``.

    Null texts are empty; texts of fewer than LEAST bytes lose nothing. A later document with the text of an earlier one
    loses all of it. Repeated rows of one doc_id don't count as earlier than each other. Rows without a doc_id are neither
    earlier nor later than any other. Ids are whole numbers. Empty tables give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = saved(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha")))
    first = slim.filter("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    found = spans(docs).drop("kept").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType), "sha", "n_removed", "n_spans", "kept_sha256")
    # very many documents may have one text: rows are dealt by its hash and a number, over which its first document is spread
    first = first.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = slim.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(first, ["sha", "_salt"], "left").join(found, ["doc_id", "sha"], "left")
    copy = (F.col("doc_id") > F.col("_first")) & (F.col("n_bytes") >= LEAST)
    value = lambda name, all_, none: F.when(copy, all_).otherwise(F.coalesce(F.col(name), none)).alias(name)
    return rows.select("doc_id", "n_bytes", value("n_removed", F.col("n_bytes"), F.lit(0)), value("n_spans", F.lit(1), F.lit(0)), value("kept_sha256", F.sha2(F.lit(""), 256), F.col("sha")))
