"""Best-fit packing of token sequences by bin completion.

Documents are cut and counted where they lie; only the histogram of piece lengths, at most ``capacity`` rows, goes to
the driver. There a branch-and-bound over bins works on the counts: the largest piece left opens a bin, the
undominated fillings around it are enumerated, best-fit solutions are the incumbents, and bounds on the waste prune.
The plan says how many bins take which lengths; each piece finds its place in it by its rank among equal lengths.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.common import arrow_rows, running, saved

CAPACITY = 4096
#: Bytes of text whose words are coded at once (a worker holds some 70 bytes for each), and rows sent to a worker at once.
BATCH, ROWS = 500_000, 2000
#: Unusual words whose ids a worker remembers before it starts anew, the id that ends a document, and no merge.
REMEMBERED, END, NONE = 50_000, 1, 1 << 30
#: For each byte: 1 for ASCII letters, 2 for the marks that may follow them, 0 else.
KIND = np.zeros(256, np.int8)
KIND[[*range(65, 91), *range(97, 123)]] = 1
KIND[list(b".,;:!?")] = 2
#: Branches after which the rest is packed by best fit for a new incumbent (at each of the first so many, and at every end).
TRIED = 64
#: Pieces that fillings of a bin are enumerated around, and bins branched on, at most, before best fit fills the rest.
FILLINGS, BRANCHES = 24, 4000


class WordIds:
    """Ids of texts, word by word: the vocabulary's rules drop white space, so each different word of a batch is coded once.

    Plain words (Latin letters, then marks) are most of all words. Their merges are applied to all of them at once, in
    numpy, by the vocabulary's own table of merges. All other words go through the whole tokenizer.
    """

    LONGEST = 64

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # each core has a task of its own; threads would only add memory
        self.coder = Tokenizer.from_file(path)
        self.coder.no_truncation()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        shown = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.inner, self.final = np.zeros(256, np.int32), np.zeros(256, np.int32)  # a byte's symbol in a word, and at its end
        for i in (*range(33, 127), *range(0x80, 0xC0), 0xC3):  # as the vocabulary writes that byte
            mark = shown(chr(i))[0][0][0 if i == 0xC3 else -1]
            self.inner[i], self.final[i] = vocab[mark], vocab[mark + end]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        key = np.array([(vocab[a] << 20) + vocab[b] for a, b in pairs], np.int64)
        into = np.array([vocab[a + b] for a, b in pairs], np.int32)
        bits = 19
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, np.int32)  # merge by hash of its pair; pairs that share a slot follow one another
        self.keys, self.into = key, into
        self.steps = 0
        left, at = np.arange(len(key)), self._slot(key)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) % len(self.slots)
            self.steps += 1
        self.other: dict[bytes, np.ndarray] = {}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _rank(self, key: np.ndarray) -> np.ndarray:
        """The merge of each pair of symbols, or NONE."""
        at = self._slot(key)
        out = np.full(len(key), NONE, np.int64)
        todo = np.arange(len(key))
        for _ in range(self.steps):
            found = self.slots[at[todo]]
            todo, found = todo[found >= 0], found[found >= 0]
            hit = self.keys[found] == key[todo]
            out[todo[hit]] = found[hit]
            todo = todo[~hit]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) % len(self.slots)
        return out

    def merged(self, symbols: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each word) after all merges; ``symbols`` of words of ``lens`` symbols, one after another.

        Each round makes, in every word that has one, the merge that comes first in the table, the leftmost if it's there
        twice; words without one are done.
        """
        which = np.arange(len(lens))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(lens) - 1] = True
        rank = np.full(len(symbols), NONE, np.int64)
        fresh = np.flatnonzero(~last)  # symbols whose pair with the next one isn't ranked yet
        while len(which):
            rank[fresh] = self._rank((symbols[fresh].astype(np.int64) << 20) + symbols[fresh + 1])
            best = np.minimum.reduceat((rank << 32) + np.arange(len(symbols)), np.cumsum(lens) - lens)
            more = (best >> 32) < NONE
            own = np.repeat(more, lens)
            if not more.all():
                out.append((which[~more], symbols[~own], lens[~more]))
            at = best[more] & 0xFFFFFFFF
            symbols[at] = self.into[best[more] >> 32]
            rank[at], last[at] = NONE, last[at + 1]
            own[at + 1] = False
            at = np.cumsum(own, dtype=np.int32)[at] - 1
            symbols, rank, last, lens, which = symbols[own], rank[own], last[own], lens[more] - 1, which[more]
            near = np.concatenate([at, at[at > 0] - 1])  # what was made meets new neighbours
            fresh = near[~last[near]]
        which = np.concatenate([x[0] for x in out])
        flat, lens = np.concatenate([x[1] for x in out]), np.concatenate([x[2] for x in out])
        order = np.argsort(which)
        return _gathered(flat, (np.cumsum(lens) - lens)[order], lens[order]), lens[order]

    @staticmethod
    def _letters(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(kind of each byte, bytes in lower case); letters of two bytes are those from U+00C0 to U+00FF."""
        kind, low = KIND[flat], W.LOWER[flat]
        second = np.flatnonzero(flat[:-1] == 0xC3) + 1
        byte = flat[second]
        letter = (byte >= 0x80) & (byte <= 0xBF) & (byte != 0x97) & (byte != 0xB7)
        kind[second[letter]] = kind[second[letter] - 1] = 1
        low[second[letter & (byte <= 0x9E)]] += 32
        return kind, low

    def distinct(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each word) of words given by place."""
        kind, low = self._letters(flat)
        letters, known = np.zeros((2, len(flat) + 1), np.int32)
        np.cumsum(kind == 1, out=letters[1:])
        np.cumsum(kind > 0, out=known[1:])
        end = begin + size
        head = letters[end] - letters[begin]  # letters of the word: all in front, if that many bytes in front are letters
        plain = (known[end] - known[begin] == size) & (letters[begin + head] - letters[begin] == head) & (head > 0) & (size <= self.LONGEST)
        b, n = begin[plain], size[plain]
        parts = np.stack([head[plain], n - head[plain]], axis=1).reshape(-1).astype(np.int64)  # letters, and marks, are words of their own to the vocabulary
        ends = np.cumsum(parts) - 1
        raw = _gathered(low, b, n)
        symbols = self.inner[raw]
        full = parts > 0
        symbols[ends[full]] = self.final[raw[ends[full]]]
        ids, sizes = self.merged(symbols, parts[full]) if len(raw) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        lens = np.zeros(len(parts), np.int64)
        lens[full] = sizes
        own = lens.reshape(-1, 2).sum(axis=1)
        rest = np.flatnonzero(~plain)
        text = flat.tobytes()
        words = [text[i : i + k] for i, k in zip(begin[rest].tolist(), size[rest].tolist(), strict=True)]
        known = self.other if len(self.other) < REMEMBERED else self.other.clear() or self.other
        new = [w for w in words if w not in known]
        for i in range(0, len(new), 5000):
            part = new[i : i + 5000]
            for w, code in zip(part, self.coder.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                known[w] = np.array(code.ids, np.int32)
        others = [known[w] for w in words]
        every = np.concatenate([ids, *others, np.zeros(0, np.int32)])
        k = np.zeros(len(begin), np.int64)
        k[plain], k[rest] = own, [len(x) for x in others]
        order = np.concatenate([np.flatnonzero(plain), rest])
        start = np.empty(len(begin), np.int64)
        start[order] = np.cumsum(k[order]) - k[order]
        return _gathered(every, start, k), k

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text and END, as little-endian unsigned 32-bit numbers."""
        raws = [(t or "").encode("utf-8", "replace") for t in texts]
        hashes, owner, flat, begin, size = W.words(raws, places=True)
        _, rep, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(hashes):  # words of one hash are one word, by their bytes; else each counts by itself
            same = size == size[rep[which]]
            i, j = _places(begin[same], size[same]), _places(begin[rep[which[same]]], size[same])
            if not same.all() or (flat[i] != flat[j]).any():
                rep, which = np.arange(len(hashes)), np.arange(len(hashes))
        ids, k = self.distinct(flat, begin[rep], size[rep])
        n = k[which]
        counts = np.bincount(owner, weights=n, minlength=len(texts)).astype(np.int64)
        ends = np.cumsum(counts + 1)
        out = np.full(int(ends[-1]) if len(ends) else 0, END, "<u4")
        body = np.ones(len(out), bool)
        body[ends - 1] = False
        out[body] = _gathered(ids, (np.cumsum(k) - k)[which], n)
        raw = out.tobytes()
        return [raw[4 * (e - c - 1) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]


def _places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each run of ``size`` places."""
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


def _gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return flat[_places(begin, size)]


_coders: dict[str, WordIds] = {}


def cut(batch: pa.RecordBatch, coder: WordIds, capacity: int) -> Iterator[pa.RecordBatch]:
    """The pieces of a batch of doc_id and text, for about BATCH bytes of text at a time; a longer text is a batch of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH, side="right")) - at)
        rows = []
        for i, code in enumerate(coder.packed(batch.column(1).slice(at, n).to_pylist())):
            for k, start in enumerate(range(0, len(code) // 4, capacity)):
                part = code[4 * start : 4 * (start + capacity)]
                rows.append((at + i, k, start, len(part) // 4, zlib.crc32(part)))
        row, *told = zip(*rows, strict=True)
        columns = [batch.column(0).take(pa.array(row)), *map(pa.array, told, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])
        at += n


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every row: documents longer than ``capacity`` are cut, no others."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coders.setdefault(tokenizer, _coders.get(tokenizer) or WordIds(tokenizer))
        for batch in batches:
            yield from cut(batch, coder, capacity)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(told, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: Martello and Toth's second bound on the waste, over all thresholds."""
    sizes = np.array(sorted(counts), dtype=np.int64)
    if not len(sizes):
        return 0
    n = np.array([counts[int(s)] for s in sizes], dtype=np.int64)
    most = -(-int((sizes * n).sum()) // capacity)
    for k in [0, *sizes[sizes <= capacity // 2].tolist()]:
        big, mid, small = sizes > capacity - k, (sizes <= capacity - k) & (2 * sizes > capacity), (2 * sizes <= capacity) & (sizes >= k)
        free = int(n[mid].sum()) * capacity - int((sizes[mid] * n[mid]).sum())
        more = max(0, -(-(int((sizes[small] * n[small]).sum()) - free) // capacity))
        most = max(most, int(n[big].sum()) + int(n[mid].sum()) + more)
    return most


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit packing by decreasing length on counts: (lengths, bins of that kind). Equal bins are filled at once."""
    left = {s: n for s, n in counts.items() if n}
    sizes = sorted(left)
    out: list[tuple[tuple[int, ...], int]] = []
    while left:
        bin_, free, used, at = [], capacity, {}, len(sizes)
        while free and (at := bisect_right(sizes, free, 0, at) - 1) >= 0:  # the next smaller length that fits
            s = sizes[at]
            take = min(free // s, left[s])
            bin_ += [s] * take
            used[s] = take
            free -= take * s
        times = min(left[s] // k for s, k in used.items())
        out.append((tuple(bin_), times))
        for s, k in used.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
                del sizes[bisect_right(sizes, s) - 1]
    return out


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of ``b``, largest first, fit together into those of ``a`` as if they were bins: then ``a`` is
    never worse, for what ``b`` leaves can take the place of what ``a`` leaves."""
    if len(b) > 12 or sum(b) > sum(a):  # too many to try
        return False

    def fits(room: list[int], at: int) -> bool:
        if at == len(b):
            return True
        tried = set()
        for i, r in enumerate(room):
            if r >= b[at] and r not in tried:
                tried.add(r)
                room[i] -= b[at]
                if fits(room, at + 1):
                    return True
                room[i] += b[at]
        return False

    return fits(list(a), 0)


def fillings(sizes: list[int], left: dict[int, int], free: int) -> list[tuple[int, ...]]:
    """Undominated ways to fill ``free``, least waste first, of those enumerated: the FILLINGS pairs that leave least,
    and each of the FILLINGS largest pieces with the two others that leave least; then the largest that still fit.

    A filling whose pieces all fit together into another's pieces is dominated.
    """
    found: dict[tuple[int, ...], int] = {}
    fit = np.array([s for s in reversed(sizes) if s <= free], np.int64)

    def closed(chosen: list[int], room: int) -> None:
        used = {s: chosen.count(s) for s in chosen}
        if any(n > left[s] for s, n in used.items()):
            return
        at = len(fit)
        while room > 0 and (at := int(np.searchsorted(fit[:at], room, side="right")) - 1) >= 0:  # the next smaller that fits
            s = int(fit[at])
            if (take := min(room // s, left[s] - used.get(s, 0))) > 0:
                chosen = chosen + [s] * take
                room -= s * take
        found.setdefault(tuple(sorted(chosen, reverse=True)), room)

    closed([], free)
    heads = fit[::-1][:FILLINGS]
    if len(heads):
        under = np.concatenate([[0], fit])  # no piece, or one
        pair = under[np.searchsorted(fit, free - fit, side="right")]
        for i in np.argsort(free - fit[::-1] - pair[::-1], kind="stable")[:FILLINGS].tolist():  # two pieces that leave least
            a, b = int(fit[-1 - i]), int(pair[-1 - i])
            closed([x for x in (a, b) if x], free - a - b)
        rest = (free - heads)[:, None] - under[None, :]  # after a second piece
        three = np.where(rest >= 0, under[np.searchsorted(fit, rest.reshape(-1), side="right").reshape(rest.shape)], -1)
        waste = np.where(rest >= 0, rest - three, free + 1)
        pick = waste.argmin(axis=1)
        for i, a in enumerate(heads.tolist()):
            b, c = int(under[pick[i]]), int(three[i, pick[i]])
            closed([x for x in (a, b, c) if x], free - a - b - c)
    ranked = sorted(found.items(), key=lambda x: (x[1], tuple(-s for s in x[0])))
    kept: list[tuple[int, ...]] = []
    for way, _ in ranked:
        if not any(dominates(k, way) for k in kept):
            kept.append(way)
    return kept


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """The bins, as (lengths, number of such bins), by bin completion over a histogram of lengths.

    Depth first: the largest length left opens a bin, its fillings are tried in order of waste, and one choice is made
    for as many equal bins at once as the counts allow. A branch ends where the waste so far leaves a bound no better
    than the incumbent. The search starts from the best-fit packing and ends at the lower bound or after BRANCHES
    branches. There is one table of counts: a choice changes it, and the way back undoes the change.
    """
    incumbent = best_fit(counts, capacity)
    best, floor = sum(n for _, n in incumbent), lower_bound(counts, capacity)
    total = sum(s * n for s, n in counts.items())
    left = {s: n for s, n in counts.items() if n}
    done: list[tuple[tuple[int, ...], int]] = []
    bins = waste = branches = 0
    open_ = [[()]]  # at each depth the choices left, the next one last; the root's only choice is none

    def change(lengths: tuple[int, ...], times: int) -> None:
        for s in lengths:
            left[s] = left.get(s, 0) - times
            if not left[s]:
                del left[s]

    while best > floor and branches < BRANCHES:
        if not open_[-1]:
            open_.pop()
            if not open_ or not done:
                break
            lengths, times = done.pop()
            change(lengths, -times)
            bins, waste = bins - times, waste - (capacity - sum(lengths)) * times
            continue
        lengths = open_[-1].pop()
        if lengths:
            times = min(left[s] // lengths.count(s) for s in set(lengths))
            change(lengths, times)
            done.append((lengths, times))
            bins, waste = bins + times, waste + (capacity - sum(lengths)) * times
        open_.append([])
        if -(-(total + waste) // capacity) >= best:
            continue
        if branches < TRIED or not branches % TRIED or not left:
            rest = best_fit(left, capacity)
            if bins + (n := sum(n for _, n in rest)) < best:
                incumbent, best = done + rest, bins + n
        if not left or best <= floor:
            continue
        branches += 1
        largest = max(left)
        change((largest,), 1)
        sizes = sorted(left, reverse=True)
        ways = fillings(sizes, left, capacity - largest) if sizes else [()]
        change((largest,), -1)
        open_[-1] = [(largest, *way) for way in reversed(ways)]
    return incumbent


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of ``docs``.

    Null and blank texts are the single id END. Each piece has one place; offsets in a sequence are gapless from 0.
    Repeated rows are packed each. Longer documents are cut into ``capacity`` ids. Empty tables give no rows. Pieces of
    one length may be a third of all rows: they are ranked in parts by hash, never in one task.
    """
    spark = docs.sparkSession
    with arrow_rows(spark, ROWS):
        cut = saved(pieces(docs, tokenizer, capacity).withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(256))))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    slots, base = [], 0
    taken: dict[int, int] = {}
    for lengths, bins in plan(counts, capacity):
        at, seen = 0, {}
        for s in lengths:
            k = seen[s] = seen.get(s, -1) + 1
            slots.append((s, taken.get(s, 0) + k * bins, base, at))  # the bins' k-th pieces of this length, one after another
            at += s
        for s in seen:
            taken[s] = taken.get(s, 0) + (seen[s] + 1) * bins
        base += bins
    table = pd.DataFrame(slots, columns=["length", "_from", "_base", "offset"]).sort_values(["length", "_from"])
    whole = capacity in counts
    grouped = table.groupby("length").agg(list).reset_index() if len(table) else table
    look = spark.createDataFrame(grouped, "length long, _from array<long>, _base array<long>, offset array<long>")
    ranked = running(cut, ["length"], ["doc_id", "piece", "ids_crc32"], F.lit(1), "_rank", "_part")
    joined = ranked.join(F.broadcast(look), "length")  # the plan's slots: bounded by the capacity, not by the rows
    nth = F.expr("aggregate(sequence(0, 63), named_struct('lo', 0, 'hi', size(_from)), (x, i) -> if(x.hi - x.lo > 1, if(_from[cast((x.lo + x.hi) / 2 as int)] <= _rank, named_struct('lo', cast((x.lo + x.hi) / 2 as int), 'hi', x.hi), named_struct('lo', x.lo, 'hi', cast((x.lo + x.hi) / 2 as int))), x)).lo")
    placed = joined.withColumn("_nth", nth)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.expr("_base[_nth]") + F.col("_rank") - F.expr("_from[_nth]")).alias("sequence_id"), F.expr("offset[_nth]").alias("offset"))
