"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is parsed against each
automaton into phrases, each the longest match with that language's sample; the language that needs the fewest
phrases, normalised by length and by the size of its sample, wins.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import boxed

#: Characters of labelled text for each language's automaton, at most; and how many labelled documents are drawn for
#: each language, about, to get them.
SAMPLE_CHARS, SAMPLE_DOCS = 32_768, 120
#: Characters parsed without a break, lanes parsed in step, and characters of text handled at once.
SEGMENT, LANES, BATCH = 1024, 2048, 1_000_000


def held_out(doc_id="doc_id"):
    """Whether a document is kept from training: the CRC-32 of its id, as text, modulo 3, is 1."""
    return F.coalesce(F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")) % 3 == 1, F.lit(False))


def samples(docs: DataFrame) -> dict[str, str]:
    """Labelled text by language, at most SAMPLE_CHARS characters of each; every language is learned.

    Documents are drawn by the hash of their ids, at a rate from each language's count, so that nothing large is sorted or
    grouped and the driver gets a few hundred documents' leading SAMPLE_CHARS characters a language, whatever the
    table's size.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(SAMPLE_DOCS)) / F.count("*")).alias("rate"))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    # a row per language: as many as labels there are
    chosen = known.join(F.broadcast(counts), "lang").filter(draw < F.col("rate"))
    at = F.xxhash64("doc_id", "text").alias("at")
    order = Window.partitionBy("lang").orderBy("at", "text")  # of the few drawn; ids that are very often repeated can't add more
    drawn = chosen.select("lang", F.substring("text", 1, SAMPLE_CHARS).alias("text"), at).withColumn("nth", F.row_number().over(order))
    rows = drawn.filter(F.col("nth") <= 2 * SAMPLE_DOCS).collect()
    rows.sort(key=lambda r: (r["lang"], r["at"], r["text"]))
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["lang"], []).append(r["text"])
    share = {lang: max(200, SAMPLE_CHARS // len(texts)) for lang, texts in out.items()}
    return {lang: " ".join(t[: share[lang]] for t in texts)[:SAMPLE_CHARS] for lang, texts in sorted(out.items())}


@functools.cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


class Parser:
    """The automata of all languages as one table of transitions, and parsing against them."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        folded = {k: self.points(texts[k]) for k in self.langs}
        found = np.unique(np.concatenate([*folded.values(), np.zeros(0, np.uint32)]))
        alphabet = found[letters()[found]] if len(found) else found
        # class 0: letters that no sample holds; 1: anything but a letter; 2 and on: the samples' letters
        self.classes = np.where(letters(), 0, 1).astype(np.int32)
        self.classes[alphabet] = np.arange(2, len(alphabet) + 2, dtype=np.int32)
        self.width = len(alphabet) + 2
        self.tables, self.bits = [], []
        for k in self.langs:
            text = self.squeezed(self.classes[folded[k]])
            self.tables.append(self.automaton(text[text > 0].tolist()))
            self.bits.append(math.log2(max(2, len(text))))

    @staticmethod
    def points(text: str) -> np.ndarray:
        return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)

    @staticmethod
    def squeezed(classes: np.ndarray) -> np.ndarray:
        """Runs of other characters count as one."""
        keep = np.ones(len(classes), bool)
        keep[1:] = (classes[1:] != 1) | (classes[:-1] != 1)
        return classes[keep]

    def automaton(self, text: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The suffix automaton's transitions, packed; state 1 is the start, 0 none."""
        edges: list[dict[int, int]] = [{}, {}]
        link, length, last = [0, 0], [0, 0], 1
        for c in text:
            new = len(edges)
            edges.append({})
            link.append(1)
            length.append(length[last] + 1)
            p = last
            while p and c not in edges[p]:
                edges[p][c] = new
                p = link[p]
            if p:
                q = edges[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(edges)
                    edges.append(dict(edges[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    link[q] = link[new] = copy
                    while p and edges[p].get(c) == q:
                        edges[p][c] = copy
                        p = link[p]
            last = new
        return self.packed(edges)

    def packed(self, edges: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Transitions as (base, owner, to): class c leads from a state to ``to[base + c]`` if ``owner`` there is the state.

        States share one array, each where its classes find free places, so its size follows the number of edges.
        """
        most = sum(map(len, edges)) * 4 + 4 * self.width
        used, base = bytearray(most), np.zeros(len(edges), np.int64)
        owner, to = np.full(most, -1, np.int32), np.zeros(most, np.int32)
        at: dict[int, int] = {}
        for state in sorted(range(len(edges)), key=lambda i: -len(edges[i])):
            out = edges[state]
            if not out:
                continue
            classes = sorted(out)
            low, degree = classes[0], len(classes)
            place = used.find(0, max(at.get(degree, 0), low))
            while any(used[place - low + c] for c in classes):
                place = used.find(0, place + 1)
            at[degree] = place
            base[state] = place - low
            for c, target in out.items():
                used[place - low + c] = 1
                owner[place - low + c], to[place - low + c] = state, target
        end = int(base.max(initial=0)) + self.width
        return base, owner[:end].copy(), to[:end].copy()

    def phrases(self, lanes: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Phrases by language and lane; lanes: steps x lanes of classes, the longest lane first."""
        n, out = lanes.shape[1], np.zeros((len(self.langs), lanes.shape[1]), np.int64)
        live = n - np.searchsorted(lens[::-1], np.arange(len(lanes)), side="right")  # lanes that reach each step
        for k, (base, owner, to) in enumerate(self.tables):
            state, count = np.ones(n, np.int32), np.zeros(n, np.int32)
            every = base[1] + np.arange(self.width)
            start = np.where(owner[every] == 1, to[every], 0).astype(np.int32)
            start[start == 0] = 1
            for m, row in zip(live.tolist(), lanes, strict=True):
                c = row[:m]
                at = base[state[:m]] + c
                broken = owner[at] != state[:m]
                count[:m] += broken
                state[:m] = np.where(broken, start[c], to[at])
            out[k] = count
        return out

    def bits_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character by text and language (inf: nothing to parse), and whether a text holds a letter."""
        points = [self.points(t) if t else np.zeros(0, np.uint32) for t in texts]
        which = np.repeat(np.arange(len(texts)), [len(p) for p in points])
        flat = np.concatenate([*points, np.zeros(0, np.uint32)])
        classes = self.classes[flat]
        has = np.bincount(which, weights=letters()[flat], minlength=len(texts)) > 0
        keep = np.ones(len(classes), bool)
        keep[1:] = (classes[1:] != 1) | (classes[:-1] != 1) | (which[1:] != which[:-1])
        classes, which = classes[keep], which[keep]
        sizes = np.bincount(which, minlength=len(texts))
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        cuts = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), cuts)
        nth = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(cuts)])[:-1], cuts)
        begin = starts[owner] + nth * SEGMENT
        long = np.minimum(SEGMENT, starts[owner] + sizes[owner] - begin)
        total = np.zeros((len(self.langs), len(texts)))
        order = np.argsort(-long, kind="stable")
        owner, begin, long = owner[order], begin[order], long[order]
        for at in range(0, len(owner), LANES):
            b, n = begin[at : at + LANES], long[at : at + LANES]
            step = np.arange(n[0])[:, None]
            lanes = classes[np.minimum(b + step, len(classes) - 1)]
            for k, counts in enumerate(self.phrases(lanes, n)):
                total[k] += np.bincount(owner[at : at + LANES], weights=counts + 1, minlength=len(texts))
        with np.errstate(divide="ignore", invalid="ignore"):
            return (total * np.array(self.bits)[:, None] / sizes).T, has


@functools.lru_cache(maxsize=1)
def parser(texts: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(dict(texts))


def recognised(docs: DataFrame, learned: dict[str, str] | None = None) -> DataFrame:
    """``docs`` as ``_row``, with ``_told`` (lang_pred, score). Only the text decides."""
    texts = tuple(sorted((samples(docs) if learned is None else learned).items()))
    shared = docs.sparkSession.sparkContext.broadcast(texts)  # at most SAMPLE_CHARS characters a language
    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = parser(shared.value)
        for batch in batches:
            texts = [None if t is None else str(t) for t in batch]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            at = 0
            while known.langs and at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= BATCH):
                    size += len(texts[end] or "")
                    end += 1
                bits, has = known.bits_of(texts[at:end])
                for i in np.flatnonzero(has):
                    order = np.argsort(bits[i], kind="stable")
                    best, second = bits[i][order[0]], bits[i][order[1]] if len(order) > 1 else np.inf
                    lang[at + i] = known.langs[order[0]]
                    score[at + i] = 1.0 if np.isinf(second) else max(0.0, min(1.0, 1 - best / second))
                at = end
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return boxed(docs, "text").select("_row", "text", predict(F.col("text")).alias("_told"))


def identify(docs: DataFrame, learned: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with held_out, lang_pred and score (0 to 1) added.

    Only the text decides. Null texts, texts without a letter, and all texts where nothing was learned: ``und``, score 0.
    Otherwise the score is the saving of the best language's bits over the second's; ties go to the smaller name (score
    0); with one learned language it is 1. Whole texts of any length are parsed, in segments. Rows keep their order of
    partitions: nothing is shuffled. Repeated rows are judged alike. Extra columns pass through; an own column of one of
    the three names is replaced.
    """
    names = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    told = recognised(docs, learned)
    return told.select(*[(F.col("text") if c == "text" else F.col("_row").getField(c)).alias(c) for c in names], held_out(F.col("_row.doc_id")).alias("held_out"), F.col("_told.lang_pred").alias("lang_pred"), F.col("_told.score").alias("score"))
