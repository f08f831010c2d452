"""Fill-in-the-middle: texts rearranged so that a model learns to write what stands between a prefix and a suffix.

A text is a rope: a balanced binary tree over leaves of some units each, where every node caches its units and code
points. A split at a unit rank walks down one path and cuts one leaf; the rearranged text is the concatenation of the
subtrees with leaves for the sentinels between them. To invert it, the tree of the output is split at the code-point ranks
of its sentinels, and the parts are joined in the order of the text.

Whether, where and how a text is cut depends on its doc_id and the seed alone, so reruns and other partitionings agree.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed sentinels and units: blanks with the word after them; blanks at the end are a unit of their own.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = re.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")
#: Seed, texts in a hundred that are rearranged, and of those in a hundred that put the suffix first.
SEED, RATE, SUFFIX_FIRST = 42, 50, 80
#: Units of a leaf at most.
LEAF = 256
_LEAF = re.compile(rf"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){{1,{LEAF}}}+|[\x20\x09-\x0D]++")
FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string"


class Rope:
    """A leaf (``text``) or a node of two ropes, with its units, code points and height."""

    __slots__ = ("text", "left", "right", "units", "points", "height")

    def __init__(self, text: str | None = None, units: int = 0, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if left is None or right is None:
            self.units, self.points, self.height = units, len(text or ""), 0
        else:
            self.units, self.points, self.height = left.units + right.units, left.points + right.points, 1 + max(left.height, right.height)


EMPTY = Rope("")


def leaf(text: str) -> Rope:
    return Rope(text, len(UNIT.findall(text)))


def rope(text: str) -> Rope:
    """The tree of a text, its leaves cut where units end."""
    level = [leaf(m[0]) for m in _LEAF.finditer(text)]
    while len(level) > 1:
        level = [Rope(left=a, right=b) for a, b in zip(level[::2], level[1::2])] + level[len(level) - len(level) % 2 :]
    return level[0] if level else EMPTY


def _node(a: Rope, b: Rope) -> Rope:
    """Two ropes whose heights differ by two at most, as a balanced one."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return Rope(left=a.left, right=Rope(left=a.right, right=b))
        return Rope(left=Rope(left=a.left, right=a.right.left), right=Rope(left=a.right.right, right=b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return Rope(left=Rope(left=a, right=b.left), right=b.right)
        return Rope(left=Rope(left=a, right=b.left.left), right=Rope(left=b.left.right, right=b.right))
    return Rope(left=a, right=b)


def joined(a: Rope, b: Rope) -> Rope:
    """Concatenation: the lower tree goes down the edge of the higher one."""
    if not a.points or not b.points:
        return a if a.points else b
    if a.height > b.height + 1:
        return _node(a.left, joined(a.right, b))
    if b.height > a.height + 1:
        return _node(joined(a, b.left), b.right)
    return Rope(left=a, right=b)


def split(tree: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """The first ``rank`` units (or ``points``) of a rope, and the rest."""
    size = getattr(tree, by)
    if rank <= 0 or rank >= size:
        return (EMPTY, tree) if rank <= 0 else (tree, EMPTY)
    if tree.left is not None and tree.right is not None:
        first = getattr(tree.left, by)
        if rank <= first:
            a, b = split(tree.left, rank, by)
            return a, joined(b, tree.right)
        a, b = split(tree.right, rank - first, by)
        return joined(tree.left, a), b
    if by == "points":
        return leaf(tree.text[:rank]), leaf(tree.text[rank:])
    at = next(m.end() for i, m in enumerate(UNIT.finditer(tree.text), 1) if i == rank)
    return Rope(tree.text[:at], rank), Rope(tree.text[at:], tree.units - rank)


def leaves(tree: Rope) -> Iterator[str]:
    stack = [tree]
    while stack:
        at = stack.pop()
        if at.left is None or at.right is None:
            yield at.text
        else:
            stack += (at.right, at.left)


def flat(*trees: Rope) -> str:
    whole = EMPTY
    for t in trees:
        whole = joined(whole, t)
    return "".join(leaves(whole))


def draws(doc_id: object, seed: int = SEED) -> list[int]:
    """The first four 32-bit numbers of the hash of seed and doc_id; a null doc_id hashes as nothing."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rearranged(doc_id: object, text: str | None, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    text = text or ""
    whole = rope(text)
    n = whole.units
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, suffix = split(whole, two)
    prefix, middle = split(head, one)
    p, s, m = (Rope(x, 0) for x in (PREFIX, SUFFIX, MIDDLE))
    if h4 % 100 < suffix_first:
        return n, "spm", prefix.points, middle.points, flat(s, suffix, p, prefix, m, middle)
    return n, "psm", prefix.points, middle.points, flat(p, prefix, s, suffix, m, middle)


def text_of(output: str | None, form: str) -> str | None:
    """The text of an output: its tree is split where the sentinels stand. No other place can look like one, since texts
    that hold a sentinel stay plain, and what follows "<" in one never begins another."""
    if output is None or form == "plain":
        return output
    order = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    rest, parts, gone = rope(output), {}, 0
    for mark, after in zip(order, (*order[1:], None)):
        _, rest = split(rest, len(mark), "points")
        gone += len(mark)
        end = output.index(after, gone) if after else len(output)
        parts[mark], rest = split(rest, end - gone, "points")
        gone = end
    return flat(parts[PREFIX], parts[MIDDLE], parts[SUFFIX])


def transform(docs: DataFrame, into: str = "fim", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Adds ``into`` (in place of a column of that name): a struct of n (units), form (plain, psm or spm), prefix_chars,
    middle_chars (code points; null if plain) and output (the text to train on).

    Null and empty texts have no units and a plain, empty output. Repeated rows of a doc_id are cut alike, rows without one
    too. Whole texts of any length are cut; other columns stay in the JVM. Empty tables give no rows.
    """

    @F.pandas_udf(FIELDS)
    def cut(doc_id: pd.Series, text: pd.Series) -> pd.DataFrame:
        rows = [rearranged(d, t, seed, rate, suffix_first) for d, t in zip(doc_id, text, strict=True)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    kept = [F.col(f"`{c}`") for c in docs.columns if c != into]
    return docs.select(*kept, cut(F.col("doc_id").cast("string"), F.col("text")).alias(into))


def restored(output: Column, form: Column) -> Column:
    """The exact text that an output of this form was made from; a null text comes back empty."""

    @F.pandas_udf("string")
    def whole(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([text_of(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return whole(output, form)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and hashes of the output and of the text restored from it."""
    cut = transform(docs.select("doc_id", "text")).select("doc_id", "fim.*")
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
