"""Versions of XML bodies compared leaf by leaf.

A small parser tells each body as rows, one a leaf, with the steps from the root to it; a step knows what its own document says
about it (the declared key, the place among its namesakes, how many they are). Which of these names a step is a matter
of both versions, and of what their parents were matched by, so it's decided level by level with windows inside a pair: by
key where every namesake of both sides has one of its own, by tag where neither side repeats it, else by place, which is
flagged. Then one join by path compares all leaves. Where both bodies of a pair stand in one row, the same is decided while both
trees are walked at once (``compared``), and equal leaves never leave the task.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Mapping, Sequence
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.checkpoint import saved

#: Repeated blocks with the children that tell them apart, and the names of numeric leaves.
_SENIOR, _SUBORDINATE = ("SERIE", "ID_SUBCLASSE"), ("TIPO", "SERIE", "ID_SUBCLASSE")
KEYS = {
    "CLASSE_SENIOR": _SENIOR,
    "DESC_SERIE_CLASSE_SENIOR": _SENIOR,
    "RENT_CLASSE_SENIOR": _SENIOR,
    "CLASSE_SUBORD": _SUBORDINATE,
    "DESC_SERIE_CLASSE_SUBORD": _SUBORDINATE,
    "RENT_CLASSE_SUBORD": _SUBORDINATE,
    "CEDENT_CRED_EXISTE": ("NR_PF_PJ_CEDENT_CRED_EXISTE",),
    "CEDENT": ("NR_PF_PJ_CEDENT",),
}
NUMERIC = ("VL_", "VLR_", "QT_", "QNT_", "PR_", "PRC_", "TX_", "DESEMP_")
NUMERIC_PARENTS = ("CLS_SENIOR", "CLS_SUBORDINADA")
NIL = "{http://www.w3.org/2001/XMLSchema-instance}nil"
STEP = "struct<tag:string,key:string,at:int,n:int,ok:boolean>"
#: Leaves that a task hands over at once.
ROWS = 20_000
_ENDS = re.compile("[\\\\,\\]/]")
_NUMBER = re.compile(r"[+-]?[0-9]+([.,][0-9]+)?")
_BASES = ("path", "key", "position")


def _bare(tag: str) -> str:
    return tag.rpartition("}")[2] if tag[:1] == "{" else tag


def _is_nil(e: ET.Element) -> bool:
    return e.get(NIL) in ("true", "1")


def _key(e: ET.Element, names: Sequence[str]) -> str | None:
    """An element's declared key as text, from the key children that it has; null if one of them can't tell it."""
    found = [(n, c) for n in names if (c := e.find(n)) is not None]
    for _, c in found:
        if len(c) or (c.attrib and _is_nil(c)):
            return None
    return ",".join(f"{n}={_ENDS.sub(lambda m: chr(92) + m[0], (c.text or '').strip())}" for n, c in found) or None


def _own(e: ET.Element, top: bool) -> Iterator[tuple[str | None, str | None, bool]]:
    """(attribute, value, nil) of an element's own leaves: its text, or that it is nil or empty, and its attributes."""
    text, nil = (e.text or "").strip(), bool(e.attrib) and _is_nil(e)
    if nil or text or (not len(e) and not top):
        yield "#text" if top else None, None if nil else text, nil
    if e.attrib:
        for name, value in sorted((_bare(k), v.strip()) for k, v in e.attrib.items() if k != NIL):
            yield name, value, False


def _namesakes(e: ET.Element) -> dict[str, list[ET.Element]]:
    out: dict[str, list[ET.Element]] = {}
    for child in e:
        tag = child.tag
        if isinstance(tag, str):
            tag = _bare(tag)
            if tag in out:
                out[tag].append(child)
            else:
                out[tag] = [child]
    return out


def _keyed(tag: str, all_: Sequence[ET.Element], keys: Mapping[str, Sequence[str]]) -> list[str] | None:
    """The keys of namesakes, if each has one of its own."""
    if tag not in keys:
        return None
    own = [_key(c, keys[tag]) for c in all_]
    return own if None not in own and len(set(own)) == len(own) else None


def _told(e: ET.Element, steps: tuple, keys: Mapping[str, Sequence[str]]) -> Iterator[tuple]:
    """(steps, attribute, value, nil) of every leaf at or below an element."""
    for leaf in _own(e, not steps):
        yield steps, *leaf
    for tag, all_ in _namesakes(e).items() if len(e) else ():
        own = _keyed(tag, all_, keys)
        for i, c in enumerate(all_):
            yield from _told(c, (*steps, (tag, own[i] if own else None, i + 1, len(all_), own is not None)), keys)


def _numeric(tag: str, parent: str) -> bool:
    return tag.startswith(NUMERIC) or parent in NUMERIC_PARENTS


def _plain(e: ET.Element) -> bool:
    """An element that is one leaf, without attributes but for being nil."""
    return not len(e) and (not e.attrib or e.attrib.keys() == {NIL})


def _alike(a: str, b: str, numeric: bool) -> bool:
    """Texts that are the same, or short numbers that are but for a comma."""
    return a == b or (numeric and len(a) == len(b) < 25 and a.replace(",", ".") == b.replace(",", ".") and bool(_NUMBER.fullmatch(a)))


def _apart(old: ET.Element, new: ET.Element, keys: Mapping[str, Sequence[str]]) -> Iterator[tuple]:
    """(path, leaf, numeric, basis, old, new) of the leaves in which two trees differ, each side as (value, nil) or None.

    Both trees are walked at once, so that only what differs is told. Numbers that are written otherwise still differ here,
    but for those whose comma is a point."""
    stack: list[tuple] = [("", 0, "", "", old, new)]
    rows: list[tuple] = []

    def met(at: str, basis: int, tag: str, parent: str, x: ET.Element | None, y: ET.Element | None) -> None:
        # most are one leaf on either side
        if (x is None or _plain(x)) and (y is None or _plain(y)):
            u, v = (None if e is None else (None, True) if e.attrib and _is_nil(e) else ((e.text or "").strip(), False) for e in (x, y))
            numeric = _numeric(tag, parent)
            if u != v and not (u and v and u[0] and v[0] and _alike(u[0], v[0], numeric)):
                rows.append((at, tag, numeric, basis, u, v))
        else:
            stack.append((at, basis, tag, parent, x, y))

    while stack:
        path, basis, tag, parent, x, y = stack.pop()
        sides: list[dict[str | None, tuple]] = []
        for e in (x, y):
            own: dict[str | None, tuple] = {}
            told = e is not None and (e.attrib or not len(e) or (e.text and not e.text.isspace()))
            for attribute, value, nil in _own(e, not path) if told else ():
                if attribute not in own or own[attribute] < (value, nil):  # of names alike but for their space
                    own[attribute] = value, nil
            sides.append(own)
        a, b = sides
        for attribute in {**a, **b} if a != b else ():
            u, v = a.get(attribute), b.get(attribute)
            numeric = attribute is None and _numeric(tag, parent)
            if u != v and not (u and v and u[0] and v[0] and _alike(u[0], v[0], numeric)):
                end = "" if attribute is None else attribute if attribute == "#text" else f"@{attribute}"
                yield path + end, tag if attribute is None else attribute, numeric, basis, u, v
        one, two = (_namesakes(e) if e is not None and len(e) else {} for e in (x, y))
        to = f"{path}/" if path else ""
        for name in {**one, **two}:
            first, second = one.get(name, ()), two.get(name, ())
            if name in keys:
                known = [_keyed(name, s, keys) for s in (first, second) if s]
                if None not in known:
                    left, right = (dict(zip(own, s, strict=True)) for own, s in ((known[0] if first else (), first), (known[-1] if second else (), second)))
                    for k in {**left, **right}:
                        met(f"{to}{name}[{k}]", max(basis, 1), name, tag, left.get(k), right.get(k))
                    continue
            if len(first) <= 1 and len(second) <= 1:
                met(to + name, basis, name, tag, *(first or (None,)), *(second or (None,)))
                continue
            for i, (c, d) in enumerate(zip_longest(first, second)):
                met(f"{to}{name}[#{i + 1}]", 2, name, tag, c, d)
        yield from rows
        rows.clear()


def parsed(content: str | None, roots: Sequence[str]) -> tuple[str, ET.Element | None]:
    """(status, root): why a body can't be read, or ok."""
    text = (content or "").lstrip("﻿ \t\r\n")
    if not text.startswith("<"):
        return "not_xml", None
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        return "parse_error", None
    try:
        root = ET.fromstring(re.sub(r"^<\?xml[^>]*\?>", "", text))
    except (ET.ParseError, ValueError, RecursionError):
        return "parse_error", None
    return ("ok", root) if not roots or _bare(root.tag) in roots else ("unsupported_root", None)


def leaves(bodies: DataFrame, keys: Mapping[str, Sequence[str]] = KEYS, roots: Sequence[str] = ()) -> DataFrame:
    """id, status, steps, attribute, value, nil: a row for each leaf of a body, and one without steps for a body that can't be
    read, or has no leaf. ``bodies``: id, content. A DTD is refused, as no report has one. Deep or long bodies are whole."""

    step = pa.struct([("tag", pa.string()), ("key", pa.string()), ("at", pa.int32()), ("n", pa.int32()), ("ok", pa.bool_())])

    def packed(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        at, status, steps, attribute, value, nil = map(list, zip(*rows, strict=True))
        ends = [0]
        for s in steps:
            ends.append(ends[-1] + len(s or ()))
        flat = list(zip(*(x for s in steps for x in s or ()), strict=True)) or [()] * len(step)
        structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, step, strict=True)], fields=list(step))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs, mask=pa.array([s is None for s in steps]))
        columns = [ids.take(pa.array(at)), pa.array(status, pa.string()), lists, pa.array(attribute, pa.string()), pa.array(value, pa.string()), pa.array(nil, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, ["id", "status", "steps", "attribute", "value", "nil"])

    def told(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, rows = batch.column(0), []
            for i, content in enumerate(batch.column(1)):
                status, root = parsed(content.as_py(), roots)
                found = _told(root, (), keys) if root is not None else iter(())
                first = next(found, None)
                rows.append((i, status, *(first or (None, None, None, False))))
                for leaf in found:
                    rows.append((i, status, *leaf))
                    if len(rows) >= ROWS:
                        yield packed(ids, rows)
                        rows = []
            if rows:
                yield packed(ids, rows)

    kind = bodies.schema["id"].dataType.simpleString()
    return bodies.select("id", "content").mapInArrow(told, f"id {kind}, status string, steps array<{STEP}>, attribute string, value string, nil boolean")


def _attribute() -> Column:
    """The end of a path: the attribute, if the leaf is one."""
    at = F.when(F.col("attribute") == "#text", "#text").otherwise(F.concat(F.lit("@"), F.col("attribute")))
    return F.coalesce(at, F.lit(""))


def _path(segments: Column) -> Column:
    """Segments joined, with the attribute at the end."""
    return F.concat(F.array_join(segments, "/"), _attribute())


def _segment(step: Column, keyed: Column, single: Column) -> Column:
    by_key = F.concat(step["tag"], F.lit("["), step["key"], F.lit("]"))
    return F.when(keyed, by_key).when(single, step["tag"]).otherwise(F.concat(step["tag"], F.lit("[#"), step["at"].cast("string"), F.lit("]")))


def canonical(told: DataFrame) -> DataFrame:
    """id, status, leaves and sha256 of each body's canonical form: sorted lines of path and value, in which white space, the
    declaration and the order of keyed blocks don't count. Null for bodies that can't be read."""
    path = _path(F.transform("steps", lambda s: _segment(s, s["ok"], s["n"] <= 1)))
    line = F.concat(path, F.when(F.col("nil"), "\t~nil").otherwise(F.concat(F.lit("\t="), F.col("value"))))
    per = told.groupBy("id").agg(F.first("status").alias("status"), F.sort_array(F.collect_list(F.when(F.col("steps").isNotNull(), line))).alias("_lines"))
    ok = F.col("status") == "ok"
    return per.select("id", "status", F.when(ok, F.size("_lines")).alias("leaves"), F.when(ok, F.sha2(F.array_join("_lines", "\n"), 256)).alias("sha256"))


def differences(pairs: DataFrame, told: DataFrame) -> DataFrame:
    """pair, path, leaf, kind, old, new, old_num, new_num, basis: every leaf in which two bodies differ.

    ``pairs``: pair, old, new (ids of bodies). kind: added, removed, changed, nil_to_value, value_to_nil; an empty element has
    a value, a nil one none, and an absent one isn't there. Leaves named as numbers are equal if their numbers are, so 0,00 is
    0; everything else is text. basis: path, key or position, the weakest on the way to the leaf. Pairs of which a
    body can't be read have no rows.
    """
    sides = pairs.select("pair", F.col("old").alias("id"), F.lit(0).alias("side")).unionByName(pairs.select("pair", F.col("new").alias("id"), F.lit(1).alias("side")))
    # told once; the table is dealt by pair once, and each level is a sort within a pair's part
    rows = saved(told.join(sides, "id").select("pair", "side", "status", "steps", "attribute", "value", "nil"), forget=True)
    bad = rows.filter("status != 'ok'").select("pair").distinct()
    depth = rows.agg(F.max(F.size("steps"))).first()[0] or 0
    rows = rows.join(bad, "pair", "left_anti").filter("steps is not null").drop("status")
    tag, parent = F.try_element_at("steps", F.lit(-1))["tag"], F.try_element_at("steps", F.lit(-2))["tag"]
    numeric = F.col("attribute").isNull() & (F.size("steps") > 0) & (tag.rlike(f"^({'|'.join(NUMERIC)})") | F.coalesce(parent.isin(*NUMERIC_PARENTS), F.lit(False)))
    number = F.when(numeric, _number(F.col("value")))
    rows = rows.withColumns({"leaf": F.coalesce("attribute", tag), "num": number, "_path": F.lit(""), "basis": F.lit(0)}).repartition("pair")
    for level in range(depth):
        step = F.get("steps", F.lit(0))
        group = Window.partitionBy("pair", "_path", step["tag"])
        both = rows.withColumns({"_keyed": F.coalesce(F.min(step["ok"]).over(group), F.lit(False)), "_most": F.max(step["n"]).over(group)})
        here = step.isNotNull()
        segment = F.concat(F.lit("/" if level else ""), _segment(step, F.col("_keyed"), F.col("_most") <= 1))
        basis = F.when(F.col("_keyed"), 1).when(F.col("_most") <= 1, 0).otherwise(2)
        rows = both.withColumns({"_path": F.when(here, F.concat("_path", segment)).otherwise(F.col("_path")), "basis": F.when(here, F.greatest("basis", basis)).otherwise(F.col("basis")), "steps": F.slice("steps", 2, F.greatest(F.size("steps"), F.lit(1)))}).drop("_keyed", "_most")
    named = rows.select("pair", "side", F.concat("_path", _attribute()).alias("path"), "leaf", "value", "nil", "basis", "num")
    side = lambda k: F.max(F.when(F.col("side") == k, F.struct("value", "nil", "num")))
    met = named.groupBy("pair", "path").agg(F.first("leaf").alias("leaf"), F.max("basis").alias("basis"), side(0).alias("a"), side(1).alias("b"))
    return _changes(met)


def _number(value: Column) -> Column:
    """A text as a number, null if it isn't one."""
    return F.when(value.rlike(f"^{_NUMBER.pattern}$"), F.replace(value, F.lit(","), F.lit(".")).try_cast("decimal(38, 12)"))


def _changes(met: DataFrame) -> DataFrame:
    """What differs, of leaves with both sides (a and b: value, nil, num; null if absent) beside each other."""
    a, b = F.col("a"), F.col("b")
    same = F.when(a["nil"] | b["nil"], a["nil"] & b["nil"]).otherwise((a["value"] == b["value"]) | F.coalesce(a["num"] == b["num"], F.lit(False)))
    kind = F.when(a.isNull(), "added").when(b.isNull(), "removed").when(a["nil"], "nil_to_value").when(b["nil"], "value_to_nil").otherwise("changed")
    out = met.filter(a.isNull() | b.isNull() | ~same)
    return out.select("pair", "path", "leaf", kind.alias("kind"), a["value"].alias("old"), b["value"].alias("new"), a["num"].alias("old_num"), b["num"].alias("new_num"), F.get(F.array(*map(F.lit, _BASES)), F.col("basis")).alias("basis"))


def compared(versions: DataFrame, keys: Mapping[str, Sequence[str]] = KEYS, roots: Sequence[str] = ()) -> DataFrame:
    """The same as ``differences`` of pairs whose bodies stand beside each other. ``versions``: pair, old, new (texts).

    A task holds the trees of one pair at a time and hands over only leaves that differ, so nothing is shuffled or sorted by
    leaf; numbers are compared after that."""
    kind = versions.schema["pair"].dataType.simpleString()
    schema = pa.schema([("path", pa.string()), ("leaf", pa.string()), ("numeric", pa.bool_()), ("basis", pa.int32())] + [(f"{side}{end}", t) for side in "ab" for end, t in (("", pa.string()), ("_nil", pa.bool_()))])

    def packed(pairs: pa.Array, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
        return pa.RecordBatch.from_arrays([pairs.take(pa.array(at)), *columns], ["pair", *schema.names])

    def told(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        absent = None, None
        for batch in it:
            pairs, at, rows = batch.column(0), [], []
            for i in range(batch.num_rows):
                (one, old), (two, new) = (parsed(batch.column(k)[i].as_py(), roots) for k in (1, 2))
                if one != "ok" or two != "ok":
                    continue
                for path, leaf, numeric, basis, u, v in _apart(old, new, keys):
                    at.append(i)
                    rows.append((path, leaf, numeric, basis, *(u or absent), *(v or absent)))
                    if len(rows) >= ROWS:
                        yield packed(pairs, at, rows)
                        at, rows = [], []
            if rows:
                yield packed(pairs, at, rows)

    apart = versions.select("pair", "old", "new").mapInArrow(told, f"pair {kind}, path string, leaf string, numeric boolean, basis int, a string, a_nil boolean, b string, b_nil boolean")
    side = lambda k: F.when(F.col(f"{k}_nil").isNotNull(), F.struct(F.col(k).alias("value"), F.col(f"{k}_nil").alias("nil"), F.when(F.col("numeric"), _number(F.col(k))).alias("num"))).alias(k)
    return _changes(apart.select("pair", "path", "leaf", "basis", side("a"), side("b")))
