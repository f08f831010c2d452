"""Sharding by a hierarchical weighted hash tree (regions, racks, shards), in DataFrame functions only.

At each level a row draws, for every child of the node it stands in, ``-ln(u) / weight`` with ``u`` hashed
from its key and the child's path, and steps into the child with the smallest draw. A child is so taken in
proportion to its weight, and a changed weight moves rows only into or out of the subtrees that hold it.
Keys alone decide: no state, no shuffle, no memory of earlier rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import running

#: A leaf: region, rack, shard number, weight.
Leaf = tuple[str, str, int, float]


def tree(shards: int, per_rack: int = 2, racks: int = 2, whole: int | None = None) -> list[Leaf]:
    """The leaves for shards 0, 1, ...: ``per_rack`` to a rack, ``racks`` to a region, all of weight 1.

    With ``whole``, each shard from that number on has a region of its own: then adding one moves rows into it alone.
    """
    whole = shards if whole is None else whole
    return [(f"r{s // (per_rack * racks)}", f"k{s // per_rack}", s, 1.0) if s < whole else (f"g{s}", f"g{s}", s, 1.0) for s in range(shards)]


def levels(leaves: list[Leaf]) -> list[dict[str, list[tuple[str, float]]]]:
    """For each level, the children and weights of every node, by path."""
    out: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for region, rack, shard, weight in leaves:
        if weight <= 0:
            continue
        for at, (up, child) in enumerate((("", region), (region, f"{region}/{rack}"), (f"{region}/{rack}", f"{region}/{rack}/{shard}"))):
            nodes = out[at].setdefault(up, {})
            nodes[child] = nodes.get(child, 0.0) + weight
    return [{up: sorted(kids.items()) for up, kids in at.items()} for at in out]


def place(key: Column, leaves: list[Leaf]) -> Column:
    """The shard (int) of a key. Null keys share one shard. Shards of weight 0 get no row."""
    node: Column = F.lit("")
    for at in levels(leaves):
        kids = F.create_map(*[x for up, children in at.items() for x in (F.lit(up), F.array(*[F.struct(F.lit(p).alias("path"), F.lit(w).alias("w")) for p, w in children]))])
        here = node

        def draw(child: Column) -> Column:
            u = (F.xxhash64(F.coalesce(key, F.lit("")), child["path"]).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))
            return F.struct((-F.log(u) / child["w"]).alias("draw"), child["path"].alias("path"))

        node = F.array_min(F.transform(F.element_at(kids, here), draw))["path"]
    return F.element_at(F.split(node, "/"), 3).cast("int")


def shard(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", bucket_bits: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    Null or empty text: size 1, checksum 0. Equal keys share a shard; every row has a slot of its own, gapless
    from 0 in each shard, in the order of hashed keys. Empty tables give no rows; other columns are ignored.
    The text is read once and isn't shuffled: only the narrow result is, for the slots.
    """
    by = F.col(key).cast("string")
    slim = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(by, tree(shards, whole=shards)).alias("shard"),
        place(by, tree(shards + 1, whole=shards)).alias("grown_shard"),
        F.xxhash64(by).alias("_hash"),
    ).withColumn("_part", F.shiftrightunsigned("_hash", 64 - bucket_bits))
    out = running(slim, ["shard"], ["_hash", "doc_id", "text_crc32"], F.lit(1), "slot", "_part")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
