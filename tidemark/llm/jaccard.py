"""Exact join of documents by the Jaccard similarity of their word shingles, in a metric space.

1. Equal sets are one set, known by a hash; its documents follow it.
2. Shingles are dealt by hash, packed in arrays, to count in how many sets each occurs. A set in which more than a
   quarter of the shingles occur nowhere else has no partner; of the others, the rarest shingles that a partner must
   share one of are kept (two sets at the threshold can't differ in all of them). Shingles in a large share of all
   sets are known beforehand and not dealt; they come last in that order.
3. Sets that share such a shingle form families, which are joined in rounds. Pivots create Voronoi regions: sets within
   the threshold of a pivot belong to the nearest such pivot, link to it, and need no comparison with each other, since
   only the components count; by the triangle inequality a set outside can link into the region only from a window of
   distances around it, so only those boundary sets, with a region of their own or without, are compared with it. What
   lies outside all regions is joined recursively, with more pivots of its own, until nothing is left. Families of up to
   FAMILY sets go through this inside a task; larger ones are first split by counting shingles within the family, as in 2,
   before each round, and of what stays large the regions and their boundary sets are replicated to blocks.
4. Links become components by the smallest label, round by round, with checkpoints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.common import saved
from tidemark.operators.graph import components

SHINGLE, PERCENT = 5, 75
#: Bytes of text for a bucket of shingles, about; buckets at least; bytes packed at once.
BUCKET, LEAST_BUCKETS, BATCH = 8_000_000, 64, 2_000_000
#: A shingle is common if it is in one of so many sets; a batch looks for those in one of twice as many.
COMMON, MOST_COMMON = 16, 65_536
#: Sets of a family that one task joins at most; pivots of the first round, over tasks and in one; their growth by round.
FAMILY, PIVOTS, INNER, GROWTH = 1024, 16, 8, 4
#: A component with more than 1 in HOT of all rows is looked up apart.
HOT = 10_000
_HOT = np.iinfo(np.int32).max


def needed(n):
    """Shingles that a set of n must share with a partner, at least."""
    return (PERCENT * n + 99) // 100


def owner_of(shingles: np.ndarray) -> int:
    """A 64-bit name of a set, by its content."""
    return int((W.mixed(shingles).sum(dtype=np.uint64) + W.mixed(np.array([len(shingles) + 77], np.uint64))[0]).astype(np.int64))


def _sets(texts: list[str | None]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(index of the first text, shingle sets of some texts) for about BATCH bytes of text, hashed in smaller parts."""
    at, held, size = 0, [], 0
    for _, raws in W.batches(texts):
        held += W.shingle_sets(raws, SHINGLE)
        size += sum(map(len, raws))
        if size >= BATCH:
            yield at, held
            at, held, size = at + len(held), [], 0
    if held:
        yield at, held


def survey(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set) and owner (its name) for every row; besides, rows of shingles common in a batch
    (common, n: sets of the batch that hold it)."""

    def told(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            for at, sets in _sets(batch["text"].tolist()):
                owners = [owner_of(s) if len(s) else 0 for s in sets]
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[at : at + len(sets)].to_numpy(), "n": [len(s) for s in sets], "owner": owners, "common": pd.Series([None] * len(sets), dtype="Int64")})
                once = list({o: s for o, s in zip(owners, sets, strict=True) if len(s)}.values())
                if once:
                    found, count = np.unique(np.concatenate(once), return_counts=True)
                    many = count >= max(8, len(once) // (2 * COMMON))
                    if many.any():
                        yield pd.DataFrame({"doc_id": None, "n": count[many], "owner": 0, "common": pd.Series(found[many].astype(np.int64), dtype="Int64")})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(told, f"doc_id {kind}, n long, owner long, common long")


def _packed(ids: np.ndarray) -> bytes:
    return np.ascontiguousarray(ids).tobytes()


def dealt(docs: DataFrame, common: np.ndarray, buckets: int) -> DataFrame:
    """Shingles by bucket of their hash, and by -1 - bucket of the owner: each set's size and common shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(common))

    def told(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot, seen = shared.value, set()
        for batch in it:
            for _, sets in _sets(batch["text"].tolist()):
                once: dict[int, np.ndarray] = {}
                for s in sets:
                    if len(s) and (o := owner_of(s)) not in seen:
                        seen.add(o)
                        once[o] = s
                if not once:
                    continue
                owners, sizes = np.array(list(once), np.int64), np.array([len(s) for s in once.values()])
                flat, who = np.concatenate(list(once.values())), np.repeat(owners, sizes)
                rows = []
                is_hot = np.isin(flat, hot, kind="sort") if len(hot) else np.zeros(len(flat), bool)
                home = (owners.astype(np.uint64) % np.uint64(buckets)).astype(np.int64)
                hot_home = (who[is_hot].astype(np.uint64) % np.uint64(buckets)).astype(np.int64)
                for b in np.unique(home).tolist():
                    rows.append((-1 - b, _packed(owners[home == b]), _packed(sizes[home == b]), _packed(who[is_hot][hot_home == b]), _packed(flat[is_hot][hot_home == b])))
                flat, who = flat[~is_hot], who[~is_hot]
                to = (flat % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                flat, who, cuts = flat[order], who[order], np.searchsorted(to[order], np.arange(buckets + 1))
                rows += [(b, None, None, _packed(who[i:j]), _packed(flat[i:j])) for b, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if j > i]
                yield pd.DataFrame(rows, columns=["bucket", "owners", "sizes", "who", "keys"])

    return docs.select("text").mapInPandas(told, "bucket int, owners binary, sizes binary, who binary, keys binary")


def _joined(column: pd.Series, kind=np.int64) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column if x is not None), kind)


def counted(packed: DataFrame, buckets: int) -> DataFrame:
    """By bucket of the owner: which shingles of which sets occur in how many sets (2 or more), and the sets' sizes."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        who, keys = _joined(pdf["who"]), _joined(pdf["keys"])
        if bucket < 0:  # already at its owner's bucket
            owners, at = np.unique(_joined(pdf["owners"]), return_index=True)
            sizes = _joined(pdf["sizes"])[at]
            pair = np.unique(np.stack([who, keys], axis=1), axis=0) if len(who) else np.zeros((0, 2), np.int64)
            return pd.DataFrame([(-1 - bucket, _packed(owners), _packed(sizes), _packed(pair[:, 0]), _packed(pair[:, 1]), _packed(np.full(len(pair), _HOT, np.int32)))], columns=["home", "owners", "sizes", "who", "keys", "df"])
        order = np.argsort(keys)
        keys, who = keys[order], who[order]
        same = keys[1:] == keys[:-1]
        more = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        keys, who = keys[more], who[more]
        order = np.lexsort((who, keys))
        keys, who = keys[order], who[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (who[1:] != who[:-1])
        keys, who = keys[new], who[new]
        _, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
        df = n[inverse].astype(np.int32)
        keys, who, df = keys[df > 1], who[df > 1], df[df > 1]
        home = (who.astype(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        cuts = np.searchsorted(home[order], np.arange(buckets + 1))
        rows = [(b, None, None, _packed(who[o]), _packed(keys[o]), _packed(df[o])) for b in range(buckets) if len(o := order[cuts[b] : cuts[b + 1]])]
        return pd.DataFrame(rows, columns=["home", "owners", "sizes", "who", "keys", "df"])

    return packed.groupBy("bucket").applyInPandas(count, "home int, owners binary, sizes binary, who binary, keys binary, df binary")


def candidates(counts: DataFrame) -> DataFrame:
    """owner, n, keys (shingles that other sets hold too) and prefix (the rarest of them, one of which any partner
    shares) of the sets that may have a partner."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        owners, sizes = _joined(pdf["owners"]), _joined(pdf["sizes"])
        who, keys, df = _joined(pdf["who"]), _joined(pdf["keys"]), _joined(pdf["df"], np.int32)
        order = np.lexsort((keys, df, who))
        who, keys = who[order], keys[order]
        at = np.argsort(owners)
        owners, sizes = owners[at], sizes[at]
        begin, end = np.searchsorted(who, owners), np.searchsorted(who, owners, side="right")
        spare = sizes - needed(sizes) + 1 - (sizes - (end - begin))  # the prefix, without shingles of this set alone
        rows = [(int(owners[i]), int(sizes[i]), keys[begin[i] : end[i]], keys[begin[i] : begin[i] + spare[i]]) for i in np.flatnonzero((spare > 0) & (end > begin))]
        return pd.DataFrame(rows, columns=["owner", "n", "keys", "prefix"])

    return counts.groupBy("home").applyInPandas(choose, "owner long, n long, keys array<long>, prefix array<long>")


class Family:
    """The sets of a family in one task, with the components that are known so far."""

    def __init__(self, pdf: pd.DataFrame, percent: int = PERCENT):
        self.percent, self.owners, self.n = percent, pdf["owner"].to_numpy(), pdf["n"].to_numpy()
        self.lens = np.array([len(k) for k in pdf["keys"]])
        names, self.flat = np.unique(np.concatenate(pdf["keys"].to_list()), return_inverse=True)
        self.starts = np.cumsum(self.lens) - self.lens
        self.mark = np.zeros(len(names), bool)
        self.label = np.arange(len(pdf))
        if "root" in pdf:
            known = np.flatnonzero(pdf["root"].notna())
            _, first, which = np.unique(pdf["root"].iloc[known].to_numpy(np.int64), return_index=True, return_inverse=True)
            self.label[known] = known[first][which]
        self.links: list[tuple[int, int]] = []

    def common(self, x: int, others: np.ndarray) -> np.ndarray:
        """Shingles that x shares with each of the others."""
        own = self.flat[self.starts[x] : self.starts[x] + self.lens[x]]
        lens = self.lens[others]
        begin = np.cumsum(lens) - lens
        at = np.arange(lens.sum()) + np.repeat(self.starts[others] - begin, lens)
        self.mark[own] = True
        both = np.add.reduceat(self.mark[self.flat[at]].astype(np.int64), begin)
        self.mark[own] = False
        return both

    def link(self, x: int, y: int) -> None:
        if self.label[x] != self.label[y]:
            self.links.append((int(self.owners[x]), int(self.owners[y])))
            self.label[self.label == self.label[y]] = self.label[x]

    def linked(self, both: np.ndarray, x: int, others: np.ndarray) -> np.ndarray:
        return 100 * both >= self.percent * (self.n[others] + self.n[x] - both)

    def join(self) -> list[tuple[int, int]]:
        """Links that hold the components together.

        Rounds of pivots: every live set within the threshold of a pivot is in the region of its nearest one. A set that
        links to a member of a region is at most twice the threshold from its pivot: those, of other components, are
        compared with the members. Then the regions' sets have met all they can link to and leave.
        """
        live = np.arange(len(self.owners))
        pivots = INNER
        while len(live) and (self.label[live] != self.label[live[0]]).any():
            size = np.bincount(self.label[live], minlength=len(self.owners))
            chosen = live[np.lexsort((self.owners[live], -size[self.label[live]]))][:pivots]
            best, home = np.full(len(live), np.inf), np.full(len(live), -1)
            near = []
            for k, p in enumerate(chosen.tolist()):
                both = self.common(p, live)
                d = 1 - both / (self.n[live] + self.n[p] - both)
                within = self.linked(both, p, live)
                d[live == p], within[live == p] = 0, True  # its keys are only those that others hold too
                for x in live[within & (self.label[live] != self.label[p])].tolist():
                    self.link(p, x)
                closer = within & (d < best)
                best[closer], home[closer] = d[closer], k
                near.append(live[d <= 2 * (1 - self.percent / 100) + 1e-9])
            for k, p in enumerate(chosen.tolist()):
                region = live[home == k]
                if not len(region):
                    continue
                for y in near[k].tolist():
                    if self.label[y] != self.label[p]:
                        hit = np.flatnonzero(self.linked(self.common(y, region), y, region))
                        if len(hit):
                            self.link(int(region[hit[0]]), y)
            live = live[home < 0]
            pivots *= 2
        return self.links


def linked_in(pdf: pd.DataFrame, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that hold a small family's components together, found exactly.

    Sets of one ``root`` are known to be in one component; null: nothing is known.
    """
    return Family(pdf, percent).join()


def _families(members: DataFrame, percent: int) -> DataFrame:
    """Links of small families: rows family, owner, n, keys (and root)."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(linked_in(pdf, percent) if len(pdf) > 1 else [], columns=["a", "b"], dtype="int64")

    return members.groupBy("family").applyInPandas(join, "a long, b long")


def grouped(by_key: DataFrame, keys: list[str]) -> DataFrame:
    """owner and family of the sets that share a key with another one, transitively."""
    first = by_key.groupBy(*keys).agg(F.min("owner").alias("a"), F.count("*").alias("m")).filter("m > 1").drop("m")
    stars = by_key.join(first, keys).select("a", F.col("owner").alias("b")).filter("a <> b").distinct()
    return components(stars).select(F.col("node").alias("owner"), F.col("root").alias("family"))


def links(sets: DataFrame) -> DataFrame:
    """Links (a, b) between candidate sets, enough for their components; exact whatever the families' sizes."""
    family = grouped(sets.select(F.explode("prefix").alias("key"), "owner"), ["key"])
    return linked(sets.select("owner", "n", "keys").join(family, "owner"), PERCENT)


def split(large: DataFrame, percent: int) -> DataFrame:
    """family, owner, n, keys of sets in families anew, without the sets that can't have a partner in their family.

    All partners of a set are in its family, so a shingle that no other set of the family holds joins nothing, however many
    hold it elsewhere. Counted within the family, fewer shingles are shared, and the rarest of them, one of which partners
    share, hold fewer sets together. Exact, and linear in the shingles."""
    each = large.select("family", "owner", "n", F.explode("keys").alias("key"))
    shared = each.groupBy("family", "key").agg(F.count("*").alias("df")).filter("df > 1")
    told = each.join(shared, ["family", "key"]).groupBy("family", "owner").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "key"))).alias("rare"))
    spare = F.size("rare") - F.ceil(F.col("n") * percent / 100) + 1
    sets = saved(told.select("family", "owner", "n", F.col("rare.key").alias("keys"), spare.cast("int").alias("spare")).filter("spare > 0"), forget=True)
    anew = grouped(sets.select("family", "owner", F.explode(F.slice("keys", F.lit(1), F.col("spare"))).alias("key")), ["family", "key"])
    return sets.select("owner", "n", "keys").join(anew, "owner")


def linked(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that hold the components within families together: rows family, owner, n, keys."""
    small, large = _by_size(members)
    out = saved(_families(small, percent), forget=True)
    step = 0
    while True:
        large = saved(large, forget=True)
        if large.isEmpty():
            return out
        small, large = _by_size(split(large.drop("size"), percent))
        out = out.unionByName(saved(_families(small, percent), forget=True))
        large = saved(large, forget=True)
        if large.isEmpty():
            return out
        more, large = _voronoi(large, step, percent)
        out = out.unionByName(saved(more, forget=True))
        small, large = _by_size(large.drop("size"))
        out = out.unionByName(saved(_families(small, percent), forget=True))
        step += 1


def _by_size(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of families that one task joins, and of larger ones (with their size)."""
    members = saved(members, forget=True)
    sizes = saved(members.groupBy("family").agg(F.count("*").alias("size")), forget=True)
    return members.join(sizes.filter(F.col("size") <= FAMILY).drop("size"), "family", "left_semi"), members.join(sizes.filter(F.col("size") > FAMILY), "family")


def _met(large: DataFrame, step: int, percent: int) -> DataFrame:
    """What each set of a large family has to do with its pivots: home (the nearest within the threshold), to (those that
    it links to), near (others that a link may lead past).

    About PIVOTS * GROWTH ** step sets a family are pivots, chosen by hash where they stand. A family's sets are dealt to
    parts of FAMILY and its pivots to parts of FAMILY / 4; each two parts meet in one task.
    """
    want = PIVOTS * GROWTH**step
    sets = large.withColumns({"chunks": F.ceil(F.col("size") / FAMILY).cast("int"), "parts": F.ceil(F.least(F.lit(want), F.col("size")) * 4 / FAMILY).cast("int"), "_draw": F.pmod(F.xxhash64("owner", F.lit(step)), F.col("size"))})
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("owner", F.lit(n), F.lit(step)), F.col(n)).cast("int")
    pivots = sets.filter(F.col("_draw") < want).withColumn("part", own("parts")).select("family", every("chunks").alias("chunk"), "part", "owner", "n", "keys", F.lit(True).alias("pivot"))
    others = sets.withColumn("chunk", own("chunks")).select("family", "chunk", every("parts").alias("part"), "owner", "n", "keys", F.lit(False).alias("pivot"))
    far = 2 * (1 - percent / 100) + 1e-9

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = Family(pdf, percent)
        members, chosen = np.flatnonzero(~pdf["pivot"]), np.flatnonzero(pdf["pivot"])
        best, home = np.full(len(members), np.inf), np.zeros(len(members), np.int64)
        to: list[list[int]] = [[] for _ in members]
        near: list[list[int]] = [[] for _ in members]
        for p in chosen.tolist() if len(members) else []:
            name = int(cell.owners[p])
            both = cell.common(p, members)
            d = 1 - both / (cell.n[members] + cell.n[p] - both)
            within, itself = cell.linked(both, p, members), cell.owners[members] == name
            d[itself], within[itself] = 0, True  # its keys may be only those that others hold too
            for x in np.flatnonzero(within & ~itself).tolist():
                to[x].append(name)
            for x in np.flatnonzero(~within & (d <= far)).tolist():
                near[x].append(name)
            closer = within & ((d < best) | ((d == best) & (name < home)))
            best[closer], home[closer] = d[closer], name
        return pd.DataFrame({"owner": cell.owners[members], "d": best, "home": home, "to": pd.Series(to, dtype=object), "near": pd.Series(near, dtype=object)})

    met = pivots.unionByName(others).groupBy("family", "chunk", "part").applyInPandas(meet, "owner long, d double, home long, to array<long>, near array<long>")
    told = met.groupBy("owner").agg(F.min(F.when(F.col("d") <= 1, F.struct("d", "home"))).alias("best"), F.flatten(F.collect_list("to")).alias("to"), F.flatten(F.collect_list("near")).alias("near"))
    return told.select("owner", F.col("best.home").alias("home"), "to", "near")


def _voronoi(large: DataFrame, step: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """One round of pivots in large families (with their size): the links found, and the sets outside all regions."""
    seen = saved(_met(large, step, percent), forget=True)
    out = seen.select(F.explode("to").alias("a"), F.col("owner").alias("b"))
    # a set that links to pivots of two regions makes them one component: pairs across these need no comparison
    roots = components(seen.filter("home is not null").select(F.col("home").alias("a"), F.explode("to").alias("b")).distinct())
    region = seen.filter("home is not null").groupBy("home").agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("size") / FAMILY).cast("int"))
    region = saved(region.join(roots.withColumnRenamed("node", "home"), "home", "left").withColumn("root", F.coalesce("root", "home")), forget=True)
    placed = seen.join(region.select("home", "root", "blocks"), "home", "left")
    # boundary sets meet a region only where the triangle inequality allows a link: up to twice the threshold away.
    # Of a pair with regions on both sides, the end in the region of the larger root goes to the other's
    border = placed.select("owner", F.col("root").alias("own"), F.explode("near").alias("home")).join(region.select("home", "root", "blocks"), "home").filter("own is null or root < own")
    border = saved(border, forget=True)
    chunks = saved(border.groupBy("home").agg(F.ceil(F.count("*") / FAMILY).cast("int").alias("chunks")), forget=True)
    border = border.join(chunks, "home").withColumn("chunk", F.pmod(F.xxhash64("owner"), F.col("chunks")).cast("int"))
    inner = placed.filter("home is not null").join(chunks, "home").select("owner", "home", F.pmod(F.xxhash64("owner"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "root")
    outer = border.select("owner", "home", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "chunk", F.col("own").alias("root"))
    cells = inner.unionByName(outer).withColumn("family", F.xxhash64("home", "block", "chunk")).select("owner", "family", "root")
    out = out.unionByName(_families(cells.join(large.select("owner", "n", "keys"), "owner"), percent))
    return out, large.join(seen.filter("home is null").select("owner"), "owner", "left_semi")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reached by links, its own included) for every row.

    Null, empty and blank texts have no shingles and stand alone. Repeated rows link, having equal sets. Whole texts of
    any length count. Rows without a doc_id are joined too; a component without any doc_id has none. Empty tables give
    no rows. Names of sets and shingles are 64-bit hashes.
    """
    docs = docs.select("doc_id", "text")
    seen = saved(survey(docs))
    told = seen.filter("common is null")
    total = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
    buckets = max(LEAST_BUCKETS, -(-(total["bytes"] or 0) // BUCKET))
    common = seen.filter("common is not null").groupBy("common").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(64, total["n"] // COMMON))
    hot = np.array([r["common"] for r in common.orderBy(F.desc("n"), "common").limit(MOST_COMMON).collect()], np.int64).view(np.uint64)
    sets = saved(candidates(counted(dealt(docs, hot, buckets), buckets)))
    return labelled(told, components(links(sets)), total["n"])


def labelled(told: DataFrame, roots: DataFrame, rows: int) -> DataFrame:
    """doc_id, n_shingles, component_id of rows doc_id, n, owner, by the owners' roots (node, root; alone if missing)."""
    rooted = saved(told.join(roots.withColumnRenamed("node", "owner"), "owner", "left").withColumn("root", F.coalesce("root", "owner")))
    ids = saved(rooted.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("_rows")))
    # a component may hold a third of all rows: the HOT largest at most are broadcast, so that no task gets all rows of one
    many = F.col("_rows") > F.lit(max(1, rows // HOT))
    large = ids.filter(many).select("root", F.col("component_id").alias("_large"), F.lit(True).alias("_is_large"))
    told = rooted.join(F.broadcast(large), "root", "left")
    rest = told.filter("n > 0 and _is_large is null").select("doc_id", "n", "root").join(ids.filter(~many), "root", "left")
    known = told.filter("n = 0 or _is_large").select("doc_id", "n", F.when(F.col("n") > 0, F.col("_large")).otherwise(F.col("doc_id")).alias("component_id"))
    return known.unionByName(rest.select("doc_id", "n", "component_id")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
