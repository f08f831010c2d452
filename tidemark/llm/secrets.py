"""Secret scanning in DataFrame functions only: fixed patterns, and a battery of randomness tests for other tokens.

Patterns give the base spans. Besides, every run of 20 or more encoding characters is a candidate ('=' only ends one, so
names before '=' stay apart), and so is each part of 20 or more between '_', '-' and '/' in it. For its inferred encoding (hex, base32, base62, base64) it must look uniformly random: its letters in a
chi-squared test, the runs of its character classes, and the serial correlation of neighbours. How unlikely ordinary
text would make it is bounded by the likelihood ratio of the two models, which grows with length; these bounds go
through a Benjamini-Hochberg step-up in each length band, over all candidates of the table, so that the share of
false finds stays under ``rate`` in short and long tokens alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, saved, unboxed

KINDS = ("assign", "access", "hex", "random")
PATTERNS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{24,}",
    "random": r"[A-Za-z0-9+/_-]{20,}={0,2}",
    "part": r"(?<=[/_-])[A-Za-z0-9+]{20,}={0,2}|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+]{20,}+(?=[/_-])",  # never all of a run
}
LEAST = {"assign": 6, "access": 20}
#: Marks that no pattern matches stand around matches; where a text holds them itself, another such character does.
OPEN, CLOSE, OTHER = "\ue000", "\ue001", "\ue002"
#: Length bands from these lengths on, whole bits of evidence counted at most, and the rate of false finds.
BANDS, MOST_BITS, RATE = (20, 32, 64, 128), 400, 0.001
#: Standard deviations beyond which a test rejects randomness.
LIMIT = 3.3
BLOCK = 1000


def _ends(parts: Column) -> Column:
    """Running sum of the parts' lengths, in blocks, so that many matches in one text stay cheap."""
    lens = F.transform(parts, F.length)
    blocks = F.transform(F.sequence(F.lit(0), ((F.size(parts) - 1) / BLOCK).cast("int")), lambda b: F.slice(lens, b * BLOCK + 1, F.lit(BLOCK)))
    grown = lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x))
    bases = F.aggregate(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x)), F.array(F.lit(0)), grown)
    return F.flatten(F.zip_with(blocks, F.slice(bases, F.lit(1), F.size(blocks)), lambda b, base: F.slice(F.aggregate(b, F.array(base), grown), F.lit(2), F.size(b))))


def _matches(docs: DataFrame, kind: str) -> DataFrame:
    """Adds ``_<kind>``: start, end and text of each match, in code points."""
    marked = F.regexp_replace("_clean", F.lit(PATTERNS[kind]), F.lit(f"{OPEN}$0{CLOSE}"))
    docs = docs.withColumn("_marked", marked)
    docs = docs.withColumn("_parts", F.when(F.instr("_marked", OPEN) > 0, F.split("_marked", f"[{OPEN}{CLOSE}]", -1)))
    docs = docs.withColumn("_ends", F.when(F.col("_parts").isNotNull(), _ends(F.col("_parts"))))
    at = lambda name, i: F.element_at(F.col(name), i)
    spans = F.transform(F.sequence(F.lit(2), F.size("_parts") - 1, F.lit(2)), lambda i: F.struct(at("_ends", i - 1).alias("start"), at("_ends", i).alias("end"), at("_parts", i).alias("text")))
    keep = {
        "assign": lambda x: F.length(F.regexp_extract(x["text"], PATTERNS["assign"], 2)) >= LEAST["assign"],
        "access": lambda x: F.length(x["text"]) >= LEAST["access"],
        "hex": lambda x: F.lit(True),
        "random": lambda x: F.lit(True),
        "part": lambda x: F.lit(True),
    }[kind]
    empty = F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)")
    return docs.withColumn(f"_{kind}", F.coalesce(F.filter(spans, keep), empty)).drop("_marked", "_parts", "_ends")


def _tested(token: Column) -> Column:
    """start, end, band and bits of evidence (0 where a test rejects randomness) of one candidate."""
    text = F.rtrim(token["text"], F.lit("="))
    n = F.length(text).cast("double")
    alphabet = F.when(text.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(text.rlike("^[A-Z2-7]+$"), 32).when(text.rlike("^[A-Za-z0-9]+$"), 62).otherwise(64).cast("double")
    chars = F.transform(F.split(text, ""), lambda x: F.ascii(x).cast("double"))
    group = lambda c: F.when(c.between(48, 57), 10).when(c.between(65, 90) | c.between(97, 122), 26).otherwise(4)
    kind = lambda c: F.when(c.between(48, 57), 0).when(c.between(65, 90), 1).when(c.between(97, 122), 2).otherwise(3)
    total = lambda array, of: F.aggregate(array, F.lit(0.0), lambda s, x: s + of(x))
    stats = F.struct(n.alias("n"), alphabet.alias("a"), chars.alias("c"))

    def means(s: Column) -> Column:  # a step of its own: what a lambda holds is computed again for each element
        return F.struct(s["c"].alias("c"), s["n"].alias("n"), s["a"].alias("a"), (total(s["c"], lambda x: x) / s["n"]).alias("mean"))

    def judged(s: Column) -> Column:
        c, n, a, mean = s["c"], s["n"], s["a"], s["mean"]
        squares = total(F.array_distinct(c), lambda x: F.pow(F.size(F.filter(c, lambda y: x == y)), F.lit(2.0)))
        chi = (a / n * squares - n - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)
        pairs = F.arrays_zip(F.slice(c, F.lit(1), F.size(c) - 1).alias("x"), F.slice(c, F.lit(2), F.size(c) - 1).alias("y"))
        switches = total(pairs, lambda p: (kind(p["x"]) != kind(p["y"])).cast("double"))
        q = F.when(a == 16, 0.469).when(a == 32, 0.305).when(a == 62, 0.622).otherwise(0.643)  # 1 - sum of squared shares of the classes
        runs = (switches - (n - 1) * q) / F.sqrt((n - 1) * q * (1 - q))
        spread = total(c, lambda x: (x - mean) * (x - mean))
        serial = F.when(spread > 0, total(pairs, lambda p: (p["x"] - mean) * (p["y"] - mean)) / spread * F.sqrt(n)).otherwise(99.0)
        # ordinary text keeps its class of characters 92 times in 100, and draws within it
        bits = -n * F.log2(a) + (n - 1 - switches) * 0.12 + switches * 5.23 + total(c, lambda x: F.log2(group(x).cast("double")))
        random = (chi < LIMIT) & (chi > -LIMIT) & (runs > -LIMIT) & (F.abs(serial) < LIMIT)
        band = sum(((n >= b).cast("int") for b in BANDS[1:]), F.lit(0))
        return F.struct(band.alias("band"), F.when(random, F.greatest(F.lit(0), F.least(F.floor(bits), F.lit(MOST_BITS)))).otherwise(0).cast("int").alias("bits"))

    verdict = F.element_at(F.transform(F.transform(F.array(stats), means), judged), 1)
    return F.struct(token["start"].alias("start"), token["end"].alias("end"), verdict["band"].alias("band"), verdict["bits"].alias("bits"))


def findings(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_assign``, ``_access``, ``_hex`` (spans with their text) and ``_maybe`` (tested candidates) added."""
    out = docs.withColumn("_clean", F.translate(F.coalesce(F.col(text), F.lit("")), OPEN + CLOSE, OTHER + OTHER))
    for kind in PATTERNS:
        out = _matches(out, kind)
    return out.withColumn("_maybe", F.transform(F.concat("_random", "_part"), _tested)).drop("_clean", "_random", "_part")


def cutoffs(found: DataFrame, rate: float = RATE) -> dict[int, int]:
    """Bits from which candidates of a length band count as secrets: Benjamini and Hochberg's step-up in each band.

    What comes to the driver is a histogram of at most len(BANDS) * (MOST_BITS + 1) rows.
    """
    rows = found.select(F.explode("_maybe").alias("m")).groupBy("m.band", "m.bits").count().collect()
    out = {}
    for band in {r["band"] for r in rows}:
        counts = sorted(((r["bits"], r["count"]) for r in rows if r["band"] == band), reverse=True)
        tested, reached = sum(n for _, n in counts), 0
        for bits, n in counts:
            reached += n
            if bits and 2.0**-bits <= rate * reached / tested:
                out[band] = bits
    return out


def spans(found: DataFrame, cut: dict[int, int]) -> DataFrame:
    """``found`` with ``_base`` and ``_spans``: arrays of start, k (place in KINDS) and end, in that order.

    A part of a run that counts as a whole is left out.
    """
    as_base = lambda kind: F.transform(f"_{kind}", lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), x["end"].alias("end")))
    out = found.withColumn("_base", F.array_sort(F.concat(as_base("assign"), as_base("access"), as_base("hex"))))
    held = F.filter("_maybe", lambda m: _passes(m, cut))
    fresh = F.filter(held, lambda m: ~F.exists("_base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    out = out.withColumn("_fresh", fresh)
    whole = F.filter("_fresh", lambda m: ~F.exists("_fresh", lambda o: (o["start"] <= m["start"]) & (m["end"] <= o["end"]) & (o["end"] - o["start"] > m["end"] - m["start"])))
    more = F.transform(whole, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index("random")).alias("k"), m["end"].alias("end")))
    return out.withColumn("_spans", F.array_sort(F.concat("_base", more))).drop("_fresh")


def _passes(m: Column, cut: dict[int, int]) -> Column:
    out = F.lit(False)
    for band, bits in cut.items():
        out = out | ((m["band"] == band) & (m["bits"] >= bits))
    return out


def _told(array: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for every row of ``docs``.

    Null or empty texts have no spans (the hash is that of the empty string). Positions are code points, the end
    exclusive. Spans of different kinds may overlap; random ones that overlap a base span are left out. Repeated rows are
    judged alike; each counts as a test. The texts are scanned once: what was found, without them, is checkpointed.
    """
    slim = [F.transform(f"_{k}", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(f"_{k}") for k in KINDS[:3]]
    found = saved(findings(docs.select("doc_id", "text")).select("doc_id", *slim, "_maybe"))
    out = spans(found, cutoffs(found, rate))
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return out.select("doc_id", *counts, F.sha2(_told("_base"), 256).alias("base_sha256"), _told("_spans").alias("spans"))


def redact(docs: DataFrame, mask: str = "[secret]", rate: float = RATE) -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by ``mask``; texts without spans stay as they are.

    Two scans: one for the cutoffs over all texts, one that applies them. Nothing is shuffled.
    """
    out = spans(findings(boxed(docs, "text")), cutoffs(findings(docs.select("text")), rate))
    begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        more = F.concat(acc["out"], F.array(F.substr(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.lit(mask)))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(F.col("text"), acc["at"] + 1, F.length("text")))
    out = out.withColumn("_clear", F.when(F.size("_spans") > 0, F.aggregate("_spans", begin, step, rest)).otherwise(F.col("text")))
    new = {"text": F.col("_clear")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("_spans") > 0, F.length("_clear").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return unboxed(out, docs.columns, ("text",), **new)
