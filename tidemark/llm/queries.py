"""The queries opN_<name>, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import fim, jaccard, language, lm, mixing, packing, quality, secrets, sharding, suffix, supermin, topk, variants
from tidemark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(table(spark, sf_dir, "documents"))


def op13_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supermin.group(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos,
         ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM per),
levelled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
             - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / sum(w) OVER (ORDER BY source_size / w, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM ranked),
goals AS (
  SELECT source, source_size,
         coalesce(least((SELECT arg_min(level, (source_size / w, pos)) FROM levelled WHERE level * w <= 2.0::DOUBLE * source_size) * w,
                        2.0::DOUBLE * source_size), 2.0::DOUBLE * source_size)::DOUBLE AS target
  FROM levelled),
ordered AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sizes)
SELECT o.doc_id, o.size, g.source_size, g.target,
       (CASE WHEN g.source_size > 0 THEN round(g.target)::BIGINT // g.source_size ELSE 0 END * o.size
        + least(greatest(round(g.target)::BIGINT - CASE WHEN g.source_size > 0 THEN round(g.target)::BIGINT // g.source_size ELSE 0 END * g.source_size - o.before, 0), o.size))::BIGINT AS taken
FROM ordered o JOIN goals g ON o.source IS NOT DISTINCT FROM g.source
"""

OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id) q JOIN v c ON c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
  SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS draw
  FROM d),
f AS (
  SELECT doc_id, text, units, len(units)::BIGINT AS n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR draw[3] % 100 >= 50 THEN 'plain'
              WHEN draw[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
         least(draw[1] % (len(units) + 1), draw[2] % (len(units) + 1)) AS one,
         greatest(draw[1] % (len(units) + 1), draw[2] % (len(units) + 1)) AS two
  FROM u),
p AS (
  SELECT *, array_to_string(units[1:one], '') AS prefix, array_to_string(units[one + 1:two], '') AS middle, array_to_string(units[two + 1:], '') AS suffix
  FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

OP12_SQL = r"""
WITH RECURSIVE poly AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS i)),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  GROUP BY ALL),
bytes AS (
  SELECT run, times, list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':', ''), lambda x: unicode(x)::BIGINT),
         flatten(list_transform(string_split(run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))) AS b
  FROM runs),
hashed AS (SELECT run, times, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS h FROM bytes, poly),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(times)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(times) >= 5),
cut AS (SELECT word, length(word) AS size, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word),
ranked AS (
  SELECT p.word, p.other, o.n AS on_, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY o.n DESC, p.other) AS rk
  FROM pairs p JOIN words o ON o.word = p.other),
formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0)::BIGINT AS n_near, CASE WHEN r.on_ >= 5 * w.n THEN r.other END AS form, CASE WHEN r.on_ >= 5 * w.n THEN r.on_ END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.rk = 1),
walk AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON f.word = walk.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN walk w ON w.word = f.word JOIN formed e ON e.word = w.at AND e.form IS NULL
"""

#: Shingle sets and links told in full; {shingle} words, {percent} of the union, {more} columns, {leads}: the next words, {parts}: their names.
LINKS_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
e AS (SELECT row, len(words) AS n, unnest(words) AS word, unnest(range(len(words))) AS i FROM w),
s AS (
  SELECT DISTINCT row, hash({parts}) AS shingle FROM (SELECT row, n, i, {leads} FROM e WINDOW o AS (PARTITION BY row ORDER BY i)) WHERE i <= n - {shingle}
  UNION ALL SELECT row, hash(words) FROM w WHERE len(words) BETWEEN 1 AND {shingle} - 1),
n AS (SELECT row, count(*) AS n FROM s GROUP BY row),
links AS (
  SELECT a.row AS x, b.row AS y FROM (SELECT s.*, n.n FROM s JOIN n USING (row)) a JOIN (SELECT s.*, n.n FROM s JOIN n USING (row)) b ON a.shingle = b.shingle AND a.row <> b.row AND 100 * a.n >= {percent} * b.n AND 100 * b.n >= {percent} * a.n
  GROUP BY a.row, b.row, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reach AS (SELECT x AS row, x AS at FROM links UNION SELECT reach.row, links.y FROM reach JOIN links ON links.x = reach.at),
least AS (SELECT row, min(doc_id) AS component_id FROM (SELECT reach.row, w.doc_id FROM reach JOIN w ON w.row = reach.at) GROUP BY row)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least.component_id, w.doc_id) AS component_id{more}
FROM w LEFT JOIN n USING (row) LEFT JOIN least USING (row)
"""


def links_sql(shingle: int, percent: int, more: str = "") -> str:
    names = [f"w{j}" for j in range(shingle)]
    leads = ", ".join(f"lead(word, {j}) OVER o AS w{j}" for j in range(shingle))
    return LINKS_SQL.format(shingle=shingle, percent=percent, more=more, parts=", ".join(names), leads=leads)


OP7_SQL = links_sql(jaccard.SHINGLE, jaccard.PERCENT)
OP13_SQL = links_sql(supermin.SHINGLE, supermin.PERCENT, ", coalesce(w.doc_id = coalesce(least.component_id, w.doc_id), false) AS kept")

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_lm_scoring, op3_suffix_dedup, op4_mixing, op5_language_id, op6_exact_topk, op7_jaccard_join, op8_quality_rules, op9_sharding, op10_secret_scan, op11_fill_in_middle, op12_spelling_variants, op13_superminhash)
}
ORACLES: dict[str, str] = {"op4_mixing": OP4_SQL, "op6_exact_topk": OP6_SQL, "op7_jaccard_join": OP7_SQL, "op11_fill_in_middle": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_superminhash": OP13_SQL}
