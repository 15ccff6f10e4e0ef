"""The registered queries of the subpackage and, where SQL can express one, its equivalent."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, licenses, line_crf, line_dedup, mixing, quality_rules, simhash, topk, toxicity, url_filter
from quarry.plans import skew

TOKENIZER = "word_bpe_49k.json"
#: Chunks that a worker of the encoder keeps.
KEPT_CHUNKS = 500_000
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules.quality(_table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), RULES)


def op3_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return line_crf.score(docs, line_crf.train(docs, _table(spark, sf_dir, "labels")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), ids=False, keep=KEPT_CHUNKS)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = F.sha2(F.encode("text", "UTF-8"), 256)
    return d.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), sha.alias("kept_sha256"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality_rules, op2_url_filters, op3_entropy_mixing, op4_line_crf, op5_license_scan, op6_toxicity, op7_bpe, op8_line_dedup, op9_topk_search, op10_simhash]
    return {f.__name__: f for f in found}


_WORD = "[^\\x20\\x09-\\x0D]+"
_UPPER, _LOWER = url_filter.UPPER, url_filter.LOWER

def _op1() -> str:
    q = quality_rules
    wide = lambda c: re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", c).replace("'", "''")
    marks = ", ".join(f"length(regexp_replace(text, '{wide(c)}', '', 'g'))" for c in (*q.CLASSES, *q.SCRIPTS))
    commons = ", ".join(f"'{w}'" for w in q.WORDS)
    half = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ((p + q) / 2)) ELSE 0 END"
    distance = f"sqrt(greatest(sum({half('p')} + {half('q')}) / 2, 0))"
    window = f"list_slice(words, i, i + {q.WINDOW - 1})"
    return f"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents
), c AS (
  SELECT *, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars, [{marks}, strlen(text) - length(text)]::BIGINT[] AS marks,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines, list_filter(words, lambda w: list_contains([{commons}], w)) AS known FROM d
), w AS (
  SELECT r, i, {window} AS w FROM c, unnest(range(1, greatest(1, n_words - {q.WINDOW - 2}))) AS u(i) WHERE n_words > {q.WINDOW}
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM w) WHERE n > 1
), covered AS (
  SELECT r, sum(step)::BIGINT AS n FROM (SELECT r, least({q.WINDOW}, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, {q.WINDOW})) AS step FROM again) GROUP BY r
), b AS (
  SELECT c.*, marks[{q.SYMBOLS + 1}] AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    list_append(marks, (strlen(text) - list_sum(marks))::BIGINT) AS classes,
    list_append(list_transform([{commons}], lambda v: len(list_filter(known, lambda w: w = v))), n_words - len(known)) AS commons FROM c LEFT JOIN covered USING (r)
), h AS (
  SELECT r, lang, kind, i, hist[i] AS c, list_sum(hist) AS total, i = len(hist) AS last
  FROM (SELECT r, lang, 'class' AS kind, classes AS hist FROM b UNION ALL SELECT r, lang, 'word', commons FROM b), unnest(range(1, len(hist) + 1)) AS u(i)
), ref AS (
  SELECT lang, kind, i, last, sum(c) AS c, sum(sum(c)) OVER (PARTITION BY lang, kind) AS total FROM h GROUP BY lang, kind, i, last
), js AS (
  SELECT r, kind, {distance} AS far FROM (
    SELECT h.r, h.kind, h.c / h.total AS p, ref.c / ref.total AS q FROM h JOIN ref ON h.lang IS NOT DISTINCT FROM ref.lang AND h.kind = ref.kind AND h.i = ref.i WHERE h.total > 0) GROUP BY r, kind
), share AS (
  SELECT lang, 1 - rest AS share, sqrt(greatest((log2(2 / (1 + rest)) + (1 - rest) + CASE WHEN rest > 0 THEN rest * log2(2 * rest / (1 + rest)) ELSE 0 END) / 2, 0)) AS bare
  FROM (SELECT lang, c / total AS rest FROM ref WHERE kind = 'word' AND last AND total > 0)
), k AS (
  SELECT b.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, strlen(text) >= {q.MIN_BYTES} AND coalesce(jc.far, 0) > {q.MAX_CLASS_DISTANCE} AS class_far,
    n_words >= {q.MIN_WORDS} AND coalesce(jw.far, 0) > least({q.MAX_WORD_DISTANCE}, CASE WHEN n_words * share >= {q.MIN_EXPECTED} THEN {q.NO_COMMON} * bare END) AS word_far
  FROM b LEFT JOIN js jc ON jc.r = b.r AND jc.kind = 'class' LEFT JOIN js jw ON jw.r = b.r AND jw.kind = 'word' LEFT JOIN share ON share.lang IS NOT DISTINCT FROM b.lang
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT class_far AND NOT word_far AS kept FROM k
"""


_OP2 = f"""
WITH RECURSIVE p AS (
  SELECT page_id, html, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), q AS (
  SELECT page_id, html, url, coalesce(translate(regexp_extract(rest, '(?s)^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') AS host,
    coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path FROM p
), rules AS (
  SELECT unnest(['com/', 'example.com/en/', 'www.example.com/en/', 'net/es/', 'net/fr/']) AS rule, unnest(['allow', 'block', 'allow', 'block', 'block']) AS verdict
), parts AS (
  SELECT rule, verdict, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS t FROM rules
), matched AS (
  SELECT q.page_id, q.host, q.path, q.url, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM q JOIN parts ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, t) GROUP BY ALL
)
SELECT q.page_id, q.host, q.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM q LEFT JOIN matched m ON m.page_id = q.page_id AND m.url IS NOT DISTINCT FROM q.url
"""


def _rounded(own: str, goal: str, name: str, table: str) -> str:
    """One step of systematic rounding: adds the whole copies of each size, from the start that comes nearest to the goal."""
    unit = mixing.UNIT
    starts = [unit * (2 * i + 1) // (2 * mixing.OFFSETS) for i in range(mixing.OFFSETS)]
    at = lambda u: f"((upto + {u}) // {unit} - (upto - {own} + {u}) // {unit})"
    tried = ", ".join(f"{{'off': round(abs(coalesce(sum({at(u)} * size) OVER w, 0)::DOUBLE - goal), 3), 'u': {u}::BIGINT}}" for u in starts)
    return f"""(
  SELECT * EXCLUDE (upto, goal, u), {at("u")} AS {name} FROM (
    SELECT *, list_min([{tried}]).u AS u FROM (
      SELECT *, {goal} AS goal, sum({own}) OVER (PARTITION BY source ORDER BY size DESC ROWS UNBOUNDED PRECEDING) AS upto FROM {table} WINDOW w AS (PARTITION BY source)
    ) WINDOW w AS (PARTITION BY source)
  ))"""


def _op3() -> str:
    unit, most = mixing.UNIT, mixing.MOST
    words = lambda c: f"coalesce(sum({c} * size) OVER w, 0)::DOUBLE"
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents
), kinds AS (
  SELECT doc_id, source, size, digest, count(*)::BIGINT AS m FROM d GROUP BY ALL
), hist AS (
  SELECT source, size, sum(m)::BIGINT AS n FROM kinds GROUP BY ALL
), s AS (
  SELECT source, sum(n)::BIGINT AS n_docs, sum(size * n)::BIGINT AS source_size FROM hist GROUP BY source
), w AS (
  SELECT *, ([5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, source_size * {most}::DOUBLE AS cap FROM s
), l AS (
  SELECT *, row_number() OVER o AS k,
    ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST)
), f AS (SELECT min(k) AS k, arg_min(level, k) AS level FROM l WHERE level * weight <= cap
), t AS (
  SELECT l.source, n_docs, source_size, CASE WHEN l.k < f.k OR f.k IS NULL THEN cap ELSE f.level * weight END AS target FROM l, f
), x AS (
  SELECT hist.source, n, size, target, size / (size + source_size / n_docs) AS x FROM hist JOIN t ON hist.source IS NOT DISTINCT FROM t.source
  WHERE source_size > 0 AND target > 0 AND target < source_size * {most}::DOUBLE
), newton AS (
  SELECT source, 0::BIGINT AS step, 0::DOUBLE AS mu, {-mixing.WIDEST}::DOUBLE AS low, {mixing.WIDEST}::DOUBLE AS high, true AS open FROM x GROUP BY source
  UNION ALL
  SELECT source, step + 1, moved, low, high, NOT done AND moved <> mu FROM (
    SELECT *, CASE WHEN done THEN mu WHEN mu - off / slope > low AND mu - off / slope < high THEN mu - off / slope ELSE (low + high) / 2 END AS moved FROM (
      SELECT source, step, mu, off, slope, CASE WHEN off < 0 THEN mu ELSE low END AS low, CASE WHEN off > 0 THEN mu ELSE high END AS high, abs(off) <= {mixing.RESIDUAL}::DOUBLE * target AS done FROM (
        SELECT i.source, step, mu, low, high, target, sum(n * size * exp(least(mu * x, ln({most}::DOUBLE)))) - target AS off,
          nullif(sum(CASE WHEN mu * x < ln({most}::DOUBLE) THEN n * size * x * exp(mu * x) END), 0) AS slope
        FROM newton i JOIN x ON i.source IS NOT DISTINCT FROM x.source WHERE open AND step < {mixing.STEPS} GROUP BY i.source, step, mu, low, high, target)))
), mu AS (
  SELECT source, round(arg_max(mu, step), 9) AS mu FROM newton GROUP BY source
), r AS (
  SELECT h.source, size, n, n_docs, source_size, target, floor({unit} * CASE WHEN size = 0 THEN 1 WHEN target <= 0 THEN 0 WHEN target >= source_size * {most}::DOUBLE THEN {most}
    ELSE least({most}::DOUBLE, exp(coalesce(mu, 0) * (size / (size + source_size / n_docs)))) END + 0.5::DOUBLE)::HUGEINT AS rate
  FROM hist h JOIN t ON h.source IS NOT DISTINCT FROM t.source LEFT JOIN mu ON h.source IS NOT DISTINCT FROM mu.source
), a AS (
  SELECT *, size * {mixing.HEAVY} > source_size AS heavy, CASE WHEN size * {mixing.HEAVY} > source_size THEN rate * n END AS own FROM r
), b AS {_rounded("own", words("own") + f" / {unit}", "first_copies", "a")}, c AS (
  SELECT *, CASE WHEN heavy THEN NULL WHEN size = 0 THEN rate * n
    ELSE n * floor(least({most * unit}::DOUBLE, rate * coalesce(round(greatest(0, rest / nullif(light, 0)), 9), 0)) + 0.5::DOUBLE)::HUGEINT END AS own2
  FROM (SELECT *, target - {words("first_copies")} AS rest, {words("CASE WHEN NOT heavy THEN rate * n END")} / {unit} AS light FROM b WINDOW w AS (PARTITION BY source))
), e AS {_rounded("own2", "rest", "rest_copies", "c")}, classes AS (
  SELECT source, size, n, source_size, target, coalesce(first_copies, rest_copies)::HUGEINT AS copies, CASE WHEN n * {skew.PARTS} > sum(n) OVER () AND n > {skew.FEW} THEN ceil(n / {mixing.BUCKET}::DOUBLE)::BIGINT ELSE 1 END AS parts FROM e
), k AS (
  SELECT kinds.*, n, source_size, target, copies, md5(coalesce(doc_id::VARCHAR, '') || ' ' || digest) AS pos,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || digest), 1, 8))::BIGINT % parts AS part
  FROM kinds JOIN classes c ON kinds.source IS NOT DISTINCT FROM c.source AND kinds.size = c.size
), p AS (
  SELECT source, size, part, n, copies, sum(m) AS np FROM k GROUP BY ALL
), q AS (
  SELECT source, size, part, np, copies * sum(np) OVER o // n - copies * (sum(np) OVER o - np) // n AS part_copies FROM p WINDOW o AS (PARTITION BY source, size ORDER BY part ROWS UNBOUNDED PRECEDING)
), v AS (
  SELECT k.*, part_copies * sum(m) OVER o // np - part_copies * (sum(m) OVER o - m) // np AS together
  FROM k JOIN q ON k.source IS NOT DISTINCT FROM q.source AND k.size = q.size AND k.part = q.part
  WINDOW o AS (PARTITION BY k.source, k.size, k.part ORDER BY pos, doc_id ROWS UNBOUNDED PRECEDING)
), y AS (SELECT *, unnest(range(1, m + 1)) AS j FROM v)
SELECT doc_id, size, source_size, target, ((together * j // m - together * (j - 1) // m) * size)::BIGINT AS taken FROM y
"""


_OP8 = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, r, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l
), bad AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.*, bad.key IS NOT NULL AND k.doc_id IS DISTINCT FROM bad.last AS gone FROM k LEFT JOIN bad USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id, r
"""

_OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _op1(), "op2_url_filters": _OP2, "op3_entropy_mixing": _op3(), "op8_line_dedup": _OP8, "op9_topk_search": _OP9}
