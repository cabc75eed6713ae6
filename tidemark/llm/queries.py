"""The corpus operators as queries over the test tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import audio, chunktable, innerproduct, jaccard, lines, middle, packing, pii, quality, runs, transducer, urls, warc
from tidemark.llm.tables import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_media_audio")
def op9_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.media_features(table(spark, sf_dir, "documents"), keep=False).drop("media", "tensors")


def _level_sql(order: int) -> str:
    """Smoothed probabilities of one order over all grams, as a DuckDB table p{order}."""
    size, below = urls.SYMBOLS, f"b.{{k}}" if order else f"1.0 / {urls.SYMBOLS}"
    p = ", ".join(
        f"CASE WHEN coalesce(c.n_{k}, 0) < {urls.LEAST_CONTEXT} THEN {below.format(k=k)} "
        f"ELSE (coalesce(n.{k}, 0) + c.kinds_{k} * {below.format(k=k)}) / (c.n_{k} + c.kinds_{k}) END AS {k}"
        for k in ("yes", "no")
    )
    return f"""n{order} AS (SELECT gram % {size ** (order + 1)} AS gram, sum(yes) AS yes, sum(no) AS no FROM seen GROUP BY 1),
c{order} AS (SELECT gram // {size} AS ctx, sum(yes) AS n_yes, sum(no) AS n_no, count(*) FILTER (yes > 0) AS kinds_yes,
  count(*) FILTER (no > 0) AS kinds_no FROM n{order} GROUP BY 1),
p{order} AS MATERIALIZED (SELECT g.gram, {p} FROM range({size ** (order + 1)}) AS g(gram) LEFT JOIN n{order} AS n ON n.gram = g.gram
  LEFT JOIN c{order} AS c ON c.ctx = g.gram // {size}{f" JOIN p{order - 1} AS b ON b.gram = g.gram % {size**order}" if order else ""})"""


def _rule_sql(value: str) -> str:
    """CASE over the rules, longest first."""
    rules = sorted(urls.RULES, key=lambda r: -len(r[0] + r[1]))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v if value == 'verdict' else h + p}'" for h, p, v in rules) + " END"


OP10_SQL = f"""
WITH r AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*', 0), '{urls.UPPER}', '{urls.LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
j AS (SELECT *, {_rule_sql("rule")} AS rule, {_rule_sql("verdict")} AS decided,
  chr(2) || chr(2) || translate(lower(coalesce(url, '')), '0123456789' || chr(2) || chr(3), '0000000000' || chr(1) || chr(1)) || chr(3) AS s,
  row_number() OVER () AS row FROM h),
k AS (SELECT *, list_transform(generate_series(1, length(s)), lambda i: strpos(chr(2) || chr(3) || '{urls.ALPHABET[2:]}', s[i])) AS c FROM j),
g AS MATERIALIZED (
  SELECT row, decided, unnest(list_transform(generate_series(3, len(c)), lambda i: c[i] + {urls.SYMBOLS} * c[i - 1] + {urls.SYMBOLS**2} * c[i - 2])) AS gram FROM k),
seen AS MATERIALIZED (SELECT gram, count(*) FILTER (decided = 'allow') AS yes, count(*) FILTER (decided = 'block') AS no FROM g WHERE decided IS NOT NULL GROUP BY 1),
{", ".join(_level_sql(k) for k in range(urls.ORDER + 1))},
m AS (SELECT gram, round(ln(yes) - ln(no), 6) AS ratio FROM p{urls.ORDER}),
s AS MATERIALIZED (SELECT row, floor(sum(CAST(round(ratio * 1000000) AS BIGINT)) / count(*)) / 1e6 AS score FROM g JOIN m USING (gram) GROUP BY 1),
b AS (SELECT CAST(floor(score / {urls.BIN}) AS BIGINT) AS bin, count(*) FILTER (decided = 'allow') AS yes, count(*) FILTER (decided = 'block') AS no
  FROM s JOIN j USING (row) WHERE decided IS NOT NULL GROUP BY 1),
t AS (SELECT bin, sum(yes) OVER (ORDER BY bin) AS below_yes, sum(no) OVER (ORDER BY bin) AS below_no, sum(yes) OVER () AS yes, sum(no) OVER () AS no,
  lead(bin) OVER (ORDER BY bin) AS nxt FROM b),
u AS (SELECT bin, round((yes - below_yes) / yes + below_no / no, 12) AS gain, (bin + 1 + nxt) / 2 * {urls.BIN} AS threshold FROM t WHERE nxt IS NOT NULL AND yes > 0 AND no > 0),
v AS (SELECT threshold, row_number() OVER (ORDER BY bin) - 1 AS i, count(*) OVER () AS n FROM u WHERE gain = (SELECT max(gain) FROM u)),
w AS (SELECT coalesce(max(threshold) FILTER (i = n // 2), 0.0) AS threshold FROM v)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.decided, CASE WHEN s.score >= w.threshold THEN 'allow' ELSE 'block' END) AS verdict, s.score, w.threshold
FROM j JOIN s USING (row) CROSS JOIN w
"""


@query("op10_url_markov", OP10_SQL)
def op10_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(table(spark, sf_dir, "pages"))


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op2_sentencepiece_chunks")
def op2_sentencepiece_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunktable.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=False).drop("ids", "decoded")


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op7_inner_products", OP7_SQL)
def op7_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return innerproduct.top_inner_products(vectors, vectors.where(F.col("vec_id") % 100 == 0))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (
  SELECT o.a, o.b FROM o JOIN n AS x ON x.doc_id = o.a JOIN n AS y ON y.doc_id = o.b WHERE 100 * o.o >= 75 * (x.n + y.n - o.o)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(c.b, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id
"""


@query("op8_ngram_jaccard", OP8_SQL)
def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@query("op1_line_dedup")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_groups(table(spark, sf_dir, "documents"))


@query("op3_quality_cotraining")
def op3_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP6_SQL = """
WITH r AS (
  SELECT page_id, CAST(floor(page_id / 500.0) AS BIGINT) AS file,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>'
    || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') AS body, chr(13) || chr(10) || chr(13) || chr(10) AS tail FROM pages),
l AS (SELECT *, CAST(octet_length(encode(body || tail)) AS BIGINT) AS length FROM r),
o AS (
  SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM l)
SELECT file, "offset", length AS first_length, sha256(body || tail) AS first_digest,
  CASE WHEN page_id % 211 <> 7 THEN length END AS second_length,
  CASE WHEN page_id % 211 <> 7 THEN sha256(left(body, length(body) - 1) || '?' || tail) END AS second_digest,
  CASE WHEN page_id % 211 <> 7 THEN 'changed' ELSE 'missing' END AS status
FROM o WHERE page_id % 211 = 7 OR (page_id % 101 = 5 AND right(body, 1) <> '?')
"""


@query("op6_warc_fixity", OP6_SQL)
def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the pages' WARC files against an aged copy."""
    found = warc.records(table(spark, sf_dir, "pages"))
    kept, worn = warc.aged_copy(found)
    placed = warc.with_offsets(warc.digests(found))
    # the copy's index has the offsets of the files as they were written
    aged = warc.digests(kept, worn).select("page_id", "file", F.col("digest").alias("now"))
    return warc.audit(placed, placed.join(aged, ["file", "page_id"]).select("file", "offset", "length", F.col("now").alias("digest")))


@query("op11_personal_data")
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT *, {", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))} FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {middle.TRANSFORMED} THEN 'plain'
    WHEN h4 % 100 < {middle.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


@query("op12_fill_in_middle", OP12_SQL)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.fill_in_middle(table(spark, sf_dir, "documents"), keep=False).drop("output")


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return runs.periodic_runs(docs, change=runs.repeat_tail, keep=False).drop("runs", "collapsed")
