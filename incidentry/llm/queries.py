"""The registered queries of this package: thin digests of the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentry.llm import (
    decontaminate,
    fill_in_middle,
    license_scan,
    line_templates,
    minhash_dedup,
    mixing,
    ngram_join,
    quality_rules,
    secrets,
    spelling_variants,
    token_archive,
    warc,
    wrapper_induction,
)
from incidentry.llm.common import documents
from incidentry.plans.catalog import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words,
    row_number() OVER () AS rid FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS n, list_slice(words, i, i + least(10, len(words)) - 1) AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
dw AS (
  SELECT rid, i, n, list_slice(words, i, i + n - 1) AS win
  FROM (SELECT rid, words, n, unnest(range(1, len(words) - n + 2)) AS i
        FROM w CROSS JOIN (SELECT DISTINCT n FROM bw) WHERE len(words) >= n)),
hit AS (SELECT dw.rid, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY rid)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (rid) LEFT JOIN it USING (rid)
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
tri AS (
  SELECT rid, i, words[i] || chr(1) || words[i + 1] || chr(1) || words[i + 2] AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) > 2)),
rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (
    SELECT rid, unnest(range(i, i + 3)) AS p
    FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c > 1) GROUP BY rid),
ln AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
f AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper
  FROM d LEFT JOIN rep USING (rid) LEFT JOIN ln USING (rid)),
b AS (
  SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 25 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 30 * n_words THEN 16 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_upper > 60 * word_chars THEN 64 ELSE 0 END AS BIGINT) AS failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  failed % 4 <> 0 AS base_failed, failed = 0 AS kept, failed FROM b
"""


@query("op3_decontaminate", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.hits(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def token_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write ``docs`` as a token archive and read it back."""
    import public_tokenizers

    path = scratch(spark, "token-archive")
    token_archive.write_archive(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return token_archive.read_archive(spark.read.parquet(path))


@query("op4_token_archive")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return token_rows(spark, documents(spark, folder))


#: Shares of all tokens that the domains clean, low and toxic are mixed to.
MIX_SHARES = (0.9, 0.08, 0.02)


@query("op6_mixing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    rates = mixing.mixed_rates(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"), MIX_SHARES)
    p = [rates.p[k].alias(f"p_{name}") for k, name in enumerate(mixing.DOMAINS)]
    return rates.select("doc_id", "n_tokens", *p, "rate")


@query("op10_quality_rules", OP10_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    book = quality_rules.ledger(documents(spark, folder))
    base, verdict = quality_rules.rejected("base"), quality_rules.rejected(quality_rules.CURRENT)
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       base.alias("base_failed"), (~(base | verdict)).alias("kept"), "failed")


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + least(5, len(words)) - 1), ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY 1, 2),
e AS MATERIALIZED (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * i >= 80 * (nx.n + ny.n - i)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM w UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.reach)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) c
  ON c.node = w.doc_id
"""


@query("op9_ngram_join", OP9_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_components(documents(spark, folder))


@query("op1_secrets")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return secrets.digest(docs, secrets.fit(docs))


def _phrase_rows() -> str:
    return ", ".join(f"({p}, '{label}', {str(base).lower()}, {list(words)!r})"
                     for p, (label, words, base) in enumerate(license_scan.PHRASES))


OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
ph AS (SELECT * FROM (VALUES {_phrase_rows()}) AS t(phrase, label, base, words)),
pg AS (SELECT phrase, j - 1 AS place, list_slice(words, j, j + 2) AS g
       FROM (SELECT phrase, words, unnest(range(1, len(words) - 1)) AS j FROM ph)),
dg AS (SELECT rid, i - 1 AS pos, list_slice(words, i, i + 2) AS g
       FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) > 2)),
v AS (SELECT rid, phrase, pos - place AS diagonal, place FROM dg JOIN pg USING (g)),
di AS (SELECT rid, phrase, diagonal, count(*) AS votes FROM v GROUP BY ALL),
sp AS (SELECT *, sum(CASE WHEN diagonal - p > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY rid, phrase ORDER BY diagonal) AS span
       FROM (SELECT *, lag(diagonal) OVER (PARTITION BY rid, phrase ORDER BY diagonal) AS p FROM di)),
cv AS (SELECT rid, phrase, span, count(DISTINCT w) AS covered
       FROM (SELECT rid, phrase, span, unnest(range(place, place + 3)) AS w FROM v JOIN sp USING (rid, phrase, diagonal))
       GROUP BY ALL),
pl AS (SELECT rid, phrase, span, count(CASE WHEN base AND votes = len(words) - 2 THEN 1 END) AS places,
         min(CASE WHEN base AND votes = len(words) - 2 THEN diagonal END) AS f,
         max(CASE WHEN base AND votes = len(words) - 2 THEN diagonal END) AS l
       FROM sp JOIN ph USING (phrase) GROUP BY ALL),
r AS (
  SELECT rid, sum(places) AS n_base, min(f) AS f, max(l) AS l, max(covered / len(words)) AS score,
    string_agg(DISTINCT CASE WHEN places > 0 THEN label END, ',' ORDER BY CASE WHEN places > 0 THEN label END) AS bl,
    string_agg(DISTINCT CASE WHEN places > 0 OR covered / len(words) >= 0.8 THEN label END, ','
      ORDER BY CASE WHEN places > 0 OR covered / len(words) >= 0.8 THEN label END) AS la
  FROM pl JOIN cv USING (rid, phrase, span) JOIN ph USING (phrase) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(f AS BIGINT) AS first_word, CAST(l AS BIGINT) AS last_word, coalesce(bl, '') AS base_labels,
  coalesce(la, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN r USING (rid)
"""


@query("op8_license_scan", OP8_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(documents(spark, folder))


OP7_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, t FROM p),
o AS (SELECT t, max(page_id) AS original FROM d WHERE payload_bytes >= 1000 GROUP BY t HAVING count(*) > 1)
SELECT page_id, payload_bytes, sha1(t) AS payload_digest,
  CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM d LEFT JOIN o USING (t)
"""


@query("op7_warc_revisits", OP7_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archive(spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html"), path)
    return warc.resolved(warc.read_records(spark, path))


@query("op5_wrapper_induction")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    return wrapper_induction.extract(pages)


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
l AS (SELECT rid, md5(t) AS whole, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS p FROM d),
m AS (SELECT rid, whole, p, line, array_to_string(list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'),
        lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END), ' ') AS mask FROM l),
s AS (SELECT *, string_split(mask, ' ') AS k FROM m),
u AS (SELECT DISTINCT whole, mask, k, len(k) AS size, k[1:3] AS lead FROM s WHERE len(k) >= 3),
f AS (SELECT u.* FROM u JOIN (SELECT size, lead FROM u GROUP BY ALL HAVING count(DISTINCT whole) >= 10) USING (size, lead)),
w AS (SELECT whole, mask, size, lead, unnest(range(1, size + 1)) AS i, unnest(k) AS token FROM f),
n AS (SELECT size, lead, i, token FROM w WHERE token <> '<*>' GROUP BY ALL HAVING count(DISTINCT whole) >= 10),
t AS (SELECT w.mask, w.size, count(n.token) AS constant, string_agg(coalesce(n.token, '<*>'), ' ' ORDER BY w.i) AS template
      FROM (SELECT DISTINCT mask, size, lead, i, token FROM w) w LEFT JOIN n USING (size, lead, i, token) GROUP BY w.mask, w.size),
h AS (SELECT template FROM t JOIN f USING (mask) WHERE constant >= 3 AND constant >= 0.5 * t.size
      GROUP BY template HAVING count(DISTINCT whole) >= 10),
r AS (SELECT mask FROM t JOIN h USING (template) WHERE constant >= 3 AND constant >= 0.5 * size
      UNION SELECT mask FROM u WHERE size >= 50 GROUP BY mask HAVING count(DISTINCT whole) >= 2),
k AS (SELECT rid, CAST(count(CASE WHEN regexp_matches(line, '[^\x20\x09-\x0D]') THEN 1 END) AS BIGINT) AS n_lines,
        CAST(count(r.mask) AS BIGINT) AS n_dropped,
        coalesce(string_agg(CASE WHEN r.mask IS NULL THEN line END, chr(10) ORDER BY p), '') AS text
      FROM s LEFT JOIN r USING (mask) GROUP BY rid)
SELECT doc_id, n_lines, n_dropped, text FROM d JOIN k USING (rid)
"""


@query("op2_line_templates", OP2_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return line_templates.drop_recurring(documents(spark, folder))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tok,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (
  SELECT doc_id, t, tok, CAST(len(tok) AS BIGINT) AS n,
    least(h1 % (len(tok) + 1), h2 % (len(tok) + 1)) AS a, greatest(h1 % (len(tok) + 1), h2 % (len(tok) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT *, array_to_string(list_slice(tok, 1, a), '') AS pre, array_to_string(list_slice(tok, a + 1, b), '') AS mid,
    array_to_string(list_slice(tok, b + 1, n), '') AS suf FROM c)
SELECT doc_id, n, form, CAST(CASE WHEN form <> 'plain' THEN length(pre) END AS BIGINT) AS prefix_chars,
  CAST(CASE WHEN form <> 'plain' THEN length(mid) END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""


@query("op11_fill_in_middle", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    out = fill_in_middle.transform(documents(spark, folder))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fill_in_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + least(2, len(words)) - 1), ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY 1, 2),
l AS MATERIALIZED (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * i >= 80 * (nx.n + ny.n - i)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM w UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.reach)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) c
  ON c.node = w.doc_id
"""


@query("op12_minhash_dedup", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_dedup.near_components(documents(spark, folder))


@query("op13_spelling_variants")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants.variants(documents(spark, folder))
