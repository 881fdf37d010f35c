"""Queries of the corpus operators over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, lexical_search, vector_codes
from . import license_scan as licenses
from . import line_dedup as lines
from . import mixing, ngram_join, packing, quality_classifier, quality_rules, secret_scan, topk_search, url_filter

# Host and path rules of the URL filter.
URL_RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
#: Pages with such a title make up the list of unwanted URLs: runs of symbols.
UNWANTED = "<title>[^<]*[#$%*]{3}"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary() -> str:
    """The byte-level BPE vocabulary as ranks: the same ids as byte_bpe_50k.json."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens() -> dict[str, int]:
    """The added tokens of byte_bpe_50k.json, which the ranks lack."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    listed = pages.filter(F.col("html").rlike(UNWANTED)).select("url")
    return url_filter.url_filter(pages.select("page_id", "url"), listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(read(spark, sf_dir, "documents"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.topk_search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(read(spark, sf_dir, "documents"))


def pieces(docs: DataFrame, run_col: str | None = None) -> DataFrame:
    packed = packing.pack_documents(docs, vocabulary(), added=added_tokens(), run_col=run_col)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return done.select("doc_id", "n_lines", "n_removed", "text")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix_sources(docs, mixing.ranked_weights(docs))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_scan(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(secret_scan.spans_text("base_spans"), 256).alias("base_sha256"), secret_scan.spans_text("spans").alias("spans")
    )


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier half of the ids is history, the other half arrives; rows of both halves are judged."""
    docs = read(spark, sf_dir, "documents")
    judged = exact_dedup.exact_dedup(docs, exact_dedup.earlier_half(docs))
    return judged.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(lexical_search.build_index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(read(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_ngram_join, op3_topk_search, op4_packing, op5_line_dedup, op6_quality_classifier, op7_mixing,
        op8_license_scan, op9_quality_rules, op10_secret_scan, op11_exact_dedup, op12_lexical_search, op13_vector_codes, pipeline,
    )
}

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _url_sql() -> str:
    host = f"coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {_LOWER}), '')"
    path = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    fits = []
    for text, does in sorted(URL_RULES, key=lambda r: (-len(r[0]), r[0])):
        at, _, start = text.partition("/")
        fits.append((f"WHEN (host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{start}')", text, does))
    rule = " ".join(f"{w} THEN '{t}'" for w, t, _ in fits)
    does = " ".join(f"{w} THEN '{d}'" for w, _, d in fits)
    tracking = ", ".join(f"'{p}'" for p in url_filter.TRACKING)
    return f"""
WITH cut AS (
  SELECT page_id, url, html, {host} AS host, {path} AS path,
         list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND string_split(p, '=')[1] NOT IN ({tracking}))) AS q
  FROM pages
), judged AS (
  SELECT page_id, html, host, path, CASE {rule} END AS rule, CASE {does} END AS action,
         CASE WHEN contains(url, '://') THEN regexp_replace(host, '^(?:www|m)\\.|:(?:80|443)$', '', 'g') || regexp_replace(path, '/+$', '')
              || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canon
  FROM cut
), unwanted AS (
  SELECT DISTINCT canon FROM judged WHERE regexp_matches(html, '{UNWANTED}') AND canon IS NOT NULL
)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN u.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       u.canon IS NOT NULL AS listed
FROM judged LEFT JOIN unwanted u ON judged.canon = u.canon"""


_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, q.e AS asked, CAST(coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), 0) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

_LINES_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents
), u AS (
  SELECT doc_id, n, unnest(CASE WHEN regexp_matches(line, '[^\\x20\\x09-\\x0D]') THEN regexp_extract_all(line, '{lines.UNIT}') ELSE [line] END) AS u,
    generate_subscripts(CASE WHEN regexp_matches(line, '[^\\x20\\x09-\\x0D]') THEN regexp_extract_all(line, '{lines.UNIT}') ELSE [line] END, 1) AS j FROM l
), e AS (
  SELECT doc_id, n, u, row_number() OVER (PARTITION BY doc_id ORDER BY n, j) AS i FROM u
), f AS (
  SELECT doc_id, i, p, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (
    SELECT doc_id, i, translate(trim(regexp_replace(u, '[\\x20\\x09-\\x0D]+', ' ', 'g')), {_LOWER}) AS p FROM e) WHERE p <> ''
), w AS (
  SELECT a.doc_id, a.p || chr(10) || b.p || chr(10) || c.p AS w, a.i AS i, b.i AS i2, c.i AS i3
  FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.k = a.k + 1 JOIN f c ON a.doc_id = c.doc_id AND c.k = a.k + 2
), o AS (
  SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS n FROM w
), gone AS (
  SELECT DISTINCT doc_id, unnest([i, i2, i3]) AS i FROM o WHERE n > 1
), s AS (
  SELECT e.doc_id, e.n, e.i, e.u, gone.i AS lost FROM e LEFT JOIN gone ON e.doc_id = gone.doc_id AND e.i = gone.i
), kept AS (
  SELECT doc_id, n, string_agg(u, '' ORDER BY i) FILTER (lost IS NULL) AS line, count(lost) AS n_removed FROM s GROUP BY doc_id, n
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (line IS NOT NULL), '') AS text, count(*) AS n_lines,
  CAST(sum(n_removed) AS BIGINT) AS n_removed FROM kept GROUP BY doc_id"""


def _license_sql() -> str:
    phrase = []
    for p, label in licenses.PHRASES:
        w = p.split()
        test = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(w))
        phrase.append(f"list_transform(list_filter(range(0, greatest(0, len(w) - {len(w) - 1})), lambda i: {test}), lambda i: {{'p': i, 'l': '{label}'}})")
    rows = ", ".join(
        f"({t}, {f.length}, '{f.label}', {list(f.words)!r}, {f.m}, {list(f.telling)!r}, '{f.unless or '(?:$^)'}', {f.exact})" for t, f in enumerate(licenses.forms(licenses.TEMPLATES, licenses.THRESHOLD))
    )
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{word}') AS w FROM documents
), base AS (
  SELECT doc_id, text, len(w) AS n_words, list_concat({phrase[0]}, list_concat({phrase[1]}, {phrase[2]})) AS places FROM d
), templates(t, length, label, s, m, telling, unless, exact) AS (VALUES {rows}), starts AS (
  SELECT doc_id, w, length, unnest(range(0, len(w), length)) AS start FROM d, (SELECT DISTINCT length FROM templates)
), b AS (
  SELECT doc_id, length, start, w[start + 1 : start + 2 * length] AS w FROM starts
), pairs AS (
  SELECT doc_id, b.length, start, label, exact, len(list_intersect(b.w, s)) / len(s) AS c,
    len(list_filter(telling, lambda p: NOT contains(regexp_replace(' ' || array_to_string(b.w, ' ') || ' ', unless, ' | ', 'g'), p))) = 0 AS told
  FROM b JOIN templates ON b.length = templates.length WHERE len(list_intersect(b.w, s)) >= m
), found AS (
  SELECT * FROM (SELECT *, CASE WHEN told THEN 2 ELSE c END AS r FROM pairs WHERE told OR NOT exact) QUALIFY r = max(r) OVER (PARTITION BY doc_id, length, start)
), per AS (
  SELECT doc_id, list(DISTINCT label) AS more, max(c) AS best, count(DISTINCT (length, start)) AS n_blocks FROM found GROUP BY doc_id
)
SELECT base.doc_id, n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(list_transform(places, lambda x: x.p)) AS first_word,
  list_max(list_transform(places, lambda x: x.p)) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(places, lambda x: x.l))), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(list_transform(places, lambda x: x.l), coalesce(more, [])))), ','), '') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score, coalesce(n_blocks, 0) AS n_blocks
FROM base LEFT JOIN per ON base.doc_id = per.doc_id"""


def _rules_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
    checks = " AND ".join(
        f"{c}" for r in quality_rules.RULES for c in ([f"{r.measure} >= {r.least}"] * (r.least is not None) + [f"{r.measure} <= {r.most}"] * (r.most is not None))
    )
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS f, len(lines) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words,
    len(list_intersect(list_distinct(w), [{stop}])) AS distinct_stop_words, length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_upper
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id
), c AS (
  SELECT *, len(f) - len(list_distinct(f)) AS n_dup_lines, len(f) AS n_full_lines FROM m
), r AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
    CASE WHEN n_words > 0 THEN n_symbols / greatest(word_chars, 1) ELSE 0 END AS symbol_ratio,
    CASE WHEN n_full_lines > 0 THEN n_dup_lines / n_full_lines ELSE 0 END AS dup_line_ratio,
    CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_word_ratio,
    (n_lines - n_full_lines) / greatest(n_lines, 1) AS blank_line_ratio,
    CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END AS shout_ratio,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {checks} AS kept FROM r"""


_DEDUP_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS plain FROM documents
), k AS (
  SELECT doc_id, plain, first_value(doc_id) OVER (PARTITION BY plain ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM k"""

_SEARCH_SQL = f"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, {_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tf AS (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term
), size AS (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id
), total AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM size
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, n_docs
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, {_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term
), scored AS (
  SELECT item_id, tf.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN tf ON asked.term = tf.term JOIN size ON size.doc_id = tf.doc_id JOIN weight ON weight.term = tf.term, total GROUP BY item_id, tf.doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""


def _codes_sql() -> str:
    parts, entries, scale = vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.SCALE
    steps = [f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT r, i AS part, e[i * (len(e) // {parts}) + 1 : (i + 1) * (len(e) // {parts})] AS x FROM v, range({parts}) AS t(i)
), b0 AS MATERIALIZED (
  SELECT part, r - 1 AS entry, x FROM p WHERE r <= {entries}
)"""]
    for k in range(vector_codes.ROUNDS + 1):
        steps.append(f""", a{k} AS MATERIALIZED (
  SELECT r, part, min({{'d': d, 'entry': entry}}) AS best FROM (
    SELECT r, p.part, entry, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))::BIGINT AS d FROM p JOIN b{k} b ON p.part = b.part
  ) GROUP BY r, part
)""")
        if k < vector_codes.ROUNDS:
            steps.append(f""", b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
    SELECT part, entry, list(m ORDER BY i) AS x FROM (
      SELECT part, entry, i, CAST(floor(sum(c) / count(*)) AS BIGINT) AS m FROM (
        SELECT a.part, a.best.entry AS entry, unnest(range(len(x))) AS i, unnest(x) AS c FROM a{k} a JOIN p ON a.r = p.r AND a.part = p.part
      ) GROUP BY part, entry, i) GROUP BY part, entry
  ) m ON b.part = m.part AND b.entry = m.entry
)""")
    last = vector_codes.ROUNDS
    steps.append(f""", coded AS (
  SELECT r, string_agg(format('{{:02x}}', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{last} GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b{last}) AS codebooks_sha256
FROM coded JOIN v ON coded.r = v.r""")
    return "".join(steps)


ORACLES: dict[str, str] = {
    "op1_url_filter": _url_sql(),
    "op3_topk_search": _TOPK_SQL,
    "op5_line_dedup": _LINES_SQL,
    "op8_license_scan": _license_sql(),
    "op9_quality_rules": _rules_sql(),
    "op11_exact_dedup": _DEDUP_SQL,
    "op12_lexical_search": _SEARCH_SQL,
    "op13_vector_codes": _codes_sql(),
}
