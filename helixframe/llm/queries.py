"""The opN_ queries: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contamination
from .divergence import LEAST_DOCS, MOST_RANK, source_divergence
from .exact import exact_groups
from .lines import duplicate_lines
from .near import near_components
from .packing import pack
from .pages import main_text
from .personal import personal_spans
from .runtime import documents, id_bucket
from .scoring import language_scores
from .secrets import ALPHABET, BASE, CANDIDATE, LEAST_RANDOM, secret_spans, trained
from .shard import assign_shards
from .toxicity import THRESHOLD, toxicity, train

N_SHARDS = 24
#: For DuckDB: A-Z in lower case, and words of letters, digits and all that isn't ASCII.
UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ALNUM_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
LETTER_WORDS = r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+'"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(documents(spark, sf_dir), N_SHARDS, "bytes")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir), width=2)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_lines(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scores = toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scores.select("doc_id", (id_bucket("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "threshold", "toxic")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(documents(spark, sf_dir)).drop("found")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path())


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(documents(spark, sf_dir))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_spans(documents(spark, sf_dir)).drop("found")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_sharding, op2_html_extraction, op3_minhash, op4_line_dedup, op5_exact_dedup, op6_toxicity, op7_secret_scan, op8_decontamination, op9_packing, op10_lm_scoring, op11_personal_data, op12_source_divergence)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_exact_dedup": r"""
            WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
            g AS (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                         row_number() OVER (PARTITION BY text_sha256, doc_id) AS again FROM d)
            SELECT doc_id, keep_id, group_size, (again = 1 AND doc_id = keep_id) AS kept, text_sha256 FROM g""",
        "op8_decontamination": rf"""
            WITH dw AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}), {ALNUM_WORDS}) AS w FROM documents),
            iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}), {ALNUM_WORDS}) AS w FROM benchmark),
            win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS g
                    FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM iw WHERE len(w) > 0)),
            sizes AS (SELECT DISTINCT n FROM win),
            dg AS (SELECT row, s, n, array_to_string(w[s : s + n - 1], ' ') AS g
                   FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes WHERE len(w) >= n)),
            hit AS (SELECT row, s, dg.n, item_id FROM dg JOIN win USING (n, g)),
            words AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(s, s + n)) AS p FROM hit) GROUP BY row),
            items AS (SELECT row, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY row)
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
                   sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
            FROM dw LEFT JOIN words USING (row) LEFT JOIN items USING (row)""",
        "op7_secret_scan": secrets_sql(),
        "op12_source_divergence": rf"""
            WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), {UPPER}) AS t FROM documents),
            w AS (SELECT row, lang, source, unnest(regexp_extract_all(t, {LETTER_WORDS})) AS term FROM d),
            c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs FROM w GROUP BY ALL),
            kept AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(docs) >= {LEAST_DOCS}),
            v AS (SELECT lang, count(*) AS v, sum(total) AS n_lang FROM kept GROUP BY lang),
            g AS (SELECT DISTINCT lang, source FROM d),
            cell AS (SELECT g.lang, g.source, term, coalesce(n, 0) AS n, total FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
            s AS (SELECT lang, source, sum(n) AS n_all FROM cell GROUP BY ALL),
            p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (n_all + 5 * v) AS p, 1 + (1000000000::HUGEINT * (total + 5)) // (n_lang + 5 * v) AS q
                  FROM cell JOIN s USING (lang, source) JOIN v USING (lang)),
            f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
            parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
                      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
                      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
            SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
            FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts) WHERE part = 'pair' OR rank <= {MOST_RANK}""",
        "op4_line_dedup": r"""
            WITH l AS (SELECT doc_id, i - 1 AS line_no, p[i] AS line FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)) WHERE trim(p[i]) <> ''),
            f AS (SELECT line, length(line) AS n, min({'d': doc_id, 'l': line_no}) AS own, row_number() OVER () AS k FROM l GROUP BY line),
            v AS (SELECT k, own, n, i, hash(left(line, i - 1) || chr(0) || substr(line, i + 1)) AS put, hash(left(line, i - 1) || substr(line, i + 1)) AS cut FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM f)),
            e AS (SELECT a.k, b.own FROM v a JOIN (SELECT put, n, i, min(own) AS own FROM v GROUP BY ALL) b USING (put, n, i)
                  UNION ALL SELECT a.k, b.own FROM (SELECT k, n, own, hash(line) AS h FROM f) a JOIN (SELECT cut, n, min(own) AS own FROM v GROUP BY ALL) b ON b.cut = a.h AND b.n = a.n + 1
                  UNION ALL SELECT a.k, b.own FROM v a JOIN (SELECT n, own, hash(line) AS h FROM f) b ON a.cut = b.h AND b.n = a.n - 1),
            g AS (SELECT f.line, f.own, least(f.own, coalesce(m.own, f.own)) AS first FROM f LEFT JOIN (SELECT k, min(own) AS own FROM e GROUP BY k) m USING (k))
            SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(length(line) AS INTEGER) AS n_chars, first.d AS first_doc_id, CAST(first.l AS INTEGER) AS first_line_no,
                   CASE WHEN first < own THEN 'near' WHEN doc_id = first.d AND line_no = first.l THEN NULL ELSE 'exact' END AS match,
                   doc_id = first.d AND line_no = first.l AS kept
            FROM l JOIN g USING (line)""",
    }


def secrets_sql() -> str:
    """The spans in DuckDB: pieces between matches give the places; the table of the two chains is written out."""
    model = trained()
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for kind, (pattern, group, least) in enumerate([*((p, 2 if name == "assign" else 0, n) for name, p, n in BASE), (CANDIDATE, 0, LEAST_RANDOM)]):
        parts.append(
            f"""SELECT row, {kind} AS kind, b + list_sum(list_transform(p[1:i], lambda x: length(x))) AS start, ms[i] AS m
            FROM (SELECT *, coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS b
                  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT row, regexp_extract_all(t, {quoted(pattern)}, 0) AS ms, regexp_extract_all(t, {quoted(pattern)}, {group}) AS gs, string_split_regex(t, {quoted(pattern)}) AS p FROM d)))
            WHERE length(gs[i]) >= {least}"""
        )
    n = len(ALPHABET) + 1
    table = ",".join(f"{x:.6f}" for row in model.log_odds for x in row)
    listed = lambda c: f"coalesce(string_agg(k || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER ({c}), '')"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
        model AS (SELECT [{table}]::DOUBLE[] AS odds),
        s AS (SELECT row, kind, CAST(start AS BIGINT) AS start, CAST(start + length(m) AS BIGINT) AS stop, m FROM ({' UNION ALL '.join(parts)})),
        free AS (SELECT * FROM s r WHERE kind = {len(BASE)} AND NOT EXISTS (SELECT 1 FROM s b WHERE b.row = r.row AND b.kind < {len(BASE)} AND b.start < r.stop AND r.start < b.stop)),
        placed AS (SELECT *, list_transform(string_split(m, ''), lambda x: strpos('{ALPHABET}', x)) AS a FROM free),
        added AS (SELECT placed.* EXCLUDE (a) FROM placed, model WHERE list_sum(list_transform(range(1, len(a) + 1), lambda i: odds[(CASE WHEN i = 1 THEN 0 ELSE a[i - 1] END) * {n} + a[i] + 1])) / len(a) > {model.threshold}),
        named AS (SELECT *, ['assign', 'access', 'hex', 'random'][kind + 1] AS k FROM (SELECT * FROM s WHERE kind < {len(BASE)} UNION ALL SELECT * FROM added)),
        g AS (SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, {listed(f'kind < {len(BASE)}')} AS base, {listed('true')} AS spans FROM named GROUP BY row)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN g USING (row)"""
