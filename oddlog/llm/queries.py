"""One query for each operator, over its whole table with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from oddlog.llm import chat, decontaminate, exact, html, langid, lexical, mixing, ngram_join, quality, substring, tokens, toxicity, whitening
from oddlog.llm.common import table

NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_classes(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document contains."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus mixed to weights of size ** 0.5, as (document, copy) rows in shuffled order."""
    return mixing.mix(table(spark, sf_dir, "documents"), alpha=0.5)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digests = docs.select(
        F.monotonically_increasing_id().alias("row"), F.sha2(exact.normalised("text"), 256).alias("text_sha256")
    )
    return exact.exact_groups(docs).join(digests, "row").drop("row")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severities(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = turns.unionByName(extra)
    return chat.digests(chat.read_back(chat.format_turns(turns, chat.text_parts(F.col("text")))))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


LLM_QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_ngram_join": op3_ngram_join,
    "op4_html_text": op4_html_text,
    "op5_quality": op5_quality,
    "op6_decontamination": op6_decontamination,
    "op7_mixing": op7_mixing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_chat": op10_chat,
    "op11_whitening": op11_whitening,
    "op12_lexical_search": op12_lexical_search,
    "op13_language": op13_language,
}

LLM_ORACLES = {
    "op3_ngram_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k+2], ' ')))
                                     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
        flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY df, shingle) AS place
                   FROM (SELECT *, count(*) OVER (PARTITION BY shingle) AS df FROM flat)),
        heads AS (SELECT * FROM ranked WHERE place <= n - ceil(0.9 * n) + 1),
        pairs AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM heads a JOIN heads b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
                  AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)),
        links AS (SELECT a, b FROM pairs JOIN flat x ON x.doc_id = a JOIN flat y ON y.doc_id = b AND y.shingle = x.shingle
                  GROUP BY a, b HAVING 100 * count(*) >= 90 * (any_value(x.n) + any_value(y.n) - count(*))),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, low AS component_id
        FROM sets JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) USING (doc_id)""",
    "op6_decontamination": r"""
        WITH words AS (
            SELECT 0 AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents
            UNION ALL
            SELECT 1, item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') FROM benchmark),
        sets AS (SELECT kind, id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' ')))
                                       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
        flat AS (SELECT kind, id, len(s) AS n, unnest(s) AS shingle FROM sets)
        SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, any_value(i.n)::BIGINT AS n_item, count(*) / any_value(i.n) AS containment
        FROM flat d JOIN flat i ON d.kind = 0 AND i.kind = 1 AND d.shingle = i.shingle
        GROUP BY d.id, i.id HAVING count(*) * 100 >= any_value(i.n) * 80""",
    "op7_mixing": r"""
        WITH sizes AS (SELECT source, sum(length(text))::DOUBLE AS size FROM documents GROUP BY source),
        rates AS (SELECT source, sqrt(size) / (SELECT sum(sqrt(size)) FROM sizes) * (SELECT sum(size) FROM sizes) / size AS rate
                  FROM sizes),
        drawn AS (SELECT d.*, rate, ('0x' || substr(md5('mix-1|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u
                  FROM documents d JOIN rates USING (source)),
        counts AS (SELECT *, len(list_filter(range(0, (rate + 12 * sqrt(rate) + 20)::BIGINT), lambda k:
                     list_sum(list_transform(range(0, k + 1), lambda i: exp(i * ln(rate) - rate - lgamma(i + 1)))) <= u)) AS n
                   FROM drawn),
        copies AS (SELECT * EXCLUDE (rate, u, n), unnest(range(0, n)) AS copy_no FROM counts)
        SELECT doc_id, text, lang, source, n_chars, copy_no::INT AS copy_no,
               md5('mix-1|place|' || doc_id || '|' || copy_no) AS shuffle_key
        FROM copies""",
    "op8_exact_dedup": rf"""
        WITH normal AS (SELECT doc_id, sha256({NORM}) AS text_sha256 FROM documents),
        sized AS (SELECT *, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size
                  FROM normal WINDOW w AS (PARTITION BY text_sha256))
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM sized""",
    "op12_lexical_search": r"""
        WITH words AS (
            SELECT 0 AS kind, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
            UNION ALL
            SELECT 1, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) FROM benchmark),
        tf AS (SELECT kind, id, term, count(*)::BIGINT AS tf FROM words GROUP BY ALL),
        sizes AS (SELECT id, sum(tf)::BIGINT AS n FROM tf WHERE kind = 0 GROUP BY id),
        totals AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM sizes),
        weights AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals WHERE kind = 0 GROUP BY term),
        scores AS (
            SELECT q.id AS item_id, d.id AS doc_id,
                   sum(q.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 12 * (75 + (25 * n * nn) // ll))))::BIGINT AS score
            FROM tf q JOIN tf d ON q.kind = 1 AND d.kind = 0 AND q.term = d.term JOIN weights w ON w.term = d.term JOIN sizes s ON s.id = d.id, totals
            GROUP BY q.id, d.id)
        SELECT item_id, rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0)
        WHERE rank <= 20""",
}
