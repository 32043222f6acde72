"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, buckets, katz, langid, linecrf, manyqueries, middle, nearcopies, pages, quality, suffixes, tokenfiles, topk
from .common import crc_mod, table

REGISTRY: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        REGISTRY[name] = (fn, sql)
        return fn

    return add


@query("op1_katz_backoff")
def katz_backoff(spark, sf_dir):
    """Log-probability of every text under a model of order 3 of four fifths of the documents."""
    docs = table(spark, sf_dir, "documents")
    scores, _ = katz.katz_scores(docs, crc_mod("doc_id", 5) == 1, order=3)
    return scores


@query("op2_main_text")
def main_text(spark, sf_dir):
    """The article of every page."""
    return pages.extract(table(spark, sf_dir, "pages"))


@query("op3_block_topk")
def block_topk(spark, sf_dir):
    """The 20 best inner products of every twentieth vector against all others."""
    vectors = topk.scaled(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0, 20).select("query_id", "rank", "vec_id", "score")


@query("op4_suffix_dedup")
def suffix_dedup(spark, sf_dir):
    """Every passage of 50 words or more that is found at two places or more."""
    return suffixes.span_rows(suffixes.passages(table(spark, sf_dir, "documents")))


@query("op5_length_buckets")
def length_buckets(spark, sf_dir):
    """Bucket and batch of every document by its length in words."""
    return buckets.pack(table(spark, sf_dir, "documents"))


@query("op6_prob_minhash")
def prob_minhash(spark, sf_dir):
    """The class of near copies of every document."""
    return nearcopies.class_rows(nearcopies.near_classes(table(spark, sf_dir, "documents")))


@query("op7_byte_bpe")
def byte_bpe(spark, sf_dir):
    """Ids and decoded bytes of every text, as digests."""
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"
    )


@query("op8_token_files")
def token_files(spark, sf_dir):
    """Every text as ids in flat files, and what the files hold."""
    docs = table(spark, sf_dir, "documents")
    manifest = tokenfiles.write_token_files(docs, tokenfiles.output_folder(spark), public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfiles.read_digests(spark, manifest)


@query("op9_language_id")
def language_id(spark, sf_dir):
    """The language of every text, learnt from three quarters of the documents."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    model = langid.train(docs, ~held_out)
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "entropy", "accepted")


@query("op10_quality_rules")
def quality_rules(spark, sf_dir):
    """Statistics and verdict of every text."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_score"
    )


MANY_QUERIES_SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, row_number() OVER () AS row, doc_id AS id, unnest(regexp_extract_all(translate(text,
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), asked AS (
  SELECT DISTINCT row, id, term FROM (
    SELECT row_number() OVER () AS row, item_id AS id, unnest(regexp_extract_all(translate(text,
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) t
), lengths AS (SELECT row, id, count(*) AS n FROM words GROUP BY row, id
), sizes AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths
), counts AS (SELECT row, term, count(*) AS tf FROM words GROUP BY row, term
), weighted AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term) f, sizes
), scored AS (
  SELECT a.row AS item_row, a.id AS item_id, l.row AS doc_row, l.id AS doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM asked a JOIN weighted USING (term) JOIN counts c USING (term) JOIN lengths l ON l.row = c.row, sizes
  GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id NULLS LAST) AS r FROM scored WHERE score > 0
)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM ranked WHERE r <= 50
"""

FILL_IN_MIDDLE_SQL = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM hashed
), formed AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), cut AS (
  SELECT *, substr(t, 1, low) AS prefix, substr(t, low + 1, high - low) AS middle, substr(t, high + 1) AS suffix FROM formed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
FROM cut
"""


@query("op11_many_queries", MANY_QUERIES_SQL)
def many_queries(spark, sf_dir):
    """The 50 best documents of every benchmark item."""
    return manyqueries.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_fill_in_middle", FILL_IN_MIDDLE_SQL)
def fill_in_middle(spark, sf_dir):
    """Every text cut and put in another order, and put back, as digests."""
    made = middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


@query("op13_line_field")
def line_field(spark, sf_dir):
    """Quality of every text, learnt from four fifths of the labels."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 5) == 0
    model = linecrf.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return linecrf.score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
