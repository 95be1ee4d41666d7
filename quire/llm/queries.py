"""The operators' queries over the tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language, mixing, pii, quality, simhash, tokens, topk
from .common import fold, table
from .repeats import remove_repeats
from .substrings import Words
from .suffixes import Bytes

TOKENIZER = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
#: Labelled rows that the quality trees learn from, and texts of each language: the operators' documented bounds.
LABELLED, EACH_LANGUAGE = 20_000, 300


def op1_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), tokens.token_count(F.col("text"), public_tokenizers.path(TOKENIZER)).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = quality.labelled(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1, LABELLED)
    trees = quality.train(known, "text", "label", F.col("order"), LABELLED)
    scored = docs.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), quality.score(F.col("text"), trees).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", pii.find(F.col("text"), pii.train(pii.pieces(docs))).alias("f"))
    return found.select("doc_id", "f.n_email", "f.n_ip", "f.n_card", "f.n_phone", F.sha2("f.base", 256).alias("base_sha256"), "f.spans", "f.n_added")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    coder = language.train(language.sample(docs, fold(F.col("doc_id"), 4) != 2, EACH_LANGUAGE))
    said = docs.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), language.predict(F.col("text"), coder).alias("p"))
    return said.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_topk_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), Words(20), with_text=False)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_words"), "n_removed", "kept_sha256")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), Bytes(100), with_text=False)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_cube_mix, op2_token_counts, op3_quality_scores, op4_pii_spans, op5_language_id, op6_simhash_components, op7_decontaminate, op8_topk_pivots, op9_substring_dedup, op10_suffix_dedup)}

_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {
    "op7_decontaminate": rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram, least(len(w), 10) AS size
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM g),
grams AS (SELECT DISTINCT gram, size FROM g),
p AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
      FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, size, i, gram FROM p SEMI JOIN grams USING (gram, size)),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM hits) GROUP BY doc_id),
t AS (SELECT doc_id, string_agg(item, ',' ORDER BY item) AS items, count(*) AS n_items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits JOIN g USING (gram, size)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
""",
    "op8_topk_pivots": """
WITH v AS (SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
""",
    "op9_substring_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM p) WHERE k > 1),
gone AS (SELECT doc_id, list(DISTINCT pos) AS g, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 20)) AS pos FROM later) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d)
         ANTI JOIN (SELECT doc_id, unnest(g) AS pos FROM gone) USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op10_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
p AS (SELECT doc_id, i, hash(substring(h, CAST(2 * i + 1 AS BIGINT), 200)) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM p) WHERE k > 1),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g
         FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 100 THEN 1 ELSE 0 END AS new FROM later)) GROUP BY doc_id, g),
spans AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM runs),
parts AS (SELECT s.doc_id, a, substring(h, CAST(2 * z + 1 AS BIGINT), CAST(2 * (a - z) AS BIGINT)) AS t FROM spans s JOIN d USING (doc_id)
          UNION ALL SELECT doc_id, n + 1, substring(h, CAST(2 * b + 1 AS BIGINT), CAST(2 * (n - b) AS BIGINT)) FROM (SELECT doc_id, max(b) AS b FROM runs GROUP BY doc_id) JOIN d USING (doc_id)),
kept AS (SELECT doc_id, string_agg(t, '' ORDER BY a) AS t FROM parts GROUP BY doc_id),
gone AS (SELECT doc_id, sum(b - a) AS r, count(*) AS s FROM runs GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, CAST(coalesce(s, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
}
