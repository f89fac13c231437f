"""The thin queries over the operators, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bilinear, bpe, common, contamination, language, minhash, neighbours, rankmerge, sstable, suffixes, toxicity

BYTE_VOCAB = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCAB = public_tokenizers.path("word_bpe_49k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    found = suffixes.dedup(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return neighbours.near_duplicates(common.table(spark, sf_dir, "embeddings"), threshold=0.9)


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs = common.table(spark, sf_dir, "documents")
    return bpe.encode_decode(docs, BYTE_VOCAB, keep=["n_tokens", "ids_sha256", "decoded_sha256"])


def op4_sstable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    folder = common.scratch(spark, "sstables")
    manifest = sstable.write_shards(common.table(spark, sf_dir, "documents"), WORD_VOCAB, folder, end_id=1)
    return sstable.read_shards(spark, folder, manifest)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return toxicity.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return rankmerge.count_tokens(common.table(spark, sf_dir, "documents"), WORD_VOCAB, limit=2048)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return minhash.near_duplicates(common.table(spark, sf_dir, "documents"), percent=85)


def _remainder(divisor: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % divisor


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs = common.table(spark, sf_dir, "documents")
    scored = bilinear.score(docs, docs.where(_remainder(7) != 2))
    return scored.select("doc_id", (_remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs = common.table(spark, sf_dir, "documents")
    profiles = language.learn(docs.where(_remainder(5) != 0))
    return language.predict(docs, profiles).select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", "score")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    found = contamination.contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), share=0.8)
    return found.select("doc_id", "n_items", F.array_join(F.col("item_ids").cast("array<string>"), ",").alias("item_ids"), "contaminated")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_embedding_near_dedup": op2_embedding_near_dedup,
        "op3_bpe_encode_decode": op3_bpe_encode_decode,
        "op4_sstable_shards": op4_sstable_shards,
        "op5_toxicity": op5_toxicity,
        "op6_token_counts": op6_token_counts,
        "op7_minhash_near_dedup": op7_minhash_near_dedup,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_language_id": op9_language_id,
        "op10_benchmark_decontamination": op10_benchmark_decontamination,
    }


#: Items in documents: at least four fifths of an item's distinct runs of five words are in the document.
OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM benchmark
), bs AS (
  SELECT DISTINCT item_id, len(w) AS n_words, least(5, len(w)) AS k, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), size AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id
), ds AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bs) WHERE len(w) >= k)
), hit AS (
  SELECT doc_id, item_id FROM ds JOIN bs USING (k, s) JOIN size USING (item_id)
  GROUP BY doc_id, item_id, size.n HAVING count(*) >= 0.8 * size.n
), agg AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids FROM hit GROUP BY doc_id)
SELECT doc_id, coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids, n_items IS NOT NULL AS contaminated
FROM documents LEFT JOIN agg USING (doc_id)
"""


#: Every byte under a 50-byte string that also starts in an earlier document.
OP1_SQL = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM h)),
m AS (SELECT s, min(doc_id) AS d FROM w GROUP BY s),
c AS (SELECT w.doc_id, i, lag(i) OVER (PARTITION BY w.doc_id ORDER BY i) AS p FROM w JOIN m USING (s) WHERE m.d < w.doc_id),
g AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i - p > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM c),
sp AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, g),
o AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS pb FROM sp),
k AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * pb + 1, 2 * (a - pb)), '' ORDER BY a) AS head FROM o JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN k USING (doc_id)
"""

_COMPONENTS = """,
r(id, c) AS (SELECT id, id FROM ids UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.id WHERE r.c < l.v),
comp AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)"""

#: All pairs of vectors; components by spreading smaller ids.
OP2_SQL = f"""
WITH RECURSIVE e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
ids AS (SELECT vec_id AS id FROM embeddings), n AS (SELECT u, count(*) AS n FROM l GROUP BY u){_COMPONENTS}
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN comp ON comp.id = vec_id LEFT JOIN n ON n.u = vec_id
"""

#: All pairs of documents with a shingle in common, on full sets.
OP7_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT u, v FROM pairs JOIN z x ON x.doc_id = u JOIN z y ON y.doc_id = v WHERE 100 * k >= 85 * (x.n + y.n - k)),
ids AS (SELECT doc_id AS id FROM documents){_COMPONENTS}
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN comp ON comp.id = doc_id LEFT JOIN z USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": OP1_SQL,
        "op2_embedding_near_dedup": OP2_SQL,
        "op7_minhash_near_dedup": OP7_SQL,
        "op10_benchmark_decontamination": OP10_SQL,
    }
