"""One query per operator, with production parameters, over the whole of its table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import bpe, jaccard, license_scans, mixing, neardup, prefix_trie, quality, token_counts, topk, toxicity, training_order, warc, whitening


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_fm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_warc_derivatives(spark, sf_dir):
    return warc.derivatives(warc.responses_of(table(spark, sf_dir, "pages")), keep=("page_id",))


def op3_jaccard_forest(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op4_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


def op5_toxicity_ordinal(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_training_order(spark, sf_dir):
    return training_order.materialize_order(table(spark, sf_dir, "documents"), vocabulary_path(), training_order.scratch_folder(spark))


def op7_embedding_collisions(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_systematic_mix(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op9_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path())


def op10_topk(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), prefix_trie.grafted)


def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_license_scans(spark, sf_dir):
    return license_scans.report(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_fm, op2_warc_derivatives, op3_jaccard_forest, op4_bpe, op5_toxicity_ordinal, op6_training_order, op7_embedding_collisions, op8_systematic_mix, op9_token_counts, op10_topk, op11_prefix_trie, op12_whitening, op13_license_scans)}


_COMPONENTS = """,
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT id AS node, id AS reach FROM n UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.reach),
m AS (SELECT node, min(reach) AS component_id FROM c GROUP BY node),
k AS (SELECT id AS node, count(e.b) AS n_links FROM n LEFT JOIN e ON e.a = n.id GROUP BY id)
"""


def oracle_sql() -> dict[str, str]:
    w = "list_filter(string_split_regex(lower(text), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '')"
    jaccard_sql = f"""
WITH RECURSIVE t AS (SELECT doc_id AS id, {w} AS w FROM documents),
n AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM t),
g AS (SELECT id, len(s) AS size, unnest(s) AS x FROM n),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS common, any_value(a.size) + any_value(b.size) AS total
  FROM g a JOIN g b ON a.x = b.x AND a.id < b.id GROUP BY a.id, b.id),
l AS (SELECT a, b, common = total - common AS same FROM p WHERE common >= 0.8 * (total - common)){_COMPONENTS}
SELECT k.node AS doc_id, least(k.node, coalesce((SELECT min(a) FROM l WHERE l.b = k.node AND same), k.node)) AS class_id,
  k.n_links, m.component_id, k.node = m.component_id AS kept FROM k JOIN m USING (node)"""
    cosine_sql = f"""
WITH RECURSIVE n AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
l AS (SELECT x.id AS a, y.id AS b FROM n x JOIN n y ON x.label = y.label AND x.id < y.id
  WHERE list_cosine_similarity(x.v, y.v) >= 0.93){_COMPONENTS}
SELECT k.node AS vec_id, k.n_links, m.component_id, k.node = m.component_id AS kept FROM k JOIN m USING (node)"""
    return {"op3_jaccard_forest": jaccard_sql, "op7_embedding_collisions": cosine_sql, "op8_systematic_mix": mixing.MIX_SQL, "op10_topk": topk.TOPK_SQL, "op11_prefix_trie": prefix_trie.TRIE_SQL}
