"""The queries opN_<name>: each operator over its whole table, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_template import DIGESTS, format_conversations, read_back
from .decontaminate import decontaminate
from .lm_score import lm_score
from .near_vectors import near_vectors
from .ngram_join import ngram_jaccard_join
from .packing import pack
from .pii import KINDS, find_pii
from .sharding import shard
from .substring_dedup import substring_dedup
from .tokens import vocabulary_path
from .toxicity import score_toxicity

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """The fold that nothing is learnt from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1


def op1_nearest_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ~held_out())
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted", "evidence_ids")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k+4], ' ')) WHEN len(ws) > 0 THEN ['#' || array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), both_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id AS low, doc_id AS node FROM documents
  UNION
  SELECT reach.low, link.b FROM reach JOIN link ON link.a = reach.node WHERE link.b > reach.low
)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.low) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach r ON r.node = d.doc_id GROUP BY d.doc_id
"""


def op3_masked_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = rf"""
WITH w AS (
  SELECT doc_id, {WORDS} AS ws FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 11)) AS k, ws FROM w
), h AS (
  SELECT doc_id, k, array_to_string(ws[k:k+12], ' ') AS g FROM g
), f AS (
  SELECT g, min(doc_id) AS low FROM h GROUP BY g
), hit AS (
  SELECT DISTINCT h.doc_id, unnest(range(h.k, h.k + 13)) AS p FROM h JOIN f USING (g) WHERE f.low < h.doc_id
), gone AS (
  SELECT doc_id, list(p) AS ps FROM hit GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, len(ws) AS n, coalesce(len(ps), 0) AS r, CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END AS ks FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(ks, ' '), '')) AS kept_sha256 FROM kept
"""


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    place = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    rows = F.transform(spans, lambda x: F.struct(x["start"].alias("s"), place[x["kind"]].alias("k"), x["end"].alias("e"), x["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(rows), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def op5_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(_table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"))


def op6_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return format_conversations(turns.unionByName(own), then=read_back, schema=DIGESTS)


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(text, '\', '\\') AS x, replace(role, '\', '\\') AS y FROM t
), f AS (
  SELECT conv_id, turn, role, text, length(regexp_replace(x, '<s>|</s>|\[/?ROLE\]|\[/?INST\]', '........', 'g')) AS n0, len(regexp_extract_all(x, '<s>|</s>|\[/?ROLE\]|\[/?INST\]')) AS hits, length(x) AS n, length(y) AS m FROM e
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(n + hits + m + 20 + CASE WHEN role = 'assistant' THEN 0 ELSE 13 END) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


def op7_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM benchmark
), m AS (
  SELECT DISTINCT least(len(ws), 5) AS m FROM b WHERE len(ws) > 0
), ds AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws) - m + 2), lambda k: array_to_string(ws[k:k+m-1], ' '))) AS g FROM d, m
), bs AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(ws) - least(len(ws), 5) + 2), lambda k: array_to_string(ws[k:k+least(len(ws), 5)-1], ' '))) AS g FROM b WHERE len(ws) > 0
), n AS (
  SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id
)
SELECT doc_id, bs.item_id, n_item, count(*) AS n_found, count(*) / CAST(n_item AS DOUBLE) AS containment
FROM bs JOIN ds USING (g) JOIN n ON n.item_id = bs.item_id GROUP BY doc_id, bs.item_id, n_item HAVING 100 * count(*) >= 80 * n_item
"""


def op8_small_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings
), g AS (
  SELECT * FROM v WHERE x IS NOT NULL AND label IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), reach AS (
  SELECT vec_id AS low, vec_id AS node FROM v UNION SELECT reach.low, link.b FROM reach JOIN link ON link.a = reach.node WHERE link.b > reach.low
), n AS (
  SELECT a, count(*) AS n FROM link GROUP BY a
)
SELECT v.vec_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_links, min(reach.low) AS component_id, min(reach.low) = v.vec_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id JOIN reach ON reach.node = v.vec_id GROUP BY v.vec_id
"""


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op10_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), vocabulary_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_nearest_examples": op1_nearest_examples,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_masked_likelihood": op3_masked_likelihood,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_skip_chain": op5_skip_chain,
        "op6_chat_template": op6_chat_template,
        "op7_minhash_containment": op7_minhash_containment,
        "op8_small_world": op8_small_world,
        "op9_virtual_slots": op9_virtual_slots,
        "op10_cutting_stock": op10_cutting_stock,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": OP2_SQL, "op4_substring_dedup": OP4_SQL, "op6_chat_template": OP6_SQL, "op7_minhash_containment": OP7_SQL, "op8_small_world": OP8_SQL}
