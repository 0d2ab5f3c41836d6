"""The registered queries: every operator with its production parameters on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, secrets
from .chat_format import format_chat
from .language_id import language_id
from .lm_scoring import lm_scores
from .near_dedup import near_duplicates
from .packing import pack
from .quality_rules import quality
from .token_counts import token_counts
from .toxicity import toxicity


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = format_chat(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "turn", "item", "kind", "position", "depth", "cyclic", "link", F.col("valid").cast("string").alias("valid"), "json")


#: What ``chat_tool_calls`` validates its calls against.
ORDER_TOOL = {"lookup": {"type": "object", "required": ["status"], "properties": {"customer": {"type": "integer"}, "status": {"type": "string", "enum": ["F", "O"]}}}}


def chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls of a tool and line items as their results, which stand before them: links, order, validity and JSON."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    call = F.struct(F.concat(F.lit("o"), F.col("o_orderkey")).alias("id"), F.lit("lookup").alias("name"), F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer")).alias("arguments"))
    calls = orders.select(F.col("o_custkey").cast("long").alias("conv_id"), (F.lit(10) + F.col("o_orderkey")).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.to_json(F.struct(F.array(call).alias("tool_calls"))).alias("text"))
    answer = F.to_json(F.struct(F.concat(F.lit("o"), F.col("l_orderkey")).alias("tool_call_id"), F.concat(F.col("l_returnflag"), F.lit(" "), F.col("l_linestatus")).alias("content")))
    results = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").cast("long").alias("conv_id"), F.col("l_linenumber").cast("long").alias("turn"), F.lit("tool").alias("role"), answer.alias("text"))
    found = format_chat(calls.unionByName(results), ORDER_TOOL)
    return found.select("conv_id", "turn", "item", "kind", "position", "depth", "cyclic", "link", F.col("valid").cast("string").alias("valid"), "json")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.scan(docs, secrets.train(docs)))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.digest(found)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=512)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_format, chat_tool_calls, op2_toxicity, op3_near_dedup, op4_lm_scores, op5_language_id, op6_secrets, op7_packing, op8_decontamination, op9_quality_rules, op10_token_counts)}


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER.format('coalesce(text, {0})')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".replace("{0}", "''")

#: The conversations hold no tool calls, so every item is a plain message; ``chat_tool_calls`` has calls and results.
OP1_SQL = """SELECT conv_id, turn, 0 AS item, 'message' AS kind, turn::BIGINT AS position, 0::BIGINT AS depth, false AS cyclic, NULL::VARCHAR AS link, NULL::VARCHAR AS valid,
 concat('{"content":', to_json(coalesce(text, ''))::VARCHAR, ',"role":', to_json(role)::VARCHAR, '}') AS json FROM conversations"""

CHAT_CALLS_SQL = """WITH c AS (SELECT o_custkey::BIGINT AS conv_id, (10 + o_orderkey)::BIGINT AS turn, 'o' || o_orderkey AS id, o_orderkey AS k, o_custkey, o_orderstatus AS st FROM orders),
 r AS (SELECT c.conv_id, l_linenumber::BIGINT AS turn, c.id, c.turn AS call_turn, l_returnflag || ' ' || l_linestatus AS content FROM lineitem JOIN c ON l_orderkey = c.k)
 SELECT conv_id, turn, 0 AS item, 'message' AS kind, turn AS position, 0::BIGINT AS depth, false AS cyclic, NULL::VARCHAR AS link, NULL::VARCHAR AS valid, '{"content":"","role":"assistant"}' AS json FROM c
 UNION ALL SELECT conv_id, turn, 1, 'call', turn, 0, false, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = c.k) THEN 'linked' ELSE 'open' END, CASE WHEN st IN ('F', 'O') THEN 'true' ELSE 'false' END,
  '{"arguments":{"customer":' || o_custkey || ',"status":"' || st || '"},"id":"' || id || '","name":"lookup","role":"assistant"}' FROM c
 UNION ALL SELECT conv_id, turn, 0, 'result', greatest(turn, call_turn), 1, false, 'linked', NULL, '{"content":"' || content || '","role":"tool","tool_call_id":"' || id || '"}' FROM r"""

OP8_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
 j AS (SELECT item_id, w, least(13, len(w)) AS n FROM i WHERE len(w) > 0),
 iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM j)),
 dw AS (SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM j) WHERE len(w) >= n)),
 m AS (SELECT dw.r, dw.k, dw.n, iw.item_id FROM dw JOIN iw USING (n, s)),
 h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM m) GROUP BY r),
 t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY r)
 SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
 FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "chat_tool_calls": CHAT_CALLS_SQL, "op8_decontamination": OP8_SQL}
