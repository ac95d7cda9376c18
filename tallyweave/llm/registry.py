"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .ann import nearest
from .chat import chat_events
from .decontaminate import contamination
from .jaccard_join import jaccard_components
from .language_id import identify, learn_languages
from .lm_score import lm_scores
from .mixing import Mix
from .token_counts import token_counts
from .token_store import token_output
from .toxicity import learn_toxicity, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = common.fold(F.col("doc_id"), 4) == 2
    model = learn_toxicity(docs, _table(spark, sf_dir, "labels"), ~held_out)
    return toxicity(docs, model, threshold=0.3).select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = common.fold(F.col("doc_id"), 10) == 0
    scores = lm_scores(_table(spark, sf_dir, "documents"), ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), cap=3.0).counts()


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), width=3, percent=90)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_events(_table(spark, sf_dir, "conversations"))


def tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's operator on conversations turned into tool use, as the tables hold none: turn 0 declares a tool, each odd turn
    calls it with its text's length and the result of the call before, each other turn answers the call before it."""
    rows = _table(spark, sf_dir, "conversations")
    turn, size = F.col("turn"), F.length("text")
    schema = '{"properties":{"n":{"type":"integer","maximum":500},"after":{"type":["string","null"]}},"required":["n"],"additionalProperties":false}'
    declares = F.lit('{"tools":[{"name":"lookup","parameters":' + schema + "}]}")
    after = F.when(turn >= 3, F.concat(F.lit(',"after":"$c'), turn - 2, F.lit('"'))).otherwise("")
    extra = F.when(size % 7 == 0, ',"x":1').otherwise("")
    calls = F.concat(F.lit('{"content":"","tool_calls":[{"id":"c'), turn, F.lit('","name":"lookup","arguments":{"n":'), size, after, extra, F.lit("}}]}"))
    answers = F.to_json(F.struct(F.concat(F.lit("c"), turn - 1).alias("tool_call_id"), F.col("text").alias("content")))
    text = F.when(turn == 0, declares).when(turn % 2 == 1, calls).otherwise(answers)
    role = F.when(turn == 0, "system").when(turn % 2 == 1, "assistant").otherwise("tool")
    return chat_events(rows.select("conv_id", "turn", role.alias("role"), text.alias("text")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = common.fold(F.col("doc_id"), 5) == 0
    model = learn_languages(docs, ~held_out)
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_toxicity": op2_toxicity,
    "op3_lm_score": op3_lm_score,
    "op4_source_mix": op4_source_mix,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_token_counts": op7_token_counts,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_chat_format": op9_chat_format,
    "tool_links": tool_links,
    "op10_language_id": op10_language_id,
}

def _words_sql(word: str) -> str:
    """SQL for a text's words, A-Z lower-cased; null has none."""
    return f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}')"


_WORD, _ITEM_WORD = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op5_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_words_sql(_WORD)} AS w FROM documents),
        word AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM d),
        shingle AS (
            SELECT DISTINCT r, s FROM (SELECT r, x || ' ' || lead(x, 1) OVER p || ' ' || lead(x, 2) OVER p AS s FROM word WINDOW p AS (PARTITION BY r ORDER BY k)) WHERE s IS NOT NULL
            UNION ALL SELECT r, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2
        ),
        n AS (SELECT r, count(*) AS n FROM shingle GROUP BY r),
        shared AS (SELECT a.r AS x, b.r AS y, count(*) AS o FROM shingle a JOIN shingle b USING (s) WHERE a.r <> b.r GROUP BY 1, 2),
        link AS (SELECT x, y FROM shared JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 100 * o >= 90 * (p.n + q.n - o)),
        reach AS (SELECT r AS a, r AS b FROM d UNION SELECT a, y FROM reach JOIN link ON b = x),
        component AS (SELECT a, min(doc_id) AS component_id FROM reach JOIN d ON b = r GROUP BY a)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, (SELECT count(*) FROM link WHERE x = d.r) AS n_links
        FROM d JOIN component ON a = d.r LEFT JOIN n ON n.r = d.r
    """,
    "op8_benchmark_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words_sql(_ITEM_WORD)} AS w FROM documents),
        b AS (SELECT row_number() OVER () AS r, item_id, {_words_sql(_ITEM_WORD)} AS w FROM benchmark),
        item AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
        ahead AS (SELECT r, k, list(x) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS x FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM d)),
        met AS (SELECT r, k, m, array_to_string(x[1:m], ' ') AS s FROM ahead JOIN (SELECT DISTINCT m FROM item) ON len(x) >= m),
        found AS (SELECT r, k, m, item_id FROM met JOIN item USING (m, s)),
        hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + m)) AS p FROM (SELECT DISTINCT r, k, m FROM found)) GROUP BY r),
        named AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
    """,
    # All pairs, exactly: the index finds all true neighbours on the tables that the SQL is run on.
    "op6_nearest_neighbours": """
        WITH usable AS (
            SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), e AS (SELECT vec_id, min(v) AS v FROM usable GROUP BY vec_id),
        scored AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
        SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored) WHERE rank <= 20
    """,
    # The tables' conversations hold no tool messages: every row is an event ``message``. ``tool_links`` has tool events.
    "op9_chat_format": """
        SELECT conv_id, turn, 'message' AS kind, turn AS order_turn, 0::BIGINT AS order_after, (-1)::BIGINT AS order_index,
               NULL::VARCHAR AS call_id, 'ok' AS status, NULL::BOOLEAN AS valid,
               json_object('content', text, 'role', role, 'turn', turn)::VARCHAR AS event_json
        FROM conversations
    """,
    "tool_links": """
        WITH c AS (SELECT conv_id, turn, text, length(text) AS n FROM conversations),
        calls AS (
            SELECT *, (turn - 1) // 2 AS depth, list_sort(list_filter([CASE WHEN n > 500 THEN 'maximum n' END, CASE WHEN n % 7 = 0 THEN 'unknown x' END], lambda x: x IS NOT NULL)) AS errors
            FROM c WHERE turn % 2 = 1
        )
        SELECT conv_id, turn, 'message' AS kind, turn AS order_turn, 0::BIGINT AS order_after, (-1)::BIGINT AS order_index, NULL::VARCHAR AS call_id, 'ok' AS status, NULL::BOOLEAN AS valid,
               CASE WHEN turn = 0 THEN json_object('content', '{"tools":[{"name":"lookup","parameters":{"properties":{"n":{"type":"integer","maximum":500},"after":{"type":["string","null"]}},"required":["n"],"additionalProperties":false}}]}', 'role', 'system', 'turn', turn)
               ELSE json_object('content', '', 'role', 'assistant', 'turn', turn) END::VARCHAR AS event_json
        FROM c WHERE turn = 0 OR turn % 2 = 1
        UNION ALL
        SELECT conv_id, turn, 'call', turn, 2 * depth, 0, 'c' || turn, CASE WHEN EXISTS (FROM c WHERE c.conv_id = calls.conv_id AND c.turn = calls.turn + 1) THEN 'answered' ELSE 'pending' END, len(errors) = 0,
               '{"arguments":{' || CASE WHEN turn >= 3 THEN '"after":"$c' || (turn - 2) || '",' ELSE '' END || '"n":' || n || CASE WHEN n % 7 = 0 THEN ',"x":1' ELSE '' END || '},"errors":'
               || to_json(errors) || ',"id":"c' || turn || '","name":"lookup","turn":' || turn || '}'
        FROM calls
        UNION ALL
        SELECT conv_id, turn, 'result', turn, 2 * ((turn - 2) // 2) + 1, 0, 'c' || (turn - 1), 'linked', NULL,
               json_object('content', text, 'role', 'tool', 'tool_call_id', 'c' || (turn - 1), 'turn', turn)::VARCHAR
        FROM c WHERE turn > 0 AND turn % 2 = 0
    """,
}
