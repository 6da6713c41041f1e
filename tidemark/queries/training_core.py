"""Queries of the general training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import flatten
from tidemark.session import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p5_found": lambda s, d: flatten.json_nodes(table(s, d, "raw_records")).select("record_id", "node", "parent").distinct(),
        "p5_values": lambda s, d: flatten.json_values(table(s, d, "raw_records")),
        "p5_messages": lambda s, d: flatten.child_table(table(s, d, "sft_rows"), ["row_id"], "messages"),
        "p5_outputs": lambda s, d: flatten.child_table(table(s, d, "rl_rows"), ["row_id"], "outputs"),
        "p5_reward_models": lambda s, d: flatten.struct_table(table(s, d, "rl_rows"), ["row_id"], "reward_model"),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p5_messages": """
SELECT row_id, CAST(i - 1 AS INTEGER) AS position, messages[i].content AS content, messages[i].function_calls AS function_calls,
  messages[i].functions AS functions, messages[i].role AS role
FROM (SELECT row_id, messages, unnest(range(1, len(messages) + 1)) AS i FROM sft_rows) x""",
        "p5_outputs": """
SELECT row_id, CAST(i - 1 AS INTEGER) AS position, outputs[i] AS value
FROM (SELECT row_id, outputs, unnest(range(1, len(outputs) + 1)) AS i FROM rl_rows) x""",
        "p5_reward_models": "SELECT row_id, reward_model.ground_truth AS ground_truth, reward_model.style AS style FROM rl_rows WHERE reward_model IS NOT NULL",
    }
