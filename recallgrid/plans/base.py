"""What registers a query with its SQL, and the logical tables in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The logical tables in SQL, as in sources.catalog.
VIEWS = """
    topics AS (
        SELECT r_regionkey AS topic_id, r_name AS path, r_name AS label FROM region
        UNION ALL SELECT n_nationkey + 100, r_name || '/' || n_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey),
    notes AS (
        SELECT c_custkey AS note_id, c_custkey % 4 + 200 AS model_id, lower(c_name) || ' ' || lower(c_mktsegment) AS text,
            [lower(c_mktsegment), 'tag-' || (c_custkey % 24)] AS tags, c_custkey % 17 = 0 AS deleted FROM customer),
    note_topics AS (
        SELECT c_custkey AS note_id, c_nationkey + 100 AS topic_id, least(greatest((c_acctbal + 1000) / 11000, 0), 1) AS confidence FROM customer
        UNION ALL SELECT c_custkey, n_regionkey, least(greatest((c_acctbal + 1000) / 11000, 0), 1) * 0.5 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 = 0),
    cards AS (
        SELECT o_orderkey AS card_id, o_custkey AS note_id, o_orderpriority AS deck, o_orderkey % 60 AS ivl, o_orderkey % 7 AS lapses, o_orderkey % 25 AS reps, o_orderkey % 2000 + 1300 AS ease FROM orders),
    card_stats AS (SELECT l_orderkey AS card_id, count(*) AS reviews, avg((l_returnflag = 'R')::INT) AS fail_rate FROM lineitem GROUP BY 1),
    reviews AS (
        SELECT epoch_ms(ts) AS review_ms, user_id AS card_id, CASE WHEN event_type = 'error' THEN 1 ELSE 3 END AS ease, event_id % 1200 + 1300 AS factor, floor(value)::BIGINT AS time_ms FROM events)
"""


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query; its SQL may use the logical tables."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            text = sql.strip()
            recursive = text.upper().startswith("RECURSIVE")
            text = text[len("RECURSIVE") :].strip() if recursive else text
            head = f"WITH {'RECURSIVE ' if recursive else ''}{VIEWS}"
            ORACLES[name] = f"{head}, {text[4:].lstrip()}" if text.upper().startswith("WITH") else f"{head} {text}"
        return f

    return add
