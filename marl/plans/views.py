"""The logical views as DuckDB SQL: common table expressions that the oracles start from."""

from __future__ import annotations

REVIEWS = """reviews AS (
  SELECT l_orderkey AS review_id, o_custkey AS user_id, l_suppkey AS business_id, o_orderdate AS date, ceil(l_quantity / 10)::DOUBLE AS stars
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
RATINGS = f"""{REVIEWS},
ratings AS (SELECT user_id, business_id, avg(stars) AS stars FROM reviews GROUP BY user_id, business_id),
train AS (SELECT * FROM ratings WHERE (user_id * 31 + business_id) % 5 <> 0),
test AS (SELECT * FROM ratings WHERE (user_id * 31 + business_id) % 5 = 0)"""
BASKETS = """pairs AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"""
USER_ITEMS = """sets AS (
  SELECT DISTINCT user_id AS owner, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item
  FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL)"""
STREAM = """stream AS (SELECT event_id AS seq, user_id, event_id // 100 AS batch_id FROM events)"""
POINTS = """points AS (SELECT vec_id AS idx, label, embedding::DOUBLE[] AS x FROM embeddings)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
