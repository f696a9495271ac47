"""Corpus queries that have SQL give the same rows as DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from lamina.llm.queries import queries
from lamina.llm.sql import ORACLE


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    found, df = con.sql(ORACLE[name]), queries()[name](spark, sf)
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted((tuple(r[k] for k in at) for r in found.fetchall()), key=str)


#: The base columns of the quality query, whose verdict a fitted list decides.
BASE = r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
n AS (SELECT doc_id, t, ws, len(ws) AS n_words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS gram FROM n, unnest(range(1, n_words - 3)) u(i)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM g) WHERE times > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, unnest(range(0, 5)) u(k) GROUP BY doc_id)
SELECT n.doc_id, n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed FROM n LEFT JOIN covered USING (doc_id)"""


def test_base_columns_of_the_quality_query(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = con.sql(BASE)
    df = queries()["op10_decision_list"](spark, sf).select(*found.columns)
    assert sorted(map(tuple, df.collect())) == sorted(found.fetchall())
