"""SQL that gives the registered queries' results from the same tables, by other means (row numbers in key order)."""

from __future__ import annotations

_ORDERS = """o AS (SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS ord, * FROM orders),
g AS (SELECT ord // 4096 AS rg, ord % 4096 AS pos_in_rg, * FROM o)"""
_EVENTS = """o AS (SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS ord, * FROM events),
g AS (SELECT ord // 4096 AS rg, ord % 4096 AS pos_in_rg, * FROM o)"""
_FILES = f"{_ORDERS}, f AS (SELECT ord // 4000 AS file_no, ord % 4000 // 1000 AS row_group, * FROM o)"
_CUSTOMERS = "o AS (SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS ord, * FROM customer)"
_DICTIONARY = """d AS (SELECT rg, o_orderpriority AS value, CAST(row_number() OVER (PARTITION BY rg ORDER BY min(ord)) - 1 AS BIGINT) AS id FROM g GROUP BY rg, o_orderpriority)"""
_CHUNKS = f"""{_ORDERS},
c AS (SELECT rg, CAST(0 AS BIGINT) AS col, CAST(8 * count(*) AS BIGINT) AS sz, count(*) AS n FROM g GROUP BY rg
 UNION ALL SELECT rg, 1, CAST(sum(4 + octet_length(CAST(o_orderstatus AS BLOB))) AS BIGINT), count(*) FROM g GROUP BY rg
 UNION ALL SELECT rg, 2, CAST(sum(4 + octet_length(CAST(o_orderpriority AS BLOB))) AS BIGINT), count(*) FROM g GROUP BY rg),
e AS (SELECT rg, col, sz, n, CAST(sum(sz) OVER (ORDER BY rg, col) AS BIGINT) AS off FROM c),
s AS (SELECT rg, CAST(min(off - sz) + 4 AS BIGINT) AS r_start, CAST(max(off) + 4 AS BIGINT) AS r_end FROM e GROUP BY rg)"""
_FIXED = f"""{_CHUNKS},
t AS (SELECT max(r_end) AS total FROM s),
p AS (SELECT n, n * 90000 AS p_start, least((n + 1) * 90000, total) AS p_end FROM t, unnest(range(0, CAST(ceil(total / 90000.0) AS BIGINT))) AS u(n))"""
_PLAN = f"""{_CHUNKS},
pts AS (SELECT CAST(0 AS BIGINT) AS off UNION ALL SELECT off FROM e),
tot AS (SELECT max(off) AS t FROM pts),
sp AS (SELECT t, greatest(CAST(ceil(t / 5.0) AS BIGINT), CAST(20000 AS BIGINT)) AS space FROM tot),
cand AS (SELECT a.off AS cut, coalesce(min(b.off), max(sp.t)) AS nxt, max(sp.t) AS t FROM pts a CROSS JOIN sp LEFT JOIN pts b ON b.off >= a.off + sp.space GROUP BY a.off),
step AS (SELECT cut, CASE WHEN t - nxt < 20000 THEN t ELSE nxt END AS nxt FROM cand),
walk(n, cut) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT w.n + 1, s.nxt FROM walk w JOIN step s ON w.cut = s.cut WHERE s.nxt > w.cut)"""


def _summary(column: str, text: str) -> str:
    return f"SELECT rg, '{column}' AS \"column\", count({column}) AS num_values, count(*) - count({column}) AS num_nulls, min({text}) AS min_text, max({text}) AS max_text FROM g GROUP BY rg"


_TEXT = {
    "o_orderkey": "CAST(o_orderkey AS VARCHAR)", "o_custkey": "CAST(o_custkey AS VARCHAR)", "o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority",
    "o_totalprice": "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)", "o_orderdate": "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')",
}


def _scan(column_no: int, column: str) -> str:
    return f"SELECT rg, CAST({column_no} AS BIGINT) AS column_no, '{column}' AS \"column\", ord, {_TEXT[column]} AS value FROM g"


def _benefit(column: str) -> str:
    return f"""SELECT rg, '{column}' AS "column", CAST(sum(n) AS BIGINT) AS num_rows, count(*) AS num_distinct, CAST(sum(n * b) AS BIGINT) AS plain_bytes,
 CAST(sum(b) + 2 * sum(n) AS BIGINT) AS dictionary_bytes, count(*) <= 65536 AND sum(b) + 2 * sum(n) < sum(n * b) AS use_dictionary
 FROM (SELECT rg, {column}, count(*) AS n, 4 + octet_length(CAST({column} AS BLOB)) AS b FROM g GROUP BY rg, {column}) GROUP BY rg"""


_ENDS = """SELECT rg, '{0}' AS "column", count({0}) AS num_values, arg_min({0}, ord) AS first_value, arg_max({0}, ord) AS last_value FROM g GROUP BY rg"""

_CUSTOMER_TEXT = {
    "c_custkey": "CAST(c_custkey AS VARCHAR)", "c_name": "c_name", "c_nationkey": "CAST(c_nationkey AS VARCHAR)", "c_acctbal": "CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR)", "c_mktsegment": "c_mktsegment",
}

ORACLES: dict[str, str] = {
    "row_group_index": f"WITH {_ORDERS}, n AS (SELECT rg, count(*) AS num_rows FROM g GROUP BY rg) SELECT rg, CAST(sum(num_rows) OVER (ORDER BY rg) - num_rows AS BIGINT) AS start_row, num_rows FROM n",
    "row_group_totals": f"WITH {_ORDERS}, n AS (SELECT rg, count(*) AS num_rows FROM g GROUP BY rg) SELECT count(*) AS num_row_groups, CAST(sum(num_rows) AS BIGINT) AS num_rows, max(num_rows) AS largest FROM n",
    "chunk_scan": f"WITH {_ORDERS} " + " UNION ALL ".join(_scan(i, c) for i, c in enumerate(("o_orderstatus", "o_totalprice", "o_orderdate"))),
    "chunk_scan_summary": f"WITH {_ORDERS} " + " UNION ALL ".join(_summary(c, t) for c, t in _TEXT.items()),
    "row_group_scan_summary": f"WITH {_EVENTS} SELECT rg, count(*) AS num_rows, count(DISTINCT event_type) AS num_types, round(sum(value), 2) AS sum_value FROM g GROUP BY rg",
    "row_group_processor": f"WITH {_EVENTS} SELECT rg, count(*) AS num_rows, arg_min(event_type, ord) AS first_type, arg_max(event_type, ord) AS last_type FROM g GROUP BY rg",
    "chunk_processor": f"WITH {_ORDERS} {_ENDS.format('o_orderstatus')} UNION ALL {_ENDS.format('o_orderpriority')}",
    "read_chunk": f"WITH {_ORDERS} SELECT ord, o_totalprice FROM g WHERE rg = 1",
    "project_known_columns": "SELECT c_name, c_custkey, c_acctbal FROM customer",
    "project_all": "SELECT * FROM nation",
    "select_row_groups": f"WITH {_ORDERS} SELECT rg, ord, o_orderkey FROM g WHERE rg IN (0, 2)",
    "skip_rows": f"WITH {_ORDERS} SELECT ord, pos_in_rg, o_orderkey FROM g WHERE rg = 1 AND pos_in_rg >= 1000",
    "skip_relative": f"WITH {_EVENTS}, s(step, p) AS (VALUES (CAST(1 AS BIGINT), 1), (2, 3), (3, 3), (4, 4)) SELECT step, ord AS position, event_id FROM s JOIN g ON ord = p",
    "null_iteration": f"WITH {_ORDERS} SELECT ord, o_orderkey % 7 = 0 AS is_null, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS value FROM g",
    "null_count_by_chunk": f"WITH {_ORDERS} SELECT rg, count(*) FILTER (WHERE o_orderkey % 7 <> 0) AS num_values, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS num_nulls FROM g GROUP BY rg",
    "global_row_position": f"WITH {_EVENTS} SELECT rg, pos_in_rg, rg * 4096 AS start_row, ord, rg * 4096 + pos_in_rg = event_id AS matches FROM g",
    "dictionary_build": f"WITH {_ORDERS}, {_DICTIONARY} SELECT rg, id, value FROM d",
    "dictionary_encode": f"WITH {_ORDERS}, {_DICTIONARY} SELECT g.rg, g.ord, d.id FROM g JOIN d ON g.rg = d.rg AND g.o_orderpriority = d.value",
    "dictionary_decode": f"WITH {_ORDERS}, {_DICTIONARY} SELECT g.ord, d.id, g.o_orderpriority AS value FROM g JOIN d ON g.rg = d.rg AND g.o_orderpriority = d.value",
    "dictionary_benefit": "WITH o AS (SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS ord, * FROM part), g AS (SELECT ord // 512 AS rg, * FROM o) "
    + _benefit("p_brand") + " UNION ALL " + _benefit("p_name"),
    "dictionary_page_support": f"WITH {_ORDERS} " + " UNION ALL ".join(
        f"""SELECT rg AS row_group, '{c}' AS "column", count(DISTINCT {c}) * 2 < count(*) AS supported FROM g GROUP BY rg""" for c in ("o_orderkey", "o_orderpriority")
    ),
    "kv_first_wins": "SELECT 'region ' || n_regionkey AS key, arg_min(n_name, n_nationkey) AS value FROM nation GROUP BY n_regionkey",
    "kv_written": "SELECT * FROM (VALUES ('colour', 'green'), ('colour', 'blue'), ('shape', 'round')) AS v(key, value)",
    "append": "WITH o AS (SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS ord, * FROM orders) SELECT o_orderkey, o_totalprice, ord, CAST(ord >= (SELECT count(*) // 2 FROM orders) AS BIGINT) AS source_no FROM o",
    "append_three_sources": "WITH o AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS ord, n_nationkey, n_name FROM nation) SELECT n_nationkey, n_name, CAST(ord + s * (SELECT count(*) FROM nation) AS BIGINT) AS ord, s AS source_no FROM o, (VALUES (CAST(0 AS BIGINT)), (1), (2)) AS v(s)",
    "reorder_row_groups": f"WITH {_ORDERS} SELECT CAST(row_number() OVER (ORDER BY rg DESC, ord) - 1 AS BIGINT) AS new_ord, ord, o_totalprice AS v FROM g",
    "add_column": f"WITH {_ORDERS} SELECT rg, ord, o_totalprice, o_custkey % 10 AS last_digit FROM g",
    "assemble_select_columns": "SELECT p_size, p_partkey, p_brand FROM part",
    "builder_row_mismatch": "SELECT CAST(s AS BIGINT) AS source_no, n AS num_rows, CAST(d AS BIGINT) AS declared, n = d AS ok FROM (SELECT 0 AS s, count(*) AS n, 10000 AS d FROM events UNION ALL SELECT 1, count(*), 100 FROM events WHERE event_id < 100 UNION ALL SELECT 2, count(*), 100 FROM events WHERE event_id < 50)",
    "row_group_sizes": f"WITH {_CHUNKS} SELECT rg, count(*) AS num_columns, max(n) AS num_rows, CAST(sum(sz) AS BIGINT) AS bytes FROM e GROUP BY rg",
    "relocate_offsets": f"WITH {_CHUNKS} SELECT rg, col, sz, off - sz + 4 AS start_off FROM e",
    "copy_chunk": f"WITH {_ORDERS} SELECT ord, o_orderstatus FROM g WHERE rg = 2",
    "recompress_roundtrip": "SELECT * FROM supplier",
    "assemble_in_memory": f"WITH {_ORDERS} SELECT rg, ord, o_orderkey, o_totalprice, rg // 2 AS row_group, true AS whole FROM g",
    "write_row_groups": f"WITH {_CUSTOMERS} SELECT ord // 300 AS row_group, min(ord) AS start_row, count(*) AS num_rows FROM o GROUP BY 1",
    "physical_row_groups": f"WITH {_CUSTOMERS} SELECT ord // 300 AS rg, ord % 300 AS pos_in_rg, ord, c_custkey FROM o",
    "write_layout_roundtrip": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
    "schema_order": """SELECT CAST((SELECT count(*) FROM information_schema.columns WHERE table_name = 'region') - ordinal_position AS BIGINT) AS position, column_name AS "column",
 CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' END AS type FROM information_schema.columns WHERE table_name = 'region'""",
    "infer_schema_types": """SELECT DISTINCT table_name AS "table", CAST(ordinal_position - 1 AS BIGINT) AS position, column_name AS "column",
 CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'DOUBLE[]' THEN 'array<double>' END AS type
 FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'labels', 'conversations', 'pages', 'benchmark')""",
    "footer_files": f"WITH {_FILES} SELECT file_no, count(*) AS num_rows, count(DISTINCT row_group) AS num_row_groups, CAST(7 AS BIGINT) AS num_columns, true AS footer_at_end FROM f GROUP BY file_no",
    "footer_row_groups": f"WITH {_FILES} SELECT file_no, row_group, min(ord) % 4000 AS start_row, count(*) AS num_rows FROM f GROUP BY file_no, row_group",
    "footer_column_chunks": f"""WITH {_FILES} SELECT file_no, row_group, c AS col, n AS "column", p AS physical, 'ZSTD' AS codec, count(*) AS num_values, true AS follows
 FROM f, (VALUES (CAST(0 AS BIGINT), 'o_orderkey', 'INT64'), (1, 'o_custkey', 'INT64'), (2, 'o_orderstatus', 'BYTE_ARRAY'), (3, 'o_totalprice', 'DOUBLE'), (4, 'o_orderdate', 'INT64'), (5, 'o_orderpriority', 'BYTE_ARRAY'), (6, 'ord', 'INT64')) AS v(c, n, p) GROUP BY ALL""",
    "footer_source": f"WITH {_FILES} SELECT file_no, count(*) AS num_rows, count(DISTINCT row_group) AS num_row_groups, CAST(7 AS BIGINT) AS num_columns FROM f GROUP BY file_no",
    "row_group_source": f"WITH {_CUSTOMERS} SELECT ord // 30 AS rg, ord AS position, c_custkey, c_name FROM o WHERE ord // 30 IN (1, 3)",
    "raw_chunk_bytes": f"WITH {_CUSTOMERS} " + " UNION ALL ".join(
        f"""SELECT ord // 300 AS row_group, '{c}' AS "column", count(*) AS num_values, arg_min({t}, ord) AS first_value, arg_max({t}, ord) AS last_value, max({t}) AS largest, true AS again FROM o GROUP BY 1"""
        for c, t in (("ord", "CAST(ord AS VARCHAR)"), *_CUSTOMER_TEXT.items())
    ),
    "byte_ranges": "WITH o AS (SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS ord, event_id FROM events) SELECT ord // 4000 AS row_group, ord % 4000 AS pos, event_id, 'PAR1PAR1' AS ends FROM o",
    "split_row_groups": f"WITH {_ORDERS} SELECT rg, ord, o_orderkey, o_totalprice FROM g",
    "overlap_parts": f"WITH {_FIXED} SELECT n, rg, CAST(least(p_end, r_end) - greatest(p_start, r_start) AS BIGINT) AS bytes FROM (SELECT n, greatest(p_start, 4) AS p_start, p_end FROM p) JOIN s ON p_start < r_end AND r_start < p_end",
    "overlap_at_boundaries": f"""WITH {_CHUNKS}, b AS (SELECT min(r_end) AS a, max(r_end) AS z FROM s),
 p AS (SELECT CAST(0 AS BIGINT) AS n, 4 AS p_start, a - 1 AS p_end FROM b UNION ALL SELECT 1, a - 1, a FROM b UNION ALL SELECT 2, a, a + 1 FROM b UNION ALL SELECT 3, a + 1, z FROM b)
 SELECT n, rg, CAST(least(p_end, r_end) - greatest(p_start, r_start) AS BIGINT) AS bytes FROM p JOIN s ON p_start < r_end AND r_start < p_end""",
    "split_footer_offsets": f"WITH {_CHUNKS} SELECT e.rg, col, off - sz + 4 AS start_off, off - sz + 4 - r_start + 4 AS moved_off FROM e JOIN s ON e.rg = s.rg",
    "contiguity_check": f"WITH {_CHUNKS} SELECT rg, r_start, r_end, r_end > r_start AND coalesce(lag(r_end) OVER (ORDER BY rg) = r_start, r_start = 4) AS contiguous FROM s",
    "part_offsets": f"WITH {_FIXED} SELECT n AS part_no, p_start AS start, CAST(p_end - p_start AS BIGINT) AS size FROM p",
    "plan_parts": f"WITH RECURSIVE {_PLAN} SELECT n, cut FROM walk",
    "group_chunks_in_parts": f"""WITH RECURSIVE {_PLAN},
 part AS (SELECT n, cut AS p_start, lead(cut) OVER (ORDER BY n) AS p_end, (SELECT max(n) FROM walk) - 1 AS last FROM walk)
 SELECT part.n, count(*) AS num_chunks, CAST(sum(sz) + CASE WHEN part.n = 0 THEN 4 ELSE 0 END + CASE WHEN part.n = max(last) THEN 1000 ELSE 0 END AS BIGINT) AS bytes
 FROM e JOIN part ON off - sz >= p_start AND off - sz < p_end GROUP BY part.n""",
    "max_part_check": f"WITH RECURSIVE {_PLAN} SELECT count(*) - 1 AS num_parts, count(*) - 1 <= 10000 AS ok FROM walk",
    "shared_dictionary": f"WITH {_ORDERS} SELECT rg, ord, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS id, o_orderpriority FROM g",
    "copy_and_fresh_chunks": f"WITH {_CUSTOMERS} SELECT ord // 300 AS rg, c_custkey, c_custkey % 10 AS last_digit FROM o",
    "assemble_upload": f"WITH {_CUSTOMERS} SELECT CAST(row_number() OVER (ORDER BY ord // 300 DESC, ord) - 1 AS BIGINT) AS ord, c_name, c_custkey FROM o",
    "upload_parts": "SELECT n_name, CAST((SELECT sum(1 + octet_length(CAST(n_name AS BLOB))) FROM nation) AS BIGINT) AS size FROM nation",
    "incremental_writer": f"WITH {_ORDERS} SELECT rg, ord, o_orderkey % 7 = 0 AS is_null, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS v FROM g",
    "write_checks": "SELECT c AS \"case\", CASE WHEN c = 'right' THEN (SELECT count(*) FROM nation) ELSE 0 END AS num_rows FROM (VALUES ('right'), ('rows'), ('column missing'), ('column too many')) AS v(c)",
    "write_grouped_files": f"WITH {_FILES} SELECT file_no, row_group AS rg, ord % 1000 AS pos_in_rg, o_orderkey FROM f",
    "page_layout": f"WITH {_ORDERS} " + " UNION ALL ".join(
        f"""SELECT ord // 2000 AS row_group, '{c}' AS "column", ord % 2000 // 500 AS page, 'v2' AS kind, count(*) AS num_values, 'SNAPPY' AS codec FROM o GROUP BY ALL""" for c in ("o_orderkey", "o_totalprice")
    ),
    "column_chunk": f"WITH {_CUSTOMERS} SELECT ord // 300 AS row_group, CAST(1 AS BIGINT) AS col, 'c_name' AS \"column\", 'BYTE_ARRAY' AS physical, count(*) AS num_values FROM o WHERE ord // 300 = 1 GROUP BY 1",
    "row_group_reader": f"WITH {_FILES} SELECT file_no, ord % 4000 AS position, o_orderkey, o_totalprice FROM f WHERE row_group = 1",
    "split_files": f"WITH {_FILES} SELECT file_no, row_group, ord % 1000 AS pos, o_orderkey, o_totalprice FROM f",
    "split_file_footers": f"""WITH {_FILES} SELECT file_no, row_group, CAST(0 AS BIGINT) AS new_group, n AS "column", count(*) AS num_values, true AS follows FROM f,
 (VALUES ('o_orderkey'), ('o_custkey'), ('o_orderstatus'), ('o_totalprice'), ('o_orderdate'), ('o_orderpriority'), ('ord')) AS v(n) GROUP BY ALL""",
    "upload_buffers": f"""WITH RECURSIVE {_CHUNKS}, b AS (SELECT rg, CAST(sum(sz) AS BIGINT) AS n FROM e GROUP BY rg),
 w AS (SELECT rg, CAST(0 AS BIGINT) AS part, n AS buffered FROM b WHERE rg = 0
  UNION ALL SELECT b.rg, CASE WHEN buffered >= 200000 THEN part + 1 ELSE part END, CASE WHEN buffered >= 200000 THEN n ELSE buffered + n END FROM w JOIN b ON b.rg = w.rg + 1)
 SELECT rg, part, buffered FROM w""",
}
