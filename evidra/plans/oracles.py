"""SQL that DuckDB runs on the same tables, for each query that SQL can express."""

from __future__ import annotations

from . import canonical

_ORDERS = """
l AS (SELECT l_orderkey, count(*)::DOUBLE AS n_lines, sum(CAST(round(l_discount * 100) AS BIGINT)) / count(*) / 100 AS mean_discount,
    sum(CAST(round(l_tax * 100) AS BIGINT)) / count(*) / 100 AS mean_tax, sum(CAST(l_quantity AS BIGINT)) / count(*) AS mean_quantity FROM lineitem GROUP BY l_orderkey),
o AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
    CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'P' THEN 'HOLD' ELSE 'PASS' END AS official, n_lines, mean_discount, mean_tax, mean_quantity
    FROM orders LEFT JOIN l ON o_orderkey = l_orderkey),
s AS (SELECT *, greatest(0, (150000 - o_totalprice) / 150000) AS sy, greatest(0, (mean_discount - 0.06) / 0.06) AS sm,
    greatest(0, (mean_tax - 0.05) / 0.05) AS sd, greatest(0, (2 - n_lines) / 2) AS sg,
    o_totalprice IS NULL OR mean_discount IS NULL OR mean_tax IS NULL OR n_lines IS NULL AS missing,
    o_totalprice >= 150000 AND mean_discount <= 0.06 AND mean_tax <= 0.05 AND n_lines >= 2 AND coalesce(mean_quantity > 20, true) AS ok FROM o),
t AS (SELECT *, CASE WHEN o_totalprice IS NULL THEN 0 ELSE sy END AS ny, CASE WHEN mean_discount IS NULL THEN 0 ELSE sm END AS nm,
    CASE WHEN mean_tax IS NULL THEN 0 ELSE sd END AS nd, CASE WHEN n_lines IS NULL THEN 0 ELSE sg END AS ng FROM s),
v AS (SELECT *, 0.0::DOUBLE + ny + nm * 0.1904::DOUBLE + nd * 0.5644::DOUBLE + ng * 0.0758::DOUBLE AS wsev, 0.0::DOUBLE + ny + nm + nd + ng AS esev FROM t),
w AS (SELECT *, CASE WHEN missing THEN 'HOLD' WHEN ok THEN 'PASS' WHEN wsev > 0.15::DOUBLE THEN 'FAIL' ELSE 'HOLD' END AS computed FROM v)
"""

_PARTS = """
b AS (SELECT p_brand, sum(CAST(round(p_retailprice * 100) AS BIGINT)) / count(*) / 100 AS brand_price FROM part GROUP BY p_brand),
l AS (SELECT l_partkey, count(*) AS n_lines, sum(CAST(round(l_tax * 100) AS BIGINT)) / count(*) / 100 AS tax_mean FROM lineitem GROUP BY l_partkey),
f AS (SELECT p_partkey, p_type, p_size, round(100 * p_retailprice / brand_price, 2) AS ratio_pct, round(tax_mean, 4) AS tax_mean,
    CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE coalesce(n_lines, 0) END AS n_used
    FROM part JOIN b USING (p_brand) LEFT JOIN l ON p_partkey = l_partkey),
g AS (SELECT *, coalesce(ratio_pct < 60, false) AS r1, coalesce(p_size > 45, false) AS r2, coalesce(ratio_pct < 95, false) AND NOT coalesce(ratio_pct < 60, false) AS a1,
    coalesce(p_size > 30, false) AND NOT coalesce(p_size > 45, false) AS a2, coalesce(tax_mean > 0.045, false) AS a3, coalesce(p_type = 'STANDARD', false) AS a4,
    n_used > 0 AND n_used < 20 AS a5 FROM f),
h AS (SELECT *, CASE WHEN n_used = 0 THEN 'AMBER' WHEN r1 OR r2 THEN 'RED' WHEN a1 OR a2 OR a3 OR a4 OR a5 THEN 'AMBER' ELSE 'GREEN' END AS colour FROM g)
"""

_YEARS = """
a AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
b AS (SELECT * REPLACE (o_totalprice * 1.1 AS o_totalprice) FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')
"""

_LABELLED = "x AS (SELECT doc_id, source, lang, n_chars, quality FROM documents JOIN labels USING (doc_id))"

ORACLES: dict[str, str] = {
    "rules_trial_verdict": f"""WITH {_ORDERS} SELECT o_orderkey, official, computed, official AS verdict,
        CASE official WHEN 'PASS' THEN 'GREEN' WHEN 'HOLD' THEN 'AMBER' ELSE 'RED' END AS colour, official = computed AS agrees, round(wsev, 6) AS severity,
        CASE WHEN r = '' THEN 'all criteria met' ELSE r END AS reason FROM (SELECT *, concat_ws('; ',
            CASE WHEN NOT o_totalprice >= 150000 THEN 'price below target' END, CASE WHEN NOT mean_discount <= 0.06 THEN 'discount above target' END,
            CASE WHEN NOT mean_tax <= 0.05 THEN 'tax elevated' END, CASE WHEN NOT n_lines >= 2 THEN 'lines below target' END,
            CASE WHEN NOT mean_quantity > 20 THEN 'quantity below target' END) AS r FROM w)""",
    "rules_gate_and_severity_modes": f"""WITH {_ORDERS} SELECT o_orderkey,
        CASE WHEN missing THEN 'HOLD' WHEN ok THEN 'PASS' WHEN o_totalprice < 150000 THEN 'FAIL' ELSE 'HOLD' END AS gate,
        CASE WHEN missing THEN 'HOLD' WHEN ok THEN 'PASS' WHEN esev > 0.4::DOUBLE THEN 'FAIL' ELSE 'HOLD' END AS severity FROM w""",
    "rules_evidence_rows": f"""WITH {_ORDERS} SELECT o_orderkey, rule, field, round(value_num, 6) AS value_num, op, threshold, passed, CASE WHEN passed THEN good ELSE bad END AS statement FROM (
        SELECT o_orderkey, 'yield' AS rule, 'o_totalprice' AS field, o_totalprice AS value_num, '>=' AS op, 150000.0::DOUBLE AS threshold, o_totalprice >= 150000 AS passed, 'price meets threshold' AS good, 'price below target' AS bad FROM w
        UNION ALL SELECT o_orderkey, 'moisture', 'mean_discount', mean_discount, '<=', 0.06::DOUBLE, mean_discount <= 0.06, 'discount meets threshold', 'discount above target' FROM w
        UNION ALL SELECT o_orderkey, 'disease', 'mean_tax', mean_tax, '<=', 0.05::DOUBLE, mean_tax <= 0.05, 'tax acceptable', 'tax elevated' FROM w
        UNION ALL SELECT o_orderkey, 'genomic_value', 'n_lines', n_lines, '>=', 2.0::DOUBLE, n_lines >= 2, 'lines favourable', 'lines below target' FROM w
        UNION ALL SELECT o_orderkey, 'extra', 'mean_quantity', mean_quantity, '>', 20.0::DOUBLE, mean_quantity > 20, 'meets threshold', 'quantity below target' FROM w) WHERE value_num IS NOT NULL""",
    "rules_shortfalls": f"""WITH {_ORDERS} SELECT o_orderkey, round(ny, 6) AS short_yield, round(nm, 6) AS short_moisture, round(nd, 6) AS short_disease, round(ng, 6) AS short_genomic_value FROM w""",
    "rules_candidate_share": f"""WITH {_ORDERS}, a AS (SELECT o_custkey, count(*) AS n, avg((official = 'FAIL')::INT) AS share FROM w GROUP BY o_custkey),
        c AS (SELECT c_custkey AS o_custkey, coalesce(n, 0) AS n_records, share AS fail_share, CASE WHEN coalesce(n, 0) = 0 THEN 'HOLD' WHEN share >= 0.6 THEN 'FAIL'
            WHEN share <= 0.5 AND n >= 3 AND round(c_acctbal) >= 102 THEN 'PASS' ELSE 'HOLD' END AS verdict FROM customer LEFT JOIN a ON c_custkey = o_custkey)
        SELECT o_custkey, n_records, round(fail_share, 6) AS fail_share, verdict, CASE verdict WHEN 'PASS' THEN 'GREEN' WHEN 'HOLD' THEN 'AMBER' ELSE 'RED' END AS colour FROM c""",
    "rules_candidate_rag": f"""WITH {_PARTS} SELECT p_partkey, colour AS computed_colour, colour, CASE
        WHEN n_used = 0 THEN 'No field data yet (genotyped only) - cannot judge performance'
        WHEN r1 OR r2 THEN concat_ws('; ', CASE WHEN r1 THEN printf('price vs brand %.1f%% below minimum 60%%', ratio_pct) END, CASE WHEN r2 THEN printf('size %.1f above limit 45.0', p_size::DOUBLE) END)
        WHEN colour = 'AMBER' THEN concat_ws('; ', CASE WHEN a1 THEN printf('price vs brand %.1f%% below target 95%%', ratio_pct) END, CASE WHEN a2 THEN printf('size %.1f above target 30.0', p_size::DOUBLE) END,
            CASE WHEN a3 AND tax_mean > 0.06 THEN printf('tax %.1f above limit 0.1', tax_mean) WHEN a3 THEN printf('tax %.1f above target 0.0', tax_mean) END, CASE WHEN a4 THEN 'disease-susceptible marker' END,
            CASE WHEN a5 THEN 'only ' || n_used || ' usable trial' END)
        ELSE 'all criteria met' END AS reason FROM h""",
    "rules_record_verdict": f"""WITH {_PARTS} SELECT p_partkey, CASE WHEN NOT n_used > 0 THEN 'EXCLUDED' WHEN coalesce(ratio_pct < 95, false) OR coalesce(p_size / 5.0 > 6, false) THEN 'FAIL'
        WHEN coalesce(ratio_pct < 103, false) OR coalesce(p_size / 5.0 > 4, false) OR coalesce(tax_mean * 500 > 23, false) THEN 'HOLD' ELSE 'PASS' END AS verdict FROM f""",
    "rules_parity": f"""WITH {_ORDERS} SELECT count(*) FILTER (WHERE official = computed) AS agree, count(official) AS total, round(count(*) FILTER (WHERE official = computed) / count(official), 6) AS accuracy FROM w""",
    "rules_confusion": f"""WITH {_ORDERS} SELECT official, computed, count(*) AS n FROM w GROUP BY ALL""",
    "rules_evidence_reread": f"""WITH {_ORDERS} SELECT CAST(o_orderkey AS VARCHAR) AS record, 'o_totalprice' AS field, round(o_totalprice, 6) AS cited, round(o_totalprice + 1, 6) AS found FROM w WHERE o_orderkey % 13 = 0 AND o_totalprice IS NOT NULL""",
    "rules_what_if": f"""WITH {_ORDERS}, z AS (SELECT *, greatest(0, (150000 - o_totalprice * 0.8) / 150000) AS ay FROM w), y AS (SELECT *, CASE WHEN missing THEN 'HOLD'
        WHEN o_totalprice * 0.8 >= 150000 AND mean_discount <= 0.06 AND mean_tax <= 0.05 AND n_lines >= 2 AND coalesce(mean_quantity > 20, true) THEN 'PASS'
        WHEN ay + nm * 0.1904::DOUBLE + nd * 0.5644::DOUBLE + ng * 0.0758::DOUBLE > 0.15::DOUBLE THEN 'FAIL' ELSE 'HOLD' END AS alt FROM z)
        SELECT count(*) FILTER (WHERE computed <> alt) AS n_changed, count(*) FILTER (WHERE computed = official) AS parity_reported, count(*) FILTER (WHERE alt = official) AS parity_recomputed FROM y""",
    "recompute_summary": """WITH l AS (SELECT l_orderkey AS k, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, count(*) AS n FROM lineitem GROUP BY 1),
        a AS (SELECT CASE WHEN k % 29 = 0 THEN NULL ELSE round(cents / 100) + CASE WHEN k % 13 = 0 THEN 2 ELSE 0 END END AS total, cents / 100 AS mine, n + CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END AS n_lines, n FROM l)
        SELECT 'total' AS field, count(total) AS compared, round(max(abs(total - mine)), 4) AS max_abs_diff, 0.501::DOUBLE AS tolerance, count(*) FILTER (WHERE abs(total - mine) > 0.501) AS outside_tolerance, count(*) FILTER (WHERE total IS NULL) AS missing_on_one_side FROM a
        UNION ALL SELECT 'n_lines', count(*), max(abs(n_lines - n))::DOUBLE, 0.0::DOUBLE, count(*) FILTER (WHERE n_lines <> n), 0 FROM a""",
    "recompute_ratio_of_means": """SELECT l_suppkey, round(100 * avg(l_extendedprice) / avg(p_retailprice), 4) AS ratio_pct FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
    "recompute_excluded_orders": """SELECT o_orderstatus, count(*) AS n_kept FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'R') GROUP BY 1""",
    "reconcile_keyed": """WITH u AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END AS k,
            CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 100 WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS p FROM orders),
        j AS (SELECT k, b.o_orderkey IS NOT NULL AS known, p IS NOT NULL AND NOT abs(b.o_totalprice - p) <= 1e-8 + 1e-5 * abs(p) AS differs FROM u LEFT JOIN orders b ON b.o_orderkey = u.k)
        SELECT k AS o_orderkey, CASE WHEN known AND differs THEN 'conflict' WHEN known THEN 'duplicate' ELSE 'new' END AS outcome, CASE WHEN known AND differs THEN 1 ELSE 0 END AS n_conflicts FROM j""",
    "reconcile_keyless": """WITH b AS (SELECT DISTINCT l_orderkey, l_quantity, l_returnflag FROM lineitem WHERE l_linestatus = 'F'), u AS (SELECT l_orderkey, l_quantity, l_returnflag, count(*) AS c FROM lineitem GROUP BY ALL),
        j AS (SELECT u.*, b.l_orderkey IS NULL AS fresh FROM u LEFT JOIN b ON u.l_orderkey = b.l_orderkey AND u.l_quantity = b.l_quantity AND u.l_returnflag = b.l_returnflag)
        SELECT 'new' AS outcome, count(*) FILTER (WHERE fresh) AS n FROM j UNION ALL SELECT 'duplicate', CAST(sum(c) - count(*) FILTER (WHERE fresh) AS BIGINT) FROM j""",
    "reconcile_natural_key": """WITH u AS (SELECT s_suppkey + CASE WHEN s_suppkey % 4 = 0 THEN 100000 ELSE 0 END AS k, CASE WHEN s_suppkey % 8 = 0 THEN s_name || 'x' ELSE s_name END AS nm FROM supplier)
        SELECT k AS s_suppkey, CASE WHEN b.s_suppkey IS NOT NULL AND b.s_name <> u.nm THEN 'conflict' WHEN b.s_suppkey IS NOT NULL THEN 'duplicate' WHEN n.s_name IS NOT NULL THEN 'natural_clash' ELSE 'new' END AS outcome
        FROM u LEFT JOIN supplier b ON b.s_suppkey = u.k LEFT JOIN supplier n ON n.s_name = u.nm""",
    "canonical_values": """WITH x AS (SELECT o_orderkey % 5 AS m, o_orderkey FROM orders) SELECT CASE m WHEN 0 THEN 'missing' WHEN 1 THEN 'num' WHEN 2 THEN 'bool' WHEN 3 THEN 'text' ELSE 'ts' END AS kind, m = 1 AS is_key, count(*) AS n FROM x GROUP BY ALL""",
    "join_reference_share": """WITH l AS (SELECT CASE WHEN l_orderkey % 9 = 0 THEN l_orderkey + 1000000000 ELSE l_orderkey END AS k FROM lineitem), c AS (SELECT CASE WHEN o_custkey % 7 = 0 THEN o_custkey + 1000000000 ELSE o_custkey END AS k FROM orders WHERE o_custkey % 10 <> 4)
        SELECT 'lineitem.l_orderkey -> orders' AS reference, count(*) AS n_references, count(o_orderkey) AS n_resolved, round(count(o_orderkey) / count(*), 6) AS share FROM l LEFT JOIN orders ON k = o_orderkey
        UNION ALL SELECT 'orders.o_custkey -> customer', count(*), count(c_custkey), round(count(c_custkey) / count(*), 6) FROM c LEFT JOIN customer ON k = c_custkey""",
    "join_orphans_flagged": """SELECT l_returnflag, count(*) FILTER (WHERE l_orderkey % 9 = 0) AS n_orphans, count(*) AS n_lines FROM lineitem GROUP BY 1""",
    "join_orphan_reassignment": """WITH o AS (SELECT s_nationkey, s_acctbal > 0 AS s, count(DISTINCT s_suppkey) AS n, min(s_suppkey) AS m FROM supplier GROUP BY ALL)
        SELECT c_custkey, coalesce(n, 0) AS n_options, CASE WHEN n = 1 THEN CAST(m AS VARCHAR) END AS proposed FROM customer LEFT JOIN o ON c_nationkey = s_nationkey AND (c_acctbal > 0) = s""",
    "join_feature_table": """WITH o AS (SELECT o_custkey, count(*) AS n, min(o_orderdate) AS f FROM orders GROUP BY 1) SELECT c_custkey, n_name, r_name, coalesce(n, 0) AS n_orders, CAST(year(f) AS INT) AS first_year
        FROM customer LEFT JOIN o ON c_custkey = o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "join_lineage": """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey > 10 THEN p_partkey // 2 END AS mother, p_partkey + 100 AS father FROM part)
        SELECT p.p_partkey, coalesce(m.p_name, CAST(mother AS VARCHAR)) AS mother_name, coalesce(f.p_name, CAST(father AS VARCHAR)) AS father_name FROM p LEFT JOIN part m ON m.p_partkey = mother LEFT JOIN part f ON f.p_partkey = father""",
    "join_compare_suppliers": """SELECT a.s_suppkey AS a, b.s_suppkey AS b, round(sqrt((round(a.s_acctbal, 2) - round(b.s_acctbal, 2)) ** 2 + (a.s_nationkey - b.s_nationkey) ** 2), 4) AS distance
        FROM supplier a, supplier b WHERE a.s_suppkey IN (1, 2, 3, 5, 8, 13) AND b.s_suppkey IN (1, 2, 3, 5, 8, 13)""",
    "join_latest_review": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events WHERE event_type = 'error') SELECT u.user_id, event_id, round(value, 6) AS value FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN e ON u.user_id = e.user_id AND n = 1""",
    "join_check_yield": """WITH c AS (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) / count(*) AS c FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), o AS (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) / count(*) AS o FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
        SELECT o.l_orderkey, round(o, 6) AS own_mean, round(c, 6) AS check_mean, round(100 * o / c, 6) AS vs_check_pct FROM o LEFT JOIN c ON o.l_orderkey = c.l_orderkey""",
    "join_nested_messages": """SELECT conv_id, string_agg(role, ',' ORDER BY turn, role) AS roles, count(*) AS n_turns FROM conversations GROUP BY 1""",
    "agg_grouped": """SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 3) AS avg_qty, strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S') AS min_ship, round(sum(l_extendedprice), 3) AS sum_price, count(*) AS n, count(DISTINCT l_suppkey) AS n_suppliers, bool_or(l_discount > 0.09) AS any_deep FROM lineitem GROUP BY 1, 2""",
    "agg_conditional_share": """SELECT l_suppkey, round(100 * avg((l_orderkey % 10 <> 0 AND l_returnflag = 'R')::INT), 6) AS returned_pct FROM lineitem GROUP BY 1""",
    "agg_pivot_mean": """SELECT l_suppkey, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'A'), 6) AS qty_a, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'N'), 6) AS qty_n, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'R'), 6) AS qty_r FROM lineitem GROUP BY 1""",
    "agg_sorted_unique_list": """SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1""",
    "agg_distinct_pairs": """SELECT o_custkey, count(DISTINCT (o_orderpriority, year(o_orderdate))) AS n_environments FROM orders GROUP BY 1""",
    "agg_value_counts": """SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1""",
    "agg_keep_first_and_last": """SELECT user_id, arg_min(event_id, ts) AS first_id, arg_max(event_id, ts) AS last_id FROM events GROUP BY 1""",
    "agg_crosstab_cube": """SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping_id(o_orderstatus, o_orderpriority) AS INT) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
    "agg_rollup_region": """SELECT CAST(n_regionkey AS VARCHAR) AS n_regionkey, c_mktsegment, count(*) AS n, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_mktsegment)""",
    "agg_statistics": """SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 3) AS median, round(quantile_cont(o_totalprice, 0.9), 3) AS p90, round(stddev_samp(o_totalprice), 3) AS std, round(corr(o_totalprice, o_custkey), 3) AS corr, round(max(abs(o_totalprice - 100000)), 3) AS max_gap FROM orders GROUP BY 1""",
    "agg_largest_three": """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3""",
    "agg_null_propagating_cost": """SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_id % 97 = 0) = 0 THEN CAST(sum(CAST(round(value * 100) AS BIGINT)) AS VARCHAR) END AS cost, count(*) AS n FROM events GROUP BY 1""",
    "window_carry_forward": """SELECT user_id, event_id, round(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) AS last_purchase FROM events""",
    "window_current_state": """SELECT user_id, round(arg_max(value, event_id) FILTER (WHERE event_type = 'purchase'), 6) AS purchase, max(event_id) FILTER (WHERE event_type = 'error') AS error_id FROM events GROUP BY 1""",
    "window_running_sum": """SELECT o_custkey, o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_cents FROM orders""",
    "window_merge_turns": """WITH c AS (SELECT *, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'other' END AS side FROM conversations), m AS (SELECT *, CASE WHEN lag(side) OVER (PARTITION BY conv_id ORDER BY turn) = side THEN 0 ELSE 1 END AS new FROM c),
        r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM m)
        SELECT conv_id, min(turn) AS turn, any_value(side) AS side, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM r GROUP BY conv_id, run""",
    "window_labels": """SELECT c_mktsegment, printf('LOC-%02d', row_number() OVER (ORDER BY c_mktsegment)) AS label FROM (SELECT DISTINCT c_mktsegment FROM customer)""",
    "set_operations": """WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O'), u AS (SELECT * FROM a UNION SELECT * FROM b), i AS (SELECT * FROM a INTERSECT SELECT * FROM b), m AS (SELECT * FROM a EXCEPT SELECT * FROM b)
        SELECT 'union' AS op, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS key_sum FROM u UNION ALL SELECT 'intersect', count(*), CAST(sum(o_custkey) AS BIGINT) FROM i UNION ALL SELECT 'minus', count(*), CAST(sum(o_custkey) AS BIGINT) FROM m""",
    "set_union_by_name": """SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey < 5 UNION ALL BY NAME SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey >= 20""",
    "serve_candidates": f"""WITH {_PARTS} SELECT p_partkey, colour, n_used FROM h WHERE colour = 'AMBER' AND n_used >= 3 ORDER BY p_partkey LIMIT 25""",
    "serve_colour_counts": f"""WITH {_PARTS} SELECT colour, count(*) AS n FROM h GROUP BY 1""",
    "serve_text_search": """SELECT 'customer' AS kind, CAST(c_custkey AS VARCHAR) AS id, 'c_name' AS matched FROM customer WHERE contains(lower(c_name), '0000007') UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), 's_name' FROM supplier WHERE contains(lower(s_name), '0000007')
        UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), 'n_name' FROM nation WHERE contains(lower(n_name), '0000007')""",
    "serve_index_search": r"""WITH t AS (SELECT 'customer' AS kind, c_custkey::VARCHAR AS id, 'c_name' AS field, c_name AS t FROM customer UNION ALL SELECT 'customer', c_custkey::VARCHAR, 'c_mktsegment', c_mktsegment FROM customer UNION ALL SELECT 'supplier', s_suppkey::VARCHAR, 's_name', s_name FROM supplier
            UNION ALL SELECT 'item', item_id::VARCHAR, 'text', text FROM benchmark UNION ALL SELECT 'document', doc_id::VARCHAR, 'text', text FROM documents),
        f AS (SELECT * REPLACE (regexp_replace(lower(strip_accents(t)), '\s+', ' ', 'g') AS t) FROM t WHERE t IS NOT NULL)
        SELECT kind, id, field, contains(t, 'uber')::BIGINT + contains(t, '000017')::BIGINT + contains(t, 'er t')::BIGINT AS needles FROM f WHERE needles > 0""",
    "serve_app_list": """WITH x AS (SELECT c_custkey, c_acctbal, count(*) OVER () AS total FROM customer WHERE c_mktsegment ILIKE '%u%' AND c_name ILIKE '%1%') SELECT * FROM x ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 10""",
    "serve_quarantine_flags": """WITH x AS (SELECT l_returnflag AS kind, CASE WHEN l_discount > 0.08 THEN 'M' WHEN l_tax > 0.06 THEN 'D' ELSE 'X' END AS s, l_linestatus FROM lineitem) SELECT kind, count(*) FILTER (WHERE s = 'D') AS n_delayed, count(*) FILTER (WHERE s = 'M') AS n_missed, count(*) FILTER (WHERE l_linestatus = 'O') AS n_offline FROM x GROUP BY 1""",
    "serve_read_only_sql": """SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "audit_effective_colours": f"""WITH {_PARTS}, e AS (SELECT CAST(user_id AS VARCHAR) AS r, arg_max(CASE event_type WHEN 'error' THEN 'RED' ELSE 'AMBER' END, event_id) AS c FROM events WHERE event_type IN ('error', 'view') GROUP BY 1),
        j AS (SELECT colour, coalesce(c, colour) AS eff, c IS NOT NULL AS o FROM h LEFT JOIN e ON CAST(p_partkey AS VARCHAR) = r)
        SELECT count(*) FILTER (WHERE colour = 'RED') AS engine_red, count(*) FILTER (WHERE colour = 'AMBER') AS engine_amber, count(*) FILTER (WHERE colour = 'GREEN') AS engine_green, count(*) FILTER (WHERE eff = 'RED') AS effective_red,
        count(*) FILTER (WHERE eff = 'AMBER') AS effective_amber, count(*) FILTER (WHERE eff = 'GREEN') AS effective_green, count(*) FILTER (WHERE o) AS n_overridden FROM j""",
    "profile_entropy": """WITH v AS (SELECT 'o_orderstatus' AS c, o_orderstatus AS v FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders
        UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer UNION ALL SELECT 'half', CASE WHEN c_custkey % 2 = 0 THEN 'x' END FROM customer), n AS (SELECT c, v, count(*) AS n FROM v GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY c) AS p FROM n)
        SELECT c AS "column", round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1""",
    "profile_roles": """WITH n AS (SELECT count(*) AS r, count(DISTINCT c_mktsegment) AS s, count(DISTINCT c_acctbal) AS a FROM customer)
        SELECT 'c_custkey' AS "column", r AS rows, r AS non_null, r AS "distinct", 'numeric' AS kind, 'identifier' AS role FROM n UNION ALL SELECT 'c_name', r, r, r, 'text', 'identifier' FROM n
        UNION ALL SELECT 'c_mktsegment', r, r, s, 'categorical', 'feature' FROM n UNION ALL SELECT 'c_acctbal', r, r, a, 'numeric', 'feature' FROM n UNION ALL SELECT 'constant', r, r, 1, 'constant', 'drop' FROM n
        UNION ALL SELECT 'empty', r, 0, 0, 'empty', 'drop' FROM n UNION ALL SELECT 'FREE_COMMENT', r, r, r, 'text', 'text' FROM n""",
    "profile_token_estimate": """SELECT CAST(ceil((sum(length(CAST(c_custkey AS VARCHAR)) + length(c_name) + length(c_mktsegment) + 3) + 30) / 4) AS BIGINT) AS tokens FROM customer""",
    "profile_identifiers": """SELECT DISTINCT 'CUST-' || c_custkey AS id FROM customer WHERE length('CUST-' || c_custkey) >= 6""",
    "identifier_families": """WITH v AS (SELECT 'customer' AS source, c_name AS v FROM customer UNION ALL SELECT 'priority', o_orderpriority FROM orders), s AS (SELECT source, v, regexp_replace(regexp_replace(regexp_replace(v, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g') AS shape FROM v),
        n AS (SELECT source, shape, count(*) AS n, count(DISTINCT v) AS n_distinct, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM s GROUP BY source, shape) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, shape) <= 5""",
    "identifier_positions": """WITH c AS (SELECT DISTINCT s_name FROM supplier), p AS (SELECT i AS pos, s_name[i + 1] AS ch FROM c, range(0, 18) t(i)), n AS (SELECT pos, ch, count(*) AS n FROM p GROUP BY ALL), q AS (SELECT *, n / sum(n) OVER (PARTITION BY pos) AS p FROM n)
        SELECT CAST(pos AS INT) AS pos, CASE WHEN regexp_matches(min(ch), '[A-Z]') THEN 'A' WHEN regexp_matches(min(ch), '[a-z]') THEN 'a' WHEN regexp_matches(min(ch), '[0-9]') THEN '9' ELSE min(ch) END AS class, count(*) AS n_symbols, round(-sum(p * log2(p)), 6) + 0.0 AS entropy, CASE WHEN count(*) = 1 THEN min(ch) END AS symbol FROM q GROUP BY pos""",
    "view_patterns": """WITH v AS (SELECT 'customer' AS name, 'Customer#' AS head, CASE WHEN c_custkey % 37 < 2 THEN 'Customer#' || lpad((c_custkey + 5000000)::VARCHAR, 9, '0') ELSE c_name END AS v FROM customer UNION ALL SELECT 'supplier', 'Supplier#', s_name FROM supplier),
        n AS (SELECT name, v, CAST(regexp_extract(v, '([0-9]+)$', 1) AS BIGINT) AS n FROM v), s AS (SELECT name, regexp_replace(regexp_replace(regexp_replace(v, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g') AS shape, n, v FROM n)
        SELECT name, shape, 'Aa{7}#9{9}' AS pattern, count(*) AS n, count(DISTINCT v) AS n_distinct, 1.0::DOUBLE AS share, min(n) AS least, max(n) AS largest, max(n) - min(n) + 1 - count(DISTINCT n) AS n_gaps FROM s GROUP BY name, shape""",
    "identifier_gaps": """WITH n AS (SELECT DISTINCT CASE WHEN c_custkey % 37 < 2 THEN c_custkey + 5000000 ELSE CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) END AS n FROM customer), s AS (SELECT n, lag(n) OVER (ORDER BY n) AS was FROM n) SELECT was + 1 AS lo, n - 1 AS hi FROM s WHERE n - was > 1""",
    "identifier_counter": """WITH n AS (SELECT DISTINCT CASE WHEN c_custkey % 37 < 2 THEN c_custkey + 5000000 ELSE CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) END AS n FROM customer) SELECT min(n) AS least, max(n) AS largest, count(*) AS n_distinct, max(n) - min(n) + 1 - count(*) AS n_gaps, max(n) - min(n) + 1 = count(*) AS contiguous FROM n""",
    "drift_stability": f"""WITH {_YEARS}, q AS (SELECT unnest(quantile_cont(o_totalprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM a), g AS (SELECT i AS bin FROM range(0, 10) t(i)),
        x AS (SELECT bin, count(*) AS n FROM (SELECT (SELECT count(*) FROM q WHERE o_totalprice > e) AS bin FROM a) GROUP BY 1), y AS (SELECT bin, count(*) AS n FROM (SELECT (SELECT count(*) FROM q WHERE o_totalprice > e) AS bin FROM b) GROUP BY 1),
        p AS (SELECT bin, greatest(coalesce(x.n / (SELECT count(*) FROM a), 0), 1e-4) AS e, greatest(coalesce(y.n / (SELECT count(*) FROM b), 0), 1e-4) AS a FROM g LEFT JOIN x USING (bin) LEFT JOIN y USING (bin)), s AS (SELECT sum((a - e) * ln(a / e)) AS psi FROM p)
        SELECT 'o_totalprice' AS "column", round(psi, 4) AS psi, round(((SELECT avg(o_totalprice) FROM b) - (SELECT avg(o_totalprice) FROM a)) / (SELECT stddev_samp(o_totalprice) FROM a), 4) AS mean_shift_sd, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'major' END AS status FROM s""",
    "drift_variation": f"""WITH {_YEARS}, c AS (SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus) FROM b),
        p AS (SELECT 'o_orderstatus' AS col, o_orderstatus AS v, count(*) / (SELECT count(*) FROM a) AS p FROM a GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) / (SELECT count(*) FROM a) FROM a GROUP BY 2),
        q AS (SELECT 'o_orderstatus' AS col, o_orderstatus AS v, count(*) / (SELECT count(*) FROM c) AS q FROM c GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) / (SELECT count(*) FROM c) FROM c GROUP BY 2)
        SELECT coalesce(p.col, q.col) AS "column", round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 6) AS tvd FROM p FULL JOIN q ON p.col = q.col AND p.v = q.v GROUP BY 1""",
    "drift_keys": f"""WITH {_YEARS}, x AS (SELECT DISTINCT o_custkey AS k FROM a), y AS (SELECT DISTINCT o_custkey AS k FROM b) SELECT (SELECT count(*) FROM y) AS seen, (SELECT count(*) FROM x WHERE k NOT IN (SELECT k FROM y)) AS lost, (SELECT count(*) FROM y WHERE k NOT IN (SELECT k FROM x)) AS gained""",
    "encode_table": """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS p, o_orderpriority AS r, o_orderstatus AS s, dayofyear(o_orderdate) - 1 AS dy FROM orders), m AS (SELECT avg(p) AS m, stddev_pop(p) AS sd FROM o)
        SELECT o_orderkey, round(coalesce((p - m) / sd, 0), 6) + 0.0 AS x0, round((CAST(r[1] AS INT) - 3) / sqrt(2), 6) + 0.0 AS x1, round(CASE s WHEN 'F' THEN 1 / sqrt(2) WHEN 'O' THEN -1 / sqrt(2) ELSE 0 END, 6) + 0.0 AS x2,
        round(CASE s WHEN 'P' THEN -2 / sqrt(6) ELSE 1 / sqrt(6) END, 6) AS x3, round(cos(2 * pi() * dy / 365.25), 6) + 0.0 AS x4, round(sin(2 * pi() * dy / 365.25), 6) + 0.0 AS x5 FROM o, m""",
    "neighbours_knn": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: round(x * 1000)::DOUBLE) AS x FROM embeddings), d AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, list_sum(list_transform(list_zip(a.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS distance2
            FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY distance2, neighbour) AS INT) AS rank FROM d QUALIFY rank <= 5""",
    "calibrate_bayes_ceiling": f"""WITH {_LABELLED}, n AS (SELECT source, lang, quality, count(*) AS n FROM x GROUP BY ALL), g AS (SELECT max(n) AS best, sum(n) AS n, count(*) AS k FROM n GROUP BY source, lang)
        SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(best) AS BIGINT) AS reachable, count(*) FILTER (WHERE k > 1) AS conflicting_inputs, round(sum(best) / sum(n), 6) AS ceiling FROM g""",
    "calibrate_roc": f"""WITH {_LABELLED}, c AS (SELECT n_chars::DOUBLE AS threshold, sum(quality) AS p, count(*) - sum(quality) AS n FROM x GROUP BY 1) SELECT threshold, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp,
        round(sum(p) OVER w / (SELECT sum(p) FROM c), 6) AS tpr, round(sum(n) OVER w / (SELECT sum(n) FROM c), 6) AS fpr FROM c WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)""",
    "calibrate_auc": f"""WITH {_LABELLED}, r AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS r, quality FROM x) SELECT round((sum(r) FILTER (WHERE quality = 1) - sum(quality) * (sum(quality) + 1) / 2) / (sum(quality) * (count(*) - sum(quality))), 6) AS auc FROM r""",
    "calibrate_flags": f"""WITH {_ORDERS} SELECT o_totalprice >= 150000 AS yield, mean_discount <= 0.06 AS moisture, mean_tax <= 0.05 AS disease, n_lines >= 2 AS genomic_value, count(*) AS n FROM w GROUP BY ALL""",
    "text_shapes": """WITH s AS (SELECT regexp_replace(regexp_replace(regexp_replace(o_orderpriority, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g') AS shape FROM orders) SELECT shape, count(*) AS n, CASE shape WHEN '9-AAAAAA' THEN '9-A{6}' WHEN '9-AAAA' THEN '9-A{4}' WHEN '9-AAA AAAAAAAAA' THEN '9-A{3} A{9}' WHEN '9-AAA' THEN '9-A{3}' END AS pattern FROM s GROUP BY ALL""",
    "text_fold": r"""SELECT doc_id, sha256(trim(regexp_replace(lower(strip_accents(coalesce(text, ''))), '\s+', ' ', 'g'))) AS folded FROM documents""",
    "text_char_grams": r"""WITH f AS (SELECT item_id, regexp_replace(trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g')), '\p{Nd}', '0', 'g') AS t FROM benchmark), w AS (SELECT item_id, ' ' || unnest(regexp_extract_all(t, '[\pL\pN_]+|[/%]')) || ' ' AS w FROM f),
        g AS (SELECT item_id, w[i:i + n - 1] AS gram FROM w, (SELECT unnest([3, 4, 5]) AS n), range(1, 80) r(i) WHERE i + n - 1 <= length(w)) SELECT item_id, gram, count(*) AS n FROM g GROUP BY ALL""",
    "text_strip_tags": r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(
        regexp_replace(regexp_replace(regexp_replace(html, '<script\b[^>]*>.*?</script\s*>', ' ', 'gis'), '<style\b[^>]*>.*?</style\s*>', ' ', 'gis'), '<noscript\b[^>]*>.*?</noscript\s*>', ' ', 'gis'),
        '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS body FROM pages""",
    "text_html_tables": r"""WITH t AS (SELECT page_id, unnest(x) AS t, unnest(range(len(x))) AS table_no FROM (SELECT page_id, regexp_extract_all(coalesce(html, '') || '<TABLE class="x">' || chr(10) || '<tr><th>Id</th><th>Length</th></tr><tr><td>' || page_id || '</td>' || chr(10) || '<td><b>' || length(html) || ' %</b></td></tr></TABLE>'
            || CASE WHEN page_id % 3 = 0 THEN '<p>between</p><table><tbody><tr><td>' || page_id * 2 || '</td></tr></tbody></table>' ELSE '' END, '(?is)<table.*?</table>') AS x FROM pages)),
        r AS (SELECT page_id, table_no, unnest(x) AS r, unnest(range(len(x))) AS row_no FROM (SELECT page_id, table_no, regexp_extract_all(t, '(?is)<tr.*?</tr>') AS x FROM t))
        SELECT page_id, table_no, row_no, array_to_string(list_transform(regexp_extract_all(r, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1), lambda c: regexp_replace(c, '(?s)<[^>]*>', '', 'g')), '|') AS cells FROM r""",
    "text_facts": """WITH o AS (SELECT o_orderkey, o_custkey, 'SYN-MZ-' || lpad(o_custkey::VARCHAR, 5, '0') AS id FROM orders) SELECT o_orderkey, 0 AS sentence_no, 'YIELD_T_HA' AS field, o_orderkey % 10 + (o_custkey % 10) / 10 AS value, 't/ha' AS unit, 'yield' AS matched, id AS ids FROM o
        UNION ALL SELECT o_orderkey, 1, NULL, NULL, NULL, NULL, 'SYN-TR-0001' FROM o UNION ALL SELECT o_orderkey, 2, 'MOISTURE_PCT', 18.0, '%', 'humedad', '' FROM o""",
    "text_tfidf_cosine": r"""WITH q AS (SELECT doc_id, g AS gram, 1 + ln(count(*)) AS tf FROM (SELECT doc_id, w[i:i + n - 1] AS g FROM (SELECT doc_id, ' ' || unnest(regexp_extract_all(regexp_replace(trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g')), '\p{Nd}', '0', 'g'), '[\pL\pN_]+|[/%]')) || ' ' AS w FROM documents WHERE doc_id % 100 = 0), (SELECT unnest([3, 4, 5]) AS n), range(1, 80) r(i) WHERE i + n - 1 <= length(w)) GROUP BY ALL), r AS (SELECT item_id, g AS gram, 1 + ln(count(*)) AS tf FROM (SELECT item_id, w[i:i + n - 1] AS g FROM (SELECT item_id, ' ' || unnest(regexp_extract_all(regexp_replace(trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g')), '\p{Nd}', '0', 'g'), '[\pL\pN_]+|[/%]')) || ' ' AS w FROM benchmark), (SELECT unnest([3, 4, 5]) AS n), range(1, 80) r(i) WHERE i + n - 1 <= length(w)) GROUP BY ALL),
        i AS (SELECT gram, ln((1 + (SELECT count(DISTINCT item_id) FROM r)) / (1 + count(*))) + 1 AS idf FROM r GROUP BY 1), rw AS (SELECT item_id, gram, tf * idf AS r FROM r JOIN i USING (gram)), rn AS (SELECT item_id, sqrt(sum(r * r)) AS n FROM rw GROUP BY 1),
        qw AS (SELECT doc_id, gram, tf * idf AS q FROM q JOIN i USING (gram)), qn AS (SELECT doc_id, sqrt(sum(q * q)) AS n FROM qw GROUP BY 1) SELECT doc_id, item_id, round(sum(q * r) / any_value(qn.n) / any_value(rn.n), 5) AS cosine FROM qw JOIN rw USING (gram) JOIN rn USING (item_id) JOIN qn USING (doc_id) GROUP BY ALL""",
    "text_lexicon": r"""WITH f AS (SELECT doc_id, trim(regexp_replace(lower(strip_accents(coalesce(text, ''))), '\s+', ' ', 'g')) AS t FROM documents), w AS (SELECT doc_id, regexp_extract_all(t, '[\pL\pN_]+') AS words, regexp_extract_all(t, '[\pL\pN_]+|[^\pL\pN_]+') AS parts FROM f),
        h AS (SELECT doc_id, len(words) AS n, len(list_filter(parts, lambda x: x = 'the')) AS n_the, len(list_filter(parts, lambda x: x = 'und')) AS n_und,
            len(list_filter(range(1, len(parts) - 1), lambda i: parts[i] = 'of' AND parts[i + 1] = ' ' AND parts[i + 2] = 'the')) AS n_of_the FROM w)
        SELECT doc_id, round(ln(1 + 100 * (n_the - n_of_the + 2.0 * n_und + 3.0 * n_of_the) / greatest(n, 20)), 5) AS feature FROM h""",
    "verify_cited_values": """WITH o AS (SELECT o_orderkey AS n, floor(o_totalprice / 1000 * 10 + 0.5) / 10 AS r, o_totalprice / 1000 AS k FROM orders),
        y AS (SELECT 'YIELD_T_HA' AS field, CASE WHEN abs(CASE WHEN n % 4 = 0 THEN round((k + 0.3)::DECIMAL(18, 6), 1) ELSE r::DECIMAL(18, 1) END - k::DECIMAL(18, 6)) <= 0.05 THEN 'supported' ELSE 'contradicted' END AS status FROM o)
        SELECT field, status, count(*) AS n FROM y GROUP BY ALL UNION ALL SELECT 'MOISTURE_PCT', 'supported', count(*) FROM o UNION ALL SELECT 'PLANT_HEIGHT_CM', 'unknown', count(*) FROM o WHERE n % 5 = 0""",
    "audit_ledger": """SELECT 'as appended' AS state, 0 AS faults UNION ALL SELECT 'batch ' || o_orderkey % 4, count(*) FROM orders GROUP BY o_orderkey % 4""",
    "serve_context": """WITH b AS (SELECT o_orderstatus AS s, log2(sum(count(*)) OVER () / count(*)) AS bits FROM orders GROUP BY 1),
        i AS (SELECT o_custkey, 'order ' || o_orderkey || ' is ' || o_orderstatus || CASE WHEN o_orderkey % 3 = 0 THEN ', and its priority was judged to be high' ELSE '' END AS t, bits, o_orderpriority = '1-URGENT' AS u FROM orders JOIN b ON o_orderstatus = s),
        c AS (SELECT *, ceil(length(t) / 4) AS c FROM i), r AS (SELECT *, sum(c) OVER w AS run, row_number() OVER w AS nth FROM c WINDOW w AS (PARTITION BY o_custkey ORDER BY u DESC, bits / c DESC, t ROWS UNBOUNDED PRECEDING))
        SELECT o_custkey, coalesce(string_agg(t, '; ' ORDER BY nth) FILTER (WHERE run <= 40), '') AS lines, coalesce(sum(c) FILTER (WHERE run <= 40), 0)::BIGINT AS tokens, count(*) FILTER (WHERE run <= 40) AS n_items, count(*) FILTER (WHERE run > 40) AS n_left_out,
            sum(c)::BIGINT AS tokens_of_all, round(1 - coalesce(sum(c) FILTER (WHERE run <= 40), 0) / sum(c), 6) AS saved FROM r GROUP BY 1""",
    "verify_repeated_warnings": """SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id, event_id % 3""",
    "quality_order_violations": """WITH p AS (SELECT l_orderkey, min(l_shipdate) FILTER (WHERE l_returnflag = 'A') AS a, min(l_shipdate) FILTER (WHERE l_returnflag = 'N') AS n, min(l_shipdate) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) SELECT l_orderkey FROM p WHERE n < a OR r < a""",
    "quality_single_environment": """SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT (year(o_orderdate), o_orderpriority)) = 1""",
    "quality_feature_gate": """SELECT round(avg((l_discount < 0.09)::INT), 6) AS share_ok, avg((l_discount < 0.09)::INT) >= 0.8 AS usable FROM lineitem""",
    "quality_issues": """WITH t AS (SELECT o_orderkey, year(o_orderdate) AS y FROM orders), l AS (SELECT * REPLACE (CASE WHEN l_orderkey % 9 = 0 THEN l_orderkey + 1000000000 ELSE l_orderkey END AS l_orderkey) FROM lineitem),
        a AS (SELECT l_orderkey AS k FROM l ANTI JOIN t ON l_orderkey = o_orderkey), b AS (SELECT l_orderkey AS k FROM l JOIN t ON l_orderkey = o_orderkey WHERE year(l_shipdate) <> y), c AS (SELECT l_orderkey AS k FROM l WHERE l_linestatus = 'O')
        SELECT 'linkage.orphans' AS id, 'linkage' AS category, 'warning' AS severity, count(*) AS count, CASE WHEN count(DISTINCT k) > 12 THEN array_to_string(list_sort(list(DISTINCT k::VARCHAR))[1:12], ',') || ',... +' || count(DISTINCT k) - 12 || ' more' ELSE array_to_string(list_sort(list(DISTINCT k::VARCHAR)), ',') END AS affected, 'proposed' AS fix_status FROM a HAVING count(*) > 0
        UNION ALL SELECT 'temporal.year', 'temporal', 'critical', count(*), CASE WHEN count(DISTINCT k) > 12 THEN array_to_string(list_sort(list(DISTINCT k::VARCHAR))[1:12], ',') || ',... +' || count(DISTINCT k) - 12 || ' more' ELSE array_to_string(list_sort(list(DISTINCT k::VARCHAR)), ',') END, 'applied' FROM b HAVING count(*) > 0 UNION ALL SELECT 'status.planned', 'status', 'warning', count(*), CASE WHEN count(DISTINCT k) > 12 THEN array_to_string(list_sort(list(DISTINCT k::VARCHAR))[1:12], ',') || ',... +' || count(DISTINCT k) - 12 || ' more' ELSE array_to_string(list_sort(list(DISTINCT k::VARCHAR)), ',') END, 'proposed' FROM c HAVING count(*) > 0""",
    "supplier_triage": """WITH a AS (SELECT l_suppkey, count(*) AS n, 100 * sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / sum(CAST(round(p_retailprice * l_quantity * 100) AS BIGINT)) AS ratio, 100 * count(*) FILTER (WHERE l_returnflag = 'R') / count(*) AS ret, sum(CAST(round(l_discount * 100) AS BIGINT)) / count(*) AS dis FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
        f AS (SELECT s_suppkey, s_name, coalesce(n, 0) AS n_used, ratio, ret, dis FROM supplier LEFT JOIN a ON s_suppkey = l_suppkey),
        g AS (SELECT *, CASE WHEN n_used = 0 THEN 'AMBER' WHEN ret > 36 THEN 'RED' WHEN ret > 33.5 OR dis > 5.05 OR n_used < 2 THEN 'AMBER' ELSE 'GREEN' END AS colour FROM f)
        SELECT s_suppkey, s_name, n_used, round(ratio, 4) AS ratio_pct, round(ret, 4) AS returned_pct, round(dis, 4) AS discount_pct, colour, CASE colour WHEN 'RED' THEN 0 WHEN 'AMBER' THEN 1 ELSE 2 END AS priority FROM g""",
    "rules_baseline": f"""WITH {_ORDERS} SELECT count(*) FILTER (WHERE official = computed) AS agree, count(official) AS total, round(count(*) FILTER (WHERE official = computed) / count(official), 6) AS accuracy,
        count(*) FILTER (WHERE official <> computed) AS n_not_explained, count(*) FILTER (WHERE o_orderkey % 19 <> 0) AS identical_reasons, count(*) AS n_reasons,
        array_to_string(list_sort(list(o_orderkey::VARCHAR) FILTER (WHERE official <> computed))[1:12], ',') AS not_explained FROM w""",
    "serve_envelope": f"""WITH {_PARTS}, a AS (SELECT p_partkey, count(*) OVER () AS total FROM h WHERE colour = 'AMBER') SELECT p_partkey, total::INT AS total, least(20, total)::INT AS returned, total > 20 AS truncated, 20 AS "limit" FROM a ORDER BY p_partkey LIMIT 20""",
    "serve_cards": """WITH o AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'FAIL' ELSE 'PASS' END AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
        a AS (SELECT o_custkey, count(*) AS n_trials, count(*) FILTER (WHERE v = 'FAIL') AS n_fail, string_agg(o_orderkey || ':' || v || ':' || o_orderpriority, ';' ORDER BY o_orderkey) FILTER (WHERE n <= 3) AS trials FROM o GROUP BY 1)
        SELECT c_custkey AS o_custkey, c_name, coalesce(n_trials, 0) AS n_trials, coalesce(n_fail, 0) AS n_fail, coalesce(trials, '') AS trials FROM customer LEFT JOIN a ON c_custkey = o_custkey""",
    "profile_ingestion": """WITH c AS (SELECT 'customer' AS "table", count(*) AS "rows", 4 AS "columns", 2 AS informative_columns, ceil((sum(length(c_custkey::VARCHAR) + length(c_name) + 5) + 32) / 4)::BIGINT AS tokens_raw,
            ceil((sum(length(c_custkey::VARCHAR) + length(c_name) + 2) + 17) / 4)::BIGINT AS tokens_renormalised FROM customer),
        n AS (SELECT 'nation', count(*), 3, 3, ceil((sum(length(n_nationkey::VARCHAR) + length(n_name) + length(n_regionkey::VARCHAR) + 3) + 31) / 4)::BIGINT AS t, t FROM nation), u AS (SELECT * FROM c UNION ALL SELECT * FROM n)
        SELECT *, NULL::DOUBLE AS token_reduction FROM u UNION ALL SELECT NULL, sum("rows")::BIGINT, sum("columns")::BIGINT, sum(informative_columns)::BIGINT, sum(tokens_raw)::BIGINT, sum(tokens_renormalised)::BIGINT, round(1 - sum(tokens_renormalised) / sum(tokens_raw), 6) FROM u""",
    "profile_renormalised": """SELECT c_custkey, c_mktsegment FROM customer""",
    "drift_report": f"""WITH {_YEARS}, q AS (SELECT unnest(quantile_cont(o_totalprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM a), g AS (SELECT i AS bin FROM range(0, 10) t(i)),
        x AS (SELECT bin, count(*) AS n FROM (SELECT (SELECT count(*) FROM q WHERE o_totalprice > e) AS bin FROM a) GROUP BY 1), y AS (SELECT bin, count(*) AS n FROM (SELECT (SELECT count(*) FROM q WHERE o_totalprice > e) AS bin FROM b) GROUP BY 1),
        p AS (SELECT greatest(coalesce(x.n / (SELECT count(*) FROM a), 0), 1e-4) AS e, greatest(coalesce(y.n / (SELECT count(*) FROM b), 0), 1e-4) AS a FROM g LEFT JOIN x USING (bin) LEFT JOIN y USING (bin)),
        l AS (SELECT 'o_orderstatus' AS c, o_orderstatus AS v, 1 AS s FROM a UNION ALL SELECT 'o_orderpriority', o_orderpriority, 1 FROM a UNION ALL SELECT 'o_orderstatus', o_orderstatus, 2 FROM b UNION ALL SELECT 'o_orderpriority', o_orderpriority, 2 FROM b),
        k AS (SELECT c, v, count(*) FILTER (WHERE s = 1) / (SELECT count(*) FROM a) AS pa, count(*) FILTER (WHERE s = 2) / (SELECT count(*) FROM b) AS pb FROM l GROUP BY ALL),
        r AS (SELECT 'o_totalprice' AS "column", 'psi' AS kind, (SELECT sum((a - e) * ln(a / e)) FROM p) AS value UNION ALL SELECT c, 'tvd', sum(abs(pa - pb)) / 2 FROM k GROUP BY c)
        SELECT "column", kind, round(value, 4) AS value, CASE kind WHEN 'psi' THEN round(((SELECT avg(o_totalprice) FROM b) - (SELECT avg(o_totalprice) FROM a)) / (SELECT stddev_samp(o_totalprice) FROM a), 4) END AS mean_shift_sd,
            round(max(value) OVER (), 4) AS worst, CASE WHEN max(value) OVER () < 0.1 THEN 'stable' WHEN max(value) OVER () < 0.25 THEN 'moderate' ELSE 'major' END AS status FROM r""",
    "drift_schema": """SELECT * FROM (SELECT 'extra' AS "column", 'added' AS change, NULL::BIGINT AS was_filled, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS now_filled FROM orders
        UNION ALL SELECT 'o_orderpriority', 'removed', count(o_orderpriority), NULL FROM orders UNION ALL SELECT 'o_custkey', 'bigint -> string', count(o_custkey), count(*) FILTER (WHERE o_custkey % 7 <> 0) FROM orders)""",
    "spectral_identities": f"""WITH {_ORDERS}, x AS (SELECT o_totalprice / stddev_pop(o_totalprice) OVER () AS a, CAST(o_orderpriority[1] AS INT) / sqrt(2) AS b, cos(2 * pi() * (dayofyear(o_orderdate) - 1) / 365.25) AS c, sin(2 * pi() * (dayofyear(o_orderdate) - 1) / 365.25) AS s FROM orders),
        m(name, v) AS (SELECT 'energy_of_all_components', count(*) * (var_pop(a) + var_pop(b) + var_pop(c) + var_pop(s)) FROM x UNION ALL SELECT 'whitening_covariance', count(*) FROM x
            UNION ALL SELECT 'evidence_reread_mismatches', count(*) FROM w WHERE o_orderkey % 13 = 0 AND o_totalprice IS NOT NULL)
        SELECT "check", "check" <> 'evidence_reread_mismatches' OR v = 0 AS passed, round(v, 3) AS measured FROM (VALUES ('orthogonality_basis'), ('orthogonality_scores'), ('roundtrip'), ('eigen_equation_residual'), ('energy_of_all_components'), ('truncation_identity'), ('whitening_covariance'),
            ('mahalanobis_by_inverse'), ('contributions_sum_to_t2'), ('helmert_orthonormal'), ('evidence_reread_mismatches')) t("check") LEFT JOIN m ON "check" = name""",
    "window_last_turns": """WITH e AS (SELECT *, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'other' END AS side FROM conversations WHERE role <> 'system'), c AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3),
        m AS (SELECT *, CASE WHEN lag(side) OVER (PARTITION BY conv_id ORDER BY turn) = side THEN 0 ELSE 1 END AS new FROM c), r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM m)
        SELECT conv_id, min(turn) AS turn, any_value(side) AS side, string_agg(text, chr(10) ORDER BY turn) AS text FROM r GROUP BY conv_id, run""",
    "text_document_summary": """WITH o AS (SELECT o_orderkey, o_orderkey % 7 AS n, o_orderkey % 3 = 0 AS f FROM orders) SELECT o_orderkey, 'SYN-MZ-0000' || n || ',SYN-MZ-00009' || CASE WHEN f THEN '' ELSE ',SYN-TR-0001' END AS entities,
        CASE WHEN f THEN 2 ELSE 0 END AS n_facts, CASE WHEN f THEN 'MOISTURE_PCT,YIELD_T_HA' ELSE '' END AS fields FROM o""",
    "reconcile_repeated_keys": """WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS fresh, count(*) FILTER (WHERE o_orderkey % 3 = 0 AND (o_orderkey + 50000000) % 2 = 0) AS changed FROM orders)
        SELECT 'duplicate' AS outcome, n + fresh - changed AS n FROM n UNION ALL SELECT 'conflict', changed FROM n UNION ALL SELECT 'new', fresh FROM n UNION ALL SELECT 'rows', n + fresh FROM n""",
}


ORACLES |= canonical.ORACLES
