"""Conformance queries over the star-schema graph, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom import api_queries
from nodeloom.graph import Graph
from nodeloom.sources.tables import star_schema

Query = Callable[[SparkSession, str], DataFrame]

#: name: (query, parameters, SQL)
TEXTS: dict[str, tuple[str, dict[str, Any], str]] = {
    "scan_label": ("MATCH (n:Nation) RETURN n.name AS name, n.regionkey AS region", {}, "SELECT n_name AS name, n_regionkey AS region FROM nation"),
    "scan_labels_or": ("MATCH (n:Region|Nation) WITH labels(n) AS kind, n.name AS name RETURN kind, name", {}, "SELECT ['Region'] AS kind, r_name AS name FROM region UNION ALL SELECT ['Nation'], n_name FROM nation"),
    "scan_unlabeled_count": ("MATCH (n) RETURN count(n) AS n", {}, "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM events) + (SELECT count(DISTINCT user_id) FROM events) + (SELECT count(*) FROM documents) + (SELECT count(*) FROM conversations) AS n"),
    "seek_id": ("MATCH (c:Customer) WHERE id(c) = $id RETURN id(c) AS id, c.name AS name, c.acctbal AS bal", {"id": "Customer:7"}, "SELECT 'Customer:7' AS id, c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey = 7"),
    "verify_rematch": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n MATCH (c:Customer)-[:IN_NATION]->(k:Nation) RETURN c.name AS name, n, k.name AS nation", {}, "SELECT c_name AS name, count(*) AS n, n_name AS nation FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY c_custkey, c_name, n_name"),
    "expand_out": ("MATCH (c:Customer)-[r:PLACED]->(o:Order) WHERE o.totalprice > 400000 RETURN c.name AS name, o.totalprice AS price", {}, "SELECT c_name AS name, o_totalprice AS price FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 400000"),
    "expand_in": ("MATCH (o:Order)<-[:PLACED]-(c:Customer) WHERE c.acctbal < 0 RETURN c.mktsegment AS seg, count(o) AS n", {}, "SELECT c_mktsegment AS seg, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < 0 GROUP BY 1"),
    "expand_multi_type": ("MATCH (x)-[r:IN_NATION|BASED_IN]->(n:Nation) WITH n.name AS nation, type(r) AS t RETURN nation, t, count(*) AS n", {}, "SELECT n_name AS nation, t, count(*) AS n FROM (SELECT c_nationkey AS k, 'IN_NATION' AS t FROM customer UNION ALL SELECT s_nationkey, 'BASED_IN' FROM supplier) JOIN nation ON n_nationkey = k GROUP BY 1, 2"),
    "expand_into": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation) MATCH (s:Supplier)-[:BASED_IN]->(n) MATCH (s)-[:SUPPLIED]->(o:Order) MATCH (c)-[:PLACED]->(o) RETURN n.name AS nation, count(*) AS n", {}, "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey AND o_custkey = c_custkey GROUP BY 1"),
    "var_len_1_3": ("MATCH (a:Turn)-[:NEXT*1..3]->(b:Turn) RETURN a.conv AS conv, a.turn AS a, b.turn AS b", {}, "SELECT x.conv_id AS conv, x.turn AS a, y.turn AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn - x.turn BETWEEN 1 AND 3"),
    "var_len_exact": ("MATCH (a:Turn)-[:NEXT*2]->(b:Turn) RETURN a.conv AS conv, a.turn AS a, b.turn AS b", {}, "SELECT x.conv_id AS conv, x.turn AS a, y.turn AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn - x.turn = 2"),
    "var_len_unbounded": ("MATCH (a:Turn)-[:NEXT*]->(b:Turn) WHERE a.turn = 0 RETURN a.conv AS conv, max(b.turn) AS last", {}, "WITH RECURSIVE w AS (SELECT conv_id, turn FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn FROM w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.turn + 1) SELECT conv_id AS conv, max(turn) AS last FROM w WHERE turn > 0 GROUP BY 1"),
    "var_len_last_edge": ("MATCH (c:Customer)-[r*1..2]->(p:Part) RETURN count(r) AS n, sum(r.quantity) AS q", {}, "SELECT count(*) AS n, sum(l_quantity) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey"),
    "cross_product_theta": ("MATCH (a:Nation), (b:Region) WHERE a.regionkey > id(b) OR a.name < b.name RETURN count(*) AS n", {}, "SELECT count(*) AS n FROM nation, region WHERE n_name < r_name"),
    "cross_product_equi": ("MATCH (c:Customer), (s:Supplier) WHERE c.nationkey = s.nationkey AND c.acctbal < s.acctbal RETURN s.name AS name, count(*) AS n", {}, "SELECT s_name AS name, count(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal GROUP BY 1"),
    "optional_match": ("MATCH (o:Order) OPTIONAL MATCH (o)-[l:CONTAINS]->(p:Part) RETURN o.orderpriority AS pri, count(DISTINCT o) AS orders, count(l) AS items", {}, "SELECT o_orderpriority AS pri, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"),
    "optional_match_where": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > c.acctbal * 40 RETURN c.name AS name, count(o) AS n, max(o.totalprice) AS top", {}, "SELECT c_name AS name, count(o_orderkey) AS n, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 40 GROUP BY c_custkey, c_name"),
    "exists_semi": ("MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 400000 } RETURN c.name AS name", {}, "SELECT c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"),
    "not_exists_anti": ("MATCH (o:Order) WHERE NOT EXISTS { MATCH (o)-[:CONTAINS]->(:Part) } RETURN id(o) AS id", {}, "SELECT 'Order:' || o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    "exists_in_return": ("MATCH (o:Order) WITH o.orderstatus AS st, EXISTS { (o)-[l:CONTAINS]->() WHERE l.quantity > 49 } AS big RETURN st, big, count(*) AS n", {}, "SELECT o_orderstatus AS st, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49) AS big, count(*) AS n FROM orders GROUP BY 1, 2"),
    "exists_or": ("MATCH (c:Customer) WHERE c.acctbal > 9000 OR EXISTS { (c)-[:PLACED]->(o) WHERE o.totalprice > 450000 } RETURN count(c) AS n", {}, "SELECT count(*) AS n FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)"),
    "exists_nested": ("MATCH (n:Nation) WHERE EXISTS { (n)<-[:IN_NATION]-(c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 460000 } } RETURN n.name AS name", {}, "SELECT n_name AS name FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 460000))"),
    "pattern_predicate": ("MATCH (o:Order) WHERE NOT (o)-[:CONTAINS]->() AND o.totalprice > 1000 RETURN count(o) AS n", {}, "SELECT count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AND o_totalprice > 1000"),
    "pattern_size": ("MATCH (c:Customer) WHERE size((c)-[:PLACED]->()) > 12 RETURN c.name AS name, size((c)-[:PLACED]->()) AS n", {}, "SELECT c_name AS name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 12"),
    "pattern_comprehension": ("MATCH (n:Nation) WITH n.name AS name, [(n)<-[:BASED_IN]-(s:Supplier) WHERE s.acctbal > 0 | s.acctbal] AS l RETURN name, size(l) AS n", {}, "SELECT n_name AS name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0 GROUP BY n_nationkey, n_name"),
    "named_path_nodes": ("MATCH p = (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) WHERE c.acctbal > 9500 RETURN [x IN nodes(p) | id(x)] AS ids, [e IN relationships(p) | type(e)] AS types", {}, "SELECT ['Customer:' || c_custkey, 'Nation:' || n_nationkey, 'Region:' || r_regionkey] AS ids, ['IN_NATION', 'IN_REGION'] AS types FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_acctbal > 9500"),
    "named_path_var_len": ("MATCH p = (a:Turn)-[:NEXT*2..3]->(b:Turn) WHERE a.turn = 0 RETURN a.conv AS conv, size(nodes(p)) AS nodes, size(relationships(p)) AS rels", {}, "SELECT x.conv_id AS conv, y.turn + 1 AS nodes, y.turn AS rels FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id WHERE x.turn = 0 AND y.turn IN (2, 3)"),
    "inline_props": ("MATCH (c:Customer {mktsegment: 'BUILDING'})-[:PLACED]->(o:Order {orderstatus: $st}) RETURN count(*) AS n", {"st": "F"}, "SELECT count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'"),
    "inline_edge_props": ("MATCH (o:Order)-[l:CONTAINS {returnflag: 'R'}]->(p:Part) RETURN count(l) AS n", {}, "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'"),
    "and_or_xor_not_null": ("MATCH (d:Document) WHERE NOT (d.quality = 1 AND d.toxic = 0) XOR d.n_chars > 2000 OR d.toxic RETURN count(d) AS n", {}, "SELECT count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE ((NOT coalesce(quality = 1 AND toxic = 0, false)) <> (n_chars > 2000)) OR coalesce(toxic <> 0, false)"),
    "eq_null_safe": ("MATCH (d:Document) WHERE d.quality = null OR d.quality = 1 RETURN count(d) AS n", {}, "SELECT count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality = 1"),
    "neq_null": ("MATCH (d:Document) WHERE d.quality <> 1 RETURN count(d) AS n", {}, "SELECT count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM 1"),
    "cmp_null": ("MATCH (d:Document) WHERE d.quality < 1 OR d.lang < 3 RETURN count(d) AS n", {}, "SELECT count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE quality < 1"),
    "str_predicates": ("MATCH (p:Part) WHERE p.name STARTS WITH 'Part' AND p.name ENDS WITH '7' AND p.type CONTAINS 'A' OR p.brand ENDS WITH '3' RETURN p.name AS name", {}, "SELECT p_name AS name FROM part WHERE starts_with(p_name, 'Part') AND p_name LIKE '%7' AND contains(p_type, 'A') OR p_brand LIKE '%3'"),
    "regex": ("MATCH (c:Customer) WHERE c.name =~ 'Customer#0+[12]5|.*99' RETURN c.name AS name", {}, "SELECT c_name AS name FROM customer WHERE regexp_full_match(c_name, 'Customer#0+[12]5|.*99')"),
    "is_null": ("MATCH (d:Document) WHERE d.toxic IS NULL RETURN d.lang AS lang, count(*) AS n", {}, "SELECT lang, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL GROUP BY 1"),
    "is_not_null": ("MATCH (d:Document) WHERE d.toxic IS NOT NULL RETURN d.lang AS lang, count(*) AS n", {}, "SELECT lang, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1"),
    "in_list": ("MATCH (c:Customer) WHERE c.mktsegment IN ['BUILDING', 'MACHINERY'] AND c.nationkey IN $keys RETURN count(c) AS n", {"keys": [1, 2, 3]}, "SELECT count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3)"),
    "not_in_null": ("MATCH (d:Document) WHERE d.quality NOT IN [1, null] RETURN count(d) AS n", {}, "SELECT count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality <> 1"),
    "list_predicates": ("UNWIND [[1, 2, 3], [2, 4], []] AS l RETURN l, ALL(x IN l WHERE x > 1) AS a, ANY(x IN l WHERE x > 3) AS b, NONE(x IN l WHERE x = 2) AS c, SINGLE(x IN l WHERE x > 2) AS d", {}, "SELECT * FROM (VALUES ([1, 2, 3], false, false, false, true), ([2, 4], true, true, false, true), ([]::INT[], true, false, true, false)) t(l, a, b, c, d)"),
    "project_alias": ("MATCH (n:Region) RETURN n.name, 1, 'x' AS y, id(n)", {}, "SELECT r_name AS n_name, 1 AS \"1\", 'x' AS y, 'Region:' || r_regionkey AS id FROM region"),
    "with_star": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH *, n.name + '/' + r.name AS both RETURN n.name AS n, r.name AS r, both", {}, "SELECT n_name AS n, r_name AS r, n_name || '/' || r_name AS \"both\" FROM nation JOIN region ON r_regionkey = n_regionkey"),
    "distinct": ("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN DISTINCT c.mktsegment AS seg, o.orderpriority AS pri", {}, "SELECT DISTINCT c_mktsegment AS seg, o_orderpriority AS pri FROM customer JOIN orders ON o_custkey = c_custkey"),
    "distinct_node": ("MATCH (n:Nation)<-[:IN_NATION]-(c:Customer) WITH DISTINCT n RETURN n.name AS name", {}, "SELECT DISTINCT n_name AS name FROM nation JOIN customer ON c_nationkey = n_nationkey"),
    "sort_nulls": ("MATCH (d:Document) WITH d.quality AS q, d.n_chars AS n, id(d) AS id ORDER BY q, n DESC, id LIMIT 20 RETURN q, n", {}, "SELECT quality AS q, n_chars AS n FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality NULLS FIRST, n_chars DESC, 'Document:' || doc_id LIMIT 20"),
    "order_by_alias": ("MATCH (c:Customer) RETURN c.name AS name, c.acctbal * 2 AS twice ORDER BY twice DESC, c.name LIMIT 5", {}, "SELECT c_name AS name, c_acctbal * 2 AS twice FROM customer ORDER BY 2 DESC, 1 LIMIT 5"),
    "skip_limit": ("MATCH (c:Customer) RETURN c.name AS name ORDER BY c.acctbal, c.name SKIP $s LIMIT 3 + 4", {"s": 10}, "SELECT c_name AS name FROM customer ORDER BY c_acctbal, c_name LIMIT 7 OFFSET 10"),
    "topk": ("MATCH (o:Order)<-[:PLACED]-(c:Customer) RETURN c.name AS name, o.totalprice AS price ORDER BY price DESC, name LIMIT 10", {}, "SELECT c_name AS name, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY 2 DESC, 1 LIMIT 10"),
    "unwind": ("UNWIND [1, 2, 2, null] AS x UNWIND ['a', 'b'] AS y RETURN x, y, count(*) AS n", {}, "SELECT x, y, count(*) AS n FROM (VALUES (1), (2), (2), (NULL)) a(x), (VALUES ('a'), ('b')) b(y) GROUP BY 1, 2"),
    "unwind_scalar_null": ("UNWIND [[1], null, [2, 3], []] AS l UNWIND l AS x UNWIND x AS z RETURN z", {}, "SELECT * FROM (VALUES (1), (2), (3)) t(z)"),
    "unwind_collected": ("MATCH (c:Customer) WITH c.nationkey AS k, collect(c.acctbal) AS l UNWIND l AS b RETURN k, sum(b) AS total", {}, "SELECT c_nationkey AS k, sum(c_acctbal) AS total FROM customer GROUP BY 1"),
    "union_all": ("MATCH (c:Customer) RETURN c.nationkey AS k UNION ALL MATCH (s:Supplier) RETURN s.nationkey AS k", {}, "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "union": ("MATCH (c:Customer) RETURN c.nationkey AS k UNION MATCH (s:Supplier) RETURN s.nationkey AS k UNION ALL MATCH (n:Region) RETURN 1 AS k", {}, "SELECT * FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 1 FROM region"),
    "union_order_limit": ("MATCH (n:Region) RETURN n.name AS name UNION MATCH (n:Nation) RETURN n.name AS name ORDER BY name DESC SKIP 2 LIMIT 5", {}, "SELECT name FROM (SELECT r_name AS name FROM region UNION SELECT n_name FROM nation) ORDER BY 1 DESC LIMIT 5 OFFSET 2"),
    "with_where_having": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n, sum(o.totalprice) AS total WHERE n > 12 AND total > 1000 RETURN c.name AS name, n", {}, "SELECT c_name AS name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 12 AND sum(o_totalprice) > 1000"),
    "with_order_limit": ("MATCH (c:Customer) WITH c ORDER BY c.acctbal DESC, c.name LIMIT 5 MATCH (c)-[:PLACED]->(o:Order) RETURN c.name AS name, count(o) AS n", {}, "SELECT c_name AS name, count(*) AS n FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 5) JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name"),
    "params": ("MATCH (o:Order) WHERE o.totalprice > $min AND o.orderstatus = $st WITH count(o) AS n RETURN n, $st AS st", {"min": 200000.5, "st": "O"}, "SELECT count(*) AS n, 'O' AS st FROM orders WHERE o_totalprice > 200000.5 AND o_orderstatus = 'O'"),
    "count_star": ("MATCH (o:Order)-[:CONTAINS]->(p:Part) RETURN count(*) AS n", {}, "SELECT count(*) AS n FROM lineitem"),
    "count_distinct": ("MATCH (o:Order)-[l:CONTAINS]->(p:Part) RETURN count(DISTINCT p) AS parts, count(DISTINCT l.returnflag) AS flags", {}, "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_returnflag) AS flags FROM lineitem"),
    "sum_avg_empty": ("MATCH (c:Customer) WHERE c.acctbal > 1000000 RETURN count(c) AS c, sum(c.acctbal) AS s, avg(c.acctbal) AS a, min(c.acctbal) AS lo, max(c.name) AS hi, size(collect(c.name)) AS l", {}, "SELECT 0 AS c, 0.0::DOUBLE AS s, 0.0::DOUBLE AS a, NULL::DOUBLE AS lo, NULL::VARCHAR AS hi, 0 AS l"),
    "min_max_string": ("MATCH (c:Customer) RETURN c.mktsegment AS seg, min(c.name) AS lo, max(c.name) AS hi, min(c.acctbal) AS a, max(c.acctbal) AS b", {}, "SELECT c_mktsegment AS seg, min(c_name) AS lo, max(c_name) AS hi, min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer GROUP BY 1"),
    "collect": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r.name AS region, n.name AS nation ORDER BY nation WITH region, collect(nation) AS l RETURN region, size(l) AS n, ANY(x IN l WHERE x ENDS WITH '7') AS has", {}, "SELECT r_name AS region, count(*) AS n, bool_or(n_name LIKE '%7') AS has FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1"),
    "collect_distinct": ("MATCH (c:Customer) WITH c.nationkey AS k, collect(DISTINCT c.mktsegment) AS l RETURN k, size(l) AS n", {}, "SELECT c_nationkey AS k, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY 1"),
    "collect_nodes": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, collect(n) AS l UNWIND l AS x RETURN r.name AS region, x.name AS nation, id(x) AS id", {}, "SELECT r_name AS region, n_name AS nation, 'Nation:' || n_nationkey AS id FROM nation JOIN region ON r_regionkey = n_regionkey"),
    "group_multi": ("MATCH (o:Order)-[l:CONTAINS]->(p:Part) RETURN l.returnflag AS f, l.linestatus AS s, sum(l.quantity) AS q, avg(l.discount) AS d, count(*) AS n", {}, "SELECT l_returnflag AS f, l_linestatus AS s, sum(l_quantity) AS q, avg(l_discount) AS d, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "group_null_key": ("MATCH (d:Document) RETURN d.quality AS q, d.toxic AS t, count(*) AS n, avg(d.n_chars) AS chars", {}, "SELECT quality AS q, toxic AS t, count(*) AS n, avg(n_chars) AS chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2"),
    "agg_expr": ("MATCH (o:Order)-[l:CONTAINS]->(p:Part) RETURN p.brand AS brand, sum(l.extendedprice) / count(*) + 1 AS x, count(*) * 2 AS y", {}, "SELECT p_brand AS brand, sum(l_extendedprice) / count(*) + 1 AS x, count(*) * 2 AS y FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1"),
    "order_by_agg": ("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.name AS name ORDER BY sum(o.totalprice) DESC, name LIMIT 5", {}, "SELECT c_name AS name FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_name ORDER BY sum(o_totalprice) DESC, 1 LIMIT 5"),
    "sum_distinct": ("MATCH (p:Part) RETURN p.brand AS brand, sum(DISTINCT p.size) AS s, avg(DISTINCT p.size) AS a", {}, "SELECT p_brand AS brand, sum(DISTINCT p_size)::BIGINT AS s, avg(DISTINCT p_size) AS a FROM part GROUP BY 1"),
    "arithmetic": ("UNWIND [1, 2, 7] AS x RETURN x + 1 AS a, x - 2 AS b, x * 3 AS c, x / 2 AS d, -x AS e, (0 - x) % 3 AS f, x ^ 2 AS g, -2 ^ 2 AS h, 1.5 + x AS i", {}, "SELECT x + 1 AS a, x - 2 AS b, x * 3 AS c, x::DOUBLE / 2 AS d, -x AS e, (0 - x) % 3 AS f, x::DOUBLE ^ 2 AS g, 4.0::DOUBLE AS h, 1.5::DOUBLE + x AS i FROM (VALUES (1), (2), (7)) t(x)"),
    "string_plus": ("MATCH (n:Nation) RETURN n.name + ':' + n.regionkey AS s, 'v' + 2.0 AS v, 'b' + true AS b", {}, "SELECT n_name || ':' || n_regionkey AS s, 'v2' AS v, 'btrue' AS b FROM nation"),
    "list_plus": ("UNWIND [1, 2] AS x RETURN [0] + x AS a, x + [9] AS b, [x] + [x, 3] AS c", {}, "SELECT [0, x] AS a, [x, 9] AS b, [x, x, 3] AS c FROM (VALUES (1), (2)) t(x)"),
    "case_simple": ("MATCH (d:Document) WITH CASE d.quality WHEN 1 THEN 'good' WHEN null THEN 'none' ELSE 'bad' END AS k RETURN k, count(*) AS n", {}, "SELECT CASE WHEN quality = 1 THEN 'good' WHEN quality IS NULL THEN 'none' ELSE 'bad' END AS k, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"),
    "case_searched": ("MATCH (c:Customer) WITH CASE WHEN c.acctbal > 5000 THEN 2 WHEN c.acctbal > 0 THEN 1 END AS k RETURN k, count(*) AS n", {}, "SELECT CASE WHEN c_acctbal > 5000 THEN 2 WHEN c_acctbal > 0 THEN 1 END AS k, count(*) AS n FROM customer GROUP BY 1"),
    "list_comp": ("UNWIND [[1, 2, 3, 4], []] AS l RETURN [x IN l WHERE x % 2 = 0 | x * 10] AS a, [x IN l | x + 1] AS b, [x IN l WHERE x > 3] AS c", {}, "SELECT * FROM (VALUES ([20, 40], [2, 3, 4, 5], [4]), ([]::INT[], []::INT[], []::INT[])) t(a, b, c)"),
    "map_literal": ("MATCH (n:Region) WITH {name: n.name, n: 1} AS m RETURN m.name AS name, m.n AS n, m.other AS o", {}, "SELECT r_name AS name, 1 AS n, NULL::VARCHAR AS o FROM region"),
    "labels_type_id": ("MATCH (n:Nation)-[r]->(x:Region) RETURN labels(n) AS l, type(r) AS t, id(x) AS id, n.id AS nid", {}, "SELECT ['Nation'] AS l, 'IN_REGION' AS t, 'Region:' || n_regionkey AS id, 'Nation:' || n_nationkey AS nid FROM nation"),
    "size": ("UNWIND [[1], [1, 2], []] AS l RETURN size(l) AS n, size(null) AS z", {}, "SELECT n, NULL::BIGINT AS z FROM (VALUES (1), (2), (0)) t(n)"),
    "entity_equality": ("MATCH (a:Nation)-[:IN_REGION]->(r:Region), (b:Nation)-[:IN_REGION]->(q:Region) WHERE r = q AND a <> b RETURN count(*) AS n", {}, "SELECT count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey"),
    "flagship": ("MATCH (c:Customer)-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part) WHERE l.quantity > 5 AND c.acctbal > 0 AND l.extendedprice < o.totalprice RETURN c.mktsegment AS segment, count(l) AS n, sum(l.extendedprice) AS revenue, avg(p.retailprice) AS avg_price ORDER BY revenue DESC", {}, "SELECT c_mktsegment AS segment, count(*) AS n, sum(l_extendedprice) AS revenue, avg(p_retailprice) AS avg_price FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_quantity > 5 AND c_acctbal > 0 AND l_extendedprice < o_totalprice GROUP BY 1"),
    "aggregate_by_type": ("MATCH (p:Part) WHERE p.size > 10 AND p.retailprice > 900 RETURN p.type AS type, count(p) AS n, sum(p.retailprice) AS s, avg(p.retailprice) AS a, min(p.size) AS lo, max(p.size) AS hi", {}, "SELECT p_type AS type, count(*) AS n, sum(p_retailprice) AS s, avg(p_retailprice) AS a, min(p_size) AS lo, max(p_size) AS hi FROM part WHERE p_size > 10 AND p_retailprice > 900 GROUP BY 1"),
}


def _text(text: str, params: dict[str, Any]) -> Query:
    return lambda spark, sf_dir: Graph(spark, star_schema(spark, sf_dir)).query(text, params).df


def _nations(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions and nations as a graph of its own that can be written to."""
    from nodeloom.operators.mutations import Snapshot

    r, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation"))
    nodes = r.select(F.concat(F.lit("r"), "r_regionkey").alias("_id"), F.array(F.lit("Region")).alias("_labels"), F.lit(0).cast("long").alias("createdOn"), F.lit(0).cast("long").alias("updatedOn"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("key"))
    nodes = nodes.unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("_id"), F.array(F.lit("Nation"), F.lit("Place")).alias("_labels"), F.lit(0).cast("long").alias("createdOn"), F.lit(0).cast("long").alias("updatedOn"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("key")))
    edges = n.select(F.concat(F.lit("e"), "n_nationkey").alias("_id"), F.concat(F.lit("n"), "n_nationkey").alias("_src"), F.concat(F.lit("r"), "n_regionkey").alias("_dst"), F.lit("IN").alias("_type"), F.lit(0).cast("long").alias("createdOn"), F.lit(0).cast("long").alias("updatedOn"))
    g = Graph(spark)
    g._snapshot = Snapshot(nodes, edges)
    return g


#: name: (statements, SQL for the last one's rows)
WRITES: dict[str, tuple[list[str], str]] = {
    "create_then_match": (["MATCH (n:Nation) WHERE n.key < 5 CREATE (c:City {size: 10})-[:PART_OF {w: 1}]->(n)", "MATCH (c:City)-[e:PART_OF]->(n) RETURN n.name AS name, c.size AS size, e.w AS w"], "SELECT n_name AS name, 10 AS size, 1 AS w FROM nation WHERE n_nationkey < 5"),
    "merge_create": (["MATCH (n:Nation) MERGE (t:Tag {name: 'all'}) RETURN count(n) AS n", "MATCH (t:Tag) RETURN count(t) AS n, min(t.name) AS name"], "SELECT 1 AS n, 'all' AS name"),
    "merge_edge": (["MATCH (r:Region), (n:Nation) WHERE r.key = n.key MERGE (n)-[e:IN]->(r) ON CREATE SET e.made = true ON MATCH SET e.made = false", "MATCH (n:Nation)-[e:IN]->(r:Region) RETURN count(*) AS n, count(e.made) AS touched"], "SELECT 25 + (SELECT count(*) FROM nation WHERE n_nationkey < 5 AND n_regionkey <> n_nationkey) AS n, 5 AS touched"),
    "merge_match": (["MERGE (r:Region {name: 'ASIA'}) ON MATCH SET r.seen = 1 ON CREATE SET r.seen = 2", "MATCH (r:Region) RETURN r.name AS name, r.seen AS seen"], "SELECT r_name AS name, CASE WHEN r_name = 'ASIA' THEN 1 END AS seen FROM region"),
    "set_prop": (["MATCH (n:Nation) WHERE n.key >= 20 SET n.key = n.key * 2, n.flag = 'x'", "MATCH (n:Nation) RETURN n.name AS name, n.key AS key, n.flag AS flag"], "SELECT n_name AS name, CASE WHEN n_nationkey >= 20 THEN n_nationkey * 2 ELSE n_nationkey END AS key, CASE WHEN n_nationkey >= 20 THEN 'x' END AS flag FROM nation"),
    "set_map_replace": (["MATCH (n:Nation) WHERE n.key = 3 SET n = {code: 7}", "MATCH (n:Nation) RETURN n.name AS name, n.code AS code"], "SELECT CASE WHEN n_nationkey <> 3 THEN n_name END AS name, CASE WHEN n_nationkey = 3 THEN 7 END AS code FROM nation"),
    "set_map_merge": (["MATCH (n:Nation) WHERE n.key = 3 SET n += {code: 7}", "MATCH (n:Nation) RETURN n.name AS name, n.code AS code"], "SELECT n_name AS name, CASE WHEN n_nationkey = 3 THEN 7 END AS code FROM nation"),
    "remove_prop": (["MATCH (n:Region) REMOVE n.key", "MATCH (n) RETURN count(n.key) AS keys, count(n.name) AS names"], "SELECT 25 AS keys, 30 AS names"),
    "remove_label": (["MATCH (n:Nation) WHERE n.key < 10 REMOVE n:Place", "MATCH (n:Place) RETURN count(n) AS n"], "SELECT 15 AS n"),
    "delete_edge": (["MATCH (n:Nation)-[e:IN]->(r:Region {name: 'ASIA'}) DELETE e", "MATCH (n)-[e:IN]->(r) RETURN r.name AS name, count(e) AS n"], "SELECT r_name AS name, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'ASIA' GROUP BY 1"),
    "detach_delete": (["MATCH (r:Region {name: 'ASIA'}) DETACH DELETE r", "MATCH (n) OPTIONAL MATCH (n)-[e:IN]->() RETURN count(DISTINCT n) AS nodes, count(e) AS edges"], "SELECT 29 AS nodes, (SELECT count(*) FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'ASIA') AS edges"),
    "show_indexes": (["CREATE INDEX by_name FOR (n:Nation) ON (n.name)", "CREATE INDEX by_type FOR ()-[e:IN]-() ON (e.w, e.v)", "SHOW INDEXES"], "SELECT * FROM (VALUES ('by_name', 'node', ['name']), ('by_type', 'edge', ['w', 'v'])) t(name, target, propertyKeys)"),
}


def _write(statements: list[str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = _nations(spark, sf_dir)
        for text in statements[:-1]:
            g.query(text)
        return g.query(statements[-1]).df

    return run


def api_get_nodes_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, star_schema(spark, sf_dir))
    options = {"filter": {"types": ["Customer"], "properties": {"or": [{"key": "acctbal", "op": ">", "value": 9000}, {"and": [{"key": "mktsegment", "op": "IN", "value": ["BUILDING"]}, {"key": "acctbal", "op": "<=", "value": 0}]}]}}, "order_by": [("acctbal", "desc"), ("name", "asc")], "limit": 25}
    return g.get_nodes(options).select("_id", "name", "acctbal")


def api_edges_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _nations(spark, sf_dir)
    g.query("MATCH (r:Region), (n:Nation) WHERE r.key = 0 AND n.key = 0 CREATE (r)-[:BACK]->(n)")
    return g.get_direct_edges_between("n0", "r0").groupBy(F.col("_type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


def api_aggregate_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Graph(spark, star_schema(spark, sf_dir)).aggregate_node_property("acctbal", {"types": ["Customer"]})
    return spark.createDataFrame([(r["count"], float(r["sum"]), float(r["avg"]), float(r["min"]), float(r["max"]))], "n long, total double, mean double, lo double, hi double")


def bfs_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of a shortest path from the first turn of each conversation to its turn 3, over the whole table."""
    g = star_schema(spark, sf_dir)
    return _to_turn_3(g.nodes[-1].df, g.edges[-1].df)


def _to_turn_3(turns: DataFrame, edges: DataFrame) -> DataFrame:
    from nodeloom.operators.algorithms import shortest_paths

    paths = shortest_paths(edges, turns.where("turn = 0").select("_id"), turns.where("turn = 3").select("_id"))
    return paths.select("src", "dst", F.size("path").alias("nodes"))


def is_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nodeloom.operators.algorithms import peel

    g = star_schema(spark, sf_dir)
    return spark.createDataFrame([(peel(g.nodes[-1].df, g.edges[-1].df)[1],)], "dag boolean")


def topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nodeloom.operators.algorithms import peel

    g = star_schema(spark, sf_dir)
    return peel(g.nodes[-1].df, g.edges[-1].df)[0].select(F.col("_id").alias("id"), "level")


FUNCTIONS: dict[str, tuple[Query, str | None]] = {
    "api_get_nodes_filter": (api_get_nodes_filter, "SELECT 'Customer:' || c_custkey AS _id, c_name AS name, c_acctbal AS acctbal FROM customer WHERE c_acctbal > 9000 OR c_mktsegment = 'BUILDING' AND c_acctbal <= 0 ORDER BY c_acctbal DESC, c_name LIMIT 25"),
    "api_edges_between": (api_edges_between, "SELECT 'BACK' AS type, 1 AS n UNION ALL SELECT 'IN', 1 FROM nation WHERE n_nationkey = 0 AND n_regionkey = 0"),
    "api_aggregate_property": (api_aggregate_property, "SELECT count(*) AS n, sum(c_acctbal) AS total, avg(c_acctbal) AS mean, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer"),
    "bfs_shortest": (bfs_shortest, "SELECT conv_id * 1000000 AS src, conv_id * 1000000 + 3 AS dst, 4 AS nodes FROM conversations WHERE turn BETWEEN 0 AND 3 GROUP BY conv_id HAVING count(DISTINCT turn) = 4"),
    "is_dag": (is_dag, "SELECT true AS dag"),
    "topo_levels": (topo_levels, "SELECT conv_id * 1000000 + turn AS id, turn AS level FROM conversations"),
}

FUNCTIONS |= api_queries.FUNCTIONS

QUERIES: dict[str, Query] = {n: _text(q, p) for n, (q, p, _) in TEXTS.items()} | {n: _write(w) for n, (w, _) in WRITES.items()} | {n: f for n, (f, _) in FUNCTIONS.items()}
SQL: dict[str, str] = {n: x for n, (_, _, x) in TEXTS.items()} | {n: x for n, (_, x) in WRITES.items()} | {n: x for n, (_, x) in FUNCTIONS.items() if x}
