"""The registered queries over the sales graph, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.engine import Engine

CYPHER: dict[str, str] = {}
SQL: dict[str, str] = {}


def _add(name: str, text: str, sql: str | None = None) -> None:
    CYPHER[name] = text
    if sql is not None:
        SQL[name] = sql


# Operators of the query plan
_add("top_segments", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 100000 RETURN c.c_mktsegment AS segment, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total ORDER BY total DESC LIMIT 3",
     "SELECT c_mktsegment AS segment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000 GROUP BY 1 ORDER BY total DESC LIMIT 3")
_add("empty", "MATCH (r:Region) WHERE false RETURN r.r_name AS name", "SELECT r_name AS name FROM region WHERE false")
_add("unit", "RETURN 1 AS one, 'a' AS a", "SELECT CAST(1 AS BIGINT) AS one, 'a' AS a")
_add("anchored_entry", "MATCH (c:Customer) WHERE c.c_custkey IN [1, 7, 99999999] RETURN c.c_custkey AS k, c.c_name AS name", "SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey IN (1, 7, 99999999)")
_add("argument_entry", "UNWIND [1, 7, null, 99999999] AS k MATCH (c) WHERE id(c) = 'Customer:' + toString(k) RETURN k, id(c) AS id, c.c_name AS name",
     "SELECT CAST(k AS BIGINT) AS k, 'Customer:' || k AS id, c_name AS name FROM (VALUES (1), (7), (99999999)) t(k) LEFT JOIN customer ON c_custkey = k")
_add("get_degree", "MATCH (c:Customer) RETURN c.c_custkey AS k, size((c)-[:PLACED]->()) AS degree", "SELECT c_custkey AS k, count(o_orderkey) AS degree FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
_add("expand", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(s:Supplier) RETURN r.r_name AS region, n.n_name AS nation, s.s_suppkey AS supplier", "SELECT r_name AS region, n_name AS nation, s_suppkey AS supplier FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
_add("expand_types", "MATCH (x)-[e:IN_REGION|IN_NATION]->(y) RETURN type(e) AS kind, labels(x) AS of, count(*) AS n",
     "SELECT 'IN_REGION' AS kind, ['Nation'] AS of, count(*) AS n FROM nation UNION ALL SELECT 'IN_NATION', ['Customer'], count(*) FROM customer UNION ALL SELECT 'IN_NATION', ['Supplier'], count(*) FROM supplier")
_add("expand_both", "MATCH (n:Nation)-[:IN_REGION]-(r) RETURN n.n_name AS nation, r.r_name AS region", "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey")
_add("expand_variable", "MATCH p = (c:Customer)-[:IN_NATION|IN_REGION*1..2]->(x) RETURN length(p) AS hops, id(x) AS goal, count(*) AS n",
     "SELECT CAST(1 AS BIGINT) AS hops, 'Nation:' || c_nationkey AS goal, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 2, 'Region:' || n_regionkey, count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 2")
_add("expand_zero", "MATCH (n:Nation)-[:IN_REGION*0..1]->(x) RETURN id(x) AS goal, count(*) AS n", "SELECT 'Nation:' || n_nationkey AS goal, count(*) AS n FROM nation GROUP BY 1 UNION ALL SELECT 'Region:' || n_regionkey, count(*) FROM nation GROUP BY 1")
_add("relationship_uniqueness", "MATCH (a:Nation)-[:IN_REGION]->(r:Region)<-[:IN_REGION]-(b:Nation) RETURN r.r_name AS region, count(*) AS pairs", "SELECT r_name AS region, count(*) AS pairs FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey JOIN region ON r_regionkey = a.n_regionkey GROUP BY 1")
_add("cycle", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(s:Supplier)<-[:FROM_SUPPLIER]-(i:Item)<-[:CONTAINS]-(o:Order)<-[:PLACED]-(c) RETURN n.n_name AS nation, count(*) AS n",
     "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey AND o_custkey = c_custkey GROUP BY 1")
_add("local_node", "MATCH (c:Customer {c_mktsegment: 'BUILDING', c_nationkey: 3}) RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
_add("label_alternatives", "MATCH (x:Customer|Supplier)-[:IN_NATION]->(n:Nation) RETURN n.n_name AS nation, count(x) AS n", "SELECT n_name AS nation, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON n_nationkey = k GROUP BY 1")
_add("union_all", "MATCH (n:Nation) RETURN n.n_regionkey AS k UNION ALL MATCH (r:Region) RETURN r.r_regionkey AS k", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
_add("union", "MATCH (n:Nation) RETURN n.n_regionkey AS k UNION MATCH (r:Region) RETURN r.r_regionkey AS k", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
_add("semi_apply", "MATCH (c:Customer) WHERE (c)-[:PLACED]->(:Order {o_orderstatus: 'F'}) RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
_add("anti_apply", "MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->(:Order {o_orderstatus: 'F'}) RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
_add("apply", "MATCH (r:Region) UNWIND range(1, r.r_regionkey) AS i RETURN r.r_name AS name, i", "SELECT r_name AS name, CAST(i AS BIGINT) AS i FROM region, unnest(range(1, r_regionkey + 1)) t(i)")
_add("optional", "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:IN_NATION]-(s:Supplier) WHERE s.s_acctbal > 5000 RETURN n.n_name AS nation, s.s_suppkey AS supplier", "SELECT n_name AS nation, s_suppkey AS supplier FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000")
_add("filter", "MATCH (o:Order) WHERE o.o_totalprice > 200000 AND NOT o.o_orderstatus = 'F' OR o.o_orderpriority STARTS WITH '1' RETURN o.o_orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 200000 AND NOT o_orderstatus = 'F' OR starts_with(o_orderpriority, '1')")
_add("skip_limit", "MATCH (c:Customer) RETURN c.c_custkey AS k ORDER BY k SKIP 10 LIMIT 5", "SELECT c_custkey AS k FROM customer ORDER BY k LIMIT 5 OFFSET 10")
_add("sort_top", "MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_totalprice AS price ORDER BY price DESC, k LIMIT 20", "SELECT o_orderkey AS k, o_totalprice AS price FROM orders ORDER BY price DESC, k LIMIT 20")
_add("distinct", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN DISTINCT c.c_mktsegment AS s, o.o_orderpriority AS p", "SELECT DISTINCT c_mktsegment AS s, o_orderpriority AS p FROM customer JOIN orders ON o_custkey = c_custkey")
_add("unwind", "UNWIND [[1, 2], [], [3, null]] AS xs UNWIND xs AS x RETURN x, size(xs) AS n", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(2 AS BIGINT)), (2, 2), (3, 2), (NULL, 2)) t(x, n)")
_add("with_where", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n, max(o.o_totalprice) AS top WHERE n > 15 RETURN c.c_custkey AS k, n, top", "SELECT o_custkey AS k, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1 HAVING count(*) > 15")
_add("subquery", "MATCH (n:Nation) CALL { WITH n MATCH (n)<-[:IN_NATION]-(c:Customer) RETURN c.c_custkey AS k, c.c_acctbal AS b ORDER BY b DESC, k LIMIT 2 } RETURN n.n_name AS nation, k",
     "SELECT n_name AS nation, c_custkey AS k FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) JOIN nation ON n_nationkey = c_nationkey WHERE r <= 2")
_add("subquery_aggregate", "MATCH (n:Nation) CALL { WITH n MATCH (n)<-[:IN_NATION]-(s:Supplier) WHERE s.s_acctbal > 9000 RETURN count(s) AS k, sum(s.s_acctbal) AS total, max(s.s_acctbal) AS top } RETURN n.n_name AS nation, k, total, top",
     "SELECT n_name AS nation, count(s_suppkey) AS k, coalesce(sum(s_acctbal), 0) AS total, max(s_acctbal) AS top FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 GROUP BY 1")
_add("recursive_call", "CALL RECURSIVELY WITH 0 AS x UNTIL (y > 5) { RETURN x + 1 AS x, x AS y } RETURN x, y", "SELECT CAST(7 AS BIGINT) AS x, CAST(6 AS BIGINT) AS y")
_add("recursive_fan_out", "CALL RECURSIVELY WITH 1 AS max UNTIL (max > 3) { UNWIND range(1, max) AS x RETURN x, max + 1 AS max } RETURN x", "SELECT CAST(x AS BIGINT) AS x FROM (VALUES (1), (2), (3), (1), (2), (3)) t(x)")
_add("recursive_correlated", "MATCH (r:Region) CALL RECURSIVELY WITH r.r_regionkey AS k UNTIL (k >= 10) { RETURN k + 3 AS k } RETURN r.r_name AS name, k", "SELECT r_name AS name, CAST(r_regionkey + 3 * ceil((10 - r_regionkey) / 3.0) AS BIGINT) AS k FROM region")
_add("pattern_comprehension", "MATCH (r:Region) RETURN r.r_name AS region, size([(r)<-[:IN_REGION]-(n:Nation) WHERE n.n_nationkey > 5 | n.n_name]) AS n", "SELECT r_name AS region, CAST((SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 5) AS BIGINT) AS n FROM region")
_add("shortest_path", "MATCH (c:Customer), (r:Region) WHERE c.c_custkey < 20 WITH c, r, shortestPath((c)-[:IN_NATION|IN_REGION*..5]->(r)) AS p WHERE p IS NOT NULL RETURN c.c_custkey AS k, r.r_name AS region, length(p) AS hops",
     "SELECT c_custkey AS k, r_name AS region, CAST(2 AS BIGINT) AS hops FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_custkey < 20")
_add("multi_way_join", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order)-[:CONTAINS]->(i:Item) WHERE o.o_totalprice > 50000 RETURN r.r_name AS region, count(*) AS items, round(sum(i.l_extendedprice * (1 - i.l_discount)), 2) AS revenue",
     "SELECT r_name AS region, count(*) AS items, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 50000 GROUP BY 1")
_add("part_suppliers", "MATCH (p:Part)<-[:OF_PART]-(i:Item)-[:FROM_SUPPLIER]->(s:Supplier) WHERE p.p_size > 40 RETURN p.p_brand AS brand, count(DISTINCT s) AS suppliers, round(avg(i.l_quantity), 4) AS quantity",
     "SELECT p_brand AS brand, count(DISTINCT l_suppkey) AS suppliers, round(avg(l_quantity), 4) AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 40 GROUP BY 1")
_add("user_events", "MATCH (u:User)-[:DID]->(e:Event) WHERE e.event_type IN ['purchase', 'click'] WITH u, count(*) AS n, sum(e.value) AS total WHERE n >= 3 RETURN u.user_id AS user, n, round(total, 6) AS total", "SELECT user_id AS user, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE event_type IN ('purchase', 'click') GROUP BY 1 HAVING count(*) >= 3")
_add("time_buckets", "MATCH (o:Order) RETURN o.o_orderdate.year AS y, o.o_orderdate.month AS m, count(*) AS n", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, count(*) AS n FROM orders GROUP BY 1, 2")
_add("documents_by_source", "MATCH (d:Document)-[:FROM_SOURCE]->(s:Source) RETURN s.source AS source, count(d) AS n, sum(d.n_chars) AS chars", "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
# Aggregates
_add("aggregates", "MATCH (o:Order) RETURN o.o_orderstatus AS s, count(*) AS n, count(DISTINCT o.o_custkey) AS customers, min(o.o_totalprice) AS low, max(o.o_totalprice) AS high, round(avg(o.o_totalprice), 4) AS mean, round(stDev(o.o_totalprice), 4) AS sd, round(stDevP(o.o_totalprice), 4) AS sdp, round(percentileCont(o.o_totalprice, 0.25), 6) AS q",
     "SELECT o_orderstatus AS s, count(*) AS n, count(DISTINCT o_custkey) AS customers, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, round(stddev_pop(o_totalprice), 4) AS sdp, round(quantile_cont(o_totalprice, 0.25), 6) AS q FROM orders GROUP BY 1")
_add("aggregates_empty", "MATCH (o:Order) WHERE o.o_orderkey < 0 RETURN count(*) AS n, sum(o.o_totalprice) AS s, size(collect(o.o_orderkey)) AS c, stDev(o.o_totalprice) AS sd, max(o.o_totalprice) AS m", "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS s, CAST(0 AS BIGINT) AS c, CAST(0 AS DOUBLE) AS sd, CAST(NULL AS DOUBLE) AS m")
_add("percentile_disc", "MATCH (c:Customer) RETURN c.c_mktsegment AS s, percentileDisc(c.c_acctbal, 0.5) AS q",
     "SELECT s, v AS q FROM (SELECT c_mktsegment AS s, c_acctbal AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) - 1 AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) WHERE i = CAST(floor(0.5 * (n - 1) + 0.5) AS BIGINT)")
_add("collect", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, n ORDER BY n.n_name RETURN r.r_name AS region, size(collect(DISTINCT n.n_name)) AS names, coll.max(collect(n.n_nationkey)) AS last", "SELECT r_name AS region, count(DISTINCT n_name) AS names, max(n_nationkey) AS last FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
# Expressions and functions
_add("arithmetic", "UNWIND [-7, -2, 3, 8] AS x RETURN x, x / 2 AS half, x % 3 AS rest, x * 1.5 AS scaled, x ^ 2 AS square, -x AS negative, x / 0.0 AS limitless",
     "SELECT CAST(x AS BIGINT) AS x, CAST(trunc(x / 2) AS BIGINT) AS half, CAST(x % 3 AS BIGINT) AS rest, x * CAST(1.5 AS DOUBLE) AS scaled, CAST(x * x AS DOUBLE) AS square, CAST(-x AS BIGINT) AS negative, CAST(CASE WHEN x > 0 THEN 'inf' ELSE '-inf' END AS DOUBLE) AS limitless FROM (VALUES (-7), (-2), (3), (8)) t(x)")
_add("comparison", "UNWIND [1, 2, null] AS x RETURN x, x = 1 AS e, x <> 1 AS d, x < 2 AS l, x IS NULL AS n, x IN [1, null] AS i, NOT x = 1 OR x = 2 AS o, x = 1 XOR x = 2 AS xo",
     "SELECT CAST(x AS BIGINT) AS x, x = 1 AS e, x <> 1 AS d, x < 2 AS l, x IS NULL AS n, CASE WHEN x = 1 THEN true END AS i, NOT (x = 1) OR x = 2 AS o, (x = 1) <> (x = 2) AS xo FROM (VALUES (1), (2), (NULL)) t(x)")
_add("equality", "RETURN [1, 2] = [1, 2] AS a, [1, 2] = [1, 3] AS b, [1] = [1, 2] AS c, [1, null] = [1, 2] AS d, 1 = 1.0 AS e, 1 = 'a' AS f, null = null AS g, {a: 1, b: 2} = {b: 2, a: 1} AS h, 0.0 / 0.0 = 0.0 / 0.0 AS i",
     "SELECT true AS a, false AS b, false AS c, CAST(NULL AS BOOLEAN) AS d, true AS e, false AS f, CAST(NULL AS BOOLEAN) AS g, true AS h, false AS i")
_add("string_predicates", "MATCH (p:Part) WHERE p.p_type CONTAINS 'CON' AND p.p_brand ENDS WITH '1' AND p.p_name =~ '.*i.*' RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE contains(p_type, 'CON') AND ends_with(p_brand, '1') AND regexp_full_match(p_name, '.*i.*')")
_add("lists", "WITH [1, 2, 3, 4, 5] AS xs RETURN xs[0] AS a, xs[-1] AS b, xs[9] AS c, size(xs[1..3]) AS d, size(xs[..-1]) AS e, head(tail(xs)) AS f, last(reverse(xs)) AS g, size(xs + 6) AS h, reduce(s = 0, x IN xs | s + x) AS i",
     "SELECT CAST(1 AS BIGINT) AS a, CAST(5 AS BIGINT) AS b, CAST(NULL AS BIGINT) AS c, CAST(2 AS BIGINT) AS d, CAST(4 AS BIGINT) AS e, CAST(2 AS BIGINT) AS f, CAST(1 AS BIGINT) AS g, CAST(6 AS BIGINT) AS h, CAST(15 AS BIGINT) AS i")
_add("list_predicates", "UNWIND range(1, 6) AS n WITH n, range(1, n) AS xs RETURN n, all(x IN xs WHERE x < 4) AS a, any(x IN xs WHERE x = 3) AS b, none(x IN xs WHERE x > 5) AS c, single(x IN xs WHERE x % 3 = 0) AS d, size([x IN xs WHERE x % 2 = 0 | x * x]) AS e",
     "SELECT CAST(n AS BIGINT) AS n, n < 4 AS a, n >= 3 AS b, n <= 5 AS c, n // 3 = 1 AS d, CAST(n // 2 AS BIGINT) AS e FROM range(1, 7) t(n)")
_add("case", "MATCH (o:Order) RETURN CASE o.o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state, CASE WHEN o.o_totalprice > 100000 THEN 1 ELSE 0 END AS big, count(*) AS n",
     "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state, CAST(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS BIGINT) AS big, count(*) AS n FROM orders GROUP BY 1, 2")
_add("map_projection", "MATCH (r:Region) WITH r {.r_name, twice: r.r_regionkey * 2} AS m RETURN m.r_name AS name, m.twice AS twice, keys(m) AS ks", "SELECT r_name AS name, CAST(r_regionkey * 2 AS BIGINT) AS twice, ['r_name', 'twice'] AS ks FROM region")
_add("string_functions", "MATCH (c:Customer) RETURN c.c_custkey AS k, toLower(c.c_name) AS lo, toUpper(c.c_name) AS up, left(c.c_name, 3) AS l, right(c.c_name, 3) AS r, substring(c.c_name, 2, 4) AS s, replace(c.c_name, 'C', '-') AS rp, reverse(c.c_name) AS rv, size(c.c_name) AS n, trim('  ' + c.c_name + ' ') AS t, size(split(c.c_name, '0')) AS parts",
     "SELECT c_custkey AS k, lower(c_name) AS lo, upper(c_name) AS up, left(c_name, 3) AS l, right(c_name, 3) AS r, substring(c_name, 3, 4) AS s, replace(c_name, 'C', '-') AS rp, reverse(c_name) AS rv, length(c_name) AS n, c_name AS t, len(CASE WHEN contains(c_name, '0') THEN split(rtrim(c_name, '0'), '0') ELSE [c_name] END) AS parts FROM customer")
_add("math_functions", "MATCH (s:Supplier) WITH s.s_suppkey AS k, s.s_acctbal AS b RETURN k, abs(b) AS a, ceil(b) AS c, floor(b) AS f, sign(b) AS s, round(sqrt(abs(b)), 6) AS q, round(log(abs(b) + 1), 6) AS l, round(b) AS r, round(sin(b), 6) AS si, round(haversin(b), 6) AS h, round(atan2(b, 2.0), 6) AS at",
     "SELECT s_suppkey AS k, abs(s_acctbal) AS a, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, CAST(sign(s_acctbal) AS BIGINT) AS s, round(sqrt(abs(s_acctbal)), 6) AS q, round(ln(abs(s_acctbal) + 1), 6) AS l, floor(s_acctbal + 0.5) AS r, round(sin(s_acctbal), 6) AS si, round((1 - cos(s_acctbal)) / 2, 6) AS h, round(atan2(s_acctbal, 2.0), 6) AS at FROM supplier")
_add("conversions", "UNWIND ['12', '0x1F', '3.9', 'x'] AS s RETURN s, toInteger(s) AS i, toFloat(s) AS f, toString(size(s)) AS t, coalesce(toInteger(s), -1) AS c",
     "SELECT * FROM (VALUES ('12', CAST(12 AS BIGINT), CAST(12 AS DOUBLE), '2', CAST(12 AS BIGINT)), ('0x1F', 31, NULL, '4', 31), ('3.9', 3, 3.9, '3', 3), ('x', NULL, NULL, '1', -1)) t(s, i, f, t, c)")
_add("json_functions", "MATCH (e:Event) WITH e.event_id AS k, castOrNull.integer(parseJson(e.props).k) AS v RETURN k, v", "SELECT event_id AS k, CAST(json_extract(props, '$.k') AS BIGINT) AS v FROM events")
_add("map_functions", "WITH {a: 1, b: 2} AS m RETURN map.merge(m, {b: 3, c: 4})['b'] AS b, size(map.sortedProperties(m)) AS n, map.removeKey(m, 'a')['a'] AS gone, castOrNull.integer(map.fromPairs([['x', 1], ['y', 2]])['y']) AS y, size(keys(map.dropNullValues({p: 1, q: null}))) AS kept",
     "SELECT CAST(3 AS BIGINT) AS b, CAST(2 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS gone, CAST(2 AS BIGINT) AS y, CAST(1 AS BIGINT) AS kept")
_add("regex_functions", "MATCH (p:Part) RETURN p.p_partkey AS k, text.regexFirstMatch(p.p_brand, '([A-Za-z]+).*?([0-9]+)') AS m, text.regexReplaceAll(p.p_brand, '[0-9]+', '<$0>') AS r, size(text.split(p.p_type, ' ')) AS n",
     "SELECT p_partkey AS k, CASE WHEN regexp_matches(p_brand, '([A-Za-z]+).*?([0-9]+)') THEN [regexp_extract(p_brand, '([A-Za-z]+).*?([0-9]+)', 0), regexp_extract(p_brand, '([A-Za-z]+).*?([0-9]+)', 1), regexp_extract(p_brand, '([A-Za-z]+).*?([0-9]+)', 2)] ELSE [] END AS m, regexp_replace(p_brand, '([0-9]+)', '<\\1>', 'g') AS r, CAST(len(split(p_type, ' ')) AS BIGINT) AS n FROM part")
_add("url_functions", "RETURN text.urlencode('a b&c/d') AS e, text.urldecode('a%20b%26c') AS d", "SELECT 'a%20b%26c%2Fd' AS e, 'a b&c' AS d")
_add("temporal_functions", "WITH localdatetime('2021-03-04T05:06:07') AS t RETURN t.year AS y, t.month AS m, t.day AS d, t.hour AS h, t.second AS s, temporal.format(t, 'yyyy/MM/dd') AS f, duration.between(localdatetime('2021-03-04T05:00:00'), t).seconds AS secs, localtime('01:02:03') AS nanos, (t + duration({hours: 20})).day AS later",
     "SELECT CAST(2021 AS BIGINT) AS y, CAST(3 AS BIGINT) AS m, CAST(4 AS BIGINT) AS d, CAST(5 AS BIGINT) AS h, CAST(7 AS BIGINT) AS s, '2021/03/04' AS f, CAST(367 AS BIGINT) AS secs, CAST(3723000000000 AS BIGINT) AS nanos, CAST(5 AS BIGINT) AS later")
_add("id_functions", "MATCH (r:Region) RETURN idFrom('r', r.r_regionkey) = idFrom('r', r.r_regionkey) AS same, idFrom('r', r.r_regionkey) = idFrom('s', r.r_regionkey) AS other, idFrom('r', null) IS NULL AS none, id(r) AS id", "SELECT true AS same, false AS other, true AS none, 'Region:' || r_regionkey AS id FROM region")
# Procedures and traversals
_add("filtered_edges", "MATCH (n:Nation) CALL getFilteredEdges(n, ['IN_REGION'], ['outgoing'], []) YIELD edge RETURN id(endNode(edge)) AS region, count(*) AS n", "SELECT 'Region:' || n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1")
_add("trigonometry", "MATCH (p:Part) WITH p, p.p_size / 100.0 AS x RETURN p.p_partkey AS k, round(acos(x), 6) AS a, round(asin(x), 6) AS b, round(atan(x), 6) AS c, round(cos(x), 6) AS d, round(cot(x), 6) AS e, round(sin(x), 6) AS f, round(tan(x), 6) AS g, round(degrees(x), 6) AS h, round(radians(x), 6) AS i",
     "SELECT p_partkey AS k, round(acos(x), 6) AS a, round(asin(x), 6) AS b, round(atan(x), 6) AS c, round(cos(x), 6) AS d, round(1 / tan(x), 6) AS e, round(sin(x), 6) AS f, round(tan(x), 6) AS g, round(degrees(x), 6) AS h, round(radians(x), 6) AS i FROM (SELECT *, p_size / 100.0::DOUBLE AS x FROM part)")
_add("exponentials", "MATCH (p:Part) WITH p, p.p_size + 1 AS x RETURN p.p_partkey AS k, round(exp(x / 10.0), 6) AS a, round(log10(x), 6) AS b, round(e() * x, 6) AS c, round(pi() * x, 6) AS d",
     "SELECT p_partkey AS k, round(exp((p_size + 1) / 10.0::DOUBLE), 6) AS a, round(log10(p_size + 1), 6) AS b, round(exp(1.0::DOUBLE) * (p_size + 1), 6) AS c, round(pi() * (p_size + 1), 6) AS d FROM part")
_add("text_edges", "MATCH (p:Part) WITH '  ' + p.p_name + ' ' AS t, p RETURN p.p_partkey AS k, lTrim(t) AS l, rTrim(t) AS r, toBoolean(CASE WHEN p.p_size > 20 THEN 'true' ELSE 'FALSE' END) AS b, text.utf8Decode(text.utf8Encode(p.p_name)) AS u, text.utf8Decode(convert.stringToBytes(p.p_brand, 'UTF-8')) AS v",
     "SELECT p_partkey AS k, ltrim('  ' || p_name || ' ') AS l, rtrim('  ' || p_name || ' ') AS r, p_size > 20 AS b, p_name AS u, p_brand AS v FROM part")
_add("path_parts", "MATCH p = (s:Supplier)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN s.s_suppkey AS k, size(nodes(p)) AS n, size(relationships(p)) AS m, nodes(p)[1] AS middle",
     "SELECT s_suppkey AS k, CAST(3 AS BIGINT) AS n, CAST(2 AS BIGINT) AS m, 'Nation:' || s_nationkey AS middle FROM supplier")
_add("property_maps", "MATCH (n:Nation) RETURN n.n_name AS name, properties(n).n_name AS same, strId(n) AS id", "SELECT n_name AS name, n_name AS same, 'Nation:' || n_nationkey AS id FROM nation")
_add("casts_that_throw", "MATCH (n:Nation) WITH n, toJson({a: n.n_nationkey, b: n.n_name}) AS j RETURN n.n_name AS name, castOrThrow.integer(parseJson(j).a) AS a, castOrThrow.string(parseJson(j).b) AS b, coll.min(n.n_nationkey, 7) AS least", "SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS a, n_name AS b, CAST(least(n_nationkey, 7) AS BIGINT) AS least FROM nation")
_add("mixed_extremes", "UNWIND [1, 2, 'hello', 4.0, null, true, 'a'] AS x WITH max(x) AS top, min(x) AS low RETURN castOrNull.float(top) AS top, castOrNull.string(low) AS low", "SELECT CAST(4 AS DOUBLE) AS top, 'a' AS low")
_add("property_keys", "CALL db.propertyKeys() YIELD propertyKey WITH propertyKey AS k WHERE k STARTS WITH 'n_' RETURN k", "SELECT k FROM (VALUES ('n_chars'), ('n_name'), ('n_nationkey'), ('n_regionkey')) t(k)")
_add("label_names", "CALL dbms.labels() YIELD label WITH label AS l WHERE l IN ['Nation', 'Region', 'Part'] RETURN l", "SELECT l FROM (VALUES ('Nation'), ('Region'), ('Part')) t(l)")
_add("do_when_row_parameters", "MATCH (r:Region) CALL do.when(r.r_regionkey > 2, 'RETURN $k AS y', 'RETURN -$k AS y', {k: r.r_regionkey}) YIELD value RETURN r.r_name AS name, castOrNull.integer(value.y) AS y", "SELECT r_name AS name, CAST(CASE WHEN r_regionkey > 2 THEN r_regionkey ELSE -r_regionkey END AS BIGINT) AS y FROM region")
_add("do_case_row_parameters", "MATCH (n:Nation) CALL cypher.do.case([n.n_nationkey < 5, 'RETURN $k + 100 AS y', n.n_nationkey < 10, 'UNWIND [$k, $k] AS y RETURN y'], 'RETURN 0 AS y', {k: n.n_nationkey}) YIELD value RETURN n.n_name AS name, castOrNull.integer(value.y) AS y",
     "SELECT n_name AS name, CAST(n_nationkey + 100 AS BIGINT) AS y FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_name, n_nationkey FROM nation, range(2) WHERE n_nationkey BETWEEN 5 AND 9 UNION ALL SELECT n_name, 0 FROM nation WHERE n_nationkey >= 10")
_add("do_it_row_parameters", "MATCH (r:Region) CALL cypher.doIt('MATCH (n:Nation) WHERE n.n_regionkey = $k RETURN count(n) AS c', {k: r.r_regionkey}) YIELD value RETURN r.r_name AS name, castOrNull.integer(value.c) AS c", "SELECT r_name AS name, count(*) AS c FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
_add("timeboxed", "CALL cypher.runTimeboxed('MATCH (r:Region) RETURN r.r_name AS name', {}, 600000) YIELD value RETURN castOrNull.string(value.name) AS name", "SELECT r_name AS name FROM region")
_add("shortest_path_procedure", "MATCH (s:Supplier {s_suppkey: 1}), (r:Region) CALL algorithms.shortestPath(s, r, {direction: 'outgoing', maxLength: 3}) YIELD path RETURN id(r) AS goal, length(path) AS hops", "SELECT 'Region:' || n_regionkey AS goal, CAST(2 AS BIGINT) AS hops FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey = 1")
_add("endpoint_nodes", "MATCH (:Customer)-[r:IN_NATION]->() WHERE startNode(r).c_acctbal > 5000 RETURN endNode(r).n_name AS nation, count(*) AS n, max(startNode(r).c_acctbal) AS most", "SELECT n_name AS nation, count(*) AS n, max(c_acctbal) AS most FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 5000 GROUP BY 1")
_add("percentile_disc_all", "MATCH (o:Order) RETURN percentileDisc(o.o_totalprice, 0.9) AS q, percentileDisc(o.o_orderdate, 0) AS first, count(*) AS n",
     "SELECT v AS q, first, n FROM (SELECT o_totalprice AS v, min(o_orderdate) OVER () AS first, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders) WHERE i = CAST(floor(0.9 * (n - 1) + 0.5) AS BIGINT)")
_add("percentile_of_row_fractions", "MATCH (c:Customer) WITH c, CASE c.c_mktsegment WHEN 'BUILDING' THEN 0.5 ELSE 0.25 END AS p RETURN c.c_mktsegment AS s, round(percentileCont(c.c_acctbal, p), 6) AS q",
     "SELECT c_mktsegment AS s, round(CASE c_mktsegment WHEN 'BUILDING' THEN quantile_cont(c_acctbal, 0.5) ELSE quantile_cont(c_acctbal, 0.25) END, 6) AS q FROM customer GROUP BY 1")
_add("hashes", "MATCH (n:Nation) RETURN n.n_nationkey AS k, hash(n.n_name, 1) = hash(n.n_name, 1) AS same, hash(n.n_name) = hash(n.n_name + 'x') AS other, kafkaHash(n.n_name) >= 0 AS whole, locIdFrom(3, n.n_name) STARTS WITH '3/' AS placed, text.utf8Decode(bytes('4142')) AS b", "SELECT n_nationkey AS k, true AS same, false AS other, true AS whole, true AS placed, 'AB' AS b FROM nation")
_add("generated", "MATCH (n:Nation) WITH n.n_nationkey AS k RETURN k, size(gen.string.from(k, 12)) AS s, gen.integer.from(k) = gen.integer.from(k) AS i, gen.float.from(k) < 1.0 AS f, meta.type(gen.boolean.from(k)) AS b, meta.type(gen.bytes.from(k, 4)) AS y, size(gen.node.from(k)) AS n",
     "SELECT n_nationkey AS k, CAST(12 AS BIGINT) AS s, true AS i, true AS f, 'BOOLEAN' AS b, 'BYTES' AS y, CAST(64 AS BIGINT) AS n FROM nation")
_add("type_names", "UNWIND [1] AS i RETURN meta.type(i) AS a, meta.type(1.5) AS b, meta.type('x') AS c, meta.type([1]) AS d, meta.type({a: 1}) AS e, meta.type(true) AS f, meta.type(date('2020-01-02')) AS g", "SELECT 'INTEGER' AS a, 'FLOAT' AS b, 'STRING' AS c, 'LIST' AS d, 'MAP' AS e, 'BOOLEAN' AS f, 'DATE' AS g")
_add("moments", "MATCH (e:Event) WITH e.event_id AS k, datetime({epochMillis: e.event_id * 86400000}) AS t RETURN k, t.epochMillis AS m, t.epochSeconds AS s, date({year: 2020, month: 2, day: 3}).day AS d, date('2021-05-06').month AS o, time('01:00:00+02:00').nanos AS n, time('01:00:00+02:00').offset_seconds AS z, timestamp() > t.epochMillis - 1000000000000000 AS now, rand() < 1.0 AS r",
     "SELECT event_id AS k, CAST(event_id * 86400000 AS BIGINT) AS m, CAST(event_id * 86400 AS BIGINT) AS s, CAST(3 AS BIGINT) AS d, CAST(5 AS BIGINT) AS o, CAST(3600000000000 AS BIGINT) AS n, CAST(7200 AS BIGINT) AS z, true AS now, true AS r FROM events")
_add("regex_groups", "MATCH (p:Part) RETURN p.p_partkey AS k, size(text.regexGroups(p.p_brand, '([0-9])')) AS n", "SELECT p_partkey AS k, len(regexp_extract_all(p_brand, '([0-9])')) AS n FROM part")
_add("coll_least", "MATCH (n:Nation) RETURN n.n_nationkey AS k, coll.min([n.n_nationkey, 7, 9]) AS low, coll.max(n.n_nationkey, 3) AS high", "SELECT n_nationkey AS k, CAST(least(n_nationkey, 7) AS BIGINT) AS low, CAST(greatest(n_nationkey, 3) AS BIGINT) AS high FROM nation")
_add("recent_nodes", "CALL recentNodes(5) YIELD node WITH node AS n RETURN count(n) AS n", "SELECT CAST(5 AS BIGINT) AS n")
_add("recent_node_ids", "CALL recentNodeIds(7) YIELD nodeId WITH nodeId AS i RETURN count(DISTINCT i) AS n", "SELECT CAST(7 AS BIGINT) AS n")
_add("help_functions", "CALL help.functions() YIELD name WITH name AS f WHERE f IN ['toUpper', 'idFrom', 'coll.max'] RETURN DISTINCT f", "SELECT f FROM (VALUES ('toUpper'), ('idFrom'), ('coll.max')) t(f)")
_add("help_procedures", "CALL help.procedures() YIELD name WITH name AS p WHERE toLower(p) IN ['random.walk', 'cypher.doit'] RETURN toLower(p) AS p", "SELECT p FROM (VALUES ('random.walk'), ('cypher.doit')) t(p)")
_add("indexes", "CALL db.indexes() YIELD name WITH name AS i WHERE i IN ['Nation', 'Part'] RETURN i", "SELECT i FROM (VALUES ('Nation'), ('Part')) t(i)")
_add("index_hint", "MATCH (n:Nation) USING INDEX n:Nation(n_name) WHERE n.n_name STARTS WITH 'N' AND n.n_nationkey < 9 RETURN n.n_name AS name", "SELECT n_name AS name FROM nation WHERE starts_with(n_name, 'N') AND n_nationkey < 9")
_add("shortest_path_pattern", "MATCH (s:Supplier {s_suppkey: 2}), (r:Region) MATCH p = shortestPath((s)-[*..4]->(r)) RETURN r.r_name AS region, length(p) AS hops", "SELECT r_name AS region, CAST(2 AS BIGINT) AS hops FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_suppkey = 2")
_add("random_walk_procedure", "MATCH (n:Nation) CALL random.walk(n, 1) YIELD walk RETURN n.n_name AS name, size(walk) >= 1 AS some", "SELECT n_name AS name, true AS some FROM nation")
_add("do_when", "UNWIND [1, 2] AS x CALL do.when(x = 1, 'RETURN 10 AS y', 'RETURN 20 AS y', {}) YIELD value RETURN x, castOrNull.integer(value.y) AS y", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(10 AS BIGINT)), (2, 20)) t(x, y)")
_add("relationship_types", "CALL db.relationshipTypes() YIELD relationshipType RETURN relationshipType AS t", "SELECT * FROM (VALUES ('IN_REGION'), ('IN_NATION'), ('PLACED'), ('CONTAINS'), ('OF_PART'), ('FROM_SUPPLIER'), ('DID'), ('FROM_SOURCE')) x(t)")

GREMLIN = {
    "gremlin_out": ("g.V().hasLabel('Nation').out('IN_REGION').dedup().values('r_name')", "SELECT r_name AS result FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)"),
    "gremlin_count": ("g.V().hasLabel('Region').in('IN_REGION').in('IN_NATION').hasLabel('Supplier').count()", "SELECT count(*) AS result FROM supplier"),
    "gremlin_where": ("g.V().hasLabel('Nation').where(__.in('IN_NATION').hasLabel('Supplier')).id()", "SELECT 'Nation:' || n_nationkey AS result FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)"),
    "gremlin_ids": ("g.V(['Nation:3', 'Region:1']).union(__.values('n_name'), __.values('r_name'))", "SELECT n_name AS result FROM nation WHERE n_nationkey = 3 UNION ALL SELECT r_name FROM region WHERE r_regionkey = 1"),
    "gremlin_edges": ("g.V().hasLabel('Nation').outE('IN_REGION').inV().hasId('Region:2').strId()", "SELECT 'Region:' || n_regionkey AS result FROM nation WHERE n_regionkey = 2"),
    "gremlin_select": ("g.V().hasLabel('Nation').as('a').out('IN_REGION').hasId('Region:3').select('a').values('n_name').is(regex('.*[0-4]'))", "SELECT n_name AS result FROM nation WHERE n_regionkey = 3 AND regexp_full_match(n_name, '.*[0-4]')"),
    "gremlin_variable": ("x = 'Region:4'; g.V().hasLabel('Region').eqToVar(x).in('IN_REGION').count()", "SELECT count(*) AS result FROM nation WHERE n_regionkey = 4"),
    "gremlin_path": ("g.V('Nation:3').out('IN_REGION').unrollPath().id()", "SELECT x AS result FROM nation, unnest(['Nation:' || n_nationkey, 'Region:' || n_regionkey]) t(x) WHERE n_nationkey = 3"),
    "gremlin_not": ("g.V().hasLabel('Nation').not(__.in('IN_NATION').hasLabel('Supplier')).hasNot('r_name').limit(1000).id()", "SELECT 'Nation:' || n_nationkey AS result FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)"),
}
SQL |= {k: v for k, (_, v) in GREMLIN.items()}


def _cypher(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine.retail(spark, sf_dir).cypher(text)


def random_walk_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks of three steps from every nation; regions and nations always have a neighbour."""
    from weftgraph.procedures import random_walks

    e = Engine.retail(spark, sf_dir)
    start = e.catalog.table("Nation").df.select(F.concat(F.lit("Nation:"), "n_nationkey").alias("id"), F.lit(0).alias("n"))
    walks = random_walks(e.catalog.all_edges(["IN_REGION"]), start, 3)
    return walks.select("id", F.size("walk").cast("long").alias("steps"))


SQL["random_walk_lengths"] = "SELECT 'Nation:' || n_nationkey AS id, CAST(4 AS BIGINT) AS steps FROM nation"


def _event_graph(spark: SparkSession, sf_dir: str) -> Engine:
    """A graph of users and their events, written through an ingest query."""
    import uuid

    from weftgraph.session import shared_dir
    from weftgraph.streaming.events import EventGraph
    from weftgraph.streaming.ingest import Ingest

    e = Engine(spark, events=EventGraph(spark, f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"))
    records = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    Ingest(e, "MATCH (u), (e) WHERE id(u) = idFrom('user', $that.user_id) AND id(e) = idFrom('event', $that.event_id) SET u:User, u.user_id = $that.user_id, e:Event, e.kind = $that.event_type CREATE (u)-[:DID]->(e)").run(records)
    return e


def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_graph(spark, sf_dir).cypher("MATCH (u:User)-[:DID]->(e:Event) RETURN u.user_id AS user, e.kind AS kind, count(*) AS n")


SQL["ingest_counts"] = "SELECT user_id AS user, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2"


def standing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with an error and a purchase, found as the errors arrive after the rest."""
    from weftgraph.streaming.standing import StandingQuery

    e = _event_graph(spark, sf_dir)
    q = StandingQuery(e, "both", "MATCH (u:User)-[:DID]->(a:Event), (u)-[:DID]->(b:Event) WHERE a.kind = 'refund' AND b.kind = 'purchase' RETURN u.user_id AS user, b.kind AS kind")
    changed = e.events.events().where("kind = 'PropertySet' AND key = 'kind' AND value = '\"error\"'").withColumn("ts_ms", F.lit(e.events.now())).withColumn("value", F.lit('"refund"'))
    out = q.process(changed)
    return out.where("meta.isPositiveMatch").select(F.col("data.user").alias("user")).groupBy("user").agg(F.count("*").alias("n"))


SQL["standing_query"] = "SELECT user_id AS user, CAST(count(*) FILTER (event_type = 'error') * count(*) FILTER (event_type = 'purchase') AS BIGINT) AS n FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') * count(*) FILTER (event_type = 'purchase') > 0"


def standing_not_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users without an error, after their errors arrived: the pattern in WHERE takes back what stood."""
    from weftgraph.streaming.standing import StandingQuery

    e = _event_graph(spark, sf_dir)
    log = e.events.events()
    q = StandingQuery(e, "calm", "MATCH (u:User) WHERE NOT (u)-[:DID]->(:Event {kind: 'refund'}) RETURN u.user_id AS user")
    changed = log.where("kind = 'PropertySet' AND key = 'kind' AND value = '\"error\"'").withColumn("ts_ms", F.lit(e.events.now())).withColumn("value", F.lit('"refund"'))
    gone = q.process(changed).where("not meta.isPositiveMatch").select(F.col("data.user").alias("user"), F.lit("gone").alias("state"))
    return q.matches().select("user", F.lit("stays").alias("state")).unionByName(gone)


SQL["standing_not_pattern"] = "SELECT user_id AS user, CASE WHEN bool_or(event_type = 'error') THEN 'gone' ELSE 'stays' END AS state FROM events GROUP BY 1"


def _written(final: str, *steps: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query over a new event graph after the writing steps."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        import uuid

        from weftgraph.session import shared_dir
        from weftgraph.streaming.events import EventGraph

        e = Engine(spark, events=EventGraph(spark, f"{shared_dir(spark)}/written-{uuid.uuid4().hex}"))
        for text in steps:
            e.cypher(text)
        return e.cypher(final)

    return query


WRITTEN = {
    "merge": ("MATCH (n:Thing) RETURN n.k AS k, n.state AS state", ["CREATE (:Thing {k: 1})", *(f"MERGE (n:Thing {{k: {k}}}) ON CREATE SET n.state = 'made' ON MATCH SET n.state = 'met'" for k in (1, 2))], "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'met'), (2, 'made')) t(k, state)"),
    "foreach": ("MATCH (n:Step) RETURN n.i AS i, n.sq AS sq", ["FOREACH (i IN range(1, 3) | CREATE (:Step {i: i, sq: i * i}))"], "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(1 AS BIGINT)), (2, 4), (3, 9)) t(i, sq)"),
    "set_properties": ("MATCH (n:T) RETURN n.b AS b, n.c AS c, labels(n) AS labels", ["CREATE (:T {a: 1, b: 2})", "MATCH (n:T) SET n += {b: 3, c: 4}, n:Extra", "MATCH (n:T) REMOVE n:Extra, n.a"], "SELECT CAST(3 AS BIGINT) AS b, CAST(4 AS BIGINT) AS c, ['T'] AS labels"),
    "detach_delete": ("MATCH (a)-[:R]->(b) RETURN a.k AS a, b.k AS b", ["CREATE (:A {k: 1})-[:R]->(:B {k: 2})", "CREATE (:A {k: 3})-[:R]->(:B {k: 4})", "MATCH (n:B {k: 2}) DETACH DELETE n"], "SELECT CAST(3 AS BIGINT) AS a, CAST(4 AS BIGINT) AS b"),
    "counters": ("MATCH (c:C) RETURN c.n AS n, c.m AS m, c.f AS f", ["CREATE (:C {k: 1, m: 10})", "MATCH (c:C) CALL incrementCounter(c, 'n', 5) YIELD count RETURN count", "MATCH (c:C) CALL int.add(c, 'm', 7) YIELD result RETURN result", "MATCH (c:C) CALL float.add(c, 'f', 1.5) YIELD result RETURN result"], "SELECT CAST(5 AS BIGINT) AS n, CAST(17 AS BIGINT) AS m, CAST(1.5 AS DOUBLE) AS f"),
    "create_procedures": ("MATCH (a:New)-[:REL]->(b) RETURN a.k AS a, b.v AS b", ["CREATE (:P {k: 1}), (:Q {k: 2})", "MATCH (a:P), (b:Q) CALL create.relationship(a, 'REL', {}, b) YIELD rel RETURN 1 AS one", "MATCH (b:Q) CALL create.setProperty(b, 'v', 9)", "MATCH (a:P) CALL create.setLabels(a, ['New'])"], "SELECT CAST(1 AS BIGINT) AS a, CAST(9 AS BIGINT) AS b"),
}
WRITTEN |= {
    "set_procedures": ("MATCH (c:C) RETURN size(c.tags) AS n", ["CREATE (:C {k: 1})", "MATCH (c:C) CALL set.insert(c, 'tags', 'a') YIELD result RETURN result", "MATCH (c:C) CALL set.union(c, 'tags', ['a', 'b', 'c']) YIELD result RETURN result"], "SELECT CAST(3 AS BIGINT) AS n"),
    "purge_node": ("MATCH (n) RETURN n.k AS k", ["CREATE (:A {k: 1})-[:R]->(:B {k: 2})", "MATCH (n:A) CALL purgeNode(n)"], "SELECT CAST(2 AS BIGINT) AS k"),
    "delete_edge": ("MATCH (a:A) RETURN a.k AS k, size((a)-[:R]->()) AS n", ["CREATE (a:A {k: 1})-[:R]->(:B {k: 2}), (a)-[:R]->(:B {k: 3})", "MATCH (:A)-[r:R]->(b:B {k: 3}) DELETE r"], "SELECT CAST(1 AS BIGINT) AS k, CAST(1 AS BIGINT) AS n"),
    "remove_property": ("MATCH (n:T) RETURN n.k AS k, n.v AS v", ["CREATE (:T {k: 1, v: 5}), (:T {k: 2, v: 6})", "MATCH (n:T {k: 1}) REMOVE n.v", "MATCH (n:T {k: 2}) SET n = {k: 9}"], "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(NULL AS BIGINT)), (9, NULL)) t(k, v)"),
    "created_endpoints": ("MATCH ()-[r:R]->() RETURN startNode(r).k AS a, endNode(r).k AS b", ["CREATE (:A {k: 1})-[:R]->(:B {k: 2})"], "SELECT CAST(1 AS BIGINT) AS a, CAST(2 AS BIGINT) AS b"),
}
SQL |= {f"write_{k}": sql for k, (_, _, sql) in WRITTEN.items()}


def load_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as CSV and as JSON lines, read by LOAD CSV and by loadJsonLines."""
    import uuid

    from weftgraph.session import shared_dir

    at = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    nations.write.option("header", True).csv(f"{at}/csv")
    nations.write.json(f"{at}/json")
    e = Engine.retail(spark, sf_dir)
    one = e.cypher(f"LOAD CSV WITH HEADERS FROM '{at}/csv' AS r RETURN toInteger(r.n_nationkey) AS k, r.n_name AS name, 'csv' AS kind")
    two = e.cypher(f"CALL loadJsonLines('{at}/json') YIELD value RETURN castOrNull.integer(value.n_nationkey) AS k, castOrNull.string(value.n_name) AS name, 'json' AS kind")
    return one.unionByName(two)


SQL["load_files"] = "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, kind FROM nation, (VALUES ('csv'), ('json')) t(kind)"


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query with parameters."""
    return Engine.retail(spark, sf_dir).cypher("MATCH (n:Nation) WHERE n.n_nationkey IN $keys AND n.n_name <> $name RETURN n.n_name AS name, $extra.a AS a", params={"keys": [1, 2, 3], "name": "none", "extra": {"a": 5}})


SQL["parameters"] = "SELECT n_name AS name, CAST(5 AS BIGINT) AS a FROM nation WHERE n_nationkey IN (1, 2, 3)"


def value_hash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and suppliers by key; as a hand-built plan, in which nulls would meet."""
    from weftgraph.operators import relational as R

    g = Engine.retail(spark, sf_dir).catalog
    n, s = R.anchored_entry(g, "n", "Nation"), R.anchored_entry(g, "s", "Supplier")
    return R.adjust_context(R.value_hash_join(n, s, "n_key", "s_s_nationkey"), nation="n_n_name", supplier="s_key")


SQL["value_hash_join"] = "SELECT n_name AS nation, s_suppkey AS supplier FROM nation JOIN supplier ON s_nationkey = n_nationkey"


def or_else(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's suppliers, or a row of its own where it has none."""
    from weftgraph.operators import relational as R

    g = Engine.retail(spark, sf_dir).catalog
    n = R.anchored_entry(g, "n", "Nation")
    hits = R.expand(n, g, "n", "IN_NATION", "s", "in").where("s_id like 'Supplier:%'").select("n_id", F.col("s_id").alias("found"))
    other = n.select("n_id", F.lit("none").alias("found"))
    return R.or_else(n.select("n_id"), hits, other, ["n_id"]).select(F.col("n_id").alias("id"), "found")


SQL["or_else"] = "SELECT 'Nation:' || n_nationkey AS id, coalesce('Supplier:' || s_suppkey, 'none') AS found FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{k: _cypher(v) for k, v in CYPHER.items()},
    **{k: (lambda spark, sf_dir, text=t: Engine.retail(spark, sf_dir).gremlin(text)) for k, (t, _) in GREMLIN.items()},
    **{f"write_{k}": _written(final, *steps) for k, (final, steps, _) in WRITTEN.items()},
    "load_files": load_files,
    "parameters": parameters,
    "value_hash_join": value_hash_join,
    "or_else": or_else,
    "random_walk_lengths": random_walk_lengths,
    "ingest_counts": ingest_counts,
    "standing_query": standing_query,
    "standing_not_pattern": standing_not_pattern,
}
