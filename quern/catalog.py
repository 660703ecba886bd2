"""Registered queries: one or more for each operator, each with the SQL that it must equal.

SPARQL queries run over the Parquet tables by the direct mapping of ``sources.virtual``; the
others are built from the same operators by the functions at the end.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import terms as t
from quern.functions.registry import EXPT_NS, TIME_NS
from quern.operators.update import run_sequential
from quern.session import Dataset, quad_text
from quern.sources import ntriples, turtle
from quern.sources.quads import QuadSource
from quern.sources.virtual import VirtualSource, register
from quern.sparql import ast as A
from quern.sparql.parser import parse
from quern.storage import materialize, shared_dir
from quern.streaming.accumulators import accumulator_of, running
from quern.streaming.events import event_matches
from quern.streaming.incremental import IncrementalView
from quern.streaming.rules import RuleEngine

PREFIXES = {"t": "urn:t:", "c": "urn:c:", "r": "urn:r:", "x": "urn:x:", "xsd": A.XSD, "math": EXPT_NS, "time": TIME_NS}
_TYPE = A.RDF + "type"

#: name -> (SPARQL, SQL)
SPARQL: dict[str, tuple[str, str]] = {
    # Patterns, filters, BIND
    "bgp_filter_orders": (
        "SELECT ?o ?price { ?o c:o_totalprice ?price FILTER(?price > 400000) }",
        "SELECT 'urn:t:orders/' || o_orderkey AS o, o_totalprice AS price FROM orders WHERE o_totalprice > 400000",
    ),
    "bgp_var_predicate_nation": (
        "SELECT ?s ?p ?o { ?s a t:Nation ; ?p ?o }",
        f"""SELECT 'urn:t:nation/' || n_nationkey AS s, u.p, u.o FROM nation, LATERAL (VALUES ('{_TYPE}', 'urn:t:Nation'), ('urn:c:n_nationkey', CAST(n_nationkey AS VARCHAR)),
            ('urn:c:n_name', n_name), ('urn:c:n_regionkey', CAST(n_regionkey AS VARCHAR)), ('urn:r:region', 'urn:t:region/' || n_regionkey)) u(p, o)""",
    ),
    "bgp_constant_subject": (
        "SELECT ?name ?region { t:nation\\/7 c:n_name ?name ; r:region ?region }",
        "SELECT n_name AS name, 'urn:t:region/' || n_regionkey AS region FROM nation WHERE n_nationkey = 7",
    ),
    "bgp_constant_object": (
        'SELECT ?c { ?c c:c_mktsegment "BUILDING" ; r:nation t:nation\\/3 }',
        "SELECT 'urn:t:customer/' || c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3",
    ),
    "bgp_repeated_variable": (
        "SELECT ?l { ?l c:l_linenumber ?n ; c:l_suppkey ?n }",
        "SELECT 'urn:t:lineitem/' || l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || CAST(l_extendedprice AS VARCHAR) || '/' || CAST(l_shipdate AS VARCHAR) AS l FROM lineitem WHERE l_linenumber = l_suppkey",
    ),
    "bgp_join_chain": (
        "SELECT ?customer ?nation ?region ?price { ?o r:customer ?c ; c:o_totalprice ?price . ?c c:c_name ?customer ; r:nation ?n . ?n c:n_name ?nation ; r:region ?g . ?g c:r_name ?region FILTER(?price > 300000) }",
        """SELECT c_name AS customer, n_name AS nation, r_name AS region, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey
           JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 300000""",
    ),
    "join_cross_region": ("SELECT ?a ?b { ?x c:r_name ?a . ?y c:r_name ?b }", "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b"),
    "join_theta_nation": (
        "SELECT ?a ?b { ?x c:n_name ?a ; c:n_regionkey ?g . ?y c:n_name ?b ; c:n_regionkey ?g FILTER(?a < ?b) }",
        "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_name < b.n_name",
    ),
    "subselect_join": (
        "SELECT ?name ?n { ?c c:c_name ?name { SELECT ?c (COUNT(*) AS ?n) { ?o r:customer ?c } GROUP BY ?c } }",
        "SELECT c_name AS name, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey",
    ),
    "union_parties": (
        "SELECT ?x ?name { { ?x c:c_name ?name } UNION { ?x c:s_name ?name } UNION { ?x c:n_name ?name } }",
        "SELECT 'urn:t:customer/' || c_custkey AS x, c_name AS name FROM customer UNION ALL SELECT 'urn:t:supplier/' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'urn:t:nation/' || n_nationkey, n_name FROM nation",
    ),
    "union_join": (
        "SELECT ?nation ?bal { ?n c:n_name ?nation { ?x r:nation ?n ; c:c_acctbal ?bal } UNION { ?x r:nation ?n ; c:s_acctbal ?bal } FILTER(?bal > 5000) }",
        "SELECT n_name AS nation, bal FROM nation JOIN (SELECT c_nationkey AS k, c_acctbal AS bal FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) ON k = n_nationkey WHERE bal > 5000",
    ),
    "optional_lineitem": (
        "SELECT ?o ?q { ?o c:o_totalprice ?p OPTIONAL { ?l r:order ?o ; c:l_quantity ?q } FILTER(?p > 450000) }",
        "SELECT 'urn:t:orders/' || o_orderkey AS o, l_quantity AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 450000",
    ),
    "optional_filter_scope": (
        "SELECT ?c ?p { ?c a t:Customer ; c:c_acctbal ?b OPTIONAL { ?o r:customer ?c ; c:o_totalprice ?p FILTER(?p > 450000 && ?b > 0) } }",
        "SELECT 'urn:t:customer/' || c_custkey AS c, o_totalprice AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 450000 AND c_acctbal > 0",
    ),
    "optional_nested": (
        "SELECT ?c ?o ?q { ?c c:c_acctbal ?b FILTER(?b > 8000) OPTIONAL { ?o r:customer ?c ; c:o_totalprice ?p FILTER(?p > 400000) OPTIONAL { ?l r:order ?o ; c:l_quantity ?q FILTER(?q > 40) } } }",
        """SELECT 'urn:t:customer/' || c_custkey AS c, 'urn:t:orders/' || o_orderkey AS o, l_quantity AS q FROM customer LEFT JOIN (orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 40)
           ON o_custkey = c_custkey AND o_totalprice > 400000 WHERE c_acctbal > 8000""",
    ),
    "exists_big_order": (
        "SELECT ?name { ?c c:c_name ?name FILTER EXISTS { ?o r:customer ?c ; c:o_totalprice ?p FILTER(?p > 450000) } }",
        "SELECT c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
    ),
    "not_exists_lineitem": (
        "SELECT ?o { ?o a t:Orders FILTER NOT EXISTS { ?l r:order ?o } }",
        "SELECT 'urn:t:orders/' || o_orderkey AS o FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    ),
    "exists_theta_newer_event": (
        "SELECT ?e ?u { ?e c:user_id ?u ; c:ts ?t FILTER NOT EXISTS { ?f c:user_id ?u ; c:ts ?t2 FILTER(?t2 > ?t) } }",
        "SELECT 'urn:t:events/' || event_id AS e, user_id AS u FROM events a WHERE NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.ts > a.ts)",
    ),
    "filter_exists_or_expr": (
        "SELECT ?c { ?c c:c_acctbal ?b FILTER(?b > 9000 || EXISTS { ?o r:customer ?c ; c:o_totalprice ?p FILTER(?p > 450000) }) }",
        "SELECT 'urn:t:customer/' || c_custkey AS c FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
    ),
    "minus_labels": (
        "SELECT ?d { ?d a t:Documents MINUS { ?l r:document ?d } }",
        "SELECT 'urn:t:documents/' || doc_id AS d FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    ),
    "minus_disjoint": ("SELECT ?n { ?n a t:Nation MINUS { ?r a t:Region } }", "SELECT 'urn:t:nation/' || n_nationkey AS n FROM nation"),
    "values_undef_join": (
        'SELECT ?n ?name { VALUES (?n ?name) { (t:nation\\/1 UNDEF) (UNDEF "NATION_2") (t:nation\\/3 "NATION_4") (UNDEF UNDEF) } ?n c:n_name ?name }',
        """SELECT 'urn:t:nation/' || n_nationkey AS n, n_name AS name FROM nation JOIN (VALUES ('urn:t:nation/1', NULL), (NULL, 'NATION_2'), ('urn:t:nation/3', 'NATION_4'), (NULL, NULL)) v(a, b)
           ON (a IS NULL OR a = 'urn:t:nation/' || n_nationkey) AND (b IS NULL OR b = n_name)""",
    ),
    "values_trailing": (
        'SELECT ?c ?seg { ?c c:c_mktsegment ?seg } VALUES ?seg { "BUILDING" "MACHINERY" }',
        "SELECT 'urn:t:customer/' || c_custkey AS c, c_mktsegment AS seg FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    ),
    "bind_arith": (
        "SELECT ?l ?net { ?l c:l_orderkey ?l_ ; c:l_extendedprice ?p ; c:l_discount ?d ; c:l_tax ?x BIND(ROUND(?p * (1 - ?d) * (1 + ?x) * 100) / 100 AS ?net) FILTER(?net > 90000) }".replace("?l ?net {", "?l_ ?net {"),
        "SELECT l_orderkey AS l_, floor(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100 + 0.5) / 100 AS net FROM lineitem WHERE floor(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100 + 0.5) / 100 > 90000",
    ),
    "bind_error_unbound": (
        'SELECT ?n ?q ?e { ?x c:n_name ?n ; c:n_nationkey ?k BIND(100 / (?k - 3) AS ?q) BIND(IF("text" != 1, "correct", "problem") AS ?e) }',
        "SELECT n_name AS n, CASE WHEN n_nationkey <> 3 THEN 100.0::DOUBLE / (n_nationkey - 3) END AS q, CAST(NULL AS VARCHAR) AS e FROM nation",
    ),
    "empty_group": ('SELECT ?a (1 + 1 AS ?two) { BIND("x" AS ?a) }', "SELECT 'x' AS a, CAST(2 AS BIGINT) AS two"),
    # Paths
    "path_seq": ("SELECT ?c ?name { ?c r:nation/r:region/c:r_name ?name }", "SELECT 'urn:t:' || k AS c, r_name AS name FROM (SELECT 'customer/' || c_custkey AS k, c_nationkey AS n FROM customer UNION ALL SELECT 'supplier/' || s_suppkey, s_nationkey FROM supplier) JOIN nation ON n = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "path_inverse": ("SELECT ?r ?n { ?r a t:Region ; ^r:region ?n }", "SELECT 'urn:t:region/' || n_regionkey AS r, 'urn:t:nation/' || n_nationkey AS n FROM nation"),
    "path_alt": ("SELECT ?x ?v { ?x c:n_name|c:r_name ?v }", "SELECT 'urn:t:nation/' || n_nationkey AS x, n_name AS v FROM nation UNION ALL SELECT 'urn:t:region/' || r_regionkey, r_name FROM region"),
    "path_opt": (
        "SELECT ?v { t:nation\\/5 r:region? ?v }",
        "SELECT 'urn:t:nation/5' AS v UNION ALL SELECT 'urn:t:region/' || n_regionkey FROM nation WHERE n_nationkey = 5",
    ),
    "path_plus": (
        "SELECT ?x ?v { ?x (r:nation|r:region)+ ?v }",
        """WITH e AS (SELECT 'urn:t:customer/' || c_custkey AS x, 'urn:t:nation/' || c_nationkey AS y FROM customer UNION SELECT 'urn:t:supplier/' || s_suppkey, 'urn:t:nation/' || s_nationkey FROM supplier
           UNION SELECT 'urn:t:nation/' || n_nationkey, 'urn:t:region/' || n_regionkey FROM nation) SELECT x, y AS v FROM e UNION SELECT a.x, b.y FROM e a JOIN e b ON a.y = b.x""",
    ),
    "path_star": (
        "SELECT ?v { t:customer\\/42 (r:nation|r:region)* ?v }",
        "SELECT 'urn:t:customer/42' AS v UNION SELECT 'urn:t:nation/' || c_nationkey FROM customer WHERE c_custkey = 42 UNION SELECT 'urn:t:region/' || n_regionkey FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE c_custkey = 42",
    ),
    "path_negated": (
        f"SELECT ?n ?v {{ ?n a t:Nation ; !(c:n_name|c:n_nationkey|<{_TYPE}>) ?v }}",
        "SELECT 'urn:t:nation/' || n_nationkey AS n, CAST(n_regionkey AS VARCHAR) AS v FROM nation UNION ALL SELECT 'urn:t:nation/' || n_nationkey, 'urn:t:region/' || n_regionkey FROM nation",
    ),
    # Aggregates and modifiers
    "agg_count": ("SELECT ?s (COUNT(*) AS ?n) (COUNT(?p) AS ?m) { ?o c:o_orderstatus ?s ; c:o_totalprice ?p } GROUP BY ?s", "SELECT o_orderstatus AS s, count(*) AS n, count(o_totalprice) AS m FROM orders GROUP BY 1"),
    "agg_count_distinct": ("SELECT ?f (COUNT(DISTINCT ?p) AS ?n) { ?l c:l_returnflag ?f ; c:l_partkey ?p } GROUP BY ?f", "SELECT l_returnflag AS f, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1"),
    "agg_sum": ("SELECT ?f (SUM(?q) AS ?sum_qty) (SUM(?k) AS ?sum_k) { ?l c:l_returnflag ?f ; c:l_quantity ?q ; c:l_linenumber ?k } GROUP BY ?f", "SELECT l_returnflag AS f, sum(l_quantity) AS sum_qty, CAST(sum(l_linenumber) AS BIGINT) AS sum_k FROM lineitem GROUP BY 1"),
    "agg_avg": ("SELECT ?f (ROUND(AVG(?q) * 1000000) AS ?avg6) { ?l c:l_returnflag ?f ; c:l_quantity ?q } GROUP BY ?f", "SELECT l_returnflag AS f, floor(avg(l_quantity) * 1000000 + 0.5) AS avg6 FROM lineitem GROUP BY 1"),
    "agg_min_max": ("SELECT ?s (MIN(?b) AS ?lo) (MAX(?b) AS ?hi) (MIN(?n) AS ?first) { ?c c:c_mktsegment ?s ; c:c_acctbal ?b ; c:c_name ?n } GROUP BY ?s", "SELECT c_mktsegment AS s, min(c_acctbal) AS lo, max(c_acctbal) AS hi, min(c_name) AS first FROM customer GROUP BY 1"),
    "agg_sample": ("SELECT ?r (SAMPLE(?k) AS ?any) { ?n r:region ?r ; c:n_regionkey ?k } GROUP BY ?r", "SELECT 'urn:t:region/' || n_regionkey AS r, CAST(n_regionkey AS BIGINT) AS any FROM nation GROUP BY n_regionkey"),
    "agg_group_concat": ('SELECT ?k (GROUP_CONCAT(?name ; SEPARATOR="|") AS ?names) { ?n c:n_regionkey ?k ; c:n_name ?name } GROUP BY ?k', "SELECT CAST(n_regionkey AS BIGINT) AS k, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY 1"),
    "agg_distinct": ("SELECT ?s (SUM(DISTINCT ?k) AS ?total) (AVG(DISTINCT ?k) AS ?mean) { ?c c:c_mktsegment ?s ; c:c_nationkey ?k } GROUP BY ?s", "SELECT c_mktsegment AS s, CAST(sum(DISTINCT c_nationkey) AS BIGINT) AS total, avg(DISTINCT c_nationkey) AS mean FROM customer GROUP BY 1"),
    "agg_expr": ("SELECT ?s (SUM(?b * ?b) / COUNT(*) + 1 AS ?m) { ?c c:c_mktsegment ?s ; c:c_nationkey ?b } GROUP BY ?s", "SELECT c_mktsegment AS s, CAST(sum(CAST(c_nationkey AS BIGINT) * c_nationkey) AS DOUBLE) / count(*) + 1 AS m FROM customer GROUP BY 1"),
    "agg_implicit": ("SELECT (COUNT(*) AS ?n) (SUM(?p) AS ?total) { ?o c:o_totalprice ?p FILTER(?p > 1000000000) }", "SELECT count(*) AS n, coalesce(sum(o_totalprice), 0) AS total FROM orders WHERE o_totalprice > 1000000000"),
    "group_by_expr": ("SELECT ?y (COUNT(*) AS ?n) { ?o c:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1"),
    "having_sum": ("SELECT ?c (SUM(?p) AS ?spent) { ?o r:customer ?c ; c:o_totalprice ?p } GROUP BY ?c HAVING(COUNT(*) > 12 && MAX(?p) > 400000)".replace("SUM(?p) AS ?spent", "COUNT(?p) AS ?orders"), "SELECT 'urn:t:customer/' || o_custkey AS c, count(*) AS orders FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 400000"),
    "select_distinct": ("SELECT DISTINCT ?s ?p { ?o c:o_orderstatus ?s ; c:o_orderpriority ?p }", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders"),
    "select_reduced": ("SELECT REDUCED ?s { ?c c:c_mktsegment ?s }", "SELECT c_mktsegment AS s FROM customer"),
    "order_limit_offset": ("SELECT ?k ?p { ?o c:o_orderkey ?k ; c:o_totalprice ?p } ORDER BY DESC(?p) ?k LIMIT 20 OFFSET 5", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 20 OFFSET 5"),
    "ask_exists": ('ASK { ?c c:c_mktsegment "BUILDING" ; c:c_acctbal ?b FILTER(?b > 9000) }', "SELECT count(*) > 0 AS ask FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000"),
    # Functions
    "fn_logic": (
        "SELECT ?k ?a ?b ?c { ?n c:n_nationkey ?k BIND(?k > 3 && ?k < 9 AS ?a) BIND(?k > 3 || 1 / (?k - 5) > 0 AS ?b) BIND(!(?k = 7) AS ?c) }",
        "SELECT CAST(n_nationkey AS BIGINT) AS k, n_nationkey > 3 AND n_nationkey < 9 AS a, n_nationkey > 3 OR (CASE WHEN n_nationkey <> 5 THEN 1.0 / (n_nationkey - 5) > 0 END) AS b, NOT (n_nationkey = 7) AS c FROM nation",
    ),
    "fn_compare": (
        'SELECT ?c { ?c c:c_name ?n ; c:c_acctbal ?b ; c:c_nationkey ?k FILTER(?n >= "Customer#000000100" && ?b <= 5000 && ?k != 3 && ?b > ?k) }',
        "SELECT 'urn:t:customer/' || c_custkey AS c FROM customer WHERE c_name >= 'Customer#000000100' AND c_acctbal <= 5000 AND c_nationkey <> 3 AND c_acctbal > c_nationkey",
    ),
    "fn_in": (
        'SELECT ?c { ?c c:c_mktsegment ?s ; c:c_nationkey ?k FILTER(?s IN ("BUILDING", "FURNITURE") && ?k NOT IN (1, 2, 3.0)) }',
        "SELECT 'urn:t:customer/' || c_custkey AS c FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') AND c_nationkey NOT IN (1, 2, 3)",
    ),
    "fn_if_coalesce": (
        'SELECT ?d ?q ?r { ?d a t:Documents OPTIONAL { ?l r:document ?d ; c:quality ?x } BIND(COALESCE(?x, -1) AS ?q) BIND(IF(BOUND(?x), IF(?x = 1, "good", "bad"), "none") AS ?r) }',
        "SELECT 'urn:t:documents/' || d.doc_id AS d, CAST(coalesce(quality, -1) AS BIGINT) AS q, CASE WHEN quality IS NULL THEN 'none' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS r FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    ),
    "fn_term_tests": (
        "SELECT ?p ?i ?l ?n ?b ?d ?s { t:nation\\/4 ?p ?o BIND(isIRI(?o) AS ?i) BIND(isLiteral(?o) AS ?l) BIND(isNumeric(?o) AS ?n) BIND(isBlank(?o) AS ?b) BIND(STR(DATATYPE(?o)) AS ?d) BIND(sameTerm(?o, 4) AS ?s) }",
        f"""SELECT u.p, u.i, NOT u.i AS l, u.n, false AS b, u.d, u.s FROM (VALUES ('{_TYPE}', true, false, NULL, false), ('urn:c:n_nationkey', false, true, '{A.INTEGER}', true), ('urn:c:n_name', false, false, '{A.STRING}', false),
            ('urn:c:n_regionkey', false, true, '{A.INTEGER}', (SELECT n_regionkey = 4 FROM nation WHERE n_nationkey = 4)), ('urn:r:region', true, false, NULL, false)) u(p, i, n, d, s)""",
    ),
    "fn_terms": (
        'SELECT ?k ?a ?b ?c ?d ?e { ?n c:n_nationkey ?k ; c:n_name ?m BIND(STR(?n) AS ?a) BIND(IRI(CONCAT("urn:n:", ?m)) AS ?b) BIND(LANG(STRLANG(?m, "en")) AS ?c) BIND(STR(STRDT(STR(?k), xsd:integer)) AS ?d) BIND(STRDT(STR(?k), xsd:integer) + 1 AS ?e0) BIND(xsd:integer(?e0) AS ?e) }',
        "SELECT CAST(n_nationkey AS BIGINT) AS k, 'urn:t:nation/' || n_nationkey AS a, 'urn:n:' || n_name AS b, 'en' AS c, CAST(n_nationkey AS VARCHAR) AS d, CAST(n_nationkey + 1 AS BIGINT) AS e FROM nation",
    ),
    "fn_string": (
        'SELECT ?p ?n ?s ?u ?l ?a ?z ?m ?f ?g ?c { ?x c:p_partkey ?p ; c:p_name ?t BIND(STRLEN(?t) AS ?n) BIND(SUBSTR(?t, 2, 3) AS ?s) BIND(UCASE(?t) AS ?u) BIND(LCASE(?t) AS ?l) BIND(STRSTARTS(?t, "P") AS ?a) BIND(STRENDS(?t, "5") AS ?z) BIND(CONTAINS(?t, "1") AS ?m) BIND(STRBEFORE(?t, "a") AS ?f) BIND(STRAFTER(?t, "a") AS ?g) BIND(CONCAT(?t, "-", STR(?p)) AS ?c) }',
        """SELECT p_partkey AS p, length(p_name) AS n, substr(p_name, 2, 3) AS s, upper(p_name) AS u, lower(p_name) AS l, starts_with(p_name, 'P') AS a, ends_with(p_name, '5') AS z, contains(p_name, '1') AS m,
           CASE WHEN contains(p_name, 'a') THEN substr(p_name, 1, instr(p_name, 'a') - 1) ELSE '' END AS f, CASE WHEN contains(p_name, 'a') THEN substr(p_name, instr(p_name, 'a') + 1) ELSE '' END AS g, p_name || '-' || p_partkey AS c FROM part""",
    ),
    "fn_regex_replace": (
        'SELECT ?c ?r ?i { ?c c:c_name ?n FILTER REGEX(?n, "#0+1[0-9]*$") BIND(REPLACE(?n, "0+", "0") AS ?r) BIND(REGEX(?n, "^CUSTOMER", "i") AS ?i) }',
        "SELECT 'urn:t:customer/' || c_custkey AS c, regexp_replace(c_name, '0+', '0', 'g') AS r, regexp_matches(c_name, '(?i)^CUSTOMER') AS i FROM customer WHERE regexp_matches(c_name, '#0+1[0-9]*$')",
    ),
    "fn_lang_matches": ('SELECT ?d ?m { ?d c:lang ?l FILTER langMatches(?l, "DE") BIND(langMatches(STR(LANG(STRLANG("x", "de-at"))), "de") AS ?m) }', "SELECT 'urn:t:documents/' || doc_id AS d, true AS m FROM documents WHERE lower(lang) = 'de' OR lang LIKE 'de-%'"),
    "fn_encode_uri": ("SELECT ?p ?u { ?p c:url ?x BIND(ENCODE_FOR_URI(?x) AS ?u) }", "SELECT 'urn:t:pages/' || page_id AS p, url_encode(url) AS u FROM pages"),
    "fn_numeric": (
        "SELECT ?c ?a ?r ?u ?f ?m { ?c c:c_acctbal ?b ; c:c_nationkey ?k BIND(ABS(?b) AS ?a) BIND(ROUND(?b) AS ?r) BIND(CEIL(?b) AS ?u) BIND(FLOOR(?b) AS ?f) BIND(-?k + 2 * ?k AS ?m) }",
        "SELECT 'urn:t:customer/' || c_custkey AS c, abs(c_acctbal) AS a, floor(c_acctbal + 0.5) AS r, ceil(c_acctbal) AS u, floor(c_acctbal) AS f, CAST(c_nationkey AS BIGINT) AS m FROM customer",
    ),
    "fn_datetime": (
        "SELECT ?k ?y ?m ?d ?h ?i ?s ?z { ?e c:event_id ?k ; c:ts ?t BIND(YEAR(?t) AS ?y) BIND(MONTH(?t) AS ?m) BIND(DAY(?t) AS ?d) BIND(HOURS(?t) AS ?h) BIND(MINUTES(?t) AS ?i) BIND(SECONDS(?t) AS ?s) BIND(TZ(?t) AS ?z) }",
        "SELECT event_id AS k, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS i, CAST(microsecond(ts) AS DOUBLE) / 1000000 AS s, 'Z' AS z FROM events",
    ),
    "fn_datetime_compare": (
        'SELECT ?k ?t { ?o c:o_orderkey ?k ; c:o_orderdate ?t FILTER(?t >= "1997-01-01T00:00:00Z"^^xsd:dateTime && ?t < "1997-03-01T02:00:00+02:00"^^xsd:dateTime) }',
        "SELECT o_orderkey AS k, o_orderdate AS t FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-03-01'",
    ),
    "fn_hash": (
        "SELECT ?d ?a ?b ?c { ?d c:text ?t ; c:n_chars ?n BIND(MD5(?t) AS ?a) BIND(SHA1(?t) AS ?b) BIND(SHA256(?t) AS ?c) }",
        "SELECT 'urn:t:documents/' || doc_id AS d, md5(text) AS a, sha1(text) AS b, sha256(text) AS c FROM documents",
    ),
    "fn_hash_long": ("SELECT ?n ?a ?b { ?x c:n_name ?n BIND(STRLEN(SHA384(?n)) AS ?a) BIND(STRLEN(SHA512(?n)) AS ?b) }", "SELECT n_name AS n, CAST(96 AS BIGINT) AS a, CAST(128 AS BIGINT) AS b FROM nation"),
    "fn_cast": (
        'SELECT ?c ?i ?s ?d ?b ?n { ?c c:c_acctbal ?x ; c:c_name ?m ; c:c_nationkey ?k BIND(xsd:integer(?x) AS ?i) BIND(xsd:string(?k) AS ?s) BIND(xsd:double(STR(?k)) AS ?d) BIND(xsd:boolean(?k) AS ?b) BIND(xsd:integer(?m) AS ?n) }',
        "SELECT 'urn:t:customer/' || c_custkey AS c, CAST(trunc(c_acctbal) AS BIGINT) AS i, CAST(c_nationkey AS VARCHAR) AS s, CAST(c_nationkey AS DOUBLE) AS d, c_nationkey <> 0 AS b, CAST(NULL AS BIGINT) AS n FROM customer",
    ),
    "bgp_blank_lists": (
        "SELECT ?name ?region { [ c:n_name ?name ; r:region [ c:r_name ?region ] ] }",
        "SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "fn_fresh_values": (
        """SELECT ?n ?b ?u ?s ?r ?d { ?x c:n_name ?n BIND(isBlank(BNODE()) AS ?b) BIND(REGEX(STR(UUID()), "^urn:uuid:[0-9a-f-]{36}$") AS ?u) BIND(REGEX(STRUUID(), "^[0-9a-f-]{36}$") AS ?s)
           BIND(RAND() < 1 AS ?r) BIND(DATATYPE(NOW()) = xsd:dateTime AS ?d) }""",
        "SELECT n_name AS n, true AS b, true AS u, true AS s, true AS r, true AS d FROM nation",
    ),
    "fn_timezone": (
        'SELECT ?n ?z ?t { ?x c:n_name ?n ; c:n_regionkey ?k BIND(STRDT(CONCAT("2011-01-10T14:45:13-0", STR(?k + 1), ":00"), xsd:dateTime) AS ?d) BIND(STR(TIMEZONE(?d)) AS ?z) BIND(TZ(?d) AS ?t) }',
        "SELECT n_name AS n, '-PT' || (n_regionkey + 1) || 'H' AS z, '-0' || (n_regionkey + 1) || ':00' AS t FROM nation",
    ),
    "fn_math_ext": (
        "SELECT ?k ?p ?q ?s { ?e c:event_id ?k ; c:ts ?t ; c:value ?v BIND(math:expt(?v, 2) AS ?p) BIND(math:sqrt(math:expt(?v, 2)) AS ?q) BIND(time:datetime_in_seconds(?t) AS ?s) }",
        "SELECT event_id AS k, pow(value, 2) AS p, sqrt(pow(value, 2)) AS q, CAST(epoch(date_trunc('second', ts)) AS BIGINT) + 2208988800 AS s FROM events",
    ),
    # The close-friends scenario: who was last seen near whom
    "close_friends": (
        """SELECT ?person1 ?person2 ?value1 ?value2 {
             ?event1 c:user_id ?person1 ; c:ts ?time1 ; c:value ?value1 ; c:event_type ?type1
             FILTER NOT EXISTS { ?newer1 c:user_id ?person1 ; c:ts ?later1 FILTER(?later1 > ?time1) }
             BIND(?person1 + 1 AS ?person2)
             ?event2 c:user_id ?person2 ; c:ts ?time2 ; c:value ?value2 ; c:event_type ?type2
             FILTER NOT EXISTS { ?newer2 c:user_id ?person2 ; c:ts ?later2 FILTER(?later2 > ?time2) }
             FILTER(ABS(?value2 - ?value1) < 50)
             FILTER NOT EXISTS { ?same c:user_id ?person1 ; c:event_type ?type2 ; c:value ?seen FILTER(?seen > 900) } }""",
        """WITH last AS (SELECT * FROM events e WHERE ts = (SELECT max(ts) FROM events x WHERE x.user_id = e.user_id))
           SELECT a.user_id AS person1, b.user_id AS person2, a.value AS value1, b.value AS value2 FROM last a JOIN last b ON b.user_id = a.user_id + 1 WHERE abs(b.value - a.value) < 50
           AND NOT EXISTS (SELECT 1 FROM events s WHERE s.user_id = a.user_id AND s.event_type = b.event_type AND s.value > 900)""",
    ),
}

#: Over events in the named graphs of their types.
GRAPHS: dict[str, tuple[str, str]] = {
    "graph_named": ("SELECT ?e ?v { GRAPH <urn:g:purchase> { ?e c:value ?v } }", "SELECT 'urn:t:events/' || event_id AS e, value AS v FROM events WHERE event_type = 'purchase'"),
    "graph_var": ("SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?e c:user_id ?u } } GROUP BY ?g", "SELECT 'urn:g:' || event_type AS g, count(*) AS n FROM events GROUP BY event_type"),
    "graph_default": ("SELECT ?e ?n { { ?e c:user_id ?u } UNION { ?e c:r_name ?n } }", "SELECT 'urn:t:region/' || r_regionkey AS e, r_name AS n FROM region"),
    "graph_join": ("SELECT ?u ?a ?b { GRAPH <urn:g:signup> { ?x c:user_id ?u ; c:event_id ?a } GRAPH <urn:g:purchase> { ?y c:user_id ?u ; c:event_id ?b } }", "SELECT a.user_id AS u, a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id WHERE a.event_type = 'signup' AND b.event_type = 'purchase'"),
    "from_named": ("SELECT ?g (COUNT(*) AS ?n) FROM <urn:g:click> FROM NAMED <urn:g:view> { { GRAPH ?g { ?e c:user_id ?u } } UNION { ?e c:user_id ?u } } GROUP BY ?g", "SELECT CASE WHEN event_type = 'view' THEN 'urn:g:view' END AS g, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1"),
}


@lru_cache(maxsize=64)
def _source(spark: SparkSession, application: str, sf_dir: str, names: tuple[str, ...] | None, graphs: bool) -> VirtualSource:
    """Tables are registered once for each session: reading their footers costs more than planning."""
    return register(spark, sf_dir, list(names) if names else None, {"events": "event_type"} if graphs else None)


def dataset(spark: SparkSession, sf_dir: str, names: list[str] | None = None, graphs: bool = False) -> Dataset:
    names = ["events", "region"] if graphs else names
    return Dataset(_source(spark, spark.sparkContext.applicationId, sf_dir, tuple(names) if names else None, graphs), prefixes=PREFIXES)


_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages"]


def _sparql(text: str, graphs: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: dataset(spark, sf_dir, _TABLES, graphs).query(text)


def nation_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = dataset(spark, sf_dir, ["nation"]).query("CONSTRUCT { ?n c:n_name ?name ; r:region ?r } WHERE { ?n c:n_name ?name ; r:region ?r }")
    return materialize(made, "nation")


_NATIONS = "(SELECT 'urn:t:nation/' || n_nationkey AS s, 'urn:c:n_name' AS p, n_name AS o, n_regionkey AS k FROM nation UNION ALL SELECT 'urn:t:nation/' || n_nationkey, 'urn:r:region', 'urn:t:region/' || n_regionkey, n_regionkey FROM nation)"


def construct_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = 'CONSTRUCT { ?c x:lives ?n ; x:segment ?s . GRAPH x:g { ?n x:has ?c } } WHERE { ?c r:nation ?n ; c:c_mktsegment ?s ; c:c_acctbal ?b FILTER(?b > 5000) }'
    return quad_text(dataset(spark, sf_dir, _TABLES).query(q))


def describe_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quad_text(dataset(spark, sf_dir, ["customer", "nation"]).query("DESCRIBE ?c { ?c r:nation t:nation\\/3 }"))


def _updated(script: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return quad_text(run_sequential(nation_quads(spark, sf_dir), parse(script, prefixes=PREFIXES)))

    return run


def roundtrip_ntriples(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "nquads")
    ntriples.write_statements(nation_quads(spark, sf_dir), path)
    return quad_text(ntriples.read_statements(spark, path))


def roundtrip_turtle(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "turtle")
    turtle.write_turtle(nation_quads(spark, sf_dir), path, {"c": "urn:c:", "r": "urn:r:", "n": "urn:t:nation/"})
    return quad_text(turtle.read_turtle(spark, path))


def graph_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' names in the default graph, their regions in a named one."""
    made = dataset(spark, sf_dir, ["nation"]).query("CONSTRUCT { ?n c:n_name ?name . GRAPH x:regions { ?n r:region ?r } } WHERE { ?n c:n_name ?name ; r:region ?r }")
    return materialize(made, "nation")


def roundtrip_nquads(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "nquads")
    ntriples.write_statements(graph_quads(spark, sf_dir), path)
    return quad_text(ntriples.read_statements(spark, path))


def roundtrip_trig(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "trig")
    turtle.write_turtle(graph_quads(spark, sf_dir), path, {"c": "urn:c:", "x": "urn:x:"})
    return quad_text(turtle.read_turtle(spark, path))


def _over_quads(construct: str, query: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query over the quads that ``construct`` makes of the nations."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = materialize(dataset(spark, sf_dir, ["nation"]).query(construct), "nation")
        return Dataset(QuadSource(made), prefixes=PREFIXES).query(query)

    return run


def quads_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free RDF: the chain join and an aggregate over a quad table."""
    d = Dataset(QuadSource(nation_quads(spark, sf_dir)), prefixes=PREFIXES)
    return d.query("SELECT ?r (COUNT(*) AS ?n) (MIN(?name) AS ?first) { ?x r:region ?r ; c:n_name ?name } GROUP BY ?r").withColumn("n", F.col("n").cast("bigint"))


def service_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dataset(spark, sf_dir, ["customer"])
    d.services["urn:s:nations"] = register(spark, sf_dir, ["nation"])
    return d.query("SELECT ?c ?name { ?c r:nation ?n SERVICE <urn:s:nations> { ?n c:n_name ?name } }")


def event_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a block of quads."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    s = t.to_term(t.Val("iri", F.concat(F.lit("urn:t:events/"), F.col("event_id").cast("string"))))
    pairs = [("urn:r:user", t.Val("iri", F.concat(F.lit("urn:t:customer/"), F.col("user_id").cast("string")))), ("urn:c:value", t.Val("double", F.col("value"))), ("urn:c:event_type", t.Val("string", F.col("event_type")))]
    po = F.explode(F.array(*(F.struct(t.to_term(t.Val("iri", F.lit(p))).alias("p"), t.to_term(v).alias("o")) for p, v in pairs))).alias("po")
    return e.select(s.alias("s"), po, F.col("event_id").alias("block_id")).select("s", "po.p", "po.o", F.lit(None).cast(t.TERM).alias("g"), "block_id")


def event_mode_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = dataset(spark, sf_dir, ["customer"]).query("CONSTRUCT { ?c c:c_mktsegment ?s } WHERE { ?c c:c_mktsegment ?s }")
    query = parse('SELECT ?e ?s { ?e r:user ?c ; c:event_type "purchase" . ?c c:c_mktsegment ?s }', prefixes=PREFIXES)[0]
    found = event_matches(event_quads(spark, sf_dir), stored, query)
    return found.select("block_id", F.col("e.lex").alias("e"), F.col("s.lex").alias("s"))


RUNNING_SUM = """DELETE { GRAPH x:memory { ?u x:sum ?old } } INSERT { GRAPH x:memory { ?u x:sum ?new } }
WHERE { ?e c:user_id ?u ; c:value ?v . GRAPH x:memory { ?u x:sum ?old } BIND(?old + ?v AS ?new) }"""
MAX_SO_FAR = """DELETE { ?u x:max ?old } INSERT { ?u x:max ?v }
WHERE { ?e c:user_id ?u ; c:value ?v . ?u x:max ?old FILTER(?v > ?old) }"""


def _accumulated(rule_text: str, out: str) -> Callable[[SparkSession, str], DataFrame]:
    """A stateful rule run over all events in the order of time."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rule = accumulator_of(parse(rule_text, prefixes=PREFIXES)[0])
        compiler = dataset(spark, sf_dir, ["events"]).compiler()
        r = compiler.group(A.Group((*rule.pattern.elements, A.Bgp((A.Triple(A.Var("e"), A.Iri("urn:c:ts"), A.Var("ts")), A.Triple(A.Var("e"), A.Iri("urn:c:event_id"), A.Var("id")))))))
        value = compiler.expr(rule.value, r.val)
        rows = r.df.select(r.val("id").col.alias("event_id"), r.val(rule.subject.name).col.alias("user_id"), r.val("ts").col.alias("ts"), value.col.alias("v"))
        return running(rows, "user_id", ["ts", "event_id"], "v", rule.kind, out).select("event_id", "user_id", (F.floor(F.col(out) * 100 + 0.5) / 100).alias(out))

    return run


def rules_reachability_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules to fixpoint: which later turns each turn of a conversation leads to."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn").distinct()
    node = lambda turn: t.to_term(t.Val("iri", F.concat(F.lit("urn:t:conversations/"), F.col("conv_id").cast("string"), F.lit("/"), turn.cast("string"))))
    nxt = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"], "left_semi")
    quads = nxt.select(node(F.col("turn")).alias("s"), t.to_term(t.Val("iri", F.lit("urn:x:next"))).alias("p"), node(F.col("turn") + 1).alias("o"), F.lit(None).cast(t.TERM).alias("g"))
    engine = RuleEngine(spark, policy="repeat-snapshot")
    engine.add_rules(parse("INSERT { ?a x:reaches ?b } WHERE { ?a x:next ?b } ; INSERT { ?a x:reaches ?c } WHERE { ?a x:next ?b . ?b x:reaches ?c }", prefixes=PREFIXES))
    engine.process(quads)
    found = engine.quads.where(F.col("p")["lex"] == "urn:x:reaches")
    return found.select(F.col("s")["lex"].alias("a"), F.col("o")["lex"].alias("b"))


def window_avg_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages of tumbling windows, as soon as a newer window has begun."""
    q = """SELECT ?w ?n ?total { { SELECT ?w (COUNT(*) AS ?n) (SUM(?u) AS ?total) { ?e c:event_id ?k ; c:user_id ?u } GROUP BY (FLOOR(?k / 100) AS ?w) }
           FILTER EXISTS { ?f c:event_id ?newer FILTER(FLOOR(?newer / 100) = ?w + 1) } }"""
    return dataset(spark, sf_dir, ["events"]).query(q)


def incremental_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view kept by signed deltas while events come and go."""
    quads = event_quads(spark, sf_dir).withColumn("event_id", F.col("block_id"))
    base, more = quads.where("event_id % 3 <> 0").select(*"spog"), quads.where("event_id % 3 = 0").select(*"spog")
    gone = quads.where("event_id % 5 = 0").select(*"spog")
    query = parse('SELECT ?u ?v { ?e r:user ?u ; c:value ?v ; c:event_type "error" }', prefixes=PREFIXES)[0]
    view = IncrementalView(query, materialize(base, "base"))
    view.change(gone.limit(0), more)
    view.change(gone, gone.limit(0))
    return view.rows().select(F.col("u.lex").alias("u"), F.col("v.lex").cast("double").alias("v"))


def shaped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of mixed types compared, added and sorted at run time."""
    quads = nation_quads(spark, sf_dir).union(dataset(spark, sf_dir, ["nation"]).query("CONSTRUCT { ?n x:v ?k ; x:v ?d ; x:v ?name } WHERE { ?n c:n_nationkey ?k ; c:n_name ?name BIND(?k + 0.5 AS ?d) }"))
    d = Dataset(QuadSource(quads), prefixes=PREFIXES)
    return d.query("SELECT ?n (COUNT(?v) AS ?all) (SUM(?v) AS ?total) (MAX(?v) AS ?top) { ?n x:v ?v } GROUP BY ?n").select("n", F.col("all"), F.col("total").cast("double").alias("total"), "top")


OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "construct_triples": (construct_triples, "WITH c AS (SELECT 'urn:t:customer/' || c_custkey AS c, 'urn:t:nation/' || c_nationkey AS n, c_mktsegment AS m FROM customer WHERE c_acctbal > 5000) SELECT c AS s, 'urn:x:lives' AS p, n AS o, CAST(NULL AS VARCHAR) AS g FROM c UNION ALL SELECT c, 'urn:x:segment', m, NULL FROM c UNION ALL SELECT n, 'urn:x:has', c, 'urn:x:g' FROM c"),
    "describe_customer": (describe_customer, f"""SELECT 'urn:t:customer/' || c_custkey AS s, u.p, u.o, CAST(NULL AS VARCHAR) AS g FROM customer, LATERAL (VALUES ('{_TYPE}', 'urn:t:Customer'), ('urn:c:c_custkey', CAST(c_custkey AS VARCHAR)), ('urn:c:c_name', c_name),
        ('urn:c:c_nationkey', CAST(c_nationkey AS VARCHAR)), ('urn:c:c_acctbal', CAST(c_acctbal AS VARCHAR)), ('urn:c:c_mktsegment', c_mktsegment), ('urn:r:nation', 'urn:t:nation/' || c_nationkey)) u(p, o) WHERE c_nationkey = 3"""),
    "update_insert_data": (_updated('INSERT DATA { x:a x:b 1 , "two" . GRAPH x:g { x:a x:b x:c } } ; DELETE DATA { x:a x:b 1 . t:nation\\/0 c:n_name "NATION_0" }'), f"SELECT s, p, o, CAST(NULL AS VARCHAR) AS g FROM {_NATIONS} WHERE NOT (s = 'urn:t:nation/0' AND o = 'NATION_0') UNION ALL VALUES ('urn:x:a', 'urn:x:b', 'two', NULL), ('urn:x:a', 'urn:x:b', 'urn:x:c', 'urn:x:g')"),
    "update_delete_where": (_updated("DELETE WHERE { ?n r:region t:region\\/2 ; c:n_name ?name }"), f"SELECT s, p, o, CAST(NULL AS VARCHAR) AS g FROM {_NATIONS} WHERE k <> 2"),
    "update_modify": (_updated("DELETE { ?n r:region ?r } INSERT { ?r x:has ?n . GRAPH x:moved { ?n x:was ?r } } WHERE { ?n r:region ?r FILTER(?r != t:region\\/1) }"), f"SELECT s, p, o, CAST(NULL AS VARCHAR) AS g FROM {_NATIONS} WHERE p = 'urn:c:n_name' OR k = 1 UNION ALL SELECT o, 'urn:x:has', s, NULL FROM {_NATIONS} WHERE p = 'urn:r:region' AND k <> 1 UNION ALL SELECT s, 'urn:x:was', o, 'urn:x:moved' FROM {_NATIONS} WHERE p = 'urn:r:region' AND k <> 1"),
    "update_with_using": (_updated("COPY DEFAULT TO x:a ; WITH x:a DELETE { ?n c:n_name ?name } INSERT { ?n x:label ?name } WHERE { ?n c:n_name ?name } ; INSERT { ?n x:again ?l } USING x:a WHERE { ?n x:label ?l }"), f"SELECT s, p, o, CAST(NULL AS VARCHAR) AS g FROM {_NATIONS} UNION ALL SELECT s, CASE WHEN p = 'urn:c:n_name' THEN 'urn:x:label' ELSE p END, o, 'urn:x:a' FROM {_NATIONS} UNION ALL SELECT s, 'urn:x:again', o, NULL FROM {_NATIONS} WHERE p = 'urn:c:n_name'"),
    "graph_clear_copy_move": (_updated("COPY DEFAULT TO x:a ; ADD x:a TO x:b ; MOVE x:b TO x:c ; CREATE GRAPH x:d ; CLEAR DEFAULT ; DROP SILENT GRAPH x:a ; ADD x:c TO DEFAULT"), f"SELECT s, p, o, CAST(NULL AS VARCHAR) AS g FROM {_NATIONS} UNION ALL SELECT s, p, o, 'urn:x:c' FROM {_NATIONS}"),
    "roundtrip_ntriples": (roundtrip_ntriples, f"SELECT s, p, o, CAST(NULL AS VARCHAR) AS g FROM {_NATIONS}"),
    "roundtrip_turtle": (roundtrip_turtle, f"SELECT s, p, o, CAST(NULL AS VARCHAR) AS g FROM {_NATIONS}"),
    "roundtrip_nquads": (roundtrip_nquads, f"SELECT s, p, o, CASE WHEN p = 'urn:r:region' THEN 'urn:x:regions' END AS g FROM {_NATIONS}"),
    "roundtrip_trig": (roundtrip_trig, f"SELECT s, p, o, CASE WHEN p = 'urn:r:region' THEN 'urn:x:regions' END AS g FROM {_NATIONS}"),
    "quads_terms_join": (  # 1 joins 1, not 1.0
        _over_quads("CONSTRUCT { ?n x:i ?k ; x:i ?e ; x:j ?k } WHERE { ?n c:n_nationkey ?k BIND(?k + 0.0 AS ?e) }", "SELECT ?n ?m { ?n x:i ?v . ?m x:j ?v }"),
        "SELECT 'urn:t:nation/' || n_nationkey AS n, 'urn:t:nation/' || n_nationkey AS m FROM nation",
    ),
    "quads_exact_sums": (
        _over_quads("CONSTRUCT { ?n r:region ?r ; x:big ?w ; x:cent ?d } WHERE { ?n r:region ?r ; c:n_nationkey ?k BIND(?k + 9007199254740993 AS ?w) BIND(0.1 AS ?d) }", "SELECT ?r (STR(SUM(?w)) AS ?whole) (STR(SUM(?d)) AS ?cents) { ?n r:region ?r ; x:big ?w ; x:cent ?d } GROUP BY ?r"),
        "SELECT 'urn:t:region/' || n_regionkey AS r, CAST(sum(CAST(9007199254740993 AS HUGEINT) + n_nationkey) AS VARCHAR) AS whole, CAST(sum(CAST(0.1 AS DECIMAL(18, 1))) AS VARCHAR) AS cents FROM nation GROUP BY n_regionkey",
    ),
    "quads_join": (quads_join, "SELECT 'urn:t:region/' || n_regionkey AS r, count(*) AS n, min(n_name) AS first FROM nation GROUP BY n_regionkey"),
    "quads_mixed_types": (shaped_values, "SELECT 'urn:t:nation/' || n_nationkey AS n, CAST(3 AS BIGINT) AS all, 2 * n_nationkey + CAST(0.5 AS DOUBLE) AS total, n_name AS top FROM nation"),
    "service_join": (service_join, "SELECT 'urn:t:customer/' || c_custkey AS c, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "event_mode_match": (event_mode_match, "SELECT event_id AS block_id, 'urn:t:events/' || event_id AS e, c_mktsegment AS s FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase'"),
    "rules_running_sum": (_accumulated(RUNNING_SUM, "sum"), "SELECT event_id, user_id, floor(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) * 100 + 0.5) / 100 AS sum FROM events"),
    "rules_max_so_far": (_accumulated(MAX_SO_FAR, "max"), "SELECT event_id, user_id, floor(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) * 100 + 0.5) / 100 AS max FROM events"),
    "rules_reachability_fixpoint": (rules_reachability_fixpoint, """WITH RECURSIVE c AS (SELECT DISTINCT conv_id, turn FROM conversations), r(conv_id, a, b) AS (SELECT x.conv_id, x.turn, y.turn FROM c x JOIN c y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1
        UNION ALL SELECT r.conv_id, r.a, y.turn FROM r JOIN c y ON r.conv_id = y.conv_id AND y.turn = r.b + 1) SELECT 'urn:t:conversations/' || conv_id || '/' || a AS a, 'urn:t:conversations/' || conv_id || '/' || b AS b FROM r"""),
    "window_avg_closed": (window_avg_closed, "WITH w AS (SELECT floor(event_id / 100.0::DOUBLE) AS w, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS total FROM events GROUP BY 1) SELECT w, n, total FROM w WHERE w + 1 IN (SELECT w FROM w)"),
    "incremental_equals_batch": (incremental_equals_batch, "SELECT 'urn:t:customer/' || user_id AS u, value AS v FROM events WHERE event_type = 'error' AND event_id % 5 <> 0"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _sparql(q) for k, (q, _) in SPARQL.items()} | {k: _sparql(q, True) for k, (q, _) in GRAPHS.items()} | {k: f for k, (f, _) in OTHERS.items()}
ORACLE_SQL: dict[str, str] = {k: sql for group in (SPARQL, GRAPHS, OTHERS) for k, (_, sql) in group.items()}


