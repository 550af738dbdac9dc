"""More registered graph queries: risks by register depth, impact of signals, two versions of a graph, random variables, protocols and
deadlocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..operators import diff, impact, machines, paths, protocol, randomize, reports, search, stats, timing, traverse
from ..sources import tables
from .catalog import DIFF, G, REACH, big, graph_query, starts, table_query, versions
from .reports import wide
from .walks import ALL, STEP, TOP_PATHS, VISITS, all_depths

# Risks by register depth

RISK = VISITS.format(touching=ALL) + """,
scored AS (SELECT v.id, v.kind, coalesce(d.depth, 0) AS depth, coalesce(d.depth, 0) * 10 + 15 * (v.kind = 'REG')::INT AS score FROM v LEFT JOIN deep d USING (id)),
risk AS (
  SELECT id, kind, CAST(depth AS BIGINT) AS depth, CAST(score AS BIGINT) AS score,
         CASE WHEN score >= 60 THEN 'CRITICAL' WHEN score >= 40 THEN 'HIGH' WHEN score >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS risk
  FROM scored)
"""
graph_query("timing_risk", RISK + "SELECT * FROM risk")(lambda g: timing.vertex_risk(g, all_depths(g)))
graph_query("critical_paths", RISK + "SELECT * FROM risk ORDER BY score DESC, id LIMIT 25")(
    lambda g: timing.vertex_risk(g, all_depths(g)).orderBy(F.desc("score"), "id").limit(25))

head, body = TOP_PATHS.format(combinational=STEP).split("\nSELECT", 1)
TOP_TEN = VISITS.format(touching=ALL) + head + ",\ntop_ten AS (SELECT" + body.replace("r <= 5", "r <= 10") + ")\n"


def ten_paths(g: PropertyGraph) -> DataFrame:
    return g.kept("ten register paths", lambda: timing.register_paths(g, all_depths(g), 10))


graph_query("timing_report", TOP_TEN + """
SELECT count(*) AS paths, coalesce(max(cycles), 0) AS max_cycles, CAST(coalesce(floor(sum(cycles) * 10 / count(*) + 0.5), 0) AS BIGINT) AS avg_tenths,
       count(*) FILTER (risk = 'CRITICAL') AS critical, count(*) FILTER (risk = 'HIGH') AS high, count(*) FILTER (risk = 'MEDIUM') AS medium, count(*) FILTER (risk = 'LOW') AS low
FROM top_ten
""")(lambda g: timing.report(ten_paths(g)))
graph_query("risk_ranking", TOP_TEN + """
SELECT * FROM (SELECT row_number() OVER (ORDER BY violation <> 'HIGH', score DESC, depth DESC, target) AS rank, target, score, depth, risk, violation FROM top_ten) WHERE rank <= 5
""")(lambda g: timing.risk_ranking(ten_paths(g)))


def supplier_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property for each supplier over the numbers of its parts, which other vertices may have too."""
    line = tables.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_set(F.col("l_partkey").cast("string")).alias("signals"))
    s = tables.table(spark, sf_dir, "supplier").join(line, F.col("s_suppkey") == F.col("l_suppkey"))
    return s.select(F.concat(F.lit("P"), "s_suppkey").alias("property"), F.when(F.col("s_acctbal") > 0, F.array(F.lit("##1"), F.lit("|=>"))).otherwise(F.array(F.lit("|->"))).alias("operators"), "signals")


@table_query("property_depths", G + VISITS.format(touching=ALL) + """,
named AS (SELECT split_part(id, '.', 2) AS signal, min(id) AS id FROM v GROUP BY 1),
want AS (SELECT DISTINCT s_suppkey, s_acctbal > 0 AS later, CAST(l_partkey AS VARCHAR) AS signal FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
SELECT 'P' || s_suppkey AS property, CASE WHEN later THEN '|=>' ELSE '|->' END AS operator, later::BIGINT AS declared, signal, n.id, CAST(coalesce(depth, 0) AS BIGINT) AS depth
FROM want JOIN named n USING (signal) LEFT JOIN deep d ON d.id = n.id
""")
def property_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.trade(spark, sf_dir)
    return timing.declared_depths(g, supplier_properties(spark, sf_dir), all_depths(g))


# Impact: customers' loads three levels down, large parts being asserted and finished orders covered.

IMPACT = REACH.format(root="src", to="dst", at="src", start="src LIKE 'c.%'", depth=3).replace("SELECT root, id, CAST(min(level)", ", near AS (SELECT root, id, CAST(min(level)") + """),
drives AS (SELECT src AS id, count(*) AS fanout FROM top WHERE kind = 'DRIVER' GROUP BY src),
seen AS (SELECT 'p.' || p_partkey AS id, true AS has_sva, false AS has_cov FROM part WHERE p_size > 25 UNION ALL SELECT 'o.' || o_orderkey, false, true FROM orders WHERE o_orderstatus = 'F'),
x AS (
  SELECT root, n.id, level, coalesce(fanout, 0) AS fanout, coalesce(t.condition, '') AS condition, coalesce(t.clock_domain, '') AS clock_domain, coalesce(has_sva, false) AS has_sva, coalesce(has_cov, false) AS has_cov
  FROM near n LEFT JOIN drives d ON d.id = n.id LEFT JOIN seen s ON s.id = n.id LEFT JOIN top t ON t.src = n.root AND t.dst = n.id),
y AS (
  SELECT *, CAST(10 + 2 * fanout + (CASE WHEN has_sva OR has_cov THEN 0 ELSE 20 END) + (CASE WHEN fanout > 10 THEN 15 WHEN fanout > 5 THEN 10 ELSE 0 END)
         + (CASE WHEN condition <> '' THEN 10 ELSE 0 END) AS BIGINT) AS score FROM x),
z AS (SELECT *, CASE WHEN score >= 30 THEN 'HIGH' WHEN score >= 18 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM y)
"""


def customer_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.trade(spark, sf_dir)
    parts = tables.table(spark, sf_dir, "part").where("p_size > 25").select(F.concat(F.lit("p."), "p_partkey").alias("id"), F.lit(True).alias("has_sva"), F.lit(False).alias("has_cov"))
    orders = tables.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("o."), "o_orderkey"), F.lit(False), F.lit(True))
    return impact.paths(g, traverse.fan_out(g, starts(g, "id like 'c.%'"), 3), parts.union(orders))


table_query("impact_paths", G + IMPACT + """
SELECT root, id, level, CASE WHEN condition <> '' THEN 'conditional' ELSE 'combinational' END AS path_type, fanout, condition, clock_domain, has_sva, has_cov, score, risk,
       concat_ws('; ', CASE WHEN risk = 'HIGH' AND NOT has_sva AND NOT has_cov THEN 'cover this path' END, CASE WHEN risk = 'HIGH' AND fanout > 10 THEN 'buffer a fan-out of ' || fanout END) AS advice
FROM z
""")(customer_impact)
table_query("impact_summary", G + IMPACT + """
SELECT root, count(*) AS n_paths, count(*) FILTER (risk = 'HIGH') AS high, count(*) FILTER (risk = 'MEDIUM') AS medium, count(*) FILTER (risk = 'LOW') AS low,
       count(*) FILTER (NOT has_sva AND NOT has_cov) AS n_uncovered, max(score) AS max_score, count(DISTINCT split_part(id, '.', 1)) AS n_modules
FROM z GROUP BY root
""")(lambda spark, sf_dir: impact.summary(customer_impact(spark, sf_dir)))


# Two versions

FROM_CHANGED = """,
{n}k AS (SELECT DISTINCT src, dst FROM e WHERE kind IN ('DRIVER', 'CONNECTION') AND {edges}),
{n}w AS (SELECT dst AS id, 1 AS level FROM {n}k WHERE src IN (SELECT id FROM nd) AND src IN (SELECT id FROM {v}) UNION SELECT k.dst, level + 1 FROM {n}w w JOIN {n}k k ON k.src = w.id),
{n}r AS (SELECT id, min(level) AS level FROM {n}w GROUP BY id)
"""
OLD = FROM_CHANGED.format(n="a", v="v1", edges="src NOT IN (SELECT 'o.' || o_orderkey FROM orders WHERE o_orderstatus = 'P')")
NEW = FROM_CHANGED.format(n="b", v="v2", edges="NOT (kind = 'CONNECTION' AND dst LIKE 's.%')")

graph_query("compare_versions", DIFF + OLD + NEW + """,
n AS (
  SELECT (SELECT count(*) FROM v1) AS nodes_old, (SELECT count(*) FROM v2) AS nodes_new, (SELECT count(*) FROM nd WHERE change = 'added') AS added, (SELECT count(*) FROM nd WHERE change = 'removed') AS removed,
         (SELECT count(*) FROM nd WHERE change = 'modified') AS modified, (SELECT count(*) FROM ch2) AS pairs_added, (SELECT count(*) FROM ch) AS pairs_removed, (SELECT count(*) FROM core) AS stable,
         (SELECT count(*) FROM br WHERE id NOT IN (SELECT id FROM ar)) AS newly, (SELECT count(*) FROM ar WHERE id NOT IN (SELECT id FROM br)) AS no_longer, (SELECT count(*) FROM ar JOIN br USING (id)) AS still,
         (SELECT CASE WHEN (SELECT count(*) FROM nd JOIN v1 USING (id)) > 0 THEN coalesce(max(level), 0) + 1 ELSE 0 END FROM ar) AS depth_old,
         (SELECT CASE WHEN (SELECT count(*) FROM nd JOIN v2 USING (id)) > 0 THEN coalesce(max(level), 0) + 1 ELSE 0 END FROM br) AS depth_new),
h AS (SELECT *, CAST(round(stable * 10000 / nodes_old) AS BIGINT) AS health_old, CAST(round(stable * 10000 / nodes_new) AS BIGINT) AS health_new, greatest(nodes_old, nodes_new) AS larger FROM n)
SELECT nodes_old, nodes_new, added, removed, modified, pairs_added, pairs_removed, added + removed + modified + pairs_added + pairs_removed = 0 AS identical, stable, health_old, health_new, health_new - health_old AS health_delta,
       CAST(round((larger - stable) * 10000 / larger) AS BIGINT) AS unstable,
       CASE WHEN added + removed + modified < 0.05 * larger AND larger - stable > 0.5 * larger THEN 'critical' WHEN added + removed + modified < 0.05 * larger AND larger - stable > 0.3 * larger THEN 'high' ELSE 'low' END AS coupling,
       newly, no_longer, still, CAST(depth_old AS BIGINT) AS depth_old, CAST(depth_new AS BIGINT) AS depth_new
FROM h
""")(lambda g: diff.compare(*versions(g)))


# Random variables: brands are classes with a variable for each size, suppliers make calls, customers refer, nations cover.

@table_query("random_reachability", """
WITH v AS (SELECT DISTINCT p_brand AS class, 'v' || p_size AS name, CASE WHEN p_size < 20 THEN 'rand' ELSE 'randc' END AS kind FROM part),
c AS (SELECT s_nationkey < 12 AS named, 'v' || s_nationkey || ' > xv' || (s_suppkey % 60) || '_q' AS inline FROM supplier),
r AS (SELECT 'v' || (c_nationkey * 3) AS name, count(*) AS n FROM customer WHERE c_acctbal >= 0 GROUP BY 1),
p AS (SELECT 'v' || (n_nationkey + n_regionkey) AS name, count(*) AS n FROM nation GROUP BY 1),
k AS (SELECT name, count(*) AS n FROM (SELECT DISTINCT name FROM v) x JOIN c ON c.named AND contains(c.inline, x.name) GROUP BY name)
SELECT class, name, kind, CASE WHEN r.n IS NULL AND p.n IS NULL THEN 'dead' ELSE 'alive' END AS status, coalesce(k.n, 0) + (SELECT count(*) FROM c WHERE NOT named) AS randomized, coalesce(r.n, 0) AS consumed, coalesce(p.n, 0) AS covered
FROM v LEFT JOIN r USING (name) LEFT JOIN p USING (name) LEFT JOIN k USING (name)
""")
def random_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: tables.table(spark, sf_dir, n)
    v = t("part").select(F.col("p_brand").alias("class"), F.concat(F.lit("v"), "p_size").alias("name"), F.when(F.col("p_size") < 20, "rand").otherwise("randc").alias("kind"))
    inline = F.concat(F.lit("v"), "s_nationkey", F.lit(" > xv"), F.col("s_suppkey") % 60, F.lit("_q"))
    calls = t("supplier").select(F.when(F.col("s_nationkey") < 12, randomize.WITH).otherwise("randomize").alias("kind"), F.when(F.col("s_nationkey") < 12, inline).alias("inline"))
    references = t("customer").select(F.concat(F.lit("v"), F.col("c_nationkey") * 3).alias("name"), F.when(F.col("c_acctbal") < 0, "decl").otherwise("assign").alias("kind"))
    points = t("nation").select(F.col("n_name").alias("covergroup"), F.concat(F.lit("v"), F.col("n_nationkey") + F.col("n_regionkey")).alias("signal"))
    return randomize.reachability(v, calls, references, points)


# Protocols: types of parts are modules, sizes their signals; `simple` has one channel of axi's.

SIGNALS = (("m_axi_awvalid", 1, "output", "register"), ("m_axi_awready", 1, "input", "wire"), ("m_axi_awaddr", 32, "output", ""), ("m_axi_wvalid", 1, "output", "register"), ("m_axi_wready", 1, "input", ""),
           ("m_axi_wdata", 64, "output", ""), ("m_axi_wlast", 1, "output", ""), ("m_axi_bresp", 2, "input", ""), ("clk", 1, "input", ""))
CHANNELS = [("axi", "AW", "awvalid", True), ("axi", "AW", "awready", True), ("axi", "AW", "awaddr", True), ("axi", "W", "wvalid", True), ("axi", "W", "wready", True), ("axi", "W", "wdata", True),
            ("axi", "W", "wlast", False), ("axi", "B", "bresp", False), ("simple", "W", "wvalid", True), ("simple", "W", "wready", True)]
SIGNAL_ROLES = [("axi", "awvalid", "valid"), ("axi", "awready", "ready"), ("axi", "awaddr", "addr"), ("axi", "wvalid", "valid"), ("axi", "wready", "valid")]
VARIANTS = [("axi", "lite", ["awaddr"], ["wlast"]), ("axi", "full", ["awaddr", "wlast"], []), ("axi", "any", [], [])]
OVERRIDES = [("axi", "lite", "W", ["awaddr"], 50, 40)]


def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_size") % len(SIGNALS)
    cells = [F.element_at(F.array(*[F.lit(s[i]) for s in SIGNALS]), (kind + 1).cast("int")).alias(n) for i, n in enumerate(("name", "width", "direction", "driver_kind"))]
    signals = tables.table(spark, sf_dir, "part").select(F.col("p_type").alias("module"), *cells).distinct()
    frame = spark.createDataFrame
    return protocol.score(
        signals, frame(CHANNELS, "protocol string, channel string, signal string, required boolean"), frame(SIGNAL_ROLES, "protocol string, signal string, role string"),
        frame(VARIANTS, "protocol string, variant string, needs array<string>, absent array<string>"),
        frame(OVERRIDES, "protocol string, variant string, channel string, needs array<string>, name_score int, pattern_score int"))


CONFIDENCE = """
WITH m AS (
  SELECT p_type AS module, max((p_size % 9 = 0)::INT) AS av, max((p_size % 9 = 1)::INT) AS ar, max((p_size % 9 = 2)::INT) AS aa, max((p_size % 9 = 3)::INT) AS wv, max((p_size % 9 = 4)::INT) AS wr,
         max((p_size % 9 = 5)::INT) AS wd, max((p_size % 9 = 6)::INT) AS wl, max((p_size % 9 = 7)::INT) AS b FROM part GROUP BY p_type),
f AS (
  SELECT *, av * ar AS group_a, wv * wr AS group_w, CASE WHEN aa = 1 AND wl = 0 THEN 'lite' WHEN aa = 1 THEN 'full' ELSE 'any' END AS variant,
         av * greatest(ar, wr) AS pair_a, wv * greatest(ar, wr) AS pair_w, CASE WHEN ar = 1 THEN 1.0 ELSE 0.4 END AS worth_a, CASE WHEN wr = 1 THEN 1.0 ELSE 0.4 END AS worth_w FROM m),
s AS (
  SELECT module, 'axi' AS protocol, variant, ((av + ar + aa) / 3.0 + greatest((wv + wr + wd) / 3.0, CASE WHEN variant = 'lite' THEN 0.5 ELSE 0 END) + b) / 3.0 AS name,
         ((av + ar + aa) / 3.0 + (wv + 0.3 * wr + 0.5 * wd) / 3.0 + 1) / 3.0 AS structural,
         (group_a * (2 + aa) / 3.0 + greatest(group_w * (2 + wd) / 3.0, CASE WHEN variant = 'lite' THEN 0.4 ELSE 0 END) + CASE WHEN group_a + group_w > 0 THEN 0.8 ELSE 0 END) / 3.0 AS pattern, f.*
  FROM f WHERE av + ar + aa + wv + wr + wd + wl + b > 0
  UNION ALL SELECT module, 'simple', NULL, (wv + wr) / 2.0, (wv + wr) / 4.0, group_w, f.* FROM f WHERE wv + wr > 0),
h AS (SELECT *, CASE WHEN pair_a + pair_w > 0 THEN (pair_a * worth_a + pair_w * worth_w) / (pair_a + pair_w) ELSE 0 END AS handshake FROM s),
c AS (
  SELECT module, protocol, variant, CAST(floor(name * 1000 + 1e-6) AS BIGINT) AS name, CAST(floor(structural * 1000 + 1e-6) AS BIGINT) AS structural, CAST(floor(pattern * 1000 + 1e-6) AS BIGINT) AS pattern,
         CAST(floor(handshake * 1000 + 1e-6) AS BIGINT) AS handshake,
         CAST(CASE WHEN name < 0.2 THEN 0 ELSE floor((name * 30 + structural * 30 + pattern * 25 + handshake * 15) * 10 + 1e-6) END AS BIGINT) AS confidence FROM h)
"""
table_query("protocol_confidence", CONFIDENCE + "SELECT * FROM c")(confidence)
table_query("protocol_detected", CONFIDENCE + """
SELECT module, CASE WHEN confidence >= 300 THEN protocol ELSE 'UNKNOWN' END AS protocol, confidence
FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY confidence DESC, protocol) AS r FROM c) WHERE r = 1
""")(lambda spark, sf_dir: protocol.detect_by_score(confidence(spark, sf_dir)))


# Deadlocks: every order is the ready of its priority's channel, with a region for a valid and a nation for a request.

@table_query("deadlock_rules", G + """,
walk AS (
  SELECT 'o.' || o_orderkey AS root, 'o.' || o_orderkey AS id, 0 AS level FROM orders
  UNION SELECT w.root, e.src, level + 1 FROM walk w JOIN e ON e.dst = w.id WHERE level < 10),
near AS (SELECT root, id, min(level) AS level FROM walk WHERE level > 0 GROUP BY root, id),
o AS (SELECT 'o.' || o_orderkey AS ready, o_orderpriority AS channel, 'r.' || (o_custkey % 5) AS valid, 'n.' || (o_custkey % 25) AS request FROM orders),
one AS (SELECT DISTINCT a.channel AS a, b.channel AS b FROM o a JOIN near ON near.root = a.ready JOIN o b ON b.ready = near.id WHERE a.channel <> b.channel)
SELECT 'R1' AS rule, 'no_combinational_loop' AS kind, valid AS a, ready AS b FROM o JOIN near ON root = ready AND id = valid WHERE level <= 5
UNION ALL SELECT 'R2', 'no_cross_channel_loop', x.a, x.b FROM one x JOIN one y ON y.a = x.b AND y.b = x.a WHERE x.a < x.b
UNION ALL SELECT 'R3', 'response_after_request', request, ready FROM o WHERE NOT EXISTS (SELECT 1 FROM near WHERE root = ready AND id = request)
""")
def deadlock_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = F.concat(F.lit("o."), "o_orderkey")
    o = tables.table(spark, sf_dir, "orders")
    pairs = o.select(F.col("o_orderpriority").alias("channel"), F.concat(F.lit("r."), F.col("o_custkey") % 5).alias("valid"), ready.alias("ready"))
    requests = o.select(F.concat(F.lit("n."), F.col("o_custkey") % 25).alias("request"), ready.alias("response"))
    rules = spark.createDataFrame([("R1", "no_combinational_loop"), ("R2", "no_cross_channel_loop"), ("R3", "response_after_request"), ("R4", "fifo_depth")], "id string, kind string")
    return protocol.deadlocks(tables.trade(spark, sf_dir), rules, pairs, requests)


# Segments: all edges between suppliers or orders and parts; stages of the paths from a region to a part.

graph_query("segments_of_pair", """
SELECT src, dst, row_number() OVER (PARTITION BY src, dst ORDER BY length(condition), condition, clock_domain, kind, expression) - 1 AS pos,
       expression, condition, condition AS effective_condition, clock_domain, '' AS assign_type
FROM e WHERE dst LIKE 'p.%'
""")(lambda g: paths.parallel_segments(g, g.edges.where("dst like 'p.%'")))

graph_query("stage_breakdown", """,
pair AS (SELECT DISTINCT src, dst FROM e),
walk AS (
  SELECT ['r.3'] AS path, 'r.3' AS cur
  UNION ALL SELECT list_append(path, pair.dst), pair.dst FROM walk JOIN pair ON pair.src = walk.cur WHERE cur <> 'p.9' AND len(path) < 6 AND NOT list_contains(path, pair.dst)),
w AS (SELECT 'c.' || c_custkey AS id, 0 AS d FROM customer UNION SELECT e.dst, d + 1 FROM w JOIN e ON e.src = w.id JOIN v ON v.id = e.dst AND v.kind = 'REG' WHERE e.kind = 'DRIVER'),
stage AS (SELECT id, CAST(min(d) AS BIGINT) AS stage FROM w WHERE id LIKE 'o.%' GROUP BY id),
step AS (SELECT path, unnest(range(len(path) - 1)) AS pos FROM walk WHERE cur = 'p.9'),
s AS (SELECT array_to_string(path, '>') AS path, CAST(pos AS INT) AS pos, path[pos + 1] AS src, path[pos + 2] AS dst FROM step)
SELECT path, pos, src, dst, x.stage AS from_stage, y.stage AS to_stage, a.kind AS from_kind, b.kind AS to_kind, b.kind = 'REG' AS is_reg_boundary
FROM s JOIN v a ON a.id = src JOIN v b ON b.id = dst LEFT JOIN stage x ON x.id = src LEFT JOIN stage y ON y.id = dst
""")(lambda g: paths.stage_breakdown(search.signal_paths(g, "r.3", "p.9", 5), g, reports.pipeline_stages(wide(g)).where("id like 'o.%'")).withColumn("path", F.array_join("path", ">")))

graph_query("fanout_loads", "SELECT id, row_number() OVER (PARTITION BY id ORDER BY load) AS rank, load FROM (SELECT DISTINCT src AS id, dst AS load FROM e WHERE kind = 'DRIVER')")(stats.fanout_loads)
graph_query("net_fanouts", "SELECT max(n) AS clock_fanout, CAST(0 AS BIGINT) AS reset_fanout FROM (SELECT count(DISTINCT dst) AS n FROM e WHERE kind = 'CLOCK' GROUP BY src)")(lambda g: stats.net_fanouts(g, "CLOCK"))


# State machines: a register for each nation, which its customers' orders drive.

MOVES = """
WITH d AS (
  SELECT DISTINCT 'n' || c_nationkey || '.state' AS signal, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'S' || (o_custkey % 4) END AS from_state, o_orderstatus || (o_orderkey % 2) AS to_state,
         CASE o_orderstatus WHEN 'P' THEN '!rst_n' WHEN 'O' THEN 'en' || (o_orderkey % 3) ELSE '!!rst_n' END AS condition, o_orderstatus = 'P' AS resets
  FROM orders JOIN customer ON o_custkey = c_custkey),
every AS (SELECT signal, from_state AS state FROM d WHERE from_state IS NOT NULL UNION SELECT signal, to_state FROM d),
s AS (SELECT e.signal, e.state, e.state = coalesce((SELECT min(to_state) FROM d WHERE d.signal = e.signal AND resets), (SELECT min(state) FROM every x WHERE x.signal = e.signal)) AS is_reset FROM every e)
"""


def nation_machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.table(spark, sf_dir, "orders").join(tables.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    here, status = F.format_string("state == S%d", F.col("o_custkey") % 4), F.col("o_orderstatus")
    condition = F.when(status == "P", "!rst_n").when(status == "O", F.concat(here, F.format_string(" && en%d", F.col("o_orderkey") % 3))).otherwise(F.concat(F.lit("!!rst_n && "), here))
    e = o.select(F.concat(F.format_string("n%d.", "c_nationkey"), status, F.col("o_orderkey") % 2).alias("src"), F.format_string("n%d.state", "c_nationkey").alias("dst"), condition.alias("condition"))
    return machines.moves(PropertyGraph.of(spark.createDataFrame([], "id string"), e, placeholders=False))


table_query("machine_moves", MOVES + "SELECT * FROM d")(nation_machines)
table_query("machine_states", MOVES + "SELECT * FROM s")(lambda spark, sf_dir: machines.states(nation_machines(spark, sf_dir)))
table_query("machine_summary", MOVES + """
SELECT signal, split_part(signal, '.', 1) AS module, count(*) AS n_states, (SELECT count(*) FROM d WHERE d.signal = s.signal AND NOT resets) AS n_transitions, min(state) FILTER (is_reset) AS reset_state
FROM s GROUP BY signal
""")(lambda spark, sf_dir: machines.summary(nation_machines(spark, sf_dir)))


@table_query("case_machines", """
WITH n AS (SELECT c_custkey AS k, 'k' || c_custkey AS id, unnest([lower(c_mktsegment), 'v' || c_nationkey]) AS variable FROM customer),
f AS (SELECT variable, min(id) AS id FROM n GROUP BY variable)
SELECT variable, 'case (' || id || ')' AS from_state, o_orderpriority AS to_state, o_orderstatus AS condition FROM f JOIN orders ON 'k' || o_custkey = id WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'
""")
def case_machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = tables.table(spark, sf_dir, "customer"), tables.table(spark, sf_dir, "orders")
    k, t = F.format_string("k%d", "c_custkey"), F.format_string("t%d", "o_orderkey")
    nodes = c.select(k.alias("id"), F.lit("CONDITION").alias("kind"), F.array(F.lower("c_mktsegment"), F.format_string("v%d", "c_nationkey")).alias("variables"), F.format_string("case (k%d)", "c_custkey").alias("expression"), F.lit("").alias("state_value"))
    nodes = nodes.union(o.select(t, F.lit("STATEMENT"), F.array().cast("array<string>"), F.lit(""), F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority"))))
    edges = o.select(F.format_string("k%d", "o_custkey").alias("src"), t.alias("dst"), F.when(F.col("o_orderstatus") == "P", "SEQUENCE").otherwise("CASE_MATCH").alias("kind"), F.col("o_orderstatus").alias("condition"))
    return machines.of_cases(nodes, edges)
