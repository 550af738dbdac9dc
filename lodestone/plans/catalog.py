"""The registered graph queries: name → (query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..graph import PropertyGraph
from ..operators import classify, coverage, diff, domains, modules, paths, protocol, stats, traverse
from ..sources import tables, text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}
G = tables.SQL


def graph_query(name: str, sql: str | None = None, plain: str | None = None, graph=tables.trade):
    """Registers f(graph) as a query; sql goes behind the oracle's graph tables, plain stands alone."""

    def keep(f: Callable[[PropertyGraph], DataFrame]):
        QUERIES[name] = (lambda spark, sf_dir: f(graph(spark, sf_dir)), plain or (G + sql if sql else None))
        return f

    return keep


def table_query(name: str, sql: str | None = None):
    def keep(f: Query):
        QUERIES[name] = (f, sql)
        return f

    return keep


def big(name: str, c=None):
    return (F.col(name) if c is None else c).cast("bigint").alias(name)


# Storage, filters, projection

graph_query("graph_stats", "SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM pairs) AS pairs, (SELECT count(*) FROM e) AS edges")(stats.totals)
graph_query("kind_histogram", "SELECT kind, count(*) AS n FROM v GROUP BY kind")(stats.kind_histogram)
graph_query("edge_histogram", "SELECT e.kind, coalesce(max(t.n), 0) AS n_pairs, count(*) AS n_edges FROM e LEFT JOIN (SELECT kind, count(*) AS n FROM top GROUP BY kind) t USING (kind) GROUP BY e.kind")(stats.edge_histogram)
graph_query("nodes_by_kind", "SELECT id, name, module, kind FROM v WHERE kind = 'REG' AND module = 'supplier'")(lambda g: g.vertices.where("kind = 'REG' and module = 'supplier'").select("id", "name", "module", "kind"))
graph_query("edges_by_kind", "SELECT src, dst, kind, condition FROM top WHERE kind = 'CLOCK'")(lambda g: g.top_edges().where("kind = 'CLOCK'").select("src", "dst", "kind", "condition"))
graph_query("find_nodes", "SELECT id, kind FROM v WHERE contains(lower(id), 'o.77')")(lambda g: g.vertices.where(F.lower("id").contains("O.77".lower())).select("id", "kind"))
graph_query("filtered_nodes", "SELECT id, CAST(greatest(0, width_msb - width_lsb + 1) AS BIGINT) AS width FROM v WHERE kind = 'PORT_OUT' AND module LIKE 'S%' AND greatest(0, width_msb - width_lsb + 1) BETWEEN 8 AND 32 AND id NOT LIKE 'p.1%'")(lambda g: modules.filtered(g.vertices, ("PORT_OUT",), "S*", 8, 32, "p.1*").select("id", big("width", F.greatest(F.lit(0), F.col("width_msb") - F.col("width_lsb") + 1))))
graph_query("top_edge_per_pair", "SELECT src, dst, kind, condition, clock_domain FROM top")(lambda g: g.top_edges().select("src", "dst", "kind", "condition", "clock_domain"))
graph_query("parallel_edges", "SELECT src, dst, count(*) AS n FROM e GROUP BY 1, 2 HAVING count(*) > 1")(lambda g: g.edges.groupBy("src", "dst").agg(F.count("*").alias("n")).where("n > 1"))
graph_query("edge_dedup", "SELECT kind, condition, count(*) AS n FROM e GROUP BY 1, 2")(lambda g: g.edges.groupBy("kind", "condition").agg(F.count("*").alias("n")))
graph_query("placeholder_nodes", "SELECT id, split_part(id, '.', 1) AS module, 'SIGNAL' AS kind FROM (SELECT src AS id FROM e UNION SELECT dst FROM e) WHERE id NOT IN (SELECT id FROM v WHERE kind <> 'SIGNAL')")(lambda g: PropertyGraph(g.vertices.where("kind != 'SIGNAL'"), g.edges).placeholders().select("id", "module", "kind"))
graph_query("degrees", "SELECT id, fan_in, fan_out FROM deg")(lambda g: g.degrees().select("id", big("fan_in"), big("fan_out")))

# Joins

graph_query("direct_drivers", "SELECT id, kind FROM v WHERE id IN (SELECT src FROM e WHERE dst = 'p.7')")(lambda g: modules.drivers(g, "p.7").select("id", "kind"))
graph_query("direct_loads", "SELECT id, kind FROM v WHERE id IN (SELECT dst FROM e WHERE src = 's.3')")(lambda g: modules.loads(g, "s.3").select("id", "kind"))
graph_query("neighbours_by_kind", "SELECT id, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e WHERE kind = 'CONNECTION' UNION ALL SELECT dst, 1, 0 FROM e WHERE kind = 'CONNECTION') GROUP BY id")(lambda g: modules.by_kind(g, "CONNECTION"))
graph_query("module_internal", "SELECT src, dst, e.kind, condition FROM e JOIN v a ON a.id = src JOIN v b ON b.id = dst WHERE a.module = '1-URGENT' AND b.module = '1-URGENT'")(lambda g: modules.internal(g, "1-URGENT").select("src", "dst", "kind", "condition"))
graph_query("module_cross", "SELECT src, dst, e.kind, condition FROM e JOIN v a ON a.id = src JOIN v b ON b.id = dst WHERE (a.module = 'PROMO') <> (b.module = 'PROMO')")(lambda g: modules.crossing(g, "PROMO").select("src", "dst", "kind", "condition"))
graph_query("connected_modules", "SELECT DISTINCT CASE WHEN a.module = '2-HIGH' THEN b.module ELSE a.module END AS module FROM e JOIN v a ON a.id = src JOIN v b ON b.id = dst WHERE (a.module = '2-HIGH') <> (b.module = '2-HIGH')")(lambda g: modules.connected(g, "2-HIGH"))
graph_query("unconnected_ports", "SELECT id FROM v WHERE is_port AND id NOT IN (SELECT src FROM e) AND id NOT IN (SELECT dst FROM e)")(lambda g: modules.unconnected_ports(g).select("id"))


@table_query("instance_pairs_capped", """
WITH p AS (SELECT DISTINCT 'p.'||l_partkey AS net, 's.'||l_suppkey AS instance FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY net ORDER BY instance) AS r FROM p)
SELECT net, a, b FROM (SELECT x.net, x.instance AS a, y.instance AS b, row_number() OVER (PARTITION BY x.net ORDER BY x.instance, y.instance) AS k FROM r x JOIN r y ON x.net = y.net AND x.r < y.r) WHERE k <= 4""")
def instance_pairs(spark, sf_dir):
    lines = tables.table(spark, sf_dir, "lineitem")
    return modules.shared_net_pairs(lines.select(F.concat(F.lit("s."), "l_suppkey").alias("instance"), F.concat(F.lit("p."), "l_partkey").alias("net")))


# Traversal

REACH = """, walk AS (SELECT {root} AS root, {to} AS id, 1 AS level FROM e WHERE {start} AND kind IN ('DRIVER', 'CONNECTION')
 UNION SELECT w.root, e.{to}, w.level + 1 FROM walk w JOIN e ON e.{at} = w.id WHERE kind IN ('DRIVER', 'CONNECTION') AND w.level < {depth})
SELECT root, id, CAST(min(level) AS BIGINT) AS level FROM walk GROUP BY 1, 2"""


def starts(g: PropertyGraph, condition: str) -> DataFrame:
    return g.vertices.where(condition).select(F.col("id").alias("root"), "id")


graph_query("fanout_depth_k", REACH.format(root="src", to="dst", at="src", start="src IN ('n.3', 'c.11')", depth=3))(lambda g: traverse.fan_out(g, starts(g, "id in ('n.3', 'c.11')"), 3))
graph_query("fanin_depth_k", REACH.format(root="dst", to="src", at="dst", start="dst IN ('p.5', 'p.6')", depth=3))(lambda g: traverse.fan_in(g, starts(g, "id in ('p.5', 'p.6')"), 3))
graph_query("fanin_direct", "SELECT DISTINCT dst AS root, src AS id, CAST(1 AS BIGINT) AS level FROM e WHERE dst IN ('o.1', 'o.2', 'o.3')")(lambda g: traverse.fan_in(g, starts(g, "id in ('o.1', 'o.2', 'o.3')"), 1))
graph_query("fanout_closure", REACH.format(root="src", to="dst", at="src", start="src = 'c.20'", depth=200))(lambda g: traverse.fan_out(g, starts(g, "id = 'c.20'")))
graph_query("load_confidence", "SELECT v.id, count(DISTINCT e.dst) AS n, CASE count(DISTINCT e.dst) WHEN 0 THEN 'no_load' WHEN 1 THEN 'high' ELSE 'medium' END AS confidence FROM v LEFT JOIN e ON e.src = v.id AND e.kind IN ('DRIVER', 'CONNECTION') WHERE v.kind = 'REG' GROUP BY 1")(
    lambda g: g.vertices.where("kind = 'REG'").select("id").join(g.edges.where("kind in ('DRIVER', 'CONNECTION')").select("src", "dst").distinct().groupBy("src").agg(F.count("*").alias("n")), F.col("id") == F.col("src"), "left").select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")).withColumn("confidence", traverse.confidence()))
graph_query("neighbourhood", """, sides AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
near AS (SELECT 'c.5' AS id UNION SELECT dst FROM sides WHERE src = 'c.5' UNION SELECT b2.dst FROM sides b1 JOIN sides b2 ON b2.src = b1.dst WHERE b1.src = 'c.5')
SELECT src, dst, kind FROM e WHERE src IN (SELECT id FROM near) AND dst IN (SELECT id FROM near)""")(lambda g: traverse.neighbourhood(g, starts(g, "id = 'c.5'"), 2).edges.select("src", "dst", "kind"))


@table_query("hierarchy_ancestors", """
WITH p AS (SELECT 'c.'||c_custkey AS id, 'n.'||c_nationkey AS parent FROM customer UNION ALL SELECT 'n.'||n_nationkey, 'r.'||n_regionkey FROM nation)
SELECT id, parent AS ancestor, CAST(1 AS BIGINT) AS level FROM p UNION ALL SELECT a.id, b.parent, CAST(2 AS BIGINT) FROM p a JOIN p b ON b.id = a.parent""")
def hierarchy(spark, sf_dir):
    link = lambda t, a, k, b, m: tables.table(spark, sf_dir, t).select(F.concat(F.lit(a), k).alias("id"), F.concat(F.lit(b), m).alias("parent"))
    return traverse.ancestors(link("customer", "c.", "c_custkey", "n.", "c_nationkey").union(link("nation", "n.", "n_nationkey", "r.", "n_regionkey")), 2)


# Paths

EV = tables.SQL + """, walk AS (SELECT src AS cur, [src] AS path FROM ev WHERE src = {start} GROUP BY 1
 UNION ALL SELECT ev.dst, list_append(w.path, ev.dst) FROM walk w JOIN ev ON ev.src = w.cur WHERE NOT list_contains(w.path, ev.dst) AND len(w.path) <= 4 AND w.cur <> 'purchase')
"""
graph_query("simple_paths", plain=EV.format(start="'view'") + "SELECT array_to_string(path, '>') AS path, CAST(len(path) - 1 AS BIGINT) AS hops FROM walk WHERE cur = 'purchase'", graph=tables.events)(lambda g: paths.simple_paths(g.edges, "view", "purchase", 4).select(F.array_join("path", ">").alias("path"), big("hops", F.size("path") - 1)))
graph_query("shortest_path", """, walk AS (SELECT 'r.1' AS cur, ['r.1'] AS path UNION ALL SELECT e.dst, list_append(w.path, e.dst) FROM walk w JOIN (SELECT DISTINCT src, dst FROM e) e ON e.src = w.cur WHERE len(w.path) <= 4)
SELECT array_to_string(w.path, '>') AS path FROM walk w WHERE w.cur = 'p.9' ORDER BY len(w.path), w.path LIMIT 1""")(lambda g: paths.shortest_path(g.edges, "r.1", "p.9").select(F.array_join("path", ">").alias("path")))
graph_query("elementary_cycles", plain=tables.SQL + """, walk AS (SELECT src AS root, src AS cur, [src] AS path FROM ev GROUP BY 1
 UNION ALL SELECT w.root, ev.dst, list_append(w.path, ev.dst) FROM walk w JOIN ev ON ev.src = w.cur WHERE ev.dst > w.root AND NOT list_contains(w.path, ev.dst))
SELECT array_to_string(w.path, '>') AS path FROM walk w JOIN ev ON ev.src = w.cur AND ev.dst = w.root""", graph=tables.events)(lambda g: paths.elementary_cycles(g.edges, 5).select(F.array_join("path", ">").alias("path")))
graph_query("dataflow_latency", """, s AS (SELECT a.src || '>' || a.dst || '>' || b.dst AS path, (CASE WHEN x.kind = 'REG' THEN 1 ELSE 0 END) + (CASE WHEN y.kind = 'REG' THEN 1 ELSE 0 END) + (CASE WHEN z.kind = 'REG' THEN 1 ELSE 0 END) AS n_regs,
  (SELECT count(DISTINCT c) FROM (VALUES (a.clock_domain), (b.clock_domain)) t(c) WHERE c <> '') AS n_clocks, a.condition <> '' OR b.condition <> '' AS conditional
 FROM top a JOIN top b ON b.src = a.dst JOIN v x ON x.id = a.src JOIN v y ON y.id = a.dst JOIN v z ON z.id = b.dst WHERE a.src = 'c.12' AND a.kind = 'DRIVER' AND b.kind = 'DRIVER')
SELECT path, CAST(n_regs AS BIGINT) AS n_regs, CAST(n_clocks AS BIGINT) AS n_clocks, CASE WHEN n_clocks <= 1 THEN CAST(n_regs AS BIGINT) END AS latency, conditional, CASE WHEN n_clocks > 1 THEN 'high' ELSE 'safe' END AS risk FROM s""")(
    lambda g: paths.latency(two_steps(g, "c.12"), g).select(F.array_join("path", ">").alias("path"), big("n_regs"), big("n_clocks"), big("latency"), "conditional", "risk"))


def two_steps(g: PropertyGraph, src: str) -> DataFrame:
    e = g.edges.where("kind = 'DRIVER'").select("src", "dst").distinct()
    return e.where(F.col("src") == src).select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").select(F.array("src", "mid", "dst").alias("path"))


# Statistics and risk

graph_query("fanout_rank", """SELECT src AS id, v.kind, n AS fanout, CASE WHEN n > 50 THEN 'split the signal' ELSE '' END AS suggestion
FROM (SELECT src, count(DISTINCT dst) AS n FROM e WHERE kind = 'DRIVER' GROUP BY src) JOIN v ON v.id = src""")(stats.fanout_rank)
graph_query("clock_load", """SELECT src AS id, v.kind, n AS fanout, CASE WHEN n > 100 THEN 'gate the clock' WHEN n > 50 THEN 'optimise the clock''s fan-out' ELSE '' END AS suggestion
FROM (SELECT src, count(DISTINCT dst) AS n FROM e WHERE kind = 'CLOCK' GROUP BY src) JOIN v ON v.id = src""")(lambda g: stats.fanout_rank(g, "CLOCK"))
RISK = """, cov AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS bare FROM part WHERE p_size % 5 = 0),
d AS (SELECT v.id, v.kind, fan_in, fan_out, split_part(v.id, '.', 2) IN (SELECT bare FROM cov) AS has_sva, greatest(1, width_lsb - width_msb + 1) AS w FROM v JOIN deg USING (id) WHERE NOT is_clock),
s AS (SELECT id, kind, fan_in, fan_out, has_sva, CAST(fan_in*30 + fan_out*20 + w*3 + (CASE WHEN fan_in >= 3 THEN 150 ELSE 0 END) + (CASE WHEN fan_out >= 3 THEN 100 ELSE 0 END) + (CASE WHEN has_sva THEN 0 ELSE 120 END) + 80 AS BIGINT) AS func_tenths,
 CAST((CASE WHEN kind = 'REG' THEN 150 ELSE 0 END) + fan_in*20 AS BIGINT) AS timing_tenths FROM d)
"""
LEVELS = "CASE WHEN {0} >= 400 THEN 'CRITICAL' WHEN {0} >= 250 THEN 'HIGH' WHEN {0} >= 150 THEN 'MEDIUM' ELSE 'LOW' END"


def covered(spark, sf_dir):
    return tables.table(spark, sf_dir, "part").where("p_size % 5 = 0").select(F.col("p_partkey").cast("string").alias("name")).distinct().select("name", F.lit(True).alias("has_sva"), F.lit(False).alias("has_cov"))


@table_query("degree_risk", G + RISK + f"SELECT id, kind, fan_in, fan_out, func_tenths, {LEVELS.format('func_tenths')} AS func_level, timing_tenths, {LEVELS.format('timing_tenths')} AS timing_level FROM s")
def degree_risk(spark, sf_dir):
    return stats.risk(tables.trade(spark, sf_dir), covered(spark, sf_dir)).select("id", "kind", big("fan_in"), big("fan_out"), "func_tenths", "func_level", "timing_tenths", "timing_level")


@table_query("verify_gap", G + RISK + "SELECT id, func_tenths + timing_tenths AS total_tenths FROM s WHERE NOT has_sva AND func_tenths + timing_tenths >= 900 ORDER BY 2 DESC, 1 LIMIT 50")
def verify_gap(spark, sf_dir):
    return stats.gaps(stats.risk(tables.trade(spark, sf_dir), covered(spark, sf_dir)), 900, 50).select("id", "total_tenths")


@graph_query("impact_risk", REACH.format(root="src", to="dst", at="src", start="src = 'c.8'", depth=3).replace("SELECT root, id, CAST(min(level)", ", near AS (SELECT root, id, CAST(min(level)") + """),
x AS (SELECT n.id, n.level, d.fan_out, n.level * 5 + d.fan_out * 2 + 20 + (CASE WHEN d.fan_out > 10 THEN 15 WHEN d.fan_out > 5 THEN 10 ELSE 0 END) AS score FROM near n JOIN deg d USING (id))
SELECT id, level, fan_out, CAST(score AS BIGINT) AS score, CASE WHEN score >= 40 THEN 'HIGH' WHEN score * 10 >= 240 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM x""")
def impact_risk(g):
    near = traverse.fan_out(g, starts(g, "id = 'c.8'"), 3)
    score = stats.path_risk(F.col("level"), F.col("fan_out"), F.lit(False), F.substring_index("id", ".", -1), F.lit(""))
    return near.join(g.degrees(), "id").select("id", "level", big("fan_out"), score.alias("score")).withColumn("risk", stats.risk_level(F.col("score"), 40))


graph_query("batch_fanin_capped", """, b AS (SELECT DISTINCT dst AS signal, src AS driver FROM e WHERE dst IN ('p.1', 'p.2', 'p.3', 'o.4')),
r AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY driver) AS rank, count(*) OVER (PARTITION BY signal) AS pre_cap FROM b)
SELECT signal, driver, rank, pre_cap, pre_cap > 5 AS truncated FROM r WHERE rank <= 5""")(lambda g: stats.capped(g.edges.where(F.col("dst").isin("p.1", "p.2", "p.3", "o.4")).select(F.col("dst").alias("signal"), F.col("src").alias("driver")).distinct(), "signal", ["driver"], 5).select("signal", "driver", "rank", "pre_cap", "truncated"))
graph_query("anomalies", "SELECT id, CASE WHEN fan_in = 0 AND fan_out > 0 THEN 'X_DRIVER' WHEN fan_in > 0 AND fan_out = 0 THEN 'DANGLING' ELSE 'ORPHAN' END AS anomaly FROM deg JOIN v USING (id) WHERE NOT is_port AND (fan_in = 0 OR fan_out = 0)")(stats.anomalies)

# Differences: all orders but the late ones, against all but those of one status

DIFF = """, g1 AS (SELECT src, dst FROM e WHERE src NOT IN (SELECT 'o.'||o_orderkey FROM orders WHERE o_orderstatus = 'P')),
g2 AS (SELECT src, dst FROM e WHERE NOT (kind = 'CONNECTION' AND dst LIKE 's.%')),
p1 AS (SELECT DISTINCT * FROM g1), p2 AS (SELECT DISTINCT * FROM g2),
v1 AS (SELECT id, kind, module FROM v WHERE kind <> 'WIRE'), v2 AS (SELECT id, CASE WHEN module = 'supplier' THEN 'WIRE' ELSE kind END AS kind, module FROM v WHERE id <> 'r.0'),
ch AS (SELECT src, dst, 'removed' AS change FROM p1 EXCEPT SELECT src, dst, 'removed' FROM p2),
ch2 AS (SELECT src, dst, 'added' AS change FROM p2 EXCEPT SELECT src, dst, 'added' FROM p1),
core AS (SELECT v1.id FROM v1 JOIN v2 USING (id) WHERE id NOT IN (SELECT src FROM ch UNION SELECT dst FROM ch UNION SELECT src FROM ch2 UNION SELECT dst FROM ch2)),
nd AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM v1 a FULL JOIN v2 b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.kind <> b.kind)
"""


def versions(g: PropertyGraph) -> tuple[PropertyGraph, PropertyGraph]:
    late = g.edges.where("kind = 'CLOCK' and src = 'clk.P'").select(F.col("dst").alias("src")).distinct()
    a = PropertyGraph(g.vertices.where("kind != 'WIRE'"), g.edges.join(late, "src", "left_anti").select(*g.edges.columns))
    kind = F.when(F.col("module") == "supplier", "WIRE").otherwise(F.col("kind"))
    return a, PropertyGraph(g.vertices.where("id != 'r.0'").withColumn("kind", kind), g.edges.where("not (kind = 'CONNECTION' and dst like 's.%')"))


graph_query("graph_diff_nodes", DIFF + "SELECT id, change FROM nd")(lambda g: diff.nodes(*versions(g)))
graph_query("graph_diff_pairs", DIFF + "SELECT * FROM ch UNION ALL SELECT * FROM ch2")(lambda g: diff.pairs(*versions(g)))
graph_query("stable_core", DIFF + "SELECT id FROM core")(lambda g: diff.stable_core(*versions(g)))
graph_query("graph_health", DIFF + """SELECT nodes, stable, added, removed, changed, CAST(floor(stable * 10000 / nodes) AS BIGINT) AS score, CASE WHEN changed < 0.05 * nodes AND nodes - stable > 0.3 * nodes THEN CASE WHEN nodes - stable > 0.5 * nodes THEN 'critical' ELSE 'warning' END ELSE '' END AS coupling FROM (SELECT (SELECT count(*) FROM v2) AS nodes, (SELECT count(*) FROM core) AS stable,
 (SELECT count(*) FROM nd WHERE change = 'added') AS added, (SELECT count(*) FROM nd WHERE change = 'removed') AS removed, (SELECT count(*) FROM nd) AS changed)""")(lambda g: diff.health(*versions(g)))
graph_query("reach_diff", DIFF + """, w1 AS (SELECT dst AS id, 1 AS level FROM g1 WHERE src = 'c.30' UNION SELECT e.dst, level + 1 FROM w1 JOIN g1 e ON e.src = w1.id WHERE level < 3),
w2 AS (SELECT dst AS id, 1 AS level FROM g2 WHERE src = 'c.30' UNION SELECT e.dst, level + 1 FROM w2 JOIN g2 e ON e.src = w2.id WHERE level < 3)
SELECT 'c.30' AS root, coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'newly' WHEN b.id IS NULL THEN 'no_longer' ELSE 'still' END AS change FROM (SELECT DISTINCT id FROM w1) a FULL JOIN (SELECT DISTINCT id FROM w2) b ON a.id = b.id""")(lambda g: diff.reachability(*versions(g), starts(g, "id = 'c.30'"), 3))

# Domains, state machines, control flow

DOM = ", dom AS (SELECT dst AS id, min(src) AS domain FROM e WHERE kind = 'CLOCK' GROUP BY dst), cdc AS (SELECT t.src, t.dst, t.kind, t.condition, a.domain AS src_domain, b.domain AS dst_domain FROM top t JOIN dom a ON a.id = t.src JOIN dom b ON b.id = t.dst WHERE t.kind <> 'CLOCK' AND a.domain <> b.domain)\n"
graph_query("clock_domains", DOM + "SELECT id, domain FROM dom")(domains.assign)
graph_query("spread_domains", DOM + """, w AS (SELECT a.domain, e.dst AS id FROM dom a JOIN e ON e.src = a.id AND e.kind <> 'CLOCK' WHERE e.dst NOT IN (SELECT id FROM dom))
SELECT id, domain FROM dom UNION ALL SELECT id, min(domain) FROM w GROUP BY id""")(lambda g: domains.spread(g, 1))
graph_query("cdc_paths", DOM + "SELECT * FROM cdc")(domains.crossings)
graph_query("cdc_pairs", DOM + "SELECT coalesce(src_domain, '') AS src_domain, coalesce(dst_domain, '') AS dst_domain, count(*) AS n FROM cdc GROUP BY ROLLUP (src_domain, dst_domain)")(lambda g: domains.crossing_counts(domains.crossings(g)))
graph_query("sync_chain", DOM + """, same AS (SELECT DISTINCT e.src, e.dst FROM e JOIN dom a ON a.id = e.src JOIN dom b ON b.id = e.dst WHERE kind = 'DRIVER' AND a.domain = b.domain),
w AS (SELECT DISTINCT dst AS root, dst AS id FROM cdc UNION SELECT w.root, s.dst FROM w JOIN same s ON s.src = w.id)
SELECT root AS dst, count(DISTINCT id) AS n_regs, CASE WHEN count(DISTINCT id) = 1 THEN 'NONE' ELSE count(DISTINCT id) || '-FLOP' END AS sync FROM w GROUP BY root""")(lambda g: domains.synchronisers(g, domains.crossings(g)))
graph_query("reg_depth", """, w AS (SELECT 'c.'||c_custkey AS id, 0 AS depth FROM customer UNION SELECT e.dst, depth + 1 FROM w JOIN e ON e.src = w.id JOIN v ON v.id = e.dst AND v.kind = 'REG' WHERE e.kind = 'DRIVER')
SELECT id, CAST(max(depth) AS BIGINT) AS depth FROM w GROUP BY id""")(lambda g: paths.longest_depth(domains.register_steps(g).where("src not like 'r.%' and src not like 'n.%'"), g.vertices.where("id like 'c.%'"), g.vertices.select("id", F.when(F.col("kind") == "REG", 1).otherwise(0).cast("bigint").alias("w"))))
graph_query("fsm_transitions", plain=tables.SQL + "SELECT src AS from_state, dst AS to_state, '1' AS condition FROM ev", graph=tables.events)(domains.state_machine)


@table_query("role_transitions", "SELECT src, dst, count(*) AS n FROM (SELECT role AS src, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role) AS dst FROM conversations) WHERE dst IS NOT NULL GROUP BY 1, 2")
def role_transitions(spark, sf_dir):
    return tables.transitions(tables.table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role"], "role")


graph_query("conditioned_signals", "SELECT dst AS id, count(DISTINCT condition) AS n_conditions, count(DISTINCT src) AS n_sources FROM e WHERE condition <> '' GROUP BY dst")(domains.conditioned)


@table_query("mutex_pairs", "WITH c AS (SELECT o_custkey AS k, o_orderstatus AS s, bool_or(o_orderpriority = '1-URGENT') AS u FROM orders GROUP BY 1, 2) SELECT CAST(a.k AS VARCHAR) AS id, '!en_' || a.s AS a, 'en_' || b.s AS b FROM c a JOIN c b ON a.k = b.k AND a.s = b.s WHERE a.u")
def mutex_pairs(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders")
    e = o.select(F.concat(F.lit("x"), "o_orderkey").alias("src"), F.col("o_custkey").cast("string").alias("dst"), F.concat(F.lit("en_"), "o_orderstatus").alias("condition"))
    n = o.where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("y"), "o_orderkey").alias("src"), F.col("o_custkey").cast("string").alias("dst"), F.concat(F.lit("!en_"), "o_orderstatus").alias("condition"))
    return domains.opposed(PropertyGraph.of(spark.createDataFrame([], "id string"), e.union(n), placeholders=False))


# Classes and patterns

_match = lambda names: " OR ".join(f"contains(n, '{x}')" for x in names)
CLASS = f""", m AS (SELECT *, lower(name) AS n, CASE WHEN width_msb >= width_lsb THEN width_msb - width_lsb + 1 ELSE 1 END AS w FROM v),
k AS (SELECT *, ({_match(S.CONTROL_NAMES)}) AS ctl, ({_match(S.DATA_NAMES)}) AS dat FROM m),
cls AS (SELECT id, CASE WHEN is_clock THEN 'CLOCK' WHEN ctl AND dat THEN 'DATA' WHEN ctl THEN 'CONTROL' WHEN dat THEN 'DATA' WHEN w = 1 THEN 'CONTROL' WHEN w > 1 THEN 'DATA' ELSE 'UNKNOWN' END AS class,
 CAST(CASE WHEN is_clock THEN 100 WHEN ctl AND dat THEN 60 WHEN ctl THEN 70 WHEN dat THEN 70 WHEN w = 1 AND kind = 'REG' THEN 50 WHEN w = 1 THEN 40 WHEN w > 1 THEN 60 ELSE 0 END AS BIGINT) AS confidence FROM k)
"""
graph_query("node_classes", CLASS + "SELECT id, class, confidence FROM cls")(classify.nodes)
EDGE_CLASS = CLASS + """, ec AS (SELECT e.src, e.dst, e.kind, e.condition, a.class AS s, b.class AS d FROM e LEFT JOIN cls a ON a.id = e.src LEFT JOIN cls b ON b.id = e.dst)
SELECT class, kind, key_control, confidence, count(*) AS n FROM (SELECT kind, CAST(CASE WHEN kind = 'CLOCK' THEN 100 WHEN s = 'CLOCK' OR d = 'CLOCK' THEN 90 WHEN kind = 'CONNECTION' THEN 0 WHEN s = 'CONTROL' AND d = 'DATA' THEN 80 WHEN s = 'DATA' OR d = 'DATA' THEN 70 WHEN condition <> '' THEN 50 ELSE 0 END AS BIGINT) AS confidence, CASE WHEN kind = 'CLOCK' OR s = 'CLOCK' OR d = 'CLOCK' THEN 'CLOCK' WHEN kind = 'CONNECTION' THEN 'DATA' WHEN s = 'CONTROL' AND d = 'DATA' THEN 'CONTROL' WHEN s = 'DATA' OR d = 'DATA' THEN 'DATA' WHEN condition <> '' THEN 'DATA' ELSE 'UNKNOWN' END AS class,
 CASE WHEN kind = 'CLOCK' OR s = 'CLOCK' OR d = 'CLOCK' THEN true WHEN kind = 'CONNECTION' THEN false WHEN s = 'CONTROL' AND d = 'DATA' THEN true WHEN s = 'DATA' OR d = 'DATA' THEN false WHEN condition <> '' THEN true ELSE false END AS key_control FROM ec) GROUP BY 1, 2, 3, 4"""
graph_query("edge_classes", EDGE_CLASS)(lambda g: classify.edges(g).groupBy("class", "kind", "key_control", "confidence").agg(F.count("*").alias("n")))
graph_query("pattern_convergence", "SELECT DISTINCT src, dst, 'CONVERGENCE' AS rule FROM e WHERE kind = 'DRIVER' AND dst IN (SELECT dst FROM e WHERE kind = 'DRIVER' GROUP BY dst HAVING count(*) FILTER (condition <> '') >= 2 AND count(*) FILTER (condition = '') >= 1)")(lambda g: classify.matches(g, [classify.convergence(), classify.truncation(), classify.widening()]))

# Names, roles, protocols


@table_query("effective_conditions", """WITH c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'rst_n && ' || o_orderstatus || ' == x' WHEN o_orderkey % 3 = 1 THEN o_orderstatus || ' && !rst_n' ELSE o_orderstatus END AS c FROM orders)
SELECT k, CASE WHEN k % 3 = 0 THEN split_part(replace(c, ' ', ''), '&&', 2) WHEN k % 3 = 1 THEN split_part(replace(c, ' ', ''), '&&', 1) ELSE c END AS effective FROM c""")
def effective_conditions(spark, sf_dir):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    c = F.when(k % 3 == 0, F.concat(F.lit("rst_n && "), s, F.lit(" == x"))).when(k % 3 == 1, F.concat(s, F.lit(" && !rst_n"))).otherwise(s)
    return tables.table(spark, sf_dir, "orders").select(k.alias("k"), S.effective_condition(c).alias("effective"))


@table_query("normalised_names", "SELECT p_partkey, replace(replace(p_name, ' ', '_'), '_', '') || 'valid' AS normalised FROM part")
def normalised_names(spark, sf_dir):
    name = F.concat(F.lit("top.u1.io_m_axi_"), F.regexp_replace("p_name", " ", "_"), F.lit("_valid_o[3]"))
    return tables.table(spark, sf_dir, "part").select("p_partkey", S.normalise(name).alias("normalised"))


@table_query("role_scores", """WITH s AS (SELECT CAST(p_partkey AS VARCHAR) AS name, p_size % 12 AS w, CASE WHEN p_partkey % 2 = 0 THEN 'output' ELSE 'input' END AS d FROM part)
SELECT name, CASE WHEN w >= 9 THEN 'data' WHEN w = 1 AND d = 'output' THEN 'valid' WHEN w = 1 THEN 'ready' WHEN w BETWEEN 2 AND 8 AND d = 'input' THEN 'resp' WHEN w BETWEEN 2 AND 8 THEN 'ctrl' ELSE '' END AS role FROM s""")
def role_scores(spark, sf_dir):
    p = tables.table(spark, sf_dir, "part")
    s = p.select(F.col("p_partkey").cast("string").alias("name"), (F.col("p_size") % 12).alias("width"), F.when(F.col("p_partkey") % 2 == 0, "output").otherwise("input").alias("direction"), F.lit("register").alias("driver_kind"))
    return classify.roles(s).select("name", "role")


@table_query("handshake_pairs", """WITH p AS (SELECT DISTINCT o_orderpriority AS module, 'b' || (o_custkey % 7) || CASE WHEN o_orderkey % 2 = 0 THEN '_valid' ELSE '_ready' END AS name FROM orders)
SELECT a.module, replace(a.name, '_valid', '') AS base, a.name AS valid, b.name AS ready FROM p a JOIN p b ON a.module = b.module AND a.name LIKE '%_valid' AND b.name = replace(a.name, '_valid', '_ready')""")
def handshake_pairs(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders")
    name = F.concat(F.lit("b"), F.col("o_custkey") % 7, F.when(F.col("o_orderkey") % 2 == 0, "_valid").otherwise("_ready"))
    return classify.valid_ready_pairs(o.select(F.col("o_orderpriority").alias("module"), name.alias("name"), F.lit(1).alias("width")).distinct())


@table_query("protocol_scores", """WITH s AS (SELECT DISTINCT p_type AS module, CASE p_size % 4 WHEN 0 THEN 'awvalid' WHEN 1 THEN 'awready' WHEN 2 THEN 'wdata' ELSE 'wlast' END AS signal FROM part),
c(protocol, channel, signal, required) AS (VALUES ('axi', 'AW', 'awvalid', true), ('axi', 'AW', 'awready', true), ('axi', 'W', 'wdata', true), ('axi', 'W', 'wlast', false), ('stream', 'T', 'tvalid', true), ('stream', 'T', 'wlast', false))
SELECT module, protocol, channel, count(*) FILTER (required) AS required_hits, count(*) FILTER (NOT required) AS optional_hits FROM s JOIN c USING (signal) GROUP BY 1, 2, 3""")
def protocol_scores(spark, sf_dir):
    p = tables.table(spark, sf_dir, "part")
    k = F.col("p_size") % 4
    s = p.select(F.col("p_type").alias("module"), F.when(k == 0, "m_axi_aw_valid").when(k == 1, "m_axi_aw_ready").when(k == 2, "m_axi_w_data").otherwise("m_axi_w_last").alias("name"))
    c = spark.createDataFrame([("axi", "AW", "awvalid", True), ("axi", "AW", "awready", True), ("axi", "W", "wdata", True), ("axi", "W", "wlast", False), ("stream", "T", "tvalid", True), ("stream", "T", "wlast", False)], "protocol string, channel string, signal string, required boolean")
    return protocol.channel_scores(s, c).select("module", "protocol", "channel", big("required_hits"), big("optional_hits"))


graph_query("deadlock_candidates", """, q AS (SELECT DISTINCT dst AS ready, 'r.' || (CAST(split_part(dst, '.', 2) AS INT) % 5) AS valid FROM e WHERE dst LIKE 'n.%'),
w AS (SELECT ready AS root, ready AS id, 0 AS level FROM q UNION SELECT w.root, e.src, level + 1 FROM w JOIN e ON e.dst = w.id WHERE level < 3)
SELECT q.valid, q.ready, CAST(min(level) AS BIGINT) AS level FROM q JOIN w ON w.root = q.ready AND w.id = q.valid WHERE level > 0 GROUP BY 1, 2""")(
    lambda g: protocol.combinational_loops(g, g.edges.where("dst like 'n.%'").select(F.concat(F.lit("r."), F.substring_index("dst", ".", -1).cast("int") % 5).alias("valid"), F.col("dst").alias("ready")).distinct(), 3))

# Coverage and search


@table_query("coverage_ratio", "SELECT count(l.doc_id) AS covered, count(*) - count(l.doc_id) AS uncovered, CAST(floor(count(l.doc_id) * 1000 / count(*)) AS BIGINT) AS per_mille FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def coverage_ratio(spark, sf_dir):
    return coverage.ratio(tables.table(spark, sf_dir, "documents").select("doc_id"), tables.table(spark, sf_dir, "labels"), "doc_id")


@table_query("uncovered", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def uncovered(spark, sf_dir):
    return coverage.uncovered(tables.table(spark, sf_dir, "documents").select("doc_id", "lang"), tables.table(spark, sf_dir, "labels"), "doc_id")


@table_query("missing_cross", """WITH p AS (SELECT DISTINCT least(c_mktsegment, o_orderpriority) AS a, greatest(c_mktsegment, o_orderpriority) AS b FROM orders JOIN customer ON c_custkey = o_custkey), x AS (SELECT DISTINCT least(c_mktsegment, o_orderpriority) AS a, greatest(c_mktsegment, o_orderpriority) AS b FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P' AND c_nationkey = 7 AND c_acctbal < 1000)
SELECT a, b FROM p EXCEPT SELECT a, b FROM x""")
def missing_cross(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders").join(tables.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    pairs = o.select(F.col("c_mktsegment").alias("a"), F.col("o_orderpriority").alias("b"), "o_orderstatus", "c_nationkey", "c_acctbal")
    points = pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct()
    return coverage.missing_crosses(pairs.select("a", "b").distinct(), points, pairs.where("o_orderstatus = 'P' and c_nationkey = 7 and c_acctbal < 1000").select("a", "b"))


@table_query("search_context", """WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
c AS (SELECT *, coalesce(lag(x) OVER (PARTITION BY id ORDER BY line), '') AS before, coalesce(lead(x) OVER (PARTITION BY id ORDER BY line), '') AS after FROM l)
SELECT id, CAST(line AS BIGINT) AS line, x AS text, before, after FROM c WHERE contains(lower(x), 'pathetic')""")
def search_context(spark, sf_dir):
    return text.search(tables.table(spark, sf_dir, "documents"), "doc_id", "text", "Pathetic", context=1, ignore_case=True)
