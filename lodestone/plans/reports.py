"""More registered graph queries, over the reports, ports, passes and handshakes: name → (query, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..graph import PropertyGraph
from ..operators import decompose, domains, handshake, passes, ports, reports, traverse
from ..sources import export, tables
from .catalog import CLASS, DOM, EDGE_CLASS, G, big, graph_query, starts, table_query

PORTS = "prt AS (SELECT DISTINCT 's.'||l_suppkey||'.p.'||l_partkey AS inst_port, 's.'||l_suppkey AS instance, 'p.'||l_partkey AS internal FROM lineitem)"


def supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as instances, the parts that they supply as signals inside their ports."""
    line = tables.table(spark, sf_dir, "lineitem")
    s, p = F.concat(F.lit("s."), "l_suppkey"), F.concat(F.lit("p."), "l_partkey")
    line = line.select("l_suppkey", "l_partkey").distinct()  # keys, not the names that they make
    return line.select(F.concat_ws(".", s, p).alias("inst_port"), s.alias("instance"), p.alias("internal"))


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s."), "s_suppkey").alias("id"), F.lit("supplier").alias("module_type"), F.concat(F.lit("n."), "s_nationkey").alias("parent"))
    n = tables.table(spark, sf_dir, "nation").select(F.concat(F.lit("n."), "n_nationkey").alias("id"), F.lit("nation").alias("module_type"), F.concat(F.lit("r."), "n_regionkey").alias("parent"))
    return s.union(n)


def port_query(name: str, sql: str):
    """Registers f(graph, ports) as a query."""

    def keep(f):
        table_query(name, G + ", " + PORTS + "\n" + sql)(lambda spark, sf_dir: f(tables.trade(spark, sf_dir), supplied(spark, sf_dir)))
        return f

    return keep


# Ports and instances

port_query("internal_signals", "SELECT inst_port AS id, internal FROM prt WHERE instance = 's.3'")(lambda g, p: ports.internal(p, p.where("instance = 's.3'").select(F.col("inst_port").alias("id"))))
port_query("port_paths", "SELECT internal AS id, inst_port FROM prt WHERE internal IN (SELECT id FROM v WHERE module LIKE 'PROMO%')")(lambda g, p: ports.port_paths(p, g.vertices.where("module like 'PROMO%'").select("id")))
port_query("port_twin_loads", "SELECT internal AS root, inst_port AS id FROM prt UNION SELECT inst_port, internal FROM prt")(lambda g, p: ports.twin_loads(p, p.select(F.col("inst_port").alias("root"), F.col("inst_port").alias("id")).union(p.select("internal", "internal")).distinct()))
port_query("port_twin_drivers", "SELECT a.inst_port AS root, a.internal AS id FROM prt a WHERE instance = 's.2' UNION SELECT a.inst_port, b.inst_port FROM prt a JOIN prt b ON a.internal = b.internal AND a.inst_port <> b.inst_port WHERE a.instance = 's.2'")(lambda g, p: ports.twin_drivers(p, p.where("instance = 's.2'").select(F.col("inst_port").alias("root"), F.col("inst_port").alias("id"))))
port_query("loads_or_ports", "SELECT e.src AS root, e.dst AS id FROM e WHERE src IN ('s.1', 's.2') AND kind IN ('DRIVER', 'CONNECTION') UNION SELECT internal, inst_port FROM prt WHERE internal IN ('p.1', 'p.2')")(lambda g, p: ports.loads(g, p, starts(g, "id in ('s.1', 's.2', 'p.1', 'p.2')"), 1))
port_query("drivers_or_ports", "SELECT dst AS root, src AS id FROM e WHERE dst IN ('p.1', 'o.2') UNION SELECT inst_port, internal FROM prt WHERE instance = 's.1' UNION SELECT a.inst_port, b.inst_port FROM prt a JOIN prt b ON a.internal = b.internal AND a.inst_port <> b.inst_port WHERE a.instance = 's.1'")(lambda g, p: ports.drivers(g, p, starts(g, "id in ('p.1', 'o.2')").union(p.where("instance = 's.1'").select(F.col("inst_port").alias("root"), F.col("inst_port").alias("id"))), 1))
port_query("resolved_signals", """, q AS (SELECT inst_port AS id FROM prt UNION SELECT internal FROM prt UNION SELECT id FROM v WHERE kind = 'WIRE'),
t AS (SELECT id, arg_min(internal, inst_port) AS tail FROM (SELECT internal AS id, inst_port, internal FROM prt UNION ALL SELECT split_part(inst_port, '.', 2) || '.' || internal, inst_port, internal FROM prt UNION ALL SELECT split_part(internal, '.', 2), inst_port, internal FROM prt) GROUP BY id)
SELECT q.id, coalesce((SELECT min(internal) FROM prt WHERE inst_port = q.id), (SELECT min(internal) FROM prt WHERE internal = q.id), (SELECT tail FROM t WHERE t.id = q.id), q.id) AS "to" FROM q""")(
    lambda g, p: ports.resolve(p, p.select(F.col("inst_port").alias("id")).union(p.select("internal")).union(g.vertices.where("kind = 'WIRE'").select("id"))))
tables_only = "WITH i AS (SELECT 's.'||s_suppkey AS id, 'supplier' AS module_type, 'n.'||s_nationkey AS parent FROM supplier UNION ALL SELECT 'n.'||n_nationkey, 'nation', 'r.'||n_regionkey FROM nation) "
table_query("child_instances", tables_only + "SELECT id, module_type FROM i WHERE parent = 'n.5'")(lambda spark, sf_dir: ports.children(instances(spark, sf_dir), "n.5").select("id", "module_type"))
table_query("instances_below", tables_only + "SELECT id, CAST(1 AS BIGINT) AS level FROM i WHERE parent = 'r.1' UNION ALL SELECT b.id, CAST(2 AS BIGINT) FROM i a JOIN i b ON b.parent = a.id WHERE a.parent = 'r.1'")(lambda spark, sf_dir: ports.below(instances(spark, sf_dir), "r.1", 2))
table_query("collapsed_instances", tables_only + "SELECT min(id) AS id, module_type, count(*) AS n FROM i GROUP BY 2")(lambda spark, sf_dir: ports.collapsed(instances(spark, sf_dir), 5))
table_query("class_depths", tables_only + ", d AS (SELECT id, 'r.' || n_regionkey AS top, CAST(1 AS BIGINT) AS depth FROM i JOIN nation ON id = 'n.'||n_nationkey) SELECT id, depth, top FROM d UNION ALL SELECT 's.'||s_suppkey, CAST(2 AS BIGINT), top FROM supplier JOIN d ON d.id = 'n.'||s_nationkey UNION ALL SELECT DISTINCT top, CAST(0 AS BIGINT), top FROM d")(lambda spark, sf_dir: traverse.depths(instances(spark, sf_dir)))
table_query("class_descendants", tables_only + "SELECT id, CAST(1 AS BIGINT) AS level FROM i WHERE parent = 'r.2' UNION ALL SELECT b.id, CAST(2 AS BIGINT) FROM i a JOIN i b ON b.parent = a.id WHERE a.parent = 'r.2'")(lambda spark, sf_dir: traverse.descendants(instances(spark, sf_dir), "r.2"))
table_query("not_extracted", "WITH " + PORTS + ", g AS (SELECT DISTINCT instance FROM prt WHERE instance NOT IN (SELECT 's.'||s_suppkey FROM supplier WHERE s_acctbal > 0)) SELECT count(*) AS n, (SELECT coalesce(string_agg(instance, ',' ORDER BY instance), '') FROM (SELECT instance FROM g ORDER BY 1 LIMIT 20)) AS first FROM g")(
    lambda spark, sf_dir: ports.not_extracted(supplied(spark, sf_dir), tables.table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s."), "s_suppkey").alias("id"))).select("n", F.array_join("first", ",").alias("first")))

# Drivers in detail, chains

FIRST = ", fd AS (SELECT dst AS id, min(src) AS src FROM top WHERE kind = 'DRIVER' GROUP BY dst), fe AS (SELECT t.dst AS id, t.condition, t.clock_domain FROM top t JOIN fd ON fd.id = t.dst AND fd.src = t.src WHERE t.kind = 'DRIVER')"
graph_query("driver_details", FIRST + """, d AS (SELECT DISTINCT dst AS id, src AS driver FROM e WHERE dst IN ('p.4', 'o.9', 'c.3')),
c AS (SELECT s.src AS id, arg_min(k.clock_domain, k.dst) AS guess FROM pairs s JOIN e k ON k.dst = s.dst AND k.kind = 'CLOCK' GROUP BY 1),
x AS (SELECT d.id, d.driver, v.kind, t.expression, t.condition, CASE WHEN t.clock_domain = '' THEN coalesce(c.guess, '') ELSE t.clock_domain END AS clock_domain FROM d JOIN v ON v.id = d.driver JOIN top t ON t.src = d.driver AND t.dst = d.id LEFT JOIN c ON c.id = d.id)
SELECT id, driver, kind, expression, condition, clock_domain, CASE WHEN condition <> '' THEN 'if (' || condition || ') ' ELSE '' END || id || CASE WHEN clock_domain <> '' THEN ' <= ' ELSE ' = ' END || expression || CASE WHEN clock_domain <> '' THEN '; // @' || clock_domain ELSE ';' END AS statement FROM x""")(
    lambda g: reports.driver_details(g, starts(g, "id in ('p.4', 'o.9', 'c.3')"), 1).select("id", "driver", "kind", "expression", "condition", "clock_domain", "statement"))
graph_query("signal_chain", """, w AS (SELECT dst AS root, src AS id FROM e WHERE dst IN ('p.4', 'n.2', 'r.1') AND kind IN ('DRIVER', 'CONNECTION') UNION SELECT w.root, e.src FROM w JOIN e ON e.dst = w.id WHERE kind IN ('DRIVER', 'CONNECTION')),
q AS (SELECT id FROM v WHERE id IN ('p.4', 'n.2', 'r.1'))
SELECT id, (SELECT count(*) FROM w WHERE root = q.id) AS drivers, (SELECT count(*) FROM pairs WHERE src = q.id) AS loads, CASE WHEN (SELECT count(*) FROM w WHERE root = q.id) > 0 THEN 'high' ELSE 'uncertain' END AS confidence FROM q""")(lambda g: reports.signal_chain(g, starts(g, "id in ('p.4', 'n.2', 'r.1')")))
graph_query("through_connections", """, w AS (SELECT 'r.2' AS root, 'r.2' AS id UNION SELECT w.root, e.dst FROM w JOIN e ON e.src = w.id WHERE kind IN ('DRIVER', 'CONNECTION'))
SELECT DISTINCT root, e.dst AS id FROM w JOIN e ON e.src = w.id AND e.kind = 'DRIVER'""")(lambda g: reports.through_connections(g, starts(g, "id = 'r.2'")))
graph_query("impact_depth", """, w AS (SELECT src AS root, dst AS id, 1 AS l FROM e WHERE src IN ('c.7', 's.2', 'p.1') AND kind IN ('DRIVER', 'CONNECTION') UNION SELECT w.root, e.dst, l + 1 FROM w JOIN e ON e.src = w.id WHERE kind IN ('DRIVER', 'CONNECTION') AND l < 200),
m AS (SELECT root, id, min(l) AS l FROM w GROUP BY 1, 2) SELECT v.id AS root, CAST(coalesce((SELECT max(l) FROM m WHERE root = v.id), 0) + 1 AS BIGINT) AS rounds FROM v WHERE id IN ('c.7', 's.2', 'p.1')""")(lambda g: reports.impact_depth(g, starts(g, "id in ('c.7', 's.2', 'p.1')")).select("root", big("rounds")))

# Modules

graph_query("port_edges", "SELECT src AS port, 'input' AS side, dst AS src, src AS dst, kind, condition FROM top WHERE src IN (SELECT id FROM v WHERE module = 'clk')")(lambda g: reports.port_edges(_reversed(g), "clk"))


def _reversed(g: PropertyGraph) -> PropertyGraph:
    back = {"src": F.col("dst").alias("src"), "dst": F.col("src").alias("dst")}
    return PropertyGraph(g.vertices, g.edges.select(*[back.get(c, F.col(c)) for c in g.edges.columns]))


graph_query("module_report", """, a AS (SELECT e.*, x.module AS sm, y.module AS dm FROM e JOIN v x ON x.id = e.src JOIN v y ON y.id = e.dst)
SELECT 'internal' AS part, src, dst, kind, condition FROM a WHERE sm = 'nation' AND dm = 'nation' UNION ALL SELECT 'cross', src, dst, kind, condition FROM a WHERE (sm = 'nation') <> (dm = 'nation')""")(lambda g: reports.module_report(g, "nation"))
graph_query("module_caveats", "SELECT id, 'unconnected input port' AS caveat FROM v WHERE module = 'region' AND kind = 'PORT_IN' AND id NOT IN (SELECT dst FROM e)")(lambda g: reports.caveats(g, "region"))
graph_query("module_confidence", ", a AS (SELECT e.src, e.dst FROM e JOIN v x ON x.id = e.src JOIN v y ON y.id = e.dst WHERE x.module = 'nation' OR y.module = 'nation') SELECT CASE WHEN count(*) > 0 THEN 'medium' ELSE 'high' END AS confidence FROM a WHERE dst LIKE 's.%'")(lambda g: reports.module_confidence(g, "nation", g.edges.where("dst like 's.%'")))

# Clock domains, timing, pipelines

graph_query("clock_report", DOM + """, r AS (SELECT domain, count(*) AS n FROM dom GROUP BY 1), c AS (SELECT src_domain, count(*) AS n FROM cdc GROUP BY 1)
SELECT v.id AS clock, coalesce(r.n, 0) AS registers, CAST(0 AS BIGINT) AS combinational, coalesce(c.n, 0) AS crossings, CAST(0 AS BIGINT) AS resets, CASE WHEN coalesce(c.n, 0) = 0 THEN 'high' WHEN c.n > 5 THEN 'low' ELSE 'medium' END AS confidence,
 concat_ws('; ', CASE WHEN r.n IS NULL THEN 'no registers' END, CASE WHEN r.n > 0 THEN 'no reset tree' END, CASE WHEN c.n > 5 THEN 'crossings without synchronisers' END) AS caveats FROM v LEFT JOIN r ON r.domain = v.id LEFT JOIN c ON c.src_domain = v.id WHERE v.is_clock""")(reports.clock_report)
graph_query("cdc_violations", DOM + "SELECT src_domain AS clock, src, dst FROM cdc WHERE src_domain IN (SELECT src_domain FROM cdc GROUP BY 1 HAVING count(*) > 5)")(reports.cdc_violations)
graph_query("cdc_report", DOM + """, same AS (SELECT DISTINCT e.src, e.dst FROM e JOIN dom a ON a.id = e.src JOIN dom b ON b.id = e.dst WHERE kind = 'DRIVER' AND a.domain = b.domain),
w AS (SELECT DISTINCT dst AS root, dst AS id FROM cdc UNION SELECT w.root, s.dst FROM w JOIN same s ON s.src = w.id), n AS (SELECT root, count(DISTINCT id) AS n FROM w GROUP BY 1)
SELECT src_domain, dst_domain, CASE WHEN n.n = 1 THEN 'NONE' ELSE n.n || '-FLOP' END AS sync, count(*) AS n, count(*) FILTER (n.n = 1) AS high_risk FROM cdc JOIN n ON n.root = cdc.dst GROUP BY 1, 2, 3""")(reports.cdc_report)
port_query("clock_nets", "SELECT 'domain.' || lower(split_part(id, '.', 2)) AS domain, id FROM v WHERE is_clock")(lambda g, p: ports.clock_nets(g, p))
EVENT_REACH = ", w AS (SELECT src, dst FROM ev UNION SELECT w.src, ev.dst FROM w JOIN ev ON ev.src = w.dst)"
graph_query("scc", plain=tables.SQL + EVENT_REACH + " SELECT a.src AS id, min(a.dst) AS component FROM w a JOIN w b ON b.src = a.dst AND b.dst = a.src GROUP BY 1", graph=tables.events)(lambda g: domains.components(g.edges))
graph_query("scc_of_trade", "SELECT id, id AS component FROM v WHERE false")(lambda g: domains.components(g.edges))
graph_query("condensed", """, c AS (SELECT 'n.'||n_nationkey AS id, min('n.'||n_nationkey) OVER (PARTITION BY n_regionkey) AS c FROM nation)
SELECT DISTINCT c.c AS src, e.dst FROM e JOIN c ON c.id = e.src WHERE kind = 'CONNECTION' AND e.dst NOT LIKE 'n.%'""")(lambda g: domains.condensed(_both_ways(g)))
graph_query("region_components", plain="SELECT 'n.'||n_nationkey AS id, min('n.'||n_nationkey) OVER (PARTITION BY n_regionkey) AS component FROM nation UNION ALL SELECT 'r.'||n_regionkey, min('n.'||n_nationkey) FROM nation GROUP BY 1")(lambda g: domains.components(_both_ways(g)))


def _both_ways(g: PropertyGraph) -> DataFrame:
    """The connections, and those of regions backwards too: a region and its nations are a cycle."""
    e = g.edges.where("kind = 'CONNECTION'").select("src", "dst")
    return e.union(e.where("src like 'r.%'").select("dst", "src"))


graph_query("pipeline_registers", CLASS + "SELECT v.id, CASE WHEN contains(lower(name), 'state') OR contains(lower(name), 'fsm') THEN 'state' WHEN class = 'CONTROL' THEN 'control' ELSE 'pipeline' END AS role FROM v JOIN cls USING (id) WHERE kind = 'REG'")(reports.pipeline_registers)


def wide(g: PropertyGraph) -> PropertyGraph:
    """Orders as registers of 32 bits, so that they are pipeline registers by their class."""
    order = F.col("id").like("o.%")
    v = g.vertices.withColumn("width_msb", F.when(order, 31).otherwise(F.col("width_msb"))).withColumn("name", F.when(order, F.lit("q")).otherwise(F.col("name")))
    return PropertyGraph(v, g.edges, buckets=g.buckets)


graph_query("pipeline_stages", """, w AS (SELECT 'c.'||c_custkey AS id, 0 AS d FROM customer UNION SELECT e.dst, d + 1 FROM w JOIN e ON e.src = w.id JOIN v ON v.id = e.dst AND v.kind = 'REG' WHERE e.kind = 'DRIVER')
SELECT id, CAST(min(d) AS BIGINT) AS stage FROM w WHERE id LIKE 'o.%' GROUP BY 1""")(lambda g: reports.pipeline_stages(wide(g)).where("id like 'o.%'"))
graph_query("folded_stages", plain="SELECT CAST(floor((r - 1) / 2) AS BIGINT) AS fold, min(stage) AS first, max(stage) AS last, count(*) AS n FROM (SELECT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS stage, dense_rank() OVER (ORDER BY CAST(substr(o_orderpriority, 1, 1) AS BIGINT)) AS r FROM orders) GROUP BY 1")(
    lambda g: reports.folded(g.vertices.where("id like 'o.%'").select("id", F.substring("module", 1, 1).cast("bigint").alias("stage")), 2).drop("ids"))

# Scores, views, control

graph_query("degree_score", """, s AS (SELECT id, fan_in * 3 + fan_out * 2 + (CASE WHEN fan_in >= 3 THEN 15 ELSE 0 END) + (CASE WHEN fan_out >= 3 THEN 10 ELSE 0 END) + (CASE WHEN kind = 'REG' THEN 15 ELSE 0 END) + fan_in * 2 AS score, greatest(fan_in, fan_out) AS m FROM deg JOIN v USING (id))
SELECT id, CAST(score AS BIGINT) AS score, CASE WHEN score >= 40 THEN 'CRITICAL' WHEN score >= 25 THEN 'HIGH' WHEN score >= 15 THEN 'MEDIUM' ELSE 'LOW' END AS level, CASE WHEN m >= 5 THEN 'HIGH' WHEN m >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS bucket FROM s""")(reports.degree_score)
graph_query("riskiest_edges", """, s AS (SELECT id, fan_in * 3 + fan_out * 2 + (CASE WHEN fan_in >= 3 THEN 15 ELSE 0 END) + (CASE WHEN fan_out >= 3 THEN 10 ELSE 0 END) + (CASE WHEN kind = 'REG' THEN 15 ELSE 0 END) + fan_in * 2 AS score FROM deg JOIN v USING (id))
SELECT p.src, p.dst, CAST(a.score + b.score AS BIGINT) AS score FROM pairs p JOIN s a ON a.id = p.src JOIN s b ON b.id = p.dst ORDER BY 3 DESC, 1, 2 LIMIT 40""")(lambda g: reports.riskiest_edges(g, 40))
graph_query("visible_edges", "SELECT src, dst, kind FROM top WHERE kind NOT IN ('CLOCK', 'RESET')")(lambda g: reports.visible_edges(g).select("src", "dst", "kind"))
graph_query("top_level", "SELECT id FROM v")(lambda g: reports.top_level(g).select("id"))
graph_query("conditions_of", "SELECT DISTINCT src, condition FROM e WHERE dst = 'p.11' AND condition <> ''")(lambda g: domains.conditions_of(g, "p.11"))
graph_query("dependent_conditions", "SELECT DISTINCT condition FROM e WHERE condition = 'R'")(lambda g: domains.dependent_conditions(g.edges.select("condition").distinct(), "R"))
graph_query("modules_of_paths", "SELECT a.src || '>' || a.dst || '>' || b.dst AS path, 'c,o,p' AS modules FROM (SELECT DISTINCT src, dst FROM e WHERE kind = 'DRIVER' AND src LIKE 'c.1%') a JOIN (SELECT DISTINCT src, dst FROM e WHERE kind = 'DRIVER' AND dst LIKE 'p.%') b ON b.src = a.dst")(
    lambda g: reports.modules_of_paths(_customer_paths(g)).select(F.array_join("path", ">").alias("path"), F.array_join("modules", ",").alias("modules")))


def _customer_paths(g: PropertyGraph) -> DataFrame:
    e = g.edges.where("kind = 'DRIVER'").select("src", "dst").distinct()
    return e.where("src like 'c.1%'").select("src", F.col("dst").alias("mid")).join(e.where("dst like 'p.%'").select(F.col("src").alias("mid"), "dst"), "mid").select(F.array("src", "mid", "dst").alias("path"))



# Passes

graph_query("special_signals", "SELECT id, contains(lower(name), 'clk') OR contains(lower(name), 'clock') AS is_clock, contains(lower(name), 'rst') OR contains(lower(name), 'reset') AS is_reset FROM v")(lambda g: passes.mark_special(g).vertices.select("id", "is_clock", "is_reset"))
graph_query("upgraded_registers", "SELECT id, CASE WHEN id IN (SELECT dst FROM e WHERE kind = 'CLOCK') THEN 'REG' ELSE kind END AS kind FROM (SELECT id, CASE WHEN id LIKE 'o.%' THEN 'SIGNAL' ELSE kind END AS kind FROM v)")(
    lambda g: passes.upgrade_registers(PropertyGraph(g.vertices.withColumn("kind", F.when(F.col("id").like("o.%"), "SIGNAL").otherwise(F.col("kind"))), g.edges)).vertices.select("id", "kind"))
graph_query("under_target", "SELECT e.src, e.dst, e.kind FROM e WHERE (src LIKE 'r.%' OR src LIKE 'n.%') AND (dst LIKE 'r.%' OR dst LIKE 'n.%')")(lambda g: passes.under(g, ["r", "n"]).edges.select("src", "dst", "kind"))
BITS = "b AS (SELECT p_partkey AS k, p_size AS s FROM part)"
table_query("bit_parents", f"WITH {BITS} SELECT 'p.' || k || '[' || s || ':0]' AS src, 'p.' || k AS dst FROM b")(lambda spark, sf_dir: passes.bit_parents(_vectors(spark, sf_dir)).edges.where("kind = 'BIT_SELECT'").select("src", "dst"))
table_query("bit_spans", f"WITH {BITS} SELECT 'p.' || k || '[' || s || ':0]' AS id, 'p.' || k AS parent, s AS msb, 0 AS lsb, s + 1 AS width FROM b")(lambda spark, sf_dir: passes.bit_spans(_vectors(spark, sf_dir)))


def _vectors(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    p = tables.table(spark, sf_dir, "part").select(F.format_string("p.%s[%s:0]", F.col("p_partkey").cast("string"), F.col("p_size").cast("string")).alias("id"))
    return PropertyGraph.of(p.withColumn("name", F.col("id")), spark.createDataFrame([], "src string, dst string"), placeholders=False)


def _structs(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Orders as structs of a key and a status; each drives the next of its customer as a whole."""
    o = tables.trade(spark, sf_dir)
    e = o.edges.where("kind = 'DRIVER' and src like 'o.%' and dst like 'o.%'").select("src", "dst")
    ids = o.vertices.where("id like 'o.%'").select("id")
    parts = ids.select(F.explode(F.array(F.concat("id", F.lit(".key")), F.concat("id", F.lit(".status")))).alias("id"))
    return PropertyGraph.of(ids.union(parts), e, placeholders=False)


table_query("expanded_structs", G + ", o AS (SELECT src, dst FROM e WHERE kind = 'DRIVER' AND src LIKE 'o.%' AND dst LIKE 'o.%'), m(m) AS (VALUES ('key'), ('status')) SELECT src || '.' || m AS src, dst || '.' || m AS dst, 'DRIVER' AS kind FROM o, m UNION ALL SELECT src, dst, 'DRIVER' FROM o UNION ALL SELECT 'o.' || o_orderkey || '.' || m, 'o.' || o_orderkey, 'BIT_SELECT' FROM orders, m")(
    lambda spark, sf_dir: passes.expand_structs(_structs(spark, sf_dir)).edges.select("src", "dst", "kind"))

# Handshakes

SHAKE = """WITH s AS (SELECT 'u.' || o_orderkey || '_ready' AS id, CASE WHEN o_orderstatus = 'O' THEN 'PORT_IN' ELSE 'SIGNAL' END AS kind FROM orders),
d AS (SELECT 'u.' || o_orderkey || '_ready' AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'a_valid && a_ready' WHEN '2-HIGH' THEN 'x_req || y_req' WHEN '3-MEDIUM' THEN 'state == RUN' ELSE '' END AS condition,
  CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN '!fifo_full' WHEN '5-LOW' THEN 'nxt' ELSE '' END AS expression FROM orders WHERE o_orderstatus <> 'P')
"""


def _drivers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o, p = tables.table(spark, sf_dir, "orders"), F.col("o_orderpriority")
    id = F.concat(F.lit("u."), "o_orderkey", F.lit("_ready")).alias("id")
    signals = o.select(id, F.when(F.col("o_orderstatus") == "O", "PORT_IN").otherwise("SIGNAL").alias("kind"))
    condition = F.when(p == "1-URGENT", "a_valid && a_ready").when(p == "2-HIGH", "x_req || y_req").when(p == "3-MEDIUM", "state == RUN").otherwise("")
    expression = F.when(p.startswith("4"), "!fifo_full").when(p == "5-LOW", "nxt").otherwise("")
    return signals, o.where("o_orderstatus != 'P'").select(id, condition.alias("condition"), expression.alias("expression"), F.lit("always_ff").alias("assign_type"))


table_query("handshake_classes", SHAKE + """SELECT s.id, CASE WHEN d.id IS NULL THEN CASE WHEN kind = 'PORT_IN' THEN 'PORT_PASSTHROUGH' ELSE 'UNUSED' END WHEN condition LIKE '%&&%' THEN 'STANDARD_AXI' WHEN condition LIKE '%||%' THEN 'COMPLEX_ARB' WHEN condition <> '' THEN 'CONDITIONAL_CTRL' WHEN expression LIKE '!%' THEN 'COMBINATIONAL_BP' ELSE 'REGISTERED_BP' END AS handshake,
 coalesce(condition, '') AS condition, CAST(CASE WHEN d.id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_drivers FROM s LEFT JOIN d ON d.id = s.id""")(lambda spark, sf_dir: handshake.classify(*_drivers(spark, sf_dir)).drop("channel"))
table_query("handshake_scan", """WITH p AS (SELECT DISTINCT 'b' || (o_custkey % 7) AS b, o_orderpriority AS m FROM orders) SELECT m || '.' || b || '_valid_i' AS valid, m || '.' || b || '_ready_o' AS ready FROM p""")(
    lambda spark, sf_dir: handshake.pairs(_pairs(spark, sf_dir)))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.table(spark, sf_dir, "orders").select(F.concat("o_orderpriority", F.lit(".b"), F.col("o_custkey") % 7).alias("b")).distinct()
    return o.select(F.explode(F.array(F.concat("b", F.lit("_valid_i")), F.concat("b", F.lit("_ready_o")))).alias("id"))


table_query("names_by_role", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'valid' WHEN 1 THEN 'ready' WHEN 2 THEN 'data' WHEN 3 THEN 'strb' ELSE 'unknown' END AS role FROM part")(lambda spark, sf_dir: tables.table(spark, sf_dir, "part").select("p_partkey", S.role_of_name(F.element_at(F.array(*map(F.lit, ("m_VLD", "x_rdy", "wdata", "w_be", "zz"))), F.col("p_size") % 5 + 1)).alias("role")))
table_query("expression_atoms", "SELECT p_partkey, 'a' || p_size || '[3:0],b.c,' || 'd[' || (p_size % 4) || ']' AS atoms FROM part")(lambda spark, sf_dir: tables.table(spark, sf_dir, "part").select("p_partkey", F.array_join(S.atomics(F.format_string("a%s[3:0] & 4'b10x0 | (b.c + d[%s]) or a%s[3:0]", F.col("p_size").cast("string"), (F.col("p_size") % 4).cast("string"), F.col("p_size").cast("string"))), ",").alias("atoms")))
table_query("name_colours", "SELECT n_name, '#' || CASE WHEN r + g + b < 350 THEN printf('%02x%02x%02x', greatest(r, 80), greatest(g, 80), greatest(b, 80)) ELSE printf('%02x%02x%02x', r, g, b) END AS colour FROM (SELECT n_name, CAST('0x' || substr(md5(n_name), 1, 2) AS INT) AS r, CAST('0x' || substr(md5(n_name), 3, 2) AS INT) AS g, CAST('0x' || substr(md5(n_name), 5, 2) AS INT) AS b FROM nation)")(lambda spark, sf_dir: tables.table(spark, sf_dir, "nation").select("n_name", S.colour(F.col("n_name")).alias("colour")))
graph_query("data_flow", EDGE_CLASS.replace("SELECT class, kind, key_control, confidence, count(*) AS n FROM (", "SELECT class, kind, count(*) AS n FROM (").replace("GROUP BY 1, 2, 3, 4", "WHERE class = 'DATA' OR key_control GROUP BY 1, 2"))(lambda g: reports.data_flow(g).groupBy("class", "kind").agg(F.count("*").alias("n")))
graph_query("data_path", CLASS + "SELECT id FROM cls WHERE class IN ('DATA', 'CONTROL')")(reports.data_path)

# Atoms, evidence, views


@graph_query("signal_atoms", """, f AS (SELECT DISTINCT dst AS root, unnest(regexp_extract_all(condition, '[A-Za-z_$][A-Za-z0-9_$.]*')) AS atom FROM top WHERE condition <> '' UNION SELECT dst, src FROM top WHERE condition <> ''),
a(root, id, level) AS (SELECT root, atom, CAST(0 AS BIGINT) FROM f UNION SELECT a.root, t.src, a.level + 1 FROM a JOIN v ON v.id = a.id AND NOT v.is_port JOIN top t ON t.dst = a.id)
SELECT root, id AS atom, min(level) AS level FROM a GROUP BY 1, 2""")
def signal_atoms(g: PropertyGraph) -> DataFrame:
    """Every vertex as a signal, each edge's expression being its source's name."""
    return decompose.atoms(PropertyGraph(g.vertices, g.edges.withColumn("expression", F.col("src")), buckets=g.buckets), g.vertices.select(F.col("id").alias("root")), None)


@table_query("order_evidence", """SELECT id, expression, CAST(1 AS BIGINT) AS snippets, x AS matches_expression, n AS matches_name, CAST(2 + CASE WHEN x THEN 4 ELSE 0 END + CASE WHEN n THEN 2 ELSE 0 END + CASE WHEN x AND n THEN 2 ELSE 0 END AS BIGINT) AS credibility, x OR n AS verified
FROM (SELECT 'o.'||o_orderkey AS id, expression, contains(t, expression) AS x, contains(t, CAST(o_orderkey AS VARCHAR)) AS n FROM (SELECT o_orderkey, o_orderpriority AS expression, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority || ' F' ELSE o_orderkey || ' ' || o_orderstatus END AS t FROM orders))""")
def order_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order; finished ones have a snippet with their priority, others one with their key."""
    o = tables.table(spark, sf_dir, "orders").withColumn("id", F.concat(F.lit("o."), "o_orderkey"))
    text = F.when(F.col("o_orderstatus") == "F", F.concat("o_orderpriority", F.lit(" F"))).otherwise(F.concat_ws(" ", "o_orderkey", "o_orderstatus"))
    return decompose.evidence(tables.trade(spark, sf_dir), o.select("id"), o.select("id", F.lit("always").alias("kind"), text.alias("text")))


graph_query("view_nodes", CLASS + "SELECT v.id, v.kind, CAST(greatest(0, width_msb - width_lsb + 1) AS BIGINT) AS width, c.class, CASE WHEN greatest(fan_in, fan_out) >= 5 THEN 'HIGH' WHEN greatest(fan_in, fan_out) >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM v JOIN cls c ON c.id = v.id JOIN deg ON deg.id = v.id")(
    lambda g: export.view_nodes(g).select("id", "kind", "width", "class", "risk"))
