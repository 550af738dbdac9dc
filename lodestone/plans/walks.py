"""More registered graph queries: register depth and paths, conditions of statements, searches between sets, folding of constants,
inlining of calls, schedules of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..operators import constants, elaborate, inline, search, statements, timing
from ..sources import tables
from .catalog import G, big, graph_query, table_query

def all_depths(g: PropertyGraph) -> DataFrame:
    return g.kept("register depths over data edges", lambda: timing.register_depths(g, timing.data_graph(g)), "id")


# Register depth: first visits from the inputs, by hops, then by the smallest parent.

VISITS = """,
kind AS (SELECT id, kind FROM v),
start AS (SELECT id FROM v WHERE kind = 'PORT_IN' AND NOT is_clock),
link AS (
  SELECT DISTINCT src, dst FROM e JOIN kind a ON a.id = src JOIN kind b ON b.id = dst
  WHERE e.kind NOT IN ('CLOCK', 'RESET') AND {touching}),
walk AS (
  SELECT id, 0 AS hops FROM start
  UNION SELECT link.dst, hops + 1 FROM walk JOIN link ON link.src = walk.id),
near AS (SELECT id, min(hops) AS hops FROM walk GROUP BY id),
tree AS (
  SELECT n.id, n.hops, min(p.id) AS parent
  FROM near n LEFT JOIN link ON link.dst = n.id AND n.hops > 0 LEFT JOIN near p ON p.id = link.src AND p.hops = n.hops - 1
  GROUP BY n.id, n.hops),
deep AS (
  SELECT tree.id, hops, parent, 0 AS depth, tree.id AS path, '' AS regs, 0 AS score, 0 AS n_regs FROM tree WHERE hops = 0
  UNION ALL
  SELECT t.id, t.hops, t.parent, d.depth + (k.kind = 'REG')::INT, d.path || '>' || t.id,
         d.regs || CASE WHEN k.kind = 'REG' THEN CASE WHEN d.regs = '' THEN '' ELSE '>' END || t.id ELSE '' END,
         d.score + CASE WHEN k.kind = 'REG' THEN d.depth + 1 ELSE 0 END, d.n_regs + (k.kind = 'REG')::INT
  FROM deep d JOIN tree t ON t.parent = d.id AND t.hops = d.hops + 1 JOIN kind k ON k.id = t.id)
"""
TOUCHING, ALL = "('REG' IN (a.kind, b.kind) OR src IN (SELECT id FROM start))", "true"

graph_query("register_depths", VISITS.format(touching=TOUCHING) + "SELECT d.id, kind.kind, CAST(hops AS BIGINT) AS hops, parent, CAST(depth AS BIGINT) AS depth FROM deep d JOIN kind USING (id)")(timing.register_depths)
graph_query("register_depths_all", VISITS.format(touching=ALL) + "SELECT d.id, kind.kind, CAST(hops AS BIGINT) AS hops, parent, CAST(depth AS BIGINT) AS depth FROM deep d JOIN kind USING (id)")(
    lambda g: all_depths(g))

TOP_PATHS = """,
first AS (SELECT d.*, row_number() OVER (ORDER BY depth DESC, d.id) AS r FROM deep d JOIN kind USING (id) WHERE kind = 'REG' AND depth > 0)
SELECT id AS target, CAST(depth AS BIGINT) AS depth, CAST(score AS BIGINT) AS score, path, regs AS registers, CAST(n_regs AS BIGINT) AS cycles, CAST({combinational} AS BIGINT) AS combinational,
       CASE WHEN n_regs >= 5 THEN 'CRITICAL' WHEN n_regs >= 3 THEN 'HIGH' WHEN n_regs >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
       CASE WHEN {combinational} > n_regs OR n_regs >= 5 THEN 'HIGH' WHEN {combinational} > 0 AND n_regs >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS violation
FROM first WHERE r <= 5
"""
# On every path of these graphs the one step between two vertices of no register that leaves logic is that from a nation to a customer.
STEP = "(CASE WHEN contains(path, '>c.') THEN 1 ELSE 0 END)"
graph_query("register_paths", VISITS.format(touching=ALL) + TOP_PATHS.format(combinational=STEP))(
    lambda g: timing.register_paths(g, all_depths(g), 5))

def from_customers(g: PropertyGraph) -> DataFrame:
    return timing.longest_over_cycles(timing.data_graph(g), g.vertices.where("id like 'c.%'").select("id")).select("component", "length")


graph_query("longest_paths", """,
walk AS (
  SELECT 'c.' || c_custkey AS id, 0 AS d FROM customer
  UNION SELECT e.dst, d + 1 FROM walk JOIN e ON e.src = walk.id WHERE e.kind NOT IN ('CLOCK', 'RESET'))
SELECT id AS component, CAST(max(d) AS BIGINT) AS length FROM walk GROUP BY id
""")(from_customers)


# Statements: regions branch by nation, customers are cases of a segment with an item for each order, the order's line numbers
# are a choice between its lines.

STATEMENTS = """
WITH RECURSIVE s AS (
  SELECT 'if.' || r_regionkey AS id, NULL AS parent, CAST(r_regionkey AS BIGINT) AS position, 'if' AS kind, '' AS condition FROM region
  UNION ALL
  SELECT 'branch.' || n_nationkey, 'if.' || n_regionkey, n_nationkey, 'branch',
         CASE WHEN n_nationkey = max(n_nationkey) OVER (PARTITION BY n_regionkey) THEN '' WHEN n_nationkey % 3 = 0 THEN n_name || ' > ' || n_nationkey ELSE n_name END
  FROM nation
  UNION ALL
  SELECT 'case.' || c_custkey, 'branch.' || c_nationkey, c_custkey, 'case', 'segment_' || (c_custkey % 5) FROM customer
  UNION ALL
  SELECT 'item.' || o_orderkey, 'case.' || o_custkey, o_orderkey, 'item', CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END FROM orders
  UNION ALL
  SELECT 'choice.' || o_orderkey, 'item.' || o_orderkey, 0, 'choice', 'urgent' || (o_orderkey % 2) FROM orders
  UNION ALL
  SELECT 'value.' || o_orderkey || '.' || k, 'choice.' || o_orderkey, k, 'assign', '' FROM orders, (VALUES (0), (1)) AS two(k)),
"""


def statement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as a tree of statements, as STATEMENTS has it."""
    t = lambda n: tables.table(spark, sf_dir, n)
    name = lambda kind, *cols: F.concat(F.lit(kind), *[F.concat(F.lit("."), F.col(c) if isinstance(c, str) else c) for c in cols])
    lit = F.lit
    nation = t("nation").join(t("nation").groupBy("n_regionkey").agg(F.max("n_nationkey").alias("last")), "n_regionkey")
    named = F.when(F.col("n_nationkey") == F.col("last"), "").when(F.col("n_nationkey") % 3 == 0, F.concat("n_name", lit(" > "), "n_nationkey")).otherwise(F.col("n_name"))
    two = t("orders").select("o_orderkey", F.explode(F.array(lit(0), lit(1))).alias("k"))
    parts = [
        t("region").select(name("if", "r_regionkey").alias("id"), lit(None).cast("string").alias("parent"), big("position", F.col("r_regionkey")), lit("if").alias("kind"), lit("").alias("condition")),
        nation.select(name("branch", "n_nationkey"), name("if", "n_regionkey"), big("position", F.col("n_nationkey")), lit("branch"), named),
        t("customer").select(name("case", "c_custkey"), name("branch", "c_nationkey"), big("position", F.col("c_custkey")), lit("case"), F.concat(lit("segment_"), F.col("c_custkey") % 5)),
        t("orders").select(name("item", "o_orderkey"), name("case", "o_custkey"), big("position", F.col("o_orderkey")), lit("item"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))),
        t("orders").select(name("choice", "o_orderkey"), name("item", "o_orderkey"), big("position", lit(0)), lit("choice"), F.concat(lit("urgent"), F.col("o_orderkey") % 2)),
        two.select(name("value", "o_orderkey", "k"), name("choice", "o_orderkey"), big("position", F.col("k")), lit("assign"), lit("")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


table_query("path_conditions", STATEMENTS + """
no AS (SELECT id, CASE WHEN regexp_full_match(condition, '[A-Za-z0-9_]+') THEN '!' || condition ELSE '!(' || condition || ')' END AS no FROM s),
own AS (
  SELECT b.id, b.parent, b.kind, array_to_string(list_concat(coalesce(list(no.no ORDER BY a.position) FILTER (WHERE a.condition <> ''), []), CASE WHEN b.condition = '' THEN [] ELSE [b.condition] END), ' && ') AS own
  FROM s b LEFT JOIN s a ON a.parent = b.parent AND a.position < b.position LEFT JOIN no ON no.id = a.id WHERE b.kind = 'branch' GROUP BY b.id, b.parent, b.kind, b.condition
  UNION ALL SELECT i.id, i.parent, i.kind, c.condition || ' == ' || CASE WHEN i.condition = '' THEN 'default' ELSE i.condition END FROM s i JOIN s c ON c.id = i.parent WHERE i.kind = 'item'
  UNION ALL SELECT x.id, x.parent, x.kind, CASE WHEN x.position = 0 THEN c.condition ELSE '!(' || c.condition || ')' END FROM s x JOIN s c ON c.id = x.parent WHERE x.kind = 'assign'
  UNION ALL SELECT id, parent, kind, '' FROM s WHERE kind IN ('if', 'case', 'choice')),
deep AS (
  SELECT id, kind, 0 AS level, own AS condition FROM own WHERE parent IS NULL
  UNION ALL SELECT o.id, o.kind, level + 1, CASE WHEN d.condition = '' OR o.own = '' THEN d.condition || o.own ELSE d.condition || ' && ' || o.own END FROM deep d JOIN own o ON o.parent = d.id)
SELECT id, kind, CAST(level AS BIGINT) AS level, condition FROM deep
""")(lambda spark, sf_dir: statements.path_conditions(statement_rows(spark, sf_dir)))


# Searches between sets

LINKS = """,
pair AS (SELECT DISTINCT src, dst FROM e WHERE kind NOT IN ('CLOCK', 'RESET')),
walk AS (
  SELECT id AS root, id, 0 AS hops FROM v WHERE {starts}
  UNION SELECT root, pair.dst, hops + 1 FROM walk JOIN pair ON pair.src = walk.id),
near AS (SELECT root, id, min(hops) AS hops FROM walk GROUP BY root, id),
tree AS (
  SELECT n.root, n.id, n.hops, min(p.id) AS parent
  FROM near n JOIN pair ON pair.dst = n.id JOIN near p ON p.root = n.root AND p.id = pair.src AND p.hops = n.hops - 1
  WHERE n.hops > 0 GROUP BY n.root, n.id, n.hops),
trace AS (
  SELECT root AS src, id AS dst, hops AS pos, id, parent FROM tree WHERE {ends}
  UNION ALL SELECT t.src, t.dst, t.pos - 1, t.parent, p.parent FROM trace t LEFT JOIN tree p ON p.root = t.src AND p.id = t.parent WHERE t.parent IS NOT NULL)
"""
ENDS = {"starts": "id IN ('r.0', 'r.1', 'r.2')", "ends": "id LIKE 'p.%'"}


def region_paths(g: PropertyGraph) -> DataFrame:
    v = g.vertices.select("id")
    return g.kept("paths of regions to parts", lambda: search.shortest_paths(timing.data_graph(g), v.where(ENDS["starts"]), v.where(ENDS["ends"])))


graph_query("shortest_paths", LINKS.format(**ENDS) + "SELECT src, dst, CAST(pos AS BIGINT) AS pos, id FROM trace")(region_paths)

# All paths from a region to a supplier have two edges, so their order is that of their ends.
TO_SUPPLIERS = {"starts": "id LIKE 'r.%'", "ends": "id LIKE 's.%'"}
graph_query("chain", LINKS.format(**TO_SUPPLIERS) + """,
step AS (SELECT a.src AS s, a.dst AS d, a.id AS src, b.id AS dst FROM trace a JOIN trace b ON b.src = a.src AND b.dst = a.dst AND b.pos = a.pos + 1),
new AS (SELECT src, dst, min((s, d)) AS owner FROM step GROUP BY src, dst),
rank AS (SELECT owner, count(*) AS n, row_number() OVER (ORDER BY owner) - 1 AS r, sum(count(*)) OVER (ORDER BY owner) AS held FROM new GROUP BY owner),
cut AS (SELECT coalesce((SELECT min(r) FROM rank WHERE held - n > 30 - 2), (SELECT max(r) + 1 FROM rank)) AS first_left),
kept AS (SELECT r, owner, held FROM rank, cut WHERE r < first_left),
filled AS (SELECT r, owner FROM rank, cut WHERE r >= first_left AND held <= 30)
SELECT src, dst, CAST(r AS INT) AS taken FROM (SELECT r, owner FROM kept UNION ALL SELECT * FROM filled) JOIN new USING (owner)
""")(lambda g: search.chain(search.shortest_paths(timing.data_graph(g), g.vertices.where(TO_SUPPLIERS["starts"]).select("id"), g.vertices.where(TO_SUPPLIERS["ends"]).select("id")), 30))

graph_query("signal_paths", """,
pair AS (SELECT DISTINCT src, dst FROM e),
walk AS (
  SELECT ['r.3'] AS path, 'r.3' AS cur
  UNION ALL SELECT list_append(path, pair.dst), pair.dst FROM walk JOIN pair ON pair.src = walk.cur WHERE cur <> 'p.9' AND len(path) < 5 AND NOT list_contains(path, pair.dst))
SELECT 'r.3' AS src, 'p.9' AS dst, array_to_string(path, '>') AS path FROM walk WHERE cur = 'p.9'
""")(lambda g: search.signal_paths(g, "r.3[7:0]", "p.9[3]", 4).select("src", "dst", F.array_join("path", ">").alias("path")))

# At a part and an order every edge is a driver's or a clock's; customers and nations are entered by connections only.
graph_query("drivers_by_rules", """,
rule AS (
  SELECT e.dst AS at, CASE WHEN e.kind = 'DRIVER' OR (e.kind = 'CONNECTION' AND (v.kind = 'SIGNAL' OR (v.kind = 'PORT_IN' AND e.src NOT IN (SELECT dst FROM e)))) THEN e.src END AS adds,
         CASE WHEN e.kind <> 'CONNECTION' OR v.kind NOT IN ('SIGNAL', 'PORT_IN') THEN e.src END AS goes
  FROM e JOIN v ON v.id = e.src),
walk AS (
  SELECT id AS root, id FROM v WHERE id IN ('p.2', 'p.3', 'o.5', 'c.9', 's.4')
  UNION SELECT root, goes FROM walk JOIN rule ON rule.at = walk.id WHERE goes IS NOT NULL)
SELECT DISTINCT root, adds AS id FROM walk JOIN rule ON rule.at = walk.id WHERE adds IS NOT NULL AND adds <> root
""")(lambda g: search.drivers_of(g, g.vertices.where("id in ('p.2', 'p.3', 'o.5', 'c.9', 's.4')").select(F.col("id").alias("root"), "id")))


# Elaboration: an order's parts, as wide as their quantity, from its suppliers, each five bits for a line's number.

CONCAT = """
WITH p AS (
  SELECT l_orderkey AS assign, 'lhs' AS side, l_linenumber AS position, 'p.' || l_partkey AS name, CAST(l_quantity AS BIGINT) AS width FROM lineitem
  UNION ALL SELECT l_orderkey, 'rhs', -l_linenumber, 's.' || l_suppkey, 5 * l_linenumber FROM lineitem),
o AS (SELECT *, sum(width) OVER (PARTITION BY assign, side ORDER BY position DESC, name DESC, width DESC ROWS UNBOUNDED PRECEDING) AS hi FROM p),
r AS (SELECT *, hi - width AS lo FROM o)
SELECT l.assign, r.name AS src, l.name AS dst, CAST(least(l.hi, r.hi) - 1 - r.lo AS BIGINT) AS src_msb, CAST(greatest(l.lo, r.lo) - r.lo AS BIGINT) AS src_lsb,
       CAST(least(l.hi, r.hi) - 1 - l.lo AS BIGINT) AS dst_msb, CAST(greatest(l.lo, r.lo) - l.lo AS BIGINT) AS dst_lsb
FROM r l JOIN r ON r.assign = l.assign AND r.side = 'rhs' AND l.side = 'lhs' AND l.lo < r.hi AND r.lo < l.hi
"""


@table_query("concatenations", CONCAT)
def order_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = tables.table(spark, sf_dir, "lineitem")
    lhs = line.select(F.col("l_orderkey").alias("assign"), F.lit("lhs").alias("side"), F.col("l_linenumber").cast("bigint").alias("position"), F.concat(F.lit("p."), "l_partkey").alias("name"), F.col("l_quantity").cast("bigint").alias("width"))
    rhs = line.select("l_orderkey", F.lit("rhs"), -F.col("l_linenumber").cast("bigint"), F.concat(F.lit("s."), "l_suppkey"), 5 * F.col("l_linenumber").cast("bigint"))
    return elaborate.concatenations(lhs.union(rhs))


INHERIT = """
WITH c AS (
  SELECT 'c.' || c_custkey AS class, 'n.' || n_nationkey AS above, 'r.' || n_regionkey AS top, c_custkey % 3 = 0 AS b, n_nationkey % 2 = 0 AS a FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'n.' || n_nationkey, NULL, 'r.' || n_regionkey, false, n_nationkey % 2 = 0 FROM nation
  UNION ALL SELECT NULL, NULL, 'r.' || r_regionkey, false, false FROM region),
f AS (
  SELECT coalesce(class, top) AS class, 'a' AS name, CASE WHEN NOT a THEN top WHEN above IS NULL THEN class ELSE above END AS origin,
         CASE WHEN class IS NULL THEN 0 WHEN a THEN CASE WHEN above IS NULL THEN 0 ELSE 1 END WHEN above IS NULL THEN 1 ELSE 2 END AS level FROM c
  UNION ALL SELECT coalesce(class, top), 'b', CASE WHEN b THEN class ELSE top END, CASE WHEN class IS NULL OR b THEN 0 WHEN above IS NULL THEN 1 ELSE 2 END FROM c)
"""


def hierarchy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers below nations below regions; regions constrain a and b, even nations a anew, every third customer b. A constraint
    is a tree of three nodes."""
    t = lambda n: tables.table(spark, sf_dir, n)
    id_ = lambda p, c: F.concat(F.lit(f"{p}."), c)
    classes = t("nation").select(id_("n", "n_nationkey").alias("id"), id_("r", "n_regionkey").alias("parent")).union(t("customer").select(id_("c", "c_custkey"), id_("n", "c_nationkey")))
    own = t("region").select(id_("r", "r_regionkey").alias("class"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("name"))
    own = own.union(t("nation").where("n_nationkey % 2 = 0").select(id_("n", "n_nationkey"), F.lit("a"))).union(t("customer").where("c_custkey % 3 = 0").select(id_("c", "c_custkey"), F.lit("b")))
    own = own.withColumn("id", F.concat_ws(".", "class", "name"))
    top, middle = F.col("id"), F.concat("id", F.lit(".x"))
    nodes = own.select(top.alias("id"), F.lit(None).cast("string").alias("parent"), F.col("name").alias("text")).union(own.select(middle, top, F.lit("x"))).union(own.select(F.concat("id", F.lit(".y")), middle, F.lit("y")))
    return classes, own, nodes


table_query("inherited_constraints", INHERIT + "SELECT class, name, origin || '.' || name AS id, origin, CAST(level AS BIGINT) AS level FROM f")(lambda spark, sf_dir: elaborate.inherited(*hierarchy(spark, sf_dir)[:2]))


@table_query("copied_constraints", INHERIT + """
SELECT class, class || '::' || origin || '.' || name || suffix AS id, CASE WHEN suffix = '' THEN NULL ELSE class || '::' || origin || '.' || name || above END AS parent,
       origin || '.' || name || suffix AS "of", CASE WHEN suffix = '' THEN name ELSE substr(suffix, 2) END AS text
FROM f, (VALUES ('', ''), ('.x', ''), ('.y', '.x')) AS n(suffix, above) WHERE level > 0
""")
def copied_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, own, nodes = hierarchy(spark, sf_dir)
    return elaborate.copied(elaborate.inherited(classes, own), nodes)


# Constants: regions are parameters of a package, a nation's is made of its region's, a customer's of its nation's; orders' widths
# are in the scope of their customer. Quotients and remainders are rounded down.

def constant_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = lambda n: tables.table(spark, sf_dir, n)
    region = t("region").select(F.lit("pkg").alias("scope"), F.format_string("R%d", "r_regionkey").alias("name"), F.format_string("%d + 4'd3", "r_regionkey").alias("text"))
    nation = t("nation").select(F.format_string("n%d", "n_nationkey"), F.lit("BASE"), F.format_string("pkg::R%d * 2 + %d", "n_regionkey", "n_nationkey"))
    c = t("customer").withColumn("scope", F.format_string("c%d", "c_custkey"))
    wide = c.select("scope", F.lit("W"), F.format_string("n%d::BASE - %d %% 5", "c_nationkey", "c_custkey"))
    deep = c.select("scope", F.lit("D"), F.lit("(W + 2) * (W - 40) / 7"))
    loop = c.where("c_custkey % 4 = 0").select("scope", F.explode(F.array(F.struct(F.lit("X").alias("name"), F.lit("Y + 1").alias("text")), F.struct(F.lit("Y").alias("name"), F.lit("X - 1").alias("text")))).alias("p")).select("scope", "p.name", "p.text")
    o = t("orders")
    text = F.when(F.col("o_orderstatus") == "P", F.lit("X + D")).when(F.col("o_orderstatus") == "O", F.format_string("$clog2(D + W * W) - -%d %% 11", "o_orderkey")).otherwise(F.format_string("W-1 - (D / -%d)", "o_orderkey"))
    return region.union(nation).union(wide).union(deep).union(loop), o.select("o_orderkey", F.format_string("c%d", "o_custkey").alias("scope"), text.alias("text"))


CONSTANTS = """
WITH n AS (SELECT n_nationkey, n_regionkey, (n_regionkey + 3) * 2 + n_nationkey AS base FROM nation),
c AS (SELECT c_custkey, base - c_custkey % 5 AS w FROM customer JOIN n ON c_nationkey = n_nationkey),
d AS (SELECT *, CAST(floor((w + 2) * (w - 40) / 7) AS BIGINT) AS d FROM c),
p AS (
  SELECT 'pkg' AS scope, 'R' || r_regionkey AS name, r_regionkey || ' + 4''d3' AS text, r_regionkey + 3 AS value FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'BASE', 'pkg::R' || n_regionkey || ' * 2 + ' || n_nationkey, base FROM n
  UNION ALL SELECT 'c' || c_custkey, 'W', 'n' || c_nationkey || '::BASE - ' || c_custkey || ' % 5', w FROM c JOIN customer USING (c_custkey)
  UNION ALL SELECT 'c' || c_custkey, 'D', '(W + 2) * (W - 40) / 7', d FROM d
  UNION ALL SELECT 'c' || c_custkey, name, text, NULL FROM customer, (VALUES ('X', 'Y + 1'), ('Y', 'X - 1')) AS loop(name, text) WHERE c_custkey % 4 = 0)
"""

table_query("constant_parameters", CONSTANTS + "SELECT scope, name, text, CAST(value AS BIGINT) AS value FROM p")(lambda spark, sf_dir: constants.resolve(constant_rows(spark, sf_dir)[0]))


@table_query("constant_widths", CONSTANTS + """
SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'P' THEN NULL
  WHEN 'O' THEN CASE WHEN d + w * w <= 1 THEN 0 ELSE length(bin(d + w * w - 1)) END - (11 - o_orderkey % 11) % 11
  ELSE w - 1 - coalesce(floor(-d / nullif(o_orderkey, 0)), 0) END AS BIGINT) AS value
FROM orders JOIN d ON o_custkey = c_custkey
""")
def constant_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    parameters, expressions = constant_rows(spark, sf_dir)
    return constants.fold(expressions, constants.resolve(parameters)).select("o_orderkey", "value")


# Inlining: customers call the function of a region, which calls one for each of its nations, three of which call each other in a ring.

def call_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = lambda n: tables.table(spark, sf_dir, n)
    f, lit = F.format_string, F.lit
    c = t("customer").select(f("k%d", "c_custkey").alias("call"), f("f%d", F.col("c_custkey") % 5).alias("callee"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(lit("is_"), F.lower(F.substring("c_mktsegment", 1, 4)))).alias("condition"), "c_custkey")
    n = t("nation").select(f("f%d", "n_regionkey").alias("owner"), f("t%d", "n_nationkey").alias("t"), f("u%d", "n_nationkey").alias("u"), f("n%d", "n_nationkey").alias("call"), f("g%d", F.col("n_nationkey") % 3).alias("callee"), "n_nationkey")
    ring = t("nation").select((F.col("n_nationkey") % 3).alias("g")).distinct().select(f("g%d", "g").alias("owner"), f("g%d", (F.col("g") + 1) % 3).alias("callee"))
    calls = c.select(lit("").alias("owner"), "call", "callee", "condition").union(n.select("owner", "call", "callee", lit("sel"))).union(ring.select("owner", lit("again"), "callee", lit(None)))
    two = lambda df, *pairs: df.withColumn("p", F.explode(F.array(*[F.struct(lit(k).alias("formal"), v.alias("actual")) for k, v in pairs]))).select("owner", "call", "p.formal", "p.actual")
    bindings = two(c.withColumn("owner", lit("")), ("x", f("c%d", "c_custkey")), ("sel", f("a%d + 1", "c_custkey")), ("y", f("out%d", "c_custkey")))
    bindings = bindings.union(two(n, ("x", F.col("t")), ("y", F.col("u")))).union(two(ring.withColumn("call", lit("again")), ("x", lit("x")), ("y", lit("z"))))
    edges = n.select("owner", lit("x").alias("src"), F.col("t").alias("dst"), f("sel == %d", "n_nationkey").alias("condition")).union(n.select("owner", "t", lit("y"), lit(None)))
    edges = edges.union(n.select("owner", lit("sel"), lit("y"), lit("")).distinct()).union(ring.select("owner", lit("x"), lit("y"), lit("k.en && x > 4")))
    return calls, bindings, edges


table_query("inlined_calls", """
WITH c AS (
  SELECT c_custkey AS c, 'k' || c_custkey AS i, 'f' || c_custkey % 5 AS f, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'is_' || lower(substr(c_mktsegment, 1, 4)) || ' && ' END AS own,
         '(a' || c_custkey || ' + 1)' AS sel FROM customer),
n AS (SELECT c.*, n_nationkey AS n, i || '.t' || n_nationkey AS t FROM c JOIN nation ON n_regionkey = c % 5)
SELECT i AS instance, f AS function, 1::BIGINT AS level, 'c' || c AS src, t AS dst, own || sel || ' == ' || n AS condition FROM n
UNION ALL SELECT i, f, 1, t, 'out' || c, CASE WHEN own = '' THEN '' ELSE left(own, length(own) - 4) END FROM n
UNION ALL SELECT DISTINCT i, f, 1, 'a' || c, 'out' || c, CASE WHEN own = '' THEN '' ELSE left(own, length(own) - 4) END FROM n
UNION ALL SELECT i || '.n' || n || more, 'g' || (n + k) % 3, 2 + k, t, i || y, own || sel || ' && k.en && ' || t || ' > 4'
FROM (SELECT *, repeat('.again', k::INT) AS more, CASE k WHEN 0 THEN '.u' || n ELSE '.n' || n || repeat('.again', k::INT - 1) || '.z' END AS y FROM n, (VALUES (0), (1), (2)) AS three(k))
""")(lambda spark, sf_dir: inline.inlined(*call_rows(spark, sf_dir)))
table_query("recursive_calls", "SELECT DISTINCT 'g' || n_nationkey % 3 AS owner, 'again' AS call, 'g' || (n_nationkey + 1) % 3 AS callee FROM nation")(lambda spark, sf_dir: inline.recursive(call_rows(spark, sf_dir)[0]))


# A schedule: customers are sums of a wire's, orders compare, parts are added or multiplied by the lines' flags.

OPS = "CASE WHEN dst LIKE 'c.%' THEN 'Subtract' WHEN dst LIKE 'o.%' AND kind = 'DRIVER' THEN 'Equality' WHEN dst LIKE 'p.%' AND condition = 'A' THEN 'Add' WHEN dst LIKE 'p.%' AND condition = 'R' THEN 'Multiply' WHEN dst LIKE 'p.%' AND condition = 'N' THEN 'Shuffle' END"

graph_query("operator_schedule", VISITS.format(touching=ALL) + f""",
op AS (SELECT DISTINCT src, dst, {OPS} AS op FROM e WHERE kind <> 'CLOCK')
SELECT dst, op, CASE op WHEN 'Subtract' THEN '−' WHEN 'Equality' THEN '=' WHEN 'Add' THEN '+' WHEN 'Multiply' THEN '×' ELSE op END AS symbol,
       CAST(max(depth) - max((dst LIKE 'o.%')::INT) AS BIGINT) AS cycle, CAST(1 + max((src LIKE 'c.%')::INT) AS BIGINT) AS step, count(*) AS n_inputs
FROM op JOIN deep d ON d.id = dst WHERE op IS NOT NULL GROUP BY dst, op
""")(lambda g: timing.schedule(g, F.expr(OPS), all_depths(g)))
