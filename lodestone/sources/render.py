"""Sinks for drawing: DOT, Mermaid, HTML and plain text. What is drawn is styled by Spark, as columns; a drawing has at most `most`
rows by a stated order, which is a limit of drawings alone, and its text is made on the driver line by line."""

from __future__ import annotations

import json
import shutil
import subprocess
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..operators import classify, reports

# Colours of kinds, of classes and of testbench parts.
COLOURS = {"REG": "lightblue", "PORT_IN": "palegreen", "PORT_OUT": "salmon", "CONST": "lightgrey"}
CLASS_COLOURS = {"CLOCK": "gold", "RESET": "orange", "CONTROL": "lightpink", "DATA": "lightblue"}
PART_COLOURS = {"test": "lightblue", "env": "lightcyan", "agent": "lightyellow", "driver": "lightpink", "monitor": "lightgreen", "sequencer": "lavender", "scoreboard": "lightgoldenrod"}
MOST = 500


def _quoted(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def _by(key: Column, table: dict[str, str], other: str = "white") -> Column:
    out = F.when(F.lit(False), "")
    for k, v in table.items():
        out = out.when(key == k, v)
    return out.otherwise(other)


def digraph(nodes: DataFrame, edges: DataFrame, title: str = "graph", group: str | None = None, direction: str = "LR", most: int = MOST) -> Iterator[str]:
    """DOT lines of edges (src, dst, label and, if there, style), the first `most` by all of these, and of nodes (id, label, fill
    and, if there, group): the ends of these edges, or the first `most` nodes if there is no edge. group: 'cluster' draws a box
    around each group, 'rank' a level; nodes without one stand alone."""
    cols = [c for c in ("src", "dst", "label", "style") if c in edges.columns]
    drawn = edges.select(*cols).orderBy(*cols).limit(most).collect()
    ends = sorted({r[c] for r in drawn for c in ("src", "dst")})
    spark = nodes.sparkSession
    shown = nodes.join(F.broadcast(spark.createDataFrame([(i,) for i in ends], "id string")), "id", "left_semi") if ends else nodes.orderBy("id").limit(most)
    groups: dict = {}
    for r in sorted(shown.collect(), key=lambda r: r["id"]):
        groups.setdefault(r["group"] if group and "group" in shown.columns else None, []).append(r)
    yield f"digraph {_quoted(title)} {{"
    yield f"  rankdir={direction};"
    for i, key in enumerate(sorted(groups, key=lambda k: (k is not None, str(k).zfill(12)))):
        boxed = key is not None and key != ""
        if boxed:
            yield f"  subgraph cluster_{i} {{ label={_quoted(str(key))};" if group == "cluster" else "  { rank=same;"
        for r in groups[key]:
            yield f"  {_quoted(r['id'])} [label={_quoted(r['label'] or r['id'])}, style=filled, fillcolor={r['fill']}];"
        if boxed:
            yield "  }"
    for e in drawn:
        marks = [f"label={_quoted(e['label'])}"] if e["label"] else []
        marks += [f"style={e['style']}"] if "style" in cols and e["style"] else []
        yield f"  {_quoted(e['src'])} -> {_quoted(e['dst'])}" + (f" [{', '.join(marks)}]" if marks else "") + ";"
    yield "}"


def _labelled(g: PropertyGraph, label: str = "condition") -> DataFrame:
    return g.top_edges().select("src", "dst", F.col(label).alias("label"))


def _kinds(g: PropertyGraph, group: Column | None = None) -> DataFrame:
    return g.vertices.select("id", F.col("name").alias("label"), _by(F.col("kind"), COLOURS).alias("fill"), (F.lit(None).cast("string") if group is None else group).alias("group"))


def dot(g: PropertyGraph, title: str = "graph", max_edges: int = MOST) -> Iterator[str]:
    """The graph as it is, conditions on its edges."""
    return digraph(_kinds(g), _labelled(g), title, most=max_edges)


def modules_dot(g: PropertyGraph, title: str = "modules", clocks: bool = False, resets: bool = False, most: int = MOST) -> Iterator[str]:
    """Visible edges, a box for each module."""
    e = reports.visible_edges(g, clocks, resets).select("src", "dst", F.col("condition").alias("label"))
    return digraph(_kinds(g, F.col("module")), e, title, "cluster", most=most)


def classes_dot(g: PropertyGraph, title: str = "dataflow", clocks: bool = False, most: int = MOST) -> Iterator[str]:
    """Vertices coloured by class; control edges are dashed. Clock and reset edges only on demand."""
    n = g.vertices.select("id", F.col("name").alias("label")).join(classify.nodes(g).select("id", _by(F.col("class"), CLASS_COLOURS).alias("fill")), "id")
    e = classify.edges(g)
    e = e if clocks else e.where(~F.col("class").isin("CLOCK", "RESET"))
    e = e.groupBy("src", "dst").agg(F.min("condition").alias("label"), F.when(F.bool_and(F.col("class") == "CONTROL"), "dashed").otherwise("solid").alias("style"))
    return digraph(n, e, title, most=most)


def stages_dot(g: PropertyGraph, stages: DataFrame, title: str = "pipeline", most: int = MOST) -> Iterator[str]:
    """stages (id, stage): vertices of a stage stand on a level, what has none stands alone. With reports.layers() this is the
    graph along its time axis, with reports.pipeline_stages() its pipeline."""
    n = _kinds(g).drop("group").join(stages.select("id", F.col("stage").cast("string").alias("group")), "id", "left")
    return digraph(n, _labelled(g), title, "rank", most=most)


def operators_dot(g: PropertyGraph, title: str = "compute", most: int = MOST) -> Iterator[str]:
    """DRIVER edges with the expressions that they carry."""
    return digraph(_kinds(g), g.top_edges().where("kind = 'DRIVER'").select("src", "dst", F.col("expression").alias("label")), title, most=most)


def assertions_dot(assertions: DataFrame, properties: DataFrame, most: int = MOST) -> Iterator[str]:
    """assertions (id, kind, property, message), properties (id, name): which assertion states which property."""
    a = assertions.select("id", F.when(F.coalesce("message", F.lit("")) != "", F.concat(F.col("kind"), F.lit(": "), F.substring("message", 1, 30))).otherwise(F.col("kind")).alias("label"), F.lit("lightgreen").alias("fill"))
    p = properties.select("id", F.concat(F.lit("PROP: "), "name").alias("label"), F.lit("lightblue").alias("fill"))
    e = assertions.where("property != ''").select(F.col("id").alias("src"), F.col("property").alias("dst"), F.lit("").alias("label"))
    return digraph(a.union(p), e, "SVAGraph", direction="TB", most=most)


def testbench_dot(parts: DataFrame, connections: DataFrame, most: int = MOST) -> Iterator[str]:
    """parts (name, class, base, type, parent), connections (source, target: part.port): what holds what, and what talks to what."""
    n = parts.select(F.col("name").alias("id"), F.concat("name", F.lit("\n"), F.col("class"), F.lit("\n("), "base", F.lit(")")).alias("label"), _by(F.col("type"), PART_COLOURS).alias("fill"))
    holds = parts.where("parent != ''").select(F.col("parent").alias("src"), F.col("name").alias("dst"), F.lit("contains").alias("label"), F.lit("solid").alias("style"))
    last = lambda c: F.substring_index(c, ".", -1)
    talks = connections.select(F.substring_index("source", ".", 1), F.substring_index("target", ".", 1), F.concat_ws(" → ", last("source"), last("target")), F.lit("dashed"))
    return digraph(n, holds.union(talks), "UVMTestbench", direction="TB", most=most)


def states_dot(transitions: DataFrame, name: str = "fsm", reset: str = "", most: int = MOST) -> Iterator[str]:
    """(from_state, to_state, condition) as circles; the reset state is grey, a transition without a condition says 1."""
    rows = transitions.orderBy("from_state", "to_state", "condition").limit(most).collect()
    yield f"digraph {_quoted(name)} {{"
    yield "  rankdir=LR; node [shape=circle];"
    for state in sorted({r[c] for r in rows for c in ("from_state", "to_state")}):
        yield f"  {_quoted(state)}" + (" [style=filled, color=lightgray];" if state == reset else ";")
    for r in rows:
        yield f"  {_quoted(r['from_state'])} -> {_quoted(r['to_state'])} [label={_quoted(r['condition'] or '1')}];"
    yield "}"


def mermaid(transitions: DataFrame, most: int = MOST) -> Iterator[str]:
    """Lines of a state diagram of (from_state, to_state, condition)."""
    yield "stateDiagram-v2"
    for t in transitions.orderBy("from_state", "to_state", "condition").limit(most).toLocalIterator():
        yield f"    {t['from_state']} --> {t['to_state']}" + (f": {t['condition']}" if t["condition"] not in ("", "1") else "")


def _plain(s: str) -> str:
    return s.replace('"', "#quot;").replace("\n", "<br/>")


def flowchart(nodes: DataFrame, edges: DataFrame, most: int = MOST) -> Iterator[str]:
    """Mermaid lines of nodes (id, label) and edges (src, dst, label): a graph, a call tree, anything."""
    drawn = edges.select("src", "dst", "label").orderBy("src", "dst", "label").limit(most).collect()
    ends = {r[c] for r in drawn for c in ("src", "dst")} or {r["id"] for r in nodes.select("id").orderBy("id").limit(most).collect()}
    number = {i: f"n{k}" for k, i in enumerate(sorted(ends))}
    found = nodes.join(F.broadcast(nodes.sparkSession.createDataFrame([(i,) for i in number], "id string")), "id", "left_semi") if number else nodes.limit(0)
    label = {r["id"]: r["label"] for r in found.select("id", "label").collect()}
    yield "graph TD"
    for i, n in number.items():
        yield f'    {n}["{_plain(label.get(i) or i)}"]'
    for e in drawn:
        yield f"    {number[e['src']]} -->" + (f'|"{_plain(e["label"])}"| ' if e["label"] else " ") + number[e["dst"]]


def graph_mermaid(g: PropertyGraph, most: int = MOST) -> Iterator[str]:
    return flowchart(g.vertices.select("id", F.col("name").alias("label")), _labelled(g), most)


def calls_mermaid(calls: DataFrame, most: int = MOST) -> Iterator[str]:
    """calls (id, parent, callee, kind, pattern, detail): a call tree. Forks and randomisations are marked, other calls by a
    pattern that isn't generic; parent is null or '' at the top."""
    kind, text = F.col("kind"), lambda c: F.coalesce(c, F.lit(""))
    tag = F.when(kind == "fork", F.concat(F.lit("[FORK/"), text("detail"), F.lit("]"))).when(kind == "randomize", F.concat(F.lit("[RANDOMIZE] "), "callee", F.when(text("detail") != "", F.concat(F.lit("\n"), "detail")).otherwise("")))
    label = tag.otherwise(F.concat(F.when(text("pattern").isin("", "generic"), "").otherwise(F.concat(F.lit("["), F.upper("pattern"), F.lit("] "))), "callee"))
    return flowchart(calls.select("id", label.alias("label")), calls.where(text("parent") != "").select(F.col("parent").alias("src"), F.col("id").alias("dst"), F.lit("").alias("label")), most)


PAGE = """<!DOCTYPE html><meta charset="utf-8"><title>{title}</title><input id="q" placeholder="filter"><table id="t"></table>
<script>const rows = {rows};
const show = q => document.getElementById("t").replaceChildren(...rows.filter(r => r.join(" ").includes(q)).map(r => {{
  const tr = document.createElement("tr"); r.forEach(c => tr.insertCell().textContent = c); return tr; }}));
document.getElementById("q").oninput = e => show(e.target.value); show("");</script>"""


def html(g: PropertyGraph, title: str = "graph", most: int = MOST) -> str:
    """A page with the edges of the highest scores, to be filtered by what is typed."""
    top = reports.riskiest_edges(g, most).join(g.top_edges().select("src", "dst", "kind", "condition"), ["src", "dst"]).orderBy(F.desc("score"), "src", "dst")
    rows = [[r["src"], r["dst"], r["kind"], r["condition"], r["score"]] for r in top.collect()]
    safe = json.dumps(rows, ensure_ascii=False).replace("<", "\\u003c")
    return PAGE.format(title=title.replace("&", "&amp;").replace("<", "&lt;"), rows=safe)


def tree(children: dict[str, list[str]], root: str, notes: dict[str, str] | None = None) -> Iterator[str]:
    """Lines of a tree from a root; a vertex that stands above itself is named again and not followed."""
    notes, stack = notes or {}, [(root, "", "", "", ())]
    while stack:
        name, head, mark, below, above = stack.pop()
        yield head + mark + name + (f"  {notes[name]}" if notes.get(name) else "")
        kids = [] if name in above else children.get(name, [])
        for i, kid in reversed(list(enumerate(kids))):
            last = i == len(kids) - 1
            stack.append((kid, below, "└── " if last else "├── ", below + ("    " if last else "│   "), (*above, name)))


def reach_tree(g: PropertyGraph, found: DataFrame, root: str, most: int = MOST) -> Iterator[str]:
    """The tree of what a root reaches: found (root, id, level) of traverse, each vertex under its first predecessor of the level
    before."""
    f = found.where(F.col("root") == root).unionByName(found.sparkSession.createDataFrame([(root, root, 0)], "root string, id string, level bigint")).groupBy("id").agg(F.min("level").alias("level"))
    up = f.select(F.col("id").alias("src"), (F.col("level") + 1).alias("level"))
    under = g.pairs().withColumnRenamed("dst", "id").join(f.where("level > 0"), "id").join(up, ["src", "level"]).groupBy("id", "level").agg(F.min("src").alias("src"))
    children: dict[str, list[str]] = {}
    for r in under.orderBy("level", "src", "id").limit(most).collect():
        children.setdefault(r["src"], []).append(r["id"])
    return tree(children, root)


def atoms_report(signals: list[str], found: DataFrame, blocks: DataFrame, most: int = MOST) -> Iterator[str]:
    """Markdown of decompose.decompose() and decompose.control_blocks(): the atoms, the blocks, and a cross to begin with."""
    rows = found.groupBy("atom").agg(F.min("level").alias("level")).orderBy("level", "atom").limit(most).collect()
    yield f"# Control coverage of {', '.join(signals)}"
    yield ""
    yield f"Atoms: {len(rows)}" + (" (the first)" if len(rows) == most else "")
    yield ""
    for r in rows:
        yield f"- `{r['atom']}`" + (f", {r['level']} steps behind" if r["level"] else "")
    yield ""
    for b in blocks.orderBy("root", "src").limit(most).toLocalIterator():
        yield f"- `{b['src']}` -> `{b['root']}` if `{b['condition']}`" + (f": `{b['expression']}`" if b["expression"] else "")
    if len(rows) > 1:
        yield ""
        yield "```systemverilog"
        yield f"covergroup cg_{'_'.join(s.replace('.', '_') for s in signals)} @(posedge clk);"
        yield f"  cross {', '.join(r['atom'] for r in rows)};"
        yield "endgroup"
        yield "```"


def drawn(lines: Iterable[str], path: str, engine: str = "dot", form: str = "png") -> int:
    """Writes a picture of DOT lines with the program `engine`; its exit code, 127 if it isn't there."""
    program = shutil.which(engine)
    if not program:
        return 127
    return subprocess.run([program, f"-T{form}", "-o", path], input="\n".join(lines), text=True, timeout=60).returncode


def failure(code: str, message: str, command: str | None = None, **details) -> dict:
    """What a command answers if it fails: a stable code beside the text, and whatever else helps."""
    return {"ok": False, "command": command, "error": message, "error_code": code, "errors": [message], **details}
