"""Text sources: file lists, macros, and search with context lines."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def expand_filelist(path: str, read: Callable[[str], str], env: dict[str, str] | None = None, seen: set[str] | None = None) -> dict[str, list[str]]:
    """Paths that a file list names, include folders and defines. Nested lists (-f, -F) are followed once each; variables are
    expanded; comments and other options are passed over. `read` gives a list's text."""
    env, seen = dict(os.environ if env is None else env), set() if seen is None else seen
    out: dict[str, list[str]] = {"files": [], "incdirs": [], "defines": []}
    if path in seen:
        return out
    seen.add(path)
    base = path.rpartition("/")[0]
    place = lambda p: p if p.startswith("/") or "://" in p or not base else f"{base}/{p}"
    for raw in read(path).splitlines():
        line = re.sub(r"\s*(//|#).*", "", raw).strip()
        line = re.sub(r"\$\{(\w+)\}|\$(\w+)", lambda m: env.get(m[1] or m[2], m[0]), line)
        if not line:
            continue
        if nested := re.match(r"-[fF]\s+(\S+)", line):
            inner = expand_filelist(place(nested[1]), read, env, seen)
            for k in out:
                out[k] += [x for x in inner[k] if x not in out[k]]
        elif line.startswith("+incdir+"):
            out["incdirs"] += [place(x) for x in line[8:].split("+") if x]
        elif line.startswith("+define+"):
            out["defines"] += [x for x in line[8:].split("+") if x]
            env.update(x.split("=", 1) for x in line[8:].split("+") if "=" in x)
        elif line[0] not in "+-" and place(line) not in out["files"]:
            out["files"].append(place(line))
    return out


def whole_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def macros(files: DataFrame, text_col: str = "text") -> DataFrame:
    """(name, body) of `define lines of all files; of several definitions the last as text. What a body names is put in until
    nothing changes; a name that leads back to itself stays as it is, and so does one that nothing defines."""
    found = files.select(F.explode(F.regexp_extract_all(text_col, F.lit(r"(?m)^[ \t]*`define[ \t]+(\w+[ \t]+[^\n]*)$"))).alias("d"))
    found = found.select(F.regexp_extract("d", r"^(\w+)", 1).alias("name"), F.trim(F.regexp_extract("d", r"^\w+\s+(.*)$", 1)).alias("body")).groupBy("name").agg(F.max("body").alias("body"))
    table = dict(map(tuple, found.collect()))  # the names of a design, which substitute() sends to every file

    def whole(body: str, inside: frozenset[str]) -> str:
        return re.sub(r"`(\w+)", lambda m: whole(table[m[1]], inside | {m[1]}) if m[1] in table and m[1] not in inside else m[0], body)

    return files.sparkSession.createDataFrame([(n, whole(b, frozenset([n]))) for n, b in sorted(table.items())], "name string, body string")


def substitute(files: DataFrame, table: DataFrame, text_col: str = "text") -> DataFrame:
    """files with the macros of a table (name, body) put in where their names stand, but for the lines that define them."""
    names = dict(map(tuple, table.collect()))

    def put(line: Column) -> Column:
        out = line
        for name, body in names.items():
            out = F.regexp_replace(out, F.lit(rf"`{name}\b"), F.lit(body.replace("\\", "\\\\").replace("$", "\\$")))
        return F.when(line.rlike(r"^\s*`define\s"), line).otherwise(out)

    return files.withColumn(text_col, F.array_join(F.transform(F.split(text_col, "\n"), put), "\n")) if names else files


def with_timescale(text: Column, default: str = "`timescale 1ns/1ps") -> Column:
    return F.when(text.contains("`timescale"), text).otherwise(F.concat(F.lit(default + "\n"), text))


def search(df: DataFrame, id_col: str, text_col: str, keyword: str, context: int = 0, regex: bool = False, ignore_case: bool = False, most: int | None = None) -> DataFrame:
    """(id, line, text, before, after): lines that match, with context lines, at most `most` of each text. A text's lines stay in
    its row: context is a slice of the array, not a join."""
    pattern = ("(?i)" if ignore_case else "") + (keyword if regex else re.escape(keyword))
    lines = df.where(F.col(text_col).rlike(pattern)).select(F.col(id_col).alias("id"), F.split(text_col, "\n").alias("lines"))
    at = lines.withColumn("hits", F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(pattern), i + 1)), lambda i: i.isNotNull()))
    if most is not None:
        at = at.withColumn("hits", F.slice("hits", 1, most))
    n = F.col("line")
    out = at.select("id", "lines", F.explode("hits").alias("line"))
    first = F.greatest(F.lit(1), n - context)
    around = lambda a, size: F.array_join(F.slice("lines", a, size), "\n")
    return out.select("id", n.cast("bigint").alias("line"), F.element_at("lines", n).alias("text"), around(first, n - first).alias("before"), around(n + 1, F.lit(context)).alias("after"))


def source_hash(df: DataFrame, name_col: str, text_col: str) -> DataFrame:
    """16 hex digits over all (name, text), in the order of names; each text is hashed first, so only digests are gathered."""
    each = df.select(F.struct(F.col(name_col).alias("n"), F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("h")).alias("x"))
    return each.agg(F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat_ws("=", x["n"], x["h"])), ";"), 256), 1, 16).alias("hash"))
