"""Scalar functions over conditions, names and widths, as column expressions."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that signals of each class contain, affixes that a normalised name loses, keywords.
CONTROL_NAMES = ("valid", "ready", "stall", "ack", "req", "grant", "enable", "en", "sel", "select", "we", "re", "cs", "ce", "state", "next_state", "nxt_state", "done", "busy", "idle", "error", "fault", "start", "stop", "flush")
DATA_NAMES = ("data", "addr", "address", "wdata", "rdata", "mem", "pc", "opcode", "operand", "result", "alu", "fifo_wdata", "fifo_rdata", "shift", "count", "counter", "timer")
PREFIXES = ("io_s_axi_", "io_m_axi_", "io_s_axil_", "io_m_axil_", "io_s_", "io_m_", "io_", "s_axi_a_", "s_axi_w_", "s_axi_b_", "s_axi_ar_", "s_axi_r_", "s_axi_", "m_axi_", "s_axil_", "m_axil_", "s_axis_", "m_axis_", "io_axis_", "axis_", "s_", "m_", "slave_", "master_", "axi_", "axil_", "axi4_", "axi3_", "axilite_", "ahb_", "apb_", "gen_", "my_")
SUFFIXES = ("_o", "_i", "_io", "_r", "_w", "_next", "_reg", "_q", "_int", "_ext", "_n", "_p")
INFIXES = ("_payload_", "_bits_", "_chan_", "_data_")  # the longest first, as they are taken out one after the other
CHANNELS = (
    ("AW", ("awvalid", "aw_valid", "awready", "aw_ready", "awaddr", "aw_addr", "awlen", "aw_len", "awsize", "aw_size", "awburst", "aw_burst")),
    ("W", ("wvalid", "w_valid", "wready", "w_ready", "wdata", "w_data", "wstrb", "w_strb", "wlast", "w_last")),
    ("B", ("bvalid", "b_valid", "bready", "b_ready", "bresp", "b_resp")),
    ("AR", ("arvalid", "ar_valid", "arready", "ar_ready", "araddr", "ar_addr", "arlen", "ar_len")),
    ("R", ("rvalid", "r_valid", "rready", "r_ready", "rdata", "r_data", "rlast", "r_last", "rresp", "r_resp")),
    ("A", ("a_valid", "a_ready", "a_ack", "a_opcode", "a_data", "a_rd_resp", "a_param", "a_size", "a_source", "a_mask")),
    ("D", ("d_valid", "d_ready", "d_ack", "d_opcode", "d_data", "d_param", "d_size", "d_source", "d_error", "d_sink")),
)


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    return functools.reduce(operator.or_, [text.contains(p) for p in parts]) if parts else F.lit(False)


def is_literal(id: Column) -> Column:
    """Whether an id is a number: digits alone, or a leading digit and a quote (4'b10x0)."""
    return id.rlike(r"^\d+$|^\d.*'")


def _any_of(parts: tuple[str, ...]) -> str:
    return "|".join(map(re.escape, sorted(parts, key=len, reverse=True)))


def effective_condition(c: Column) -> Column:
    """The last term of a conjunction that is no reset term, without spaces; other conditions as they stand."""
    terms = F.filter(F.split(F.replace(c, F.lit(" "), F.lit("")), "&&"), lambda t: ~t.rlike(r"(?i)^(!|~~|~)(rst|reset)"))
    return F.when(~c.contains("&&"), c).otherwise(F.coalesce(F.try_element_at(terms, F.lit(-1)), c))


def is_reset_condition(c: Column) -> Column:
    """A condition on a reset alone: no conjunction or disjunction in it."""
    return c.rlike("(?i)rst|reset") & ~c.contains("&&") & ~c.contains("||")


def bit_range(name: Column) -> Column:
    """x[m:l] or x[i] → (name, msb, lsb); anything else → (itself, null, null)."""
    ranged, single = name.rlike(r"\[\s*\d+\s*:\s*\d+\s*\]"), name.rlike(r"\[\s*\d+\s*\]")
    part = lambda pattern, i: F.regexp_extract(name, pattern, i).try_cast("int")
    two, one = r"\[\s*(\d+)\s*:\s*(\d+)\s*\]", r"\[\s*(\d+)\s*\]"
    return F.struct(F.when(ranged | single, F.regexp_extract(name, r"^([^\[]*)\[", 1)).otherwise(name).alias("name"), F.when(ranged, part(two, 1)).when(single, part(one, 1)).alias("msb"), F.when(ranged, part(two, 2)).when(single, part(one, 1)).alias("lsb"))


def bit_slice(msb: Column, lsb: Column) -> Column:
    return F.when(msb.isNull(), "").when(msb == lsb, F.concat(F.lit("["), msb.cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("["), msb.cast("string"), F.lit(":"), lsb.cast("string"), F.lit("]")))


def width_class(width: Column) -> Column:
    return F.when(width <= 0, "unknown").when(width == 1, "1bit").when(width <= 8, "small").otherwise("wide")


def normalised(name: Column, prefixes: tuple[str, ...] = PREFIXES, suffixes: tuple[str, ...] = SUFFIXES, infixes: tuple[str, ...] = INFIXES, last: bool = True, subscripts: bool = True, underscores: bool = True) -> Column:
    """The last segment of a name without subscripts, infixes, prefixes (as often as one is found), one suffix and underscores.
    Infixes are taken out one after the other, the longest first. last, subscripts and underscores turn their steps off."""
    x = F.substring_index(name, ".", -1) if last else name
    x = F.regexp_replace(x, r"\[[^\]]*\]", "") if subscripts else x
    for infix in sorted(infixes, key=len, reverse=True):
        x = F.replace(x, F.lit(infix), F.lit("_"))
    x = F.regexp_replace(x, rf"^(?:{_any_of(prefixes)})+(?=.)", "") if prefixes else x
    x = F.regexp_replace(x, rf"(?<=.)(?:{_any_of(suffixes)})$", "") if suffixes else x
    return F.replace(x, F.lit("_"), F.lit("")) if underscores else x


def normalise(name: Column) -> Column:
    """normalised() by the built-in affixes."""
    return normalised(name)


def current_state(condition: Column, state: str) -> Column:
    """The state that a condition asks for, or null."""
    return F.nullif(F.regexp_extract(condition, rf"{re.escape(state)}\s*(?:===|==)\s*(\w+)", 1), F.lit(""))


def without_state(condition: Column, state: str) -> Column:
    x = F.trim(F.regexp_replace(condition, rf"{re.escape(state)}\s*(?:===|==)\s*\w+\s*", ""))
    x = F.regexp_replace(F.regexp_replace(x, r"^\s*&&\s*", ""), r"\s*&&\s*$", "")
    return F.when(x == "", "1").otherwise(x)


def condition_signals(expression: Column) -> Column:
    """Distinct identifiers of an expression, in order; 0 and 1 are none."""
    return F.array_distinct(F.filter(F.regexp_extract_all(expression, F.lit(r"(\w+)")), lambda x: ~x.isin("0", "1")))


def split_condition(condition: Column) -> Column:
    return F.filter(F.transform(F.split(condition, r"&&|\|\|"), F.trim), lambda x: x != "")


def is_negation(a: Column, b: Column) -> Column:
    bare = lambda x: F.regexp_replace(x, "[! ]", "")
    return (a.startswith("!") | b.startswith("!")) & (bare(a) == bare(b))


def last_segments(path: Column, depth: int = 1) -> Column:
    """The last `depth` segments of a dotted path; depth 0 gives the first."""
    parts = F.split(path, r"\.")
    return F.get(parts, F.lit(0)) if depth <= 0 else F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - depth + 1), F.lit(depth)), ".")


def channel(name: Column) -> Column:
    """The protocol channel that a signal's name speaks of; the first that fits."""
    s = F.lower(name)
    out = F.when(contains_any(s, ("m_wc_valid", "m_wc_ready", "m_wc_select", "m_wc_decerr")), "AW").when(contains_any(s, ("m_rc_valid", "m_rc_ready", "m_rc_decerr")), "AR")
    for c, parts in CHANNELS:
        out = out.when(contains_any(s, parts), c)
    return out.when(contains_any(F.substring_index(s, ".", -1), ("tvalid", "tready", "t_data", "tlast")), "D").otherwise("UNKNOWN")


def common_prefix(a: Column, b: Column) -> Column:
    n = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b)))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))) & (i <= F.least(F.length(a), F.length(b))), i).otherwise(acc))
    return F.substring(a, F.lit(1), n)


def statement(dst: Column, expression: Column, condition: Column, clock: Column) -> Column:
    """An assignment written out: its condition, its clock."""
    body = F.concat(dst, F.when(clock != "", " <= ").otherwise(" = "), expression)
    return F.concat(F.when(condition != "", F.concat(F.lit("if ("), condition, F.lit(") "))).otherwise(""), body, F.when(clock != "", F.concat(F.lit("; // @"), clock)).otherwise(";"))


def clean_name(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"[^A-Za-z0-9_$]", "_")


def condition_names(condition: Column) -> Column:
    """The first name of each term of a condition, each once, in order: state == READY gives state."""
    first = F.transform(split_condition(condition), lambda t: F.trim(F.regexp_extract(t, r"^([\s\S]*?)(?:[=!<>]=|[-+*/<>()\[\]]|$)", 1)))
    return F.array_distinct(F.filter(first, lambda x: x != ""))


def bare_base(name: Column) -> Column:
    """A signal's name in lower case without its direction, version and role: a_valid_i and a_ready_o are one."""
    x = F.regexp_replace(F.lower(name), "(_i|_o|_io)$", "")
    for part in ("next", "reg", "int", "early", "valid", "ready"):
        x = F.regexp_replace(x, f"_?{part}$", "")
    return x


# What the end of a name says about a signal's role; the first that fits.
ROLE_ENDS = (("valid", ("valid", "vld", "req")), ("ready", ("ready", "rdy", "ack", "stall", "wait")), ("data", ("data", "payload")), ("addr", ("addr", "address")), ("resp", ("resp", "response")), ("strb", ("strb", "strobe", "be")), ("last", ("last", "eop")), ("ctrl", ("len", "size", "burst", "id", "cache", "prot", "qos", "region", "lock", "user")))


def role_of_name(name: Column) -> Column:
    n = F.lower(name)
    out = F.when(F.lit(False), "")
    for role, ends in ROLE_ENDS:
        out = out.when(n.rlike(f"(?:{'|'.join(ends)})$"), role)
    return out.otherwise("unknown")


def layer(name: Column, keywords: dict[str, tuple[str, ...]]) -> Column:
    """The first layer of which the name has a keyword, else OTHER."""
    out = F.when(F.lit(False), "")
    for k, parts in keywords.items():
        out = out.when(contains_any(F.lower(name), parts), k)
    return out.otherwise("OTHER")


def qualified(name: Column, module: Column) -> Column:
    """A name with its module in front, unless that is there."""
    return F.when(module.isNull() | (module == "") | name.startswith(F.concat(module, F.lit("."))), name).otherwise(F.concat_ws(".", module, name))


def operand(signal: Column, msb: Column, lsb: Column, casts: Column, op: Column, side: Column) -> Column:
    """An operand as it is shown: its bits, the casts around it, and the operator that it goes into."""
    name = F.aggregate(F.coalesce(casts, F.array().cast("array<string>")), F.concat(signal, bit_slice(msb, lsb)), lambda acc, c: F.concat(c, F.lit("("), acc, F.lit(")")))
    to = F.when(F.coalesce(op, F.lit("")) == "", "").otherwise(F.concat(F.lit(" → op: "), op, F.when(F.coalesce(side, F.lit("")) == "", "").otherwise(F.concat(F.lit(" ("), side, F.lit(")")))))
    return F.concat(name, to)


# Words that are no signals.
KEYWORDS = ("logic", "wire", "reg", "input", "output", "inout", "module", "always", "assign", "if", "else", "case", "begin", "end", "posedge", "negedge", "or", "and")


def atomics(expression: Column) -> Column:
    """The signals of an expression with their bits, each once, in order; keywords and numbers are none, based ones (8'hFF, 'SB1x_0) with
    or without a size and in either case included."""
    clean = F.regexp_replace(expression, r"(?i)(?:\b\d[\d_]*\s*)?'s?[bodh]\s*[\da-f_xz?]+", " ")
    found = F.regexp_extract_all(clean, F.lit(r"([A-Za-z_$][\w$.]*(?:\[\s*\d+(?:\s*:\s*\d+)?\s*\])?)"))
    return F.array_distinct(F.filter(found, lambda x: ~x.isin(*KEYWORDS)))


def colour(name: Column) -> Column:
    """A colour for a name, by its MD5: dark ones are lifted to 80 in every part."""
    h = F.md5(name.cast("binary"))
    part = [F.conv(F.substring(h, i, 2), 16, 10).cast("int") for i in (1, 3, 5)]
    dark = part[0] + part[1] + part[2] < 350
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(F.when(dark, F.greatest(p, F.lit(80))).otherwise(p)), 2, "0")) for p in part])


# How operators are written.
OPERATORS = {"Add": "+", "Subtract": "-", "Multiply": "*", "Divide": "/", "ArithmeticShiftRight": ">>>", "GreaterThan": ">", "GreaterThanEqual": ">=", "LessThan": "<", "LessThanEqual": "<="}


def operator_label(op: Column, msb: Column, lsb: Column, casts: Column) -> Column:
    """An edge's casts, operator and bits, those that it has, between spaces."""
    sign = F.when(F.lit(False), "")
    for k, v in OPERATORS.items():
        sign = sign.when(op == k, v)
    last_first = F.reverse(F.coalesce(casts, F.array().cast("array<string>")))
    return F.concat_ws(" ", F.filter(F.concat(last_first, F.array(sign.otherwise(F.coalesce(op, F.lit(""))), bit_slice(msb, lsb))), lambda x: x != ""))


def credibility(has_snippet: Column, matches_expression: Column, matches_name: Column) -> Column:
    """How far a piece of evidence is to be believed, in tenths."""
    return F.when(has_snippet, 2).otherwise(0) + F.when(matches_expression, 4).otherwise(0) + F.when(matches_name, 2).otherwise(0) + F.when(matches_expression & matches_name, 2).otherwise(0)
