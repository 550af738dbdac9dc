"""Quality rules over single texts, and removal of lines that many documents of one host share.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

#: A line is removed in a host if at least MIN_DOCS of its documents have it and they are over MIN_SHARE of the host's.
MIN_DOCS, MIN_SHARE = 10, 0.005
#: A document is depleted, and rejected, if fewer than this share of its words is left.
LEAST_LEFT = 0.5
#: Lines that differ in numbers only are one line ("page 3 of 12").
FOLD_DIGITS = True


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def normalised(line: Column, fold_digits: bool = FOLD_DIGITS) -> Column:
    """A line as it is compared: lower case, runs of white space as one space, ends trimmed, and, if fold_digits, runs of
    ASCII digits as one 0, so that counters and dates meet."""
    out = F.trim(F.regexp_replace(F.lower(line), r"\s+", " "))
    return F.regexp_replace(out, "[0-9]+", "0") if fold_digits else out


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: as a lambda variable it can't be inlined where it is used for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shingles(w: Column, n: int) -> Column:
    """Hashes of the windows of n words of an array, in order; none if it has fewer words."""
    starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)]))


def _in_repeats(hashes: Column, n: int) -> Column:
    """Number of words inside windows of n words (their hashes in order) whose hash is found twice or more.

    Windows are sorted by (hash, position); the positions of equal neighbours, sorted again, are intervals of n words
    whose union is counted from the distance of each to the next.
    """

    def marked(pairs: Column) -> Column:
        same = lambda i, j: F.get(pairs, i)["h"].eqNullSafe(F.get(pairs, j)["h"])
        return F.filter(pairs, lambda x, k: ((k > 0) & same(k, k - 1)) | ((k < F.size(pairs) - 1) & same(k, k + 1)))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    at = F.sort_array(F.transform(_let(pairs, marked), lambda x: x["i"]))
    return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-n).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(n), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])


def base_rules(df: DataFrame, text_col: str = "text", n: int = 3) -> DataFrame:
    """df and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, which replace columns of these names. A
    null text has no words and no lines: all counts are 0, and base_failed is true, as for every text of under 50 words."""
    df = df.drop(*BASE)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    repeats = lambda h: F.when(F.size(h) > F.size(F.array_distinct(h)), _in_repeats(h, n)).otherwise(0)
    figures = _let(words(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), _let(_shingles(w, n), repeats).cast("bigint").alias("n_repeat_words")))
    # The others as one struct, so that no name of theirs meets one of these.
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])
    text = F.coalesce(F.col(f"row.c{df.columns.index(text_col)}"), F.lit(""))
    out = df.select(row.alias("row"), figures.alias("f")).select(
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(df.columns)],
        F.col("f.n_words").alias("n_words"),
        F.char_length(F.regexp_replace(text, SPACE, "")).cast("bigint").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("bigint").alias("n_symbols"),
        _let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        F.col("f.n_repeat_words").alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def shared_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, fold_digits: bool = FOLD_DIGITS) -> DataFrame:
    """(host, line hash, n_docs): the lines above the limits. Counts distinct documents: a line once for each id, however
    often it stands there or the row is repeated. Null hosts are a host of their own, null ids a document of their own;
    lines without a word are none."""
    lines = line_hashes(df, id_col, text_col, host_col, fold_digits).select("host", "doc", "h").distinct()
    sizes = df.select(F.col(f"`{host_col}`").alias("host"), F.col(f"`{id_col}`").alias("doc")).distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    counts = lines.groupBy("host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)
    return counts.alias("c").join(sizes.alias("s"), F.col("c.host").eqNullSafe(F.col("s.host"))).where(F.col("n_docs") > min_share * F.col("host_docs")).select("c.host", "h", "n_docs")


def _text_key(text) -> Column:
    return F.struct(F.xxhash64(text).alias("hash"), F.octet_length(text).alias("bytes"))


def line_hashes(df: DataFrame, id_col: str, text_col: str, host_col: str, fold_digits: bool = FOLD_DIGITS) -> DataFrame:
    """(host, doc, row, h, line): each line of a row that has a word, and the hash of its normalised form; row names the text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = df.select(F.col(f"`{host_col}`").alias("host"), F.col(f"`{id_col}`").alias("doc"), _text_key(text).alias("row"), F.explode(F.split(text, "\n")).alias("line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return lines.select("host", "doc", "row", F.xxhash64(normalised(F.col("line"), fold_digits)).alias("h"), "line")


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
MADE = (*BASE, "removed_lines", "n_left", "clean_text", "kept")


def clean(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, least_left: float = LEAST_LEFT, fold_digits: bool = FOLD_DIGITS) -> DataFrame:
    """df with the figures of base_rules and of the cross-document rule, a row for each row:

    removed_lines (hashes of the row's own lines that are above the limits in its host, whatever other rows share its id), n_left (words in the other lines),
    clean_text (the text without those lines; null stays null), kept (false if base_failed or if n_left is under
    least_left of n_words). Columns of df with these names are replaced; others may have any names. An empty df gives no rows.
    """
    shared = shared_lines(df, id_col, text_col, host_col, min_docs, min_share, fold_digits)
    found = line_hashes(df, id_col, text_col, host_col, fold_digits).alias("l").join(shared.alias("s"), (F.col("l.h") == F.col("s.h")) & F.col("l.host").eqNullSafe(F.col("s.host")))
    removed = found.groupBy("l.doc", "l.host", "l.row").agg(F.collect_set("l.h").alias("r")).alias("g")
    # Columns by place from here on; the last ones are read by their own names.
    names = [c for c in df.columns if c not in MADE or c in (id_col, text_col, host_col)]
    at = {c: f"c{i}" for i, c in enumerate(names)}
    base = df.select(*[F.col(f"`{c}`").alias(n) for c, n in at.items()]).alias("d")
    joined = base.join(removed, F.col(at[id_col]).eqNullSafe(F.col("g.doc")) & F.col(at[host_col]).eqNullSafe(F.col("g.host")) & (_text_key(F.coalesce(F.col(at[text_col]), F.lit(""))) == F.col("g.row")), "left").select("d.*", "g.r")
    text = F.col(at[text_col])
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~(F.array_contains("r", F.xxhash64(normalised(x, fold_digits))) & x.rlike(r"[^\x20\x09-\x0D]"))), "\n")
    out = base_rules(joined.withColumn("clean_text", F.when(F.col("r").isNull(), text).otherwise(left)), at[text_col])
    out = out.withColumn("n_left", F.when(F.col("r").isNull(), F.col("n_words")).otherwise(F.size(words(F.col("clean_text"))).cast("bigint")))
    kept = ~F.col("base_failed") & (F.col("n_left") >= least_left * F.col("n_words"))
    made = {c: F.col(c) for c in (*BASE, "n_left", "clean_text")} | {"kept": kept, "removed_lines": F.coalesce("r", F.array().cast("array<bigint>"))}
    return out.select(*[F.col(n).alias(c) for c, n in at.items() if c not in MADE], *[made[c].alias(c) for c in MADE])
