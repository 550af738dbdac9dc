"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams against every window of every text.

Main path: DataFrame functions only. Texts are split into words once; each position is hashed with the words behind it
inside generated code and probed against the hash set; only hits leave the join, and each is verified word by word.

A table of more n-grams than are broadcast is met by a shuffle: of a text only (row, position, hash) are sent, 24 bytes for
a word; those whose hash the table has go back to their text, by row, and are verified there in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

N = 13
#: N-grams are broadcast, sizes of few first, up to so many in all (about 200 bytes each); the other sizes' join is shuffled.
BROADCAST_GRAMS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words. Upper-case letters are lower-cased after splitting, which gives the same words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text as they stand (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BETWEEN), lambda w: w != "")


def low(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def grams(items: DataFrame, id_col: str, text_col: str, n: int = N) -> DataFrame:
    """(item_id, size, gram): the distinct windows of every item, their words joined by a space. An item of fewer than n
    words, but not none, is one window; null texts have none. A null id is the empty string, one item with others of it."""
    w = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item_id"), words(low(F.col(f"`{text_col}`"))).alias("w")).withColumn("size", F.least(F.size("w"), F.lit(n))).where("size > 0")
    at = w.select("item_id", "size", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("i"))
    return at.select("item_id", "size", F.array_join(F.slice("w", F.col("i"), F.col("size")), " ").alias("gram")).distinct()


def _key(size: int, word) -> Column:
    """Hash of the window of `size` words at a position; word(j) is its j-th word. It takes up to four words, spread over
    the window: the generated method stays small enough to be compiled, and hits are verified in full anyway."""
    return F.xxhash64(F.lit(size), *[word(j) for j in sorted({0, (size - 1) // 3, 2 * (size - 1) // 3, size - 1})])


def _keys(w: str, size: int) -> Column:
    """_key() at every position of an array of `size` words or more."""
    return F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: _key(size, lambda j: F.lower(F.get(w, i + j))))


def _window(w: Column, pos: Column, size: Column) -> Column:
    """The window of `size` words at a position, as a gram is written."""
    return low(F.array_join(F.slice(w, pos + 1, size), " "))


def hits(docs: DataFrame, table: DataFrame, sizes: list[int]) -> DataFrame:
    """docs (key, w: words), table (gram_id, size, gram; broadcast) → (key, n_words, pos, size, gram_id), a row for each
    occurrence of a gram of the sizes, and one with pos -1 for each document. Texts are split once for each size."""
    if not sizes:
        return docs.select("key", F.size("w").cast("bigint").alias("n_words"), F.lit(-1).alias("pos"), F.lit(0).alias("size"), F.lit(None).cast("bigint").alias("gram_id"))
    # The outer form: the plain one would split texts once more in a filter.
    at = docs.select("key", "w", F.posexplode_outer(F.concat(F.col("w"), F.array(F.lit("")))).alias("pos", "_"))
    spark, found = docs.sparkSession, None
    for size in sizes:
        parts = F.split("gram", " ")
        side = table.where(F.col("size") == size).select("gram_id", "gram", _key(size, lambda j: F.lower(F.get(parts, F.lit(j)))).alias("k"))
        k = F.when(F.col("pos") + size <= F.size("w"), _key(size, lambda j: F.lower(F.get("w", F.col("pos") + j))))
        # Not an equality, or it would become a join key and be computed at every position.
        exact = F.startswith(F.concat(_window(F.col("w"), F.col("pos"), F.lit(size)), F.lit(" ")), F.concat("gram", F.lit(" ")))
        if found is None:
            side = side.union(spark.range(1).select(F.lit(None).cast("bigint"), F.lit(""), F.lit(0).cast("bigint")))
            k = F.when(F.col("pos") == F.size("w"), F.lit(0).cast("bigint")).otherwise(k)
            exact = (F.col("gram_id").isNull() & (F.col("pos") == F.size("w"))) | (F.col("gram_id").isNotNull() & (F.col("pos") < F.size("w")) & exact)
        one = at.join(F.broadcast(side), (k == F.col("k")) & exact)
        one = one.select("key", F.size("w").cast("bigint").alias("n_words"), F.when(F.col("gram_id").isNull(), -1).otherwise(F.col("pos")).alias("pos"), F.lit(size).alias("size"), "gram_id")
        found = one if found is None else found.unionByName(one)
    return found


def shuffled_hits(docs: DataFrame, table: DataFrame, sizes: list[int]) -> DataFrame:
    """hits() of a table of any length, without the rows of pos -1: nothing is broadcast by hint, no text is sent but those
    with a window whose hash the table has, and those once. Rows are named by a hash of their key; two that share it are each
    verified against their own text, so they can't be taken for one another."""
    row = F.xxhash64("key.id", "key.hash", "key.bytes")
    probes = []
    for size in sizes:
        at = docs.where(F.size("w") >= size).select(row.alias("row"), F.posexplode(_keys("w", size)).alias("pos", "k"))
        parts = F.split("gram", " ")
        side = table.where(F.col("size") == size).select(_key(size, lambda j: F.lower(F.get(parts, F.lit(j)))).alias("k")).distinct()
        # Sorted, not hashed: a table of any length, and a phrase that many texts have is a skewed key, which AQE splits.
        probes.append(at.join(side.hint("merge"), "k").select("row", "pos", F.lit(size).alias("size")))
    found = probes[0]
    for p in probes[1:]:
        found = found.unionByName(p)
    # The places of one row, each once however often the row is repeated: at most its own words, for each size.
    places = found.distinct().groupBy("row").agg(F.collect_list(F.struct("pos", "size")).alias("at"))
    texts = docs.select("key", "w", row.alias("row")).join(places.hint("merge"), "row")
    seen = F.transform(F.filter("at", lambda x: x["pos"] + x["size"] <= F.size("w")), lambda x: F.struct(x["pos"].alias("pos"), x["size"].alias("size"), _window(F.col("w"), x["pos"], x["size"]).alias("gram")))
    seen = texts.select("key", F.size("w").cast("bigint").alias("n_words"), F.explode(seen).alias("x")).select("key", "n_words", "x.pos", "x.size", "x.gram")
    return seen.join(table.hint("merge"), ["size", "gram"]).select("key", "n_words", "pos", "size", "gram_id")


def _text_key(text: Column) -> dict[str, Column]:
    return {"hash": F.xxhash64(text), "bytes": F.octet_length(F.coalesce(text, F.lit("")))}


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = N, one_in: int = 20) -> DataFrame:
    """A row for each document: id_col, text_hash and text_bytes (which with the id name the row), n_words, n_hit, n_items,
    items (sorted), spans (word positions [start, end) of what is hit, merged), contaminated (n_hit > 0 and
    one_in * n_hit >= n_words).

    Every row of docs gives one row, repeated ids and null ids included, judged on its own text. Null, empty and wordless
    texts have no words and no hits; an empty benchmark hits nothing, and empty docs give no rows. Only the named columns
    are read, so others cannot clash.
    """
    spark = docs.sparkSession
    members = grams(items, item_id, item_text, n).withColumn("gram_id", F.xxhash64("gram", "size"))
    table = members.groupBy("gram_id", "size", "gram").agg(F.count("*").alias("m")).drop("m")
    size_of = {r["size"]: r["c"] for r in table.groupBy("size").agg(F.count("*").alias("c")).collect()}  # at most n rows
    text = F.col(f"`{text_col}`")
    key = F.struct(F.col(f"`{id_col}`").alias("id"), *[c.alias(n) for n, c in _text_key(text).items()])
    all_words = docs.select(key.alias("key"), words(text).alias("w"))
    if not size_of:
        return all_words.select(F.col("key.id").alias(id_col), F.col("key.hash").alias("text_hash"), F.col("key.bytes").alias("text_bytes"), F.size("w").cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_hit"), F.lit(0).cast("bigint").alias("n_items"), F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(False).alias("contaminated"))
    near, held = [], 0
    for size in sorted(size_of, key=lambda x: (size_of[x], x)):
        held += size_of[size]
        if held <= BROADCAST_GRAMS:
            near.append(size)
    far = sorted(set(size_of) - set(near))
    both = hits(all_words, table, sorted(near))
    both = checkpointed(both.unionByName(shuffled_hits(all_words, table, far)) if far else both)
    counted, found = both.where("pos < 0").select("key", "n_words"), both.where("pos >= 0")
    found = found.groupBy("key", "pos").agg(F.max("size").alias("size"), F.collect_set("gram_id").alias("gram_ids"))
    # Windows of one document, in order: where the covered stretch so far ends, and whether a new one begins.
    order = Window.partitionBy("key").orderBy("pos")
    before = F.max(F.col("pos") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("before", F.coalesce(before, F.lit(-1))).withColumn("run", F.sum(F.when(F.col("pos") > F.col("before"), 1).otherwise(0)).over(order))
    spans = runs.groupBy("key", "run").agg(F.min("pos").alias("start"), F.max(F.col("pos") + F.col("size")).alias("end"))
    spans = spans.groupBy("key").agg(F.sum(F.col("end") - F.col("start")).cast("bigint").alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    named = found.select("key", F.explode("gram_ids").alias("gram_id")).distinct().join(members.select("gram_id", "item_id"), "gram_id").select("key", "item_id").distinct()
    named = named.groupBy("key").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    per = spans.join(named, "key")
    out = counted.alias("c").join(per.alias("p"), F.col("c.key") == F.col("p.key"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select(
        F.col("c.key.id").alias(id_col), F.col("c.key.hash").alias("text_hash"), F.col("c.key.bytes").alias("text_bytes"), "n_words", n_hit.alias("n_hit"), F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("bigint").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"),
    )


def remove(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that scan() (found) doesn't call contaminated. A row goes by the verdict on its own text, so rows
    that share its id, null, repeated or not, stay unless theirs is contaminated too. Columns may have any names."""
    bad = found.where("contaminated").select(F.col(id_col).alias("id"), F.col("text_hash").alias("hash"), F.col("text_bytes").alias("bytes")).distinct().alias("b")
    text = F.col(f"d.`{text_col}`")
    own = _text_key(text)
    return docs.alias("d").join(bad, F.col(f"d.`{id_col}`").eqNullSafe(F.col("b.id")) & (own["hash"] == F.col("b.hash")) & (own["bytes"] == F.col("b.bytes")), "left_anti").select(*[F.col(f"d.`{c}`") for c in docs.columns])


def cut(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the hit words cut out of the texts of rows that scan() (found) reports; what is left of such a text is
    its words (unchanged in case) joined by a space. Rows are met by id and text, so ids may be null or repeated; other rows
    and columns, of any names, stay as they are."""
    spans = found.where("n_hit > 0").select(F.col(id_col).alias("id"), F.col("text_hash").alias("hash"), F.col("text_bytes").alias("bytes"), "spans").dropDuplicates(["id", "hash", "bytes"]).alias("s")
    text = F.col(f"d.`{text_col}`")
    own = _text_key(text)
    gone = lambda i: F.exists("s.spans", lambda s: (s["start"] <= i) & (i < s["end"]))
    left = F.array_join(F.filter(words(text), lambda w, i: ~gone(i)), " ")
    out = docs.alias("d").join(spans, F.col(f"d.`{id_col}`").eqNullSafe(F.col("s.id")) & (own["hash"] == F.col("s.hash")) & (own["bytes"] == F.col("s.bytes")), "left")
    return out.select(*[F.when(F.col("s.spans").isNull(), text).otherwise(left).alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns])
