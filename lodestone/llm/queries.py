"""The registered queries of this subpackage, their results as the contracts state them, and SQL for those that have it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontaminate, langid, lm, phrases, quality, simhash, substring_dedup, suffix_dedup, token_files, trie, warc
from .common import read


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.clean(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left", F.size("removed_lines").cast("bigint").alias("n_removed_lines"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents that labels call good (quality 1). Background: all documents."""
    good = read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("good_")).distinct()
    # Labels grow with the documents, so they are joined by a shuffle at every size, never broadcast while they are few.
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").join(good.hint("merge"), F.col("doc_id") == F.col("good_"), "left")
    return lm.score(docs, F.col("good_").isNotNull()).select("doc_id", "n_tokens", "h_target", "h_background", "score")


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of a public tokenizer."""
    import public_tokenizers

    return bpe.ranks_of(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), *vocabulary())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.deduplicate(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_symbols").alias("n_bytes"), "n_removed", (F.octet_length("spans") / 8).cast("bigint").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeated(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_symbols").alias("n_words"), "n_removed", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of all pages against a replica in WARC files, written and read again, which has lost every 389th page and
    has a payload's first byte changed in every 97th."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    harmed = pages.where("page_id is null or page_id % 389 != 7").withColumn("html", F.when(F.col("page_id") % 97 == 5, F.concat(F.lit("~"), F.expr("substring(coalesce(html, ''), 2)"))).otherwise(F.col("html")))
    out = warc.fixity(warc.layout(pages), warc.read(warc.write(harmed)))
    return out.select(F.col("id").alias("page_id"), F.col("file").alias("file_no"), "ordinal", "offset", "length", "digest", "status")


#: Both replicas as they are laid out, and every record met by its id: no rule says which pages were harmed but the damage itself.
OP7_SQL = """
WITH p AS (SELECT 'a' AS side, page_id, url, coalesce(html, '') AS html FROM pages
  UNION ALL SELECT 'b', page_id, url, CASE WHEN page_id % 97 = 5 THEN '~' || substring(coalesce(html, ''), 2) ELSE coalesce(html, '') END FROM pages WHERE page_id % 389 <> 7),
r AS (
  SELECT side, page_id, page_id // 512 AS file_no,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
           || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
           || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS rec
  FROM p),
l AS (
  SELECT side, page_id, CAST(file_no AS BIGINT) AS file_no, CAST(row_number() OVER w - 1 AS BIGINT) AS ordinal,
         CAST(sum(strlen(rec)) OVER w - strlen(rec) AS BIGINT) AS "offset", CAST(strlen(rec) AS BIGINT) AS length, sha256(rec) AS digest
  FROM r WINDOW w AS (PARTITION BY side, file_no ORDER BY page_id, sha256(rec)))
SELECT a.page_id, a.file_no, a.ordinal, a."offset", a.length, a.digest,
       CASE WHEN b.page_id IS NULL THEN 'missing' WHEN b.digest <> a.digest THEN 'changed' WHEN b.ordinal <> a.ordinal OR b."offset" <> a."offset" THEN 'moved' ELSE 'ok' END AS status
FROM l a LEFT JOIN l b ON b.side = 'b' AND b.page_id = a.page_id WHERE a.side = 'a'
"""


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "lang_rejected")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.count_documents(spark, docs, *vocabulary()).select("doc_id", "n_tokens")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation begins with the first h turns of the one whose id is the multiple of five below, h by its own id."""
    c = F.col("c")
    heads = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(9))
    return trie.trie(*trie.rebuilt(trie.turns(read(spark, sf_dir, "conversations")), c - c % 5, heads, 8)).drop("n_ends")


#: Nodes are met by the list of their turns' hashes; a node's subtree is found by the conversations that stand for its nodes.
OP11_SQL = """
WITH t AS (
  SELECT conv_id AS c, sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS dig, strlen(coalesce(text, '')) AS size, turn
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, dig, size, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, dig) AS p FROM t),
h AS (
  SELECT c, c - c % 5 AS b, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda crc, x: list_reduce(list_concat([xor(crc, x)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) % 9 AS h
  FROM (SELECT DISTINCT c FROM t)),
taken AS (SELECT h.c, n.p, n.dig, n.size FROM h JOIN n ON n.c = h.b AND n.p <= h.h),
k AS (SELECT c, count(*) AS k FROM taken GROUP BY c),
r AS (
  SELECT * FROM taken
  UNION ALL SELECT n.c, n.p - h.h + coalesce(k.k, 0), n.dig, n.size FROM n JOIN h ON h.c = n.c AND n.p > h.h LEFT JOIN k ON k.c = n.c),
chain AS (
  SELECT c, p AS d, size, sha256(string_agg(dig, '') OVER w) AS node, p = max(p) OVER (PARTITION BY c) AS last FROM r WINDOW w AS (PARTITION BY c ORDER BY p)
  UNION ALL SELECT c, 0, 0, 'root', c NOT IN (SELECT c FROM r) FROM h),
links AS (SELECT c, d, size, node, last, lag(node) OVER (PARTITION BY c ORDER BY d) AS parent FROM chain),
nodes AS (
  SELECT node, min(c) AS conv_id, any_value(d) AS depth, any_value(parent) AS parent, count(*) AS n_convs, any_value(size) AS size,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last), '')) AS ends_sha256
  FROM links GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (
  SELECT l.node, count(*) FILTER (WHERE kids.n IS NULL) AS n_leaves, sum((m.n_convs - 1) * m.size) AS saved
  FROM nodes m JOIN links l ON l.c = m.conv_id AND l.d <= m.depth LEFT JOIN kids ON kids.node = m.node GROUP BY l.node)
SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, a.n_convs, coalesce(kids.n, 0) AS n_children, below.n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, a.ends_sha256
FROM nodes a JOIN below ON below.node = a.node LEFT JOIN kids ON kids.node = a.node LEFT JOIN nodes p ON p.node = a.parent
"""


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


#: Every contiguous sequence of up to five words of a piece is counted; the rest is the contract's arithmetic in 128 bits.
OP13_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
ws AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: list_slice(w, i, i + m - 1))) AS g FROM ws, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w)) AS n FROM ws GROUP BY lang),
inner_ AS (SELECT lang, list_slice(g, s, s + m - 1) AS g, max(f) AS most FROM (SELECT lang, g, f, unnest([1, 2]) AS s, m - 1 AS m FROM f WHERE m > 2) GROUP BY ALL),
kept AS (SELECT f.* FROM f LEFT JOIN inner_ i ON i.lang = f.lang AND i.g = f.g WHERE f.m > 1 AND (i.most IS NULL OR i.most < f.f)),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, c.k, x.f AS l, y.f AS r, CAST(n.n AS BIGINT) AS n, 1000::HUGEINT * c.f * CAST(n.n AS HUGEINT) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM kept) c JOIN n ON n.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, c.k) JOIN f y ON y.lang = c.lang AND y.g = list_slice(c.g, c.k + 1, c.m)),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
out AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM best)
SELECT * FROM out WHERE rank <= 2000
"""


#: Name: query, DuckDB SQL or None.
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_quality": (op1_quality, None),
    "op2_lm_scoring": (op2_lm_scoring, None),
    "op3_bpe": (op3_bpe, None),
    "op4_suffix_dedup": (op4_suffix_dedup, None),
    "op5_substring_dedup": (op5_substring_dedup, None),
    "op6_simhash": (op6_simhash, None),
    "op7_warc_fixity": (op7_warc_fixity, OP7_SQL),
    "op8_decontamination": (op8_decontamination, None),
    "op9_language": (op9_language, None),
    "op10_token_counts": (op10_token_counts, None),
    "op11_prefix_trie": (op11_prefix_trie, OP11_SQL),
    "op12_neighbours": (op12_neighbours, None),
    "op13_collocations": (op13_collocations, OP13_SQL),
}
