"""The corpus operators as queries: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fingerprint_index, language_id, line_windows, mixing, periodic_runs, permutation_index, pii_crf, prefix_trie, product_quantisation, simhash, token_output, warc
from .common import materialize, table

END_ID = 1


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_token_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_output.token_archive(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)
    return token_output.read_documents(spark, path)


def op2_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    counted = found.withColumn("n_hit", decontamination.hit_words())
    return counted.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        decontamination.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op3_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_windows.dedup_lines(table(spark, sf_dir, "documents"))
    return cut.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(spark, warc.write_archives(table(spark, sf_dir, "pages")))


def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.replicate(table(spark, sf_dir, "documents"))
    return mixed.select("row.doc_id", "row.source", F.col("copy").cast("long").alias("copy"), "place", F.length("row.text").cast("long").alias("text_length"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_index.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op8_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_quantisation.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("row.doc_id", "held_out", "lang_pred", "score")


def op10_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii_crf.find(docs, pii_crf.train(docs))
    counts = [pii_crf.count_of(kind).alias(f"n_{kind}") for kind in pii_crf.KINDS]
    return found.select("doc_id", *counts, "base_sha256", F.col("spelled").alias("spans"))


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of every rebuilt conversation, and all conversations (conv_id).

    Conversation c begins with the first crc32(c) % 6 turns of c - c % 100, or
    those that there are, and goes on with its own turns after as many.
    """
    original = materialize(prefix_trie.ordered(conversations), "trie-original")
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6))
    convs = original.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", taken.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    convs = materialize(convs, "trie-conversations")
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    named = convs.join(sizes, "base", "left").select("conv_id", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("lent"))
    own = original.join(named, "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("lent")).alias("place"), "role", "text")
    heads = original.where("place <= 5").select(F.col("conv_id").alias("base"), "place", "role", "text")
    lent = heads.join(named, "base").where("place <= h").select("conv_id", "place", "role", "text")
    return lent.unionByName(own), convs.select("conv_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*rebuilt_turns(table(spark, sf_dir, "conversations")))


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents with everything after a drawn word replaced by its own beginning, again and again."""
    drawn = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(drawn / 10), F.size("w").cast("long")
    words = F.when(drawn % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    a = docs.select("doc_id", "text", words.alias("w")).withColumn("a", F.when(n > 0, g % n))
    placed = a.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    at = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))
    changed = F.array_join(F.transform(at, lambda i: F.get("w", i.cast("int"))), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_periods(table(spark, sf_dir, "documents")))
    spelled = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    found = found.withColumn("best", periodic_runs.strongest())
    return found.select(
        "row.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.concat(F.lit(""), F.array_join(F.transform(spelled, lambda x: F.concat(x, F.lit("\n"))), "")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return permutation_index.search(permutation_index.build(vectors), vectors.where("vec_id % 20 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_rans,
        op2_fm_decontamination,
        op3_line_windows,
        op4_warc_revisits,
        op5_poisson_mixing,
        op6_simhash,
        op7_fingerprint_index,
        op8_product_quantisation,
        op9_ppm_language,
        op10_pii_crf,
        op11_prefix_trie,
        op12_periodic_runs,
        op13_permutation_index,
    )
}

_OP3 = r"""
WITH t AS (SELECT doc_id, coalesce(string_split(text, chr(10)), []) AS l FROM documents),
w AS (SELECT doc_id, i, l[i] AS a, l[i + 1] AS b, l[i + 2] AS c FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM t)),
f AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS k FROM w),
g AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS j FROM f WHERE k > 1)),
x AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM t),
y AS (SELECT x.doc_id, string_agg(line, chr(10) ORDER BY x.i) AS kept, count(*) AS n FROM x ANTI JOIN g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY 1)
SELECT t.doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN y ON t.doc_id = y.doc_id
"""

_OP4 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d, max(page_id) OVER (PARTITION BY b) AS m FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND m <> page_id THEN m END AS refers_to
FROM q
"""

_OP5 = """
WITH s AS (SELECT source, sum(CAST(coalesce(length(text), 0) AS DOUBLE)) AS chars FROM documents GROUP BY 1),
r AS (SELECT source, pow(chars, 0.5) / sum(pow(chars, 0.5)) OVER () * sum(chars) OVER () / chars AS rate FROM s WHERE chars > 0),
d AS (SELECT doc_id, source, text, rate, greatest(CAST(ceil(coalesce(rate, 1) / 8.0) AS INT), 1) AS parts
      FROM documents LEFT JOIN r USING (source)),
u AS (SELECT *, rate / parts AS part_rate, CAST(('0x' || substr(md5('17:' || part || ':' || doc_id), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
      FROM (SELECT *, unnest(range(1, parts + 1)) AS part FROM d)),
k AS (SELECT doc_id, sum(CASE WHEN rate IS NULL THEN 1 ELSE
        list_reduce(list_prepend({'t': exp(-part_rate), 's': exp(-part_rate), 'k': 0::DOUBLE},
                                 list_transform(range(1, 49), lambda i: {'t': i::DOUBLE, 's': 0::DOUBLE, 'k': 0::DOUBLE})),
          lambda a, b: {'t': a.t * part_rate / b.t, 's': a.s + a.t * part_rate / b.t, 'k': a.k + CASE WHEN u >= a.s THEN 1 ELSE 0 END}).k END) AS n
      FROM u GROUP BY 1),
c AS (SELECT d.doc_id, d.source, d.text, unnest(range(1, CAST(n AS BIGINT) + 1)) AS copy FROM d JOIN k USING (doc_id))
SELECT doc_id, source, CAST(copy AS BIGINT) AS copy,
       CAST(('0x' || substr(md5('18:0:' || doc_id || '/' || copy), 1, 13)) AS BIGINT) AS place,
       CAST(length(text) AS BIGINT) AS text_length
FROM c
"""

_OP7 = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM t),
s AS (SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 12), ' ')) AS h FROM x),
f AS (SELECT h, min(doc_id) AS first_doc FROM s GROUP BY 1),
g AS (SELECT doc_id, list(DISTINCT i + j) AS gone FROM (SELECT s.doc_id, s.i, unnest(range(13)) AS j FROM s JOIN f USING (h) WHERE f.first_doc < s.doc_id) GROUP BY 1)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda v, k: NOT list_contains(gone, k)) END, ' ')) AS kept_sha256
FROM t LEFT JOIN g USING (doc_id)
"""

_OP8 = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND list_bool_and(list_transform(e, lambda x: coalesce(isfinite(x), false)))
      AND list_bool_or(list_transform(e, lambda x: x <> 0))),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, p.b FROM r JOIN p ON p.a = r.c)
SELECT r.vec_id, CAST(any_value(coalesce(n, 0)) AS BIGINT) AS n_links, min(c) AS component_id, min(c) = r.vec_id AS kept
FROM r LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY 1) k ON k.a = r.vec_id GROUP BY r.vec_id
"""

_OP11 = """
WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
           FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, count(*) AS n, c - c % 100 AS b,
        flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])) AS bits FROM o GROUP BY c),
k AS (SELECT c, n, b, xor(list_reduce(list_prepend(4294967295::BIGINT, bits), lambda r, x: xor(xor(r, x) >> 1, (xor(r, x) & 1) * 3988292384)), 4294967295::BIGINT) % 6 AS h FROM s),
r AS (SELECT k.c, o.p, o.role, o.text FROM k JOIN o ON o.c = k.b AND o.p <= k.h
      UNION ALL
      SELECT k.c, o.p - k.h + least(k.h, coalesce(b.n, 0)), o.role, o.text FROM k JOIN o ON o.c = k.c AND o.p > k.h LEFT JOIN k b ON b.c = k.b),
t AS (SELECT k.c, coalesce(l, []) AS l, ch FROM k LEFT JOIN
      (SELECT c, list(length(role) || ':' || role || text ORDER BY p) AS l, list(length(text) ORDER BY p) AS ch FROM r GROUP BY c) USING (c)),
m AS (SELECT c, l, ch, unnest(range(0, len(l) + 1)) AS d FROM t),
g AS (SELECT d, list_slice(l, 1, d) AS key, min(c) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN d > 0 THEN ch[d] ELSE 0 END) AS chars,
        sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len(l) = d), '')) AS ends FROM m GROUP BY 1, 2),
kids AS (SELECT d - 1 AS d, list_slice(key, 1, d - 1) AS key, count(*) AS n FROM g WHERE d > 0 GROUP BY 1, 2),
f AS (SELECT g.*, coalesce(kids.n, 0) AS n_children FROM g LEFT JOIN kids USING (d, key)),
u AS (SELECT a AS d, list_slice(key, 1, a) AS key, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved
      FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f) GROUP BY 1, 2)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(f.n_convs AS BIGINT) AS n_convs, CAST(f.n_children AS BIGINT) AS n_children,
       CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN u USING (d, key) LEFT JOIN f up ON up.d = f.d - 1 AND up.key = list_slice(f.key, 1, f.d - 1)
"""

# All neighbours; the index finds the same where a shard reranks all that it holds, as it does up to 512 rows.
_OP13 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND e IS NOT NULL AND list_bool_and(list_transform(e, lambda x: coalesce(isfinite(x), false)))
      AND list_bool_or(list_transform(e, lambda x: x <> 0))),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e) AS score FROM g a JOIN g b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

ORACLES: dict[str, str] = {
    "op3_line_windows": _OP3,
    "op4_warc_revisits": _OP4,
    "op5_poisson_mixing": _OP5,
    "op7_fingerprint_index": _OP7,
    "op8_product_quantisation": _OP8,
    "op11_prefix_trie": _OP11,
    "op13_permutation_index": _OP13,
}
