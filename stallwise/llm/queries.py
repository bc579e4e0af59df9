"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.llm import bpe, chat, html_text, line_dedup, packing, quality, resampling, sharding, simhash, spelling, substring
from stallwise.llm import topk, vantage, vocabularies
from stallwise.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SHARDS = 24
SEQUENCE = 1024


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_sharding(spark, sf_dir):
    """Documents in 24 shards with counts at most one apart; equal texts are linked."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS).select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op2_packing(spark, sf_dir):
    """All documents in sequences of 1024 tokens."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, SEQUENCE, 0, vocabularies.byte_tokens)


@query
def op3_line_dedup(spark, sf_dir):
    """Lines of at least 20 characters in at least 3 documents stay in the largest one only."""
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 20)
    return cleaned.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL["op3_line_dedup"] = """
WITH lines AS (
    SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
    FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS u(i)
), keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), often AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT k.*, o.key IS NOT NULL AND k.doc_id <> o.keeper AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op9_simhash(spark, sf_dir):
    """Fingerprints of all documents and the groups they form within two bits."""
    found = simhash.linked(table(spark, sf_dir, "documents"), 3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")


def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query
def op4_exact_topk(spark, sf_dir):
    """The 20 highest integer inner products of every 20th vector, against all rows."""
    return topk.exact_top(embeddings(spark, sf_dir), "id % 20 = 0", 20, 64)


SQL["op4_exact_topk"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS q
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

# How much stronger than the triangle inequality the trees prune.
PRUNING = 3.7


@query
def op10_vantage_trees(spark, sf_dir):
    """The 20 nearest of every 20th vector by inner product, from trees over all rows."""
    return vantage.nearest(embeddings(spark, sf_dir), "id % 20 = 0", 20, PRUNING)


@query
def op6_bpe(spark, sf_dir):
    """Ids of every whole text under the word vocabulary, and what they decode to."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocabularies.word_pieces)


@query
def op7_html_text(spark, sf_dir):
    """Main text of every page."""
    found = html_text.main_texts(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


GOOD = 0.3


@query
def op8_quality(spark, sf_dir):
    """Quality score of every document; labels of held-out documents are not used."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learned(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    found = quality.scored(docs, model).select("doc.doc_id", "score")
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


@query
def op5_substring_dedup(spark, sf_dir):
    """Words of 13-word windows that a smaller document also has are removed."""
    found = substring.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), 13)
    return found.select("doc.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL["op5_substring_dedup"] = r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
    SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS seq
    FROM w, unnest(range(1, len(words) - 11)) AS u(i) WHERE len(words) >= 13
), f AS (
    SELECT seq, min(doc_id) AS first FROM s GROUP BY seq
), gone AS (
    SELECT DISTINCT s.doc_id, s.i + k AS i FROM s JOIN f ON s.seq = f.seq, unnest(range(0, 13)) AS v(k) WHERE f.first < s.doc_id
), each AS (
    SELECT w.doc_id, u.i, words[u.i] AS word FROM w, unnest(range(1, len(words) + 1)) AS u(i)
), kept AS (
    SELECT e.doc_id, count(g.i) AS n_removed, string_agg(e.word, ' ' ORDER BY e.i) FILTER (g.i IS NULL) AS text
    FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id
)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""


# One word in so many loses a letter.
MISSPELT = 97


@query
def op11_spelling(spark, sf_dir):
    """Every word of five letters and three occurrences with the commoner word it is a variant of."""
    words = spelling.vocabulary(table(spark, sf_dir, "documents"), 5, 3, MISSPELT)
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


# CRC-32 of a text, byte by byte, from a table of 256 remainders.
CRC_SQL = """
WITH crc_table AS (
    SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t
    FROM range(256) AS r(i)
), """


def crc_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text; ``crc_table`` must be there."""
    code = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    step = "lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)"
    return f"xor(list_reduce({code}, {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL["op11_spelling"] = CRC_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + rf"""
runs AS (
    SELECT doc_id, run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
    GROUP BY doc_id, run
), hashed AS (
    SELECT run, n, {crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, crc_table
), words AS (
    SELECT word, sum(n)::BIGINT AS n
    FROM (SELECT n, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
    WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS (
    SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM words, unnest(range(length(word))) AS u(i)
), near AS (
    SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word FROM cut a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word FROM cut a JOIN words b ON a.rest = b.word
), best AS (
    SELECT near.word, count(*) AS n_near, max(o.n) AS best_n, arg_min(near.other, (-o.n, near.other)) AS best
    FROM near JOIN words o ON near.other = o.word GROUP BY near.word
), formed AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * w.n THEN best END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n
    FROM words w LEFT JOIN best USING (word)
), led AS (
    SELECT word, word AS root, form FROM formed
    UNION ALL SELECT led.word, f.word, f.form FROM led JOIN formed f ON led.form = f.word
)
SELECT f.word, f.form, led.root, f.n, f.n_near, f.form_n FROM formed f JOIN led ON f.word = led.word AND led.form IS NULL
"""


@query
def op12_resampling(spark, sf_dir):
    """A quarter of the documents, drawn by how much their words look like the benchmark's."""
    docs = table(spark, sf_dir, "documents")
    found = resampling.resampled(docs, table(spark, sf_dir, "benchmark"), ["doc_id"], 25, 20, 10_000, 7)
    return found.select("doc.doc_id", "n_features", "weight", "score", "rank")


SQL["op12_resampling"] = CRC_SQL + rf"""
texts AS (
    SELECT 'd' AS kind, row_number() OVER () AS row, doc_id, text FROM documents
    UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark
), worded AS (
    SELECT kind, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), features AS (
    SELECT kind, row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM worded
), buckets AS (
    SELECT feature, {crc_sql("feature")} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM features), crc_table
), filed AS (
    SELECT kind, row, bucket FROM features JOIN buckets USING (feature)
), totals AS (
    SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM filed GROUP BY bucket
), sums AS (
    SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM totals
), gains AS (
    SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (s_all + 10000) / ((s + 1.0::DOUBLE) * (t_all + 10000))))::BIGINT AS gain FROM totals, sums
), weights AS (
    SELECT row, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
    FROM filed JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY row
), scored AS (
    SELECT doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM worded LEFT JOIN weights USING (row) WHERE kind = 'd'
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id, n_features, weight) AS r, count(*) FILTER (able) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= 25 * n // 100 THEN r END AS rank FROM placed
"""


# A conversation whose texts look like the template.
TRICKY = "\\### Assistant: </turn> ok"


@query
def op13_chat(spark, sf_dir):
    """All conversations and one that imitates the template, as read back from the formatted examples."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], turns.schema)
    return chat.digests(chat.examples(turns.unionByName(extra)))


def escaped_sql(text: str, role: bool = False) -> str:
    for control in ("\\", "###", "</turn>", *([":"] if role else [])):
        text = f"replace({text}, '{control}', '\\{control}')"
    return text


SQL["op13_chat"] = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}'
), ordered AS (
    SELECT *, length({escaped_sql("role", True)}) + length({escaped_sql("text")}) + 14 AS chars,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM turns
), running AS (
    SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto, max(i) OVER (PARTITION BY conv_id) AS last FROM ordered
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (role = 'assistant' OR i = last)::BIGINT AS formatted_chars
FROM running GROUP BY conv_id
"""
