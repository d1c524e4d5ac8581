"""The registered queries of this package: one per operator, over its whole table, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propensity_spark.functions.session import scratch_path
from propensity_spark.llm import (chat, cover_tree, decontaminate, hilbert_codes, license, license_texts, packing,
                                  quality, shared_search, simhash, substrings, suffix_tables, suffix_tree, token_cache, token_files)
from propensity_spark.llm.common import fold, stored

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.classify(docs, model, ["doc_id"])
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.license_scan(table(spark, sf_dir, "documents"), ["doc_id"], notices=license_texts.licenses())


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))


def contaminated(n_words, n_hit):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_cache.count_tokens(docs, scratch_path(spark, "token-cache"), PIECE_BPE)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold("doc_id") == 1, F.lit(False))
    learned = docs.where(~held_out)
    tree = suffix_tables.train(learned, suffix_tables.word_counts(learned))
    scored = suffix_tables.score(docs, tree)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(tree.train_tokens).cast("long").alias(
            "train_tokens"), "base_score", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), WORD_BPE, end=1)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    kind = dict(turns.dtypes)
    extra = spark.sql("SELECT stack(2, 0, 'user', 1, 'assistant') AS (turn, role)").select(
        F.lit(-7).cast(kind["conv_id"]).alias("conv_id"), F.col("turn").cast(kind["turn"]), "role",
        F.lit(hard).alias("text"))
    made = chat.format_conversations(chat.linear_replies(turns.unionByName(extra)))
    read = made.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                       chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.similar(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, WORD_BPE, end=2)
    return token_files.read_documents(spark, folder)


def op11_shared_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + (r["end"] - r["start"]))
    return found.select("doc_id", "n_words", gone.alias("n_removed"),
                        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_hilbert_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = hilbert_codes.encode(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"),
                                 ["vec_id", "label"])
    made = hilbert_codes.group_errors(stored(coded.vectors, "codes"), "label")
    return made.select("vec_id", "code", "error", "label_error", F.lit(coded.digest()).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_quality_classifier, op2_license_scan, op3_decontamination, op4_token_counts, op5_simhash_dedup,
    op6_suffix_tree, op7_packing, op8_chat_formatting, op9_embedding_dedup, op10_token_files,
    op11_shared_search, op12_substring_dedup, op13_hilbert_codes)}

#: Lower-cases A-Z alone.
LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP3 = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format('text')} AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS.format('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS x
        FROM item, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
place AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS x
          FROM doc, (SELECT DISTINCT n FROM win), unnest(range(1, len(w) - n + 2)) AS t(i)),
found AS (SELECT p.r, p.i, p.n, win.item FROM place p JOIN win ON p.x = win.x AND p.n = win.n),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM found, unnest(range(i, i + n)) AS t(j) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT r, item FROM found WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

OP9 = """
WITH usable AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
    FROM embeddings),
ok AS (SELECT r, vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM usable
       WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(v, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.r <> b.r AND len(a.v) = len(b.v)
         WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95),
reach AS (WITH RECURSIVE walk(a, b) AS (
              SELECT a, b FROM link UNION SELECT walk.a, link.b FROM walk JOIN link ON walk.b = link.a)
          SELECT a, min(vec_id) AS least FROM walk JOIN usable ON usable.r = walk.b GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, reach.least) AS component_id,
       vec_id IS NOT DISTINCT FROM least(vec_id, reach.least) AS kept
FROM usable LEFT JOIN n ON n.a = usable.r LEFT JOIN reach ON reach.a = usable.r
"""

OP8 = """
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
said AS (
    SELECT conv_id, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
           coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
           sum(4 + length(role) + 1 + length(text) + 8
               + length(text) - length(replace(text, '\\', ''))
               + greatest(0, coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'),
                                                              lambda x: length(x) - 2)), 0))
               + (length(text) - length(replace(text, '</turn>', ''))) // 7) AS formatted_chars
    FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM said
"""

OP11 = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format('text')} AS w FROM documents),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM doc) GROUP BY r, t),
n AS (SELECT r, sum(tf) AS n FROM tf GROUP BY r),
whole AS (SELECT count(*) AS nn, sum(n) AS ll FROM n),
item AS (SELECT row_number() OVER () AS q, item_id, {WORDS.format('text')} AS w FROM benchmark),
asked AS (SELECT q, t, count(*) AS k FROM (SELECT q, unnest(w) AS t FROM item) GROUP BY q, t),
df AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * max(nn) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
       FROM tf, whole WHERE t IN (SELECT t FROM asked) GROUP BY t),
part AS (SELECT r, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + CAST((75 * n * nn) // ll AS BIGINT)))) AS s
         FROM tf JOIN df USING (t) JOIN n USING (r), whole),
score AS (SELECT q, r, CAST(sum(k * s) AS BIGINT) AS score FROM asked JOIN part USING (t) GROUP BY q, r),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
           FROM score JOIN doc USING (r) JOIN item USING (q) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

OP12 = """
WITH doc AS (SELECT row_number() OVER () AS r, doc_id,
                    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
place AS (SELECT r, doc_id, i, array_to_string(w[i:i + 19], ' ') AS x FROM doc, unnest(range(1, len(w) - 18)) AS t(i)),
again AS (SELECT r, i FROM (SELECT r, i, rank() OVER (PARTITION BY x ORDER BY doc_id NULLS LAST, i) AS k FROM place)
          WHERE k > 1),
gone AS (SELECT r, list(DISTINCT j) AS js FROM again, unnest(range(i, i + 20)) AS t(j) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(len(js), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_transform(
           list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(js, j)), lambda j: w[j]) END, ' ')) AS kept_sha256
FROM doc LEFT JOIN gone USING (r)
"""

_ROUND = """
near{i} AS MATERIALIZED (
    SELECT r, p, min(256 * d + e) AS best
    FROM (SELECT r, p, e, CAST(sum((c.x - b.x) * (c.x - b.x)) AS BIGINT) AS d
          FROM comp c JOIN book{i} b USING (p, j) GROUP BY r, p, e)
    GROUP BY r, p),
"""
_BOOK = """
book{k} AS MATERIALIZED (
    SELECT p, e, j, coalesce(n.x, b.x) AS x
    FROM book{i} b LEFT JOIN (
        SELECT p, best % 256 AS e, j, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x
        FROM near{i} JOIN comp USING (r, p) GROUP BY p, best % 256, j) n USING (p, e, j)),
"""

OP13 = f"""
WITH ok AS (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS r, vec_id, label, v
    FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
comp AS MATERIALIZED (
    SELECT r, 4 * (i - 1) // len(v) AS p, (i - 1) % (len(v) // 4) AS j, v[i] AS x
    FROM ok, unnest(range(1, len(v) + 1)) AS t(i)),
book0 AS MATERIALIZED (SELECT p, r AS e, j, x FROM comp WHERE r < 256),
{"".join(_ROUND.format(i=i) + _BOOK.format(i=i, k=i + 1) for i in range(4))}
{_ROUND.format(i=4)}
coded AS (
    SELECT r, string_agg(format('{{:02x}}', best % 256), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error
    FROM near4 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, j)) FROM book4) AS codebooks_sha256
FROM ok JOIN coded USING (r)
"""

ORACLES = {"op3_decontamination": OP3, "op8_chat_formatting": OP8, "op9_embedding_dedup": OP9,
           "op11_shared_search": OP11, "op12_substring_dedup": OP12, "op13_hilbert_codes": OP13}
