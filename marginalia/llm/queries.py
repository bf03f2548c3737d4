"""Registered queries of the pipeline operators: name -> (job, SQL or None)."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from . import (chat, decontaminate, fertility, kneser_ney, line_dedup, odd_minhash, passages, piece_codec, runs, site_quality, token_count, toxicity,
               vantage)


def read(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op1_substring_dedup(spark, folder):
    """Passages of fifty words or more that documents share with earlier ones."""
    return passages.repeated_passages(read(spark, folder, "documents"))


#: A conversation whose texts hold the escape sign and both control strings.
TRICKY = "\\### Assistant: </turn> ok"


def op2_chat_format(spark, folder):
    """Every conversation, and one more with control strings in its texts, formatted and read back."""
    turns = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], turns.schema)
    return chat.digests(chat.format_conversations(turns.union(more)))


CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ') + length(role) + len(regexp_extract_all(role, '\\|###|</turn>|:')) + length(': ') + length(text)
           + len(regexp_extract_all(text, '\\|###|</turn>')) + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


def op3_decontaminate(spark, folder):
    """Benchmark items that occur in each document."""
    found = decontaminate.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


DECONTAMINATE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT item_id, least(10, len(w)) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM bw),
sizes AS (SELECT DISTINCT k FROM win),
places AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, sizes),
hits AS (SELECT doc_id, p, win.k, item_id FROM (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS s FROM places) x JOIN win ON x.k = win.k AND x.s = win.s),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""


def op4_site_quality(spark, folder):
    """Documents by their own quality and that of their source, and of their language within it."""
    return site_quality.site_quality(read(spark, folder, "documents"), read(spark, folder, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))


def op5_lm_score(spark, folder):
    """Every document under a language model of the documents that are not held out."""
    return kneser_ney.perplexity(read(spark, folder, "documents"))


def op6_piece_codec(spark, folder):
    """Ids and decoded text of every document, as digests."""
    coded = piece_codec.round_trip(read(spark, folder, "documents"), piece_model())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                        F.sha2("text", 256).alias("decoded_sha256"))


def op7_toxicity(spark, folder):
    return toxicity.toxicity(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op8_near_dedup(spark, folder):
    """Components of documents with four-word shingle sets at 0.8 or more."""
    return odd_minhash.near_duplicates(read(spark, folder, "documents"), odd_minhash.Settings(width=4))


NEAR_DEDUP_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
             FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a),
least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)"""


def op9_token_count(spark, folder):
    return token_count.count_tokens(read(spark, folder, "documents"), piece_model())


def op10_fertility(spark, folder):
    return fertility.fertility(read(spark, folder, "documents"), piece_model())


def looped(doc_id, words):
    """The words of one document in ten with a tail that goes round; others, and those without an id, as they are."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % period] for i in range(a, n)]


def op11_periodic_runs(spark, folder):
    """Runs of repeated words in every document, as digests."""
    found = runs.periodic_runs(read(spark, folder, "documents"), edit=looped)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.withColumn("best", best).withColumn("length", F.col("best.length")).withColumn("period", -F.col("best.p"))
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), "length", "period",
                      F.expr("1000 * length div period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))


def op12_vantage_clusters(spark, folder):
    """Eight clusters of the vectors, seeded by hashes of their ids."""
    seeds = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    return vantage.with_inertia(*vantage.cluster(read(spark, folder, "embeddings"), 8, seeds))


def cluster_sql(k: int = 8, rounds: int = 10, dimensions: int = 64) -> str:
    """The rounds one after the other, components as rows."""
    nearest = """a{0} AS MATERIALIZED (SELECT vec_id, c, d FROM (SELECT vec_id, c, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS r
      FROM (SELECT vec_id, c, sum((v - m) * (v - m)) AS d FROM x JOIN m{0} USING (i) GROUP BY ALL)) WHERE r = 1)"""
    moved = """m{1} AS MATERIALIZED (SELECT c, i, (s - ((s % n) + n) % n) // n AS m FROM (SELECT c, i, sum(v) AS s, count(*) AS n FROM a{0} JOIN x USING (vec_id) GROUP BY c, i)
      UNION ALL SELECT c, i, m FROM m{0} WHERE c NOT IN (SELECT c FROM a{0}))"""
    steps = [f"""flat AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS e FROM embeddings WHERE len(embedding) = {dimensions}),
    good AS (SELECT vec_id FROM flat GROUP BY vec_id HAVING count(e) = {dimensions} AND bool_and(isfinite(e))),
    x AS MATERIALIZED (SELECT vec_id, i, CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT) AS v FROM flat SEMI JOIN good USING (vec_id)),
    seeds AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM good ORDER BY c LIMIT {k}),
    m0 AS MATERIALIZED (SELECT c, i, v AS m FROM seeds JOIN x USING (vec_id))"""]
    for n in range(rounds):
        steps += [nearest.format(n), moved.format(n, n + 1)]
    steps.append(nearest.format(rounds))
    return f"""WITH {", ".join(steps)},
    digests AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM m{rounds} GROUP BY c)
    SELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
      CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN digests USING (c)"""


def op13_line_dedup(spark, folder):
    """Documents without the lines that a later one of at least five holds too, as digests."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    left = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs))
    return left.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


LINE_DEDUP_SQL = r"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
l AS (SELECT doc_id, i, s[i] AS line, translate(regexp_replace(s[i], '^[ 	-
]+|[ 	-
]+$', '', 'g'),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM parts)),
held AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id <> keeper) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM l LEFT JOIN held USING (k) GROUP BY doc_id"""


QUERIES = {
    "op1_substring_dedup": (op1_substring_dedup, None),
    "op3_decontaminate": (op3_decontaminate, DECONTAMINATE_SQL),
    "op2_chat_format": (op2_chat_format, CHAT_SQL),
    "op4_site_quality": (op4_site_quality, None),
    "op5_lm_score": (op5_lm_score, None),
    "op6_piece_codec": (op6_piece_codec, None),
    "op7_toxicity": (op7_toxicity, None),
    "op8_near_dedup": (op8_near_dedup, NEAR_DEDUP_SQL),
    "op9_token_count": (op9_token_count, None),
    "op10_fertility": (op10_fertility, None),
    "op11_periodic_runs": (op11_periodic_runs, None),
    "op12_vantage_clusters": (op12_vantage_clusters, cluster_sql()),
    "op13_line_dedup": (op13_line_dedup, LINE_DEDUP_SQL),
}
