"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import chat, decontaminate, lattice, minhash, packing, secret_scan, substrings, token_count, token_store, toxicity
from quern.llm.common import Workspace


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    columns = "conv_id long, turn long, role string, text string"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], columns)
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    space = Workspace(spark, "chat")
    return chat.read_back(space.table(chat.format_conversations(rows), "formatted"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards, dictionary = token_store.write_store(_read(spark, sf_dir, "documents"), Workspace(spark, "tokens"))
    return token_store.read_store(shards, dictionary)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents")).drop("ids")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_read(spark, sf_dir, "documents"), Workspace(spark, "substrings"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "secrets")
    ledger = secret_scan.Ledger(spark, f"{space.root}/ledger")
    paths, _ = ledger.scan(_read(spark, sf_dir, "documents"), space)
    return secret_scan.digest(secret_scan.findings_by_path(paths, ledger.read()))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_read(spark, sf_dir, "documents"))


def op8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(_read(spark, sf_dir, "embeddings"), Workspace(spark, "lattice"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_read(spark, sf_dir, "documents"), Workspace(spark, "minhash"), size=2)
    return found.select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


QUERIES = {
    "op1_chat": op1_chat,
    "op2_token_store": op2_token_store,
    "op3_packing": op3_packing,
    "op4_substrings": op4_substrings,
    "op5_decontamination": op5_decontamination,
    "op6_secrets": op6_secrets,
    "op7_token_counts": op7_token_counts,
    "op8_lattice": op8_lattice,
    "op9_minhash": op9_minhash,
    "op10_toxicity": op10_toxicity,
}

ORACLES = {
    "op1_chat": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(15 + length(regexp_replace(role, '\\|#|:|</turn>', 'xx', 'g')) + 6 * len(regexp_extract_all(role, '</turn>'))
                + length(text) + len(regexp_extract_all(text, '\\|#|</turn>'))) AS BIGINT) AS formatted_chars
        FROM rows GROUP BY conv_id""",
    "op4_substrings": r"""
        WITH texts AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        windows AS (
            SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS window_
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM texts WHERE len(words) >= 50)),
        firsts AS (SELECT window_, min(doc_id) AS least FROM windows GROUP BY window_),
        repeats AS (
            SELECT w.doc_id, list(DISTINCT w.i) AS starts FROM windows w JOIN firsts f ON w.window_ = f.window_
            WHERE w.doc_id > f.least GROUP BY w.doc_id),
        gone AS (
            SELECT doc_id, list(DISTINCT p) AS positions
            FROM (SELECT doc_id, unnest(range(s, s + 50)) AS p FROM (SELECT doc_id, unnest(starts) AS s FROM repeats))
            GROUP BY doc_id),
        kept AS (
            SELECT t.doc_id, t.words, coalesce(g.positions, []) AS positions FROM texts t LEFT JOIN gone g ON t.doc_id = g.doc_id),
        flat AS (
            SELECT k.doc_id, u.p, k.words[u.p] AS word
            FROM kept k, LATERAL (SELECT unnest(range(1, len(k.words) + 1)) AS p) u),
        left_ AS (
            SELECT f.doc_id, string_agg(f.word, ' ' ORDER BY f.p) AS words FROM flat f
            LEFT JOIN (SELECT doc_id, unnest(positions) AS p FROM gone) g ON f.doc_id = g.doc_id AND f.p = g.p
            WHERE g.p IS NULL GROUP BY f.doc_id)
        SELECT k.doc_id, CAST(len(k.words) AS BIGINT) AS n_words, CAST(len(k.positions) AS BIGINT) AS n_removed,
            sha256(coalesce(l.words, '')) AS kept_sha256
        FROM kept k LEFT JOIN left_ l ON k.doc_id = l.doc_id""",
    "op8_lattice": """
        WITH RECURSIVE finite AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS raw, list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda c: abs(c))) AS largest
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
                AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
        -- a power of two changes no cosine, and keeps squares finite
        scaled AS (SELECT vec_id, list_transform(raw, lambda c: c / pow(2.0, floor(log2(largest)))) AS v FROM finite),
        usable AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS norm FROM scaled),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.9),
        reach AS (
            SELECT vec_id AS node, vec_id AS other FROM embeddings
            UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
        least_ AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT l.node AS vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, l.component_id, l.node = l.component_id AS kept
        FROM least_ l LEFT JOIN counts c ON c.a = l.node""",
    "op9_minhash": r"""
        WITH RECURSIVE texts AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
            FROM documents),
        sets AS (
            SELECT doc_id, list_sort(CASE WHEN len(words) = 0 THEN []
                WHEN len(words) = 1 THEN [words[1]]
                ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END) AS shingles
            FROM texts),
        classes AS (
            SELECT min(doc_id) AS id, any_value(shingles) AS shingles, any_value(len(shingles)) AS n
            FROM sets WHERE len(shingles) > 0 GROUP BY md5(array_to_string(shingles, chr(10)))),
        items AS (SELECT id, n, unnest(shingles) AS shingle FROM classes),
        frequency AS (SELECT shingle, count(*) AS c FROM items GROUP BY shingle),
        ranked AS (
            SELECT i.id, i.n, i.shingle, row_number() OVER (PARTITION BY i.id ORDER BY f.c, i.shingle) AS place
            FROM items i JOIN frequency f ON i.shingle = f.shingle),
        -- sets at 0.8 share one of the first n - ceil(0.8 n) + 1 shingles in order of frequency
        prefix AS (SELECT * FROM ranked WHERE place <= n - CAST(ceil(0.8 * n) AS BIGINT) + 1),
        candidates AS (
            SELECT DISTINCT a.id AS a, b.id AS b FROM prefix a JOIN prefix b ON a.shingle = b.shingle
            WHERE a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
        common AS (
            SELECT c.a, c.b, count(*) AS both_ FROM candidates c JOIN items x ON x.id = c.a
            JOIN items y ON y.id = c.b AND y.shingle = x.shingle GROUP BY c.a, c.b),
        links AS (
            SELECT m.a, m.b FROM common m JOIN classes p ON p.id = m.a JOIN classes q ON q.id = m.b
            WHERE 100 * m.both_ >= 80 * (p.n + q.n - m.both_)),
        edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (
            SELECT id AS node, id AS other FROM classes
            UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a),
        least_ AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
        of_set AS (SELECT md5(array_to_string(c.shingles, chr(10))) AS key, l.component FROM classes c JOIN least_ l ON l.node = c.id)
        SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles,
            CASE WHEN len(s.shingles) > 0 THEN o.component ELSE s.doc_id END AS component_id,
            s.doc_id = CASE WHEN len(s.shingles) > 0 THEN o.component ELSE s.doc_id END AS kept
        FROM sets s LEFT JOIN of_set o ON o.key = md5(array_to_string(s.shingles, chr(10)))""",
}
