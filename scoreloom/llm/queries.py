"""The registered queries of this package, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm import bpe, chat, compaction, fertility, language_id, line_dedup, minhash, mixing, periodic, simhash, suffix_dedup, warc, whitening
from scoreloom.llm._common import shared_dir, table


def op1_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fertility.measure(table(spark, sf_dir, "documents"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select(*first, *[c for c in found.columns if c not in first])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edit_test(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.span_digests(table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive in eight parts, are compacted after each, and are read back from the newest manifest."""
    store = compaction.ShardTable(spark, shared_dir(spark, "shards"))
    store.append_each(table(spark, sf_dir, "documents").withColumn("arrival", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(8))), "arrival")
    sha = F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    return store.read().select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), sha)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    found = warc.read_archives(spark, path, with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", language_id.held_out_of(F.col("doc_id")).alias("held_out"))
    net = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.predict(docs.drop("lang"), net).select("doc_id", "held_out", "lang_pred", "score")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(periodic.with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of two turns whose texts are control strings."""
    columns = "conv_id long, turn long, role string, text string"
    control = spark.createDataFrame([(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], columns)
    return chat.digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(control))


QUERIES = {
    f.__name__: f
    for f in (
        op1_fertility, op2_simhash, op3_suffix_dedup, op4_minhash, op5_sharding, op6_warc, op7_bpe, op8_line_dedup, op9_mixing, op10_language_id, op11_whitening, op12_periodic, op13_chat,
    )
}

#: How much longer escaping makes a text.
_MORE = r"CAST(length(X) - length(replace(X, '\', '')) + len(regexp_extract_all(X, '<\||</?s>|<</?SYS>>|\[/?INST\]')) AS BIGINT)"

SQL = {
    "op5_sharding": """
        SELECT doc_id, lang, source, n_chars, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256 FROM documents""",
    "op6_warc": """
        WITH p AS (
          SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages
        ), f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
        SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS error
        FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100""",
    "op8_line_dedup": r"""
        WITH l AS (
          SELECT doc_id, line, pos, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
          FROM (SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))
        ), g AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
        k AS (SELECT l.*, coalesce(first < doc_id, false) AS goes FROM l LEFT JOIN g USING (key))
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (goes) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS kept_sha256
        FROM k GROUP BY doc_id""",
    "op9_mixing": r"""
        WITH d AS (
          SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
        ), s AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source
        ), w AS (
          SELECT *, CAST([3, 1, 2][(r - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS stop FROM s
        ), x AS (
          SELECT *, stop / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS share FROM w
        ), y AS (
          SELECT *, (share - coalesce(sum(stop) OVER (ORDER BY ratio, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / sum(weight) OVER (ORDER BY ratio, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM x
        ), z AS (
          SELECT source, source_size, least(stop, coalesce((SELECT arg_min(level, ratio) FROM y WHERE level <= ratio) * weight, stop)) AS target FROM y
        ), e AS (
          SELECT d.doc_id, d.source, size, source_size, target,
                 CAST(CASE WHEN source_size > 0 THEN round(target / source_size * 4294967296::DOUBLE) ELSE 0 END AS BIGINT) AS expected
          FROM d JOIN z ON d.source IS NOT DISTINCT FROM z.source
        ), u AS (
          SELECT *, CAST(sum(expected) OVER (PARTITION BY source ORDER BY size, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT)
                    + CAST('0x' || substr(md5('7:' || coalesce(source, '\N')), 1, 8) AS BIGINT) AS upto FROM e
        )
        SELECT doc_id, size, source_size, target, ((upto >> 32) - ((upto - expected) >> 32)) * size AS taken, (upto >> 32) - ((upto - expected) >> 32) AS copies FROM u""",
    "op13_chat": f"""
        WITH c AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
        ), s AS (
          SELECT *, 18 + length(role) + length(role) - length(replace(role, '|', '')) + CAST(role LIKE '%<' AS BIGINT) + {_MORE.replace("X", "role")} + length(text) + {_MORE.replace("X", "text")} AS size FROM c
        ), p AS (
          SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n, CAST(sum(size) OVER w AS BIGINT) AS stop FROM s
          WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(stop) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
        FROM p GROUP BY conv_id""",
    "op4_minhash": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents
        ), s AS (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(x) >= 3 THEN list_transform(range(1, len(x) - 1), lambda i: x[i] || ' ' || x[i + 1] || ' ' || x[i + 2])
                                              WHEN len(x) > 0 THEN [array_to_string(x, ' ')] ELSE [] END) AS g FROM w
        ), n AS (SELECT d.doc_id, CAST(count(g) AS BIGINT) AS n FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
        c AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node WHERE c.root < e.b)
        SELECT n.doc_id, n.n AS n_shingles, m.root AS component_id, n.doc_id = m.root AS kept
        FROM n JOIN (SELECT node, min(root) AS root FROM c GROUP BY node) m ON m.node = n.doc_id""",
}
