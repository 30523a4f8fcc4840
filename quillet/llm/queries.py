"""One query per operator, each with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.llm import exact_dedup, fertility, html_extract, license_scan, line_dedup, mixing, near_dedup, packing, sessions, substring_dedup, token_files, toxicity, turns
from quillet.llm.common import scratch, tokenizer_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "ids")
    token_files.write(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return token_files.digest(spark, path)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents")).drop("rid")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("rid")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).drop("rid")


def op9_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fertility.measure(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")).drop("rid")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("spans")


def op12_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions.sessions(table(spark, sf_dir, "clicks"))
    return found.withColumn("path_sha256", F.sha2("path", 256)).drop("path")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, edits = turns.repair(turns.damaged(table(spark, sf_dir, "conversations")))
    d = turns.digests(edits).withColumnRenamed("conv_id", "of")
    found = found.join(d, found.conv_id.eqNullSafe(d.of), "left").drop("of")
    return found.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_exact_dedup, op3_html_extract, op4_license_scan, op5_substring_dedup, op6_mixing, op7_near_dedup, op8_line_dedup, op9_fertility, op10_packing, op11_toxicity, op12_sessions, op13_turn_repair)}

ORACLE_SQL = {
    "op2_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    # a session's next one starts at the next end or gap, or at the first click over 120 minutes after its own first
    "op12_sessions": r"""
        WITH RECURSIVE c AS (
            SELECT click_id, client_id, epoch_us(ts) AS ts, coalesce(epoch_us(arrived_at) - epoch_us(ts) > 3600000000, false) AS late,
                coalesce(kind = 'purchase' AND value >= 60, false) AS final, coalesce(CAST(floor(100 * value + 0.5) AS BIGINT), 0) AS cents
            FROM clicks WHERE click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY ts, client_id, late, final, cents) = 1),
        n AS (
            SELECT *, row_number() OVER w AS rn, lag(final) OVER w AS was_final, ts - lag(ts) OVER w AS since
            FROM c WHERE NOT late WINDOW w AS (PARTITION BY client_id ORDER BY ts, click_id)),
        t AS (SELECT *, CASE WHEN was_final THEN 'end' WHEN since >= 300000000 THEN 'gap' END AS hard FROM n),
        h AS (SELECT *, min(rn) FILTER (hard IS NOT NULL) OVER (PARTITION BY client_id ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_hard FROM t),
        firsts AS (SELECT client_id, ts, min(rn) AS rn FROM t GROUP BY ALL),
        hops AS (
            SELECT h.client_id, h.rn, least(h.next_hard, f.rn) AS nxt
            FROM h ASOF LEFT JOIN firsts f ON h.client_id = f.client_id AND h.ts + 7200000000 < f.ts),
        starts AS (
            SELECT client_id, rn, nxt FROM hops WHERE rn = 1
            UNION ALL SELECT hops.client_id, hops.rn, hops.nxt FROM starts JOIN hops ON hops.client_id = starts.client_id AND hops.rn = starts.nxt),
        s AS (
            SELECT s.client_id, s.rn, coalesce(s.nxt, 1000000000) AS stop, a.ts AS start_us, a.click_id AS session_id, z.ts AS next_us,
                CASE WHEN s.nxt IS NOT NULL THEN coalesce(z.hard, 'length') END AS why
            FROM starts s JOIN t a ON a.client_id = s.client_id AND a.rn = s.rn LEFT JOIN t z ON z.client_id = s.client_id AND z.rn = s.nxt),
        late_ones AS (
            SELECT s.client_id, s.session_id, count(*) AS n FROM s JOIN c ON c.late AND c.client_id = s.client_id AND c.ts >= s.start_us AND (s.next_us IS NULL OR c.ts < s.next_us) GROUP BY ALL)
        SELECT s.client_id, s.session_id, s.start_us, max(t.ts) AS end_us, count(*) AS n_clicks, coalesce(any_value(l.n), 0) AS n_late, CAST(sum(t.cents) AS BIGINT) AS value_cents,
            coalesce(s.why, CASE WHEN arg_max(t.final, t.rn) THEN 'end' ELSE 'none' END) AS closed_by, sha256(string_agg(CAST(t.click_id AS VARCHAR), ',' ORDER BY t.rn)) AS path_sha256
        FROM s JOIN t ON t.client_id = s.client_id AND t.rn >= s.rn AND t.rn < s.stop LEFT JOIN late_ones l ON l.client_id = s.client_id AND l.session_id = s.session_id
        GROUP BY s.client_id, s.session_id, s.start_us, s.why""",
}
