"""The registered queries of these operators, and their SQL where there is one."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecatlas.llm import ann, bpe, chat, classifier, decontam, lines, lm, manifest, quality, repeats, sharding, simhash, whitening
from vecatlas.llm.tables import documents

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def op1_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts are linked (empty ones too); null texts have no links."""
    docs = documents(spark, sf_dir)
    rows, node = sharding.numbered(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")))
    placed, shard, slot = sharding.shard_by_groups(rows, node, ["h1", "h2"], shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard, slot,
                         F.lit(None).cast("int").alias("grown_shard"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    judged, names = quality.judge(docs)
    return judged.select("doc_id", *(F.col(names[n]).alias(n) for n, _ in quality.ADDED))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.format_conversations(turns.unionByName(own)))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    marked, n_lines, n_dropped, keep = lines.keep_bitmaps(docs, min_docs=10, min_chars=1)

    def run(batches):
        for batch in batches:
            texts, maps = batch.column(1).to_pylist(), batch.column(4).to_pylist()
            shas = [hashlib.sha256(lines.kept_text(t, m).encode()).hexdigest() for t, m in zip(texts, maps)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(shas, pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return marked.select("doc_id", "text", n_lines, n_dropped, keep).mapInArrow(
        run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def op5_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(documents(spark, sf_dir), shingle=3, tau=2)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which benchmark items."""
    return decontam.contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")).drop("doc_row")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = classifier.train(docs, documents(spark, sf_dir, "labels"), "quality")
    scored = classifier.score(docs, model)
    return scored.select("doc_id", classifier.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(documents(spark, sf_dir))


def op11_pstable_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(documents(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.document_manifest(documents(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deviation is exact in the operator; where it is no long any more (from millions of vectors on) it is null here."""
    rows = whitening.whitened_rows(documents(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


QUERIES = {
    "op1_label_propagation": op1_label_propagation,
    "op2_quality_rules": op2_quality_rules,
    "op3_chat_format": op3_chat_format,
    "op4_line_dedup": op4_line_dedup,
    "op5_deleted_interpolation": op5_deleted_interpolation,
    "op6_simhash": op6_simhash,
    "op7_decontamination": op7_decontamination,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_suffix_repeats": op10_suffix_repeats,
    "op11_pstable_multiprobe": op11_pstable_multiprobe,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_whitening": op13_whitening,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WHITE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"



def _escaped_length(text: str) -> str:
    """Code points of a text once each backslash and control string has a backslash before it."""
    marks = "".join(f" + (length({text}) - length(replace({text}, '{m}', ''))) // {len(m)}" for m in ("\\", "### ", " </turn>", ": "))
    return f"(length({text}){marks})"


def _hashed(value: str) -> str:
    """A value as the manifest hashes it."""
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_hashed(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


ORACLE_SQL = {
    "op3_chat_format": rf"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        placed AS (
            SELECT *, row_number() OVER w AS pos, lag(role) OVER w AS prev FROM turns
            WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(9 + {_escaped_length("text")} + CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15
                        ELSE 11 + {_escaped_length("role")} END) AS BIGINT) AS formatted_chars,
               bool_and(CASE WHEN prev IS NULL THEN role IN ('system', 'user') WHEN prev = 'system' THEN role = 'user'
                        WHEN prev = 'user' THEN role = 'assistant' WHEN prev = 'assistant' THEN role = 'user' ELSE false END)
               AND arg_max(role, pos) = 'assistant' AS conversation_valid
        FROM placed GROUP BY conv_id""",
    "op4_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, t.pos, t.line, translate(trim(t.line, {_WHITE}), '{_UPPER}', '{_LOWER}') AS key
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
                 LATERAL (SELECT unnest(parts) AS line, generate_subscripts(parts, 1) AS pos) t),
        often AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE o.key IS NOT NULL) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
        FROM lines LEFT JOIN often o ON lines.key = o.key GROUP BY doc_id""",
    "op12_merkle_manifest": f"""
        WITH RECURSIVE
        crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i:
                    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
        leaves AS (
            SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, {_leaf("n_chars + 1")} AS changed,
                   xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                       lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AND n_chars IS NOT NULL AS hit
            FROM documents, crc),
        placed AS (
            SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                   count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp FROM leaves),
        tree AS (
            SELECT grp, 0 AS lvl, pos AS idx, n, leaf AS h FROM placed
            UNION ALL
            SELECT grp, lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY grp, lvl, idx // 2, n),
        top AS (
            SELECT 0 AS lvl, grp AS idx, (SELECT count(DISTINCT grp) FROM placed) AS n, h FROM tree WHERE n = 1
            UNION ALL
            SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY lvl, idx // 2, n),
        steps AS (
            SELECT p.id, t.lvl, t.idx % 2 = 1 AS on_left, s.h AS sibling
            FROM placed p JOIN tree t ON t.grp = p.grp AND t.n > 1 AND t.idx = p.pos >> t.lvl
            LEFT JOIN tree s ON s.grp = t.grp AND s.lvl = t.lvl AND s.idx = xor(t.idx, 1)
            UNION ALL
            SELECT p.id, 1000 + t.lvl, t.idx % 2 = 1, s.h
            FROM placed p JOIN top t ON t.n > 1 AND t.idx = p.grp >> t.lvl LEFT JOIN top s ON s.lvl = t.lvl AND s.idx = xor(t.idx, 1)),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lvl) AS step FROM steps),
        fold AS (
            SELECT id, 0 AS step, CASE WHEN hit THEN changed ELSE leaf END AS h FROM placed
            UNION ALL
            SELECT f.id, f.step + 1, sha256(CASE WHEN s.sibling IS NULL THEN f.h WHEN s.on_left THEN s.sibling || f.h ELSE f.h || s.sibling END)
            FROM fold f JOIN numbered s ON s.id = f.id AND s.step = f.step + 1),
        ends AS (SELECT id, arg_max(h, step) AS folded_root FROM fold GROUP BY id),
        proofs AS (SELECT id, sha256(coalesce(string_agg(sibling, '' ORDER BY lvl), '')) AS proof_sha256 FROM steps GROUP BY id),
        root AS (SELECT h AS root FROM top WHERE n = 1)
        SELECT p.doc_id, p.leaf, t.h AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM placed p JOIN tree t ON t.grp = p.grp AND t.n = 1 JOIN ends USING (id) LEFT JOIN proofs USING (id), root""",
}
