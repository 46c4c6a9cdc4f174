"""The registered queries of the corpus operators: thin digests of their outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.llm import chat, decontaminate, html_extract, media, near_dedup, packing, pii, substring_index, suffix_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '{hard}' AS text UNION ALL SELECT -7L, 1L, 'assistant', '{hard}'")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.read_examples(chat.expand_targets(turns, keep_rest=True))
    whole = F.max_by(F.struct("n_turns", "turns_sha256", "formatted_chars"), "n_turns").alias("whole")
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss_text"))), lambda x: x["loss_text"]), "")
    by_conv = read.groupBy("conv_id").agg(whole, loss.alias("loss"))
    return by_conv.select("conv_id", "whole.n_turns", "whole.turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "whole.formatted_chars")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(_table(spark, sf_dir, "pages"))


def op4_substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_index.digest(substring_index.remove_repeated_windows(_table(spark, sf_dir, "documents")))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", "predicted", (F.size("spans") / 2).cast("long").alias("n_terms"))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeated_bytes(_table(spark, sf_dir, "documents")))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(_table(spark, sf_dir, "documents")))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.as_media(_table(spark, sf_dir, "documents")))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_chat_format": op2_chat_format,
        "op3_main_text": op3_main_text,
        "op4_substring_index": op4_substring_index,
        "op5_pack": op5_pack,
        "op6_toxicity": op6_toxicity,
        "op7_suffix_array": op7_suffix_array,
        "op8_personal_data": op8_personal_data,
        "op9_media": op9_media,
        "op10_near_duplicates": op10_near_duplicates,
    }


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


#: Words of a text as the decontamination contract has them.
_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_SQL = {
    "op1_decontaminate": f"""
WITH iw AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
     win AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS k
             FROM iw, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(i) WHERE len(w) > 0),
     sizes AS (SELECT DISTINCT size FROM win),
     dw AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
     dk AS (SELECT r, i, size, array_to_string(w[i : i + size - 1], ' ') AS k FROM dw, sizes, unnest(range(1, len(w) - size + 2)) AS u(i)),
     hit AS (SELECT r, i, dk.size, item_id FROM dk JOIN win USING (size, k)),
     n AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + size)) AS u(p) GROUP BY r),
     it AS (SELECT r, list(DISTINCT CAST(item_id AS VARCHAR) ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN n USING (r) LEFT JOIN it USING (r)""",
    "op2_chat_format": r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
     f AS (SELECT *, length(regexp_replace(text, '([\[<])(\\*)(/?INST\]|/?s>|/ROLE\]|ROLE)', '\1\\\2\3', 'g'))
                  + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE CASE WHEN role IS NULL THEN 15 ELSE 16 + 2 * octet_length(encode(role)) END END AS chars FROM t)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role NULLS FIRST, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id""",
    "op4_substring_index": r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     win AS (SELECT r, doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: md5_number(array_to_string(w[i : i + 12], ' ')))) AS k FROM dw),
     least AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
     gone AS (SELECT DISTINCT r, p FROM win JOIN least USING (k), unnest(range(i, i + 13)) AS v(p) WHERE doc_id > first),
     g AS (SELECT r, list(p) AS ps FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_select(w, list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(ps, j))) END, ' ')) AS kept_sha256
FROM dw LEFT JOIN g USING (r)""",
    "op7_suffix_array": r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
     win AS (SELECT r, unnest(range(1, length(h) // 2 - 98)) AS i, unnest(list_transform(range(1, length(h) // 2 - 98), lambda i: md5_number(substr(h, 2 * i - 1, 200)))) AS k FROM d),
     late AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY k ORDER BY r, i) AS n FROM win) WHERE n > 1),
     step AS (SELECT r, i, max(i) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM late),
     run AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS n FROM step),
     span AS (SELECT r, n, min(i) AS a, max(i) + 100 AS b FROM run GROUP BY r, n),
     gap AS (SELECT r, n, a, b, lag(b, 1, 1) OVER (PARTITION BY r ORDER BY n) AS was, lead(a) OVER (PARTITION BY r ORDER BY n) AS next FROM span),
     kept AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed,
                     string_agg(substr(h, 2 * was - 1, 2 * (a - was)) || CASE WHEN next IS NULL THEN substr(h, 2 * b - 1) ELSE '' END, '' ORDER BY n) AS k
              FROM gap JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)""",
}
