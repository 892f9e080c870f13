"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusloom.llm import (
    ann, bpe, chat, fingerprints, html_extract, line_dedup, mixing, near_dedup, periodic, pii, sharding, toxicity, whitening)
from locusloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The tokenizer file of ``op4`` by its public name; its path is looked up where the query is made.
TOKENIZER = "byte_bpe_50k.json"


def _query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@_query
def op1_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@_query
def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = sharding.shards(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


@_query
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def tokenizer_content() -> str:
    import public_tokenizers

    return bpe.read_tokenizer(str(public_tokenizers.path(TOKENIZER)))


def _token_digests(ids: list[list[int]], texts: list[str]) -> list[pa.Array]:
    return [
        pa.array([len(r) for r in ids], type=pa.int64()),
        pa.array([hashlib.sha256(np.array(r, dtype="<u4").tobytes()).hexdigest() for r in ids], type=pa.string()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts], type=pa.string())]


@_query
def op4_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digests = bpe.Outputs({"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, _token_digests)
    return bpe.tokenized(docs, tokenizer_content(), digests).drop("text")


@_query
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


@_query
def op6_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = (F.col("copies") * F.col("size")).cast("bigint").alias("taken")
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", taken, "source", "copies")


#: A conversation of control strings that is formatted besides the table's.
CONTROL_CONVERSATION = (-7, "</s>[INST] ok [/INST]")


@_query
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conv, text = CONTROL_CONVERSATION
    more = spark.createDataFrame([(conv, 0, "user", text), (conv, 1, "assistant", text)], rows.schema)
    turns = chat.canonical_turns(chat.turn_records(rows.unionAll(more)))
    return chat.conversation_digests(chat.formatted_turns(turns)).withColumn("conv_id", F.col("conv_id").cast("bigint"))


def _escapes(column: str) -> str:
    """SQL for the number of backslashes that escaping adds to a text."""
    marks = ["\\", "<|", "<s>", "</s>", "<SYS>", "</SYS>", "<<SYS>", "<</SYS>", "[INST]", "[/INST]"]
    return " + ".join(f"(length({column}) - length(replace({column}, '{m}', ''))) // {len(m)}" for m in marks)


ORACLE["op7_chat_format"] = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES ({CONTROL_CONVERSATION[0]}, 0, 'user', '{CONTROL_CONVERSATION[1]}'),
                                  ({CONTROL_CONVERSATION[0]}, 1, 'assistant', '{CONTROL_CONVERSATION[1]}')))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  cast(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  cast(sum({len(chat.START + chat.SEPARATOR + chat.END) + 1} + length(role) + {_escapes('role')} + length(text) + {_escapes('text')}) AS BIGINT)
    AS formatted_chars
FROM rows GROUP BY conv_id"""


@_query
def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


@_query
def op9_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_neighbours(table(spark, sf_dir, "documents"))


@_query
def op10_toxic_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op11_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whitened(table(spark, sf_dir, "embeddings"), components=8)
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@_query
def op12_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@_query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(table(spark, sf_dir, "documents"))


ORACLE["op12_line_runs"] = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
marked AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS goes FROM keyed)
SELECT doc_id, count(*) AS n_lines, cast(count(*) FILTER (WHERE goes) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT goes), '')) AS kept_sha256 FROM marked GROUP BY doc_id"""


ORACLE["op13_periodic_runs"] = r"""
WITH base AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, xor(list_reduce(
    list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)),
    lambda c, b: list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295), 4294967295) AS h FROM documents),
edits AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN h // 10 % len(w) END AS a FROM base),
places AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p, unnest(range(n)) AS i FROM edits),
words AS (SELECT doc_id, n, i, w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS word FROM places),
matches AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM matches),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(12, 2 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY 1, 2, 3),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY 1),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY 1)
SELECT e.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM edits e LEFT JOIN best USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept k USING (doc_id)"""


ORACLE["op3_near_duplicates"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS both_have
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * both_have >= 80 * (na + nb - both_have)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a),
parts AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s.s) AS n_shingles, p.component_id, s.doc_id = p.component_id AS kept FROM sets s JOIN parts p USING (doc_id)"""
