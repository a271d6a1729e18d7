"""The thin queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, encoding, mixing, pii, quality, repeats, simhash, token_counts, token_shards, warc
from .common import Stage, forget_at_exit, read_table, scratch_path, tokenizer_path

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_length_histogram(read_table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.round_trip_digests(read_table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-shards")
    token_shards.write_shards(read_table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), 2, path)
    forget_at_exit(spark, path)
    return token_shards.scan_documents(spark, path)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents")).drop("text_key")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read_table(spark, sf_dir, "documents"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"))


#: The drill's replica is damaged in every page whose id this divides.
DRILL_EVERY = 97


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as a WARC set, damages a second replica as a drill, and audits one against the other:
    every record with its size, digest and what the audit says of its copy."""
    path = scratch_path(spark, "warc")
    warc.write(read_table(spark, sf_dir, "pages"), path)
    forget_at_exit(spark, path)
    one = warc.replica(spark, path)
    two = Stage(warc.damage(one, DRILL_EVERY), "replica").read()
    trees = [Stage(warc.trees(r), "trees").read() for r in (one, two)]
    found = warc.audit(*trees).select("part", "seq", "record", "state")
    records = warc.inventory(one).join(found, ["part", "seq", "record"], "left")
    return records.select("page_id", "n_bytes", "record_sha256", "intact", F.coalesce("state", F.lit("same")).alias("copy"))


QUERIES = {"op1_token_counts": op1_token_counts, "op2_bpe": op2_bpe, "op3_token_shards": op3_token_shards, "op4_simhash": op4_simhash, "op5_quality": op5_quality, "op6_pii": op6_pii, "op7_mixing": op7_mixing, "op8_repeats": op8_repeats, "op9_embeddings": op9_embeddings, "op10_warc": op10_warc}

#: Brute force over all pairs of a label, and reachability by recursion.
_EMBEDDINGS_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
  l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
  r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.id), k AS (SELECT id, min(c) AS component_id FROM r GROUP BY id), n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
  SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM k LEFT JOIN n ON u = id"""

#: Records written out, for urls without white space and control characters, as the table has.
_WARC_SQL = f"""WITH h AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) AS http FROM pages),
  r AS (SELECT page_id, array_to_string(['WARC/1.1', 'WARC-Type: response', 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, 'null') || '>', 'WARC-Date: {warc.RECORD_DATE}', 'WARC-Target-URI: ' || url, 'WARC-Payload-Digest: sha256:' || sha256(html),
    'Content-Type: application/http; msgtype=response', 'Content-Length: ' || (strlen(http) + strlen(html)), '', http || html || chr(13) || chr(10) || chr(13) || chr(10)], chr(13) || chr(10)) AS rec FROM h)
  SELECT page_id, strlen(rec)::BIGINT AS n_bytes, sha256(rec) AS record_sha256, true AS intact, CASE WHEN page_id % {DRILL_EVERY} = 0 THEN 'changed' ELSE 'same' END AS copy FROM r"""

#: Where SQL cannot express a query, tests/llm holds it against brute force on small tables.
ORACLE_SQL: dict[str, str] = {"op9_embeddings": _EMBEDDINGS_SQL, "op10_warc": _WARC_SQL}
