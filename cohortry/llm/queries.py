"""Registered queries of the operators, one each over its whole table, and their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.chat_format import format_conversations, masked_texts, parsed_turns
from cohortry.llm.decontamination import contaminated, contamination
from cohortry.llm.fingerprints import fingerprints_of_edits
from cohortry.llm.host_suffixes import main_text
from cohortry.llm.jaccard_join import jaccard_components
from cohortry.llm.language_id import fit_languages, identify_language
from cohortry.llm.mixing import mix_sources, word_count
from cohortry.llm.prefix_trie import conversation_trie, ends_digest, numbered_turns, with_group_heads
from cohortry.llm.resampling import fit_ratio, resample
from cohortry.llm.samples import held_out
from cohortry.llm.sharding import uniform_shards
from cohortry.llm.spelling import spelling_forms, word_table
from cohortry.llm.staging import new_folder, staged
from cohortry.llm.token_files import read_token_digests, write_token_files
from cohortry.llm.toxicity import fit_toxicity, score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op3_jaccard_join", """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS head FROM sets GROUP BY 1),
shingles AS (SELECT head, len(s) AS n, unnest(s) AS x FROM classes WHERE len(s) > 0),
pairs AS (
  SELECT a.head AS p, b.head AS q FROM shingles a JOIN shingles b ON a.x = b.x AND a.head < b.head
  GROUP BY a.head, b.head, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
links AS (SELECT p, q FROM pairs UNION ALL SELECT q, p FROM pairs),
reach AS (SELECT head AS p, head AS q FROM classes WHERE len(s) > 0
  UNION SELECT r.p, l.q FROM reach r JOIN links l ON l.p = r.q),
roots AS (SELECT p, min(q) AS root FROM reach GROUP BY p)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id
FROM sets LEFT JOIN classes ON list_sort(sets.s) = classes.s LEFT JOIN roots ON head = p
""")
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


@query("op5_sharding")
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rows are exchanged; the digests are taken from the sharded rows."""
    text = F.coalesce("text", F.lit(""))
    return uniform_shards(table(spark, sf_dir, "documents"), 24).select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op9_decontamination", r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
),
lengths AS (SELECT DISTINCT least(13, len(w)) AS m FROM items WHERE len(w) > 0),
wanted AS (
  SELECT DISTINCT item_id, m, w[i:i + m - 1] AS x
  FROM (SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
        FROM items WHERE len(w) > 0)
),
offered AS (
  SELECT doc_id, m, i, w[i:i + m - 1] AS x
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, lengths WHERE len(w) >= m)
),
met AS (SELECT doc_id, item_id, i, o.m FROM offered o JOIN wanted USING (m, x)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
""")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col("n_words").cast("long"), F.col("n_hit").cast("long"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"))


@query("op10_mixing")
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size"))
    return mix_sources(sized, "size").select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op6_chat_format")
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text"))
        for i, role in enumerate(("user", "assistant"))])))
    out = format_conversations(turns.unionByName(own))
    read = out.select("conv_id", "formatted", parsed_turns(F.col("formatted")).alias("turns"),
                      F.array_join(masked_texts(F.col("formatted"), F.col("mask")), "").alias("loss"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
        .alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_language(docs, fit_languages(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op8_fingerprints")
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return fingerprints_of_edits(docs)


@query("op4_token_files")
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = new_folder(spark, "token_files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_digests(spark, path)


@query("op2_importance_resampling")
def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    drawn = resample(docs, fit_ratio(docs, table(spark, sf_dir, "labels")))
    return drawn.withColumn("held_out", held_out())


@query("op11_prefix_trie")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered, convs = numbered_turns(table(spark, sf_dir, "conversations"))
    convs = staged(convs, "convs")
    trie = conversation_trie(with_group_heads(numbered, convs), convs.select("conv_id"))
    # Nodes without an end get a key of their own, so they are dealt evenly.
    own = F.coalesce("end_id", F.concat_ws("/", F.lit("own"), "conv_id", "depth"))
    return trie.nodes.withColumn("end_id", own).join(ends_digest(trie.ends), "end_id", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


@query("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(word_table(table(spark, sf_dir, "documents"))).select(
        "word", "n", "n_near", "form", "form_n", "root")


@query("op13_main_text")
def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "boilerplate_tokens")
