"""One query for each operator, over whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.llm import (
    byte_pairs,
    chat,
    divergence,
    language,
    near_dups,
    nearest,
    packing,
    quality_rules,
    resampling,
    token_counts,
    token_store,
    toxicity,
    whitening,
)
from maskloom.llm.common import bounded_sample, key_remainder
from maskloom.llm.library import read_vocabulary
from maskloom.session import materialise, spread

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
# SQL has no byte-pair merging, learning, or connected components of similar sets, so those have none; see tests/llm.
ORACLES: dict[str, str] = {
    "op12_source_audit": r"""
WITH docs AS (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
    FROM documents),
counts AS (
    SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS held
    FROM (SELECT lang, source, id, unnest(words) AS term FROM docs) GROUP BY ALL),
terms AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL HAVING sum(held) >= 3),
sizes AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM terms GROUP BY ALL),
pairs AS (SELECT DISTINCT lang, source FROM docs),
cells AS (
    SELECT pairs.lang, pairs.source, terms.term, coalesce(counts.n, 0)::HUGEINT AS n, v
    FROM pairs JOIN terms USING (lang) JOIN sizes USING (lang)
    LEFT JOIN counts ON counts.lang = pairs.lang AND counts.source = pairs.source AND counts.term = terms.term),
priced AS (
    SELECT lang, source, term, n, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v)::HUGEINT AS p
    FROM cells),
between_ AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair_rows AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(between_.value, 0)::BIGINT AS value
    FROM pairs a JOIN pairs b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN between_ ON between_.lang = a.lang AND between_.source = a.source AND between_.item = b.source),
term_rows AS (
    SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value
    FROM (SELECT priced.*, 1 + (1000000000 * (terms.n + 1)) // (sizes.total + sizes.v) AS q
          FROM priced JOIN terms USING (lang, term) JOIN sizes USING (lang))
    WHERE n > 0 AND p > q)
SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
    FROM (SELECT * FROM pair_rows UNION ALL SELECT * FROM term_rows))
WHERE part = 'pair' OR rank <= 200
""",
}

SEQUENCE = 1024
WORD_END, BYTE_END = 1, 2
LABELLED_ROWS = 20_000


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/documents.parquet").select(*(columns or ("doc_id", "text"))))


def labels(spark: SparkSession, sf: str, label: str) -> DataFrame:
    """One label for each document that has any."""
    table = spark.read.parquet(f"{sf}/labels.parquet").where(F.col("doc_id").isNotNull())
    return table.groupBy("doc_id").agg(F.max(label).alias(label)).where(F.col(label).isNotNull())


@query
def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    counts = materialise(quality_rules.text_statistics(documents(spark, sf), "text", ["doc_id"]), "statistics")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    labelled = counts.where(~failed).join(labels(spark, sf, "quality"), "doc_id")
    rules = quality_rules.learn_from(labelled, "quality", LABELLED_ROWS, "doc_id")
    return counts.select(
        "doc_id",
        *quality_rules.COUNTS[:5],
        failed.alias("base_failed"),
        (~failed & (quality_rules.verdict(rules) == 0)).alias("kept"),
        quality_rules.verdict(rules).alias("rule"),
    )


@query
def op2_bpe(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    encoded = byte_pairs.encode(documents(spark, sf), "text", vocabulary, ["doc_id"])
    decoded = byte_pairs.decode(encoded, "ids", vocabulary, ["doc_id", "ids"])
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    packed = packing.pack_documents(
        documents(spark, sf), "doc_id", "text", vocabulary, BYTE_END, SEQUENCE, with_ids=False
    )
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op4_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """The sample is as large as the part of the corpus that is of target quality, by the labels."""
    docs, quality = documents(spark, sf), labels(spark, sf, "quality")
    row = quality.agg(F.avg("quality").alias("share")).first()
    target = bounded_sample(quality.where("quality = 1").select("doc_id"), "doc_id", LABELLED_ROWS)
    # at most LABELLED_ROWS numbers, so a broadcast is safe
    marked = docs.join(F.broadcast(target.withColumn("_target", F.lit(True))), "doc_id", "left")
    weights = resampling.learn_weights(marked, "text", F.col("_target"))
    k = round(docs.count() * (row["share"] if row["share"] is not None else 1.0))
    out = resampling.resample(docs, "doc_id", "text", weights, k, keep=["doc_id"])
    return out.select("doc_id", "log_weight", "gumbel_key", "sampled", F.col("sampled").alias("kept"))


@query
def op5_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    counted = token_counts.count_tokens(documents(spark, sf), "text", vocabulary, ["doc_id"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@query
def op6_language_id(spark: SparkSession, sf: str) -> DataFrame:
    held_out = key_remainder("doc_id", 4) == 2
    profiles = language.learn_profiles(
        documents(spark, sf, "doc_id", "text", "lang").where(~held_out), "doc_id", "text", "lang"
    )
    found = language.identify(documents(spark, sf), "text", profiles, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    held_out = key_remainder("doc_id", 5) == 0
    docs = documents(spark, sf)
    model = toxicity.learn(docs, labels(spark, sf, "toxic").where(~held_out), "doc_id", "text", "toxic")
    scored = toxicity.score(docs, "text", model, ["doc_id"])
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("segments").alias("n_segments"),
        "evidence",
    )


@query
def op8_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    return nearest.nearest(table, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20)


@query
def op9_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    found = near_dups.near_duplicates(documents(spark, sf), "doc_id", "text", size=3, percent=85)
    return found.select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


@query
def op10_token_store(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    docs = documents(spark, sf)
    store = token_store.write_store(docs, "doc_id", "text", vocabulary, WORD_END)
    rows = store.read(store.keys(docs, "doc_id")).join(store.shards().select("shard", "first"), "shard")
    return rows.select(
        F.col("key").alias("doc_id"),
        (F.col("first") + F.col("start")).alias("start"),
        F.col("length").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


@query
def op11_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    columns = ["conv_id", "turn", "role", "text"]
    said = "<|im_end|><|im_start|>assistant ok"
    probe = spark.range(2).select(
        F.lit(-1).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said)
    )
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select(columns).unionAll(probe)
    formatted = chat.format_conversations(turns, *columns, vocabulary)
    return chat.read_back(formatted).withColumnRenamed("key", "conv_id")


@query
def op12_source_audit(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf, "text", "lang", "source")
    audit = divergence.Audit(docs, "text", "lang", "source")
    parts = [audit.between_sources().withColumn("part", F.lit("pair"))]
    parts.append(audit.top_terms(200).withColumn("part", F.lit("term")))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return parts[0].select(columns).unionAll(parts[1].select(columns))


@query
def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    table = spread(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding"))
    model = whitening.learn(table, "embedding")
    rows = whitening.whiten(table, "embedding", model, ["vec_id"])
    error = whitening.identity_error(rows, model)
    shares = F.array(*[F.lit(float(x)) for x in model.explained]).cast("array<double>")
    listed = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return listed.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        F.expr("try_cast(deviation AS BIGINT)").alias("deviation"),
        "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


@query
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
