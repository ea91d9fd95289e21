"""Queries of the operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salvor.llm import alignment, chat, clusters, decontamination, exact_dedup, jaccard, language, licenses, mixing, quality, substrings, suffix_tree, toxicity
from salvor.llm.words import fold_of


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = fold_of(F.col("doc_id")) == 0
    model = language.fit_languages(docs.where(~held_out))
    found = language.predict_languages(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("nearest").alias("lang_pred"), "score", "rejected")


def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    items = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix_sources(items).select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(hard).alias("text"),
    )
    turns = turns.unionByName(extra).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    made = chat.format_chats(turns)
    back = made.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", F.array_join(chat.read_loss(F.col("formatted"), F.col("loss_spans")), ""))
    line_of = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line_of), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = fold_of(F.col("doc_id")) == 1
    training = docs.where(~held_out).select(F.coalesce("text", F.lit("")).alias("text"))
    counts = suffix_tree.count_words(training)
    tree = suffix_tree.fit_tree(training, suffix_tree.alphabet_of(counts))
    found = suffix_tree.score_texts(docs, tree, counts)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels")
    held_out = fold_of(F.col("doc_id")) == 0
    model = toxicity.fit_toxicity(toxicity.labelled(docs, labels.where(~held_out)))
    found = toxicity.score_toxicity(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard.jaccard_components(table(spark, folder, "documents"), k=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = substrings.remove_repeats(docs, substrings.repeated_passages(docs))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, folder, "documents"), all_digests=True)
    return groups.withColumnRenamed("digest", "text_sha256")


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels")
    held_out = fold_of(F.col("doc_id")) == 0
    net = quality.fit_quality(quality.labelled(docs, labels.where(~held_out)))
    found = quality.score_quality(docs, net)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_clusters(spark: SparkSession, folder: str) -> DataFrame:
    members, centroids, _ = clusters.cluster_vectors(table(spark, folder, "embeddings"))
    return clusters.with_inertia(members, centroids)


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align_tokenizers(table(spark, folder, "documents"))


QUERIES = {
    "op1_language": op1_language,
    "op2_mix_sources": op2_mix_sources,
    "op3_chat_format": op3_chat_format,
    "op4_suffix_tree": op4_suffix_tree,
    "op5_toxicity": op5_toxicity,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_decontamination": op10_decontamination,
    "op11_quality": op11_quality,
    "op12_clusters": op12_clusters,
    "op13_alignment": op13_alignment,
}
