"""Queries opN_<name>: thin, each gets its rows through its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretell.llm.chat import format_chats, read_back
from foretell.llm.common import load
from foretell.llm.exact_dedup import exact_duplicates
from foretell.llm.kneser_ney import judge
from foretell.llm.langid import identify
from foretell.llm.line_dedup import drop_repeated_lines
from foretell.llm.merkle import leaves, manifest
from foretell.llm.mixing import mixed_positions
from foretell.llm.packing import pack_documents
from foretell.llm.product_codes import codebooks_digest, errors_by_label, product_codes
from foretell.llm.secrets import KINDS, scan
from foretell.llm.simhash import near_duplicates
from foretell.llm.toxicity import score
from foretell.llm.vafile import top_k


def op1_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_positions(load(spark, sf_dir, "documents")).drop("text_hash")


def _remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held_out = _remainder(5) == 0
    found = identify(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


def op4_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")).drop("text_hash")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = _remainder(4) == 2
    found = score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(load(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(load(spark, sf_dir, "documents"))
    name = F.array(*map(F.lit, KINDS))
    say = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")
    order = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end"))))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(say(order(F.col("base"))), 256).alias("base_sha256"), say(order(F.concat("base", "added"))).alias("spans"),
    )


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    log = talk.unionByName(probe).select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")
    back = read_back(format_chats(log))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    tampered = {"text": F.when(_remainder(2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))}
    found = manifest(leaves(docs, changed=tampered))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_lines(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    found = product_codes(vectors)
    if found is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    code = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "").alias("code")
    return errors_by_label(found.codes).select("vec_id", code, "error", "label_error", F.lit(codebooks_digest(found.codebooks)).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pfair_mix": op1_pfair_mix,
    "op2_language_id": op2_language_id,
    "op3_vector_top_k": op3_vector_top_k,
    "op4_kneser_ney_quality": op4_kneser_ney_quality,
    "op5_toxicity": op5_toxicity,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_secret_scan": op8_secret_scan,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_chat_format": op10_chat_format,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_line_dedup": op12_line_dedup,
    "op13_product_codes": op13_product_codes,
}
