"""The corpus operators as queries over the given tables, with production parameters; SQL where it can express them."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pseudonym_key(spark: SparkSession) -> str:
    """The setting spark.waxcrate.pseudonym.key; without it a fresh one, so pseudonyms are linked within this run only."""
    return spark.conf.get("spark.waxcrate.pseudonym.key", None) or secrets.token_hex(32)


@query("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_file_rows

    return token_file_rows(table(spark, sf_dir, "documents"), vocab="byte_bpe_50k.json", end_id=0)


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, token_pieces

    return pack(token_pieces(table(spark, sf_dir, "documents"), vocab="word_bpe_49k.json", end_id=1, length=4096), capacity=4096)


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_spans import section_tokens

    return section_tokens(table(spark, sf_dir, "documents"), vocab="byte_bpe_50k.json", rule="middle")


@query("op1_near_duplicates")
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8).select("doc_id", "class_id", "kept")


@query("op8_decontamination")
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=0.8)
    return found.select("doc_id", "item_id", "similarity", "start")


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import COUNTS, quality

    judged = quality(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", *[judged[f"q_{k}"].alias(k) for k in COUNTS], judged["q_base_failed"].alias("base_failed"), judged["q_kept"].alias("kept"))


@query("op4_pii_pseudonyms")
def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, pseudonymised

    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), pseudonym_key(spark)).select("doc_id", "text", *[f"pii_{k}" for k in KINDS])


def _licence_sql() -> str:
    from .licences import oracle

    return oracle()


@query("op6_licence_scan", _licence_sql())
def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import licence_scan

    return licence_scan(table(spark, sf_dir, "documents")).drop("key")


@query("op7_tool_calls")
def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import DERIVED, derived_messages, link_tool_calls

    return link_tool_calls(derived_messages(table(spark, sf_dir, "conversations")), DERIVED)


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import held_out, score, train

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(scored["doc_id"]).alias("held_out"), "score", "predicted")


@query("op13_language_id")
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identified, is_learned, train

    docs = table(spark, sf_dir, "documents")
    filters = train(docs.where(is_learned(docs["doc_id"])), share=1e-5)
    found = identified(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", (~is_learned(found["doc_id"])).alias("held_out"), "lang_pred", "score")


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import periodic_runs, run_digests

    return run_digests(periodic_runs(table(spark, sf_dir, "documents"), plant=True))


@query("op11_conversation_repair")
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import damaged, repaired

    return repaired(damaged(table(spark, sf_dir, "conversations")))
