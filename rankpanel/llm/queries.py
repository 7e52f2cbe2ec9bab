"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankpanel.llm import alignment, collocations, curriculum, decontaminate, licenses, order_minhash, pii, ppm, quality, secrets, sorted_projections, substrings, tokens
from rankpanel.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]

#: The pseudonym key of the registered query; users pass their own.
PII_KEY = "registered-query"

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


#: Documents have no path; a tree of a hundred per folder stands for one.
DOCUMENT_PATH = "concat_ws('/', source, cast(floor(doc_id / 10000) as string), cast(floor(doc_id / 100) as string), concat(doc_id, '.txt'))"


@query("op1_license_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("path", F.expr(DOCUMENT_PATH))
    return licenses.scan(docs, "path")


@query("op2_pii_feistel")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its text with pseudonyms and the number of values replaced, by kind."""
    done = pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)
    counts = [(F.size("found") - F.size(F.array_remove("found", kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return done.select("doc_id", "text", *counts)


@query("op3_sorted_projections", sorted_projections.ORACLE_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorted_projections.groups(table(spark, sf_dir, "embeddings"))


@query("op4_quality_pu")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_seed_extend", substrings.ORACLE_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("repeats").cast("long").alias("n_repeats"))


@query("op6_range_coded_ids")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"))


@query("op7_curriculum_mix")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.by_position(curriculum.plan(table(spark, sf_dir, "documents"))).drop("source")


@query("op8_secret_trigrams", secrets.oracle_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summary(secrets.scan(table(spark, sf_dir, "documents")))


@query("op9_order_minhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.groups(table(spark, sf_dir, "documents"))


@query("op10_cgk_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_ppm_score")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"), ppm.held_out())


@query("op12_interval_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


@query("op13_automata_collocations", collocations.ORACLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_phrases(collocations.phrases(table(spark, sf_dir, "documents")))
