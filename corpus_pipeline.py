"""Documents to packed training sequences: quality rules, line dedup, near-duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternlake.llm import line_dedup, near_dedup, packing, quality_rules, source_mixing
from lanternlake.llm.common import materialize, scratch, table


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the host-level rules reject go."""
    return quality_rules.filter_documents(docs)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: lines that a site repeats on its pages go; n_chars follows the text."""
    names = docs.columns
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*names)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each group of near-duplicates stays."""
    return near_dedup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: each document comes as often as the mix takes it, up to three times."""
    return source_mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the pieces' places in training sequences."""
    return packing.pack(docs, carry={"ids_crc32": F.crc32("ids")})


STAGES = [
    ("quality_rules", keep_by_rules),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", one_of_each_group),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Near-duplicate classes and packing can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  What a stage used is deleted once its result is written."""

    def after(docs: DataFrame, stages: list) -> DataFrame:
        if not stages:
            return docs
        name, stage = stages[-1]
        with scratch(spark):
            return materialize(stage(spark, after(docs, stages[:-1]), sf_dir), name, keep=True)

    return after(table(spark, sf_dir, "documents"), STAGES)
