"""Training-corpus pipeline: the stages that turn documents into token files."""

from __future__ import annotations

import gc

import public_tokenizers

from tablescour.llm import decontaminate, kneser_ney, mixing, sequences, setsketch
from tablescour.session import shared_dir


def quality_classifier(spark, docs, sf_dir):
    """Documents that the classifier rejects go."""
    return kneser_ney.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    return setsketch.one_of_each(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents with a benchmark passage go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark, docs, sf_dir):
    """Documents as often as the mix draws them, whole."""
    return mixing.mix(docs, cut=False)


def token_output(spark, docs, sf_dir):
    """Token files; a row per document drawn, read back from them."""
    folder = shared_dir(spark, "sequences")
    sequences.write_sequences(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return sequences.read_documents(spark, folder)


STAGES = [
    ("quality", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", benchmark_decontamination),
    ("mixing", source_mixing),
    ("tokens", token_output),
]
ORACLE_SQL = None


# What the driver keeps of a finished query is mostly the text of its plan.
PLAN_TEXTS = {"spark.sql.maxPlanStringLength": "4096", "spark.sql.ui.explainMode": "simple"}


def run(spark, sf_dir):
    """All stages over documents; each stage's rows are written and read again.

    The stages are some two hundred queries. Their plans are kept as short texts while
    they run, and after each stage the driver lets go of its broadcasts and shuffles,
    which Spark does only when the driver's memory is collected.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark, "pipeline")
    before = {name: spark.conf.get(name, None) for name in PLAN_TEXTS}
    try:
        for name, value in PLAN_TEXTS.items():
            spark.conf.set(name, value)
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            gc.collect()
            spark._jvm.java.lang.System.gc()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    return docs
