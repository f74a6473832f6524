"""From raw documents to a mixed training corpus: five stages, each written before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, exact_dedup, jaccard_join, langid, mixing
from tidemark.llm.queries import remainder, table
from tidemark.llm.shared import stored
from tidemark.session import send_package


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without any letter go."""
    send_package(spark)
    model = langid.fit(docs.filter(remainder(4) != 2))
    found = langid.identify(docs, model)
    predicted = found.columns[len(docs.columns)]
    return found.filter(F.col(predicted) != langid.UNKNOWN).select(docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs, exact_dedup.build_index(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    send_package(spark)
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lies in benchmark passages."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    n_words, n_hit = found.columns[len(docs.columns) : len(docs.columns) + 2]
    return found.filter(~decontaminate.is_contaminated(n_hit, n_words)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their place in the mixture, sources weighing as the root of their sizes."""
    return mixing.mix_exact(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
]

#: Language identification is not expressible in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
    return docs
