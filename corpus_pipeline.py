"""Filters and packs a corpus: each stage takes (spark, docs, sf_dir) and returns a DataFrame.

Every stage works on all that the one before it kept: documents of low quality go, then those of no
known language, then all but one of each group of near-duplicates; the rest is packed. All but the
last return the columns of ``documents``. Models are learned from the documents and labels of
``sf_dir`` (quality) and from the documents that the stage gets (language).

All stages take tables with nulls in any column, with empty and very long texts (a text is handled
whole, in one row), with repeated rows and with further columns of any name, which pass through as
they are; an empty table gives an empty one. What is special is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import language, packing, quality, simhash
from tilewright.session import table, written


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose quality score reaches the threshold.

    Null and empty texts have the score of the biases alone. A score equal to the threshold is kept.
    Without any labels nothing is learned, and all documents are kept.
    """
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def filter_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are near a centroid of a language.

    Texts that are null or hold no letter have no language and go. Rows of null lang or doc_id are not
    learned from, but judged like others. Where nothing can be learned, all documents go.
    """
    return language.keep_identified(docs, language.fit(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that of the smallest doc_id, nulls last.

    Null, empty and wordless texts are duplicates of one another. Rows that repeat doc_id and text are
    one document, of which the first by its other columns stays; rows that share a doc_id only are
    documents of their own.
    """
    return simhash.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences: a row for each piece.

    Null and empty texts are pieces of the end id alone. Only texts longer than a sequence are cut.
    Null and repeated doc_ids are documents of their own; pieces of equal size go by doc_id.
    """
    import public_tokenizers

    pieces = packing.tokenize_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(written(pieces, "pieces"))


STAGES = [
    ("quality", filter_quality),
    ("language", filter_language),
    ("near_duplicates", deduplicate),
    ("packing", pack),
]

#: SQL can't express the stages; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
