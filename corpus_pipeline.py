"""The corpus pipeline: documents become token ids of a clean, deduplicated, mixed corpus.

Each stage calls one operator of panelloom.llm, takes what its predecessor kept, and returns the columns of
`documents`; the last returns the encoded texts. run() writes each stage's rows as Parquet in the shared
folder and reads them again for the next.

Defined cases, in every stage: a null text counts as empty (the quality rules reject it, as they do any text of under 20
words); texts of any length go through whole; null ids and ids on several rows are allowed, rows being told apart by their
texts; of rows that repeat an id and its text one stays; ties go to the smaller id, null last; an empty table gives an
empty one, with the same columns; further columns pass through to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelloom.llm import mixing, pii_labels, piece_codec, quality_gate, shingle_neardup
from panelloom.llm.common import materialise

#: Encodings that a worker keeps; fewer than by default, as workers live on beside the other stages.
KEEP = 120_000
#: Share of five-word shingles, of those in either text, from which on two texts are near copies.
LEAST = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_gate.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays.

    SimHash links under covering masks, and MinHash bands for the pairs that no feasible radius reaches; the
    five-word sets of both texts decide.
    """
    return shingle_neardup.keep_one(docs, least=LEAST)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii_labels.redact_documents(docs, pii_labels.fit(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or stay out, as their source's target weight asks; rows are shuffled within shards."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids_sha256, decoded_sha256, ids) of each document; of further columns only the source stays."""
    import public_tokenizers

    return piece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), also=("source",), with_ids=True, keep=KEEP)


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_dedup),
    ("pii", pii),
    ("mix sources", mix),
    ("sentencepiece", encode),
]

#: The stages learn models and draw by hashes, which SQL cannot express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage{k + 1}")
    return docs
