"""A training corpus out of `documents`: language ID, line dedup, SimHash near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) with docs as the stage before left them; all but the last return the columns of
documents. Rows that language ID rejects (no letter in them) go, and the language it finds becomes the row's `lang`, by which the mixture is balanced;
lines found in at least ten documents go; of documents whose fingerprints are linked one stays; sources are cut to their share of tokens, and the
rest is packed into sequences of 4096 tokens.

Edge cases, by stage. Null, empty and white texts: language ID rejects them; line dedup takes them for one empty line, near-dedup for the
fingerprint zero, mixing for no tokens, packing for the end alone. Very long texts are one row throughout. Ties: languages by name; in near-dedup the
least id stays, then the least hash of the text; mixing orders by a seeded hash of the id. Repeated rows: near-dedup keeps one; before it, they count as one document, and
after it none are left. Rows without an id: line dedup counts them as one document; near-dedup keeps one of each component, if no row of it has an id; mixing takes all or
none of a leaf's. A null lang or source is a branch of its own in mixing (a null lang is left only without a labelled row to learn from). An empty table gives
no rows. Extra columns pass through every stage but packing unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from viatica.llm import base, language, lines, mixing, packing, simhash, tokens


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.with_language(docs, language.learn(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(docs, counted=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(docs, tokens.vocabulary()))


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("mixing to target weights", mixing_to_weights), ("packing", pack)]

#: SQL has neither suffix automata nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            path = base.fresh_dir(spark, f"stage{n}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
