"""A corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

ORACLE_SQL is None: no stage's rows can be had from SQL on whole tables (learned
languages, 5-word set similarity, byte suffixes, keyed permutations, packing);
tests compare the stages with brute-force versions.

Every stage works row by row: rows that share a doc_id are rows of their own. Null
texts have no letter and go in the first stage; empty tables give empty tables; the
columns of documents are kept, whatever names further ones have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm import graph, jaccard, langid, packing, pii, suffix
from sievemill.llm.common import drop_staged, stage, staged_so_far, workers_import

ORACLE_SQL = None


def apart(docs: DataFrame) -> DataFrame:
    """docs with reserved names for all columns but doc_id and text, so that none is one that an operator makes."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"__column_{i}" for i, c in enumerate(docs.columns)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: texts without any letter go, and those of which no language has a third of the letters. Row by row: rows of one doc_id don't matter to each other."""
    own = apart(docs)
    lang = own.columns[docs.columns.index("lang")]
    model = langid.fit(own.select("doc_id", "text", F.col(lang).alias("lang")), train=~langid.held_out())
    found = langid.predict(own, model, keep=True).where("lang_pred <> 'und' and score >= 0.34")
    return found.select(*own.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of similarity 0.8 connect: that of least doc_id (of rows of one doc_id, that whose text has the least hash; of equal doc_id and text, any one)."""
    spare = stage(jaccard.link(docs, row=True).where(~F.col("first")).select(row_key("doc_id", "text_hash").alias(KEY), F.col("doc_id").alias("__spare_id")).distinct(), "spare")
    keyed = apart(docs).withColumn(KEY, row_key("doc_id", F.xxhash64(F.col("text").cast("string"))))
    clear = keyed.mapInArrow(graph.in_filter(spare.select(KEY), False, KEY), keyed.schema)
    maybe = keyed.mapInArrow(graph.in_filter(spare.select(KEY), True, KEY), keyed.schema).join(spare.withColumnRenamed(KEY, "__spare_key"), (F.col(KEY) == F.col("__spare_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__spare_id")), "left_anti")
    return one_each(clear.unionByName(maybe)).drop(KEY).toDF(*docs.columns)


KEY = "__row_key"


def row_key(doc_id, text_hash):
    """A fingerprint of a row's doc_id and text; it only leads to rows whose doc_id is then compared."""
    return F.xxhash64(F.col(doc_id).cast("long") if isinstance(doc_id, str) else doc_id, text_hash)


def one_each(keyed: DataFrame) -> DataFrame:
    """One row of those with equal doc_id and text. Only rows whose key a bit table holds among the repeated ones are shuffled with their texts."""
    again = stage(keyed.groupBy(KEY).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(KEY), "again")
    if not again.take(1):
        return keyed
    clear = keyed.mapInArrow(graph.in_filter(again, False, KEY), keyed.schema)
    maybe = keyed.mapInArrow(graph.in_filter(again, True, KEY), keyed.schema).dropDuplicates(["doc_id", "text"])
    return clear.unionByName(maybe)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings of 400 that stand elsewhere too; documents that are left empty go."""
    own = apart(docs)
    cut = suffix.dedup(own, cut_text=True).where("n_removed = 0 or text <> ''")
    if "n_chars" in docs.columns:
        n_chars = own.columns[docs.columns.index("n_chars")]
        cut = cut.withColumn(n_chars, F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col(n_chars)))
    return cut.select(*own.columns).toDF(*docs.columns)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = apart(docs)
    return pii.replace(own).select(*own.columns).toDF(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language_id), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_passages), ("PII", private_data), ("best-fit packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_import(spark)
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), staged_so_far()
    for k, (_, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, "corpus")
            drop_staged(spark, mark, docs)  # all that led to it
    return docs
