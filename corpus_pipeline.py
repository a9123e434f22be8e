"""The corpus pipeline: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last return the columns of ``documents``
(doc_id, text, lang, source, n_chars); columns that a table lacks come back null and extra ones are dropped.  Rows may
be null in any column and repeated; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import encoded
from tidemark.llm.common import arrow_rows, table, written
from tidemark.llm.mixing import mix
from tidemark.llm.nearcopies import near_copies
from tidemark.llm.quality import accepted, fit
from tidemark.llm.suffixdedup import remove_repeats

#: Ids up to which a list of rows to leave out is broadcast (16 bytes each); a longer one is joined by shuffle.
BROADCAST_ROWS = 500_000
SALTS = 64
COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


def _documents(docs: DataFrame) -> DataFrame:
    have = set(docs.columns)
    return docs.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with ``row``, which tells rows apart: the id, or where ids are null or repeated a number.

    Numbers are written with the rows, so that every later read sees the same.
    """
    docs = _documents(docs)
    ids = docs.select("doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    if (ids.most or 1) == 1 and not ids.nulls:
        return docs.withColumn("row", F.col("doc_id"))
    return written(docs.withColumn("row", F.monotonically_increasing_id()), "rows")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier fitted on docs rejects go; null and empty texts are rejected."""
    arrow_rows(spark)
    docs = _documents(docs)
    return accepted(docs, fit(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest id (null last), of equal ids the first row.

    Near copies have a Jaccard similarity of 0.8 or more on five-word shingles, as their SimHash tells it.
    """
    arrow_rows(spark)
    rows = _numbered(docs)
    groups = near_copies(rows, "row")
    # the group's name is its first row; the row that stays is the one with the smallest id
    named = written(groups.join(rows.select("row", "doc_id"), "row").select("row", "component_id", F.struct(F.col("doc_id").isNull(), "doc_id", "row").alias("order")), "named")
    first = named.groupBy("component_id").agg(F.min("order").alias("first"), F.count("*").alias("n")).where("n > 1").select("component_id", F.col("first.row").alias("stays"))
    first = written(first, "first")
    # a group's rows are spread over salts, and its first row is sent to each
    if first.count() <= BROADCAST_ROWS:
        met = named.join(F.broadcast(first), "component_id")
    else:
        salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = named.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["component_id", "salt"])
    gone = written(met.where("row <> stays").select("row"), "gone")
    few = gone.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if few else gone, "row", "left_anti").drop("row")


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts and n_chars follows; a text that was cut to nothing goes as a row.

    A cut may split a character: bytes that are no longer UTF-8 go too.  Null texts come back empty.
    """
    arrow_rows(spark)
    cut = remove_repeats(_documents(docs), keep=("lang", "source", "n_chars")).where("n_removed = 0 or n_removed < n_bytes")
    text = F.col("kept").cast("string")
    whole = F.when(F.is_valid_utf8(text), text).otherwise(F.regexp_replace(F.make_valid_utf8(text), "\ufffd", ""))
    return cut.select("doc_id", whole.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length(whole).cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 3 times."""
    rows = _numbered(docs)
    copies = mix(rows, id_col="row").select("row", "copies").where("copies > 0")
    return rows.join(copies, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and input_ids of each row."""
    import public_tokenizers

    arrow_rows(spark)
    return encoded(_documents(docs), public_tokenizers.path("word_bpe_49k.json"), ids=True).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", source_mixing),
    ("BPE encoding and decoding", bpe_encoding),
]

#: No DuckDB SQL expresses the fitted classifier or BPE; tests hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
