"""The corpus pipeline: five stages over documents, each written and read again by the next.

1. quality classifier: documents that score under 0.5 go;
2. language ID: documents without letters, or in no learned language, go;
3. SimHash near-dedup: one document of each group stays (a Jaccard
   similarity of 0.8 or more of their distinct five-word shingles): the smallest id's;
4. secret scans: found secrets are masked in the text, and n_chars follows;
5. best-fit packing: the documents' pieces, packed into sequences.

All but the last return the columns of documents. Models are learned from what
the stage before has kept. Null, empty and wordless texts get the base rate of
the quality sample in stage 1 and go in stage 2, as they have no letters; texts
with letters but alike in all shingles are one near-dedup group, of which the row
with the smallest id stays, then the first row. Repeated rows are such a group.
Ties, very long texts and empty tables are handled as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm import lsa, packing, ppm, secrets, simhash
from fieldspark.llm.common import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return lsa.accepted(docs, lsa.learn(docs, labels, F.lit(True)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ppm.accepted(docs, ppm.learn(docs, F.lit(True)))


def numbered(docs: DataFrame) -> DataFrame:
    """(doc, row): every row as one column, so that none of its own can clash, and a number that stays its own.

    Rows of stored tables are numbered by file and place, others are stored first.
    """
    try:
        if "_metadata" in docs.columns:
            raise AnalysisException("not the hidden column")
        placed = docs.select(F.struct("*").alias("doc"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    except AnalysisException:
        return written(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    files = sorted(r.file for r in placed.select("file").distinct().collect())
    known = docs.sparkSession.createDataFrame(list(enumerate(files)), "number long, file string")
    return placed.join(F.broadcast(known), "file").select("doc", (F.col("number") * (1 << 40) + F.col("place")).alias("row"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(docs)
    gone = simhash.similar_groups(rows.select("doc.doc_id", "doc.text", "row"), width=5).where("row != representative").select("row")
    return rows.join(written(gone, "gone"), "row", "left_anti").select("doc.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weights = secrets.learn(docs)
    text = F.coalesce("text", F.lit(""))
    found = docs.select(F.struct("*").alias("doc"), secrets.all_spans(text, secrets.base_spans(text), weights).alias("spans"))
    clean = secrets.masked(F.col("doc.text"), F.col("spans"))
    values = {"text": clean, "n_chars": F.when(F.size("spans") > 0, F.length(clean)).otherwise(F.col("doc.n_chars"))}
    return found.select(*[values.get(c, F.col("doc").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("best-fit packing", pack),
]

#: The classifiers, the tokenizer and the signatures can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not k else written(docs, "stage"), sf_dir)
    return docs
