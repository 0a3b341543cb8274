"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

Every stage is a call of one operator of ``pulsegrid.llm``. Between stages the rows are written as Parquet and
read again. All but the last return the columns of ``documents``. Python gets at most 1,000 texts at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import jaccard, mixing, packing, pii, quality
from pulsegrid.llm.queries import vocabulary
from pulsegrid.llm.store import stored
from pulsegrid.session import use_small_batches

NEAR = jaccard.Join(words=5, least=80, of=100)


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose best grade is likely enough, by ratings of a sample; toxic and poor ones go."""
    use_small_batches(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.selected(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar ones: that with the smallest id, null last. Rows without words are groups of their own."""
    use_small_batches(spark)
    plain = [f"column_{k}" for k in range(len(docs.columns))]  # whatever the columns are called
    named = dict(zip(docs.columns, plain, strict=True))
    rows = stored(docs.toDF(*plain).withColumn("row_id", F.monotonically_increasing_id()), "rows")  # ids repeat, rows don't
    groups = jaccard.link_components(rows, NEAR, id_col="row_id", text_col=named["text"]).select(F.col("doc_id").alias("row_id"), "component_id")
    own = F.col(named["doc_id"])
    first = (groups.join(rows.select("row_id", own.isNull().alias("nameless"), own.alias("id")), "row_id").groupBy("component_id")
             .agg(F.min(F.struct("nameless", "id", "row_id")).alias("first")).select("first.row_id"))
    return rows.join(stored(first, "first"), "row_id", "left_semi").select(*plain).toDF(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the text."""
    use_small_batches(spark)
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order that mixes the sources by their weights; rows and files follow it."""
    plain = [f"column_{k}" for k in range(len(docs.columns))]  # whatever the columns are called
    named = dict(zip(docs.columns, plain, strict=True))
    mixed = mixing.mix(docs.toDF(*plain), id_col=named["doc_id"], source_col=named["source"])
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select(*plain).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens; sequence ids follow the mixed order."""
    use_small_batches(spark)
    return packing.pack_in_order(docs, vocabulary())


STAGES = [
    ("quality_classifier", select_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing_sources", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier and the field are trained, and packing is a greedy search: SQL has no words for them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
