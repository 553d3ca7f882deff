"""The corpus pipeline: quality rules, near-duplicates, decontamination, pseudonyms, packing.

Each stage takes the documents that its predecessor kept, as written and read again, and returns those it keeps with all their
columns; the last returns the packed pieces. All stages: null texts count as empty, and null ids, languages and sources are values
like any other; repeated rows are judged alike; an empty table gives an empty table; documents may have any other columns, whatever
their names, as a stage works on numbered names and gives the columns back as they were; texts may have any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waxcrate.llm.common import scratch_path, written
from waxcrate.llm.decontaminate import contaminated
from waxcrate.llm.dedup import near_duplicates
from waxcrate.llm.packing import pack, token_pieces
from waxcrate.llm.pii import pseudonymised
from waxcrate.llm.quality import quality
from waxcrate.llm.queries import pseudonym_key


class _Numbered:
    """docs under the column names c0, c1 ...; of names a stage's column, back gives a result its first names again."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.columns = [f"c{i}" for i in range(len(self.names))]
        self.docs = docs.toDF(*self.columns)

    def of(self, name: str) -> str:
        return self.columns[self.names.index(name)]

    def back(self, df: DataFrame) -> DataFrame:
        return df.select(*self.columns).toDF(*self.names)

    def without(self, rows: DataFrame, how: str = "left_anti") -> DataFrame:
        """docs without (or, left_semi, only) those with an id and a hash of the text that rows (v_id, v_key) has."""
        same = F.col(self.of("doc_id")).eqNullSafe(F.col("v_id")) & (F.xxhash64(self.of("text")) == F.col("v_key"))
        return self.docs.join(rows.select("v_id", "v_key"), same, how)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A text without words (null ones too) fails the base rules and goes."""
    d = _Numbered(docs)
    return d.back(quality(d.docs, d.of("lang"), d.of("source"), d.of("text")).where("q_kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that with the smallest id; of rows that repeat its id and text, one.

    Documents without words are classes of their own. Only ids and hashes of the removed and of the repeated ones meet the documents.
    """
    d = _Numbered(docs)
    judged = near_duplicates(d.docs, doc_id=d.of("doc_id"), text=d.of("text")).toDF("v_id", "v_key", "class_id", "class_key", "kept")
    verdicts = written(judged.groupBy("v_id", "v_key").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("NOT kept OR n > 1"), "verdicts")
    once, repeated = d.without(verdicts), verdicts.where("kept")
    if repeated.isEmpty():
        return d.back(once)
    again = d.without(repeated, "left_semi").withColumn("v_key", F.xxhash64(d.of("text"))).dropDuplicates([d.of("doc_id"), "v_key"])
    return d.back(once).union(d.back(again))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Texts and items under five words match nothing, so such documents stay."""
    d = _Numbered(docs)
    found = contaminated(d.docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id=d.of("doc_id"), text=d.of("text"))
    return d.back(d.without(found.select(F.col("doc_id").alias("v_id"), F.col("key").alias("v_key")).distinct()))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data; n_chars follows the text, if there is such a column. Null texts stay null."""
    d = _Numbered(docs)
    out = pseudonymised(d.docs, pseudonym_key(spark), text=d.of("text"))
    if "n_chars" in d.names:
        out = out.withColumn(d.of("n_chars"), F.length(d.of("text")).cast(docs.schema["n_chars"].dataType))
    return d.back(out)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, packed into sequences of 4096 tokens. An empty or null text is its end id alone."""
    d = _Numbered(docs)
    return pack(token_pieces(d.docs, doc_id=d.of("doc_id"), text=d.of("text")))


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_dedup), ("decontamination", decontamination), ("pseudonyms", pii), ("packing", packing)]

#: SQL can't express the outlier estimates, the signatures or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
