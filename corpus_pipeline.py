"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that it is given, and returns a DataFrame; all but the last
return the columns of documents. The quality stage reads labels from sf_dir and learns from rows of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import common, jaccard, packing, quality, secrets, suffix
from leafmill.llm.queries import vocabulary


#: The least number of bytes of a passage that is cut where it repeats: 51 words of four letters and a space each have 254.
#: (The query op5 takes 400, which leaves passages of 51 to some 70 words.)
PASSAGE = 250


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars as the text is now; a null text keeps what it had."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; the others go.

    Null and empty texts are judged as an empty line; rows that repeat an id are judged by their own texts; without
    usable labels every score is 0.5, so all rows go; extra columns stay; an empty table stays empty.
    """
    model = quality.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.kept(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more over five-word shingles, the one of smallest id.

    Texts that are null, empty or without words are linked with nothing and all stay; of rows that repeat an id, one of
    each text stays; extra columns stay; an empty table stays empty.
    """
    return jaccard.one_of_each(docs, 5, 4, 5)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of PASSAGE bytes or more that occur elsewhere too; what is left empty by that goes.

    Every occurrence is cut, and of texts that are equal and as long as that, all go; null texts and those that were
    empty before stay; a character cut in two goes as a whole; extra columns stay; an empty table stays empty.
    """
    return _sized(suffix.deduplicated(docs, PASSAGE, drop_emptied=True))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials give way to a mark; examples that many owners or documents have stay.

    Null texts stay null; a null source is one owner; rows that repeat an id and a text are treated alike; extra columns
    stay; an empty table stays empty.
    """
    return _sized(secrets.redacted(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset.

    A null or empty text is one piece that holds the end id alone; rows that repeat an id are documents of their own;
    columns of the table are left out; an empty table gives no rows.
    """
    return packing.packed(docs, vocabulary("word_bpe_49k.json"), 4096)


STAGES = [
    ("quality classifier", accept_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", cut_repeats),
    ("secret scans", hide_secrets),
    ("best-fit packing", pack),
]

#: A classifier, components and a tokenizer: SQL can't express these.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage writes for itself goes once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with common.made() as own:
        for name, stage in STAGES[:-1]:
            docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            common.cleared(spark, own, keep=docs)
        return STAGES[-1][1](spark, docs, sf_dir)
