"""A corpus pipeline of five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``, and take further ones, whatever their
names, through.  An empty table gives empty results.  Null texts count as empty.
Rows without an id are judged by their text as others are, except that they are
never near duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from poolsieve.llm.bpe import read_spec, token_digests
from poolsieve.llm.components import cut
from poolsieve.llm.decontaminate import decontaminate
from poolsieve.llm.minhash import minhash_dedup
from poolsieve.llm.queries import table, word_bpe_path
from poolsieve.llm.secrets import find_secrets
from poolsieve.llm.toxicity import toxicity

SECRET = "[SECRET]"


def _whole(docs: DataFrame) -> DataFrame:
    """The id, the text, and the whole row aside, so that no column's name meets that of a result."""
    return docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    scored = toxicity(_whole(docs), table(spark, sf_dir, "labels"), keep=["__row"])
    return scored.where("predicted = 0").select("__row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Where ids repeat, rows of one id and one text are one document, of which one
    row stays, and rows of one id with different texts are documents of their own.
    """
    named, rest = docs.where("doc_id IS NOT NULL"), docs.where("doc_id IS NULL")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = minhash_dedup(named).where("NOT kept").select("doc_id")
        return named.join(gone, "doc_id", "left_anti").select(*docs.columns).unionByName(rest)
    # ordered as the ids are, then by text; ids that are no whole numbers are ordered as text
    whole = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    place = F.lpad(F.expr("cast(doc_id AS decimal(20,0)) + 9223372036854775808BD").cast("string"), 20, "0") if whole else F.concat(F.col("doc_id").cast("string"), F.lit("\0"))
    key = F.concat(place, F.coalesce(F.sha2("text", 256), F.lit("")))
    keyed = _whole(named).withColumn("__key", key)
    gone = minhash_dedup(keyed, "__key").where("NOT kept").select(F.col("doc_id").alias("__key")).distinct()
    left = keyed.join(gone, "__key", "left_anti").groupBy("__key").agg(F.min_by("__row", F.to_json("__row")).alias("__row"))
    return left.select("__row.*").unionByName(rest)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    judged = decontaminate(_whole(docs), table(spark, sf_dir, "benchmark"), keep=["__row"])
    return judged.where("NOT contaminated").select("__row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced in the text; no document goes."""
    masked = find_secrets(_whole(docs), keep=["__row", "text"], redact=SECRET)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    return masked.select(*[new.get(c, F.col("__row")[c]).alias(c) for c in docs.columns])


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every text that is left, and their decoding, as counts and digests."""
    return token_digests(docs.select("doc_id", "lang", "source", "text"), read_spec(word_bpe_path()), ["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("tokens", encode_tokens),
]

#: The language models and the network are not SQL; tests compare what each stage keeps with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
