"""First synsets of words, by the files of a lexical database and its rules for base forms.

A word has the synsets of its base forms, noun before verb before adjective before
adverb.  Where a list of exceptions has the word, its base forms are the word itself
and those listed.  Else they are the word and what the endings' rules make of it, or,
where none of these is a lemma, what the rules make of that, and so on.

Words are looked up once, as a vocabulary: their forms are joined to the lemmas, and
the first of each word is kept by a partial minimum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolsieve.functions.text import words
from poolsieve.operators.filters import lexicon_of

#: Parts of speech in their order, their files, and the endings' rules of each.
PARTS = {"n": "noun", "v": "verb", "a": "adj", "r": "adv"}
RULES = {
    "n": [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")],
    "v": [("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")],
    "a": [("er", ""), ("est", ""), ("er", "e"), ("est", "e")],
    "r": [],
}
#: Longer words have no synset; no lemma is half as long.
LONGEST = 200


def parse_index(lines: DataFrame) -> DataFrame:
    """``lemma, pos, offset`` of index lines ``value``: the first synset of each lemma; lines that begin with a blank are no entries."""
    entry = F.split("value", r"\s+")
    known = lines.where("value <> '' AND NOT startswith(value, ' ')").select(entry.alias("e"))
    pointers = F.try_element_at("e", F.lit(4)).try_cast("int")
    return known.select(F.lower(F.col("e")[0]).alias("lemma"), F.col("e")[1].alias("pos"), F.try_element_at("e", pointers + 7).try_cast("long").alias("offset")).where("offset IS NOT NULL")


def read_synsets(spark: SparkSession, folder: str) -> DataFrame:
    """``lemma, pos, offset`` of the files ``index.noun``, ``index.verb``, ``index.adj`` and ``index.adv``."""
    return parse_index(spark.read.option("pathGlobFilter", "index.{noun,verb,adj,adv}").text(folder))


def read_exceptions(spark: SparkSession, folder: str) -> DataFrame:
    """``word, pos, form, place`` of the files ``noun.exc`` and so on: a word and its base forms on each line."""
    lines = spark.read.option("pathGlobFilter", "{noun,verb,adj,adv}.exc").text(folder).select("value", F.regexp_extract("_metadata.file_path", r"(\w+)\.exc$", 1).alias("file"))
    pos = F.create_map(*[F.lit(x) for p, f in PARTS.items() for x in (f, p)])[F.col("file")]
    told = lines.select(F.split("value", r"\s+").alias("e"), pos.alias("pos")).where("size(e) > 1")
    return told.select(F.col("e")[0].alias("word"), "pos", F.posexplode(F.expr("slice(e, 2, size(e))")).alias("place", "form")).where("form <> ''").select("word", "pos", "form", (F.col("place") + 1).alias("place"))


def _derived(word: str) -> Iterator[tuple[str, int, int, str]]:
    """``pos, turn, place, form`` of all that the rules make of a word."""
    for pos, rules in RULES.items():
        forms, turn = [word], 0
        yield pos, 0, 0, word
        while forms and len(word) <= LONGEST:
            forms = list(dict.fromkeys(f[: -len(old)] + new for f in forms for old, new in rules if f.endswith(old)))
            for place, form in enumerate(forms, 1):
                yield pos, turn, place, form
            turn += 1


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(w, *x) for w in batch.column(0).to_pylist() for x in _derived(w)]
        if rows:
            word, pos, turn, place, form = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(pos), pa.array(np.array(turn, np.int32)), pa.array(np.array(place, np.int32)), pa.array(form)], ["word", "pos", "turn", "place", "form"])


def first_synsets(vocabulary: DataFrame, synsets: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """``word, lemma, pos, offset`` of the different words ``word`` that have a synset; case does not matter, ``word`` stays as it is."""
    lowered = vocabulary.select("word", F.lower("word").alias("low")).where("word IS NOT NULL").distinct()
    forms = lowered.select("low").distinct().mapInArrow(_forms, "word string, pos string, turn int, place int, form string")
    if exceptions is not None:
        listed = exceptions.select(F.col("word").alias("word"), "pos").distinct()
        own = F.expr("turn = 0 AND place = 0")
        forms = forms.where(own).unionByName(forms.where(~own).join(listed, ["word", "pos"], "left_anti"))
        forms = forms.unionByName(exceptions.select("word", "pos", F.lit(0).alias("turn"), F.col("place").cast("int").alias("place"), "form"))
    rank = F.create_map(*[F.lit(x) for k, p in enumerate(PARTS) for x in (p, k)])[F.col("pos")]
    found = forms.join(synsets.select(F.col("lemma").alias("form"), "pos", "offset"), ["form", "pos"])
    best = found.groupBy("word").agg(F.min(F.struct(rank.alias("rank"), "turn", "place", F.col("form").alias("lemma"), "pos", "offset")).alias("b"))
    return lowered.join(best.withColumnRenamed("word", "low"), "low").select("word", "b.lemma", "b.pos", "b.offset")


def vocabulary(pool: DataFrame, text: str = "text") -> DataFrame:
    """The different words of all captions, lower-cased."""
    return pool.select(F.explode(words(F.lower(F.col(text)))).alias("word")).distinct()


def entity_lexicon(pool: DataFrame, entities: DataFrame, synsets: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """``word`` of the pool's words whose first synset is among the entities (``line``), inflected ones too: the lexicon of ``text_based``."""
    return lexicon_of(entities, first_synsets(vocabulary(pool), synsets, exceptions))
