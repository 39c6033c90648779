"""Selection of pool samples by named filters.

Every filter turns a pool into the ids it keeps.  Conditions are native
expressions, so they are pushed down or fused with the scan; a language
detector is a function from the caption column to a language column, by default
the pool's own ``lang``.  A null caption is kept by no filter that reads it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolsieve.functions.text import char_count, entity_offset, token_count, word_count, words
from poolsieve.functions.vector import scaled_min_max
from poolsieve.operators.centroids import BROADCAST_BYTES, nearest_centroid
from poolsieve.operators.threshold import top_fraction_threshold

Detector = Callable[[Column], Column]

SCALES = ("small", "medium", "large", "xlarge")
ARCHES = ("b32", "l14")
LAION_SCORE = 0.28


def own_language(_: Column) -> Column:
    return F.col("lang")


@dataclass(frozen=True)
class FilterParams:
    threshold: float | None = None
    fraction: float | None = None
    arch: str | None = None
    scale: str | None = None
    detector: Detector = own_language
    lexicon: DataFrame | None = None  # word
    centroids: DataFrame | None = None  # centroid_id, c
    targets: DataFrame | None = None  # centroid_id
    vector: str = "embedding"
    pool: DataFrame | None = None  # the rows that a fraction is of, where the filter is given fewer


def score_column(arch: str) -> str:
    return "clip_b32_similarity_score" if arch == "b32" else "clip_l14_similarity_score"


def check_params(name: str, p: FilterParams) -> None:
    """Raise ValueError where the parameters do not suit the filter."""
    if name not in FILTERS:
        raise ValueError(f"unknown filter {name}; there are {sorted(FILTERS)}")
    scored, imaged = "clip_score" in name, "image_based" in name
    if scored:
        if (p.threshold is None) == (p.fraction is None):
            raise ValueError("give either a threshold or a fraction")
        if p.arch not in ARCHES:
            raise ValueError(f"give an architecture of {ARCHES}")
        if p.fraction is not None and not 0 <= p.fraction < 1:
            raise ValueError("the fraction must be at least 0 and below 1")
    elif any(x is not None for x in (p.threshold, p.fraction, p.arch)):
        raise ValueError("threshold, fraction and architecture are for score filters")
    if imaged != (p.scale is not None):
        raise ValueError("a scale is for the image filters, which need one")
    if imaged and p.scale not in SCALES:
        raise ValueError(f"the scale must be one of {SCALES}")
    if imaged and (p.centroids is None or p.targets is None):
        raise ValueError("image filters need centroids and target centroids")
    if name == "text_based" and p.lexicon is None:
        raise ValueError("text_based needs a lexicon")


def at_least(df: DataFrame, column: str, threshold: float | None) -> Column:
    """Score at or above the threshold, compared in the column's own type; NaN and null are not."""
    if threshold is None:
        return F.lit(False)
    c = F.col(column)
    return F.coalesce(~F.isnan(c) & (c >= F.lit(threshold).cast(df.schema[column].dataType)), F.lit(False))


def score_condition(pool: DataFrame, p: FilterParams) -> Column:
    column = score_column(p.arch)
    threshold = p.threshold if p.fraction is None else top_fraction_threshold(pool if p.pool is None else p.pool, column, p.fraction)
    return at_least(pool, column, threshold)


def english(p: FilterParams) -> Column:
    return F.coalesce(p.detector(F.col("text")) == "en", F.lit(False))


def basic_condition(p: FilterParams) -> Column:
    small, large = scaled_min_max(F.col("original_width"), F.col("original_height"))
    shape = (small >= 200) & (F.try_divide(large, small) <= 3.0)
    return F.coalesce((word_count(F.col("text")) > 2) & (char_count(F.col("text")) > 5) & shape, F.lit(False)) & english(p)


def caption_condition(p: FilterParams) -> Column:
    """More than one token of the other tokenizer, more than five characters, English."""
    text = F.col("text")
    return F.coalesce((token_count(text) > 1) & (char_count(text) > 5), F.lit(False)) & english(p)


def lexicon_of(entities: DataFrame, synsets: DataFrame) -> DataFrame:
    """``word`` of the words whose first synset is among the entities.

    ``entities`` has ``line`` (an entity id each), ``synsets`` has ``word`` and
    ``offset``, the number of the word's first synset.
    """
    return synsets.join(entities.select(entity_offset(F.col("line")).alias("offset")).distinct(), "offset", "left_semi").select("word").distinct()


def entity_rows(pool: DataFrame, p: FilterParams, held_words: int = 20_000) -> DataFrame:
    """English captions with a word of the lexicon, once for each of their rows.

    A lexicon of at most ``held_words`` words (counted) is part of the condition,
    so nothing is shuffled; a larger one is joined to the words of each row.
    """
    rows = pool.where(english(p)).withColumn("__words", words(F.lower(F.col("text"))))
    lexicon = p.lexicon.select("word").where("word IS NOT NULL").distinct()
    held = [r[0] for r in lexicon.limit(held_words + 1).collect()]
    if len(held) <= held_words:
        told = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in sorted(held)) or "NULL"
        return rows.where(F.expr(f"exists(__words, w -> w IN ({told}))")).drop("__words")
    named = rows.withColumn("__row", F.monotonically_increasing_id())
    return named.select("uid", "__row", F.explode(F.array_distinct("__words")).alias("word")).join(lexicon, "word", "left_semi").select("uid", "__row").distinct().drop("__row")


def image_rows(pool: DataFrame, p: FilterParams) -> DataFrame:
    assigned = nearest_centroid(pool.where(caption_condition(p)).select("uid", p.vector), p.centroids, p.vector, BROADCAST_BYTES)
    return assigned.join(p.targets.select("centroid_id").distinct(), "centroid_id", "left_semi")


FILTERS: dict[str, Callable[[DataFrame, FilterParams], DataFrame]] = {
    "no_filter": lambda pool, p: pool,
    "basic_filter": lambda pool, p: pool.where(basic_condition(p)),
    "clip_score": lambda pool, p: pool.where(score_condition(pool, p)),
    "laion2b": lambda pool, p: pool.where(at_least(pool, "clip_b32_similarity_score", LAION_SCORE) & english(p)),
    "text_based": entity_rows,
    "image_based": image_rows,
    "image_based_intersect_clip_score": lambda pool, p: image_rows(pool.where(score_condition(pool, p)), p),
}


def select_uids(name: str, pool: DataFrame, params: FilterParams | None = None) -> DataFrame:
    """The ``uid`` of every sample of ``pool`` that the filter keeps, once for each of its rows."""
    params = params or FilterParams()
    check_params(name, params)
    return FILTERS[name](pool, params).select("uid")


def intersect(*subsets: DataFrame) -> DataFrame:
    """Ids in all of the subsets."""
    out = subsets[0].select("uid")
    for s in subsets[1:]:
        out = out.intersect(s.select("uid"))
    return out
