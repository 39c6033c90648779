"""Scalar functions over captions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_line(text: Column) -> Column:
    return F.translate(text, "\n", " ")


def word_count(text: Column) -> Column:
    """Words between any Unicode white space, the separators U+001C to U+001F included."""
    return F.regexp_count(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def token_count(text: Column) -> Column:
    """Words between ASCII white space; a newline is a token itself."""
    return F.regexp_count(text, F.lit("[^ \n\r\t\x0b\f\x00]+|\n"))


def char_count(text: Column) -> Column:
    return F.length(text)


def article_prompt(text: Column) -> Column:
    """ "An" before a vowel, else "A", and the text in lower case."""
    low = F.lower(text)
    return F.concat(F.when(F.substring(low, 1, 1).isin(*"aeiou"), "An ").otherwise("A "), low)


def objective(template: Column) -> Column:
    return F.split(template, ":", 2)[0]


def template(template: Column) -> Column:
    return F.split(template, ":", 2)[1]


def numeric_suffix(name: Column) -> Column:
    return F.regexp_extract(name, r"(\d+)$", 1)


def without_suffix(name: Column) -> Column:
    return F.regexp_replace(name, r"\d+$", "")


def entity_offset(line: Column) -> Column:
    """The number of an entity id: a letter, then digits."""
    return F.substring(F.trim(line), 2, 32).cast("long")


def duration(seconds: Column) -> Column:
    """Hours, minutes and seconds."""
    s = seconds.cast("long")
    return F.format_string("%dh %dm %ds", F.expr("0L") + F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def percent(share: Column) -> Column:
    return F.round(100 * share, 1)


def ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a / b).cast("long")


def shard_name(shard: Column, pattern: str = "%08d.tar") -> Column:
    return F.format_string(pattern, shard)


def or_default(value: Column, default: Column) -> Column:
    """``value`` unless it is null or empty."""
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), default.cast("string"))


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def json_with(document: Column, **fields: Column) -> Column:
    """A JSON object's text with more fields (a field that is there is replaced); values keep their types."""
    kept = F.map_filter(F.from_json(document, "map<string,variant>"), lambda k, _: ~k.isin(*fields))
    added = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), F.parse_json(F.to_json(F.struct(v.alias("v")))))])
    return F.to_json(F.map_concat(kept, F.transform_values(added, lambda _, v: F.variant_get(v, "$.v", "variant"))))


def language_is(column: Column, language: str = "en") -> Column:
    return F.coalesce(column == language, F.lit(False))
