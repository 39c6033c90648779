"""First synsets by index files, exceptions and rules for endings."""

from poolsieve.operators.filters import FilterParams, select_uids
from poolsieve.operators.synsets import entity_lexicon, first_synsets, read_exceptions, read_synsets

NOUNS = """  1 This line is part of a licence
child n 2 1 @ 2 1 00000011 00000012
dog n 3 2 @ ~ 3 1 00000021 00000022 00000023
glass n 1 0 1 0 00000031
glasses n 1 1 @ 1 0 00000032
man n 1 1 @ 1 1 00000041
box n 1 1 @ 1 0 00000051
church n 1 1 @ 1 0 00000052
city n 1 1 @ 1 0 00000053
meeting n 1 1 @ 1 0 00000061
broken n x
"""
VERBS = """dog v 1 1 @ 1 0 00000101
run v 1 1 @ 1 0 00000102
hope v 1 1 @ 1 0 00000103
hop v 1 1 @ 1 0 00000104
meet v 1 1 @ 1 0 00000105
"""
ADJECTIVES = "small a 1 1 & 1 0 00000201\nlarge a 1 1 & 1 0 00000202\n"


def lexicon(spark, tmp_path):
    for name, text in (("index.noun", NOUNS), ("index.verb", VERBS), ("index.adj", ADJECTIVES), ("index.adv", ""), ("noun.exc", "children child\nmen man\n"), ("verb.exc", "ran run\nhopping hop\n"), ("index.sense", "other")):
        (tmp_path / name).write_text(text)
    return read_synsets(spark, str(tmp_path)), read_exceptions(spark, str(tmp_path))


def test_inflected_words(spark, tmp_path):
    synsets, exceptions = lexicon(spark, tmp_path)
    want = {
        "dog": 21, "Dogs": 21, "child": 11, "children": 11, "childs": 11, "childrens": None, "glass": 31, "glasses": 32, "boxes": 51, "churches": 52, "cities": 53, "firemen": None, "men": 41, "mans": 41,
        "meeting": 61, "meets": 105, "ran": 102, "runs": 102, "running": None, "hoping": 103, "hopes": 103, "hopping": 104, "hoped": 103, "smaller": 201, "largest": 202, "dogss": 21, "dogsss": 21, "s": None,
        "": None, "none": None, "x" * 300: None,
    }
    got = {r.word: r.offset for r in first_synsets(spark.createDataFrame([(w,) for w in want] + [(None,), ("dog",)], "word string"), synsets, exceptions).collect()}
    assert got == {w: n for w, n in want.items() if n is not None}
    # without the list of exceptions only rules are left
    plain = {r.word: r.offset for r in first_synsets(spark.createDataFrame([("children",), ("men",), ("hopping",)], "word string"), synsets).collect()}
    assert plain == {"men": 41}


def test_text_based_keeps_inflected_entities(spark, tmp_path):
    synsets, exceptions = lexicon(spark, tmp_path)
    captions = ["two Dogs run", "the children", "a glass", "new glasses", "cities", "nothing", None]
    pool = spark.createDataFrame([(str(k), t, "en") for k, t in enumerate(captions)], "uid string, text string, lang string")
    entities = spark.createDataFrame([("n00000021",), ("n00000011 ",), ("n00000032",)], "line string")
    kept = select_uids("text_based", pool, FilterParams(lexicon=entity_lexicon(pool, entities, synsets, exceptions)))
    assert sorted(r.uid for r in kept.collect()) == ["0", "1", "3"]
