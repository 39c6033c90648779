"""A Bloom filter of ids as a table, so that rows that cannot match never reach a join's shuffle.

Every id sets BITS bits of one 64-bit word that its hash names; words are made by
one partial aggregation.  A row may match if the word of its id holds all its
bits, which a broadcast join decides where the row is read.  Of other ids about
one in a hundred gets through at PER_WORD ids a word, and none of the right ones
is lost, so a join afterwards gives equal results.

The number of words follows from the number of ids.  Beyond MAX_WORDS the words
hold more ids each, up to MOST ids, at which about a tenth of other ids get
through; with still more, rows pass as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 4
PER_WORD = 4
#: Of which the broadcast table has about 40 bytes each.
MAX_WORDS = 1 << 21
#: Ids in a word beyond which the filter is left out.
MOST = 12


def _word(uid: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(uid, F.lit(1)), F.lit(words))


def _mask(uid: Column) -> Column:
    h, one = F.xxhash64(uid, F.lit(2)), F.lit(1).cast("long")
    mask = F.lit(0).cast("long")
    for k in range(BITS):
        place = F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", one, place))
    return mask


def words_for(ids: int) -> int:
    """How many words ``ids`` need; 0 if no filter is worth it."""
    words = min(max(1, -(-ids // PER_WORD)), MAX_WORDS)
    return words if ids <= words * MOST else 0


def may_match(rows: DataFrame, subset: DataFrame, ids: int, uid: str = "uid") -> DataFrame:
    """The ``rows`` whose id may be in ``subset``, which has at most ``ids`` rows.

    Null ids never match.  Columns of any names are kept, except that ``__word``
    and ``__bits`` are used inside.
    """
    words = words_for(ids)
    if not words:
        return rows
    asked = subset.where(F.col(uid).isNotNull())
    table = asked.groupBy(_word(F.col(uid), words).alias("__word")).agg(F.bit_or(_mask(F.col(uid))).alias("__bits"))
    own = _mask(rows[uid])
    fits = (_word(rows[uid], words) == table["__word"]) & (table["__bits"].bitwiseAND(own) == own) & rows[uid].isNotNull()
    return rows.join(F.broadcast(table), fits, "left_semi")
