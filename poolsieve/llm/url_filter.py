"""URL filters: host and path rules, then a character language-model ratio.

Rules are a short list of host, path prefix and verdict.  A rule fits its host
and all subdomains where the path begins with the rule's; of several the
longest wins, host and path together, then the longer host.

URLs without a rule are judged by two variable-order Markov models over
characters, of accepted and of rejected URLs.  The examples are the different
URLs that a rule judges.  Orders 0 to 3 are interpolated as Witten and Bell do:

    p(c | s) = (n(s, c) + types(s) * p(c | s without its first)) / (n(s) + types(s))

down to a uniform distribution.  A URL's score is the mean over its characters
and its end of log p_accepted - log p_rejected; it is allowed from a threshold
on.  The threshold is calibrated on one in CALIBRATION of the examples, which
the models do not see: the one of the best mean of both classes' hit rates.

Everything is DataFrame expressions.  URLs are scored once each.  The log
ratios of all character 4-grams there are form a table; it is broadcast while
it has at most MAX_BROADCAST rows (counted first), else joined by a shuffle.

A null URL, or one without "://", has an empty host and path, and is scored as
it is (null: as the empty text).  Without examples of both classes every URL
that no rule judges is allowed.  URLs are read whole, however long.  Rows that repeat are
judged each and alike; a score at the threshold is allowed, and of rules of equal
length the one with the longer host wins.  An empty table gives an empty result.
Only the kept columns and the URL are read, so others may have any name;
a kept one that is called as a result is gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolsieve.llm.components import cut
from poolsieve.llm.groups import join_salted

ORDER = 3
CALIBRATION = 5
MAX_BROADCAST = 500_000
_SYMBOLS = 256.0
_BEGIN, _END = "\u0002", "\u0003"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Host, path prefix, verdict.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def host_of(url: Column) -> Column:
    rest = F.expr("substring(__u, instr(__u, '://') + 3)")
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.expr("substring(__u, instr(__u, '://') + 3)")
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """``struct<rule, verdict>`` of the rule that decides, or null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(urls: DataFrame) -> DataFrame:
    """The 4-grams of each ``u``, one for each of its characters and its end."""
    padded = F.concat(F.lit(_BEGIN * ORDER), F.col("u"), F.lit(_END))
    return urls.withColumn("__p", padded).withColumn("g", F.explode(F.expr(f"transform(sequence(1, length(__p) - {ORDER}), i -> substring(__p, i, {ORDER + 1}))"))).drop("__p")


def _ratios(examples: DataFrame, grams: DataFrame) -> DataFrame:
    """``g, ratio`` of all ``grams``, learned from ``u, good`` rows."""
    seen = _grams(examples).groupBy("g").agg(F.sum(F.expr("int(good)")).alias("c1"), F.sum(F.expr("int(NOT good)")).alias("c0"))
    seen = cut(seen)
    out = grams.withColumn("p0", F.lit(1 / _SYMBOLS)).withColumn("p1", F.lit(1 / _SYMBOLS))
    for k in range(ORDER + 1):
        tail, head = F.substring("g", ORDER + 1 - k, k + 1), F.substring("g", ORDER + 1 - k, k)
        counts = seen.groupBy(tail.alias(f"t{k}")).agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
        contexts = counts.groupBy(F.substring(f"t{k}", 1, k).alias(f"h{k}"))
        contexts = contexts.agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1"), F.sum(F.expr("int(c0 > 0)")).alias("v0"), F.sum(F.expr("int(c1 > 0)")).alias("v1"))
        out = out.withColumn(f"t{k}", tail).withColumn(f"h{k}", head).join(counts, f"t{k}", "left").join(contexts, f"h{k}", "left").na.fill(0, ["c0", "c1", "n0", "n1", "v0", "v1"])
        for c in "01":
            out = out.withColumn(f"p{c}", F.when(F.col(f"n{c}") > 0, (F.col(f"c{c}") + F.col(f"v{c}") * F.col(f"p{c}")) / (F.col(f"n{c}") + F.col(f"v{c}"))).otherwise(F.col(f"p{c}")))
        out = out.select("g", "p0", "p1")
    return out.select("g", F.log(F.col("p1") / F.col("p0")).alias("ratio"))


def _threshold(scored: DataFrame) -> float:
    """Of ``score, good`` rows, the score from which on to allow; 0 without both classes."""
    bins = scored.groupBy(F.round("score", 3).alias("s")).agg(F.sum(F.expr("int(good)")).alias("g"), F.sum(F.expr("int(NOT good)")).alias("b"))
    # few bins, whatever the number of URLs
    rows = sorted((r.s, r.g, r.b) for r in bins.collect())
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return 0.0
    best, at, below_good, below_bad = 0.0, rows[0][0], 0, 0
    for s, g, b in rows:
        rate = (good - below_good) / good + below_bad / bad
        if rate > best:
            best, at = rate, s
        below_good, below_bad = below_good + g, below_bad + b
    return at - 0.0005


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, keep: list[str] | None = None, url: str = "url") -> DataFrame:
    """``keep`` columns, ``host, path, rule, verdict`` and the method's ``score`` of every page."""
    rules = RULES if rules is None else rules
    keep = [c for c in (["page_id"] if keep is None else keep) if c not in ("host", "path", "rule", "verdict", "score")]
    rows = pages.select(*[F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)], F.coalesce(F.col(url), F.lit("")).alias("__u"))
    rows = rows.withColumn("host", host_of(F.col("__u"))).withColumn("path", path_of(F.col("__u"))).withColumn("by", rule_of(F.col("host"), F.col("path"), rules))
    urls = cut(rows.groupBy(F.col("__u").alias("u")).agg(F.first("by.verdict").alias("verdict"), F.count("*").alias("n")))
    part = F.pmod(F.xxhash64("u", F.lit("calibration")), F.lit(CALIBRATION)) == 0
    ruled = urls.where("verdict IS NOT NULL").select("u", (F.col("verdict") == "allow").alias("good"), part.alias("cal"))
    asked = urls.where("verdict IS NULL").select("u", F.lit(None).cast("boolean").alias("good"))
    wanted = asked.unionByName(ruled.where("cal").select("u", "good"))
    classes = ruled.where("NOT cal").agg(F.sum(F.expr("int(good)")), F.sum(F.expr("int(NOT good)"))).first()
    if not all(classes):
        scored, least = asked.select("u", F.lit(0.0).alias("score")), 0.0
    else:
        grams = _grams(wanted)
        ratios = cut(_ratios(ruled.where("NOT cal").select("u", "good"), grams.select("g").distinct()))
        if ratios.count() <= MAX_BROADCAST:
            ratios = F.broadcast(ratios)
        both = cut(grams.join(ratios, "g").groupBy("u", "good").agg(F.avg("ratio").alias("score")))
        scored, least = both.where("good IS NULL").select("u", "score"), _threshold(both.where("good IS NOT NULL"))
    # every URL without a rule has a score; one that many pages have is dealt to many tasks
    sized = scored.join(urls.select("u", "n"), "u").withColumnRenamed("u", "__u")
    left = join_salted(rows.where("by IS NULL"), sized, ["__u"], "n", [f"__keep{i}" for i in range(len(keep))] or ["__u"])
    judged = left.unionByName(rows.where("by IS NOT NULL").withColumn("score", F.lit(None).cast("double")))
    verdict = F.coalesce("by.verdict", F.when(F.col("score") >= least, "allow").otherwise("block"))
    return judged.select(*[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)], "host", "path", F.col("by.rule").alias("rule"), verdict.alias("verdict"), "score")
