"""The registered queries over whole corpora, op11 to op13, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from poolsieve.llm.filter_audit import audit_filters
from poolsieve.llm.fingerprints import NARROW, WIDE, edited_fingerprints
from poolsieve.llm.variants import spelling_variants


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


# CRC-32 bit by bit over the hexadecimal digits of the UTF-8, the low one of each byte first
_OP11_SQL = """
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL),
digits AS (SELECT doc_id, run, k, hex(doc_id || ':' || run) AS x FROM runs),
bits AS (
  SELECT run, k, flatten(list_transform(range(0, length(x)), lambda i: list_transform(range(0, 4), lambda b:
    ((strpos('0123456789ABCDEF', x[CAST(xor(i, 1) AS BIGINT) + 1]) - 1) >> b) & 1))) AS b FROM digits),
hashed AS (SELECT run, k, xor(list_reduce(b, lambda c, v: xor(c >> 1, 3988292384 * (xor(c, v) & 1)), 4294967295), 4294967295) AS h FROM bits),
words AS (
  SELECT w, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS w, k FROM hashed)
  WHERE length(w) >= 5 GROUP BY w HAVING sum(k) >= 3),
gone AS (SELECT w, n, i, substr(w, 1, i) || substr(w, i + 2) AS d FROM (SELECT w, n, unnest(range(0, length(w))) AS i FROM words)),
near AS (
  SELECT a.w, b.w AS v, b.n FROM gone a JOIN gone b ON a.d = b.d AND a.i = b.i AND a.w <> b.w
  UNION SELECT a.w, b.w, b.n FROM gone a JOIN words b ON a.d = b.w
  UNION SELECT b.w, a.w, a.n FROM gone a JOIN words b ON a.d = b.w),
best AS (SELECT w, count(*) AS n_near, max(n) AS most FROM near GROUP BY w),
told AS (
  SELECT words.w, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * n THEN most END AS form_n,
    CASE WHEN most >= 2 * n THEN (SELECT min(v) FROM near WHERE near.w = words.w AND near.n = most) END AS form
  FROM words LEFT JOIN best USING (w)),
follow AS (SELECT w, w AS at FROM told UNION ALL SELECT f.w, t.form FROM follow f JOIN told t ON t.w = f.at WHERE t.form IS NOT NULL),
ends AS (SELECT f.w, f.at AS root FROM follow f JOIN told t ON t.w = f.at WHERE t.form IS NULL)
SELECT w AS word, form, root, n, n_near, form_n FROM told JOIN ends USING (w)
"""


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(_table(spark, sf_dir, "documents"))


_OP12_SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS r, count(*) OVER () AS c FROM documents),
pairs AS (
  SELECT a.r, a.doc_id, b.r AS after, a.t, substr(a.t, 1, length(a.t) - length(a.t) // 2) || substr(b.t, 1, length(a.t) // 2) AS e
  FROM docs a JOIN docs b ON b.r = CASE WHEN a.r = a.c THEN 1 ELSE a.r + 1 END),
texts AS (SELECT r, 0 AS kind, t FROM pairs UNION ALL SELECT r, 1, e FROM pairs),
-- paragraphs, and how often each counts
lines AS (
  SELECT r, kind, sha256(x) AS h, 1 AS k FROM (SELECT r, kind, unnest(string_split(t, chr(10))) AS x FROM texts) WHERE x <> ''
  UNION ALL SELECT r, kind, sha256(chr(10)), length(t) - length(replace(t, chr(10), '')) FROM texts),
digits AS (SELECT '0123456789abcdef' AS d),
words AS (
  SELECT r, kind, lane, CAST(sum(k * CAST(list_reduce(list_transform(range(1, 17), lambda i: CAST(strpos(d, substr(h, lane * 16 + i, 1)) - 1 AS HUGEINT)), lambda a, b: a * 16 + b) AS HUGEINT)) % 18446744073709551616 AS HUGEINT) AS v
  FROM lines, digits, range({WIDE}) w(lane) GROUP BY r, kind, lane),
wide AS (SELECT r, kind, string_agg(lpad(hex(CAST(v AS UBIGINT)), 16, '0'), '' ORDER BY lane) AS x FROM words GROUP BY r, kind),
sentences AS (SELECT r, kind, sha256(x) AS h FROM (SELECT r, kind, ltrim(unnest(regexp_extract_all(t, '[^.!?\n]*[.!?]+|[^.!?\n]+')), ' ' || chr(9)) AS x FROM texts) WHERE x <> ''),
signs AS (
  SELECT r, kind, lane, sum(2 * (((strpos(d, substr(h, lane // 4 + 1, 1)) - 1) >> (3 - lane % 4)) & 1) - 1) AS v
  FROM sentences, digits, range({NARROW}) w(lane) GROUP BY r, kind, lane),
lanes AS (SELECT r, kind, lane, CAST(((coalesce(v, 0) + 32768) % 65536 + 65536) % 65536 - 32768 AS BIGINT) AS v FROM (SELECT r, kind, CAST(lane AS BIGINT) AS lane FROM texts, range({NARROW}) w(lane)) LEFT JOIN signs USING (r, kind, lane)),
narrow AS (SELECT r, kind, string_agg(lpad(hex(CAST((v + 65536) % 65536 AS UBIGINT)), 4, '0'), '' ORDER BY lane) AS x, sum(v * v) AS size FROM lanes GROUP BY r, kind),
prints AS (SELECT r, kind, wide.x || narrow.x AS x, size FROM wide JOIN narrow USING (r, kind)),
dots AS (
  SELECT p.r, sum(a.v * b.v) AS edited, sum(a.v * n.v) AS next
  FROM pairs p JOIN lanes a ON a.r = p.r AND a.kind = 0 JOIN lanes b ON b.r = p.r AND b.kind = 1 AND b.lane = a.lane JOIN lanes n ON n.r = p.after AND n.kind = 0 AND n.lane = a.lane GROUP BY p.r)
SELECT p.doc_id, length(p.t) AS n_chars, sha256(p.e) AS edited_sha256, to_base64(unhex(a.x)) AS fingerprint, to_base64(unhex(b.x)) AS edited_fingerprint,
  CASE WHEN a.x = b.x THEN 1.0::DOUBLE WHEN a.size = 0 OR b.size = 0 THEN 0 ELSE least(1, greatest(0, CAST(edited AS DOUBLE) / (sqrt(CAST(a.size AS DOUBLE)) * sqrt(CAST(b.size AS DOUBLE))))) END AS near_edited,
  CASE WHEN a.x = n.x THEN 1.0::DOUBLE WHEN a.size = 0 OR n.size = 0 THEN 0 ELSE least(1, greatest(0, CAST(next AS DOUBLE) / (sqrt(CAST(a.size AS DOUBLE)) * sqrt(CAST(n.size AS DOUBLE))))) END AS near_next
FROM pairs p JOIN dots USING (r) JOIN prints a ON a.r = p.r AND a.kind = 0 JOIN prints b ON b.r = p.r AND b.kind = 1 JOIN prints n ON n.r = p.after AND n.kind = 0
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


_OP13_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
first AS (SELECT t, min(doc_id) AS least FROM docs GROUP BY t),
judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(docs.doc_id > least, false) AS e
  FROM docs LEFT JOIN marks ON docs.doc_id = marks.doc_id JOIN first USING (t)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
grown AS (SELECT '' AS o UNION ALL SELECT o || l FROM grown, letters WHERE strpos(o, l) = 0),
orders AS (SELECT o FROM grown WHERE length(o) = 5),
cells AS (
  SELECT part, concat(CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END) AS f,
    count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY ALL),
steps AS (SELECT o, CAST(s AS INT) AS step, substr(o, s, 1) AS l, substr(o, 1, s - 1) AS before FROM orders, range(1, 6) x(s)),
counted AS (
  SELECT part, o, step, l,
    sum(n) FILTER (translate(f, o[:step], '') = f) AS kept,
    sum(n) FILTER (contains(f, l) AND translate(f, before, '') = f) AS removed,
    sum(n) FILTER (contains(f, l) AND translate(f, before, '') <> f) AS redundant,
    sum(n) FILTER (f = l) AS unique_fails,
    sum(good) FILTER (contains(f, l) AND translate(f, before, '') = f) AS good_lost,
    sum(toxic) FILTER (contains(f, l) AND translate(f, before, '') = f) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, o AS filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, l) AS BIGINT) AS shapley
FROM counted
"""


def queries():
    return {"op11_spelling_variants": op11_spelling_variants, "op12_fingerprints": op12_fingerprints, "op13_filter_audit": op13_filter_audit}


def oracle_sql() -> dict[str, str]:
    return {"op11_spelling_variants": _OP11_SQL, "op12_fingerprints": _OP12_SQL, "op13_filter_audit": _OP13_SQL}
