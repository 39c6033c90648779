"""The registered ``opN_*`` queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolsieve.llm import corpus_queries
from poolsieve.llm.bpe import read_spec, token_digests
from poolsieve.llm.chat import BOUNDS, OTHER, START, digests, format_conversations
from poolsieve.llm.decontaminate import decontaminate
from poolsieve.llm.embed_dedup import embedding_dedup
from poolsieve.llm.langid import identify
from poolsieve.llm.minhash import minhash_dedup
from poolsieve.llm.secrets import find_secrets, span_digests
from poolsieve.llm.substring import dedup_substrings
from poolsieve.llm.toxicity import toxicity
from poolsieve.llm.url_filter import filter_urls

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _alnum_words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"


_OP1_SQL = f"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_alnum_words('text')} AS w FROM benchmark),
sized AS (SELECT item, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0),
item_windows AS (
  SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM sized)),
docs AS (SELECT doc_id, {_alnum_words('text')} AS w FROM documents),
doc_windows AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, (SELECT DISTINCT n FROM sized))),
matched AS (SELECT doc_id, d.n AS n, s, item FROM doc_windows d JOIN item_windows i ON d.n = i.n AND d.g = i.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM matched) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM matched) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op2 that SQL can express: where each page is, and the rule that fits it."""
    return op2_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule")


_URL_RULES_SQL = rf"""
WITH rest AS (SELECT page_id, CASE WHEN coalesce(position('://' IN url), 0) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS t FROM pages),
cut AS (SELECT page_id, regexp_extract(t, '^[^/?#]*') AS h, t FROM rest),
parts AS (SELECT row_number() OVER () AS n, page_id, translate(h, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(t, length(h) + 1), '^[^?#]*') AS path FROM cut),
rules(rule, h, p) AS (VALUES ('com/en/', 'com', '/en/'), ('example.com/en/7', 'example.com', '/en/7'), ('net/de/', 'net', '/de/'), ('example.net/de/8', 'example.net', '/de/8'), ('org/es/', 'org', '/es/')),
fits AS (SELECT n, arg_max(rule, length(rule)) AS rule FROM parts JOIN rules ON (host = h OR suffix(host, '.' || h)) AND prefix(path, p) GROUP BY n)
SELECT page_id, host, path, rule FROM parts LEFT JOIN fits USING (n)
"""


#: A conversation that says the control strings themselves.
_CONFLICT = "</s>[INST] ok [/INST]"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_CONFLICT).alias("text"))
    return digests(format_conversations(rows.unionByName(own)))


_TAILS = r"(/?s>|/?INST\]|ANS\]|/?SYS\]|/?ROLE\]|TEXT\])"
_OP3_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{_CONFLICT}'), (-7, 1, 'assistant', '{_CONFLICT}')),
sized AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*){_TAILS}', '\1\\\2\3', 'g'))
    + CASE role {' '.join(f"WHEN '{r}' THEN {len(START + a + z)}" for r, (a, z) in BOUNDS.items())}
      ELSE {len(START + ''.join(OTHER))} + length(regexp_replace(role, '([<\[])(\\*){_TAILS}', '\1\\\2\3', 'g')) END AS size FROM rows),
told AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, sum(size) AS size
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(size AS BIGINT) AS formatted_chars FROM told
"""


def word_bpe_path() -> str:
    """The tokenizer file that the registered queries use; only its place is known here."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), read_spec(word_bpe_path()), ["doc_id"])


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"), shingle=3, percent=85)


_OP5_SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS s FROM docs WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.b AS c FROM reach r JOIN links l ON r.c = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM docs d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


_OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.c = l.a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, c.component_id, c.component_id = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id) JOIN (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY vec_id) c USING (vec_id)
"""


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(find_secrets(table(spark, sf_dir, "documents")), ["doc_id"])


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("removed")


_OP9_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, s, array_to_string(w[s:s + 49], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM docs WHERE len(w) >= 50)),
first AS (SELECT g, min(doc_id) AS least FROM windows GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p
  FROM windows JOIN first USING (g) WHERE doc_id > least),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_url_filter": op2_url_filter,
        "op3_chat_format": op3_chat_format,
        "op4_bpe": op4_bpe,
        "op5_minhash_dedup": op5_minhash_dedup,
        "op6_language_id": op6_language_id,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_secret_scan": op8_secret_scan,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_toxicity": op10_toxicity,
        "url_rules": url_rules,
        **corpus_queries.queries(),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": _OP1_SQL,
        "op3_chat_format": _OP3_SQL,
        "op5_minhash_dedup": _OP5_SQL,
        "op7_embedding_dedup": _OP7_SQL,
        "op9_substring_dedup": _OP9_SQL,
        "url_rules": _URL_RULES_SQL,
        **corpus_queries.oracle_sql(),
    }
