"""Text quality rules per document, and host verdicts over them.

Only DataFrame functions.  The rules of a text are worked out inside its row:
repeated five-word windows come from sorting the row's own array of
(window hash, position), so no window is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CHARS, column_name, table, words_of, written

#: Bytes of rejected hosts' names that are sent to all tasks; beyond that the join is salted.
MOST_BROADCAST = 8 << 20
SALTS = 64
#: Columns of the results; those of the documents that are called so are left out.
RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
#: Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def _repeat_words(words: Column, n: Column) -> Column:
    """Words covered by windows that occur twice or more in the array."""
    starts = F.sequence(F.lit(1), n - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(n > WINDOW, hashes)


def text_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Words are runs of characters other than space and U+0009 to U+000D; a null
    text has none.  ``word_chars`` counts code points in words, ``n_dup_lines``
    lines with a word that equal an earlier line, ``n_repeat_words`` the words
    in five-word windows that the text has at least twice (windows are compared
    by 64-bit hash within the text).  ``base_failed``: fewer than 10 words, or
    over 20 % of them repeated; so an empty or null text fails.  A column of
    ``docs`` that is called like a result gives way to it, other columns pass
    through.  Repeated rows are judged each, an empty table gives no rows.
    """
    docs = docs.select([f"`{c}`" for c in docs.columns if c.lower() not in RULES or c == text])
    t, lines_of = F.coalesce(F.col(text), F.lit("")), F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")
    w, h, p = (column_name(docs, x) for x in ("_words", "_hashes", "_positions"))
    lines = column_name(docs, "_lines")
    a = docs.select(
        *[f"`{c}`" for c in docs.columns if c != text],
        words_of(F.col(text)).alias(w),
        lines_of.alias(lines),
        F.length(F.translate(t, WS_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    a = a.withColumn("n_words", F.size(w).cast("long")).withColumn("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")).drop(lines)
    a = a.withColumn(h, _repeat_words(F.col(w), F.size(w))).drop(w)
    # only texts with a repeated window are sorted
    pairs = F.array_sort(F.zip_with(h, F.sequence(F.lit(0), F.size(h) - 1), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    a = a.withColumn(p, F.when(F.size(F.array_distinct(h)) < F.size(h), pairs))
    same = lambda i, j: F.coalesce(F.get(F.col(p), j)["x"] == F.get(F.col(p), i)["x"], F.lit(False))
    marked = F.transform(p, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"]))
    a = a.withColumn(p, F.array_sort(F.filter(marked, lambda x: x.isNotNull())))
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(p), i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x)
    a = a.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(h, p)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return a.withColumn("base_failed", failed)


def host_verdicts(rules: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """host, n_docs, n_failed, shrunk_rate, host_ok.

    A beta prior is fitted to the hosts' failure rates by moments and each rate
    is shrunk to (failures + a) / (documents + a + b), so that a host needs
    many failures, not a few out of a few, to be rejected.  Hosts whose shrunk
    rate is over ``max_rate`` are rejected.  Rows without a host are left out.
    """
    hosts = rules.filter(F.col(host).isNotNull()).groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    # moments over hosts: mean of rates, their variance less what sampling alone explains
    m = hosts.agg(F.avg(rate).alias("mean"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("var"), F.avg(1 / F.col("n_docs")).alias("inv_n")).select(
        "mean", F.greatest(F.lit(1e-6), F.col("var") - F.col("mean") * (1 - F.col("mean")) * F.col("inv_n")).alias("between"), (F.col("mean") * (1 - F.col("mean"))).alias("spread")
    )
    strength = F.least(F.lit(1000.0), F.greatest(F.lit(2.0), F.col("spread") / F.col("between") - 1))
    prior = m.select((F.col("mean") * strength).alias("a"), ((1 - F.col("mean")) * strength).alias("b"))
    # one row, an aggregate without keys
    shrunk = (F.col("n_failed") + F.col("a")) / (F.col("n_docs") + F.col("a") + F.col("b"))
    return hosts.join(F.broadcast(prior)).select(host, "n_docs", "n_failed", shrunk.alias("shrunk_rate"), (shrunk <= max_rate).alias("host_ok"))


def _with_verdict(rules: DataFrame, host: str, max_rate: float) -> DataFrame:
    """``rules`` (written) with ``kept``.

    What is joined back are the rejected hosts only, so that no document moves
    while they fit a broadcast, and a host with very many documents is spread
    over salts beyond it.
    """
    bad, salt = column_name(rules, "rejected"), column_name(rules, "salt")
    rejected = written(host_verdicts(rules, host, max_rate).filter("NOT host_ok").select(F.col(host).alias(bad)))
    size = rejected.agg(F.sum(F.octet_length(F.col(bad).cast("string")) + 16)).first()[0] or 0
    if size <= MOST_BROADCAST:
        j = rules.join(F.broadcast(rejected), rules[host] == rejected[bad], "left")
    else:
        many = rejected.withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rules.withColumn(salt, F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        j = salted.join(many, (salted[host] == many[bad]) & (salted[salt] == many["of"]), "left").drop(many["of"]).drop(salt)
    return j.withColumn("kept", ~F.col("base_failed") & F.col(bad).isNull()).drop(bad)


def judge_documents(docs: DataFrame, host: str = "source", max_rate: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` without the text, with the rules of ``text_rules`` and ``kept``.

    A document is kept if it passes the base rules and its host is not
    rejected; a document without a host is judged by the base rules alone.
    Repeated rows count as often as they occur; null and empty texts fail the
    base rules; columns called like a result give way to it; an empty table
    gives no rows.
    """
    return _with_verdict(written(text_rules(docs, text)), host, max_rate)


def passing_documents(docs: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judge_documents`` keeps, in the same columns, whatever their names."""
    row = F.struct([F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rules = text_rules(docs.select(row, F.col(host).alias("host"), F.col("text").alias("text")))
    return _with_verdict(written(rules.select("row", "host", "base_failed")), "host", max_rate).filter("kept").select("row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return judge_documents(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), windows AS (
  SELECT doc_id, i, list_aggregate(words[i:i+4], 'string_agg', ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) > 5)
), repeated AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows
), covered AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM repeated WHERE n > 1)
  GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), rules AS (
  SELECT d.doc_id, d.source, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM rules
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM judged WHERE source IS NOT NULL GROUP BY source
), moments AS (
  SELECT avg(f / n) AS mean, coalesce(var_pop(f / n), 0) AS var, avg(1 / n) AS inv_n FROM hosts
), prior AS (
  SELECT mean, least(1000.0, greatest(2.0, mean * (1 - mean) / greatest(1e-6, var - mean * (1 - mean) * inv_n) - 1)) AS strength
  FROM moments
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce((h.f + mean * strength) / (h.n + strength) <= 0.5, true) AS kept
FROM judged j LEFT JOIN hosts h ON j.source = h.source CROSS JOIN prior
"""
