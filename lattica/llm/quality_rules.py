"""Quality rules as a bitmask ledger, in DataFrame operations alone.

Every rule is evaluated once per document and leaves one bit, together with the measurements it read. A
policy is a named, versioned mask of rules; applying it is one bitwise test, and ablations (how many documents each
rule alone would drop, and how many only it drops) are aggregates over the stored bits, without the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import WORD

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_alpha_words")

#: Rules in bit order: (name, SQL over the measurements that is true where a document fails).
RULES: tuple[tuple[str, str], ...] = (
    ("too_short", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("dup_lines", "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "n_words > 0 and word_chars < 2 * n_words"),
    ("long_words", "word_chars > 18 * n_words"),
    ("shouting", "100 * n_upper > 50 * word_chars"),
    ("few_letters", "100 * n_alpha_words < 60 * n_words"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version of the rules that drop a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", ("too_short", "repeated_windows"))
POLICIES = {p.version: p for p in (BASE, Policy("v1", ("too_short", "repeated_windows", "symbols", "dup_lines")), Policy("v2", tuple(BIT)))}


def measure(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as (doc_id, measurements). Null text: as empty, every measurement 0.

    A window of three words counts as found twice by the XXH64 of its words. Its positions are sorted by
    hash within the row, and only where a row has any repeated window at all.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id"), text.alias("t"))
    words = base.withColumn("w", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    words = words.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)))
    first = words.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("t", F.lit(r"\p{L}+[^\x20\x09-\x0D]*")).cast("long").alias("n_alpha_words"),
        F.when(F.size("w") > 3, F.expr("transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))")).alias("h"),
    )
    second = first.withColumn("repeats", F.coalesce(F.size("h") > F.size(F.array_distinct("h")), F.lit(False)))
    # positions of windows found twice or more: neighbours by hash
    found = """
      transform(array(sort_array(transform(h, (x, i) -> struct(x as x, i as i)))), s ->
        sort_array(transform(filter(transform(s, (e, k) -> struct(e.i as i,
          (k > 0 and s[greatest(k - 1, 0)].x = e.x) or (k < size(s) - 1 and s[least(k + 1, size(s) - 1)].x = e.x) as d)), e -> e.d), e -> e.i)))[0]"""
    # words covered: each window adds three, less what the next one covers too
    covered = "aggregate(transform(p, (x, k) -> if(k = size(p) - 1, 3, least(3, p[least(k + 1, size(p) - 1)] - x))), 0L, (a, x) -> a + x)"
    third = second.withColumn("p", F.when(F.col("repeats"), F.expr(found)))
    return third.withColumn("n_repeat_words", F.when(F.col("repeats"), F.expr(covered)).otherwise(F.lit(0)).cast("long")).select("doc_id", *MEASURES)


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements, fails): bit k of ``fails`` is set where rule k fails.

    Empty and null texts fail too_short; repeated rows give repeated rows; an empty table an empty ledger.
    """
    bits: Column = F.lit(0)
    for name, condition in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(condition), BIT[name]).otherwise(0))
    return measure(docs).withColumn("fails", bits.cast("long"))


def apply_policy(book: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``kept`` under a policy."""
    return book.withColumn("kept", F.col("fails").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(book: DataFrame, policy: Policy) -> DataFrame:
    """One row per rule of a policy: (version, rule, fails, only): documents that fail it, and that fail it alone."""
    masked = F.col("fails").bitwiseAND(F.lit(policy.mask))
    counts = book.groupBy(masked.alias("bits")).agg(F.count("*").alias("n"))  # 2 ** rules rows at most
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit")) for r in policy.rules])).alias("r")
    each = counts.select("bits", "n", rule).select("bits", "n", "r.rule", "r.bit")
    fails = F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n"))), F.lit(0)).alias("fails")
    only = F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("only")
    return each.groupBy(F.lit(policy.version).alias("version"), "rule").agg(fails, only)


RULES_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
m AS (
  SELECT k, doc_id, w, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(regexp_extract_all(t, '\p{Lu}'))::BIGINT AS n_upper, len(regexp_extract_all(t, '\p{L}+[^\x20\x09-\x0D]*'))::BIGINT AS n_alpha_words FROM w),
win AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM m WHERE len(w) >= 3)),
dup AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT k, count(DISTINCT p)::BIGINT AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY k),
b AS (SELECT m.*, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN rep USING (k)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words OR (n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines) OR (n_words > 0 AND word_chars < 2 * n_words)
    OR word_chars > 18 * n_words OR 100 * n_upper > 50 * word_chars OR 100 * n_alpha_words < 60 * n_words) AS kept
FROM f
"""
