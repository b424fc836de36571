"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one long whose
bit i says that rule i failed; versioned policies are masks over those bits, so changing a policy
or asking what a rule costs never reads a text again.

Defined results: a null or empty text has no words and measures 0; rows with equal ids stay
separate rows; an empty table gives an empty ledger; other columns of the input, whatever
their names, are neither read nor returned; a null doc_id stays null."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardloom.llm.common import load, staged

# The characters between words, and the symbols counted.
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"


@dataclass(frozen=True)
class Rule:
    """A document fails the rule where `failed` holds over the measurements."""

    name: str
    failed: str


@dataclass(frozen=True)
class Policy:
    """Documents that fail one of the named rules are rejected."""

    version: str
    rules: tuple[str, ...]


RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "n_symbols * 10 > n_words"),
    Rule("duplicate_lines", "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines"),
    Rule("short_words", "n_words > 0 and word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("upper_case", "n_upper * 10 > 3 * word_chars"),
    Rule("exclamations", "n_exclaims * 10 > 3 * n_words"),
    Rule("no_letters", "n_words > 0 and n_letters * 2 < word_chars"),
)
BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = (
    BASE,
    Policy("v1", (*BASE.rules, "symbols", "duplicate_lines")),
    Policy("v2", tuple(r.name for r in RULES)),
)


def _pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later expressions read as values: the optimizer would otherwise copy the
    expressions into each use, and into lambdas once per element."""
    row = F.struct(*df.columns, *[c.alias(n) for n, c in columns.items()])
    return df.select(F.inline(F.array(row)))


def measurements(docs: DataFrame) -> DataFrame:
    """doc_id and what the rules look at, all long.

    n_words and word_chars (code points in words); n_symbols; n_lines (lines with a word) and
    n_dup_lines (those equal to an earlier one); n_repeat_words; n_upper, n_letters, n_exclaims."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = _pinned(rows, words=F.filter(F.split("text", BLANKS), lambda w: w != ""), lines=F.filter(F.split("text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")))
    # windows sorted by hash: one that occurs twice or more is equal to a neighbour
    windows = F.expr("""
        case when size(words) >= 4 then transform(sequence(1, size(words) - 2),
            i -> named_struct('h', xxhash64(words[i - 1], words[i], words[i + 1]), 'i', i)) else array() end""")
    rows = _pinned(rows.withColumn("n_words", F.size("words")), windows=F.array_sort(windows))
    twice = F.expr("""filter(windows, (x, i) -> (i > 0 and windows[greatest(i - 1, 0)].h = x.h)
        or (i + 1 < size(windows) and windows[least(i + 1, size(windows) - 1)].h = x.h))""")
    rows = _pinned(rows, twice=twice)
    covered = F.expr("size(array_distinct(flatten(transform(twice, x -> array(x.i, x.i + 1, x.i + 2)))))")
    count = lambda pattern: F.length(F.regexp_replace("text", pattern, ""))
    return rows.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        count(BLANKS).cast("long").alias("word_chars"),
        count(SYMBOLS).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        count(r"[^\p{Lu}]+").cast("long").alias("n_upper"),
        count(r"[^\p{L}]+").cast("long").alias("n_letters"),
        count(r"[^!]+").cast("long").alias("n_exclaims"),
    )


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measurements and `failed_bits`; at most 63 rules."""
    if len(rules) > 63:
        raise ValueError("a ledger holds 63 rules")
    bits = [F.when(F.expr(r.failed), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)]
    return measurements(docs).withColumn("failed_bits", reduce(lambda a, b: a.bitwiseOR(b), bits))


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    at = {r.name: i for i, r in enumerate(rules)}
    return reduce(or_, (1 << at[n] for n in policy.rules), 0)


def rejected(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(mask(policy, rules))) != 0


def with_policies(book: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds kept_<version> for each policy."""
    return book.withColumns({f"kept_{p.version}": ~rejected(p, rules) for p in policies})


def ablations(book: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: documents that fail it, and documents that only it rejects (they would be
    kept without the rule). Documents are first counted by their failure bits, of which there are few."""
    whole = mask(policy, rules)
    counts = book.groupBy(F.col("failed_bits").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    bit = {r.name: 1 << i for i, r in enumerate(rules)}
    table = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(bit[n]).cast("long").alias("bit")) for n in policy.rules])
    return (
        counts.select("bits", "n", F.inline(table))
        .groupBy("rule")
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
    )


def failing_any(book: DataFrame) -> DataFrame:
    """Bits that some document fails, and bits that every document fails."""
    return book.agg(F.bit_or("failed_bits").alias("some"), F.bit_and("failed_bits").alias("every"))


def op5(docs: DataFrame, policy: Policy = POLICIES[-1]) -> DataFrame:
    """Per document the measurements, the failure bits, base_failed, the policy's verdict and those of all versions, and, where a
    single rule of the policy rejects the document, its name and how many documents are kept without it. The ledger is stored, so
    texts are read once for all of this."""
    book = staged(ledger(docs), "ledger")
    base, own = rejected(BASE), F.col("failed_bits").bitwiseAND(F.lit(mask(policy)))
    rows = with_policies(book).withColumn("base_failed", base).withColumn("kept", ~(base | rejected(policy)))
    names = reduce(lambda x, n: x.when(own == mask(Policy("", (n,))), n), policy.rules, F.when(F.lit(False), ""))
    freed = ablations(book, policy).select(F.col("rule").alias("only_rule"), F.col("n_only").alias("n_freed"))
    # as many rows as the policy has rules
    return rows.withColumn("only_rule", names).join(F.broadcast(freed), "only_rule", "left").select(*rows.columns, "only_rule", "n_freed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5(load(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH parts AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM parts WHERE len(words) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n >= 2),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) t(k) GROUP BY doc_id),
m AS (
  SELECT p.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '[^\p{Lu}]', '', 'g'))::BIGINT AS n_upper,
    length(regexp_replace(text, '[^\p{L}]', '', 'g'))::BIGINT AS n_letters,
    length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_exclaims
  FROM parts p LEFT JOIN covered c ON p.doc_id = c.doc_id),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN n_symbols * 10 > n_words THEN 4 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 16 ELSE 0 END
    + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
    + CASE WHEN n_upper * 10 > 3 * word_chars THEN 64 ELSE 0 END
    + CASE WHEN n_exclaims * 10 > 3 * n_words THEN 128 ELSE 0 END
    + CASE WHEN n_words > 0 AND n_letters * 2 < word_chars THEN 256 ELSE 0 END)::BIGINT AS failed_bits
  FROM m)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failed_bits = 0 AS kept,
  failed_bits & 3 = 0 AS kept_base, failed_bits & 15 = 0 AS kept_v1, failed_bits = 0 AS kept_v2,
  CASE failed_bits WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'symbols' WHEN 8 THEN 'duplicate_lines' WHEN 16 THEN 'short_words'
    WHEN 32 THEN 'long_words' WHEN 64 THEN 'upper_case' WHEN 128 THEN 'exclamations' WHEN 256 THEN 'no_letters' END AS only_rule,
  CASE WHEN failed_bits IN (1, 2, 4, 8, 16, 32, 64, 128, 256) THEN count(*) OVER (PARTITION BY failed_bits) END AS n_freed
FROM b
"""
