"""Scalar text, list, id and number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK_RUN = r"(?U)\s+"
PUNCTUATION = r"(?U)[^\w\s]"
SENTENCE_BREAK = r"(?<=[.!?;])\s+|\n+"
SENTENCE_BODY = r"(?md)[^.!?\n]+(?:[.!?]+|$)"  # $ also stands before a line break, and only before \n

# Severity levels in rising order.
LEVELS = ["I", "II", "III", "IV", "V", "VI"]

# Stop words of the audit token sets, current and first generation.
STOP_WORDS = [
    "the", "and", "with", "from", "was", "were", "that", "this", "worker", "person", "employee", "operator",
    "incident", "during", "while", "his", "her", "their", "into", "onto", "near", "due", "because", "which", "when",
    "then", "after", "before", "a", "an", "of", "to", "in", "on", "for", "at", "by", "as", "is", "are",
]
FIRST_STOP_WORDS = [
    "the", "and", "that", "with", "from", "this", "were", "was", "when", "while", "into", "onto", "near", "worker",
    "employee", "operator", "collaborator", "personnel", "during", "performed", "performing", "activity", "work",
    "working", "area", "event", "injury", "injured", "causing", "cause", "caused", "could", "would", "also", "used",
    "use", "made", "make", "at", "of", "to", "in", "on", "a", "an", "for", "by", "is", "are", "be", "as", "or",
    "their", "his", "her", "its", "had", "has", "have", "not", "no", "one", "two", "three", "all", "very", "more",
]


def squeeze(c: Column) -> Column:
    """Collapse every run of Unicode blanks to one space and trim."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), BLANK_RUN, " "))


def norm(c: Column) -> Column:
    return F.lower(squeeze(c))


def norm_for_matching(c: Column) -> Column:
    """Key of the duplicate search; blanks collapse before punctuation goes, so inner double blanks stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), BLANK_RUN, " "), PUNCTUATION, ""))


def norm_key(c: Column) -> Column:
    """Trim and lower after turning no-break spaces into plain ones."""
    return F.lower(F.trim(F.translate(F.coalesce(c, F.lit("")), " ", " ")))


# Blanks at the ends of a text.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.btrim(c, F.lit(BLANKS))


def clean(c: Column) -> Column:
    """Trimmed text, null when blank."""
    return F.nullif(strip(c), F.lit(""))


def clean_or_empty(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def split_list(c: Column, separator: str = ";") -> Column:
    """Trimmed non-blank parts; null text gives an empty array."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), separator), strip)
    return F.filter(parts, lambda x: x != "")


def tokens(c: Column) -> Column:
    """Parts between '|' or ',' without blanks and the text 'nan'."""
    return F.filter(split_list(c, r"[|,]"), lambda x: F.lower(x) != "nan")


def zero_padded(digits: Column, width: int = 6) -> Column:
    """Digits filled up with zeros; longer ones stay whole."""
    return F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0"))


def padded_id(prefix: str, number: Column, width: int = 6) -> Column:
    return F.concat(F.lit(prefix), zero_padded(number.cast("string"), width))


def normalise_id(c: Column) -> Column:
    """'17', '17.0' or 'x_000017' to '000017'."""
    digits = F.regexp_extract(F.trim(c.cast("string")), r"(\d+)(?:\.0)?$", 1)
    return F.when(digits != "", zero_padded(digits))


def lenient_timestamp(c: Column) -> Column:
    """ISO text of a parseable timestamp, else null."""
    return F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd'T'HH:mm:ss")


def lenient_double(c: Column) -> Column:
    return c.try_cast("double")


def is_one(c: Column) -> Column:
    """A 0/1 signal read leniently: anything that is not 1 counts as absent."""
    return F.coalesce(c.try_cast("int") == 1, F.lit(False))


def level_number(c: Column) -> Column:
    """I..VI to 1..6, anything else null."""
    position = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.upper(F.trim(c)))
    return F.nullif(position, F.lit(0)).cast("int")


def severity_band(level: Column) -> Column:
    return (
        F.when(level <= 2, "low").when(level == 3, "medium").when(level == 4, "high").when(level >= 5, "very_high")
        .otherwise("unknown")
    )


def first_non_blank(*cols: Column) -> Column:
    return F.coalesce(*[clean(c) for c in cols])


def label_text(c: Column) -> Column:
    return F.upper(F.trim(c))


def binary_label(c: Column) -> Column:
    text = label_text(c)
    return F.when(text == "YES", 1).when(text == "NO", 0)


def bound(column: Column, body) -> Column:
    """body over the column's value, which is computed once. An expression that a body names several times, or within a lambda
    function, is computed again at each place and for each element."""
    return F.get(F.transform(F.array(column), body), F.lit(0))


def distinct_ignoring_case(items: Column) -> Column:
    """Distinct strings in first-seen order and spelling, compared without case."""

    def fresh(pair: Column) -> Column:
        return F.filter(pair["items"], lambda x, i: F.array_position(pair["lowered"], F.lower(x)) == i + 1)

    return bound(items, lambda x: bound(F.struct(x.alias("items"), F.transform(x, F.lower).alias("lowered")), fresh))


def join_unique(items: Column, separator: str = "; ") -> Column:
    kept = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(distinct_ignoring_case(kept), separator)


def sentences(c: Column) -> Column:
    """Sentences with their terminators, stripped of blanks, bullets and dashes."""
    parts = F.split(F.coalesce(c, F.lit("")), SENTENCE_BREAK)
    return F.filter(F.transform(parts, lambda s: F.btrim(s, F.lit(" -•\t"))), lambda s: s != "")


def token_set(c: Column) -> Column:
    """Distinct lower-case words of three characters or more without stop words."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " ")
    words = F.filter(F.split(plain, r"\s+"), lambda w: F.length(w) >= 3)
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in STOP_WORDS]))


def first_token_set(c: Column) -> Column:
    """First generation: words may hold hyphens and must start with a letter."""
    words = F.regexp_extract_all(norm_key(c), F.lit(r"[a-z][a-z0-9-]{2,}"), 0)
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in FIRST_STOP_WORDS]))


def token_recall(wanted: Column, found: Column) -> Column:
    """Share of the wanted tokens that were found; zero when either set is empty."""
    return share(F.size(F.array_intersect(wanted, found)), F.size(wanted))


def jaccard(a: Column, b: Column) -> Column:
    return share(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def share(part: Column, whole: Column) -> Column:
    """part / whole, zero when the whole is empty."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.lit(100.0) * part / whole)


def word_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"(?U)\w++"))


def max_number(c: Column, pattern: str) -> Column:
    """Largest number captured by group 1; a decimal comma counts as a point."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), 1)
    return F.array_max(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double")))


def around(text: Column, at: Column, width: Column, reach: int) -> Column:
    """The text from reach characters before position at (1-based) to reach after the hit."""
    begin = F.greatest(at - reach, F.lit(1))
    return F.substring(text, begin, at - begin + width + reach)


def context_snippet(c: Column, patterns: list[str], reach: int = 90) -> Column:
    """Squeezed context of the first pattern that hits, in pattern order."""
    text = F.coalesce(c, F.lit(""))

    def one(p: str) -> Column:
        at = F.regexp_instr(text, F.lit(p))
        return F.when(at > 0, squeeze(around(text, at, F.length(F.regexp_extract(text, p, 0)), reach)))

    return F.coalesce(*[one(p) for p in patterns])


def short_hash(c: Column, prefix: str = "derived_") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(c, 256), 1, 16))
