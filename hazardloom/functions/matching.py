"""Pattern banks as Column expressions.

A bank is plain data: category -> patterns. The generators below turn it into
literal-pattern expressions, so tagging is one narrow projection and every
regex is compiled once per task.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import lru_cache, reduce
from re import _constants as op
from re import _parser
from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardloom.functions.text import SENTENCE_BODY, around, bound, distinct_ignoring_case

Bank = Mapping[str, Sequence[str]]


def unicode_word(pattern: str) -> str:
    """Word boundaries and classes follow Unicode on every Java version."""
    return "(?U)" + begun(pattern)


def any_case(pattern: str) -> str:
    return "(?iU)" + begun(pattern, True)


def _first(sequence) -> tuple[set[str], bool] | None:
    """Characters and classes that a match of a parsed sequence may begin with, and whether it may be empty; None when unknown."""
    found: set[str] = set()
    for kind, arg in sequence:
        if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            continue
        if kind is op.LITERAL and chr(arg).isascii() and chr(arg).isalnum():
            return found | {chr(arg)}, False
        if kind is op.IN and arg == [(op.CATEGORY, op.CATEGORY_DIGIT)]:
            return found | {r"\d"}, False
        if kind is op.SUBPATTERN and not arg[1] and not arg[2]:
            inner = _first(arg[3])
        elif kind is op.BRANCH:
            options = [_first(option) for option in arg[1]]
            inner = None if None in options else (set().union(*[o[0] for o in options]), any(o[1] for o in options))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            inner = _first(arg[2])
            inner = inner and (inner[0], inner[1] or arg[0] == 0)
        else:
            return None
        if inner is None:
            return None
        found |= inner[0]
        if not inner[1]:
            return found, False
    return found, True


def _bounded(sequence) -> bool:
    """Whether every match of a parsed sequence begins with a word boundary."""
    for kind, arg in sequence:
        if kind is op.AT:
            return arg is op.AT_BOUNDARY
        if kind is op.SUBPATTERN:
            return _bounded(arg[3])
        return kind is op.BRANCH and all(_bounded(option) for option in arg[1])
    return False


#: Characters of ASCII words, each by itself: a class of single characters is one table look-up, one of ranges is several times slower.
ASCII_WORD = ascii_letters + digits + "_"

# Characters beside the upper-case letter that a pattern without case takes for a letter.
ALSO = {"i": "\u0131\u0130", "k": "\u212a", "s": "\u017f"}


@lru_cache(maxsize=None)
def begun(pattern: str, any_case: bool = False) -> str:
    """The pattern behind tests of the first character and the one before, far cheaper than a Unicode word boundary; same matches."""
    if "(?i" in pattern:
        return pattern
    parsed = _parser.parse(pattern)
    first = _first(parsed)
    if first is None or first[1]:
        return pattern
    chars = "".join(c + (c.upper() + ALSO.get(c.lower(), "") if any_case and c.isalpha() else "") for c in sorted(first[0]))
    before = f"(?<![{ASCII_WORD}])" if _bounded(parsed) else ""
    test = f"(?=[{chars}]){before}"
    return (f"(?-i:{test})" if any_case else test) + f"(?:{pattern})"


def staged(column: Column) -> Column:
    """The same column, computed where it stands. The test is always true, but as the optimizer
    may not move it, filters and projections above refer to the result instead of carrying
    copies of every regex below them. Filter on plain columns before tagging, not after."""
    return F.when(F.spark_partition_id() >= 0, column)


def _groups(sequence, edge: bool = False) -> list[list[tuple[str, bool]]]:
    """Groups of literals of a parsed pattern; a match contains at least one word of every group. The second field says whether the
    word then stands right behind a word boundary; `edge`: the sequence does."""
    groups: list[list[tuple[str, bool]]] = []
    run, begun_ = "", False

    def flush() -> None:
        nonlocal run
        if len(run) > 1:
            groups.append([(run, begun_ and run[0].isascii() and (run[0].isalnum() or run[0] == "_"))])
        run = ""

    for kind, arg in sequence:
        if kind is op.LITERAL:
            if not run:
                begun_ = edge
            run += chr(arg).lower()
        elif kind is op.AT:
            edge = arg is op.AT_BOUNDARY
            continue
        elif kind is op.SUBPATTERN:
            flush()
            groups += _groups(arg[3], edge)
        elif kind is op.BRANCH:
            flush()
            options = [_groups(option, edge) for option in arg[1]]
            if all(options):
                groups.append([w for o in options for w in min(o, key=lambda g: (len(g), -min(len(x) for x, _ in g)))])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            flush()
            if arg[0] > 0:
                groups += _groups(arg[2], edge)
        else:
            flush()
        edge = False
    flush()
    return groups


@lru_cache(maxsize=None)
def required_words(pattern: str) -> tuple[tuple[str, ...], ...]:
    return tuple(tuple(dict.fromkeys(w for w, _ in g)) for g in _groups(_parser.parse(pattern)))


@lru_cache(maxsize=None)
def listed_words(pattern: str) -> tuple[tuple[tuple[str, bool], ...], ...]:
    """The groups that guard a pattern: those whose words all stand behind a word boundary, which one cheap pass finds; all groups
    where there is none such."""
    groups = [tuple(dict.fromkeys(g)) for g in _groups(_parser.parse(pattern))]
    return tuple([g for g in groups if all(edge for _, edge in g)] or groups)


def may_hit(low: Column, pattern: str) -> Column | None:
    """Necessary condition by plain substring search over lower-cased text, or None. It is
    about fifteen times cheaper than the regex, which then runs only where it can hit."""
    groups = [reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w, _ in g]) for g in listed_words(pattern)]
    return reduce(lambda a, b: a & b, groups) if groups else None


def _tree(words: Iterable[str]) -> str:
    """A regex for the longest of the words that stands at a place, branching by character."""
    branches: dict[str, set[str]] = {}
    for w in words:
        if w:
            branches.setdefault(w[0], set()).add(w[1:])
    options = []
    for c, rest in sorted(branches.items()):
        tail = _tree(rest)
        if "" in rest or len({w[0] for w in rest}) > 1:
            tail = tail and f"(?:{tail})" + ("?" if "" in rest else "")
        options.append((c if c.isalnum() else "\\" + c) + tail)
    return "|".join(options)


def _standing(low: Column, words: set[str]) -> Column:
    """The longest of the words that stands at a place, for every place of a text."""
    starts = "".join(sorted({w[0] if w[0].isalnum() else "\\" + w[0] for w in words}))
    return F.regexp_extract_all(low, F.lit(f"(?=[{starts}])(?=({_tree(words)}))"), 1)


def seen_words(low: Column, patterns: Iterable[str]) -> Column:
    """Words required by the patterns that stand in lower-cased text, one a line, found in one pass over it. A required word is
    a substring of the text exactly if it is one of these lines: at its place the longest word that stands there begins with it."""
    words = {w for p in patterns for g in required_words(p) for w in g}
    return F.array_join(F.array_distinct(_standing(low, words)), "\n") if words else F.lit("")


def begun_words(low: Column, patterns: Iterable[str]) -> Column:
    """As `seen_words` for what `may_hit` asks: a word that a match has behind a word boundary is looked for only there, so most
    characters cost one test."""
    listed = {w for p in patterns for g in listed_words(p) for w in g}
    free = {w for w, edge in listed if not edge}
    begun_ = {w for w, _ in listed} - free
    if not begun_:
        return seen_words(low, patterns)
    found = F.regexp_extract_all(F.concat(F.lit(" "), low), F.lit(f"[^{ASCII_WORD}](?=({_tree(begun_)}))"), 1)
    return F.array_join(F.array_distinct(F.concat(found, _standing(low, free)) if free else found), "\n")


def bank_patterns(*banks) -> list[str]:
    """Patterns of banks: lists of (label, pattern, ...) or category -> patterns."""
    found: list[str] = []
    for bank in banks:
        for entry in bank.values() if isinstance(bank, Mapping) else bank:
            found += entry[1:] if isinstance(entry, tuple) else entry
    return found


def hits(low: Column, pattern: str, seen: Column | None = None) -> Column:
    """Whether the pattern hits lower-cased text. Here and below, `seen` is the text's `begun_words` or
    `seen_words`, searched instead of the text for the words that a hit needs."""
    guard = may_hit(low if seen is None else seen, pattern)
    found = low.rlike(unicode_word(pattern))
    return found if guard is None else guard & found


def hit_text(low: Column, pattern: str, seen: Column | None = None) -> Column:
    """Matched text of the first hit in lower-cased text, null without one."""
    guard = may_hit(low if seen is None else seen, pattern)
    found = F.nullif(F.regexp_extract(low, unicode_word(pattern), 0), F.lit(""))
    return found if guard is None else F.when(guard, found)


def any_of(text: Column, patterns: Iterable[str], seen: Column | None = None) -> Column:
    """True when a pattern hits lower-cased text; OR stops at the first one."""
    return reduce(lambda a, b: a | b, [hits(text, p, seen) for p in patterns])


def first_hit(text: Column, patterns: Iterable[str], seen: Column | None = None) -> Column:
    """Matched text of the first pattern that hits, in the order of the list."""
    return F.coalesce(*[hit_text(text, p, seen) for p in patterns])


def all_terms(text: Column, patterns: Iterable[str], seen: Column | None = None) -> Column:
    """One matched text per pattern that hits."""
    return F.array_compact(F.array(*[hit_text(text, p, seen) for p in patterns]))


def count_patterns(text: Column, patterns: Iterable[str], seen: Column | None = None) -> Column:
    return reduce(lambda a, b: a + b, [hits(text, p, seen).cast("int") for p in patterns])


def categories(text: Column, bank: Bank, seen: Column | None = None) -> Column:
    """Array of (category, evidence) for every category that hits, by category name."""
    pairs = [F.struct(F.lit(c).alias("category"), first_hit(text, bank[c], seen).alias("evidence")) for c in sorted(bank)]
    return F.filter(F.array(*pairs), lambda x: x.evidence.isNotNull())


def names(hits: Column) -> Column:
    return F.transform(hits, lambda x: x.category)


def evidence_of(hits: Column, category: str) -> Column:
    return F.get(F.filter(hits, lambda x: x.category == category), F.lit(0)).evidence


def render_names(hits: Column) -> Column:
    return F.array_join(names(hits), " | ")


def render_evidence(hits: Column) -> Column:
    return F.array_join(F.transform(hits, lambda x: F.concat(x.category, F.lit(": "), x.evidence)), " | ")


def has_any_name(hits: Column, wanted: Iterable[str]) -> Column:
    return F.arrays_overlap(names(hits), F.array(*[F.lit(w) for w in sorted(wanted)]))


def located_hits(text: Column, pattern: str) -> Column:
    """Every occurrence as (evidence, at): the matched text and its 1-based position."""
    before = F.transform(F.split(text, pattern, -1), F.length)
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"), before.alias("before"))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("starts"))

    def placed(x: Column) -> Column:
        gaps = F.slice(x["before"], 1, F.size(x["found"]))
        starts = F.aggregate(
            F.arrays_zip(gaps.alias("gap"), F.transform(x["found"], F.length).alias("width")),
            start,
            lambda acc, x: F.struct(
                (acc.next + x.gap + x.width).alias("next"),
                F.concat(acc.starts, F.array(acc.next + x.gap)).alias("starts"),
            ),
            lambda acc: acc.starts,
        )
        return F.zip_with(x["found"], starts, lambda e, at: F.struct(e.alias("evidence"), at.alias("at")))

    return bound(parts, placed)


def occurrences(text: Column, low: Column, pattern: str) -> Column:
    """All matched texts in the spelling of the text; low is its lower-cased form, or that form's `begun_words`."""
    guard = may_hit(low, pattern)
    found = F.regexp_extract_all(text, F.lit(any_case(pattern)), 0)
    return found if guard is None else F.when(guard, found).otherwise(F.array().cast("array<string>"))


def sentence_offsets(text: Column) -> Column:
    """Array of (start, stop, sentence): half-open character offsets of each trimmed sentence."""

    def placed(x: Column) -> Column:
        body = x["evidence"]
        begin = x["at"] - 1
        return F.struct(
            (begin + F.length(body) - F.length(F.ltrim(body))).alias("start"),
            (begin + F.length(F.rtrim(body))).alias("stop"),
            F.trim(body).alias("sentence"),
        )

    return F.filter(F.transform(located_hits(text, SENTENCE_BODY), placed), lambda x: x.sentence != "")


NUMBER = r"(?<![a-z])(\d+(?:[.,]\d+)?)"


def max_number_near(text: Column, cue: str, reach: int = 45) -> Column:
    """Largest number within reach characters of any hit of the cue, null without one."""

    def numbers(place: Column) -> Column:
        return F.regexp_extract_all(around(text, place["at"], F.length(place["evidence"]), reach), F.lit(NUMBER), 1)

    found = F.flatten(F.transform(located_hits(text, unicode_word(cue)), numbers))
    return F.array_max(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double")))


def collect_hits(text: Column, low: Column, bank: Sequence[tuple[str, str]], cap: int) -> Column:
    """Array of (label, evidence): all occurrences in bank order, distinct per label without
    case, cut to cap over the whole bank, so early labels can starve later ones."""

    def of(label: str, pattern: str) -> Column:
        fresh = distinct_ignoring_case(F.transform(occurrences(text, low, pattern), lambda x: F.trim(x)))
        return F.transform(fresh, lambda x: F.struct(F.lit(label).alias("label"), x.alias("evidence")))

    return F.slice(F.flatten(F.array(*[of(label, p) for label, p in bank])), 1, cap)


def longest_per_label(items: Column, labels: Sequence[str]) -> Column:
    """One (label, evidence) per label, the longest evidence; the first one wins a tie."""

    def of(label: str) -> Column:
        mine = F.filter(items, lambda x: x.label == label)
        best = F.array_max(F.transform(mine, lambda x: F.length(x.evidence)))
        return F.get(F.filter(mine, lambda x: F.length(x.evidence) == best), F.lit(0))

    return F.filter(F.array(*[of(x) for x in labels]), lambda x: x.isNotNull())


def gated(hits_by_name: Sequence[tuple[str, Column, Column]]) -> Column:
    """Array of (category, evidence) of those entries whose gate holds and whose evidence exists."""
    pairs = [
        F.struct(F.lit(name).alias("category"), F.when(gate, evidence).alias("evidence"))
        for name, gate, evidence in hits_by_name
    ]
    return F.filter(F.array(*pairs), lambda x: x.evidence.isNotNull())
