"""Text and term-list functions. All are plain column expressions, so they run inside the JVM on any plan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom import fixed_values as fv

UNICODE = "(?U)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strings(values: Iterable[str]) -> Column:
    """A literal array of strings that keeps its type when it is empty."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def empty_if_null(c: Column | str) -> Column:
    """Empty is the null of list columns."""
    return F.coalesce(_col(c), strings([]))


def member_of(c: Column, values: Iterable[str]) -> Column:
    return c.isin(list(values))


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


# ---- T1 to T5: single values ------------------------------------------------------------------------------------

def squash(c: Column | str) -> Column:
    """Null to empty, every whitespace run to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), fv.WHITESPACE + "+", " "))


#: A class of single characters below 256 is one bit set to the regex engine; with ranges it is tried range by range, which
#: takes ten times as long over whole texts. Upper case is kept, so that only what is left has to be lower-cased.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEPT = LETTERS + "0123456789+#./"
KEPT_OR_SPLIT = KEPT + ",;|\\n"  # the slash splits lists as well


def _kept(c: Column | str, kept: str) -> Column:
    """Runs of other characters to one blank, lower case. The two letters beyond ASCII that have ASCII in their lower case go first."""
    text = F.replace(F.coalesce(_col(c), F.lit("")), F.lit("\u0130"), F.lit("i\u0307"))
    text = F.replace(text, F.lit("\u212a"), F.lit("k"))
    return F.lower(F.regexp_replace(text, f"[^{kept}]++", " "))


def skill(c: Column | str) -> Column:
    """Lower case; only a-z 0-9 + # . / and single blanks stay; blanks and dots at the ends go.

    One pass does it: whitespace lies outside the kept class, so a run of dropped characters is one blank.
    """
    return F.btrim(_kept(c, KEPT), F.lit(" .,:;"))


def canonical_of(term: Column) -> Column:
    """Alias lookup for a term that is already normalised."""
    return F.coalesce(F.element_at(literal_map(fv.SKILL_ALIASES), term), term)


def canonical(c: Column | str) -> Column:
    return canonical_of(skill(c))


def canonical_each(values: Column | str) -> Column:
    """Each element canonical; in two passes, as a lambda with the alias lookup alone would normalise an element twice."""
    return F.transform(F.transform(_col(values), skill), canonical_of)


def canonical_terms(terms: Column) -> Column:
    """Elements that are already normalised, by their aliases."""
    return F.transform(terms, canonical_of)


def listed(c: Column | str) -> Column:
    """``split_list`` with every element normalised. The text is cleaned as a whole, as no element holds a character to split at."""
    return F.transform(F.split(_kept(c, KEPT_OR_SPLIT), fv.LIST_SPLIT), lambda x: F.btrim(x, F.lit(" .")))


def token_set(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(canonical(c), F.lit("[a-z0-9+#./]+"), F.lit(0)))


# ---- T3, T6 to T9: lists ------------------------------------------------------------------------------------------

def split_list(c: Column | str) -> Column:
    return F.split(F.coalesce(_col(c), F.lit("")), fv.LIST_SPLIT)


def distinct_terms(terms: Column) -> Column:
    """Blanks dropped, first occurrences kept in order."""
    return F.array_distinct(F.filter(terms, lambda x: x != ""))


def normalised(values: Column, canonicalise: bool = False) -> Column:
    """Each element normalised, blanks dropped, first occurrences kept in order."""
    return distinct_terms(canonical_each(values) if canonicalise else F.transform(values, skill))


def split_tokens(c: Column | str) -> Column:
    return distinct_terms(listed(c))


def n_words(term: Column) -> Column:
    return F.size(F.split(term, " "))


def at_most(term: Column, words: int) -> Column:
    """``n_words(term) <= words`` without taking the term apart."""
    return F.substring_index(term, " ", words) == term


def phrases(c: Column | str, limit: int = 16, max_tokens: int = 6, canonicalise: bool = False) -> Column:
    """Short noise-free phrases of a text, in order, first ``limit``."""
    terms = canonical_terms(listed(c)) if canonicalise else listed(c)
    return short_terms(distinct_terms(terms), limit, max_tokens)


def short_terms(terms: Column, limit: int = 16, max_tokens: int = 6) -> Column:
    """Of normalised terms the first ``limit`` that are short and no noise."""
    return F.slice(F.filter(terms, lambda x: ~member_of(x, fv.SCORING_NOISE) & at_most(x, max_tokens)), 1, limit)


def skill_phrases(c: Column | str, limit: int = 16) -> Column:
    return phrases(c, limit, 5)


def score_phrases(c: Column | str, limit: int = 15, max_tokens: int = 4) -> Column:
    return phrases(c, limit, max_tokens, canonicalise=True)


def _role_aliases(term: Column) -> Column:
    for alias, full in fv.ROLE_ALIASES.items():
        term = F.regexp_replace(term, rf"\b{alias}\b", full)
    return term


def sanitise_terms(values: Column, limit: int | None = None, renormalise: bool = True) -> Column:
    """Job terms without role aliases, noise and non-skill phrases; ``renormalise`` is the scoring variant."""
    again = skill if renormalise else squash
    cleaned = F.transform(values, lambda v: again(_role_aliases(skill(v))))
    kept = F.array_distinct(
        F.filter(cleaned, lambda x: (x != "") & ~member_of(x, fv.NON_SKILL_PHRASES + fv.SCORING_NOISE))
    )
    return kept if limit is None else F.slice(kept, 1, limit)


def normal_set(values: Column) -> Column:
    """Distinct canonical terms without noise, sorted (the order of a set is not defined, so we define it)."""
    return sorted_terms(canonical_each(values))


def sorted_terms(terms: Column) -> Column:
    """Of canonical terms the distinct ones without noise, sorted. ``sort_array`` compares strings itself, where
    ``array_sort`` calls a comparison function per pair."""
    return F.sort_array(F.filter(distinct_terms(terms), lambda x: ~member_of(x, fv.SCORING_NOISE)))


def skill_like(values: Column) -> Column:
    """Drop noise and project labels such as 'chat app'."""
    return F.filter(
        normalised(values, True),
        lambda x: ~member_of(x, fv.SCORING_NOISE)
        & ~((n_words(x) >= 2) & member_of(F.substring_index(x, " ", -1), fv.PROJECT_TAIL_TOKENS)),
    )


def matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def keyword_set(title: Column, responsibilities: Column, domain_keywords: Column) -> Column:
    def words(text: Column, shortest: int) -> Column:
        found = matches(F.lower(text), "[a-z0-9+#]{%d,}" % shortest)
        return F.filter(found, lambda x: ~member_of(x, fv.STOPWORDS))

    parts = F.concat(words(title, 3), words(F.array_join(responsibilities, " "), 4), domain_keywords)
    return normal_set(parts)


def extract_terms(c: Column | str, limit: int = 30) -> Column:
    found = normalised(matches(_col(c), r"[a-zA-Z][a-zA-Z0-9+#.]{2,}"))
    return F.slice(F.filter(found, lambda x: ~member_of(x, fv.TERM_STOPWORDS)), 1, limit)


# ---- T13 to T21: cleaning -------------------------------------------------------------------------------------------

#: The same characters as in fixed_values, one by one.
BREAK = r"\r\n|[\n\x0b\f\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def lines_of(c: Column | str) -> Column:
    return F.split(F.coalesce(_col(c), F.lit("")), BREAK)


def clean_lines(values: Column) -> Column:
    return F.filter(F.transform(values, squash), lambda x: x != "")


def strip_space(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def clean_scan_text(c: Column | str) -> Column:
    text = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\r", "\n")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, fv.WHITESPACE + r"+([,.;:])", "$1")
    rows = F.transform(lines_of(text), lambda x: strip_space(F.regexp_replace(x, r"^[\-|\]\[()'`]+", "")))
    return F.array_join(F.filter(rows, lambda x: x != ""), "\n")


def compact(c: Column | str, limit: int = 240) -> Column:
    def shortened(text: Column) -> Column:
        cut = F.concat(F.rtrim(F.substring(text, 1, limit - 3), F.lit(" ,.;:")), F.lit("..."))
        return F.when(F.length(text) <= limit, text).otherwise(cut)

    return let(squash(c), shortened)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it inside lambdas (which would otherwise repeat it per element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def distinct_ignoring_case(values: Column) -> Column:
    def first_of_each(v: Column) -> Column:
        return let(
            F.transform(v, F.lower),
            lambda keys: F.filter(v, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1),
        )

    return let(values, first_of_each)


def unique_compact(values: Column, limit: int = 160) -> Column:
    """Compacted values, blanks dropped, first of each spelling kept."""
    return distinct_ignoring_case(F.filter(F.transform(values, lambda x: compact(x, limit)), lambda x: x != ""))


def sentence_join(values: Column, limit: int = 2) -> Column:
    """'a', 'a; and b', 'a; b; and c'."""

    def join(u: Column) -> Column:
        n = F.size(u)
        head = F.array_join(F.slice(u, 1, F.greatest(n - 1, F.lit(1))), "; ")
        return (
            F.when(n == 0, F.lit(""))
            .when(n == 1, F.get(u, F.lit(0)))
            .otherwise(F.concat(head, F.lit("; and "), F.get(u, n - 1)))
        )

    return let(unique_compact(F.slice(values, 1, limit)), join)


def scrub_pii(c: Column | str) -> Column:
    text = F.regexp_replace(F.coalesce(_col(c), F.lit("")), UNICODE + fv.PII_EMAIL, "[EMAIL]")
    return F.regexp_replace(text, fv.PII_PHONE, "[PHONE]")


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(c, pattern, group)


def clean_email(c: Column | str) -> Column:
    return first_match(F.lower(squash(c)), fv.EMAIL)


def clean_phone(c: Column | str) -> Column:
    digits = F.regexp_replace(first_match(squash(c), fv.PHONE), "[^0-9+]", "")
    return F.regexp_replace(digits, r"^\+\+", "+")


def first_number(c: Column | str) -> Column:
    return F.coalesce(first_match(F.coalesce(_col(c), F.lit("")), fv.NUMBER, 1).try_cast("double"), F.lit(0.0))


def max_years(c: Column | str) -> Column:
    """Largest 'N years' of a text, 0 when there is none."""
    found = F.transform(matches(F.lower(_col(c)), fv.YEARS, 1), lambda x: x.try_cast("double"))
    return F.coalesce(F.array_max(found), F.lit(0.0))


def project_lines(lines: Column, limit: int = 5) -> Column:
    bare = F.transform(lines, lambda x: squash(F.regexp_replace(x, r"^(?:[\-*\x{2022}]|" + fv.WHITESPACE + ")+", "")))
    return F.slice(distinct_ignoring_case(F.filter(bare, lambda x: x != "")), 1, limit)


def repair_json(c: Column | str) -> Column:
    """Fences off, outermost braces only, trailing commas off."""
    text = F.regexp_replace(strip_space(_col(c)), r"^```(?:json)?\s*\n?", "")
    text = F.regexp_replace(strip_space(text), r"\n?```\s*$", "")
    braces = first_match(text, r"(?s)\{.*\}")
    return F.when(braces != "", F.regexp_replace(braces, r",(\s*[}\]])", "$1")).otherwise(text)


def redact_critical(text: Column, critical: Column) -> Column:
    soft = F.regexp_replace(text, r"(?i)\bcritical missing skills?\b", "missing required skills")
    soft = F.regexp_replace(soft, r"(?i)\bcritical skill gaps?\b", "skill gaps")
    return F.when(F.size(critical) == 0, soft).otherwise(text)


def contains_any(c: Column, needles: Iterable[str]) -> Column:
    needles, hit = set(needles), F.lit(False)
    for needle in sorted(needles):
        if not any(n in needle for n in needles - {needle}):  # else the shorter one is found wherever this one is
            hit = hit | c.contains(needle)
    return hit


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))
