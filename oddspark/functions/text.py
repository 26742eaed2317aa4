"""Text normalisation and matching as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from oddspark import constants as K

_WORD = r"[\p{L}\p{N}_]+"
_SEPARATOR = r"[^\p{L}\p{N}_]+"


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def norm(text: Column) -> Column:
    """Lower case; runs outside a-z, 0-9 and space become one space (spaces stay as they are)."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", " ")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def flatten_sections(parts: Column) -> Column:
    """Array of section texts to one line: joined, tags stripped, whitespace collapsed."""
    return collapse(F.regexp_replace(F.concat_ws(" ", parts), "<[^>]+>", " "))


def word_set(text: Column) -> Column:
    """Distinct letter runs of the upper-cased text without trivial words."""
    runs = F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit("([A-Z]+)"), 1))
    return F.array_except(runs, _words(K.TRIVIAL_WORDS))


def shares_words(words: Column, other: Column, share: float = K.INDICATION_SHARE) -> Column:
    """At least ``share`` of ``words`` occur in ``other`` (both word sets)."""
    common = F.size(F.array_intersect(words, other))
    return (common > 0) & (common >= F.size(words) * share)


def label_tokens(term: Column) -> Column:
    """Distinctive tokens of a normalised term."""
    keep = lambda t: (F.length(t) > 3) & ~F.array_contains(_words(K.LABEL_STOPWORDS), t)
    return F.filter(F.split(term, " +"), keep)


def label_hits(reaction: Column, text: Column, boxed: Column) -> tuple[Column, Column]:
    """(in label, in boxed section): the phrase, else every distinctive token as a substring.

    When the phrase itself is in the label, the boxed flag also needs the phrase.
    """
    term = norm(reaction)
    tokens = label_tokens(term)
    phrase = (F.trim(term) != "") & F.contains(text, term)
    all_in = lambda body: (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.contains(body, t))
    labelled = phrase | all_in(text)
    in_boxed = F.when(phrase, F.contains(boxed, term)).otherwise(all_in(text) & all_in(boxed))
    return labelled, (boxed != "") & in_boxed


def interaction_terms(variants: Column, epc: Column, synonyms: Column) -> Column:
    """Names to look for, longest first: variants, the class phrase and its synonyms."""
    plain = F.trim(F.replace(F.coalesce(epc, F.lit("")), F.lit("[EPC]"), F.lit("")))
    none = F.array().cast("array<string>")
    names = F.concat(
        F.transform(F.coalesce(variants, none), lambda t: F.trim(t)), F.array(plain), F.coalesce(synonyms, none)
    )
    long_enough = F.array_distinct(F.filter(names, lambda t: F.length(t) >= K.MIN_TERM_LENGTH))
    order = lambda p, q: F.when(F.length(p) != F.length(q), F.length(q) - F.length(p)).otherwise(
        F.when(p < q, -1).when(p > q, 1).otherwise(0)
    )
    return F.array_sort(long_enough, order)


def name_forms(name: Column, variants: Column) -> Column:
    """Lower-case spellings of a molecule of at least five characters."""
    forms = F.concat(F.array(F.replace(name, F.lit("_"), F.lit(" "))), F.coalesce(variants, F.array().cast("array<string>")))
    lowered = F.transform(forms, lambda v: F.lower(F.trim(v)))
    return F.array_distinct(F.filter(lowered, lambda t: F.length(t) >= K.MIN_TERM_LENGTH))


def haystack(*names: Column) -> Column:
    """Non-empty names, lower-cased and joined."""
    return F.lower(F.concat_ws(" | ", *[F.nullif(n, F.lit("")) for n in names]))


def tokens(text: Column) -> Column:
    """Alternating word and separator tokens; joined they give the text back."""
    return F.regexp_extract_all(text, F.lit(f"({_WORD}|{_SEPARATOR})"), 1)


def word_starts(toks: Column) -> Column:
    """1-based positions of the word tokens."""
    first = F.when(F.try_element_at(toks, F.lit(1)).rlike(f"^{_WORD}"), 1).otherwise(2)
    none = F.array().cast("array<int>")
    return F.when(F.size(toks) >= first, F.sequence(first, F.size(toks), F.lit(2))).otherwise(none)


def sentences(text: Column) -> Column:
    """Pieces ending in '. ', the last one without."""
    return F.split(text, r"(?<=\. )")


def clip(quote: Column, limit: int = K.QUOTE_LIMIT) -> Column:
    q = F.trim(quote)
    return F.when(F.length(q) > limit, F.concat(F.rtrim(F.substring(q, 1, limit - 3)), F.lit("..."))).otherwise(q)


def reaction_key(term: Column) -> Column:
    """Comparison key: case folded, without caret and apostrophe."""
    return F.translate(F.upper(F.trim(term)), "^'\u2019", "")


def display_term(term: Column) -> Column:
    return F.replace(F.coalesce(term, F.lit("")), F.lit("^"), F.lit("'"))


def split_list(text: Column) -> Column:
    return F.transform(F.split(text, "[,;\n]"), lambda t: F.trim(t))


def is_safe_query(text: Column) -> Column:
    q = F.trim(text)
    return F.coalesce(q.rlike(K.SAFE_QUERY) & ~F.contains(q, F.lit("..")), F.lit(False))


def redact(text: Column, keys: tuple[str, ...] = ("api_key",), mark: str = "[hidden]") -> Column:
    """URL parameters with the given names lose their values; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"\b({'|'.join(keys)})=[^&\s]*", f"$1={mark}")
