"""Normal forms, tokens, scores and cues of text, as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Characters with the Unicode property White_Space, for use inside a character class; and those white space in scripts of browsers.
WS = r"\t-\r \u0085   -     　"
SCRIPT_WS = r"\t-\r    -     　﻿"

# Words without weight in phrase scores.
STOP_WORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "the", "to", "with")
# Words that are no keywords.
KEYWORD_STOP = (
    "about", "after", "again", "author", "because", "before", "between", "could", "document", "first", "from", "have",
    "into", "more", "paper", "that", "their", "there", "these", "this", "through", "with", "would",
)
# Phrases that announce something new, and something known.
NOVELTY_CUES = (
    "we found", "evaluation shows", "reduced", "increased", "failed when", "only when", "regressed", "new",
    "previously unknown", "changed from", "unlike", "limitation", "tradeoff",
)
FAMILIAR_CUES = (
    "previously validated", "already validated", "known configuration", "standard practice", "not new evidence",
    "already deployed", "baseline already includes",
)


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WS}]+|[{WS}]+$", "")


_SPACES = re.compile(r"\s+")


@pandas_udf(StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def compatible(text: Column) -> Column:
    """NFKC; ASCII text, on which it does nothing, never goes to Python in a plan that filters for it first."""
    return _compatible(text)


def item_form(text: Column) -> Column:
    """NFKC, no soft hyphen, white space collapsed and trimmed."""
    one = F.regexp_replace(F.regexp_replace(compatible(text), r"­", ""), f"[{SCRIPT_WS}]+", " ")
    return F.trim(one)


def policy_form(text: Column) -> Column:
    """Lower case; letters, digits and % < > kept, everything else one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{IsAlphabetic}\p{N}%<>]+", " "))


def word_form(text: Column) -> Column:
    """Lower case; letters and digits kept, everything else one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+", " "))


def match_form(text: Column) -> Column:
    """Lower case, words cut at a line end joined, ASCII letters and digits kept, everything else one space."""
    joined = F.regexp_replace(F.lower(text), f"([a-z])-[{SCRIPT_WS}]+(?=[a-z])", "$1")
    return F.trim(F.regexp_replace(joined, "[^a-z0-9]+", " "))


def compact(text: Column) -> Column:
    return F.regexp_replace(text, f"[{WS}]+", "")


def words(form: Column) -> Column:
    """The words of a normal form; none of an empty one."""
    return F.filter(F.split(form, " "), lambda w: w != "")


def policy_tokens(form: Column) -> Column:
    return F.array_distinct(F.filter(words(form), lambda w: F.octet_length(w) > 2))


def word_tokens(form: Column) -> Column:
    return F.array_except(F.array_distinct(F.filter(words(form), lambda w: F.octet_length(w) > 1)), F.array(*map(F.lit, STOP_WORDS)))


def meaningful_words(form: Column) -> Column:
    return F.filter(words(form), lambda w: F.char_length(w) > 2)


def phrase_score(text_form: Column, phrase_form: Column, tokens=word_tokens) -> Column:
    """1 if the phrase stands in the text, else the share of its tokens that do; 0 for an empty phrase. Takes normal forms."""
    want = tokens(phrase_form)
    share = F.size(F.array_intersect(want, tokens(text_form))) / F.size(want).cast("double")
    return F.when(phrase_form == "", 0.0).when(F.contains(text_form, phrase_form), 1.0).when(F.size(want) == 0, 0.0).otherwise(share)


def best_phrase_score(text_form: Column, phrases: list[str] | tuple[str, ...], form=word_form, tokens=word_tokens) -> Column:
    """The highest score of a list of phrases, which travels as a literal; 0 without phrases."""
    scores = [phrase_score(text_form, form(F.lit(p)), tokens) for p in phrases]
    return F.greatest(F.lit(0.0), F.lit(0.0), *scores)


def matched_phrases(text_form: Column, phrases: list[str] | tuple[str, ...], least: float = 0.55) -> Column:
    return F.array_compact(F.array(*[F.when(phrase_score(text_form, policy_form(F.lit(p)), policy_tokens) >= least, F.lit(p)) for p in phrases]))


def cues(form: Column, phrases: tuple[str, ...]) -> Column:
    """The cues that stand in a policy form as whole words."""
    padded = F.concat(F.lit(" "), form, F.lit(" "))
    return F.filter(F.array(*map(F.lit, phrases)), lambda c: F.contains(padded, F.concat(F.lit(" "), c, F.lit(" "))))


def novelty_cues(form: Column) -> Column:
    """As ``cues``; "new" does not count beside "not new" or "no new"."""
    found = cues(form, NOVELTY_CUES)
    return F.when(F.contains(form, F.lit("not new")) | F.contains(form, F.lit("no new")), F.array_remove(found, "new")).otherwise(found)


def compares_numbers(form: Column) -> Column:
    """A digit together with a sign or word of comparison."""
    both = F.contains(form, F.lit(" from ")) & F.contains(form, F.lit(" to "))
    return form.rlike("[0-9]") & (form.rlike("[%<>]| percent| versus | compared | than ") | both)


# Letters whose capital form is written with several characters, and the one character that is theirs (themselves where there is none).
_SEVERAL = "".join(c for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x10000))) if len(c.upper()) > 1)
_ONE = "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _SEVERAL)


def lower_each(text: Column) -> Column:
    """Lower case, character by character: a sigma is the same wherever it stands, and a dotted capital I becomes one letter."""
    return F.lower(F.translate(text, "Σİ", "σi"))


def title_case(word: Column) -> Column:
    """The first character as a capital, one for one."""
    first = F.left(word, F.lit(1))
    return F.concat(F.when(first.isin(*_SEVERAL), F.translate(first, _SEVERAL, _ONE)).otherwise(F.upper(first)), F.substring(word, F.lit(2), F.char_length(word)))


def enum_token(value: Column) -> Column:
    """Trimmed, lower case, hyphens and spaces as underscores."""
    return F.translate(F.lower(trim(value)), "- ", "__")


def split_claims(text: Column) -> Column:
    """Claims divided by line breaks, full stops and semicolons; blank ones dropped."""
    return F.filter(F.transform(F.split(text, r"[\n.;]"), trim), lambda c: c != "")


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    return F.filter(F.transform(F.split(text, separator), trim), lambda p: p != "")


def is_complete_sentence(text: Column) -> Column:
    return trim(text).rlike("""[.!?]["')\\]]?$""")


def truncated(text: Column, characters: int) -> Column:
    return F.left(text, F.lit(characters))


def dice(a: Column, b: Column) -> Column:
    """Twice the common members over the members of both, as sets."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.coalesce(F.try_divide(F.lit(2.0) * F.size(F.array_intersect(x, y)), (F.size(x) + F.size(y)).cast("double")), F.lit(0.0))


def exact_index(text: Column, part: Column) -> Column:
    """Place of the first occurrence, from 0; -1 if there is none."""
    return F.instr(text, part) - 1
