"""Text steps of the title chain as column expressions."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from titleloom import fixed_values as fv
from titleloom.functions.word_index import WordIndex

# Characters that count as white space when a title is cut into words (regex class body).
WHITE_SPACE = (
    r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)


def regex_literal(text: str) -> str:
    """Escape a text so that a regex matches it as it stands."""
    return re.sub(r"([^\w\s]|_)", r"\\\1", text, flags=re.ASCII) if text.isascii() else "".join(
        regex_literal(ch) if ch.isascii() else ch for ch in text
    )


def lowercase(text: Column) -> Column:
    return F.lower(text)


def strip(text: Column) -> Column:
    """Drop white space at both ends."""
    return F.regexp_replace(text, f"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+\\z", "")


def strip_line_breaks(text: Column) -> Column:
    """Line breaks, real or written out as backslash sequences, become spaces."""
    text = F.translate(text, "".join(fv.LINE_BREAK_CHARACTERS), " " * len(fv.LINE_BREAK_CHARACTERS))
    for sequence in fv.LINE_BREAK_SEQUENCES:
        text = F.replace(text, F.lit(sequence), F.lit(" "))
    return text


def symbols_to_space(text: Column) -> Column:
    """Separating symbols become spaces; runs of spaces become one; ends are stripped."""
    text = F.translate(text, "".join(fv.SPACE_CHARACTERS), " " * len(fv.SPACE_CHARACTERS))
    for sequence in fv.SPACE_SEQUENCES:
        text = F.replace(text, F.lit(sequence), F.lit(" "))
    return strip(F.regexp_replace(text, " +", " "))


def drop_symbols(text: Column) -> Column:
    return F.translate(text, fv.SPECIAL_CHARACTERS, "")


def split_words(text: Column, also: str = "") -> Column:
    """Words between white space and the characters of ``also`` (regex class body), as an array."""
    return F.filter(F.split(text, f"[{WHITE_SPACE}{also}]+"), lambda w: w != "")


def join_words(words: Column) -> Column:
    return F.array_join(words, " ")


# Longer lists are looked up in a constant index instead of being part of the expression word by word.
LISTED_WORDS = 200


def without_words(words: Column, dropped: Iterable[str]) -> Column:
    dropped = sorted(dropped)
    if len(dropped) > LISTED_WORDS:
        index = WordIndex(dict.fromkeys(dropped, True), "boolean")
        return F.filter(words, lambda w: ~index.holds(w))
    return F.filter(words, lambda w: ~w.isin(dropped)) if dropped else words


def only_words(words: Column, kept: Iterable[str]) -> Column:
    """Words of a set, in order, repeats kept."""
    kept = sorted(kept)
    return F.filter(words, lambda w: w.isin(kept))


def remove_stopwords(text: Column, stopwords: Iterable[str]) -> Column:
    return join_words(without_words(split_words(text), stopwords))


def extract_seniority(text: Column) -> Column:
    return only_words(split_words(text), fv.SENIORITIES)


def extract_hierarchy(text: Column) -> Column:
    return only_words(split_words(text), fv.HIERARCHIES)


def remove_locations(text: Column, locations: Iterable[str]) -> Column:
    return join_words(without_words(split_words(text), locations))


@lru_cache(maxsize=1)
def ascii_foldings() -> tuple[dict[str, str], dict[str, str]]:
    """Compatibility decompositions that leave ASCII: one character each, and several characters each."""
    single, several = {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        folded = unicodedata.normalize("NFKD", char)
        if folded == char:
            continue
        kept = "".join(c for c in folded if c.isascii())
        if len(kept) == 1:
            single[char] = kept
        elif kept:
            several[char] = kept
    return single, several


def _class_of(chars: Iterable[str]) -> str:
    """Regex class body for a set of characters, as code point ranges."""
    codes = sorted(map(ord, chars))
    ranges, start = [], codes[0]
    for here, after in zip(codes, codes[1:] + [None]):
        if after != here + 1:
            ranges.append(f"\\x{{{start:X}}}-\\x{{{here:X}}}")
            start = after
    return "".join(ranges)


def strip_accents(text: Column) -> Column:
    """Compatibility-decompose, keep ASCII, drop the rest."""
    single, several = ascii_foldings()
    # Characters that expand to several are rare, and their regex class is long: it is tried only on texts with
    # letters beyond the usual accented ones, and single characters are looked at only in texts that hold one.
    table = F.from_json(F.lit(_json(several)), "map<string,string>")
    expanded = F.when(
        text.rlike(r"[^\x00-\x7F\u00C0-\u00FF]") & text.rlike(f"[{_class_of(several)}]"),
        F.array_join(
            F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), ""
        ),
    ).otherwise(text)
    folded = F.translate(expanded, "".join(single), "".join(single.values()))
    plain = F.regexp_replace(folded, r"[^\x00-\x7F]", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), plain).otherwise(text)


def _json(value) -> str:
    import json

    return json.dumps(value)


def normalize_plural(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Suffix rules in cascade on every word; a rule needs a non-digit of the word before the suffix.

    A rule looks at one word only, so each rule runs once over all words of the text. Words that no rule
    may touch are marked first, which takes their ends out of reach.
    """
    text = join_words(split_words(text))
    text = F.regexp_replace(text, f"(^| )({'|'.join(fv.PLURAL_EXCEPTIONS)})(?= |\\z)", f"$1$2{fv.PLURAL_MARK}")
    for suffix, replacement in rules:
        text = F.regexp_replace(text, f"{suffix}(?= |\\z)(?<=[^0-9 ]{suffix})", replacement)
    return strip(F.replace(text, F.lit(fv.PLURAL_MARK), F.lit("")))


def normalize_conjugation(text: Column, verbs: dict[str, str]) -> Column:
    """Replace words by the base form listed for them."""
    if not verbs:
        return join_words(split_words(text))
    index = WordIndex(verbs, "string")
    return join_words(F.transform(split_words(text), lambda w: F.coalesce(index.get(w), w)))
