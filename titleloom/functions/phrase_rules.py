"""Ordered phrase rules: replace any variation of a phrase by its base, rule after rule."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from titleloom.functions.text import regex_literal, strip
from titleloom.functions.word_index import WordIndex


class PhraseRule(NamedTuple):
    base: str
    variations: tuple[str, ...]


def rules_literal(rules: Sequence[PhraseRule]) -> Column:
    """The rule list as one constant array, in order.

    Texts are padded by one space at each end while rules run, so a phrase boundary is always a space.
    """
    rows = [
        {
            "phrases": [f" {variation} " for variation in rule.variations],
            "pattern": " +(?:" + "|".join(regex_literal(v) for v in rule.variations) + ") +",
            "base": " " + rule.base.replace("\\", "\\\\").replace("$", "\\$") + " ",
        }
        for rule in rules
    ]
    return F.from_json(
        F.lit(json.dumps(rows)), "array<struct<phrases:array<string>,pattern:string,base:string>>"
    )


def reached_rules(rules: Sequence[PhraseRule]) -> tuple[dict[str, list[int]], list[int]]:
    """For each word the rules that can change a text because it holds the word, and the rules to try on any text.

    A rule can only act where the first word of one of its phrases stands. That word is in the text from the start,
    or an earlier rule wrote it: so a word reaches the rules it starts, and those that their bases reach later on.
    """
    by_first: dict[str, int] = {}
    always = 0
    reach = [0] * len(rules)
    for at in range(len(rules) - 1, -1, -1):
        # Rules behind this one that its base can start, with all that these reach.
        reach[at] = 1 << at
        for word in rules[at].base.split(" "):
            reach[at] |= by_first.get(word, 0)
        for variation in rules[at].variations:
            first = variation.split(" ")[0]
            if first:
                by_first[first] = by_first.get(first, 0) | reach[at]
            else:
                always |= reach[at]

    def listed(bits: int) -> list[int]:
        return [at for at in range(bits.bit_length()) if bits >> at & 1]

    return {word: listed(bits) for word, bits in by_first.items()}, listed(always)


def apply_phrase_rules(text: Column, rules: Sequence[PhraseRule]) -> Column:
    """Run the rules in order over a text and strip it.

    One pass per rule; a match takes its separating spaces with it, so of two neighbouring matches only
    the first is replaced. Later rules see what earlier ones wrote. Only rules that some word of the text reaches
    are looked at, in order; a regex is compiled and run only for those one of whose phrases stands in the text.
    """
    if not rules:
        return strip(text)
    by_word, always = reached_rules(rules)
    index = WordIndex(by_word, "array<int>")
    all_rules = rules_literal(rules)
    none = F.array().cast("array<int>")
    padded = F.concat(F.lit(" "), strip(text), F.lit(" "))

    def run(held: Column) -> Column:
        reached = F.flatten(F.transform(F.split(held, " "), lambda word: F.coalesce(index.get(word), none)))
        if always:
            reached = F.concat(reached, F.array(*[F.lit(i) for i in always]))
        return F.aggregate(
            F.transform(F.array_sort(F.array_distinct(reached)), lambda at: F.get(all_rules, at)),
            held,
            lambda done, rule: F.when(
                F.exists(rule["phrases"], lambda phrase: F.contains(done, phrase)),
                F.regexp_replace(done, rule["pattern"], rule["base"]),
            ).otherwise(done),
        )

    # The text is computed once, as both the words and the fold read it.
    return strip(F.get(F.transform(F.array(padded), run), 0))
