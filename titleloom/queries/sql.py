"""The title chain as DuckDB expressions, written from the rule files with the regexes the rules stand for."""

from __future__ import annotations

import re
from importlib import resources

from titleloom import fixed_values as fv
from titleloom.functions.text import WHITE_SPACE


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words) -> str:
    return "[" + ", ".join(quoted(w) for w in sorted(words)) + "]"


def file_lines(name: str) -> list[list[str]]:
    text = resources.files("titleloom").joinpath("gazetteers", f"{name}.txt").read_text("utf-8")
    return [[t.strip() for t in line.lower().split(",")] for line in text.splitlines() if not line.startswith("#")]


def stopwords() -> set[str]:
    return ({line[0] for line in file_lines("stopwords")} - set(fv.STOPWORDS_KEPT)) | set(fv.STOPWORDS_ADDED)


def locations() -> set[str]:
    return {w for line in file_lines("locations") for token in line for w in token.split()} - stopwords()


def conjugation() -> dict[str, str]:
    return {form: line[0] for line in file_lines("mapping_conjugation") for form in line[1:]}


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{WHITE_SPACE}]+'), lambda w: w <> '')"


def joined(x: str) -> str:
    return f"coalesce(array_to_string({x}, ' '), '')"


def without(x: str, dropped) -> str:
    return f"list_filter({x}, lambda w: NOT list_contains({listed(dropped)}, w))"


def only(x: str, kept) -> str:
    return f"list_filter({words(x)}, lambda w: list_contains({listed(kept)}, w))"


def line_breaks(x: str) -> str:
    for char in fv.LINE_BREAK_CHARACTERS:
        x = f"replace({x}, chr({ord(char)}), ' ')"
    for sequence in fv.LINE_BREAK_SEQUENCES:
        x = f"replace({x}, {quoted(sequence)}, ' ')"
    return x


def symbols_to_space(x: str) -> str:
    for char in fv.SPACE_CHARACTERS:
        x = f"replace({x}, chr({ord(char)}), ' ')"
    for sequence in fv.SPACE_SEQUENCES:
        x = f"replace({x}, {quoted(sequence)}, ' ')"
    return strip(f"regexp_replace({x}, ' +', ' ', 'g')")


def drop_symbols(x: str) -> str:
    return f"translate({x}, {quoted(fv.SPECIAL_CHARACTERS)}, '')"


def phrase_rules(x: str, name: str) -> str:
    """One regex per rule, in order, as the rule list is meant."""
    rules: dict[str, list[str]] = {}
    for line in file_lines(name):
        if len(line) >= 2:
            rules[line[0]] = sorted(set(line[1:]), key=lambda v: -len(v.split()))
    x = strip(x)
    for base, variations in rules.items():
        pattern = "( |^)+(" + "|".join(re.escape(v) for v in variations) + ")( |$)+"
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(chr(92) + '1' + base + chr(92) + '3')}, 'g')"
    return strip(x)


def remove_stopwords(x: str) -> str:
    return joined(without(words(x), stopwords()))


def accents(x: str) -> str:
    return f"regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')"


def remove_locations(x: str) -> str:
    return joined(without(words(x), locations()))


def conjugated(x: str) -> str:
    cases = " ".join(f"WHEN {quoted(form)} THEN {quoted(base)}" for form, base in conjugation().items())
    return joined(f"list_transform({words(x)}, lambda w: CASE w {cases} ELSE w END)")


def plural(x: str) -> str:
    word = "w"
    for line in file_lines("mapping_plural"):
        if len(line) == 2:
            word = f"regexp_replace({word}, {quoted(f'({chr(92)}D+){line[0]}$')}, {quoted(chr(92) + '1' + line[1])})"
    return strip(joined(
        f"list_transform({words(x)}, lambda w: replace("
        f"CASE WHEN list_contains({listed(fv.PLURAL_EXCEPTIONS)}, w) THEN w ELSE {word} END, '--', ''))"
    ))


def cleaned(x: str) -> str:
    x = line_breaks(f"lower(coalesce({x}, ''))")
    return drop_symbols(symbols_to_space(phrase_rules(x, "mapping_special_character_terms")))


def plain(x: str) -> str:
    """Up to the removal of accents, without spelling correction."""
    return accents(remove_stopwords(cleaned(x)))


def reworded(x: str) -> str:
    return phrase_rules(phrase_rules(plural(conjugated(x)), "mapping_gender"), "mapping_thesaurus")


def normalized(source: str, title: str, keep: str) -> str:
    """SELECT with ``norm_title, seniorities, hierarchies`` (lists) for the titles of a FROM item, in two steps."""
    return (
        f"SELECT {keep}, {reworded('plain_text')} AS norm_title, {only('plain_text', fv.SENIORITIES)} AS seniorities, "
        f"{only('plain_text', fv.HIERARCHIES)} AS hierarchies "
        f"FROM (SELECT *, {plain(title)} AS plain_text FROM {source})"
    )
