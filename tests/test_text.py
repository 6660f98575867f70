"""The title chain against plain Python."""

from __future__ import annotations

import random
from dataclasses import replace
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from titleloom import fixed_values as fv
from titleloom.functions import text as T
from titleloom.functions.phrase_rules import PhraseRule, apply_phrase_rules, reached_rules
from titleloom.functions.word_index import WordIndex
from titleloom.operators.normalize import Steps, normalize_title, replace_words
from titleloom.sources.gazetteers import (
    conjugation_of,
    load_gazetteer,
    phrase_rules_of,
    plural_rules_of,
    stopwords_of,
)


def column(spark, texts, step):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", step(F.col("t")).alias("r"))
    return [r.r for r in sorted(rows.collect())]


def test_white_space_and_accents_follow_unicode(spark):
    chars = [chr(c) for c in [*range(1, 0x3100), *range(0xF900, 0xFFFF)] if not 0xD800 <= c < 0xE000]
    chars += ["\U0001D538", "\U0001F100", "가", "㎏", "ﬁ", "½"]
    texts = [f"a{c}b" for c in chars]
    assert column(spark, texts, T.split_words) == [t.split() for t in texts]
    assert column(spark, [c + "k" + c for c in chars], T.strip) == [(c + "k" + c).strip() for c in chars]
    folded = [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]
    assert column(spark, texts, T.strip_accents) == folded


def test_symbols(spark):
    texts = ["a:b,c;d.e-f–g\th\\ti", "  x   y  ", "a(b)c'd\"e`f´g", "a\\rb\\nc\r\nd"]
    assert column(spark, texts, T.symbols_to_space)[:2] == ["a b c d e f g h i", "x y"]
    assert column(spark, texts, T.drop_symbols)[2] == "abcdefg"
    assert column(spark, texts, T.strip_line_breaks)[3] == "a b c  d"


def by_regex(text, rules):
    """Rules as they are meant: one regex each, in order."""
    text = text.strip()
    for rule in rules:
        longest_first = sorted(rule.variations, key=lambda v: -len(v.split()))
        pattern = "( |^)+(" + "|".join(map(re.escape, longest_first)) + r")( |\Z)+"
        text = re.sub(pattern, lambda m: m.group(1) + rule.base + (m.group(3) or ""), text)
    return text.strip()


def test_phrase_rules_equal_one_regex_per_rule(spark):
    rng = random.Random(3)
    words = ["a", "b", "c", "d", "c#", "c++", "$x", "n.t"]
    rules = []
    for base in ("b", "x y", "c\\1", "$0", "q"):
        phrases = {" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(4)}
        rules.append(PhraseRule(base, tuple(sorted(phrases, key=lambda p: (-len(p.split()), p)))))
    texts = [rng.choice(["", " "]) + rng.choice([" ", "  "]).join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(800)]
    assert column(spark, texts, lambda c: apply_phrase_rules(c, rules)) == [by_regex(t, rules) for t in texts]


def test_neighbouring_matches_share_one_space(spark):
    rules = [PhraseRule("adv", ("lawyer",))]
    texts = ["lawyer lawyer", "x  lawyer  y", "lawyers", "lawyer"]
    assert column(spark, texts, lambda c: apply_phrase_rules(c, rules)) == ["adv lawyer", "x adv y", "lawyers", "adv"]


def test_plural_rules_equal_regexes_per_word(spark, lists):
    rng = random.Random(5)

    def one(word):
        if word in fv.PLURAL_EXCEPTIONS:
            word += "--"
        for suffix, replacement in lists.plural:
            word = re.sub(rf"(\D+)({suffix})\Z", lambda m: m.group(1) + replacement, word)
        return word.replace("--", "")

    endings = [s for s, _ in lists.plural] + ["", "1os", "9"]
    words = [rng.choice(["", "a", "medic", "7", "x2"]) + rng.choice(endings) for _ in range(400)] + list(fv.PLURAL_EXCEPTIONS)
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 5))) for _ in range(400)] + ["vidas vidas fisica vida"]
    expected = [" ".join(one(w) for w in t.split()).strip() for t in texts]
    assert column(spark, texts, lambda c: T.normalize_plural(c, lists.plural)) == expected


def normalized(spark, lists, titles, steps=Steps(correct_typos=False), **options):
    rows = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    done = normalize_title(rows, lists, steps, **options).collect()
    return [(r.norm_title, r.seniorities, r.hierarchies) for r in sorted(done, key=lambda r: r.id)]


@pytest.mark.parametrize(
    "title, same_as",
    [
        ("\tadvogado,júnior? ", "advogado júnior"),
        ("AdVoGado JÚnior", "advogado júnior"),
        ("àdvõgádô júnior", "advogado junior"),
        ("advogada", "advogado"),
        ("ad&vog#ad*o", "advogado"),
        ("analista banco dados", "analista de banco de dados"),
        ("advogaria como júnior", "advogar júnior"),
        ("advogados junior", "advogado júnior"),
        ("advogada junior", "advogado júnior"),
        ("advocacia junior", "advogado júnior"),
    ],
)
def test_variants_normalize_alike(spark, lists, title, same_as):
    one, other = normalized(spark, lists, [title, same_as])
    assert one[0] and one == other


def test_spelling_variant_normalizes_alike(spark, lists):
    vocabulary = spark.createDataFrame([("recepcionista", 5), ("advogado", 9)], "word string, freq bigint")
    one, other = normalized(spark, lists, ["recepicionista", "recepcionista"], Steps(), vocabulary=vocabulary)
    assert one == other == ("recepcionista", [], [])


def test_seniorities_and_hierarchies_keep_order_and_repeats(spark, lists):
    (done,) = normalized(spark, lists, ["Líder Sr. e gerente SÊNIOR sr"])
    assert done[1:] == (["sr", "senior", "sr"], ["lider", "gerente"])


def test_null_and_empty_titles(spark, lists):
    assert normalized(spark, lists, [None, "", "  ", "de"]) == [("", [], [])] * 4


def test_switches(spark, lists):
    off = Steps(False, True, False, False, False, False, False)
    assert normalized(spark, lists, ["Advogadas rio claro c#"], off)[0][0] == "advogadas c"


def test_verb_table_gives_the_inline_result(spark, lists):
    verbs = spark.createDataFrame(list(lists.conjugation.items()), "variation string, base string")
    titles = ["advogaria venderia muito", "vendo", "x"]
    inline = normalized(spark, lists, titles)
    assert normalized(spark, lists, titles, verbs=verbs) == inline
    texts = spark.createDataFrame([("t", "vendo vendo a")], "title string, text string")
    assert replace_words(texts, "text", verbs, "title").first().text == "vender vender a"


def lines(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "line int, text string")


def test_rule_list_readers(spark):
    rules = phrase_rules_of(lines(spark, "# c,x", "B, y ,Z z,y", "alone", "a,q", "b,w"))
    assert [tuple(r) for r in rules.orderBy("line").collect()] == [(2, "b", ["w"]), (4, "a", ["q"])]
    one = phrase_rules_of(lines(spark, "b,y,z z,y,a a")).first()
    assert one.variations == ["a a", "z z", "y"]
    verbs = {r.variation: r.base for r in conjugation_of(lines(spark, "ser,sou,era", "ir,era,era")).collect()}
    assert verbs == {"sou": "ser", "era": "ir"}
    plural = plural_rules_of(lines(spark, "os,o", "a,b,c", "x", "es, ")).collect()
    assert sorted((r.line, r.suffix, r.replacement) for r in plural) == [(1, "os", "o"), (4, "es", "")]
    stop = {r.word for r in stopwords_of(lines(spark, "# x", "de ", "sem", "à")).collect()}
    assert stop == {"de", "à", "in", "of", "on"}


def test_gazetteer_files_of_a_folder(spark, tmp_path):
    (tmp_path / "stopwords.txt").write_text("# c\r\nde\nsem\n", "utf-8")
    (tmp_path / "locations.txt").write_text("rio de janeiro\nsão paulo\n", "utf-8")
    (tmp_path / "mapping_gender.txt").write_text("b,c\na,d\n", "utf-8")
    found = load_gazetteer(spark, str(tmp_path), ["stopwords", "locations", "mapping_gender"])
    assert found.stopwords == {"de", "in", "of", "on"}
    assert found.locations == {"rio", "janeiro", "são", "paulo"}
    assert found.gender == (PhraseRule("b", ("c",)), PhraseRule("a", ("d",)))
    assert found.thesaurus == () and found.conjugation == {}


def test_many_rules_stay_one_small_expression(spark):
    rules = [PhraseRule(f"base{i}", (f"term{i}", f"two {i}")) for i in range(400)]
    assert column(spark, ["term7 x two 399"], lambda c: apply_phrase_rules(c, rules)) == ["base7 x base399"]


def test_long_rule_lists_equal_the_ordered_fold(spark):
    """330 rules whose bases start later rules: the rules a text reaches do all that the whole list does."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    for _ in range(3):
        rules = []
        for _ in range(330):
            phrases = {" ".join(rng.choices(words, k=rng.choice([1, 1, 2, 3]))) for _ in range(rng.randint(1, 4))}
            longest_first = tuple(sorted(phrases, key=lambda p: (-len(p.split()), p)))
            rules.append(PhraseRule(" ".join(rng.choices(words, k=rng.randint(1, 2))), longest_first))
        rules.append(PhraseRule("", ("w3 w4",)))
        texts = [" ".join(rng.choices(words, k=rng.randint(0, 7))) for _ in range(60)] + ["w1  w2", " w1", "other words", ""]
        assert column(spark, texts, lambda c: apply_phrase_rules(c, rules)) == [by_regex(t, rules) for t in texts]


def test_words_reach_rules_through_what_earlier_ones_write():
    rules = [PhraseRule("b", ("a",)), PhraseRule("d", ("c",)), PhraseRule("e f", ("b x", "b")), PhraseRule("a", ("f",)), PhraseRule("z", ("a",))]
    by_word, always = reached_rules(rules)
    assert by_word == {"a": [0, 2, 3, 4], "b": [2, 3, 4], "c": [1], "f": [3, 4]}
    assert always == []


def test_word_index(spark):
    values = {f"word {i}": i for i in range(3000)} | {"é": -1, "": -2}
    index = WordIndex(values, "int")
    asked = ["word 7", "word 2999", "é", "", "word", "WORD 7"]
    assert column(spark, asked, index.get) == [7, 2999, -1, -2, None, None]
    assert column(spark, asked, index.holds) == [True, True, True, True, False, False]
    assert column(spark, ["x"], WordIndex({}, "int").get) == [None]


def test_location_lists_of_any_size(spark, lists):
    """In the expression word by word, by the index, and as a table of a million words: the same answers."""
    from titleloom.operators.normalize import Steps, normalize_title

    steps = Steps(correct_typos=False, remove_locations=True, plural=False, gender=False, thesaurus=False, conjugation=False)
    titles = ["motorista t5 recife t999999", "t1000000 x", "t7", "", "T3  t3 cook"]
    rows = spark.createDataFrame([(t,) for t in titles], "title string")
    table = spark.range(1_000_000).selectExpr("concat('t', id) AS word")

    def answers(gazetteer, locations=None):
        done = normalize_title(rows, gazetteer, steps, locations=locations).collect()
        return {r.title: r.norm_title for r in done}

    expected = {titles[0]: "motorista recife", titles[1]: "t1000000 x", titles[2]: "", "": "", titles[4]: "cook"}
    assert answers(lists, table) == expected
    for words in (frozenset({"t5", "t999999", "t7", "t3"}), frozenset({"t5", "t999999", *(f"t{i}" for i in range(3000))})):
        assert answers(lists._replace(locations=words) if hasattr(lists, "_replace") else replace(lists, locations=words)) == expected


def test_rule_words_cut_a_line_once(spark):
    from titleloom.sources.gazetteers import rule_words_of

    texts = ["#no, words", "Base, one two ,\tthree,,four five", " ,", "", "stop, SIX"]
    lines = spark.createDataFrame([*enumerate(texts), (9, None)], "line int, text string")
    stop = spark.createDataFrame([("stop",)], "word string")
    found = rule_words_of(lines, stop)
    assert sorted(r.word for r in found.collect()) == sorted("base one two three four five six".split())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1
