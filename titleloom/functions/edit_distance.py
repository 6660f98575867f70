"""Edit distance up to two, where swapping two neighbouring letters counts as one edit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# One edit (delete, insert, change, swap) takes this many characters off the left and the right word.
_EDITS = ((1, 0), (0, 1), (1, 1), (2, 2))


def _let(body: Callable[[Column], Column], **values: Column) -> Column:
    """Evaluate some columns once and use them many times."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body)[0]


def _shared_prefix(left: Column, right: Column) -> Column:
    """Number of equal characters at the start."""
    same = F.zip_with(F.split(left, ""), F.split(right, ""), lambda a, b: a.eqNullSafe(b))
    return _let(
        lambda at: F.when(at["difference"] == 0, F.length(left)).otherwise(at["difference"] - 1),
        difference=F.array_position(same, False).cast("int"),
    )


def _is_edit(left: Column, right: Column, sizes: tuple[int, int]) -> Column:
    """Is turning one piece into the other a single edit? Only a swap needs a look at the letters."""
    return left == F.reverse(right) if sizes == (2, 2) else F.lit(True)


def _edits(cut: Column) -> Column:
    """Edits between two words that differ in their first and in their last character."""
    a, b, m, n = cut["a"], cut["b"], cut["m"], cut["n"]
    one, two = F.lit(False), F.lit(False)
    for i, j in _EDITS:
        one = one | ((m == i) & (n == j) & _is_edit(a, b, (i, j)))
        for k, l in _EDITS:
            two = two | (
                (m - n == i + k - j - l)
                & (m >= i + k)
                & (n >= j + l)
                & _is_edit(F.substring(a, 1, i), F.substring(b, 1, j), (i, j))
                & _is_edit(F.substring(a, m - k + 1, F.lit(k)), F.substring(b, n - l + 1, F.lit(l)), (k, l))
                & (F.substring(a, F.lit(i + 1), m - (i + k)) == F.substring(b, F.lit(j + 1), n - (j + l)))
            )
    return F.when((m == 0) & (n == 0), 0).when(one, 1).when(two, 2)


def letters(word: Column) -> Column:
    """The letters of a word in order of the alphabet."""
    return F.array_join(F.array_sort(F.split(word, "")), "")


def edits_up_to_two(
    left: Column, right: Column, left_letters: Column | None = None, right_letters: Column | None = None
) -> Column:
    """0, 1 or 2, or null where more edits are needed.

    Without swaps this is the plain distance. A swap can only do better if it leaves the letters as they are:
    one swap turns two plain edits into one, and a swap with one more edit changes at most one letter. Only
    pairs with such ``letters`` are looked at closely. Pass the letters where words are compared many times.
    """
    plain = F.levenshtein(left, right, 2)
    left_letters = letters(left) if left_letters is None else left_letters
    right_letters = letters(right) if right_letters is None else right_letters
    return (
        F.when(plain.between(0, 1), plain)
        .when((plain == 2) & (left_letters != right_letters), 2)
        .when((plain < 0) & (F.levenshtein(left_letters, right_letters, 2) < 0), F.lit(None).cast("int"))
        .otherwise(_edits_with_swaps(left, right))
    )


def _edits_with_swaps(left: Column, right: Column) -> Column:
    """Equal ends never need an edit, so they are cut off first.

    What remains starts and ends with a difference: with at most two edits one of them is at the start, one at
    the end, and the text between them is the same.
    """

    def without_suffix(words: Column) -> Column:
        a, b = words["a"], words["b"]
        return _let(
            lambda s: _let(
                _edits,
                a=F.substring(a, F.lit(1), F.length(a) - s["n"]),
                b=F.substring(b, F.lit(1), F.length(b) - s["n"]),
                m=F.length(a) - s["n"],
                n=F.length(b) - s["n"],
            ),
            n=_shared_prefix(F.reverse(a), F.reverse(b)),
        )

    return _let(
        lambda p: _let(
            without_suffix,
            a=F.substring(left, p["n"] + 1, F.length(left)),
            b=F.substring(right, p["n"] + 1, F.length(right)),
        ),
        n=_shared_prefix(left, right),
    )
