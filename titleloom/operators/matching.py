"""Match normalized titles to the catalogue: whole title, longest word sequence, nearest embedding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleloom import fixed_values as fv
from titleloom.functions.text import regex_literal, split_words
from titleloom.operators.catalogue import ID_COLUMNS, ROLE_COLUMNS
from titleloom.operators.embedding import match_embedding
from titleloom.operators.normalize import Steps, normalize_distinct
from titleloom.operators.skew import Lookup, join_hot, join_lookup, keep_hot, written_lookup
from titleloom.session import written_once
from titleloom.sources.gazetteers import Gazetteer

# So many starts of each text are looked at before the others where the catalogue is too large to broadcast.
FIRST_STARTS = 4
# Length and start of a title in one number; no text has this many words.
_PLACES = 1 << 32


def title_ngrams(
    norm_title: Column, max_words: int | None = fv.NGRAM_MAX_TITLE_WORDS, longest: int = fv.NGRAM_MAX_WORDS
) -> Column:
    """Word sequences of a title, longest first, then leftmost; repeats and blocked single words left out.

    Sequences hold up to ``longest`` words and come from the first ``max_words`` words, or from all with None.
    """
    words = split_words(norm_title)
    if max_words is not None:
        words = F.slice(words, 1, max_words)

    def of_length(all_words: Column, n: Column) -> Column:
        return F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), F.size(all_words) - n + 1),
                lambda start: F.array_join(F.slice(all_words, start, n), " "),
            )
        )

    sequences = F.flatten(
        F.transform(
            F.array(words),
            lambda w: F.flatten(
                F.when(
                    F.size(w) >= fv.NGRAM_MIN_WORDS,
                    F.transform(
                        F.sequence(F.least(F.size(w), F.lit(longest)), F.lit(fv.NGRAM_MIN_WORDS), F.lit(-1)),
                        lambda n: of_length(w, n),
                    ),
                ).otherwise(F.array().cast("array<array<string>>"))
            ),
        )
    )
    return F.filter(sequences, lambda s: ~s.isin(list(fv.SINGLE_WORD_BLOCKLIST)))


def match_exact(titles: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``norm_title`` and the role whose normalized title it is; unmatched titles are left out."""
    roles = catalogue.select(F.col("processed_title").alias("norm_title"), F.struct(*ROLE_COLUMNS).alias("role"))
    distinct = titles.select("norm_title").filter(F.col("norm_title") != "").distinct()
    return join_lookup(distinct, roles, ["norm_title"], "inner").select("norm_title", F.lit(fv.MATCH_EXACT).alias("match_type"), "role")


def catalogue_prefixes(catalogue: DataFrame, longest: int = fv.NGRAM_MAX_WORDS) -> DataFrame:
    """``prefix, n, is_title, goes_on``: every start of n whole words of a catalogue title of up to ``longest`` words.

    ``is_title`` says that a title ends there and may be found inside another, ``goes_on`` that a longer title starts so.
    """
    titles = catalogue.select("processed_title", split_words(F.col("processed_title")).alias("words"))
    # A title with other white space than single spaces is no word sequence.
    plain = titles.filter((F.array_join("words", " ") == F.col("processed_title")) & (F.size("words") <= longest))
    starts = plain.select(
        F.size("words").alias("length"),
        F.posexplode(
            F.transform(F.sequence(F.lit(1), F.size("words")), lambda n: F.array_join(F.slice("words", F.lit(1), n), " "))
        ).alias("at", "prefix"),
    ).filter(F.col("length") > 0)
    whole = F.col("length") == F.col("at") + 1
    allowed = (F.col("length") >= fv.NGRAM_MIN_WORDS) & ~F.col("prefix").isin(list(fv.SINGLE_WORD_BLOCKLIST))
    return starts.groupBy("prefix", (F.col("at") + 1).alias("n")).agg(
        F.max(whole & allowed).alias("is_title"), F.max(~whole).alias("goes_on")
    )


def _starts(words: Column, length: int, first: int = 1, last: int | None = None) -> Column:
    """``start, rest`` of the positions ``first`` to ``last`` (or all from ``first``) of a title: the words from there, at
    most ``length``. The title is cut once.
    """
    return F.flatten(
        F.transform(
            F.array(words),
            lambda w: F.when(
                F.size(w) >= first,
                F.transform(
                    F.sequence(F.lit(first), F.size(w) if last is None else F.least(F.size(w), F.lit(last))),
                    lambda i: F.struct(i.alias("start"), F.slice(w, i, length).alias("rest")),
                ),
            ).otherwise(F.array().cast("array<struct<start:int,rest:array<string>>>")),
        )
    )


def _places(starts: DataFrame, prefixes: Lookup, levels: int) -> DataFrame:
    """``row, place``: of the positions ``row, start, rest`` of each row the one with the longest title, then the leftmost.

    Rows without a title are left out. A place is the length of the title and, below it, the start counted from the end:
    one number, whose maximum needs no sort.
    """
    found = starts.select("*", F.lit(0).alias("best"), F.lit(True).alias("alive"))
    for n in range(1, levels + 1):
        step = prefixes.select("prefix", "n", "is_title", "goes_on")
        step = step._replace(table=step.table.filter(F.col("n") == n).drop("n"))
        so_far = F.when(F.col("alive") & (F.size("rest") >= n), F.array_join(F.slice("rest", 1, n), " "))
        joined = join_lookup(found.withColumn("prefix", so_far), step, ["prefix"], "left", spread=["row", "start"])
        found = joined.select(
            "row", "start", "rest",
            F.when(F.col("is_title"), n).otherwise(F.col("best")).alias("best"),
            F.coalesce("goes_on", F.lit(False)).alias("alive"),
        ).filter((F.col("alive") & (F.lit(n) < levels)) | (F.col("best") > 0))
    place = F.col("best") * F.lit(_PLACES) + (_PLACES - 1 - F.col("start"))
    return found.filter(F.col("best") > 0).groupBy("row").agg(F.max(place).alias("place"))


def _longest_titles(
    texts: DataFrame, catalogue: DataFrame, key: str, exact: bool, max_words: int | None, longest: int
) -> DataFrame:
    """``key, whole, candidate, role``: per key the whole title (if ``exact``), else the longest catalogue title inside it.

    A position of a title goes on to its next word only while the words so far start a catalogue title, so most
    positions end at their first word. The catalogue's prefixes are written and measured once; if they are small, all
    steps are broadcast joins of one stage. If not, every position is shuffled, and the first few of each text go before
    the others: a title as long as the longest of the catalogue is not beaten by any that starts later.
    """
    roles = catalogue.select(F.col("processed_title").alias("candidate"), F.struct(*ROLE_COLUMNS).alias("role"))
    roles = written_lookup(roles)
    prefixes = written_lookup(catalogue_prefixes(roles.table.select(F.col("candidate").alias("processed_title")), longest))
    levels = prefixes.table.agg(F.max("n")).first()[0] or 0
    # Positions go under a digest of their text, which comes back by one join.
    digest = F.md5("norm_title") if key == "norm_title" else F.md5(F.to_json(F.struct(key, "norm_title")))
    rows = texts.select(*dict.fromkeys((key, "norm_title")), digest.alias("row"))
    if exact:
        wholes = roles.select(F.col("candidate").alias("norm_title"), F.col("role").alias("of_whole"))
        named = written_once(join_lookup(rows, wholes, ["norm_title"], "left", spread=["row"]), "texts")
        rows = named.filter(F.col("of_whole").isNull())
    else:
        rows = written_once(rows, "texts")
    words = split_words(F.col("norm_title"))
    words = words if max_words is None else F.slice(words, 1, max_words)

    def places(of: DataFrame, first: int = 1, last: int | None = None) -> DataFrame:
        starts = of.select("row", F.inline(_starts(words, max(1, levels), first, last)))
        return _places(starts, prefixes, levels)

    if prefixes.small:
        best = places(rows)
    else:
        best = written_once(places(rows, 1, FIRST_STARTS), "first-starts")
        ended = best.filter(F.col("place") >= F.lit(levels) * F.lit(_PLACES)).select("row")
        further = rows.filter(F.size(words) > FIRST_STARTS).select("row").join(ended, "row", "left_anti")
        further = written_once(further, "further-texts")
        if not further.isEmpty():
            others = places(rows.join(further, "row", "left_semi"), FIRST_STARTS + 1)
            best = best.unionByName(others).groupBy("row").agg(F.max("place").alias("place"))
    length = F.floor(F.col("place") / _PLACES).cast("int")
    start = (_PLACES - 1 - F.pmod("place", F.lit(_PLACES))).cast("int")
    chosen = rows.join(best, "row").select(
        key, F.array_join(F.slice(split_words(F.col("norm_title")), start, length), " ").alias("candidate"), "place"
    )
    inside = join_lookup(chosen, roles, ["candidate"], "left", spread=[key])
    if not exact:
        return inside.select(key, F.lit(False).alias("whole"), "candidate", "role")
    whole = named.filter(F.col("of_whole").isNotNull()).select(
        key, F.lit(True).alias("whole"), F.col("norm_title").alias("candidate"), F.col("of_whole").alias("role"), F.lit(0).alias("place")
    )
    both = inside.select(key, F.lit(False).alias("whole"), "candidate", "role", "place").unionByName(whole)
    best = F.max_by(F.struct("whole", "candidate", "role"), "place").alias("found")
    return both.groupBy(key).agg(best).select(key, "found.*")


def match_longest_ngram(
    titles: DataFrame,
    catalogue: DataFrame,
    max_words: int | None = fv.NGRAM_MAX_TITLE_WORDS,
    longest: int = fv.NGRAM_MAX_WORDS,
) -> DataFrame:
    """``norm_title, matched_title, role`` by the longest word sequence that is a whole catalogue title.

    Parameters as in ``title_ngrams``.
    """
    best = _longest_titles(titles.select("norm_title").distinct(), catalogue, "norm_title", False, max_words, longest)
    return best.select("norm_title", F.lit(fv.MATCH_NGRAM).alias("match_type"), F.col("candidate").alias("matched_title"), "role")


def filter_by_profile(matches: DataFrame, profile_ids: Sequence[int]) -> DataFrame:
    """Matches whose role belongs to one of the profiles."""
    wanted = F.array(*[F.lit(int(p)) for p in profile_ids])
    return matches.filter(F.arrays_overlap(F.col("role.perfil_ids"), wanted))


def restrict_ids_to_profile(matches: DataFrame, profiles: DataFrame, profile_ids: Sequence[int]) -> DataFrame:
    """Keep only the ids of a role that the chosen profiles (rows ``id`` + id lists) list as well."""
    if not profile_ids:
        return matches
    # One row: the distinct ids that any row of the chosen profiles lists.
    allowed_ids = profiles.filter(F.col("id").isin([int(p) for p in profile_ids])).agg(
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in ID_COLUMNS]
    ).first()
    role = F.col("role")
    for column in ID_COLUMNS:
        allowed = list(allowed_ids[column])
        kept = F.array_intersect(F.col(f"role.{column}"), F.lit(allowed).cast("array<int>"))
        role = role.withField(column, F.array_sort(kept))
    return matches.withColumn("role", role)


def match_cascade(
    texts: DataFrame,
    catalogue: DataFrame,
    key: str = "norm_title",
    profile_ids: Sequence[int] = (),
    profiles: DataFrame | None = None,
    word_vectors: DataFrame | None = None,
    max_words: int | None = fv.NGRAM_MAX_TITLE_WORDS,
    longest: int = fv.NGRAM_MAX_WORDS,
) -> DataFrame:
    """``key, match_type, role`` for distinct keys with a ``norm_title``: exact, then word sequence, then embedding.

    A match that fails the profile filter ends the search of its title. Titles without a match are left out.
    ``max_words`` and ``longest`` limit the word sequences as in ``title_ngrams``.
    """
    if word_vectors is not None:
        # Read again for the titles left over.
        texts = written_once(texts, "texts")
    named = texts.filter(F.col("norm_title") != "")
    matches = _longest_titles(named, catalogue, key, True, max_words, longest).select(
        key, F.when(F.col("whole"), fv.MATCH_EXACT).otherwise(fv.MATCH_NGRAM).alias("match_type"), "role"
    )
    if word_vectors is not None:
        rest = texts.filter(F.col("norm_title") != "").join(matches.select(key), key, "left_anti")
        near = match_embedding(rest.select("norm_title"), catalogue, word_vectors)
        roles = catalogue.select(F.col("processed_title").alias("matched_title"), F.struct(*ROLE_COLUMNS).alias("role"))
        matches = matches.unionByName(
            rest.join(near, "norm_title")
            .join(roles, "matched_title")
            .select(key, F.lit(fv.MATCH_EMBEDDING).alias("match_type"), "role")
        )
    if profile_ids:
        matches = filter_by_profile(matches, profile_ids)
        if profiles is not None:
            matches = restrict_ids_to_profile(matches, profiles, profile_ids)
    return matches


def split_compound_title(titles: DataFrame) -> DataFrame:
    """``title, pos, piece``: a title cut into single roles."""
    cut = "|".join(regex_literal(s) for s in fv.TITLE_SEPARATORS)
    return titles.select("title", F.posexplode(F.split("title", cut)).alias("pos", "piece"))


def match_pieces(
    titles: DataFrame,
    catalogue: DataFrame,
    lists: Gazetteer,
    steps: Steps = Steps(),
    vocabulary: DataFrame | None = None,
    profile_ids: Sequence[int] = (),
    profiles: DataFrame | None = None,
    word_vectors: DataFrame | None = None,
    verbs: DataFrame | None = None,
    dictionary: DataFrame | None = None,
    max_words: int | None = fv.NGRAM_MAX_TITLE_WORDS,
    longest: int = fv.NGRAM_MAX_WORDS,
) -> DataFrame:
    """``title, pos, match_type, role`` for the pieces of distinct titles that match a role.

    A piece that stands in many titles is normalized and matched once.
    """
    pieces = split_compound_title(titles.select("title").filter(F.col("title") != "").distinct())
    distinct = pieces.select(F.col("piece").alias("title")).filter(F.col("title") != "").distinct()
    normalized = normalize_distinct(distinct, lists, steps, vocabulary, verbs, dictionary)
    texts = normalized.select(F.col("title").alias("piece"), "norm_title")
    matches = match_cascade(texts, catalogue, "piece", profile_ids, profiles, word_vectors, max_words, longest)
    return join_hot(pieces, matches, ["piece"], "inner").select("title", "pos", "match_type", "role")


def normalize_titles(
    titles: DataFrame,
    catalogue: DataFrame,
    lists: Gazetteer,
    steps: Steps = Steps(),
    vocabulary: DataFrame | None = None,
    profile_ids: Sequence[int] = (),
    profiles: DataFrame | None = None,
    word_vectors: DataFrame | None = None,
    verbs: DataFrame | None = None,
    dictionary: DataFrame | None = None,
    max_words: int | None = fv.NGRAM_MAX_TITLE_WORDS,
    longest: int = fv.NGRAM_MAX_WORDS,
) -> DataFrame:
    """``title, roles``: each distinct title with the roles of its pieces, in their order.

    Titles without any role are left out. Each role is a struct with ``normalized_role, role_id, seniority,
    hierarchy``, the id lists and ``match_type``.
    """
    found = match_pieces(
        titles, catalogue, lists, steps, vocabulary, profile_ids, profiles, word_vectors, verbs, dictionary,
        max_words, longest,
    )
    answer = F.struct(
        "pos",
        F.col("role.title").alias("normalized_role"),
        F.col("role.role_id").alias("role_id"),
        F.col("role.seniorities").alias("seniority"),
        F.col("role.hierarchies").alias("hierarchy"),
        *[F.col(f"role.{c}").alias(c) for c in ID_COLUMNS],
        "match_type",
    )
    # The array of a title holds at most one role per piece of that title.
    grouped = found.groupBy("title").agg(F.array_sort(F.collect_list(answer)).alias("roles"))
    return grouped.withColumn("roles", F.transform("roles", lambda r: r.dropFields("pos")))


def first_match(pieces: DataFrame) -> DataFrame:
    """``title, role_id``: the first matched piece of each title (from ``match_pieces``)."""
    return pieces.groupBy("title").agg(F.min_by("role.role_id", "pos").alias("role_id"))


def ab_group_filter(rows: DataFrame, assignments: DataFrame, id_column: str, group: str) -> DataFrame:
    """Rows whose id is assigned to a test group. Ids without an assignment are left out."""
    members = assignments.filter(F.col("ab_test_group") == group).select(F.col("id").alias(id_column))
    return keep_hot(rows, members, [id_column])
