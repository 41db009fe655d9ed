"""Evidence search: which files of a code corpus mention a required skill.

A skill's query terms are words of three characters or more without spaces, and
a term counts wherever it is a *substring* of a line. A line holds such a term
exactly if one of the line's space-delimited words holds it, so the substring
test runs once per distinct word of the corpus instead of once per line:

    words of files --distinct--> vocabulary --trigram--> (term, word) pairs
    words of files --equality with the pairs' word--> (term, file)

New words keep coming as a corpus grows, so the pairs outgrow what can be
broadcast; the terms don't. Where every hit is asked for and the terms are few
enough to be broadcast, words meet them by trigram where they are read:

    words of files --trigrams, equality with the terms' one--> (term, file)

A term always has a trigram, and its rarest one is compared, so the
substring test too is reached by equality; nothing is joined all to all. A word
longer than a window (an image cell, a minified file) takes part as overlapping
windows that between them hold every term it holds, so no row grows with it.

Only a few files of a skill are reported, and the first files of a skill are
among the first files of its words. `top_files` looks in the very first files
before the others, which settles the skills that most files mention. For the
others it keeps the first few files of each *word*, in each task and then of all, and merges the words' lists
by skill: no table of skills and files is made. `best_hits` then looks for lines
in those files alone. `search_code` gives the line of every hit there is; what
travels there are the hits, each task's cut to the first line of a skill and
file. Project and path name a file, so they are expected once in a corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from winnow import fixed_values as fixed
from winnow.functions import text as t
from winnow.operators.grouping import for_skewed_join, likely_among
from winnow.operators.ordering import written

FILE = ["project", "path"]
_TRIGRAM = "(?s)(?=(.{3}))"
# Characters from one window of a long word to the next.
_STEP = 128
# Files, the first in encounter order, that skills are looked for in before all files are.
_FIRST_FILES = 4096
# Marks where a window is cut off from the rest of its word; no term holds it.
_CUT = "\ua66e"


def query_terms(skills: DataFrame) -> DataFrame:
    """(skill, term): the terms of each distinct skill."""
    return skills.select("skill").distinct().select(
        "skill", F.explode(F.array_distinct(t.query_terms(F.col("skill")))).alias("term")
    )


def longest_term(skills: DataFrame) -> Column:
    """Characters of the longest term, as a subquery."""
    longest = query_terms(skills).agg(F.coalesce(F.max(F.length("term")), F.lit(1)).alias("n"))
    return longest.select("n").scalar()


def _windows(words: Column, reach: Column) -> Column:
    """Words, those longer than a window as overlapping windows.

    An occurrence of a term with its neighbours left and right lies whole in
    one of them. A lookahead takes a window and the match goes one step on, so
    a long word is read through about once.
    """
    width = F.lit(_STEP + 1) + reach

    def cut(word: Column) -> Column:
        pattern = F.concat(F.lit("(?s)(?=(.{1,"), width.cast("string"), F.lit(f"}})).{{1,{_STEP}}}"))
        mark = F.lit(_CUT)

        def marked(window: Column, at: Column) -> Column:
            ends = at * _STEP + F.length(window) >= F.length(word)
            return F.concat(F.when(at > 0, mark).otherwise(""), window, F.when(ends, "").otherwise(mark))

        return F.transform(F.regexp_extract_all(word, pattern, F.lit(1)), marked)

    def all_cut(words: Column) -> Column:
        pieces = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > width, cut(w)).otherwise(F.array(w))))
        return F.when(F.exists(words, lambda w: F.length(w) > width), F.array_distinct(pieces)).otherwise(words)

    # One-element array: binds the words, so that they are worked out once.
    return F.flatten(F.transform(F.array(words), all_cut))


def _file_id() -> Column:
    """Two hashes; one of 64 bits is shared by two files from some 10^9 files on."""
    return F.struct(F.xxhash64(*FILE).alias("a"), F.xxhash64(*FILE[::-1], F.lit(1)).alias("b")).alias("file")


def _named(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Hits with project and path in place of the file's id."""
    names = files.select(_file_id(), *FILE)
    return hits.join(names, "file").select("skill", *FILE, *[c for c in hits.columns if c not in ("skill", "file")])


def _copies(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Hits once for every row of `files` with their project and path, which is one row as a rule."""
    several = files.groupBy(*[F.col(c).alias("_" + c) for c in FILE]).agg(F.count("*").alias("_n")).filter("_n > 1")
    several = written(several, "repeated-files")
    same = F.col("project").eqNullSafe(F.col("_project")) & F.col("path").eqNullSafe(F.col("_path"))
    copied = hits.join(several, same, "left")
    return copied.withColumn("_n", F.explode(F.sequence(F.lit(1), F.coalesce("_n", F.lit(1)).cast("int")))).select(*hits.columns)


def word_positions(files: DataFrame, skills: DataFrame) -> DataFrame:
    """(project, path, word, line_no): the distinct words or windows of each line, lines from 1."""
    lines = files.withColumn("_reach", longest_term(skills)).select(
        *FILE, "_reach", F.posexplode(t.lines_of(F.lower("content"))).alias("at", "line")
    )
    spaced = F.array_distinct(F.split("line", t.SPACE + "+"))
    words = lines.select(*FILE, (F.col("at") + 1).alias("line_no"), F.explode(_windows(spaced, F.col("_reach"))).alias("word"))
    return words.filter(F.length("word") >= fixed.MIN_TERM_CHARS)


def words_with_terms(vocabulary: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, word) for every word of a distinct vocabulary that contains the term."""
    wanted = terms.select("term").distinct()

    def trigrams(of: str) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.col(of), F.lit(_TRIGRAM), F.lit(1)))

    term_grams = wanted.select("term", F.explode(trigrams("term")).alias("gram"))
    needed = written(term_grams.select("gram").distinct(), "term-trigrams")
    word_grams = vocabulary.select("word", F.explode(trigrams("word")).alias("gram"))
    # How common each needed trigram is in the vocabulary decides which one to compare.
    common = (
        word_grams.filter(likely_among(needed, "gram"))
        .groupBy("gram")
        .agg(F.count("*").alias("n"))
    )
    rarest = (
        term_grams.join(common, "gram", "left")
        .groupBy("term")
        .agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram"))
    )
    rarest = written(rarest, "rarest-trigrams")
    word_grams = word_grams.filter(likely_among(rarest, "gram"))
    return (
        word_grams.join(rarest, "gram")
        .filter(F.contains("word", F.col("term")))
        .select("term", "word")
    )


def skill_words(vocabulary: DataFrame, skills: DataFrame, whole_word: bool) -> DataFrame:
    """(skill, word) for every word that has one of the skill's terms, as a part or as a whole word."""
    terms = query_terms(skills)
    pairs = words_with_terms(vocabulary, terms)
    if whole_word:
        pairs = pairs.filter(t.contains_word(F.col("word"), F.col("term"), _CUT))
    return pairs.join(terms, "term").select("skill", "word").distinct()


def _distinct_words(files: DataFrame, skills: DataFrame, *keep: str | Column) -> DataFrame:
    """(kept columns, word): the distinct words or windows of each file; a file is one row, so nothing is shuffled."""
    distinct = F.array_distinct(F.split(F.lower("content"), t.SPACE + "+"))
    spread = files.withColumn("_reach", longest_term(skills)).select(
        *keep, F.explode(_windows(distinct, F.col("_reach"))).alias("word")
    )
    return spread.filter(F.length("word") >= fixed.MIN_TERM_CHARS)


def skills_found(files: DataFrame, skills: DataFrame, whole_word: bool = False) -> DataFrame:
    """(skill) of the skills with a term in any file. The words of the corpus tell; files and their names aren't needed."""
    vocabulary = _distinct_words(files, skills).distinct()
    return skill_words(vocabulary, skills, whole_word).select("skill").distinct()


def matching_files(files: DataFrame, skills: DataFrame, whole_word: bool = False) -> DataFrame:
    """(skill, project, path) of all files with any of the skill's terms."""
    words = _distinct_words(files, skills, _file_id())
    pairs = skill_words(words.select("word").distinct(), skills, whole_word)
    pairs = for_skewed_join(pairs, "word")  # some words stand in every file (import, return)
    return _named(words.join(pairs, "word").select("skill", "file").distinct(), files)


def _by_trigram(skills: DataFrame) -> DataFrame:
    """(gram, term, skill): each term under the one of its trigrams that the fewest terms have."""
    terms = query_terms(skills)
    grams = terms.select("term").distinct().select("term", F.explode(F.array_distinct(_trigrams_at("term"))).alias("gram"))
    common = grams.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = grams.join(common, "gram").groupBy("term").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return rarest.join(terms, "term").select("gram", "term", "skill")


def _places(text: str) -> Column:
    """Where the trigrams of a text of three characters or more start, from 1."""
    return F.sequence(F.lit(1), F.length(text) - 2)


def _trigrams_at(text: str) -> Column:
    return F.transform(_places(text), lambda at: F.substr(F.col(text), at, F.lit(3)))


def _is_broadcast(rows: DataFrame) -> bool:
    """Whether written rows are of a size that Spark broadcasts."""
    spark = rows.sparkSession
    most = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= most


def first_hit_per_file(files: DataFrame, skills: DataFrame, whole_word: bool = False) -> DataFrame:
    """(skill, project, path, line_no): the first line with any of the skill's terms, for every hit.

    A file's words are met in one task, which sends the file's first line of a skill on.
    """
    words = word_positions(files, skills)
    wanted = None if whole_word else written(_by_trigram(skills), "terms-by-trigram")
    if wanted is not None and _is_broadcast(wanted):
        grams = words.select("*", F.explode(_places("word")).alias("_at"))
        grams = grams.withColumn("gram", F.substr("word", F.col("_at"), F.lit(3)))
        found = grams.join(wanted, "gram").filter(F.contains("word", F.col("term")))
    else:
        # Written, so that Spark knows their size before it plans the join: where they
        # can be broadcast, the words of the corpus are met where they are read.
        pairs = written(skill_words(words.select("word").distinct(), skills, whole_word), "skill-words")
        found = words.join(pairs, "word")
    return _copies(found.groupBy("skill", *FILE).agg(F.min("line_no").alias("line_no")), files)


def is_readme(path: Column) -> Column:
    return path == fixed.README_NAME


def _kinds() -> list[Column]:
    """`kind` puts READMEs before code, `ext_rank` the extensions among themselves."""
    readme = is_readme(F.col("path"))
    ranks = F.array(*[F.lit(e) for e in fixed.CODE_EXTENSIONS])
    place = F.array_position(ranks, F.substring_index("path", ".", -1)).cast("int")
    return [
        F.when(readme, "readme").otherwise("code").alias("kind"),
        F.when(readme, 0).otherwise(place).alias("ext_rank"),
    ]


def search_code(files: DataFrame, skills: DataFrame, whole_word: bool = False) -> DataFrame:
    """One row per (skill, file): READMEs that hold a term, and code files with their first hit line.

    A README counts as a whole, so it has no line.
    """
    line = F.when(~is_readme(F.col("path")), F.col("line_no")).alias("line_no")
    return first_hit_per_file(files, skills, whole_word).select("skill", *FILE, *_kinds(), line)


def top_hits(hits: DataFrame, per_skill: int = fixed.MAX_HITS_PER_SKILL) -> DataFrame:
    """The first hits of each skill in encounter order, with their rank.

    Spark applies the rank limit before the shuffle as well, so a skill that a
    third of all files mention still sends only a few rows per task.
    """
    order = Window.partitionBy("skill").orderBy("project", "ext_rank", "path")
    ranked = hits.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= per_skill)


def first_files_of_words(files: DataFrame, skills: DataFrame, per_word: int, wanted: Column | None = None) -> DataFrame:
    """(word, project, path, kind, ext_rank): the first files of each word, or of each wanted one, in encounter order.

    The limit cuts each task's rows before the shuffle, and again after it, so
    a task sends `per_word` rows of a word at most, whatever it stands in.
    """
    words = _distinct_words(files, skills, *FILE, *_kinds())
    words = words if wanted is None else words.filter(wanted)
    order = Window.partitionBy("word").orderBy("project", "ext_rank", "path")
    ranked = words.withColumn("_place", F.row_number().over(order))
    return ranked.filter(F.col("_place") <= per_word).drop("_place")


def top_files(
    files: DataFrame, skills: DataFrame, per_skill: int = fixed.MAX_HITS_PER_SKILL, whole_word: bool = False
) -> DataFrame:
    """The first files of each skill with their rank: (skill, project, path, kind, ext_rank, rank).

    A skill with `per_skill` hits among the very first files has its first ones
    there, whatever the others hold. The skills that most files mention are of
    that kind, so what is looked for in all files are the words of the others.
    """
    asked = written(skills.select("skill").distinct(), "asked-skills")
    keys = files.select(_encounter().alias("key"))
    last = keys.orderBy("key").limit(_FIRST_FILES).agg(F.max("key").alias("key")).scalar()
    first = written(files.filter(_encounter() <= last), "first-files")
    early = written(_top_files(first, asked, per_skill, whole_word), "top-of-first-files")
    settled = early.filter(F.col("rank") == per_skill).select("skill")
    late = _top_files(files, written(asked.join(settled, "skill", "left_anti"), "open-skills"), per_skill, whole_word)
    return early.join(settled, "skill", "left_semi").unionByName(late)


def _encounter() -> Column:
    """What files are ordered by, compared as in `top_hits`: nulls first."""
    return F.struct("project", _kinds()[1], "path")


def _top_files(files: DataFrame, skills: DataFrame, per_skill: int, whole_word: bool) -> DataFrame:
    """As `top_files`, by the words of all the given files.

    A skill's first files hold one of its words, and each is among the first
    files of that word; so the words' lists merged by skill hold them all. Words
    that have no term are left out before the files of any are ranked.
    """
    vocabulary = written(_distinct_words(files, skills).distinct(), "vocabulary")
    pairs = written(skill_words(vocabulary, skills, whole_word), "skill-words")
    first = first_files_of_words(files, skills, per_skill, likely_among(pairs, "word"))
    listed = first.join(pairs, "word").select("skill", *FILE, "kind", "ext_rank").distinct()
    return top_hits(listed, per_skill)


def best_hits(
    files: DataFrame, skills: DataFrame, per_skill: int = fixed.MAX_HITS_PER_SKILL, whole_word: bool = False
) -> DataFrame:
    """The first hits of each skill with line_no and snippet.

    The contents are met only by the ranked hits, and only of a file that was
    hit are the lines looked through.
    """
    best = written(top_files(files, skills, per_skill, whole_word).drop("rank"), "top-files")
    ranked = top_hits(best, per_skill)

    def has_term(line: Column) -> Column:
        def within(term: Column) -> Column:
            return t.contains_word(line, term) if whole_word else F.contains(line, term)

        return F.exists(t.query_terms(F.col("skill")), within)

    code_lines = F.when(F.col("kind") != "readme", t.lines_of(F.col("content")))
    first = F.array_position(F.transform("_lines", lambda line: has_term(F.lower(line))), True)
    return (
        files.select(*FILE, "content")
        .filter(likely_among(best, "path"))
        .join(ranked, FILE)
        .withColumn("_lines", code_lines)
        .withColumn("line_no", first.cast("int"))
        .withColumn("snippet", _shown())
        .select(*ranked.columns, "line_no", "snippet")
    )


def snippet(lines: Column, line_no: Column) -> Column:
    """The hit line with up to 8 lines before and 7 after, clipped to the file."""
    start = F.greatest(line_no - fixed.SNIPPET_BEFORE, F.lit(1))
    end = F.least(line_no + fixed.SNIPPET_AFTER, F.size(lines))
    return F.array_join(F.slice(lines, start, end - start + 1), "\n")


def _shown() -> Column:
    """The overview of a README, or the window around the hit in _lines."""
    overview = t.cap(F.col("content"), fixed.README_OVERVIEW_CHARS)
    window = snippet(F.col("_lines"), F.col("line_no"))
    return F.when(F.col("kind") == "readme", overview).otherwise(window)


def readme_hits(files: DataFrame, skills: DataFrame) -> DataFrame:
    """(skill, project, overview) for READMEs that hold a term anywhere."""
    readmes = files.filter(is_readme(F.col("path")))
    overview = t.cap(F.col("content"), fixed.README_OVERVIEW_CHARS).alias("overview")
    heads = readmes.select(*FILE, overview)
    return heads.join(matching_files(readmes, skills), FILE).select("skill", "project", "overview")


def search_status(files: DataFrame, skills: DataFrame, hits: DataFrame) -> DataFrame:
    """(skill, status): no_corpus, no_terms, no_matches or found; `hits` has the skills found, as of `skills_found`."""
    any_file = files.limit(1).agg(F.count("*")).scalar()
    hit = hits.select("skill").distinct().withColumn("_hit", F.lit(True))
    status = (
        F.when(F.col("_files") == 0, "no_corpus")
        .when(F.size(t.query_terms(F.col("skill"))) == 0, "no_terms")
        .when(F.col("_hit").isNull(), "no_matches")
        .otherwise("found")
    )
    return (
        skills.select("skill")
        .distinct()
        .join(hit, "skill", "left")
        .withColumn("_files", any_file)
        .select("skill", status.alias("status"))
    )


def proof_skills(jds: DataFrame, per_jd: int | None = None) -> DataFrame:
    """(jd_id, pos, skill): the required skills of each JD, or the first of them, pos from 0."""
    wanted = F.col("required_skills") if per_jd is None else F.slice("required_skills", 1, per_jd)
    return jds.select("jd_id", F.posexplode(wanted).alias("pos", "skill"))


def code_proofs(jds: DataFrame, files: DataFrame, per_jd: int | None = None) -> DataFrame:
    """Search results for the required skills of each JD; skills without hits drop out."""
    asked = proof_skills(jds, per_jd)
    return asked.join(best_hits(files, asked), "skill").select(
        "jd_id",
        "pos",
        F.col("skill").alias("requirement"),
        F.col("project").alias("project_name"),
        F.col("path").alias("file_path"),
        "kind",
        "line_no",
        "rank",
        F.col("snippet").alias("code_snippet"),
    )


def proof_counts(jds: DataFrame, files: DataFrame, per_jd: int | None = None) -> DataFrame:
    """Evidence found per JD; JDs without any have a row with 0.

    Counting needs no snippets, so no content is fetched here.
    """
    asked = proof_skills(jds, per_jd)
    best = for_skewed_join(top_files(files, asked).select("skill"), "skill")
    counted = asked.join(best, "skill").groupBy("jd_id").agg(F.count("*").alias("n_proofs"))
    return jds.select("jd_id").join(counted, "jd_id", "left").fillna(0, ["n_proofs"])
