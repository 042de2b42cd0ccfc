r"""Quality rules, lines first, in DataFrame functions only.

Every line is judged alone: by its punctuation, as navigation, as boilerplate. Failing lines are removed, and a
document that loses too much of its text that way is rejected. Counts over the whole document reject it beforehand
when it is too short or repeats itself. All of it is a projection: no shuffle, nothing beside the row itself in memory.

Words are runs of characters other than ``\x20`` and ``\x09`` to ``\x0D``. Windows of words are compared by their
64-bit hash within one document.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnlens.llm.shared import quoted, unused_prefix

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of the words
SYMBOLS = "#*$%&|<>"
MOST_SYMBOLS = 10  # percent of a line's characters without white space
MOST_SHOUTS = 50  # ! and ? as percent of a line's words, for lines of SHOUT_WORDS and more
SHOUT_WORDS = 5
MENU_WORDS = 3  # unfinished lines of so few words are navigation
MOST_STUTTER = 50  # percent of a line's words that repeat the word before
BOILERPLATE_WORDS = 20  # a boilerplate phrase condemns a line of at most so many words
LEAST_LEFT = 50  # percent of the characters of lines with words

SPACES = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]"
CLOSERS = "\"'”’»)]"
FINISHED = (*".!?…:;。！？।؟",)
SEPARATORS = "|›»•·>"
SEPARATED = rf"\s[{SEPARATORS}]\s"
PHRASES = (
    "all rights reserved",
    "click here",
    "cookie",
    "enable javascript",
    "privacy policy",
    "share on",
    "sign in",
    "sign up",
    "subscribe to",
    "terms of use",
    "terms of service",
)
BOILERPLATE = "(?i)" + "|".join(PHRASES)


def without(text: Column, characters: str) -> Column:
    """The text without the given characters; one replacement each is much faster than a translation."""
    return functools.reduce(lambda left, c: F.replace(left, F.lit(c), F.lit("")), characters, text)


def bare(text: Column) -> Column:
    return without(text, SPACES)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def line_kept(line: Column, words: Column) -> Column:
    """Whether a line with words passes the rules; the dear ones are looked at last and seldom."""
    count = F.size(words)
    shouts = F.length(line) - F.length(without(line, "!?"))
    symbols = F.length(line) - F.length(without(line, SYMBOLS))
    punctuation = ((symbols > 0) & (100 * symbols > MOST_SYMBOLS * F.length(bare(line)))) | (
        (count >= SHOUT_WORDS) & (100 * shouts >= MOST_SHOUTS * count)
    )
    last = F.substring(F.rtrim(line, F.lit(SPACES + CLOSERS)), -1, 1)
    separators = F.length(line) - F.length(without(line, SEPARATORS))
    navigation = ((count <= MENU_WORDS) & ~last.isin(*FINISHED)) | (
        (separators >= 2) & (F.regexp_count(line, F.lit(SEPARATED)) >= 2)
    )
    following = F.zip_with(words, F.slice(words, 2, F.greatest(count, F.lit(1))), lambda a, b: a.eqNullSafe(b))
    stutter = F.size(F.filter(following, lambda same: same))
    boilerplate = ((count <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE)) | (100 * stutter > MOST_STUTTER * count)
    return ~(punctuation | navigation | boilerplate)


def placed_hashes(hashes: Column) -> Column:
    """Hashes with their places, sorted, so that equal ones lie together; none if all differ."""
    some = F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), hashes).otherwise(F.array().cast("array<bigint>"))
    return F.array_sort(F.transform(some, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def repeated_places(placed: Column) -> Column:
    """Places of the windows whose hash has an equal neighbour, in order."""
    rest = F.greatest(F.size(placed) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(placed, 1, rest), F.slice(placed, 2, rest), _both)
    return F.array_sort(F.array_distinct(F.flatten(pairs)))


def _both(a: Column, b: Column) -> Column:
    return F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))


def covered_words(places: Column, window: int = WINDOW) -> Column:
    """Words in windows at the given places, each once."""
    steps = F.zip_with(
        places,
        F.slice(places, 2, F.size(places)),
        lambda a, b: F.least(F.lit(window), F.coalesce(b - a, F.lit(window))),
    )
    return F.aggregate(steps, F.lit(0), lambda total, step: total + step).cast("long")


def quality(frame: DataFrame, text: str = "text") -> DataFrame:
    """Every row with its counts, ``base_failed``, ``kept`` and ``clean_text``; columns of these names are replaced.

    Counts: ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_dup_lines`` (lines with a word equal
    to an earlier line), ``n_repeat_words`` (words in windows found twice or more). ``clean_text`` is the text without
    failing lines; lines without a word stay, and a text none of whose lines fail stays as it is. NULL and empty
    texts have no words and fail. Repeated rows are judged alike; rows are neither joined nor reordered. Other columns
    stay, whatever their names; an empty table gives no rows. A text is held as a whole by its task.
    """
    others = [c for c in frame.columns if c.lower() not in OUTPUTS]
    kept_names = [quoted(c) for c in others]
    inner = unused_prefix(others)

    def own(name: str) -> Column:
        return F.col(inner + name)

    parts = frame.select(*kept_names, F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias(f"{inner}text"))
    cut = parts.select("*", F.split(own("text"), "\n").alias(f"{inner}lines"))
    cut = cut.select("*", F.transform(own("lines"), words_of).alias(f"{inner}line_words"))
    cut = cut.select("*", F.flatten(own("line_words")).alias(f"{inner}words"))
    count = F.size(own("words"))
    windows = F.when(
        count >= WINDOW,
        F.transform(
            F.sequence(F.lit(1), count - (WINDOW - 1)),
            lambda i: F.xxhash64(F.slice(own("words"), i, F.lit(WINDOW))),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    judged = cut.select(
        *kept_names,
        own("text"),
        count.cast("long").alias("n_words"),
        windows.alias(f"{inner}windows"),
        F.filter(
            F.zip_with(own("lines"), own("line_words"), lambda line, words: F.when(F.size(words) > 0, line)),
            F.isnotnull,
        ).alias(f"{inner}full"),
        F.filter(
            F.zip_with(
                own("lines"),
                own("line_words"),
                lambda line, words: F.when((F.size(words) == 0) | line_kept(line, words), line),
            ),
            F.isnotnull,
        ).alias(f"{inner}passed"),
    )
    judged = judged.withColumn(f"{inner}placed", placed_hashes(own("windows")))
    judged = judged.withColumn(f"{inner}places", repeated_places(own("placed")))
    solid = F.length(bare(own("text")))
    counted = judged.select(
        *kept_names,
        "n_words",
        solid.cast("long").alias("word_chars"),
        (F.length(own("text")) - F.length(without(own("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size(own("full")) - F.size(F.array_distinct(own("full")))).cast("long").alias("n_dup_lines"),
        covered_words(own("places")).alias("n_repeat_words"),
        F.array_join(own("passed"), "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    enough = 100 * F.length(bare(F.col("clean_text"))) >= LEAST_LEFT * F.col("word_chars")
    # A filter on the verdict must not be pushed below: it would judge every text twice, the inner steps many times.
    # Spark moves no filter past a generator, and this one makes one row of each.
    verdict = F.struct(*OUTPUTS[:5], failed.alias("base_failed"), (~failed & enough).alias("kept"), "clean_text")
    held = counted.select(*kept_names, F.explode(F.array(verdict)).alias(f"{inner}verdict"))
    return held.select(*kept_names, *(F.col(f"{inner}verdict.{c}").alias(c) for c in OUTPUTS))


OUTPUTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text",
]
