"""Line-first cleaning: rules per line, then a verdict on what is left.

Native: column functions only. Words are runs of anything but ASCII white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.llm.common import free_names, let, whole_text, words_of

# Phrases of page furniture, matched in the lower-cased line.
BOILERPLATE = ("all rights reserved", "apache license", "cookie policy", "copyright ©", "copyright (c)",
               "enable javascript", "licensed under", "lorem ipsum", "mit license", "privacy policy",
               "sign up for our newsletter", "spdx-license-identifier", "terms of service", "terms of use")

SYMBOLS = r"[#*$%&|<>]"
SEPARATORS = r"[|»›•·]"
MARKS = r"[.!?…:;。！？।॥؟۔։።]"
SHOUTS = r"[!?]"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _matches(text: Column, pattern: str) -> Column:
    """How many characters match a one-character pattern."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _line(line: Column, symbol_share: float, separators: int, shout_share: float, words_without_mark: int) -> Column:
    """The line with its number of words and whether it passes every rule.

    * navigation: fails with ``separators`` or more separators and one for four words at least
    * punctuation: fails when symbols outnumber ``symbol_share`` of the words, when exclamation and
      question marks outnumber ``shout_share`` of the words, or when a line of more than
      ``words_without_mark`` words has no sentence mark at all
    * boilerplate: fails when it holds a phrase of ``BOILERPLATE``
    """
    def furniture(lower: Column) -> Column:
        found = F.lit(False)
        for phrase in BOILERPLATE:
            found = found | F.contains(lower, F.lit(phrase))
        return found

    def counted(c: Column) -> Column:
        n, marks, bars = c["n"], c["marks"], c["bars"]
        passes = (~((bars >= separators) & (bars * 4 >= n)) & (marks <= n * symbol_share)
                  & (_matches(line, SHOUTS) <= n * shout_share)
                  & ~((n > words_without_mark) & ~F.rlike(line, F.lit(MARKS))) & ~let(F.lower(line), furniture))
        return F.struct(line.alias("line"), n.alias("n"), marks.alias("marks"), passes.alias("ok"))

    return let(F.struct(F.size(words_of(line)).alias("n"), _matches(line, SYMBOLS).alias("marks"),
                        _matches(line, SEPARATORS).alias("bars")), counted)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, the first one included.

    Windows are compared by a 64-bit hash of their words. Sorting brings equal
    windows together, so the work is n log n in the words of the text.
    """
    def marked(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                              lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("p")))
        return let(F.sort_array(windows), repeated)

    def repeated(s: Column) -> Column:
        again = F.filter(s, lambda x, j: F.get(s, j - 1)["h"].eqNullSafe(x["h"])
                         | F.get(s, j + 1)["h"].eqNullSafe(x["h"]))
        starts = F.sort_array(F.transform(again, lambda x: x["p"]))
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
                           lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"),
                                                 p.alias("last")))["n"]

    return F.when(F.size(words) < 4, 0).otherwise(marked(words))


def line_quality(docs: DataFrame, text: str = "text", max_loss: float = 0.5, symbol_share: float = 0.5,
                 separators: int = 2, shout_share: float = 0.5, words_without_mark: int = 12) -> DataFrame:
    """Add counts, the cleaned text and the verdict to every row.

    Added: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``clean_text`` (the passing lines),
    ``lost_words`` and ``kept``. A row is kept when the base passes and failing
    lines hold at most ``max_loss`` of its words. Columns of these names in the
    input are replaced; all others stay.

    A null or empty text has no words, so the base fails; ``clean_text`` is then
    empty. Repeated rows are judged alike. An empty table gives an empty one.
    The row alone decides: no shuffle.
    """
    body = whole_text(text)

    def counts(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long")
                        .alias("word_chars"), _repeat_words(w).cast("long").alias("n_repeat_words"))

    def lined(ls: Column) -> Column:
        return let(F.filter(ls, lambda x: x["n"] > 0), lambda full: F.struct(
            (F.size(full) - F.size(F.array_distinct(F.transform(full, lambda x: x["line"])))).cast("long")
            .alias("n_dup_lines"),
            F.aggregate(ls, F.lit(0), lambda a, x: a + x["marks"]).cast("long").alias("n_symbols"),
            F.array_join(F.transform(F.filter(ls, lambda x: x["ok"]), lambda x: x["line"]), "\n").alias("clean_text"),
            F.aggregate(F.filter(full, lambda x: ~x["ok"]), F.lit(0), lambda a, x: a + x["n"]).cast("long")
            .alias("lost_words")))

    lines = F.transform(F.split(body, "\n", -1),
                        lambda x: _line(x, symbol_share, separators, shout_share, words_without_mark))
    of_words, of_lines = free_names(docs, "__counts", "__lines")
    measured = docs.withColumns({of_words: let(words_of(body), counts), of_lines: let(lines, lined)})
    c, s = F.col(of_words), F.col(of_lines)
    failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
    return measured.withColumns({
        "n_words": c["n_words"], "word_chars": c["word_chars"], "n_symbols": s["n_symbols"],
        "n_dup_lines": s["n_dup_lines"],
        "n_repeat_words": c["n_repeat_words"], "base_failed": failed, "clean_text": s["clean_text"],
        "lost_words": s["lost_words"],
        "kept": ~failed & (s["lost_words"] <= max_loss * c["n_words"])}).drop(of_words, of_lines)
