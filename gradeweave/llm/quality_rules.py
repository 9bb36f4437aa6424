"""Quality rules: a table of thresholds compiled into one projection.

Only built-in functions run here. Defined results: a null or empty text has no
words, counts of zero and fails the base rule; repeated rows are judged each on
its own; columns besides the text are not looked at; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeweave.llm.common import WHITE, let, words

SYMBOLS = "#*$%&|<>"
#: Frequent words of the languages served, as they stand between white space.
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "are", "as", "with", "he", "be", "at",
    "by", "this", "from", "or", "an", "not", "have", "which", "you", "had", "but",
    "de", "la", "le", "les", "et", "des", "un", "une", "en", "du", "que", "est", "pour", "dans", "qui", "sur", "pas",
    "au", "ce", "il", "elle", "aux", "par",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "dem", "nicht", "ein", "eine", "ist", "im", "auf",
    "für", "es", "als", "auch", "an",
    "el", "los", "y", "las", "por", "con", "para", "al", "lo", "como", "del", "se", "su", "no", "más",
)
#: The same with one mark behind them: looked up whole, a word needs no cutting.
STOP_FORMS = tuple(w + mark for w in STOP_WORDS for mark in ("", ".", ",", ";", ":"))


@dataclass(frozen=True)
class Threshold:
    """A metric must lie in [least, most]; a limit left out does not hold."""

    metric: str
    least: float | None = None
    most: float | None = None


#: Production thresholds. A text without words fails the base rule before them.
THRESHOLDS = (
    Threshold("mean_word_chars", 2.0, 12.0),
    Threshold("symbol_ratio", most=0.1),
    Threshold("stop_word_ratio", least=0.06),
    Threshold("dup_line_ratio", most=0.5),
)


def _covered(starts: Column) -> Column:
    """Places that windows of three cover, given their first places in order."""
    done = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["total"] + s + 3 - F.greatest(s, a["end"])).alias("total"), (s + 3).alias("end")
        ),
    )
    return done["total"]


def _repeated_starts(windows: Column) -> Column:
    """First places of the windows, given sorted by text, that stand beside an equal one."""
    same = lambda x, other: F.coalesce(other["w"] == x["w"], F.lit(False))
    return F.array_sort(F.transform(
        F.filter(windows, lambda x, k: same(x, F.get(windows, k - 1)) | same(x, F.get(windows, k + 1))),
        lambda x: x["i"],
    ))


def repeat_words(ws: Column) -> Column:
    """Words in three-word windows that the text holds twice or more.

    Windows are told apart by a hash first: as many hashes as windows say that all differ. Only other texts have their
    windows spelt out and sorted.
    """
    window = lambda i: [F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)]
    places = F.sequence(F.lit(0), F.size(ws) - 3)
    hashes = F.transform(places, lambda i: F.xxhash64(*window(i)))
    spelt = F.transform(places, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("w"), i.alias("i")))
    counted = F.when(
        F.size(F.array_distinct(hashes)) < F.size(ws) - 2, let(F.array_sort(spelt), lambda s: _covered(_repeated_starts(s))),
    ).otherwise(0)
    return F.when(F.size(ws) < 4, 0).otherwise(counted)


def _counts(text: Column) -> Column:
    """All counts of one text, its words split once."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(words(text), lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, f"{WHITE}+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda v: F.size(v) - F.size(F.array_distinct(v))).cast("long").alias("n_dup_lines"),
        repeat_words(ws).cast("long").alias("n_repeat_words"),
        F.size(F.filter(ws, lambda w: F.lower(w).isin(*STOP_FORMS))).cast("long").alias("n_stop_words"),
        F.size(lines).cast("long").alias("n_lines"),
    ))


def _metrics(c: Column) -> dict[str, Column]:
    share = lambda a, b: c[a] / F.greatest(c[b], F.lit(1))
    return {
        "mean_word_chars": share("word_chars", "n_words"),
        "symbol_ratio": share("n_symbols", "word_chars"),
        "stop_word_ratio": share("n_stop_words", "n_words"),
        "dup_line_ratio": share("n_dup_lines", "n_lines"),
    }


def compiled(counts: Column, thresholds: tuple[Threshold, ...] = THRESHOLDS) -> Column:
    """The table of thresholds as one condition."""
    metrics, conditions = _metrics(counts), [F.lit(True)]
    for t in thresholds:
        if t.least is not None:
            conditions.append(metrics[t.metric] >= t.least)
        if t.most is not None:
            conditions.append(metrics[t.metric] <= t.most)
    return reduce(lambda a, b: a & b, conditions)


def judge(text: Column, thresholds: tuple[Threshold, ...] = THRESHOLDS) -> Column:
    """Counts and verdict of a text as one struct."""
    def verdict(c: Column) -> Column:
        failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
        fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        return F.struct(
            *[c[f].alias(f) for f in fields],
            failed.alias("base_failed"),
            (~failed & compiled(c, thresholds)).alias("kept"),
        )

    return let(_counts(text), verdict)


def quality_report(docs: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """doc_id with counts and verdict of every document."""
    return docs.select("doc_id", judge(F.col("text"), thresholds).alias("judged")).select("doc_id", "judged.*")


def keep_quality(docs: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    return docs.filter(judge(F.col("text"), thresholds)["kept"])
