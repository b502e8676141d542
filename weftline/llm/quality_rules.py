"""Rule filter as a short-circuit cascade (operator 10), with DataFrame functions only.

Every rule is a boolean expression that is true where a text must go.  On a bounded sample the operator
measures what each rule costs and how many texts it rejects, orders the rules by rejections per second and
puts them into one CASE expression: later (costly) rules run only for texts that no earlier rule rejected.
The order changes the time and never the verdict, as a text is kept if no rule rejects it.  Where the counts
of a text are wanted anyway, the rules read them and count nothing again.

Defined cases: a null or empty text has no words and fails ``too_short``; repeated rows each get their own
verdict; an empty table gives no rows; extra columns pass through, and the names of result columns replace
columns of the same name.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import WORD_RE, let

SYMBOLS = r"[#*$%&|<>]"
#: Rows of the sample on which costs and selectivities are measured.
SAMPLE_ROWS = 500
#: How often a rule is applied to a text while it is timed, and what no rule is held to be faster than (for all texts).
TIMES, LEAST_SECONDS = 8, 2.0**-8
SEED = 7
#: Longer texts are left out of the sample (and of nothing else), so that it stays small.
SAMPLE_TEXT_BYTES = 100_000
WINDOW = 3
#: What lies between words.
SPACE_RE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Facts:
    """What a rule sees: a text (never null), the array of its words, and its counts if they are there already."""

    text: Column
    words: Column
    counted: Column | None = None

    def __getitem__(self, name: str) -> Column:
        """A count by its name in ``COUNTS``; ``counted`` is a struct of those in ``REPORTED``."""
        return COUNTS[name](self.text, self.words) if self.counted is None or name not in REPORTED else self.counted[name]


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps the facts of a text to a boolean column."""

    name: str
    rejects: Callable[[Facts], Column]


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / self.seconds


def n_words(text: Column, words: Column) -> Column:
    return F.size(words).cast("long")


def word_chars(text: Column, words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column, words: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOLS)).cast("long")


def _worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD_RE))


def n_lines(text: Column, words: Column) -> Column:
    """Lines with a word: each is matched once, from its first word to its end."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D][^\n]*")).cast("long")


def n_dup_lines(text: Column, words: Column) -> Column:
    distinct = let(_worded_lines(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))
    return F.when(F.contains(text, F.lit("\n")), distinct).otherwise(F.lit(0)).cast("long")


def n_repeat_words(text: Column, words: Column) -> Column:
    """Words inside windows of three words that occur at least twice in the text.

    Windows are hashed.  Only where hashes repeat are they sorted with their positions, so that equal ones become
    neighbours; the covered words follow from the sorted positions.  Time is n log n in the words of a text,
    whatever repeats.
    """
    count = F.size(words)
    windows = F.slice(words, F.lit(1), F.greatest(count - (WINDOW - 1), F.lit(0)))
    hashes = F.transform(windows, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(placed: Column) -> Column:
        again = F.filter(
            placed,
            lambda x, i: (x["h"] == F.get(placed, i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(placed, i - 1)["h"])),
        )
        starts = F.sort_array(F.transform(again, lambda x: x["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(acc["end"], p)).alias("n")),
            lambda acc: acc["n"],
        )

    def repeated(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(placed, covered)).otherwise(F.lit(0))

    return F.when(count > WINDOW, let(hashes, repeated)).otherwise(F.lit(0)).cast("long")


def _matched(text: Column, kind: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, rf"\p{{{kind}}}+", ""))).cast("long")


def n_letters(text: Column, words: Column) -> Column:
    return _matched(text, "L")


def n_capitals(text: Column, words: Column) -> Column:
    return _matched(text, "Lu")


REPORTED = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words}
COUNTS = REPORTED | {"n_lines": n_lines, "n_letters": n_letters, "n_capitals": n_capitals}


def base_rules() -> list[Rule]:
    """The two rules that every text must pass."""
    return [
        Rule("too_short", lambda x: x["n_words"] < 50),
        Rule("repeats_itself", lambda x: 100 * x["n_repeat_words"] > 50 * x["n_words"]),
    ]


def default_rules() -> list[Rule]:
    """Lenient limits: a rule rejects only what no prose comes near."""
    return [
        Rule("symbols", lambda x: 5 * x["n_symbols"] > x["n_words"]),
        Rule("duplicate_lines", lambda x: (x["n_lines"] >= 4) & (10 * x["n_dup_lines"] > 3 * x["n_lines"])),
        Rule("word_length", lambda x: let(x["word_chars"], lambda n: (n < 2 * x["n_words"]) | (n > 15 * x["n_words"]))),
        Rule("few_letters", lambda x: 2 * x["n_letters"] < x["word_chars"]),
        Rule("capitals", lambda x: 2 * x["n_capitals"] > x["n_letters"]),
    ]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RE), "")


def _sampled(docs: DataFrame, text_col: str, rows: int) -> DataFrame:
    """About ``rows`` texts t drawn from the whole table, with their words w and counts c."""
    total = docs.count()
    drawn = docs if total <= rows else docs.sample(fraction=rows / total, seed=SEED)
    texts = drawn.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    # the draw has the bound already, but for chance
    fetched = texts.filter(F.octet_length("t") <= SAMPLE_TEXT_BYTES).limit(2 * rows).collect()
    worded = docs.sparkSession.createDataFrame(fetched, "t string").withColumn("w", _words(F.col("t")))
    counts = F.struct(*[count(F.col("t"), F.col("w")).alias(name) for name, count in REPORTED.items()])
    return worded.withColumn("c", counts).coalesce(1)


def measure(docs: DataFrame, rules: list[Rule], text_col: str = "text", rows: int = SAMPLE_ROWS, ready: bool = False) -> list[Measured]:
    """Seconds and rejected share of each rule on about ``rows`` texts of the whole table, best first.

    A job applies one rule ``TIMES`` times to every text, as the cascade does; planning and compilation fall into a
    first run, which does not count, and what a job costs without a rule is taken off.  ``ready``: the rules
    find the counts in ``REPORTED`` done, as in ``rule_report``.  Costs are compared by powers of two, so that the order
    does not follow noise; equals stay in the order given.  The table is read once more for the sample.
    """
    sample = _sampled(docs, text_col, rows).persist()
    facts = Facts(F.col("t"), F.col("w"), F.col("c") if ready else None)

    def seconds(rejects: Column) -> float:
        again = F.transform(F.sequence(F.lit(1), F.lit(TIMES)), lambda _: F.coalesce(rejects, F.lit(False)))
        job = sample.agg(F.sum(F.size(F.filter(again, lambda x: x))))
        taken = []
        for _ in range(3):
            began = time.perf_counter()
            job.collect()
            taken.append(time.perf_counter() - began)
        return min(taken[1:])

    try:
        total = sample.count()
        shares = sample.agg(F.count("*"), *[F.count(F.when(rule.rejects(facts), 1)) for rule in rules]).first()[1:]
        empty = seconds(F.col("t").isNull())
        found = []
        for rule, rejected in zip(rules, shares):
            spent = max((seconds(rule.rejects(facts)) - empty) / TIMES, LEAST_SECONDS)
            found.append(Measured(rule, 2.0 ** round(math.log2(spent)), rejected / max(total, 1)))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda m: (-m.worth, m.seconds))


def cascade(ordered: list[Rule], facts: Facts) -> Column:
    """Name of the first rule that rejects the text, else null; branches after it are not evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(ordered):
        out = F.when(F.coalesce(rule.rejects(facts), F.lit(False)), F.lit(rule.name)).otherwise(out)
    return out


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns as they were."""
    rules = base_rules() + default_rules() if rules is None else rules
    ordered = [m.rule for m in measure(docs, rules, text_col, sample_rows)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.filter(let(_words(text), lambda words: cascade(ordered, Facts(text, words))).isNull())


def rule_report(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Counts and verdict of every row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    ordered = [m.rule for m in measure(docs, default_rules(), text_col, sample_rows, ready=True)]
    text = F.coalesce(F.col(text_col), F.lit(""))

    def judged(words: Column) -> Column:
        counts = F.struct(*[count(text, words).alias(name) for name, count in REPORTED.items()])
        return let(counts, lambda c: verdict(Facts(text, words, c)))

    def verdict(facts: Facts) -> Column:
        failed = (facts["n_words"] < 50) | (100 * facts["n_repeat_words"] > 50 * facts["n_words"])
        kept = F.when(failed, F.lit(False)).otherwise(cascade(ordered, facts).isNull())
        return F.struct(*[facts[name].alias(name) for name in REPORTED], failed.alias("base_failed"), kept.alias("kept"))

    results = [*REPORTED, "base_failed", "kept"]
    passed = [c for c in docs.columns if c.lower() not in results]
    return docs.withColumn("__judged", let(_words(text), judged)).select(*passed, *[F.col(f"__judged.{name}").alias(name) for name in results])
