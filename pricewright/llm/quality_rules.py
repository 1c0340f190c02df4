"""Quality rules: a table of thresholds compiled into one projection.

Every measure and every rule is a built-in expression over the row's own text:
no user function, no shuffle, no state. A text costs time in proportion to its
length (times the logarithm for the sort of its three-word windows).

Defined cases: a null or empty text has no words and fails the base rules;
ratios over zero words or lines are null and a null ratio breaks no rule; input
columns pass through untouched, except that measures replace columns of the
same name; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Blank characters: space, tab, line feed, vertical tab, form feed, return.
BLANK_CHARS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which "
    "der die das und ist von mit den zu ein eine nicht im auf sich für dem des auch es "
    "le la les de des et un une du en que qui dans est pour pas sur au avec il "
    "el los las del y por con una su para al lo como más no se que en"
).split()


@dataclass(frozen=True)
class Rule:
    """A row fails when ``measure / per`` is below ``low`` or above ``high``."""

    name: str
    measure: str
    per: str | None = None
    low: float | None = None
    high: float | None = None


# The thresholds in use. The base pair is fixed by contract, the others are choices.
BASE_RULES = (
    Rule("too_few_words", "n_words", low=50),
    Rule("repeated_windows", "n_repeat_words", "n_words", high=0.5),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", low=2.0, high=15.0),
    Rule("symbols", "n_symbols", "n_words", high=0.3),
    Rule("stop_words", "n_stop_words", "n_words", low=0.01),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
)


def _let(value: Column, body) -> Column:
    """``body`` over ``value`` computed once, also inside its lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK_RUN), lambda w: w != "")


def repeated_words(w: Column) -> Column:
    """Words inside three-word windows that occur at least twice in ``w``.

    The windows' hashes are sorted with their places; equal neighbours mark
    places, and sorted places tell how many words their windows cover.
    """
    return _let(w, _repeated_words)


def _repeated_words(w: Column) -> Column:
    grams = F.when(
        F.size(w) >= 3,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size(w) - 3),
                lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
            )
        ),
    )
    places = _let(
        grams,
        lambda g: F.sort_array(
            F.transform(
                F.filter(
                    g,
                    lambda x, k: F.coalesce(x["h"] == F.get(g, k - 1)["h"], F.lit(False))
                    | F.coalesce(x["h"] == F.get(g, k + 1)["h"], F.lit(False)),
                ),
                lambda x: x["i"],
            )
        ),
    )
    covered = _let(
        places,
        lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
            F.lit(0),
            lambda a, b: a + b,
        ),
    )
    return F.coalesce(covered, F.lit(0)).cast("long")


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The measures of every text as columns, and ``__row``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    split = docs.withColumn("__words", words(whole)).withColumn(
        "__lines", F.filter(F.split(whole, "\n"), lambda x: F.trim(x, F.lit(BLANK_CHARS)) != "")
    )
    n_chars = F.char_length(whole)
    return split.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.char_length(F.translate(whole, BLANK_CHARS, "")).cast("long"),
            "n_symbols": (n_chars - F.char_length(F.translate(whole, SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("__words")),
            "n_stop_words": F.size(F.filter("__words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
            # Keeps a later filter on the measures from being pushed below them, which
            # would compute them anew for every mention.
            "__row": F.monotonically_increasing_id(),
        }
    ).drop("__words", "__lines")


def broken(rule: Rule) -> Column:
    """Whether a row breaks the rule; bounds are compared without dividing."""
    per = F.col(rule.per).cast("double") if rule.per else F.lit(1.0)
    tests = []
    if rule.low is not None:
        tests.append(F.col(rule.measure) < per * rule.low)
    if rule.high is not None:
        tests.append(F.col(rule.measure) > per * rule.high)
    test = tests[0] if len(tests) == 1 else tests[0] | tests[1]
    return F.coalesce(test & (per > 0), F.lit(False))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Measures, ``base_failed``, the names of the broken rules, and ``kept``."""
    measured = with_measures(docs, text)
    base_failed = F.lit(False)
    for rule in base:
        base_failed = base_failed | broken(rule)
    names = F.filter(F.array(*[F.when(broken(r), F.lit(r.name)) for r in rules]), lambda n: n.isNotNull())
    return measured.withColumns({"base_failed": base_failed, "broken_rules": names}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("broken_rules") == 0) & (F.col("__row") >= 0)
    ).drop("__row")
