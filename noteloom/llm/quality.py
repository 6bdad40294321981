"""Quality rules by weak supervision, in DataFrame and SQL functions only.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the counts of vote patterns (at most
3 ** rules of them, whatever the number of documents) estimates how often each rule is right on good and on bad
documents and the share of good ones; a document is kept if it passes the base rule and its posterior probability of
being good is at least a half.

Null texts have no words; texts without words fail the base rule. Repeated rows and ids are judged each. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, numbered, only, table, tidied

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: All but the characters that are counted one by one.
COUNTED = r"[^A-Z0-9#*$%&|<>!]+"
#: Frequent short words of English, French, German and Spanish.
STOPWORDS = """the of and to in is that it for was on are as with be by this from at or an a he not which have
le la les de des du et un une en que qui est pour dans par sur au ce pas plus
der die das und ist von den mit zu ein eine nicht sich auf im dem es als auch für
el los las y del se una por con no para su al lo como más o""".split()  # fmt: skip
RULES = ("length", "symbols", "duplicate_lines", "repeated_words", "word_length", "capitals", "stopwords", "marks", "digits")
#: Expectation-maximisation goes on until no estimate moves by TOLERANCE; ROUNDS only ends what would never settle, with a warning.
ROUNDS, TOLERANCE = 500, 1e-4


def with_features(documents: DataFrame, prefix: str = "q_") -> DataFrame:
    """documents with the measures of their texts in columns that start with prefix.

    Arrays that a lambda reads more than once are columns of a step before it, so that they are built once a row.
    """
    p = lambda name: f"{prefix}{name}"
    c = lambda name: F.col(f"{prefix}{name}")
    keep = [F.col(f"`{name}`") for name in documents.columns]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = documents.select(*keep, text.alias(p("text")))
    df = df.select(
        *keep,
        F.filter(F.split(c("text"), BLANK), lambda w: w != "").alias(p("words")),
        F.filter(F.split(c("text"), "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "").alias(p("lines")),
        F.regexp_replace(c("text"), COUNTED, "").alias(p("counted")),  # usually short
    )
    without = lambda chars: F.length(c("counted")) - F.length(F.translate(c("counted"), chars, ""))
    df = df.select(
        *keep,
        F.size(c("words")).cast("long").alias(p("n_words")),
        F.length(F.array_join(c("words"), "")).cast("long").alias(p("word_chars")),
        without(SYMBOLS).cast("long").alias(p("n_symbols")),
        F.size(c("lines")).cast("long").alias(p("n_lines")),
        (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long").alias(p("n_dup_lines")),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias(p("capitals")),
        without("0123456789").alias(p("digits")),
        without("!|").alias(p("marks")),
        F.size(F.filter(c("words"), lambda w: w.isin(STOPWORDS))).alias(p("stopwords")),
        F.transform(c("words"), lambda w: F.xxhash64(w)).alias(p("hashes")),
    )
    names = [p(n) for n in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "capitals", "digits", "marks", "stopwords")]
    starts = F.sequence(F.lit(0), (c("n_words") - 5).cast("int"))
    windows = F.transform(starts, lambda i: F.xxhash64(*(F.get(c("hashes"), i + k) for k in range(5))))
    df = df.select(*keep, *names, F.when(c("n_words") >= 5, windows).alias(p("windows")))
    # only texts in which a window repeats go on: their windows are sorted with their places
    some = F.size(F.array_distinct(c("windows"))) < F.size(c("windows"))
    pairs = F.sort_array(F.transform(c("windows"), lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    df = df.select(*keep, *names, F.when(some, pairs).alias(p("pairs")))
    same = lambda e, j: F.coalesce(e["k"] == F.get(c("pairs"), j)["k"], F.lit(False))
    found = F.filter(c("pairs"), lambda e, j: same(e, j - 1) | same(e, j + 1))
    df = df.select(*keep, *names, F.when(c("pairs").isNotNull(), F.sort_array(F.transform(found, lambda e: e["i"]))).alias(p("places")))
    step = F.transform(c("places"), lambda x, j: F.least(F.lit(5), F.coalesce(F.get(c("places"), j + 1) - x, F.lit(5))))
    covered = F.when(c("places").isNotNull(), F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))
    return df.select(*keep, *names, covered.alias(p("n_repeat_words")))


def base_failed(prefix: str = "q_") -> Column:
    n = F.col(f"{prefix}n_words")
    return (n < 10) | (100 * F.col(f"{prefix}n_repeat_words") > 20 * n)


def votes(prefix: str = "q_") -> dict[str, Column]:
    c = lambda name: F.col(f"{prefix}{name}")
    n, chars = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("word_chars"), F.lit(1))

    def vote(value: Column, good: Column, bad: Column) -> Column:
        return F.when(good, 1).when(bad, -1).otherwise(0)

    def share(value: Column, good: float, bad: float, enough: Column | None = None) -> Column:
        out = vote(value, value <= good, value >= bad)
        return out if enough is None else F.when(enough, out).otherwise(0)

    words = n >= 20
    return {
        "length": vote(n, n >= 50, n < 20),
        "symbols": share(c("n_symbols") / chars, 0.005, 0.03),
        "duplicate_lines": share(c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)), 0.05, 0.3, c("n_lines") >= 3),
        "repeated_words": share(c("n_repeat_words") / n, 0.05, 0.15, words),
        "word_length": F.when((chars / n < 2.5) | (chars / n > 14), -1).otherwise(0),
        "capitals": F.when(c("capitals") / chars >= 0.4, -1).otherwise(0),
        "stopwords": F.when(words, vote(n, c("stopwords") / n >= 0.1, c("stopwords") / n <= 0.02)).otherwise(0),
        "marks": share(c("marks") / n, 0.02, 0.2),
        "digits": F.when(c("digits") / chars >= 0.3, -1).otherwise(0),
    }


def posterior(model: dict, prefix: str = "q_v_") -> Column:
    """Probability of being good, given the votes.

    The weights are one array, which compiled code refers to and does not contain: each round runs the same code.
    """
    weights = [math.log(model["good"] / (1 - model["good"]))]
    for on_good, on_bad in model["accuracy"].values():
        weights += [math.log((1 - on_good) / on_bad), 0.0, math.log(on_good / (1 - on_bad))]
    w = F.lit(weights)
    logit = F.get(w, F.lit(0))
    for k, rule in enumerate(model["accuracy"]):
        logit = logit + F.get(w, F.col(prefix + rule).cast("int") + (3 * k + 2))
    return 1 / (1 + F.exp(-logit))


def fit(patterns: DataFrame, rounds: int = ROUNDS, prefix: str = "q_v_") -> dict:
    """patterns: a row for each pattern of votes and its count n. Expectation and maximisation, one small aggregation a round.

    Accuracies stay between 0.6 and 0.99, so that the classes keep their names; they begin at 0.8, as does the share of good documents.
    """
    model = {"good": 0.8, "accuracy": {rule: (0.8, 0.8) for rule in RULES}}
    votes_ = F.array(*(F.col(prefix + r) for r in RULES))
    for _ in range(rounds):
        each = patterns.select("n", posterior(model, prefix).alias("p"), F.posexplode(votes_).alias("rule", "vote"))
        got = {(r.rule, r.vote): (r.good, r.all - r.good) for r in each.groupBy("rule", "vote").agg(F.sum(F.col("n") * F.col("p")).alias("good"), F.sum("n").alias("all")).collect()}
        if not got:
            break
        good, bad = (sum(v[k] for (rule, _), v in got.items() if rule == 0) for k in (0, 1))

        def share(rule: int, vote: int, k: int, got: dict = got) -> float:
            right, wrong = got.get((rule, vote), (0.0, 0.0))[k], got.get((rule, -vote), (0.0, 0.0))[k]
            return min(0.99, max(0.6, (right + 8) / (right + wrong + 10)))

        new = {"good": min(0.99, max(0.01, good / (good + bad))), "accuracy": {r: (share(i, 1, 0), share(i, -1, 1)) for i, r in enumerate(RULES)}}
        moved = max(abs(new["good"] - model["good"]), *(abs(a - b) for r in RULES for a, b in zip(new["accuracy"][r], model["accuracy"][r], strict=True)))
        model = new
        if moved < TOLERANCE:
            break
    else:
        warnings.warn(f"the rules' accuracies still moved by {TOLERANCE} or more after {rounds} rounds", stacklevel=2)
    return model


def count_patterns(judged: DataFrame, prefix: str = "q_v_") -> DataFrame:
    return materialize(judged.groupBy(*(prefix + r for r in RULES)).agg(F.count(F.lit(1)).alias("n")), "vote-patterns")


def judge(documents: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, dict]:
    """documents (and any columns) with measures q_*, votes q_v_*, q_base_failed, q_posterior and q_kept; and the model.

    The judged rows, texts left out, are written once; their patterns and the verdicts are read from there.
    """
    measured = with_features(documents).drop("text")
    judged = materialize(measured.select("*", *(v.cast("tinyint").alias(f"q_v_{r}") for r, v in votes().items())), "votes")
    model = fit(count_patterns(judged), rounds)
    return judged.select("*", base_failed().alias("q_base_failed"), posterior(model).alias("q_posterior")).withColumn("q_kept", ~F.col("q_base_failed") & (F.col("q_posterior") >= 0.5)), model


def filter_documents(documents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The documents that are kept, with their own columns, whatever their names.

    Texts are measured once; what is kept is told by 128 bits of the text's hash, so that equal texts share a verdict.
    """
    rows, at = numbered(documents)
    text = F.col(at["text"])
    marks = {"mark_0": F.xxhash64(text), "mark_1": F.xxhash64(F.lit(1), text)}

    def kept() -> DataFrame:
        measured = with_features(rows.select(text.alias("text"), *(c.alias(n) for n, c in marks.items())))
        voted = materialize(measured.select(*marks, base_failed().alias("q_base_failed"), *(v.cast("tinyint").alias(f"q_v_{r}") for r, v in votes().items())), "votes")
        model = fit(count_patterns(voted), rounds)
        return voted.where(~F.col("q_base_failed") & (posterior(model) >= 0.5)).select(*marks).distinct()

    return rows.withColumns(marks).join(tidied("kept-texts", kept), list(marks), "left_semi").select(*at.values()).toDF(*documents.columns)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = judge(only(table(spark, sf_dir, "documents"), doc_id="long", text="string"))
    return judged.select("doc_id", *(F.col(f"q_{n}").alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")), F.col("q_kept").alias("kept"), F.col("q_posterior").alias("posterior"))


QUERIES = {"op4_quality_rules": op4}
ORACLES: dict[str, str] = {}
__all__ = ["filter_documents", "fit", "judge", "op4"]
