"""Quality rules under weak supervision: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import BLANKS, stage

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
REPEAT_PERCENT = 50
GOOD, BAD, NONE = 1, -1, 0


def _let(value: Column, use) -> Column:
    """use(value) with value computed once a row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column) -> Column:
    """Words lying in a 3-word window that the text holds twice or more.

    Windows are hashed and sorted with their places; equal neighbours are repeats. Each repeated
    window then adds the words up to the next repeated one, three at most.
    """

    def windows(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(
            places, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p"))
        )

    def repeated(s: Column) -> Column:
        same = lambda x, i: x["h"] == F.get(s, i)["h"]
        return F.filter(s, lambda x, i: F.coalesce(same(x, i - 1), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False)))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    def count(w: Column) -> Column:
        places = _let(F.sort_array(windows(w)), lambda s: F.transform(repeated(s), lambda x: x["p"]))
        return _let(F.sort_array(places), covered)

    return F.when(F.size(words) < 6, F.lit(0).cast("long")).otherwise(_let(words, count))


def features(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc_id and the counts the rules look at (and the columns `carry`); one pass over the text, no shuffle.

    Null text: all counts 0. Lines end at line feeds; a line counts if it holds a word.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, BLANKS, "")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    count = lambda kept: F.size(F.filter(F.col("_words"), kept)).cast("long")
    counted = docs.select("doc_id", *(F.col(c).alias(f"_carry_{c}") for c in carry or ()), bare.alias("_bare"), words.alias("_words"), lines.alias("_lines"))
    return counted.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length("_bare").cast("long").alias("word_chars"),
        (F.length("_bare") - F.length(F.translate("_bare", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_words")).alias("n_repeat_words"),
        F.regexp_count("_bare", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("_bare", F.lit(r"[\p{L}\p{N}]")).cast("long").alias("n_plain"),
        F.regexp_count("_bare", F.lit(r"[!?]")).cast("long").alias("n_shouts"),
        count(lambda w: w == "|").alias("n_bars"),
        *(F.col(f"_carry_{c}").alias(c) for c in carry or ()),
    )


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))


def rules() -> dict[str, Column]:
    """Name -> vote of a rule over the columns of features(): 1 good, -1 bad, 0 no opinion."""

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, BAD).when(good, GOOD).otherwise(NONE)

    mean = _share("word_chars", "n_words")
    return {
        "word_length": vote((mean < 1.5) | (mean > 20), mean.between(2.5, 12)),
        "plain": vote(_share("n_plain", "word_chars") < 0.75, _share("n_plain", "word_chars") > 0.85),
        "symbols": vote(_share("n_symbols", "word_chars") > 0.05, F.col("n_symbols") == 0),
        "lines": vote((F.col("n_dup_lines") >= 2) & (_share("n_dup_lines", "n_lines") > 0.3), F.col("n_dup_lines") == 0),
        "repeats": vote(_share("n_repeat_words", "n_words") > 0.35, _share("n_repeat_words", "n_words") < 0.1),
        "capitals": vote((F.col("n_plain") >= 10) & (_share("n_upper", "n_plain") > 0.5), _share("n_upper", "n_plain") < 0.2),
        "shouting": vote(_share("n_shouts", "n_words") > 0.4, _share("n_shouts", "n_words") < 0.05),
        "table": vote(_share("n_bars", "n_words") > 0.2, F.col("n_bars") == 0),
    }


def estimate(counts: dict[tuple[int, ...], int], rounds: int = 60, prior_good: float = 0.9) -> dict[tuple[int, ...], float]:
    """Posterior probability of good per vote pattern, by expectation-maximisation.

    Each rule has, for good and for bad texts, a probability of each vote (abstaining included);
    votes are independent given the class. Starts from: any bad vote makes a text probably bad.
    At most 3**rules patterns, whatever the number of texts. Add-half smoothing keeps every
    probability above 0.
    """
    if not counts:
        return {}
    posterior = {p: 0.1 if BAD in p else 0.95 for p in counts}
    size = len(next(iter(counts)))
    total = sum(counts.values())
    for _ in range(rounds):
        good = sum(n * posterior[p] for p, n in counts.items())
        weight = {True: good, False: total - good}
        chance = {}
        for r in range(size):
            for cls in (True, False):
                for v in (GOOD, BAD, NONE):
                    mass = sum(n * (posterior[p] if cls else 1 - posterior[p]) for p, n in counts.items() if p[r] == v)
                    chance[r, cls, v] = (mass + 0.5) / (weight[cls] + 1.5)
        share = (good + prior_good) / (total + 1)
        for p in counts:
            odds = math.log(share) - math.log(1 - share)
            odds += sum(math.log(chance[r, True, v]) - math.log(chance[r, False, v]) for r, v in enumerate(p))
            posterior[p] = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
    return posterior


def judge(docs: DataFrame, threshold: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """Base counts, base_failed, the posterior `quality` and `kept` for every row of docs.

    The rules of rules() vote on each text; estimate() weighs the vote patterns (counted before
    the shuffle, at most 3**8 rows for the driver); a text is kept if it passes the base limits
    and its probability of being good reaches the threshold.
    base_failed: fewer than 50 words, or over half of the words repeat. Null and empty texts have
    no words and fail. Repeated rows each get their row. Columns named in carry are passed on, others ignored. An
    empty table gives none.
    """
    names = list(rules())
    voted = stage(features(docs, carry).withColumns({f"vote_{name}": vote for name, vote in rules().items()}), "quality-votes")
    votes = [f"vote_{name}" for name in names]
    failed = (F.col("n_words") < LEAST_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(REPEAT_PERCENT) * F.col("n_words"))
    counts = {tuple(r[v] for v in votes): r["n"] for r in voted.groupBy(*votes).agg(F.count("*").alias("n")).collect()}
    posterior = estimate(counts)
    schema = ", ".join([*(f"{v} int" for v in votes), "quality double"])
    known = docs.sparkSession.createDataFrame([(*p, q) for p, q in sorted(posterior.items())], schema)
    return (
        voted.join(F.broadcast(known), votes)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    )
