"""Priority rules: which apply, which match, and what they decide."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.keys import RULE_CRITERIA
from ledgerloom.functions.text import normalize_text
from ledgerloom.sources.store import stage_shared
from ledgerloom.operators.skew import BROADCAST_ROWS_MAX, hot_keys, lookup, lookup_dimension

# Longer lists of rules are not carried along with the tuples they belong to.
FEW_IDS = 16
# Lists of so many ids in all are broadcast.
BROADCAST_IDS_MAX = 1_000_000
PLACES = "\x1e"

# Criterion -> transaction column it is compared with.
MATCHED_COLUMNS = {
    "description_exact": "description_normalized",
    "merchant_exact": "merchant_name",
    "counterparty_exact": "counterparty_name",
    "source_institution": "source_institution",
    "card_alias": "card_alias",
}


def active_categories(categories: DataFrame) -> DataFrame:
    return categories.where("is_active")


def with_category(rules: DataFrame, categories: DataFrame) -> DataFrame:
    """Rules with category_name and category_active (null without a category)."""
    names = categories.select(
        F.col("id").alias("category_id"),
        F.col("name").alias("category_name"),
        F.col("is_active").alias("category_active"),
    )
    # Few categories and many rules: a category that holds most rules must not be one task.
    return lookup_dimension(rules, names, ["category_id"], ["id"])


def usable_rules(rules: DataFrame, categories: DataFrame) -> DataFrame:
    return (
        with_category(rules, categories)
        .where("is_enabled and (category_id is null or category_active)")
        .select(*rules.columns, "category_name")
    )


def criteria_mask(rules: DataFrame) -> Column:
    """Bit per criterion that is set; an empty criterion is set, a null one is not."""
    return reduce(
        lambda a, b: a + b,
        [
            F.when(F.col(name).isNotNull(), F.lit(1 << bit)).otherwise(F.lit(0))
            for bit, name in enumerate(RULE_CRITERIA)
        ],
    )


def _no_ids() -> Column:
    return F.array().cast("array<string>")


def best_rules_by_key(rules: DataFrame) -> DataFrame:
    """One row per (mask, criterion values): the rules that could win for that key.

    A rule without any criterion matches nothing.

    A lower priority with equal criteria can never win, so keeping the top priority
    loses nothing. The evidence list is a union of ids, built map-side. ``outcome`` and
    ``last_outcome`` are the smallest and largest one; they differ if the rules disagree.
    """
    masked = rules.withColumn("mask", criteria_mask(rules)).where("mask > 0")
    keyed = masked.select(
        "mask",
        rule_key(RULE_CRITERIA).alias("rule_key"),
        F.col("priority").alias("p"),
        F.col("id").cast("string").alias("rule_id"),
        F.struct("nature", "category_id").alias("o"),
    )
    key = ["mask", "rule_key"]
    top = keyed.groupBy(*key).agg(F.max("p").alias("p"))
    # Distinct ids per key: the evidence a reviewer is shown, as long as it really is.
    return (
        keyed.join(top, [*key, "p"], "left_semi")
        .groupBy(*key)
        .agg(
            F.max("p").alias("priority"),
            F.sort_array(F.collect_set("rule_id")).alias("rule_ids"),
            F.min("o").alias("outcome"),
            F.max("o").alias("last_outcome"),
        )
    )


def rule_key(columns: list[str], mask: int | None = None) -> Column:
    """Text of the criterion values; unset criteria are left out by position."""
    parts = []
    for bit, name in enumerate(columns):
        used = mask is None or mask >> bit & 1
        parts.append(
            F.coalesce(F.concat(F.lit(f"{bit}="), F.col(name)), F.lit("")) if used else F.lit("")
        )
    return F.concat_ws("\x1f", *parts)


def propose(
    transactions: DataFrame, rules: DataFrame, evidence: Callable[[Column], dict[str, Column]] | None = None
) -> DataFrame:
    """One proposal per transaction: classified, or pending review with a reason.

    Transactions are first reduced to the different tuples of the values that rules compare. Each
    tuple asks once for every set of criteria that rules use (at most 31), by one equality join
    with the best rules per key, whatever the number of sets; what is decided for a tuple then
    goes back to its transactions. No pair of transaction and rule is ever materialised.

    Lists of more than FEW_IDS rules are not carried along: a tuple names the keys whose lists it
    takes, and the list of each different choice of keys is made once. ``matched_rule_ids`` is put
    together at the end; with ``evidence`` the columns it makes of the list come instead, worked
    out once per different list.
    """
    best = stage_shared(best_rules_by_key(rules), "best-rules")
    # At most 31 rows come back, whatever the number of rules.
    sizes = {row["mask"]: row["count"] for row in best.groupBy("mask").count().collect()}
    compared = [f"_{name}" for name in RULE_CRITERIA]
    facts = transactions.withColumns({f"_{name}": normalize_text(F.col(column)) for name, column in MATCHED_COLUMNS.items()})
    facts = facts.withColumn("_tuple", rule_key(compared))
    tuples = stage_shared(facts.groupBy("_tuple", *compared).agg(F.count(F.lit(1)).alias("_n")), "rule-tuples")
    asked = []
    for mask in sorted(sizes):
        used = [f"_{name}" for bit, name in enumerate(RULE_CRITERIA) if mask >> bit & 1]
        complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in used])
        asked.append(F.when(complete, F.struct(F.lit(mask).alias("mask"), rule_key(compared, mask).alias("rule_key"))))
    questions = F.array_compact(F.array(*asked)) if asked else F.array().cast("array<struct<mask:int,rule_key:string>>")
    each = tuples.select("_tuple", F.explode(questions).alias("q")).select("_tuple", "q.mask", "q.rule_key")
    many = F.size("rule_ids") > FEW_IDS
    # Matched keys hold normalised text, which has no separator.
    place = F.concat_ws(":", F.col("mask").cast("string"), "rule_key")
    narrow = best.select(
        "mask",
        "rule_key",
        "priority",
        "outcome",
        "last_outcome",
        F.get("rule_ids", F.lit(0)).alias("first_id"),
        F.when(many, _no_ids()).otherwise(F.col("rule_ids")).alias("few"),
        F.when(many, place).alias("place"),
    )
    hits = each.join(F.broadcast(narrow) if sum(sizes.values()) <= BROADCAST_ROWS_MAX else narrow, ["mask", "rule_key"])
    # At most one hit per set of criteria.
    hit = F.struct(*[c for c in narrow.columns if c not in ("mask", "rule_key")])
    found = hits.groupBy("_tuple").agg(F.collect_list(hit).alias("found"))
    top = F.array_max(F.transform("found", lambda h: h["priority"]))
    won = found.withColumn("top", top).select("_tuple", F.filter("found", lambda h: h["priority"] == F.col("top")).alias("won"))

    def each_won(name: str) -> Column:
        return F.transform("won", lambda h: h[name])

    outcome = F.array_min(each_won("outcome"))
    agreed = outcome.eqNullSafe(F.array_max(each_won("last_outcome")))
    decided = stage_shared(
        won.select(
            "_tuple",
            agreed.alias("_agreed"),
            F.when(agreed, outcome).alias("_outcome"),
            F.when(agreed, F.array_min(each_won("first_id"))).alias("_winner"),
            F.sort_array(F.flatten(each_won("few"))).alias("_few"),
            F.array_join(F.sort_array(F.array_compact(each_won("place"))), PLACES).alias("_places"),
        ),
        "rule-decisions",
    )
    chosen = decided.select("_places").where("_places <> ''").distinct()
    by_place = chosen.select("_places", F.explode(F.split("_places", PLACES)).alias("place"))
    lists = stage_shared(
        by_place.join(best.where(many).select(place.alias("place"), "rule_ids"), "place")
        .groupBy("_places")
        .agg(F.flatten(F.collect_list("rule_ids")).alias("_many")),
        "rule-evidence",
    )
    total = lists.agg(F.coalesce(F.sum(F.size("_many")), F.lit(0)).alias("n")).first().n
    few_lists = total <= BROADCAST_IDS_MAX

    def matched(rows: DataFrame, spread_by: list[str]) -> DataFrame:
        both = F.concat(F.coalesce("_few", _no_ids()), F.coalesce("_many", _no_ids()))
        return lookup_dimension(rows, lists, ["_places"], spread_by, few_lists).withColumn("_ids", F.sort_array(both))

    answers, shown = decided, {}
    if evidence is not None:
        shown = evidence(F.col("_ids"))
        key = ["_few", "_places"]
        made = matched(decided.select(*key).distinct(), key).select(*key, *[c.alias(name) for name, c in shown.items()])
        answers = lookup_dimension(decided, stage_shared(made, "rule-evidence-shown"), key, ["_tuple"])
    resolved = lookup(facts, answers, ["_tuple"], ["id"], hot_keys(tuples, ["_tuple"], "_n"))
    if evidence is None:
        resolved = matched(resolved, ["id"])
        listed = [F.col("_ids").alias("matched_rule_ids")]
    else:
        # What evidence makes of no rules at all.
        nothing = evidence(_no_ids())
        listed = [F.when(F.col("_agreed").isNull(), nothing[name]).otherwise(F.col(name)).alias(name) for name in shown]
    return resolved.select(
        *transactions.columns,
        F.when(F.col("_agreed"), F.lit("classified")).otherwise(F.lit("pending_review")).alias("status"),
        F.col("_outcome")["nature"].alias("nature"),
        F.col("_outcome")["category_id"].alias("proposed_category_id"),
        F.col("_winner").alias("winning_rule_id"),
        *listed,
        F.when(F.col("_agreed").isNull(), F.lit("no_matching_rule"))
        .when(~F.col("_agreed"), F.lit("priority_conflict"))
        .alias("review_reason"),
    )


def undecided(transactions: DataFrame, current: DataFrame) -> DataFrame:
    """Transactions without a current decision (one row per transaction on each side)."""
    return transactions.join(
        current.select(F.col("transaction_id").alias("id")), "id", "left_anti"
    )


def proposal_errors(proposals: DataFrame, transactions: DataFrame, rules: DataFrame) -> DataFrame:
    """Why a proposal from elsewhere cannot be recorded; error_code is null if it can.

    ``proposals``: transaction_id, nature, category_id, winning_rule_id; ``rules`` are
    the usable ones.
    """
    facts = transactions.select(
        F.col("id").alias("transaction_id"),
        *[normalize_text(F.col(c)).alias(f"_{n}") for n, c in MATCHED_COLUMNS.items()],
        F.lit(True).alias("_known"),
    )
    winner = rules.select(
        F.col("id").alias("winning_rule_id"),
        F.col("nature").alias("_nature"),
        F.col("category_id").alias("_category"),
        *[F.col(n).alias(f"_want_{n}") for n in RULE_CRITERIA],
        F.lit(True).alias("_usable"),
    )
    counts = proposals.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("_n"))
    joined = lookup(proposals, facts, ["transaction_id"], proposals.columns, hot_keys(counts, ["transaction_id"], "_n"))
    joined = lookup_dimension(joined, winner, ["winning_rule_id"], ["transaction_id"])
    fits = reduce(
        lambda a, b: a & b,
        [
            F.col(f"_want_{n}").isNull() | F.coalesce(F.col(f"_want_{n}") == F.col(f"_{n}"), F.lit(False))
            for n in RULE_CRITERIA
        ],
    )
    supports = (
        (F.col("_nature") == F.col("nature")) & F.col("_category").eqNullSafe(F.col("category_id")) & fits
    )
    code = (
        F.when(F.col("_known").isNull(), F.lit("transaction_not_found"))
        .when(F.col("_usable").isNull(), F.lit("winning_rule_not_available"))
        .when(~F.coalesce(supports, F.lit(False)), F.lit("winning_rule_does_not_support_proposal"))
    )
    return joined.select(*proposals.columns, code.alias("error_code"))
