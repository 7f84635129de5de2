"""Apply a log of change rows to the category and rule dimensions.

``seq`` (from 0 to SEQS - 1) orders the changes of one batch; a logical clock, the batch's place
among all commits, comes before it, so the numbers may start anew in each batch. Creating what
exists returns the existing row; later switches win over earlier ones; a switch for an id that does
not exist yet is reported and ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions import keys
from ledgerloom.functions.checks import rule_violations
from ledgerloom.functions.text import normalize_text, strip
from ledgerloom.operators.skew import lookup_dimension


#: Changes one batch can number.
SEQS = 1 << 40


def moment(clock: int, seq: Column | str = "seq") -> Column:
    """Place of a change among those of all batches."""
    return F.lit(clock * SEQS).cast("bigint") + (F.col(seq) if isinstance(seq, str) else seq)


def _switches(changes: DataFrame, table: DataFrame, on: str, off: str, clock: int) -> DataFrame:
    """On/off changes with ``applied``: the id existed when the switch came."""
    wanted = changes.where(F.col("action").isin(on, off)).select(
        "seq", "action", "id", (F.col("action") == on).alias("flag")
    )
    return lookup_dimension(wanted, table.select("id", "created_seq"), ["id"], ["seq"]).withColumn(
        "applied", F.coalesce(moment(clock) > F.col("created_seq"), F.lit(False))
    )


def _latest_flag(switches: DataFrame) -> DataFrame:
    return switches.where("applied").groupBy("id").agg(F.max_by("flag", "seq").alias("_flag"))


def category_error(name: Column) -> Column:
    normalized = normalize_text(name)
    return F.when(F.coalesce(normalized, F.lit("")) == "", F.lit("category_name_required")).when(
        (F.length(strip(name)) > 80) | (F.length(normalized) > 80), F.lit("category_name_too_long")
    )


def apply_category_changes(categories: DataFrame, changes: DataFrame, clock: int = 0) -> tuple[DataFrame, DataFrame]:
    """(categories afterwards, results). ``changes``: seq, action, name, id; ``clock`` grows per batch.

    Actions: create (by name), activate, deactivate (by id).
    """
    create = (
        changes.where("action = 'create'")
        .withColumn("error_code", category_error(F.col("name")))
        .withColumn("normalized_name", normalize_text(F.col("name")))
    )
    created = (
        create.where("error_code is null")
        .groupBy("normalized_name")
        .agg(F.min_by(strip(F.col("name")), "seq").alias("name"), moment(clock, F.min("seq")).alias("created_seq"))
        .join(categories.select("normalized_name"), "normalized_name", "left_anti")
        .select(
            keys.name_uuid(F.concat(F.lit("category:"), "normalized_name")).alias("id"),
            "name",
            "normalized_name",
            F.lit(True).alias("is_active"),
            "created_seq",
        )
    )
    table = categories.select(*schemas.CATEGORY_FIELDS).unionByName(created)
    switches = _switches(changes, table, "activate", "deactivate", clock)
    after = (
        table.join(_latest_flag(switches), "id", "left")
        .withColumn("is_active", F.coalesce("_flag", "is_active"))
        .select(*schemas.CATEGORY_FIELDS)
    )
    made = lookup_dimension(
        create.select("seq", "action", "error_code", "normalized_name"),
        table.select("normalized_name", "id"),
        ["normalized_name"],
        ["seq"],
    ).select("seq", "action", "id", F.col("error_code").isNull().alias("applied"), "error_code")
    results = made.unionByName(
        switches.select("seq", "action", "id", "applied", F.lit(None).cast("string").alias("error_code"))
    )
    return after, results


def normalize_rules(rules: DataFrame) -> DataFrame:
    return rules.withColumns({name: normalize_text(F.col(name)) for name in keys.RULE_CRITERIA})


def apply_rule_changes(
    rules: DataFrame, changes: DataFrame, categories: DataFrame, clock: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(rules afterwards, results). Actions: create, enable, disable.

    ``changes``: seq, action, id, and for create the rule columns. A create whose
    fingerprint exists switches that rule on; ``categories`` are those valid for the
    whole batch.
    """
    active = categories.where("is_active").select(
        F.col("id").alias("category_id"), F.lit(True).alias("_active")
    )
    create = lookup_dimension(
        normalize_rules(changes.where("action = 'create'")), active, ["category_id"], ["seq"]
    )
    violations = rule_violations()
    create = create.withColumn(
        "error_code",
        F.when(F.size(violations) > 0, F.concat_ws(",", violations)).when(
            F.col("category_id").isNotNull() & F.col("_active").isNull(), F.lit("active_category_not_found")
        ),
    ).withColumn("rule_fingerprint", keys.rule_fingerprint(keys.columns_of(*create.columns)))
    valid = create.where("error_code is null")
    described = ["name", "priority", "nature", "category_id", *keys.RULE_CRITERIA, "created_by_user"]
    created = (
        valid.groupBy("rule_fingerprint")
        .agg(F.min_by(F.struct(*described), "seq").alias("r"), moment(clock, F.min("seq")).alias("created_seq"))
        .join(rules.select("rule_fingerprint"), "rule_fingerprint", "left_anti")
        .select(
            keys.name_uuid(F.concat(F.lit("rule:"), "rule_fingerprint")).alias("id"),
            "r.*",
            "rule_fingerprint",
            F.lit(True).alias("is_enabled"),
            "created_seq",
        )
    )
    table = rules.select(*schemas.RULE_FIELDS).unionByName(
        created.select(*[F.col(c).cast(kind).alias(c) for c, kind in schemas.RULE_FIELDS.items()])
    )
    made = lookup_dimension(
        create.select("seq", "action", "error_code", "rule_fingerprint"),
        table.select("rule_fingerprint", "id"),
        ["rule_fingerprint"],
        ["seq"],
    )
    switches = _switches(changes, table, "enable", "disable", clock).select(
        "seq", "action", "id", "flag", "applied"
    )
    revived = made.where("error_code is null").select(
        "seq", "action", "id", F.lit(True).alias("flag"), F.lit(True).alias("applied")
    )
    after = (
        table.join(_latest_flag(switches.unionByName(revived)), "id", "left")
        .withColumn("is_enabled", F.coalesce("_flag", "is_enabled"))
        .select(*schemas.RULE_FIELDS)
    )
    results = made.select(
        "seq",
        "action",
        F.when(F.col("error_code").isNull(), F.col("id")).alias("id"),
        F.col("error_code").isNull().alias("applied"),
        "error_code",
    ).unionByName(
        switches.select("seq", "action", "id", "applied", F.lit(None).cast("string").alias("error_code"))
    )
    return after, results
