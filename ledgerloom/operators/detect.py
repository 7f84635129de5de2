"""Recognise the layout of a file among the known formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions.text import let
from ledgerloom.operators.mapping import suggest_mapping
from ledgerloom.operators.skew import is_small, lookup_dimension
from ledgerloom.sources.files import DELIMITERS
from ledgerloom.sources.formats import spec_struct

THRESHOLD = 0.72
AMBIGUITY_GAP = 0.03
LISTED = 3
INLINE_SPECS_MAX = 2000

_RANKED = "array<struct<score:double,place:bigint,spec:struct<{}>>>".format(
    ",".join(f"{k}:{v}" for k, v in schemas.SPEC_FIELDS.items())
)


def format_score(shared: Column, expected: Column, same_delimiter: Column) -> Column:
    coverage = F.when(expected > 0, shared / expected).otherwise(F.lit(0.0))
    return F.round(
        coverage * 0.85 + F.when(same_delimiter, F.lit(1.0)).otherwise(F.lit(0.0)) * 0.15, 4
    )


def detect_formats(profiles: DataFrame, specs: DataFrame, inline_max: int = INLINE_SPECS_MAX) -> DataFrame:
    """Adds detection_status, format_candidates (best three) and selected_spec.

    A registry of ordinary size travels as one array inside the plan and every file
    is scored in its own row, without a shuffle. A larger one is matched by equal
    column names, once per distinct layout; the result is the same. Blocked files have
    no candidates.
    """
    if is_small(specs, inline_max):
        wanted = F.array_distinct("expected_columns")
        n = F.coalesce(F.size(wanted), F.lit(0))

        def by_shared(same: bool) -> Column:
            """Scores of a spec by the number of shared names."""
            return F.transform(F.sequence(F.lit(0), n), lambda shared: format_score(shared, n, F.lit(same)))

        known = specs.agg(
            F.collect_list(
                F.struct(
                    spec_struct().alias("spec"),
                    n.alias("n"),
                    F.array_compact(wanted).alias("wanted"),
                    F.exists(wanted, lambda name: name.isNull()).alias("blank"),
                    by_shared(True).alias("same"),
                    by_shared(False).alias("other"),
                )
            )
        ).scalar()
        ranked = profiles.withColumn("_specs", known).withColumn("_ranked", _rank_inline()).drop("_specs")
    else:
        best = rank_by_join(profiles, specs)
        ranked = lookup_dimension(profiles, best, ["signature"], ["file_id"])
    return _decide(suggest_mapping(ranked))


def _rank_inline() -> Column:
    columns = F.col("columns")

    def rank(blank: Column) -> Column:
        def score(s: Column) -> Column:
            shared = F.coalesce(F.size(F.filter(s["wanted"], lambda name: F.array_contains(columns, name))), F.lit(0))
            shared += F.coalesce((s["blank"] & blank).cast("int"), F.lit(0))
            # Null columns share an unknown number of names.
            shared = F.when(columns.isNotNull() | (s["n"] == 0), shared)
            return F.get(F.when(s["spec"]["delimiter"] == F.col("delimiter"), s["same"]).otherwise(s["other"]), shared)

        # Score, then place, then name; the specs themselves follow for the best ones only.
        scored = F.transform(
            "_specs",
            lambda s, i: F.struct(
                score(s).alias("score"),
                (-s["spec"]["spec_order"]).alias("place"),
                s["spec"]["format_id"].alias("format_id"),
                i.alias("i"),
            ),
        )
        return F.slice(F.sort_array(scored, asc=False), 1, LISTED)

    return F.transform(
        let(F.exists(columns, lambda name: name.isNull()), rank),
        lambda r: F.struct(r["score"].alias("score"), r["place"].alias("place"), F.get("_specs", r["i"])["spec"].alias("spec")),
    ).cast(_RANKED)


def rank_by_join(profiles: DataFrame, specs: DataFrame) -> DataFrame:
    """signature -> best three specs, for registries too large to carry along.

    Layouts and specs meet on shared column names. Specs that share none score by the
    delimiter alone and can only fill up a list of three, in registry order: the first
    2 * LISTED specs of each delimiter and of all always contain enough of them.
    """
    layouts = profiles.where("issue_code is null").groupBy("signature").agg(
        F.any_value("columns").alias("columns"), F.any_value("delimiter").alias("delimiter")
    )
    pairs = (
        layouts.select("signature", F.col("delimiter").alias("own"), F.explode(F.array_distinct("columns")).alias("feature"))
        .join(
            specs.select(
                "format_id",
                "spec_order",
                "delimiter",
                F.size(F.array_distinct("expected_columns")).alias("expected"),
                F.explode(F.array_distinct("expected_columns")).alias("feature"),
            ),
            "feature",
        )
        .groupBy("signature", "format_id", "spec_order", "expected", (F.col("own") == F.col("delimiter")).alias("same_delimiter"))
        .agg(F.count(F.lit(1)).alias("shared"))
        .select(
            "signature",
            "format_id",
            format_score(F.col("shared"), F.col("expected"), F.col("same_delimiter")).alias("score"),
            (-F.col("spec_order")).alias("place"),
        )
    )
    firsts = [specs] + [specs.where(F.col("delimiter") == d) for d in DELIMITERS]
    fillers = [frame.orderBy("spec_order").limit(2 * LISTED).select("format_id", "spec_order", "delimiter") for frame in firsts]
    known = reduce(DataFrame.unionByName, fillers).distinct().agg(F.collect_list(F.struct("format_id", "spec_order", "delimiter")))
    zero = layouts.select("signature", "delimiter", F.explode(known.scalar()).alias("f")).select(
        "signature",
        "f.format_id",
        format_score(F.lit(0), F.lit(1), F.col("f.delimiter") == F.col("delimiter")).alias("score"),
        (-F.col("f.spec_order")).alias("place"),
    )
    best_score = (
        pairs.unionByName(zero)
        .groupBy("signature", "format_id")
        .agg(F.max("score").alias("score"), F.max("place").alias("place"))
    )
    ranking = Window.partitionBy("signature").orderBy(F.desc("score"), F.desc("place"))
    top = best_score.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= LISTED)
    return (
        top.join(specs.select("format_id", spec_struct().alias("spec")), "format_id")
        .groupBy("signature")
        .agg(F.sort_array(F.collect_list(F.struct("score", "place", "spec")), asc=False).cast(_RANKED).alias("_ranked"))
    )


def _decide(ranked: DataFrame) -> DataFrame:
    def decision(top: Column) -> Column:
        first, second = F.get(top, F.lit(0)), F.get(top, F.lit(1))
        found = F.coalesce(first["score"] >= THRESHOLD, F.lit(False)) & F.col("issue_code").isNull()
        rival = F.coalesce(
            (second["score"] >= THRESHOLD) & (F.abs(first["score"] - second["score"]) <= AMBIGUITY_GAP),
            F.lit(False),
        )
        status = (
            F.when(F.col("issue_code").isNotNull(), F.lit("unknown"))
            .when(found & rival, F.lit("ambiguous"))
            .when(found & first["spec"]["learned"], F.lit("learned"))
            .when(found, F.lit("known"))
            .when(F.col("mapping_complete"), F.lit("generic"))
            .otherwise(F.lit("unknown"))
        )
        listed = F.transform(
            top,
            lambda r: F.struct(
                r["spec"]["format_id"].alias("format_id"),
                r["spec"]["institution"].alias("institution"),
                r["score"].alias("confidence"),
            ),
        )
        return F.struct(
            status.alias("status"), F.when(found & ~rival, first["spec"]).alias("spec"), F.when(F.col("issue_code").isNull(), listed).alias("listed")
        )

    return (
        ranked.withColumn("_decision", let(F.col("_ranked"), decision))
        .withColumn("detection_status", F.col("_decision.status"))
        .withColumn("selected_spec", F.col("_decision.spec"))
        .withColumn("format_candidates", F.col("_decision.listed"))
        .drop("_ranked", "_decision")
    )
