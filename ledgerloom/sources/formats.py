"""Registry of statement layouts: two built in, the rest learned by approval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions.text import slug, strip
from ledgerloom.sources.store import stage_shared

SIGNED_TEXT, CREDIT_DEBIT, CONFIGURABLE = "picpay_csv", "bradesco_csv", "generic_csv"


def builtin_specs(spark: SparkSession) -> DataFrame:
    def mapping(**fields):
        return tuple(fields.get(name) for name in schemas.MAPPED_FIELDS)

    # The layouts known without approval.
    rows = [
        (
            "picpay_csv_v1",
            "PicPay",
            SIGNED_TEXT,
            "BRL",
            "ymd",
            ",",
            ["data", "hora", "tipo", "origem destino", "valor", "forma de pagamento"],
            ["data", "origem destino", "valor"],
            [],
            mapping(
                transaction_date="data",
                transaction_time="hora",
                direction="tipo",
                description="origem destino",
                amount="valor",
                payment_method="forma de pagamento",
            ),
            False,
            0,
        ),
        (
            "bradesco_csv_v1",
            "Bradesco",
            CREDIT_DEBIT,
            "BRL",
            "dmy",
            ";",
            ["data", "historico", "docto", "credito", "debito", "saldo"],
            ["data", "historico"],
            [["credito", "debito"]],
            mapping(
                transaction_date="data",
                description="historico",
                credit="credito",
                debit="debito",
                balance="saldo",
                external_id="docto",
            ),
            False,
            1,
        ),
    ]
    return spark.createDataFrame(rows, schemas.ddl(schemas.SPEC_FIELDS))


def all_specs(spark: SparkSession, learned: DataFrame | None = None) -> DataFrame:
    """Built-in specs followed by learned ones; spec_order keeps ties stable."""
    known = builtin_specs(spark)
    if learned is None:
        return known
    return known.unionByName(
        learned.select(*[c for c in known.columns if c != "spec_order"], (F.col("spec_order") + 2).alias("spec_order"))
    )


def write_registry(specs: DataFrame, path: str) -> None:
    """Learned specs as JSON, one per line, for other stores to read."""
    specs.where("learned").select(*schemas.SPEC_FIELDS).write.json(path)


def read_registry(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """(specs, whether all of it could be read). Lines that are no spec are left out and make it unreadable."""
    fields = schemas.ddl({**schemas.SPEC_FIELDS, "_corrupt": "string"})
    lines = spark.read.schema(fields).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    fit = F.col("_corrupt").isNull() & F.col("format_id").isNotNull() & (F.size("expected_columns") > 0) & F.col("delimiter").isNotNull() & mapping_is_complete(F.col("mapping"))
    checked = stage_shared(lines.withColumn("_fit", F.coalesce(fit, F.lit(False))), "registry")
    return checked.where("_fit").select(*schemas.SPEC_FIELDS), checked.where("not _fit").isEmpty()


def spec_struct() -> Column:
    return F.struct(*schemas.SPEC_FIELDS)


def mapping_is_complete(mapping: Column) -> Column:
    return (
        mapping["transaction_date"].isNotNull()
        & mapping["description"].isNotNull()
        & (mapping["amount"].isNotNull() | mapping["credit"].isNotNull() | mapping["debit"].isNotNull())
    )


def approval_error(mapping: Column) -> Column:
    """``registry_invalid`` when an approval (institution, currency, date_order) cannot be learned."""
    name = strip(F.col("institution"))
    currency = F.upper(strip(F.col("currency")))
    valid = (
        mapping_is_complete(mapping)
        & (name != "")
        & (F.length(name) <= 80)
        & ~name.rlike("[\r\n\t]")
        & currency.rlike("^[A-Z]{3}$")
        & (F.col("date_order").isNull() | F.col("date_order").isin("ymd", "dmy", "mdy"))
    )
    return F.when(~F.coalesce(valid, F.lit(False)), F.lit("registry_invalid"))


def learn_specs(approved: DataFrame) -> DataFrame:
    """Approvals with their profile and suggested mapping -> specs, or an error code.

    Input columns: columns, delimiter, signature, mapping, institution, currency,
    date_order, approval_seq. A later approval with the same format id replaces
    an earlier one.
    """
    name = strip(F.col("institution"))
    amounts = F.array_sort(
        F.array_distinct(F.array_compact(F.array("mapping.amount", "mapping.credit", "mapping.debit")))
    )
    required = F.array_sort(
        F.array_distinct(F.array_compact(F.array("mapping.transaction_date", "mapping.description")))
    )
    return approved.select(
        F.concat_ws("_", F.lit("learned_csv"), slug(name), F.substring("signature", 1, 8)).alias("format_id"),
        name.alias("institution"),
        F.lit(CONFIGURABLE).alias("parser_id"),
        F.upper(strip(F.col("currency"))).alias("currency"),
        "date_order",
        "delimiter",
        F.col("columns").alias("expected_columns"),
        required.alias("required_columns"),
        F.array(amounts).alias("required_any_groups"),
        "mapping",
        F.lit(True).alias("learned"),
        F.col("approval_seq").cast("bigint").alias("spec_order"),
        approval_error(F.col("mapping")).alias("issue_code"),
    )


def upsert_specs(registry: DataFrame, learned: DataFrame) -> DataFrame:
    """Registry after the valid learned specs replaced equal ids; the newest goes last."""
    columns = list(schemas.SPEC_FIELDS)
    both = registry.select(*columns, F.lit(0).alias("round")).unionByName(
        learned.where("issue_code is null").select(*columns, F.lit(1).alias("round"))
    )
    spec = F.struct("round", "spec_order", *[c for c in columns if c not in ("format_id", "spec_order")])
    return (
        both.groupBy("format_id")
        .agg(F.max_by(spec, F.struct("round", "spec_order")).alias("spec"))
        .select("format_id", "spec.*")
        .select(*columns)
    )
