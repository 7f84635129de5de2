"""Statement-like data derived by Spark from the given tables.

Everything is built from integers and string concatenation, so that any engine
produces the same bytes; every view grows with its source table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import keys, values
from ledgerloom.functions.text import normalize_text
from ledgerloom.operators.extract import issue

ROWS_PER_FILE = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def spread_tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def choose(selector: Column, options: list) -> Column:
    """options[selector] as a chain of tests."""
    out = F.lit(None)
    for i, option in reversed(list(enumerate(options))):
        value = option if isinstance(option, Column) else F.lit(option)
        out = F.when(selector == i, value).otherwise(out)
    return out


def orders_with_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return orders.join(customers, orders.o_custkey == customers.c_custkey)


def grouped(whole: Column, mark: str) -> Column:
    return F.when(
        whole >= 1000,
        F.concat(F.floor(whole / 1000).cast("string"), F.lit(mark), F.lpad((whole % 1000).cast("string"), 3, "0")),
    ).otherwise(whole.cast("string"))


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of text per order, with every kind of good and bad value."""
    key = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    joined = orders_with_customer(spark, sf_dir).withColumn("cents", cents)
    whole, frac = F.expr("cents div 100"), F.lpad(F.expr("cents % 100").cast("string"), 2, "0")
    date = F.col("o_orderdate")
    return joined.select(
        (F.col("o_custkey") % 64).alias("file_no"),
        key.alias("seq"),
        F.concat(F.lit("Bank "), text_of(F.col("o_custkey") % 3)).alias("institution"),
        "cents",
        choose(
            key % 4,
            [F.date_format(date, f) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy")] + [""],
        ).alias("date_text"),
        choose(
            key % 7,
            [
                F.concat(F.lit("+R$ "), grouped(whole, "."), F.lit(","), frac),
                F.concat(F.lit("−R$ "), grouped(whole, "."), F.lit(","), frac),
                F.concat(F.lit("$"), grouped(whole, ","), F.lit("."), frac),
                F.concat(F.lit("("), whole.cast("string"), F.lit("."), frac, F.lit(")")),
                "R$ XX",
                whole.cast("string"),
                "",
            ],
        ).alias("amount_text"),
        choose(
            key % 6,
            [F.col("c_name"), "Cartão Visa", "PIX", F.concat("c_name", F.lit(" é")), "", "SALDO ANTERIOR"],
        ).alias("description"),
        choose(key % 5, ["0", "000", "", F.expr("cast(o_orderkey div 10 as string)"), key.cast("string")]).alias(
            "external_id"
        ),
        F.concat_ws(
            ":", text_of(key % 25), text_of(key % 61), text_of(key % 60)
        ).alias("time_text"),
        F.concat(F.col("o_orderpriority"), F.lit(" "), choose(key % 4, ["Crédito", "Pagamento", "Transferência", "compra estorno"])).alias("words"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_rows as tolerant candidates; blank values are missing, unreadable ones invalid."""
    rows = raw_rows(spark, sf_dir)
    date = values.parse_date(F.col("date_text"))
    minor = values.parse_money(F.col("amount_text"))
    parsed = rows.select("*", date.alias("date"), minor.alias("minor"))
    absent = F.lit(None).cast("string")
    return parsed.select(
        text_of("file_no").alias("import_id"),
        text_of("file_no").alias("file_id"),
        F.col("seq").alias("row_number"),
        F.lit("2026-01-01 00:00:00").cast("timestamp").alias("created_at"),
        F.col("date").alias("transaction_date"),
        absent.alias("transaction_time"),
        F.col("minor").alias("amount_minor"),
        values.direction_from_amount_text(F.col("amount_text")).alias("amount_direction"),
        F.lit("BRL").alias("currency"),
        F.col("description").alias("description_raw"),
        F.col("institution").alias("source_institution"),
        F.struct(
            text_of("file_no").alias("file_id"),
            F.col("seq").cast("int").alias("row_number"),
            F.lit(None).cast("int").alias("page_number"),
            F.lit(None).cast("int").alias("block_number"),
        ).alias("source_location"),
        keys.record_hash(F.array("institution", "amount_text", "description")).alias("source_record_hash"),
        F.when(F.col("external_id") != "", F.col("external_id")).alias("external_id"),
        F.lit(None).cast("bigint").alias("balance_minor"),
        absent.alias("payment_method"),
        absent.alias("payment_instrument"),
        absent.alias("card_alias"),
        F.when(F.col("seq") % 9 == 0, F.lit("12a4")).otherwise(F.lpad((F.col("seq") % 10000).cast("string"), 4, "0")).alias("card_last_four"),
        absent.alias("source_account_ref"),
        absent.alias("counterparty_name"),
        absent.alias("merchant_name"),
        F.create_map().cast("map<string,string>").alias("source_metadata"),
        F.array_compact(
            F.array(
                F.when(
                    F.col("date").isNull() & (F.col("date_text") != ""),
                    issue("invalid_transaction_date", "transaction_date"),
                ),
                F.when(F.col("minor").isNull() & (F.col("amount_text") != ""), issue("invalid_amount", "amount_minor")),
            )
        ).alias("extraction_issues"),
        F.when(F.col("seq") % 11 == 0, F.lit("invalid_row")).alias("rejected_reason"),
        F.when(F.col("seq") % 13 == 0, F.array(F.lit("invalid_row")))
        .otherwise(F.array().cast("array<string>"))
        .alias("warnings"),
    )


# Layout of the file made from each block of orders, by file number modulo 5.
HEADERS = [
    "data,hora,tipo,origem / destino,valor,forma de pagamento",
    "Data;Histórico;Docto.;Crédito;Débito;Saldo",
    "Data Movimento;Detalhes;Montante;Natureza",
    "Date\tDescription\tAmount\tDirection",
    "data|hora|tipo|valor|forma de pagamento",
]
PREAMBLE = "Extrato: Ag 0000 | Conta 0;;;;;\n\n"


def statement_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of at most ROWS_PER_FILE orders in five layouts, as the file scan returns them.

    Every second file is in a single-byte encoding. Order keys are unique, which
    bounds the rows collected into one file.
    """
    rows = orders_with_customer(spark, sf_dir)
    key = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    rows = rows.withColumn("cents", cents).withColumn("file_no", F.expr(f"o_orderkey div {ROWS_PER_FILE}"))
    whole, frac = F.expr("cents div 100"), F.lpad(F.expr("cents % 100").cast("string"), 2, "0")
    amount = F.concat(grouped(whole, "."), F.lit(","), frac)
    iso, dmy = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "dd/MM/yyyy")
    name = F.concat(F.col("c_name"), F.lit(" José"))
    quoted = F.when(key % 10 == 7, F.concat(F.lit('"'), name, F.lit('\n""linha"", 2"'))).otherwise(
        F.concat(F.lit('"'), name, F.lit(', loja"'))
    )
    plus, minus = F.lit('"+R$ '), F.lit('"-R$ ')
    line = choose(
        F.col("file_no") % 5,
        [
            F.concat_ws(
                ",",
                iso,
                F.concat(F.lit("08:"), F.lpad((key % 60).cast("string"), 2, "0")),
                F.lit("Pagamento"),
                quoted,
                F.concat(F.when(key % 3 == 0, plus).otherwise(minus), amount, F.lit('"')),
                F.lit("Pix"),
            ),
            F.when(
                key % 10 == 0, F.concat(dmy, F.lit(";SALDO ANTERIOR;0;;;"), amount)
            ).otherwise(
                F.concat_ws(
                    ";",
                    dmy,
                    F.when(key % 10 == 3, F.concat(F.lit("COMPRA;"), name)).otherwise(name),
                    key.cast("string"),
                    F.when(key % 2 == 0, amount).otherwise(F.lit("")),
                    F.when(key % 2 == 1, amount).otherwise(F.lit("")),
                    F.lit("1.000,00"),
                )
            ),
            F.concat_ws(";", dmy, name, amount, F.when(key % 2 == 0, F.lit("Pagamento")).otherwise(F.lit("Entrada"))),
            F.concat_ws("\t", iso, name, F.concat(whole.cast("string"), F.lit("."), frac), F.lit("Payment")),
            F.concat_ws("|", iso, F.lit("10:00"), F.lit("Pix"), amount, F.lit("Pix")),
        ],
    )
    lines = rows.select("file_no", F.struct("o_orderkey", line.alias("line")).alias("l"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n")
    head = choose(F.col("file_no") % 5, [F.lit(PREAMBLE + h if i == 1 else h) for i, h in enumerate(HEADERS)])
    text = F.concat(head, F.lit("\n"), F.col("body"), F.lit("\n"))
    return (
        lines.groupBy("file_no")
        .agg(body.alias("body"))
        .select(
            F.concat(F.lit("file-"), F.lpad(F.col("file_no").cast("string"), 12, "0"), F.lit(".csv")).alias("path"),
            (F.lit("2026-01-01 00:00:00").cast("timestamp")).alias("modificationTime"),
            F.length(text).cast("bigint").alias("length"),
            F.when(F.col("file_no") % 2 == 1, F.encode(text, "ISO-8859-1"))
            .otherwise(F.encode(text, "UTF-8"))
            .alias("content"),
        )
    )


LARGE_FILES = 4


def large_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """LARGE_FILES real files with a row per order, in order; every tenth row lies on two lines."""
    key = F.col("o_orderkey")
    name = F.when(key % 10 == 7, F.concat(F.lit('"'), "c_name", F.lit('\n""linha"", 2"'))).otherwise(F.col("c_name"))
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    row = F.concat_ws(",", F.date_format("o_orderdate", "yyyy-MM-dd"), name, cents.cast("string"))
    rows = orders_with_customer(spark, sf_dir).select((F.col("o_custkey") % LARGE_FILES).alias("file_no"), key.alias("seq"), row.alias("value"))
    header = spark.range(LARGE_FILES).select(F.col("id").alias("file_no"), F.lit(-1).cast("bigint").alias("seq"), F.lit("data,descricao,valor").alias("value"))
    lines = rows.withColumns({"file_no": F.col("file_no").cast("bigint"), "seq": F.col("seq").cast("bigint")}).unionByName(header)
    # One task per file: a file is written in order.
    lines.repartition(LARGE_FILES, "file_no").sortWithinPartitions("file_no", "seq").select("file_no", "value").write.partitionBy("file_no").text(folder)


def layout_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File profiles derived from parts: known layouts with columns lost, renamed, added or turned."""
    wallet = ["data", "hora", "tipo", "origem destino", "valor", "forma de pagamento"]
    bank = ["data", "historico", "docto", "credito", "debito", "saldo"]
    key, size = F.col("p_partkey"), F.col("p_size")
    base = F.when(key % 2 == 0, F.array(*[F.lit(c) for c in wallet])).otherwise(F.array(*[F.lit(c) for c in bank]))
    dropped = F.filter("base", lambda _, i: i != F.col("p_partkey") % 7)
    renamed = F.transform(
        dropped,
        lambda c: F.when((size % 5 == 0) & (c == "data"), F.lit("data movimento"))
        .when((size % 5 == 1) & (c == "valor"), F.lit("montante total"))
        .when((size % 5 == 1) & (c == "historico"), F.lit("memo"))
        .otherwise(c),
    )
    extended = F.when(size % 2 == 0, F.array_append(renamed, F.lower("p_name"))).otherwise(renamed)
    columns = F.when(size % 3 == 0, F.reverse(extended)).otherwise(extended)
    # Few bytes and much work per row: a file with one row group would otherwise be one task.
    parts = table(spark, sf_dir, "part").repartition(spread_tasks(spark), "p_partkey")
    return parts.withColumn("base", base).select(
        F.col("p_partkey").cast("string").alias("file_id"),
        F.col("p_partkey").cast("string").alias("path"),
        "p_partkey",
        "p_size",
        columns.alias("columns"),
        choose(size % 4, [",", ";", "\t", "|"]).alias("delimiter"),
        F.when(size % 6 == 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("irregular_row_count"),
        F.lit(None).cast("string").alias("issue_code"),
    ).withColumn("signature", F.sha2(F.concat_ws("|", F.col("columns"), F.col("delimiter")), 256))


def order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical transactions for classification, one per order."""
    rows = orders_with_customer(spark, sf_dir)
    absent = F.lit(None).cast("string")
    return rows.select(
        text_of("o_orderkey").alias("id"),
        F.col("o_orderdate").cast("date").alias("transaction_date"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("amount_minor"),
        F.lit("BRL").alias("currency"),
        normalize_text(F.col("o_orderpriority")).alias("description_normalized"),
        F.concat(F.lit("Bank "), text_of(F.col("o_custkey") % 3)).alias("source_institution"),
        absent.alias("payment_method"),
        absent.alias("payment_instrument"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("card_alias"),
        F.col("c_name").alias("counterparty_name"),
        F.lower("c_mktsegment").alias("merchant_name"),
        F.lit("2026-01-01 00:00:00").cast("timestamp").alias("created_at"),
    )


# Fixed values of the order and customer tables.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def part_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One category per part type; ECONOMY is switched off."""
    return (
        table(spark, sf_dir, "part")
        .groupBy("p_type")
        .agg(F.min("p_partkey").alias("created_seq"))
        .select(
            F.concat(F.lit("cat-"), "p_type").alias("id"),
            F.initcap("p_type").alias("name"),
            F.col("p_type").alias("normalized_name"),
            (F.col("p_type") != "ECONOMY").alias("is_active"),
            "created_seq",
        )
    )


def part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule per part: which criteria it sets depends on the part key."""
    key = F.col("p_partkey")
    kind = key % 6
    nature = choose(key % 4, ["despesa", "receita", "transferencia_interna", "estorno"])
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("rule-"), F.lpad(text_of(key), 12, "0")).alias("id"),
        F.col("p_name").alias("name"),
        (F.col("p_size") * 10).alias("priority"),
        nature.alias("nature"),
        F.when((key % 4 < 2) | (key % 3 == 0), F.concat(F.lit("cat-"), "p_type")).alias("category_id"),
        F.when(kind.isin(0, 1, 4), normalize_text(choose(key % 5, PRIORITIES))).alias("description_exact"),
        F.when(kind.isin(1, 2), choose(F.expr("(p_partkey div 5) % 5"), SEGMENTS)).alias("merchant_exact"),
        F.when(
            kind.isin(3, 5), F.concat(F.lit("CUSTOMER "), F.lpad(F.expr("cast(p_partkey div 2 as string)"), 9, "0"))
        ).alias("counterparty_exact"),
        F.when(kind.isin(2, 4, 5), F.concat(F.lit("BANK "), text_of(key % 3))).alias("source_institution"),
        F.when(kind == 4, F.lit("O")).alias("card_alias"),
        (key % 10 != 9).alias("is_enabled"),
        F.lit(True).alias("created_by_user"),
        key.alias("created_seq"),
    )


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with many repeats, one per event, spread over eight imports."""
    event = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        text_of(event).alias("id"),
        F.concat(F.lit("Bank "), text_of(F.col("user_id") % 3)).alias("source_institution"),
        F.lit(None).cast("string").alias("source_account_ref"),
        choose(event % 5, ["0", "000", "", F.expr("cast(event_id div 40 as string)"), event.cast("string")]).alias(
            "external_id"
        ),
        F.to_date("ts").alias("transaction_date"),
        (F.floor("value") + 1).cast("bigint").alias("amount_minor"),
        F.lit("BRL").alias("currency"),
        F.upper("event_type").alias("description_normalized"),
        (F.col("user_id") % 8).alias("import_seq"),
        event.alias("row_seq"),
    )
    names = keys.columns_of(*rows.columns)
    return rows.withColumn("strong_dedup_key", keys.strong_key(names)).withColumn(
        "semantic_fingerprint", keys.semantic_fingerprint(names)
    )


def event_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision events: the user is the transaction, the event type the category."""
    return table(spark, sf_dir, "events").select(
        text_of("event_id").alias("id"),
        text_of("user_id").alias("transaction_id"),
        F.lit("estorno").alias("nature"),
        F.col("event_type").alias("category_id"),
        F.lit("user").alias("source"),
        F.lit(None).cast("string").alias("rule_id"),
        F.array().cast("array<string>").alias("matched_rule_ids"),
        F.lit("user_correction").alias("reason_code"),
        F.col("ts").alias("decided_at"),
        F.col("event_id").alias("seq"),
    )


def event_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review events: purchases and signups resolve, everything else opens."""
    resolves = F.col("event_type").isin("purchase", "signup")
    return table(spark, sf_dir, "events").select(
        text_of("user_id").alias("transaction_id"),
        F.when(resolves, F.lit("resolved")).otherwise(F.lit("opened")).alias("event"),
        choose(
            F.expr("case event_type when 'click' then 0 when 'view' then 1 when 'error' then 2 end"),
            ["no_matching_rule", "priority_conflict", "user_requested"],
        ).alias("reason"),
        F.when(
            F.col("event_type") == "view",
            F.array(F.concat(F.lit("r"), text_of(F.col("event_id") % 7)), F.concat(F.lit("r"), text_of(F.col("event_id") % 3))),
        )
        .otherwise(F.array().cast("array<string>"))
        .alias("candidate_rule_ids"),
        F.col("ts").alias("event_at"),
        F.col("event_id").alias("seq"),
    )


def nation_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("n-"), text_of("n_nationkey")).alias("id"),
        F.col("n_name").alias("name"),
        normalize_text(F.col("n_name")).alias("normalized_name"),
        (F.col("n_regionkey") != 0).alias("is_active"),
        F.col("n_nationkey").cast("bigint").alias("created_seq"),
    )
