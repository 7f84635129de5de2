"""Files to stored rows, through the whole batch."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans.ingest import ingest_batch, report_store, summarize_store
from ledgerloom.sources.store import Store
from tests import fixtures

AS_OF = datetime(2026, 9, 1)


def ingest(spark, folder, store, batch, **more):
    ingest_batch(spark, store, f"file:{folder}", batch, AS_OF, **more)


def runs_by(store, *columns):
    return [tuple(r) for r in store.read("import_runs").select(*columns).collect()]


@pytest.fixture()
def store(spark):
    return Store.scratch(spark)


COUNTS = ["records_read", "transactions_created", "pending_created", "duplicates_in_file", "records_rejected"]


def test_both_layouts_balance_and_reimport_adds_nothing(spark, tmp_path, store):
    fixtures.write(tmp_path, "wallet.csv", fixtures.WALLET)
    fixtures.write(tmp_path, "bank.TXT", fixtures.BANK)
    fixtures.write(tmp_path, "notes.pdf", "x")
    ingest(spark, tmp_path, store, "b1")
    got = {r[0]: r[1:] for r in runs_by(store, "format_id", "ingestion_status", "persistence_status", *COUNTS, "issue_counts")}
    assert got["picpay_csv_v1"] == ("completed_with_issues", "stored", 8, 7, 0, 1, 0, {"duplicate_record": 1})
    assert got["bradesco_csv_v1"] == (
        "completed_with_issues", "stored", 7, 6, 0, 0, 1, {"irregular_row_width": 1, "non_transaction_row": 1})
    assert got[None] == ("blocked", "not_stored", 0, 0, 0, 0, 0, {"unsupported_file_type": 1})

    folded = store.read("transactions").where("description_raw like 'BOLETO%'").first()
    assert folded.description_raw == "BOLETO; ESCOLA MUSICAL"
    assert folded.description_normalized == "BOLETO ESCOLA MUSICAL"
    assert (folded.amount_minor, folded.balance_minor, folded.external_id) == (-61215, 336890, "9087")
    unsigned = store.read("transactions").where("description_raw = 'Tito Sabino'").first()
    assert (unsigned.amount_minor, unsigned.payment_method, unsigned.transaction_time) == (-555, "pix", "21:09:02")

    ingest(spark, tmp_path, store, "b2")
    summary = summarize_store(store).first()
    assert (summary.transactions, summary.completed_imports, summary.open_pending) == (13, 2, 0)
    ingest(spark, tmp_path, store, "b1")
    assert summarize_store(store).first().transactions == 13
    for line in report_store(store).collect():
        assert not any(secret in line.report for secret in ("Girassol", "BOLETO", "311,04", "31104"))


def test_overlap_between_files(spark, tmp_path, store):
    first, second = tmp_path / "a", tmp_path / "b"
    first.mkdir(), second.mkdir()
    fixtures.write(first, "wallet.csv", fixtures.WALLET)
    fixtures.write(first, "bank.csv", fixtures.BANK)
    ingest(spark, first, store, "b1")
    fixtures.write(second, "again.csv", "\n".join(fixtures.WALLET.split("\n")[:2]) + "\n")
    lines = fixtures.BANK.split("\n")
    fixtures.write(second, "bank.csv", "\n".join([lines[1], lines[2]]) + "\n")
    ingest(spark, second, store, "b2")
    dups = {(d.detection_strategy, d.status) for d in store.read("duplicate_candidates").collect()}
    assert dups == {("semantic_fingerprint", "open_review"), ("external_id", "confirmed_duplicate")}
    later = store.read("import_runs").where("batch_id = 'b2'").collect()
    assert [(r.transactions_created, r.duplicates_in_database) for r in later] == [(0, 1), (0, 1)]
    existing = store.read("transactions").select(F.col("id").alias("existing_transaction_id"))
    assert store.read("duplicate_candidates").join(existing, "existing_transaction_id", "left_anti").count() == 0


def test_new_layout_needs_approval_then_is_recognised(spark, tmp_path, store):
    path = fixtures.write(tmp_path, "new.csv", fixtures.NEW_LAYOUT)
    ingest(spark, tmp_path, store, "b1")
    assert runs_by(store, "detection_status", "issue_counts") == [("generic", {"generic_mapping_requires_approval": 1})]
    schema = "path string, institution string, currency string, date_order string, approval_seq bigint"
    no_currency = spark.createDataFrame([(path, "Banco Novo", None, "dmy", 1)], schema)
    ingest(spark, tmp_path, store, "b2", approvals=no_currency)
    bad = spark.createDataFrame([(path, "Banco\nNovo", "BRL", "dmy", 2)], schema)
    ingest(spark, tmp_path, store, "b3", approvals=bad)
    good = spark.createDataFrame([(path, "Banco Novo", "brl", "dmy", 3)], schema)
    ingest(spark, tmp_path, store, "b4", approvals=good)
    rows = {r.batch_id: r for r in store.read("import_runs").collect()}
    assert rows["b2"].issue_counts == {"missing_currency": 1}
    assert rows["b3"].issue_counts == {"registry_invalid": 1}
    assert (rows["b4"].detection_status, rows["b4"].ingestion_status, rows["b4"].transactions_created) == ("learned", "completed", 2)
    assert sorted(r.amount_minor for r in store.read("transactions").collect()) == [-735, 41520]
    spec = store.snapshot("format_specs").first()
    assert spec.format_id.startswith("learned_csv_banco_novo_") and spec.learned
    other = tmp_path / "later"
    other.mkdir()
    fixtures.write(other, "next.csv", fixtures.NEW_LAYOUT.replace("Feira Livre", "Horta Comum"))
    ingest(spark, other, store, "b5")
    assert store.read("import_runs").where("batch_id = 'b5'").first().transactions_created == 1


@pytest.mark.parametrize(
    "text,encoding,expected",
    [
        ("data,hora,tipo,valor,forma de pagamento,novo campo\n2026-01-02,08:00:00,Pix,1,Pix,a\n", "utf-8", {"missing_column": 1, "unexpected_column": 1}),
        ("\n", "utf-8", {"unknown_format": 1}),
        ("just words\nmore words\n", "utf-8", {"unknown_format": 1}),
        ("a\x00b,c\n", "utf-8", {"unreadable_file": 1}),
        ("foo,bar\n1,2\n", "utf-8", {"missing_minimum_column": 1}),
    ],
)
def test_blocked_files(spark, tmp_path, store, text, encoding, expected):
    fixtures.write(tmp_path, "f.csv", text, encoding)
    ingest(spark, tmp_path, store, "b1")
    (row,) = store.read("import_runs").collect()
    assert (row.ingestion_status, row.issue_counts) == ("blocked", expected)


def test_pending_rows_keep_every_reason(spark, tmp_path, store):
    fixtures.write(tmp_path, "w.csv", fixtures.WALLET_HEADER + "\n31-31-31,99:00:00,Compra,Quiosque,R$ doze,Pix\n")
    ingest(spark, tmp_path, store, "b1")
    (pending,) = store.read("pending_transactions").collect()
    assert [i.code for i in pending.issues] == ["invalid_transaction_date", "invalid_amount"]
    assert pending.candidate.amount_direction == "outflow"
    (run,) = store.read("import_runs").collect()
    assert run.issue_counts == {"invalid_amount": 1, "invalid_row": 1, "invalid_transaction_date": 1}


def test_size_limit_and_missing_files(spark, tmp_path):
    from ledgerloom.sources.files import list_files, read_files, refused_files

    small = fixtures.write(tmp_path, "small.csv", "a,b\n")
    large = fixtures.write(tmp_path, "large.csv", "a,b\n" * 10)
    requested = spark.createDataFrame([(small,), ("file:/nowhere/x.csv",), ("file:/nowhere/x.doc",)], "path string")
    refused = refused_files(list_files(spark, f"file:{tmp_path}"), requested, max_bytes=10)
    assert {(r.path, r.issue_code) for r in refused.collect()} == {
        (large, "file_too_large"), ("file:/nowhere/x.csv", "unreadable_file"), ("file:/nowhere/x.doc", "unsupported_file_type")}
    assert [r.path for r in read_files(spark, f"file:{tmp_path}", 10).collect()] == [small]


def test_landing_folder_replays_add_nothing(spark, tmp_path, store):
    from ledgerloom.streaming.landing import watch_folder

    landing = tmp_path / "in"
    landing.mkdir()
    fixtures.write(landing, "wallet.csv", fixtures.WALLET)
    for checkpoint in ("one", "two"):
        watch_folder(spark, store, f"file:{landing}", str(tmp_path / checkpoint), checkpoint).awaitTermination()
        assert summarize_store(store).first().transactions == 7


def test_fresh_checkpoint_under_one_name_loses_nothing(spark, tmp_path, store):
    from ledgerloom.streaming.landing import watch_folder

    landing = tmp_path / "in"
    landing.mkdir()
    fixtures.write(landing, "wallet.csv", fixtures.WALLET)
    fixtures.write(landing, "scan.pdf", "x")
    watch_folder(spark, store, f"file:{landing}", str(tmp_path / "one")).awaitTermination()
    (landing / "wallet.csv").rename(tmp_path / "gone.csv")
    (landing / "scan.pdf").rename(tmp_path / "gone.pdf")
    fixtures.write(landing, "bank.csv", fixtures.BANK)
    watch_folder(spark, store, f"file:{landing}", str(tmp_path / "two")).awaitTermination()
    assert summarize_store(store).first().transactions == 13
    assert [r[0] for r in runs_by(store, "issue_counts") if "unsupported_file_type" in r[0]] == [{"unsupported_file_type": 1}]


def test_published_batches_never_change(spark, tmp_path, store, monkeypatch):
    from ledgerloom.plans import ingest as plan
    from ledgerloom.sources.store import BatchConflict

    fixtures.write(tmp_path, "bank.csv", fixtures.BANK)
    ingest(spark, tmp_path, store, "b1")
    before = sorted(map(str, store.read("transactions").collect()))
    fixtures.write(tmp_path, "wallet.csv", fixtures.WALLET)
    with pytest.raises(BatchConflict):
        ingest(spark, tmp_path, store, "b1")
    # A job that dies after its first table leaves a log row and nothing else.
    monkeypatch.setattr(plan, "to_pending", lambda rows: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ingest(spark, tmp_path, store, "b2")
    monkeypatch.undo()
    assert sorted(map(str, store.read("transactions").collect())) == before
    failed = store.read("import_runs").where("persistence_status = 'failed'").collect()
    assert {(r.error_code, r.ingestion_status) for r in failed} == {("ZeroDivisionError", "failed")}
    ingest(spark, tmp_path, store, "b2")
    assert summarize_store(store).first().transactions == 13


def test_stored_files_are_not_parsed_again(spark, tmp_path, store, monkeypatch):
    from ledgerloom.plans import ingest as plan

    fixtures.write(tmp_path, "bank.csv", fixtures.BANK)
    ingest(spark, tmp_path, store, "b1")
    seen = []
    profile = plan.profile_files
    monkeypatch.setattr(plan, "profile_files", lambda content: seen.append(content.count()) or profile(content))
    fixtures.write(tmp_path, "wallet.csv", fixtures.WALLET)
    ingest(spark, tmp_path, store, "b2")
    assert seen == [1]


def test_unchanged_files_are_not_opened(spark, tmp_path, store, monkeypatch):
    from ledgerloom.plans import ingest as plan

    fixtures.write(tmp_path, "bank [1].csv", fixtures.BANK)
    fixtures.write(tmp_path, "blocked.csv", "foo,bar\n1,2\n")
    ingest(spark, tmp_path, store, "b1")
    status = lambda batch: {r.path.rsplit("/", 1)[1]: (r.persistence_status, r.import_id) for r in plan.batch_files(store, batch).collect()}
    held = status("b1")["bank [1].csv"][1]
    assert status("b1") == {"bank [1].csv": ("stored", held), "blocked.csv": ("not_stored", None)}
    opened = []
    read = plan.read_files
    monkeypatch.setattr(plan, "read_files", lambda spark, paths, size: opened.extend(paths) or read(spark, paths, size))
    fixtures.write(tmp_path, "copy.txt", fixtures.BANK)
    ingest(spark, tmp_path, store, "b2")
    assert sorted(p.rsplit("/", 1)[1] for p in opened) == ["blocked.csv", "copy.txt"]
    assert status("b2") == {"bank [1].csv": ("already_imported", held), "copy.txt": ("already_imported", held), "blocked.csv": ("not_stored", None)}
    (tmp_path / "blocked.csv").rename(tmp_path / "blocked.old")
    opened.clear()
    ingest(spark, tmp_path, store, "b3")
    assert opened == [] and set(status("b3").values()) == {("already_imported", held)}
    assert summarize_store(store).first().transactions == 6


def test_large_files_are_read_by_ranges(spark, tmp_path, store):
    def stored(some):
        columns = [c for c in some.read("transactions").columns if c not in ("id", "file_id", "import_id", "import_seq", "source_location", "batch_id")]
        rows = some.read("transactions").select(*columns, "source_location.row_number")
        runs = some.read("import_runs").select("format_id", "ingestion_status", "persistence_status", *COUNTS, F.to_json("issue_counts"))
        return sorted(map(str, rows.collect())), sorted(map(str, runs.collect()))

    fixtures.write(tmp_path, "wallet.csv", fixtures.WALLET)
    fixtures.write(tmp_path, "bank.TXT", fixtures.BANK)
    fixtures.write(tmp_path, "words.csv", "just words\n" * 20)
    ingest(spark, tmp_path, store, "b1")
    split = Store.scratch(spark)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        ingest(spark, tmp_path, split, "b1", split_bytes=100)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert stored(split) == stored(store)
    ingest(spark, tmp_path, split, "b2", split_bytes=100)
    assert summarize_store(split).first().transactions == 13


@pytest.mark.parametrize("batch", ["b/3", "b%203", "b 3", "", "../x", "_x", "b\n"])
def test_batch_ids_that_are_no_folder_names_are_refused(spark, tmp_path, store, batch):
    from ledgerloom.streaming.landing import watch_folder

    fixtures.write(tmp_path, "bank.csv", fixtures.BANK)
    with pytest.raises(ValueError):
        ingest(spark, tmp_path, store, batch)
    with pytest.raises(ValueError):
        watch_folder(spark, store, f"file:{tmp_path}", str(tmp_path / "c"), batch)
    assert store.commits().isEmpty()


def test_corrected_pendings_are_promoted_once(spark, tmp_path, store):
    from ledgerloom.plans.pendings import current_pendings, promote_corrections

    rows = ["2026-01-02,08:00:00,Compra,Quiosque,R$ doze,Pix", "2026-01-03,08:00:00,Compra,Mercado,R$ onze,Pix",
            "2026-01-04,08:00:00,Compra,Feira,R$ dez,Pix", '2026-01-02,09:00:00,Compra,Padaria,"-R$ 3,00",Pix']
    fixtures.write(tmp_path, "w.csv", "\n".join([fixtures.WALLET_HEADER, *rows, ""]))
    ingest(spark, tmp_path, store, "b1")
    ids = {r.candidate.description_raw: r.id for r in store.read("pending_transactions").collect()}
    done = store.read("transactions").first()
    from ledgerloom.operators.validate import CORRECTABLE

    types = {"transaction_date": "date", "amount_minor": "bigint"}
    shape = "pending_id string, " + ", ".join(f"new_{c} {types.get(c, 'string')}" for c in CORRECTABLE)
    def row(pending, **new):
        return (pending, *[new.get(c) for c in CORRECTABLE])
    asked = [row(ids["Quiosque"], amount_minor=1200), row(ids["Mercado"]), row("nobody", amount_minor=1),
             row(ids["Feira"], amount_minor=300, transaction_date=done.transaction_date, description_raw="Padaria")]
    frame = spark.createDataFrame(asked, shape)
    for _ in range(2):
        got = {r.pending_id: r.result for r in promote_corrections(store, frame, "p1", AS_OF).collect()}
        assert got == {ids["Quiosque"]: "transaction", ids["Mercado"]: "empty_correction", "nobody": "pending_not_found", ids["Feira"]: "duplicate"}
        summary = summarize_store(store).first()
        assert (summary.transactions, summary.open_pending, summary.duplicate_candidates) == (2, 1, 1)
    assert {r.id: r.status for r in current_pendings(store).collect()} == {ids["Quiosque"]: "corrected", ids["Feira"]: "corrected", ids["Mercado"]: "open"}
    again = spark.createDataFrame([row(ids["Quiosque"], amount_minor=1300)], shape)
    assert [r.result for r in promote_corrections(store, again, "p2", AS_OF).collect()] == ["pending_not_open"]
    assert summarize_store(store).first().transactions == 2


def test_rows_that_break_a_constraint_go_to_quarantine(spark, tmp_path, store, monkeypatch):
    from ledgerloom.functions import checks

    monkeypatch.setattr(checks, "CURRENCY", "^(?!BRL)[A-Z]{3}$")
    fixtures.write(tmp_path, "bank.csv", fixtures.BANK)
    fixtures.write(tmp_path, "w.csv", fixtures.WALLET_HEADER + "\n31-31-31,99:00:00,Compra,Quiosque,R$ doze,Pix\n")
    ingest(spark, tmp_path, store, "b1")
    assert store.read("transactions").isEmpty() and store.read("pending_transactions").isEmpty()
    held = store.read("quarantine").collect()
    assert sorted(r.target for r in held) == ["pending_transactions"] + ["transactions"] * 6
    assert {tuple(r.violations) for r in held} == {("currency_format",)} and all('"currency":"BRL"' in r.row for r in held)
    for r in store.read("import_runs").collect():
        assert r.records_read == r.transactions_created + r.pending_created + r.duplicates_in_file + r.records_rejected
        assert r.issue_counts["constraint_violation"] in (1, 6)


def test_switches_of_later_batches_count_whatever_their_numbers(spark, store):
    from ledgerloom.plans.maintain import change_dimensions

    shape = "seq bigint, action string, name string, id string"
    rules = spark.createDataFrame([], "seq bigint, action string, id string, name string, priority int, nature string, category_id string, description_exact string, merchant_exact string, counterparty_exact string, source_institution string, card_alias string, created_by_user boolean")
    change_dimensions(store, spark.createDataFrame([(5, "create", "Bikes", None)], shape), rules, "d1")
    made = store.snapshot("categories").first()
    assert made.is_active
    off = change_dimensions(store, spark.createDataFrame([(1, "deactivate", None, made.id), (2, "deactivate", None, "nobody")], shape), rules, "d2")
    assert {r.seq: r.applied for r in off.collect()} == {1: True, 2: False}
    assert not store.snapshot("categories").first().is_active
    change_dimensions(store, spark.createDataFrame([(0, "activate", None, made.id)], shape), rules, "d3")
    assert store.snapshot("categories").first().is_active


def test_layouts_of_another_store(spark, tmp_path, store):
    from ledgerloom.sources.formats import write_registry

    folder = tmp_path / "in"
    folder.mkdir()
    path = fixtures.write(folder, "new.csv", fixtures.NEW_LAYOUT)
    schema = "path string, institution string, currency string, date_order string, approval_seq bigint"
    ingest(spark, folder, store, "b1", approvals=spark.createDataFrame([(path, "Banco Novo", "BRL", "dmy", 3)], schema))
    write_registry(store.snapshot("format_specs"), f"file:{tmp_path}/registry")
    other = Store.scratch(spark)
    (tmp_path / "registry" / "broken.json").write_text('{"format_id": 5, "expected\n')
    ingest(spark, folder, other, "b1", registry_path=f"file:{tmp_path}/registry")
    assert runs_by(other, "detection_status", "issue_counts") == [("unknown", {"registry_invalid": 1})]
    (tmp_path / "registry" / "broken.json").rename(tmp_path / "broken.json")
    ingest(spark, folder, other, "b2", registry_path=f"file:{tmp_path}/registry")
    (run,) = other.read("import_runs").where("batch_id = 'b2'").collect()
    assert (run.detection_status, run.ingestion_status, run.transactions_created) == ("learned", "completed", 2)


def test_corrections_can_be_repeated(spark, store):
    from ledgerloom.plans.correct import correct_batch

    requests = spark.createDataFrame(
        [(1, "t-1", "despesa", None, False, 10, AS_OF)],
        "seq bigint, transaction_id string, nature string, category_name string, remember boolean, rule_priority int, requested_at timestamp",
    )
    first = [r.error_code for r in correct_batch(store, requests, "c1").collect()]
    assert first == ["transaction_not_found"]
    assert [r.error_code for r in correct_batch(store, requests, "c1").collect()] == first


def test_old_limits_are_gone(spark, tmp_path):
    from ledgerloom.sources.files import profile_files, read_files

    fixtures.write(tmp_path, "late.csv", "x\n" * 40 + "Date;Amount\n" + "1;2\n" * 3)
    fixtures.write(tmp_path, "open.csv", 'Date,Amount\n"A,1\nB,2\n')
    fixtures.write(tmp_path, "tail.csv", "Date\n" + "word\n" * 9000 + "a|b\n")
    rows = {r.path.rsplit("/", 1)[1]: r for r in profile_files(read_files(spark, f"file:{tmp_path}")).collect()}
    assert (rows["late.csv"].header_row_number, rows["late.csv"].row_count) == (41, 3)
    assert [r.cells for r in rows["open.csv"].records] == [["A,1\nB,2\n"]]
    assert rows["tail.csv"].delimiter == "|"


def test_both_forms_of_detection_agree(spark):
    from ledgerloom.operators.detect import detect_formats
    from ledgerloom.sources.formats import builtin_specs

    shape = "file_id string, columns array<string>, delimiter string, signature string, issue_code string, irregular_row_count bigint"
    files = spark.createDataFrame(
        [("a", ["data", "historico", "docto", "credito", "debito", "saldo"], ";", "s1", None, 0), ("b", ["x", "y"], ",", "s2", None, 0),
         ("c", None, None, None, "unknown_format", 0), ("d", ["data", "hora"], "|", "s4", None, 0)], shape)
    pick = lambda frame: sorted(map(str, frame.select("file_id", "detection_status", "format_candidates", "selected_spec.format_id").collect()))
    specs = builtin_specs(spark)
    assert pick(detect_formats(files, specs)) == pick(detect_formats(files, specs, inline_max=0))


def test_changed_dimensions_and_review_requests_are_stored(spark, store, tmp_path):
    from ledgerloom.plans.correct import correct_batch
    from ledgerloom.plans.maintain import change_dimensions, request_review_batch

    categories = spark.createDataFrame([(1, "create", "Bikes", None), (2, "create", " ", None)], "seq bigint, action string, name string, id string")
    shape = (
        "seq bigint, action string, id string, name string, priority int, nature string, category_id string, description_exact string,"
        " merchant_exact string, counterparty_exact string, source_institution string, card_alias string, created_by_user boolean"
    )
    rule = (3, "create", None, "Fees", 40, "estorno", None, "TARIFA PACOTE", None, None, None, None, True)
    rules = spark.createDataFrame([rule], shape)
    got = {(r.kind, r.seq): (r.applied, r.error_code) for r in change_dimensions(store, categories, rules, "d1").collect()}
    assert got == {("category", 1): (True, None), ("category", 2): (False, "category_name_required"), ("rule", 3): (True, None)}
    change_dimensions(store, categories, rules, "d1")
    assert store.snapshot("categories").count() == store.snapshot("classification_rules").count() == 1
    assert store.commits().count() == 1

    fixtures.write(tmp_path, "bank.csv", fixtures.BANK)
    ingest(spark, tmp_path, store, "b1")
    paid = store.read("transactions").where("description_raw = 'BOLETO; ESCOLA MUSICAL'").first().id
    asked = spark.createDataFrame([(paid, AS_OF, 5), ("nobody", AS_OF, 6)], "transaction_id string, event_at timestamp, seq bigint")
    request_review_batch(store, asked, "r1")
    assert [r.transaction_id for r in store.read("review_events").collect()] == [paid]
    wanted = spark.createDataFrame(
        [(7, paid, "despesa", "bikes", False, 10, AS_OF)],
        "seq bigint, transaction_id string, nature string, category_name string, remember boolean, rule_priority int, requested_at timestamp",
    )
    assert correct_batch(store, wanted, "c1").collect() == []
    assert store.read("classification_decisions").first().transaction_id == paid
