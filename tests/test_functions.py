"""Expression tables against small literal frames and the Python standard library."""

import hashlib
import json
import random
import re
import unicodedata
import uuid
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import keys, text, values


def apply(spark, expression, items, kind="string"):
    rows = list(enumerate(items))
    frame = spark.createDataFrame(rows, f"i int, x {kind}").repartition(3)
    return [row.y for row in frame.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def model_normalize(value):
    stripped = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
    return re.sub(r"[^A-Za-z0-9]+", " ", stripped).strip().upper()


def test_normalize_text_matches_unicode_definition(spark):
    rng = random.Random(7)
    pool = [chr(c) for c in [*range(1, 0x250), *range(0x300, 0x370), *range(0x1E00, 0x1F00), *range(0x2000, 0x2200), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFF60), 0x1D400, 0x1F100, 0xBD, 0x2460, 0xAC00]]
    items = ["".join(rng.choices(pool, k=rng.randint(0, 12))) for _ in range(3000)]
    items += ["Crédito recebido", "  Origem / Destino ", "ﬁm ½ №", "", "ASCII only"]
    assert apply(spark, text.normalize_text, items) == [model_normalize(x) for x in items]


def test_every_folded_character(spark):
    source, _, expansions = text.folding_tables()
    items = [f"a{c}b" for c in [*source, *expansions]]
    assert apply(spark, text.normalize_text, items) == [model_normalize(x) for x in items]


def test_generic_descriptions_and_slug(spark):
    items = ["Cartão Visa", "PIX", "Pix Maria", "", "--", "compra débito"]
    assert apply(spark, text.is_generic_description, items) == [True, True, False, False, False, True]
    assert apply(spark, text.slug, ["Banco São José", "!!", "a  b"]) == ["banco_sao_jose", "custom", "a_b"]


@pytest.mark.parametrize(
    "raw,minor",
    [
        ("R$ 7.081,36", 708136), ("−R$ 3,07", -307), ("$82,019.40", 8201940), ("(6.66)", -666),
        ("913", 91300), ("R$ sete", None), (" ", None), ("4,5,67", None), ("8.7.65", None),
        ("2.345.678", 234567800), ("R$ -31", 3100), ("44-", 4400), ("9.876,543", None), ("8.", 800),
        (".7", 70), ("6,4", 640), ("3,200", 320000), ("5.432,", 543200), ("7.000,9100", 700091), (" – 2,6 ", -260),
        ("99999999999999999999", None), ("1" * 40, None),
    ],
)
def test_parse_money(spark, raw, minor):
    assert apply(spark, values.parse_money, [raw]) == [minor]


def test_decimal_to_minor(spark):
    items = ["61.09", "-7.41", "3.337", "4e3", "2.5E-1", "sNaN", " ", "+.8", "9.", " 13 ", "6e30", "0e44", "00.0000", "7.1e-3", ".", "5e0001", "8E+00002"]
    expected = []
    for item in items:
        try:
            scaled = Decimal(item.strip()) * 100
            ok = scaled.is_finite() and scaled == scaled.to_integral_value() and abs(scaled) < 2**63
            expected.append(int(scaled) if ok else None)
        except Exception:
            expected.append(None)
    assert apply(spark, values.decimal_to_minor, items) == expected
    assert apply(spark, lambda c: values.decimal_to_minor(c, 0), ["12", "1.5"]) == [12, None]
    with pytest.raises(ValueError):
        values.decimal_to_minor(F.lit("1"), -1)


def test_signed_amount(spark):
    frame = spark.createDataFrame(
        [(0, 731, "outflow"), (1, -731, "outflow"), (2, 86, "inflow"), (3, -86, "inflow"),
         (4, -19, None), (5, 19, None), (6, 0, "outflow")], "i int, m long, d string")
    rows = frame.select("i", values.normalize_signed_amount(F.col("m"), F.col("d")).alias("s")).orderBy("i").collect()
    assert [(r.s.value, r.s.code) for r in rows] == [
        (-731, None), (-731, None), (86, None), (None, "conflicting_amount_direction"),
        (-19, None), (None, "ambiguous_amount_direction"), (None, "zero_amount")]


def test_directions_and_payment_context(spark):
    assert apply(spark, values.direction_from_words, ["Entrada de salário", "Débito mensal", "Aviso", "Compra e estorno", ""]) == [
        "inflow", "outflow", None, None, None]
    assert apply(spark, values.direction_from_amount_text, ["−R$ 88", "+15", "(7,2)", "61", " -9"]) == [
        "outflow", "inflow", "outflow", None, "outflow"]
    got = apply(spark, values.payment_context, ["Cartão PicPay", "Pix recebido", "boleto", "Dinheiro", "Saldo PicPay", "Transferência", "x"])
    assert [(g.method, g.instrument) for g in got] == [
        ("credit_card", "credit_card"), ("pix", "bank_account"), ("boleto", "bank_account"), ("cash", "cash"),
        ("digital_wallet", "wallet"), ("bank_transfer", "bank_account"), (None, None)]


def test_dates_and_times(spark):
    items = ["07/09/2031", "27/11/2031", "11/27/2031", "2031-11-27", "2031/2/9", "06/06/2031", "30/02/2031", "45/45/2031", "", "2031-11/27", "27/11/31", "0000-09-09", " 27-11-2031 "]
    assert apply(spark, values.parse_date, items) == [
        None, date(2031, 11, 27), date(2031, 11, 27), date(2031, 11, 27), date(2031, 2, 9), None, None, None, None, None, None, None, date(2031, 11, 27)]
    assert apply(spark, lambda c: values.parse_date(c, F.lit("dmy")), ["07/09/2031", "7-9-2031", "2031-09-07"]) == [
        date(2031, 9, 7), date(2031, 9, 7), None]
    assert apply(spark, lambda c: values.parse_date(c, F.lit("mdy")), ["07/09/2031"]) == [date(2031, 7, 9)]
    times = ["6:4", "19:27:41", "25:10", "11:11:77", "", "?"]
    assert apply(spark, values.parse_time, times) == ["06:04:00", "19:27:41", None, None, None, None]
    assert apply(spark, values.bad_time, times) == [False, False, True, True, False, True]


def test_record_hash_matches_compact_json(spark):
    rng = random.Random(3)
    pool = ['"', "\\", "/", "é", "\n", "\t", "\x01", "\x1f", "\x0b", "u001F", "\\u001F", "a", "\x7f", "−", " "]
    items = [["".join(rng.choices(pool, k=rng.randint(0, 6))) for _ in range(rng.randint(0, 4))] for _ in range(800)]
    expected = [hashlib.sha256(json.dumps(x, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest() for x in items]
    assert apply(spark, keys.record_hash, items, "array<string>") == expected


def test_name_uuid_and_external_ids(spark):
    items = ["", "abc", "é", *[hashlib.sha256(str(i).encode()).hexdigest() for i in range(50)]]
    assert apply(spark, keys.name_uuid, items) == [str(uuid.uuid5(uuid.NAMESPACE_URL, x)) for x in items]
    assert apply(spark, keys.is_reliable_external_id, ["0", "000", "", "  ", None, "10", "A0", " 0 "]) == [
        False, False, False, False, False, True, True, False]


def test_dedup_keys_and_rule_fingerprint(spark):
    row = spark.createDataFrame(
        [("Straße BANK", None, " 12 ", date(2026, 7, 1), -5, "BRL", "LOJA")],
        "source_institution string, source_account_ref string, external_id string, transaction_date date, amount_minor long, currency string, description_normalized string")
    names = keys.columns_of(*row.columns)
    got = row.select(keys.strong_key(names).alias("s"), keys.semantic_fingerprint(names).alias("f")).first()
    sha = lambda *parts: hashlib.sha256("\x1f".join(parts).encode()).hexdigest()
    assert got.s == sha("strasse bank", "", " 12 ", "2026-07-01", "-5", "BRL")
    assert got.f == sha("strasse bank", "2026-07-01", "-5", "BRL", "LOJA")
    rule = {"priority": 800, "nature": "despesa", "category_id": None, "description_exact": "LOJA", "merchant_exact": None,
            "counterparty_exact": None, "source_institution": "X", "card_alias": None}
    frame = spark.createDataFrame([tuple(rule.values())], "priority int, nature string, category_id string, description_exact string, merchant_exact string, counterparty_exact string, source_institution string, card_alias string")
    payload = json.dumps(rule, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    assert frame.select(keys.rule_fingerprint(keys.columns_of(*rule)).alias("f")).first().f == hashlib.sha256(payload.encode()).hexdigest()
