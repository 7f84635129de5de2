"""Amounts, dates, times, directions and payment context read from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import let, normalize_text, strip

INFLOW, OUTFLOW = "inflow", "outflow"

# Words that give a direction.
INFLOW_WORDS = [
    "CREDIT",
    "CREDITO",
    "DEPOSIT",
    "DEPOSITO",
    "ENTRADA",
    "ESTORNO",
    "RECEIVED",
    "RECEBIDO",
    "RENDIMENTO",
]
OUTFLOW_WORDS = [
    "COMPRA",
    "DEBITO",
    "DEBIT",
    "ENVIADO",
    "PAGAMENTO",
    "PAYMENT",
    "PURCHASE",
    "SAIDA",
    "SAQUE",
    "WITHDRAWAL",
]

# Fixed values: (words looked for, method, instrument), first hit wins.
PAYMENT_HINTS = [
    (["CARTAO"], "credit_card", "credit_card"),
    (["PIX"], "pix", "bank_account"),
    (["BOLETO"], "boleto", "bank_account"),
    (["SAQUE", "DINHEIRO"], "cash", "cash"),
    (["SALDO PICPAY"], "digital_wallet", "wallet"),
    (["TRANSFERENCIA"], "bank_transfer", "bank_account"),
]

DECIMAL_TEXT = r"^([+-]?)(\d*)\.?(\d*)(?:[eE]([+-]?)0*(\d*)(?<=\d))?$"


def to_bigint(digits: Column) -> Column:
    """Integer text -> BIGINT, null beyond its range.

    A failing ``try_cast`` costs an exception inside Spark, so hopeless text never
    reaches it.
    """
    return F.when(digits == "", F.lit(0).cast("bigint")).when(
        F.length(digits) <= 20, digits.try_cast("bigint")
    )


def decimal_to_minor(text: Column, exponent: int = 2) -> Column:
    """Exact decimal text -> integer minor units, null when it would lose digits.

    Works on digits as text, so no precision limit can round a value on the way;
    amounts outside BIGINT are null too.
    """
    if exponent < 0:
        raise ValueError("exponent must not be negative")
    def scale(clean: Column) -> Column:
        parts = [F.regexp_extract(clean, DECIMAL_TEXT, group) for group in (1, 2, 3, 4, 5)]
        return let(F.struct(*[p.alias(n) for p, n in zip(parts, ("sign", "whole", "fraction", "down", "power"))]), to_minor)

    def to_minor(part: Column) -> Column:
        digits = F.concat(part["whole"], part["fraction"])
        # Four digits of exponent already exceed every amount that fits.
        size = F.when(part["power"] == "", F.lit(0)).when(F.length(part["power"]) > 3, F.lit(9999)).otherwise(part["power"].try_cast("int"))
        power = F.when(part["down"] == "-", -size).otherwise(size)
        shift = power + exponent - F.length(part["fraction"])
        kept = F.greatest(F.length(digits) + shift, F.lit(0))
        scaled = F.when(
            shift >= 0,
            F.concat(F.ltrim(digits, F.lit("0")), F.repeat(F.lit("0"), F.least(shift, F.lit(40)))),
        ).when(
            F.substring(digits, kept + 1, F.length(digits)).rlike("^0*$"),
            F.substring(digits, F.lit(1), kept),
        )
        unsigned = F.when(digits.rlike("^0*$") | (scaled == ""), F.lit("0")).otherwise(scaled)
        # Without any digit the text was no number at all.
        return F.when(
            digits != "",
            to_bigint(F.concat(F.when(part["sign"] == "-", F.lit("-")).otherwise(F.lit("")), unsigned)),
        )

    return let(strip(text), lambda clean: F.when(clean.rlike(DECIMAL_TEXT), scale(clean)))


def plain_minus(text: Column) -> Column:
    """Strip and turn the typographic minus signs into ASCII."""
    return F.translate(strip(text), "−–", "--")


def parse_money(text: Column) -> Column:
    """Money text in either thousands convention -> minor units, null if invalid."""
    def amount(raw: Column) -> Column:
        minor = let(F.regexp_replace(raw, "[^0-9,.]", ""), lambda kept: let(one_dot(kept), _plain_number_to_minor))
        return F.when(_is_negative(raw), -minor).otherwise(minor)

    return let(plain_minus(text), amount)


def _is_negative(raw: Column) -> Column:
    return (raw.startswith("(") & raw.endswith(")")) | raw.startswith("-")


def one_dot(kept: Column) -> Column:
    """Digits with separators -> digits with the decimal mark as the only dot."""
    comma, dot = kept.contains(","), kept.contains(".")
    short_tail = kept.rlike(r"[,.]\d{1,2}$")
    return (
        F.when(comma & dot & kept.rlike(r",[^.]*$"), F.translate(kept, ",.", "."))
        .when(comma & dot, F.translate(kept, ",", ""))
        .when(comma & short_tail, F.translate(kept, ",", "."))
        .when(dot & short_tail, kept)
        .otherwise(F.translate(kept, ",.", ""))
    )


def _plain_number_to_minor(number: Column) -> Column:
    """Unsigned digits with at most one dot; cheaper than the general form above."""
    whole = F.substring_index(number, ".", 1)
    cents = F.rtrim(
        F.when(number.contains("."), F.substring_index(number, ".", -1)).otherwise(F.lit("")),
        F.lit("0"),
    )
    return F.when(
        number.rlike(r"^(\d+\.?\d*|\.\d+)$") & (F.length(cents) <= 2),
        to_bigint(F.ltrim(F.concat(whole, F.rpad(cents, 2, "0")), F.lit("0"))),
    )


def normalize_signed_amount(minor: Column, direction: Column) -> Column:
    """struct(value, code): outflows negative, inflows positive, else the reason."""
    value = (
        F.when(minor == 0, F.lit(None).cast("bigint"))
        .when(direction == OUTFLOW, -F.abs(minor))
        .when((direction == INFLOW) & (minor > 0), minor)
        .when(direction.isNull() & (minor < 0), minor)
    )
    code = (
        F.when(minor == 0, F.lit("zero_amount"))
        .when((direction == INFLOW) & (minor < 0), F.lit("conflicting_amount_direction"))
        .when(direction.isNull() & (minor > 0), F.lit("ambiguous_amount_direction"))
    )
    return F.struct(value.alias("value"), code.alias("code"))


def direction_from_amount_text(text: Column) -> Column:
    return let(
        plain_minus(text),
        lambda raw: F.when(_is_negative(raw), F.lit(OUTFLOW)).when(raw.startswith("+"), F.lit(INFLOW)),
    )


def direction_from_words(text: Column) -> Column:
    def decide(words: Column) -> Column:
        inflow = F.arrays_overlap(words, F.array(*[F.lit(word) for word in INFLOW_WORDS]))
        outflow = F.arrays_overlap(words, F.array(*[F.lit(word) for word in OUTFLOW_WORDS]))
        return F.when(inflow & ~outflow, F.lit(INFLOW)).when(outflow & ~inflow, F.lit(OUTFLOW))

    return let(F.split(normalize_text(text), " "), decide)


def payment_context(text: Column) -> Column:
    """struct(method, instrument) from the first matching hint."""
    hints = F.array(
        *[
            F.struct(F.lit("|".join(words)).alias("words"), F.lit(method).alias("method"), F.lit(kind).alias("instrument"))
            for words, method, kind in PAYMENT_HINTS
        ]
    )
    first = let(
        normalize_text(text),
        lambda normalized: F.get(F.filter(hints, lambda h: F.regexp_like(normalized, h["words"])), F.lit(0)),
    )
    return let(first, lambda hit: F.struct(hit["method"].alias("method"), hit["instrument"].alias("instrument")))


def _date_of(text: Column, pattern: str, year: int, month: int, day: int) -> Column:
    """Calendar date from three groups of one pattern; null for impossible dates."""
    y = F.regexp_extract(text, pattern, year)
    m = F.lpad(F.regexp_extract(text, pattern, month), 2, "0")
    d = F.lpad(F.regexp_extract(text, pattern, day), 2, "0")

    def date(part: Column) -> Column:
        # Only the last days of short months are left for try_cast to refuse.
        plausible = (part["y"] != "0000") & part["m"].between("01", "12") & part["d"].between("01", "31")
        return F.when(plausible, F.concat_ws("-", part["y"], part["m"], part["d"]).try_cast("date"))

    return F.when(text.rlike(pattern), let(F.struct(y.alias("y"), m.alias("m"), d.alias("d")), date))


YEAR_FIRST = r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})$"
YEAR_LAST = r"^(\d{1,2})([-/])(\d{1,2})\2(\d{4})$"


def parse_date(text: Column, order: Column | None = None) -> Column:
    """Date in a declared order (ymd, dmy, mdy); without one only unambiguous text."""
    return let(strip(text), lambda clean: _date(clean, order))


def _date(clean: Column, order: Column | None) -> Column:
    ymd = _date_of(clean, YEAR_FIRST, 1, 3, 4)
    dmy = _date_of(clean, YEAR_LAST, 4, 3, 1)
    mdy = _date_of(clean, YEAR_LAST, 4, 1, 3)
    # Without a declared order the text decides only if one reading is no month.
    first = F.lpad(F.regexp_extract(clean, YEAR_LAST, 1), 2, "0")
    second = F.lpad(F.regexp_extract(clean, YEAR_LAST, 3), 2, "0")
    undeclared = (
        F.when(clean.rlike(YEAR_FIRST), ymd)
        .when((first > "12") & (second <= "12"), dmy)
        .when((second > "12") & (first <= "12"), mdy)
    )
    if order is None:
        return undeclared
    return (
        F.when(order.isNull(), undeclared)
        .when(order == "ymd", ymd)
        .when(order == "dmy", dmy)
        .when(order == "mdy", mdy)
    )


CLOCK = r"^(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?$"


def parse_time(text: Column) -> Column:
    """``HH:mm:ss``; null for blank and for impossible times (see bad_time)."""
    def clock(clean: Column) -> Column:
        hour, minute, second = (
            F.lpad(F.regexp_extract(clean, CLOCK, group), 2, "0") for group in (1, 2, 3)
        )
        return F.when(
            clean.rlike(CLOCK) & (hour <= "23") & (minute <= "59") & (second <= "59"),
            F.concat_ws(":", hour, minute, second),
        )

    return let(strip(text), clock)


def bad_time(text: Column) -> Column:
    """Text is present but is no time of day."""
    return (strip(text) != "") & parse_time(text).isNull()
