"""Comparable text as native column expressions (no Python per row)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Private-use character that marks text in need of the slower folding.
UNFOLDS = "\ue000"

# Words that name only the kind of a movement, never its other party.
GENERIC_WORDS = [
    "BOLETO",
    "CARTAO",
    "CARD",
    "COMPRA",
    "CREDITO",
    "CREDIT",
    "DEBITO",
    "DEBIT",
    "LANCAMENTO",
    "MASTERCARD",
    "PAGAMENTO",
    "PAYMENT",
    "PURCHASE",
    "PIX",
    "SAQUE",
    "SALDO",
    "TRANSFERENCIA",
    "TRANSFER",
    "VISA",
    "WITHDRAWAL",
]


@lru_cache(maxsize=1)
def folding_tables() -> tuple[str, str, dict[str, str]]:
    """(from, to, expansions) that reproduce NFKD followed by mark removal.

    Built from the Unicode database of the driver: characters that fold to one
    ASCII letter or digit go to the ``translate`` pair, combining marks are
    the tail of ``from`` without a partner (deleted), and the few characters that
    unfold to several are kept apart. Anything else non-ASCII ends up as a
    separator anyway.
    """
    source: list[str] = []
    target: list[str] = []
    deleted: list[str] = []
    expansions: dict[str, str] = {}
    for code in range(0x80, 0x110000):
        char = chr(code)
        if unicodedata.combining(char):
            deleted.append(char)
            continue
        if not unicodedata.decomposition(char):
            continue
        folded = "".join(
            part
            for part in unicodedata.normalize("NFKD", char)
            if not unicodedata.combining(part)
        )
        if not any(part.isascii() and part.isalnum() for part in folded):
            continue
        if len(folded) == 1:
            source.append(char)
            target.append(folded)
        else:
            expansions[char] = "".join(
                part if part.isascii() and part.isalnum() else " " for part in folded
            )
    return "".join(source + deleted), "".join(target), expansions


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often body mentions it."""
    return F.transform(F.array(value), lambda bound: body(bound))[0]


def strip(text: Column) -> Column:
    """Trim every Unicode blank, not just U+0020."""
    return F.trim(text, F.lit(WHITESPACE))


def fold_accents(text: Column) -> Column:
    """Compatibility-decompose and drop combining marks; ASCII text passes through.

    The one-to-one translation also turns characters that unfold to several into a
    mark, so the slower branch runs only on texts that hold one of them. Looking
    characters up in a table costs the same however many there are; a regular
    expression class of that size would be tried member by member.
    """
    source, target, expansions = folding_tables()
    many = "".join(expansions)
    marked_source, marked_target = many + source, UNFOLDS * len(many) + target
    # One literal instead of hundreds; Catalyst folds it to a constant map.
    pairs = "\x1f".join(f"{char}\x1e{plain}" for char, plain in expansions.items())
    table = F.str_to_map(F.lit(pairs), F.lit("\x1f"), F.lit("\x1e"))

    def unfold(original: Column) -> Column:
        letters = F.transform(F.split(original, ""), lambda ch: F.coalesce(F.element_at(table, ch), ch))
        return F.translate(F.array_join(letters, ""), source, target)

    folded = let(
        F.translate(text, marked_source, marked_target),
        lambda t: F.when(t.contains(UNFOLDS), unfold(text)).otherwise(t),
    )
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(folded)


def normalize_text(text: Column) -> Column:
    """Accent-free upper-case words separated by single spaces."""
    return F.upper(F.trim(F.regexp_replace(fold_accents(text), "[^A-Za-z0-9]+", " ")))


def normalize_column_name(text: Column) -> Column:
    return F.lower(normalize_text(text))


def words_are_generic(normalized: Column) -> Column:
    """Same test as :func:`is_generic_description` on already normalised text."""
    words = F.array(*[F.lit(word) for word in GENERIC_WORDS])
    return (normalized != "") & (F.size(F.array_except(F.split(normalized, " "), words)) == 0)


def is_generic_description(text: Column) -> Column:
    return words_are_generic(normalize_text(text))


def slug(text: Column) -> Column:
    """Identifier part made from a name; ``custom`` when nothing usable is left."""
    joined = F.regexp_replace(normalize_column_name(text), " ", "_")
    return F.when(joined == "", F.lit("custom")).otherwise(joined)


def casefold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
