"""Suggest which source column feeds which canonical field."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions.text import let

ACCEPTED_SCORE = 0.6
CONTAINED_SCORE = 0.8

# Names under which each field is known, fields in assignment order.
SYNONYMS = {
    "transaction_date": [
        "data",
        "date",
        "data transacao",
        "data da transacao",
        "data movimento",
        "transaction date",
    ],
    "description": [
        "descricao",
        "description",
        "historico",
        "origem destino",
        "estabelecimento",
        "merchant",
        "memo",
        "detalhes",
        "details",
    ],
    "amount": ["valor", "valor r", "amount", "montante", "transaction amount"],
    "direction": ["tipo", "natureza", "direction", "movimento"],
    "transaction_time": ["hora", "time", "horario"],
    "credit": ["credito", "credit", "entrada"],
    "debit": ["debito", "debit", "saida"],
    "balance": ["saldo", "balance"],
    "external_id": ["docto", "documento", "id", "transaction id"],
    "payment_method": ["forma de pagamento", "payment method", "metodo pagamento"],
}


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _score(name: Column, words: Column, synonyms: list[str]) -> Column:
    """1 for an exact name, else the best word overlap, at least 0.8 if contained; null if that is not accepted.

    words: the distinct words of a name of several, null for one word alone. One word against several
    shares at most half of them, which is not accepted, so the overlap is of names of several words only.
    """
    # What holds a synonym holds the synonyms inside that one too.
    least = [s for s in synonyms if not any(t in s and t != s for t in synonyms)]
    # No synonym has a line end.
    inside = F.lit("\n".join(synonyms)).contains(name) & ~name.contains("\n")
    overlaps = []
    for known in (list(dict.fromkeys(s.split(" "))) for s in synonyms):
        if len(known) > 1:
            shared = reduce(lambda a, b: a + b, [F.array_contains(words, w).cast("int") for w in known])
            overlaps.append(let(shared, lambda n, k=len(known): F.when(n > 1, n / (F.size(words) + k - n))))
    contained = F.when(_any([name.contains(s) for s in least]) | inside, F.lit(CONTAINED_SCORE))
    partial = F.when(words.isNotNull(), F.greatest(contained, F.lit(0.0), *overlaps)).otherwise(contained) if overlaps else contained
    return F.when(name.isin(synonyms), F.lit(1.0)).otherwise(partial)


def _known_score(name: str, synonyms: list[str]) -> float | None:
    """_score of a fixed name."""
    if name in synonyms:
        return 1.0
    words, found = set(name.split(" ")), [CONTAINED_SCORE for s in synonyms if s in name or name in s]
    for known in (set(s.split(" ")) for s in synonyms):
        if min(len(words), len(known)) > 1:
            found.append(len(words & known) / len(words | known))
    return max(found, default=None)


def _known_scores() -> Column:
    """Name -> scores for every field, as a constant, of the names in SYNONYMS."""
    known = [(s, [_known_score(s, names) for names in SYNONYMS.values()]) for s in dict.fromkeys(s for names in SYNONYMS.values() for s in names)]
    scores = [F.array(*[F.lit(x).cast("double") for x in row]) for _, row in known]
    return F.create_map(*[c for (name, _), row in zip(known, scores) for c in (F.lit(name), row)])


def _scored(name: Column) -> Column:
    """A column name with its score for every field, each worked out once; names in SYNONYMS have theirs."""
    words = F.when(name.contains(" "), F.array_distinct(F.split(name, " ")))
    several = let(words, lambda cut: F.when(F.size(cut) > 1, cut))
    tested = let(several, lambda cut: F.array(*[_score(name, cut, names) for names in SYNONYMS.values()]))
    return F.struct(name.alias("name"), F.coalesce(F.try_element_at(_known_scores(), name), tested).alias("scores"))


def assign_columns(columns: Column) -> Column:
    """array<struct(score, column)> aligned with SYNONYMS; null where nothing fits.

    A fold over the fields: each takes the best column not taken by an earlier field;
    equal scores go to the column that sorts last.
    """

    def choose(scored: Column, picked: Column, field: Column) -> Column:
        free = F.filter(
            scored,
            lambda c: (F.get(c["scores"], field) >= ACCEPTED_SCORE)
            & ~F.exists(picked, lambda p: F.coalesce(p["column"] == c["name"], F.lit(False))),
        )
        best = F.array_max(F.transform(free, lambda c: F.struct(F.get(c["scores"], field).alias("score"), c["name"].alias("column"))))
        return F.array_append(picked, best)

    return let(
        F.filter(
            F.transform(F.filter(columns, lambda name: name != ""), _scored),
            lambda c: F.exists(c["scores"], lambda score: score >= ACCEPTED_SCORE),
        ),
        lambda scored: F.aggregate(
            F.array(*[F.lit(i) for i in range(len(SYNONYMS))]),
            F.when(scored.isNotNull(), F.array().cast("array<struct<score:double,column:string>>")),
            lambda picked, field: choose(scored, picked, field),
        ),
    )


def suggest_mapping(profiles: DataFrame) -> DataFrame:
    """Adds suggested_mapping, mapping_confidence, missing_fields, mapping_complete."""
    place = {field: i for i, field in enumerate(SYNONYMS)}

    def suggestion(picked: Column) -> Column:
        def score(field: str) -> Column:
            return F.coalesce(F.get(picked, F.lit(place[field]))["score"], F.lit(0.0))

        amount = F.greatest(score("amount"), score("credit"), score("debit"))
        missing = F.array(
            F.when(score("transaction_date") == 0, F.lit("transaction_date")),
            F.when(score("description") == 0, F.lit("description")),
            F.when(amount == 0, F.lit("amount")),
        )
        return F.struct(
            F.struct(
                *[F.get(picked, F.lit(place[f]))["column"].alias(f) for f in schemas.MAPPED_FIELDS]
            ).alias("mapping"),
            F.round((score("transaction_date") + score("description") + amount) / 3, 4).alias("confidence"),
            F.array_compact(missing).alias("missing"),
        )

    return (
        profiles.withColumn("_suggestion", let(assign_columns(F.col("columns")), suggestion))
        .withColumn("suggested_mapping", F.col("_suggestion.mapping"))
        .withColumn("mapping_confidence", F.col("_suggestion.confidence"))
        .withColumn("missing_fields", F.col("_suggestion.missing"))
        .withColumn("mapping_complete", F.size("missing_fields") == 0)
        .drop("_suggestion")
    )
