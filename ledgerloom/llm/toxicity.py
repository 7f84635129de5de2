"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage

#: Plain insults, the fixed part of the lexicon.
INSULTS = frozenset(
    "arse asshole bastard bitch bozo bullshit clown clueless coward crap creep cretin cunt damn degenerate dick dimwit "
    "disgusting dolt dumb dumbass dunce faggot fool freak fuck fucker fucking garbage gross halfwit hate hideous idiot "
    "idiotic imbecile jackass jerk kill liar lazy loser lunatic maggot moron moronic nasty nitwit parasite pathetic pig "
    "prick psycho pussy racist rat retard ridiculous rubbish scum scumbag shit shithead shut sick sicko simpleton slut "
    "snake stupid sucker suck thug toxic traitor trash twat twit ugly useless vermin vile weasel whore wimp worthless "
    "arschloch depp dumm dummkopf hurensohn idioten miststück schlampe schwein trottel wichser connard débile "
    "imbécile merde ordure salaud salope cabrón estúpido gilipollas idiota imbécil mierda pendejo puta tonto".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros".split())
#: Letters written as signs or digits.
DISGUISES = str.maketrans("013457@$!|€", "oieastasile")
NEAR = 5
#: Bounds of the training sample: rows per label, in order of a hash of doc_id.
SAMPLE_ROWS = 6000
#: Learned words and word beginnings, most telling first.
LEARNED_TERMS = 400
LEAST_TERM_DOCS = 5
PREFIXES = (4, 5)
FOLDS = 5
SEED = 11

FEATURES = [
    "insult_rate",
    "insult_kinds",
    "learned_rate",
    "learned_kinds",
    "learned_peak",
    "second_person_rate",
    "near_second_person",
    "capital_rate",
    "shout_rate",
    "punctuation_rate",
    "exclamation_rate",
    "obfuscation_rate",
    "disguised_insults",
    "log_words",
]

_WORD = re.compile(r"\S+")
_EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?[]^_`{|}~«»“”‘’„…–—¡¿"
_MIXED = re.compile(r"[^\W\d_][0-9@$!|€*]+[^\W\d_]")


def terms(word: str) -> list[str]:
    """The word and its beginnings, marked apart."""
    return [word, *(f"{word[:n]}~" for n in PREFIXES if len(word) > n)]


def words_of(text: str) -> list[str]:
    return [w for w in (raw.strip(_EDGE) for raw in _WORD.findall(text.lower())) if w]


def describe(text: str, lexicon: dict[str, float]) -> list[float]:
    """The FEATURES of a text; all 0 for one without words."""
    raw = _WORD.findall(text)
    if not raw:
        return [0.0] * len(FEATURES)
    n = len(raw)
    words = [w.strip(_EDGE) for w in text.lower().split()]
    counts = Counter(words)
    insults = {w: c for w, c in counts.items() if w in INSULTS}
    learned = {}
    for w, c in counts.items():
        weight = max((lexicon[t] for t in terms(w) if t in lexicon), default=0.0) if w else 0.0
        if weight:
            learned[w] = (weight, c)
    hits = [i for i, w in enumerate(words) if w in insults or w in learned] if insults or learned else []
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON] if counts.keys() & SECOND_PERSON else []
    close, at = 0, 0
    for i in hits:
        while at < len(you) and you[at] < i - NEAR:
            at += 1
        close += at < len(you) and you[at] <= i + NEAR
    letters = sum(map(str.isalpha, text)) or 1
    mixed = [w for w in counts if _MIXED.search(w)]
    disguised = sum(counts[w] for w in mixed if w not in INSULTS and w.translate(DISGUISES) in INSULTS)
    return [
        sum(insults.values()) / n,
        float(len(insults)),
        sum(c for _, c in learned.values()) / n,
        float(len(learned)),
        max((weight for weight, _ in learned.values()), default=0.0),
        len(you) / n,
        close / n,
        sum(map(str.isupper, text)) / letters,
        sum(w.isupper() and len(w) > 2 for w in raw) / n,
        sum(text.count(c) for c in ".,;:") / n,
        sum(text.count(c) for c in "!?") / n,
        sum(counts[w] for w in mixed) / n,
        float(disguised),
        math.log1p(n),
    ]


def _emit_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted({t for w in set(words_of(text or "")) for t in terms(w)}) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.string()))], names=["toxic", "terms"])


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Terms that toxic texts of the sample (text, toxic) have much more often than others: term -> log ratio.

    Document counts are made by Spark; at most LEARNED_TERMS terms come to the driver.
    """
    found = sample.mapInArrow(_emit_terms, "toxic int, terms array<string>").select("toxic", F.explode("terms").alias("term"))
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    yes, no = F.sum("toxic"), F.sum(1 - F.col("toxic"))
    ratio = F.log((F.col("yes") / totals.get(1, 1)) / ((F.col("no") + 0.5) / totals.get(0, 1)))
    counted = found.groupBy("term").agg(yes.alias("yes"), no.alias("no")).filter(F.col("yes") >= LEAST_TERM_DOCS).withColumn("ratio", ratio).filter("ratio > 1")
    best = counted.orderBy(F.desc(F.col("ratio") * F.log1p("yes")), "term").limit(LEARNED_TERMS)
    return {r["term"]: float(r["ratio"]) for r in best.collect()}


def _emit_features(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon.value
        for batch in batches:
            rows = [describe(text or "", known) for text in batch.column("text").to_pylist()]
            columns = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *FEATURES])

    return run


def fold_of(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo FOLDS; fold 0 is held out. A null id is the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Learns from labels (doc_id, toxic) outside fold 0 only, at most sample_rows rows per label:
    folds 1 and 2 give the learned lexicon, folds 1 to 3 the trees, fold 4 the calibration. Trees
    and calibration weigh the rows so that both labels keep their share of all labels. Only the
    text is an input of the score.
    Labels of unknown documents or null labels are ignored; of several labels of a document the
    highest counts. Null and empty texts have all features 0. If the training rows lack a label,
    every score is that of the only one known, or 0. Repeated rows each get their row; an empty
    table gives none.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("fold", fold_of()).filter("fold != 0").withColumn("_h", F.xxhash64(F.lit(SEED), "doc_id"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    ranked = [known.filter(F.col("toxic") == v).orderBy("_h", "doc_id").limit(sample_rows) for v in (0, 1)]
    sample = stage(ranked[0].unionByName(ranked[1]).drop("_h"), "toxicity-sample")
    # At most 2 * sample_rows ids, a bound by parameter.
    labelled = stage(texts.join(F.broadcast(sample), "doc_id"), "toxicity-texts")
    lexicon = learn_lexicon(labelled.filter("fold in (1, 2)").select("text", "toxic"))
    features = texts.mapInArrow(_emit_features(spark.sparkContext.broadcast(lexicon)), ", ".join(["doc_id long", *(f"{f} double" for f in FEATURES)]))
    features = stage(features, "toxicity-features")
    held_out = (fold_of() == 0).alias("held_out")
    train = stage(
        labelled.mapInArrow(_emit_labelled(spark.sparkContext.broadcast(lexicon)), ", ".join(["toxic int", "fold long", *(f"{f} double" for f in FEATURES)])), "toxicity-train"
    )
    # A bounded sample: few partitions keep the many small passes of the training short. Each row
    # stands for as many labels as the sample left out for it.
    weights = [max(1.0, totals.get(v, 0) / max(sample_rows, 1)) for v in (0, 1)]
    train = train.coalesce(2).withColumn("weight", F.when(F.col("toxic") == 1, weights[1]).otherwise(weights[0]))
    seen = {(r["toxic"], r["part"]) for r in train.select("toxic", F.when(F.col("fold") == 4, 1).otherwise(0).alias("part")).distinct().collect()}
    if not {(0, 0), (1, 0)} <= seen:
        only = float(any(v == 1 for v, _ in seen))
        return features.select("doc_id", held_out, F.lit(only).alias("score"), F.lit(int(only)).alias("predicted"))
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    trees = GBTClassifier(labelCol="toxic", featuresCol="features", weightCol="weight", maxIter=15, maxDepth=4, stepSize=0.2, seed=SEED)
    model = trees.fit(assemble.transform(train.filter("fold != 4")).select("toxic", "features", "weight"))
    rated = lambda df: model.transform(assemble.transform(df)).withColumn("rated", vector_to_array("probability")[1])
    apart = train.filter("fold = 4") if {(0, 1), (1, 1)} <= seen else train
    isotonic = IsotonicRegression(labelCol="toxic", featuresCol="rated", predictionCol="calibrated", weightCol="weight").fit(
        rated(apart).select("toxic", "rated", "weight")
    )
    scored = isotonic.transform(rated(features).select("doc_id", "rated")).select("doc_id", held_out, F.least(F.lit(1.0), F.greatest(F.lit(0.0), "calibrated")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _emit_labelled(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon.value
        for batch in batches:
            rows = [describe(text or "", known) for text in batch.column("text").to_pylist()]
            columns = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("fold"), *columns], names=["toxic", "fold", *FEATURES])

    return run
