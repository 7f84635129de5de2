"""Steps that are shared by all cores, made once, or shuffled narrowly."""

from pyspark.sql import functions as F

from ledgerloom.catalogue import queries, views
from ledgerloom.functions import keys
from ledgerloom.operators import detect, mapping
from ledgerloom.plans import correct
from ledgerloom.sources import files, formats


def test_profiles_of_one_row_group_are_spread(spark, tmp_path):
    rows = [(i, f"p {i}", i % 50) for i in range(40)]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    profiles = views.layout_profiles(spark, str(tmp_path))
    assert profiles.rdd.getNumPartitions() >= views.spread_tasks(spark) and profiles.count() == 40


def test_delimiter_cuts_the_text_once(spark):
    text = spark.createDataFrame([("a;b\nc;d, e\n\nf;g",), ("x",), (None,)], "text string")
    found = text.select(files.detect_delimiter(F.col("text")).alias("d"))
    assert [r.d for r in found.collect()] == [";", None, None]
    assert found._jdf.queryExecution().analyzed().toString().count("split(") == 1


def test_packed_hashes_come_back(spark):
    texts = ["ab" * 32, "AB", "abc", "", "zz", "é", None, "01", "\x01ab", "0"]
    packed = spark.createDataFrame([(t,) for t in texts], "t string").select("t", keys.pack_hex(F.col("t")).alias("p"))
    rows = packed.select("t", "p", keys.unpack_hex(F.col("p")).alias("u")).collect()
    assert all(r.t == r.u for r in rows) and len({bytes(r.p) for r in rows if r.p is not None}) == 9
    assert max(len(r.p) for r in rows if r.p is not None) == 33


def test_requests_are_checked_once(spark, monkeypatch):
    staged = []
    keep = correct.stage_shared
    monkeypatch.setattr(correct, "stage_shared", lambda frame, name: staged.append(name) or keep(frame, name))
    queries._corrected(spark, "/root/testdata/sf0.001")
    assert staged == ["checked-requests"]


def test_names_are_scored_once_for_all_fields(spark):
    known = [s for names in mapping.SYNONYMS.values() for s in names]
    names = [*known, "transacao data", "data data", "valor em data", "da", "x", "memo\nvalor", "a forma b de pagamento", "pagamento forma"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", mapping._scored(F.col("n"))["scores"].alias("s"))
    for r in rows.collect():
        model = [mapping._known_score(r.n, synonyms) for synonyms in mapping.SYNONYMS.values()]
        assert [x if (x or 0) >= 0.6 else None for x in r.s] == [x if (x or 0) >= 0.6 else None for x in model], r.n
    plan = mapping.suggest_mapping(rows.select(F.array("n").alias("columns")))._jdf.queryExecution().analyzed().toString()
    assert "array_intersect" not in plan and plan.count("memo, ") < 4


def test_specs_are_scored_once_per_registry(spark):
    specs = formats.builtin_specs(spark)
    files_ = spark.createDataFrame(
        [(1, ["data", "hora", "valor"], ",", None), (2, None, ";", None), (3, ["data", None, "historico"], ";", None), (4, [], None, "x")],
        "i int, columns array<string>, delimiter string, issue_code string",
    )
    found = detect.detect_formats(files_, specs)
    by_file = {r.i: r.format_candidates for r in found.collect()}
    expected = {r.format_id: (set(r.expected_columns), r.delimiter) for r in specs.collect()}
    for i, columns, delimiter in ((1, {"data", "hora", "valor"}, ","), (3, {"data", "historico"}, ";")):
        model = {k: round(len(e & columns) / len(e) * 0.85 + 0.15 * (d == delimiter), 4) for k, (e, d) in expected.items()}
        assert {c.format_id: c.confidence for c in by_file[i]} == {k: model[k] for k in sorted(model, key=model.get)[-3:]}
    assert all(c.confidence is None for c in by_file[2]) and by_file[4] is None
    assert "array_intersect" not in found._jdf.queryExecution().optimizedPlan().toString()
