"""Set-based operators against one-row-at-a-time models, with and without hot keys.

``hot_rows_min=2`` makes nearly every key hot, so the same data takes the spread path.
"""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import dedup, history, reports, reviews, rules, skew

START = datetime(2026, 1, 1)


@pytest.mark.parametrize("hot", [2, 10**9])
def test_duplicates_match_a_sequential_store(spark, hot):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        # A third of all rows share one fingerprint.
        mark = "hot" if i % 3 == 0 else f"f{rng.randint(0, 40)}"
        key = f"k{rng.randint(0, 60)}" if rng.random() < 0.4 else None
        rows.append((f"t{i:04d}", key, mark, START.date(), i // 100, i % 100))
    schema = "id string, strong_dedup_key string, semantic_fingerprint string, transaction_date date, import_seq int, row_seq int"
    kept, expected = [], {}
    for tx in rows:
        first = next((k for k in kept if (tx[1] and k[1] == tx[1]) or (not tx[1] and k[2] == tx[2])), None)
        if tx[1]:
            first = next((k for k in kept if k[1] == tx[1]), None)
        expected[tx[0]] = first[0] if first else None
        if first is None:
            kept.append(tx)
    frame = spark.createDataFrame(rows, schema).repartition(7)
    early = dedup.resolve_duplicates(frame.where("import_seq < 3"), hot_rows_min=hot)
    stored = early.where("existing_transaction_id is null").select(*frame.columns)
    late = dedup.resolve_duplicates(frame.where("import_seq >= 3"), stored, hot_rows_min=hot)
    got = {r.id: r.existing_transaction_id for r in early.unionByName(late).collect()}
    assert got == expected


@pytest.mark.parametrize("hot", [2, 10**9])
def test_first_rows_and_lookups_keep_null_keys(spark, hot):
    rows = [(i, None if i % 5 == 0 else ("hot" if i % 3 else f"k{i % 7}")) for i in range(300)]
    frame = spark.createDataFrame(rows, "i int, k string").repartition(5)
    marked = skew.mark_first(frame.where("k is not null"), ["k"], ["i"], carry=["i"], hot_rows_min=hot)
    first = {}
    for i, k in rows:
        if k is not None:
            first.setdefault(k, i)
    assert {r.i: (r.is_first, r.first_i) for r in marked.collect()} == {
        i: (first[k] == i, None if first[k] == i else first[k]) for i, k in rows if k is not None}
    right = frame.where("k is not null").groupBy("k").agg(F.min("i").alias("least"))
    counts = frame.groupBy("k").agg(F.count(F.lit(1)).alias("_n"))
    joined = skew.lookup(frame, right, ["k"], ["i"], skew.hot_keys(counts, ["k"], "_n", hot))
    assert {r.i: r.least for r in joined.collect()} == {i: first.get(k) for i, k in rows}


def review_model(events):
    found, open_review = [], None
    for at, seq, event, reason, cand in events:
        if event == "resolved":
            if open_review:
                open_review["status"], open_review["resolved"] = "resolved", at
                open_review = None
        elif open_review:
            open_review.update(reason=reason, cand=sorted(cand))
        else:
            open_review = {"created": at, "status": "open", "reason": reason, "cand": sorted(cand), "resolved": None}
            found.append(open_review)
    return sorted((r["created"], r["status"], r["reason"], r["cand"], r["resolved"]) for r in found)


@pytest.mark.parametrize("hot", [2, 10**9])
def test_reviews_and_history_match_sequential_models(spark, hot):
    rng = random.Random(11)
    events, decisions = [], []
    for seq in range(500):
        tx = "hot" if rng.random() < 0.4 else f"t{rng.randint(0, 20)}"
        at = START + timedelta(minutes=rng.randint(0, 600))
        events.append((tx, rng.choice(["opened", "opened", "resolved"]), f"r{seq % 3}", ["b", "a"][: seq % 3], at, seq))
        decisions.append((f"d{seq}", tx, at, seq))
    frame = spark.createDataFrame(
        events, "transaction_id string, event string, reason string, candidate_rule_ids array<string>, event_at timestamp, seq long").repartition(6)
    got = {}
    for r in reviews.reviews(frame, hot).collect():
        got.setdefault(r.transaction_id, []).append((r.created_at, r.status, r.reason, list(r.candidate_rule_ids), r.resolved_at))
    expected = {}
    for tx in {e[0] for e in events}:
        ordered = sorted((e[4], e[5], e[1], e[2], e[3]) for e in events if e[0] == tx)
        if model := review_model(ordered):
            expected[tx] = model
    assert {k: sorted(v) for k, v in got.items()} == expected

    table = spark.createDataFrame(decisions, "id string, transaction_id string, decided_at timestamp, seq long")
    dated = {r.id: (r.superseded_at, r.is_current) for r in history.decision_history(table, hot_rows_min=hot).collect()}
    for tx in {d[1] for d in decisions}:
        line = sorted((d[2], d[3], d[0]) for d in decisions if d[1] == tx)
        for one, following in zip(line, [*line[1:], None]):
            assert dated[one[2]] == (following[0] if following else None, following is None)
    current = {r.id for r in history.current_decisions(table).collect()}
    assert current == {k for k, v in dated.items() if v[1]}


def test_one_second_of_one_key_spreads_over_runs(spark, monkeypatch):
    """All rows of a key at the same time: runs are cut by rows, and open reviews need no episodes."""
    from ledgerloom.operators import runs

    monkeypatch.setattr(runs, "RUN_ROWS", 40)
    rng = random.Random(3)
    events = [("hot" if i % 4 else f"t{i % 12}", rng.choice(["opened", "resolved"]), f"r{i % 5}", ["b", "a"], START, i) for i in range(400)]
    frame = spark.createDataFrame(
        events, "transaction_id string, event string, reason string, candidate_rule_ids array<string>, event_at timestamp, seq long").repartition(6)
    counted = runs.running_count(frame, "transaction_id", ["event_at", "seq"], F.col("event") == "resolved", "n", 100)
    cut = runs._cut(frame, "transaction_id", ["event_at", "seq"], 100)
    sizes = [r["count"] for r in cut.where("_hot").groupBy("_run").count().collect()]
    assert len(sizes) >= 6 and max(sizes) <= 80
    for r in counted.collect():
        assert r.n == sum(e[0] == r.transaction_id and e[5] < r.seq and e[1] == "resolved" for e in events)
    following = runs.neighbours(frame, "transaction_id", ["event_at", "seq"], ["seq"], True, 100)
    for r in following.collect():
        assert r.next_seq == min((e[5] for e in events if e[0] == r.transaction_id and e[5] > r.seq), default=None)
    for hot in (2, 10**9):
        whole = reviews.reviews(frame, hot).where("status = 'open'").drop("status", "resolved_at", "episode")
        assert sorted(map(str, reviews.open_reviews(frame, hot).select(*whole.columns).collect())) == sorted(map(str, whole.collect()))


RULE_SCHEMA = "id string, priority int, nature string, category_id string, description_exact string, merchant_exact string, counterparty_exact string, source_institution string, card_alias string"
TX_SCHEMA = "id string, description_normalized string, merchant_name string, counterparty_name string, source_institution string, card_alias string"


def test_rules_match_a_nested_loop(spark, monkeypatch):
    rng = random.Random(2)
    words = ["LOJA", "CAFE", ""]
    maybe = lambda: rng.choice([None, None, *words])
    # Description, merchant, both, description with institution and card.
    used = [(1, 0, 0, 0, 0), (0, 1, 0, 0, 0), (1, 1, 0, 0, 0), (1, 0, 0, 1, 1)]
    shape = lambda i: [rng.choice(words) if on else None for on in used[i % 4]]
    rule_rows = [(f"r{i:03d}", rng.choice([100, 400, 800]), rng.choice(["despesa", "estorno"]), rng.choice([None, "c1", "c2"]), *shape(i)) for i in range(120)]
    rule_rows = [r for r in rule_rows if any(v is not None for v in r[4:])]
    tx_rows = [(f"t{i:03d}", rng.choice(words), *[rng.choice([None, "lojá", "Cafe", ""]) for _ in range(2)], rng.choice(["Loja", "CAFE"]), maybe()) for i in range(200)]
    norm = lambda v: {"lojá": "LOJA", "Cafe": "CAFE", "Loja": "LOJA"}.get(v, v)
    expected = {}
    for tx in tx_rows:
        hits = [r for r in rule_rows if all(w is None or (v is not None and w == norm(v)) for w, v in zip(r[4:], tx[1:]))]
        top = [r for r in hits if r[1] == max(h[1] for h in hits)]
        results = {(r[2], r[3]) for r in top}
        reason = "no_matching_rule" if not hits else "priority_conflict" if len(results) > 1 else None
        ids = sorted(r[0] for r in top)
        expected[tx[0]] = (reason, ids, ids[0] if reason is None else None)
    txs, table = spark.createDataFrame(tx_rows, TX_SCHEMA), spark.createDataFrame(rule_rows, RULE_SCHEMA)
    for limit in (skew.BROADCAST_ROWS_MAX, 0):
        monkeypatch.setattr(rules, "BROADCAST_ROWS_MAX", limit)
        got = {r.id: (r.review_reason, list(r.matched_rule_ids), r.winning_rule_id) for r in rules.propose(txs, table).collect()}
        assert got == expected


def test_long_rule_lists_are_made_once(spark, monkeypatch):
    """Lists of many rules stay out of the decisions per tuple, whichever way they are put together."""
    rule_rows = [(f"r{i:02d}", 100, "estorno", None, "LOJA", None, None, None, None) for i in range(5)]
    rule_rows += [(f"m{i:02d}", 100, "estorno", None, None, "CAFE", None, None, None) for i in range(4)]
    rule_rows += [("s00", 100, "estorno", None, None, None, f"P{i}", None, None) for i in range(3)]
    tx_rows = [(f"t{i:02d}", "LOJA" if i % 2 else "X", "Cafe" if i % 3 else None, f"p{i % 4}", "Y", None) for i in range(48)]
    expected = {}
    for tx in tx_rows:
        ids = [f"r{i:02d}" for i in range(5)] * (tx[1] == "LOJA") + [f"m{i:02d}" for i in range(4)] * (tx[2] == "Cafe") + ["s00"] * (tx[3] != "p3")
        expected[tx[0]] = sorted(ids)
    txs, table = spark.createDataFrame(tx_rows, TX_SCHEMA), spark.createDataFrame(rule_rows, RULE_SCHEMA)
    staged = {}
    keep = rules.stage_shared
    monkeypatch.setattr(rules, "stage_shared", lambda frame, name: staged.setdefault(name, keep(frame, name)))
    monkeypatch.setattr(rules, "FEW_IDS", 3)
    for most in (rules.BROADCAST_IDS_MAX, 0):
        staged.clear()
        monkeypatch.setattr(rules, "BROADCAST_IDS_MAX", most)
        rows = rules.propose(txs, table).collect()
        assert {r.id: r.matched_rule_ids for r in rows} == expected
        longest = max((len(v) for r in staged["rule-decisions"].collect() for v in r if isinstance(v, list)), default=0)
        assert longest <= 3
        staged.clear()
        joined = rules.propose(txs, table, lambda ids: {"n": F.size(ids), "listed": F.array_join(ids, ",")}).collect()
        assert {r.id: (r.n, r.listed) for r in joined} == {k: (len(v), ",".join(v)) for k, v in expected.items()}
        assert {r.id: r[r.__fields__.index("review_reason")] for r in joined} == {r.id: r.review_reason for r in rows}


def test_listing_limits(spark):
    frame = spark.createDataFrame([("a", START, "open")], "id string, created_at timestamp, status string")
    for limit in (0, 1001):
        with pytest.raises(ValueError):
            reports.list_open_pending(frame, limit)
    assert reports.list_open_pending(frame, 1).count() == 1


def test_match_plan_has_no_nested_loop(spark):
    txs = spark.createDataFrame([("t", "LOJA", None, None, "B", None)], TX_SCHEMA)
    table = spark.createDataFrame([("r", 1, "estorno", None, "LOJA", None, None, "B", None)], RULE_SCHEMA)
    plan = rules.propose(txs, table)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
