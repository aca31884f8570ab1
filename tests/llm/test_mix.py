"""Problem 9: shares, repeats, the draw."""

import random

import pytest

from knotwork.llm import mix
from knotwork.llm.mix import Mix, budgets

DOCS = "doc_id long, text string, source string, message_id string, key double, uses int"
TARGETS = "source string, target_share double, max_repeats int"


def corpus():
    rng = random.Random(8)
    rows = []
    for i in range(900):
        source = rng.choice(["big"] * 6 + ["Big ", " mid", "MID", "small", None, "untargeted"])
        rows.append((i, "Subject: s\n\n" + "word " * rng.randint(1, 60), source, None if i % 5 else f"<{i}>", 1.0, 1))
    rows.append((5000, rows[0][1], rows[0][2], "<0>", 1.0, 1))
    rows += [(None, "x", "big", None, 1.0, 1), (6000, None, "small", None, 1.0, 1), (6001, "", "small", None, 1.0, 1), rows[7]]
    return rows


def mixed(spark, rows, targets, **options):
    records, report = mix.mix_sources(spark.createDataFrame(rows, DOCS), spark.createDataFrame(targets, TARGETS), Mix(**options))
    return records.collect(), {r.source: r for r in report.collect()}


WANT = [("BIG", 0.5, 1), ("mid ", 0.3, 2), ("small", 0.2, 4)]


def test_shares_and_repeats(spark):
    records, report = mixed(spark, corpus(), WANT)
    most = {"big": 1, "mid": 2, "small": 4}
    assert {r.source for r in records} == set(most)
    assert all(1 <= r.uses <= most[r.source] for r in records)
    assert len({r.doc_id for r in records}) == len(records) and not {5000} & {r.doc_id for r in records}
    for r in report.values():
        assert r.mixed_tokens <= r.budget_tokens and r.budget_tokens - r.mixed_tokens < 80
        assert abs(r.actual_share - r.target_share) < 0.03
        assert r.mixed_tokens == sum(x.n_tokens * x.uses for x in records if x.source == r.source)
    for source, n in most.items():  # complete epochs first: uses differ by one at most
        uses = {r.uses for r in records if r.source == source}
        assert max(uses) - min(uses) <= 1


def test_same_draw_again_other_draw_otherwise(spark):
    a, b, c = (sorted((r.doc_id, r.uses) for r in mixed(spark, corpus(), WANT, seed=s)[0]) for s in (1, 1, 2))
    assert a == b and a != c


def test_prefix_is_by_key(spark, monkeypatch):
    """Few and many buckets select the same records."""
    a = sorted((r.doc_id, r.uses) for r in mixed(spark, corpus(), WANT)[0])
    monkeypatch.setattr(mix, "BUCKETS", 3)
    assert sorted((r.doc_id, r.uses) for r in mixed(spark, corpus(), WANT)[0]) == a


def test_too_large_a_total_is_capped_and_reported(spark):
    records, report = mixed(spark, corpus(), [*WANT, ("nowhere", 0.1, 3), (None, 0.5, 1)], total=10**9)
    assert report["nowhere"].mixed_tokens == 0 and report["nowhere"].target_share == pytest.approx(0.1 / 1.1)
    assert report["small"].mixed_tokens == 4 * report["small"].available_tokens
    assert max(r.uses for r in records) == 4


def test_empty(spark):
    assert mixed(spark, [], WANT)[0] == [] and mixed(spark, corpus(), [])[0] == []


def test_budgets():
    plan = {b.source: b for b in budgets([("a", 0.5, 2), ("b", 0.5, 1)], {"a": 30, "b": 100}, None)}
    assert plan["a"].tokens == plan["b"].tokens == 60 and plan["a"].epochs == 2 and plan["a"].rest == 0
    assert plan["b"].epochs == 0 and plan["b"].rest == 60


def test_quality_prefers_text():
    assert mix.quality("S: x\n\n" + "plain words here " * 40) > mix.quality("S: x\n\n" + "!!1?2 " * 120) >= 0.1
    assert mix.quality(None) == mix.quality("") == 0.1


def test_records_are_those_of_sql_over_the_measures(spark, monkeypatch):
    """Epochs first, then the prefix in key order, as one window over all says; weights far from 1, bars refined often."""
    duckdb = pytest.importorskip("duckdb")
    rows, options = corpus(), Mix(total=9000)
    monkeypatch.setattr(mix, "SORTED", 3)
    monkeypatch.setattr(mix, "BUCKETS", 4)
    drawn = {}
    whole = mix.spool
    monkeypatch.setattr(mix, "spool", lambda df: drawn.setdefault("t", whole(df)))
    records, report = mix.mix_sources(spark.createDataFrame(rows, DOCS), spark.createDataFrame(WANT, TARGETS), options)
    records, report = records.collect(), report.collect()
    measured = drawn["t"].toPandas()
    assert measured.quality.min() < 0.2
    plan = spark.createDataFrame(report).toPandas()
    con = duckdb.connect()
    con.register("measured", measured)
    con.register("plan", plan)
    want = con.execute("""
      WITH budget AS (SELECT *, least(max_repeats, floor(budget_tokens / available_tokens)) AS epochs FROM plan WHERE available_tokens > 0),
      prefixed AS (SELECT m.*, b.epochs, CASE WHEN b.epochs < b.max_repeats THEN b.budget_tokens - b.epochs * b.available_tokens ELSE 0 END AS rest,
        sum(n_tokens) OVER (PARTITION BY m.source ORDER BY key, record ROWS UNBOUNDED PRECEDING) AS upto FROM measured m JOIN budget b USING (source))
      SELECT doc_id, source, n_tokens, (epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::INT AS uses FROM prefixed WHERE uses > 0
    """).fetchall()
    assert sorted(want) == sorted((r.doc_id, r.source, r.n_tokens, r.uses) for r in records)
