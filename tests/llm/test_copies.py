"""Problem 7: copies against grouping in memory, runs over partition borders."""

import json
import random

from hypothesis import given
from hypothesis import strategies as st

from knotwork.llm import copies
from knotwork.llm.copies import fold, fold_attributes

NODES = "embed_id long, label string, attributes string, key string, n int"
EDGES = "embed_id long, source string, target string, label string, attributes string, h long"


def test_fold():
    assert fold("  The-END,of\tit_all ") == "the end of it all"
    assert fold("STRASSE") == fold("Straße") and fold("") == fold("…!") == ""


def test_attributes_by_value():
    same = fold_attributes('{"A b": "X, y", "n": [1, {"k": null}]}')
    assert fold_attributes('{"n":[1.0,{"K ":null}],"a-B":" x Y"}') == same
    for other in ('{"a b": "x y", "n": [{"k": null}, 1]}', '{"a b": "x y", "n": [true, {"k": null}]}', '{"a b": "x y", "n": ["1", {"k": null}]}', '{"a b": "x y"}', "a b x y n 1 k"):
        assert fold_attributes(other) != same
    assert fold_attributes('["A"]') == fold_attributes('[ "a" ]') == fold_attributes("a")


@given(st.dictionaries(st.text("abAB -", min_size=1, max_size=4), st.one_of(st.none(), st.booleans(), st.integers(-3, 3), st.text("xY .", max_size=5)), max_size=4), st.randoms())
def test_rewriting_changes_nothing(value, rng):
    items = list(value.items())
    rng.shuffle(items)
    rewritten = {" " + k.swapcase() + ".": (v.upper() if isinstance(v, str) else v) for k, v in items}
    if len({fold(k) for k in value}) == len(value):
        assert fold_attributes(json.dumps(rewritten, indent=2)) == fold_attributes(json.dumps(value))


def groups(spark, canonical):
    runs = copies.copy_runs(canonical)
    members = {(r.tbl, r.embed_id_a, r.embed_id_b) for r in copies.copy_members(runs).collect()}
    counts = {(r.tbl, r.embed_id): r.n_copies for r in copies.copy_groups(runs).collect()}
    return members, counts


def test_against_grouping(spark):
    """One group with over a third of the rows, which so runs over several partitions."""
    rng = random.Random(2)
    rows = []
    for i in range(1200):
        key = rng.choice(["Hot"] * 5 + [f"k{rng.randrange(300)}" for _ in range(6)])
        key = rng.choice([key, key.upper(), f" {key}. "])
        rows.append((rng.randrange(4000), key, rng.choice(["{}", " { } "]), "k", 1))
    seen = {}
    rows = [r for r in rows if seen.setdefault(r[0], (fold(r[1]))) == fold(r[1])]
    rows += rows[:100] + [(None, "a", "{}", "", 1), (5000, None, "{}", "", 1), (5001, "a", None, "", 1)]
    members, counts = groups(spark, copies.canonical_nodes(spark.createDataFrame(rows, NODES)))
    by = {}
    for e, label, attributes, *_ in rows:
        if None not in (e, label, attributes):
            by.setdefault(fold(label), set()).add(e)
    assert counts == {("nodes", min(v)): len(v) for v in by.values()}
    assert members == {("nodes", min(v), e) for v in by.values() for e in v if e != min(v)}


def test_edges_by_exact_ends(spark):
    rows = [
        (3, "a", "b", "x", '{"K": 1}', 0), (1, "a", "b", "y", '{"k":1}', 0), (2, "A", "b", "x", '{"k":1}', 0), (4, "ab", "", "x", '{"k":1}', 0),
        (5, "a", "b", None, '{"k":1}', 0), (6, None, "b", "x", '{"k":1}', 0), (1, "a", "b", "y", '{"k":1}', 0),
    ]
    members, counts = groups(spark, copies.canonical_edges(spark.createDataFrame(rows, EDGES)))
    assert members == {("edges", 1, 3), ("edges", 1, 5)}
    assert counts == {("edges", 1): 3, ("edges", 2): 1, ("edges", 4): 1}


def test_all_equal_and_empty(spark):
    df = spark.createDataFrame([(i, "l", "{}", "", 0) for i in range(500)], NODES)
    members, counts = groups(spark, copies.canonical_nodes(df))
    assert counts == {("nodes", 0): 500} and len(members) == 499
    assert groups(spark, copies.canonical_nodes(df.where("false"))) == (set(), {})
    long = spark.createDataFrame([(1, "x " * 200_000, "{}", "", 0), (2, "X-" * 200_000, "{}", "", 0)], NODES)
    assert groups(spark, copies.canonical_nodes(long))[0] == {("nodes", 1, 2)}
