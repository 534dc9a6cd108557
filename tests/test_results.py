"""JSON results: what is read, skipped and refused."""

import random

import pytest

from ledgerloom.operators import evaluate
from ledgerloom.sources import results


def frame(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "q long, json string")


def test_sampler_results(spark):
    text = '''[{"account_ids": ["a", "b", 7]}, {"party_ids": []}, {"entity_ids": [12]}, "noise", {"other": [1]},
      {"edges": [{"from_id": "a", "to_id": "b", "e_type": "HAS_PAID"}, {"from_id": "a", "to_id": "b"}, 5, {"from_id": 1, "to_id": 2, "e_type": "X", "more": {}}]}]'''
    nodes, edges = results.sampled(frame(spark, text, "[]"), keys=("q",))
    assert sorted(map(tuple, nodes.collect())) == [(0, "Account", "7", 2), (0, "Account", "a", 0), (0, "Account", "b", 1), (0, "Resolved_Entity", "12", 0)]
    assert sorted(map(tuple, edges.collect())) == [(0, "1", "2", "X"), (0, "a", "b", "HAS_PAID")]
    nodes, edges = results.sampled(frame(spark, '[{"account_ids": "a"}, {"edges": {}}]'))
    assert nodes.collect() == [] and edges.collect() == []
    for bad in ('{"account_ids": []}', "7"):
        with pytest.raises(Exception, match="no list"):
            results.sampled(frame(spark, bad))[0].collect()


def test_fetched_accounts(spark):
    kinds = {"n": "long", "x": "double"}
    good = '[{"noise": 1}, {"Accounts": [{"v_id": "a", "attributes": {"n": 3.0, "x": 1, "s": "t"}}, {"v_id": "b", "attributes": {"n": 4, "x": 0.5}}]}]'
    assert sorted(map(tuple, results.fetched_accounts(frame(spark, good), kinds).collect())) == [("a", 3, 1.0), ("b", 4, 0.5)]
    assert results.fetched_accounts(frame(spark, '[{"Accounts": []}]'), kinds).collect() == []
    assert results.fetched_accounts(frame(spark, good, good), kinds).count() == 4
    for bad, why in (('[]', "no list"), ('[{"Other": []}]', "no list"), ('[{"Accounts": {}}]', "no list"), ('[{"Accounts": [{"attributes": {"n": 1, "x": 1}}]}]', "no v_id"),
                     ('[{"Accounts": [{"v_id": "a", "attributes": {"n": true, "x": 1}}]}]', "n is no long"), ('[{"Accounts": [{"v_id": "a", "attributes": {"n": 1.5, "x": 1}}]}]', "n is no long"),
                     ('[{"Accounts": [{"v_id": "a", "attributes": {"n": 1}}]}]', "x is no double"), ('[{"Accounts": [{"v_id": "a", "attributes": {"n": 1, "x": null}}]}]', "x is no double"),
                     ('[{"Accounts": [{"v_id": "a"}]}]', "is no")):
        with pytest.raises(Exception, match=why):
            results.fetched_accounts(frame(spark, bad), kinds).collect()


def test_fetched_edges(spark):
    edge = '{"from_id": "a", "to_id": "b", "attributes": {"n": 2}}'
    good = '[{"Collected": [{"attributes": {"out_edges": [%s, %s]}}, {"attributes": {"out_edges": []}}]}]' % (edge, edge.replace('"b"', '"c"'))
    assert sorted(map(tuple, results.fetched_edges(frame(spark, good), {"n": "int"}).collect())) == [("a", "b", 2), ("a", "c", 2)]
    for bad, why in (('[{"Other": []}]', "no list"), ('[{"Collected": [5]}]', "out_edges"), ('[{"Collected": [{"attributes": {}}]}]', "out_edges"),
                     ('[{"Collected": [{"attributes": {"out_edges": [{"from_id": "a", "attributes": {"n": 1}}]}}]}]', "lacks an end")):
        with pytest.raises(Exception, match=why):
            results.fetched_edges(frame(spark, bad), {"n": "int"}).collect()


def test_seeds(spark):
    good = '[{"x": 1}, {"result": [{"attributes": {"account_id": "a", "pu_label": 1}}, 3, {"v_id": "z"}, {"attributes": {"account_id": 9, "pu_label": 0}}]}]'
    assert sorted(map(tuple, results.seeds(frame(spark, good)).collect())) == [("9", 0), ("a", 1)]
    with pytest.raises(Exception, match="no account_id"):
        results.seeds(frame(spark, '[{"result": [{"attributes": {"pu_label": 1}}]}]')).collect()


def test_selected_epochs_equal_the_step_by_step_form(spark):
    r, rows, want = random.Random(3), [], {}
    for run in range(60):
        best, stop, seen = evaluate.BestEpoch(3, 0.01, 0.05), None, 0
        for epoch in range(r.randint(1, 15)):
            primary, second = r.randrange(20) / 20, r.choice([None, r.randrange(10) / 10])
            rows.append((run, epoch, primary, second))
            if stop is None:
                best.update(primary, float("-inf") if second is None else second)
                seen += 1
                stop = epoch if best.done else None
        want[run] = (best.epoch, best.best, best.second, stop, seen)
    r.shuffle(rows)
    epochs = spark.createDataFrame(rows, "run long, epoch int, primary double, second double")
    got = {x.run: tuple(x)[1:] for x in evaluate.select_epochs(epochs, 3, 0.01, 0.05).collect()}
    assert got == want and any(x[3] is not None for x in want.values()) and evaluate.select_epochs(epochs.limit(0)).collect() == []
