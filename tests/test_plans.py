import json

import pytest

from millrace.plans.flows import Registered, build_flow, check_flow, standard_registry
from millrace.plans.graph import Block, Edge, Graph


def test_validation_collects_all():
    g = Graph([Block("a"), Block("a"), Block("b"), Block("c"), Block("d")], [Edge("a", "b"), Edge("c", "b"), Edge("b", "zz")])
    errors, warnings = g.problems()
    assert len(errors) == 3 and "twice" in errors[0] and "no block 'zz'" in errors[1] and "2 inputs" in errors[2]
    assert warnings == ["block 'd' is connected to nothing"]
    assert "cycle" in Graph([Block("a"), Block("b")], [Edge("a", "b"), Edge("b", "a")]).problems()[0][0]


def test_orders_of_a_diamond():
    g = Graph([Block("a"), Block("b"), Block("c"), Block("d", many_inputs=True)], [Edge("a", "b"), Edge("a", "c"), Edge("b", "d"), Edge("c", "d")])
    assert g.problems() == ([], []) and g.order() == ["a", "b", "c", "d"] and g.depth_first() == ["a", "b", "d", "c"]
    assert g.mermaid().splitlines()[1] == '  b0["a (transform)"]' and g.mermaid().count("-->") == 4
    assert g.graphviz().startswith("digraph") and g.text().splitlines()[0] == "a -> b, c"
    assert g.summary() == {"blocks": 4, "edges": 4, "kind_transform": 4}


FLOW = {
    "flowId": "f", "version": 1,
    "blocks": [{"instanceId": "in", "blockKey": "source"}, {"instanceId": "hi", "blockKey": "rows/filter"}, {"instanceId": "lo", "blockKey": "rows/filter"}, {"instanceId": "all", "blockKey": "rows/union"}],
    "connections": [{"from": "in", "to": "hi"}, {"from": "in", "to": "lo"}, {"from": "hi", "to": "all"}, {"from": "lo", "to": "all"}],
    "config": {"hi": {"column": "id", "operator": "GreaterThan", "value": 7}, "lo": {"column": "id", "operator": "LessThan", "value": 2}},
}


def test_flow_from_json(spark):
    out = build_flow(json.dumps(FLOW), standard_registry(), {"in": spark.range(10)})
    assert [*out] == ["all"] and sorted(r[0] for r in out["all"].collect()) == [0, 1, 8, 9]


def test_flow_errors_are_all_told():
    r = standard_registry()
    with pytest.raises(ValueError):
        r.register("rows/filter", Registered(lambda df, c: df))
    assert not r.try_register("rows/select", Registered(lambda df, c: df)) and r.keys("rows/f") == ["rows/filter"]
    bad = {"blocks": [{"instanceId": ""}, {"instanceId": "a", "blockKey": "nope"}, {"instanceId": "A", "blockKey": "source"}], "connections": [{"from": "a", "to": "zz"}]}
    errors = check_flow(bad, r)
    assert len(errors) == 4
    with pytest.raises(ValueError, match="nope"):
        build_flow(bad, r, {})
