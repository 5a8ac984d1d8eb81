import json

import pytest
from conftest import rows

from millrace.operators.shred import Shape, _load_deep, entity_table, parse, shred, with_owner

SHAPE = Shape({"batches": ("batchid",), "journals": ("journalid",), "blocks": ("blockname",)}, frozenset({"batches", "journals"}), frozenset({"params"}))
FIELDS = {"batch": ("batchId",), "journal": ("journalId",), "block": ("blockName",), "note": ("note",)}
KINDS = {"batches": "batch", "journals": "journal", "blocks": "block"}


def entities(spark, docs):
    df = spark.createDataFrame([(i, d, "clash") for i, d in docs], "id string, text string, node string")
    return entity_table(shred(df, "id", "text", SHAPE), KINDS, FIELDS)


def test_lists_maps_single_objects_and_owners(spark):
    doc = {"Blocks": {"x": {"blockName": "one"}, "two": {"note": True}}, "params": json.dumps({"batches": {"batchId": "b", "journals": [{"journalId": 1}, {"JournalId": 2.5, "note": None}]}})}
    e = entities(spark, [("d", json.dumps(doc)), ("d", json.dumps(doc)), ("w", json.dumps(json.dumps(json.dumps({"blocks": [{"blockName": "n"}, "text", None]}))))])
    assert rows(e.select("record_id", "kind", "batch", "journal", "block", "map_key", "note")) == sorted(
        [("d", "block", None, None, "one", "x", None), ("d", "block", None, None, None, "two", "true"), ("d", "batch", "b", None, None, None, None), ("d", "journal", None, "1", None, None, None), ("d", "journal", None, "2.5", None, None, None), ("w", "block", None, None, "n", None, None)],
        key=repr,
    )
    journals = with_owner(e.where("kind = 'journal'").drop("batch"), e.where("kind = 'batch'"), "batch", "parent")
    assert rows(journals.select("journal", "parent")) == [("1", "b"), ("2.5", "b")]


def test_invalid_null_empty_and_odd_documents(spark):
    deep = "[" * 100_000
    bad = [("a", None), (None, "{}"), ("b", ""), ("c", '{"blocks": [{"blockName": "cut'), ("d", '{"x": NaN}'), ("e", "3"), ("f", '"text"'), ("g", deep), ("h", "{} {}")]
    assert rows(entities(spark, bad)) == []
    assert rows(entities(spark, [])) == []
    odd = [("s", '{"blocks": [{"blockName": "\\ud800"}, {"blockName": "' + "y" * 100_000 + '"}, {}, {"blockName": {"a": 1}}]}')]
    found = rows(entities(spark, odd).select("block"))
    assert [(x[0] or "")[:2] for x in found] == ["?", "yy", "", ""] or sorted((x[0] or "")[:2] for x in found) == ["", "", "?", "yy"]


def test_deep_but_valid(spark):
    doc = '{"a":' * 400 + '{"blocks": [{"blockName": "deep"}]}' + "}" * 400
    assert rows(entities(spark, [("d", doc)]).select("block")) == [("deep",)]


def test_parse():
    assert parse('"{\\"a\\": 1}"') == {"a": 1}
    assert parse("nonsense") is None and parse(None) is None


def test_deeper_than_the_json_module_goes_and_wrapped_often(spark):
    deep = '{"a":[' * 50_000 + '{"blocks": [{"blockName": "deep"}]}' + "]}" * 50_000
    wrapped = '{"blocks": [{"blockName": "w"}]}'
    for _ in range(12):
        wrapped = json.dumps(wrapped)
    got = entities(spark, [("d", deep), ("w", wrapped), ("cut", deep[:-1]), ("more", deep + "]")]).select("record_id", "block")
    assert rows(got) == [("d", "deep"), ("w", "w")]


def test_the_parser_for_deep_documents_reads_what_the_json_module_reads():
    good = ['{"a": [1, -2.5e3, true, false, null, "x\\u00e9\\n", {}, [], {"b": {"c": []}}], "a": 2}', " [ ] ", '"t"', "3", '{"k" : [ { } , 1 ] }', "-0", "1E2"]
    assert [repr(_load_deep(t)) for t in good] == [repr(json.loads(t)) for t in good]
    for t in ["", "{", "[1,]", '{"a":1,}', '{"a" 1}', "{1:2}", "[1 2]", "nul", "01", "NaN", "-Infinity", "[1}", '{"a":1]', '"x', "1 2", '{"a":}', "\ufeff1", "[,]"]:
        with pytest.raises(ValueError):
            _load_deep(t)
