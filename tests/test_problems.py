"""Queries without SQL against brute force over the smallest data."""

import json

from conftest import rows

from millrace.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def load(text):
    try:
        value = json.loads(text)
        while isinstance(value, str):
            value = json.loads(value)
    except (TypeError, ValueError):
        return {}
    return value if isinstance(value, dict) else {}


def get(o, name):
    return next((v for k, v in o.items() if k.lower() == name), None) if isinstance(o, dict) else None


def listed(x):
    return [y for y in x if isinstance(y, dict)] if isinstance(x, list) else [x] if isinstance(x, dict) else []


def named(x):
    return [(k, v) for k, v in x.items() if isinstance(v, dict)] if isinstance(x, dict) else [(None, v) for v in listed(x)]


def edge(o):
    return f"{get(o, 'sourceblock') or ''}>{get(o, 'targetblock') or ''}"


def test_nested_objects(spark):
    want = set()
    for r in spark.read.parquet(f"{SF}/flow_event.parquet").select("id", "payload").collect():
        v, at = load(r["payload"]), ("flow_event", str(r["id"]))
        want |= {(*at, "block", "", get(b, "blockname")) for b in listed(get(v, "blocks"))} | {(*at, "edge", "", edge(b)) for b in listed(get(v, "edges"))}
        t = get(v, "triggerparamsjson")
        for b in listed(get(load(t) if isinstance(t, str) else t, "batches")):
            want.add((*at, "batch", "", str(get(b, "batchid"))))
            for j in listed(get(b, "journals")):
                want.add((*at, "journal", str(get(b, "batchid")), str(get(j, "journalid"))))
                want |= {(*at, "entry", f"{get(b, 'batchid')}/{get(j, 'journalid')}", str(get(e, "entryid"))) for e in listed(get(j, "entries"))}
    for r in spark.read.parquet(f"{SF}/flow_snapshot.parquet").select("flow_run_id", "snapshot_json").collect():
        v, at = load(r["snapshot_json"]), ("flow_snapshot", r["flow_run_id"])
        want |= {(*at, "block", "", get(b, "blockname") or k) for k, b in named(get(v, "blocks"))} | {(*at, "channel", "", edge(b)) for _, b in named(get(v, "channels"))}
    got = rows(QUERIES["p2_found"](spark, SF))
    assert len(got) > 500 and got == sorted(want, key=repr)
