import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderlog.functions.times import literal_like
from cinderlog.operators.validation import accepted, batch_results, normalize_attributes, validate, with_ids
from cinderlog.schemas import MAX_BODY_BYTES
from cinderlog.sources.batches import bad_batches, open_batches

NOW = datetime(2025, 3, 9, 12)
BASE = {"timestamp": "2025-03-09T11:59:00.000Z", "level": "info", "service": "archiver", "message": "snapshot 12 uploaded"}


def changed(**fields):
    return json.dumps({**BASE, **fields})


def without(name):
    return json.dumps({k: v for k, v in BASE.items() if k != name})


CASES = [
    (json.dumps(BASE), None),
    (changed(timestamp=""), "timestamp is required"),
    (changed(timestamp=0), "timestamp is required"),
    (changed(timestamp=-0.0), "timestamp is required"),
    (changed(timestamp=False), "timestamp is required"),
    (changed(timestamp=None), "timestamp is required"),
    (without("timestamp"), "timestamp is required"),
    (changed(timestamp="0"), "invalid timestamp"),
    (changed(timestamp="not-a-date"), "invalid timestamp"),
    (changed(timestamp="12:30"), "invalid timestamp"),
    (changed(timestamp="2024"), "invalid timestamp"),
    (changed(timestamp=1753021921000), "invalid timestamp"),
    (changed(timestamp={"a": 1}), "invalid timestamp"),
    (changed(timestamp="2025-02-30T00:00:00Z"), "invalid timestamp"),
    (changed(timestamp="2025-03-09T12:06:00.000Z"), "timestamp too far in the future"),
    (changed(timestamp="2025-03-09T12:05:00.001Z"), "timestamp too far in the future"),
    (changed(timestamp="2025-03-09T12:05:00.000Z"), None),
    (changed(timestamp="2025-03-09T12:05:00.000900Z"), None),
    (changed(timestamp="2025-03-09T14:05:00+02:00"), None),
    (changed(timestamp="1969-12-31"), None),
    (changed(level="critical"), "invalid level: 'critical'"),
    (changed(level="Info"), "invalid level: 'Info'"),
    (changed(level=None), "invalid level: 'null'"),
    (changed(level=5), "invalid level: '5'"),
    (changed(level={"a": 1}), "invalid level: '[object Object]'"),
    (changed(level=["warn", None, 3]), "invalid level: 'warn,,3'"),
    (without("level"), "invalid level: 'undefined'"),
    (changed(service="  "), "service is required"),
    (changed(service=" ﻿　\t"), "service is required"),
    (changed(service=5), "service is required"),
    (changed(service=" padded "), None),
    (without("service"), "service is required"),
    (changed(message=""), "message is required"),
    (changed(message=["x"]), "message is required"),
    (changed(attributes=None), None),
    (changed(attributes={}), None),
    (changed(attributes={"user_id": "42", "retries": 3, "resolved": False}), None),
    (changed(attributes={"user": {"id": "42"}}), "nested object in attribute 'user'"),
    (changed(attributes={"tags": ["a", "b"]}), "nested object in attribute 'tags'"),
    (changed(attributes={"z": {}, "a": None}), "nested object in attribute 'z'"),
    (changed(attributes={"z": None, "a": {}}), "invalid attribute value for 'z'"),
    (changed(attributes={"ok": 1, "z": {}, "10": None, "9": []}), "nested object in attribute '9'"),
    (changed(attributes={"a.b": None}), "invalid attribute value for 'a.b'"),
    (changed(attributes=[1, 2, 3]), "attributes must be a flat object"),
    (changed(attributes="hello"), "attributes must be a flat object"),
    (changed(attributes=False), "attributes must be a flat object"),
    ("null", "entry must be an object"),
    ("[1]", "entry must be an object"),
    ('"s"', "entry must be an object"),
    ("5", "entry must be an object"),
    (json.dumps(json.dumps(BASE)), "entry must be an object"),
    ("{}", "timestamp is required"),
    # Several faults at once: the first check wins.
    (changed(timestamp="", level="x", service="", message="", attributes=5), "timestamp is required"),
    (changed(timestamp="x", level="x", service=""), "invalid timestamp"),
    (changed(timestamp="2030-01-01", level="x"), "timestamp too far in the future"),
    (changed(level="x", service="", message=""), "invalid level: 'x'"),
    (changed(service="", message="", attributes=[]), "service is required"),
    (changed(message=" ", attributes={"a": None}), "message is required"),
    # A repeated key: the last one counts.
    ('{"level":"nope",' + json.dumps(BASE)[1:], None),
]


def check(spark, bodies):
    frame = spark.createDataFrame(bodies, "batch_id long, body string")
    return validate(open_batches(frame), literal_like(NOW, T.TimestampType()))


@pytest.fixture(scope="module")
def checked_cases(spark):
    body = '{"logs":[' + ",".join(text for text, _ in CASES) + "]}"
    return check(spark, [(1, body)]).persist()


def test_reasons(checked_cases):
    rows = {r["index"]: r["reason"] for r in checked_cases.collect()}
    assert [rows[i] for i in range(len(CASES))] == [reason for _, reason in CASES]


def test_each_entry_alone(spark):
    """The text of entries is only kept for some batches; the reason must not depend on that."""
    bodies = [(i, '{"logs":[' + text + "]}") for i, (text, _) in enumerate(CASES)]
    rows = {r["batch_id"]: r["reason"] for r in check(spark, bodies).collect()}
    assert [rows[i] for i in range(len(CASES))] == [reason for _, reason in CASES]


def test_accepted_rows(checked_cases):
    rows = {r["index"]: r for r in accepted(checked_cases).collect()}
    assert set(rows) == {i for i, (_, reason) in enumerate(CASES) if reason is None}
    attributes = [r["attributes"] for r in rows.values() if r["attributes"]]
    assert attributes == [{"user_id": "42", "retries": "3", "resolved": "false"}]
    padded = [r for r in rows.values() if r["service"].startswith(" ")]
    assert padded[0]["service"] == " padded "


def test_ids_follow_batch_and_index(checked_cases):
    ids = [r["id"] for r in with_ids(accepted(checked_cases.withColumn("batch_id", F.lit(3)), "batch_id")).collect()]
    assert len(set(ids)) == len(ids) and all(i >> 24 == 3 for i in ids)


def test_batches(spark):
    good = json.dumps(BASE)
    bodies = [
        (1, "{bad"), (2, '{"logs":5}'), (3, '{"x":1}'), (4, '{"logs":[]}'), (5, f'{{"logs":[{good},{{}},{good}]}}'),
        (6, f'{{"logs":[{good}]}}' + " " * MAX_BODY_BYTES), (7, "[]"), (8, f'{{"logs":[{good}]}}' + "\n"), (9, ""),
    ]
    checked = check(spark, bodies).persist()
    results = {r["batch_id"]: r for r in batch_results(checked).collect()}
    assert {k: (r["accepted"], r["status"], r["error"]) for k, r in results.items()} == {
        1: (0, 400, "malformed JSON"), 2: (0, 400, "body must contain a 'logs' array"),
        3: (0, 400, "body must contain a 'logs' array"), 4: (0, 400, None), 5: (2, 200, None),
        6: (0, 400, "payload too large"), 7: (0, 400, "body must contain a 'logs' array"), 8: (1, 200, None),
        9: (0, 400, "malformed JSON"),
    }
    assert [tuple(x) for x in results[5]["rejected"]] == [(1, "timestamp is required")]
    assert {r["batch_id"] for r in bad_batches(checked).collect()} == {1, 2, 3, 6, 7, 9}


def test_attribute_texts(spark):
    body = '{"a":1.50,"b":true,"c":"x","d":-3,"e":12345678901,"f":1.0}'
    row = spark.range(1).select(normalize_attributes(F.parse_json(F.lit(body))).alias("m")).first()
    assert row["m"] == {"a": "1.5", "b": "true", "c": "x", "d": "-3", "e": "12345678901", "f": "1"}
    nested = spark.range(1).select(normalize_attributes(F.parse_json(F.lit('{"a":{}}'))).alias("m")).first()
    assert nested["m"] is None


@pytest.mark.parametrize("literal, text", [
    ("1e21", "1e+21"), ("1e7", "10000000"), ("-1.25e-7", "-1.25e-7"), ("1.5e300", "1.5e+300"), ("2.5e8", "250000000"), ("1.234567891e8", "123456789.1"),
    ("1.5e-4", "0.00015"), ("1e-6", "0.000001"), ("1e20", "100000000000000000000"), ("-4e-9", "-4e-9"), ('"1.0E7"', "1.0E7"), ("1e2", "100"), ("12.5", "12.5"),
    ("0.0000001", "1e-7"), ("-0.00000012340", "-1.234e-7"), ("0.000001", "0.000001"), ('"0.0000001"', "0.0000001"), ("0.00000001", "1e-8"),
])
def test_numbers_with_exponents(spark, literal, text):
    entry = json.dumps({**BASE, "attributes": {"n": "@"}}).replace('"@"', literal)
    row = accepted(check(spark, [(1, '{"logs":[' + entry + "]}")])).first()
    assert row["attributes"] == {"n": text}
