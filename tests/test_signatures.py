"""Text search over signed files: the rows of a plain scan from fewer files."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cinderlog.functions.text import GRAM_CHUNK, chunks, gram_numbers, literal_runs
from cinderlog.operators.search import filter_logs
from cinderlog.plans.spec import AggSpec, LogQuery
from cinderlog.schemas import LOGS

from .conftest import log_row

TEXTS = [
    "payment DECLINED by bank", "Straße gesperrt, Übergang zu", "ΣΟΦΟΣ Λόγος", "100% of disk_7 used", "a\nb\r\nc", "", "ab", "smile 😀😀 ok 😀a",
    "back\\slash path C:\\temp", "İstanbul ısı", "日本語のログです",
]


@pytest.fixture(scope="module")
def signed(spark, tmp_path_factory):
    from cinderlog.sources.tables import LogStore

    store = LogStore(spark, str(tmp_path_factory.mktemp("signed")))
    for epoch, text in enumerate(TEXTS):
        rows = [log_row(epoch * 10 + i, datetime(2024, 3, 1 + i), message=f"{text} {'xyz' * i}") for i in range(3)]
        store.append_logs(spark.createDataFrame(rows, LOGS), epoch)
    assert store.sign_logs() == 3 * len(TEXTS)
    assert store.sign_logs() == 0
    return store


def both(store, text):
    found = filter_logs(store.logs(text=text), LogQuery(q=text))
    whole = filter_logs(store.logs(), LogQuery(q=text))
    assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in whole.collect())
    return len(store.logs(text=text).inputFiles())


@pytest.mark.parametrize(
    "text, files",
    [
        ("declined", 3), ("DECL%bank", 3), ("strasse", 0), ("STRAßE", 3), ("übergang", 3), ("σοφος", None), ("ΛΌΓΟΣ", None), ("100\\% of", 3), ("disk_7", 3),
        ("a\nb", 33), ("😀a", 33), ("😀😀 o", 3), ("\\\\slash", 3), ("istanbul", None), ("日本語", 3), ("zz", 33), ("xyzxyz", 11), ("no such words", 0), ("%", 33), ("nk%xyzx", 11),
    ],
)
def test_signed_search_equals_scan(signed, text, files):
    opened = both(signed, text)
    assert files is None or opened <= files


def test_random_parts_are_never_lost(spark, signed):
    draw = random.Random(4)
    for _ in range(12):
        text = draw.choice([t for t in TEXTS if len(t) > 4])
        start = draw.randrange(len(text) - 3)
        part = text[start:start + draw.randrange(1, 9)].replace("\\", "\\\\").swapcase()
        both(signed, part)


def test_unsigned_and_replayed_files_are_read(spark, store):
    def write(epoch, message):
        store.append_logs(spark.createDataFrame([log_row(epoch, datetime(2024, 3, 1), message=message)], LOGS), epoch)

    write(0, "first needle")
    write(1, "hay only")
    assert store.sign_logs() == 2
    write(2, "second needle")
    write(1, "third needle")
    assert sorted(r["id"] for r in store.search(LogQuery(q="NEEDLE")).collect()) == [0, 1, 2]
    # A run that did not finish does not count.
    store._mark(f"{store.path('signings')}/taken.2")
    assert store.sign_logs() == 2
    assert len(store.logs(text="hay").inputFiles()) == 0
    assert store.logs(text="hay").count() == 0
    count = store.aggregate(AggSpec(datetime(2024, 3, 1), datetime(2024, 3, 2), "1d", q="second")).collect()
    assert [r["count"] for r in count] == [1]
    store.drop_expired_days(datetime(2024, 3, 2))
    assert store.folders("signatures", "log_date") == {}


def test_ranges_open_only_their_days(signed):
    found = signed.logs(datetime(2024, 3, 2), datetime(2024, 3, 2) + timedelta(hours=1), "bank")
    assert len(found.inputFiles()) == 1


def test_long_texts_are_cut_without_loss(spark):
    text = "".join(chr(97 + (i * i) % 26) for i in range(2 * GRAM_CHUNK + 5))
    df = spark.createDataFrame([(text,)], "t string")
    pieces = df.select(F.explode(chunks(F.col("t"))).alias("p")).select(F.explode(gram_numbers(F.col("p"))).alias("n")).distinct()
    whole = df.select(F.explode(gram_numbers(F.col("t"))).alias("n"))
    assert sorted(r[0] for r in pieces.collect()) == sorted(r[0] for r in whole.collect())


def test_literal_runs():
    assert literal_runs("%ab_c\\%d\\\\%e") == ["ab", "c%d\\", "e"]
    assert literal_runs("%%") == []
