"""Expiring repeats: a stream with state and timers against the same function on a table and a plain version."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from sievework.streaming import events, stateful

SCHEMA = "id long, key string, ts timestamp, extra string"
BASE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
KEEP = dt.timedelta(minutes=30)


def at(minutes: float) -> dt.datetime:
    return BASE + dt.timedelta(minutes=minutes)


def micros(moment: dt.datetime) -> int:
    return (moment - BASE) // dt.timedelta(microseconds=1) + int(BASE.timestamp()) * 1_000_000


def plain(rows) -> dict:
    by, out = defaultdict(list), {}
    for i, key, ts, _ in rows:
        if ts is None:
            out[i] = "undated"
        else:
            by[key].append((ts, i))
    for found in by.values():
        last = None
        for ts, i in sorted(found):
            out[i] = "first" if last is None or ts - last >= KEEP else "repeat"
            last = ts
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, k, t, "x") for i, k, t, _ in rows], SCHEMA)


def random_rows(seed: int, n: int, first: int = 0):
    rng = random.Random(seed)
    rows = [(first + i, rng.choice(["hot"] * 6 + ["a", "b", None, ""]), at(rng.choice((rng.uniform(0, 3000), rng.randrange(0, 3000, 30)))), "x") for i in range(n)]
    return rows + [(first + n, "hot", None, "x"), (first + n + 1, None, None, "x")]


def test_table_equals_plain(spark):
    for seed in (1, 2):
        rows = random_rows(seed, 400)
        got = stateful.expiring_first_seen(table(spark, rows), "key", "ts", "id", KEEP).collect()
        assert len(got) == len(rows) and {r.id: r.status for r in got} == plain(rows)
    assert stateful.expiring_first_seen(table(spark, []), "key", "ts", "id", KEEP).count() == 0
    with pytest.raises(ValueError):
        stateful.expiring_first_seen(table(spark, []), "key", "ts", "id", dt.timedelta(0))


def test_stream_equals_table_over_restarts(spark, tmp_path):
    def feed(name, rows):
        table(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        events.run_once(stateful.expiring_first_seen(stream, "key", "ts", "id", KEEP, "2 hours"), str(tmp_path / "out"), str(tmp_path / "check"))
        return spark.read.parquet(str(tmp_path / "out")).collect()

    rows = [r for r in random_rows(3, 150)]
    rng = random.Random(4)
    dated = sorted((r for r in rows if r[2]), key=lambda r: r[2] + dt.timedelta(minutes=rng.uniform(0, 110)))  # out of order within the delay
    half = len(dated) // 2
    feed("a", dated[:half] + [r for r in rows if not r[2]])
    early = run()
    assert 2 < len(early) < len(rows)  # rows that the watermark hasn't passed wait in the state
    feed("b", dated[half:])
    late = [(900, "hot", at(1), "x"), (901, "new", at(2), "x")]
    feed("c", [(990, "end", at(9000), "x")])
    run()
    feed("d", late)
    feed("e", [(991, "end", at(9500), "x")])
    got = run()
    expected = plain([*rows, (990, "end", at(9000), "x")]) | {900: "late", 901: "late"}
    assert len({r.id for r in got}) == len(got)
    assert {r.id: r.status for r in got if r.id != 991} == expected
    assert {r.id: r.at for r in got if r.id == 900} == {900: micros(at(1))}
