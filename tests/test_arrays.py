"""Arrays read by many tasks equal the one-task read at every split size."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sievework.sources import arrays, documents


def items(n: int, seed: int) -> list[dict]:
    rng = random.Random(seed)
    odd = ['a "quoted" }{ ][ , text', "back\\slash \\", "}", "{", '"', "", "é 日本 \U0001f600", "line\nend\t}", '\\"}', "x" * 300]
    out = []
    for i in range(n):
        source = {"complaint_id": i, "text": rng.choice(odd) + rng.choice(odd), "nested": {"list": [{"k": rng.choice(odd)}, [], {}, 1, None], "t": True}}
        out.append({"_index": "x", "_source": source} if rng.random() < 0.9 else {"_source": {}})
    return out


@pytest.mark.parametrize("indent", [None, 1])
def test_every_split_size(spark, tmp_path, indent):
    for k, n in enumerate((0, 1, 17)):
        (tmp_path / f"{k}.json").write_text(json.dumps(items(n, k), indent=indent, ensure_ascii=k == 1) + "\n" * (k % 2))
    want = {(r.path, r.source_row_ordinal): json.loads(r.payload) for r in documents.read_exports(spark, str(tmp_path)).collect()}
    size, cost = (spark.conf.get(f"spark.sql.files.{c}") for c in ("maxPartitionBytes", "openCostInBytes"))
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for split in ("400", "3000", "1000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            rows = arrays.read_split_exports(spark, str(tmp_path)).collect()
            assert {(r.path, r.source_row_ordinal): json.loads(r.payload) for r in rows} == want and len(rows) == len(want) == 18
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(items(2000, 9)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
        parts = arrays.fragments(spark, str(tmp_path))
        assert parts.select(F.spark_partition_id()).distinct().count() > 5
        ordinals = sorted(r.ordinal for r in arrays.elements(parts).select("ordinal").collect())
        assert ordinals == list(range(2000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


@pytest.mark.parametrize("text", ["", "[", "{}", '[{"a":1}', '[{"a":1}] x', '[{"a":1}]]', '[1, 2]', '[{"a":1} {"b":2}]', '{"a":[{"b":1}]}'])
def test_malformed_arrays(spark, text):
    found = arrays.source_rows(arrays.elements(arrays.fragments_of(spark.createDataFrame([("p", text)], "path string, document string"), 2)))
    if text == "":
        return
    with pytest.raises(Exception):
        found.collect()
