"""Large JSON arrays in ranges, the audit sink, table functions."""

import json
import random

import pytest

from lectern.functions import table_functions
from lectern.operators import scoring as SC
from lectern.operators import vocab as V
from lectern.sources import json_arrays as J
from lectern.sources import readers as RD
from lectern.sources import writers as WR


def elements(rng):
    """Objects, and other elements that look like them."""
    out = []
    for i in range(rng.randint(0, 60)):
        kind = rng.randrange(6)
        text = rng.choice(["a", "} {", '"', "\\", "]", "é\n", "x" * 90, "\\\"}"])
        out.append([{"a": i, "b": text}, {"a": i, "b": text, "c": [{"d": "}"}]}, [{"a": 1}], 7, text, None][kind])
    return out


@pytest.mark.parametrize("size", ["1k", "200", "64"])
def test_an_array_is_read_in_ranges(spark, tmp_path, size):
    rng = random.Random(size)
    want = []
    for k in range(4):
        items = elements(rng)
        want += [(x["a"], x["b"]) for x in items if isinstance(x, dict)]
        (tmp_path / f"{k}.json").write_text(rng.choice(["", " \n"]) + json.dumps(items, ensure_ascii=False, indent=rng.choice([None, 1])) + "\n", encoding="utf-8")
    keys = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        ranges = spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions()
        got = [(r.a, r.b) for r in RD.read_json_array(spark, str(tmp_path), "a int, b string").collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(got) == sorted(want)
    assert ranges >= (4 if size == "1k" else 12)


def test_a_range_knows_its_state():
    text = '[{"a": "}"}, "x{", {"b": [{"c": 1}]}]'
    for cut in range(len(text) + 1):
        first = J.Scanner(False, 0, True)
        first.feed(text[:cut])
        second = J.Scanner(first.quoted, first.depth, True)
        second.feed(text[cut:])
        pieces = "".join(first.open or [])
        done = first.done + ([pieces + second.done[0], *second.done[1:]] if second.from_before else second.done)
        assert done == ['{"a": "}"}', '{"b": [{"c": 1}]}'], cut


def test_a_repeated_batch_is_logged_once(spark, tmp_path):
    sink = WR.audit_batches(str(tmp_path / "log"))
    one = spark.createDataFrame([(1, "á"), (2, None)], "i int, t string")
    two = spark.createDataFrame([(3, "x")], "i int, t string")
    for batch, number in ((one, 0), (two, 1), (two, 1), (one, 0)):
        sink(batch, number)
    assert sorted(r.i for r in spark.read.json(str(tmp_path / "log")).collect()) == [1, 2, 3]


def test_table_functions_are_the_operators(spark):
    texts = [(1, "Uno dos TRES"), (2, " ".join(f"w{chr(97 + i % 26)}" for i in range(23))), (3, ""), (4, None), (5, "é " * 11)]
    docs = spark.createDataFrame(texts, "ord int, texto string")
    docs.createOrReplaceTempView("some_docs")
    words = spark.createDataFrame([("uno", 7), ("wa", 8), ("é", 9)], "word string, idx int")
    words.createOrReplaceTempView("some_words")
    table_functions.register(spark, "some_words")
    for mode in ("head", "head_tail", "score"):
        for width in (1, 4, 7, 30):
            got = spark.sql(f"SELECT ord, v.* FROM some_docs, LATERAL token_views(texto, {width}, '{mode}') AS v").collect()
            want = SC.view_rows(docs, width, mode).select("ord", "view", "toks").collect()
            assert sorted(map(str, got)) == sorted(map(str, want)), (mode, width)
    got = spark.sql("SELECT ord, t.* FROM some_docs, LATERAL token_table(texto) AS t").collect()
    assert sorted(map(str, got)) == sorted(map(str, V.token_table(docs, words).collect()))
