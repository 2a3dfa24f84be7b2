"""Near duplicates and lines against loops over all pairs and all lines."""

import hashlib
import random
import re

import pytest

from lectern.llm import line_dedup, near_dedup
from lectern.llm.components import components

SPACE = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not found:
        return set()
    return {tuple(found[i:i + 5]) for i in range(max(1, len(found) - 4))}


def brute(rows):
    """Component and set size of each row by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            if a is None or b is None or not sets[i] or not sets[j]:
                continue
            common = len(sets[i] & sets[j])
            if 100 * common >= 75 * len(sets[i] | sets[j]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    out = []
    for (i, _), s in zip(rows, sets, strict=True):
        c = None if i is None else root(i)
        out.append((i, len(s), c, i is None or c == i))
    return sorted(out, key=str)


def got(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, sig string, component int")
    out = near_dedup.near_duplicates(df.repartition(3)).collect()
    return sorted((tuple(r) for r in out), key=str)


@pytest.fixture(scope="module")
def chain():
    """A text and copies with ever more changed words, chains, passages that many share, odd texts."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage = [word() for _ in range(60)]
    rows, base = [], [word() for _ in range(120)]
    for i in range(70):
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(120)] = word()
        rows.append((i, " ".join(copy)))
    step = list(base)
    for i in range(70, 90):
        step[rng.randrange(120)] = word()
        step[rng.randrange(120)] = word()
        rows.append((i, " ".join(step)))
    for i in range(90, 130):
        rows.append((i, " ".join(passage + [word() for _ in range(rng.randint(5, 30))])))
    rows += [(130, None), (131, ""), (132, " \n"), (133, "one two"), (134, "ONE\ttwo"), (135, "one two three"), (136, rows[3][1])]
    rows += [(None, rows[0][1]), (137, rows[5][1]), (137, rows[100][1]), (4, rows[4][1]), (138, "w " * 5000)]
    return rows


def test_components_are_those_of_all_pairs(spark, chain):
    assert got(spark, chain) == brute(chain)


def test_small_blocks_find_the_same(spark, chain, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 900)
    monkeypatch.setattr(near_dedup, "HOT_PAIRS", 7)
    assert got(spark, chain) == brute(chain)


def made_by_joins(df):
    """Rows that each join of the executed plan made, by its description."""
    plan = df._jdf.queryExecution().executedPlan()
    out, left = {}, [plan]
    while left:
        node = left.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            left.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            left.append(node.plan())
        if "Join" in node.nodeName():
            key = node.simpleString(200)
            out[key] = out.get(key, 0) + node.metrics().apply("numOutputRows").value()
        left += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_a_document_of_many_buckets_meets_its_words_once(spark):
    rows = [(b, i, i % 7, 300) for b in range(40) for i in range(20)]
    members = spark.createDataFrame(rows, "bucket bigint, id bigint, component bigint, n bigint")
    words = spark.createDataFrame([(i, b"w" * i) for i in range(20)], "id bigint, packed binary")
    df = near_dedup._in_blocks(members, words)
    out = df.collect()
    assert sorted((r.bucket, r.id, r.component, r.n, len(r.packed)) for r in out) == sorted((*r, r[1]) for r in rows)
    assert {(r.block, r.first, r.second) for r in out} == {(0, 0, 0)}
    on_id = {k: v for k, v in made_by_joins(df).items() if "[id#" in k}
    assert on_id and sum(on_id.values()) == 20


def test_no_documents(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None)]) == [(1, 0, 1, True)]


def test_chunks_guarantee_the_distance():
    """Any 31 changed symbols leave a chunk with at most one error."""
    rng = random.Random(0)
    for _ in range(200):
        changed = set(rng.sample(range(near_dedup.SYMBOLS), 2 * near_dedup.CHUNKS - 1))
        errors = [sum(c * near_dedup.WIDTH + i in changed for i in range(near_dedup.WIDTH)) for c in range(near_dedup.CHUNKS)]
        assert min(errors) <= 1


def test_components(spark):
    pairs = [(1, 2), (2, 3), (9, 3), (7, 8), (8, 7), (5, 5), (None, 4)] + [(i, i + 1) for i in range(20, 60)]
    out = components(spark.createDataFrame(pairs, "x bigint, y bigint")).collect()
    want = {1: 1, 2: 1, 3: 1, 9: 1, 7: 7, 8: 7} | dict.fromkeys(range(20, 61), 20)
    assert {r.id: r.component for r in out} == want and len(out) == len(want)


def brute_lines(rows, least=20, docs=3):
    held = {}
    key = lambda line: lower(line.strip(SPACE))
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least and i is not None:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(h := held.get(key(x), set())) < docs or max(h) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_lines_are_those_of_a_loop(spark, batches):
    rng = random.Random(4)
    common = [f"A Line that {i} documents may share é" for i in range(12)] + ["short", "", "   ", "\tthe same line, but padded \r"]
    rows = [(i, "\n".join(rng.choice(common) if rng.random() < 0.6 else f"only here {i} {rng.random()}" for _ in range(rng.randint(1, 30)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n"), (None, "\n".join(common)), (3, rows[3][1]), (5, "\n".join(common)), (99, common[0].upper() + "\n" + common[0])]
    df = spark.createDataFrame([(i, t, "c", 5) for i, t in rows], "doc_id bigint, text string, h1 string, top int").repartition(4)
    out = line_dedup.dedupe_lines(df, batches=batches)
    assert out.columns == ["doc_id", "text", "h1", "top", "n_lines", "n_dropped"]
    found = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in out.collect()]
    assert sorted(found, key=str) == brute_lines(rows)


def test_lines_without_rows(spark):
    assert line_dedup.dedupe_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
