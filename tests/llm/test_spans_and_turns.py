"""Repeated word windows, token alignment and turn repair against plain loops and a shortest path."""

import hashlib
import heapq
import random
import re
from collections import Counter

import pytest

from lectern.llm import alignment, substrings, turns

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_repeats(rows, window):
    """Words, removed words and digest of the rest of each row, from a table of all windows."""
    first = {}
    for i, text in rows:
        words = WORD.findall(text or "")
        for at in range(len(words) - window + 1 if i is not None else 0):
            key = tuple(words[at:at + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        words = WORD.findall(text or "")
        gone = set()
        for at in range(len(words) - window + 1 if i is not None else 0):
            if first[tuple(words[at:at + window])] < i:
                gone.update(range(at, at + window))
        out.append((i, len(words), len(gone), sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    return sorted(out, key=str)


def repeats_of(spark, rows, window):
    df = spark.createDataFrame([(i, "x", t, 1) for i, t in rows], "doc_id bigint, doc string, text string, n_words int").repartition(3)
    out = substrings.remove_repeats(df, window)
    assert out.columns == ["doc_id", "doc", "text", "n_words", "n_removed"]
    return sorted(((r.doc_id, r.n_words, r.n_removed, sha(r.text)) for r in out.collect()), key=str)


@pytest.fixture(scope="module")
def texts():
    """Shared passages, near copies, exact copies, a text that repeats itself, odd rows."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgé", k=3))
    passage = [word() for _ in range(40)]
    base = [word() for _ in range(150)]
    rows = []
    for i in range(60):
        part = passage[rng.randint(0, 12):rng.randint(20, 40)]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join([word() for _ in range(rng.randint(0, 20))] + part + [word() for _ in range(9)])))
    for i in range(60, 90):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(150)] = word()
        rows.append((i, " ".join(copy)))
    rows += [(i, rows[63][1]) for i in range(90, 110)]  # exact copies
    rows += [(110, "w " * 3000), (111, "w " * 40), (112, "w x " * 30), (113, " ".join(base) * 3)]
    rows += [(120, None), (121, ""), (122, " \n\t"), (123, "one"), (None, rows[0][1]), (None, None)]
    rows += [(5, rows[5][1]), (5, rows[70][1]), (4, rows[70][1].upper()), (114, rows[70][1].upper())]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("window", [13, 7, 3])
def test_repeats_are_those_of_all_windows(spark, texts, window):
    assert repeats_of(spark, texts, window) == brute_repeats(texts, window)


def test_many_shards_and_parts_find_the_same(spark, texts, monkeypatch):
    monkeypatch.setattr(substrings, "STRETCH", 9)
    monkeypatch.setattr(substrings, "SHARD_WINDOWS", 40)
    monkeypatch.setattr(substrings, "STREAMED", 25)
    assert repeats_of(spark, texts, 13) == brute_repeats(texts, 13)


def test_no_rows_and_no_repeats(spark):
    assert repeats_of(spark, [], 13) == []
    rows = [(1, " ".join(map(str, range(50)))), (2, None)]
    assert repeats_of(spark, rows, 13) == brute_repeats(rows, 13)


def test_automaton_gives_the_least_id_of_each_window():
    rng = random.Random(3)
    for _ in range(40):
        held = [(rng.randint(0, 9), [rng.choice(b"abc").to_bytes() for _ in range(rng.randint(1, 30))]) for _ in range(rng.randint(1, 6))]
        made = substrings.Automaton()
        for least, words in held:
            made.add(words, least)
        made.close()
        found = substrings.Automaton.unpack(made.pack())
        text = [rng.choice(b"abcd").to_bytes() for _ in range(60)]
        for n in (1, 2, 4):
            want = {}
            for i in range(len(text) - n + 1):
                ids = [least for least, words in held for k in range(len(words) - n + 1) if words[k:k + n] == text[i:i + n]]
                if ids:
                    want[i] = min(ids)
            places, least = found.matches(text, n)
            assert dict(zip(places.tolist(), least.tolist(), strict=True)) == want


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers as vocabularies

    return vocabularies.path("byte_bpe_50k.json"), vocabularies.path("piece_bpe_32k.model")


def bytes_of(paths):
    """Entries of both vocabularies as bytes, through the libraries' own decoders."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(x): x for x in printable}
    shown |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printable)}
    return a, b, lambda i: bytes(shown[c] for c in a.id_to_token(i)), lambda i: (
        bytes.fromhex(b.id_to_piece(i)[3:5]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    )


def brute_alignment(rows, paths):
    a, b, a_bytes, b_bytes = bytes_of(paths)
    found, counts = [], Counter()
    for i, text in rows:
        x = [(t, a_bytes(t)) for t in a.encode(" " + text, add_special_tokens=False).ids] if text else []
        y = [(t, b_bytes(t)) for t in b.encode(text)] if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(w for _, w in x) != whole or b"".join(w for _, w in y) != whole:
            found.append((i, 0, 0, [], ""))
            continue
        spans = []
        for side in (x, y):
            at, own = 0, []
            for t, w in side:
                own.append((t, at, at + len(w)))
                at += len(w)
            spans.append(own)
        links = [(p[0], q[0]) for p in spans[0] for q in spans[1] if p[1] < q[2] and q[1] < p[2]]
        counts.update(links)
        groups, start = [], 0
        for end in sorted({p[2] for p in spans[0]} & {q[2] for q in spans[1]}):
            groups.append("|".join(",".join(str(t) for t, s, e in side if start <= s and e <= end) for side in spans))
            start = end
        found.append((i, len(x), len(y), links, ";".join(groups)))
    most = Counter()
    for (_, q), n in counts.items():
        most[q] = max(most[q], n)
    return sorted(((
        i, n_a, n_b, len(g.split(";")) if g else 0, len(links), sum(counts[p] == most[p[1]] for p in links),
        sum(counts[p] for p in links), sha(g) if g else "") for i, n_a, n_b, links, g in found), key=str)


@pytest.fixture(scope="module")
def odd_texts(spark, sf):
    rows = [(r.doc_id, r.text[:400]) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    odd = [
        None, "", " ", "  ", "\n", "a", "Héllo\nBar  two <s> <|endoftext|> x\t😀 ", "日本語のテキスト 😀😀 ok", "with ▁ inside", "▁", "a\r\nb\x0bc\x0c",
        "trailing \n", " leading", "<0x41> <unk> </s>", "é" * 300, " nbsp em", "it's 'quoted' don't  'd", "x" * 3000, "\x00\x01", "a \nb\n c\n\nd", "ﬁ ① Ａ",
        "العربية mixed नमस्ते text", "tab\tand  double", "​ zero", "100 000,5 %-- ==", "Ça va? Très «bien».\nOui!\n",
    ]
    return rows + [(1000 + k, t) for k, t in enumerate(odd)] + [(None, "no id"), (3, "again one"), (3, rows[3][1])]


def alignment_of(spark, rows, paths):
    df = spark.createDataFrame([(i, t, 7, "c") for i, t in rows], "doc_id bigint, text string, block int, a string").repartition(3)
    out, pairs = alignment.align(df, *paths)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[c] for c in columns) for r in out.collect()), key=str), pairs


def test_alignment_is_that_of_whole_texts(spark, odd_texts, paths):
    got, pairs = alignment_of(spark, odd_texts, paths)
    assert got == brute_alignment(odd_texts, paths)
    assert pairs.agg({"n": "sum"}).first()[0] == sum(r[4] for r in got)


def test_small_blocks_align_the_same(spark, odd_texts, paths, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 500)
    monkeypatch.setattr(alignment, "HELD_UNITS", 60)
    monkeypatch.setattr(alignment, "_TOGETHER", 7)
    monkeypatch.setattr(alignment, "_aligner", lambda a, b: alignment.Aligner(a, b))
    assert alignment_of(spark, odd_texts, paths)[0] == brute_alignment(odd_texts, paths)


def test_alignment_of_nothing(spark, paths):
    assert alignment_of(spark, [], paths)[0] == []
    assert alignment_of(spark, [(1, None)], paths)[0] == [(1, 0, 0, 0, 0, 0, 0, "")]


def shortest_repair(rows):
    """Counts, price, audit and digest of one conversation by a search over all edits."""
    seen, gone, cut, blank, duplicate = set(), [], [], 0, 0
    for _, role, text in rows:
        bare = text.rstrip("\t\n\x0b\x0c\r ")
        blank += not bare
        duplicate += bool(bare) and (role, text) in seen
        gone.append(not bare or (role, text) in seen)
        cut.append(not gone[-1] and bare[-1] not in ".!?")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    names, heap, done = {"u": "user", "a": "assistant"}, [(0, "", 0, "", ())], set()
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    while True:
        price, audit, i, last, lines = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return gaps, blank, duplicate, sum(cut), illegal, price, audit, sha("\n".join(lines))
        if (i, last) in done:
            continue
        done.add((i, last))
        for c in set(follows[last]) & set(names):
            heapq.heappush(heap, (price + 2, audit + "I", i, c, (*lines, names[c] + ":")))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(heap, (price + 3, audit + "D", i + 1, last, lines))
        if gone[i]:
            continue
        if initials[i] and initials[i] in follows[last]:
            heapq.heappush(heap, (price + cut[i], audit + "K", i + 1, initials[i], (*lines, f"{role}:{text}")))
        for c in set(follows[last]) & set(names):
            heapq.heappush(heap, (price + 2 + cut[i], audit + "R", i + 1, c, (*lines, f"{names[c]}:{text}")))


def brute_repair(rows):
    held = {}
    for conv, turn, role, text in rows:
        held.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest())
    return {conv: shortest_repair(sorted(own, key=order)) for conv, own in held.items()}


def repaired(spark, rows):
    schema = "conv_id bigint, turn bigint, role string, text string, key string, rn int"
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], schema).repartition(3)
    lines, report = turns.repair(df)
    digests = {r.conv_id: (r.audit, r.repaired_sha256) for r in turns.digests(lines).collect()}
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return {r.conv_id: (*(r[c] for c in counts), *digests[r.conv_id]) for r in report.collect()}


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(5)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.choice([1, 2, 3, 5, 9, 14])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "agent"])
            text = rng.choice([f"Say {rng.randint(0, 3)}.", f"cut off {rng.randint(0, 9)}", "", " \n", None, "Why?\t", "¿Qué? é", "line\nbreak!"])
            rows.append((conv, rng.choice([turn, turn + 7, turn, None]), role, text))
    rows += [(500, t, ("user", "assistant", "system")[rng.choice([0, 1, 1, 0, 2])], f"turn {t}{rng.choice(['.', '!', ''])}") for t in range(150)]
    rows += [(501, t, "user", "the same.") for t in range(40)]
    return rows


@pytest.mark.parametrize("chunk", [4096, 3])
def test_repair_is_the_cheapest(spark, talks, chunk, monkeypatch):
    monkeypatch.setattr(turns, "CHUNK", chunk)
    assert repaired(spark, talks) == brute_repair(talks)


def test_repair_of_nothing(spark):
    assert repaired(spark, []) == {}


def test_damage(spark):
    import zlib

    rows = [(c, t, r, x) for c in (None, 1, 2, 3, 4, 5, 6, 7) for t in (None, *range(9)) for r, x in ((None, None), ("system", "What? Yes."))]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = Counter()
    for c, t, r, x in rows:
        mark = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = "user" if mark == 4 else r or " ", {1: "", 2: (x or " ").replace("?", "").replace(".", "")}.get(mark, x or " ")
        want[c, t, role, text] += 0 if mark == 0 else 2 if mark == 3 else 1
    assert Counter(map(tuple, turns.damage(df).collect())) == +want


def test_every_block_has_a_table():
    """Lookups give what single steps give."""
    t = turns.tables()
    rng = random.Random(1)
    for _ in range(200):
        symbols = turns._codes("".join(str(rng.randrange(9)) for _ in range(rng.randint(1, 11))))
        cost = turns._inserted(list(turns._END))
        for symbol in symbols[::-1].tolist():
            cost = turns._before(symbol, cost)
        assert t.price(t.blocks(symbols), tuple(turns._inserted(list(turns._END))))[0] == tuple(cost)
