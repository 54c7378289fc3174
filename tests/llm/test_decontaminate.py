import random
import re

import pytest

from loglark.llm import decontaminate
from loglark.llm.decontaminate import Automaton, words


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def plain_marks(items, text, window=13):
    tokens = plain_words(text)
    hit, found = set(), set()
    for name, item in items:
        own = plain_words(item)
        m = min(window, len(own))
        for k in range(len(own) - m + 1) if own else []:
            for i in range(len(tokens) - m + 1):
                if tokens[i : i + m] == own[k : k + m]:
                    hit.update(range(i, i + m))
                    found.add(name)
    return len(tokens), hit, found


@pytest.mark.parametrize("seed", range(6))
def test_marks_match_brute_force(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c9", "é", "d"][: 2 + seed % 4]
    say = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(str(k), say(rng.choice([0, 1, 3, 5, 6, 9, 20]))) for k in range(12)]
    items += [("again", items[3][1]), ("again", items[4][1])]
    automaton = Automaton([(n, words(t.encode())) for n, t in items], window=6)
    for _ in range(60):
        text = say(rng.randint(0, 40)) + rng.choice(["", " zzz "]) + rng.choice(items)[1] + " " + say(rng.randint(0, 9))
        n, spans, found = automaton.marks(text.encode())
        want = plain_marks(items, text, 6)
        assert (n, {i for a, b in spans for i in range(a, b)}, found) == want
        assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


ITEM = " ".join(f"w{i}" for i in range(20))
SHORT = "only five words in this"


@pytest.fixture
def benchmark(spark):
    rows = [(1, ITEM), (2, SHORT), (3, None), (4, ""), (5, " ".join(f"W{i}" for i in range(3, 18))), (1, ITEM), (None, "x y z q")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("block_words", [200_000, 12])
def test_report(spark, docs, benchmark, block_words):
    filler = "so " * 400
    table = docs(
        (1, filler + ITEM), (2, "<b>" + SHORT.upper() + "</b>"), (3, None), (4, ""), (5, " ".join(f"w{i}" for i in range(12))),
        (6, "x, y; z q"), (7, "w4 w5 " + ITEM),
    ).withColumn("_m", F_lit()).withColumn("spans", F_lit())
    rows = decontaminate.report(table, benchmark, block_words=block_words).collect()
    got = {r.doc_id: (r._marks.n_words, r._marks.n_hit, r._marks["items"], r._marks.contaminated) for r in rows}
    assert got == {
        1: (420, 20, ["1", "5"], False), 2: (7, 5, ["2"], True), 3: (0, 0, [], False), 4: (0, 0, [], False),
        5: (12, 0, [], False), 6: (4, 4, [], True), 7: (22, 20, ["1", "5"], True),
    }
    kept = decontaminate.keep_clean(table, benchmark, block_words=block_words)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]


def F_lit():
    from pyspark.sql import functions as F

    return F.lit("mine")


def test_clean_text(docs, benchmark):
    table = docs((1, f"Before, {ITEM}! After."), (2, None), (3, "so " * 300 + SHORT), (4, SHORT + " é"))
    got = {r.doc_id: r.clean_text for r in decontaminate.clean(table, benchmark).collect()}
    assert got == {1: "Before, ! After.", 2: None, 3: "so " * 300 + SHORT, 4: " é"}


def test_empty_tables(spark, docs, benchmark):
    table = docs((1, ITEM), (2, None))
    rows = decontaminate.report(table, benchmark.where("item_id = 99")).collect()
    assert sorted((r.doc_id, r._marks.n_words, r._marks.n_hit) for r in rows) == [(1, 20, 0), (2, 0, 0)]
    assert decontaminate.report(table.where("doc_id = 9"), benchmark).count() == 0
