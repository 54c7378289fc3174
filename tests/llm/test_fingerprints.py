import hashlib
import random

import numpy as np
import pytest

from loglark.llm import fingerprints
from loglark.llm.fingerprints import edited, fingerprint, likeness


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 8))) for _ in range(n))


def plain_alike(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                table[i][j] = i + j
            else:
                table[i][j] = min(table[i - 1][j], table[i][j - 1]) + 1
                if a[i - 1] == b[j - 1]:
                    table[i][j] = min(table[i][j], table[i - 1][j - 1])
    return 1 - table[-1][-1] / (len(a) + len(b))


def test_likeness_is_one_less_the_share_of_the_edit_distance():
    rng = random.Random(8)
    for _ in range(60):
        a, b = (["".join(rng.choice("xy") for _ in range(2)) for _ in range(rng.randint(1, 64))] for _ in range(2))
        assert fingerprints._alike("".join(a), "".join(b)) == pytest.approx(plain_alike(a, b))


def test_equal_and_edited_texts():
    rng = random.Random(9)
    for n in (30, 300, 3000):
        a, b = words(rng, n), words(rng, n)
        changed = edited(a, b)
        one = fingerprint(a.encode())
        assert one == fingerprint(a.encode()) and likeness(one, one) == 1
        assert 0.3 < likeness(one, fingerprint(changed.encode())) < 0.75
        assert likeness(one, fingerprint(b.encode())) < 0.2
        moved = "An inserted start. " + a
        assert likeness(one, fingerprint(moved.encode())) > 0.8


def test_boundaries_depend_on_nearby_bytes_only():
    rng = random.Random(10)
    tail = words(rng, 500).encode()
    one, two = (fingerprints._rolled(np.frombuffer(head + tail, np.uint8)) for head in (b"", b"some other start"))
    assert np.array_equal(one[6:], two[-len(one) + 6 :])


def test_pieces_do_not_show(monkeypatch):
    text = words(random.Random(11), 4000).encode()
    want = fingerprint(text)
    monkeypatch.setattr(fingerprints, "_PIECE", 97)
    assert fingerprint(text) == want


@pytest.mark.parametrize("text", ["", "a", "é" * 3, "aaaaaaa" * 20_000, "ab " * 50_000, "x" * 8])
def test_odd_texts(text):
    mark = fingerprint(text.encode())
    size, fine, wide = mark.split(":")
    assert len(fine) <= 2 * fingerprints.CHUNKS and len(wide) <= len(fine) and (fine == "") == (text == "")
    assert likeness(mark, mark) == 1 and 0 <= likeness(mark, fingerprint(b"other")) <= 1
    assert 0 <= likeness(mark, fingerprint(edited(text, "zz").encode())) <= 1


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (key, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        changed = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        marks = [fingerprint(t.encode()) for t in (text, changed, following)]
        out.append((key, len(text), hashlib.sha256(changed.encode()).hexdigest(), *marks[:2], likeness(*marks[:2]),
                    likeness(marks[0], marks[2])))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 60])
def test_rows_meet_their_successors(docs, n):
    rng = random.Random(12)
    rows = [(3 * k, words(rng, rng.randint(1, 60))) for k in range(n)] + ([(1, None), (2, ""), (None, "last 🙂")] if n > 2 else [])
    rng.shuffle(rows)
    got = fingerprints.compare_with_next(docs(*rows).repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_repeated_rows_and_empty_table(docs):
    got = fingerprints.compare_with_next(docs((1, "one text"), (1, "one text"), (1, "one text"))).collect()
    assert len(got) == 3 and all(r.near_next == 1 for r in got)
    assert fingerprints.compare_with_next(docs((1, "a")).where("doc_id = 2")).count() == 0


@pytest.mark.parametrize("ids", [[None], [7], [None, 7, 8, -3]])
def test_a_much_repeated_id_is_spread_over_tasks(spark, docs, ids):
    """Rows of one id, or of none, go by the hash of their text: they meet their successors and no task has them all."""
    rng = random.Random(13)
    rows = [(rng.choice(ids), f"{k} {words(rng, 3)}") for k in range(400)]
    table = docs(*rows).repartition(3)
    got = fingerprints.compare_with_next(table)
    ties = {(r.doc_id, r.text): r.t for r in table.selectExpr("doc_id", "text", "xxhash64(text) AS t").collect()}
    in_order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -ties[r]))
    changed = [t[: len(t) - len(t) // 2] + in_order[(k + 1) % len(rows)][1][: len(t) // 2] for k, (_, t) in enumerate(in_order)]
    assert sorted(r.edited_sha256 for r in got.collect()) == sorted(hashlib.sha256(c.encode()).hexdigest() for c in changed)
    placed = [fingerprints._place(i, ties[i, t]) for i, t in rows]
    frame = spark.createDataFrame([(i, ties[i, t]) for i, t in rows], "id long, tie long")
    bounds = fingerprints._bounds(frame, 8)
    sizes = np.bincount([fingerprints.bisect_right(bounds, p) for p in placed], minlength=8)
    assert len(bounds) == 7 and sizes.max() < 3 * len(rows) / 8
