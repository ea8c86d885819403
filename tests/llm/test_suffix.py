"""What of op8 grows with chance meetings and with the edges of a passage that many documents share."""

import random

import numpy as np

from kinfold.llm import suffix, windows

TEXT = "doc_id long, text string"


def say(r, n):
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))


def test_stretches_that_share_an_anchor_alone_go_no_further(spark, monkeypatch):
    """1,000 texts with the same 20 bytes amid others: anchors are shared, windows are not; two share 60 bytes."""
    kept, write = [], suffix.stage

    def watched(df, label):
        out = write(df, label)
        if label == "stretches":
            kept.append(out.filter(out.kind == suffix.LEAD).count())
        return out

    monkeypatch.setattr(suffix, "stage", watched)
    r = random.Random(1)
    some, both = [say(r, 20) for _ in range(20)], say(r, 60)
    rows = [(i, say(r, 60) + some[i % 20] + say(r, 60)) for i in range(1000)] + [(2000, say(r, 60) + both), (2001, both + say(r, 60))]
    got = {x["doc_id"]: x["n_removed"] for x in suffix.remove_repeats(spark.createDataFrame(rows, TEXT)).collect()}
    assert {d: n for d, n in got.items() if n} == {2001: 60}
    assert len(kept) == 1 and kept[0] <= 200  # before, the stretches of all 1,000


def test_neighbours_hold_what_two_stretches_share():
    """Stretches of one anchor with a window in common share a hash, whatever else repeats in their texts."""
    r, shared = random.Random(2), 0
    for _ in range(60):
        parts = [say(r, n) for n in (r.randrange(50, 110), 30, 70)] + ["ab" * r.randrange(40)]
        found = []
        for _ in range(2):
            text = "".join(r.choice(parts) for _ in range(6)).encode()
            h = suffix.byte_hashes(text)
            a, s, start, n = windows.stretches(h, 50, 16)
            near = windows.neighbours(h, 50, 16, a, start, n)
            found.append([(x, {text[b + j : b + j + 50] for j in range(m)}, y) for x, b, m, y in zip(a.tolist(), start.tolist(), n.tolist(), near.tolist(), strict=True)])
        for a, own, x in found[0]:
            for b, other, y in found[1]:
                if a == b and own & other:
                    shared += 1
                    assert -1 in (x, y) or x >> 16 & 0xFFFF == y >> 16 & 0xFFFF > 0 or x & 0xFFFF == y & 0xFFFF > 0
    assert shared > 500


def test_equal_runs_of_a_large_group_are_represented_once(monkeypatch):
    """300 stretches that hold the same 70 bytes between different ones; some have equal ids."""
    symbols, sort = [], suffix.suffix_arrays
    monkeypatch.setattr(suffix, "suffix_arrays", lambda x, offsets: symbols.append(len(x)) or sort(x, offsets))
    r = random.Random(3)
    middle = say(r, 70)
    for cuts in ((0,), (0, 5, 9)):
        data = [(say(r, 10) + middle[r.choice(cuts) :] + say(r, 10)).encode() for _ in range(300)]
        docs = np.array([r.randrange(100) for _ in data])
        got = suffix.shared_windows(data, np.zeros(300, np.int64), docs, 50)
        least = {}
        for d, text in zip(docs.tolist(), data, strict=True):
            for j in range(len(text) - 49):
                w = text[j : j + 50]
                least[w] = min(least.get(w, d), d)
        want = [sum(1 << j for j in range(len(x) - 49) if least[x[j : j + 50]] < d) for d, x in zip(docs.tolist(), data, strict=True)]
        assert got.tolist() == want
    assert sum(symbols) <= 20_000  # before, 51 for each of 12,000 windows
