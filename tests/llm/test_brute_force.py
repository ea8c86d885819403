"""Operators against plain loops on small inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from kinfold.llm import components, decontam, grouping, langid, linededup, mixing, pii, quality, simhash, substring, suffix, toxicity, windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = "doc_id long, text string"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def corpus(seed, n=60, vocabulary=12, longest=90):
    """Random texts with copies, shared passages and repeated words."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 5))) for _ in range(vocabulary)]
    passage = " ".join(r.choice(words) for _ in range(50))
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, longest))) for _ in range(n)]
    for i in range(0, n, 6):
        texts[i] = texts[i] + "\n" + passage + " " + texts[(i * 7 + 1) % n]
    texts[1] = texts[0]
    texts[2] = "x " * 80
    texts[3] = texts[3] + " " + passage[: len(passage) // 2] + " odd " + passage
    texts[4], texts[5] = None, ""
    return list(enumerate(texts))


def test_quality_measurements(spark):
    rows = corpus(1) + [(100, "a\nb\na\n \n\n a"), (101, "# $% x|x <>")]
    got = {r["doc_id"]: r for r in quality.query(spark.createDataFrame(rows, TEXT)).collect()}
    for doc, text in rows:
        text = text or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        grams = Counter(zip(words, words[1:], words[2:]))
        covered = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
        r = got[doc]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r["base_failed"] and r["kept"])


def test_quality_ablations(spark):
    book = quality.ledger(spark.createDataFrame(corpus(2), TEXT)).cache()
    bits = [r["fail_bits"] for r in book.collect()]
    for r in quality.ablations(book).collect():
        mask = quality.POLICIES[r["policy"]]
        rest = mask & ~quality.BIT[r["left_out"]]
        kept = sum(b & rest == 0 for b in bits)
        assert (r["n_kept"], r["n_gained"]) == (kept, kept - sum(b & mask == 0 for b in bits))


@given(st.dictionaries(st.one_of(st.none(), st.text(max_size=2)), st.integers(0, 1000), max_size=7))
def test_targets(sizes):
    got = mixing.targets(sizes)
    assert set(got) == set(sizes)
    assert all(got[s] <= 2 * sizes[s] + 1e-6 for s in sizes)
    assert abs(sum(got.values()) - 1.5 * sum(sizes.values())) < 1e-6 * (1 + sum(sizes.values()))


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=1, max_size=8), st.integers(0, 400))
@settings(max_examples=200)
def test_fit_is_exact_where_a_table_holds_it(counts, budget):
    lengths, n = np.array(list(counts)), np.array(list(counts.values()))
    take = mixing.fit(lengths, n, budget)
    assert (take >= 0).all() and (take <= n).all() and (take * lengths).sum() <= budget
    start = np.array([int(c) * budget // max(1, int((lengths * n).sum())) for c in n]) if (lengths * n).sum() > budget else n
    reach = {int((start * lengths).sum())}
    for length, free in zip(lengths.tolist(), (n - start).tolist()):
        reach |= {r + length * k for r in reach for k in range(free + 1)}
    assert (take * lengths).sum() == max(r for r in reach if r <= budget)


def test_mix_meets_its_targets_and_agrees(spark):
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.randint(0, 60)), r.choice(["a", "a", "a", "b", "ç", None])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = {x["doc_id"]: x for x in mixing.query(docs).collect()}
    two = {x["doc_id"]: x for x in mixing.query(docs.repartition(7, "text")).collect()}
    assert one == two and len(one) == len(rows)
    taken, target = Counter(), {}
    for doc, text, source in rows:
        assert one[doc]["size"] == len(text.split()) and one[doc]["taken"] <= 2 * one[doc]["size"]
        taken[source] += one[doc]["taken"]
        target[source] = one[doc]["target"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_mix_ranks_within_bins(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 7)
    rows = [(i, "a b c", "one") for i in range(300)] + [(1000 + i, "a", "two") for i in range(30)]
    got = mixing.query(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert len(got) == 330 and abs(got[got.doc_id < 1000].taken.sum() - got[got.doc_id < 1000].target.iloc[0]) <= 3


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("cap", [512, 2])
def test_simhash_components(spark, cap):
    rows = [(i * 3 % 97, t) for i, t in corpus(5)]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(rows, TEXT), cap).collect()}
    prints = {d: plain_fingerprint(t) for d, t in rows}
    assert all(got[d]["fp"] % (1 << 64) == prints[d] for d in prints)
    group = {d: d for d in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    group[a] = group[b] = min(group[a], group[b])
    assert {d: got[d]["component_id"] for d in prints} == group


def test_components_of_long_paths_and_stars(spark):
    path, star = [(i, i + 1) for i in range(40)], [(100, i) for i in range(101, 160)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(path + star, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), **dict.fromkeys(range(101, 160), 100)}


@given(st.text("a1.@+ -()%9 0é\n", max_size=50))
@settings(max_examples=1500)
def test_pii_base_spans(text):
    got = ",".join(f"{k}:{s}:{e}" for k, s, e in pii.spans(text) if k in pii.BASE_KINDS)
    assert got == pii.brute_force(text)


def test_pii_added_kinds_and_redaction(spark):
    text = 'see https://a.example/x?q=1. IBAN DE89 3704 0044 0532 0130 00, token = "0123456789abcdef0123" account no: 12-345678; a@b.co'
    found = {k: text[s:e] for k, s, e in pii.spans(text)}
    assert found["url"] == "https://a.example/x?q=1" and found["iban"].startswith("DE89") and found["secret"] == "0123456789abcdef0123" and found["account"] == "12-345678"
    out = pii.redact(spark.createDataFrame([(1, text), (2, None)], TEXT)).collect()
    assert "a@b.co" not in out[0]["text"] and "[email]" in out[0]["text"] and out[1]["text"] is None
    row = pii.query(spark.createDataFrame([(1, text)], TEXT)).first()
    assert row["n_email"] == 1 and row["base_sha256"] == sha(pii.brute_force(text))


@pytest.mark.parametrize("terms", [decontam.MAX_TERMS, 3])
def test_leaks(spark, terms):
    r = random.Random(8)
    words = ["".join(r.choice("bcdfgaeiou") for _ in range(6)) for _ in range(900)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([20, 35, 60, 120, 5, 12])] + [(90, None), (91, "")]
    text = dict(items)
    swapped = text[1].split()
    for i in range(0, 30, 6):
        swapped[i] = "other"
    rows = [(i, say(300)) for i in range(40)] + [(100 + i, f"{say(150)} {t.upper()}, {say(90)}") for i, t in items if t] + [(200, f"{say(70)} {' '.join(swapped)} {say(70)}"), (300, None), (301, "")]
    got = decontam.find_leaks(spark.createDataFrame(rows, TEXT), spark.createDataFrame(items, "item_id long, text string"), max_terms=terms).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == {(100 + i, i) for i, t in items if t} | {(200, 1)}
    assert min(x["lcs"] for x in got) < 1 == max(x["lcs"] for x in got)
    kept = decontam.keep_clean(spark.createDataFrame(rows, TEXT), spark.createDataFrame(items, "item_id long, text string"))
    assert {x["doc_id"] for x in kept.collect()} == {d for d, _ in rows} - {x["doc_id"] for x in got}


def zipf_words(r, n_words, n):
    """Words of a vocabulary of ``n_words``, the first far more often than the last."""
    return [f"w{int(n_words ** r.random()):05d}" for _ in range(n)]


def reworded(r, tokens, share):
    return [f"new{r.randint(0, 99)}" if i in at else w for at in [set(r.sample(range(len(tokens)), int(share * len(tokens))))] for i, w in enumerate(tokens)]


def test_leaks_of_a_large_benchmark(spark):
    r = random.Random(21)
    items = [(i, zipf_words(r, 20_000, r.randint(20, 40))) for i in range(2500)]
    rows, planted = [], set()
    for i, part in items[:1500]:
        rows.append((i, " ".join(zipf_words(r, 20_000, r.randint(30, 90)) + reworded(r, part, 0.28 * (i % 2)) + zipf_words(r, 20_000, r.randint(30, 90)))))
        planted.add((i, i))
    got = decontam.find_leaks(spark.createDataFrame(rows, TEXT), spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string"))
    assert planted <= {(x["doc_id"], x["item_id"]) for x in got.collect()}


def plain_leaks(rows, items):
    """Pairs by the words alone, of every place and every passage of items (item, words, answer)."""
    texts = {doc: decontam.words(text) for doc, text in rows}
    n = sum(map(bool, texts.values()))
    df = Counter(w for tokens in texts.values() for w in set(tokens))
    weight = lambda w: np.log((n + 1) / (df[w] + 1)) + 0.1
    found = set()
    for doc, tokens in texts.items():
        for p in range(0, max(1, len(tokens) - 20), 20) if tokens else ():
            for item, words, answer in items:
                for part in [words[i : i + 40] for i in range(0, max(1, len(words) - 20), 20)]:
                    near = tokens[max(0, p - len(part)) : p + 40 + len(part)]
                    held, half = {*near}, len(part) // 2
                    share = sum(weight(w) for w in part if w in held) / sum(map(weight, part))
                    if len(held & {*part}) < 3:
                        continue
                    common = (decontam.lcs(part[:half], near) + decontam.lcs(part[half:], near)) / len(part)
                    answered = len(answer) > 2 and decontam.within(answer, near)
                    if decontam.within(part, near) if len(part) < 8 else common >= 0.7 or share >= 0.55 - 1e-9 and common >= 0.5 or answered and share >= 0.45 - 1e-9 and common >= 0.4:
                        found.add((doc, item))
    return found


@pytest.mark.parametrize("change", [0.2, 0.3, 0.4, "swapped", "swapped, 0.2"])
def test_recall_of_paraphrases(spark, change):
    r = random.Random(31)
    items = [(i, zipf_words(r, 3000, r.randint(20, 70))) for i in range(150)]
    share = change if isinstance(change, float) else 0.2 * change.endswith("0.2")
    rows = [(1000 + i, " ".join(zipf_words(r, 3000, 300))) for i in range(150)]
    for i, part in items:
        now = [r.choice(part2) if k in at else w for at, part2 in [({*r.sample(range(len(part)), int(share * len(part)))}, zipf_words(r, 3000, 40))] for k, w in enumerate(part)]
        if "swapped" in str(change):
            now = now[len(now) // 2 :] + now[: len(now) // 2]
        rows.append((i, " ".join(zipf_words(r, 3000, r.randint(0, 120)) + now + zipf_words(r, 3000, r.randint(0, 120)))))
    got = {(x["doc_id"], x["item_id"]) for x in decontam.find_leaks(spark.createDataFrame(rows, TEXT), spark.createDataFrame([(i, " ".join(p)) for i, p in items], "item_id long, text string")).collect()}
    assert len([i for i, _ in items if (i, i) in got]) >= (0.8 if change == 0.4 else 0.95) * len(items)
    assert len([x for x in got if x[0] != x[1]]) <= 1


@pytest.mark.parametrize("terms", [decontam.MAX_TERMS, 700])
def test_leaks_agree_with_brute_force(spark, terms):
    r = random.Random(22)
    items = [(i, zipf_words(r, 3000, r.choice([5, 7, 10, 20, 30, 40, 70]))) for i in range(330)]
    answers = {i: part[-4:] if i % 3 else part[-2:] for i, part in items}
    rows = []
    for d in range(60):
        text = zipf_words(r, 3000, r.randint(0, 70))
        for i, part in r.sample(items, 3):
            kept = reworded(r, part[:-4], r.choice([0, 0.2, 0.3, 0.4, 0.5])) + part[-4:]
            for _ in range(r.choice([0, 0, 15])):
                kept.insert(r.randrange(len(kept)), f"in{r.randint(0, 99)}")
            text += kept + zipf_words(r, 3000, r.randint(0, 50))
        rows.append((d, " ".join(text)))
    table = spark.createDataFrame([(i, " ".join(part), " ".join(answers[i])) for i, part in items], "item_id long, text string, answer string")
    got = [(x["doc_id"], x["item_id"]) for x in decontam.find_leaks(spark.createDataFrame(rows, TEXT), table, max_terms=terms, scan=200).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_leaks(rows, [(i, part, answers[i]) for i, part in items])


def test_latent_space_is_fitted_on_every_passage(spark, monkeypatch):
    """300 documents of 300 words, each the only one with some of the benchmark's words: a bounded sample misses most of them."""
    r, fitted, svd = random.Random(23), [], decontam.randomised_svd
    monkeypatch.setattr(decontam, "randomised_svd", lambda rows, columns, *more: fitted.append((columns, rows.collect())) or svd(rows, columns, *more))
    items = [(i, " ".join(f"only{i}w{k}" for k in range(20))) for i in range(300)]
    rows = [(i, " ".join([f"only{i}w{i % 20}", *zipf_words(r, 3000, 299)])) for i in range(300)] + [(None, "only7w1 " * 3), (-5, "only8w2"), (900, None)]
    assert decontam.find_leaks(spark.createDataFrame(rows, TEXT), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    (columns, rows), terms = fitted[0], sorted(f"only{i}w{k}" for i in range(300) for k in range(20))
    times = Counter(terms[c - 1] for row in rows for c in row["cols"])
    held = {f"only{i}w{i % 20}" for i in range(300)} | {"only7w1", "only8w2"}
    assert columns == len(terms) and {t for t, n in times.items() if n > 1} == held  # beside its item's row


def test_sketch_adds_up_every_passage(spark):
    """Against the sums over all passages, one by one."""
    r = np.random.default_rng(24)
    texts = [(d, r.integers(0, 6, n).astype("<u2")) for d, n in enumerate([0, 1, 19, 20, 21, 40, 41, 60, 333, 70_000, 5])]
    weights, square = np.array([1.0, 2, 3, 4]), np.array([9.0, 1, 4, 9, 16, 25])
    row_of = np.array([0, 1, 2, 3, 4, 0])
    plain = np.zeros((decontam.SKETCH, 4))
    for d, ids in texts:
        for p in range(max(-(-len(ids) // 20) - 1, len(ids) > 0)):
            part, x = ids[20 * p : 20 * p + 40], (d + (p + 1) * 0x9E3779B97F4A7C15) % 2**64
            for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                x = (x ^ x >> shift) * by % 2**64
            padded = np.concatenate([part, np.zeros(-len(part) % 20, int)]).astype(int)
            for t in padded[row_of[padded] > 0]:
                plain[x % decontam.SKETCH, row_of[t] - 1] += (1 - 2 * (x >> 63)) * weights[row_of[t] - 1] / np.sqrt(square[padded].sum())
    sent = spark.sparkContext.broadcast((row_of, weights, square))
    rows = spark.createDataFrame([(d, bytearray(ids.tobytes())) for d, ids in texts], "doc_id long, ids binary").repartition(3)
    got = np.array([np.frombuffer(x["v"]) for x in decontam._sketch(rows, sent, "<u2").collect()])
    plain = plain[plain.any(1)]
    assert got.shape == plain.shape and np.allclose(np.array(sorted(got.tolist())), np.array(sorted(plain.tolist())), atol=1e-3)


@given(st.lists(st.integers(0, 4), max_size=30), st.lists(st.integers(0, 4), max_size=30))
def test_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert decontam.lcs(a, b) == best[-1][-1]


def test_randomised_svd_spans_the_rows(spark):
    r = np.random.default_rng(3)
    dense = r.standard_normal((40, 6)) @ r.standard_normal((6, 25))
    rows = spark.createDataFrame([(list(range(1, 26)), x.tolist()) for x in dense], "cols array<int>, weights array<double>")
    v = decontam.randomised_svd(rows, 25, 6)
    assert np.allclose(dense @ v @ v.T, dense, atol=1e-6)


def plain_repeats(rows, window, earlier):
    """Per document: which tokens go; tokens are lists."""
    where = defaultdict(list)
    for doc, tokens in rows:
        for i in range(len(tokens) - window + 1):
            where[tuple(tokens[i : i + window])].append((doc, i))
    gone = {doc: [False] * len(tokens) for doc, tokens in rows}
    for places in where.values():
        low = min(places)[0]
        for doc, i in places:
            if (doc > low) if earlier else len(places) > 1:
                gone[doc][i : i + window] = [True] * window
    return gone


@pytest.mark.parametrize("cap", [1000, 3, 1])
def test_substring_windows(spark, cap):
    rows = corpus(11, vocabulary=6) + [(200, "p q r " * 40), (201, " ".join(f"u{i}" for i in range(35))), (202, " ".join(f"u{i}" for i in range(35)))]
    got = {r["doc_id"]: r for r in substring.remove_repeats(spark.createDataFrame(rows, TEXT), cap=cap).collect()}
    gone = plain_repeats([(d, (t or "").split()) for d, t in rows], 35, False)
    for d, t in rows:
        words = (t or "").split()
        assert (got[d]["n_words"], got[d]["n_removed"]) == (len(words), sum(gone[d]))
        assert got[d]["text"] == " ".join(w for w, x in zip(words, gone[d]) if not x)


@pytest.mark.parametrize("cap", [1000, 3, 1])
def test_suffix_windows(spark, cap):
    rows = corpus(12, n=40, vocabulary=5) + [(200, "ab" * 200), (201, "ab" * 40), (202, "é" * 60)]
    rows = [(99 - d if d < 40 else d, t) for d, t in rows]
    got = {r["doc_id"]: r for r in suffix.remove_repeats(spark.createDataFrame(rows, TEXT), cap=cap).collect()}
    gone = plain_repeats([(d, list((t or "").encode())) for d, t in rows], 50, True)
    for d, t in rows:
        data, out = (t or "").encode(), gone[d]
        runs = sum(x and not (i and out[i - 1]) for i, x in enumerate(out))
        assert (got[d]["n_bytes"], got[d]["n_removed"], got[d]["n_spans"]) == (len(data), sum(out), runs)
        assert bytes(got[d]["data"]) == bytes(b for b, x in zip(data, out) if not x)


@given(st.lists(st.lists(st.integers(1, 3), max_size=25), min_size=1, max_size=6))
@settings(max_examples=300)
def test_grouped_suffix_arrays(texts):
    texts = [[*t, 0] for t in texts]
    offsets = np.cumsum([0, *map(len, texts)])
    got = grouping.suffix_arrays(np.array([c for t in texts for c in t]), offsets)
    for b, t in enumerate(texts):
        assert (got[offsets[b] : offsets[b + 1]] - offsets[b]).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def plain_lines(rows, least):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    return {d: [x for x in (t or "").split("\n") if held[key(x)] < least] for d, t in rows}


@pytest.mark.parametrize("limit", [linededup.FILTER_LIMIT, 0])
def test_line_dedup(spark, limit):
    r = random.Random(6)
    pool = ["Common Line", " common line\t", "rare", "", "  ", "É", "é", "x\x0b"] + [f"own {i}" for i in range(30)]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 9)))) for i in range(80)] + [(90, None), (91, "")]
    docs = spark.createDataFrame(rows, TEXT)
    got = {x["doc_id"]: x for x in linededup.drop_lines(docs, linededup.count_lines(docs), 10, limit).collect()}
    for d, kept in plain_lines(rows, 10).items():
        n = len((dict(rows)[d] or "").split("\n"))
        assert (got[d]["text"], got[d]["n_lines"], got[d]["n_dropped"]) == ("\n".join(kept), n, n - len(kept))


def test_line_dedup_is_reversible(spark):
    one = spark.createDataFrame([(i, f"shared\nown {i}") for i in range(12)], TEXT)
    two = spark.createDataFrame([(50 + i, "shared\nlate\nown 1") for i in range(11)], TEXT)
    table = lambda df: sorted(map(tuple, df.collect()))
    before = linededup.count_lines(one).cache()
    after = linededup.update_counts(before, added=two).cache()
    back = linededup.update_counts(after, removed=two)
    assert table(back) == table(before) and table(after) != table(before)
    old = linededup.build_filters(before, 10, 3)
    new = linededup.update_filters(old, before, after, 10, 3)
    again = linededup.update_filters(new, after, before, 10, 3)
    filters = lambda df: {r["shard"]: linededup.CuckooFilter.from_bytes(bytes(r["filter"])) for r in df.collect()}
    hot = [(r["k1"], r["k2"] % 3) for r in after.filter("n_docs >= 10").collect()]
    held = filters(new)
    assert len(hot) == 3 and all(held[s].contains(np.array([k]))[0] for k, s in hot)
    assert sum((f.table > 0).sum() for f in filters(again).values()) == sum((f.table > 0).sum() for f in filters(old).values()) == 1


@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1), unique=True, max_size=300), st.integers(0, 300))
@settings(max_examples=60)
def test_cuckoo_filter(keys, n):
    made = linededup.CuckooFilter.of(np.array(keys, np.int64))
    assert not keys or made.contains(np.array(keys, np.int64)).all()
    for k in keys[:n]:
        assert made.delete(k)
    rest = keys[n:]
    assert not rest or made.contains(np.array(rest, np.int64)).all()
    assert (made.table > 0).sum() == len(rest)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@given(st.lists(st.text("abc", min_size=5, max_size=8), min_size=1, max_size=6, unique=True), st.text("abcd", max_size=9))
@settings(max_examples=400)
def test_lexicon_automaton(terms, word):
    term, edits = toxicity.LexiconAutomaton(dict.fromkeys(terms, 1.0)).match(word)
    near = min(distance(t, word) for t in terms)
    assert (term is None) == (near > 1)
    if term:
        assert edits == near == distance(term, word)


def test_quoted_hits_are_told_apart():
    scorer = toxicity.Scorer({"stupid": 3.0, "idiot": 2.0})
    direct, quoted = scorer.features("you are a stupid idiot"), scorer.features('she said "you are stupid" and left')
    assert direct[0] > 0 == direct[3] and quoted[3] > 0 == quoted[0]
    assert scorer.features("what a stupld thing")[2] > 0


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = toxicity.query(spark.read.parquet(f"{sf}/documents.parquet"), labels).filter("held_out").join(labels, "doc_id").toPandas()
    assert (found.predicted == found.toxic).mean() > 0.93


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.query(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.93


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2), st.integers(0, 2)), max_size=25), st.lists(st.integers(1, 5), min_size=25, max_size=25))
@settings(max_examples=200)
def test_rows_sorted_by_anchor_are_told_apart_across_batches(rows, sizes):
    rows, batches, at = sorted(rows), [], 0
    for n in sizes:
        part = rows[at : at + n]
        batches.append(pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.int64()) for i in range(3)] + [pa.array([False] * len(part))], ["a", "s", "doc_id", "own"]))
        at += n
    got = [tuple(r.values())[:3] for b in windows.with_company(["a"], "own")(iter(batches)) for r in b.to_pylist()]
    assert got == [r for r in rows if sum(x[0] == r[0] for x in rows) > 1]
    got = sorted((r["a"], r["s"], r["doc_id"], r["kind"]) for b in suffix.kinds(iter(batches)) for r in b.to_pylist())
    want, seen = [], {}
    for a, s, d in rows:
        if (a, s) not in seen:
            seen[a, s] = d
            if len({x[1] for x in rows if x[0] == a}) > 1:
                want.append((a, s, d, suffix.LEAD))
        else:
            want.append((a, s, d, suffix.LATER if d > seen[a, s] else suffix.SAME))
    assert got == sorted(want)


@given(st.integers(0, (1 << 64) - 1), st.lists(st.tuples(st.integers(0, 7), st.integers(1, 255)), max_size=6))
@settings(max_examples=300)
def test_the_count_of_shared_bytes_decides(a, changes):
    b = a
    for i, x in changes:
        b ^= x << (8 * i)
    shared = sum((a ^ b) >> (8 * i) & 0xFF == 0 for i in range(8))
    lists = sum((a & int(m)) == (b & int(m)) for m in simhash._MASKS)
    assert len(simhash._MASKS) == 56 and lists == shared * (shared - 1) * (shared - 2) // 6
    fps = np.array([a, b], np.uint64).view(np.int64)
    for m in simhash._MASKS:
        if a != b and (a & int(m)) == (b & int(m)):
            found, large = simhash._pairs([fps & np.uint64(m).view(np.int64)], fps, 512)
            assert len(found) == (shared >= 4 and (a ^ b).bit_count() <= 4) and not len(large)


def test_a_pair_may_share_a_list_and_fail_the_count():
    a, b = 0, sum(1 << (8 * i) for i in range(5))
    assert sum(a & int(m) == b & int(m) for m in simhash._MASKS) == 1
