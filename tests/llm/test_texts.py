import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelsieve.llm import packing, spans, tokens

RANKS = None
TEXTS = [
    "", None, " ", "a", "Hello, world!", "don't we'll I'M", "  leading and trailing  \n\n", "tab\tand\r\nlines\r\r", "naïve café — “quotes” …", "日本語のテキスト" * 30, "🙂👩‍👩‍👧 𝒳𝒴", "  x　y z",
    "١٢٣ 456 ½ Ⅷ", "x" * 700, "ab" * 300, "<|endoftext|>", "á̀b", "\x00\x01\x7f", "مرحبا بالعالم", "_under_score__ ###", "\\begin{eq} x^2_{i,j} \\end{eq}", "'s's 'S", "0123456789" * 20, "﻿bom", "\n" * 50 + "x", "Σίσυφος ЁЖИК",
]


@pytest.fixture(scope="module")
def ranks():
    return tokens.load_ranks()


@pytest.fixture(scope="module")
def reference(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokens.PATTERN.removeprefix("(?U)"), mergeable_ranks=ranks, special_tokens={})


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, w string")


def test_same_ids_as_the_reference_and_back(spark, ranks, reference):
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choice("aeiou tnrsl'.,\n 0é日🙂") for _ in range(r.randrange(120))) for _ in range(150)]
    df = frame(spark, texts)
    got = {x.doc_id: x for x in tokens.decode(tokens.encode(df, ranks=ranks), into="back", ranks=ranks).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == reference.encode_ordinary(t or ""), t
        assert got[i].back == (t or "")


def test_long_words(spark, ranks, reference):
    r = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    texts = ["".join(r.choice(letters) for _ in range(n)) for n in (tokens.LONG - 1, tokens.LONG, tokens.LONG + 1, 700, 1500)]
    texts += ["a" * 1001, "ab" * 300, "é" * 300, "日本語" * 150, "-=" * 300, "".join(r.choice("ab") for _ in range(900)), "".join(r.choice(["the", "ing", "a"]) for _ in range(300))]
    got = {x.doc_id: x.ids for x in tokens.encode(frame(spark, texts), ranks=ranks).collect()}
    assert got == {i: reference.encode_ordinary(t) for i, t in enumerate(texts)}


def test_the_cache_is_bounded_and_from_all_parts(spark, ranks, monkeypatch):
    monkeypatch.setattr(tokens, "HOT_WORDS", 20)
    monkeypatch.setattr(tokens, "HOT_BYTES", 8)
    df = spark.createDataFrame([(f"part{i // 50} " + "x" * 9,) for i in range(200)], "text string").repartitionByRange(4, "text")
    hot = tokens.hot_words(df, "text", ranks)
    assert {"part", "0", "1", "2", "3", " "} >= {w for w in hot if w.strip() in "0123"} and {"0", "1", "2", "3"} <= set(hot)
    assert len(hot) <= 20 and max(map(len, hot)) <= 8


def test_without_the_cache(spark, ranks, reference, monkeypatch):
    monkeypatch.setattr(tokens, "HOT_WORDS", 3)
    df = frame(spark, TEXTS)
    assert {x.doc_id: x.ids for x in tokens.encode(df, ranks=ranks).collect()} == {i: reference.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    assert {x.doc_id: x.n_tokens for x in tokens.count_tokens(df, ranks=ranks).collect()} == {i: len(reference.encode_ordinary(t or "")) for i, t in enumerate(TEXTS)}


def test_another_vocabulary(spark):
    import tiktoken

    path = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    ranks = tokens.load_ranks(path)
    enc = tiktoken.Encoding("multi", pat_str=tokens.PATTERN.removeprefix("(?U)"), mergeable_ranks=ranks, special_tokens={})
    got = {x.doc_id: x.ids for x in tokens.encode(frame(spark, TEXTS), vocabulary=path).collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}


def test_no_texts(spark, ranks):
    assert tokens.encode(frame(spark, []), ranks=ranks).count() == 0


def test_no_shuffle_and_no_python_in_the_encoding(spark, ranks):
    plan = tokens.encode(frame(spark, TEXTS).filter("doc_id >= 0"), ranks=ranks)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange (hash|range|Single|RoundRobin)|ArrowEvalPython|BatchEvalPython|MapInArrow", plan)


def items_frame(spark, sizes):
    return spark.createDataFrame([(i, s, 0) for i, s in enumerate(sizes)], "id long, size long, part int")


def caps_frame(spark, caps):
    return spark.createDataFrame([(i, c) for i, c in enumerate(caps)], "cap_id int, capacity int")


def check_packing(rows, sizes, caps):
    by = {}
    for r in rows:
        by.setdefault(r.cap_id, []).append(r)
    assert set(by) == {i for i, c in enumerate(caps) if c and c > 0}
    for k, part in by.items():
        cap, fill, got = caps[k], {}, {}
        for r in part:
            assert r.capacity == cap and r.start == r.part * cap
            fill[r.container] = fill.get(r.container, 0) + r.size
            got.setdefault(r.id, {})[r.part] = r.size
        assert max(fill.values()) <= cap
        assert len(part) == sum(len(p) for p in got.values())
        for i, s in enumerate(sizes):
            s = max(s or 0, 0)
            whole = [cap] * (s // cap) + ([s % cap] if s % cap else []) if s > cap else [s]
            assert [got[i][p] for p in range(len(whole))] == whole and len(got[i]) == len(whole)
    return {k: len({r.container for r in p}) for k, p in by.items()}


def plain_best_fit(sizes, cap):
    """Containers of best fit by falling size, item by item."""
    room = []
    for s in sorted((s for s in sizes if s), reverse=True):
        at = min((x for x in range(len(room)) if room[x] >= s), key=lambda x: room[x], default=None)
        if at is None:
            room.append(cap)
            at = -1
        room[at] -= s
    return len(room)


@pytest.mark.parametrize("shard, ranking", [(2500, 10**6), (60, 50)])
def test_packing(spark, monkeypatch, shard, ranking):
    monkeypatch.setattr(packing, "SHARD_ITEMS", shard)
    monkeypatch.setattr(packing, "ITEMS_A_RANKING", ranking)
    r = random.Random(3)
    sizes = [r.choice([r.randrange(5), r.randrange(900), r.randrange(100, 300), 512, 5000]) for _ in range(900)] + [None, -4, 0, 1024, 1025, 2048]
    caps = [1024, 4096, 700, 100_000]
    rows = packing.pack(items_frame(spark, sizes), caps_frame(spark, caps)).collect()
    used = check_packing(rows, sizes, caps)
    alone = {r.cap_id: r for r in packing.best_fit_alone(items_frame(spark, sizes), caps_frame(spark, caps)).collect()}
    for k, n in used.items():
        rest = [max(s or 0, 0) for s in sizes]
        full = sum(s // caps[k] for s in rest if s > caps[k])
        rest = [s % caps[k] if s > caps[k] else s for s in rest]
        if caps[k] <= packing.CLASSES:
            assert alone[k].best_fit == full + plain_best_fit(rest, caps[k])
        assert alone[k].least <= n <= alone[k].best_fit


def test_best_fit_of_counts_is_best_fit():
    r = random.Random(5)
    for _ in range(60):
        cap = r.randrange(1, 60)
        sizes = [r.randrange(1, cap + 1) for _ in range(r.randrange(80))]
        counts = {s: sizes.count(s) for s in sizes}
        slots, bins = packing.best_fit_of_counts(counts, cap)
        assert bins == plain_best_fit(sizes, cap)
        start = packing._Start(counts, cap)
        fill = {}
        for s, n in counts.items():
            for b in start.container(np.full(n, s), np.arange(n)).tolist():
                fill[b] = fill.get(b, 0) + s
        assert sorted(fill) == list(range(bins)) and max(fill.values(), default=0) <= cap


def test_lower_bounds_hold_and_evolution_gains():
    r = np.random.default_rng(7)
    won = 0
    for _ in range(12):
        sizes = r.integers(200, 500, 300)
        best, fill = np.zeros(300, np.int64), []
        packing.best_fit(sizes, np.argsort(-sizes, kind="stable"), 1000, best, fill)
        bound = packing.lower_bound(sizes, 1000)
        assert -(-int(sizes.sum()) // 1000) <= bound <= len(fill)
        found = packing.evolved(sizes, 1000, [best, *(packing.started(sizes, 1000, r) for _ in range(3))], r)[0].max() + 1
        assert bound <= found <= len(fill)
        won += found < len(fill)
    assert won >= 3
    assert packing.lower_bound(np.array([6, 6, 6, 4]), 10) == 3 and packing.lower_bound(np.array([5, 5, 5]), 10) == 2


def test_capacities_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "CLASSES_AT_ONCE", 50)
    sizes = [3, 9, 30, 8, 8, 1, 0] * 5
    caps = [10, 20, 30, 40, 5]
    check_packing(packing.pack(items_frame(spark, sizes), caps_frame(spark, caps)).collect(), sizes, caps)


def test_packing_same_result_each_time(spark):
    df, caps = items_frame(spark, list(range(1, 200))), caps_frame(spark, [500])
    one, two = ({(r.id, r.container) for r in packing.pack(df, caps).collect()} for _ in range(2))
    assert one == two


def test_packing_edge_cases(spark):
    none = items_frame(spark, [])
    assert packing.pack(none, caps_frame(spark, [5])).count() == 0
    assert packing.pack(items_frame(spark, [1]), caps_frame(spark, [])).count() == 0
    assert packing.pack(items_frame(spark, [1]), caps_frame(spark, [0, -1, None])).count() == 0
    check_packing(packing.pack(items_frame(spark, [0, 0, None]), caps_frame(spark, [3])).collect(), [0, 0, None], [3])
    check_packing(packing.pack(items_frame(spark, [10, 9]), caps_frame(spark, [3, 3])).collect(), [10, 9], [3, 3])


def test_children_keep_every_item():
    r = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        sizes = r.integers(0, 100, n)
        people = [packing.started(sizes, 100, r) for _ in range(4)]
        for p in [*people, packing.crossed(sizes, people[0], people[-1], 100, r), *packing.evolved(sizes, 100, people, r)]:
            assert len(p) == n and np.bincount(p, weights=sizes).max() <= 100


def test_replacing_beside_many_tiny_items_is_small():
    """3,000 items of a few tokens in one container are 4.5 million couples."""
    r = np.random.default_rng(3)
    sizes = np.r_[r.integers(20_000, 26_000, 1200), r.integers(1, 8, 3000)]
    bins = np.r_[np.arange(1200) // 2, np.full(3000, 600)]
    bins[:40] = -1
    tracemalloc.start()
    free = packing.replaced(sizes, 65_536, bins, np.arange(40))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6
    assert sorted(free) == np.flatnonzero(bins < 0).tolist() and np.bincount(bins[bins >= 0], weights=sizes[bins >= 0]).max() <= 65_536


def test_replacing_is_the_same_in_any_blocks(monkeypatch):
    r, moved = np.random.default_rng(2), 0
    for _ in range(30):
        sizes, whole = r.integers(1, 40, 24), []
        start = packing.started(sizes, 100, r)
        start[r.random(24) < 0.2] = -1
        for block in (3, 8_192):
            monkeypatch.setattr(packing, "COUPLES", block)
            monkeypatch.setattr(packing, "REPLACEMENTS", 10**6)
            bins = start.copy()
            free = packing.replaced(sizes, 100, bins, np.flatnonzero(bins < 0))
            assert sorted(free) == np.flatnonzero(bins < 0).tolist() and np.bincount(bins[bins >= 0], weights=sizes[bins >= 0], minlength=1).max() <= 100
            whole.append(bins.tolist())
        assert whole[0] == whole[1]
        moved += whole[0] != start.tolist()
    assert moved > 15


def plain_spans(texts, shortest):
    where = {}
    for d, t in texts.items():
        for i in range(len(t or "") - shortest + 1):
            where.setdefault(t[i : i + shortest], set()).add(d)
    pairs = {(a, b) for s in where.values() for a in s for b in s if a < b}
    cover = {}
    for d, t in texts.items():
        mask = [0] * (len(t or "") + 1)
        for i in range(len(t or "") - shortest + 1):
            if len(where[t[i : i + shortest]]) > 1:
                for k in range(i, i + shortest):
                    mask[k] = 1
        cover[d] = sum(mask)
    return pairs, cover


def make_texts(seed, n=24, shortest=400):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice("abcdefgh é日🙂\n") for _ in range(k))
    shared = [word(k) for k in (shortest - 1, shortest, shortest + 1, shortest * 2, shortest - 1)]
    texts = {}
    for d in range(n):
        texts[d] = "".join(x for _ in range(3) for x in (word(r.randrange(0, shortest)), r.choice(shared) if r.random() < 0.5 else ""))
    texts |= {100: None, 101: "", 102: "short", 103: texts[3], 104: texts[3], 105: "z" * 900, 106: "z" * 1500, 107: "z" * (shortest - 1), 108: shared[1], 109: shared[1]}
    return texts


@pytest.mark.parametrize("shortest", [400, 401, 40, 7, 1])
def test_shared_spans_exactly(spark, shortest):
    texts = make_texts(shortest, shortest=shortest) if shortest > 1 else {0: "ab", 1: "bc", 2: "x", 3: None, 4: ""}
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in texts.items()], "doc_id long, text string, cls int, code int")
    pairs, cover = plain_spans(texts, shortest)
    got = [(r.doc_a, r.doc_b) for r in spans.shared_pairs(df, shortest).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    rows = spans.coverage(df, shortest).collect()
    assert {r.doc_id: r.shared_chars for r in rows} == cover
    assert all(r.chars == len(texts[r.doc_id] or "") for r in rows)


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spans.shared_pairs(df).count() == 0 and spans.coverage(df).count() == 0


def test_many_slices_and_shuffled_ids(spark, monkeypatch):
    monkeypatch.setattr(spans, "BROADCAST_IDS", 0)
    texts = make_texts(11)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {(r.doc_a, r.doc_b) for r in spans.shared_pairs(df).collect()} == plain_spans(texts, 400)[0]
    assert list(spans._slices([3, 3, 10, 1, 1], 6)) == [(0, 2), (2, 3), (3, 5)] and list(spans._slices([], 6)) == []


@pytest.mark.parametrize("crowd,at_once", [(2, 10**6), (2, 3), (0, 10**6)])
def test_crowded_windows(spark, monkeypatch, crowd, at_once):
    """A preamble one character too short in nearly all texts, and one just long enough in some."""
    monkeypatch.setattr(spans, "CROWD", crowd)
    monkeypatch.setattr(spans, "CROWDED_AT_ONCE", at_once)
    r = random.Random(5)
    word = lambda k: "".join(r.choice("abcdefgh") for _ in range(k))
    short, long = word(399), word(400)
    texts = {d: word(r.randrange(90)) + r.choice("xyz") + short + r.choice("xyz") + word(r.randrange(200)) + (long if d % 4 == 0 else "") + word(50) for d in range(40)} | make_texts(12)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pairs, cover = plain_spans(texts, 400)
    assert {(x.doc_a, x.doc_b) for x in spans.shared_pairs(df).collect()} == pairs
    assert {x.doc_id: x.shared_chars for x in spans.coverage(df).collect()} == cover


def test_a_passage_in_all_texts_makes_no_pairs_for_coverage(spark, monkeypatch):
    monkeypatch.setattr(spans, "CROWD", 5)
    r = random.Random(6)
    word = lambda k: "".join(r.choice("abcdefgh") for _ in range(k))
    common = word(700)
    texts = {d: word(spans.PERIOD * r.randrange(2)) + common + word(r.randrange(60)) for d in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    compared = []
    runs = spans._runs
    monkeypatch.setattr(spans, "_runs", lambda search, matches, *a: compared.append(matches.count()) or runs(search, matches, *a))
    got = {x.doc_id: x.shared_chars for x in spans.coverage(df).collect()}
    assert got == plain_spans(texts, 400)[1] and compared[0] < 60


def test_long_repetitive_texts(spark):
    r = random.Random(8)
    line = "".join(r.choice("abc") for _ in range(37))
    texts = {0: "z" * 60_000, 1: "z" * 45_000 + "y", 2: line * 1500, 3: "q" + line * 900 + "q", 4: " \n" * 20_000, 5: "x" + " \n" * 300, 6: "z" * 399}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {(x.doc_a, x.doc_b) for x in spans.shared_pairs(df).collect()} == {(0, 1), (2, 3), (4, 5)}
    got = {x.doc_id: x.shared_chars for x in spans.coverage(df).collect()}
    assert got == {0: 60_000, 1: 45_000, 2: 37 * 1500, 3: 37 * 900, 4: 40_000, 5: 600, 6: 0}


def test_covers():
    for shortest in (400, 399, 398, 100, 50, 9, 3, 2, 1):
        period, cover = spans.cover_for(shortest)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period)) and period <= shortest
        assert max(cover) < period


def test_columns_with_clashing_names(spark):
    df = frame(spark, ["same " * 100, "same " * 100]).withColumn("digest", F.lit(1)).withColumn("a", F.lit(2))
    assert spans.shared_pairs(df).count() == 1


def plain_runs(x, y, shortest):
    """Every run that cannot be made longer, shift by shift."""
    out = set()
    for s in range(-len(y), len(x)):
        i = max(0, s)
        while i < len(x) and i - s < len(y):
            n = 0
            while i + n < len(x) and i - s + n < len(y) and x[i + n] == y[i - s + n]:
                n += 1
            if n >= shortest:
                out.add((i, i - s, n))
            i += n + 1
    return out


@pytest.mark.parametrize("shortest", [1, 3, 8])
@pytest.mark.parametrize("truth", [True, False])
def test_every_run_is_whole(monkeypatch, shortest, truth):
    if not truth:
        monkeypatch.setattr(spans, "_true_hashes", lambda *a: False)
    r = random.Random(shortest)
    texts = [("a" * 40, "a" * 30), ("ab" * 20, "b" + "ab" * 9 + "c"), ("", "a")]
    for _ in range(60):
        parts = ["".join(r.choice("ab\0🙂") for _ in range(r.randrange(1, 12))) for _ in range(4)]
        texts.append(tuple("".join(r.choice(parts) for _ in range(r.randrange(1, 8))) for _ in range(2)))
    for a, b in texts:
        if min(len(a), len(b)) < shortest:
            continue
        x, y = spans.Text([a]), spans.Text([b])
        hx, hy = (t.windows(np.arange(len(t.points) - shortest + 1), shortest) for t in (x, y))
        got = list(spans._every_run(x.points, y.points, hx, hy, shortest))
        assert len(got) == len(set(got)) and set(got) == plain_runs(a, b, shortest)


def test_equal_hashes_of_different_windows():
    x, y = (np.array([ord(c) for c in t], dtype=np.uint32) for t in ("abcabd", "abcabe"))
    h = np.array([7, 7, 8, 9], dtype=np.uint64)
    assert not spans._true_hashes(x, y, h, h, 3)
    assert set(spans._every_run(x, y, h, h, 3)) == plain_runs("abcabd", "abcabe", 3) == {(0, 0, 5)}


def test_spans_are_the_same_on_either_side_of_a_switch(spark, monkeypatch):
    r = random.Random(9)
    word = lambda k: "".join(r.choice("abcdefgh") for _ in range(k))
    p, q = word(400), word(300)
    texts = [word(50) + p + word(60) + p + q + word(20), word(70) + p + word(80) + p + q + word(30), *[word(9) + p + word(d) for d in range(8)]]
    df = frame(spark, texts)
    want = {(a, b, *run) for a in range(10) for b in range(a + 1, 10) for run in plain_runs(texts[a], texts[b], 400)}
    assert max(w[4] for w in want if w[:2] == (0, 1)) == 700 and len([w for w in want if w[:2] == (0, 1)]) == 4
    for crowd, shifts in ((10**6, 10**6), (2, 10**6), (10**6, 0)):
        monkeypatch.setattr(spans, "CROWD", crowd)
        monkeypatch.setattr(spans, "MANY_SHIFTS", shifts)
        got = [tuple(x) for x in spans.class_spans(df, spans.checkpointed(spans.text_classes(df)), every=True).collect()]
        assert len(got) == len(set(got)) and set(got) == want
