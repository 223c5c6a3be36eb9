"""Leak search against brute force over all pairs, and its guarantees."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from symbolake.llm import leaks as L

WORDS = [f"{a}{b}" for a in ("re", "un", "in", "co", "de", "pro") for b in ("load", "sort", "bind", "fold", "scan", "trim", "route", "queue")]


def text(rng, n, tag=""):
    return " ".join(f"{rng.choice(WORDS)}{tag and rng.choice(['', tag + str(rng.randrange(900))])}" for _ in range(n))


def noisy(rng, words, every):
    return [f"zz{rng.randrange(99)}" if every and i % every == every // 2 else w for i, w in enumerate(words)]


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(11)
    items = [(i, text(rng, 60, "_x")) for i in range(12)]
    docs, want = [], set()
    for d in range(160):
        i, t = items[rng.randrange(12)]
        n = rng.choice([0, 8, 12, 17, 20, 30, 60])
        start = rng.randrange(0, 61 - n)
        words = t.split()[start : start + n]
        every = rng.choice([0, 0, 9])
        cut = noisy(rng, words, every)
        joined = rng.choice([" ", "\n", "  ", "  ", "\n> ", "\n# "]).join(rng.choice([str.upper, str, lambda w: f"**{w}**", lambda w: w + ",", lambda w: "​" + w])(w) for w in cut)
        docs.append((d, f"{text(rng, 30)} . {joined} . {text(rng, 25)}"))
        if n >= 17:
            want.add((d, i))
    return items, docs, want


def words_of(text):
    """The blank-separated words without all that doesn't count; '' for words of marks only."""
    return ["".join(t for t in L.tokens(w) if t != " ") for w in text.split()]


def holds(item, text):
    """By the definition, over all passages of the item and all alignments with the text: at least 17 words, one in eight differing."""
    a, b = words_of(item), [w for w in words_of(text) if w]
    for start in range(len(a)):
        if not a[start]:
            continue
        row = [0 if w == a[start] else 99 for w in b]  # differing words of the passage so far, by the text's word it ends with
        for end in range(start + 1, min(len(a), start + 2 * 17)):
            if not a[end]:
                continue
            before, row = row, [99] * len(b)
            for j in range(len(b)):
                same = j and b[j] == a[end]
                if same and before[j - 1] * 8 <= end - start + 1 and end - start + 1 >= 17:
                    return True
                row[j] = min(before[j] + 1, (before[j - 1] + (not same)) if j else 99, (row[j - 1] + 1) if j else 99)
    return False


def brute(items, docs):
    return {(d, i) for d, t in docs for i, x in items if set(words_of(x)) & set(words_of(t)) and holds(x, t)}


def test_same_as_brute_force_and_planted(spark, cases):
    items, docs, want = cases
    d = spark.createDataFrame([*docs, (None, "x"), (900, None), (901, ""), (902, "  "), docs[0]], "doc_id long, text string").repartition(3)
    i = spark.createDataFrame([*items, (77, None), (78, "too short"), (None, "x " * 30)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in L.leaks(d, i).collect()}
    assert got == want
    assert {g for g in got if g[0] < 30} == brute(items, docs[:30])


def test_many_passes_give_the_same(spark, cases, monkeypatch):
    items, docs, want = cases
    monkeypatch.setattr(L, "PASS_TOKENS", 200)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in L.leaks(d, i).collect()}
    assert want <= got


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert L.leaks(d, i).count() == 0
    assert L.leaks(d, spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("k", [1, 3, 5])
def test_simhash(k):
    rng = np.random.default_rng(5)
    h = rng.integers(0, 2**63, 40, dtype=np.uint64)
    got = L.simhash(h, k)
    assert len(got) == 41 - k
    for j in range(len(got)):
        bits = [sum((int(x) >> b) & 1 for x in h[j : j + k]) * 2 > k for b in range(64)]
        assert int(got[j]) == sum(1 << b for b, on in enumerate(bits) if on)


def test_limits():
    words = [f"q{i}x" for i in range(40)]
    item = [(1, " ".join(words))]

    def longest(ws):
        return next((w for _, w in _found(item, " ".join(ws))), 0)

    assert longest(words[:17]) == 17 and longest(words[:16]) == 0
    two = [*words[:6], "no", *words[7:12], "no", *words[13:17]]
    assert longest(two) == 17
    three = [*words[:4], "no", *words[5:9], "no", *words[10:13], "no", *words[14:17]]
    assert longest(three) == 0
    assert longest([*words[:8], *words[9:17]]) == 17  # one word left out
    assert longest([*words[:8], "extra", *words[8:17]]) == 17


def test_radius_of_the_fingerprint():
    """A window of 17 words with two replaced shares one of three blocks at least; fewer differing blocks allowed find fewer windows."""
    rng = random.Random(4)
    words = [f"q{i}x" for i in range(200)]
    shared = []
    for _ in range(200):
        at = rng.randrange(len(words) - 17)
        cut = words[at : at + 17]
        for k in rng.sample(range(1, 16), 2):
            cut[k] = f"zz{k}"
        blocks = [cut[k : k + 5] == words[at + k : at + k + 5] for k in (0, 6, 12)]
        shared.append(sum(blocks))
        assert _found([(1, " ".join(words))], " ".join(["some text", *cut, "behind"])) == [(1, 17)]
    assert min(shared) >= 1 and sum(s == 1 for s in shared) > 60  # radius 1, two equal blocks, would lose a third and more


def test_random_edits_by_the_definition():
    rng = random.Random(9)
    words = [f"q{i}x" for i in range(60)]
    for _ in range(150):
        n = rng.randrange(14, 36)
        at = rng.randrange(60 - n)
        cut = list(words[at : at + n])
        for _ in range(rng.randrange(0, 6)):
            k = rng.randrange(1, len(cut) - 1)
            cut[k : k + 1] = rng.choice([[], ["foo.bar.baz.qux.quux"], [cut[k], "put_in"]])
        doc = " ".join([rng.choice(words), "before", *cut, "behind", rng.choice(words)])
        assert bool(_found([(1, " ".join(words))], doc)) == holds(" ".join(words), doc), doc


def test_words_of_marks_only():
    """Among many words without letters or digits fewer than five words in a row may be left untouched."""
    item = " ".join(w if k % 2 else f"{w} =" for k, w in enumerate(f"q{i}x" for i in range(40)))
    words = item.split()[3:23]
    for k in (4, 10):
        k += words[k] == "="
        words[k] = "zz"
    assert _found([(1, item)], "x y " + " ".join(words) + " z")
    assert _found([(1, item)], "x y " + " ".join(w for w in words if w != "=") + " z")


def test_blocks_of_equal_prints_and_other_words_are_no_seed():
    ix = L.build_index([(1, " ".join(f"q{i}x" for i in range(20)))])
    code = [ix["vocabulary"][f"q{i}x"] for i in (4, 3, 2, 1, 0)]
    right, *_ = L._sides([np.array(code, dtype=np.int32)], -4)
    assert not any(len(p) for _, p, _ in L.shared_blocks(ix, right["codes"]))


def test_very_long_text(spark):
    item = " ".join(f"k{i}v" for i in range(30))
    d = spark.createDataFrame([(1, "pad words here " * 40_000 + item)], "doc_id long, text string")
    assert [tuple(r) for r in L.leaks(d, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()] == [(1, 5, 30)]


def test_pieces_of_a_long_text_lose_nothing(spark, monkeypatch, cases):
    items, docs, want = cases
    monkeypatch.setattr(L, "CHARS", 3000)
    long = "\n".join(t for _, t in docs)
    cut = list(L.pieces(long, 50))
    assert len(cut) > 5 and set(long.split()) == {w for p in cut for w in p.split()}
    d, i = spark.createDataFrame([(1, long)], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {r.item_id for r in L.leaks(d, i).collect()} == {i for _, i in want}


def test_repetitive_text_in_small_blocks(spark, monkeypatch, cases):
    items, docs, want = cases
    monkeypatch.setattr(L, "SEEDS", 50)
    monkeypatch.setattr(L, "CHARS", 700)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in L.leaks(d, i).collect()} == want
    same = spark.createDataFrame([(1, "the same word again and " * 3000)], "doc_id long, text string")
    assert L.leaks(same, spark.createDataFrame([(1, "the same word again and " * 5), (2, "no such words in it at all")], "item_id long, text string")).count() == 1


def _found(items, doc):
    got = L.search(L.build_index(items), pd.DataFrame([(1, doc)], columns=["doc_id", "text"]))
    return list(zip(got["item_id"], got["words"], strict=True))


@pytest.mark.parametrize("kind", ["weight", "tokens", "repeats", "three of 24"])
def test_words_alone_decide(kind):
    words = [f"q{i}x" for i in range(40)]
    items = []
    if kind == "weight":  # the two that differ are the only rare ones
        words[10], words[16] = "rare", "seldom"
        items = [(i, " ".join(f"q{k}x" for k in range(40))) for i in range(2, 40)]
    elif kind == "tokens":  # two words of many tokens differ
        words[10], words[16] = "a.b.c.d.e.f.g.h", "i.j.k.l.m.n.o.p"
    elif kind == "repeats":  # the stretch's first word stands before it, too
        words[1] = words[5]
    cut = words[5:22] if kind != "three of 24" else words[5:29]
    for k in (5, 11) if kind not in ("repeats", "three of 24") else (1, 7) if kind == "repeats" else (8, 11, 14):
        cut[k] = f"zz{k}"
    assert (1, len(cut)) in _found([(1, " ".join(words)), *items], f"some text before . {' '.join(cut)} . and text behind")
