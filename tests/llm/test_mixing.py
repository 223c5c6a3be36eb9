"""Mixes: shares, caps, order of service, and the tokenizer's counts."""

from __future__ import annotations

import random

import pytest
from symbolake.llm import mixing as M


def test_plan():
    assert M.plan({"a": 100, "b": 100}, {"a": (0.5, 1), "b": (0.5, 1)}) == {"a": (1.0, 100.0), "b": (1.0, 100.0)}
    both = {"big": 900, "small": 100}, {"big": (0.5, 1), "small": (0.5, 3)}
    p = M.plan(*both, total=1000)
    assert p["small"] == (3.0, 300.0) and p["big"][1] == 700
    assert M.largest_total(*both) == 600 and M.plan(*both) == {"big": (300 / 900, 300.0), "small": (3.0, 300.0)}
    assert M.plan(*both, total=float("inf")) == {"big": (1.0, 900.0), "small": (3.0, 300.0)}
    assert M.plan({"a": 10}, {"a": (0.5, 0), "none": (0.5, 4)}) == {} and M.largest_total({}, {}) == 0
    p = M.plan({"a": 1000, "b": 1000, "c": 10}, {"a": (0.6, 2), "b": (0.3, 2), "c": (0.1, 1)}, total=500)
    assert p["c"][1] == 10 and abs(p["a"][1] / p["b"][1] - 2) < 1e-9 and abs(sum(v for _, v in p.values()) - 500) < 1e-9


@pytest.mark.parametrize("blocks", [{"a": 5, "b": 3, "c": 2}, dict(zip("abcdefgh", [40, 15, 10, 12, 3, 12, 5, 1], strict=True)), {"half": 500} | {f"s{i:02}": 10 for i in range(50)}, {"one": 7}, {}], ids=["3", "8", "51", "1", "0"])
def test_every_source_is_always_less_than_a_block_off(blocks):
    slots = M.pfair(blocks)
    total, done = sum(blocks.values()), dict.fromkeys(blocks, 0)
    assert sorted((s, i) for s, i, _ in slots) == sorted((s, i) for s, n in blocks.items() for i in range(n)) and [t for *_, t in slots] == list(range(total))
    for s, i, t in slots:
        assert done[s] == i and i * total // blocks[s] <= t < -(-(i + 1) * total // blocks[s])  # served between release and deadline
        done[s] += 1
        for x, n in blocks.items():
            assert abs(done[x] * total - n * (t + 1)) < total


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(8)
    docs = [(i, "word " * rng.randrange(20, 60), rng.choice(["big", "Big ", "BIG", "big"] * 5 + ["mid-dle", "middle", "middle", "other", None] * 3 + ["tiny"])) for i in range(1500)]
    docs += [(5000, None, "big"), (5001, "", "big"), (None, "x", "big"), (5002, "x" * 200_000, "other")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame([("big", 0.5, 1), ("middle", 0.3, 2), ("tiny", 0.15, 2), ("absent", 0.05, 4)], "source string, target_share double, max_repeats int")
    mix, report = M.mixture(d, t, block_tokens=200)
    return docs, mix, {r.source: r for r in report.collect()}


def test_caps_and_shares(mixed):
    docs, mix, report = mixed
    uses = {}
    for r in mix.collect():
        if r.from_token == 0:
            uses.setdefault((r.source, r.doc_id), []).append(r["pass"])
    caps = {"big": 1, "middle": 2, "tiny": 2}
    assert all(sorted(p) == list(range(1, len(p) + 1)) and len(p) <= caps[s] for (s, _), p in uses.items())
    assert report["absent"].actual_share == 0 and report["tiny"].most_repeats == 2
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-5
    goal = M.plan({s: report[s].source_tokens for s in caps}, {"big": (0.5, 1), "middle": (0.3, 2), "tiny": (0.15, 2)})
    for s, share in (("big", 0.5), ("middle", 0.3), ("tiny", 0.15)):
        assert 0 <= report[s].tokens - goal[s][1] <= 61  # one document
        assert abs(report[s].actual_share - share / 0.95) < 0.1


def test_parts_are_whole_documents_in_equal_blocks(mixed):
    docs, mix, report = mixed
    p = M.interleaved(mix).toPandas()
    assert (p.slot.diff().fillna(0) >= 0).all() and (p.to_token > p.from_token).all()
    size = (p.to_token - p.from_token).groupby([p.source, p.block]).sum()
    assert all((x[x.index[:-1]] == 200).all() and 0 < x.iloc[-1] <= 200 for x in (size[s] for s in size.index.levels[0]))
    assert (p.groupby("slot")[["source", "block"]].nunique() == 1).all().all()
    one = p.sort_values(["source", "doc_id", "pass", "from_token"]).groupby(["source", "doc_id", "pass"])
    assert (one.from_token.first() == 0).all() and (one.to_token.last() == (p.to_token - p.from_token).groupby([p.source, p.doc_id, p["pass"]]).sum()).all()
    assert {s: int(n) for s, n in (p.to_token - p.from_token).groupby(p.source).sum().items()} == {s: r.tokens for s, r in report.items() if r.tokens}


def test_a_large_mix_has_larger_blocks(spark):
    d = spark.createDataFrame([(i, "word " * 30, "ab"[i % 2]) for i in range(200)], "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    mix, _ = M.mixture(d, t, block_tokens=10, most_blocks=22)
    assert mix.selectExpr("max(slot)").first()[0] <= 21


def test_counts_are_the_tokenizers(spark):
    d = spark.createDataFrame([(1, "Hello world, hello!", "a"), (2, "<|endoftext|>", "a")], "doc_id long, text string, source string")
    enc = M._encoding(M.TOKENIZER)
    got = {r.doc_id: r.tokens for r in M.sized(d, d.select("source").distinct()).collect()}
    assert got == {1: len(enc.encode_ordinary("Hello world, hello!")), 2: len(enc.encode_ordinary("<|endoftext|>"))} and got[2] > 1
    assert enc.decode(enc.encode_ordinary("naïve \n\t x")) == "naïve \n\t x"


def test_nothing_to_mix(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    mix, report = M.mixture(d, t)
    assert mix.count() == 0 and report.first().tokens == 0
    mix, report = M.mixture(d, t.limit(0))
    assert mix.count() == 0 and report.count() == 0


def test_schedule_is_the_whole_mix_in_order(spark, data):
    from symbolake.llm import queries

    rows = queries.QUERIES["p8_schedule"](spark, data).collect()
    report = {r.source: r for r in queries.QUERIES["p8_mix"](spark, data).collect()}
    assert [r.slot for r in rows] == sorted(r.slot for r in rows)
    assert {s: sum(r.to_token - r.from_token for r in rows if r.source == s) for s in report} == {s: r.tokens for s, r in report.items()}
    assert {s: len({(r.doc_id, r["pass"]) for r in rows if r.source == s}) for s in report} == {s: r.uses for s, r in report.items()}
    assert rows and all(abs(r.actual_share - r.target_share / 0.97) < 0.06 for s, r in report.items() if r.source_tokens)
    whole = {r.source: r for r in queries.QUERIES["p8_whole"](spark, data).collect()}
    assert all(whole[s].tokens >= r.tokens for s, r in report.items())
