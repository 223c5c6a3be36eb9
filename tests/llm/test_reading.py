"""Reading levels: parts, fit, and accuracy on documents that took no part in the fit."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from symbolake.llm import reading as R
from symbolake.llm.graded_texts import PASSAGES

sys.path.insert(0, str(Path(__file__).parent))
import flesch  # noqa: E402


def test_parts():
    assert R.prose("a\n```\ncode\n```\nb\n~~~ x\ncode").split() == ["a", "b"]
    s = R.sentences("# Head\n\nThe cat sat, e.g. here. It ran!\n- one item\n- `code()` two\n\nlast part")
    assert s == [["the", "cat", "sat", "here"], ["it", "ran"], ["one", "item"], ["two"], ["last", "part"]]
    assert R.language("the cat is on the mat".split()) == "en" and R.language("die katze ist auf der matte".split()) == "de"
    assert R.language("le chat est sur la table".split()) == "fr" and R.language("el gato es de la casa".split()) == "es" and R.language(["zzz"]) == ""


def test_ordinal_fit_on_a_known_model():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 3))
    z = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=1500) * 0.3
    band = np.digitize(z, [-1.0, 1.5])
    w, cut = R.fit_ordinal(x, band)
    assert (np.digitize(x @ w, cut) == band).mean() > 0.88 and cut[0] < cut[1] and abs(w[2]) < 0.2 * abs(w[0])
    many = np.digitize(z, [-3.0, -2.0, -1.0, 0.0, 1.0, 2.0, 3.0])
    w, cut = R.fit_ordinal(x, many)
    assert (np.abs(np.digitize(x @ w, cut) - many) <= 1).mean() > 0.95 and (np.diff(cut) >= 0).all()


EASY = "The cat sat on the mat. It ran to the box. We like the big red ball. "
HARD = "Notwithstanding the methodological generalization, multidimensional implementation substantiates considerable interoperability, particularly where heterogeneous representations presuppose architectural normalization of the configuration. "


def test_edges(spark):
    mid = "When the worker holds a cached record, it updates the router and then moves it to the queue. "
    docs = [(i, t * 6, None, "x") for i, t in enumerate([EASY, mid, HARD] * 12)]
    docs += [(100, "The cat sat.", None, "x"), (101, None, None, "x"), (102, EASY * 6, "a.py", "x"), (103, "Die Katze ist auf der Matte und der Hund ist im Haus. " * 8, None, "x"), (None, EASY * 6, None, "x"), (104, "```\n" + EASY * 6 + "\n```", None, "x"), (105, "", None, "x"), (0, EASY * 6, None, "x"), (106, EASY * 4000, None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, file_path string, band string")
    got = [(r.doc_id, r.band) for r in R.reading_levels(df).collect()]
    assert dict(got) == {**{i: R.BANDS[i % 3] for i in range(36)}, 106: "basic"} and len(got) == 38
    assert R.reading_levels(df.limit(0)).count() == 0


def test_held_out_passages():
    """Each graded passage by a model of all others."""
    words = Counter(w for _, t in PASSAGES for w in t.lower().split())
    bits, rare = {w: float(np.log2(words.total() / n)) for w, n in words.items()}, float(np.log2(words.total()))
    x = np.array([R.features(t, R.sentences(t), bits, rare) for _, t in PASSAGES])
    grades = np.array([g for g, _ in PASSAGES])
    wrong = 0
    for i in range(len(x)):
        others = np.arange(len(x)) != i
        mean, scale = x[others].mean(axis=0), x[others].std(axis=0)
        levels, level = np.unique(grades[others], return_inverse=True)
        w, cut = R.fit_ordinal((x[others] - mean) / scale, level, steps=1500)
        wrong += np.digitize((x[i] - mean) / scale @ w, cut[np.searchsorted(levels, R.EDGES) - 1]) != np.digitize(grades[i], R.EDGES)
    assert wrong <= 1


def test_agrees_with_a_formula_it_does_not_use(spark, data):
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.where("file_path is null and text is not null").collect()}
    got = {r.doc_id: r.band for r in R.reading_levels(docs).collect()}
    right = sum(R.BANDS[int(np.digitize(flesch.grade(R.sentences(R.prose(text[i]))), R.EDGES))] == b for i, b in got.items())
    assert len(got) > 300 and right / len(got) >= 0.98


def test_rare_words_are_equally_rare(spark, monkeypatch):
    docs = spark.createDataFrame([("aa " * 50 + "bb " * 40 + "cc dd",)], "text string")
    bits, rare = R.word_bits(docs)
    assert bits["aa"] < bits["bb"] < bits["cc"] == bits["dd"] <= rare
    monkeypatch.setattr(R, "KNOWN_WORDS", 2)
    monkeypatch.setattr(R, "HELD_WORDS", 2)
    few, _ = R.word_bits(docs)
    assert "cc" not in few and few["aa"] < few["bb"]


@pytest.mark.parametrize("words", [["the"], ["the"] * 200])
def test_features_are_finite(words):
    assert all(np.isfinite(R.features(" ".join(words), [words], {}, 9.0)))
