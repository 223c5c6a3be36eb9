"""Reading level of English prose documents (problem 9).

A regularised ordinal regression (proportional odds) over length, lexical diversity, word rarity, connectives and clause
depth, calibrated to graded text: the passages of `graded_texts`, written to school grades. No readability formula takes
part. Word counts for rarity cover all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolake.llm.graded_texts import PASSAGES

#: Documents are given a level from so many words outside code fences on.
MIN_WORDS = 40
#: So many of the most frequent words are told apart by their counts, which bounds what is broadcast; all others are equally rare.
KNOWN_WORDS = 200_000
#: Distinct words a task holds before it sends their counts on.
HELD_WORDS = 500_000
#: US school grades up to which a band goes; none lies between the bands.
BANDS = ("basic", "middle", "expert")
EDGES = (6.0, 13.0)
#: Of the average word: length of its sentence, its own length, share of different words in windows of SPAN, bits of rarity, share of connectives; and marks of clauses a sentence.
FEATURES = ("sentence_words", "word_chars", "diversity", "rarity", "connectives", "clauses")
SPAN = 40

# Frequent function words by language.
_STOPS = {
    "en": "the of and to in is that it for on with as are be this by at from or an not its was which when then each has you we they their while also but never until because if one do can what".split(),
    "de": "der die das und ist nicht ein eine einen den dem des zu mit auf für von wird werden sich auch bei nach oder wenn jede jeden jeder ohne vor im am als aus wie".split(),
    "fr": "le la les de des du et un une est dans que qui pour sur avec par ne pas ce cette chaque sans avant au aux sont plus ou se son sa toutes tous".split(),
    "es": "el la los las de del y un una es en que por para con no se su al lo cada sin antes durante o como más este esta todas todos".split(),
}
# English connectives and subordinators.
_CONNECTIVES = frozenset(
    "because although though while whereas since unless until when whenever if once after before therefore however moreover furthermore consequently thus hence nevertheless notwithstanding irrespective insofar particularly where which whose that yet but so then also".split()
)
_FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)")
_TAG = re.compile(r"<[^<>\n]{1,60}>")
_INLINE = re.compile(r"`[^`\n]*`")
_HEAD = re.compile(r"(?m)^[ \t]*#{1,6}[ \t].*$")
_ITEM = re.compile(r"(?m)^[ \t]*(?:[-*+>]|\d+[.)])[ \t]+")
_SHORT = re.compile(r"\b(?:e\.g|i\.e|max|min|vs|cf|etc|approx|no|fig|dr|mr|mrs|z\.B|resp)\.", re.I)
_END = re.compile(r"[.!?]+(?=[\s\"')\]]|$)|\n\s*\n|\x00")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def prose(text: str) -> str:
    """The text outside code fences."""
    t = text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")
    return _FENCE.sub(" ", t) if "```" in t or "~~~" in t else t


def sentences(text: str) -> list[list[str]]:
    """Lower-case words of each sentence of prose; list items are sentences, headings and inline code are left out."""
    t = _INLINE.sub(" ", _TAG.sub(" ", _HEAD.sub("\n\n", text)))
    t = _SHORT.sub(" ", _ITEM.sub("\x00", t))
    parts = (_WORD.findall(p.lower()) for p in _END.split(t))
    return [p for p in parts if p]


def language(words: list[str]) -> str:
    """The language whose function words are the most, `''` if fewer than one word in twenty is any's."""
    have = Counter(words)
    score = {k: sum(have[w] for w in ws) for k, ws in _STOPS.items()}
    best = max(score, key=score.get)
    return best if score[best] * 20 >= max(1, len(words)) else ""


def features(text: str, sents: list[list[str]], bits: dict, rare: float) -> list[float]:
    """The FEATURES of a document; `bits` of the frequent words, `rare` of all others."""
    words = [w for s in sents for w in s]
    n = len(words)
    windows = [words[i : i + SPAN] for i in range(0, max(1, n - SPAN + 1), SPAN)]
    joins = sum(map(_CONNECTIVES.__contains__, words))
    return [
        n / len(sents), sum(map(len, words)) / n, sum(len(set(w)) / len(w) for w in windows) / len(windows), sum(bits.get(w, rare) for w in words) / n,
        joins / n, (text.count(",") + text.count(";") + joins) / len(sents),
    ]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    have: Counter = Counter()
    out = lambda: pa.RecordBatch.from_arrays([pa.array(have.keys(), pa.string()), pa.array(have.values(), pa.int64())], names=["word", "n"])
    for b in batches:
        for text in b.column(0).to_pylist():
            have.update(_WORD.findall(prose(text).lower()))
            if len(have) >= HELD_WORDS:
                yield out()
                have.clear()
    yield out()


def word_bits(docs: DataFrame) -> tuple[dict, float]:
    """Bits of each of the KNOWN_WORDS most frequent words, and of any other, from counts over all of `docs` and the graded passages."""
    here = Counter(w for _, text in PASSAGES for w in _WORD.findall(text.lower()))
    counts = docs.select("text").mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(KNOWN_WORDS).toArrow()
    n = Counter(dict(zip(top.column("word").to_pylist(), top.column("n").to_pylist(), strict=True)))
    n.update(here)
    total = sum(n.values())
    least = min(n.values()) if len(n) > KNOWN_WORDS else 1
    return {w: float(np.log2(total / c)) for w, c in n.items()}, float(np.log2(total / least))


def _featurise(words):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, rare = words.value
        for f in frames:
            rows = []
            for doc, text in zip(f["doc_id"], f["text"], strict=True):
                body = prose(text)
                if sum(1 for w in body.split() if any(map(str.isalnum, w))) < MIN_WORDS:
                    continue
                sents = sentences(body)
                said = [w for s in sents for w in s]
                if len(said) >= MIN_WORDS // 2 and language(said) == "en":
                    rows.append((doc, *features(body, sents, bits, rare)))
            yield pd.DataFrame(rows, columns=["doc_id", *FEATURES])

    return run


def fit_ordinal(x: np.ndarray, level: np.ndarray, ridge: float = 1e-3, steps: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cut points (one less than levels, rising) of a proportional-odds model on standardised `x`, by gradient steps of adapted size on its ridge-penalised likelihood. `level`: 0, 1, 2, ..., each at least once."""
    (n, k), cuts = x.shape, int(level.max())
    w, cut = np.zeros(k), np.linspace(-1.0, 1.0, cuts)
    m, v = np.zeros(k + cuts), np.zeros(k + cuts)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    for t in range(1, steps + 1):
        z, edge = x @ w, np.concatenate([[-np.inf], np.sort(cut), [np.inf]])
        fu, fl = sig(edge[level + 1] - z), sig(edge[level] - z)
        p = np.maximum(fu - fl, 1e-12)
        du, dl = fu * (1 - fu) / p, fl * (1 - fl) / p
        of_cut = (np.bincount(level, weights=du, minlength=cuts + 1)[:cuts] - np.bincount(level, weights=dl, minlength=cuts + 1)[1:]) / n
        g = np.concatenate([x.T @ (dl - du) / n - ridge * w, of_cut])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, cut = w + step[:k], np.sort(cut) + step[k:]
    return w, np.sort(cut)


def _cases(documents: DataFrame) -> DataFrame:
    return documents.where("doc_id is not null and text is not null and file_path is null").select("doc_id", "text")


def fit(bits: dict, rare: float, use: tuple = FEATURES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights, cuts between the bands) calibrated on the graded passages, each grade a level; features not in `use` get no weight."""
    x = np.array([features(text, sentences(text), bits, rare) for _, text in PASSAGES])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    grades, level = np.unique([g for g, _ in PASSAGES], return_inverse=True)
    w, cut = fit_ordinal((x - mean) / scale * [f in use for f in FEATURES], level)
    return mean, scale, w, cut[np.searchsorted(grades, EDGES) - 1]


def band_column(model: tuple) -> Column:
    """The band by the model as an expression over the FEATURES."""
    mean, scale, w, cut = model
    z = F.lit(0.0)
    for c, m, s, a in zip(FEATURES, mean, scale, w, strict=True):
        z = z + (F.col(c) - F.lit(float(m))) * F.lit(float(a / s))
    return F.when(z <= float(cut[0]), BANDS[0]).when(z <= float(cut[1]), BANDS[1]).otherwise(BANDS[2])


def reading_levels(documents: DataFrame) -> DataFrame:
    """Problem 9: (doc_id, band, and the FEATURES) of every English prose document without file_path.

    Documents with null id or text, below MIN_WORDS words outside code fences, or in another language give no row; a
    repeated document gives one row each time. An empty table gives no rows.
    """
    cases = _cases(documents)
    bits, rare = word_bits(cases)
    words = documents.sparkSession.sparkContext.broadcast((bits, rare))
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{c} double' for c in FEATURES)}"
    return cases.mapInPandas(_featurise(words), schema).withColumn("band", band_column(fit(bits, rare))).select("doc_id", "band", *FEATURES)
