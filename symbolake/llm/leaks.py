"""Evaluation texts that leak into documents (problem 7).

A leak is a window of an item's size, LEAK_WORDS words, of which at most two differ (of longer ones, one word in ONE_IN).
A window's fingerprint is made of BLOCKS SimHashes, one for each run of PART words in it. Two words that differ touch
at most two of the three, so fingerprints within that radius share a block: the multi-index of the blocks finds all of
them, wherever words left out or put in have moved the block. From each shared block the passage is grown to both
sides, one differing word after another, which is exact: a passage with one word in ONE_IN differing is found, any
other is not. Everything is done on arrays of token codes, for all documents of a batch at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A leak is at least so many successive words of an item, of which at most one in ONE_IN differs.
LEAK_WORDS, ONE_IN = 17, 8
#: A leak of 34 words or more can be parted into two of which one is a leak too, so a passage of up to 33 words is enough to find it; so many of those may differ.
MOST = (2 * LEAK_WORDS - 1) // ONE_IN
#: Words of a block; windows of LEAK_WORDS words hold BLOCKS of them, one more than words may differ there.
PART, BLOCKS = 5, 3
#: Tokens of evaluation texts handled in one pass over the documents; more items take more passes.
PASS_TOKENS = 2_000_000
#: Pairs of places that are looked at together, and characters of texts; both bound a task's memory.
SEEDS, CHARS = 1_000_000, 8_000_000
_HIDDEN = dict.fromkeys([0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF])
_TAGS = re.compile(r"</?(?:b|i|u|s|p|q|em|br|li|ul|ol|code|span|strong|mark|del|ins|sup|sub|blockquote|pre|div)\s*/?>")
_TOKEN = re.compile(r"[^\W_]+| ")
_CUT = re.compile(r"\s(?![^<>]{0,20}>)")
#: Codes of what is no token of an item: other tokens, blanks, and the border between items.
OTHER, BLANK, PAD = -1, -3, -2


def tokens(text: str) -> list[str]:
    """Runs of letters and digits in lower case, without invisible characters and emphasis tags, and a blank between words."""
    t = text.lower()
    if not t.isascii():
        t = t.translate(_HIDDEN)
    if "<" in t:
        t = _TAGS.sub(" ", t)
    return _TOKEN.findall(" ".join(t.split()))


def simhash(h: np.ndarray, k: int) -> np.ndarray:
    """SimHash of each `k` neighbours of `h`, 1, 3 or 5: bit by bit, whether most of them have it."""
    a, b, c, d, e = (h[i : len(h) - k + 1 + i] for i in (*range(k), *[0] * (5 - k)))
    if k == 1:
        return a
    if k == 3:
        return (a & b) | (c & (a | b))
    s1, c1 = a ^ b ^ c, (a & b) | (c & (a | b))  # full adder
    s2, c2 = s1 ^ d ^ e, (s1 & d) | (e & (s1 | d))
    return (c1 & c2) | ((c1 | c2) & s2)


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges low..high: the number of the range and the place of each element."""
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def _side(codes: np.ndarray, word: np.ndarray, border: int) -> dict:
    """Of a row of texts: codes, number of the word, first place of the word, first place of the next, and whether words of marks follow.

    Every text has a border behind it, where reading stops; its number is that behind the text's last word.
    """
    n = len(codes)
    edge = codes == border
    first = np.ones(n, dtype=bool)
    first[1:] = (word[1:] != word[:-1]) | edge[1:] | edge[:-1]
    at = np.arange(n)
    follow = np.full(n, n - 1)
    follow[:-1] = np.minimum.accumulate(np.where(first, at, n - 1)[::-1])[::-1][1:]
    return {"codes": codes, "word": word, "own": np.maximum.accumulate(np.where(first, at, 0)), "next": np.where(edge, at, follow), "marks": ~edge & (word[follow] != word + 1)}


def _sides(parts: list[np.ndarray], border: int) -> tuple[dict, dict, np.ndarray, np.ndarray]:
    """Texts (codes with blanks) laid out in a row, read to the right and, mirrored, to the left; of each place the number of its text; the first place of each text."""
    codes, words, count = [], [], []
    for p in parts:
        blank = p == BLANK
        codes.append(p[~blank])
        words.append(np.cumsum(blank)[~blank])
        count.append(int(blank.sum()) + 1)
    size = np.array([len(c) for c in codes], dtype=np.int64)
    start = np.cumsum(size + 1) - size
    n, total = int((size + 1).sum()) + 1, int(size.sum())
    inside = np.repeat(start - np.cumsum(size) + size, size) + np.arange(total)
    flat, word, owner = np.full(n, border, dtype=np.int32), np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
    if total:
        flat[inside], word[inside], owner[inside] = np.concatenate(codes), np.concatenate(words), np.repeat(np.arange(len(parts)), size)
    behind, before = word, word.copy()
    behind[start + size] = count
    before[start - 1] = -1
    return _side(flat, behind, border), _side(flat[::-1].copy(), -before[::-1], border), owner, start


def _block_words(p: np.ndarray) -> int:
    """Words in a row that no passage of the item can do without: PART, or fewer where words of marks only stand among its words. 0: the item is too short to leak."""
    blank = p == BLANK
    holds = np.zeros(int(blank.sum()) + 1, dtype=np.int64)
    holds[np.cumsum(blank)[~blank]] = 1
    total = np.concatenate([[0], np.cumsum(holds)])
    least = PART
    for size in range(LEAK_WORDS, min(2 * LEAK_WORDS, len(holds) + 1)):
        differ = size // ONE_IN
        have = int((total[size:] - total[:-size]).min())
        least = min(least, -(-(have - differ) // (differ + 1)))
    return 0 if len(holds) < LEAK_WORDS else max(1, least)


def build_index(items: list[tuple]) -> dict:
    """Index of (id, text) items in plain arrays; items below LEAK_WORDS words can't leak and are left out."""
    vocabulary: dict = {" ": BLANK}
    ids, parts, need = [], [], []
    for i, text in items:
        p = np.array([vocabulary.setdefault(t, len(vocabulary)) for t in tokens(text)], dtype=np.int32)
        if (k := _block_words(p)) and (p != BLANK).any():
            ids.append(i)
            parts.append(p)
            need.append(5 if k >= 5 else 3 if k >= 3 else 1)
    hashes = np.array([xxhash.xxh64_intdigest(t) for t in vocabulary], dtype=np.uint64)
    right, left, owner, _ = _sides(parts, PAD)
    blocks = {}
    need = np.array(need, dtype=np.int64)
    for k in sorted(set(need.tolist())):
        flat = right["codes"]
        fp = simhash(hashes[np.maximum(flat, 0)], k) if len(flat) >= k else np.zeros(0, np.uint64)
        ok = need[owner[: len(fp)]] == k
        for j in range(k):
            ok &= flat[j : len(fp) + j] != PAD
        places = np.flatnonzero(ok)
        prints, inverse = np.unique(fp[places], return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        blocks[k] = (prints, np.searchsorted(inverse[order], np.arange(len(prints) + 1)), places[order])
    return {"ids": ids, "vocabulary": vocabulary, "hashes": hashes, "right": right, "left": left, "owner": owner, "blocks": blocks}


def shared_blocks(ix: dict, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, p, q): every block of k tokens that the documents hold at p and the items at q, by lookup of its SimHash; of blocks that overlap on a line the first."""
    for k, (prints, first, places) in ix["blocks"].items():
        full = codes[: len(codes) - k + 1] >= 0
        for j in range(1, k):
            full &= codes[j : len(codes) - k + 1 + j] >= 0
        at = np.flatnonzero(full)
        if not len(at) or not len(prints):
            continue
        fp = simhash(ix["hashes"][np.maximum(codes, 0)], k)[at]
        j = np.minimum(np.searchsorted(prints, fp), len(prints) - 1)
        hit = prints[j] == fp
        at, j = at[hit], j[hit]
        part = np.cumsum(first[j + 1] - first[j]) // SEEDS
        borders = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(at)]
        for x, y in zip(borders, borders[1:], strict=False):
            if x == y:
                continue
            w, place = _spread(first[j[x:y]], first[j[x:y] + 1])
            p, q = at[x:y][w], places[place]
            same = np.ones(len(p), dtype=bool)
            for d in range(k):
                same &= codes[p + d] == ix["right"]["codes"][q + d]
            p, q = p[same], q[same]
            o = np.lexsort((p, p - q))
            p, q = p[o], q[o]
            head = np.ones(len(p), dtype=bool)
            head[1:] = (np.diff(p - q) != 0) | (np.diff(p) != 1)
            yield k, p[head], q[head]


def _slide(a: dict, b: dict, i: np.ndarray, s: np.ndarray, last: np.ndarray) -> tuple:
    """From places i of the items and s of the documents on as far as they agree, by whole words of the items; `last` is the last word that does, one more if a word of marks follows on both sides."""
    at, to = i.copy(), s.copy()
    live = np.flatnonzero(a["codes"][at] == b["codes"][to])
    while len(live):
        at[live] += 1
        to[live] += 1
        live = live[a["codes"][at[live]] == b["codes"][to[live]]]
    back = at - a["own"][at]
    at, to = at - back, to - back
    moved = at > i
    end = np.where(moved, a["word"][at - 1] + (a["marks"][at - 1] & b["marks"][to - 1]), last)
    return at, to, end


class _Front:
    """How far each seed's passage reaches to one side, with 0, 1, 2, ... differing words."""

    def __init__(self, a: dict, b: dict, i: np.ndarray, s: np.ndarray):
        self.a, self.b, self.n = a, b, len(i)
        self.seed = np.arange(len(i))
        self.i, self.s, self.last = _slide(a, b, i, s, np.full(len(i), -(1 << 30)))
        self.sure, self.maybe = [self.last.copy()], [a["word"][self.i] - 1]

    def keep(self, which: np.ndarray) -> None:
        """Goes on with some of the seeds only."""
        at = np.full(self.n, -1)
        at[which] = np.arange(len(which))
        ok = at[self.seed] >= 0
        self.seed, self.i, self.s, self.last, self.n = at[self.seed[ok]], self.i[ok], self.s[ok], self.last[ok], len(which)
        self.sure, self.maybe = [x[which] for x in self.sure], [x[which] for x in self.maybe]

    def grow(self) -> None:
        """One more differing word: replaced, left out or put in."""
        a, b = self.a["next"], self.b["next"]
        i = np.concatenate([a[self.i], a[self.i], self.i])
        s = np.concatenate([b[self.s], self.s, b[self.s]])
        seed, last = np.tile(self.seed, 3), np.tile(self.last, 3)
        self.i, self.s, self.last = _slide(self.a, self.b, i, s, last)
        o = np.lexsort((-self.last, self.s, self.i, seed))
        self.i, self.s, self.last, self.seed = self.i[o], self.s[o], self.last[o], seed[o]
        new = np.ones(len(o), dtype=bool)
        new[1:] = (np.diff(self.seed) != 0) | (np.diff(self.i) != 0) | (np.diff(self.s) != 0)
        self.i, self.s, self.last, self.seed = self.i[new], self.s[new], self.last[new], self.seed[new]
        sure, maybe = self.sure[-1].copy(), self.maybe[-1].copy()
        np.maximum.at(sure, self.seed, self.last)
        np.maximum.at(maybe, self.seed, self.a["word"][self.i] - 1)
        self.sure.append(sure)
        self.maybe.append(maybe)


#: Words that agree around some block of every leak with so many differing words among them, at least: 17 words with two
#: differing are gaps of 15 words in all, and so on; a gap and its larger neighbour then have 8, three gaps in a row 11.
PAIR, TRIPLE = 8, 11


def passages(ix: dict, docs: tuple, p: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the blocks at p and q: which belong to a leak, and the words of the longest passage that proves it."""
    right, left = docs
    n, m = len(ix["right"]["codes"]), len(right["codes"])
    r = _Front(ix["right"], right, q, p)
    l = _Front(ix["left"], left, n - 1 - (q + k - 1), m - 1 - (p + k - 1))  # noqa: E741
    best, alive = np.zeros(len(q), dtype=np.int64), np.arange(len(q))
    for differ in range(MOST + 1):
        if differ:
            r.grow()
            l.grow()
        for x in range(differ + 1):
            size = (r.sure[x] + l.sure[differ - x] + 1).astype(np.int64)
            good = (size >= LEAK_WORDS) & (ONE_IN * differ <= size)
            best[alive[good]] = np.maximum(best[alive[good]], size[good])
        bound = PAIR if differ == 1 else TRIPLE if differ == 2 else 0
        reach = np.max([r.maybe[x] + l.maybe[differ - x] + 1 - differ for x in range(differ + 1)], axis=0)
        stay = np.flatnonzero(reach >= bound)
        if not len(stay):
            break
        if len(stay) < r.n:
            alive = alive[stay]
            r.keep(stay)
            l.keep(stay)
    hit = np.flatnonzero(best)
    return hit, best[hit]


def search(ix: dict, f: pd.DataFrame) -> pd.DataFrame:
    """The leaks of some documents (doc_id, text)."""
    get = ix["vocabulary"].get
    parts = [np.array([get(t, OTHER) for t in tokens(text)], dtype=np.int32) for text in f["text"]]
    right, left, owner, _ = _sides(parts, PAD - 2)
    found = []
    for k, p, q in shared_blocks(ix, right["codes"]):
        hit, words = passages(ix, (right, left), p, q, k)
        found.append(pd.DataFrame({"d": owner[p[hit]], "i": ix["owner"][q[hit]], "words": words}))
    if not found:
        return pd.DataFrame({"doc_id": [], "item_id": [], "words": []})
    g = pd.concat(found).groupby(["d", "i"], as_index=False)["words"].max()
    ids = f["doc_id"].to_numpy()
    return pd.DataFrame({"doc_id": ids[g["d"]], "item_id": [ix["ids"][i] for i in g["i"]], "words": g["words"]})


def widest(ix: dict) -> int:
    """Words of a document that hold any passage of up to 33 words of an item, however they are spaced."""
    inside = ix["right"]["codes"] != PAD
    key = ix["owner"][inside].astype(np.int64) * (1 << 31) + ix["right"]["word"][inside]
    return int((np.searchsorted(key, key + 2 * LEAK_WORDS) - np.arange(len(key))).max(initial=0)) + MOST


def pieces(text: str, overlap: int) -> Iterator[str]:
    """The text, if longer than CHARS cut between words into pieces, each with the last `overlap` words with a letter or digit of the one before."""
    tail, at = "", 0
    while at < len(text):
        cut = _CUT.search(text, at + CHARS) if at + CHARS < len(text) else None
        part = tail + text[at : cut.start() if cut else len(text)]
        yield part
        if not cut:
            return
        held = [m.start() for m in re.finditer(r"\S*[^\W_]\S*", part)]
        tail, at = part[held[-overlap] :] if len(held) >= overlap else part, cut.start()


def _find(index):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = index.value
        overlap = widest(ix)
        for frame in frames:
            rows, size = [], 0
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                for piece in pieces(text, overlap):
                    rows.append((doc, piece))
                    size += len(piece)
                    if size >= CHARS:
                        yield search(ix, pd.DataFrame(rows, columns=["doc_id", "text"]))
                        rows, size = [], 0
            if rows:
                yield search(ix, pd.DataFrame(rows, columns=["doc_id", "text"]))

    return run


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Problem 7: (doc_id, item_id, words) of every document holding at least LEAK_WORDS successive words of an item.

    Case, punctuation, spacing, invisible characters, line breaks and marks don't count; one word in eight may differ: be
    replaced, left out or put in. A passage begins and ends with a word that is there; words of marks only never differ.
    words: of the longest passage with at most MOST differing words. Null and blank texts, and items below LEAK_WORDS
    words, leak nothing. A repeated document or item id is reported once. The items are the stated query set: they are
    indexed in blocks of at most PASS_TOKENS tokens, a pass over the documents for each. Empty tables give no rows.
    """
    spark = documents.sparkSession
    rows = ((r[0], r[1]) for r in items.where("item_id is not null and text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator())
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    kind = documents.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    out = None
    for block in _blocks(rows):
        index = spark.sparkContext.broadcast(build_index(block))  # plain arrays: workers need no copy of this package
        part = docs.mapInPandas(_find(index), f"doc_id {kind[0]}, item_id {kind[1]}, words int")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"doc_id {kind[0]}, item_id {kind[1]}, words int")
    return out.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


def _blocks(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    block, size = [], 0
    for i, text in rows:
        block.append((i, text))
        size += len(text) // 3
        if size >= PASS_TOKENS:
            yield block
            block, size = [], 0
    if block:
        yield block
