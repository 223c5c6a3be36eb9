"""Generated, minified, vendored and data files among source files (problem 3).

Signals, each from statistics of the corpus itself; no list of phrases takes part:

* minified: character trigram models of identifiers, one per language; names mangled by a tool have a high
  cross-entropy under the model of their language;
* generated: the names of a file's functions follow a template, so their first words have almost no diversity and
  every class repeats the same ones;
* vendored: the file's definitions occur again in another repository that is not its fork, or the file begins or ends
  with a release number beside a name foreign to the corpus: one of high cross-entropy under the model of all identifiers;
* data: nearly all of the file's tokens, by their characters, are literals, and those mostly digits or hash characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

FILE = ["repo", "file_path"]
#: Classes of characters: a-z 1-26, digits 27, underscore and $ 28, others 29, name border 0.
_CLASS = np.full(256, 29, dtype=np.int64)
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CLASS[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_CLASS[ord("0") : ord("9") + 1] = 27
_CLASS[[ord("_"), ord("$")]] = 28
_CLASS[0] = 0
CODES = 32 * 32 * 32
#: The languages with the most names have a model each, all others share one; this bounds the broadcast (65 x 32768 numbers).
MODELS = 63
#: Shortest name the models are fitted on; mangled names must not teach them.
FIT_LENGTH = 4
#: A file is minified if its names, at least MIN_NAMES, need more bits a character than this on average.
MANGLED_BITS, MIN_NAMES = 6.0, 8
#: A file is generated if so many functions in several classes share so few first words.
TEMPLATE_FUNCTIONS, TEMPLATE_WORDS, TEMPLATE_CLASSES = 6, 3, 2
#: A file is vendored if this share of its runs of two definitions occurs in another repository.
COPIED_SHARE = 0.5
#: Lines of a file whose definitions one window task orders.
RUN_LINES = 100_000
#: Definitions shared with other repositories say nothing in a repository of which this share of the files is shared: it is a fork.
FORK_SHARE = 0.8
#: A name is foreign if it needs more bits a character than this under the model of all identifiers.
FOREIGN_BITS = 4.0
#: A file is data if this share of its tokens' characters is literals, with this share of digits or hash characters in them, and so many literals.
DATA_SHARE, DATA_DIGITS, DATA_LITERALS = 0.8, 0.25, 20
#: A file without document is data if it has so many lines outside definitions; imports and small tables take fewer.
UNREAD_LINES = 32


def _trigrams(names: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The trigram codes of all names, and for each the index of its name."""
    raw = [b"\0\0" + n.encode("latin-1", "replace") + b"\0" for n in names]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = _CLASS[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    codes = c[:-2] * 1024 + c[1:-1] * 32 + c[2:]
    owner = np.repeat(np.arange(len(raw)), sizes)
    inside = owner[:-2] == owner[2:]
    return codes[inside], owner[:-2][inside]


def _slots(languages: pd.Series, slot: dict) -> np.ndarray:
    """The number of each row's model."""
    known = {x: slot.get((x or "").lower(), len(slot)) for x in languages.unique()}
    return languages.map(known).to_numpy(dtype=np.int64)


def _count_trigrams(slot: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(slot) + 1) * CODES, dtype=np.int64)
        for b in batches:
            f = b.to_pandas()
            codes, owner = _trigrams(f["name"])
            total += np.bincount(_slots(f["language"], slot)[owner] * CODES + codes, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["code", "n"])

    return run


def identifier_models(names: DataFrame) -> tuple[dict, np.ndarray]:
    """The models' numbers by language, and for each model bits of each trigram given its first two characters; the last but one is of all other languages, the last of all together (`names`: name, language; distinct)."""
    most = names.where("language is not null").groupBy(F.lower("language").alias("x")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "x").limit(MODELS).collect()
    slot = {r.x: i for i, r in enumerate(most)}
    counts = names.where(F.length("name") >= FIT_LENGTH).mapInArrow(_count_trigrams(slot), "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((len(slot) + 1) * CODES)
    n[np.asarray(counts.column("code"))] = np.asarray(counts.column("n"))
    n = n.reshape(len(slot) + 1, CODES)
    n = np.concatenate([n, n.sum(axis=0, keepdims=True)]).reshape(-1, 32) + 0.05
    return slot, -np.log2(n / n.sum(axis=1, keepdims=True)).reshape(len(slot) + 2, CODES).astype(np.float32)


def cross_entropy(model: np.ndarray, names: pd.Series, which: np.ndarray) -> pd.Series:
    """Bits per character of each name under its model."""
    codes, owner = _trigrams(names)
    size = np.bincount(owner, minlength=len(names))
    return pd.Series(np.bincount(owner, weights=model[which[owner], codes], minlength=len(names)) / np.maximum(size, 1), index=names.index)


_RELEASE = re.compile(r"(?<![\w.])v?\d+\.\d+\.\d+(?!\w|\.\d)")
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_-]{3,}")
_CONSTANT = re.compile(r"(?m)^[ \t]*(?:(?:const|let|var|export)\s+)*[\w.$]+\s*=\s*[\"']([A-Za-z][\w-]{3,})[\"'][ \t]*;?[ \t]*$")
# Words that go with any release number.
_ANY_RELEASE = frozenset("version release released since exports module".split())
_TOKENS = re.compile(
    r"""(?P<com>/\*.*?\*/|//[^\n]*|\#[^\n]*|\"\"\".*?\"\"\"|'''.*?''')|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)"""
    r"""|(?P<num>-?\b\d[\w.]*)|(?P<word>[A-Za-z_$][\w$]*)|(?P<sep>[,\[\]{}():;])|(?P<op>\S)""",
    re.S,
)
_DENSE = re.compile(r"\d+(?:\.\d+)?|[0-9a-fA-F]{6,}|[A-Za-z0-9+/=]{40,}")
_CODE_LINE = re.compile(r"\s*(?:@|(?:(?:export|default|async|abstract|declare)\s+)*(?:def|class|function|interface)\b)")
_NOTE = re.compile(r"\s*(?:#|//|/\*|\*|--|<!--|\Z)|.*(?:\*/|-->)\s*\Z")


def frame(text: str) -> str:
    """What a file begins with, up to its first definition, and the comments it ends with."""
    lines = text.lstrip("\ufeff").replace("\r\n", "\n").split("\n")
    first = next((i for i, line in enumerate(lines) if _CODE_LINE.match(line)), len(lines))
    last = len(lines)
    while last > first and _NOTE.match(lines[last - 1]):
        last -= 1
    return "\n".join(lines[:first] + lines[last:])


def release_names(text: str, own: str) -> list[str]:
    """Names on the lines of a file's frame that have a release number, and those its constants have as values if there is one; without the parts of `own`."""
    head = frame(text)
    if not _RELEASE.search(head):
        return []
    names = [n for line in head.split("\n") if _RELEASE.search(line) for n in _NAME.findall(_RELEASE.sub(" ", line))] + _CONSTANT.findall(head)
    mine = _ANY_RELEASE | {p for p in re.split(r"[\W_]+", own.lower())} | {own.lower()}
    return sorted({n for n in names if n.lower().strip("_-") not in mine})


def literal_share(text: str) -> tuple[float, float, int]:
    """Of a file: share of literals in its tokens' characters (comments and brackets apart), share of digits and hash characters in those, number of literals."""
    literal = other = dense = count = 0
    for m in _TOKENS.finditer(text):
        kind, size = m.lastgroup, m.end() - m.start()
        if kind in ("str", "num"):
            literal += size
            count += 1
            dense += size if kind == "num" else sum(len(v) for v in _DENSE.findall(m[0]))
        elif kind in ("word", "op"):
            other += size
    return literal / max(literal + other, 1), dense / max(literal, 1), count


_TEXT = "repo string, file_path string, foreign boolean, packed boolean, data boolean"


def _read_texts(models):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = models.value[1]
        for f in frames:
            rows = []
            for repo, path, text in zip(f["repo"], f["file_path"], f["text"], strict=True):
                share, digits, count = literal_share(text)
                longest = max(map(len, text.split("\n")), default=0)
                packed = longest >= 500 and len(re.findall(r"\s", text)) < 0.08 * len(text) and share < DATA_SHARE
                names = pd.Series(release_names(text, repo), dtype=object)
                foreign = len(names) > 0 and bool((cross_entropy(model, names, np.full(len(names), len(model) - 1)) > FOREIGN_BITS).any())
                rows.append((repo, path, foreign, packed, share >= DATA_SHARE and digits >= DATA_DIGITS and count >= DATA_LITERALS))
            yield pd.DataFrame(rows, columns=[*FILE, "foreign", "packed", "data"])

    return run


def text_signals(documents: DataFrame, models) -> DataFrame:
    """Per file with a document: a foreign release in its frame, packed lines, data; `models`: the broadcast identifier models."""
    src = documents.where("repo is not null and file_path is not null and text is not null").select(*FILE, "text")
    return src.mapInPandas(_read_texts(models), _TEXT).groupBy(*FILE).agg(*(F.max(c).alias(c) for c in ("foreign", "packed", "data")))


def definitions(symbols: DataFrame) -> DataFrame:
    """Names of definitions by file; distinct."""
    return symbols.where(F.col("kind") != "File").select(*FILE, "language", "kind", "name", "descriptor").where("name is not null").distinct()


def name_signals(defs: DataFrame, models) -> DataFrame:
    """Per file: mean cross-entropy of its names, diversity of its functions' first words; `models`: the broadcast identifier models."""

    @F.pandas_udf(T.DoubleType())
    def bits(names: pd.Series, languages: pd.Series) -> pd.Series:
        slot, model = models.value
        return cross_entropy(model, names, _slots(languages, slot))

    entropy = defs.withColumn("bits", bits("name", "language")).groupBy(*FILE).agg(F.avg("bits").alias("bits"), F.count(F.lit(1)).alias("names"))
    word = F.lower(F.regexp_extract("name", r"^_*([A-Z]?[a-z]+|[A-Z]+(?![a-z])|.)", 1))
    owner = F.regexp_replace("descriptor", r"/[^/]*$", "")
    fn = defs.where(F.col("kind").isin("Function", "Method")).select(*FILE, owner.alias("owner"), word.alias("word"))
    # Sums of hashes stand for the sets of words, so no set is gathered: equal sums, equal words.
    per_word = fn.groupBy(*FILE, "owner", "word").agg(F.count(F.lit(1)).alias("n"))
    per_owner = per_word.groupBy(*FILE, "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"), F.bit_xor(F.xxhash64("word")).alias("which"))
    template = per_owner.groupBy(*FILE).agg(
        F.sum("n").alias("functions"), F.max("words").alias("words"), F.count(F.lit(1)).alias("owners"), (F.min("which") == F.max("which")).alias("same")
    )
    return entropy.join(template, FILE, "full")


def copied_share(symbols: DataFrame) -> DataFrame:
    """Per file with at least two definitions: the share of its runs of two that another repository has too.

    Runs end at every RUN_LINES lines, so a file of any length is ordered in pieces.
    """
    sig = F.xxhash64("name", F.coalesce("signature", F.lit("")))
    rows = symbols.where((F.col("kind") != "File") & F.col("repo").isNotNull() & F.col("file_path").isNotNull())
    newest = rows.groupBy(*FILE, "descriptor").agg(F.max_by(F.struct("line_start", sig.alias("sig")), "ordinal").alias("s"))
    order = Window.partitionBy(*FILE, F.floor(F.col("s.line_start") / RUN_LINES)).orderBy("s.line_start", "descriptor")
    run = newest.select(*FILE, F.xxhash64(F.col("s.sig"), F.lead("s.sig").over(order)).alias("run"), F.lead("s.sig").over(order).alias("next")).where("next is not null").select(*FILE, "run").distinct()
    where = run.groupBy("run").agg(F.min("repo").alias("a"), F.max("repo").alias("b"))
    shared = where.where("a != b").select("run", F.lit(1).alias("shared"))
    per_file = run.join(shared, "run", "left").groupBy(*FILE).agg(F.avg(F.coalesce("shared", F.lit(0))).alias("copied"))
    forks = per_file.groupBy("repo").agg(F.avg((F.col("copied") >= COPIED_SHARE).cast("int")).alias("all")).where(F.col("all") >= FORK_SHARE).select("repo")
    return per_file.join(forks, "repo", "left_anti")


def bare_lines(symbols: DataFrame) -> DataFrame:
    """Per file, by its newest File row: lines, and lines inside outermost definitions (at most all)."""
    end = symbols.where(F.col("kind") == "File").groupBy(*FILE).agg(F.max_by("line_end", "ordinal").alias("lines"))
    depth = F.size(F.split("descriptor", "/")) - F.size(F.split("file_path", "/"))
    top = symbols.where((F.col("kind") != "File") & (depth <= 1)).groupBy(*FILE, "descriptor").agg(F.max_by(F.col("line_end") - F.col("line_start") + 1, "ordinal").alias("n"))
    return end.join(top.groupBy(*FILE).agg(F.sum("n").alias("inside")), FILE, "left").select(*FILE, "lines", F.coalesce("inside", F.lit(0)).alias("inside"))


def machine_files(symbols: DataFrame, documents: DataFrame) -> DataFrame:
    """Problem 3: (repo, file_path, reason) of the files in `symbols` that are not hand-written source.

    reason: minified, generated, vendored or data, the first that holds. Files without document are judged by their
    symbols alone. Rows with null repo or path name no file. Empty tables give no rows.
    """
    sym = symbols.where("repo is not null and file_path is not null")
    files, defs = sym.select(*FILE).distinct(), definitions(sym)
    models = symbols.sparkSession.sparkContext.broadcast(identifier_models(defs.select("name", "language").distinct()))
    all_ = files.join(name_signals(defs, models), FILE, "left").join(copied_share(sym), FILE, "left").join(bare_lines(sym), FILE, "left")
    all_ = all_.join(text_signals(documents, models).withColumn("read", F.lit(True)), FILE, "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    minified = (F.col("bits") > MANGLED_BITS) & (F.col("names") >= MIN_NAMES)
    template = (F.col("functions") >= TEMPLATE_FUNCTIONS) & (F.col("words") <= TEMPLATE_WORDS) & (F.col("owners") >= TEMPLATE_CLASSES) & F.col("same")
    unread = F.col("read").isNull() & (F.col("lines") - F.col("inside") >= UNREAD_LINES) & (F.col("inside") <= (1 - DATA_SHARE) * F.col("lines"))
    reason = (
        F.when(yes(minified) | yes(F.col("packed")), "minified")
        .when(yes(template), "generated")
        .when(yes(F.col("copied") >= COPIED_SHARE) | yes(F.col("foreign")), "vendored")
        .when(yes(F.col("data")) | yes(unread), "data")
    )
    return all_.withColumn("reason", reason).where("reason is not null").select(*FILE, "reason")
