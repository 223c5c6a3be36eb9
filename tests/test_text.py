"""Column functions against their rules in plain Python."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from symbolake.functions import text as X


def one(spark, *cols):
    r = spark.range(1).select(*cols).first()
    return tuple(r)


def camel(s):
    words, start = [], 0
    for i in range(1, len(s)):
        p, c = s[i - 1], s[i]
        if (p.islower() and c.isupper()) or (p.isupper() and c.isupper() and i + 1 < len(s) and s[i + 1].islower()) or p.isalpha() != c.isalpha():
            words.append(s[start:i])
            start = i
    return [w for w in [*words, s[start:]] if w]


def parts(s):
    out = [s.lower()]
    for seg in s.split("_"):
        for w in camel(seg):
            w = w.lower()
            if len(w.encode()) >= 2 and w not in out:
                out.append(w)
    return out


def test_split_identifier(spark):
    rng = random.Random(4)
    names = ["getHTTPResponse", "my_func", "", "_", "A1b2", "éÉtatÜ"] + ["".join(rng.choice("abzABZ019_éÉ") for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", X.split_identifier("n").alias("p")).collect()
    assert all(r.p == parts(r.n) for r in got)


def test_symbol_queries(spark):
    q = lambda s: X.is_symbol_query(F.lit(s))
    assert one(spark, q("my_func"), q("a::b"), q("getUser"), q("how do we create a migration"), q("x" * 30)) == (True, True, True, False, False)


def test_keywords_and_lexical(spark):
    k = X.query_keywords(F.lit("How does the getUser_by name work in A"))
    assert one(spark, k) == (["getuser_by", "name", "user", "work"],)
    score = lambda ks, n: X.lexical_score(F.array(*map(F.lit, ks)), F.lit(n), F.lit(""))
    assert one(spark, score(["create", "user"], "create_user"), score(["migr", "xyz"], "run_migration")) == (1.0, 0.5)
    assert one(spark, X.lexical_score(F.array().cast("array<string>"), F.lit("a"), F.lit("b"))) == (0.0,)


def test_penalty_casing_core(spark):
    p = lambda s: X.path_penalty(F.lit(s))
    assert one(spark, p("a/tests/x.py"), p("src/latest_run.py"), p("pkg/__init__.py"), p("x.d.ts"), p("src/app.py")) == (0.3, 0.3, 0.5, 0.7, 1.0)
    c = lambda s: X.casing(F.lit(s))
    assert one(spark, c("MAX_SIZE"), c("a_b"), c("FooBar"), c("fooBar"), c("__"), c("plain"), c("_1")) == ("SCREAMING_SNAKE", "snake_case", "PascalCase", "camelCase", "other", "snake_case", "snake_case")
    d = lambda s: X.descriptor_core(F.lit(s))
    assert one(spark, d("a/b()."), d("a/B#"), d("a/b"), X.provisional_call(F.lit("?/f()")), X.provisional_call(F.lit("a/f()."))) == ("a/b", "a/B", "a/b", "f", None)


def test_ids(spark):
    i = X.symbol_id(F.lit("s"), F.lit("npm"), F.lit("p"), F.lit("1"), F.lit("a b"))
    assert one(spark, i) == ("s npm p 1 a b",)
    assert tuple(one(spark, X.parse_symbol_id(F.lit("s . p")))[0]) == ("s", ".", "p", ".", ".")
    assert one(spark, X.is_package_managed(F.lit("npm")), X.is_package_managed(F.lit("."))) == (True, False)
    assert one(spark, X.module_path(F.lit("a/b.c.py")), X.module_path(F.lit("a/__init__.py")), X.detect_language(F.lit("x.TSX")), X.detect_language(F.lit("x.go"))) == ("a/b.c", "a", "TypeScript", None)


def test_replies(spark):
    s = lambda t: X.summary_reply(F.lit(t))
    a, b, c = one(spark, s("SUMMARY: one\nQUERIES: a | b ||c"), s("\n free text \nmore"), s("SUMMARY: x\nSUMMARY: y"))
    assert (a.summary, a.queries, b.summary, b.queries, c.summary) == ("one", ["a", "b", "c"], "free text", [], "y")
    n, m = one(spark, X.narration_reply(F.lit("NARRATION: it\nruns QUERIES: q1|q2")), X.narration_reply(F.lit(" just text ")))
    assert (n.narration, n.queries, m.narration, m.queries) == ("it\nruns", ["q1", "q2"], "just text", [])


def test_small_helpers(spark):
    assert one(spark, X.truncate(F.lit("ßßß"), 2), X.truncate(F.lit("ab"), 2), X.truncate(F.lit("ab"), 0), X.short_sha(F.lit("0123456789")), X.compact_number(F.lit(1234)), X.compact_number(F.lit(7)), X.edge_label(F.lit("ParticipatesIn"))) == ("ßß…", "ab", "…", "01234567", "1.2k", "7", "participates_in")
