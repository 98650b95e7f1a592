"""Patterns: the dialect, its translations, ambiguity, literals; rules of users' own in the plans."""

import random
import time

import pytest
import regex
from pyspark.sql import functions as F

from haetae import patterns as p
from haetae import plain
from haetae import rules as catalog
from haetae.operators.detect import detect
from haetae.operators.mask import mask_text

#: (pattern, texts that it matches whole, texts that it does not)
DIALECT = [
    (r"\*+\d{4}", ["*1234", "***1234"], ["1234", "*123"]),
    (r"[*+]\d{4}", ["*1234", "+1234"], ["a1234"]),
    (r"\p{Hangul}{2,4}동", ["역삼동", "대치일이동"], ["a동", "동"]),
    (r"[\p{L}]+\d{3}", ["aé가123"], ["123", "_123"]),
    (r"\pL\PN", ["ab", "é "], ["a1", "1a"]),
    (r"\p{Lu}\p{Letter}\p{gc=Nd}\p{Script=Greek}\p{^Greek}", ["Aa1αa"], ["aa1αa", "Aa1αα"]),
    (r"\d++", ["1", "123"], [""]),
    (r"(?:a+)*b", ["b", "aaab"], ["a"]),
    (r"[[:alpha:]]+[[:^digit:]]", ["abc", "a-"], ["é1", "a1"]),
    (r"[[:digit:]]", ["1"], ["١"]),
    (r"\d", ["1", "١"], ["a"]),
    (r"(?-u:\d)", ["1"], ["١"]),
    (r"[a-z&&[^aeiou]]+", ["xyz"], ["a", "xa"]),
    (r"[a-z--[m-p]]", ["a", "z"], ["n"]),
    (r"[a-m~~g-z]", ["a", "z"], ["g", "m"]),
    (r"[^a-z&&[aeiou]]", ["b", "1"], ["a", "e"]),
    (r"[]a]", ["]", "a"], ["b"]),
    (r"[a-]", ["-", "a"], ["b"]),
    (r"[^\]x]", ["a"], ["]", "x"]),
    (r"\x41\x{1F600}\u00e9\U0000AC00\u{B098}", ["A😀é가나"], ["A"]),
    (r"(?i)straße|É{2}", ["STRAßE", "éÉ"], ["strasse"]),
    (r"a(?i:b)c", ["abc", "aBc"], ["ABc"]),
    (r"(?x) a b # c", ["ab"], ["a b"]),
    (r"a.b", ["axb", "a\rb"], ["a\nb"]),
    (r"(?s)a.b", ["a\nb"], ["ab"]),
    (r"(?U)a+?", ["a", "aa"], [""]),
    (r"(?P<x>a)(?<y>b)|c", ["ab", "c"], ["a"]),
    (r"a{2}b{2,}c{1,2}", ["aabbbcc"], ["abbc", "aabbccc"]),
    (r"\.\-\#\/\x20\ ", [".-#/  "], ["abcde"]),
    (r"}a", ["}a"], ["a"]),
    (r"\t\n\v\f\r\a", ["\t\n\x0b\f\r\a"], ["t"]),
]
REFUSED = [r"a(?=b)", r"a(?!b)", r"(?<=a)b", r"(?<!a)b", r"(a)\1", r"(?P<a>x)(?P=a)", r"(?>a)", r"a{2,1}", r"a{", r"{2}", r"*a", r"a|*", r"(a", r"a)", r"[z-a]", r"[a", r"\p{Foo}", r"\q", r"(?R)a", r"\Z", r"[[:foo:]]", r"\x{110000}", r"\xg1", "a\\", r"[a&&]", r"(?-u:.)", r"(?<1>a)", r"(?#c)"]


@pytest.mark.parametrize("pattern, yes, no", DIALECT, ids=lambda x: x if isinstance(x, str) else None)
def test_dialect_in_python(pattern, yes, no):
    made = regex.compile(p.parse(pattern).python, regex.V1)
    assert all(made.fullmatch(t) for t in yes) and not any(made.fullmatch(t) for t in no)


def test_dialect_in_java(spark):
    cases = [(i, pattern, t, want) for i, (pattern, yes, no) in enumerate(DIALECT) for want, texts in ((True, yes), (False, no)) for t in texts]
    df = spark.createDataFrame([(i, t, want) for i, _, t, want in cases], "i int, t string, want boolean")
    tests = F.coalesce(*[F.when(F.col("i") == i, F.rlike("t", F.lit(rf"(?U)(?d)\A(?:{p.parse(pattern).java})\z"))) for i, (pattern, _, _) in enumerate(DIALECT)])
    assert df.filter(tests != F.col("want")).collect() == []


@pytest.mark.parametrize("pattern", REFUSED)
def test_what_the_dialect_lacks(pattern):
    with pytest.raises(p.PatternError):
        p.parse(pattern)
    with pytest.raises(catalog.RuleError):
        catalog.load(f"[[rules]]\nid = 'a'\nlabel = 'b'\npattern = '''{pattern}'''\n")


def test_places(spark):
    """Word boundaries and text ends, in both engines."""
    text = "foo\nfoobar bar_ 바 a1"
    df = spark.createDataFrame([(text,)], "t string")
    for pattern in (r"\bfoo\b", r"\bfoo", r"foo\B", r"^foo", r"(?m)^foo", r"foo$", r"(?m)foo$", r"\w+\z", r"\A\w+", r"\b{start}\w", r"\w\b{end}", r"\<\w", r"(?-u:\b)\w+", r"\b{start-half}o", r"o\b{end-half}"):
        made = df.select(F.regexp_extract_all("t", F.lit(catalog.java_pattern(pattern)), F.lit(0)).alias("m")).first().m
        assert made == [text[a:b] for a, b in plain.spans(plain.compiled(pattern), text)], pattern
    found = lambda pattern: [text[a:b] for a, b in plain.spans(plain.compiled(pattern), text)]
    assert found(r"(?m)^foo") == ["foo", "foo"] and found(r"^foo") == ["foo"] and found(r"foo$") == [] and found(r"(?m)foo$") == ["foo"] and found(r"foo\B") == ["foo"]


AMBIGUOUS = {
    "none": [r"\d{6}[\s\-–][0-9*]{7}|\d{13}", r"(a+)+b", r"(a*)*", r"(?:ab|cd)+x", r"[a-z]+@[a-z]+\.[a-z]{2,}", r"(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}", r"(a|b)*c", r"\p{Hangul}+동", r"x*y*"],
    "polynomial": [r"\d+\d+x", r"\w*\d*:", r"a*b?a*c", r".*a.*b"],
    "exponential": [r"(a|a)*b", r"(\w+\s?)*:", r"(a|ab|b)*c", r"(\d+|\w+)*x", r"(?:a?b?a?)+c", r"([a-z]|[m-p])+!", r"((?:ab)*|a|b)*c"],
}


@pytest.mark.parametrize("kind, pattern", [(k, x) for k, all_of in AMBIGUOUS.items() for x in all_of])
def test_ambiguity(kind, pattern):
    assert p.ambiguity(p.parse(pattern).tree) == kind


def test_exponential_rules_are_refused_by_name():
    with pytest.raises(catalog.RuleError, match="'slow'"):
        catalog.load("[[rules]]\nid = 'slow'\nlabel = 'b'\npattern = '(\\w+\\s?)*:'\n")
    assert catalog.builtin().slow() == []
    assert catalog.load("[[rules]]\nid = 'q'\nlabel = 'b'\npattern = '\\d+\\d+x'\n").slow() == [("q", r"\d+\d+x")]


def test_repetitions_of_repetitions_take_no_time(spark):
    """What is exponential as written for a backtracking engine, and accepted as it has one way through a text."""
    rules = catalog.load("[[rules]]\nid = 'n'\nlabel = 'n'\npatterns = ['(a+)+b', '(?:(?:x*)*)*y', 'z++']\n")
    began = time.time()
    rows = detect(spark.createDataFrame([("a" * 5000 + "! " + "x" * 5000 + "y zzz",)], "t string"), [], "t", rules).collect()
    assert [(r.raw[-1], len(r.raw)) for r in rows] == [("y", 5001), ("z", 3)] and time.time() - began < 60


def test_final_runs_find_the_same():
    """Marking runs as final never changes a match."""
    rng = random.Random(8)
    parts = ["a+", "[ab]*", "b", "c?", "[bc]{1,3}", "(?:a|bc)", "\\d+", "d*?", "(?:ab)+", "[^a]+"]
    for _ in range(400):
        source = "".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))
        made = p.parse(source)
        if p.ambiguity(made.tree) == "exponential":
            continue
        for _ in range(20):
            text = "".join(rng.choice("abcd1 ") for _ in range(rng.randint(0, 14)))
            assert list(plain.spans(regex.compile(made.python, regex.V1), text)) == list(plain.spans(regex.compile(source, regex.V1), text)), (source, text)


def test_literals_are_in_every_match():
    assert p.literals(p.parse(r"EMP-\d{6}").tree) == {"EMP-"} and p.literals(p.parse(r"(?:ab|cd)+x?").tree) == {"ab", "cd"}
    assert p.literals(p.parse(r"\d+|ab").tree) is None and p.literals(p.parse(r"(?i)abc").tree) is None and p.literals(p.parse("a{3}b").tree) == {"aaab"}
    rng = random.Random(9)
    parts = ["ab", "a+b", "(?:ab|c)", "(?:ab)?", "b{2}", "c{1,2}a", "\\d", "(?:a|bc)+", "x*"]
    for _ in range(300):
        source = "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
        needed = p.literals(p.parse(source).tree)
        for _ in range(30):
            text = "".join(rng.choice("abc1x") for _ in range(rng.randint(0, 12)))
            for a, b in plain.spans(plain.compiled(source), text):
                assert needed is None or any(x in text[a:b] for x in needed), (source, text)


EMPTY = [r"\d*", r"(a|b)?\d{0,3}", r"x*?", r"(?:ab)*", r"|a", r"a||b", r"\b", r"[a-c]*1?"]


def test_patterns_that_may_be_empty(spark):
    """Only their matches that are not empty count, wherever empty ones come up."""
    rng = random.Random(10)
    texts = ["", "1", "ab", "12ab34", " a1 ", "xx"] + ["".join(rng.choice("ab1x 가") for _ in range(rng.randint(0, 25))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    for pattern in EMPTY:
        rules = catalog.load(f"[[rules]]\nid = 'e'\nlabel = 'e'\npattern = '{pattern}'\n")
        found: dict = {}
        for r in detect(df, ["i"], "t", rules).collect():
            found.setdefault(r.i, []).append((r.char_start, r.raw))
        for i, t in enumerate(texts):
            assert sorted(found.get(i, [])) == [(f.char_start, f.raw) for f in plain.find(t, rules)], (pattern, t)
            if "|" not in pattern.replace("(a|b)", "") and "?" not in pattern.replace(")?", "").replace("1?", ""):
                free = [m.span() for m in regex.finditer(pattern, t) if m.end() > m.start()]
                assert list(plain.spans(plain.compiled(pattern), t)) == free


def test_clusters_as_plain(spark):
    """Candidates that overlap in chains, of several rules and patterns."""
    rng = random.Random(11)
    toml = "".join(f"[[rules]]\nid = 'r{i}'\nlabel = 'l'\npriority = {rng.randint(0, 3)}\npatterns = {ps}\n" for i, ps in enumerate([["-b-", "a-b"], ["[ab]-c-?"], ["-a-b-c-", "c--"], ["(?:a|b|c)-(?:a|b)"], ["-+"]]))
    rules = catalog.load(toml)
    texts = ["".join(rng.choice("abc--- ") for _ in range(rng.randint(3, 90))) for _ in range(300)] + ["-".join("abc" * 300), "-" * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    found: dict = {}
    for r in detect(df, ["i"], "t", rules).collect():
        found.setdefault(r.i, []).append((r.char_start, r.rule_id, r.raw))
    for i, t in enumerate(texts):
        assert sorted(found.get(i, [])) == sorted((f.char_start, f.rule_id, f.raw) for f in plain.find(t, rules)), t


def test_a_cluster_of_fifty_thousand(spark):
    rules = catalog.load("[[rules]]\nid = 'x'\nlabel = 'x'\npriority = 2\npattern = 'a\\.b'\n[[rules]]\nid = 'y'\nlabel = 'y'\npriority = 1\npattern = 'b\\.[ac]'\n[[rules]]\nid = 'z'\nlabel = 'z'\npattern = 'c\\.c'\n")
    text = lambda n: "a.b." * n + "c.c.b.c." * n
    few = text(60)
    assert [(r.char_start, r.rule_id) for r in detect(spark.createDataFrame([(few,)], "t string"), [], "t", rules).collect()] == [(f.char_start, f.rule_id) for f in plain.find(few, rules)]
    began = time.time()
    rows = detect(spark.createDataFrame([(text(13_000),)], "t string"), [], "t", rules).collect()
    assert len(rows) == 26_001 and time.time() - began < 60


def test_own_rules_mask_too(spark):
    rules = catalog.overlay(catalog.builtin(), "[[rules]]\nid = 'dong'\nlabel = '동'\npriority = 5\npattern = '\\p{Hangul}{2,4}동'\n[[rules]]\nid = 'tail'\nlabel = '끝'\npattern = '\\*+\\d{4}'\n")
    df = spark.createDataFrame([("사는 곳: 역삼동, 카드 ***1234.",)], "text string")
    assert mask_text(df, mode="replace", rules=rules).first().masked == "사는 곳: [동], 카드 ***1234." == plain.mask_line("사는 곳: 역삼동, 카드 ***1234.", "replace", rules)
