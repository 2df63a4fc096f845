"""The pattern table, held against fnmatch."""

import fnmatch
import random
import re

from lexiforge.operators import catalog, patterns

PATHS = ["a/b/c.md", "a/b/d.txt", "src/x.py", "src/[x].py", "src/lib/y.PY", "", "a", "ab", "weird\nname.md", "x" * 60 + "/end.md", "été/ñ.md", None]
PATTERNS = ["*", "?", "??", "a/*", "*.md", "src/[xy].py", "src/[[]x].py", "*lib*", "*[a-c]*", "a/b/c.md", "none", "", "[!a]*", "s*y", "x" * 50 + "*", "*" + "x" * 40 + "/end.md", "*été*", "*b/d*", "[", "a[", "*.m?", "src/[!x]*", "[]]*", "*/*/*"]


def test_anchors():
    assert [patterns.anchor(p) for p in ("a/*.md", "*b.md", "*lib/*", "*ab*", "x.md", "[ab]c*", "*")] == [
        ("suffix", ".md"), ("suffix", "b.md"), ("gram", "lib/"), ("any", ""), ("exact", "x.md"), ("any", ""), ("any", ""),
    ]


def check(spark, paths, globs):
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [(r.path, r.pattern) for r in catalog.removal_matches(rows, spark.createDataFrame([(g,) for g in globs], "pattern string")).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(p, g) for p in paths for g in globs if p is not None and g is not None and fnmatch.fnmatchcase(p, g)}


def test_all_kinds_of_patterns(spark):
    check(spark, PATHS + PATHS, PATTERNS + PATTERNS[:4] + [None])
    check(spark, PATHS, [])
    check(spark, [], PATTERNS)


def test_random_patterns(spark):
    rng = random.Random(3)
    paths = ["".join(rng.choice("ab/.") for _ in range(rng.randint(1, 9))) for _ in range(80)]
    check(spark, paths, ["".join(rng.choice("ab/.*?") for _ in range(rng.randint(1, 8))) for _ in range(150)])


def test_ten_thousand_patterns_have_the_plan_of_a_hundred(spark):
    rows = spark.range(2000).selectExpr("concat('d', id % 50, '/f', id, '.md') AS path")
    plans = []
    for n in (100, 10_000):
        globs = [f"d{i % 50}/f{i}*" if i % 2 else f"*{i}.md" for i in range(n)]
        made = catalog.removal_matches(rows, globs)
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        plans.append(re.sub(r"#\d+|(?<=x)_\d+|\[[\d,]+\]", "", plan))  # without numbers of columns, and the anchors' lengths
        if n > 100:
            assert made.count() == _expected(n)
    assert plans[0] == plans[1]


def _expected(n):
    paths = [f"d{i % 50}/f{i}.md" for i in range(2000)]
    prefixes, suffixes = {}, {}
    for i in range(n):
        (prefixes if i % 2 else suffixes)[f"d{i % 50}/f{i}" if i % 2 else f"{i}.md"] = 1
    return sum(p[:k] in prefixes for p in paths for k in range(len(p) + 1)) + sum(p[k:] in suffixes for p in paths for k in range(len(p)))
