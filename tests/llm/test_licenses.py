import random
from collections import Counter

from lexiforge.llm import licenses as s
from tests.llm import cases


def brute(text, threshold):
    """Every run of words against every template; what shares most is taken first, and nothing meets it."""
    words = s.words_of(text or "")
    taken, best = [], {}

    def clear(a, b):
        return all(b <= lo or a >= hi for lo, hi in taken)

    while True:
        found = []
        for name, t in s.TEMPLATES:
            want = Counter(s.bigrams(s.words_of(t)))
            n, longest = sum(want.values()), (2 - threshold) / threshold * sum(want.values()) + 2
            for a in range(len(words)):
                have, shared, own = Counter(), 0, None
                for b in range(a + 1, min(len(words), int(a + longest) + 1)):
                    gram = words[b - 1], words[b]
                    if (b == a + 1 and gram not in want) or not clear(a, b + 1):
                        break
                    have[gram] += 1
                    shared += have[gram] <= want[gram]
                    dice = 2 * shared / (n + b - a)
                    if dice >= threshold and (own is None or dice > own[0]):
                        own = dice, shared, a, b + 1
                if own:
                    said, asked = s.versions(words[own[2] : own[3] + 2], own[3] - own[2]), s.versions(s.words_of(t))
                    if not (said and asked and said != asked):
                        found.append((-own[1], -own[0], own[2], own[3] - own[2], name))
        if not found:
            return {k: round(v, 6) for k, v in best.items()}
        _, dice, lo, size, name = min(found)
        taken.append((lo, lo + size))
        best[name] = max(best.get(name, 0), -dice)


def test_matches_brute_force(spark):
    rng = random.Random(4)
    texts = [r.text for r in spark.read.parquet(f"{cases.SF}/documents.parquet").collect() if r.text and len(r.text) < 1500][:8]
    for _, t in s.TEMPLATES[:27]:
        words = [w for w in t.split() if rng.random() > 0.05]
        for k in range(rng.randrange(0, 4)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["\n", "extra", "\n\n"]))
        texts.append("some words before\n" + " ".join(words) + "\nof the end")
    for threshold in (0.8, 0.6):
        for t in texts if threshold == 0.8 else texts[::4]:
            assert {x[0]: round(x[1], 6) for x in s.scan(t, threshold)} == brute(t, threshold)


def test_every_template_is_found_as_itself():
    for name, t in s.TEMPLATES:
        assert (name, 1.0) in {(x[0], x[1]) for x in s.scan(f"foo bar\n{t.upper()}\nbaz")}


def test_odd_rows(spark):
    docs = cases.frame(spark, [*cases.ROWS, (70, "x\nReleased under the MIT License.", "en", "a", 1)])
    assert [tuple(r) for r in s.found(docs).collect()] == [(70, "MIT", 1.0, 1, 1)]
    assert s.found(cases.empty(spark)).count() == 0


def test_notices_inside_lines_are_found(spark):
    for text, name in (
        ("This library is released under the MIT License, which see.", "MIT"),
        ("Copyright 2020 Acme Corp. All rights reserved. Read on", "all-rights-reserved"),
        ("Before you begin. Licensed under the Apache License, Version 2.0. And so on, and so forth.", "Apache-2.0"),
    ):
        assert (name, 1.0) in {(x[0], x[1]) for x in s.scan(f"word {text} {cases.prose(60, 1)}")}
    body = next(t for n, t in s.TEMPLATES if n == "BSD-3-Clause" and len(t) > 1000)
    assert ("BSD-3-Clause", 1.0, 1, 3) in s.scan(f"Copyright (c) 2019\n{body[:300]}\n{body[300:700]}\n{body[700:]}\n{cases.prose(9000, 2)}".replace(body[295:305], body[295:300] + body[300:305]))
    assert s.scan(cases.prose(9000, 2)) == []


def test_one_licence_for_one_notice():
    for text, names in (
        ("This work is licensed under the GNU General Public License, version 3.", {"GPL-3.0"}),
        ("This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0"}),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", {"LGPL-3.0"}),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1.", set()),
        ("Licensed under the Apache License, Version 1.1.", set()),
        ("Licensed under CC BY 4.0. Licensed under CC BY-SA 4.0.", {"CC-BY-4.0", "CC-BY-SA-4.0"}),
        ("Licensed under CC BY 3.0.", set()),
        ("This work is licensed under the GNU General Public License, version 3. " * 3, {"GPL-3.0"}),
        ("This work is licensed under the GNU General Public License, version 3. Or not: this work is licensed under the GNU Affero General Public License, version 3.", {"GPL-3.0", "AGPL-3.0"}),
    ):
        assert {x[0] for x in s.scan(f"some words before {text} and after it")} == names, text
    for name in ("ISC", "BSD-3-Clause", "BSD-2-Clause", "MIT", "Zlib"):
        whole = max((t for n, t in s.TEMPLATES if n == name), key=len).split()
        del whole[len(whole) // 2 :: 40]
        assert {x[0] for x in s.scan("before it " + " ".join(whole) + " after it")} == {name}
