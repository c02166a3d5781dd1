"""Bridge matches against trying every value on every question."""

import random

import pytest

from quillgraph.operators.bridge import bridge_matches, bridged, likeness


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_likeness_is_that_of_the_longest_common_subsequence():
    rnd = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 80))) for _ in range(2))
        assert likeness(a, b) == (2 * subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0)


@pytest.mark.parametrize("question, value, want", [
    ("How many singers live in New York?", "New York", ("New York", "New York", 1.0, 8)),
    ("cities of New Yorks", "New York", ("New York", "New Yorks", 16 / 17, 8)),
    ("cities of New Yorkers and", "New York", None),  # ends in the middle of a word, but near: not like enough
    ("renew york", "New York", None),  # begins in the middle of a word
    ("the USA teams", "USAs", ("USA", "USA", 6 / 7, 3)),
    ("the USA teams", "USAX", None),  # all capitals count in full only
    ("show Bob's songs", "Bob", ("Bob", "Bob", 1.0, 3)),
    ("it is x's own", "o'sx", None),
    ("is it about him", "about", None),  # a stop word
    ("answer yes or", "yes", ("yes", "yes", 1.0, 3)),
    ("the id of", "id", None),
    ("", "x", None),
    ("x", "", None),
])
def test_rules(question, value, want):
    assert bridged(question, value) == want


def brute(questions, values, top=2):
    out = set()
    for qid, text in questions:
        for column in {v[:2] for v in values}:
            found = {}
            for value in sorted({v[2].strip() for v in values if v[:2] == column and v[2] is not None}):
                got = bridged(text or "", value)
                if got:
                    found[got[0]] = (value, *got[1:])
            ranked = sorted(found.values(), key=lambda x: 1e16 * x[2] + 1e8 * x[2] + x[3], reverse=True)
            ranked = [x for x in ranked if "name" not in column[1] or x[2] >= 1][:top]
            out |= {(qid, *column, *x, i + 1) for i, x in enumerate(ranked)}
    return out


def test_equals_trying_every_value(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdeio") for _ in range(rnd.randint(1, 8))) for _ in range(120)]
    values = [(rnd.choice("tu"), rnd.choice(("c", "full name")), " ".join(rnd.choices(words, k=rnd.randint(1, 3)))) for _ in range(250)]
    values += [("t", "c", x) for x in (None, "", " ", "x", "B", "ABBA", "no", "Ä b", *(v[2].upper() for v in values[:20]))]

    def spelt(value):
        out = list(value)
        for _ in range(rnd.randint(0, 2)):
            if out:
                out[rnd.randrange(len(out))] = rnd.choice(["", "e", "is", "'s"])
        return "".join(out)

    questions = [(i, " ".join(rnd.choice((rnd.choice(words), spelt(rnd.choice(values)[2] or "x") + rnd.choice(("", "'s", "?", ","))) ) for _ in range(rnd.randint(1, 8)))) for i in range(150)]
    questions += [(1000, None), (1001, ""), (1002, "x's b's"), (1003, "  abba x ")]
    got = bridge_matches(spark.createDataFrame(questions, "qid long, text string"), spark.createDataFrame(values, "table string, column string, value string"))
    rows = {tuple(r) for r in got.collect()}
    assert rows == brute(questions, values) and len(rows) > 300


def test_empty(spark):
    none = spark.createDataFrame([], "qid long, text string")
    assert bridge_matches(none, spark.createDataFrame([("t", "c", "v")], "table string, column string, value string")).isEmpty()
