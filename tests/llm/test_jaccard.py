import random
import re

import pytest

from quillmill.llm import jaccard

from .helpers import awkward, docs, prose


def shingle_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(texts):
    sets = [shingle_set(t) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 75 * (len(sets[a]) + len(sets[b]) - same):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def edited(text, seed, changes):
    r, words = random.Random(seed), text.split()
    for _ in range(changes):
        words[r.randrange(len(words))] = f"new{r.random()}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    base, short = prose(7, 120), prose(8, 14)
    out = [*awkward(), "A b C", "a B c", "a b c d"]
    out += [edited(base, i, i % 4) for i in range(40)]
    out += [edited(short, i, i % 2) for i in range(20)] + [short + " " + "x " * (i % 3) for i in range(9)]
    passage = prose(9, 60)
    out += [prose(100 + i, 30) + " " + passage + " " + prose(200 + i, 50) for i in range(30)]
    out += [prose(300 + i, 3 + i) for i in range(25)] + [prose(300 + i, 4 + i) for i in range(25)]
    return out


def test_components_match_brute_force(spark, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_keep_one_and_empty(spark, texts):
    kept = {r["doc_id"] for r in jaccard.keep_one(docs(spark, texts)).collect()}
    assert kept == {c for _, c in brute(texts)}
    assert jaccard.classes(docs(spark, [])).count() == 0
    twice = docs(spark, ["a b c d e f"]).union(docs(spark, ["a b c d e f"]))
    assert jaccard.keep_one(twice).count() == 1


def test_boundary_balances_cost():
    assert jaccard.boundary(2.0, 75, 100) < jaccard.boundary(8.0, 75, 100)


def test_rows_without_an_id_or_of_one_id_are_told_apart(spark):
    a, b, c, d = (prose(k, 60, 5000) for k in (1, 2, 3, 4))
    rows = [(7, a), (None, edited(a, 1, 1)), (None, b), (None, c), (8, d), (9, d), (9, prose(5, 60, 5000)), (None, ""), (None, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.classes(frame).collect()
    assert sorted(str(r["component_id"]) for r in got if r["doc_id"] is None) == ["7", "None", "None", "None", "None"]
    assert sorted(r["component_id"] for r in got if r["doc_id"] == 9) == [8, 9]
    kept = sorted((str(r["doc_id"]), r["text"]) for r in jaccard.keep_one(frame).collect())
    assert kept == sorted((str(i), t) for k, (i, t) in enumerate(rows) if k not in (1, 5))
