"""The license scan against plain word comparison, and notices with words changed."""

import re

import pytest

from quillmill.llm import licenses

from .helpers import awkward, docs, prose, saved

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def plain(text):
    w = words(text)
    hits = [(i, t.label) for t in licenses.TEMPLATES if t.base for p in [t.text.split()] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


NOTICE = {t.label: t.text.split() for t in licenses.TEMPLATES if not t.phrase}
TEXTS = [
    *awkward(), "MIT License", "the mit\nlicense, MIT-License. mit license mit license", "general public license", "GNU General  Public-License and Apache License; general public licence",
    "general public", "public license", "mit", "mit é license", "KKit license MİT license", "0mit license 0", "mit license " * 3000, prose(4, 50) + " apache license " + prose(5, 50),
]


def test_base_columns_against_plain_words(spark, tmp_path):
    got = licenses.op11_licenses(spark, saved(spark, tmp_path, TEXTS)).collect()
    want = {i: plain(t) for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got} == want and len(got) == len(TEXTS)
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")


@pytest.mark.parametrize("label", sorted(NOTICE))
def test_changed_notices_are_found(spark, label):
    w = NOTICE[label]
    n = len(w)
    more = [*w[: n // 3], "really", "quite", *w[n // 3 :]]  # words put in: two diagonals, one band
    less = [*w[: n // 3], *w[n // 3 + 3 :]]
    other = [x if i % 9 else "other" for i, x in enumerate(w)]
    few = w[: n // 4]
    texts = [" ".join([prose(k, 30), *x, prose(k + 9, 30)]) for k, x in enumerate((w, more, less, other, few))]
    found = {}
    for r in licenses.bands(docs(spark, texts), licenses.TEMPLATES).where(f"label = '{label}' and end - start > 5").collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["share"]))
    assert found[0] == [(30, 30 + n, 1.0)]
    assert [x[:2] for x in found[1]] == [(30, 32 + n)] and [x[:2] for x in found[2]] == [(30, 27 + n)]
    assert len(found[3]) == 1 and 0.6 <= found[3][0][2] < 1
    assert 4 not in found


def test_many_templates_are_not_broadcast(spark, monkeypatch):
    texts = ["one two three mit license", None, "two three four"]
    own = (licenses.Template("a", "two three"), licenses.Template("b", "mit license", base=True))
    few = sorted(map(tuple, licenses.scan(docs(spark, texts), own).collect()))
    monkeypatch.setattr(licenses, "BROADCAST_RUNS", 1)
    assert sorted(map(tuple, licenses.scan(docs(spark, texts), own).collect())) == few
    assert [(r[0], r[-2]) for r in few] == [(0, "a,b"), (1, ""), (2, "a")]


def test_a_template_needs_a_run(spark):
    with pytest.raises(ValueError):
        licenses.runs_of("one")
