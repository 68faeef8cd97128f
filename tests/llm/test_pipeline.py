import re

import numpy as np
import pytest

import corpus_pipeline
from quillmill.llm import language, secret_scan

from .helpers import awkward, docs, prose, saved
from .test_jaccard import brute as components
from .test_jaccard import edited
from .test_secrets import expected as base_spans
from .test_suffixes import Counter
from .test_tokens import crc, plain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def texts():
    shared = prose(71, 70)
    out = [t for t in awkward() if t is None or len(t) < 5000]
    out += [prose(600 + i, 60, 5000) + " token=abc%dxyz9 " % i + prose(700 + i, 30, 5000) for i in range(20)]
    out += [prose(800 + i, 40, 5000) + " " + shared + " " + prose(900 + i, 40, 5000) for i in range(8)]
    out += [edited(out[-1], i, 1) for i in range(5)]
    return out


def without_repeats(rows):
    raw = [(t or "").encode() for t in rows]
    count = Counter(b[k : k + 200] for b in raw for k in range(len(b) - 199))
    out = []
    for t, b in zip(rows, raw, strict=True):
        lost = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                lost[k : k + 200] = True
        out.append(bytes(x for x, y in zip(b, lost, strict=True) if not y).decode() if lost.any() else t)
    return out


def test_stages_match_plain_python(spark, tmp_path):
    where = saved(spark, tmp_path, texts())
    source = docs(spark, texts())
    told = {r["doc_id"] for r in language.predict(source.select("doc_id", "text"), language.dictionaries(source.where(language.fold_of(4) != 2))).where("not rejected").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "find_secrets", "pack"]
    step = stages["language_id"](spark, source, where)
    assert step.columns == COLUMNS
    kept = {r["doc_id"]: r["text"] for r in step.collect()}
    assert set(kept) == told

    ids = sorted(kept)
    group = [c for _, c in components([kept[i] for i in ids])]
    step = stages["near_duplicates"](spark, step, where)
    assert step.columns == COLUMNS
    ids = [i for k, i in enumerate(ids) if group[k] == k]
    assert {r["doc_id"] for r in step.collect()} == set(ids)

    step = stages["repeated_passages"](spark, step, where)
    assert step.columns == COLUMNS
    cleaned = dict(zip(ids, without_repeats([kept[i] for i in ids]), strict=True))
    assert {r["doc_id"]: r["text"] for r in step.collect()} == cleaned

    step = stages["find_secrets"](spark, step, where)
    assert step.columns == COLUMNS
    final = {r["doc_id"]: r["text"] for r in step.collect()}
    assert set(final) == set(ids)
    for i in ids:
        assert not base_spans(final[i]) and (final[i] == cleaned[i]) == (not base_spans(cleaned[i]))
        assert len(re.findall("<assign>", final[i] or "")) == len(base_spans(cleaned[i]))

    pieces = stages["pack"](spark, step, where).collect()
    for i in ids:
        ids_of, at = plain("byte_bpe_50k.json", final[i], 0), 0
        for r in sorted((r for r in pieces if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == crc(ids_of[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids_of)
    whole = corpus_pipeline.run(spark, where).collect()
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, pieces))


@pytest.mark.parametrize("rows", [[], [None], ["", None, ""]])
def test_degenerate_tables(spark, tmp_path, rows):
    assert corpus_pipeline.run(spark, saved(spark, tmp_path, rows)).count() == 0


def test_rules_are_listed_base_first():
    assert [r.kind for r in secret_scan.RULES[:3]] == ["assign", "access", "hex"]
