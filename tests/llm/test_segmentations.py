import math
from collections import Counter

import numpy as np
import pytest
import public_tokenizers

from quillmill.llm import registry
from quillmill.llm import segmentations as S

from .helpers import awkward, docs, prose


@pytest.fixture(scope="module")
def lat():
    return S.lattices(public_tokenizers.path(S.MODEL))


def every(lat, word):
    steps = lat.lattice(word, int(lat.nodes([word])[0]))

    def walk(at):
        if at == len(steps):
            yield (), 0.0
            return
        for end, ids, share in steps[at]:
            for rest, logp in walk(end):
                yield ids + rest, share + logp

    return dict(walk(0))


def test_lattice_shares_are_probabilities(lat):
    found = every(lat, S.SPACE + "hello")
    assert sum(map(math.exp, found.values())) == pytest.approx(1)
    weight = {ids: sum(lat.weight[i] for i in ids) for ids in found}
    a, b = list(found)[:2]
    assert found[a] - found[b] == pytest.approx(weight[a] - weight[b])


def test_samples_are_distinct_and_decode(lat):
    for i, text in enumerate([*[t or "" for t in awkward()[:8]], "a few  words here", "日本 ▁x"]):
        out = S.sample(lat, text, 5, f"k{i}")
        assert len({tuple(x[0]) for x in out}) == len(out) >= 1
        assert [x[2] for x in out] == sorted((x[2] for x in out), reverse=True)
        for ids, logp, _, inc in out:
            assert S.decode(lat, ids) == text.replace("▁", " ") and logp <= 1e-9 and 0 < inc <= 1


def test_first_sample_and_inclusion_follow_the_model(lat):
    word = "the an"
    a, b = every(lat, S.SPACE + "the"), every(lat, S.SPACE + "an")
    want = {x + y: math.exp(p + q) for x, p in a.items() for y, q in b.items()}
    runs = 4000
    outs = [S.sample(lat, word, 2, str(i)) for i in range(runs)]
    first = Counter(tuple(o[0][0]) for o in outs)
    for ids, p in sorted(want.items(), key=lambda x: -x[1])[:5]:
        assert first[ids] / runs == pytest.approx(p, abs=4 * math.sqrt(p / runs) + 1e-3)
    # Horvitz-Thompson: weights p / inclusion sum to one on average.
    total = sum(math.exp(logp) / inc for o in outs for _, logp, _, inc in o)
    assert total / runs == pytest.approx(1, abs=0.06)


def test_plain_draws_follow_the_shares(lat):
    word = S.SPACE + "é\U0001f600an"
    shares = {k: math.exp(v) for k, v in every(lat, word).items()}
    assert sum(shares.values()) == pytest.approx(1)
    runs = 40_000
    ids, count, logp, _ = lat.drawn(np.repeat(lat.nodes([word]), runs), S.mix(np.arange(runs, dtype=np.uint64)))
    found = Counter(tuple(x.tolist()) for x in np.split(ids, np.cumsum(count)[:-1]))
    assert set(found) <= set(shares)
    for k, p in shares.items():
        assert found[k] / runs == pytest.approx(p, abs=5 * math.sqrt(p / runs) + 1e-3)
    assert np.exp(logp[0]) == pytest.approx(shares[tuple(ids[: count[0]].tolist())])


def test_the_most_likely_segmentation(lat):
    for word in ("hello", "thinking", "日本x"):
        ways = every(lat, S.SPACE + word)
        assert ways[tuple(S.best(lat, word))] == pytest.approx(max(ways.values()))
    assert S.decode(lat, S.best(lat, "two  words here")) == "two  words here"


def test_nodes_do_not_depend_on_what_is_kept(lat, monkeypatch):
    texts = [prose(k, 300, 5000) for k in range(3)]
    want = [S.sample(lat, t, 3, "k") for t in texts]
    monkeypatch.setattr(S, "WORDS", 5)
    small = S.Lattices(public_tokenizers.path(S.MODEL))
    assert [S.sample(small, t, 3, "k") for t in texts] == want
    assert [[x[0].tolist() for x in out] for out in S.sampled(small, texts, 3, ["k"] * 3)] == [[x[0] for x in out] for out in want]


def test_all_when_few(lat):
    word = S.SPACE + "th"
    out = S.sample(lat, "th", 50, "x")
    assert {tuple(o[0]) for o in out} == set(every(lat, word)) and all(o[3] == 1 for o in out)


def test_table(spark, sf):
    rows = S.op9_segmentations(spark, sf).collect()
    turns = spark.read.parquet(f"{sf}/conversations.parquet").count()
    assert len({(r["conv_id"], r["turn"]) for r in rows}) == turns
    again = {(r["conv_id"], r["turn"], r["sample"]): r["ids_crc32"] for r in S.op9_segmentations(spark, sf).collect()}
    assert all(again[r["conv_id"], r["turn"], r["sample"]] == r["ids_crc32"] for r in rows)
    path = public_tokenizers.path(S.MODEL)
    assert S.segmentations(docs(spark, []).select("doc_id", "text"), S.F.col("doc_id"), path).count() == 0
    assert S.segmentations(docs(spark, [None, "a"]).select("doc_id", "text"), S.F.col("doc_id"), path).where("doc_id = 0").count() == 1


def test_query_reads_every_whole_document(spark, sf, tmp_path, lat):
    long = prose(1, 20_000, 3000)
    rows = docs(spark, [*awkward(), long, long]).withColumn("doc_id", S.F.when(S.F.col("doc_id") != 4, S.F.col("doc_id")))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["sample"]): r for r in registry.QUERIES["op9_segmentations"](spark, str(tmp_path)).collect()}
    assert {i for i, _ in got} == {r["doc_id"] for r in rows.collect()}
    for i in (13, 14):
        for k, (ids, logp, _, _) in enumerate(S.sample(lat, long, S.SAMPLES, str(i))):
            assert S.decode(lat, ids) == long
            assert got[i, k + 1]["n_pieces"] == len(ids) and got[i, k + 1]["log_prob"] == pytest.approx(logp)
