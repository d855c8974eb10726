"""The pipeline's near-copy stage against all pairs."""

import random

import pytest

import corpus_pipeline
from rollcall.llm import nearcopies

from .test_operators import union_find


def planted():
    """Texts of 60 to 400 words, and copies with 1 to 12 edits; short and empty ones."""
    r, out = random.Random(11), ["", " ", "One two", "one TWO", "one two three"]
    for _ in range(25):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randrange(60, 400))]
        out.append(" ".join(base))
        for edits in (1, 2, 3, 5, 8, 12):
            copy = list(base)
            for _ in range(edits):
                copy[r.randrange(len(copy))] = f"x{r.randrange(99999)}"
            out.append(" ".join(copy))
    return out


def shingle_set(text):
    w = text.lower().split()
    return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets = [shingle_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return union_find(len(texts), pairs)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_stage_catches_every_planted_near_copy(spark):
    texts = planted()
    want = brute(texts)
    assert len(set(want)) < len(texts) - 60
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    kept = {r.doc_id for r in stage(spark, frame(spark, list(enumerate(texts))), "").collect()}
    assert kept == set(want)


@pytest.mark.parametrize("limit,most,room", [(nearcopies.LIMIT, nearcopies.MOST, nearcopies.LIMIT), (0, nearcopies.MOST, nearcopies.LIMIT), (0, 3, 900)])
def test_groups_equal_all_pairs(spark, limit, most, room):
    texts = planted()
    got = {r.doc_id: r.part for r in nearcopies.near_copies(frame(spark, list(enumerate(texts))), limit, most, room).collect()}
    want = brute(texts)
    assert len({(got[i], want[i]) for i in range(len(texts))}) == len(set(want)) == len(set(got.values()))


def test_no_cell_holds_a_whole_bucket(spark, monkeypatch):
    """One family of 400 texts and blocks of 50: cells stay near two blocks, the parts right."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for k in range(400):
        copy = list(base)
        for _ in range(3):
            copy[r.randrange(len(copy))] = f"x{k}-{r.randrange(999)}"
        texts.append(" ".join(copy))
    held, plain = [], nearcopies._links

    def watched(grouped):
        held.append(grouped.where("band >= 0").groupBy("band", "part", "cell").count().agg({"count": "max"}).first()[0] or 0)
        return plain(grouped)

    monkeypatch.setattr(nearcopies, "_links", watched)
    parts = {x.part for x in nearcopies.near_copies(frame(spark, list(enumerate(texts))), most=50).collect()}
    assert len(parts) == 1 and 50 < max(held) <= 150


def test_odd_rows(spark):
    a = " ".join(f"w{i}" for i in range(100))
    rows = [(1, a), (1, a), (2, a + " end"), (2, "another text of some words"), (None, a), (None, "only here"), (None, "only here"), (3, None), (4, "")]
    kept = sorted(((r.doc_id or 0), r.text or "") for r in nearcopies.first_of_each_group(frame(spark, rows)).collect())
    assert kept == [(0, "only here"), (1, a), (2, "another text of some words"), (3, "")]
    assert nearcopies.first_of_each_group(frame(spark, [])).count() == 0


def test_links_of_similarity_lie_within_the_radius():
    """Fingerprints of pairs at similarity 0.8 to 0.9: beyond two bits, and all within RADIUS."""
    far, two = [], 0
    r = random.Random(8)
    for k in range(400):
        n = r.randrange(9, 300)
        shared = [r.getrandbits(64) for _ in range(n)]
        extra = n // 8 if k % 2 else n // 4
        one, other = (nearcopies.np.sort(nearcopies.np.array(shared + [r.getrandbits(64) for _ in range(m)], nearcopies.np.uint64)) for m in (extra // 2, extra - extra // 2))
        d = (nearcopies.fingerprint(one) ^ nearcopies.fingerprint(other)).bit_count()
        far.append(d)
        two += d <= 2
    assert max(far) <= nearcopies.RADIUS and two < 40
