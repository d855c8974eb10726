"""Sentence spans against all runs of all texts."""

import random

import pytest

from rollcall.llm import sentences
from rollcall.llm.sentences import LEAST


def passage(tag, *sizes):
    return "".join(" ".join(f"{tag}{k}w{i}" for i in range(n)) + ". " for k, n in enumerate(sizes))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def kept(spark, rows):
    return {r.doc_id: r.kept for r in sentences.remove_repeats(frame(spark, rows), keep_text=True).collect()}


def brute(rows, least):
    """Sentences in any run of ``least`` words that an earlier document or place holds."""
    seen, out = {}, {}
    for doc, text in rows:
        parts = [" ".join(p.split()) for p in sentences.sentences(text)]
        gone, n = set(), len(parts)
        total = sum(len(p.split()) for p in parts)
        for i in range(n):
            for e in range(i + 1, n + 1):
                words = sum(len(p.split()) for p in parts[i:e])
                if words >= least or (total < least and (i, e) == (0, n) and words):
                    key = tuple(parts[i:e]) + (("whole",) if total < least else ())
                    at = seen.setdefault(key, (doc, i))
                    if at != (doc, i) and (at[0] != doc or at[1] < i):
                        gone |= set(range(i, e))
        out[doc] = gone
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_runs(spark, seed):
    r = random.Random(seed)
    pool = [" ".join(r.choice("abcd") for _ in range(r.randrange(1, 9))) + r.choice([". ", "! ", ".\n", "? "]) for _ in range(14)]
    rows = [(i, "".join(r.choice(pool) for _ in range(r.randrange(14)))) for i in range(40)]
    rows += [(40, pool[0]), (41, pool[0]), (42, None), (43, " ")]
    want = brute(rows, LEAST)
    for x in sentences.remove_repeats(frame(spark, rows)).collect():
        got = {j for span in x.removed.split(",") if span for j in range(*map(int, span.split("-")))}
        assert got == want[x.doc_id], x.doc_id


def test_passages_of_one_two_and_three_sentences(spark):
    one, two, three = passage("a", 51), passage("b", 30, 21), passage("c", 20, 20, 11)
    own = [f"Own start {i}. " for i in range(9)]
    rows = [(1, own[0] + one + own[1] + two + "Mid. " + three + own[2]), (2, own[3] + one + own[4]), (3, own[5] + two + own[6]), (4, own[7] + three + own[8]), (7, "Short text."), (8, "Short text.")]
    got = kept(spark, rows)
    assert got[1] == rows[0][1] and got[2] == own[3] + own[4] and got[3] == own[5] + own[6] and got[4] == own[7] + own[8]
    assert got[7] == "Short text." and got[8] == ""


def test_passages_set_in_the_middle_of_other_words(spark):
    r = random.Random(5)
    for sizes in ((80,), (30, 30), (6, 9, 12, 15, 18), (55, 4)):
        middle = " ".join(f"m{r.randrange(10**6)}" + "." * (k in {sum(sizes[:i + 1]) - 1 for i in range(len(sizes))}) for k in range(sum(sizes)))
        rows = [(1, "Here begins x " + middle + " and y ends here."), (2, "There begins z " + middle + " but w ends there.")]
        got = kept(spark, rows)
        assert got[1] == rows[0][1] and len(got[2].split()) < len(rows[1][1].split()) - sum(sizes) / 3
        assert got[2].startswith("There begins z") and got[2].endswith("w ends there.")


def test_short_common_lines_and_abbreviations_stay(spark):
    line = "All rights reserved by the maker. No copies. "
    rows = [(i, f"A text {i} of its own, e.g. this one. " + line + f"It ends {i}.") for i in range(30)]
    assert kept(spark, rows) == dict(rows)
    assert sentences.sentences("See v1.2 of it. Then e.g. that!  New\nline") == ["See v1.2 of it. ", "Then e.g. ", "that!  ", "New\n", "line"]


def test_thousands_of_equal_runs_and_ids_that_are_null_or_repeated(spark):
    text = passage("p", 12, 12, 12)
    rows = [(i, f"Start {i}. " + text) for i in range(2500)] + [(None, text), (0, text)]
    out = sentences.remove_repeats(frame(spark, rows)).collect()
    assert len(out) == 2502 and sum(r.n_removed for r in out) == 3 * 2500
    assert all(r.n_removed == 0 for r in out if r.doc_id == 0)
