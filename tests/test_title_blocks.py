"""Title pairs by blocks of like length against all pairs."""

import random

import numpy as np
import pytest

from newsweft.operators import fuzzy
from tests.test_clusters import fuzzy_inputs


@pytest.mark.parametrize("block", [1, 6, 1000])
def test_candidates_of_any_blocks(spark, block):
    runs = {0: fuzzy_inputs(3, 12), 1: fuzzy_inputs(5, 9)}
    df = spark.createDataFrame([(run, t, t) for run, ts in runs.items() for t in ts], "d int, _id string, title_key string")
    got = sorted(tuple(r) for r in fuzzy.candidate_titles(df, ["d"], 0.08, block).collect())
    want = sorted(
        (run, *sorted((a, b), key=lambda t: (len(t), t))) for run, ts in runs.items() for i, a in enumerate(ts) for b in ts[i + 1:]
        if fuzzy.common_subsequence_reaches(a, b, fuzzy._least(a, b, 0.08))
    )
    assert got == want and got


def test_few_titles_of_one_language_are_compared():
    """Titles of the same syllables share grams by the hundred; their counts part them before any text is compared."""
    rnd = random.Random(7)
    syllables = ["the", "on", "er", "ing", "an", "re", "ou", "tion", "ly", "ed", "nd", "ble", "wh", "st", "sh"]
    titles = sorted(("".join(rnd.choice(syllables) for _ in range(rnd.randint(20, 200))) for _ in range(300)), key=len)
    edited = titles[100][:40] + titles[100][41:]
    titles = sorted([*titles, edited], key=len)
    found = [(titles[x], titles[y]) for r, c in fuzzy._near_counts(titles, titles, 0.08, True) for x, y in zip(r, c)]
    assert any(edited in p for p in found) and len(found) < 100


def test_counts_hold_every_gram():
    titles = ["abcab", "", "ab", "\U0001F600ab", "a" * 600]
    assert fuzzy._counts(titles, 2, 4096).sum(axis=1, dtype=np.int64).tolist() == [4, 0, 1, 2, 255]


def test_grams_of_long_titles():
    a, b = "abcabcabc", "abcabxabc"
    tell = lambda t: [t[i:i + 3] for i in range(len(t) - 2)]
    apart = sum(abs(tell(a).count(g) - tell(b).count(g)) for g in {*tell(a), *tell(b)})
    near = lambda most: fuzzy._grams_near(fuzzy._grams(a, 3), fuzzy._grams(b, 3), most)
    assert near(apart) and not near(apart - 1)
    assert fuzzy._grams_near(fuzzy._grams("ab", 3), fuzzy._grams(a, 3), 0)
