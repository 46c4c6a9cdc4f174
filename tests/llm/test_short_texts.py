"""Short near duplicates, which few or no common sketches tell."""

import random

from catalith.llm import near_dedup
from tests.llm.test_dedup_operators import documents, plain_classes


def test_short_texts_equal_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for size in [8, 8, *range(8, 68, 2)]:
        base = rng.choices(words, k=size)
        rows.append((len(rows), " ".join(base)))
        for _ in range(2):  # each longer by a word
            base.append(rng.choice(words))
            rows.append((len(rows), " ".join(base)))
    want = plain_classes(rows)
    assert dict(want)[1] == 0 and dict(want)[2] == 0  # 8, 9 and 10 words: 0.8, then 5 / 6
    assert sorted(tuple(r) for r in near_dedup.near_duplicates(documents(spark, rows)).collect()) == want


def test_short_texts_in_small_blocks(spark, monkeypatch):
    rng = random.Random(9)
    line = " ".join(f"c{i}" for i in range(9))
    rows = []
    for _ in range(12):
        own = " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(1, 12)))
        rows += [(len(rows) + k, f"{own} {line}" + " x" * k) for k in range(3)]
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    assert sorted(tuple(r) for r in near_dedup.near_duplicates(documents(spark, rows)).collect()) == plain_classes(rows)
