"""Links do not depend on how many texts share a key."""

import random

import numpy as np
import pyarrow as pa
import pytest

from catalith.llm import near_dedup
from catalith.llm.order_minhash import labelled, similarity, sketch, word_hashes
from tests.llm.test_dedup_operators import documents


@pytest.mark.parametrize("large", [1, 4096])
def test_a_single_shared_key_links_in_a_bucket_of_any_size(spark, monkeypatch, large):
    rng = random.Random(27518)
    first = [f"w{rng.randrange(10**6)}" for _ in range(140)]
    second = list(first)
    for at in (15, 70, 120):
        second[at] = "changed"
    rows = [(1, " ".join(first)), (2, " ".join(second)), (3, " ".join(f"other{i}" for i in range(140)))]
    a, b = (labelled(word_hashes(t)) for _, t in rows[:2])
    assert (sketch(a) == sketch(b)).sum() == 1 and len(a) > near_dedup.SHORT and similarity(a, b, np.argsort(a), 0.8) >= 0.8
    monkeypatch.setattr(near_dedup, "LARGE", large)
    monkeypatch.setattr(near_dedup, "_star", lambda least: lambda table: pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())}))
    assert sorted(tuple(r) for r in near_dedup.near_duplicates(documents(spark, rows)).collect()) == [(1, 1), (2, 1), (3, 3)]
