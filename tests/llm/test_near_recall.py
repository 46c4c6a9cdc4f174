"""Near duplicates of the table against all pairs, and rows without ids."""

from collections import Counter, defaultdict

from catalith.llm import near_dedup
from catalith.llm.order_minhash import labelled, word_hashes
from tests.llm.test_dedup_operators import documents


def common(a, b):
    """Length of a longest common subsequence, a bit for each shingle of ``a`` (none repeats)."""
    at = {x: 1 << i for i, x in enumerate(a)}
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        same = row & at.get(x, 0)
        row = (row + same | row - same) & full
    return len(a) - row.bit_count()


def similar_pairs(texts, least):
    """All pairs at ``least``, found by every shingle that two texts share."""
    labels = [labelled(word_hashes(t)).tolist() for t in texts]
    holders = defaultdict(list)
    for n, some in enumerate(labels):
        for x in some:
            holders[x].append(n)
    shared = Counter((a, b) for own in holders.values() for i, a in enumerate(own) for b in own[i + 1 :])
    for (a, b), n in shared.items():
        total = len(labels[a]) + len(labels[b])
        if n / (total - n) >= least:
            same = common(labels[a], labels[b])
            if same / (total - same) >= least:
                yield a, b, same / (total - same)


def test_recall_on_the_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    classes = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    pairs = list(similar_pairs([t for _, t in rows], 0.8))
    near = [(a, b) for a, b, s in pairs if rows[a][1] != rows[b][1]]
    met = [classes[rows[a][0]] == classes[rows[b][0]] for a, b in near]
    assert len(near) >= 12 and all(met)
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in pairs:
        x, y = top(rows[a][0]), top(rows[b][0])
        parent[max(x, y)] = min(x, y)
    empty = [i for i, t in rows if not labelled(word_hashes(t)).size]
    assert all(classes[i] == top(i) or i in empty for i, _ in rows)  # nothing is linked that is not similar


def test_texts_under_one_id_and_without_ids(spark):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcde"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0] + " end"), (None, texts[2]), (None, texts[2] + " end"), (None, texts[3]), (3, texts[3]), (None, texts[4]), (None, texts[4])]
    got = near_dedup.near_duplicates(documents(spark, rows)).collect()
    names = Counter(r.class_id for r in got)
    assert len(got) == len(rows) and names[1] == 3 and names[3] == 2 and sorted(names.values()) == [2, 2, 2, 3]
    kept = near_dedup.keep_one(documents(spark, rows)).collect()
    left = Counter((r.doc_id, r.text.split()[0][0]) for r in kept)
    assert left == Counter([(1, "a"), (1, "b"), (None, "c"), (3, "d"), (None, "e")])


def test_many_rows_without_ids(spark):
    rows = [(None, " ".join(f"w{(i * 7 + j) % 997}" for j in range(30))) for i in range(300)]
    got = near_dedup.near_duplicates(documents(spark, rows + rows[:5])).collect()
    assert len(got) == 305 and all(r.class_id is not None for r in got)
