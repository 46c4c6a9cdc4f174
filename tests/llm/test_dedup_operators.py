"""Substring index, suffix ranks, near duplicates and the pipeline against plain Python."""

import hashlib
import random
import re
from collections import Counter

import pytest

from catalith.llm import fingerprints, near_dedup, substring_index, suffix_dedup
from catalith.llm.common import scratch
from catalith.llm.decontaminate import words_of
from catalith.llm.order_minhash import labelled, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], DOCS)


def corpus(seed, n=60):
    """Texts with shared passages, copies, periodic parts and odd rows."""
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(300)]
    shared = [" ".join(rng.choices(words, k=k)) for k in (13, 14, 25, 60)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randrange(0, 40))) for _ in range(3)]
        text = " ".join([parts[0], rng.choice(shared), parts[1], rng.choice([*shared, "be " * 40]), parts[2]])
        rows.append((i, text))
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200, rows[3][1][7:]), (201, rows[3][1].replace("w1 ", "w2 "))]
    rows += [(300, None), (301, ""), (302, "x" * 99), (303, "x" * 350), (303, "x" * 350), (None, shared[3]), (304, "\t".join([shared[3], shared[3]]))]
    rng.shuffle(rows)
    return rows


def order_of(spark, rows):
    """What orders each row: its id, for a null id a number from its text."""
    keyed = {r.text: r.key for r in documents(spark, [(None, t) for _, t in rows]).select("text", fingerprints.document_key().alias("key")).collect()}
    return [keyed[t] if i is None else i for i, t in rows]


def plain_windows(rows, order=None, n=13):
    order = order or [float("inf") if i is None else i for i, _ in rows]
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for i, w in zip(order, split, strict=True):
        for at in range(len(w) - n + 1):
            k = tuple(w[at : at + n])
            first[k] = min(first.get(k, float("inf")), i)
    out = []
    for (i, _), key, w in zip(rows, order, split, strict=True):
        gone = {p for at in range(len(w) - n + 1) if first[tuple(w[at : at + n])] < key for p in range(at, at + n)}
        out.append((i or -1, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("seed", "n_batches"), [(1, 1), (2, 2), (3, 4)])
def test_windows_equal_brute_force(spark, seed, n_batches):
    rows = corpus(seed)
    docs = documents(spark, rows).selectExpr("*", "1 AS key", "2 AS doc", "3 AS open")
    got = substring_index.digest(substring_index.remove_repeated_windows(docs, n_batches=n_batches)).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_windows(rows)


def test_index_runs_are_merged_and_compacted(spark):
    rows = [r for r in corpus(4) if r[0] is not None]
    rows.sort()
    place = scratch(spark, "index")
    index = substring_index.FingerprintIndex(spark, place, buckets=3, fanout=3, per_bucket=100)
    found, counts = None, []
    for part in (rows[:20], rows[20:40], rows[40:60], rows[60:]):
        index = substring_index.FingerprintIndex(spark, place, index.buckets, fanout=3, per_bucket=100)  # read again from its folder
        spark.createDataFrame([(0, b"broken")], "bucket int, block binary").write.parquet(f"{place}/run-9{len(counts)}")  # of a driver that was lost
        more = index.add(documents(spark, part).selectExpr("doc_id AS key", "text"))
        found = more if found is None else found.unionByName(more)
        counts.append(len(index.runs))
    assert counts == [1, 2, 1, 2] and index.buckets > 3 and index._names("run-") == [n for n, _, _ in index.runs]
    source = documents(spark, rows).selectExpr("doc_id", "text", "doc_id AS key")
    got = substring_index.digest(substring_index.strip_repeats(source, found)).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_windows(rows)


@pytest.mark.parametrize("all_null", [False, True])
def test_rows_with_null_ids_are_documents_of_their_own(spark, all_null):
    rows = [(None if all_null or n % 4 else i, t) for n, (i, t) in enumerate(corpus(6))]
    order = order_of(spark, rows)
    got = substring_index.digest(substring_index.remove_repeated_windows(documents(spark, rows))).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_windows(rows, order)
    got = suffix_dedup.digest(suffix_dedup.remove_repeated_bytes(documents(spark, rows))).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == plain_bytes(rows, order)


def test_dealt_out_keys_change_nothing(spark, monkeypatch):
    rows = corpus(5)
    monkeypatch.setattr(fingerprints, "HOT", 1)
    monkeypatch.setattr(fingerprints, "GATHER", 50)
    got = substring_index.digest(substring_index.remove_repeated_windows(documents(spark, rows))).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_windows(rows)


def plain_bytes(rows, order=None, n=100):
    order = order or [float("inf") if i is None else i for i, _ in rows]
    data = [((t or "").encode(), key, i) for (i, t), key in zip(rows, order, strict=True)]
    first = {}
    for d, key, _ in data:
        for at in range(len(d) - n + 1):
            k = d[at : at + n]
            first[k] = min(first.get(k, (key, at)), (key, at))
    out = []
    for d, key, i in data:
        gone = [False] * len(d)
        for at in range(len(d) - n + 1):
            if first[d[at : at + n]] < (key, at):
                gone[at : at + n] = [True] * n
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((-1 if i is None else i, len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_equal_brute_force(spark, seed):
    rows = corpus(seed, 40)
    docs = documents(spark, rows).selectExpr("*", "1 AS key", "2 AS starts")
    got = suffix_dedup.digest(suffix_dedup.remove_repeated_bytes(docs)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == plain_bytes(rows)


def test_plain_doubling_equals_brute_force(spark):
    rows = [(i, t) for i, t in dict(corpus(9, 25)).items() if i is not None]
    got = {(r.doc, r.start) for r in suffix_dedup.plain_doubling(documents(spark, rows)).collect()}
    first, want = {}, set()
    for i, t in sorted(rows):
        data = (t or "").encode()
        for at in range(len(data) - 99):
            if first.setdefault(data[at : at + 100], (i, at)) != (i, at):
                want.add((i, at))
    assert got == want and want


def test_empty_tables(spark):
    none = documents(spark, [(1, "a")]).limit(0)
    assert substring_index.remove_repeated_windows(none).count() == 0
    assert suffix_dedup.remove_repeated_bytes(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0


# near duplicates


def plain_classes(rows, least=0.8):
    """Components of all pairs by the longest common subsequence of labelled shingles."""
    labels = [labelled(word_hashes(t)).tolist() for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if not labels[a] or not labels[b]:
                same = labels[a] == labels[b]
            else:
                row = [0] * (len(labels[b]) + 1)
                for x in labels[a]:
                    new = [0]
                    for j, y in enumerate(labels[b], 1):
                        new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
                    row = new
                same = row[-1] / (len(labels[a]) + len(labels[b]) - row[-1]) >= least
            if same:
                parent[max(top(a), top(b))] = min(top(a), top(b))
    least_id = {}
    for n, (i, _) in enumerate(rows):
        least_id[top(n)] = min(x for x in (least_id.get(top(n)), i) if x is not None)
    return sorted((i, least_id[top(n)]) for n, (i, _) in enumerate(rows))


def near_corpus(seed, n=8, copies=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(n):
        base = rng.choices(words, k=rng.randrange(4, 120))
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 60)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text).title() + "."))
    return rows + [(900, ""), (901, "..."), (902, "one"), (903, "One!"), (904, "two")]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    rows = near_corpus(seed)
    docs = documents(spark, rows).selectExpr("*", "1 AS tid", "2 AS first", "3 AS key")
    assert sorted(tuple(r) for r in near_dedup.near_duplicates(docs).collect()) == plain_classes(rows)


def test_small_blocks_and_split_buckets_lose_no_link(spark, monkeypatch):
    rows = near_corpus(3, 3, 12)
    for name, value in (("BLOCK", 2), ("LARGE", 3), ("STAR", 2)):
        monkeypatch.setattr(near_dedup, name, value)
    assert sorted(tuple(r) for r in near_dedup.near_duplicates(documents(spark, rows)).collect()) == plain_classes(rows)


def test_one_of_each_class_stays(spark):
    rows = [*near_corpus(4), (None, None), (900, "")]
    kept = near_dedup.keep_one(documents(spark, rows))
    classes = Counter(c for _, c in plain_classes([r for r in rows if r[0] is not None]))
    assert kept.columns == documents(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(classes)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.v: r.label for r in near_dedup.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# pipeline


def test_pipeline_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rng = random.Random(7)
    words = [f"w{i}" for i in range(200)]
    clean = [(i, " ".join(rng.choices(words, k=60))) for i in range(40)]
    toxic = [(100 + i, " ".join([*rng.choices(words, k=30), "moron", "clown", "moron"])) for i in range(30)]
    item = " ".join(rng.choices(words, k=20))
    rows = [*clean, *toxic, (200, clean[3][1]), (201, clean[4][1] + " end"), (202, f"intro {item}"), (203, clean[5][1] + " mail a@b.org")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 100)) for i, _ in clean + toxic], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in docs.collect()}
        assert name == "packing" or docs.columns == corpus_pipeline.COLUMNS
    everything = {i for i, _ in rows}
    assert kept["toxicity"] == everything - {i for i, _ in toxic}
    assert kept["near_duplicates"] == kept["toxicity"] - {200, 201, 203}
    assert kept["decontamination"] == kept["near_duplicates"] - {202}
    assert kept["packing"] == kept["personal_data"] == kept["decontamination"]
    assert words_of("A b") == [b"a", b"b"]
