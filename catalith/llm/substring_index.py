"""Substring deduplication over words with a log-structured fingerprint index.

The index keeps fingerprints of all windows seen, in sorted immutable runs.  A
new batch makes a sorted run of its own, which is merge-joined with the runs of
the index, bucket by bucket; what is found is verified on whole windows; then
the run is added.  When the runs reach ``fanout``, the merge writes one run that
replaces them, so compaction costs no pass of its own.

Not each window is kept: the windows that share their least 6-gram (the anchor)
are one fingerprint, whose key is the anchor and whose mark covers all their
words.  Equal windows always have equal anchors (see ``rolling``), so none is
missed.  A mark that an earlier document has removes all its windows; where an
anchor stands in other surroundings, the windows themselves are compared, by
128 bits of hash over all their words.

What the index holds is said by a manifest, which is put in place after its runs
are whole; runs that no manifest names (of a driver that was lost) do not count.

Edge cases: null and wordless texts have no windows; a row with a null id is a
document of its own, later than all others, among such rows by a hash of the
text (equal texts are one document); rows that share an id are one document for
the rule (nothing in them is earlier than themselves) and each gets a row; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from catalith.llm import fingerprints as fp
from catalith.llm.common import cut, id_and_text, remove, scratch, shuffle_partitions, small_batches
from catalith.llm.rolling import Prefix, anchors, batches, cover, mix, spread

WINDOW, GRAM = 13, 6
U = np.uint64


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _units(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.cumsum([0, *map(len, words)])
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for text in words for w in text), U, int(bounds[-1])), bounds


def _ids(part: pa.RecordBatch) -> np.ndarray:
    return part.column("key").to_numpy(zero_copy_only=False).astype(np.int64)


def _scan(window: int, gram: int) -> fp.Scan:
    def scan(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for rows in (part.slice(at, 128) for at in range(0, part.num_rows, 128)):  # words as objects are many times their text
            ids, words = _ids(rows), [words_of(t) for t in rows.column("text").to_pylist()]
            for begin, end in batches([b" " * 8 * len(w) for w in words]):
                units, bounds = _units(words[begin:end])
                found = anchors(units, bounds, window, gram)
                yield mix(found["anchor"]), found["context"], ids[begin:end][found["doc"]]  # anchors are least hashes, so not even

    return scan


class FingerprintIndex:
    """Runs below ``path``.  A manifest names them in order, with their numbers of
    buckets and of fingerprints; the one with the highest number holds.  Buckets
    double when they would hold more than ``per_bucket`` fingerprints."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, fanout: int = 4, window: int = WINDOW, gram: int = GRAM, per_bucket: int = fp.PER_BUCKET):
        self.spark, self.path, self.fanout, self.window, self.gram, self.per_bucket = spark, path.rstrip("/"), fanout, window, gram, per_bucket
        self.store = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.number, held = self._manifest()
        self.runs: list[tuple[str, int, int]] = [tuple(r) for r in held]
        self.buckets = self.runs[-1][1] if self.runs else buckets or shuffle_partitions(spark)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, start: str) -> list[str]:
        where = self._path("")
        found = self.store.listStatus(where) if self.store.exists(where) else []
        return sorted(n for n in (s.getPath().getName() for s in found) if n.startswith(start))

    def _manifest(self) -> tuple[int, list]:
        names = self._names("manifest-")
        if not names:
            return 0, []
        stream = self.store.open(self._path(names[-1]))
        try:
            return int(names[-1].split("-")[1]), json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, runs: list[tuple[str, int, int]]) -> None:
        """The new manifest takes effect by one rename; only then old files go."""
        self.number += 1
        name = f"manifest-{self.number:08d}"
        stream = self.store.create(self._path(f"_{name}"), True)
        stream.write(bytearray(json.dumps(runs).encode()))
        stream.close()
        self.store.rename(self._path(f"_{name}"), self._path(name))
        self.runs = runs
        kept = {r for r, _, _ in runs}
        for old in [*(n for n in self._names("manifest-") if n < name), *(n for n in self._names("run-") if n not in kept)]:
            remove(self.spark, f"{self.path}/{old}")

    def _run(self, name: str, buckets: int) -> DataFrame:
        run = self.spark.read.schema("bucket int, block binary").parquet(f"{self.path}/{name}")
        return run if buckets == self.buckets else fp.dealt_anew(run, self.buckets)

    def add(self, docs: DataFrame) -> DataFrame:
        """``doc, mark, kind`` of what the batch shares with itself and with earlier
        batches; afterwards the index has the batch.  ``docs`` has key (see
        ``fingerprints.document_key``) and text."""
        while sum(n for _, _, n in self.runs) > self.per_bucket * self.buckets:
            self.buckets *= 2
        sent = fp.blocks(docs, _scan(self.window, self.gram), self.buckets)
        for name, buckets, _ in self.runs:
            sent = sent.unionByName(self._run(name, buckets))
        compact = len(self.runs) + 1 >= self.fanout
        name = f"run-{self.number + 1:08d}"
        step = f"{self.path}/step-{name}"
        fp.merge(sent, "all" if compact else "new").write.mode("overwrite").parquet(step)
        made = self.spark.read.schema("doc long, mark long, kind int, bucket int, block binary").parquet(step)
        found = cut(made.filter(F.col("kind") != fp.RUN).select("doc", "mark", "kind"))
        run = made.filter(F.col("kind") == fp.RUN)
        size = run.agg(F.coalesce(F.sum("mark"), F.lit(0)).alias("n")).first()["n"]
        run.select("bucket", "block").coalesce(max(1, self.buckets // 4)).write.mode("overwrite").parquet(f"{self.path}/{name}")
        self._commit([*([] if compact else self.runs), (name, self.buckets, size)])
        remove(self.spark, step)
        return found


def _open_windows(window: int, gram: int):
    """Of each document with open marks, its windows below them, as two hashes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p.slice(at, 128) for p in parts for at in range(0, p.num_rows, 128)):
            ids, words = _ids(part), [words_of(t) for t in part.column("text").to_pylist()]
            marks = part.column("open").to_pylist()
            for begin, end in batches([b" " * 8 * len(w) for w in words]):
                units, bounds = _units(words[begin:end])
                first, last, doc = _marked(anchors(units, bounds, window, gram), marks[begin:end])
                starts, of = spread(first, last)
                one, two = Prefix(units).fixed(window)[starts], Prefix(units, 1).fixed(window)[starts]
                owner = ids[begin:end][doc[of]]
                order = np.lexsort((owner, two, one))
                one, two, owner = one[order], two[order], owner[order]
                head = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))[: len(one)]
                again = ~head & np.append(False, owner[1:] == owner[:-1])[: len(one)]  # the same window of the same document
                least = owner[np.flatnonzero(head)][np.cumsum(head) - 1] if len(one) else owner
                known = owner > least
                two = np.where(known, two ^ owner.view(U) * U(0x9E3779B97F4A7C15), two)  # known ones need not meet
                keep = ~again
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (one.view(np.int64), two.view(np.int64), owner, known)], names=["one", "two", "doc", "known"])

    return run


def _marked(found: dict[str, np.ndarray], marks: list[list[int] | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start, and document, of the anchors with these marks."""
    have = found["context"].view(np.int64)
    at = np.zeros(len(have), bool)
    border = np.searchsorted(found["doc"], np.arange(len(marks) + 1))
    for i, some in enumerate(marks):
        if some:
            at[border[i] : border[i + 1]] = np.isin(have[border[i] : border[i + 1]], np.array(some, np.int64))
    return found["first"][at], found["last"][at], found["doc"][at]


def _kept(window: int, gram: int):
    """Each row's words without those that covered marks and windows remove."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p.slice(at, 128) for p in parts for at in range(0, p.num_rows, 128)):
            words = [words_of(t) for t in part.column("text").to_pylist()]
            covered, opened, windows = (part.column(c).to_pylist() for c in ("covered", "open", "windows"))
            texts, removed = [b" ".join(w) for w in words], [0] * len(words)
            some = [i for i in range(len(words)) if covered[i] or windows[i]]
            for begin, end in batches([b" " * 8 * len(words[i]) for i in some]):
                rows = some[begin:end]
                units, bounds = _units([words[i] for i in rows])
                found = anchors(units, bounds, window, gram)
                first, last, _ = _marked(found, [covered[i] for i in rows])
                low, high, doc = _marked(found, [opened[i] if windows[i] else None for i in rows])
                starts, of = spread(low, high)
                hashes = Prefix(units).fixed(window)[starts].view(np.int64)
                hit = np.zeros(len(starts), bool)
                for j in np.unique(doc):
                    own = doc[of] == j
                    hit[own] = np.isin(hashes[own], np.array(windows[rows[j]], np.int64))
                gone = cover(len(units), np.append(first, starts[hit]), np.append(last, starts[hit]) + window)
                for j, i in enumerate(rows):
                    out = gone[bounds[j] : bounds[j + 1]]
                    if out.any():
                        removed[i] = int(out.sum())
                        texts[i] = b" ".join([w for w, g in zip(words[i], out.tolist(), strict=True) if not g])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array(removed, pa.int64()), pa.array([t.decode("utf-8", "surrogatepass") for t in texts], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def strip_repeats(docs: DataFrame, found: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of each row, from what the index found.
    The texts are shuffled once; both joins read that shuffle."""
    n = shuffle_partitions(docs.sparkSession)
    by_id = docs.repartition(n, "key")
    marks = fp.by_document(found)
    looked_at = by_id.join(marks.filter(F.size("open") > 0).select("doc", "open").hint("shuffle_hash"), F.col("key") == F.col("doc"))
    windows = looked_at.select("key", "text", "open").mapInArrow(_open_windows(window, gram), "one long, two long, doc long, known boolean")
    least = F.min("doc").over(Window.partitionBy("one", "two"))
    late = windows.withColumn("least", least).filter(F.col("known") | (F.col("doc") > F.col("least"))).groupBy("doc").agg(F.collect_set("one").alias("windows"))
    all_marks = marks.join(late, "doc", "full")
    joined = by_id.join(all_marks.hint("shuffle_hash"), F.col("key") == F.col("doc"), "left").select("doc_id", "text", "covered", "open", "windows")
    return joined.mapInArrow(_kept(window, gram), T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]))


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, n_batches: int = 2) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: words of each document without those
    covered by a window that starts in a document with a smaller id too.  The
    documents go through a new index in ``n_batches`` batches of rising ids."""
    spark = docs.sparkSession
    small_batches(spark)
    source = id_and_text(docs, id_col, text_col).withColumn("key", fp.document_key())
    shares = [i / n_batches for i in range(1, n_batches)] or [1.0]
    size = source.agg(F.percentile_approx("doc_id", shares, 1000).alias("cuts"), F.sum(F.octet_length("text")).alias("bytes")).first()
    edges = sorted({int(c) for c in size["cuts"] or []}) if n_batches > 1 else []
    place = scratch(spark, "windows")
    # a fingerprint stands for some 20 bytes of text
    buckets = max(shuffle_partitions(spark), (size["bytes"] or 0) // (20 * fp.PER_BUCKET))
    index = FingerprintIndex(spark, place, buckets, fanout=max(2, n_batches), window=window, gram=gram)
    found = None
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        batch = source if low is None else source.filter(F.col("key") > low)
        batch = batch if high is None else batch.filter(F.col("key") <= high)
        part = index.add(batch.select("key", "text"))
        found = part if found is None else found.unionByName(part)
    remove(spark, place)
    return strip_repeats(source, found, window, gram)


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def kept_sha256(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()
