"""Repeated byte strings by distributed prefix doubling over sampled suffixes.

Suffixes are ranked by growing prefixes until a rank is unique, and then gone, or
the threshold of ``length`` bytes is passed:

1. Prefixes of 36 bytes.  Of the 65 of them in each string of 100 bytes only the
   leftmost of the least hash is ranked (its anchor), a thirtieth of all
   positions; equal strings have equal anchors at the same offset.
2. Around anchors whose rank is shared, 84 bytes: four ranks for each anchor,
   one for each quarter of the strings that it stands for.
3. In quarters whose rank is shared, each string of 100 bytes by the pair of its
   ranks at offsets 0 and 50: Spark sorts the pairs, and all but the first
   position of a pair are repeats.

After rounds 1 and 2 equal surroundings are settled as a whole: where the same
bytes stand in an earlier document, or earlier in the same one, all their
strings are repeats, and no later round sees them.  Ranks are named by hashes,
112 bits and more with the round before, so that a name needs no dense numbers.

Edge cases: null and empty texts have no bytes; a row with a null id is a
document of its own, later than all others, among such rows by a hash of the
text (equal texts are one document); rows that share an id count as one document
(each judged alone against the others' earlier ids); repeated rows each give a
row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.llm import fingerprints as fp
from catalith.llm.common import cut, id_and_text, shuffle_partitions, small_batches
from catalith.llm.rolling import Prefix, anchors, batches, cover, mix, spread

LENGTH, GRAM, PARTS = 100, 36, 4
U = np.uint64
#: Ranks of the first two rounds keep their upper 48 bits; a rank and the one before it must agree.
_KEPT = U(0xFFFFFFFFFFFF0000)
_UNITS = np.random.default_rng(20_24).integers(1 << 62, 1 << 63, 256, dtype=U)


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _ids(part: pa.RecordBatch) -> np.ndarray:
    return part.column("key").to_numpy(zero_copy_only=False).astype(np.int64)


class _Text:
    """Anchors of some texts, and the quarters of their strings."""

    def __init__(self, texts: list[bytes], length: int, gram: int):
        self.length, self.gram = length, gram
        self.bounds = np.cumsum([0, *map(len, texts)])
        self.units = _UNITS[np.frombuffer(b"".join(texts), np.uint8)]
        self.found = anchors(self.units, self.bounds, length, gram)
        self.mark = self.found["context"] & _KEPT

    @staticmethod
    def _again(doc: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Which marks stand earlier in the same document (positions rise)."""
        order = np.lexsort((np.arange(len(mark)), mark, doc))
        same = np.append(False, (mark[order][1:] == mark[order][:-1]) & (doc[order][1:] == doc[order][:-1]))[: len(mark)]
        out = np.zeros(len(mark), bool)
        out[order] = same
        return out

    def again(self) -> np.ndarray:
        return self._again(self.found["doc"], self.mark)

    def having(self, doc: np.ndarray, mark: np.ndarray, sets: list[list[int] | None]) -> np.ndarray:
        out = np.zeros(len(mark), bool)
        border = np.searchsorted(doc, np.arange(len(sets) + 1))
        for i, some in enumerate(sets):
            if some:
                out[border[i] : border[i + 1]] = np.isin(mark[border[i] : border[i + 1]].view(np.int64), np.array(some, np.int64))
        return out

    def quarters(self, which: np.ndarray) -> dict[str, np.ndarray]:
        """Of these anchors: key (the bytes that all strings of the quarter hold), mark, first, last, doc and whether it stands earlier."""
        step = -(-(self.length - self.gram + 1) // PARTS)
        prefix = Prefix(self.units)
        rows = []
        at, first, last, doc = (self.found[n][which] for n in ("at", "first", "last", "doc"))
        for q in range(PARTS):
            low, high = at - q * step - step + 1, at - q * step
            a, b = np.maximum(first, low), np.minimum(last, high)
            ok = a <= b
            key = mix(prefix.of(high[ok], low[ok] + self.length) + U(q))
            mark = mix(prefix.of(a[ok], b[ok] + self.length) ^ mix((at[ok] - a[ok]).astype(U)))
            rows.append((doc[ok], a[ok], b[ok], key & _KEPT, mark & _KEPT))
        doc, a, b, key, mark = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((a, doc))
        out = dict(zip(("doc", "first", "last", "key", "mark"), (x[order] for x in (doc, a, b, key, mark)), strict=True))
        return out | {"again": self._again(out["doc"], out["mark"])}


def _parts(rows: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[tuple[pa.RecordBatch, list[int], _Text]]:
    """Rows in pieces of about a megabyte of text, with their anchors."""
    for part in (p.slice(at, 512) for p in rows for at in range(0, p.num_rows, 512)):
        texts = [_bytes(t) for t in part.column("text").to_pylist()]
        for begin, end in batches(texts):
            yield part.slice(begin, end - begin), texts[begin:end], _Text(texts[begin:end], length, gram)


def _first_round(length: int, gram: int) -> fp.Scan:
    def scan(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for rows, _, text in _parts(iter([part]), length, gram):
            yield mix(text.found["anchor"]) & _KEPT, text.mark, _ids(rows)[text.found["doc"]]  # anchors are least hashes, so not even

    return scan


def _second_round(length: int, gram: int) -> fp.Scan:
    def scan(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for rows, _, text in _parts(iter([part]), length, gram):
            opened = text.having(text.found["doc"], text.mark, rows.column("open").to_pylist()) & ~text.again()
            found = text.quarters(opened)
            yield found["key"], found["mark"], _ids(rows)[found["doc"]]

    return scan


def _third_round(length: int, gram: int):
    """Positions still shared: the names of their two halves, document and start."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, text in _parts(parts, length, gram):
            ids = _ids(rows)
            opened = text.having(text.found["doc"], text.mark, rows.column("open").to_pylist()) & ~text.again()
            found = text.quarters(opened)
            at = text.having(found["doc"], found["mark"], rows.column("open2").to_pylist()) & ~found["again"]
            starts, of = spread(found["first"][at], found["last"][at])
            row = found["doc"][at][of]
            half = Prefix(text.units, 1).fixed(length // 2)
            left, right = half[starts], half[starts + length - length // 2]
            doc, start = ids[row], starts - text.bounds[row]
            order = np.lexsort((start, doc, right, left))
            left, right, doc, start = (x[order] for x in (left, right, doc, start))
            first = np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1]))[: len(left)]
            head = np.flatnonzero(first)[np.cumsum(first) - 1] if len(first) else np.empty(0, np.int64)
            # all later ones are repeats already; as such they need not meet.  A repeated row has no later ones.
            known = (doc != doc[head]) | (start != start[head])
            right = np.where(known, mix(right ^ doc.view(U) * U(0x9E3779B97F4A7C15) ^ start.view(U)), right)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (left.view(np.int64), right.view(np.int64), doc, start, known)], names=["left", "right", "doc", "start", "known"])

    return run


def _last(length: int, gram: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts, text in _parts(parts, length, gram):
            sets = {c: rows.column(c).to_pylist() for c in ("covered", "open", "covered2", "starts")}
            again = text.again()
            whole = again | text.having(text.found["doc"], text.mark, sets["covered"])
            opened = text.having(text.found["doc"], text.mark, sets["open"]) & ~whole
            quarter = text.quarters(opened)
            part = quarter["again"] | text.having(quarter["doc"], quarter["mark"], sets["covered2"])
            single = np.concatenate([np.array(s or [], np.int64) + text.bounds[i] for i, s in enumerate(sets["starts"])])
            begin = np.concatenate([text.found["first"][whole], quarter["first"][part], single])
            end = np.concatenate([text.found["last"][whole], quarter["last"][part], single]) + length
            gone = cover(len(text.units), begin, end)
            removed, spans, kept = [], [], []
            for i, data in enumerate(texts):
                out = gone[text.bounds[i] : text.bounds[i + 1]]
                edge = np.flatnonzero(np.diff(out.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
                spans.append(edge.tolist())
                removed.append(int(out.sum()))
                kept.append(np.frombuffer(data, np.uint8)[~out].tobytes() if len(edge) else data)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return run


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept``: the UTF-8 bytes of each text
    without those covered by a string of ``length`` bytes that also starts earlier;
    ``spans`` are the removed runs, as alternating starts and ends.  One plan: the
    texts are shuffled once, and all three joins read that shuffle."""
    small_batches(docs.sparkSession)
    n = shuffle_partitions(docs.sparkSession)
    source = id_and_text(docs, id_col, text_col).withColumn("key", fp.document_key())
    size = source.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    buckets = max(n, size // (30 * fp.PER_BUCKET))  # a fingerprint stands for some 30 bytes
    by_id = source.repartition(n, "key")

    def with_text(marks: DataFrame, how: str) -> DataFrame:
        return by_id.join(marks.hint("shuffle_hash"), F.col("key") == F.col("doc"), how)

    one = fp.by_document(fp.merge(fp.blocks(source, _first_round(length, gram), buckets)))
    some = with_text(one.filter(F.size("open") > 0).select("doc", "open"), "inner").select("key", "text", "open")
    two = fp.by_document(fp.merge(fp.blocks(some, _second_round(length, gram), buckets))).select("doc", F.col("covered").alias("covered2"), F.col("open").alias("open2"))
    still = with_text(one.join(two, "doc").filter(F.size("open2") > 0).select("doc", "open", "open2"), "inner").select("key", "text", "open", "open2")
    positions = still.mapInArrow(_third_round(length, gram), "left long, right long, doc long, start long, known boolean")
    first = F.min(F.struct("doc", "start")).over(Window.partitionBy("left", "right"))
    late = positions.withColumn("first", first).filter(F.col("known") | (F.struct("doc", "start") > F.col("first")))
    three = late.groupBy("doc").agg(F.collect_list("start").alias("starts"))
    marks = one.join(two, "doc", "left").join(three, "doc", "left")
    joined = with_text(marks, "left").select("doc_id", "text", "covered", "open", "covered2", "starts")
    return joined.mapInArrow(_last(length, gram), "doc_id long, n_bytes long, n_removed long, spans array<long>, kept binary")


def _positions(length: int, first: int):
    """Every position that has ``first`` bytes after it, ranked by these bytes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p.slice(at, 64) for p in parts for at in range(0, p.num_rows, 64)):
            ids, texts = _ids(part), [_bytes(t) for t in part.column("text").to_pylist()]
            for i, text in zip(ids.tolist(), texts, strict=True):
                n = len(text) - first + 1
                if len(text) >= length:
                    cells = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), first)
                    rank = np.ascontiguousarray(cells).view(">i8").ravel().astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i)), pa.array(np.arange(n)), pa.array(rank)], names=["doc", "start", "rank"])

    return run


def plain_doubling(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc, start`` of all strings of ``length`` bytes that also start earlier, by
    prefix doubling over all positions: Spark sorts pairs of ranks at offsets 8, 16,
    32 and so on, what is unique goes, and a pair's rank is its first position.  It
    moves some 20 times the input in each round; ``remove_repeated_bytes`` ranks
    samples instead.  Rows that share an id must hold the same text."""
    source = id_and_text(docs, id_col, text_col).withColumn("key", fp.document_key()).dropDuplicates(["key"])
    known, ranks = 8, source.select("key", "text").mapInArrow(_positions(length, 8), "doc long, start long, rank long")
    ranks = ranks.select("doc", "start", F.struct(F.col("rank").alias("a"), F.lit(0).cast("long").alias("b")).alias("rank"))
    while known < length:
        again = Window.partitionBy("rank")
        shared = cut(ranks.withColumn("n", F.count("*").over(again)).filter("n > 1").drop("n"))
        offset = min(known, length - known)
        right = shared.select("doc", (F.col("start") - offset).alias("start"), F.col("rank").alias("right"))
        pairs = shared.join(right, ["doc", "start"])
        first = F.min(F.struct(F.col("doc").alias("a"), F.col("start").alias("b"))).over(Window.partitionBy("rank", "right"))
        ranks, known = pairs.select("doc", "start", first.alias("rank")), known + offset
    return ranks.filter(F.struct(F.col("doc").alias("a"), F.col("start").alias("b")) > F.col("rank")).select("doc", "start")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
