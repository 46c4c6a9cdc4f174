"""Blocks of fingerprints, and which of them have equals in other documents.

A fingerprint is (key, mark, doc): ``key`` says what can be equal at all,
``mark`` what is equal as a whole, 64 bits each.  Sorted blocks of them travel as
one binary value, so a row of the shuffle holds hundreds.  In each bucket the
blocks are merged; a mark that stands in an earlier document is *covered*; the
first document of a mark, whose key has other marks too, is *open* and must be
looked at more closely; what has no equal is gone.

Keys are spread evenly over buckets, whose number follows the size of the data.
A key with many marks in one task (a passage in ever new surroundings) is dealt
over buckets by its marks and known to be open, so no bucket grows with it.
Within a task, only the first document of a mark is sent as a candidate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U = np.uint64
#: Fingerprints that a task gathers at least and at most before it sends blocks, and for
#: each bucket; those that a bucket may hold; marks of one key in a task from which on it may be dealt out.
GATHER, MOST, SHARE, PER_BUCKET, HOT = 300_000, 2_000_000, 32, 200_000, 16
COVERED, OPEN, RUN = 0, 1, 2
_KNOWN, _DEALT, _SIGN, _OLD = 1, 2, 4, 8
NO_ID = np.iinfo(np.int64).max
_SIGN_MARK = U(0xFFFFFFFFFFFFFFFF)


def document_key(id_col: str | Column = "doc_id", text_col: str | Column = "text") -> Column:
    """What orders documents and tells them apart: the id; for a null id a number
    above 2**62 from the text, so that such rows are later than all others, do not
    meet in one place, and count as one document only if their texts are equal."""
    own = F.xxhash64(F.coalesce(text_col, F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    return F.coalesce(id_col, own)


def _packed(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(data: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, n * size)), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def encode(key: np.ndarray, mark: np.ndarray, doc: np.ndarray, flag: np.ndarray) -> bytes:
    """A block.  Rows are sorted by key."""
    docs, which = np.unique(doc, return_inverse=True)
    parts = [_packed(np.diff(key, prepend=U(0))), _packed(mark), _packed(which.astype(np.uint32)), _packed(flag.astype(np.uint8)), _packed(np.diff(docs, prepend=0))]
    return np.array([len(key), len(docs), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def decode(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, m, *sizes = np.frombuffer(block, np.int64, 7).tolist()
    at = np.cumsum([56, *sizes])
    delta, mark, which, flag, docs = (_unpacked(block[a:b], k, c) for a, b, k, c in zip(at[:-1], at[1:], (U, U, np.uint32, np.uint8, np.int64), (n, n, n, n, m), strict=True))
    return np.cumsum(delta), mark, np.cumsum(docs)[which], flag


def _groups(key: np.ndarray, mark: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting order, and where in it keys and marks begin."""
    order = np.lexsort((doc, mark, key))
    key, mark = key[order], mark[order]
    new_key = np.append(True, key[1:] != key[:-1])[: len(key)]
    return order, new_key, new_key | np.append(True, mark[1:] != mark[:-1])[: len(key)]


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


Scan = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def blocks(rows: DataFrame, scan: Scan, buckets: int) -> DataFrame:
    """``bucket, block`` of the fingerprints that ``scan`` finds in batches of rows.
    Their keys must be spread evenly over 64 bits."""
    gather = min(max(GATHER, SHARE * buckets), MOST)
    many = max(HOT, gather // buckets)  # a bucket's share

    def flush(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, mark, doc = (np.concatenate(x) for x in zip(*found, strict=True))
        order, new_key, new_mark = _groups(key, mark, doc)
        key, mark, doc = key[order], mark[order], doc[order]
        first = doc[np.flatnonzero(new_mark)][np.cumsum(new_mark) - 1]
        flag = np.where(~new_mark & (doc > first), _KNOWN, 0).astype(np.uint8)
        keep = new_mark | (flag == _KNOWN) & np.append(True, doc[1:] != doc[:-1])[: len(doc)]
        marks = np.bincount(np.cumsum(new_key) - 1, new_mark)
        hot = (marks > many)[np.cumsum(new_key) - 1] & (flag == 0)
        flag[hot] |= _DEALT
        to = np.where(hot, _bucket(mark, buckets), _bucket(key, buckets))
        signs = np.flatnonzero(new_key & hot)  # tell the key's own bucket
        key, mark, doc, flag, to = (np.append(x[keep], y) for x, y in ((key, key[signs]), (mark, np.full(len(signs), _SIGN_MARK)), (doc, np.full(len(signs), NO_ID)), (flag, np.full(len(signs), _SIGN, np.uint8)), (to, _bucket(key[signs], buckets))))
        order = np.lexsort((key, to))
        key, mark, doc, flag, to = (x[order] for x in (key, mark, doc, flag, to))
        head = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        data = [encode(key[a:b], mark[a:b], doc[a:b], flag[a:b]) for a, b in zip(head, [*head[1:], len(to)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(to[head], pa.int32()), pa.array(data, pa.binary())], names=["bucket", "block"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for part in parts:
            for some in scan(part):
                found.append(some)
                size += len(some[0])
                if size >= gather:
                    yield from flush(found)
                    found, size = [], 0
        if size:
            yield from flush(found)

    return rows.mapInArrow(run, "bucket int, block binary")


def merge(sent: DataFrame, with_runs: str | None = None) -> DataFrame:
    """``doc, mark, kind`` of covered and open fingerprints.  ``with_runs`` adds, as
    kind RUN, a sorted run of the first documents of all marks (``all``) or of
    those that are new (``new``), in ``bucket, block``, with its size as ``mark``."""
    nothing = {"doc": pa.int64(), "mark": pa.int64(), "kind": pa.int32(), "bucket": pa.int32(), "block": pa.binary()}

    def one(table: pa.Table) -> pa.Table:
        got = [decode(x) for x in table.column("block").to_pylist()]
        key, mark, doc, flag = (np.concatenate(x) for x in zip(*got, strict=True))
        known = flag & _KNOWN > 0
        covered_doc, covered_mark = doc[known], mark[known]
        key, mark, doc, flag = (x[~known] for x in (key, mark, doc, flag))
        order, new_key, new_mark = _groups(key, mark, doc)
        key, mark, doc, flag = (x[order] for x in (key, mark, doc, flag))
        if not len(key):
            new_key = new_mark = np.zeros(0, bool)
        first = doc[np.flatnonzero(new_mark)][np.cumsum(new_mark) - 1] if len(key) else doc
        sign = flag & _SIGN > 0
        late = (doc > first) & (flag & _OLD == 0) & ~sign
        of = np.cumsum(new_key) - 1
        many = np.bincount(of, new_mark) > 1 if len(key) else np.zeros(0, bool)
        many |= np.bincount(of, flag & (_SIGN | _DEALT) > 0) > 0 if len(key) else False
        is_open = new_mark & ~sign & (many[of] if len(key) else new_mark)
        docs = np.concatenate([covered_doc, doc[late], doc[is_open]])
        out_mark = np.concatenate([covered_mark, mark[late], mark[is_open]]).view(np.int64)
        kind = np.concatenate([np.full(len(covered_doc) + int(late.sum()), COVERED), np.full(int(is_open.sum()), OPEN)])
        made = {"doc": docs, "mark": out_mark, "kind": kind, "bucket": pa.nulls(len(kind), pa.int32()), "block": pa.nulls(len(kind), pa.binary())}
        tables = [pa.table({n: pa.array(v, t) if isinstance(v, np.ndarray) else v for (n, v), t in zip(made.items(), nothing.values(), strict=True)})]
        if with_runs:
            keep = new_mark
            if with_runs == "new":  # not the marks that a run has already
                old = np.bincount(np.cumsum(new_mark) - 1, flag & _OLD > 0) > 0 if len(key) else np.zeros(0, bool)
                keep &= ~old[np.cumsum(new_mark) - 1] if len(key) else keep
            if keep.any():
                size = int(keep.sum())
                data = encode(key[keep], mark[keep], doc[keep], np.full(size, _OLD, np.uint8) | flag[keep] & (_DEALT | _SIGN))
                row = {"doc": [None], "mark": [size], "kind": [RUN], "bucket": [table.column("bucket")[0].as_py()], "block": [data]}
                tables.append(pa.table({n: pa.array(v, nothing[n]) for n, v in row.items()}))
        return pa.concat_tables(tables)

    return sent.groupBy("bucket").applyInArrow(one, "doc long, mark long, kind int, bucket int, block binary")


def dealt_anew(runs: DataFrame, buckets: int) -> DataFrame:
    """Blocks of a run dealt over another number of buckets."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for block in part.column("block").to_pylist():
                key, mark, doc, flag = decode(block)
                to = np.where((flag & _DEALT > 0) & (flag & _SIGN == 0), _bucket(mark, buckets), _bucket(key, buckets))
                order = np.lexsort((key, to))
                key, mark, doc, flag, to = (x[order] for x in (key, mark, doc, flag, to))
                head = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
                data = [encode(key[a:b], mark[a:b], doc[a:b], flag[a:b]) for a, b in zip(head, [*head[1:], len(to)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(to[head], pa.int32()), pa.array(data, pa.binary())], names=["bucket", "block"])

    return runs.select("bucket", "block").mapInArrow(run, "bucket int, block binary")


def by_document(found: DataFrame) -> DataFrame:
    """``doc, covered, open``: the marks of each document, as arrays."""
    kinds = ((COVERED, "covered"), (OPEN, "open"))
    return found.filter(F.col("kind") != RUN).groupBy("doc").agg(*(F.collect_list(F.when(F.col("kind") == k, F.col("mark"))).alias(n) for k, n in kinds))
