"""Packing documents into training sequences by non-negative least squares.

Each document is tokenized and ended, and cut at multiples of the capacity; so
only one piece of a document is shorter than a sequence.  The counts of those
lengths (at most ``capacity - 1`` numbers, whatever the corpus) are packed on
the driver: shallow combinations of lengths that fill a sequence are
enumerated, non-negative least squares gives how often to use each so that the
histogram is matched, the counts are rounded down, and what is left is packed
greedily, best fit first.  The plan names patterns with repeat counts, not
documents.  A document finds its place from its rank among the pieces of its
length: counts per partition and length, a running sum over partitions, and a
counter inside each partition; no length is gathered in one task.

Edge cases: a null or empty text is the end token alone; repeated rows are
packed each on their own; null ids stay null; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import heapq
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.llm.common import cut, id_and_text, rowwise, small_batches, tidy
from catalith.llm.rolling import batches

CAPACITY = 2048
#: Words whose ids a worker remembers; further words are encoded each time.
MEMO_WORDS = 400_000
#: Characters that a worker splits into words at once, and documents that it encodes at once.
AT_ONCE, ROWS = 1 << 20, 512
#: Combinations offered to the solver, and its steps.
MAX_COMBINATIONS, STEPS = 30_000, 400


#: Characters for which the rules below are plain: no composition, no lower case outside the list.
_OTHER = re.compile("[^\t-\r -~\x85\xa0-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u205e\u20ac]")
_LETTER, _DIGIT = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PART = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\\s{_LETTER}{_DIGIT}]+")
#: A mark next to a full stop or comma that ends a word.
_RUN = "[!-/:-@\\[-`{-~\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7\u2010-\u20ac][.,]\\s"
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
#: Byte-level vocabularies write a byte as itself where it is printable, the others from 256 on.
_BYTE_NAMES = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _SHOWN)}


class WordTokenizer:
    """Ids of texts by a byte-level BPE that lowers case and drops white space,
    so that what stands between white space can be encoded, and remembered, by
    itself.  Texts with characters outside the plain ones, or with a special
    token's string, go to the tokenizer whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bpe = self.tokenizer.model.tokenize
        self.memo: dict[str, tuple[int, ...]] = {"": ()}
        self.missed = 0

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        plain: list[int] = []
        for i, text in enumerate(texts):
            if _OTHER.search(text) or "<|" in text:
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                plain.append(i)
        for begin, end in batches([texts[i] for i in plain], AT_ONCE):
            some = plain[begin:end]
            for i, ids in zip(some, self._plain([texts[i] for i in some]), strict=True):
                out[i] = ids
        return out

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        lines = pa.array([t.lower().replace("\xa0", " ").replace("\x85", " ") for t in texts], pa.large_string())
        # Where no mark stands next to it, a full stop or comma after a word stands alone; then words are met again without it.
        apart = pc.match_substring_regex(lines, _RUN)
        for mark in (". ", ", ", ".\n", ",\n"):
            lines = pc.if_else(apart, lines, pc.replace_substring(lines, mark, f" {mark[0]} "))
        split = pc.ascii_split_whitespace(lines)
        words = split.values.dictionary_encode()
        known = [self._word(w) for w in words.dictionary.to_pylist()]
        if not known:
            return [np.empty(0, np.uint32) for _ in texts]
        sizes = np.fromiter(map(len, known), np.int64, len(known))
        flat = np.fromiter(itertools.chain.from_iterable(known), np.uint32, int(sizes.sum()))
        which = words.indices.to_numpy()
        of, ends = sizes[which], np.append(0, np.cumsum(sizes[which]))
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], of) + np.arange(ends[-1])]
        return np.split(ids, ends[split.offsets.to_numpy()[1:-1]])

    def _word(self, word: str) -> tuple[int, ...]:
        ids = self.memo.get(word)
        if ids is None:
            if word.isalpha():
                return self._part(word)
            ids = tuple(i for part in _PART.findall(word) for i in self._part(part))
            self._keep(word, ids)
        return ids

    def _part(self, part: str) -> tuple[int, ...]:
        ids = self.memo.get(part)
        if ids is None:
            ids = tuple([t.id for t in self.bpe(part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_NAMES))])
            self._keep(part, ids)
        return ids

    def _keep(self, key: str, ids: tuple[int, ...]) -> None:
        """A full memo stays as it is, for frequent words come early, until many have missed it."""
        if len(self.memo) >= MEMO_WORDS:
            self.missed += 1
            if self.missed < 8 * MEMO_WORDS:
                return
            self.missed = 0
            self.memo.clear()
        self.memo[key] = ids


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` of each piece."""

    def one(rows: dict[str, list]) -> dict[str, list]:
        ids_of = tokenizer(vocabulary)
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
        for doc_id, ids in zip(rows["doc_id"], ids_of([t or "" for t in rows["text"]]), strict=True):
            ids = np.append(ids, np.uint32(end_id)).astype("<u4")
            for at in range(0, len(ids), capacity):
                part = ids[at : at + capacity]
                for k, v in zip(out, (doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True):
                    out[k].append(v)
        return out

    return rowwise(id_and_text(docs, id_col, text_col), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long", one, ROWS)


def combinations(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of up to four lengths that fill a sequence exactly: pairs and
    repeats of a length with its complement, and triples with frequent lengths."""
    have = np.flatnonzero(counts)
    there = counts > 0
    found: set[tuple[int, ...]] = set()
    for a in have.tolist():
        for times in (1, 2, 3):
            rest = capacity - times * a
            if 0 < rest < len(there) and there[rest]:
                found.add(tuple(sorted((a,) * times + (rest,))))
        if capacity % a == 0 and capacity // a <= 4:
            found.add((a,) * (capacity // a))
    often = have[np.argsort(-counts[have], kind="stable")][:64].tolist()
    for a, b in itertools.combinations_with_replacement(often, 2):
        for c in ([], *([x] for x in often[:24])):
            rest = capacity - a - b - sum(c)
            if len(found) < MAX_COMBINATIONS and 0 < rest < len(there) and there[rest]:
                found.add(tuple(sorted((a, b, *c, rest))))
    for a in have.tolist():
        for b in often:
            rest = capacity - a - b
            if len(found) < MAX_COMBINATIONS and 0 < rest < len(there) and there[rest]:
                found.add(tuple(sorted((a, b, rest))))
    return np.array([x + (0,) * (4 - len(x)) for x in sorted(found)], np.int64).reshape(-1, 4)


def nonnegative_counts(combos: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that bring the lengths used near their counts, by
    accelerated projected gradient on the squared distance."""
    weight = (combos > 0).astype(float)
    size = len(counts)

    def used(x: np.ndarray) -> np.ndarray:
        return np.bincount(combos.ravel(), (weight * x[:, None]).ravel(), size)

    x = y = np.zeros(len(combos))
    # the largest eigenvalue, by power iteration
    v = np.ones(len(combos))
    norm = 1.0
    for _ in range(20):
        v = (used(v)[combos] * weight).sum(1)
        norm = max(float(np.linalg.norm(v)), 1e-9)
        v /= norm
    t = 1.0
    for _ in range(STEPS):
        gradient = ((used(y) - counts)[combos] * weight).sum(1)
        new = np.maximum(0.0, y - gradient / (1.05 * norm))
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, y = new, new + (last - 1) / t * (new - x)
    return x


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences have each; every piece is used once."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    combos = combinations(left, capacity)
    if len(combos):
        want = np.floor(nonnegative_counts(combos, left.astype(float)) + 1e-6).astype(np.int64)
        for i in np.argsort(-want, kind="stable").tolist():
            pattern = tuple(x for x in combos[i].tolist() if x)
            need: dict[int, int] = {}
            for a in pattern:
                need[a] = need.get(a, 0) + 1
            times = min(int(want[i]), *(int(left[a]) // n for a, n in need.items()))
            if times > 0:
                out.append((pattern, times))
                for a, n in need.items():
                    left[a] -= n * times
    return out + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest piece first; the rest of a sequence takes the longest piece that
    fits, again and again; a pattern repeats as long as its lengths last."""
    out: list[tuple[tuple[int, ...], int]] = []
    have = [-int(a) for a in np.flatnonzero(left)]
    heapq.heapify(have)
    while have:
        top = -have[0]
        if not left[top]:
            heapq.heappop(have)
            continue
        need: dict[int, int] = {}
        pattern: list[int] = []
        room, bound = capacity, top
        while room:
            bound = min(bound, room)
            fits = np.flatnonzero(left[1 : bound + 1]) + 1
            while len(fits) and left[fits[-1]] <= need.get(int(fits[-1]), 0):
                fits = fits[:-1]
            if not len(fits):
                break
            bound = int(fits[-1])
            need[bound] = need.get(bound, 0) + 1
            pattern.append(bound)
            room -= bound
        times = min(int(left[a]) // n for a, n in need.items())
        out.append((tuple(pattern), times))
        for a, n in need.items():
            left[a] -= n * times
    return out


def _slots(patterns: list[tuple[tuple[int, ...], int]], size: int) -> dict[int, tuple[np.ndarray, ...]]:
    """Of each length its slots in order: ranks below (cumulated), first sequence, repeats a sequence, offset in it."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for a in pattern:
            rows.setdefault(a, []).append((times, sequence, offset, 0))
            offset += a
        sequence += times
    return {a: (np.cumsum([r[0] for r in rs]), np.array([r[1] for r in rs]), np.array([r[2] for r in rs])) for a, rs in rows.items()}


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of each piece."""
    small_batches(docs.sparkSession)
    found = cut(pieces(docs, vocabulary, end_id, capacity, id_col, text_col).withColumn("part", F.spark_partition_id()))
    per_part = found.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(per_part.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    counts = np.zeros(capacity + 1, np.int64)
    for row in starts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[row["length"]] = row["n"]
    patterns = plan(counts, capacity)
    slots = docs.sparkSession.sparkContext.broadcast(_slots(patterns, capacity))

    def ranked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        for part in parts:
            length = part.column("length").to_numpy()
            order = np.argsort(length, kind="stable")
            same = length[order]
            head = np.searchsorted(same, same, "left")
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(same)) - head + seen[same]
            seen += np.bincount(length, minlength=capacity + 1)
            yield part.append_column("rank", pa.array(rank))

    def placed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            length, rank = part.column("length").to_numpy(), part.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for a in np.unique(length).tolist():
                at = np.flatnonzero(length == a)
                ends, first, begin = slots.value[a]
                slot = np.searchsorted(ends, rank[at], "right")
                sequence[at] = first[slot] + rank[at] - np.where(slot > 0, ends[slot - 1], 0)
                offset[at] = begin[slot]
            keep = part.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield keep.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    pieces_schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    numbered = found.mapInArrow(tidy(ranked), f"{pieces_schema}, part int, rank long")
    met = numbered.join(starts.select("length", "part", "before"), ["length", "part"])
    met = met.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("before")).alias("rank"))
    return met.mapInArrow(tidy(placed), f"{pieces_schema}, sequence_id long, offset long")
