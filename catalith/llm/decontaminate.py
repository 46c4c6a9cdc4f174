"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of ``window`` consecutive words of a benchmark item; an
item with fewer words, but at least one, is one pattern.  The patterns of each
length have their own search, as a short pattern would shorten every shift:

* SHIFT holds, for a block of two words, how far the search may move on
  because no pattern has that block nearer to its end.  Blocks of words that no
  pattern holds allow the longest shift.
* Where SHIFT is 0, HASH gives the bucket of patterns that end in that block.
* Each pattern of the bucket is compared word for word.

Many searches advance side by side, each in its own stretch of the text, so one
numpy step moves thousands of cursors.

Edge cases: a null or empty text has no words, hits or items and is not
contaminated; null or wordless items have no window; repeated items each count
under their own id; repeated rows of documents each give a row; an empty table
gives no rows; null ids stay null.  Other columns of either table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.llm.common import id_and_text, small_batches, tidy
from catalith.llm.rolling import batches, cover, spread

#: Items are taken in blocks of so many characters; a block's tables go to every task.
BLOCK_CHARS = 2_000_000
#: Words of text that one cursor searches.
STRETCH = 256
#: Bits of the shift tables, at least; there are at least as many slots for each block of words.
TABLE_BITS, SLOTS = 18, 4

#: a-z and 0-9 stay, A-Z become lower case, other ASCII parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of letters, digits and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class _Search:
    """The tables for the patterns of one length."""

    def __init__(self, patterns: np.ndarray, items: list[list[int]]):
        self.patterns, self.items = patterns, items
        self.length = m = patterns.shape[1]
        self.block = b = min(2, m)
        self.bits = max(TABLE_BITS, (SLOTS * len(patterns) * m).bit_length() if m > b else 0)
        self.bits = min(self.bits, 24)
        self.shift = np.full(1 << self.bits, m - b + 1, np.uint8 if m < 255 else np.int32)
        for end in range(b, m + 1):  # ascending, so that the least shift stays
            self.shift[self._slot(patterns[:, end - b], patterns[:, end - 1])] = m - end
        suffix = self._slot(patterns[:, m - b], patterns[:, m - 1])
        self.by_suffix = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.by_suffix]

    def _slot(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        mixed = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ last.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and pattern of every occurrence; word 0 is in no pattern."""
        n, m, b = len(words), self.length, self.block
        ends = np.arange(m, n + 1, STRETCH, dtype=np.int64)  # a cursor is the end of its window
        stop = np.minimum(ends + STRETCH, n + 1)
        starts, which = [], []
        while len(ends):
            slot = self._slot(words[ends - b], words[ends - 1])
            step = self.shift[slot].astype(np.int64)
            at = np.flatnonzero(step == 0)
            if len(at):
                low = np.searchsorted(self.suffix, slot[at], "left")
                high = np.searchsorted(self.suffix, slot[at], "right") - 1
                bucket, of = spread(low, high)
                begin, found = ends[at][of] - m, self.by_suffix[bucket]
                same = np.ones(len(found), bool)
                for i in range(m):
                    same[same] = words[begin[same] + i] == self.patterns[found[same], i]
                starts.append(begin[same])
                which.append(found[same])
                step[at] = 1
            ends = ends + step
            live = ends < stop
            ends, stop = ends[live], stop[live]
        none = np.empty(0, np.int64)
        return (np.concatenate(starts), np.concatenate(which)) if starts else (none, none)


class WuManber:
    """Searches texts for the windows of benchmark items."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        self.ids: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[int]]] = {}
        self.names = [i for i, _ in items]
        for n, (_, text) in enumerate(items):
            ids = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1 if size else 0):
                by_length.setdefault(size, {}).setdefault(tuple(ids[at : at + size]), set()).add(n)
        self.searches = [_Search(np.array(list(p), np.int32), [sorted(x) for x in p.values()]) for _, p in sorted(by_length.items())]

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int]], set[int]]]:
        """Of each text: its words, the word ranges that are hit, and the items."""
        ids, split = self.ids.get, [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in split], np.int64)
        line = np.zeros(int(sizes.sum()) + len(split) + 1, np.int64)  # a 0 before each text and at the end
        first = np.cumsum(sizes + 1) - sizes
        for at, words in zip(first, split, strict=True):
            line[at : at + len(words)] = [ids(w, 0) for w in words]
        spans: list[list[tuple[int, int]]] = [[] for _ in split]
        items: list[set[int]] = [set() for _ in split]
        for search in self.searches:
            starts, which = search.find(line)
            for start, p, text in zip(starts.tolist(), which.tolist(), (np.searchsorted(first, starts, "right") - 1).tolist(), strict=True):
                spans[text].append((start - int(first[text]), start - int(first[text]) + search.length))
                items[text].update(search.items[p])
        for size, s, i in zip(sizes.tolist(), spans, items, strict=True):
            yield size, s, i


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in blocks of at most ``limit`` characters (or one item); a block at a time is on the driver."""
    block: list[tuple[int | None, str | None]] = []
    size = 0
    for row in benchmark.select(F.col(item_col), F.col(text_col).cast("string")).toLocalIterator():
        if block and size + len(row[1] or "") > limit:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1] or "")
    if block:
        yield block


#: The columns that a search adds to a row.
_ADDED = (("__wm_words", pa.int64(), T.LongType()), ("__wm_hits", pa.list_(pa.int64()), T.ArrayType(T.LongType())), ("__wm_items", pa.list_(pa.string()), T.ArrayType(T.StringType())))


def _searched(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str, item_col: str, item_text_col: str, window: int, block_chars: int) -> DataFrame:
    """The kept columns with number of words, hit ranges and items.  Each block
    of items is one narrow pass that adds to what the passes before it found."""
    spark, frame = docs.sparkSession, docs
    small_batches(spark)
    blocks = _blocks(benchmark, item_col, item_text_col, block_chars)
    block, later = next(blocks, []), next(blocks, None)
    names = [n for n, _, _ in _ADDED]
    while True:
        shared = spark.sparkContext.broadcast(WuManber(block, window))
        columns = keep + [text_col] * (later is not None and text_col not in keep)

        def run(parts: Iterator[pa.RecordBatch], shared=shared, columns=columns) -> Iterator[pa.RecordBatch]:
            for part in (p.slice(at, 512) for p in parts for at in range(0, p.num_rows, 512)):
                texts = part.column(text_col).to_pylist()
                before = [part.column(n).to_pylist() for n in names[1:]] if names[1] in part.schema.names else [[[]] * len(texts)] * 2
                words, hits, items = [], [], []
                for begin, end in batches([t or "" for t in texts], 1 << 21):
                    for i, (n, spans, found) in zip(range(begin, end), shared.value.scan(texts[begin:end]), strict=True):
                        old = before[0][i]
                        words.append(n)
                        hits.append([x for s in sorted({*spans, *zip(old[::2], old[1::2], strict=True)}) for x in s])
                        items.append(sorted({*before[1][i], *(str(shared.value.names[x]) for x in found)}))
                made = [pa.array(v, t) for v, (_, t, _) in zip((words, hits, items), _ADDED, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *made], names=[*columns, *names])

        frame = frame.mapInArrow(tidy(run), T.StructType([*(docs.schema[c] for c in columns), *(T.StructField(n, t) for n, _, t in _ADDED)]))
        if later is None:
            return frame
        block, later = later, next(blocks, None)


def _covered(hits: str) -> F.Column:
    """Words in the union of sorted ranges, given as alternating starts and ends."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(hits) - 2, F.lit(2)), lambda i: F.struct(F.get(hits, i).alias("a"), F.get(hits, i + 1).alias("b")))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    total = F.aggregate(pairs, start, lambda s, x: F.struct((s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], x["b"]).alias("end")))
    return F.when(F.size(hits) > 0, total["n"]).otherwise(F.lit(0).cast("long"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: float = 0.05, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Of each row of ``docs``: ``doc_id``, ``n_words``, ``n_hit`` (words inside an
    occurrence of a window), ``hits`` (the word ranges, as alternating starts and
    ends), ``items`` (ids of items with occurring windows, sorted as strings)
    and ``contaminated`` (any hit, and at least ``share`` of the words).  No shuffle.
    """
    found = _searched(id_and_text(docs, id_col, text_col), benchmark, ["doc_id"], "text", item_col, item_text_col, window, block_chars)
    found = found.select("doc_id", F.col("__wm_words").alias("n_words"), _covered("__wm_hits").alias("n_hit"), F.col("__wm_hits").alias("hits"), F.col("__wm_items").alias("items"))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") / F.lit(share) >= F.col("n_words")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: float = 0.05, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows judged contaminated; all columns stay, and no shuffle is needed."""
    found = _searched(docs, benchmark, docs.columns, text_col, item_col, item_text_col, window, block_chars)
    hit = _covered("__wm_hits")
    return found.filter(~((hit > 0) & (hit / F.lit(share) >= F.col("__wm_words")))).select(*docs.columns)
