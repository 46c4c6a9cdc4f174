"""Near-duplicate classes by Order MinHash, verified by banded alignment.

Texts are words in lower case without marks; equal word sequences are one text
from the start.  Each text has ``SKETCHES`` Order MinHash keys; texts that share
a key are candidates, and so are short texts that share one of their rarest
shingles.  Two texts are linked if the alignment of their labelled
five-word shingles, in a band that the similarity bounds, matches at least
``least`` of all their shingles; classes are the connected components.

1. In each bucket, all texts are aligned with the first one (a star).
2. Buckets whose texts are in one component are done.  In the others, texts of
   different components are compared in blocks of bounded size; a pair is
   aligned in the first bucket that it shares only, if it has enough shingles in
   common, and what the block has linked already is passed over.  Buckets of
   more than ``LARGE`` texts are split by the rarest shingles of their texts, as
   in 3, so that texts are compared if they share a key and a shingle that they
   must share; the links are those of one undivided bucket.
3. Texts of up to ``SHORT`` shingles are also compared, in such blocks, wherever
   they share one of their n - ceil(least * n) + 1 rarest shingles.  Two texts
   at ``least`` must share one of these, so no such pair is lost.

Of two texts at a similarity of 0.8, one of which has more than ``SHORT``
shingles, fewer than two of 32 keys are equal with a chance below 1 in 10,000,
and less above.  Links are at most as many as texts, whatever
the size of a group; no pair of copies is written out.

Edge cases: null and wordless texts are one class; a row with a null id counts
under a number above 2**62 made from its text, so it never leads a class unless
all its ids are null, and then that number names the class; repeated rows each
get a row; rows of different texts under one id are told apart by their text; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import cut, id_and_text, small_batches, tidy
from catalith.llm.fingerprints import document_key
from catalith.llm.order_minhash import labelled, similarity, sketch, word_hashes

LEAST = 0.8
#: Texts in half a block; texts of a bucket from which on it is split by rare shingles; texts that one copy of a star's centre meets.
BLOCK, LARGE, STAR = 512, 4096, 128
#: Shingles of a text up to which all similar texts are found; labels of a group up to which its common shingles are counted before pairs are aligned.
SHORT, COUNTED = 62, 1 << 22


def _digest(words: np.ndarray) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(words.tobytes())
    return value >> 64, value & 0xFFFFFFFFFFFFFFFF


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _sketches(parts):
    for part in (p.slice(at, 256) for p in parts for at in range(0, p.num_rows, 256)):
        words = [word_hashes(t) for t in part.column("text").to_pylist()]
        marks = [_digest(w) for w in words]
        labels = [labelled(w) for w in words]
        keys = [sketch(x).view(np.int64) for x in labels]
        short = [x.view(np.int64) if 0 < len(x) <= SHORT else None for x in labels]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), part.column("raw"), _signed([a for a, _ in marks]), _signed([b for _, b in marks]), pa.array(keys, pa.list_(pa.int64())), pa.array(short, pa.list_(pa.int64()))], names=["doc_id", "key", "raw", "d1", "d2", "keys", "labels"])


def _sequences(parts):
    """Word hashes of the texts that are looked for, told by their digests."""
    for part in (p.slice(at, 256) for p in parts for at in range(0, p.num_rows, 256)):
        words = [word_hashes(t) for t in part.column("text").to_pylist()]
        same = [_digest(w) == (a % (1 << 64), b % (1 << 64)) for w, a, b in zip(words, part.column("d1").to_pylist(), part.column("d2").to_pylist(), strict=True)]
        some = pa.array(same)
        yield pa.RecordBatch.from_arrays([part.column("tid").filter(some), pa.array([w.tobytes() for w, s in zip(words, same, strict=True) if s], pa.binary())], names=["tid", "words"])


class _Texts:
    """Labelled shingles of a group's texts, and their alignments."""

    def __init__(self, labels: list[np.ndarray], least: float):
        self.least, self.labels = least, labels
        self.sizes = np.array([len(x) for x in labels])
        self.orders: dict[int, np.ndarray] = {}
        self.sorted: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def of(cls, words: list[bytes], least: float) -> _Texts:
        return cls([labelled(np.frombuffer(w, np.uint32)) for w in words], least)

    def alike(self, x: int) -> np.ndarray:
        """Texts with as many shingles in common with ``x``, in any order, as ``least`` needs."""
        if self.sizes.sum() > COUNTED:
            return np.ones(len(self.sizes), bool)
        if self.sorted is None:
            flat = np.concatenate(self.labels)
            order = np.argsort(flat, kind="stable")
            self.sorted = flat[order], np.repeat(np.arange(len(self.sizes)), self.sizes)[order]
        flat, owner = self.sorted
        low = np.searchsorted(flat, self.labels[x], "left")
        n = np.searchsorted(flat, self.labels[x], "right") - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(self.sizes))
        return common >= self.least / (1 + self.least) * (self.sizes + self.sizes[x]) - 1e-6

    def linked(self, a: int, b: int) -> bool:
        if a not in self.orders:
            self.orders[a] = np.argsort(self.labels[a])
        return similarity(self.labels[a], self.labels[b], self.orders[a], self.least) >= self.least


def _star(least: float):
    def one(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        centre = rows["centre"].index(True) if True in rows["centre"] else None
        found = []
        if centre is not None:
            texts = _Texts.of(rows["words"], least)
            found = [t for i, t in enumerate(rows["tid"]) if not rows["centre"][i] and texts.linked(centre, i)]
        return pa.table({"a": pa.array([rows["first"][0]] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return one


def _forest(labels):
    """Components within a group, and the function that finds one's top."""
    parent = {x: x for x in labels}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    return top, parent


def _block(least: float):
    def one(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        at = {t: i for i, t in enumerate(rows["tid"])}  # a text once
        index = sorted(at.values(), key=lambda i: rows["tid"][i])
        keys = np.array([rows["keys"][i] for i in index], np.int64)
        part = np.array([rows["chunk"][i] for i in index])
        top, parent = _forest(rows["comp"][i] for i in index)
        texts = _Texts.of([rows["words"][i] for i in index], least)
        found = []
        own = rows["j"][0]
        for x in range(len(index) - 1):
            same = keys[x] == keys[x + 1 :]
            ok = same.any(1) if own < 0 else same[:, own] & (same.argmax(1) == own)  # the pair's first shared key
            if rows["c1"][0] != rows["c2"][0]:
                ok &= part[x + 1 :] != part[x]
            if ok.any():
                ok &= texts.alike(x)[x + 1 :]
            for y in (np.flatnonzero(ok) + x + 1).tolist():
                a, b = top(rows["comp"][index[x]]), top(rows["comp"][index[y]])
                if a != b and texts.linked(x, y):
                    parent[max(a, b)] = min(a, b)
                    found.append((rows["tid"][index[x]], rows["tid"][index[y]]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return one


def _short_block(least: float):
    def one(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        at = {t: i for i, t in enumerate(rows["tid"])}
        index = sorted(at.values(), key=lambda i: rows["tid"][i])
        crossing = rows["c1"][0] != rows["c2"][0]
        part = np.array([rows["chunk"][i] for i in index])
        top, parent = _forest(rows["comp"][i] for i in index)
        texts = _Texts([np.array(rows["labels"][i], np.int64).view(np.uint64) for i in index], least)
        found = []
        for x in range(len(index) - 1):
            ok = texts.alike(x)[x + 1 :]
            if crossing:
                ok &= part[x + 1 :] != part[x]
            for y in (np.flatnonzero(ok) + x + 1).tolist():
                a, b = top(rows["comp"][index[x]]), top(rows["comp"][index[y]])
                if a != b and texts.linked(x, y):
                    parent[max(a, b)] = min(a, b)
                    found.append((rows["tid"][index[x]], rows["tid"][index[y]]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return one


def _in_blocks(each: DataFrame) -> DataFrame:
    """Rows of buckets of ``n`` texts, once for each pair of chunks they stand in."""
    chunks = F.ceil(F.col("n") / BLOCK).cast("int")
    each = each.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("tid"), F.col("chunks")).cast("int"))
    return each.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"c1": F.least("chunk", "with"), "c2": F.greatest("chunk", "with")})


def _shingles(parts):
    """The labelled shingles of texts, and how many a text has."""
    for part in (p.slice(at, 64) for p in parts for at in range(0, p.num_rows, 64)):
        labels = [labelled(np.frombuffer(w, np.uint32)).view(np.int64) for w in part.column("words").to_pylist()]
        sizes = np.array([len(x) for x in labels], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("tid").to_numpy(), sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(labels))], names=["tid", "size", "mark"])


def _rarest(each: DataFrame, least: float) -> DataFrame:
    """``mark, tid``: of each text's shingles (``tid, size, mark``) its rarest, as
    many as two texts at ``least`` need to meet; those of one text only are left out."""
    counts = each.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1")
    ranked = each.join(counts, "mark").groupBy("tid").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("n", "mark"))).alias("ranked"))
    room = F.size("ranked") + 1 - F.ceil(F.col("size") * F.lit(least) - F.lit(1e-6))
    return ranked.select("tid", F.explode(F.slice("ranked", F.lit(1), F.greatest(room, F.lit(0)).cast("int"))).alias("z")).select("z.mark", "tid")


def _mixed(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings with their bucket's size and their text's component, of buckets that hold several."""
    placed = cut(postings.join(labels, postings["tid"] == labels["v"], "left").select("mark", "tid", F.coalesce("label", "tid").alias("comp")))
    mixed = placed.groupBy("mark").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("mark", "n")
    return placed.join(mixed, "mark")


def short_links(short: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """Links between short texts (``tid, labels``) of different components.  A
    text stands under its rarest shingles, as many as two texts need to meet."""
    each = short.select("tid", F.size("labels").cast("long").alias("size"), F.explode("labels").alias("mark"))
    ready = _in_blocks(_mixed(_rarest(each, least), labels)).join(short, "tid").select("mark", "c1", "c2", "chunk", "tid", "comp", "labels")
    return ready.groupBy("mark", "c1", "c2").applyInArrow(_short_block(least), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``v, label``: the least vertex of each linked vertex's component, by
    spreading least labels along links and jumping to labels of labels."""
    both = cut(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "v").select("v", F.least("label", "near").alias("new"), "label")
        goal = spread.select(F.col("v").alias("label_of"), F.col("new").alias("jump"))
        spread = cut(spread.join(goal, F.col("new") == F.col("label_of")).select("v", F.least("new", "jump").alias("new"), "label"))
        moved = spread.filter(F.col("new") != F.col("label")).limit(1).count()
        labels = spread.select("v", F.col("new").alias("label"))
        if not moved:
            return labels


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_and_text(docs, id_col, text_col).withColumns({"key": document_key(), "raw": F.xxhash64(F.coalesce("text", F.lit("")))})


def _classes(source: DataFrame, least: float) -> DataFrame:
    """``doc_id, key, raw, leader`` of each row: ``raw`` tells its text, ``leader`` (least
    key and digest) its class, also where two classes have the same least id."""
    small_batches(source.sparkSession)
    sketched = cut(source.mapInArrow(tidy(_sketches), "doc_id long, key long, raw long, d1 long, d2 long, keys array<long>, labels array<long>"))
    texts = cut(sketched.groupBy("d1", "d2").agg(F.min("key").alias("first_id"), F.first("keys").alias("keys"), F.first("labels").alias("labels")).withColumn("tid", F.monotonically_increasing_id()))

    postings = texts.select("tid", F.posexplode("keys").alias("j", "key"))
    buckets = postings.groupBy("j", "key").agg(F.min("tid").alias("first"), F.count("*").alias("n")).filter("n > 1")
    members = cut(postings.join(buckets, ["j", "key"]).select("j", "key", "n", "first", "tid"))

    wanted = texts.join(members.select("tid").distinct(), "tid").select("tid", "d1", "d2", F.col("first_id").alias("key"))
    found = source.select("key", "text").join(wanted.hint("shuffle_hash"), "key")
    words = cut(found.select("tid", "d1", "d2", "text").mapInArrow(tidy(_sequences), "tid long, words binary").dropDuplicates(["tid"]))

    # 1. stars
    pairs = members.filter("tid <> first").select("first", "tid").distinct()
    sizes = pairs.groupBy("first").agg(F.ceil(F.count("*") / STAR).cast("int").alias("copies"))
    spokes = pairs.join(sizes, "first").select("first", "tid", F.pmod(F.xxhash64("tid"), F.col("copies")).cast("int").alias("copy"), F.lit(False).alias("centre"))
    hubs = sizes.select("first", F.col("first").alias("tid"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(True).alias("centre"))
    star = spokes.unionByName(hubs).join(words, "tid")
    links = cut(star.groupBy("first", "copy").applyInArrow(_star(least), "a long, b long"))
    labels = components(links)

    # 2. what is left of buckets that lie in several components
    placed = members.join(labels, members["tid"] == labels["v"], "left").select("j", "key", "n", "tid", F.coalesce("label", "tid").alias("comp"))
    mixed = placed.groupBy("j", "key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("j", "key")
    left = cut(placed.join(mixed, ["j", "key"]))
    small = left.filter(F.col("n") <= LARGE).select("j", F.col("key").alias("mark"), "n", "tid", "comp")
    large = cut(left.filter(F.col("n") > LARGE).select("tid").distinct())
    split = _mixed(_rarest(words.join(large, "tid").mapInArrow(tidy(_shingles), "tid long, size long, mark long"), least), labels)
    each = _in_blocks(small.unionByName(split.select(F.lit(-1).alias("j"), "mark", "n", "tid", "comp")))
    ready = each.join(texts.select("tid", "keys"), "tid").join(words, "tid").select("j", "mark", "c1", "c2", "chunk", "tid", "comp", "keys", "words")
    more = cut(ready.groupBy("j", "mark", "c1", "c2").applyInArrow(_block(least), "a long, b long"))

    # 3. short texts
    short = cut(short_links(texts.filter("labels is not null").select("tid", "labels"), labels, least))
    labels = components(links.unionByName(more).unionByName(short))

    own = F.struct("first_id", "d1", "d2")
    named = labels.join(texts.select(F.col("tid").alias("v"), own.alias("own")), "v")
    classes = named.join(named.groupBy("label").agg(F.min("own").alias("leader")), "label").select(F.col("v").alias("tid"), "leader")
    of_text = texts.join(classes, "tid", "left").select("d1", "d2", F.coalesce("leader", own).alias("leader"))
    return sketched.select("doc_id", "key", "raw", "d1", "d2").join(of_text, ["d1", "d2"]).select("doc_id", "key", "raw", "leader")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """``doc_id, class_id`` of each row; the class is named by its least id."""
    return _classes(_source(docs, id_col, text_col), least).select("doc_id", F.col("leader.first_id").alias("class_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """``docs`` with one document of each class: the one with the least id, of
    several texts under that id the one with the least hash, of equal rows one.
    All columns stay."""
    classes = _classes(_source(docs, id_col, text_col), least)
    kept = cut(classes.groupBy("leader").agg(F.min(F.struct("key", "raw")).alias("kept")).select(F.col("kept.key").alias("__key"), F.col("kept.raw").alias("__raw")))
    text = F.col(text_col).cast("string")
    marked = docs.withColumns({"__raw": F.xxhash64(F.coalesce(text, F.lit(""))), "__own": F.col(id_col).cast("long")})
    marked = marked.withColumn("__key", document_key("__own", text))
    return marked.join(kept, ["__key", "__raw"], "left_semi").dropDuplicates(["__key", "__raw"]).select(*docs.columns)
