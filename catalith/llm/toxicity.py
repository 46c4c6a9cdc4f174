"""Toxicity by a lexicon trie intersected with Levenshtein automata.

The lexicon is learned from labelled rows: words, and word beginnings shared by
several words, that are many times likelier in toxic documents.  It is stored
as a trie, in which a beginning accepts whatever follows.  For each word of a
text, the Levenshtein automaton of that word is run along the trie, so that a
term is found within one edit without generating variants; terms under five
letters must match exactly.  Around each hit a window of words is looked at:
quotation marks and verbs of reporting speak for quotation, second-person
pronouns for abuse.  Counts of hits by kind and context go into a logistic
regression fitted on the same labelled rows.

Only text enters a score.  Training takes at most ``max_rows`` labelled rows
(those with the least hash of their id), the one bounded sample here; scoring
covers all rows and whole texts.

Edge cases: null and empty texts have no hits and get a score too; null ids
stay null; labels that are null, or whose document is missing, are not learned
from; without labels of both kinds every score is 0; repeated rows each give a
row; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import cut, id_and_text, rowwise, small_batches, tidy

MAX_ROWS, LEAST_DOCS, LEAST_RATIO = 20_000, 5, 6.0
SHORTEST_STEM, FUZZY_FROM, CONTEXT = 4, 5, 8
MEMO_WORDS = 400_000
_WORD = re.compile(r"[^\W_]+(?:[@$*'’!][^\W_]+)*")
#: Signs that open a quotation, and those that close it.
_QUOTES = (('"', '"'), ("“", "”"), ("«", "»"), ("„", "“”"), ("‘", "’"))
_REPORTING = frozenset("said says say wrote writes called calls reported quoted quote quotes word words term insult insults slur dijo escribió llamó palabra dit écrit appelé mot sagte schrieb nannte wort zitat".split())
_ADDRESS = frozenset("you your youre u ur du dich dir dein deine tu te toi ton ta vous usted tú ti".split())
_FEATURES = 10


class Lexicon:
    """A trie of terms with their log odds; a node has its children by letter, and
    under ``end`` and ``stem`` the term that ends there or accepts all below."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.trie: dict = {}
        #: With one edit, the first or the second half of a term is intact: places in a word, and what may stand there.
        self.probes: dict[tuple[int, int], set[str]] = {}
        for term, is_stem in [(w, False) for w in words] + [(s, True) for s in stems]:
            node = self.trie
            for c in term:
                node = node.setdefault(c, {})
            node["stem" if is_stem else "end"] = term
            half = len(term) // 2 if len(term) >= FUZZY_FROM else len(term)
            self.probes.setdefault((0, half), set()).add(term[:half])
            for start in (half - 1, half, half + 1) if half < len(term) else ():
                self.probes.setdefault((start, start + len(term) - half), set()).add(term[half:])
        self.memo: dict[str, tuple[int, str]] = {}

    def find(self, word: str) -> tuple[int, str]:
        """The term and how it is met: 0 not at all, 1 a word, 2 a beginning, 3 a word within one edit, 4 a beginning within one edit."""
        got = self.memo.get(word)
        if got is None:
            got = self._find(word) if any(word[a:b] in some for (a, b), some in self.probes.items()) else (0, "")
            if len(self.memo) < MEMO_WORDS:  # frequent words come early
                self.memo[word] = got
        return got

    def _find(self, word: str) -> tuple[int, str]:
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        n = len(word)
        last = 1 << n
        best: tuple[int, str] = (0, "")
        # The automaton of `word`: bit i of `exact` (`edited`) is set if i letters are read with no (one) edit.
        stack = [(self.trie, 1, 0b10 if n else 0, 0)]
        while stack:
            node, exact, edited, depth = stack.pop()
            term = node.get("end")
            if term is not None and (exact & last or edited & last and depth >= FUZZY_FROM):
                best = self._better(best, 1 if exact & last else 3, term)
            stem = node.get("stem")
            if stem is not None and (exact or edited and depth >= FUZZY_FROM):
                best = self._better(best, 2 if exact else 4, stem)
            for c, child in node.items():
                if len(c) > 1:
                    continue
                mask = masks.get(c, 0)
                to = (exact & mask) << 1
                # an edit: a letter replaced, one of the term left out, or one too many in the word
                also = (edited & mask) << 1 | (exact << 1) & (last * 2 - 1) | exact | to << 1 & (last * 2 - 1)
                if to or also:
                    stack.append((child, to, also, depth + 1))
        return best

    @staticmethod
    def _better(old: tuple[int, str], kind: int, term: str) -> tuple[int, str]:
        return old if old[0] and (old[0], old[1]) <= (kind, term) else (kind, term)


@dataclass
class ToxicityModel:
    words: dict[str, float]
    stems: dict[str, float]
    weights: list[float]

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.weights), -40, 40)))


@dataclass
class Hits:
    """Of a text: its words, and start, end, kind, term, quoted and addressed of each hit."""

    words: int
    found: list[tuple[int, int, int, str, bool, bool]]


def hits(text: str | None, lexicon: Lexicon) -> Hits:
    low = (text or "").lower()
    plain = _WORD.findall(low)
    terms = {w: got for w in set(plain) if (got := lexicon.find(w))[0]}
    out: list[tuple[int, int, int, str, bool, bool]] = []
    if not terms:
        return Hits(len(plain), out)
    words = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(low)]
    met = [(i, *terms[w]) for i, w in enumerate(plain) if w in terms]
    quotes = sorted(quotations(low))
    begins = [q for q, _ in quotes]
    reach = list(accumulate((e for _, e in quotes), max))  # the farthest end of the quotations so far
    for i, kind, term in met:
        start, end, _ = words[i]
        near = {w for _, _, w in words[max(0, i - CONTEXT) : i + CONTEXT + 1]}
        k = bisect_left(begins, start) - 1
        quoted = k >= 0 and end < reach[k] or not near.isdisjoint(_REPORTING)
        out.append((start, end, kind, term, quoted, not near.isdisjoint(_ADDRESS)))
    return Hits(len(words), out)


def _features(seen: Hits, lexicon: Lexicon) -> list[float]:
    weight: Counter = Counter()
    for _, _, kind, term, quoted, _ in seen.found:
        weight["quoted" if quoted else kind] += lexicon.words.get(term, 0) if kind in (1, 3) else lexicon.stems.get(term, 0)
    total = sum(weight.values())
    logs = [math.log1p(weight[k]) for k in (1, 2, 3, 4, "quoted")]
    return [1.0, *logs, math.log1p(sum(a for *_, a in seen.found)), 1.0 if weight[1] + weight[2] else 0.0, math.log1p(len({t for _, _, _, t, _, _ in seen.found})), math.log1p(20 * total / (seen.words + 20))]


def quotations(text: str) -> list[tuple[int, int]]:
    """Start and end of what stands between signs of quotation on one line, of any
    length; each sign is looked at once for each pair of signs."""
    out = []
    for opening, closing in _QUOTES:
        if opening not in text:
            continue
        at = 0
        for line in text.split("\n"):
            start = line.find(opening)
            while start >= 0:
                ends = [e for e in (line.find(c, start + 1) for c in closing) if e >= 0]
                if not ends:
                    break
                if min(ends) > start + 1:
                    out.append((at + start, at + min(ends) + 1))
                start = line.find(opening, min(ends) + (min(ends) > start + 1 or opening != closing))
            at += len(line) + 1
    return out


_LEXICONS: dict[tuple, Lexicon] = {}


def _lexicon(model: ToxicityModel) -> Lexicon:
    key = (tuple(model.words.items()), tuple(model.stems.items()))
    if key not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[key] = Lexicon(model.words, model.stems)
    return _LEXICONS[key]


def _terms(docs: DataFrame) -> DataFrame:
    """How many toxic and clean documents have each word, and each beginning of a word (marked ``*``)."""

    def count(parts):
        have: tuple[Counter, Counter] = (Counter(), Counter())

        def flush():
            names = list({**have[0], **have[1]})
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([have[1][x] for x in names], pa.int64()), pa.array([have[0][x] for x in names], pa.int64())], names=["term", "toxic", "clean"])
            have[0].clear()
            have[1].clear()
            return out

        for part in parts:
            for text, label in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                words = {m.group() for m in _WORD.finditer((text or "").lower())}
                words = {w for w in words if len(w) > 2}
                have[label].update(words)
                have[label].update({f"{w[:n]}*" for w in words for n in range(SHORTEST_STEM, min(len(w) - 1, SHORTEST_STEM + 3) + 1)})
                if len(have[0]) + len(have[1]) > 400_000:
                    yield flush()
        yield flush()

    counted = docs.select("text", "toxic").mapInArrow(tidy(count), "term string, toxic long, clean long")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _choose(rows: list[tuple[str, float]]) -> tuple[dict[str, float], dict[str, float]]:
    """Words and beginnings with their log odds; a beginning must stand for three
    words and more, and the shortest is taken."""
    words = {t: r for t, r in rows if not t.endswith("*")}
    stems: dict[str, float] = {}
    for stem, ratio in sorted(((t[:-1], r) for t, r in rows if t.endswith("*")), key=lambda x: (len(x[0]), x[0])):
        below = [w for w in words if w.startswith(stem) and w != stem]
        if len(below) >= 3 and not any(stem.startswith(s) for s in stems):
            stems[stem] = math.log(ratio)
    return {w: math.log(r) for w, r in sorted(words.items())}, stems


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", held_out: int = 5, max_rows: int = MAX_ROWS) -> ToxicityModel:
    """Lexicon and weights from at most ``max_rows`` labelled rows whose
    ``crc32(id) mod held_out`` is not 0."""
    known = labels.select(F.col(label_id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("toxic")).dropna()
    known = known.filter(F.crc32(F.col("label_id").cast("string")) % held_out != 0) if held_out else known
    known = known.dropDuplicates(["label_id"]).orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
    small_batches(docs.sparkSession)
    source = id_and_text(docs, id_col, text_col)
    labelled = source.join(F.broadcast(known), F.col("doc_id") == F.col("label_id")).select("text", F.when(F.col("toxic") == 1, 1).otherwise(0).alias("toxic"))
    labelled = cut(labelled)
    totals = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return ToxicityModel({}, {}, [])
    ratio = (F.col("toxic") / F.lit(toxic)) / ((F.col("clean") + 0.5) / F.lit(clean + 0.5))
    # a term stands in one of 50 toxic documents at least, so they are few: at most 50 times the words of a document
    picked = _terms(labelled).filter((F.col("toxic") >= max(LEAST_DOCS, toxic // 50)) & (ratio >= LEAST_RATIO))
    model = ToxicityModel(*_choose([(r["term"], r["ratio"]) for r in picked.select("term", ratio.alias("ratio")).collect()]), [])

    def one(rows: dict[str, list]) -> dict[str, list]:
        return {"toxic": rows["toxic"], "features": [_features(hits(t, _lexicon(model)), _lexicon(model)) for t in rows["text"]]}

    # at most max_rows rows of a few numbers
    fit = rowwise(labelled, "toxic int, features array<double>", one).groupBy("features", "toxic").agg(F.count("*").alias("n")).collect()
    model.weights = _logistic(np.array([r["features"] for r in fit]), np.array([r["toxic"] for r in fit], float), np.array([r["n"] for r in fit], float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.01) -> list[float]:
    """Newton's method on the ridge-penalised likelihood; the bias is not penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (n * (p - y)) + penalty * w
        hessian = (x * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step / max(1.0, float(np.abs(step).max()) / 5)
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` and ``spans`` (start, end of each hit) of each row."""

    def one(rows: dict[str, list]) -> dict[str, list]:
        lexicon = _lexicon(model)
        found = [hits(t, lexicon) for t in rows["text"]]
        scores = model.score(np.array([_features(f, lexicon) for f in found]).reshape(-1, _FEATURES))
        return {"doc_id": rows["doc_id"], "score": scores.tolist(), "predicted": [int(s >= 0.5) for s in scores], "spans": [[x for h in f.found for x in h[:2]] for f in found]}

    return rowwise(id_and_text(docs, id_col, text_col), "doc_id long, score double, predicted int, spans array<long>", one)


def remove_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns stay, and no shuffle is needed."""

    def run(parts):
        lexicon = _lexicon(model)
        for part in (p.slice(at, 512) for p in parts for at in range(0, p.num_rows, 512)):
            scores = model.score(np.array([_features(hits(t, lexicon), lexicon) for t in part.column(text_col).to_pylist()]).reshape(-1, _FEATURES))
            yield part.filter(pa.array(scores < 0.5))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(tidy(run), docs.schema)
