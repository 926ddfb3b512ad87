"""Toxicity of deobfuscated text: a noisy-channel decoder, then learned word evidence."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from corpuslens.llm.staging import bounded_batches, stage

# --------------------------------------------------------------- language model

#: Symbol classes: 0 ends a word, 1-26 are a-z, 27 digits, 28-63 other letters.
CLASSES = 64


@lru_cache(maxsize=1 << 16)
def symbol(char: str) -> int:
    low = char.lower()[:1]
    if "a" <= low <= "z":
        return ord(low) - 96
    if low.isdigit():
        return 27
    return 28 + ord(low) % 36 if low.isalpha() else 0


def _symbols() -> np.ndarray:
    return np.array([symbol(chr(c)) if not 0xD800 <= c < 0xE000 else 0 for c in range(0x3000)], dtype=np.uint8)


_TABLE: list[np.ndarray] = []


def symbols_of(text: str) -> np.ndarray:
    """Classes of all characters; those from U+3000 on count as letters by their number."""
    if not _TABLE:
        _TABLE.append(_symbols())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 0x3000, _TABLE[0][np.minimum(points, 0x2FFF)], 28 + points % 36)


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of all three-symbol runs in all whole texts (CLASSES ** 3 numbers)."""

    def run(batches):
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            held, size = [], 0
            for value in [*batch.column(0), None]:
                if value is not None and value.is_valid:
                    held.append(value.as_py())
                    size += len(held[-1])
                if size > 500_000 or value is None:
                    s = symbols_of("\n\n" + "\n\n".join(held) + "\n\n").astype(np.int64)
                    total += np.bincount((s[:-2] * CLASSES + s[1:-1]) * CLASSES + s[2:], minlength=CLASSES**3)
                    held, size = [], 0
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["run", "n"])

    rows = docs.select(text).mapInArrow(run, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))
    out = np.zeros(CLASSES**3, np.int64)
    for run_, n in rows.collect():  # at most CLASSES ** 3 rows, whatever the corpus
        out[run_] = n
    return out


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), interpolated with the bigram and the single symbol (Witten-Bell weights)."""
    tri = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    one = (uni + 1) / (uni.sum() + CLASSES)

    def blend(n, lower):
        total, kinds = n.sum(axis=-1, keepdims=True), (n > 0).sum(axis=-1, keepdims=True) + 1
        return (n + kinds * lower) / (total + kinds)

    return np.log(blend(tri, blend(bi, one))).astype(np.float32)


# --------------------------------------------------------------------- decoding

# Letters that a sign is commonly written for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "{": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = ".-_*'`~^,:;/\\·•"
#: Log costs of the channel: writing a sign for a letter, adding a sign that could be a
#: letter, repeating a letter (first and further times), one letter written twice, a
#: separator or space within a word, a space that is a true word end among single letters.
SWAP, EXTRA, REPEAT, AGAIN, TWICE, SPLIT, WORD_END = -1.5, -12.0, -2.0, -0.2, -5.0, -1.0, -5.0
#: Adding a sign that could be a letter in front of a word.
FRONT = -8.0
EDGES = ".,;:!?\"'()[]{}<>«»“”‘’…-–—*#&%"
#: An exclamation mark in front of a word may be its first letter.
OPENING = EDGES.replace("!", "") + "¡¿"
_TAIL = re.compile(r"(.)\1{2,}$")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_SPACED = re.compile(r"(?<!\S)(?:[^\s\x00-\x20]\s+){2,}\S(?!\S)")
_LETTER = re.compile(r"[^\W\d_]")
_BETWEEN = re.compile(f"[^{re.escape(SEPARATORS)}]{{2,}}")
_LETTERS = re.compile(r"[^\W\d_]+")
#: Tokens whose evidence a Python worker remembers, and word features a task adds up.
MEMO = 100_000
_HELD: dict[str, dict[str, float]] = {}


def _remembered(name: str) -> dict[str, float]:
    """Evidence of tokens under a model, from task to task; a worker keeps that of two models."""
    held = _HELD.get(name)
    if held is None:
        if len(_HELD) > 1:
            _HELD.clear()
        held = _HELD[name] = {}
    return held



def stripped(token: str) -> str:
    """The token without punctuation around it and without a tail of one sign repeated."""
    token = token.rstrip(EDGES).lstrip(OPENING)
    if token and not token[-1].isalnum():
        tail = _TAIL.search(token)
        if tail:
            token = token[: tail.start()].rstrip(EDGES)
    return token


def is_noisy(core: str) -> bool:
    """Whether a token's lattice has more than the path that leaves it as it is."""
    if core.isalpha():
        return bool(_DOUBLE.search(core.lower()))
    return bool(_LETTER.search(core)) and not core.isdigit()


def lattice(core: str) -> list[list[tuple[str, float]]]:
    """For each run of one character the strings it may stand for, with log costs.
    A sign in front may be no letter at all."""
    out = []
    for match in re.finditer(r"(.)\1*", core.lower(), re.S):
        char, n = match.group(1), len(match.group(0))
        more = REPEAT + AGAIN * (n - 2)
        if char.isalpha():
            arcs = [(char * n, 0.0)]
            if n >= 2:
                arcs.append((char, TWICE if n == 2 else more))
            if n >= 3:
                arcs.append((char * 2, more))
        else:
            arcs = [(char * n, 0.0)] if char.isdigit() else []
            for letter in LEET.get(char, ""):
                arcs.append((letter * min(n, 2), SWAP * min(n, 2) + AGAIN * max(0, n - 2)))
                if n >= 2:
                    arcs.append((letter, SWAP + more))
            arcs.append(("", SPLIT if char not in LEET else EXTRA if out or char.isdigit() else FRONT))
            if char in SEPARATORS:
                arcs.append((" ", 0.0))
        out.append(arcs)
    return out


_FLAT: list = [None, None]


def _flat(model: np.ndarray) -> list[float]:
    """The model as plain numbers, which are read one by one several times as fast."""
    if _FLAT[0] is not model:
        _FLAT[:] = model, model.ravel().tolist()
    return _FLAT[1]


def viterbi(arcs: list[list[tuple[str, float]]], model: np.ndarray) -> str:
    """The likeliest string through the lattice; a state is the last two symbols and holds
    its string as a chain of parts, so that time grows with the length alone."""
    model = _flat(model)
    states: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    for options in arcs:
        nxt: dict[int, tuple[float, tuple]] = {}
        coded = [(string, cost, [symbol(c) for c in string]) for string, cost in options]
        for state, (score, text) in states.items():
            for string, cost, symbols in coded:
                at, total = state, score + cost
                for c in symbols:
                    at = at * CLASSES + c
                    total += model[at]
                    at %= CLASSES * CLASSES
                if at not in nxt or total > nxt[at][0]:
                    nxt[at] = (total, (text, string))
        states = nxt
    _, chain = max(((s + model[at * CLASSES], t) for at, (s, t) in states.items()), key=lambda r: r[0], default=(0.0, ()))
    parts = []
    while chain:
        chain, part = chain
        parts.append(part)
    return "".join(reversed(parts))


def spellings(core: str) -> list[str] | None:
    """All strings of the lattice of a word of letters; none where they would be many."""
    arcs = lattice(core)
    if sum(len(options) > 1 for options in arcs) > 4:
        return None
    return ["".join(s for s, _ in path) for path in product(*arcs)]


def decode(core: str, model: np.ndarray) -> list[str]:
    """Restored words of a token, lower case; of a long one also those of what stands
    between its separators, since it may be a list."""
    if not is_noisy(core):
        return [core.lower()] if core else []
    words = _LETTERS.findall(viterbi(lattice(core), model))
    pieces = _BETWEEN.findall(core) if len(core) > 64 else []
    return words + [w for piece in pieces if piece != core for w in decode(stripped(piece), model)]


def decode_spaced(run: str, model: np.ndarray) -> list[str]:
    """Restored words of single characters with white space between them: every gap may be
    the writer's or a true word end."""
    arcs = []
    for i, char in enumerate(run.split()):
        if i:
            arcs.append([("", SPLIT), (" ", WORD_END)])
        arcs.extend(lattice(char))
    return _LETTERS.findall(viterbi(arcs, model))


# --------------------------------------------------------------------- evidence

PREFIXES = (4, 5, 6, 7)


def features(word: str) -> Iterable[str]:
    """A word as such, and its beginnings: endings vary, stems tell."""
    yield "=" + word
    for n in PREFIXES:
        if len(word) >= n:
            yield word[:n]


@dataclass
class Toxicity:
    """A fitted model; its size does not depend on the corpus."""

    model: np.ndarray
    weights: dict[str, float]
    scale: list[float]
    name: str = field(default_factory=lambda: uuid.uuid4().hex, repr=False, compare=False)

    def restored(self, text: str) -> set[str]:
        """Distinct restored words of a text."""
        return set().union(*map(self._token, set(text.split())), *(decode_spaced(m.group(0), self.model) for m in _SPACED.finditer(text)))

    def _token(self, token: str) -> list[str]:
        return decode(stripped(token), self.model)

    def _evidence(self, token: str) -> float:
        """Largest evidence among the restored words of a token."""
        held = _remembered(self.name)
        weight = held.get(token)
        if weight is None:
            weight = self._core_evidence(stripped(token))
            if len(token) < 64:
                if len(held) >= MEMO:
                    held.clear()
                held[token] = weight
        return weight

    def _core_evidence(self, core: str) -> float:
        """As of the decoded token; a word of letters is decoded only if one of the strings
        of its lattice carries evidence."""
        if not core.isalpha():
            return self._weight(decode(core, self.model))
        word = core.lower()
        if not _DOUBLE.search(word):
            return self._weight([word])
        strings = spellings(core)
        if strings is not None and not any(self._weight(_LETTERS.findall(s)) for s in strings):
            return 0.0
        return self._weight(decode(core, self.model))

    def _weight(self, words: list[str]) -> float:
        """Largest weight of the features of words."""
        best, weight = 0.0, self.weights.get
        for word in words:
            best = max(best, weight("=" + word, 0.0), *[weight(word[:n], 0.0) for n in PREFIXES if len(word) >= n])
        return best

    def summary(self, text: str | None) -> tuple[float, float]:
        """Largest evidence of a word, and the logarithm of how many words carry any."""
        if not text:
            return 0.0, 0.0
        found = [w for w in map(self._evidence, set(text.split())) if w]
        found += [w for m in _SPACED.finditer(text) if (w := self._weight(decode_spaced(m.group(0), self.model)))]
        return max(found, default=0.0), math.log1p(len(found))

    def score(self, text: str | None) -> float:
        a, b = self.summary(text)
        z = self.scale[0] + self.scale[1] * a + self.scale[2] * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Ridge logistic regression by Newton steps; the intercept is free."""
    x = np.column_stack([np.ones(len(y)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


COUNTS = ("clean0", "toxic0", "clean1", "toxic1")


def _weights(counted: DataFrame, columns: Iterable[str], most: int) -> dict[str, float]:
    """Lower bounds of the log odds of the features that speak for label 1, the ``most`` largest."""
    clean, toxic = (sum(F.col(c) for c in columns if c.startswith(kind)) for kind in ("clean", "toxic"))
    both = counted.select("feature", clean.alias("clean"), toxic.alias("toxic"))
    total = both.where("feature = ''").first()
    if not total:
        return {}
    p, q = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(p / (total["toxic"] + 1)) - F.log(q / (total["clean"] + 1)) - F.sqrt(1 / p + 1 / q)
    best = both.where("feature <> '' and toxic >= 3").withColumn("w", odds).where("w > 0.7")
    return {r["feature"]: r["w"] for r in best.orderBy(F.desc("w"), "feature").limit(most).collect()}


def fit(
    docs: DataFrame, labels: DataFrame, allowed: Column | None = None, most_labels: int = 20_000, most_features: int = 5_000,
    label: str = "toxic",
) -> Toxicity:
    """Learn from labelled documents.

    The character model counts all whole texts. The classifier is fitted on at most
    ``most_labels`` labelled rows, those of the smallest hash of their id, and keeps at
    most ``most_features`` word features; ``allowed`` (a condition on doc_id) says which
    labels may be seen. Half of the sample weighs the features by a lower bound of their
    log odds and the other half is summarised by them, and the other way round; on these
    summaries two coefficients are fitted, and the final weights are those of the whole
    sample. Labels of documents that are
    not there, null labels and null ids are left out. Without any label every document
    gets the score 0.5 at most; with one class only, no word is evidence.
    """
    bounded_batches(docs.sparkSession)
    model = log_model(trigram_counts(docs))
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(allowed) if allowed is not None else known
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most_labels)
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int")
    rows = stage(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(part.alias("part"), "y", "text"), "labelled")

    def count(batches):
        def rows_of(total):
            columns = [pa.array([n[k] for n in total.values()], pa.int64()) for k in range(4)]
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *columns], names=["feature", *COUNTS])

        reader, total = Toxicity(model, {}, []), {}
        for batch in batches:
            for half, y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = {f for w in reader.restored(text.as_py() or "") for f in features(w)}
                for f in [*found, ""]:
                    total.setdefault(f, [0] * 4)[2 * half + y] += 1
                if len(total) > MEMO:
                    yield rows_of(total)
                    total = {}
        yield rows_of(total)

    counted = rows.mapInArrow(count, "feature string, " + ", ".join(f"{c} long" for c in COUNTS))
    counted = stage(counted.groupBy("feature").agg(*[F.sum(c).alias(c) for c in COUNTS]), "evidence")
    halves = [_weights(counted, COUNTS[2 * k : 2 * k + 2], most_features) for k in (0, 1)]
    readers = [Toxicity(model, halves[1], []), Toxicity(model, halves[0], [])]  # each half is read with the other's

    def summarise(batches):
        for batch in batches:
            halves_, ys = batch.column(0).to_pylist(), batch.column(1)
            got = [readers[h].summary(t.as_py()) for h, t in zip(halves_, batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [ys, pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64())], names=["y", "a", "b"]
            )

    seen = rows.mapInArrow(summarise, "y int, a double, b double").collect()
    weights = _weights(counted, COUNTS, most_features)
    if not seen:
        return Toxicity(model, weights, [0.0, 0.0, 0.0])
    data = np.array([[r["y"], r["a"], r["b"]] for r in seen], dtype=float)
    return Toxicity(model, weights, _logistic(data[:, 1:], data[:, 0]))


def _as_struct(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as one struct, whatever their names."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("document"))


def score_toxicity(docs: DataFrame, fitted: Toxicity, cut: float = 0.3) -> DataFrame:
    """The rows with score (0 to 1) and predicted (1 from ``cut`` on) behind their columns.

    Only the text is read for it. Null and empty texts get the score of a text without
    evidence; long texts are read whole; an empty table gives no rows; columns named
    score or predicted are replaced.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    rows, at = _as_struct(docs, kept), kept.index("text")
    schema = StructType([rows.schema["document"]]).add("score", DoubleType()).add("predicted", IntegerType())

    def run(batches):
        for batch in batches:
            scores = [fitted.score(t.as_py()) for t in batch.column(0).field(at)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= cut) for s in scores], pa.int32())],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema).select("document.*", "score", "predicted")


def drop_toxic(docs: DataFrame, fitted: Toxicity, cut: float = 0.3) -> DataFrame:
    """The documents that score below ``cut``, all columns as they were, whatever their names."""
    rows, at = _as_struct(docs, docs.columns), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([fitted.score(t.as_py()) < cut for t in batch.column(0).field(at)], pa.bool_()))

    return rows.mapInArrow(run, StructType([rows.schema["document"]])).select("document.*")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never seen: crc32 of the id as text, mod 4, is 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2
