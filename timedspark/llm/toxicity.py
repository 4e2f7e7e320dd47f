"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from timedspark.llm.common import as_before, aside, cut

SYMBOLS = 64  # letters, digits, a word's beginning and end, and hashed other characters
SPAN = 6  # characters a subsequence of three may stretch over
DECAY = 0.6  # what each further character of its stretch takes from its weight
PIECE, STEP = 32, 20  # longer words are read in overlapping pieces
GAPS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]
START, STOP, FILL = 28, 29, 0
CACHE = 300_000  # words whose margins a task remembers at once
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
MEASURES = ["_margin", "_mass", "_words"]
APART = re.compile(r"(?:^|(?<=\s))(?:\S\s){2,}\S(?=\s|$)")


@dataclass
class Model:
    """Weight of each subsequence of three symbols, and of a text's measures in its score: worst margin, mass, words, constant."""

    weights: np.ndarray
    bias: float = 0.0
    curve: tuple[float, ...] = (0.001, 0.0, 0.0, -3.0)


def _symbol(code: int) -> int:
    if 97 <= code <= 122:
        return code - 96
    if 48 <= code <= 57:
        return 27
    return 30 + code % 34


_ASCII = np.array([_symbol(c) for c in range(128)], np.uint8)


def tokens_of(text: str) -> Counter[str]:
    """Lower-case words of a text, and words whose letters stand apart (`i d i o t`) put together, and how often they come."""
    low = text.lower()
    words = Counter(low.split())
    words.update("".join(m[0].split()) for m in APART.finditer(low))
    return words


def forms(token: str) -> list[str]:
    """A token without marks at its ends and, where marks stand inside, also without those."""
    if token.isalnum():
        return [token]
    inner = token.strip("".join(c for c in {token[0], token[-1]} if not c.isalnum())) if token else token
    while inner and not (inner[0].isalnum() and inner[-1].isalnum()):
        inner = inner[1:] if not inner[0].isalnum() else inner[:-1]
    bare = "".join(c for c in inner if c.isalnum())
    return [inner] if bare == inner else [inner, bare]


def _encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of words, a row per piece, between START and STOP where the word begins and ends; and each row's word."""
    long = [k for k, w in enumerate(words) if len(w) > PIECE]
    pieces = [w[:PIECE] for w in words]
    owner, begins, ends = list(range(len(words))), [True] * len(words), [len(w) <= PIECE for w in words]
    for k in long:
        for at in range(STEP, len(words[k]) - PIECE + STEP, STEP):
            pieces.append(words[k][at:at + PIECE])
            owner.append(k)
            begins.append(False)
            ends.append(at + PIECE >= len(words[k]))
    lengths = np.array([len(x) for x in pieces], np.int64)
    codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = np.where(codes < 128, _ASCII[np.minimum(codes, 127)], 30 + codes % 34)
    rows = np.zeros((len(pieces), PIECE + 2), np.int32)
    starts = np.array(begins, np.int64)
    rows[starts == 1, 0] = START
    row = np.repeat(np.arange(len(pieces)), lengths)
    column = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[row]
    rows[row, column] = symbols
    stop = np.array(ends)
    rows[np.flatnonzero(stop), (starts + lengths)[stop]] = STOP
    return rows, np.array(owner, np.int64)


def _parts(rows: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """For each gap pattern: its weight, the codes of the subsequences there and which of them are whole."""
    width = rows.shape[1]
    for j, k in GAPS:
        first, second, third = rows[:, :width - k], rows[:, j:width - k + j], rows[:, k:]
        yield DECAY ** (k - 2), (first * SYMBOLS + second) * SYMBOLS + third, third > FILL


def _apply(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Kernel expansion of each row against a vector over subsequences, over the row's own norm."""
    out, norm = np.zeros(len(rows)), np.zeros(len(rows))
    for decay, codes, whole in _parts(rows):
        out += decay * np.where(whole, weights[codes], 0).sum(1)
        norm += decay * decay * whole.sum(1)
    return out / np.sqrt(np.maximum(norm, 1e-9))


def kernel(rows: np.ndarray, landmarks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised kernel of every row with every landmark; the subsequences that landmarks have, and each landmark's features over its norm."""
    met = np.unique(np.concatenate([codes[whole] for _, codes, whole in _parts(landmarks)]))
    place = np.full(SYMBOLS ** 3, -1, np.int32)
    place[met] = np.arange(len(met))
    maps = np.zeros((len(met), len(landmarks)), np.float32)

    def norms(some: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(sum(decay * decay * whole.sum(1) for decay, _, whole in _parts(some)), 1e-9))

    for decay, codes, whole in _parts(landmarks):
        np.add.at(maps, (place[codes[whole]], np.nonzero(whole)[0]), decay)
    maps /= norms(landmarks)
    out = np.zeros((len(rows), len(landmarks)), np.float32)
    for decay, codes, whole in _parts(rows):
        places = np.where(whole, place[codes], -1)
        for column in range(places.shape[1]):
            for at in range(0, len(rows), 2000):
                hit = np.flatnonzero(places[at:at + 2000, column] >= 0)
                out[at + hit] += decay * maps[places[at + hit, column]]
    return out / norms(rows)[:, None], met, maps


def word_margins(words: list[str], model: Model) -> np.ndarray:
    """Margin of each word: its best form's best piece."""
    shapes = [forms(w) for w in words]
    flat = [f for s in shapes for f in s]
    out = np.full(len(words), -10.0)
    if not flat:
        return out
    word_of = np.repeat(np.arange(len(words)), [len(s) for s in shapes])
    for at in range(0, len(flat), 20_000):
        rows, owner = _encode(flat[at:at + 20_000])
        np.maximum.at(out, word_of[at + owner], _apply(rows, model.weights) + model.bias)
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss in the primal, by Newton steps over the rows inside the margin."""
    z = np.c_[x, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(50):
        inside = y * (z @ w) < 1
        a = z[inside] * (cost * weight[inside])[:, None]
        new = np.linalg.solve(ridge + a.T @ z[inside], a.T @ y[inside])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def fit_words(words: list[str], label: np.ndarray, seen: np.ndarray, hard: np.ndarray, landmarks: int, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights over subsequences from words with labels 1 and -1 and how often they were seen; landmarks are half of either kind, hard words first."""
    rows, owner = _encode(words)
    first = np.unique(owner, return_index=True)[1]
    rows = rows[first]
    weight = np.sqrt(seen)
    for side in (1.0, -1.0):
        weight[label == side] /= max(weight[label == side].sum(), 1e-9) / 500
    rng = np.random.default_rng(seed)
    order = np.argsort(-seen, kind="stable")
    positive = [k for k in order if label[k] > 0][: landmarks // 2]
    others = [k for k in rng.permutation(len(words)) if label[k] < 0]
    negative = sorted(others, key=lambda k: not hard[k])[: landmarks - len(positive)]
    chosen = positive + negative
    to_landmarks, met, maps = kernel(rows, rows[chosen])
    values, vectors = np.linalg.eigh(to_landmarks[chosen])
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    w, bias = fit_svm(to_landmarks @ root, label, weight)
    weights = np.zeros(SYMBOLS ** 3, np.float32)
    weights[met] = maps @ (root @ w)
    return weights, bias


def fit_curve(measures: np.ndarray, labels: np.ndarray) -> tuple[float, ...]:
    """Logistic regression of labels on a text's measures; targets are pulled in by the class sizes."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = np.c_[measures, np.ones(len(measures))]
    prior = np.array([1.0, 0.0, 0.0, 0.0])
    w = prior.copy()
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ z + 0.05 * np.eye(4)
        step = np.linalg.solve(hessian, z.T @ (p - target) + 0.05 * (w - prior))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(x) for x in w)


def _sentence_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of labelled sentences, each sentence with its document's label: word, toxic, doc_id and the word before."""
    for batch in batches:
        rows: set[tuple[str, int, int, str]] = set()
        for doc, text, toxic in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "toxic")), strict=True):
            for sentence in SENTENCE.split(text or ""):
                before = ""
                for token in sentence.lower().split():
                    shapes = forms(token)
                    if 1 < len(shapes[-1]) <= PIECE:
                        rows.add((shapes[-1], toxic, doc, before))
                    before = shapes[-1]
        if rows:
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["word", "toxic", "doc", "before"])


def _evidence(words: DataFrame) -> DataFrame:
    """word, toxic, clean: in how many documents, and after how many different words, whichever is less.

    Copies of one text bring the same neighbours, and one long text is one document, so neither counts as evidence of its own.
    """
    seen = lambda c, y: F.count_distinct(F.when(F.col("toxic") == y, F.col(c)))
    return words.groupBy("word").agg(F.least(seen("doc", 1), seen("before", 1)).alias("toxic"), F.least(seen("doc", 0), seen("before", 0)).alias("clean"))


def evidence_needed(totals: dict[int, int], share: float, chance: float = 0.3) -> int:
    """Toxic sightings from which a word without clean ones is no accident: fewer than `chance` such words are expected.

    `totals` has the number of words by how often they are seen, `share` is the share of toxic sightings.
    """
    for k in range(2, 40):
        if sum(n for seen, n in totals.items() if seen >= k) * share ** k < chance:
            return k
    return 40


class Memory:
    """Margins of words, worked out together for words not met before."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def of(self, sets: list[set[str]] | list[Counter[str]]) -> dict[str, float]:
        new = list(set().union(*sets) - self.known.keys())
        if len(self.known) + len(new) > CACHE:
            self.known, new = {}, list(set().union(*sets))
        self.known.update(zip(new, word_margins(new, self.model).tolist()))
        return self.known


def measure(words: Counter[str], margins: dict[str, float]) -> tuple[float, float, float]:
    """Worst margin, logarithm of the number of words on the toxic side (counted as often as they come), logarithm of the different words."""
    if not words:
        return -10.0, 0.0, 0.0
    worst, mass = -np.inf, 0.0
    for word, count in words.items():
        margin = margins[word]
        worst = max(worst, margin)
        if margin > 0:
            mass += count * min(1.0, margin)
    return worst, float(np.log1p(mass)), float(np.log1p(len(words)))


def _measures(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(model)
        for batch in batches:
            out = []
            texts = batch.column("text")
            for at in range(0, batch.num_rows, 256):
                some = texts[at:at + 256].to_pylist()
                counted = [tokens_of(t or "") for t in some]
                margins = memory.of(counted)
                out += [measure(c, margins) for c in counted]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([r[k] for r in out], pa.float64()) for k in range(3)]], [*batch.schema.names, *MEASURES])
    return run


def _worst_words(model: Model, most: int = 5, least: float = -0.7):
    """The words of a training text that come nearest to the toxic side."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(model)
        for batch in batches:
            found: dict[str, list] = {}
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 256):
                sets = [{f for t in tokens_of(x) if 1 < len(f := forms(t)[-1]) <= PIECE} if x else set() for x in texts[at:at + 256]]
                margins = memory.of(sets)
                for some in sets:
                    for word in heapq.nlargest(most, some, key=margins.__getitem__):
                        if margins[word] > least:
                            found.setdefault(word, [margins[word], 0])[1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([v for v, _ in found.values()], pa.float64()), pa.array([n for _, n in found.values()], pa.int64())], ["word", "margin", "clean"])
    return run


def held_out(doc_id: str = "doc_id"):
    """Rows that no training sees: the remainder of crc32 over the doc_id's text by 5 is 0; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 6_000, words: int = 4_000, landmarks: int = 400, rounds: int = 2) -> Model:
    """Fit on at most about `sample` labelled rows that are not held out, chosen by the hash of doc_id.

    Two thirds of the sample count words of its sentences; at most `words` of each class, and `landmarks` of these, make the machine. In
    `rounds` more rounds the clean texts' worst words join the clean side. The last third sets the curve from margins to scores. Without both labels in either part, every score is that of the
    rarer or only label seen, and 0 without labels.
    """
    rows = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = rows.count()
    share = min(1.0, sample / max(n, 1))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(101)), F.lit(1 << 20))
    rows = rows.where(draw < int(share * (1 << 20)) + (share == 1.0)).withColumn("scale", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0)
    known = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    sightings = known.where("NOT scale").select(F.xxhash64("doc_id").alias("doc"), "text", "toxic").mapInArrow(_sentence_words, "word string, toxic int, doc long, before string")
    counted = cut(_evidence(sightings))
    totals = dict(counted.groupBy(F.least(F.col("toxic") + F.col("clean"), F.lit(40)).cast("int")).count().collect())
    seen_toxic, seen = counted.agg(F.sum("toxic"), F.sum(F.col("toxic") + F.col("clean"))).first()
    if not seen_toxic or seen_toxic == seen:
        return Model(np.zeros(SYMBOLS ** 3))
    least = evidence_needed(totals, seen_toxic / seen)
    bad = counted.where((F.col("toxic") >= least) & (F.col("toxic") > 20 * F.col("clean"))).orderBy(F.desc("toxic"), "word").limit(words)
    good = counted.where("clean >= 1 AND toxic <= 4 * clean").orderBy(F.desc(F.least("clean", F.lit(3))), F.xxhash64("word")).limit(words)
    found = pd.concat([bad.withColumn("label", F.lit(1.0)).toPandas(), good.withColumn("label", F.lit(-1.0)).toPandas()], ignore_index=True)
    if found["label"].nunique() < 2:
        return Model(np.zeros(SYMBOLS ** 3))
    found["hard"] = False
    for again in range(rounds + 1):
        found["seen"] = (found["toxic"] + found["clean"]).clip(lower=1)
        weights, bias = fit_words(found["word"].tolist(), *(found[c].to_numpy() for c in ("label", "seen", "hard")), landmarks)
        model = Model(weights, bias)
        if again < rounds:
            worst = known.where("NOT scale AND toxic = 0").select("text").mapInArrow(_worst_words(model), "word string, margin double, clean long")
            worst = worst.groupBy("word").agg(F.max("margin").alias("margin"), F.sum("clean").alias("clean")).orderBy(F.desc("margin"), "word").limit(words // 2).toPandas()
            found.loc[found["word"].isin(worst["word"]) & (found["label"] < 0), "hard"] = True
            new = worst[~worst["word"].isin(found["word"])]
            found = pd.concat([found, pd.DataFrame({"word": new["word"], "toxic": 0, "clean": new["clean"], "label": -1.0, "hard": True})], ignore_index=True)
    measures = with_measures(known.where("scale").select("toxic", "text"), model).drop("text").toPandas()
    if measures["toxic"].nunique() == 2:
        model.curve = fit_curve(measures[MEASURES].to_numpy(), measures["toxic"].to_numpy(float))
    return model


def with_measures(docs: DataFrame, model: Model) -> DataFrame:
    """The table, its column `text` measured by the model: three more columns."""
    schema = StructType([*docs.schema.fields, *[StructField(m, DoubleType()) for m in MEASURES]])
    return docs.mapInArrow(_measures(model), schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, **options: int) -> DataFrame:
    """Add held_out, score (0 to 1), predicted (1 from 0.5 up) and margin to every document.

    A word's margin is its kernel expansion: subsequences of three characters, gaps of up to three allowed, weighted less the longer they
    stretch. So `i-d-i-o-t`, `idxiot` and `i d i o t` come near `idiot`. A text's score rests on its worst word, on how often words of the
    toxic side come, and on how many words it has. Nyström landmarks give the machine its features, and as the kernel is explicit, the fitted machine is
    one table of weights over subsequences, which travels with the job (1 MB). Labels count only where held_out is false; language, source and doc_id are
    not inputs of a score.

    Null, empty and wordless texts have the lowest margin. Repeated rows are scored alike; rows of `labels` that repeat a
    doc_id count once, with the larger label. Empty tables give no rows, or scores under one half. Columns named like the added ones are kept under longer names.
    """
    docs = aside(docs, *MEASURES, "held_out", "score", "predicted", "margin")
    model = train(docs, labels, **options)
    logit = sum((F.lit(w) * F.col(m) for w, m in zip(model.curve, MEASURES)), F.lit(model.curve[-1]))
    score = 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))))
    return with_measures(docs, model).select(*docs.columns, held_out().alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col(MEASURES[0]).alias("margin"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **options: int) -> DataFrame:
    """The documents whose score is under one half, with the columns they came with."""
    kept = score_toxicity(docs, labels, **options).where("predicted = 0")
    return as_before(kept, docs)
