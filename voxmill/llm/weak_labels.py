"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every text. Expectation-maximisation over the counts of vote patterns of all
documents (at most 3 ** labellers rows, whatever the corpus) estimates each labeller's vote distribution for good and bad texts and the posterior of every
pattern. Posterior labels of a bounded sample (`sample` rows, half from either side, by smallest hash) train a hashed linear scorer, which then scores every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hidden, slices, written

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_UPPER, _LETTER = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[^\W\d_]")
#: Function words of the four languages.
FUNCTION_WORDS = frozenset(
    """a an and are as at be by for from had has have he her his in is it not of on or she that the this to was were which with
    au aux avec ce dans de des du elle en est et il la le les ne par pas pour qui sur un une vous
    auf das dem den der des die ein eine es für im ist mit nicht sich und von zu
    al como con del el ella esta lo los las no por que se su una uno y""".split()
)
_ENDS = frozenset(".,;:?!)]}\"'”»…-")
DIMENSIONS = 1 << 18
LABELLERS = 9
GOOD, BAD, NONE = 1, 2, 0


def _vote(x: float, good: float, bad: float) -> int:
    """Good up to one bound, bad from the other, in whichever order they lie."""
    if good < bad:
        return GOOD if x <= good else BAD if x >= bad else NONE
    return GOOD if x >= good else BAD if x <= bad else NONE


def _twins(words: list[str]) -> int:
    """Words that equal the word before."""
    return sum(map(str.__eq__, words[1:], words))


def votes(text: str | None) -> tuple[int, ...]:
    """The labellers' votes. A text without words gets none."""
    words = _WORD.findall(text or "")
    n = len(words)
    if not n:
        return (NONE,) * LABELLERS
    size = sum(map(len, words))
    counts = Counter(words)
    letters = len(_LETTER.findall(text))
    odd = sum(k for w, k in counts.items() if not w[-1].isalnum() and (w[-1] not in _ENDS or len(w) > 1 and w[-2] in "!?"))
    lone = sum(k for w, k in counts.items() if len(w) == 1 and not w.isalnum())
    common = sum(k for w, k in counts.items() if w.strip(".,;:").lower() in FUNCTION_WORDS)
    return (
        _vote(len(_SYMBOL.findall(text)) / size, 0.005, 0.05),
        _vote(len(_UPPER.findall(text)) / max(1, letters), 0.25, 0.6) if letters >= 20 else NONE,
        _vote(odd / n, 0.05, 0.3),
        _vote(max(counts.values()) / n, 0.2, 0.4) if n >= 20 else NONE,
        _vote(_twins(words) / n, 0.05, 0.2) if n >= 10 else NONE,
        _vote(len(counts) / min(n, 200), 0.3, 0.15) if n >= 20 else NONE,
        _vote(lone / n, 0.02, 0.2),
        _vote(common / n, 0.08, 0.02) if n >= 30 else NONE,
        _vote(abs(size / n - 6), 3, 6) if n >= 20 else NONE,
    )


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Latent-class vote model: (posterior of bad per pattern, P(bad vote | class, a vote) [labeller, good or bad], share of bad).

    Labellers overlap, and each sees only some kinds of badness; so bad is a mixture of as many kinds as there are labellers, each
    begun from the patterns in which its labeller votes bad (a single bad vote counts half). Within a kind votes are independent. Missing votes say
    nothing, or short texts, on which many labellers are silent, would become a class of their own.
    """
    bad, good = (patterns == BAD).astype(float), (patterns == GOOD).astype(float)
    n_bad = bad.sum(1, keepdims=True)
    sure = np.where(n_bad >= 2, 0.95, np.where(n_bad == 1, 0.5, 0.0))
    post = np.hstack([1 - sure, sure * bad / np.maximum(1, n_bad)])
    for _ in range(rounds):
        w = post * counts[:, None]
        share = (w.sum(0) + 0.01) / (w.sum() + 0.01 * w.shape[1])
        b, g = w.T @ bad, w.T @ good
        theta = np.clip((b + 0.1) / (b + g + 1.1), 1e-6, 1 - 1e-6)  # [class, labeller]
        logs = bad @ np.log(theta).T + good @ np.log(1 - theta).T + np.log(share)
        new = np.exp(logs - logs.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    w = post * counts[:, None]
    b, g = w.T @ bad, w.T @ good
    rates = np.stack([(b[0] + 0.1) / (b[0] + g[0] + 1.1), (b[1:].sum(0) + 0.1) / (b[1:].sum(0) + g[1:].sum(0) + 1.1)], 1)
    return 1 - post[:, 0], rates, float(share[1:].sum())


def _shape(word: str) -> str:
    """Letters to x or X, digits to 9, runs cut to two, so that shapes are few."""
    out = []
    for ch in word:
        s = "X" if ch.isupper() else "x" if ch.isalpha() else "9" if ch.isdigit() else ch
        if len(out) < 2 or s != out[-1] or s != out[-2]:
            out.append(s)
    return "".join(out)


def _slots(*keys: str) -> list[int]:
    return [xxhash.xxh32_intdigest(k.encode()) % DIMENSIONS for k in keys]


def _word_slots(word: str) -> list[int]:
    return _slots("w " + word.lower(), "s " + _shape(word), "e " + word[-3:])


def _text_slots(words: list[str]) -> list[int]:
    """Features of the whole text: how often words repeat, the share of the most frequent one and of words like the one before, in coarse steps."""
    n, counts = len(words), Counter(words)
    return _slots(f"distinct {len(str(bin(n)))} {8 * len(counts) // max(1, n)}", f"top {10 * max(counts.values(), default=0) // max(1, n)}", f"twins {10 * _twins(words) // max(1, n)}")


def features(text: str | None) -> dict[int, float]:
    words = _WORD.findall(text or "")
    out: Counter = Counter()
    for w, k in Counter(words).items():
        for s in _word_slots(w):
            out[s] += k / len(words)
    for s in _text_slots(words):
        out[s] += 1.0
    return dict(out)


def train(rows: list[tuple[dict[int, float], float]], rounds: int = 150, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels (posterior of bad), both sides weighted alike, by gradient steps with AdaGrad. Positive scores are good."""
    weights, bias = np.zeros(DIMENSIONS), 0.0
    if not rows:
        return weights, 1.0
    y = 1 - np.array([p for _, p in rows])
    if y.min() > 0.5 or y.max() < 0.5:
        return weights, 1.0 if y.min() > 0.5 else -1.0
    row = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    col = np.concatenate([np.fromiter(f.keys(), np.int64, len(f)) for f, _ in rows])
    val = np.concatenate([np.fromiter(f.values(), float, len(f)) for f, _ in rows])
    importance = np.where(y > 0.5, 0.5 / (y > 0.5).sum(), 0.5 / (y <= 0.5).sum())
    g2, b2 = np.full(DIMENSIONS, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(row, weights[col] * val, len(rows)) + bias
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * importance
        g = np.bincount(col, err[row] * val, DIMENSIONS) + ridge * weights
        g2 += g * g
        b2 += err.sum() ** 2
        weights -= 0.5 * g / np.sqrt(g2)
        bias -= 0.5 * err.sum() / b2**0.5
    return weights, bias


def _patterns(docs: DataFrame) -> DataFrame:
    """(key, pattern) of every text, written: key tells texts apart for sampling, pattern has a digit of base 3 for each vote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [sum(v * 3**i for i, v in enumerate(votes(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.int32())], ["key", "pattern"])

    return written(docs.select(F.xxhash64("text").alias("key"), "text").mapInArrow(run, "key long, pattern int"), "votes")


def fit(docs: DataFrame, sample: int = 4096) -> tuple[np.ndarray, float]:
    """The scorer (weights, bias) for docs (text)."""
    seen = _patterns(docs)
    rows = seen.groupBy("pattern").agg(F.count("*").alias("n")).collect()
    if not rows:
        return np.zeros(DIMENSIONS), 1.0
    codes = np.array([r.pattern for r in rows])
    patterns = np.stack([codes // 3**i % 3 for i in range(LABELLERS)], 1)
    post = dict(zip(codes.tolist(), em(patterns, np.array([r.n for r in rows], float))[0].tolist(), strict=True))
    spark = docs.sparkSession
    told = spark.createDataFrame(list(post.items()), "pattern int, post double")
    keyed = seen.join(told, "pattern").groupBy("key").agg(F.first("post").alias("post"))
    half = lambda side: keyed.filter(side).orderBy(F.hash("key"), "key").limit(sample // 2)
    chosen = half(F.col("post") > 0.5).unionByName(half(F.col("post") <= 0.5))
    chosen = spark.createDataFrame(chosen.collect(), chosen.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("post"), pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.float32()))], ["key", "post", "slots", "parts"])

    texts = docs.select(F.xxhash64("text").alias("key"), "text").join(F.broadcast(chosen), "key")
    got = texts.mapInArrow(run, "key long, post double, slots array<int>, parts array<float>").dropDuplicates(["key"]).collect()
    return train([(dict(zip(r.slots, r.parts, strict=True)), r.post) for r in sorted(got, key=lambda r: r.key)])


def scored(docs: DataFrame, model: tuple[np.ndarray, float], out: str = "score") -> DataFrame:
    """docs with the scorer's value in the column out (double; 0 or more: good). A text without words has the scorer's bias and the value of its emptiness."""
    weights, bias = model[0].astype(np.float32), model[1]
    box = docs.sparkSession.sparkContext.broadcast(weights)  # DIMENSIONS values, whatever the corpus
    names = [c for c in docs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, known = box.value, {}
        for batch in slices(batches):
            values = []
            for text in batch.column("text").to_pylist():
                words = _WORD.findall(text or "")
                if len(known) > 300_000:
                    known.clear()
                for x in words:
                    if x not in known:
                        known[x] = float(w[_word_slots(x)].sum())
                values.append(bias + sum(map(known.__getitem__, words)) / max(1, len(words)) + float(w[_text_slots(words)].sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(values, pa.float64())], [*names, out])

    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema if x.name in names), f"`{out}` double"])
    return docs.select(*names).mapInArrow(run, schema)


def classify(docs: DataFrame, sample: int = 4096) -> DataFrame:
    """doc_id, score, kept of every row of docs (doc_id, text; others are ignored).

    A null text is an empty one, which gets no votes and the scorer's value of emptiness. Whole texts are scored, however long. Equal texts have equal scores and
    train the scorer once; a score of 0 is kept; null ids and repeated rows stay rows of their own. No rows give none.
    """
    return scored(docs.select("doc_id", "text"), fit(docs, sample)).select("doc_id", "score", (F.col("score") >= 0).alias("kept"))


def keep_good(docs: DataFrame, sample: int = 4096) -> DataFrame:
    """The rows of docs that score 0 or more, with all columns, whatever they are called; cases as in classify()."""
    (score,) = hidden(docs, "score")
    return scored(docs, fit(docs, sample), score).filter(F.col(score) >= 0).select(*docs.columns)
