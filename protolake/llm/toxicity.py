"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A position's input is a word: its own hashed embedding beside the mean of the
hashed embeddings of its marked character n-grams. Forward and backward gated
recurrent units read a window of words, attention pools their states, and a
logistic unit scores the window. All overlapping windows of a text are scored;
the text's score is that of its highest window, calibrated on rows that the
training left out.

Training is on the driver, on a bounded sample of labelled rows. Labels are of
texts, so first random windows take their text's label, then each text's
highest window among a random run of them does, while half of the clean windows
come from the highest ones of all clean texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from protolake.llm.kernels import give_back, ragged
from protolake.llm.labels import is_held_out, labelled_rows
from protolake.llm.rows import judged
from protolake.llm.words import Words, read_words

WINDOW, STRIDE = 16, 8
#: Lengths of the character n-grams, in bytes, with word marks.
SIZES = (3, 4, 5)
WORD_BUCKETS, CHAR_BUCKETS = 1 << 14, 1 << 15
WORD_WIDTH, CHAR_WIDTH, HIDDEN, ATTENTION = 8, 12, 8, 8
#: Bytes between words: ASCII but letters, digits and the marks that stand for letters.
BREAK = np.array([c < 0x80 and not chr(c).isalnum() and chr(c) not in "@$*#" for c in range(256)])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word in the text, and length of all overlapping windows; texts without words have none."""
    n = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(counts)), n)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    return text, start, np.minimum(WINDOW, counts[text] - start)


def new_parameters(rng: np.random.Generator) -> dict[str, np.ndarray]:
    d, h = WORD_WIDTH + CHAR_WIDTH, HIDDEN
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2]), shape).astype(np.float32)
    zero = lambda *shape: np.zeros(shape, np.float32)
    return {
        "words": rng.normal(0, 0.02, (WORD_BUCKETS, WORD_WIDTH)).astype(np.float32), "chars": rng.normal(0, 0.05, (CHAR_BUCKETS, CHAR_WIDTH)).astype(np.float32),
        "input": draw(d, 6 * h), "bias": zero(6 * h), "gates": draw(2, h, 2 * h), "state": draw(2, h, h),
        "look": draw(2 * h, ATTENTION), "look_bias": zero(ATTENTION), "look_out": draw(ATTENTION, 1), "out": draw(2 * h, 1), "out_bias": zero(1),
    }


def forward(p: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows. x: (T, B, 6H) projected inputs, forward direction first; mask: (T, B)."""
    steps, b, h = len(x), x.shape[1], HIDDEN
    both = np.stack([x[:, :, : 3 * h], x[::-1, :, 3 * h :]], 1)  # (T, 2, B, 3H)
    on = np.stack([mask, mask[::-1]], 1)[..., None]
    state = np.zeros((2, b, h), np.float32)
    states, kept = np.empty((steps, 2, b, h), np.float32), []
    for t in range(steps):
        zr = sigmoid(both[t, :, :, : 2 * h] + state @ p["gates"])
        z, r = zr[..., :h], zr[..., h:]
        gated = r * state
        c = np.tanh(both[t, :, :, 2 * h :] + gated @ p["state"])
        move = z * on[t]
        if keep:
            kept.append((state, z, r, gated, c))
        state = state + move * (c - state)
        states[t] = state
    joined = np.concatenate([states[:, 0], states[::-1, 1]], -1)  # (T, B, 2H), in the order of words
    seen = np.tanh(joined @ p["look"] + p["look_bias"])
    weight = (seen @ p["look_out"])[..., 0] + np.where(mask, 0, np.float32(-1e9))
    weight = np.exp(weight - weight.max(0))
    weight /= weight.sum(0)
    pooled = np.einsum("tb,tbh->bh", weight, joined)
    logit = (pooled @ p["out"])[:, 0] + p["out_bias"][0]
    return logit, (on, kept, joined, seen, weight, pooled)


def backward(p: dict[str, np.ndarray], cache, d_logit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the dense parameters but the input's, and of x."""
    on, kept, joined, seen, weight, pooled = cache
    steps, h = len(joined), HIDDEN
    g = {"out": pooled.T @ d_logit[:, None], "out_bias": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * p["out"][:, 0]
    d_weight = np.einsum("bh,tbh->tb", d_pooled, joined)
    d_score = weight * (d_weight - (weight * d_weight).sum(0))
    d_seen = d_score[..., None] * p["look_out"][:, 0] * (1 - seen**2)
    g["look_out"] = np.einsum("tba,tb->a", seen, d_score)[:, None]
    g["look"], g["look_bias"] = np.einsum("tbh,tba->ha", joined, d_seen), d_seen.sum((0, 1))
    d_joined = weight[..., None] * d_pooled + d_seen @ p["look"].T
    d_states = np.stack([d_joined[..., :h], d_joined[::-1, :, h:]], 1)
    g["gates"], g["state"] = np.zeros_like(p["gates"]), np.zeros_like(p["state"])
    d_both = np.empty((steps, 2, joined.shape[1], 3 * h), np.float32)
    d_next = np.zeros_like(d_states[0])
    for t in range(steps - 1, -1, -1):
        state, z, r, gated, c = kept[t]
        d = d_states[t] + d_next
        move = z * on[t]
        d_c = d * move * (1 - c**2)
        d_z = d * (c - state) * on[t] * z * (1 - z)
        d_gated = d_c @ p["state"].transpose(0, 2, 1)
        d_r = d_gated * state * r * (1 - r)
        d_zr = np.concatenate([d_z, d_r], -1)
        d_next = d * (1 - move) + d_gated * r + d_zr @ p["gates"].transpose(0, 2, 1)
        g["gates"] += state.transpose(0, 2, 1) @ d_zr
        g["state"] += gated.transpose(0, 2, 1) @ d_c
        d_both[t] = np.concatenate([d_zr, d_c], -1)
    return g, np.concatenate([d_both[:, 0], d_both[::-1, 1]], -1)


@dataclass
class Subwords:
    """Distinct words' buckets, word by word."""

    word: np.ndarray
    spots: np.ndarray
    first: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, words: Words, which=slice(None)) -> Subwords:
        spots, whose = words.subwords(CHAR_BUCKETS, SIZES, which, ordered=True)
        n = len(words.hashes[which])
        count = np.bincount(whose, minlength=n)
        return cls((words.hashes[which] % np.uint64(WORD_BUCKETS)).astype(np.int32), spots, np.cumsum(count) - count, count)

    def vectors(self, p: dict[str, np.ndarray]) -> np.ndarray:
        chars = np.add.reduceat(p["chars"][self.spots], self.first, axis=0) / self.count[:, None]
        return np.concatenate([p["words"][self.word], chars.astype(np.float32)], 1)

    def inputs(self, p: dict[str, np.ndarray], block: int = 8192) -> np.ndarray:
        """Projected inputs of all words, a block of them at a time."""
        out = np.empty((len(self.word), 6 * HIDDEN), np.float32)
        for a in range(0, len(out), block):
            out[a : a + block] = self.some(np.arange(a, min(a + block, len(out)))).vectors(p) @ p["input"] + p["bias"]
        return out

    def some(self, which: np.ndarray) -> Subwords:
        count = self.count[which]
        return Subwords(self.word[which], self.spots[ragged(self.first[which], count)], np.cumsum(count) - count, count)


@dataclass
class ToxicityModel:
    """sharpness, shift: calibration of the highest window's logit. Keeps projected inputs of words it has met."""

    parameters: dict[str, np.ndarray]
    sharpness: float = 1.0
    shift: float = 0.0
    most_words: int = 80_000
    _known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    _rows: np.ndarray = field(default_factory=lambda: np.zeros((0, 6 * HIDDEN), np.float32))

    def _inputs(self, words: Words) -> np.ndarray:
        """Projected input of each distinct word."""
        p = self.parameters
        at = np.minimum(np.searchsorted(self._known, words.hashes), max(0, len(self._known) - 1))
        new = self._known[at] != words.hashes if len(self._known) else np.ones(words.n, bool)
        out = np.empty((words.n, 6 * HIDDEN), np.float32)
        out[~new] = self._rows[at[~new]]
        if new.any():
            fresh = np.flatnonzero(new)
            out[fresh] = Subwords.of(words, fresh).inputs(p)
            if len(self._known) + len(fresh) > self.most_words:
                self._known, self._rows = self._known[:0], self._rows[:0]
            if len(fresh) <= self.most_words:
                every = np.concatenate([self._known, words.hashes[fresh]])
                order = np.argsort(every)
                self._known, self._rows = every[order], np.concatenate([self._rows, out[fresh]])[order]
        return out

    def highest(self, texts: list[str | None], batch: int = 1024) -> np.ndarray:
        """The highest logit of each text's windows; -inf without words."""
        words = read_words(texts, BREAK)
        best = np.full(len(texts), -np.inf)
        if not words.n:
            return best
        inputs = self._inputs(words)
        counts = np.bincount(words.doc, minlength=len(texts))
        text, start, length = windows_of(counts)
        at = (np.cumsum(counts) - counts)[text] + start
        steps = np.arange(WINDOW)
        logits = np.empty(len(text), np.float32)
        for a in range(0, len(text), batch):
            part = slice(a, a + batch)
            mask = steps[:, None] < length[part]
            place = np.minimum(at[part] + steps[:, None], len(words.code) - 1)
            logits[part] = forward(self.parameters, inputs[words.code[place]], mask)[0]
        np.maximum.at(best, text, logits)
        return best

    def score(self, texts: list[str | None]) -> np.ndarray:
        logit = self.highest(texts)
        return np.where(np.isfinite(logit), sigmoid(self.sharpness * np.nan_to_num(logit, neginf=0) + self.shift), 0.0)


def train_toxicity(texts: list[str], labels: list[int], prior: float = 0.1, steps: int = 2400, batch: int = 64, rate: float = 0.01, seed: int = 1) -> ToxicityModel:
    """Half of each batch is toxic. A fifth of the rows is left out and calibrates; prior: the toxic share of all labels."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.int64)
    p = new_parameters(rng)
    words = read_words(texts, BREAK)
    give_back()
    counts = np.bincount(words.doc, minlength=len(texts))
    begin = np.cumsum(counts) - counts
    held = np.arange(len(texts)) % 5 == 4
    rows = [np.flatnonzero((counts > 0) & ~held & (y == c)) for c in (0, 1)]
    model = ToxicityModel(p)
    if not len(rows[0]) or not len(rows[1]):
        model.shift = -5.0
        return model
    every = Subwords.of(words)
    give_back()
    dense = [k for k in p if k not in ("words", "chars")]
    mean, square = {k: np.zeros_like(p[k]) for k in dense}, {k: np.zeros_like(p[k]) for k in dense}
    gathered = {k: np.full(len(p[k]), 1e-3, np.float32) for k in ("words", "chars")}
    spots = np.arange(WINDOW)
    run = 16  # windows that a text enters with in the second phase

    def gather(docs: np.ndarray, start: np.ndarray):
        length = np.minimum(WINDOW, counts[docs] - start)
        mask = spots[:, None] < length
        return words.code[np.minimum(begin[docs] + start + spots[:, None], len(words.code) - 1)], mask

    def projected(code: np.ndarray):
        used, place = np.unique(code, return_inverse=True)
        some = every.some(used)
        vectors = some.vectors(p)
        return (vectors @ p["input"] + p["bias"])[place.reshape(code.shape)], some, vectors, place.reshape(code.shape)

    def hardest(most: int = 1500) -> tuple[np.ndarray, np.ndarray]:
        """Clean texts' highest windows."""
        text, start, _ = windows_of(counts[rows[0]])
        docs, starts = rows[0][text], start
        inputs = every.inputs(p)
        logits = []
        for a in range(0, len(docs), 4096):
            code, mask = gather(docs[a : a + 4096], starts[a : a + 4096])
            logits.append(forward(p, inputs[code], mask)[0])
        top = np.argsort(-np.concatenate(logits))[:most]
        return docs[top], starts[top]

    for step in range(steps):
        lr = rate * (1 - 0.9 * step / steps)
        truth = np.arange(batch) % 2
        docs = np.array([rows[c][rng.integers(len(rows[c]))] for c in truth])
        last = np.maximum(0, -(-(counts[docs] - WINDOW) // STRIDE))
        start = rng.integers(0, last + 1) * STRIDE
        if step >= steps // 3:  # each text's highest window of a run
            starts = np.minimum(start[None] + STRIDE * np.arange(run)[:, None], (last * STRIDE)[None])
            code, mask = gather(np.tile(docs, run), starts.ravel())
            logit = forward(p, projected(code)[0], mask)[0].reshape(run, batch)
            start = starts[logit.argmax(0), np.arange(batch)]
            if (step - steps // 3) % max(1, steps // 6) == 0:
                hard_docs, hard_starts = hardest()
            pick = rng.integers(0, len(hard_docs), batch // 4)
            docs[: batch // 2 : 2], start[: batch // 2 : 2] = hard_docs[pick], hard_starts[pick]
        code, mask = gather(docs, start)
        x, some, vectors, place = projected(code)
        logit, cache = forward(p, x, mask, keep=True)
        g, d_x = backward(p, cache, ((sigmoid(logit) - truth) / batch).astype(np.float32))
        d_rows = np.zeros((len(vectors), 6 * HIDDEN), np.float32)
        np.add.at(d_rows, place.ravel(), d_x.reshape(-1, 6 * HIDDEN))
        g["input"], g["bias"] = vectors.T @ d_rows, d_rows.sum(0)
        d_vectors = d_rows @ p["input"].T
        for k in dense:
            mean[k] = 0.9 * mean[k] + 0.1 * g[k]
            square[k] = 0.99 * square[k] + 0.01 * g[k] ** 2
            p[k] -= lr * (mean[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(square[k] / (1 - 0.99 ** (step + 1))) + 1e-6)
        owner = np.repeat(np.arange(len(some.count)), some.count)
        for k, at, d in (("words", some.word, d_vectors[:, :WORD_WIDTH]), ("chars", some.spots, (d_vectors[:, WORD_WIDTH:] / some.count[:, None])[owner])):
            used, where = np.unique(at, return_inverse=True)
            total = np.stack([np.bincount(where, d[:, c], len(used)) for c in range(d.shape[1])], 1).astype(np.float32)
            gathered[k][used] += (total**2).mean(1) * 1e4
            p[k][used] -= 20 * lr * total * 100 / np.sqrt(gathered[k][used])[:, None]
    check = np.flatnonzero(held & (counts > 0))
    if len(np.unique(y[check])) < 2:
        check = np.flatnonzero(counts > 0)
    logits = [model.highest([texts[k] for k in check[a : a + 50]]) for a in range(0, len(check), 50)]
    model.sharpness, model.shift = calibrated(np.concatenate(logits), y[check], prior)
    return model


def calibrated(logit: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Sharpness and shift of a logistic curve over the highest logits, classes weighing as in all labels, smoothed."""
    scale = max(1e-3, float(np.abs(logit - logit.mean()).mean()))
    z = (logit - logit.mean()) / scale
    n = np.bincount(y, minlength=2)
    target = np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    a, b, weight = 1.0, 0.0, len(y) * np.array([1 - prior, prior])[y] / n[y]
    for _ in range(3000):
        e = (sigmoid(a * z + b) - target) * weight
        a, b = a - 0.3 * (e * z).mean(), b - 0.3 * e.mean()
    return float(a / scale), float(b - a * logit.mean() / scale)


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = 800, clean_rows: int = 1600, most_chars: int = 8_000_000) -> ToxicityModel:
    """Train on labels.toxic of documents off the held-out fold.

    At most per_label toxic and clean_rows clean whole texts, and of each label no more once they
    hold most_chars characters. A doc_id with several labels is toxic if one of them says so.
    """
    marks = labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    texts, found, counts = labelled_rows(docs.select("doc_id", F.col("text").cast("string").alias("text")), marks, {0: clean_rows, 1: per_label}, most_chars)
    model = train_toxicity(texts, found, (counts.get(1, 0) + 1) / (sum(counts.values()) + 2))
    del texts, found
    give_back()
    return model


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", only_clean: bool = False) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= 0.5); replaces columns of these names, in any case.

    Null and empty texts, and texts without words, score 0. Very long texts are scored whole. Repeated
    rows are scored each; an empty table gives no row; other columns stay, whatever their names.
    only_clean: the rows that are predicted 0, without the new columns.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # some MB, whatever the input

    def judge(texts: list[str | None]) -> list:
        score = shared.value.score(texts)
        return [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]

    added = [StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    return judged(df, text, added, judge, (lambda found: pa.array(found[1].to_numpy() == 0)) if only_clean else None)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
