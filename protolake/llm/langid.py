"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's vector is the mean of the embeddings of all its words' subwords (the
word itself and its character n-grams with word marks, hashed into buckets);
a linear softmax reads it. Both are trained by stochastic gradient descent in
numpy on a bounded sample of labelled rows.

Rejection is learned and calibrated with negatives: one more class of the
softmax stands for texts of no learned language, made from training rows by
shuffling letters and by drawing letters of other alphabets. Embeddings start
at zero, so subwords that were never seen move a text towards that class's
bias. A temperature is fitted to the left-out rows and negatives, whole and as
short runs of words, and the level is the highest up to a half that keeps nearly
all of the left-out rows and runs that are rightly identified.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField

from protolake.llm.kernels import give_back, ragged
from protolake.llm.labels import is_held_out, labelled_rows
from protolake.llm.rows import judged
from protolake.llm.words import read_words

UNKNOWN = "und"
#: Lengths of the n-grams, in bytes.
SIZES = (1, 2, 3, 4)
#: First and last letters of alphabets that negatives are drawn from.
ALPHABETS = [("a", "z"), ("\u00e0", "\u00ff"), ("\u0100", "\u017f"), ("\u03b1", "\u03c9"), ("\u0430", "\u044f"), ("\u05d0", "\u05ea"), ("\u0627", "\u064a"), ("\u0905", "\u0939"), ("\u0e01", "\u0e2e"), ("\u3041", "\u3096"), ("\u4e00", "\u9fa5"), ("\uac00", "\ud7a3")]


def has_letter(text: str | None) -> bool:
    return bool(text) and (any("a" <= c <= "z" or "A" <= c <= "Z" for c in text[:200]) or any(unicodedata.category(c)[0] == "L" for c in text))


def negatives(texts: list[str], n: int, rng: np.random.Generator, words: int = 40) -> list[str]:
    """n texts of no language: runs of words of the texts with their letters shuffled over the run, words of letters of one alphabet, of consonants, or of shuffled syllables."""
    out = []
    worded = [x for x in texts if x and not x.isspace()]
    for k in range(n if worded else 0):
        own = worded[int(rng.integers(len(worded)))].split()
        at = int(rng.integers(max(1, len(own) - words)))
        run = own[at : at + int(rng.integers(3, words + 1))]
        lengths = [len(w) for w in run]
        if k % 3 == 0:
            letters = np.array(list("".join(run)))
            rng.shuffle(letters)
        elif k % 3 == 1:
            pool = [chr(c) for a, z in [ALPHABETS[int(rng.integers(len(ALPHABETS)))]] for c in range(ord(a), ord(z) + 1)]
            letters = rng.choice(pool, sum(lengths))
        else:
            letters = rng.choice(list("bcdfghjklmnpqrstvwxyz" if k % 2 else "zxwykjqvcszzrwyiaeou"), sum(lengths))
        cuts = np.cumsum([0, *lengths])
        out.append(" ".join("".join(letters[a:b]) for a, b in zip(cuts, cuts[1:])))
    return out


@dataclass
class LanguageModel:
    """by_bucket: each bucket's share of the logits (its embedding times the softmax weights); the last class is no language, if ``rejects``."""

    languages: list[str]
    by_bucket: np.ndarray
    bias: np.ndarray
    sharpness: float
    least: float
    rejects: bool = False

    def logits(self, texts: list[str | None]) -> np.ndarray:
        words = read_words(texts)
        spots, whose = words.subwords(len(self.by_bucket), SIZES)
        k = len(self.bias)
        sums = np.stack([np.bincount(whose, self.by_bucket[spots, c], words.n) for c in range(k)], 1)
        counts = np.bincount(whose, minlength=words.n)
        total = np.bincount(words.doc, counts[words.code], len(texts))
        return np.stack([np.bincount(words.doc, sums[words.code, c], len(texts)) for c in range(k)], 1) / np.maximum(total, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language (-1: none, no letter) and its calibrated probability, texts of no language included."""
        p = softmax(self.logits(texts) * self.sharpness)
        best = p[:, : len(self.languages)].argmax(1)
        none = np.array([not has_letter(x) for x in texts], bool)
        return np.where(none, -1, best), np.where(none, 0.0, p[np.arange(len(p)), best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train_languages(texts: list[str], labels: list[str], buckets: int = 1 << 16, width: int = 16, steps: int = 3000, rate: float = 0.5, seed: int = 1, sample_words: int = 40, keep: float = 0.999, made: int = 600) -> LanguageModel:
    """SGD over random runs of words of random rows, classes in turn; a fifth of the rows, and of ``made`` negatives, calibrates."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    k = len(languages)
    bad = negatives(texts, made, rng)
    texts, y = [*texts, *bad], np.array([languages.index(x) for x in labels] + [k] * len(bad))
    words = read_words(texts)
    give_back()
    spots, whose = words.subwords(buckets, SIZES, ordered=True)
    give_back()
    per = np.bincount(whose, minlength=words.n)
    first = np.cumsum(per) - per
    n_words = np.bincount(words.doc, minlength=len(texts))
    begin = np.cumsum(n_words) - n_words
    usable = n_words > 0
    held = (np.arange(len(texts)) % 5 == 4) & usable
    if not all(held[y == c].any() and (~held & usable)[y == c].any() for c in range(k)):
        held = usable
    trains = usable if held.sum() == usable.sum() else usable & ~held
    rows = [np.flatnonzero(trains & (y == c)) for c in range(k + 1)]
    classes = [c for c in range(k + 1) if len(rows[c])]
    table, weights, bias = np.zeros((buckets, width), np.float32), rng.normal(0, 0.3, (width, k + 1)).astype(np.float32), np.zeros(k + 1, np.float32)
    batch = 32
    for step in range(steps if classes else 0):
        lr = rate * (1 - step / steps)
        truth = np.array([classes[(step * batch + j) % len(classes)] for j in range(batch)])
        docs = np.array([rng.choice(rows[c]) for c in truth])
        size = np.minimum(n_words[docs], rng.integers(1, sample_words + 1, batch))
        at = begin[docs] + (rng.random(batch) * (n_words[docs] - size + 1)).astype(np.int64)
        code = words.code[ragged(at, size)]
        mine = np.repeat(np.repeat(np.arange(batch), size), per[code])
        used = spots[ragged(first[code], per[code])]
        n = np.bincount(mine, minlength=batch)
        mean = np.add.reduceat(table[used], np.cumsum(n) - n, axis=0) / n[:, None]
        p = softmax(mean @ weights + bias)
        p[np.arange(batch), truth] -= 1
        back = (p @ weights.T) / n[:, None]
        weights -= lr * mean.T @ p / batch * 8
        bias -= lr * p.mean(0)
        np.subtract.at(table, used, (lr * 8 * back)[mine].astype(np.float32))
    model = LanguageModel(languages, (table @ weights).astype(np.float64), bias.astype(np.float64), 1.0, 0.0, True)
    check = np.flatnonzero(held)
    if len(check):
        logits, truth = [], []
        for a in range(0, len(check), 50):
            some = [texts[j] for j in check[a : a + 50]]
            logits += [model.logits(some), model.logits([" ".join(x.split()[: 3 + j % 20]) for j, x in enumerate(some)])]
            truth += [y[check[a : a + 50]]] * 2
        logits, truth = np.concatenate(logits), np.concatenate(truth)
        model.sharpness = fitted_sharpness(logits, truth)
        p = softmax(logits * model.sharpness)[:, :k]
        right = (truth < k) & (p.argmax(1) == truth)
        if right.any():
            model.least = float(min(0.5, np.quantile(p[right].max(1), 1 - keep)))
    return model


def fitted_sharpness(logits: np.ndarray, y: np.ndarray) -> float:
    """The inverse temperature of the least cross entropy, by golden-section search on its logarithm.

    Truth is smoothed as if one more row had been wrong, so that rows that are all right do not drive it to infinity.
    """
    share = 1 / (len(y) + 2)

    def loss(x: float) -> float:
        p = np.log(np.clip(softmax(logits * np.exp(x)), 1e-300, 1))
        return float(-((1 - share) * p[np.arange(len(y)), y] + share * p.mean(1)).mean())

    a, b, g = -6.0, 6.0, (np.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    lc, ld = loss(c), loss(d)
    while b - a > 1e-3:
        if lc < ld:
            b, d, ld = d, c, lc
            c = b - g * (b - a)
            lc = loss(c)
        else:
            a, c, lc = c, d, ld
            d = a + g * (b - a)
            ld = loss(d)
    return float(np.exp((a + b) / 2))


def identify(df: DataFrame, model: LanguageModel, text: str = "text", only_accepted: bool = False) -> DataFrame:
    """Adds lang_pred, score and accepted (calibrated rejection); replaces columns of these names, in any case.

    Texts that are null or have no letter get `und`, score 0, not accepted. Very long texts are read
    whole. Repeated rows are judged each; an empty table gives no row; other columns stay, whatever
    their names. only_accepted: the accepted rows, without the new columns.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # one table of buckets x languages, whatever the input

    def judge(texts: list[str | None]) -> list:
        m = shared.value
        best, p = m.predict(texts)
        return [pa.array([UNKNOWN if k < 0 else m.languages[k] for k in best.tolist()], pa.string()), pa.array(p), pa.array((best >= 0) & (p >= m.least))]

    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("accepted", BooleanType())]
    return judged(df, text, added, judge, (lambda found: found[2]) if only_accepted else None)


def fit_languages(df: DataFrame, per_label: int = 500, most_chars: int = 4_000_000) -> LanguageModel:
    """Train on documents' text and lang: at most per_label whole texts of each lang, and of each no more once they hold most_chars characters; every lang is learned."""
    docs = df.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").alias("label"))
    texts, labels, _ = labelled_rows(docs, None, per_label, most_chars)
    model = train_languages(texts, labels) if texts else LanguageModel([UNKNOWN], np.zeros((1, 1)), np.zeros(1), 1.0, 0.0)
    del texts, labels
    give_back()
    return model


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), fit_languages(docs))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
