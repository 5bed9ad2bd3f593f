"""Reading level of documents, sentence by sentence.

Two regularised multinomial logistic models, one of words and pairs of words, one of
character four-grams (both hashed), judge every sentence; their geometric mean is the
sentence's distribution over levels.  A document's distribution is the mean over its
sentences, weighted by words, and a third model calibrates it on the labelled documents.
Code, links, lists, headings and markup are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fitting reads at most this many labelled documents (those with the smallest hashed ids) and this many sentences.
MAX_LABELLED_DOCS, MAX_SENTENCES = 1500, 12_000
WORD_DIM, CHAR_DIM = 1 << 14, 1 << 14
LEVELS = 4
_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|<(pre|code)\b.*?</\1>", re.S | re.I)
_LINK = re.compile(r"\b(?:https?|ftp)://\S+|\bwww\.\S+|!?\[([^\]]*)\]\([^)]*\)")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,300}>")
_ITEM = re.compile(r"^[ \t]*(?:[-*+•]|\[[ xX]?\]|\d+[.)])[ \t]+.*$|^[ \t]*#{1,6}[ \t].*$|^(?: {4}|\t)[ \t]*\S.*$|^[ \t]*\|.*\|[ \t]*$", re.M)
_SPLIT = re.compile(r"(?<=[.!?])[\"'”’)]*\s+|\n\s*\n")


def sentences(text: str) -> list[str]:
    """The sentences of the running text; pieces of fewer than three words are left out."""
    s = _TAG.sub(" ", _FENCE.sub("\n\n", text))
    s = _ITEM.sub("\n\n", _LINK.sub(lambda m: m[1] or " ", s))
    s = re.sub(r"^[ \t]*>+ ?", "", s, flags=re.M)
    out = []
    for piece in _SPLIT.split(s):
        words = piece.split()
        if sum(any(c.isalpha() for c in w) for w in words) >= 3:
            # what has lost its punctuation is read in pieces of at most forty words
            out += [" ".join(words[k : k + 40]) for k in range(0, len(words), 40)] if len(words) > 60 and not re.search(r"[.!?,;]", piece) else [" ".join(words)]
    return out


_POW = np.array([pow(1_000_003, k, 1 << 64) for k in range(64)], dtype=np.uint64)


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower case and closed by a blank either side, digits alike, and the start of each text."""
    joined = [" " + re.sub(r"\d", "0", re.sub(r"[^\w\s']+", " ", t.lower())) + " " for t in texts]
    joined = [re.sub(r"\s+", " ", t) for t in joined]
    size = np.array([len(t) for t in joined])
    return np.frombuffer("".join(joined).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64), np.concatenate([[0], np.cumsum(size)])


def _mix(h: np.ndarray, dim: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(dim)).astype(np.int64)


def char_features(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, hashed four-gram)`` pairs."""
    if len(codes) < 4:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(codes) - 3
    with np.errstate(over="ignore"):
        h = codes[:n] * _POW[3] + codes[1 : n + 1] * _POW[2] + codes[2 : n + 2] * _POW[1] + codes[3 : n + 3]
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:n]
    inside = rows == np.repeat(np.arange(len(starts) - 1), np.diff(starts))[3 : n + 3]
    return rows[inside], _mix(h, CHAR_DIM)[inside]


def word_features(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, hashed word or pair of words)`` pairs."""
    blank = codes == 32
    first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows_all = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    place = np.arange(len(codes)) - np.maximum.accumulate(np.where(blank, np.arange(len(codes)) + 1, 0))
    with np.errstate(over="ignore"):
        weighed = np.where(blank, 0, codes * _POW[np.minimum(place, 63)] + np.uint64(7)).astype(np.uint64)
        h = np.add.reduceat(weighed, first)
        rows = rows_all[first]
        pair = h[:-1] * np.uint64(31) + h[1:] * np.uint64(17) + np.uint64(5)
    together = rows[:-1] == rows[1:]
    return np.concatenate([rows, rows[:-1][together]]), np.concatenate([_mix(h, WORD_DIM), _mix(pair, WORD_DIM)[together]])


def _scores(rows: np.ndarray, cols: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """Mean weight of each text's features, scaled by the root of their number, for every level."""
    count = np.maximum(np.bincount(rows, minlength=n), 1)
    return np.column_stack([np.bincount(rows, weights=weights[cols, k], minlength=n) for k in range(weights.shape[1])]) / np.sqrt(count)[:, None]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_hashed(rows: np.ndarray, cols: np.ndarray, n: int, target: np.ndarray, weight: np.ndarray, dim: int, l2: float = 2e-4, steps: int = 80, rate: float = 0.5) -> np.ndarray:
    """Multinomial logistic regression on hashed counts by Adam on full batches."""
    levels = target.shape[1]
    w, m, v = np.zeros((dim, levels)), np.zeros((dim, levels)), np.zeros((dim, levels))
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
    total = weight.sum()
    for t in range(1, steps + 1):
        p = _softmax(_scores(rows, cols, n, w))
        delta = (p - target) * (weight * scale / total)[:, None]
        grad = np.column_stack([np.bincount(cols, weights=delta[rows, k], minlength=dim) for k in range(levels)]) + l2 * w / dim**0.5
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * (1 - t / (steps + 1))
    return w


def _judge(texts: list[str], model: dict) -> np.ndarray:
    """The distribution over levels of every sentence."""
    if not texts:
        return np.zeros((0, LEVELS))
    codes, starts = _flat(texts)
    z = _scores(*word_features(codes, starts), len(texts), model["words"]) + _scores(*char_features(codes, starts), len(texts), model["chars"])
    return _softmax(z / 2 * model["sharp"])


def document_features(judged: np.ndarray, words: np.ndarray) -> np.ndarray:
    share = judged * words[:, None]
    mean = share.sum(axis=0) / max(words.sum(), 1)
    return np.concatenate([mean, [mean @ np.arange(1, LEVELS + 1)]])


def _fit_dense(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 400) -> np.ndarray:
    """Multinomial logistic regression in which every level weighs alike."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros((z.shape[1], LEVELS))
    target = np.eye(LEVELS)[y]
    weight = (1 / np.maximum(np.bincount(y, minlength=LEVELS), 1))[y]
    weight = (weight / weight.sum())[:, None]
    for _ in range(steps):
        w -= 2.0 * (z.T @ (weight * (_softmax(z @ w) - target)) + l2 * w)
    return w


def fit_reading_model(documents: DataFrame, labels: DataFrame, max_docs: int = MAX_LABELLED_DOCS) -> dict | None:
    """Fit the sentence models and the calibration on at most ``max_docs`` labelled documents.

    Several ratings of one document count with their mean distribution.  None without labels.
    """
    rated = labels.where(F.col("doc_id").isNotNull() & F.col("band").between(1, LEVELS)).groupBy("doc_id").agg(F.avg("band").alias("band"), F.min("band").alias("low"), F.max("band").alias("high"))
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    texts = documents.where("text IS NOT NULL").join(F.broadcast(rated), "doc_id").groupBy("doc_id").agg(F.first("text").alias("text"), F.first("low").alias("low"), F.first("high").alias("high"))
    return fit_on_sample(texts.toPandas().sort_values("doc_id"))


def fit_on_sample(sample: pd.DataFrame) -> dict | None:
    """Fit on rows ``(doc_id, text, low, high)``: a text and its lowest and highest rating."""
    parts = [sentences(t) for t in sample["text"]]
    keep = [k for k, p in enumerate(parts) if p]
    if not keep:
        return None
    soft = np.array([(np.eye(LEVELS)[a - 1] + np.eye(LEVELS)[b - 1]) / 2 for a, b in zip(sample["low"].astype(int), sample["high"].astype(int))])
    flat, owner = [s for k in keep for s in parts[k]], np.array([k for k in keep for _ in parts[k]])
    step = max(1, math.ceil(len(flat) / MAX_SENTENCES))
    chosen = np.arange(0, len(flat), step)
    texts_, owner_ = [flat[k] for k in chosen], owner[chosen]
    codes, starts = _flat(texts_)
    wr, wc = word_features(codes, starts)
    cr, cc = char_features(codes, starts)
    n = len(texts_)
    model = {"words": np.zeros((WORD_DIM, LEVELS)), "chars": np.zeros((CHAR_DIM, LEVELS)), "sharp": 1.0}
    target = soft[owner_]
    for turn in range(3):
        # a document's sentences differ in level: after the first turn each trains on its own level as judged so far, near the document's
        weight = np.ones(n)
        model["words"] = fit_hashed(wr, wc, n, target, weight, WORD_DIM)
        model["chars"] = fit_hashed(cr, cc, n, target, weight, CHAR_DIM, steps=50)
        judged = _softmax((_scores(wr, wc, n, model["words"]) + _scores(cr, cc, n, model["chars"])) / 2)
        target = judged**2 * (0.1 + soft[owner_])
        target /= target.sum(axis=1, keepdims=True)
    x = []
    for k in keep:
        j = _judge(parts[k], model)
        x.append(document_features(j, np.array([len(s.split()) for s in parts[k]], dtype=float)))
    model["calibration"] = _fit_dense(np.array(x), soft[keep].argmax(axis=1))
    return model


_SCHEMA = "doc_id long, n_sentences int, level_1 double, level_2 double, level_3 double, level_4 double, difficulty double, band int"


def reading_levels(documents: DataFrame, labels: DataFrame, lang: str | None = "en") -> DataFrame:
    """``doc_id, n_sentences, level_1..4, difficulty, band`` of every document of the language.

    Null, empty or sentence-less texts have no level (nulls, 0 sentences); rows without id are
    left out; repeated rows are judged each; without labels nothing can be judged and all levels
    are null.  The model's size is fixed (two tables of 16,384 rows), so it is sent with the task.
    """
    rows = documents.where("doc_id IS NOT NULL")
    rows = rows.where(F.col("lang") == lang) if lang else rows
    model = fit_reading_model(documents, labels)
    if model:
        model = {k: v.astype(np.float32) if isinstance(v, np.ndarray) else v for k, v in model.items()}
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for frame in frames:
            parts = [sentences(t) if t and model else [] for t in frame["text"]]
            sizes = np.array([len(p) for p in parts])
            flat = [s for p in parts for s in p]
            judged = np.concatenate([_judge(flat[k : k + 4000], model) for k in range(0, len(flat), 4000)]) if flat else np.zeros((0, LEVELS))
            words = np.array([len(s.split()) for s in flat], dtype=float)
            at, out = 0, []
            for doc, size in zip(frame["doc_id"], sizes):
                if not size:
                    out.append((doc, 0, None, None, None, None, None, None))
                    continue
                x = document_features(judged[at : at + size], words[at : at + size])
                at += size
                p = _softmax(np.concatenate([[1.0], x])[None] @ model["calibration"])[0]
                out.append((doc, size, *(round(float(v), 6) for v in p), round(float(p @ np.arange(1, LEVELS + 1)), 6), int(p.argmax()) + 1))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _SCHEMA.split(", ")]).astype({"doc_id": "int64", "n_sentences": "int32", "band": "Int32"})

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(judge, _SCHEMA)
