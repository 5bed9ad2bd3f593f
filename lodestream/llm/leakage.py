"""Held-out test passages inside a training corpus.

One Aho-Corasick automaton over the normalised test items (every run of ``NGRAM`` words is a
pattern) scans each normalised text once.  Word offsets lead back to the original text.  Hits
of one item on one diagonal (text position minus item position) are chained into stretches
that bridge single changed words; the stretches tell how much of the item a text carries.

The test set is the only thing held by every worker: its size is checked, and sets beyond
``MAX_ITEM_WORDS`` are scanned in blocks of that size.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NGRAM = 3
#: Words of test items in one automaton.
MAX_ITEM_WORDS = 2_000_000
#: A stretch bridges at most so many words that differ and counts from so many equal words on.
MAX_GAP, MIN_STRETCH = 3, 8
_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")


def words_with_offsets(text: str) -> tuple[list[str], list[int]]:
    """Words in lower case and the place of each in ``text``; punctuation, layout and tags are none."""
    blank = _TAG.sub(lambda m: " " * len(m[0]), text) if "<" in text else text
    words, at = [], []
    for m in _WORD.finditer(blank):
        w = m[0]
        words.append(w.lower() if w.isascii() else unicodedata.normalize("NFKC", w).casefold())
        at.append(m.start())
    return words, at


def build_automaton(items: list[tuple[int, str]]):
    """The automaton and, per item, its words and the places of its distinctive words (in few items)."""
    import ahocorasick

    words = {i: words_with_offsets(t)[0] for i, t in items}
    spread = Counter(w for ws in words.values() for w in set(ws))
    rare = max(2, len(words) // 40)
    places: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for i, ws in words.items():
        n = min(NGRAM, len(ws))
        for k in range(len(ws) - n + 1 if n else 0):
            places[" " + " ".join(ws[k : k + n]) + " "].append((i, k))
    auto = ahocorasick.Automaton()
    for pattern, where in places.items():
        auto.add_word(pattern, (pattern.count(" ") - 1, where))
    if places:
        auto.make_automaton()
    return auto, words, {i: {k for k, w in enumerate(ws) if spread[w] <= rare} for i, ws in words.items()}


@lru_cache(maxsize=2)
def _automaton_of(block: tuple[tuple[int, str], ...]):
    """One automaton per block and Python worker, shared by the tasks that the worker runs."""
    return build_automaton(list(block))


def _stretches(hits: list[tuple[int, int]], item: list[str], text: list[str], distinctive: set[int]) -> list[tuple[int, int, int, int]]:
    """Item and text ranges ``(i0, i1, t0, t1)`` carried in order, from ``(item place, text place)`` word hits."""
    out, open_, done = [], [], []
    for t, i in sorted((t, i) for i, t in hits):
        for s in open_:
            di, dt = i - s[1], t - s[3]
            if 0 <= di <= MAX_GAP + 1 and 0 <= dt <= MAX_GAP + 1 and (di or not dt):
                if di:
                    s[1], s[3], s[4] = i, t, s[4] + 1
                    s[5].add(i)
                break
        else:
            open_.append([i, i, t, t, 1, {i}])
        if len(open_) > 64:
            done += [s for s in open_ if t - s[3] > MAX_GAP + 1]
            open_ = [s for s in open_ if t - s[3] <= MAX_GAP + 1]
    for s in done + open_:
        own = {k for k in distinctive if s[0] <= k <= s[1]}
        if (s[4] >= MIN_STRETCH or s[4] == len(item)) and 2 * len(own & s[5]) >= len(own):
            out.append((s[0], s[1] + 1, s[2], s[3] + 1))
    return out


def scan_text(text: str, auto, words: dict[int, list[str]], distinctive: dict[int, set[int]]) -> list[tuple[int, float, int, int]]:
    """``(item, share of its words carried, start, end)`` for one text, offsets in the original."""
    ws, at = words_with_offsets(text)
    if not ws or not words:
        return []
    flat = " " + " ".join(ws) + " "
    starts, p = {}, 0
    for k, w in enumerate(ws):
        starts[p] = k
        p += len(w) + 1
    found: dict[int, set[tuple[int, int]]] = defaultdict(set)
    for end, (n, where) in auto.iter(flat):
        first = flat.rfind(" ", 0, end)
        for _ in range(n - 1):
            first = flat.rfind(" ", 0, first)
        k = starts[first]
        for item, i in where:
            found[item].update((i + j, k + j) for j in range(n))
    out = []
    for item, hits in found.items():
        size = len(words[item])
        if len({i for i, _ in hits}) * 5 < size * 2:
            continue
        parts = _stretches(list(hits), words[item], ws, distinctive[item])
        covered = set().union(*[range(a, b) for a, b, _, _ in parts]) if parts else ()
        if covered:
            t0, t1 = min(p[2] for p in parts), max(p[3] for p in parts)
            out.append((item, len(covered) / size, at[t0], at[t1 - 1] + len(ws[t1 - 1])))
    return out


def find_leaks(documents: DataFrame, items: DataFrame, least: float = 0.5) -> DataFrame:
    """``doc_id, item_id, share, start, end`` for every text that carries ``least`` of an item or more.

    Null or empty texts and items match nothing, an item without id is ignored, repeated rows of
    either table give one result row each pair, extra columns are ignored.  Whole texts are
    scanned whatever their length.
    """
    held = items.where("item_id IS NOT NULL AND text IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text"))
    blocks: list[list[tuple[int, str]]] = [[]]
    size = 0
    for r in held.orderBy("item_id").toLocalIterator():
        n = r["text"].count(" ") + 1
        if size + n > MAX_ITEM_WORDS and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((r["item_id"], r["text"]))
        size += n
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in blocks:

        def scan(frames: Iterator[pd.DataFrame], block=tuple(block)) -> Iterator[pd.DataFrame]:
            auto, words, distinctive = _automaton_of(block)
            for frame in frames:
                rows = [(d, *r) for d, t in zip(frame["doc_id"], frame["text"]) for r in scan_text(t, auto, words, distinctive) if r[1] >= least]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "share", "start", "end"]).astype({"doc_id": "int64", "item_id": "int64", "share": "float64", "start": "int64", "end": "int64"})

        part = texts.mapInPandas(scan, "doc_id long, item_id long, share double, start long, end long")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("share", "start", "end"), "share").alias("r")).select("doc_id", "item_id", "r.*")


def leaked_items(leaks: DataFrame) -> DataFrame:
    """Per test item, how many texts carry it and how much of it at most."""
    return leaks.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.max("share"), 6).alias("most"))
