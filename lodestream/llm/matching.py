"""Records of the same person in sources without a common key.

All attributes of a record become terms of an inverted index: addresses, account handles,
numbers beside a surname, full names and the short forms that people make of them.  Records
are retrieved by BM25, exactly above the least score that counts (MaxScore).  Pairs pass a
mutual-nearest test per source, and a logistic model of score and score gap, calibrated on
pairs that an address proves or a number disproves, gives each a confidence.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.given_names import FEMALE, MALE
from lodestream.llm.grouping import ROLE_LOCALS
from lodestream.llm.names import FORMAL, fold
from lodestream.scratch import materialize, release

#: Calibration reads at most this many proven and disproven pairs each.
CALIBRATION_PAIRS = 20_000
_ADDRESS = re.compile(r"([^\s<>\"'(),;]+)@([a-z0-9-]+(?:\.[a-z0-9-]+)+)")
_TAGS = frozenset("dev hq ops codes code gh git work team data infra billing search mobile growth risk identity payments platform bot".split())


def _formal(given: str) -> list[str]:
    return sorted(FORMAL.get(given, {given}))


def _person_names(text: str) -> list[tuple[str, str]]:
    """``(given, surname)`` of a written name; either may be an initial."""
    text = re.sub(r"\([^)]*\)|\|.*$", " ", text).strip().lstrip("@")
    swapped = "," in text
    words = re.findall(r"[^\W\d_]+", fold(text.replace("-", " ")) if " " in text or swapped else "")
    if len(words) < 2:
        return []
    return [(words[-1], words[0])] if swapped else [(words[0], words[-1])]


def _is_given(word: str) -> bool:
    return word in FORMAL or word in FEMALE or word in MALE


def record_terms(name: str, emails: list[str], handles: list[str]) -> tuple[list[tuple[str, str]], list[str], str]:
    """Index terms ``(term, start of the given name it rests on)`` of a record, the numbers in its identifiers, the start of its surname."""
    terms: dict[str, str] = {}
    numbers: set[str] = set()
    people: set[tuple[str, str]] = set()
    plain: list[str] = []
    own = _person_names(name)
    own_given = min(_formal(own[0][0]))[:3] if own and len(own[0][0]) > 1 else ""
    own_surname = own[0][1][:4] if own and len(own[0][1]) > 3 else ""
    for text in [name, *handles]:
        people.update(_person_names(text))
        t = text.strip().lstrip("@").lower()
        if t and " " not in t and "@" not in t and "," not in t:
            plain.append(t)
            terms["h:" + t] = ""
    for text in emails:
        m = _ADDRESS.search(text.strip().lower())
        if not m:
            continue
        local, domain = m[1], m[2]
        if "+" in local and local.split("+")[0].isdigit():
            handle = local.split("+", 1)[1]
            terms["h:" + handle] = ""
            plain.append(handle)
        elif local not in ROLE_LOCALS:
            plain.append(local)
            terms["l:" + local] = ""
        if local not in ROLE_LOCALS:
            terms[f"e:{local}@{domain}"] = ""
    surnames = {s for _, s in people if len(s) > 3}
    for t in plain:
        letters = [w for w in re.findall(r"[^\W\d_]+", fold(t)) if w not in _TAGS]
        if len(letters) == 2 and all(len(w) > 2 for w in letters):
            first, last = letters if _is_given(letters[0]) or not _is_given(letters[1]) else letters[::-1]
            if _is_given(first) or not re.search(r"\d", t):
                people.add((first, last))
                surnames.add(last)
        whole = "".join(letters)
        if len(whole) >= 6 and not _is_given(whole) and whole not in surnames:
            terms.setdefault("c:" + whole, own_given)
        for number in re.findall(r"\d{3,}", t):
            owner = next((s for s in sorted(surnames) if s in whole), max(letters, key=len, default=""))
            if len(owner) > 3:
                numbers.add(number)
                terms[f"k:{owner}{number}"] = ""
                if len(number) > 3:  # long numbers are given to namesakes, so initials beside one tell whose it is
                    terms.update({f"k:{number} {min(_formal(g))[0]} {s[0]}": "" for g, s in own})
    for given, surname in people:
        if len(given) > 1 and len(surname) > 1:
            for g in _formal(given):
                terms["n:" + " ".join(sorted((g, surname)))] = g[:3]
            for g in {given, *_formal(given)}:
                for c in (g + surname, surname + g):
                    terms["c:" + c] = min(_formal(given))[:3] if len(c) > 5 else ""
        if len(surname) > 3 and not _is_given(surname):
            tag = min(_formal(given))[:3] if len(given) > 1 else ""
            for g in {given, *_formal(given)}:
                terms[f"i:{g[0]} {surname}"] = tag
                for c in (g[0] + surname, surname + g[0]):
                    terms["c:" + c] = tag or terms.get("c:" + c, "")
    return list(terms.items()), sorted(numbers), own_surname


def _index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for rid, name, emails, handles in zip(f["cls"], f["name"], f["emails"], f["handles"]):
            terms, numbers, surname = record_terms(name, [e for e in emails if e], [h for h in handles if h])
            out.append((rid, [t for t, _ in terms], [g for _, g in terms], numbers, surname))
        yield pd.DataFrame(out, columns=["cls", "terms", "givens", "numbers", "surname"])


def _records(records: DataFrame) -> DataFrame:
    """``record_id, source`` and the attributes, one row per id."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in records.columns else F.lit("")
    aliases = F.coalesce(F.col("aliases"), F.array().cast("array<string>")) if "aliases" in records.columns else F.array().cast("array<string>")
    rows = records.where("record_id IS NOT NULL AND source IS NOT NULL").select(
        F.col("record_id").cast("long").alias("record_id"), "source", text("name").alias("name"), F.array_sort(F.concat(F.array(text("email")), aliases)).alias("emails"),
        F.concat(F.array(text("github_handle"), text("slack_handle"), text("linear_display_name")), F.array_sort(F.filter(aliases, lambda a: ~a.contains("@")))).alias("handles"),
    )
    return rows.groupBy("record_id").agg(F.min(F.struct("source", "name", "emails", "handles")).alias("r")).select("record_id", "r.*")


def _postings(classes: DataFrame) -> DataFrame:
    """``cls, source, term`` (hashed), what kind of term it is, and what tells its bearers apart."""
    docs = classes.mapInPandas(_index, "cls long, terms array<string>, givens array<string>, numbers array<string>, surname string")
    docs = docs.select("cls", "numbers", "surname", F.explode(F.arrays_zip("terms", "givens")).alias("t"))
    term = F.col("t.terms")
    return docs.select("cls", F.xxhash64(term).alias("term"), F.substring(term, 1, 1).alias("kind"), term.rlike(r"\d").alias("numbered"), F.col("t.givens").alias("given"), "numbers", "surname")


def _clear_terms(post: DataFrame) -> DataFrame:
    """Terms that tell people apart, with their frequency and kind.

    Left out are names that several people bear by their numbers, short forms of several given
    names, and handles of several surnames.
    """
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    number = F.get("numbers", F.lit(0))
    per = post.groupBy("term", "kind", "numbered").agg(
        F.count(F.lit(1)).alias("df"), F.min(number).alias("n1"), F.max(number).alias("n2"), F.min(some("given")).alias("g1"), F.max(some("given")).alias("g2"), F.min(some("surname")).alias("s1"), F.max(some("surname")).alias("s2")
    )
    differ = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
    kind, numbered = F.col("kind"), F.col("numbered")
    vague = (kind.isin("n", "c", "i") | kind.isin("h", "l") & ~numbered) & differ("n1", "n2") | kind.isin("c", "i") & differ("g1", "g2") | kind.isin("h", "l", "c") & ~numbered & differ("s1", "s2")
    return per.where("df > 1").where(~vague).select("term", kind.isin("e", "k").alias("proof"), "df")


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Logistic regression by Newton's method with a ridge."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + l2 * w
        hess = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: BM25: saturation, weight of a record's length, and the least score as a share of the greatest weight of a term.
K1, B, FLOOR = 1.2, 0.3, 0.55
#: A record counts as nearest if its score is at least this share of the best one of its source.
NEAR = 0.4


def _retrieve(docs: DataFrame, floor: float, mean_length: float) -> DataFrame:
    """All pairs of records that score the floor or more from both ends, with BM25 scores and the best of either end per source.

    ``docs``: ``cls, source, numbers, terms`` (term, its weight, whether it is proof).  A term occurs once in
    a record, so a record's score for another is the sum of the shared terms' weights, scaled by the
    other's length.  MaxScore: a record's lightest terms, whose weights together cannot reach the floor,
    start no search, which loses no pair above it.
    """
    scale = lambda n: (K1 + 1) / (1 + K1 * (1 - B + B * n / mean_length))
    most = (K1 + 1) / (1 + K1 * (1 - B))
    summed = F.aggregate(
        F.array_sort(F.transform("terms", lambda t: F.struct(t["w"].alias("w"), t["t"].alias("t")))), F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<bigint>").alias("out")),
        lambda acc, t: F.struct((acc["sum"] + t["w"]).alias("sum"), F.when((acc["sum"] + t["w"]) * most >= floor, F.concat(acc["out"], F.array(t["t"]))).otherwise(acc["out"]).alias("out")),
    )
    starts = docs.select(F.col("cls").alias("x"), F.explode(summed["out"]).alias("term"))
    index = docs.select(F.col("cls").alias("y"), F.explode("terms.t").alias("term"))
    pairs = starts.join(index, "term").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    side = lambda s: docs.select(F.col("cls").alias(s), F.col("source").alias(f"source_{s}"), F.col("numbers").alias(f"num_{s}"), F.col("terms").alias(f"terms_{s}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b")
    add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, t: s + t["w"])
    clash = (F.size("num_a") > 0) & (F.size("num_b") > 0) & ~F.arrays_overlap("num_a", "num_b")
    full = full.select("a", "b", "source_a", "source_b", clash.alias("clash"), scale(F.size("terms_b")).alias("sb"), scale(F.size("terms_a")).alias("sa"), F.filter("terms_a", lambda t: F.array_contains(F.col("terms_b.t"), t["t"])).alias("shared"))
    proof = F.exists("shared", lambda t: t["p"])
    scored = full.select("a", "b", "source_a", "source_b", "clash", "sa", "sb", add(F.col("shared")).alias("sum"), add(F.filter("shared", lambda t: ~t["p"])).alias("rest"), proof.alias("proof"))
    scored = materialize(scored.where(F.col("sum") * F.greatest("sa", "sb") >= floor), "scored")
    # the best of a record's candidates per source, from either end, with and without proof
    ends = scored.select(F.explode(F.array(F.struct(F.col("a").alias("r"), F.col("source_b").alias("s"), (F.col("sum") * F.col("sb")).alias("v"), (F.col("rest") * F.col("sb")).alias("u")), F.struct(F.col("b").alias("r"), F.col("source_a").alias("s"), (F.col("sum") * F.col("sa")).alias("v"), (F.col("rest") * F.col("sa")).alias("u")))).alias("e")).select("e.*")
    best = materialize(ends.groupBy("r", "s").agg(F.max("v").alias("v"), F.max("u").alias("u")), "best")
    end = lambda r, s: best.select(F.col("r").alias(r), F.col("s").alias(s), F.col("v").alias(f"v_{r}"), F.col("u").alias(f"u_{r}"))
    near = scored.join(end("a", "source_b"), ["a", "source_b"]).join(end("b", "source_a"), ["b", "source_a"])
    share = lambda c, u: F.least(F.try_divide(F.col(c) * F.col("sb"), F.col(f"{u}_a")), F.try_divide(F.col(c) * F.col("sa"), F.col(f"{u}_b")))
    score = lambda c: F.col(c) * F.sqrt(F.col("sa") * F.col("sb")) / floor
    out = materialize(near.select("a", "b", "source_a", "source_b", "clash", "proof", score("sum").alias("score"), (1 - share("sum", "v")).alias("gap"), score("rest").alias("rest"), (1 - F.coalesce(share("rest", "u"), F.lit(0.0))).alias("rest_gap")), "near")
    release(scored)
    release(best)
    return out


def _calibrate(near: DataFrame) -> tuple[float, float, float]:
    """Logistic weights of score and gap, from pairs that shared addresses or numbers prove and different numbers disprove.

    What proves a pair is left out of its features, so the labels are not among them.
    """

    def sample(where: str, label: int) -> pd.DataFrame:
        return near.where(where).select("a", "b", "rest", "rest_gap").orderBy(F.xxhash64("a", "b")).limit(CALIBRATION_PAIRS).toPandas().assign(y=label)

    known = pd.concat([sample("proof AND NOT clash AND rest > 0", 1), sample("clash AND NOT proof", 0)])
    if known["y"].nunique() < 2:
        return -1.0, 2.0, -4.0  # without proof from the data: a pair needs more than the floor, and no better partner
    share = np.where(known["y"] == 1, 0.5 / max((known["y"] == 1).mean(), 1e-9), 0.5 / max((known["y"] == 0).mean(), 1e-9))
    w = _fit(known[["rest", "rest_gap"]].to_numpy(float), known["y"].to_numpy(float), share)
    return float(w[0]), max(float(w[1]), 0.0), min(float(w[2]), 0.0)


def _accepted(near: DataFrame, weights: tuple[float, float, float], least: float) -> DataFrame:
    """Mutually nearest pairs that no number contradicts, with calibrated confidence."""
    odds = weights[0] + weights[1] * F.col("score") + weights[2] * F.col("gap")
    return near.where((F.col("gap") <= 1 - NEAR) & ~F.col("clash")).withColumn("confidence", 1 / (1 + F.exp(-odds))).where(F.col("confidence") >= least).select("a", "b", "source_a", "source_b", "confidence")


def match_records(records: DataFrame, least_confidence: float = 0.5) -> DataFrame:
    """``record_a < record_b, confidence``: records of different sources that describe one person.

    Records of a source alike in every attribute are one class; classes retrieve each other by BM25
    over all attributes.  Two are matched if each is the other's nearest of its source, or near to it
    (ties and repeats of a person are all nearest), and the logistic model of score and gap trusts it.
    In a second round every class carries the terms of its matches too (relevance feedback), so that
    records meet that only a third one relates; the same tests decide.

    Null or empty fields and fillers give no terms; rows without id or source are no records, a
    repeated id is one; extra columns are ignored.
    """
    rows = materialize(_records(records), "records")
    alike = materialize(rows.groupBy("source", "name", "emails", "handles").agg(F.min("record_id").alias("cls"), F.collect_list("record_id").alias("members")), "alike")
    post = materialize(_postings(alike.select("cls", "name", "emails", "handles")), "postings")
    total = alike.count()
    if not total:
        return rows.select(F.col("record_id").alias("record_a"), F.col("record_id").alias("record_b"), F.lit(1.0).alias("confidence")).where("false")
    idf = F.log(1 + (F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    floor = FLOOR * math.log(max(total, 2))
    clear = _clear_terms(post).select("term", "proof", idf.alias("w"))
    held = post.select("cls", "term", "numbers").join(clear, "term").groupBy("cls", "numbers").agg(F.collect_list(F.struct(F.col("term").alias("t"), "w", F.col("proof").alias("p"))).alias("terms"))
    docs = materialize(held.join(alike.select("cls", "source"), "cls"), "docs")
    mean_length = docs.agg(F.avg(F.size("terms"))).first()[0] or 1.0
    release(post)

    near = _retrieve(docs, floor, mean_length)
    weights = _calibrate(near)
    sure = materialize(_accepted(near, weights, least_confidence), "sure")
    release(near)
    lent = sure.select(F.explode(F.array(F.struct(F.col("a").alias("cls"), F.col("b").alias("of")), F.struct(F.col("b").alias("cls"), F.col("a").alias("of")))).alias("e")).select("e.*")
    lent = lent.join(docs.select(F.col("cls").alias("of"), F.col("numbers").alias("n"), F.col("terms").alias("t")), "of").groupBy("cls").agg(F.array_distinct(F.flatten(F.collect_list("n"))).alias("n"), F.array_distinct(F.flatten(F.collect_list("t"))).alias("t"))
    wide = docs.join(lent, "cls", "left").select("cls", "source", F.array_union("numbers", F.coalesce("n", F.array().cast("array<string>"))).alias("numbers"), F.array_union("terms", F.coalesce("t", F.filter("terms", lambda t: F.lit(False)))).alias("terms"))
    wide = materialize(wide, "docs")
    again = _retrieve(wide, floor, wide.agg(F.avg(F.size("terms"))).first()[0] or 1.0)
    both = _accepted(again, weights, least_confidence).unionByName(sure).where("source_a <> source_b").groupBy("a", "b").agg(F.max("confidence").alias("confidence"))
    member = lambda c: alike.select(F.col("cls").alias(c), F.explode("members").alias(f"record_{c}"))
    out = both.join(member("a"), "a").join(member("b"), "b")
    return out.select(F.least("record_a", "record_b").alias("record_a"), F.greatest("record_a", "record_b").alias("record_b"), F.round("confidence", 6).alias("confidence"))
