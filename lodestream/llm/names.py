"""Variant spellings of the names of people and organisations.

Candidates come from a symmetric-delete index: every distinctive token of a name is entered
under itself and under itself less one letter, together with the initial of another token of
the name, so that spellings within one edit meet whatever their order, abbreviations and
initials.  A candidate pair is judged by the cheapest one-to-one alignment of the tokens
(optimal assignment; equal, nickname, initial, abbreviation or one slip of the pen) and by
attributes that must not contradict each other.  Accepted pairs are closed to whole sets.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.grouping import connected_groups
from lodestream.scratch import materialize, release

# Nicknames by formal name (public knowledge; a list for recognition).
NICKNAMES: dict[str, str] = {
    "alexander": "alex al sandy xander sasha", "benjamin": "ben benny", "charles": "chuck charlie chas chaz", "christopher": "chris kit topher", "daniel": "dan danny", "deborah": "deb debbie debby",
    "edward": "ed eddie ted ned teddy", "elizabeth": "liz beth lizzie eliza betty bess libby", "francisco": "paco pancho fran frank cisco", "frederick": "fred freddie freddy fritz", "gregory": "greg gregg",
    "guadalupe": "lupe lupita", "harold": "harry hal", "ignacio": "nacho iggy", "isabella": "bella izzy isa belle", "james": "jim jimmy jamie jem", "johannes": "hannes jo hans joe", "joseph": "joe joey jo",
    "katherine": "kate kathy kat katie kit kitty", "leonard": "leo len lenny lennie", "margaret": "maggie meg peggy greta marge", "michael": "mike mick mickey micky", "nicholas": "nick nico nicky claus",
    "oliver": "ollie oli", "patricia": "pat patty tricia trish patsy", "quentin": "quen quin", "richard": "rick dick richie rich ricky", "robert": "rob bob bobby robbie bert", "samuel": "sam sammy",
    "susan": "sue susie suzy", "theodore": "theo ted teddy", "thomas": "tom tommy", "ulrike": "uli rike ulla", "veronica": "vera ronnie roni nica", "victoria": "vicky vic tori vickie", "vikram": "vik vicky",
    "wilhelmina": "mina willa billie minnie wilma", "william": "will bill billy liam willy", "yevgenia": "zhenya eugenia genia jenya", "zachary": "zach zack zac", "alexandra": "alex sandra sasha lexi", "andrew": "andy drew",
    "anthony": "tony", "catherine": "cathy kate cat", "david": "dave davy", "jennifer": "jen jenny", "jonathan": "jon jonny", "matthew": "matt", "stephen": "steve", "timothy": "tim", "walter": "walt wally", "rebecca": "becky",
}
FORMAL: dict[str, frozenset[str]] = {}
for _formal, _nicks in NICKNAMES.items():
    for _n in _nicks.split():
        FORMAL[_n] = FORMAL.get(_n, frozenset()) | {_formal}

#: One of the names that are linked by nicknames, directly or by way of others: equal for any two of them.
KIN: dict[str, str] = {}
for _formal, _nicks in NICKNAMES.items():
    _all = {_formal, *_nicks.split()}
    _all |= {t for t, k in KIN.items() if k in {KIN.get(n) for n in _all}}
    KIN |= dict.fromkeys(_all, min(_all))

_TITLES = frozenset("mr mrs ms miss mx dr prof sir dame lord lady rev hon".split())
_SUFFIX = re.compile(
    r"\b(?:gesellschaft mit beschrankter haftung|public limited company|limited liability partnership|limited liability company|societe a responsabilite limitee|societe anonyme|sociedad anonima|"
    r"besloten vennootschap|aktiengesellschaft|naamloze vennootschap|in administration|in liquidation|private limited)\b"
)
#: Words that a name may carry or lack: legal forms, articles and fillers.
NOISE = frozenset(
    "the and of group grp co company trust ltd limited limted plc llp llc lp inc incorporated corp corporation gmbh ag sa sarl sas bv nv srl spa oy ab as kg ohg se pty pte et und de ltda uk".split()
)
_NUMERAL = re.compile(r"^(?:i{2,3}|iv|vi{1,3}|ix|\d+)$")
_LEET = str.maketrans("01358", "olesb")
#: A token is common from this share of all names on (the ``MAX_COMMON`` commonest at most; any other is indexed as a rare one).
COMMON_SHARE, COMMON_LEAST, MAX_COMMON = 1 / 1000, 50, 8_000
#: Names under one index key are paired in blocks of about this many.
BLOCK = 1_000


def fold(text: str) -> str:
    """Lower case without accents; run-together words parted where a capital follows a small letter."""
    parted = re.sub(r"(?<=[^\W\d_A-ZÀ-Þ])(?=[A-ZÀ-Þ])", " ", text) if not text.isupper() else text
    flat = unicodedata.normalize("NFKD", parted.casefold())
    return "".join(c for c in flat if not unicodedata.combining(c)).replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("đ", "d")


@lru_cache(maxsize=200_000)
def name_tokens(name: str) -> tuple[str, ...]:
    """The words of a name that count, in order: no titles, legal forms, articles, additions in brackets."""
    s = fold(re.sub(r"\([^)]*\)", " ", name))
    s = re.sub(r"\b((?:\w\.){2,})", lambda m: m[0].replace(".", "") + " ", s)
    s = _SUFFIX.sub(" ", re.sub(r"[^\w&]+", " ", s.replace("'", "")))
    words = [w.translate(_LEET) if re.search(r"[a-z]", w) and re.search(r"\d", w) else w for w in re.findall(r"[^\W_]+", s)]
    core = [w for w in words if w not in NOISE and w not in _TITLES]
    return tuple(core or [w for w in words if w not in _TITLES] or words)


def within_one(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours turns ``a`` into ``b``."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    if len(a) < len(b):
        return a[k:] == b[k + 1 :]
    return a[k + 1 :] == b[k + 1 :] or a[k + 2 :] == b[k + 2 :] and a[k : k + 2] == b[k : k + 2][::-1]


def _within_two(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 2:
        return False
    if within_one(a, b):
        return True
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    x, y = a[k:], b[k:]
    return within_one(x[1:], y) or within_one(x, y[1:]) or within_one(x[1:], y[1:]) or (x[:2] == y[:2][::-1] and within_one(x[2:], y[2:]))


EQUAL, NICK, SHORT, INITIAL, SLIP, SLIPS = 0.0, 0.15, 0.2, 0.3, 0.4, 0.8


@lru_cache(maxsize=500_000)
def token_cost(a: str, b: str) -> float | None:
    """What it takes to read two tokens as one; None if they differ."""
    if a == b:
        return EQUAL
    if _NUMERAL.match(a) or _NUMERAL.match(b):
        return None
    s, t = sorted((a, b), key=len)
    if len(s) == 1:
        return INITIAL if t[0] == s or any(f[0] == s for f in FORMAL.get(t, ())) else None
    if t in FORMAL.get(s, ()) or s in FORMAL.get(t, ()) or FORMAL.get(s, frozenset()) & FORMAL.get(t, frozenset()):
        return NICK
    if len(s) >= 3 and len(t) - len(s) >= 2 and s[0] == t[0]:
        if t.startswith(s) and len(s) >= 3:
            return SHORT
        it = iter(t)
        if len(s) <= 6 and all(c in it for c in s) and (s[-1] == t[-1] or s[-1] == "s" or not set(s[1:]) & set("aeiou")):
            return SHORT
    if len(s) >= 4 and within_one(a, b):
        return SLIP
    if len(s) >= 6 and _within_two(a, b):
        return SLIPS
    if any(len(f) > 4 and within_one(s if t == n else t, f) for n in (s, t) for f in FORMAL.get(n, ())):
        return NICK + SLIP
    return None


def align(a: tuple[str, ...], b: tuple[str, ...], spare: bool = False) -> tuple[float, int, int] | None:
    """The cheapest one-to-one reading of two token lists ``(cost, slips, initials)``; None if a token has no partner.

    With ``spare``, the longer of the two may have one more (a middle name that the other lacks).
    """
    if len(a) > len(b):
        a, b = b, a
    if not len(a) <= len(b) <= len(a) + spare * (len(a) > 1) or not a:
        return None
    if len(b) > 8:
        return _align_long(a, b)
    best: dict[int, tuple[float, int, int]] = {0: (0.0, 0, 0)}
    for x in a:
        step: dict[int, tuple[float, int, int]] = {}
        for used, (cost, slips, initials) in best.items():
            for k, y in enumerate(b):
                if not used >> k & 1 and (c := token_cost(x, y)) is not None:
                    got = (cost + c, slips + (c >= SLIP) + (c >= SLIPS), initials + (c == INITIAL))
                    if used | 1 << k not in step or got < step[used | 1 << k]:
                        step[used | 1 << k] = got
        best = step
        if not best:
            return None
    return min(best.values())


def _align_long(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[float, int, int] | None:
    """``align`` for long names, by the Hungarian method with potentials."""
    never = 1e6
    cost = [[never if (c := token_cost(x, y)) is None else c for y in b] for x in a]
    n, m = len(a), len(b)
    u, v, match, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    chosen = [cost[match[j] - 1][j - 1] for j in range(1, m + 1) if match[j]]
    if max(chosen) >= never:
        return None
    return sum(chosen), sum((c >= SLIP) + (c >= SLIPS) for c in chosen), sum(c == INITIAL for c in chosen)


_POST = re.compile(r"\b([a-z]{1,2}\d{1,2}[a-z]?)\s*(\d[a-z]{2})\b")


@lru_cache(maxsize=200_000)
def address_parts(text: str) -> tuple[str, str, str]:
    """``house number, first word of the street, postcode`` as far as written."""
    s = fold(text)
    post = _POST.search(s)
    rest = s[: post.start()] + s[post.end() :] if post else s
    rest = re.sub(r"\b(?:unit|flat|apt|suite|room|floor)\.?\s*\w+\s*,|\bc/o\b[^,]*,", " ", rest)
    m = re.search(r"\b(\d+[a-z]?)\b\s*,?\s*([a-z]+)", rest)
    return (m[1] if m else "", m[2] if m else "", post[1] + post[2] if post else "")


def address_verdict(a: str, b: str) -> int:
    """1: one place as far as written; 0: nothing to compare; -1: two places."""
    (n, s, p), (m, t, q) = address_parts(a), address_parts(b)
    same_house = bool(n) and n == m and (token_cost(s, t) is not None if s and t else True)
    if p and q:
        return -1 if p != q and not same_house or n and m and n != m else 1
    if n and m:
        return 1 if same_house else -1
    return 0


def _shorter(t: str) -> set[str]:
    """A token and, from four letters on, what is left of it without any one letter."""
    return {t} | {t[:k] + t[k + 1 :] for k in range(len(t))} if len(t) >= 4 else {t}


@lru_cache(maxsize=200_000)
def _number(t: str) -> int:
    return int.from_bytes(blake2b(KIN.get(t, t).encode(), digest_size=8).digest(), "big")


def common_keys(tokens: tuple[str, ...], address: str, day: str, common: frozenset, near_common: frozenset) -> set[str]:
    """Entries by which names meet that share common tokens only: one token as it may be spelled, with all others or a place or date.

    Without a common place or date a pair passes with one slip and one initial at most.  Its other
    tokens are equal or nicknames, whose sum (of a number per family of nicknames) is the same
    whatever their order.
    """
    total, out = sum(map(_number, tokens)), set()
    rare = {t for t in tokens if t not in common and t not in KIN and len(t) >= 4 and not _NUMERAL.match(t)}
    lettered = Counter(t for t in tokens if not _NUMERAL.match(t))
    n_lettered = lettered.total()
    number, _, post = address_parts(address)
    places = {f"n{number}" if number else "", f"p{post}" if post else "", f"d{day}" if day else ""} - {""}
    entry = lambda kind, rest, x="": f"{kind}{rest % 2**64:x} {x}"
    out.add(entry("=", total))
    if not day and not rare:
        out.add(entry("+", total))
    for t in set(tokens):
        # what holds another rare token is met by that token and the initial of a third, or of this one
        rest, others = total - _number(t), rare - {t} if lettered[t] == 1 else rare
        if not day and not others and len(tokens) > 2:
            out.add(entry("+", rest))
        if t not in lettered:
            continue
        forms = _shorter(t).union(*(_shorter(f) for f in FORMAL.get(t, ()) if len(f) > 4))
        if t in common or forms & near_common:
            out |= {f"@{c} {v}" for v in forms for c in places}
        if not others:
            out |= {entry("~", rest, v) for v in forms}
            out |= {entry("i", rest, i) for i in {t[0]} | {f[0] for f in FORMAL.get(t, ())}}
            out |= {entry("^", rest, t[:k]) for k in (*range(3, len(t) - 1), len(t)) if k >= 3}
        elif n_lettered < 3:
            out |= {entry("~", rest, v) for v in forms if v == t or v in (t[1:], t[0] + t[2:]) or t in FORMAL}
    return out


def index_keys(tokens: tuple[str, ...], address: str, day: str, common: frozenset, near_common: frozenset) -> set[str]:
    """The entries of one name in the symmetric-delete index."""
    shorter = _shorter
    out = common_keys(tokens, address, day, common, near_common)
    own = [t for t in tokens if t not in common and len(t) >= 4 and not _NUMERAL.match(t)]
    initials = {t: {t[0]} | {f[0] for f in FORMAL.get(t, ())} for t in set(tokens) if not _NUMERAL.match(t)}
    total = Counter(i for t in tokens if t in initials for i in initials[t])
    for t in set(own):
        others = {i for i, n in total.items() if n > (i in initials[t])} or {""}
        out |= {f"{v}|{i}" for v in shorter(t) for i in others}
    number, street, post = address_parts(address)
    # two slips in one token pass only beside a common address or date, so a common token leads to them with these
    places = {f"n{number}{street[:3]}" if number else "", f"p{post}" if post else "", f"d{day}" if day else ""} - {""}
    out |= {f"{t[:3]}!{c}" for t in set(tokens) - set(own) if len(t) > 2 for c in places}
    if not own or any(shorter(t) & near_common for t in own):
        # names made of common words alone, and their misspellings, need a corroborating attribute
        exact = sorted(max(FORMAL.get(t, {t})) for t in tokens)
        support = {f"n{number}" if number else "", f"p{post}" if post else "", f"d{day}" if day else ""} - {""}
        formal = {t: min(FORMAL.get(t, {t}))[0] for t in initials}
        letters = Counter(formal.values())
        for t in initials:
            if len(t) >= 4:
                others = "".join(sorted((letters - Counter([formal[t]])).elements()))
                out |= {f"{v}~{others}~{c}" for v in shorter(t) for c in support}
        out.add("=" + " ".join(exact))
    return out


_COLUMNS = ("entity_id", "name", "jurisdiction", "formation_date", "address", "entity_type")


def _class_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        tokens = [" ".join(name_tokens(n)) for n in frame["name"]]
        yield pd.DataFrame({"entity_id": frame["entity_id"], "tokens": tokens, "jurisdiction": frame["jurisdiction"], "day": frame["day"], "address": frame["address"], "person": frame["person"]})


def variant_pairs(entities: DataFrame) -> DataFrame:
    """``entity_a < entity_b``: all pairs of ids of one class of ``variant_classes``."""
    classes = materialize(variant_classes(entities), "grouped")
    one, two = classes.select("class_id", F.col("entity_id").alias("entity_a")), classes.select("class_id", F.col("entity_id").alias("entity_b"))
    return one.join(two, "class_id").where("entity_a < entity_b").select("entity_a", "entity_b")


def variant_classes(entities: DataFrame) -> DataFrame:
    """``entity_id, class_id``: every id that means the same person or organisation as another, with a number of its class.

    Rows without id or without a letter or digit in their name link to nothing; a row repeated
    under its own id is one; missing attributes contradict nothing; extra columns are ignored.
    An initial that, without a common address, fits several given names links to none.
    """
    have = [c if c in entities.columns else F.lit(None).cast("string").alias(c) for c in _COLUMNS]
    rows = entities.select(*have).where("entity_id IS NOT NULL AND name IS NOT NULL").groupBy("entity_id").agg(
        F.min(F.struct("name", F.col("jurisdiction").alias("jurisdiction"), F.date_format("formation_date", "yyyy-MM-dd").alias("day"), "address", (F.lower("entity_type") == "person").alias("person"))).alias("r")
    )
    rows = rows.select("entity_id", "r.name", F.coalesce("r.jurisdiction", F.lit("")).alias("jurisdiction"), F.coalesce("r.day", F.lit("")).alias("day"), F.coalesce("r.address", F.lit("")).alias("address"), F.coalesce("r.person", F.lit(False)).alias("person"))
    named = rows.mapInPandas(_class_rows, "entity_id string, tokens string, jurisdiction string, day string, address string, person boolean").where("tokens <> ''")
    named = materialize(named.withColumn("row", F.monotonically_increasing_id()), "names")

    # rows alike in everything that counts are one class; pairs are sought between classes
    form = ["tokens", "jurisdiction", "day", "address"]
    classes = materialize(named.groupBy(*form).agg(F.min("row").alias("cls"), F.max("person").alias("person")), "classes")
    total = classes.count()
    words = classes.select(F.explode(F.array_distinct(F.split("tokens", " "))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    common = frozenset(r[0] for r in words.where(F.col("n") >= max(COMMON_LEAST, int(total * COMMON_SHARE))).orderBy(F.desc("n"), "w").limit(MAX_COMMON).select("w").collect())
    near = frozenset(v for t in common if len(t) >= 4 for v in _shorter(t))

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys = [list(index_keys(tuple(t.split(" ")), a, d, common, near)) for t, d, a in zip(frame["tokens"], frame["day"], frame["address"])]
            yield pd.DataFrame({"keys": keys, "cls": frame["cls"], "j": frame["jurisdiction"], "d": frame["day"], "n": frame["tokens"].str.count(" ")}).astype({"n": "int32"})

    entered = classes.select("cls", "tokens", "day", "address", "jurisdiction").mapInPandas(keyed, "keys array<string>, cls long, j string, d string, n int")
    postings = materialize(entered.select(F.explode("keys").alias("key"), "cls", "j", "d", "n").withColumn("key", F.xxhash64("key")), "index")
    # names under a key with very many are paired block by block: each meets all blocks, in as many tasks
    crowded = postings.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    index = postings.join(crowded, "key")
    left = index.select("key", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("block"), F.col("cls").alias("a"), F.col("j").alias("ja"), F.col("d").alias("da"), F.col("n").alias("na"))
    right = index.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("cls").alias("b"), F.col("j").alias("jb"), F.col("d").alias("db"), F.col("n").alias("nb"))
    # what the verdict below would reject for its attributes or its number of words is not even a pair
    pairs = left.join(right, ["key", "block"]).where("a < b AND (ja = jb OR ja = '' OR jb = '') AND (da = db OR da = '' OR db = '') AND abs(na - nb) <= 1").select("a", "b").distinct()

    side = lambda s: classes.select(F.col("cls").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in [*form, "person"]])
    full = pairs.join(side("a"), "a").join(side("b"), "b")

    def judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for a, b, ta, tb, ja, jb, da, db, pa, pb, person in zip(f["a"], f["b"], f["tokens_a"], f["tokens_b"], f["jurisdiction_a"], f["jurisdiction_b"], f["day_a"], f["day_b"], f["address_a"], f["address_b"], f["person_a"] | f["person_b"]):
                x, y = tuple(ta.split(" ")), tuple(tb.split(" "))
                got = align(x, y, spare=person and not da and not db)
                if got is None or got[1] > 3:
                    continue
                where = address_verdict(pa, pb)
                support = where == 1 or da and da == db
                spared = len(x) != len(y)
                if spared and not support and (ja != jb or not ja or got[0] > NICK):
                    continue
                if where < 0 or got[1] > 1 and not support or got[2] > 1 and not support or not support and ja != jb and got[1] + got[2] > 0:
                    continue
                # the row whose initial stands for a given name, and the letters that name begins with
                short, given = -1, ""
                if got[2] and where != 1:
                    one, other, short = (x, y, a) if any(len(t) == 1 for t in x) else (y, x, b)
                    given = min((t[:2] for t in other if any(len(s) == 1 and token_cost(s, t) == INITIAL for s in one)), default="")
                out.append((a, b, short, given))
            yield pd.DataFrame(out, columns=["a", "b", "short", "given"]).astype({"a": "int64", "b": "int64", "short": "int64"})

    kept = materialize(full.mapInPandas(judged, "a long, b long, short long, given string"), "judged")
    release(postings)
    unclear = kept.where("short >= 0").groupBy("short").agg(F.min("given").alias("x"), F.max("given").alias("y")).where("x <> y").select("short")
    links = kept.join(unclear, "short", "left_anti").select("a", "b")

    named = named.join(classes, form).select("entity_id", "row", "cls")
    named = materialize(named, "members")
    same = named.where("row <> cls").select(F.col("cls").alias("a"), F.col("row").alias("b"))
    groups = connected_groups(links.unionByName(same), "a", "b")
    return named.join(groups, named["row"] == groups["member"]).select("entity_id", F.col("group_id").alias("class_id"))
