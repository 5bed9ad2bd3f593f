"""Personal information in free text: find it, replace it by typed, keyed surrogates.

Detection goes in the order e-mail, identity number, phone, address, name; a later kind never
overlaps an earlier one, so no name is found inside an e-mail address.  Names are found by lists
of given names in common use, by two small models on the letters of a word (trained here on those
lists and a public vocabulary), by the commoner spelling of a word there, and by cues around it.

Replacement is deterministic under a secret key and composed of parts.  The parts of a piece are
its given name (a nickname counts as its formal name), its family name, each word of an address,
or a whole e-mail address; each distinct part gets one surrogate, drawn again until no two parts
share one.  So all writings of a person (``Harold Smith``, ``Smith, Hal``, ``H. Smith``) agree in
their surrogates.  Digits and the letters of numbers go through a keyed permutation of numbers of
their length, which cannot collide.  A surrogate keeps the kind, gender, script, letter case,
order and format of what it replaces.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
import unicodedata
from base64 import b64decode
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.given_names import AMBIGUOUS, FEMALE, MALE
from lodestream.llm.names import FORMAL
from lodestream.operators.skew import hot_keys, join_unique
from lodestream.scratch import materialize

KINDS = ("EMAIL", "ID", "PHONE", "ADDRESS", "NAME")

#: A public vocabulary with ranks by frequency; which spelling of a word is the commoner tells words from proper names.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words that are no part of a name whatever their spelling: closed classes, calendar, greetings, field labels, abbreviations.
CLOSED = frozenset(
    "a an the this that these those i you he she it we they me him her us them my your his its our their who whom whose which what and or but nor so yet for to from in on at of by with as if than then when while because not no yes is are was were be been am do does did has have had "
    "will would shall should can could may might must please thanks thank hi hello hey dear regards cheers best sincerely cc re fwd fyi asap ps monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december "
    "der die das ein eine und oder mit von für im am zum zur ist sind bitte danke hallo grüße herr frau el la los las un una y o con para por de del es son hola gracias saludos le les une et ou avec pour du des est bonjour merci id ids ssn nino ni dni nie nif tin tax passport pass "
    "tel phone mail email http https url json api sla slo crm ok lgtm kyc qq npm pr ci".split()
)
TITLES = r"(?:Dr|Prof|Mrs?|Ms|Miss|Mx|Frau|Herr|Sra?|Señora?|Mme|Mlle|Sir)\b\.?"
_L = r"[^\W\d_]"
_UPPER = r"[A-ZÀ-ÖØ-Þ]"

_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|DOT|\.)\s?[\])}]\s?|\s(?:dot|DOT)\s)"
_EMAIL = re.compile(
    r"(?<![\w.+%/@-])(?P<local>[A-Za-z0-9](?:[\w.+%-]*\w)?)"
    r"(?:@|\s?[\[({]\s?(?:at|AT|@)\s?[\])}]\s?|\s(?:at|AT)\s(?=[\w-]+(?:\.[\w-]+)*(?:\s?[\[({]\s?(?:dot|DOT)\s?[\])}]|\s(?:dot|DOT)\s)))"
    rf"(?P<domain>[A-Za-z0-9](?:[\w-]*\w)?(?:{_DOT}[A-Za-z0-9](?:[\w-]*\w)?)+)(?P<path>:[\w~/])?"
)
_ID = re.compile(
    r"(?i:(?:\b(?:ssn|social security (?:number|no\.?))(?: is| =)?[:\s#]*)(?P<ssn>\d{3}[- ]?\d{2}[- ]?\d{4})\b)"
    r"|(?<![\w-])(?P<bare>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<![A-Za-z0-9])(?P<nino>[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])(?![A-Za-z0-9])"
    r"|(?i:\b(?:dni|nie|nif)[:\s]*)(?P<dni>[XYZ]?\d{7,8}-?[A-Za-z])\b"
    r"|(?i:\b(?:passport|pass)(?: (?:no|number|nr)\.?)?[:\s#]*)(?P<pass>[A-Z]{1,2}\d{6,8})\b"
    r"|(?<![\w-])(?P<barepass>[A-Z]\d{8})(?![\w-])|(?<![\w-])(?P<baredni>\d{8}[A-Z])(?![\w-])"
    r"|(?i:\b(?:tax id|tax number|steuer-?id|idnr|tin)\.?[:\s#]*(?:is\s)?)(?P<tax>\d{2} ?\d{3} ?\d{3} ?\d{3})\b"
    r"|(?<![\d.,+-])(?<!\d )(?P<baretax>\d{2} \d{3} \d{3} \d{3})(?! ?\d)"
)
_EXT = r"(?:,?\s*(?:ext\.?|x|extension|Durchwahl|extn\.?)\s*\d{1,6})?"
_PHONE = re.compile(
    r"(?<![\w.+/@-])(?<!\d )(?:"
    r"\+\d{1,3}[ .-]?(?:\(0?\d{0,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}"
    r"|00[1-9]\d{0,2}[ .-]?(?:\(0\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,8}){1,4}"
    r"|\(\d{3,5}\)[ .-]?\d{3,4}[ .-]\d{3,4}"
    r"|\d{3}([.-])\d{3}\1\d{4}"
    r"|0\d{2,4}[ /-]\d{3,5}[ -]?\d{3,5}"
    r"|0\d{2,4}[ /]\d{4,8}(?:-\d{1,4})?"
    r")" + _EXT + r"(?![\w-]|\.\d)"
)
_EN_KIND = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Court|Ct|Drive|Dr|Boulevard|Blvd|Way|Close|Place|Pl|Square|Sq|Terrace|Ter|Crescent|Cres|Row|Gardens|Gdns|Hill|Park|Walk|Mews|Parkway|Pkwy|Highway|Hwy|Trail|Trl|Grove|Green)"
_UNIT = r"(?:(?:Flat|Apt|Apartment|Unit|Suite|Ste)\.?\s?\w{1,4},\s*)"
_UNIT_AFTER = r"(?:,\s*(?:Flat|Apt|Apartment|Unit|Suite|Ste)\.?\s?\w{1,4}\b|,\s*#\s?\d+\w?)"
_POSTCODE = r"(?i:[ ][A-Z]{1,2}\d[A-Z\d]?[ ]\d[A-Z]{2}\b)?"
_NO_TOWN = r"(?!(?i:passport|ssn|social|nino|ni|dni|nie|nif|tax|tin|id|tel|phone|mail|mobile|call|and|or)\b)"
_TOWN = rf"(?:,[ ]*(?:\d{{5}}[ ])?{_NO_TOWN}{_L}(?:{_L}|['’-])*(?:[ ]{_UPPER}(?:{_L}|['’-])+(?![\w]))*{_POSTCODE})"
_NAMED = rf"{_L}(?:{_L}|['’-])*"
_FLOOR = r"(?:,[ ]*\d{1,2}[ ]?[ºª°][ ]?[A-Za-z]?)?"
_ADDRESS = re.compile(
    rf"(?<![\w.#-])(?i:{_UNIT})?(?i:\d{{1,5}}[A-Za-z]?[ ](?:[NSEW]\.?[ ]|north[ ]|south[ ]|east[ ]|west[ ])?{_NAMED}(?:[ ]{_NAMED}){{0,2}}[ ]{_EN_KIND}\b(?:\.(?=,))?){_UNIT_AFTER}?{_TOWN}?"
    rf"|(?<![\w.#-])\d{{1,5}},?[ ](?i:rue|avenue|boulevard|place|allée|chemin|impasse|quai|route)[ ]{_NAMED}(?:[ ]{_NAMED}){{0,4}}{_TOWN}?"
    rf"|(?<!\w)(?i:calle|avenida|plaza|paseo|camino|ronda)[ ]{_NAMED}(?:[ ]{_NAMED}){{0,3}}[ ]\d{{1,4}}{_FLOOR}{_TOWN}?"
    rf"|(?<!\w)(?:{_UPPER}[\w-]*(?i:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer)|(?i:am|an[ ]der|auf[ ]der|auf[ ]dem|im|in[ ]der|zum|zur|unter[ ]den|hinter[ ]dem)[ ]{_UPPER}[\w-]+|{_UPPER}[\w-]+(?i:[ ](?:straße|str\.|weg|allee|platz|gasse|ring)))[ ]\d{{1,4}}[ ]?[a-z]?\b{_TOWN}?"
)
_STREETISH = re.compile(rf"(?i)\b{_EN_KIND}\b|\b(?:rue|calle|avenida|plaza|place|allée|chemin|paseo|camino|ronda|impasse|quai|route|am|an der|auf de[rm]|im|in der|zu[mr]|unter den)\b|(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer)\s")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_TITLE = frozenset("dr prof mr mrs ms miss mx frau herr sr sra señor señora mme mlle sir".split())
#: What stands before a person: somebody acts, is addressed, is listed or is named by a label.
_CUE_BEFORE = re.compile(
    r"(?i:\b(?:by|assigned to|i think|reach|ask|asked|tell|told|ping|call|meet|met|thank|talk(?:ed|ing)? to|sp(?:eak|oke)(?:ing)? (?:to|with)|met with|wr(?:ite|ote) to|contact|customer|client|patient|tenant|colleague|employee|manager|owner|assignee|author|signed|attn\.?|cc|"
    r"(?:lists|names|includes|invited?|hired)|(?:new|recent) (?:hire|joiner|starter)|(?:failed|pending|rejected|approved|open) ?:|(?:llamar|avisar|preguntar|escribir|contactar) a|for|next week,|thanks,? to|von|mit|avec|con|par)\"?:?,? ?\"?|"
    r"\b(?:name|contact|owner|author|from|to)\"?\s?[=:] ?\"?|(?:^|\s)\d\)(?=[ ])|\b(?:regards|cheers|best|thanks|sincerely|grüße|saludos|cordialement),|(?:talked to|spoke with|met)\s.{1,60}\sand)\s*$"
)
#: What nobody but a person stands behind.
_CUE_STRONG = re.compile(r"(?i:\bname\s?[=:]\s?|\b(?:regards|cheers|sincerely|grüße|saludos|cordialement),\s|\b(?:signed off|approved|written|reported|escalated) by\s|\b(?:talked to|spoke (?:to|with)|met with|(?:new|recent) (?:hire|joiner|starter)|(?:llamar|avisar|preguntar|escribir) a)\s)$")
#: What follows a person: a verb of saying or doing, a place, a colon of address.
_CUE_AFTER = re.compile(r"\s(?:said|says|approved|called|calls|broke|covers|starts|started|lives|wrote|writes|asked|asks|thinks|thought|signed|reported|joined|left|raised|opened|closed|fixed|deployed|reviewed|merged|sent|owns|works|worked|moved|wants|needs|confirmed|agreed)\b|\sat the \w+|\sand\s\S+(?:\s\S+){0,3}\sabout\b|\sat\s\x00|,?\s\(?\x00|: (?:bitte|please|por favor)|\"")
#: Code names and products are announced, or carry the noun of a thing.
_NOT_BEFORE = re.compile(r"(?i:\b(?:codename|code name|codenamed|project|branch|release|product|version|the|our|this|new|operation|team|squad)\s)$")
_NOT_AFTER = re.compile(r"(?i:\s(?:suite|service|module|release|branch|cluster|project|environment|team|squad|pipeline|api|app|platform|server|library|street|road|avenue|university|hospital|bank|hotel|park|bridge|airport|inc|ltd|llc|gmbh|plc|corp|group|limited)\b)")


def find_emails(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _EMAIL.finditer(text):
        last = re.split(r"[^A-Za-z0-9_-]+", m["domain"].rstrip(")]} "))[-1]
        if not re.fullmatch(r"[A-Za-z]{2,}", last) or m["local"].lower() == "git" or m["path"]:
            continue
        out.append((m.start("local"), m.end("domain")))
    return out


def find_ids(text: str) -> list[tuple[int, int]]:
    return [m.span(m.lastgroup) for m in _ID.finditer(text)]


def find_phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if sum(c.isdigit() for c in m[0]) >= 9]


def find_addresses(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _ADDRESS.finditer(text) if not re.match(r"(?i)\d+\s+way\b", m[0])]


_ROMAN = {c: r for block, roman in (("абвгдезийклмнопрстуфыэё", "abvgdeziyklmnoprstufyee"), ("αβγδεζηικλμνοπρστυω", "avgdeziiklmnoprstyo")) for c, r in zip(block, roman)} | {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya", "ь": "", "ъ": "", "θ": "th", "ξ": "x", "φ": "f", "χ": "ch", "ψ": "ps", "ς": "s"}


@lru_cache(maxsize=200_000)
def romanised(low: str) -> str:
    """A Cyrillic or Greek word in Latin letters, any word without its accents."""
    return "".join(_ROMAN.get(c, c) for c in plain(low))


@lru_cache(maxsize=1)
def _ranks() -> dict[bytes, int]:
    with open(VOCABULARY, "rb") as f:
        return {b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=200_000)
def is_word(low: str) -> bool:
    """Whether a lower-case spelling is a common word: closed class, or in the vocabulary in small letters about as often as capitalised."""
    if low in CLOSED:
        return True
    ranks = _ranks()
    small, big = ranks.get(b" " + low.encode()), ranks.get(b" " + low.capitalize().encode())
    return small is not None and (big is None or small <= 1.5 * big)


def _grams(low: str) -> list[int]:
    padded = f"^{low}$"
    return [int.from_bytes(hashlib.blake2s(padded[i : i + n].encode(), digest_size=4).digest(), "big") % 8192 for n in (2, 3, 4) for i in range(len(padded) - n + 1)]


def _logistic(rows: list[list[int]], y: np.ndarray, steps: int = 120, rate: float = 4.0, ridge: float = 2e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on hashed letter groups by full-batch gradient steps; deterministic."""
    at = np.concatenate([np.full(len(r), k) for k, r in enumerate(rows)])
    col = np.concatenate([np.array(r) for r in rows])
    val = np.concatenate([np.full(len(r), 1 / np.sqrt(len(r))) for r in rows])
    w, bias, weight = np.zeros(8192), 0.0, np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    for _ in range(steps):
        z = np.bincount(at, w[col] * val, len(rows)) + bias
        g = weight * (1 / (1 + np.exp(-z)) - y)
        w -= rate * len(rows) ** 0.5 * (np.bincount(col, g[at] * val, 8192) + ridge * w / len(rows) ** 0.5)
        bias -= rate * g.sum()
    return w, bias


@lru_cache(maxsize=1)
def _name_models() -> tuple[tuple[np.ndarray, float], tuple[np.ndarray, float]]:
    """Two models on the letters of a word, trained on the name lists and the vocabulary: is it a given name; is it a woman's."""
    words = [k[1:].decode() for k in _ranks() if k[:1] == b" " and k[1:].isalpha() and 3 <= len(k) - 1 <= 11 and k.isascii()]
    other = sorted({w.lower() for w in words} - FEMALE - MALE)
    names = sorted(n for n in FEMALE | MALE if len(n) > 2)
    negatives = [w for k, w in enumerate(other) if k % max(1, len(other) // 6000) == 0]
    given = _logistic([_grams(w) for w in names + negatives], np.array([1.0] * len(names) + [0.0] * len(negatives)))
    sure = [n for n in names if (n in FEMALE) != (n in MALE)]
    return given, _logistic([_grams(w) for w in sure], np.array([float(n in FEMALE) for n in sure]))


def _probability(model: tuple[np.ndarray, float], low: str) -> float:
    g = _grams(low)
    return float(1 / (1 + np.exp(-(model[0][g].sum() / np.sqrt(len(g)) + model[1]))))


@lru_cache(maxsize=200_000)
def like_a_given_name(low: str, least: float = 0.5) -> bool:
    """Whether the letters of a word outside the lists are those of a given name rather than of any other word."""
    return not is_word(low) and len(low) > 2 and _probability(_name_models()[0], low) >= least


def gender_of(given: str) -> str:
    """``f`` or ``m``: by the lists where they agree, else by the letters of the name."""
    low = plain(given)
    if (low in FEMALE) != (low in MALE):
        return "f" if low in FEMALE else "m"
    return "f" if _probability(_name_models()[1], low or "a") >= 0.5 else "m"


def _given(word: str) -> bool:
    low = word.lower()
    return low in FEMALE or low in MALE or not low.isascii() and romanised(low) in FEMALE | MALE


def find_names(text: str) -> list[tuple[int, int]]:
    """Spans of person names: full names in any order and case, with title or initial, and given names alone.

    A name starts with a listed given name, with a title or initial, with a word whose letters are
    those of a given name, or (all capitalised words) where both neighbours point to a person.
    What a family name is, is told by its spelling in the vocabulary: common words follow only
    given names that are no word or place themselves.
    """
    words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
    n, out, k = len(words), [], 0

    def surname(j: int, upper: bool, strict: bool = True) -> bool:
        w = words[j][2]
        if len(w) < 2 or not w[0].isupper() or w.lower() in CLOSED or w.isupper() and not upper and len(w) < 5 or upper and not w.isupper():
            return False
        return not strict or not is_word(w.lower())

    def gap(j: int) -> str:
        """What stands between word j and the next."""
        return text[words[j][1] : words[j + 1][0]] if j + 1 < n else "\n"

    def dotted(j: int) -> bool:
        """Whether word j is an initial with its dot."""
        return len(words[j][2]) == 1 and words[j][2].isupper() and text[words[j][1] : words[j][1] + 1] == "."

    def before(start: int) -> bool:
        """Whether the words before point to a person; so does another person in the same list."""
        return bool(_CUE_BEFORE.search(text[max(0, start - 80) : start])) or bool(out) and text[out[-1][1] : start] in (" and ", " & ", ", ", " und ", " y ", " et ")

    def strong(start: int) -> bool:
        return bool(_CUE_STRONG.search(text[max(0, start - 30) : start]))

    def swapped_pair(j: int, upper: bool, start: int) -> bool:
        """Whether words j and j + 1 are a family name and an unlisted given name: neither is any known word, and the words around point to a person."""
        w, g = words[j][2], words[j + 1][2]
        if not surname(j, upper) or len(g) < 3 or is_word(g.lower()) or b" " + w.capitalize().encode() in _ranks():
            return False
        after = bool(_CUE_AFTER.match(text, words[j + 1][1]))
        return strong(start) or like_enough(g.lower(), before(start), after)

    while k < n:
        start, end, word = words[k]
        first = k
        k += 1
        if start and text[start - 1] in "_@/#.-=" and not (text[start - 1] == "=" and text[max(0, start - 5) : start] == "name="):
            continue
        low = word.lower()
        if not word[0].isupper():
            # both names in small letters, where the words around point to a person
            if word.islower() and _given(word) and gap(first) == " ":
                w, stop = words[first + 1][2], words[first + 1][1]
                if w.islower() and len(w) > 3 and not is_word(w) and (before(start) or low not in AMBIGUOUS and _CUE_AFTER.match(text, stop)):
                    out.append((start, stop))
                    k = first + 2
            continue
        if low in _PLACE_HEADS and gap(first) == " " and words[k][2][0].isupper():
            k += 1
            continue
        titled = low in _TITLE and gap(first) in (" ", ". ")
        j = first + 1 if titled else first
        if titled and not (words[j][2][0].isupper() and words[j][2].lower() not in CLOSED | _TITLE):
            continue
        w, stop, last = words[j][2], 0, j
        low, upper, given = w.lower(), w.isupper() and len(w) > 1, _given(w)
        clear = given and low not in AMBIGUOUS
        if len(w) == 1:  # initial and surname
            if gap(j) in (". ", ".") and surname(j + 1, False):
                stop, last = words[j + 1][1], j + 1
        elif gap(j) == ", " and words[j + 1][2][0].isupper() and (surname(j, upper, False) and _given(words[j + 1][2]) or swapped_pair(j, upper, start)) and not (given and gap(j + 1) == " " and surname(j + 2, False)):
            stop, last = words[j + 1][1], j + 1
            if gap(last) == " " and dotted(last + 1):
                stop, last = words[last + 1][1] + 1, last + 1
        else:
            i = j + 1 if gap(j) == " " else n
            last_word = i + 1 if i + 1 < n and dotted(i) and gap(i) == ". " else i
            after = words[last_word][1] if i < n else end
            person = given or titled or surname(j, upper) and (before(start) or bool(_CUE_AFTER.match(text, after)) or b" " + w.encode() in _ranks() and like_a_given_name(low))
            if not person:
                continue
            if i < n and dotted(i):
                if gap(i) == ". " and surname(i + 1, upper):
                    stop, last = words[i + 1][1], i + 1
                elif given or titled:
                    stop, last = words[i][1] + 1, i
            elif (given or titled) and i + 1 < n and words[i][2] in _PARTICLES and (m := _behind_particles(words, i, text)) and surname(m, False, False):
                stop, last = words[m][1], m
            elif i < n and surname(i, upper, not (clear or titled)) and (given or titled or not _NOT_BEFORE.search(text[max(0, start - 20) : start]) and not _NOT_AFTER.match(text, after) and (strong(start) and not is_word(low) or like_enough(low, before(start), bool(_CUE_AFTER.match(text, after))))):
                stop, last = words[i][1], i
            elif titled or clear or given and (before(start) or bool(_CUE_AFTER.match(text, end))) or before(start) and _CUE_AFTER.match(text, end) and surname(j, upper):
                stop = words[j][1]
        if stop and not _NOT_BEFORE.search(text[max(0, start - 20) : start]):
            out.append((start, stop))
            k = last + 1
    return out


#: Small words inside family names, and first words of places called after people or directions.
_PARTICLES = frozenset("van von de da do dos das del della di du la le den der ter ten zu af al bin ibn ben".split())
_PLACE_HEADS = frozenset("san santa sankt saint st new fort port mount lake north south east west great".split())


def _behind_particles(words: list[tuple[int, int, str]], i: int, text: str) -> int:
    """The word after a run of at most three particles that blanks alone part, or 0."""
    for m in range(i, min(i + 3, len(words) - 1)):
        if words[m][2] not in _PARTICLES or text[words[m][1] : words[m + 1][0]] != " ":
            return 0
        if words[m + 1][2] not in _PARTICLES:
            return m + 1
    return 0


def like_enough(low: str, before: bool, after: bool) -> bool:
    """Whether an unlisted first name is one: by its letters beside a cue, more leniently where no vocabulary knows it, or by two cues."""
    known = b" " + low.capitalize().encode() in _ranks()
    return before and after or (before or after or known) and like_a_given_name(low, 0.5 if not before else 0.25 if known else 0.1)


_DIGIT = re.compile(r"\d")
_RUN = re.compile(r"\d(?:[ ./()-]{0,3}\d){5}")
def find_pii(text: str) -> list[tuple[int, int, str]]:
    """All pieces ``(start, end, kind)`` from the left; pieces never overlap."""
    out: list[tuple[int, int, str]] = []
    low = text.lower()
    shown = text

    def take(kind: str, spans: list[tuple[int, int]]) -> None:
        nonlocal shown
        kept, at = [], 0
        for a, b in spans:
            if a >= at and "\x00" not in shown[a:b]:
                out.append((a, b, kind))
                kept += [shown[at:a], "\x00" * (b - a)]
                at = b
        if kept:
            shown = "".join([*kept, shown[at:]])

    if "@" in low or "(at" in low or "[at" in low or "( at" in low or "[ at" in low or "{at" in low or " at " in low and "dot" in low:
        take("EMAIL", find_emails(shown))
    if _RUN.search(shown):
        take("ID", find_ids(shown))
        take("PHONE", find_phones(shown))
    if _DIGIT.search(shown) and _STREETISH.search(shown):
        take("ADDRESS", find_addresses(shown))
    take("NAME", find_names(shown))
    return sorted(out)


_PIECES = "row long, pii_kind string, nth int, start int, stop int, piece string, parts array<string>"


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for row, text in zip(frame["row"], frame["text"]):
            seen = dict.fromkeys(KINDS, 0)
            for a, b, kind in find_pii(text):
                seen[kind] += 1
                out.append((row, kind, seen[kind], a, b, text[a:b], parts_of(kind, text[a:b])))
        yield pd.DataFrame(out, columns=["row", "pii_kind", "nth", "start", "stop", "piece", "parts"]).astype({"row": "int64", "nth": "int32", "start": "int32", "stop": "int32"})


def pii_pieces(signals: DataFrame, id_col: str = "delivery_no", text_col: str = "content") -> DataFrame:
    """One row per piece: ``<id>, pii_kind, nth, start, stop, piece``, offsets in code points.

    Null or empty texts and null ids have none; repeated rows give repeated pieces; extra columns
    are ignored; texts of any length are read whole.
    """
    texts = signals.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & (F.col(text_col) != "")).select(F.col(id_col).cast("long").alias("row"), F.col(text_col).alias("text"))
    return texts.mapInPandas(_pieces, _PIECES).drop("parts").withColumnRenamed("row", id_col)


# ---- surrogates -----------------------------------------------------------------------------

_VOWELS, _CONSONANTS = "aeiou", "bdfgklmnprstvz"
_ENDS = {"f": ("a", "ia", "ina", "elle", "ette", "ora", "isa", "enne"), "m": ("an", "or", "us", "ik", "ert", "on", "ard", "im")}
_STREET_WORDS = frozenset(
    "street st road rd lane ln avenue ave court ct drive dr boulevard blvd way close place pl square sq terrace ter crescent cres row gardens gdns hill park walk mews parkway pkwy highway hwy trail trl grove green flat apt apartment unit suite ste north south east west n s e w "
    "rue allée chemin impasse quai route calle avenida plaza paseo camino ronda de del la las los des du am an der auf dem im in zum zur unter den hinter straße strasse str weg gasse allee platz ring damm ufer".split()
)
_STREET_ENDS = re.compile(r"(?i)^(.{2,}?)(straße|strasse|weg|gasse|allee|platz|damm|ufer|str)$")


def _bits(key: str, *what: object) -> int:
    return int.from_bytes(hmac.new(key.encode(), "\x1f".join(map(str, what)).encode(), hashlib.sha256).digest(), "big")


@lru_cache(maxsize=200_000)
def plain(text: str) -> str:
    """Lower case without accents or repeated blanks."""
    return " ".join("".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c)).split())


def _name_parts(piece: str) -> tuple[str, str, str, str, bool]:
    """``title, given, middle, surname, surname first`` of a written name; an initial stands for the name it begins."""
    words = piece.split()
    title = words[0] if words[0].rstrip(".").lower() in _TITLE and len(words) > 1 else ""
    rest = words[1:] if title else words
    if len(rest) > 1 and rest[0].endswith(","):
        return title, rest[1], " ".join(rest[2:]), rest[0][:-1], True
    if len(rest) == 1:
        return (title, "", "", rest[0], False) if title or not _given(rest[0]) else ("", rest[0], "", "", False)
    return title, rest[0], " ".join(rest[1:-1]), rest[-1], False


def _formal(given: str) -> str:
    """The formal name that a nickname stands for if there is one such name, else the name itself."""
    low = romanised(given.lower())
    formal = FORMAL.get(low, frozenset())
    return next(iter(formal)) if len(formal) == 1 else low


def parts_of(kind: str, piece: str) -> list[str]:
    """What of a piece needs a surrogate of its own; numbers and initials do not, for they are permuted."""
    if kind == "NAME":
        _, given, _, surname, _ = _name_parts(piece)
        out = [f"G:{gender_of(_formal(given))}:{_formal(given)}"] if len(given.rstrip(".")) > 1 else []
        return out + ([f"S:{romanised(surname.lower())}"] if len(surname.rstrip(".")) > 1 else [])
    if kind == "EMAIL":
        low = re.sub(r"\s?[\[({]?\s?\bdot\b\s?[\])}]?\s?", ".", re.sub(r"\s?[\[({]\s?at\s?[\])}]\s?|\sat\s", "@", piece.casefold()))
        return [f"E:{low}"]
    if kind == "ADDRESS":
        return [f"A:{w}" for w in dict.fromkeys(_stem(m[0])[0] for m in _WORD.finditer(piece)) if w]
    return []


def _stem(word: str) -> tuple[str, str]:
    """``what is to be replaced, what stays`` of a word in an address: kinds of streets, units and articles stay."""
    if word.lower() in _STREET_WORDS or len(word) < 3:
        return "", word
    m = _STREET_ENDS.match(word)
    return (plain(m[1]), m[2]) if m else (plain(word), "")


def permuted_letter(key: str, letter: str) -> str:
    """A keyed permutation of the letters, so that initials agree with the names they stand for."""
    if not "a" <= letter <= "z":
        return letter
    order = sorted("abcdefghijklmnopqrstuvwxyz", key=lambda c: _bits(key, "letter", c))
    return order[ord(letter) - 97]


def permuted_number(key: str, digits: tuple[int, ...], base: int) -> tuple[int, ...]:
    """A keyed permutation of the numbers of one length to ``base``: a Feistel network whose halves are added modulo."""
    n = len(digits)
    if n == 1:
        order = sorted(range(base), key=lambda d: _bits(key, "digit", base, d))
        return (order[digits[0]],)
    value = lambda part: sum(d * base**k for k, d in enumerate(reversed(part)))
    spread = lambda v, size: tuple(v // base**k % base for k in reversed(range(size)))
    a, b = digits[: n // 2], digits[n // 2 :]
    for k in range(8):
        a, b = b, spread((value(a) + _bits(key, "round", base, n, k, b)) % base ** len(a), len(a))
    return a + b


def permuted(key: str, text: str, letters: bool) -> str:
    """``text`` with its digits (and, if ``letters``, its ASCII letters) permuted, each kind as one number; all else stays."""
    digits = [unicodedata.digit(c) for c in text if c.isdigit() and unicodedata.digit(c, -1) >= 0]
    signs = [ord(c.lower()) - 97 for c in text if letters and c.isascii() and c.isalpha()]
    drawn, spelled = iter(permuted_number(key, tuple(digits), 10) if digits else ()), iter(permuted_number(key, tuple(signs), 26) if signs else ())
    out = []
    for c in text:
        if c.isdigit() and unicodedata.digit(c, -1) >= 0:
            out.append(chr(ord(c) - unicodedata.digit(c) + next(drawn)))
        elif letters and c.isascii() and c.isalpha():
            x = chr(97 + next(spelled))
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def surrogate_of(key: str, part: str, attempt: int) -> str:
    """The surrogate of a part in small Latin letters; every four attempts it grows by a syllable, so some attempt is free."""
    kind, what = part.split(":", 1)
    bits = _bits(key, part, attempt)

    def draw(signs: str) -> str:
        nonlocal bits
        bits, d = divmod(bits, len(signs))
        return signs[d]

    def syllables(n: int) -> str:
        return "".join(draw(_CONSONANTS) + draw(_VOWELS) for _ in range(n))

    longer = attempt // 4
    if kind == "E":
        return f"{syllables(3 + longer)}{bits % 97}@{_syllables_of(key, what.rsplit('@', 1)[-1])}"
    what = what.split(":", 1)[-1]
    first = permuted_letter(key, what[:1]) if what[:1].isascii() and what[:1].isalpha() else draw(_CONSONANTS)
    body = ("" if first in _VOWELS else draw(_VOWELS)) + syllables(1 + longer) if kind == "G" else ("" if first in _VOWELS else draw(_VOWELS)) + syllables(2 + longer)
    return first + (body[:-1] + draw(_ENDS[part[2]]) if kind == "G" else body + draw("lmnrst"))


def _syllables_of(key: str, domain: str) -> str:
    bits = _bits(key, "domain", domain)
    return "".join(_CONSONANTS[bits >> 8 * k & 255 & 13] + _VOWELS[(bits >> 8 * k + 4 & 15) % 5] for k in range(3)) + "".join(_CONSONANTS[(bits >> 40 + 5 * k & 31) % 14] for k in range(2))


_TO_CYRILLIC = dict(zip("abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопкрстувюксз"))
_TO_GREEK = dict(zip("abcdefghijklmnopqrstuvwxyz", "αβκδεφγηιικλμνοπκρστυβουξυζ"))


def _written_like(core: str, piece: str) -> str:
    """A surrogate in the script and letter case of what it replaces."""
    script = next((unicodedata.name(c, "").split(" ")[0] for c in piece if c.isalpha()), "")
    core = "".join({"CYRILLIC": _TO_CYRILLIC, "GREEK": _TO_GREEK}.get(script, {}).get(c, c) for c in core)
    letters = [c for c in piece if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return core.upper()
    return core.capitalize() if letters and letters[0].isupper() else core


def render(key: str, kind: str, piece: str, cores: dict[str, str]) -> str:
    """The surrogate in the writing of the piece: order, title, initials, case, script, separators."""
    if kind in ("ID", "PHONE"):
        extension = re.search(_EXT + "$", piece) if kind == "PHONE" else None
        cut = extension.start() if extension else len(piece)
        return permuted(key, piece[:cut], kind == "ID") + (permuted(key, piece[cut:], False) if cut < len(piece) else "")
    if kind == "EMAIL":
        local, domain = cores[parts_of(kind, piece)[0]].split("@")
        m = re.search(r"\s?[\[({]\s?(?i:at)\s?[\])}]\s?|\s(?i:at)\s|@", piece)
        dot = re.search(r"\s?[\[({]\s?(?i:dot|\.)\s?[\])}]\s?|\s(?i:dot)\s|\.", piece[m.end() :])
        text = f"{local}{m[0]}{domain}{dot[0] if dot else '.'}example"
        return text.upper() if piece.isupper() else text
    if kind == "ADDRESS":

        def swap(m: re.Match) -> str:
            if any(c.isdigit() for c in m[0]):
                return permuted(key, m[0], len(m[0]) > 1 and m[0].isupper())
            stem, kept = _stem(m[0])
            return _written_like(cores[f"A:{stem}"], m[0][: len(m[0]) - len(kept)]) + kept if stem else m[0]

        return re.sub(r"[A-Z]{1,2}\d[A-Z\d]?[ ]\d[A-Z]{2}\b|\d+[^\W_]*|[^\W\d_]+(?:['’-][^\W\d_]+)*", swap, piece)
    title, given, middle, surname, swapped = _name_parts(piece)
    part = dict(p.rsplit(":", 1)[0].split(":")[0:1] + [p] for p in parts_of(kind, piece))
    one = lambda word, sign: permuted_letter(key, romanised(word.lower())[:1]).upper() + "." * word.endswith(".") if len(word.rstrip(".")) == 1 else _written_like(cores[part[sign]], word) if word else ""
    g, s = one(given, "G"), one(surname, "S")
    m = permuted_letter(key, middle[:1].lower()).upper() + "." if re.fullmatch(r"\w\.", middle) else ""
    return " ".join(x for x in ((title, s + ",", g, m) if swapped else (title, g, m, s)) if x)


def session_key(spark) -> str:
    """The key of ``spark.lodestream.pii.key``; without one a random key of this session, so that surrogates are stable within it only."""
    key = spark.conf.get("spark.lodestream.pii.key", None)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set("spark.lodestream.pii.key", key)
    return key


def surrogate_pieces(signals: DataFrame, key: str | None = None, id_col: str = "delivery_no", text_col: str = "content") -> DataFrame:
    """One row per piece: ``<id>, pii_kind, nth, start, stop, piece, surrogate, __t`` (a hash of the whole text).

    Distinct parts are listed once and drawn under ``key``; parts whose surrogates coincide are drawn
    again, all but the first, until all differ (an error after 64 rounds; nothing is left unreplaced).
    A part that makes up a large share of all meets a broadcast of at most 500.  Rows repeated with
    their id and text count once.
    """
    spark = signals.sparkSession
    key = key or session_key(spark)
    texts = signals.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & (F.col(text_col) != "")).select(F.col(id_col).cast("long").alias("row"), F.col(text_col).alias("text"))
    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for out in _pieces([frame.assign(row=range(len(frame)))]):
                yield out.assign(t=frame["t"].to_numpy()[out["row"]], row=frame["row"].to_numpy()[out["row"]])

    pieces = materialize(texts.withColumn("t", F.xxhash64("text")).mapInPandas(found, _PIECES + ", t long"), "pieces")
    draw = F.pandas_udf(lambda p, n: pd.Series([surrogate_of(key, a, b) for a, b in zip(p, n)], dtype=object), "string")
    used = pieces.select(F.explode("parts").alias("part"))
    drawn, fixed, rounds = used.distinct().withColumn("attempt", F.lit(0)), None, []
    while True:
        if len(rounds) == 64:
            raise RuntimeError("surrogates still coincide after 64 draws")
        drawn = materialize(drawn.withColumn("core", draw("part", "attempt")), "drawn")
        space = F.substring("part", 1, 1)
        both = drawn.withColumn("fresh", F.lit(True)) if fixed is None else drawn.withColumn("fresh", F.lit(True)).unionByName(fixed.withColumn("fresh", F.lit(False)))
        owner = both.groupBy(space.alias("space"), "core").agg(F.min(F.struct("fresh", "part"))["part"].alias("part"), F.count(F.lit(1)).alias("n"))
        clash = owner.where("n > 1").select("space", "core", F.col("part").alias("holder"))
        again = materialize(drawn.withColumn("space", space).join(clash, ["space", "core"]).where("part <> holder").select("part", "attempt"), "again")
        kept = drawn.join(again.select("part"), "part", "left_anti")
        fixed = kept if fixed is None else fixed.unionByName(kept)
        rounds.append(again)
        if again.isEmpty():
            break
        drawn = again.select("part", (F.col("attempt") + 1).alias("attempt"))
    fixed = materialize(fixed.select("part", "core"), "surrogates")
    row = F.struct("start", "stop", "pii_kind", "nth", "piece")
    whole = pieces.where(F.size("parts") == 0).select("row", "t", row.alias("p"), F.lit(None).cast("string").alias("part"), F.lit(None).cast("string").alias("core"))
    split = pieces.where(F.size("parts") > 0).select("row", "t", row.alias("p"), F.explode("parts").alias("part"))
    named = join_unique(split, fixed, "part", hot_keys(split, "part")).select("row", "t", "p", "part", "core")
    per = named.unionByName(whole).groupBy("row", "t").agg(F.array_sort(F.collect_set(F.struct("p", "part", "core"))).alias("all"))

    def shown(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r, t, every in zip(frame["row"], frame["t"], frame["all"]):
                cores: dict[tuple, dict[str, str]] = {}
                for e in every:
                    cores.setdefault(tuple(e["p"][c] for c in ("start", "stop", "pii_kind", "nth", "piece")), {})[e["part"]] = e["core"]
                out += [(r, p[2], p[3], p[0], p[1], p[4], render(key, p[2], p[4], c), t) for p, c in cores.items()]
            yield pd.DataFrame(out, columns=["row", "pii_kind", "nth", "start", "stop", "piece", "surrogate", "t"])

    return per.mapInPandas(shown, "row long, pii_kind string, nth int, start int, stop int, piece string, surrogate string, t long").withColumnsRenamed({"row": id_col, "t": "__t"})


def replace_pii(signals: DataFrame, key: str | None = None, id_col: str = "delivery_no", text_col: str = "content") -> DataFrame:
    """``signals`` with ``<text_col>`` in which every piece is a placeholder ``<KIND:surrogate>``; all else is unchanged.

    Rows with null ids keep their text; extra columns stay as they are.
    """
    shown = F.concat(F.lit("<"), "pii_kind", F.lit(":"), "surrogate", F.lit(">"))
    cuts = surrogate_pieces(signals, key, id_col, text_col).groupBy(F.col(id_col).alias("__id"), "__t").agg(F.array_sort(F.collect_list(F.struct("start", "stop", shown.alias("shown")))).alias("__cuts"))
    text = F.col(text_col)
    spliced = F.aggregate(
        "__cuts", F.struct(F.lit("").alias("t"), F.lit(0).alias("at")),
        lambda acc, c: F.struct(F.concat(acc["t"], F.substring(text, acc["at"] + 1, c["start"] - acc["at"]), c["shown"]).alias("t"), c["stop"].alias("at")),
        lambda acc: F.concat(acc["t"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    joined = signals.join(cuts, (F.col(id_col).cast("long") == F.col("__id")) & (F.xxhash64(text) == F.col("__t")), "left")
    return joined.withColumn(text_col, F.coalesce(spliced, text)).drop("__cuts", "__id", "__t")
