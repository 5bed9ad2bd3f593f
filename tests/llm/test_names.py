import pytest

from lodestream.llm.names import address_verdict, align, name_tokens, token_cost, variant_pairs, within_one


def dl(a, b):
    """Optimal string alignment distance by the full table."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_within_one_is_exact():
    import random

    rnd = random.Random(3)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 6))) for _ in range(120)]
    for a in words:
        for b in words:
            assert within_one(a, b) == (dl(a, b) <= 1)


@pytest.mark.parametrize("a,b,same", [("patricia", "tricia", True), ("p", "patricia", True), ("intl", "international", True), ("capi", "capital", True), ("ii", "iii", False), ("holdings", "trading", False), ("services", "svcs", True), ("quentin", "quenitin", True)])
def test_token_readings(a, b, same):
    assert (token_cost(a, b) is not None) == same


def test_alignment_is_optimal_and_needs_every_token():
    assert align(("k", "benjamin", "x"), ("benjamin", "kofi", "x"))[2] == 1
    assert align(("acme", "foods"), ("acme", "pharma")) is None
    assert align(("acme",), ("acme", "foods")) is None
    assert align(("wei", "prud"), ("wei", "omar", "prud"), spare=True)[0] == 0


def test_tokens():
    assert name_tokens("The Slejözak-Ventures (UK) B.V.") == ("slejozak", "ventures")
    assert name_tokens("Flimb0nor Management S.A.") == ("flimbonor", "management")
    assert name_tokens("Mr Vru1irund, Ann") == ("vrulirund", "ann")
    assert name_tokens("Ltd") == ("ltd",)


def test_addresses():
    assert address_verdict("144 Juniper Drive, Brackenford, QV20 3EL", "144 JUNIPER DR BRACKENFORD QV203EL") == 1
    assert address_verdict("144 Juniper Drive, Brackenford, QV20 3EL", "Brackenford QV20 3EL") == 1
    assert address_verdict("144 Juniper Drive, X, QV20 3EL", "17 Alder Way, Y, QX1 1AA") == -1
    assert address_verdict("", "17 Alder Way, Y, QX1 1AA") == 0


SCHEMA = "entity_id string, name string, entity_type string, jurisdiction string, formation_date date, address string, row string, cls int"


def pairs(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(map(tuple, variant_pairs(df).collect()))


def test_variants_and_neighbours(spark):
    import datetime

    d = datetime.date(1991, 4, 12)
    rows = [
        ("1", "Plurnavist Logistics III Ltd", "company", "VGB", d, "27 Elderberry Road, Eastvale, QY16 8BL"),
        ("2", "Logistics Plurnavist III Group LTD.", "company", "VGB", d, "Unit 14, 27 Elderberry Road, Eastvale"),
        ("3", "Plurnaivst Logs III Ltd", "unknown", None, None, "27 ELDERBERRY RD EASTVALE QY16 8BL"),
        ("4", "Plurnavist Logistics II Ltd", "company", "VGB", datetime.date(1999, 1, 1), "27 Elderberry Road, Eastvale, QY16 8BL"),
        ("5", "Plurnavist Media Ltd", "company", "VGB", d, ""),
        ("6", "Hope Brarbofor", "person", "JEY", None, "126 Cinder Road, Westrill, QX14 3AJ"),
        ("7", "Omar Brarbofor", "person", "JEY", None, "126 Cinder Road, Westrill, QX14 3AJ"),
        ("8", "Brarbofor, H.", "person", "JEY", None, "126 Cinder Rd., Westrill QX143AJ"),
        ("9", None, "person", None, None, None),
        (None, "Hope Brarbofor", "person", "JEY", None, ""),
        ("10", "", "company", None, None, None),
        ("11", "???", "company", None, None, None),
        ("12", "x " * 20_000, "company", None, None, None),
        ("1", "Plurnavist Logistics III Ltd", "company", "VGB", d, "27 Elderberry Road, Eastvale, QY16 8BL"),
    ]
    assert pairs(spark, rows) == [("1", "2"), ("1", "3"), ("2", "3"), ("6", "8")]
    assert pairs(spark, []) == []


def test_names_of_common_words_meet_without_place_or_date(spark, monkeypatch):
    from lodestream.llm import names as N

    monkeypatch.setattr(N, "COMMON_LEAST", 3)
    rows = [(f"{g}{s}{k}", f"{g} {s}", "person", j, None, "") for k, j in enumerate(("GB", "DE", "FR", "IT")) for g in ("Tobias", "Marcel", "Konrad") for s in ("Winter", "Sommer", "Herbst")]
    rows += [("a", "Tobais Winter", "person", "GB", None, ""), ("b", "T Sommer", "person", "DE", None, ""), ("c", "Winetr Marcel", "person", "FR", None, ""), ("d", "Konrad Emil Herbst", "person", "IT", None, ""), ("e", "Nikolas Winter", "person", "US", None, ""), ("f", "Nikolas Wintr", "person", "US", None, "")]
    got = set(pairs(spark, rows))
    assert {("TobiasWinter0", "a"), ("TobiasSommer1", "b"), ("MarcelWinter2", "c"), ("KonradHerbst3", "d"), ("e", "f")} <= got
    assert len(got) == 5


def test_pairs_that_pass_meet_in_the_index_however_common_their_words():
    import random

    from lodestream.llm.names import KIN, NICKNAMES, index_keys

    assert all(KIN[f] == KIN[n] for f, ns in NICKNAMES.items() for n in ns.split())
    rnd = random.Random(4)
    words = ["robert", "william", "smith", "winter", "holdings", "trading", "ann", "marceline"]
    common = frozenset(words)
    near = frozenset(v for t in common if len(t) >= 4 for v in ({t} | {t[:k] + t[k + 1 :] for k in range(len(t))}))
    for _ in range(2000):
        a = [rnd.choice(words + ["quorzel"]) for _ in range(rnd.randrange(1, 4))]
        b, k, kind = list(a), rnd.randrange(len(a)), rnd.randrange(4)
        if kind == 0 and len(b[k]) > 4:
            at = rnd.randrange(len(b[k]))
            b[k] = b[k][:at] + rnd.choice(["", "z", b[k][at] + "z"]) + b[k][at + 1 :]
        elif kind == 1 and len(a) > 1:
            b[k] = b[k][0]
        elif kind == 2:
            b = [{"robert": "bob", "william": "billy"}.get(w, w) for w in b]
        elif len(b[k]) >= 5:
            b[k] = b[k][: rnd.randrange(3, len(b[k]) - 1)]
        rnd.shuffle(b)
        if align(tuple(a), tuple(b)) is not None:
            assert index_keys(tuple(a), "", "", common, near) & index_keys(tuple(b), "", "", common, near), (a, b)
