import re

import pytest

from lodestream.llm import pii
from lodestream.llm.pii import find_pii, parts_of, permuted, pii_pieces, render, replace_pii, surrogate_of, surrogate_pieces

CASES = [
    ("reach Uma Gijerkor at nico72 (at) quillstone.test now", [("NAME", "Uma Gijerkor"), ("EMAIL", "nico72 (at) quillstone.test")]),
    ("glagruvor-h at quillstone dot test", [("EMAIL", "glagruvor-h at quillstone dot test")]),
    ("clone via git@code.quillstone.example:risk/a.git; npm i left-trim@6.27.11; @infra-oncall", []),
    ("call (916) 555-0168, +44 7700 900680, 0049 (0)30 23125502, 283.555.0182 ext. 243", [("PHONE", "(916) 555-0168"), ("PHONE", "+44 7700 900680"), ("PHONE", "0049 (0)30 23125502"), ("PHONE", "283.555.0182 ext. 243")]),
    ("range 115-575, ref INV-654-686-789, build 995-45-490-rc6, host 10.57.90.112:8010, H 0123456", []),
    ("SSN 977-22-9663 and NI number QQ 38 70 63 B, DNI 00240821Y, passport no. X09169079, tax id 00 432 686 178", [("ID", "977-22-9663"), ("ID", "QQ 38 70 63 B"), ("ID", "00240821Y"), ("ID", "X09169079"), ("ID", "00 432 686 178")]),
    ("to Flat 6, 137 Millrace Lane, Yaxbury QZ12 3DL; calle del Olmo 61, 2º A, Puertoseco; Am Mühlrad 217, 00215 Oststadt; 199 rue des Trois Aulnes, Saint-Oré", [("ADDRESS", "Flat 6, 137 Millrace Lane, Yaxbury QZ12 3DL"), ("ADDRESS", "calle del Olmo 61, 2º A, Puertoseco"), ("ADDRESS", "Am Mühlrad 217, 00215 Oststadt"), ("ADDRESS", "199 rue des Trois Aulnes, Saint-Oré")]),
    ("Juniper Lane suite; 93 Way merge of 53bcec7; codename Rowan Finch; Mark this as done; Will deploy; May rollout; Grace period", []),
    ("signed off by Dr. Savikak. I think Wilhelmina N. broke the cache, asking now", [("NAME", "Dr. Savikak"), ("NAME", "Wilhelmina N.")]),
    ("Prandagist, Imran said the export is stuck. H. Bradrofund approved it", [("NAME", "Prandagist, Imran"), ("NAME", "H. Bradrofund")]),
    ("April said the nightly export is flaky; April target is stuck", [("NAME", "April")]),
    ("Regards,\nHiro Stregrolak\n(405) 555-0134", [("NAME", "Hiro Stregrolak"), ("PHONE", "(405) 555-0134")]),
    ("", []),
    ("🙂 +1", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_pieces(text, want):
    assert [(k, text[a:b]) for a, b, k in find_pii(text)] == want


def test_table(spark):
    rows = [(1, "Regards,\nYara\n030/23125-973 and 030/23125-974"), (2, None), (3, ""), (None, "SSN 977-22-9663"), (4, "x" * 300_000 + " a@b.example"), (4, "x" * 300_000 + " a@b.example")]
    df = spark.createDataFrame([(*r, "c", 0) for r in rows], "delivery_no long, content string, piece string, start int")
    got = sorted((r["delivery_no"], r["pii_kind"], r["nth"]) for r in pii_pieces(df).collect())
    assert got == [(1, "NAME", 1), (1, "PHONE", 1), (1, "PHONE", 2), (4, "EMAIL", 1), (4, "EMAIL", 1)]
    assert pii_pieces(df.where("false")).count() == 0


def test_replacement_keeps_the_rest_and_the_reference(spark):
    rows = [(1, "Hiro Stregrolak called +1 823 555 0140."), (2, "ask Stregrolak, Hiro or HIRO STREGROLAK; +1 823 555 0141"), (3, None), (4, "nothing here")]
    out = {r["delivery_no"]: r["content"] for r in replace_pii(spark.createDataFrame(rows, "delivery_no long, content string"), key="k").collect()}
    names = re.findall(r"<NAME:([^>]*)>", out[1] + out[2])
    first = names[0].split()
    assert names[1] == f"{first[1]}, {first[0]}" and names[2] == names[0].upper()
    phones = re.findall(r"<PHONE:([^>]*)>", out[1] + out[2])
    assert len(set(phones)) == 2 and all(re.fullmatch(r"\+\d \d{3} \d{3} \d{4}", p) for p in phones)
    assert re.sub(r"<[A-Z]+:[^>]*>", "", out[1]) == " called ." and out[3] is None and out[4] == "nothing here"


def test_surrogates_depend_on_the_key_and_keep_the_format():
    assert surrogate_of("a", "S:gijerkor", 0) != surrogate_of("b", "S:gijerkor", 0)
    shown = render("a", "ID", "QQ 38 70 63 B", {})
    assert [c.isdigit() for c in shown] == [c.isdigit() for c in "QQ 38 70 63 B"] and shown.replace(" ", "").isupper()
    cores = {p: surrogate_of("a", p, 0) for p in parts_of("ADDRESS", "Hauptstraße 12, 10115 Berlin")}
    assert re.fullmatch(r"[A-Z][a-z]+straße \d\d, \d{5} [A-Z][a-z]+", render("a", "ADDRESS", "Hauptstraße 12, 10115 Berlin", cores))
    cores = {p: surrogate_of("a", p, 0) for p in parts_of("NAME", "Смирнов, Иван")}
    assert re.fullmatch("[А-Я][а-я]+, [А-Я][а-я]+", render("a", "NAME", "Смирнов, Иван", cores))


def test_numbers_are_permuted_without_collision():
    for n in (1, 2, 3):
        assert len({permuted("k", f"{v:0{n}d}", False) for v in range(10**n)}) == 10**n


def test_all_writings_of_a_person_agree(spark):
    rows = [(1, "Harold Smith called"), (2, "ask Hal Smith"), (3, "signed H. Smith today"), (4, "thanks Mr Smith"), (5, "ask Henry Smith"), (6, "ask Harold Smythe")]
    got = {r["delivery_no"]: r["surrogate"] for r in surrogate_pieces(spark.createDataFrame(rows, "delivery_no long, content string"), key="k").collect()}
    given, family = got[1].split()
    assert got[2] == got[1] and got[3] == f"{given[0]}. {family}" and got[4] == f"Mr {family}"
    assert got[5].split()[0] != given and got[5].split()[1] == family and got[6].split() == [given, got[6].split()[1]] and got[6].split()[1] != family


def test_many_parts_get_different_surrogates(spark):
    rows = [(k, f"Anna {a}{b}{c}ov called") for k, (a, b, c) in enumerate((a, b, c) for a in ("Bar", "Kel", "Mor", "Tas") for b in "aeiou" for c in ("zun", "rik", "lom", "dap", "fes", "gur"))]
    got = [r["surrogate"] for r in surrogate_pieces(spark.createDataFrame(rows, "delivery_no long, content string"), key="k").collect()]
    assert len(got) == len(rows) == len(set(got))


def test_names_outside_the_lists_are_found_by_model_and_context():
    """Held out: given names in no list, invented family names, sentences unlike the signals."""
    given = "Ingeborg Giuseppina Takeshi Oluwaseun Bogdana Priyanka Marcelline Thorvald Anneliese Radoslav Ekaterina Yoshiko Ferdinando Sigurd Milosz Henriette Bronislaw Evangelina Kristjan Rosalinda".split()
    family = "Haugland Ferri Yamashiro Adebanjo Petrescu Chatterjee Dubreuil Lindqvist Krollmann Zdravkov Morozova Kitagawa Bellandi Thorsen Wojtowicz Lagrange Kowalczuk Quintanar Tammsaare Olivares".split()
    frames = ["Please ask {} about the invoice.", "Yesterday {} signed the lease.", "The ticket was raised by {} today.", "We met {} at the office.", "{} reported the outage twice.", "I spoke with {} on Friday."]
    assert not any(pii._given(g) for g in given)
    found = sum(("NAME", f"{g} {f}") in [(k, t[a:b]) for a, b, k in find_pii(t)] for g, f in zip(given, family) for s in frames for t in [s.format(f"{g} {f}")])
    print(found, len(given) * len(frames))
    assert found >= 0.8 * len(given) * len(frames)


@pytest.mark.parametrize("text", ["Grace Period ends soon", "Visual Studio Code is slow", "Google Cloud Platform is down", "San Francisco meets on Friday", "Docker Compose file", "the Rowan Finch suite", "New York office", "Jenkins Pipeline failed", "Please Review this", "May Release notes", "Red Hat Enterprise Linux", "Monday Morning call"])
def test_things_are_no_names(text):
    assert [x for x in find_pii(text) if x[2] == "NAME"] == []


@pytest.mark.parametrize("text,want", [("Please ask Sarah Johnson about the invoice.", "Sarah Johnson"), ("Yesterday Maria Rossi and others signed.", "Maria Rossi"), ("raised by Peter Novak yesterday", "Peter Novak"), ("Emma Watson deployed it", "Emma Watson"), ("Anna wrote the patch", "Anna"), ("My SSN is 123456789", "123456789"), ("Contact Marlies van Houten for access", "Marlies van Houten")])
def test_common_names_and_numbers(text, want):
    assert want in [text[a:b] for a, b, _ in find_pii(text)]
