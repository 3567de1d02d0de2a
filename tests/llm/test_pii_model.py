"""The random field against enumeration, held-out accuracy, and forms that no list holds."""

import math
import random
from itertools import combinations

import pytest
from postloom.llm import pii

PAIRS = [(g, f"{a}{b}") for g in ("Ida", "Otto", "Mila", "Karin") for a in ("Field", "Moor", "Birk", "Wald") for b in ("mann", "gard", "berg", "ström")]


@pytest.fixture(scope="module")
def model():
    return pii.train(PAIRS)


def found(model, text):
    return [(m[2], text[m[0] : m[1]]) for m in pii.decode(pii.candidates(text, model[0]), model[1], text)]


def test_sums_and_best_equal_enumeration():
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice("ab \n,") for _ in range(24))
        cands = []
        for _ in range(rng.randint(1, 7)):
            a = rng.randint(0, 20)
            cands.append((a, a + rng.randint(1, 4), rng.choice(("name", "phone", "code")), [f"f{rng.randint(0, 3)}"]))
        weights = {f"f{k}": rng.uniform(-2, 2) for k in range(4)}
        lattice = pii.Lattice(text, cands)
        weights |= {pair: rng.uniform(-1, 1) for near in lattice.near for _, pair in near}
        chains = [()] + [c for n in range(1, len(cands) + 1) for c in combinations(range(len(cands)), n) if all(lattice.found[x][1] <= lattice.found[y][0] for x, y in zip(c, c[1:]))]

        def score(c):
            total = sum(weights[f] for k in c for f in lattice.found[k][3])
            return total + sum(weights[pii._between(lattice.found[x], lattice.found[y], text)] for x, y in zip(c, c[1:]) if lattice.found[y][0] - lattice.found[x][1] <= pii._NEAR)

        z, counts = lattice.expected(weights)
        whole = sum(math.exp(score(c)) for c in chains)
        assert abs(z - math.log(whole)) < 1e-9
        for f in ("f0", "f1", "f2", "f3"):
            assert abs(counts.get(f, 0) - sum(math.exp(score(c)) / whole * sum(g == f for k in c for g in lattice.found[k][3]) for c in chains)) < 1e-9
        best = lattice.decode(weights)
        got = tuple(lattice.found.index(c) for c in best) if len({id(c) for c in lattice.found}) == len({tuple(map(str, c)) for c in lattice.found}) else None
        if got is not None:
            assert abs(score(got) - max(map(score, chains))) < 1e-9


def test_held_out_accuracy(model):
    hit = wrong = missed = 0
    for text, gold in pii._compositions(PAIRS, 1500, 991):
        got = {c[:3] for c in pii.decode(pii.candidates(text, model[0]), model[1], text)}
        hit, wrong, missed = hit + len(got & gold), wrong + len(got - gold), missed + len(gold - got)
    assert hit / (hit + missed) > 0.99 and hit / (hit + wrong) > 0.97, (hit, wrong, missed)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Tel +44 1632 960354\n1539 Copse St.\n", [("phone", "+44 1632 960354"), ("street_address", "1539 Copse St.")]),
        ("> Tel +1 907 555\n> 0111 ext. 12", [("phone", "+1 907 555\n> 0111 ext. 12")]),
        ("From: Nguyen Van Anh\nTo: Venkataraman, Priyanka <p@x.example>", [("name", "Nguyen Van Anh"), ("name", "Venkataraman, Priyanka"), ("email", "p@x.example")]),
        ("Dr. Thabo Nkosi was there.", [("name", "Thabo Nkosi")]),
        ("call 07700 900123 or 0049 30 901820", [("phone", "07700 900123"), ("phone", "0049 30 901820")]),
        ("passport 523456789 is lost", [("id_number", "523456789")]),
        ("at 221B Baker Street, not Hauptstraße 12 or 12 rue de la Paix", [("street_address", "221B Baker Street"), ("street_address", "Hauptstraße 12"), ("street_address", "12 rue de la Paix")]),
        ("lives at 5 Old Mill Green", [("street_address", "5 Old Mill Green")]),
        ("IBAN GB29 NWBK 6016 1331 9268 19, on 12.07.2019 we paid 1,234,567 for deal no. 43.384.6304", []),
        ("Senior Counsel, Copper Gantry\nPlease think of the 12 row 5 gate", []),
        ("", []),
    ],
)
def test_forms_outside_the_lists(model, text, want):
    assert found(model, text) == want


def test_without_names_and_very_long():
    names, weights = pii.train([])
    text = "Ida Field, write to a@b.example. " * 20_000
    got = pii.decode(pii.candidates(text, names), weights, text)
    assert len(got) == 20_000 and {c[2] for c in got} == {"email"}
