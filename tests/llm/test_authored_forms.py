"""Histories of any length, and notices, devices and headings that are in no list of examples."""

import pytest
from postloom.llm.authored import Decoder, _compositions, train

NEW = "Hi Ida,\n\nThe plan is ready and goes out today.\n\nBest,\nMila\n\n"
HEAD = "-----Original Message-----\nFrom: a\nSent: b\nTo: c\nSubject: d\n\n"


@pytest.fixture(scope="module")
def decoder():
    return Decoder(train())


@pytest.mark.parametrize("n", [1, 5, 30, 300, 2500])
def test_history_mixed_with_marked_lines(decoder, n):
    assert decoder.authored(NEW + HEAD + "an old answer is here.\n> older question\n" * n) == [1, 3]
    assert decoder.authored(NEW + HEAD + "an old answer is here.\nand more of it.\n> older\n> question\n" * n) == [1, 3]


@pytest.mark.parametrize("n", [1, 4, 5, 40, 400])
def test_answers_between_quoted_runs_of_any_length(decoder, n):
    quoted = "> a question of yours\n" * n
    got = decoder.authored("Ida Field writes:\n" + quoted + "\nMy answer stands here, whole and new.\n\n" + quoted)
    assert got == [n + 3]


@pytest.mark.parametrize(
    "tail",
    [
        "This message is legally privileged and intended solely for the person named above.\nCopying or disclosing it is strictly prohibited.\n",
        "Diese Nachricht ist vertraulich und nur für den Empfänger bestimmt.\nBei irrtümlichem Erhalt bitte löschen. Unbefugte Weitergabe ist untersagt.\n",
        "Sent using the Outlook client for tablets\n",
        "Envoyé de mon téléphone\n",
        "Il giorno 3 marzo 2020 Ida ha scritto:\n> vecchio testo\n> ancora\n",
        "On Friday, 29 January 2016 at 18:28, Ida Field\n<ida@x.example>\nwrote:\n> old\n",
    ],
)
def test_other_wordings(decoder, tail):
    assert decoder.authored(NEW + tail) == [1, 3]


def test_held_out_compositions(decoder):
    hit = wrong = missed = 0
    for symbols, segments in _compositions(800, 77):
        truth = "".join(label[0] * (j - i) for label, i, j in segments)
        got = decoder.labels(symbols)
        hit += sum(a == b == "a" for a, b in zip(got, truth))
        wrong += sum(a == "a" != b for a, b in zip(got, truth))
        missed += sum(b == "a" != a for a, b in zip(got, truth))
    assert hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.97, (hit, wrong, missed)
