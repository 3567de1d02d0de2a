import random
import time

from postloom.llm.authored import _PAIRS, _whole, LABELS, Decoder, segment, train
from postloom.llm.segments import SemiMarkov

OWN = "Hi Ida,\n\nThe plan is ready and goes out today.\n\nBest,\nMila Field\nTel 555-010-1234\n\n"
OLD = "Hello Mila,\n\nthe old words number {k} are here.\n\nThey go on for a while.\n\nRegards,\nIda Field\n020 7946 0409\n\n"
HEAD = "-----Original Message-----\nFrom: Ida Field\nSent: Monday, May 4\nTo: Mila Field\nSubject: Plan\n\n"


def test_chain_of_some_hundred_messages():
    decoder = Decoder(train())
    for n in (1, 30, 60, 400):
        assert decoder.authored(OWN + "".join(HEAD + OLD.format(k=k) for k in range(n))) == [1, 3], n


def test_one_long_old_message():
    assert Decoder(train()).authored(OWN + HEAD + OLD.format(k=1) * 300) == [1, 3]


def test_long_bracketed_quote_and_answer_below():
    body = "Begin quoted text from i@x.example, Monday\n" + OLD.format(k=1) * 200 + "End quoted text\n\nNew words come here and go on."
    assert Decoder(train()).authored(body) == [body.count("\n") + 1]


def test_signature_at_any_place():
    decoder = Decoder(train())
    for n in range(388, 404):
        text = "".join(("Some words of the plan go on here.", "> a question of yours")[k % 2] + "\n" for k in range(n))
        got = decoder.authored(text + "That is all there is to say.\n\nBest,\nMila Field\nPlanner\nTel 555-010-1234\n")
        assert got[-1] == n + 1 and got[0] == 1 and len(got) == n // 2 + n % 2 + 1, n


def test_same_as_full_search():
    weights = train()
    model = SemiMarkov(LABELS, _PAIRS, _whole, weights, {"signature": 14})

    def score(symbols, segments):
        total, before = 0.0, "^"
        for y, i, j in segments:
            total += sum(weights.get(f, 0.0) for f in model._named(symbols, before, y, i, j))
            before = y
        return total

    rng, same = random.Random(1), 0
    for k in range(1500):
        symbols = "".join(rng.choice(("t", "tt", "g", "N", "n", "s", "c", "d", "v", "x", "y", "q", "qq", "i", "h", "p", "m", "k", "e", "kte")) for _ in range(rng.randint(1, 25)))
        got = segment(symbols, weights)
        assert [i for _, i, _ in got] == [0, *(j for _, _, j in got[:-1])] and got[-1][2] == len(symbols)
        full = model.decode(symbols)
        barred = any("history begins otherwise" in _whole(symbols, y, i, j) for y, i, j in full)
        more = score(symbols, full) - score(symbols, got)
        assert -1e-6 < more and (barred or more < 1e-6), symbols
        same += not barred
    assert same > 600, same


def test_time_is_in_proportion():
    began = time.process_time()
    segment("ttgsnqtx" * 5000, train())
    assert time.process_time() - began < 20
