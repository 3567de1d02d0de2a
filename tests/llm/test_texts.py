from postloom.llm.authored import Decoder, find_authored, symbols_of, train as train_authored
from postloom.llm.pii import candidates, decode, find_pii, header_names, train as train_pii
from postloom.llm.residue import exclude_residue, find_residue
from postloom.llm.segments import SemiMarkov

CASES = [
    ("Hi Ida,\n\nThe plan is ready.\n\nBest,\nMila Field\nPlanner\nTel 555-010-1234\n\nThis mail is confidential. If you got it in error, tell us.\nRecipients open attachments at their own risk.", [1, 3]),
    ("Agreed.\n\n-----Original Message-----\nFrom: Ida\nSent: Monday\n\nold text\n\nThanks,\nIda", [1]),
    ("On Mon, 1 Jan 2020 at 10:00, Ida Field <i@x.example> wrote:\n> question one\n\nMy answer is here.\n\n> question two\n\nAnd the second answer.\n\nBR\nMila", [4, 8]),
    ("Begin quoted text from i@x.example, Monday\nold\nThanks,\nIda\nEnd quoted text\n\nNew words come here.", [7]),
    ("Fine with me.\n\nIda Field\n01/02/2020 10:15 AM\nTo: Mila Field\ncc: \nSubject: Plan\n\nold words", [1]),
    ("On 16 Jul the auditor wrote: nothing new.\nThe rest follows.", [1, 2]),
    ("*** Ida Field said on 01/02/20 ***\n    old\n    words\n\nMy text stays.\n\nSent from my handheld", [5]),
    ("> only quoted\n> lines", []),
    ("   \n\n", []),
]


def test_authored_lines():
    decoder = Decoder(train_authored())
    for body, want in CASES:
        assert decoder.authored(body) == want, body
        assert decoder.authored(body.replace("\n", "\r\n")) == want, body
    long = "Text of a long message goes on.\n" * 3000 + "\nBest,\nIda"
    assert len(decoder.authored(long)) == 3000


def test_authored_table(spark):
    df = spark.createDataFrame([(1, CASES[0][0], "clash"), (2, None, ""), (3, "", ""), (None, "x", ""), (1, CASES[0][0], "")], "email_id long, raw_body string, id string")
    assert sorted((r["id"], r["line_no"]) for r in find_authored(df).collect()) == [(1, 1), (1, 1), (1, 3), (1, 3)]
    assert find_authored(df.limit(0)).count() == 0


def test_best_segmentation_is_that_of_full_search():
    import itertools

    weights = {"a:x": 1.0, "b:y": 1.5, "a:y": -0.5, "b:x": -1.0, "a>b": -0.7, "b>a": -0.2, "long b": 0.9, "^>b": -0.1}
    model = SemiMarkov("ab", {("^", "a"), ("^", "b"), ("a", "b"), ("b", "a"), ("a", "$"), ("b", "$")}, lambda s, y, i, j: ["long b"] if y == "b" and j - i > 1 else [], weights, {"b": 3})

    def score(cuts, labels, s):
        total, before = 0.0, "^"
        for (i, j), y in zip(itertools.pairwise(cuts), labels):
            if before == y or (y == "b" and j - i > 3):
                return None
            total += sum(weights.get(f, 0.0) for f in model._named(s, before, y, i, j))
            before = y
        return total

    for s in map("".join, itertools.product("xy", repeat=6)):
        every = [score((0, *c, 6), ls, s) for k in range(6) for c in itertools.combinations(range(1, 6), k) for ls in itertools.product("ab", repeat=k + 1)]
        before, got = "^", 0.0
        for y, i, j in model.decode(s):
            got += sum(weights.get(f, 0.0) for f in model._named(s, before, y, i, j))
            before = y
        assert abs(got - max(x for x in every if x is not None)) < 1e-9


PAIRS = [(g, s) for g in ("Ida", "Mila", "Otto") for s in ("Fieldmann", "Moormann", "Birkgard", "Fieldgard", "Waldström")]


def test_mentions():
    names, weights = train_pii(PAIRS)
    text = (
        "Hi Ida,\nask Otto K. Fieldmann or Ms. Moormann (otto@x.example, otto at x dot example) on 020 7946 0409 or +1 212 555 0122 ext. 7.\n"
        "Waldström, Mila lives at 12 N. Harbour St. now. SSN 123-45-6789, number QQ 11 22 33 A.\nDeal no. 123-45-6789, pump model 6050226324, contract AB-12345678.\n> ida\n> birkgard | Lead | (212) 555-0101"
    )
    got = {(c[2], text[c[0] : c[1]]) for c in decode(candidates(text, names), weights)}
    assert got == {
        ("name", "Ida"), ("name", "Otto K. Fieldmann"), ("name", "Moormann"), ("email", "otto@x.example"), ("email", "otto at x dot example"), ("phone", "020 7946 0409"), ("phone", "+1 212 555 0122 ext. 7"),
        ("name", "Waldström, Mila"), ("street_address", "12 N. Harbour St."), ("id_number", "123-45-6789"), ("id_number", "QQ 11 22 33 A"), ("name", "ida\n> birkgard"), ("phone", "(212) 555-0101"),
    }


def test_mention_tables(spark):
    emails = spark.createDataFrame([(i, f"{g} {s}", f"{s}, {g}") for i, (g, s) in enumerate(PAIRS)] + [(90, None, None), (91, "Front Desk", "")], "email_id long, x_from string, x_to string")
    pairs = header_names(emails)
    assert set(PAIRS) <= set(pairs) and header_names(emails.limit(0)) == []
    df = spark.createDataFrame([("p", 1, "body", "Ida met Ida and Otto", 3), ("p", 2, "body", None, 1), ("p", 3, "body", "", 1), ("p", None, "body", "Ida", 1), ("p", 4, "body", "no one " * 50_000, 1)], "record_type string, record_id long, field string, text string, mention int")
    assert sorted((r["record_id"], r["mention"]) for r in find_pii(df, pairs).collect()) == [(1, "Ida"), (1, "Otto")]
    text = {r["record_id"]: r["text"] for r in find_pii(df, pairs, redact=True).collect()}
    assert text[1] == "[NAME] met [NAME] and [NAME]" and text[2] is None and text[3] == ""
    assert find_pii(df.limit(0), pairs).count() == 0 and find_pii(df, []).count() == 0


def test_residue(spark):
    rows = [
        (1, "Dear {{first_name}}, thank you.", ""), (2, "Real text about a 404 page that was seen.", "Lorem ipsum dolor sit amet, consectetur."), (3, "Please enable JavaScript to view this page.", None), (4, None, None),
        (5, "See [see term sheet] and [attachment: a.doc].", "x"), (6, "Real words. " * 20_000 + "Access denied. You do not have permission to view this resource.", ""), (7, "JavaScript should be off on the kiosk by June.", ""), (None, "Lorem ipsum dolor sit amet", ""), (1, "Dear {{first_name}}, thank you.", ""),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "syn_id long, body string, quoted string, term string")
    got = {(r["id"], r["field"], r["kind"]) for r in find_residue(df, "syn_id", ("body", "quoted")).collect()}
    assert got == {(1, "body", "placeholder"), (2, "quoted", "filler"), (3, "body", "script notice"), (6, "body", "error page")}
    assert sorted(r["syn_id"] for r in exclude_residue(df.filter("syn_id is not null"), "syn_id", ("body", "quoted")).collect()) == [4, 5, 7]
    assert find_residue(df.limit(0), "syn_id", ("body",)).count() == 0


def test_symbols():
    assert symbols_of(["Hi Ida,", "", "Text one.", "", "Best,", "Ida", "> q"]) == "gtsnq"
