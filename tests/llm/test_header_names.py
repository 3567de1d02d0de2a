from postloom.llm.pii import Names, candidates, decode, header_names, train


def test_names_of_all_rows(spark):
    """A name in one row of many is known, also a surname unlike any other."""
    emails = spark.range(0, 60_000).selectExpr("id as email_id", "element_at(array('Ida Fieldmann', 'Ida Moormann', 'Ida Birkgard', 'Ida Waldt'), int(id % 4 + 1)) as x_from", "cast(null as string) as x_to")
    rare = spark.createDataFrame([(100_000 + k, None, f"Qu{chr(97 + k)}zyx, Ida") for k in range(20)], "email_id long, x_from string, x_to string")
    pairs = header_names(emails.unionByName(rare))
    assert len(pairs) == 24 and {("Ida", f"Qu{chr(97 + k)}zyx") for k in range(20)} <= set(pairs)
    names, weights = train(pairs)
    text = "ask Quczyx about it"
    assert [text[a:b] for a, b, _, _ in decode(candidates(text, names), weights)] == ["Quczyx"]


def test_many_pairs_give_the_same_names(spark):
    rows = [(k, f"G{chr(97 + k % 7)}x {chr(65 + k % 13)}{chr(97 + k % 11)}s{chr(97 + k % 5)}", "Desk, Front; ÖRN, GAX") for k in range(700)] + [(800, "Solo Onlyone", ""), (801, "Solo Other", None)]
    df = spark.createDataFrame(rows, "email_id long, x_from string, x_to string")
    every, fewer = header_names(df), header_names(df, most=50)
    a, b = Names(every), Names(fewer)
    assert len(fewer) < len(every) and (a.given, a.surnames, a.stems, a.ends) == (b.given, b.surnames, b.stems, b.ends)
