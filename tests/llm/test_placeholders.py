from postloom.llm.residue import exclude_residue, find_residue

SLOTS = (
    "@@SUBJECT@@", "@@first_name@@", "%%SIGNATURE%%", "##Order No##", "$$AMOUNT$$", "[[Recipient]]", "[[first_name]]", "<NAME>", "<recipient>", "<%= name %>", "{% name %}", "**FIRST_NAME**", "__first_name__", "%NAME%", "@DUE_DATE@", "*|FNAME|*", "((name))", "«First_Name»", "[first_name]", "[Name]", "[Your Name]", "|FNAME|",
)
REAL = (
    "This is **important** and ~~late~~, see ==Notes== below.", "Rob <grin> wrote to <rob@x.example>, see [see term sheet] and [attachment: a.doc].", "Ticket ##45671## stays open; margins of 5%, 10% and 12% were quoted.", "Prices in $US and $CA rose; C++ and G++ are installed.", "<p>Hello</p> <B>bold</B> text of the mail.",
    "What??Really?? Yes!!Sure!!", "On @@ -1,3 +1,4 @@ nothing changed, write to ida@x.example or mila@x.example.",
)


def test_placeholders_in_any_delimiter(spark):
    rows = [(k, f"As agreed with {s} we moved the lots.", "") for k, s in enumerate(SLOTS)] + [(100 + k, "", f"{s} will archive the report") for k, s in enumerate(SLOTS)] + [(200 + k, s, "") for k, s in enumerate(REAL)]
    df = spark.createDataFrame(rows, "syn_id long, body string, quoted string")
    found = {(r["id"], r["field"]): r["kind"] for r in find_residue(df, "syn_id", ("body", "quoted")).collect()}
    assert found == {(k, "body"): "placeholder" for k in range(len(SLOTS))} | {(100 + k, "quoted"): "placeholder" for k in range(len(SLOTS))}
    assert sorted(r["syn_id"] for r in exclude_residue(df, "syn_id", ("body", "quoted")).collect()) == [200 + k for k in range(len(REAL))]


def test_inserted_word(spark):
    df = spark.createDataFrame([(1, "This site can't currently be reached", "")] + [(k, f"Mail {k} about the plan, as agreed.", "") for k in range(2, 60)], "syn_id long, body string, quoted string")
    assert [(r["id"], r["kind"]) for r in find_residue(df, "syn_id", ("body", "quoted")).collect()] == [(1, "error page")]


UNSEEN = (
    "Sorry, the page you were looking for does not exist.", "Fatal error: Uncaught exception thrown in /var/www/mail.php on line 42", "We are currently undergoing scheduled maintenance. Please check back soon!",
    "Pellentesque habitant morbi tristique senectus et netus et malesuada fames.", "We have detected that JavaScript is disabled in this browser.", "Sed ut perspiciatis, unde omnis iste natus error sit voluptatem.",
)
TALK = (
    "The site had an error page on Monday, the desk looked at it.", "Scheduled maintenance of the tank starts in May.", "Please enable the new account for Ida.", "We found the fatal error in line 42 of the budget.", "The page with prices doesn't list the new lots.",
)


def test_other_wordings_and_mail_about_them(spark):
    rows = [(k, f"Hello,\n\n{s}\n\nRegards", "") for k, s in enumerate(UNSEEN)] + [(100 + k, s, "") for k, s in enumerate(TALK)] + [(k, f"Mail {k} about the plan and the page of the report, as agreed with the desk.", "") for k in range(200, 300)]
    found = {r["id"] for r in find_residue(spark.createDataFrame(rows, "syn_id long, body string, quoted string"), "syn_id", ("body", "quoted")).collect()}
    assert found == set(range(len(UNSEEN)))
