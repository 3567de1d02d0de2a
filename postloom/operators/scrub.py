"""Scrubbing messages: people, contacts, numbers, dates, firms and places get consistent stand-ins in one pass over each text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from postloom.functions import mail, text as tx
from postloom.operators import harvest, identity, redact, surrogates
from postloom.operators.dates import MONTH, numeric_date, worded_date
from postloom.plans.lineage import cut

#: Kinds of spans in the order in which they are tried at one place; what stands around a span, and the span itself.
KINDS = (
    ("email", "", r"[A-Za-z0-9._%+'-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", ""),
    ("zip", r"(?<=\b[A-Z]{2},? )", r"[0-9]{5}(?:-[0-9]{4})?", r"(?![0-9-])"),
    ("date", r"(?<![\w/.-])", r"(?:[0-9]{1,2}/[0-9]{1,2}/(?:[0-9]{4}|[0-9]{2})|[0-9]{1,2}-[0-9]{1,2}-(?:[0-9]{4}|[0-9]{2}))", r"(?![\w/-])"),
    ("month_first", r"(?<![\w-])", rf"(?:{MONTH})\.?\s+[0-9]{{1,2}}(?:st|nd|rd|th)?(?:,?\s+[0-9]{{4}})?", r"(?![\w])"),
    ("day_first", r"(?<![\w-])", rf"[0-9]{{1,2}}(?:st|nd|rd|th)?\s+(?:{MONTH})(?:,?\s+[0-9]{{4}})?", r"(?![\w])"),
    ("url", "", r"(?:https?://|www\.)[^\s<>\"')\]]+", ""),
    ("ssn", r"(?<![\w-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?![\w-])"),
    ("phone", r"(?<![\w.,/+-])", r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,5}\)[ .-]?|[0-9]{2,5}[ .-])(?:[0-9]{2,4}[ .-]){1,2}[0-9]{2,5}(?: ?(?:x|ext\.?) ?[0-9]{1,5})?", r"(?![\w-])"),
    ("number", r"(?<![0-9.,])", r"[0-9]{7,}", r"(?![0-9]|[.,][0-9])"),
    ("office", r"(?<![\w])", r"(?:Room|Rm\.?|EB) ?[0-9]{2,4}[A-Za-z]?", r"(?![\w])"),
)
_STATIC = "|".join(f"{before}(?:{span}){after}" for _, before, span, after in KINDS)
#: Stands between subject, body and trailer while they are rewritten together; no span goes over it.
_PART = "\x01"
_EDGE, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: What an old mail system writes after a name.
_ROUTE = r"(?:(?:/\p{Alnum}{1,12})+(?:@\p{Alnum}{1,20})?|@\p{Lu}{2,12}\b(?!\.))?"
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "esq", "md", "phd")
PLACEHOLDER = r"\[(?:COMPANY|ORG_[0-9]+|LOC_[0-9]+|UNIT_[0-9]+)\]"
_PERSON = "struct<pos:int,role:string,name:string,address:string,first:string,last:string,email:string,title:string,common:boolean>"


@dataclass(frozen=True)
class Terms:
    """What has to go besides people and contacts; configuration, of at most 1,000 terms each. Units are told apart by case, the others aren't."""

    company: tuple[str, ...] = ()
    internal_domain: str = "internal.example"
    organisations: tuple[str, ...] = ()
    places: tuple[str, ...] = ()
    units: tuple[str, ...] = ()

    def __post_init__(self):
        if max(map(len, (self.company, self.organisations, self.places, self.units))) > 1000:
            raise ValueError("lists of more than 1,000 terms")


#: Takes (doc, text), gives (doc, label, entity) with the labels PERSON, ORG and LOC.
Detector = Callable[[DataFrame], DataFrame]


def keep_entities(found: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    """Entities of a detector that can be names: three characters and more, no line feed, @ or digit, some capital, no stop word."""
    e = F.btrim("entity", F.lit(" '\"()[]<>,.;:"))
    return found.withColumn("entity", e).filter((F.length(e) >= 3) & ~e.rlike(r"[\n@0-9]") & e.rlike(r"\p{Lu}") & ~F.lower(e).isin(*(stop or ("",)))).select("doc", "label", "entity")


def _quote(c: Column) -> Column:
    """A pattern for the words of a term, with up to three blanks or line feeds between them."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(" "), F.lit(r"\E\s{1,3}\Q")), F.lit(r"\E"))


def _one_of(terms: Column) -> Column:
    """An alternation of the terms, longest first; of none, null."""
    longest = F.array_sort(F.array_distinct(F.filter(terms, lambda t: F.length(t) > 1)), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return tx.once(longest, lambda ts: F.when(F.size(ts) > 0, F.concat(F.lit(_EDGE + "(?:"), F.array_join(F.transform(ts, _quote), "|"), F.lit(")" + _END))))


def _occurring(text: Column, terms: tuple[str, ...], fold: bool = True) -> Column:
    """Those of the terms that stand in the text, in their order."""
    listed = F.array(*(F.lit(t.lower() if fold else t) for t in terms)).cast("array<string>")
    return F.filter(listed, lambda t: F.contains(text, t) & F.rlike(text, F.concat(F.lit(_EDGE), _quote(t), F.lit(_END))))


def _numbered(tag: str):
    return lambda _, i: F.concat(F.lit(f"[{tag}_"), (i + 1).cast("string"), F.lit("]"))


def _nicknames() -> Column:
    """Formal names and all their short forms, as a map."""
    by_formal: dict[str, list[str]] = {}
    for short, formal in identity.NICKNAMES.items():
        by_formal.setdefault(formal, []).append(short)
    return F.create_map(*(x for formal, shorts in by_formal.items() for x in (F.lit(formal), F.array(*map(F.lit, shorts)))))


def alias_forms(p: Column) -> Column:
    """(alias, replacement, hard) for all forms in which the name of a person may stand, the first one of an alias counts.

    Full names, with middle name or initial, and "Last, First", for the given name as written and its short and formal forms; the surname of four
    letters and more if it is no common word; given names of three and more. Each as written and in capitals, all but given names in lower case too.
    """
    words = F.filter(F.split(identity.clean_name(p["name"]), " "), lambda w: ~F.lower(F.rtrim(w, F.lit("."))).isin(*SUFFIXES) & (w != ""))

    def forms(w: Column) -> Column:
        given, n = F.get(w, F.lit(0)), F.size(w)
        last = F.when(n > 1, F.element_at(w, -1))
        middle = F.when(n > 2, F.array_join(F.slice(w, 2, F.greatest(n - 2, F.lit(1))), " "))
        low = F.lower(given)
        formal = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in identity.NICKNAMES.items() for x in pair)), low), low)
        firsts = F.array_distinct(F.concat(F.array(given, F.initcap(formal)), F.transform(F.coalesce(F.element_at(_nicknames(), formal), F.array().cast("array<string>")), F.initcap)))
        full, turned = F.concat_ws(" ", p["first"], p["last"]), F.concat_ws(", ", p["last"], p["first"])
        form = lambda alias, out, hard, lower: F.struct(alias.alias("alias"), out.alias("replacement"), F.lit(hard).alias("hard"), F.lit(lower).alias("lower"))
        long = F.flatten(
            F.transform(
                firsts,
                lambda f: F.array(
                    form(F.concat(f, F.lit(" "), middle, F.lit(" "), last), full, True, True),
                    form(F.concat(f, F.lit(" "), F.left(middle, F.lit(1)), F.lit(". "), last), full, True, True),
                    form(F.concat(f, F.lit(" "), F.left(middle, F.lit(1)), F.lit(" "), last), full, True, True),
                    form(F.concat(f, F.lit(" "), last), full, True, True),
                    form(F.concat(last, F.lit(", "), f), turned, True, True),
                ),
            )
        )
        short = F.transform(firsts, lambda f: form(F.when(F.length(f) >= 3, f), p["first"], False, False))
        surname = F.array(form(F.when((F.length(last) >= 4) & ~F.coalesce(p["common"], F.lit(False)), last), p["last"], True, True))
        return F.filter(F.concat(long, surname, short), lambda x: x["alias"].isNotNull() & (F.length(x["alias"]) > 1))

    def cased(x: Column) -> Column:
        case = lambda f, on=True: F.when(F.lit(True) if on is True else on, F.struct(f(x["alias"]).alias("alias"), f(x["replacement"]).alias("replacement"), x["hard"].alias("hard")))
        return F.array_compact(F.array(case(lambda c: c), case(F.upper), case(F.lower, x["lower"])))

    return F.flatten(F.transform(tx.once(words, forms), cased))


def identities(emails: DataFrame, internal_domain: str) -> DataFrame:
    """(doc, pos, role, name, address) of the people in the headers, in the order From, To, Cc, Bcc."""
    empty = F.array().cast("array<string>")
    one = lambda name, address: F.struct(name.alias("name"), address.alias("address"))
    pairs = lambda names, addresses: F.zip_with(names, addresses, one)
    to, cc, bcc = (F.coalesce(c, empty) for c in ("to_addrs", "cc_addrs", "bcc_addrs"))
    sender = F.array(one(F.coalesce(F.nullif(identity.clean_name(F.col("x_from")), F.lit("")), identity.name_from_address(F.col("from_addr"))), F.coalesce("from_addr", F.lit(""))))
    roles = (("from", sender), ("to", pairs(harvest.paired_names(F.col("x_to"), to), to)), ("cc", pairs(F.transform(cc, identity.name_from_address), cc)), ("bcc", pairs(F.transform(bcc, identity.name_from_address), bcc)))
    with_role = lambda role: lambda p: F.struct(F.lit(role).alias("role"), p["name"].alias("name"), F.lower(p["address"]).alias("address"))
    listed = F.concat(*(F.transform(people, with_role(role)) for role, people in roles))
    return emails.select(F.col("email_id").alias("doc"), F.posexplode(listed).alias("pos", "p")).select("doc", "pos", "p.role", "p.name", "p.address")


def harvested(texts: DataFrame, given: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(doc, pos, role, name, address) of the people named in ``texts(doc, text)``."""
    pairs = harvest.address_pairs(texts).select("doc", F.lit(1000).alias("pos"), "name", "address")
    rest = None
    for k, found in enumerate((harvest.header_line_names(texts), harvest.capitalised_names(texts, given, frequencies), harvest.lowercase_names(texts, given, frequencies))):
        own = found.select("doc", F.lit(2000 + k).alias("pos"), "name", F.lit(None).cast("string").alias("address"))
        rest = own if rest is None else rest.unionByName(own)
    return pairs.unionByName(rest).select("doc", "pos", F.lit("text").alias("role"), "name", "address")


def scrub(emails: DataFrame, profiles: DataFrame, terms: Terms, detector: Detector | None = None, genders: DataFrame | None = None, given: DataFrame | None = None, body_words: int | None = None, trailer_words: int | None = None, years: tuple[int, int] = (1990, 2035), find_people: bool = True, profile_set: str | None = "current") -> DataFrame:
    """The messages with stand-ins, in the columns ``subject``, ``body`` and ``trailer``, next to what later stages need.

    People come from the headers, from the text (``find_people``; given names are those that addresses spell, those of ``given(first)`` and of ``genders``), and from a ``detector``; the same person of a profile always has the same
    stand-in. Each text is split once at everything that has to go, and every span becomes what its kind asks for: contacts and numbers get
    stand-ins of their form, dates move by whole weeks, firms, places and units become numbered placeholders, names become those of their persona.
    What is put in is never looked at again. ``body_words`` and ``trailer_words`` cut very long texts at a line, as a feature; by default nothing is cut.

    Adds: profile columns with the prefix ``to_``, ``shift_days``, ``sender``, ``to_people``, ``cc_people``, ``counts`` by kind, ``placeholders``,
    ``hard_terms`` and ``soft_terms`` (what must and what should not be left), ``keep_names`` (persona names that stand in the text).

    Null texts count as empty. Messages without people, without date or with unknown owner are scrubbed of the rest. Of rows with the same id each is done.
    """
    owner = F.coalesce(F.nullif(mail.owner(F.col("file")), F.lit("")), F.nullif(F.col("x_origin"), F.lit("")), F.col("from_addr"), F.lit(""))
    cleaned = emails.withColumn("owner", owner)
    for c, most in (("subject", None), ("body", body_words), ("trailer", trailer_words)):
        cleaned = cleaned.withColumn(f"source_{c}", F.coalesce(c, F.lit("")))
        base = F.col(f"source_{c}") if most is None else harvest.trim_words(F.col(f"source_{c}"), most)
        cleaned = cleaned.withColumn(c, F.translate(redact.clean_artifacts(base, terms.internal_domain), _PART, " "))
    assigned = identity.assign_profiles(cleaned, profiles.select("profile_id", *(F.col(c).alias(f"to_{c}") for c in ("name", "short", "domain", "industry", "locale", "country", "city", "tz", "sub_units")), "profile_set"), profile_set=profile_set).drop("profile_set")
    local = mail.wall_clock(F.col("date"))
    docs = assigned.withColumn("shift_days", F.coalesce(identity.shift_days(local, F.col("owner")), F.lit(0))).withColumn("source_year", F.coalesce(F.year(local), F.lit(int(identity.DEFAULT_DATE[:4]))))
    docs = docs.withColumn("all_text", F.concat_ws(_PART, "subject", "body", "trailer"))
    texts = docs.select(F.col("email_id").alias("doc"), F.col("all_text").alias("text"))
    people = identities(docs, terms.internal_domain)
    frequencies = None
    if find_people:
        addresses = emails.select(F.explode(F.array_union(F.array("from_addr"), F.coalesce("to_addrs", F.array().cast("array<string>")))).alias("address")).distinct()
        known = harvest.given_names(addresses).select("first")
        for more in (given, genders):
            known = known if more is None else known.unionByName(more.select(F.lower("first").alias("first")))
        known = cut(known.distinct())
        frequencies = cut(harvest.word_frequencies(texts))
        people = people.unionByName(harvested(texts, known, frequencies))
    entities = None
    if detector is not None:
        entities = cut(keep_entities(detector(texts)))
        people = people.unionByName(entities.filter("label = 'PERSON'").select("doc", F.lit(3000).alias("pos"), F.lit("text").alias("role"), F.regexp_replace("entity", "'s$", "").alias("name"), F.lit(None).cast("string").alias("address")))
    people = people.withColumn("identity", identity.canonical_name(identity.clean_name(F.col("name")))).filter("identity <> ''")
    keyed = people.join(docs.select(F.col("email_id").alias("doc"), "profile_id", F.col("to_domain").alias("domain"), F.col("to_locale").alias("locale")).distinct(), "doc")
    keyed = cut(keyed)
    made = identity.personas(keyed, genders)
    if frequencies is not None:  # a surname that is a common word is no alias of its own
        common = frequencies.filter(f"zipf >= {harvest.COMMON} and 2 * n_small > n").select(F.col("word").alias("_w"), F.lit(True).alias("common"))
        made = made.withColumn("_w", F.substring_index("identity", " ", -1)).join(common, "_w", "left").drop("_w")
    else:
        made = made.withColumn("common", F.lit(False))
    beside = keyed.join(made, ["profile_id", "identity"]).groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("pos", "role", "name", "address", "first", "last", "email", "title", "common").cast(_PERSON))).alias("people"))  # the people of one message
    joined = docs.join(beside.withColumnRenamed("doc", "email_id"), "email_id", "left").withColumn("people", F.coalesce("people", F.array().cast(f"array<{_PERSON}>")))
    if entities is not None:
        at = F.position(F.col("entity"), F.col("text"))
        placed = entities.filter("label <> 'PERSON'").distinct().join(texts, "doc").groupBy("doc", "label").agg(F.transform(F.array_sort(F.collect_set(F.struct(at.alias("at"), F.lower("entity").alias("e")))), lambda x: x["e"]).alias("e"))
        named = placed.groupBy(F.col("doc").alias("email_id")).agg(F.first(F.when(F.col("label") == "ORG", F.col("e")), True).alias("ent_orgs"), F.first(F.when(F.col("label") == "LOC", F.col("e")), True).alias("ent_places"))
        joined = joined.join(named, "email_id", "left")
    else:
        joined = joined.withColumn("ent_orgs", F.lit(None).cast("array<string>")).withColumn("ent_places", F.lit(None).cast("array<string>"))
    empty = F.array().cast("array<string>")
    low = F.lower("all_text")
    joined = joined.withColumns({"orgs": F.array_distinct(F.concat(F.coalesce("ent_orgs", empty), _occurring(low, terms.organisations))), "places": F.array_distinct(F.concat(F.coalesce("ent_places", empty), _occurring(low, terms.places))), "units": _occurring(F.col("all_text"), terms.units, fold=False), "company_terms": _occurring(low, terms.company), "forms": F.flatten(F.transform("people", alias_forms))})
    names = _one_of(F.transform("forms", lambda f: f["alias"]))
    folded = _one_of(F.concat("company_terms", "orgs", "places"))
    pattern = F.concat_ws("|", F.lit(_STATIC), F.concat(F.lit("(?i:"), folded, F.lit(")")), _one_of(F.col("units")), F.concat(names, F.lit(_ROUTE)))
    joined = joined.withColumn("pattern", pattern)

    def kind_of(s: Column) -> Column:
        out = None
        for kind, _, span, _ in KINDS:
            found = s.rlike(f"^(?:{span})$")
            out = F.when(found, kind) if out is None else out.when(found, kind)
        word = tx.collapse(F.lower(s))
        return out.when(F.array_contains("company_terms", word), "company").when(F.array_contains("orgs", word), "org").when(F.array_contains("places", word), "place").when(F.array_contains("units", s), "unit").otherwise("person")

    def replacement(x: Column) -> Column:
        kind, s = x["kind"], x["span"]
        profile, days = F.col("profile_id"), F.col("shift_days")
        word = tx.collapse(F.lower(s))
        holder = F.element_at(F.filter("people", lambda p: p["address"] == F.lower(s)), F.lit(1))
        tag = lambda label, c: F.concat(F.lit(f"[{label}_"), F.array_position(c, word if label != "UNIT" else s).cast("string"), F.lit("]"))
        name = tx.collapse(F.regexp_extract(s, r"^[^/@]+", 0))
        alias = F.get(F.filter("forms", lambda f: f["alias"] == name), F.lit(0))["replacement"]
        return (
            F.when(kind == "person", F.coalesce(alias, name))
            .when(kind == "email", F.coalesce(F.try_element_at(F.filter("people", lambda p: p["address"] == F.lower(s)), F.lit(1))["email"], surrogates.email(profile, F.col("to_domain"), F.lit(terms.internal_domain), s)))
            .when(kind == "date", numeric_date(s, days, years))
            .when(kind == "month_first", worded_date(s, days, F.col("source_year"), years, True))
            .when(kind == "day_first", worded_date(s, days, F.col("source_year"), years, False))
            .when(kind == "url", surrogates.url(profile, s))
            .when(kind == "phone", surrogates.phone(profile, F.col("to_locale"), F.regexp_replace(s, "[^0-9]", "")))
            .when(kind.isin("zip", "ssn", "number"), surrogates.number(profile, s))
            .when(kind == "office", surrogates.office(profile, s))
            .when(kind == "company", "[COMPANY]")
            .when(kind == "org", tag("ORG", F.col("orgs")))
            .when(kind == "place", tag("LOC", F.col("places")))
            .when(kind == "unit", tag("UNIT", F.col("units")))
        )

    found = joined.withColumn("spans", F.transform(F.regexp_extract_all("all_text", F.col("pattern"), F.lit(0)), lambda s: F.struct(s.alias("span"), kind_of(s).alias("kind"))))
    glued = F.array_join(F.zip_with(F.split("all_text", F.col("pattern")), F.col("spans"), lambda plain, x: F.concat(F.coalesce(plain, F.lit("")), F.coalesce(replacement(x), F.lit("")))), "")
    found = found.withColumn("parts", F.split(glued, _PART))
    every = F.col("spans")
    kinds = [k for k, *_ in KINDS] + ["company", "org", "place", "unit", "person"]
    counts = tx.once(F.transform(every, lambda x: x["kind"]), lambda ks: F.map_filter(F.create_map(*(y for k in kinds for y in (F.lit(k), F.size(F.filter(ks, tx.equals(k)))))), lambda _, n: n > 0))
    of = lambda *ks: F.transform(F.filter(every, lambda x: x["kind"].isin(*ks)), lambda x: F.lower(x["span"]))
    hosts = F.filter(F.concat(F.transform(of("email"), lambda a: F.substring_index(a, "@", -1)), F.transform(of("url"), surrogates.host_of)), lambda h: ~h.isin(*surrogates.FREE_MAIL))
    digits = F.transform(of("phone"), lambda p: F.right(F.regexp_replace(p, "[^0-9]", ""), F.lit(10)))
    named = lambda hard: F.transform(F.filter("forms", lambda f: f["hard"] == F.lit(hard)), lambda f: F.lower(f["alias"]))
    allowed = F.array_union(F.regexp_extract_all(F.lower(F.concat_ws(" ", "to_name", "to_short", "to_domain", "to_city")), F.lit("[a-z]+"), F.lit(0)), F.flatten(F.transform("people", lambda p: F.array(F.lower(p["first"]), F.lower(p["last"])))))
    left = lambda c: F.array_sort(F.filter(F.array_except(F.array_distinct(c), allowed), lambda t: F.length(t) >= 3))
    role = lambda r: F.transform(F.filter("people", lambda p: p["role"] == r), lambda p: F.struct(F.concat_ws(" ", p["first"], p["last"]).alias("full"), p["first"].alias("first"), p["email"].alias("email"), p["title"].alias("title")))
    recased = F.regexp_replace(F.col("out_subject"), r"^\s*(?i)(re|fwd?)\s*:\s*", "")
    mark = F.regexp_extract("out_subject", r"^\s*((?i)re|fwd?)\s*:", 1)
    done = found.withColumns({
        **{f"out_{c}": F.get("parts", F.lit(k)) for k, c in enumerate(("subject", "body", "trailer"))}, "counts": counts,
        "placeholders": F.array_sort(F.concat(F.when(F.size("company_terms") > 0, F.array(F.lit("[COMPANY]"))).otherwise(empty), *(F.transform(c, _numbered(tag)) for c, tag in (("orgs", "ORG"), ("places", "LOC"), ("units", "UNIT"))))),
        "hard_terms": left(F.concat(named(True), of("email"), hosts, digits, "company_terms", "orgs", "places", F.transform("units", F.lower))), "soft_terms": left(named(False)),
        "sender": F.get(role("from"), F.lit(0)), "to_people": role("to"), "cc_people": role("cc"),
    })
    done = done.withColumn("out_subject", F.when(mark != "", F.concat(F.initcap(mark), F.lit(": "), recased)).otherwise(F.col("out_subject")))
    whole = F.concat_ws("\n", "out_subject", "out_body", "out_trailer")
    keep = F.filter(F.array_distinct(F.transform("people", lambda p: F.concat_ws(" ", p["first"], p["last"]))), lambda n: F.contains(whole, n))
    return done.withColumn("keep_names", F.array_sort(keep)).select(
        "email_id", "file", "message_id", "date", "owner", "profile_id", *(f"to_{c}" for c in ("name", "short", "domain", "industry", "locale", "country", "city", "tz", "sub_units")), "shift_days",
        F.col("out_subject").alias("subject"), F.col("out_body").alias("body"), F.col("out_trailer").alias("trailer"), "source_subject", "source_body", "source_trailer",
        "counts", "placeholders", "hard_terms", "soft_terms", "keep_names", "sender", "to_people", "cc_people",
    )
