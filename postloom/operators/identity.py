"""Target profiles and consistent surrogates for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from postloom.functions.hashing import digest_mod, hash_digits, hex_mod, keyed
from postloom.functions.text import ascii_fold

SALT = "loom-1"
# Invented pools of names, titles and number forms. They define the surrogates.
FIRST = {
    "f": ("Aila", "Brenna", "Cora", "Daphne", "Elin", "Farah", "Greer", "Hedda", "Isla", "Juno", "Kaia", "Liv", "Maren", "Nell", "Orla", "Pia"),
    "m": ("Abel", "Bram", "Caspar", "Dario", "Emre", "Finn", "Gregor", "Henrik", "Idris", "Joren", "Kai", "Levin", "Mats", "Nils", "Orin", "Piet"),
    "u": ("Ariel", "Blair", "Casey", "Devon", "Eden", "Finley", "Gray", "Harper", "Indigo", "Jules", "Kit", "Lane", "Merit", "Noor", "Oakley", "Quinn"),
}
LAST = ("Alder", "Birch", "Calloway", "Draper", "Ellery", "Farrow", "Garland", "Hollis", "Ivers", "Jessop", "Keaton", "Lowell", "Marlow", "Norwood", "Oakes", "Penrose", "Quimby", "Rowan", "Sayer", "Thorne", "Underhill", "Vance", "Whitlock", "Yardley")
TITLES = ("Analyst", "Senior Analyst", "Manager", "Director", "Coordinator", "Specialist", "Associate", "Counsel", "Planner", "Controller")
PHONES = {"en_US": ("(555) 010-####", "555-010-####"), "en_GB": ("+44 1632 96####", "+44 20 7946 0###"), "de_DE": ("+49 30 2312 5###",), "fr_FR": ("+33 1 99 00 ## ##",), "en_IN": ("+91 40 5550 ####",), "pt_BR": ("+55 21 5550-####",)}
OTHER_PHONE = ("+99 ### ### ###",)
#: Short forms of given names.
NICKNAMES = {"bill": "william", "bob": "robert", "kate": "katherine", "liz": "elizabeth", "mike": "michael", "tom": "thomas", "vic": "viktor", "theo": "theodor", "flo": "flora", "gus": "gustav", "mat": "matilda", "nico": "nicolas"}
#: Days in a target span of whole weeks.
TARGET_YEAR = 2024


def clean_name(c: Column) -> Column:
    """A display name as "First Last": without address and routing suffix, "Last, First" turned, words in capitals recased. Null gives empty."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]*>", ""), r"/[A-Z][A-Za-z]*(/[A-Za-z]+)*(@[A-Za-z]+)?", "")
    s = F.regexp_replace(F.regexp_replace(s, r"^[\s\"']+|[\s\"']+$", ""), r"@.*$", "")
    turned = F.when(F.regexp_count(s, F.lit(",")) == 1, F.regexp_replace(s, r"^\s*([^,]+?)\s*,\s*([^,]+?)\s*$", "$2 $1")).otherwise(s)
    words = F.filter(F.split(F.regexp_replace(turned, r"[.\s]+", " "), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when((F.upper(w) == w) & (F.length(w) > 2), F.initcap(w)).otherwise(w)), " ")


def name_from_address(address: Column) -> Column:
    """The name an address spells ("first.last@"), else its local part."""
    local = F.substring_index(F.coalesce(address, F.lit("")), "@", 1)
    parts = F.filter(F.split(local, r"[._-]"), lambda p: p != "")
    return F.when((F.size(parts) >= 2) & F.forall(F.slice(parts, 1, 2), lambda p: p.rlike(r"^\p{L}{2,}$")), F.array_join(F.transform(parts, F.initcap), " ")).otherwise(local)


def canonical_name(name: Column) -> Column:
    """The key under which a person has one surrogate: lower case, blanks collapsed, the given name in its formal form."""
    words = F.split(F.lower(F.btrim(F.regexp_replace(name, r"\s+", " "))), " ")
    formal = F.create_map(*(F.lit(x) for pair in NICKNAMES.items() for x in pair))
    return F.array_join(F.transform(words, lambda w, i: F.when(i == 0, F.coalesce(F.element_at(formal, w), w)).otherwise(w)), " ")


def assign_profiles(owners: DataFrame, profiles: DataFrame, key: str = "owner", salt: str = SALT, profile_set: str | None = "current") -> DataFrame:
    """Each key with the profile that a keyed hash picks; the same key always has the same one.

    Profiles are numbered by id. They are a table of configuration, so the numbered rows are broadcast only while there are few of them.
    """
    chosen = profiles if profile_set is None else profiles.filter(F.col("profile_set") == profile_set)
    n = chosen.count()
    numbered = chosen.withColumn("_no", F.row_number().over(Window.orderBy("profile_id")) - 1)
    keyed_owners = owners.withColumn("_no", hex_mod(keyed(F.col(key), salt=salt), max(n, 1)).cast("int"))
    return keyed_owners.join(F.broadcast(numbered) if n <= 10_000 else numbered, "_no").drop("_no")


def personas(identities: DataFrame, genders: DataFrame | None = None, salt: str = SALT) -> DataFrame:
    """A surrogate for each distinct (profile_id, identity) of ``identities(profile_id, domain, locale, identity)``.

    Names, title and phone follow from a keyed hash alone. Surrogates of one profile with the same address are numbered by a rank over their
    identities, so they don't depend on the order in which people are met. ``genders(first, gender)`` sets the pool of given names.
    """
    people = identities.filter("identity is not null and identity <> ''").select("profile_id", "domain", "locale", "identity").distinct()
    if genders is not None:
        people = people.withColumn("first", F.substring_index("identity", " ", 1)).join(genders.select("first", "gender"), "first", "left").drop("first")
    else:
        people = people.withColumn("gender", F.lit("u"))
    gender = F.coalesce("gender", F.lit("u"))
    pool = lambda names, k: F.get(F.array(*map(F.lit, names)), digest_mod(F.col("seed"), len(names), k).cast("int"))
    seeded = people.withColumn("seed", keyed(F.col("profile_id"), F.col("identity"), salt=salt))
    first = F.when(gender == "f", pool(FIRST["f"], 0)).when(gender == "m", pool(FIRST["m"], 0)).otherwise(pool(FIRST["u"], 0))
    digits = F.sha2(F.col("seed"), 256)
    phone = F.lit(None).cast("string")
    for locale, forms in PHONES.items():
        for k, form in enumerate(forms):
            phone = F.when((F.col("locale") == locale) & (digest_mod(F.col("seed"), len(forms), 4) == k), hash_digits(F.col("digits"), form)).otherwise(phone)
    made = seeded.withColumns({"first": first, "last": pool(LAST, 1), "title": pool(TITLES, 2), "digits": digits}).withColumn("phone", F.coalesce(phone, hash_digits(F.col("digits"), OTHER_PHONE[0])))
    ranked = made.withColumn("base", F.lower(F.regexp_replace(ascii_fold(F.concat_ws(".", "first", "last")), r"[^A-Za-z0-9.]", ""))).withColumn("k", F.row_number().over(Window.partitionBy("profile_id", "base").orderBy("identity")))
    return ranked.select("profile_id", "identity", "first", "last", "title", "phone", F.concat(F.col("base"), F.when(F.col("k") > 1, F.col("k").cast("string")).otherwise(F.lit("")), F.lit("@"), F.col("domain")).alias("email"))


def shift_days(date: Column, owner: Column, salt: str = SALT, per_mailbox_year: Column | None = None) -> Column:
    """Days by which a message moves: whole weeks, from its year to the target one, half to even.

    ``per_mailbox_year`` gives one source year for a whole mailbox, so that its messages all move alike; else each message's own year counts.
    """
    year = F.year(date) if per_mailbox_year is None else per_mailbox_year
    target = F.lit(TARGET_YEAR) + hex_mod(keyed(owner, salt=salt), 2)
    return (F.bround((target - year) * 365.25 / 7) * 7).cast("int")


def shift_dates(emails: DataFrame, owner: Column, salt: str = SALT) -> DataFrame:
    """Adds ``shift_days`` and ``shifted``, the moved wall clock: same weekday and time of day. Without a readable date both are null."""
    local = F.try_to_timestamp(F.left("date", F.lit(19)))
    days = shift_days(local, owner, salt)
    return emails.withColumn("shift_days", days).withColumn("shifted", F.timestamp_add("DAY", days, local))


#: The wall clock of messages without a readable date.
DEFAULT_DATE = "2001-06-01 10:00:00"


def new_date(local: Column, days: Column, tz: Column) -> Column:
    """RFC-2822 date of the moved wall clock in the target's zone; without a readable date that of ``DEFAULT_DATE``. A null or unknown zone is UTC."""
    wall = F.coalesce(F.timestamp_add("DAY", days, local), F.lit(DEFAULT_DATE).cast("timestamp"))
    zone = F.coalesce(tz, F.lit("UTC"))
    offset = ((F.unix_timestamp(wall) - F.unix_timestamp(F.to_utc_timestamp(wall, zone))) / 60).cast("int")
    sign = F.when(offset < 0, "-").otherwise("+")
    hours = F.lpad(F.floor(F.abs(offset) / 60).cast("string"), 2, "0")
    return F.concat(F.date_format(wall, "EEE, dd MMM yyyy HH:mm:ss "), sign, hours, F.lpad((F.abs(offset) % 60).cast("string"), 2, "0"))


def gender_lexicon(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(first, gender) of given names: a CSV of that form, or the names whose gender the pools of surrogates tell."""
    if path is not None:
        return spark.read.option("header", True).schema("first string, gender string").csv(path)
    return spark.createDataFrame([(x.lower(), g) for g in ("f", "m") for x in FIRST[g]], "first string, gender string")


def message_id(source: Column, domain: Column, salt: str = SALT) -> Column:
    digest = F.md5(F.concat_ws("|", source, domain, F.lit(salt)))
    number = F.lpad((F.conv(F.substr(digest, F.lit(17), F.lit(8)), 16, 10).cast("bigint") % 100000).cast("string"), 5, "0")
    return F.concat(F.lit("<"), F.left(digest, F.lit(16)), F.lit("."), number, F.lit("@"), domain, F.lit(">"))
