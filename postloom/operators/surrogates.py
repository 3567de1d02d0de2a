"""Invented stand-ins for contacts, numbers, firms and places, each following from a keyed hash of the original."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postloom.functions.hashing import digest_mod, digits_like, hash_digits, keyed
from postloom.functions.text import once
from postloom.operators.identity import OTHER_PHONE, PHONES, SALT

# Invented pools. They define the surrogates.
SYLLABLES = ("ael", "bor", "cael", "dov", "enn", "fal", "gri", "hol", "ist", "jun", "kor", "lys", "mav", "nes", "olt", "pra")
DOMAIN_ENDS = ("works", "line", "field", "point", "")
ORG_ENDS = ("Partners", "Holdings", "Works", "Services", "Trading", "Supply")
CITY_ENDS = ("ford", "haven", "stead", "mere", "brook", "wick")
STREETS = ("Larch", "Quarry", "Mason", "Ferry", "Orchard", "Canal", "Beacon", "Meadow")
STREET_TYPES = ("Street", "Road", "Lane", "Avenue")
#: End parts of domains that are kept, and providers whose addresses say nothing of a firm.
KEPT_ENDS = ("com", "org", "net", "edu", "gov")
FREE_MAIL = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com")


def pick(pool: tuple[str, ...], digest: Column, part: int = 0) -> Column:
    return F.get(F.array(*map(F.lit, pool)), digest_mod(digest, len(pool), part).cast("int"))


def _seed(what: str, *parts: Column) -> Column:
    return keyed(F.lit(what), *parts, salt=SALT)


def fake_domain(profile: Column, domain: Column) -> Column:
    """Two syllables and an end, under the original's last part if that is a common one."""
    end = F.substring_index(domain, ".", -1)
    return once(_seed("domain", profile, domain), lambda h: F.concat(pick(SYLLABLES, h, 0), pick(SYLLABLES, h, 1), pick(DOMAIN_ENDS, h, 2), F.lit("."), F.when(end.isin(*KEPT_ENDS), end).otherwise("com")))


def org_name(profile: Column, key: Column) -> Column:
    return once(_seed("org", profile, key), lambda h: F.concat(F.initcap(F.concat(pick(SYLLABLES, h, 0), pick(SYLLABLES, h, 1))), F.lit(" "), pick(ORG_ENDS, h, 2)))


def city_name(profile: Column, key: Column) -> Column:
    return once(_seed("city", profile, key), lambda h: F.initcap(F.concat(pick(SYLLABLES, h, 0), pick(CITY_ENDS, h, 1))))


def street_address(profile: Column, key: Column) -> Column:
    return once(_seed("street", profile, key), lambda h: F.concat_ws(" ", (digest_mod(h, 899, 0) + 100).cast("string"), pick(STREETS, h, 1), pick(STREET_TYPES, h, 2)))


def email(profile: Column, domain: Column, internal: Column, address: Column) -> Column:
    """A stand-in for an address whose owner isn't known: of the profile's domain for internal ones, at the same free provider, else at an invented domain."""
    low = F.lower(address)
    host = F.substring_index(low, "@", -1)
    mark = once(_seed("email", profile, low), lambda h: (digest_mod(h, 9000) + 100).cast("string"))
    initial = F.coalesce(F.nullif(F.left(F.regexp_replace(F.substring_index(low, "@", 1), "[^a-z0-9]", ""), F.lit(1)), F.lit("")), F.lit("x"))
    inside = (host == internal) | F.endswith(host, F.concat(F.lit("."), internal))
    return F.concat(initial, mark, F.lit("@"), F.when(inside, domain).when(host.isin(*FREE_MAIL), host).otherwise(fake_domain(profile, host)))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(url, r"^(?i)(?:https?://)?(?:www\.)?", ""), r"[/?#].*$", ""))


def url(profile: Column, original: Column) -> Column:
    return F.concat(F.lit("https://www."), fake_domain(profile, host_of(original)), F.lit("/"))


def phone(profile: Column, locale: Column, digits: Column) -> Column:
    """A number in a form of the locale; equal digits give equal numbers."""
    def made(h: Column) -> Column:
        out = hash_digits(h, OTHER_PHONE[0])
        for name, forms in PHONES.items():
            for k, form in enumerate(forms):
                out = F.when((locale == name) & (digest_mod(h, len(forms), 7) == k), hash_digits(h, form)).otherwise(out)
        return out

    return once(_seed("phone", profile, digits), made)


def number(profile: Column, original: Column) -> Column:
    """As many digits, in the same places."""
    return once(_seed("number", profile, original), lambda h: digits_like(h, original))


def office(profile: Column, original: Column) -> Column:
    return once(_seed("office", profile, original), lambda h: F.concat(F.lit("Room "), (digest_mod(h, 29, 0) + 2).cast("string"), pick(("A", "B", "C", "D"), h, 1), (digest_mod(h, 90, 2) + 10).cast("string")))
