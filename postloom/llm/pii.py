"""Personal information in free text (problem 4)."""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: White space inside a mention: blanks, and at most one line end with the quote marks after it.
_GAP = r"(?:[^\S\n]+(?:\n[ \t>|]*)?|\n[ \t>|]*)"
_SEP = rf"(?:[.-]|{_GAP})"
_EXT = rf"(?:{_GAP}?(?:ext\.?|x|extension){_GAP}?\d{{1,6}})?"
_KINDS = ("email", "phone", "id_number", "street_address", "name")

_EMAIL = re.compile(r"[\w+-]+(?:\.[\w+-]+)*@[\w-]+(?:\.[\w-]+)+")
_SPELLED = re.compile(rf"[\w+-]+(?:\.[\w+-]+)*{_GAP}?(?:[(\[{{<]at[)\]}}>]|(?<=\s)at(?=\s)){_GAP}?[\w-]+(?:(?:{_GAP}?(?:[(\[{{<]dot[)\]}}>]|(?<=\s)dot(?=\s)){_GAP}?|\.)[\w-]+)+", re.IGNORECASE)
#: A run of groups of digits, of which any part may be a number of somebody; the groups; what a group may be.
_RUN = re.compile(rf"(?<![\w.,/-])(?:\+\d{{1,3}}|\(\+?\d{{1,5}}\)|\d+)(?:{_SEP}?\(\d{{1,5}}\)|{_SEP}\d+)*{_EXT}(?![\w-]|[.,]\d)", re.IGNORECASE)
_GROUP = re.compile(r"\+?\d+|\(\+?\d+\)")
_EXTENSION = re.compile(rf"{_GAP}?(?:ext\.?|x|extension){_GAP}?\d{{1,6}}\Z", re.IGNORECASE)
_ID = re.compile(rf"(?<![\w.,/-])(?:[A-Z]\d{{3}}-\d{{4}}-\d{{4}}|[A-Z]{{1,2}}\d{{6,8}}|[A-Z]{{2}}{_GAP}?\d{{2}}{_GAP}?\d{{2}}{_GAP}?\d{{2}}{_GAP}?[A-D])(?![\w-]|[.,]\d)", re.IGNORECASE)
#: Codes that hold digits and are nobody's: account numbers by country, dates, amounts by the thousand.
_CODE = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
#: Street types and their abbreviations; those that name other things as well.
_TYPES = r"street|road|avenue|lane|drive|court|close|way|boulevard|place|square|terrace|crescent|parkway|(?:st|rd|ave|ln|dr|ct|cl|blvd|pl|sq|ter|cres|pkwy)\b\.?"
_WEAK_TYPES = r"green|row|walk|hill|gate|mews|circle|quay|wharf|park|grove|gardens|rise"
_STREET = re.compile(rf"(?<![\w.,/-])\d{{1,5}}[a-z]?{_GAP}(?:[NSEW]\.?{_GAP}|(?:north|south|east|west){_GAP})?(?:[^\W\d_][\w'-]*{_GAP}){{1,2}}(?:(?P<strong>{_TYPES})|{_WEAK_TYPES})(?![\w-])", re.IGNORECASE)
_STREET_FIRST = re.compile(rf"(?<![\w-])(?:[^\W\d_a-z][^\W\d_]{{2,20}}(?:straße|strasse|str\.|weg|platz|allee|gasse)|(?:[^\W\d_a-z][^\W\d_]+{_GAP}){{1,2}}(?:Straße|Strasse|Str\.|Weg|Platz|Allee)){_GAP}\d{{1,4}}[a-z]?(?!\w)|(?<![\w-])\d{{1,4}}(?:{_GAP}(?:bis|ter))?,?{_GAP}(?:rue|avenue|boulevard|place|quai|via|calle|plaza){_GAP}(?:[^\W\d_][\w'’-]*{_GAP}){{0,3}}[^\W\d_a-z][\w'’-]+")
_ONE_GAP = re.compile(rf"{_GAP}\Z")
_COMMA = re.compile(rf",{_GAP}\Z")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CAPITALISED = re.compile(r"[^\W\d_a-z][^\W\d_]*[a-zß-öø-ÿ](?:['’-][^\W\d_]+)*")
#: People in header lines, and after titles, whose names need not be known.
_HEADED = re.compile(rf"(?m)^[ \t>|]*(?:From|To|Cc|Bcc|Von|An|De|À|Sent by)[ \t]*:[ \t]*\"?({_CAPITALISED.pattern}(?:,? (?:[^\W\d_a-z]\.|{_CAPITALISED.pattern})){{1,2}})(?=\"?[ \t]*(?:$|[<\[(;/]))")
_TITLED = re.compile(rf"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Sir)\b\.?{_GAP}({_CAPITALISED.pattern}(?:[^\S\n](?:[^\W\d_a-z]\.[^\S\n])?{_CAPITALISED.pattern})?)")
_LEFT = re.compile(r"[\w.()]+")
_TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau", "mme", "sir"}
#: Words before a number that make it a contact, an identity number, or neither.
_CALL = {"phone", "tel", "tel.", "telephone", "mobile", "cell", "fax", "call", "ring", "at", "on", "is", "line", "dial", "or", "number", "direct"}
_IDENTITY = {"ssn", "security", "tax", "id", "passport", "licence", "license", "insurance", "no.", "number", "social", "driving", "national", "has", "under", "the"}
_PAPERS = {"ssn", "passport", "licence", "license", "ausweis", "passeport"}
_NEITHER = {"model", "deal", "reference", "ref", "ticket", "contract", "version", "build", "invoice", "order", "permit", "clause", "item", "part", "serial", "wire"}
_WHERE = {"at", "to", "from", "address", "lives", "office", "near", "is"}


class Names:
    """Given names and surnames learned from mail headers."""

    def __init__(self, pairs: list[tuple[str, str]], least: int = 3):
        """``pairs`` of given name and surname. A given name goes with at least ``least`` surnames; so desks and lists, which stand there too, are left out."""
        with_given: dict[str, set] = defaultdict(set)
        for given, surname in pairs:
            with_given[_fold(given)].add(_fold(surname))
        self.given = {g for g, s in with_given.items() if len(s) >= least and len(g) > 1}
        self.surnames = {s for g in self.given for s in with_given[g] if len(s) > 2} - self.given
        # Surnames are often made of a stem and an ending; both recur in others.
        ends, stems = Counter(), Counter()
        for s in self.surnames:
            for k in range(3, len(s) - 2):
                stems[s[:k]] += 1
                ends[s[k:]] += 1
        self.stems = {x for x, n in stems.items() if n >= 8}
        self.ends = {x for x, n in ends.items() if n >= 8}
        self._kinds: dict[str, str] = {}

    def kind(self, word: str) -> str:
        """'G' for a given name, 'S' for a surname, 's' for what is made like one, else ''."""
        known = self._kinds.get(word)
        if known is None:
            w = _fold(word)
            known = "G" if w in self.given else "S" if w in self.surnames else "s" if any(w[:k] in self.stems and w[k:] in self.ends for k in range(3, len(w) - 2)) else ""
            if len(self._kinds) > 200_000:
                self._kinds.clear()
            self._kinds[word] = known
        return known


def _fold(word: str) -> str:
    return word.lower().replace("ö", "o").replace("ü", "u").replace("ä", "a")


#: Start of the training, to which the weights are drawn: what a feature tells before any example is seen.
_PRIOR = {
    "email": 6.0, "email:spelled": 0.0, "code": 4.0,
    "phone": 0.5, "phone:plus": 3.0, "phone:paren": 2.0, "phone:dashes": 0.0, "phone:dots": -0.5, "phone:blanks": -1.0, "phone:zero": 0.5, "phone:bare": -3.5, "phone:ext": 1.5, "phone<call": 2.0, "phone<neither": -8.0,
    "phone=334": 2.0, "phone=0:344": 2.0, "phone=0:56": 1.0, "phone=(:334": 1.0, "phone digits": 0.5, "phone few digits": -3.0, "phone many digits": -3.0, "phone over lines": -1.5, "phone part": -2.5, "phone mixed": -1.0, "phone=224": -5.0, "phone=234": -2.0, "phone=324": -4.0, "phone one group": -1.0,
    "id_number": 0.0, "id_number:324": 2.0, "id_number:blanks": -0.5, "id_number:27": 2.0, "id_number:licence": 3.0, "id_number:passport": 2.0, "id_number:insurance": 4.0, "id_number:bare": -5.0, "id_number<identity": 2.0, "id_number<papers": 4.0, "id_number<neither": -8.0, "id_number part": -4.0,
    "street_address": 5.0, "street_address:weak": -6.0, "street_address:first": 0.0, "street_address<where": 1.0, "street_address line": 2.0, "street_address cased": 1.5,
    "name:G": 3.0, "name:GS": 6.5, "name:GIS": 8.0, "name:IS": 4.5, "name:SG": 5.0, "name:SGI": 5.2, "name:S": 1.5, "name:Gs": 6.0, "name:GIs": 7.5, "name:Is": 3.0, "name:sG": 4.6, "name:s": -1.0, "name:unknown": -1.0, "name:Gx": -3.5, "name<header": 5.0, "name line": 2.5, "name<with": 2.0,
    "name<title": 3.0, "name lower alone": -1.0, "name inside word": -9.0,
    "phone>street_address nl": 1.0, "phone>phone ,": 0.5, "name>phone ,": 0.3,
}

#: A candidate: start, end, kind, features. Of kind "code" are spans that are no mention but keep others away.
Candidate = tuple[int, int, str, list[str]]


def _left_words(text: str, start: int) -> list[str]:
    return [w.lower() for w in _LEFT.findall(text[max(0, start - 40) : start])[-4:]]


def _is_code(left: list[str]) -> bool:
    """Whether the words before a number make it the number of a thing."""
    last = [w.strip("().") for w in left[-2:]]
    return last[-1:] != [] and (last[-1] in _NEITHER or (last[-1] in ("no", "nr", "number") and len(last) > 1 and last[0] in _NEITHER))


def _numbers(text: str, out: list[Candidate]) -> None:
    """Candidates among groups of digits: every part of a run of up to six groups, as a whole with its separators."""
    for m in _RUN.finditer(text):
        run, at = m[0], m.start()
        if len(run) < 7:
            continue
        extension = _EXTENSION.search(run)
        groups = [g.span() for g in _GROUP.finditer(run, 0, extension.start() if extension else len(run))]
        digits = [sum(map(str.isdigit, run[a:b])) for a, b in groups]
        if sum(digits) < 7:
            continue
        n = len(groups)
        for i in range(n):
            left = None
            for j in range(i + 1, min(n, i + 6) + 1):
                total = sum(digits[i:j])
                if total < 7 or total > 15:
                    continue
                a, b = groups[i][0], groups[j - 1][1]
                whole = i == 0 and j == n
                if left is None:
                    left = _left_words(text, at + a)
                first = run[a]
                gaps = {("n" if "\n" in g else "b" if g.isspace() else g[:1]) for g in (run[groups[k][1] : groups[k + 1][0]] for k in range(i, j - 1))} - {""}
                shape = "plus" if first == "+" or run[a : a + 2] == "(+" else "paren" if first == "(" else "bare" if j == i + 1 else "zero" if first == "0" else "dashes" if gaps == {"-"} else "dots" if gaps == {"."} else "blanks"
                sizes = "".join(map(str, digits[i:j]))
                signature = sizes if shape not in ("zero", "paren", "plus") else {"zero": "0:", "paren": "(:", "plus": "+"}[shape] + (sizes if shape != "plus" else "")
                near = [w.strip("().") for w in left[-2:]]
                features = ["phone", f"phone:{shape}", f"phone={signature}", "phone digits" if 9 <= total <= 13 else "phone few digits" if total < 9 else "phone many digits"]
                features += ["phone over lines"] * ("n" in gaps) + ["phone part"] * (not whole) + ["phone mixed"] * (len(gaps - {"n"}) > 1) + ["phone one group"] * (j == i + 1 and shape != "bare")
                features += ["phone<call"] * any(w in _CALL for w in (*near, *left[-2:])) + ["phone<neither"] * _is_code(left)
                if j == n and extension:
                    out.append((at + a, at + len(run), "phone", [*features, "phone:ext"]))
                out.append((at + a, at + b, "phone", features + ["phone part"] * bool(j == n and extension)))
                if first in "+(" or gaps - {"-", "b", "n"} or sizes not in ("324", "27") and not (j == i + 1 and 7 <= total <= 10):
                    continue
                kind = "bare" if j == i + 1 else sizes
                marks = ["id_number", f"id_number:{kind}"] + ["id_number:blanks"] * bool(gaps & {"b", "n"}) + ["id_number part"] * (not whole or bool(extension))
                out.append((at + a, at + b, "id_number", marks + ["id_number<identity"] * any(w in _IDENTITY for w in left[-2:]) + ["id_number<papers"] * (kind == "bare" and any(w in _PAPERS for w in near)) + ["id_number<neither"] * _is_code(left)))


def candidates(text: str, names: Names) -> list[Candidate]:
    """All spans that may be mentions, with whole-span features."""
    out: list[Candidate] = []
    if "@" in text:
        out += [(m.start(), m.end(), "email", ["email"]) for m in _EMAIL.finditer(text)]
    low = text.lower() if "at" in text or "AT" in text or "At" in text else ""
    if "(at)" in low or "[at]" in low or "{at}" in low or "dot" in low:
        out += [(m.start(), m.end(), "email", ["email", "email:spelled"]) for m in _SPELLED.finditer(text) if re.search(r"[(\[{<]at|\bdot\b", m[0], re.IGNORECASE)]
    _numbers(text, out)
    for m in _ID.finditer(text):
        s = m[0]
        shape = "insurance" if s[-1].isalpha() else "licence" if "-" in s else "passport"
        left = _left_words(text, m.start())
        out.append((m.start(), m.end(), "id_number", ["id_number", f"id_number:{shape}"] + ["id_number<identity"] * any(w in _IDENTITY for w in left[-2:]) + ["id_number<neither"] * _is_code(left)))
    out += [(m.start(), m.end(), "code", ["code"]) for m in _CODE.finditer(text)]
    for pattern in (_STREET, _STREET_FIRST):
        for m in pattern.finditer(text):
            left, first = _left_words(text, m.start())[-1:], pattern is _STREET_FIRST
            weak = not first and not m["strong"]
            line = text[m.start() - 1 : m.start()] in ("", "\n") and text[m.end() : m.end() + 1] in ("", "\n")
            cased = all(w[0].isupper() for w in _WORD.findall(m[0])[-2:])
            out.append((m.start(), m.end(), "street_address", ["street_address"] + ["street_address:weak"] * weak + ["street_address:first"] * first + ["street_address<where"] * (left[:1] != [] and left[0] in _WHERE) + ["street_address line"] * line + ["street_address cased"] * (weak and cased)))
    words = [(m.start(), m.end(), names.kind(m[0])) for m in _WORD.finditer(text)]
    known = [w for w in words if w[2]]
    for i, (start, end, kind) in enumerate(known):
        base: list[str] = []
        before = text[max(0, start - 8) : start]
        if before[-1:] in ("@", "_") or (before[-1:] in (".", "-") and before[-2:-1].isalnum()) or text[end : end + 1] in ("_",) or (text[end : end + 2][:1] == "-" and text[end + 1 : end + 2].isalpha()) or (text[end : end + 1] == "." and text[end + 1 : end + 2].isalpha()) or before[-1:].isdigit():
            base = ["name inside word"]
        title = ["name<title"] * bool((t := re.search(rf"([^\W\d_]+)\.?{_GAP}\Z", text[max(0, start - 14) : start])) and t[1].lower() in _TITLES)
        initial = re.search(rf"(?<![^\W\d_])([^\W\d_])\.{_GAP}\Z", text[max(0, start - 8) : start])
        if initial and initial[1].isupper() == text[start].isupper() and kind != "G":
            at = max(0, start - 8) + initial.start(1)
            out.append((at, end, "name", [f"name:I{kind}", *base]))
        lower = ["name lower alone"] * text[start].islower()
        out.append((start, end, "name", [f"name:{kind}", *lower, *title, *base]))
        if kind == "G" and text[start].isupper() and text[end : end + 1] == " " and (x := _CAPITALISED.match(text, end + 1)) and not names.kind(x[0]):
            line_start, line_end = text.rfind("\n", 0, start) + 1, text.find("\n", end)
            line = text[line_start : line_end if line_end >= 0 else len(text)].strip(" \t>|,") == text[start : x.end()]
            out.append((start, x.end(), "name", ["name:Gx", *title, *base] + ["name line"] * line + ["name<with"] * (_left_words(text, start)[-1:] in (["with"], ["colleague"], ["named"], ["attention"]))))
        if i + 1 == len(known):
            continue
        start2, end2, kind2 = known[i + 1]
        gap = text[end:start2]
        if kind == "G" and kind2 in "Ss":
            if _ONE_GAP.match(gap):
                out.append((start, end2, "name", [f"name:G{kind2}", *base]))
            elif len(gap) < 16 and re.fullmatch(rf"{_GAP}[^\W\d_]\.?{_GAP}", gap):
                out.append((start, end2, "name", [f"name:GI{kind2}", *base]))
        elif kind in "Ss" and kind2 == "G" and _COMMA.match(gap):
            more = re.match(rf"{_GAP}[^\W\d_]\.(?!\w)", text[end2 : end2 + 8])
            out.append((start, end2, "name", [f"name:{kind}G", *base]))
            if more and kind == "S":
                out.append((start, end2 + more.end(), "name", ["name:SGI", *base]))
    taken = {(c[0], c[1]) for c in out if c[2] == "name"}
    for pattern, context in ((_HEADED, "name<header"), (_TITLED, "name<title")):
        out += [(*m.span(1), "name", ["name:unknown", context]) for m in pattern.finditer(text) if m.span(1) not in taken]
    return out


#: Up to so many characters between two segments, the segments know of each other.
_NEAR = 6


def _between(a: Candidate, b: Candidate, text: str) -> str:
    """The feature of two neighbouring segments: their kinds and what stands between them."""
    gap = text[a[1] : b[0]]
    return f"{a[2]}>{b[2]} {'nl' if chr(10) in gap else gap.strip()[:3]}"


class Lattice:
    """A semi-Markov conditional random field over the segmentations of a text into candidates and plain text.

    A segmentation is a chain of candidates that don't overlap. Its score is the sum of its segments' features, and, for neighbours with up to
    ``_NEAR`` characters between them, of a feature of the pair; plain text scores 0. Chains are summed and compared by dynamic programming
    over the candidates in order of their ends: for each one, the chains that end before it are either near ones, looked at singly, or far ones,
    kept as one running value. So time is in proportion to the candidates and their near pairs.
    """

    def __init__(self, text: str, found: list[Candidate]):
        self.found = sorted(found, key=lambda c: (c[1], c[0], c[2]))
        ends = [c[1] for c in self.found]
        self.far: list[int] = []  # how many candidates end too far before it to be near
        self.near: list[list[tuple[int, str]]] = []
        for c in self.found:
            lo, hi = bisect_left(ends, c[0] - _NEAR), bisect_right(ends, c[0])
            self.far.append(lo)
            self.near.append([(j, _between(self.found[j], c, text)) for j in range(lo, hi)])

    def scores(self, weights: dict[str, float]) -> list[float]:
        return [sum(weights.get(f, 0.0) for f in c[3]) for c in self.found]

    def decode(self, weights: dict[str, float]) -> list[Candidate]:
        """The best segmentation."""
        n = len(self.found)
        own = self.scores(weights)
        best, back = [0.0] * n, [-1] * n  # of chains that end with a candidate
        top = [(0.0, -1)]  # of chains among the first k
        for k in range(n):
            value, last = top[self.far[k]]
            for j, pair in self.near[k]:
                v = best[j] + weights.get(pair, 0.0)
                if v > value:
                    value, last = v, j
            best[k], back[k] = value + own[k], last
            top.append(max(top[-1], (best[k], k), key=lambda t: t[0]))
        out, k = [], top[-1][1]
        while k >= 0:
            out.append(self.found[k])
            k = back[k]
        return out[::-1]

    def expected(self, weights: dict[str, float]) -> tuple[float, dict[str, float]]:
        """(log of the sum over all segmentations, expected number of each feature), by sums forward and backward."""
        n = len(self.found)
        own = self.scores(weights)
        add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
        forward, total = [0.0] * n, [0.0]  # chains that end with a candidate; all chains among the first k, the empty one included
        for k in range(n):
            value = total[self.far[k]]
            for j, pair in self.near[k]:
                value = add(value, forward[j] + weights.get(pair, 0.0))
            forward[k] = value + own[k]
            total.append(add(total[-1], forward[k]))
        # Backward: of what may follow a candidate, the empty chain included.
        after = [0.0] * n
        grads = [0.0] * n
        z = total[n]
        counts: dict[str, float] = defaultdict(float)
        down = [0.0] * (n + 1)  # derivative of z by total[k]
        down[n] = 1.0
        for k in range(n - 1, -1, -1):
            # total[k + 1] = log(exp total[k] + exp forward[k])
            share = math.exp(forward[k] - total[k + 1])
            grads[k] += down[k + 1] * share
            down[k] += down[k + 1] * (1 - share)
            value = forward[k] - own[k]
            down[self.far[k]] += grads[k] * math.exp(total[self.far[k]] - value)
            for j, pair in self.near[k]:
                p = grads[k] * math.exp(forward[j] + weights.get(pair, 0.0) - value)
                grads[j] += p
                counts[pair] += p
            for f in self.found[k][3]:
                counts[f] += grads[k]
        return z, counts

    def truth(self, gold: set[tuple[int, int, str]]) -> tuple[dict[str, float], int]:
        """(number of each feature in the true segmentation, how many of its segments are no candidates)."""
        free = lambda c: all(c[1] <= a or b <= c[0] for a, b, _ in gold)
        chosen = [(k, c) for k, c in enumerate(self.found) if c[:3] in gold or c[2] == "code" and free(c)]
        counts: dict[str, float] = defaultdict(float)
        once: dict[tuple, int] = {}
        for k, c in chosen:
            if c[:3] not in once:
                once[c[:3]] = k
                for f in c[3]:
                    counts[f] += 1
        kept = set(once.values())
        for k in kept:
            for j, pair in self.near[k]:
                if j in kept:
                    counts[pair] += 1
        return counts, sum(g not in once for g in gold)


def decode(found: list[Candidate], weights: dict[str, float], text: str = "") -> list[Candidate]:
    """The best segmentation's mentions."""
    return [c for c in Lattice(text, found).decode(weights) if c[2] != "code"] if found else []


_UNSEEN = (("Priyanka", "Venkat"), ("Thabo", "Nkosi"), ("Aoife", "Byrne"), ("Luca", "Ferri"), ("Mei", "Tanaka"), ("Zofia", "Nowak"))


def _compositions(pairs: list[tuple[str, str]], n: int, seed: int) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """Labelled texts: ``n`` patterns filled with names of ``pairs``, names that are in no list, and invented numbers; a bounded sample."""
    rng = random.Random(seed)
    digits = lambda form: "".join(rng.choice("0123456789") if c == "#" else rng.choice("123456789") if c == "9" else c for c in form)
    both = lambda g, s: rng.choice((f"{g} {s}", f"{g} {s}", g, g, s, f"{g[0]}. {s}", f"{g} K. {s}", f"{s}, {g}", f"{g} {s}".lower(), f"{g} {s}".upper()))
    fill = {
        "phone": lambda: digits(rng.choice(("(###) ###-####", "###-###-####", "###.###.####", "### ### ####", "+1 ### ### ####", "+44 #### ######", "+44 ## #### ####", "+49 ## ######", "0## #### ####", "0#### ######"))) + rng.choice(("", "", "", " ext. 12", " x9")),
        "id_number": lambda: digits(rng.choice(("###-##-####", "### ## ####", "##-#######", "K########", "W###-####-####", "QQ ## ## ## A"))),
        "bare": lambda: digits("9########"),
        "street_address": lambda: digits(rng.choice(("9##", "9###", "9"))) + rng.choice((" ", " ", " N. ")) + rng.choice(("Linden", "Harbour", "Mill", "Old Mill")) + rng.choice((" Street", " Rd.", " Lane", " Ave.", " Way", " Blvd")),
        "email": lambda: rng.choice(("ann.field@firm.example", "ann.field at firm dot example", "field.ann (at) firm.example")),
        "name": lambda: both(*rng.choice(pairs)),
        "new": lambda: " ".join(rng.choice(_UNSEEN)),
        "firm": lambda: rng.choice(("Alder Works", "Copper Gantry", "Linden Group", "Violet Viaduct")),
        "code": lambda: digits(rng.choice(("####-###", "9#########", "##.###.####", "###-##-####", "#.##.###", "##.##.20##", "GB## ABCD #### #### ####", "#,###,###"))),
        "short": lambda: digits(rng.choice(("9###", "9##", "9####"))),
    }
    patterns = (
        "Payroll has number {id_number} on file.", "Security needs the SSN {id_number} of {name}.", "The new joiner is {name}, passport {id_number}, phone {phone}.", "Call me at {phone} or write to {email} today.",
        "My line is {phone}, at home it is {phone}.", "The courier goes to {street_address}, attention {name}.", "Pump model {code} needs seals.", "Deal no. {code} replaces deal no. {code} now.", "Wire reference {code} covers the sum.",
        "Version {code} went live.", "I spoke with {name} and {name} about it.", "Hi {name},", "Regards,\n{name}\nTel {phone}", "You can reach {name} on {phone} after lunch.", "{name} has moved to {street_address} in May.", "From: {name}\nTo: {name}", "Build {code} broke it.",
        "Best,\n{name}\nTel {phone}\n{street_address}", "> {name}\n> Tel {phone}\n> {street_address}", "Thanks,\n{name}\n{phone}\n{street_address}\n", "Tel {phone}\n{short} cases went out.", "From: {new}\nSubject: plan", "Ask Dr. {new} about it.", "To: {new}; {name}", "The passport {bare} is lost.",
        "{firm} sold {short} cases on {code}.", "Line {short}\n{short} and {code} are open.", "We took {short} {short} times, {phone} is my number.", "The file of {firm} has {short} lines.",
    )
    kind_of = {"bare": "id_number", "new": "name"}
    out = []
    for _ in range(n):
        text, gold = "", set()
        for part in re.split(r"(\{\w+\})", rng.choice(patterns)):
            kind = part[1:-1] if part.startswith("{") else ""
            value = fill[kind]() if kind else part
            kind = kind_of.get(kind, kind)
            if kind in _KINDS:
                gold.add((len(text), len(text) + len(value), kind))
            text += value
        out.append((text, gold))
    return out


def train(pairs: list[tuple[str, str]], n: int = 900, seed: int = 5, rounds: int = 8, rate: float = 0.15, pull: float = 0.002) -> tuple[Names, dict[str, float]]:
    """The names of ``pairs`` and weights that maximise the conditional likelihood of ``n`` labelled compositions, drawn to the prior ones (Gaussian), by stochastic gradient steps."""
    names = Names(pairs)
    weights: dict[str, float] = defaultdict(float, _PRIOR)
    usable = [(g, s) for g, s in pairs if names.kind(g) == "G" and names.kind(s) == "S"]
    if not usable:
        return names, dict(weights)
    examples = []
    for text, gold in _compositions(sorted(set(usable)), n, seed):
        lattice = Lattice(text, candidates(text, names))
        counts, missing = lattice.truth(gold)
        if not missing:
            examples.append((lattice, counts))
    rng = random.Random(seed)
    for k in range(rounds):
        rng.shuffle(examples)
        step = rate / (1 + k)
        for lattice, counts in examples:
            _, expected = lattice.expected(weights)
            for f in expected.keys() | counts.keys():
                weights[f] += step * (counts.get(f, 0.0) - expected.get(f, 0.0) - pull * (weights[f] - _PRIOR.get(f, 0.0)))
    return names, dict(weights)


def header_names(emails: DataFrame, most: int = 200_000, least: int = 3) -> list[tuple[str, str]]:
    """Distinct (given name, surname) pairs in the sender and recipient names of all rows.

    Above ``most`` pairs, those that ``Names`` learns the same words from: ``least`` surnames of each given name that goes with so many, and one
    pair for each of their surnames. So what comes to the driver is bounded by the number of different names, not of people or rows.
    """
    listed = F.regexp_extract_all(F.coalesce("x_to", F.lit("")), F.lit(r"(\p{L}[\p{L}'-]*, \p{L}[\p{L}'-]*)"), F.lit(1))
    parts = F.transform(listed, lambda p: F.struct(F.get(F.split(p, ", "), F.lit(1)).alias("given"), F.get(F.split(p, ", "), F.lit(0)).alias("surname")))
    sender = F.split(F.trim(F.coalesce("x_from", F.lit(""))), r"(?U)\s+")
    pairs = F.concat(parts, F.when(F.size(sender) == 2, F.array(F.struct(F.get(sender, F.lit(0)).alias("given"), F.get(sender, F.lit(1)).alias("surname")))).otherwise(F.array().cast("array<struct<given:string,surname:string>>")))
    found = emails.select(F.explode(pairs).alias("p")).select("p.given", "p.surname").distinct()
    rows = found.limit(most + 1).collect()
    if len(rows) > most:
        fold = lambda c: F.translate(F.lower(c), "öüä", "oua")
        folded = found.groupBy(fold("given").alias("g"), fold("surname").alias("s")).agg(F.min(F.struct("given", "surname")).alias("p"))
        ranked = folded.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("s")))
        names = ranked.filter(F.col("n") == least).select("g")
        kept = ranked.join(names, "g", "left_semi")
        rows = kept.filter(F.col("n") <= least).select("p.*").union(kept.groupBy("s").agg(F.min("p").alias("p")).select("p.*")).distinct().collect()
    return sorted((r["given"], r["surname"]) for r in rows)


def _redact(text: str, mentions: list[Candidate]) -> str:
    out, at = [], 0
    for start, end, kind, _ in mentions:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def find_pii(records: DataFrame, pairs: list[tuple[str, str]], redact: bool = False) -> DataFrame:
    """Mentions of people and how to reach or identify them in ``records(record_type, record_id, field, text)``.

    Gives (record_type, record_id, field, pii_type, mention), one row for each distinct mention of a field as written; with ``redact``
    (record_type, record_id, field, text) with typed placeholders instead, one row for each row.

    A semi-Markov conditional random field (see ``Lattice``) scores candidate segments by their shape as a whole, the words before them and
    their neighbours; dynamic programming picks the best segmentation, with boundaries and types together. ``pairs`` of given names and
    surnames, see ``header_names``, give names; surnames are also known by their parts, and names in headers, after titles and given names need not be known.

    Null and empty texts have no mentions and stay as they are. Repeated rows are done one by one.
    """
    model = train(pairs)
    model[0]._kinds.clear()
    schema = "record_type string, record_id long, field string, " + ("text string" if redact else "pii_type string, mention string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = model
        for batch in batches:
            kinds, ids, fields, texts = (batch.column(k).to_pylist() for k in range(4))
            rows: list[tuple] = []
            for rt, i, f, t in zip(kinds, ids, fields, texts):
                mentions = decode(candidates(t, names), weights, t) if t else []
                if redact:
                    rows.append((rt, i, f, _redact(t, mentions) if t else t))
                else:
                    rows += [(rt, i, f, *x) for x in dict.fromkeys((m[2], t[m[0] : m[1]]) for m in mentions)]
            columns = list(zip(*rows)) or [[]] * (4 if redact else 5)
            types = [pa.string(), pa.int64(), *[pa.string()] * (len(columns) - 2)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["record_type", "record_id", "field", *(["text"] if redact else ["pii_type", "mention"])])

    rows = records.select("record_type", F.col("record_id").cast("long"), "field", "text").filter("record_id is not null")
    return rows.mapInArrow(run, schema) if redact else rows.filter("text is not null and text <> ''").mapInArrow(run, schema)
