"""The text newly written by an e-mail's sender (problem 1)."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postloom.llm.segments import Segment, SemiMarkov

# Boundary cues, fixed values. Case is ignored.
_CLOSING = r"(?:(?:kind|best|warm|many)\s+)?(?:regards|thanks|wishes|thank you)|best|cheers|thx|tnx|br|rgds|sincerely|yours(?:\s+\w+)?|take care|mit freundlichen grüßen|viele grüße|gruß|cordialement|saludos|mvh"
_CUES = (
    ("q", r"[>|]"),
    ("k", r"begin quoted text\b|-{2,}\s*begin (?:quoted|forwarded)\b"),
    ("e", r"end quoted text\s*$|-{2,}\s*end (?:quoted|forwarded)\b"),
    ("H", r"-{2,}\s*original (?:message|appointment)\s*-{2,}|-{4,}[^\n]*\bforwarded (?:by|message)\b|-{4,}\s*weitergeleitet|_{16,}\s*$|_{16,}\s+from:"),
    ("h", r"(?:on|am|le|el|il|em|op|den|dnia)\s[^\n]{6,160}\s(?:wrote|schrieb\b[^\n]*|a écrit|escribió|ha scritto|escreveu|schreef\b[^\n]*|skrev\b[^\n]*|napisał(?:\(a\))?)\s*:(?:\s*$|\s*[>|])|[^\n,.]{2,60}\swrites:(?:\s*$|\s*[>|])|\*{3}[^\n]{3,80}\ssaid on\s[^\n]{4,40}\*{3}"),
    ("p", r"(?:on|am)\s(?:\w{2,3},\s)?\d{1,2}[. ]\s?\w{2,9}[. ]\s?\d{4}\s(?:at|um)\s\d{1,2}:\d\d"),
    ("f", r"(?:from|sent|to|cc|bcc|subject|date|von|gesendet|an|betreff|de|envoyé|à|objet|para|enviado|asunto|da|inviato|oggetto|aan|onderwerp|verzonden):(?:\s|$)"),
    ("m", r"\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d\d\s*[ap]m\b|[^\n]{3,70}\s\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d\d\s*[ap]m\s+to:"),
    ("v", r"sent (?:from|via) (?:my|the)?\s*[\w -]{3,40}(?:,[^\n]{0,40})?\s*$|sent (?:using|with|by|on) (?:the |my |an? )?[\w .-]{3,50}\s*$|get the \w+ app\s*$|-{1,2} ?typed on [\w ]{3,30}-{0,2}\s*$|von (?:meinem|unterwegs|meiner)\b[\w ]{0,30}gesendet\s*$|(?:gesendet|envoyé|enviado|inviato|verzonden|skickat) (?:mit|von|de|depuis|desde|con|da|dal|met|vanaf|från)\b[\w .'’-]{2,50}\s*$"),
    ("s", rf"(?:{_CLOSING})\s*[,!.]?\s*(?:$|--|[*_]{{4,}})|(?:{_CLOSING})\s*,?(?:\s+[^\W\d_][\w.'-]*){{1,4}}(?<![.?!])\s*$"),
    ("d", r"--\s*$|--\s+[^\W\d_]|[*=~]{5,}\s*(?:$|[^\W\d_])|_{4,15}\s*$"),
    ("g", r"(?:hi|hello|dear|hey|good (?:morning|afternoon|evening|day)|hallo|bonjour|hola)\b[^\n.?]{0,40}$|(?:all|team|everyone|folks|colleagues)\s*[,!-]?\s*$|[^\W\d_][\w'-]*(?:,|\s-)\s*$"),
    ("c", r"(?:tel|phone|mobile|cell|fax|office|direct)\b[.:]?\s*\+?[(\d][\d ().+-]{6,}|\+?[(\d][\d ().+-]{6,}(?:\s*ext\.?\s*\d+)?\s*(?:\(\w+\))?\s*$|[^\W\d_][\w .,'-]{2,60}\s\+?[(\d][\d ().+-]{8,}(?:\(\w+\))?\s*$|[\w.+-]+@[\w.-]+\s*$|[^\n|]{2,40}(?:\s\|\s[^\n|]{2,40}){1,3}\s*$|\d{1,5}\s+(?:[nsew]\.\s+)?[^\W\d_]+\s+(?:street|st\.?|road|rd\.?|avenue|ave\.?|lane|ln\.?|drive|dr\.?|court|ct\.?|close|way|boulevard|blvd\.?|place|square)\s*$"),
    ("n", r"[^\W\d_][\w.'@-]*(?:,?\s+[^\W\d_][\w.'@-]*){0,5}(?<![.?!:;]),?\s*$"),
)
_CUE = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in _CUES), re.IGNORECASE)
_INDENTED = re.compile(r"(?:\s{4}|\t)\s*\S")
#: Words of legal notices.
_LEGAL = re.compile(
    r"\b(confidential\w*|privilege[ds]?|addressee|recipients?\b(?= (?:only|open)|\.)|named recipients|disclaim\w*|(?:this|the content of this|any) (?:e-?mail|mail|message|transmission|communication)|views|warrant\w*|viruses|in error|by mistake|written consent|unauthori[sz]ed|liab\w+|accepts no|monitored|supervisory bodies|before you print|woodland|offer or an acceptance|bind neither|registered office|investments|leave the list|unsubscribe|you receive this|what was received|not permitted|restricted to|business partner|subject line|does not amount|prices are|any such decision|those of its author|stored, screened|legally|strictly prohibited|intended (?:solely|only|recipient\w*)|disclos\w+|copying|distribut\w+ (?:of|is|or)|vertraulich\w*|empfänger\w*|irrtümlich|unbefugt\w*|rechtlich geschützt\w*|confidentiel\w*|destinataires?|confidencial\w*|destinatario\w*|riservat\w+|vertrouwelijk\w*)\b",
    re.IGNORECASE,
)
_BLANK = re.compile(r"\s*$")

LABELS = ("authored", "signature", "notice", "marked", "bracketed", "history")
_NEXT = {
    "^": ("authored", "signature", "notice", "marked", "bracketed", "history"),
    "authored": ("signature", "notice", "marked", "bracketed", "history", "$"),
    "signature": ("notice", "marked", "bracketed", "history", "authored", "$"),
    "notice": ("signature", "marked", "bracketed", "history", "$"),
    "marked": ("authored", "signature", "notice", "history", "bracketed", "$"),
    "bracketed": ("authored", "signature", "notice", "history", "marked", "$"),
    "history": ("$",),
}
_PAIRS = {(a, b) for a, bs in _NEXT.items() for b in bs}

#: Start of the training: what each cue tells before any example is seen.
_PRIOR = {
    **{f"authored:{c}": v for c, v in zip("tgGnNsScCdDvVxXyYqiIhHpfFmMkel", (2, 2, 2, 0.2, -0.6, -2, -2, -1.5, -1.5, -2, -2, -4, -4, -4, -4, 0.3, 0.3, -9, -1, -1, -4, -8, 0.5, -1, -1, -2, -2, -9, -6, 1))},
    **{f"signature:{c}": v for c, v in zip("tgGnNsScCdDvVxXyYqiIhHpfFmMkel", (-4, -3, -3, 1.5, 1.5, 3, 3, 3, 3, 3, 3, 4, 4, -3, -3, -3, -3, -9, -2, -2, -6, -9, -4, -3, -3, -4, -4, -9, -6, -4))},
    **{f"notice:{c}": v for c, v in zip("tgGnNsScCdDvVxXyYqiIhHpfFmMkel", (-0.6, -3, -3, -1, -2, -3, -3, -2, -2, -2, -2, -2, -2, 4, 4, 0.8, 0.8, -9, -2, -2, -6, -9, -4, -3, -3, -4, -4, -9, -6, -3))},
    **{f"marked:{c}": v for c, v in zip("tgGnNsScCdDvVxXyYqiIhHpfFmMkel", (-5, -5, -5, -4, -4, -4, -4, -4, -4, -3, -3, -5, -5, -5, -5, -5, -5, 5, 1.2, 1.2, 6, -6, 4, -2, -2, -3, -3, -9, -6, -5))},
    **{f"bracketed:{c}": 0.0 for c in "tgGnNsScCdDvVxXyYqiIhHpfFmMl"},
    **{f"history:{c}": 0.0 for c in "tgGnNsScCdDvVxXyYiIhHpfFmMl"},
    "history:q": 1.0, "history:k": 20.0, "history:e": 20.0,
    "!bracket": -1000.0, "bracketed:k": 20.0, "bracketed:e": 20.0, "bracketed closed": 20.0, "bracketed open": -4.0,
    "history begins H": 14.0, "history begins header": 12.0, "history begins dated": 12.0, "history begins otherwise": -30.0, "history begins inside": -30.0,
    "signature>authored": -7.0, "signature begins t": -6.0, "signature lines 10+": -4.0, "signature begins closing": 1.0, "signature begins n inside": -2.5,
    "marked begins heading": 1.5, "marked begins indented": -6.0, "marked indented under heading": 3.0, "notice begins y": -1.0, "authored begins n": -0.5, "^>signature": -2.0, "^>notice": -1.0,
}


def _signature_length(n: int) -> str:
    """The class of a signature's number of lines."""
    return f"signature lines {n if n < 5 else '5-6' if n < 7 else '7-9' if n < 10 else '10+'}"


def _whole(symbols: str, label: str, i: int, j: int) -> list[str]:
    """Whole-span features."""
    first = symbols[i]
    if label in ("authored", "signature", "notice", "marked") and "k" in symbols[i:j]:
        return ["!bracket"]
    if label == "history":
        inside = symbols[i:j]
        if first == "H":
            return ["history begins H"]
        if first in "fF" and (len(inside) > 1 and inside[1] in "fl" or inside[0] == "F"):
            return ["history begins header"]
        if first in "mM" or first in "nNcC" and len(inside) > 1 and inside[1] in "mM":
            return ["history begins dated"]
        return ["history begins otherwise"]
    if label == "bracketed":
        open_ = closed = 0
        for c in symbols[i:j]:
            closed += not open_ and c != "k"
            open_ += (c == "k") - (c == "e")
        closed = not open_ and not closed  # brackets may be nested
        return ["bracketed closed"] if closed else ["bracketed open"] if first == "k" and j == len(symbols) and open_ > 0 else ["history begins otherwise"]
    if label == "signature":
        return [f"signature begins {'closing' if first in 'sS' else 't' if first == 't' else first.lower() + (' inside' if first == 'n' else '')}", _signature_length(j - i)]
    single = ["notice one line"] * (label == "notice" and j - i == 1)
    if label == "marked":
        if first in "hp":
            return ["marked begins heading", *(["marked indented under heading"] * (sum(c in "iI" for c in symbols[i + 1 : j]) > 0))]
        return ["marked begins indented"] if first in "iI" else []
    if label == "notice":
        return ["notice begins y", *single] if first in "yYtn" else single
    return ["authored begins n"] if first in "nN" else []


_ON = re.compile(r"\s*(?:on|am|le|el|il|em|op|den|dnia)\s[^\n]*\d", re.IGNORECASE)
_WROTE = re.compile(r"(?:^|\s|>)(?:wrote|schrieb\b.{0,60}|a écrit|escribió|ha scritto|escreveu|schreef\b.{0,60}|skrev\b.{0,60}|napisał(?:\(a\))?)\s*:\s*$", re.IGNORECASE)


def _wrapped_headings(lines: list[str], longest: int = 4) -> set[int]:
    """Numbers of the lines of headings ("On ... wrote:") that are broken over two to ``longest`` lines."""
    out: set[int] = set()
    for k, line in enumerate(lines):
        if _WROTE.search(line) and not _ON.match(line):
            for first in range(k - 1, max(-1, k - longest), -1):
                if not lines[first].strip() or lines[first].lstrip()[:1] in (">", "|") or _WROTE.search(lines[first]):
                    break
                if _ON.match(lines[first]):
                    out.update(range(first, k + 1))
                    break
    return out


def symbols_of(lines: list[str]) -> str:
    """One symbol for each non-blank line: its cue, as a capital after a blank line where that matters.

    't' is plain text, 'x' a line of a paragraph with several words of legal notices, 'y' with one, 'i' an indented line.
    """
    out: list[str] = []
    after_blank = True
    paragraph: list[int] = []
    legal: set[str] = set()

    def close() -> None:
        # Beside running text a line without stop is part of it, unless it comes after a closing word or a delimiter.
        for at, k in enumerate(paragraph):
            if out[k] in "sd":
                break
            if out[k] in "nN" and any(out[x] == "t" for x in paragraph[max(0, at - 1) : at + 2]):
                out[k] = "t"
        if legal and paragraph:
            mark = "x" if len(legal) > 1 else "y"
            for k in paragraph:
                if out[k] in "tngNG":
                    out[k] = mark

    wrapped = _wrapped_headings(lines)
    for number, line in enumerate(lines):
        if _BLANK.match(line):
            close()
            paragraph, legal, after_blank = [], set(), True
            continue
        text = " ".join(line.split())
        m = _CUE.match(text)
        cue = m.lastgroup if m else "t"
        if number in wrapped:
            cue = "h"
        elif _INDENTED.match(line):
            cue = "i"
        elif cue == "f" and len(re.findall(r"\b(?:from|sent|to|subject|date|cc):\s", text, re.IGNORECASE)) > 1:
            cue = "F"
        elif after_blank and cue in "n":
            cue = "N"
        if cue in "tngNG" and (words := _LEGAL.findall(text)):
            legal.update(w.lower() for w in words)
        paragraph.append(len(out))
        out.append(cue)
        after_blank = False
    close()
    return "".join(out)


def _compositions(n: int, seed: int) -> list[tuple[str, list[Segment]]]:
    """Labelled examples, put together from the parts that e-mails have; a bounded sample of ``n`` with known labels."""
    rng = random.Random(seed)
    text = lambda: "t" * rng.choice((1, 1, 2, 3, 4, 5, 6, 7, 8, 9))
    name = lambda: rng.choice(("n", "N", "N", "N", "n", "NN", "nn", "nnc", "nncc", "c", "ncc", "nc", "dn", "dnc", "dnn", "dnnc", "N", "Nnc", "Nncc"))
    signature = lambda: rng.choice(("s", "s", "s", "")) + name() + rng.choice(("", "", "v"))
    notice = lambda: rng.choice(("x", "xxx", "xxxx", "xxxxx", "xxy"))
    quoted = lambda k: "q" * k
    history = lambda: rng.choice(("H", "Hfff", "Hffff", "ffff", "fff", "Nmfff", "nmfff", "Hnff", "FF")) + "".join(rng.choice(("g", "t", "tt", "s", "n", "N", "c", "v", "h", "qqq", "x", "H", "ffff", "nm", "i")) for _ in range(rng.randint(0, 8)))
    marked = lambda: rng.choice(("h" + quoted(rng.choice((rng.randint(1, 12), 60))), "h" + quoted(rng.randint(1, 12)), "h" + "i" * rng.randint(1, 10), "p" + quoted(rng.randint(2, 9)), quoted(rng.randint(2, 9))))
    bracketed = lambda: "k" + "".join(rng.choice(("g", "t", "tt", "s", "n", "Hfff", "x", "c")) for _ in range(rng.randint(1, 7))) + "e"
    out = []
    for _ in range(n):
        parts: list[tuple[str, str]] = []
        own = rng.choice(("g", "g", "g", "", "N")) + text()
        if rng.random() < 0.3:  # answers below or between quoted lines
            parts.append(rng.choice((("marked", marked()), ("marked", marked()), ("bracketed", bracketed()))))
            if parts[-1][0] == "marked" and "q" in parts[-1][1] and rng.random() < 0.4:
                parts += [("authored", text()), ("marked", quoted(rng.randint(1, 8)))]
        if rng.random() < 0.94:
            parts.append(("authored", own))
            if rng.random() < 0.75:
                parts.append(("signature", signature()))
        if rng.random() < 0.3:
            parts.append(("notice", notice()))
        if rng.random() < 0.5:
            parts.append(rng.choice((("history", history()), ("history", history()), ("marked", marked()), ("bracketed", bracketed()))))
        segments, symbols = [], ""
        for label, s in parts:
            segments.append((label, len(symbols), len(symbols) + len(s)))
            symbols += s
        if symbols:
            out.append((symbols, segments))
    return out


@lru_cache(2)
def train(n: int = 2500, seed: int = 3) -> dict[str, float]:
    """Weights of the segment model, trained on ``n`` labelled compositions."""
    model = SemiMarkov(LABELS, _PAIRS, _whole, _PRIOR, {"signature": 14})
    model.train(_compositions(n, seed), rounds=5, decode=segment)
    return dict(model.weights)


#: Header blocks without quoted or indented lines after them; from there all is history, but inside brackets.
_HEADING = re.compile(r"(?:H(?=[nNcC]?[fFmM])|[mM](?=[fF])|f(?=[fl])|F)[HnNcCfFlmM]*+(?![qiIhp])")
_NONE = (float("-inf"), -1)


def segment(symbols: str, weights: dict[str, float], longest: int = 14) -> list[Segment]:
    """The best segmentation of a whole e-mail, in time proportional to its length.

    Scores are those of ``SemiMarkov`` with the features of ``_whole``: as these tell of a segment's beginning and of what is in it, the best
    beginning so far is kept for each label; only signatures, of at most ``longest`` lines, are tried at each length. Rules are absolute
    here, as sums over a long e-mail outgrow any weight: outside brackets a header block is in history, or directly before marked lines, and
    a bracket is in history or in a bracketed segment, which begins with it and is closed or goes to the end, and history begins with a header block.
    """
    n = len(symbols)
    if not n:
        return []
    w = lambda f: weights.get(f, 0.0)
    sums = {y: [0.0] for y in LABELS}
    for y, total in sums.items():
        own = {c: w(f"{y}:{c}") for c in set(symbols)}
        for c in symbols:
            total.append(total[-1] + own[c])
    headings = {m.start() for m in _HEADING.finditer(symbols)}
    lengths = [w(_signature_length(k)) for k in range(longest + 1)]
    into = {y: [(b, w(f"{b}>{y}")) for b in _NEXT if (b, y) in _PAIRS] for y in LABELS}
    close, opened = {}, []  # end of the bracket begun at a place
    for i, c in enumerate(symbols):
        if c == "k":
            opened.append(i)
        elif c == "e" and opened:
            close[opened.pop()] = i + 1
    first_of = {y: {} for y in LABELS}

    def begins(y: str, i: int) -> float:
        """What the beginning of a segment tells, whatever its length."""
        key = symbols[i : i + 2]
        if key not in first_of[y]:
            first_of[y][key] = sum(w(f) for f in _whole(key, y, 0, 1 if y != "history" else len(key)) if f not in (f"{y} one line", "signature lines 1"))
        return first_of[y][key]

    best: list[dict[str, tuple[float, int, str]]] = [{} for _ in range(n + 1)]
    come: list[dict[str, tuple[float, str]]] = [{} for _ in range(n)]
    kept = dict.fromkeys(("authored", "notice", "marked", "under", "indented"), _NONE)  # best beginnings: score without the sum up to it, place
    chains: list[tuple[float, int]] = [_NONE] * (n + 1)  # of closed brackets that end at a place
    free = 0  # first place from which no rule bars a segment
    last = (_NONE[0], -1)  # best beginning of history, which goes to the end

    def put(j: int, y: str, score: float, i: int) -> None:
        score += w(f"{y}>$") if j == n else 0.0
        if i >= 0 and (y not in best[j] or score > best[j][y][0]):
            best[j][y] = (score, i, come[i][y][1])

    for i, c in enumerate(symbols):
        j = i + 1
        before = {b: x[0] for b, x in best[i].items()} if i else {"^": 0.0}
        fresh: dict[str, tuple[float, int]] = {}
        single: dict[str, float] = {}
        for y in LABELS:
            if scores := [(before[b] + v, b) for b, v in into[y] if b in before]:
                come[i][y] = max(scores)
        if c in "iI" and kept["under"][1] >= 0:
            x, at = kept["under"]
            kept["indented"] = max(kept["indented"], (x + w("marked indented under heading"), at), key=lambda t: t[0])
            kept["under"] = _NONE
        for y in ("authored", "notice", "marked"):
            if y in come[i] and c != "k":
                where = "under" if y == "marked" and c in "hp" else y
                single[y] = come[i][y][0] - sums[y][i] + begins(y, i) + sums[y][j] + w(f"{y} one line")
                fresh[where] = max(kept[where], (come[i][y][0] - sums[y][i] + begins(y, i), i), key=lambda t: t[0])
        if "history" in come[i] and _whole(symbols[i : i + 2], "history", 0, min(2, n - i)) != ["history begins otherwise"]:
            last = max(last, (come[i]["history"][0] - sums["history"][i] + begins("history", i), i), key=lambda t: t[0])
        if i in close:
            chain = chains[i]
            if "bracketed" in come[i]:
                chain = max(chain, (come[i]["bracketed"][0] - sums["bracketed"][i], i), key=lambda t: t[0])
            chains[close[i]] = max(chains[close[i]], chain, key=lambda t: t[0])
        if c == "k" or i in headings:
            free = j
            kept, fresh, single = dict.fromkeys(kept, _NONE), {}, {}
        for y, value in single.items():
            put(j, y, value, i)
        for y, where in (("authored", "authored"), ("notice", "notice"), ("marked", "marked"), ("marked", "under"), ("marked", "indented")):
            x, at = kept[where]
            put(j, y, x + sums[y][j], at)
        kept |= fresh  # of more than one line from here on
        for at in range(max(free, j - longest), j):
            if "signature" in come[at]:
                put(j, "signature", come[at]["signature"][0] + sums["signature"][j] - sums["signature"][at] + begins("signature", at) + lengths[j - at], at)
        x, at = chains[j]  # no segment where that is _NONE
        put(j, "bracketed", x + sums["bracketed"][j] + w("bracketed closed"), at)
    put(n, "history", last[0] + sums["history"][n], last[1])
    depth = 0
    for at in range(n - 1, -1, -1):
        depth += (symbols[at] == "k") - (symbols[at] == "e")
        if symbols[at] == "k" and depth > 0 and "bracketed" in come[at]:  # not closed at the end
            put(n, "bracketed", come[at]["bracketed"][0] + sums["bracketed"][n] - sums["bracketed"][at] + w("bracketed open"), at)
    y = max(best[n], key=lambda y: best[n][y][0])
    segments, j = [], n
    while y != "^":
        _, i, before = best[j][y]
        segments.append((y, i, j))
        j, y = i, before
    return segments[::-1]


class Decoder:
    """Finds the authored lines of e-mails. Sequences of cues recur, so their segmentations are kept."""

    def __init__(self, weights: dict[str, float], keep: int = 50_000):
        self._weights = weights
        self._kept: dict[str, str] = {}
        self._keep = keep

    def labels(self, symbols: str) -> str:
        """The first letter of each line's label."""
        if symbols not in self._kept:
            if len(self._kept) >= self._keep:
                self._kept.clear()
            self._kept[symbols] = "".join(label[0] * (j - i) for label, i, j in segment(symbols, self._weights))
        return self._kept[symbols]

    def authored(self, body: str) -> list[int]:
        """Numbers, from 1, of the newly written lines that are not blank."""
        lines = body.split("\n")
        numbers = [k for k, line in enumerate(lines, 1) if not _BLANK.match(line)]
        return [k for k, label in zip(numbers, self.labels(symbols_of(lines))) if label == "a"]


def find_authored(emails: DataFrame, id_col: str = "email_id", text_col: str = "raw_body", examples: int = 2500) -> DataFrame:
    """(id, line_no, text) of the newly written lines that are not blank, lines counted from 1 after splitting at line feeds.

    Lines are reduced to boundary cues; a semi-Markov model of authored, signature, notice and quoted segments (marked line by line, between
    two bracketing lines, or as history to the end) picks the best segmentation of each e-mail. It is trained on ``examples`` compositions
    with known labels.

    Null and blank texts have no lines. Repeated ids are done row by row.
    """
    weights = train(examples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(weights)
        for batch in batches:
            ids, numbers, texts = [], [], []
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = decoder.authored(body)
                if found:
                    lines = body.split("\n")
                    ids += [i] * len(found)
                    numbers += found
                    texts += [lines[k - 1] for k in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=["id", "line_no", "text"])

    return emails.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body")).filter("id is not null and body is not null and body <> ''").mapInArrow(run, "id long, line_no int, text string")
