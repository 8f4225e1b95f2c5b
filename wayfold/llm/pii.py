"""Personal data by fixed patterns and a semi-Markov conditional random field over whole-span features."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

#: Kinds with a fixed pattern, in their order, then kinds that only the field finds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a run of digits without a dot behind it fails as a whole, so no start inside it need be tried
_SECRET = re.compile(r"(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{20,}").fullmatch
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+").fullmatch
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# every candidate of span_features has a digit or one of these; the word ' at ' counts only with a dot form in reach of one span
_CUE = re.compile(r"[0-9@]|[\[(]at[\])]| dot(?= )| at(?= )", re.I)
_DOT = re.compile(r"\w\.\w| dot |[\[(]dot[\])]", re.I)
# keys and tokens of letters and digits mixed are one token; a part of one is nothing by itself
_TOKEN = re.compile(r"(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{20,}|[^\W\d_]+|[0-9]+|\s+|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns: leftmost and non-overlapping per kind; matches that fail their check go."""
    found = []
    at = low = 0
    while (at := text.find("@", at)) >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        if m:
            while start > low and text[start - 1] in _LOCAL:
                start -= 1
        if m and start < at:
            found.append((start, m.end(), "email"))
            at = low = m.end()
        else:
            at += 1
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() < 12:
                continue
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# ---- the field -------------------------------------------------------------------------------------------------------

#: Words before a span that the field may use.
CUE_WORDS = frozenset("tel phone call mobile fax cell telefon card visa account iban ssn social security mail email write ip host server address order version price invoice date page id no token key secret password bearer commit".split())
#: Bounds of a segment; numbers that are not part of an account, an address or a key have at most as many digits as a card.
MAX_TOKENS, MAX_CHARS, MAX_DIGITS = 24, 72, 19


class Region:
    """Tokens of a stretch of text and the candidate segments in it, each with its whole-span features. ``taken`` has the spans already
    found, apart from each other and in order; no segment touches them."""

    def __init__(self, text: str, start: int, end: int, taken: list[tuple[int, int]] = ()):
        self.tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]
        self.spans: dict[int, list[tuple[int, list[str]]]] = defaultdict(list)  # by end: (begin, features)
        shut, at = [False] * len(self.tokens), 0  # tokens that a span already found touches
        for t, (a, b) in enumerate(self.tokens):
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            shut[t] = at < len(taken) and taken[at][0] < b
        kind = [text[a].isspace() and "s" or ("d" if "0" <= text[a] <= "9" else "a" if text[a].isalpha() else "p") for a, _ in self.tokens]
        # running counts over tokens rule out most segments before their features are made
        words = [text[a:b] for a, b in self.tokens]
        digits = [0, *accumulate(sum("0" <= c <= "9" for c in w) for w in words)]
        letters = [0, *accumulate(any(c.isalpha() for c in w) for w in words)]
        ats = [0, *accumulate(w == "@" or w.lower() == "at" for w in words)]
        for i, (a, _) in enumerate(self.tokens):
            if shut[i] or kind[i] == "s" or (kind[i] == "p" and text[a] not in "+("):
                continue
            for j in range(i, min(len(self.tokens), i + MAX_TOKENS)):
                b = self.tokens[j][1]
                if shut[j] or b - a > MAX_CHARS or "\n" in text[self.tokens[j][0] : b]:
                    break
                if kind[j] in "ps" or (ats[j + 1] == ats[i] and not self._plain(letters[j + 1] - letters[i], digits[j + 1] - digits[i], words[i], i == j)):
                    continue
                found = span_features(text, a, b)
                if found:
                    self.spans[j + 1].append((i, found))

    @staticmethod
    def _plain(letters: int, digits: int, first: str, single: bool) -> bool:
        """Whether a segment without an at sign can be personal data: a number of 7 to 19 digits, an account, a secret."""
        return 7 <= digits <= MAX_DIGITS if not letters else single or (first[:2].isupper() and first[:2].isalpha())


def span_features(text: str, a: int, b: int) -> list[str]:
    """Features of a whole candidate span; none where it can't be personal data."""
    s = text[a:b]
    digits = "".join(c for c in s if "0" <= c <= "9")
    letters = sum(c.isalpha() for c in s)
    low = s.lower()
    mail = "@" in s or ("[at]" in low or "(at)" in low or " at " in low) and (" dot " in low or "[dot]" in low or "(dot)" in low or re.search(r"\w\.\w", s) is not None)
    iban = bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,8}", s))
    secret = _SECRET(s) is not None
    if letters and not mail and not iban and not secret:
        return []
    if not mail and not iban and not secret and not 7 <= len(digits) <= MAX_DIGITS:
        return []
    groups = re.findall(r"[0-9]+", s)
    left, right = text[a - 1 : a] if a else "", text[b : b + 1]
    out = ["bias", f"digits={min(len(digits), 22)}", f"groups={len(groups)}"]
    if not mail:
        out.append("form=" + re.sub(r"[0-9]+", lambda m: str(min(9, len(m[0]))), "secret" if secret else s if not iban else "iban"))
        out.append("seps=" + "".join(sorted({c for c in s if not c.isalnum()})))
    for name, on in (
        ("mail", mail), ("plainmail", "@" in s and " " not in s), ("mailform", mail and re.fullmatch(r"[\w.%+-]+ ?(?:@|[\[(]at[\])]| at ) ?[\w-]+(?: ?(?:\.|[\[(]dot[\])]| dot ) ?[\w-]+)+", s, re.I) is not None),
        ("iban", iban), ("secret", secret), ("hex", secret and _HEX(s) is not None), ("quoted", left in ("'", '"') and left == right), ("plus", s[0] == "+"), ("paren", s[0] == "("), ("luhn", len(digits) >= 12 and luhn(digits)),
        ("ip", len(groups) == 4 and all(int(g) <= 255 for g in groups if len(g) < 5) and s.count(".") == 3),
        ("ssn", re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", s) is not None), ("phone10", re.fullmatch(r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}", s) is not None),
        ("intl", re.fullmatch(r"00[0-9]{2}(?:[ -][0-9]{2,5}){2,4}", s) is not None),
        ("touch", left.isalnum() or right.isalnum() or left in tuple("-+/@_=#") or right in tuple("-/@_=")),
        ("longer", mail and re.match(r" ?(?:\.|[\[(]dot[\])]| dot )[ ]?\w", text[b : b + 10]) is not None),
        ("more", right in tuple(".-, ") and text[b + 1 : b + 2].isdigit()), ("before", left in tuple(".-, ") and a > 1 and text[a - 2].isdigit()),
    ):
        if on:
            out.append(name)
    word = re.search(r"([^\W\d_]+)[^\w\n]{0,4}$", text[max(0, a - 24) : a])
    if word and word[1].lower() in CUE_WORDS:
        out.append("word=" + word[1].lower())
    return out


class SemiMarkovField:
    """Log-linear scores of segments by kind; text outside segments is in tokens of score 0."""

    def __init__(self):
        self.weights: dict[str, list[float]] = defaultdict(lambda: [0.0] * len(KINDS))

    def scores(self, features: list[str]) -> list[float]:
        out = [0.0] * len(KINDS)
        for f in features:
            w = self.weights.get(f)
            if w is not None:
                for k in range(len(KINDS)):
                    out[k] += w[k]
        return out

    def decode(self, region: Region) -> list[tuple[int, int, str]]:
        """The best segmentation, boundaries and kinds chosen jointly: a Viterbi pass over candidates of bounded length."""
        n = len(region.tokens)
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j], back[j] = best[j - 1], None
            for i, features in region.spans.get(j, ()):
                scores = self.scores(features)
                k = max(range(len(KINDS)), key=scores.__getitem__)
                if best[i] + scores[k] > best[j]:
                    best[j], back[j] = best[i] + scores[k], (i, k)
        out, j = [], n
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                out.append((region.tokens[i][0], region.tokens[j - 1][1], KINDS[k]))
                j = i
        return out[::-1]

    def fit(self, examples: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 8, rate: float = 0.2, decay: float = 1e-3) -> SemiMarkovField:
        """Stochastic gradient of the conditional log-likelihood; expectations by the forward-backward sums over segmentations."""
        prepared = []
        for text, gold in examples:
            r = Region(text, 0, len(text))
            prepared.append((r, {(a, b): KINDS.index(k) for a, b, k in gold}))
        for epoch in range(epochs):
            step = rate / (1 + epoch / 4)
            for r, gold in prepared:
                n = len(r.tokens)
                segments = [(i, j, f, self.scores(f)) for j in r.spans for i, f in r.spans[j]]
                by_end, by_start = defaultdict(list), defaultdict(list)
                for s in segments:
                    by_end[s[1]].append(s)
                    by_start[s[0]].append(s)
                forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
                for j in range(1, n + 1):
                    forward[j] = _log_sum([forward[j - 1], *(forward[i] + x for i, _, _, sc in by_end[j] for x in sc)])
                for i in range(n - 1, -1, -1):
                    backward[i] = _log_sum([backward[i + 1], *(backward[j] + x for _, j, _, sc in by_start[i] for x in sc)])
                for i, j, f, sc in segments:
                    want = gold.get((r.tokens[i][0], r.tokens[j - 1][1]))
                    for k in range(len(KINDS)):
                        g = (1.0 if want == k else 0.0) - math.exp(min(0.0, forward[i] + sc[k] + backward[j] - forward[n]))
                        if abs(g) > 1e-4:
                            for x in f:
                                w = self.weights[x]
                                w[k] += step * (g - decay * w[k])
        return self


def _log_sum(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


def examples(n: int = 900, seed: int = 17) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Made-up sentences with personal data in the forms people write, and with numbers that are none."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8)))

    def card(good: bool) -> str:
        body = r.choice("3456") + num(14)
        check = next(d for d in "0123456789" if luhn(body + d) == good)
        s = body + check
        return r.choice([s, "-".join(s[i : i + 4] for i in range(0, 16, 4)), " ".join(s[i : i + 4] for i in range(0, 16, 4)), ".".join(s[i : i + 4] for i in range(0, 16, 4))])

    at, dot = lambda: r.choice([" at ", "[at]", "(at)", " [at] ", " (at) "]), lambda: r.choice([" dot ", "[dot]", ".", " dot "])
    ip = lambda top: ".".join(str(r.randint(0, top)) for _ in range(4))
    forms = {
        "email": [lambda: f"{word()}{at()}{word()}{dot()}{r.choice(['com', 'org', 'net'])}", lambda: f"{word()}.{num(2)}@{word()}.{word()}.com", lambda: f"{word()}{at()}{word()}{dot()}{word()}{dot()}com"],
        "ip": [lambda: ip(255)],
        "card": [lambda: card(True)],
        "phone": [lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"{num(3)}.{num(3)}.{num(4)}", lambda: f"0049 {num(3)} {num(4)} {num(2)}", lambda: f"00{r.randint(10, 99)}-{num(3)}-{num(5)}", lambda: f"+{r.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", lambda: f"+{num(2)} {num(3)} {num(3)} {num(3)}"],
        "ssn": [lambda: f"{num(3)}-{num(2)}-{num(4)}"],
        "secret": [lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 64]))), lambda: "".join(r.choice("0123456789ABCDEF") for _ in range(r.choice([32, 40]))), lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(r.randint(24, 44)))],
        "iban": [lambda: f"{r.choice(['DE', 'FR', 'ES'])}{num(2)} {num(4)} {num(4)} {num(4)} {num(4)} {num(2)}", lambda: f"DE{num(20)}"],
    }
    clean = [
        lambda: f"20{num(2)}-0{r.randint(1, 9)}-1{num(1)}", lambda: f"{num(2)}/{num(2)}/20{num(2)} {num(2)}:{num(2)}", lambda: f"{num(1)},{num(3)}.{num(2)}", lambda: f"{r.randint(1, 9)}.{num(1)}.{num(2)}", lambda: card(False), lambda: num(r.choice([7, 8, 9, 10, 11])),
        lambda: f"{r.randint(300, 999)}.{num(3)}.{num(2)}.{num(1)}", lambda: f"{num(4)} {num(4)}", lambda: f"{num(3)}-{num(4)}-{num(3)}-{num(2)}", lambda: f"{word()}@{word()}", lambda: f"password={num(2)}b{num(3)}f{num(6)}", lambda: f"{num(4)}-{num(4)}", lambda: f"{word()} at {word()}", lambda: " ".join(num(r.randint(1, 4)) for _ in range(r.randint(3, 8))),
        lambda: f"{num(5)}-{num(5)}-{num(5)}", lambda: f"{num(1)}.{num(1)}.{num(1)}.{num(1)}.{num(1)}", lambda: f"{num(8)}-{num(4)}-{num(4)}", lambda: num(r.choice([12, 14, 18, 20])), lambda: f"{num(3)} {num(3)} {num(4)}",
        lambda: "commit " + "".join(r.choice("0123456789abcdef") for _ in range(40)),
    ]
    out = []
    for _ in range(n):
        text, gold = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join([*(word() for _ in range(r.randint(1, 4))), *([r.choice(sorted(CUE_WORDS))] if r.random() < 0.3 else [])]) + r.choice([" ", ": ", " "])
            if r.random() < 0.5:
                kind = r.choice(KINDS)
                s = r.choice(forms[kind])()
                if kind == "secret":  # what makes a run of letters and digits a secret is the word before it
                    name = r.choice(["token", "TOKEN", "key", "secret", "password", "Bearer"])
                    text += name + r.choice([' = "', "=", ": ", '="', " "])
                gold.append((len(text), len(text) + len(s), kind))
            else:
                s = r.choice(clean)()
                if s.replace("-", "").replace(" ", "").isdigit() and luhn(re.sub(r"\D", "", s)) and 12 <= sum(map(str.isdigit, s)) <= 19:
                    s = "none"
            text += s + ('"' if text[-1:] == '"' else "") + r.choice([" ", ". ", ", ", " "])
        out.append((text + word(), gold))
    return out


@lru_cache(maxsize=1)
def trained_field() -> tuple[tuple[str, tuple[float, ...]], ...]:
    """Weights fitted on made-up sentences, the same for every table."""
    return tuple((f, tuple(w)) for f, w in sorted(SemiMarkovField().fit(examples()).weights.items()))


def field_from(weights: tuple[tuple[str, tuple[float, ...]], ...]) -> SemiMarkovField:
    field = SemiMarkovField()
    field.weights.update((f, list(w)) for f, w in weights)
    return field


def regions(text: str, taken: list[tuple[int, int]], before: int = 40, after: int = 64) -> list[tuple[int, int]]:
    """Stretches around characters that any candidate needs, outside the spans already found; cut at white space."""
    out: list[list[int]] = []
    at = 0
    spans = iter(sorted(taken))
    span = next(spans, None)
    while m := _CUE.search(text, at):
        a = m.start()
        if m[0].lower() == " at" and not _DOT.search(text, max(0, a - MAX_CHARS), m.end() + MAX_CHARS):
            at = m.end()
            continue
        while span is not None and span[1] <= a:
            span = next(spans, None)
        if span is not None and span[0] <= a:
            at = max(span[1], m.end())
            continue
        lo = max(0, a - before)
        while 0 < lo < a and not text[lo - 1].isspace():
            lo += 1
        hi = min(len(text), m.end() + after)
        while hi < len(text) and hi > m.end() and not text[hi].isspace():
            hi -= 1
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
        at = m.end()
    return [(a, b) for a, b in out]


def find_spans(text: str, field: SemiMarkovField) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Fixed-pattern spans, and all spans: the field adds segments that touch none of them."""
    base = base_spans(text)
    taken: list[tuple[int, int]] = []
    for a, b, _ in base:  # in order of their starts; spans of two kinds may overlap
        if taken and a <= taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    added, at = [], 0
    for a, b in regions(text, taken):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        end = at
        while end < len(taken) and taken[end][0] < b:
            end += 1
        added += field.decode(Region(text, a, b, taken[at:end]))
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def detect_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, the counts of fixed-pattern spans, and ``base`` and ``spans`` as arrays of (kind, start, end) in
    code points, end exclusive. Null and empty texts have none; long texts are read whole, in regions around cues, in time linear
    in their length; repeated rows are treated alike; other columns are ignored; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(trained_field())

    def make():
        field = field_from(shared.value)

        def fn(ids, texts):
            base_out, all_out = [], []
            for t in texts:
                base, every = find_spans(t or "", field)
                base_out.append([{"kind": k, "start": a, "end": b} for a, b, k in base])
                all_out.append([{"kind": k, "start": a, "end": b} for a, b, k in every])
            return ids, base_out, all_out

        return fn

    span = "array<struct<kind:string,start:long,end:long>>"
    found = map_columns(docs.select(F.col(id_col).cast("long"), text_col), f"doc_id long, base {span}, spans {span}", make)
    for kind in BASE:
        found = found.withColumn(f"n_{kind}", F.expr(f"CAST(size(filter(base, s -> s.kind = '{kind}')) AS BIGINT)"))
    return found


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def spans_text(column: str):
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
