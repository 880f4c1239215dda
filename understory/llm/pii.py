"""Personal data by candidate gradient boosting.

Exact patterns give the base spans, which always stay. High-recall generators propose further, overlapping spans: written-out
addresses, national phone numbers, IPv6 addresses and cards with other separators. Boosted trees score them by format
and context; those above a threshold calibrated for precision on held-out examples are added where they don't touch a
base span. The trees are trained here on composed examples, of a fixed number, so the model is the same everywhere.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from understory.llm.boosting import Trees, boost, threshold
from understory.llm.common import map_batches

KINDS = ("email", "ip", "card", "phone")
#: Examples that are composed for the fit; half of them are held out for calibration.
EXAMPLES = 12_000
PRECISION = 0.99
#: Letters of context on either side that features see.
CONTEXT = 32

# ---------------------------------------------------------------- base patterns

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*").finditer
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
DIGIT = re.compile(r"[0-9]").search
DIGITS = re.compile(r"[0-9]").findall

Span = tuple[int, int, int]  # start, number of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """All base spans by start, then kind. Each pattern is matched leftmost and without overlap; a match that fails its check is dropped.

    Runs in time linear in the text, also over very long runs of digits or letters.
    """
    out: list[Span] = []
    at = text.find("@")
    free = 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN(text, at + 1)):
            out.append((start, 0, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    if not (first := DIGIT(text)):
        return out
    for m in CARD(text, first.start()):
        if m.end() - m.start() >= 12:
            digits = "".join(DIGITS(m.group()))
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "." in text:
        for run in DOTTED(text, first.start()):  # numbers joined by single points; a match takes four of them
            if run.group().count(".") >= 3:
                at, parts = run.start(), run.group().split(".")
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k : k + 4]
                    end = at + sum(map(len, four)) + 3
                    if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in four)):
                        out.append((at, 1, end))
                    at = end + 1
    if "+" in text:
        for m in PHONE(text):
            if 9 <= len(DIGITS(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---------------------------------------------------------------- candidates

AT = re.compile(r"\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\sat\s", re.I)
DOMAIN_PARTS = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s|\.)[A-Za-z0-9-]{1,63}){1,4}", re.I).match
POINT = r"(?:\.|\[\.\]|\(\.\)|\s?[\[(]dot[\])]\s?)"
GROUP = r"[0-9A-Fa-f]{1,4}"
GENERATORS = (
    (1, re.compile(rf"(?<![0-9A-Za-z:.])(?:(?:{GROUP}:){{2,7}}(?::?{GROUP}){{1,7}}|(?:{GROUP}(?::{GROUP}){{0,6}})?::(?:{GROUP}(?::{GROUP}){{0,6}})?)(?![0-9A-Za-z:])"), lambda t: t.count(":") > 1),
    (1, re.compile(rf"(?<![0-9.])[0-9]{{1,3}}{POINT}[0-9]{{1,3}}{POINT}[0-9]{{1,3}}{POINT}[0-9]{{1,3}}(?![0-9])", re.I), lambda t: "[" in t or "(" in t),
    (2, re.compile(r"(?<![0-9])[0-9]{4}(?:[._/ \u00a0\u2009\u2013-]{1,3}[0-9]{3,6}){2,4}(?![0-9])"), DIGIT),
    (3, re.compile(r"(?<![0-9+])(?:00[0-9]{1,3}[\x20.-])?\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}[0-9]{2,8}){1,4}(?![0-9])"), DIGIT),
)
#: Cue words before personal data of each kind, words before look-alikes, words before "at" in prose, common ends of host names.
WORDS = (
    re.compile(r"mail|correo|courriel|contact|write|reach|address", re.I),
    re.compile(r"\bip\b|ipv6|server|host|addr|router|ping|login", re.I),
    re.compile(r"card|visa|carte|karte|tarjeta|credit|amex|payment|pay", re.I),
    re.compile(r"phone|tel|call|mobile|fax|cell|number|llam|appel|anruf|whatsapp|reach|contact|ring|text me|dial", re.I),
    re.compile(r"isbn|issn|order|invoice|version|page|pages|article|ref|no\.|nr\.|part|sku|lot|total|score|year|price|date|time|id|serial|account|mac|ratio|bestell|factura|commande|from|between", re.I),
)
PROSE = frozenset("available look looking looked found us out online sold visit hosted located held live more back me you it this that here there them stay arrive met meet made seen read starting ends open listed news work worked working".split())
ENDS = frozenset("com org net edu gov info io de fr es it uk us eu ch at nl co ai dev app me biz".split())


def candidates(text: str) -> list[Span]:
    """Overlapping spans that may be personal data. What is proposed depends on the span and the letters beside it alone."""
    out: list[Span] = []
    for m in AT.finditer(text):
        start = m.start()
        while start and m.start() - start < 64 and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start() and (d := DOMAIN_PARTS(text, m.end())):
            out.append((start, 0, d.end()))
    for kind, pattern, may in GENERATORS:
        if may(text):  # what every match of the pattern needs
            out += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    return out


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    start, kind, end = span
    s = text[start:end]
    digits = "".join(DIGITS(s))
    left, right = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    near = re.findall(r"[0-9]{2,}", left[-16:] + " " + right[:16])
    own = [0.0] * 12
    if kind == 0:
        m = AT.search(s)
        local, domain = (s[: m.start()], s[m.end() :]) if m else (s, "")
        labels = re.split(r"[^A-Za-z0-9-]+(?:dot[^A-Za-z0-9-]+)?", domain)
        own = [
            bool(m) and any(c in m.group() for c in "[({<"), bool(re.search(r"[._0-9%+-]", local)), local.lower() in PROSE, len(labels), labels[-1].lower() in ENDS, len(labels[-1]),
            bool(re.search(r"[\[({<]\s?(?:dot|\.)", domain, re.I)), bool(re.search(r"\sdot\s", domain, re.I)), len(local), bool(re.search(r"(?:^|\.\s+|\n)$", left)), local[:1].isupper(), len(labels[0]),
        ]
    elif kind == 1:
        parts = s.split(":")
        own = ["::" in s, len(parts), bool(digits), bool(re.search(r"[a-fA-F]", s)), all(len(p) == 2 for p in parts), max(map(len, parts)), s.startswith("::"), bool(re.match(r"fe80|2001|2a0|fd|fc|::1$|ff0", s, re.I)),
               bool(re.search(r"[\[(]", s)), all(int(g) <= 255 for g in re.findall(r"[0-9]+", s)[:8]), bool(re.search(r"[A-Fa-f]{3}", s)) and not digits, s.endswith("::")]
    else:
        firsts = re.findall(r"[0-9]+", s)
        own = [groups[:3] == [3, 3, 4], groups in ([4, 4, 4, 4], [4, 6, 5]), s.startswith("0") and not s.startswith("00"), s.startswith("(0"), len(groups) == 5 and max(groups) == 2, bool(re.match(r"(?:19|20)[0-9]{2}\D", s)),
               bool(re.search(r"\D(?:19|20)[0-9]{2}$", s)), len(groups) == 3 and groups[0] <= 4 and groups[1] == 2 and groups[2] in (2, 4), max((int(g) for g in firsts[:1]), default=0), all(g == 3 for g in groups[1:]), len(set(re.findall(r"[^0-9]+", s))), groups[-1] if groups else 0]
    return [
        kind, len(s), len(digits), len(groups), max(groups, default=0), min(groups, default=0), luhn(digits) if digits else 0.0, len(set(digits)),
        s.count("("), s.count(")"), s.count("-"), s.count("."), s.count(" "), s.count("/"), s.startswith("00"), len(near), left[-1:].isalnum(), right[:1].isalpha(),
        left[-1:] in "$€£#%=|", right[:1] in "%€$", *(bool(w.search(left)) for w in WORDS), *own,
    ]


# ---------------------------------------------------------------- composed examples


def _number(r: random.Random, *sizes: int) -> list[str]:
    return ["".join(r.choice("0123456789") for _ in range(n)) for n in sizes]


def _luhn_card(r: random.Random, size: int = 16) -> str:
    head = r.choice("3456") + "".join(_number(r, size - 2))
    return next(head + c for c in "0123456789" if luhn(head + c))


def _word(r: random.Random) -> str:
    return "".join(r.choice(["an", "der", "la", "to", "re", "os", "ing", "sch", "eau", "ción", "jo", "mar", "el", "smith", "ka", "tin"]) for _ in range(r.randint(1, 3)))


def _true(r: random.Random, kind: int) -> tuple[str, str]:
    """Personal data in a form that the base patterns don't take, and what may stand before it."""
    if kind == 0:
        at, point = r.choice([(" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "."), (" at ", " dot "), (" (at) ", "."), ("[@]", "[.]"), (" AT ", " DOT "), (" at ", "."), (" {at} ", ".")])
        name = r.choice([f"{_word(r)}.{_word(r)}", f"{_word(r)}{r.randrange(100)}", f"{_word(r)}_{_word(r)}", _word(r)])
        plain = at == " at " and point == "."
        if plain and name.isalpha():
            name = f"{name}.{_word(r)}"
        host = point.join([_word(r), *([_word(r)] if r.random() < 0.2 else []), r.choice(sorted(ENDS))])
        cues = ["mail: ", "e-mail me, ", "contact ", "write to ", "reach ", "correo ", "courriel : "]
        return f"{name}{at}{host}".replace("ó", "o"), r.choice(cues if plain and r.random() < 0.7 else [*cues, "", "by ", "is "])
    if kind == 1:
        form, h = r.randrange(4), lambda: f"{r.randrange(65536):x}"
        if form == 0:
            s = ":".join(h() for _ in range(8))
        elif form == 1:
            s = r.choice(["2001:db8::", "fe80::", "fd00::", "2a02:26f0::"]) + ":".join(h() for _ in range(r.randint(1, 4)))
        elif form == 2:
            s = "::1" if r.random() < 0.5 else ":".join(h() for _ in range(r.randint(2, 4))) + "::" + ":".join(h() for _ in range(r.randint(1, 3)))
        else:
            s = r.choice(["[.]", "(.)", "[dot]"]).join(str(r.randrange(256)) for _ in range(4))
        return s, r.choice(["ip ", "host ", "server address ", "", "from ", "to ", "ping ", "login at "])
    if kind == 2:
        c, sep = _luhn_card(r), r.choice([".", "_", "/", "  ", " - ", "\u00a0", "\u2013"])
        parts = [c[:4], c[4:8], c[8:12], c[12:]]
        if r.random() < 0.2:
            c = _luhn_card(r, 15)
            parts = [c[:4], c[4:10], c[10:]]
        return sep.join(parts), r.choice(["card ", "visa ", "payment card: ", "", "pay with ", "karte ", "number "])
    a, b, c = _number(r, 3, 3, 4)
    form = r.randrange(7)
    if form < 4:
        s = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"][form]
    elif form == 4:
        s = f"00{r.randint(1, 99)} {r.choice([f'{a} {b} {c}', f'{a[:2]} {b}{c}', f'{a}-{b}{c}'])}"
    elif form == 5:
        s = r.choice([f"0{a[:2]} {b}{c}", f"0{a} {b}{c}", f"0{a}-{b}{c}", f"0{a}/{b}{c[:2]}", f"(0{a}) {b}{c[:3]}"])
    else:
        s = "0" + r.choice("1234567") + " " + " ".join(_number(r, 2, 2, 2, 2))
    cues = ["phone ", "tel. ", "call ", "fax: ", "mobile ", "my number is ", "reach me at ", "call us on ", "anruf ", "llame al "]
    return s, r.choice(cues if form == 3 else [*cues, "", "", "and ", "is "])


def _false(r: random.Random, kind: int) -> tuple[str, str]:
    """A look-alike, and what may stand before it."""
    if kind == 0:
        s = r.choice([
            f"{r.choice(sorted(PROSE))} at {_word(r)}.{r.choice(sorted(ENDS))}", f"{_word(r)} at {_word(r)} dot {_word(r)}", f"{_word(r)} at {_word(r)}.{_word(r).title()}", f"{r.choice(sorted(PROSE))} at {_word(r)} dot {r.choice(sorted(ENDS))}",
            f"{_word(r)} at {r.randrange(12)}.{r.randrange(60)}", f"{_word(r)} (at) {_word(r)}.{_word(r)}ly",
        ])
        return s, r.choice(["", "look ", "the ", "is ", "was "])
    if kind == 1:
        s = r.choice([
            ":".join(_number(r, 2, 2, 2)), ":".join(_number(r, 2, 2, 2, 2)), ":".join(_number(r, 1, 1, 1)), ":".join(f"{r.randrange(256):02x}" for _ in range(6)), r.choice(["ab::cd", "de::ad", "fab::add", "bad::ace", "a::b"]),
            ":".join(str(r.randint(1, 999)) for _ in range(r.randint(3, 4))), f"{r.randrange(24)}:{r.randrange(60):02}:{r.randrange(60):02}", "::", f"{r.choice(['ab', 'de', 'fee'])}::",
            r.choice(["[.]", "(.)"]).join(str(r.randrange(300, 999)) for _ in range(4)),
        ])
        return s, r.choice(["at ", "time ", "ratio ", "", "mac ", "from ", "std ", "verse "])
    sep = r.choice("._/ -")
    if kind == 2:
        s = r.choice([sep.join(_number(r, 4, 4, 4, 4)), sep.join(_number(r, 4, 3, 3)), "/".join(_number(r, 4, 4, 3)), "2024/" + "/".join(_number(r, 3, 3)), sep.join(_number(r, 4, 4, 4)), sep.join(_number(r, 4, 6, 5))])
        digits = "".join(DIGITS(s))
        if 12 <= len(digits) <= 19 and luhn(digits):
            s = s[:-1] + str((int(s[-1]) + 1) % 10)
        return s, r.choice(["order ", "ref ", "", "version ", "card ", "total ", "number "])
    year, day, month = str(r.randint(1900, 2035)), f"{r.randint(1, 28):02}", f"{r.randint(1, 12):02}"
    s = r.choice([
        "-".join([year, month, day]), ".".join([day, month, year]), "/".join([month, day, year]), f"{year}-{r.randint(1900, 2035)}", f"{r.randint(10, 99)}-{r.randint(100, 999)}", " ".join(_number(r, 3, 3)),
        " ".join(_number(r, 2, 3, 3)), "-".join(["978", *_number(r, 1, 2, 6)]), "-".join(["978", *_number(r, 2, 5, 2)]), "-".join(_number(r, 3, 7, 7)), "-".join(_number(r, 3, 2, 4)), " ".join(_number(r, 2, 2, 2)), ".".join(_number(r, 2, 3, 2)),
        " ".join(_number(r, 4, 4, 4)), "-".join(_number(r, 4, 4)), f"{r.randint(10, 99)} {r.randint(100, 999)}", "/".join(_number(r, 2, 2)), " ".join(_number(r, 5, 5)), "--".join(_number(r, 2, 2)), " ".join(str(r.randint(10, 99)) for _ in range(5)),
    ])
    lead = r.choice(["", "page ", "total ", "version ", _word(r) + " ", "year ", "pages "])
    if r.random() < 0.25:  # a number's form, said to be another thing
        s, lead = r.choice(["-", " ", "."]).join(_number(r, 3, 3, 4)), r.choice(["isbn ", "order ", "sku ", "part no. ", "lot ", "serial ", "ref ", "invoice ", "account id "])
    return s, lead


def _example(r: random.Random) -> tuple[str, int, int, bool]:
    """(text, kind, position of the personal data or look-alike, whether it is personal data)."""
    kind, true = r.randrange(4), r.random() < 0.5
    prose = lambda n: " ".join(_word(r) for _ in range(n))
    s, lead = (_true if true else _false)(r, kind)
    head = prose(r.randint(0, 6))
    head += r.choice([" ", " ", ". ", ", "]) * bool(head) + lead
    return head + s + r.choice([" ", ". ", ", ", "\n", "! "]) + prose(r.randint(0, 5)), kind, len(head), true


def examples(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and truth of the candidates in composed examples."""
    r = random.Random(seed)
    rows, truth = [], []
    for _ in range(count):
        text, kind, at, true = _example(r)
        for span in candidates(text):  # the wrong kind is as false as the wrong place
            rows.append(features(text, span))
            truth.append(true and span[1] == kind and abs(span[0] - at) <= 1)
    return np.array(rows, float), np.array(truth, float)


Model = tuple[tuple[Trees, ...], tuple[float, ...]]


@lru_cache(maxsize=2)
def fitted(count: int = EXAMPLES, precision: float = PRECISION, seed: int = 11) -> Model:
    """The trees and the threshold of each kind: the least chance, one half at least, that has the precision on held-out candidates."""
    x, y = examples(count, seed)
    every, least = [], []
    for k in range(len(KINDS)):
        own, truth = x[x[:, 0] == k], y[x[:, 0] == k]
        half = len(own) // 2
        every.append(boost(own[:half], truth[:half], own[half:], truth[half:], trees=80, depth=4))
        least.append(max(0.5, threshold(every[-1](own[half:]), truth[half:], precision)))
    return tuple(every), tuple(least)


def chances(model: Model, text: str, found: list[Span]) -> np.ndarray:
    """Calibrated chance of each candidate."""
    x = np.array([features(text, f) for f in found], float)
    out = np.zeros(len(found))
    for k, trees in enumerate(model[0]):
        if (own := x[:, 0] == k).any():
            out[own] = trees(x[own])
    return out


def added_spans(text: str, base: list[Span], model: Model) -> list[Span]:
    """Candidates above their kind's threshold that touch neither a base span nor a likelier candidate."""
    taken = np.array([(s, e) for s, _, e in base], np.int64).reshape(-1, 2)
    found = candidates(text)
    if len(taken) and found:
        order = np.maximum.accumulate(taken[np.argsort(taken[:, 0])], axis=0)
        starts, ends = order[:, 0], order[:, 1]
        found = [f for f in found if not ((k := int(np.searchsorted(starts, f[2]))) and ends[k - 1] > f[0])]
    if not found:
        return []
    chance, least = chances(model, text, found), model[1]
    order = sorted((k for k, f in enumerate(found) if chance[k] >= least[f[1]]), key=lambda k: (-chance[k], found[k]))
    out: list[Span] = []
    if len(order) <= 64:
        for k in order:
            if all(found[k][2] <= o[0] or found[k][0] >= o[2] for o in out):
                out.append(found[k])
        return sorted(out)
    import bisect

    for k in order:
        s, _, e = found[k]
        at = bisect.bisect_left(out, (s, -1, -1))
        if (at == 0 or out[at - 1][2] <= s) and (at == len(out) or out[at][0] >= e):
            out.insert(at, found[k])
    return out


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for s, kind, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[kind].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def detected(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, counts of base spans by kind, base_sha256, spans): every whole text in one narrow pass; null texts are empty."""
    kind = dict(docs.dtypes)[ident]
    model = fitted()

    def start():
        def one(b: pa.RecordBatch) -> dict:
            counts, hashes, spans = [[] for _ in KINDS], [], []
            for t in b.column(1).to_pylist():
                base = base_spans(t or "")
                for k, c in enumerate(counts):
                    c.append(sum(s[1] == k for s in base))
                hashes.append(hashlib.sha256(shown(base).encode()).hexdigest())
                spans.append(shown(sorted(base + added_spans(t or "", base, model))))
            return {"id": b.column(0), "base_sha256": pa.array(hashes), "spans": pa.array(spans)} | {f"n_{k}": pa.array(c, pa.int64()) for k, c in zip(KINDS, counts, strict=True)}

        return one

    schema = f"id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return map_batches(docs.select(F.col(ident).alias("id"), F.col(text).cast("string").alias("t")), schema, start).withColumnRenamed("id", ident)


def redacted(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents with personal data replaced in ``text`` (a null text stays null); ``n_chars``, where there is one, follows."""
    model = fitted()

    kinds = [f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema.fields)]
    at, size = docs.columns.index(text), docs.columns.index(n_chars) if n_chars in docs.columns else None

    def start():
        def clean(t: str | None) -> str | None:
            if t is None:
                return None
            base = base_spans(t)
            return redact(t, base + added_spans(t, base, model))

        def one(b: pa.RecordBatch) -> dict:
            out = {f"c{k}": c for k, c in enumerate(b.columns)}
            texts = [clean(t) for t in b.column(at).to_pylist()]
            out[f"c{at}"] = pa.array(texts, pa.string())
            if size is not None:
                out[f"c{size}"] = pa.array([None if t is None else len(t) for t in texts], b.schema.field(size).type)
            return out

        return one

    own = docs.withColumn(text, F.col(text).cast("string")).toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return map_batches(own, ", ".join("c%d string" % at if k == at else c for k, c in enumerate(kinds)), start).toDF(*docs.columns)
