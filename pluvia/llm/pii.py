"""Personal data and secrets by candidate gradient boosting.

Four base kinds (email, ip, card, phone) are fixed patterns with a check and always stay. Beyond them, generators with
high recall propose overlapping spans of further kinds; boosted trees judge each by its format and its context, a
held-out calibration turns margins into probabilities and a threshold per kind, and of overlapping spans that pass the
most probable stays. The trees are fitted on ``TRAINING_TEXTS`` texts made by :func:`example_text`, in which the private
spans are known; no corpus rows are used.

Defined results: a null text counts as empty and has no spans. Offsets are code points, the end is exclusive. Texts are
read whole. Rows that repeat an id are judged each by itself. Only id and text are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm import boosting

# Fixed patterns of the base kinds. An email's part before the @ is read backwards from there, and an ip begins where a
# run of digits does (from no other digit of it could a match begin), so that time grows with a text's length only.
BEFORE_AT, AFTER_AT = re.compile(r"[A-Za-z0-9._%+-]+"), re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE = ("email", "ip", "card", "phone")

# Generators of further candidates, wide on purpose.
ADDED = ("secret", "contact", "account", "identity")
GENERATORS = {
    "secret": re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}(?:\.[A-Za-z0-9+/_-]{8,}={0,2})*"),
    "contact": re.compile(r"\(?0[0-9]{2,4}\)?[\x20./-]?[0-9]{3,4}[\x20.-]?[0-9]{3,5}|\(?(?<![0-9])[1-9][0-9]{2}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    "account": re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?|[0-9]{12,19}"),
    "identity": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{1,2}[0-9]{6,9}[A-Z]?"),
}
# A spelled-out address: what follows the name, which is read backwards from here; parts of a host name have 63 characters at most.
SPELLED = re.compile(r"\s?[(\[{]?(?:at|AT)[)\]}]?\s?[A-Za-z0-9-]{1,63}(?:\s?[(\[{]?(?:dot|DOT)[)\]}]?\s?[A-Za-z]{2,63})+")
NAME = 64
TOP_LEVEL = frozenset("com org net edu gov int info biz io co ai app dev eu us uk de fr es it nl at ch be se no dk fi pl pt cz ru jp cn in br mx ca au nz".split())  # fixed names
TRAINING_TEXTS, PRECISION = 3000, 0.98
HINTS = {
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential"),
    "contact": ("phone", "tel", "call", "mobile", "fax", "mail", "contact", "write"),
    "account": ("account", "iban", "card", "bank", "konto", "pay"),
    "identity": ("ssn", "passport", "identity", "licence", "license no", "id no", "social"),
    "harmless": ("version", "isbn", "order", "build", "commit", "page", "article", "figure", "sha", "http", "www"),
}


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def emails(text: str) -> list[Span]:
    found, low, at = [], 0, text.find("@")
    while at >= 0:
        name, host = BEFORE_AT.match(text[low:at][::-1]), AFTER_AT.match(text, at + 1)
        if name and host:
            found.append(Span("email", at - name.end(), host.end()))
        low = host.end() if name and host else at + 1
        at = text.find("@", low)
    return found


def spelled(text: str) -> list[Span]:
    """Addresses with words in place of their signs."""
    found = []
    for m in SPELLED.finditer(text):
        if name := BEFORE_AT.match(text[max(0, m.start() - NAME) : m.start()][::-1]):
            found.append(Span("contact", m.start() - name.end(), m.end()))
    return found


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of the fixed patterns that pass their check, by kind and start."""
    found = emails(text)
    if re.search("[0-9]", text) is None:
        return found
    found += [Span("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = re.sub("[^0-9]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(Span("card", *m.span()))
    if "+" in text:
        found += [Span("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return found


def candidates(text: str) -> list[Span]:
    """All proposed spans of the added kinds; they may overlap one another.

    A generator is passed over only where its own pattern can't match.
    """
    digit = re.search("[0-9]", text) is not None
    found = [Span(kind, *m.span()) for kind, pattern in GENERATORS.items() if digit or kind == "secret" for m in pattern.finditer(text)]
    return found + (spelled(text) if ("at" in text or "AT" in text) and ("dot" in text or "DOT" in text) else [])


def features(text: str, span: Span) -> list[float]:
    """Format of the span and the context around it."""
    body, before, after = text[span.start : span.end], text[max(0, span.start - 24) : span.start].lower(), text[span.end : span.end + 12].lower()
    n = len(body)
    digits, letters = sum(c.isdigit() for c in body), sum(c.isalpha() for c in body)
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(body, body[1:]))
    counts = np.unique(list(body), return_counts=True)[1] / n
    bare = re.sub("[^0-9]", "", body)
    return [
        *(float(span.kind == k) for k in ADDED),
        n, digits / n, letters / n, sum(c in "0123456789abcdefABCDEF" for c in body) / n, sum(c.isupper() for c in body) / n,
        switches / n, len(counts) / n, float(-(counts * np.log2(counts)).sum()), float(len(bare)), float(len(bare) > 11 and luhn(bare)),
        float(sum(not c.isalnum() for c in body)), float("(" in body or "[" in body), float(body.count(".")), float(body.count("_") + body.count("-")),
        sum(c in "aeiouAEIOU" for c in body) / n, float(body[:1] == "0"), float(span.kind == "contact" and re.split("[^A-Za-z]+", body)[-1].lower() in TOP_LEVEL), float(before[-1:] in ('"', "'", "=", ":")),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(before[-1:].isalnum() or before[-1:] in "/.-_@" and before != ""),
        float(after[:1].isalnum() or after[:1] in "/_@" and after != ""), float(after[:1] in ('"', "'")),
        *(float(any(w in before for w in words)) for words in HINTS.values()),
    ]


def example_text(draw: np.random.Generator) -> tuple[str, list[Span]]:
    """A made-up text with private spans and look-alikes, and the spans that are private."""
    pick = lambda of: of[int(draw.integers(len(of)))]
    chars = lambda of, n: "".join(pick(of) for _ in range(n))
    number = lambda n: chars("0123456789", n)
    word = lambda: "".join(pick(("the", "ou", "ment", "ing", "er", "cion", "lich", "que", "an", "st", "re", "bo")) for _ in range(int(draw.integers(1, 4))))
    hexa, mixed = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    parts, spans, at = [], [], 0

    def add(text: str, kind: str | None = None) -> None:
        nonlocal at
        if kind:
            spans.append(Span(kind, at, at + len(text)))
        parts.append(text)
        at += len(text)

    upper = draw.random() < 0.15
    case = (lambda s: s.upper()) if upper else (lambda s: s)
    for _ in range(int(draw.integers(3, 9))):
        for _ in range(int(draw.integers(1, 7))):
            add(case(word()) + pick((" ", " ", " ", ", ", ". ", "\n", "!! ", "### ")))
        quote = pick(('"', '"', "'", ""))
        what = int(draw.integers(21))
        if what < 3:
            add(case(pick(("token", "api_key", "secret", "password", "auth key"))) + pick((" = ", "=", ": ", " is ")) + quote)
            add(case(pick((chars(hexa, int(pick((32, 40, 64)))), chars(mixed, int(draw.integers(20, 48)))))), "secret")
            add(quote)
        elif what == 3:
            add(pick(("sk-", "key_", "tk_")) + chars(mixed, int(draw.integers(24, 40))), "secret")
        elif what == 4:
            add(case(pick(("commit ", "sha ", "build "))) + chars(hexa, 40))
        elif what == 5:
            add(f"http://{word()}.example/" + chars(mixed, int(draw.integers(16, 30))))
        elif what == 6:
            add("".join(word() for _ in range(int(draw.integers(4, 8)))))
        elif what == 7:
            add(word() + pick((" (at) ", "[at]", " at ")) + word() + pick((" (dot) ", "[dot]", " dot ")) + pick(("com", "org", "net", "de", "io", "fr", "es")), "contact")
        elif what == 8:
            add(f"{word()} at the {word()} " if draw.random() < 0.5 else f"{word()} at {pick(('', 'the '))}{word()} dot {word()} ")
        elif what == 9:
            add(case(pick(("phone ", "call ", "tel: ", "mobile "))))
            add(f"(0{number(2)}) {number(3)}-{number(4)}" if draw.random() < 0.5 else f"0{number(3)} {number(3)}{number(4)}", "contact")
        elif what == 10:
            add(case(pick(("order ", "page ", "figure ", "build "))) + f"0{number(3)}-{number(4)}{number(3)}")
        elif what == 11:
            add(case(pick(("account ", "iban ", "bank ", ""))))
            add(chars("ABCDEFGH", 2) + number(2) + "".join(" " + number(4) for _ in range(int(draw.integers(3, 6)))), "account")
        elif what == 12:
            add(case(pick(("account no ", "card ", "konto "))))
            add(number(int(draw.integers(12, 17))), "account")
        elif what == 13:
            add(case(pick(("order ", "isbn ", "article ", "", ""))) + number(int(draw.integers(12, 15))))
        elif what == 14:
            add(case(pick(("ssn ", "social security ", "passport ", "identity "))))
            add(f"{number(3)}-{number(2)}-{number(4)}" if draw.random() < 0.6 else chars("ABCDEFGH", 2) + number(7), "identity")
        elif what == 15:
            add(case(pick(("version ", "build ", "order ", "part no ", "article "))) + pick(("A", "BX", "C", "K")) + number(int(draw.integers(6, 10))))
        elif what == 16:
            add(case(pick(("passport no ", "passport: ", "passport number ", "identity no ", "id no "))))
            add(chars("ABCDEFGHKLMNPRX", int(draw.integers(1, 3))) + number(int(draw.integers(6, 10))), "identity")
        elif what == 17:
            add(case(pick(("token ", "auth: ", "bearer ", "session ", ""))) + quote)
            add("eyJ" + chars(mixed, int(draw.integers(14, 34))) + "." + chars(mixed + "_-", int(draw.integers(20, 90))) + "." + chars(mixed + "_-", int(draw.integers(20, 44))), "secret")
            add(quote)
        elif what == 18:  # the name of a setting, not its value
            add("_".join(pick(("aws", "access", "key", "id", "secret", "token", "user", "max", "name", "client", "region", "default", "path")) for _ in range(int(draw.integers(3, 6)))) + pick((" = ", "=", ": ", " is set ")))
        elif what == 19:
            add(case(pick(("phone ", "call ", "tel: ", "mobile ", "fax ", "contact "))))
            first, sign = pick("23456789") + number(2), pick(("-", ".", " "))
            add(f"({first}) {number(3)}-{number(4)}" if draw.random() < 0.3 else f"{first}{sign}{number(3)}{sign}{number(4)}", "contact")
        else:
            add(case(pick(("order ", "page ", "figure ", "build ", "part no ", "isbn "))) + f"{pick('23456789')}{number(2)}-{number(3)}-{number(4)}")
        add(pick((" ", ". ", "\n", "!! ", "### ", "%%% ")))
    return "".join(parts), spans


class Detector:
    """Fitted trees, calibration and thresholds; ``parts`` is what the executors get."""

    def __init__(self, trees: boosting.Trees, slope: float, offset: float, cuts: dict[str, float]):
        self.trees, self.slope, self.offset, self.cuts = trees, slope, offset, cuts

    @classmethod
    def fit(cls, texts: int = TRAINING_TEXTS, precision: float = PRECISION, seed: int = 11) -> Detector:
        """The same arguments always give the same detector, fitted once a process."""
        return _fitted(cls, texts, precision, seed)

    @classmethod
    def fit_anew(cls, texts: int, precision: float, seed: int) -> Detector:
        draw = np.random.default_rng(seed)
        rows, y, kinds, held = [], [], [], []
        for k in range(texts):
            text, private = example_text(draw)
            for span in candidates(text):
                rows.append(features(text, span))
                y.append(any(span.kind == p.kind and span.start < p.end and p.start < span.end and min(span.end, p.end) - max(span.start, p.start) >= 0.8 * max(span.end - span.start, p.end - p.start) for p in private))
                kinds.append(span.kind)
                held.append(k % 4 == 0)
        x, y, kinds, held = np.array(rows), np.array(y, dtype=float), np.array(kinds), np.array(held)
        trees = boosting.fit(x[~held], y[~held])
        margin = trees.margin(x[held])
        slope, offset = boosting.platt(margin, y[held])
        sure = 1 / (1 + np.exp(-(slope * margin + offset)))
        cuts = {k: max(0.5, boosting.threshold(sure[kinds[held] == k], y[held][kinds[held] == k], precision)) for k in ADDED}
        return cls(trees, slope, offset, cuts)

    def parts(self) -> tuple:
        return self.trees.parts(), self.slope, self.offset, self.cuts

    @classmethod
    def of(cls, parts: tuple) -> Detector:
        return cls(boosting.Trees(*parts[0]), *parts[1:])

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and the added ones: the most probable of overlapping spans, none that overlaps a base span."""
        base, proposed = base_spans(text), candidates(text)
        if not proposed:
            return base, []
        sure = 1 / (1 + np.exp(-(self.slope * self.trees.margin(np.array([features(text, s) for s in proposed])) + self.offset)))
        passed = sorted((-p, s.start, s.kind, s) for p, s in zip(sure, proposed) if p >= self.cuts[s.kind])
        starts, ends, added = [], [], []  # of what is taken: disjoint and in order
        for span in sorted(base, key=lambda s: s.start):
            if ends and span.start < ends[-1]:  # base kinds may overlap one another
                ends[-1] = max(ends[-1], span.end)
            else:
                starts.append(span.start)
                ends.append(span.end)
        for _, _, _, span in passed:
            at = bisect_right(starts, span.start)
            if (at == 0 or ends[at - 1] <= span.start) and (at == len(starts) or span.end <= starts[at]):
                starts.insert(at, span.start)
                ends.insert(at, span.end)
                added.append(span)
        return base, sorted(added, key=lambda s: (ADDED.index(s.kind), s.start))


@cache
def _fitted(kind: type[Detector], texts: int, precision: float, seed: int) -> Detector:
    return kind.fit_anew(texts, precision, seed)


SPAN_TYPE = "array<struct<kind: string, start: long, end: long>>"


def find_spans(docs: DataFrame, detector: Detector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and added spans of each row, each by kind and start."""
    shared = docs.sparkSession.sparkContext.broadcast(detector.parts())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Detector.of(shared.value)
        for batch in batches:
            both = [own.spans(t.as_py() or "") for t in batch.column(1)]
            columns = [pa.array([[vars(s) for s in pair[i]] for pair in both], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "base", "added"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id long, base {SPAN_TYPE}, added {SPAN_TYPE}").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, detector: Detector, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in brackets; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(detector.parts())

    def clean(own: Detector, text: str) -> str:
        base, added = own.spans(text)
        out, at = [], 0
        for span in sorted([*base, *added], key=lambda s: (s.start, -s.end)):
            if span.end > at:  # base kinds may overlap one another: what is covered goes, once
                if span.start >= at:
                    out.append(text[at : span.start] + f"[{span.kind.upper()}]")
                at = span.end
        return "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Detector.of(shared.value)
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            texts = [None if t is None else clean(own, t) for t in batch.column(k).to_pylist()]
            yield batch.set_column(k, text_col, pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)
