"""Secrets by fixed patterns and by a battery of randomness tests.

Three base kinds (assign, access, hex) are fixed patterns with a check and always stay. Beyond them every token of
``SHORTEST`` or more ASCII letters, digits and signs that no base span touches is tested: its encoding is the smallest of
``ENCODINGS`` that has all its characters, and under that alphabet a chi-squared test of even use, tests of the runs of
small letters, capitals, digits and signs and of those of vowels, and one of serial correlation are joined by Fisher's method into the chance that random characters
look as little random as the token does.

Which chance is good enough is settled by false-discovery control, for each stratum of lengths by itself, as the tests
can tell far less from a short token than from a long one. Names put together from the corpus' own words (in lower case,
camel case, with signs between, with a number at the end), one from each ``STRIDE`` words of every document, say how
often what isn't a secret gets so high a chance; the cut of a stratum is the lowest chance at which at most ``FALSE`` of
the tokens above it are expected to be such names. Both counts cover all documents, and only they (strata times bins)
come to the driver.

Defined results: a null text counts as empty and has no spans. Offsets are code points, the end is exclusive. Tokens of
digits only are never added. Texts are read whole; rows that repeat an id are scanned each by itself; only id and text
are read. In a corpus too small to vouch for a stratum nothing is added there.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.session import Scratch

# Fixed patterns of the base kinds. Letters of the assigned names are matched in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of fewer can't pass
BASE = ("assign", "access", "hex")
ADDED = "random"

SHORTEST, STRIDE, FALSE = 16, 50, 0.05
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Least lengths of the strata.
LENGTHS = (16, 20, 24, 32, 40, 64)
BINS = 96

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets from small to large, each in the order of its values.
ENCODINGS = {
    "decimal": DIGITS, "hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "lower": LOWER, "upper": UPPER, "base32": UPPER + "234567", "lower36": DIGITS + LOWER,
    "upper36": DIGITS + UPPER, "letters": UPPER + LOWER, "base62": UPPER + LOWER + DIGITS, "base64": UPPER + LOWER + DIGITS + "+/", "base64url": UPPER + LOWER + DIGITS + "-_",
    "any": UPPER + LOWER + DIGITS + "+/-_",
}
NAMES = tuple(ENCODINGS)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """By byte the encodings that have it; by encoding and byte the value; by encoding the size; and two ways to part the
    characters, each by byte the class and by encoding the shares of the classes: small, capital, digit, sign; vowel, other.
    """
    admits, value, size = np.zeros(256, np.int64), np.zeros((len(NAMES), 256), np.int64), np.array([len(a) for a in ENCODINGS.values()], float)
    kinds = [lambda c: 2 if c in DIGITS else 3 if not c.isalpha() else int(c in UPPER), lambda c: int(c in "aeiouAEIOU")]
    parted = [(np.zeros(256, np.int64), np.zeros((len(NAMES), 4))) for _ in kinds]
    for e, alphabet in enumerate(ENCODINGS.values()):
        for v, c in enumerate(alphabet):
            admits[ord(c)] |= 1 << e
            value[e, ord(c)] = v
            for kind, (of, shares) in zip(kinds, parted):
                of[ord(c)] = kind(c)
                shares[e, kind(c)] += 1 / len(alphabet)
    return admits, value, size, parted


ADMITS, VALUE, SIZE, PARTED = _tables()


def _above(z: np.ndarray) -> np.ndarray:
    """Upper tail of the standard normal (Abramowitz and Stegun 26.2.17), for either sign."""
    x = np.minimum(np.abs(z), 37.0)
    t = 1 / (1 + 0.2316419 * x)
    tail = np.exp(-x * x / 2) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z < 0, 1 - tail, tail)


def battery(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of tokens of ``SHORTEST`` or more characters the number of the encoding, and the chance that random ones deviate as much."""
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0)
    n = np.array([len(t) for t in tokens])
    start = np.cumsum(n) - n
    flat = np.frombuffer("".join(tokens).encode("ascii"), np.uint8)
    fits = np.bitwise_and.reduceat(ADMITS[flat], start)
    enc = np.log2(fits & -fits).astype(np.int64)
    owner = np.repeat(np.arange(len(tokens)), n)
    value = VALUE[enc[owner], flat]

    # even use of the alphabet: X^2, by its own first two moments brought to a normal variable by cube roots
    used = np.bincount(owner * 128 + value, minlength=len(tokens) * 128).reshape(-1, 128)
    free = SIZE[enc] - 1
    square = SIZE[enc] / n * (used.astype(float) ** 2).sum(1) - n
    k = free * n / (n - 1)
    uneven = _above((np.cbrt(square / free) - (1 - 2 / (9 * k))) / np.sqrt(2 / (9 * k)))

    # runs of classes: changes between neighbours, against independent draws with the alphabet's shares
    inner = owner[1:] == owner[:-1]
    chances, tests = [uneven], np.full(len(tokens), 2)
    for of, shares in PARTED:
        changes = np.bincount(owner[1:][inner & (of[flat[1:]] != of[flat[:-1]])], minlength=len(tokens))
        share = shares[enc]
        s = 1 - (share**2).sum(1)
        spread = (n - 1) * s * (1 - s) + 2 * (n - 2) * ((share * (1 - share) ** 2).sum(1) - s * s)
        some = spread > 1e-9  # an alphabet of one class has no such test
        off = np.abs(changes - (n - 1) * s) / np.sqrt(np.maximum(spread, 1e-9))
        chances.append(np.where(some, np.minimum(1, 2 * _above(off)), 1.0))
        tests += some

    # serial correlation of the values of neighbours
    centred = value - (np.bincount(owner, value) / n)[owner]
    power = np.bincount(owner, centred**2)
    product = np.bincount(owner[1:][inner], (centred[1:] * centred[:-1])[inner], minlength=len(tokens))
    r = np.where(power > 0, product / np.maximum(power, 1e-9), 1.0)
    serial = np.minimum(1, 2 * _above(np.abs(r + 1 / n) * np.sqrt(n)))

    half = -np.log(np.maximum([*chances, serial], 1e-30)).sum(0)  # Fisher: chi-squared with two degrees of freedom a test
    terms = np.cumsum([np.ones(len(tokens)), half, half**2 / 2, half**3 / 6], axis=0)
    return enc, np.exp(-half) * terms[tests - 1, np.arange(len(tokens))]


def binned(length: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Stratum times ``BINS`` plus the bin of the chance: bin 0 is the most random, two bins halve the chance."""
    stratum = np.searchsorted(LENGTHS, length, side="right") - 1
    return stratum * BINS + np.minimum(np.floor(-2 * np.log2(np.maximum(chance, 1e-300))), BINS - 1).astype(np.int64)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of the fixed patterns that pass their check, by start and kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], BASE.index(s[0])))


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Tokens that touch no base span."""
    starts, ends = [], []
    for _, start, end in base:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    found = []
    for m in TOKEN.finditer(text):
        at = bisect_right(starts, m.end() - 1)
        if not at or ends[at - 1] <= m.start():
            found.append(m.span())
    return found


def made_names(text: str) -> list[str]:
    """Names put together from words of the text: what may look random and is none. One from each ``STRIDE`` words."""
    words, names = text.split(), []
    for k, at in enumerate(range(0, len(words), STRIDE), len(text)):  # styles and lengths take turns, beginning anywhere
        style, want = k % 7, LENGTHS[k // 7 % len(LENGTHS)] + k % 4
        parts, length = [], 0
        for word in words[at : at + STRIDE]:
            if word.isascii() and word.isalpha():
                parts.append(word)
                length += len(word) + (style > 2)
                if length >= want:
                    break
        if style in (0, 6):
            name = "".join(parts).lower() if style == 0 else "".join(parts).lower() + str(1900 + (7 * k + len(words)) % 150)
        elif style == 1:
            name = "".join(p.capitalize() for p in parts)
        elif style == 2:
            name = "".join(p.capitalize() if i else p.lower() for i, p in enumerate(parts)) + str(k % 10)
        else:
            name = "_-/"[style - 3].join(parts if style == 3 else [p.lower() for p in parts])
        if len(name) >= SHORTEST:
            names.append(name[-want:] if style in (2, 6) else name[:want])
    return [n for n in names if len(n) >= SHORTEST]


def cuts(tokens: dict[int, int], names: dict[int, int]) -> list[int]:
    """By stratum the last bin that counts as random, -1 for none. Both arguments: number of rows by stratum and bin."""
    found = []
    for stratum in range(len(LENGTHS)):
        bins = range(stratum * BINS, (stratum + 1) * BINS)
        total, others = sum(tokens.get(b, 0) for b in bins), sum(names.get(b, 0) for b in bins)
        passed = others_passed = 0
        cut = -1
        for k, b in enumerate(bins):
            passed, others_passed = passed + tokens.get(b, 0), others_passed + names.get(b, 0)
            if tokens.get(b, 0) and total * (others_passed + 1) / (others + 1) <= FALSE * passed:
                cut = k
        found.append(cut)
    return found


SPANS = "array<struct<kind: string, start: long, end: long>>"
SCANNED = f"id long, base {SPANS}, tokens array<struct<start: long, end: long, encoding: string, cell: int>>, names array<int>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    tokens = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("cell", pa.int32())]))
    for batch in batches:
        texts = [t.as_py() or "" for t in batch.column(1)]
        base = [base_spans(t) for t in texts]
        found = [candidates(t, b) for t, b in zip(texts, base)]
        names = [made_names(t) for t in texts]
        enc, chance = battery([text[a:b].rstrip("=") for text, of in zip(texts, found) for a, b in of])
        cell = iter(zip(enc.tolist(), binned(np.array([b - a for of in found for a, b in of]), chance).tolist()))
        rows = [[{"start": a, "end": b, "encoding": NAMES[e], "cell": c} for (a, b), (e, c) in ((span, next(cell)) for span in of) if NAMES[e] != "decimal"] for of in found]
        whole = [name for of in names for name in of]
        place = binned(np.array([len(n) for n in whole], int), battery(whole)[1]).astype(np.int32)
        ends = np.r_[0, np.cumsum([len(of) for of in names])].astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([[dict(zip(("kind", "start", "end"), s)) for s in of] for of in base], spans), pa.array(rows, tokens), pa.ListArray.from_arrays(ends, pa.array(place))],
            ["id", "base", "tokens", "names"],
        )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base (by start and kind) and added (kind ``random``, by start; with the encoding) of each row."""
    scratch = Scratch(docs.sparkSession, "secret-scan")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scanned = scratch.write(rows.mapInArrow(_scan, SCANNED), "scanned")

    def counted(cells) -> dict[int, int]:
        return {r.cell: r["count"] for r in scanned.select(F.explode(cells).alias("cell")).groupBy("cell").count().collect()}  # strata * bins rows at most

    last = F.array(*(F.lit(c) for c in cuts(counted(F.transform("tokens", lambda t: t.cell)), counted(F.col("names")))))
    random = F.filter("tokens", lambda t: t.cell % BINS <= F.get(last, (t.cell / BINS).cast("int")))
    added = F.transform(random, lambda t: F.struct(F.lit(ADDED).alias("kind"), t.start.alias("start"), t.end.alias("end"), t.encoding.alias("encoding")))
    return scanned.select(F.col("id").alias(id_col), "base", added.alias("added"))
