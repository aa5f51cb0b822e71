"""SentencePiece encoding and decoding by suffix-array matching, for BPE models with byte fallback.

Pieces never reach over the end of a word (white space marks, then other characters), so a batch's distinct words are
encoded once each. Their concatenation is indexed by a suffix array over as many characters as the longest piece has;
a binary search per piece gives the range of suffixes that begin with it, and so its edges (start, piece). The edges,
sorted by position, are relaxed from the left: a piece extends the encoding of what stands before it if the two pieces
stay apart when merged by rank. For byte-pair models exactly one piece does so at each position, and the path is the
encoding that the merges give; a word for which none reaches the end is merged step by step.

Defined results: null and empty texts have no ids. Characters outside the vocabulary become their UTF-8 byte pieces.
Decoding gives the text back, except that a "▁" in a text comes back as a space. Texts are read whole. Rows that
repeat an id are encoded each. Only id and text are read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
GROUP_CHARS = 4_000_000


class Pieces:
    """The vocabulary of a model; ids from ``size`` on stand for single characters that aren't in it."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.size = model.get_piece_size()
        plain = [i for i in range(self.size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.text = {i: model.id_to_piece(i) for i in plain}
        self.id = {t: i for i, t in self.text.items()}
        self.score = {t: model.get_score(i) for t, i in self.id.items()}
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(self.size) if model.is_byte(i)}
        self.bytes = [b""] * self.size
        for t, i in self.id.items():
            self.bytes[i] = t.replace(MARK, " ").encode()
        for b, i in self.byte.items():
            self.bytes[i] = bytes([b])
        self.ids = np.array(plain, dtype=np.int64)
        self.lengths = np.array([len(self.text[i]) for i in plain], dtype=np.int64)
        self.longest = int(self.lengths.max())
        self.codes = np.zeros((len(plain), self.longest), dtype=np.int64)
        for row, i in enumerate(plain):
            self.codes[row, : self.lengths[row]] = list(map(ord, self.text[i]))

    def merges(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """The pieces of a text by merging the best pair, the leftmost of equals, until none is in the vocabulary; and
        of every merge its score and the outer parts after it."""
        n, score, steps = len(text), self.score, [(0.0, text[:1], text[-1:])]
        part: list[str | None] = list(text)  # None where a part has been merged into the one before
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def propose(k: int) -> None:
            if k >= 0 and after[k] < n:
                both = part[k] + part[after[k]]
                if both in score:
                    heapq.heappush(heap, (-score[both], k, both))

        for k in range(n):
            propose(k)
        last = n - 1
        while heap:
            s, k, both = heapq.heappop(heap)
            if part[k] is None or after[k] >= n or part[k] + part[after[k]] != both:
                continue  # one of the two has been merged since
            gone = after[k]
            part[k], part[gone], after[k] = both, None, after[gone]
            if after[k] < n:
                before[after[k]] = k
            else:
                last = k
            steps.append((-s, part[0], part[last]))
            propose(before[k])
            propose(k)
        return [p for p in part if p is not None], steps

    def of(self, piece: int) -> str:
        return self.text[piece] if piece < self.size else chr(piece - self.size)

    def id_or_own(self, text: str) -> int:
        return self.id[text] if text in self.id else self.size + ord(text)

    def expand(self, pieces: Iterator[int]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            out += [p] if p < self.size else [self.byte[b] for b in chr(p - self.size).encode("utf-8", "surrogatepass")]
        return out


class Neighbours:
    """Which pairs of pieces stay apart; sorted keys, so that a batch of pairs is looked up at once. At most ``MOST`` are kept."""

    SPAN, MOST = 1 << 22, 4_000_000

    def __init__(self, pieces: Pieces):
        self.pieces, self.keys, self.apart = pieces, np.zeros(0, np.int64), np.zeros(0, bool)
        self.steps: dict[int, list | None] = {}

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self.SPAN + right
        unique, back = np.unique(wanted, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        known = (at < len(self.keys)) & (self.keys[np.minimum(at, max(len(self.keys) - 1, 0))] == unique) if len(self.keys) else np.zeros(len(unique), bool)
        apart = np.empty(len(unique), bool)
        apart[known] = self.apart[at[known]]
        if not known.all():
            new = unique[~known]
            apart[~known] = fresh = np.fromiter((self._apart(*divmod(k, self.SPAN)) for k in new.tolist()), dtype=bool, count=len(new))
            if len(self.keys) + len(new) > self.MOST:
                self.keys, self.apart = unique, apart
            else:
                self.keys, self.apart = np.insert(self.keys, at[~known], new), np.insert(self.apart, at[~known], fresh)
        return apart[back]

    def _steps(self, piece: int) -> list | None:
        if piece not in self.steps:
            if len(self.steps) > self.MOST // 8:
                self.steps.clear()
            parts, steps = self.pieces.merges(self.pieces.of(piece))
            self.steps[piece] = steps if len(parts) == 1 else None
        return self.steps[piece]

    def _apart(self, left: int, right: int) -> bool:
        """Whether the merges of the two pieces are all done before one over their border is the best."""
        a, b = self._steps(left), self._steps(right)
        if a is None or b is None:
            return False
        i = j = 0
        score = self.pieces.score
        while True:
            over = score.get(a[i][2] + b[j][1], -np.inf)
            of_a = a[i + 1][0] if i + 1 < len(a) else -np.inf
            of_b = b[j + 1][0] if j + 1 < len(b) else -np.inf
            if over > of_a and over >= of_b:
                return False
            if of_a == of_b == -np.inf:
                return True
            if of_a >= of_b:
                i += 1
            else:
                j += 1


class Encoder:
    """Encodes words of a batch and keeps them while there is room (``most`` bytes, about)."""

    def __init__(self, model_path: str, most: int = 256 << 20):
        self.pieces = Pieces(model_path)
        self.apart = Neighbours(self.pieces)
        self.known: dict[str, bytes] = {}
        self.most, self.held = most, 0

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, piece and length of every occurrence of a piece in ``codes`` (0 parts words)."""
        pieces = self.pieces
        alphabet, dense = np.unique(codes, return_inverse=True)  # 0 stays 0
        bits = max(1, int(len(alphabet) - 1).bit_length())
        per = min(pieces.longest, 62 // bits)
        levels = -(-pieces.longest // per)
        padded = np.concatenate((dense, np.zeros(levels * per, dense.dtype))).astype(np.int64)
        n = len(codes)

        def packed(of: np.ndarray) -> np.ndarray:
            key = np.zeros(of.shape[:-1], dtype=np.int64)
            for j in range(per):
                key = key << bits | of[..., j]
            return key

        one = np.zeros(n + (levels - 1) * per, dtype=np.int64)
        for j in range(per):
            one = one << bits | padded[j : j + len(one)]
        keys = [one[k * per : k * per + n] for k in range(levels)]
        suffixes = np.lexsort(keys[::-1])
        keys = [k[suffixes] for k in keys]
        place = np.searchsorted(alphabet, pieces.codes)
        fits = (alphabet[np.minimum(place, len(alphabet) - 1)] == pieces.codes).all(1)
        rows = np.nonzero(fits)[0]
        code = np.zeros((len(rows), levels * per), dtype=np.int64)
        code[:, : pieces.longest] = place[rows]
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), n, np.int64)
        for k in range(levels):
            inside = np.clip(pieces.lengths[rows] - k * per, 0, per)
            least = packed(code[:, k * per : (k + 1) * per])
            most = least + (np.int64(1) << (bits * (per - inside)))
            open_ = np.nonzero((inside > 0) & (high > low))[0]
            if k == 0:
                low[open_], high[open_] = np.searchsorted(keys[0], least[open_]), np.searchsorted(keys[0], most[open_])
            else:
                for r in open_.tolist():
                    part = keys[k][low[r] : high[r]]
                    low[r], high[r] = low[r] + np.searchsorted(part, least[r]), low[r] + np.searchsorted(part, most[r])
        counts = np.maximum(high - low, 0)
        first = np.repeat(low - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
        start = suffixes[first + np.arange(counts.sum())]
        of = np.repeat(rows, counts)
        start, piece, length = start, pieces.ids[of], pieces.lengths[of]
        single = np.zeros(n, bool)
        single[start[length == 1]] = True
        own = np.nonzero(~single & (codes > 0))[0]
        return np.concatenate((start, own)), np.concatenate((piece, pieces.size + codes[own])), np.concatenate((length, np.ones(len(own), np.int64)))

    def learn(self, words: list[str]) -> None:
        """Encode words that aren't known yet."""
        pieces = self.pieces
        codes = np.frombuffer(("\0".join(w.replace("\0", "\U0010ffff") for w in words) + "\0").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        n = len(codes)
        ends = np.nonzero(codes == 0)[0]
        begins = np.concatenate(([0], ends[:-1] + 1))
        start, piece, length = self._edges(codes)
        offset = start - np.repeat(begins, ends - begins + 1)[start]
        order = np.argsort(offset, kind="stable")
        start, piece, length, offset = start[order], piece[order], length[order], offset[order]
        last, before = np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int64)
        bounds = np.searchsorted(offset, np.arange(int(offset[-1]) + 2)) if len(offset) else [0]
        for a, b in zip(bounds[:-1], bounds[1:]):
            s, p, end = start[a:b], piece[a:b], start[a:b] + length[a:b]
            if offset[a] == 0:
                good = np.ones(len(s), bool)
            else:
                reached = np.nonzero(last[s] >= 0)[0]
                good = np.zeros(len(s), bool)
                good[reached] = self.apart(last[s[reached]], p[reached])
            last[end[good]], before[end[good]] = p[good], s[good]
        path, at, lows = np.zeros(n + 1, bool), ends.copy(), begins.copy()
        whole = last[ends] >= 0
        at, lows = at[whole], lows[whole]
        while len(at):
            path[at] = True
            at = before[at]
            more = at > lows
            at, lows = at[more], lows[more]
        found = np.nonzero(path)[0]
        ids = last[found]
        cuts = np.searchsorted(found, begins, side="right")
        raw, own = ids.astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(ids >= pieces.size))).tolist()
        for word, a, b, complete in zip(words, cuts.tolist(), np.searchsorted(found, ends, side="right").tolist(), whole.tolist()):
            if not complete or "\0" in word:
                self.known[word] = np.array(pieces.expand(map(pieces.id_or_own, pieces.merges(word)[0])), dtype="<u4").tobytes()
            elif own[a] == own[b]:
                self.known[word] = raw[4 * a : 4 * b]
            else:
                self.known[word] = np.array(pieces.expand(ids[a:b].tolist()), dtype="<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        split = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = {w for words in split for w in words if w not in self.known}
        size = sum(map(len, new)) * 8 + len(new) * 200  # a character and its id, and what an entry takes
        if self.held + size > self.most:
            self.known.clear()
            self.held = 0
            new = {w for words in split for w in words}
            size = sum(map(len, new)) * 8 + len(new) * 200
        self.held += size
        if new:
            self.learn(sorted(new))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.pieces.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decode_too: bool = False) -> DataFrame:
    """id and ids (little-endian unsigned 32-bit numbers) of each row; with ``decode_too`` the text decoded from them."""
    fields = "id long, ids binary" + ", decoded string" * decode_too

    def groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
        first = size = 0
        for i, t in enumerate(texts):
            if i > first and size + len(t or "") > GROUP_CHARS:
                yield first, i
                first, size = i, 0
            size += len(t or "")
        if first < len(texts):
            yield first, len(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups(texts):
                ids = encoder.encode(texts[a:b])
                columns = [batch.column(0).slice(a, b - a), pa.array(ids, pa.binary())]
                if decode_too:
                    columns.append(pa.array([encoder.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in fields.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, fields).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of each row of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encoder.decode(x or b"") for x in batch.column(1).to_pylist()], pa.string())], ["id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
