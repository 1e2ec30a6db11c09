"""Token counts of a byte-level BPE vocabulary by a compiled finite-state transducer.

The pre-tokenizer's pattern only looks a few characters around a place, so the
pieces that it cuts are found on whole arrays of character classes. Inside a
piece, the BPE encoding of a prefix ends in one certain token, and which one it
is for the next longer prefix depends only on the longest suffix that some
token of the vocabulary begins with and on the last tokens of the prefixes
within that suffix. That is the state of a deterministic transducer; each
transition carries the change in the number of tokens. States and transitions
are compiled when they are first met and kept by the worker.

At every piece's start the transducer is in its start state, so pieces are
chunks whose state maps are sums, and a text's count is a difference of their
prefix sums. Pieces longer than CHUNK bytes are cut further. A chunk's map is
compiled for the states that the bytes before it lead to, and neighbours' maps are
composed pair by pair, level by level, as in the up-sweep of a parallel prefix scan; the
pairs of a level don't depend on one another. Where a composition meets a state that a
map lacks, the map is extended.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrove.llm import textvec as tv

LIMIT = 512
CHUNK = 64
#: What a worker keeps at most: counts of pieces, transitions, chunk maps. Beyond it starts anew.
KEPT_PIECES, KEPT_TRANSITIONS = 400_000, 1_500_000

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable
    Latin-1 ones for themselves, the others in order from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    """Counts BPE tokens of byte strings, one transition for each byte."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_of_character()
        code = lambda t: bytes(to_byte[c] for c in t)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(code(a), code(b)): k for k, (a, b) in enumerate(pairs)}
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        added = set(self.special)
        self.tokens = {code(t) for t in spec["model"]["vocab"] if t not in added}
        self.begins = {t[:k] for t in self.tokens for k in range(1, len(t) + 1)}
        self.allowed: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        # a state: the suffix that may go on as a token, and for each prefix's end within it (the suffix's
        # start first) the last token and the number of tokens less than at the state's own end
        self.states: list[tuple[bytes, tuple]] = [(b"", ((b"", 0),))]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}
        self.maps: dict[tuple[int, bytes], tuple[int, int]] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """The BPE encoding by its definition: the first best-ranked pair is merged until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def adjacent(self, a: bytes, b: bytes) -> bool:
        """Whether b can follow a in an encoding."""
        key = (a, b)
        if key not in self.allowed:
            if len(self.allowed) > KEPT_TRANSITIONS:
                self.allowed.clear()
            self.allowed[key] = self.merged(a + b) == [a, b]
        return self.allowed[key]

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        suffix, ends = self.states[state]
        suffix += bytes((byte,))
        whole = ends[0][0] == b""  # the suffix begins where the piece does
        for k in range(len(suffix)):  # the longest token first
            token = suffix[k:]
            if token in self.tokens and ((k == 0 and whole) or self.adjacent(ends[k][0], token)) and not (k == 0 and whole and self.merged(token) != [token]):
                count = ends[k][1] + 1
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        ends = (*ends, (token, count))
        drop = 0
        while drop < len(suffix) and suffix[drop:] not in self.begins:
            drop += 1
        key = (suffix[drop:], tuple((t, c - count) for t, c in ends[drop:]))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        move = (self.number[key], count)
        self.moves[state << 8 | byte] = move
        return move

    def run(self, data: bytes, state: int = 0) -> tuple[int, int]:
        """The state after data and the tokens more than before."""
        total = 0
        moves = self.moves
        for byte in data:
            move = moves.get(state << 8 | byte) or self.compile(state, byte)
            state = move[0]
            total += move[1]
        return state, total

    def count(self, piece: bytes) -> int:
        if len(self.moves) > KEPT_TRANSITIONS:
            self.reset()
        if len(piece) <= CHUNK:
            return self.run(piece)[1]
        return self.scan([piece[k : k + CHUNK] for k in range(0, len(piece), CHUNK)])[1]

    def chunk_map(self, chunk: bytes, state: int) -> tuple[int, int]:
        """What the chunk's map gives for an entry state."""
        key = (state, chunk)
        if key not in self.maps:
            if len(self.maps) > KEPT_PIECES // 8:
                self.maps.clear()
            self.maps[key] = self.run(chunk, state)
        return self.maps[key]

    def scan(self, chunks: list[bytes]) -> tuple[int, int]:
        """The state after all chunks from the start state, and the tokens more: maps composed in a balanced tree."""
        level: list[Span] = []
        before = 0
        for k, c in enumerate(chunks):
            level.append(Span(self, c, None, None, {before: self.chunk_map(c, before)}))
            before = self.chunk_map(c, 0)[0]  # where the bytes before lead to if a piece began with them
        while len(level) > 1:
            level = [level[k].then(level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0].at(0)


class Span:
    """The state map of consecutive chunks, for the entry states met so far: entry to (exit, tokens more)."""

    def __init__(self, machine: Transducer, chunk: bytes | None, left: Span | None, right: Span | None, table: dict[int, tuple[int, int]]):
        self.machine, self.chunk, self.left, self.right, self.table = machine, chunk, left, right, table

    def at(self, state: int) -> tuple[int, int]:
        if state not in self.table:
            if self.chunk is not None:
                self.table[state] = self.machine.chunk_map(self.chunk, state)
            else:
                middle, one = self.left.at(state)
                end, other = self.right.at(middle)
                self.table[state] = (end, one + other)
        return self.table[state]

    def then(self, other: Span) -> Span:
        """The composition of two neighbours' maps."""
        out = Span(self.machine, None, self, other, {})
        for state in list(self.table):
            out.at(state)
        return out


def character_classes() -> np.ndarray:
    """The class of each code point: letter, number, white space, other."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for pattern, k in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            out[ord(m.group()[0]) : ord(m.group()[-1]) + 1] = k
    return out


class Counter:
    """Counts tokens of texts; one for each vocabulary and worker."""

    made: dict[str, Counter] = {}

    def __init__(self, path: str):
        self.transducer = Transducer(path)
        self.classes = character_classes()
        self.known: dict[bytes, int] = {}

    @classmethod
    def of(cls, path: str) -> Counter:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def starts(self, points: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where pieces start among code points; begins are the texts' first places (ascending, texts not empty)."""
        n = len(points)
        c = self.classes[points]
        first = np.zeros(n + 1, bool)
        first[begins] = True
        first[n] = True
        prev = np.r_[np.uint8(255), c[:-1]]
        prev[first[:n]] = 255
        nxt = np.r_[c[1:], np.uint8(255)]
        nxt[first[1:]] = 255
        blank = c == SPACE
        run = (c != prev) | first[:n]
        # the last of several blanks before something else stands alone or joins it
        last = blank & (nxt != SPACE) & (nxt != 255)
        plain = last & (points == 0x20)
        start = np.where(blank, run | last, run)
        joined = np.r_[False, plain[:-1]]
        start &= ~(joined & ~blank)
        # 's 't 'm 'd 're 've 'll after an apostrophe that is a piece of its own
        quote = np.flatnonzero((points == 0x27) & start & (nxt == LETTER))
        if len(quote):
            at = np.minimum(quote + 1, n - 1)
            one = points[at]
            two = np.where((quote + 2 < n) & ~first[np.minimum(quote + 2, n)], points[np.minimum(quote + 2, n - 1)], 0)
            short = np.isin(one, [ord(x) for x in "stmd"])
            long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            for where, k in ((short, 1), (long, 2)):
                q = quote[where]
                start[q + 1] = False
                after = q + 1 + k
                ok = after < n
                after = after[ok]
                after = after[(c[after] == LETTER) & ~first[after]]
                start[after] = True
        return start

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        parts: list[str] = []
        owner: list[int] = []
        out = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            for x in self._cut(t):
                if x in self.transducer.special:
                    out[k] += 1
                elif x:
                    parts.append(x)
                    owner.append(k)
        if not parts:
            return out
        joined = "".join(parts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.array([len(p) for p in parts])
        begins = np.cumsum(lengths) - lengths
        start = np.flatnonzero(self.starts(points, begins))
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        byte = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=byte[1:])
        data = np.frombuffer(joined.encode(), np.uint8)
        a = byte[start]
        z = np.r_[byte[start[1:]], len(data)]
        h = tv.hashes(tv.Words(a, z, np.array([0, len(a)]), data))
        kinds, one, index = np.unique(h, return_index=True, return_inverse=True)
        if not _alike(data, a, z, one[index]):  # two pieces of one hash: each stands for itself
            one = index = np.arange(len(a))
        n = np.empty(len(one), np.int64)
        known, count, raw = self.known, self.transducer.count, data.tobytes()
        if len(known) > KEPT_PIECES:
            known.clear()
        for k, (i, j) in enumerate(zip(a[one].tolist(), z[one].tolist())):
            x = raw[i:j]
            v = known.get(x)
            if v is None:
                v = count(x)
                if len(x) <= CHUNK:
                    known[x] = v
            n[k] = v
        total = np.zeros(len(start) + 1, np.int64)
        np.cumsum(n[index], out=total[1:])
        edge = np.searchsorted(start, np.r_[begins, len(points)])
        np.add.at(out, owner, total[edge[1:]] - total[edge[:-1]])
        return out

    def _cut(self, text: str) -> list[str]:
        """The text at its special strings, which stay."""
        found = [text]
        for s in self.transducer.special:
            if s in text:
                found = [y for x in found for part in ([x] if x in self.transducer.special else _between(x, s)) for y in [part]]
        return found


def _alike(data: np.ndarray, a: np.ndarray, z: np.ndarray, of: np.ndarray) -> bool:
    """Whether each piece data[a:z] has the bytes of the piece that it is counted as."""
    n = z - a
    if (n != n[of]).any():
        return False
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return bool((data[np.repeat(a, n) + inside] == data[np.repeat(a[of], n) + inside]).all())


def _between(text: str, sep: str) -> list[str]:
    out: list[str] = []
    for k, x in enumerate(text.split(sep)):
        out += [sep, x] if k else [x]
    return out


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    vocabulary is a byte-level BPE file of the tokenizers library, at a path
    that every worker has. Null texts count as empty: no tokens. Special
    strings inside texts are one token each. Extra columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(vocabulary)
        for b in batches:
            ids = b.column("doc_id")
            for s in tv.slices(b.column("text")):
                raw = s.data.tobytes()
                o = s.offsets.tolist()
                n = counter.counts([raw[x:y].decode("utf-8", "replace") for x, y in zip(o, o[1:])])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(s.lo, len(s)), pa.array(np.diff(s.offsets)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
