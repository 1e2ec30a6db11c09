"""SentencePiece encoding and decoding of a merge-type (BPE) model with byte fallback, exactly, by backtracking.

A sequence of tokens is the merge encoding of its text exactly if each token encodes to itself and each two
neighbours, merged anew from their characters, come out as these two again: the first merge that crossed an edge
between tokens would cross it in the pair alone too, as merges elsewhere don't change what is merged around the edge
or in which order. So there is one such sequence, and it is found from left to right: the longest
vocabulary entry at each place (an Aho-Corasick automaton over reversed entries and text gives it for all places in one
run), checked against the token before; if it doesn't fit, its next shorter prefix; if none fits, the place is marked
in a bitfield as failed and the token before it is shortened. A place is reached with one certain token before it (the
encoding of a prefix is unique as well), so a failed place never has to be tried again and the work is linear.

Where no entry crosses from a word to the next space, from letters to other characters or into or out of line ends
(checked over the whole vocabulary when the model is loaded; else coarser units, at last whole texts, are taken), no merge
does either, and texts are encoded by such units; what a unit gives is kept by the worker. Characters that are no entry go
by their bytes. The search runs on numbers: ids, then characters that only longer entries have, then one for all others.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Units and pairs that a worker keeps; beyond it starts anew. Longer units are encoded each time.
KEPT_UNITS, KEPT_LENGTH, KEPT_PAIRS = 400_000, 64, 500_000
ROWS = 256
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

# each byte that is no part of a character is one replacement character
codecs.register_error("veritrove_one_byte", lambda e: ("�", e.start + 1))


class PieceModel:
    """The vocabulary of a model file, its encoder and its decoder."""

    _loaded: dict[str, PieceModel] = {}

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.end, self.unknown = sp.eos_id(), sp.unk_id()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        special = [sp.is_control(i) or sp.is_unknown(i) for i in range(size)]
        of_byte = [sp.is_byte(i) for i in range(size)]
        if any(sp.is_unused(i) for i in range(size)) or sum(of_byte) != 256:
            raise ValueError("a merge-type model with byte fallback and without unused pieces is needed")
        self.score = {p: sp.get_score(i) for i, p in enumerate(self.pieces) if not special[i] and not of_byte[i]}
        self.id = {p: i for i, p in enumerate(self.pieces) if p in self.score}
        self.byte = [0] * 256
        self.sound: list[str | int] = []  # what each id stands for: a text, or a byte
        for i, p in enumerate(self.pieces):
            if of_byte[i]:
                self.byte[int(p[3:5], 16)] = i
                self.sound.append(int(p[3:5], 16))
            else:
                self.sound.append(" ⁇ " if i == self.unknown else "" if special[i] else p.replace(SPACE, " "))
        #: Entries that their own characters merge to; the others never come out.
        self.valid = {p for p in self.score if len(p) == 1 or self.merged(p) == [p]}
        parts = sorted({c for p in self.score for c in p} - self.score.keys())
        self.part = {c: size + k for k, c in enumerate(parts)}
        #: The number of characters that are in no entry, how many numbers there are, and of each number its text and length.
        self.other, self.numbers = size + len(parts), size + len(parts) + 1
        self.text = [*self.pieces, *parts, ""]
        self.length = [*map(len, self.text[:-1]), 1]
        #: The number of the longest entry that a number's text begins with and isn't (a single character always counts), or -1.
        self.shorter = [self.prefix(p) if p in self.valid else -1 for p in self.text]
        self.backward = ahocorasick.Automaton()
        for p in self.valid:
            self.backward.add_word(p[::-1], self.id[p])
        self.backward.make_automaton()
        self.pattern = next((p for p in _UNITS if all(len(p.findall(x)) == 1 for x in self.score)), None)
        self._fit: dict[int, bool] = {}
        self.decimal = [*map(str, range(size))]
        self.kept = _Units(self)
        probe = "ab  ▁c\n漢 ﬁ"
        if sp.encode(probe, add_eos=True) != self.encode(probe):
            raise ValueError("a model that leaves characters as they are and puts a space before the text is needed")

    @classmethod
    def of(cls, path: str) -> PieceModel:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def merged(self, text: str) -> list[str]:
        """Merges the best neighbours, of equal ones the first, until none makes an entry. For a few characters only."""
        parts, score = list(text), self.score
        while True:
            best, at = None, 0
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, a: int, b: int) -> bool:
        """Whether the texts of a and b stay apart when their characters are merged anew; -1 stands for the text's start."""
        key = a * self.numbers + b
        known = self._fit.get(key)
        if known is None:
            if len(self._fit) >= KEPT_PAIRS:
                self._fit.clear()
            x, y = self.text[a], self.text[b]
            known = self._fit[key] = a < 0 or a == self.other or b == self.other or self.merged(x + y) == [x, y]
        return known

    def prefix(self, piece: str) -> int:
        n = next((k for k in range(len(piece) - 1, 1, -1) if piece[:k] in self.valid), min(1, len(piece) - 1))
        return -1 if not n else self.id[piece[:n]] if piece[:n] in self.valid else self.part[piece[:n]]

    def longest(self, unit: str) -> list[int]:
        """For each place the number of the longest entry that begins there, or of its character; -1 for the end."""
        last, length = len(unit) - 1, self.length
        out = [self.part.get(c, self.other) for c in unit] if self.part else [self.other] * len(unit)
        out.append(-1)
        at, most = -1, 0
        for end, k in self.backward.iter(unit[::-1]):
            if end != at or length[k] > most:
                at, most = end, length[k]
                out[last - end] = k
        return out

    def found(self, unit: str) -> list[int]:
        """The merge encoding of unit in numbers: entries, and characters that are no entry."""
        n, longest = len(unit), self.longest(unit)
        length, shorter, fit, numbers = self.length, self.shorter, self._fit, self.numbers
        failed = bytearray(n + 1)
        out: list[int] = []
        before, at, k = -1, 0, longest[0]
        while at < n:
            while k >= 0:
                end = at + length[k]
                if not failed[end]:
                    known = fit.get(before * numbers + k)
                    if known or known is None and self.fits(before, k):
                        break
                k = shorter[k]
            if k >= 0:
                out.append(k)
                before, at, k = k, end, longest[end]
            else:
                failed[at] = 1
                out.pop()
                at -= length[before]
                k = shorter[before]
                before = out[-1] if out else -1
        return out

    def tokens(self, unit: str) -> list[str]:
        """The merge encoding of unit: entries, and characters that are no entry."""
        out, at = [], 0
        for k in self.found(unit):
            out.append(unit[at : at + self.length[k]])
            at += self.length[k]
        return out

    def unit_ids(self, unit: str) -> list[int]:
        found = self.found(unit)
        if not found or max(found) < len(self.pieces):
            return found
        ids: list[int] = []
        at = 0
        for k in found:
            if k < len(self.pieces):
                ids.append(k)
            else:
                ids += [self.byte[b] for b in unit[at].encode()]
            at += self.length[k]
        return ids

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        return self.pattern.findall(text) if self.pattern else [text]

    def encode(self, text: str) -> list[int]:
        """The ids of a text, the end's too."""
        return [*(int(i) for u in self.units(text) for i in self.kept[u][0].split(" ")), self.end]

    def sounds(self, ids: Iterable[int]) -> str:
        """What ids stand for, one space at the start not yet taken off."""
        parts = [self.sound[i] for i in ids]
        try:
            return "".join(parts)
        except TypeError:  # there are bytes among them
            out, run = [], bytearray()
        for x in parts:
            if isinstance(x, int):
                run.append(x)
                continue
            if run:
                out.append(run.decode("utf-8", "veritrove_one_byte"))
                run.clear()
            out.append(x)
        return "".join(out) + run.decode("utf-8", "veritrove_one_byte")

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the first space goes, bytes that make no character become replacement characters."""
        text = self.sounds(ids)
        first = next((i for i in ids if self.sound[i] != ""), None)
        return text[1:] if first is not None and self.pieces[first].startswith(SPACE) else text

    def digests(self, text: str) -> tuple[int, str, str]:
        """The number of ids, and SHA-256 of the ids and of the decoded text, unit by unit."""
        ids, decoded = zip(*map(self.kept.__getitem__, self.units(text))) if text else ((), ())
        ids = " ".join([*ids, self.decimal[self.end]])
        decoded = "".join(decoded)[1:]
        return ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


#: Units of a text, fine ones first: spaces and the letters after them, letters, other characters; spaces, other characters and
#: the letters after them, but line ends; spaces and what follows. Where they are cut depends on the two characters beside the cut alone.
_OTHER, _LETTERS = r"(?:[^▁\n\w]|[\d_¹²³])", r"[^\W\d_¹²³]+"
_UNITS = [re.compile(p) for p in (r"▁*[^\W\d_¹²³]+|▁+|(?:[^▁\w]|[\d_¹²³])+", rf"▁*{_OTHER}*{_LETTERS}|▁*{_OTHER}+|▁+|\n+", r"▁+[^▁]*|[^▁]+")]


class _Units(dict):
    """Units' ids as text and what these stand for, made when first asked for. Units are whole characters, so bytes of two never meet in one."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model

    def __missing__(self, unit: str) -> tuple[str, str]:
        ids = self.model.unit_ids(unit)
        out = " ".join([self.model.decimal[i] for i in ids]), self.model.sounds(ids)
        if len(unit) <= KEPT_LENGTH:
            if len(self) >= KEPT_UNITS:
                self.clear()
            self[unit] = out
        return out


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs (doc_id, text).

    model is a merge-type model file with byte fallback at a path that every worker has. Null and empty texts have
    the end's id alone and decode to ''. Texts may be of any length; nothing goes between rows, so no key is hot. Repeated rows
    come back each, rows with a null doc_id too; extra columns are ignored; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = PieceModel.of(model)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                n, ids, decoded = zip(*(m.digests(t or "") for t in part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """docs with their ids (array of int, the end's too) and the decoded text, as encode_pieces treats them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = PieceModel.of(model)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                ids = [m.encode(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([m.decode(i) for i in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
