"""Encoding and decoding of texts with a SentencePiece model as a weighted transducer.

The model file is compiled to states and arcs. Pieces are a tree of states that
reads characters and writes a piece where one ends. The normaliser is composed
with it once: every arc that reads the space mark has a twin that reads a space,
and the mark before a text is read first. A character that no piece begins with
is read by byte arcs, one for each of its bytes. Composed with a text, arcs lead
from place to place, and the shortest path in the tropical semiring (weights add
along a path, the smaller wins) is the encoding.

Weights. A unigram model weighs a piece by its negative score; places are relaxed
in their order. A model of merges has no such weights: there, an acceptor over
neighbouring pieces is composed as well, which gives weight zero where the merges
of both pieces together leave the border between them, and infinity elsewhere.
Merges never reach over a border that they leave for its two pieces alone, so
exactly one path to each place is finite. Zero cannot be improved, so the first
finite path to the end is the shortest; it is sought depth first, longest arcs
first, and a place from which the end was not reached is never entered again.

Texts are cut where no piece reaches across, at marks and at characters that are
in no longer piece, and a bounded number of runs is remembered, so a run is
composed once per process.

Defined cases: a null or empty text has no ids; ids outside the model fail when
decoded; control pieces decode to nothing, unknown ones to their surface; bytes
that form no character decode to the replacement character.
"""

from __future__ import annotations

import math
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
# Characters of the longest run that is remembered.
REMEMBERED = 64
NOTHING: dict = {}
# Piece types, model types and field numbers of the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2
_PIECES, _TRAINER, _NORMALISER = 1, 2, 3
_TYPE, _BYTE_FALLBACK, _SURFACE = 3, 35, 44
_CHARSMAP, _DUMMY, _TRIM, _ESCAPE = 2, 3, 4, 5


def _fields(data: bytes):
    """Numbers and values of a message in the file."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


class Transducer:
    """A model file, compiled."""

    def __init__(self, path: str, limit: int = 400_000):
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        trainer = dict(_fields(next((v for k, v in top if k == _TRAINER), b"")))
        normaliser = dict(_fields(next((v for k, v in top if k == _NORMALISER), b"")))
        self.merges = trainer.get(_TYPE, UNIGRAM) == MERGES
        if not self.merges and trainer.get(_TYPE, UNIGRAM) != UNIGRAM:
            raise ValueError("the model is neither of the unigram nor of the merge kind")
        if normaliser.get(_CHARSMAP) or not normaliser.get(_ESCAPE, 1):
            raise ValueError("a normaliser with a character map or without space marks is not supported")
        self.dummy, self.trim = bool(normaliser.get(_DUMMY, 1)), bool(normaliser.get(_TRIM, 1))
        self.byte_fallback = bool(trainer.get(_BYTE_FALLBACK, 0))
        self.surface = trainer.get(_SURFACE, " ⁇ ".encode()).decode()
        self.pieces: list[str] = []
        self.types: list[int] = []
        self.scores: list[float] = []
        for k, v in top:
            if k == _PIECES:
                p = dict(_fields(v))
                self.pieces.append(p[1].decode())
                self.scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                self.types.append(p.get(3, NORMAL))
        if USER in self.types:
            raise ValueError("models with user-defined pieces are not supported")
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t in (NORMAL, UNUSED)}
        self.unknown = self.types.index(UNKNOWN)
        # Pieces that are not simply their text.
        self.special = np.array([t not in (NORMAL, UNUSED) for t in self.types])
        self.byte_ids = [self.types.index(BYTE) + b for b in range(256)] if self.byte_fallback else []
        self.writes = {p: struct.pack("<I", i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.byte_arcs = [struct.pack("<I", i) for i in self.byte_ids]
        self.unknown_weight = 10 - min((self.scores[i] for i in self.ids.values()), default=0)
        inside = {c for p in self.ids for c in p[1:] if len(p) > 1}
        outer = inside | {p[0] for p in self.ids if len(p) > 1}
        # A run begins at a mark, unless a piece has one inside; other characters in no longer piece stand alone.
        marks_begin = not any(MARK in p.lstrip(MARK) for p in self.ids)
        alone = "".join(re.escape(c) for c in "\n\t" if c not in outer)
        marks = MARK + " "
        self.runs = re.compile(
            (f"[{alone}]|" if alone else "")
            + (f"[{marks}]*[^{marks}{alone}]+|[{marks}]+" if marks_begin else (f"[^{alone}]+" if alone else "[\\s\\S]+")))
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.borders: dict[str, dict[str, bool]] = {}
        self.n_borders = 0
        # When a piece is merged, pieces of one score at one time, and from what.
        times = {x: k for k, x in enumerate(sorted({-self.scores[i] for i in self.ids.values()}))}
        self.time = {p: times[-self.scores[i]] for p, i in self.ids.items() if len(p) > 1}
        self.halves: dict[str, tuple[str, str]] = {}
        self.start = self._compile()

    def _compile(self) -> dict:
        """The state before a piece. A state maps characters to states and "" to the piece that ends there."""
        start: dict = {}
        for piece in self.ids:
            # Only pieces that merging their own characters gives can be on a path.
            if self.merges:
                halves = self._merged(piece, 2)
                if len(halves) > 2:
                    continue
                if len(halves) == 2:
                    self.halves[piece] = halves[0], halves[1]
            state = start
            for c in piece:
                state = state.setdefault(c, {})
            state[""] = piece
        states = [start]
        while states:
            state = states.pop()
            states += [to for c, to in state.items() if c]
            if MARK in state:
                state[" "] = state[MARK]
        return start

    def prepared(self, text: str) -> str:
        """The text as the composed transducer reads it: with the space that stands for the mark before it."""
        if self.trim:
            text = re.sub(" +", " ", text).strip(" ")
        return " " * self.dummy + text if text else ""

    # The acceptor over neighbouring pieces.

    def _merged(self, text: str, least: int = 1) -> list[str]:
        """Pieces left when the best adjacent pair is merged again and again, down to ``least`` pieces."""
        parts = list(text)
        while len(parts) > least:
            best, at = -math.inf, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and self.scores[i] > best:
                    best, at = self.scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays(self, left: str, right: str) -> bool:
        """Whether merging both pieces together leaves just them."""
        row = self.borders.get(left)
        if row is None:
            row = self.borders[left] = {}
        found = row.get(right)
        if found is None:
            if self.n_borders >= self.limit:
                self.borders, self.n_borders = {}, 0
                row = self.borders[left] = {}
            self.n_borders += 1
            found = row[right] = self._border(left, right)
        return found

    def _border(self, left: str, right: str) -> bool:
        """Merges undone from the last one on: whether at no time what lay at the border was the next pair to merge."""
        time, limit = self.time.get, math.inf
        while True:
            if time(left + right, math.inf) < limit:
                return False
            a, b = time(left, -1), time(right, -1)
            if a == b == -1:
                return True
            # Of equal pairs the left one goes first.
            if a > b:
                left, limit = self.halves[left][1], a
            else:
                right, limit = self.halves[right][0], b + 1

    def _arcs(self, text: str, at: int, stop: int) -> list[str]:
        """Pieces that can be read at a place, shorter ones first; a character that is no piece stands for itself."""
        state, out = self.start, []
        for c in text[at : min(stop, at + self.longest)]:
            state = state.get(c)
            if state is None:
                break
            if "" in state:
                out.append(state[""])
        if at < stop and (not out or len(out[0]) > 1):
            out.insert(0, MARK if text[at] == " " else text[at])
        return out

    def shortest(self, text: str) -> list[str]:
        """Pieces of the shortest path through the composition with a text."""
        return self._finite(text) if self.merges else self._least(text)

    def _finite(self, text: str) -> list[str]:
        n, at, stop, last = len(text), 0, len(text), ""
        arcs, stays = self._arcs, self.stays
        row, dead, path = {}, None, []
        while at < n:
            ways = arcs(text, at, stop)
            while ways:
                piece = ways.pop()
                if dead is not None and dead[at + len(piece)]:
                    continue
                if last:
                    fits = row.get(piece)
                    if fits is None:
                        fits = stays(last, piece)
                    if not fits:
                        continue
                path.append(piece)
                at += len(piece)
                stop, last, row = n, piece, self.borders.get(piece, NOTHING)
                break
            else:
                # No way on: back to the place before, and on with its shorter arcs.
                dead = bytearray(n + 1) if dead is None else dead
                dead[at] = 1
                stop = at - 1
                at -= len(path.pop())
                last = path[-1] if path else ""
                row = self.borders.get(last, NOTHING)
        return path

    def _least(self, text: str) -> list[str]:
        n = len(text)
        weight, last = [0.0] + [math.inf] * n, [""] * (n + 1)
        for at in range(n):
            for piece in self._arcs(text, at, n):
                i = self.ids.get(piece)
                total = weight[at] + (self.unknown_weight if i is None else -self.scores[i])
                end = at + len(piece)
                if total < weight[end]:
                    weight[end], last[end] = total, piece
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def _run(self, text: str) -> bytes:
        """What the arcs of the shortest path write."""
        path = self.shortest(text)
        out = list(map(self.writes.get, path))
        if None in out:
            for k, ids in enumerate(out):
                if ids is not None:
                    continue
                if self.byte_fallback:
                    out[k] = b"".join(map(self.byte_arcs.__getitem__, path[k].encode("utf-8", "surrogatepass")))
                else:
                    # Unknown characters in a row are one unknown piece.
                    out[k] = b"" if k and path[k - 1] not in self.writes else struct.pack("<I", self.unknown)
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        runs = self.runs.findall(self.prepared(text or ""))
        found = list(map(self.known.get, runs))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    found[k] = self.known.get(runs[k]) or self._learn(runs[k])
        return np.frombuffer(b"".join(found), "<u4")

    def _learn(self, run: str) -> bytes:
        ids = self._run(run)
        # Long runs are not remembered, so what is remembered is bounded in bytes as well.
        if len(run) <= REMEMBERED:
            if len(self.known) >= self.limit:
                self.known.clear()
            self.known[run] = ids
        return ids

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        if not self.special[ids].any():
            return self._spaced("".join(map(self.pieces.__getitem__, ids.tolist())))
        out, raw = [], bytearray()
        for i in ids.tolist():
            kind = self.types[i]
            if kind == BYTE:
                raw.append(i - self.byte_ids[0])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if kind != CONTROL:
                out.append(self.surface if kind == UNKNOWN else self.pieces[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return self._spaced("".join(out))

    def _spaced(self, text: str) -> str:
        if self.dummy and text.startswith(MARK):
            text = text[1:]
        return text.replace(MARK, " ")


_models: dict[str, Transducer] = {}


def model(path: str) -> Transducer:
    """The transducer of this process, kept between tasks."""
    if path not in _models:
        _models[path] = Transducer(path)
    return _models[path]


def _few(batches, rows: int = 128):
    """Slices of batches, so that a worker holds the texts and ids of a few rows."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _encode(path: str):
    def run(batches):
        for batch in _few(batches):
            t = model(path)
            ids = [t.encode(x) for x in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["_in", "ids"])
    return run


def _decode(path: str):
    def run(batches):
        for batch in _few(batches):
            t = model(path)
            # One document's ids at a time become Python numbers.
            ids = batch.column(1)
            at, values, there = ids.offsets.to_numpy(), ids.values.to_numpy(), ids.is_valid().to_pylist()
            text = [t.decode(values[at[k] : at[k + 1]]) if there[k] else None for k in range(len(ids))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["_in", "decoded"])
    return run


def _with(df: DataFrame, source: str, f, name: str, kind: str) -> DataFrame:
    inside = F.struct(*[df[c].alias(f"c{k}") for k, c in enumerate(df.columns)]).alias("_in")
    start = df.select(inside, F.col(source).alias("_source"))
    out = start.mapInArrow(f, f"_in {start.schema['_in'].dataType.simpleString()}, {name} {kind}")
    return out.select(*[F.col("_in")[f"c{k}"].alias(c) for k, c in enumerate(df.columns) if c != name], name)


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (array of int); a column of that name is replaced."""
    return _with(df, text, _encode(path), "ids", "array<int>")


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``; a column of that name is replaced."""
    return _with(df, ids, _decode(path), "decoded", "string")
