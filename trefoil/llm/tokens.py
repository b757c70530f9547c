"""Token ids of whole texts, through the tokenizers library.

The library is handed each distinct run of text once per process: a text is cut
only where the tokenizer itself always cuts, the ids of a run are remembered, and
the ids of the text are those of its runs in order. Where white space leads tokens,
runs are found and told apart for a whole column of texts at once. What is
remembered is bounded by ``limit`` runs. The result is the library's own for the
whole text.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa

# The code points of the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
# White space to some libraries only; a text with one of these is not cut at all.
UNSURE = "\x1c\x1d\x1e\x1f᠎"
# Runs that are remembered; fewer where a word and the mark after it are two.
LIMIT = {"dropped": 1_000_000, "leading": 650_000}
# Words of one text, line ends between them counted, that the library is handed to learn them.
JOINED = 200
_RARE = [c for c in WHITE if c not in " \n"]
_RUNS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")
# Bytes of text whose runs are told apart at once.
_CHUNK = 1 << 22
# Characters that the library is handed at a time.
_HANDED = 1 << 18
# By byte: ASCII white space, ASCII letters, and what begins other white space or an unsure character; those as numbers.
_BLANK = np.array([chr(b) in "\t\n\x0b\x0c\r " for b in range(256)])
_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_OTHER = [c.encode() for c in WHITE + UNSURE if ord(c) > 127 or not _BLANK[ord(c)]]
_LEAD = np.isin(np.arange(256), [c[0] for c in _OTHER])
_ODD = [int.from_bytes(c, "big") for c in _OTHER]


class Encoder:
    """Ids of texts by the tokenizer in the file ``path``.

    ``spaces`` tells what the tokenizer does with white space: ``"dropped"`` if it
    only separates words, ``"leading"`` if one space may begin a token and no
    token reaches from a word into the white space after it.

    With ``special`` the special tokens of the file are found in texts, as by the
    library as it comes; without, their characters are ordinary text.
    """

    def __init__(self, path: str, spaces: str, limit: int | None = None, special: bool = False):
        from tokenizers import Tokenizer

        if spaces not in ("dropped", "leading"):
            raise ValueError("spaces is 'dropped' or 'leading'")
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        self.library.no_truncation()
        self.library.no_padding()
        self.dtype, self.code = ("<u2", "H") if self.library.get_vocab_size() <= 1 << 16 else ("<u4", "I")
        # Added tokens that may reach over white space or a mark leave no sure place to cut.
        added = self.library.get_added_tokens_decoder().values()
        self.whole = any(a.lstrip or a.rstrip or any(c in a.content for c in WHITE + UNSURE + ".,") for a in added)
        self.cut = (lambda text: [text]) if self.whole else self._words if spaces == "dropped" else self._spaced
        self.limit = limit or LIMIT[spaces]
        self.known: dict[str, bytes] = {}
        self.lengths = self._lengths() if spaces == "leading" and not self.whole else None
        self.last = self._last() if spaces == "dropped" and not self.whole else None

    def _lengths(self) -> np.ndarray | None:
        """Bytes of text that each token stands for, where tokens are the text's own bytes."""
        from tokenizers import pre_tokenizers

        before = self.library.pre_tokenizer
        if self.library.normalizer is not None or not isinstance(before, pre_tokenizers.ByteLevel) or before.add_prefix_space:
            return None
        added = self.library.get_added_tokens_decoder()
        names = (self.library.id_to_token(i) for i in range(self.library.get_vocab_size()))
        return np.array([len(added[i].content.encode()) if i in added else len(x or "") for i, x in enumerate(names)], np.int64)

    def _last(self) -> np.ndarray | None:
        """Whether each token ends a piece of a text, where each piece ends in one such token."""
        from tokenizers import pre_tokenizers

        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        if not suffix or any(self.library.token_to_id(c + suffix) is None for c in pre_tokenizers.ByteLevel.alphabet()):
            return None
        if any(_WORD.fullmatch(a.content) for a in self.library.get_added_tokens_decoder().values()):
            return None
        return np.array([(self.library.id_to_token(i) or "").endswith(suffix) for i in range(self.library.get_vocab_size())])

    def _words(self, text: str) -> list[str]:
        return [text] if any(c in text for c in UNSURE) else text.split()

    def _spaced(self, text: str) -> list[str]:
        if any(c in text for c in UNSURE):
            return [text]
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(c in text for c in _RARE) or text[:1] == " " or text[-1:] == " ":
            return _RUNS.findall(text)
        # Single spaces between words: each begins the run that follows it; single line ends stand alone.
        return text.replace(" ", "\x1c ").replace("\n", "\x1c\n\x1c").split("\x1c")

    def batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids (of ``dtype``) of each text."""
        if self.lengths is not None:
            ids, ends = self.column(pa.array(texts, pa.large_string()))
            raw, cuts = ids.tobytes(), [0, *(ends * ids.itemsize).tolist()]
            return [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        known, get = self.known, self.known.get
        runs = [self.cut(t) for t in texts]
        # One look-up a run; what is not known yet is filled in after the library has seen it.
        found = [list(map(get, r)) for r in runs]
        gaps = [[k for k, ids in enumerate(f) if ids is None] if None in f else () for f in found]
        new = {r[k] for r, g in zip(runs, gaps) for k in g}
        if new:
            if len(known) + len(new) > self.limit:
                known.clear()
            # Both tokenizers cut between an ASCII letter and a mark, so a word with a mark after it is two known runs.
            # Other letters may be normalised to a letter and a combining mark, which joins the mark after it.
            marked = [x for x in new if x[-1:] in (".", ",") and x[-2:-1].isascii() and x[-2:-1].isalpha() and not self.whole]
            plain = new.difference(marked).union(x[:-1] for x in marked).difference(known).union(".,")
            self._learn(list(plain))
            for x in marked:
                known[x] = known[x[:-1]] + known[x[-1]]
        for r, f, g in zip(runs, found, gaps):
            for k in g:
                f[k] = known[r[k]]
        return [b"".join(f) for f in found]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where those of each text end; a null is an empty text."""
        if self.lengths is None:
            parts = self.batch([t or "" for t in texts.to_pylist()])
            ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) // np.dtype(self.dtype).itemsize
            return np.frombuffer(b"".join(parts), self.dtype), ends
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts) or texts.buffers()[2] is None:
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        found, ends, i, total = [], [], 0, 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _CHUNK, "right")) - 1)
            ids, upto = self._chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            found.append(ids)
            ends.append(upto + total)
            i, total = j, total + len(ids)
        return np.concatenate(found), np.concatenate(ends)

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``column``, for texts given by their bytes and where they begin and end."""
        starts = self._starts(data, offsets)
        runs = pa.Array.from_buffers(
            pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]).dictionary_encode()
        words, known = runs.dictionary.to_numpy(zero_copy_only=False).tolist(), self.known
        found = list(map(known.get, words))
        gaps = [k for k, ids in enumerate(found) if ids is None]
        if gaps:
            if len(known) + len(gaps) > self.limit:
                known.clear()
            self._learn([words[k] for k in gaps])
            for k in gaps:
                found[k] = known[words[k]]
        ids = np.frombuffer(b"".join(found), self.dtype)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // ids.itemsize
        which = runs.indices.to_numpy()
        many = sizes[which]
        upto = np.concatenate([[0], np.cumsum(many)])
        # The ids of a run lie together, so their places are those of its first one and a running number.
        places = np.repeat((np.cumsum(sizes) - sizes)[which] - upto[:-1], many)
        places += np.arange(len(places))
        return ids[places], upto[np.searchsorted(starts, offsets[1:])]

    def _starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the runs of some texts begin, as ``_spaced`` cuts them; marks after a letter begin a run, too."""
        blank = _BLANK[data]
        cut = blank.copy()
        cut[1:] &= ~blank[:-1]
        # A single line end stands alone.
        after = np.flatnonzero(cut[:-1] & (data[:-1] == 10)) + 1
        cut[after[~blank[after]]] = True
        # No token reaches from a letter over a mark. Letters: ASCII, and two bytes of a Latin one (all of U+00C0 to U+027F but two).
        mark = np.flatnonzero((data == 46) | (data == 44))
        mark = mark[mark > 1]
        last, first = data[mark - 1], data[mark - 2]
        latin = (last >= 0x80) & (last < 0xC0) & (((first >= 0xC4) & (first <= 0xC9)) | ((first == 0xC3) & (last != 0x97) & (last != 0xB7)))
        mark = mark[_LETTER[last] | latin]
        cut[mark] = True
        lead = np.flatnonzero(_LEAD[data])
        if len(lead):
            some = np.concatenate([data, np.zeros(2, np.uint8)])
            value = some[lead].astype(np.int64)
            for k, least in ((1, 0x80), (2, 0xE0)):
                value = np.where(some[lead] >= least, value << 8 | some[lead + k], value)
            for t in np.unique(np.searchsorted(offsets, lead[np.isin(value, _ODD)], "right")) - 1:
                a, b = offsets[t], offsets[t + 1]
                cut[a:b] = False
                sizes = [len(r.encode()) for r in self._spaced(data[a:b].tobytes().decode())]
                cut[a + np.cumsum(sizes) - sizes] = True
        # An empty text begins no run.
        cut[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        return np.flatnonzero(cut)

    def _learn(self, runs: list[str]) -> None:
        """Remember the ids of runs."""
        if self.lengths is not None:
            runs = self._learn_joined(runs)
        elif self.last is not None:
            runs = self._learn_letters(runs)
        known, code = self.known, self.code
        for run, ids in self._handed(runs):
            known[run] = array(code, ids.ids).tobytes()

    def _handed(self, texts: list[str]):
        """Texts and what the library makes of them, some at a time, so that few of its results are held."""
        sizes = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + _HANDED, "right")))
            yield from zip(texts[i:j], self.library.encode_batch_fast(texts[i:j], add_special_tokens=False))
            i = j

    def _learn_joined(self, runs: list[str]) -> list[str]:
        """Learn many words by one text for some hundred; returns the runs not learnt.

        The tokenizer cuts before the space of a word and on both sides of a single line end, which is put before a word
        without space, so the bytes that tokens stand for tell where the ids of each end.
        """
        words, left = [], []
        for x in runs:
            if not x.isprintable() or x.rfind(" ") > 0 or x in (" ", ""):
                left.append(x)
            elif x[0] == " ":
                words.append(x)
            else:
                words += ("\n", x)
        groups = [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
        for group, (text, found) in zip(groups, self._handed(["".join(g) for g in groups])):
            ids = np.array(found.ids, self.dtype)
            reached = np.cumsum(self.lengths[ids])
            sizes = map(len, group) if text.isascii() else [len(x.encode()) for x in group]
            ends = np.cumsum(np.fromiter(sizes, np.int64, len(group)))
            last = np.searchsorted(reached, ends)
            if last[-1] >= len(reached) or (reached[last] != ends).any():
                left += group
                continue
            self._keep(group, ids, last + 1)
        return left

    def _learn_letters(self, runs: list[str]) -> list[str]:
        """As ``_learn_joined``, for words of Latin letters where white space is dropped.

        No word is without a token that ends a piece, so if there are as many such tokens as words, each word has one.
        """
        words = [x for x in runs if _WORD.fullmatch(x)]
        left = [x for x in runs if not _WORD.fullmatch(x)]
        groups = [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
        for group, (_, found) in zip(groups, self._handed([" ".join(g) for g in groups])):
            ids = np.array(found.ids, self.dtype)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(group) or ends[-1] != len(ids):
                left += group
                continue
            self._keep(group, ids, ends)
        return left

    def _keep(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """Remember ids that words have one after the other."""
        raw, cuts = ids.tobytes(), (ends * ids.itemsize).tolist()
        self.known.update(zip(words, map(raw.__getitem__, map(slice, [0] + cuts[:-1], cuts))))


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, spaces: str, special: bool = False) -> Encoder:
    """The encoder of this process, kept between tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, spaces, special) not in _encoders:
        _encoders[path, spaces, special] = Encoder(path, spaces, special=special)
    return _encoders[path, spaces, special]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
