"""Toxicity scores by a support vector machine over a subsequence string kernel.

The kernel compares two words by the letter triples that both hold as subsequences,
gaps allowed: a triple that spans more letters counts less (``DECAY`` for each letter
in between, at most ``SPAN`` letters in all), and either side is divided by the norm
of its weights. So a word with a letter put in, left out or changed stays near itself.
Its square, a kernel again, is close to zero for words that merely look alike. Two
sentences are compared by the sum over their words.

Nyström landmarks, words of the training sentences, make it linear: a word is its
kernel values against the landmarks times the inverse root of the landmarks' own
kernel matrix. The machine is trained on sentences. A label belongs to a document, so
sentences of toxic documents are suspected first by their words and then by the
machine itself; training and suspicion alternate. What is suspected comes a second
time with a letter put into its strongest word. A word that comes out on the toxic
side is read again with each of its letters left out, and the highest reading counts,
so that a letter put in is worth little.

A document's score is that of its highest sentence, calibrated to (0, 1) by a
logistic curve on training documents. The machine adds up over words, so a worker
computes each distinct word once and remembers a bounded number.

Words are cut at white space; signs inside them go, so that dots or stars between
letters do not hide a word; characters spelled out one by one are joined; long words
are read in overlapping windows. The whole text counts. Fitting sees about ``rows``
labelled documents drawn by a hash of their id, none above ``chars`` characters; they
alone pass the driver.

Defined cases: a null or empty text has no sentence and scores as one without words;
labels without a document and null labels are left out; a document with several
labels is toxic if one is; without both classes in training the score is the share
of toxic labels; repeated rows are scored alike. Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

DECAY, SPAN, POWER = 0.9, 5, 2
WINDOW, STEP = 24, 12
LANDMARKS = 192
ROWS, CHARS = 4000, 20_000
LIMIT = 150_000
CHUNK = 2048
# Value from which a word is read again without one of its letters.
NEAR = 1.0
# Standard errors from which a word marks toxic documents, and rounds of training and choice.
SUSPECT, ROUNDS = 3.0, 3

_SENTENCES = re.compile(r"[.!?]+\s|\n")
_SIGNS = re.compile(r"[\W_]+")
# Three or more single characters with a space before each.
_SPELLED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")


def sentences(text: str | None) -> list[set[str]]:
    """The different tokens of each sentence; characters spelled out one by one are joined to one."""
    out = []
    for sentence in _SENTENCES.split((text or "").lower()):
        tokens = set(sentence.split())
        if tokens:
            # The search is dear; a spelled word has three tokens of one character, but for repeats.
            if min(map(len, tokens)) == 1:
                tokens.update("".join(x.split()) for x in _SPELLED.findall(sentence))
            out.append(tokens)
    return out


def words(token: str) -> list[str]:
    """A token without its signs, in windows if it is long."""
    if not token.isalnum():
        token = _SIGNS.sub("", token)
    if len(token) <= WINDOW:
        return [token]
    return [token[i : i + WINDOW] for i in range(0, len(token) - STEP, STEP)]


_SPANS = [(m, s - 1) for s in range(3, SPAN + 1) for m in range(1, s - 1)]


def _triples(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all gapped triples of words of one length (a row each), and their weights."""
    size = len(batch[0])
    letters = np.frombuffer("".join(batch).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(batch), size).astype(np.uint64)
    codes, weights = [], []
    for middle, last in _SPANS:
        if last < size:
            n = size - last
            codes.append(letters[:, :n] << np.uint64(42) | letters[:, middle : middle + n] << np.uint64(21) | letters[:, last:])
            weights.append(np.full(n, DECAY ** (last - 2)))
    return np.concatenate(codes, axis=1), np.concatenate(weights)


def by_length(batch: list[str]) -> list[tuple[list[int], list[str]]]:
    """Places and words for each length of three letters or more."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(batch):
        if len(w) > 2:
            groups.setdefault(len(w), []).append(i)
    return [(at, [batch[i] for i in at]) for at in groups.values()]


class Kernel:
    """Squared subsequence kernel against landmark words, which must have three letters or more.

    Both feature vectors are divided by the norm of their triples' weights, so any
    two words of one length have the same divisor.
    """

    _BITS = 20

    def __init__(self, landmarks: list[str]):
        self.n = len(landmarks)
        code, mark, weight = [], [], []
        for at, some in by_length(landmarks):
            codes, weights = _triples(some)
            code.append(codes.ravel())
            mark.append(np.repeat(at, codes.shape[1]))
            weight.append(np.tile(weights / np.sqrt((weights ** 2).sum()), len(some)))
        code, mark, weight = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (code, mark, weight))
        by = np.argsort(code, kind="stable")
        code, self.mark, self.weight = code[by], mark[by].astype(np.int64), weight[by]
        # Where the landmarks of a triple begin, and how many there are.
        self.codes, self.first, self.many = np.unique(code, return_index=True, return_counts=True)
        self.seen = np.zeros(1 << self._BITS, bool)
        self.seen[self._slot(self.codes)] = True

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._BITS)

    def __call__(self, batch: list[str]) -> np.ndarray:
        out = np.zeros((len(batch), self.n), np.float32)
        for at, some in by_length(batch):
            codes, weights = _triples(some)
            # Most triples are in no landmark: a bit table drops nearly all of them.
            row, column = np.nonzero(self.seen[self._slot(codes)])
            code = codes[row, column]
            place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = self.codes[place] == code
            row, column, place = row[hit], column[hit], place[hit]
            many = self.many[place]
            each = np.repeat(np.arange(len(place)), many)
            inside = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
            entry = self.first[place[each]] + inside
            value = weights[column[each]] * self.weight[entry] / np.sqrt((weights ** 2).sum())
            sums = np.bincount(row[each] * self.n + self.mark[entry], value, len(some) * self.n)
            out[at] = sums.reshape(len(some), self.n)
        return out ** POWER


def machine(blocks, size: int, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a squared-hinge support vector machine, by Newton steps.

    ``blocks()`` yields (rows, class, cost of a row); the last of the ``size`` columns is the offset's.
    """
    keep = np.full(size, ridge)
    keep[-1] = 1e-6
    w, before = np.zeros(size), None
    for _ in range(rounds):
        left, right, state = np.diag(keep), np.zeros(size), []
        for x, y, cost in blocks():
            active = y * (x @ w.astype(np.float32)) < 1
            some = x[active]
            left += cost * (some.T @ some)
            right += cost * y * some.sum(axis=0, dtype=np.float64)
            state.append(np.packbits(active).tobytes())
        if state == before:
            break
        w, before = np.linalg.solve(left, right), state
    return w


def calibration(score: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, with softened targets."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([score, np.ones(len(score))], axis=1)
    w = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def altered(word: str, draw: np.random.Generator) -> str:
    """The word with a letter put into it."""
    at = int(draw.integers(1, len(word)))
    return word[:at] + "xzkq"[int(draw.integers(4))] + word[at:]


class Model:
    """What a worker needs: landmarks, their weights, offset and curve. Small."""

    def __init__(self, landmarks: list[str], alpha: np.ndarray, offset: float, slope: float, start: float):
        self.landmarks, self.alpha, self.offset, self.slope, self.start = landmarks, alpha, offset, slope, start
        self.kernel = None

    def __getstate__(self):
        # Workers build the kernel's table themselves.
        return {**self.__dict__, "kernel": None, "known": {}}

    def _values(self, tokens: list[str]) -> list[float]:
        """What each token adds to its sentence."""
        parts = [words(t) for t in tokens]
        flat = [w for p in parts for w in p]
        value = self.kernel(flat).astype(np.float64) @ self.alpha
        # A word on the toxic side is read again with each letter left out; the highest reading counts.
        near = np.flatnonzero(value > NEAR)
        shorter = [flat[i][:k] + flat[i][k + 1 :] for i in near for k in range(len(flat[i]))]
        if shorter:
            lengths = np.array([len(flat[i]) for i in near])
            again = np.maximum.reduceat(self.kernel(shorter).astype(np.float64) @ self.alpha, np.cumsum(lengths) - lengths)
            value[near] = np.maximum(value[near], again)
        ends = np.cumsum([len(p) for p in parts])
        return np.add.reduceat(value, ends - [len(p) for p in parts]).tolist()

    def scores(self, texts: list[str | None], limit: int = LIMIT) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts, limit) + self.start, -30, 30)))

    def margins(self, texts: list[str | None], limit: int = LIMIT) -> np.ndarray:
        """The machine's value for the highest sentence of each text."""
        if self.kernel is None:
            self.kernel, self.known = Kernel(self.landmarks), {}
        parts = [sentences(t) for t in texts]
        needed = set().union(*[s for p in parts for s in p])
        fresh = list(needed.difference(self.known))
        if len(self.known) + len(fresh) > limit:
            self.known, fresh = {}, list(needed)
        for i in range(0, len(fresh), CHUNK):
            self.known.update(zip(fresh[i : i + CHUNK], self._values(fresh[i : i + CHUNK])))
        get = self.known.__getitem__
        return np.array([max((sum(map(get, s)) for s in p), default=0.0) for p in parts]) + self.offset


def fit(texts: list[str], toxic: list[bool], landmarks: int = LANDMARKS, seed: int = 0) -> Model:
    """Train on whole labelled texts."""
    toxic = np.array(toxic, bool)
    if not toxic.any() or toxic.all() or not any(map(sentences, texts)):
        share = float(toxic.mean()) if len(toxic) else 0.0
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(["..."], np.zeros(1), 0.0, 1.0, float(np.log(share / (1 - share))))
    # Words as numbers, sentence by sentence: ``flat[bounds[i] : bounds[i + 1]]`` are those of sentence i.
    vocabulary: dict[str, int] = {}
    flat, sizes, of = [], [], []
    for k, text in enumerate(texts):
        for sentence in sentences(text):
            ids = {vocabulary.setdefault(w, len(vocabulary)) for t in sentence for w in words(t)}
            flat.append(np.fromiter(sorted(ids), np.int32, len(ids)))
            of.append(k)
    names, of = list(vocabulary), np.array(of, np.int64)
    del vocabulary
    sizes = np.array([len(f) for f in flat])
    flat, sentence_of = np.concatenate(flat), np.repeat(np.arange(len(sizes)), sizes)
    bounds = np.append(0, np.cumsum(sizes))
    pairs = np.unique(of[sentence_of] * len(names) + flat)
    held = toxic[pairs // len(names)]
    uses = [np.bincount(pairs[held == t] % len(names), minlength=len(names)) for t in (False, True)]
    del pairs, held
    # How much more often toxic documents hold a word, in standard errors.
    n = [int((~toxic).sum()), int(toxic.sum())]
    share = (uses[0] + uses[1]) / sum(n)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * sum(n) / (n[0] * n[1]))
    lift = (uses[1] / n[1] - uses[0] / n[0]) / error
    lift[[len(w) < 3 for w in names]] = -np.inf

    order = sorted(np.flatnonzero(lift > 0), key=lambda i: (-lift[i], names[i]))[: landmarks // 2]
    plain = sorted(np.flatnonzero((lift <= 1) & np.isfinite(lift)), key=lambda i: (-uses[0][i], names[i]))
    marks = [names[i] for i in [*order, *plain[: landmarks - len(order)]]]
    if not marks:
        marks = ["..."]
    kernel = Kernel(marks)
    values, vectors = np.linalg.eigh(kernel(marks).astype(np.float64))
    sound = values > 1e-6
    root = (vectors[:, sound] / np.sqrt(values[sound])).astype(np.float32)
    near = np.empty((len(names), root.shape[1]), np.float32)
    for i in range(0, len(names), CHUNK):
        near[i : i + CHUNK] = kernel(names[i : i + CHUNK]) @ root
    x = np.ones((len(sizes), root.shape[1] + 1), np.float32)
    for i in range(len(sizes)):
        x[i, :-1] = near[flat[bounds[i] : bounds[i + 1]]].sum(axis=0)

    near = {i: near[i].copy() for i in np.flatnonzero(lift > SUSPECT)}

    # At first, the sentences with words that mark toxic documents are suspected.
    rank = np.bincount(sentence_of, np.maximum(lift[flat] - SUSPECT, 0.0), len(sizes))
    draw = np.random.default_rng(seed)
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    clean = np.flatnonzero(~toxic[of])
    first_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(of))))
    for _ in range(ROUNDS):
        # Suspected sentences of toxic documents, and the highest of each, unless clean ones reach as high.
        usual = np.quantile(rank[clean], 0.99) if len(clean) else 0.0
        highest = np.maximum.reduceat(rank, starts)[first_of]
        witness = np.flatnonzero(toxic[of] & ((rank > 0) | (rank == highest)) & (rank > usual))
        if not len(witness):
            witness = np.flatnonzero(toxic[of] & (rank == highest))
        changed = []
        for k in witness:
            ids = flat[bounds[k] : bounds[k + 1]]
            word = ids[lift[ids].argmax()]
            if len(names[word]) > 3 and lift[word] > SUSPECT:
                changed.append((k, word, altered(names[word], draw)))
        parts = [x[witness]]
        if changed:
            again = x[[k for k, _, _ in changed]]
            again[:, :-1] += kernel([new for _, _, new in changed]) @ root - np.stack([near[word] for _, word, _ in changed])
            parts.append(again)
        positives = np.concatenate(parts)

        def blocks():
            total = len(positives) + len(clean)
            yield positives, 1, total / (2 * max(len(positives), 1))
            for i in range(0, len(clean), CHUNK):
                yield x[clean[i : i + CHUNK]], -1, total / (2 * len(clean))

        w = machine(blocks, x.shape[1])
        rank = (x @ w.astype(np.float32)).astype(np.float64)
    model = Model(marks, root.astype(np.float64) @ w[:-1], float(w[-1]), 1.0, 0.0)
    model.slope, model.start = calibration(model.margins(texts), toxic)
    return model


def training_rows(
    docs: DataFrame, labels: DataFrame, learns: Column, id: str = "doc_id", text: str = "text", label: str = "toxic",
    rows: int = ROWS, chars: int = CHARS,
) -> tuple[list[str], list[bool]]:
    """About ``rows`` labelled texts, half of them toxic if there are so many, drawn by a hash of the id."""
    known = labels.where(learns & F.col(label).isNotNull()).groupBy(F.col(id).alias("_id")).agg(F.max(F.col(label) == 1).alias("_toxic"))
    found = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = {t: min(found.get(t, 0), rows // 2) for t in (True, False)}
    room = {t: rows - few[not t] for t in (True, False)}
    draw = F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    share = {t: min(1.0, room[t] / max(found.get(t, 0), 1)) for t in room}
    chosen = known.where(draw < F.when(F.col("_toxic"), share[True]).otherwise(share[False]))
    # The drawn ids are about ``rows`` whatever the size of the tables.
    drawn = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).where(F.char_length("_text") <= chars)
    got = drawn.join(F.broadcast(chosen), "_id").toPandas().sort_values(["_id", "_text"])
    return got["_text"].tolist(), got["_toxic"].tolist()


def _score(model: Model):
    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            parts = [model.scores(texts.slice(i, 128).to_pylist()) for i in range(0, len(texts), 128)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], ["_id", "score"])
    return run


def toxicity(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``id``, ``score`` and ``predicted`` of every row."""
    kind = dict(docs.dtypes)[id]
    source = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    scored = source.mapInArrow(_score(model), f"_id {kind}, score double")
    return scored.select(F.col("_id").alias(id), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
