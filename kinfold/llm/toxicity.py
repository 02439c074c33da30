"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two words counts their common subsequences of three characters,
each discounted by ``DECAY`` for every character it spans, so that insults
with inserted, missing or changed endings stay close to the plain ones; it is
scaled by the words' lengths. Landmarks are words of the training texts: those
that tell toxic texts from clean ones by a likelihood-ratio statistic that
chance would give to one word of the vocabulary, and common and arbitrary
words of clean texts. Words are mapped by the inverse square root of the
landmarks' own kernel matrix, and a linear machine with squared hinge loss is
fitted in that space. A sentence is as toxic as its most toxic word, and a
text as its most toxic sentence; the fit takes each sentence by that word: one
sentence of each toxic text, and of clean texts all sentences within the
margin, over ``ROUNDS`` rounds of fitting and looking again. As the kernel is
linear in weighted subsequences, landmarks, map and machine fold into one
table of 2 ** 18 weights, whatever the number of landmarks; a word costs one
look-up for each of its subsequences, and workers keep nothing between tasks.
Margins and the share of words beyond the margin are mapped to scores on texts
kept out of the fit.

Signs inside words are passed over. Single letters with blanks between them
are read as one word. Words beyond ``WINDOW`` characters are compared window
by window. At most ``SAMPLE`` labelled rows of each label are fitted on, the
first by a hash of the id, and at most ``LANDMARKS`` telling words and
``NEGATIVES`` arbitrary clean ones; the whole of every text is scored.

Defined cases: null and empty texts, and texts without a word of three
characters, score as the least toxic word could; null ids carry no label;
labels other than 0 and 1 are not used; of repeated labels of an id the
largest holds, and of equal texts of one label the smallest id; without labels
of both classes, or without a telling word, every score is the share of ones,
or a half; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._work import checkpointed, trimmed

ORDER, DECAY = 3, 0.8
WINDOW = 16
SAMPLE = 3_000
LANDMARKS, COMMON, NEGATIVES, LEAST_DOCS = 512, 96, 3_000, 5  # the first is a bound for memory, far above the words that tell in 3,000 texts
ROUNDS, MINED = 2, 6
SYMBOLS = 64
LEAST = -3.0
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _symbols() -> np.ndarray:
    """Of each byte: 1 to 36 for letters and digits, 37 to 62 for what tells letters beyond ASCII apart, 0 for signs, which are passed over."""
    table = np.zeros(256, np.int32)
    for i, c in enumerate(LETTERS):
        table[ord(c)] = i + 1
    table[0x80:0xC0] = 37 + np.arange(64) % 26
    return table


_TABLE = _symbols()


@lru_cache(maxsize=WINDOW + 1)
def _scale(size: int) -> float:
    """Norm of a word of ``size`` different characters."""
    gaps = np.arange(2, size)
    return float(np.sqrt(((size - gaps) * (gaps - 1) * DECAY ** (2.0 * (gaps + 1))).sum())) or 1.0


def table_margins(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum over the subsequences of each row (words of one length, as symbols) of their discounted weights, scaled."""
    size = rows.shape[1]
    total = np.zeros(len(rows), np.float32)
    for i in range(size - 2):
        for j in range(i + 1, size - 1):
            base = (rows[:, i] * SYMBOLS + rows[:, j]) * SYMBOLS
            fall = (DECAY ** (np.arange(j + 1, size) - i + 1.0)).astype(np.float32)
            total += weights.take(base[:, None] + rows[:, j + 1 :]) @ fall
    return total / np.float32(_scale(size))


def subsequences(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a row per word of one length) and scaled weights of all subsequences of three characters."""
    size = rows.shape[1]
    at = np.array([(i, j, k) for i in range(size) for j in range(i + 1, size) for k in range(j + 1, size)], np.int64).reshape(-1, 3)
    code = (rows[:, at[:, 0]] * SYMBOLS + rows[:, at[:, 1]]) * SYMBOLS + rows[:, at[:, 2]]
    return code, (DECAY ** (at[:, 2] - at[:, 0] + 1.0) / _scale(size)).astype(np.float32)


@dataclass
class Words:
    """The distinct words of some texts and where they stand: tokens of text i are ``offsets[i]`` to ``offsets[i + 1]``."""

    spelling: np.ndarray  # symbols of all pieces, one after another
    begin: np.ndarray  # of each piece
    size: np.ndarray
    owner: np.ndarray  # the distinct word of each piece
    count: int  # distinct words
    token: np.ndarray  # the distinct word of each token
    offsets: np.ndarray
    spelled: list[tuple[int, int]]  # text and distinct word of words spelled letter by letter

    def margins(self, weights: np.ndarray) -> np.ndarray:
        """Of each distinct word: its own, or that of its worst window; ``LEAST`` for words of under three characters."""
        out = np.full(self.count, LEAST, np.float32)
        for size in np.unique(self.size[self.size >= ORDER]):
            which = np.flatnonzero(self.size == size)
            for some in np.array_split(which, -(-len(which) * int(size) // (1 << 17))):
                rows = self.spelling[self.begin[some][:, None] + np.arange(size)]
                np.maximum.at(out, self.owner[some], table_margins(rows, weights))
        return out

    def word(self, number: int) -> bytes:
        """The worst-case spelling of a distinct word, as symbols."""
        first = int(np.searchsorted(self.owner, number))
        return self.spelling[self.begin[first] : self.begin[first] + self.size[first]].astype(np.uint8).tobytes()


def read_words(held: list[bytes]) -> Words:
    h, offsets, starts, ends, data = _text.words(held)
    _, first, token = np.unique(h, return_index=True, return_inverse=True)
    symbol = _TABLE[data]
    place = np.concatenate(([0], np.cumsum(symbol > 0)))
    stream = symbol[symbol > 0]
    begin, size = place[starts[first]], place[ends[first]] - place[starts[first]]
    spelled, extra, at = [], [], len(stream)
    letter = (ends - starts == 1) & (data[starts] >= 97) & (data[starts] <= 122)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], letter.astype(np.int8), [0]))))
    text = np.repeat(np.arange(len(held)), np.diff(offsets))
    more_begin, more_size = [], []
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        for cut in np.split(np.arange(a, b), 1 + np.flatnonzero(np.diff(text[a:b]))):
            if len(cut) >= ORDER:
                spelled.append((int(text[cut[0]]), len(first) + len(spelled)))
                extra.append(_TABLE[data[starts[cut]]])
                more_begin.append(at)
                more_size.append(len(cut))
                at += len(cut)
    begin = np.concatenate((begin, np.array(more_begin, np.int64))).astype(np.int64)
    size = np.concatenate((size, np.array(more_size, np.int64))).astype(np.int64)
    windows = np.where(size > WINDOW, -(-(size - WINDOW) // (WINDOW // 2)) + 1, 1)
    owner = np.repeat(np.arange(len(size)), windows)
    step = (np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)) * (WINDOW // 2)
    # The last window ends with the word.
    step = np.minimum(step, np.maximum(size[owner] - WINDOW, 0))
    return Words(np.concatenate((stream, *extra)) if extra else stream, begin[owner] + step, np.minimum(size[owner], WINDOW), owner, len(size), token, offsets, spelled)


class Model:
    """weights: the folded table, or none; bias; and the logistic's weights of margin and share, and its offset."""

    def __init__(self, weights: np.ndarray | None, bias: float, logistic: tuple[float, float, float]) -> None:
        self.weights, self.bias, self.logistic = weights, bias, logistic

    def seen(self, held: list[bytes]) -> np.ndarray:
        """A row per text: margin of the worst word, and the square root of the share of words beyond the margin."""
        out = np.zeros((len(held), 2))
        out[:, 0] = LEAST
        if self.weights is None:
            return out
        words = read_words(held)
        own = np.maximum(words.margins(self.weights) + np.float32(self.bias), np.float32(LEAST))
        margin = own[words.token]
        full = np.flatnonzero(np.diff(words.offsets))
        if len(full):
            begin = words.offsets[full]
            out[full, 0] = np.maximum.reduceat(margin, begin)
            out[full, 1] = np.add.reduceat((margin > 0).astype(np.float64), begin) / np.diff(words.offsets)[full]
        for text, word in words.spelled:
            out[text, 0] = max(out[text, 0], own[word])
        out[:, 1] = np.sqrt(out[:, 1])
        return out

    def score(self, seen: np.ndarray) -> np.ndarray:
        a, b, c = self.logistic
        return 1 / (1 + np.exp(-np.clip(a * seen[:, 0] + b * seen[:, 1] + c, -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """id, text and y of at most ``sample`` labelled rows of each label for which ``usable`` (a condition on ``id``) holds; equal texts once."""
    known = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & usable)
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    some = [known.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (0, 1)]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(some[0].union(some[1])), "id")  # at most 2 * sample rows
    return rows.groupBy("y", "text").agg(F.min("id").alias("id"))


def _sampled_words(rows: DataFrame) -> tuple[list[tuple[str, int]], list[str], list[str]]:
    """Telling words with the number of their toxic texts, the commonest clean words, and clean words by their hash."""
    word = F.explode(F.array_distinct(F.transform(F.split(F.lower("text"), r"[\x09-\x0D\x20]+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]+", ""))))
    n1, n0 = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    seen = rows.select("id", "y", word.alias("w")).where((F.char_length("w") >= ORDER) & (F.char_length("w") <= WINDOW))
    seen = checkpointed(seen.groupBy("w").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")))
    share = (F.col("a") + F.col("b")) / float(max(n1 + n0, 1))
    cell = lambda seen, of, p: F.when(seen > 0, seen * F.log(seen / (of * p))).otherwise(0.0)
    gain = cell(F.col("a"), n1, share) + cell(F.col("b"), n0, share) + cell(n1 - F.col("a"), n1, 1 - share) + cell(n0 - F.col("b"), n0, 1 - share)
    # By chance one word of those in enough texts is expected to pass.
    bound = NormalDist().inv_cdf(1 - 0.5 / max(2, seen.where(f"a + b >= {LEAST_DOCS}").count())) ** 2 / 2
    telling = seen.where(f"a >= {LEAST_DOCS} and a * {max(n0, 1)} > 2 * b * {max(n1, 1)}").where(gain >= bound).orderBy(gain.desc(), "w").limit(LANDMARKS)
    clean = seen.where(f"b > 0 and a * {max(n0, 1)} <= b * {max(n1, 1)}").select("w", "b")
    common = clean.orderBy(F.col("b").desc(), "w").limit(COMMON)
    other = clean.orderBy(F.xxhash64("w"), "w").limit(NEGATIVES)
    return [(r["w"], r["a"]) for r in telling.collect()], [r["w"] for r in common.collect()], [r["w"] for r in other.collect()]


def _spelling(word: str) -> bytes:
    s = _TABLE[np.frombuffer(word.encode("utf-8", "surrogatepass"), np.uint8)]
    return s[s > 0][:WINDOW].astype(np.uint8).tobytes()


class Landmarks:
    """Words (as symbols) with the inverse square root of their kernel matrix."""

    def __init__(self, words: list[bytes]) -> None:
        self.words = words
        code, weight, of = [], [], []
        for j, w in enumerate(words):
            c, v = subsequences(np.frombuffer(w, np.uint8).astype(np.int64)[None, :])
            code.append(c[0])
            weight.append(v)
            of.append(np.full(len(v), j))
        self.code, self.weight, self.of = np.concatenate(code), np.concatenate(weight), np.concatenate(of)
        by = np.argsort(self.code, kind="stable")
        self.code, self.weight, self.of = self.code[by], self.weight[by], self.of[by]
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(self.code, minlength=SYMBOLS**ORDER))))
        gram = self.kernel(words).astype(np.float64)
        value, vector = np.linalg.eigh((gram + gram.T) / 2)
        self.root = (vector / np.sqrt(np.maximum(value, 1e-3))) @ vector.T

    def kernel(self, words: list[bytes]) -> np.ndarray:
        """Of each word (as symbols, longest ``WINDOW``) with all landmarks."""
        k = len(self.words)
        out = np.zeros((len(words), k), np.float32)
        for i, w in enumerate(words):
            if len(w) < ORDER:
                continue
            code, weight = subsequences(np.frombuffer(w, np.uint8).astype(np.int64)[None, :])
            first, n = self.begin[code[0]], self.begin[code[0] + 1] - self.begin[code[0]]
            entry = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            out[i] = np.bincount(self.of[entry], np.repeat(weight, n) * self.weight[entry], k)
        return out

    def folded(self, w: np.ndarray) -> np.ndarray:
        """The table of weights of subsequences for the machine ``w``."""
        alpha = self.root @ w
        return np.bincount(self.code, self.weight * alpha[self.of], SYMBOLS**ORDER).astype(np.float32)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept of the linear machine of squared hinge loss, by Newton's steps on the rows within the margin; ``x`` is read in blocks."""
    n, k = x.shape
    w, ridge = np.zeros(k + 1), np.append(np.ones(k), 1e-3)
    margin = lambda v: x @ v[:-1].astype(x.dtype) + v[-1]
    loss = lambda v: (ridge * v * v).sum() / 2 + cost / 2 * (weight * np.maximum(0, 1 - y * margin(v)) ** 2).sum()
    for _ in range(40):
        gap = 1 - y * margin(w)
        push = np.where(gap > 0, weight, 0.0)
        g, hess = ridge * w, np.diag(ridge)
        for i in range(0, n, 2048):
            on = i + np.flatnonzero(push[i : i + 2048])
            some = np.column_stack((x[on], np.ones(len(on)))).astype(np.float64)
            g = g - cost * (some.T @ (push * y * gap)[on])
            hess += cost * (some.T * push[on]) @ some
        step = np.linalg.solve(hess, g)
        t, now = 1.0, loss(w)
        while t > 1e-4 and loss(w - t * step) > now - 1e-4 * t * (g @ step):
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-5:
            break
    return w[:-1], float(w[-1])


def logistic_fit(seen: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Weights of both columns, not below zero, and offset of the logistic that maps them to probabilities; smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    use = [0, 1]
    while True:
        x = np.column_stack((*(seen[:, c] for c in use), np.ones(len(y))))
        v, ridge = np.zeros(x.shape[1]), np.append(np.full(len(use), 1e-2), 1e-6)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
            step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + np.diag(ridge), x.T @ (p - goal) + ridge * v)
            v = v - np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        low = [c for c, s in zip(use, v, strict=False) if s < 0]
        if not low:
            out = dict(zip(use, v, strict=False))
            return float(out.get(0, 0.0)), float(out.get(1, 0.0)), float(v[-1])
        use = [c for c in use if c not in low]


def _worst(rows: DataFrame, weights: np.ndarray, bias: float) -> pd.DataFrame:
    """id, y, margin and spelling of the word by which sentences count: of toxic texts the worst, of clean ones up to ``MINED`` within the margin."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first, held in _text.chunks(b["text"].tolist()):
                words, part, out = read_words(held), b.iloc[first : first + len(held)], []
                own = words.margins(weights) + np.float32(bias)
                spelled: dict[int, list[int]] = {}
                for text, word in words.spelled:
                    spelled.setdefault(text, []).append(word)
                for i, (key, y) in enumerate(zip(part["id"], part["y"], strict=True)):
                    there = np.unique(np.concatenate((words.token[words.offsets[i] : words.offsets[i + 1]], np.array(spelled.get(i, []), np.int64))))
                    there = there[np.argsort(-own[there], kind="stable")][: 1 if y else MINED]
                    out += [(key, y, float(own[t]), words.word(t)) for t in there if y or own[t] > -1]
                yield pd.DataFrame(out, columns=["id", "y", "margin", "word"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(trimmed(read), f"id {kind}, y int, margin float, word binary").toPandas()  # at most (1 + MINED) * SAMPLE words


def train(rows: DataFrame) -> Model:
    """Fit on rows of id, text, y. A fifth of them, by a hash of the id, is kept out for the scores' scale."""
    rows = checkpointed(rows.select("id", "text", F.col("y").cast("int").alias("y"), (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(5)) == 0).alias("out")))
    count = {(r["y"], r["out"]): r["n"] for r in rows.groupBy("y", "out").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, zeros = (sum(n for (y, _), n in count.items() if y == k) for k in (1, 0))
    share = ones / (ones + zeros) if ones + zeros else 0.5
    none = Model(None, 0.0, (0.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6)))))
    if not ones or not zeros:
        return none
    apart = all(count.get((y, out), 0) >= 5 for y in (0, 1) for out in (True, False))
    inner = rows.where("not out") if apart else rows
    telling, common, other = _sampled_words(inner)
    if not telling:
        return none
    clean = sorted({_spelling(w) for w in (*common, *other)} - {_spelling(w) for w, _ in telling})
    marks = Landmarks(sorted({s for w, _ in telling if len(s := _spelling(w)) >= ORDER} | {s for w in (*common, *other[: 2 * COMMON]) if len(s := _spelling(w)) >= ORDER}))
    bad = {}
    for w, n in telling:
        bad[_spelling(w)] = bad.get(_spelling(w), 0) + n
    good = dict.fromkeys((w for w in clean if len(w) >= ORDER), 1.0)
    row: dict[bytes, int] = {}
    x = np.zeros((0, len(marks.words)), np.float32)
    for turn in range(ROUNDS + 1):
        new = [w for w in (*sorted(bad), *sorted(good)) if w not in row]
        row.update(zip(new, range(len(row), len(row) + len(new)), strict=True))
        x = np.concatenate((x, marks.kernel(new) @ marks.root.astype(np.float32)))
        # Rows of words that a later round no longer takes weigh nothing.
        y, weight = -np.ones(len(x)), np.zeros(len(x))
        for w, n in good.items():
            weight[row[w]] = n
        for w, n in bad.items():
            y[row[w]], weight[row[w]] = 1.0, n
        # Both sides weigh as many as there are words of clean texts.
        weight = np.where(y > 0, weight * len(good) / max(weight[y > 0].sum(), 1e-9), weight)
        w, bias = fit(x, y, weight)
        weights = marks.folded(w)
        if turn == ROUNDS:
            break
        worst = _worst(inner, weights, bias).sort_values(["id", "margin", "word"])
        found = worst[(worst["y"] == 1) & (worst["margin"] > -0.5)]
        if len(found):
            bad = {bytes(k): float(n) for k, n in found.groupby("word").size().items()}
        for k, n in worst[worst["y"] == 0].groupby("word").size().items():
            if bytes(k) not in bad or bad[bytes(k)] < n:
                good[bytes(k)] = max(good.get(bytes(k), 0.0), float(n))
    plain = Model(weights, bias, (1.0, 0.0, 0.0))
    seen = _seen(rows.where("out") if apart else rows, plain).sort_values("id")
    return Model(weights, bias, logistic_fit(np.stack(seen["seen"].to_numpy()).astype(np.float64), np.where(seen["y"] > 0, 1.0, -1.0)))


def _seen(rows: DataFrame, model: Model) -> pd.DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first, held in _text.chunks(b["text"].tolist()):
                part = b.iloc[first : first + len(held)]
                yield pd.DataFrame({"id": part["id"].array, "y": part["y"].array, "seen": list(model.seen(held).astype(np.float32))})

    return rows.mapInPandas(trimmed(read), f"id {rows.schema['id'].dataType.simpleString()}, y int, seen array<float>").toPandas()  # at most 2 * SAMPLE rows


def scores(docs: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted. ``held_out``: a condition on the id column."""

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first, held in _text.chunks(b["text"].tolist()):
                p = model.score(model.seen(held))
                part = b.iloc[first : first + len(held)]
                yield pd.DataFrame({"id": part["id"].array, "held_out": part["held_out"].array, "score": p, "predicted": (p >= 0.5).astype(np.int32)})

    own = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return own.mapInPandas(trimmed(scored), f"id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the texts predicted toxic. All columns stay as they are. A model that has seen labels of one kind only, or none, rejects nothing."""
    if model.weights is None:
        return docs

    @F.pandas_udf("int")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in trimmed(iter)(batches):
            got = [model.score(model.seen(held)) >= 0.5 for _, held in _text.chunks(b.tolist())]
            yield pd.Series(np.concatenate(got).astype(np.int32) if got else np.zeros(0, np.int32))

    return docs.where(toxic(F.col(text_col)) == 0)
