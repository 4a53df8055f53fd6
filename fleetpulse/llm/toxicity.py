"""Toxicity: a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks.

Sentences are cut into tokens; a token's features are all its character subsequences of three with a span of at most
``SPAN``, weighted ``DECAY ** span`` ("idiot", "idi-ot" and "i.d.i.o.t" share most of them).  The kernel is the cosine of
those features.  Landmarks are training tokens; tokens are mapped to K(x, L) K(L, L)^-1/2 and a linear machine is
trained there.  Its decision is a weighted sum of kernels with landmarks, hence one weight for every subsequence that a
landmark has: scoring is a table look-up and never depends on the number of landmarks.  A sentence scores as its worst
token, a text as its worst sentence, put through a logistic curve fitted on the training texts.

Training tokens come from labelled sentences: a greedy cover picks the tokens that explain most toxic texts that no
earlier pick explains and that clean texts lack; tokens of clean texts are the other class, and those that the first
machine gets most wrong are added before the second one is trained.  The fit uses at most ``MAX_TRAIN`` labelled texts of
each class, those of the least id checksum; everything scored is the whole text.

Edge cases: null and empty texts score as the empty text; rows without a label don't train; without toxic or without
clean training rows every text scores 0; labels are matched by id, repeated label rows count as toxic if one is; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import SPACE_RE, text_of

#: Labelled texts of each class that the fit reads at most.
MAX_TRAIN = 1000
SPAN, DECAY = 5, 0.7
LANDMARKS = 160
WINDOW, STEP = 24, 12
#: Decisions up to here are clean by most of the machine's margin: the fit doesn't tell them apart, and the cut between
#: the classes never lies below.  Scores do tell them apart.
CLEAN = -0.6
#: Slopes that the logistic curve is chosen from.
SLOPES = np.geomspace(0.5, 64.0, 200)
SENTENCE_RE = re.compile(r"[.!?]+[\x20\x09-\x0D]+|\n+")
TOKEN_RE = re.compile(r"[^\x20\x09-\x0D]+")

#: Character codes: 0 outside, 1 start, 2 end, then a-z, digits, letters beyond ASCII by their low bits, the rest.
_A, _DIGIT, _WIDE, _OTHER, CODES = 3, 29, 30, 62, 63
#: Offsets of the second and third character from the first one.
PAIRS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def _code_table() -> np.ndarray:
    """Code by code point, for all up to 0xFFFF; beyond that the same rule holds by the low bits."""
    o = np.arange(1 << 16)
    out = np.where(o >= 0xC0, _WIDE + o % 32, _OTHER)
    out[97:123] = _A + np.arange(26)
    out[48:58] = _DIGIT
    out[0] = 0
    return out.astype(np.int32)


CODE_OF = _code_table()


def _matrix(tokens: list[str]) -> np.ndarray:
    """Tokens of at most WINDOW characters as rows of codes between a start and an end mark, padded with 0."""
    points = np.array(tokens, f"<U{WINDOW}")
    length = np.char.str_len(points)
    width = max(1, int(length.max(initial=0)))
    points = points.view(np.uint32).reshape(len(tokens), WINDOW)[:, :width]
    rows = np.zeros((len(tokens), width + 2 + SPAN), np.int32)
    rows[:, 0] = 1
    rows[:, 1:width + 1] = np.where(points > 0xFFFF, _WIDE + points % 32, CODE_OF[points & 0xFFFF])
    rows[np.arange(len(tokens)), length + 1] = 2
    return rows


def windows(token: str) -> list[str]:
    """A token in overlapping windows; short ones are one window."""
    return [token] if len(token) <= WINDOW else [token[i:i + WINDOW] for i in range(0, len(token) - WINDOW + STEP, STEP)]


def joined(tokens: list[str]) -> list[str]:
    """Lower-case tokens; a run of single characters (i d i o t) also counts as one token."""
    out, run = [], []
    for t in [*tokens, "  "]:
        if len(t) == 1:
            run.append(t)
        else:
            if len(run) > 2:
                out.append("".join(run))
            run = []
            out.append(t)
    return out[:-1]


def _subsequences(rows: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each pair of offsets: the code of each subsequence (0 where a character is missing) and its weight."""
    width = rows.shape[1] - SPAN
    first = rows[:, :width]
    for a, b in PAIRS:
        x, y = rows[:, a:a + width], rows[:, b:b + width]
        yield np.where(y > 0, (first * CODES + x) * CODES + y, 0), DECAY ** (b + 1)  # y is the last of the three


def _features(tokens: list[str]) -> list[dict[int, float]]:
    """Unit feature vectors, as dictionaries."""
    out: list[dict[int, float]] = [{} for _ in tokens]
    for codes, weight in _subsequences(_matrix(tokens)):
        for f, row in zip(out, codes.tolist()):
            for c in row:
                if c:
                    f[c] = f.get(c, 0.0) + weight
    for f in out:
        norm = sum(v * v for v in f.values()) ** 0.5 or 1.0
        for k in f:
            f[k] /= norm
    return out


def _raw_scores(tokens: list[str], weights: np.ndarray) -> np.ndarray:
    """Sum of weights over each token's unit feature vector."""
    out = np.zeros(len(tokens))
    order = np.argsort([len(t) for t in tokens], kind="stable")
    for lo in range(0, len(tokens), 1024):
        block = order[lo:lo + 1024]
        rows = _matrix([tokens[i] for i in block])
        total = np.zeros(len(block))
        codes, vals = [], []
        for c, w in _subsequences(rows):
            total += w * weights[c].sum(axis=1)
            codes.append(c)
            vals.append(np.full(c.shape[1], w))
        flat = np.concatenate(codes, axis=1)
        by = np.argsort(flat, axis=1, kind="stable")
        flat = np.take_along_axis(flat, by, axis=1)
        v = np.where(flat > 0, np.concatenate(vals)[by], 0.0)
        new = np.ones(flat.shape, bool)
        new[:, 1:] = flat[:, 1:] != flat[:, :-1]
        sums = np.add.reduceat(v.ravel(), np.flatnonzero(new.ravel()))
        norm = np.sqrt(np.add.reduceat(sums * sums, np.concatenate(([0], np.cumsum(new.sum(axis=1))[:-1]))))
        out[block] = total / np.maximum(norm, 1e-9)
    return out


def _svm(x: np.ndarray, y: np.ndarray, rounds: int = 300, lam: float = 2e-3) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss and balanced classes, by accelerated gradient steps."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    x1 = np.hstack((x, np.ones((len(x), 1))))
    step = 1.0 / (2 * np.linalg.norm(x1 * np.sqrt(share)[:, None], 2) ** 2 + lam)
    w = z = np.zeros(x1.shape[1])
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x1 @ z))
        grad = -2 * x1.T @ (share * y * slack) + lam * np.append(z[:-1], 0)
        new = z - step * grad
        z = new + k / (k + 3) * (new - w)
        w = new
    return w[:-1], w[-1]


class ToxicModel:
    """Weights by subsequence, the machine's offset, and the logistic curve over a text's worst token."""

    def __init__(self, weights: np.ndarray, offset: float, slope: float, shift: float) -> None:
        self.weights, self.offset, self.slope, self.shift = weights, offset, slope, shift

    def worst(self, tokens: list[str]) -> np.ndarray:
        """The machine's decision for each token."""
        return _raw_scores(tokens, self.weights) + self.offset

    def curve(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -30, 30)))


def _sentence_tokens(text: str) -> set[str]:
    out: set[str] = set()
    for s in SENTENCE_RE.split(text.lower()):
        for t in joined(TOKEN_RE.findall(s)):
            out.update(windows(t.strip(".,;:!?\"'()") or t))
    return out


def _cover(toxic: list[set[str]], clean: Counter, rounds: int = 400) -> list[str]:
    """Tokens that explain toxic texts: again and again the one in most unexplained texts that clean ones lack."""
    where: dict[str, list[int]] = {}
    for i, s in enumerate(toxic):
        for t in s:
            if len(t) > 2 and not clean.get(t):
                where.setdefault(t, []).append(i)
    where = {t: d for t, d in where.items() if len(d) > 1}
    left, picked = set(range(len(toxic))), []
    count = {t: len(d) for t, d in where.items()}
    for _ in range(rounds):
        if not count or not left:
            break
        best = max(count, key=lambda t: (count[t], t))
        if count[best] < 2:
            break
        picked.append(best)
        gone = left.intersection(where[best])
        left -= gone
        for i in gone:
            for t in toxic[i]:
                if t in count:
                    count[t] -= 1
        del count[best]
    return picked


def fit(toxic: list[str], clean: list[str]) -> ToxicModel:
    zero = ToxicModel(np.zeros(CODES ** 3), -1.0, 1.0, -29.0)
    if not toxic or not clean:
        return zero
    bad, good = [_sentence_tokens(t) for t in toxic], [_sentence_tokens(t) for t in clean]
    seen = Counter(t for s in good for t in s)
    picked = _cover(bad, seen)
    if not picked:
        return zero
    ordinary = sorted(seen, key=lambda t: (pd.util.hash_array(np.array([t], object))[0], t))[:1500]
    rest: list[str] = []
    for _ in range(3):
        tokens = picked + ordinary + rest
        y = np.array([1.0] * len(picked) + [-1.0] * (len(tokens) - len(picked)))
        marks = picked[:LANDMARKS // 2] + (rest + ordinary)[:LANDMARKS // 2]
        f = _features(tokens)
        keys = {c: i for i, c in enumerate({c: None for m in _features(marks) for c in m})}

        def dense(vs: list[dict[int, float]]) -> np.ndarray:
            out = np.zeros((len(vs), len(keys)))
            for i, v in enumerate(vs):
                for c, a in v.items():
                    if c in keys:
                        out[i, keys[c]] = a
            return out

        land = dense(_features(marks))
        val, vec = np.linalg.eigh(land @ land.T)
        keep = val > 1e-6
        root = vec[:, keep] / np.sqrt(val[keep])
        w, offset = _svm(dense(f) @ land.T @ root, y)
        table = np.zeros(CODES ** 3)
        table[list(keys)] = land.T @ (root @ w)
        model = ToxicModel(table, offset, 1.0, 0.0)
        everyday = list(seen)
        s = np.maximum(model.worst(everyday), max(CLEAN, offset))
        hard = np.argsort(-s, kind="stable")[:400]
        known = {*ordinary, *rest}
        rest += [everyday[i] for i in hard if s[i] > -0.9 and everyday[i] not in known]

    def worst(sets: list[set[str]]) -> np.ndarray:
        flat = [t for s in sets for t in s]
        all_ = model.worst(flat) if flat else np.zeros(0)
        ends = np.cumsum([len(s) for s in sets])
        return np.array([all_[e - len(s):e].max() if s else offset for s, e in zip(sets, ends)])

    x = np.concatenate((worst(bad), worst(good)))
    y = np.array([1.0] * len(bad) + [0.0] * len(good))
    # the cut with the fewest errors, then the slope around it that fits best (targets kept off 0 and 1, as Platt does)
    order = np.argsort(x, kind="stable")
    xs, ys = np.maximum(x[order], max(CLEAN, offset)), y[order]
    wrong = np.concatenate(([0], np.cumsum(ys))) + (1 - ys).sum() - np.concatenate(([0], np.cumsum(1 - ys)))
    best = np.flatnonzero(wrong == wrong.min())
    k = int(best[len(best) // 2])
    cut = (xs[max(0, k - 1)] + xs[min(len(xs) - 1, k)]) / 2
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    loss = [np.sum(np.logaddexp(0, z) - target * z) for s in SLOPES for z in [np.clip(s * (x - cut), -30, 30)]]
    model.slope = float(SLOPES[int(np.argmin(loss))])
    model.shift = -model.slope * cut
    return model


def train(docs: DataFrame, labels: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel:
    """Fit on the labelled rows for which ``trains`` (over _id) holds, MAX_TRAIN of each class at most."""
    marked = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("_toxic"))
    chosen = None
    for kind in (1, 0):
        part = marked.filter((F.col("_toxic") == kind) & trains).orderBy(F.crc32(F.reverse(F.col("_id").cast("string"))), "_id").limit(MAX_TRAIN)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    fitted = rows.select("_id", "_text", "_toxic").repartition(1).mapInPandas(_fit_rows, "at array<int>, weights array<double>, offset double, slope double, shift double").first()
    return fit([], []) if fitted is None else ToxicModel(_dense(fitted["at"], fitted["weights"]), fitted["offset"], fitted["slope"], fitted["shift"])


def _fit_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bounded training rows (_id, _text, _toxic) are fitted in a task; the driver gets the weights only."""
    rows = sorted((i, t, k) for b in batches for i, t, k in zip(b["_id"], b["_text"], b["_toxic"]))
    if rows:
        model = fit(*(list(dict.fromkeys(t for _, t, k in rows if k == kind)) for kind in (1, 0)))
        at = np.flatnonzero(model.weights)
        yield pd.DataFrame([(at.tolist(), model.weights[at].tolist(), model.offset, model.slope, model.shift)], columns=["at", "weights", "offset", "slope", "shift"])


def _dense(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    weights = np.zeros(CODES ** 3)
    weights[np.asarray(at, np.int64)] = values
    return weights


def scorer(docs: DataFrame, model: ToxicModel):
    """A Pandas UDF text -> score.  The model is a table of fixed size, so it is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(
        (np.flatnonzero(model.weights), model.weights[model.weights != 0], model.offset, model.slope, model.shift))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, values, offset, slope, shift = shared.value
        own = ToxicModel(_dense(at, values), offset, slope, shift)
        for texts in batches:
            parts = [_batch_worst(pa.array(texts.iloc[k:k + 500], pa.large_string(), from_pandas=True), own) for k in range(0, len(texts), 500)]
            yield pd.Series(own.curve(np.concatenate(parts)) if parts else np.zeros(0))

    return score


def _batch_worst(texts: pa.Array, model: ToxicModel) -> np.ndarray:
    """The worst token's score of each text; distinct tokens of the batch are scored once."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    parts = pc.split_pattern_regex(low, SPACE_RE)
    offsets = np.asarray(parts.offsets).astype(np.int64)
    offsets -= offsets[0]
    coded = parts.flatten().dictionary_encode()
    codes = np.asarray(coded.indices).astype(np.int64)
    spelled = pc.utf8_trim(coded.dictionary, ".,;:!?\"'()").to_pylist()
    raw = coded.dictionary.to_pylist()
    per_token = np.full(len(raw), model.offset)
    short = [i for i, t in enumerate(spelled) if 0 < len(t) <= WINDOW]
    if short:
        per_token[short] = model.worst([spelled[i] for i in short])
    for i, t in enumerate(spelled):
        if len(t) > WINDOW:
            own = windows(t)
            per_token[i] = model.worst(own).max()
    out = np.full(len(low), model.offset)
    values = per_token[codes] if len(codes) else np.zeros(0)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.maximum.reduceat(values, offsets[full])
    # runs of single characters: only texts that have three in a row
    single = np.asarray(pc.equal(pc.utf8_length(coded.dictionary), 1))[codes] if len(codes) else np.zeros(0, bool)
    triple = np.flatnonzero(single[:-2] & single[1:-1] & single[2:]) if len(single) > 2 else np.zeros(0, int)
    for d in np.unique(np.searchsorted(offsets, triple, side="right") - 1):
        words = [raw[c] for c in codes[offsets[d]:offsets[d + 1]]]
        runs = [w for t in joined(words) if len(t) > 2 for w in windows(t)]
        if runs:
            out[d] = max(out[d], model.worst(runs).max())
    return out


def toxic_scores(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), scorer(docs, model)(F.col(text_col).cast("string")).alias("score"))
