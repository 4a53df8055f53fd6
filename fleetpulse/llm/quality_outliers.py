"""Quality rules: base limits, then robust multivariate outliers of text statistics within a language and source.

Six statistics of a text (length of words, symbols, repeated lines, repeated windows and words, punctuation, capitals) are
transformed to logarithms, so that ratios count, and written as whole thousandths.  Each group of texts of one language
and source gets minimum-covariance-determinant estimates: of three starts (spread by medians, Euclidean norm, largest
component around the medians), concentration steps take the half of the texts that is nearest by Mahalanobis distance
and fit mean and covariance again until no determinant falls; the least determinant wins.  A text is rejected if its
squared distance, made consistent for the normal law, is beyond the chi-square quantile of TAIL.

* The nearest half is found from counts by distance class (BINS to a power of e), so nothing is sorted or gathered: a
  step is one aggregation by (group, start, class) with map-side sums, whatever a group holds.
* Thousandths make every sum a whole number: results don't depend on partitions or on which executors were lost.
* A short text says little, so its deviations from the group's medians are multiplied by sqrt(n / (n + SOFT)) words.
* LEAST_SPREAD is added to the covariances' diagonals: half of the texts have no symbols at all, and copies may be
  more than half of a group, so the deviations that any clean text may have are fixed values.
* Groups of fewer than MIN_GROUP texts are pooled by language, and pools below that are pooled over all languages.

Defined results: null texts are empty; a null language or source is a value of its own; empty texts and all others
below MIN_WORDS words fail the base rule and take no part in the estimates; rows of one id, repeated rows and ties are
judged one by one (rows with equal columns get equal verdicts); an empty table gives no rows; columns other than
doc_id, text, lang and source don't matter.  Texts of any length are read whole, in batches bounded by bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.common import HOT_KEYS, discard, join_hot, split_words, stage

#: Base rule: least words, window of words, share of words in repeated windows (per cent).
MIN_WORDS, WINDOW, MAX_REPEATED = 20, 8, 30

#: Statistics, and the deviation (thousandths) that is always allowed for.
LEAST_SPREAD = {"length": 100, "symbols": 200, "lines": 300, "repeats": 300, "punctuation": 300, "capitals": 200}
P = len(LEAST_SPREAD)

#: Share of texts beyond the cut under the normal law; words that halve the square of a deviation; texts of a group.
TAIL, SOFT, MIN_GROUP = 1e-5, 50, 100

#: Distance classes to a power of e; most concentration steps (each one's estimate is an estimate of half of the texts).
BINS, STEPS = 32, 20

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_capitals", "n_stutter"]
SLICE_BYTES = 4 << 20


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about SLICE_BYTES of text (one text at least)."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES)))
        yield batch.slice(at, to - at)
        at = to


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs."""
    return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1]


def repeated_words(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of every text that lie in a WINDOW which its text has twice or more."""
    n, texts = len(codes), len(offsets) - 1
    if n < WINDOW:
        return np.zeros(texts, np.int64)
    ids, width = codes.astype(np.int64), 1
    while width < WINDOW:  # numbers of windows twice as wide, from pairs
        ids, width = _pairs(ids[:-width], ids[width:]), 2 * width
    text = np.repeat(np.arange(texts), np.diff(offsets))
    inside = np.flatnonzero(text[: len(ids)] == text[WINDOW - 1:])
    _, back, seen = np.unique(text[inside] * (int(ids.max(initial=0)) + 1) + ids[inside], return_inverse=True, return_counts=True)
    starts = inside[seen[back] > 1]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
    return covered[offsets[1:]] - covered[offsets[:-1]]


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if texts.offset:  # some kernels misread slices
        texts = pa.concat_arrays([texts])
    words, offsets = split_words(texts)
    codes = np.asarray(words.indices).astype(np.int64)
    chars = np.asarray(pc.utf8_length(words.dictionary)).astype(np.int64)
    same = np.zeros(len(codes), bool)
    same[1:] = codes[1:] == codes[:-1]
    same[offsets[:-1][offsets[:-1] < len(codes)]] = False  # the first word of a text follows none
    lines = pc.split_pattern(texts, "\n")
    line_offsets = np.asarray(lines.offsets).astype(np.int64)
    coded = lines.flatten().dictionary_encode()
    filled = np.asarray(pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]")) if len(coded.dictionary) else np.zeros(0, bool)
    line, owner = np.asarray(coded.indices).astype(np.int64), np.repeat(np.arange(len(texts)), np.diff(line_offsets))
    has = filled[line] if len(line) else np.zeros(0, bool)
    n_lines = np.bincount(owner[has], minlength=len(texts))
    kinds = np.unique(owner[has] * (len(coded.dictionary) + 1) + line[has]) // (len(coded.dictionary) + 1)
    count = lambda pattern: np.asarray(pc.count_substring_regex(texts, pattern)).astype(np.int64)
    return {
        "n_words": np.diff(offsets), "word_chars": _per_text(chars[codes] if len(codes) else codes, offsets), "n_symbols": count(r"[#*$%&|<>]"),
        "n_dup_lines": n_lines - np.bincount(kinds, minlength=len(texts)), "n_repeat_words": repeated_words(codes, offsets),
        "n_lines": n_lines, "n_marks": count(r"[.,;:!?]"), "n_capitals": count(r"\p{Lu}"), "n_stutter": _per_text(same, offsets),
    }


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch, 1):
            counts = text_counts(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), *[pa.array(counts[c], pa.int64()) for c in COUNTS]], names=["doc_id", "lang", "source", *COUNTS])


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed and the vector x0.. of transformed statistics, in thousandths."""
    counted = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
               .mapInArrow(_counted, "doc_id bigint, lang string, source string, " + ", ".join(f"{c} bigint" for c in COUNTS)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    words, lines, chars = (F.greatest(c, F.lit(1)) for c in ("n_words", "n_lines", "word_chars"))
    share = lambda n, of, unit: F.log1p(100 * F.col(n) / of / unit)  # noqa: E731  unit: per cent that count as one
    logs = [F.log(F.col("word_chars") / words), share("n_symbols", words, 5), share("n_dup_lines", lines, 10), share("n_again", words, 10), share("n_marks", words, 10), share("n_capitals", chars, 5)]
    again = F.col("n_repeat_words") + 3 * F.col("n_stutter")  # a word right after itself counts like three in repeated windows
    return counted.select("*", failed.alias("base_failed"), again.alias("n_again")).select("*", *[F.coalesce(F.round(1000 * x), F.lit(0)).cast("bigint").alias(f"x{i}") for i, x in enumerate(logs)]).drop("n_again")


def _grouped(stats: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(stats with ``grp``, (grp, n) of the texts that pass the base rule, number of these texts)."""
    keys = [F.coalesce("lang", F.lit("")).alias("l"), F.col("lang").isNull().alias("l0"), F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("s0")]
    names = ["l", "l0", "s", "s0"]
    keyed = stats.select("*", *keys)
    sizes = keyed.groupBy(*names).agg(F.sum((~F.col("base_failed")).cast("bigint")).alias("n"), F.count(F.lit(1)).alias("rows"))
    small = F.col("n") < MIN_GROUP
    pools = sizes.filter(small).groupBy("l", "l0").agg((F.sum("n") < MIN_GROUP).alias("thin"))
    named = sizes.join(pools, ["l", "l0"], "left").select(
        *names, "n", "rows", F.when(~small, F.to_json(F.struct("l", "l0", "s", "s0"))).when(~F.col("thin"), F.to_json(F.struct("l", "l0"))).otherwise("").alias("grp"))
    named = stage(named, "groups")
    total = named.agg(F.sum("rows").alias("rows"), F.sum("n").alias("n")).first()
    out = join_hot(keyed, named.drop("n"), names, "rows", max(total["rows"] or 0, HOT_KEYS)).drop(*names, "rows")
    return out, named.groupBy("grp").agg(F.sum("n").alias("n")), total["n"] or 0


Y = [f"y{i}" for i in range(P)]
MOMENTS = [(i, j) for i in range(P) for j in range(i, P)]
SUMS = [*[(f"s{i}", Y[i], None) for i in range(P)], *[(f"q{i}_{j}", Y[i], Y[j]) for i, j in MOMENTS]]


def _distance() -> Column:
    """Squared Mahalanobis distance of y from ``mu`` by the inverse ``inv`` (row by row)."""
    off = [F.col(Y[i]) - F.col("mu")[i] for i in range(P)]
    out = F.lit(0.0)
    for i, j in MOMENTS:
        out = out + (1 if i == j else 2) * off[i] * off[j] * F.col("inv")[i * P + j]
    return F.greatest(out, F.lit(0.0))


def _fitted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean, inverse covariance and log determinant of every (grp, start) from its sums."""
    floor = np.diag(np.array(list(LEAST_SPREAD.values()), float) ** 2)
    for frame in frames:
        out = []
        for row in frame.to_dict("records"):
            n = int(row["n"])
            s = [int(row[f"s{i}"]) for i in range(P)]
            cov = floor.copy()
            for i, j in MOMENTS:
                cov[i, j] = cov[j, i] = cov[i, j] + (int(row[f"q{i}_{j}"]) * n - s[i] * s[j]) / (n * n)  # whole numbers up to the division
            out.append((row["grp"], row["start"], [x / n for x in s], np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
        yield pd.DataFrame(out, columns=["grp", "start", "mu", "inv", "det"])


MODEL = "grp string, start int, mu array<double>, inv array<double>, det double"


def _half(distances: DataFrame, sizes: DataFrame) -> DataFrame:
    """The model of the nearest half by ``d``, from sums by distance class."""
    classes = distances.withColumn("bin", F.floor(F.log(F.col("d") + 1e-9) * BINS).cast("int"))
    summed = classes.groupBy("grp", "start", "bin").agg(F.count(F.lit(1)).alias("m"), *[F.sum(F.col(a) * F.col(b) if b else F.col(a)).alias(name) for name, a, b in SUMS])
    before = F.sum("m").over(Window.partitionBy("grp", "start").orderBy("bin")) - F.col("m")
    near = summed.withColumn("before", before).join(sizes, "grp").filter(2 * F.col("before") < F.col("n") + P + 1)
    return near.groupBy("grp", "start").agg(F.sum("m").alias("n"), *[F.sum(name).alias(name) for name, _, _ in SUMS]).mapInPandas(_fitted, MODEL)


def _chi2(p: int, x: float) -> float:
    """Chi-square distribution function for an even number of degrees."""
    term, total = 1.0, 1.0
    for k in range(1, p // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def _quantile(p: int, share: float) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(p, mid) < share else (low, mid)
    return high


#: The half's covariance is too small by this factor under the normal law; squared distances above CUT are outliers.
CONSISTENT = 0.5 / _chi2(P + 2, _quantile(P, 0.5))
CUT = _quantile(P, 1 - TAIL)


def covariance_estimates(rows: DataFrame, sizes: DataFrame, total: int) -> DataFrame:
    """(grp, mu, inv) of each group's minimum-covariance-determinant estimate over the vectors y0.. of ``rows``."""
    meet = lambda df, model: join_hot(df, model.join(sizes, "grp"), ["grp"], "n", max(total, HOT_KEYS))
    spread = stage(rows.groupBy("grp").agg(F.array(*[F.percentile(F.abs(y), 0.5) for y in Y]).alias("mad")), "spread")
    least = list(LEAST_SPREAD.values())
    first = meet(rows, spread)
    scaled = [F.col(y) / least[i] for i, y in enumerate(Y)]
    by_mad = sum((F.pow(F.col(y) / F.greatest(F.col("mad")[i] * 1.4826, F.lit(float(least[i]))), 2) for i, y in enumerate(Y)), F.lit(0.0))
    starts = F.array(by_mad, sum((F.pow(s, 2) for s in scaled), F.lit(0.0)), F.pow(F.greatest(*[F.abs(s) for s in scaled]), 2))
    model = stage(_half(first.select("grp", *Y, F.posexplode(starts).alias("start", "d")), sizes), "model")
    for _ in range(STEPS):
        after = _half(meet(rows, model.groupBy("grp").agg(F.collect_list(F.struct("start", "mu", "inv")).alias("starts")))  # three models a group
                      .select("grp", *Y, F.explode("starts").alias("m")).select("grp", *Y, "m.start", "m.mu", "m.inv").withColumn("d", _distance()).drop("mu", "inv"), sizes)
        best = F.max_by(F.struct("mu", "inv", "det"), F.struct(-F.col("det"), "age"))
        both = model.withColumn("age", F.lit(1)).unionByName(after.withColumn("age", F.lit(0)))
        new = stage(both.groupBy("grp", "start").agg(best.alias("m"), (F.min("det") < F.max(F.when(F.col("age") == 1, F.col("det")))).alias("fell")).select("grp", "start", "m.*", "fell"), "model")
        discard(model)
        model = new.drop("fell")
        model.staged_at = new.staged_at
        if not new.filter("fell").limit(1).count():
            break
    out = stage(model.groupBy("grp").agg(F.max_by(F.struct("mu", "inv"), F.struct(-F.col("det"), -F.col("start"))).alias("m")).select("grp", "m.*"), "estimates")
    discard(model, spread)
    return out


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Every document with its counts, base_failed, ``distance`` (squared, null where the base rule fails) and kept."""
    stats, sizes, total = _grouped(stage(text_statistics(docs), "statistics"))
    stats = stage(stats, "grouped")
    passed = stats.filter(~F.col("base_failed"))
    medians = passed.groupBy("grp").agg(*[F.percentile(f"x{i}", 0.5).alias(f"m{i}") for i in range(P)])
    sizes = stage(sizes.filter("n > 0"), "sizes")
    soft = F.sqrt(F.col("n_words") / (F.col("n_words") + SOFT))
    centred = join_hot(passed, medians.join(sizes, "grp"), ["grp"], "n", max(total, HOT_KEYS))
    rows = stage(centred.select("doc_id", "grp", *COUNTS, *[F.round((F.col(f"x{i}") - F.col(f"m{i}")) * soft).cast("bigint").alias(y) for i, y in enumerate(Y)]), "deviations")
    model = covariance_estimates(rows, sizes, total)
    judged = join_hot(rows, model.join(sizes, "grp"), ["grp"], "n", max(total, HOT_KEYS)).select("doc_id", *COUNTS, F.lit(False).alias("base_failed"), (_distance() / CONSISTENT).alias("distance"))
    rest = stats.filter("base_failed").select("doc_id", *COUNTS, "base_failed", F.lit(None).cast("double").alias("distance"))
    return judged.unionByName(rest).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(False)))
