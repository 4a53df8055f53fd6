"""PII by weak supervision, in DataFrame functions only.

Four base patterns (email, ip, card, phone) give spans that always stay.  For the rest, runs of 8 or more letters and
digits with at least one digit are candidates for the kind ``secret``.  Labelers vote on each candidate:

* regex: shapes of keys and digests; a gazetteer of key names just before it; context: an assignment or quote before
  it, a digit in its middle, and (against) all digits, or one capital word with a number;
* the votes of all candidates are counted by pattern (a few hundred patterns at most), expectation-maximisation
  estimates each labeler's reliability and the share of secrets from those counts;
* a logistic classifier over shape and context features is trained on the posteriors, also from counts by feature
  pattern, and decides each span.

Patterns run in the JVM.  Matches are marked with control characters, the text is cut there, and offsets are running
sums of the pieces' lengths; possessive quantifiers and look-behinds keep every pattern linear on long runs and match
what the plain patterns match.

Edge cases: a null text is the empty text; control characters U+0001 and U+0002 in a text are read as U+0003, which no
pattern matches; repeated rows get the same spans each; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.common import stage, text_of

OPEN, CLOSE, OTHER = "\u0001", "\u0002", "\u0003"
KINDS = ["email", "ip", "card", "phone", "secret"]
#: The base patterns, rewritten so that no run is scanned twice.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{8,}+",
}
#: A text without this can't match.
NEEDS = {"email": "@", "phone": "+"}
GAZETTEER = r"(?i)(?:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key)[\"']?\s*[=:]?\s*[\"']?$"
ROUNDS = 50
#: Characters before a span that the labelers see.
CONTEXT = 48


def _cut(text: Column, kind: str) -> Column:
    """The text cut before each match; the end of a match is marked."""
    cut = F.split(F.regexp_replace(text, PATTERNS[kind], OPEN + "$0" + CLOSE), OPEN, -1)
    return F.when(F.instr(text, NEEDS[kind]) > 0, cut).otherwise(F.array(text)) if kind in NEEDS else cut


def _pieces(cut: Column, kind: str) -> Column:
    """The cut text as (kind, i, characters, match, what the piece ends with); empty without a match."""
    none = F.array().cast("array<struct<kind:int,i:int,chars:int,match:string,tail:string>>")
    made = F.transform(cut, lambda x, i: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), (F.length(x) - F.when(i > 0, 1).otherwise(0)).alias("chars"),
        F.when(i > 0, F.substring_index(x, CLOSE, 1)).alias("match"),
        F.when(F.lit(kind == "secret"), F.right(F.substring_index(x, CLOSE, -1), F.lit(CONTEXT))).alias("tail")))
    return F.when(F.size(cut) > 1, made).otherwise(none)


def _luhn(digits: Column) -> Column:
    at = F.sequence(F.lit(1), F.length(digits))
    def part(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))
    return F.aggregate(at, F.lit(0), lambda a, i: a + part(i)) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    return (F.when(kind == 0, True).when(kind == 1, match.rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
            .when(kind == 2, _luhn(digits)).when(kind == 3, F.length(digits).between(8, 15)).otherwise(True))


def _votes(match: Column, before: Column) -> dict[str, Column]:
    """1 for a secret, -1 against, 0 for no opinion."""
    has = lambda r: match.rlike(r)
    return {
        "regex": F.when(has("^(?:AKIA|ASIA)[A-Z0-9]{12,}$") | has("^(?:[0-9a-f]{16,}|[0-9A-F]{16,})$") & has("[A-Fa-f]"), 1)
                  .when(has("^[a-zA-Z][a-z]*[0-9]{1,4}$"), -1).otherwise(0),
        "gazetteer": F.when(before.rlike(GAZETTEER), 1).otherwise(0),
        "context": F.when(before.rlike("[=:]\\s*[\"']?$"), 1).when(before.rlike("[A-Za-z,]\\s$"), 0).otherwise(0),
        "digits": F.when(has("^[0-9]+$"), -1).otherwise(0),
        "mixed": F.when((F.length(F.regexp_replace(match, "[^0-9]", "")) >= 4) & (F.length(match) >= 16) & has("[A-Za-z]"), 1)
                  .when(F.length(match) < 10, -1).otherwise(0),
    }


def _features(match: Column, before: Column) -> dict[str, Column]:
    """Yes-no features of a span; a pattern of them is one of at most 2 ** 8."""
    digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return {
        "long": flag(F.length(match) >= 16), "very_long": flag(F.length(match) >= 32), "few_digits": flag(digits * 8 < F.length(match)),
        "only_digits": flag(digits == F.length(match)), "hex": flag(match.rlike("^[0-9a-f]+$")), "capitals": flag(match.rlike("^[0-9A-Z]+$")),
        "assigned": flag(before.rlike("[=:]\\s*[\"']?$")), "named": flag(before.rlike(GAZETTEER)),
    }


def _reliabilities(patterns: list[tuple[tuple[int, ...], int]]) -> dict[tuple[int, ...], float]:
    """Posterior of each vote pattern by expectation-maximisation, started from the balance of votes."""
    if not patterns:
        return {}
    width = len(patterns[0][0])
    post = {v: 0.9 if sum(v) > 0 else 0.1 for v, _ in patterns}
    for _ in range(ROUNDS):
        mass = [sum(n * p for v, n in patterns for p in [post[v] if s else 1 - post[v]]) for s in (0, 1)]
        total = sum(mass)
        rate = {(s, j, x): (sum(n * (post[v] if s else 1 - post[v]) for v, n in patterns if v[j] == x) + (3.0 if x == (1 if s else -1) else 1.0)) / (mass[s] + 5.0)
                for s in (0, 1) for j in range(width) for x in (-1, 0, 1)}
        for v, _ in patterns:
            log = [math.log((mass[s] + 1) / (total + 2)) + sum(math.log(rate[s, j, x]) for j, x in enumerate(v)) for s in (0, 1)]
            post[v] = 1 / (1 + math.exp(max(-60.0, min(60.0, log[0] - log[1]))))
    return post


def _logistic(rows: list[tuple[tuple[int, ...], float, float]]) -> list[float]:
    """Weights and offset fitted to (features, soft positives, count) by gradient steps with a small penalty."""
    if not rows:
        return []
    width = len(rows[0][0])
    w = [0.0] * (width + 1)
    total = sum(n for _, _, n in rows)
    for _ in range(500):
        grad = [1e-4 * x for x in w]
        for x, good, n in rows:
            z = w[-1] + sum(a for a, b in zip(w, x) if b)
            err = (n / (1 + math.exp(max(-60.0, min(60.0, -z)))) - good) / total
            grad[-1] += err
            for j, b in enumerate(x):
                if b:
                    grad[j] += err
        w = [a - 4.0 * g for a, g in zip(w, grad)]
    return w


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, spans): spans is an array of (kind number, start, end) sorted by kind and start, in code points."""
    raw = text_of(text_col)
    clean = F.translate(raw, OPEN + CLOSE, OTHER + OTHER)
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), raw).alias("key"), clean.alias("t"))
    cuts = base.select("doc_id", "key", *[_cut(F.col("t"), k).alias(k) for k in KINDS])
    found = stage(cuts.select("doc_id", "key", F.concat(*[_pieces(F.col(k), k) for k in KINDS]).alias("pieces")), "pieces")

    per_text = Window.partitionBy("doc_id", "key", "kind").orderBy("i")
    pieces = found.filter(F.size("pieces") > 0).dropDuplicates(["doc_id", "key"]).select("doc_id", "key", F.inline("pieces"))
    placed = pieces.select("doc_id", "key", "kind", "i", "match",
                           F.coalesce(F.sum("chars").over(per_text.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
                           F.coalesce(F.lag("tail").over(per_text), F.lit("")).alias("before"))
    spans = stage(placed.filter(F.col("i") > 0).withColumn("end", F.col("start") + F.length("match"))
                  .filter(_valid(F.col("kind"), F.col("match"))), "spans")

    votes, features = _votes(F.col("match"), F.col("before")), _features(F.col("match"), F.col("before"))
    taken = spans.filter("kind < 4").select("doc_id", "key", F.col("start").alias("s"), F.col("end").alias("e"))
    open_ = spans.filter("kind = 4").select("doc_id", "key", "start", "end", *[c.alias(f"v_{n}") for n, c in votes.items()], *[c.alias(f"f_{n}") for n, c in features.items()])
    open_ = stage(open_, "candidates")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key"))
    free = open_.alias("a").join(taken.alias("b"), same & (F.col("a.start") < F.col("b.e")) & (F.col("b.s") < F.col("a.end")), "left_anti")
    free = stage(free, "free")
    v_names, f_names = [f"v_{n}" for n in votes], [f"f_{n}" for n in features]
    grouped = free.groupBy(*v_names, *f_names).count().collect()  # at most 3 ** 5 * 2 ** 8 patterns, at any size
    by_vote: dict[tuple[int, ...], int] = {}
    for r in sorted(grouped, key=tuple):
        v = tuple(r[n] for n in v_names)
        by_vote[v] = by_vote.get(v, 0) + r["count"]
    post = _reliabilities(sorted(by_vote.items()))
    soft: dict[tuple[int, ...], list[float]] = {}
    for r in sorted(grouped, key=tuple):
        own = soft.setdefault(tuple(r[n] for n in f_names), [0.0, 0.0])
        own[0] += r["count"] * post[tuple(r[n] for n in v_names)]
        own[1] += r["count"]
    w = _logistic([(x, a, n) for x, (a, n) in sorted(soft.items())]) or [0.0] * (len(f_names) + 1)
    odds = F.lit(w[-1])
    for n, a in zip(f_names, w):
        odds = odds + F.col(n) * F.lit(a)
    added = free.filter(odds > 0).select("doc_id", "key", F.lit(4).alias("kind"), "start", "end")
    every = spans.filter("kind < 4").select("doc_id", "key", "kind", "start", "end").unionByName(added)
    listed = every.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("spans"))
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    on = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.key") == F.col("s.key"))
    return found.select("doc_id", "key").alias("d").join(listed.alias("s"), on, "left").select(
        F.col("d.doc_id").alias("doc_id"), F.col("d.key").alias("key"), F.coalesce(F.col("s.spans"), none).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
