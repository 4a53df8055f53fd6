"""N-gram Jaccard join by chosen paths.

Every text becomes its set of word 5-grams.  Texts with equal sets are one class.  Each class's set is embedded in
``TOKENS`` min-hashed tokens.  A run splits all sets at a few sampled token positions (1 / threshold of them on
average, the same for all sets of a bucket), so similar sets meet in some bucket; buckets of at most ``SMALL`` sets are
compared by brute force, larger ones are split again, ``DEPTH`` times at most.  What is still large then is compared in
blocks of ``BLOCK`` x ``BLOCK`` (whole sets: of ``BLOCK_BYTES`` each on average, if that is less), so no task holds more.  ``RUNS`` runs bring the chance to miss a pair at the
threshold under the target.

Buckets compare by embedded tokens with slack and give only links that keep their clusters connected; the exact
Jaccard similarity of all pairs of a cluster is then computed block by block from the whole sets, which yields each
text's number of links and the final components.  Pairs are never shuffled.

Edge cases: a null or empty text has an empty set, is linked to nothing and forms classes with other empty texts;
texts of fewer than five words have one n-gram, the whole text; null ids are left out (they can't be reported);
of different texts under one id each has a set of its own (all but one of them under an inner, negative number), so
none loses links; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.common import HOT_KEYS, hashed_words, join_hot, mix64, small_batches, stage
from fleetpulse.llm.graph import components

WORDS, THRESHOLD = 5, 0.8
TOKENS, RUNS, DEPTH = 64, 10, 3
SMALL, BLOCK, BLOCK_BYTES = 200, 1000, 8 << 20
#: Rows of buckets that are compared together, on average.
TASK_ROWS = 20_000
#: Links between embedded sets are kept from this similarity on: three standard deviations under the threshold.
SLACK = 0.65


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct 5-gram hashes of every text."""
    words, offsets, _ = hashed_words(texts)
    out = []
    factors = [mix64(np.array([k + 1], np.uint64))[0] | np.uint64(1) for k in range(WORDS)]
    n = len(words)
    grams = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for k, f in enumerate(factors):
        grams += words[k:n - WORDS + 1 + k] * f if n >= WORDS else 0
    grams = mix64(grams)
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= WORDS:
            out.append(np.unique(grams[a:b - WORDS + 1]))
        elif b > a:
            part = np.uint64(0)
            for w, f in zip(words[a:b], factors):
                part = part + w * f
            out.append(mix64(np.array([part + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _embedded(sets: list[np.ndarray]) -> np.ndarray:
    """TOKENS min-hashed 32-bit tokens of every set (zeros for an empty one)."""
    out = np.zeros((len(sets), TOKENS), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[i] for i in full])
    starts = np.concatenate(([0], np.cumsum([len(sets[i]) for i in full])[:-1]))
    for t in range(TOKENS):
        key = mix64(np.array([2 * t + 1], np.uint64))[0] | np.uint64(1)
        h = (flat ^ (key >> np.uint64(7))) * key
        out[full, t] = np.minimum.reduceat((h >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _names(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits that name each set."""
    return np.array([(s.sum(dtype=np.uint64), mix64(s).sum(dtype=np.uint64)) for s in sets], np.uint64).reshape(-1, 2)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> doc_id, the set's 128-bit name, size and embedding."""
    with np.errstate(over="ignore"):
        for batch in small_batches(batches):
            sets = shingle_sets(batch.column(1))
            name = _names(sets)
            sig = _embedded(sets)
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array(name[:, 0].view(np.int64)), pa.array(name[:, 1].view(np.int64)),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([r.tobytes() for r in sig], pa.binary()),
            ], ["doc_id", "set_a", "set_b", "n_grams", "tokens"])


def _children(nodes: np.ndarray, tokens: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sub-buckets: (row, node).  A bucket samples one position, and a second one for a quarter of the buckets."""
    first = mix64(nodes ^ seed)
    second = mix64(first + np.uint64(0x9E3779B97F4A7C15))
    rows, out = [], []
    for h, own in ((first, np.arange(len(nodes))), (second, np.flatnonzero((first >> np.uint64(40)) % np.uint64(100) < np.uint64(round(100 / THRESHOLD - 100))))):
        at = (h[own] % np.uint64(TOKENS)).astype(np.int64)
        rows.append(own)
        out.append(mix64(h[own] ^ (tokens[own, at].astype(np.uint64) + (at.astype(np.uint64) << np.uint64(32)))))
    return np.concatenate(rows), np.concatenate(out)


def _tokens(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(-1, TOKENS)


def _first_split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    with np.errstate(over="ignore"):
        for b in batches:
            tok, ids = _tokens(b["tokens"]), b["doc_id"].to_numpy()
            for run in range(RUNS):
                root = np.full(len(b), run + 1, np.uint64)
                rows, nodes = _children(mix64(root), tok, np.uint64(1))
                yield pd.DataFrame({"node": nodes.view(np.int64), "doc_id": ids[rows]})


def _next_split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    with np.errstate(over="ignore"):
        for b in batches:
            rows, nodes = _children(b["node"].to_numpy().view(np.uint64), _tokens(b["tokens"]), np.uint64(2))
            yield pd.DataFrame({"node": nodes.view(np.int64), "doc_id": b["doc_id"].to_numpy()[rows]})


class Forest:
    """Of links between 0..n-1, added in batches, those that join what was apart: n - 1 at most, whatever is added."""

    def __init__(self, n: int) -> None:
        self.root, self.links = np.arange(n), []

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        apart = self.root[x] != self.root[y]
        if not apart.any():
            return
        for p, q in zip(x[apart].tolist(), y[apart].tolist()):
            r, s = self._find(p), self._find(q)
            if r != s:
                self.root[s] = r
                self.links.append((p, q))
        while not np.array_equal(up := self.root[self.root], self.root):
            self.root = up

    def _find(self, x: int) -> int:
        while (up := self.root[x]) != x:
            x = up
        return x


def _compare_tokens(rows: pd.DataFrame) -> pd.DataFrame:
    """Many buckets (or pairs of blocks of large ones): links between embedded sets, thinned to a spanning forest.

    Rows are sorted by bucket; in step d every row is compared with the one d places on, if that is in its bucket.
    """
    rows = rows.sort_values(["node", "i", "j", "doc_id"])
    tok = _tokens(rows["tokens"]).astype(np.uint16)
    ids, block = rows["doc_id"].to_numpy(), rows["block"].to_numpy()
    one_block = (rows["i"] == rows["j"]).to_numpy()
    bucket = rows.groupby(["node", "i", "j"], sort=False).ngroup().to_numpy()
    known, code = np.unique(ids, return_inverse=True)
    forest, d = Forest(len(known)), 1
    active = np.arange(len(rows))
    while True:
        active = active[active + d < len(rows)]
        active = active[bucket[active] == bucket[active + d]]
        if not len(active):
            break
        for x in np.array_split(active, -(-len(active) // 100_000)):
            y = x + d
            asked = one_block[x] | (block[x] != block[y])
            x, y = x[asked], y[asked]
            hit = (tok[x] == tok[y]).mean(axis=1) >= SLACK
            forest.add(code[x[hit]], code[y[hit]])
        d += 1
    return pd.DataFrame([(known[p], known[q]) for p, q in forest.links], columns=["a", "b"], dtype="int64")


def in_blocks(rows: DataFrame, group: str, sizes: DataFrame, most: int) -> DataFrame:
    """``rows`` with the columns block, i, j: each row once for every pair of blocks that its block belongs to.

    Groups of at most ``most`` rows, and of BLOCK_BYTES where the sizes have ``bytes``, have one block and pass unchanged;
    block numbers come from a hash of doc_id.
    """
    blocks = F.col("size") / most
    blocks = F.greatest(blocks, F.least(F.col("bytes") / BLOCK_BYTES, F.col("size"))) if "bytes" in sizes.columns else blocks
    cut = rows.join(sizes.select(group, F.ceil(blocks).cast("int").alias("blocks")), group)
    cut = cut.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (cut.withColumn("_other", other)
            .withColumn("i", F.least("block", "_other")).withColumn("j", F.greatest("block", "_other"))
            .drop("_other", "blocks"))


def candidate_links(classes: DataFrame) -> DataFrame:
    """(a, b): links between classes (doc_id, tokens) by chosen paths; connected wherever a similar pair is found."""
    found, level = None, classes.mapInPandas(_first_split, "node bigint, doc_id bigint")
    for depth in range(1, DEPTH + 1):
        level = stage(level, f"paths{depth}")
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        sizes = stage(sizes, f"sizes{depth}")
        small = sizes.filter(F.col("size") <= SMALL) if depth < DEPTH else sizes
        members = level.join(small.select("node"), "node", "left_semi").join(classes, "doc_id")
        tasks = max(1, -(-(small.agg(F.sum("size")).first()[0] or 0) // TASK_ROWS))
        links = (in_blocks(members, "node", small, BLOCK).withColumn("task", F.pmod(F.xxhash64("node", "i", "j"), F.lit(tasks)))
                 .groupBy("task").applyInPandas(_compare_tokens, "a bigint, b bigint").distinct())
        found = links if found is None else found.unionByName(links)
        if depth < DEPTH:
            large = sizes.filter(F.col("size") > SMALL)
            level = (level.join(large.select("node"), "node", "left_semi").join(classes, "doc_id")
                     .mapInPandas(_next_split, "node bigint, doc_id bigint").distinct())
    return found


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root, text, set_a, set_b) -> doc_id (the node), root and the whole set, where it is the one so named."""
    with np.errstate(over="ignore"):
        for batch in small_batches(batches, 200):
            sets = shingle_sets(batch.column(2))
            wanted = np.stack([np.asarray(batch.column(i)).view(np.uint64) for i in (3, 4)], axis=1)
            same = pa.array((_names(sets) == wanted).all(axis=1), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "root", "grams"]).filter(same)


def _compare_sets(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A pair of blocks of one cluster: exact similarities.  Rows (a, b, null) link, rows (a, null, n) count links."""
    rows = rows.sort_values("doc_id")
    sets = [np.frombuffer(g, np.uint64) for g in rows["grams"]]
    ids, block = rows["doc_id"].to_numpy(), rows["block"].to_numpy()
    left, right = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
    size = np.array([len(s) for s in sets])
    forest, number = Forest(len(ids)), np.zeros(len(ids), np.int64)
    if len(left) and len(right):
        flat = np.concatenate([sets[r] for r in right])
        owner = np.repeat(np.arange(len(right)), size[right])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        for x in left:
            lo, hi = np.searchsorted(flat, sets[x], "left"), np.searchsorted(flat, sets[x], "right")
            count = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            common = np.bincount(owner[at], minlength=len(right))
            hit = right[common >= THRESHOLD * (size[x] + size[right] - common) - 1e-9]
            hit = hit[hit > x] if key[1] == key[2] else hit
            number[x] += len(hit)
            number[hit] += 1
            forest.add(np.full(len(hit), x), hit)
    some = np.flatnonzero(number)
    links = [(ids[p], ids[q]) for p, q in forest.links]
    return pd.DataFrame({
        "a": [x for x, _ in links] + ids[some].tolist(),
        "b": pd.array([y for _, y in links] + [None] * len(some), dtype="Int64"),
        "n": pd.array([None] * len(links) + number[some].tolist(), dtype="Int64"),
    })


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, class_id (least id of its component), set_id (least id with an equal set), n_links.

    n_links is the number of other sets with a Jaccard similarity of THRESHOLD or more.
    """
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    described = stage(rows.mapInArrow(_describe, "doc_id bigint, set_a bigint, set_b bigint, n_grams bigint, tokens binary"), "sets")
    by = ["set_a", "set_b", "n_grams"]
    named = described.groupBy(*by).agg(F.min("doc_id").alias("set_id"), F.count(F.lit(1)).alias("n"))
    own = F.row_number().over(Window.partitionBy("set_id").orderBy(*by)) == 1  # sets that share an id are few: texts of one document
    named = stage(named.withColumn("node", F.when(own, F.col("set_id")).otherwise(-1 - F.shiftrightunsigned(F.xxhash64(*by), 2))), "names")
    reps = named.filter("n_grams > 0").select(F.col("set_id").alias("doc_id"), *by, "node")
    classes = stage(described.join(reps, ["doc_id", *by]).select(F.col("node").alias("doc_id"), "tokens").dropDuplicates(["doc_id"]), "classes")
    near = stage(components(candidate_links(classes)), "near")
    nodes = near.join(reps, "node")
    sizes = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("size"), (8 * F.sum("n_grams")).alias("bytes"))
    sets = rows.join(nodes.select("doc_id", "node", "root", "set_a", "set_b"), "doc_id").select("node", "root", "text", "set_a", "set_b")
    sets = sets.mapInArrow(_grams, "doc_id bigint, root bigint, grams binary").dropDuplicates(["doc_id"])
    exact = stage(in_blocks(sets, "root", sizes, BLOCK).groupBy("root", "i", "j")
                  .applyInPandas(_compare_sets, "a bigint, b bigint, n bigint"), "links")
    roots = stage(components(exact.filter("b is not null").select("a", "b")), "roots")
    least = roots.join(named.select("node", "set_id"), "node").groupBy("root").agg(F.min("set_id").alias("class_id"))
    counts = exact.filter("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    per_set = (named.join(roots.join(least, "root").select("node", "class_id"), "node", "left").join(counts, "node", "left")
               .select(*by, "n", "set_id", F.coalesce("class_id", "set_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")))
    slim = described.select("doc_id", *by)
    return join_hot(slim, stage(per_set, "per_set"), by, "n", max(described.count(), HOT_KEYS)).select("doc_id", "class_id", "set_id", "n_links")
