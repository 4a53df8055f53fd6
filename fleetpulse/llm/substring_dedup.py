"""Substring dedup over windows of 20 words by suffix automata.

Repeated passages are found by anchors (see ``repeats``): every window with an equal one elsewhere lies in a snippet
whose anchor occurs twice.  The distinct snippets of a shard of anchors are its reference: in the order of their first
occurrence each one is streamed through the shard's one suffix automaton, whose matching statistics give, word by word,
the longest match with anything earlier; windows that end in a match of 20 words or more are repeated.  Insertion finds
those statistics and adds the snippet at once.  Maximal spans of such windows are removed from the texts.

The reference is the corpus itself, so all shards together grow with it and can't be broadcast to every task; a shard's
automaton stays in one task, and the snippets of documents that can match it are sent there.

Edge cases: null and empty texts have no words; texts of fewer than 20 words lose nothing; equal texts all go but the
one with the least id (a null id is least; rows that repeat id and text count as one text); overlapping repeats inside one
text are found; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import SPACE_RE, hashed_words, split_words
from fleetpulse.llm.repeats import Repeats, Windows, candidates, covered, runs_of

WORDS, GRAM = 20, 6


class SuffixAutomaton:
    """Online suffix automaton of several sequences of symbols."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: list[int]) -> list[int]:
        """Append a sequence.  For each of its symbols, the length of the longest match that ends there with anything
        added before (or with an earlier place of the sequence itself): its matching statistics, which insertion finds."""
        nxt, link, length = self.next, self.link, self.length
        last, out = 0, []
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:
                if length[q] != length[last] + 1:
                    q = self._split(last, c, q)
                last = q
                out.append(length[q])
                continue
            new = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            out.append(length[link[new]])
            last = new
        return out

    def _split(self, p: int, c: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def matching_statistics(self, sequence: list[int]) -> list[int]:
        """For each symbol, the length of the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        out = []
        for c in sequence:
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
            out.append(matched)
        return out


def _decide(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard: in the order of first occurrence, each class is streamed through the automaton of all earlier ones."""
    rows = candidates(rows, np.uint64, WORDS)
    none = rows["doc_id"].isna()
    rows = rows.assign(order=(~none).astype(int), doc_id=rows["doc_id"].astype("Int64").fillna(0)).sort_values(["order", "doc_id", "rid", "place"])
    contents = [np.frombuffer(c, np.uint64) for c in rows["content"]]
    codes = np.unique(np.concatenate([np.zeros(0, np.uint64), *contents]), return_inverse=True)[1].tolist()
    reference, out, at = SuffixAutomaton(), [], 0
    for anchor, snippet, count, c in zip(rows["anchor"], rows["snippet"], rows["count"], contents):
        matched = reference.add(codes[at:at + len(c)])
        at += len(c)
        windows = [i for i in range(count) if matched[i + WORDS - 1] >= WORDS]
        if windows:
            out.append((anchor, snippet, windows))
    return pd.DataFrame(out, columns=["anchor", "snippet", "windows"])


def _symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    codes, offsets, _ = hashed_words(texts)
    return codes, offsets


WINDOWS = Windows(_symbols, WORDS, GRAM)
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept string, firsts array<int>, ends array<int>"


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts with their removed runs of windows to what is kept and the removed spans of words."""
    for b in batches:
        words, offsets = split_words(pa.array(b["text"], pa.large_string(), from_pandas=True))
        spelled = words.dictionary.to_pylist()
        codes = np.asarray(words.indices)
        out = []
        for i, (d, c) in enumerate(zip(b["doc_id"], b["cuts"])):
            own = codes[offsets[i]:offsets[i + 1]]
            gone = covered(len(own), WORDS, *runs_of(d, c))
            edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
            out.append((d, len(own), int(gone.sum()), " ".join([spelled[k] for k in own[~gone]]), edge[::2].tolist(), edge[1::2].tolist()))
        made = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept", "firsts", "ends"])
        made["doc_id"] = pd.array(list(b["doc_id"]), dtype="Int64")
        yield made


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts that lose words, all other texts).

    The first has doc_id, n_words, n_removed, kept (words joined by a space) and the removed spans of words (firsts,
    ends); the second doc_id, n_words and digest (SHA-256 of the words joined by a space).
    """
    found = Repeats(docs, WINDOWS, True, id_col, text_col)
    cut, whole = found.finished(found.cuts(_symbols, np.uint64, _decide))
    whole = whole.select("doc_id", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE_RE, " ")).alias("plain"))
    n_words = F.when(F.col("plain") == "", 0).otherwise(F.length("plain") - F.length(F.replace("plain", F.lit(" "))) + 1).cast("bigint")
    return cut.mapInPandas(_finish, RESULT), whole.select("doc_id", n_words.alias("n_words"), F.sha2("plain", 256).alias("digest"))
