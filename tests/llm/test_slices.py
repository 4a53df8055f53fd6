"""Arrow batches that are worked through in slices: no slice may read another one's rows."""

import pyarrow as pa
import pytest

from fleetpulse.llm import decontaminate, substring_dedup, suffix_array, suffix_tree_lm
from fleetpulse.llm.common import checksum_mod, small_batches, split_words
from tests.llm.test_suffix_tree_lm import ascii_lower, base_model
from tests.llm.test_suffix_tree_whole import brute_scores

ASCII = [f"Word{i} Two{i % 50} three Four five. Six{i % 7}" for i in range(5000)]
WIDE = [f"Wörd{i} Twö{i % 50} thrée FÖUR fünf. Séx{i % 7}" for i in range(5000)]


@pytest.mark.parametrize("texts", [ASCII, WIDE], ids=["ascii", "wide"])
@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()], ids=str)
@pytest.mark.parametrize("lower", [False, True])
def test_words_of_slices(texts, kind, lower):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, kind)], ["text"])
    for k, part in enumerate(small_batches([batch], 1000)):
        words, offsets = split_words(part.column(0), lower)
        expect = [ascii_lower(w) if lower else w for t in texts[1000 * k:1000 * (k + 1)] for w in t.split()]
        assert words.to_pylist() == expect and offsets.tolist() == list(range(0, 6001, 6))


@pytest.mark.parametrize("texts", [ASCII, WIDE], ids=["ascii", "wide"])
def test_symbols_of_slices(texts):
    """Each operator's symbols of a slice equal those of the same texts alone."""
    part = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]).slice(3000, 1000).column(0)
    alone = pa.array(texts[3000:4000], pa.string())
    for symbols in (suffix_tree_lm._symbols, substring_dedup._symbols, suffix_array._symbols):
        (got, got_at), (expect, expect_at) = symbols(part), symbols(alone)
        assert (got == expect).all() and (got_at == expect_at).all()
    (got, got_at), (expect, expect_at) = decontaminate.word_codes(part), decontaminate.word_codes(alone)
    assert (got == expect).all() and (got_at == expect_at).all()


@pytest.mark.parametrize("texts", [ASCII, WIDE], ids=["ascii", "wide"])
def test_model_of_one_large_partition(spark, texts):
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = {r["doc_id"]: r for r in suffix_tree_lm.suffix_tree_scores(docs, checksum_mod("doc_id", 7) == 2).collect()}
    base, scores = base_model(rows), dict(brute_scores(rows))
    for i, t in rows:
        held_out, n_tokens, n_known, n, base_score = base[i, t]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held_out, n_tokens, n_known, n)
        assert abs(r["base_score"] - base_score) < 1e-6 and abs(r["score"] - scores[i]) < 1e-6
