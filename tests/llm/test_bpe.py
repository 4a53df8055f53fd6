import random
import sys

import hypothesis.strategies as st
import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings

from fleetpulse.llm.bpe import bpe_encode, merge_piece, read_ranks

RANKS = read_ranks(P.path("byte_bpe_50k.tiktoken"))
REAL = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
WHOLE = tiktoken.Encoding("whole", pat_str=r"(?s).+", mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdehinorst é🙂'0"), min_size=1, max_size=60))
def test_piece_merges_like_the_library(piece):
    assert merge_piece(piece.encode(), RANKS) == WHOLE.encode_ordinary(piece)


def test_documents(hard_docs, hard_rows, no_docs):
    got = {}
    for r in bpe_encode(hard_docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect():
        ids = np.frombuffer(r["ids_le"], "<u4").tolist()
        assert len(ids) == r["n_tokens"]
        assert ids == REAL.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
        got[r["doc_id"]] = 1
    assert set(got) == {i for i, _ in hard_rows}
    assert bpe_encode(no_docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_long_run_without_break():
    piece = b"ab" * 20000
    assert merge_piece(piece, RANKS) == WHOLE.encode_ordinary(piece.decode())


def test_trees_of_several_levels():
    rnd = random.Random(3)
    for n in (1, 2, 15, 16, 17, 255, 256, 257, 4097):
        piece = "".join(rnd.choices("aehinost", k=n))
        assert merge_piece(piece.encode(), RANKS) == WHOLE.encode_ordinary(piece)


def test_short_pieces_take_few_steps():
    steps = 0

    def count(frame, event, arg):
        nonlocal steps
        steps += event == "line"
        return count

    was = sys.gettrace()
    sys.settrace(count)
    try:
        merge_piece(b" oftionnten", RANKS)
    finally:
        sys.settrace(was)
    assert steps < 150
