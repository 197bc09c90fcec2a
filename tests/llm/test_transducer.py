import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from statuta.llm.transducer import compile_automaton, run

MACHINE = compile_automaton(lambda s, a: (s * 3 + a) % 7 if a != 3 else 0, 0, 4)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), max_size=6), st.integers(1, 9), st.booleans())
def test_chunked_run_equals_plain_run(texts, chunk, reverse):
    flat = np.array([a for t in texts for a in t], np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    got = run(MACHINE, flat, offsets, reverse, chunk)
    want = []
    for text in texts:
        state, seen = 0, []
        for a in reversed(text) if reverse else text:
            seen.append(state)
            state = MACHINE.table[state, a]
        want += reversed(seen) if reverse else seen
    assert got.tolist() == want
