import numpy as np
import pytest

from shelfmark.llm import packing

TOKENS, DOCUMENTS, ATTENTION = (1.0, 1e-6, 1e-6), (1e-6, 1.0, 1e-6), (1e-6, 1e-6, 1.0)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("cap, lengths, weights, nearest", [
    ((100, 3, None), [70, 35, 33, 20], TOKENS, 70), ((100, 3, None), [70, 35, 33, 20], DOCUMENTS, 35),
    ((100, None, 10_000), [66, 35, 35, 20], TOKENS, 35), ((100, None, 10_000), [66, 35, 35, 20], ATTENTION, 66),
])
def test_weights_choose_the_sequence(rule, cap, lengths, weights, nearest):
    """The last piece fits two open sequences; norm takes the one with the least left by its weights, dot the most."""
    counts = {k: lengths.count(k) for k in lengths}
    plan = packing.plan(counts, packing.Capacity(*cap), rule, weights)
    length = np.array([k for k, n in counts.items() for _ in range(n)])
    number = np.array([i for n in counts.values() for i in range(n)])
    sequence, _ = plan.place(length, number)
    together = set(length[sequence == sequence[length == 20][0]].tolist()) - {20}
    assert (nearest in together) == (rule == "norm")
