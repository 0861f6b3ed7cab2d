import random
import time

import numpy as np
import pytest

from spanloom.llm.gsaca import suffix_array


def joined(strings):
    out = []
    for k, s in enumerate(strings):
        out += [c + len(strings) for c in s] + [k]
    return np.array(out)


@pytest.mark.parametrize("seed", range(60))
def test_against_sort(seed):
    r = random.Random(seed)
    letters = r.choice([1, 2, 3, 20])
    strings = [[r.randrange(letters) for _ in range(r.choice([0, 1, 2, 7, 60]))] for _ in range(r.choice([1, 2, 9]))]
    if r.random() < 0.5:
        strings += strings[:2]
    text = joined(strings)
    assert suffix_array(text, len(strings)).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_time_is_linear():
    """A square would take 64 times as long for eight times the symbols; the best of three runs counts."""
    took = []
    for n in (10_000, 80_000):
        text = joined([[0, 1] * 50, *(np.random.default_rng(k).integers(0, 9, 50).tolist() for k in range(n // 50))])
        runs = []
        for _ in range(3):
            began = time.process_time()
            suffix_array(text, n // 50 + 1)
            runs.append(time.process_time() - began)
        took.append(min(runs))
    assert took[1] < 30 * took[0]
