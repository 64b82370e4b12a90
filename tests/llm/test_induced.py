import random

import numpy as np

from lingora.llm import induced


def slow(text, cap):
    """Positions by their first `cap` characters, and neighbours' common prefixes; separators are equal to none."""
    key = lambda i: [(0, j) if text[j] == 0 else (1, text[j]) for j in range(i, min(len(text), i + cap))]
    order = sorted(range(len(text)), key=key)
    common = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while k < cap and text[a + k] == text[b + k] != 0:
            k += 1
        common.append(k)
    return order, common, key


def check(text, cap, limit):
    store = induced.Store(limit)
    parts = list(induced.suffixes(np.array(text, np.uint16), cap, store))
    got, shared = (np.concatenate(x).tolist() for x in zip(*parts))
    order, common, key = slow(text, cap)
    assert sorted(got) == list(range(len(text)))
    assert [key(i) for i in got] == [key(i) for i in order], text
    assert shared == common, text
    return store


def test_order_and_common_prefixes_equal_sorting(monkeypatch):
    rng = random.Random(2)
    for trial in range(500):
        k = rng.choice((1, 2, 3, 5))
        text = [rng.randint(1, k) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 5)):
            text.insert(rng.randint(0, len(text)), 0)
        if rng.random() < 0.5:
            part = text[: rng.randint(0, len(text))]
            text += [0, *part, 0, *part]
        text.append(0)
        monkeypatch.setattr(induced, "WAVE", rng.choice((1, 3, 1 << 20)))
        monkeypatch.setattr(induced, "NAMES", rng.choice((1, 4, 256)))
        monkeypatch.setattr(induced, "INNER", rng.choice((24, 1 << 30)))
        check(text, rng.choice((1, 4, 16, 254)), rng.choice((0, 64, 1 << 20)))


def test_names_in_two_digits_and_arrays_on_disk(monkeypatch):
    monkeypatch.setattr(induced, "INNER", 1 << 30)
    rng = random.Random(3)
    words = [[rng.randint(1, 60) for _ in range(rng.randint(1, 9))] for _ in range(300)]
    text = []
    for _ in range(120):
        text += [c for w in rng.choices(words, k=rng.randint(1, 8)) for c in w] + [0]
    text += text[: len(text) // 2] + [0]
    assert check(text, 40, 500).spilled > 0 and check(text, 40, 1 << 30).spilled == 0


def test_range_min():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 200, 300).astype(np.uint8)
    low = rng.integers(0, 300, 500)
    high = np.minimum(299, low + rng.integers(0, 300, 500))
    assert induced.range_min(values, low, high).tolist() == [values[a : b + 1].min() for a, b in zip(low, high)]
    least = induced.RangeMin(values, induced.Store(0))
    assert least.of(low, high).tolist() == [values[a : b + 1].min() for a, b in zip(low, high)]
