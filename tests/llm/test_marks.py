"""Marks of windows and of what they cover."""

import tracemalloc

import numpy as np
import pandas as pd

from dyadflow.llm import repeats
from dyadflow.llm.repeats import Units, Windows


def test_marks_take_few_bytes_a_unit():
    """A bucket has millions of bytes: sums of eight bytes for each were most of the work."""
    units = Units([b"x" * 300_000, b"", b"y" * 49, b"z" * 700_000], Windows("byte", 50, 16))
    tracemalloc.start()
    valid = units.window_starts()
    gone = repeats.covered(units, valid)
    peak = tracemalloc.get_traced_memory()[1] / units.n
    tracemalloc.stop()
    assert valid.sum() == 299_951 + 699_951 and gone.sum() == 1_000_000 and not gone[300_000:300_049].any()
    assert peak < 6


def test_copies_of_a_stretch_get_its_answer():
    """Four documents of one bucket hold one text, which one of them sends; what is marked depends on whose copies count."""
    text = b"the quick brown fox jumps over the lazy dog, and then it sleeps for a while in the sun"
    docs = pd.DataFrame({"id": [1, 1, 2, 3], "text": [text.decode(), text.decode() + "!", text.decode() + "?", "short"]})
    rule = Windows("byte", 50, 16)
    bucket = repeats.Bucket(docs, rule)
    chosen = np.arange(len(bucket.hash))
    which, _, _ = repeats.once_each(chosen.tolist(), bucket.stretches(chosen))
    n = bucket.end[which] - bucket.begin[which] + 1
    answers = pd.DataFrame({"single": [False], "which": [which.astype("<u4").tobytes()], "bits": [np.packbits(np.zeros(int(n.sum()), bool)).tobytes()]})
    windows = [(int(bucket.ids[d]), bucket.texts[d][i : i + 50], int(bucket.units.first[d]) + i) for d in range(4) for i in range(len(bucket.texts[d]) - 49)]
    for first_stays in (True, False):
        marked = repeats.marked_windows(bucket, answers, first_stays)
        # a stretch is judged whole: its windows are copies where the whole stretch is
        stretches = list(zip(bucket.begin.tolist(), bucket.end.tolist(), bucket.stretches(chosen), bucket.ids[bucket.doc].tolist(), strict=True))
        want = {s for a, b, t, i in stretches for s in range(a, b + 1) if (any(t == u and j < i for _, _, u, j in stretches) if first_stays else sum(t == u for _, _, u, _ in stretches) > 1)}
        assert set(np.flatnonzero(marked).tolist()) == want and want and len(windows) == 37 + 38 + 38
