"""Blocks of profiles: no more than the comparison can use, and no pair lost."""

import random

import pyarrow as pa

from carbonweave.llm import variants
from carbonweave.llm.strings import osa


class Profiles:
    """Stands for a DataFrame: runs the batch function over one batch."""

    def __init__(self, batch):
        self.batch = batch

    def mapInArrow(self, run, schema):  # noqa: N802
        return [(i, b) for out in run(iter([self.batch])) for b, i in zip(*(out.column(k).to_pylist() for k in (0, 1)))]


def blocks(words):
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(words))), "kind": ["o"] * len(words), "propers": [[w] for w in words], "seconds": [["x"]] * len(words)})
    return variants._blocked(Profiles(batch), 2)


def test_blocks_hold_every_pair_that_compares_near_and_no_spare_letters():
    rng = random.Random(6)
    words = ["".join(rng.choice("abk") for _ in range(rng.randrange(1, 10))) for _ in range(250)]
    of: dict[int, set] = {}
    for i, b in blocks(words):
        of.setdefault(i, set()).add(b)
    for i, x in enumerate(words):
        for j, y in enumerate(words[:i]):
            if osa(x, y, 2) <= variants.edits(min(len(x), len(y))):
                assert of[i] & of[j], (x, y)
    # Six letters may differ by one only: the word itself and one letter left out.
    assert len(blocks(["abcdef"])) == 7
