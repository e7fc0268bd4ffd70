"""Stretches to train on hold their own rows, not a view of those of a whole text."""

import numpy as np

from cuewise.llm import secrets


def test_stretches_are_small_and_own_their_rows():
    text = "plain words and more of them " * 400 + "password = hunter2hunter " + "other words here " * 400
    chains = secrets.labelled_chains([text])
    assert chains and any(any(tags) for _, tags in chains)
    for rows, tags in chains:
        assert rows.base is None and rows.dtype == np.int16 and len(rows) == len(tags) <= secrets.WIDTH
        assert rows.min() >= 0 and rows.max() < secrets.BUCKETS
