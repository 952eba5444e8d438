"""Whole groups of sorted rows, for functions of batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd


def by_group(of: list[str], work: Callable[[pd.DataFrame], pd.DataFrame]):
    """A function of batches whose rows come group by group (equal columns ``of``): whole groups, one or more at once, to ``work``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last = np.logical_and.reduce([batch[c].to_numpy() == batch[c].iat[-1] for c in of])
            cut = int(np.argmax(last))
            if cut or (rest and any(rest[-1][c].iat[-1] != batch[c].iat[-1] for c in of)):
                yield work(pd.concat([*rest, batch.iloc[:cut]], ignore_index=True))
                rest = []
            rest.append(batch.iloc[cut:])
        if rest:
            yield work(pd.concat(rest, ignore_index=True))

    return run
