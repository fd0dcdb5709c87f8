"""Sums of arrays by key: within a task first, so that whole arrays are shuffled, never single numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: A task sums up to so many keys or numbers before it passes them on.
HELD, NUMBERS = 4096, 1 << 22
#: A frame that a task makes has about so many numbers in arrays and so many rows at most, however many rows came in.
FRAME_NUMBERS, FRAME_ROWS = 1 << 20, 4096


def framed(rows: Iterable[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    """Tuples as frames of bounded size, made as they come."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(x.size for x in row if isinstance(x, np.ndarray))
        if size >= FRAME_NUMBERS or len(held) >= FRAME_ROWS:
            yield pd.DataFrame(held, columns=names)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=names)


def kinds(rows: DataFrame, keys: list[str]) -> str:
    return "".join(f"{k} {dict(rows.dtypes)[k].replace('bigint', 'long')}, " for k in keys)


def summed(rows: DataFrame, keys: list[str], name: str = "x") -> DataFrame:
    """(keys, x): the sum of the arrays of each key, all of one length. Sums are made before the shuffle, and behind it as sorted keys go by."""
    return mapped_sum(rows.select(*keys, name), None, kinds(rows, keys) + f"{name} array<double>")


def mapped_sum(rows: DataFrame, f: Callable | None, schema: str) -> DataFrame:
    """As summed, of the tuples (keys, x) that f gives for each row, made and summed in one pass; schema names the keys and, last, the array."""
    names = [c.split()[0] for c in schema.split(", ")]
    keys = names[:-1]

    def table(found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=names)

    def before(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = {}, 0
        for t in batches:
            for *key, x in zip(*(t[c] for c in names), strict=True) if f is None else (made for r in t.itertuples() for made in f(r)):
                key = tuple(key)
                if key in held:
                    held[key] += x
                else:
                    held[key] = np.array(x, dtype=float)
                    size += len(x)
            if len(held) > HELD or size > NUMBERS:
                yield table([(*k, x) for k, x in held.items()])
                held, size = {}, 0
        if held:
            yield table([(*k, x) for k, x in held.items()])

    def behind(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, total = None, None
        for t in batches:
            done = []
            for *key, x in zip(*(t[c] for c in names), strict=True):
                key = tuple(key)
                if key == last:
                    total += x
                else:
                    if last is not None:
                        done.append((*last, total))
                    last, total = key, np.array(x, dtype=float)
            if done:
                yield table(done)
        if last is not None:
            yield table([(*last, total)])

    return rows.mapInPandas(before, schema).repartition(*keys).sortWithinPartitions(*keys).mapInPandas(behind, schema)
