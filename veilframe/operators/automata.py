"""Containment of keys in either direction by automata over one bounded set of keys, in the tasks that have the values.

Which keys a value holds is for an Aho-Corasick automaton of the keys. Whether a key holds a value is for a suffix automaton
of all keys, one after another with a byte between that no key has: a value lies in a key if it is a path from the root.
The suffix automaton is built once, on the driver, as arrays of sorted edges, and all values of a batch take their steps in
it together. Neither direction shuffles or multiplies rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Keys go into automata up to so many bytes together; the arrays that tasks get are about fifty times as many.
MOST_KEY_BYTES = 1 << 20


@dataclass(frozen=True)
class Suffixes:
    """Edges of a suffix automaton, state * 256 + byte in ascending order, and the states they lead to."""

    edges: np.ndarray
    to: np.ndarray

    @property
    def n_bytes(self) -> int:
        return self.edges.nbytes + self.to.nbytes


def suffixes(keys: Sequence[bytes]) -> Suffixes:
    """The automaton of all pieces of the keys. A zero byte stands between keys, so no piece runs from one into the next."""
    step: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for byte in b"\0".join(keys):
        new, p = len(step), last
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        while p >= 0 and byte not in step[p]:
            step[p][byte] = new
            p = link[p]
        if p >= 0:
            q = step[p][byte]
            if length[q] != length[p] + 1:  # q also stands for longer pieces: its shorter ones get a state of their own
                own = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = own
                while p >= 0 and step[p].get(byte) == q:
                    step[p][byte] = own
                    p = link[p]
                q = own
            link[new] = q
        last = new
    edges = np.fromiter((s * 256 + b for s, out in enumerate(step) for b in out), np.int64)
    to = np.fromiter((t for out in step for t in out.values()), np.int32, len(edges))
    order = np.argsort(edges)
    return Suffixes(edges[order], to[order])


def within(automaton: Suffixes, values: pa.Array) -> np.ndarray:
    """Whether each value (binary) lies in a key; all values take a step at a time."""
    bounds = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] is not None else np.zeros(0, np.uint8)
    alive, state, size = np.ones(len(values), bool), np.zeros(len(values), np.int64), np.diff(bounds)
    for i in range(int(size.max(initial=0))):
        on = np.flatnonzero(alive & (size > i))
        if not len(on):
            break
        want = state[on] * 256 + data[bounds[on] + i]
        at = np.minimum(np.searchsorted(automaton.edges, want), max(len(automaton.edges) - 1, 0))
        found = (automaton.edges[at] == want) & (data[bounds[on] + i] > 0) if len(automaton.edges) else np.zeros(len(on), bool)
        alive[on] = found
        state[on[found]] = automaton.to[at[found]]
    return alive


def matcher(keys, automaton, least: int) -> Callable:
    """Arrow function of values to whether they hold a key or lie in one. keys, automaton: broadcasts."""
    built: list = []

    def run(values: pa.Array) -> pa.Array:
        if not built:
            import ahocorasick

            built.append(ahocorasick.Automaton(ahocorasick.STORE_LENGTH))
            for k in keys.value:
                if len(k.encode()) >= least:
                    built[0].add_word(k)
            built[0].make_automaton()
        raw = values.cast(pa.binary()).fill_null(b"")
        lies = within(automaton.value, raw) & (np.diff(np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]) >= least)
        holds = [bool(len(built[0])) and v is not None and next(built[0].iter(v), None) is not None for v in values.to_pylist()]
        return pa.array(lies | np.array(holds, bool))

    return run


def contains_or_lies_in(spark: SparkSession, value: Column, keys: list[str], least: int) -> Column:
    """Whether a value holds one of the keys or lies in one, from least bytes of the held one on.

    Keys are of MOST_KEY_BYTES together at most and hold no zero byte. Empty and null values match nothing.
    """
    size = sum(len(k.encode()) for k in keys)
    if size > MOST_KEY_BYTES:
        raise ValueError(f"{size} bytes of keys are too many for automata")
    shared = spark.sparkContext.broadcast(keys), spark.sparkContext.broadcast(suffixes([k.encode() for k in keys]))
    return F.arrow_udf(matcher(*shared, least), "boolean")(value)
