"""Brute-force enumeration of segmentations, labelings, trees, outputs and alignments, to test the dynamic programs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F


def segmentations_column(word: Column) -> Column:
    """array<array<string>>: all ways to cut a short word, one for each set of cut places."""
    n = F.length(word)
    cut = lambda mask: F.split(F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.substring(word, k, F.lit(1)), F.when((F.shiftright(mask, 0).bitwiseAND(F.pow(F.lit(2), k - 1).cast("int")) > 0) & (k < n), F.lit("\t")).otherwise(F.lit("")))), ""), "\t")
    return F.transform(F.sequence(F.lit(0), F.pow(F.lit(2), n - 1).cast("int") - 1), cut)


def segmentations(n: int) -> Iterator[list[tuple[int, int]]]:
    for cuts in product((False, True), repeat=max(n - 1, 0)):
        at = [0, *(k + 1 for k, c in enumerate(cuts) if c), n]
        yield list(zip(at[:-1], at[1:], strict=True)) if n else []


def labelings(spans: list, labels: int) -> Iterator[list[int]]:
    """All labels of segments; a single one is the root and so has label 0."""
    for ys in product(range(labels), repeat=len(spans)):
        if len(spans) > 1 or ys == (0,):
            yield list(ys)


def brackets(i: int, j: int) -> Iterator[tuple]:
    """Binary trees over leaves i .. j - 1."""
    if j - i == 1:
        yield (i,)
    for k in range(i + 1, j):
        for a in brackets(i, k):
            for b in brackets(k, j):
                yield a, b


def trees(n: int, labels: int) -> Iterator[list[tuple[int, int, int]]]:
    """Nodes (i, j, label) of all labelled binary trees over a word of n characters."""
    for spans in segmentations(n):
        for ys in labelings(spans, labels):
            for shape in brackets(0, len(spans)):
                nodes: list = []

                def grow(t, root=True, spans=spans, ys=ys, nodes=nodes):
                    if len(t) == 1:
                        (i, j), y = spans[t[0]], ys[t[0]]
                        nodes.append((i, j, y))
                        return i, j
                    (i, _), (_, j) = grow(t[0]), grow(t[1])
                    nodes.append((i, j, 0))
                    return i, j

                grow(shape)
                yield nodes


def chunkings(n: int, labels: int) -> Iterator[tuple[list, tuple]]:
    for spans in segmentations(n):
        for ys in product(range(labels), repeat=len(spans)):
            yield spans, ys


def strings(symbols: list[str], most: int) -> Iterator[str]:
    """All strings of up to most one-character symbols."""
    for n in range(most + 1):
        yield from map("".join, product([s for s in symbols if s], repeat=n))


def alignments(x: str, y: str, symbols: list[str]) -> Iterator[list[tuple[str, str]]]:
    """All ways to read x and write y by pairs of symbols, not both empty."""
    if not x and not y:
        yield []
    for a in symbols:
        for b in symbols:
            if (a or b) and x.startswith(a) and y.startswith(b):
                for rest in alignments(x[len(a) :], y[len(b) :], symbols):
                    yield [(a, b), *rest]
