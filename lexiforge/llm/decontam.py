"""Benchmark decontamination with an FM-index per training shard.

A shard is some 1.5 MB of whole documents in a task (a longer document is a shard of its own, cut into overlapping pieces
for the index only). Its word sequence, one separator after each document, gets a suffix array by prefix doubling, the
Burrows-Wheeler transform in a wavelet matrix, and suffix positions sampled every few words. Windows of the test phrases
are searched backwards, all at once; occurrences are located by walking to a sampled position; hit words are merged into
spans. Test phrases lie in the shared folder in files of bounded size, so any number of them can be searched.

Cases: null texts and texts without words have no words and no hits; null ids and repeated rows pass through as they are;
benchmark rows of one item_id are one item, rows with a null item_id hit words but are not listed; an item of fewer words
than a window is one window; empty tables give no hits or no rows; other columns pass through, and columns named like the
results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .texts import ALNUM, Words, chunks, split_words, utf8

SHARD_BYTES = 3 << 19
#: Bytes of test phrases that are searched together.
BLOCK_BYTES = 4 << 20
#: Every so many words a suffix position is kept.
SAMPLE = 8
#: Located occurrences held at once.
LOCATED = 1 << 20

RESULTS = {"n_words": "long", "n_hit": "long", "items": "array<string>", "spans": "array<struct<start:int,end:int>>", "cleaned": "string"}


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of the suffixes of seq; 0 is a separator, each unlike all others and smaller than any symbol. seq ends in one."""
    n = len(seq)
    sep = seq == 0
    n_sep = int(sep.sum())
    rank = np.where(sep, np.cumsum(sep) - 1, seq.astype(np.int64) + (n_sep - 1))
    bits = (int(rank.max()) + 1).bit_length()
    depth = max(1, min(n, 63 // bits))
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key <<= bits
        key[: n - k] += rank[k:] + 1
    sa = np.argsort(key)
    idx = np.arange(n)
    key = key[sa]
    while True:
        new = np.ones(len(idx), bool)
        new[1:] = key[1:] != key[:-1]
        own = sa[idx] if len(idx) < n else sa
        rank[own] = idx[np.maximum.accumulate(np.where(new, np.arange(len(idx)), 0))]
        alone = new.copy()
        alone[:-1] &= new[1:]
        idx = idx[~alone]
        if not len(idx):
            return sa
        own = sa[idx]
        key = rank[own] * n + rank[own + depth]
        order = np.argsort(key)
        sa[idx] = own[order]
        key = key[order]
        depth *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence."""

    def __init__(self, seq: np.ndarray):
        self.levels = max(1, int(seq.max()).bit_length())
        self.bits, self.cum, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            packed = np.zeros((len(seq) // 64 + 1) * 8, np.uint8)
            short = np.packbits(bit, bitorder="little")
            packed[: len(short)] = short
            words = packed.view(np.uint64)
            cum = np.zeros(len(words) + 1, np.int32)
            np.cumsum(np.bitwise_count(words), out=cum[1:])
            self.bits.append(words)
            self.cum.append(cum)
            self.zeros.append(len(seq) - int(cum[-1]))
            seq = np.concatenate((seq[~bit], seq[bit]))
        symbols = np.arange(1 << self.levels)
        self.base = self.through(symbols, np.zeros(len(symbols), np.int64)) if self.levels < 22 else None

    def _rank1(self, k: int, pos: np.ndarray) -> np.ndarray:
        word = pos >> 6
        mask = (np.uint64(1) << (pos & 63).astype(np.uint64)) - np.uint64(1)
        return self.cum[k][word] + np.bitwise_count(self.bits[k][word] & mask)

    def through(self, symbols: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Where positions go if at each level the bit of the symbol is followed."""
        for k in range(self.levels):
            ones = self._rank1(k, pos)
            pos = np.where(symbols >> (self.levels - 1 - k) & 1, self.zeros[k] + ones, pos - ones)
        return pos

    def _base(self, symbols: np.ndarray) -> np.ndarray:
        return self.base[symbols] if self.base is not None else self.through(symbols, np.zeros(len(symbols), np.int64))

    def rank(self, symbols: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self.through(symbols, pos) - self._base(symbols)

    def access(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at each position, how often it stands before)."""
        symbols = np.zeros(len(pos), np.int64)
        for k in range(self.levels):
            ones = self._rank1(k, pos)
            bit = (self.bits[k][pos >> 6] >> (pos & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            symbols = symbols << 1 | bit
            pos = np.where(bit, self.zeros[k] + ones, pos - ones)
        return symbols, pos - self._base(symbols)


class FMIndex:
    """Full-text index over a sequence of symbols from 1 on, in which 0 separates documents and stands last."""

    def __init__(self, seq: np.ndarray, sample: int = SAMPLE):
        self.n = len(seq)
        sa = suffix_array(seq)
        self.wavelet = WaveletMatrix(seq[sa - 1])
        counts = np.bincount(seq, minlength=int(seq.max()) + 2)
        self.before = np.concatenate(([0], np.cumsum(counts)))
        after = np.zeros(self.n, bool)
        after[0] = True
        after[1:] = seq[:-1] == 0
        self.marked = (sa % sample == 0) | after[sa]
        self.place = np.cumsum(self.marked, dtype=np.int32)
        self.samples = sa[self.marked].astype(np.int32 if self.n < 1 << 31 else np.int64)

    def search(self, windows: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [from, to) of the suffixes that start with each window; windows: right-aligned symbols."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        live = np.arange(len(windows))
        for k in range(windows.shape[1]):
            live = live[(lens[live] > k) & (low[live] < high[live])]
            if not len(live):
                break
            symbols = windows[live, windows.shape[1] - 1 - k]
            low[live] = self.before[symbols] + self.wavelet.rank(symbols, low[live])
            high[live] = self.before[symbols] + self.wavelet.rank(symbols, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position in the sequence of each row's suffix."""
        out = np.zeros(len(rows), np.int64)
        live, at, steps = np.arange(len(rows)), rows, 0
        while len(live):
            done = self.marked[at]
            out[live[done]] = self.samples[self.place[at[done]] - 1] + steps
            live, at = live[~done], at[~done]
            symbols, before = self.wavelet.access(at)
            at = self.before[symbols] + before
            steps += 1
        return out


def phrase_windows(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(right-aligned windows of codes, their lengths, the row of each)."""
    first, lens = words.rows[:-1], np.diff(words.rows)
    n = np.where(lens == 0, 0, np.maximum(lens - window + 1, 1))
    row = np.repeat(np.arange(len(lens)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(lens[row], window)
    place = (first[row] + k + size)[:, None] - window + np.arange(window)[None, :]
    inside = np.arange(window)[None, :] >= window - size[:, None]
    codes = words.codes.astype(np.int64) if len(words.codes) else np.zeros(1, np.int64)
    return np.where(inside, codes[np.clip(place, 0, len(codes) - 1)], -2), size, row


def publish_phrases(benchmark: DataFrame) -> str:
    """Write item_id and text of the benchmark to the shared folder, in files of bounded size."""
    folder = shared.new_folder(benchmark.sparkSession, "phrases")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(chunks(batches, limit=BLOCK_BYTES)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_file(sink, batch.schema) as out:
                out.write_batch(batch)
            shared.publish(f"{folder}/{part:06d}-{k:06d}.phrases", sink.getvalue())
        yield from ()

    benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(write, "done int").count()
    return folder


class Phrases:
    """One file of test phrases."""

    def __init__(self, uri: str, window: int):
        with pa.ipc.open_file(pa.py_buffer(shared.mapped(uri, np.uint8))) as f:
            table = f.read_all().combine_chunks()
        batch = table.to_batches()[0]
        self.items = batch.column("item_id").to_pylist()
        words = split_words(*utf8(batch.column("text")), ALNUM)
        self.words = words.words
        codes, self.lens, rows = phrase_windows(words, window)
        self.codes, inverse = np.unique(codes, axis=0, return_inverse=True) if len(codes) else (codes, np.zeros(0, int))
        inverse = inverse.reshape(-1)
        lens = np.zeros(len(self.codes), np.int64)
        lens[inverse] = self.lens
        self.lens = lens
        pairs = np.unique(np.stack((inverse, rows), 1), axis=0) if len(rows) else np.zeros((0, 2), int)
        self.rows, self.offs = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.codes) + 1))

    def against(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(windows of symbols, number of each) of those whose words all stand in a shard's dictionary."""
        found = pc.fill_null(pc.index_in(self.words, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        symbols = np.where(self.codes == -2, 0, (found[self.codes] if len(found) else self.codes) + 1)
        keep = np.flatnonzero(((symbols > 0) | (self.codes == -2)).all(axis=1))
        return symbols[keep], keep


def mark(words: Words, blocks: list[Phrases], pieces: list[tuple[int, int]]) -> tuple[np.ndarray, list[set]]:
    """(whether each word is hit, items of each row) by an index over each piece of a shard's words."""
    n = len(words.codes)
    edge = np.zeros(n + 1, np.int64)
    items: list[set] = [set() for _ in range(len(words.rows) - 1)]
    for a, b in pieces:
        ends = np.unique(np.clip(words.rows[1:], a, b))
        ends = ends[ends > a]
        seq = np.insert(words.codes[a:b].astype(np.int64) + 1, ends - a, 0)
        word_at = np.cumsum(seq != 0) - 1 + a
        index = FMIndex(seq)
        for block in blocks:
            symbols, which = block.against(words.words)
            low, high = index.search(symbols, block.lens[which])
            some = np.flatnonzero(high > low)
            for at in np.split(some, np.flatnonzero(np.diff(np.cumsum((high - low)[some]) // LOCATED)) + 1):
                if not len(at):
                    continue
                per = high[at] - low[at]
                win = np.repeat(which[at], per)
                rows = np.repeat(low[at] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
                start = word_at[index.locate(rows)]
                np.add.at(edge, start, 1)
                np.add.at(edge, start + block.lens[win], -1)
                doc = np.searchsorted(words.rows, start, "right") - 1
                for d, w in np.unique(np.stack((doc, win), 1), axis=0).tolist():
                    items[d].update(block.items[i] for i in block.rows[block.offs[w] : block.offs[w + 1]].tolist())
    return np.cumsum(edge[:-1]) > 0, items


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """All rows and columns of docs with n_words, n_hit, items (sorted as strings), spans of hit words (code points, end
    exclusive, hit words that touch are one span) and cleaned (the text without the spans; null stays null)."""
    folder = publish_phrases(benchmark)
    docs = docs.drop(*RESULTS)
    schema = docs.limit(0).select("*", *(F.lit(None).cast(t).alias(n) for n, t in RESULTS.items())).schema
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uris = shared.listing(folder, ".phrases")
        kept: list[Phrases] = [Phrases(u, window) for u in uris] if len(uris) <= 4 else []
        for batch in chunks(batches, limit=SHARD_BYTES):
            data, offs = utf8(batch.column("text"))
            words = split_words(data, offs, ALNUM)
            most = SHARD_BYTES // 4
            n = len(words.codes)
            pieces = [(a, min(n, a + most + window - 1)) for a in range(0, max(n - window + 1, 1), most)] if n else []
            hit, items = np.zeros(n, bool), [set() for _ in range(batch.num_rows)]
            for group in [kept] if kept else ([Phrases(u, window)] for u in uris):
                h, i = mark(words, group, pieces)
                hit |= h
                for own, more in zip(items, i, strict=True):
                    own |= more
            total = np.concatenate(([0], np.cumsum(hit)))
            texts, spans, cleaned = batch.column("text"), [[] for _ in range(batch.num_rows)], None
            changed = {}
            for d in np.flatnonzero(np.diff(total[words.rows])).tolist():
                a, b = words.rows[d], words.rows[d + 1]
                own = hit[a:b].astype(np.int8)
                turn = np.diff(own, prepend=0, append=0)
                starts = words.starts[a:b][np.flatnonzero(turn == 1)] - offs[d]
                ends = words.ends[a:b][np.flatnonzero(turn == -1) - 1] - offs[d]
                body = data[offs[d] : offs[d + 1]]
                char = np.concatenate(([0], np.cumsum((body & 0xC0) != 0x80)))
                spans[d] = [{"start": int(char[s]), "end": int(char[e])} for s, e in zip(starts, ends, strict=True)]
                keep = np.ones(len(body), bool)
                for s, e in zip(starts, ends, strict=True):
                    keep[s:e] = False
                changed[d] = body[keep].tobytes().decode("utf-8")
            cleaned = texts if not changed else pa.array([changed.get(d, t) for d, t in enumerate(texts.to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(np.diff(words.rows), pa.int64()),
                    pa.array(np.diff(total[words.rows]), pa.int64()),
                    pa.array([sorted(x for x in i if x is not None) for i in items], pa.list_(pa.string())),
                    pa.array(spans, pa.list_(span)),
                    cleaned.cast(pa.string()),
                ],
                [*batch.schema.names, *RESULTS],
            )

    return docs.mapInArrow(run, schema).select(*docs.columns, *RESULTS)


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


#: Windows are joined with all word positions of the documents; the words of both are the same pattern.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS t FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
pos AS (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS t FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
occ AS (SELECT pos.r, pos.k, pos.i, win.item_id FROM pos JOIN win ON pos.k = win.k AND pos.t = win.t),
hits AS (SELECT r, count(DISTINCT h) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS h FROM (SELECT DISTINCT r, k, i FROM occ)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM occ WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hits.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256, coalesce(hits.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""
