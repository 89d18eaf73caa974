"""Interpolated modified Kneser-Ney bigram model over words, counted in Spark and memory-mapped by the scoring workers.

1. Each task sums the bigrams of its texts and deals them out by a hash of the context and three bits of the word, so
   that one frequent context is spread over eight parts. Each part is merged and written to the shared folder as a sorted
   hash array: a directory by the leading bits of the hash, then 32-bit remainders and counts.
2. Each part sends on sums by context and by word; they are merged by word into arrays of counts, continuation counts and
   numbers of continuations.
3. Workers map these files and look up the distinct bigrams of a few MB of text at a time.

All counts cover the whole training text; nothing is pruned. Word ids are 48-bit hashes; a bigram is held to some 60 bits.
The order is two: at four times the input's disk, trigram tables and their shuffle do not fit (README).

Cases: a null text is empty (its only token is the end); null ids belong to the rows that are held out; repeated rows
count repeatedly; without training text every token has probability one over one, so scores are 0; long texts are taken
whole; other columns pass through, clashing names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .langid import remainder
from .texts import NONSPACE, chunks, hashes, mix, split_words, summed, utf8

CHUNK = 1 << 20
#: Bytes of training text for each part of the tables.
PART_BYTES = 16 << 20
#: Bigrams that a counting task holds before it sends them on.
HELD = 2 << 20
START, END = 0, 1
RESULTS = {"n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "lm_score": "double"}
_SIX = np.uint64((1 << 48) - 1)


def word_ids(words: pa.Array) -> np.ndarray:
    """48-bit ids of words; 0 and 1 are kept for the start and the end."""
    return np.maximum(hashes(words) >> np.uint64(16), np.uint64(2))


def narrow(ids: np.ndarray) -> bytes:
    return np.ascontiguousarray(ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def sequence(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of the distinct tokens, codes of all tokens with a start before and an end after each row, rows' offsets in them)."""
    words = split_words(*utf8(batch.column("text")), NONSPACE)
    ids = np.concatenate((np.array([START, END], np.uint64), word_ids(words.words)))
    codes = np.insert(words.codes.astype(np.int64) + 2, np.stack((words.rows[:-1], words.rows[1:]), 1).reshape(-1), np.tile([0, 1], len(words.rows) - 1))
    return ids, codes, words.rows + 2 * np.arange(len(words.rows))


def distinct_pairs(codes: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed pair of codes of each token and the one before, places of the tokens); starts are no tokens."""
    place = np.ones(len(codes), bool)
    place[offs[:-1]] = False
    at = np.flatnonzero(place)
    return codes[at - 1] << 32 | codes[at], at


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(u) + w * np.uint64(0x9E3779B97F4A7C15))


def pair_part(u: np.ndarray, w: np.ndarray, bits: int) -> np.ndarray:
    return (mix(u << np.uint64(3) | w & np.uint64(7)) >> np.uint64(64 - bits)).astype(np.int64)


def word_part(ids: np.ndarray, bits: int) -> np.ndarray:
    return (ids >> np.uint64(48 - bits)).astype(np.int64)


def _by_part(part: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange((1 << bits) + 1))
    for k in range(1 << bits):
        if cuts[k] < cuts[k + 1]:
            yield k, order[cuts[k] : cuts[k + 1]]


def merge(u: np.ndarray, w: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs, sorted, with the sums of their values."""
    order = np.lexsort((w, u))
    u, w = u[order], w[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
    at = np.flatnonzero(new)
    return u[at], w[at], *(np.add.reduceat(v[order], at) for v in values)


def first_counts(counts: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3, 4."""
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].astype(np.int64)


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2, 3 and more, from the numbers of counts 1 to 4."""
    out = np.array([0.0, 0.5, 0.75, 0.9])
    if n[0] and n[1]:
        y = n[0] / (n[0] + 2 * n[1])
        for k in (1, 2, 3):
            if n[k - 1]:
                out[k] = min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05)
    return out


def bigram_file(u: np.ndarray, w: np.ndarray, counts: np.ndarray) -> bytes:
    key = pair_key(u, w)
    order = np.argsort(key)
    key = key[order]
    bits = max(1, (len(key) // 4).bit_length())
    lead = (key >> np.uint64(64 - bits)).astype(np.int64)
    directory = np.searchsorted(lead, np.arange((1 << bits) + 1)).astype(np.uint32)
    head = np.array([len(key), bits], np.int64)
    return b"".join(x.tobytes() for x in (head, directory, key.astype(np.uint32), np.minimum(counts[order], 0xFFFFFFFF).astype(np.uint32)))


_WORD_ROW = [("id", np.uint64), ("count", np.int64), ("n1", np.uint32), ("n2", np.uint32), ("n3", np.uint32), ("cont", np.uint32)]
_PAIRS = "part int, u binary, per binary, w binary, n binary"
_SUMS = "part int, kind int, ids binary, a binary, b binary, c binary, d binary"


def train(texts: DataFrame) -> tuple[str, int, dict[str, np.ndarray]]:
    """Count the model of texts.text; (folder, bits of a part, totals)."""
    folder = shared.new_folder(texts.sparkSession, "bigrams")
    bits = shared.part_bits(texts, PART_BYTES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in chunks(batches, limit=CHUNK):
            ids, codes, offs = sequence(batch)
            pair, n = summed(distinct_pairs(codes, offs)[0])
            held.append((ids[pair >> 32], ids[pair & 0xFFFFFFFF], n))
            size += len(pair)
            if size > HELD:
                yield from dealt(held)
                held, size = [], 0
        if held:
            yield from dealt(held)

    def dealt(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        u, w, n = merge(*(np.concatenate(x) for x in zip(*held, strict=True)))
        for k, at in _by_part(pair_part(u, w, bits), bits):
            names, first = np.unique(u[at], return_index=True)
            per = np.diff(np.append(first, len(at))).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x], pa.binary()) for x in (narrow(names), per.tobytes(), narrow(w[at]), n[at].astype(np.uint32).tobytes()))], ["part", "u", "per", "w", "n"])

    def write_pairs(table: pa.Table) -> pa.Table:
        part, us, ws, ns = table.column("part")[0].as_py(), [], [], []
        for row in table.to_batches():
            for u, per, w, n in zip(*(row.column(c).to_pylist() for c in ("u", "per", "w", "n")), strict=True):
                us.append(np.repeat(wide(u), np.frombuffer(per, np.uint32)))
                ws.append(wide(w))
                ns.append(np.frombuffer(n, np.uint32).astype(np.int64))
        u, w, n = merge(np.concatenate(us), np.concatenate(ws), np.concatenate(ns))
        shared.publish(f"{folder}/{part:06d}.pairs", bigram_file(u, w, n))
        rows = [(part, 2, b"", first_counts(n).tobytes(), np.array([len(n)]).tobytes(), b"", b"")]
        names, at = np.unique(u, return_index=True)
        sums = [np.add.reduceat(x.astype(np.int64), at) for x in (n, n == 1, n == 2, n > 2)]
        for k, own in _by_part(word_part(names, bits), bits):
            rows.append((k, 0, narrow(names[own]), sums[0][own].tobytes(), *(s[own].astype(np.uint32).tobytes() for s in sums[1:])))
        words, cont = summed(w)
        for k, own in _by_part(word_part(words, bits), bits):
            rows.append((k, 1, narrow(words[own]), cont[own].astype(np.uint32).tobytes(), b"", b"", b""))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), *[pa.binary()] * 5), strict=True)], names=["part", "kind", "ids", "a", "b", "c", "d"])

    def write_words(table: pa.Table) -> pa.Table:
        part, ids, values = table.column("part")[0].as_py(), [], []
        pairs, first = 0, np.zeros(4, np.int64)
        for row in table.to_batches():
            for kind, i, a, b, c, d in zip(*(row.column(x).to_pylist() for x in ("kind", "ids", "a", "b", "c", "d")), strict=True):
                if kind == 2:
                    first += np.frombuffer(a, np.int64)
                    pairs += int(np.frombuffer(b, np.int64)[0])
                    continue
                own = wide(i)
                ids.append(own)
                out = np.zeros((len(own), 5), np.int64)
                if kind == 0:
                    out[:, 0] = np.frombuffer(a, np.int64)
                    out[:, 1:4] = np.stack([np.frombuffer(x, np.uint32) for x in (b, c, d)], 1)
                else:
                    out[:, 4] = np.frombuffer(a, np.uint32)
                values.append(out)
        cont, total, starts, known = np.zeros(4, np.int64), 0, 0, 0
        if ids:
            names, values = np.concatenate(ids), np.concatenate(values)
            order = np.argsort(names)
            names = names[order]
            at = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
            names, values = names[at], np.add.reduceat(values[order], at, axis=0)
            rows = np.zeros(len(names), _WORD_ROW)
            for k, (name, _) in enumerate(_WORD_ROW[1:]):
                rows[name] = values[:, k]
            rows["id"] = names
            shared.publish(f"{folder}/{part:06d}.words", np.ascontiguousarray(rows["id"]).tobytes() + rows.tobytes())
            starts = int(rows["count"][names == START].sum())
            known, total, cont = int((names >= 2).sum()), int(rows["count"][names >= 2].sum()), first_counts(rows["cont"][names >= 1].astype(np.int64))
        made = [pairs, starts, known, total, *first, *cont]
        return pa.table({"totals": pa.array([[int(x) for x in made]], pa.list_(pa.int64()))})

    parts = texts.select("text").mapInArrow(count, _PAIRS).groupBy("part").applyInArrow(write_pairs, _SUMS).groupBy("part").applyInArrow(write_words, "totals array<long>")
    sums = parts.select(*(F.sum(F.col("totals")[k]).alias(f"t{k}") for k in range(12))).first()
    t = np.array([x or 0 for x in sums], np.int64)
    ends = int(t[1])
    return folder, bits, {"pairs": t[0], "ends": t[1], "vocabulary": t[2] + (ends > 0), "tokens": t[3] + ends, "pair_counts": t[4:8], "cont_counts": t[8:12]}


class Model:
    """The mapped files of a model."""

    def __init__(self, folder: str, bits: int, totals: dict):
        self.folder, self.bits, self.t = folder, bits, totals
        self.d2, self.d1 = discounts(totals["pair_counts"]), discounts(totals["cont_counts"])
        self.pairs_at, self.words_at = {}, {}
        self.there = set(shared.listing(folder, ".pairs")) | set(shared.listing(folder, ".words"))
        c = totals["cont_counts"]
        many = max(int(totals["vocabulary"]) - int(c[0]) - int(c[1]), 0)
        self.g1 = (self.d1[1] * c[0] + self.d1[2] * c[1] + self.d1[3] * many) / max(int(totals["pairs"]), 1) if totals["pairs"] else 1.0

    def words(self, ids: np.ndarray) -> np.ndarray:
        """Rows of the word table; zeros for words that are not in it."""
        out = np.zeros(len(ids), _WORD_ROW)
        for k, own in _by_part(word_part(ids, self.bits), self.bits):
            uri = f"{self.folder}/{k:06d}.words"
            if uri not in self.there:
                continue
            if k not in self.words_at:
                shared.forget(self.words_at)
                size = 8 + np.dtype(_WORD_ROW).itemsize
                n = len(shared.mapped(uri, np.uint8)) // size
                self.words_at[k] = shared.mapped(uri, np.uint64, 0, n), shared.mapped(uri, _WORD_ROW, 8 * n, n)
            names, rows = self.words_at[k]
            at = np.minimum(np.searchsorted(names, ids[own]), len(names) - 1)
            same = names[at] == ids[own]
            out[own[same]] = rows[at[same]]
        return out

    def pairs(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Counts of bigrams."""
        out = np.zeros(len(u), np.int64)
        keys = pair_key(u, w)
        for k, own in _by_part(pair_part(u, w, self.bits), self.bits):
            uri = f"{self.folder}/{k:06d}.pairs"
            if uri not in self.there:
                continue
            if k not in self.pairs_at:
                shared.forget(self.pairs_at)
                n, b = (int(x) for x in shared.mapped(uri, np.int64, 0, 2))
                at = 16 + 4 * ((1 << b) + 1)
                self.pairs_at[k] = b, shared.mapped(uri, np.uint32, 16, (1 << b) + 1), shared.mapped(uri, np.uint32, at, n), shared.mapped(uri, np.uint32, at + 4 * n, n)
            b, directory, short, counts = self.pairs_at[k]
            own = own[np.argsort(keys[own])]
            lead = (keys[own] >> np.uint64(64 - b)).astype(np.int64)
            at, to = directory[lead].astype(np.int64), directory[lead + 1].astype(np.int64)
            want = keys[own].astype(np.uint32)
            while True:
                live = at < to
                own, at, to, want = own[live], at[live], to[live], want[live]
                if not len(own):
                    break
                hit = short[at] == want
                out[own[hit]] = counts[at[hit]]
                own, at, to, want = own[~hit], at[~hit] + 1, to[~hit], want[~hit]
        return out

    def score(self, ids: np.ndarray, codes: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known tokens, base score, model's score) of each row."""
        t, rows = self.t, self.words(ids)
        count = rows["count"].copy()
        count[1] = t["ends"]
        base = np.log10((count + 0.1) / (int(t["tokens"]) + 0.1 * (int(t["vocabulary"]) + 1)))
        cont = rows["cont"].astype(np.int64)
        low = np.maximum(cont - self.d1[np.minimum(cont, 3)], 0) / max(int(t["pairs"]), 1) + self.g1 / (int(t["vocabulary"]) + 1)
        total = rows["count"]
        back = np.where(total > 0, (self.d2[1] * rows["n1"] + self.d2[2] * rows["n2"] + self.d2[3] * rows["n3"]) / np.maximum(total, 1), 1.0)
        pair, place = distinct_pairs(codes, offs)
        kinds, which = np.unique(pair, return_inverse=True)
        u, w = kinds >> 32, kinds & 0xFFFFFFFF
        n = self.pairs(ids[u], ids[w])
        p = np.maximum(n - self.d2[np.minimum(n, 3)], 0) / np.maximum(total[u], 1) + back[u] * low[w]
        ends = np.searchsorted(place, offs)
        by_row = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[ends])
        return by_row((count > 0)[codes[place]].astype(np.int64)), by_row(base[codes[place]]), by_row(np.log10(p)[which])


def score(docs: DataFrame, model: tuple[str, int, dict[str, np.ndarray]]) -> DataFrame:
    """All rows and columns of docs with n_tokens, n_known, train_tokens, base_score, lm_score (log10) and perplexity."""
    folder, bits, totals = model
    docs = docs.drop(*RESULTS, "perplexity")
    schema = docs.limit(0).select("*", *(F.lit(None).cast(t).alias(n) for n, t in RESULTS.items())).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(folder, bits, totals)
        for batch in chunks(batches, limit=CHUNK):
            ids, codes, offs = sequence(batch)
            known, base, own = held.score(ids, codes, offs)
            tokens = np.diff(offs) - 1
            made = [pa.array(tokens), pa.array(known), pa.array(np.full(len(tokens), int(totals["tokens"]))), pa.array(base), pa.array(own)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *RESULTS])

    out = docs.mapInArrow(run, schema).select(*docs.columns, *RESULTS)
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("lm_score") / F.col("n_tokens")))


def op6_perplexity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 10) == 0
    out = score(docs, train(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", F.col("lm_score").alias("score"), "perplexity")
