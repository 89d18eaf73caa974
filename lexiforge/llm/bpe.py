"""BPE encoding and decoding through a table of distinct words.

1. Texts are split into words (pieces of the pre-tokenizer's pattern); each task keeps its distinct words.
2. Distinct words are dealt by hash; each is encoded once, and every part of the table is written to the shared
   folder as sorted hash arrays with the words themselves, so a lookup is exact.
3. Texts are split again; ids are joined back by position from the memory-mapped table, without a shuffle of
   occurrences. Decoding joins ids with the table of pieces.

Cases: a null text counts as empty (no ids); empty texts give no ids; long texts are taken whole; strings of special
tokens in a text become their ids, as the library does; repeated rows give repeated rows; null ids and other columns
pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .texts import chunks, flat, hashes, utf8

CHUNK = 1 << 20
#: Bytes of text for each part of the table of words.
PART_BYTES = 16 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """Class of each code point: 0 other, 1 letter, 2 number, 3 white space, as the pattern has them."""
    global _classes
    if _classes is None:
        import regex

        every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(0x110000))
        _classes = np.zeros(0x110000, np.uint8)
        for k, kind in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
            for m in regex.finditer(kind, every):
                _classes[m.start() : m.end()] = k
    return _classes


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to."""
    table = char_classes()
    out = table[:128][data & 127]
    for low, high, more in ((0xC0, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0xF8, 3)):
        lead = np.flatnonzero((data >= low) & (data < high))
        if len(lead):
            code = data[lead].astype(np.int64) & (0x3F >> more)
            for k in range(1, more + 1):
                code = code << 6 | (data[lead + k] & 0x3F)
            for k in range(more + 1):
                out[lead + k] = table[code]
    return out


class Splitter:
    """Pieces of texts as the byte-level pre-tokenizer's pattern makes them; special tokens are pieces of their own.

    The pattern is followed by runs of one class: a run of letters, numbers or other signs takes a space before it;
    white space ends a piece before its last character if more text follows; an apostrophe alone and without a space
    takes the fixed endings s, t, re, ve, m, ll, d from the letters behind it.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        added = said.get("added_tokens") or []
        pre = said.get("pre_tokenizer") or {}
        odd = any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized") for t in added)
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or said.get("normalizer") or odd:
            raise ValueError("only byte-level tokenizers without a normalizer or prefix space are known")
        special = sorted((t["content"].encode() for t in added), key=len, reverse=True)
        self._special = re.compile(b"|".join(map(re.escape, special))) if special else None

    def _spans(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int]]:
        """Special tokens in the rows."""
        if self._special is None or self._special.search(raw := data.tobytes()) is None:
            return []
        return [(a + m.start(), a + m.end()) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True) for m in self._special.finditer(raw[a:b])]

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start of each piece and the end of the last, first piece of each row) in the bytes of some rows."""
        n = len(data)
        if not n:
            return np.zeros(1, np.int64), np.zeros(len(offs), np.int64)
        kind = byte_classes(data)
        wall = np.zeros(n + 1, bool)
        wall[offs] = True
        inner = self._spans(data, offs)
        for a, b in inner:
            wall[a] = wall[b] = True
        start = wall.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        runs = np.flatnonzero(start[:n])
        ends = np.append(runs[1:], n)
        k_run = kind[runs]
        white = np.flatnonzero((k_run == 3) & ~wall[ends])
        last = ends[white] - 1
        while (more := (data[last] & 0xC0) == 0x80).any():
            last = last - more
        start[last] = True
        start[ends[white][data[ends[white] - 1] == 32]] = False
        lone = np.flatnonzero((k_run[:-1] == 0) & (ends[:-1] - runs[:-1] == 1) & (data[runs[:-1]] == 39) & (k_run[1:] == 1) & ~wall[runs[1:]] & start[runs[:-1]])
        if len(lone):
            at, to = runs[lone + 1], ends[lone + 1]
            one, two = data[at], np.where(at + 1 < to, data[np.minimum(at + 1, n - 1)], 0)
            long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
            size = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 1, np.where(long, 2, 0))
            start[at[size > 0]] = False
            start[(at + size)[size > 0]] = True
        for a, b in inner:
            start[a + 1 : b] = False
        at = np.append(np.flatnonzero(start[:n]), n)
        return at, np.searchsorted(at, offs)


def _pieces(batch: pa.RecordBatch, split: Splitter) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(codes, distinct pieces, offsets by row)."""
    data, offs = utf8(batch.column("text"))
    data = np.ascontiguousarray(data)
    at, rows = split(data, offs)
    coded = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, rows


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + len), one after the other."""
    total = int(lens.sum())
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(total)


def build_table(docs: DataFrame, tokenizer: str) -> tuple[str, int]:
    """Encode each distinct word of docs.text once; (folder of the table, bits of the hash that name a part)."""
    spark = docs.sparkSession
    folder = shared.new_folder(spark, "bpe")
    bits = shared.part_bits(docs, PART_BYTES)
    split = Splitter(tokenizer)  # read here, so that workers don't hold the whole file

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for batch in chunks(batches, limit=CHUNK):
            words = _pieces(batch, split)[1]
            seen = words if seen is None else pa.concat_arrays([seen, words]).unique()
            if seen.nbytes > 8 << 20:
                yield out(seen)
                seen = None
        if seen is not None:
            yield out(seen)

    def out(words: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((hashes(words) >> np.uint64(64 - bits)).astype(np.int32)), words.cast(pa.binary())], ["part", "word"])

    def encode(table: pa.Table) -> pa.Table:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        part = table.column("part")[0].as_py()
        words = table.column("word").combine_chunks().unique()
        keys = hashes(words)
        order = np.argsort(keys, kind="stable")
        words = words.take(pa.array(order))
        tok = Tokenizer.from_file(tokenizer)
        tok.no_truncation()
        tok.no_padding()
        ids: list[np.ndarray] = []
        for at in range(0, len(words), 5_000):
            ids += [np.array(e.ids, np.uint32) for e in tok.encode_batch_fast([w.decode() for w in words[at : at + 5_000].to_pylist()], add_special_tokens=False)]
        body, offs = flat(words)
        id_offs = np.zeros(len(ids) + 1, np.int64)
        np.cumsum([len(x) for x in ids], out=id_offs[1:])
        joined = np.concatenate(ids)
        head = np.array([len(words), len(joined), len(body)], np.int64)
        shared.publish(f"{folder}/{part:06d}.words", b"".join(x.tobytes() for x in (head, keys[order], offs, id_offs, joined, body)))
        return pa.table({"part": pa.array([part], pa.int32()), "n": pa.array([len(words)], pa.int64())})

    docs.select("text").mapInArrow(distinct, "part int, word binary").groupBy("part").applyInArrow(encode, "part int, n long").count()
    return folder, bits


class Table:
    """The memory-mapped parts of a table of distinct words."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits, self.parts = folder, bits, {}

    def _part(self, k: int):
        if k not in self.parts:
            shared.forget(self.parts)
            uri = f"{self.folder}/{k:06d}.words"
            n, n_ids, n_bytes = (int(x) for x in shared.mapped(uri, np.int64, 0, 3))
            at = 24
            arrays = []
            for dtype, count in ((np.uint64, n), (np.int64, n + 1), (np.int64, n + 1), (np.uint32, n_ids), (np.uint8, n_bytes)):
                arrays.append(shared.mapped(uri, dtype, at, count))
                at += count * np.dtype(dtype).itemsize
            self.parts[k] = arrays
        return self.parts[k]

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of distinct words that are all in the table."""
        keys = hashes(words)
        part = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        body, offs = flat(words)
        lens = np.zeros(len(words), np.int64)
        runs = [None] * (1 << self.bits)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange((1 << self.bits) + 1))
        for k in range(1 << self.bits):
            own = order[cuts[k] : cuts[k + 1]]
            if not len(own):
                continue
            held, w_offs, id_offs, w_ids, w_bytes = self._part(k)
            at = np.searchsorted(held, keys[own])
            w_lens, own_lens = w_offs[at + 1] - w_offs[at], offs[own + 1] - offs[own]
            if not (np.array_equal(w_lens, own_lens) and np.array_equal(w_bytes[ragged(w_offs[at], w_lens)], body[ragged(offs[own], own_lens)])):
                at = np.array([self._exact(words[int(i)].as_py(), int(a), self.parts[k]) for i, a in zip(own, at, strict=True)])
            lens[own] = id_offs[at + 1] - id_offs[at]
            runs[k] = (own, np.asarray(w_ids[ragged(id_offs[at], lens[own])]))
        out_offs = np.zeros(len(words) + 1, np.int64)
        np.cumsum(lens, out=out_offs[1:])
        out = np.zeros(int(out_offs[-1]), np.uint32)
        for own, values in (r for r in runs if r is not None):
            out[ragged(out_offs[own], lens[own])] = values
        return out, out_offs

    @staticmethod
    def _exact(word: bytes, at: int, part) -> int:
        """Place of a word among those of one hash."""
        _, offs, _, _, body = part
        while bytes(body[offs[at] : offs[at + 1]]) != word:
            at += 1
        return at


def piece_table(tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the piece of each id. Byte-level vocabularies spell the bytes that don't print as the characters from U+0100 on."""
    with open(tokenizer, encoding="utf-8") as f:
        said = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    pieces = {i: bytes(byte_of[c] for c in p) for p, i in said["model"]["vocab"].items()}
    pieces |= {t["id"]: t["content"].encode() for t in said.get("added_tokens") or []}
    rows = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
    offs = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=offs[1:])
    return np.frombuffer(b"".join(rows), np.uint8), offs


def encode(docs: DataFrame, tokenizer: str | None = None, ids: bool = True, decoded: bool = True) -> DataFrame:
    """All rows and columns of docs (with a string column text) and bpe_n, bpe_ids_sha256, bpe_decoded_sha256; with ids, bpe_ids; with decoded, bpe_decoded.

    Columns of docs that have one of these names are replaced.
    """
    tokenizer = tokenizer or default_tokenizer()
    folder, bits = build_table(docs, tokenizer)
    extra = [("bpe_n", "long"), ("bpe_ids_sha256", "string"), ("bpe_decoded_sha256", "string")] + [("bpe_ids", "array<int>")] * ids + [("bpe_decoded", "string")] * decoded
    names = {n for n, _ in extra}
    docs = docs.drop(*names)
    schema = docs.limit(0).select("*", *(F.lit(None).cast(t).alias(n) for n, t in extra)).schema

    # bounded by the vocabulary
    split, (p_bytes, p_offs) = Splitter(tokenizer), piece_table(tokenizer)
    p_lens = np.diff(p_offs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(folder, bits)
        for batch in chunks(batches, limit=CHUNK):
            codes, words, offs = _pieces(batch, split)
            w_ids, w_offs = table.ids(words)
            w_lens = np.diff(w_offs)
            per = w_lens[codes]
            all_ids = w_ids[ragged(w_offs[codes], per)]
            at = np.zeros(len(per) + 1, np.int64)
            np.cumsum(per, out=at[1:])
            rows = at[offs]
            b_lens = p_lens[all_ids]
            text = p_bytes[ragged(p_offs[all_ids], b_lens)].tobytes()
            b_at = np.zeros(len(all_ids) + 1, np.int64)
            np.cumsum(b_lens, out=b_at[1:])
            texts = [text[b_at[a] : b_at[b]].decode("utf-8", "replace") for a, b in zip(rows[:-1], rows[1:], strict=True)]
            made = {
                "bpe_n": pa.array(np.diff(rows), pa.int64()),
                "bpe_ids_sha256": pa.array([hashlib.sha256(all_ids[a:b].astype("<u4").tobytes()).hexdigest() for a, b in zip(rows[:-1], rows[1:], strict=True)], pa.string()),
                "bpe_decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
            }
            if ids:
                made["bpe_ids"] = pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(all_ids.astype(np.int32)))
            if decoded:
                made["bpe_decoded"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *made.values()], [*batch.schema.names, *made])

    return docs.mapInArrow(run, schema).select(*docs.columns, *(n for n, _ in extra))


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, ids=False, decoded=False)
    return out.select("doc_id", F.col("bpe_n").alias("n_tokens"), F.col("bpe_ids_sha256").alias("ids_sha256"), F.col("bpe_decoded_sha256").alias("decoded_sha256"))
