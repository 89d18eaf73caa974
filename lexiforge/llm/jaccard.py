"""N-gram Jaccard join by chosen paths.

Documents become sets of word 5-grams; equal sets are one class with a multiplicity, and the join runs over classes.
Each class draws shared tokens by min-wise hashing: at each node of the recursion RUNS independent draws send it to the
bucket of the drawn token. Buckets of up to LEAF classes are compared by brute force; a larger one is split again by fresh
draws while that lessens the pairs to compare, else it is compared in blocks of LEAF by LEAF. Two classes of similarity
0.8 or more miss all RUNS draws of a node with probability 0.2 ** RUNS, so RUNS follows from the target recall.

A pair is compared only where its draws meet first at every level of the path, which its two signatures show, so link
counts add up without listing pairs. Signatures first tell which classes of a bucket may have a partner there; only those
receive their whole sets, and similarity is then exact. A bucket sends on sums and a spanning forest, never all pairs.
Classes are joined into components by alternating large and small stars.

Cases: words are runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case; a text of fewer than five
words is one n-gram of all of them; null texts and texts without words have no links and are a class of their own; copies
(also repeated rows) are links of each other; class_id is the smallest non-null doc_id of the class; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .texts import ALNUM, Words, chunks, hashes, mix, split_words, utf8

WORDS = 5
TARGET_RECALL = 0.9999
LEVELS = 4
LEAF = 1024
SIGNATURE = 64
CHUNK = 1 << 20
BITS48 = np.uint64((1 << 48) - 1)


def _multipliers() -> np.ndarray:
    return mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(words: Words, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(48-bit n-grams of each row, sorted and without repeats, row by row; offsets by row)."""
    ids = hashes(words.words)[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    lens = np.diff(words.rows)
    n = np.where(lens >= size, lens - size + 1, 0)
    row = np.repeat(np.arange(len(lens)), n)
    first = np.repeat(words.rows[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    value = np.full(len(first), size, np.uint64)
    for k in range(size):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + ids[first + k])
    short = np.flatnonzero((lens > 0) & (lens < size))
    if len(short):
        more = lens[short].astype(np.uint64)
        for k in range(size):
            live = lens[short] > k
            more[live] = mix(more[live] * np.uint64(0x9E3779B97F4A7C15) + ids[words.rows[short[live]] + k])
        value, row = np.concatenate((value, more)), np.concatenate((row, short))
    key = np.sort(row.astype(np.uint64) << np.uint64(48) | value >> np.uint64(16))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return key & BITS48, np.searchsorted(key >> np.uint64(48), np.arange(len(lens) + 1))


def set_keys(values: np.ndarray, offs: np.ndarray) -> list[bytes | None]:
    """16-byte key of each set, the same for the same set; None for the empty one."""
    one, two = (np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values + np.uint64(c))))) for c in (1, 0x5851F42D4C957F2D))
    both = np.stack((one[offs[1:]] - one[offs[:-1]], mix(two[offs[1:]] - two[offs[:-1]])), 1)
    return [both[k].tobytes() if n else None for k, n in enumerate(np.diff(offs).tolist())]


def signatures(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Smallest hash of each non-empty set under each of SIGNATURE hash functions."""
    at = offs[:-1][np.diff(offs) > 0]
    out = np.zeros((len(at), SIGNATURE), np.uint32)
    spread = mix(values)
    for k, a in enumerate(_multipliers()):
        if len(at):
            out[:, k] = np.minimum.reduceat(((spread * a) >> np.uint64(32)).astype(np.uint32), at)
    return out


def _row_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, limit=CHUNK):
        for at in range(0, batch.num_rows, 1 << 15):
            yield batch.slice(at, 1 << 15)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _row_chunks(batches):
        values, offs = shingles(split_words(*utf8(batch.column("text")), ALNUM))
        keys, sigs = set_keys(values, offs), iter(signatures(values, offs))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(keys, pa.binary()), pa.array(np.diff(offs), pa.int64()), pa.array([next(sigs).tobytes() if k else None for k in keys], pa.binary())],
            ["doc_id", "text_hash", "set_key", "n", "sig"],
        )


def _groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows that agree in the columns by, of sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        if held and any(held[-1].column(c)[-1].as_py() != k[0] for c, k in zip(by, keys, strict=True)):
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _candidates(table: pa.Table, runs: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a leaf that this leaf has to compare: met here first, and not ruled out by sizes and signatures."""
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, SIGNATURE)
    n, block = table.column("n").to_numpy(), table.column("block").to_numpy()
    cross = table.column("p")[0].as_py() != table.column("q")[0].as_py()
    path, earlier, level = table.column("path")[0].as_py(), [], 0
    for step in path:
        earlier += range(level * runs, level * runs + step)
        level += 1
    least = math.floor(SIGNATURE * (similarity - 4.5 * math.sqrt(similarity * (1 - similarity) / SIGNATURE)))
    left, right = [], []
    for a in range(0, len(sig), 64):
        own, rest = sig[a : a + 64], sig[a:]
        same = (own[:, None, :] == rest[None, :, :]).sum(axis=2) >= least
        if earlier:
            same &= (own[:, None, earlier] != rest[None, :, earlier]).all(axis=2)
        small, large = np.minimum(n[a : a + 64, None], n[None, a:]), np.maximum(n[a : a + 64, None], n[None, a:])
        same &= small >= similarity * large - 1e-9
        if cross:
            same &= block[a : a + 64, None] != block[None, a:]
        x, y = np.nonzero(same)
        keep = y > x
        left.append(x[keep] + a)
        right.append(y[keep] + a)
    return np.concatenate(left), np.concatenate(right)


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the pairs have at least the similarity."""
    size = np.array([len(s) for s in sets])
    if len(left) <= 48:
        shared_n = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right, strict=True)])
    else:
        used, inverse = np.unique(np.concatenate((left, right)), return_inverse=True)
        token, code, count = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(used)), size[used])
        keep = count[code] > 1
        code, row = (np.cumsum(count > 1) - 1)[code[keep]], row[keep]
        order = np.argsort(code, kind="stable")
        code, row = code[order], row[order]
        both = np.zeros((len(used), len(used)), np.float32)
        width = max(256, (8 << 20) // len(used))
        for at in range(0, int(code[-1]) + 1 if len(code) else 0, width):
            a, b = np.searchsorted(code, [at, at + width])
            part = np.zeros((len(used), width), np.float32)
            part[row[a:b], code[a:b] - at] = 1
            both += part @ part.T
        shared_n = both[inverse[: len(left)], inverse[len(left) :]].astype(np.int64)
    union = size[left] + size[right] - shared_n
    return shared_n >= similarity * union - 1e-9


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member of each row's component."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while (root[root] != root).any():
            root = root[root]
        live = root[left] != root[right]
        left, right = left[live], right[live]
    return root


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) of the components of edges(a, b): every node that has an edge, with the smallest node of its component."""
    both = edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct()
    both, before = shared.cut(both), None
    while True:
        state = both.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return both.selectExpr("a AS node", "b AS root").union(both.selectExpr("b AS node", "b AS root").distinct())
        before = state
        every = both.union(both.selectExpr("b AS a", "a AS b"))
        low = every.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = every.where("b > a").join(low, "a").selectExpr("b AS a", "m AS b").where("a <> b").distinct()
        down = large.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a")
        both = shared.cut(small.selectExpr("b AS a", "m AS b").union(small.selectExpr("a", "m AS b")).where("a <> b").distinct())


def _flag_folder(keys: DataFrame) -> str:
    """The set keys as sorted arrays in the shared folder."""
    folder = shared.new_folder(keys.sparkSession, "sets")

    def write(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        own = np.unique(np.frombuffer(b"".join(table.column("set_key").to_pylist()), np.uint64).reshape(-1, 2)[:, 0])
        shared.publish(f"{folder}/{part:03d}.keys", own.tobytes())
        return pa.table({"n": pa.array([len(own)], pa.int64())})

    keys.select("set_key", F.pmod(F.xxhash64("set_key"), F.lit(64)).cast("int").alias("part")).groupBy("part").applyInArrow(write, "n long").count()
    return folder


def _by_size(rows: DataFrame, keys: DataFrame, key: str, how: str, most: int) -> DataFrame:
    """rows joined with keys; both have size, the number of rows of the key. Those of more than most rows are few and broadcast."""
    hot, cold = (rows.where(test).join(f(keys.where(test).select(key)), key, how) for test, f in ((F.col("size") > most, F.broadcast), (F.col("size") <= most, lambda x: x)))
    return hot.unionByName(cold)


def near_duplicates(docs: DataFrame, similarity: float = 0.8, target_recall: float = TARGET_RECALL, leaf: int = LEAF) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, text_hash, set_key (null: no words), class_key, class_id,
    n_links (other rows of at least the similarity) and n_text_links (other distinct sets of it)."""
    spark = docs.sparkSession
    shared.ship(spark)
    runs = max(1, math.ceil(math.log(1 - target_recall) / math.log(1 - similarity)))
    if runs * LEVELS > SIGNATURE:
        raise ValueError("target_recall asks for more draws than a signature has")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    described = shared.cut(docs.mapInArrow(_describe, "doc_id long, text_hash long, set_key binary, n long, sig binary"))
    rows = described.select("doc_id", "text_hash", "set_key")
    classes = shared.cut(described.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("low_id"), F.count("*").alias("mult"), F.min("n").alias("n"), F.min("sig").alias("sig")))
    draws = lambda df, level: df.select("*", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")).withColumn("bucket", F.xxhash64("bucket", "run", F.expr(f"substring(sig, ({level * runs} + run) * 4 + 1, 4)"))).withColumn("path", F.concat("path", F.array("run")))

    at = draws(classes.select("set_key", "sig", F.lit(0).cast("long").alias("bucket"), F.expr("cast(array() AS array<int>)").alias("path")), 0).select("bucket", "path", "set_key")
    leaves = None
    for level in range(1, LEVELS + 1):
        at = shared.cut(at)
        total = at.count()
        sizes = shared.cut(at.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"))
        largest = sizes.agg(F.max("c")).first()[0] or 0
        at = shared.cut(shared.attached(at, sizes, ["bucket"], largest, total).withColumnRenamed("c", "size"))
        done, big = at, at.where(F.col("size") > leaf)
        if level < LEVELS and largest > leaf:
            big = big.join(classes.select("set_key", "sig"), "set_key").withColumnRenamed("bucket", "parent").withColumn("bucket", F.col("parent"))
            below = shared.cut(draws(big, level).select("parent", "bucket", "path", "set_key", "size"))
            pairs = below.groupBy("parent", "bucket").agg(F.count("*").alias("c"), F.first("size").alias("size")).groupBy("parent").agg(F.sum(F.col("c") * F.col("c")).alias("after"), F.first("size").alias("size"))
            split = shared.cut(pairs.where(F.col("after") < F.col("size") * F.col("size")).select("parent", "size"))
            most = shared.hot_rows(total)
            done = _by_size(at, split.withColumnRenamed("parent", "bucket"), "bucket", "left_anti", most)
            at = _by_size(below, split, "parent", "left_semi", most).select("bucket", "path", "set_key")
        else:
            big = None
        leaves = done if leaves is None else leaves.unionByName(done)
        if big is None:
            break
    blocks = F.ceil(F.col("size") / F.lit(leaf)).cast("int")
    placed = leaves.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("set_key", F.lit(7)), F.col("blocks")).cast("int"))
    placed = placed.select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")).select("bucket", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "path", "set_key")
    by = ("bucket", "p", "q")
    slim = classes.select("set_key", "n", "mult", "sig")

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.Table] = []
        for table in _groups(batches, by):
            if table.num_rows > 1:
                left, right = _candidates(table, runs, similarity)
                if len(left):
                    out.append(table.take(pa.array(np.union1d(left, right))))
            if len(out) >= 256:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
                out = []
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    met = placed.join(slim, "set_key").select("bucket", "p", "q", "block", "path", "set_key", "n", "mult", "sig")
    flagged = shared.cut(met.repartition(*by).sortWithinPartitions(*by).mapInArrow(flag, met.schema))
    folder = _flag_folder(flagged.select("set_key").distinct())

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [shared.mapped(u, np.uint64) for u in shared.listing(folder, ".keys")]
        wanted = np.sort(np.concatenate(parts)) if sum(len(p) for p in parts) < 1 << 20 else None
        seen: set[bytes] = set()
        for batch in _row_chunks(batches):
            values, offs = shingles(split_words(*utf8(batch.column("text")), ALNUM))
            keys = set_keys(values, offs)
            lead = np.array([int.from_bytes(k[:8], "little") if k else 0 for k in keys], np.uint64)
            hit = np.zeros(len(keys), bool)
            for held in [wanted] if wanted is not None else parts:
                if len(held):
                    hit |= held[np.minimum(np.searchsorted(held, lead), len(held) - 1)] == lead
            own = [k for k in np.flatnonzero(hit).tolist() if keys[k] and keys[k] not in seen]
            seen.update(keys[k] for k in own)
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in own], pa.binary()), pa.array([values[offs[k] : offs[k + 1]].tobytes() for k in own], pa.binary())], ["set_key", "grams"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, by):
            left, right = _candidates(table, runs, similarity)
            sets = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
            ok = _links(sets, left, right, similarity) if len(left) else np.zeros(0, bool)
            left, right = left[ok], right[ok]
            if not len(left):
                continue
            mult, n = table.column("mult").to_numpy(), table.num_rows
            links = np.bincount(left, mult[right], n) + np.bincount(right, mult[left], n)
            texts = np.bincount(left, minlength=n) + np.bincount(right, minlength=n)
            keys = table.column("set_key").to_pylist()
            root = _forest(n, left, right)
            own = np.flatnonzero(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[k] for k in own], pa.binary()), pa.array([keys[root[k]] for k in own], pa.binary()), pa.array(links[own].astype(np.int64)), pa.array(texts[own].astype(np.int64))],
                ["set_key", "root", "links", "text_links"],
            )

    sets = docs.select("text").where("text IS NOT NULL").mapInArrow(gather, "set_key binary, grams binary")
    sets = sets.groupBy("set_key").agg(F.min("grams").alias("grams"))
    full = flagged.join(sets, "set_key")
    found = shared.cut(full.repartition(*by).sortWithinPartitions(*by).mapInArrow(verify, "set_key binary, root binary, links long, text_links long"))
    roots = stars(found.selectExpr("set_key AS a", "root AS b"))
    links = found.groupBy("set_key").agg(F.sum("links").alias("links"), F.sum("text_links").alias("text_links"))
    info = classes.select("set_key", "mult", "low_id").join(links, "set_key", "left").join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("class_key", F.coalesce("root", "set_key"))
    info = shared.cut(info.select("set_key", "mult", "low_id", "links", "text_links", "class_key"))
    low = info.groupBy("class_key").agg(F.min("low_id").alias("class_id"))
    info = info.drop("low_id").join(low, "class_key")
    out = rows.join(info, "set_key", "left")
    return out.select(
        "doc_id", "text_hash", "set_key", "class_key",
        F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (F.coalesce("mult", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("text_links", F.lit(0)).alias("n_text_links"),
    )


def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "n_links", "n_text_links")


#: All pairs of sets that share an n-gram, and a walk over the links from every set.
SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT r, doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' ')))) AS s FROM d WHERE len(w) > 0),
k AS (SELECT r, doc_id, md5(array_to_string(s, '|')) AS k, s FROM g),
c AS (SELECT k, count(*) AS mult, min(doc_id) AS low, any_value(len(s)) AS n, any_value(s) AS s FROM k GROUP BY k),
t AS (SELECT k, n, unnest(s) AS gram FROM c),
e AS (SELECT a.k AS a, b.k AS b FROM t a JOIN t b ON a.gram = b.gram AND a.k < b.k GROUP BY a.k, b.k HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
walk AS (SELECT k AS a, k AS b FROM c UNION SELECT walk.a, l.b FROM walk JOIN l ON walk.b = l.a),
cls AS (SELECT walk.a AS k, min(c.low) AS class_id FROM walk JOIN c ON walk.b = c.k GROUP BY walk.a),
n AS (SELECT l.a AS k, CAST(sum(c.mult) AS BIGINT) AS links, count(*) AS texts FROM l JOIN c ON l.b = c.k GROUP BY l.a)
SELECT d.doc_id, CASE WHEN k.k IS NULL THEN d.doc_id ELSE cls.class_id END AS class_id, coalesce(c.mult, 1) - 1 + coalesce(n.links, 0) AS n_links, coalesce(n.texts, 0) AS n_text_links
FROM d LEFT JOIN k ON d.r = k.r LEFT JOIN c ON k.k = c.k LEFT JOIN cls ON k.k = cls.k LEFT JOIN n ON k.k = n.k
"""
