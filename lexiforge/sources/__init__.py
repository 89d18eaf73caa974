"""Bracketed morpheme corpora, alphabets, weights and metrics as DataFrames.

A corpus line is a surface form, a space and a tree: leaves are (text:label), inner nodes (name child child ...).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.shipping import ship

LEAF = r"([^():]+):([^():]+)[)]"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """raw and line_no of a text corpus: increasing in the order in which the lines are read, but with gaps between partitions."""
    return spark.read.text(path).select(F.col("value").alias("raw"), F.monotonically_increasing_id().alias("line_no"))


def limited(corpus: DataFrame, rows: int) -> DataFrame:
    """The first rows of a corpus in line order (a loader's cap)."""
    return corpus.orderBy("line_no").limit(rows)


def surface(raw: Column) -> Column:
    return F.substring_index(F.trim(raw), " ", 1)


def leaves(raw: Column) -> Column:
    """array<struct<word, label>> of the leaves of a line, left to right; blanks inside the tree don't count."""
    text = F.regexp_replace(F.substring(F.trim(raw), F.instr(F.concat(F.trim(raw), F.lit(" ")), " "), F.length(raw)), " ", "")
    words, labels = (F.regexp_extract_all(text, F.lit(LEAF), F.lit(k)) for k in (1, 2))
    return F.zip_with(words, labels, lambda w, l: F.struct(w.alias("word"), l.alias("label")))


def segments(raw: Column) -> Column:
    """array<struct<word, label, i, j, chunk>> of a line: leaves with their places in the underlying form."""
    kind = lambda l: F.when(l == "prefix", 0).when(l == "suffix", 1).otherwise(2)
    found = leaves(raw)
    ends = F.transform(found, lambda _, k: F.aggregate(F.slice(found, 1, k + 1), F.lit(0), lambda n, x: n + F.length(x["word"])))
    return F.zip_with(found, ends, lambda x, e: F.struct(x["word"].alias("word"), x["label"].alias("label"), (e - F.length(x["word"])).alias("i"), e.alias("j"), kind(x["label"]).alias("chunk")))


def underlying(raw: Column) -> Column:
    """The underlying form: the leaves' texts, joined."""
    return F.array_join(F.transform(leaves(raw), lambda x: x["word"]), "")


def _grow(tree: str) -> tuple[list[list], str]:
    """(rows of [parent, name, children], what was wrong) of a printed tree. Row 0 is the root above the tree.

    What a text means follows from the brackets around it: "(text(" opens an inner node, "(text)" is a leaf, "))" closes;
    a text behind a closing bracket belongs to the next name.
    """
    rows: list[list] = [[-1, "ROOT", []]]
    path, left, carry, wrong = [0], "", "", ""
    for text, right in re.findall(r"([^()]*)([()])", re.sub(r"\s+", "", tree)):
        around, text = left + right, carry + text
        carry = "" if left == "(" else text
        if left == "(":
            rows.append([path[-1], text, []])
            rows[path[-1]][2].append(len(rows) - 1)
        if around == "((":
            path.append(len(rows) - 1)
        elif around in ("))", ")"):
            if len(path) == 1:
                wrong = wrong or "surplus )"
            else:
                path.pop()
        left = right
    if len(path) > 1 or left == "(":
        wrong = wrong or "unclosed ("
    return rows, wrong


def parse_line(raw: str | None) -> tuple[str, str, list[dict], str]:
    """(surface form, underlying form, nodes in preorder, what was wrong). Spans of inner nodes cover all their children."""
    sr, _, tree = (raw or "").strip().partition(" ")
    rows, wrong = _grow(tree)
    if "(" in sr:
        wrong = "no surface form"
    labels = {"prefix": 1, "suffix": 2}
    out: list[dict] = []
    at, todo, ends = 0, [(0, -1, False)], {}
    while todo:
        k, parent, done = todo.pop()
        _, name, children = rows[k]
        if done:
            ends[k][1] = at
            continue
        leaf = not children and k > 0
        if k > 0 and not leaf and len(children) > 2:
            wrong = wrong or "more than two children"
        word, _, label = name.partition(":")
        if leaf and (":" not in name or label not in ("prefix", "suffix", "stem")):
            wrong = wrong or "odd label"
        ends[k] = [at, at + len(word) if leaf else at]
        out.append({"key": k, "node_id": len(out), "parent_id": parent, "label": labels.get(label, 0) if leaf else 0, "word": word if leaf else None, "is_leaf": leaf})
        me = len(out) - 1
        if leaf:
            at += len(word)
        else:
            todo.append((k, parent, True))
            todo += [(c, me, False) for c in reversed(children)]
    for x in out:
        x["i"], x["j"] = ends[x.pop("key")]
    return sr, "".join(x["word"] for x in out if x["is_leaf"]), out, wrong


def parse(corpus: DataFrame) -> DataFrame:
    """line_no, sr, ur, n, m, nodes (preorder, the root first), parse_ok and parse_issue of lines (line_no, raw).

    Nothing raises: odd lines are read as far as they go and flagged.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for line_no, raw in zip(pdf["line_no"], pdf["raw"], strict=True):
                sr, ur, nodes, wrong = parse_line(raw)
                made.append((line_no, sr, ur, len(sr), len(ur), nodes, not wrong, wrong or None))
            yield pd.DataFrame(made, columns=["line_no", "sr", "ur", "n", "m", "nodes", "parse_ok", "parse_issue"])

    ship(corpus.sparkSession)
    node = "struct<node_id:int,parent_id:int,i:int,j:int,label:int,word:string,is_leaf:boolean>"
    return corpus.select("line_no", "raw").mapInPandas(run, f"line_no long, sr string, ur string, n int, m int, nodes array<{node}>, parse_ok boolean, parse_issue string")


def display(nodes: list) -> str:
    """A tree with the places of its nodes, such as S(0,6) ( re(0,2) pay(2,5) )."""
    below: dict[int, list] = {}
    for x in nodes:
        below.setdefault(x["parent_id"], []).append(x)
    show = lambda x: f"{x['word'] if x['is_leaf'] else 'S'}({x['i']},{x['j']})" + (" ( " + " ".join(map(show, below[x["node_id"]])) + " )" if x["node_id"] in below else "")
    return " ".join(map(show, below.get(-1, [])))


def checked(parsed: DataFrame) -> DataFrame:
    """Leaves whose word is not the underlying form's text at their place (a data-quality test: none)."""
    return parsed.select("line_no", "ur", F.explode("nodes").alias("x")).where("x.is_leaf AND x.word <> substring(ur, x.i + 1, x.j - x.i)")


def alphabet(words: DataFrame, columns: tuple[str, ...] = ("word",), seeds: tuple[str, ...] = ()) -> DataFrame:
    """symbol, id: "" is 0, then the seeds, then characters in order of first sight (line_no, column, place).

    Characters are aggregated before they are numbered, so the window holds one row for each character.
    """
    seen = None
    for k, c in enumerate(columns):
        own = words.select("line_no", F.posexplode(F.split(c, "")).alias("pos", "symbol")).where("symbol <> ''").select("symbol", F.struct("line_no", F.lit(k).alias("c"), "pos").alias("at"))
        seen = own if seen is None else seen.union(own)
    first = seen.groupBy("symbol").agg(F.min("at").alias("at"))
    fixed = words.sparkSession.createDataFrame([(s, i) for i, s in enumerate(("", *seeds))], "symbol string, id int")
    new = first.join(fixed, "symbol", "left_anti").select("symbol", (F.row_number().over(Window.orderBy("at")) + len(seeds)).cast("int").alias("id"))
    return fixed.union(new)


def save_alphabet(symbols: DataFrame, path: str) -> None:
    """One symbol a line, in order of id."""
    symbols.coalesce(1).sortWithinPartitions("id").select("symbol").write.mode("overwrite").text(path)


def load_alphabet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.expr(r"regexp_replace(value, '\n$', '')"), "\n")).alias("id", "symbol")).select("symbol", "id")


def save_weights(weights: DataFrame, path: str, model: str, epoch: int) -> None:
    """Weights with the optimizer's state (k, w, q, u), kept by model and epoch."""
    weights.withColumns({"model": F.lit(model), "epoch": F.lit(epoch)}).write.mode("append").partitionBy("model", "epoch").parquet(path)


def load_weights(spark: SparkSession, path: str, model: str, epoch: int | None = None) -> DataFrame:
    """The weights of an epoch, or of the last."""
    own = spark.read.parquet(path).where(F.col("model") == model)
    epoch = own.agg(F.max("epoch")).first()[0] if epoch is None else epoch
    return own.where(F.col("epoch") == epoch).drop("model", "epoch")


def log_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").parquet(path)
