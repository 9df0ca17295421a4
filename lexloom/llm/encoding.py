"""Token ids of a whole corpus by content-defined chunk reuse.

A rolling hash over the characters cuts every text at places that depend on the text around them alone, so texts
that share passages share chunks. Each distinct chunk is encoded once. A cut is moved to the next place where the
tokenizer's own splitting must begin a new piece, which makes the join of the two chunks' ids exact; where no such
place is near, the join is marked, and its surroundings are encoded again, from the last sure place before to the
first sure place after it, until both sides agree with the ids they had.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import stored

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
WINDOW, LEAST, DIVISOR, MOST, SEARCH = 16, 128, 256, 2048, 64
# Fixed value: the public pattern that splits text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


@lru_cache(maxsize=4)
def encoder(directory: str = TOKENIZER_DIR, name: str = TOKENIZER):
    """The tokenizer of a rank file; loaded once in each worker."""
    import tiktoken

    with open(os.path.join(directory, name + ".tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=65_536)
def _class(c: str) -> str:
    """S white space, L letter, N number, P anything else; Q the apostrophe, which may begin a contraction."""
    if c == "'":
        return "Q"
    if c.isspace() and not "\x1c" <= c <= "\x1f":
        return "S"
    return {"L": "L", "N": "N"}.get(unicodedata.category(c)[0], "P")


def sure_break(text: str, at: int) -> bool:
    """Whether a new piece begins at ``at`` whatever stands around: then both sides can be encoded apart."""
    if at <= 0 or at >= len(text):
        return True
    before, after = _class(text[at - 1]), _class(text[at])
    if before == "S" or "Q" in (before, after):
        return False
    if after == "S":
        return text[at] == " " and at + 1 < len(text) and _class(text[at + 1]) not in "SQ"
    return before != after


_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.full(max(n, 2 * len(_POWERS)), _BASE, dtype=np.uint64))
    return _POWERS[:n]


def cut_places(text: str) -> list[tuple[int, bool]]:
    """(place, sure) of the inner cuts of ``text``."""
    n = len(text)
    if n <= LEAST + WINDOW:
        return []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    # hash of the window that ends at i, as a sum of mixed codes weighted by their place in the window
    mixed = codes * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    rolled = np.zeros(n - WINDOW + 1, dtype=np.uint64)
    for k in range(WINDOW):
        rolled = rolled * _BASE + mixed[k : n - WINDOW + 1 + k]
    hits = np.flatnonzero((rolled >> np.uint64(40)) % np.uint64(DIVISOR) == 0) + WINDOW
    cuts: list[tuple[int, bool]] = []
    last = 0
    for place in [*hits.tolist(), n]:
        while place - last > MOST:  # no hit for long: forced cuts
            last = _cut(text, last + MOST, min(place, n), cuts)
        if place < n and place - last >= LEAST:
            last = _cut(text, place, n, cuts)
    return cuts


def _cut(text: str, place: int, end: int, cuts: list[tuple[int, bool]]) -> int:
    """Adds a cut at the first sure place from ``place`` on, or at ``place`` itself, and returns it."""
    for at in range(place, min(place + SEARCH, end)):
        if sure_break(text, at):
            cuts.append((at, True))
            return at
    cuts.append((place, False))
    return place


def chunks(text: str) -> list[tuple[str, bool]]:
    """(chunk, whether its left join is sure) of a text; one empty chunk for an empty text."""
    cuts = [(0, True), *[c for c in cut_places(text) if c[0] < len(text)]]
    ends = [c[0] for c in cuts[1:]] + [len(text)]
    return [(text[a:z], sure) for (a, sure), z in zip(cuts, ends)]


def sure_edges(text: str) -> tuple[int | None, int | None]:
    """First and last sure place inside ``text``, None where there is none."""
    inner = range(1, len(text))
    first = next((i for i in inner if sure_break(text, i)), None)
    last = next((i for i in reversed(inner) if sure_break(text, i)), None)
    return first, last


def repaired(parts: list[tuple[str, list[int]]], sure: list[bool], tool) -> list[int]:
    """Ids of the joined text of ``parts`` (text, ids); ``sure[i]`` tells of the join before part i."""
    out: list[int] = []
    pending = ""  # text whose ids aren't settled yet: it reaches up to the join at hand
    for i, (text, ids) in enumerate(parts):
        joined_next = i + 1 < len(parts) and not sure[i + 1]
        first, last = sure_edges(text) if pending or joined_next else (None, None)
        if pending:
            if first is None:
                pending += text
                if not joined_next:
                    out += tool.encode_ordinary(pending)
                    pending = ""
                continue
            out += tool.encode_ordinary(pending + text[:first])
            pending = ""
            ids = _from(ids, len(text[:first].encode()), tool)
            text = text[first:]
            if joined_next:
                last = sure_edges(text)[1]
        if joined_next:
            if last is None:
                pending = text
                continue
            head = len(text[:last].encode())
            keep = len(ids) - len(_from(ids, head, tool))
            out += ids[:keep]
            pending = text[last:]
        else:
            out += ids
    if pending:
        out += tool.encode_ordinary(pending)
    return out


def _from(ids: list[int], offset: int, tool) -> list[int]:
    """The ids from byte ``offset`` on, which is a border of tokens."""
    at = 0
    for k, token in enumerate(ids):
        if at == offset:
            return list(ids[k:])
        at += len(tool.decode_single_token_bytes(token))
    if at != offset:
        raise ValueError("a sure place is no border of tokens")
    return []


def runs(parts: list[tuple[str, bool]]) -> list[int]:
    """Of each chunk the number of the first one that unsure joins link it with, -1 if its joins are all sure."""
    linked = [not sure for _, sure in parts]
    out, first = [], 0
    for i, own in enumerate(linked):
        if not own:
            first = i
        out.append(first if own or (i + 1 < len(parts) and linked[i + 1]) else -1)
    return out


def _encoded_chunks(documents: DataFrame, directory: str, name: str) -> DataFrame:
    """(row, doc_id, pos, run, sure, chunk, ids) of every chunk of every document; ``chunk`` only where it needs repair.

    Texts are read and cut once, into a table in the shared folder that the distinct chunks and their uses are read from.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, places, texts, sure, linked = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                parts = chunks(text)
                docs += [i] * len(parts)
                places += range(len(parts))
                texts += [c for c, _ in parts]
                sure += [s for _, s in parts]
                linked += runs(parts)
            take = pa.array(docs, pa.int32())
            columns = {
                "row": batch.column("row").take(take),
                "doc_id": batch.column("doc_id").take(take),
                "pos": pa.array(places, pa.int32()),
                "run": pa.array(linked, pa.int32()),
                "sure": pa.array(sure, pa.bool_()),
                "chunk": pa.array(texts, pa.string()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(directory, name)
        for batch in batches:
            flat, ends = array("i"), array("i", [0])
            for text in batch.column("chunk").to_pylist():
                flat.extend(tool.encode_ordinary(text))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.asarray(ends)), pa.array(np.asarray(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), ids], ["key", "ids"])

    kind = dict(documents.dtypes)["doc_id"]
    uses = stored(
        documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .mapInArrow(cut, f"row long, doc_id {kind}, pos int, run int, sure boolean, chunk string")
        .withColumn("key", F.unhex(F.md5("chunk")))
    )
    distinct = uses.select("key", "chunk").distinct()  # a hash aggregate; taking a first chunk by key would sort
    encoded = distinct.mapInArrow(encode, "key binary, ids array<int>")
    refs = uses.withColumn("chunk", F.when(F.col("run") >= 0, F.col("chunk")))
    return refs.join(encoded, "key").drop("key")


def _repair(directory: str, name: str):
    """Arrow function: linked chunks (pos, run, sure, chunk, ids) of a text to the ids of each run (pos, ids)."""

    @F.pandas_udf("array<struct<pos: int, ids: array<int>>>")
    def repair(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool = encoder(directory, name)
        for batch in batches:
            out = []
            for parts in batch:
                by_run: dict[int, list] = {}
                for p in sorted([] if parts is None else parts, key=lambda p: p["pos"]):
                    by_run.setdefault(p["run"], []).append(p)
                out.append(
                    [
                        {"pos": run, "ids": repaired([(p["chunk"], list(p["ids"])) for p in own], [p["sure"] for p in own], tool)}
                        for run, own in by_run.items()
                    ]
                )
            yield pd.Series(out, dtype=object)

    return repair


def encode_corpus(documents: DataFrame, directory: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids) of every document; null and empty texts have no ids (an empty array).

    Repeated rows give repeated rows. A very long text is spread over as many rows as it has chunks until its ids
    come together again. A chunk that very many texts share is one row of the encoded chunks; its uses are many
    rows of the other side of the join, which adaptive execution splits. Only chunks whose joins aren't sure pass
    through Python once more.
    """
    parts = _encoded_chunks(documents, directory, name)
    linked = F.col("run") >= 0
    whole = parts.groupBy("row", "doc_id").agg(
        F.collect_list(F.when(~linked, F.struct("pos", "ids"))).alias("plain"),
        F.collect_list(F.when(linked, F.struct("pos", "run", "sure", "chunk", "ids"))).alias("linked"),
    )
    mended = _repair(directory, name)(F.when(F.size("linked") > 0, F.col("linked")))
    every = F.array_sort(F.concat("plain", mended))
    return whole.select("doc_id", F.flatten(F.transform(every, lambda p: p["ids"])).alias("ids"))


def token_counts(documents: DataFrame, directory: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of every document, as many as :func:`encode_corpus` gives ids; only linked chunks carry theirs."""
    parts = _encoded_chunks(documents, directory, name).withColumn("n", F.size("ids"))
    linked = F.col("run") >= 0
    whole = parts.groupBy("row", "doc_id").agg(
        F.sum(F.when(~linked, F.col("n")).otherwise(0)).alias("plain"),
        F.collect_list(F.when(linked, F.struct("pos", "run", "sure", "chunk", "ids"))).alias("linked"),
    )
    mended = _repair(directory, name)(F.when(F.size("linked") > 0, F.col("linked")))
    extra = F.aggregate(mended, F.lit(0).cast("long"), lambda n, p: n + F.size(p["ids"]))
    return whole.select("doc_id", (F.col("plain") + extra).alias("tokens"))
