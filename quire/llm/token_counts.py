"""Token counts by offset-mapped attribution.

A document is encoded once, whole. The byte spans of its tokens are joined with the spans of its sections, and a token that
crosses a border is allocated by an explicit rule: to the section that holds most of its characters and, at a tie, to the
earlier one (``majority``), or to the section of its first character (``first``).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import public_tokenizers

RULES = ("majority", "first")


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The tokenizer of a rank file, and the bytes of each id. Control strings in texts are ordinary text."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for piece, rank in ranks.items():
        lengths[rank] = len(piece)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def allocate(tokens: np.ndarray, borders: np.ndarray, weight: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. ``tokens`` holds the byte lengths of successive tokens, ``borders`` where sections end (the
    last is the text's end), ``weight`` the characters before each byte of the text and at its end."""
    stop = np.cumsum(tokens)
    start = stop - tokens
    section = np.searchsorted(borders, start, side="right")
    if rule == "majority" and len(tokens):
        until = np.searchsorted(borders, stop - 1, side="right")
        for i in np.flatnonzero(section != until).tolist():
            cuts = np.concatenate(([start[i]], borders[section[i] : until[i]], [stop[i]]))
            # Characters that begin in each part; of a token without any (the rest of one character), bytes.
            share = np.diff(weight[cuts])
            section[i] += int(np.argmax(share if share.any() else np.diff(cuts)))
    return np.bincount(section, minlength=len(borders))


def attribute(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n", rule: str = "majority", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``<id>, n_tokens, sections``: per row, the tokens of the whole text and ``start, stop, n_tokens`` of its sections.

    Sections end after each ``separator`` (one character) and at the text's end; ``start`` and ``stop`` are characters. Every
    token is in one section, so counts add up to ``n_tokens``; of sections that hold as much of a token the first gets it. A null
    or empty text has no tokens and no sections. Texts of any length are encoded whole. Repeated rows and null ids stay, and an
    empty table gives no rows. Other columns are not read. ``path`` is a rank file that executors can open.
    """
    assert rule in RULES and len(separator) == 1 and separator.isascii()
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    section = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, lengths = encoding(path, pattern)
        for batch in batches:
            total, at, starts, stops, counts = [], [0], [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                tokens = lengths[np.array(tokenizer.encode_ordinary(text), dtype=np.int64)]
                raw = np.frombuffer(text.encode(), dtype=np.uint8)
                total.append(len(tokens))
                if len(raw):
                    weight = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                    borders = np.union1d(np.flatnonzero(raw == ord(separator)) + 1, [len(raw)])
                    counts.append(allocate(tokens, borders, weight, rule))
                    ends = weight[borders]
                    stops.append(ends), starts.append(np.concatenate(([0], ends[:-1])))
                    at.append(at[-1] + len(borders))
                else:
                    at.append(at[-1])
            flat = [pa.array(np.concatenate(x) if x else np.empty(0), pa.int64()) for x in (starts, stops, counts)]
            sections = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(flat, fields=list(section)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), sections], [id_col, "n_tokens", "sections"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, sections array<struct<start:long,stop:long,n_tokens:long>>")
