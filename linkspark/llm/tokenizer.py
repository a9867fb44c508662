"""Encoding texts with a public byte-level BPE vocabulary as a streaming transducer (problem 6).

Two machines run one behind the other, and both keep a bounded amount of state whatever the length of a text:

* ``Splitter`` reads the text in chunks and cuts it where the vocabulary's pattern does. Only the last characters of a
  chunk are held back, as further text can change a cut by at most ``HOLD`` characters. A run of one class that is
  longer than a chunk is handed on in open fragments.
* ``Transducer`` turns the bytes of a piece into ids. From the merge list it computes a sufficient lookahead: the number
  of bytes behind a position beyond which further bytes can't change whether a token ends there. A later merge can
  only be prevented by an earlier one that begins inside it, so chains of overlapping merges in ascending order bound
  the influence; their greatest reach is found in one pass over the list. Tokens that end at least that far before the
  end of what has been read are stable and are emitted; the rest stays in the window.

``Decoder`` goes back from ids to text with an incremental state machine for UTF-8.
"""

from __future__ import annotations

import base64
import codecs
import heapq
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from linkspark.llm.spread import spread

#: Where the public vocabularies lie; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters read at a time, and the last ones of them that further text may still cut otherwise.
CHUNK = 8192
HOLD = 3
#: Ids that are gathered before they leave a task, but for one text's own.
EMITTED = 1 << 20
#: Pieces whose ids a task remembers.
REMEMBERED = 200_000

# The pattern is part of the public vocabulary: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PIECE = regex.compile(PATTERN)
# How an open run goes on, by the class of its last character.
_GOES_ON = [
    (regex.compile(r"\s"), regex.compile(r"\s*(?!\S)")),
    (regex.compile(r"\p{L}"), regex.compile(r"\p{L}*")),
    (regex.compile(r"\p{N}"), regex.compile(r"\p{N}*")),
    (regex.compile(r"."), regex.compile(r"[^\s\p{L}\p{N}]*")),
]


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """The tokens' bytes and ids; an id is also the place of its merge in the list."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def sufficient_lookahead(ranks: dict[bytes, int]) -> int:
    """Bytes behind a position that decide whether a token ends there."""
    reach_of_prefix: dict[bytes, int] = {}
    most = 1
    for token in sorted(ranks, key=ranks.__getitem__):
        n = reach = len(token)
        if n < 2:
            continue
        for i in range(1, n):
            reach = max(reach, i + reach_of_prefix.get(token[i:], 0))
        most = max(most, reach)
        for j in range(1, n + 1):
            if reach_of_prefix.get(token[:j], 0) < reach:
                reach_of_prefix[token[:j]] = reach
    return most


def merge(ranks: dict[bytes, int], piece: bytes) -> list[bytes]:
    """The tokens of ``piece``: the lowest ranked pair is joined first, the leftmost of equals."""
    if piece in ranks:
        return [piece]
    if len(piece) <= 48:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts
    n = len(piece)
    end = list(range(1, n + 1))  # where the token that begins at i ends; 0 once it was joined to the one before
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or not end[mid] or end[mid] != to:
            continue
        end[i], end[mid] = to, 0
        if to < n:
            before[to] = i
            if (r := ranks.get(piece[i : end[to]])) is not None:
                heapq.heappush(heap, (r, i, end[to]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:to])) is not None:
            heapq.heappush(heap, (r, p, to))
    out, i = [], 0
    while i < n:
        out.append(piece[i : end[i]])
        i = end[i]
    return out


class Splitter:
    """Cuts a text into ``(fragment, piece ends here)``, reading ``chunk`` characters at a time."""

    def __init__(self, chunk: int = CHUNK):
        self.chunk = max(chunk, 4 * HOLD)

    def __call__(self, text: str) -> Iterator[tuple[str, bool]]:
        held, at, goes_on = "", 0, None
        while True:
            buffer = held + text[at : at + self.chunk]
            at += self.chunk
            final = at >= len(text)
            sure = len(buffer) if final else len(buffer) - HOLD
            done = 0
            if goes_on is not None:
                m = goes_on.match(buffer)
                done = m.end() if m else 0
                if not final and done > sure:
                    yield buffer[: max(sure, 0)], False
                    held = buffer[max(sure, 0) :]
                    continue
                yield buffer[:done], True
                goes_on = None
            for m in _PIECE.finditer(buffer, done):
                if m.end() > sure:
                    break
                yield m.group(), True
                done = m.end()
            if final:
                return
            if not done and sure >= self.chunk:  # one run fills the chunk
                yield buffer[:sure], False
                goes_on = next(on for last, on in _GOES_ON if last.match(buffer[sure - 1]) or on is _GOES_ON[-1][1])
                done = sure
            held = buffer[done:]


class Transducer:
    """Ids of texts by a merge list, with constant memory; its own results for short pieces are remembered."""

    def __init__(self, ranks: dict[bytes, int], lookahead: int | None = None, chunk: int = CHUNK):
        self.ranks = ranks
        self.lookahead = lookahead or sufficient_lookahead(ranks)
        self.split = Splitter(chunk)
        self.memory: dict[str, list[int]] = {}

    def ids(self, text: str | None) -> list[int]:
        """The ids of a text; those of null and of the empty text are the empty list."""
        out: list[int] = []
        for some in self.stream(text):
            out += some
        return out

    def stream(self, text: str | None) -> Iterator[list[int]]:
        """The ids as they become stable."""
        if not text:
            return
        memory, window = self.memory, b""
        for fragment, ends in self.split(text):
            if ends and not window:
                if (known := memory.get(fragment)) is not None:
                    yield known
                    continue
                data = fragment.encode("utf-8", "surrogatepass")
                if len(data) <= 2 * self.lookahead:
                    known = [self.ranks[t] for t in merge(self.ranks, data)]
                    if len(data) <= 256:
                        if len(memory) >= REMEMBERED:
                            memory.clear()
                        memory[fragment] = known
                    yield known
                    continue
                window = data
            else:
                window += fragment.encode("utf-8", "surrogatepass")
            while len(window) > 2 * self.lookahead:
                part = window[: 2 * self.lookahead]
                stable, upto = [], 0
                for t in merge(self.ranks, part):
                    if upto + len(t) > len(part) - self.lookahead:
                        break
                    stable.append(self.ranks[t])
                    upto += len(t)
                yield stable
                window = window[upto:]
            if ends:
                yield [self.ranks[t] for t in merge(self.ranks, window)] if window else []
                window = b""


class Decoder:
    """Text from ids, one after the other: bytes that end inside a character wait for the rest of it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {i: t for t, i in ranks.items()}

    def text(self, ids: Iterable[int]) -> str:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        return "".join(machine.decode(self.tokens[i]) for i in ids) + machine.decode(b"", True)


_OF_WORKER: dict[str, Transducer] = {}


def transducer(vocabulary: str = VOCABULARY) -> Transducer:
    """The worker's transducer for a vocabulary file."""
    if vocabulary not in _OF_WORKER:
        _OF_WORKER[vocabulary] = Transducer(load_ranks(_here(vocabulary)))
    return _OF_WORKER[vocabulary]


def _send(df: DataFrame, vocabulary: str) -> None:
    """Sends the driver's vocabulary file to the executors of a cluster, which need not have it in its place."""
    sc = df.sparkSession.sparkContext
    if not re.match(r"local(\[|$)", sc.master) and os.path.exists(vocabulary):
        sc.addFile(vocabulary)


def _here(vocabulary: str) -> str:
    return vocabulary if os.path.exists(vocabulary) else SparkFiles.get(os.path.basename(vocabulary))


def encode(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(<id_column>, ids ARRAY<INT>)``, one row per row of ``df``.

    Defined cases: a null and an empty text have the empty list; white space has ids; strings of special tokens are
    ordinary text; repeated rows are encoded each. Other columns are ignored, whatever their names.
    """
    kind = df.schema[id_column].dataType.simpleString()
    _send(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary)
        for batch in batches:
            flat: list[np.ndarray] = []
            ends, first = [0], 0
            for i, text in enumerate(batch.column(1)):
                flat.append(np.array(t.ids(text.as_py()), np.int32))
                ends.append(ends[-1] + len(flat[-1]))
                if ends[-1] >= EMITTED or i + 1 == batch.num_rows:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat), pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(flat)), lists], [id_column, "ids"])
                    flat, ends, first = [], [0], i + 1

    return spread(df.select(id_column, text_column)).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(<id_column>, n_tokens BIGINT)`` by the same transducer, without keeping ids."""
    kind = df.schema[id_column].dataType.simpleString()
    _send(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary)
        for batch in batches:
            n = [sum(map(len, t.stream(text.as_py()))) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], [id_column, "n_tokens"])

    return spread(df.select(id_column, text_column)).mapInArrow(run, f"`{id_column}` {kind}, n_tokens bigint")


def decode(df: DataFrame, id_column: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(<id_column>, text)`` from ``ids``; an empty or null list gives the empty text."""
    kind = df.schema[id_column].dataType.simpleString()
    _send(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Decoder(load_ranks(_here(vocabulary)))
        for batch in batches:
            texts = [d.text(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_column, "text"])

    return df.select(id_column, "ids").mapInArrow(run, f"`{id_column}` {kind}, text string")
