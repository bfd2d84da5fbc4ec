"""Cost-balanced packing of tokenised documents into fixed-size training sequences.

A piece of L tokens costs ``LINEAR * L + QUADRATIC * L**2`` (feed-forward and attention work). Documents are
cut into full sequences first; the remainders are taken in descending order and each goes to the sequence
of lowest cost that still has room for it. What fits nowhere is cut to fill the gaps, lowest cost first,
so all sequences but a tail are full; the tail is cut at powers of two, which need no padding.

Packing goes by blocks of consecutive documents inside one input task: no shuffle, memory bounded by
``BLOCK_TOKENS`` and the longest document, and a lost task repeats its own blocks with the same sequence
numbers (input split number, then running number).

A null or empty text is the single closing id; repeated rows are packed once each; a null doc_id stays null;
an empty table gives no pieces.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from msgscreen.llm.common import blocks

CAPACITY = 2048
#: Tokens packed together.
BLOCK_TOKENS = 1 << 22
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Distinct word pieces whose ids a worker process remembers.
MEMORY_PIECES = 1 << 19

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)
#: Texts of these characters are cut by the rule below as by the vocabulary's own one (letters, digits, rest).
_PLAIN = re.compile(r"[^\n\t\r -~\xa1-\xff]")
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_CUT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")


#: A blank and letters: such pieces, one behind the other, are cut apart again by the tokenizer's own rule.
_WORD = re.compile(rf" [{_LETTER}]+")
#: Pieces that go through the tokenizer as one text.
JOINED_PIECES = 2000


class Known(dict):
    """Ids of pieces. A piece that is not known gives None and is noted."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> None:
        self.new.append(piece)


class Tokens:
    """Ids of whole texts. Word pieces repeat, so each is looked up once and its ids are kept."""

    def __init__(self, path: str, added_tokens: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        # An added token spans pieces: a text that could hold one goes to the tokenizer whole.
        self.model.encode_special_tokens = not added_tokens
        added = sorted({t.content for t in self.model.get_added_tokens_decoder().values() if t.content})
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.known = Known()

    def learn(self, pieces: list[str]) -> None:
        """Ids of pieces not met yet; words in long rows, since a call for each costs more than its ids."""
        word, other = [], []
        fits = _WORD.fullmatch
        for p in pieces:
            (word if fits(p) else other).append(p)
        for a in range(0, len(word), JOINED_PIECES):
            row = word[a : a + JOINED_PIECES]
            code = self.model.encode("".join(row), add_special_tokens=False)
            owner = np.array(code.word_ids)
            if len(owner) and owner[-1] != len(row) - 1:
                other += row  # another rule than the expected one
                continue
            raw = np.array(code.ids, "<u4").tobytes()
            edge = (4 * np.searchsorted(owner, np.arange(len(row) + 1))).tolist()
            self.known.update(zip(row, [raw[i:j] for i, j in zip(edge, edge[1:])]))
        for piece, code in zip(other, self.model.encode_batch(other, add_special_tokens=False)):
            self.known[piece] = np.array(code.ids, "<u4").tobytes()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        cut = [None if _PLAIN.search(t) or self.added and self.added.search(t) else _CUT.findall(t) for t in texts]
        if len(self.known) > MEMORY_PIECES:  # the earliest met are the most frequent: they stay
            kept = list(itertools.islice(self.known.items(), MEMORY_PIECES // 2))
            self.known.clear()
            self.known.update(kept)
        find, new = self.known.__getitem__, self.known.new
        found, short = [], []
        for i, pieces in enumerate(cut):
            before = len(new)
            found.append(None if pieces is None else list(map(find, pieces)))
            if len(new) > before:
                short.append((i, len(new) - before))
        if short:
            self.learn(list(set(new)))
            for i, missing in short:  # only the gaps are looked up again
                pieces, row, at = cut[i], found[i], -1
                for _ in range(missing):
                    at = row.index(None, at + 1)
                    row[at] = find(pieces[at])
            new.clear()
        whole = iter(self.model.encode_batch([t for t, p in zip(texts, cut) if p is None], add_special_tokens=False))
        return [np.array(next(whole).ids, "<u4") if f is None else np.frombuffer(b"".join(f), "<u4") for f in found]


def worker_tokens(path: str, added_tokens: bool) -> Tokens:
    """The tokenizer of this worker process, with the pieces that its earlier tasks have met.

    Task functions arrive by value with globals of their own, so what lasts over tasks is kept by the process.
    """
    import sys
    import types

    store = sys.modules.setdefault("_msgscreen_worker", types.ModuleType("_msgscreen_worker"))
    key = (path, added_tokens, os.path.getmtime(path))
    if getattr(store, "tokens_key", None) != key:
        store.tokens_key, store.tokens = key, Tokens(path, added_tokens)
    return store.tokens


def cost(length):
    return LINEAR * length + QUADRATIC * length * length


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of the given lengths."""
    out, rest, n_seq = [], [], 0
    for d, n in enumerate(lengths):
        full = n // capacity
        for j in range(full):
            out.append((d, j * capacity, capacity, n_seq, 0))
            n_seq += 1
        if n % capacity:
            rest.append((n % capacity, d))
    rest.sort(key=lambda r: (-r[0], r[1]))
    m = sum(r[0] for r in rest) // capacity
    room, load = np.full(m, capacity), np.zeros(m)
    left: list[tuple[int, int, int]] = []

    def put(d: int, start: int, length: int, s: int) -> None:
        out.append((d, start, length, n_seq + s, int(capacity - room[s])))
        room[s] -= length
        load[s] += cost(length)

    for length, d in rest:
        start = lengths[d] - length
        s = int(np.argmin(np.where(room >= length, load, np.inf))) if m else 0
        if m and room[s] >= length:
            put(d, start, length, s)
        else:
            left.append((d, start, length))
    tail: list[tuple[int, int, int]] = []
    gaps = iter(sorted(np.flatnonzero(room).tolist(), key=lambda s: (load[s], s)))
    s = next(gaps, None)
    for d, start, length in left:
        while length and s is not None:
            part = min(length, int(room[s]))
            put(d, start, part, s)
            start, length = start + part, length - part
            if not room[s]:
                s = next(gaps, None)
        if length:
            tail.append((d, start, length))
    n_seq += m
    total = sum(t[2] for t in tail)
    sizes = [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
    offset = 0
    for d, start, length in tail:
        while length:
            part = min(length, sizes[0] - offset)
            out.append((d, start, part, n_seq, offset))
            start, length, offset = start + part, length - part, offset + part
            if offset == sizes[0]:
                sizes.pop(0)
                n_seq, offset = n_seq + 1, 0
    return out


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY,
           doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS, added_tokens: bool = False) -> DataFrame:
    """One row per piece (``PIECES``). ``tokenizer`` is the path of a tokenizer file that workers can read.

    With ``added_tokens`` the literal of an added token in a text gets that token's id, as the file's tokenizer gives
    it when left as loaded; without, a special one's literal is plain characters.
    """

    def flush(first: int, keys: list, ids: list[np.ndarray]) -> tuple[pa.RecordBatch, int]:
        pieces = pack([len(i) for i in ids], capacity)
        names = [c.split()[0] for c in PIECES.split(", ")]
        rows = [
            (keys[d], start, length, zlib.crc32(ids[d][start : start + length].tobytes()), len(ids[d]), first + s, offset)
            for d, start, length, s, offset in pieces
        ]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
        return pa.RecordBatch.from_arrays(columns, names), 1 + max(p[3] for p in pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_tokens(tokenizer, added_tokens)
        first = TaskContext.get().partitionId() << 36
        keys, ids, held = [], [], 0
        for batch in batches:
            given, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts):
                for key, code in zip(given[a:b], model.ids(texts[a:b])):
                    keys.append(key)
                    ids.append(np.append(code, np.uint32(end_id)).astype("<u4"))
                    held += len(ids[-1])
                if held >= block_tokens:
                    done, used = flush(first, keys, ids)
                    yield done
                    first, keys, ids, held = first + used, [], [], 0
        if keys:
            yield flush(first, keys, ids)[0]

    return docs.select(docs[doc_id].cast("bigint"), docs[text]).mapInArrow(run, PIECES)
