"""Periodic runs of words by grammar-compressed run detection.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), at least ``LENGTH`` words
and ``TIMES`` periods long, that no neighbouring word extends.

1. Every window of ``LENGTH // TIMES`` words inside a run occurs again in the run, one period away. Word hashes of a
   whole batch find the stretches of at least ``LENGTH`` words whose windows all occur again in their text; hashes
   that collide only make a stretch longer. Nothing outside these stretches can be in a run.
2. Re-Pair over the exact word ids of a text's stretches: the most frequent pair becomes a nonterminal until no pair
   occurs twice; the rest of each stretch is bracketed into a balanced tree.
3. Each nonterminal's boundary is looked at once, at one of its occurrences: two Z-functions a side give, for every
   period, how far it reaches to the left and to the right (Main and Lorentz). Shorter periods win over their multiples.
4. The runs of a nonterminal are moved to all its derivation positions, and intervals of one period that overlap by a
   period are merged: the lowest nonterminal that holds a whole run has found it whole.

The work is a projection: no shuffle, memory bounded by a batch and, for one long text, by its words. A text that is
null, empty or without words has no words and no runs; its collapsed text is empty. Repeated rows and ids are
judged row by row, an empty table gives an empty table, other columns are kept, a column named like the result is
replaced.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgscreen.llm.common import BLANK, Words, blocks, encoded, mix, pieces

LENGTH = 24
TIMES = 3

RESULT = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"

Run = tuple[int, int, int]  # first word, word after the last, period


def stretches(texts: list[bytes], length: int = LENGTH, times: int = TIMES) -> list[list[tuple[int, int]]]:
    """For each text the word ranges in which every window of ``length // times`` words occurs again in the text."""
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    size = length // times
    for a, b in blocks(texts):
        parts = [(t, p) for t in range(a, b) for p in pieces(texts[t])]
        hashes, owner = [], []
        for c, d in blocks([p for _, p in parts]):
            words = Words([p for _, p in parts[c:d]], BLANK == 0)
            hashes.append(words.hash)
            owner.append(np.array([t for t, _ in parts[c:d]], np.int64)[words.doc])
        if not hashes:
            continue
        h, doc = np.concatenate(hashes), np.concatenate(owner)
        n = len(h) - size + 1
        if n <= 0:
            continue
        window = np.zeros(n, np.uint64)
        for j in range(size):
            window = window * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
        first = np.flatnonzero(doc[:n] == doc[size - 1 :])
        key = mix(mix(window[first]) + doc[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(n + 2, np.int8)
        again[first[order[1:][same]] + 1] = 1
        again[first[order[:-1][same]] + 1] = 1
        edge = np.flatnonzero(again[1:] != again[:-1])
        starts, ends = edge[0::2], edge[1::2]
        long = ends - starts + size - 1 >= length
        base = np.searchsorted(doc, np.arange(a, b))
        for s, e in zip(starts[long].tolist(), ends[long].tolist()):
            t = int(doc[s])
            found[t].append((s - int(base[t - a]), e - int(base[t - a]) + size - 1))
    return found


class Grammar:
    """Re-Pair over ``word``: a list of ids in which each negative id is a barrier that occurs once.

    Nonterminal ``base + i`` derives ``left[i] right[i]``; ``size[i]`` words, first met at word ``at[i]``.
    ``rest`` maps the words where a symbol of the remaining sequence starts to that symbol.
    """

    def __init__(self, word: list[int]):
        n = len(word)
        self.base = base = max(word, default=0) + 1
        self.left: list[int] = []
        self.right: list[int] = []
        self.size: list[int] = []
        self.at: list[int] = []
        symbol, after, before = list(word), list(range(1, n + 1)), list(range(-1, n - 1))
        where: dict[tuple[int, int], list[int]] = {}
        for i in range(n - 1):
            if word[i] >= 0 and word[i + 1] >= 0:
                where.setdefault((word[i], word[i + 1]), []).append(i)
        turn = 0
        queue = []
        for pair, places in where.items():
            if len(places) > 1:
                queue.append((-len(places), turn, pair))
                turn += 1
        heapq.heapify(queue)

        def live(pair: tuple[int, int]) -> list[int]:
            """Places of the pair that do not overlap."""
            x, y = pair
            out, end = [], -1
            for i in where[pair]:
                if i > end and symbol[i] == x and after[i] < n and symbol[after[i]] == y:
                    out.append(i)
                    if x == y:
                        end = after[i]
            return out

        while queue:
            count, rank, pair = heapq.heappop(queue)
            places = live(pair)
            if len(places) < 2:
                where.pop(pair)
                continue
            if len(places) < -count:
                where[pair] = places if pair[0] != pair[1] else where[pair]
                heapq.heappush(queue, (-len(places), rank, pair))
                continue
            where.pop(pair)
            x, y = pair
            new = base + len(self.left)
            self.left.append(x)
            self.right.append(y)
            self.size.append(self._size(x) + self._size(y))
            self.at.append(places[0])
            fresh: dict[tuple[int, int], list[int]] = {}
            for i in places:
                j = after[i]
                symbol[i], symbol[j] = new, -n - 1
                k = after[j]
                after[i] = k
                if k < n:
                    before[k] = i
                    if symbol[k] >= 0:
                        fresh.setdefault((new, symbol[k]), []).append(i)
                p = before[i]
                if p >= 0 and symbol[p] >= 0:
                    fresh.setdefault((symbol[p], new), []).append(p)
            for pair, places in fresh.items():
                if len(places) > 1:
                    where[pair] = places
                    heapq.heappush(queue, (-len(places), turn, pair))
                    turn += 1
        self.rest = {}
        i = 0
        while i < n:
            self.rest[i] = symbol[i]
            i = after[i]

    def _size(self, symbol: int) -> int:
        return 1 if symbol < self.base else self.size[symbol - self.base]


def _z(s: list) -> list[int]:
    """For each position the length of the longest prefix of ``s`` that starts there."""
    n = len(s)
    out = [0] * n
    if n:
        out[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = out[i - left]
            if i + k < right:
                out[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def crossing(word: list[int], start: int, cut: int, stop: int, length: int, times: int) -> list[Run]:
    """Runs of ``word[start:stop]`` that hold words on both sides of ``cut``, as far as they reach in that range."""
    left, right = word[start:cut], word[cut:stop]
    top = (stop - start) // times
    best: dict[tuple[int, int], int] = {}

    def keep(s: int, e: int, q: int) -> None:
        if s < cut < e and e - s >= length and e - s >= times * q and best.get((s, e), q) >= q:
            best[s, e] = q

    back = left[::-1]
    ahead, behind = _z(right), _z(back)
    most = min(top, len(right))
    reach = _z([*back, None, *right[:most][::-1], *back])
    for q in range(1, most + 1):
        keep(cut - reach[len(back) + 1 + most - q], cut + q + (ahead[q] if q < len(right) else 0), q)
    most = min(top, len(left))
    reach = _z([*right, None, *left[len(left) - most :], *right])
    for q in range(1, most + 1):
        keep(cut - q - (behind[q] if q < len(left) else 0), cut + reach[len(right) + 1 + most - q], q)
    return [(s, e, q) for (s, e), q in best.items()]


def runs_of(sequences: list[list[int]], length: int = LENGTH, times: int = TIMES) -> list[list[Run]]:
    """The runs of each sequence of word ids, in order of start and period; one grammar serves all sequences."""
    word: list[int] = []
    starts = []
    for k, ids in enumerate(sequences):
        starts.append(len(word))
        word += ids
        word.append(-1 - k)
    grammar = Grammar(word)
    n, none = len(word), len(word)
    earlier, later, last = [-none] * n, [2 * none] * n, {}
    for i in range(n - 1):  # nearest other places of the two words around each boundary
        pair = word[i], word[i + 1]
        j = last.get(pair)
        if j is not None:
            earlier[i], later[j] = j, i
        last[pair] = i

    def across(start: int, cut: int, stop: int) -> list[Run]:
        near = min(cut - 1 - earlier[cut - 1] if earlier[cut - 1] >= start else none, later[cut - 1] - cut + 1 if later[cut - 1] + 1 < stop else none)
        if stop - start < length or near > (stop - start) // times:
            return []
        return crossing(word, start, cut, stop, length, times)

    base, own, useful = grammar.base, [], []
    for x, y, size, at in zip(grammar.left, grammar.right, grammar.size, grammar.at):
        own.append([(s - at, e - at, q) for s, e, q in across(at, at + grammar._size(x), at + size)])
        useful.append(bool(own[-1]) or x >= base and useful[x - base] or y >= base and useful[y - base])
    intervals: list[Run] = []
    places: list[list[int]] = [[] for _ in own]
    for at, symbol in grammar.rest.items():
        if symbol >= base and useful[symbol - base]:
            places[symbol - base].append(at)
    for i in range(len(own) - 1, -1, -1):
        x, y = grammar.left[i], grammar.right[i]
        for at in places[i]:
            intervals += [(at + s, at + e, q) for s, e, q in own[i]]
        if x >= base and useful[x - base]:
            places[x - base] += places[i]
        if y >= base and useful[y - base]:
            shift = grammar._size(x)
            places[y - base] += [at + shift for at in places[i]]
    heads = sorted(grammar.rest)
    for k, ids in enumerate(sequences):  # the remaining symbols of a sequence, as a balanced tree
        todo = [(starts[k], starts[k] + len(ids))]
        while todo:
            start, stop = todo.pop()
            if stop - start < length:
                continue
            lo, hi = bisect_right(heads, start), bisect_left(heads, stop)
            if lo >= hi:
                continue
            cut = heads[min(max(bisect_left(heads, (start + stop) // 2), lo), hi - 1)]
            intervals += across(start, cut, stop)
            todo += [(start, cut), (cut, stop)]

    merged: list[list[int]] = []
    for s, e, q in sorted(intervals, key=lambda x: (x[2], x[0])):
        if merged and merged[-1][2] == q and s <= merged[-1][1] - q:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, q])
    least: dict[tuple[int, int], int] = {}
    for s, e, q in merged:
        least[s, e] = min(q, least.get((s, e), q))
    out: list[list[Run]] = [[] for _ in sequences]
    for (s, e), q in least.items():
        k = bisect_right(starts, s) - 1
        out[k].append((s - starts[k], e - starts[k], q))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def judged(words: list[bytes], ranges: list[tuple[int, int]], length: int = LENGTH, times: int = TIMES) -> list[Run]:
    """The runs of a text, given its words and the ranges that can hold runs."""
    number: dict[bytes, int] = {}
    ids = [[number.setdefault(w, len(number)) for w in words[a:b]] for a, b in ranges]
    found = [(a + s, a + e, q) for (a, _), runs in zip(ranges, runs_of(ids, length, times)) for s, e, q in runs]
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words outside all runs, and the first period of each run as far as no other run drops it."""
    out, at = [], 0
    for s, e in sorted((s + q, e) for s, e, q in runs):
        if e > at:
            out += words[at : max(at, s)]
            at = e
    return out + words[at:]


def _finder(length: int, times: int):
    fields = [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = encoded(batch)
            counts, edges, rows, collapsed = [], [0], [], []
            for text, ranges in zip(texts, stretches(texts, length, times)):
                words = text.split()
                runs = judged(words, ranges, length, times) if ranges else []
                counts.append(len(words))
                rows += runs
                edges.append(len(rows))
                collapsed.append(b" ".join(kept_words(words, runs) if runs else words))
            start, stop, period = np.array(rows, np.int64).reshape(-1, 3).T
            listed = pa.ListArray.from_arrays(
                pa.array(edges, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in (start, stop - start, period)], fields=[pa.field(*f) for f in fields])
            )
            columns = [pa.array(counts, pa.int64()), listed, pa.array(collapsed, pa.binary()).view(pa.string())]
            yield pa.StructArray.from_arrays(columns, names=["n_words", "runs", "collapsed"])

    return F.arrow_udf(find, RESULT)


def with_runs(docs: DataFrame, text: str = "text", out: str = "periodic", length: int = LENGTH, times: int = TIMES) -> DataFrame:
    """``docs`` with ``out``: number of words, runs (start, length, period) and the text with each run cut to one period."""
    if length < times or times < 3:
        raise ValueError("runs of at least 3 periods and as many words")
    return docs.withColumn(out, _finder(length, times)(F.col(text)))
