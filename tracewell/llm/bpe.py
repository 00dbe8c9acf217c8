"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A worker gathers the texts of many megabytes as numbers of their distinct words. The words are laid
end to end as byte tokens, and an inverted index from a merge's rank to the positions where it
applies is kept; merges are taken in rank order over all words at once, each over all of its
positions as arrays, and touch only their two neighbours, whose new pairs join the index. Each distinct
word is replayed once a gathering. A word that is itself a token is that token, whatever the merges would give. Where a merge gives rise
to one of lower rank, which tables that were not made by merging allow, the rest of its word's
merges depends on their order in the word, and that word is replayed position by position.

Decoding goes the same way: the ids of each distinct word are turned into bytes once, and a text's
bytes are those of its words.

The tokenizer's file is read by the driver and sent to the executors once; its size is fixed.

Edge cases: a null text is empty and has no ids; a very long word costs n log n steps, not n
squared, and some 40 bytes of memory a byte; repeated rows are encoded each; an empty table gives
an empty result; other columns are not carried, but by ``counted``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StructField, StructType

from ._spark import prepare, table
from ._text import slices, spread

#: Words and their bytes that a worker keeps from one gathering to the next; beyond that it starts anew.
KEPT_WORDS, KEPT_BYTES = 100_000, 2_000_000
#: Bytes of text that are gathered before their new words are replayed.
GATHERED = 8_000_000

#: White space as Unicode defines it (fixed values).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token to rank, from lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


#: What a pattern's classes hold among ASCII characters (fixed values).
ASCII_CLASSES = {r"\s": "".join(c for c in SPACE if c < "\x80"), r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\d": "0-9"}


def rewritten(pattern: str, classes: dict[str, str]) -> str | None:
    """A pattern with classes spelt out: bare within brackets, in brackets of their own elsewhere. None if it has a class that isn't known."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        sign = pattern[at]
        if sign == "\\":
            m = re.compile(r"\\([pP])\{(\^?)([^}]*)\}|\\(.)", re.S).match(pattern, at)
            name = rf"\p{{{m[3]}}}" if m[1] else "\\" + m[4].lower()
            no = (m[1] == "P") != bool(m[2]) if m[1] else m[4] in "SDW"
            if (m[1] or m[4] in "sSdDwW") and (name not in classes or (no and inside)):
                return None
            known = classes.get(name, name)
            out.append(m[0] if known == name else known if inside else f"[{'^' * no}{known}]")
            at = m.end()
            continue
        if sign == "[" and not inside:
            inside = True
        elif sign == "]" and inside:
            inside = False
        out.append(sign)
        at += 1
    return "".join(out)


def splitter(pattern: str):
    """A function from a text to the pattern's matches, with white space as Unicode defines it."""
    import regex

    every = {c: c for c in (r"\p{L}", r"\p{N}", r"\d")}
    full = regex.compile(rewritten(pattern, {r"\s": SPACE} | every) or pattern)
    # For ASCII texts the classes are short, and the standard module is faster, where it knows the pattern.
    try:
        quick = re.compile(rewritten(pattern, ASCII_CLASSES) or r"\p")
    except re.error:
        return full.findall
    return lambda text: (quick if text.isascii() else full).findall(text)


_MIX = np.uint64(0x9E3779B97F4A7C15)


class Pairs:
    """Ranks of token pairs: a hash table with linear probing, looked up as arrays."""

    def __init__(self, pairs: dict[int, int], wide: int):
        self.wide, bits = wide, max(4, (4 * len(pairs)).bit_length())
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.keys, self.ranks = np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int32)
        self.last = size - 1
        keys, ranks = np.fromiter(pairs, dtype=np.int64, count=len(pairs)), np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))
        at = self._slot(keys)
        while len(keys):
            # Of those that want a free slot, the first of each gets it; the others go on.
            free = np.flatnonzero(self.keys[at] < 0)
            won = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[won]], self.ranks[at[won]] = keys[won], ranks[won]
            left = np.ones(len(keys), dtype=bool)
            left[won] = False
            keys, ranks, at = keys[left], ranks[left], at[left] + 1 & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _MIX >> self.shift).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Each pair's rank, or -1."""
        keys = left.astype(np.int64) * self.wide + right
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], np.int32(-1))
        on = np.flatnonzero((found != keys) & (found >= 0))
        while len(on):
            at[on] = at[on] + 1 & self.last
            found = self.keys[at[on]]
            same = found == keys[on]
            out[on[same]] = self.ranks[at[on[same]]]
            on = on[~same & (found >= 0)]
        return out


class _Numbers(dict):
    """A word's number; a word that isn't there gets the next one."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Codec:
    """Encodes and decodes with one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, splitter(pattern)
        self.token = {rank: token for token, rank in ranks.items()}
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.wide = wide = 1 + max(self.token)
        #: left * wide + right of each pair that some token joins, to that token's rank
        self.pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left * wide + right] = rank
        self.table = Pairs(self.pairs, wide)
        bytewise = np.full((256, 256), -1, dtype=np.int32)
        for token, rank in ranks.items():
            if len(token) == 2:
                bytewise[token[0], token[1]] = rank
        self.bytewise = bytewise
        self.digit = {rank: str(rank) for rank in self.token}.__getitem__
        self._forget()

    def _forget(self) -> None:
        self.known, self.size = _Numbers(), 0
        #: Of each numbered word: its ids (laid end to end, with their ends), their digits, their bytes.
        self.flat, self.ends = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
        self.digits: list[str] = []
        self.bytes: list[bytes] = []

    def replay(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        out: list[np.ndarray | None] = [np.array([self.ranks[w]], dtype=np.int32) if w in self.ranks else None for w in words]
        todo = [k for k, ids in enumerate(out) if ids is None]
        if not todo:
            return out
        raw = np.frombuffer(b"".join(words[k] for k in todo), dtype=np.uint8)
        ends = np.cumsum([len(words[k]) for k in todo])
        first = np.full(len(raw), -1, dtype=np.int32)
        first[:-1] = self.bytewise[raw[:-1], raw[1:]]
        first[ends - 1] = -1
        tokens = self._by_rank(raw, ends, first)
        live = np.flatnonzero(tokens >= 0)
        ids, edges = tokens[live], np.searchsorted(live, [0, *ends.tolist()])
        for k, a, b in zip(todo, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            out[k] = ids[a:b]
        return out

    def _index(self, first: np.ndarray) -> dict[int, list[np.ndarray]]:
        held = np.flatnonzero(first >= 0).astype(np.int32)
        return self._grouped({}, first[held], held)

    @staticmethod
    def _grouped(index: dict[int, list[np.ndarray]], ranks: np.ndarray, places: np.ndarray, heap: list[int] | None = None) -> dict[int, list[np.ndarray]]:
        """Put places under their ranks; ranks that are new to the index go to the heap."""
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        edges = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        begins = [0, *edges.tolist()] if len(ranks) else []
        for a, b, rank in zip(begins, [*begins[1:], len(ranks)], ranks[begins].tolist(), strict=True):
            if rank in index:
                index[rank].append(places[a:b])
            else:
                index[rank] = [places[a:b]]
                if heap is not None:
                    heapq.heappush(heap, rank)
        return index

    def _by_rank(self, raw: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The token at each position, or -1; ``first``: the rank of the pair that begins there, or -1."""
        n, pair, odd = len(raw), first.copy(), set()
        tokens = np.array(self.byte, dtype=np.int32)[raw]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1
        before[ends[:-1]] = -1
        index = self._index(first)
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            parts = index.pop(rank)
            places = np.sort(np.concatenate(parts)) if len(parts) > 1 else parts[0]
            places = places[pair[places] == rank]
            if len(parts) > 1 and len(places) > 1:
                fresh = np.ones(len(places), dtype=bool)
                fresh[1:] = places[1:] != places[:-1]
                places = places[fresh]
            if not len(places):
                continue
            right = after[places]
            if len(places) > 1 and (places[1:] == right[:-1]).any():
                # Of pairs that overlap, as in a run of one letter, every other one from the left.
                begins = np.ones(len(places), dtype=bool)
                begins[1:] = places[1:] != right[:-1]
                starts = np.flatnonzero(begins)
                nth = np.arange(len(places)) - np.repeat(starts, np.diff(np.append(starts, len(places))))
                places, right = places[nth % 2 == 0], right[nth % 2 == 0]
            follows, precedes = after[right], before[places]
            lower = np.zeros(0, dtype=np.int32)
            if (beside := follows[:-1] == places[1:]).any():
                # The next place merges too; the pair with what is there yet may come before that.
                between = self.table.of(np.full(int(beside.sum()), rank), tokens[places[1:][beside]])
                lower = places[1:][beside][(between >= 0) & (between < rank)]
            tokens[places], tokens[right] = rank, -1
            pair[places] = pair[right] = -1
            after[places] = follows
            on = follows >= 0
            some, follows = places[on], follows[on]
            before[follows] = some
            behind = before[places]
            behind = behind[precedes >= 0]
            changed = np.concatenate([some, behind])
            ranks = self.table.of(tokens[changed], tokens[after[changed]])
            pair[changed] = ranks
            held = ranks >= 0
            if len(lower) or (ranks[held] < rank).any():
                for k in np.unique(np.searchsorted(ends, np.append(lower, changed[held & (ranks < rank)]), "right")).tolist():
                    pair[ends[k - 1] if k else 0 : ends[k]] = -1
                    odd.add(k)
                held = pair[changed] >= 0
            if held.any():
                self._grouped(index, pair[changed[held]], changed[held], heap)
        for k in odd:
            word = slice(int(ends[k - 1]) if k else 0, int(ends[k]))
            tokens[word] = self._by_place(raw[word], np.array([word.stop - word.start]), first[word])
        return tokens

    def _by_place(self, raw: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The same, position by position."""
        n, pairs, wide = len(raw), self.pairs, self.wide
        index = {rank: np.concatenate(x).tolist() for rank, x in self._index(first).items()}
        heap = list(index)
        heapq.heapify(heap)
        tokens = [self.byte[b] for b in raw.tolist()]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for end in ends.tolist():
            after[end - 1] = -1
            if end < n:
                before[end] = -1
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            for k, at in enumerate(places):
                left = tokens[at]
                if left < 0 or (right_at := after[at]) < 0 or pairs.get(left * wide + tokens[right_at]) != rank:
                    continue
                tokens[at], tokens[right_at] = rank, -1
                follows, precedes = after[right_at], before[at]
                after[at] = follows
                lower = False
                if follows >= 0:
                    before[follows] = at
                    new = pairs.get(rank * wide + tokens[follows])
                    if new is not None:
                        if new in index:
                            index[new].append(at)
                        else:
                            index[new] = [at]
                            heapq.heappush(heap, new)
                        lower = new < rank
                if precedes >= 0:
                    new = pairs.get(tokens[precedes] * wide + rank)
                    if new is not None:
                        if new in index:
                            index[new].append(precedes)
                        else:
                            index[new] = [precedes]
                            heapq.heappush(heap, new)
                        lower = lower or new < rank
                if lower:  # a pair of lower rank arose: it comes before the rest of this rank
                    index[rank] = places[k + 1 :] + index.get(rank, [])
                    heapq.heappush(heap, rank)
                    break
        return np.array(tokens, dtype=np.int32)

    def numbers(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Each text as numbers of its words; ``learn`` has to be called before they are looked up."""
        split, number = self.split, self.known.__getitem__
        return [np.fromiter(map(number, split(t)), dtype=np.int32) if t else np.zeros(0, dtype=np.int32) for t in texts]

    def learn(self) -> None:
        """Replay the words that have numbers and no ids yet."""
        new = [w.encode("utf-8") for w in islice(self.known, len(self.digits), None)]
        if new:
            ids = self.replay(new)
            ends, flat = np.cumsum([0, *map(len, ids)]), np.concatenate(ids)
            self.ends, self.flat = np.append(self.ends, ends[1:] + self.ends[-1]), np.append(self.flat, flat)
            flat, digits, token = flat.tolist(), self.digit, self.token.__getitem__
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                self.digits.append(" ".join(map(digits, flat[a:b])))
                self.bytes.append(b"".join(map(token, flat[a:b])))
            self.size += sum(map(len, new))

    def forget_some(self) -> None:
        if len(self.known) > KEPT_WORDS or self.size > KEPT_BYTES:
            self._forget()

    def encode(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        """The ids of each text, without special tokens."""
        numbers = self.numbers(texts)
        self.learn()
        for of in numbers:
            yield self.flat[spread(self.ends[of], self.ends[of + 1])].tolist()
        self.forget_some()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_CODECS: dict[str, Codec] = {}


def _codec(name: str, shared, pattern: str) -> Codec:
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = Codec(shared.value, pattern)
    return _CODECS[name]


def _share(spark: SparkSession, path: str, pattern: str):
    ranks = read_ranks(path)
    name = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()
    return name, prepare(spark).sparkContext.broadcast(ranks)


def _gathered(batches: Iterable[pa.RecordBatch], codec: Codec, at: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches and the numbers of their texts' words, whose ids are known; texts of ``GATHERED`` bytes are learnt from together."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, at):
            held.append((part, codec.numbers(part.column(at).to_pylist())))
            size += part.column(at).nbytes
            if size >= GATHERED:
                codec.learn()
                yield from held
                codec.forget_some()
                held, size = [], 0
    codec.learn()
    yield from held
    codec.forget_some()


def _ids(codec: Codec, numbers: list[np.ndarray]) -> pa.Array:
    """The ids of texts given as numbers of words."""
    words = np.concatenate([np.zeros(0, dtype=np.int32), *numbers])
    ids = codec.flat[spread(codec.ends[words], codec.ends[words + 1])]
    sizes = np.concatenate([[0], np.cumsum(codec.ends[words + 1] - codec.ends[words])])
    texts = np.concatenate([[0], np.cumsum([len(x) for x in numbers])]).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes[texts], pa.int32()), pa.array(ids, pa.int32()))


def encode(rows: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``ids`` of each row's text."""
    name, shared = _share(rows.sparkSession, path, pattern)

    def work(batches):
        codec = _codec(name, shared, pattern)
        for part, numbers in _gathered(batches, codec, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), _ids(codec, numbers)], names=[key, "ids"])

    return rows.select(key, text).mapInArrow(work, f"{key} {rows.schema[key].dataType.simpleString()}, ids array<int>")


def counted(rows: DataFrame, path: str, pattern: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``rows`` with the number of each text's ids."""
    name, shared = _share(rows.sparkSession, path, pattern)
    at = rows.columns.index(text)

    def work(batches):
        codec = _codec(name, shared, pattern)
        for part, numbers in _gathered(batches, codec, at):
            n = pa.array([int((codec.ends[of + 1] - codec.ends[of]).sum()) for of in numbers], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns, n], names=[*part.schema.names, out])

    return rows.mapInArrow(work, StructType([*rows.schema.fields, StructField(out, LongType())]))


def decode(rows: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """Key and ``bytes`` of each row's ids; null ids give null."""
    name, shared = _share(rows.sparkSession, path, pattern)

    def work(batches):
        codec = _codec(name, shared, pattern)
        for batch in batches:
            done = [None if ids is None else codec.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.binary())], names=[key, "bytes"])

    return rows.select(key, "ids").mapInArrow(work, f"{key} {rows.schema[key].dataType.simpleString()}, bytes binary")


def round_trip(rows: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Counts and digests of each row's ids and of the bytes that decoding the ids gives, and on demand the ids."""
    name, shared = _share(rows.sparkSession, path, pattern)

    def work(batches):
        codec = _codec(name, shared, pattern)
        for part, numbers in _gathered(batches, codec, 1):
            of_ids, of_bytes, counts = [], [], []
            for of in numbers:
                words = of.tolist()
                digits = " ".join(map(codec.digits.__getitem__, words))
                counts.append(digits.count(" ") + 1 if words else 0)
                of_ids.append(hashlib.sha256(digits.encode()).hexdigest())
                of_bytes.append(hashlib.sha256(b"".join(map(codec.bytes.__getitem__, words))).hexdigest())
            cols = [part.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(_ids(codec, numbers))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(work, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
