"""Language-model scores from a Brown class-based trigram model, trained here.

A text is its words and one end token. The model is
``P(token | two tokens before) = P(class | two classes before) * P(token | class)``; class
transitions are interpolated from trigram over bigram to unigram counts, and a token's share of
its class gets 0.5 added. The end token has a class of its own. Words seen once in training share
a class with the words that training has never seen, which count as one further member, so the
model is a proper distribution over training tokens and "unknown".

Classes come from the exchange algorithm. Words that make up at least ``SHARE`` of all training
tokens (at most 1 / SHARE of them exist, whatever the corpus) are moved between classes until no
move raises the likelihood. Every other word that occurs twice or more is then exchanged in rounds,
in parallel over ranges of word hashes: it moves into the class that its own neighbours in the
whole training corpus make likeliest, given the classes that all words have at the round's start
and the class counts of the whole corpus under them. The first round knows no class of these words
yet; in the others one word in ``TURNS`` has its turn. Rounds go on until fewer than ``FEW`` of
these words move while each has a turn, or until that has not raised the likelihood, and then
the classes of the highest likelihood stay; so they always end.

The corpus is tokenised once, into chunks of some million tokens that hold their distinct words
(64-bit hashes) and numbers into them, and written to the shared checkpoint folder. Counts and
classes travel between chunks and hash ranges: a range gets each chunk's distinct words of that
range with their counts and, for words that may move, how often each pair of classes is beside
them in the chunk, and answers each chunk with the words' corpus counts and classes. So no vocabulary is broadcast or collected; what the driver holds (the counts of class
trigrams and of pairs of the most frequent words) has a fixed bound.

Edge cases: null and empty texts are one end token; without training rows all words are unknown;
a null id is in the fold of the empty string; repeated rows are learnt from and scored each; an
empty table gives an empty result; other columns are not carried. Two words of equal 64-bit hash
would count as one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, fold, prepare, range_bits, release, table
from ._text import U64, slices, words

SHARE = 1 / 2000
CLASSES = 64
#: Sweeps of the exchange that no corpus should need, since each raises the likelihood; more are an error.
SWEEPS = 1_000
#: Rounds end when a smaller share of the words that aren't frequent moves.
FEW = 0.1
#: In each round after the first one word in so many has its turn, so that few neighbours move at once.
TURNS = 2
CHUNK = 500_000
#: Ranges of word hashes, as bits, at least and at most; so many bytes of input (as the optimiser knows it) fill one.
RANGE_BITS, RANGE_BYTES, MOST_BITS = 8, 8_000_000, 18
#: Weight of the next lower order in class transitions: bigrams, trigrams.
LOWER = (5.0, 20.0)
END = 0x0123456789ABCDEF


_SHUT, _OPENED = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(x: np.ndarray) -> bytes:
    return _SHUT.compress(np.ascontiguousarray(x))


def _open(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(_OPENED.decompress(blob), dtype=kind)


# --- chunks


def chunked(docs: DataFrame, trains: Column, key: str, text: str) -> DataFrame:
    """Chunks: ids, which of them train (bytes), token bounds, tokens as numbers, the distinct words, their training counts."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches):
        seq, held, size = 0, [], 0

        def send():
            hashes = np.concatenate([h for _, _, h, _ in held])
            lengths = np.concatenate([np.diff(b) for _, _, _, b in held])
            bounds = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(lengths)])
            train = np.concatenate([t for _, t, _, _ in held])
            distinct, number = np.unique(hashes, return_inverse=True)
            counts = np.bincount(number, weights=np.repeat(train, lengths), minlength=len(distinct)).astype(np.int64)
            # Frequent words get small numbers, which pack better.
            order = np.argsort(-np.bincount(number, minlength=len(distinct)), kind="stable")
            rank = np.empty(len(order), dtype=np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            ids = pa.concat_arrays([i for i, _, _, _ in held])
            cols = [pa.array([(TaskContext.get().partitionId() << 32) | seq], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
            blobs = [train.astype(np.uint8), bounds, rank[number], distinct[order], counts[order].astype(np.uint32)]
            cols += [pa.array([_pack(x)], pa.binary()) for x in blobs] + [pa.array([int(counts.sum())], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=["chunk", "ids", "train", "bounds", "tokens", "words", "counts", "n"])

        for batch in batches:
            for part in slices(batch, 1):
                w = words(part.column(1), "space")
                hashes = np.insert(w.hashes, w.bounds[1:], U64(END))
                held.append((part.column(0), part.column(2).to_numpy(zero_copy_only=False).astype(bool), hashes, w.bounds + np.arange(len(w.bounds))))
                size += len(hashes)
                if size >= CHUNK:
                    yield send()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield send()

    read = docs.select(key, text, F.coalesce(trains, F.lit(False)).alias("_train"))
    return read.mapInArrow(work, f"chunk long, ids array<{kind}>, train binary, bounds binary, tokens binary, words binary, counts binary, n long")


def _ranges(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts words by range and otherwise keeps it, and each range's bounds in it."""
    part = (hashes >> U64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)  # numpy sorts 16 bits by radix
    return np.argsort(part, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(part, minlength=1 << bits))])


# --- the most frequent words


def frequent_words(chunks: DataFrame, least: float, bits: int) -> list[int]:
    """Hashes of the words with at least so many training tokens, most frequent first."""

    def send(batches):
        for batch in batches:
            for words_, counts in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                h, n = _open(words_, np.uint64), _open(counts, np.uint32)
                h, n = h[n > 0], n[n > 0]
                order, at = _ranges(h, bits)
                parts = np.flatnonzero(np.diff(at))
                pick = [order[at[p] : at[p + 1]] for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([h[x].tobytes() for x in pick], pa.binary()), pa.array([_pack(n[x]) for x in pick], pa.binary())], names=["part", "words", "counts"])

    def total(group):
        h = np.frombuffer(b"".join(group.column("words").to_pylist()), dtype=np.uint64)
        n = np.concatenate([_open(x, np.uint32) for x in group.column("counts").to_pylist()])
        h, number = np.unique(h, return_inverse=True)
        n = np.bincount(number, weights=n)
        return pa.table({"word": h[n >= least].view(np.int64), "n": n[n >= least].astype(np.int64)})

    sent = chunks.select("words", "counts").mapInArrow(send, "part int, words binary, counts binary")
    rows = sent.groupBy("part").applyInArrow(total, "word long, n long").where(F.col("word") != np.array([END], dtype=np.uint64).view(np.int64)[0].item()).collect()
    return [r.word & (1 << 64) - 1 for r in sorted(rows, key=lambda r: (-r.n, r.word))]


def _numbered(words_: np.ndarray, known: np.ndarray, other: int, end: int) -> np.ndarray:
    """Of each word its number among the sorted known ones, or ``other``, or ``end``."""
    out = np.full(len(words_), other, dtype=np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, words_), len(known) - 1)
        same = known[at] == words_
        out[same] = at[same]
    out[words_ == U64(END)] = end
    return out


def _before(sequence: np.ndarray, bounds: np.ndarray, first: int) -> np.ndarray:
    """The value before each one, at a text's beginning ``first``."""
    out = np.empty_like(sequence)
    out[1:] = sequence[:-1]
    out[bounds[:-1]] = first
    return out


def pair_counts(chunks: DataFrame, known: np.ndarray) -> np.ndarray:
    """How often each pair of frequent words (then: any other word, the end) is adjacent in training texts."""
    wide = len(known) + 2

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                bounds, train = _open(row["bounds"], np.int64), _open(row["train"], np.uint8).astype(bool)
                number = _numbered(_open(row["words"], np.uint64), known, wide - 2, wide - 1)[_open(row["tokens"], np.uint32)]
                code = (_before(number, bounds, wide - 1) * wide + number)[np.repeat(train, np.diff(bounds))]
                code, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

    rows = chunks.select("train", "bounds", "tokens", "words").mapInArrow(work, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    out = np.zeros(wide * wide)
    got = rows.toArrow()
    out[got.column("code").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(wide, wide)


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of the words (all rows but the last two, which stay alone): moves one word at a time while that helps."""
    n = len(pairs) - 2
    classes = max(1, min(classes, n))
    of = np.append(np.arange(n) % classes, [classes, classes + 1])
    wide = classes + 2
    into = np.zeros((len(pairs), wide))
    into[np.arange(len(pairs)), of] = 1
    right, left = pairs @ into, pairs.T @ into  # word to following classes; word to preceding classes
    between = into.T @ right
    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            a, own, r, le = of[w], pairs[w, w], right[w].copy(), left[w].copy()
            between[a] -= r
            between[:, a] -= le
            between[a, a] += own
            r[a] -= own
            le[a] -= own
            k = np.arange(classes)
            rows, cols = between[:classes], between[:, :classes].T
            gain = (_h(rows + r) - _h(rows)).sum(1) + (_h(cols + le) - _h(cols)).sum(1)
            own_cell = between[k, k]
            gain -= _h(own_cell + r[k]) + _h(own_cell + le[k]) - 2 * _h(own_cell)
            gain += _h(own_cell + r[k] + le[k] + own) - _h(own_cell)
            # Classes' own sizes, which hold the word's neighbours wherever it goes.
            sent, met = rows.sum(1) + le[k], cols.sum(1) + r[k]
            gain -= _h(sent + r.sum() + own) - _h(sent) + _h(met + le.sum() + own) - _h(met)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            r[b] += own
            le[b] += own
            between[b] += r
            between[:, b] += le
            between[b, b] -= own
            if b != a:
                moved += 1
                of[w] = b
                right[:, a] -= pairs[:, w]
                right[:, b] += pairs[:, w]
                left[:, a] -= pairs[w]
                left[:, b] += pairs[w]
        if not moved:
            return of[:n]
    raise RuntimeError(f"the exchange still moves words after {sweeps} sweeps")


# --- all other words


def likelihood(pairs: np.ndarray) -> float:
    """Log likelihood of the class bigrams and of words in their classes, up to a term that classes don't change."""
    return float(_h(pairs).sum() - _h(pairs.sum(0)).sum() - _h(pairs.sum(1)).sum())


def _best(whose: np.ndarray, near: np.ndarray, times: np.ndarray, held: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The class that each word's neighbours make likeliest, which is the one it has (``held``, if not negative) unless another is likelier.

    Word number ``whose`` has so many ``times`` the neighbours ``near``: the class before * classes + the class after.
    """
    wide = len(pairs)
    k, between = wide - 2, pairs + 0.5
    # Up to what is the same for all classes: log P(class | left) + log P(right | class) - log N(class).
    size = np.log(between.sum(1)[:k])
    before, after = np.log(between[:, :k]), np.log(between[:k]).T - 2 * size
    out = np.zeros(len(held), dtype=np.int64)
    for lo in range(0, len(held), 50_000):
        m = min(50_000, len(held) - lo)
        some = (whose >= lo) & (whose < lo + m) if m < len(held) else slice(None)
        w, code, n = (whose[some] - lo) * wide, near[some].astype(np.int64), times[some]
        left, right = (np.bincount(w + side, weights=n, minlength=m * wide).reshape(m, wide) for side in (code // wide, code % wide))
        fit = np.round(left @ before + right @ after, 6)  # so that ties don't hang on the order of sums
        best, own = np.argmax(fit, axis=1), held[lo : lo + m]
        stays = (own >= 0) & (fit[np.arange(m), np.maximum(own, 0)] >= fit[np.arange(m), best])
        out[lo : lo + m] = np.where(stays, own, best)
    return out


def _by_word(row: dict, answers: dict) -> tuple[np.ndarray, np.ndarray]:
    """Corpus counts and classes of a chunk's words, from the answers of all ranges."""
    h = _open(row["words"], np.uint64)
    order, at = _ranges(h, answers["bits"])
    total, cls = np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=np.uint8)
    for p, c, k in zip(answers["part"], answers["counts"], answers["classes"], strict=True):
        where = order[at[p] : at[p + 1]]
        total[where], cls[where] = _open(c, np.uint64).astype(np.int64), _open(k, np.uint8)
    return total, cls


SENT = "chunk long, part int, words binary, counts binary, old binary, near binary, spans binary, times binary"


def _histograms(where: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words 0 to n - 1 the distinct codes, word by word: where each word's begin, the codes, and how often each occurs."""
    order = np.argsort(code, kind="stable")  # numpy sorts 16 bits by radix, so the pair is sorted by three such passes
    for half in (where.astype(np.uint16), (where >> 16).astype(np.uint16)):
        order = order[np.argsort(half[order], kind="stable")]
    where, code = where[order], code[order]
    first = np.ones(len(where), dtype=bool)
    first[1:] = (where[1:] != where[:-1]) | (code[1:] != code[:-1])
    at = np.flatnonzero(first)
    begins = np.concatenate([[0], np.cumsum(np.bincount(where[at], minlength=n))])
    return begins, code[at], np.diff(np.append(at, len(where))).astype(np.uint32)


def _sent(row: dict, symbols: np.ndarray, moves: np.ndarray, bits: int, wide: int, old: bool) -> pa.RecordBatch:
    """What a chunk sends to each range: its words, their counts, their classes if they have one (``old``), and how often which
    classes are beside training tokens of the words that move; and, as part -1, the chunk's pairs of classes."""
    bounds, train = _open(row["bounds"], np.int64), _open(row["train"], np.uint8).astype(bool)
    h, n, tokens = _open(row["words"], np.uint64), _open(row["counts"], np.uint32), _open(row["tokens"], np.uint32)
    symbol, learnt = symbols.astype(np.uint16)[tokens], np.repeat(train, np.diff(bounds))  # wide is at most 256
    before = _before(symbol, bounds, wide - 1) * np.uint16(wide)
    times = np.bincount((before + symbol)[learnt], minlength=wide * wide)
    pair, code = np.flatnonzero(times), before
    code[:-1] += symbol[1:]  # an end token, which has no right neighbour, is never looked at
    mine = moves[tokens] & learnt
    order, at = _ranges(h, bits)
    place = np.empty(len(h), dtype=np.uint32)
    place[order] = np.arange(len(h), dtype=np.uint32)
    ends, codes, times_ = _histograms(place[tokens[mine]], code[mine], len(h))
    cells = np.diff(ends).astype(np.uint32)
    parts = np.flatnonzero(np.diff(at))
    pick = [order[at[p] : at[p + 1]] for p in parts]
    cols = [pa.array(np.full(len(parts) + 1, row["chunk"]), pa.int64()), pa.array([*parts, -1], pa.int32())]
    cols += [pa.array([*[h[x].tobytes() for x in pick], None], pa.binary()), pa.array([*[_pack(n[x]) for x in pick], _pack(times[pair])], pa.binary())]
    cols.append(pa.array([*[_pack(symbols[x].astype(np.uint8)) if old else None for x in pick], None], pa.binary()))
    cols.append(pa.array([*[_pack(codes[ends[at[p]] : ends[at[p + 1]]]) for p in parts], _pack(pair)], pa.binary()))
    cols.append(pa.array([*[_pack(cells[at[p] : at[p + 1]]) for p in parts], None], pa.binary()))
    cols.append(pa.array([*[_pack(times_[ends[at[p]] : ends[at[p + 1]]]) for p in parts], None], pa.binary()))
    return pa.RecordBatch.from_arrays(cols, names=["chunk", "part", "words", "counts", "old", "near", "spans", "times"])


def first_sent(chunks: DataFrame, known: np.ndarray, of: np.ndarray, wide: int, bits: int) -> DataFrame:
    """What chunks send when only the frequent words have classes."""
    every = np.append(of, [wide - 2, wide - 1]).astype(np.int64)

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                number = _numbered(_open(row["words"], np.uint64), known, len(known), len(known) + 1)
                yield _sent(row, every[number], number == len(known), bits, wide, False)

    return chunks.select("chunk", "train", "bounds", "tokens", "words", "counts").mapInArrow(work, SENT)


def next_sent(chunks: DataFrame, answers: DataFrame, known: np.ndarray, wide: int, bits: int, turn: int) -> DataFrame:
    """What chunks send when all words have classes, and words whose hash is ``turn`` modulo ``TURNS`` may move."""
    turns = TURNS

    def work(left, right):
        if not left.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("chunk", pa.int64()), ("part", pa.int32()), *((b, pa.binary()) for b in ("words", "counts", "old", "near", "spans", "times")))})
        row = left.to_pylist()[0]
        total, cls = _by_word(row, right.select(["part", "counts", "classes"]).to_pydict() | {"bits": bits})
        h = _open(row["words"], np.uint64)
        moves = (_numbered(h, known, len(known), len(known) + 1) == len(known)) & (total >= 2) & (h % U64(turns) == U64(turn))
        return pa.Table.from_batches([_sent(row, cls, moves, bits, wide, True)])

    given = answers.where("chunk IS NOT NULL").select("chunk", "part", "counts", "classes").groupBy("chunk")
    return chunks.select("chunk", "train", "bounds", "tokens", "words", "counts").groupBy("chunk").cogroup(given).applyInArrow(work, SENT)


def class_pairs(sent: DataFrame, wide: int) -> np.ndarray:
    """How often each pair of classes is adjacent in training texts."""

    def work(batches):
        for batch in batches:
            for near, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(_open(near, np.int64)), pa.array(_open(counts, np.int64))], names=["code", "n"])

    got = sent.where("part = -1").select("near", "counts").mapInArrow(work, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(wide * wide)
    out[got.column("code").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(wide, wide)


def _answers(sent: DataFrame, known: np.ndarray, of: np.ndarray, pairs: np.ndarray, turn: int | None = None) -> DataFrame:
    """For each chunk and hash range the corpus counts and classes of the chunk's words there (n is null);
    and for each range by class the tokens and distinct words, and as part -1 the words that moved and that could (chunk is null)."""
    k, turns = len(pairs) - 2, TURNS
    kinds = k + 2  # classes, then once-seen and unknown words, then the end
    fixed = np.append(of, [k, k + 1]).astype(np.int64)

    def answer(group):
        chunk = group.column("chunk").to_numpy()
        hs = [np.frombuffer(x, dtype=np.uint64) for x in group.column("words").to_pylist()]
        ns = np.concatenate([_open(x, np.uint32) for x in group.column("counts").to_pylist()])
        h, number = np.unique(np.concatenate(hs), return_inverse=True)
        total = np.bincount(number, weights=ns).astype(np.int64)
        found = _numbered(h, known, len(known), len(known) + 1)
        cls = fixed[found]
        moves = repeated = (found == len(known)) & (total >= 2)
        held = np.full(len(h), -1, dtype=np.int64)
        if turn is not None:
            held[number] = np.concatenate([_open(x, np.uint8) for x in group.column("old").to_pylist()])
            cls = np.where(repeated, held, cls)
            moves = repeated & (h % U64(turns) == U64(turn))
        near, spans, times = (np.concatenate([_open(x, kind) for x in group.column(c).to_pylist()]) for c, kind in (("near", np.uint16), ("spans", np.uint32), ("times", np.uint32)))
        whose = np.repeat(number, spans)
        at = np.flatnonzero(moves)
        among = np.full(len(h), -1, dtype=np.int64)
        among[at] = np.arange(len(at))
        whose = among[whose]
        cls[at] = _best(whose[whose >= 0], near[whose >= 0], times[whose >= 0], held[at], pairs)
        seen = total > 0
        tokens, distinct = np.bincount(cls, weights=total, minlength=kinds), np.bincount(cls[seen], minlength=kinds)
        edge = np.concatenate([[0], np.cumsum([len(x) for x in hs])])
        mine = [number[edge[j] : edge[j + 1]] for j in range(len(hs))]
        rows, more = len(hs), kinds + 1
        return pa.table({
            "chunk": pa.array([*chunk.tolist(), *[None] * more], pa.int64()),
            "part": pa.array([*group.column("part").to_pylist(), *range(kinds), -1], pa.int32()),
            "counts": pa.array([*[_pack(total[x].astype(np.uint64)) for x in mine], *[None] * more], pa.binary()),
            "classes": pa.array([*[_pack(cls[x].astype(np.uint8)) for x in mine], *[None] * more], pa.binary()),
            "n": pa.array([*[None] * rows, *tokens.astype(np.int64).tolist(), int((cls != held)[at].sum())], pa.int64()),
            "distinct": pa.array([*[None] * rows, *distinct.tolist(), int(repeated.sum())], pa.int64()),
        })

    return sent.where("part >= 0").groupBy("part").applyInArrow(answer, "chunk long, part int, counts binary, classes binary, n long, distinct long")


class Rounds:
    """The rounds over all words that aren't frequent: ``run`` gives the last answers, ``told`` each round's words that moved
    and that could, and the likelihood before it. What rounds write goes when it isn't needed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.told, self.held = spark, [], {}

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        self.held[name] = cut(df)
        del df
        release(self.spark)
        return self.held[name]

    def delete(self, *names: str) -> None:
        """Delete the files of these results, or of all."""
        release(self.spark, *[self.held.pop(n) for n in names or list(self.held)])

    def run(self, chunks: DataFrame, known: np.ndarray, of: np.ndarray, pairs: np.ndarray, bits: int) -> DataFrame:
        wide = int(of.max()) + 3 if len(of) else 3
        into = np.zeros((len(pairs), wide))
        into[np.arange(len(pairs)), np.append(of, [wide - 2, wide - 1]).astype(np.int64)] = 1
        answers = self._kept(_answers(first_sent(chunks, known, of, wide, bits), known, of, into.T @ pairs @ into), "0")
        best, at, k = -np.inf, 0, 0  # the highest likelihood and the round it is that of
        while True:
            moved, movable = answers.where("chunk IS NULL AND part = -1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
            self.told.append((moved, movable, best))
            if wide == 3 or not movable or (k >= TURNS and sum(m for m, *_ in self.told[-TURNS:]) <= FEW * movable):
                break
            sent = self._kept(next_sent(chunks, answers, known, wide, bits, k % TURNS), f"sent{k}")
            between = class_pairs(sent, wide)
            now = likelihood(between)
            if now > best:
                if k > at:
                    self.delete(str(at))
                best, at = now, k
            elif k - at >= TURNS:
                answers = self.held[str(at)]
                break
            following = self._kept(_answers(sent, known, of, between, k % TURNS), str(k + 1))
            if k > at:
                self.delete(str(k))
            answers = following
            self.delete(f"sent{k}")
            k += 1
        return answers


def _classed(chunks: DataFrame, answers: DataFrame, tokens: np.ndarray, distinct: np.ndarray, bits: int, kind: str) -> DataFrame:
    """Chunks as class sequences, with sums over each text's tokens: known ones, base scores, and shares of classes."""
    n, v = float(tokens.sum()), float(distinct.sum())
    members = distinct.astype(float).copy()
    members[-2] += 1  # "unknown"
    members[-1] = max(members[-1], 1.0)
    scale = np.log10(np.maximum(tokens + 0.5 * members, 0.5))
    base = np.log10(n + 0.5 * (v + 1))

    def work(left, right):
        if not left.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("ids", left.schema.field("ids").type), *((b, pa.binary()) for b in ("train", "bounds", "classes", "known", "base", "emitted")))})
        row = left.to_pylist()[0]
        bounds, number = _open(row["bounds"], np.int64), _open(row["tokens"], np.uint32)
        total, cls = _by_word(row, right.select(["part", "counts", "classes"]).to_pydict() | {"bits": bits})
        log = np.log10(total + 0.5)
        sums = lambda x: np.add.reduceat(x[number], bounds[:-1])
        blobs = [row["train"], row["bounds"], _pack(cls[number]), _pack(sums((total > 0).astype(np.int64))), _pack(sums(log - base)), _pack(sums(log - scale[cls]))]
        return pa.table([left.column("ids").slice(0, 1), *[pa.array([b], pa.binary()) for b in blobs]], names=["ids", "train", "bounds", "classes", "known", "base", "emitted"])

    paired = chunks.select("chunk", "ids", "train", "bounds", "tokens", "words").groupBy("chunk").cogroup(answers.where("chunk IS NOT NULL").select("chunk", "part", "counts", "classes").groupBy("chunk"))
    return paired.applyInArrow(work, f"ids array<{kind}>, train binary, bounds binary, classes binary, known binary, base binary, emitted binary")


# --- class transitions and scores


def _trigrams(classes: np.ndarray, bounds: np.ndarray, wide: int) -> np.ndarray:
    c = classes.astype(np.int64)
    one = _before(c, bounds, wide - 1)
    two = _before(one, bounds, wide - 1)
    return (two * wide + one) * wide + c


def transitions(counts: np.ndarray) -> np.ndarray:
    """log10 P(c | a, b) from the counts of (a, b, c)."""
    wide = counts.shape[0]
    uni, bi = counts.sum((0, 1)), counts.sum(0)
    p1 = (uni + 1) / (uni.sum() + wide)
    p2 = (bi + LOWER[0] * p1) / (bi.sum(1, keepdims=True) + LOWER[0])
    return np.log10((counts + LOWER[1] * p2) / (counts.sum(2, keepdims=True) + LOWER[1]))


def score_texts(docs: DataFrame, trains: Column, key: str = "doc_id", text: str = "text", share: float = SHARE, classes: int = CLASSES, ranges: int | None = None) -> DataFrame:
    """Key, n_tokens, n_known, train_tokens, base_score and score of every row, learning from the rows for which ``trains`` holds."""
    spark = prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    bits = range_bits(docs, RANGE_BITS, RANGE_BYTES, MOST_BITS) if ranges is None else ranges
    chunks = cut(chunked(docs, trains, key, text))
    n = chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = np.sort(np.array(frequent_words(chunks, max(share * n, 2), bits), dtype=np.uint64))
    pairs = pair_counts(chunks, known)
    of = exchange(pairs, classes)
    rounds = Rounds(spark)
    answers = rounds.run(chunks, known, of, pairs, bits)
    wide = int(of.max()) + 3 if len(of) else 3
    tokens, distinct = np.zeros(wide, dtype=np.int64), np.zeros(wide, dtype=np.int64)
    for r in answers.where("chunk IS NULL AND part >= 0").groupBy("part").agg(F.sum("n").alias("n"), F.sum("distinct").alias("distinct")).collect():
        tokens[r.part], distinct[r.part] = r.n, r.distinct
    classed = cut(_classed(chunks, answers, tokens, distinct, bits, kind))
    rounds.delete()

    def count(batches):
        total = np.zeros(wide**3, dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                bounds, train = _open(row["bounds"], np.int64), _open(row["train"], np.uint8).astype(bool)
                code = _trigrams(_open(row["classes"], np.uint8), bounds, wide)
                total += np.bincount(code[np.repeat(train, np.diff(bounds))], minlength=wide**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    counts = np.zeros(wide**3)
    got = classed.select("train", "bounds", "classes").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts[got.column("code").to_numpy()] = got.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(transitions(counts.reshape(wide, wide, wide)).reshape(-1))

    def score(batches):
        for batch in batches:
            for k, row in enumerate(batch.select(["bounds", "classes", "known", "base", "emitted"]).to_pylist()):
                bounds = _open(row["bounds"], np.int64)
                moves = np.add.reduceat(shared.value[_trigrams(_open(row["classes"], np.uint8), bounds, wide)], bounds[:-1])
                ids = batch.column(0).slice(k, 1).flatten()
                cols = [ids, pa.array(np.diff(bounds)), pa.array(_open(row["known"], np.int64)), pa.array(np.full(len(ids), n), pa.int64())]
                cols += [pa.array(_open(row["base"], np.float64)), pa.array(moves + _open(row["emitted"], np.float64))]
                yield pa.RecordBatch.from_arrays(cols, names=[key, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return classed.select("ids", "bounds", "classes", "known", "base", "emitted").mapInArrow(score, f"{key} {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_texts(table(spark, sf_dir, "documents"), fold("doc_id") != 1)
    return out.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
