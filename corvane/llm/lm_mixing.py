"""LM scoring by logistic context mixing: hashed-context bit predictors, gated weights, an adaptive last step.

A token's first bit says whether it is the one that most often followed the two tokens before it in the training
texts; counts of every such place in them are gathered in a table that grows with the input, and how often they were
right, by how much was seen, is that bit's probability. A token that is not told so is spelled bit by bit. What the
model knows of these bits comes from counts under several contexts inside the token, gathered over all training
tokens; weights learned online combine them, and a table refines the result. A token's spelling costs the same
wherever it stands, so each distinct token is spelled once, however often it occurs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, clear_shuffles, constants, many_word_hashes, release, staged, word_hashes

#: Contexts: none, the last one to four bytes, all bytes of the token so far. Slots of each context's table, and of
#: the blocks in which tables travel; with 8 bytes a slot this bounds what is broadcast to 50 MB.
CONTEXTS, SLOTS, BLOCK = 6, 1 << 20, 1 << 13
#: Gates: how often the token so far and its last three bytes have been seen, by the bit's place in its byte.
WHOLE, LAST = np.array([1, 2, 4, 16, 256]), np.array([1, 16, 1024])
GATES = (len(WHOLE) + 1) * (len(LAST) + 1) * 8
#: Weights before any is learned; steps and range of the last table, in log odds.
FIRST = np.array([0.0, 0.0, 0.05, 0.1, 0.25, 0.6])
STEPS, RANGE = 33, 8.0
#: Tokens that every executor holds at most, with their scores; bytes that are looked at in one go; distinct
#: tokens that one task learns from.
FREQUENT, AT_ONCE, LEARNED = 1 << 17, 1 << 14, 1 << 18
#: Bytes of text whose places are counted together before they are sent, and that are hashed in one go; places that
#: meet in one group, and that are judged in one go.
BLOCK_BYTES, HASHED, MET, JUDGED = 1 << 21, 1 << 17, 1 << 20, 1 << 16
#: Classes of how often a place was followed by its first token, and by others; each class of both has two codes.
FIRST_SEEN, OTHERS_SEEN = np.array([2, 3, 5, 17]), np.array([1, 2, 4, 16])
CODES = 1 + 2 * (len(FIRST_SEEN) + 1) * (len(OTHERS_SEEN) + 1)
#: Stands for the end of a text; no word contains it.
END = b"\n"
_KEYS = constants(8, 11)
_SLOT_SHIFT = np.uint64(64 - (SLOTS.bit_length() - 1))


@dataclass
class Spelling:
    """Bytes of some tokens, each closed by a space, their contexts, and the token that each byte belongs to."""

    data: np.ndarray
    contexts: list[np.ndarray]
    token: np.ndarray

    def bits(self) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """For each place in a byte: the place, the bits there, and their slots in each context's table.

        A context's slots for half a byte, a tree of 15 nodes, are next to each other, so that they are hashed and read together.
        """
        for half in (0, 1):
            four = (self.data >> 4) if half == 0 else (self.data & 15)
            before = np.uint64(0) if half == 0 else ((self.data >> 4) + 1).astype(np.uint64) * _KEYS[7]
            starts = []
            for context in self.contexts:
                x = context + before
                x ^= x >> np.uint64(29)
                x *= _KEYS[6]
                x >>= _SLOT_SHIFT
                x &= np.uint64(SLOTS - 16)
                starts.append(x.view(np.int64))
            for k in range(4):
                node = (1 << k) | (four >> (4 - k))
                yield 4 * half + k, (four >> (3 - k)) & 1, [x + node for x in starts]


def spell(tokens: list[bytes]) -> Spelling:
    data = np.frombuffer(b"".join(t + b" " for t in tokens), dtype=np.uint8).astype(np.int64)
    sizes = np.array([len(t) + 1 for t in tokens])
    starts = np.cumsum(sizes) - sizes
    token = np.repeat(np.arange(len(tokens)), sizes)
    place = np.arange(len(data)) - starts[token]
    contexts, tail = [np.full(len(data), _KEYS[0])], np.zeros(len(data), dtype=np.uint64)
    for j in range(1, 5):
        last = np.full(len(data), 32, dtype=np.int64)
        last[j:] = np.where(place[j:] >= j, data[:-j], 32)
        tail = tail * np.uint64(256) + last.astype(np.uint64)
        contexts.append((tail + np.uint64(j)) * _KEYS[j])
    whole, here = np.zeros(len(data), dtype=np.uint64), np.flatnonzero(place == 0)
    state, step = np.full(len(tokens), _KEYS[5]), 0
    while len(here):
        whole[here] = state[token[here]]
        state[token[here]] = (state[token[here]] ^ data[here].astype(np.uint64)) * np.uint64(0x100000001B3)
        state[token[here]] ^= state[token[here]] >> np.uint64(31)
        step += 1
        here = here[sizes[token[here]] > step] + 1
    return Spelling(data, [*contexts, whole], token)


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[int]]]:
    """Tokens and the counts in their second column, about ``AT_ONCE`` bytes at a time."""
    tokens: list[bytes] = []
    counts: list[int] = []
    size = 0
    for batch in batches:
        for token, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tokens.append(token)
            counts.append(count)
            size += len(token) + 1
            if size >= AT_ONCE:
                yield tokens, counts
                tokens, counts, size = [], [], 0
    if tokens:
        yield tokens, counts


def count_bits(vocabulary: DataFrame) -> np.ndarray:
    """Zeros and ones counted in every slot of every context, over all training tokens: [CONTEXTS, SLOTS].

    A slot's two counts are one complex number, zeros + ones * i, and so are read together.

    Each task sums its tokens in tables of its own; block by block, tasks' tables are added up on the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((CONTEXTS, 2 * SLOTS))
        for tokens, counts in portions(batches):
            text, by = spell(tokens), np.array(counts, dtype=np.float64)
            by = by[text.token]
            for _, bit, slots in text.bits():
                for c in range(CONTEXTS):
                    np.add.at(table[c], slots[c] * 2 + bit, by)
        table = table.reshape(CONTEXTS, SLOTS, 2).swapaxes(1, 2)
        for c in range(CONTEXTS):
            blocks = range(0, SLOTS, BLOCK)
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * len(blocks), pa.int32()), pa.array(blocks, pa.int32()), pa.array([table[c, :, b : b + BLOCK].astype(np.float32).tobytes() for b in blocks], pa.binary())],
                names=["context", "block", "counts"],
            )

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, dtype=np.float32).astype(np.float64) for x in rows["counts"])
        return rows.head(1).assign(counts=[total.astype(np.float32).tobytes()])

    schema = "context int, block int, counts binary"
    rows = vocabulary.where("trained > 0").select("token", "trained").mapInArrow(run, schema).groupBy("context", "block").applyInPandas(add, schema).collect()
    table = np.zeros((CONTEXTS, SLOTS), dtype=np.complex64)
    for r in rows:
        zeros, ones = np.frombuffer(r["counts"], dtype=np.float32).reshape(2, -1)
        table[r["context"], r["block"] : r["block"] + BLOCK] = zeros + 1j * ones
    return table


@dataclass
class Said:
    """What counted bits say in each slot of each context, as log odds, and the class of how often a slot was seen.

    With ``own``, of a bit that is itself among those counted, and is taken out of them: [CONTEXTS, 2 * SLOTS], zeros first.
    """

    odds: np.ndarray
    whole: np.ndarray
    last: np.ndarray

    @classmethod
    def of(cls, table: np.ndarray, own: bool) -> Said:
        zero, one = table.real, table.imag
        log = lambda zero, one: np.log((one + np.float32(0.2)) / (zero + np.float32(0.2)))
        odds = np.concatenate([log(np.maximum(zero - 1, 0), one), log(zero, np.maximum(one - 1, 0))], axis=1) if own else log(zero, one)
        whole, last = (np.searchsorted(steps, zero[c] + one[c] - own, "right").astype(np.uint8) for c, steps in ((CONTEXTS - 1, WHOLE), (3, LAST)))
        return cls(odds, whole * np.uint8(len(LAST) + 1), last)

    def inputs(self, k: int, slots: list[np.ndarray], own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """What each context says of a bit, as a log odds, and the bit's gate; ``own`` bits are among those counted."""
        said, gate = np.empty((CONTEXTS, len(slots[0])), dtype=np.float32), np.full(len(slots[0]), k)
        beyond = None if own is None else own * SLOTS
        for c in range(CONTEXTS):
            at = slots[c]
            if c in (3, CONTEXTS - 1):
                gate += np.take(self.last if c == 3 else self.whole, at, mode="clip").astype(np.int64) << 3
            if own is not None:
                at = at + beyond
            np.take(self.odds[c], at, out=said[c], mode="clip")
        return said, gate


def mixed(weights: np.ndarray, gate: np.ndarray, said: np.ndarray) -> np.ndarray:
    """The log odds that the gates' weights make of what the contexts say; context by context, so that memory is read in order."""
    return sum(np.take(w, gate, mode="clip") * x for w, x in zip(np.ascontiguousarray(weights.T), said, strict=True))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def refined(p: np.ndarray, gate: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The mean of ``p`` and of what the last table has between the two steps next to it."""
    odds = np.clip(np.log(p / (1 - p)), -RANGE, RANGE)
    at = (odds + RANGE) * ((STEPS - 1) / (2 * RANGE))
    low = np.minimum(at.astype(np.intp), STEPS - 2)
    high = at - low.astype(at.dtype)
    low += gate * STEPS
    below, above = (np.take(last, at, mode="clip") for at in (low, low + 1))
    return np.clip((p + below + high * (above - below)) / 2, 1e-7, 1 - 1e-7)


def learn(vocabulary: DataFrame, table: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """The weights of each gate, and the table that refines the mixed probability.

    Every task learns online over its own training tokens, each occurrence judged without itself in the counts;
    the tasks' weights are then averaged by how many bits they saw, and what their tables counted is added up.
    ``vocabulary`` is ``dealt``, so that every run learns from the same tokens in the same order.
    """
    sc = vocabulary.sparkSession.sparkContext
    shared = sc.broadcast(Said.of(table, own=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        weights, used, curve = np.tile(FIRST, (GATES, 1)), np.zeros(GATES), np.full((GATES, CONTEXTS), 1e-3)
        steps, ones = np.zeros(GATES * STEPS), np.zeros(GATES * STEPS)
        for tokens, by in portions(batches):
            text, by = spell(tokens), np.array(by, dtype=np.float64)
            by = by[text.token]
            for k, bit, slots in text.bits():
                said, gate = known.inputs(k, slots, bit)
                p = squash(mixed(weights, gate, said))
                miss, seen = by * (bit - p), np.bincount(gate, by, GATES)
                bend = by * np.maximum(p * (1 - p), 0.02)
                for c in range(CONTEXTS):
                    curve[:, c] = 0.9 * curve[:, c] + np.bincount(gate, bend * said[c] ** 2, GATES)
                    weights[:, c] += np.clip(rate * np.bincount(gate, miss * said[c], GATES) / curve[:, c], -0.02, 0.02)
                used += seen
                odds = np.clip(np.log(p / (1 - p)), -RANGE, RANGE)
                at = gate * STEPS + np.rint((odds + RANGE) * ((STEPS - 1) / (2 * RANGE))).astype(np.int64)
                steps += np.bincount(at, by, GATES * STEPS)
                ones += np.bincount(at, by * bit, GATES * STEPS)
        parts = (weights * used[:, None], used, steps, ones)
        whole = np.concatenate([x.ravel() for x in parts]).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([whole], pa.binary())], names=["part", "parts"])

    rows = vocabulary.where("trained > 0").select("token", "trained").mapInArrow(run, "part int, parts binary")
    # a row is some 25 kB whatever its task saw; a sum of them is, too
    total = rows.groupBy((F.col("part") / 64).cast("int")).applyInPandas(_sum_parts, "part int, parts binary").collect()
    shared.unpersist()
    flat = sum((np.frombuffer(r["parts"]) for r in sorted(total)), np.zeros(GATES * (CONTEXTS + 1 + 2 * STEPS)))
    weights, used, steps, ones = np.split(flat, np.cumsum([GATES * CONTEXTS, GATES, GATES * STEPS]))
    weights = np.where(used[:, None] > 0, weights.reshape(GATES, CONTEXTS) / np.maximum(used, 1)[:, None], FIRST)
    prior = np.tile(squash(np.linspace(-RANGE, RANGE, STEPS)), GATES)
    return weights, ((ones + 20 * prior) / (steps + 20)).reshape(GATES, STEPS)


def _sum_parts(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("part")
    return rows.head(1).assign(parts=[sum(np.frombuffer(x) for x in rows["parts"]).tobytes()])


def dealt(vocabulary: DataFrame, parts: int) -> DataFrame:
    """``vocabulary`` in ``parts`` partitions by token, each in order of tokens: the same for every run, whatever came first."""
    return vocabulary.repartition(parts, "token").sortWithinPartitions("token")


def score_tokens(vocabulary: DataFrame, table: np.ndarray, weights: np.ndarray, last: np.ndarray) -> DataFrame:
    """token, trained, found and logp: the base-10 logarithm of each token's probability."""
    shared = vocabulary.sparkSession.sparkContext.broadcast((Said.of(table, own=False), weights.astype(np.float32), last.astype(np.float32)))
    least = np.float32(1e-7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, mix, step = shared.value
        for batch in batches:
            at = 0
            for tokens, _ in portions([batch]):
                text = spell(tokens)
                total = np.zeros(len(text.data))
                for k, bit, slots in text.bits():
                    said, gate = known.inputs(k, slots, None)
                    p = refined(np.clip(squash(mixed(mix, gate, said)), least, 1 - least), gate, step)
                    total += np.log(np.abs(p - (1 - bit).astype(np.float32)))
                columns = batch.slice(at, len(tokens)).columns
                at += len(tokens)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.bincount(text.token, total, len(tokens)) / math.log(10))], names=["token", "trained", "found", "logp"])

    scored = staged(vocabulary.select("token", "trained", "found").mapInArrow(run, "token binary, trained long, found long, logp double"))
    shared.unpersist()
    return scored


def _tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LOWER).split()


def count_tokens(docs: DataFrame) -> DataFrame:
    """token, trained, found: occurrences in training texts and in all; ``docs`` has text and held_out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            for tokens, learned in ((trained, 1), (other, 0)):
                found = pa.array(tokens.values(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(tokens.keys(), pa.binary()), found if learned else pa.array([0] * len(tokens), pa.int64()), found], names=["token", "trained", "found"])

        trained, other = Counter(), Counter()
        for batch in batches:
            for text, held in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (other if held else trained).update([*_tokens(text), END])
                if len(trained) + len(other) > 250_000:
                    yield from out()
                    trained, other = Counter(), Counter()
        yield from out()

    rows = docs.select("text", "held_out").mapInArrow(run, "token binary, trained long, found long")
    return rows.groupBy("token").agg(F.sum("trained").alias("trained"), F.sum("found").alias("found"))


def hashed(token: bytes) -> int:
    """The token's 64 bits in ``token_hashes``."""
    return int(_KEYS[6] if token == END else word_hashes(token)[0])


def token_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64 bits for each token of the texts, one text after the other, and how many tokens each text has."""
    hashes, sizes, at = [], [], 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and size < HASHED:
            size += len(texts[upto] or b"") + 1
            upto += 1
        words, counts = many_word_hashes([t or b"" for t in texts[at:upto]])
        hashes.append(np.insert(words, np.cumsum(counts), _KEYS[6]))
        sizes.append(counts + 1)
        at = upto
    return np.concatenate(hashes), np.concatenate(sizes)


class Numbers(dict):
    """Numbers of tokens from 0 on: of those at first, and of what a block adds to them."""

    def __init__(self, first: list[bytes] = ()) -> None:
        super().__init__(zip(first, range(len(first)), strict=True))
        self.first, self.tokens = len(first), list(first)

    def __missing__(self, token: bytes) -> int:
        self[token] = x = len(self)
        self.tokens.append(token)
        return x

    def trim(self) -> None:
        """Forgets what came after the first ones, once it is more than ``FREQUENT``."""
        if len(self) > self.first + FREQUENT:
            kept = self.tokens[: self.first]
            self.clear()
            self.__init__(kept)


@dataclass
class Places:
    """Where the tokens of some texts stand: after which two, and which they are, as keys of 64 bits.

    A key has 40 bits of the two tokens before, 23 of the token, and one that tells held-out texts; further bits of the
    two tokens before choose the group in which keys meet. ``keys`` are distinct, in order of groups.
    """

    starts: np.ndarray
    keys: np.ndarray
    counts: np.ndarray
    group: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes | None], held: list[bool], groups: int) -> Places:
        token, sizes = token_hashes(texts)
        starts = np.cumsum(sizes) - sizes
        one, two = np.full(len(token), _KEYS[0]), np.full(len(token), _KEYS[0])
        one[1:], two[2:] = token[:-1], token[:-2]
        one[starts] = two[starts] = two[starts[sizes > 1] + 1] = _KEYS[0]
        before = one * _KEYS[1] + (two ^ (two >> np.uint64(31))) * _KEYS[2]
        before = (before ^ (before >> np.uint64(29))) * _KEYS[3]
        before ^= before >> np.uint64(32)
        key = before << np.uint64(24) | (token >> np.uint64(41)) << np.uint64(1) | np.repeat(np.array(held, dtype=np.uint64), sizes)
        order = np.argsort(key)
        key = key[order]
        new = np.diff(key, prepend=~key[:1]) != 0
        cuts = np.flatnonzero(new)
        keys, first, counts, at = key[cuts], order[cuts], np.diff(cuts, append=len(key)), np.empty(len(key), dtype=np.int64)
        at[order] = np.cumsum(new) - 1
        group = ((before[first] >> np.uint64(40)) * np.uint64(groups) >> np.uint64(24)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        moved = np.empty_like(order)
        moved[order] = np.arange(len(order))
        return cls(starts, keys[order], counts[order], group[order], moved[at])


def blocks(docs: DataFrame) -> DataFrame:
    """block, ids, held, texts: the rows of ``docs`` put together, a block at ``BLOCK_BYTES`` of text."""
    names = ["block", "ids", "held", "texts"]
    kinds = (pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([x], k) for x, k in zip(rows, kinds, strict=True))], names=names)

        block, rows, size = TaskContext.get().partitionId() << 32, ([], [], []), 0
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                for held, x in zip(rows, row, strict=True):
                    held.append(x)
                size += len(row[2] or b"") + 64
                if size >= BLOCK_BYTES:
                    yield out()
                    block, rows, size = block + 1, ([], [], []), 0
        if size:
            yield out()

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "block long, ids array<long>, held array<boolean>, texts array<binary>")


def judged(keys: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of keys in order, of whole places, that occur ``by`` times, and how often training places got each code."""
    trains = keys & np.uint64(1) == 0
    by = np.where(trains, by, 0).astype(np.int64)

    def numbered(x: np.ndarray) -> np.ndarray:
        new = np.zeros(len(x), dtype=bool)
        np.not_equal(x[1:], x[:-1], out=new[1:])
        return np.cumsum(new, dtype=np.int32)

    pair, place = numbered(keys >> np.uint64(1)), numbered(keys >> np.uint64(24))
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    n, of = np.add.reduceat(by, first), place[first]
    start = np.flatnonzero(np.diff(of, prepend=-1))

    def leading(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most = np.maximum.reduceat(n, start)
        at = np.flatnonzero(n == most[of])
        return at[np.diff(of[at], prepend=-1) != 0], most

    best, n_best = leading(n)
    left = n.copy()
    left[best] = -1
    second, n_second = leading(left)
    total = np.add.reduceat(n, start)
    says, much, rest = best[place], n_best[place], total[place] - trains
    own = trains & (says == pair)
    much = much - own
    other = own & ((n_second[place] > much) | ((n_second[place] == much) & (second[place] < says)))
    says, much = np.where(other, second[place], says), np.where(other, n_second[place], much)
    kind = np.searchsorted(FIRST_SEEN, much, "right") * (len(OTHERS_SEEN) + 1) + np.searchsorted(OTHERS_SEEN, rest - much, "right")
    code = np.where(much > 0, 1 + 2 * kind + (says == pair), 0).astype(np.uint8)
    return code, np.bincount(code, by, CODES).astype(np.int64)


def meet(rows: pa.Table) -> pa.Table:
    """What the training texts say of each key of one group: a code, 0 where they say nothing.

    A training text's place is judged without itself. Of tokens that followed equally often, the one with the smaller
    hash comes first. ``tally`` has how often training places got each code, in the group's first row. Keys are read where
    Arrow has them, and judged some ``JUDGED`` at a time, so that a group takes little more than its keys in order.
    """
    rows = rows.combine_chunks()

    def flat(name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
        _, offsets, data = (c := rows[name].chunk(0)).buffers()
        bounds = np.frombuffer(offsets, dtype=np.int32)[c.offset : c.offset + len(c) + 1]
        return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]].view(kind), np.diff(bounds)

    (keys, sizes), (by, _) = flat("keys", np.uint64), flat("counts", np.uint32)
    order = np.argsort(keys)
    keys, by = keys[order], by[order]
    # where places begin that lie about JUDGED keys apart
    cuts = np.unique(np.searchsorted(keys, keys[::JUDGED] >> np.uint64(24) << np.uint64(24)))
    out, tally = np.empty(len(keys), dtype=np.uint8), np.zeros(CODES, dtype=np.int64)
    for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
        out[order[a:b]], seen = judged(keys[a:b], by[a:b])
        tally += seen
    bounds = np.concatenate([[0], np.cumsum(sizes // 8)]).astype(np.int32)
    codes = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(out)])
    tallies = pa.array([tally.tolist(), *[None] * (len(sizes) - 1)], pa.list_(pa.int64()))
    return pa.Table.from_arrays([rows["block"], rows["part"], codes, tallies], names=["block", "part", "codes", "tally"])


def foretold(texts: DataFrame, groups: int) -> tuple[DataFrame, np.ndarray]:
    """(block, codes): the codes of each block's keys, and the base-10 logarithm of what each code's bit costs.

    Keys are counted in each block before they are sent, so a place that many texts have is one row a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, _, held, text = (c[i].as_py() for c in batch.columns)
                places = Places.of(text, held, groups)
                cuts = np.flatnonzero(np.diff(places.group, prepend=-1))
                runs = list(zip(cuts, [*cuts[1:], len(places.group)], strict=True))
                cut = lambda x, kind: pa.array([x[a:b].astype(kind).tobytes() for a, b in runs], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(runs), pa.int64()), pa.array(places.group[cuts], pa.int64()), cut(places.keys, np.uint64), cut(places.counts, np.uint32)],
                    names=["block", "part", "keys", "counts"],
                )

    sent = texts.mapInArrow(run, "block long, part long, keys binary, counts binary")
    told = staged(sent.repartition(groups, "part").groupBy("part").applyInArrow(meet, "block long, part long, codes binary, tally array<long>"))
    tally = np.zeros(CODES)
    for r in told.where("tally IS NOT NULL").select(F.posexplode("tally").alias("code", "n")).groupBy("code").agg(F.sum("n").alias("n")).collect():
        tally[r["code"]] = r["n"]
    missed, hit = tally[1::2], tally[2::2]
    right = (hit + 0.4) / (hit + missed + 0.8)
    cost = np.zeros(CODES)
    cost[1::2], cost[2::2] = np.log10(1 - right), np.log10(right)
    return told.groupBy("block").agg(F.collect_list(F.struct("part", "codes")).alias("codes")), cost


def frequent(scored: DataFrame) -> DataFrame:
    """The most frequent tokens, at most ``FREQUENT``: all above the least frequency, in steps, that so few reach."""
    level = F.floor(F.log2("found") * 16).cast("int")
    steps = sorted(scored.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"])
    total, least = 0, 1 << 20
    for r in steps:
        total += r["count"]
        if total > FREQUENT:
            break
        least = r["level"]
    return scored.where(level >= least)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 2, folds: int = 7, rate: float = 0.1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte: one row for each row of ``docs``.

    Texts with crc32(id) mod ``folds`` equal to ``fold`` are held out, all others teach. Tokens are words with A-Z
    lower-cased, then one end. base_score is the add-one unigram log10 probability, score that of the mixing model.
    Null and empty texts have the end alone. A null id teaches. Repeated rows count and are scored as often as they
    are there. With no training text, all contexts are unseen and each bit costs one bit. Reruns agree, in any order
    of rows: weights are learned from tokens dealt and sorted by themselves.

    Texts go in blocks. What followed each pair of tokens is counted in tables of keys, which meet in groups of about
    ``MET`` and send each block the codes of its own. Frequent tokens, at most ``FREQUENT``, are scored where the text
    is; rarer ones meet their scores in a join. A token that was foretold is not spelled; that spelling it would have been
    possible, too, is a small waste that makes no score too good.
    """
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == fold, F.lit(False))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held)
    vocabulary = staged(count_tokens(base))
    facts = vocabulary.agg(F.sum("trained").alias("n"), F.count_if(F.col("trained") > 0).alias("v"), F.sum("found").alias("everything")).first()
    n, v = facts["n"] or 0, facts["v"] or 0
    table = count_bits(vocabulary)
    weights, last = learn(dealt(vocabulary, v // LEARNED + 1), table, rate)
    scored = score_tokens(vocabulary, table, weights, last)
    release(vocabulary)
    clear_shuffles(docs.sparkSession)
    known = {bytes(r["token"]): (r["trained"], r["logp"]) for r in frequent(scored).collect()}
    spread = docs.sparkSession.sparkContext.broadcast(known)
    floor = math.log10(n + v + 1)
    whole, groups = staged(blocks(base)), (facts["everything"] or 0) // MET + 1
    codes, cost = foretold(whole, groups)
    clear_shuffles(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(list(spread.value))
        counted, logp = (np.array(x, dtype=np.float64) for x in zip(*spread.value.values(), strict=True)) if spread.value else (np.zeros(0), np.zeros(0))
        # one more place for all other tokens, which add nothing here
        worth = [np.append(x, 0.0) for x in (counted > 0, np.log10(counted + 1) - floor, logp)]
        row = TaskContext.get().partitionId() << 40
        names = ["row", "doc_id", "held_out", "n_tokens", "n_bytes", "n_known", "base_score", "score", "rare"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        for batch in batches:
            for i in range(batch.num_rows):
                ids, held, text, told = (batch.column(c)[i].as_py() for c in ("ids", "held", "texts", "codes"))
                places = Places.of(text, held, groups)
                numbers.trim()
                number = np.fromiter(map(numbers.__getitem__, chain.from_iterable([*_tokens(t), END] for t in text)), np.int64, len(places.at))
                code = np.frombuffer(b"".join(x["codes"] for x in sorted(told, key=lambda x: x["part"])), dtype=np.uint8)[places.at]
                hit = (code > 0) & (code % 2 == 0)
                at = np.minimum(number, numbers.first)
                known, low, high = (x[at] for x in worth)
                known, low, high = (np.add.reduceat(x, places.starts) for x in (known, low, np.where(hit, 0.0, high) + cost[code]))
                others = np.flatnonzero(at == numbers.first)
                where = np.searchsorted(places.starts, others, "right") - 1
                each, of = np.unique(where * len(numbers) + number[others], return_inverse=True)
                times, spelled = np.bincount(of, minlength=len(each)), np.bincount(of, ~hit[others], len(each)).astype(np.int64)
                left = pa.StructArray.from_arrays([pa.array([numbers.tokens[t] for t in (each % len(numbers)).tolist()], pa.binary()), pa.array(times), pa.array(spelled)], names=["token", "times", "spelled"])
                left = pa.ListArray.from_arrays(pa.array(np.searchsorted(each, np.arange(len(ids) + 1) * len(numbers)), pa.int32()), left)
                out = (np.diff(places.starts, append=len(code)), [len(t or b"") for t in text], known.astype(np.int64), low, high)
                columns = [pa.array(x, k) for x, k in zip(out, kinds, strict=True)]
                rows = pa.array(range(row, row + len(ids)), pa.int64())
                row += len(ids)
                yield pa.RecordBatch.from_arrays([rows, pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), *columns, left], names=names)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base_score double, score double, rare array<struct<token:binary,times:long,spelled:long>>"
    texts = staged(whole.join(codes, "block").mapInArrow(run, schema))
    spread.unpersist()
    release(whole)
    rare = texts.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.times", "r.spelled").join(scored, "token")
    rest = rare.groupBy("row").agg(
        F.sum(F.when(F.col("trained") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * (F.log10(F.col("trained") + 1.0) - floor)).alias("more_base"),
        F.sum(F.col("spelled") * F.col("logp")).alias("more_score"),
    )
    rows = texts.drop("rare").join(rest, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    rows = rows.select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "more_known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        plus("base_score", "more_base").alias("base_score"), plus("score", "more_score").alias("score"), "n_bytes",
    )
    bits = -F.col("score") * math.log2(10) / F.greatest(F.col("n_bytes"), F.lit(1))
    return rows.withColumn("bits_per_byte", bits).drop("n_bytes")
