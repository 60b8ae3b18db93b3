"""Substring near-duplicates: compact windows of token min-hashes, interval joins, exact verification.

The tokens are shingles of five words. For one hash function, all passages of a text whose minimum lies at the same
token form a compact window (left, centre, right): any passage that starts between left and centre and ends between
centre and right has that minimum. The windows of all passages of a given length or more are the nodes of the
Cartesian tree over the hashes that span as much; a text of n tokens has about 2n / length of them.

Texts that have a window's token in common are compared with one of them, the centre, and only where such windows lie.
What the centre does not explain of those places is hashed again without the tokens that it has, and so on until no two
places agree: a line that many texts have costs each of them one comparison, not one with every other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import constants, many_shingle_hashes, mix64, release, shingle_hashes, staged, word_hashes

#: Bytes of texts, about, whose windows are made together; a longer text is taken alone, in trees of at most ``SPAN`` tokens
#: with an overlap that no shorter passage is lost in.
TOGETHER, SPAN, OVERLAP = 1 << 20, 1 << 23, 1 << 16
_PLACE = np.uint64((1 << 24) - 1)
#: A window as one number: centre, and how far left and right reach from it. A key's last bits are its hash function.
REACH, HASH_BITS = 16, 4
#: Makes the numbers that are summed over a window's tokens.
SUMMED = constants(1, 22)[0]
#: No token has it: the hash of what is left out.
NEVER = np.uint64((1 << 64) - 1)


def compact_windows(hashed: np.ndarray, begins: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """left, centre and right of each compact window of ``length`` tokens or more, for texts that stand one after the other.

    Only minima of runs of exactly ``length`` tokens can be centres, and their nearest smaller neighbours are such
    minima again, so the trees are built over those alone.
    """
    n = len(hashed)
    if not (sizes >= length).any():
        return (np.empty(0, dtype=np.int64),) * 3
    low = (hashed & ~_PLACE) | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= length:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < length:
        low = np.minimum(low[: n - length + 1], low[length - width :])
    runs = np.maximum(sizes - length + 1, 0)
    low = low[np.repeat(begins, runs) + np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)]
    low = np.unique(low[np.flatnonzero(np.append(True, low[1:] != low[:-1]))])
    low = low[np.argsort(low & _PLACE)]
    places = (low & _PLACE).astype(np.int64)
    owner = np.searchsorted(begins, places, side="right") - 1
    first, last = begins[owner], begins[owner] + sizes[owner] - 1
    before, after = nearest_smaller(low, owner), len(low) - 1 - nearest_smaller(low[::-1], owner[::-1])[::-1]
    left = np.where(before < 0, first, places[before] + 1)
    right = np.where(after >= len(low), last, places[np.minimum(after, len(low) - 1)] - 1)
    return left, places, right


def nearest_smaller(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The place of the last smaller value before each one of the same owner, -1 for none: its ancestor to the left in the tree.

    All between a place and its pointer are larger; where the one pointed to is, too, its own pointer is the next to try.
    """
    n = len(values)
    at = np.arange(-1, n - 1)
    at[np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))] = -1
    with_none, todo = np.append(values, np.uint64(0)), np.arange(n)
    while len(todo := todo[with_none[at[todo]] > values[todo]]):
        at[todo] = at[at[todo]]
    return at


def keyed(hashed: np.ndarray, function: int) -> np.ndarray:
    """Keys of minima, with the number of the hash function in the last bits."""
    return mix64(hashed) >> np.uint64(HASH_BITS) << np.uint64(HASH_BITS) | np.uint64(function)


def windows(docs: DataFrame, length: int, hashes: int, k: int) -> DataFrame:
    """doc_id, digest, n_words, keys, spans: the compact windows of texts, as arrays that run side by side.

    A span says how far a window reaches from its centre, up to ``length`` tokens each way: no further can a passage of
    ``length`` tokens around the centre. Windows of one key that reach as far over the same tokens are one: a text that
    repeats itself has the first. Of equal texts that meet in a task, one is given with windows: they are one class later on.
    """
    by = constants(hashes, 21)

    def of(tokens: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The text of each window, its key and its span."""
        owners, keys, spans = [], [], []
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix64(tokens ^ SUMMED))])
        for j in range(hashes):
            hashed = mix64(tokens ^ by[j])
            left, centre, right = compact_windows(hashed, begins, sizes, length)
            left, right, key = np.maximum(left, centre - length + 1), np.minimum(right, centre + length - 1), keyed(hashed[centre], j)
            owner = np.searchsorted(begins, centre, side="right") - 1
            around = mix64(total[right + 1] - total[left]) ^ mix64(((centre - left) << 32 | (right - centre)).astype(np.uint64))
            once = np.sort(np.unique(mix64(mix64(key) + around) + owner.astype(np.uint64) * SUMMED, return_index=True)[1])
            left, centre, right, owner = left[once], centre[once], right[once], owner[once]
            owners.append(owner)
            keys.append(key[once])
            spans.append((centre - begins[owner]) << 2 * REACH | (centre - left) << REACH | (right - centre))
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return owner[order], np.concatenate(keys)[order].view(np.int64), np.concatenate(spans)[order]

    def made(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """How many windows each text has, its words, and keys and spans of all."""
        tokens, begins, words = many_shingle_hashes(texts, k)
        sizes = np.diff(np.append(begins, len(tokens)))
        if len(tokens) <= SPAN:
            some = np.flatnonzero(sizes)  # a text without tokens begins where the next one does
            owner, keys, spans = of(tokens, begins[some], sizes[some]) if len(some) else (np.empty(0, dtype=np.int64),) * 3
            return np.bincount(some[owner] if len(some) else owner, minlength=len(texts)), words, keys, spans
        parts = [(at, of(part := tokens[at : at + SPAN], np.zeros(1, dtype=np.int64), np.array([len(part)]))) for at in range(0, len(tokens) - OVERLAP, SPAN - OVERLAP)]
        keys = np.concatenate([p[1] for _, p in parts])
        return np.array([len(keys)]), words, keys, np.concatenate([p[2] + (at << 2 * REACH) for at, p in parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            held: list[tuple[int, bytes, bytes]] = []
            size = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                text = text.as_py()
                if held and size + len(text) > TOGETHER:
                    yield out(held, seen)
                    held, size = [], 0
                held.append((doc_id, text, hashlib.blake2b(text, digest_size=16).digest()))
                size += len(text)
            if held:
                yield out(held, seen)

    def out(held: list[tuple[int, bytes, bytes]], seen: set[bytes]) -> pa.RecordBatch:
        fresh = []
        for i, (_, _, mark) in enumerate(held):
            if mark not in seen:
                seen.add(mark)
                fresh.append(i)
        counts, words, keys, spans = made([held[i][1] for i in fresh]) if fresh else (np.empty(0, dtype=np.int64),) * 4
        many, n_words = np.zeros(len(held), dtype=np.int64), np.zeros(len(held), dtype=np.int64)
        many[fresh], n_words[fresh] = counts, words
        offsets = pa.array(np.cumsum([0, *many]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (keys, spans)]
        columns = [pa.array([h[0] for h in held], pa.int64()), pa.array([h[2] for h in held], pa.binary()), pa.array(n_words), *lists]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "n_words", "keys", "spans"])

    return docs.mapInArrow(run, "doc_id long, digest binary, n_words long, keys array<long>, spans array<long>")


#: Places of one text that are cut in one go.
AT_ONCE = 64


def cut(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``pairs`` with the tokens of their places. Texts meet what is wanted of them, so that only places are shuffled on.

    A text that many pairs want is read for ``AT_ONCE`` of them at a time.
    """
    side = lambda name, n: pairs.select(F.col(name).alias("doc_id"), F.struct("x", "y", "more", F.lit(n).alias("side"), F.col(f"{name}s").alias("places")).alias("ask"))
    asks = side("x", 0).unionByName(side("y", 1))
    parts = asks.groupBy("doc_id").agg(F.ceil(F.count("*") / AT_ONCE).alias("parts"))
    asks = asks.join(parts.hint("merge"), "doc_id").groupBy("doc_id", F.pmod(F.xxhash64("ask.x", "ask.y"), "parts").alias("part")).agg(F.collect_list("ask").alias("asks"))
    rows = docs.join(asks.hint("merge"), "doc_id").dropDuplicates(["doc_id", "part"]).select("text", "asks")
    place = pa.list_(pa.struct([("start", pa.int64()), ("tokens", pa.list_(pa.int64())), ("left_out", pa.binary()), ("marks", pa.list_(pa.int64()))]))
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("more", pa.bool_()), ("side", pa.int32()), ("places", place)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tokens = shingle_hashes(word_hashes(batch.column(0)[i].as_py().encode()), k).view(np.int64)
                out = batch.column(1)[i].as_py()
                for ask in out:
                    ask["places"] = [{"start": p["start"], "tokens": tokens[p["start"] : p["stop"]], "left_out": None, "marks": p["marks"]} for p in ask["places"]]
                yield pa.RecordBatch.from_pylist(out, schema)

    places = "array<struct<start:long,tokens:array<long>,left_out:binary,marks:array<long>>>"
    cuts = rows.mapInArrow(run, f"x long, y long, more boolean, side int, places {places}")
    of = lambda n: F.any_value(F.when(F.col("side") == n, F.col("places")), True)
    return cuts.groupBy("x", "y").agg(F.any_value("more").alias("more"), of(0).alias("xs"), of(1).alias("ys")).where("xs IS NOT NULL AND ys IS NOT NULL")


def dense_runs(hit: np.ndarray, length: int, share: float) -> list[tuple[int, int]]:
    """Runs [start, end) that begin and end on a hit, hold a ``share`` of hits and span ``length`` or more.

    The longest run is taken first, then the longest ones before and after it. With hits counted less what the share
    asks for, a run is dense where the sum at its end is not below the sum at its start.
    """
    out, todo = [], [(0, len(hit))]
    while todo:
        low, high = todo.pop()
        if high - low < length:
            continue
        total = np.concatenate([[0.0], np.cumsum(hit[low:high] - share)])
        least, most = np.minimum.accumulate(total), np.maximum.accumulate(total[::-1])[::-1]
        # for each start that is a new minimum, the last end that is not below it
        ends = np.searchsorted(-most, -least + 1e-9, side="right") - 1
        best = int(np.argmax(ends - np.arange(len(total))))
        start, end = best, int(ends[best])
        if end - start < length:
            continue
        inner = np.flatnonzero(hit[low + start : low + end])
        todo += [(low, low + start), (low + end, high)]
        if len(inner) and inner[-1] + 1 - inner[0] >= length:
            out.append((low + start + int(inner[0]), low + start + int(inner[-1]) + 1))
    return out


def shared_passages(xs: list[np.ndarray], y: np.ndarray, length: int, percent: int) -> Iterator[tuple]:
    """(place, x start, x end, y start, y end, similarity): passages of ``y`` that one of the places ``xs`` has, each once."""
    whole = percent / 100
    pool = np.unique(np.concatenate(xs))
    hit = pool[np.minimum(np.searchsorted(pool, y), len(pool) - 1)] == y
    for share in (2 * whole / (1 + whole), whole):  # what both sides hold if they differ alike, or if one is whole
        for a, b in dense_runs(hit, length, share) if np.count_nonzero(hit) >= share * length else ():
            mine = np.unique(y[a:b])
            best = None
            for place, x in enumerate(xs):
                for c, d in dense_runs(mine[np.minimum(np.searchsorted(mine, x), len(mine) - 1)] == x, length, share):
                    theirs = np.unique(x[c:d])
                    both = len(np.intersect1d(mine, theirs, assume_unique=True))
                    union = len(mine) + len(theirs) - both
                    if 100 * both >= percent * union and (best is None or both / union > best[-1]):
                        best = (place, c, d, a, b, both / union)
            if best:
                hit[a:b] = False
                yield best


def unexplained(tokens: np.ndarray, left_out: np.ndarray, length: int, hashes: int) -> np.ndarray:
    """Keys of the minima of all runs of ``length`` tokens, leaving out the tokens of ``left_out``."""
    if len(tokens) < length or left_out.all():
        return np.empty(0, dtype=np.int64)
    low, width = mix64(tokens[None, :] ^ constants(hashes, 21)[:, None]), 1
    low[:, left_out] = NEVER
    while 2 * width <= length:
        low = np.minimum(low[:, :-width], low[:, width:])
        width *= 2
    if width < length:
        low = np.minimum(low[:, : len(tokens) - length + 1], low[:, length - width :])
    return np.unique(np.concatenate([keyed(r[r != NEVER], j) for j, r in enumerate(np.unique(x) for x in low)])).view(np.int64)


#: What a comparison tells: passages, and places that it leaves, each with a number of its own, the text that explains it
#: (its own where no passage covers all of it), its tokens, which of them are explained, and the keys of the others.
PASSAGE = "start long, end long, other_id long, other_start long, other_end long, similarity double"
PLACE = "start long, home long, tokens array<long>, left_out binary, keys array<long>"
TOLD = f"doc_id long, passage struct<{PASSAGE}>, place struct<{PLACE}>"


def compared(pairs: DataFrame, length: int, hashes: int, percent: int, k: int) -> DataFrame:
    """``TOLD`` of every row of ``pairs``: x, y, more, and of each side an array of places (start, tokens), y's with
    ``left_out`` and ``marks``. ``more`` says whether other texts can have what x leaves unexplained of y, and ``marks``
    are the tokens that a passage has to cover for y to count as explained by x.
    """
    numbers = lambda values: values.to_numpy(zero_copy_only=False)
    schema = pa.schema([
        ("doc_id", pa.int64()),
        ("passage", pa.struct([(n, pa.int64()) for n in ("start", "end", "other_id", "other_start", "other_end")] + [("similarity", pa.float64())])),
        ("place", pa.struct([("start", pa.int64()), ("home", pa.int64()), ("tokens", pa.list_(pa.int64())), ("left_out", pa.binary()), ("keys", pa.list_(pa.int64()))])),
    ])

    def told(row: dict) -> Iterator[dict]:
        xs = [numbers(p["tokens"].values).view(np.uint64) for p in row["xs"] if len(p["tokens"])]
        starts = [p["start"].as_py() for p in row["xs"] if len(p["tokens"])]
        if not xs:
            return
        pool = np.unique(np.concatenate(xs))
        for p in row["ys"]:
            y, at = numbers(p["tokens"].values).view(np.uint64), p["start"].as_py()
            if not len(y):
                continue
            covered = np.zeros(len(y), dtype=bool)
            for place, c, d, a, b, similarity in shared_passages(xs, y, length, percent):
                covered[a:b] = True
                values = (at + a, at + b + k - 1, row["x"], starts[place] + c, starts[place] + d + k - 1, similarity)
                names = ("start", "end", "other_id", "other_start", "other_end", "similarity")
                yield {"doc_id": row["y"], "passage": dict(zip(names, values, strict=True)), "place": None}
            if not row["more"]:
                continue
            left_out = pool[np.minimum(np.searchsorted(pool, y), len(pool) - 1)] == y
            if len(before := p["left_out"].as_py() or b""):
                left_out |= np.frombuffer(before, dtype=bool)
            keys = unexplained(y, left_out, length, hashes)
            if len(keys):
                marks = numbers(p["marks"].values) - at
                home = row["x"] if covered[marks[(marks >= 0) & (marks < len(y))]].all() else row["y"]
                yield {"doc_id": row["y"], "passage": None, "place": {"start": at, "home": home, "tokens": y.view(np.int64), "left_out": left_out.tobytes(), "keys": keys}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("x", "y", "more")} | {n: batch.column(n)[i] for n in ("xs", "ys")}
                out += told(row)
                if len(out) >= 500 or (out and len(batch.column("ys")[i]) > 50):
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return pairs.select("x", "y", "more", "xs", "ys").mapInArrow(run, TOLD)


def merged(pairs: DataFrame) -> DataFrame:
    """x, y, more, and for each side the places [start, stop) that its windows make where they overlap; y's with their centres."""
    side = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("marks", pa.list_(pa.int64()))]))

    def places(spans: np.ndarray) -> list[dict]:
        spans = np.unique(spans)
        centre, most = spans >> 2 * REACH, (1 << REACH) - 1
        low, high = centre - (spans >> REACH & most), centre + (spans & most) + 1
        order = np.argsort(low, kind="stable")
        low, high, centre = low[order], np.maximum.accumulate(high[order]), centre[order]
        first = np.flatnonzero(np.append(True, low[1:] > high[:-1]))
        ends = np.append(first[1:], len(low))
        return [{"start": low[a], "stop": high[b - 1], "marks": np.unique(centre[a:b])} for a, b in zip(first, ends, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [pa.array([places(s.values.to_numpy(zero_copy_only=False)) for s in batch.column(c)], side) for c in ("xs", "ys")]
            yield pa.RecordBatch.from_arrays([*batch.select(["x", "y", "more"]).columns, *sides], names=["x", "y", "more", "xs", "ys"])

    of = "array<struct<start:long,stop:long,marks:array<long>>>"
    return pairs.select("x", "y", "more", "xs", "ys").mapInArrow(run, f"x long, y long, more boolean, xs {of}, ys {of}")


def first_pairs(found: DataFrame, same: DataFrame, docs: DataFrame, needed: int, k: int) -> DataFrame:
    """What ``compared`` takes: texts with the centres of their keys, at the places where their windows lie.

    The centre of a key is the smallest id that has it, where ``same`` (doc_id, first) names equal texts by their first. Pairs
    for which fewer than ``needed`` hash functions agree go no further.
    """
    rows = found.select("doc_id", F.explode(F.arrays_zip("keys", "spans")).alias("w")).select(F.col("w.keys").alias("key"), "doc_id", F.col("w.spans").alias("span"))
    keys = found.select("doc_id", F.explode("keys").alias("key")).groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    hits = staged(rows.join(keys.where("low < high").select("key").hint("merge"), "key"))
    release(found)
    named = hits.join(same.hint("merge"), "doc_id", "left").withColumn("doc_id", F.coalesce("first", "doc_id"))
    # a text's windows of one key go on together, so that a line which both texts repeat makes no products
    mine = staged(named.groupBy("key", "doc_id").agg(F.collect_set("span").alias("ys")))
    release(hits)
    centres = mine.groupBy("key").agg(F.min("doc_id").alias("x"), F.min_by("ys", "doc_id").alias("xs"), F.count("*").alias("n"))
    centres = centres.where("n > 1").select("key", "x", "xs", (F.col("n") > 2).alias("more"))
    met = mine.join(centres.hint("merge"), "key").where("doc_id != x")
    made_by = F.count_distinct(F.col("key").bitwiseAND((1 << HASH_BITS) - 1)).alias("made_by")
    pairs = met.groupBy("x", F.col("doc_id").alias("y")).agg(
        F.flatten(F.collect_list("xs")).alias("xs"), F.flatten(F.collect_list("ys")).alias("ys"), F.bool_or("more").alias("more"), made_by
    )
    return cut(staged(merged(pairs.where(F.col("made_by") >= needed))), docs, k)


def next_pairs(places: DataFrame) -> DataFrame | None:
    """What ``compared`` takes next: places of different texts that agree in a key of what is not explained yet.

    Places that one text explains, all of them, are linked by it already. None if there are no pairs.
    """
    places = places.withColumn("place", F.xxhash64("doc_id", "start", "left_out"))
    rows = places.select("place", "doc_id", "home", F.explode("keys").alias("key")).distinct()
    keys = rows.groupBy("key").agg(
        F.min(F.struct("doc_id", "place")).alias("centre"), F.max("doc_id").alias("last"), F.min("home").alias("low"), F.max("home").alias("high"), (F.count("*") > 2).alias("more")
    )
    keys = keys.where("centre.doc_id < last AND low < high").select("key", F.col("centre.doc_id").alias("x"), F.col("centre.place").alias("x_place"), "more")
    met = rows.join(keys.hint("merge"), "key").where("doc_id != x").groupBy("x", F.col("doc_id").alias("y"), "x_place", "place")
    met = met.agg(F.bool_or("more").alias("more"), F.count_distinct("key").alias("n")).groupBy("place")
    met = met.agg(F.max_by(F.struct("x", "y", "x_place", "more"), F.struct("n", -F.col("x"), "x_place")).alias("best"))
    met = staged(met.select("place", "best.*"))
    if met.isEmpty():
        return None
    narrow = places.dropDuplicates(["place"]).select("place", "start", "tokens", "left_out")
    xs = narrow.select(F.col("place").alias("x_place"), F.array(F.struct("start", "tokens")).alias("xs"))
    every = F.sequence(F.col("start"), F.col("start") + F.size("tokens") - 1)
    ys = narrow.select("place", F.array(F.struct("start", "tokens", "left_out", every.alias("marks"))).alias("ys"))
    return met.join(xs.hint("merge"), "x_place").join(ys.hint("merge"), "place").select("x", "y", "more", "xs", "ys")


def copies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, x, n_words: texts that equal the text of a smaller id, the smallest such id, and how long they are; and
    (doc_id, first): the same where an id has one text alone. ``rows`` has doc_id, digest and n_words, once at least for each digest.
    """
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("last"), F.max("n_words").alias("n_words"))
    first = first.where("x < last").drop("last")
    texts = rows.groupBy("doc_id").agg(F.min("digest").alias("digest"), F.max("digest").alias("other")).where("digest = other").select("doc_id", "digest")
    found = staged(rows.select("doc_id", "digest").distinct().join(first.hint("merge"), "digest").where("doc_id != x"))
    single = found.join(texts.hint("merge"), ["doc_id", "digest"], "left_semi").select("doc_id", F.col("x").alias("first"))
    return found.drop("digest"), staged(single)


def repeated_passages(
    docs: DataFrame, words: int = 50, k: int = 5, hashes: int = 6, needed: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, start, end, other_id, other_start, other_end, similarity: passages that a text shares with another.

    Passages are runs of ``words`` words or more, A-Z lower-cased, given by word positions, ends exclusive, whose sets
    of ``k``-word shingles have a Jaccard similarity of ``percent`` or more; they begin and end with a shingle that both have. For each key, the text with the
    smallest id is the centre, and every other text with that key is compared with it: a row names a text and the
    centre that it shares a passage with, so a passage in n texts makes about n - 1 rows and every text with it is
    in one. Of equal texts, the smallest id stands for all: each other one has a row with it over the whole text, and
    goes no further.

    A comparison leaves what the centre does not have of a text's places. These are hashed anew without the tokens that the
    centre has, and the places that agree then are compared, until none do, each time with fewer tokens. So a text that
    has but part of a passage, or a line that many texts have, does not hide it. Places that the same text explains,
    and only those, are linked by it. Two texts that share a minimal passage at a similarity of 0.8 fail to meet where fewer than
    ``needed`` of the ``hashes`` functions agree, with a probability of 0.0016 (binomial); tokens are compared as 64-bit hashes.

    Null, empty and short texts, and rows with a null id, have no passages; rows that share an id count as one text.
    """
    length = words - k + 1
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = staged(windows(base, length, hashes, k))
    copied, same = copies(found.select("doc_id", "digest", "n_words"))
    start, end = F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")
    out = copied.where(F.col("n_words") >= words).select(
        "doc_id", start, end, F.col("x").alias("other_id"), start.alias("other_start"), end.alias("other_end"), F.lit(1.0).alias("similarity")
    )
    pairs = first_pairs(found, same, base, needed, k)
    while pairs is not None:
        told = staged(compared(pairs, length, hashes, percent, k))
        out = out.unionByName(told.where("passage IS NOT NULL").select("doc_id", "passage.*"))
        pairs = next_pairs(told.where("place IS NOT NULL").select("doc_id", "place.*"))
    return out.distinct()
