"""Exact-substring deduplication: bytes covered by a string of WINDOW bytes that also starts earlier are removed.

Equal windows have to meet, so each window goes by its anchor: of the GRAM-byte grams in it the one with the smallest
hash, the first of them if several are. Equal windows have equal anchors at equal places. Successive windows with one
anchor form a run; a run's bytes are hashed as a whole (keyed BLAKE2b of 128 bits, the key drawn for each job, so that n runs
hold a pair of unequal ones with one hash by a chance of n**2 / 2**129 at most, whatever the texts). Runs are dealt out by the anchor's gram. Where a run comes again,
all its windows but those of the first are found repeated. What is left are runs that share a gram but not all
bytes, mostly at the edges of a copied passage: of those the bytes are fetched, dealt out by gram, and their suffixes are
put in order by deep-shallow sorting: a multikey sort, eight bytes at a time, to depth SHALLOW, and a blind trie for each
group that still agrees. Suffixes that end at the same leaf are equal windows. A gram of more than HEAVY undecided windows isn't
dealt out as a whole: its windows go singly, by gram and their own hash, so that only equal ones meet in a task; of windows
that a task finds to be equal byte by byte, only the first is sent.

Of equal runs that a task finds together only the first is sent on. "Earlier" means a smaller id, or the same id and an earlier start. A document equal to one that its task has seen under a smaller id
is wholly repeated and sends no runs, so that many copies don't meet in one task.

Defined results: a null text counts as empty. Documents shorter than a window keep all bytes. Rows that repeat an id and text
are one document and get the same result. Rows that repeat an id with other text are documents of their own; among them, and among
rows without an id, which come after all others, a hash of the text gives the order. A table without rows gives none. Other
columns are not looked at.
"""

from __future__ import annotations

import os
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Bytes of a window, of an anchor's gram, and grams in a window.
WINDOW, GRAM = 100, 24
SPREAD = WINDOW - GRAM + 1
#: Bytes at once, digests of texts that a task remembers, depth of the multikey sort.
CHUNK, REMEMBERED, SHALLOW = 1 << 19, 200_000, 32
#: Undecided windows of a gram that are dealt out together at most.
HEAVY = 1 << 16
_PLACE = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15

_RUNS = "kind byte, gram long, run long, more long, key long, first int, last int"
#: Order of the rows that ``_compare_runs`` takes.
_ORDER = ("kind", "gram", "run", "more", "key", "first")


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0, base**1 ... and the same of the inverse, modulo 2**64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(n, b, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _sums(data: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(base, 1 << 20)
    return np.r_[np.uint64(0), np.cumsum(data * up[: len(data)])], down


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts that stand one after the other, under 2**20 bytes in all: each run's gram, first and last window start."""
    n = len(data) - WINDOW + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none
    wide = data.astype(np.uint64)
    sums, down = _sums(wide, _BASE)
    grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
    keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    short = -len(keys) % SPREAD
    blocks = np.r_[keys, np.full(short, ~np.uint64(0))].reshape(-1, SPREAD)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[:n], ahead[SPREAD - 1 : SPREAD - 1 + n]) & _PLACE).astype(np.int64)
    # a window belongs to the text that it starts in, if it ends there too
    text = np.searchsorted(ends, np.arange(n), side="right")
    whole = np.arange(n) + WINDOW <= ends[text]
    change = np.r_[True, (np.diff(anchor) != 0) | (np.diff(text) != 0)] | ~whole
    begin = np.flatnonzero(change & whole)
    stop = np.r_[np.flatnonzero(change)[1:], n] - 1
    stop = stop[whole[np.flatnonzero(change)]]
    return grams[anchor[begin]].view(np.int64), begin, stop


def run_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, secret: bytes) -> np.ndarray:
    """Two numbers for each run: 128 bits of a keyed hash of its bytes."""
    view = memoryview(data)
    found = [blake2b(view[a:b], digest_size=16, key=secret).digest() for a, b in zip(first.tolist(), (last + WINDOW).tolist(), strict=True)]
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


def _pieces(batch, column: int):
    """Groups of whole texts, or pieces of a long one that share WINDOW - 1 bytes: bytes, ends, rows, offsets in their texts."""
    texts = batch.column(column)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = row + 1
        if offsets[stop] - offsets[row] > CHUNK:
            size = offsets[stop] - offsets[row]
            for at in range(0, size - WINDOW + 1, CHUNK):
                part = data[offsets[row] + at : min(offsets[stop], offsets[row] + at + CHUNK + WINDOW - 1)]
                yield part, np.array([len(part)]), np.array([row]), np.array([at])
        else:
            stop = max(stop, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
            yield data[offsets[row] : offsets[stop]], offsets[row + 1 : stop + 1] - offsets[row], np.arange(row, stop), np.zeros(stop - row, np.int64)
        row = stop


def _record(kind: int, gram, run, more, key, first, last) -> pa.RecordBatch:
    n = len(key)
    arrays = [np.full(n, kind, np.int8), *(x if len(x) else np.zeros(n, np.int64) for x in (gram, run, more)), key, np.asarray(first, np.int32), np.asarray(last, np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=[f.split()[0] for f in _RUNS.split(", ")])


def _find_runs(secret: bytes):
    """kind 0: windows that are known to be repeated; kind 1: runs to compare. ``secret`` is the key of the hashes."""

    def find(batches):
        yield from _runs_of(batches, secret)

    return find


def _runs_of(batches, secret: bytes):
    none, seen = np.zeros(0, np.int64), {}
    for batch in batches:
        keys = batch.column(0).to_numpy()
        texts = batch.column(1)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        view = memoryview(raw) if raw is not None else memoryview(b"")
        copy = np.zeros(len(keys), bool)
        if len(seen) > REMEMBERED:
            seen.clear()
        for k, key in enumerate(keys.tolist()):
            if offsets[k + 1] - offsets[k] >= WINDOW:
                digest = blake2b(view[offsets[k] : offsets[k + 1]], digest_size=16, key=secret).digest()
                if seen.setdefault(digest, key) < key:
                    copy[k] = True
                else:
                    seen[digest] = key
        if copy.any():
            yield _record(0, none, none, none, keys[copy], np.zeros(copy.sum(), np.int64), np.diff(offsets)[copy] - WINDOW)
        for data, ends, rows, shifts in _pieces(batch, 1):
            gram, first, last = runs(data, ends)
            own = np.searchsorted(ends, first, side="right")
            if (keep := ~copy[rows[own]]).any():
                gram, first, last, own = (x[keep] for x in (gram, first, last, own))
                start = np.r_[0, ends][own] - shifts[own]
                run, more = run_hashes(data, first, last, secret).T
                yield from _settle_near([gram, run, more, keys[rows[own]], first - start, last - start])


def _settle_near(found: list[np.ndarray]):
    """Of runs found together, the first of equal ones to compare; the others are repeated, so a run that comes often is sent once."""
    gram, run, more, key, first, last = found
    order = np.lexsort((first, key, more, run, gram))
    same = np.r_[False, np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (gram, run, more)])]
    place = (key[order][1:] == key[order][:-1]) & (first[order][1:] == first[order][:-1])
    again = np.zeros(len(order), bool)
    again[order] = same & ~np.r_[False, place]
    once = np.zeros(len(order), bool)
    once[order] = ~same
    yield _record(1, *[x[once] for x in found])
    if again.any():
        key, first, last = key[again], first[again], last[again]
        new = np.r_[True, (key[1:] != key[:-1]) | (first[1:] != last[:-1] + 1)]
        yield _record(0, *[np.zeros(0, np.int64)] * 3, key[new], first[new], last[np.r_[np.flatnonzero(new)[1:], len(new)] - 1])


def _compare_runs(batches):
    """Rows in ``_ORDER``: runs that come again are kind 0; the first of runs that share a gram are kind 2."""
    none = np.zeros(0, np.int64)
    gram_at, run_at, place, held = None, None, None, None  # of the last row; the gram's first run as long as it has no other

    def undecided(rows):
        return _record(2, *rows)

    for batch in batches:
        kinds = batch.column(0).to_numpy()
        if (kinds == 0).any():
            yield batch.filter(pa.array(kinds == 0))
            batch = batch.filter(pa.array(kinds != 0))
        if not batch.num_rows:
            continue
        gram, run, more, key, first, last = (c.to_numpy() for c in batch.columns[1:])
        before = [np.r_[np.int64(0), x[:-1]] for x in (gram, run, more, key, first)]
        same_gram, same_run = before[0] == gram, (before[1] == run) & (before[2] == more)
        same_place = (before[3] == key) & (before[4] == first)
        same_gram[0] = gram[0] == gram_at
        same_run[0] = (run[0], more[0]) == run_at
        same_place[0] = (key[0], first[0]) == place
        again = same_gram & same_run
        if (hit := again & ~same_place).any():  # a repeated row is the same place, not a copy
            yield _record(0, none, none, none, key[hit], first[hit], last[hit])
        new = np.flatnonzero(~again)
        if len(new):
            starts = np.flatnonzero(~same_gram[new])
            # runs of the gram that the batch before ended with
            carried = new[: starts[0]] if len(starts) else new
            if len(carried):
                if held is not None:
                    yield undecided(held)
                    held = None
                yield undecided([x[carried] for x in (gram, run, more, key, first, last)])
            if len(starts):
                sizes = np.diff(np.r_[starts, len(new)])
                many = np.repeat(sizes > 1, sizes)
                rest = new[starts[0] :]
                if many.any():
                    yield undecided([x[rest[many]] for x in (gram, run, more, key, first, last)])
                held = [x[rest[-1:]] for x in (gram, run, more, key, first, last)] if sizes[-1] == 1 else None
        gram_at, run_at, place = gram[-1], (run[-1], more[-1]), (key[-1], first[-1])


def _fetch(batches):
    """The bytes of undecided runs: (gram, part, key, first, bytes). Those of heavy grams come by window, with the window's hash as part; null bytes: first to part are repeated."""
    import xxhash

    seen: dict[bytes, tuple[int, int]] = {}  # windows of heavy grams, with the earliest place
    for batch in batches:
        for key, text, own in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "runs")), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            out = []
            for x in own:
                first, last = x["first"], x["last"]
                if last + WINDOW > len(raw):
                    continue
                if not x["heavy"]:
                    out.append((x["gram"], 0, first, raw[first : last + WINDOW]))
                    continue
                if len(seen) > REMEMBERED:
                    seen.clear()
                again = []
                for p in range(first, last + 1):
                    w = raw[p : p + WINDOW]
                    old = seen.setdefault(w, (key, p))
                    if old < (key, p):
                        if again and again[-1][1] == p - 1:
                            again[-1][1] = p
                        else:
                            again.append([p, p])
                    else:
                        seen[w] = (key, p)
                        out.append((x["gram"], xxhash.xxh64_intdigest(w) - (1 << 63), p, w))
                out += [(x["gram"], b, a, None) for a, b in again]
            if out:
                gram, part, at, found = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(part, pa.int64()), pa.array([key] * len(out), pa.int64()), pa.array(at, pa.int32()), pa.array(found, pa.binary())], names=["gram", "part", "key", "first", "bytes"])


def _shared(x: bytes, y: bytes) -> int:
    """Length of the common prefix of two equally long strings."""
    return len(x) - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def blind_trie(strings: list[bytes], depth: int) -> list[list[int]]:
    """The strings' numbers in sorted order, equal ones together. All agree in the first ``depth`` bytes and have one length.

    A node is a list of the place where its strings first differ and its children by their byte there; a leaf is a list of numbers.
    """
    root, leaf_of = None, {}
    for k, x in enumerate(strings):
        if (there := leaf_of.get(x)) is not None:
            there.append(k)
            continue
        leaf_of[x] = leaf = [k]
        if root is None:
            root = (len(x), leaf)
            continue
        node = root  # blind descent: only the bytes at the nodes are looked at
        while node[0] < len(x):
            node = node[1].get(x[node[0]]) or next(iter(node[1].values()))
        y = strings[node[1][0]]
        at = _shared(x, y)
        above, node = None, root  # now the node at which x leaves
        while node[0] < at:
            above, node = node, node[1][x[node[0]]]
        if node[0] == at:
            node[1][x[at]] = (len(x), leaf)
        else:
            new = (at, {y[at]: node, x[at]: (len(x), leaf)})
            if above is None:
                root = new
            else:
                above[1][x[above[0]]] = new
    out, todo = [], [root] if root else []
    while todo:
        node = todo.pop()
        if node[0] == len(strings[0]):
            out.append(node[1])
        else:
            todo += [node[1][b] for b in sorted(node[1], reverse=True)]
    return out


def equal_windows(groups: np.ndarray, parts: list[bytes]) -> list[np.ndarray]:
    """Classes of equal windows within the parts of one group, as numbers of windows in the order of the parts.

    Deep-shallow sorting: a multikey sort to SHALLOW bytes over all suffixes at once, then a blind trie for each group left.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts) + b"\0" * 8, np.uint8)
    counts = sizes - WINDOW + 1
    base = np.cumsum(sizes) - sizes
    start = np.repeat(base - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    group = np.repeat(groups, counts)
    order = np.arange(len(start))
    for depth in range(0, SHALLOW, 8):
        at = start[order] + depth
        letters = np.zeros(len(at), np.uint64)
        for k in range(8):
            letters = (letters << np.uint64(8)) | data[at + k]
        sort = np.lexsort((letters, group))
        order, group, letters = order[sort], group[sort], letters[sort]
        new = np.r_[True, (np.diff(group) != 0) | (letters[1:] != letters[:-1])]
        group = np.cumsum(new)
        size = np.bincount(group)
        stay = size[group] > 1
        order, group = order[stay], group[stay]
        if not len(order):
            return []
    raw = data.tobytes()
    cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(group)]
    out = []
    for i, j in zip(cuts, cuts[1:], strict=False):
        own = order[i:j]
        for leaf in blind_trie([raw[s : s + WINDOW] for s in start[own].tolist()], SHALLOW):
            if len(leaf) > 1:
                out.append(own[leaf])
    return out


def _sort_suffixes(batches):
    """Rows sorted by gram and part, keys in order: the windows that an earlier one equals, as (key, first, last)."""
    held: list[tuple] = []

    def settle(rows):
        groups = np.unique(np.array([r[:2] for r in rows], np.int64), axis=0, return_inverse=True)[1].ravel()
        sizes = np.array([len(r[4]) - WINDOW + 1 for r in rows], np.int64)
        keys = np.repeat(np.array([r[2] for r in rows], np.int64), sizes)
        place = np.repeat(np.array([r[3] for r in rows], np.int64) - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        late = np.zeros(len(keys), bool)
        for own in equal_windows(groups, [r[4] for r in rows]):
            least = np.lexsort((place[own], keys[own]))[0]
            late[own] = (keys[own] != keys[own[least]]) | (place[own] != place[own[least]])
        found = np.flatnonzero(late)
        if len(found):
            k, p = keys[found], place[found]
            new = np.r_[True, (np.diff(found) != 1) | (np.diff(k) != 0) | (np.diff(p) != 1)]
            yield pa.RecordBatch.from_arrays([pa.array(k[new]), pa.array(p[new].astype(np.int32)), pa.array(p[np.r_[np.flatnonzero(new)[1:], len(p)] - 1].astype(np.int32))], names=["key", "first", "last"])

    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        if known := [r for r in rows if r[4] is None]:
            yield pa.RecordBatch.from_arrays([pa.array([r[2] for r in known], pa.int64()), pa.array([r[3] for r in known], pa.int32()), pa.array([r[1] for r in known], pa.int32())], names=["key", "first", "last"])
        held += [r for r in rows if r[4] is not None]
        if held and held[0][:2] != held[-1][:2] and len(held) >= 2000:
            cut = next(k for k in range(len(held) - 1, -1, -1) if held[k][:2] != held[-1][:2]) + 1
            yield from settle(held[:cut])
            held = held[cut:]
    if held:
        yield from settle(held)


def _remove(batches):
    for batch in batches:
        out, spans, sizes = [], [], []
        for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            sizes.append(len(raw))
            gone: list[list[int]] = []
            for first, last in sorted((x["first"], x["last"]) for x in own or ()):
                end = min(len(raw), last + WINDOW)
                if gone and first <= gone[-1][1]:
                    gone[-1][1] = max(gone[-1][1], end)
                elif first < end:
                    gone.append([first, end])
            spans.append([{"start": a, "end": b} for a, b in gone])
            edges = [0, *(x for pair in gone for x in pair), len(raw)]
            out.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(out, pa.binary())], names=["id", "n_bytes", "spans", "kept"])


def undecided_runs(rows: DataFrame, compared: DataFrame) -> DataFrame:
    """What ``_fetch`` gives for the runs of kind 2, dealt out by gram and part and sorted. Heavy grams, one in HEAVY windows at most, are joined as Spark sees fit by their size."""
    runs = compared.where("kind = 2").select("gram", "key", "first", "last")
    heavy = runs.groupBy("gram").agg(F.sum(F.col("last").cast("long") - F.col("first") + 1).alias("n")).where(F.col("n") > HEAVY).select("gram", F.lit(True).alias("heavy"))
    marked = runs.join(heavy, "gram", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    lists = marked.groupBy("key").agg(F.collect_list(F.struct("gram", "first", "last", "heavy")).alias("runs"))
    # the same columns of the texts as in the last join, so that one exchange of them serves both
    fetched = rows.join(lists, "key").mapInArrow(_fetch, "gram long, part long, key long, first int, bytes binary")
    known = F.col("bytes").isNull()
    return fetched.repartition(F.when(known, F.col("key")).otherwise(F.col("gram")), F.when(known, F.lit(0).cast("long")).otherwise(F.col("part"))).sortWithinPartitions("gram", "part", "key", "first")


def with_keys(rows: DataFrame) -> DataFrame:
    """(id, text) with ``key``, by which documents are told apart and put in order: the id itself where ids tell texts apart."""
    hashed = rows.select("id", F.xxhash64("text").alias("hash"))
    per_id = hashed.groupBy("id").agg(F.min("hash").alias("low"), F.max("hash").alias("high"))
    if per_id.where("id is null or low <> high").isEmpty():
        return rows.select("id", F.coalesce("id", F.lit(0)).alias("key"), "text")
    places = hashed.distinct().repartitionByRange(F.col("id").asc_nulls_last(), "hash").sortWithinPartitions(F.col("id").asc_nulls_last(), "hash")
    places = stored(places.select(F.col("id").alias("__id"), F.col("hash").alias("__hash"), F.monotonically_increasing_id().alias("key")), "places")
    return rows.join(places, (F.xxhash64("text") == F.col("__hash")) & F.col("id").eqNullSafe(F.col("__id"))).select("id", F.coalesce("key", F.lit(0)).alias("key"), "text")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id_col, n_bytes, spans (removed byte ranges, ends exclusive), kept (the bytes left)."""
    rows = with_keys(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    found = rows.select("key", "text").mapInArrow(_find_runs(os.urandom(32)), _RUNS)
    dealt = found.repartition(F.when(F.col("kind") == 1, F.col("gram")).otherwise(F.col("key"))).sortWithinPartitions(*_ORDER)
    compared = stored(dealt.mapInArrow(_compare_runs, _RUNS), "runs")
    sorted_ = undecided_runs(rows, compared).mapInArrow(_sort_suffixes, "key long, first int, last int")
    gone = compared.where("kind = 0").select("key", "first", "last").unionByName(sorted_)
    ranges = gone.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    joined = rows.join(ranges, "key", "left").select("id", "text", "ranges")
    return joined.mapInArrow(_remove, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary").withColumnRenamed("id", id_col)
