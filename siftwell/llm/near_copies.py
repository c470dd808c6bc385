"""Operator 10: n-gram Jaccard join by vertical partitioning.

A text's grams are its distinct runs of N words, lower case, cut at white space. The global gram order (their hashes) is cut
into fragments of equal range; each fragment counts its part of every overlap alone, and the parts are summed:

1. A task packs the grams of its texts by fragment: six bytes a gram and one for the step to the next text, so a document
   takes as many bytes in a large input as in a small one. A fragment finds which of its grams other texts have too and in
   how many. These partial counts are summed per text: one that shares fewer than T of its grams with any other text can't
   have a partner and is dropped, exactly.
2. Texts of equal gram sets are one class from here on. Classes are linked where they share a gram of their prefix (rarest
   first, the fewest that no partner can miss) after which both hold grams enough for the overlap that their sizes ask for.
   Every pair of the result lies inside one connected part.
3. Inside a connected part every pair of classes is counted. A part beyond BLOCK classes or PIECE grams is dealt out by blocks
   of like size, so no case is left out and no task holds a whole part. What is sent on is a sum for each class, not the
   pairs, whose number grows as the square of a group. Where a text alone is beyond a piece, pieces of the gram order count
   separately, and the sums per pair decide.

The result has one row a document, so copies aren't expanded into pairs; no link between different texts is lost.

Defined cases: a text of 1 to N - 1 words has itself as its only gram; null and empty texts have no grams and no partners; a
null doc_id has no partners and its row is kept; rows with the same doc_id and text are one document, of which the filter
keeps one row; rows with the same doc_id and other texts are documents of their own; other columns stay as they are, whatever
their names; an empty table gives empty results. Grams are compared by 52 or more bits of a hash: 48, and as many as number
the fragments, 4 at least."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import components
from .spark_io import BROADCAST_ROWS, cut, join_small, release, ship, slices, unwrapped, wrapped
from .textvec import SPACE, classes, code_points, mix, ragged, span_hashes, words

#: Production parameters: words in a gram and the least Jaccard similarity of a pair.
N, T = 3, 0.5
#: Physical sizes, without influence on results: input bytes for each fragment, grams held by a task before it sends them, classes in a block, grams in a block or piece, chars worked on at once,
#: classes compared at once, texts up to which a gram's pairs are counted one by one, bytes of grams that are dealt at once, rows whose texts are held as strings.
FRAGMENT_BYTES, HELD_GRAMS, BLOCK, PIECE, SLICE, TILE, FEW, SENT, ROWS = 16 << 20, 2_000_000, 4096, 1_000_000, 600_000, 1024, 32, 8 << 20, 500
_EPS = 1e-9


def fragments_for(df: DataFrame) -> int:
    """A power of two that grows with the input."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 50:  # rows that don't come from files: Spark doesn't know their size
        size = df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return 1 << max(4, min(18, (size // FRAGMENT_BYTES).bit_length()))


def gram_sets(texts: list[str | None], n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct gram hashes end to end and in order, their number in each row)."""
    low = [(t or "").lower() for t in texts]
    lengths = list(map(len, low))
    for a, b in slices(lengths, SLICE):
        size = np.array(lengths[a:b], np.int64)
        begins = np.cumsum(size) - size
        cp = code_points("".join(low[a:b]))
        starts, ends = words(cp, begins[size > 0], classes()[cp] != SPACE)
        row = np.searchsorted(begins[size > 0], starts, "right") - 1
        row = np.flatnonzero(size > 0)[row] if len(row) else row
        h = span_hashes(cp, starts, ends)
        count = np.bincount(row, minlength=b - a) if len(row) else np.zeros(b - a, np.int64)
        gram = h.copy()
        for k in range(1, n):  # a word that isn't there, as the text ends before, adds nothing
            gram = mix(gram)
            gram[: len(h) - k] += np.where(row[k:] == row[:-k], h[k:], np.uint64(0)) if len(h) > k else 0
        place = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
        whole = (place + n <= np.repeat(count, count)) | ((place == 0) & (np.repeat(count, count) < n))
        gram, row = mix(gram[whole]), row[whole]
        order = np.lexsort((gram, row))
        gram, row = gram[order], row[order]
        first = np.ones(len(gram), bool)
        first[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
        yield a, b, gram[first], np.bincount(row[first], minlength=b - a) if len(row) else np.zeros(b - a, np.int64)


def stepped(rows: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending rows of runs that start at begins as steps of a byte each, 255 going on; and where each run's bytes start."""
    step = np.diff(rows, prepend=0)
    step[begins] = rows[begins]
    more = step // 255
    at = np.cumsum(more) + np.arange(len(rows))
    out = np.full(len(rows) + int(more.sum()), 255, np.uint8)
    out[at] = step % 255
    return out, at[begins] - more[begins]


def unstepped(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


SEGMENTS = "frag int, pack long, steps binary, gram binary, uids binary, sizes binary"


def segments(docs: DataFrame, fragments: int, n: int) -> DataFrame:
    """The grams of packs of texts by fragment. One segment of each pack has its list of texts (doc_id, text hash) and their sizes.

    A pack is named by what it holds, in order; so that a task that runs again makes the same packs, rows that don't come
    straight from files are sorted first."""
    ship(docs.sparkSession)
    bits = fragments.bit_length() - 1
    texts = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("n_key"), "text")
    if "Exchange" in texts._jdf.queryExecution().executedPlan().toString():
        texts = texts.sortWithinPartitions("doc_id", "n_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            uid, size, gram = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            frag = (gram >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int32)
            order = np.argsort(frag, kind="stable")
            frag, row, gram = frag[order], np.repeat(np.arange(len(uid), dtype=np.int32), size)[order], gram[order]
            del order
            # six bytes of each gram go along, the fragment stands for the first bits
            low = (gram << np.uint64(bits)).byteswap().view(np.uint8).reshape(-1, 8)[:, :6]
            del gram
            begins = np.flatnonzero(np.append(True, frag[1:] != frag[:-1]))
            steps, at = stepped(row, begins)
            pack = int(mix(uid.astype(np.uint64).reshape(-1) + mix(np.arange(2 * len(uid)).astype(np.uint64))).sum().view(np.int64))
            k, ends, to = len(begins), np.append(begins[1:], len(row)), np.append(at[1:], len(steps))
            columns = [
                pa.array(frag[begins].astype(np.int32)), pa.array(np.full(k, pack)), pa.array([steps[a:b].tobytes() for a, b in zip(at, to, strict=True)], pa.binary()),
                pa.array([low[a:b].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary()), *(pa.array([x.tobytes(), *[None] * (k - 1)], pa.binary()) for x in (uid, size.astype(np.int32))),
            ]
            return pa.RecordBatch.from_arrays(columns, ["frag", "pack", "steps", "gram", "uids", "sizes"])

        for batch in batches:
            ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            uids = np.stack([ids.astype(np.int64), keys.astype(np.int64)], 1)
            for at in range(0, len(ids), ROWS):  # Python strings of a whole batch would take many times a slice's memory
                for a, b, gram, size in gram_sets(batch.column(2).slice(at, ROWS).to_pylist(), n):
                    held.append((uids[at + a : at + b][size > 0], size[size > 0], gram))
                    total += len(gram)
                    if total > HELD_GRAMS:
                        yield flush()
                        total = 0
        if total:
            yield flush()
        release()

    return texts.mapInArrow(run, SEGMENTS)


def released(one: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The function of a group; what it freed is given back after each."""

    def run(t: pa.Table) -> pa.Table:
        out = one(t)
        release()
        return out

    return run


def _often(count: np.ndarray) -> np.ndarray:
    """A byte that ascends with the number of texts."""
    return np.minimum(np.rint(8 * np.log2(count)), 255).astype(np.uint8)


def shared_grams(segs: DataFrame) -> DataFrame:
    """Per fragment: number the grams that two texts or more have, and send each pack's back."""

    def one(t: pa.Table) -> pa.Table:
        frag = t.column("frag")[0].as_py()
        packs = t.column("gram").to_pylist()
        length = np.array([len(x) // 6 for x in packs], np.int64)
        low = np.frombuffer(b"".join(packs), np.uint8).reshape(-1, 6)
        del packs
        gram = np.zeros((len(low), 8), np.uint8)
        gram[:, :6] = low
        gram = gram.view(np.uint64).reshape(-1).byteswap()
        of, often, top, part, seen = np.zeros(len(gram), np.uint32), np.zeros(len(gram), np.uint8), low[:, 0] >> 4, 16, 0
        for p in range(part):  # parts of the fragment's range in turn, for the sake of memory
            mine = np.flatnonzero(top == p)
            order = np.argsort(gram[mine])
            mine = mine[order]
            value = gram[mine]
            group = np.cumsum(np.append(True, value[1:] != value[:-1])) - 1 if len(value) else np.zeros(0, np.int64)
            count = np.bincount(group)
            more = count > 1
            keep = more[group]
            of[mine[keep]] = seen + (np.cumsum(more) - 1)[group[keep]]
            often[mine[keep]] = _often(count[group[keep]])
            seen += int(more.sum())
        del gram
        wide = 1 if seen <= 1 << 8 else 2 if seen <= 1 << 16 else 3 if seen <= 1 << 24 else 4
        of = of.view(np.uint8).reshape(-1, 4)
        out: list[list] = [[], [], [], [], []]
        for at, n, steps in zip(np.cumsum(length) - length, length, t.column("steps").to_pylist(), strict=True):
            keep = often[at : at + n] > 0
            rows = unstepped(np.frombuffer(steps, np.uint8))[keep]
            for column, x in zip(out, (stepped(rows, np.zeros(1, np.int64))[0] if len(rows) else rows, of[at : at + n][keep, :wide], often[at : at + n][keep]), strict=False):
                column.append(x.tobytes())
        columns = [pa.array(x, pa.binary()) for x in out[:3]]
        return pa.table([pa.array(np.full(len(length), frag, np.int32)), t.column("pack"), *columns, t.column("uids"), t.column("sizes")], ["frag", "pack", "steps", "gram", "often", "uids", "sizes"])

    return segs.groupBy("frag").applyInArrow(released(one), "frag int, pack long, steps binary, gram binary, often binary, uids binary, sizes binary")


SURVIVORS = "doc_id long, key long, size int, held int, prefix int, node long, grams binary"


def survivors(shared: DataFrame, t: float) -> DataFrame:
    """Per text that shares enough for a partner: the grams it shares, rarest first, how many of them are its prefix, and its class.

    Texts that share all grams and have the same set are one class; any other is its own."""

    def one(x: pa.Table) -> pa.Table:
        uid, size, rows, grams, often = None, None, [], [], []
        for frag, steps, gram, n, uids, sizes in zip(*(x.column(c).to_pylist() for c in ("frag", "steps", "gram", "often", "uids", "sizes")), strict=True):
            if uids is not None:
                uid, size = np.frombuffer(uids, np.int64).reshape(-1, 2), np.frombuffer(sizes, np.int32).astype(np.int64)
            if n:
                four = np.zeros((len(n), 4), np.uint8)
                four[:, : len(gram) // len(n)] = np.frombuffer(gram, np.uint8).reshape(len(n), -1)
                rows.append(unstepped(np.frombuffer(steps, np.uint8)))
                grams.append(four.view(np.uint32).reshape(-1).astype(np.int64) | frag << 32)
                often.append(np.frombuffer(n, np.uint8))
        if uid is None:
            raise RuntimeError("a pack's list of texts is missing: its task gave other rows when it ran again")
        row, gram, n = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (rows, grams, often))
        order = np.lexsort((gram, n, row))
        row, gram = row[order], gram[order]
        if len(row):  # the same pack twice, as of a table that was appended to itself
            new = np.append(True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1]))
            row, gram = row[new], gram[new]
        held = np.bincount(row, minlength=len(uid))
        need = np.maximum(np.ceil(t * size - _EPS), 1).astype(np.int64)
        alive = held >= need
        first = (np.cumsum(held) - held)[alive]
        gram = gram[alive[row]]
        uid, size, held, need = uid[alive], size[alive], held[alive], need[alive]
        ends = np.cumsum(held)
        if len(held):
            total = np.add.reduceat(mix(gram.astype(np.uint64)), ends - held)
        else:
            total = np.zeros(0, np.uint64)
        own = mix(mix(uid[:, 0].astype(np.uint64)) + uid[:, 1].astype(np.uint64))
        node = np.where(held == size, mix(total + mix(size.astype(np.uint64))), own).view(np.int64)
        blobs = pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer((np.append(0, ends) * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(gram))])
        # grams that no other text has come first in the order, so the shared part of the prefix is as much shorter
        columns = [uid[:, 0], uid[:, 1], size.astype(np.int32), held.astype(np.int32), (held - need + 1).astype(np.int32), node]
        return pa.table([*map(pa.array, map(np.ascontiguousarray, columns)), blobs], ["doc_id", "key", "size", "held", "prefix", "node", "grams"])

    return shared.groupBy("pack").applyInArrow(released(one), SURVIVORS)


def _prefix_links(leads: DataFrame, t: float) -> DataFrame:
    """(a, b): links that connect all classes whose grams let them be partners.

    At the first gram that two classes share, in the common order, either still holds the whole overlap: it is at most the
    grams that are left to each. So a class of that size with so many grams left has a reach, the largest partner that it
    can have there, and two classes may be partners where neither's size is beyond the other's reach. Classes that reach
    their own size are intervals from size to reach, connected where these overlap; any other may only be the larger one of
    a pair, with an interval that begins within its reach and ends at its size or later. One sweep by gram that links each
    class to the interval that reaches furthest connects just these, with one link a class and gram, however many have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0

        def flush() -> pa.RecordBatch:
            """The sweep within the task; only what isn't covered by an interval that is sent goes on to the one over all tasks."""
            node, size, gram, reach = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((node, -reach, reach < size, np.minimum(size, reach), gram))
            node, size, gram, reach = (x[order] for x in (node, size, gram, reach))
            new = np.append(True, gram[1:] != gram[:-1])
            key = np.cumsum(new) << 32 | np.where(reach >= size, reach, 0)
            most = np.maximum.accumulate(key)
            lead = np.maximum.accumulate(np.where((key & 0xFFFFFFFF > 0) & np.append(True, key[1:] > most[:-1]), np.arange(len(key)), 0))
            before, best = np.append(0, lead[:-1]), np.where(new, 0, np.append(0, most[:-1]) & 0xFFFFFFFF)
            linked = best >= size
            links = np.unique(np.stack([node[before[linked]], node[linked]], 1), axis=0)
            none = pa.nulls(len(links), pa.int64())
            first = [pa.array(np.ascontiguousarray(links[:, 0])), pa.array(np.ascontiguousarray(links[:, 1])), none, *[pa.nulls(len(links), pa.int32())] * 2]
            on = np.where(reach < size, ~linked, best < reach)
            rest = [pa.array(node[on]), pa.nulls(int(on.sum()), pa.int64()), pa.array(gram[on]), pa.array(size[on].astype(np.int32)), pa.array(reach[on].astype(np.int32))]
            return pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(first, rest, strict=True)], ["a", "b", "gram", "size", "reach"])

        for batch in batches:
            nodes, sizes, left, prefix = (batch.column(i).to_numpy().astype(np.int64) for i in range(4))
            if not len(nodes):
                continue
            left = np.repeat(left, prefix) - ragged(np.zeros(len(prefix), np.int64), prefix)
            sizes = np.repeat(sizes, prefix)
            reach = np.minimum(np.floor(left * (1 + t) / t + 1e-6).astype(np.int64) - sizes, (1 << 31) - 1)
            held.append((np.repeat(nodes, prefix), sizes, np.concatenate([np.frombuffer(g.as_buffer(), np.int64)[:k] for g, k in zip(batch.column(4), prefix, strict=True)]), reach))
            total += int(prefix.sum())
            if total > HELD_GRAMS:
                yield flush()
                held, total = [], 0
        if held:
            yield flush()
            held.clear()
        release()

    got = leads.select("node", "size", "held", "prefix", "grams").mapInArrow(run, "a long, b long, gram long, size int, reach int")
    w = Window.partitionBy("gram").orderBy(F.least("size", "reach"), F.col("reach") < F.col("size"), F.desc("reach"), "a").rowsBetween(Window.unboundedPreceding, -1)
    # a row without a gram is a link already; it is dealt by its own ends
    key = F.coalesce("gram", F.xxhash64("a", "b"))
    furthest = F.max(F.when(F.col("b").isNull() & (F.col("reach") >= F.col("size")), F.struct("reach", "a"))).over(w)
    swept = got.withColumn("gram", key).withColumn("furthest", furthest)
    return swept.select("a", F.coalesce("b", F.when(F.col("furthest.reach") >= F.col("size"), F.col("furthest.a"))).alias("b")).filter("b is not null").distinct()


def counts(rows: list[np.ndarray], lower: int = 0) -> np.ndarray:
    """How many grams each two of the arrays share; lower: only each of the first so many with each other one.

    Of a gram that few have, the pairs are counted one by one; the others are columns, products of slices of them are added."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    gram = np.concatenate(rows)
    order = np.argsort(gram, kind="stable")
    gram, row = gram[order], row[order]
    column = np.cumsum(np.append(True, gram[1:] != gram[:-1])) - 1 if len(gram) else np.zeros(0, np.int64)
    often = np.bincount(column)
    m, down, across = len(rows), lower or len(rows), len(rows) - lower
    total = np.zeros(down * across, np.float32)
    keep = (often[column] > 1) & (often[column] <= FEW)
    few, group = row[keep], column[keep]
    ends = np.searchsorted(group, group, "right")
    later = ends - np.arange(len(few)) - 1
    so_far, at = np.cumsum(later), 0
    while at < len(few):
        to = max(at + 1, int(np.searchsorted(so_far, (so_far[at - 1] if at else 0) + 1_000_000, "right")))
        i, j = np.repeat(few[at:to], later[at:to]), few[ragged(np.arange(at, to) + 1, later[at:to])]
        if lower:
            mixed = (i < lower) & (j >= lower)
            i, j = i[mixed], j[mixed]
        if len(i):
            total += np.bincount(i * across + j - lower, minlength=len(total))
        at = to
    total = total.reshape(down, across)
    if not lower:
        total += total.T
    keep = often[column] > FEW
    row, column = row[keep], (np.cumsum(often > FEW) - 1)[column[keep]]
    n = int(column[-1]) + 1 if len(column) else 0
    width = max(1, min(4_000_000 // m, 1 << 16))
    for at in range(0, n, width):
        a, b = np.searchsorted(column, (at, at + width))
        x = np.zeros((m, min(width, n - at)), np.float32)
        x[row[a:b], column[a:b] - at] = 1
        total += x[:lower] @ x[lower:].T if lower else x @ x.T
    return total


def least_linked(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of m, the least that it is connected to by the pairs (i, j)."""
    least = np.arange(m)
    while True:
        now = least.copy()
        both = np.minimum(least[i], least[j])
        for end in (i, j, least[i], least[j]):
            np.minimum.at(now, end, both)
        now = now[now]
        if (now == least).all():
            return least
        least = now


def class_links(docs: DataFrame, n: int, t: float) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (doc_id, key, node) has each text that may have a partner and its class; links (node, lead,
    links, best) has parts of what a class's pairs of Jaccard t or more come to: how many they are, the highest similarity,
    and a class that it is connected to by them. Every pair of classes is counted once at either end, and none is sent."""
    fragments = fragments_for(docs)
    alive = cut(survivors(shared_grams(segments(docs, fragments, n)), t))
    members = cut(alive.select("doc_id", "key", "node").distinct())
    # one of each class goes on; copies are merged before the shuffle
    leads = cut(alive.groupBy("node").agg(F.min_by(F.struct("size", "held", "prefix", "grams"), F.struct("doc_id", "key")).alias("x")).select("node", "x.*"))
    part = components(_prefix_links(leads, t))
    placed = cut(leads.select("node", "size", "held").join(part, "node"))
    bucket = F.floor(F.log("size") / float(-np.log(min(t, 0.99))) + _EPS).cast("int")
    spread = placed.select("part", bucket.alias("bucket"), "held").groupBy("part", "bucket").agg(F.count(F.lit(1)).alias("k"), F.sum("held").alias("grams"), F.max("held").alias("longest"))
    blocks = F.ceil(F.greatest(F.col("k") / BLOCK, F.col("grams") / PIECE)).cast("int")
    # a text alone may be beyond a piece, which no dealing by blocks helps
    large = cut(
        spread.groupBy("part").agg(F.sum("k").alias("of"), F.sum("grams").alias("grams"), F.map_from_entries(F.collect_list(F.struct("bucket", blocks))).alias("layout"), F.max("longest").alias("longest"))
        .filter((F.col("of") > BLOCK) | (F.col("grams") > PIECE)).select("part", "layout", F.ceil(F.col("longest") * 2 / PIECE).cast("int").alias("pieces"))
    )
    rows, cuts = large.agg(F.count(F.lit(1)), F.coalesce(F.max("pieces"), F.lit(1))).first()
    plain = (placed if not rows else placed.join(F.broadcast(large) if rows <= BROADCAST_ROWS else large, "part", "left_anti")).select("node", "part", F.array(F.struct(F.xxhash64("part").alias("task"), F.lit(1).alias("side"))).alias("tasks"), F.lit(1).alias("pieces"))
    if rows:
        here = join_small(placed, large, ["part"], ["node"], rows).withColumn("bucket", bucket)
        of = lambda b: F.coalesce(F.try_element_at("layout", b), F.lit(0))
        mine = F.struct(F.col("bucket").alias("bucket"), F.pmod(F.xxhash64("node"), of(F.col("bucket"))).cast("int").alias("block"))
        near = lambda d: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(of(F.col("bucket") + d) - 1, F.lit(0))), lambda i: i < of(F.col("bucket") + d)), lambda i: F.struct((F.col("bucket") + d).alias("bucket"), i.alias("block")))
        # partners are in the same bucket of sizes or in the next one; a pair of blocks is a task: side 1 both are one, 0 the lower, 2 the upper
        task = lambda o: F.struct(F.xxhash64("part", F.least("mine", o), F.greatest("mine", o)).alias("task"), F.when(o == F.col("mine"), 1).when(o > F.col("mine"), 0).otherwise(2).alias("side"))
        dealt = here.withColumn("mine", mine).select("node", "part", F.transform(F.concat(*(near(d) for d in (-1, 0, 1))), task).alias("tasks"), "pieces")
        plain = plain.unionByName(dealt)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["task", "piece", "pieces", "node", "size", "grams"])
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            sent = 0
            for i, (node, size, tasks, pieces) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("node", "size", "tasks", "pieces")), strict=True)):
                g = np.sort(np.frombuffer(batch.column("grams")[i].as_buffer(), np.int64))
                # pieces are ranges of fragments, so of the global order
                ends = np.searchsorted(g >> 32, [fragments * p // pieces for p in range(1, pieces)] + [1 << 31]).tolist()
                for p, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                    if a < b:
                        blob = g[a:b].tobytes()
                        for x in tasks:
                            for column, v in zip(out, (x["task"], p, pieces, node, size << 2 | x["side"], blob), strict=True):
                                column.append(v)
                            sent += len(blob)
                            if sent > SENT:
                                yield made(out)
                                out, sent = [[], [], [], [], [], []], 0
            yield made(out)
        release()

    def one(x: pa.Table) -> pa.Table:
        task, piece, pieces, node, size = (x.column(c).to_numpy() for c in ("task", "piece", "pieces", "node", "size"))
        side, size, grams = size & 3, size >> 2, x.column("grams")
        order = np.lexsort((side, piece, task))
        edges = np.append(np.flatnonzero(np.append(True, (task[order][1:] != task[order][:-1]) | (piece[order][1:] != piece[order][:-1]))), len(order))
        out: list[list[np.ndarray]] = [[], [], [], [], [], [], []]

        def tile(upper: np.ndarray, other: np.ndarray | None) -> None:
            """The pairs of some classes, or of these with others."""
            who, lower = (upper, 0) if other is None else (np.append(upper, other), len(upper))
            total = counts([np.frombuffer(grams[int(i)].as_buffer(), np.int64) for i in who], lower)
            u, v = (size[upper], size[upper]) if other is None else (size[upper], size[other])
            may = total > 0
            if pieces[who[0]] == 1:
                may &= total >= t * (u[:, None] + v - total.astype(np.float64)) - _EPS
            else:
                may &= np.minimum(u[:, None], v) >= t * np.maximum(u[:, None], v) - _EPS
            i, j = np.nonzero(may if lower else np.triu(may, 1))
            both, j = total[i, j].astype(np.int64), j + lower
            if not len(i):
                return
            if pieces[who[0]] == 1:  # the whole overlap: either end's part is summed here
                m, best = len(who), np.zeros(len(who))
                each = both / (size[who[i]] + size[who[j]] - both)
                np.maximum.at(best, i, each)
                np.maximum.at(best, j, each)
                links = np.bincount(i, minlength=m) + np.bincount(j, minlength=m)
                there = np.flatnonzero(links)
                zero = np.zeros(len(there), np.int64)
                got = (node[who[there]], node[who[least_linked(m, i, j)[there]]], zero, zero, zero, links[there], best[there])
            else:
                a, b = who[i], who[j]
                a, b = np.where(node[a] > node[b], b, a), np.where(node[a] > node[b], a, b)
                got = (node[a], node[b], both, size[a], size[b], np.zeros(len(a), np.int64), np.zeros(len(a)))
            for column, y in zip(out, got, strict=True):
                column.append(y)

        for a, b in zip(edges, edges[1:], strict=False):
            who = order[a:b]
            alone = side[who[0]] == 1
            lower, upper = (who, who) if alone else (who[side[who] == 0], who[side[who] == 2])
            parts = [[g[k : k + TILE] for k in range(0, len(g), TILE)] for g in (lower, upper)]
            for p, y in enumerate(parts[0]):
                if alone:
                    tile(y, None)
                for z in parts[1][p + 1 :] if alone else parts[1]:
                    tile(y, z)
        names, kinds = ["node", "lead", "overlap", "size", "lead_size", "links", "best"], [np.int64] * 6 + [np.float64]
        return pa.table([np.concatenate([np.zeros(0, k), *c]) for c, k in zip(out, kinds, strict=True)], names)

    bins = max(16, fragments * 4)
    sent = leads.select("node", "size", "grams").join(plain, "node").select("node", "size", "grams", "tasks", "pieces").mapInArrow(deal, "task long, piece int, pieces int, node long, size long, grams binary")
    links = sent.withColumn("bin", F.pmod(F.xxhash64("task", "piece"), F.lit(bins))).groupBy("bin").applyInArrow(released(one), "node long, lead long, overlap long, size long, lead_size long, links long, best double")
    if cuts > 1:  # overlaps counted in pieces are summed by pair
        links = cut(links)
        whole = F.col("lead_size") + F.col("size") - F.col("overlap")
        summed = links.filter("links = 0").groupBy("node", "lead", "size", "lead_size").agg(F.sum("overlap").alias("overlap")).filter(F.col("overlap") >= whole * t - _EPS)
        ends = F.explode(F.array(F.struct("node", "lead"), F.struct(F.col("lead").alias("node"), F.col("node").alias("lead")))).alias("x")
        summed = summed.select(ends, (F.col("overlap") / whole).alias("best")).select("x.*", F.lit(1).cast("long").alias("links"), "best")
        links = links.filter("links > 0").select("node", "lead", "links", "best").unionByName(summed)
    return members, links.select("node", "lead", "links", "best")


def near_groups(docs: DataFrame, n: int = N, t: float = T) -> DataFrame:
    """(doc_id, key, class_id, keep, copies, links, best) of every document that has a partner.

    class_id is the least doc_id of its connected group, whose first document (by doc_id, then key) is kept; copies counts the
    other documents with the same grams, links the classes of other grams with Jaccard t or more, best is the highest similarity."""
    members, links = class_links(docs, n, t)
    links = cut(links)
    linked = links.groupBy("node").agg(F.sum("links").alias("links"), F.max("best").alias("best"))
    part = components(links.select(F.col("node").alias("a"), F.col("lead").alias("b")))
    classes_ = members.groupBy("node").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("doc_id", "key")).alias("first")).join(linked, "node", "left").join(part, "node", "left").withColumn("part", F.coalesce("part", "node")).filter("k > 1 or links > 0")
    classes_ = cut(classes_)
    firsts = classes_.groupBy("part").agg(F.min("first").alias("least"))
    verdict = cut(join_small(classes_, cut(firsts), ["part"], ["node"]).select("node", "k", F.coalesce("links", F.lit(0)).alias("links"), F.when(F.col("k") > 1, 1.0).otherwise(F.col("best")).alias("best"), "least"))
    of = join_small(members, verdict, ["node"], ["doc_id", "key"])
    return of.select("doc_id", "key", F.col("least.doc_id").alias("class_id"), (F.col("least") == F.struct("doc_id", "key")).alias("keep"), (F.col("k") - 1).alias("copies"), "links", "best")


def jaccard_join(docs: DataFrame, n: int = N, t: float = T) -> DataFrame:
    """(doc_id, class_id, links, copies, best): a row for each document that has a partner, see near_groups."""
    return near_groups(docs, n, t).select("doc_id", "class_id", "links", "copies", "best")


def near_filter(docs: DataFrame, n: int = N, t: float = T) -> DataFrame:
    """The documents but for all others of each group of near copies, and but for repeated rows."""
    gone = cut(near_groups(docs, n, t).filter("not keep").select(F.col("doc_id").alias("g_id"), F.col("key").alias("g_key")))
    ids = {"g_id": F.col("doc_id").cast("long"), "g_key": F.xxhash64("text")}
    repeats = cut(docs.select(*[c.alias(k) for k, c in ids.items()]).filter("g_id is not null").groupBy("g_id", "g_key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k"))
    few, times = gone.count() <= BROADCAST_ROWS, repeats.count()
    left = wrapped(docs, **ids).join(F.broadcast(gone) if few else gone, ["g_id", "g_key"], "left_anti")
    if times:
        side = F.broadcast(repeats) if times <= BROADCAST_ROWS else repeats
        again = left.join(side, ["g_id", "g_key"], "left_semi").dropDuplicates(["g_id", "g_key"])
        left = left.join(side, ["g_id", "g_key"], "left_anti").unionByName(again)
    return unwrapped(left)
