"""Near duplicates by exact Jaccard similarity, found without loss by partitions of the items.

Each text is a set of hashed items (word 3-grams, or words). Equal sets are one class, so copies aren't compared or expanded.

1. Two sets of Jaccard t or more differ in at most k items, k = (1 - t) / t times the smaller one's size. Sizes are cut in bands
   that grow by 1 / t, so that such two are in the same band or the next; k is that of the smaller one's band. Items are dealt
   over k + 2 partitions by their hash: the two agree in two partitions at least. A set has a signature for each of its
   partitions, for its own band and as the larger one of the band before. An empty partition has none, unless a set has more
   than one of them: so two sets always agree in a signature.
2. Sets with an equal signature are compared by a sketch: of as many bits as the size asks for, those that an odd number of
   items fall on. Bits that differ can't be more than items that differ, so no near set is lost. Only links that connect
   what is left go on, not pairs.
3. Every pair lies inside a connected part of these links. Within a part all sets are compared by their items, a part beyond
   BLOCK sets or PIECE items block by block. What is sent on is a sum for each class, not the pairs.

Texts without items have no partners."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import cut, release, ship
from ..functions import points
from ..graph import components

#: Physical sizes, without influence on results: sets and items in a block, how many may have an item for its pairs to be counted one by one, columns of a product, the least and the most bits of a sketch.
BLOCK, PIECE, FEW, COLUMNS, BITS = 512, 1_000_000, 8, 2048, (256, 2048)


def _gram_arrays(n: int) -> Callable[[list[str]], pa.Array]:
    def make(texts: list[str]) -> pa.Array:
        gram, size = points.gram_sets(texts, n)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(gram, pa.int64()))

    return make


def words(text: Column) -> Column:
    """The hashes of the text's distinct lower-case words, in order."""
    return points.by_slices(_gram_arrays(1), "array<long>")(text)


def shingles(text: Column, n: int = 3) -> Column:
    """The hashes of the text's distinct runs of n lower-case words, in order."""
    return points.by_slices(_gram_arrays(n), "array<long>")(text)


def item_sets(df: DataFrame, items: Column, key: str = "id") -> DataFrame:
    """(id, n, items): the distinct items in order, strings hashed; rows without any are left out. Texts are read once, as the result is materialised."""
    ship(df.sparkSession)
    texts = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), items.alias("s"))
    hashed = F.col("s") if dict(texts.dtypes)["s"] == "array<bigint>" else F.transform("s", lambda x: F.xxhash64(x))
    sets = texts.select("id", F.array_sort(F.array_distinct(hashed)).alias("items"))
    return cut(sets.select("id", F.size("items").alias("n"), "items").filter("n > 0"))


def bands(t: float, most: int) -> np.ndarray:
    """The least size of each band, up to the first beyond most."""
    out = [1]
    while out[-1] <= most:
        out.append(int(out[-1] / t + 1e-9) + 1)
    return np.array(out, np.int64)


def signatures(sets: DataFrame, t: float) -> DataFrame:
    """(id, n, h, sketch, sigs) of each set; h is a hash of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, points.ROWS):
                part = batch.slice(at, points.ROWS)
                ids, sizes, lists = part.column(0), part.column(1).to_numpy().astype(np.int64), part.column(2)
                for a, b in points.slices(sizes.tolist(), points.SLICE):
                    yield of(ids.slice(a, b - a), sizes[a:b], lists.slice(a, b - a).flatten().to_numpy().view(np.uint64))
        release()

    def of(ids: pa.Array, size: np.ndarray, items: np.ndarray) -> pa.RecordBatch:
        m, edges = len(size), bands(t, int(size.max(initial=1)))
        row, ends = np.repeat(np.arange(m), size), np.cumsum(size)
        x = points.mix(items)
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(points.mix(x), out=total[1:])
        h = points.mix(total[ends] - total[ends - size] + size.astype(np.uint64)).view(np.int64)
        bits = np.clip(1 << np.ceil(np.log2(size / 3)).clip(0).astype(np.int64), *BITS)  # a power of two, a third of the items at least
        from_ = np.cumsum(bits) - bits
        odd = np.bincount(from_[row] + (x >> np.uint64(40)).astype(np.int64) % bits[row], minlength=int(bits.sum())) & 1
        packed = np.packbits(odd.astype(np.uint8)).tobytes()
        sketch = [packed[f // 8 : (f + n) // 8] for f, n in zip(from_.tolist(), bits.tolist(), strict=True)]
        band = np.searchsorted(edges, size, "right") - 1
        rows, sigs = [], []
        for scheme in (band, band - 1):
            real = scheme >= 0
            k = np.floor((1 - t) / t * (edges[scheme + 1] - 1) + 1e-6).astype(np.int64)
            real &= k > 0  # else only equal sets are near
            parts = np.where(real, k + 2, 0)
            begin = np.cumsum(parts) - parts
            on = real[row]
            place = begin[row[on]] + ((x[on] & np.uint64(0xFFFFFFFF)) % parts[row[on]].astype(np.uint64)).astype(np.int64)
            count = np.bincount(place, minlength=int(parts.sum()))
            # sums by partition: of 16 bits at a time, as bincount adds doubles
            deep, sig = points.mix(x[on]), points.mix(count.astype(np.uint64))
            for shift in (0, 16, 32, 48):
                sig = points.mix(sig + np.bincount(place, (deep >> np.uint64(shift)) & np.uint64(0xFFFF), len(count)).astype(np.uint64))
            of_row = np.repeat(np.arange(m), parts)
            nth = np.arange(len(of_row)) - np.repeat(begin, parts)
            sig = points.mix(sig + points.mix(scheme[of_row].astype(np.uint64) * np.uint64(1 << 32) + nth.astype(np.uint64)))
            hollow = np.bincount(of_row, count == 0, m)
            keep = (count > 0) | (hollow > 1)[of_row]
            rows.append(of_row[keep])
            sigs.append(sig[keep].view(np.int64))
        rows, sigs = np.concatenate(rows), np.concatenate(sigs)[np.argsort(np.concatenate(rows), kind="stable")]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(rows, minlength=m))), pa.int32()), pa.array(sigs))
        return pa.RecordBatch.from_arrays([ids, pa.array(size.astype(np.int32)), pa.array(h), pa.array(sketch, pa.binary()), lists], ["id", "n", "h", "sketch", "sigs"])

    return sets.select("id", "n", "items").mapInArrow(run, f"id {dict(sets.dtypes)['id']}, n int, h long, sketch binary, sigs array<long>")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups; rows come sorted by the first columns, so many of which are the key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows - 1, bool)
        for c in batch.columns[:keys]:
            v = c.to_numpy(zero_copy_only=False)
            new |= v[1:] != v[:-1]
        last = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0  # where the last group begins
        same = bool(held) and all(held[-1].column(i)[-1] == batch.column(i)[0] for i in range(keys))
        if held and not same:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _plausible(sketches: list[bytes], n: np.ndarray, t: float) -> tuple[list[int], list[int]]:
    """Links that connect what may have Jaccard t or more by sizes and sketches. Of unlike lengths, the longer ones are folded: a bit of the shortest stands for several."""
    width = min(map(len, sketches)) // 8
    bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, width), 0) for x in sketches])
    a, b, seeds, rest = [], [], [0], np.arange(1, len(n))
    while len(rest):
        if seeds:
            one = seeds.pop()
        else:
            one, rest = rest[0], rest[1:]
        size = n[rest]
        fits = np.minimum(size, n[one]) >= np.maximum(size, n[one]) * t - 1e-9
        fits &= np.bitwise_count(bits[rest] ^ bits[one]).sum(1) <= (1 - t) / (1 + t) * (size + n[one]) + 1e-6
        found = rest[fits].tolist()
        a += [one] * len(found)
        b += found
        seeds += found
        rest = rest[~fits]
    return a, b


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of sig, those whose sig is another one's too."""
    for table in _runs(batches, 1):
        new = np.diff(table.column("sig").to_numpy()) != 0
        more = ~(np.append(True, new) & np.append(new, True))
        if more.any():
            yield from table.filter(pa.array(more)).to_batches()
    release()


def plausible_links(leads: DataFrame, t: float) -> DataFrame:
    """(a, b): links that connect all leads that may be near, distinct."""
    kind = dict(leads.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 1):
            sig, n, sketch = table.column("sig").to_numpy(), table.column("n").to_numpy().astype(np.int64), table.column("sketch")
            edges = [0, *(np.flatnonzero(np.diff(sig)) + 1).tolist(), len(sig)]
            a, b = [], []
            for at, end in zip(edges, edges[1:], strict=False):
                x, y = _plausible(sketch.slice(at, end - at).to_pylist(), n[at:end], t)
                a += [at + i for i in x]
                b += [at + i for i in y]
            if a:
                ids = table.column("id").combine_chunks()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a, pa.int64())), ids.take(pa.array(b, pa.int64()))], ["a", "b"])
        release()

    each = leads.select(F.explode("sigs").alias("sig"), "id")
    met = each.repartition("sig").sortWithinPartitions("sig").mapInArrow(_met, f"sig long, id {kind}")
    known = met.join(leads.select("id", "n", "sketch"), "id")
    return known.repartition("sig").sortWithinPartitions("sig").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _overlaps(rows: list[np.ndarray]) -> np.ndarray:
    """How many items each two of the arrays share.

    Of an item that few have, the pairs are counted one by one; the others are columns, products of slices of them are added."""
    m = len(rows)
    item, row = np.concatenate(rows), np.repeat(np.arange(m), [len(r) for r in rows])
    order = np.argsort(item, kind="stable")
    item, row = item[order], row[order]
    column = np.cumsum(np.append(True, item[1:] != item[:-1])) - 1
    often = np.bincount(column)[column]
    total = np.zeros((m, m), np.float32)
    some = (often > 1) & (often <= FEW)
    few, group = row[some], column[some]
    for k in range(1, FEW):  # each with the k-th after it
        same = group[k:] == group[:-k]
        if not same.any():
            break
        total += np.bincount(few[:-k][same] * m + few[k:][same], minlength=m * m).reshape(m, m).astype(np.float32)
    total += total.T
    row, column = row[often > FEW], column[often > FEW]
    column = np.cumsum(np.append(True, column[1:] != column[:-1]))[: len(column)] - 1
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        x = np.zeros((m, min(COLUMNS, int(column[-1]) + 1 - at)), np.float32)
        x[row[a:b], column[a:b] - at] = 1
        total += x @ x.T
    return total


def class_links(sets: DataFrame, t: float) -> tuple[DataFrame, DataFrame]:
    """(members, linked): members (id, lead) names each id's class by its least id; linked has, of each lead with others of Jaccard t or more, their number links, the highest similarity top, the least of them first, and before, the highest similarity of an earlier one."""
    kind = dict(sets.dtypes)["id"]
    coded = cut(signatures(sets, t).withColumn("lead", F.min("id").over(Window.partitionBy("n", "h"))))
    leads = coded.filter("id = lead")
    parts = cut(components(plausible_links(leads, t)))
    size = parts.join(leads.select("id", "n"), F.col("node") == F.col("id")).groupBy("part").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / PIECE)).cast("int").alias("blocks"))
    inside = sets.join(parts.join(size, "part"), F.col("node") == F.col("id")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("part").alias("part"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "n", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 3):
            key = np.stack([table.column(c).to_numpy() for c in ("part", "i", "j")])
            edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), table.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if b - a > 1:
                    yield from compared(table.slice(a, b - a))
        release()

    def compared(x: pa.Table) -> Iterator[pa.RecordBatch]:
        id_, n, block = x.column("id"), x.column("n").to_numpy().astype(np.int64), x.column("block").to_numpy()
        lists = x.column("items").combine_chunks()
        flat = lists.flatten().to_numpy()
        share = _overlaps(np.split(flat, np.cumsum(n)[:-1])).astype(np.float64)
        similarity = share / (n[:, None] + n[None, :] - share)
        near = similarity >= t - 1e-9
        np.fill_diagonal(near, False)
        if x.column("i")[0] != x.column("j")[0]:
            near &= block[:, None] != block[None, :]
        links = near.sum(1)
        order = np.argsort(np.argsort(np.array(id_.to_pylist()), kind="stable"))  # places of the ids
        earlier = order[None, :] < order[:, None]
        top, before = np.where(near, similarity, -1).max(1), np.where(near & earlier, similarity, -1).max(1)
        first = np.argsort(order)[np.where(near, order[None, :], len(order) - 1).min(1)]
        keep = np.flatnonzero(links)
        if len(keep):
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [id_.combine_chunks().take(at), pa.array(links[keep]), pa.array(top[keep]), id_.combine_chunks().take(pa.array(first[keep])), pa.array(before[keep], mask=before[keep] < 0)], ["lead", "links", "top", "first", "before"]
            )

    ordered = dealt.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j")
    sums = ordered.mapInArrow(run, f"lead {kind}, links long, top double, first {kind}, before double")
    linked = sums.groupBy("lead").agg(F.sum("links").alias("links"), F.max("top").alias("top"), F.min("first").alias("first"), F.max("before").alias("before"))
    return coded.select("id", "lead"), cut(linked)


def near(sets: DataFrame, t: float) -> DataFrame:
    """A row for each id that has a partner: (id, class_id, copies, links, best, duplicate, representative).

    class_id is the least id of those with the same items and copies counts the others of them; links counts the classes with
    Jaccard t or more, best is the highest similarity. duplicate is 1 - similarity to the most similar earlier id, and
    representative the least earlier partner; both are null where all partners come later."""
    members, linked = class_links(sets, t)
    classes = members.groupBy("lead").agg(F.count(F.lit(1)).alias("k")).join(linked, "lead", "left").filter("k > 1 or links > 0")
    later = F.col("id") > F.col("lead")
    return members.join(cut(classes), "lead").select(
        "id", F.col("lead").alias("class_id"), (F.col("k") - 1).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"), F.when(F.col("k") > 1, 1.0).otherwise(F.col("top")).alias("best"),
        F.when(later, 0.0).otherwise(1 - F.col("before")).alias("duplicate"), F.least(F.when(later, F.col("lead")), F.when(F.col("first") < F.col("id"), F.col("first"))).alias("representative"),
    )


def penalties(found: DataFrame) -> DataFrame:
    """(id, duplicate) of the ids that have an earlier partner."""
    return found.filter("duplicate is not null").select("id", "duplicate")


def groups(found: DataFrame) -> DataFrame:
    """(id, representative): each id that has an earlier partner goes to the least of these."""
    return found.filter("representative is not null").select("id", "representative")


def group_report(df: DataFrame, found: DataFrame) -> DataFrame:
    """One row: rows checked, groups, rows in groups (representatives included)."""
    g = groups(found)
    inside = g.select(F.explode(F.array("id", "representative")).alias("id")).distinct()
    return df.agg(F.count(F.lit(1)).alias("checked")).crossJoin(g.agg(F.countDistinct("representative").alias("duplicate_groups"))).crossJoin(inside.agg(F.count(F.lit(1)).alias("duplicate_chunks")))


class Index:
    """Sets of items that were seen before, in a store: new texts are compared with them and with each other, then added."""

    def __init__(self, store, t: float = 0.92, items=shingles):
        self.store, self.t, self.items = store, t, items

    def add(self, df: DataFrame, key: str = "id", text: str = "text") -> None:
        self.store.add(item_sets(df, self.items(F.col(text)), key))

    def find(self, df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
        """near() of the new rows among all; an id that is there already is replaced for this."""
        new, old = item_sets(df, self.items(F.col(text)), key), self.store.get_all()
        every = new if old is None else old.join(new.select("id"), "id", "left_anti").unionByName(new)
        return near(every, self.t).join(new.select("id"), "id", "left_semi")

    def clear(self) -> None:
        self.store.clear()
