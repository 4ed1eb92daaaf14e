"""N-gram Jaccard join by chosen paths.

A text is the set of its shingles of SIZE words; texts with equal sets form a class, and one of them
stands for it. A class is described by COORDINATES minimal hashes. A run starts with all classes in one
bucket and splits buckets again and again: each bucket draws a few coordinates, 1 / SIMILARITY of them on
average, and a class goes to one child for each drawn coordinate, the child of its value there. Two
classes of that similarity are expected to share a child at every level. Buckets of up to BUCKET classes
are compared by brute force on sketches; RUNS independent runs reach the target recall. A larger bucket that
kept more than DENSE of its parent's classes will not split further, as its classes are alike: all of
them are linked to one member. Of another large bucket the least member leads; if over half of the classes have
a sketch like its own, these are linked to it, with all classes that are like any of them, and leave before
the bucket is split, so a large group of near copies is not carried down.

What the buckets link are candidates only. Their connected components are read again from the texts, and
within each component every pair is compared exactly, in blocks, so links are neither estimated nor
lost there, and no pair is ever written out: tasks return link counts and a spanning forest. Sets whose
sizes alone rule a link out are not counted through.

Disk follows the rows, not their pairs: buckets are dealt out ROWS at a time, blocks hold as many sets as a
task can, and block pairs are read SHIPPED bytes at a time. What a part has shuffled goes when it is done.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quality_probe.llm import words as W
from quality_probe.llm.components import components
from quality_probe.operators.sizes import broadcast_if_small, gathered, is_small
from quality_probe.scratch import removed, written

SIZE = 5
SIMILARITY = 0.8
OF, PARTS = 4, 5  # the same as a ratio, for exact comparison
COORDINATES = 64
RUNS = 20  # a pair at the threshold survives two levels of a run with probability 0.47: recall 1 - 3e-6
BUCKET = 32
DENSE = 0.5
DEPTH = 10
SKETCH_SLACK = 0.2  # four standard deviations of a sketch of 64 coordinates
ALIKE = 39  # least number of equal bytes in two sketches that agree in SIMILARITY - SKETCH_SLACK
NEAR = 2 * ALIKE - COORDINATES  # what is like a sketch that is ALIKE to the leader's has as many bytes of the leader's
ROWS = 1 << 24  # classes in buckets, of one part of a level
BLOCK = 512  # sets compared at once
MEMBERS, HASHES = 1 << 12, 1 << 20  # sets of a component that one task holds, and hashes of these, about
SHIPPED = 1 << 31  # bytes of sets on their way to tasks, or SHARE of all sets if that is more
SHARE = 0.25
SMALL = 24  # sets compared one by one
MEMBERS_A_TASK = 1 << 12  # of small buckets, at least

SEEDS = W.mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64))
SETS = "_id bigint, doc_id bigint, class_a bigint, class_b bigint, n bigint, mins binary"


def shingles(texts: pa.Array) -> tuple:
    """(hashes, borders): the sorted distinct shingle hashes of each text of a piece."""
    data, borders = W.flat(texts)
    starts, ends, rows = W.spans(data, borders)
    hashes, rows = W.window_hashes(W.span_hashes(data, starts, ends), rows, SIZE)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[first], rows[first]
    return hashes, np.searchsorted(rows, np.arange(len(texts) + 1))


def minima(hashes: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """(texts, COORDINATES) uint32 minimal hashes; all ones for a text without words."""
    n = len(borders) - 1
    out = np.full((n, COORDINATES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(borders) > 0)
    if not len(full):
        return out
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    for c in range(COORDINATES):
        seed = SEEDS[c]
        drawn = (low ^ np.uint32(seed >> np.uint64(32))) * np.uint32((seed & np.uint64(0xFFFFFFFF)) | np.uint64(1))
        drawn ^= drawn >> np.uint32(15)
        drawn *= np.uint32(0x2C1B3C6D)
        drawn ^= drawn >> np.uint32(13)
        out[full, c] = np.minimum.reduceat(drawn, borders[full])
    return out


def set_hash(hashes: np.ndarray, borders: np.ndarray, seed: int) -> np.ndarray:
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(W.mixed(hashes ^ np.uint64(seed)), out=sums[1:])
    sizes = np.diff(borders).astype(np.uint64)
    return W.mixed((sums[borders[1:]] - sums[borders[:-1]]) ^ (sizes << np.uint64(40))).view(np.int64)


def described(docs: DataFrame) -> DataFrame:
    """SETS of every row: a row number, its id, 128 bits of its set, the set's size and minima."""

    def describe(batches):
        for batch in batches:
            for row, part in W.pieces(W.filled(batch.column("text"))):
                hashes, borders = shingles(part)
                found = minima(hashes, borders)
                size = COORDINATES * 4
                mins = pa.BinaryArray.from_buffers(
                    pa.binary(), len(part),
                    [None, pa.py_buffer((np.arange(len(part) + 1) * size).astype(np.int32)), pa.py_buffer(found.tobytes())],
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(row, len(part)), batch.column("doc_id").slice(row, len(part)),
                     pa.array(set_hash(hashes, borders, 1)), pa.array(set_hash(hashes, borders, 2)),
                     pa.array(np.diff(borders).astype(np.int64)), mins],
                    names=["_id", "doc_id", "class_a", "class_b", "n", "mins"],
                )

    return docs.mapInArrow(describe, SETS)


def drawn_coordinates(paths: np.ndarray) -> np.ndarray:
    """(buckets, COORDINATES): which coordinates each bucket draws, 1 / SIMILARITY of them on average."""
    mixed = W.mixed(paths[:, None] ^ SEEDS[None, :])
    return mixed < np.uint64(int(2.0**64 / (SIMILARITY * COORDINATES)))


def children(paths: np.ndarray, mins: np.ndarray) -> tuple:
    """(row, path) of the child buckets of each class in its bucket."""
    row, coordinate = np.nonzero(drawn_coordinates(paths))
    value = mins[row, coordinate].astype(np.uint64)
    return row, W.mixed(paths[row] ^ W.mixed(SEEDS[coordinate] + value))


def as_minima(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def sketched(mins: np.ndarray) -> pa.Array:
    """One byte of each minimum."""
    flat = (mins & np.uint32(0xFF)).astype(np.uint8)
    offsets = (np.arange(len(mins) + 1) * COORDINATES).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(mins), [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())])


def split(rows: DataFrame, roots: bool) -> DataFrame:
    """(_id, path, parent) of the children and the size of the bucket they come from.

    With `roots` those of every run's first bucket; else `rows` has path and size.
    """

    def descend(batches):
        for batch in batches:
            mins, ids = as_minima(batch.column("mins")), batch.column("_id").to_numpy()
            if roots:
                for run in range(RUNS):
                    path = W.mixed(np.full(len(ids), run + 1, np.uint64))
                    row, child = children(path, mins)
                    yield found(ids[row], child, np.full(len(row), 1 << 62))
            elif len(ids):
                row, child = children(batch.column("path").to_numpy().view(np.uint64), mins)
                yield found(ids[row], child, batch.column("size").to_numpy()[row])

    def found(ids, child, size):
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(child.view(np.int64)), pa.array(size)], names=["_id", "path", "parent"]
        )

    return rows.mapInArrow(descend, "_id bigint, path bigint, parent bigint")


class Forest:
    """Union-find over the ids of one task's piece of work."""

    def __init__(self):
        self.up = {}

    def root(self, x):
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x, y):
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def edges(self) -> list:
        return [(x, self.root(x)) for x in self.up if self.root(x) != x]


def compared(buckets: DataFrame, least: float, rows: int) -> DataFrame:
    """(a, b): a spanning forest of the pairs in each small bucket whose sketches agree in `least`."""

    def compare(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            path = table.column("path").to_numpy()
            if not len(path):
                continue
            last = int(np.searchsorted(path != path[-1], False)) if path[0] == path[-1] else int(np.flatnonzero(path != path[-1])[-1]) + 1
            held = table.slice(last)
            yield linked(table.slice(0, last))
        if held is not None:
            yield linked(held)

    def linked(table):
        forest = Forest()
        path, ids = table.column("path").to_numpy(), table.column("_id").to_numpy()
        if len(ids):
            sketch = as_sketches(table.column("sketch"))
            step = 1
            while step < len(path):
                left = np.flatnonzero(path[step:] == path[:-step])
                if not len(left):
                    break
                alike = (sketch[left] == sketch[left + step]).mean(axis=1) >= least
                for x, y in zip(ids[left[alike]].tolist(), ids[left[alike] + step].tolist(), strict=True):
                    forest.join(x, y)
                step += 1
        found = forest.edges()
        return pa.RecordBatch.from_arrays(
            [pa.array([e[0] for e in found], pa.int64()), pa.array([e[1] for e in found], pa.int64())], names=["a", "b"]
        )

    dealt = gathered(buckets.repartition("path"), rows, MEMBERS_A_TASK)
    return dealt.sortWithinPartitions("path").mapInArrow(compare, "a bigint, b bigint")


def with_sketch(classes: DataFrame) -> DataFrame:
    def add(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), sketched(as_minima(batch.column("mins")))], names=["_id", "sketch"]
                )

    return classes.select("_id", "mins").mapInArrow(add, "_id bigint, sketch binary")


def as_sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def led(large: DataFrame, rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """(_id, path, size, _lead, equal): the classes of large buckets and how many bytes of the leader's sketch they share."""

    def compare(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own, other = (as_sketches(batch.column(c)) for c in ("sketch", "_sketch"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("_id", "path", "size", "_lead")]
                + [pa.array((own == other).sum(axis=1).astype(np.int32))],
                names=["_id", "path", "size", "_lead", "equal"],
            )

    leaders = large.join(sketches.withColumnRenamed("_id", "_lead").withColumnRenamed("sketch", "_sketch"), "_lead")
    kept = rows.select("_id", "path").join(leaders, "path").repartition("_id")  # a large bucket leaves its one task
    kept = kept.join(sketches, "_id").select("_id", "path", "size", "_lead", "sketch", "_sketch")
    return kept.mapInArrow(compare, "_id bigint, path bigint, size bigint, _lead bigint, equal int")


def level(rows: DataFrame, n_rows: int, classes: DataFrame, sketches: DataFrame, last: bool) -> tuple:
    """(links, children): tables of links (a, b) of these buckets, and the rows below the large ones, None without any."""
    least = SIMILARITY - SKETCH_SLACK
    sizes = rows.groupBy("path").agg(
        F.count("*").alias("size"), F.min("_id").alias("_least"), F.max("parent").alias("parent")
    ).where("size > 1")
    dense = (F.col("size") > DENSE * F.col("parent")) | F.lit(last)
    kind = F.when(F.col("size") <= BUCKET, "small").when(dense, "dense").otherwise("large")
    sizes = written(gathered(sizes.withColumn("kind", kind).drop("parent"), n_rows), "path-sizes")
    n = dict(sizes.groupBy("kind").agg(F.sum("size")).collect())  # three rows at most
    small = rows.join(sizes.where("kind = 'small'").select("path"), "path")
    links = compared(small.join(sketches, "_id").select("_id", "path", "sketch"), least, n.get("small", 0))
    star = rows.join(sizes.where("kind = 'dense'").select("path", "_least"), "path").where("_id <> _least")
    links = links.union(star.select(F.col("_id").alias("a"), F.col("_least").alias("b")))
    links = written(gathered(links.distinct(), n.get("small", 0) + n.get("dense", 0)), "links")
    if "large" not in n:
        removed(sizes)
        return [links], None
    large = sizes.where("kind = 'large'").select("path", "size", F.col("_least").alias("_lead"))
    inside = written(led(large, rows, sketches), "led")
    tight = inside.where(f"equal >= {ALIKE}").groupBy("path").agg(F.count("*").alias("alike"), F.max("size").alias("of"))
    tight = tight.where("2 * alike > of").select("path", "alike")
    judged = written(inside.join(tight, "path", "left"), "led")
    around = judged.where(f"alike IS NOT NULL AND equal >= {NEAR} AND _id <> _lead")
    around = around.select(F.col("_id").alias("a"), F.col("_lead").alias("b"))
    around = written(gathered(around.distinct(), n["large"]), "links")
    left = judged.where(f"alike IS NULL OR equal < {ALIKE}")
    left = left.select("_id", "path", F.expr("size - coalesce(alike, 0) AS size")).join(classes, "_id")
    children = written(split(left.select("_id", "path", "size", "mins"), roots=False), "paths")
    removed(sizes, inside, judged)
    return [links, around], children


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b) links between classes (_id, mins) that may be similar: a forest for each bucket."""
    sketches = written(with_sketch(classes), "sketches")
    found, tables = [], [written(split(classes, roots=True), "paths")]
    for depth in range(DEPTH):
        rows = reduce(DataFrame.union, tables)
        n_rows = rows.count()
        parts = max(1, -(-n_rows // ROWS))
        links, below = [], []
        for part in range(parts):
            own = rows.where(F.pmod(F.xxhash64("path"), F.lit(parts)) == part) if parts > 1 else rows
            made, children = level(own, -(-n_rows // parts), classes, sketches, depth + 1 == DEPTH)
            links += made
            below += [] if children is None else [children]
        if parts > 1:
            found.append(written(reduce(DataFrame.union, links).distinct(), "links"))
            removed(*links)
        else:
            found += links
        removed(*tables)
        tables = below
        if not tables:
            break
    removed(sketches)
    return reduce(DataFrame.union, found)


def intersections(left: list, right: list) -> np.ndarray:
    """Sizes of the intersections of two lists of sorted sets, by counting shared values in slices."""
    out = np.zeros((len(left), len(right)), np.float32)
    values = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in [*left, *right]])
    distinct, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    step = 4096
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [first, first + step])
        dense = np.zeros((len(left) + len(right), step), np.float32)
        dense[owner[a:b], column[a:b] - first] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out


def similar(left: list, right: list) -> np.ndarray:
    """Pairs with a Jaccard similarity of SIMILARITY or more."""
    if len(left) * len(right) <= SMALL * SMALL:
        common = np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left])
    else:
        common = intersections(left, right)
    sizes = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
    return np.argwhere(common.astype(np.int64) * (OF + PARTS) >= OF * sizes)


def pairs(left: list, right: list | None = None):
    """Index pairs of similar sets, of which the smaller has OF / PARTS of the larger's size at least.

    Both lists are in order of size; without `right`, pairs within `left`.
    """
    own, right = right is None, left if right is None else right
    for x in range(0, len(left), BLOCK):
        some = left[x : x + BLOCK]
        for y in range(x if own else 0, len(right), BLOCK):
            other = right[y : y + BLOCK]
            if PARTS * len(some[-1]) < OF * len(other[0]) or PARTS * len(other[-1]) < OF * len(some[0]):
                continue
            found = similar(some, other)
            yield from ((found if not own or x < y else found[found[:, 0] < found[:, 1]]) + [x, y]).tolist()


def verified(sets: DataFrame) -> DataFrame:
    """(a, b, links): link counts (b null) and a spanning forest (links 0) of each pair of blocks.

    `sets` is (_id, _root, i, j, block, shingles): the sets of blocks i and j of a candidate component.
    """

    def grouped(batches):
        held, key = [], None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("_root", "i", "j", "_id", "block", "shingles")]
            for root, i, j, own, block, raw in zip(*columns, strict=True):
                if key != (root, i, j):
                    if held:
                        yield key, held
                    held, key = [], (root, i, j)
                held.append((own, block, np.frombuffer(raw, np.uint64)))
        if held:
            yield key, held

    def verify(batches):
        out = []
        for (_, i, j), rows in grouped(batches):
            rows.sort(key=lambda r: len(r[2]))
            left = [r for r in rows if r[1] == i]
            right = left if i == j else [r for r in rows if r[1] == j]
            forest, counts = Forest(), {}
            for x, y in pairs([r[2] for r in left], None if i == j else [r[2] for r in right]):
                a, b = left[x][0], right[y][0]
                forest.join(a, b)
                counts[a] = counts.get(a, 0) + 1
                counts[b] = counts.get(b, 0) + 1
            out += [(a, b, 0) for a, b in forest.edges()] + [(a, None, n) for a, n in counts.items()]
            if len(out) > 10000:
                yield frame(out)
                out = []
        yield frame(out)

    def frame(out):
        a, b, n = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "links"])

    return (
        sets.repartition("_root", "i", "j")
        .sortWithinPartitions("_root", "i", "j", "_id")
        .mapInArrow(verify, "a bigint, b bigint, links bigint")
    )


def numbered(docs: DataFrame) -> DataFrame:
    """_id, doc_id, text: the place of a row among the partitions of the scan, which a rerun repeats."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").select(
        F.monotonically_increasing_id().alias("_id"), "doc_id", "text"
    )


def with_shingles(docs: DataFrame, members: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """Blocks of `members` (_id, _root, block, blocks) with their sets, once for each pair of blocks of this part."""

    def read(batches):
        for batch in batches:
            for row, part in W.pieces(W.filled(batch.column("text"))):
                hashes, borders = shingles(part)
                raw = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(part), [None, pa.py_buffer(borders.astype(np.int64) * 8), pa.py_buffer(hashes.tobytes())]
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(row, len(part)) for c in ("_id", "_root", "block", "blocks")] + [raw.cast(pa.binary())],
                    names=["_id", "_root", "block", "blocks", "shingles"],
                )

    pairs = "transform(sequence(0, blocks - 1), o -> struct(least(o, block) AS i, greatest(o, block) AS j))"
    if parts > 1:
        pairs = f"filter({pairs}, p -> pmod(xxhash64(_root, p.i, p.j), {parts}) = {part})"
        members = members.where(f"size({pairs}) > 0")
    texts = numbered(docs).select("_id", "text").join(broadcast_if_small(members), "_id")
    sets = texts.select("_id", "_root", "block", "blocks", "text").mapInArrow(
        read, "_id bigint, _root bigint, block int, blocks int, shingles binary"
    )
    return sets.select("_id", "_root", "block", "shingles", F.explode(F.expr(pairs)).alias("pair")).select(
        "_id", "_root", "block", "shingles", "pair.i", "pair.j"
    )


def compared_exactly(docs: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """`verified` of all `members` (_id, _root, n, block, blocks), in parts by what their sets take on the way."""
    shipped = members.agg(F.sum(F.col("n") * 8 * F.col("blocks"))).first()[0] or 0
    limit = max(SHIPPED, SHARE * 8 * (classes.agg(F.sum("n")).first()[0] or 0))
    parts = max(1, -int(-shipped // limit))
    members = members.drop("n")
    tables = [written(verified(with_shingles(docs, members, part, parts)), "verified") for part in range(parts)]
    return reduce(DataFrame.union, tables)


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, copy_of, n_shingles, _id of every document.

    `class_id` is the least doc_id of the documents that links connect (copies of each other included),
    `n_links` the number of other different texts (sets) with a similarity of SIMILARITY or more, and
    `copy_of` the least doc_id with an equal set. Texts of one to four words are one shingle; texts
    without words, null ones included, are copies of each other and have no links. Null ids count for no
    minimum; repeated rows are copies; an empty table gives no rows; other columns are not read.
    """
    sets = written(described(numbered(docs)), "sets")
    classes = sets.groupBy("class_a", "class_b").agg(F.min("_id").alias("_class"), F.min("doc_id").alias("copy_of"))
    classes = written(classes, "classes")
    one_each = classes.select(F.col("_class").alias("_id"))
    small = is_small(one_each)
    reps = sets.where("n > 0").join(F.broadcast(one_each) if small else one_each, "_id", "left_semi").select("_id", "n", "mins")
    reps = written(reps, "class-minima")

    near = components(candidates(reps.select("_id", "mins")))
    n_near = near.count()
    sized = near.join(reps.select(F.col("_id").alias("node"), "n"), "node")
    sizes = gathered(sized.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("hashes")), n_near)
    members = gathered(sized.join(sizes, "root"), n_near).select(
        F.col("node").alias("_id"), F.col("root").alias("_root"), "n",
        F.greatest(F.ceil(F.col("size") / MEMBERS), F.ceil(F.col("hashes") / HASHES)).cast("int").alias("blocks"),
    ).withColumn("block", F.pmod(F.xxhash64("_id"), F.col("blocks").cast("bigint")).cast("int"))
    members = written(members, "members")
    checked = compared_exactly(docs, members, reps)

    links = checked.where("b IS NULL").groupBy(F.col("a").alias("_class")).agg(F.sum("links").alias("n_links"))
    trees = components(checked.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "_class")
    linked = classes.join(links, "_class", "left").join(trees, "_class", "left").select(
        "class_a", "class_b", "copy_of", F.coalesce("n_links", F.lit(0)).alias("n_links"), "root",
    )
    least = linked.where("root IS NOT NULL").groupBy("root").agg(F.min("copy_of").alias("_least"))
    final = linked.join(least, "root", "left").select(
        "class_a", "class_b", "copy_of", "n_links", F.coalesce("_least", "copy_of").alias("class_id")
    )
    final = written(final, "final-classes")
    removed(reps, members, checked, classes)
    return sets.select("_id", "doc_id", "n", "class_a", "class_b").join(
        F.broadcast(final) if small else final, ["class_a", "class_b"]
    ).select("doc_id", "class_id", "n_links", "copy_of", F.col("n").alias("n_shingles"), "_id")


def kept_documents(docs: DataFrame) -> DataFrame:
    """One document of each class: the one with the least id; rows that share that id, the first of them."""
    found = joined(docs)
    first = found.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "_id"))["_id"].alias("_id"))
    gone = written(found.select("_id").join(first, "_id", "left_anti"), "near-copies")
    return (
        docs.withColumn("_id", F.monotonically_increasing_id())
        .join(broadcast_if_small(gone), "_id", "left_anti")
        .select(*docs.columns)
    )
