"""Prefix trie of conversations that share heads, by composable fingerprints.

A rebuilt conversation is the first turns of its base conversation followed by its own turns after as many. It
is never laid out: a sequence of turns has the fingerprint sum(t[i] * B^i) in three prime fields, and a
concatenation's fingerprint follows from those of its parts, F(x + y) = F(x) + B^len(x) * F(y). So all prefixes of
a conversation as stored give those of the rebuilt one by a + m * F, with two numbers a conversation that
hold its base's head and cut its own. The same rule joins the parts of one long conversation that lie in several
partitions.

Nodes are groups of equal depth and fingerprint. A group is verified by what its members refer to, the
stored turns: their content hashes must agree in each group, and where a group has several stored turns, their roles
and texts are compared too. As the last turns of each group are equal, and with them their parents' fingerprints,
the sequences are equal by induction. Should a group fail, the whole is done again with other bases.

Sums over subtrees need no walk over levels. The members that own a node, as the smallest of it, own the rest of
their path too; so a subtree is the owner's own rest, and all that the other members own.
"""

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quality_probe.llm.crc_sql import CRC_TABLE, crc32
from quality_probe.llm.packing import running
from quality_probe.scratch import written

# Fixed values of the contract.
BLOCK = 100  # conversations with one base
HEADS = 6  # a head has fewer turns

PRIMES = (2147483647, 2147483629, 2147483587)  # the largest ones below 2^31
FIELDS = range(len(PRIMES))
PRINTS = [f"f{i}" for i in FIELDS]
NODE = ["depth", *PRINTS]
EXPONENT_BITS = 40
ATTEMPTS = 8
IDS = 1 << 14  # conversation numbers joined in one row
STRETCH = 1 << 10  # depths summed in one task
SALTS = 16  # shares of a node that many turns refer to


class Fields:
    """The bases of an attempt, and SQL for arithmetic in each field."""

    def __init__(self, attempt: int):
        drawn = random.Random(1000 + attempt)
        self.seed = attempt
        self.bases = [drawn.randrange(1 << 20, p - 1) for p in PRIMES]

    def power(self, i: int, exponent: str) -> str:
        squares = ", ".join(f"{pow(self.bases[i], 1 << k, PRIMES[i])}L" for k in range(EXPONENT_BITS))
        bit = f"shiftright({exponent}, k) % 2 = 1"
        return (f"aggregate(sequence(0, {EXPONENT_BITS - 1}), 1L, (acc, k) -> "
                f"CASE WHEN {bit} THEN acc * element_at(array({squares}), k + 1) % {PRIMES[i]} ELSE acc END)")

    def backward(self, i: int, steps: str) -> str:
        """The inverse power of the base for less than HEADS steps."""
        values = ", ".join(f"{pow(self.bases[i], -k, PRIMES[i])}L" for k in range(HEADS))
        return f"element_at(array({values}), cast({steps} AS int) + 1)"


def contents(conversations: DataFrame, seed: int) -> DataFrame:
    """The turns with two content hashes; rows without a conv_id belong to no conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"),
        F.xxhash64(F.lit(seed), role, text).alias("x1"), F.xxhash64(text, F.lit(seed), role).alias("x2"),
    )


# --- prefixes of the stored conversations --------------------------------------------------------


def powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    out, square, left = np.ones(len(exponents), np.int64), base, exponents
    while left.any():
        out = np.where(left & 1, out * square % prime, out)
        square, left = square * square % prime, left >> 1
    return out


def prefix_prints(batches, bases: list):
    """Number the turns of each conversation within a sorted partition, and add the prefixes' fingerprints."""
    conv, count, sums = None, 0, [0] * len(PRIMES)  # of the conversation that the last batch ended in
    for batch in batches:
        ids = batch.column("conv_id").to_numpy()
        if not len(ids):
            continue
        goes_on = ids[0] == conv
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
        index = np.arange(len(ids)) - starts[group]
        index[group == 0] += count if goes_on else 0
        x1, x2 = (batch.column(c).to_numpy() for c in ("x1", "x2"))
        made = {"number": index + 1}
        for i in FIELDS:
            terms = np.mod((x1, x2, x1 ^ x2)[i], PRIMES[i]) * powers(bases[i], index, PRIMES[i]) % PRIMES[i]
            total = np.cumsum(terms)
            total -= (total - terms)[starts][group]
            total[group == 0] += sums[i] if goes_on else 0
            made[PRINTS[i]] = total % PRIMES[i]
        conv, count, sums = ids[-1], int(index[-1]) + 1, [int(made[f][-1]) for f in PRINTS]
        kept = {name: batch.column(name) for name in batch.schema.names}
        yield pa.RecordBatch.from_pydict(kept | {n: pa.array(v) for n, v in made.items()})


def stored_prefixes(turns: DataFrame, fields: Fields) -> DataFrame:
    """conv_id, number, chars, x1, x2, f0.. of each turn: its number in the conversation, the prefix that it ends.

    Turns are ordered by turn (null first), then by role and content hash. One range of the order is a slice, so a
    conversation of any length spreads over tasks; where it goes on in another slice, its slices are joined by
    the concatenation rule.
    """
    order = ["conv_id", "turn", "role", "x1", "x2"]
    narrow = turns.select(*order, F.char_length("text").alias("chars"))
    sliced = narrow.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", F.spark_partition_id().alias("slice"), "chars", "x1", "x2"
    )
    shape = "conv_id bigint, slice int, chars int, x1 bigint, x2 bigint, number bigint, " + ", ".join(
        f"{f} bigint" for f in PRINTS
    )
    bases = fields.bases
    parts = written(sliced.mapInArrow(lambda batches: prefix_prints(batches, bases), shape), "turn-slices")
    ends = parts.groupBy("conv_id", "slice").agg(
        F.max("number").alias("rows"), *[F.max_by(f, "number").alias(f) for f in PRINTS]
    )
    before = "OVER (PARTITION BY conv_id ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    shifted = ends.selectExpr("*", f"coalesce(sum(rows) {before}, 0L) AS shift").selectExpr(
        "*", *[f"{fields.power(i, 'shift')} AS p{i}" for i in FIELDS]
    )
    joined = shifted.selectExpr(
        "conv_id", "slice", "shift", *[f"p{i}" for i in FIELDS],
        *[f"sum(p{i} * f{i} % {PRIMES[i]}) {before} % {PRIMES[i]} AS b{i}" for i in FIELDS],
    )
    later = joined.filter("shift > 0")  # one for each border of slices at most
    return parts.join(F.broadcast(later), ["conv_id", "slice"], "left").selectExpr(
        "conv_id", "number + coalesce(shift, 0L) AS number", "chars", "x1", "x2",
        *[f"coalesce((b{i} + p{i} * f{i} % {PRIMES[i]}) % {PRIMES[i]}, f{i}) AS f{i}" for i in FIELDS],
    )


# --- rebuilt conversations -----------------------------------------------------------------------


def recipes(prefixes: DataFrame, fields: Fields) -> DataFrame:
    """conv_id, base, cut, size, a0.., m0.., head: how each conversation is rebuilt from stored prefixes.

    `head` has the prefixes taken from the base, `cut` is the number of own turns that they replace, `size` the
    number of turns of the rebuilt one; the own prefix F ends the rebuilt prefix a + m * F.
    """
    start = F.struct("number", *PRINTS, "x1", "x2", "chars")
    convs = written(
        prefixes.groupBy("conv_id").agg(
            F.max("number").alias("turns"),
            F.sort_array(F.collect_list(F.when(F.col("number") < HEADS, start))).alias("starts"),
        ),
        "conversations",
    )
    with_base = convs.withColumn("base", F.expr(f"conv_id - conv_id % {BLOCK}"))
    bases = convs.select(
        F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"), F.col("starts").alias("base_starts")
    )
    sized = with_base.join(bases, "base", "left").selectExpr(
        "*", f"cast(crc32(cast(cast(conv_id AS string) AS binary)) % {HEADS} AS int) AS cut"
    ).selectExpr("*", "cast(least(cut, coalesce(base_turns, 0)) AS int) AS taken").selectExpr(
        "*",
        "CASE WHEN taken > 0 THEN slice(base_starts, 1, taken) ELSE slice(starts, 1, 0) END AS head",
        *[f"{fields.backward(i, 'cut - taken')} AS m{i}" for i in FIELDS],
    )

    def start_print(i: int) -> str:
        own = f"CASE WHEN cut > 0 AND turns >= cut THEN get(starts, cut - 1).f{i} ELSE 0 END"
        return f"pmod(coalesce(get(head, taken - 1).f{i}, 0) - m{i} * ({own}) % {PRIMES[i]}, {PRIMES[i]}) AS a{i}"

    return written(
        sized.selectExpr(
            "conv_id", "base", "cut", "taken", "taken + greatest(turns - cut, 0) AS size", "head",
            *[f"m{i}" for i in FIELDS], *[start_print(i) for i in FIELDS],
        ),
        "recipes",
    )


def memberships(prefixes: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, depth, f0.., x1, x2, chars, stored, last: each rebuilt conversation at each of its depths but 0.

    `stored` marks one membership for each stored turn in use.
    """
    columns = ["x1", "x2", "chars"]
    heads = found.selectExpr("conv_id", "base", "size", "inline(head)").selectExpr(
        "conv_id", "number AS depth", *PRINTS, *columns, "conv_id = base AS stored", "number = size AS last"
    )
    own = prefixes.join(found.drop("head", "base"), "conv_id").filter("number > cut").selectExpr(
        "conv_id", "taken + number - cut AS depth",
        *[f"(a{i} + m{i} * f{i} % {PRIMES[i]}) % {PRIMES[i]} AS f{i}" for i in FIELDS], *columns,
        "true AS stored", "taken + number - cut = size AS last",
    )
    return heads.unionByName(own)


# --- nodes ---------------------------------------------------------------------------------------


def nodes_of(members: DataFrame, found: DataFrame) -> DataFrame:
    """One row per node, the root included, with its owner `conv_id` and the first of its ends."""
    ends_here = F.min(F.when(F.col("last"), F.col("conv_id"))).alias("first_end")
    grouped = members.groupBy(*NODE).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), ends_here, F.max("chars").alias("chars"),
        F.count_if("stored").alias("turns"),
        *[f(c).alias(f"{f.__name__}_{c}") for c in ("x1", "x2") for f in (F.min, F.max)],
    )
    root = found.agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.min(F.when(F.col("size") == 0, F.col("conv_id"))).alias("first_end"),
    ).filter("n_convs > 0").selectExpr("0L AS depth", *[f"0L AS {f}" for f in PRINTS], "*", "0 AS chars", "0L AS turns")
    return written(grouped.unionByName(root, allowMissingColumns=True), "nodes")


def is_verified(nodes: DataFrame, members: DataFrame, turns: DataFrame) -> bool:
    """Whether all members of each node end in the same role and text."""
    if not nodes.filter("min_x1 <> max_x1 OR min_x2 <> max_x2").isEmpty():
        return False
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    shared = nodes.filter("turns > 1").select(*NODE, salts)
    salted = members.filter("stored").select("*", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int").alias("salt"))
    referring = salted.join(shared, [*NODE, "salt"]).select("conv_id", "x1", "x2", *NODE)
    said = F.struct("role", "text")
    compared = turns.join(referring, ["conv_id", "x1", "x2"]).groupBy(*NODE).agg(
        F.min(said).alias("least"), F.max(said).alias("greatest")
    )
    return compared.filter("least <> greatest").isEmpty()


def joined_ids(batches):
    """Runs of up to IDS sorted conversation numbers of one node, joined by commas."""
    node, ids = None, []

    def row():
        return [*node, ids[0], ",".join(map(str, ids))]

    for batch in batches:
        rows = []
        for *key, conv in zip(*[batch.column(c).to_pylist() for c in (*NODE, "conv_id")], strict=True):
            if key != node or len(ids) == IDS:
                if ids:
                    rows.append(row())
                node, ids = key, []
            ids.append(conv)
        if rows:
            yield listed(rows, [*NODE, "first", "ids"])
    if ids:
        yield listed([row()], [*NODE, "first", "ids"])


def hashed_ids(batches):
    """SHA-256 of all ids of each node, whose runs come in order."""
    node, state = None, None
    for batch in batches:
        rows = []
        for *key, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")], strict=True):
            if key != node:
                if state:
                    rows.append([*node, state.hexdigest()])
                node, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if rows:
            yield listed(rows, [*NODE, "ends_sha256"])
    if state:
        yield listed([[*node, state.hexdigest()]], [*NODE, "ends_sha256"])


def listed(rows: list, names: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))


def ends(members: DataFrame, found: DataFrame) -> DataFrame:
    """NODE, ends_sha256 of each node where conversations end.

    Numbers are joined in slices of their order; only the joined runs of a node meet in one task, as a stream.
    """
    here = members.filter("last").select(*NODE, "conv_id").unionByName(
        found.filter("size = 0").selectExpr("0L AS depth", *[f"0L AS {f}" for f in PRINTS], "conv_id")
    )
    keys = ", ".join(f"{c} bigint" for c in NODE)
    order = [*NODE, "conv_id"]
    joined = here.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        joined_ids, f"{keys}, first bigint, ids string"
    )
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(
        hashed_ids, f"{keys}, ends_sha256 string"
    )


def tops(nodes: DataFrame, fields: Fields) -> DataFrame:
    """conv_id, depth, up and u0..: the first node that each owner owns, and the NODE key of its parent."""
    first = nodes.groupBy("conv_id").agg(
        F.min_by(F.struct(*NODE, "min_x1", "min_x2"), "depth").alias("top")
    ).selectExpr("conv_id", "top.*", "top.depth - 1 AS up").filter("depth > 0")

    def parent(i: int) -> str:
        turn = f"pmod({('min_x1', 'min_x2', 'min_x1 ^ min_x2')[i]}, {PRIMES[i]})"
        return f"pmod(f{i} - {turn} * {fields.power(i, 'up')} % {PRIMES[i]}, {PRIMES[i]}) AS u{i}"

    return written(first.selectExpr("conv_id", "depth", "up", *map(parent, FIELDS)), "tops")


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node.

    Null roles and texts are empty; rows without a conv_id belong to no conversation; turns of equal number are
    ordered by role, then by content hash; equal rows are turns each; an empty table has no node. Columns other
    than conv_id, turn, role and text are not read. The base of a negative number is the next multiple towards zero.
    """
    for attempt in range(ATTEMPTS):
        fields = Fields(attempt)
        turns = contents(conversations, fields.seed)
        prefixes = written(stored_prefixes(turns, fields), "prefixes")
        found = recipes(prefixes, fields)
        members = written(memberships(prefixes, found), "memberships")
        nodes = nodes_of(members, found)
        if is_verified(nodes, members, turns):
            return described(nodes, members, found, fields)
    raise RuntimeError(f"fingerprints collided in {ATTEMPTS} attempts")


def described(nodes: DataFrame, members: DataFrame, found: DataFrame, fields: Fields) -> DataFrame:
    first = tops(nodes, fields)
    up = [F.col("up").alias("depth"), *[F.col(f"u{i}").alias(f"f{i}") for i in FIELDS]]
    attached = first.select(*up).groupBy(*NODE).agg(F.count("*").alias("attached"))
    # an owner's path goes on below a node unless it ends there
    children = "coalesce(attached, 0L) + if(first_end <=> conv_id, 0L, 1L) AS n_children"
    known = written(
        nodes.join(attached, NODE, "left").selectExpr(
            *NODE, "conv_id", "n_convs", children, "(n_convs - 1) * chars AS saved"
        ),
        "known-nodes",
    )
    owners = known.groupBy("conv_id").agg(
        F.min("depth").alias("top"), F.sum("saved").alias("saved"),
        F.count_if(F.col("n_children") == 0).alias("leaves"),
    ).filter("saved > 0 OR leaves > 0")
    passed = members.select("conv_id", *NODE).unionByName(
        found.selectExpr("conv_id", "0L AS depth", *[f"0L AS {f}" for f in PRINTS])
    )
    others = passed.join(owners, "conv_id").filter("depth < top").groupBy(*NODE).agg(
        F.sum("saved").alias("others_saved"), F.sum("leaves").alias("others_leaves")
    )
    own_leaves = owners.filter("leaves > 0").select("conv_id", F.lit(1).cast("long").alias("own_leaf"))
    # below nodes of one member nothing is saved
    deeper = running(
        known.filter("n_convs > 1").select("conv_id", "depth", "saved"), ["conv_id"],
        F.expr(f"- (depth div {STRETCH})"), [F.desc("depth")], "saved", "deeper",
    ).selectExpr("conv_id", "depth", "deeper + saved AS own_saved")
    parents = first.join(
        known.select(*[F.col(c).alias(f"_{c}") for c in NODE], F.col("conv_id").alias("above")),
        [F.col("up") == F.col("_depth"), *[F.col(f"u{i}") == F.col(f"_f{i}") for i in FIELDS]],
    ).select("conv_id", "depth", "above")
    below = known.join(others, NODE, "left").join(ends(members, found), NODE, "left")
    whole = below.join(deeper, ["conv_id", "depth"], "left").join(parents, ["conv_id", "depth"], "left").join(
        own_leaves, "conv_id", "left"
    )
    nothing = hashlib.sha256(b"").hexdigest()
    return whole.selectExpr(
        "conv_id", "depth", "coalesce(above, CASE WHEN depth > 0 THEN conv_id END) AS parent_conv_id", "n_convs",
        "n_children", "coalesce(own_leaf, 0L) + coalesce(others_leaves, 0L) AS n_leaves",
        "coalesce(own_saved, 0L) + coalesce(others_saved, 0L) AS saved_tokens",
        f"coalesce(ends_sha256, '{nothing}') AS ends_sha256",
    )


def trie_sql() -> str:
    """The rows of `trie` in DuckDB SQL, with every rebuilt conversation laid out and all its prefixes hashed."""
    return f"""
WITH {CRC_TABLE},
turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS number
    FROM conversations WHERE conv_id IS NOT NULL
),
counted AS (SELECT conv_id, max(number) AS turns FROM turns GROUP BY conv_id),
convs AS (
    SELECT conv_id, turns, conv_id - conv_id % {BLOCK} AS base, {crc32("conv_id::VARCHAR")} % {HEADS} AS cut
    FROM counted, crc_table
),
sized AS (SELECT c.*, least(cut, coalesce(b.turns, 0)) AS taken FROM convs c LEFT JOIN counted b ON b.conv_id = c.base),
rebuilt AS (
    SELECT s.conv_id, number AS depth, role, text FROM sized s JOIN turns t ON t.conv_id = base AND number <= cut
    UNION ALL
    SELECT conv_id, taken + number - cut, role, text FROM sized JOIN turns USING (conv_id) WHERE number > cut
),
paths AS (
    SELECT conv_id, depth, text,
        sha256(string_agg(sha256(role || chr(31) || text), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS path
    FROM rebuilt
    UNION ALL SELECT conv_id, 0, '', '' FROM convs
),
members AS (
    SELECT *, lag(path) OVER walk AS above, depth = max(depth) OVER (PARTITION BY conv_id) AS last
    FROM paths WINDOW walk AS (PARTITION BY conv_id ORDER BY depth)
),
nodes AS (
    SELECT path, depth, min(conv_id) AS conv_id, min(above) AS above, count(*) AS n_convs,
        (count(*) - 1) * max(length(text)) AS saved,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
    FROM members GROUP BY path, depth
),
attached AS (SELECT above AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY above),
known AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN attached USING (path)),
subtrees AS (
    SELECT m.path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
    FROM known k JOIN members m ON m.conv_id = k.conv_id AND m.depth <= k.depth GROUP BY m.path
)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, k.ends_sha256
FROM known k JOIN subtrees USING (path) LEFT JOIN known p ON p.path = k.above AND k.depth > 0
"""
