"""Near-duplicate documents by HyperMinHash registers, bands and verification.

A document is the set of its word shingles (words split at white space, A-Z as
a-z).  Two documents are linked if 100 * shared >= 80 * united.

1. Equal sets are folded to one node before anything is compared, so
   thousands of copies count as one node.
2. A set's hashes fall into ``REGISTERS`` buckets.  A register keeps the least
   value of its bucket as leading-zero count (6 bits) and mantissa (10 bits); an
   empty one borrows from the first filled bucket of its own fixed order.
3. ``BANDS`` bands of ``ROWS`` registers are shuffled.  A bucket first offers
   each node with its first one, which connects most of a large group at a cost
   that grows with its size.  Buckets that still hold several components then
   compare registers across them, and small sets at once; of large ones each node
   offers its best partners, then all (``LIMITS``).  In the end every pair of a
   bucket was tested, or ruled out by its estimate, or its ends are connected
   anyway.
4. Of a pair across components with a large set, one whose registers agree in a
   share five standard errors below the threshold is dropped.  All others, and
   every pair of small sets, are decided on the full sets.
5. Verified links are joined to components by smallest label and pointer jumping.

A link of similarity 0.8 between large sets misses all bands with a probability
of 2.9 in a million; where it is left to the estimate, that drops it with 1.0 in a
million, together at most 3.9.  A closer one is missed far less often.

Defined results: a NULL or blank text has no shingle, is linked with nothing and
stays.  A text with fewer words than a shingle has one shingle, all its words.
Rows with a NULL doc_id are linked with nothing, get a NULL component and stay.
Rows that share a doc_id share a component.  Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditrank.llm.components import components
from auditrank.llm.frames import packed, rows, tidy, unpack, unused
from auditrank.llm.words import NOT_SPACE, blocks, hash_words, mix, per_row, texts
from auditrank.operators.ordering import numbered
from auditrank.session import stage

THRESHOLD_PERCENT = 80
#: Words of a shingle where no contract says otherwise.
SHINGLE = 5
REGISTER_BITS = 8
REGISTERS = 1 << REGISTER_BITS
MANTISSA_BITS = 10
BANDS, ROWS = 42, 6
#: Partners that a node offers per bucket and round across components.
LIMITS = (8, None)
#: Sets of so many hashes at most travel with their nodes and are compared at once.
SMALL_SET = 512
#: Standard errors below the threshold from which an estimate rules a pair out.
SIGMAS = 5.0
#: Nodes of a block, about, of a bucket that is compared across components.
BLOCK_NODES = 1_024
#: Sets whose shared hashes are counted against a part of the outside at once.
COUNTED = 256
#: Hashes of sets that a verifying worker remembers.
HELD_HASHES = 4_000_000
#: Chance that two unequal minima give the same register (Yu and Weber 2017).
_COLLISION = 0.169919487159739093975315012348 / 2**MANTISSA_BITS


def shingle_sets(data: np.ndarray, cuts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and where each row's begin."""
    at, found = hash_words(data, cuts, NOT_SPACE)
    bounds = per_row(at, cuts)
    count = np.diff(bounds)
    rolled = found.copy()
    for k in range(1, words):
        rolled[:-k] = mix(rolled[:-k] + np.uint64(0x9E3779B97F4A7C15)) ^ found[k:] if len(found) > k else rolled[:-k]
    rolled = mix(rolled)
    out, sizes = [], []
    for i, (a, n) in enumerate(zip(bounds.tolist(), count.tolist())):
        if n >= words:
            own = np.sort(rolled[a : a + n - words + 1])
            own = own[np.append(True, own[1:] != own[:-1])]
        elif n:
            value = np.uint64(n)
            for h in found[a : a + n]:
                value = mix(np.array([value ^ h], np.uint64))[0]
            own = np.array([value], np.uint64)
        else:
            own = found[:0]
        out.append(own)
        sizes.append(len(own))
    return (np.concatenate(out) if out else found[:0]), np.append(0, np.cumsum(sizes)).astype(np.int64)


@cache
def _orders() -> tuple[np.ndarray, np.ndarray]:
    """For each register the fixed order of buckets to borrow from, and its inverse."""
    draw = np.random.Generator(np.random.PCG64(7)).random((REGISTERS, REGISTERS))
    order = np.argsort(draw, axis=1).astype(np.int64)
    place = np.argsort(order, axis=1).astype(np.int32)
    return order, place


def registers(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of registers per non-empty set; sets are sorted and distinct."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    bucket = (hashes >> np.uint64(64 - REGISTER_BITS)).astype(np.int64)
    slot = owner * REGISTERS + bucket
    least = np.flatnonzero(np.diff(slot, prepend=-1))
    value = hashes[least] << np.uint64(REGISTER_BITS)
    # log2 of the value rounded down, from its upper 53 bits, which a double holds.
    high = value >> np.uint64(11)
    log = np.frexp(high.astype(np.float64))[1]
    zeros = np.minimum(53 - log, 53)
    shifted = high << np.minimum(zeros + 1, 63).astype(np.uint64)
    mantissa = (shifted >> np.uint64(53 - MANTISSA_BITS)) & np.uint64((1 << MANTISSA_BITS) - 1)
    filled = np.zeros(n * REGISTERS, bool)
    filled[slot[least]] = True
    out = np.zeros(n * REGISTERS, np.uint16)
    out[slot[least]] = (zeros.astype(np.uint64) << np.uint64(MANTISSA_BITS) | mantissa).astype(np.uint16)
    filled, out = filled.reshape(n, REGISTERS), out.reshape(n, REGISTERS)
    order, place = _orders()
    row, column = np.nonzero(~filled)
    for step in range(12):
        if not len(row):
            break
        source = order[column, step]
        good = filled[row, source]
        out[row[good], column[good]] = out[row[good], source[good]]
        row, column = row[~good], column[~good]
    # Nearly empty sets: look at the filled buckets instead of along the order.
    start = np.flatnonzero(np.diff(row, prepend=-1))
    for a, b in zip(start.tolist(), [*start[1:].tolist(), len(row)]):
        own = np.flatnonzero(filled[row[a]])
        if len(own):
            chosen = own[place[column[a:b]][:, own].argmin(axis=1)]
            out[row[a], column[a:b]] = out[row[a], chosen]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key per set and band; a band takes every 42nd register."""
    keys = np.zeros((len(regs), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix(keys ^ (regs[:, r * BANDS : (r + 1) * BANDS].astype(np.uint64) + np.uint64(1)))
    return mix(keys + np.arange(BANDS, dtype=np.uint64))


def estimate(one: np.ndarray, two: np.ndarray, size_one: int, size_two: int) -> float:
    """Jaccard from equal registers, less the equal ones expected by collision."""
    ratio = max(size_one, size_two) / max(1, min(size_one, size_two))
    chance = _COLLISION * 4 * ratio / (1 + ratio) ** 2
    same = float(np.count_nonzero(one == two)) / REGISTERS
    return max(0.0, (same - chance) / (1 - chance))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, body, n, set_a, set_b, keys) of every row: hash of its text, size
    and hashes of its set and the keys of its bands; of an empty set the last three
    are NULL."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            for first, last, data, cuts in blocks(texts(batch.column(1))):
                hashes, bounds = shingle_sets(data, cuts, words)
                size = np.diff(bounds)
                given = [batch.column(k).slice(first, last - first) for k in (0, 2)]
                columns = [*given, pa.array(size, pa.int64())]
                for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                    total = np.append(np.uint64(0), np.cumsum(mix(hashes ^ np.uint64(salt))))
                    columns.append(pa.array((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64), mask=size == 0))
                keys = band_keys(registers(hashes, bounds)).view(np.int64)
                starts = np.append(0, np.cumsum(np.where(size > 0, BANDS, 0))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(starts), pa.array(keys[size > 0].ravel())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "body", "n", "set_a", "set_b", "keys"])

    return docs.mapInArrow(tidy(run), "doc_id long, body long, n long, set_a long, set_b long, keys array<long>")


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of buckets with several nodes, with their place in the bucket.

    Rows come sorted by (key, node).  The last row of a batch is held until the
    next one tells whether its bucket goes on.
    """

    def out(key, node, place) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(place)], names=["key", "node", "place"])

    held = [np.zeros(0, np.int64)] * 3
    for batch in rows(batches):
        key, node = (np.append(h, batch.column(k).to_numpy()) for k, h in enumerate(held[:2]))
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        place = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
        if len(held[2]):
            place[: start[1] if len(start) > 1 else None] += held[2][0]
        joined = (place[:-1] > 0) | (key[:-1] == key[1:])
        if joined.any():
            yield out(key[:-1][joined], node[:-1][joined], place[:-1][joined])
        held = [x[-1:] for x in (key, node, place)]
    if len(held[2]) and held[2][0] > 0:
        yield out(*held)


def _to_first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each later node of a bucket with the bucket's first one; rows come sorted."""
    last_key, first = None, 0
    for batch in rows(batches):
        key, node, place = (batch.column(k).to_numpy() for k in range(3))
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        heads = node[start].copy()
        if key[0] == last_key:
            heads[0] = first
        one = np.repeat(heads, np.diff(np.append(start, len(key))))
        last_key, first = key[-1], heads[-1]
        later = one != node
        yield pa.RecordBatch.from_arrays([pa.array(one[later]), pa.array(node[later])], names=["one", "two"])


def _jaccard_reached(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether two sorted sets of hashes are similar enough."""
    if len(one) > len(two):
        one, two = two, one
    at = np.minimum(np.searchsorted(two, one), len(two) - 1)
    shared = int(np.count_nonzero(two[at] == one))
    return 100 * shared >= THRESHOLD_PERCENT * (len(one) + len(two) - shared)


def _links(ones: list, twos: list, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (x, y) whose sets of hashes are similar enough.

    Shared hashes are counted by a matrix product over the hashes of ``ones``.
    """
    own, place = np.unique(x, return_inverse=True)
    if not len(own):
        return x, y
    known = np.unique(np.concatenate([ones[k] for k in own.tolist()]))

    def held(sets: list) -> np.ndarray:
        out = np.zeros((len(sets), len(known)), np.float32)
        flat = np.concatenate(sets)
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        hit = known[at] == flat
        out[np.repeat(np.arange(len(sets)), [len(k) for k in sets])[hit], at[hit]] = 1
        return out

    rows_, good = held([ones[k] for k in own.tolist()]), np.zeros(len(x), bool)
    others, column = np.unique(y, return_inverse=True)
    for part in range(0, len(others), COUNTED):
        chosen = [twos[k] for k in others[part : part + COUNTED].tolist()]
        shared = (rows_ @ held(chosen).T).astype(np.int64)
        here = np.flatnonzero((column >= part) & (column < part + COUNTED))
        both = shared[place[here], column[here] - part]
        total = np.array([len(ones[k]) for k in own.tolist()])[place[here]] + np.array([len(k) for k in chosen])[column[here] - part]
        good[here] = 100 * both >= THRESHOLD_PERCENT * (total - both)
    return x[good], y[good]


def _offer(limit: int | None):
    """Pairs across the components of a bucket that are links or left open.

    Sets of up to ``SMALL_SET`` hashes travel with their nodes: such pairs are
    decided here without an estimate, and of a node's links one to each component
    is handed on as ``sure``, which connects as much as all of them.  Of the others
    that the estimate leaves open a node offers its ``limit`` best; a row without
    ``two`` says that it has more.  A pair is
    looked at in the first of its common bands only.

    Rows (key, left, right, node, component, n, registers, hashes, outside) come
    sorted by key, left, right: nodes outside the bucket's largest component, of
    block ``left``, and nodes of block ``right``.  Two blocks are in memory at once.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in rows(batches):
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            parts = [table.column(k).to_numpy() for k in range(3)]
            cut = int(np.append(0, np.flatnonzero(np.any([p[1:] != p[:-1] for p in parts], axis=0)) + 1)[-1])
            if cut:
                yield from work(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None:
            yield from work(held)

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, left, right, node, group, size = (table.column(k).to_numpy() for k in range(6))
        regs = np.frombuffer(b"".join(table.column(6).to_pylist()), np.uint16).reshape(-1, REGISTERS)
        sets = [None if x is None else np.frombuffer(x, np.uint64) for x in table.column(7).to_pylist()]
        from_outside = table.column(8).to_numpy()
        small = size <= SMALL_SET
        changed = (key[1:] != key[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        start = np.flatnonzero(np.append(True, changed)).tolist()
        sure, open_, more = set(), set(), set()
        for a, b in zip(start, [*start[1:], len(key)]):
            if (group[a:b] == group[a]).all():
                continue
            bands = band_keys(regs[a:b])
            band = int((bands[0].view(np.int64) == key[a]).argmax())
            outside, others = np.flatnonzero(from_outside[a:b]), ~from_outside[a:b]
            for part in range(0, len(outside), 64):
                i = outside[part : part + 64]
                same = (regs[a + i][:, None, :] == regs[None, a:b, :]).sum(2) / REGISTERS
                one, two = size[a + i][:, None], size[None, a:b]
                margin = SIGMAS * np.sqrt(0.16 * (1 / np.maximum(one, two) + 1 / REGISTERS))
                exact = small[a + i][:, None] & small[None, a:b]
                fits = np.where(
                    exact,
                    100 * np.minimum(one, two) >= THRESHOLD_PERCENT * np.maximum(one, two),
                    same >= THRESHOLD_PERCENT / 100 - margin,
                )
                x, y = np.nonzero(fits & (group[a + i][:, None] != group[None, a:b]) & others)
                first = (bands[i[x]] == bands[y]).argmax(1) == band
                x, y = x[first], y[first]
                exact = exact[x, y]
                links = _links([sets[a + k] for k in i.tolist()], sets[a:b], x[exact], y[exact])
                linked = set()
                for u, v in zip((a + i[links[0]]).tolist(), (a + links[1]).tolist()):
                    if (u, group[v]) not in linked:
                        linked.add((u, group[v]))
                        sure.add((min(node[u], node[v]), max(node[u], node[v])))
                x, y = x[~exact], y[~exact]
                order, offered = np.argsort(-same[x, y], kind="stable"), {}
                for u, v in zip((a + i[x[order]]).tolist(), (a + y[order]).tolist()):
                    if limit is None or offered.get(u, 0) < limit:
                        offered[u] = offered.get(u, 0) + 1
                        open_.add((min(node[u], node[v]), max(node[u], node[v])))
                    else:
                        more.add(node[u])
        found = [(one, two, True) for one, two in sure] + [(one, two, False) for one, two in open_]
        found += [(one, None, False) for one in more]
        if found:
            columns = [pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(columns, names=["one", "two", "sure"])

    return run


def _registers_of(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            size, found, held = [], [], []
            for text in batch.column(1):
                raw = np.frombuffer(unpack(text.as_py()), np.uint8)
                hashes, bounds = shingle_sets(raw, np.array([0, len(raw)]), words)
                size.append(len(hashes))
                found.append(registers(hashes, bounds)[0].tobytes())
                held.append(hashes.tobytes() if len(hashes) <= SMALL_SET else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(found, pa.binary()), pa.array(held, pa.binary())],
                names=["node", "n", "registers", "hashes"],
            )

    return run


def _verified(words: int):
    """Keeps the pairs whose full sets are similar enough."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashes(text: bytes) -> np.ndarray:
            raw = np.frombuffer(unpack(text), np.uint8)
            return shingle_sets(raw, np.array([0, len(raw)]), words)[0]

        # Nodes come again with other partners; what is kept of them is bounded.
        held: dict[int, np.ndarray] = {}
        kept = 0
        for batch in rows(batches):
            one, two = (batch.column(k).to_pylist() for k in (0, 1))
            good = np.zeros(len(one), bool)
            for i in range(len(one)):
                if kept > HELD_HASHES:
                    held, kept = {}, 0
                for k, node in ((2, one[i]), (3, two[i])):
                    if node not in held:
                        held[node] = hashes(batch.column(k)[i].as_py())
                        kept += len(held[node])
                good[i] = _jaccard_reached(held[one[i]], held[two[i]])
            if good.any():
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["one", "two"]
                )

    return run


def links(docs: DataFrame, words: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(sets, labels): every row's set with its node and the node's doc_id, and (node,
    component) of the linked nodes, component being the smallest doc_id.

    A node stands for all rows of one set.  Nodes are numbered by their smallest
    doc_id, so the smallest node of a component has its smallest doc_id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("body"))
    sets = stage(_sets(docs, words), "shingle-sets")
    known = sets.where(F.col("set_a").isNotNull() & F.col("doc_id").isNotNull())
    # Of the rows of a set the least stands for it; any of its equals will do.
    least = known.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "body")).alias("_row"))
    least = least.select("set_a", "set_b", F.col("_row.doc_id").alias("node_doc"), F.col("_row.body").alias("node_body"))
    nodes = stage(numbered(least, [F.col(c) for c in ("node_doc", "set_a", "set_b")], "node"), "nodes")
    same = ["set_a", "set_b"]
    keys = known.join(nodes, same).where("doc_id = node_doc AND body = node_body").dropDuplicates(["node"])
    shared = stage(
        keys.select(F.explode("keys").alias("key"), "node").repartition("key").sortWithinPartitions("key", "node")
        .mapInArrow(tidy(_shared), "key long, node long, place long"),
        "bands",
    )
    members = shared.select("node").distinct()
    carried = stage(
        packed(docs.where("text IS NOT NULL"))
        .join(nodes.join(members, "node", "left_semi"), (F.col("doc_id") == F.col("node_doc")) & (F.col("body") == F.col("node_body")))
        .select("node", "text").dropDuplicates(["node"]),
        "texts",
    )
    of_node = known.select("doc_id", *same).join(nodes, same)
    first = of_node.groupBy("doc_id").agg(F.min("node").alias("one"), F.max("node").alias("last")).where("one != last")
    twins = of_node.join(first, "doc_id").where("node != one").select("one", F.col("node").alias("two"))
    found = stage(twins, "links")

    def verify(pairs: DataFrame) -> DataFrame:
        one = carried.select(F.col("node").alias("one"), F.col("text").alias("p1"))
        two = carried.select(F.col("node").alias("two"), F.col("text").alias("p2"))
        both = pairs.join(two, "two").join(one, "one").select("one", "two", "p1", "p2").sortWithinPartitions("one")
        return stage(both.mapInArrow(tidy(_verified(words)), "one long, two long"), "links")

    tested = stage(
        shared.repartition("key").sortWithinPartitions("key", "place").mapInArrow(tidy(_to_first), "one long, two long").distinct(),
        "pairs",
    )
    found = found.unionByName(verify(tested))
    label = components(found)
    for limit in LIMITS:
        open_rows = _open(shared, label)
        sketched = carried.join(open_rows.select("node").distinct(), "node", "left_semi").mapInArrow(
            tidy(_registers_of(words)), "node long, n long, registers binary, hashes binary"
        )
        offered = stage(
            open_rows.join(sketched, "node")
            .select("key", "left", "right", "node", "component", "n", "registers", "hashes", "outside")
            .repartition("key", "left", "right").sortWithinPartitions("key", "left", "right", "node")
            .mapInArrow(tidy(_offer(limit)), "one long, two long, sure boolean").distinct(),
            "pairs",
        )
        sure = offered.where("sure").select("one", "two")
        pairs = stage(offered.where("two IS NOT NULL AND NOT sure").select("one", "two").join(tested, ["one", "two"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            tested = tested.unionByName(pairs)
            found = found.unionByName(verify(pairs))
        found = found.unionByName(sure)
        label = components(found)
        if offered.where("two IS NULL").isEmpty():
            break
    label = label.join(nodes.select(F.col("node").alias("component"), F.col("node_doc").alias("_doc")), "component")
    return sets.drop("keys", "body").join(nodes.drop("node_body"), same, "left"), label.select("node", F.col("_doc").alias("component"))


def _open(shared: DataFrame, label: DataFrame) -> DataFrame:
    """Rows (key, left, right, node, component, outside) of buckets that still hold
    several components.

    Every open pair has an end outside the bucket's largest component.  Those
    nodes and all nodes are each dealt to blocks of about ``BLOCK_NODES``, and each
    block of the one meets each of the other.
    """
    named = shared.join(label, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    counted = named.groupBy("key", "component").agg(F.count("*").alias("_n"))
    several = counted.groupBy("key").agg(
        F.count("*").alias("_components"), F.sum("_n").alias("_all"), F.max(F.struct("_n", "component")).alias("_top")
    )
    # A bucket of two nodes had its only pair tested in the first round.
    several = several.where("_components > 1 AND _all > 2").select(
        "key",
        F.col("_top.component").alias("_largest"),
        F.ceil((F.col("_all") - F.col("_top._n")) / BLOCK_NODES).alias("_lefts"),
        F.ceil(F.col("_all") / BLOCK_NODES).alias("_rights"),
    )
    rows_ = stage(named.join(several, "key"), "bands")
    salt = F.xxhash64("node", F.lit(3))

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    lefts = rows_.where("component != _largest").select(
        "key", F.pmod(salt, "_lefts").alias("left"), every("_rights").alias("right"), "node", "component", F.lit(True).alias("outside")
    )
    rights = rows_.select(
        "key", every("_lefts").alias("left"), F.pmod(salt, "_rights").alias("right"), "node", "component", F.lit(False).alias("outside")
    )
    return lefts.unionByName(rights)


def report(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    sets, label = links(docs, words)
    out = sets.join(label, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node_doc", "doc_id").alias("component_id")
    )
    return out.withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    ).withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def one_of_each(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each component, the one of smallest doc_id.

    Rows equal in doc_id and text are one document and all stay or all go.
    """
    gone = report(docs, words).where(~F.col("kept")).select("doc_id").distinct()
    (name,) = unused(docs, "_gone_id")
    gone = gone.withColumnRenamed("doc_id", name)
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
