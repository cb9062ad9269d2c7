"""N-gram Jaccard join over a token-group matrix.

A document's set holds its distinct word shingles (as 64-bit hashes). Equal sets collapse
to one node. The matrix has a row for each part of a node's set (below); nodes that share a part,
over any number of steps, are a class of similar sets, and a class is a group, or several of
at most about ``LIMIT`` shingles. A group stores the union of its members' tokens. A query can reach the
threshold with a member only if the union holds enough of the query's tokens; that bound is taken
for each query and group that meet, and only groups that pass are opened and their members
compared exactly.

Which sets meet at all follows from the pigeonhole principle, so nothing that links is
left out. Sets of sizes a and b at or above the similarity p/q differ in at most
(a + b)(q - p) / (q + p) tokens. Tokens are dealt by hash into more parts than that, so some part is
equal in both, at the same place with the same tokens. Sizes fall into classes that grow by ``STEP`` and fix the number of parts; a
set near the lower end of its class also asks in the classes below. One spare part allows for a part
without tokens; sets with more empty parts than that list the empty ones as well.

Most documents share no part with another one and go no further. The others meet groups in two
rounds: first their own group and the first group of their class, which joins groups of copies; then only
those groups that hold a part in common with
nodes of another component. A group names its members' components, so a query reports one link
for each of them, not all pairs. Queries that meet a group are dealt in slices of ``LIMIT`` shingles.

Defined cases: NULL, empty and blank texts have no shingles and are linked with nothing; texts of
fewer words than a shingle are one shingle; equal sets are linked; rows with equal ids keep
rows of their own and count as one document only in the component's name; NULL ids
take part, never name a component unless all its ids are NULL, and their own component is NULL if they are linked with nothing;
an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .base import parts_for
from .components import components
from .simhash import shingle_hashes

#: Shingles of a group, and of a slice of the queries that meet it, about.
LIMIT = 200_000
#: Growth of the size classes.
STEP = 1.5
#: Parts' rows that one task sorts, about.
ROWS_PER_TASK = 1_000_000
#: Hash bits of the shared filter of rows that go on (8 MB), a bound at every size.
FILTER_BITS = 1 << 26


def class_of(n: np.ndarray | int) -> np.ndarray:
    """Class i holds the sizes from ceil(STEP ** i) on."""
    bounds = np.array(CLASS_STARTS)
    return np.searchsorted(bounds, n, "right") - 1


CLASS_STARTS = sorted({int(np.ceil(STEP ** i)) for i in range(100)})


def scheme(c: int, p: int, q: int) -> tuple[int, int]:
    """(parts, tokens that may differ) for pairs whose smaller set is of class c."""
    small = CLASS_STARTS[c + 1] - 1
    most = (small + small * q // p) * (q - p) // (q + p)
    return (most + 2 if most else 1), most


def part_keys(tokens: np.ndarray, p: int, q: int) -> np.ndarray:
    """Keys of the parts of a set, for its own class and for those below that hold smaller
    sets which could be similar. ``tokens`` are sorted and distinct."""
    n = len(tokens)
    c = int(class_of(n))
    out = []
    for k in range(c, -1, -1):
        if k < c and (CLASS_STARTS[k + 1] - 1) * q < n * p:
            break  # all sets of that class are too small
        parts, most = scheme(k, p, q)
        if not most:
            continue  # only equal sets, which are one node
        mixed = tokens * np.uint64(0x9E3779B97F4A7C15)
        part = ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")  # inside a part the tokens stay sorted
        place, starts = np.unique(part[order], return_index=True)
        data, ends = tokens[order].tobytes(), [*starts[1:].tolist(), n]
        h = xxhash.xxh64_intdigest
        out += [h(data[8 * a:8 * b], (k << 32) + j) for j, a, b in zip(place.tolist(), starts.tolist(), ends)]
        if parts - len(place) > 1:  # more empty parts than the spare one
            out += [h(b"", (k << 32) + j) for j in np.setdiff1d(np.arange(parts), place).tolist()]
    return np.array(out, np.uint64)


def token_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def profiles(docs: DataFrame, id: str, text: str, size: int, p: int, q: int) -> DataFrame:
    """(id, k1, n, d1, d2, key, parts): text digest, size, digest of the set, group name and
    the part keys as bytes."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            n, d1, d2, key, parts, seen = [], [], [], [], [], {}
            for k, t in zip(rb.column(1).to_pylist(), rb.column(2)):
                if k not in seen:  # copies of a batch are hashed once
                    s = token_set(t.as_py(), size)
                    data = s.tobytes()
                    low = (int(s[0]), int((s * np.uint64(0xD6E8FEB86659FD93)).min())) if len(s) else (0, 0)
                    seen[k] = (len(s), xxhash.xxh64_intdigest(data, 1), xxhash.xxh64_intdigest(data, 2), xxhash.xxh64_intdigest(repr(low)), part_keys(s, p, q).tobytes() if len(s) else b"")
                for held, x in zip((n, d1, d2, key, parts), seen[k]):
                    held.append(x)
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (d1, d2, key)]
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(n, pa.int64()), *longs, pa.array(parts, pa.binary())],
                                             names=["id", "k1", "n", "d1", "d2", "key", "parts"])
    src = docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(text).alias("k1"), F.col(text).alias("text"))
    return src.mapInArrow(batches, "id long, k1 long, n long, d1 long, d2 long, key long, parts binary")


# --- the matrix ------------------------------------------------------------------

def shared_parts(nodes: DataFrame, buckets: int) -> DataFrame:
    """(part, node): the parts that lie in two nodes at least. Parts are dealt by
    their key as packed bytes. Nodes with a frequent pair of minimum hashes (``cut``) are many and
    alike: their parts are reduced to one mark each before they are dealt, and always go on."""
    def packed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            found = [np.frombuffer(x.as_buffer(), np.uint64) for x in rb.column(1)]
            if not sum(map(len, found)):
                continue
            part = np.concatenate(found)
            node = np.repeat(rb.column(0).to_numpy(), [len(f) for f in found])
            bucket = (part % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            names, starts = np.unique(bucket[order], return_index=True)
            ends = [*starts[1:].tolist(), len(order)]
            cols = [[c[order][a:b].tobytes() for a, b in zip(starts.tolist(), ends)] for c in (part, node)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *[pa.array(c, pa.binary()) for c in cols]], names=["bucket", "part", "node"])

    def repeated(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[], []]
        for rb in rows:
            for h, c in zip(held, rb.columns[1:]):
                h += c.to_pylist()
        part, node = (np.frombuffer(b"".join(h), t) for h, t in zip(held, ("<u8", "<i8")))
        if not len(part):
            return
        order = np.argsort(part, kind="stable")
        part, node = part[order], node[order]
        new = np.r_[True, part[1:] != part[:-1]]
        many = np.diff(np.r_[np.flatnonzero(new), len(part)])
        keep = np.flatnonzero((np.repeat(many, many) > 1) & (node >= 0))
        for a in range(0, len(keep), 100_000):
            at = keep[a:a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part[at].view(np.int64)), pa.array(node[at])], names=["part", "node"])

    def listed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            found = [np.frombuffer(x.as_buffer(), np.int64) for x in rb.column(1)]
            if sum(map(len, found)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.repeat(rb.column(0).to_numpy(), [len(f) for f in found]))], names=["part", "node"])
    row = "part long, node long"
    cut = nodes.filter("cut").select("node", "parts").mapInArrow(listed, row)
    marks = cut.select("part").distinct().select(F.lit(-1).cast("long").alias("node"), _bytes("part").alias("parts"))
    rare = nodes.filter("NOT cut").select("node", "parts").unionByName(marks)
    found = rare.mapInArrow(packed, "bucket int, part binary, node binary").repartition(buckets, "bucket").mapInArrow(repeated, row)
    return found.unionByName(cut)


def _bytes(c: str):
    """A long as eight little-endian bytes."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(F.col(c), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(8)]))


def row_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of ``FILTER_BITS`` bits with two bits a key. It only saves shuffling
    rows that go no further; a full one lets all pass, and the join decides."""
    bit = F.explode(F.array(*[F.pmod(F.xxhash64("k", F.lit(i)), F.lit(FILTER_BITS)) for i in range(2)]))
    words = keys.select(bit.alias("b")).groupBy(F.expr("b div 32").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 32 as int))")).alias("x"))
    held = np.zeros(FILTER_BITS // 32, np.uint32)
    rows = words.toArrow()  # two million words at most
    held[rows.column("w").to_numpy()] = rows.column("x").to_numpy().astype(np.uint32)
    return held


def passing(docs: DataFrame, held: np.ndarray) -> DataFrame:
    """docs (id, k1, k, b0, b1, text): the rows whose key may be one of the filter's."""
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for rb in rows:
            ok = np.ones(rb.num_rows, bool)
            for c in (2, 3):
                b = rb.column(c).to_numpy()
                ok &= (bits[b // 32] >> (b % 32).astype(np.uint32)) & 1 == 1
            yield rb.filter(pa.array(ok))
    return docs.mapInArrow(batches, docs.schema)


def member_sets(docs: DataFrame, active: DataFrame, id: str, text: str, size: int) -> DataFrame:
    """(node, g, first, n, tokens): the sets of the nodes that share a part, from their texts."""
    key = F.xxhash64(F.col(id).cast("long"), F.xxhash64(text))
    held = row_filter(active.select(F.xxhash64("rep", "k1").alias("k")))
    places = [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(FILTER_BITS)).alias(f"b{i}") for i in range(2)]
    src = passing(docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(text).alias("k1"), *places, F.col(text).alias("text")), held).drop("b0", "b1")
    # sorted and merged at every size, so that its cost is known from small tables
    joined = src.join(active.select("node", "g", "first", "rep", F.col("k1").alias("_k1")).hint("merge"), F.col("id").eqNullSafe(F.col("rep")) & (F.col("k1") == F.col("_k1")))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            sets = [token_set(t.as_py(), size) for t in rb.column(3)]
            yield pa.RecordBatch.from_arrays([*rb.columns[:3], pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                                             names=["node", "g", "first", "n", "tokens"])
    # rows equal in id and text are several for one node; the filter on the digest is exact
    return joined.select("node", "g", "first", "text").mapInArrow(batches, "node long, g long, first long, n long, tokens binary")


# --- opening groups ----------------------------------------------------------------

class Group:
    """Members of a group with their token union and, inside, a list of members by token."""

    def __init__(self, nodes: list[int], sets: list[np.ndarray], p: int, q: int):
        self.p, self.q, self.nodes, self.sizes = p, q, nodes, np.array([len(s) for s in sets])
        self.union, code = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(code, kind="stable")
        self.members, self.starts = owner[order], np.r_[0, np.cumsum(np.bincount(code, minlength=len(self.union)))]
        self.component = np.full(len(sets), -1)

    def bound(self, tokens: np.ndarray) -> np.ndarray | None:
        """Codes of the query's tokens in the union, if they are enough for any member."""
        at = np.searchsorted(self.union, tokens)
        at[at == len(self.union)] = 0
        codes = at[self.union[at] == tokens]
        return codes if len(codes) * self.q >= self.p * len(tokens) else None

    def hits(self, codes: np.ndarray, size: int) -> np.ndarray:
        """Members at or above the similarity, exactly."""
        common = np.bincount(np.concatenate([self.members[self.starts[c]:self.starts[c + 1]] for c in codes.tolist()]), minlength=len(self.sizes))
        return np.flatnonzero(self.q * common >= self.p * (size + self.sizes - common))

    def forest(self, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """Links between members that join all that can be joined; names the components."""
        edges = []
        for start in range(len(sets)):
            if self.component[start] >= 0:
                continue
            self.component[start], queue = start, [start]
            while queue:
                at = queue.pop()
                codes = self.bound(sets[at])
                found = self.hits(codes, len(sets[at])) if codes is not None else np.zeros(0, int)
                new = found[self.component[found] < 0]
                self.component[new] = start
                edges += [(self.nodes[at], self.nodes[i]) for i in new.tolist()]
                queue += new.tolist()
        return edges

    def links(self, node: int, tokens: np.ndarray) -> list[tuple[int, int]]:
        """One link for each component that the query is linked with."""
        codes = self.bound(tokens)
        if codes is None or not len(codes):
            return []
        found = self.hits(codes, len(tokens))
        first = np.unique(self.component[found], return_index=True)[1]
        return [(node, self.nodes[i]) for i in found[first].tolist()]


def to_first(sets: DataFrame) -> DataFrame:
    """The queries of the first round: sets outside the first group of their class meet that group.
    The sets' own rows tell, so their tokens are not moved to be joined."""
    return sets.filter("g <> first").select("node", F.col("first").alias("g"), "n", "tokens")


def opened(sets: DataFrame, asked: DataFrame, p: int, q: int, inside: bool) -> DataFrame:
    """(a, b): links of the queries ``asked`` (node, g, n, tokens) with members of those groups, and
    links inside these groups (``inside``: inside all). A group's queries are cut into slices,
    each of which gets the members."""
    slices = written(asked.groupBy("g").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / LIMIT)).cast("int").alias("slices")))
    queries = asked.join(slices, "g").select("g", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int").alias("s"), F.lit(1).alias("role"), "node", "tokens")
    last = F.coalesce("slices", F.lit(1)) - 1
    members = sets.join(slices, "g", "left" if inside else "inner").select("g", F.explode(F.sequence(F.lit(0), last)).alias("s"), F.lit(0).alias("role"), "node", "tokens")
    dealt = members.unionByName(queries).repartition("g", "s").sortWithinPartitions("g", "s", "role")

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, nodes, sets, group = None, {}, [], None
        for rb in rows:
            out = []
            for g, s, role, node, tokens in zip(*(c.to_pylist() for c in rb.columns)):
                if (g, s) != name:
                    if group is None and len(nodes) > 1:
                        out += Group(list(nodes), sets, p, q).forest(sets)
                    name, nodes, sets, group = (g, s), {}, [], None
                tokens = np.frombuffer(tokens, np.uint64)
                if role == 0:
                    if node not in nodes:
                        nodes[node] = True
                        sets.append(tokens)
                    continue
                if group is None and nodes:
                    group = Group(list(nodes), sets, p, q)
                    out += group.forest(sets)
                if group is not None and node not in nodes:
                    out += group.links(node, tokens)
            yield _edges(out)
        if group is None and len(nodes) > 1:
            yield _edges(Group(list(nodes), sets, p, q).forest(sets))
    return dealt.mapInArrow(batches, "a long, b long").distinct()


def _edges(out: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*out) if out else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def linked(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """(id, n_shingles, component): one row for each row of ``docs``. ``similarity`` is a fraction."""
    p, q = similarity
    all_docs = written(profiles(docs, id, text, size, p, q))
    first = F.min(F.struct(F.col("id").isNull(), "id", "k1")).alias("r")
    nodes = written(all_docs.filter("n > 0").groupBy("d1", "d2").agg(first, F.first("n").alias("n"), F.first("key").alias("key"), F.first("parts").alias("parts"), F.count(F.lit(1)).alias("copies"))
                    .select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "r.id", "r.k1", "n", "key", "parts", "copies").withColumnRenamed("id", "rep"))
    # sets are taken as alike, and many, if their minimum hashes are frequent
    often = written(nodes.groupBy("key").agg(F.sum("n").alias("total")).filter(F.col("total") > LIMIT).select("key", F.lit(True).alias("often")))
    marked = nodes.join(often, "key", "left").withColumn("cut", F.coalesce("often", F.lit(False)))
    total = nodes.agg(F.sum(F.length("parts"))).first()[0] or 0
    buckets = parts_for(total // 8, ROWS_PER_TASK, docs.sparkSession.sparkContext.defaultParallelism)
    matrix = written(shared_parts(marked.select("node", "parts", "cut"), buckets))
    least = matrix.groupBy("part").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
    shared = written(matrix.join(least.hint("merge"), "part").select("part", "node", "low"))
    classes = written(components(shared.filter("node <> low").select("node", "low").distinct(), "node", "low"))
    sized = nodes.select("node", "n", "rep", "k1", "d1").join(classes.withColumnRenamed("component", "class"), "node")
    large = written(sized.groupBy("class").agg(F.sum("n").alias("total")).filter(F.col("total") > LIMIT).select("class", F.ceil(F.col("total") / LIMIT).cast("int").alias("pieces")))
    active = written(sized.join(large, "class", "left").withColumn("block", F.when(F.col("pieces").isNotNull(), F.pmod("d1", "pieces")).otherwise(F.lit(0)).cast("int"))
                     .withColumn("g", F.xxhash64("class", "block")).withColumn("first", F.xxhash64("class", F.lit(0))))
    sets = written(member_sets(docs, active, id, text, size))
    edges = written(opened(sets, to_first(sets), p, q, True))
    named = components(edges).select("node", "component")
    # parts that lie in several groups may still join nodes of different components
    placed = shared.select("part", "node").join(active.filter("pieces IS NOT NULL").select("node", "g", "first"), "node").join(named, "node", "left")
    placed = written(placed.select("part", "node", "g", "first", F.coalesce("component", "node").alias("c")))
    open_parts = placed.groupBy("part").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.min("g").alias("u"), F.max("g").alias("v")).filter("x <> y AND u <> v").select("part")
    left = written(placed.join(open_parts, "part"))
    cells = left.groupBy("part", "g").agg(F.min("c").alias("x"), F.max("c").alias("y")).select("part", F.col("g").alias("to"), "x", "y")
    # of two groups one asks the other; what has met the first group need not ask it again
    more = left.join(cells, "part").filter("g < to AND g <> first AND to <> first AND NOT (x = c AND y = c)").select("node", F.col("to").alias("g")).distinct()
    edges = edges.unionByName(opened(sets, written(more).join(sets.select("node", "n", "tokens"), "node"), p, q, False))
    named = components(edges)
    found = nodes.select("node", "d1", "d2", "rep", "copies").join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    found = written(found.filter("copies > 1 OR component <> node OR rep IS NULL").unionByName(found.filter("copies = 1 AND component = node AND rep IS NOT NULL").join(
        named.select("component").distinct(), "component", "left_semi").select(*found.columns)))
    names = found.groupBy("component").agg(F.min("rep").alias("name"))
    decided = written(found.join(names, "component").select(F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), "name", F.lit(True).alias("linked")))
    some = all_docs.filter("n > 0").select("id", "n", "d1", "d2").join(decided.hint("merge"), (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")), "left")
    some = some.select("id", F.col("n").alias("n_shingles"), F.when(F.col("linked"), F.col("name")).otherwise(F.col("id")).alias("component"))
    return some.unionByName(all_docs.filter("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component")))
