"""Near-duplicate groups by an LSH forest over MinHash signatures.

Every distinct shingle set gets TREES signature orders. In an order, the sets that share a prefix of
MIN_DEPTH values form a region. A region of at most REGION sets is compared in full; a denser one is
deepened, value by value, until its parts are that small, and there each set meets its neighbours of
longest common prefix; besides, every set of a dense region meets the region's hub, the set whose labels
are shared by most sets over all orders. Candidates are confirmed on full sets, and links are joined into
components by star contraction. Where sets of a dense region then still are in several components, an
exact join on their rarest shingles finds what deepening has missed, so that it loses no link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, saved, scratch, ship_package, split_join
from .textkit import LOWER, U, mix, shingles, span_hashes, word_spans

TREES, DEPTH, MIN_DEPTH, REGION, NEIGHBOURS = 20, 9, 4, 16, 3
#: Sets on either side of an exact comparison's block, places on either side of a shingle's, and counters of the
#: shingles' frequencies (they give an order, never a filter).
BLOCK, PLACES, COUNTERS = 256, 512, 1 << 20
_SEEDS = np.random.default_rng(7).integers(1, 1 << 62, TREES * DEPTH, dtype=np.int64).astype(U) * U(2) + U(1)


def signature(members: np.ndarray) -> np.ndarray:
    """TREES * DEPTH MinHash values (32 bits each) of a set of hashes."""
    best = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, U)
    for at in range(0, len(members), 256):
        np.minimum(best, (members[at : at + 256, None] * _SEEDS).min(axis=0), out=best)
    return (best >> U(32)).astype(np.uint32)


def _sets(chunk, size: int):
    lowered = LOWER[chunk.data]
    starts, ends, first = word_spans(lowered, chunk.offsets)
    words = span_hashes(lowered, starts, ends)
    for i in range(len(chunk)):
        yield np.unique(shingles(words[first[i] : first[i + 1]], size))


def _sketches(size: int):
    def step(chunk, rows):
        count, a, b, sig = [], [], [], []
        for members in _sets(chunk, size):
            count.append(len(members))
            a.append(int(members.sum(dtype=U).view(np.int64)))
            b.append(int(mix(members).sum(dtype=U).view(np.int64)))
            sig.append(signature(members).tobytes() if len(members) else None)
        return {"n_shingles": count, "fp": a, "fp2": b, "sig": sig}

    return step


def _set_arrays(size: int):
    def step(chunk, rows):
        sets = [x.view(np.int64) for x in _sets(chunk, size)]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
        return {"members": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))}

    return step


def _orders(classes: DataFrame) -> DataFrame:
    """A row for each class and tree: the region at MIN_DEPTH and the rest of the label, by value."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("region", T.LongType()), T.StructField("label", T.BinaryType())])

    def run(batches):
        tree = np.arange(TREES, dtype=U)
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                rows = batch.slice(lo, 2000)
                if not len(rows):
                    continue
                sig = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.uint32).reshape(len(rows), TREES, DEPTH)
                region = np.zeros(sig.shape[:2], U) + tree
                for d in range(MIN_DEPTH):
                    region = mix(region * U(0x9E3779B97F4A7C15) + sig[:, :, d].astype(U) + U(1))
                rest = np.ascontiguousarray(sig[:, :, MIN_DEPTH:]).view(np.uint8).reshape(-1)
                width = 4 * (DEPTH - MIN_DEPTH)
                label = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows) * TREES, [None, pa.py_buffer(rest)]).cast(pa.binary())
                take = np.repeat(np.arange(len(rows)), TREES)
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(take)), rows.column(1).take(pa.array(take)), pa.array(region.reshape(-1).view(np.int64)), label], names=schema.names)

    return classes.select("node", "copies", "sig").mapInArrow(run, schema)


def _candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs a < b of classes that are neighbours in some order, with the number of orders; (hub, node) of dense regions."""
    orders = saved(_orders(classes))
    regions = saved(orders.groupBy("region").agg(F.count("*").alias("n")).where("n > 1"))
    rows = saved(split_join(orders, regions, "region", "n"))
    dense = rows.where(F.col("n") > REGION)
    shared = saved(dense.groupBy("region", "label").agg(F.count("*").alias("sharing")))
    placed = saved(split_join(dense.drop("n"), _deepened(shared), ["region", "label"], "sharing"))
    central = placed.groupBy("node").agg(F.sum("sharing").alias("central"))
    hubs = saved(dense.drop("n").join(central, "node").groupBy("region").agg(F.max_by("node", F.struct("central", "copies", -F.col("node"))).alias("hub"), F.count("*").alias("n")))
    # equal whole labels: parts of about REGION sets, dealt differently in each order; the hub joins the parts
    salt = F.when(F.col("m") > REGION, F.pmod(F.xxhash64("node", "region"), F.ceil(F.col("m") / REGION))).otherwise(F.lit(0))
    near = placed.select(F.xxhash64("part", salt).alias("region"), "label", "node")
    pairs = _pairs(rows.where(F.col("n") <= REGION).select("region", "label", "node"), REGION)
    pairs = pairs.union(_pairs(near, NEIGHBOURS))
    around = saved(split_join(dense.select("region", "node"), hubs, "region", "n").select("hub", "node").distinct())
    star = around.where("node != hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    return pairs.union(star).groupBy("a", "b").agg(F.count("*").alias("orders")), around


def _deepened(shared: DataFrame) -> DataFrame:
    """(region, label, sharing, part, m): of each label the shortest prefix that at most REGION sets have, else all of it, and its m sets.

    shared tells for the labels of dense regions how many sets have them. Sets of one label are in the same parts, so
    prefixes are made once for each label, not for each set: DEPTH - MIN_DEPTH rows, in proportion to the labels.
    """
    deepest = DEPTH - MIN_DEPTH
    depths = F.array(*[F.struct(F.lit(d).alias("d"), F.xxhash64("region", F.substring("label", 1, 4 * d)).alias("part")) for d in range(1, deepest + 1)])
    deeper = saved(shared.select("region", "label", "sharing", F.explode(depths).alias("x")).select("region", "label", "sharing", "x.*"))
    counts = saved(deeper.groupBy("part").agg(F.sum("sharing").alias("m"), F.count("*").alias("labels")))
    fits = split_join(deeper, counts, "part", "labels").where((F.col("m") <= REGION) | (F.col("d") == deepest))
    return saved(fits.groupBy("region", "label", "sharing").agg(F.min_by(F.struct("part", "m"), "d").alias("x")).select("region", "label", "sharing", "x.*"))


def _pairs(rows: DataFrame, reach: int) -> DataFrame:
    """Each set of a small region with the next ``reach`` in label order."""
    groups = rows.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("label", "node"))).alias("g")).where("size(g) > 1")
    nexts = f"flatten(transform(g, (x, i) -> transform(slice(g, i + 2, {reach}), y -> struct(least(x.node, y.node) AS a, greatest(x.node, y.node) AS b))))"
    return groups.select(F.explode(F.expr(nexts)).alias("p")).select("p.a", "p.b").where("a != b")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component.

    Large-star and small-star steps by turns, on tables in the shared folder. A node's edges are grouped by
    a minimum and joined with one row; the few nodes that hold most edges have that row broadcast.
    """
    edges = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    state = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        large = saved(split_join(both, low, "u", "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        low = saved(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = split_join(large, low, "u", "n")
        edges = saved(small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("node").alias("a"), F.col("members").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("members").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _frequencies(members: DataFrame) -> np.ndarray:
    """How often shingles stand in the sets, by counters that some shingles share: COUNTERS numbers, whatever the input."""
    schema = T.StructType([T.StructField("at", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches):
        sums = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            sums += np.bincount(batch.column(0).flatten().to_numpy() & (COUNTERS - 1), minlength=COUNTERS)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=schema.names)

    ship_package(members.sparkSession)
    table = members.select("members").mapInArrow(run, schema).groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most COUNTERS rows
    out = np.zeros(COUNTERS, np.int64)
    out[table.column(0).to_numpy()] = table.column(1).to_numpy()
    return out


def _rarest(members: DataFrame, percent: int) -> DataFrame:
    """(shingle, node, root, size, at, short): of each set the rarest shingles, one of which a linked set must share, and their places.

    Shingles come in one order for all sets, by frequency and then by value. short: a larger set that is linked must
    share one of these few, since the common part is then as large as a link of two sets of this size needs.
    """
    shared = members.sparkSession.sparkContext.broadcast(_frequencies(members))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("shingle", "node", "root", "size", "at")] + [T.StructField("short", T.BooleanType())])

    def run(batches):
        often = shared.value
        for batch in batches:
            lists = batch.column(2)
            offsets, values = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
            size = np.diff(offsets).astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((values, often[values & (COUNTERS - 1)], row))
            place = np.arange(len(values)) - offsets[:-1][row]
            chosen = np.flatnonzero(place <= size[row] - -(-percent * size[row] // 100))
            row = row[chosen]
            yield pa.RecordBatch.from_arrays([pa.array(values[order][chosen]), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(size[row]), pa.array(place[chosen]), pa.array(place[chosen] <= _short(size[row], percent))], names=schema.names)

    return members.select("node", "root", "members").mapInArrow(run, schema)


def _short(size: np.ndarray, percent: int) -> np.ndarray:
    """The last place among a set's rarest shingles at which it can meet a larger set first."""
    return size - -(-2 * percent * size // (100 + percent))


def _may_link(size: np.ndarray, at: np.ndarray, root: np.ndarray, asking: np.ndarray, given: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets that meet at a shingle could be linked across components, were it the first that they share.

    Sizes must fit; of the smaller set the shingle must be among the few that are left when the common part is as
    large as a link needs; and behind the shingle there must be room for that part in both.
    """
    sx, sy = size[asking][:, None], size[given][None, :]
    rest = np.minimum((size - at)[asking][:, None], (size - at)[given][None, :])
    needed = -(-percent * (sx + sy) // (100 + percent))
    smaller = np.where(sx <= sy, at[asking][:, None], at[given][None, :])
    short = smaller <= _short(np.minimum(sx, sy), percent)
    return (root[asking][:, None] != root[given][None, :]) & (100 * np.minimum(sx, sy) >= percent * np.maximum(sx, sy)) & (rest >= needed) & short


def _met(members: DataFrame, percent: int) -> DataFrame:
    """(place, node, root, size, at, asks): the rare rows, dealt to where those that could be linked meet.

    The sets outside a shingle's largest component ask. Of two sets that meet, the smaller one must have the shingle
    among its short ones, so short rows that ask meet all rows, the others that ask meet short rows, both in blocks of
    PLACES; a shingle that is short for no set, as those of a template that all its pages share, is dealt nowhere.
    """
    rare = saved(_rarest(members, percent))
    by_root = rare.groupBy("shingle", "root").agg(F.count("*").alias("n"), F.count_if("short").alias("s"))
    largest = F.struct("n", "root")
    stats = by_root.groupBy("shingle").agg(F.count("*").alias("k"), F.max_by("root", largest).alias("main"), F.sum("n").alias("total"), F.max("n").alias("most"), F.sum("s").alias("shorts"), F.max_by("s", largest).alias("main_shorts"))
    stats = saved(stats.where("k > 1 AND shorts > 0").drop("k"))
    columns = ["shingle", "node", "root", "size", "at"]
    rows = split_join(rare, stats, "shingle", "total").withColumn("asks", F.col("root") != F.col("main"))
    blocks = lambda n: F.ceil(n / PLACES)
    asking = F.col("shorts") - F.col("main_shorts")
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    out = None
    for kind, refs, asks, n_refs, n_asks in (("short", F.lit(True), F.col("asks") & F.col("short"), F.col("total"), asking), ("other", F.col("short"), F.col("asks") & ~F.col("short"), F.col("shorts"), F.col("total") - F.col("most") - asking)):
        counted = rows.withColumns({"n_refs": blocks(n_refs), "n_asks": blocks(n_asks)}).where("n_asks > 0")
        given = counted.where(refs).select(*columns, F.lit(False).alias("asks"), deal("n_refs").alias("block"), every("n_asks").alias("ask_block"))
        asked = counted.where(asks).select(*columns, "asks", every("n_refs").alias("block"), deal("n_asks").alias("ask_block"))
        part = given.union(asked).select(F.xxhash64("shingle", "block", "ask_block", F.lit(kind)).alias("place"), "node", "root", "size", "at", "asks")
        out = part if out is None else out.union(part)
    return out


def _alive(members: DataFrame, percent: int) -> DataFrame:
    """Nodes that share a rare shingle with a set of another component that they could be linked with.

    What comes out of a block is a list of nodes, not of pairs.
    """

    def run(batches):
        held = None
        for batch in (*batches, None):
            if batch is not None:
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table])
            if held is None or (batch is not None and len(held) < 1 << 16):
                continue
            place, node, root, size, at = (held.column(i).to_numpy() for i in range(5))
            asking = held.column(5).to_numpy()
            cut = int(np.searchsorted(place, place[-1])) if batch is not None else len(place)
            borders = np.flatnonzero(np.append(True, place[1:cut] != place[: cut - 1])) if cut else np.zeros(0, np.int64)
            found = [np.zeros(0, np.int64)]
            for lo, hi in zip(borders, np.append(borders[1:], cut)):
                x, y = lo + np.flatnonzero(asking[lo:hi]), lo + np.flatnonzero(~asking[lo:hi])
                if len(x) and len(y):
                    may = _may_link(size, at, root, x, y, percent)
                    found += [node[x[may.any(1)]], node[y[may.any(0)]]]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))], names=["node"])
            held = held.slice(cut) if cut < len(place) else None

    return _met(members, percent).repartition("place").sortWithinPartitions("place").mapInArrow(run, "node long").distinct()


def _across(around: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components around one hub: for each set outside the largest, one to each other component.

    Only sets that a rare shingle lets hope for such a link are compared, in full and in blocks.
    """
    own = saved(around.join(roots, "node", "left").select("hub", "node", F.coalesce("root", "node").alias("root")))
    mixed = saved(own.groupBy("hub", "root").agg(F.count("*").alias("n")).groupBy("hub").agg(F.count("*").alias("k"), F.sum("n").alias("n")).where("k > 1"))
    members = saved(split_join(own, mixed, "hub", "n").select("node", "root").distinct().join(sets, "node"))
    alive = saved(_alive(members, percent))
    own = saved(own.join(alive, "node", "left_semi"))
    by_root = own.groupBy("hub", "root").agg(F.count("*").alias("n"))
    mixed = saved(by_root.groupBy("hub").agg(F.count("*").alias("k"), F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("total"), F.max("n").alias("most")).where("k > 1"))
    rows = split_join(own, mixed, "hub", "total").select("hub", "node", "root", (F.col("root") != F.col("main")).alias("asks"), F.ceil(F.col("total") / BLOCK).alias("n_refs"), F.ceil((F.col("total") - F.col("most")) / BLOCK).alias("n_asks"))
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    refs = rows.select("hub", "node", "root", F.lit(False).alias("asks"), deal("n_refs").alias("block"), every("n_asks").alias("ask_block"))
    asks = rows.where("asks").select("hub", "node", "root", "asks", every("n_refs").alias("block"), deal("n_asks").alias("ask_block"))
    blocks = refs.union(asks).join(sets, "node").groupBy("hub", "block", "ask_block")

    def compare(table: pa.Table) -> pa.Table:
        lists = table.column("members").combine_chunks()
        offsets, values = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
        node, root = table.column("node").to_numpy(), table.column("root").to_numpy()
        asking = np.flatnonzero(table.column("asks").to_numpy(zero_copy_only=False))
        given = np.flatnonzero(~table.column("asks").to_numpy(zero_copy_only=False))
        size = np.diff(offsets)
        one, inverse, times = np.unique(values, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(times > 1)  # a shingle of one set alone is in no intersection
        place = np.full(len(one), -1, np.int64)
        place[shared] = np.arange(len(shared))
        row, column = np.repeat(np.arange(len(size)), size), place[inverse]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(asking), len(given)), np.float32)
        for lo in range(0, len(shared), 4096):
            a, b = np.searchsorted(column, [lo, lo + 4096])
            has = np.zeros((len(size), 4096), np.float32)
            has[row[a:b], column[a:b] - lo] = 1
            both += has[asking] @ has[given].T
        total = size[asking][:, None] + size[given][None, :] - both
        apart = root[asking][:, None] != root[given][None, :]
        x, y = np.nonzero((100 * both >= percent * total) & apart)
        _, first = np.unique(np.stack([asking[x], root[given[y]]], axis=1), axis=0, return_index=True) if len(x) else (None, [])
        return pa.table({"a": node[asking[x[first]]], "b": node[given[y[first]]]}) if len(x) else pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    return blocks.applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, groups: bool = False) -> DataFrame:
    """A row for each row of docs: id, n_shingles, component_id (smallest id of its group), kept.

    Two documents are linked when 100 * |intersection| >= percent * |union| of their shingle sets.
    Null or wordless texts have an empty set and are groups of their own; repeated rows have equal sets
    and one group; rows without id join groups but are kept only where no member has an id; empty docs give
    no rows. Other columns of docs are not read. With ``groups`` also group_key, which is the same for all
    rows of a group, whatever their ids (null for empty sets), and text_key (xxhash64 of the text). The
    result is a table in the shared folder; all other tables of the work are deleted.
    """
    with scratch(docs.sparkSession):
        found = _grouped(docs, id_col, text_col, size, percent)
        return saved(found if groups else found.drop("group_key", "text_key"), keep=True)


def _grouped(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    sketch_schema = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("fp2", T.LongType()), T.StructField("sig", T.BinaryType())])
    sketches = saved(map_texts(keyed, "text", lambda: _sketches(size), sketch_schema, ["id", "text_key"]))
    full = sketches.where("n_shingles > 0")
    classes = saved(full.groupBy(F.col("fp").alias("node"), "fp2").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.min(F.struct("text_key", "id")).alias("member"), F.min("sig").alias("sig")))
    pairs, around = _candidates(classes)
    pairs = saved(pairs)

    # one member's text for each class, found by text and id, so that a group of copies is not dealt to one task
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", "member"), "node").select("node", F.col("member.text_key").alias("text_key"), F.col("member.id").alias("member_id"))
    found = (keyed["text_key"] == needed["text_key"]) & keyed["id"].eqNullSafe(needed["member_id"])
    texts = keyed.join(needed, found).groupBy("node").agg(F.first("text").alias("text"))
    sets = saved(map_texts(texts, "text", lambda: _set_arrays(size), T.StructType([T.StructField("members", T.ArrayType(T.LongType()))]), ["node"]))

    # first each class with its likeliest partner; then only pairs that could still join two components
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other"), "orders"), F.struct(F.col("b").alias("node"), F.col("a").alias("other"), "orders"))).alias("e")).select("e.*")
    best = ends.groupBy("node").agg(F.max_by("other", F.struct("orders", -F.col("other"))).alias("other"))
    best = best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    links = saved(_confirmed(best, sets, percent))
    roots = components(links)
    ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    rest = pairs.join(best, ["a", "b"], "left_anti").join(ra, "a", "left").join(rb, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
    more = saved(_confirmed(rest, sets, percent))
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))

    last = saved(_across(around, roots, sets, percent))
    if not last.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(last))

    grouped = saved(classes.join(roots, "node", "left").select("node", "fp2", "first_id", "copies", F.coalesce("root", "node").alias("root")))
    named = saved(grouped.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")))
    named = saved(split_join(grouped, named, "root", "n").select(F.col("node").alias("fp"), "fp2", "component_id", F.col("root").alias("group_key"), "copies"))
    columns = ["id", "n_shingles", "component_id", "group_key", "text_key"]
    out = split_join(full.select("id", "n_shingles", "fp", "fp2", "text_key"), named, ["fp", "fp2"], "copies").select(*columns)
    out = out.union(sketches.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"), F.lit(None).cast("long").alias("group_key"), "text_key"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "group_key", "text_key")
