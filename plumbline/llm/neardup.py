"""Near-duplicates by a signature-coordinate inverted join.

A document's signature has 144 minima over its set of word shingles, in 48 coordinates of
three, so two documents with Jaccard similarity J agree on a coordinate with probability J
cubed. Documents are posted under every (coordinate, value). A pair above the threshold
agrees on at least ``MATCHES`` of the coordinates (at 0.85 all but one pair in a trillion do,
at 0.8 all but three in a billion), hence on one of any 48 - MATCHES + 1: only this prefix is
posted, the rest is skipped until two documents meet. Then all their minima are compared:
pairs that agree on fewer than all but one in a billion of similar pairs would are dropped,
the others are confirmed on their full sets.

Links serve to find components, so a posting list is not expanded into its pairs. Its
most central member, the one that shares most postings with others, is compared with all
others first; lists whose members are then in one component are finished. What is left is
compared with a second centre. Members of the last lists whose minima would allow a link form
families, and each family's texts are compared in full, in cells that give a forest of their links.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import MIX, WordHash, as_bytes, col, mixed, text_bytes, window_hashes
from plumbline.llm.components import components
from plumbline.plans.small import written

SHINGLE = 5
PERCENT, LEAST_PERCENT = 85, 80
COORDINATES, MINIMA, MATCHES = 48, 3, 6
PREFIX = COORDINATES - MATCHES + 1
FILTER_BITS = 1 << 26
BLOCK = 2048
BLOCK_SHINGLES = 4 << 20  # of a block of texts that are compared in full
MET_BY_CENTRES = 3  # two centres compare all pairs of so few members

FACTORS = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, COORDINATES * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = np.random.Generator(np.random.PCG64(20240301)).integers(0, 1 << 63, COORDINATES * MINIMA, dtype=np.uint64)


def shingles(text: bytes | None, memo: WordHash, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text; all of a short text's words are one."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(memo.array(words), min(size, len(words))))


def least_matches(percent: int, chance: float = 1e-9) -> int:
    """The most minima that all but ``chance`` of the pairs with this similarity agree on."""
    n, p, total, k = COORDINATES * MINIMA, percent / 100, 0.0, 0
    while total <= chance:
        total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        k += 1
    return k - 1


def signature(found: np.ndarray) -> tuple[np.ndarray, bytes]:
    """One 64-bit number per coordinate, different for different coordinates; the minima, cut to 16 bits."""
    least = np.full(COORDINATES * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 512):
        part = found[i : i + 512, None] * FACTORS[None, :] + ADDENDS[None, :]
        np.minimum(least, part.min(axis=0), out=least)
    out = np.arange(1, COORDINATES + 1, dtype=np.uint64)
    for k in range(MINIMA):
        out = mixed(out * MIX + least[k::MINIMA])
    return out.view(np.int64), (mixed(least) >> np.uint64(48)).astype("<u2").tobytes()


def sketches(docs: DataFrame, text: str, id: str) -> DataFrame:
    """``(id, n, content, coordinates, minima)`` of every document: size of the set, its digest, the signature."""

    def run(batches):
        memo = WordHash()
        for batch in batches:
            sizes, keys, signs = [], [], []
            for x in as_bytes(batch.column(1)):
                found = shingles(x, memo)
                sizes.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                signs.append(signature(found) if len(found) else (None, None))
            columns = [
                pa.array(sizes, pa.int64()),
                pa.array(keys, pa.binary()),
                pa.array([x for x, _ in signs], pa.list_(pa.int64())),
                pa.array([x for _, x in signs], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n", "content", "coordinates", "minima"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(col(id).alias("id"), col(text).alias("t")).mapInArrow(
        run, f"id {kind}, n long, content binary, coordinates array<long>, minima binary"
    )


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size over a column ``id``: one bit a hash, two hashes.

    However many ids there are, it holds eight megabytes; more ids let more others pass, which a
    join removes again.
    """
    bits = ids.select(F.explode(F.array(F.xxhash64("id"), F.xxhash64("id", F.lit(1)))).alias("h")).select(
        F.pmod("h", F.lit(FILTER_BITS)).alias("at")
    )
    words = bits.groupBy(F.shiftright("at", 5).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("bits")
    )
    table = words.toArrow()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().astype(np.uint32)
    return out


def sets_of(docs: DataFrame, text: str, id: str, ids: DataFrame) -> DataFrame:
    """``(id, shingles)`` of the documents with these ids: texts stay where they are, the sets move."""
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(ids))
    kind = docs.schema[id].dataType.simpleString()
    hashes = [F.pmod(F.xxhash64(*h), F.lit(FILTER_BITS)) for h in ((col(id),), (col(id), F.lit(1)))]
    rows = docs.select(col(id).alias("id"), col(text).alias("t"), hashes[0].alias("a"), hashes[1].alias("b"))

    def run(batches):
        memo, words = WordHash(), shared.value
        for batch in batches:
            hit = np.ones(batch.num_rows, bool)
            for c in ("a", "b"):
                at = batch.column(c).to_numpy()
                hit &= (words[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1
            some = batch.filter(pa.array(hit))
            found = [shingles(x, memo).view(np.int64) for x in as_bytes(some.column("t"))]
            yield pa.RecordBatch.from_arrays(
                [some.column("id"), pa.array(found, pa.list_(pa.int64()))], names=["id", "shingles"]
            )

    sets = rows.mapInArrow(run, f"id {kind}, shingles array<long>")
    return sets.join(ids, "id", "left_semi").groupBy("id", F.xxhash64("shingles").alias("h")).agg(F.first("shingles").alias("shingles")).drop("h")


def as_minima(column: pa.Array) -> np.ndarray:
    """A column of packed minima as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, COORDINATES * MINIMA)


def near_enough(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sizes and minima allow them to be similar."""
    side = lambda c: classes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("minima").alias(f"m_{c}"))
    sizes = F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(sizes)
    least = least_matches(percent)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                same = (as_minima(batch.column("m_a")) == as_minima(batch.column("m_b"))).sum(axis=1)
                yield batch.filter(pa.array(same >= least)).select(["a", "b"])

    kind = dict(classes.dtypes)["id"]
    return met.select("a", "b", "m_a", "m_b").mapInArrow(run, f"a {kind}, b {kind}")


def linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text: str, id: str, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that pass size and match threshold and are similar on their full sets."""
    near = written(near_enough(pairs, classes, percent).distinct(), "near-pairs")
    if near.isEmpty():
        return near
    ids = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct()
    sets = sets_of(docs, text, id, ids)
    both = near.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b"
    )
    shared = F.size(F.array_intersect("x", "y"))
    enough = F.lit(100) * F.col("i") >= F.lit(percent) * (F.size("x") + F.size("y") - F.col("i"))
    return both.withColumn("i", shared).where(enough).select("a", "b").distinct()


def stars(members: DataFrame, second: bool) -> DataFrame:
    """Pairs of each list's centre with its members of other components.

    The first centre is the member with most company; the second is the one with most among
    those outside the first one's component.
    """
    rank = F.struct("company", F.struct(F.col("id").alias("i"), F.col("component").alias("c")).alias("who"))
    centres = members.groupBy("key").agg(
        F.max(rank).alias("top"), F.min("component").alias("lo"), F.max("component").alias("hi")
    ).where("lo != hi")
    centres = centres.select("key", F.col("top.who.i").alias("centre"), F.col("top.who.c").alias("home"))
    if second:
        others = members.join(centres, "key").where("component != home")
        top = others.groupBy("key").agg(F.max(rank).alias("top"))
        centres = top.select("key", F.col("top.who.i").alias("centre"), F.col("top.who.c").alias("home"))
    met = members.join(centres, "key").where("component != home")
    return met.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


SAME_CELL = ["key", "with_core", "i", "j"]


def cells(members: DataFrame, block) -> DataFrame:
    """The members ``(key, id, component)`` of every key with several components, dealt into cells.

    Members of a key's largest component form one side of blocks, all others are met with them and
    among themselves, so a cell holds two blocks. A key of up to a block is one cell.
    """
    counts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"))
    keys = counts.groupBy("key").agg(
        F.max(F.struct("k", "component")).alias("top"), F.sum("k").alias("m"), F.count(F.lit(1)).alias("parts"), F.max("n").alias("n")
    ).where(f"parts > 1 and m > {MET_BY_CENTRES}")
    keys = keys.withColumn("block", block(F.col("n")))
    long = F.col("m") > F.col("block")
    keys = keys.select(
        "key",
        F.when(long, F.col("top.component")).alias("core"),
        F.ceil(F.col("top.k") / F.col("block")).cast("int").alias("cores"),
        F.when(long, F.ceil((F.col("m") - F.col("top.k")) / F.col("block"))).otherwise(1).cast("int").alias("others"),
    )
    is_core = F.coalesce(F.col("component") == F.col("core"), F.lit(False))
    rows = members.join(keys, "key").withColumn("is_core", is_core)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("is_core"), F.col("cores")).otherwise(F.col("others"))).cast("int"))

    def cell(i, j, with_core: bool):
        return F.struct(i.alias("i"), j.alias("j"), F.lit(with_core).alias("with_core"))

    own = F.col("own")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    among = F.transform(each("others"), lambda k: cell(F.least(own, k), F.greatest(own, k), False))
    down = F.transform(each("cores"), lambda j: cell(own, j, True))
    up = F.transform(each("others"), lambda i: cell(i, own, True))
    parts = F.when(F.col("is_core"), up).when(F.col("core").isNull(), among).otherwise(F.concat(among, down))
    dealt = rows.select("key", "id", "component", "is_core", "own", F.explode(parts).alias("cell"))
    return dealt.select("key", "cell.*", "is_core", "own", "id", "component")


def by_cell(dealt: DataFrame, compare) -> DataFrame:
    """``(a, b)`` of the places that ``compare`` returns for each cell; cells come one after another."""
    kind = dict(dealt.dtypes)["id"]

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            held = yield from done(held, False)
        if held is not None:
            yield from done(held, True)

    def done(table: pa.Table, last: bool):
        table = table.combine_chunks()
        keys = [table.column(c).to_numpy() for c in SAME_CELL]
        change = np.zeros(max(table.num_rows - 1, 0), bool)
        for k in keys:
            change |= k[1:] != k[:-1]
        ends = np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])
        whole = len(ends) - (1 if last else 2)
        ids = table.column("id")
        for start, stop in zip(ends[:whole], ends[1 : whole + 1]):
            if stop - start > 1:
                a, b = compare(table.slice(start, stop - start))
                if len(a):
                    one, two = (ids.take(pa.array(np.asarray(x) + start)).combine_chunks() for x in (a, b))
                    yield pa.RecordBatch.from_arrays([one, two], names=["a", "b"])
        return table.slice(ends[whole])

    rows = dealt.repartition(*SAME_CELL).sortWithinPartitions(*SAME_CELL)
    return rows.mapInArrow(run, f"a {kind}, b {kind}").where("a != b").distinct()


def forest(cell: pa.Table, similar, name_all: bool = False) -> tuple[list[int], list[int]]:
    """Pairs of a cell that join all that ``similar(i, js)`` connects, fewer than the cell has rows.

    Only members of different components, and of different blocks where a cell has two, are met;
    those that earlier pairs have joined already are not met again. With ``name_all`` the pairs also
    name every member that is similar to one of another component (less than two pairs a row).
    """
    column = lambda c: cell.column(c).to_numpy()
    home, core, block, with_core = column("component"), column("is_core"), column("own"), bool(column("with_core")[0])
    apart = not with_core and column("i")[0] != column("j")[0]
    home = np.unique(home, return_inverse=True)[1]
    label, named = home.copy(), np.full(len(home), not name_all)
    a, b = [], []
    for i in np.flatnonzero(~core) if with_core else np.arange(len(label) - 1):
        js = np.flatnonzero(core) if with_core else np.arange(i + 1, len(label))
        js = js[(home[js] != home[i]) & ~((label[js] == label[i]) & named[js] & named[i])]
        if apart:
            js = js[block[js] != block[i]]
        if not len(js) or not len(js := js[similar(i, js)]):
            continue
        labels, at = np.unique(label[js], return_index=True)
        new = ~named[js]
        new[at[labels != label[i]]] = True
        new[0] |= not named[i]
        a += [int(i)] * int(new.sum())
        b += js[new].tolist()
        named[i] = named[js] = True
        label[np.isin(label, labels)] = label[i]
    return a, b


def candidates(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose sizes and minima allow them to be similar: a forest per cell of each
    list, and every text that has such a partner in another component at least once."""
    least = least_matches(percent)
    dealt = cells(members.withColumn("n", F.lit(0)), lambda n: F.lit(BLOCK)).join(classes.select("id", "n", "minima"), "id")

    def compare(cell: pa.Table):
        n, minima = cell.column("n").to_numpy(), as_minima(cell.column("minima"))

        def similar(i, js):
            sizes = 100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i])
            return sizes & ((minima[js] == minima[i]).sum(axis=1) >= least)

        return forest(cell, similar, name_all=True)

    return by_cell(dealt, compare)


def shared_bits(sets: list[np.ndarray]) -> np.ndarray:
    """Which of the shingles that two sets or more have are in each set, 64 to a word."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    seen = times[column] > 1
    row, at = row[seen], place[column[seen]]
    bits = np.zeros((len(sets), max(int((times > 1).sum()) + 63, 64) // 64), np.uint64)
    np.bitwise_or.at(bits, (row, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return bits


def leftovers(members: DataFrame, classes: DataFrame, docs: DataFrame, text: str, id: str, percent: int) -> DataFrame:
    """Links ``(a, b)`` that join all similar texts of different components that share a list.

    Candidates, a forest per cell, and known components make up families. A family's texts meet
    once, in cells with their full sets, where shared shingles are counted as bits; each cell gives
    a forest of its links. So no join or result has a row a pair, however many texts lie just below
    the threshold; the pairs of a family are only counted within cells, which are dealt out.
    """
    near = written(candidates(members, classes, percent), "candidates")
    if near.isEmpty():
        return near
    who = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct()
    homes = members.select("id", "component").distinct().join(who, "id", "left_semi")
    homes = written(homes, "homes")
    graph = near.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        homes.select(F.col("id").alias("u"), F.col("component").alias("v"))
    )
    families = components(graph).withColumnRenamed("component", "key")
    rows = homes.join(families, "id").join(classes.groupBy("id").agg(F.max("n").alias("n")), "id")
    room = lambda n: F.greatest(F.lit(16), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_SHINGLES) / F.greatest(n, F.lit(1))))).cast("int")
    sets = sets_of(docs, text, id, homes.select("id"))
    dealt = cells(rows, room).join(sets, "id")

    def compare(cell: pa.Table):
        sets = [np.asarray(x, np.int64) for x in cell.column("shingles").to_pylist()]
        n, bits = np.array([len(x) for x in sets]), shared_bits(sets)

        def similar(i, js):
            js_ok = 100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i])
            both = np.bitwise_count(bits[js] & bits[i]).sum(axis=1, dtype=np.int64)
            return js_ok & (100 * both >= percent * (n[js] + n[i] - both))

        return forest(cell, similar)

    return by_cell(dealt, compare)


def near_duplicates(
    docs: DataFrame, text: str = "text", id: str = "doc_id", percent: int = PERCENT, sketched: DataFrame | None = None
) -> DataFrame:
    """One row per document: ``id, n_shingles, component_id, kept``.

    Documents are linked if ``100 * |A and B| >= percent * |A or B|`` for their sets of distinct
    five-word shingles (lower-cased A-Z); ``component_id`` is the least id that links reach. Equal
    sets are one class from the start and only classes are compared. ``percent`` is at least 80:
    the match threshold is laid out for similar sets.

    A text with fewer than five words is one shingle; one without words, or null, has none, is
    linked with nothing and is its own component. Rows that share an id are one document. Rows
    without an id cannot be named: they are compared with nothing, have a null component and are
    kept. An empty table gives no rows. Only id and text are read. ``sketched`` passes in stored
    ``sketches`` of the same documents.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"the match threshold is laid out for {LEAST_PERCENT} percent and more")
    sketched = written(sketches(docs, text, id), "sketches") if sketched is None else sketched
    known = sketched.where("id is not null")
    classes = known.where("n > 0").groupBy("content").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("coordinates").alias("coordinates"), F.first("minima").alias("minima")
    )
    classes = written(classes, "classes")
    postings = classes.select("id", F.posexplode(F.slice("coordinates", 1, PREFIX)).alias("place", "key"))
    shared = postings.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    lists = written(postings.join(shared, "key"), "postings")
    company = lists.groupBy("id").agg(F.sum("m").alias("company"))
    lists = written(lists.drop("m").join(company, "id"), "lists")

    # Texts of one id that fell into different classes belong together.
    several = known.where("n > 0").groupBy("id").agg(F.min("content").alias("a"), F.max("content").alias("b")).where("a != b")
    own = known.join(several.select("id"), "id", "left_semi").select(F.col("id").alias("u"), "content")
    links = own.join(classes.select("content", F.col("id").alias("v")), "content").select("u", "v").where("u != v")
    links = written(links, "links")
    found, tried = components(links), None
    for second in (False, True, None):
        members = lists.join(found.withColumnRenamed("id", "node"), F.col("id") == F.col("node"), "left")
        members = members.select("key", "place", "id", "company", F.coalesce("component", "id").alias("component"))
        members = written(members, "members")
        if second is None:
            new = leftovers(members, classes, docs, text, id, percent)
        else:
            pairs = stars(members, second)
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = written(pairs, "pairs")
            if pairs.isEmpty():
                continue
            tried = pairs
            new = linked(pairs, classes, docs, text, id, percent)
        new = new.select(F.col("a").alias("u"), F.col("b").alias("v"))
        new = written(new, "links")
        if not new.isEmpty():
            links = links.unionByName(new)
            found = components(links)

    home = classes.join(found.withColumnRenamed("id", "node"), F.col("id") == F.col("node"), "left").select(
        "content", F.coalesce("component", "id").alias("component_id")
    )
    rows = sketched.select("id", "n", "content").join(home, "content", "left")
    component = F.coalesce("component_id", "id")
    component = F.when(F.col("id").isNotNull(), component)
    return rows.select(
        F.col("id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
