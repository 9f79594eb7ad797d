"""Near copies: SimHash links, checked on whole shingle sets, and an exact set-similarity join for what they miss."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.components import components
from lanewise.llm.rows import FILE, KEY, ROW, discard, keyed, marked, row_bits, ship, text_batches, utf8
from lanewise.llm.simhash import SEED, fingerprint, print_components
from lanewise.session import write_table

WIDTH = 5
NEAR = (4, 5)  # similarity 0.8, as a fraction: sizes are compared in whole numbers
SAMPLE = 10_000  # documents whose shingles are counted for the order; the order changes cost only
COMMON = 3
BIT_WORDS = 16  # longs of a parity bitmap


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, one without words has none."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII blanks
    digest = xxhash.xxh64_intdigest
    hashes = [digest(b" ".join(words[i : i + width]), SEED) for i in range(max(1, len(words) - width + 1))] if words else []
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def _set_id(shingles: np.ndarray) -> bytes:
    """128 bits: rows of one id are taken for equal sets without a look at them."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _parity_bits(shingles: np.ndarray) -> np.ndarray:
    """1,024 bits: whether an odd number of the shingles has these first ten bits."""
    cells = np.bincount((shingles.view(np.uint64) >> np.uint64(54)).astype(np.int64), minlength=64 * BIT_WORDS)
    return np.packbits((cells & 1).astype(np.uint8)).view(np.int64)


def common_shingles(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that at least COMMON of about SAMPLE documents have, ascending, and in how many; bounded by the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in utf8(batch["text"]):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, width))], ["shingle"])

    step = max(1, rows.count() // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64(*KEY), F.lit(step)) == 0).select("text")
    found = sample.mapInArrow(run, "shingle long").groupBy("shingle").count().where(f"count >= {COMMON}").orderBy("shingle").toArrow()
    return found["shingle"].to_numpy(), found["count"].to_numpy()


def shingle_table(rows: DataFrame, width: int, near: tuple[int, int]) -> DataFrame:
    """(doc_id, row key, SimHash print, 128-bit hash of the shingle set, its size n, parity bits, prefix) of every row, stored.

    In one order of all shingles, seldom ones first, two sets that are near share one of
    their first n - ceil(similarity * n) + 1 shingles, whatever the order is.
    """
    context = rows.sparkSession.sparkContext
    common = context.broadcast(common_shingles(rows, width))
    num, den = near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = common.value
        for batch in batches:
            prints, ids, sizes, bits, prefixes = [], [], [], [], []
            for text in utf8(batch["text"]):
                prints.append(fingerprint(text))
                shingles = shingle_set(text, width)
                n = len(shingles)
                often = np.zeros(n, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
                    often = np.where(known[at] == shingles, counts[at], 0)
                length = n + num * n // -den + 1 if n else 0
                ids.append(_set_id(shingles))
                sizes.append(n)
                bits.append(_parity_bits(shingles))
                prefixes.append(shingles[np.lexsort((shingles, often))[:length]])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (bits, prefixes)]
            signed = pa.array(np.array(prints, np.uint64).view(np.int64))
            arrays = [batch["doc_id"], batch[FILE], batch[ROW], signed, pa.array(ids, pa.binary()), pa.array(sizes, pa.int32()), *lists]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *KEY, "print", "set", "n", "bits", "prefix"])

    schema = f"doc_id long, {FILE} long, {ROW} long, print long, set binary, n int, bits array<bigint>, prefix array<bigint>"
    return write_table(rows.mapInArrow(run, schema), "shingles")


def _possible(n: Column, at: Column, m: Column, to: Column, near: tuple[int, int]) -> Column:
    """Sets of n and m can be near if the shingle at these places is the first they share: no more than what follows can be common."""
    return F.least(n - at, m - to) * sum(near) >= (n + m) * near[0]


def _room(n: Column, at: Column, near: tuple[int, int]) -> Column:
    """near[0] times the largest set that a set of n can be near to if the shingle at this place is the first they share."""
    return (n - at) * sum(near) - n * near[0]


def _meetings(places: DataFrame, near: tuple[int, int], *more: Column) -> DataFrame:
    """(shingle, least, widest) with the least size and the largest room at it, and ``more``, of the shingles by which two sets may be near.

    Of two near sets the smaller has room for one of its own size; a shingle without such a place links nothing.
    """
    room = _room(F.col("n"), F.col("at"), near)
    sums = [F.count("*").alias("sets"), F.min("n").alias("least"), F.max(room).alias("widest"), F.max(room >= F.col("n") * near[0]).alias("inner")]
    return places.groupBy("shingle").agg(*sums, *more).where("sets > 1 AND inner").drop("sets", "inner")


def _met(places: DataFrame, meetings: DataFrame, near: tuple[int, int]) -> DataFrame:
    """Those of ``places`` whose set can be near to the least or to the roomiest that ``meetings`` has at their shingle."""
    fits = (F.col("n") * near[0] <= F.col("widest")) & (F.col("least") * near[0] <= _room(F.col("n"), F.col("at"), near))
    return places.join(meetings, "shingle").where(fits).drop("least", "widest")


def _bits_allow(near: tuple[int, int]) -> Column:
    """The parity bits of sides a and b leave it open that the sets are near.

    Two bitmaps differ in no more bits than the sets have shingles that the other lacks, so
    nothing that is near goes.
    """
    differ = reduce(add, (F.bit_count(F.get("bits_a", F.lit(i)).bitwiseXOR(F.get("bits_b", F.lit(i)))) for i in range(BIT_WORDS)))
    both = F.col("n_a").cast("long") + F.col("n_b")
    return (both - differ) * sum(near) >= both * (2 * near[0])


def _not_apart(pairs: DataFrame, heads: DataFrame, near: tuple[int, int]) -> DataFrame:
    """Those of ``pairs`` that their parity bits allow; 128 bytes of a set move here, before any text does."""
    for side in "ab":
        pairs = pairs.join(heads.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side)
    return pairs.where(_bits_allow(near)).select("a", "b")


def simhash_pairs(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """(a, b): each set and the least set of its SimHash component, linear in the sets."""
    of = rows.select("set", "print").distinct().join(heads.select("set", "id"), "set").join(print_components(rows), "print")
    of = write_table(of.select("id", F.col("root").alias("group")).distinct(), "simhash")
    hubs = write_table(of.groupBy("group").agg(F.min("id").alias("b"), F.count("*").alias("sets")).where("sets > 1").select("group", "b"), "simhash-hubs")
    return of.join(hubs, "group").where("id <> b").select(F.col("id").alias("a"), "b")


def _unlinked(pairs: DataFrame, folded: DataFrame) -> DataFrame:
    """Those of ``pairs`` that are not of one component yet."""
    pairs = pairs.distinct()
    for side in "ab":
        roots = folded.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
        pairs = pairs.join(roots, side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    return pairs.where("root_a <> root_b").select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, heads: DataFrame, width: int, near: tuple[int, int]) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole shingle sets are near.

    Only the texts of these sets are read, and the texts travel: they are a third of the size
    of their shingles' hashes, which are made again where two texts meet.
    """

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [_set_id(shingle_set(t, width)) for t in utf8(batch["text"])]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), batch["text"]], ["set", "text"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, one, two, x, y = [], None, None, None, None
            for a, b, left, right in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), utf8(batch["x"]), utf8(batch["y"])):
                x, one = (x if a == one else shingle_set(left, width)), a
                y, two = (y if b == two else shingle_set(right, width)), b
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both * sum(near) >= near[0] * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = write_table(_not_apart(pairs.distinct(), heads, near), "pairs")
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct()
    needed = write_table(heads.select("id", "set", "head").join(ids, "id"), "needed")
    texts = marked(docs, row_bits(needed.select("head.*")), "lanewise_needed").where("lanewise_needed").select("text")
    table = write_table(texts.mapInArrow(named, "set binary, text string"), "texts")
    of = lambda side: needed.select(F.col("id").alias(side), F.col("set").alias(f"set_{side}"))
    sets = pairs.join(of("a"), "a").join(of("b"), "b")
    left = table.select(F.col("set").alias("set_a"), F.col("text").alias("x"))
    right = table.select(F.col("set").alias("set_b"), F.col("text").alias("y"))
    both = sets.join(left, "set_a").join(right, "set_b").select("a", "b", "x", "y")
    found = write_table(both.mapInArrow(compare, "a long, b long"), "near")
    discard(pairs, needed, table)
    return found


_SIDE = ["id", "n", "at", "root", "bits"]


def _allowed(near: tuple[int, int]) -> Column:
    """Sizes, places and parity bits of sides a and b leave it open that the sets are near."""
    return _possible(F.col("n_a"), F.col("at_a"), F.col("n_b"), F.col("at_b"), near) & _bits_allow(near)


def _mixed(places: DataFrame, folded: DataFrame, near: tuple[int, int]) -> DataFrame:
    """``places`` (shingle, set) with the set's component, of the shingles by which different ones may be near; stored."""
    rooted = places.join(folded.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    rooted = write_table(rooted, "rooted")
    mixed = _meetings(rooted, near, F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").drop("lo", "hi")
    active = write_table(_met(rooted, mixed, near), "active")
    discard(rooted)
    return active


def _more_pairs_than_rows(active: DataFrame) -> bool:
    """A full join would meet more pairs of different components than it has rows."""
    each = active.groupBy("shingle", "root").agg(F.count("*").cast("double").alias("sets"))
    pairs = each.groupBy("shingle").agg(F.sum("sets").alias("all"), F.sum(F.col("sets") * F.col("sets")).alias("own"))
    total, rows = pairs.agg(F.sum((F.col("all") * F.col("all") - F.col("own")) / 2), F.sum("all")).first()
    return total is not None and total > rows


def near_copies(docs: DataFrame, width: int = WIDTH, near: tuple[int, int] = NEAR) -> DataFrame:
    """``linked_rows``, its texts passing in small batches; all that passes texts is stored when it returns."""
    with text_batches(docs.sparkSession):
        return linked_rows(docs, width, near)


def linked_rows(docs: DataFrame, width: int, near: tuple[int, int]) -> DataFrame:
    """(row key, first) for every row of ``docs``.

    Rows are linked, directly or in steps, when the Jaccard similarity of their sets of word
    shingles is at least ``near``. ``first`` marks the one row that stands for its component:
    smallest doc_id (null last), then row key. Texts without words are linked to each other.

    SimHash comes first: its components (fingerprints within 4 bits) are checked on the whole sets
    against the least set of each, and what is near is linked. Ordinary near copies differ in more
    bits, so no near pair is left to it: each prefix shingle's least set is a hub and takes the sets
    near to it, so a large group of near copies folds in rows linear in the group. Where a prefix
    shingle still holds different components, hubs are drawn again until a draw links less than a tenth
    of what the best one has. At the end the sets of such a shingle are joined in full, and only pairs of different components that
    sizes, places and parity bits allow come out of the join.
    """
    slim = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id", "text")
    rows = shingle_table(slim, width, near)
    heads = rows.groupBy("set").agg(F.min(F.struct(*KEY)).alias("head"), *[F.first(c).alias(c) for c in ("n", "bits", "prefix")])
    heads = write_table(heads.withColumn("id", F.monotonically_increasing_id()), "heads")
    alike = _verified(simhash_pairs(rows, heads), slim, heads, width, near)
    keys = heads.select("id", "n", F.posexplode("prefix").alias("at", "shingle"))
    # Counted before anything else of a shingle moves: most occur in one set. Stored, so that the join
    # shuffles both sides and Spark can split a shingle that very many sets share.
    often = write_table(_meetings(keys, near), "often")
    shared = write_table(_met(keys, often, near), "shared")
    hubs = write_table(shared.groupBy("shingle").agg(F.min(F.struct("id", "n", "at")).alias("hub")), "hubs")
    met = shared.join(hubs, "shingle")
    spokes = met.where((F.col("id") != F.col("hub.id")) & _possible(F.col("n"), F.col("at"), F.col("hub.n"), F.col("hub.at"), near))
    pairs = _unlinked(spokes.select(F.col("id").alias("a"), F.col("hub.id").alias("b")), components(alike))
    edges = alike.unionAll(_verified(pairs, slim, heads, width, near))
    folded = components(edges)

    mixed = _mixed(met.where("id <> hub.id").select("shingle", "id", "n", "at"), folded, near)
    active = write_table(mixed.join(heads.select("id", "bits"), "id"), "active")
    discard(often, shared, hubs, mixed)
    drawn, links = 0, edges.count()
    before = links
    while links * 10 >= before and _more_pairs_than_rows(active):
        drawn += 1
        hub = F.min(F.struct(F.xxhash64("id", F.lit(drawn)).alias("place"), *_SIDE)).alias("hub")
        hubs = write_table(active.groupBy("shingle").agg(hub).select("shingle", *[F.col(f"hub.{c}").alias(f"{c}_b") for c in _SIDE]), "hubs")
        met = active.select("shingle", *[F.col(c).alias(f"{c}_a") for c in _SIDE]).join(hubs, "shingle")
        spokes = met.where((F.col("root_a") != F.col("root_b")) & _allowed(near))
        found = _verified(spokes.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), slim, heads, width, near)
        before, links = before + links, found.count()
        edges = edges.unionAll(found)
        others = met.where("id_a <> id_b").select("shingle", *[F.col(f"{c}_a").alias(c) for c in _SIDE if c != "root"])
        old, active = active, _mixed(others, components(edges), near)
        discard(old, hubs)
    left, right = (active.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in _SIDE]) for side in "ab")
    pairs = left.join(right, (left["shingle"] == right["shingle"]) & (F.col("root_a") < F.col("root_b")) & _allowed(near))
    more = _verified(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), slim, heads, width, near)
    roots = write_table(components(edges.unionAll(more)).withColumnRenamed("node", "id"), "roots")

    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY)
    of_set = rows.groupBy("set").agg(F.min(order).alias("best")).join(heads.select("set", "id"), "set")
    linked = write_table(of_set.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "linked")
    discard(active, heads, roots)
    best = linked.groupBy("root").agg(F.min("best").alias("first_row"))
    groups = linked.select("set", "root").join(best, "root").select("set", "first_row")
    first = (F.col(FILE) == F.col(f"first_row.{FILE}")) & (F.col(ROW) == F.col(f"first_row.{ROW}"))
    return rows.select("set", *KEY).join(groups, "set").select(first.alias("first"), *KEY)


ship(__name__)
