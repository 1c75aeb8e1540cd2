"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A document's shingles of five words are labelled with their occurrence number, so each label is unique in it. For each of
several tables the two labels of least hash are sampled and kept in text order: documents meet in a bucket if they share
the same labels in the same order, which favours small edit distance over mere overlap. At similarity 0.8 a pair misses
all twelve tables about once in 200,000.

Candidates are verified on whole texts: shared labels inside a diagonal band are chained in increasing order in both
texts, and the pair is linked if chain / (shingles of both - chain) is at least 0.8.

Exact copies (equal word sequences) are one node from the start, chosen with partial aggregation. Nodes are texts and have
numbers of their own; ids come in only at the end, when an id of several texts links their classes. A bucket first links
its members to one of them, never all pairs: the hub is the member that meets most others over all tables, which in a
family of copies is one near their common origin. What is left are buckets whose other members belong to several
classes. Their members are grouped by two neighbouring bands of length, as longer or shorter texts cannot be similar. Each
group is read in blocks of bounded bytes, every two blocks of a large group together; a block counts the shared labels of its
members at once and verifies only pairs whose counts allow the similarity and whose classes are still apart, so it returns
fewer links than it has members, and no pair that shares a bucket goes unexamined. Work there grows with the square of a
group's members; it is spread over as many tasks as there are pairs of blocks.

Defined cases: a null text or one without words is alone in its class; fewer than five words make one shingle; rows that
repeat a doc_id are one document that links the classes of all its texts (`near_classes`; `keep_one` goes by texts); a null
doc_id is stood for by a negative number made of the text's hash; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import fresh, materialize, pick, read, released, scratch, shuffle_partitions, word_split

SHINGLE = 5
TABLES = 12
SAMPLED = 2
SIMILARITY = 0.8
#: Bytes of label sequences in a block, and members of a block.
BLOCK_BYTES, BLOCK_MEMBERS = 4 << 20, 1024
#: Labels held by so many members of a block are counted as a matrix product, rarer ones pair by pair.
COMMON = 24
#: Longer texts are hashed table by table, which bounds the memory.
TOGETHER = 1 << 17
CACHED_WORDS = 300_000

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (constants of the splitmix generator)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    """Hash of each word, worked out once; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def labels(words: list[bytes], cache: dict[bytes, int]) -> np.ndarray:
    """Occurrence-labelled shingles in text order."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
    size = min(SHINGLE, n)
    shingles = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        shingles = (shingles + ids[k : n - size + 1 + k]) * _U(0x9E3779B97F4A7C15)
    shingles = _mix(shingles)
    order = np.argsort(shingles, kind="stable")
    sorted_ = shingles[order]
    first = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    at = np.arange(len(order))
    occurrence = np.empty(len(order), np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return _mix(shingles + occurrence * _U(0xD1B54A32D192ED03))


_SEEDS = np.array([0x9E3779B97F4A7C15 * (table + 1) & 0xFFFFFFFFFFFFFFFF for table in range(TABLES)], np.uint64)


def order_keys(marks: np.ndarray) -> list[int]:
    """One key a table: the labels of least hash, in text order."""
    sampled = min(SAMPLED, len(marks))
    if len(marks) <= SAMPLED:
        least = np.broadcast_to(np.arange(sampled), (TABLES, sampled))
    else:
        blocks = [_SEEDS] if len(marks) <= TOGETHER else np.split(_SEEDS, TABLES)
        least = np.vstack([np.sort(_mix(marks[None] ^ seeds[:, None]).argpartition(sampled - 1, axis=1)[:, :sampled], axis=1) for seeds in blocks])
    keys = np.zeros(TABLES, np.uint64)
    for k in range(sampled):
        keys = _mix(keys * _U(3) + marks[least[:, k]])
    return keys.view(np.int64).tolist()


@released
def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns but the text, its number of labels, 128 bits that name its words, and its keys."""
    cache = _Words()
    for batch in batches:
        columns: list[list] = [[] for _ in range(4)]
        for raw in batch.column("text").cast(pa.binary()).to_pylist():
            words = word_split(raw or b"")
            marks = labels(words, cache)
            if len(marks):
                e1, e2 = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), np.int64).tolist()
                row = (len(marks), e1, e2, order_keys(marks))
            else:
                row = (0, None, None, None)
            for column, value in zip(columns, row):
                column.append(value)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*kept, "n", "e1", "e2", "keys"])


@released
def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = _Words()
    for batch in batches:
        raws = batch.column("text").cast(pa.binary()).to_pylist()
        seqs = [(labels(word_split(raw or b""), cache) >> _U(32)).astype(np.uint32).tobytes() for raw in raws]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(seqs, pa.binary())], names=["node", "seq"])


def alignment(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two label sequences by their best chain inside the band that `least` allows; 0 if it can't be reached."""
    together = len(a) + len(b)
    shared, in_a, in_b = np.intersect1d(a, b, return_indices=True)
    if len(shared) < least * (together - len(shared)):
        return 0.0
    # A chain that reaches `least` leaves at most so many labels unmatched in both texts, so its diagonals lie no farther.
    band = together * (1 - least) / (1 + least) + 1
    near = np.abs(in_a - in_b) <= band
    in_a, in_b = in_a[near], in_b[near]
    ahead = in_b[np.argsort(in_a)]
    if (np.diff(ahead) > 0).all():
        chain = len(ahead)
    else:
        ends: list[int] = []
        for place in ahead.tolist():
            k = bisect_left(ends, place)
            if k == len(ends):
                ends.append(place)
            else:
                ends[k] = place
        chain = len(ends)
    return chain / (together - chain)


def _aligned(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("seq_a").to_pylist(), batch.column("seq_b").to_pylist())
            linked = [alignment(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), least) >= least for x, y in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return released(run)


def shared_counts(seqs: list[np.ndarray]) -> np.ndarray:
    """How many labels each two sequences share."""
    owner = np.repeat(np.arange(len(seqs)), [len(q) for q in seqs])
    _, label, held = np.unique(np.concatenate(seqs), return_inverse=True, return_counts=True)
    common = held >= COMMON
    place = np.cumsum(common) - 1
    counts = np.zeros((len(seqs), len(seqs)), np.float32)
    for at in range(0, int(common.sum()), 4096):
        here = common[label] & (place[label] >= at) & (place[label] < at + 4096)
        matrix = np.zeros((len(seqs), min(4096, int(common.sum()) - at)), np.float32)
        matrix[owner[here], place[label[here]] - at] = 1
        counts += matrix @ matrix.T
    order = np.argsort(label, kind="stable")
    ranked, owners = label[order], owner[order]
    for lag in range(1, COMMON):
        both = (ranked[lag:] == ranked[:-lag]) & ~common[ranked[lag:]]
        left, right = owners[:-lag][both], owners[lag:][both]
        np.add.at(counts, (left, right), 1)
        np.add.at(counts, (right, left), 1)
    return counts


def block_links(nodes: list[int], classes: list[int], seqs: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Verified links that join the classes of a block's members, no more than it takes."""
    size = np.array([len(q) for q in seqs], np.float32)
    counts = shared_counts(seqs)
    reach = counts * (1 + least) >= least * (size[:, None] + size[None]) - 0.5
    held = np.array(classes)
    reach &= held[:, None] != held[None]
    parent = {c: c for c in classes}

    def top(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    found = []
    left, right = np.nonzero(np.triu(reach, 1))
    # The likeliest pairs first, so that most others are settled by them.
    for k in np.argsort(-counts[left, right], kind="stable"):
        a, b = int(left[k]), int(right[k])
        if top(classes[a]) != top(classes[b]) and alignment(seqs[a], seqs[b], least) >= least:
            parent[top(classes[a])] = top(classes[b])
            found.append((nodes[a], nodes[b]))
    return found


def _blocks(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams rows sorted by block, one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def links() -> pa.RecordBatch:
            nodes, classes, seqs = zip(*held)
            found = block_links(nodes, classes, [np.frombuffer(q, np.uint32) for q in seqs], least)
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for key, node, cls, seq in zip(*(batch.column(c).to_pylist() for c in ("block", "node", "class", "seq"))):
                if key != block and held:
                    yield links()
                    held.clear()
                block = key
                held.append((node, cls, seq))
        if held:
            yield links()

    return released(run)


def _empty(df: DataFrame) -> bool:
    return not df.take(1)


def classes_of(links: DataFrame) -> DataFrame:
    """node, class of every node in links (a, b): the class is its smallest node.

    Each round every node points to its smallest neighbour, pointers are followed once, and the links are contracted along
    them; links stay distributed, hubs are combined before the shuffle.
    """
    edges = materialize(links.where("a <> b").select("a", "b").distinct(), "edges")
    known = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("class", F.col("node"))
    while not _empty(edges):
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("x")).select("x.*")
        least = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to"))
        least = materialize(least, "pointers")
        then = least.select(F.col("node").alias("to"), F.col("to").alias("then"))
        pointers = materialize(least.join(then, "to", "left").select("node", F.coalesce("then", "to").alias("to")), "pointers")
        known = materialize(
            known.join(pointers.select(F.col("node").alias("class"), "to"), "class", "left").select("node", F.coalesce("to", "class").alias("class")),
            "classes",
        )
        of_a, of_b = pointers.select(F.col("node").alias("a"), F.col("to").alias("pa")), pointers.select(F.col("node").alias("b"), F.col("to").alias("pb"))
        edges = materialize(edges.join(of_a, "a").join(of_b, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges")
    return known


def row_id() -> Column:
    """The doc_id, or for a null one a negative number made of the text's hash."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseOR(F.lit(-(2**63))))


def _mixed(placed: DataFrame, least: float) -> DataFrame:
    """t, key, band and parts of the groups that are left to compare: members of two neighbouring bands of sizes, of several classes.

    Similar texts differ by the factor 1 / least in their labels at most, so they lie in one band or in neighbouring ones. Of
    groups with the same members one is enough.
    """
    told = placed.groupBy("t", "key", "band").agg(
        F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("labels"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.shiftrightunsigned(F.xxhash64("node", F.lit(1)), 24)).alias("y"),
    )
    # A bucket has as many rows here as sizes have bands, a hundred at most.
    bands = told.groupBy("t", "key").agg(F.collect_list(F.struct("band", "low", "high", "members", "labels", "x", "y")).alias("bands"))
    at = lambda b, step: F.get(F.filter("bands", lambda c: c["band"] == b["band"] + step), F.lit(0))
    pairs = bands.select("t", "key", F.explode(F.transform("bands", lambda b: F.struct(b.alias("own"), at(b, 1).alias("next"), at(b, -1).alias("before")))).alias("p")).select("t", "key", "p.*")
    # A band alone is compared with the one before it, if there is one.
    pairs = pairs.where("next IS NOT NULL OR before IS NULL")
    both = lambda c: F.col(f"own.{c}") + F.coalesce(f"next.{c}", F.lit(0))
    groups = pairs.select(
        "t", "key", "own.band", F.least("own.low", "next.low").alias("low"), F.greatest("own.high", "next.high").alias("high"), both("members").alias("members"), both("labels").alias("labels"),
        F.col("own.x").bitwiseXOR(F.coalesce("next.x", F.lit(0))).alias("x"), both("y").alias("y"),
    )
    one = groups.where("low <> high").groupBy("members", "x", "y").agg(F.min(F.struct("t", "key", "band", "labels")).alias("b")).select("b.*", "members")
    parts = F.ceil(F.greatest(F.col("members") / BLOCK_MEMBERS, F.col("labels") * 4 / BLOCK_BYTES)).cast("int")
    return one.select("t", "key", "band", parts.alias("parts"))


def near_texts(rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows (rid, text_h, text and others; rid and text_h find a text) with, instead of the text, the class of near copies
    it is in, as a number; null where it has no words."""
    others = [f for f in rows.schema if f.name != "text"]
    marked = materialize(rows.mapInArrow(_sketches, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others) + ", n int, e1 long, e2 long, keys array<long>"), "sketches")
    # Each text is a node with a number of its own, as an id may have several texts; rid and text_h find one row of the text.
    texts = marked.where("n > 0").groupBy("e1", "e2").agg(F.min(F.struct("rid", "text_h", "n", "keys")).alias("x"))
    nodes = materialize(texts.select("e1", "e2", "x.*", F.monotonically_increasing_id().alias("node")), "nodes")
    bands = nodes.select("node", "n", F.posexplode("keys").alias("t", "key"))
    sizes = materialize(bands.groupBy("t", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "sizes")
    met = materialize(bands.join(sizes, ["t", "key"]), "met")
    fame = met.groupBy("node").agg(F.sum("members").alias("fame"))
    ranked = materialize(met.join(fame, "node"), "ranked")
    # The most met member of each bucket.
    hubs = materialize(ranked.groupBy("t", "key").agg(F.max(F.struct("fame", (-F.col("node")).alias("m"))).alias("x")).select("t", "key", (-F.col("x.m")).alias("hub")), "hubs")
    members = materialize(ranked.join(hubs, ["t", "key"]).where("node <> hub").select("t", "key", "node", "n", "hub"), "members")
    wanted = members.select("node").union(hubs.select("hub")).distinct()
    # The nodes grow with the input, so they are not to be broadcast while they happen to be few: the plan is one at any size.
    wanted = nodes.select("rid", "text_h", "node").join(wanted.hint("merge"), "node", "left_semi")
    # Rows that repeat both id and text have equal sequences. Keys are the hashed side, so texts are not sorted.
    of_text = rows.select("rid", "text_h", "text").join(wanted.hint("shuffle_hash"), ["rid", "text_h"]).select("node", "text")
    sequences = materialize(of_text.mapInArrow(_sequences, "node long, seq binary").dropDuplicates(["node"]), "sequences")

    pairs = members.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    seq_a, seq_b = (sequences.select(F.col("node").alias(c), F.col("seq").alias(f"seq_{c}")) for c in "ab")
    tested = materialize(pairs.join(seq_a, "a").join(seq_b, "b").select("a", "b", "seq_a", "seq_b").mapInArrow(_aligned(least), "a long, b long, linked boolean"), "tested")
    known = classes_of(tested.where("linked").select("a", "b"))

    # Pairs without the hub are left in buckets whose other members belong to several classes.
    band = F.floor(F.log("n") / F.lit(1.0001 * math.log(1 / least))).cast("int")
    placed = materialize(members.select("t", "key", "node", "n", band.alias("band")).join(known, "node", "left").withColumn("class", F.coalesce("class", "node")), "placed")
    mixed = materialize(_mixed(placed, least), "mixed")
    within = placed.withColumn("band", F.explode(F.array("band", F.col("band") - 1))).join(mixed, ["t", "key", "band"])
    within = within.withColumn("part", F.pmod(F.xxhash64("node", "t"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    block = F.xxhash64("t", "key", "band", F.least("part", "other"), F.greatest("part", "other"))
    dealt = within.withColumn("other", other).select(block.alias("block"), "node", "class").join(sequences, "node")
    count = shuffle_partitions(rows.sparkSession)
    more = materialize(
        dealt.repartition(count, "block").sortWithinPartitions("block", "node").select("block", "node", "class", "seq").mapInArrow(_blocks(least), "a long, b long").distinct(), "links"
    )
    known = merged(known, more)
    named = nodes.select("e1", "e2", "node").join(known, "node", "left").select("e1", "e2", F.coalesce("class", "node").alias("class"))
    columns = [f.name for f in others]
    found = marked.where("n > 0").join(named, ["e1", "e2"]).select(*columns, "class")
    return materialize(found.unionByName(marked.where("n = 0").select(*columns, F.lit(None).cast("long").alias("class"))), "named")


def keyed_rows(docs: DataFrame) -> DataFrame:
    """rid, text_h and text of every row."""
    # Seeded apart from the hash in `row_id`, so that both together tell the texts of null ids.
    return pick(docs, "doc_id", "text").select(row_id().alias("rid"), F.xxhash64(F.lit(1), "text").alias("text_h"), "text")


def near_classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """rid, class, rows of every distinct rid of the documents: the class is its smallest rid, rows counts the rid's rows."""
    with scratch(docs.sparkSession):
        named = near_texts(keyed_rows(docs), least)
        held = materialize(named.where("class IS NOT NULL").select("rid", "class").distinct(), "held")
        # An id of texts in several classes links these.
        several = held.groupBy("rid").agg(F.min("class").alias("a"), F.max("class").alias("high")).where("a <> high").select("rid", "a")
        links = materialize(held.join(several, "rid").where("a <> class").select("a", F.col("class").alias("b")).distinct(), "links")
        if not _empty(links):
            to = classes_of(links).select(F.col("node").alias("class"), F.col("class").alias("to"))
            held = materialize(held.join(to, "class", "left").select("rid", F.coalesce("to", "class").alias("class")).distinct(), "held")
        # Classes of one id need no name from others.
        names = held.groupBy("class").agg(F.min("rid").alias("name"), F.count(F.lit(1)).alias("ids")).where("ids > 1").select("class", "name")
        found = held.join(materialize(names, "names"), "class", "left").select("rid", F.coalesce("name", "rid").alias("class"))
        counted = named.groupBy("rid").agg(F.count(F.lit(1)).alias("rows"))
        return materialize(counted.join(found, "rid", "left").select("rid", F.coalesce("class", "rid").alias("class"), "rows"), "found", keep=True)


def merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """Classes (node, class) after more links: only the classes that these touch are worked out again."""
    if _empty(links):
        return known
    of = lambda side: known.select(F.col("node").alias(side), F.col("class").alias(f"c{side}"))
    lifted = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = classes_of(lifted)
    to = moved.select(F.col("node").alias("class"), F.col("class").alias("to"))
    old = known.join(to, "class", "left").select("node", F.coalesce("to", "class").alias("class"))
    return materialize(old.unionByName(moved.join(known, "node", "left_anti").select("node", "class")), "classes")


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of each class of near copies, all columns as they were: the row of the smallest rid (see `row_id`).

    Classes are of texts: what several rows with one id hold is compared, and stays or goes, text by text. Of several rows of
    that rid the one of least text hash stays, and among equal texts the one whose other columns have the least hash. Rows
    without words stay, but for those that repeat both id and text.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key = fresh(docs.columns, "_rid", "_text_h", "_row_h")
    # Maps have no hash; rows that differ in nothing else are taken as equal.
    others = [F.col(f"`{f.name}`") for f in docs.schema if f.name != "text" and "map<" not in f.dataType.simpleString()]
    made = [row_id(), F.xxhash64(F.lit(1), "text"), F.xxhash64(*others) if others else F.lit(0).cast("long")]
    rows = docs.withColumns(dict(zip(key, made)))
    names = ["rid", "text_h", "row_h"]
    with scratch(docs.sparkSession):
        named = near_texts(rows.select(*(F.col(k).alias(n) for k, n in zip(key, names)), "text"), least)
        keyed = materialize(named.groupBy(*names, "class").agg(F.count(F.lit(1)).alias("rows")), "keyed")
        # A row without words is in a class with those of its id and text only.
        alone = [F.when(F.col("class").isNull(), F.col(c)).alias(f"own_{c}") for c in ("rid", "text_h")]
        best = keyed.groupBy("class", *alone).agg(F.min(F.struct(*names)).alias("best")).select("best.*")
        best = materialize(best, "best")
        lost = keyed.join(best, names, "left_anti").select(*names)
        repeated = materialize(keyed.where("rows > 1").join(best, names, "left_semi").select(*names), "repeated", keep=True)
        gone = materialize(lost.unionByName(repeated), "gone", keep=True)
    renamed = lambda df: df.select(*(F.col(n).alias(k) for k, n in zip(key, names)))
    single = rows.join(renamed(gone).hint("shuffle_hash"), key, "left_anti").select(*columns)
    if _empty(repeated):
        return single
    # Combined before the shuffle, so that a row of many copies sends one from each task.
    row = fresh(docs.columns, "_row")[0]
    first = rows.join(renamed(repeated), key, "left_semi").groupBy(*key).agg(F.first(F.struct(*columns)).alias(row))
    return single.unionByName(first.select(*(F.col(f"{row}.`{c}`") for c in docs.columns)))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = near_classes(docs)
    rows = docs.select("doc_id", row_id().alias("rid"))
    return rows.join(found, "rid").select("doc_id", F.col("class").alias("class_id"), (F.col("rid") == F.col("class")).alias("representative"))
