"""Merkle fixity audit of WARC records: hash records and offset ranges into trees, descend only where replicas differ.

Records are dealt into archive files by a range of ids and lie in a file in id order. Every record has a leaf of its own: its
id, its number among equal records, its offset from its parent's start, its length and the hash of its bytes. Each inner
node hashes the ordered hashes and offset ranges of its children, `FANOUT` places at most, up to one root for each file. The
trees of a replica are one written table, a row a file, so that comparing roots reads nothing else of it. Only files with other
roots are opened, and of them only branches that differ, down to the damaged records. Ranges count from the parent's
start, so a record of another length alters its own branch only; offsets in the file are added up on the way down.

An id with more than `COPIES` records, and null ids alike, has archive files of its own, as many as its records need. In them
equal records are one leaf with their count, and records are dealt to files and places by their hash.

Defined cases: null records, urls and html count as empty; null ids lie in a file that has no number; a record in one replica only is
missing or extra; of an id with several records, those that are not in both replicas are paired in the order of their hashes
and are damaged as far as there are pairs (inside one file, for an id with files of its own); a row of the result stands for
`copies` equal records, one for ids that share a file; an empty replica makes every record missing; equal replicas give no
rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import materialize, pick, read, scratch, shuffle_partitions

#: Places in a file: FANOUT branches of FANOUT twigs of FANOUT places.
FANOUT = 10
RECORDS_A_FILE = FANOUT**3
COPIES = 16
#: The audited replica of the query is damaged where the id leaves this remainder.
DAMAGE_STEP, DAMAGED, LOST = 97, 13, 31
#: Pages carry no time of capture, which a record must name.
NO_DATE = "1970-01-01T00:00:00Z"

_TREE = ["file", "hot", "part"]


def warc_record(page_id: Column, url: Column, html: Column, date: str = NO_DATE) -> Column:
    """A resource record in WARC format: header lines, an empty line, the payload, two line ends.

    The record id is a name-based UUID of page id and address.
    """
    url, html = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    name = F.md5(F.concat_ws(" ", F.coalesce(page_id.cast("string"), F.lit("none")), url).cast("binary"))
    part = lambda at, size: F.substring(name, at, size)
    uuid = F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("3"), part(14, 3)), F.concat(F.lit("8"), part(18, 3)), part(21, 12))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url,
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Record-ID: <urn:uuid:"), uuid,
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"),
    )


def leaves(records: DataFrame) -> DataFrame:
    """page_id, length, content (hash) of each record (page_id, record); contents go no further than their hash."""
    record = F.coalesce("record", F.lit(""))
    return pick(records, "page_id", "record").select("page_id", F.octet_length(record).cast("long").alias("length"), F.sha2(record.cast("binary"), 256).alias("content"))


def crowded(sides: DataFrame) -> DataFrame:
    """page_id and files of each id with more than COPIES records in a replica: as many files as keep them near RECORDS_A_FILE."""
    counts = sides.groupBy("page_id").agg(F.count_if(~F.col("replica")).alias("ours"), F.count_if("replica").alias("theirs"))
    most = F.greatest("ours", "theirs")
    return counts.where(most > COPIES).select("page_id", F.ceil(most / RECORDS_A_FILE).cast("int").alias("files"))


def placed(sides: DataFrame, own_files: DataFrame) -> DataFrame:
    """The leaves with file, hot (the id of an archive of its own), part, place and copies."""
    id_, file = F.col("page_id"), F.floor(F.col("page_id") / RECORDS_A_FILE).cast("long")
    own = own_files.withColumnRenamed("page_id", "_own")
    dealt = sides.join(own, id_.eqNullSafe(F.col("_own")), "left").drop("_own")
    shared = dealt.where("files IS NULL").select(
        "replica", "page_id", "length", "content", file.alias("file"), F.lit(False).alias("hot"), F.lit(0).alias("part"),
        F.coalesce(id_ - file * RECORDS_A_FILE, F.lit(0)).cast("int").alias("place"), F.lit(1).cast("long").alias("copies"),
    )
    # Equal records meet before they are dealt, so that no file gathers more than different ones.
    alone = dealt.where("files IS NOT NULL").groupBy("replica", "page_id", "length", "content", "files").agg(F.count(F.lit(1)).alias("copies"))
    alone = alone.select(
        "replica", "page_id", "length", "content", id_.alias("file"), F.lit(True).alias("hot"), F.pmod(F.xxhash64("content"), F.col("files")).cast("int").alias("part"),
        F.pmod(F.xxhash64(F.lit(1), "content"), F.lit(RECORDS_A_FILE)).cast("int").alias("place"), "copies",
    )
    return shared.unionByName(alone)


def _children(at: Column, *rest: Column) -> Column:
    """The children of a node in order, each with its start, counted from the node's own."""
    ordered = F.array_sort(F.collect_list(F.struct(at.alias("at"), *rest)))
    first = F.transform(ordered, lambda c: c["length"])
    return F.transform(ordered, lambda c, k: c.withField("start", F.aggregate(F.slice(first, F.lit(1), k), F.lit(0).cast("long"), lambda a, x: a + x)))


def _digest(children: Column, line) -> Column:
    return F.sha2(F.array_join(F.transform(children, line), "|").cast("binary"), 256)


def trees(rows: DataFrame) -> DataFrame:
    """replica, file, hot, part, hash and length of each file's root and its nested branches, twigs and leaves.

    One exchange by file serves every level: what holds the rows of a file holds those of its branches.
    """
    by = ["replica", *_TREE]
    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), *by)
    # Records that share an id and bytes are told apart by a number; at most COPIES of them lie in one file.
    nth = F.row_number().over(Window.partitionBy(*by, "place", "page_id", "content").orderBy("length"))
    branch, twig = F.floor(F.col("place") / FANOUT**2).cast("int"), F.floor(F.col("place") / FANOUT).cast("int")
    numbered = dealt.withColumns({"nth": nth, "branch": branch, "twig": twig, "range": F.col("length") * F.col("copies")})
    # Leaves count their length once a copy.
    leaf = _children(F.struct("place", "page_id", "content", "nth"), F.col("range").alias("length"), F.col("copies"))
    ranged = lambda c: F.concat_ws(":", c["at"].cast("string"), c["start"].cast("string"), c["length"].cast("string"), c["hash"])
    told = lambda c: F.concat_ws(":", F.coalesce(c["at"]["page_id"].cast("string"), F.lit("none")), c["at"]["nth"].cast("string"), c["copies"].cast("string"), c["start"].cast("string"), c["length"].cast("string"), c["at"]["content"])
    low = numbered.groupBy(*by, "branch", "twig").agg(leaf.alias("kids"))
    low = low.select(*by, "branch", "twig", "kids", _digest(F.col("kids"), told).alias("hash"), _length("kids").alias("length"))
    for name, above in (("twig", [*by, "branch"]), ("branch", by)):
        low = low.groupBy(*above).agg(_children(F.col(name), F.col("length"), F.col("hash"), F.col("kids")).alias("kids"))
        low = low.select(*above, "kids", _digest(F.col("kids"), ranged).alias("hash"), _length("kids").alias("length"))
    return low


def _length(children: str) -> Column:
    return F.aggregate(children, F.lit(0).cast("long"), lambda a, c: a + c["length"])


def differing(stored: DataFrame) -> DataFrame:
    """file, hot, part of the files whose roots differ between the replicas; nothing but roots is read."""
    root = lambda replica: F.max(F.when(F.col("replica") == replica, F.col("hash")))
    roots = stored.groupBy(*_TREE).agg(root(F.lit(False)).alias("ours"), root(F.lit(True)).alias("theirs"))
    return roots.where(~F.col("ours").eqNullSafe(F.col("theirs"))).select(*_TREE)


def _opened(pairs: DataFrame) -> DataFrame:
    """The children of two nodes side by side, those that differ only; a node that one replica lacks is null there."""
    found = F.array_union(*(F.coalesce(F.transform(f"{side}.kids", lambda c: c["at"]), F.array().cast("array<int>")) for side in ("ours", "theirs")))
    each = pairs.withColumn("at", F.explode(found))
    for side in ("ours", "theirs"):
        kid = F.filter(f"{side}.kids", lambda c: c["at"] == F.col("at"))
        each = each.withColumn(f"{side}_kid", F.get(kid, F.lit(0)))
    each = each.where(~F.col("ours_kid.hash").eqNullSafe(F.col("theirs_kid.hash")))
    moved = [
        F.when(F.col(f"{side}_kid").isNotNull(), F.struct(F.col(f"{side}_kid.kids").alias("kids"), (F.col(f"{side}.base") + F.col(f"{side}_kid.start")).alias("base"))).alias(side)
        for side in ("ours", "theirs")
    ]
    return each.select(*_TREE, *moved)


def _unmatched(side: str, other: str) -> Column:
    """Leaves of a side with the copies that the other lacks, each with its offset and its rank among those of its id."""
    known = F.coalesce(F.transform(f"{other}.kids", lambda c: F.struct(c["at"], c["copies"])), F.array())
    held = lambda c: F.coalesce(F.get(F.filter(known, lambda o: o["at"] == c["at"]), F.lit(0))["copies"], F.lit(0))
    alone = F.filter(F.transform(f"{side}.kids", lambda c: c.withField("copies", c["copies"] - held(c))), lambda c: c["copies"] > 0)
    offset = lambda c: F.col(f"{side}.base") + c["start"]
    rows = F.transform(alone, lambda c: F.struct(c["at"]["page_id"].alias("page_id"), c["at"]["content"].alias("content"), offset(c).alias("offset"), c["copies"].alias("copies")))
    ranked = F.transform(rows, lambda c, k: c.withField("rank", F.size(F.filter(F.slice(rows, F.lit(1), k), lambda o: o["page_id"].eqNullSafe(c["page_id"])))))
    return F.coalesce(ranked, F.array())


def descend(suspects: DataFrame) -> DataFrame:
    """Damaged, missing and extra records of files (ours, theirs: both trees), opening only branches that differ."""
    for _ in range(2):
        suspects = _opened(suspects)
    both = suspects.select(*_TREE, _unmatched("ours", "theirs").alias("lost"), _unmatched("theirs", "ours").alias("found"))
    same = lambda a, b: a["page_id"].eqNullSafe(b["page_id"]) & (a["rank"] == b["rank"])
    paired = F.transform("lost", lambda a: F.struct(a.alias("ours"), F.get(F.filter("found", lambda b: same(a, b)), F.lit(0)).alias("theirs")))
    alone = F.filter("found", lambda b: ~F.exists("lost", lambda a: same(a, b)))
    extra = F.transform(alone, lambda b: F.struct(F.when(F.lit(False), F.get("lost", F.lit(0))).alias("ours"), b.alias("theirs")))
    rows = both.select(*_TREE, F.explode(F.concat(paired, extra)).alias("pair")).select(*_TREE, "pair.*")
    # Where numbers of copies differ, what is paired is damaged and the rest is missing or extra.
    ours, theirs = (F.coalesce(f"{side}.copies", F.lit(0)) for side in ("ours", "theirs"))
    parts = [("damaged", F.least(ours, theirs), True, True), ("missing", ours - theirs, True, False), ("extra", theirs - ours, False, True)]
    told = [
        F.struct(F.lit(kind).alias("kind"), copies.alias("copies"), F.lit(a).alias("a"), F.lit(b).alias("b")) for kind, copies, a, b in parts
    ]
    row = rows.select(*_TREE, "ours", "theirs", F.explode(F.filter(F.array(*told), lambda t: t["copies"] > 0)).alias("x"))
    held, other = (lambda c, flag=flag, side=side: F.when(F.col(f"x.{flag}"), F.col(f"{side}.{c}")) for flag, side in (("a", "ours"), ("b", "theirs")))
    return row.select(
        F.coalesce("ours.page_id", "theirs.page_id").alias("page_id"), F.when(~F.col("hot"), F.col("file")).alias("file"), "x.kind",
        held("content").alias("held_sha256"), other("content").alias("replica_sha256"), held("offset").alias("held_offset"), other("offset").alias("replica_offset"), "x.copies",
    )


def audit(held: DataFrame, replica: DataFrame) -> DataFrame:
    """Damaged, missing and extra records of the replica: page_id, file, kind, held and replica content hash and offset, copies."""
    with scratch(held.sparkSession):
        sides = [leaves(r).withColumn("replica", F.lit(name)) for r, name in ((held, False), (replica, True))]
        hashed = materialize(sides[0].unionByName(sides[1]), "leaves")
        stored = materialize(trees(placed(hashed, materialize(crowded(hashed), "crowded"))), "merkle")
        suspects = materialize(differing(stored), "suspects")
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _TREE]
        opened = stored.join(suspects.select(*(F.col(c).alias(f"_{c}") for c in _TREE)), same, "left_semi")
        top = F.struct("kids", F.lit(0).cast("long").alias("base"))
        both = opened.groupBy(*_TREE).agg(F.max_by(F.when(~F.col("replica"), top), ~F.col("replica")).alias("ours"), F.max_by(F.when(F.col("replica"), top), "replica").alias("theirs"))
        return materialize(descend(both), "audit", keep=True)


def op8_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of the pages in which some records are damaged and some are lost, by their ids."""
    pages = pick(read(spark, sf_dir, "pages"), "page_id", "url", "html")
    rest = F.pmod(F.col("page_id"), F.lit(DAMAGE_STEP))
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record")
    held = pages.select("page_id", record)
    # One character less in the payload, which shifts all later offsets of its file as well.
    damaged = F.when(rest == DAMAGED, F.substring("html", 2, 2**31 - 1)).otherwise(F.col("html"))
    replica = pages.where(F.coalesce(rest != LOST, F.lit(True))).withColumn("html", damaged).select("page_id", record)
    found = audit(held, replica)
    absent = {**dict.fromkeys(("held_sha256", "replica_sha256"), ""), **dict.fromkeys(("held_offset", "replica_offset"), -1)}
    return found.fillna(absent)


OP8_SQL = r"""
WITH record AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, page_id // 1000 AS file, page_id % 97 AS rest,
         md5(page_id::VARCHAR || ' ' || coalesce(url, '')) AS name FROM pages),
sides AS (
  SELECT page_id, file, 'held' AS side, url, name, html FROM record
  UNION ALL SELECT page_id, file, 'replica', url, name, CASE WHEN rest = 13 THEN substr(html, 2) ELSE html END FROM record WHERE rest <> 31),
built AS (
  SELECT *, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
    || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:'
    || substr(name, 1, 8) || '-' || substr(name, 9, 4) || '-3' || substr(name, 14, 3) || '-8' || substr(name, 18, 3) || '-' || substr(name, 21, 12)
    || '>' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)::VARCHAR
    || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM sides),
placed AS (
  SELECT page_id, file, side, sha256(rec) AS h, (sum(strlen(rec)) OVER (PARTITION BY side, file ORDER BY page_id) - strlen(rec))::BIGINT AS o FROM built)
SELECT a.page_id, a.file, CASE WHEN b.h IS NULL THEN 'missing' ELSE 'damaged' END AS kind,
       a.h AS held_sha256, coalesce(b.h, '') AS replica_sha256, a.o AS held_offset, coalesce(b.o, -1) AS replica_offset, 1::BIGINT AS copies
FROM (SELECT * FROM placed WHERE side = 'held') a LEFT JOIN (SELECT * FROM placed WHERE side = 'replica') b USING (page_id)
WHERE a.h IS DISTINCT FROM b.h
"""
