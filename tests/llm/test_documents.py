"""Operators on documents against plain versions of the same law, over odd tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline

from pagewright.llm import byte_bpe, decontamination, language_id, line_dedup, near_dedup, quality, sharding
from pagewright.llm.common import word_split

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rid long, hit string, `class` int, `key` string"
LONG = "abcdefg hij\n" * 9000
COMMON = "This line is common to many documents, and long enough."
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def rows(texts):
    return [(k, t, "en", "s", None, 0.5, 7, "h", 1, "k") for k, t in texts]


def table(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def odd_documents():
    base = prose(1, 200)
    edited = base.split()
    edited[50] = "changed"
    texts = [None, "", "!!!", "  \n ", LONG, "x" * 300_000, "one two", "one two", base, base, " ".join(edited), base + " tail end", prose(2, 200), prose(3, 30), "Ünï çödé 章章 🙂"]
    out = list(enumerate(texts))
    out += [(100 + k, f"first {k}\n  {COMMON.upper() if k % 2 else COMMON}\t\nlast {k}\n{COMMON}") for k in range(6)]
    return [*out, (100, f"first 0\n{COMMON}"), (8, base), (None, COMMON), (None, None), (None, base)]


ODD = odd_documents()
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    return WORD.findall(lower(text))


def test_words_are_those_of_the_pattern():
    for _, text in ODD:
        assert [w.decode() for w in word_split((text or "").encode())] == words_of(text)


# -- line dedup


def plain_lines(docs, min_chars=40, min_docs=5):
    holders = collections.defaultdict(set)
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    rank = lambda d: line_dedup.NO_ID if d is None else d
    for d, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(rank(d))
    out = []
    for d, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or rank(d) == max(holders[key(x)])]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def digest_lines(df):
    from pyspark.sql.types import StructType

    assert isinstance(df.schema, StructType)
    docs = df.select("doc_id", "text")
    found = line_dedup.with_bitmaps(docs, line_dedup.keep_bitmaps(docs)).mapInArrow(line_dedup._digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_line_dedup(spark):
    assert digest_lines(table(spark, ODD)) == plain_lines(ODD)
    kept = line_dedup.dedup_lines(table(spark, ODD))
    assert kept.columns == table(spark, []).columns and kept.count() == len(ODD)
    assert {r.text for r in kept.where("doc_id = 105").collect()} == {f"first 5\n  {COMMON.upper()}\t\nlast 5\n{COMMON}"}
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


@pytest.mark.parametrize("flush", [1, 3, 7, 1000])
def test_lines_stream_alike_for_any_flush(monkeypatch, flush):
    monkeypatch.setattr(line_dedup, "FLUSH_KEYS", flush)
    rng = random.Random(flush)
    docs = [(d, "\n".join(rng.choice("abcdef") * 50 for _ in range(3))) for d in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array([d]), pa.array([zlib.crc32(t.encode())]), pa.array([t])], names=["doc_id", "text_h", "text"]) for d, t in docs]
    lines = [tuple(r.values()) for b in line_dedup._hashed_lines(40, 5)(iter(batches)) for r in b.to_pylist()]
    lines.sort(key=lambda r: (r[0], r[1], -r[2]))
    back = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*lines), line_dedup._LINE_ROWS)], schema=line_dedup._LINE_ROWS)
    dropped = collections.Counter()
    for b in line_dedup._first_occurrences(5)(iter([back])):
        for r in b.to_pylist():
            dropped[r["doc_id"]] += len(r["at"]) // 4
    assert {d: n for d, _, n, _ in plain_lines(docs) if n} == dict(dropped)


def test_lines_of_rows_that_repeat_whole(spark):
    docs = [(7, f"{COMMON}\nown\n{COMMON}")] * 300 + [(k, f"{COMMON}\nlast {k}") for k in range(8, 12)] + [(None, f"{COMMON} and\nmore of the same")] * 40
    assert digest_lines(table(spark, docs)) == plain_lines(docs)


# -- near duplicates


def plain_classes(docs):
    cache = near_dedup._Words()
    ids, marks = [], {}
    for k, (d, text) in enumerate(docs):
        if d is None and text is None:
            continue
        ids.append(d if d is not None else ("null", text))
        marks[k] = (ids[-1], near_dedup.labels(word_split((text or "").encode()), cache))
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (ia, ma) in marks.items():
        for b, (ib, mb) in marks.items():
            if a < b and len(ma) and len(mb) and near_dedup.alignment(ma, mb) >= 0.8:
                parent[find(ia)] = find(ib)
    groups = collections.defaultdict(set)
    for i in parent:
        groups[find(i)].add(i if not isinstance(i, tuple) else None)
    return sorted(map(str, (sorted(map(str, g)) for g in groups.values())))


def test_near_duplicates(spark):
    df = table(spark, ODD)
    found = near_dedup.near_classes(df)
    named = df.select("doc_id", "text", near_dedup.row_id().alias("rid")).join(found, "rid").where("doc_id IS NOT NULL OR text IS NOT NULL")
    groups = collections.defaultdict(set)
    for r in named.collect():
        groups[r["class"]].add(str(r.doc_id))
    assert sorted(map(str, map(sorted, groups.values()))) == plain_classes(ODD)
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {0, 1, 2, 3, 4, 5, 6, 12, 13, 14}
    assert not {7, 9, 10} & {r.doc_id for r in kept.collect()}
    assert near_dedup.keep_one(table(spark, [])).count() == 0


def test_near_duplicate_families(spark):
    rng = random.Random(5)
    docs = []
    for family in range(6):
        base = prose(100 + family, 120).split()
        for k in range(12):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(1000)}"
            docs.append((len(docs), " ".join(copy)))
    got = {r.rid: r["class"] for r in near_dedup.near_classes(table(spark, docs)).collect()}
    groups = collections.defaultdict(set)
    for rid, cls in got.items():
        groups[cls].add(str(rid))
    assert sorted(map(str, map(sorted, groups.values()))) == plain_classes(docs)


def test_an_id_of_many_texts_links_the_near_copies_of_each(spark):
    docs = []
    for k in range(8):
        base = prose(400 + k, 100)
        docs += [(7, base), (100 + k, base.replace(base.split()[50], "edited", 1))]
    docs += [(3, prose(410, 100)), (7, None), (5, "")]
    got = {r.rid: r["class"] for r in near_dedup.near_classes(table(spark, docs)).collect()}
    assert got == {7: 7, 3: 3, 5: 5, **{100 + k: 7 for k in range(8)}}


def test_one_row_of_a_class_stays(spark):
    base, other = prose(420, 80), prose(421, 80)
    docs = [(None, base)] * 3 + [(4, other)] * 3 + [(9, other)] * 2 + [(6, prose(422, 80)), (6, prose(423, 80)), (8, ""), (11, "")] + [(None, None)] * 2
    rows_ = rows(docs)
    rows_.append((4, other, "de", *rows_[0][3:]))
    df = spark.createDataFrame(rows_, SCHEMA)
    kept = [near_dedup.keep_one(df.repartition(n)) for n in (1, 3)]
    got = [sorted(map(str, k.collect())) for k in kept]
    assert kept[0].schema == df.schema and got[0] == got[1]
    stay = sorted((r.doc_id or 0, r.text or "") for r in kept[0].collect())
    assert stay == sorted([(0, base), (0, ""), (4, other), (6, prose(422, 80)), (6, prose(423, 80)), (8, ""), (11, "")])


def test_an_id_of_two_texts_does_not_unite_them(spark):
    one, two = prose(430, 90), prose(431, 90)
    docs = [(10, one), (11, two), (12, one), (12, two), (5, one.replace(one.split()[40], "edited", 1))]
    kept = near_dedup.keep_one(table(spark, docs)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(5, docs[-1][1]), (11, two)])


def test_no_column_clashes_with_the_operators(spark):
    docs = [(k, f"{prose(440 + k % 3, 60)}\n{COMMON}") for k in range(9)]
    names = ["_rid", "_id", "_h", "_bitmap", "_row", "_text_h", "_row_h", "_doc", "_hit", "_n_words", "lang_pred", "node", "class", "rid"]
    df = spark.createDataFrame([(d, t, *(f"{n} {d}" for n in names)) for d, t in docs], ["doc_id", "text", *names])
    lined = line_dedup.dedup_lines(df)
    single = near_dedup.keep_one(lined)
    bench = spark.createDataFrame([(1, " ".join(docs[1][1].split()[:12])), (2, " ".join(f"other{k}" for k in range(40)))], "item_id long, text string")
    clean = decontamination.decontaminate(single, bench, max_words=20)
    assert lined.columns == single.columns == clean.columns == df.columns and lined.count() == 9
    rest = clean.collect()
    assert len(rest) == 3 and all(r[n] == f"{n} {r.doc_id}" for r in rest for n in names) and all(COMMON not in r.text for r in rest)


def test_alignment_respects_order():
    cache = near_dedup._Words()
    a = near_dedup.labels(word_split(prose(9, 100).encode()), cache)
    assert near_dedup.alignment(a, a) == 1 and near_dedup.alignment(a, np.concatenate((a[50:], a[:50]))) < 0.8
    assert near_dedup.alignment(a, a[:90]) == pytest.approx(90 / 96) and near_dedup.alignment(a, a[:10]) == 0


def plain_similarity(a, b):
    """Longest common subsequence of the occurrence-labelled shingles of five words, by the full table, over their union."""
    sides = []
    for words in (a, b):
        seen = collections.Counter()
        size = min(5, len(words))
        marks = []
        for k in range(len(words) - size + 1 if words else 0):
            shingle = tuple(words[k : k + size])
            marks.append((shingle, seen[shingle]))
            seen[shingle] += 1
        sides.append(marks)
    x, y = sides
    row = [0] * (len(y) + 1)
    for p in x:
        last = 0
        for k, q in enumerate(y):
            last, row[k + 1] = row[k + 1], last + 1 if p == q else max(row[k + 1], row[k])
    return row[-1] / (len(x) + len(y) - row[-1]) if x or y else 0.0


def edited(rng, words):
    out = list(words)
    for _ in range(rng.randrange(3)):
        kind, at = rng.randrange(4), rng.randrange(len(out))
        if kind == 0:
            out[at] = f"new{rng.randrange(99)}"
        elif kind == 1:
            del out[at]
        elif kind == 2:
            out[at:at] = out[at : at + rng.randrange(1, 12)]
        else:
            cut = rng.randrange(1, 15)
            block = out[at : at + cut]
            del out[at : at + cut]
            to = rng.randrange(len(out) + 1)
            out[to:to] = block
    return out


def test_alignment_by_a_plain_version():
    rng, cache, near = random.Random(21), near_dedup._Words(), 0
    marks = lambda words: near_dedup.labels([w.encode() for w in words], cache)
    for k in range(250):
        base = [rng.choice(WORDS[:6]) if k % 3 == 0 else rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(rng.randrange(1, 160))]
        a, b = edited(rng, base), edited(rng, base)
        want, got = plain_similarity(a, b), near_dedup.alignment(marks(a), marks(b))
        assert (got >= 0.8) == (want >= 0.8) and (want < 0.8 or got == pytest.approx(want))
        near += want >= 0.8
    assert 60 < near < 200


def test_classes_by_a_plain_version(spark):
    """Near copies of several families and everything between them, by all pairs and nothing of the operator's own."""
    rng = random.Random(31)
    docs = []
    for family in range(4):
        base = prose(600 + family, 50).split()
        docs += [(10 * family + k, " ".join(edited(rng, base))) for k in range(8)]
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (d, text) in enumerate(docs):
        for e, other in docs[:k]:
            if plain_similarity(words_of(text), words_of(other)) >= 0.8:
                parent[find(d)] = find(e)
    groups, want = collections.defaultdict(set), collections.defaultdict(set)
    for r in near_dedup.near_classes(table(spark, docs)).collect():
        groups[r["class"]].add(r.rid)
    for d, _ in docs:
        want[find(d)].add(d)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values())) and len(want) > 4


def test_classes_of_long_chains(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (5, 200), (7, 7)]
    got = {r.node: r["class"] for r in near_dedup.classes_of(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in range(41)} == {0} and got[200] == 0 and got[101] == 100


# -- decontamination

ITEMS = [(1, " ".join(WORDS[:12])), (2, "Short item here"), (3, None), (4, "..."), (5, " ".join(WORDS[5:18])), (5, "Another text"), (6, "alpha")]


def plain_hits(text, items, window=10):
    w, hit, who = words_of(text), set(), set()
    for item, t in items:
        v = words_of(t)
        size = min(window, len(v))
        grams = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if v else set()
        for k in range(len(w) - size + 1 if v else 0):
            if tuple(w[k : k + size]) in grams:
                hit |= set(range(k, k + size))
                who.add(str(item))
    return len(w), len(hit), ",".join(sorted(who))


@pytest.mark.parametrize("max_words", [100_000, 10])
def test_decontamination(spark, max_words):
    rng = random.Random(3)
    texts = [*ODD, *((500 + k, " ".join(rng.choice(["x", *WORDS[:14]]) for _ in range(30)) + " " + " ".join(WORDS[rng.randrange(6) : rng.randrange(9, 20)]) + " SHORT, item-here!") for k in range(40))]
    items = ITEMS if max_words == 10 else ITEMS[:-1]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, hit int")
    found = decontamination.scan_documents(table(spark, texts), bench, max_words=max_words)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, 0 if r.hit is None else int(np.unpackbits(np.frombuffer(r.hit, np.uint8)).sum()), ",".join(r["items"])) for r in found.collect())
    want = sorted((d if d is not None else -1, *plain_hits(t, items)) for d, t in texts)
    assert got == want
    clean = decontamination.decontaminate(table(spark, texts), bench)
    assert all(plain_hits(r.text, items)[1] == 0 for r in clean.collect()) and clean.columns == table(spark, []).columns
    untouched = {d for d, t in texts if not plain_hits(t, items)[1]}
    assert untouched <= {r.doc_id for r in clean.collect()} and {r.text for r in clean.where("doc_id = 8").collect()} == {ODD[8][1]}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.scan_documents(table(spark, texts), empty).where("hit IS NOT NULL").count() == 0


def test_decontamination_is_alike_for_any_number_of_groups(spark):
    long = [(k, " ".join(f"item{k}w{j}" for j in range(60))) for k in range(4)]
    a, b = (t.split() for _, t in long[:2])
    filler = prose(40, 15).split()
    docs = [
        (1, " ".join(a[:45] + b[:40] + filler)),
        (2, " ".join(filler + a[:45] + b[:40])),
        # The cut of one item's window joins the halves of another's.
        (3, " ".join(prose(41, 60).split() + a[10:17] + b[5:20] + a[17:24] + prose(42, 60).split())),
        (4, " ".join(prose(43, 60).split() + b[10:17] + a[5:20] + b[17:24] + prose(44, 60).split())),
        (5, prose(45, 50)), (6, None), (None, long[2][1]), (None, " ".join(filler * 4 + a[:12])), (None, " ".join(filler * 4 + a[:12])),
    ]
    bench = spark.createDataFrame(long, "item_id long, text string")
    df = table(spark, docs)
    groups = list(decontamination.automata(bench, max_words=20))
    homes = [next(k for k, g in enumerate(groups) if w[0].encode() in g.vocabulary) for w in (a, b)]
    assert len(groups) > 1 and homes[0] != homes[1]
    single, several = (sorted(map(str, decontamination.decontaminate(df, bench, max_words=m).collect())) for m in (100_000, 20))
    assert several == single and len(single) == 6


# -- tokens


def test_byte_bpe(spark):
    import tiktoken

    path, pattern = byte_bpe.public_vocabulary()
    vocabulary = byte_bpe.Vocabulary.parse(open(path, "rb").read())
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})
    extra = [(900, "<|endoftext|> it's  they'll\t\t\n\n  x=====$$$ 12345 ÀÉ"), (901, "a" * 5000), (902, " " * 3000 + "b")]
    got = sorted(byte_bpe.encode(table(spark, [*ODD, *extra]), path, pattern).collect(), key=lambda r: (str(r.doc_id), r.ids_sha256))
    want = []
    for d, t in [*ODD, *extra]:
        ids = theirs.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: (str(r[0]), r[2]))
    assert byte_bpe.encode(table(spark, []), path, pattern).count() == 0


def test_prefixes_append_and_edit():
    path, _ = byte_bpe.public_vocabulary()
    vocabulary = byte_bpe.Vocabulary.parse(open(path, "rb").read())
    rng = random.Random(8)
    for _ in range(60):
        data = bytes(rng.choice(b"the quickest \xc3\xa9$$$====ing") for _ in range(rng.randrange(1, 60)))
        whole = byte_bpe.PrefixEncoder(vocabulary, data)
        assert whole.ids() == vocabulary.merged(data)
        parts = byte_bpe.PrefixEncoder(vocabulary)
        for k in range(0, len(data), 7):
            parts.append(data[k : k + 7])
        assert list(parts.last) == list(whole.last)
        a, b = sorted((rng.randrange(len(data)), rng.randrange(len(data))))
        whole.replace(a, b, b"new")
        assert whole.ids() == vocabulary.merged(data[:a] + b"new" + data[b:])
    long = byte_bpe.PrefixEncoder(vocabulary, b"some words here " * 200)
    assert long.replace(100, 104, b"other") < 400 and long.ids() == byte_bpe.PrefixEncoder(vocabulary, bytes(long.data)).ids()


# -- sharding


def plain_slot(doc, text):
    """The slot by the published hash, one column's hash seeding the next."""
    seed = 42
    for part in ("" if doc is None else str(doc), text or ""):
        seed = xxhash.xxh64_intdigest(part.encode(), seed=seed)
    return (seed - (1 << 64) if seed >= 1 << 63 else seed) % sharding.VIRTUAL_SLOTS


def shard_bytes(placed, shards):
    out = [0] * shards
    for r in placed:
        out[r.shard] += r["size"]
    return out


def gapless(placed, shards):
    return all(sorted(r.slot for r in placed if r.shard == k) == list(range(sum(r.shard == k for r in placed))) for k in range(shards))


def test_sharding_by_a_plain_version(spark, tmp_path):
    docs = [(k, prose(k, 20 + k % 50)) for k in range(600)] + [*ODD]
    placed = sharding.shard(table(spark, docs), f"{tmp_path}/map", 4).collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in placed) == sorted((str(d), 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for d, t in docs)
    assert gapless(placed, 4) and {r.map_version for r in placed} == {2}
    current, first = sharding.stored_map(spark, f"{tmp_path}/map"), sharding.stored_map(spark, f"{tmp_path}/map", 1)
    assert current.version == 2 and first.assignment[:9] == (0, 1, 2, 3, 0, 1, 2, 3, 0) and first.splits == current.splits
    split_slots = {s for s, *_ in current.splits}
    homes = collections.Counter((plain_slot(d, t), zlib.crc32((t or "").encode())) for d, t in docs)
    pieces = {first_ + k: slot for slot, first_, n in current.splits for k in range(n)}
    assert collections.Counter((pieces.get(r.vslot, r.vslot), r.text_crc32) for r in placed) == homes
    assert all(r.shard == current.assignment[r.vslot] and (r.vslot not in split_slots) for r in placed)
    # Positions follow slot by slot, and by id inside.
    for k in range(4):
        own = sorted((r for r in placed if r.shard == k), key=lambda r: r.slot)
        assert [r.vslot for r in own] == sorted(r.vslot for r in own)
    empty = sharding.shard(table(spark, []), f"{tmp_path}/none", 4)
    assert empty.count() == 0 and sharding.stored_map(spark, f"{tmp_path}/none").version == 2


@pytest.mark.parametrize("docs", [
    [(None, prose(k, 30)) for k in range(500)], [(7, prose(k, 30)) for k in range(500)], [(None, None)] * 500, [(7, prose(1, 30))] * 500,
    [(7, "x" * 300)] * 200 + [(k, prose(k, 40)) for k in range(400)],
])
def test_shards_are_near_equal_whatever_repeats(spark, tmp_path, docs):
    placed = sharding.shard(table(spark, docs), f"{tmp_path}/map", 4).collect()
    held = shard_bytes(placed, 4)
    assert len(placed) == len(docs) and gapless(placed, 4)
    assert max(held) - min(held) <= 2 * max(r["size"] for r in placed) + 0.1 * sum(held) / 4


def test_rebalancing_moves_little():
    rng = random.Random(1)
    loads = {s: (rng.randrange(1, 5000), 1) for s in range(sharding.VIRTUAL_SLOTS)}
    first = sharding.rebalance(sharding.dealt_in_turn(), loads, 24)

    def held(m):
        out = [0] * m.shards
        for slot, shard in enumerate(m.assignment):
            out[shard] += loads[slot][0]
        return out

    assert first.version == 2 and max(held(first)) <= 1.001 * min(held(first))
    grown = sharding.rebalance(first, loads, 25)
    assert grown.version == 3 and max(held(grown)) < 1.02 * min(held(grown))
    moved = sum(loads[s][0] for s in loads if first.assignment[s] != grown.assignment[s])
    assert moved < 1.1 * sum(held(first)) / 25
    assert max(sharding.rebalance(grown, loads, 20).assignment) == 19


# -- classifiers


def test_language_model_is_naive_bayes():
    texts = ["Hello world", "", None, "123 !!", "éé ab", "x", "İstanbul AB", "word " * 50]
    rng = np.random.default_rng(1)
    model = language_id.LanguageModel(("a", "b"), rng.random((1 << language_id.BUCKET_BITS, 2)).astype(np.float32), np.log([0.6, 0.4]))
    for size in (7, language_id.PIECE_CHARS):
        old = language_id.pieces.__defaults__
        language_id.pieces.__defaults__ = (size,)
        try:
            langs, scores = model.score(texts)
        finally:
            language_id.pieces.__defaults__ = old
        for text, lang, score in zip(texts, langs, scores):
            if not any(c.isalpha() for c in text or ""):
                assert (lang, score) == ("und", 0.0)
                continue
            points = np.array([ord(c) if c.isalpha() else 32 for c in text.lower()] + [32, 32], np.uint32)
            sums = sum(model.log_probability[language_id.buckets(points, o)].astype(float).sum(0) for o in language_id.ORDERS) / 3 + model.prior
            spread = np.exp(sums - sums.max())
            assert lang == "ab"[sums.argmax()] and score == pytest.approx(spread.max() / spread.sum())


def test_language_id_learns(spark):
    english, german = "the and of this with that from have".split(), "der die und nicht für über schön müssen".split()
    rng = random.Random(2)
    rows_ = [(k, " ".join(rng.choice(g) for _ in range(20)), lang) for k, (g, lang) in enumerate([(english, "en"), (german, "de")] * 60)]
    rows_ += [(500, None, "en"), (501, "", None), (502, "12 34", "de"), (503, LONG, None), (None, "und nicht für", None), (None, None, None)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("hit", F.lit(1))
    got = language_id.identify(df, language_id.learn(df)).collect()
    assert len(got) == len(rows_)
    for r in got:
        assert r.lang_pred == (r.lang if r.doc_id is not None and r.doc_id < 500 else "de" if r.text == "und nicht für" else r.lang_pred) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    nothing = language_id.train(df.limit(0))
    assert {r.lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"} and language_id.identify(df.limit(0), nothing).count() == 0


def test_text_of_a_language_never_learned_does_not_fit(spark):
    english, german = "the and of this with that from have".split(), "der die und nicht für über schön müssen".split()
    rng = random.Random(2)
    rows_ = [(k, " ".join(rng.choice(g) for _ in range(20)), lang) for k, (g, lang) in enumerate([(english, "en"), (german, "de")] * 60)]
    rows_ += [(500, "Быстрая коричневая лиса прыгает через ленивую собаку", None), (501, "zxqv kjwq vvxz qqkz xwjv zzqk jxvq", None), (502, "敏捷的棕色狐狸跳过懒狗", None), (503, "12", None)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    got = {r.doc_id: r.fit for r in language_id.identify(df, language_id.learn(df)).collect()}
    assert all(got[k] > 0.95 for k in range(120)) and all(got[k] < 0.3 for k in range(500, 504))
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, df, "").collect()}
    assert kept == set(range(120))


def test_quality_learns(spark):
    rng = random.Random(4)
    good = lambda: prose(rng.random(), 40)
    bad = lambda: " ".join(w + "$$$%%%" for w in prose(rng.random(), 40).split())
    docs = [(k, good() if k % 2 else bad(), 3) for k in range(120)] + [(500, None, 1), (501, "", 1), (502, LONG, 1), (503, "y" * 600_000, 1), (3, "z", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(90)] + [(500, None, 0), (501, 5, 0), (None, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    odds = quality.train(df, labels)
    got = quality.score(df.select("doc_id", "text"), odds).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if 90 <= r.doc_id < 120)
    assert {r.score for r in quality.score(df.select("doc_id", "text"), quality.train(df, labels.limit(0))).collect()} == {0.5}


def plain_features(text):
    """Words, their n-grams with a space at either end, and repetitions, one by one."""
    points = [32, *(32 if ord(c) < 32 or ord(c) in (0x85, 0xA0) else ord(c) for c in text), 32]
    found, words = [quality._EVERY], []
    for order in quality.ORDERS:
        for k in range(len(points) - order + 1):
            part = points[k : k + order]
            if 32 in part[1:-1]:
                continue
            h = order * 0x9E3779B1 & 0xFFFFFFFF
            for p in part:
                h = (h ^ p) * 0x01000193 & 0xFFFFFFFF
                h ^= h >> 15
            found.append((h * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - quality.BUCKET_BITS))
    for word in bytes.decode(b"".join(c.to_bytes(4, "little") for c in points), "utf-32-le").split(" "):
        if word:
            words.append(word)
            h = sum(ord(c) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(word)) & (1 << 64) - 1
            h ^= h >> 29
            found.append((h * 0xBF58476D1CE4E5B9 & (1 << 64) - 1) >> (64 - quality.BUCKET_BITS))
    for lag in quality.REPEATS:
        found += [lag] * sum(a == b for a, b in zip(words, words[lag:]))
    return collections.Counter(found)


@pytest.mark.parametrize("text", ["", "a", "one two two one two", "tab\tand\u00a0space", "Ünï çödé 章章 🙂", "aa aa aa b"])
def test_quality_features(text):
    at, counts = quality.document_features(text)
    assert dict(zip(at.tolist(), counts.tolist())) == dict(plain_features(text))


def test_quality_descends_the_gradient():
    """The fit against one that takes each step from the definition, number by number."""
    rng = random.Random(3)
    samples = [(k % 2, np.array(sorted(rng.sample(range(40), 6)), np.uint32), np.array([rng.randrange(1, 4) for _ in range(6)], np.uint32)) for k in range(12)]
    d, steps, rate = 3, 60, 0.4
    draw = np.random.default_rng(7)
    vectors = [[float(x) for x in row] for row in ((draw.random((1 << quality.BUCKET_BITS, d), dtype=np.float32) - 0.5) * (2 / d)).astype(np.float32)[:40]]
    outputs = [[0.0] * d, [0.0] * d]
    groups = [[k for k, s in enumerate(samples) if s[0] == label] for label in (0, 1)]
    order = [k for pair in zip(*(np.resize(draw.permutation(g), steps // 2).tolist() for g in groups)) for k in pair]
    for done, k in enumerate(order):
        label, at, counts = samples[k]
        total = int(counts.sum())
        hidden = [sum(int(c) / total * vectors[a][j] for a, c in zip(at, counts)) for j in range(d)]
        logits = [sum(o[j] * hidden[j] for j in range(d)) for o in outputs]
        chance = [math.exp(x) / sum(map(math.exp, logits)) for x in logits]
        slope = [chance[i] - (i == label) for i in (0, 1)]
        now = rate * (1 - done / steps)
        pull = [sum(slope[i] * outputs[i][j] for i in (0, 1)) for j in range(d)]
        for i in (0, 1):
            outputs[i] = [outputs[i][j] - now * slope[i] * hidden[j] for j in range(d)]
        for a, c in zip(at, counts):
            vectors[a] = [vectors[a][j] - now * int(c) / total * pull[j] for j in range(d)]
    want = [sum(v[j] * (outputs[1][j] - outputs[0][j]) for j in range(d)) for v in vectors]
    assert quality.fit(samples, d, steps, rate)[:40] == pytest.approx(want, abs=1e-5)


def test_quality_pieces_cover_whole_texts():
    text = prose(6, 300)
    whole, cut = (np.sort(np.concatenate([quality.features(p) for p in quality.pieces(text, size)])) for size in (1 << 18, 200))
    words = [p for p in quality.pieces(text, 200)]
    assert len(words) > 1 and abs(len(whole) - len(cut)) < 8 * len(words) and set(cut) <= set(whole)


@pytest.mark.parametrize("members", [1024, 5])
def test_blocks_find_links_that_hubs_miss(spark, monkeypatch, members):
    """A family whose copies differ so much that many reach no hub but each other."""
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", members)
    rng = random.Random(12)
    base = prose(300, 150).split()
    docs = []
    for _ in range(60):
        copy = list(base)
        for k in rng.sample(range(0, 150, 15), rng.randrange(1, 6)):
            copy[k] = f"edit{rng.randrange(3)}"
        docs.append((len(docs), " ".join(copy)))
    got = collections.defaultdict(set)
    for r in near_dedup.near_classes(table(spark, docs)).collect():
        got[r["class"]].add(str(r.rid))
    assert sorted(map(str, map(sorted, got.values()))) == plain_classes(docs)


def test_shared_counts():
    rng = np.random.default_rng(2)
    seqs = [np.unique(rng.integers(0, 80, rng.integers(1, 60))).astype(np.uint32) for _ in range(70)]
    counts = near_dedup.shared_counts(seqs)
    for a in range(0, 70, 3):
        for b in range(70):
            assert a == b or counts[a, b] == len(np.intersect1d(seqs[a], seqs[b]))
