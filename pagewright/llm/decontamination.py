"""Benchmark decontamination with a suffix automaton of the test items.

The items' word sequences are joined by separators no document can hold, and one automaton recognises every substring of
them. A document's words stream through it: the state gives the longest match that ends at each word. A window is
`window` consecutive item words (a shorter item is one window as a whole); words inside any window are hit.

The automaton is broadcast only below `MAX_ITEM_WORDS` item words. A larger benchmark is cut into groups of items under
that size, each scanned on its own, and the hits of a document are united; so any benchmark size works. Cutting does the same:
each round unites the hits of all groups before it judges and cuts, and documents that were cut go through another round
until no group hits them, so results do not depend on the number of groups.

Defined cases: null or wordless texts and items match nothing; items that repeat an id count once; a null item_id is the
empty text; rows that repeat a doc_id are judged each on its own text; extra columns are ignored or kept as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import fresh, materialize, pick, read, released, word_split

WINDOW = 10
MAX_ITEM_WORDS = 100_000
MAX_COVERAGE = 0.8
_FILTER_BITS = 22
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


class ItemAutomaton:
    """Suffix automaton over the words of test items, with marks where windows end."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: Items whose window of full size is the state's substring of that size, and shorter items that the state spells.
        self.full: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]) for item, words in items if words]
        self.shortest = min([window, *(len(w) for _, w in coded)])
        last = 0
        for k, (_, words) in enumerate(coded):
            for word in (*words, -1 - k):
                last = self._extend(last, word)
        for item, words in coded:
            self._mark(item, words)
        self._climb()
        self.pairs = np.zeros(1 << _FILTER_BITS, bool)
        for _, words in coded:
            ids = np.array(words, np.int64)
            self.pairs[self._pair(ids[:-1], ids[1:])] = True

    @staticmethod
    def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left * 40_503 + right * 2_654_435_761) & ((1 << _FILTER_BITS) - 1)

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.length) - 1

    def _extend(self, last: int, word: int) -> int:
        new, at = self._state(self.length[last] + 1, {}, 0), last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at >= 0:
            reached = self.step[at][word]
            if self.length[reached] == self.length[at] + 1:
                self.link[new] = reached
            else:
                split = self._state(self.length[at] + 1, dict(self.step[reached]), self.link[reached])
                while at >= 0 and self.step[at].get(word) == reached:
                    self.step[at][word] = split
                    at = self.link[at]
                self.link[reached] = self.link[new] = split
        return new

    def _mark(self, item: str, words: list[int]) -> None:
        state, matched = 0, 0
        for word in words:
            state, matched = self.step[state][word], matched + 1
            if matched > self.window:
                matched = self.window
            while self.length[self.link[state]] >= matched:
                state = self.link[state]
            if matched == self.window:
                self.full.setdefault(state, set()).add(item)
        if len(words) < self.window:
            self.short.setdefault(state, []).append((len(words), item))

    def _climb(self) -> None:
        """For each state, the nearest states on its suffix path (itself included) with a full window and with short items."""
        n = len(self.link)
        self.to_full, self.to_short = [-1] * n, [-1] * n
        for state in sorted(range(n), key=self.length.__getitem__):
            up = self.link[state]
            self.to_full[state] = state if state in self.full else self.to_full[up] if up >= 0 else -1
            self.to_short[state] = state if state in self.short else self.to_short[up] if up >= 0 else -1

    def _run(self, ids: list[int], hit: np.ndarray, items: set[str], start: int) -> None:
        """Stream one run of known words; marks what windows cover."""
        step, link, length, window = self.step, self.link, self.length, self.window
        state = matched = 0
        for at, word in enumerate(ids, start + 1):
            while state and word not in step[state]:
                state = link[state]
                matched = length[state]
            if word in step[state]:
                state, matched = step[state][word], matched + 1
            if matched >= window and (full := self.to_full[state]) >= 0:
                hit[at - window : at] = True
                items |= self.full[full]
            ending = self.to_short[state]
            while ending >= 0:
                for size, item in self.short[ending]:
                    if size <= matched:
                        hit[at - size : at] = True
                        items.add(item)
                up = link[ending]
                ending = self.to_short[up] if up >= 0 else -1

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Which words are hit (None: none) and by which items. Only runs of known neighbours enter the automaton."""
        items: set[str] = set()
        n = len(words)
        if n < self.shortest or not self.vocabulary:
            return None, items
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, n)
        joined = self.pairs[self._pair(ids[:-1], ids[1:])] & (ids[:-1] > 0) & (ids[1:] > 0)
        edges = np.flatnonzero(np.concatenate(([True], ~joined, [True])))
        long = np.diff(edges) >= self.shortest
        if not long.any():
            return None, items
        hit = np.zeros(n, bool)
        for start, end in zip(edges[:-1][long].tolist(), edges[1:][long].tolist()):
            if ids[start]:
                self._run(ids[start:end].tolist(), hit, items, start)
        return (hit, items) if items else (None, items)


def automata(benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_ITEM_WORDS) -> Iterator[ItemAutomaton]:
    """One automaton for each group of items of at most about `max_words` words; each group is fetched by itself."""
    rows = pick(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    size = rows.select(F.sum(F.length("text")).alias("n")).first().n or 0
    # A word and its separator take two characters at least.
    groups = max(1, -(-size // (2 * max_words)))
    for group in range(groups):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == group) if groups > 1 else rows
        yield ItemAutomaton([(r.item, word_split((r.text or "").encode())) for r in part.toLocalIterator()], window)


_HIT_ROWS = "n_words long, hit binary, items array<string>"


def _scanner(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            counts, hits, items = [], [], []
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                words = word_split(raw or b"")
                hit, found = automaton.scan(words)
                counts.append(len(words))
                hits.append(None if hit is None else np.packbits(hit).tobytes())
                items.append(sorted(found))
            kept = [batch.column(f.name) for f in batch.schema if f.name != "text"]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(counts, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))],
                names=[*(f.name for f in batch.schema if f.name != "text"), "n_words", "hit", "items"],
            )

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = []
        for parts in batch.column("hits").to_pylist():
            whole = np.frombuffer(parts[0], np.uint8) if parts else None
            for part in parts[1:]:
                whole = whole | np.frombuffer(part, np.uint8)
            hits.append(None if whole is None else whole.tobytes())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "text_h", "n_words")), pa.array(hits, pa.binary()), batch.column("items")],
            names=["doc_id", "text_h", "n_words", "hit", "items"],
        )


def _scans(docs: DataFrame, groups: list) -> list[DataFrame]:
    """doc_id, text_h, n_words, hit, items of every row by each group's automaton (broadcast)."""
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_h"), "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_h long, "
    return [rows.mapInArrow(_scanner(shared), schema + _HIT_ROWS) for shared in groups]


def _united_hits(scans: list[DataFrame], copies: bool = True) -> DataFrame:
    """The hits of all scans for each row, or, without `copies`, once for all equal rows."""
    together = reduce(DataFrame.unionByName, scans[1:], scans[0])
    # Equal rows meet here; they have equal results, so each group stands for all its copies, told apart by the count.
    grouped = together.groupBy("doc_id", "text_h").agg(
        F.max("n_words").alias("n_words"), F.collect_set("hit").alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        (F.count(F.lit(1)) / len(scans)).cast("int").alias("copies"),
    )
    if copies:
        grouped = grouped.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return grouped.select("doc_id", "text_h", "n_words", "hits", "items").mapInArrow(_united, scans[0].schema)


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """doc_id, text_h, n_words, hit (packed bits, one a word; null: none) and items (sorted ids) of every row."""
    sc = docs.sparkSession.sparkContext
    groups = [sc.broadcast(a) for a in automata(benchmark, window, max_words)]
    scans = _scans(docs, groups)
    return scans[0] if len(scans) == 1 else _united_hits(scans)


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _cut(text: str, hit: np.ndarray) -> str:
    """The text without the hit words and what lies between them; a line break marks each cut."""
    places = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for first, end in _spans(hit):
        kept.append(text[at : places[first][0]].rstrip())
        at = places[end - 1][1]
    kept.append(text[at:])
    return "\n".join(kept)


def _judged(raw: bytes, hit: np.ndarray, max_coverage: float) -> bytes | None:
    """The text without its hit words; None: it is benchmark text."""
    return None if hit.sum() > max_coverage * len(hit) else _cut(raw.decode(), hit).encode()


def _with_texts(batch: pa.RecordBatch, texts: list[bytes | None], names: list[str]) -> pa.RecordBatch:
    text = pa.array(texts, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([text if n == "text" else batch.column(n) for n in names], names=names)


def _cleaner(shared, max_coverage: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def clean(raw: bytes | None, automaton: ItemAutomaton) -> tuple[bool, bytes | None]:
        """Cuts until no window is left, as a cut may join words into a new one. False: the document is benchmark text."""
        while raw:
            hit, _ = automaton.scan(word_split(raw))
            if hit is None:
                break
            raw = _judged(raw, hit, max_coverage)
            if raw is None:
                return False, None
        return True, raw

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [clean(raw, shared.value) for raw in batch.column("text").cast(pa.binary()).to_pylist()]
            yield _with_texts(batch, [t for _, t in got], batch.schema.names).filter(pa.array([ok for ok, _ in got], pa.bool_()))

    return released(run)


def _cutter(max_coverage: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One round of `_cleaner` on rows that carry the number of their words and their united hits in the last two columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *names, n_words, hit = batch.schema.names
            texts = []
            for raw, n, bits in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column(n_words).to_pylist(), batch.column(hit).to_pylist()):
                texts.append(_judged(raw, np.unpackbits(np.frombuffer(bits, np.uint8), count=n).view(bool), max_coverage))
            yield _with_texts(batch, texts, names).filter(pa.array([t is not None for t in texts], pa.bool_()))

    return run


def _decontaminate_by_groups(docs: DataFrame, groups: list, max_coverage: float) -> DataFrame:
    """Rounds over all groups; only the documents that a round cut enter the next."""
    key = F.coalesce(F.xxhash64("text"), F.lit(0))
    doc, text_h, n_words, hit = fresh(docs.columns, "_doc", "_text_h", "_n_words", "_hit")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    clean, left = [], docs
    while True:
        # A row counts once however many groups hit it and however often it is repeated.
        hits = _united_hits([s.where("hit IS NOT NULL") for s in _scans(left, groups)], copies=False)
        hits = materialize(hits.select(F.col("doc_id").alias(doc), F.col("text_h").alias(text_h), F.col("n_words").alias(n_words), F.col("hit").alias(hit)), "hits")
        if not hits.take(1):
            return reduce(DataFrame.unionByName, clean, left)
        same = F.col("doc_id").eqNullSafe(F.col(doc)) & (key == F.col(text_h))
        clean.append(left.join(hits, same, "left_anti"))
        found = left.join(hits, same).select(*columns, n_words, hit)
        left = materialize(found.mapInArrow(_cutter(max_coverage), left.schema), "cut")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, max_words: int = MAX_ITEM_WORDS
) -> DataFrame:
    """The documents without the spans that benchmark windows cover; those covered beyond `max_coverage` go as a whole."""
    sc = docs.sparkSession.sparkContext
    groups = [sc.broadcast(a) for a in automata(benchmark, window, max_words)]
    if len(groups) == 1:
        return docs.mapInArrow(_cleaner(groups[0], max_coverage), docs.schema)
    return _decontaminate_by_groups(docs, groups, max_coverage)


@released
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit = [0 if h is None else int(np.unpackbits(np.frombuffer(h, np.uint8)).sum()) for h in batch.column("hit").to_pylist()]
        items = batch.column("items").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()), pa.array([h > 0 for h in hit], pa.bool_())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.mapInArrow(_digests, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[p + 1 : p + least(len(w), 10)], ' ') AS gram
  FROM items, unnest(range(len(w) - least(len(w), 10) + 1)) AS t(p) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT doc_id, p, size, array_to_string(w[p + 1 : p + size], ' ') AS gram
  FROM words, sizes, unnest(range(greatest(len(w) - size + 1, 0))) AS t(p)),
hits AS (
  SELECT d.doc_id, d.p, d.size, i.item_id FROM doc_windows d JOIN item_windows i ON d.gram = i.gram AND d.size = i.size),
covered AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(n.n, 0)::BIGINT AS n_items,
       sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM words w LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)
"""
