"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every word sequence of the benchmark items. Documents stream through it word by word; the longest
match that ends at each word shows whether a window (13 consecutive item words, or a whole shorter item) ends there.
Documents are never shuffled: the automaton is broadcast, built from blocks of items of a checked size, and a
benchmark of several blocks takes one pass each.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, broadcast_if_small, copy_key, materialize, table

WINDOW = 13
#: Words are runs of digits, letters a-z and everything from U+0080, after lower-casing A-Z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class SuffixAutomaton:
    """Of several word sequences: all their substrings, and for each window or short item the items that hold it."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in seq]) for name, seq in items if seq]
        self.shortest = min([window, *(len(seq) for _, seq in coded)])
        for _, seq in coded:
            at = 0
            for word in seq:
                at = self._extend(at, word)
        self.items: dict[int, set[str]] = {}  # by the state of a window
        self.short: dict[int, list[tuple[int, str]]] = {}  # by the state of a whole short item
        by_length = sorted(range(1, len(self.len)), key=self.len.__getitem__)
        self.of_window = [0] * len(self.len)  # the state of the last `window` words of what a state stands for
        for state in by_length:
            self.of_window[state] = state if self.len[self.link[state]] < window else self.of_window[self.link[state]]
        for name, seq in coded:
            at = 0
            for i, word in enumerate(seq):
                at = self.next[at][word]
                if i + 1 >= window:
                    self.items.setdefault(self.of_window[at], set()).add(name)
            if len(seq) < window:
                self.short.setdefault(at, []).append((len(seq), name))
        self.near_short = [-1] * len(self.len)  # the closest state on the way to the root that ends a short item
        for state in by_length:
            self.near_short[state] = state if state in self.short else self.near_short[self.link[state]]

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            kept = self.next[last][word]
            return kept if self.len[kept] == self.len[last] + 1 else self._split(last, word, kept)
        new = self._state(self.len[last] + 1, {})
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        else:
            q = self.next[p][word]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, word, q)
        return new

    def _split(self, p: int, word: int, q: int) -> int:
        copy = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _state(self, length: int, following: dict[int, int], link: int = 0) -> int:
        self.next.append(following)
        self.link.append(link)
        self.len.append(length)
        return len(self.len) - 1

    def scan(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (start, end) of words hit, in order and not touching, and the items that occur."""
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        if len(text) < self.shortest or not self.ids:
            return found, items
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for w in text), np.int64, len(text))
        known = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False]))))
        for start, end in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if end - start >= self.shortest:
                self._run(ids[start:end].tolist(), start, found, items)
        return found, items

    def _run(self, ids: list[int], offset: int, found: list[tuple[int, int]], items: set[str]) -> None:
        following, link, length = self.next, self.link, self.len
        state = matched = 0
        for i, word in enumerate(ids, offset + 1):
            while state and word not in following[state]:
                state = link[state]
                matched = length[state]
            if word not in following[state]:
                continue
            state = following[state][word]
            matched += 1
            longest = 0
            if matched >= self.window:
                longest = self.window
                items |= self.items[self.of_window[state]]
            short = self.near_short[state]
            while short > 0:
                for size, name in self.short[short]:
                    if size <= matched:
                        longest = max(longest, size)
                        items.add(name)
                short = self.near_short[link[short]]
            if longest:
                start = i - longest
                while found and found[-1][1] >= start:
                    start = min(start, found.pop()[0])
                found.append((start, i))


_SCANNED = "doc_id long, copy long, n_words long, spans array<struct<start:int,end:int>>, item_ids array<string>"
_automata: dict[str, SuffixAutomaton] = {}


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = 1 << 22) -> DataFrame:
    """doc_id, copy (a hash of the text), n_words, spans (of words hit, from 0, end exclusive, in order), item_ids
    (sorted as strings).

    docs: doc_id, text; benchmark: item_id, text. Null texts have no words; items without words match nothing; items
    that repeat an item_id count as one id; an item of null id hits words but is not listed. Every row of docs gives a
    row, whatever it repeats. block_chars bounds what is collected and broadcast at once, about half a gigabyte of
    states for each Python worker; a larger benchmark is dealt into blocks that take one pass each.
    """
    bound_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-2 * size // block_chars)) if size > block_chars else 1
    found = None
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), copy_key().alias("copy"), "text").mapInArrow(_scanner(part, window), _SCANNED)
        found = rows if found is None else found.unionByName(rows)
    return found if blocks == 1 else _merge(materialize(found, "blocks"), blocks)


def _scanner(items: DataFrame, window: int):
    shared = items.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in items.toLocalIterator()])
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _automata:
            _automata.clear()
            _automata[key] = SuffixAutomaton([(name, words(text)) for name, text in shared.value], window)
        automaton = _automata[key]
        for batch in batches:
            n_words, spans, names = [], [], []
            for text in batch.column(2):
                seq = words(text.as_py())
                hit, items = automaton.scan(seq)
                n_words.append(len(seq))
                spans.append([{"start": a, "end": b} for a, b in hit])
                names.append(sorted(items - {None}))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            columns = [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(spans, kind), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "copy", "n_words", "spans", "item_ids"])

    return run


def _merge(rows: DataFrame, blocks: int) -> DataFrame:
    """One row a document out of one a block; touching spans become one. Rows of one doc_id and text are alike."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def join(done, s):
        last = F.element_at(done, -1)
        merged = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.element_at(F.concat(F.array(F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"))), done), -1)["end"] >= s["start"]), merged).otherwise(F.concat(done, F.array(s)))

    grouped = rows.groupBy("doc_id", "copy", "n_words").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        (F.count("*") / blocks).cast("int").alias("copies"),
    )
    merged = grouped.withColumn("spans", F.aggregate("spans", none, join))
    return merged.select("doc_id", "copy", "n_words", "spans", "item_ids", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1))))).drop("col")


def judged(scanned: DataFrame, share: int = 20) -> DataFrame:
    """Adds n_hit and contaminated: hit words are at least 1/share of all."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return scanned.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: int = 20, cut: bool = False, **limits: int) -> DataFrame:
    """docs, all columns, without the contaminated rows; each row is judged by its own text, also with a null doc_id.
    cut: the rows that stay lose the words hit and what parts them, and n_chars, if there, follows."""
    judgement = judged(scan(docs, benchmark, **limits), share).where("n_hit > 0").select("doc_id", "copy", "contaminated", "spans").distinct()
    judgement = materialize(judgement, "hits")
    found = broadcast_if_small(judgement if cut else judgement.where("contaminated"), 64 + 8 * F.size("spans"))
    same = docs["doc_id"].cast("long").eqNullSafe(found["doc_id"]) & (copy_key(docs["text"]) == found["copy"])
    if not cut:
        return docs.join(found, same, "left_anti")
    joined = docs.join(found, same, "left").where(~F.coalesce(found["contaminated"], F.lit(False)))
    flat = joined.select(*(docs[c] for c in docs.columns), F.transform(found["spans"], lambda x: x["start"]).alias("__start"), F.transform(found["spans"], lambda x: x["end"]).alias("__end"))
    at, last = docs.columns.index("text"), len(docs.columns)
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, texts = list(batch.columns[:last]), batch.column(at).to_pylist()
            spans = [list(zip(a, b, strict=True)) if a else None for a, b in zip(batch.column(last).to_pylist(), batch.column(last + 1).to_pylist(), strict=True)]
            texts = [without(t, x) if x else t for t, x in zip(texts, spans, strict=True)]
            columns[at] = pa.array(texts, columns[at].type)
            if counted is not None:
                sizes = [len(t) if x else n for t, x, n in zip(texts, spans, columns[counted].to_pylist(), strict=True)]
                columns[counted] = pa.array(sizes, columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, names=docs_names)

    docs_names = docs.columns
    return flat.mapInArrow(run, docs.schema)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of these spans and what lies between them."""
    data = text.encode("utf-8", "surrogatepass")
    found = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(_FOLD))]
    parts, at = [], 0
    for start, end in spans:
        parts.append(data[at : found[start][0]])
        at = found[end - 1][1]
    return b"".join([*parts, data[at:]]).decode("utf-8", "surrogatepass")


def query(spark, sf_dir):
    found = judged(scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
       FROM (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT doc_id, item_id, dw.size AS size, i FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
