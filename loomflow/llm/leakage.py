"""Passages of evaluation items inside a training corpus, by a positional inverted index.

The corpus is tokenised once. Its index is stored in the shared folder in shards of some
100,000 words: each has, of every term of its documents, the postings (document,
positions), so a term of any frequency is spread as the documents are and no posting
is ever shuffled. Documents are numbered within a shard, so rows that share an id
stay apart.

The test items are a stated query set, taken in blocks of bounded size, which all read the one
index. For each block: document frequencies of its words come from the index; of each
passage-long window of an item the rarest words are its anchors; offset-adjusted
posting lists of a window's anchors are intersected from the rarest on; and what is
left is compared word by word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomflow.llm.words import words
from loomflow.runtime import materialize, ship

#: Words of test items handled at once; their anchors are broadcast.
BLOCK_WORDS = 1_000_000

#: The same for windows of items, which take more room a word.
WINDOW_BLOCK_WORDS = 100_000

#: Words of a shard; a document is never cut, so a longer one is a shard of its own.
SHARD_WORDS = 100_000

#: Pairs of a posting and an item's window that are looked at in one step.
PAIRS = 1_000_000

_SHARD = ("ids", "lengths", "terms", "term_docs", "term_words", "docs", "positions")


def build_index(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """The positional inverted index of whole texts, a row per shard, stored.

    ``ids`` and ``lengths`` are of the shard's documents; of each of ``terms`` there are
    ``term_docs`` documents and ``term_words`` places, which follow one another in ``docs`` (numbers
    within the shard) and ``positions``. Documents without an id can't be reported and aren't indexed.
    """
    ship(docs.sparkSession)
    kind = docs.schema[ident].dataType.simpleString()

    def shard(ids: pa.Array, texts: list[list[str]]) -> pa.RecordBatch:
        lengths = np.array(list(map(len, texts)), np.int64)
        coded = pa.array([w for t in texts for w in t], pa.string()).dictionary_encode()
        codes, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
        order = np.argsort(codes, kind="stable")
        doc = np.repeat(np.arange(len(texts)), lengths)[order]
        place = (np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths))[order]
        codes = codes[order]
        first = np.ones(len(codes), bool)
        first[1:] = (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])
        columns = [ids, *[pa.array(x, pa.int32()) for x in (lengths, np.bincount(codes[first], minlength=n), np.bincount(codes, minlength=n), doc, place)]]
        columns.insert(2, coded.dictionary)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], names=list(_SHARD))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, size, begin = batch.column(0), [], 0, 0
            for at, value in enumerate(batch.column(1)):
                held.append(words(value.as_py()))
                size += len(held[-1])
                if size >= SHARD_WORDS or at + 1 == batch.num_rows:
                    yield shard(ids.slice(begin, len(held)), held)
                    held, size, begin = [], 0, at + 1

    source = docs.where(F.col(ident).isNotNull()).select(F.col(ident).alias("doc"), F.col(text).cast("string").alias("text"))
    schema = f"ids array<{kind}>, lengths array<int>, terms array<string>, term_docs array<int>, term_words array<int>, docs array<int>, positions array<int>"
    return materialize(source.mapInArrow(index, schema), "leakage-index")


def document_frequencies(index: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """In how many documents each word of the vocabulary occurs, over the whole index: two of its columns are read.
    The result is no larger than the vocabulary, which the caller bounds."""
    if not vocabulary:
        return {}
    listed = sorted(vocabulary)
    shared = index.sparkSession.sparkContext.broadcast(listed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(shared.value, pa.string())
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            found = pc.index_in(batch.column(0).flatten(), value_set=wanted)
            known = found.is_valid()
            np.add.at(total, found.filter(known).to_numpy(), batch.column(1).flatten().filter(known).to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "df"])

    counts = index.select("terms", "term_docs").mapInArrow(count, "at long, df long")
    return {listed[r["at"]]: r["df"] for r in counts.groupBy("at").agg(F.sum("df").alias("df")).collect()}


def anchored_windows(item_words: list[str], df: dict[str, int], passage: int, anchors: int) -> list[tuple[int, ...]]:
    """The anchor positions of each window of ``passage`` words: its rarest words.
    Windows with a word that no document has can't match and are left out."""
    found: dict[tuple[int, ...], None] = {}
    for start in range(len(item_words) - passage + 1):
        at = range(start, start + passage)
        if all(df.get(item_words[i]) for i in at):
            rarest = sorted(at, key=lambda i: (df[item_words[i]], item_words[i], i))[:anchors]
            found[tuple(sorted(rarest))] = None
    return list(found)


class _Shard:
    """Postings of the wanted terms in one shard, in the order (term, document, position)."""

    def __init__(self, batch: pa.RecordBatch, row: int, wanted: pa.Array) -> None:
        parts = [batch.column(i)[row].values for i in range(len(_SHARD))]
        self.ids, numbers = parts[0], {n: p.to_numpy(zero_copy_only=False) for n, p in zip(_SHARD, parts) if n not in ("ids", "terms")}
        self.lengths = numbers["lengths"].astype(np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        code = pc.fill_null(pc.index_in(parts[2], value_set=wanted), -1).to_numpy(zero_copy_only=False)
        code = np.repeat(code, numbers["term_words"])
        known = np.flatnonzero(code >= 0)
        self.code, self.doc, self.place = code[known].astype(np.int64), numbers["docs"][known].astype(np.int64), numbers["positions"][known].astype(np.int64)

    def in_documents(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, term) of all that occur, each once."""
        first = np.ones(len(self.code), bool)
        first[1:] = (self.code[1:] != self.code[:-1]) | (self.doc[1:] != self.doc[:-1])
        return self.doc[first], self.code[first]

    def places(self, document: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and terms of a document's postings, by place."""
        if not hasattr(self, "_order"):
            self._order = np.lexsort((self.place, self.doc))
            self._upto = np.searchsorted(self.doc[self._order], np.arange(len(self.lengths) + 1))
        at = self._order[self._upto[document] : self._upto[document + 1]]
        return self.place[at], self.code[at]


def _grouped(keys: Sequence[int], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, begin, count): which rows have each key 0 to n - 1."""
    keys = np.asarray(keys, np.int64)
    order, count = np.argsort(keys, kind="stable"), np.bincount(keys, minlength=n)
    return order, np.cumsum(count) - count, count


def _expanded(keys: np.ndarray, group: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of ``keys``, row of the group with that key), about PAIRS at a time."""
    order, begin, count = group
    each = count[keys]
    upto = np.cumsum(each)
    at = 0
    while at < len(keys):
        done = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, done + PAIRS, side="right")))
        n = each[at:to]
        row = np.repeat(np.arange(at, to), n)
        within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        yield row, order[begin[keys[row]] + within]
        at = to


def _blocks(items: DataFrame, ident: str, text: str, most: int | None = None) -> Iterator[list[tuple[object, list[str]]]]:
    held, size = [], 0
    for row in items.select(ident, text).where(F.col(ident).isNotNull()).toLocalIterator():
        item = (row[0], words(row[1]))
        held.append(item)
        size += len(item[1])
        if size >= (most or BLOCK_WORDS):
            yield held
            held, size = [], 0
    if held:
        yield held


def _search(index: DataFrame, wanted: list[str], plan: object, find, columns: Sequence[str], block: list, names: tuple[str, str, str, str]) -> DataFrame:  # noqa: ANN001
    """Rows (document's id, item's id, columns...) of what ``find(shard, plan)`` gives for each shard: (document, item, numbers...)."""
    doc_name, item_name, kind, item_kind = names
    spark: SparkSession = index.sparkSession
    shared = spark.sparkContext.broadcast((wanted, plan))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, given = shared.value
        terms = pa.array(terms, pa.string())
        for batch in batches:
            for row in range(batch.num_rows):
                shard = _Shard(batch, row, terms)
                found = find(shard, given)
                numbers = [pa.array([f[i] for f in found], pa.int32()) for i in range(1, 2 + len(columns))]
                yield pa.RecordBatch.from_arrays([shard.ids.take(pa.array([f[0] for f in found], pa.int64())), *numbers], names=["doc", "item", *columns])

    found = index.mapInArrow(search, f"doc {kind}, item int, " + ", ".join(f"{c} int" for c in columns))
    known = spark.createDataFrame([(k, ident) for k, (ident, _) in enumerate(block)], f"item int, name {item_kind}")
    return found.join(F.broadcast(known), "item").select(F.col("doc").alias(doc_name), F.col("name").alias(item_name), *columns)


def _best(found: DataFrame | None, spark: SparkSession, columns: Sequence[str], names: tuple[str, str, str, str]) -> DataFrame:
    """One row per (document's id, item's id): the most words, and the first place of so many."""
    doc_id, item_id, kind, item_kind = names
    if found is None:
        return spark.createDataFrame([], f"`{doc_id}` {kind}, `{item_id}` {item_kind}, " + ", ".join(f"{c} int" for c in columns))
    best = F.max(F.struct(F.col(columns[0]).alias("c0"), *[(-F.col(c)).alias(f"c{i}") for i, c in enumerate(columns[1:], 1)])).alias("__best")
    rows = found.groupBy(doc_id, item_id).agg(best)
    return rows.select(doc_id, item_id, F.col("__best.c0").alias(columns[0]), *[(-F.col(f"__best.c{i}")).alias(c) for i, c in enumerate(columns[1:], 1)])


def _names(docs: DataFrame, doc_id: str, items: DataFrame, item_id: str) -> tuple[str, str, str, str]:
    if doc_id == item_id:
        raise ValueError("the two ids need different names")
    return doc_id, item_id, docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()


def _union(found: DataFrame | None, part: DataFrame) -> DataFrame:
    return part if found is None else found.unionByName(part)


def leaked_passages(
    docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, passage: int = 12, anchors: int = 3
) -> DataFrame:
    """Every (document, item) that share ``passage`` successive words or more:
    (doc_id, item_id, ``n_words`` of the longest shared run, ``doc_word`` and
    ``item_word``, where it starts, counted in words from 0).

    Null and empty texts and items shorter than a passage match nothing; rows
    without an id are left out; rows that repeat an id are each searched, whatever their texts, and
    joined into one result row. Items are read in blocks of BLOCK_WORDS words, so any number of them works.
    """
    names, columns = _names(docs, doc_id, items, item_id), ("n_words", "doc_word", "item_word")
    index = build_index(docs, doc_id, text)
    found: DataFrame | None = None
    for block in _blocks(items, item_id, item_text):
        texts = [t for _, t in block]
        frequency = document_frequencies(index, {w for t in texts if len(t) >= passage for w in t})
        wanted = sorted(frequency)
        codes = {w: n for n, w in enumerate(wanted)}
        plans = []
        for k, t in enumerate(texts):
            for window in anchored_windows(t, frequency, passage, anchors):
                by_rarity = sorted(window, key=lambda i: (frequency[t[i]], i))  # noqa: B023 - used at once
                plans.append((k, *[i for i in by_rarity], *[codes[t[i]] for i in by_rarity]))
        if not plans:
            continue
        table = np.array(plans, np.int64)
        n = (table.shape[1] - 1) // 2
        spans = np.cumsum([0, *map(len, texts)])
        flat = np.array([codes.get(w, -2) for t in texts for w in t], np.int64)
        plan = (table[:, 0], table[:, 1 : n + 1], table[:, n + 1 :], _grouped(table[:, n + 1], len(wanted)), flat, spans, passage)
        found = _union(found, _search(index, wanted, plan, _passages, columns, block, names))
    return _best(found, docs.sparkSession, columns, names)


def _passages(shard: _Shard, plan: tuple) -> list[tuple[int, ...]]:
    """(document, item, words, place in the document, place in the item) of the longest runs.

    An anchor at word i of an item, seen at p, means the item starts at p - i. From the rarest
    anchor's postings on, a start is kept while the next anchor's list has the place it must be at.
    """
    item_of, offsets, terms, by_rarest, flat, spans, passage = plan
    text = np.full(int(shard.lengths.sum()), -1, np.int32)  # the wanted terms' lists, laid out by place
    text[shard.begins[shard.doc] + shard.place] = shard.code
    starts: list[np.ndarray] = []
    for row, which in _expanded(shard.code, by_rarest):
        doc, start = shard.doc[row], shard.place[row] - offsets[which, 0]
        for k in range(1, offsets.shape[1]):
            at = start + offsets[which, k]
            kept = (at >= 0) & (at < shard.lengths[doc])
            kept[kept] = text[shard.begins[doc[kept]] + at[kept]] == terms[which[kept], k]
            which, doc, start = which[kept], doc[kept], start[kept]
        starts.append(np.unique(np.stack((doc, item_of[which], start), axis=1), axis=0))
    if not starts:
        return []
    out = []
    for doc, item, start in np.unique(np.concatenate(starts), axis=0).tolist():
        low, high = max(0, -start), min(int(spans[item + 1] - spans[item]), int(shard.lengths[doc]) - start)
        begin = int(shard.begins[doc]) + start
        same = text[begin + low : begin + high] == flat[spans[item] + low : spans[item] + high]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
        if not len(edges):
            continue
        runs = edges[1::2] - edges[0::2]
        longest = int(np.argmax(runs))
        if runs[longest] >= passage:
            at = low + int(edges[2 * longest])
            out.append((doc, item, int(runs[longest]), start + at, at))
    return out


def proximity_matches(
    docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, rarest: int = 8, least: int = 7, span: int = 60
) -> DataFrame:
    """Documents that hold ``least`` or more of an item's ``rarest`` rarest distinct words within
    ``span`` successive words, in any order: (doc_id, item_id, ``n_words`` the most of
    them in one such span, ``doc_word`` where it begins). It finds edited passages that share no
    long run, of whole items up to ``span`` words; for longer items and parts of items see
    ``window_matches``. Words that no document has aren't taken; items left with fewer than
    ``least`` words match nothing. Nulls, empty texts, repeated ids and blocks as in ``leaked_passages``.
    """
    return _near(docs, doc_id, text, items, item_id, item_text, None, rarest, least, span, BLOCK_WORDS)


def window_matches(
    docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, window: int = 24, rarest: int = 8, least: int = 7, span: int = 60
) -> DataFrame:
    """As ``proximity_matches``, but the rarest words are taken of every window of ``window`` successive
    words of an item, of the whole item if it is shorter: so a passage of a window's length is found wherever in
    an item it is from, edited too while ``least`` of the window's rarest words are left within ``span``.
    Windows of fewer than ``least`` distinct words match nothing. Items come in blocks of WINDOW_BLOCK_WORDS
    words. One row per (doc_id, item_id), repeated ids joined: ``n_words`` is the most words of a
    window within one span, ``doc_word`` where it begins.
    """
    return _near(docs, doc_id, text, items, item_id, item_text, window, rarest, least, span, WINDOW_BLOCK_WORDS)


def _near(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, window: int | None, rarest: int, least: int, span: int, block_words: int) -> DataFrame:
    names, columns = _names(docs, doc_id, items, item_id), ("n_words", "doc_word")
    index = build_index(docs, doc_id, text)
    found: DataFrame | None = None
    for block in _blocks(items, item_id, item_text, block_words):
        frequency = document_frequencies(index, {w for _, t in block for w in t})
        chosen: dict[tuple[int, tuple[str, ...]], None] = {}
        for k, (_, t) in enumerate(block):
            width = window or max(len(t), 1)
            for start in range(max(1, len(t) - width + 1)):
                rare = sorted({w for w in t[start : start + width] if frequency.get(w)}, key=lambda w: (frequency[w], w))[:rarest]
                if len(rare) >= least:
                    chosen[(k, tuple(rare))] = None
        if not chosen:
            continue
        # Of a window's n words all but n - least occur, so one of its n - least + 1 rarest does.
        wanted = sorted({w for _, rare in chosen for w in rare})
        codes = {w: n for n, w in enumerate(wanted)}
        windows = [(k, [codes[w] for w in rare]) for k, rare in chosen]
        starting = [(c, n) for n, (_, rare) in enumerate(windows) for c in rare[: len(rare) - least + 1]]
        order, begin, count = _grouped([c for c, _ in starting], len(wanted))
        by_start = (np.array([n for _, n in starting], np.int64)[order], begin, count)
        padded = np.full((len(windows), rarest), -1, np.int64)
        for n, (_, rare) in enumerate(windows):
            padded[n, : len(rare)] = rare
        plan = (np.array([k for k, _ in windows], np.int64), padded, by_start, least, span)
        found = _union(found, _search(index, wanted, plan, _close, columns, block, names))
    return _best(found, docs.sparkSession, columns, names)


def _close(shard: _Shard, plan: tuple) -> list[tuple[int, ...]]:
    """(document, item, words, place) of windows with enough of their words close together, the best of each item."""
    item_of, padded, by_start, least, span = plan
    doc, code = shard.in_documents()
    width = len(by_start[2])
    present = np.sort(doc * width + code)
    candidates: list[np.ndarray] = []
    for row, which in _expanded(code, by_start):
        pairs = np.unique(np.stack((doc[row], which), axis=1), axis=0)
        if not len(pairs):
            continue
        keys = pairs[:, :1] * width + padded[pairs[:, 1]]
        at = np.minimum(np.searchsorted(present, keys), len(present) - 1)
        hits = ((present[at] == keys) & (padded[pairs[:, 1]] >= 0)).sum(axis=1)
        candidates.append(pairs[hits >= least])
    if not candidates:
        return []
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for document, which in np.unique(np.concatenate(candidates), axis=0).tolist():
        places, terms = shard.places(document)
        mine = np.isin(terms, padded[which])
        most, begin = _densest(list(zip(places[mine].tolist(), terms[mine].tolist())), span)
        if most >= least:
            key = document, int(item_of[which])
            best[key] = max(best.get(key, (0, 0)), (most, -begin))
    return [(d, k, most, -begin) for (d, k), (most, begin) in best.items()]


def _densest(places: list[tuple[int, int]], span: int) -> tuple[int, int]:
    """Most distinct terms within ``span`` successive words, and where the first such span begins."""
    inside, begin, best = Counter(), 0, (0, 0)
    for at, term in places:
        inside[term] += 1
        while at - places[begin][0] >= span:
            inside[places[begin][1]] -= 1
            if not inside[places[begin][1]]:
                del inside[places[begin][1]]
            begin += 1
        if len(inside) > best[0]:
            best = (len(inside), places[begin][0])
    return best
