"""Benchmark decontamination: n-gram seeds, a bound on the score, then Smith-Waterman alignment.

Runs of ``n`` words of the test items are looked for in every document. Each is a seed, however frequent: which runs an edited
copy keeps depends on its edits, and the kept ones are the frequent ones where an item was copied often.
Around each seed found, the words that document and item share, each as often as both have it, bound the score; where that
reaches what a copy needs, words of document and item are aligned locally: a match is worth 2, a mismatch or a gap costs 1.
So runs that are common in any text cost a count, not an alignment, and no copy is lost that keeps a run.
A document holds a copy of an item if the score reaches that of ``share`` of the item's words, or of ``enough``
words, and in any case of ``least`` words (four fifths of a shorter item's), which no chance likeness does.

Test items are broadcast in groups whose text is ``GROUP_BYTES`` at most; more items make more groups, each with
its own scan, with the same result.

Defined results: null or blank documents match nothing, as do items of fewer than ``n`` words, which have no
run to be found by. Rows with a null id are left out of the matches (and kept by ``drop_contaminated``).
Rows sharing an id give each item's best match once; of equal scores in a text the first place counts. Case and punctuation don't count.
Very long texts are searched whole, alone in their slice. An empty table of documents gives no rows, one of items no matches. Extra columns of
either table, whatever their names (``item_id``, ``score``), are left out of the matches and kept as they are by ``drop_contaminated``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm._text import HashSet, Words, map_slices, mix, ngrams, picked

N, SHARE, ENOUGH, LEAST, GROUP_BYTES = 3, 0.35, 50, 8, 16 << 20
MATCH = 2
#: Window words that are counted at once.
AT_ONCE = 1 << 20


@dataclass
class Items:
    ids: list[int]
    words: list[np.ndarray]
    gram: np.ndarray  # sorted hashes
    owner: np.ndarray  # pairs (gram index, item index, position in the item), sorted by gram index
    begin: np.ndarray
    salt: np.ndarray  # of each item
    word: np.ndarray  # sorted hashes of item and word, and how often the item has the word
    times: np.ndarray


def prepare(rows: list[tuple[int, str]], n: int = N) -> Items:
    w = Words(pa.array([t for _, t in rows], pa.string()))
    h = w.hashes()
    words = [h[w.first[i] : w.first[i + 1]] for i in range(len(rows))]
    grams, item, pos = [], [], []
    for i, x in enumerate(words):
        g, at = ngrams(x, np.array([0, len(x)]), n)
        grams.append(g)
        item.append(np.full(len(g), i))
        pos.append(at)
    g = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    names, inverse = np.unique(g, return_inverse=True)
    owner = np.stack([inverse, np.concatenate(item), np.concatenate(pos)], axis=1) if len(g) else np.zeros((0, 3), np.int64)
    owner = owner[np.argsort(owner[:, 0], kind="stable")]
    salt = mix(np.arange(1, len(rows) + 1, dtype=np.uint64))
    word, times = np.unique(mix(h ^ np.repeat(salt, np.diff(w.first))), return_counts=True)
    return Items([i for i, _ in rows], words, names, owner, np.searchsorted(owner[:, 0], np.arange(len(names) + 1)), salt, word, times)


def bounds(items: Items, item: np.ndarray, h: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A score that no alignment of an item with the words ``h[low:high]`` exceeds: every word that both have, as often as both, matched."""
    out, size = np.zeros(len(item), np.int64), high - low
    cut = np.flatnonzero(np.diff(np.cumsum(size) // AT_ONCE)) + 1
    for a, b in zip(np.r_[0, cut], np.r_[cut, len(item)], strict=True):
        n = size[a:b]
        pair = np.repeat(np.arange(a, b), n)
        at = np.arange(n.sum()) + np.repeat(low[a:b] - (np.cumsum(n) - n), n)
        key = mix(h[at] ^ items.salt[item[pair]])
        k = np.minimum(np.searchsorted(items.word, key), len(items.word) - 1)
        ok = items.word[k] == key
        both, times = np.unique(pair[ok] * len(items.word) + k[ok], return_counts=True)
        np.add.at(out, both // len(items.word), np.minimum(times, items.times[both % len(items.word)]))
    return MATCH * out


def align(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of pairs of word sequences, and where in ``b`` the best alignment ends.

    All pairs at once; a row's gaps along ``b`` come from a running maximum.
    """
    score, end = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    order = sorted(range(len(a)), key=lambda i: (len(b[i]), len(a[i])))
    for s in range(0, len(order), 256):
        part = order[s : s + 256]
        la, lb = max(len(a[i]) for i in part), max(len(b[i]) for i in part)
        x = np.zeros((len(part), la), np.uint64)
        y = np.zeros((len(part), lb), np.uint64)
        okx, oky = np.zeros(x.shape, bool), np.zeros(y.shape, bool)
        for k, i in enumerate(part):
            x[k, : len(a[i])], okx[k, : len(a[i])] = a[i], True
            y[k, : len(b[i])], oky[k, : len(b[i])] = b[i], True
        before = np.zeros((len(part), lb + 1), np.int32)
        ramp = np.arange(lb + 1, dtype=np.int32)
        best, where = np.zeros(len(part), np.int32), np.zeros(len(part), np.int64)
        for i in range(la):
            same = (y == x[:, i : i + 1]) & oky & okx[:, i : i + 1]
            now = np.zeros_like(before)
            np.maximum(before[:, :-1] + np.where(same, MATCH, -1), before[:, 1:] - 1, out=now[:, 1:])
            np.maximum(now, 0, out=now)
            now += ramp
            np.maximum.accumulate(now, axis=1, out=now)
            now -= ramp
            top = now.max(axis=1)
            better = top > best
            if better.any():
                where[better] = now[better].argmax(axis=1)
                best[better] = top[better]
            before = now
        score[part], end[part] = best, where
    return score, end


def needed(length: np.ndarray, share: float = SHARE, enough: int = ENOUGH, least: int = LEAST) -> np.ndarray:
    """Score from which an alignment with an item of so many words counts as a copy."""
    length = np.asarray(length, float)
    return MATCH * np.maximum(np.minimum(least, 0.8 * length), np.minimum(share * length, enough))


def matches(items: Items, seeds: HashSet, column: pa.Array, n: int = N, share: float = SHARE, enough: int = ENOUGH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text index, item index, score and last word's position of each copy found, the best for each text and item."""
    w = Words(column)
    h = w.hashes()
    g, at = ngrams(h, w.first, n)
    hit, gram = seeds.find(g)
    empty = np.zeros(0, np.int64)
    if not len(hit):
        return empty, empty, empty, empty
    at = at[hit]
    times = items.begin[gram + 1] - items.begin[gram]
    rows = np.repeat(items.begin[gram], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    where = np.repeat(at, times)
    item, pos = items.owner[rows, 1], items.owner[rows, 2]
    doc = np.searchsorted(w.first, where, side="right") - 1
    length = np.array([len(x) for x in items.words])[item]
    # a window reaches over the whole item on both sides, with room for gaps
    low = np.maximum(where - pos - length // 2 - 2, w.first[doc])
    high = np.minimum(where - pos + length + length // 2 + 2, w.first[doc + 1])
    order = np.lexsort((low, item, doc))
    doc, item, low, high = doc[order], item[order], low[order], high[order]
    new = np.ones(len(doc), bool)
    reach = np.maximum.accumulate(high + (np.cumsum(np.r_[0, (np.diff(doc) != 0) | (np.diff(item) != 0)]) * (len(h) + 1)))
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (low[1:] + np.cumsum((np.diff(doc) != 0) | (np.diff(item) != 0)) * (len(h) + 1) > reach[:-1])
    first = np.flatnonzero(new)
    high = np.maximum.reduceat(high, first)
    doc, item, low = doc[first], item[first], low[first]
    length = np.array([len(x) for x in items.words])[item]
    ok = bounds(items, item, h, low, high) >= needed(length, share, enough)
    doc, item, low, high = doc[ok], item[ok], low[ok], high[ok]
    score, end = align([items.words[i] for i in item], [h[a:b] for a, b in zip(low, high, strict=True)])
    ok = score >= needed(length[ok], share, enough)
    doc, item, score, end = doc[ok], item[ok], score[ok], (low + end - 1 - w.first[doc])[ok]
    order = np.lexsort((end, -score, item, doc))
    doc, item, score, end = doc[order], item[order], score[order], end[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    return doc[new], item[new], score[new], end[new]


def _groups(benchmark: DataFrame, id_col: str, text_col: str, most: int):
    """Items in groups of at most ``most`` text bytes (a longer item alone)."""
    rows, size = [], 0
    own = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text")).dropna().distinct()
    for r in own.orderBy("item_id", "text").toLocalIterator(prefetchPartitions=True):
        n = len(r["text"].encode())
        if rows and size + n > most:
            yield rows
            rows, size = [], 0
        rows.append((r["item_id"], r["text"]))
        size += n
    if rows:
        yield rows


def _prepared(benchmark: DataFrame, item_col: str, item_text_col: str, n: int, group_bytes: int):
    for rows in _groups(benchmark, item_col, item_text_col, group_bytes):
        yield prepare(rows, n)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = N, share: float = SHARE, enough: int = ENOUGH, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``doc_id, item_id, score, item_words, end_word`` of every document and test item that it holds a copy of."""
    base = picked(docs, id_col, text_col)
    schema = "doc_id long, item_id long, score long, item_words long, end_word long"
    out = None
    for items in _prepared(benchmark, item_col, item_text_col, n, group_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def make(shared=shared):
            items = shared.value
            seeds = HashSet(items.gram)
            ids, lengths = np.array(items.ids), np.array([len(x) for x in items.words])

            def one(part: pa.RecordBatch) -> pa.RecordBatch:
                d, i, s, e = matches(items, seeds, part.column("text"), n, share, enough)
                return pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(d)), pa.array(ids[i]), pa.array(s), pa.array(lengths[i]), pa.array(e)], ["doc_id", "item_id", "score", "item_words", "end_word"])

            return one

        found = map_slices(base.where("doc_id is not null and text is not null"), make, "text", schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    best = F.max_by(F.struct("score", "item_words", "end_word"), F.struct("score", -F.col("end_word"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.score", "b.item_words", "b.end_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = N, share: float = SHARE, enough: int = ENOUGH, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``docs`` less the rows whose text holds a copy of a test item; columns and their order stay."""
    for items in _prepared(benchmark, item_col, item_text_col, n, group_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def make(shared=shared):
            items = shared.value
            seeds = HashSet(items.gram)

            def one(part: pa.RecordBatch) -> pa.RecordBatch:
                keep = np.ones(part.num_rows, bool)
                keep[matches(items, seeds, part.column(text_col), n, share, enough)[0]] = False
                return part.filter(pa.array(keep))

            return one

        docs = map_slices(docs, make, text_col, docs.schema)
    return docs
