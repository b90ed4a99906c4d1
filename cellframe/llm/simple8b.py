"""Token ids as Simple-8b words: word-aligned packing with escapes and block offsets.

A text's ids are cut into blocks of ``BLOCK``; each block begins on a word of its own, whose index is in
``offsets``. A word's top four bits select how many ids of how many bits its other 60 bits hold. An id of
more than 60 bits is an escape: its word (selector 0) holds an index into ``escapes``. As the count
follows from the selector alone, all words of many texts are decoded at once, and any block by itself.

Packing takes the widest selector that fits at every position; all blocks advance together.

Defined results: null texts have null payloads, empty ones empty payloads; a block's last word may be partly filled.
Rows with repeated or null ids are packed each. Very long texts are packed whole, alone in their slice. Equal texts give equal words. An empty table
gives no rows. Extra columns, whatever their names (``payload``, ``n_ids``), are left out of the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm import sentencepieces as sp
from cellframe.llm._text import map_slices, picked, tokenizer_path

BLOCK = 256
#: Ids in a word and bits of each, by selector; 0 is the escape.
COUNT = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)


_SMALL = np.zeros(1 << 16, np.uint8)
for _k in range(16):
    _SMALL[1 << _k : 2 << _k] = _k + 1


def bit_length(x: np.ndarray) -> np.ndarray:
    if not len(x) or x.max() < 1 << 16:
        return _SMALL[x.astype(np.int64)]
    x = x.astype(np.uint64)
    out = np.zeros(len(x), np.uint8)
    for k in (48, 32, 16, 0):
        part = x >> np.uint64(k)
        new = (out == 0) & (part > 0)
        out[new] = _SMALL[part[new].astype(np.int64)] + np.uint8(k)
    return out


def widest(need: np.ndarray, block: int) -> np.ndarray:
    """Selector to begin with at each place of each block (rows of bit lengths, 0 after the end).

    The greatest bit length of the next n ids comes from those of shorter stretches, for all places at once.
    """
    room = np.zeros((len(need), block + 120), np.uint8)
    room[:, : need.shape[1]] = need
    most = {1: room}
    for n, (a, b) in {2: (1, 1), 3: (2, 2), 4: (2, 2), 5: (4, 4), 6: (4, 4), 7: (4, 4), 8: (4, 4), 10: (5, 5), 12: (6, 6), 15: (8, 8), 20: (10, 10), 30: (15, 15), 60: (30, 30), 120: (60, 60)}.items():
        m = most[a].copy()
        shift = n - b
        np.maximum(m[:, :-shift], most[b][:, shift:], out=m[:, :-shift])
        most[n] = m
    best = np.zeros((len(need), block), np.uint8)
    for s in range(15, 0, -1):
        np.copyto(best, np.uint8(s), where=most[int(COUNT[s])][:, :block] <= BITS[s])
    return best


def pack(ids: np.ndarray, counts: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, words of each text, block offsets (word index within the text), blocks of each text, escapes of all texts.

    Escapes' indexes count within the text.
    """
    n = len(ids)
    blocks = -(-counts // block)
    text_at = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = text_at[owner] + nth * block
    end = np.minimum(begin + block, (text_at + counts)[owner])
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64), z, blocks, np.zeros(0, np.uint64)
    size = end - begin
    row = np.repeat(np.arange(len(owner)), size)
    flat = row * block + np.arange(n) - np.repeat(begin, size)
    need = np.zeros(len(owner) * block, np.uint8)
    need[flat] = bit_length(ids)
    best = widest(need.reshape(-1, block), block).ravel()[flat].astype(np.int64)
    at, first = begin.copy(), []
    live = np.arange(len(begin))
    rounds = []
    while len(live):
        p = at[live]
        first.append(p)
        rounds.append(live)
        at[live] = p + np.minimum(COUNT[best[p]], end[live] - p)
        live = live[at[live] < end[live]]
    first, of = np.concatenate(first), np.concatenate(rounds)
    order = np.argsort(first, kind="stable")
    first, of = first[order], of[order]
    sel = best[first]
    words = sel.astype(np.uint64) << np.uint64(60)
    esc = sel == 0
    taken = np.minimum(COUNT[sel], end[of] - first)
    for s in range(2, 16):
        w = np.flatnonzero(sel == s)
        if len(w):
            for k in range(int(COUNT[s])):
                ok = w[taken[w] > k]
                words[ok] |= ids[first[ok] + k].astype(np.uint64) << np.uint64(int(BITS[s]) * k)
    if esc.any():
        e = np.flatnonzero(esc)
        text = owner[of[e]]
        words[e] = (np.arange(len(e)) - np.searchsorted(text, text)).astype(np.uint64)
    in_block = np.bincount(of, minlength=len(owner))
    per_text = np.bincount(owner, in_block, len(counts)).astype(np.int64)
    start = np.cumsum(in_block) - in_block
    offsets = start - (np.cumsum(per_text) - per_text)[owner]
    return words, per_text, offsets, blocks, ids[first[esc]].astype(np.uint64)


def unpack(words: np.ndarray, taken: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """Ids of ``words``, of which ``taken`` says how many each holds; ``escapes`` in the order of the escape words."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    total = np.cumsum(taken)
    out = np.zeros(int(total[-1]) if len(total) else 0, np.uint64)
    at = total - taken
    for s in range(2, 16):
        w = np.flatnonzero(sel == s)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(int(COUNT[s])):
            ok = w[taken[w] > k]
            if not len(ok):
                break
            out[at[ok] + k] = (words[ok] >> np.uint64(int(BITS[s]) * k)) & mask
    out[at[sel == 0]] = escapes
    return out


def holds(words: np.ndarray, offsets: np.ndarray, n_ids: int, block: int = BLOCK) -> np.ndarray:
    """How many ids each of one text's words holds: its selector's count, less at a block's end."""
    taken = COUNT[(words >> np.uint64(60)).astype(np.int64)].copy()
    if len(words):
        ends = np.append(offsets[1:], len(words)) - 1
        size = np.minimum(block, n_ids - block * np.arange(len(offsets)))
        taken[ends] -= np.add.reduceat(taken, offsets) - size
    return taken


def _longs(values: np.ndarray, counts: np.ndarray, kind: pa.DataType, null: np.ndarray) -> pa.Array:
    cut = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.append(null, False))
    return pa.ListArray.from_arrays(cut, pa.array(values, kind))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_ids, payload`` (little-endian words), ``offsets`` (first word of each block), ``escapes``."""
    path = model or tokenizer_path(sp.MODEL)

    def make():
        encoder = sp.shared_encoder(path)

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            null = pc.is_null(part.column("text")).to_numpy(zero_copy_only=False)
            ids, counts = encoder.encode(part.column("text"))
            words, per_text, offsets, blocks, escapes = pack(ids, counts, block)
            cut = pa.py_buffer(np.concatenate([[0], np.cumsum(per_text * 8)]).astype(np.int32))
            payload = pa.BinaryArray.from_buffers(pa.binary(), len(null), [None, cut, pa.py_buffer(words.astype("<u8"))])
            if null.any():
                payload = pc.if_else(pa.array(null), pa.scalar(None, pa.binary()), payload)
            none = pa.ListArray.from_arrays(pa.array(np.zeros(len(null) + 1, np.int32), mask=np.append(null, False)), pa.array([], pa.int64()))  # ids of a vocabulary never need more than 60 bits
            return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, mask=null), payload, _longs(offsets, blocks, pa.int32(), null), none], ["doc_id", "n_ids", "payload", "offsets", "escapes"])

        return one

    return map_slices(picked(docs, id_col, text_col), make, "text", "doc_id long, n_ids long, payload binary, offsets array<int>, escapes array<long>", 2 << 20)


def encode_ids(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", block: int = BLOCK) -> DataFrame:
    """The same for rows that have an array of ids (0 to 2**63 - 1) already."""

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            null = pc.is_null(ids).to_numpy(zero_copy_only=False)
            counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            words, per_text, offsets, blocks, escapes = pack(ids.flatten().to_numpy(zero_copy_only=False).astype(np.uint64), counts, block)
            ends = np.cumsum(per_text)
            payload = [None if x else words[a:b].astype("<u8").tobytes() for a, b, x in zip(ends - per_text, ends, null, strict=True)]
            escaped = np.add.reduceat(np.append((words >> np.uint64(60)) == 0, False).astype(np.int64), ends - per_text) * (per_text > 0) if len(ends) else ends
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, mask=null), pa.array(payload, pa.binary()), _longs(offsets, blocks, pa.int32(), null), _longs(escapes.astype(np.int64), escaped, pa.int64(), null)], ["doc_id", "n_ids", "payload", "offsets", "escapes"])

    some = rows.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<long>").alias("ids"))
    return some.mapInArrow(run, "doc_id long, n_ids long, payload binary, offsets array<int>, escapes array<long>")


def decode(packed: DataFrame, block: int = BLOCK) -> DataFrame:
    """``doc_id, ids`` of the rows that ``encode`` or ``encode_ids`` made."""

    def run(batches):
        for batch in batches:
            out = []
            for n, payload, offsets, escapes in zip(*(batch.column(c).to_pylist() for c in ("n_ids", "payload", "offsets", "escapes")), strict=True):
                if payload is None:
                    out.append(None)
                    continue
                words = np.frombuffer(payload, "<u8").astype(np.uint64)
                out.append(unpack(words, holds(words, np.array(offsets, np.int64), n, block), np.array(escapes, np.uint64)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return packed.select("doc_id", "n_ids", "payload", "offsets", "escapes").mapInArrow(run, "doc_id long, ids array<long>")
