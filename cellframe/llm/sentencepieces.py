"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut into segments that no piece can cross (a run of blanks with the word after it; line breaks
and tabs alone). Distinct segments are encoded at once: flat arrays of symbols, in each round the
least pair rank of every segment, all leftmost occurrences of that pair merged together, the arrays
compacted, until no pair of any segment is a piece. Pieces that share one score (runs of blanks) are merged one at a time,
leftmost first, as the library does. Symbols outside the vocabulary fall back to their UTF-8 bytes.

The vocabulary is read from a public SentencePiece file of the BPE kind with identity normalisation; its path is a parameter.

Defined results: a null text has null ids, an empty text none; very long texts and words are encoded whole.
Decoding returns the text exactly, but for U+2581, which stands for a blank in the vocabulary. Rows with repeated or null ids are encoded each.
Of equal ranks the leftmost pair is merged. An empty table gives no rows. Extra columns, whatever their names (``ids``, ``exact``), are left out of the
result.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm._text import flat, map_slices, picked, tokenizer_path

MODEL = "piece_bpe_32k.model"
_NONE = np.iinfo(np.int32).max
_MARK = "▁"
_SPREAD, _MASK64 = 0x9E3779B97F4A7C15, (1 << 64) - 1


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece as sp

        model = sp.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.size = n
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte = np.full(256, -1, np.int64)
        plain = {}
        self.raw: list[bytes] = []
        for i, p in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.raw.append(bytes([int(p[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.raw.append(b"" if model.is_control(i) else " ⁇ ".encode())
            else:
                plain[p] = i
                self.raw.append(p.replace(_MARK, " ").encode())
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_length = np.array([len(r) for r in self.raw], np.int64)
        self.raw_start = np.concatenate([[0], np.cumsum(self.raw_length)[:-1]])
        self.letters = {ord(p): i for p, i in plain.items() if len(p) == 1}
        # letters that only longer pieces have stand as symbols of their own
        for p in plain:
            for c in p:
                self.letters.setdefault(ord(c), n + len(self.letters))
        symbols = {chr(c): i for c, i in self.letters.items()} | plain
        scores = {i: model.get_score(i) for i in plain.values()}
        levels = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.base = max(symbols.values()) + 1
        pairs = {}
        for p, i in plain.items():
            for k in range(1, len(p)):
                if (a := symbols.get(p[:k])) is not None and (b := symbols.get(p[k:])) is not None:
                    pairs[a * self.base + b] = (levels[scores[i]], i)
        self.pair = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.pair.tolist()], np.int32)
        self.into = np.array([pairs[k][1] for k in self.pair.tolist()], np.int32)
        # open addressing: a pair is at the first slots from its hash on, an empty slot ends the search
        self.slots = np.full(1 << 19, -1, np.int32)
        for k, key in enumerate(self.pair.tolist()):
            at = (key * _SPREAD & _MASK64) >> 45
            while self.slots[at] >= 0:
                at = (at + 1) & ((1 << 19) - 1)
            self.slots[at] = k
        shared = [0] * len(levels)
        for s in scores.values():
            shared[levels[s]] += 1
        self.tied = np.array(shared) > 1
        self.of_code = np.full(max(self.letters) + 1, -1, np.int32)
        self.of_code[list(self.letters)] = list(self.letters.values())

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols, and the piece that it makes."""
        key = left.astype(np.int64) * self.base + right
        key[(left < 0) | (right < 0)] = -1
        at = ((key.astype(np.uint64) * np.uint64(_SPREAD)) >> np.uint64(45)).astype(np.int64)
        k = self.slots[at]
        rank = np.full(len(key), _NONE, np.int32)
        into = np.zeros(len(key), np.int32)
        todo = np.flatnonzero(k >= 0)
        while len(todo):
            kt = k[todo]
            ok = self.pair[kt] == key[todo]
            rank[todo[ok]] = self.rank[kt[ok]]
            into[todo[ok]] = self.into[kt[ok]]
            todo = todo[~ok]
            at[todo] = (at[todo] + 1) & ((1 << 19) - 1)
            k[todo] = self.slots[at[todo]]
            todo = todo[k[todo] >= 0]
        return rank, into

    def encode_segments(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments one after another, and the number of each segment's ids.

        ``codes``: code points of all segments; ``lengths``: how many each has, one at least.
        """
        n = len(lengths)
        seg = np.repeat(np.arange(n, dtype=np.int32), lengths)
        codes = codes.astype(np.int32)
        sym = np.where(codes < len(self.of_code), self.of_code[np.minimum(codes, len(self.of_code) - 1)], np.int32(-1))
        sym = np.where(sym >= 0, sym, -1 - codes)  # below 0: a code point that no piece has
        done_sym, done_seg = [], []
        place = np.arange(len(sym), dtype=np.int32)
        done_place = []
        # rank[i] and into[i] are of the pair i, i + 1
        rank, into = self._pairs(sym, np.append(sym[1:], -1))
        rank[:-1][seg[1:] != seg[:-1]] = _NONE
        while len(sym):
            first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            least = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(sym)))
            # segments without a pair are finished and leave the arrays
            if (least == _NONE).any():
                go = np.repeat(least != _NONE, count)
                over = ~go
                done_sym.append(sym[over])
                done_seg.append(seg[over])
                done_place.append(place[over])
                sym, seg, place, rank, into = sym[go], seg[go], place[go], rank[go], into[go]
                count, least = count[least != _NONE], least[least != _NONE]
                if not len(sym):
                    break
            run = np.flatnonzero(rank == np.repeat(least, count))
            # of touching occurrences of one pair every other merges, from the left
            step = np.r_[True, np.diff(run) > 1]
            begin = np.maximum.accumulate(np.where(step, np.arange(len(run)), 0))
            chosen = (np.arange(len(run)) - begin) % 2 == 0
            tied = self.tied[rank[run]]
            if tied.any():
                lead = np.r_[True, seg[run][1:] != seg[run][:-1]]
                chosen = np.where(tied, lead, chosen)
            run = run[chosen]
            sym[run] = into[run]
            # the pair that the second half began belongs to the new symbol; both its neighbours' pairs are new
            keep = np.ones(len(sym), bool)
            keep[run + 1] = False
            sym, seg, place, rank, into = sym[keep], seg[keep], place[keep], rank[keep], into[keep]
            at = run - np.arange(len(run))
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            touched[at[at > 0] - 1] = True
            near = np.flatnonzero(touched)
            follow = np.minimum(near + 1, len(sym) - 1)
            rank[near], into[near] = self._pairs(sym[near], sym[follow])
            rank[near[(seg[follow] != seg[near]) | (follow == near)]] = _NONE
        sym, seg, place = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (done_sym, done_seg, done_place))
        order = np.argsort(place, kind="stable")
        sym, seg = sym[order], seg[order]
        # symbols that aren't pieces become bytes
        odd = np.flatnonzero((sym < 0) | (sym >= self.size))
        if len(odd):
            back = {i: c for c, i in self.letters.items() if i >= self.size}
            spelled = [chr(-1 - s) if s < 0 else chr(back[s]) for s in sym[odd].tolist()]
            spelled = [self.byte[list(c.encode("utf-8", "surrogatepass"))] for c in spelled]
            times = np.ones(len(sym), np.int64)
            times[odd] = [len(x) for x in spelled]
            seg = np.repeat(seg, times)
            new = np.repeat(sym, times)
            new[np.repeat(np.isin(np.arange(len(sym)), odd), times)] = np.concatenate(spelled)
            sym = new
        return sym.astype(np.int32), np.bincount(seg, minlength=n)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _spread(start: np.ndarray, count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Indexes ``start[i], start[i] + 1, ...``, ``count[i]`` of them for each i; ``total`` is the running sum of the counts."""
    n = int(total[-1]) if len(total) else 0
    kind = np.int32 if n < 1 << 31 and (not len(start) or int(start.max()) + n < 1 << 31) else np.int64
    out = np.repeat((start - (total - count)).astype(kind), count)
    out += np.arange(n, dtype=kind)
    return out


class Encoder:
    """Encodes columns of texts; remembers the segments that it has met, up to ``most``."""

    def __init__(self, vocab: Vocabulary, most: int = 400_000):
        self.vocab, self.most = vocab, most
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 20, np.int32)
        self.filled = 0
        self.start = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)

    def _learn(self, segments: list[bytes]) -> None:
        raw = b"".join(segments)
        # a segment is cut at blanks and line breaks only, so that all of them decode as one text
        codes = np.frombuffer(raw.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
        heads = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        ends = np.cumsum([len(s) for s in segments])
        lengths = np.diff(np.cumsum(heads)[ends - 1], prepend=0)
        ids, count = self.vocab.encode_segments(np.where(codes == 32, ord(_MARK), codes), lengths)
        n, k = self.filled + len(ids), len(self.known)
        while n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while k + len(segments) > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        self.ids[self.filled : n] = ids
        self.start[k : k + len(segments)] = self.filled + np.cumsum(count) - count
        self.count[k : k + len(segments)] = count
        self.known |= zip(segments, range(k, k + len(segments)), strict=True)
        self.filled = n

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of each text's ids."""
        # U+2581 in a text is a blank to the vocabulary
        column = pc.replace_substring(column.cast(pa.large_string()), _MARK, " ")
        data, offsets = flat(column)
        n = len(column)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        begin = np.zeros(len(data), bool)
        blank = data == 32
        begin[1:] = blank[1:] & ~blank[:-1]
        line = (data == 10) | (data == 9) | (data == 13)
        begin |= line
        begin[1:] |= line[:-1]
        begin[offsets[:-1]] = True
        at = np.flatnonzero(begin)
        full = np.diff(offsets) > 1  # an empty text is one blank here, and has no ids
        cuts = pa.array(np.append(at, len(data)), pa.int64())
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, cuts.buffers()[1], pa.py_buffer(data)]).dictionary_encode()
        names = words.dictionary.to_pylist()
        if len(self.known) + len(names) > self.most:
            self._clear()
        number = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = len(self.known) + np.arange(len(new))
            self._learn([names[i] for i in new.tolist()])
        code = number[words.indices.to_numpy(zero_copy_only=False)]
        text = np.repeat(np.arange(n), np.diff(np.searchsorted(at, offsets)))
        ok = full[text]
        code, text = code[ok], text[ok]
        count = self.count[code]
        total = np.cumsum(count)
        ids = self.ids[_spread(self.start[code], count, total)]
        return ids, np.bincount(text, count, n).astype(np.int64)


@lru_cache(maxsize=2)
def shared_encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker process: what it has met stays known."""
    return Encoder(vocabulary(path))


def decode(vocab: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """Texts of id sequences: their pieces' bytes, less the blank that encoding put in front."""
    length = vocab.raw_length[ids]
    total = np.cumsum(length)
    raw = vocab.raw_bytes[_spread(vocab.raw_start[ids], length, total)].tobytes()
    ends = np.concatenate([[0], total])[np.cumsum(counts)]
    out, a = [], 0
    for b in ends.tolist():
        part = raw[a:b]
        out.append((part[1:] if part[:1] == b" " else part).decode("utf-8", "replace"))
        a = b
    return out


def _lists(counts: np.ndarray, ids: np.ndarray, null: np.ndarray) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.append(null, False))
    return pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, verify: bool = True) -> DataFrame:
    """``doc_id, ids, n_ids, exact`` of every row; ``exact``: decoding gives the text again."""
    path = model or tokenizer_path(MODEL)

    def make():
        vocab = vocabulary(path)
        encoder = shared_encoder(path)

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            text = part.column("text")
            ids, counts = encoder.encode(text)
            null = pc.is_null(text).to_numpy(zero_copy_only=False)
            exact = pa.nulls(len(text), pa.bool_())
            if verify:
                again = pa.array(decode(vocab, ids, counts), pa.large_string())
                exact = pc.equal(again, text.cast(pa.large_string()))
            return pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(counts, ids, null), pa.array(counts, mask=null), exact], ["doc_id", "ids", "n_ids", "exact"])

        return one

    return map_slices(picked(docs, id_col, text_col), make, "text", "doc_id long, ids array<int>, n_ids long, exact boolean", 2 << 20)


def decode_ids(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """``doc_id, text`` of every row of ids; null ids give a null text."""
    path = model or tokenizer_path(MODEL)

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            ids = batch.column("ids")
            counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = decode(vocab, ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            null = pc.is_null(ids).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if x else t for t, x in zip(texts, null, strict=True)], pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")
