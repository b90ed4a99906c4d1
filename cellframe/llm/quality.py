"""Line quality by a linear-chain conditional random field.

Every line of a text is content or boilerplate. Features of a line (length, shares of letters, capitals,
digits and signs, words repeated at once, lines repeated in the text, closing punctuation, place) and of neighbouring
labels are weighed by a linear-chain CRF, whose most likely labels Viterbi decoding gives, for many texts at
once. A text is kept if at least ``least_share`` of its characters are content.

The CRF is fitted to documents labelled by quality. Such a label only bounds the share of a document's lines that are content; which
lines those are is inferred (``fit``). At most ``max_labelled`` documents are used, chosen by a hash of their id. Everything else
covers all rows and whole texts.

Defined results: null, empty and blank texts have no line; their share is 0 and they aren't kept. Blank lines
belong to no label. Without labels of both classes every line is content. Rows with repeated or null ids are judged
each; of an id labelled several times the greatest label counts. Very long texts, and very long lines, are judged whole, alone in their
slice. Of two equally likely labels a line is boilerplate. An empty table gives no rows. Extra columns, whatever their names
(``kept``, ``n_lines``), are left out of the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm._text import _WORD, flat, map_slices, mix, picked, _powers

MAX_LABELLED, LEAST_SHARE, L2, PASSES, SETTLED = 4000, 0.5, 1e-5, 3, 0.002

_LETTER = np.zeros(256, np.uint8)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = 1
_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.uint8)
_DIGIT[48:58] = 1
_SIGN = np.zeros(256, np.uint8)
_SIGN[[*b"#$%&*+<=>@[\\]^_`{|}~!/"]] = 1
_BLANK = np.zeros(256, np.uint8)
_BLANK[[9, 10, 11, 12, 13, 32]] = 1
_HEAD = np.ones(256, np.uint8)  # all but UTF-8 continuation bytes
_HEAD[128:192] = 0
_CLOSING = frozenset(b".!?:;\"')")

NAMES = ("bias", "short", "middle", "long", "few_letters", "capitals", "many_capitals", "some_digits", "digits", "some_signs", "signs", "same_word", "same_words", "seen", "seen_often", "no_close", "one_word", "first", "last", "long_words", "tiny_words")


@dataclass
class Lines:
    features: np.ndarray  # lines by features, 0 or 1
    chars: np.ndarray
    first: np.ndarray  # index of each text's first line, and the end


def lines_of(column: pa.Array) -> Lines:
    """Non-blank lines of all texts and their features."""
    data, offsets = flat(column)
    texts = len(offsets) - 1
    if not len(data):
        return Lines(np.zeros((0, len(NAMES))), np.zeros(0, np.int64), np.zeros(texts + 1, np.int64))
    cut = np.union1d(np.flatnonzero(data == 10), offsets[:-1][np.diff(offsets) > 0])
    if cut[0] != 0:
        cut = np.r_[0, cut]

    def total(table: np.ndarray) -> np.ndarray:
        c = np.zeros(len(data) + 1, np.int32)
        np.cumsum(table[data], out=c[1:])
        return c[np.r_[cut[1:], len(data)]] - c[cut]

    blank = total(_BLANK)
    size = np.diff(np.r_[cut, len(data)])
    chars = total(_HEAD) - 1
    ok = size > blank
    # words: spans, hashes, and whether one equals the word before it on the line
    w = _WORD[data].view(np.int8)
    edge = np.diff(w, prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    p, inv = _powers(len(data) + 1)
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=s[1:])
    h = (s[end] - s[start]) * inv[start]
    line = np.searchsorted(cut, start, side="right") - 1
    words = np.bincount(line, minlength=len(cut))
    same = np.zeros(len(cut), np.int64)
    if len(h) > 1:
        np.add.at(same, line[1:][(h[1:] == h[:-1]) & (line[1:] == line[:-1])], 1)
    letters, upper, digits, signs = total(_LETTER), total(_UPPER), total(_DIGIT), total(_SIGN)
    # lines seen before in the text: by hash of the whole line without its break
    stop = np.r_[cut[1:], len(data)]
    lh = mix((s[stop] - s[cut + 1]) * inv[np.minimum(cut + 1, len(data))])
    text = np.searchsorted(offsets, cut, side="right") - 1
    order = np.lexsort((np.arange(len(cut)), lh, text))
    again = np.zeros(len(cut), bool)
    again[1:] = (lh[order][1:] == lh[order][:-1]) & (text[order][1:] == text[order][:-1])
    group = np.cumsum(~again) - 1
    times = np.bincount(group)[group]
    seen = np.zeros(len(cut), np.int64)
    seen[order] = times
    tail = data[np.maximum(stop - 1, 0)]
    closed = np.isin(tail, list(_CLOSING))
    n = np.maximum(chars, 1)
    word = np.maximum(words, 1)
    ok_text = text[ok]
    first = np.searchsorted(ok_text, np.arange(texts + 1))
    is_first = np.zeros(len(ok_text), bool)
    is_last = np.zeros(len(ok_text), bool)
    has = np.diff(first) > 0
    is_first[first[:-1][has]] = True
    is_last[first[1:][has] - 1] = True
    x = np.stack(
        [
            np.ones(len(cut), bool), chars < 20, (chars >= 20) & (chars < 80), chars >= 200, letters < 0.6 * n, upper > 0.3 * np.maximum(letters, 1), upper > 0.6 * np.maximum(letters, 1),
            digits > 0.05 * n, digits > 0.2 * n, signs > 0.03 * n, signs > 0.1 * n, same > 0, same > 0.3 * word, seen > 1, seen > 3, ~closed, words <= 1,
            np.zeros(len(cut), bool), np.zeros(len(cut), bool), chars > 12 * word, chars < 3.5 * word,
        ],
        axis=1,
    )[ok].astype(float)
    x[:, NAMES.index("first")] = is_first
    x[:, NAMES.index("last")] = is_last
    return Lines(x, chars[ok].astype(np.int64), first)


@dataclass
class Crf:
    emit: np.ndarray  # features by labels (0 boilerplate, 1 content)
    move: np.ndarray  # labels by labels


def _steps(first: np.ndarray):
    """Texts by falling length, and for each position the index of the line of every text that reaches it."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    reach = np.searchsorted(-n[order], -np.arange(1, (n.max() if len(n) else 0) + 1), side="right")
    return order, [first[order[:k]] + t for t, k in enumerate(reach)]


def viterbi(crf: Crf, lines: Lines) -> np.ndarray:
    """The most likely label of every line."""
    e = lines.features @ crf.emit
    out = np.zeros(len(e), np.int64)
    order, steps = _steps(lines.first)
    if not steps:
        return out
    score = e[steps[0]]
    back = []
    scores = [score]
    for at in steps[1:]:
        k = len(at)
        way = score[:k, :, None] + crf.move
        back.append(way.argmax(axis=1))
        score = way.max(axis=1) + e[at]
        scores.append(score)
    label = np.zeros(0, np.int64)
    for t in range(len(steps) - 1, -1, -1):
        k, m = len(steps[t]), len(label)
        now = scores[t].argmax(axis=1)  # where a text ends here
        if m:
            now[:m] = back[t][np.arange(m), label]
        out[steps[t]] = now[:k]
        label = now
    return out


def _gradient(crf: Crf, lines: Lines, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood of labels ``y``, its gradient, and each line's marginal probabilities, by forward and backward sums."""
    e = lines.features @ crf.emit
    order, steps = _steps(lines.first)
    alpha = np.zeros_like(e)
    beta = np.zeros_like(e)
    alpha[steps[0]] = e[steps[0]]
    for before, at in zip(steps, steps[1:], strict=False):
        k = len(at)
        alpha[at] = np.logaddexp.reduce(alpha[before[:k], :, None] + crf.move, axis=1) + e[at]
    for before, at in zip(steps[-2::-1], steps[:0:-1], strict=True):
        k = len(at)
        beta[before[:k]] = np.logaddexp.reduce(crf.move + (e[at] + beta[at])[:, None, :], axis=2)
    last = lines.first[1:] - 1
    some = np.diff(lines.first) > 0
    z = np.zeros(len(some))
    z[some] = np.logaddexp.reduce(alpha[last[some]], axis=1)
    text = np.repeat(np.arange(len(some)), np.diff(lines.first))
    p = np.exp(alpha + beta - z[text, None])
    truth = np.zeros_like(p)
    truth[np.arange(len(y)), y] = 1
    g_emit = lines.features.T @ (truth - p)
    inner = np.flatnonzero(text[1:] == text[:-1])
    pair = np.exp(alpha[inner, :, None] + crf.move + (e[inner + 1] + beta[inner + 1])[:, None, :] - z[text[inner], None, None])
    g_move = -pair.sum(axis=0)
    np.add.at(g_move, (y[inner], y[inner + 1]), 1)
    value = e[np.arange(len(y)), y].sum() + crf.move[y[inner], y[inner + 1]].sum() - z[some].sum()
    return value, g_emit, g_move, p


def evidence(features: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log-odds of content that each line's own features give by naive Bayes, both labels being equally likely at first.

    Labels may be noisy: what a wrongly labelled line shares with the rest of its kind outvotes its label. Every feature has its own say, so
    a sign of boilerplate isn't explained away by another that goes with it in poor documents.
    """
    rate = [(features[y == k].sum(axis=0) + 1) / ((y == k).sum() + 2) for k in (0, 1)]
    on, off = np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0]))
    return features @ (on - off) + off.sum()


def bounded(odds: np.ndarray, lines: Lines, quality: np.ndarray, least_share: float) -> np.ndarray:
    """Labels of lines by their log-odds, as far as each document's label allows: content is under ``least_share`` of the characters of a
    poor document and at least that of a good one; the least certain lines change until that holds.
    """
    text = np.repeat(np.arange(len(quality)), np.diff(lines.first))
    good = quality[text] > 0
    # the lines most certain to have the document's own label come first: they take it until its share is reached
    order = np.lexsort((np.where(good, -odds, odds), text))
    chars = lines.chars[order].astype(float)
    before = np.cumsum(chars) - chars
    whole = np.bincount(text, lines.chars, len(quality))
    start = np.concatenate([[0.0], np.cumsum(whole)])[:-1]
    within = before - start[text[order]]
    share = np.where(quality > 0, least_share, 1 - least_share)[text[order]]
    must = np.empty(len(odds), bool)
    # a poor document needs more than the share, a good one the share
    limit = share * whole[text[order]]
    must[order] = np.where(good[order], within < limit, within <= limit)
    return np.where(must, good, odds > 0).astype(np.int64)


def fit(texts: list[str], quality: list[int], rounds: int = 250, l2: float = L2, passes: int = PASSES, least_share: float = LEAST_SHARE) -> Crf | None:
    """None without lines of both classes.

    A document's label bounds the share of its lines that are content and says nothing of any one line. So lines begin with the label that
    their own features make likelier over all labelled documents, within those bounds; the CRF is fitted to these sequences, labels are
    drawn again from its marginals within the bounds, until less than ``SETTLED`` of them change, ``passes`` times at most.
    """
    parts = [lines_of(pa.array(texts[a : a + 200], pa.string())) for a in range(0, len(texts), 200)]
    if not parts:
        return None
    per = np.concatenate([np.diff(p.first) for p in parts])
    lines = Lines(np.concatenate([p.features for p in parts]), np.concatenate([p.chars for p in parts]), np.concatenate([[0], np.cumsum(per)]))
    given = np.asarray(quality, np.int64)
    y = np.repeat(given, np.diff(lines.first))
    if not len(y) or not 0 < y.sum() < len(y):
        return None
    for _ in range(passes):
        y = bounded(evidence(lines.features, y), lines, given, least_share)
    crf = Crf(np.zeros((len(NAMES), 2)), np.zeros((2, 2)))
    n = len(y)
    for again in range(passes):
        m = [np.zeros_like(crf.emit), np.zeros_like(crf.move)]
        v = [np.zeros_like(crf.emit), np.zeros_like(crf.move)]
        for t in range(1, (rounds if not again else rounds // 2) + 1):
            ge, gm = _gradient(crf, lines, y)[1:3]
            for k, (g, w) in enumerate(((ge, crf.emit), (gm, crf.move))):
                g = g / n - 2 * l2 * w
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                w += 0.1 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-9)
        if again < passes - 1:
            p = _gradient(crf, lines, y)[3]
            new = bounded(np.log(p[:, 1] + 1e-12) - np.log(p[:, 0] + 1e-12), lines, given, least_share)
            if (new != y).mean() < SETTLED:
                break
            y = new
    return crf


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Crf | None:
    named = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("quality")).dropna()
    some = named.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = picked(docs, id_col, text_col).dropna().join(F.broadcast(some), "doc_id").select("doc_id", "text", "quality").toPandas().sort_values(["doc_id", "text"], ignore_index=True)
    return fit(rows.pop("text").tolist(), rows["quality"].clip(0, 1).tolist())


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_share: float = LEAST_SHARE, crf: Crf | None = None, **how) -> DataFrame:
    """``doc_id, n_lines, content_lines, content_share, kept`` of every row."""
    crf = crf or train(docs, labels, id_col=id_col, text_col=text_col, **how)

    def make():
        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            lines = lines_of(part.column("text"))
            label = viterbi(crf, lines) if crf is not None else np.ones(len(lines.chars), np.int64)
            n = np.diff(lines.first)
            text = np.repeat(np.arange(len(n)), n)
            content = np.bincount(text, label, len(n)).astype(np.int64)
            whole = np.bincount(text, lines.chars, len(n))
            share = np.round(np.bincount(text, lines.chars * label, len(n)) / np.maximum(whole, 1), 6)
            return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(content), pa.array(share), pa.array((share >= least_share) & (n > 0))], ["doc_id", "n_lines", "content_lines", "content_share", "kept"])

        return one

    return map_slices(picked(docs, id_col, text_col), make, "text", "doc_id long, n_lines long, content_lines long, content_share double, kept boolean")
