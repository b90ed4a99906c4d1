"""Counterfactual-regularised toxicity classifier.

A logistic model over the presence of words and of word beginnings, and over those that a text has ``OFTEN`` times or
more (insults built on one stem, each form of which is rare). It is fitted on labelled documents; sentences of theirs that name a group of people are rewritten with another group, and with
a neutral word, and the squared change of the score is penalised. So a group's name alone can't
carry weight, and neutral mentions of a group aren't taken for abuse.

Features are kept that occur far more often in toxic texts than chance allows (a likelihood ratio test
over the labelled sample). The fit uses at most ``max_labelled`` labelled documents, chosen by a hash of
their id; everything else covers all rows.

A text is toxic from the score on that parts the labelled sample best by F1, with the groups that it names made neutral, so that what weight
their names have left decides nothing; unless a ``cutoff`` is given.

Defined results: null, empty or wordless texts have the score of the bias alone. Without labels of both classes nothing is toxic (score 0). Labelled rows
without a text, and null labels, are left out of the fit; of an id labelled several times the greatest label counts. Rows with repeated or null ids are
scored each. Very long texts are scored whole, alone in their slice. An empty table gives no rows. Extra columns, whatever their names (``score``,
``toxic``), are left out of the scores and kept as they are by ``drop_toxic``. Equal scores get equal verdicts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm._text import HashSet, Words, map_slices, picked

MAX_LABELLED, PREFIXES, OFTEN = 8000, (4, 5, 6, 7, 8), 3
LEAST_G2, LEAST_LIFT, L2, COUNTERFACTUAL = 10.0, 3.0, 1e-4, 1.0

#: Groups of terms that stand for one another; the first list's words are replaced by words of the same list and by ``NEUTRAL``.
IDENTITY = (
    ("women", "men", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("woman", "man", "girl", "boy", "frau", "mann", "femme", "homme", "mujer", "hombre"),
    ("gay", "straight", "lesbian", "queer", "bisexual", "transgender", "homosexual", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "latino", "hispanic", "african", "arab", "european", "indigenous"),
    ("immigrant", "refugee", "foreigner", "citizen", "native", "migrant"),
    ("immigrants", "refugees", "foreigners", "citizens", "natives", "migrants"),
    ("deaf", "blind", "disabled", "autistic", "elderly", "young"),
)
NEUTRAL = "person"


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    cutoff: float  # a text is toxic from this score on


#: Makes the name of "often" out of a feature's.
_MANY = np.uint64(0xD6E8FEB86659FD93)


def features(column: pa.Array, prefixes: tuple[int, ...] = PREFIXES) -> tuple[np.ndarray, np.ndarray, int]:
    """Feature hashes of all words, the text of each, and the number of texts."""
    w = Words(column)
    doc = w.doc_of()
    length = w.end - w.start
    hashes, docs = [w.hashes()], [doc]
    for k in prefixes:
        long = length >= k
        hashes.append(w.span_hash(w.start[long], w.start[long] + k) ^ np.uint64(k))
        docs.append(doc[long])
    return np.concatenate(hashes), np.concatenate(docs), len(column)


def presence(column: pa.Array, prefixes: tuple[int, ...] = PREFIXES) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature), and the features that a text has often."""
    h, d, _ = features(column, prefixes)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    many = first[np.diff(np.append(first, len(h))) >= OFTEN]
    return np.concatenate([d[first], d[many]]), np.concatenate([h[first], h[many] ^ _MANY])


def swaps(sentence: str) -> list[str]:
    """The sentence with each named group replaced by each other of its list, and by a neutral word."""
    found = {w for w in re.findall(r"\w+", sentence.lower())}
    out = []
    for group in IDENTITY:
        for term in sorted(found & set(group)):
            for other in (*group, NEUTRAL):
                if other != term:
                    out.append(re.sub(rf"(?i)\b{re.escape(term)}\b", other, sentence))
    return out


def _g2(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    n = a + b
    with np.errstate(divide="ignore", invalid="ignore"):
        def term(x, e):
            return np.where(x > 0, x * np.log(x / e), 0)

        return 2 * (term(a, n * na / (na + nb)) + term(b, n * nb / (na + nb)) + term(na - a, (na + nb - n) * na / (na + nb)) + term(nb - b, (na + nb - n) * nb / (na + nb)))


def fit(texts: list[str], toxic: list[int], counterfactual: float = COUNTERFACTUAL, l2: float = L2, rounds: int = 400, prefixes: tuple[int, ...] = PREFIXES) -> Model | None:
    """None without examples of both classes."""
    y = np.asarray(toxic, float)
    if not len(y) or not 0 < y.sum() < len(y):
        return None

    def parts(which: np.ndarray):
        for a in range(0, len(which), 100):
            d, h = presence(pa.array([texts[i] for i in which[a : a + 100]], pa.string()), prefixes)
            yield which[a : a + 100][d], h

    nt, nc = y.sum(), len(y) - y.sum()
    # what is too rare in toxic texts to pass the test, even if absent from the others, is left out at once: a table of
    # counts by a few bits of the hash, which are never below a feature's own count, tells most of it before any name is kept
    toxic_texts, table = np.flatnonzero(y > 0), np.zeros(1 << 22, np.int32)
    for _, h in parts(toxic_texts):
        np.add.at(table, (h >> np.uint64(42)).astype(np.int64), 1)
    enough = _g2(np.arange(nt + 1), np.zeros(int(nt) + 1), nt, nc) >= LEAST_G2
    least = int(np.argmax(enough)) if enough.any() else int(nt) + 1
    names, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for _, h in parts(toxic_texts):
        h = h[table[(h >> np.uint64(42)).astype(np.int64)] >= least]
        names, inverse = np.unique(np.concatenate([names, h]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([counts, np.ones(len(h), np.int64)]), len(names)).astype(np.int64)
    some = _g2(counts.astype(float), np.zeros(len(counts)), nt, nc) >= LEAST_G2
    likely, in_toxic = HashSet(names[some]), counts[some].astype(float)
    if not len(likely.values):
        return None
    in_clean = np.zeros(len(in_toxic))
    for _, h in parts(np.flatnonzero(y == 0)):
        in_clean += np.bincount(likely.find(h)[1], minlength=len(in_clean))
    lift = ((in_toxic + 0.5) / (nt + 1)) / ((in_clean + 0.5) / (nc + 1))
    chosen = HashSet(likely.values[(_g2(in_toxic, in_clean, nt, nc) >= LEAST_G2) & (lift >= LEAST_LIFT)])
    if not len(chosen.values):
        return None
    rows, cols = [], []
    for d, h in parts(np.arange(len(y))):
        at, k = chosen.find(h)
        rows.append(d[at])
        cols.append(k)
    row, col = np.concatenate(rows), np.concatenate(cols)

    # differences that swapping makes, over the sentences of labelled documents that name a group
    terms = re.compile(r"(?i)\b(?:" + "|".join(sorted({t for g in IDENTITY for t in g}, key=len, reverse=True)) + r")\b")
    before, after = [], []
    for text in texts:
        if terms.search(text):
            for sentence in re.split(r"(?<=[.!?])\s+|\n", text):
                if terms.search(sentence):
                    new = swaps(sentence)
                    before += [sentence] * len(new)
                    after += new
    crow = ccol = np.zeros(0, np.int64)
    csign = np.zeros(0)
    if before:
        sides = []
        for side, sign in ((before, 1.0), (after, -1.0)):
            pd_, ph = presence(pa.array(side, pa.string()), prefixes)
            i, c = chosen.find(ph)
            sides.append((pd_[i], c, np.full(len(i), sign)))
        crow, ccol, csign = (np.concatenate(x) for x in zip(*sides, strict=True))

    n, f = len(y), len(chosen.values)
    balance = np.where(y > 0, n / (2 * nt), n / (2 * nc))
    w, bias = np.zeros(f), 0.0
    m, v, t = np.zeros(f + 1), np.zeros(f + 1), 0
    for _ in range(rounds):
        z = np.bincount(row, w[col], n) + bias
        r = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = np.bincount(col, r[row], f) + 2 * l2 * w
        if len(crow):
            change = np.bincount(crow, csign * w[ccol], len(before))
            g += 2 * counterfactual * np.bincount(ccol, csign * change[crow], f) / len(before)
        g = np.append(g, r.sum())
        t += 1
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    z = np.bincount(row, w[col], n) + bias
    for i in np.flatnonzero([terms.search(t) is not None for t in texts]):
        _, h = presence(pa.array([terms.sub(NEUTRAL, texts[i])], pa.string()), prefixes)
        z[i] = w[chosen.find(h)[1]].sum() + bias
    return Model(chosen.values, w, float(bias), cutoff_of(z, y))


def cutoff_of(z: np.ndarray, y: np.ndarray) -> float:
    """Score that parts the labelled sample best (F1), in the middle of the gap."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    last = np.flatnonzero(np.r_[np.diff(z) < 0, True])
    right = np.cumsum(y)[last]
    f1 = 2 * right / (last + 1 + y.sum())
    k = int(np.argmax(f1))
    middle = (z[last[k]] + z[last[k] + 1]) / 2 if last[k] + 1 < len(z) else z[last[k]] - 1e-9
    return float(1 / (1 + np.exp(-np.clip(middle, -30, 30))))


def score(model: Model | None, column: pa.Array, prefixes: tuple[int, ...] = PREFIXES) -> np.ndarray:
    if model is None:
        return np.zeros(len(column))
    h, d, n = features(column, prefixes)
    known = HashSet(model.features)
    at, k = known.find(h)
    once = np.unique(d[at] * len(model.features) + k)
    at, k = known.find(h ^ _MANY)
    many, times = np.unique(d[at] * len(model.features) + k, return_counts=True)
    pair = np.concatenate([once, many[times >= OFTEN]])
    z = np.bincount(pair // len(model.features), model.weights[pair % len(model.features)], n) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **how) -> Model | None:
    named = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).dropna()
    some = named.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = picked(docs, id_col, text_col).dropna().join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic").toPandas().sort_values(["doc_id", "text"], ignore_index=True)
    return fit(rows.pop("text").tolist(), rows["toxic"].clip(0, 1).tolist(), **how)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cutoff: float | None = None, model: Model | None = None, **how) -> DataFrame:
    """``doc_id, score, toxic`` of every row."""
    model = model or train(docs, labels, id_col=id_col, text_col=text_col, **how)
    cutoff = cutoff if cutoff is not None else model.cutoff if model else 1.0

    def make():
        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            s = score(model, part.column("text"))
            return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.round(s, 6)), pa.array(s >= cutoff)], ["doc_id", "score", "toxic"])

        return one

    return map_slices(picked(docs, id_col, text_col), make, "text", "doc_id long, score double, toxic boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", cutoff: float | None = None, **how) -> DataFrame:
    """``docs`` less the rows whose text is toxic; columns and their order stay."""
    model = train(docs, labels, text_col=text_col, **how)
    cutoff = cutoff if cutoff is not None else model.cutoff if model else 1.0

    def make():
        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            return part.filter(pa.array(score(model, part.column(text_col)) < cutoff))

        return one

    return map_slices(docs, make, text_col, docs.schema)
