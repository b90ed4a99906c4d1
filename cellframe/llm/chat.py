"""Chat formatting: roles of a transcript's lines by a hidden Markov model, then canonical turns.

A transcript is plain text, its turns more or less well marked (``User:``, ``### Assistant``, ``Q:``, or nothing).
Hidden states are a role with "begins a turn" or "goes on"; each line shows a marker (of which role, or none),
a length class, its ending, and whether a blank line is before it. Start, transition and emission
probabilities are counted, smoothed, on transcripts of known roles; Viterbi decoding gives every line's state,
for many transcripts at once. Turns are then rendered as ``<|role|>\\ntext\\n<|end|>\\n``, markers removed.

The query makes its transcripts of ``conversations``: turns in order, each behind its role's marker in one of
several conventions, and one in ``HIDDEN`` (chosen by hash) without marker, whose role has to be recovered. At most
``max_labelled`` conversations, chosen by a hash of their id, are counted for the model.

Defined results: null turn texts are left out, an unknown or null role has no marker and no truth; a conversation or transcript
without any line has no turn and an empty rendering. Rows with a null id are left out. Turns of equal number are ordered by role
and text; repeated rows of a conversation are repeated turns. Without any labelled line the model has equal emissions, so markers alone decide.
Of equally likely states the first counts. Very long texts are parsed whole, alone in their slice. An empty table gives no rows. Extra columns, whatever
their names (``rendered``, ``truth``), are left out of the result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm._text import map_slices

ROLES = ("system", "user", "assistant")
HIDDEN, MAX_LABELLED = 8, 2000
#: Ways of marking a turn, by role.
MARKERS = (
    ("System: ", "User: ", "Assistant: "),
    ("SYSTEM: ", "Human: ", "AI: "),
    ("### System: ", "### Instruction: ", "### Response: "),
    ("[system] ", "[user] ", "[assistant] "),
    ("Context: ", "Q: ", "A: "),
    ("<|system|> ", "<|user|> ", "<|assistant|> "),
)
_NAMED = {
    "system": 0, "context": 0, "instructions": 0, "developer": 0,
    "user": 1, "human": 1, "q": 1, "question": 1, "instruction": 1, "prompter": 1, "customer": 1, "student": 1, "usuario": 1, "utilisateur": 1, "nutzer": 1,
    "assistant": 2, "ai": 2, "bot": 2, "a": 2, "answer": 2, "response": 2, "gpt": 2, "model": 2, "agent": 2, "asistente": 2, "assistent": 2,
}
_MARK = re.compile(r"\s{0,3}(?:#{1,4}\s*|\*\*|[\[<]\|?)?(" + "|".join(sorted(_NAMED, key=len, reverse=True)) + r")(?:\*\*)?(?:\|?[\]>]:?|:|\s*>)(?:\*\*)?[ \t]*", re.I)
#: Values of each feature: marker (none or role), length class, ending, blank line before.
SIZES = (4, 6, 4, 2)
_ENDINGS = {"?": 1, ".": 2, "!": 2, ":": 3}


def observe(line: str, blank: bool) -> tuple[tuple[int, ...], str]:
    """Feature values of a line, and the line without its marker."""
    m = _MARK.match(line)
    mark = _NAMED[m.group(1).lower()] + 1 if m else 0
    rest = line[m.end() :] if m else line
    n = len(rest)
    size = 0 if n < 20 else 1 if n < 60 else 2 if n < 120 else 3 if n < 250 else 4 if n < 600 else 5
    return (mark, size, _ENDINGS.get(rest.rstrip()[-1:], 0), int(blank)), rest


def split(text: str) -> tuple[list[tuple[int, ...]], list[str]]:
    seen, rest, blank = [], [], False
    for line in text.split("\n"):
        if line.strip():
            o, r = observe(line, blank)
            seen.append(o)
            rest.append(r)
            blank = False
        else:
            blank = True
    return seen, rest


@dataclass
class Hmm:
    """Log probabilities; state ``2 * role`` begins a turn, ``2 * role + 1`` goes on with it."""

    start: np.ndarray
    move: np.ndarray
    emit: list[np.ndarray]  # states by values, for each feature


def fit(sequences: list[tuple[list[tuple[int, ...]], list[int]]], smooth: float = 0.5) -> Hmm:
    n = 2 * len(ROLES)
    start, move = np.full(n, smooth), np.full((n, n), smooth)
    emit = [np.full((n, k), smooth) for k in SIZES]
    for seen, states in sequences:
        if not states:
            continue
        start[states[0]] += 1
        np.add.at(move, (states[:-1], states[1:]), 1)
        for f, values in enumerate(zip(*seen, strict=True)):
            np.add.at(emit[f], (states, list(values)), 1)
    # what can't be: going on with a turn of another role, or at the start; a marker of another role
    start[1::2] = 0
    for i in range(n):
        for j in range(1, n, 2):
            if i // 2 != j // 2:
                move[i, j] = 0
    for s in range(n):
        wrong = [v for v in range(1, 4) if v != s // 2 + 1 or s % 2]
        emit[0][s, wrong] *= 1e-3
    with np.errstate(divide="ignore"):
        return Hmm(np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), [np.log(e / e.sum(axis=1, keepdims=True)) for e in emit])


def viterbi(hmm: Hmm, sequences: list[list[tuple[int, ...]]]) -> list[np.ndarray]:
    """The most likely states of each sequence, all decoded together."""
    n = np.array([len(s) for s in sequences], np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(first[-1], np.int64)
    if first[-1]:
        seen = np.array([o for s in sequences for o in s], np.int64)
        e = sum(table[:, seen[:, f]] for f, table in enumerate(hmm.emit)).T
        order = np.argsort(-n, kind="stable")
        reach = np.searchsorted(-n[order], -np.arange(1, n.max() + 1), side="right")
        steps = [first[order[:k]] + t for t, k in enumerate(reach)]
        score = hmm.start + e[steps[0]]
        scores, back = [score], []
        for at in steps[1:]:
            way = score[: len(at), :, None] + hmm.move
            back.append(way.argmax(axis=1))
            score = way.max(axis=1) + e[at]
            scores.append(score)
        state = np.zeros(0, np.int64)
        for t in range(len(steps) - 1, -1, -1):
            now = scores[t].argmax(axis=1)
            if len(state):
                now[: len(state)] = back[t][np.arange(len(state)), state]
            out[steps[t]] = now
            state = now
    return [out[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def turns_of(states: np.ndarray, rest: list[str]) -> list[tuple[str, str]]:
    out: list[tuple[str, list[str]]] = []
    for s, line in zip(states.tolist(), rest, strict=True):
        if s % 2 == 0 or not out:
            out.append((ROLES[s // 2], []))
        out[-1][1].append(line)
    return [(role, "\n".join(lines)) for role, lines in out]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


def transcripts(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", hidden: int = HIDDEN) -> DataFrame:
    """``doc_id, text, truth``: one transcript for each conversation; truth is the role and the number of lines of every turn."""
    base = conversations.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.lower(F.trim(F.col(f"`{role_col}`").cast("string"))).alias("role"), F.col(f"`{text_col}`").cast("string").alias("text")
    ).where("doc_id is not null")
    style = F.pmod(F.xxhash64("doc_id"), F.lit(len(MARKERS))).cast("int")
    marks = F.array(*[F.create_map(*[F.lit(x) for pair in zip(ROLES, m, strict=True) for x in pair]) for m in MARKERS])
    shown = (F.pmod(F.xxhash64("doc_id", "turn"), F.lit(hidden)) != 0) & F.col("role").isin(*ROLES)
    # a text's blank lines at its ends belong to no turn
    body = F.regexp_replace("text", r"^(?:[ \t\r]*\n)+|(?:\n[ \t\r]*)+$", "")
    line = F.when(shown, F.concat(F.element_at(F.element_at(marks, style + 1), F.col("role")), body)).otherwise(body)
    kept = F.when(F.trim(F.regexp_replace("text", r"\s", "")) != "", F.struct("turn", "role", line.alias("line")))
    grouped = base.groupBy("doc_id").agg(F.array_sort(F.collect_list(kept)).alias("turns"))
    lines = F.transform("turns", lambda t: F.size(F.filter(F.split(t["line"], "\n"), lambda x: F.length(F.regexp_replace(x, r"\s", "")) > 0)))
    return grouped.select("doc_id", F.concat_ws("\n", F.col("turns.line")).alias("text"), F.arrays_zip(F.col("turns.role").alias("role"), lines.alias("n")).alias("truth"))


def states_of(truth) -> list[int]:
    """States that the truth gives, -1 where the role is unknown."""
    out = []
    for t in truth or []:
        r = ROLES.index(t["role"]) if t["role"] in ROLES else -1
        out += [2 * r + (k > 0) if r >= 0 else -1 for k in range(t["n"])]
    return out


def train(made: DataFrame, max_labelled: int = MAX_LABELLED) -> Hmm:
    # the ids alone are sorted; the conversations of the chosen ones are then made from just their rows
    some = made.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = made.join(F.broadcast(some), "doc_id", "left_semi").collect()
    examples = []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        seen, states = split(r["text"])[0], states_of(r["truth"])
        if states and -1 not in states and len(states) == len(seen):
            examples.append((seen, states))
    return fit(examples)


def parse(texts: DataFrame, hmm: Hmm, id_col: str = "doc_id", text_col: str = "text", truth_col: str | None = None) -> DataFrame:
    """``doc_id, roles, rendered, n_lines, right_lines``: turns recovered from transcripts.

    ``right_lines`` counts the lines whose role is the truth's; null without a truth.
    """
    truth = F.col(f"`{truth_col}`") if truth_col else F.lit(None).cast("array<struct<role:string,n:int>>")
    some = texts.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), truth.alias("truth")).where("doc_id is not null")

    def make():
        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            pairs = [split(t or "") for t in part.column("text").to_pylist()]
            states = viterbi(hmm, [p[0] for p in pairs])
            turns = [turns_of(s, p[1]) for s, p in zip(states, pairs, strict=True)]
            right = []
            for s, t in zip(states, part.column("truth").to_pylist(), strict=True):
                true = None if t is None else states_of(t)
                right.append(None if true is None or len(true) != len(s) else sum(a // 2 == b // 2 for a, b in zip(s.tolist(), true, strict=True) if b >= 0))
            return pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([[r for r, _ in t] for t in turns], pa.list_(pa.string())), pa.array([render(t) for t in turns], pa.string()), pa.array([len(s) for s in states], pa.int64()), pa.array(right, pa.int64())],
                ["doc_id", "roles", "rendered", "n_lines", "right_lines"],
            )

        return one

    return map_slices(some, make, "text", "doc_id long, roles array<string>, rendered string, n_lines long, right_lines long")


def format_conversations(conversations: DataFrame, max_labelled: int = MAX_LABELLED, hidden: int = HIDDEN, **columns) -> DataFrame:
    """Conversations as transcripts, their roles recovered and rendered; the id is ``conv_id``."""
    made = transcripts(conversations, hidden=hidden, **columns)
    return parse(made, train(made, max_labelled), truth_col="truth").withColumnRenamed("doc_id", "conv_id")
