"""Licence wording found by token automata compiled from template markup.

A template is a run of mandatory words with optional and replaceable regions.
All templates become one deterministic automaton over word numbers. It starts at every
word that can begin a template; all started runs of a slice of text step through
the automaton together, and those without a next state drop out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .license_wording import BASE_PHRASES, WORDINGS

MOST_STATES = 100_000
_MARK = re.compile(r"<<(optional|end|any:(\d+))>>|([^\s<]+)")
_WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


@dataclass(frozen=True)
class Template:
    """A label and its wording: lower-case words, ``<<optional>> ... <<end>>`` and ``<<any:n>>``."""

    label: str
    wording: str
    base: bool = False

    @property
    def mandatory(self) -> int:
        """Words that every accepted text has."""
        depth = words = 0
        for kind, _, word in _MARK.findall(self.wording):
            depth += (kind == "optional") - (kind == "end")
            words += bool(word) and depth == 0
        return words


TEMPLATES = [*(Template(label, phrase, True) for phrase, label in BASE_PHRASES.items()),
             *(Template(label, wording) for label, wording in WORDINGS.items())]


class _Loose:
    """The templates as a nondeterministic automaton: word edges, free edges and edges for any word."""

    def __init__(self, templates: Sequence[Template]):
        self.words: list[dict[str, list[int]]] = []
        self.free: list[list[int]] = []
        self.any: list[list[int]] = []
        self.ends: dict[int, int] = {}
        self.start = self.state()
        for number, template in enumerate(templates):
            self._add(number, template)

    def state(self) -> int:
        self.words.append({})
        self.free.append([])
        self.any.append([])
        return len(self.words) - 1

    def _add(self, number: int, template: Template) -> None:
        if not template.mandatory:
            raise ValueError(f"{template.label}: a template needs a mandatory word")
        at, opened = self.state(), []
        self.free[self.start].append(at)
        for kind, most, word in _MARK.findall(template.wording):
            if word:
                if not _WORD.fullmatch(word):
                    raise ValueError(f"{template.label}: {word!r} is not a word")
                to = self.state()
                self.words[at].setdefault(word, []).append(to)
                at = to
            elif kind == "optional":
                opened.append(at)
            elif kind == "end":
                to = self.state()
                self.free[at].append(to)
                self.free[opened.pop()].append(to)
                at = to
            else:
                steps = [at, *(self.state() for _ in range(int(most)))]
                to = self.state()
                for a, b in zip(steps, steps[1:]):
                    self.any[a].append(b)
                for a in steps:
                    self.free[a].append(to)
                at = to
        if opened:
            raise ValueError(f"{template.label}: an optional region is not closed")
        self.ends[at] = number

    def closed(self, states: set[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in found:
                    found.add(to)
                    todo.append(to)
        return frozenset(found)


class Automaton:
    """``step[state, word]`` with 0 for no state, 1 for the start; word 0 is any word no template names."""

    def __init__(self, templates: Sequence[Template]):
        loose = _Loose(templates)
        self.vocabulary = sorted({w for edges in loose.words for w in edges})
        self.templates = list(templates)
        states = {frozenset(): 0, loose.closed({loose.start}): 1}
        todo, rows = list(states), []
        while todo:
            now = todo.pop(0)
            row = []
            for word in [None, *self.vocabulary]:
                to = loose.closed({t for s in now for t in [*loose.any[s], *loose.words[s].get(word, [])]})
                if to not in states:
                    states[to] = len(states)
                    todo.append(to)
                    if len(states) > MOST_STATES:
                        raise ValueError("the templates need too many states")
                row.append(states[to])
            rows.append(row)
        self.step = np.array(rows, dtype=np.int32)
        self.accepts = np.zeros((len(states), len(templates)), dtype=bool)
        for members, state in states.items():
            for s in members & loose.ends.keys():
                self.accepts[state, loose.ends[s]] = True
        self.ending = self.accepts.any(axis=1)

    def matches(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end (exclusive) and template of the longest acceptance of each template at each start.

        ``words`` are word numbers, ``ends`` the end of the text that each word stands in.
        """
        start = np.flatnonzero(self.step[1][words])
        at, state, found = start, np.ones(len(start), dtype=np.int32), []
        while len(start):
            state = self.step[state, words[at]]
            at = at + 1
            live = state > 0
            start, at, state = start[live], at[live], state[live]
            hit = np.flatnonzero(self.ending[state])
            if len(hit):
                row, template = np.nonzero(self.accepts[state[hit]])
                found.append((start[hit[row]], at[hit[row]], template))
            inside = at < ends[start]
            start, at, state = start[inside], at[inside], state[inside]
        if not found:
            nothing = np.zeros(0, dtype=np.int64)
            return nothing, nothing, nothing
        begin, end, template = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((end, template, begin))
        begin, end, template = begin[order], end[order], template[order]
        last = np.append((begin[1:] != begin[:-1]) | (template[1:] != template[:-1]), True)
        return begin[last], end[last], template[last]


_MATCH = T.StructType([T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType()),
                       T.StructField("first", T.LongType()), T.StructField("end", T.LongType()),
                       T.StructField("mandatory", T.LongType())])


def _scan(automaton: Automaton) -> K.Kernel:
    labels = pa.array([t.label for t in automaton.templates], pa.string())
    base = np.array([t.base for t in automaton.templates], dtype=bool)
    mandatory = np.array([t.mandatory for t in automaton.templates], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table, fold = K.Hasher(), K.letter_words(True), K.lower_table()
        known, _, _, _ = hasher.words(*_flat(automaton.vocabulary), table)
        lengths = np.array([len(w.encode()) for w in automaton.vocabulary])
        order = np.argsort(known)
        known = known[order]
        for batch in batches:
            for first, last, data, offsets in K.text_slices(batch.column(1)):
                hashes, starts, stops, firsts = hasher.words(data, offsets, table, fold)
                place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                same = (known[place] == hashes) & (lengths[order[place]] == stops - starts)
                words = np.where(same, order[place] + 1, 0)
                begin, end, template = automaton.matches(words, np.repeat(firsts[1:], np.diff(firsts)))
                owner = np.searchsorted(firsts, begin, side="right") - 1
                found = pa.StructArray.from_arrays(
                    [labels.take(pa.array(template)), pa.array(base[template]), pa.array(begin - firsts[owner]),
                     pa.array(end - firsts[owner]), pa.array(mandatory[template])],
                    ["label", "base", "first", "end", "mandatory"])
                counts = np.bincount(owner, minlength=last - first)
                at = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(np.diff(firsts).astype(np.int64)),
                     pa.ListArray.from_arrays(at, found)], ["row", "n_words", "matches"])

    return run


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    texts = [w.encode() for w in words]
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))


def license_matches(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, text: str = "text",
                    keep: Sequence[str] | None = None) -> DataFrame:
    """``row`` (the ``keep`` columns of ``docs``, all by default), ``n_words`` and ``matches``, one row a document.

    Words are runs of ASCII letters and digits and of everything beyond ASCII,
    A-Z lower-cased. A match is a place where a template's mandatory words stand
    exactly, in order, with nothing between them but its optional and replaceable
    regions; per start and template the longest counts. ``matches`` (label, base,
    first word, end exclusive, mandatory words) are in the order of first word and
    template. Null and empty texts have no words. Rows are judged one by one, so
    repeated rows and ids give equal results and no rows give none. A text of any
    length is scanned whole in one task; memory follows the longest text. Names of
    ``docs`` cannot clash, as its columns stay inside ``row``.
    """
    own = docs.columns if keep is None else list(keep)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("n_words", T.LongType()),
                           T.StructField("matches", T.ArrayType(_MATCH))])
    return rows.mapInArrow(_scan(Automaton(templates)), schema)
