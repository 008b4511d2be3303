"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language gives longest-match lengths: a text is cut from left to right into
phrases, each the longest that occurs in that language's text. The language that needs the fewest phrases a symbol wins.

Texts are parsed for all languages at once: they are laid out in lanes of ``LANE`` symbols, and one step moves every lane of
every language by one symbol. Lanes at first start afresh; then each lane that follows another is parsed again from the state
in which that one ended, until it falls in with its first parse, so phrases are those of the whole text from end to end. Texts above
``CHUNK`` symbols are parsed piece by piece, each from the state before.

An automaton's transitions lie in one array, each state's shifted to where they fit (a row displacement), so an alphabet may be
of any size: all letters of the sample are told apart, and any other letter is a phrase by itself.

Learning uses a bounded sample of labelled passages: ``PASSAGES`` a language of ``SPAN`` characters, those of smallest hash among
all passages of all labelled texts, wherever they stand. Scoring uses every symbol of every text.

Defined cases: null text, or no letter: ``und`` with score 0; so is everything if no row teaches a language. Non-letters count
as one separator a run. Ties go to the first language by code point. Rows are judged one by one, so repeated rows, null and
repeated ids do not matter; empty tables give no rows. Extra columns are kept (own columns replace any of the same name).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, shielded, tidy

PASSAGES, SPAN = 96, 400
LANE, CHUNK = 512, 1 << 20
ADDED = ("lang_pred", "score")


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The transitions of each state of the automaton of all factors of a sequence; state 0 is the root."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return nexts


def displaced(states: list[dict[int, int]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The automaton as one array: (owner of each cell, where it leads, where each state begins).

    A state is named by where it begins; its transition by symbol c is in the cell c places on, if that cell is its own. The
    root is 0 and owns nothing: from it every symbol begins a phrase.
    """
    transitions = sum(map(len, states))
    room = 4 * transitions + len(states) + 2 * size + 1024
    taken, begins = np.zeros(room + size, bool), np.zeros(room, bool)
    begin = np.zeros(len(states), np.int64)
    begins[0] = True
    low, width = 1, 256
    by_size = sorted(range(1, len(states)), key=lambda k: -len(states[k]))
    some = [k for k in by_size if len(states[k]) > 1]
    for k in some:
        own = np.fromiter(states[k], np.int64, len(states[k]))
        at = low
        while True:
            places = np.arange(at, min(at + width, room))
            if not len(places):
                taken, begins, room = np.append(taken, np.zeros(room, bool)), np.append(begins, np.zeros(room, bool)), 2 * room
                continue
            fits = ~(taken[places[:, None] + own].any(1) | begins[places])
            if fits.any():
                break
            #: What is full stays behind.
            low = at = at + width
        begin[k] = places[int(fits.argmax())]
        begins[begin[k]] = True
        taken[begin[k] + own] = True
    free, used = iter(np.flatnonzero(~taken).tolist()), set(np.flatnonzero(begins).tolist())
    for k in by_size[len(some) :]:
        for c in states[k] or (0,):
            at = next(f for f in free if f - c > 0 and f - c not in used)
            begin[k] = at - c
            used.add(at - c)
    owner = np.full(int(begin.max()) + size, -1, np.int64)
    to = np.zeros_like(owner)
    for k, row in enumerate(states[1:], 1):
        for c, target in row.items():
            owner[begin[k] + c], to[begin[k] + c] = begin[k], begin[target]
    return owner, to, begin


class Parser:
    """Automata of several languages over one alphabet. Symbols: 0 separator, 1 any letter of no sample, then the letters."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        letters = sorted({ch.lower()[:1] for texts in samples.values() for t in texts for ch in t if ch.isalpha()})
        number = {ch: k + 2 for k, ch in enumerate(letters)}
        self.size = len(letters) + 2
        self.symbol = np.zeros(sys.maxunicode + 1, np.uint16 if self.size <= 1 << 16 else np.uint32)
        for cp in range(sys.maxunicode + 1):
            if (ch := chr(cp)).isalpha():
                self.symbol[cp] = number.get(ch.lower()[:1], 1)
        #: All automata one after another: a cell holds its owner in the high half and where it leads in the low half.
        cells, start, at = [np.zeros(0, np.int64)], [], 0
        self.first = np.zeros((len(self.languages), self.size), np.int64)
        for n, lang in enumerate(self.languages):
            stream = [s for t in samples[lang] for s in [0, *self.symbols(t).tolist()]]
            states = suffix_automaton(stream)
            owner, to, begin = displaced(states, self.size)
            cells.append(np.where(owner < 0, -1, ((owner + at) << 32) | (to + at)))
            self.first[n] = at
            for c, target in states[0].items():
                self.first[n, c] = begin[target] + at
            start.append(at)
            at += len(owner)
        self.cells, self.root = np.concatenate(cells), np.array(start, np.int64)

    def symbols(self, text: str) -> np.ndarray:
        parts, before = [np.zeros(0, self.symbol.dtype)], 0
        for k in range(0, len(text), CHUNK):
            s = self.symbol[np.frombuffer(text[k : k + CHUNK].encode("utf-32-le"), np.uint32)]
            keep = s != 0
            last = int(s[-1])
            keep[1:] |= s[:-1] != 0
            keep[0] |= before != 0
            parts.append(s[keep])
            before = last
        return np.concatenate(parts)

    def step(self, state: np.ndarray, symbol: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase begins. first: the state that each symbol leads to from its root."""
        cell = self.cells.take(state + symbol)
        begins = (cell >> 32) != state
        return np.where(begins, first, cell & 0xFFFFFFFF), begins

    def phrases(self, streams: list[np.ndarray], entry: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """How many phrases begin in each stream (row) in each language (column), and the states in which streams end (by language).

        entry: the states in which streams begin, by language; else nothing has matched.
        """
        entry = np.repeat(self.root[:, None], len(streams), 1) if entry is None else entry
        n = np.fromiter(map(len, streams), np.int64, len(streams))
        lanes = -(-n // LANE)
        total, kinds = int(lanes.sum()), len(self.languages)
        out, exits = np.zeros((len(streams), kinds), np.int64), entry.copy()
        if not total:
            return out, exits
        ends = np.cumsum(lanes)
        cells = np.zeros(total * LANE, np.int64)
        for s, e, k in zip(streams, ends.tolist(), lanes.tolist(), strict=True):
            cells[(e - k) * LANE : (e - k) * LANE + len(s)] = s
        some = lanes > 0
        width = np.full(total, LANE)
        width[ends[some] - 1] = n[some] - (lanes[some] - 1) * LANE
        leads = np.zeros(total, bool)
        leads[(ends - lanes)[some]] = True
        owner = np.repeat(np.arange(len(streams)), lanes)
        order = np.argsort(-width, kind="stable")
        steps = np.ascontiguousarray(cells.reshape(total, LANE)[order].T)
        active = np.searchsorted(-width[order], -np.arange(LANE), side="left")
        began = np.where(leads, entry[:, owner], self.root[:, None])
        state = began[:, order]
        count = np.zeros((kinds, total), np.int64)
        path = np.zeros((LANE, kinds, total), np.int32)
        new = np.zeros((LANE, kinds, total), bool)
        for t in range(int(width.max())):
            a = int(active[t])
            to, begins = self.step(state[:, :a], steps[t, :a], self.first.take(steps[t, :a], axis=1))
            count[:, :a] += begins
            state[:, :a] = to
            path[t, :, :a], new[t, :, :a] = to, begins
        place = np.empty(total, np.int64)
        place[order] = np.arange(total)
        while True:
            #: Lanes that follow another and did not begin in the state in which that one ended.
            last = state[:, place]
            due = began.copy()
            due[:, 1:] = np.where(leads[1:], began[:, 1:], last[:, :-1])
            kind, lane = np.nonzero(due != began)
            if not len(lane):
                break
            began = due
            at, now = place[lane], due[kind, lane]
            limit = width[lane]
            for t in range(LANE):
                symbol = steps[t, at]
                now, begins = self.step(now, symbol, self.first[kind, symbol])
                count[kind, at] += begins.astype(np.int64) - new[t, kind, at]
                open_ = now != path[t, kind, at]
                path[t, kind, at], new[t, kind, at] = now, begins
                done = open_ & (t + 1 == limit)
                state[kind[done], at[done]] = now[done]
                open_ &= ~done
                if not open_.all():
                    kind, at, now, limit = kind[open_], at[open_], now[open_], limit[open_]
                    if not len(at):
                        break
        count = count[:, place]
        for k in range(kinds):
            out[:, k] = np.bincount(owner, weights=count[k], minlength=len(streams))
        exits[:, some] = state[:, place][:, ends[some] - 1]
        return out, exits

    def counts(self, streams: list[np.ndarray]) -> np.ndarray:
        """Phrases of each stream in each language, in memory that no stream's length raises."""
        out = np.zeros((len(streams), len(self.languages)), np.int64)
        held: list[int] = []
        size = 0
        for k, s in enumerate(streams):
            if len(s) > CHUNK:
                state = None
                for at in range(0, len(s), CHUNK):
                    part, state = self.phrases([s[at : at + CHUNK]], state)
                    out[k] += part[0]
                continue
            if held and size + len(s) > CHUNK:
                out[held] = self.phrases([streams[h] for h in held])[0]
                held, size = [], 0
            held.append(k)
            size += len(s)
        if held:
            out[held] = self.phrases([streams[h] for h in held])[0]
        return out

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        streams = [self.symbols(t) if t else np.zeros(0, self.symbol.dtype) for t in texts]
        langs, scores = [], []
        for s, p in zip(streams, self.counts(streams), strict=True):
            if not s.any():
                langs.append("und")
                scores.append(0.0)
                continue
            best = int(np.argmin(p))
            odds = (p[best] / p.astype(float)) ** 8
            langs.append(self.languages[best])
            scores.append(float(1 / odds.sum()))
        return langs, scores


def learn(rows: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", passages: int = PASSAGES, span: int = SPAN) -> Parser:
    """A parser from rows that all may teach. Gathers about twice the passages a language at most."""
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("h"), F.ceil(F.length(text) / span).cast("int").alias("n"))
    #: Languages and their passages are stored, so that Spark knows how to join them.
    totals = materialise(rows.groupBy(F.col("lang").alias("of")).agg((2.0 * passages / F.sum("n")).alias("limit")), "languages")
    chance = lambda i: F.pmod(F.xxhash64("h", i), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: chance(i) < F.col("limit"))
    got = rows.join(totals, F.col("lang") == F.col("of")).select("lang", "h", "text", F.explode(chosen).alias("i")).select("lang", chance(F.col("i")).alias("c"), F.substring(F.col("text"), F.col("i") * span + 1, F.lit(span)).alias("t")).collect()
    samples: dict[str, list[str]] = {}
    for k in sorted({r["lang"] for r in got}):
        #: Passages with letters only; a language whose few rows have none cannot be told.
        own = [r["t"] for r in sorted(got, key=lambda r: (r["c"], r["t"])) if r["lang"] == k and any(c.isalpha() for c in r["t"])][:passages]
        if own:
            samples[k] = own
    return Parser(samples)


def identify(docs: DataFrame, parser: Parser, text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    return shielded(docs, {"text": text}, ADDED, lambda rows: _identified(rows, parser))


def _identified(docs: DataFrame, parser: Parser, text: str = "text") -> DataFrame:
    kept = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(parser)
    into = T.StructType([*(docs.schema[c] for c in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            langs, scores, held, size = [], [], [], 0
            for x in [*column, None]:
                end = x is None
                t = None if end else x.as_py()
                if held and (end or size + len(t or "") > CHUNK):
                    a, b = p.judge(held)
                    langs += a
                    scores += b
                    held, size = [], 0
                if not end:
                    held.append(t)
                    size += len(t or "")
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=into.names)

    return docs.select(*kept).mapInArrow(run, into)
