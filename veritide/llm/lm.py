"""Language-model scores of whole texts: causal self-attention over subword ids.

Words (lower-cased, split at ASCII space) are spelled in ids of a public byte-level BPE, which makes a text a stream of ids and an end.
An attention model, trained in numpy, reads the ids of a window (each has an embedding of its own) and gives the next id in two steps: its
class, and the id within the class. Before it is trained it says what counts of pairs of ids say; attention adds to the log
odds of classes what the ids further back tell. Within a class, ids are drawn by their counts after the id before.

A word is drawn in one of two ways, mixed at weights fitted for each class of first ids: id by id, every one scored by attention; or, once
attention has given the class of its first id, as a whole by its share among the training words of that class. A text's score is
the sum over its words and its end: a true probability.

Texts are laid out in windows of ``OVERLAP + STEP`` ids. Windows overlap, so each id is scored once, and with up to
OVERLAP ids more of context than the start of its window would give; attention within a window is batched and masked.

The corpus gives: counts of all words (a shuffle with map-side sums), from these the counts of all pairs of ids, and all training texts
to train on. Each task goes on from the same start, once over every window of its texts; then the moves of all tasks are averaged, those of
an id's embedding by how often each task met the id. A window is scored just before it is first trained on, which says of every
training word how probable the two ways to draw it make it; counts of this by class, whatever the input, are all that fits the weights.
The start and the classes of ids come from passages, drawn by hash over all places of all training texts: ``PASSAGES`` of them
for a million training tokens, and as the cube root of these more. Frequent words, at most
``FREQUENT`` by a threshold on their count, are sent to the tasks with their spelling and counts. Other words are spelled where they
stand, and finish their mixture and base score in a join with the whole vocabulary, so no count is missed: a word counts the same
whether it was sent or joined.

Bounds that decide what is told apart: pairs of ids have counts of their own among the ``SPELLED`` most frequent ids; the rest share
one place in pairs and keep their own single counts. Ids that the passages show less than twice share two classes; their embeddings start
from these.

Defined cases: a null text is the empty text, which is its end alone; without training texts all counts are 0; a null id counts as
the empty text in the fold; rows are scored one by one, so repeated rows and ids do not matter; a very long text is a longer
stream; an empty table gives no rows. Of extra columns only the id is kept.
"""

from __future__ import annotations

import copy
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, tidy
from .tokens import Tokenizer

#: Fixed: the bytes of A-Z to a-z.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
CLASSES, WIDTH, INNER, STEP, OVERLAP = 62, 16, 16, 24, 8
#: Ids whose pairs are counted apart; the rest share one place.
SPELLED = 2048
#: The log probability of what cannot be.
NEVER = -700.0
FREQUENT, LONGEST, PASSAGES, SPAN, STEPS, BATCH = 400_000, 48, 8000, 240, 6000, 96
HELD_WORDS, CHUNK, ROWS = 300_000, 120_000, 64
#: Windows that a task holds and trains on in any order; how far it steps at first, and after how many steps that has shrunk by the root of two.
RUN, RATE, SETTLED = 3072, 0.005, 500
#: Fixed: bins of the log odds of the two ways to draw a word, BIN wide, 0 in the middle; the first also holds what cannot be.
BINS, BIN = 1201, 0.05
#: Fixed: the key of the first bin, above all ids.
ODDS = 1 << 20


class Attention:
    """One block of causal self-attention over ids: log odds of the next class at the last STEP places of a window.

    The first OVERLAP places are context alone: they give keys and values, and no query is asked there.
    """

    def __init__(self, label: np.ndarray, classes: int, seed: int = 1):
        """label: the class of each id, which an id's embedding starts from."""
        r = np.random.default_rng(seed)
        n = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        size = STEP + OVERLAP
        self.p = {"E": (n(classes, WIDTH) * 3)[label], "P": n(size, WIDTH) * 0.4, "Q": n(WIDTH, WIDTH), "K": n(WIDTH, WIDTH), "V": n(WIDTH, WIDTH), "A": n(WIDTH, INNER), "a": np.zeros(INNER, np.float32), "B": n(INNER, WIDTH) * 0.5, "O": n(WIDTH, classes) * 0.1, "o": np.zeros(classes, np.float32)}
        self.label, self.classes = label, classes
        #: How far the embedding of each id has moved in training.
        self.seen = np.zeros(len(label), np.float32)
        self.mask = np.tril(np.ones((size, size), np.float32))[OVERLAP:]
        self.ones = np.ones((size, 1), np.float32)

    def forward(self, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """What comes before the last layer at the scored places, and all that led to it."""
        p, (n, size) = self.p, ids.shape
        x = p["E"][ids] + p["P"]
        kv = (x.reshape(-1, WIDTH) @ np.concatenate([p["K"], p["V"]], axis=1)).reshape(n, size, 2 * WIDTH)
        k, v = kv[:, :, :WIDTH], kv[:, :, WIDTH:]
        own = np.ascontiguousarray(x[:, OVERLAP:])
        q = (own.reshape(-1, WIDTH) @ (p["Q"] / np.float32(np.sqrt(WIDTH)))).reshape(n, STEP, WIDTH)
        #: Weights are left unscaled until they have met the values, which are narrower; scores are held below overflow.
        w = q @ k.transpose(0, 2, 1)
        np.minimum(w, 60, out=w)
        np.exp(w, out=w)
        w *= self.mask
        total = (w.reshape(-1, size) @ self.ones).reshape(n, STEP, 1)
        h = w @ v
        h /= total
        h += own
        inner = h.reshape(-1, WIDTH) @ p["A"]
        inner += p["a"]
        np.maximum(inner, 0, out=inner)
        y = inner @ p["B"]
        y += h.reshape(-1, WIDTH)
        return y, x, q, k, v, w, total, h, inner

    def log_probs(self, ids: np.ndarray, prior: np.ndarray, target: np.ndarray, scored: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log of the probability of each scored target class, in order, and of a word's start (or the end) there.

        prior: the log probability of each class at each scored place, before attention; starts: which classes start a word.
        """
        y = self.forward(ids)[0]
        kept = scored.ravel()
        if not kept.all():
            y, target = y[kept], target.ravel()[kept]
        z = y @ self.p["O"]
        z += self.p["o"]
        z += prior
        np.clip(z, -80, 40, out=z)
        t = z[np.arange(len(z)), target.ravel()]
        np.exp(z, out=z)
        sums = np.log(z @ np.stack([np.ones_like(starts), starts], axis=1))
        return t - sums[:, 0], sums[:, 1] - sums[:, 0]

    def train(self, ids: np.ndarray, prior: np.ndarray, before: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: int = STEPS, batch: int = BATCH, seed: int = 2) -> None:
        """prior: a row of log probabilities of classes for each place of an id before; before: these places at the targets."""
        r, moves = np.random.default_rng(seed), Moves(self)
        for t in range(1, steps + 1):
            own = r.integers(0, len(ids), batch)
            moves.step(self.gradients(ids[own], prior[before[own]], target[own], weight[own]), 0.02 * min(1, t / 20) * (1 - t / (steps + 1)))
        self.seen = moves.seen

    def gradients(self, ids: np.ndarray, prior: np.ndarray, target: np.ndarray, weight: np.ndarray, starts: np.ndarray | None = None) -> dict:
        """starts: asks for what log_probs() says as well (told), at all places, scored or not."""
        p, (n, size) = self.p, ids.shape
        y, x, q, k, v, w, total, h, inner = self.forward(ids)
        w /= total
        d = y @ p["O"]
        d += p["o"]
        d += prior.reshape(len(y), -1)
        d -= d.max(1, keepdims=True)
        at, to = np.arange(len(d)), target.ravel()
        t = d[at, to]
        np.exp(d, out=d)
        sums = d.sum(1)
        told = None if starts is None else (t - np.log(sums), np.log(np.maximum(d @ starts, 1e-30)) - np.log(sums))
        share = (weight.ravel() / max(weight.sum(), 1)).astype(d.dtype)
        d *= (share / sums)[:, None]
        d[at, to] -= share
        g = {"O": y.T @ d, "o": d.sum(0), "told": told}
        dy = d @ p["O"].T
        di = (dy @ p["B"].T) * (inner > 0)
        g |= {"B": inner.T @ dy, "A": h.reshape(-1, WIDTH).T @ di, "a": di.sum(0)}
        dh = (dy + di @ p["A"].T).reshape(n, STEP, WIDTH)
        dw = dh @ v.transpose(0, 2, 1)
        dv = w.transpose(0, 2, 1) @ dh
        ds = w * (dw - (dw * w).sum(-1, keepdims=True))
        dq, dk = ds @ k / np.float32(np.sqrt(WIDTH)), ds.transpose(0, 2, 1) @ q
        flat, own = x.reshape(-1, WIDTH), x[:, OVERLAP:].reshape(-1, WIDTH)
        g |= {"Q": own.T @ dq.reshape(-1, WIDTH), "K": flat.T @ dk.reshape(-1, WIDTH), "V": flat.T @ dv.reshape(-1, WIDTH)}
        dx = (dk.reshape(-1, WIDTH) @ p["K"].T + dv.reshape(-1, WIDTH) @ p["V"].T).reshape(n, size, WIDTH)
        dx[:, OVERLAP:] += dh + (dq.reshape(-1, WIDTH) @ p["Q"].T).reshape(n, STEP, WIDTH)
        g["P"] = dx.sum(0)
        flat_ids = ids.ravel().astype(np.uint16)
        order = np.argsort(flat_ids, kind="stable")
        rows = flat_ids[order]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        g["E"] = rows[first], np.add.reduceat(dx.reshape(-1, WIDTH)[order], first)
        return g


class Moves:
    """Steps of a network along its gradients, with rates that follow these."""

    def __init__(self, net: Attention):
        self.net, self.t, self.seen = net, 0, net.seen.copy()
        self.m, self.s = ({k: np.zeros_like(v) for k, v in net.p.items() if k != "E"} for _ in range(2))

    def step(self, g: dict, rate: float) -> None:
        p, m, s = self.net.p, self.m, self.s
        self.t += 1
        for k in m:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.99 * s[k] + 0.01 * g[k] * g[k]
            p[k] -= (rate * (m[k] / (1 - 0.9**self.t)) / (np.sqrt(s[k] / (1 - 0.99**self.t)) + 1e-8)).astype(np.float32)
        #: Embeddings move as often as their ids are met; each has a rate of its own.
        rows, move = g["E"]
        self.seen[rows] += (move**2).mean(1)
        p["E"][rows] -= 5 * rate * move / (np.sqrt(self.seen[rows]) + 1e-7)[:, None]


def windows(stream: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping windows over one stream, what the others hold at their last STEP places, and which of these are scored: every place once."""
    size, n = STEP + OVERLAP, len(stream)
    at = np.arange(-(-n // STEP))[:, None] * STEP - OVERLAP + np.arange(size)
    inside = np.clip(at, 0, n - 1)
    return stream[inside], *(o[inside[:, OVERLAP:]] for o in others), at[:, OVERLAP:] < n


def cluster(streams: list[np.ndarray], opens: np.ndarray, classes: int = CLASSES, seed: int = 6) -> np.ndarray:
    """A class for each id: k-means of ids met more than once, by their neighbours, apart for ids that open a word and others.

    The last two classes hold the ids that are left (inside a word, opening one).
    """
    ids = np.concatenate([np.zeros(0, np.int64), *streams])
    count = np.bincount(ids, minlength=len(opens))
    label = np.where(opens, classes - 1, classes - 2)
    order = np.argsort(-count, kind="stable")
    order = order[count[order] > 1]
    if not len(order):
        return label
    place = np.full(len(opens), -1)
    place[order] = np.arange(len(order))
    wide = min(256, len(order))
    #: Next neighbours on either side, and those some places away, which tell languages apart.
    x = np.zeros((3, len(order) * wide), np.float32)
    wide = np.int64(wide)
    for lag, right, left in ((1, 0, 1), (3, 2, 2), (5, 2, 2), (8, 2, 2)):
        some = [s for s in streams if len(s) > lag]
        if not some:
            continue
        a, b = (place[np.concatenate([s[k : len(s) - lag + k] for s in some])].astype(np.int32) for k in (0, lag))
        k = (a >= 0) & (b >= 0) & (b < wide)
        x[right] += np.bincount(a[k] * wide + b[k], minlength=x.shape[1])
        k = (a >= 0) & (b >= 0) & (a < wide)
        x[left] += np.bincount(b[k] * wide + a[k], minlength=x.shape[1])
    x = x.reshape(3, len(order), wide)
    x /= np.maximum(x.sum(2, keepdims=True), 1)
    np.sqrt(x, out=x)
    x = np.concatenate(list(x), axis=1)
    r = np.random.default_rng(seed)
    first = 0
    for kind, share in ((True, 0.55), (False, 0.45)):
        some = np.flatnonzero(opens[order] == kind)
        room = int((classes - 2) * share) if kind else classes - 2 - first
        if not len(some) or not room:
            continue
        own, points, weight = np.zeros(len(some), np.int64), x[some], np.sqrt(count[order[some]])
        centres = points[r.choice(len(points), min(room, len(points)), replace=False, p=weight / weight.sum())]
        for _ in range(12):
            own = np.argmin((centres**2).sum(1) - 2 * (points @ centres.T), axis=1)
            for c in range(len(centres)):
                if (k := own == c).any():
                    centres[c] = np.average(points[k], axis=0, weights=weight[k])
        label[order[some]] = first + own
        first += room
    return label


class Pairs:
    """What an id says of the next one: counts of pairs over the distinct training words, smoothed by single ids.

    Witten-Bell: after an id with n followers of d kinds, a follower has (its count + d * its share in all) / (n + d). A word ends
    with some of this; then another begins, or the text ends.
    """

    def __init__(self, index: np.ndarray, pairs: np.ndarray, id_counts: np.ndarray, opens: np.ndarray, end_share: float):
        #: index: each id's place, SPELLED for the rest; place SPELLED + 1: before and after a word.
        self.index, self.edge = index, SPELLED + 1
        n, kinds = pairs.sum(1, keepdims=True), np.maximum((pairs > 0).sum(1, keepdims=True), 1)
        single = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * pairs.shape[1])
        follows = (pairs + kinds * single) / (n + kinds)
        #: Ids of one place share it by their counts, those that open a word apart from the others.
        ids, weight = len(index) - 1, id_counts[:-1] + 0.5
        self.opens = opens[:ids]
        within = np.zeros(ids)
        places = np.zeros((2, SPELLED + 2), bool)
        for kind in (True, False):
            some = self.opens == kind
            mass = np.bincount(index[:ids][some], weights=weight[some], minlength=SPELLED + 2)
            within[some] = weight[some] / mass[index[:ids][some]]
            places[int(kind)] = mass > 0
        #: After an id: the ids that may go on, or the word's end. Before a word: the ids that open one.
        on = follows * places[0]
        stop = follows[:, self.edge].copy()
        on[:, self.edge] = 0
        total = on.sum(1) + stop
        self.on, self.stop = on / total[:, None], stop / total
        begin = follows[self.edge] * places[1]
        begin[self.edge] = 0
        self.begin = begin / max(begin.sum(), 1e-300)
        self.within, self.end_share = within, min(max(end_share, 1e-6), 0.5)

    def classes(self, label: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of the classes after each place (the last class: the end), and of each opening id in its class."""
        ids = len(label) - 1
        first = self.begin[self.index[:ids]] * self.within * self.opens
        by_class = np.bincount(label[:ids], weights=first, minlength=classes)
        spread = np.zeros((SPELLED + 2, classes))
        some = np.flatnonzero(~self.opens)
        np.add.at(spread, (self.index[some], label[some]), self.within[some])
        after = self.on @ spread
        after += np.outer(self.stop * (1 - self.end_share), by_class)
        after[:, -1] = self.stop * self.end_share
        after[self.edge] = by_class * (1 - self.end_share)
        after[self.edge, -1] = self.end_share
        opening = np.log(np.maximum(first, 1e-300)) - np.log(np.maximum(by_class[label[:ids]], 1e-300))
        return np.log(np.maximum(after, 1e-30)).astype(np.float32), np.append(opening, 0.0)


class Scorer:
    """All that a task needs: frequent words with spelling and counts, classes of ids, pairs, the network."""

    def __init__(self, tokenizer: Tokenizer, words: list[bytes], counts: np.ndarray, ends: int, total: int, distinct: int, pairs: Pairs, firsts: np.ndarray, sample: list[tuple[bytes, bool, bool]]):
        """firsts: how often training words begin with each id. sample: passages that training starts from, and whether a text begins and ends with them."""
        self.tokenizer, self.ends = tokenizer, ends
        self.words = {w: k for k, w in enumerate(words)}
        self.opens_word = opens_word(tokenizer)
        self.base_of_none = -np.log10(total + distinct + 1)
        self.base = np.append(np.log10(counts + 1.0) + self.base_of_none, self.base_of_none)
        self.base_of_end = float(np.log10(ends + 1.0) + self.base_of_none)
        parts = [self.spell_all(words[k : k + 10_000]) for k in range(0, len(words), 10_000)]
        self.length = np.concatenate([*(n for _, n in parts), [0]]).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.spelling = np.concatenate([np.zeros(0, np.int64), *(i for i, _ in parts)]).astype(np.uint16)
        #: The last class is the end's.
        spelled = [self.ids(t)[0].astype(np.uint16) for t, *_ in sample]
        self.classes = np.append(cluster(spelled, self.opens_word[:-1]), CLASSES).astype(np.int32)
        self.place = pairs.index.astype(np.int64)
        self.place[-1] = pairs.edge
        self.prior, self.opening = pairs.classes(self.classes, CLASSES + 1)
        self.log_on = np.log(np.maximum(pairs.on, 1e-300)).astype(np.float32)
        self.log_within = np.append(np.log(pairs.within), 0.0)
        self.starts = np.zeros(CLASSES + 1, np.float32)
        self.starts[np.unique(self.classes[:-1][self.opens_word[:-1]])] = 1
        self.starts[CLASSES] = 1
        in_class = np.bincount(self.classes, weights=firsts, minlength=CLASSES + 1)
        self.log_in_class = np.log(np.maximum(in_class, 1e-300))
        of_word = self.classes[self.spelling[self.first[:-1]].astype(np.int64)] if words else np.zeros(0, np.int64)
        share = lambda c: np.append(np.log(np.maximum(c, 1e-300)) - self.log_in_class[of_word], NEVER)
        self.own = share(counts)
        #: For fitting: with one occurrence taken out, a word seen once is none of the training words.
        self.own_without = share(counts - 1.0)
        self.net = Attention(self.classes, CLASSES + 1)
        self.weights = np.log(np.tile([[0.3], [0.7]], (1, CLASSES + 1)))
        if sample:
            made = []
            for ids, (_, begins, ends_) in zip(spelled, sample, strict=True):
                line = np.concatenate([[tokenizer.end] * begins, ids, [tokenizer.end] * ends_]).astype(np.int32)
                if len(line) > 1:
                    made.append(windows(line[:-1], self.place[line[:-1]].astype(np.int16), self.classes[line[1:]].astype(np.int16)))
            if made:
                ids, before, target, weight = (np.concatenate(c) for c in zip(*made, strict=True))
                made = None
                self.net.train(ids, self.prior, before, target, weight, max(STEPS, len(ids) // BATCH))
                ids = before = target = weight = None
        self.net.p = {k: v.astype(np.float32) for k, v in self.net.p.items()}

    def spell(self, word: bytes) -> np.ndarray:
        return self.tokenizer.encoding.encode_to_numpy(" " + word.decode("utf-8", "replace")).astype(np.int64)

    def spell_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has. A space parts words and stands in none, so one call spells them all."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids = self.tokenizer.encoding.encode_to_numpy(" " + b" ".join(words).decode("utf-8", "replace")).astype(np.int64)
        start = np.flatnonzero(self.opens_word[ids])
        if len(start) == len(words) and start[0] == 0:
            return ids, np.diff(start, append=len(ids))
        each = [self.spell(w) for w in words]
        return np.concatenate(each), np.array([len(e) for e in each])

    def ids(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Ids of a text, ids in each word, the number of each word (last: not frequent), and the words that are not frequent."""
        w = text.translate(LOWER).split()
        none = len(self.words)
        number = np.fromiter(map(self.words.get, w, repeat(none)), np.int64, len(w))
        rare = np.flatnonzero(number == none)
        length = self.length[number]
        rare_words = [w[k] for k in rare.tolist()]
        spelled, length[rare] = self.spell_all(rare_words)
        start = np.cumsum(length) - length
        out = np.zeros(int(length.sum()), np.int64)
        known = np.ones(len(out), bool)
        if len(rare):
            places = np.repeat(start[rare], length[rare]) + (np.arange(int(length[rare].sum())) - np.repeat(np.cumsum(length[rare]) - length[rare], length[rare]))
            out[places] = spelled
            known[places] = False
        source = np.repeat(self.first[number] - start, length) + np.arange(len(out))
        out[known] = self.spelling[source[known]]
        return out, length, number, rare_words

    def laid_out(self, texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Ids of the windows of all texts in order, and at their scored places the place of the id before, the class that stands there and whether it is scored."""
        end = [self.tokenizer.end]
        made = []
        for s in texts:
            line = np.concatenate([end, s, end])
            made.append(windows(line[:-1], self.place[line[:-1]], self.classes[line[1:]]))
        return tuple(np.concatenate(c) for c in zip(*made, strict=True))

    def network(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probabilities, at all ids and ends of the texts in order, of the class that stands there and of any start of a word."""
        ids, before, target, kept = self.laid_out(texts)
        out = []
        for i in range(0, len(ids), ROWS):
            k = kept[i : i + ROWS]
            out.append(self.net.log_probs(ids[i : i + ROWS], self.prior[before[i : i + ROWS][k]], target[i : i + ROWS], k, self.starts))
        return np.concatenate([o[0] for o in out]).astype(float), np.concatenate([o[1] for o in out]).astype(float)

    def within(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Natural log probabilities of the ids of words in a row, each given its class and the id before. starts: where words start."""
        place = self.place[ids]
        before = np.empty(len(ids), np.int64)
        before[1:], before[:1] = place[:-1], 0
        out = self.log_on[before, place] + self.log_within[ids] - self.prior[before, self.classes[ids]]
        out[starts] = self.opening[ids[starts]]
        return out

    def parts(self, texts: list[bytes]) -> list[tuple]:
        """For each text: words' log probabilities id by id and as a whole, the end's, the words, the rare ones, these as a whole if seen once, and the classes of first ids."""
        spelled = [self.ids(t) for t in texts]
        return self.ways(spelled, *self.network([s[0] for s in spelled]), self.own)

    def ways(self, spelled: list[tuple], logs: np.ndarray, boundary: np.ndarray, own: np.ndarray) -> list[tuple]:
        """parts() of spelled texts, given what the network says of them. own: the log share of each frequent word in its class."""
        out, at = [], 0
        for ids, length, number, rare in spelled:
            net, opens = logs[at : at + len(ids)], boundary[at : at + len(ids) + 1]
            end = logs[at + len(ids)] - opens[-1]
            at += len(ids) + 1
            if not len(number):
                out.append((np.zeros((2, 0)), end, number, rare, np.zeros(0), np.zeros(0, np.int64)))
                continue
            start = np.cumsum(length) - length
            kind = self.classes[ids[start]]
            #: Of a word's first class, given that a word starts; id by id, a word also has to end.
            begin = net[start] - opens[start]
            whole, once = begin + own[number], np.zeros(0)
            if rare:
                k = np.flatnonzero(number == len(self.words))
                once = begin[k] - self.log_in_class[kind[k]]
            each = np.add.reduceat(net + self.within(ids, start), start) - opens[start] + opens[start + length]
            out.append((np.stack([each, whole]), end, number, rare, once, kind))
        return out

    def mixed(self, logs: np.ndarray, kind: np.ndarray) -> np.ndarray:
        logs = logs + self.weights[:, kind]
        return np.logaddexp(logs[0], logs[1])

    def fit_weights(self, odds: np.ndarray) -> None:
        """Expectation maximisation for each class of first ids. odds: by class and bin, how many training words are so much likelier as a whole than id by id."""
        ratio = np.exp(BIN * (np.arange(BINS) - BINS // 2))
        for _ in range(30 if odds.sum() else 0):
            w = np.exp(self.weights)[:, :, None]
            whole = w[1] * ratio / (w[0] + w[1] * ratio)
            by = np.stack([((1 - whole) * odds).sum(1), (whole * odds).sum(1)])
            #: A class with few words leans on all of them.
            by += 20 * by.sum(1, keepdims=True) / odds.sum()
            self.weights = np.log(by / by.sum(0))

    def score(self, texts: list[bytes]) -> list[tuple]:
        """Words and end, how many of them frequent, their base score, the model's score, the other words, and two numbers of each.

        The score takes other words for none of the training words. One that was seen c times adds log(a + c * b) to it.
        """
        out = []
        for logs, end, number, rare, once, kind in self.parts(texts):
            base = float(self.base[number[number < len(self.words)]].sum()) + self.base_of_end
            mixed, k = self.mixed(logs, kind), np.flatnonzero(number == len(self.words))
            a, b = (np.exp(np.clip(x - mixed[k], -700, 300)) for x in (logs[0, k] + self.weights[0, kind[k]], once + self.weights[1, kind[k]]))
            out.append((len(number) + 1, len(number) - len(rare) + (self.ends > 0), base, float((mixed.sum() + end) / np.log(10)), rare, a, b))
        return out


def opens_word(tokenizer: Tokenizer) -> np.ndarray:
    """Which ids begin with a space; the end does not."""
    out = np.zeros(tokenizer.end + 1, bool)
    for piece, rank in tokenizer.ranks.items():
        out[rank] = piece[:1] == b" "
    return out


def _bytes(batch: pa.RecordBatch, text: str) -> Iterator[bytes]:
    return (x.as_py() or b"" for x in batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()))


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """word, c over all texts: tasks add up what they hold before anything is shuffled."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "c"])
        for batch in batches:
            for t in _bytes(batch, text):
                held.update(t.translate(LOWER).split())
                if len(held) > HELD_WORDS:
                    yield out()
                    held = Counter()
        yield out()

    return docs.select(text).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def count_pairs(vocabulary: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """before, id, words, n: pairs of ids that follow each other in words (the end id: word ends), in how many distinct words, and how often in the texts."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(tokenizer)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            end = np.array([tok.end])
            ids = [tok.encoding.encode_to_numpy(" " + x.decode("utf-8", "replace")) for x in batch.column(0).to_pylist()]
            line = np.concatenate([end, *(x for i in ids for x in (i, end))]).astype(np.int64)
            times = np.repeat(batch.column(1).to_numpy(), np.fromiter(map(len, ids), np.int64, len(ids)) + 1)
            key, place, words = np.unique((line[:-1] << 20) | line[1:], return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key >> 20), pa.array(key & 0xFFFFF), pa.array(words), pa.array(np.bincount(place, weights=times).astype(np.int64))], names=["before", "id", "words", "n"])

    return vocabulary.select("word", "c").mapInArrow(run, "before long, id long, words long, n long").groupBy("before", "id").agg(F.sum("words").alias("words"), F.sum("n").alias("n"))


def count_ids(vocabulary: DataFrame, tokenizer: Tokenizer, end_share: float) -> tuple[Pairs, np.ndarray]:
    """Counts of pairs of ids, and how often training words begin with each id. What reaches the driver is bounded by the ids and by SPELLED squared."""
    pairs = materialise(count_pairs(vocabulary, tokenizer), "pairs")
    counts, firsts = np.zeros(tokenizer.end + 1), np.zeros(tokenizer.end + 1)
    for i, n, first in pairs.groupBy("id").agg(F.sum("n"), F.sum(F.when(F.col("before") == tokenizer.end, F.col("n")).otherwise(0))).collect():
        counts[i], firsts[i] = n, first
    counts[tokenizer.end] = firsts[tokenizer.end] = 0
    index = np.full(tokenizer.end + 1, SPELLED)
    frequent = [i for i in np.argsort(-counts, kind="stable")[:SPELLED].tolist() if counts[i]]
    index[frequent] = np.arange(len(frequent))
    index[tokenizer.end] = SPELLED + 1
    side = SPELLED + 2

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, place = np.unique(index[batch.column(0).to_numpy()] * side + index[batch.column(1).to_numpy()], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(place, weights=batch.column(2).to_numpy(), minlength=len(key)).astype(np.int64))], names=["cell", "n"])

    cells = pairs.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(side * side)
    table[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    return Pairs(index, table.reshape(side, side), counts, opens_word(tokenizer), end_share), firsts


def passages(training: DataFrame, text: str, doc_id: str, tokens: int, per_million: int = PASSAGES, span: int = SPAN) -> list[tuple[bytes, bool, bool]]:
    """Passages of whole words from any place of any text, by hash, and whether a text begins and ends with them."""
    wanted = per_million * max(1.0, tokens / 1e6) ** (1 / 3)
    rows = training.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(F.lit("passage"), F.col(doc_id).cast("string"), F.col(text)).alias("h"))
    rows = rows.withColumn("n", F.greatest(F.lit(1), F.ceil(F.length("text") / span)).cast("int"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    chance = lambda i: F.pmod(F.xxhash64("h", i), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: chance(i) < 1.1 * wanted / max(total, 1))
    cut = rows.select("text", "n", F.explode(chosen).alias("i")).select(F.substring(F.col("text"), F.col("i") * span + 1, F.lit(span)).alias("t"), (F.col("i") == 0).alias("begins"), (F.col("i") == F.col("n") - 1).alias("ends"), F.xxhash64("text", "i").alias("c"))
    out = []
    for r in sorted(cut.collect(), key=lambda r: (r["c"], r["t"])):
        t = r["t"].encode()
        #: Words that the passage cuts through are left out.
        if not r["begins"]:
            t = t[len(t.split(None, 1)[0]) + len(t) - len(t.lstrip()) :] if t.split() else b""
        if not r["ends"] and t.split():
            t = t[: len(t.rstrip()) - len(t.rsplit(None, 1)[-1])]
        out.append((t, r["begins"], r["ends"]))
    return out


class Lesson:
    """What one task learns of its texts: how the network moves from where it started, and the odds of the two ways to draw each word."""

    def __init__(self, scorer: Scorer, seed: int):
        self.s, self.net = scorer, copy.copy(scorer.net)
        self.net.p = {k: v.copy() for k, v in scorer.net.p.items()}
        self.moves, self.random = Moves(self.net), np.random.default_rng(seed)
        self.met, self.windows = np.zeros(len(self.net.label)), 0
        self.odds = np.zeros((CLASSES + 1) * BINS)

    def learn(self, spelled: list[tuple]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Trains on all windows of some texts. Gives their rare words, the classes of these, and their log odds if they were seen once."""
        s = self.s
        ids, before, target, kept = s.laid_out([x[0] for x in spelled])
        logs, boundary = np.zeros(kept.shape), np.zeros(kept.shape)
        order = self.random.permutation(len(ids))
        for k in range(0, len(order), BATCH):
            own = order[k : k + BATCH]
            g = self.net.gradients(ids[own], s.prior[before[own]], target[own], kept[own], s.starts)
            logs[own], boundary[own] = (x.reshape(len(own), STEP) for x in g["told"])
            t = self.moves.t + 1
            self.moves.step(g, RATE * min(1, t / 20) / np.sqrt(1 + t / SETTLED))
        self.met += np.bincount(ids.ravel(), minlength=len(self.met))
        self.windows += len(ids)
        words, kinds, left = [], [np.zeros(0, np.int64)], [np.zeros(0)]
        #: One occurrence of each word is taken out of its own share.
        for (each, whole), _, number, rare, once, kind in s.ways(spelled, logs[kept], boundary[kept], s.own_without):
            known = number < len(s.words)
            at = np.clip(np.floor((whole - each)[known] / BIN + 0.5) + BINS // 2, 0, BINS - 1).astype(np.int64)
            self.odds += np.bincount(kind[known] * BINS + at, minlength=len(self.odds))
            words += rare
            kinds.append(kind[~known])
            left.append(once - each[~known])
        return words, np.concatenate(kinds), np.concatenate(left)

    def told(self, start: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, weights, and moves times weights: of ids (embeddings), of the other parameters in rows of WIDTH (-1, -2, ...), and of bins, which have weights alone."""
        rows = np.flatnonzero(self.met)
        of_ids = (self.net.p["E"][rows] - start["E"][rows]) * self.met[rows, None]
        others = _in_rows(self.net.p) - _in_rows(start)
        bins = np.flatnonzero(self.odds)
        return (
            np.concatenate([rows, -1 - np.arange(len(others)), bins + ODDS]),
            np.concatenate([self.met[rows], np.full(len(others), float(self.windows)), self.odds[bins]]),
            np.concatenate([of_ids, others * self.windows, np.zeros((len(bins), WIDTH))]),
        )


def _in_rows(p: dict[str, np.ndarray]) -> np.ndarray:
    """All parameters but the embeddings of ids, in rows of WIDTH."""
    flat = np.concatenate([v.ravel() for k, v in p.items() if k != "E"]).astype(float)
    return np.pad(flat, (0, -len(flat) % WIDTH)).reshape(-1, WIDTH)


def teach(scorer: Scorer, training: DataFrame, vocabulary: DataFrame, text: str) -> None:
    """Trains the network on all training texts and fits the weights to all their words. What reaches the driver is bounded by ids, parameters and bins."""
    shared = training.sparkSession.sparkContext.broadcast(scorer)
    names = [f"v{k}" for k in range(WIDTH)]
    kinds = {"key": pa.int64(), "n": pa.float64(), **dict.fromkeys(names, pa.float64()), "word": pa.binary(), "kind": pa.int32(), "left": pa.float64()}

    def rows(**given: np.ndarray | list) -> pa.RecordBatch:
        n = len(next(iter(given.values())))
        return pa.RecordBatch.from_arrays([pa.array(given[k], t) if k in given else pa.nulls(n, t) for k, t in kinds.items()], names=list(kinds))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        lesson = Lesson(s, TaskContext.get().partitionId())
        held, size = [], 0
        for batch in batches:
            for t in _bytes(batch, text):
                held.append(s.ids(t))
                size += len(held[-1][0]) // STEP + 1
                if size >= RUN:
                    words, kind, left = lesson.learn(held)
                    yield rows(word=words, kind=kind, left=left)
                    held, size = [], 0
        if held:
            words, kind, left = lesson.learn(held)
            yield rows(word=words, kind=kind, left=left)
        if lesson.windows:
            key, n, v = lesson.told(s.net.p)
            yield rows(key=key, n=n, **{name: v[:, k] for k, name in enumerate(names)})

    told = materialise(training.select(text).mapInArrow(run, f"key long, n double, {', '.join(f'{v} double' for v in names)}, word binary, kind int, left double"), "lessons")
    sums = told.where("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n"), *(F.sum(v).alias(v) for v in names)).toArrow()
    key, n = (sums.column(c).to_numpy() for c in ("key", "n"))
    moved = np.stack([sums.column(v).to_numpy() for v in names], axis=1) / np.maximum(n, 1)[:, None]
    p, own = scorer.net.p, (key >= 0) & (key < ODDS)
    p["E"][key[own]] += moved[own].astype(np.float32)
    others = _in_rows(p)
    others[-1 - key[key < 0]] += moved[key < 0]
    flat, at = others.ravel(), 0
    for k in p:
        if k != "E":
            p[k], at = flat[at : at + p[k].size].reshape(p[k].shape).astype(np.float32), at + p[k].size
    odds = np.zeros((CLASSES + 1) * BINS)
    odds[key[key >= ODDS] - ODDS] = n[key >= ODDS]
    #: Words that are not frequent have their counts in the vocabulary; one seen once is none of the other training words.
    bins = F.when(F.col("c") > 1, F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("left") + F.log(F.col("c") - 1.0)) / BIN + 0.5) + BINS // 2))).otherwise(0)
    rare = told.where("word IS NOT NULL").select(F.col("word").alias("w"), "kind", "left").join(vocabulary, F.col("w") == F.col("word")).groupBy((F.col("kind") * BINS + bins).alias("b")).count().toArrow()
    odds[rare.column("b").to_numpy()] += rare.column("count").to_numpy()
    scorer.fit_weights(odds.reshape(CLASSES + 1, BINS))
    shared.unpersist()


def learn(training: DataFrame, vocabulary: DataFrame, text: str, doc_id: str, tokenizer: Tokenizer | None = None, per_million: int = PASSAGES, frequent: int = FREQUENT) -> tuple[Scorer, int, int]:
    """The scorer, the number of training tokens and that of distinct ones. vocabulary: the word counts of the training rows."""
    tokenizer = tokenizer or Tokenizer()
    ends = training.select(doc_id).count()
    total, distinct = vocabulary.agg(F.sum("c"), F.count("*")).first()
    total, distinct = (total or 0) + ends, distinct + (ends > 0)
    #: The lowest count that at most ``frequent`` words reach, by a histogram of a few hundred steps.
    short = vocabulary.where(F.length("word") <= LONGEST)
    step = F.floor(F.log2("c") * 16)
    chosen, low = 0, None
    for r in short.groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect():
        chosen += r["count"]
        if chosen > frequent:
            break
        low = r["s"]
    top = short.where(step >= low).toArrow() if low is not None else None
    words = top.column("word").to_pylist() if top else []
    counts = top.column("c").to_numpy() if top else np.zeros(0, np.int64)
    sample = passages(training, text, doc_id, total, per_million)
    pairs, firsts = count_ids(vocabulary, tokenizer, ends / max(total, 1))
    scorer = Scorer(tokenizer, words, counts, ends, total, distinct, pairs, firsts, sample)
    if ends:
        teach(scorer, training, vocabulary, text)
    return scorer, total, distinct


def score(docs: DataFrame, held_out, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text; rows where held_out is false teach.

    held_out: a boolean expression over docs.
    """
    rows = docs.select(doc_id, text, held_out.alias("held_out"))
    training = rows.where(~F.col("held_out"))
    vocabulary = materialise(count_words(training, text), "vocabulary")
    scorer, total, distinct = learn(training, vocabulary, text, doc_id)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    id_type = docs.schema[doc_id].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, task, row = shared.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            found, held, size = [], [], 0
            for t in _bytes(batch, text):
                held.append(t)
                size += len(t)
                if size > CHUNK:
                    found += s.score(held)
                    held, size = [], 0
            found += s.score(held) if held else []
            ends = np.cumsum([0, *(len(f[4]) for f in found)])
            each = [pa.array([w for f in found for w in f[4]], pa.binary()), *(pa.array(np.concatenate([np.zeros(0), *(f[k] for f in found)])) for k in (5, 6))]
            rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(each, ["w", "a", "b"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(found)) + (task << 40)), batch.column(0), batch.column(2), *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))), rare],
                names=["rid", doc_id, "held_out", "n_tokens", "known", "base", "score", "rare"],
            )
            row += len(found)

    scored = materialise(rows.mapInArrow(run, f"rid long, `{doc_id}` {id_type}, held_out boolean, n_tokens long, known long, base double, score double, rare array<struct<w:binary,a:double,b:double>>"), "scored")
    other = scored.select("rid", F.explode("rare").alias("r")).select("rid", F.col("r.w").alias("w"), F.col("r.a").alias("a"), F.col("r.b").alias("b"))
    looked = other.join(vocabulary, F.col("w") == F.col("word"), "left").withColumn("c", F.coalesce("c", F.lit(0)))
    seen = lambda x: F.sum(F.when(F.col("c") > 0, x).otherwise(0))
    sums = looked.groupBy("rid").agg(
        seen(F.lit(1)).alias("more"), F.sum(F.log10(F.col("c") + 1.0) - float(np.log10(total + distinct + 1))).alias("base_more"), seen(F.log10(F.col("a") + F.col("c") * F.col("b"))).alias("score_more"),
    ).withColumnRenamed("rid", "r_rid")
    return scored.drop("rare").join(sums, F.col("rid") == F.col("r_rid"), "left").select(
        doc_id, "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("base_more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("score_more", F.lit(0.0))).alias("score"),
    )
