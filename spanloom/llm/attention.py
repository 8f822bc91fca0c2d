"""A small causal self-attention model over subword ids, in numpy.

A text is its words (A-Z lower-cased, ASCII white space between them), each a space and its
bytes, cut greedily into the longest entries of a public byte-level vocabulary; entries with
upper-case letters or inner white space are left out. The end id follows. Each word sequence
has one id sequence, so the chances of all id sequences add up to one over all texts.

The model has one layer: queries, keys and values of each id are rows of a table, attention
to earlier positions falls off with distance under a causal mask, and a hidden layer of the
attended values and the last two ids predicts the class of the next id. To the classes'
logits comes a table of how often each follows the last id; which id of its class it is
comes from counts of pairs, smoothed by the ids' own counts. Classes are halves of halves of
the ids, cut along the main directions of their neighbours' counts. Ids beyond the rows of
the tables are dealt to the classes and have chances by their own counts. All counts are of
all training texts; the tables have as many numbers as ``rows`` squared.

Long texts are cut into overlapping windows: each id is scored once, with ``LEAD`` ids or more
before it in its window, or all there are; places before a text hold the end id.

Training is adaptive gradient descent on windows (``step``). ``changes`` and ``add_changes``
turn what several workers have learned from one start into rows that Spark can sum.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import chain

import ahocorasick
import numpy as np

#: Ids that a window scores, and those before them that it sees.
STEP, LEAD = 32, 16
KEY, VALUE, HIDDEN = 4, 16, 32
#: An input row: query, key, value and a one, and what goes straight to the hidden layer.
VALUE_AT, OWN_AT = 2 * KEY, 2 * KEY + VALUE + 1
#: How fast attention falls off with distance, as an exponent's factor; bound of the numbers in queries and keys.
FALL, MOST = 0.05, 2.8
PARTS = {"q": slice(0, KEY), "k": slice(KEY, VALUE_AT), "v": slice(VALUE_AT, OWN_AT - 1), "own": slice(OWN_AT, OWN_AT + HIDDEN)}
#: Numbers in a row of ``changes``, about.
BLOCK = 1 << 16
f32 = np.float32


class Subwords:
    """Cuts words into ids. Id 0 is the end; the others number the vocabulary's usable entries in its order."""

    def __init__(self, path: str):
        self.pieces: list[bytes] = [b""]
        self.trie = ahocorasick.Automaton()
        with open(path, "rb") as lines:
            for line in lines:
                piece = base64.b64decode(line.split()[0])
                inner = piece[1:] if piece[:1] == b" " else piece
                if len(piece) == 1 and piece not in b"\t\n\v\f\r" or inner and piece == piece.lower() and not set(inner) & set(b" \t\n\v\f\r"):
                    self.trie.add_word(piece.decode("latin-1"), len(self.pieces))
                    self.pieces.append(piece)
        self.trie.make_automaton()
        self.size = len(self.pieces)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in turn, and the number of each word's ids."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        text = b" " + b" ".join(words)
        found = np.fromiter(chain.from_iterable(self.trie.iter_long(text.decode("latin-1"))), np.int64).reshape(-1, 2)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        return found[:, 1].astype(np.int32), np.diff(np.searchsorted(found[:, 0], ends), prepend=0)


@functools.lru_cache(maxsize=2)
def subwords(path: str) -> Subwords:
    return Subwords(path)


def window_starts(lengths: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Of texts laid end to end: the text of each window, and the place in the text of the first id that it scores."""
    n = -(-lengths // step)
    of = np.repeat(np.arange(len(lengths)), n)
    return of, (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * step


def windows(lengths: np.ndarray, of: np.ndarray, at: np.ndarray, step: int = STEP, lead: int = LEAD) -> np.ndarray:
    """Positions of some windows (windows x lead + 1 + step), -1 where a text has not begun or is over. The last ``step`` columns are scored, each from those before it."""
    inside = at[:, None] + np.arange(-1 - lead, step)
    there = (inside >= 0) & (inside < lengths[of][:, None])
    return np.where(there, (np.cumsum(lengths) - lengths)[of][:, None] + inside, -1)


@functools.lru_cache(maxsize=2)
def mask(step: int, lead: int) -> np.ndarray:
    """The weight of the step back from a scored row's input to a column; zero ahead."""
    back = lead + np.arange(step)[:, None] - np.arange(lead + step)[None, :]
    return np.where(back >= 0, np.exp(-FALL * np.maximum(back, 0)), 0).astype(f32)


def softmax(x: np.ndarray) -> np.ndarray:
    """In place, over the last axis of logits, which are logs of chances and small sums: far from where an exponential overflows."""
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[-1], x.dtype))[..., None]
    return x


def tanh(x: np.ndarray) -> np.ndarray:
    """In place, by one exponential, which numpy has in wide registers."""
    x *= 2
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    x += 1
    np.divide(-2, x, out=x)
    x += 1
    return x


@dataclass
class Model:
    """``row``: each id's row of the input tables; ``group``: its class; ``follows``: log chance of each class after each row; ``inside``: log chance in its class of each row after each row; ``rest`` less ``whole`` (of row and class): that of an id without a row of its own; ``past``: sums of squared slopes."""

    row: np.ndarray
    group: np.ndarray
    rest: np.ndarray
    follows: np.ndarray
    inside: np.ndarray
    whole: np.ndarray
    weights: dict[str, np.ndarray]
    past: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if not self.past:
            self.past = {name: np.full((len(x), len(PARTS)) if name == "x" else x.shape[:1] if name == "p" else x.shape, 1e-6, f32) for name, x in self.weights.items()}

    def hidden(self, rows: np.ndarray, keep: bool = False):
        """Hidden layer at the inputs of the scored columns of windows of input rows (n x LEAD + STEP)."""
        w, (n, t) = self.weights, rows.shape
        x = np.take(w["x"], rows, axis=0)
        q, k, v = x[:, LEAD:, :KEY], x[..., KEY:VALUE_AT], x[..., VALUE_AT:OWN_AT]
        a = q @ k.transpose(0, 2, 1)
        np.exp(a, out=a)
        a *= mask(t - LEAD, LEAD)
        o = a @ v  # the last column of v is one: its sum is the total
        o, total = o[..., :VALUE] / o[..., VALUE:], o[..., VALUE:]
        h = (o.reshape(-1, VALUE) @ w["o"]).reshape(n, t - LEAD, HIDDEN)
        h += x[:, LEAD:, OWN_AT:]
        h += np.take(w["p"], rows[:, LEAD - 1 : -1], axis=0)
        tanh(h)
        return (h, (q, k, v, a, total, o)) if keep else h

    def log_chance(self, ids: np.ndarray, lengths: np.ndarray, most: int = 96) -> np.ndarray:
        """Natural log of each id's chance given those before it in its text."""
        w = self.weights
        of, at = window_starts(lengths)
        rows, out, ones = np.append(self.row[ids], self.row[0]), np.zeros(len(ids)), np.ones(len(w["cb"]), f32)
        follows = self.follows + w["cb"]
        for b in range(0, len(at), most):
            some = windows(lengths, of[b : b + most], at[b : b + most])
            inputs, target = rows[some[:, :-1]], some[:, LEAD + 1 :].ravel()
            h, before = self.hidden(inputs).reshape(-1, HIDDEN), inputs[:, LEAD:].ravel()
            goal = ids[target]
            group, row = self.group[goal], rows[target]
            first = h @ w["c"]
            first += np.take(follows, before, axis=0)
            value = np.take(first, np.arange(0, first.size, first.shape[1]) + group)
            np.exp(first, out=first)
            value -= np.log(first @ ones)
            rare = np.flatnonzero(row == len(self.inside) - 1)
            inside = np.take(self.inside, before.astype(np.int64) * self.inside.shape[1] + row)
            inside[rare] = self.rest[goal[rare]] - self.whole[before[rare], group[rare]]
            value += inside
            own = target >= 0
            out[target[own]] = value[own]
        return out


def directions(left: np.ndarray, right: np.ndarray, dims: int = 24) -> np.ndarray:
    """For each row, its main directions among the counts (rows x contexts) of what stands before and after it."""
    parts = []
    for counts in (left, right):
        total = counts.sum()
        expected = counts.sum(1, keepdims=True) * counts.sum(0) / max(total, 1)
        parts.append((np.sqrt(counts) - np.sqrt(expected)) / np.sqrt(counts.sum(1, keepdims=True) + 1))
    x = np.concatenate(parts, axis=1)
    return x @ np.linalg.eigh(x.T @ x)[1][:, -dims:]


def halves(x: np.ndarray, depth: int) -> np.ndarray:
    """2**depth classes of even size, by cutting each along its main direction at the median."""
    group = np.zeros(len(x), dtype=np.int64)
    for _ in range(depth):
        new = np.zeros_like(group)
        for g in np.unique(group):
            own = np.flatnonzero(group == g)
            y = x[own] - x[own].mean(0)
            direction = np.linalg.eigh(y.T @ y)[1][:, -1]
            order = own[np.argsort(y @ direction, kind="stable")]
            new[order[: len(order) // 2]] = 2 * g
            new[order[len(order) // 2 :]] = 2 * g + 1
        group = new
    return group


def rows_of(counts: np.ndarray, most_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids that have a row of their own, the end first, and each id's row; all others share the last."""
    order = np.argsort(-counts, kind="stable")
    order = np.concatenate([[0], order[order != 0]])
    rows = max(1, min(most_rows, int((counts > 0).sum()), len(counts) - 1))
    row = np.full(len(counts), rows, dtype=np.int32)
    row[order[:rows]] = np.arange(rows)
    return order, row


def classes(counts: np.ndarray, most_rows: int, left: np.ndarray, right: np.ndarray, most_depth: int = 6) -> np.ndarray:
    """The class of each id. ``left`` and ``right``: counts of neighbours of each row."""
    order, row = rows_of(counts, most_rows)
    rows = int(row.max())
    depth = max(1, min(most_depth, int(np.ceil(np.log2(max(4, rows)) / 2))))
    group = np.zeros(len(counts), dtype=np.int32)
    group[order[:rows]] = halves(directions(left, right)[:rows], depth)
    group[order[rows:]] = np.arange(len(order) - rows) % (1 << depth)
    return group


def start(counts: np.ndarray, most_rows: int, group: np.ndarray, pairs: np.ndarray, seed: int = 5, weight: float = 8.0) -> Model:
    """A model that has the counts of all texts and no context beyond the last id. ``pairs``: how often each row follows each row (rows x rows, 32-bit floats)."""
    rng = np.random.default_rng(seed)
    order, row = rows_of(counts, most_rows)
    rows, groups = int(row.max()), int(group.max()) + 1
    place, rare = group[order[:rows]], order[rows:]
    own = np.append(counts[order[:rows]], 0.0) + 0.01
    shared = counts[rare] + 0.5
    in_group = np.bincount(place, own[:rows], minlength=groups) + np.bincount(group[rare], shared, minlength=groups)
    member = np.zeros((rows + 1, groups))
    member[np.arange(rows), place] = 1
    after = (pairs @ member.astype(f32)).astype(float)
    whole = np.log(after + weight)
    after += pairs[:, rows:] * (np.bincount(group[rare], minlength=groups) / max(1, len(rare)))
    follows = np.log(after + weight * in_group / in_group.sum()) - np.log(pairs.sum(1, keepdims=True) + weight)
    share = np.append(own[:rows] / in_group[place], 1.0)
    inside = pairs + (weight * share).astype(f32)
    np.log(inside, out=inside)
    inside -= whole[:, np.append(place, 0)].astype(f32)
    rest = np.zeros(len(counts))
    rest[rare] = np.log(weight * shared / in_group[group[rare]])

    def table(n, width, size):
        return rng.normal(0, size, (n, width)).astype(f32)

    w = {
        "x": np.concatenate([table(rows + 1, 2 * KEY + VALUE, 0.3), np.ones((rows + 1, 1), f32), table(rows + 1, HIDDEN, 0.2)], axis=1),
        "p": table(rows + 1, HIDDEN, 0.1),
        "o": table(VALUE, HIDDEN, 0.2),
        "c": np.zeros((HIDDEN, groups), f32),
        "cb": np.zeros(groups, f32),
    }
    return Model(row, group, rest, follows.astype(f32), inside, whole.astype(f32), w)


#: Columns of the slopes of a place: those of its rows of "x" and "p", and one that makes them even.
P_AT = OWN_AT + HIDDEN
WIDE = P_AT + HIDDEN + (P_AT + HIDDEN) % 2
#: Which columns belong to which part.
MEMBER = np.zeros((len(PARTS) + 1, WIDE), f32)
for _i, _part in enumerate([*PARTS.values(), slice(P_AT, P_AT + HIDDEN)]):
    MEMBER[_i, _part] = 1
AVERAGE = np.ascontiguousarray((MEMBER / MEMBER.sum(1, keepdims=True)).T)


@functools.lru_cache(maxsize=2)
def places(n: int, t: int) -> np.ndarray:
    """Room for the slopes of all places of windows. What ``step`` does not fill stays zero."""
    return np.zeros((n, t, WIDE), f32)


def summed_by_row(rows: np.ndarray, d: np.ndarray, singly: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are there, and the sums of the lines of ``d`` that belong to each. The first lines of all rows are added
    side by side, then the second ones and so on; what is left of the few rows with more lines than ``singly`` is added row by row."""
    at = rows.astype(np.uint16 if rows.max(initial=0) < 1 << 16 else np.int64)  # sorted by digits, if short
    by = np.argsort(at, kind="stable")
    at = at[by]
    firsts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    sizes = np.append(firsts[1:], len(at)) - firsts
    rank = -np.minimum(sizes, singly + 1).astype(np.int16)
    order = np.argsort(rank, kind="stable")
    firsts, sizes = firsts[order], sizes[order]
    total = np.take(d, by[firsts], axis=0)
    more = np.searchsorted(rank[order], -np.arange(1, singly + 1)).tolist()  # rows that have a line at 1, 2, ...
    for i, n in enumerate(more[:-1], 1):
        total[:n] += np.take(d, by[firsts[:n] + i], axis=0)
    if n := more[-1]:
        left = sizes[:n] - singly
        starts = np.cumsum(left) - left
        lines = np.repeat(firsts[:n] + singly - starts, left) + np.arange(left.sum())
        # pairs of columns are summed as complex numbers: that costs as much for two as for one
        total[:n] += np.add.reduceat(np.take(d, by[lines], axis=0).view(np.complex64), starts, axis=0).view(f32)
    return at[firsts].astype(np.int64), total


def step(model: Model, windows_of_ids: np.ndarray, rate: float) -> None:
    """One step of adaptive gradient descent over some windows of ids, -1 where there is none."""
    w, past = model.weights, model.past
    rows = model.row[np.maximum(windows_of_ids[:, :-1], 0)]
    h, (q, k, v, a, total, o) = model.hidden(rows, keep=True)
    target = windows_of_ids[:, LEAD + 1 :].ravel()
    x, before = h.reshape(-1, HIDDEN), rows[:, LEAD:].ravel()
    slopes: dict[str, np.ndarray] = {}
    p = x @ w["c"]
    p += w["cb"]
    p += np.take(model.follows, before, axis=0)
    np.exp(p, out=p)
    whole = p @ np.ones(p.shape[1], f32)
    p.ravel()[np.arange(0, p.size, p.shape[1]) + model.group[target]] -= whole
    known = target >= 0
    p *= (known / (whole * max(1, np.count_nonzero(known)))).astype(f32)[:, None]
    slopes["c"], slopes["cb"] = x.T @ p, np.ones(len(p), f32) @ p
    x *= x
    np.subtract(1, x, out=x)
    x *= p @ w["c"].T
    slopes["o"] = o.reshape(len(x), -1).T @ x
    # of the attended values over the total; the last column meets the column of ones in v
    do = np.empty((*o.shape[:2], VALUE + 1), f32)
    np.divide((x @ w["o"].T).reshape(o.shape), total, out=do[..., :VALUE])
    np.negative(np.einsum("ijk,ijk->ij", do[..., :VALUE], o), out=do[..., VALUE])
    da = do @ v.transpose(0, 2, 1)
    da *= a
    for name, slope in slopes.items():
        past[name] += slope**2
        w[name] -= rate * slope / np.sqrt(past[name])

    d = places(*rows.shape)
    d[:, LEAD:, PARTS["q"]] = da @ k
    d[..., PARTS["k"]] = da.transpose(0, 2, 1) @ q
    d[..., PARTS["v"]] = a.transpose(0, 2, 1) @ do[..., :VALUE]
    d[:, LEAD:, PARTS["own"]] = d[:, LEAD - 1 : -1, P_AT : P_AT + HIDDEN] = h
    touched, slope = summed_by_row(rows.ravel(), d.reshape(-1, WIDE))
    squares = np.square(slope) @ AVERAGE
    squares[:, :-1] += past["x"][touched]
    squares[:, -1] += past["p"][touched]
    past["x"][touched], past["p"][touched] = squares[:, :-1], squares[:, -1]
    slope *= (rate / np.sqrt(squares)) @ MEMBER
    new = np.take(w["x"], touched, axis=0)
    new -= slope[:, :P_AT]
    np.clip(new[:, :VALUE_AT], -MOST, MOST, out=new[:, :VALUE_AT])
    w["x"][touched] = new
    w["p"][touched] -= slope[:, P_AT : P_AT + HIDDEN]


def learn(model: Model, windows_of_ids: Iterator[np.ndarray], rate: float, batch: int = 96) -> None:
    """Steps over a stream of windows, in turn."""
    for some in windows_of_ids:
        for b in range(0, len(some), batch):
            step(model, some[b : b + batch].astype(np.int32), rate)


def numbers(model: Model) -> dict[str, np.ndarray]:
    """All numbers that learning changes, as tables of two dimensions that share the model's memory."""
    every = {f"w.{k}": v for k, v in model.weights.items()} | {f"p.{k}": v for k, v in model.past.items()}
    return {k: v.reshape(len(v), -1) if v.ndim > 1 else v.reshape(-1, 1) for k, v in every.items()}


def copy_of(model: Model) -> Model:
    return replace(model, weights={k: v.copy() for k, v in model.weights.items()}, past={k: v.copy() for k, v in model.past.items()})


def without_pairs(model: Model) -> Model:
    """What learning needs of a model: not the chances inside the classes."""
    return replace(model, inside=model.inside[:0], whole=model.whole[:0])


def changes(before: Model, after: Model) -> Iterator[tuple[str, int, np.ndarray]]:
    """Table, first row and (rows x width + 1) the differences, with a last column of whether the row changed at all."""
    old, new = numbers(before), numbers(after)
    for name in old:
        height = max(1, BLOCK // old[name].shape[1])
        for first in range(0, len(old[name]), height):
            difference = new[name][first : first + height] - old[name][first : first + height]
            yield name, first, np.concatenate([difference, difference.any(axis=1, keepdims=True)], axis=1).astype(f32)


def add_changes(model: Model, name: str, first: int, summed: np.ndarray) -> None:
    """Adds to rows their mean difference among the workers that changed them."""
    mean = summed[:, :-1] / np.maximum(summed[:, -1:], 1)
    numbers(model)[name][first : first + len(mean)] += mean
