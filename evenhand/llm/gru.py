"""A gated recurrent language model in numpy: truncated backpropagation and a class-factored softmax.

Words are numbered by falling frequency. The first ones are the head: they have an input
vector and a softmax within their class. Less frequent words share classes by frequency, in
which each has its share of the class; all other words are in the open class. So
P(word | state) = P(class | state) P(word | class, state).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

STATE, CLASS_WORDS, WINDOW = 16, 128, 24
#: Words seen so often are in the head, which holds so many words at least, if there are, and at most.
LEARNT, HEAD, MOST_HEAD = 50, 2048, 8192
#: Output weights stay within this limit; places that are scored at once.
LIMIT, AT_ONCE = 4.0, 4096
INIT_SCALE, CLIP, SEED, MOST_LANES = 0.1, 1.0, 7, 384
Weights = dict[str, np.ndarray]


class Layout(NamedTuple):
    """Sizes of a model: words in the head, its classes, and shared classes, of which the last is open."""

    head: int
    classes: int
    shared: int

    @classmethod
    def of(cls, head: int, shared: int) -> Layout:
        return cls(head, -(-head // CLASS_WORDS), shared)


def head_size(counts: np.ndarray) -> int:
    """Words in the head, from all counts in falling order."""
    learnt = int(np.searchsorted(-counts, -LEARNT, side="right"))
    return min(max(HEAD, learnt), MOST_HEAD, len(counts))


def initial(layout: Layout) -> Weights:
    rng = np.random.default_rng(SEED)
    draw = lambda *shape: (INIT_SCALE * rng.standard_normal(shape)).astype(np.float32)
    weights = {
        "into": draw(layout.head + layout.shared, 3 * STATE),
        "within": draw(STATE, 3 * STATE),
        "to_class": np.zeros((STATE, layout.classes + layout.shared), np.float32),
        "class_bias": np.zeros(layout.classes + layout.shared, np.float32),
        "to_word": np.zeros((layout.classes, STATE, CLASS_WORDS), np.float32),
        "word_bias": np.zeros((layout.classes, CLASS_WORDS), np.float32),
    }
    return weights


def by_counts(layout: Layout, head: np.ndarray, shared: np.ndarray) -> Weights:
    """First weights whose biases give every word its share of the counts, whatever the state."""
    weights = initial(layout)
    slots = np.full(layout.classes * CLASS_WORDS, 1e-12)
    slots[: layout.head] = np.maximum(head, 0.5)
    slots = slots.reshape(layout.classes, CLASS_WORDS)
    classes = np.append(slots.sum(1), np.maximum(shared, 0.5))
    weights["class_bias"] = np.log(classes / classes.sum()).astype(np.float32)
    weights["word_bias"] = np.log(slots / slots.sum(1, keepdims=True)).astype(np.float32)
    return weights


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[name].ravel() for name in sorted(weights)])


def unflat(values: np.ndarray, layout: Layout) -> Weights:
    like, at, weights = initial(layout), 0, {}
    for name in sorted(like):
        size = like[name].size
        weights[name] = values[at : at + size].reshape(like[name].shape).astype(np.float32)
        at += size
    return weights


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Run(NamedTuple):
    """States and gates of one window, by step, feature and lane."""

    before: np.ndarray
    states: np.ndarray
    gates: np.ndarray
    news: np.ndarray
    mixed: np.ndarray


def forward(w: Weights, state: np.ndarray, inputs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, Run]:
    """All states of a window from the state carried over; ``starts`` marks first words of documents.

    Features come first in all arrays, so that every operation runs along the lanes.
    """
    steps, lanes = inputs.shape
    into = np.ascontiguousarray(w["into"].T)
    within_weights = np.ascontiguousarray(w["within"].T)
    run = Run(*(np.empty((steps, k * STATE, lanes), state.dtype) for k in (1, 1, 2, 1, 1)))
    for t in range(steps):
        if starts[t].any():
            state = state * ~starts[t]
        within = within_weights @ state
        now = np.take(into, inputs[t], axis=1)
        now[: 2 * STATE] += within[: 2 * STATE]
        gates = sigmoid(now[: 2 * STATE])
        now[2 * STATE :] += gates[STATE:] * within[2 * STATE :]
        new = np.tanh(now[2 * STATE :])
        run.before[t], run.gates[t], run.news[t], run.mixed[t] = state, gates, new, within[2 * STATE :]
        state = np.add(new, gates[:STATE] * (state - new), out=run.states[t])
    return state.copy(), run


def in_line(values: np.ndarray) -> np.ndarray:
    """Features by places, from steps, features and lanes."""
    return values.transpose(1, 0, 2).reshape(values.shape[1], -1)


def by_class(targets: np.ndarray, layout: Layout) -> Iterator[tuple[int, np.ndarray]]:
    """Places whose target is in the head, class by class."""
    places = np.flatnonzero(targets < layout.head)
    classes = (targets[places] // CLASS_WORDS).astype(np.uint16)
    order = np.argsort(classes, kind="stable")
    bounds = np.searchsorted(classes[order], np.arange(layout.classes + 1))
    for c in range(layout.classes):
        if bounds[c] < bounds[c + 1]:
            yield c, places[order[bounds[c] : bounds[c + 1]]]


def target_classes(targets: np.ndarray, layout: Layout) -> np.ndarray:
    return np.where(targets < layout.head, targets // CLASS_WORDS, targets - layout.head + layout.classes)


def class_scores(w: Weights, states: np.ndarray) -> np.ndarray:
    """Logits of the classes; LIMIT keeps their exponentials finite."""
    return w["to_class"].T @ states + w["class_bias"][:, None]


def word_scores(w: Weights, states: np.ndarray, c: int) -> np.ndarray:
    return w["to_word"][c].T @ states + w["word_bias"][c][:, None]


def log_probabilities(w: Weights, states: np.ndarray, targets: np.ndarray, layout: Layout) -> np.ndarray:
    """Natural log P(class) P(word | class) at every place; the words of shared classes are left to the caller."""
    found = np.empty(len(targets))
    aims = target_classes(targets, layout)
    for low in range(0, len(targets), AT_ONCE):
        part = slice(low, low + AT_ONCE)
        scores = class_scores(w, states[:, part])
        found[part] = scores[aims[part], np.arange(scores.shape[1])]
        found[part] -= np.log(np.exp(scores, out=scores).sum(0))
    for c, places in by_class(targets, layout):
        scores = word_scores(w, states[:, places], c)
        found[places] += scores[targets[places] % CLASS_WORDS, np.arange(len(places))]
        found[places] -= np.log(np.exp(scores, out=scores).sum(0))
    return found


def errors(scores: np.ndarray, aims: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Gradient of the weighted log-likelihood of the aims by their logits, in the place of these."""
    np.exp(scores, out=scores)
    scores *= -weight / scores.sum(0)
    scores[aims, np.arange(len(aims))] += weight
    return scores


def gradients(
    w: Weights, run: Run, inputs: np.ndarray, targets: np.ndarray, starts: np.ndarray, used: np.ndarray, layout: Layout
) -> Weights:
    """Gradients of the mean log-likelihood of the used targets, back to the first step of the window."""
    steps, lanes = inputs.shape
    states, aim = in_line(run.states), targets.ravel()
    weight = (used.ravel() / max(1, used.sum())).astype(states.dtype)
    found = {name: np.zeros_like(value) for name, value in w.items()}

    error = errors(class_scores(w, states), target_classes(aim, layout), weight)
    found["to_class"], found["class_bias"] = states @ error.T, error.sum(1)
    to_states = w["to_class"] @ error
    for c, places in by_class(aim, layout):
        some = states[:, places]
        error = errors(word_scores(w, some, c), aim[places] % CLASS_WORDS, weight[places])
        found["to_word"][c], found["word_bias"][c] = some @ error.T, error.sum(1)
        to_states[:, places] += w["to_word"][c] @ error

    by_step = np.ascontiguousarray(to_states.reshape(STATE, steps, lanes).transpose(1, 0, 2))
    to_into = np.empty((steps, 3 * STATE, lanes), states.dtype)
    to_within = np.empty_like(to_into)
    carried = np.zeros((STATE, lanes), states.dtype)
    for t in range(steps - 1, -1, -1):
        down = by_step[t] + carried
        keep, reset = run.gates[t, :STATE], run.gates[t, STATE:]
        new, before = run.news[t], run.before[t]
        to_new = down * (1 - keep) * (1 - new * new)
        to_into[t, :STATE] = down * (before - new) * keep * (1 - keep)
        to_into[t, STATE : 2 * STATE] = to_new * run.mixed[t] * reset * (1 - reset)
        to_into[t, 2 * STATE :] = to_new
        to_within[t, : 2 * STATE] = to_into[t, : 2 * STATE]
        to_within[t, 2 * STATE :] = to_new * reset
        carried = down * keep + w["within"] @ to_within[t]
        if starts[t].any():
            carried *= ~starts[t]
    found["within"] = in_line(run.before) @ in_line(to_within).T
    ids = inputs.ravel().astype(np.uint16 if layout.head + layout.shared < 65536 else np.int64)
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    found["into"][ids[first]] = np.add.reduceat(np.take(in_line(to_into), order, axis=1), first, axis=1).T
    return found


class Adam:
    def __init__(self, w: Weights, rate: float):
        self.w, self.rate, self.step = w, rate, 0
        self.share = 1.0
        self.first = {name: np.zeros_like(value) for name, value in w.items()}
        self.second = {name: np.zeros_like(value) for name, value in w.items()}

    def climb(self, gradient: Weights) -> None:
        self.step += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in gradient.values()))
        scale = np.float32(min(1.0, CLIP / max(norm, 1e-12)))
        rate = np.float32(self.rate * self.share * np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step))
        for name, g in gradient.items():
            first, second = self.first[name], self.second[name]
            first += np.float32(0.1) * (g * scale - first)
            second += np.float32(0.01) * (g * g * scale * scale - second)
            self.w[name] += rate * first / (np.sqrt(second) + np.float32(1e-7))
        for name in ("to_class", "to_word"):
            np.clip(self.w[name], -LIMIT, LIMIT, out=self.w[name])


class Lanes(NamedTuple):
    """Documents laid end to end in lanes: by step and lane the word, its document's start, and whether it is one."""

    targets: np.ndarray
    inputs: np.ndarray
    starts: np.ndarray
    used: np.ndarray
    lane_of: np.ndarray
    step_of: np.ndarray


def laid_out(documents: list[np.ndarray], lanes: int, start_id: int) -> Lanes:
    """Lanes of nearly equal length: the longest documents first, each to the shortest lane."""
    import heapq

    lengths = np.array([len(document) for document in documents])
    free = [(0, lane) for lane in range(lanes)]
    lane_of, step_of = np.empty(len(documents), np.int64), np.empty(len(documents), np.int64)
    for at in np.argsort(-lengths, kind="stable").tolist():
        length, lane = free[0]
        lane_of[at], step_of[at] = lane, length
        heapq.heapreplace(free, (length + int(lengths[at]), lane))
    steps = max(length for length, _ in free)
    targets = np.full((steps, lanes), start_id, np.int32)
    inputs = np.full((steps, lanes), start_id, np.int32)
    starts, used = np.zeros((steps, lanes), bool), np.zeros((steps, lanes), bool)
    for at, document in enumerate(documents):
        lane, low = lane_of[at], step_of[at]
        targets[low : low + len(document), lane] = document
        inputs[low + 1 : low + len(document), lane] = document[:-1]
        starts[low, lane] = True
        used[low : low + len(document), lane] = True
    return Lanes(targets, inputs, starts, used, lane_of, step_of)


def train(w: Weights, documents: list[np.ndarray], layout: Layout, optimiser: Adam) -> None:
    """One pass over the documents, window by window, with the state carried from window to window."""
    words = sum(map(len, documents))
    lanes = int(np.clip(words // 4000, 4, MOST_LANES))
    # Fewer words in a window make noisier gradients: the steps get shorter by the square root.
    optimiser.share = float(np.sqrt(lanes / MOST_LANES))
    laid = laid_out(documents, lanes, 0)
    state = np.zeros((STATE, lanes), np.float32)
    for low in range(0, len(laid.targets), WINDOW):
        part = slice(low, low + WINDOW)
        state, run = forward(w, state, laid.inputs[part], laid.starts[part])
        optimiser.climb(
            gradients(w, run, laid.inputs[part], laid.targets[part], laid.starts[part], laid.used[part], layout)
        )


def score(w: Weights, documents: list[np.ndarray], layout: Layout) -> np.ndarray:
    """Natural log-likelihood of every whole document; its state is carried from window to window."""
    words = sum(map(len, documents))
    lanes = int(np.clip(words // 2000, 4, 512))
    laid = laid_out(documents, lanes, 0)
    state = np.zeros((STATE, lanes), np.float32)
    found = np.zeros(laid.targets.shape)
    for low in range(0, len(laid.targets), 2 * WINDOW):
        part = slice(low, low + 2 * WINDOW)
        state, run = forward(w, state, laid.inputs[part], laid.starts[part])
        found[part] = log_probabilities(w, in_line(run.states), laid.targets[part].ravel(), layout).reshape(
            found[part].shape
        )
    sums = np.cumsum(np.vstack([np.zeros((1, lanes)), found * laid.used]), axis=0)
    ends = laid.step_of + np.array([len(document) for document in documents])
    return sums[ends, laid.lane_of] - sums[laid.step_of, laid.lane_of]
