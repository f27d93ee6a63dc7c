"""A linear-chain conditional random field with two labels, trained by maximum likelihood.

Scores: a weight per feature for label 1, and a weight per pair of labels for neighbours in the same element and in
different ones.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np

Chain = tuple[list[list[str]], list[bool]]


class Model(NamedTuple):
    weights: dict[str, float]
    #: [same element][label before][label]
    steps: list


def fit(chains: list[Chain], labels: list[list[int]], rounds: int = 200, rate: float = .3, decay: float = 1e-3,
        least: int = 3) -> Model:
    """Gradient ascent (Adam) on the penalised likelihood; features seen in fewer than `least` chains are left out."""
    seen = Counter(name for features, _ in chains for name in {n for block in features for n in block})
    names = sorted(name for name, n in seen.items() if n >= least)
    number = {name: no for no, name in enumerate(names)}
    # Longest first: the chains that reach a place are then the first ones.
    order = sorted((row for row in range(len(labels)) if labels[row]), key=lambda row: -len(labels[row]))
    chains, labels = [chains[row] for row in order], [labels[row] for row in order]
    if not chains:
        return Model({}, np.zeros((2, 2, 2)).tolist())
    ends = np.array([len(x) for x in labels]) - 1
    size = ends[0] + 1
    alive = [int((ends >= no).sum()) for no in range(size)]
    truth, same = np.zeros((2, len(chains), size), int)
    mask = np.arange(size) <= ends[:, None]
    places, columns = [], []
    for row, ((features, joined), wanted) in enumerate(zip(chains, labels, strict=True)):
        truth[row, :len(wanted)], same[row, :len(wanted)] = wanted, joined
        for no, block in enumerate(features):
            found = [number[name] for name in block if name in number]
            places += [row * size + no] * len(found)
            columns += found
    places, columns = np.array(places, int), np.array(columns, int)
    seen_moves = np.zeros((2, 2, 2))
    np.add.at(seen_moves, (same[:, 1:], truth[:, :-1], truth[:, 1:]), mask[:, 1:])
    params = np.zeros(len(names) + 8)
    first, second = np.zeros_like(params), np.zeros_like(params)
    for turn in range(1, rounds + 1):
        scores = np.bincount(places, params[columns], mask.size).reshape(mask.shape)
        one, moves = expected(scores, same, ends, alive, params[len(names):].reshape(2, 2, 2))
        slope = np.append(np.bincount(columns, ((truth - one) * mask).ravel()[places], len(names)), (seen_moves - moves).ravel())
        slope = slope / len(chains) - decay * params
        first, second = .9 * first + .1 * slope, .99 * second + .01 * slope ** 2
        params += rate * (first / (1 - .9 ** turn)) / (np.sqrt(second / (1 - .99 ** turn)) + 1e-8)
        rate *= .99
    return Model({name: float(params[no]) for name, no in number.items()}, params[len(names):].reshape(2, 2, 2).tolist())


def expected(scores: np.ndarray, same: np.ndarray, ends: np.ndarray, alive: list[int],
             steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of label 1 in every place, and the expected pairs of neighbours' labels, by forward and backward sums."""
    rows, size = scores.shape
    own = np.stack([np.zeros_like(scores), scores], axis=2)
    ahead, back = own.copy(), np.zeros((rows, size, 2))
    for no in range(1, size):
        k = alive[no]
        joint = ahead[:k, no - 1, :, None] + steps[same[:k, no]]
        ahead[:k, no] += np.logaddexp(joint[:, 0], joint[:, 1])
    for no in range(size - 2, -1, -1):
        k = alive[no + 1]
        joint = steps[same[:k, no + 1]] + (own[:k, no + 1] + back[:k, no + 1])[:, None, :]
        back[:k, no] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
    last = ahead[np.arange(rows), ends]
    total = np.logaddexp(last[:, 0], last[:, 1])
    one = np.exp(np.minimum(ahead[:, :, 1] + back[:, :, 1] - total[:, None], 0))
    moves = np.zeros((2, 2, 2))
    for no in range(1, size):
        k = alive[no]
        joint = (ahead[:k, no - 1, :, None] + steps[same[:k, no]] + (own[:k, no] + back[:k, no])[:, None, :]
                 - total[:k, None, None])
        np.add.at(moves, same[:k, no], np.exp(joint))
    return one, moves


def decode(chain: Chain, model: Model) -> list[int]:
    """The likeliest labels (Viterbi); ties go to label 0."""
    features, same = chain
    if not features:
        return []
    weights, steps = model
    zero, one, came = 0.0, 0.0, []
    for no, block in enumerate(features):
        score = sum(weights.get(name, 0.0) for name in block)
        if not no:
            zero, one = 0.0, score
            continue
        (a, b), (c, d) = steps[same[no]]
        to_zero, to_one = zero + a >= one + c, zero + b >= one + d
        came.append((0 if to_zero else 1, 0 if to_one else 1))
        zero, one = max(zero + a, one + c), max(zero + b, one + d) + score
    out = [0 if zero >= one else 1]
    for move in reversed(came):
        out.append(move[out[-1]])
    return out[::-1]
