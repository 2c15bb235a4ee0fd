"""Weighted finite-state transducers over the symbols of a clause, and their composition.

A transducer has states, and for each state and symbol read one arc: the next
state, the symbol written, and a weight.  ``compose`` joins two of them into
one whose states are pairs and whose weights multiply.  A clause is read by
three compositions in turn, forwards, backwards and forwards again, so that a
mark can follow from what stands before it or after it:

1. negation, then report: what follows "not" within three words, or a reporting
   verb, is marked;
2. (backwards) report, then target: what a reporting verb follows is marked, the
   speaker ("he said") is no target, and what a target follows is marked;
3. target, then score: what stands behind a target is marked, and insults and
   threats get their weights.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

KINDS = 8
NONE, INSULT, TARGET, NEGATION, REPORT, THREAT = range(6)
NEGATED, REPORTED, TARGETED = 8, 16, 32  # marks, added to a kind
SYMBOLS = 64
SCOPE = 3  # words that a negation reaches

# Weights of the arcs that write an insult or a threat.
PLAIN_INSULT, TARGETED_INSULT, TARGETED_THREAT, NEGATED_SHARE, REPORTED_SHARE = 1.0, 1.5, 2.0, 0.4, 0.4


@dataclass(frozen=True)
class Transducer:
    """Arcs by (state, symbol read); state 0 is the first, and a clause may end in any state."""

    next: np.ndarray
    out: np.ndarray
    weight: np.ndarray

    def read(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Symbols written and weights for all clauses [start, start + length), read side by side, a symbol of each at a time."""
        out, weight = symbols.copy(), np.ones(len(symbols))
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        state = np.zeros(len(start), np.int64)
        for t in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -t, "left"))  # clauses with more than t symbols
            at = start[:n] + (length[:n] - 1 - t if backwards else t)
            seen = symbols[at]
            out[at], weight[at] = self.out[state[:n], seen], self.weight[state[:n], seen]
            state[:n] = self.next[state[:n], seen]
        return out, weight


def transducer(states: int, arc: Callable[[int, int, int], tuple[int, int, int, float]]) -> Transducer:
    """From (state, kind, marks) to (next state, kind, marks, weight)."""
    nxt, out, weight = np.zeros((states, SYMBOLS), np.int64), np.zeros((states, SYMBOLS), np.int64), np.ones((states, SYMBOLS))
    for s in range(states):
        for x in range(SYMBOLS):
            nxt[s, x], kind, marks, weight[s, x] = arc(s, x % KINDS, x - x % KINDS)
            out[s, x] = kind + marks
    return Transducer(nxt, out, weight)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """What b makes of what a writes, as one transducer."""
    n, m = len(a.next), len(b.next)
    first, second = np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
    written = a.out[first]
    return Transducer(a.next[first] * m + b.next[second[:, None], written], b.out[second[:, None], written], a.weight[first] * b.weight[second[:, None], written])


def _negation(left: int, kind: int, marks: int) -> tuple[int, int, int, float]:
    if kind in (INSULT, THREAT) and left:
        marks |= NEGATED
    return (SCOPE if kind == NEGATION else max(0, left - 1)), kind, marks, 1.0


def _report(seen: int, kind: int, marks: int) -> tuple[int, int, int, float]:
    if kind in (INSULT, THREAT) and seen:
        marks |= REPORTED
    return int(seen or kind == REPORT), kind, marks, 1.0


def _report_behind(state: int, kind: int, marks: int) -> tuple[int, int, int, float]:
    """State 1 is right before a reporting verb: a target there speaks, and an insult names the speaker."""
    if kind == REPORT:
        return 1, kind, marks, 1.0
    if state == 1 and kind == TARGET:
        return 2, NONE, marks, 1.0
    if state == 2 and kind in (INSULT, THREAT):
        marks |= REPORTED
    return (2 if state else 0), kind, marks, 1.0


def _target(seen: int, kind: int, marks: int) -> tuple[int, int, int, float]:
    if kind in (INSULT, THREAT) and seen:
        marks |= TARGETED
    return int(seen or kind == TARGET), kind, marks, 1.0


def _score(state: int, kind: int, marks: int) -> tuple[int, int, int, float]:
    if kind == INSULT:
        weight = TARGETED_INSULT if marks & TARGETED else PLAIN_INSULT
    elif kind == THREAT:
        weight = TARGETED_THREAT if marks & TARGETED else 0.0
    else:
        weight = 0.0
    return 0, kind, marks, weight * (NEGATED_SHARE if marks & NEGATED else 1.0) * (REPORTED_SHARE if marks & REPORTED else 1.0)


NEGATION_RULE, REPORT_RULE, REPORT_BEHIND_RULE = transducer(SCOPE + 1, _negation), transducer(2, _report), transducer(3, _report_behind)
TARGET_RULE, SCORE_RULE = transducer(2, _target), transducer(1, _score)
FORWARDS = compose(NEGATION_RULE, REPORT_RULE)
BACKWARDS = compose(REPORT_BEHIND_RULE, TARGET_RULE)
SCORED = compose(TARGET_RULE, SCORE_RULE)


def read_clauses(symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marked symbols and arc weights of all clauses."""
    marked, _ = FORWARDS.read(symbols, start, length)
    marked, _ = BACKWARDS.read(marked, start, length, backwards=True)
    return SCORED.read(marked, start, length)
