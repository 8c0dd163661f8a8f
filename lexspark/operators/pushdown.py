"""Pushdown transducers: rules with matched parentheses on one stack or on several."""

from __future__ import annotations

from .fst import Fst, compose, explore, paths, reverse

MOST = 32


def pairs_of(parens) -> list[tuple[int, int]]:
    """(push, pop) label pairs, from a list or from the pairs of a transducer."""
    return [(i[0], o[0]) for i, o, _ in paths(parens)] if isinstance(parens, Fst) else [tuple(p) for p in parens]


def stacks_of(assignments, pairs: list[tuple[int, int]]) -> dict[int, int]:
    """The stack of each push label; all on one without assignments."""
    if assignments is None:
        return {p: 0 for p, _ in pairs}
    found = [(i[0], int(bytes(o).decode()) - 1) for i, o, _ in paths(assignments)] if isinstance(assignments, Fst) else [(a, b) for a, b in assignments]
    return dict(found)


def expand(f: Fst, parens, assignments=None, most: int = MOST, keep: bool = False) -> Fst:
    """The same strings without parentheses: states carry their stacks, at most ``most`` deep. keep: leaves them in as labels.

    With several stacks, reading is restricted: a pop may touch only the first stack that isn't empty.
    """
    pairs = pairs_of(parens)
    stack_of = stacks_of(assignments, pairs)
    push, pop = {a: a for a, _ in pairs}, {b: a for a, b in pairs}
    n = max(stack_of.values(), default=0) + 1

    def step(state):
        s, stacks = state
        for i, o, w, d in f.arcs[s]:
            label = i if i in push or i in pop else o
            if label in push:
                k = stack_of[label]
                if len(stacks[k]) >= most:
                    raise ValueError(f"a stack grows beyond {most}: the rule isn't bounded, or needs a larger bound")
                yield i if keep else 0, o if keep else 0, w, (d, stacks[:k] + (stacks[k] + (label,),) + stacks[k + 1 :])
            elif label in pop:
                k = stack_of[pop[label]]
                if stacks[k] and stacks[k][-1] == pop[label] and not any(stacks[:k]):
                    yield i if keep else 0, o if keep else 0, w, (d, stacks[:k] + (stacks[k][:-1],) + stacks[k + 1 :])
            else:
                yield i, o, w, (d, stacks)

    def final(state):
        s, stacks = state
        return f.finals[s] if s in f.finals and not any(stacks) else None

    return explore((f.start, ((),) * n), step, final) if f.start >= 0 else f


def compose_with(a: Fst, f: Fst, parens, assignments=None) -> Fst:
    """A string or lattice through a pushdown rule; parentheses read nothing from it."""
    labels = {x for p in pairs_of(parens) for x in p}
    free = Fst(f.start, tuple(tuple((0 if i in labels else i, i if i in labels else o, w, d) for i, o, w, d in row) for row in f.arcs), f.finals)
    return expand(compose(a, free), parens, assignments)


def compose_expanded(a: Fst, b: Fst, parens, assignments=None, left: bool = False) -> Fst:
    """Composition with a pushdown rule on the right, or on the left."""
    if left:
        return compose(expand(a, parens, assignments), b)
    return compose_with(a, b, parens, assignments)


def reversed_rule(f: Fst, parens) -> tuple[Fst, list[tuple[int, int]]]:
    """The mirrored rule, with pushes and pops exchanged."""
    return reverse(f), [(b, a) for a, b in pairs_of(parens)]


def replace_to_rule(root: Fst, parts: dict[int, Fst], first: int) -> tuple[Fst, list[tuple[int, int]]]:
    """A recursive network as one pushdown rule: each call pushes a label of its own, from ``first`` on."""
    from .fst import Builder, connect

    b = Builder()
    bases = {None: b.add(root)} | {k: b.add(f) for k, f in parts.items()}
    made: list[tuple[int, int]] = []
    every = [(bases[None], root), *((bases[k], f) for k, f in parts.items())]
    for base, f in every:
        for s, row in enumerate(f.arcs):
            kept = []
            for i, o, w, d in row:
                if o in parts:
                    push = first + 2 * len(made)
                    made.append((push, push + 1))
                    kept.append((push, push, w, parts[o].start + bases[o]))
                    for e, v in parts[o].finals.items():
                        b.rows[e + bases[o]].append((push + 1, push + 1, v, d + base))
                else:
                    kept.append((i, o, w, d + base))
            b.rows[s + base] = kept + [a for a in b.rows[s + base] if a[0] >= first]
    b.start = root.start + bases[None]
    b.finals = {s + bases[None]: w for s, w in root.finals.items()}
    return connect(b.done()), made
