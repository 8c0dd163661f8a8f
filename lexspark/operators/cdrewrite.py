"""Context-dependent rewriting: phi becomes psi between lambda and rho.

Two passes over the string. From right to left, every place is marked from which phi and
then rho can be read, and every place where rho begins. From left to right, a transducer
follows the marks: at a place where phi begins and lambda stands before it, an obligatory
rule must rewrite one of phi's matches that end where rho begins; an optional one may.
Between rewrites symbols are copied. In left-to-right rules lambda is read on the output;
in right-to-left ones the strings are mirrored; in simultaneous ones it is read on the input.
"""

from __future__ import annotations

from .fst import EMPTY, Fst, as_fst, compose, concat, cross, determinize, explore, invert, project, reverse, rmepsilon, symbol

_PHI, _RHO = -2, -3


def _acceptor(x, what: str) -> Fst:
    f = as_fst(x)
    if not f.is_acceptor() or not f.is_unweighted():
        raise ValueError(f"{what} must be an unweighted acceptor")
    return f


def _ends(language: Fst, sigma: list[int]) -> tuple[int, list[dict[int, int]], set[int]]:
    """A complete deterministic machine that accepts after each string that ends in the language."""
    loop = Fst(0, (tuple((a, a, 0.0, 0) for a in sigma),), {0: 0.0})
    d = determinize(concat(loop, language))
    if d.start < 0:
        return 0, [dict.fromkeys(sigma, 0)], set()
    step = [{i: t for i, _, _, t in row} for row in d.arcs]
    return d.start, step, set(d.finals)


def _marks(rho: Fst, phi_rho: Fst, sigma: list[int]) -> Fst:
    """Puts PHI before every place from which phi and rho can be read, and then RHO where rho can be read."""
    r0, r_step, r_good = _ends(reverse(rho), sigma)
    p0, p_step, p_good = _ends(reverse(phi_rho), sigma)

    def expand(state):  # on the mirrored string: at a place RHO is said first, then PHI
        r, p, said = state
        if said == 0 and r in r_good:
            yield 0, _RHO, 0.0, (r, p, 1)
        elif said <= 1 and p in p_good:
            yield 0, _PHI, 0.0, (r, p, 2)
        else:
            for a in sigma:
                yield a, a, 0.0, (r_step[r][a], p_step[p][a], 0)

    def final(state):
        r, p, said = state
        return None if (said == 0 and r in r_good) or (said <= 1 and p in p_good) else 0.0

    return reverse(explore((r0, p0, 0), expand, final))


def cdrewrite(tau, left, right, sigma_star, direction: str = "ltr", mode: str = "obl") -> Fst:
    """tau: a transducer (or pair of strings) from phi to psi, which may be weighted; [BOS] and [EOS] may stand in contexts."""
    tau = cross(*tau) if isinstance(tau, tuple) else as_fst(tau)
    left, right, sigma_star = _acceptor(left, "the left context"), _acceptor(right, "the right context"), _acceptor(sigma_star, "sigma*")
    if direction not in ("ltr", "rtl", "sim") or mode not in ("obl", "opt"):
        raise ValueError("direction is ltr, rtl or sim; mode is obl or opt")
    bos, eos = symbol("BOS"), symbol("EOS")
    used = {bos, eos} if (left.labels() | right.labels()) & {bos, eos} else set()
    sigma = sorted((sigma_star.labels() | (tau.labels(0) | tau.labels(1)) - {bos, eos}) | used)
    if direction == "rtl":
        core = reverse(_one_way(reverse(tau), reverse(right), reverse(left), sigma, mode, False))
    else:
        core = _one_way(tau, left, right, sigma, mode, direction == "sim")
    if used:
        body = [a for a in sigma if a not in (bos, eos)]
        loop = Fst(0, (tuple((a, a, 0.0, 0) for a in body),), {0: 0.0})
        insert = lambda x: Fst(0, (((0, x, 0.0, 1),), ()), {1: 0.0})
        dress = concat(insert(bos), loop, insert(eos))
        core = compose(compose(dress, core), invert(dress))
    return rmepsilon(core)


def _one_way(tau: Fst, left: Fst, right: Fst, sigma: list[int], mode: str, on_input: bool) -> Fst:
    places = _marks(right, concat(_bare(project(tau, "input")), right), sigma)
    start, step, good = _ends(left, sigma)
    tau = rmepsilon(tau)

    def moved(at: int, i: int, o: int) -> int:
        label = i if on_input else o
        return step[at][label] if label else at

    def begin(at: int, met: int):
        """Into a rewrite, or past it: what an obligatory or optional rule lets happen where phi begins."""
        if at in good:
            yield 0, 0, 0.0, ("in", at, tau.start, 0, met)
        if at not in good or mode == "opt":
            yield 0, 0, 0.0, ("copy", at, 3 if met else 1)

    def expand(state):
        kind, at, *rest = state
        if kind == "copy":  # rest: 0 at a new place, 1 PHI met, 2 RHO met, 3 all met
            if rest[0] == 0:
                yield _PHI, 0, 0.0, ("phi", at)
            if rest[0] <= 1:
                yield _RHO, 0, 0.0, ("copy", at, 2)
            for a in sigma:
                yield a, a, 0.0, ("copy", step[at][a], 0)
        elif kind == "phi":
            yield from begin(at, 0)
        elif kind == "in":  # rest: state of tau, whether it has read anything, whether marks were met at this place
            t, read, met = rest
            for i, o, w, d in tau.arcs[t]:
                yield i, o, w, ("in", moved(at, i, o), d, 1 if i else read, 0 if i else met)
            yield _RHO, 0, 0.0, ("in", at, t, read, 1)
            if read:
                yield _PHI, 0, 0.0, ("in", at, t, read, 1)
            if t in tau.finals:
                if read and not met:
                    yield 0, 0, tau.finals[t], ("out", at)
                elif not read and met:  # phi was empty; rho begins here
                    yield 0, 0, tau.finals[t], ("copy", at, 3)
        elif kind == "out":  # after a rewrite rho must begin
            yield _RHO, 0, 0.0, ("copy", at, 3)
            yield _PHI, 0, 0.0, ("again", at)
        elif kind == "again":
            yield _RHO, 0, 0.0, ("next", at)
        else:
            yield from begin(at, 1)

    follow = explore(("copy", start, 0), expand, lambda state: 0.0 if state[0] == "copy" else None)
    return compose(places, follow) if places.start >= 0 and follow.start >= 0 else EMPTY


def _bare(f: Fst) -> Fst:
    return Fst(f.start, tuple(tuple((i, o, 0.0, d) for i, o, _, d in row) for row in f.arcs), dict.fromkeys(f.finals, 0.0))
