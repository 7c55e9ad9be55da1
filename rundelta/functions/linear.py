"""Small dense linear algebra as SQL over arrays of arrays, and normal variates of hashes.

Each function returns SQL text.  Matrices are expressions of ``array<array<double>>`` of ``k`` rows; ``k`` names the
column or variable with their number.
"""

from __future__ import annotations

#: How far covariances are drawn to their diagonals, in turn, until they are positive definite.
SHRINK = (0.0, 1e-8, 1e-6, 1e-4, 0.01, 0.1, 0.5, 1.0)
TINY = "1e-300D"


def let(name: str, value: str, then: str) -> str:
    """``then`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def _dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (du, dv) -> du * dv), 0D, (du, dv) -> du + dv)"


def cholesky(m: str, k: str) -> str:
    """The lower factor, rows up to the diagonal; a pivot that is not positive is 0."""
    row = (
        f"aggregate(sequence(0, ci), cast(array() as array<double>), (cr, cj) -> concat(cr, array(if(cj < ci, "
        f"(cm[ci][cj] - {_dot('cr', 'slice(cl[cj], 1, size(cr))')}) / greatest(cl[cj][cj], {TINY}), "
        f"sqrt(greatest(cm[ci][ci] - {_dot('cr', 'cr')}, 0D))))))"
    )
    return let("cm", m, f"aggregate(sequence(0, {k} - 1), cast(array() as array<array<double>>), (cl, ci) -> concat(cl, array({row})))")


def _substituted(factor: str, b: str, k: str) -> str:
    """The solution of L L' x = b."""
    forth = f"aggregate(sequence(0, {k} - 1), cast(array() as array<double>), (fv, fi) -> concat(fv, array(({b}[fi] - {_dot('fv', f'slice({factor}[fi], 1, fi)')}) / greatest({factor}[fi][fi], {TINY}))))"
    back = f"aggregate(sequence({k} - 1, 0, -1), cast(array() as array<double>), (bv, bi) -> concat(array((ff[bi] - {_dot('bv', f'transform(slice({factor}, bi + 2, {k} - 1 - bi), bl -> bl[bi])')}) / greatest({factor}[bi][bi], {TINY})), bv))"
    return let("ff", forth, back)


def solved(m: str, b: str, k: str) -> str:
    return let("sl", cholesky(m, k), let("sb", b, _substituted("sl", "sb", k)))


def inverse(m: str, k: str) -> str:
    unit = f"transform(sequence(0, {k} - 1), ur -> if(ur = uc, 1D, 0D))"
    return let("il", cholesky(m, k), f"transform(sequence(0, {k} - 1), uc -> {let('ub', unit, _substituted('il', 'ub', k))})")


def positive(m: str, k: str) -> str:
    """A covariance as it is if it is positive definite, else drawn to its diagonal by the first of ``SHRINK`` that makes it so."""
    drawn = "transform(pm, (pr, pi) -> transform(pr, (pv, pj) -> if(pi = pj, pv, pv * (1D - ps))))"
    pivots = let("pl", cholesky("pd", k), f"array_min(transform(pl, (pr, pi) -> pr[pi] * pr[pi] / greatest(pd[pi][pi], {TINY}))) > 1e-10D")
    tried = ", ".join(f"{s!r}D" for s in SHRINK)
    diagonal = let("ps", "1D", drawn)
    chosen = let("pc", f"filter(transform(array({tried}), ps -> {drawn}), pd -> {pivots})", f"if(size(pc) > 0, element_at(pc, 1), {diagonal})")
    return let("pm", m, chosen)


def uniform(arguments: str) -> str:
    """A number in (0, 1) from a hash of its arguments."""
    return f"((cast(pmod(xxhash64({arguments}), 9007199254740992L) as double) + 0.5D) / 9007199254740992D)"


def normal(arguments: str) -> str:
    return f"(sqrt(-2D * ln({uniform(arguments + ', 0')})) * cos(6.283185307179586D * {uniform(arguments + ', 1')}))"
