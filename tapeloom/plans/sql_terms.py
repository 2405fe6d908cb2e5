"""SQL text of the declarative shape terms."""

from __future__ import annotations


def _n(x: float) -> str:
    return f"({float(x)!r}::double)"


def _ramp(x: str, lo: float, hi: float) -> str:
    return f"greatest(0.0e0, least(1.0e0, ({x} - {_n(lo)}) / {_n(hi - lo)}))"


def term_sql(t: tuple) -> str:
    kind, x, *p = t
    if kind in ("most", "least", "product", "ratio"):
        parts = [term_sql(y) for y in (x, *p)]
        if kind in ("most", "least"):
            return f"{'greatest' if kind == 'most' else 'least'}({', '.join(parts)})"
        return "(" + (" * " if kind == "product" else " / ").join(parts) + ")"
    if kind == "none":
        return f"(case when {any_sql((x, *p))} then 0.0e0 else 1.0e0 end)"
    if kind == "value":
        return _n(x)
    if kind == "steps":
        cases = [f"when {x} between {_n(a)} and {_n(b)} then greatest(0.0e0, least(1.0e0, {_n(v)} + ({x} - {_n(a)}) * {_n(s)}))" for a, b, v, s in p]
        return f"(case {' '.join(cases)} else 0.0e0 end)"
    if kind == "abs":
        return f"abs({x})"
    if kind == "ramp":
        return _ramp(x, *p)
    if kind == "fall":
        return f"(1 - {_ramp(x, *p)})"
    if kind == "down":
        return _ramp(f"(-({x}))", *p)
    if kind == "band":
        lo, hi, soft = p
        return f"(case when {x} between {_n(lo)} and {_n(hi)} then 1.0e0 when {x} < {_n(lo)} then greatest(0.0e0, 1 - ({_n(lo)} - {x}) / {_n(soft)}) else greatest(0.0e0, 1 - ({x} - {_n(hi)}) / {_n(soft)}) end)"
    if kind == "in":
        return f"(case when {x} between {p[0]} and {p[1]} then 1.0e0 else 0.0e0 end)"
    return f"({x})"


def profile_sql(terms: list[tuple]) -> str:
    return "(" + " + ".join(term_sql(t) for t in terms) + f") / {len(terms)}"


def finding_sql(f: tuple) -> str:
    name, op, limit = f
    return f"{name} {op} {_n(limit)}"


def any_sql(groups) -> str:
    """Whether all findings of one of the groups hold."""
    return "(" + " or ".join("(" + " and ".join(finding_sql(f) for f in group) + ")" for group in groups) + ")"
