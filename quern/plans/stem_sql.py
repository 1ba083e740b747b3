"""Porter's stems in DuckDB SQL, written for itself so that the Python ones can be checked against it."""

from __future__ import annotations

from quern.functions.stem import IRREGULAR, STEP2, STEP3, STEP4

_CONSONANTS = "bcdfghjklmnpqrstvwxz"


def _shape(w: str) -> str:
    """c and v for the letters of w; a y takes its kind from the letter before it, so the kinds spread from the left."""
    out = f"translate({w}, 'aeiou{_CONSONANTS}', '{'v' * 5 + 'c' * len(_CONSONANTS)}')"
    out = f"regexp_replace({out}, '^y', 'c')"
    for _ in range(5):
        out = f"replace(replace({out}, 'cy', 'cv'), 'vy', 'vc')"
    return out


def _more(s: str, n: int) -> str:
    """Whether the shape s holds more than n vowel-consonant turns."""
    return f"regexp_matches({s}, '{'v+c+' * n + 'v+c'}')"


def _cut(k: int) -> tuple[str, str]:
    """w and its shape without the last k letters."""
    return f"left(w, length(w) - {k})", f"left(s, length(s) - {k})"


def _short_end(w: str, s: str) -> str:
    return f"((regexp_matches({s}, 'cvc$') and right({w}, 1) not in ('w', 'x', 'y')) or {s} = 'vc')"


def _past(k: int) -> str:
    """w without an -ed or -ing of k letters."""
    w, s = _cut(k)
    double = f"(length({w}) > 1 and right({w}, 1) = left(right({w}, 2), 1) and right({s}, 1) = 'c')"
    return (
        f"case when not contains({s}, 'v') then w when right({w}, 2) in ('at', 'bl', 'iz') then {w} || 'e' when {double} then case when right({w}, 1) in ('l', 's', 'z') then {w} else left(w, length(w) - {k + 1}) end "
        f"when {_more(s, 0)} and not {_more(s, 1)} and {_short_end(w, s)} then {w} || 'e' else {w} end"
    )


def _ends(table: dict[str, str]) -> str:
    """The longest ending of w that the table holds, replaced where something is measured before it."""
    out = []
    for end in sorted(table, key=len, reverse=True):
        w, s = _cut(len(end))
        out.append(f"when suffix(w, '{end}') then case when {_more(s, 0)} then {w} || '{table[end]}' else w end")
    return f"case {' '.join(out)} else w end"


def stems(source: str) -> str:
    """CTEs behind which st(term, stem) holds a stem for every term of the relation `source`."""
    steps = [
        "case when suffix(w, 'ies') then left(w, length(w) - 3) || case when length(w) = 4 then 'ie' else 'i' end when suffix(w, 'sses') then left(w, length(w) - 2) when suffix(w, 's') and not suffix(w, 'ss') then left(w, length(w) - 1) else w end",
        f"case when suffix(w, 'ied') then left(w, length(w) - 3) || case when length(w) = 4 then 'ie' else 'i' end when suffix(w, 'eed') then case when {_more(_cut(3)[1], 0)} then left(w, length(w) - 1) else w end "
        f"when suffix(w, 'ed') then {_past(2)} when suffix(w, 'ing') then {_past(3)} else w end",
        "case when suffix(w, 'y') and length(w) > 2 and left(right(s, 2), 1) = 'c' then left(w, length(w) - 1) || 'i' else w end",
        f"case when suffix(w, 'alli') and {_more(_cut(4)[1], 0)} then left(w, length(w) - 2) else w end",
        f"case when suffix(w, 'logi') then case when {_more(_cut(3)[1], 0)} then left(w, length(w) - 1) else w end else {_ends(STEP2)} end",
        _ends(STEP3),
        "case "
        + " ".join(
            f"when suffix(w, '{e}') then case when {_more(_cut(len(e))[1], 1)}" + (f" and right({_cut(3)[0]}, 1) in ('s', 't')" if e == "ion" else "") + f" then {_cut(len(e))[0]} else w end" for e in sorted(STEP4, key=len, reverse=True)
        )
        + " else w end",
        f"case when suffix(w, 'e') and ({_more(_cut(1)[1], 1)} or ({_more(_cut(1)[1], 0)} and not {_short_end(*_cut(1))})) then left(w, length(w) - 1) else w end",
        f"case when suffix(w, 'll') and {_more(_cut(1)[1], 1)} then left(w, length(w) - 1) else w end",
    ]
    out = [f"p0 as (select term, term as w, {_shape('term')} as s from {source} where length(term) > 2)"]
    for k, step in enumerate(steps):
        out.append(f"p{k}w as (select term, {step} as w from p{k})")
        out.append(f"p{k + 1} as (select term, w, {_shape('w')} as s from p{k}w)")
    odd = ", ".join(f"('{a}', '{b}')" for a, b in IRREGULAR.items())
    out.append(f"odd(term, stem) as (values {odd})")
    out.append(f"st as (select v.term, coalesce(odd.stem, p.w, v.term) as stem from {source} v left join odd using (term) left join p{len(steps)} p using (term))")
    return ", ".join(out)
