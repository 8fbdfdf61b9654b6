"""SQL fragments of the oracles: hashed draws, distances and invariants."""

from __future__ import annotations

from tesserae.functions.invariants import distance_name, pairs


def word(seed: int, slot: int, t: str = "t", again: int = 0) -> str:
    """60 bits for a slot of tuple ``t``; ``again``: of a further try."""
    more = f" || ':{again}'" if again else ""
    return f"('0x' || substr(md5('{seed}:' || {t} || ':{slot // 2}'{more}), {16 * (slot % 2) + 1}, 15))::BIGINT"


def reduced(seed: int, slot: int, size: str, t: str = "t") -> str:
    """Uniform on [0, size): words beyond the largest multiple of ``size`` are drawn anew, three words in all."""
    limit = f"({1 << 60}::BIGINT - {1 << 60}::BIGINT % ({size}))"
    tries = " ".join(f"WHEN {word(seed, slot, t, k)} < {limit} THEN {word(seed, slot, t, k)}" for k in range(2))
    return f"(CASE {tries} ELSE {word(seed, slot, t, 2)} END % ({size}))"


def uniform(seed: int, n: int, samples: int, size: str, start: int = 0) -> str:
    """Tuples of uniform draws; ``size``: SQL of the number of points."""
    cols = ", ".join(f"{reduced(seed, k, 'size')} AS i{k}" for k in range(n))
    return f"SELECT t, {cols} FROM range({start}, {start + samples}) r(t), (SELECT ({size})::BIGINT AS size)"


def joined(draws: str, points: str, used: list[int]) -> str:
    """Tuples joined to the table ``points`` (pid, ...) as p0, p1, ..."""
    return f"({draws}) d " + " ".join(f"JOIN {points} p{k} ON p{k}.pid = d.i{k}" for k in used)


def hamming(a: str, b: str, names: list[str]) -> str:
    return "(" + " + ".join(f"({a}.{c} <> {b}.{c})::INT" for c in names) + ")::DOUBLE"


def distances(draws: str, points: str, n: int, names: list[str], wanted: list[tuple[int, int]] | None = None) -> str:
    """``t, d01, ...`` by Hamming distance over the columns ``names``."""
    wanted = wanted or pairs(n)
    used = sorted({k for p in wanted for k in p})
    cols = ", ".join(f"{hamming(f'p{a}', f'p{b}', names)} AS {distance_name(a, b)}" for a, b in wanted)
    return f"SELECT t, {cols} FROM {joined(draws, points, used)}"


DEFICIT = "(list_sort([d01 + d23, d02 + d13, d03 + d12])[3] - list_sort([d01 + d23, d02 + d13, d03 + d12])[2]) / 2.0::DOUBLE"


def persistence(n: int) -> tuple[str, str]:
    """Birth and death of n points as SQL."""
    around = [", ".join(distance_name(min(i, j), max(i, j)) for j in range(n) if j != i) for i in range(n)]
    birth = "greatest(" + ", ".join(f"list_sort([{x}])[{n - 2}]" for x in around) + ")"
    death = "least(" + ", ".join(f"list_sort([{x}])[{n - 1}]" for x in around) + ")"
    return f"CASE WHEN {birth} < {death} THEN {birth} ELSE 0.0::DOUBLE END", f"CASE WHEN {birth} < {death} THEN {death} ELSE 0.0::DOUBLE END"
