"""Command line: ``python -m tesserae.cli bound | bound-real-valued | accuracy``.

Every command makes records, one a result, and prints them as an aligned table,
as tab-separated values or as JSON lines (``--as``).
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys
from collections.abc import Callable, Iterable, Sequence
from typing import Any

from tesserae.functions.bounds import guaranteed_accuracy, sample_size, sample_size_real_valued
from tesserae.functions.invariants import NAMED

Record = dict[str, Any]


def curvature_sizes(a: argparse.Namespace) -> Iterable[Record]:
    """Tuples for the curvature measure, or for one Lipschitz invariant if a constant differs from 1."""
    span = a.lip if a.span is None else a.span
    by = "Corollary 6.3" if a.lip == span == 1 else "Corollary 6.5"
    n = sample_size(a.epsilon, a.alpha, a.n, a.p, lip=a.lip, lam=span, method=a.method)
    yield {"statement": by, "points": a.n, "order": a.p, "lipschitz": a.lip, "range": span, "method": a.method, "confidence": a.alpha, "accuracy": a.epsilon, "tuples": n}


def real_sizes(a: argparse.Namespace) -> Iterable[Record]:
    """Tuples for one invariant with real values."""
    n = sample_size_real_valued(a.epsilon, a.alpha, a.p, lam=a.span)
    yield {"statement": "Proposition 6.6", "order": a.p, "range": a.span, "confidence": a.alpha, "accuracy": a.epsilon, "tuples": n}


def accuracies(a: argparse.Namespace) -> Iterable[Record]:
    """What a number of tuples guarantees, a record an invariant."""
    for g in guaranteed_accuracy(a.tuples, [NAMED[k] for k in a.invariants or NAMED], a.p, alpha=a.alpha).values():
        yield dataclasses.asdict(g)


def cell(value: Any) -> str:
    return f"{value:,}" if isinstance(value, int) else f"{value:.6g}" if isinstance(value, float) else str(value)


def as_table(records: Sequence[Record]) -> Iterable[str]:
    rows = [list(records[0]), *([cell(v) for v in r.values()] for r in records)]
    widths = [max(map(len, column)) for column in zip(*rows)]
    for row in rows:
        yield "  ".join(x.ljust(w) for x, w in zip(row, widths)).rstrip()


def as_tsv(records: Sequence[Record]) -> Iterable[str]:
    yield "\t".join(records[0])
    yield from ("\t".join(map(str, r.values())) for r in records)


FORMS: dict[str, Callable[[Sequence[Record]], Iterable[str]]] = {"table": as_table, "tsv": as_tsv, "json": lambda records: map(json.dumps, records)}

#: Command: its records, and the options it takes beside those of all commands.
COMMANDS: dict[str, tuple[Callable[[argparse.Namespace], Iterable[Record]], list[tuple[list[str], dict[str, Any]]]]] = {
    "bound": (
        curvature_sizes,
        [
            (["-n", "--n"], {"type": int, "default": 4}),
            (["-e", "--epsilon"], {"type": float, "default": 0.1}),
            (["-L", "--lipschitz"], {"type": float, "default": 1.0, "dest": "lip"}),
            (["--lambda"], {"type": float, "dest": "span"}),
            (["--method"], {"choices": ["WB", "MD", "Markov"], "default": "WB"}),
        ],
    ),
    "bound-real-valued": (real_sizes, [(["-e", "--epsilon"], {"type": float, "default": 0.1}), (["--lambda"], {"type": float, "default": 1.0, "dest": "span"})]),
    "accuracy": (accuracies, [(["-N", "--n-samples"], {"type": float, "required": True, "dest": "tuples"}), (["invariants"], {"nargs": "*", "choices": list(NAMED), "metavar": "INVARIANT"})]),
}


def parsed(argv: Sequence[str] | None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="tesserae", description="Accuracies are in diameters of the space; each record holds at its confidence by itself.")
    below = top.add_subparsers(dest="command", required=True)
    for name, (records, options) in COMMANDS.items():
        p = below.add_parser(name, help=records.__doc__, formatter_class=argparse.ArgumentDefaultsHelpFormatter)
        for flags, how in [(["-p", "--p"], {"type": float, "default": 2.0}), (["-a", "--alpha"], {"type": float, "default": 0.999}), (["--as"], {"choices": list(FORMS), "default": "table", "dest": "form"}), *options]:
            p.add_argument(*flags, **how)
    return top.parse_args(argv)


def main(argv: Sequence[str] | None = None) -> int:
    a = parsed(argv)
    for line in FORMS[a.form](list(COMMANDS[a.command][0](a))):
        sys.stdout.write(line + "\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
