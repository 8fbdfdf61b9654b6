"""Quality rules as a short-circuit cascade.

The rules are measured on a bounded sample (cost in seconds, share rejected)
and put in the order of rejections per second, each next rule judged on what
the ones before it leave. A document then meets the rules in that order and
leaves at the first that rejects it, so a costly rule runs only on the
survivors of the cheap ones. The order never changes a verdict.

Defined cases: a null text has no words and counts as empty; an empty text is
rejected by the word-count rule; repeated rows are judged one by one; an empty
table gives an empty table; the other columns pass through untouched.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm._common import CONTINUATION, as_bytes, schema_of, text_sample

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: From this many words on, windows are ranked in arrays instead of a set.
LONG = 50_000


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def repeated_words(words: list[bytes]) -> int:
    """Words covered by 8-word windows that occur at least twice in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    if n < LONG:
        windows: list | np.ndarray = list(zip(*(words[k : k + n] for k in range(WINDOW))))
        if len(set(windows)) == n:
            return 0
        ids: dict = {}
        windows = np.fromiter((ids.setdefault(w, len(ids)) for w in windows), np.int64, n)
    else:
        ids = {}
        windows = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        width = 1
        while width < WINDOW:  # a window of twice the width is a pair of ranks: exact
            windows = _ranks(windows[:-width] * (int(windows.max()) + 1) + windows[width:])
            width *= 2
    twice = np.bincount(windows)[windows] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


class Document:
    """Measures of one text, each computed when a rule first asks for it."""

    def __init__(self, text: bytes) -> None:
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(b"".join(self.words).translate(None, CONTINUATION))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @cached_property
    def n_stutters(self) -> int:
        """Words equal to the one before."""
        return sum(map(bytes.__eq__, self.words, self.words[1:]))

    @cached_property
    def n_shouts(self) -> int:
        return sum(w.endswith(b"!!") for w in self.words)

    @cached_property
    def n_bare(self) -> int:
        """Words of ASCII punctuation only."""
        return sum(map(bool, map(_BARE, self.words)))


_BARE = re.compile(rb"[!-/:-@\[-`{-~]+").fullmatch


@dataclass(frozen=True)
class Rule:
    """Rejects a document when ``rejects`` is true. ``base`` marks the contract's own rules."""

    name: str
    rejects: Callable[[Document], bool]
    base: bool = False


def _few(d: Document) -> bool:
    return d.n_words < 20


def _repeats(d: Document) -> bool:
    return 100 * d.n_repeat_words > 30 * d.n_words


def _symbols(d: Document) -> bool:
    return 10 * d.n_symbols > 3 * d.n_words


def _lines(d: Document) -> bool:
    return 100 * d.n_dup_lines > 60 * len(d.lines)


def _shouts(d: Document) -> bool:
    return 100 * d.n_shouts > 30 * d.n_words


def _bare(d: Document) -> bool:
    return 100 * d.n_bare > 40 * d.n_words


def _stutters(d: Document) -> bool:
    return 100 * d.n_stutters > 20 * d.n_words


#: Production rules. Thresholds leave a wide margin to running prose.
RULES = (
    Rule("few_words", _few, base=True),
    Rule("repeated_windows", _repeats, base=True),
    Rule("symbols", _symbols),
    Rule("duplicate_lines", _lines),
    Rule("shouting", _shouts),
    Rule("bare_marks", _bare),
)
#: Rules of the pipeline: those of the report, whose verdict its SQL fixes, and one for runs too short to repeat a window.
CORPUS_RULES = (*RULES, Rule("stutter", _stutters))
#: Documents measured to order the rules; only the order depends on them.
SAMPLE_ROWS = 400


def ordered(rules: tuple[Rule, ...], texts: list[bytes]) -> list[tuple[Rule, float, float]]:
    """Rules with ``(seconds a document, share rejected)``, by rejections per second.

    Both figures are of the documents which the rules placed before leave. The
    split into words is common to all rules and not charged to any.
    """
    left, rest, out = list(texts), list(rules), []
    while rest:
        measured = []
        for k, rule in enumerate(rest):
            spent, hit = 0.0, []
            for text in left:
                d = Document(text)
                d.n_words  # noqa: B018
                began = time.perf_counter()
                hit.append(rule.rejects(d))
                spent += time.perf_counter() - began
            n = max(len(left), 1)
            measured.append((-(sum(hit) / n) / max(spent / n, 1e-9), spent / n, k, hit))
        _, cost, k, hit = min(measured, key=lambda m: m[:3])
        out.append((rest.pop(k), cost, sum(hit) / max(len(left), 1)))
        left = [t for t, h in zip(left, hit) if not h]
    return out


def plan_cascade(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 1) -> list[tuple[Rule, float, float]]:
    """Order ``rules`` on at most ``sample_rows`` rows of ``df``, drawn by hash over all of it; texts beyond 64 KiB are not measured."""
    return ordered(rules, [t.encode() for t in text_sample(df, text, sample_rows, seed=seed)])


def first_rejecting(d: Document, rules: list[Rule]) -> str | None:
    return next((r.name for r in rules if r.rejects(d)), None)


def quality_filter(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``df`` that no rule rejects, with the same columns."""
    order = [r for r, _, _ in plan_cascade(df, rules, text, sample_rows)]
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([first_rejecting(Document(t), order) is None for t in as_bytes(b.column(at))], pa.bool_()))

    return df.mapInArrow(run, df.schema)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_report(df: DataFrame, id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``df``: id, the base measures, ``base_failed`` and ``kept``.

    The measures are part of the report and so taken of every document; the
    remaining rules run as a cascade on those that the base rules pass.
    """
    order = [r for r, _, _ in plan_cascade(df, rules, text, sample_rows)]
    base, rest = [r for r in rules if r.base], [r for r in order if not r.base]
    fields = [(id_col, df.schema[id_col].dataType.simpleString()), *((m, "long") for m in MEASURES), ("base_failed", "boolean"), ("kept", "boolean")]
    names = [n for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = [Document(t) for t in as_bytes(b.column(1))]
            cols = [pa.array([getattr(d, m) for d in docs], pa.int64()) for m in MEASURES]
            failed = [first_rejecting(d, base) is not None for d in docs]
            kept = [not f and first_rejecting(d, rest) is None for d, f in zip(docs, failed)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())], names=names)

    return df.select(id_col, text).mapInArrow(run, schema_of(fields))

