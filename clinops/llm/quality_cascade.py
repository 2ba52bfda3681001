"""Quality rules as a short-circuit cascade.

Each rule rejects a document or lets it pass.  On a bounded sample (``sample_rows`` documents with the
smallest id hashes) every rule is run alone to measure its cost (seconds per document) and selectivity
(share rejected); rules then run in descending order of rejections per second, each only on the documents
that no earlier rule rejected.  The order changes the work, never the verdict.

Defined cases: a null or empty text has no words and fails the base test; repeated rows are judged alike;
very long texts are judged whole (memory follows the longest single text); other columns are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinops.llm import textops as T
from clinops.llm.common import prepare

WINDOW = 8
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0x100)]] = True


@dataclass
class Piece:
    """Some whole texts of a batch, with what the rules share."""

    buf: np.ndarray
    offs: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offs[1:]] - total[self.offs[:-1]]

    def per_word(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return total[self.first[1:]] - total[self.first[:-1]]

    def text(self, row: int) -> bytes:
        return self.buf[self.offs[row] : self.offs[row + 1]].tobytes()


def word_chars(p: Piece) -> np.ndarray:
    return p.per_row(~T._SEP[p.buf] & ((p.buf & 0xC0) != 0x80))


def symbols(p: Piece) -> np.ndarray:
    return p.per_row(_SYMBOL[p.buf])


def lines(text: bytes) -> list[bytes]:
    """\\n-split lines that hold a word."""
    return [x for x in text.split(b"\n") if x and not x.isspace()]


def dup_lines(p: Piece) -> np.ndarray:
    out = np.zeros(len(p.offs) - 1, dtype=np.int64)
    for i in range(len(out)):
        held = lines(p.text(i))
        out[i] = len(held) - len(set(held))
    return out


def repeat_words(p: Piece) -> np.ndarray:
    """Words inside ``WINDOW``-word windows that occur at least twice in the text, first one included."""
    h = T.window_hashes(T.word_hashes(p.buf, p.starts, p.ends), WINDOW)
    at, row = T.window_rows(p.first, WINDOW)
    if not len(at):
        return np.zeros(len(p.offs) - 1, dtype=np.int64)
    key = h[at]
    order = np.lexsort((key, row))
    same = (key[order][1:] == key[order][:-1]) & (row[order][1:] == row[order][:-1])
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(p.starts) + 1, dtype=np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + WINDOW, -1)
    return p.per_word(np.cumsum(edge[:-1]) > 0)


# --- rules: rejected rows of a piece -------------------------------------------------------------

def many_symbols(p: Piece) -> np.ndarray:
    return 10 * symbols(p) > p.n_words


def odd_word_length(p: Piece) -> np.ndarray:
    """Mean word length below 2 or above 15 characters."""
    c = word_chars(p)
    return (c < 2 * p.n_words) | (c > 15 * p.n_words)


def few_letters(p: Piece) -> np.ndarray:
    """Fewer than 70 % of the words hold a letter."""
    total = np.concatenate(([0], np.cumsum(_LETTER[p.buf], dtype=np.int64)))
    return 10 * p.per_word(total[p.ends] > total[p.starts]) < 7 * p.n_words


def repeated_lines(p: Piece) -> np.ndarray:
    """More than 30 % of the lines equal an earlier one."""
    held = np.array([len(lines(p.text(i))) for i in range(len(p.offs) - 1)], dtype=np.int64)
    return 10 * dup_lines(p) > 3 * held


def one_word_rules(p: Piece) -> np.ndarray:
    """One word makes up more than a third of a text of 20 words or more."""
    h = T.word_hashes(p.buf, p.starts, p.ends)
    row = np.repeat(np.arange(len(p.offs) - 1), p.n_words)
    order = np.lexsort((h, row))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    at = np.flatnonzero(new)
    most = np.zeros(len(p.offs) - 1, dtype=np.int64)
    if len(at):
        np.maximum.at(most, row[order][at], np.diff(np.concatenate((at, [len(order)]))))
    return (3 * most > p.n_words) & (p.n_words >= 20)


def bullet_lines(p: Piece) -> np.ndarray:
    """More than 90 % of at least three lines begin with a bullet."""
    out = np.zeros(len(p.offs) - 1, dtype=bool)
    for i in range(len(out)):
        held = lines(p.text(i))
        marked = sum(x.lstrip().startswith((b"- ", b"* ", "•".encode())) for x in held)
        out[i] = len(held) >= 3 and 10 * marked > 9 * len(held)
    return out


RULES: dict[str, Callable[[Piece], np.ndarray]] = {
    f.__name__: f for f in (many_symbols, odd_word_length, few_letters, repeated_lines, one_word_rules, bullet_lines)
}


def pieces(column: pa.Array) -> Iterator[Piece]:
    for _, _, buf, offs in T.text_chunks(column):
        yield Piece(buf, offs, *T.word_bounds(buf, offs))


def subset(p: Piece, rows: np.ndarray) -> Piece:
    """The same piece with only some of its rows."""
    if len(rows) == len(p.offs) - 1:
        return p
    size = p.offs[rows + 1] - p.offs[rows]
    offs = np.concatenate(([0], np.cumsum(size)))
    words = T.ranges(p.first[rows], p.n_words[rows])
    shift = np.repeat(offs[:-1] - p.offs[rows], p.n_words[rows])
    first = np.concatenate(([0], np.cumsum(p.n_words[rows])))
    return Piece(p.buf[T.ranges(p.offs[rows], size)], offs, p.starts[words] + shift, p.ends[words] + shift, first)


def plan_cascade(sample: pa.Array, rules: dict[str, Callable] = RULES) -> list[tuple[str, float, float]]:
    """(rule, seconds per document, share rejected), in the order to run."""
    held = list(pieces(sample))
    n = max(1, sum(len(p.offs) - 1 for p in held))
    found = []
    for name, rule in rules.items():
        began = time.perf_counter()
        rejected = sum(int(rule(p).sum()) for p in held)
        found.append((name, max(time.perf_counter() - began, 1e-9) / n, rejected / n))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[0]))


def cascade(p: Piece, order: list[str]) -> np.ndarray:
    """Rows that no rule rejects; each rule sees only the rows still in."""
    alive = np.arange(len(p.offs) - 1)
    for name in order:
        if not len(alive):
            break
        alive = alive[~RULES[name](subset(p, alive))]
    kept = np.zeros(len(p.offs) - 1, dtype=bool)
    kept[alive] = True
    return kept


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 1000) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    prepare(docs.sparkSession)
    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = ids.select("id").orderBy(F.xxhash64("id"), "id").limit(sample_rows).distinct()
    sample = ids.join(chosen, "id", "left_semi").select("text").limit(sample_rows).toArrow().column("text")
    order = [name for name, _, _ in plan_cascade(sample.combine_chunks())]

    def run(batches):
        for batch in batches:
            ids, done = batch.column("id"), 0
            for p in pieces(batch.column("text")):
                n, words, repeated = len(p.offs) - 1, p.n_words, repeat_words(p)
                failed = (words < 20) | (100 * repeated > 30 * words)
                kept = np.zeros(n, dtype=bool)
                rest = np.flatnonzero(~failed)
                kept[rest] = cascade(subset(p, rest), order)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(done, n), *map(pa.array, (words, word_chars(p), symbols(p), dup_lines(p), repeated,
                                                         failed, kept))],
                    ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])
                done += n

    kind = dict(ids.dtypes)["id"]
    return ids.mapInArrow(run, f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                               "n_repeat_words long, base_failed boolean, kept boolean")
