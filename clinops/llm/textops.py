"""Array helpers used inside tasks: words, rolling hashes and group boundaries on Arrow batches.

A text is its UTF-8 bytes.  Words are maximal runs of bytes outside ``20 09-0D`` (hex), which is the
same as ``[^\\x20\\x09-\\x0D]+`` on characters, because no multi-byte character contains those bytes.
Null texts count as empty.  Memory per call follows ``CHUNK`` or the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20  # bytes of text handled at once (a longer text is its own chunk)

_SEP = np.zeros(256, dtype=bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True

_MUL = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Runs are hashed as polynomials modulo two primes below 2**31, 62 bits together.  (Modulo 2**64 a polynomial hash
#: has pairs of unequal runs that collide under every base.)
_PRIMES = (2147483647, 2147483629)
_BASES = (1103515245, 1597334677)
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _cumulative(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo the prime, by doubling."""
    out = np.ones(n, dtype=np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done += more
    return out


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each prime the powers of its base and of the base's inverse, at least ``n`` of each."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, CHUNK + 1)
        _POWERS[:] = [(_cumulative(b, p, size), _cumulative(pow(b, -1, p), p, size)) for b, p in zip(_BASES, _PRIMES)]
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64), so that every output bit depends on every input bit."""
    out = x >> np.uint64(30)  # the steps below work in place: fresh arrays cost more than the arithmetic
    out ^= x
    out *= np.uint64(0xBF58476D1CE4E5B9)
    high = out >> np.uint64(27)
    out ^= high
    out *= np.uint64(0x94D049BB133111EB)
    out ^= np.right_shift(out, np.uint64(31), out=high)
    return out


def prefix_hash(values: np.ndarray) -> list[np.ndarray]:
    """Running sums that ``span_hash`` and ``rolling_hash`` turn into hashes of runs of ``values``."""
    n, out = len(values), []
    for (pw, _), prime in zip(powers(n + 1), _PRIMES):
        p = np.uint64(prime)
        term = values.astype(np.uint64)
        if values.dtype != np.uint8:
            term %= p
        term += np.uint64(1)
        term *= pw[:n]
        term %= p
        total = np.zeros(n + 1, dtype=np.uint64)  # terms are below 2**31: no overflow before 2**33 of them
        np.cumsum(term, out=total[1:])
        out.append(total)
    return out


def _run_hash(sums: list[np.ndarray], inverse: list[np.ndarray]) -> np.ndarray:
    """Both residues of runs as one number; ``sums`` are overwritten."""
    for s, inv, prime in zip(sums, inverse, _PRIMES):
        s %= np.uint64(prime)
        s *= inv
        s %= np.uint64(prime)
    sums[0] <<= np.uint64(31)
    sums[0] |= sums[1]
    return sums[0]


def span_hash(prefix: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inverse = [inv[start] for _, inv in powers(len(prefix[0]))]
    h = _run_hash([x[end] - x[start] for x in prefix], inverse)
    h += (end - start).astype(np.uint64) * _MUL
    return mix(h)


def rolling_hash(prefix: list[np.ndarray], width: int) -> np.ndarray:
    """Hash of every ``width``-long run; entry ``i`` starts at ``i``."""
    n = len(prefix[0]) - width
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    return mix(_run_hash([x[width:] - x[:n] for x in prefix], [inv[:n] for _, inv in powers(len(prefix[0]))]))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width``-long run by doubling: O(n log width), no Python loop over positions."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[: len(x) - done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of each row in the bytes) in pieces of about CHUNK."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offs = offs[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + CHUNK, side="right")) - 1)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def word_bounds(buf: np.ndarray, offs: np.ndarray, gap: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row the index of its first word (one extra at the end);
    ``gap`` marks the byte values between words."""
    word = ~gap[buf]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    cut = offs[1:-1]
    cut = cut[cut < len(buf)]
    begin[cut] = word[cut]
    starts = np.flatnonzero(begin)
    after = np.ones(len(buf), dtype=bool)
    after[:-1] = begin[1:] | ~word[1:]
    inner = cut[cut > 0]
    after[inner - 1] = True
    ends = np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(buf), starts, ends)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words, ignoring row limits."""
    return rolling_hash(prefix_hash(words), width)


def window_rows(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, row) of every window of ``width`` words that stays inside one row."""
    count = np.maximum(np.diff(first) - width + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    return ranges(first[:-1], count), row


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... count[0] times, then the same for the next."""
    total = int(count.sum())
    shift = np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    return np.arange(total) + shift


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as maximal spans in ascending order."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), dtype=bool)
    new[1:] = start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return start[at], reach[np.concatenate((at[1:] - 1, [len(start) - 1]))]


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the undirected edges (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (jump := label[label]).tobytes() != label.tobytes():
            label = jump
        live = label[a] != label[b]
        a, b = a[live], b[live]
    return label


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables cut between groups of the (sorted, integer) key columns, with the first row of each group
    and the row count at the end.  Holds one group and one batch at a time."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        new = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
        for k in keys:
            v = table.column(k).to_numpy()
            new |= v[1:] != v[:-1]
        return np.flatnonzero(new) + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and all(batch.column(k)[batch.num_rows - 1].equals(held[0].column(k)[0]) for k in keys):
            held.append(batch)
            continue
        table = pa.Table.from_batches([*held, batch])
        at = cut(table)
        last = int(at[-1]) if len(at) else 0
        if last:
            yield table.slice(0, last), np.concatenate(([0], at))
        held = table.slice(last).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.concatenate(([0], cut(table), [table.num_rows]))


def binary_column(rows: np.ndarray) -> pa.Array:
    """One fixed-width binary value per row of a 2-D array."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * rows.shape[1]
    offs = (np.arange(len(rows) + 1, dtype=np.int64) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offs), pa.py_buffer(rows)])


def pack_texts(column: pa.Array) -> pa.Array:
    """Each text on its own as a zstd frame (null stays null): less than half of what a shuffle moves otherwise."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1).compress
    return pa.array([press(t.as_buffer().to_pybytes()) if t.is_valid else None for t in column], pa.binary())


def unpack_texts(column: pa.Array) -> list[bytes | None]:
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    return [open_(t.as_buffer().to_pybytes()) if t.is_valid else None for t in column]


def needed_pieces(z: pa.Array, need: pa.Array, start: str, size: str, more: int = 0) -> tuple[pa.Array, pa.StructArray]:
    """Byte pieces (``size + more`` bytes from ``start``) that a list column asks of each packed text, with the
    asking structs in the same order."""
    asked = need.flatten()
    at, n = asked.field(start).to_numpy(), asked.field(size).to_numpy() + more
    count = np.diff(np.frombuffer(need.buffers()[1], np.int32)[need.offset : need.offset + len(need) + 1])
    pieces, k = [], 0
    for body, c in zip(unpack_texts(z), count.tolist()):
        pieces += [body[a : a + b] for a, b in zip(at[k : k + c].tolist(), n[k : k + c].tolist())]
        k += c
    return pa.array(pieces, pa.binary()), asked
