"""Removal of repeated byte strings: anchored suffixes, sorted by deep-shallow sorting in tasks that share an anchor."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm._common import NULL_ID, hot_keys, id_of, joined, kept, numbered, shuffle_partitions, slices, text_bytes

#: Bytes that an anchor hashes. Every string of `length` bytes holds the same anchor at the same place wherever it stands.
GRAM = 32
#: A text's anchors are looked for in pieces of so many windows.
PLACE_BITS = 24
PLACE = np.uint64((1 << PLACE_BITS) - 1)
#: Groups that agree on this many bytes more than they are known to go from multikey sorting to blind tries.
SHALLOW = 24
BLOCK = 20_000
ANCHOR = "h long, key long, nth long, a int"
#: kind 0: may stand alone; 1: the first of several in its task; 2: another of those, dealt by key in place of h.
DEALT = f"{ANCHOR}, kind byte"
SPANS = "key long, nth long, start int, stop int"
#: Of an anchor with too many contexts to hold, these go on with them in place of spans.
SPREAD = f"{SPANS}, a int, back int, near int, context binary"
#: A window's digest in two halves; spans have their key in place of the first, and no second.
WINDOWS = f"deal long, more long, {SPANS}"
CONTEXT = f"{ANCHOR}, back int, near int, context binary"
#: So many repeated anchors a task remembers; beyond that it forgets the older ones, and deals one row of them again.
TOLD = 1 << 16


def _gram_hashes(flat: np.ndarray) -> np.ndarray:
    h = flat.astype(np.uint64) + np.uint64(1)
    step = 1
    for by in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
        h = h[:-step] * np.uint64(by) + h[step:]
        step *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xE7037ED1A0B428DB)
    h ^= h >> np.uint64(29)
    return h


def anchors(flat: np.ndarray, offsets: np.ndarray, length: int, piece: int = 1 << (PLACE_BITS - 1)) -> tuple[np.ndarray, ...]:
    """(hash, text, place, first window, last window) of the anchors of texts flat[offsets[k]:offsets[k + 1]].

    A window is a string of `length` bytes within one text. Its anchor is the leftmost of its GRAM-byte strings of least hash; so
    equal windows have equal anchors, and neighbouring windows mostly share one. Windows are looked at `piece` at a time, so that a very
    long text needs no more memory than a piece.
    """
    found = []
    for begin in range(0, max(len(flat) - length + 1, 0), piece):
        part = flat[begin : begin + piece + length - 1]
        h = _gram_hashes(part)
        low = ((h >> np.uint64(PLACE_BITS)) << np.uint64(PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
        width, span = length - GRAM + 1, 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if width > span:
            low = np.minimum(low[: span - width], low[width - span :])
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.clip(offsets, begin, begin + len(part))))
        windows = np.flatnonzero(text[: len(low)] == text[length - 1 :])
        if not len(windows):
            continue
        at, of = (low[windows] & PLACE).astype(np.int64), text[windows]
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (of[1:] != of[:-1])]))
        last = np.append(new[1:], len(at)) - 1
        found.append((h[at[new]].view(np.int64), of[new], at[new] + begin, windows[new] + begin, windows[last] + begin))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    h, of, at, first, last = (np.concatenate(x) for x in zip(*found))
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (of[1:] != of[:-1])]))  # the same anchor at the edge of two pieces
    last = last[np.append(new[1:], len(at)) - 1]
    start = offsets[:-1][of[new]]
    return h[new], of[new], at[new] - start, first[new] - start, last - start


def anchor_kinds(h: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each anchor's kind (see DEALT), and told, the anchors that the task has dealt as repeated, with those of kind 1."""
    each, first, inverse, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    new = (counts > 1) & ~np.isin(each, told)
    kind = np.where(np.isin(each, told) | new, 2, 0).astype(np.int8)[inverse]
    kind[first[new]] = 1
    return kind, np.concatenate([told, each[new]]) if len(told) + new.sum() <= TOLD else each[new]


def _anchor_rows(length: int):
    """Texts come sorted by key, so a task that runs again deals its anchors alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.zeros(0, np.int64)
        for batch in slices(batches):
            h, of, a, _, _ = anchors(*text_bytes(batch.column("text")), length)
            keys = np.asarray(batch.column("key"))
            named = ~np.asarray(batch.column("is_copy"))[of]
            h, of, a = h[named], of[named], a[named]
            kind, told = anchor_kinds(h, told)
            columns = [pa.array(np.where(kind == 2, keys[of], h)), pa.array(keys[of]), batch.column("nth").take(pa.array(of)), pa.array(a.astype(np.int32)), pa.array(kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "key", "nth", "a", "kind"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by h, the places of those whose h another row has or is known to have. One row is held back, not a group."""
    held, last, alike = None, None, False
    for batch in batches:
        kind, batch_h = np.asarray(batch.column("kind")), np.asarray(batch.column("h"))
        places = batch.select(["key", "nth", "a"])
        yield places.filter(pa.array(kind == 2))
        asked = kind < 2
        h, several, places = batch_h[asked], kind[asked] == 1, places.filter(pa.array(asked))
        n = len(h)
        if not n:
            continue
        same = h[1:] == h[:-1]
        before = np.concatenate([[held is not None and h[0] == last], same])
        if held is not None and (alike or before[0]):
            yield held
        yield places.slice(0, n - 1).filter(pa.array(before[:-1] | same | several[:-1]))
        held, last, alike = places.slice(n - 1), h[-1], bool(before[-1] | several[-1])
    if held is not None and alike:
        yield held


def _of_row(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, pa.Array]:
    """What stands in each row's list, one after another, and the numbers of their rows."""
    lists = batch.column(column)
    return np.repeat(np.arange(batch.num_rows), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))), lists.flatten()


def _contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat, offsets = text_bytes(batch.column("text"))
            h, of, a, first, last = anchors(flat, offsets, length)
            rows, wanted = _of_row(batch, "anchors")
            here = np.isin((of << 32) | a, (rows << 32) | np.asarray(wanted))
            h, of, a, back, near = h[here], of[here], a[here], (a - first)[here], (a - last)[here]
            sizes = back + length - near
            ends = np.cumsum(sizes)
            for lo in range(0, len(h), 50_000):
                part = slice(lo, lo + 50_000)
                begin = ends[part] - sizes[part] - (ends[lo] - sizes[lo])
                bytes_at = np.repeat(offsets[:-1][of[part]] + a[part] - back[part] - begin, sizes[part]) + np.arange(sizes[part].sum())
                bounds = np.append(begin, sizes[part].sum()).astype(np.int32)
                context = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(flat[bytes_at].tobytes())])
                take = pa.array(of[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[part]), batch.column("key").take(take), batch.column("nth").take(take), *(pa.array(x[part].astype(np.int32)) for x in (a, back, near)), context],
                    names=["h", "key", "nth", "a", "back", "near", "context"],
                )

    return run


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """The order of strings of one length, and how much each has in common with the one before (0 for the first).

    The trie keeps only where its branches part, not what stands between. A string goes down blindly to some leaf, is compared with
    that one leaf, and joins at the branch where the two part.
    """
    width = len(strings[0])
    root: list = [width, {}, [0]]  # where it branches, its branches by byte, and the strings that end here
    for k, s in enumerate(strings[1:], 1):
        node = root
        while node[1]:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = strings[node[2][0]]
        if s == other:
            node[2].append(k)
            continue
        differ = int.from_bytes(s) ^ int.from_bytes(other)
        common = width - (differ.bit_length() + 7) // 8
        node = root
        while node[0] < common:
            node = node[1][s[node[0]]]
        if node[0] == common:
            node[1][s[common]] = [width, {}, [k]]
        else:
            old = node[:]
            node[0], node[1], node[2] = common, {other[common]: old, s[common]: [width, {}, [k]]}, []
    order: list[int] = []
    commons: list[int] = []
    stack: list[tuple[list, int]] = [(root, 0)]
    while stack:
        node, common = stack.pop()
        if node[1]:
            children = sorted(node[1].items(), reverse=True)
            stack += [(child, node[0]) for _, child in children[:-1]]
            stack.append((children[-1][1], common))
        else:
            order += node[2]
            commons += [common, *[width] * (len(node[2]) - 1)]
    return order, commons


def deep_shallow(rows: np.ndarray, group: np.ndarray, known: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte rows by (group, bytes), and how many bytes each has in common with the one before it: -1 where a group begins.

    Rows of a group agree on their first `known` bytes. Shallow: multikey quicksort, whose characters are 8 bytes here. A round splits
    all open groups at once, each around the character of its middle row, into those with a smaller, the same and a larger one; only
    those with the same go on to their next character. Deep: groups that still agree SHALLOW bytes later are ordered by a blind trie
    each, which compares a row with one other only.
    """
    n, width = rows.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = rows
    words = wide.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    heads = np.concatenate([[True], group[order][1:] != group[order][:-1]]) if n else np.zeros(0, bool)
    begins, depth = heads.copy(), np.full(n, known // 8)
    limit = min(words.shape[1], (known + SHALLOW) // 8)
    while True:
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.append(starts, n))
        is_open = (sizes > 1) & (depth[starts] < limit)
        if not is_open.any():
            break
        at = np.flatnonzero(np.repeat(is_open, sizes))
        segment = np.repeat(np.arange(len(starts)), sizes)[at]
        char = words[order[at], depth[at]]
        pivot = words[order[starts + sizes // 2], np.minimum(depth[starts], limit - 1)][segment]
        side = (char >= pivot).astype(np.int64) + (char > pivot)
        by = np.argsort(segment * 3 + side, kind="stable")
        order[at], side = order[at][by], side[by]
        depth[at] += side == 1
        begins[at[1:][(side[1:] != side[:-1]) & (segment[1:] == segment[:-1])]] = True
    common = np.full(n, width)
    for lo in range(1, n, 50_000):
        a, b = words[order[lo - 1 : lo - 1 + 50_000]][: n - lo], words[order[lo : lo + 50_000]]
        differ = a != b
        word = np.where(differ.any(axis=1), differ.argmax(axis=1), words.shape[1])
        inside = np.flatnonzero(word < words.shape[1])
        bits = (a ^ b)[inside, word[inside]]
        zero = sum((bits < np.uint64(1 << (8 * (8 - k)))).astype(np.int64) for k in range(1, 8))
        common[lo + inside] = 8 * word[inside] + zero
    common = np.where(heads, -1, np.minimum(common, width))
    if limit < words.shape[1]:
        raw = rows.tobytes()
        for a, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            members = order[a : a + size].tolist()
            by, commons = blind_trie([raw[k * width : (k + 1) * width] for k in members])
            order[a : a + size] = [members[k] for k in by]
            common[a + 1 : a + size] = commons[1:]
    return order, common


def _classes(order: np.ndarray, common: np.ndarray, length: int) -> np.ndarray:
    """For each row a number that rows share if they agree on their first `length` bytes (within a group)."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < length)
    return out


def repeated_windows(group: np.ndarray, rank: np.ndarray, back: np.ndarray, near: np.ndarray, contexts: list[bytes], length: int) -> np.ndarray:
    """[k, r]: whether the window that starts r bytes before anchor k also starts earlier at another anchor of its group.

    Suffixes from the anchor on and reversed prefixes before it are sorted; two windows are equal if their suffixes agree on
    length - r bytes and their prefixes on r, that is, if they are in one class of both orders. Earlier: of a smaller rank.
    """
    n, reach = len(group), length - GRAM
    right, left = np.zeros((n, length), np.uint8), np.zeros((n, max(reach, 1)), np.uint8)
    sizes = np.fromiter(map(len, contexts), np.int64, n)
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    row = np.repeat(np.arange(n), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) - back[row]
    after = place >= 0
    right[row[after], place[after]] = flat[after]
    left[row[~after], -1 - place[~after]] = flat[~after]
    to_right, to_left = deep_shallow(right, group, 0), deep_shallow(left, group)
    out = np.zeros((n, reach + 1), bool)
    for r in range(reach + 1):
        rows = np.flatnonzero((near <= r) & (r <= back))
        if len(rows) < 2:
            continue
        key = _classes(*to_right, length - r)[rows] * (n + 1) + _classes(*to_left, r)[rows]
        by = np.lexsort((rank[rows], key))
        again = np.flatnonzero(key[by][1:] == key[by][:-1]) + 1
        out[rows[by[again]], r] = True
    return out


def _told_apart(before: pa.RecordBatch | None, batch: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """Of rows sorted by anchor and context: those that differ from the row before, and those that are copies of it. before: the row before all."""
    rows = pa.Table.from_batches([before, batch] if before is not None else [batch]).combine_chunks()
    n = rows.num_rows
    same = np.ones(n - 1, bool)
    for f in ("h", "back", "near", "context"):
        same &= np.asarray(pa.compute.equal(rows.column(f).slice(1), rows.column(f).slice(0, n - 1)))
    copy = same if before is not None else np.concatenate([[False], same])
    return batch.filter(pa.array(~copy)), batch.filter(pa.array(copy))


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, context and place; those that are copies of a task's earlier row leave without their context.

    As all their bytes go, wherever the first one stands, they needn't meet their anchor's rows: they are dealt by key, not by h.
    """
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        first, copies = _told_apart(last, batch)
        last = batch.slice(batch.num_rows - 1)
        yield first
        if copies.num_rows:
            bare = copies.set_column(0, "h", copies.column("key"))
            yield bare.set_column(bare.num_columns - 1, "context", pa.nulls(bare.num_rows, pa.binary()))


def _spans(length: int, block: int = BLOCK):
    """Spans of rows sorted by anchor and context. Of an anchor with more than `block` different contexts, those go on as they are."""
    names = ["key", "nth", "start", "stop", "a", "back", "near", "context"]

    def out(*columns: np.ndarray) -> pa.RecordBatch:
        none = [*(pa.nulls(len(columns[0]), pa.int32()) for _ in range(3)), pa.nulls(len(columns[0]), pa.binary())]
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns[:2]), *(pa.array(c.astype(np.int32)) for c in columns[2:]), *none], names=names)

    def spread(rows: pa.RecordBatch) -> pa.RecordBatch:
        none = pa.nulls(rows.num_rows, pa.int32())
        return pa.RecordBatch.from_arrays([rows.column("key"), rows.column("nth"), none, none, *(rows.column(n) for n in names[4:])], names=names)

    def whole(rows: pa.RecordBatch) -> pa.RecordBatch:
        key, nth, a, back, near = (np.asarray(rows.column(n)) for n in ("key", "nth", "a", "back", "near"))
        return out(key, nth, a - back, a - near + length)

    def solved(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        h, doc, nth, a, back, near = (np.asarray(rows.column(n)) for n in ("h", "key", "nth", "a", "back", "near"))
        group = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]]))
        lone = np.bincount(group)[group] < 2
        k = np.flatnonzero(~lone)
        if not len(k):
            return out(doc[k], nth[k], k, k)
        rank = np.empty(len(k), np.int64)
        rank[np.lexsort((a[k], nth[k], doc[k]))] = np.arange(len(k))
        again = repeated_windows(group[k], rank, back[k], near[k], rows.column("context").take(pa.array(k)).to_pylist(), length)
        of, start, stop = _merged(again, a[k], length)
        return out(doc[k[of]], nth[k[of]], start, stop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, count, hot = None, [], 0, None
        for batch in batches:
            bare = batch.column("context").is_null()
            yield whole(batch.filter(bare))
            batch = batch.filter(pa.compute.invert(bare))
            if not batch.num_rows:
                continue
            first, copies = _told_apart(last, batch)
            last = batch.slice(batch.num_rows - 1)
            yield whole(copies)
            h = np.asarray(first.column("h"))
            if hot is not None and len(h):
                n = int(np.argmax(np.append(h != hot, True)))
                yield spread(first.slice(0, n))
                first, h = first.slice(n), h[n:]
                hot = None if len(h) else hot
            cut = np.flatnonzero(h[1:] != h[:-1]) + 1
            if held and len(h) and h[0] != held[-1].column("h")[held[-1].num_rows - 1].as_py():
                cut = np.concatenate([[0], cut])
            done = 0
            for c in cut.tolist():
                if count + c - done >= block:
                    yield solved([*held, first.slice(done, c - done)])
                    held, count, done = [], 0, c
            rest = first.slice(done)
            if rest.num_rows:
                held.append(rest)
                count += rest.num_rows
            if count > block and held:
                all_h = np.concatenate([np.asarray(x.column("h")) for x in held])
                n = count - int((all_h == all_h[-1]).sum())
                if count - n > block:
                    rows = pa.Table.from_batches(held)
                    if n:
                        yield solved(rows.slice(0, n).to_batches())
                    yield from map(spread, rows.slice(n).to_batches())
                    held, count, hot = [], 0, all_h[-1]
        if held:
            yield solved(held)

    return run


def _merged(again: np.ndarray, a: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) of the runs of windows r = 0, 1, .. that again[row] marks."""
    edge = np.diff(np.pad(again.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (of, r1), (_, r2) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    return of, a[of] - (r2 - 1), a[of] - r1 + length


def _windows(length: int):
    """Contexts to WINDOWS: each different window of a slice once, with its earliest place there, and the others of the slice as spans.

    Spans come sorted by key, nth and start; those of a batch that touch are joined.
    """
    names = [x.split()[0] for x in WINDOWS.split(", ")]

    def out(deal: np.ndarray, more: pa.Array, key: np.ndarray, nth: np.ndarray, start: np.ndarray, stop: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(deal), more, pa.array(key), pa.array(nth), pa.array(start.astype(np.int32)), stop], names=names)

    def joined(spans: pa.RecordBatch) -> pa.RecordBatch:
        key, nth, start, stop = (np.asarray(spans.column(n)) for n in ("key", "nth", "start", "stop"))
        text = np.cumsum(np.concatenate([[True], (key[1:] != key[:-1]) | (nth[1:] != nth[:-1])])[: len(key)])
        begin, reach = start + (text << 32), np.maximum.accumulate(stop + (text << 32))
        k = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]])[: len(key)])
        last = np.append(k[1:], len(key))[: len(k)] - 1
        return out(key[k], pa.nulls(len(k), pa.int64()), key[k], nth[k], start[k], pa.array((reach[last] - (text[last] << 32)).astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "context"):
            spans = batch.filter(batch.column("context").is_null())
            batch = batch.filter(batch.column("context").is_valid())
            yield joined(spans)
            if not batch.num_rows:
                continue
            key, nth, a, back, near = (np.asarray(batch.column(n)) for n in ("key", "nth", "a", "back", "near"))
            parts = [
                hashlib.blake2b(context[b - r : b - r + length], digest_size=16).digest()
                for context, b, n in zip(batch.column("context").to_pylist(), back.tolist(), near.tolist()) for r in range(n, b + 1)
            ]
            digest = np.frombuffer(b"".join(parts), np.int64).reshape(-1, 2)
            counts = back - near + 1
            of = np.repeat(np.arange(len(key)), counts)
            r = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts - near, counts)
            rank = np.empty(len(key), np.int64)
            rank[np.lexsort((a, nth, key))] = np.arange(len(key))
            by = np.lexsort((rank[of], digest[:, 1], digest[:, 0]))
            same = np.concatenate([[False], (digest[by][1:] == digest[by][:-1]).all(axis=1)])
            again = np.zeros((len(key), length - GRAM + 1), bool)
            again[of[by[same]], r[by[same]]] = True
            k, start, stop = _merged(again, a, length)
            yield out(key[k], pa.nulls(len(k), pa.int64()), key[k], nth[k], start, pa.array(stop.astype(np.int32)))
            w = by[~same]
            k = of[w]
            yield out(digest[w, 0], pa.array(digest[w, 1]), key[k], nth[k], a[k] - r[w], pa.nulls(len(k), pa.int32()))

    return run


def _later(length: int):
    """WINDOWS sorted by digest and place to spans: those that are there, and of each window all places but the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            spans = batch.column("more").is_null()
            names = ["key", "nth", "start", "stop"]
            yield batch.filter(spans).select(names)
            rows = batch.filter(pa.compute.invert(spans))
            if not rows.num_rows:
                continue
            digest = np.stack([np.asarray(rows.column("deal")), np.asarray(rows.column("more"))], axis=1)
            before = np.concatenate([digest[:1] if last is None else last, digest[:-1]])
            same = (digest == before).all(axis=1)
            same[0] &= last is not None
            last = digest[-1:]
            found = rows.filter(pa.array(same)).select(names)
            yield found.set_column(3, "stop", pa.array((np.asarray(found.column("start")) + length).astype(np.int32)))

    return run


def with_spans(docs: DataFrame, length: int = 100, block: int = BLOCK) -> DataFrame:
    """(key, nth, text, spans) of each row of docs (doc_id, text): spans is an array of (start, stop; -1: the end) of bytes to remove from
    it, which may overlap. Null if there are none.

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a document with a smaller doc_id, or before in
    the same one. Texts are taken as UTF-8; strings stay within a document.

    Whole copies of an earlier text go by their digest alone. For the others:

    1. Every text's anchors, a thirtieth of its bytes, are dealt by hash; those that stand alone go, as none of their strings repeats.
       Of those that a task has seen to repeat, one is dealt by hash for the other tasks to see, and the rest by key.
    2. The others meet their texts and get the bytes around them. Each task sorts its own so that equal ones follow each other: all of
       those but the first are copies, and only the first is dealt on to its anchor's rows, so that a passage which a third of all
       documents hold reaches its anchors' tasks about once per task, not once per document.
    3. There they are sorted again and copies told apart in the same way; different ones are held, one anchor's group at a time, for
       deep-shallow sorting. So copies are told apart by Spark's own sort; the tasks' sorting orders what differs.
    4. An anchor with more than `block` different contexts isn't held: they go on, dealt by document, as windows with 128-bit digests. Each
       slice deals a window once, by digest; where it meets others, all but the earliest go. So neither an anchor nor a window is one
       task's.

    Rows that repeat a doc_id are texts of that document one after another, in the order of a hash of their texts, then of the texts; each has
    its own number, and what is found for it is dealt by doc_id and that hash. Rows whose doc_id is null take no part. Null and empty texts, and those under
    `length` bytes, have no string. An empty table gives no row.
    """
    # the number has the part in its upper half, so that it is the row's own among those of its doc_id
    rows = numbered(docs.where("doc_id is not null")).select("key", "part", "text", (F.shiftleft(F.col("part").cast("long"), 32) + F.col("nth")).alias("nth"))
    parts = shuffle_partitions(docs.sparkSession)
    # kept by key and part alone, as the texts are; the number is compared beside them, so that no text is dealt again
    own = lambda x: (F.col("key") == x["_key"]) & (F.col("part") == x["_part"]) & (F.col("nth") - x["_nth"] == 0)
    of_part = F.shiftright("nth", 32).cast("int").alias("_part")
    beside = lambda x, *more: x.select(F.col("key").alias("_key"), of_part, F.col("nth").alias("_nth"), *more).repartition(parts, "_key", "_part")
    digests = kept(rows.where(F.octet_length("text") >= length).select("key", "nth", F.sha2("text", 256).alias("digest")))
    firsts = kept(digests.groupBy("digest").agg(F.min(F.struct("key", "nth")).alias("first"), F.count("*").alias("n")).where("n > 1"))
    copies = joined(digests, firsts.drop("n"), ["digest"], hot=hot_keys(firsts, ["digest"]))
    copies = kept(copies.where(F.struct("key", "nth") != F.col("first")).select("key", "nth"))
    of_key = beside(copies, F.lit(True).alias("is_copy"))
    told = rows.join(of_key, own(of_key), "left").select("key", "nth", "text", F.coalesce("is_copy", F.lit(False)).alias("is_copy"))
    found = told.mapInArrow(_anchor_rows(length), DEALT)
    again = found.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_repeated, "key long, nth long, a int")
    by_row = beside(again, "a").groupBy("_key", "_part", "_nth").agg(F.collect_list("a").alias("anchors"))
    around = rows.join(by_row, own(by_row)).select("key", "nth", "text", "anchors").mapInArrow(_contexts(length), CONTEXT)
    order = ("h", "back", "near", "context", "key", "nth", "a")
    fewer = around.sortWithinPartitions(*order).mapInArrow(_combined, CONTEXT)
    dealt = fewer.repartition(parts, "h").sortWithinPartitions(*order)
    solved = dealt.mapInArrow(_spans(length, block), SPREAD).repartition(parts, "key", "nth").sortWithinPartitions("key", "nth", "start")
    windows = solved.mapInArrow(_windows(length), WINDOWS).repartition(parts, "deal").sortWithinPartitions("deal", "more", "key", "nth", "start")
    spans = windows.mapInArrow(_later(length), SPANS)
    whole = copies.select("key", "nth", F.lit(0).alias("start"), F.lit(-1).alias("stop"))
    spans = beside(spans.union(whole), "start", "stop").groupBy("_key", "_part", "_nth").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    cut = rows.join(spans, own(spans), "left").select("key", "nth", "text", "spans")
    nameless = docs.where("doc_id is null").select(F.lit(NULL_ID).alias("key"), F.lit(1).cast("long").alias("nth"), F.coalesce("text", F.lit("")).alias("text"))
    return cut.unionByName(nameless, allowMissingColumns=True)


def _cut(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes, where each starts, and which bytes stay."""
    flat, offsets = text_bytes(batch.column("text"))
    of, found = _of_row(batch, "spans")
    change = np.zeros(len(flat) + 1, np.int32)
    start, stop = offsets[:-1][of] + np.asarray(found.field("start")), np.asarray(found.field("stop"))
    np.add.at(change, start, 1)
    np.add.at(change, np.where(stop < 0, offsets[1:][of], offsets[:-1][of] + stop), -1)
    return flat, offsets, np.cumsum(change[:-1]) <= 0


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        flat, offsets, stays = _cut(batch)
        kept = np.concatenate([[0], np.cumsum(stays)])[offsets]
        data = flat[stays].tobytes()
        gone = ~stays
        opens = gone & ~np.concatenate([[False], gone[:-1]]) if len(gone) else gone
        begin = offsets[:-1][np.diff(offsets) > 0]
        opens[begin] = gone[begin]
        spans = np.diff(np.concatenate([[0], np.cumsum(opens)])[offsets])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key"), pa.array(np.diff(offsets)), pa.array(np.diff(offsets) - np.diff(kept)), pa.array(spans.astype(np.int64)),
                pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(kept[:-1], kept[1:])], pa.string()),
            ],
            names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def span_digests(docs: DataFrame, length: int = 100, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row: its bytes, those removed, their maximal runs, the rest's digest.

    Null and empty texts have no byte; see with_spans for repeated rows and null doc_ids."""
    found = with_spans(docs, length, block).mapInArrow(_digests, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return found.select(id_of(F.col("key")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        flat, offsets, stays = _cut(batch)
        kept = np.concatenate([[0], np.cumsum(stays)])[offsets]
        data = flat[stays].tobytes()
        texts = [data[a:b].decode("utf-8", "ignore") for a, b in zip(kept[:-1], kept[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], names=["key", "text"])


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, text) of each row of docs with repeated bytes cut out; the rest of a character that is cut in two goes as well.

    A null text becomes empty; see with_spans for repeated rows and null doc_ids."""
    return with_spans(docs, length).mapInArrow(_texts, "key long, text string").select(id_of(F.col("key")).alias("doc_id"), "text")
