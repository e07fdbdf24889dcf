"""Fuzzy line dedup: MinHash over character shingles, banding, exact check.

Lines are the runs between line feeds that aren't blank. Every distinct line
gets 125 MinHash values of its 5-character shingles, in 25 bands of 5: at a
Jaccard similarity of 0.8 a pair shares a band with probability 0.99995. One
changed character costs up to 5 shingles of each line, so lines from 49
characters on are still similar then.

Lines of one language often share a band without being similar. Before any
text is compared, a line's number of shingles and a bit map of them bound the
similarity from above (a bit that only one of two lines has stands for a
shingle that the other lacks), and lines without a possible partner go. The others are
compared exactly (``linking``), links are united, and of each component only
the first line (smallest document id, then place) stays.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanbook.llm.arrowtext import SPACES, _odd_constants, mix64, row_chunks, span_hashes, utf8
from loanbook.llm.linking import checked, hub_groups, united
from loanbook.llm.tables import forget, kept, map_arrow, only, ship, unused

SHINGLE = 5
BANDS, ROWS = 25, 5
#: shingles hashed at a time
CACHED = 1 << 17
#: groups of at most so many members are compared pair by pair, many groups at
#: once (larger ones by marks; no effect on results), and so many keys at a time
FEW, LOOKED_UP = 8, 1 << 18
#: bit maps of pairs compared at a time
MAPS_AT_ONCE = 1 << 15
PERCENT = 80
#: bytes of text handled at a time (few enough for the processor's cache), entries
#: sorted at a time in a task, and buckets of entries for each part of the input
TEXT_BYTES, SORTED, BUCKETS_EACH = 1 << 17, 1 << 20, 4
#: lines of a task with one band key beyond which all but two are sent on without a count
ALIKE = 8
#: 64-bit words of a line's bit map
MAP_WORDS = 16
#: members of a key whose bit maps are held and compared (those of larger keys all go on)
MOST_MAPS = 1 << 14
_MULTIPLY = (_odd_constants(101, BANDS * ROWS) & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
_ADD = (_odd_constants(202, BANDS * ROWS) >> np.uint64(32)).astype(np.uint32)
_CHARS = _odd_constants(303, 8)


def _lines(data: np.ndarray, off: np.ndarray):
    """(starts, ends, document, number in the document) of the lines with
    characters other than white space. Numbers count all line feeds before."""
    feeds = np.flatnonzero(data == 0x0A)
    many = np.diff(np.searchsorted(feeds, off)) + 1
    doc = np.repeat(np.arange(len(many)), many)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    starts = np.sort(np.concatenate([off[:-1], feeds + 1]), kind="stable")
    ends = np.sort(np.concatenate([feeds, off[1:]]), kind="stable")
    full = ends > starts
    full[full] = ~SPACES[data[starts[full]]]
    odd = np.flatnonzero((ends > starts) & ~full)  # lines that begin with white space
    if len(odd):
        size = ends[odd] - starts[odd]
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(starts[odd] - first, size)
        full[odd] = np.logical_or.reduceat(~SPACES[data[at]], first)
    return starts[full], ends[full], doc[full], number[full]


def char_shingles(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the character shingles of all lines in order, first of each
    line). A line shorter than a shingle is one shingle; no line is empty."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    begin = np.cumsum(size) - size
    g = points[:max(0, len(points) - width + 1)]
    for k in range(1, width):  # polynomial hashes of 2, 3, ... characters
        g = g * _CHARS[0] + points[k:k + len(g)]
    many = np.maximum(size - width + 1, 1)
    first = np.cumsum(many) - many
    at = np.arange(int(many.sum())) + np.repeat(begin - first, many)
    short = np.flatnonzero(size < width)
    at[first[short]] = 0  # filled below
    h = g[at] if len(g) else np.zeros(len(at), np.uint64)
    for k in short.tolist():
        own = points[begin[k]:begin[k] + size[k]]
        h[first[k]] = (own * _CHARS[:len(own)]).sum() ^ np.uint64(len(own))
    return mix64(h), first


#: bits of a shingle hash kept where a number stands beside it in one 64-bit key,
#: and the lines sorted together (few enough for the processor's cache)
HASH_BITS, SORTED_LINES = 48, 128


def line_sets(lines: list[str], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (48 bits) of each line."""
    out = []
    for a in range(0, len(lines), SORTED_LINES):
        some = lines[a:a + SORTED_LINES]
        h, first = char_shingles(some, width)
        row = np.repeat(np.arange(len(some), dtype=np.uint64), np.diff(np.append(first, len(h))))
        key = (row << np.uint64(HASH_BITS)) | (h >> np.uint64(64 - HASH_BITS))
        key.sort()
        key = key[np.append(True, key[1:] != key[:-1])]
        border = np.searchsorted(key, np.arange(1, len(some), dtype=np.uint64) << np.uint64(HASH_BITS))
        out += np.split(key & np.uint64((1 << HASH_BITS) - 1), border)
    return out


def _signatures(lines: list[str]) -> np.ndarray:
    """Band hashes (line, band) of MinHash signatures."""
    least = np.empty((BANDS * ROWS, len(lines)), np.uint32)
    border = np.cumsum([0, *map(len, lines)])
    a = 0
    while a < len(lines):  # a few lines at a time stay in the processor's cache
        b = max(a + 1, int(np.searchsorted(border, border[a] + CACHED, "right")) - 1)
        h, at = char_shingles(lines[a:b], SHINGLE)
        own = (h >> np.uint64(32)).astype(np.uint32)
        v = np.empty_like(own)
        for k in range(BANDS * ROWS):
            np.bitwise_xor(own, _ADD[k], out=v)
            np.multiply(v, _MULTIPLY[k], out=v)
            least[k, a:b] = np.minimum.reduceat(v, at)
        a = b
    least = least.reshape(BANDS, ROWS, len(lines))
    v = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(lines), axis=1)
    for r in range(ROWS):
        v = mix64(v * np.uint64(0x9E3779B97F4A7C15) + least[:, r])
    return np.ascontiguousarray(v.T)


def counted_links(nodes: list[int], roots: list[int], sides: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between the probes (side 1 or 2) and the stored sets (side 0 or
    2) of different roots: a probe marks its shingles, one pass over all sets
    counts the marks of each. A single probe looks the shingles of the sets
    up in its own instead."""
    root, side, size = np.array(roots), np.array(sides), np.array([len(s) for s in sets])
    probes = np.flatnonzero(side > 0)
    if len(probes) == 1:
        own, i = sets[probes[0]], int(probes[0])
        least, most = np.minimum(size, len(own)), np.maximum(size, len(own))
        other = np.flatnonzero((root != root[i]) & (side == 0) & (100 * least >= percent * most)).tolist()
        if not other:
            return []
        keys = np.concatenate([sets[k] for k in other])
        hit = own[np.minimum(np.searchsorted(own, keys), len(own) - 1)] == keys
        overlap = np.add.reduceat(hit.astype(np.int64), np.cumsum(size[other]) - size[other])
        return [(nodes[i], nodes[k]) for k, n in zip(other, overlap.tolist(), strict=True)
                if n * (100 + percent) >= percent * (len(own) + len(sets[k]))]
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(size) - size
    marked, out = np.zeros(int(at.max()) + 1, dtype=bool), []
    for i in probes.tolist():
        other = (root != root[i]) & (side != 1) & ((side != 2) | (np.arange(len(root)) > i))
        if not other.any():
            continue
        own = at[first[i]:first[i] + size[i]]
        marked[own] = True
        overlap = np.add.reduceat(marked[at].astype(np.int64), first)
        marked[own] = False
        hit = other & (overlap * (100 + percent) >= percent * (size + size[i]))
        out += [(nodes[i], nodes[k]) for k in np.flatnonzero(hit).tolist()]
    return out


def _able_pairs(root: np.ndarray, side: np.ndarray, size: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (probe, other) of a group that sizes and bit maps allow."""
    rows = np.arange(len(sets))
    marks = np.zeros((len(sets), 64 * MAP_WORDS), bool)
    marks[np.repeat(rows, size), (np.concatenate(sets) & np.uint64(64 * MAP_WORDS - 1)).astype(np.int64)] = True
    maps = np.packbits(marks, axis=1).view(np.uint64)
    ones, left, right = _ones(maps), [], []
    step = max(1, MAPS_AT_ONCE // len(sets))
    for a in range(0, len(sets), step):
        i, j = rows[a:a + step, None], rows[None]
        able = (side[i] > 0) & (side[j] != 1) & ((side[j] != 2) | (j > i)) & (root[i] != root[j])
        able &= 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
        x, y = np.nonzero(able)
        x += a
        able = _possible(size[x], size[y], ones[x], ones[y], _ones(maps[x] & maps[y]), percent)
        left.append(x[able])
        right.append(y[able])
    return np.concatenate(left), np.concatenate(right)


def links_of_groups(nodes: list[int], roots: list[int], sides: list[int], sets: list[np.ndarray], begins: list[int], percent: int) -> list[tuple[int, int]]:
    """Links of many groups, which begin at ``begins``. Pairs of a single
    probe, of small groups and of groups of which bit maps leave few pairs are
    looked up together; each other group goes to ``counted_links``."""
    node, root, side = np.array(nodes), np.array(roots), np.array(sides)
    size = np.array([len(s) for s in sets])
    begin = np.array(begins)
    members = np.diff(np.append(begin, len(sets)))
    group, rows = np.repeat(np.arange(len(begin)), members), np.arange(len(sets))
    single = (np.bincount(group[side == 1], minlength=len(begin)) == 1) & (np.bincount(group[side == 2], minlength=len(begin)) == 0)
    probe = np.zeros(len(begin), np.int64)
    probe[group[side == 1]] = rows[side == 1]
    y = rows[(side == 0) & single[group]]
    left, right = [probe[group[y]]], [y]
    few = ~single & (members <= FEW)
    for d in range(1, FEW):
        x = rows[:max(0, len(rows) - d)]
        x = x[(group[x] == group[x + d]) & few[group[x]]]
        x = x[((side[x] == 2) & (side[x + d] == 2)) | (side[x] + side[x + d] == 1)]
        left.append(x)
        right.append(x + d)
    out = []
    for k in np.flatnonzero(~single & ~few).tolist():
        a, b = int(begin[k]), int(begin[k] + members[k])
        x, y = _able_pairs(root[a:b], side[a:b], size[a:b], sets[a:b], percent)
        if len(x) > FEW * (b - a):
            out += counted_links(nodes[a:b], roots[a:b], sides[a:b], sets[a:b], percent)
        else:
            left.append(a + x)
            right.append(a + y)
    x, y = np.concatenate(left), np.concatenate(right)
    possible = (root[x] != root[y]) & (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y]))
    x, y = x[possible], y[possible]
    if len(x):
        stored = np.concatenate(sets)
        first = np.cumsum(size) - size
        total = np.cumsum(size[x] + size[y])
        a = 0
        while a < len(x):  # both sides of a pair get its number in front: two ascending rows of keys
            b = min(max(a + 1, int(np.searchsorted(total, total[a] + LOOKED_UP, "right"))), a + (1 << (64 - HASH_BITS)))
            number = np.arange(b - a, dtype=np.uint64) << np.uint64(HASH_BITS)

            def keys(side, a=a, b=b, number=number):
                many = size[side[a:b]]
                start = np.cumsum(many) - many
                at = np.arange(int(many.sum())) + np.repeat(first[side[a:b]] - start, many)
                return stored[at] | np.repeat(number, many), many, start

            left, n_left, _ = keys(x)
            right, n_right, start = keys(y)
            found = left[np.minimum(np.searchsorted(left, right), len(left) - 1)] == right
            overlap = np.add.reduceat(found.astype(np.int64), start)
            hit = overlap * (100 + percent) >= percent * (n_left + n_right)
            out += zip(node[x[a:b][hit]].tolist(), node[y[a:b][hit]].tolist(), strict=True)
            a = b
    return out


def _bands(batches, spread):
    """Band keys of the distinct lines of a task as sorted runs: the bucket
    (leading ``spread`` bits), the next 32 bits of each key, the lines. Keys
    that agree in these bits only make more candidates. Of many lines with one
    key, two are enough to tell that the key is shared; the others go on as
    rows with a ``salt``."""
    seen: set[int] = set()
    held, number, amount = [], 0, 0

    def out():
        key = np.concatenate([h[0].reshape(-1) for h in held]) >> np.uint64(32 - spread)
        node = np.concatenate([np.repeat(h[1], BANDS) for h in held])
        order = np.argsort(key)
        key, node = key[order], node[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        many = np.diff(np.append(head, len(key)))
        place = np.arange(len(key)) - np.repeat(head, many)
        beyond = (place >= 2) & np.repeat(many > ALIKE, many)
        hot = np.repeat(many > ALIKE, many)
        columns = [], [], [], [], []
        for rows, salt, cut_short in ((~hot, 0, False), (hot & ~beyond, 0, True), (beyond, number, True)):
            k, n = key[rows], node[rows]
            if not len(k):
                continue
            bucket = (k >> np.uint64(32)).astype(np.int64)
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for a, b in zip(cut, np.append(cut[1:], len(k)), strict=True):
                for c, v in zip(columns, (int(bucket[a]), salt, cut_short, k[a:b].astype("<u4").tobytes(), n[a:b].tobytes()), strict=True):
                    c.append(v)
        return pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.bool_()),
                                pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.binary())],
                               names=["bucket", "salt", "hot", "keys", "nodes"])

    for batch in batches:
        data, offsets = utf8(batch.column(0))
        for i, j in row_chunks(offsets, TEXT_BYTES):
            chunk, off = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            starts, ends, _, _ = _lines(chunk, off)
            nodes, one = np.unique(span_hashes(chunk, starts, ends).view(np.int64), return_index=True)
            new = [k for k, n in enumerate(nodes.tolist()) if n not in seen]
            if not new:
                continue
            nodes, one = nodes[new], one[new]
            seen.update(nodes.tolist())
            bands = _signatures([chunk[starts[k]:ends[k]].tobytes().decode("utf-8", "replace") for k in one])
            held.append((bands, nodes))
            amount += bands.size
            if amount >= SORTED:
                number += 1
                yield out()
                held, amount = [], 0
    if held:
        number += 1
        yield out()


def _shared(batches):
    """Entries (key, node, members) of the keys with several lines, from the
    runs of a bucket, which stand together, and from the rows sent on.
    ``members`` is a hash of the key's lines; a key of which rows were sent on
    has one of its own."""
    held, bucket = [], None

    def out():
        key, node, hot = (np.concatenate([h[c] for h in held]) for c in range(3))
        order = np.argsort(key)
        alike = key[order[1:]] == key[order[:-1]]
        order = order[np.append(alike, False) | np.append(False, alike)]  # most keys have one line
        order = order[np.lexsort((node[order], key[order]))]
        key, node, hot = key[order], node[order], hot[order]
        if not len(key):
            return rows(key, node, bucket)
        new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
        hot = np.logical_or.reduceat(hot, np.flatnonzero(new))
        key, node = key[new], node[new]
        alike = key[1:] == key[:-1]
        several = np.append(alike, False) | np.append(False, alike)
        key, node, hot = key[several], node[several], hot[several]
        if not len(key):
            return rows(key, node, bucket)
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        many = np.diff(np.append(head, len(key)))
        members = mix64(np.add.reduceat(mix64(node.view(np.uint64)), head) + many.astype(np.uint64))
        own = mix64(key[head].astype(np.uint64) + (np.uint64(bucket) << np.uint64(32)))
        return rows(key, node, bucket, np.repeat(np.where(np.logical_or.reduceat(hot, head), own, members), many))

    def rows(key, node, b, members=None):
        whole = key.astype(np.int64) + (b << 32)
        if members is None:
            members = mix64(whole.view(np.uint64))
        return pa.record_batch([pa.array(whole), pa.array(node), pa.array(members.view(np.int64))], names=["key", "node", "members"])

    for batch in batches:
        for b, salt, hot, k, n in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
            key, node = np.frombuffer(k, "<u4"), np.frombuffer(n, np.int64)
            if salt:
                yield rows(key, node, b)
                continue
            if b != bucket and held:
                yield out()
                held = []
            bucket = b
            held.append((key, node, np.full(len(key), hot)))
    if held:
        yield out()


def _maps(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of shingles, bit maps of them) of lines."""
    size, maps = np.zeros(len(lines), np.int32), np.zeros((len(lines), MAP_WORDS), np.uint64)
    for a in range(0, len(lines), SORTED_LINES):
        some = lines[a:a + SORTED_LINES]
        h, first = char_shingles(some, SHINGLE)
        many = np.diff(np.append(first, len(h)))
        marks = np.zeros(len(some) * 64 * MAP_WORDS, bool)
        marks[np.repeat(np.arange(len(some)) * (64 * MAP_WORDS), many) + (h & np.uint64(64 * MAP_WORDS - 1)).astype(np.int64)] = True
        size[a:a + len(some)] = many
        maps[a:a + len(some)] = np.packbits(marks.reshape(len(some), -1), axis=1).view(np.uint64)
    return size, maps


def _occurrences(batches, bits):
    """Places of all lines; the text, size and bit map of lines that may be
    needed, once a task."""
    filter_, seen = bits.value, set()
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        ids, keys = batch.column(0), batch.column(1)
        for i, j in row_chunks(offsets, TEXT_BYTES):
            chunk, off = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            starts, ends, doc, number = _lines(chunk, off)
            nodes = span_hashes(chunk, starts, ends).view(np.int64)
            wanted = (filter_[(nodes % (8 * len(filter_))) >> 3] >> (nodes % 8).astype(np.uint8)) & 1
            first = []
            for k in np.flatnonzero(wanted).tolist():
                if (n := int(nodes[k])) not in seen:
                    seen.add(n)
                    first.append(k)
            found = [chunk[starts[k]:ends[k]].tobytes().decode("utf-8", "replace") for k in first]
            size, maps = _maps(found)
            to = np.full(len(nodes), -1)
            to[first] = np.arange(len(first))
            to = pa.array(to, pa.int64(), mask=to < 0)
            at = pa.array(doc + i)
            yield pa.record_batch([ids.take(at), keys.take(at), pa.array(number, pa.int32()), pa.array(nodes),
                                   pa.array(found, pa.string()).take(to), pa.array(size, pa.int32()).take(to), _map_column(maps).take(to)],
                                  names=["doc_id", "doc_key", "line", "node", "text", "n", "map"])


def _map_column(maps: np.ndarray) -> pa.Array:
    off = np.arange(len(maps) + 1, dtype=np.int32) * (8 * MAP_WORDS)
    return pa.Array.from_buffers(pa.binary(), len(maps), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(maps))])


def _map_rows(column: pa.Array) -> np.ndarray:
    return utf8(column)[0].view(np.uint64).reshape(-1, MAP_WORDS)


def _ones(maps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(maps).sum(axis=-1, dtype=np.int64)


def _possible(n, m, ones_n, ones_m, both, percent=PERCENT):
    """Whether bit maps allow the similarity. A bit that only x has stands for
    a shingle outside y. With n shingles (repeats counted, so at least the
    distinct ones) and such bits a of x and b of y, the similarity is at most
    (n - a) / (n + b); the same for the m shingles of y."""
    a, b = ones_n - both, ones_m - both
    return ((n - a) * 100 >= (n + b) * percent) & ((m - b) * 100 >= (m + a) * percent)


def _small_pairs(begin: np.ndarray, many: np.ndarray, node: np.ndarray, n: np.ndarray, maps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hubs, nodes): the pairs that bit maps allow within each of the groups,
    which begin at ``begin`` and have ``many`` members, at most FEW."""
    ones, hubs, nodes = _ones(maps), [], []
    for i in range(FEW):
        for j in range(i + 1, FEW):
            x, y = begin[many > j] + i, begin[many > j] + j
            able = _possible(n[x], n[y], ones[x], ones[y], _ones(maps[x] & maps[y])) & (node[x] != node[y])
            hubs.append(np.minimum(node[x[able]], node[y[able]]))
            nodes.append(np.maximum(node[x[able]], node[y[able]]))
    return np.concatenate(hubs), np.concatenate(nodes)


def _partnered(node: np.ndarray, n: np.ndarray, maps: np.ndarray) -> np.ndarray:
    """Which rows of a group have a possible partner in it."""
    ones, found = _ones(maps), np.zeros(len(node), bool)
    for i in range(len(node)):
        if not found[i]:
            hit = _possible(n[i], n, ones[i], ones, _ones(maps[i] & maps)) & (node != node[i])
            found |= hit
            found[i] = hit.any()
    return found


def _promising(batches):
    """From entries that are sorted by key: the possible pairs (hub, node) of
    the keys of few lines, and the entries (key, node, n) of the other keys
    that have a possible partner. Of a key with more lines than can be held,
    all go on."""
    held, hot = None, None

    def pairs(hub, node):
        none = pa.nulls(len(hub), pa.int64())
        return pa.record_batch([none, pa.array(node), pa.nulls(len(hub), pa.int32()), pa.array(hub)], names=["key", "node", "n", "hub"])

    def entries(key, node, n):
        return pa.record_batch([pa.array(key), pa.array(node), pa.array(n.astype(np.int32)), pa.nulls(len(key), pa.int64())],
                               names=["key", "node", "n", "hub"])

    def out(key, node, n, maps):
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        many = np.diff(np.append(begin, len(key)))
        small = (many <= FEW) & (key[begin] != hot if hot is not None else True)
        yield pairs(*_small_pairs(begin[small], many[small], node, n, maps))
        found = np.zeros(len(key), bool)
        for a, m in zip(begin[~small].tolist(), many[~small].tolist(), strict=True):
            found[a:a + m] = True if key[a] == hot else _partnered(node[a:a + m], n[a:a + m], maps[a:a + m])
        yield entries(key[found], node[found], n[found])

    for batch in batches:
        rows = [*(batch.column(c).to_numpy() for c in range(2)), batch.column(2).to_numpy().astype(np.int64), _map_rows(batch.column(3))]
        if held is not None:
            rows = [np.concatenate(c) for c in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        last = int(np.searchsorted(rows[0], rows[0][-1]))  # the last key may go on
        done, held = [c[:last] for c in rows], [c[last:] for c in rows]
        if last:
            yield from out(*done)
        if len(held[0]) > MOST_MAPS:
            hot = held[0][0]
        if hot is not None and held[0][0] == hot:
            yield entries(*held[:3])
            held = None
    if held is not None:
        yield from out(*held)


def _sifted(batches):
    """The pairs (hub, node) whose bit maps allow the similarity."""
    for batch in batches:
        n, m = (batch.column(c).to_numpy().astype(np.int64) for c in (2, 4))
        x, y = _map_rows(batch.column(3)), _map_rows(batch.column(5))
        able = pa.array(_possible(n, m, _ones(x), _ones(y), _ones(x & y)))
        yield pa.record_batch([batch.column(0).filter(able), batch.column(1).filter(able)], names=["hub", "node"])


_PLACE = ["doc_id", "doc_key", "line"]
#: bits for each entry in the filter that keeps the text of most lines without partner
#: out of the tables, the most bits of it, and those in one piece of it
BITS_EACH, MOST_BITS, PIECE_BITS = 8, 1 << 26, 1 << 19


def _bit_places(batches, size):
    """Places of a task's nodes in the filter, by piece."""
    marked = np.zeros(size, bool)
    for batch in batches:
        marked[batch.column(0).to_numpy() % size] = True
    places = np.flatnonzero(marked)
    piece = places // PIECE_BITS
    head = np.flatnonzero(np.append(True, piece[1:] != piece[:-1])) if len(piece) else piece
    own = np.split((places % PIECE_BITS).astype("<u4"), head[1:]) if len(piece) else []
    yield pa.record_batch([pa.array(piece[head]), pa.array([x.tobytes() for x in own], pa.binary())], names=["piece", "places"])


def _bit_pieces(batches):
    """The pieces of the filter, each from all its places."""
    pieces: dict[int, np.ndarray] = {}
    for batch in batches:
        for p, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if p not in pieces:
                pieces[p] = np.zeros(PIECE_BITS, bool)
            pieces[p][np.frombuffer(places, "<u4")] = True
    yield pa.record_batch([pa.array(list(pieces), pa.int64()),
                           pa.array([np.packbits(x, bitorder="little").tobytes() for x in pieces.values()], pa.binary())], names=["piece", "bits"])


def _needed_bits(shared: DataFrame) -> np.ndarray:
    """The bit filter of the nodes of a kept table of entries."""
    size = PIECE_BITS
    while size < min(MOST_BITS, BITS_EACH * shared.count()):
        size *= 2
    places = map_arrow(shared.select("node"), _bit_places, "piece long, places binary", size=size)
    bits = np.zeros(size // 8, np.uint8)  # at most MOST_BITS / 8 bytes
    for row in map_arrow(places.repartition("piece"), _bit_pieces, "piece long, bits binary").toArrow().to_pylist():
        at = row["piece"] * PIECE_BITS // 8
        bits[at:at + PIECE_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _repeated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places of all lines (doc_id, doc_key, line, node), and the first place
    of its component (``__first``) of each node of several places."""
    spark = rows.sparkSession
    ship(spark)
    # as many buckets as keep each small: the tasks' share of entries stays the same at every size
    spread = max(4, (BUCKETS_EACH * rows.rdd.getNumPartitions()).bit_length())
    runs = map_arrow(rows.select("text"), _bands, "bucket long, salt int, hot boolean, keys binary, nodes binary", spread=spread)
    runs = runs.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt")
    shared = kept(map_arrow(runs, _shared, "key long, node long, members long"), "shared")
    places = kept(map_arrow(rows, _occurrences, "doc_id long, doc_key long, line int, node long, text string, n int, map binary",
                            bits=spark.sparkContext.broadcast(_needed_bits(shared))), "places")
    maps = kept(places.where("text is not null").select("node", "n", "map").dropDuplicates(["node"]), "maps")
    # similar lines share many keys: of the keys with the same lines, one is enough
    one = shared.groupBy("members").agg(F.min("key").alias("key")).select("key")
    every = shared.join(one, "key", "left_semi").join(maps, "node").select("key", "node", "n", "map")
    promising = kept(map_arrow(every.repartition("key").sortWithinPartitions("key"), _promising,
                               "key long, node long, n int, hub long"), "promising")
    pairs = promising.where("hub is not null").select("hub", "node").distinct()
    entries = promising.where("key is not null").select("key", "node", "n")
    forget(shared)
    wanted = promising.select("node").union(promising.where("hub is not null").select("hub")).distinct()
    texts = kept(places.where("text is not null").select("node", "text", "n", "map")
                 .join(wanted, "node", "left_semi").dropDuplicates(["node"]), "texts")
    forget(maps)

    def verify(groups: DataFrame) -> DataFrame:
        return checked(groups, texts.select("node", "text"), functools.partial(line_sets, width=SHINGLE), PERCENT, links_of_groups)

    def sift(pairs: DataFrame) -> DataFrame:
        own = texts.select("node", "n", "map")
        both = pairs.join(own, "node").join(own.toDF("hub", "m", "hub_map"), "hub")
        return map_arrow(both.select("hub", "node", "n", "map", "m", "hub_map"), _sifted, "hub long, node long")

    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int")
    # the pairs of keys of few lines are told all at once; leaders serve the larger keys
    roots = united(entries, verify, size_class, sift=sift, known=kept(verify(hub_groups(pairs)), "found"))
    forget(texts, promising)
    places = places.select(*_PLACE, "node")
    nodes = places.groupBy("node").agg(F.min(F.struct(*_PLACE)).alias("__own"), F.count(F.lit(1)).alias("__n"))
    several = kept(nodes.join(roots, "node", "left").where("__n > 1 or root is not null").drop("__n"), "several")
    first = several.where("root is not null").groupBy("root").agg(F.min("__own").alias("__first"))
    repeated = several.join(first, "root", "left").select("node", F.coalesce("__first", "__own").alias("__first"))
    return places, repeated


def line_components(rows: DataFrame) -> DataFrame:
    """Places of all lines (doc_id, doc_key, line) with ``kept``: whether the
    line is the first of its component. ``rows``: doc_id, doc_key, text."""
    places, repeated = _repeated(rows)
    return (places.join(repeated, "node", "left")
            .select(*_PLACE, (F.col("__first").isNull() | (F.col("__first") == F.struct(*_PLACE))).alias("kept")))


def dropped_lines(rows: DataFrame) -> DataFrame:
    """The places of ``line_components`` that aren't kept."""
    places, repeated = _repeated(rows)
    return places.join(repeated, "node").where(F.col("__first") != F.struct(*_PLACE)).select(*_PLACE)


def dedup_lines(docs: DataFrame, lines: str = "__lines", dropped: str = "__dropped") -> DataFrame:
    """The rows and columns of ``docs`` with ``text`` cut down to its kept
    lines, and two columns more: ``lines`` and ``dropped`` (lines that aren't
    blank, and those of them dropped).

    Blank lines stay. A null text stays null and an empty one empty; a text
    without dropped lines is unchanged byte for byte. Of equal or similar
    lines the first by (doc_id, text hash, line number) stays, null ids first.
    Rows that repeat an id and a text are one document and keep the same
    lines. An empty table gives an empty result; further columns pass through,
    but for columns that have the names of the two new ones: these give way.
    """
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("doc_key"), "text")
    docs = docs.drop(lines, dropped)
    id_, key, drop = unused(docs, "__id", "__key", "__drop")
    per_doc = (dropped_lines(rows).groupBy("doc_id", "doc_key").agg(F.collect_set("line").alias(drop))
               .withColumnsRenamed({"doc_id": id_, "doc_key": key}))
    every = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    kept_text = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(drop, i)), "\n")
    return (docs.join(per_doc.hint("shuffle_hash"), docs["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(key)), "left")
            .withColumn(lines, F.when(F.col("text").isNull(), 0).otherwise(every).cast("long"))
            .withColumn("text", F.when(F.size(drop) > 0, kept_text).otherwise(F.col("text")))
            .withColumn(dropped, F.when(F.col(drop).isNull(), 0).otherwise(F.size(drop)).cast("long"))
            .drop(id_, key, drop))
