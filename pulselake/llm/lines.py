"""Fuzzy line dedup: blocks of normalised lines, SimHash screen, edit similarity, one line kept per connected group."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import mix, pieces, span_hashes, word_spans
from .near import in_blocks, linked_classes, meeting


#: ASCII letters and \n stay, digits are 0, every other ASCII character is a space; bytes of other characters stay.
_TABLE = bytes(c if chr(c).isalpha() or c >= 128 or c == 10 else 48 if chr(c).isdigit() else 32 for c in range(256))
#: Words of a block by the number of words of the line: up to 2, 7, 15 and 31 words, and more.
_BLOCK_EDGES, _BLOCK_WORDS = np.array([2, 7, 15, 31]), np.array([1, 2, 3, 4, 5])
#: The eight 0/1 bytes of every byte value, as one number: adding these counts bits, byte by byte.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def normal_form(line: str) -> str:
    """Lower case, every ASCII digit 0, runs of other ASCII signs and spaces one space, trimmed."""
    return b" ".join(line.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()).decode("utf-8", "surrogatepass")


def line_parts(texts: list[str | None], blocks: int = 6) -> tuple[np.ndarray, ...]:
    """Of every line with a word in these texts: (text, position, code points of the normal form, two fingerprints, SimHash, block keys, their offsets).

    A null text has no lines. The SimHash counts every word as often as it stands there.
    """
    buf, doc, pos, starts, ends, line, at, words = _line_words(texts)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none, none, np.zeros(1, np.int64)
    h = span_hashes(buf, starts, ends)
    k1, k2 = _fingerprints(h, at, words)
    n = np.add.reduceat(ends - starts, at) + words - 1
    if buf.max() >= 128:
        later = np.flatnonzero((buf & 0xC0) == 0x80)  # bytes that begin no character
        n -= np.diff(np.searchsorted(later, np.concatenate([starts[at], [len(buf)]])))
    few = np.flatnonzero(words <= 3)
    short = [[bytes(buf[starts[j] : ends[j]]).decode("utf-8", "surrogatepass") for j in range(a, a + w)] for a, w in zip(at[few], words[few])]
    keys, off = block_keys(h, at, words, blocks, {int(i): half_keys(" ".join(w)) for i, w in zip(few, short)})
    return doc[line], pos[line], n, k1.view(np.int64), k2.view(np.int64), simhashes(h, at, words).view(np.int64), keys.view(np.int64), off


def _line_words(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Of these texts: normalised bytes, text and position of every line; starts and ends of words, lines with a word, their first words and numbers of words."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE) for t in texts]
    per = np.array([r.count(b"\n") + 1 for r in raw], np.int64)
    buf = np.frombuffer(b"\n".join(raw), np.uint8)
    doc = np.repeat(np.arange(len(raw)), per)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    starts, ends, _ = word_spans(buf, np.array([0, len(buf)]))
    line, at, words = np.unique(np.searchsorted(np.flatnonzero(buf == 10), starts), return_index=True, return_counts=True)
    return buf, doc, pos, starts, ends, line, at, words


def _fingerprints(h: np.ndarray, at: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each run of word hashes."""
    place = (np.arange(len(h)) - np.repeat(at, words)).astype(np.uint64)
    return np.add.reduceat(mix(h + place * np.uint64(0x9E3779B97F4A7C15)), at), np.add.reduceat(mix((h ^ np.uint64(0x5DEECE66D)) * np.uint64(0xD6E8FEB86659FD93) + place), at)


def simhashes(hashes: np.ndarray, at: np.ndarray, words: np.ndarray) -> np.ndarray:
    """SimHash of each run of word hashes: a bit is set where more than half of the words have it."""
    spread = _SPREAD[np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)]
    edge = np.unique(np.concatenate([at, *(np.arange(a, a + w, 255) for a, w in zip(at[words > 255], words[words > 255]))]))  # a byte counts up to 255
    up = np.add.reduceat(spread, edge, axis=0).view(np.uint8).reshape(len(edge), 64)
    if len(edge) > len(at):
        up = np.add.reduceat(up, np.searchsorted(edge, at), axis=0, dtype=np.int64)
    return np.packbits(2 * up.astype(np.int64) > words[:, None], axis=1).view(np.uint64).ravel()


def block_words(words: np.ndarray) -> np.ndarray:
    return _BLOCK_WORDS[np.searchsorted(_BLOCK_EDGES, words)]


def half_keys(line: str) -> list[int]:
    """Keys of a line's first and last halves, in code points; both roundings, so that one more or less at one end does no harm."""
    halves = {(side, line[:h] if side else line[len(line) - h :]) for h in {len(line) // 2, (len(line) + 1) // 2} for side in (0, 1) if h}
    return sorted(int.from_bytes(hashlib.blake2b(f"{s}{t}".encode("utf-8", "surrogatepass"), digest_size=6).digest(), "little") for s, t in halves)


def block_keys(hashes: np.ndarray, at: np.ndarray, words: np.ndarray, most: int, extra: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, offsets) of each line: the ``most`` blocks with the least hashes, of the runs of ``block_words`` words that start at its words.

    The line is a ring, its end is followed by its start. A line that a few words more would put among the lines with longer blocks has
    keys of those too. ``extra``: further keys by line.
    """
    size = block_words(words)
    grown = block_words(words + np.maximum(1, words // 8))
    also = np.flatnonzero(grown != size)
    who = np.concatenate([np.arange(len(at)), also])
    by = np.concatenate([size, grown[also]])
    out = []
    for k in np.unique(by):
        lines = who[by == k]
        for cut in range(0, len(lines), 1 << 16):  # line numbers have 16 bits beside the keys' 48
            part = lines[cut : cut + (1 << 16)]
            w = words[part]
            first = np.concatenate([[0], np.cumsum(w)])
            row = np.repeat(np.arange(len(part)), w)
            place = np.arange(first[-1]) - first[row]
            base, wide = at[part][row], w[row]
            acc = np.full(len(row), np.uint64(k))
            for j in range(k):
                after = place + j
                after[after >= wide] -= wide[after >= wide]  # no block is longer than its line
                acc += mix(hashes[base + after] + np.uint64(j * 7919 + 1)) * np.uint64(2 * j + 1)
            s = np.sort((row.astype(np.uint64) << np.uint64(48)) | (mix(acc) >> np.uint64(16)))
            r = (s >> np.uint64(48)).astype(np.int64)
            ok = np.concatenate([[True], s[1:] != s[:-1]])
            rank = np.cumsum(ok) - 1
            ok &= rank - rank[first[:-1]][r] < most
            out.append((part[r[ok]], s[ok] & np.uint64((1 << 48) - 1)))
    for i, keys in extra.items():
        out.append((np.full(len(keys), i), np.array(keys, np.uint64)))
    row, key = np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])
    order = np.argsort(row, kind="stable")
    return key[order], np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(at)))])


def _keys(k1: np.ndarray, k2: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(np.stack([k1, k2], 1))
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer((np.arange(len(data) + 1) * 16).astype(np.int32)), pa.py_buffer(data)])


def line_signatures(docs: DataFrame, id_col: str, text_col: str, blocks: int) -> DataFrame:
    """(uid struct<id, pos>, n, set_key, bands, s0) of every line with a word."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in pieces(batches, text_col):
                doc, pos, n, k1, k2, sim, keys, off = line_parts(b.column(1).to_pylist(), blocks)
                uid = pa.StructArray.from_arrays([b.column(0).take(pa.array(doc)), pa.array(pos.astype(np.int32))], ["id", "pos"])
                bands = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(keys))
                yield pa.RecordBatch.from_arrays([uid, pa.array(n), _keys(k1, k2), bands, pa.array(sim)], ["uid", "n", "set_key", "bands", "s0"])

    return docs.select(id_col, text_col).mapInArrow(run, f"uid struct<id:{kind},pos:int>, n long, set_key binary, bands array<long>, s0 long")


#: Bytes of keys that a task holds before it deals them out.
_DEALT_BYTES = 64 << 20


def shared_blocks(rows: DataFrame) -> DataFrame:
    """(mark, key) of ``rows(mark, bands)``, each once, of the keys that rows of several marks have.

    Keys and marks travel as arrays of numbers, one for each task and part of the keys, so that no single key is a row of a shuffle.
    """
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            both = np.concatenate(held)
            part = both[:, 0] % parts
            order = np.argsort(part.astype(np.uint32), kind="stable")
            ends = np.cumsum(np.bincount(part, minlength=parts))
            some = np.flatnonzero(np.diff(ends, prepend=0))
            out = both[order]
            for at in range(0, len(some), 64):
                s = some[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array([out[ends[p - 1] if p else 0 : ends[p]].tobytes() for p in s.tolist()], pa.binary())], ["part", "pairs"])

        held, size = [], 0
        for b in batches:
            mark, bands = b.column("mark").to_numpy(), b.column("bands")
            first = np.unique(mark, return_index=True)[1]
            bands = bands.take(pa.array(first))
            held.append(np.stack([bands.flatten().to_numpy(), np.repeat(mark[first], pc.list_value_length(bands).to_numpy())], 1))
            size += held[-1].nbytes
            if size >= _DEALT_BYTES:
                yield from dealt(held)
                held, size = [], 0
        if held:
            yield from dealt(held)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def shared(held: list[bytes]) -> Iterator[pa.RecordBatch]:
            both = np.frombuffer(b"".join(held), np.int64).reshape(-1, 2)
            both = both[np.argsort(both[:, 0])]
            key, mark = both[:, 0], np.ascontiguousarray(both[:, 1])
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            several = np.repeat(np.minimum.reduceat(mark, at) != np.maximum.reduceat(mark, at), np.diff(at, append=len(key)))
            key, mark = key[several], mark[several]
            order = np.lexsort((mark, key))
            key, mark = key[order], mark[order]
            own = np.ones(len(key), bool)
            own[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(mark[own]), pa.array(key[own])], ["mark", "key"])

        for b in batches:
            for p, pairs in zip(b.column("part").to_pylist(), b.column("pairs").to_pylist()):
                if p != part and held:
                    yield from shared(held)
                    held = []
                part = p
                held.append(pairs)
        if held:
            yield from shared(held)

    dealt = rows.select("mark", "bands").mapInArrow(deal, "part int, pairs binary")
    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(gather, "mark long, key long")


#: Bits of the largest bitmap of wanted lines that goes to the tasks, 16 MB.
_WANTED_BITS = 1 << 27


def wanted_lines(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of ``wanted(node, uid, set_key)``: the normal forms of the lines with these uids and fingerprints; several texts may bear one id, repeated rows count once.

    A bitmap of the wanted lines' places, 32 bits a line or more up to 16 MB, tells the scan which lines to hand on; the join drops those that pass by chance.
    """
    place = F.xxhash64("uid.id").bitwiseXOR(F.shiftleft(F.col("uid.pos").cast("long"), 48))
    bits = min(_WANTED_BITS, max(1 << 16, 1 << (32 * wanted.count()).bit_length()))
    top = F.shiftrightunsigned(place, 65 - bits.bit_length())
    marked = wanted.select(top.alias("top")).groupBy(F.expr("cast(shiftright(top, 6) as int)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(top, 64) as int)))").alias("set")).toArrow()
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[marked.column("at").to_numpy()] = marked.column("set").to_numpy().view(np.uint64)
    shared, drop = docs.sparkSession.sparkContext.broadcast(bitmap), np.uint64(65 - bits.bit_length())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        with np.errstate(over="ignore"):
            for b in pieces(batches, "text", 1 << 20):
                lines = [(t or "").split("\n") for t in b.column("text").to_pylist()]
                per = np.array([len(x) for x in lines], np.int64)
                doc = np.repeat(np.arange(len(lines)), per)
                pos = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
                place = (b.column("h").to_numpy()[doc] ^ (pos << 48)).view(np.uint64) >> drop
                hit = np.flatnonzero((bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1))
                doc, pos = doc[hit], pos[hit]
                texts = [lines[i][j] for i, j in zip(doc.tolist(), pos.tolist())]
                buf, row, _, starts, ends, line, at, words = _line_words(texts)
                if not len(line):
                    continue
                row = row[line]
                keys = _keys(*(k.view(np.int64) for k in _fingerprints(span_hashes(buf, starts, ends), at, words)))
                uid = pa.StructArray.from_arrays([b.column("id").take(pa.array(doc[row])), pa.array(pos[row].astype(np.int32))], ["id", "pos"])
                yield pa.RecordBatch.from_arrays([uid, keys, pa.array([normal_form(texts[r]) for r in row.tolist()], pa.string())], ["uid", "set_key", "text"])

    found = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text")).mapInArrow(run, f"uid struct<id:{kind},pos:int>, set_key binary, text string")
    # a uid is a struct and never null itself, nulls inside are equal; the join needs no other shuffle than the removal of repeated rows
    return found.dropDuplicates(["uid", "set_key"]).join(wanted, ["uid", "set_key"]).select("node", "text")


def edit_distance(x: str, y: str) -> int:
    """Levenshtein distance with whole-number bit vectors."""
    if not x or not y:
        return len(x) + len(y)
    at: dict[str, int] = {}
    for i, c in enumerate(x):
        at[c] = at.get(c, 0) | (1 << i)
    full, top = (1 << len(x)) - 1, 1 << (len(x) - 1)
    up, down, score = full, 0, len(x)
    for c in y:
        eq = at.get(c, 0)
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & full
        right = down | (full & ~(diagonal | up))
        left = up & diagonal
        score += 1 if right & top else -1 if left & top else 0
        right, left = ((right << 1) | 1) & full, (left << 1) & full
        up, down = left | (full & ~(diagonal | right)), right & diagonal
    return score


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _padded(data: np.ndarray, first: np.ndarray, size: np.ndarray, fill: int) -> np.ndarray:
    """(rows, longest) matrix of the runs of ``data``."""
    at = np.arange(int(size.max(initial=0)))[None, :]
    inside = at < size[:, None]
    if not len(data):
        return np.full(inside.shape, np.uint32(fill))
    return np.where(inside, data[np.minimum(first[:, None] + at, len(data) - 1)], np.uint32(fill))


#: Classes of characters: the space, 0, a to z and the code points from 223 to 255 have one of their own, three are shared by all others.
_CLASSES = np.array([0 if c == 32 else 1 if c == 48 else c - 95 if 97 <= c <= 122 else c - 195 if 223 <= c else 61 + c % 3 for c in range(256)], np.uint8)
#: The first class that several characters share, and the classes of what follows the end of the shorter and of the longer line.
_SHARED_CLASS, _END_X, _END_Y = 61, 65, 64
#: Characters of a window, one bit each.
_WINDOW = 64
#: Fewer pairs than this do not share a step's cost; they are compared one by one.
_SHARED = 64


#: Classes of three characters.
_GRAMS = 4096


def _classes(d: np.ndarray) -> np.ndarray:
    out = _CLASSES[np.minimum(d, 255)]
    other = np.flatnonzero(d > 255)
    out[other] = _SHARED_CLASS + d[other] % 3
    return out


def _least_within(x: np.ndarray, x0: np.ndarray, n: np.ndarray, y: np.ndarray, y0: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The least Levenshtein distance of each run of x (up to _WINDOW classes) to any part of its run of y."""
    p, wide = len(n), 65
    match = np.zeros(p * wide, np.uint64)
    row = np.arange(p) * wide
    for i in range(int(n.max())):
        r = np.flatnonzero(i < n)
        match[row[r] + x[x0[r] + i]] |= np.uint64(1 << i)
    steps = np.arange(int(m.max(initial=0)))[:, None]
    text = np.where(steps < m[None, :], y[np.minimum(y0[None, :] + steps, len(y) - 1)], 64) + row[None, :]  # class 64 matches nothing and so never lowers a distance
    one, last = np.uint64(1), (n - 1).astype(np.uint64)
    up, down = np.full(p, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(p, np.uint64)
    score = n.astype(np.int64)
    best = score.copy()
    for at in text:
        eq = match[at]
        diagonal = (((eq & up) + up) ^ up) | eq
        eq |= down
        right = down | ~(diagonal | up)
        left = up & diagonal
        score += ((right >> last) & one).view(np.int64)
        score -= ((left >> last) & one).view(np.int64)
        right <<= one
        left <<= one
        up = left | ~(eq | right)
        down = right & eq
        np.minimum(best, score, out=best)
    return best


def surely_apart(dx: np.ndarray, x0: np.ndarray, n: np.ndarray, dy: np.ndarray, y0: np.ndarray, m: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the windows into which each x is cut cost more than ``most`` edits even if each takes the part of y that suits it best; so the pair costs more, too.

    An alignment of ``most`` edits shifts no character by more than half of them, give or take half of what y is longer.
    """
    x, y = _classes(dx), _classes(dy)
    out, cost, windows = np.zeros(len(n), bool), np.zeros(len(n), np.int64), -(-n // _WINDOW)
    back, ahead = (most - (m - n)) // 2, (most + (m - n)) // 2
    live = np.flatnonzero((n > 0) & (m > 0))
    for w in range(int(windows.max(initial=0))):
        live = live[(w < windows[live]) & ~out[live]]
        if len(live) < _SHARED:
            break
        for r in _chunks(live, most[live] + _WINDOW, 1 << 19):
            if len(r) < _SHARED:  # what is not counted costs nothing
                continue
            a, b = n[r] * w // windows[r], n[r] * (w + 1) // windows[r]
            first, end = np.clip(a - back[r], 0, m[r]), np.clip(b + ahead[r], 0, m[r])
            cost[r] += _least_within(x, x0[r] + a, b - a, y, y0[r] + first, np.maximum(0, end - first))
        out[live] = cost[live] > most[live]
    return out


#: Lengths of the runs of classes by which pieces are told apart, and the odd factors that deal them out to places of a table.
_PIECES = ((3, 0x9E3779B1), (4, 0x85EBCA6B), (5, 0xC2B2AE35))
#: Pairs that go on step by step together, and the places (eight bytes each) of their tables; one line's table may have more.
_TOGETHER, _PLACES = 16384, 1 << 21


def _codes(c: np.ndarray) -> np.ndarray:
    """The five classes from each place on as one number, six bits each; one more than there are classes."""
    wide = np.concatenate([c, np.zeros(5, np.uint8)]).astype(np.uint32)
    out = np.zeros(len(c) + 1, np.uint32)
    for j in range(5):
        out |= wide[j : j + len(out)] << np.uint32(6 * j)
    return out


def in_pieces_apart(c: np.ndarray, x0: np.ndarray, n: np.ndarray, y0: np.ndarray, m: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether y has more than ``most`` pieces, end to end, that x lacks where ``most`` edits could have left them; so the pair costs more, too.

    ``most`` edits shift no character by more than half of them, give or take half of what x is longer; each piece of three, four or five classes that x lacks
    there costs an edit of its own. A table for each x holds the places of all its pieces, in 64 stretches, and two pieces may share an entry: that only hides edits.
    """
    out, codes = np.zeros(len(n), bool), _codes(c)
    todo = np.flatnonzero((most > 0) & (m > 3 * most) & (np.abs(n - m) <= most))
    size = np.minimum(np.frexp(np.maximum(n, 8))[1] + 2, 24)  # bits of a place in the table: four to eight for each character of x
    todo = todo[np.lexsort((x0[todo], np.log2(most[todo]).astype(np.int64), size[todo]))]
    new = np.concatenate([[True], (x0[todo][1:] != x0[todo][:-1]) | (size[todo][1:] != size[todo][:-1]) | (n[todo][1:] != n[todo][:-1])]) if len(todo) else np.zeros(0, bool)
    line = np.cumsum(new)
    at = 0
    while at < len(todo):
        bits = int(size[todo[at]])
        end = min(at + _TOGETHER, int(np.searchsorted(size[todo], bits, "right")), int(np.searchsorted(line, line[at] + max(1, _PLACES >> bits), "left")))
        r = todo[at:end]
        if len(r) >= _SHARED:  # fewer do not share a step's cost
            out[r] = _pieces_beyond(codes, x0[r], n[r], line[at:end] - line[at], y0[r], m[r], most[r], bits)
        at = end
    return out


def _pieces_beyond(codes: np.ndarray, x0: np.ndarray, n: np.ndarray, line: np.ndarray, y0: np.ndarray, m: np.ndarray, most: np.ndarray, bits: int) -> np.ndarray:
    full, down = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint32(32 - bits)
    kinds = [(q, np.uint32((1 << 6 * q) - 1), np.uint32(f)) for q, f in _PIECES]
    shift = np.maximum(0, np.frexp(n - 1)[1].astype(np.int64) - 6)
    table = np.zeros((int(line[-1]) + 1) << bits, np.uint64)
    first = np.unique(line, return_index=True)[1]
    inside = np.arange(int(n[first].sum())) - np.repeat(np.cumsum(n[first]) - n[first], n[first])
    own, base = codes[np.repeat(x0[first], n[first]) + inside], np.repeat(line[first] << bits, n[first])
    mark, left = np.uint64(1) << (inside >> np.repeat(shift[first], n[first])).astype(np.uint64), np.repeat(n[first], n[first]) - inside
    for q, low, factor in kinds:
        ok = left >= q
        np.bitwise_or.at(table, (base + (((own & low) * factor) >> down))[ok], mark[ok])
    base, lag = line << bits, (most - (n - m)) // 2
    where = full >> (63 - np.minimum(63, (most >> shift) + 1)).astype(np.uint64)  # the stretches that a piece may have come from, in the first place
    at, lacking, who, out = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.arange(len(n)), np.zeros(len(n), bool)
    (_, low3, by3), (_, low4, by4), (_, low5, by5) = kinds
    while len(who):
        for _ in range(8):
            code = codes.take(y0 + at)
            here = where << (np.maximum(at - lag, 0) >> shift).view(np.uint64)
            lacks = (table.take(base + (((code & low3) * by3) >> down)) & here) == 0
            step = np.full(len(who), 3)
            r = np.flatnonzero(~lacks)
            code, here, of = code[r], here[r], base[r]
            lacks4 = (table.take(of + (((code & low4) * by4) >> down)) & here) == 0
            lacks[r], step[r] = lacks4, 4
            k = np.flatnonzero(~lacks4)
            r = r[k]
            lacks[r], step[r] = (table.take(of[k] + (((code[k] & low5) * by5) >> down)) & here[k]) == 0, 5
            inside = at + step <= m
            lacks &= inside
            lacking += lacks
            step *= inside
            at += step
        out[who[lacking > most]] = True
        keep = inside & (lacking <= most) & (lacking + (m - at) // 3 > most)
        if not keep.all():
            who, at, lacking, y0, m, most, base, lag, shift, where = (v[keep] for v in (who, at, lacking, y0, m, most, base, lag, shift, where))
    return out


def _bag_gap(x: np.ndarray, y: np.ndarray, rows: int, classes: int) -> np.ndarray:
    """Of two bags of classes for each row, the larger of what one has over the other."""
    over = (np.bincount(x, minlength=rows * classes).astype(np.int32) - np.bincount(y, minlength=rows * classes).astype(np.int32)).reshape(rows, classes)
    both, more = np.abs(over).sum(1), over.sum(1)
    return (both + np.abs(more)) // 2


#: Lines of more code points than this are compared one by one, with vectors as long as the line.
LONG_LINE = 1024


#: Pairs that may differ by so many edits are compared one by one, all others in a band of diagonals, many pairs at a time.
_BAND = 1024
#: Fewer pairs than this are compared one by one, with whole-number bit vectors.
_FEW = 24


def similar(x: list[str], y: list[str], percent: int) -> np.ndarray:
    """Whether the Levenshtein distance of each x and y is at most 100 - ``percent`` hundredths of the longer one; exact."""
    n, m = (np.array([len(t) for t in s], np.int64) for s in (x, y))
    most = np.maximum(n, m) * (100 - percent) // 100
    (dx, ox), (dy, oy) = _code_points(x), _code_points(y)
    head, tail = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    near = np.abs(n - m) <= most
    for i in np.flatnonzero(near):
        head[i], tail[i] = _equal_ends(dx[ox[i] : ox[i + 1]], dy[oy[i] : oy[i + 1]])
    d, rest = np.concatenate([dx, dy]), np.maximum(n, m) - head - tail
    todo = np.flatnonzero(near & (rest > most))  # replacing all that is left costs no more than that
    ends = (head + tail)[todo]
    near[todo] = within(d, _classes(d), ox[todo] + head[todo], n[todo] - ends, oy[todo] + len(dx) + head[todo], m[todo] - ends, most[todo])
    return near


def _equal_ends(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """How many leading code points of two runs are equal, and how many of the rest's last ones."""
    size = min(len(x), len(y))
    unlike = (int.from_bytes(x[:size].tobytes(), "little") ^ int.from_bytes(y[:size].tobytes(), "little"))
    head = ((unlike & -unlike).bit_length() - 1) // 32 if unlike else size
    size -= head
    unlike = int.from_bytes(x[len(x) - size :].tobytes(), "little") ^ int.from_bytes(y[len(y) - size :].tobytes(), "little")
    return head, size - -(-unlike.bit_length() // 32)


def within(d: np.ndarray, c: np.ndarray, x0: np.ndarray, n: np.ndarray, y0: np.ndarray, m: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the Levenshtein distance of two runs each of the code points ``d``, of classes ``c``, is at most ``most``; exact.

    The distance of classes is never larger; where it is small enough and both runs have characters of shared classes, the characters decide.
    """
    swap = n > m
    x0, n, y0, m = np.where(swap, y0, x0), np.where(swap, m, n), np.where(swap, x0, y0), np.where(swap, n, m)
    ok = m - n <= most
    todo = np.flatnonzero(ok & (most < _BAND))
    todo = todo[np.argsort(m[todo], kind="stable")]
    at = 0
    while at < len(todo):
        first = todo[at]
        end = min(len(todo), at + max(256, 8192 // (most[first] // 64 + 2)))
        end = max(min(end, at + _SHARED), min(end, int(np.searchsorted(m[todo], m[first] * 3 // 2 + _WINDOW, "right"))))
        r = todo[at:end]
        at = end
        if len(r) < _FEW:
            ok[r] = [_one_within(d[x0[i] : x0[i] + n[i]], d[y0[i] : y0[i] + m[i]], int(most[i])) for i in r]
        else:
            ok[r] = ~beyond(c, x0[r], n[r], y0[r], m[r], most[r])
    doubt = todo[ok[todo]]
    doubt = doubt[[bool((c[x0[i] : x0[i] + n[i]] >= _SHARED_CLASS).any() and (c[y0[i] : y0[i] + m[i]] >= _SHARED_CLASS).any()) for i in doubt]] if len(doubt) else doubt
    ok[doubt] = _distances(d, x0[doubt], n[doubt], d, y0[doubt], m[doubt]) <= most[doubt]
    long = np.flatnonzero(ok & (most >= _BAND))
    for i in long:
        ok[i] = _one_within(d[x0[i] : x0[i] + n[i]], d[y0[i] : y0[i] + m[i]], int(most[i]))
    return ok


def _string(d: np.ndarray, at: int, size: int) -> str:
    return d[at : at + size].tobytes().decode("utf-32-le", "surrogatepass")


def _one_within(x: np.ndarray, y: np.ndarray, most: int) -> bool:
    """Whether two runs of code points, the shorter one first, are within ``most`` edits: what is equal at the ends is cut off; letters, runs of three characters and windows rule out most of the rest."""
    if _bag_gap(_classes(x).astype(np.int64), _classes(y).astype(np.int64), 1, 64)[0] > most:
        return False
    head, tail = _equal_ends(x, y)
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    if len(y) <= most:  # replacing all that is left costs no more than that
        return True
    grams = [((d[:-2] * 0x9E3779B1 + d[1:-1] * 0x85EBCA6B + d[2:] * 0xC2B2AE35) >> 7) % _GRAMS for d in (x.astype(np.int64), y.astype(np.int64))]
    if _bag_gap(*grams, 1, _GRAMS)[0] > 3 * most:  # an edit changes three grams of three characters at most
        return False
    return edit_distance(_string(x, 0, len(x)), _string(y, 0, len(y))) <= most


def beyond(c: np.ndarray, x0: np.ndarray, n: np.ndarray, y0: np.ndarray, m: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the Levenshtein distance of two runs each of the classes ``c``, of n and of m >= n, is more than ``most``.

    Bit vectors (Hyyroe) of the diagonals that ``most`` edits can reach only: these are at most ``most`` + 1 of them, a band that goes down by one row with each
    column. Along the diagonal on which the lines end the distance never falls; a pair is left as soon as it is too large there.
    """
    one, top, full = np.uint64(1), np.uint64(63), np.uint64(0xFFFFFFFFFFFFFFFF)
    d = m - n
    out = np.ones(len(n), bool)
    who = np.flatnonzero(d <= most)
    if not len(who):
        return out
    x0, n, y0, m, most, d = (a[who] for a in (x0, n, y0, m, most, d))
    lo = (most + d) // 2  # rows of the band above the main diagonal
    words, letters, steps = int(most.max()) // 64 + 1, 66, int(m.max())
    xs = np.full((len(n), (max(int((lo + n).max()), steps) // 64 + words + 2) * 64), _END_X, np.uint8)  # a line's characters stand at lo and beyond: the band of column j are the places from j on
    ys = np.full((len(n), steps + 32), _END_Y, np.uint8)
    for lines, start, size, shift in ((xs, x0, n, lo), (ys, y0, m, 0 * lo)):
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        lines.ravel()[np.repeat(np.arange(len(size)) * lines.shape[1] + shift, size) + place] = c[np.repeat(start, size) + place]
    score, end = d.copy(), lo - d
    table = np.zeros((len(n) * letters, words + 1), np.uint64)
    up = np.stack([np.where(lo >= 64 * (w + 1), np.uint64(0), full << np.clip(lo - 64 * w, 0, 63).astype(np.uint64)) for w in range(words)])
    down = np.zeros((words, len(n)), np.uint64)
    row = np.arange(len(n)) * letters

    def fill(w: int, at: int) -> None:
        word = table[:, w]
        for b, places in enumerate(np.ascontiguousarray(xs[:, at : at + 64].T) + row[None, :]):
            word[places] |= np.uint64(1 << b)

    for w in range(words + 1):
        fill(w, 64 * w)
    first, last = int(d.max()), int(m.min())
    for at in range(0, steps, 32):
        if at:
            near = score <= most
            out[who[near & (m <= at)]] = False
            keep = near & (m > at)
            left = int(keep.sum())
            if not left:
                return out
            if left < 0.9 * len(keep):
                n, m, most, d, score, end, who, xs, ys = (a[keep] for a in (n, m, most, d, score, end, who, xs, ys))
                table = table.reshape(-1, letters, words + 1)[keep].reshape(-1, words + 1)
                up, down = np.compress(keep, up, axis=1), np.compress(keep, down, axis=1)
                row, last = row[:left], int(m.min())
            if at % 64 == 0:
                table[:, :-1] = table[:, 1:]
                table[:, -1] = 0
                fill(words, at + 64 * words)
        which, shift = (end >> 6) * len(end) + np.arange(len(end)), (end & 63).astype(np.uint64)
        text = np.ascontiguousarray(ys[:, at : at + 32].T) + row[None, :]
        got, (eq, z, right), over = np.empty((len(end), words + 1), np.uint64), np.empty((3, *up.shape), np.uint64), np.empty(up.shape, bool)
        for j in range(at, min(steps, at + 32)):
            s = j & 63
            np.take(table, text[j - at], axis=0, out=got, mode="clip")
            np.right_shift(got.T[:-1], np.uint64(s), out=eq)
            if s:
                np.left_shift(got.T[1:], np.uint64(64 - s), out=z)
                eq |= z
            np.bitwise_and(eq, up, out=z)
            z += up
            if words > 1:
                np.less(z, up, out=over)
                z[1:] += over[:-1]
                carried = (z[1:] == 0) & over[:-1]  # a word of ones hands the carry on
                if carried.any():
                    for w in range(2, words):
                        more = carried[w - 2] & ~over[w - 1]
                        z[w] += more
                        carried[w - 1] |= more & (z[w] == 0)
            z ^= up
            z |= eq
            z |= down
            np.bitwise_or(z, up, out=right)
            np.invert(right, out=right)
            right |= down
            up &= z
            np.right_shift(z, one, out=eq)
            if words > 1:
                eq[:-1] |= z[1:] << top
            np.bitwise_and(eq, right, out=down)
            eq |= right
            np.invert(eq, out=eq)
            up |= eq
            bit = z.ravel()[which] >> shift
            bit &= one
            bit ^= one
            more = bit.view(np.int64)
            if j < first:
                more *= j >= d
            if j >= last:
                more *= j < m
            score += more
    out[who[score <= most]] = False
    return out


def _chunks(rows: np.ndarray, size: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Runs of rows, sorted by size, whose padded matrix has about ``most`` cells."""
    at = 0
    while at < len(rows):
        end = at + 1
        while end < len(rows) and size[min(len(rows) - 1, end + 63)] * (end - at + 64) <= most:
            end = min(len(rows), end + 64)
        yield rows[at:end]
        at = end


def _distances(dx: np.ndarray, x0: np.ndarray, n: np.ndarray, dy: np.ndarray, y0: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Levenshtein distances of many pairs of runs of code points, 64 rows of the table in one number."""
    swap = n > m
    out = np.maximum(n, m)
    a0, na, b0, nb = np.where(swap, y0, x0), np.where(swap, m, n), np.where(swap, x0, y0), np.where(swap, n, m)
    words = -(-na // 64)
    for w in np.unique(words[na > 0]):
        everyone = np.flatnonzero((words == w) & (na > 0))
        everyone = everyone[np.argsort(-nb[everyone], kind="stable")]
        if len(everyone) < 30 * w:  # too few to share the steps
            for i in everyone:
                a, b = (d[f : f + size].tobytes().decode("utf-32-le", "surrogatepass") for d, f, size in ((dx, x0[i], n[i]), (dy, y0[i], m[i])))
                out[i] = edit_distance(a, b)
            continue
        for at in range(0, len(everyone), 2048):
            r = everyone[at : at + 2048]
            short = np.where(swap[r][:, None], _padded(dy, a0[r], na[r], 0xFFFFFFFF), _padded(dx, a0[r], na[r], 0xFFFFFFFF))
            long = np.where(swap[r][:, None], _padded(dx, b0[r], nb[r], 0xFFFFFFFE), _padded(dy, b0[r], nb[r], 0xFFFFFFFE))
            out[r] = _bit_distances(short, na[r], long, nb[r], int(w))
    return out


def _bit_distances(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, words: int) -> np.ndarray:
    one, top = np.uint64(1), np.uint64(63)
    p = len(a)
    row, col = np.nonzero(np.arange(a.shape[1])[None, :] < na[:, None])
    own = a[row, col]
    number = np.zeros(int(own.max()) + 2, np.int64)  # by code point; letters that the shorter one lacks are all 0
    number[own] = 1
    letters = np.cumsum(number)
    number = np.where(number > 0, letters, 0)
    ca, cb = number[np.minimum(a, len(number) - 1)], number[np.minimum(b, len(number) - 1)]
    match = np.zeros((p, int(letters[-1]) + 1, words), np.uint64)
    np.bitwise_or.at(match, (row, ca[row, col], col >> 6), one << (col & 63).astype(np.uint64))
    up = np.full((words, p), np.uint64(0xFFFFFFFFFFFFFFFF))
    down = np.zeros((words, p), np.uint64)
    last = ((na - 1) & 63).astype(np.uint64)
    score, everyone = na.copy(), np.arange(p)
    live = np.searchsorted(-nb, -np.arange(b.shape[1]), "left")  # longer ones stand first
    for j in range(b.shape[1]):
        k = live[j]
        eqs = match[everyone[:k], cb[:k, j]]
        plus, minus = np.ones(k, np.uint64), np.zeros(k, np.uint64)
        for w in range(words):
            eq, u, d = eqs[:, w], up[w, :k], down[w, :k]
            vertical = eq | d
            eq = eq | minus
            diagonal = (((eq & u) + u) ^ u) | eq
            right = d | ~(diagonal | u)
            left = u & diagonal
            if w == words - 1:
                score[:k] += ((right >> last[:k]) & one).astype(np.int64) - ((left >> last[:k]) & one).astype(np.int64)
            over, under = right >> top, left >> top
            right, left = (right << one) | plus, (left << one) | minus
            up[w, :k] = left | ~(vertical | right)
            down[w, :k] = right & vertical
            plus, minus = over, under
    return score


#: Lines and bytes of text of which the features are made at once, whole buckets; one bucket may have more.
_GROUP, _GROUP_BYTES = 4096, 4 << 20
#: Buckets of up to so many lines give their pairs together with all others of their size.
_SMALL = 64


def grouped(buckets: Iterator[pa.Table]) -> Iterator[list[pa.Table]]:
    """The buckets, gathered."""
    held, rows, size = [], 0, 0
    for t in buckets:
        held.append(t)
        rows, size = rows + t.num_rows, size + t.column("text").nbytes
        if rows >= _GROUP or size >= _GROUP_BYTES:
            yield held
            held, rows, size = [], 0, 0
    if held:
        yield held


def meetings(buckets: list[pa.Table], node: np.ndarray, root: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (by number of row in all buckets) of lines of one bucket, or of two of its blocks, that are of different roots."""
    size = np.array([b.num_rows for b in buckets])
    first = np.cumsum(size) - size
    whole = np.array([b.column("i")[0].as_py() == b.column("j")[0].as_py() for b in buckets])
    for k in np.unique(size[whole & (size <= _SMALL)]):
        i, j = np.triu_indices(k, 1)
        starts = first[whole & (size == k)][:, None]
        x, y = (starts + i[None, :]).ravel(), (starts + j[None, :]).ravel()
        apart = root[x] != root[y]
        yield x[apart], y[apart]
    for b in np.flatnonzero(~(whole & (size <= _SMALL))):
        for x, y in meeting(buckets[b], percent, 8):
            yield x + first[b], y + first[b]


def candidates(buckets: list[pa.Table], percent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(code points, classes, nodes a and b, first character and size of a's line and of b's, bits of SimHash apart): pairs of lines of one bucket that are of different roots; a pair comes from the least key that it shares only.

    The screens, sizes and letters, drop only what cannot meet the threshold. SimHashes drop nothing here, they say which pairs come first.
    """
    t = pa.concat_tables(buckets)
    node, root, sim = (t.column(c).to_numpy() for c in ("node", "root", "s0"))
    key = np.repeat([b.column("key")[0].as_py() for b in buckets], [b.num_rows for b in buckets])
    bands = t.column("bands").combine_chunks()
    values, ends = bands.flatten().to_numpy(), np.cumsum(pc.list_value_length(bands).to_numpy())
    starts = np.concatenate([[0], ends[:-1]])
    keys = values[np.minimum(starts[:, None] + np.arange(int((ends - starts).max()))[None, :], ends[:, None] - 1)]
    d, off = _code_points(t.column("text").to_pylist())
    c, start, n = _classes(d), off[:-1], np.diff(off)
    letters = np.bincount(np.repeat(np.arange(len(n)) * 64, n) + c, minlength=64 * len(n)).reshape(-1, 64).astype(np.int32 if n.max() >= 1 << 15 else np.int16)
    for x, y in meetings(buckets, node, root, percent):
        for at in range(0, len(x), 8192):
            p, q = x[at : at + 8192], y[at : at + 8192]
            most = np.maximum(n[p], n[q]) * (100 - percent) // 100
            ok = np.abs(n[p] - n[q]) <= most
            p, q, most = p[ok], q[ok], most[ok]
            ok = np.abs(letters[p] - letters[q]).sum(1, dtype=np.int64) + np.abs(n[p] - n[q]) <= 2 * most
            p, q = p[ok], q[ok]
            here = np.where((keys[p][:, :, None] == keys[q][:, None, :]).any(2), keys[p], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
            ok = here == key[p]
            p, q = p[ok], q[ok]
            if len(p):
                yield d, c, node[p], node[q], start[p], n[p], start[q], n[q], np.bitwise_count(sim[p] ^ sim[q])


def true_links(buckets: Iterator[pa.Table], percent: int, rows: int = 1 << 16, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs of ``candidates`` whose texts are similar; pairs are gathered, so that many share the steps.

    Pieces rule out most pairs before any is compared. Pairs that have most in common come first, and what links that were found in this task connect already is not compared again.
    """
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def settled(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        texts = {id(h[0]): h[:2] for h in held}
        base = dict(zip(texts, np.cumsum([0, *(len(d) for d, _ in texts.values())])))
        d, c = (np.concatenate([t[i] for t in texts.values()]) for i in (0, 1))
        a, b, x0, n, y0, m, apart = (np.concatenate([h[i] + base[id(h[0])] if i in (4, 6) else h[i] for h in held]) for i in range(2, 9))
        order = np.argsort(apart, kind="stable")
        order = order[~in_pieces_apart(c, x0, n, y0, m, np.maximum(n, m) * (100 - percent) // 100)[order]]
        for at in range(0, len(order), rows // 4):
            r = order[at : at + rows // 4]
            if parent:
                r = r[[top(x) != top(y) for x, y in zip(a[r].tolist(), b[r].tolist())]]
            r = r[within(d, c, x0[r], n[r], y0[r], m[r], np.maximum(n[r], m[r]) * (100 - percent) // 100)]
            for x, y in zip(a[r].tolist(), b[r].tolist()):
                x, y = top(x), top(y)
                parent[max(x, y)] = min(x, y)
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(a[r]), pa.array(b[r])], ["a", "b"])

    held, count, size, last = [], 0, 0, None
    for group in grouped(buckets):
        for found in candidates(group, percent):
            if held and (count >= rows or size >= most):
                yield from settled(held)
                held, count, size, last = [], 0, 0, None
            held.append(found)
            count += len(found[2])
            size += 0 if found[0] is last else len(found[0])
            last = found[0]
    if held:
        yield from settled(held)


def gram_bitmaps(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts, 64) words of bits that the runs of three characters of each text set, and how many they are."""
    return _gram_bitmaps(*_code_points(texts))


def _gram_bitmaps(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out, count = np.zeros((len(off) - 1, 64), np.uint64), np.zeros(len(off) - 1, np.int64)
    for at in range(0, len(off) - 1, 512):
        part = off[at : at + 513]
        d, row = data[part[0] : part[-1]].astype(np.int64), np.repeat(np.arange(len(part) - 1), np.diff(part))
        same = row[2:] == row[:-2]
        place = ((d[:-2] * 0x9E3779B1 + d[1:-1] * 0x85EBCA6B + d[2:] * 0xC2B2AE35) >> 7)[same] % 4096
        bits = np.zeros((len(part) - 1, 4096), np.uint8)
        bits[row[2:][same], place] = 1
        out[at : at + 512], count[at : at + 512] = np.packbits(bits, axis=1).view(np.uint64), bits.sum(1, dtype=np.int64)
    return out, count


def most_grams(n: np.ndarray, percent: int) -> np.ndarray:
    """Runs of three characters in which two lines may differ, by the longer one's size: three an edit, which holds always."""
    return 3.0 * (n * (100 - percent) // 100)


def _radius(n: np.ndarray) -> np.ndarray:
    return np.where(n < SHORT, 64, RADIUS)


#: Bits of 64 in which the SimHashes of lines may differ that are compared in the first round: a quarter of the words replaced makes 15 with a deviation of 3.5.
RADIUS = 24
#: Lines of fewer code points have too few words for the screen.
SHORT = 48


def fuzzy_lines(docs: DataFrame, percent: int = 80, blocks: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, component struct<id, pos>, repeated, removed) for every \\n-separated line with a word.

    Two lines link if the Levenshtein distance of their normalised forms is at most 100 - ``percent`` hundredths of the longer one.
    Candidates have one of ``blocks`` blocks of words in common, which a few changes must leave whole (pigeonhole), or, with up to three words, half of the
    line; SimHashes that differ in more than RADIUS bits put a pair off to the last round, in which all that share a block and are not connected yet are compared. Of
    every connected group the line with the smallest (id, position) stays. Nulls, empty
    texts and lines without words have no rows; rows that repeat an id count as the same lines; an empty table gives an empty one;
    other columns are ignored.
    """
    def alike(a: str, b: str):
        near = F.bit_count(F.col(f"{a}s0").bitwiseXOR(F.col(f"{b}s0"))) <= F.when(F.least(f"{a}n", f"{b}n") < SHORT, 64).otherwise(RADIUS)
        return near & (F.least(f"{a}n", f"{b}n") * 100 >= F.greatest(f"{a}n", f"{b}n") * percent)

    def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with np.errstate(over="ignore"):
                for big in batches:
                    for b in pieces(iter([big]), "ta", 4 << 20):
                        for c in pieces(iter([b]), "tb", 4 << 20):
                            ok = similar(c.column("ta").to_pylist(), c.column("tb").to_pylist(), percent)
                            yield c.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")

    def finish(members: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
        rows = nodes.select("node", "n", "s0", "bands").join(texts, "node")
        return in_blocks(members.join(rows, "node"), lambda t: iter([t]), "a long, b long", lambda buckets: true_links(buckets, percent))

    found = linked_classes(line_signatures(docs, id_col, text_col, blocks), lambda wanted: wanted_lines(docs, wanted, id_col, text_col), ["n", "bands", "s0"], alike, confirmed, finish, turns=0, meet=shared_blocks)
    return found.select(F.col("uid.id").alias(id_col), F.col("uid.pos").alias("pos"), "component", (F.col("members") > 1).alias("repeated"), (~F.col("uid").eqNullSafe(F.col("component"))).alias("removed"))


def without_fuzzy_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the removed lines; the text is null only where it was null, all other columns stay."""
    gone = fuzzy_lines(docs, id_col=id_col, text_col=text_col, **how).where("removed").groupBy(F.col(id_col).alias("__id")).agg(F.collect_set("pos").alias("__gone"))
    kept = F.filter(F.transform(F.split(text_col, "\n"), lambda line, i: F.when(~F.array_contains("__gone", i), line)), lambda line: line.isNotNull())
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__id"]), "left").withColumn(text_col, text).select(*docs.columns)
