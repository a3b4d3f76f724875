"""Record profiles and exact shares, which problems 3 and 5 use, and problem 5's candidate pairs from content-defined segments.

Records with equal word sequences are one *text*, known by a 64-bit id; all work on pairs is done on texts, and
copies are only expanded at the end.

Segments. Of every SPREAD consecutive runs of SEGMENT words, the run with the least hash is one of the text's
segments, so two texts that share SEGMENT + SPREAD - 1 consecutive words share a segment wherever it stands.
Texts of at most SMALL shingles also take every five-word shingle as a segment, as do those that can pair with them,
and tangled texts.

Bound. At share t, texts of n_x and n_y distinct five-word shingles have o >= t / (1 + t) (n_x + n_y) of them in
common. An edit (or the edge of a moved passage) leaves at least four of each text's shingles without a partner, so at most
e = (n_x + n_y - 2 o) / 8 edits part the common words into e + 1 runs, and these hold at least
(o - 7 (e + 1)) / 5 common segments. Half of that is asked for (``least_common``), at least one.

Tangled texts. Texts may also share shingles in another order without an edit wherever four words go on in several ways
(long texts over a tiny vocabulary, such as answer keys), and then few longer segments. Shingles that both texts have and that follow
each other in one do so in the other unless the four words between them go on in several ways there, so the bound
holds if one of the two seldom has such words. A text is tangled if it has more than TANGLED further ways on a shingle:
distinct shingles less distinct four-word runs. Two tangled texts meet in their five-word shingles, of which they share o, more than is asked for.

Steps. A block of segments counts each segment's texts exactly and drops segments of one text. The
text gets its segments back with these counts: with m left, texts at or above t still meet in the m - c + 1 rarest
of both; one and a half times the bound is kept so that chance meetings can be discarded by count. Only those are multiplied out.
Blocks are as many as the measured size of the input asks for. A segment of more than HOT texts is cut into parts of its texts,
and every two parts meet in a cell of their own. Long texts that share templates meet by chance in one or two segments where a dozen are asked for,
and the number of such pairs grows with the square of the corpus; so each text brings a sketch of 32 bytes to the product (``sketches``, ``alike``), by which
nearly all of them end before they are written. What is left is held against a bitmap of each text's shingles: o is at most a
text's shingles less its bits that the other lacks (``possible``), so most chance pairs end there and no words travel for them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qanat.llm.runtime import cut, maybe_in, membership_filter, partitions, record_text, stored_bytes
from qanat.llm.textcore import SHINGLE, chunks, consistent_form, least_runs, mix, range_hashes, set_of, shingles, words

SEGMENT, SPREAD, SMALL = 8, 5, 64
TANGLED = 1 / 32
#: Pairs of segments that one step of a block's product holds at once.
STEP = 1 << 19
#: Bytes that a block should have, and bytes above which its segments are counted in parts.
BLOCK, HOT_BLOCK = 32 << 20, 64 << 20
#: Texts of a segment above which its pairs are made in cells.
HOT = 16_384
#: Shingles from which on a text's sketch is of its least hashes; those of smaller texts are bitmaps.
SKETCHED = 256
#: Standard deviations below its mean that the count of equal least hashes may lie: a pair at the threshold is lost once in a thousand million.
DEVIATIONS = 6.0
#: Bits of a text's bitmap: a power of two from twice its shingles on, within these limits.
LEAST_BITMAP, MOST_BITMAP = 64, 1 << 15


def least_common(nx: np.ndarray, ny: np.ndarray, t: float) -> np.ndarray:
    """Segments that two texts of these sizes share at least, if their share is t or more."""
    o = t / (1 + t) * (nx + ny)
    e = (nx + ny - 2 * o) / 8
    return np.maximum(1, np.floor((o - 7 * (e + 1)) / 10)).astype(np.int64)


def chosen(n: np.ndarray, m: np.ndarray, t: float) -> np.ndarray:
    """How many of its m shared segments, rarest first, a text of n shingles sends on: its smallest possible partner decides."""
    c = np.minimum(least_common(n, n * t, t), least_common(n, n, t))
    return np.where(m < c, 0, np.minimum(m, m - c + 1 + c // 2))


def texts(rows: DataFrame, objective: bool, *more: str) -> DataFrame:
    return rows.where("row_id IS NOT NULL").select("row_id", *more, record_text(objective).alias("text"))


def batches(b: pa.RecordBatch):
    """(slice of b, word hashes, text numbers) in pieces of bounded size."""
    text = b.column("text")
    sizes = pc.utf8_length(text).to_numpy(zero_copy_only=False) if len(text) else []
    for i, j in chunks(sizes):
        h, of = words(consistent_form(text.slice(i, j - i)).to_pylist())
        yield b.slice(i, j - i), h, of


def distinct(s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (s, t), sorted by t and s."""
    order = np.lexsort((s, t))
    s, t = s[order], t[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    return s[first], t[first]


def text_ids(h: np.ndarray, of: np.ndarray, count: int) -> np.ndarray:
    bounds = np.searchsorted(of, np.arange(count + 1))
    return range_hashes(h, bounds[:-1], bounds[1:]).view(np.int64)


def tangled(h: np.ndarray, of: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which texts of a batch, of n shingles each, go on in several ways after many of their four-word runs."""
    runs, own = shingles(h, of, SHINGLE - 1)
    wide = np.uint64(64 - max(1, len(n)).bit_length())
    key = np.sort((own.astype(np.uint64) << wide) | (runs >> (np.uint64(64) - wide)))  # the text, then as much of the hash as fits
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    return n - np.bincount((key[first] >> wide).astype(np.int64), minlength=len(n)) > TANGLED * n


def segments(h: np.ndarray, of: np.ndarray, n: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (segment, text number) of a batch of texts of n shingles each."""
    at, g = least_runs(h, of, SEGMENT, SEGMENT + SPREAD - 1)
    large = n[of[at]] > SMALL
    s, own = shingles(*(x[((n <= SMALL / t) | tangled(h, of, n))[of]] for x in (h, of)))
    return distinct(np.concatenate([g[large], ~s]), np.concatenate([of[at][large], own]))


def bitmaps(s: np.ndarray, own: np.ndarray, n: np.ndarray) -> list[bytes]:
    """By text: a bit for the low end of each of its shingles' hashes."""
    size = np.clip(1 << np.ceil(np.log2(np.maximum(1, 2 * n))).astype(np.int64), LEAST_BITMAP, MOST_BITMAP)
    start = np.cumsum(size) - size
    bits = np.zeros(int(size.sum()), bool)
    bits[start[own] + (s & (size[own] - 1).astype(np.uint64)).astype(np.int64)] = True
    packed = np.packbits(bits, bitorder="little").tobytes()
    return [packed[i:j] for i, j in zip((start // 8).tolist(), ((start + size) // 8).tolist())]


def sketches(s: np.ndarray, own: np.ndarray, n: np.ndarray) -> np.ndarray:
    """By text four words: of less than SKETCHED shingles a bitmap of their hashes; of more, for each of 128 ranges of hashes, two bits of the
    least shingle in it, all low bits before all high ones. Input sorted by text and hash; an empty range has the bits of its number."""
    small = n[own] < SKETCHED
    bits = np.zeros((len(n), 256), bool)
    bits[own[small], (s[small] >> np.uint64(56)).astype(np.int64)] = True
    s, own = s[~small], own[~small]
    large = np.flatnonzero(n >= SKETCHED)
    codes = np.broadcast_to(np.arange(128, dtype=np.uint8) & 3, (len(n), 128)).copy()
    place = own.astype(np.int64) * 128 + (s >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
    codes.reshape(-1)[place[first]] = (s[first] & np.uint64(3)).astype(np.uint8)
    bits[large, :128], bits[large, 128:] = codes[large] & 1, codes[large] >> 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def alike(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, t: float) -> np.ndarray:
    """Whether the sketches of two texts allow a share of t. Bitmaps prove what they deny; least hashes of two texts at share t are
    equal, or their two bits by chance, with probability t + (1 - t) / 4 or more in each range. A bitmap and least hashes deny nothing."""
    a, b = nx < SKETCHED, ny < SKETCHED
    only = lambda p, q: np.bitwise_count(p & ~q).sum(axis=1)
    lacking = np.minimum(nx - only(x, y), ny - only(y, x)) < t / (1 + t) * (nx + ny) - 1e-6
    differ = x ^ y
    equal = 128 - np.bitwise_count(differ[:, :2] | differ[:, 2:]).sum(axis=1).astype(np.int64)
    p = t + (1 - t) / 4
    unlike = equal < 128 * p - DEVIATIONS * math.sqrt(128 * p * (1 - p))
    return ~((a & b & lacking) | (~a & ~b & unlike))


def most_common(x: bytes, nx: int, y: bytes, ny: int) -> int:
    """At most so many shingles are in both: each bit that one lacks is a shingle of the other that it lacks."""
    size = 8 * min(len(x), len(y))
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    for over in range(max(len(x), len(y)) * 8 // size, 1, -1):
        if over & (over - 1) == 0:  # halve the longer one
            half = size * over // 2
            a, b = (a & ((1 << half) - 1)) | (a >> half), (b & ((1 << half) - 1)) | (b >> half)
    return min(nx - (a & ~b).bit_count(), ny - (b & ~a).bit_count())


def block_count(rows: DataFrame) -> int:
    """Blocks of about BLOCK bytes; packed segments take at most about three bytes for a byte of the stored texts."""
    return max(2 * partitions(rows.sparkSession), -(-3 * stored_bytes(rows) // BLOCK))


def profile(rows: DataFrame, objective: bool, t: float, blocks: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(records, bitmaps, sketches, segments): (row_id, text_id, n) per record, (text_id, n, bitmap) per text, and (block, body) of packed sketches and segments.

    One pass over all texts makes them: they leave it as rows of one table, which is written once.
    """
    head = ["row_id", "text_id", "n", "block", "body"]

    def run(source):
        for b in source:
            for part, h, of in batches(b):
                count = part.num_rows
                ids = text_ids(h, of, count)
                s, own = distinct(*shingles(h, of))
                n = np.bincount(own, minlength=count)
                yield pa.RecordBatch.from_arrays([part.column("row_id"), pa.array(ids), pa.array(n), pa.nulls(count, pa.int64()), pa.array(bitmaps(s, own, n), pa.binary())], head)
                use = np.zeros(count, bool)
                once = np.unique(ids, return_index=True)[1]  # copies within the batch are one text
                use[once] = True
                sketch = sketches(s, own, n)[once]
                to = home_of(ids[once], blocks)
                parts = [(k, np.concatenate([ids[once][to == k].view(np.uint64)[:, None], sketch[to == k]], axis=1)) for k in np.unique(to).tolist()]
                none = pa.nulls(len(parts), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, pa.array([-1 - k for k, _ in parts], pa.int64()), pa.array([x.tobytes() for _, x in parts], pa.binary())], head)
                sel = use[of]
                s, own = segments(h[sel], of[sel], n, t)
                packed = pack(((s >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64), s.astype(np.uint32), own, ids, n, np.zeros(count, np.int64))
                none = pa.nulls(len(packed), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, pa.array([k for k, _ in packed], pa.int64()), pa.array([x for _, x in packed], pa.binary())], head)

    both = cut(texts(rows, objective).mapInArrow(run, "row_id bigint, text_id bigint, n bigint, block bigint, body binary"))
    own = both.where("block IS NULL")
    records = cut(own.groupBy("row_id").agg(F.max("text_id").alias("text_id"), F.max("n").alias("n")))
    return records, own.select("text_id", "n", F.col("body").alias("bitmap")), both.where("block < 0").select((-1 - F.col("block")).alias("block"), "body"), both.where("block >= 0").select("block", "body")


def home_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    """The block in which a text's segments come together."""
    return ((ids.view(np.uint64) >> np.uint64(7)) % np.uint64(blocks)).astype(np.int64)


def pack(block: np.ndarray, name: np.ndarray, own: np.ndarray, ids: np.ndarray, n: np.ndarray, m: np.ndarray, extra: np.ndarray | None = None, sketch: np.ndarray | None = None) -> list[tuple[int, bytes]]:
    """(block, body): by block its texts (id, n, m, number of segments) and their segments' 32-bit names, with a 16-bit extra and the texts' sketches if given."""
    order = np.lexsort((own, block))
    name, own, block = name[order].astype(np.uint32), own[order], block[order]
    if extra is not None:
        extra = extra[order].astype(np.uint16)
    at = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
    out = []
    for i, j in zip(at.tolist(), [*at[1:].tolist(), len(block)]):
        first = np.flatnonzero(np.append(True, own[i + 1 : j] != own[i : j - 1]))
        u, c = own[i + first], np.diff(np.append(first, j - i))
        parts = [np.array([len(u)], np.int64), ids[u].astype(np.int64), n[u].astype(np.uint32), m[u].astype(np.uint32), c.astype(np.uint32), name[i:j]]
        more = ([] if extra is None else [extra[i:j]]) + ([] if sketch is None else [sketch[u]])
        out.append((int(block[i]), b"".join(x.tobytes() for x in parts + more)))
    return out


def unpack(bodies, with_extra: bool = False, with_sketch: bool = False) -> tuple[np.ndarray, ...]:
    """(name, id, n, m[, extra][, sketch]) of every segment in the bodies."""
    cols: list[list[np.ndarray]] = [[] for _ in range(4 + with_extra + with_sketch)]
    for x in bodies:
        x = x.as_py()
        (u,) = np.frombuffer(x, np.int64, 1)
        ids = np.frombuffer(x, np.int64, u, 8)
        n, m, c = (np.frombuffer(x, np.uint32, u, 8 + 8 * u + 4 * u * k) for k in range(3))
        total = int(c.sum())
        name = np.frombuffer(x, np.uint32, total, 8 + 20 * u)
        extra = [np.frombuffer(x, np.uint16, total, 8 + 20 * u + 4 * total)] if with_extra else []
        sketch = [np.repeat(np.frombuffer(x, np.uint64, 4 * u, len(x) - 32 * u).reshape(-1, 4), c, axis=0)] if with_sketch else []
        for col, v in zip(cols, [name, *(np.repeat(v, c) for v in (ids, n, m)), *extra, *sketch]):
            col.append(v)
    return tuple(np.concatenate(c) for c in cols)


def _once(name, ids, *more):
    """Without the copies that came from other batches; sorted by name and id."""
    order = np.lexsort((ids, name))
    name, ids, *more = (x[order] for x in (name, ids, *more))
    first = np.append(True, (name[1:] != name[:-1]) | (ids[1:] != ids[:-1]))
    return tuple(x[first] for x in (name, ids, *more))


def heat(df: np.ndarray) -> np.ndarray:
    """Numbers of texts in 16 bits, in the same order: up to HOT as they are, then HOT more than the parts of HOT texts."""
    return np.minimum(np.where(df <= HOT, df, HOT - (-df // HOT)), 65535)


def candidates(packed: DataFrame, sketch: DataFrame, t: float, blocks: int) -> DataFrame:
    """(a, b): pairs of different texts, a < b, that the bound can't discard.

    A block that a hot segment makes large is counted in parts of HOT_BLOCK bytes, whose tallies are merged.
    """
    schema = "block bigint, body binary"
    sizes = packed.groupBy("block").agg(F.sum(F.octet_length("body")).alias("bytes")).where(F.col("bytes") > HOT_BLOCK)
    parts = [(r.block, -(-r.bytes // HOT_BLOCK)) for r in sizes.collect()]  # blocks are made large enough to have few of these
    cold = packed.where(~F.col("block").isin([b for b, _ in parts])) if parts else packed

    def table(out: list[tuple[int, bytes]]) -> pa.Table:
        return pa.table({"block": pa.array([k for k, _ in out], pa.int64()), "body": pa.array([x for _, x in out], pa.binary())})

    def tally(name, ids) -> tuple[np.ndarray, ...]:
        """By segment: its name, number of texts, least and largest text; input sorted by name and id."""
        start = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
        end = np.append(start[1:], len(name))
        return name[start], end - start, ids[start], ids[end - 1]

    def send(k: int, name, ids, n, df) -> pa.Table:
        """Segments with their numbers of texts, back to the texts; the block goes along as m, so that names of two blocks stay apart."""
        u, first, own = np.unique(ids, return_index=True, return_inverse=True)
        return table(pack(home_of(u, blocks)[own], name, own, u, n[first], np.full(len(u), k), heat(df)))

    def count(x: pa.Table) -> pa.Table:
        """Segments that have another text."""
        k = x.column("block")[0].as_py()
        name, ids, n, _ = _once(*unpack(x.column("body")))
        _, df, low, high = tally(name, ids)
        keep = np.repeat(low != high, df)
        return send(k, name[keep], ids[keep], n[keep], np.repeat(df, df)[keep]) if keep.any() else table([])

    def part(x: pa.Table) -> pa.Table:
        """The tally of a part of a hot block."""
        k = x.column("block")[0].as_py()
        name, ids, _, _ = _once(*unpack(x.column("body")))
        name, df, low, high = tally(name, ids)
        return table([(k, b"".join(c.tobytes() for c in (np.array([len(name)], np.int64), low, high, df.astype(np.int64), name)))])

    def merge(x: pa.Table) -> pa.Table:
        """The tallies of all parts together: useful segments, sorted, and their numbers of texts."""
        k = x.column("block")[0].as_py()
        cols: list[list[np.ndarray]] = [[] for _ in range(4)]
        for body in x.column("body").to_pylist():
            (u,) = np.frombuffer(body, np.int64, 1)
            for col, v in zip(cols, (*(np.frombuffer(body, np.int64, u, 8 + 8 * u * i) for i in range(3)), np.frombuffer(body, np.uint32, u, 8 + 24 * u))):
                col.append(v)
        low, high, df, name = (np.concatenate(c) for c in cols)
        order = np.argsort(name, kind="stable")
        low, high, df, name = (c[order] for c in (low, high, df, name))
        start = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
        keep = np.minimum.reduceat(low, start) != np.maximum.reduceat(high, start)
        name, df = name[start][keep], np.add.reduceat(df, start)[keep]
        return table([(k, np.array([len(name)], np.int64).tobytes() + df.tobytes() + name.tobytes())])

    def sift(x: pa.Table, y: pa.Table) -> pa.Table:
        """A part's segments that the merged tally knows."""
        if not x.num_rows or not y.num_rows:
            return table([])
        k = x.column("block")[0].as_py()
        (body,) = y.column("body").to_pylist()
        (u,) = np.frombuffer(body, np.int64, 1)
        df, known = np.frombuffer(body, np.int64, u, 8), np.frombuffer(body, np.uint32, u, 8 + 8 * u)
        name, ids, n, _ = _once(*unpack(x.column("body")))
        at = np.minimum(np.searchsorted(known, name), max(0, u - 1))
        keep = known[at] == name if u else np.zeros(len(name), bool)
        return send(k, name[keep], ids[keep], n[keep], df[at][keep]) if keep.any() else table([])

    def choose(x: pa.Table, y: pa.Table) -> pa.Table:
        """Each text's rarest shared segments, as many as the bound asks for, to the cells where they meet others, with its sketch."""
        if not x.num_rows:
            return table([])
        name, ids, n, block, df = unpack(x.column("body"), True)
        u, first, own = np.unique(ids, return_index=True, return_inverse=True)
        order = np.lexsort((name, block, own))  # a text whose copies were counted in several parts comes with each
        order = order[np.append(True, (np.diff(name[order]) != 0) | (np.diff(block[order]) != 0) | (np.diff(own[order]) != 0))]
        name, block, df, own = name[order], block[order].astype(np.int64), df[order].astype(np.int64), own[order]
        m = np.bincount(own, minlength=len(u))
        order = np.lexsort((name, block, df, own))
        name, block, df, own = name[order], block[order], df[order], own[order]
        rank = np.arange(len(own)) - (np.cumsum(m) - m)[own]
        keep = rank < chosen(n[first].astype(np.int64), m, t)[own]
        name, block, df, own = name[keep], block[keep], df[keep], own[keep]
        cells = np.maximum(1, df - HOT)
        home = (mix(u)[own] % cells.astype(np.uint64)).astype(np.int64)
        at = np.repeat(np.arange(len(own)), cells)
        other = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
        low, high = np.minimum(home[at], other), np.maximum(home[at], other)
        known = np.concatenate([np.frombuffer(v, np.uint64).reshape(-1, 5) for v in y.column("sketch").to_pylist()])
        known = known[np.argsort(known[:, 0].view(np.int64), kind="stable")]
        sketch = known[np.searchsorted(known[:, 0].view(np.int64), u), 1:]
        return table(pack((block[at] << 32) | (low << 16) | high, name[at], own[at], u, n[first], m, home[at], sketch))

    def product(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cell's text by segment matrix times its transpose, offset by offset, so that a step holds at most STEP pairs however many texts a segment has."""
        x = pa.Table.from_batches(list(source))
        cell = x.column("block")[0].as_py()
        across = (cell >> 16) & 0xFFFF != cell & 0xFFFF
        name, ids, n, m, home, sketch = _once(*unpack(x.column("body"), True, True))
        n, m = n.astype(np.int64), m.astype(np.int64)
        held: list[np.ndarray] = []
        size = 0

        def settled() -> pa.RecordBatch:
            y = np.concatenate(held, axis=1)
            y = y[:, np.lexsort((y[1], y[0]))]
            at = np.flatnonzero(np.append(True, (y[:2, 1:] != y[:2, :-1]).any(axis=0)))
            return pa.RecordBatch.from_arrays([*(pa.array(v) for v in y[:, at]), pa.array(np.diff(np.append(at, y.shape[1])))], ["a", "b", "need", "common"])

        live, step = np.arange(len(name)), 1
        while len(live):
            live = live[live + step < len(name)]
            live = live[name[live] == name[live + step]]
            for i in range(0, len(live), STEP):
                p = live[i : i + STEP]
                q = p + step
                ok = np.minimum(n[p], n[q]) >= t * np.maximum(n[p], n[q]) - 1e-9
                if across:
                    ok &= home[p] != home[q]
                p, q = p[ok], q[ok]
                c = least_common(n[p], n[q], t)
                ok = np.minimum(m[p], m[q]) >= c
                p, q, c = p[ok], q[ok], c[ok]
                ok = alike(sketch[p], n[p], sketch[q], n[q], t)
                p, q, c = p[ok], q[ok], c[ok]
                need = np.maximum(1, np.minimum(c - m[p] + chosen(n[p], m[p], t), c - m[q] + chosen(n[q], m[q], t)))
                held.append(np.stack([np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q]), need]))
                size += len(p)
                if size >= STEP:
                    yield settled()
                    held, size = [], 0
            step += 1
        if size:
            yield settled()

    back = cold.groupBy("block").applyInArrow(count, schema)
    if parts:
        salts = F.broadcast(packed.sparkSession.createDataFrame(parts, "block bigint, parts int"))  # at most one row per block
        hot = packed.join(salts, "block").select("block", "body", F.pmod(F.xxhash64("body"), "parts").cast("int").alias("part"))
        tallies = hot.groupBy("block", "part").applyInArrow(part, schema).groupBy("block").applyInArrow(merge, schema)
        spread = tallies.join(salts, "block").select("block", "body", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        spread = spread.select(F.col("block").alias("b"), F.col("body").alias("body"), F.col("part").alias("p"))
        back = back.union(hot.groupBy("block", "part").cogroup(spread.groupBy("b", "p")).applyInArrow(sift, schema))
    sketch = sketch.select(F.col("block").alias("b"), F.col("body").alias("sketch"))
    rare = back.groupBy("block").cogroup(sketch.groupBy("b")).applyInArrow(choose, schema)
    pairs = rare.groupBy("block").applyInArrow(product, "a bigint, b bigint, need bigint, common bigint")
    return pairs.groupBy("a", "b").agg(F.max("need").alias("need"), F.sum("common").alias("common")).where("common >= need").select("a", "b")


def possible(pairs: DataFrame, maps: DataFrame, t: float) -> DataFrame:
    """The ``pairs`` (a, b) whose bitmaps allow a share of ``t``."""
    maps = maps.dropDuplicates(["text_id"])

    def run(source):
        for b in source:
            x, nx, y, ny = (b.column(c).to_pylist() for c in ("map_a", "n_a", "map_b", "n_b"))
            ok = [most_common(p, k, q, l) >= t / (1 + t) * (k + l) - 1e-6 for p, k, q, l in zip(x, nx, y, ny)]
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return pairs.join(maps.toDF("a", "n_a", "map_a"), "a").join(maps.toDF("b", "n_b", "map_b"), "b").mapInArrow(run, "a bigint, b bigint")


def with_words(pairs: DataFrame, rows: DataFrame, records: DataFrame, objective: bool) -> DataFrame:
    """``pairs`` (a, b) with the word hashes of both texts, as words_a and words_b.

    Only texts that occur in pairs travel: a fixed-size filter lets their rows through, an exact join follows.
    """
    used = pairs.select(F.col("a").alias("text_id")).union(pairs.select("b")).distinct()
    heads = cut(records.groupBy("text_id").agg(F.min("row_id").alias("row_id")).join(used, "text_id", "left_semi").select("row_id", "text_id"))
    packed = membership_filter(heads.select("row_id"))

    def run(source):
        for b in source:
            b = b.filter(pa.array(maybe_in(packed.value, b.column("row_id").to_numpy(zero_copy_only=False))))
            for part, h, of in batches(b):
                bounds = np.searchsorted(of, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column("row_id"), pa.array([h[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:])], pa.binary())], ["row_id", "words"])

    found = texts(rows, objective).mapInArrow(run, "row_id bigint, words binary").dropDuplicates(["row_id"]).join(heads, "row_id").select("text_id", "words")
    found = cut(found)
    return pairs.join(found.toDF("a", "words_a"), "a").join(found.toDF("b", "words_b"), "b").select("a", "b", "words_a", "words_b")


def share(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """(distinct shingles in both, in either) of two word sequences."""
    p, q = set_of(x), set_of(y)
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both, len(p) + len(q) - both


def at_least(both: int, either: int, t: float) -> bool:
    return either > 0 and both >= math.ceil(t * either - 1e-9)
