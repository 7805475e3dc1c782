"""Cropped and edited image copies from local descriptors.

Multiscale Harris corners, each with an orientation from its intensity centroid and 128 binary tests turned by it, in
256 steps (brightness, contrast and rotation leave them alone).  Descriptors that differ in at most two bits are one
visual word: any two such agree in one of three parts of 42 or 43 bits, the keys of the Hamming tables; crowded buckets
are split by a piece of the other bits.  Geometric consensus: a corner and its two nearest neighbours of the same scale
form a triangle; its key is the three words with the shape of the triangle (angles and the turn of each descriptor
against the sides), which cropping, shifting, scaling and turning keep.  Images that share a key are linked, and a class
is what links reach.

Scale: corners stay in groups of images, a row each, that never move.  What is dealt out are blocks of bytes, one for
each group and part: descriptors (16 bytes each) by the key of one Hamming table after the other, and triangle keys with
the first image that has them in the group, so that a key shared by a third of all images costs a row a group.  Of the
words only those that are near another are sent back, to the groups that have them.  Buckets give spanning links, never
all pairs.  A part's descriptors, or keys, are in one task's memory, so a single key of ten million different descriptors
would cost its task 160 MB for them and the same again to sort them.  Nothing is sampled or capped: a corner is a peak
among its own neighbours, so an image has as many as its area allows.

Images are binary PGM or PPM (P5, P6; 8 bits).  Defined results: null, empty or unreadable images have no corners and
are a class of their own; images without corners likewise; equal rows share a class; null ids are linked to nothing and
have the class null; an empty table gives none.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import bucketed, forget, text_udf, written
from .components import components, stars

SCALES = (1.0, 1.5)
RADIUS = 7
BITS = 128
MAX_BITS = 2
MIN_SIDE = 6.0
SHAPE_BINS = 12
TURNS = 256
HOT_BUCKET = 2000
_HEADER = re.compile(rb"\s*(P[56])\s+(\d+)\s+(\d+)\s+(\d+)\s")


def decode(data: bytes | None) -> np.ndarray | None:
    """A grey image (whole numbers in float32) of a binary PGM or PPM file, or None."""
    m = _HEADER.match(bytes(data)) if data else None
    if not m or int(m[4]) > 255:
        return None
    w, h, depth = int(m[2]), int(m[3]), 1 if m[1] == b"P5" else 3
    raw = np.frombuffer(bytes(data), np.uint8, offset=m.end())
    if len(raw) < w * h * depth or not w * h:
        return None
    image = raw[: w * h * depth].reshape(h, w, depth).astype(np.float32)
    return image[:, :, 0] if depth == 1 else np.rint(image @ np.array([0.299, 0.587, 0.114], np.float32))


def encode(image: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + np.clip(image, 0, 255).astype(np.uint8).tobytes()


def _tests() -> np.ndarray:
    """Pairs of points in the patch, (BITS, 2, 2), from a fixed generator."""
    p = np.random.default_rng(128).normal(0, RADIUS / 2.2, (BITS, 2, 2))
    return np.clip(p, -RADIUS + 1, RADIUS - 1)


_TESTS = _tests()
_GRID = np.stack(np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1].astype(np.float32))
_DISC = ((_GRID**2).sum(axis=0) <= RADIUS * RADIUS).astype(np.float32)


def _box(a: np.ndarray) -> np.ndarray:
    """Sum over 3 x 3, edges repeated."""
    rows = a.copy()
    rows[1:] += a[:-1]
    rows[:-1] += a[1:]
    rows[0] += a[0]
    rows[-1] += a[-1]
    out = rows.copy()
    out[:, 1:] += rows[:, :-1]
    out[:, :-1] += rows[:, 1:]
    out[:, 0] += rows[:, 0]
    out[:, -1] += rows[:, -1]
    return out


def _slopes(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Central differences down and across; none at the edges, where no corner is."""
    y, x = np.zeros_like(a), np.zeros_like(a)
    y[1:-1] = (a[2:] - a[:-2]) / 2
    x[:, 1:-1] = (a[:, 2:] - a[:, :-2]) / 2
    return y, x


def _peaks(a: np.ndarray, radius: int) -> np.ndarray:
    """The greatest value within ``radius`` rows and columns of each place: running maxima by doubling."""
    for axis in (0, 1):
        a = np.swapaxes(a, 0, axis)
        width, span = 2 * radius + 1, 1
        p = np.full((len(a) + 2 * radius, a.shape[1]), -1.0, a.dtype)
        p[radius : radius + len(a)] = a
        while span * 2 <= width:
            p = np.maximum(p[:-span], p[span:])
            span *= 2
        a = np.swapaxes(np.maximum(p[: len(a)], p[width - span : width - span + len(a)]), 0, axis)
    return a


def _turned_tests() -> np.ndarray:
    """The tests turned by each of TURNS angles, in whole pixels: (TURNS, 2 * BITS, 2), the first points before the second.

    Quarter turns are exact, so that a page turned by one has the same descriptors.
    """
    angle = np.arange(TURNS // 4)[:, None, None] * (2 * np.pi / TURNS)
    p = _TESTS.transpose(1, 0, 2).reshape(-1, 2)
    y, x = (np.rint(v).astype(np.int64) for v in (p[:, 0] * np.cos(angle) + p[:, 1] * np.sin(angle), p[:, 1] * np.cos(angle) - p[:, 0] * np.sin(angle)))
    out = []
    for _ in range(4):
        out.append(np.concatenate([y, x], axis=1))
        y, x = x, -y
    return np.concatenate(out).reshape(TURNS, 2, 2 * BITS).transpose(0, 2, 1)


_TURNED = _turned_tests()
_INSIDE = np.argwhere(_DISC > 0) - RADIUS


def _stack(images: list[np.ndarray], scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Images of one width at a scale, below each other, each with its first and last row once more: the sheet, and the
    image's position and row (from -1) of each of the sheet's rows."""
    tall = np.array([len(a) for a in images])
    rows = (tall / scale).astype(np.int64)
    of = np.repeat(np.arange(len(images)), rows + 2)
    row = np.arange(len(of)) - np.repeat(np.cumsum(rows + 2) - rows - 1, rows + 2)
    a, start = np.concatenate(images), (np.cumsum(tall) - tall)[of]
    y = np.clip(row, 0, rows[of] - 1) * scale
    y0 = y.astype(np.int64)
    if scale == 1:
        return a[start + y0], of, row
    x = np.arange(int(a.shape[1] / scale)) * scale
    x0 = x.astype(np.int64)
    fx, fy = (x - x0).astype(np.float32), (y - y0)[:, None].astype(np.float32)
    a = a[:, x0] * (1 - fx) + a[:, np.minimum(x0 + 1, a.shape[1] - 1)] * fx
    return a[start + y0] * (1 - fy) + a[start + np.minimum(y0 + 1, tall[of] - 1)] * fy, of, row


def corner_tables(images: list[np.ndarray | None]) -> list[np.ndarray]:
    """For each image the rows of ``corners``.  Images of one width are handled as one sheet.

    Greys are whole numbers, so sums of nine and moments are exact in float32: what else is in the sheet changes nothing.
    """
    found, by_width = [np.zeros((0, 7), np.int64)], {}
    for i, a in enumerate(images):
        if a is not None:
            by_width.setdefault(a.shape[1], []).append(i)
    m, least = RADIUS + 1, 2 * RADIUS + 3
    for width, some in by_width.items():
        for level, scale in enumerate(SCALES):
            which = np.array([i for i in some if int(len(images[i]) / scale) >= least])
            if int(width / scale) < least or not len(which):
                continue
            sheet, of, row = _stack([images[i] for i in which], scale)
            s = _box(sheet)
            gy, gx = _slopes(s)
            xx, yy, xy = _box(gx * gx), _box(gy * gy), _box(gx * gy)
            r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
            rows = np.bincount(of) - 2
            r[(row < m) | (row >= rows[of] - m)] = -1.0
            r[:, :m] = r[:, -m:] = -1.0
            y, x = np.nonzero((r == _peaks(r, RADIUS)) & (r > 9.0**4))
            flat, line = s.ravel(), s.shape[1]
            inside, weight = _INSIDE @ (line, 1), _INSIDE.astype(np.float32)
            tests = _TURNED @ (line, 1)
            for at in range(0, len(y), 4096):
                v, u = y[at : at + 4096], x[at : at + 4096]
                base = (v * line + u)[:, None]
                moment = (flat[base + inside] @ weight).astype(np.float64)
                angle = np.arctan2(moment[:, 0], moment[:, 1])
                value = flat[base + tests[np.rint(angle * (TURNS / (2 * np.pi))).astype(np.int64) % TURNS]]
                words = np.packbits(value[:, :BITS] < value[:, BITS:], axis=1).view("<i8")
                place = [np.rint(4 * scale * c).astype(np.int64) for c in (u, row[v])]
                found.append(np.column_stack([which[of[v]], np.full(len(v), level), *place, np.rint(1000 * angle).astype(np.int64), words]))
    table = np.concatenate(found)
    table = table[np.argsort(table[:, 0], kind="stable")]
    return np.split(table[:, 1:], np.searchsorted(table[:, 0], np.arange(1, len(images)))) if images else []


def corners(image: np.ndarray | None) -> np.ndarray:
    """Rows (scale's index, x, y, orientation in milliradians, descriptor's low and high 64 bits) of an image's corners;
    places are in quarters of the image's own pixels."""
    return corner_tables([image])[0]


def _planes(a: np.ndarray, kind: str) -> bytes:
    """Numbers by planes of bytes, compressed."""
    a = np.ascontiguousarray(a.astype(kind))
    return pa.Codec("zstd", 3).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), asbytes=True)


def _numbers(data: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.Codec("zstd").decompress(data, decompressed_size=n * size, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).reshape(n).astype(np.int64)


_PLACES = (("level", "<u1"), ("x", "<i4"), ("y", "<i4"), ("angle", "<i2"))
_GROUP_CORNERS, _GROUP_ROWS = 1 << 18, 1 << 16
_SHEET_PIXELS = 100_000  # so that the sheets of a call stay in the processor's cache


def _grouped(id_type: pa.DataType):
    """Rows (image_id, image) to groups of images, each image of a group once."""
    import xxhash

    def of(batches):
        task, number = TaskContext.get().partitionId() << 24, 0
        rows, own, tables, waiting, held = [], {}, [], [], [0, 0]  # held: corners of the group, pixels that wait

        def flush() -> None:
            tables.extend(found := corner_tables(waiting))
            held[:] = held[0] + sum(map(len, found)), 0
            waiting.clear()

        def group() -> pa.RecordBatch:
            flush()
            flat, sizes = np.concatenate(tables), [len(t) for t in tables]
            ths = list(own)
            columns = {
                "grp": pa.array([task + number], pa.int64()), "ids": pa.array([[i for i, _ in rows]], pa.list_(id_type)),
                "ths": pa.array([[ths[k] for _, k in rows]], pa.list_(pa.int64())), "ns": pa.array([[sizes[k] for _, k in rows]], pa.list_(pa.int64())),
                "images": pa.array([ths], pa.list_(pa.int64())), "sizes": pa.array([sizes], pa.list_(pa.int64())),
                "bits": pa.array([np.ascontiguousarray(flat[:, 4:]).tobytes()], pa.binary()),
            }
            columns |= {c: pa.array([_planes(flat[:, k], kind)], pa.binary()) for k, (c, kind) in enumerate(_PLACES)}
            return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        for batch in batches:
            for image_id, image in zip(batch.column("image_id").to_pylist(), batch.column("image")):
                data = image.as_py()
                th = 0 if data is None else xxhash.xxh3_64_intdigest(data) - (1 << 63)
                if th not in own:
                    own[th] = len(own)
                    waiting.append(decode(data))
                    held[1] += 0 if waiting[-1] is None else waiting[-1].size
                    if held[1] >= _SHEET_PIXELS:
                        flush()
                rows.append((image_id, own[th]))
                if held[0] >= _GROUP_CORNERS or len(rows) >= _GROUP_ROWS:
                    yield group()
                    rows, own, tables, number, held[0] = [], {}, [], number + 1, 0
        if rows:
            yield group()

    return of


def image_groups(df: DataFrame) -> DataFrame:
    """``df`` (image_id, image) in groups, a row each, bucketed by ``grp``: ids, digests of images (ths) and numbers of
    corners (ns) of the rows; digests (images) and numbers of corners (sizes) of the different images, and their corners'
    descriptors (bits) and places."""
    kind = df.schema["image_id"].dataType
    of = T.StructType().add("grp", T.LongType()).add("ids", T.ArrayType(kind))
    for c in ("ths", "ns", "images", "sizes"):
        of = of.add(c, T.ArrayType(T.LongType()))
    for c in ("bits", *(c for c, _ in _PLACES)):
        of = of.add(c, T.BinaryType())
    return bucketed(df.select("image_id", "image").mapInArrow(_grouped(to_arrow_type(kind)), of), "grp", "corners", batch_rows=256)


def _rotl(a: np.ndarray, n: int) -> np.ndarray:
    return a << np.uint64(n) | a >> np.uint64(64 - n)


def _xxhash64(*values: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of bigint columns, as unsigned numbers."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = np.full(len(values[0]), 42, np.uint64)
    for v in values:
        h = h + p5 + np.uint64(8) ^ _rotl(v.view(np.uint64) * p2, 31) * p1
        h = _rotl(h, 27) * p1 + p4
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        h ^= h >> np.uint64(32)
    return h


def _bits(data: bytes) -> np.ndarray:
    """Descriptors as unsigned numbers, (n, 2)."""
    return np.frombuffer(data, "<u8").reshape(-1, 2)


def _deals(key: np.ndarray, values: np.ndarray, parts: int) -> tuple[pa.Array, pa.Array]:
    """Rows of ``values`` (n, 2: 64 bits each), dealt to ``parts`` by a range of the sorted ``key``: the part and its rows' bytes."""
    part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    ends = pa.py_buffer((np.append(first, len(part)) * 16).astype(np.int32))
    return pa.array(part[first]), pa.Array.from_buffers(pa.binary(), len(first), [None, ends, pa.py_buffer(np.ascontiguousarray(values))])


def _near(x: np.ndarray, key: np.ndarray, pieces, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between different descriptors ``x`` of equal keys that differ in at most MAX_BITS.

    More than ``hot`` of one key are first split by each of the pieces, one of which two near ones have in common.
    """
    n, order = len(x), np.argsort(key, kind="stable")
    k = key[order]
    size = np.diff(np.append(np.flatnonzero(np.r_[True, k[1:] != k[:-1]]), n)) if n else np.zeros(0, np.int64)
    a, b, held = [], [], 0
    crowded = np.repeat(size > hot, size) & bool(pieces)
    if crowded.any():
        many = order[crowded]
        for low, high in pieces:
            split = _xxhash64(key[many], x[many, 0] & np.uint64(low), x[many, 1] & np.uint64(high))
            for to, ends in zip((a, b), _near(x[many], split, (), hot)):
                to.append(many[ends])
    order, size = order[~crowded], size[(size <= hot) | (not pieces)]
    end, at, apart = np.repeat(np.cumsum(size), size), np.arange(len(order)), 1
    lo, hi = x[order, 0], x[order, 1]
    while len(at := at[at + apart < end[at]]):
        d = np.bitwise_count(lo[at] ^ lo[at + apart]) + np.bitwise_count(hi[at] ^ hi[at + apart])
        near = at[d <= MAX_BITS]
        a.append(order[near])
        b.append(order[near + apart])
        held, apart = held + len(near), apart + 1
        if held > 1 << 20:
            a, b = ([v] for v in stars(n, np.concatenate(a), np.concatenate(b)))
            held = 0
    none = np.zeros(0, np.int64)
    return stars(n, np.concatenate([none, *a]), np.concatenate([none, *b]))


def _mask(start: int, stop: int) -> int:
    return (1 << stop) - (1 << start)


#: Three parts of the 128 bits, as masks of both halves: the low 43 of each half, and the 42 high ones of both together.
_PARTS = ((_mask(0, 43), 0), (0, _mask(0, 43)), (_mask(43, 64), _mask(43, 64)))
#: The bits outside each part, in three pieces; two differences leave one of them equal.
_PIECES = (
    ((_mask(43, 64), _mask(0, 8)), (0, _mask(8, 36)), (0, _mask(36, 64))),
    ((_mask(0, 28), 0), (_mask(28, 56), 0), (_mask(56, 64), _mask(43, 64))),
    ((_mask(0, 28), 0), (_mask(28, 43), _mask(0, 15)), (0, _mask(15, 43))),
)


def _part(x: np.ndarray, table: int) -> np.ndarray:
    return _xxhash64(*(x[:, c] & np.uint64(_PARTS[table][c]) for c in (0, 1)))


def _dealt_bits(table: int, parts: int):
    """Rows (grp, bits) to rows (part, grp, bits): the descriptors of a group by the key of a Hamming table."""

    def of(batches):
        for batch in batches:
            for grp, bits in zip(batch.column("grp").to_pylist(), batch.column("bits")):
                x = _bits(bits.as_py())
                key = _part(x, table)
                order = np.argsort(key, kind="stable")
                x, key = x[order], key[order]
                fresh = np.r_[True, (x[1:] != x[:-1]).any(axis=1)][: len(x)]
                part, dealt = _deals(key[fresh], x[fresh], parts)
                yield pa.RecordBatch.from_arrays([part, pa.array(np.full(len(part), grp, np.int64)), dealt], ["part", "grp", "bits"])

    return of


def _found_near(table: int, hot: int):
    """A part's rows (part, grp, bits) to links of words (kind 0: a, b) and to the groups of linked words (kind 1: word, grp)."""

    def of(batches):
        grp, bits = [], []
        for batch in batches:
            for g, data in zip(batch.column("grp").to_pylist(), batch.column("bits")):
                bits.append(_bits(data.as_py()))
                grp.append(np.full(len(bits[-1]), g))
        if not bits:
            return
        x, grp = np.concatenate(bits), np.concatenate(grp)
        bits.clear()
        key = _part(x, table)
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = k[1:] == k[:-1]
        order = order[np.r_[False, same] | np.r_[same, False]]
        # What is left has its key in common with another; of those, each descriptor once.
        order = order[np.lexsort((x[order, 1], x[order, 0]))]
        x, grp, key = x[order], grp[order], key[order]
        fresh = np.r_[True, (x[1:] != x[:-1]).any(axis=1)][: len(x)]
        number = np.cumsum(fresh) - 1
        node, root = _near(x[fresh], key[fresh], _PIECES[table], hot)
        word = _xxhash64(x[fresh, 0], x[fresh, 1]).view(np.int64)
        linked = np.zeros(len(word), bool)
        linked[node] = linked[root] = True
        at = linked[number]
        there = np.unique(np.column_stack([word[number[at]], grp[at]]), axis=0)
        yield _pairs(0, word[node], word[root])
        yield _pairs(1, there[:, 0], there[:, 1])

    return of


_PAIRS = "kind int, a bigint, b bigint"


def _pairs(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "a", "b"])


def _parts_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def near_words(groups: DataFrame) -> list[DataFrame]:
    """Of ``groups`` (grp, bits): links between words that are near (kind 0: a, b), and where linked words are (kind 1: word, grp),
    a written table for each Hamming table.

    The tables follow each other, so that the descriptors lie dealt out on disk once at a time.  A part's descriptors are
    compared within a task, crowded keys by the pieces of their other bits.
    """
    parts, out = _parts_of(groups), []
    for table in range(len(_PARTS)):
        dealt = groups.select("grp", "bits").mapInArrow(_dealt_bits(table, parts), "part int, grp bigint, bits binary")
        met = dealt.repartitionById(parts, "part").mapInArrow(_found_near(table, HOT_BUCKET), _PAIRS)
        out.append(written(met, "near-words", batch_rows=8))
    return out


def visual_words(descriptors: DataFrame) -> DataFrame:
    """``word, root``: for each distinct descriptor (lo, hi) that is close to another, its digest and its word's.

    A bucket of more than ``HOT_BUCKET`` descriptors is split by the pieces of its other bits, which loses no link.
    """

    def packed(batches):
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi")])
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([x.astype("<i8").tobytes()], pa.binary())], ["grp", "bits"])

    found = functools.reduce(DataFrame.unionAll, near_words(written(descriptors.select("lo", "hi").mapInArrow(packed, "grp bigint, bits binary"), "descriptors")))
    return components(found.where("kind = 0").select("a", "b")).withColumnRenamed("node", "word")


def triangles(image: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Consensus keys of images (a sorted number for each row of ``table``: level, x, y, angle, word; by level within an
    image): words and shape of triangles of near corners.  Returns images and keys, each pair once, by image."""
    fresh = np.r_[True, (image[1:] != image[:-1]) | (table[1:, 0] != table[:-1, 0])][: len(image)]
    start = np.flatnonzero(fresh)
    size = np.diff(np.append(start, len(image)))
    found = [np.zeros((0, 3), np.int64)]
    for n in np.unique(size[size >= 3]).tolist():
        of = start[size == n]
        many, step = max(1, (1 << 20) // (n * n)), max(1, min(n, (1 << 20) // n))
        for at in range(0, len(of), many):
            every = of[at : at + many, None] + np.arange(n)
            x, y = table[every, 1], table[every, 2]
            for row in range(0, n, step):
                some = slice(row, row + step)
                apart = (x[:, some, None] - x[:, None]) ** 2 + (y[:, some, None] - y[:, None]) ** 2
                apart[apart < (4 * MIN_SIDE) ** 2] = _FAR
                corner = [every[:, some].ravel()]
                fit = np.ones(len(corner[0]), bool)
                for _ in range(2):
                    least = apart.argmin(axis=2)[:, :, None]
                    fit &= (np.take_along_axis(apart, least, 2) < _FAR).ravel()
                    corner.append(np.take_along_axis(every, least[:, :, 0], 1).ravel())
                    np.put_along_axis(apart, least, _FAR, 2)
                corner = np.column_stack(corner)[fit]
                side = table[corner[:, 1], 1:3] - table[corner[:, 2], 1:3]
                found.append(corner[(side**2).sum(axis=1) >= (4 * MIN_SIDE) ** 2])
    corner = np.concatenate(found)
    xy, turn, word = table[:, 1:3] / 4, table[:, 3] / 1000, table[:, 4]
    corner = np.take_along_axis(corner, np.argsort(word[corner], axis=1, kind="stable"), axis=1)
    w = word[corner]
    corner = corner[(w[:, 0] != w[:, 1]) & (w[:, 1] != w[:, 2])]
    h = np.zeros(len(corner), np.uint64)
    for p in range(3):
        a, b, c = (corner[:, (p + k) % 3] for k in range(3))
        u, v = xy[b] - xy[a], xy[c] - xy[a]
        inner = np.arctan2(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0], (u * v).sum(axis=1))
        against = turn[a] - np.arctan2(u[:, 1], u[:, 0])
        shape = [np.rint(x / (2 * np.pi) * SHAPE_BINS).astype(np.int64) % SHAPE_BINS for x in (inner, against)]
        for x in (word[a], *shape):
            h = (h ^ x.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
    of, key = image[corner[:, 0]], h.view(np.int64)
    order = np.lexsort((key, of))
    of, key = of[order], key[order]
    fresh = np.r_[True, (of[1:] != of[:-1]) | (key[1:] != key[:-1])][: len(of)]
    return of[fresh], key[fresh]


_FAR = 1 << 62


def _key_links(key: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of images with keys: where each key's first is, by key as an unsigned number; and links that span images of equal keys."""
    order = np.lexsort((image, key.view(np.uint64)))
    k = key[order]
    first = np.r_[True, k[1:] != k[:-1]][: len(k)]
    lead = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
    names, number = np.unique(image, return_inverse=True)
    node, root = stars(len(names), number[order], number[lead])
    return order[first], names[node], names[root]


def _dealt_keys(parts: int):
    """Groups with the roots of their words to rows (part, kind, pairs): links of images (0), their numbers of keys (1), and
    keys with the first image of the group (2), dealt by key."""

    def of(batches):
        for batch in batches:
            for g in range(batch.num_rows):
                row = {c: batch.column(c)[g] for c in batch.schema.names}
                images, sizes = (np.array(row[c].as_py(), np.int64) for c in ("images", "sizes"))
                x = _bits(row["bits"].as_py())
                word = _xxhash64(x[:, 0], x[:, 1]).view(np.int64)
                if row["words"].is_valid:
                    known, root = (c.to_numpy() for c in row["words"].values.flatten())
                    order = np.argsort(known)
                    known, root = known[order], root[order]
                    at = np.minimum(np.searchsorted(known, word), len(known) - 1)
                    word = np.where(known[at] == word, root[at], word)
                places = [_numbers(row[c].as_py(), len(word), kind) for c, kind in _PLACES]
                image, key = triangles(np.repeat(np.arange(len(images)), sizes), np.column_stack([*places, word]))
                counts = np.bincount(image, minlength=len(images))
                # Images of rows without an id are linked to nothing.
                named = {th for i, th in zip(row["ids"].as_py(), row["ths"].as_py()) if i is not None}
                mine = np.array([th in named for th in images.tolist()], bool)[image]
                image, key = images[image[mine]], key[mine]
                first, node, root = _key_links(key, image)
                part, dealt = _deals(key[first].view(np.uint64), np.column_stack([key[first], image[first]]), parts)
                at = row["grp"].as_py() % parts
                yield pa.RecordBatch.from_arrays([pa.array([at, at], pa.int32()), pa.array([0, 1], pa.int32()), pa.array([np.column_stack(p).astype("<i8").tobytes() for p in ((node, root), (images, counts))], pa.binary())], ["part", "kind", "pairs"])
                yield pa.RecordBatch.from_arrays([part, pa.array(np.full(len(part), 2, np.int32)), dealt], ["part", "kind", "pairs"])

    return of


def _met_keys(batches):
    """A part's rows (part, kind, pairs) to links of images (kind 0) and numbers of keys (kind 1: image, number)."""
    held: list[list[np.ndarray]] = [[np.zeros((0, 2), np.int64)] for _ in range(3)]
    for batch in batches:
        for kind, pairs in zip(batch.column("kind").to_pylist(), batch.column("pairs")):
            held[kind].append(np.frombuffer(pairs.as_py(), "<i8").reshape(-1, 2))
    links, counts, keys = map(np.concatenate, held)
    _, node, root = _key_links(keys[:, 0].copy(), keys[:, 1].copy())
    yield _pairs(0, np.append(links[:, 0], node), np.append(links[:, 1], root))
    yield _pairs(1, counts[:, 0], counts[:, 1])


def image_copies(df: DataFrame, image: str = "image") -> DataFrame:
    """``image_id, n_corners, class_id, n_keys`` for each row of ``df`` (image_id, image); class_id: smallest image_id.

    Rows of one image_id, or of none, with different images have keys of their own; ids link the former, nothing the latter.
    """
    groups = image_groups(df.select("image_id", F.col(image).alias("image")))
    tables = near_words(groups)
    near = functools.reduce(DataFrame.unionAll, tables)
    roots = components(near.where("kind = 0").select("a", "b")).where("node <> root")
    there = near.where("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("grp")).distinct()
    words = there.join(roots, "node").groupBy("grp").agg(F.collect_list(F.struct(F.col("node").alias("word"), "root")).alias("words"))
    parts = _parts_of(df)
    dealt = groups.join(words, "grp", "left").mapInArrow(_dealt_keys(parts), "part int, kind int, pairs binary")
    met = written(dealt.repartitionById(parts, "part").mapInArrow(_met_keys, _PAIRS), "image-links", batch_rows=4)
    for table in tables:
        forget(table)
    found = groups.select(F.expr("inline(arrays_zip(ids, ths, ns))").alias("image_id", "th", "n_corners"))
    # Links between images that have an id: by keys, by equal images and by equal ids.  Images without corners link nothing.
    ids = found.where("image_id IS NOT NULL AND n_corners > 0").select("image_id", "th").distinct()
    same = ids.join(ids.groupBy("image_id").agg(F.min("th").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1"), "image_id").where("a <> th").select("a", F.col("th").alias("b"))
    linked = components(met.where("kind = 0").select("a", "b").unionByName(same)).select(F.col("node").alias("th"), "root")
    rooted = ids.join(linked, "th", "left").select("image_id", "th", F.coalesce("root", "th").alias("root"))
    named = rooted.groupBy("root").agg(F.min("image_id").alias("class_id"))
    classes = rooted.join(named, "root").select("image_id", "th", "class_id")
    counts = met.where("kind = 1").groupBy(F.col("a").alias("th")).agg(F.max("b").alias("n_keys"))
    out = found.join(classes, ["image_id", "th"], "left").join(counts, "th", "left")
    # Images without corners are equal to nothing but their own row.
    return out.select("image_id", "n_corners", F.expr("CASE WHEN n_corners = 0 THEN image_id ELSE coalesce(class_id, image_id) END").alias("class_id"), F.coalesce("n_keys", F.lit(0).cast("long")).alias("n_keys"))


CELL, COLUMNS = 4, 24
#: Mirrored pixels round a sheet, so that every pixel of a word can be a corner, however few rows a page has.  A blank
#: margin would give the corners near it like descriptors on all pages.
MARGIN = RADIUS + 1


def _sheets(texts: list[str | None]) -> list[bytes | None]:
    import xxhash

    out = []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if not words:
            out.append(None)
            continue
        cells = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w)[: CELL * CELL] for w in words), np.uint8).reshape(-1, CELL, CELL)
        rows = -(-len(words) // COLUMNS)
        sheet = np.zeros((rows * COLUMNS, CELL, CELL), np.uint8)
        sheet[: len(cells)] = cells
        out.append(encode(np.pad(sheet.reshape(rows, COLUMNS, CELL, CELL).transpose(0, 2, 1, 3).reshape(rows * CELL, COLUMNS * CELL), MARGIN, mode="reflect")))
    return out


#: A raster of a text: each word is a cell whose texture its digest fixes, in reading order, COLUMNS to a row,
#: within a mirrored margin.
page_image = text_udf(T.BinaryType(), _sheets)


def query(spark, sf_dir):
    """The tables hold no images: pages are rendered, a word a cell, from the visible text of their whole html."""
    visible = r"regexp_replace(regexp_replace(html, '(?s)<(script|style|head)\\b.*?</\\1>|<!--.*?-->', ' '), '<[^>]*>', ' ')"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("image_id"), F.expr(visible).alias("text"))
    out = image_copies(pages.select("image_id", page_image("text").alias("image")))
    return out.withColumnRenamed("image_id", "page_id")
