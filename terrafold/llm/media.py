"""Cropped and edited copies of images, by local descriptors.

An image (a binary column: PGM, PPM or PNG of 8 bits) becomes grey levels. On each scale of a
pyramid corners are the local maxima of Harris' measure over their neighbourhood; each has an
orientation (centroid of its disc) and 128 binary tests of smoothed pixels, turned by it. The
tests are four words of 32 bits: two corners agree if they have a word in common (which any two
within 3 bits have) and differ in at most `budget` bits. Two images are copies where at least
`votes` corners, and `share` of those of the image with fewer, agree on one shift, turn and scale
that carries one image into the other (consensus). Copies give components.

Images of equal pixels are one class first. Classes meet in a Hamming table keyed by one word:

- In a key of at most `hot` corners all meet; very common keys are known by a sample and aren't
  sent to one place. A pair of classes that agrees there is a candidate,
  unless even all corners of hot keys wouldn't make up what it lacks; candidates are verified
  with all corners of both. The image with more corners is sent once for many partners.
- Copies that agree in hot keys alone (a banner on very many pages) need `votes` corners there,
  so both have that many. Classes that have, and share a hot key, are a group whose pairs are all
  compared, but for those that other links join already (see groups).

So every pair of copies is linked or joined by links; no key and no group has a cap.

Null or undecodable images have null class, component and corners. An image without a corner
only has exact copies; one with under `votes` corners too. Of equal descriptors within an image
the first eight are corners. Rows that repeat an id and pixels are
reported each. A very long page is one tall image, worked on whole. Other columns of the input
play no part, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import materialize, plain, ragged
from terrafold.llm.groups import components, group_links

#: A corner is the highest within SUPPRESS pixels; its tests lie within RADIUS.
SUPPRESS, RADIUS, DISC, TURNS, TESTS = 12, 10, 7, 16, 128

_MARK = re.compile(r"<!--|-->|<(/?)(script|style|head)\b[^<>]*>", re.I)
_BLOCK = re.compile(r"</?(?:p|div|h\d|li|ul|ol|nav|article|section|header|footer|table|tr|td|th|br|blockquote|pre)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[^<>]*>")


def without_hidden(page: str) -> str:
    """The page without comments, scripts, styles and head, in one walk; unclosed ones hide nothing."""
    marks = [(m.start(), m.end(), m.group(0)[:4], (m.group(2) or "").lower(), bool(m.group(1))) for m in _MARK.finditer(page)]
    closers: dict[str, int] = {}
    ends = [-1] * len(marks)  # for each opening mark the next closing one of its kind
    for k in range(len(marks) - 1, -1, -1):
        _, _, head, kind, closing = marks[k]
        if head.startswith("--"):
            closers["--"] = k
        elif head == "<!--":
            ends[k] = closers.get("--", -1)
        elif closing:
            closers[kind] = k
        else:
            ends[k] = closers.get(kind, -1)
    out, at = [], 0
    for k, (start, _, _, _, _) in enumerate(marks):
        if start >= at and ends[k] >= 0:
            out += [page[at:start], "\n"]
            at = marks[ends[k]][1]
    return "".join([*out, page[at:]])


def render_page(page: str, width: int = 64) -> bytes:
    """A picture (PGM) of a page's visible text: a block a paragraph, a pixel a byte."""
    text = html_lib.unescape(_TAG.sub("", _BLOCK.sub("\n", without_hidden(page))))
    rows = []
    for line in text.split("\n"):
        raw = line.strip().encode()
        if raw:
            rows.append(raw + b" " * (-len(raw) % width))
    body = np.frombuffer(b"".join(rows) or b" " * width, dtype=np.uint8)
    ink = (np.arange(256) * 89 + 37) % 224
    ink[32] = 255
    return b"P5\n%d %d\n255\n" % (width, len(body) // width) + ink[body].astype(np.uint8).tobytes()


def decode(raw: bytes | None) -> np.ndarray | None:
    """Grey levels, or None."""
    try:
        if raw[:2] in (b"P5", b"P6"):
            head = re.match(rb"P[56](?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", raw)
            w, h, most = map(int, head.groups())
            n = 1 if raw[1:2] == b"5" else 3
            if not 0 < most < 256 or w * h == 0:
                return None
            return np.frombuffer(raw, dtype=np.uint8, count=w * h * n, offset=head.end()).reshape(h, w, n).mean(axis=2)
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(raw)
    except (TypeError, ValueError, AttributeError, struct.error, zlib.error, KeyError, IndexError):
        pass
    return None


def _png(raw: bytes) -> np.ndarray | None:
    at, data = 8, b""
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", raw[at + 8 : at + 21])
        elif kind == b"IDAT":
            data += raw[at + 8 : at + 8 + n]
        at += 12 + n
    n = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlaced or n is None:
        return None
    lines = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h, w * n), dtype=np.int64)
    for y in range(h):
        kind, row = lines[y, 0], lines[y, 1:].astype(np.int64)
        up = out[y - 1] if y else np.zeros(w * n, dtype=np.int64)
        if kind == 0:
            out[y] = row
        elif kind == 2:
            out[y] = (row + up) & 255
        else:
            for k in range(w * n):
                a, c = (out[y, k - n], up[k - n]) if k >= n else (0, 0)
                b = up[k]
                p = a + b - c
                nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                out[y, k] = (row[k] + {1: a, 3: (a + b) // 2, 4: nearest}[int(kind)]) & 255
    colours = out.reshape(h, w, n)
    return colours[:, :, : 3 if n > 2 else 1].mean(axis=2)


@lru_cache(maxsize=1)
def pattern() -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the disc, and of the test pairs for every turn."""
    y, x = np.mgrid[-DISC : DISC + 1, -DISC : DISC + 1]
    disc = np.stack((y, x), axis=-1)[x * x + y * y <= DISC * DISC]
    draw = np.clip(np.random.default_rng(11).normal(0, RADIUS / 2.5, (TESTS, 2, 2)), -RADIUS * 0.7, RADIUS * 0.7)
    angle = 2 * np.pi * np.arange(TURNS) / TURNS
    turn = np.array([[np.cos(angle), np.sin(angle)], [-np.sin(angle), np.cos(angle)]]).transpose(2, 0, 1)  # on (y, x)
    return disc, np.rint(np.einsum("tij,nkj->tnki", turn, draw)).astype(np.int64)


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Sum over a square of side 2 r + 1, zeros outside; exact for integers."""
    h, w = a.shape
    c = np.zeros((h + 2 * r + 1, w), dtype=np.int64)
    np.cumsum(a, axis=0, out=c[r + 1 : r + 1 + h])
    c[r + 1 + h :] = c[r + h]
    a = c[2 * r + 1 :] - c[:h]
    c = np.zeros((h, w + 2 * r + 1), dtype=np.int64)
    np.cumsum(a, axis=1, out=c[:, r + 1 : r + 1 + w])
    c[:, r + 1 + w :] = c[:, r + w : r + w + 1]
    return c[:, 2 * r + 1 :] - c[:, :w]


def _highest(a: np.ndarray, r: int) -> np.ndarray:
    """Maximum over a square of side 2 r + 1; below zero counts as zero."""
    h, w = a.shape
    m = np.zeros((h + 2 * r, w + 2 * r))
    m[r : r + h, r : r + w] = a
    have = 1
    while have < 2 * r + 1:
        step = min(have, 2 * r + 1 - have)
        m = np.maximum(m[:-step], m[step:])
        m = np.maximum(m[:, :-step], m[:, step:])
        have += step
    return m


def corners(grey: np.ndarray, scales: int = 3, repeats: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(x, y, turn, scale) of each corner, in pixels of the full image, and its 4 words.

    Sums are of integers, so a copied patch gives the same numbers wherever it lies. Texture
    that repeats within the image says little of place: of equal descriptors the first `repeats`
    are corners.
    """
    disc, tests = pattern()
    places, words = [], []
    image = np.rint(grey).astype(np.int64)
    for scale in range(scales):
        if scale:
            h, w = image.shape[0] // 2, image.shape[1] // 2
            image = image[: 2 * h : 2, : 2 * w] + image[1 : 2 * h : 2, : 2 * w]
            image = image[:, ::2] + image[:, 1::2]
        if min(image.shape) < 4:
            break
        gy, gx = np.zeros_like(image), np.zeros_like(image)
        gy[1:-1], gx[:, 1:-1] = image[2:] - image[:-2], image[:, 2:] - image[:, :-2]
        xx, yy, xy = (_box(g, 2).astype(np.float64) for g in (gx * gx, gy * gy, gx * gy))
        measure = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        y, x = np.nonzero((measure > 1e4 * 256**scale) & (measure == _highest(measure, SUPPRESS)))
        if not len(y):
            continue
        soft = np.zeros((image.shape[0] + 4 * RADIUS, image.shape[1] + 4 * RADIUS), dtype=np.int64)
        soft[2 * RADIUS : -2 * RADIUS, 2 * RADIUS : -2 * RADIUS] = _box(image, 1)
        y, x = y + 2 * RADIUS, x + 2 * RADIUS
        ring = soft[y[:, None] + disc[:, 0], x[:, None] + disc[:, 1]]
        angle = np.arctan2((ring * disc[:, 0]).sum(axis=1), (ring * disc[:, 1]).sum(axis=1))
        turn = np.rint(angle / (2 * np.pi) * TURNS).astype(np.int64) % TURNS
        at = tests[turn]
        pair = soft[y[:, None, None] + at[..., 0], x[:, None, None] + at[..., 1]]
        words.append(np.packbits(pair[..., 0] < pair[..., 1], axis=1).view(">u4").astype(np.int64))
        places.append(np.stack(((x - 2 * RADIUS) << scale, (y - 2 * RADIUS) << scale, turn, np.full(len(x), scale)), axis=1))
    if not places:
        return np.zeros((0, 4), dtype=np.int64), np.zeros((0, 4), dtype=np.int64)
    places, words = np.concatenate(places), np.concatenate(words)
    order = np.lexsort((np.arange(len(words)), *words.T))
    starts = np.flatnonzero(np.append(True, (words[order[1:]] != words[order[:-1]]).any(axis=1)))
    keep = np.sort(order[ragged(np.diff(np.append(starts, len(order)))) < repeats])
    return places[keep], words[keep]


def pixel_class(grey: np.ndarray) -> int:
    """64 bits of the pixels' digest, signed."""
    return int.from_bytes(hashlib.blake2b(struct.pack("<II", *grey.shape) + np.rint(grey).astype(np.uint8).tobytes(), digest_size=8).digest(), "little", signed=True)


#: A corner in a table. at: table, word and (in the low NUMBER bits) the corner's number; two and one:
#: the words of the other tables, in their order.
ENTRY = "at bigint, cls bigint, two bigint, one int"
FIELDS = ["at", "cls", "two", "one"]
NUMBER = 24
#: Matches of corners that are expanded at once.
EXPAND = 2_000_000


def features(images: DataFrame) -> DataFrame:
    """images: id, image. (id, cls, corners as bytes: x, y, turn, scale and four words each)."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                cls, packed = [], []
                for raw in b.column("image").to_pylist():
                    grey = decode(raw)
                    cls.append(None if grey is None else pixel_class(grey))
                    packed.append(None if grey is None else np.concatenate(corners(grey), axis=1).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(cls, pa.int64()), pa.array(packed, pa.binary())], names=["id", "cls", "corners"])

    return images.mapInArrow(run, f"id {dict(images.dtypes)['id']}, cls bigint, corners binary")


def unpacked(raw: bytes) -> np.ndarray:
    """x, y, turn, scale and the four words of each corner."""
    return np.frombuffer(raw, dtype="<u4").reshape(-1, 8).astype(np.int64)


def entries(classes: DataFrame, heavy: np.ndarray | None = None, only: bool = False) -> DataFrame:
    """classes: cls, corners. Four entries for each corner; of keys that are heavy none, or `only` those."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                raw = b.column("corners").to_pylist()
                n = np.array([len(x) // 32 for x in raw])
                if not n.sum():
                    continue
                f = unpacked(b"".join(raw))
                cls, kp = np.repeat(b.column("cls").to_numpy(), n), ragged(n)
                key = (np.arange(4)[None, :] << 32) | f[:, 4:]
                rest = f[:, 4:][:, [[1, 2, 3], [0, 2, 3], [0, 1, 3], [0, 1, 2]]]
                two, one = (rest[..., 0] << 32) | rest[..., 1], rest[..., 2].astype(np.uint32).view(np.int32)
                columns = [((key << NUMBER) | kp[:, None]).ravel(), np.repeat(cls, 4), two.ravel(), one.ravel()]
                if heavy is not None:
                    own = np.isin(key.ravel(), heavy) == only
                    columns = [x[own] for x in columns]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=FIELDS)

    return classes.mapInArrow(run, ENTRY)


def heavy_keys(classes: DataFrame, most: int = 1 << 14, share: int = 64) -> np.ndarray:
    """Keys so common that their entries aren't sent to one place: at most `most`, by a sample of classes."""
    sample = entries(classes.where(F.pmod(F.xxhash64("cls", F.lit(1)), F.lit(share)) == 0)).groupBy(F.shiftright("at", NUMBER).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    total = sample.agg(F.sum("n")).first()[0] or 0
    found = sample.where(F.col("n") > max(share, total // most)).select("key").collect()  # `most` rows
    return np.sort(np.array([r["key"] for r in found], dtype=np.int64))


def expanded(lo: np.ndarray, hi: np.ndarray):
    """For ranges [lo, hi): (which range, position), some EXPAND of them at a time."""
    n = hi - lo
    for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // EXPAND)) + 1):
        if len(part) and n[part].sum():
            yield np.repeat(part, n[part]), np.repeat(lo[part], n[part]) + ragged(n[part])


def copies(one: np.ndarray, many: np.ndarray, owner: np.ndarray, sizes: np.ndarray, votes: int, share: float, budget: int, cell: int = 6) -> np.ndarray:
    """Which images agree with the image `one` on a geometry.

    many: the corners of all of them, owner: whose each is, sizes: how many each has. Places vote
    in four grids of cells, half a cell apart, so that no border parts votes that agree.
    """
    out = np.zeros(len(sizes), dtype=bool)
    need = np.maximum(votes, np.ceil(share * np.minimum(sizes, len(one)) - 1e-9).astype(np.int64))
    found = []
    for table in range(4):
        order = np.argsort(one[:, 4 + table], kind="stable")
        words = one[order, 4 + table]
        lo, hi = (np.searchsorted(words, many[:, 4 + table], side=s) for s in ("left", "right"))
        for j, at in expanded(lo, hi):
            i = order[at]
            differing = one[i, 4:] ^ many[j, 4:]
            # A pair of corners counts at the first word they share.
            ok = (differing[:, :table] != 0).all(axis=1) & (np.bitwise_count(differing).sum(axis=1) <= budget)
            found.append(np.stack((i[ok], j[ok])))
    if not found:
        return out
    i, j = np.concatenate(found, axis=1)
    # Only images with enough matches at all.
    enough = np.bincount(owner[j], minlength=len(sizes)) >= need
    i, j = i[enough[owner[j]]], j[enough[owner[j]]]
    if not len(i):
        return out
    (xi, yi, ti, si), (xj, yj, tj, sj) = one[i, :4].T, many[j, :4].T
    turn, scale = (tj - ti) % TURNS, sj - si
    angle, grow = 2 * np.pi * turn / TURNS, 2.0**scale
    dx = xj - grow * (np.cos(angle) * xi - np.sin(angle) * yi)
    dy = yj - grow * (np.sin(angle) * xi + np.cos(angle) * yi)
    for sx in (0.0, 0.5):
        for sy in (0.0, 0.5):
            cx, cy = np.floor(dx / cell + sx).astype(np.int64), np.floor(dy / cell + sy).astype(np.int64)
            order = np.lexsort((cy, cx, turn, scale, owner[j]))
            where = np.stack((owner[j], scale, turn, cx, cy))[:, order]
            group = np.cumsum(np.append(False, (where[:, 1:] != where[:, :-1]).any(axis=0)))
            # Distinct corners of either image: one corner can't vote for many.
            support = np.minimum(*(np.bincount(np.unique(group * 2**26 + k[order]) >> 26, minlength=group[-1] + 1) for k in (i, j - (np.cumsum(sizes) - sizes)[owner[j]])))
            first = np.flatnonzero(np.append(True, np.diff(group)))
            whose = where[0, first]
            out[whose[support >= need[whose]]] = True
    return out


def all_of_key(f: dict[str, np.ndarray], budget: int) -> list[pa.Array]:
    """(a, b): classes with a corner each in one key that agree, once for each; f is sorted by key.

    Corners that have several words in common count in the first of these tables alone.
    """
    key = f["at"] >> NUMBER
    lo = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    ends = np.repeat(np.append(lo[1:], len(key)), np.diff(np.append(lo, len(key))))
    out = [np.zeros((2, 0), dtype=np.int64)]
    for i, j in expanded(np.arange(1, len(ends) + 1), ends):
        x, y, table = f["two"][i] ^ f["two"][j], f["one"][i] ^ f["one"][j], key[i] >> 32
        differ = np.bitwise_count(x.view(np.uint64)).astype(np.int64) + np.bitwise_count(y.view(np.uint32))
        low = np.int64(0xFFFFFFFF)
        seen = ((x >> 32) & low == 0) & (table > 0) | (x & low == 0) & (table > 1) | (y == 0) & (table > 2)
        ok = (differ <= budget) & (f["cls"][i] != f["cls"][j]) & ~seen
        a, b = f["cls"][i[ok]], f["cls"][j[ok]]
        out.append(np.stack((np.minimum(a, b), np.maximum(a, b))))
    return [pa.array(x) for x in np.concatenate(out, axis=1)]


def meetings(table: DataFrame, budget: int, hot: int) -> DataFrame:
    """(a, b) for agreeing corners of two classes in keys of at most `hot` entries; (a, key, kp) for the entries of others."""
    names = ["a", "b", "key", "kp"]

    def pairs(f) -> pa.RecordBatch:
        a, b = all_of_key(f, budget)
        return pa.RecordBatch.from_arrays([a, b, pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32())], names=names)

    def alone(f) -> pa.RecordBatch:
        key, kp = f["at"] >> NUMBER, (f["at"] & ((1 << NUMBER) - 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(f["cls"]), pa.nulls(len(key), pa.int64()), pa.array(key), pa.array(kp)], names=names)

    def run(batches):
        rest, hot_key = None, None
        for whole in batches:
            f = {c: whole.column(c).to_numpy() for c in FIELDS}
            if rest is not None:
                f = {c: np.concatenate((rest[c], x)) for c, x in f.items()}
            if not len(f["at"]):
                continue
            key = f["at"] >> NUMBER
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(first, len(key)))
            many = sizes > hot
            many[0] |= key[0] == hot_key
            hot_key = key[-1] if many[-1] else None
            kind = np.where(many, 1, 0)
            if not many[-1]:
                kind[-1] = 2  # its key may go on
            kind = np.repeat(kind, sizes)
            few, most, rest = ({c: x[kind == k] for c, x in f.items()} for k in (0, 1, 2))
            if len(few["at"]):
                yield pairs(few)
            if len(most["at"]):
                yield alone(most)
        if rest is not None and len(rest["at"]):
            yield pairs(rest)

    return table.repartition(F.shiftright("at", NUMBER)).sortWithinPartitions("at").mapInArrow(run, "a bigint, b bigint, key bigint, kp int")


def similar_in_tile(corners_of: list[bytes], label: np.ndarray, second: np.ndarray | None, votes: int, share: float, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the copies in a tile (see groups): pairs with enough agreeing corners are verified."""
    n, sizes = len(corners_of), np.array([len(x) // 32 for x in corners_of])
    every, first, owner = unpacked(b"".join(corners_of)), np.cumsum(sizes) - sizes, np.repeat(np.arange(n), sizes)
    agreed = np.zeros(n * n, dtype=np.int64)
    for table in range(4):
        order = np.argsort(every[:, 4 + table], kind="stable")
        words = every[order, 4 + table]
        starts = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
        ends = np.repeat(np.append(starts[1:], len(words)), np.diff(np.append(starts, len(words))))
        for i, j in expanded(np.arange(1, len(words) + 1), ends):
            i, j = order[i], order[j]
            differing = every[i, 4:] ^ every[j, 4:]
            ok = (differing[:, :table] != 0).all(axis=1) & (np.bitwise_count(differing).sum(axis=1) <= budget)
            i, j = owner[i[ok]], owner[j[ok]]
            agreed += np.bincount(np.minimum(i, j) * n + np.maximum(i, j), minlength=n * n)
    need = np.maximum(votes, np.ceil(share * np.minimum(sizes[:, None], sizes[None, :]) - 1e-9))
    maybe = np.triu(agreed.reshape(n, n) >= need, 1)
    if second is not None:
        maybe &= second[:, None] != second[None, :]
    label, out = label.copy(), []
    for i in np.flatnonzero(maybe.any(axis=1)).tolist():
        others = np.flatnonzero(maybe[i] & (label != label[i]))
        if not len(others):
            continue
        at = np.repeat(first[others], sizes[others]) + ragged(sizes[others])
        ok = copies(every[first[i] : first[i] + sizes[i]], every[at], np.repeat(np.arange(len(others)), sizes[others]), sizes[others], votes, share, budget)
        for j in others[ok].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return tuple(np.array(out, dtype=np.int64).reshape(-1, 2).T)


def with_enough(lacking: DataFrame) -> DataFrame:
    """The pairs whose agreeing corners and those in hot keys that both have may be as many as they need."""
    names = ["a", "b", "n_a", "n_b", "agreed", "need"]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                lists = [b.column(c) for c in ("hot_a", "hot_b")]
                (va, oa), (vb, ob) = ((x.values.to_numpy(), x.offsets.to_numpy()) for x in lists)
                lack = b.column("need").to_numpy() - b.column("agreed").to_numpy()
                keep = np.zeros(b.num_rows, dtype=bool)
                for k in range(b.num_rows):
                    x, y = va[oa[k] : oa[k + 1]], vb[ob[k] : ob[k + 1]]
                    both = np.intersect1d(x >> NUMBER, y >> NUMBER)
                    if len(both):
                        corners_of = (len(np.unique(z[np.isin(z >> NUMBER, both)] & ((1 << NUMBER) - 1))) for z in (x, y))
                        keep[k] = min(corners_of) >= lack[k]
                yield pa.RecordBatch.from_arrays([b.column(c) for c in names], names=names).filter(pa.array(keep))

    rows = lacking.select(*names, "hot_a", "hot_b")
    return rows.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in rows.select(*names).dtypes))


def verified(pairs: DataFrame, corners_of: DataFrame, votes: int, share: float, budget: int, partners: int = 2048) -> DataFrame:
    """(a, b): the pairs that are copies. pairs: big, small (classes); corners_of: cls, corners.

    A big image goes once to each part of at most about `partners` of its partners.
    """
    many = materialize(pairs.groupBy("big").agg(F.ceil(F.count(F.lit(1)) / partners).cast("long").alias("parts")))
    smaller = pairs.join(many, "big").withColumn("part", F.pmod(F.xxhash64("small"), "parts")).join(corners_of, F.col("small") == F.col("cls")).select("big", "part", F.lit(1).alias("kind"), "small", "corners")
    bigger = many.join(corners_of, F.col("big") == F.col("cls")).select("big", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("small"), "corners")

    def run(batches):
        big, one, held = None, None, []

        def flush():
            sizes = np.array([len(c) // 32 for _, c in held])
            ok = copies(one, unpacked(b"".join(c for _, c in held)), np.repeat(np.arange(len(held)), sizes), sizes, votes, share, budget)
            small = np.array([s for s, _ in held], dtype=np.int64)[ok]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(small), big, dtype=np.int64)), pa.array(small)], names=["a", "b"])

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                for key, kind, small, corners_ in zip(*(b.column(c).to_pylist() for c in ("big", "kind", "small", "corners")), strict=True):
                    if kind == 0 or len(held) >= 256:
                        if held:
                            yield flush()
                        held = []
                    if kind == 0:
                        big, one = key, unpacked(corners_)
                    else:
                        held.append((small, corners_))
        if held:
            yield flush()

    rows = bigger.unionByName(smaller).repartition("big", "part").sortWithinPartitions("big", "part", "kind")
    return rows.mapInArrow(run, "a bigint, b bigint")


def find_copies(images: DataFrame, votes: int = 4, share: float = 0.3, budget: int = 12, hot: int = 32, side: int = 2048, id_col: str = "id", image_col: str = "image") -> DataFrame:
    """(id, image_class, component_id, corners) of every row.

    image_class: the smallest id of the same pixels; component_id: the smallest id reachable
    by links between copies.
    """
    known = materialize(features(plain(images, id=id_col, image=F.col(f"`{image_col}`").cast("binary"))))
    classes = known.where("cls is not null").groupBy("cls").agg(F.min("id").alias("image_class"), (F.max(F.length("corners")) / 32).cast("int").alias("corners"))
    # A class of fewer corners than votes is nobody's copy.
    # Only rows of repeated pixels are reduced to one: corners of the others needn't move.
    able = known.where(F.length("corners") >= 32 * votes).select("cls", "corners")
    again = materialize(known.where("cls is not null").groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cls"))
    one = materialize(able.join(again, "cls", "left_anti").unionByName(able.join(again, "cls", "left_semi").dropDuplicates(["cls"])))
    heavy = heavy_keys(one)
    met = materialize(meetings(entries(one, heavy), budget, hot))
    few = met.where("b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("agreed"))
    in_hot = met.where("b is null").select(F.col("a").alias("cls"), "key", "kp").unionByName(entries(one, heavy, only=True).select("cls", F.shiftright("at", NUMBER).alias("key"), F.col("at").bitwiseAND(F.lit((1 << NUMBER) - 1)).cast("int").alias("kp")))
    # A corner in a hot key: 31 bits of the key's hash, and the corner's number.
    mark = F.shiftleft(F.xxhash64("key").bitwiseAND(F.lit(0x7FFFFFFF)), NUMBER).bitwiseOR(F.col("kp").cast("long"))
    common = materialize(in_hot.groupBy("cls").agg(F.count_distinct("kp").cast("int").alias("more"), F.collect_list(mark).alias("hot")))
    about = materialize(one.select("cls", (F.length("corners") / 32).cast("int").alias("n")).join(common.select("cls", "more"), "cls", "left").select("cls", "n", F.coalesce("more", F.lit(0)).alias("more")))
    left, right = (about.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("more").alias(f"more_{c}")) for c in ("a", "b"))
    need = F.greatest(F.lit(votes), F.ceil(F.least("n_a", "n_b") * share - 1e-9))
    maybe = few.join(left, "a").join(right, "b").withColumn("need", need).where(F.col("agreed") + F.least("more_a", "more_b") >= F.col("need"))
    # A pair that lacks some may only find them in hot keys that both have.
    maybe = materialize(maybe.select("a", "b", "n_a", "n_b", "agreed", F.col("need").cast("long").alias("need")))
    lacking = maybe.where("agreed < need")
    for c in ("a", "b"):
        lacking = lacking.join(common.select(F.col("cls").alias(c), F.col("hot").alias(f"hot_{c}")), c)
    maybe = maybe.where("agreed >= need").unionByName(with_enough(lacking))
    first_is_big = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") > F.col("b")))
    pairs = materialize(maybe.select(F.when(first_is_big, F.col("a")).otherwise(F.col("b")).alias("big"), F.when(first_is_big, F.col("b")).otherwise(F.col("a")).alias("small")))
    linked = verified(pairs, one, votes, share, budget)
    group = in_hot.join(about.where(F.col("more") >= votes).select("cls"), "cls").select("key", "cls").distinct()
    group = materialize(group)
    least_of = materialize(group.groupBy("key").agg(F.min("cls").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "b"))
    if not least_of.isEmpty():
        reach = materialize(components(group.join(least_of, "key").where("cls <> b").select(F.col("cls").alias("a"), "b")))
        member = materialize(reach.join(one, reach["node"] == one["cls"]).select("root", F.col("node").alias("id"), F.length("corners").cast("long").alias("size"), "corners"))
        compare = lambda rows, label, second: similar_in_tile([x[0] for x in rows], label, second, votes, share, budget)
        linked = linked.unionByName(group_links(member, ["corners"], compare, side))
    reach = materialize(components(linked))
    least = materialize(classes.join(reach.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    first = materialize(least.groupBy("root").agg(F.min("image_class").alias("component_id")))
    about = materialize(least.join(first, "root").select("cls", "image_class", "component_id", "corners"))
    return known.select("id", "cls").join(about, "cls", "left").select("id", "image_class", "component_id", "corners")


def page_images(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, image): a picture of each whole page; null for a null page."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([None if x is None else render_page(x) for x in b.column("page").to_pylist()], pa.binary())], names=["id", "image"])

    rows = plain(pages, id=id_col, page=html_col)
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, image binary")
