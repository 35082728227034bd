"""Media columns: baseline JPEG written and parsed in numpy, luminance thumbnails from DC coefficients only.

A payload is stored losslessly in the DC coefficients: each byte is one 8x8 luminance block of that sample value, with a
quantiser of 8, so that the DC-only thumbnail of the stored image is the payload. Rows of 64 blocks are restart intervals,
which lets numpy decode all rows of a batch of images in lockstep. The parser takes any 8-bit baseline JPEG: own tables,
components with sampling factors, with or without restart markers.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: Blocks in a row of a stored payload, and the rows of one image (65,535 pixels at most).
ROW, ROWS = 64, 8191
#: Number of DC codes of each length from 1 to 16, and their categories: shorter codes for small differences.
DC_COUNTS, DC_VALUES = [0, 1, 2, 3, 1, 1, 1] + [0] * 9, [5, 4, 6, 0, 3, 7, 2, 1, 8]
#: The only AC code is the end of a block.
AC_COUNTS, AC_VALUES = [1] + [0] * 15, [0]


class JpegError(ValueError):
    pass


def huffman_codes(counts, values) -> dict[int, tuple[int, int]]:
    """Category -> (code, length), codes dealt out in order of length."""
    out, code, k = {}, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out[values[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def huffman_table(counts, values) -> np.ndarray:
    """For each 16 bits ahead: symbol << 8 | code length; 0 where no code fits."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, (code, length) in huffman_codes(counts, values).items():
        a = code << (16 - length)
        table[a : a + (1 << (16 - length))] = symbol << 8 | length
    return table


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    dqt = bytes([0]) + bytes([8] + [1] * 63)
    sof = struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + bytes([1, 0x11, 0])
    dht = bytes([0x00, *DC_COUNTS, *DC_VALUES, 0x10, *AC_COUNTS, *AC_VALUES])
    return b"\xff\xd8" + _segment(0xDB, dqt) + _segment(0xC0, sof) + _segment(0xC4, dht) + _segment(0xDD, struct.pack(">H", ROW)) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


_CODE = np.zeros(9, np.int64)
_LEN = np.zeros(9, np.int64)
for _c, (_v, _l) in huffman_codes(DC_COUNTS, DC_VALUES).items():
    _CODE[_c], _LEN[_c] = _v, _l
#: For each difference + 256: bits of code, extra bits and end-of-block code, and their number.
_SYMBOL = np.zeros(513, np.uint32)
_BITS = np.zeros(513, np.int32)
for _d in range(-255, 256):
    _c = abs(_d).bit_length()
    _extra = _d if _d >= 0 else _d + (1 << _c) - 1
    _SYMBOL[_d + 256] = (int(_CODE[_c]) << _c | _extra) << 1
    _BITS[_d + 256] = int(_LEN[_c]) + _c + 1


def encode_rows(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded, byte-stuffed bytes of each row of 64 samples, and where each row starts in them."""
    n = len(samples)
    diff = np.empty((n, ROW), np.int16)
    diff[:, 0] = samples[:, 0].astype(np.int16) - 128
    np.subtract(samples[:, 1:], samples[:, :-1], out=diff[:, 1:], dtype=np.int16)
    diff += 256
    bits = _BITS[diff]
    ends = np.cumsum(bits, axis=1, dtype=np.int32)
    size = (ends[:, -1] + 7) >> 3
    at = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    begin = (ends - bits) + (at[:-1] * 8)[:, None]
    value = (_SYMBOL[diff].astype(np.uint64) << (40 - bits - (begin & 7)).astype(np.uint64)).ravel()
    byte = (begin >> 3).ravel()
    total = int(at[-1])
    out = np.zeros(total + 5, np.uint8)
    for k in range(3):  # 19 bits and an offset of up to 7 reach into four bytes
        part = ((value >> np.uint64(32 - 8 * k)) & np.uint64(255)).astype(np.uint8)
        _or_at(out, byte + k, part)
    rest = ((value >> np.uint64(8)) & np.uint64(255)).astype(np.uint8)
    some = rest != 0
    _or_at(out, byte[some] + 3, rest[some])
    pad = (size * 8 - ends[:, -1]).astype(np.int64)
    out[at[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    out = out[:total]
    full = np.flatnonzero(out == 255)
    stuffed = np.insert(out, full + 1, 0) if len(full) else out
    return stuffed, at + np.searchsorted(full, at)


def _or_at(out: np.ndarray, index: np.ndarray, value: np.ndarray) -> None:
    """out[index] |= value with sorted repeated indices; the bits of one byte never overlap, so sums do."""
    if not len(index):
        return
    first = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
    out[index[first]] |= np.bitwise_or.reduceat(value, first)


def store_payloads(data: np.ndarray, offsets: np.ndarray) -> list[tuple[bytes, int]]:
    """Of each text: the JPEG images, one after the other, that store its bytes padded to a positive multiple of 64."""
    lens = np.diff(offsets)
    padded = np.maximum(64, (lens + 63) // 64 * 64)
    at = np.concatenate(([0], np.cumsum(padded)))
    flat = np.zeros(int(at[-1]), np.uint8)
    flat[np.arange(len(data)) + np.repeat(at[:-1] - offsets[:-1], lens)] = data
    coded, where = encode_rows(flat.reshape(-1, ROW))
    coded = coded.tobytes()
    out = []
    for i, size in enumerate(padded.tolist()):
        row, rows, media = int(at[i]) // ROW, size // ROW, []
        for a in range(0, rows, ROWS):
            n = min(ROWS, rows - a)
            media.append(_header(n))
            for r in range(n):
                if r:
                    media.append(_RST[(r - 1) % 8])
                media.append(coded[where[row + a + r] : where[row + a + r + 1]])
            media.append(b"\xff\xd9")
        out.append((b"".join(media), size))
    return out


_RST = [bytes([0xFF, 0xD0 + k]) for k in range(8)]


class Frame:
    """Headers of one image, the entropy-coded bytes of its scan without stuffing, and its restart segments."""

    def __init__(self):
        self.quant, self.dc, self.ac = {}, {}, {}
        self.restart, self.components = 0, []
        self.width = self.height = 0
        self.scan = b""


_TABLES: dict[bytes, np.ndarray] = {}


def parse(media: bytes) -> list[Frame]:
    """The images of a stream. Raises JpegError where it isn't baseline JPEG."""
    frames, i, f = [], 0, None
    while i < len(media):
        if media[i] != 0xFF or i + 1 >= len(media):
            raise JpegError(f"no marker at byte {i}")
        m = media[i + 1]
        if m == 0xD8:
            f, i = Frame(), i + 2
            continue
        if f is None:
            raise JpegError("no start of image")
        if m == 0xD9:
            if not f.scan:
                raise JpegError("an image without a scan")
            frames.append(f)
            f, i = None, i + 2
            continue
        if m == 0xFF:
            i += 1
            continue
        if i + 4 > len(media):
            raise JpegError("truncated segment")
        size = int.from_bytes(media[i + 2 : i + 4], "big")
        body = media[i + 4 : i + 2 + size]
        if len(body) != size - 2:
            raise JpegError("truncated segment")
        i += 2 + size
        if m == 0xDB:
            k = 0
            while k < len(body):
                wide, name = body[k] >> 4, body[k] & 15
                f.quant[name] = int.from_bytes(body[k + 1 : k + 2 + wide], "big")  # the DC entry comes first
                k += 1 + 64 * (1 + wide)
        elif m == 0xC4:
            k = 0
            while k < len(body):
                kind, name, counts = body[k] >> 4, body[k] & 15, list(body[k + 1 : k + 17])
                n = sum(counts)
                raw = body[k + 1 : k + 17 + n]
                if raw not in _TABLES:
                    if len(_TABLES) > 64:
                        _TABLES.clear()
                    _TABLES[raw] = huffman_table(counts, list(raw[16:]))
                (f.ac if kind else f.dc)[name] = _TABLES[raw]
                k += 17 + n
        elif m == 0xC0:
            bits, f.height, f.width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not f.width or not f.height:
                raise JpegError("only 8-bit samples and stated sizes are baseline")
            f.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC1 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC):
            raise JpegError("not a baseline image")
        elif m == 0xDD:
            f.restart = int.from_bytes(body[:2], "big")
        elif m == 0xDA:
            if not f.components or body[0] != len(f.components):
                raise JpegError("only one scan of all components is read")
            f.tables = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
            j = i
            while True:  # to the first marker that is no restart and no stuffed byte
                j = media.find(b"\xff", j)
                if j < 0 or j + 1 >= len(media):
                    raise JpegError("a scan without an end")
                if media[j + 1] == 0 or 0xD0 <= media[j + 1] <= 0xD7:
                    j += 2
                    continue
                break
            f.scan, i = media[i:j], j
    if f is not None or not frames:
        raise JpegError("an image without an end")
    return frames


def _split(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes without stuffing and restart markers, and the segments' bounds in them."""
    ff = np.flatnonzero(scan[:-1] == 255)
    after = scan[ff + 1]
    keep = np.ones(len(scan), bool)
    keep[ff[after == 0] + 1] = False
    marks = ff[after != 0]
    keep[marks] = False
    keep[marks + 1] = False
    removed = np.cumsum(~keep)
    return scan[keep], np.concatenate(([0], marks - (removed[marks] - 1), [int(keep.sum())]))


def luminance_thumbnails(frames: list[Frame]) -> list[np.ndarray]:
    """Of each image the mean of each 8x8 luminance block (uint8, block rows x block columns), from DC values only.

    Images with equal tables and layout are decoded together, all their restart segments in lockstep."""
    out: list = [None] * len(frames)
    groups: dict = {}
    for i, f in enumerate(frames):
        try:
            layout = tuple((c, h, v, id(f.dc[f.tables[c][0]]), id(f.ac[f.tables[c][1]]), f.quant[q]) for c, h, v, q in f.components)
        except KeyError as e:
            raise JpegError(f"a table is missing: {e}") from None
        groups.setdefault((layout, f.restart), []).append(i)
    for group in groups.values():
        _decode(frames, group, out)
    return out


def _decode(frames, group, out) -> None:
    f0 = frames[group[0]]
    single = len(f0.components) == 1
    hmax, vmax = max(c[1] for c in f0.components), max(c[2] for c in f0.components)
    units, luma = [], f0.components[0]
    for k, (c, h, v, _) in enumerate(f0.components):
        d, a = f0.tables[c]
        units += [(k, f0.dc[d], f0.ac[a])] * (1 if single else h * v)
    mcus = []
    for i in group:
        f = frames[i]
        w, h = (8, 8) if single else (8 * hmax, 8 * vmax)
        mcus.append((-(-f.height // h), -(-f.width // w)))
    scans = b"".join(frames[i].scan + b"\xff\xd0" for i in group)
    data, bounds = _split(np.frombuffer(scans, np.uint8))
    bounds = bounds[:-1]
    starts, ends = bounds[:-1] * 8, bounds[1:] * 8
    counts = []
    for rows, cols in mcus:
        total = rows * cols
        step = f0.restart or total
        counts.append(np.minimum(step, total - np.arange(0, total, step)))
    count = np.concatenate(counts)
    if len(count) != len(starts):
        raise JpegError("restart markers don't fit the restart interval")
    # 32 bits from each byte on: a code or extra bits reach 16 + 7 bits from their byte
    pad = np.concatenate((data, np.full(8, 255, np.uint8))).astype(np.uint32)
    ahead = (pad[:-3] << np.uint32(24)) | (pad[1:-2] << np.uint32(16)) | (pad[2:-1] << np.uint32(8)) | pad[3:]
    n_luma = luma[1] * luma[2] if not single else 1
    most = int(count.max())
    got = np.zeros((len(starts), most * n_luma), np.int32)
    pos = starts.astype(np.int64)
    pred = np.zeros((len(f0.components), len(starts)), np.int32)
    even = bool((count == most).all())
    limit = len(ahead) - 1

    def peek(p):
        return (ahead[np.minimum(p >> 3, limit)] << (p & 7).astype(np.uint32)) >> np.uint32(16)

    for m in range(most):
        on = slice(None) if even else np.flatnonzero(count > m)
        p, seen = pos[on], 0
        for k, dc, ac in units:
            code = dc[peek(p)]
            if not code.all():
                raise JpegError("a code that no table has")
            p = p + (code & 255)
            cat = code >> 8
            if cat.max() > 11:
                raise JpegError("a DC category beyond 11")
            extra = (peek(p) >> (16 - cat).astype(np.uint32)).astype(np.int32)
            half = (1 << cat) >> 1
            pred[k, on] += np.where(extra < half, extra - (1 << cat) + 1, extra)
            p = p + cat
            if k == 0:
                got[on, m * n_luma + seen] = pred[0, on]
                seen += 1
            code = ac[peek(p)]
            if (code == (0 << 8 | (code & 255))).all() and code.all():  # only ends of blocks
                p = p + (code & 255)
                continue
            at = np.ones(len(p), np.int32)
            live = np.arange(len(p))
            while len(live):
                code = ac[peek(p[live])]
                if not code.all():
                    raise JpegError("a code that no table has")
                symbol = code >> 8
                size = symbol & 15
                p[live] += (code & 255) + size
                at[live] += np.where(size == 0, np.where(symbol == 0xF0, 16, 64), (symbol >> 4) + 1)
                live = live[at[live] < 64]
        pos[on] = p
    if (pos > ends).any():
        raise JpegError("a scan that ends early")
    quant = f0.quant[luma[3]]
    value = np.clip((got * quant + 4) // 8 + 128, 0, 255).astype(np.uint8)
    s = 0
    for i, (rows, cols), c in zip(group, mcus, counts, strict=True):
        f, own = frames[i], value[s : s + len(c)]
        if most == c[0]:  # only a last segment is shorter
            flat = own.reshape(-1)[: rows * cols * n_luma]
        else:
            flat = np.concatenate([own[j, : x * n_luma] for j, x in enumerate(c)])
        s += len(c)
        if n_luma > 1:
            flat = flat.reshape(rows, cols, luma[2], luma[1]).transpose(0, 2, 1, 3)
            grid = flat.reshape(rows * luma[2], cols * luma[1])
        else:
            grid = flat.reshape(rows, cols)
        high = -(-(-(-f.height * (1 if single else luma[2]) // (1 if single else vmax))) // 8)
        wide = -(-(-(-f.width * (1 if single else luma[1]) // (1 if single else hmax))) // 8)
        out[i] = grid[:high, :wide]


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64-bit average hash over an 8x8 grid of cell means, as hex."""
    rows, cols = thumb.shape
    y = np.arange(9) * rows // 8
    x = np.arange(9) * cols // 8
    total = np.zeros((rows + 1, cols + 1), np.int64)
    total[1:, 1:] = thumb.astype(np.int64).cumsum(0).cumsum(1)
    y1, x1 = np.maximum(y[1:], y[:-1] + 1).clip(max=rows), np.maximum(x[1:], x[:-1] + 1).clip(max=cols)
    y0, x0 = np.minimum(y[:-1], rows - 1), np.minimum(x[:-1], cols - 1)
    cells = total[np.ix_(y1, x1)] - total[np.ix_(y0, x1)] - total[np.ix_(y1, x0)] + total[np.ix_(y0, x0)]
    area = (y1 - y0)[:, None] * (x1 - x0)[None, :]
    mean = int(total[-1, -1])
    on = cells * (rows * cols) > mean * area
    return f"{int(''.join('1' if b else '0' for b in on.ravel()), 2):016x}"


def read_payload(thumbs: list[np.ndarray]) -> bytes:
    return b"".join(t.tobytes() for t in thumbs)


_OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width long, height long, frames int, feature string"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Stores each text as JPEG, reads the stored bytes back and returns sizes, digests, dimensions and thumbnail hashes.

    keep_media adds the stored bytes as column media. Null text counts as empty and gives one row of 64 zero bytes; long
    texts span images of 8,191 rows of blocks. Rows are treated one by one: repeated rows give repeated results; other
    columns, whatever their names, are ignored; an empty table gives an empty result."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in text_slices(batch.column(1), 1 << 20):
                stored = store_payloads(data, offsets)
                frames, owner = [], []
                for k, (media, _) in enumerate(stored):
                    own = parse(media)
                    frames += own
                    owner.append(len(own))
                thumbs, t, features = luminance_thumbnails(frames), 0, []
                cols: list[list] = [[] for _ in range(9 + keep_media)]
                for (media, size), n, k in zip(stored, owner, range(b - a), strict=True):
                    payload = read_payload(thumbs[t : t + n])
                    height = sum(f.height for f in frames[t : t + n])
                    whole = np.concatenate(thumbs[t : t + n]) if n > 1 else thumbs[t]
                    row = (int(offsets[k + 1] - offsets[k]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), frames[t].width, height, n)
                    feature = f"{row[6]}x{height}:{thumbnail_hash(whole)}"
                    for c, v in zip(cols, row, strict=False):
                        c.append(v)
                    if keep_media:
                        cols[9].append(media)
                    features.append(feature)
                    t += n
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
                arrays = [ids.slice(a, b - a), *(pa.array(c, kind) for c, kind in zip(cols[:9], kinds, strict=True)), pa.array(features)]
                names = [x.split()[0] for x in _OUT.split(", ")]
                if keep_media:
                    arrays.append(pa.array(cols[9], pa.binary()))
                    names.append("media")
                yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _OUT.replace("doc_id long", f"doc_id {kind}") + ", media binary" * keep_media)
