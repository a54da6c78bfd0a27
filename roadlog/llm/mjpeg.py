"""Media columns as AVI motion JPEG: store samples, read RIFF indexes, decode intra frames, detect shots.

Samples are stored without loss in baseline JPEG frames: one sample is the DC coefficient of one 8 x 8 block
(quantiser 8), so a frame of 24 x 24 samples is a picture of 192 x 192 pixels in flat blocks. The Huffman table of the
frames gives a difference of category c a code of 9 - c bits; with its c further bits and the end of the block, each block takes
10 bits, and frames of this kind decode as arrays. Frames of other encoders go through the general
baseline decoder.

Shots: a cut lies where the histogram difference of neighbouring frames exceeds the mean by `spread` standard
deviations of the differences around it, and a floor. Clips are timed by the frame period of the header.

Cases: a null text is empty; an empty payload is one frame of padding; equal payloads give equal files and features;
long payloads are coded in groups of frames; rows repeat as they come; an empty table gives no rows; only id and text are
read. A file without an index is read by walking its chunks; a broken file raises an error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlog.llm.common import field, id_text, map_texts

SIDE = 24
FRAME = SIDE * SIDE
PERIOD_US = 40_000
GROUP = 1024
BINS = 16
SPREAD, FLOOR, AROUND = 2.0, 0.15, 8

# fixed values: the zigzag order of JPEG coefficients
ZIGZAG = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
          35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def _head() -> bytes:
    """Everything of a frame before its coded blocks."""
    lengths = bytes([1] * 9 + [0] * 7)                      # one DC code of each length: categories 8, 7, ... 0
    return (b"\xff\xd8" + _segment(0xDB, bytes([0, 8] + [1] * 63))
            + _segment(0xC0, struct.pack(">BHHB3B", 8, 8 * SIDE, 8 * SIDE, 1, 1, 0x11, 0))
            + _segment(0xC4, b"\x00" + lengths + bytes(range(8, -1, -1)))
            + _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00")
            + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])))


HEAD = _head()


def _codes() -> np.ndarray:
    """The ten bits of a block for each difference, which is from -255 to 255."""
    out = np.zeros(511, np.uint16)
    for diff in range(-255, 256):
        c = abs(diff).bit_length()
        code = (1 << (9 - c)) - 2 if c else 0b111111110
        extra = diff if diff >= 0 else diff + (1 << c) - 1
        out[diff + 255] = ((code << c) | extra) << 1
    return out


CODES = _codes()


def payload(text: str) -> bytes:
    """A text's bytes, filled up with 255 to whole frames, one at least."""
    raw = text.encode()
    return raw + b"\xff" * (-len(raw) % FRAME or FRAME * (not raw))


def encode(frames: np.ndarray) -> list[bytes]:
    """JPEG files of frames (n, 576)."""
    out: list[bytes] = []
    for at in range(0, len(frames), GROUP):
        diff = np.diff(frames[at:at + GROUP].astype(np.int16) - 128, axis=1, prepend=0)
        code = CODES[diff + 255]
        bits = ((code[:, :, None] >> np.arange(9, -1, -1, dtype=np.uint16)) & 1).astype(np.uint8)
        packed = np.packbits(bits.reshape(len(diff), -1), axis=1)
        out += [HEAD + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in packed]
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def container(frames: list[bytes], period_us: int = PERIOD_US, side: int = 8 * SIDE) -> bytes:
    """An AVI file of JPEG frames with its index."""
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", period_us, largest * 1_000_000 // period_us, 0, 0x10, len(frames), 0, 1, largest, side, side, 0, 0, 0, 0)
    strh = struct.pack("<4s4sI2HI8I4H", b"vids", b"MJPG", 0, 0, 0, 0, period_us, 1_000_000, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, 0, side, side)[:56]
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 24, b"MJPG", side * side * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    at, body, index = 4, [b"movi"], []
    for frame in frames:
        body.append(_chunk(b"00dc", frame))
        index.append(struct.pack("<4s3I", b"00dc", 0x10, at, len(frame)))
        at += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, begin and end of each chunk; lists carry the name of their kind."""
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        begin, stop = at + 8, min(at + 8 + size, end)
        if name in (b"RIFF", b"LIST"):
            name, begin = data[begin:begin + 4], begin + 4
        yield name, begin, stop
        at = stop + size % 2


def parse(data: bytes) -> tuple[int, list[bytes]]:
    """Frame period in microseconds and the coded frames, by the index where there is one."""
    period, movi, index = PERIOD_US, None, None
    for kind, begin, end in _chunks(data, 0, len(data)):
        if kind != b"AVI ":
            raise ValueError("not an AVI file")
        for name, a, b in _chunks(data, begin, end):
            if name == b"hdrl":
                period = next((struct.unpack_from("<I", data, x)[0] for n, x, _ in _chunks(data, a, b) if n == b"avih"), period)
            elif name == b"movi":
                movi = (a, b)
            elif name == b"idx1":
                index = (a, b)
    if movi is None:
        raise ValueError("an AVI file without frames")
    if index is None:
        return period, [data[a:b] for name, a, b in _chunks(data, *movi) if name[2:] in (b"dc", b"db")]
    entries = [e for e in struct.iter_unpack("<4s3I", data[index[0]:index[1]]) if e[0][2:] in (b"dc", b"db")]
    base = movi[0] - 4 if entries and data[movi[0] - 4 + entries[0][2]:][:4] == entries[0][0] else 0     # some writers count from the file's start
    return period, [data[base + at + 8:base + at + 8 + size] for _, _, at, size in entries]


class Layout:
    """The tables in front of a frame's coded blocks."""

    def __init__(self, data: bytes):
        self.quant: dict[int, np.ndarray] = {}
        self.huff: dict[int, list[tuple[int, int, int]]] = {}       # length, code, symbol
        self.parts: list[tuple[int, int, int, int]] = []            # id, across, down, quantiser
        self.restart = 0
        at = 2
        while True:
            mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4:at + 2 + size]
            at += 2 + size
            if mark == 0xDB:
                self._quantisers(body)
            elif mark == 0xC4:
                self._huffman(body)
            elif mark in (0xC0, 0xC1):
                self.height, self.width, n = struct.unpack_from(">HHB", body, 1)
                self.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            elif mark == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif mark in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
                raise ValueError("only baseline frames are read")
            elif mark == 0xDA:
                self.scan = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
                break
        self.end = at
        self.flat = self._flat()

    def _quantisers(self, body: bytes) -> None:
        while body:
            wide = body[0] >> 4
            self.quant[body[0] & 15] = np.frombuffer(body[1:65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
            body = body[65 + 64 * wide:]

    def _huffman(self, body: bytes) -> None:
        while body:
            counts, at, code, table = body[1:17], 17, 0, []
            for length, n in enumerate(counts, 1):
                for _ in range(n):
                    table.append((length, code, body[at]))
                    at, code = at + 1, code + 1
                code <<= 1
            self.huff[body[0]] = table
            body = body[at:]

    def _flat(self) -> np.ndarray | None:
        """Differences by coded bits where every block has one width and no AC coefficient, else None."""
        if len(self.parts) != 1 or self.restart:
            return None
        dc, ac = self.scan[self.parts[0][0]]
        widths = {length + symbol for length, _, symbol in self.huff[dc]}
        if len(widths) != 1 or self.huff[16 + ac] != [(1, 0, 0)]:
            return None
        width = widths.pop()
        out = np.full(1 << width, 1 << 14, np.int64)
        for length, code, c in self.huff[dc]:
            for extra in range(1 << c):
                out[(code << c) | extra] = extra if not c or extra >> (c - 1) else extra - (1 << c) + 1
        return out


def decode_flat(layout: Layout, coded: list[bytes]) -> np.ndarray:
    """Block values (n, blocks) of frames whose blocks all have one width."""
    blocks = -(-layout.height // 8) * -(-layout.width // 8)
    width = len(layout.flat).bit_length()           # the difference's bits and one for the end of the block
    size = -(-blocks * width // 8)
    scale = int(layout.quant[layout.parts[0][3]][0])
    out = np.zeros((len(coded), blocks), np.uint8)
    weights = 1 << np.arange(width - 2, -1, -1)
    for at in range(0, len(coded), GROUP):
        group = coded[at:at + GROUP]
        if any(len(x) != size for x in group):
            raise ValueError("a coded frame has another length than its blocks")
        bits = np.unpackbits(np.frombuffer(b"".join(group), np.uint8).reshape(len(group), size), axis=1)[:, :blocks * width]
        bits = bits.reshape(len(group), blocks, width)
        diff = layout.flat[bits[:, :, :-1] @ weights]
        if bits[:, :, -1].any() or (diff == 1 << 14).any():
            raise ValueError("a coded frame has a code that its tables lack")
        out[at:at + GROUP] = np.clip(np.round(np.cumsum(diff, axis=1) * scale / 8) + 128, 0, 255)
    return out


def decode(frame: bytes) -> np.ndarray:
    """The luma plane of a baseline JPEG frame."""
    layout = Layout(frame)
    data = frame[layout.end:]
    pieces, at = [], 0
    while True:                                     # the coded data in pieces between restart marks
        stop = at
        while not (data[stop] == 0xFF and data[stop + 1] != 0):
            stop = data.index(b"\xff", stop + 1 if data[stop] == 0xFF else stop)
            if data[stop + 1] == 0:
                stop += 1
        pieces.append(data[at:stop].replace(b"\xff\x00", b"\xff"))
        if not 0xD0 <= data[stop + 1] <= 0xD7:
            break
        at = stop + 2
    most_x, most_y = max(p[1] for p in layout.parts), max(p[2] for p in layout.parts)
    single = len(layout.parts) == 1
    across = -(-layout.width // (8 if single else 8 * most_x))
    down = -(-layout.height // (8 if single else 8 * most_y))
    parts = [(k, 1, 1) if single else (k, p[1], p[2]) for k, p in enumerate(layout.parts)]
    luma = np.zeros((down * parts[0][2], across * parts[0][1], 64))
    symbols = {k: {(length, code): s for length, code, s in table} for k, table in layout.huff.items()}
    units, last, bits = across * down, [0] * len(parts), _Bits(b"")
    for unit in range(units):
        if unit % (layout.restart or units) == 0:
            bits, last = _Bits(pieces.pop(0)), [0] * len(parts)
        y, x = divmod(unit, across)
        for k, wide, high in parts:
            dc, ac = layout.scan[layout.parts[k][0]]
            for sub in range(wide * high):
                block = _block(bits, symbols[dc], symbols[16 + ac])
                last[k] += block[0]
                block[0] = last[k]
                if k == 0:
                    luma[y * high + sub // wide, x * wide + sub % wide, ZIGZAG] = np.array(block) * layout.quant[layout.parts[0][3]]
    u = np.arange(8)
    basis = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    pixels = np.einsum("xu,abuv,yv->abxy", basis, luma.reshape(*luma.shape[:2], 8, 8), basis)
    plane = pixels.transpose(0, 2, 1, 3).reshape(luma.shape[0] * 8, -1)
    return np.clip(np.round(plane) + 128, 0, 255).astype(np.uint8)[:layout.height, :layout.width]


class _Bits:
    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        self.at = 0

    def take(self, n: int) -> int:
        value = 0
        for b in self.bits[self.at:self.at + n]:
            value = value << 1 | b
        self.at += n
        return value

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("a coded frame has a code that its tables lack")

    def value(self, c: int) -> int:
        x = self.take(c)
        return x if not c or x >> (c - 1) else x - (1 << c) + 1


def _block(bits: _Bits, dc: dict, ac: dict) -> list[int]:
    out = [0] * 64
    out[0] = bits.value(bits.symbol(dc))
    k = 1
    while k < 64:
        s = bits.symbol(ac)
        if s == 0:
            break
        k += s >> 4
        if s & 15:
            out[k] = bits.value(s & 15)
        k += 1
    return out


def samples(files: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """Per AVI file the frame period and the block values (frames, blocks) of its frames."""
    found: list[tuple[int, int]] = []
    grouped: dict[bytes, list[tuple[int, bytes]]] = {}
    layouts: dict[bytes, Layout] = {}
    odd: dict[int, np.ndarray] = {}
    head, n = b"", -1
    for data in files:
        period, frames = parse(data)
        found.append((period, len(frames)))
        for frame in frames:
            n += 1
            if not head or not frame.startswith(head):
                layout = Layout(frame)
                head = frame[:layout.end]
                layouts[head] = layout
                grouped.setdefault(head, [])
            if layouts[head].flat is None:
                odd[n] = decode(frame)[4::8, 4::8].reshape(-1)
                grouped[head].append((n, b""))
            else:
                grouped[head].append((n, frame[len(head):-2].replace(b"\xff\x00", b"\xff")))
    rows: dict[int, np.ndarray] = dict(odd)
    for key, members in grouped.items():
        if layouts[key].flat is not None:
            rows.update(zip((n for n, _ in members), decode_flat(layouts[key], [x for _, x in members])))
    out, at = [], 0
    for period, count in found:
        out.append((period, np.array([rows[n] for n in range(at, at + count)], np.uint8)))
        at += count
    return out


def cuts(frames: np.ndarray, spread: float = SPREAD, floor: float = FLOOR, around: int = AROUND) -> tuple[list[int], np.ndarray]:
    """First frames of the shots, and the histogram difference of each frame from the one before."""
    n = len(frames)
    if n == 0:
        return [], np.zeros(0)
    bins = frames.astype(np.int64) * BINS // 256 + BINS * np.arange(n)[:, None]
    hist = np.bincount(bins.reshape(-1), minlength=BINS * n).reshape(n, BINS) / frames.shape[1]
    diff = np.concatenate(([0.0], np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2))
    if n < 2:
        return [0], diff
    total, square = np.concatenate(([0.0], np.cumsum(diff))), np.concatenate(([0.0], np.cumsum(diff * diff)))
    at = np.arange(1, n)
    low, high = np.maximum(1, at - around), np.minimum(n, at + around + 1)
    others = np.maximum(high - low - 1, 1)                                      # the differences around, without its own
    mean = (total[high] - total[low] - diff[1:]) / others
    var = np.maximum((square[high] - square[low] - diff[1:] ** 2) / others - mean ** 2, 0)
    return [0, *(at[diff[1:] > np.maximum(mean + spread * np.sqrt(var), floor)]).tolist()], diff


def store(texts: list[str]) -> tuple[list[bytes], list[bytes]]:
    """Payloads and their AVI files."""
    loads = [payload(t) for t in texts]
    frames = encode(np.frombuffer(b"".join(loads), np.uint8).reshape(-1, FRAME))
    files, at = [], 0
    for load in loads:
        n = len(load) // FRAME
        files.append(container(frames[at:at + n]))
        at += n
    return loads, files


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and `media`, the AVI file of each text."""
    def work(texts: list[str]) -> dict:
        return {"n_bytes": [len(t.encode()) for t in texts], "media": [x for g in _groups(texts) for x in store(g)[1]]}

    return map_texts(id_text(docs, id_col, text_col), work, [field("n_bytes", "long"), field("media", "binary")])


def _groups(texts: list[str], chars: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in runs of about a million characters, a longer text by itself."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > chars:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


_READ = [field("n_bytes", "long"), field("payload_bytes", "long"), field("payload_sha256", "string"), field("tail_crc32", "long"), field("media_bytes", "long"),
         field("media_sha256", "string"), field("period_us", "long"), field("starts", "int[]"), field("ends", "int[]"), field("peaks", "double[]")]


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as an AVI file, read the file back, and describe what was read: digests and shots."""
    def work(texts: list[str]) -> dict:
        out: dict[str, list] = {f.name: [] for f in _READ}
        for group in _groups(texts):
            files = store(group)[1]
            for text, data, (period, frames) in zip(group, files, samples(files)):
                back = frames.tobytes()
                starts, diff = cuts(frames)
                for name, value in zip(out, (len(text.encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data),
                                             hashlib.sha256(data).hexdigest(), period, starts, [*starts[1:], len(frames)], [float(diff[s]) for s in starts])):
                    out[name].append(value)
        return out

    return map_texts(id_text(docs, id_col, text_col), work, _READ)


def clips(described_rows: DataFrame) -> DataFrame:
    """One row per clip: doc_id, clip, first_frame, n_frames, start_s, end_s, peak."""
    each = described_rows.select("doc_id", "period_us", F.posexplode(F.arrays_zip("starts", "ends", "peaks")).alias("clip", "c"))
    second = F.col("period_us") / 1e6
    return each.select("doc_id", "clip", F.col("c.starts").alias("first_frame"), (F.col("c.ends") - F.col("c.starts")).alias("n_frames"),
                       (F.col("c.starts") * second).alias("start_s"), (F.col("c.ends") * second).alias("end_s"), F.col("c.peaks").alias("peak"))
