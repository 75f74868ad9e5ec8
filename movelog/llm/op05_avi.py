"""Media columns of AVI motion-JPEG: RIFF index, intra frames, shots as timed clip rows.

Reading parses the RIFF chunks and the idx1 index (or walks the chunks where there is none), decodes
every frame as a baseline JPEG of one or more components (Huffman codes, the standard's where a frame
has none, restart markers, dequantisation, inverse DCT), takes a luma histogram of each frame and cuts
shots where the difference of two histograms stands out of its neighbourhood.

Writing stores any bytes without loss. The format's unit is the quantised coefficient: all values
of size category 8 (128 to 255 and -255 to -128) carry one byte each, behind the one 8-bit code of
the frame's Huffman tables; a frame is 24 x 24, so nine blocks of 64 coefficients hold 576 bytes.
Quantiser steps are 1 and each block is a restart interval, so no value depends on another.

Codes and values then fill whole bytes, and such frames decode by reshaping; frames with any other
tables go through the bit-by-bit decoder. Nothing is shuffled; memory depends on the block.

Defined results: a null or empty text is one frame of 576 bytes of 255; equal texts give equal
media; repeated rows give one row each; an empty table gives no rows; extra columns are ignored. A
media value that is null, no AVI or without frames gives no clips; of one that `store` has not written
the stored bytes are null, of a null one all features, and one that is no AVI is "undecodable". A
frame that cannot be decoded (progressive, damaged) counts with the histogram of the frame before it.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import blocks, map_frames, table, texts

SIDE, UNIT = 24, 576
FRAMES_A_SECOND = 25
BINS = 16
#: A cut: this far above the mean difference of the frames around, in standard deviations, and at least so large.
WINDOW, SIGMAS, LEAST = 4, 2.0, 0.08


def zigzag_order() -> np.ndarray:
    """Row-major place of each coefficient in the order in which JPEG scans a block."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


def inverse_dct() -> np.ndarray:
    """64 x 64: row-major coefficients to row-major samples."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    return np.kron(basis, basis)


ZIGZAG = zigzag_order()
IDCT = inverse_dct()


# ---------------------------------------------------------------- writing


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=1)
def jpeg_head() -> bytes:
    lengths = bytes([0] * 7 + [1] + [0] * 8)  # one code, of 8 bits
    head = b"\xff\xd8" + segment(0xDB, b"\0" + b"\1" * 64)
    head += segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\1\x11\0")
    head += segment(0xC4, b"\x00" + lengths + b"\x08") + segment(0xC4, b"\x10" + lengths + b"\x08")
    head += segment(0xDD, struct.pack(">H", 1)) + segment(0xDA, b"\1\1\0\0\x3f\0")
    return head


def write_frames(payload: np.ndarray) -> np.ndarray:
    """Frames x bytes: JPEG frames of payloads of 576 bytes without any 255, all of one size."""
    n, head = len(payload), np.frombuffer(jpeg_head(), np.uint8)
    out = np.zeros((n, len(head) + 9 * 130), np.uint8)
    out[:, : len(head)] = head
    scan = out[:, len(head) :].reshape(n, 9, 130)
    scan[:, :, 1:128:2] = payload.reshape(n, 9, 64)
    scan[:, :, 128] = 0xFF
    scan[:, :, 129] = [*range(0xD0, 0xD8), 0xD9]
    return out


def write_stuffed(payload: bytes) -> bytes:
    """One frame of any 576 bytes."""
    out = [jpeg_head()]
    for k in range(9):
        scan = np.zeros(128, np.uint8)
        scan[1::2] = np.frombuffer(payload, np.uint8, 64, 64 * k)
        out.append(scan.tobytes().replace(b"\xff", b"\xff\0") + (bytes([0xFF, 0xD0 + k]) if k < 8 else b"\xff\xd9"))
    return b"".join(out)


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(body: bytes, sizes: np.ndarray) -> bytes:
    """body: the 00dc chunks; sizes: of the frames in them."""
    n, largest = len(sizes), int(sizes.max())
    avih = struct.pack("<14I", 1_000_000 // FRAMES_A_SECOND, largest * FRAMES_A_SECOND, 0, 0x10, n, 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FRAMES_A_SECOND, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    index = np.empty((n, 4), "<u4")
    index[:, 0], index[:, 1], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, sizes
    index[:, 2] = 4 + np.cumsum(8 + sizes + sizes % 2) - (8 + sizes + sizes % 2)
    return chunk(b"RIFF", b"AVI " + hdrl + chunk(b"LIST", b"movi" + body) + chunk(b"idx1", index.tobytes()))


def store(payloads: list[bytes]) -> list[bytes]:
    """An AVI of each payload, which bytes of 255 fill up to a positive multiple of 576."""
    padded = [p + b"\xff" * (UNIT - len(p) if not p else -len(p) % UNIT) for p in payloads]
    frames = np.frombuffer(b"".join(padded), np.uint8).reshape(-1, UNIT)
    plain = (frames != 255).all(axis=1)
    head = np.frombuffer(b"00dc" + struct.pack("<I", len(jpeg_head()) + 9 * 130), np.uint8)
    made = write_frames(frames)
    chunks = np.concatenate([np.broadcast_to(head, (len(made), 8)), made], axis=1)
    out, at = [], 0
    for payload in padded:
        n = len(payload) // UNIT
        sizes = np.full(n, made.shape[1], np.int64)
        if plain[at : at + n].all():
            body = chunks[at : at + n].tobytes()
        else:
            parts, done = [], at
            for k in np.flatnonzero(~plain[at : at + n]).tolist():
                frame = write_stuffed(payload[k * UNIT : (k + 1) * UNIT])
                sizes[k] = len(frame)
                parts += [chunks[done : at + k].tobytes(), chunk(b"00dc", frame)]
                done = at + k + 1
            body = b"".join([*parts, chunks[done : at + n].tobytes()])
        out.append(write_avi(body, sizes))
        at += n
    return out


# ---------------------------------------------------------------- reading


# The Huffman tables of the JPEG standard, which motion-JPEG frames may leave out. Codes of
# each length from 1 to 16, then symbols; those of long codes follow by rule.
DC_CODES = ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0))
AC_CODES = ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119))
AC_SHORT = (
    "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82",
    "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1",
)

Codes = dict[tuple[int, int], int]


def huffman(counts: Iterable[int], symbols: bytes) -> Codes:
    """(length, code) -> symbol: codes of one length are counted up, and doubled for the next."""
    out, code, at = {}, 0, 0
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            out[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


@lru_cache(maxsize=1)
def usual_tables() -> dict[int, Codes]:
    """The standard's tables by class and number; AC symbols not listed follow in ascending order."""
    out = {k: huffman(counts, bytes(range(12))) for k, counts in enumerate(DC_CODES)}
    for k, counts in enumerate(AC_CODES):
        first = bytes.fromhex(AC_SHORT[k])
        every = [0x00, 0xF0, *(16 * run + size for run in range(16) for size in range(1, 11))]
        out[16 + k] = huffman(counts, first + bytes(sorted(set(every) - set(first))))
    return out


@dataclass
class Part:
    """A component in the order of the scan: blocks across and down in a unit, quantiser steps, codes."""

    across: int
    down: int
    steps: np.ndarray
    dc: Codes
    ac: Codes


@dataclass
class Jpeg:
    """The head of a frame: size, components (luma first), restart interval."""

    width: int
    height: int
    parts: list[Part]
    restart: int
    aligned: bool  # every value takes one 8-bit code for category 8 and 8 bits, in blocks of their own

    @property
    def units(self) -> int:
        """Of the scan: blocks if there is one component, else groups of the blocks of all."""
        if len(self.parts) == 1:
            return -(-self.width // 8) * -(-self.height // 8)
        most = (max(p.across for p in self.parts), max(p.down for p in self.parts))
        return -(-self.width // (8 * most[0])) * -(-self.height // (8 * most[1]))


@lru_cache(maxsize=256)
def parse_head(head: bytes) -> Jpeg:
    at, restart, width, height = 2, 0, 0, 0
    tables, steps, shapes, scanned = dict(usual_tables()), {}, {}, []
    while at + 4 <= len(head):
        marker, size = head[at + 1], struct.unpack(">H", head[at + 2 : at + 4])[0]
        body = head[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                steps[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float64)
                body = body[65 + 64 * wide :]
        elif marker in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8 or not width or not height:
                raise ValueError("only frames of 8 bits and known size are decoded")
            shapes = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            scanned = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
        at += 2 + size
    if len(scanned) != len(shapes) or not shapes:
        raise ValueError("only frames of one scan are decoded")
    parts = [Part(shapes[c][0], shapes[c][1], steps[shapes[c][2]], tables[dc], tables[16 + ac]) for c, dc, ac in scanned]
    own = {(8, 0): 8}
    return Jpeg(width, height, parts, restart, len(parts) == 1 and restart == 1 and parts[0].dc == parts[0].ac == own)


def split_frame(frame: bytes) -> tuple[bytes, bytes]:
    """Head up to the end of the SOS segment, and the scan."""
    at = 2
    while frame[at + 1] != 0xDA:
        at += 2 + struct.unpack(">H", frame[at + 2 : at + 4])[0]
    at += 2 + struct.unpack(">H", frame[at + 2 : at + 4])[0]
    return frame[:at], frame[at:]


_MARK = re.compile(rb"\xff[\xd0-\xd9]")


def decode_bits(jpeg: Jpeg, part: bytes, n: int) -> np.ndarray:
    """The luma blocks of n units in the order of the scan, bit by bit."""
    bits = "".join(f"{b:08b}" for b in part)
    at, before, out = 0, [0] * len(jpeg.parts), []

    def symbol(codes: Codes) -> int:
        nonlocal at
        for length in range(1, 17):
            if (found := codes.get((length, int(bits[at : at + length] or "0", 2)))) is not None:
                at += length
                return found
        raise ValueError("no such Huffman code")

    def value(size: int) -> int:
        nonlocal at
        if not size:
            return 0
        if at + size > len(bits):
            raise ValueError("the scan ends early")
        x = int(bits[at : at + size], 2)
        at += size
        return x if x >> (size - 1) else x - (1 << size) + 1

    for _ in range(n):
        for c, p in enumerate(jpeg.parts):
            for _ in range(p.across * p.down if len(jpeg.parts) > 1 else 1):
                block = np.zeros(64, np.int64)
                before[c] += value(symbol(p.dc))
                block[0] = before[c]
                k = 1
                while k < 64:
                    run, size = divmod(symbol(p.ac), 16)
                    if not size:
                        if run < 15:
                            break
                        k += 16
                        continue
                    k += run
                    if k > 63:
                        raise ValueError("a block is too long")
                    block[k] = value(size)
                    k += 1
                if not c:
                    out.append(block)
    return np.array(out)


def coefficients(jpeg: Jpeg, scan: bytes) -> np.ndarray:
    """All luma blocks of one scan, in its order."""
    n = jpeg.units
    parts = [p.replace(b"\xff\0", b"\xff") for p in _MARK.split(scan.rpartition(b"\xff\xd9")[0] or scan)]
    if jpeg.aligned:
        raw = np.frombuffer(b"".join(p[:128] for p in parts[:n]), np.uint8).reshape(n, 64, 2)[:, :, 1].astype(np.int64)
        return np.where(raw >= 128, raw, raw - 255)
    step = jpeg.restart or n
    if len(parts) < -(-n // step):
        raise ValueError("the scan ends early")
    return np.concatenate([decode_bits(jpeg, p, min(step, n - k * step)) for k, p in enumerate(parts[: -(-n // step)])])


def read_index(media: bytes) -> tuple[float, np.ndarray, np.ndarray]:
    """Frames a second, and the places and sizes of the frames: by the idx1 index, whose offsets count
    from the movi list or from the file's start, or, without one and in further RIFF parts, by walking movi."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    rate, index, frames = float(FRAMES_A_SECOND), np.zeros((0, 4), "<u4"), []
    first = 0

    def walk(at: int, end: int, number: int) -> None:
        nonlocal rate, index, first
        while at + 8 <= end:
            name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            kind, stop = media[at + 8 : at + 12], min(at + 8 + size, end)
            if name == b"RIFF" or name == b"LIST" and kind in (b"movi", b"rec "):
                first = at + 8 if kind == b"movi" and not first else first
                walk(at + 12, stop, number + (name == b"RIFF"))
            elif name == b"LIST" and kind == b"hdrl" and at + 24 <= len(media):
                micros = struct.unpack_from("<I", media, at + 20)[0]
                rate = 1e6 / micros if micros else rate
            elif name == b"idx1":
                index = np.frombuffer(media, "<u4", (stop - at - 8) // 16 * 4, at + 8).reshape(-1, 4)
            elif name[2:] in (b"dc", b"db") and size and stop == at + 8 + size:
                frames.append((number, at + 8, size))
            at += 8 + size + size % 2

    walk(0, len(media), 0)
    video = index[np.isin(index[:, 0] >> 16, [int.from_bytes(x, "little") for x in (b"dc", b"db")]) & (index[:, 3] > 0)].astype(np.int64)
    for base in (first, 0):
        at = base + video[:, 2]
        if len(at) and all(media[a : a + 4] == int(k).to_bytes(4, "little") and a + 8 + n <= len(media) for a, k, n in zip(at.tolist(), video[:, 0].tolist(), video[:, 3].tolist(), strict=True)):
            listed = {a + 8 for a in at.tolist()}
            more = [(a, n) for number, a, n in frames if a not in listed and a > at[-1]]
            return rate, np.array([*(at + 8).tolist(), *(a for a, _ in more)], np.int64), np.array([*video[:, 3].tolist(), *(n for _, n in more)], np.int64)
    return rate, np.array([a for _, a, _ in frames], np.int64), np.array([n for *_, n in frames], np.int64)


def own_frames(media: bytes, at: np.ndarray, size: np.ndarray) -> tuple[Jpeg, np.ndarray] | None:
    """The head and frames x blocks x 64 coefficients of media as `store` writes them; None for any other."""
    try:
        jpeg = parse_head(head := split_frame(media[at[0] : at[0] + size[0]])[0])
    except (ValueError, KeyError, IndexError, struct.error):
        return None
    if not jpeg.aligned:
        return None
    n, data = jpeg.units, np.frombuffer(media, np.uint8)
    out, slow = np.zeros((len(at), n, 64), np.int16), np.ones(len(at), bool)
    usual = np.flatnonzero(size == len(head) + n * 130)
    frames = data[at[usual, None] + np.arange(len(head) + n * 130)]
    scan = frames[:, len(head) :].reshape(len(usual), n, 130)
    raw = scan[:, :, 1:128:2]
    marks = np.array([*(0xD0 + np.arange(n - 1) % 8), 0xD9])
    good = (frames[:, : len(head)] == data[at[0] : at[0] + len(head)]).all(1) & (raw != 255).all((1, 2)) & (scan[:, :, 128] == 255).all(1) & (scan[:, :, 129] == marks).all(1)
    values = raw[good].astype(np.int16)
    out[usual[good]] = values - np.where(values >= 128, 0, 255).astype(np.int16)
    slow[usual[good]] = False
    for k in np.flatnonzero(slow).tolist():
        try:
            own, scan = split_frame(media[at[k] : at[k] + size[k]])
            if own != head:
                return None
            out[k] = coefficients(jpeg, scan)
        except (ValueError, IndexError, struct.error):
            return None
    return jpeg, out


def decode(media: bytes) -> tuple[float, np.ndarray, bytes | None]:
    """Frames a second, frames x BINS luma histograms, and the stored bytes if `store` wrote the media.

    A frame that cannot be decoded has the histogram of the one before it (zeros for the first).
    """
    rate, at, size = read_index(media)
    if not len(at):
        return rate, np.zeros((0, BINS), np.int64), b""
    if own := own_frames(media, at, size):
        return rate, histograms(own[0], own[1]), stored_bytes(own[1])
    hist = np.zeros((len(at), BINS), np.int64)
    for k, (a, n) in enumerate(zip(at.tolist(), size.tolist(), strict=True)):
        try:
            head, scan = split_frame(media[a : a + n])
            jpeg = parse_head(head)
            hist[k] = histograms(jpeg, coefficients(jpeg, scan)[None])[0]
        except (ValueError, KeyError, IndexError, struct.error):
            hist[k] = hist[k - 1] if k else 0
    return rate, hist, None


def stored_bytes(values: np.ndarray) -> bytes:
    """The bytes that coefficients of category 8 stand for."""
    return np.where(values > 0, values, values + 255).astype(np.uint8).tobytes()


def histograms(jpeg: Jpeg, values: np.ndarray) -> np.ndarray:
    """Frames x BINS: how many samples of each frame lie in each range of luma."""
    n, per = values.shape[:2]
    matrix = (IDCT[ZIGZAG] * jpeg.parts[0].steps[:, None]).astype(np.float32)
    luma = np.clip(values.reshape(-1, 64).astype(np.float32) @ matrix + 128.5, 0, 255).astype(np.uint8) >> 4
    place = luma.reshape(n, per * 64).astype(np.int64) + np.arange(n)[:, None] * BINS
    return np.bincount(place.ravel(), minlength=n * BINS).reshape(n, BINS)


def cuts(hist: np.ndarray) -> np.ndarray:
    """The frames with which a new shot begins, the first frame not counted."""
    if len(hist) < 2:
        return np.zeros(0, np.int64)
    share = hist / np.maximum(hist.sum(1, keepdims=True), 1)
    step = np.abs(np.diff(share, axis=0)).sum(1) / 2
    n = len(step)
    first, last = np.maximum(np.arange(n) - WINDOW, 0), np.minimum(np.arange(n) + WINDOW + 1, n)
    one, two = (np.concatenate([[0.0], np.cumsum(x)]) for x in (step, step**2))
    count = last - first - 1
    mean = np.where(count > 0, (one[last] - one[first] - step) / np.maximum(count, 1), 0)
    spread = np.sqrt(np.maximum((two[last] - two[first] - step**2) / np.maximum(count, 1) - mean**2, 0))
    return np.flatnonzero((step >= LEAST) & (step > mean + SIGMAS * spread)) + 1


def described(media: bytes | None) -> tuple[bytes | None, str | None]:
    """The bytes stored in a media value (null if it stores none), and its features: frames, cuts and the luma histogram."""
    if media is None:
        return None, None
    try:
        _, hist, stored = decode(media)
    except (ValueError, struct.error):
        return None, "undecodable"
    if not len(hist):
        return stored, "frames=0"
    total = hist.sum(0)
    return stored, f"frames={len(hist)};cuts={','.join(map(str, cuts(hist).tolist()))};luma={','.join(map(str, (1000 * total // max(total.sum(), 1)).tolist()))}"


# ---------------------------------------------------------------- columns


def with_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media binary: each whole text as an AVI."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames):
            raw = [t.encode("utf-8", "replace") for t in frame.text]
            yield pd.DataFrame({"doc_id": frame.doc_id, "n_bytes": [len(r) for r in raw], "media": store(raw)})

    return map_frames(texts(df, id_col, text_col), run, "doc_id long, n_bytes long, media binary")


def clips(df: DataFrame) -> DataFrame:
    """doc_id, clip, start_frame, end_frame, start_s, end_s: one row for each shot of each media value."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, media in zip(frame.doc_id, frame.media, strict=True):
                try:
                    rate, hist, _ = decode(media)
                except (ValueError, struct.error):
                    continue
                if len(hist):
                    edges = [0, *cuts(hist).tolist(), len(hist)]
                    rows += [(doc_id, k, a, b, a / rate, b / rate) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            yield pd.DataFrame(rows, columns=["doc_id", "clip", "start_frame", "end_frame", "start_s", "end_s"])

    return map_frames(df.select("doc_id", "media").where("media IS NOT NULL"), run, "doc_id long, clip int, start_frame int, end_frame int, start_s double, end_s double")


def media_features(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what is read back from the media column."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for media in frame.media:
                payload, feature = described(media)
                stored = (None, None, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
                rows.append((*stored, *((None, None) if media is None else (len(media), hashlib.sha256(media).hexdigest())), feature))
            out = pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]).astype({c: "Int64" for c in ("payload_bytes", "tail_crc32", "media_bytes")})
            yield pd.concat([frame[["doc_id", "n_bytes"]].reset_index(drop=True), out], axis=1)

    columns = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_frames(df.select("doc_id", "n_bytes", "media"), run, columns)


def op5_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(with_media(table(spark, sf_dir, "documents")))


QUERIES = {"op5_avi": op5_avi}
ORACLES: dict[str, str] = {}
