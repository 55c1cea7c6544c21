"""Pixels: decoding of plain PNG and BMP files, orientation, exact and perceptual hashes, EXIF fields.

No imaging library is needed. Other formats are decoded by one if it is
installed and are reported as unreadable otherwise.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa


def decode_png(data: bytes) -> np.ndarray:
    """Upright RGB pixels of an 8-bit, not interlaced PNG."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG signature")
    at, body, palette, head, orientation = 8, [], None, None, 1
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if len(part) < size:
            raise ValueError("truncated PNG")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"eXIf":
            orientation = exif_fields(part).get("orientation", 1)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 3, 4, 6):
        raise ValueError("unsupported PNG")
    width, height, _, colour = head[:4]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    stride = width * channels
    if len(raw) < height * (stride + 1):
        raise ValueError("truncated PNG")
    raw = raw[: height * (stride + 1)].reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.int64)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 1:
            line = np.cumsum(line.reshape(width, channels), axis=0).ravel() % 256
        elif kind == 2:
            line = (line + above) % 256
        elif kind in (3, 4):
            for x in range(stride):
                a = line[x - channels] if x >= channels else 0
                b, c = above[x], above[x - channels] if x >= channels else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = (line[x] + guess) % 256
        elif kind:
            raise ValueError("bad PNG filter")
        out[y] = above = line
    pixels = out.reshape(height, width, channels)
    if colour == 3:
        if palette is None:
            raise ValueError("PNG without palette")
        return upright(palette[pixels[:, :, 0]], orientation)
    return upright(np.repeat(pixels[:, :, :1], 3, 2) if channels < 3 else pixels[:, :, :3].copy(), orientation)


def encode_png(rgb: np.ndarray) -> bytes:
    """A PNG file of RGB pixels, for fixtures."""
    height, width, _ = rgb.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), rgb.astype(np.uint8).reshape(height, -1)], 1)

    def chunk(kind: bytes, part: bytes) -> bytes:
        return struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """Upright RGB pixels of a picture file, by an imaging library if one is installed."""
    try:
        from PIL import Image, ImageOps
    except ImportError as e:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return decode_png(data)
        raise ValueError("no decoder for this format") from e
    with Image.open(io.BytesIO(data)) as picture:
        return np.asarray(ImageOps.exif_transpose(picture).convert("RGB"))


def upright(rgb: np.ndarray, orientation: int) -> np.ndarray:
    """Apply an EXIF orientation (1 to 8)."""
    if orientation in (5, 6, 7, 8):
        rgb = rgb.transpose(1, 0, 2)
    if orientation in (2, 3, 6, 7):
        rgb = rgb[:, ::-1]
    if orientation in (3, 4, 7, 8):
        rgb = rgb[::-1]
    return np.ascontiguousarray(rgb)


def pixel_hash(rgb: np.ndarray) -> str:
    """SHA-256 of "(width, height)" and the RGB bytes row by row."""
    height, width, _ = rgb.shape
    return hashlib.sha256(f"({width}, {height})".encode() + np.ascontiguousarray(rgb, np.uint8).tobytes()).hexdigest()


def _resample(size: int, to: int) -> np.ndarray:
    """Lanczos weights (three lobes) that bring ``size`` samples to ``to``."""
    scale = max(size / to, 1.0)
    centre = (np.arange(to) + 0.5) * size / to
    x = (np.arange(size)[None, :] + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(1, keepdims=True)


def small_grey(rgb: np.ndarray, side: int = 32) -> np.ndarray:
    """Grey picture of side x side, values 0 to 255."""
    c = rgb.astype(np.int64)
    grey = (c[:, :, 0] * 19595 + c[:, :, 1] * 38470 + c[:, :, 2] * 7471 + 0x8000) >> 16
    across = np.clip(np.rint(grey @ _resample(grey.shape[1], side).T), 0, 255)
    return np.clip(np.rint(_resample(grey.shape[0], side) @ across), 0, 255)


_K = np.arange(32)
_DCT = np.cos(np.pi / 32 * (_K[None, :] + 0.5) * _K[:8, None])


def perceptual_hash(grey: np.ndarray) -> int:
    """64 bits, row by row: which of the lowest 8 x 8 cosine coefficients exceed their median. Signed."""
    low = _DCT @ grey @ _DCT.T
    bits = (low > np.median(low)).ravel()
    return int(np.packbits(bits).view(">i8")[0])


def orientation_hashes(rgb: np.ndarray) -> list[int]:
    """Hashes of the picture as it is, turned by 90, 180 and 270 degrees, mirrored sideways and
    upside down, and mirrored at both diagonals. The first is canonical."""
    g = small_grey(rgb)
    forms = [g, np.rot90(g), np.rot90(g, 2), np.rot90(g, 3), g[:, ::-1], g[::-1], g.T, np.rot90(g, 2).T]
    return [perceptual_hash(f) for f in forms]


def fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of ``image_path`` and ``content`` to their fingerprints or errors."""
    schema = pa.schema([("image_path", pa.string()), ("sha256_pixels", pa.string()), ("hashes", pa.list_(pa.int64())), ("width", pa.int32()), ("height", pa.int32()), ("error", pa.string())])
    for batch in batches:
        rows = []
        for path, data in zip(batch.column("image_path").to_pylist(), batch.column("content").to_pylist()):
            try:
                rgb = decode(data or b"")
                rows.append({"image_path": path, "sha256_pixels": pixel_hash(rgb), "hashes": orientation_hashes(rgb), "width": rgb.shape[1], "height": rgb.shape[0]})
            except Exception as e:  # any broken file is reported, none stops the others
                rows.append({"image_path": path, "error": str(e) or type(e).__name__})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


#: EXIF tags of the fields that are read.
EXIF_TAGS = {271: "make", 272: "model", 305: "software", 274: "orientation", 36867: "capture_time", 40962: "width", 40963: "height"}
EXIF_BLOCK = 34665


def exif_fields(body: bytes) -> dict[str, object]:
    """Fields of an EXIF block."""
    out: dict[str, object] = {}
    order = {b"II": "<", b"MM": ">"}[body[:2]]

    def directory(start: int) -> None:
        (count,) = struct.unpack(order + "H", body[start : start + 2])
        for k in range(count):
            tag, kind, n, raw = struct.unpack(order + "HHI4s", body[start + 2 + 12 * k : start + 14 + 12 * k])
            if tag == EXIF_BLOCK:
                directory(struct.unpack(order + "I", raw)[0])
            elif tag in EXIF_TAGS and kind == 2:
                where = struct.unpack(order + "I", raw)[0]
                text = raw[:n] if n <= 4 else body[where : where + n]
                out[EXIF_TAGS[tag]] = text.split(b"\0")[0].decode("utf-8", "replace")
            elif tag in EXIF_TAGS and kind in (3, 4):
                out[EXIF_TAGS[tag]] = struct.unpack(order + ("H" if kind == 3 else "I"), raw[: 2 if kind == 3 else 4])[0]

    directory(struct.unpack(order + "I", body[4:8])[0])
    return out


def read_exif(data: bytes) -> dict[str, object]:
    """EXIF fields of a JPEG file; empty if there are none, with an ``error`` if they are broken."""
    out: dict[str, object] = {}
    try:
        at = 2
        while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
            marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            part = data[at + 4 : at + 2 + size]
            if marker == 0xE1 and part[:6] == b"Exif\0\0":
                out.update(exif_fields(part[6:]))
            if marker in (0xC0, 0xC1, 0xC2):
                out["height"], out["width"] = struct.unpack(">HH", part[1:5])
                break
            if marker == 0xDA:
                break
            at += 2 + size
    except (struct.error, KeyError, IndexError, RecursionError) as e:
        out["error"] = f"broken metadata: {type(e).__name__}"
    return out


EXIF_SCHEMA = "make string, model string, capture_time string, software string, width int, height int, orientation int, error string"


def exif_frame(content: pd.Series) -> pd.DataFrame:
    """EXIF fields of a batch of files, for a vectorised UDF of type EXIF_SCHEMA."""
    rows = [read_exif(c or b"") for c in content]
    names = ("make", "model", "capture_time", "software", "width", "height", "orientation", "error")
    frame = pd.DataFrame([[r.get(k) for k in names] for r in rows], columns=list(names))
    return frame.astype({k: "Int32" for k in names[4:7]})
