"""Kernels over raw media bytes and samples for Arrow batches (numpy)."""

from __future__ import annotations

import struct
from datetime import datetime

import numpy as np

#: Fixed values of the audio fingerprint.
RATE, FRAME, HOP, LOW, HIGH = 11025, 4096, 1365, 27.5, 3520.0
TAPS = np.array([0.25, 0.5, 1.0, 0.5, 0.25]) / 2.5


#: Frames hashed at once: their sums stay in a processor's cache.
AT_ONCE = 128


def dct_phash(frame: np.ndarray) -> int:
    """64-bit hash of a 32 x 32 frame: the 8 x 8 lowest frequencies but the constant ones of a
    DCT, bit k set where the k-th is above their median. All in float32; as a signed long."""
    return int(dct_phashes(np.asarray(frame).reshape(1, 1024))[0])


def cosines() -> np.ndarray:
    """float32 table of the DCT: row k - 1 for frequency k of 1..8, 32 places each."""
    k = np.arange(1, 9, dtype=np.float64)[:, None]
    return np.cos((2 * np.arange(32)[None, :] + 1) * k * np.pi / 64).astype(np.float32)


def dct_phashes(frames: np.ndarray) -> np.ndarray:
    """dct_phash of each row of a (n, 1024) array. Sums are added up place after place in float32,
    first along rows, then along columns: other orders round otherwise and change bits."""
    if len(frames) > AT_ONCE:
        return np.concatenate([dct_phashes(frames[low : low + AT_ONCE]) for low in range(0, len(frames), AT_ONCE)])
    table, alpha = cosines(), np.float32(np.sqrt(2 / 32))
    pixels = frames.astype(np.float32).reshape(-1, 32, 32)
    rows = np.zeros((len(pixels), 32, 8), np.float32)
    for x in range(32):
        rows += pixels[:, :, x, None] * table[None, None, :, x]
    rows *= alpha
    cells = np.zeros((len(pixels), 8, 8), np.float32)  # vertical frequency, horizontal frequency
    for y in range(32):
        cells += rows[:, y, None, :] * table[None, :, y, None]
    cells = (cells * alpha).reshape(-1, 64)
    ordered = np.sort(cells, axis=1)
    median = (ordered[:, 31] + ordered[:, 32]) * np.float32(0.5)
    bits = (cells > median[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)
    return np.bitwise_or.reduce(bits, axis=1).view(np.int64)


def with_phash(rows, column: str = "frame", name: str = "phash"):
    """rows with the hash of a 32 x 32 frame (binary); null for frames of another size."""
    at = rows.columns.index(column)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            frames = batch.column(at).to_pylist()
            fit = [i for i, f in enumerate(frames) if f is not None and len(f) == 1024]
            values = np.zeros(len(frames), np.int64)
            if fit:
                values[fit] = dct_phashes(np.frombuffer(b"".join(frames[i] for i in fit), np.uint8).reshape(-1, 1024))
            missing = np.ones(len(frames), bool)
            missing[fit] = False
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, mask=missing)], [*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, `{name}` bigint")


def pitch_classes() -> np.ndarray:
    bins = np.arange(FRAME // 2 + 1)
    hz = bins * RATE / FRAME
    out = np.full(len(bins), -1)
    ok = (hz >= LOW) & (hz <= HIGH) & (bins > 0) & (bins < FRAME // 2)
    out[ok] = np.floor(12 * np.log2(hz[ok] / LOW)).astype(int) % 12
    return out


def chroma(samples: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Energy by pitch class of one windowed frame of samples in -1..1."""
    window = 0.5 * (1 - np.cos(2 * np.pi * np.arange(FRAME) / (FRAME - 1)))
    energy = np.abs(np.fft.rfft(samples * window)) ** 2
    ok = classes >= 0
    return np.bincount(classes[ok], energy[ok], minlength=12)


def normalised(x: np.ndarray) -> np.ndarray:
    square = float((x * x).sum())
    return np.zeros_like(x) if square < 1e-10 else x / np.sqrt(square)


def code(x: np.ndarray) -> int:
    from ..functions.kernels import CHROMA_PAIRS

    return sum(1 << i for i, (a, b) in enumerate(CHROMA_PAIRS) if x[a] > x[b])


def majority(codes: list[int]) -> int:
    need = len(codes) // 2 + 1
    return sum(1 << bit for bit in range(32) if sum(c >> bit & 1 for c in codes) >= need) if codes else 0


class Fingerprint:
    """Samples in chunks of any size -> one 32-bit value a second.

    State between chunks: samples not yet framed, the last chroma frames, the codes of the open
    second. A second closes when a frame of a later one comes; the first four frames only fill
    the filter.
    """

    def __init__(self):
        self.rest, self.frames, self.index, self.codes, self.out = np.zeros(0), [], 0, [], []
        self.classes = pitch_classes()

    def feed(self, samples: np.ndarray) -> None:
        self.rest = np.concatenate([self.rest, np.asarray(samples, np.float64) / 32768.0])
        while len(self.rest) >= FRAME:
            self._frame(self.rest[:FRAME])
            self.rest = self.rest[HOP:]

    def _frame(self, samples: np.ndarray) -> None:
        second = int(self.index * HOP / RATE)
        self.index += 1
        self.frames = (self.frames + [chroma(samples, self.classes)])[-5:]
        if second > len(self.out) and self.codes:
            self.out.append(majority(self.codes))
            self.codes = []
        if len(self.frames) == 5:
            self.codes.append(code(normalised(TAPS @ np.array(self.frames))))

    def finish(self) -> list[int] | None:
        if self.codes:
            self.out.append(majority(self.codes))
            self.codes = []
        return self.out or None


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from a JPEG's first frame header."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data) and data[at] == 0xFF:
        marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 + length
    return None


def exif_block(data: bytes) -> bytes:
    """The TIFF part of a JPEG, PNG or WebP that has one; else the data themselves."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size = int.from_bytes(data[at : at + 4], "big")
            if data[at + 4 : at + 8] == b"eXIf":
                return data[at + 8 : at + 8 + size]
            at += 12 + size
        return b""
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        at = 12
        while at + 8 <= len(data):
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            if data[at : at + 4] == b"EXIF":
                block = data[at + 8 : at + 8 + size]
                return block[6:] if block[:6] == b"Exif\0\0" else block
            at += 8 + size + size % 2
        return b""
    at = data.find(b"Exif\0\0")
    return data[at + 6 :] if at >= 0 else data


def header_facts(rows, column: str = "content"):
    """rows with width, height and taken (date) read from the headers of image files."""
    from pyspark.sql import functions as F

    from .tables import image_size

    at = rows.columns.index(column)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data = [d or b"" for d in batch.column(at).to_pylist()]
            sizes, dates = [jpeg_size(d) or (None, None) for d in data], [exif_date(d) for d in data]
            extra = [pa.array([s[0] for s in sizes], pa.int32()), pa.array([s[1] for s in sizes], pa.int32()), pa.array([d and d.isoformat(" ") for d in dates], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "jpeg_w", "jpeg_h", "taken_text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = rows.mapInArrow(run, f"{schema}, jpeg_w int, jpeg_h int, taken_text string")
    size = image_size(F.col(column))
    return out.select(
        *rows.columns, F.coalesce(size["width"], "jpeg_w").alias("width"), F.coalesce(size["height"], "jpeg_h").alias("height"), F.try_to_timestamp("taken_text").alias("taken")
    )


def exif_date(data: bytes) -> datetime | None:
    """Date taken of a JPEG or TIFF: the original date before the change date."""
    tiff = exif_block(data)
    if tiff[:2] not in (b"II", b"MM"):
        return None
    e = "<" if tiff[:2] == b"II" else ">"

    def entries(offset):
        if offset + 2 > len(tiff):
            return {}
        n = struct.unpack_from(e + "H", tiff, offset)[0]
        cells = [struct.unpack_from(e + "HHII", tiff, offset + 2 + 12 * i) for i in range(n) if offset + 14 + 12 * i <= len(tiff)]
        return {tag: (count, value) for tag, _, count, value in cells}

    def date(cell):
        text = tiff[cell[1] : cell[1] + cell[0]].strip(b"\0 ").decode("ascii", "replace")
        try:
            return datetime.strptime(text, "%Y:%m:%d %H:%M:%S")
        except ValueError:
            return None

    if len(tiff) < 8:
        return None
    first = entries(struct.unpack_from(e + "I", tiff, 4)[0])
    inner = entries(first[0x8769][1]) if 0x8769 in first else {}
    return (date(inner[0x9003]) if 0x9003 in inner else None) or (date(first[0x0132]) if 0x0132 in first else None)
