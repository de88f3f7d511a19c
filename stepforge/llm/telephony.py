"""Telephony audio columns: G.711 and IMA ADPCM bytes in WAV files, expanded, resampled and stored.

The 8-bit samples of a recording are stored unchanged in a WAV file. Mu-law and A-law samples
expand by tables of 256 entries built from the companding rule; IMA ADPCM is decoded one nibble
position at a time for all blocks of many recordings together, so the loop is as long as a
block, whatever the data. PCM is resampled from 8 to 16 kHz by linear interpolation in whole
numbers and stored as 16-bit WAV. A task holds about ``CHUNK_BYTES`` of recordings at a time, or one
longer recording.

Defined results: a null payload or text counts as empty; a text's payload is its UTF-8 bytes,
followed by zero bytes up to a positive multiple of 64, so an empty text stores 64 zero bytes;
equal payloads give equal values; rows are kept one for one, whatever their id. Expanding, a null
file stays null; bytes after the last whole sample or ADPCM block are left out; what is no WAV file,
ends early, has another format or more than one channel gives null and says so in ``problem``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

RATE = 8000
BLOCK = 64
FORMATS = {"pcm16": 1, "alaw": 6, "ulaw": 7, "ima_adpcm": 17}
# Fixed values of the IMA ADPCM format: step sizes, and index changes by the nibble's lower three bits.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307,
    337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358,
    5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def ulaw_table() -> np.ndarray:
    """PCM value of each mu-law byte."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM value of each A-law byte."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    part, mantissa = code >> 4 & 7, (code & 15) << 4
    size = np.where(part == 0, mantissa + 8, mantissa + 264 << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {"ulaw": ulaw_table(), "alaw": alaw_table()}


def _shape(codec: str) -> tuple[int, int]:
    """Bytes of a sample or block, and bits of a sample."""
    return (2, 16) if codec == "pcm16" else (BLOCK, 4) if codec == "ima_adpcm" else (1, 8)


def wav(samples: bytes, codec: str, rate: int = RATE) -> bytes:
    """A mono WAV file that holds ``samples`` unchanged."""
    align, width = _shape(codec)
    count = len(samples) // BLOCK * (2 * BLOCK - 7) if codec == "ima_adpcm" else len(samples) // align
    per_second = rate * BLOCK // (2 * BLOCK - 7) if codec == "ima_adpcm" else rate * align
    extra = struct.pack("<HH", 2, 2 * BLOCK - 7) if codec == "ima_adpcm" else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", FORMATS[codec], 1, rate, per_second, align, width) + extra
    parts = b"".join(name + struct.pack("<I", len(body)) + body for name, body in ((b"fmt ", form), (b"fact", struct.pack("<I", count))))
    body = b"WAVE" + parts + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwav(media: bytes) -> tuple[str, int, bytes]:
    """(codec, rate, samples) of a mono WAV file, found chunk by chunk; raises ValueError where it is none."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, rate = 12, None, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            if size < 16 or at + 24 > len(media):
                raise ValueError("the file ends early")
            number, channels, rate, _, align, width = struct.unpack_from("<HHIIHH", media, at + 8)
            codec = {v: k for k, v in FORMATS.items()}.get(number)
            if channels != 1:
                raise ValueError("more than one channel")
            if codec is not None and (align, width) != _shape(codec):
                raise ValueError("samples of another size")
        elif name == b"data":
            if codec is None:
                raise ValueError("unknown format")
            if at + 8 + size > len(media):
                raise ValueError("the file ends early")
            return codec, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no samples in the file")


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """PCM (blocks, 2 * size - 7) of IMA ADPCM blocks (blocks, size), every block at each step."""
    n, size = blocks.shape
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[0] = value
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    # what a nibble adds and where the index goes, by (index, nibble): one look-up a step each
    nibble = np.arange(16)
    step = STEPS[:, None]
    change = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    change = np.where(nibble & 8, -change, change).astype(np.int32).ravel()
    onward = (np.clip(np.arange(89)[:, None] + INDEX_CHANGE[nibble & 7], 0, 88) * 16).astype(np.int32).ravel()
    index *= 16
    for j in range(size - 4):
        for k, code in enumerate((columns[j] & 15, columns[j] >> 4)):
            at = index + code
            value = np.clip(value + change[at], -32768, 32767)
            index = onward[at]
            out[1 + 2 * j + k] = value
    return out.T


def resample_double(pcm: np.ndarray, first: np.ndarray) -> np.ndarray:
    """PCM at twice the rate; ``first``: where each recording begins (the last sample is held)."""
    after = np.empty_like(pcm)
    after[:-1] = pcm[1:]
    last = np.append(first[1:], len(pcm)) - 1
    after[last] = pcm[last]
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    out[1::2] = (pcm.astype(np.int32) + after) >> 1
    return out


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values.astype(np.int64), first)


def _chunks(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of a batch's rows that hold about ``CHUNK_BYTES`` each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + C.CHUNK_BYTES, "right")))
        yield at, to
        at = to


def _store(codec: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in _chunks(batch.column("payload")):
                files = [wav(p or b"", codec) for p in batch.column("payload").slice(at, to - at).to_pylist()]
                yield pa.record_batch([batch.column("id").slice(at, to - at), pa.array(files, pa.binary())], ["id", "media"])

    return run


def store_samples(df: DataFrame, id_col: str = "id", payload_col: str = "payload", codec: str = "ulaw") -> DataFrame:
    """id and media: each binary payload as the samples of a WAV file (ADPCM payloads: whole blocks)."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(payload_col).cast("binary").alias("payload"))
    return rows.mapInArrow(_store(codec), "id long, media binary")


def expanded(files: list[bytes | None]) -> list[tuple[bytes | None, str | None]]:
    """(PCM as a WAV file of twice the rate, problem) of each file; the samples of all files of a codec are decoded together."""
    out: list[tuple[bytes | None, str | None]] = [(None, None)] * len(files)
    held: dict[str, list[tuple[int, int, bytes]]] = {}
    for i, media in enumerate(files):
        if media is None:
            continue
        try:
            codec, rate, samples = unwav(media)
        except ValueError as problem:
            out[i] = (None, str(problem))
            continue
        align = _shape(codec)[0]
        held.setdefault(codec, []).append((i, rate, samples[: len(samples) // align * align]))
    for codec, some in held.items():
        raw, align = np.frombuffer(b"".join(x for _, _, x in some), np.uint8), _shape(codec)[0]
        units = np.array([len(x) // align for _, _, x in some])
        pcm = adpcm_decode(raw.reshape(-1, BLOCK)).ravel() if codec == "ima_adpcm" else raw.view("<i2") if codec == "pcm16" else TABLES[codec][raw]
        sizes = units * (2 * BLOCK - 7 if codec == "ima_adpcm" else 1)
        first = np.cumsum(sizes) - sizes
        doubled = resample_double(pcm, first[sizes > 0]).astype("<i2") if len(pcm) else pcm
        for (i, rate, _), a, n in zip(some, first.tolist(), sizes.tolist()):
            out[i] = (wav(doubled[2 * a : 2 * (a + n)].tobytes(), "pcm16", 2 * rate), None)
    return out


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to in _chunks(batch.column("media")):
            done = expanded(batch.column("media").slice(at, to - at).to_pylist())
            yield pa.record_batch([batch.column("id").slice(at, to - at), pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], ["id", "pcm", "problem"])


def expand_recordings(df: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """id, pcm and problem: each WAV file expanded, resampled to twice its rate and stored as 16-bit WAV."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("media"))
    return rows.mapInArrow(_expand, "id long, pcm binary, problem string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Store every text, read the file back and derive its values, for about a million bytes at a time."""
    for batch in batches:
        offsets, data = C.text_buffers(batch.column("text"))
        at, n = 0, len(offsets) - 1
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + C.CHUNK_BYTES, "right")) - 1)
            lengths = np.diff(offsets[at : to + 1])
            files = []
            for a, b in zip(offsets[at:to].tolist(), offsets[at + 1 : to + 1].tolist()):
                raw = data[a:b].tobytes()
                files.append(wav(raw + b"\0" * (BLOCK - len(raw) % BLOCK if len(raw) % BLOCK or not raw else 0), "ulaw"))
            back = [unwav(f)[2] for f in files]
            sizes = np.fromiter(map(len, back), np.int64, len(back))
            first = np.cumsum(sizes) - sizes
            raw = np.frombuffer(b"".join(back), np.uint8)
            law, alaw = TABLES["ulaw"][raw], TABLES["alaw"][raw]
            wide = adpcm_decode(raw.reshape(-1, BLOCK))
            turns = np.zeros(len(raw), bool)
            turns[1:] = (law[1:] < 0) != (law[:-1] < 0)
            turns[first] = False
            doubled = resample_double(law, first).astype("<i2")
            stored = [wav(doubled[2 * a : 2 * (a + n)].tobytes(), "pcm16", 2 * RATE) for a, n in zip(first.tolist(), sizes.tolist())]
            pcm = [unwav(f)[2] for f in stored]
            energy = _sums(law.astype(np.int64) ** 2, first) // sizes
            energy_a = _sums(alaw.astype(np.int64) ** 2, first) // sizes
            energy_d = _sums((wide.astype(np.int64) ** 2).sum(axis=1), first // BLOCK) // (sizes // BLOCK * wide.shape[1])
            peak = np.maximum.reduceat(np.abs(law.astype(np.int32)), first)
            crossed = _sums(turns, first)
            feature = [
                f"ms={sizes[i] * 1000 // RATE};ulaw={energy[i]};alaw={energy_a[i]};adpcm={energy_d[i]};peak={peak[i]};zc={crossed[i]};pcm16k={zlib.crc32(pcm[i]):08x}"
                for i in range(len(back))
            ]
            yield pa.record_batch(
                [
                    batch.column("doc_id").slice(at, to - at), pa.array(lengths.astype(np.int64)), pa.array(sizes), pa.array([hashlib.sha256(p).hexdigest() for p in back]),
                    pa.array([zlib.crc32(p[-BLOCK:]) for p in back], pa.int64()), pa.array([len(f) for f in files], pa.int64()), pa.array([hashlib.sha256(f).hexdigest() for f in files]), pa.array(feature),
                    pa.array([len(f) for f in stored], pa.int64()), pa.array([hashlib.sha256(f).hexdigest() for f in stored]),
                ],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes", "pcm_sha256"],
            )
            at = to


def text_recordings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of each text stored as mu-law samples and read back, and of its PCM, stored and read back in turn.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (duration,
    mean energy under each codec, peak, zero crossings and the CRC of the 16 kHz PCM), pcm_bytes and pcm_sha256 (the PCM's file).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shape = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"
    return rows.mapInArrow(_digest, shape)


def op1_telephony_audio(spark, sf_dir):
    return text_recordings(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_telephony_audio": op1_telephony_audio}
ORACLE: dict[str, str] = {}
