"""Ingest of audio files into tables of samples, and audits of archives."""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .tables import manifest_columns

#: Names under which archives hold samples and sample rates, in order of preference.
SAMPLE_KEYS = ("audio", "wav", "waveform", "x", "samples")
RATE_KEYS = ("fs", "sr", "samplerate", "sample_rate")
#: Samples of a row: 8 seconds at 125 kHz, so that rows stay small whatever a file's length.
BLOCK = 1_000_000


#: Format tags of integer, float and extensible PCM, whose code is 24 bytes into the format.
INTEGER, FLOAT, EXTENSIBLE, CODE_AT = 1, 3, 0xFFFE, 24
#: Sample types by format code and bits; 24 bits are widened by hand.
KINDS = {(FLOAT, 32): "<f4", (FLOAT, 64): "<f8", (INTEGER, 16): "<i2", (INTEGER, 32): "<i4", (INTEGER, 8): "u1", (INTEGER, 24): "u1"}
#: Bytes of a WAV file that a task reads.
SPLIT = 64 << 20


class Pcm:
    """Where a WAV file's samples are and of what type; `read` returns the first channel of a range of them.

    file: anything with read and seek. Only the heads of the file's chunks are read. Sizes beyond 32
    bits are those of a ds64 chunk (RF64); a data chunk that ends too late, or says 0 or 2**32 - 1 as
    streams do, ends with the file.
    """

    def __init__(self, file, size: int):
        self.file = file
        head = self._at(0, 12)
        if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
            raise ValueError("not a RIFF/WAVE file")
        at, form, self.begin, wide = 12, None, None, None
        while at + 8 <= size and (form is None or self.begin is None):
            kind, length = struct.unpack("<4sI", self._at(at, 8))
            if kind == b"fmt ":
                form = self._at(at + 8, min(length, 40))
            elif kind == b"ds64":
                wide = struct.unpack("<Q", self._at(at + 16, 8))[0]
            elif kind == b"data":
                length = wide if wide is not None and length == 0xFFFFFFFF else length
                self.begin = at + 8
                self.end = size if length in (0, 0xFFFFFFFF) else min(size, at + 8 + length)
            at += 8 + length + length % 2
        if form is None or len(form) < 16 or self.begin is None:
            raise ValueError("no format or no data")
        tag, channels, self.rate, _, _, bits = struct.unpack_from("<HHIIHH", form)
        if tag == EXTENSIBLE:
            if len(form) < CODE_AT + 2:
                raise ValueError("an extensible format without a code")
            (tag,) = struct.unpack_from("<H", form, CODE_AT)
        if (tag, bits) not in KINDS or not channels:
            raise ValueError(f"unknown sample format {tag}, {bits} bits")
        self.bits, self.kind, self.width = bits, np.dtype(KINDS[tag, bits]), bits // 8 * channels
        self.n = (self.end - self.begin) // self.width

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def read(self, first: int, n: int) -> np.ndarray:
        data = self._at(self.begin + first * self.width, max(0, min(n, self.n - first)) * self.width)
        rows = np.frombuffer(data, dtype="u1").reshape(-1, self.width)
        if self.bits == 24:
            b = rows[:, :3].astype(np.int32)
            return (b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8
        return np.ascontiguousarray(rows[:, : self.bits // 8]).view(self.kind)[:, 0]


def decode_wav(content: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples) of a WAV file of integer or float PCM: the first channel."""
    pcm = Pcm(io.BytesIO(content), len(content))
    return pcm.rate, pcm.read(0, pcm.n)


#: What the readers of audio return for each block of a file.
COLUMNS = "path string, rate int, block int, samples array<float>, error string"


def _row(path, rate, block, samples, error=None) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.string())
    values = (path, rate, block, None if samples is None else samples.astype(np.float32), error)
    return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["path", "rate", "block", "samples", "error"])


class ByteRange(InputPartition):
    def __init__(self, path: str, size: int, start: int):
        self.path, self.size, self.start = path, size, start


class PcmReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.block, self.split = options["path"], int(options.get("block", BLOCK)), int(options.get("splitbytes", SPLIT))

    def partitions(self):
        """Ranges of at most `split` bytes of every .wav file; files are listed, not opened."""
        system, top = file_system(self.paths)
        info = system.get_file_info(top)
        if info.type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(self.paths)
        files = [info] if info.is_file else system.get_file_info(pa.fs.FileSelector(top, recursive=True))
        found = sorted((f.path, f.size) for f in files if f.is_file and f.path.lower().endswith(".wav"))
        return [ByteRange(p, n, at) for p, n in found for at in range(0, max(1, n), self.split)]

    def read(self, part: ByteRange):
        """The blocks whose first byte lies in the range. The first range also tells of a damaged file, by an error, and of one without samples."""
        system, _ = file_system(self.paths)
        shown = self.paths.split(":")[0] + ":" + part.path if re.match(r"\w+:", self.paths) else part.path
        try:
            with system.open_input_file(part.path) as f:
                pcm = Pcm(f, part.size)
                step = self.block * pcm.width
                first, last = (max(0, -(-(at - pcm.begin) // step)) for at in (part.start, part.start + self.split))
                for k in range(first, min(last, -(-pcm.n // self.block))):
                    yield _row(shown, pcm.rate, k, pcm.read(k * self.block, self.block))
                if not pcm.n and not part.start:
                    yield _row(shown, pcm.rate, 0, pcm.read(0, 0))
        except (ValueError, OSError, struct.error) as e:
            if not part.start:
                yield _row(shown, None, 0, None, str(e) or type(e).__name__)


class PcmSource(DataSource):
    """spark.read.format("pcm").load(folder): the blocks of WAV files of any size, each read by as many tasks as it has ranges of splitBytes.

    Options: block (samples of a row), splitBytes. Every range reads the few bytes of the file's head,
    seeks to its own first block and reads block by block, so a task holds one block.
    """

    @classmethod
    def name(cls) -> str:
        return "pcm"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> PcmReader:
        return PcmReader(self.options)


def file_system(path: str):
    """(file system, path there) of a folder that Python can open: local ones, HDFS, S3 and other stores that pyarrow knows."""
    return pa.fs.FileSystem.from_uri(path if re.match(r"\w+:", path) else "file://" + os.path.abspath(path))


def decode_npz(content: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples) of an archive by the first known key; the first column of a table."""
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        samples = next((z[k] for k in SAMPLE_KEYS if k in z), None)
        rate = next((int(np.ravel(z[k])[0]) for k in RATE_KEYS if k in z), None)
    if samples is None or rate is None:
        raise ValueError("no samples or no sample rate")
    return rate, samples if samples.ndim == 1 else samples[:, 0]


def _whole(spark: SparkSession, path: str, glob: str, block: int) -> DataFrame:
    """Blocks of files that are read as a whole, of up to 2 GB each."""

    def run(batches):
        for b in batches:
            for p, content in zip(b["path"].to_pylist(), b["content"], strict=True):
                try:
                    rate, x = (decode_npz if p.lower().endswith(".npz") else decode_wav)(content.as_py())
                except (ValueError, KeyError, OSError, zipfile.BadZipFile, struct.error) as e:
                    yield _row(p, None, 0, None, str(e) or type(e).__name__)
                else:
                    for i in range(0, max(1, len(x)), block):
                        yield _row(p, rate, i // block, x[i : i + block])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInArrow(run, COLUMNS)


def audio_chunks(spark: SparkSession, path: str, block: int = BLOCK, split: int = SPLIT) -> DataFrame:
    """(path, name, exp, channel, file_num, scheme, rate, block, first_idx, n_samples, samples, error) of .wav and .npz files under a folder (or of one file).

    A file is a row for each `block` samples, the first of which is its first_idx; one that can't be
    decoded is a row with an error, one without samples a row with none. WAV files of any size are read
    by ranges of `split` bytes, each a task. Archives, and WAV files in stores that only Spark can open
    or given by a pattern, are read as a whole, which Spark does up to 2 GB.
    """
    try:
        if re.search(r"[*?{\[]", path):
            raise pa.ArrowInvalid("a pattern")
        file_system(path)
    except (pa.ArrowInvalid, OSError):
        rows = _whole(spark, path, "*.{wav,npz}", block)
    else:
        spark.dataSource.register(PcmSource)
        rows = spark.read.format("pcm").option("block", block).option("splitBytes", split).load(path)
        rows = rows.unionByName(_whole(spark, path, "*.npz", block))
    return rows.select("path", *manifest_columns(F.col("path")), "rate", "block", (F.col("block").cast("long") * block).alias("first_idx"), F.size("samples").cast("long").alias("n_samples"), "samples", "error")


def write_wav(chunks: DataFrame, folder: str) -> int:
    """Writes (exp, channel, file_num, rate, block, samples) as 32-bit float WAV files, one a file_num; returns how many.

    A file is <exp>/channel_<channel>_file_<file_num>.wav under folder and holds its blocks one after the
    other. Samples move once, to the task that writes their file, which holds one block at a time. It
    writes under another name and moves the file at its end, so a lost task leaves no half file and its
    repetition writes the same. Rows of null rate or samples are left out; several rates in a file, and
    4 GiB or more, are errors.
    """
    keys = ["exp", "channel", "file_num"]
    whole = chunks.filter("rate is not null and samples is not null")
    sizes = whole.groupBy(*keys).agg(F.sum(F.size("samples").cast("long")).alias("n"), F.min("rate").alias("low"), F.max("rate").alias("high"))
    rows = whole.select(*keys, "block", F.col("samples").cast("array<float>").alias("samples")).repartition(*keys)
    name = F.format_string("%s/channel_%02d_file_%03d.wav", F.col("exp").cast("string"), F.col("channel").cast("long"), F.col("file_num").cast("long"))
    known = rows.join(sizes, keys).select(name.alias("name"), "n", "low", "high", "block", "samples")

    def run(batches):
        system, top = file_system(folder)
        done, name, out, temporary = 0, None, None, None

        def finish():
            out.close()
            system.move(temporary, f"{top}/{name}")

        for b in batches:
            for i, own in enumerate(b["name"].to_pylist()):
                if own != name:
                    if out:
                        finish()
                    n, low, high = (b[c][i].as_py() for c in ("n", "low", "high"))
                    if low != high or 4 * n + 36 >= 1 << 32:
                        raise ValueError(f"{own}: several rates, or too long for a WAV file")
                    name, temporary, done = own, f"{top}/{own}.{uuid.uuid4().hex}", done + 1
                    system.create_dir(os.path.dirname(temporary), recursive=True)
                    out = system.open_output_stream(temporary)
                    out.write(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 4 * n + 36, b"WAVE", b"fmt ", 16, FLOAT, 1, low, 4 * low, 4, 32, b"data", 4 * n))
                out.write(np.asarray(b["samples"][i].values, dtype="<f4").tobytes())
        if out:
            finish()
        yield pa.record_batch([pa.array([done], pa.int64())], names=["files"])

    return known.sortWithinPartitions("name", "block").mapInArrow(run, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def archive_audit(spark: SparkSession, path: str, required: str = "samplerate") -> DataFrame:
    """(path, ok, reason, keys, has_key) of every .npz under path; all members are read to find damage."""

    def run(batches):
        for b in batches:
            out = []
            for p, content in zip(b["path"].to_pylist(), b["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                        if bad := z.testzip():
                            raise ValueError(f"damaged member {bad}")
                        keys = sorted(n.removesuffix(".npy") for n in z.namelist())
                    out.append((p, True, None, keys, required in keys))
                except (ValueError, OSError, zipfile.BadZipFile) as e:
                    out.append((p, False, str(e) or type(e).__name__, None, False))
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.bool_()))], names=["path", "ok", "reason", "keys", "has_key"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, ok boolean, reason string, keys array<string>, has_key boolean")
