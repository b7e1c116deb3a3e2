"""Media columns: lossless 8-bit audio, and features of it as fixed-shape tensors with time spans."""

from __future__ import annotations

import functools
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, table

#: Payloads are padded with this byte to a positive multiple of this size.
PAD, UNIT = 255, 576
#: Frames of one tensor, and mel bands of a frame.
FRAMES, BANDS = 64, 24
#: Frames that are worked on at once.
BLOCK = 4096
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")

FEATURES = "n_frames int, mel_mean array<float>, segments array<struct<start_s: double, end_s: double>>, tensors array<struct<start_s: double, end_s: double, values: binary>>"


def padded(text: Column) -> Column:
    """The text's UTF-8 bytes, padded with byte 255 up to a positive multiple of 576; null counts as empty."""
    data = F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))
    n = F.octet_length(data)
    fill = F.when(n == 0, F.lit(UNIT)).otherwise((F.lit(UNIT) - n % UNIT) % UNIT)
    return F.concat(data, F.expr(f"unhex(repeat('{PAD:02x}', {UNIT}))").substr(F.lit(1), fill.cast("int")))


def wav_header(n: int, rate: int) -> bytes:
    return HEADER.pack(b"RIFF", 36 + n & 0xFFFFFFFF, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n & 0xFFFFFFFF)


def wav_samples(media: bytes) -> tuple[np.ndarray, int]:
    """Samples and rate of an 8-bit mono WAV; chunks other than fmt and data are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV stream")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif name == b"data":
            return np.frombuffer(media, np.uint8, min(n, len(media) - at - 8), at + 8), rate
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


@functools.lru_cache(16)
def _taps(up: int, down: int, half: int = 8) -> np.ndarray:
    """Low-pass windowed sinc for resampling by up/down, one row per phase, taps in time order."""
    wide = max(up, down)
    t = np.arange(-half * wide, half * wide + 1)
    h = np.sinc(t / wide) * np.kaiser(len(t), 5.0) * up / wide
    h = np.pad(h, (0, -len(h) % up))
    return h.reshape(-1, up).T[:, ::-1].copy()


def resampled_length(n: int, up: int, down: int) -> int:
    return -(-n * up // down)


def resample(x: np.ndarray, up: int, down: int, first: int = 0, end: int | None = None) -> np.ndarray:
    """Polyphase resampling: each output sample takes the one phase of the filter that meets input samples.

    Gives output samples from `first` up to `end`, and looks only at the input that these meet; input
    before the start and after the end counts as 0.
    """
    end = resampled_length(len(x), up, down) if end is None else end
    if end <= first:
        return np.zeros(0)
    if up == down:
        return np.asarray(x[first:end], np.float64)
    h = _taps(up, down)
    width, lead = h.shape[1], 8 * max(up, down)
    at = np.arange(first, end) * down + lead
    phase, newest = at % up, at // up
    low, high = int(newest[0]) - width + 1, int(newest[-1]) + 1
    part = np.zeros(high - low)
    inside = x[max(low, 0) : min(high, len(x))]
    part[max(-low, 0) : max(-low, 0) + len(inside)] = inside
    windows = np.lib.stride_tricks.sliding_window_view(part, width)
    out = np.empty(end - first)
    for p in range(up):
        rows = np.flatnonzero(phase == p)
        if len(rows):
            step = newest[rows] - newest[0]
            out[rows] = windows[step[0] : step[-1] + 1 : max(1, int(step[1] - step[0]) if len(step) > 1 else 1)][: len(rows)] @ h[p]
    return out


@functools.lru_cache(8)
def _mel_bank(rate: int, size: int, bands: int) -> np.ndarray:
    """Triangles spaced evenly on the mel scale, as a (bins, bands) matrix."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.arange(size // 2 + 1)[:, None] * rate / size
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


def log_mel(x: np.ndarray, rate: int, size: int = 256, hop: int = 128, bands: int = BANDS) -> np.ndarray:
    """(frames, bands) of log10 mel power over overlapped Hann windows; the last frame is padded with zeros."""
    frames = max(1, -(-max(0, len(x) - size) // hop) + 1)
    x = np.pad(x, (0, (frames - 1) * hop + size - len(x)))
    windows = np.lib.stride_tricks.sliding_window_view(x, size)[::hop] * np.hanning(size + 1)[:-1]
    power = np.abs(np.fft.rfft(windows, axis=1)) ** 2
    return np.log10(np.maximum(power @ _mel_bank(rate, size, bands), 1e-10))


def loud_spans(energy: np.ndarray, rise: float, fall: float) -> list[tuple[int, int]]:
    """Runs of frames that begin where the energy reaches `rise` and end where it drops under `fall`."""
    on, spans, start = False, [], 0
    state = np.where(energy >= rise, 1, np.where(energy < fall, -1, 0))
    for i in np.flatnonzero(state):
        if state[i] > 0 and not on:
            on, start = True, int(i)
        elif state[i] < 0 and on:
            on = False
            spans.append((start, int(i)))
    if on:
        spans.append((start, len(energy)))
    return spans


def blockwise_mel(raw: np.ndarray, rate: int, up: int, down: int, size: int = 256, hop: int = 128) -> np.ndarray:
    """log_mel of 8-bit samples resampled by up/down, so many frames at a time that the work space stays small however long the clip."""
    total = resampled_length(len(raw), up, down)
    frames = max(1, -(-max(0, total - size) // hop) + 1)
    parts = []
    for f in range(0, frames, BLOCK):
        few = min(BLOCK, frames - f)
        first, end = f * hop, min((f + few - 1) * hop + size, total)
        low = max(0, first * down // up - 32 * max(up, down))
        low -= low % down  # a place where the phases begin anew
        part = (raw[low : end * down // up + 32 * max(up, down)].astype(np.float64) - 128) / 128
        x = resample(part, up, down, first - low * up // down, end - low * up // down)
        parts.append(log_mel(np.pad(x, (0, (few - 1) * hop + size - len(x))), rate * up // down, size, hop))
    return np.concatenate(parts)


def clip_features(media: bytes, up: int = 3, down: int = 4, hop: int = 128) -> tuple[np.ndarray, np.ndarray, list[tuple[float, float]], np.ndarray, np.ndarray]:
    """Of one clip, from its stored bytes: the mel bands of its frames, their mean, the time spans of its loud parts, the blocks of frames as float32 (blocks, frames, bands), and their time spans. The same bytes give the same result."""
    raw, rate = wav_samples(media)
    mel = blockwise_mel(raw, rate, up, down, hop=hop)
    energy = np.round(mel.mean(axis=1), 6)
    middle = float(np.median(energy))
    second = hop / (rate * up // down)
    count = -(-len(mel) // FRAMES)
    full = np.full((count * FRAMES, BANDS), -10, "<f4")
    full[: len(mel)] = np.round(mel, 3)
    loud = [(a * second, b * second) for a, b in loud_spans(energy, middle + 0.05, middle - 0.05)]
    edge = np.minimum(np.arange(count + 1) * FRAMES, len(mel)) * second
    return mel, np.round(mel.mean(axis=0), 3).astype(np.float32), loud, full.reshape(count, FRAMES, BANDS), np.column_stack([edge[:-1], edge[1:]])


def features_of(media: bytes, up: int = 3, down: int = 4, hop: int = 128) -> dict:
    """clip_features as a row of audio_features."""
    mel, mean, loud, blocks, spans = clip_features(media, up, down, hop)
    return {
        "n_frames": len(mel),
        "mel_mean": mean,
        "segments": [{"start_s": a, "end_s": b} for a, b in loud],
        "tensors": [{"start_s": a, "end_s": b, "values": block.tobytes()} for block, (a, b) in zip(blocks, spans.tolist(), strict=True)],
    }


def encode_audio(df: DataFrame, payload_col: str, out: str = "media", rate: int = 16000) -> DataFrame:
    """Add the payload as an 8-bit mono WAV, whose samples are the payload's bytes; a null payload gives an empty clip."""
    data = F.coalesce(F.col(payload_col), F.lit(b""))

    def little(n: Column) -> Column:
        big = F.lpad(F.hex(n), 8, "0")
        return F.unhex(F.concat(*[big.substr(i, 2) for i in (7, 5, 3, 1)]))

    n, fixed = F.octet_length(data), wav_header(0, rate)
    return df.withColumn(out, F.concat(F.lit(fixed[:4]), little(n + 36), F.lit(fixed[8:40]), little(n), data))


def audio_features(df: DataFrame, media_col: str = "media", tensors: bool = True) -> DataFrame:
    """Read the stored clips back and compute features, one row per row of df.

    Adds samples (the clip's bytes as read), n_frames, mel_mean, segments (time spans of loud parts,
    by hysteresis), tensors: blocks of 64 frames by 24 bands, float32, the last one filled with
    -10, each with its time span; and tensor_ipc: the same blocks as stored, an Arrow stream whose
    column mel is of the fixed-shape tensor type, beside start_s and end_s. Without `tensors` the
    blocks come as tensor_ipc alone. These replace columns of
    their names in df. The clip must be an 8-bit mono WAV; a null clip gives nulls. No shuffle; each
    row stands alone, so a lost executor only repeats its own rows. A clip is worked on in blocks of
    frames: beyond its bytes and its features, little is held.
    """
    small_batches(df.sparkSession)
    from pyspark.sql import types as T

    span = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])
    added = {f.name: f for f in [T.StructField("samples", T.BinaryType()), *T.StructType.fromDDL(FEATURES).fields, T.StructField("tensor_ipc", T.BinaryType())]}
    columns = [c for c in df.columns if c not in added]
    names = [c for c in added if tensors or c != "tensors"]
    given = [f"given{i}" for i in range(len(columns))]  # names that can't clash, whatever df's are

    def listed(parts: list, of: pa.Array) -> pa.Array:
        """One list for each part, null for None, over their elements in a row."""
        offsets = np.concatenate([[0], np.cumsum([0 if p is None else len(p) for p in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), of, mask=pa.array([p is None for p in parts], pa.bool_()))

    def spans_of(parts: list) -> list[pa.Array]:
        flat = np.array([x for p in parts if p is not None for x in p], np.float64).reshape(-1, 2)
        return [pa.array(flat[:, 0]), pa.array(flat[:, 1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clips = batch.column("clip").to_pylist()
            made = [None if c is None else clip_features(c) for c in clips]
            of = lambda f: [None if m is None else f(m) for m in made]
            means, loud, blocks, spans = of(lambda m: m[1]), of(lambda m: m[2]), of(lambda m: m[3]), of(lambda m: m[4])
            out = {
                "samples": pa.array([None if c is None else wav_samples(c)[0].tobytes() for c in clips], pa.binary()),
                "n_frames": pa.array(of(lambda m: len(m[0])), pa.int32()),
                "mel_mean": listed(means, pa.array(np.concatenate([np.zeros(0, np.float32), *(m for m in means if m is not None)]), pa.float32())),
                "segments": listed(loud, pa.StructArray.from_arrays(spans_of(loud), fields=list(span))),
                "tensor_ipc": pa.array([None if b is None else tensor_stream(b, s) for b, s in zip(blocks, spans, strict=True)], pa.binary()),
            }
            if tensors:
                values = pa.array([b.tobytes() for m in blocks if m is not None for b in m], pa.binary())
                out["tensors"] = listed(spans, pa.StructArray.from_arrays([*spans_of(spans), values], fields=[*span, pa.field("values", pa.binary())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in given), *(out[n] for n in names)], names=[*given, *names])

    schema = T.StructType([*(T.StructField(g, df.schema[c].dataType) for g, c in zip(given, columns, strict=True)), *(added[n] for n in names)])
    plain = df.select(*[F.col(f"`{c}`").alias(g) for g, c in zip(given, columns, strict=True)], F.col(f"`{media_col}`").alias("clip"))
    return plain.mapInArrow(run, schema).toDF(*columns, *names)


def tensor_columns(blocks: np.ndarray, spans: np.ndarray) -> dict[str, pa.Array]:
    """start_s, end_s and mel, the last of the fixed-shape tensor type, of blocks (n, frames, bands) and their spans (n, 2)."""
    kind = pa.fixed_shape_tensor(pa.float32(), (FRAMES, BANDS), dim_names=("frame", "band"))
    storage = pa.FixedSizeListArray.from_arrays(pa.array(blocks.ravel(), pa.float32()), FRAMES * BANDS)
    return {"start_s": pa.array(spans[:, 0]), "end_s": pa.array(spans[:, 1]), "mel": pa.ExtensionArray.from_storage(kind, storage)}


def tensor_stream(blocks: np.ndarray | list[dict], spans: np.ndarray | None = None) -> bytes:
    """The tensors of one clip as an Arrow IPC stream; also from the rows of the column tensors."""
    made = pa.table(tensor_columns(*(unpacked(blocks) if spans is None else (blocks, spans))))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, made.schema) as writer:
        writer.write_table(made)
    return sink.getvalue().to_pybytes()


def unpacked(tensors: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and spans of rows of the column tensors."""
    blocks = np.frombuffer(b"".join(t["values"] for t in tensors), "<f4").reshape(-1, FRAMES, BANDS)
    return blocks, np.array([(t["start_s"], t["end_s"]) for t in tensors], np.float64).reshape(-1, 2)


def tensors_in(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Values (tensors, frames, bands) and time spans (tensors, 2) of a stored stream."""
    made = pa.ipc.open_stream(stream).read_all().combine_chunks()
    mel = made.column("mel").combine_chunks()
    return mel.to_numpy_ndarray(), np.column_stack([made.column(c).to_numpy() for c in ("start_s", "end_s")])


def tensor_table(rows: list[dict]) -> pa.Table:
    """Collected rows of audio_features (doc_id, tensors) as an Arrow table with a fixed-shape tensor column."""
    flat = [(r["doc_id"], t) for r in rows for t in r["tensors"]]
    return pa.table({"doc_id": pa.array([k for k, _ in flat], pa.int64()), **tensor_columns(*unpacked([t for _, t in flat]))})


def write_tensors(df: DataFrame, path: str) -> DataFrame:
    """Write each partition's tensors (of doc_id, tensors) as an Arrow IPC file under path, any place pyarrow can reach; returns files and rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        where.create_dir(root, recursive=True)
        for batch in batches:
            made = tensor_table(batch.to_pylist())
            name = f"{root}/{uuid.uuid4().hex}.arrow"
            with where.open_output_stream(name) as sink, pa.ipc.new_file(sink, made.schema) as writer:
                writer.write_table(made)
            yield pa.RecordBatch.from_pydict({"file": [name], "tensors": pa.array([made.num_rows], pa.int64())})

    return df.select("doc_id", "tensors").mapInArrow(run, "file string, tensors long")


def op9_query(spark, sf_dir: str) -> DataFrame:
    """All documents' bytes as clips, written as a table and read back, with their features and tensors."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), padded(F.col("text")).alias("payload"))
    stored = materialize(encode_audio(docs, "payload").drop("payload"), "media")
    made = audio_features(stored, tensors=False)
    feature = F.concat_ws(";", F.concat_ws(",", F.transform("mel_mean", lambda v: F.format_string("%.3f", v))), F.concat_ws(",", F.transform("segments", lambda s: F.format_string("%.3f-%.3f", s["start_s"], s["end_s"]))), F.sha2("tensor_ipc", 256))
    return made.select("doc_id", "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), F.crc32(F.expr("substring(samples, -32, 32)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), "tensor_ipc")
