"""Chroma fingerprints of audio columns, their search and alignment.

Audio is 16-bit little-endian mono PCM in a binary column, at RATE samples a second. A frame of FRAME samples, every
HOP, is windowed and transformed; the energy of each bin between LOW and HIGH goes to its pitch class, classes are
smoothed over five frames and each frame is divided by its norm. In the integral image of frames by classes, FILTERS
(rectangle comparisons over up to 16 frames) give log ratios, each cut into four by fixed thresholds and written as two
Gray-coded bits: one 32-bit integer for each place.

Recordings with equal fingerprints are one class. A query's class meets every other class at every offset at which
they overlap by half of the shorter one; the bits that differ over the whole overlap are the error. The best match is
that with the least error, then the smallest class, then the offset nearest 0, then the smaller one. The search is
exact: bits are signals of plus and minus one, whose correlation at all offsets comes from their spectra, and what is
within rounding of the least error is counted again bit by bit. Equal integers as keys would miss the best class where
it differs in a quarter of its bits. The work is queries times classes.

Null audio and audio shorter than one filter have an empty fingerprint, which matches nothing. Null and repeated ids
are recordings like others: a class is named by its smallest id that is not null, so that one whose ids are all null has
no name; it is searched, and a match with it shows as an offset and an error without a name. An empty table gives no
rows; columns other than id and audio are not read, whatever their names; long recordings are read whole, one at a time.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

RATE, FRAME, HOP, LOW, HIGH = 8000, 2048, 512, 60.0, 3500.0
WIDTH = 16
#: Bits that may differ in a match; places that must overlap, as a share of the shorter recording.
MAX_ERROR, LEAST_OVERLAP = 0.35, 0.5
#: Places of queries and of classes that meet in one group of the search; cells of one correlation.
QUERY_PLACES, CLASS_PLACES, CELLS = 1 << 17, 1 << 19, 1 << 22
#: Rounding of a correlation at most, as a share of bits.
_ROUNDING = 1e-4
_SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])


def _filters() -> list[tuple[int, int, int, int]]:
    """kind, first class, classes, frames of sixteen filters: by rule, each kind at several sizes."""
    out = []
    for i in range(16):
        kind = i % 4
        out.append((kind, (5 * i) % 12, 1 + (7 * i) % 6 if kind != 2 else 2 + 2 * (i % 3), (4, 8, 12, 16)[(i // 4 + i) % 4]))
    return out


FILTERS = _filters()
_CUTS = (-0.25, 0.0, 0.25)
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    used = np.flatnonzero((f >= LOW) & (f <= HIGH))
    return used, np.round(12 * np.log2(f[used] / 440.0)).astype(int) % 12


_USED, _CLASS = _classes()
_ONE_HOT = (_CLASS[:, None] == np.arange(12)).astype(np.float64)
_WINDOW = np.hanning(FRAME)


def chroma(pcm: bytes | None) -> np.ndarray:
    """Frames by pitch classes."""
    x = np.frombuffer((pcm or b"")[: len(pcm or b"") // 2 * 2], "<i2").astype(np.float64)
    if len(x) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = np.empty((len(frames), 12))
    for low in range(0, len(frames), 256):
        power = np.abs(np.fft.rfft(frames[low : low + 256] * _WINDOW)[:, _USED]) ** 2
        out[low : low + 256] = power @ _ONE_HOT
    if len(out) < 5:
        return np.zeros((0, 12))
    smooth = sum(w * out[i : len(out) - 4 + i] for i, w in enumerate(_SMOOTH))
    norm = np.sqrt((smooth**2).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-6, smooth / np.maximum(norm, 1e-6), 0.0)


def fingerprint(pcm: bytes | None) -> np.ndarray:
    """Integers below 2 to the 32, one for each place; none for audio under WIDTH smoothed frames."""
    image = chroma(pcm)
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    wide = np.concatenate([image, image], axis=1)  # classes go round
    integral = np.zeros((len(wide) + 1, 25))
    integral[1:, 1:] = wide.cumsum(axis=0).cumsum(axis=1)

    def box(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        a, b = integral[t0 : t0 + n], integral[t1 : t1 + n]
        return b[:, c1] - a[:, c1] - b[:, c0] + a[:, c0]

    out = np.zeros(n, np.uint32)
    for kind, c, h, w in FILTERS:
        if kind == 0:  # against all classes of these frames
            a, b = box(0, w, c, c + h), box(0, w, 0, 12) * h / 12
        elif kind == 1:  # earlier against later
            a, b = box(0, w // 2, c, c + h), box(w // 2, w, c, c + h)
        elif kind == 2:  # lower against upper classes
            a, b = box(0, w, c, c + h // 2), box(0, w, c + h // 2, c + h)
        else:  # middle against ends
            a, b = box(w // 4, 3 * w // 4, c, c + h), box(0, w // 4, c, c + h) + box(3 * w // 4, w, c, c + h)
        value = np.log((1 + a) / (1 + b))
        out = (out << np.uint32(2)) | _GRAY[np.digitize(value, _CUTS)]
    return out.astype(np.int64)


def fingerprints(recordings: DataFrame, id: str, audio: str, decode=None) -> DataFrame:
    """id, n_samples, prints of each row. decode makes PCM of a value; it runs beside the fingerprint, one value at a
    time, so that no batch of decoded sound is ever held."""

    def of(batches):
        for batch in batches:
            ids, sizes, prints, ends = batch.column(0), [], [], [0]
            for value in batch.column(1):
                pcm = decode(value.as_py()) if decode else value.as_py()
                prints.append(fingerprint(pcm))
                sizes.append(len(pcm or b"") // 2)
                ends.append(ends[-1] + len(prints[-1]))
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *prints]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["id", "n_samples", "prints"])

    kind = recordings.schema[id].dataType.simpleString()
    return recordings.select(F.col(id).alias("id"), F.col(audio).alias("audio")).mapInArrow(of, f"id {kind}, n_samples long, prints array<long>")


def least_overlap(a: int, b: int) -> int:
    return max(1, math.ceil(LEAST_OVERLAP * min(a, b)))


def best_offset(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
    """Error and offset (of a in b) of the best alignment of two fingerprints, counted bit by bit."""
    found, least = [], least_overlap(len(a), len(b))
    for offset in range(least - len(a), len(b) - least + 1):
        first, last = max(0, -offset), min(len(a), len(b) - offset)
        if last - first >= least:
            bits = int(np.bitwise_count(a[first:last] ^ b[first + offset : last + offset]).sum())
            found.append((bits / (32 * (last - first)), abs(offset), offset))
    error, _, offset = min(found)
    return error, offset


def _spectra(prints: list[np.ndarray], size: int) -> np.ndarray:
    """Frequencies by recordings by bits."""
    signal = np.zeros((len(prints), size, 32), np.float32)
    for i, x in enumerate(prints):
        bits = np.unpackbits(x.astype("<u4").view(np.uint8), bitorder="little").reshape(-1, 32)
        signal[i, : len(x)] = 2.0 * bits - 1.0
    return np.ascontiguousarray(np.fft.rfft(signal, axis=1).transpose(1, 0, 2))


def _least_errors(spectra_q: np.ndarray, spectra_c: np.ndarray, size: int, n_q: np.ndarray, n_c: np.ndarray) -> np.ndarray:
    """Least error of each query (lengths n_q) with each class (n_c), up to rounding; 0.5 if none is less."""
    low = least_overlap(int(n_q.min()), int(n_c.min()))
    offsets = np.arange(low - n_q.max(), n_c.max() - low + 1)
    if n_q.min() == n_q.max():
        n_q = n_q[:1]
    if n_c.min() == n_c.max():
        n_c = n_c[:1]
    o, a, b = offsets[:, None, None], n_q[None, :, None], n_c[None, None, :]
    overlap = np.minimum(a, b - o) - np.maximum(0, -o)
    enough = overlap >= np.maximum(1, np.ceil(LEAST_OVERLAP * np.minimum(a, b)))
    scale = np.where(enough, 1 / (64 * np.maximum(overlap, 1)), 0).astype(np.float32)
    agreed = np.fft.irfft(np.matmul(spectra_q, spectra_c), n=size, axis=0)[offsets % size]
    agreed *= scale
    return 0.5 - agreed.max(axis=0)


def _runs(prints: list[np.ndarray], most: int) -> list[list[int]]:
    """Places of the recordings by length, in runs of at most `most` places, each counted as the longest of its run."""
    order, out = sorted(range(len(prints)), key=lambda i: len(prints[i])), []
    for i in order:
        if not out or (len(out[-1]) + 1) * len(prints[i]) > most or len(prints[i]) > 1.25 * len(prints[out[-1][0]]):
            out.append([])
        out[-1].append(i)
    return out


def _smooth_size(n: int) -> int:
    """The first number from n on without a prime factor over 5."""
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def search(queries: list[tuple], classes: list[tuple]) -> list[tuple]:
    """Places of query and class, offset and error of the best pairs of each query: (name, integers) both; those of
    equal names don't meet. Ties are all given."""
    q, c = ([np.asarray(x, np.uint32) for _, x in rows] for rows in (queries, classes))
    named = defaultdict(list)
    for j, (name, _) in enumerate(classes):
        named[name].append(j)
    own = [set(named[name]) for name, _ in queries]
    best = np.full(len(q), MAX_ERROR)
    near: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    runs = _runs(q, 1 << 13)
    for of_c in _runs(c, CELLS >> 6):
        n_c, at, known = np.array([len(c[j]) for j in of_c]), {j: k for k, j in enumerate(of_c)}, {}
        for of_q in runs:
            n_q = np.array([len(q[i]) for i in of_q])
            size = _smooth_size(int(n_q.max() + n_c.max()) - least_overlap(int(n_q.min()), int(n_c.min())))
            if size not in known:
                known = {size: np.ascontiguousarray(_spectra([c[j] for j in of_c], size).transpose(0, 2, 1))}
            step = max(1, CELLS // (size * len(of_c)))
            for low in range(0, len(of_q), step):
                some = np.array(of_q[low : low + step])
                errors = _least_errors(_spectra([q[i] for i in some], size).conj(), known[size], size, n_q[low : low + step], n_c)
                for k, i in enumerate(some):
                    errors[k, [at[j] for j in own[i] if j in at]] = 1.0
                best[some] = np.minimum(best[some], errors.min(axis=1))
                k, j = np.nonzero(errors <= best[some, None] + _ROUNDING)
                near.append((some[k], np.array(of_c)[j], errors[k, j]))
    exact: dict[int, list] = defaultdict(list)
    for some, others, errors in near:
        for i, j, e in zip(some.tolist(), others.tolist(), errors.tolist(), strict=True):
            if e <= best[i] + _ROUNDING:
                error, offset = best_offset(q[i], c[j])
                if error <= MAX_ERROR:
                    exact[i].append((error, j, offset))
    return [(i, j, offset, error) for i, found in exact.items() for error, j, offset in found if error == min(found)[0]]


def matched(queries: DataFrame, classes: DataFrame) -> DataFrame:
    """queries (query, prints) with their best other class (class, prints): match, offset (of the query in the match),
    bit_error; none over MAX_ERROR. Every query meets every class in one group of bounded size."""
    q, c = queries.where(F.size("prints") > 0), classes.where(F.size("prints") > 0)
    places_q, places_c = (df.agg(F.coalesce(F.sum(F.size("prints")), F.lit(0))).first()[0] for df in (q, c))
    cores = q.sparkSession.sparkContext.defaultParallelism
    rows, columns = max(1, -(-places_q // QUERY_PLACES)), max(1, 4 * cores, -(-places_c // CLASS_PLACES))
    kind_q, kind_c = queries.schema["query"].dataType.simpleString(), classes.schema["class"].dataType.simpleString()
    deal_q = F.pmod(F.xxhash64("prints"), F.lit(rows)) * columns
    deal_c = F.pmod(F.xxhash64("prints"), F.lit(columns))
    q = q.select("query", "prints", F.explode(F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda j: deal_q + j)).alias("group"))
    c = c.select("class", "prints", F.explode(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: deal_c + i * columns)).alias("group"))

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        def named(t: pa.Table) -> list[tuple]:
            prints = t.column("prints").combine_chunks()
            flat, ends = prints.flatten().to_numpy().astype(np.uint32), np.cumsum([0, *prints.value_lengths().to_pylist()])
            return [(name, flat[ends[k] : ends[k + 1]]) for k, name in enumerate(t.column(0).to_pylist())]

        found = search(named(left), named(right)) if left.num_rows and right.num_rows else []
        i, j, offset, error = zip(*found, strict=True) if found else ((), (), (), ())
        return pa.table([left.column(0).take(pa.array(i, pa.int64())), right.column(0).take(pa.array(j, pa.int64())), pa.array(offset, pa.int64()), pa.array(error, pa.float64())], ["query", "class", "offset", "bit_error"])

    parts = min(rows * columns, 1 << 14)
    met = q.repartition(parts, "group").groupBy("group").cogroup(c.repartition(parts, "group").groupBy("group"))
    found = met.applyInArrow(one, f"query {kind_q}, class {kind_c}, offset long, bit_error double")
    best = found.groupBy("query").agg(F.min(F.struct("bit_error", "class", F.abs("offset").alias("far"), "offset")).alias("m"))
    return best.select("query", F.col("m.class").alias("match"), F.col("m.offset").alias("offset"), F.col("m.bit_error").alias("bit_error"))


def _notes() -> np.ndarray:
    """The 25 notes of two octaves above 220 Hz, an eighth of a second each."""
    t = np.arange(RATE // 8) / RATE
    pitch = 220.0 * 2 ** (np.arange(25) / 12)
    sound = (np.sin(2 * np.pi * pitch[:, None] * t) + 0.4 * np.sin(4 * np.pi * pitch[:, None] * t)) * np.hanning(len(t)) ** 0.25
    return (8000 * sound).astype("<i2")


_NOTES = _notes()


def rendered(vector) -> bytes:
    """A vector as sound: each of its numbers, however many, is a note of an eighth of a second."""
    v = np.nan_to_num(np.asarray(vector if vector is not None else [], np.float64))
    return _NOTES[np.round(24 * np.clip((v + 0.4) / 0.8, 0, 1)).astype(int)].tobytes()


def op1_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector, rendered as sound, with its fingerprint and class; those whose id is divisible by 50 are searched
    for among all classes but their own."""
    prints = written(fingerprints(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", rendered), "prints")
    classes = written(prints.groupBy("prints").agg(F.min("id").alias("class")), "classes")
    members = written(prints.join(classes, "prints").select("id", "n_samples", "class", F.size("prints").alias("n_prints"), F.sha2(F.array_join(F.transform("prints", lambda x: x.cast("string")), ","), 256).alias("fingerprint_sha256"), "prints"), "members")
    wanted = members.where("id % 50 = 0 and n_prints > 0").groupBy("class").agg(F.first("prints").alias("prints")).withColumnRenamed("class", "query")
    best = matched(wanted, classes.where(F.size("prints") > 0))
    found = members.drop("prints").join(best, (F.col("class") == F.col("query")) & (F.col("id") % 50 == 0), "left")
    return found.select(F.col("id").alias("vec_id"), "n_samples", "n_prints", "fingerprint_sha256", F.col("class").alias("class_id"), F.col("match").alias("match_class"), "offset", "bit_error")
