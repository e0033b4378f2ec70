"""Standard MIDI files: a small reader, note tables, structural hashes, and the bar-position token encoding."""

from __future__ import annotations

import hashlib
import json
import struct
from collections import Counter, deque
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the MIDI format: the drum channel, and channel messages with their number of data bytes.
DRUMS = 9
_CHANNEL = {8: ("note_off", 2), 9: ("note_on", 2), 10: ("polytouch", 2), 11: ("control_change", 2), 12: ("program_change", 1), 13: ("aftertouch", 1), 14: ("pitchwheel", 2)}


class Event(NamedTuple):
    delta: int
    kind: str
    channel: int
    data: tuple


class Song(NamedTuple):
    ppq: int
    tracks: list[list[Event]]


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def byte(self) -> int:
        if self.at >= len(self.raw):
            raise ValueError("unexpected end of MIDI data")
        self.at += 1
        return self.raw[self.at - 1]

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise ValueError("unexpected end of MIDI data")
        self.at += n
        return self.raw[self.at - n : self.at]

    def number(self) -> int:
        value = 0
        while True:
            b = self.byte()
            value = value << 7 | b & 127
            if b < 128:
                return value


def _track(raw: bytes, clip: bool) -> list[Event]:
    r, out, status = _Reader(raw), [], 0
    while r.at < len(raw):
        delta, first = r.number(), r.byte()
        if first == 0xFF:
            kind, body = r.byte(), r.take(r.number())
            name = {0x51: "set_tempo", 0x58: "time_signature", 0x2F: "end_of_track"}.get(kind, "meta")
            data = (int.from_bytes(body, "big"),) if name == "set_tempo" else (body[0], 2 ** body[1], *body[2:]) if name == "time_signature" else (kind, body.hex())
            out.append(Event(delta, name, -1, data))
        elif first in (0xF0, 0xF7):
            out.append(Event(delta, "sysex", -1, (r.take(r.number()).hex(),)))
        else:
            if first >= 128:
                status = first
                data = []
            else:
                data = [first]
            if status >> 4 not in _CHANNEL:
                raise ValueError("running status without status byte")
            name, n = _CHANNEL[status >> 4]
            data += [r.byte() for _ in range(n - len(data))]
            if any(d > 127 for d in data):
                if not clip:
                    raise ValueError("data byte must be in range 0..127")
                data = [min(127, d) for d in data]
            out.append(Event(delta, name, status & 15, tuple(data)))
    return out


def read(raw: bytes, clip: bool = False) -> Song:
    """Tracks of a Standard MIDI File. Running status, system-exclusive and meta events are understood; chunks of other kinds are skipped."""
    r = _Reader(raw)
    if r.take(4) != b"MThd":
        raise ValueError("not a Standard MIDI File")
    head = r.take(struct.unpack(">I", r.take(4))[0])
    _, count, division = struct.unpack(">HHH", head[:6])
    if division & 0x8000 or not division:
        raise ValueError("MIDI ticks_per_beat must be positive")
    tracks = []
    while r.at < len(raw) and len(tracks) < count:
        name, size = r.take(4), struct.unpack(">I", r.take(4))[0]
        body = r.take(size)
        if name == b"MTrk":
            tracks.append(_track(body, clip))
    return Song(division, tracks)


class Note(NamedTuple):
    start: int
    end: int | None  # None: never closed
    channel: int
    pitch: int
    velocity: int
    program: int
    track: int


def paired(events: list[tuple[int, Event]], track: int, programs: dict[int, int]) -> list[Note]:
    """Notes from (tick, event): each note-off closes the oldest open note of its channel and pitch, and is ignored if none is open. Unclosed notes come last."""
    out: list[Note] = []
    waiting: dict[tuple[int, int], deque] = {}
    for tick, e in events:
        if e.kind == "program_change":
            programs[e.channel] = e.data[0]
        elif e.kind in ("note_on", "note_off"):
            queue = waiting.setdefault((e.channel, e.data[0]), deque())
            if e.kind == "note_on" and e.data[1] > 0:
                queue.append((tick, e.data[1], programs.get(e.channel, 0)))
            elif queue:
                start, velocity, program = queue.popleft()
                out.append(Note(start, tick, e.channel, e.data[0], velocity, program, track))
    for (channel, pitch), queue in waiting.items():
        out += [Note(start, None, channel, pitch, velocity, program, track) for start, velocity, program in queue]
    return out


def ticked(track: list[Event]) -> list[tuple[int, Event]]:
    tick, out = 0, []
    for e in track:
        tick += e.delta
        out.append((tick, e))
    return out


def melodic_notes(raw: bytes) -> list[dict]:
    """Note rows for the detector: beats, drums left out, unclosed notes a quarter beat long, closed ones one tick at least."""
    song = read(raw, clip=True)
    rows = []
    for k, track in enumerate(song.tracks):
        for n in paired(ticked(track), k, {}):
            if n.channel != DRUMS:
                duration = 0.25 if n.end is None else max(1, n.end - n.start) / song.ppq
                rows.append({"onset": n.start / song.ppq, "duration": duration, "pitch": n.pitch, "velocity": n.velocity, "program": n.program, "track": k})
    if not rows:
        raise ValueError("no non-drum notes")
    return sorted(rows, key=lambda r: (r["onset"], r["pitch"], r["track"]))


def _digest(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def event_hashes(raw: bytes) -> dict[str, str]:
    """sha256 of the bytes, of the tracks' events (without meta events other than meter and tempo), and of the same tracks sorted."""
    tracks = []
    for track in read(raw).tracks:
        kept = [(t, e) for t, e in ticked(track) if e.channel >= 0 or e.kind in ("time_signature", "set_tempo", "sysex")]
        tracks.append([[t, e.kind, e.channel, list(e.data)] for t, e in kept])
    return {"byte_sha256": hashlib.sha256(raw).hexdigest(), "canonical_event_sha256": _digest(tracks), "track_order_invariant_sha256": _digest(sorted(tracks, key=json.dumps))}


def normalised_notes(raw: bytes) -> list[dict]:
    """The multiset of notes in exact beats: onset, duration, pitch, velocity, drum flag, multiplicity; an unclosed note is an error."""
    song = read(raw)
    count: Counter = Counter()
    for k, track in enumerate(song.tracks):
        notes = paired(ticked(track), k, {})
        if lost := sorted((n.channel, n.pitch) for n in notes if n.end is None):
            raise ValueError(f"unclosed active MIDI note: channel={lost[0][0]} pitch={lost[0][1]} count={lost.count(lost[0])}")
        count.update((Fraction(n.start, song.ppq), Fraction(n.end - n.start, song.ppq), n.pitch, n.velocity, n.channel == DRUMS) for n in notes)
    names = ("onset_beats", "duration_beats", "pitch", "velocity", "is_drum")
    return [dict(zip(names, ([k[0].numerator, k[0].denominator], [k[1].numerator, k[1].denominator], *k[2:]))) | {"multiplicity": n} for k, n in sorted(count.items())]


def normalised_hash(raw: bytes) -> str:
    return _digest({"events": normalised_notes(raw), "event_type": "note"})


def relation(a: dict[str, str], b: dict[str, str]) -> str:
    """The strongest of the four relations between two files' event_hashes()."""
    for name, key in (("BYTE_EXACT", "byte_sha256"), ("CANONICAL_EQUIVALENT", "canonical_event_sha256"), ("TRACK_ORDER_EQUIVALENT", "track_order_invariant_sha256")):
        if a[key] == b[key]:
            return name
    return "STRUCTURALLY_NONEXACT"


def relation_column(prefix_a: str = "a_", prefix_b: str = "b_") -> Column:
    same = lambda key: F.col(prefix_a + key) == F.col(prefix_b + key)
    return F.when(same("byte_sha256"), "BYTE_EXACT").when(same("canonical_event_sha256"), "CANONICAL_EQUIVALENT").when(same("track_order_invariant_sha256"), "TRACK_ORDER_EQUIVALENT").otherwise("STRUCTURALLY_NONEXACT")


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all MIDI files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{mid,midi,MID,MIDI}").load(root).select("path", "content")


_NOTES = "array<struct<onset:double,duration:double,pitch:int,velocity:int,program:int,track:int>>"
_NOTES_ARROW = pa.list_(pa.struct([("onset", pa.float64()), ("duration", pa.float64()), ("pitch", pa.int32()), ("velocity", pa.int32()), ("program", pa.int32()), ("track", pa.int32())]))


def _each(work, kinds: list, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw in b.column(1):
                try:
                    rows.append((*work(raw.as_py()), None))
                except Exception as e:  # a broken file is a row with its error
                    rows.append((*[None] * len(names), f"{type(e).__name__}: {e}"))
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), [*kinds, pa.string()])] if rows else [pa.array([], k) for k in [*kinds, pa.string()]]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["path", *names, "error"])

    return run


def parse(binary: DataFrame) -> DataFrame:
    """(path, notes, error) of (path, content); a file that cannot be read has its error and no notes."""
    return binary.select("path", "content").mapInArrow(_each(lambda raw: (melodic_notes(raw),), [_NOTES_ARROW], ["notes"]), f"path string, notes {_NOTES}, error string")


def note_table(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("path").alias("piece"), F.explode("notes").alias("n")).select("piece", "n.*")


def hashes(binary: DataFrame) -> DataFrame:
    """(path, three event hashes, normalised_sha256, error)."""
    names = ["byte_sha256", "canonical_event_sha256", "track_order_invariant_sha256", "normalised_sha256"]
    work = lambda raw: (*event_hashes(raw).values(), normalised_hash(raw))
    return binary.select("path", "content").mapInArrow(_each(work, [pa.string()] * 4, names), ", ".join(f"{n} string" for n in ["path", *names, "error"]))


# The vocabulary of 237 ids.
PAD, BOS, EOS, BAR = 0, 1, 2, 3
POSITION, PROGRAM, PITCH, DURATION, VELOCITY, VOCABULARY = 4, 20, 29, 157, 221, 237


def vocabulary() -> list[str]:
    ranges = (("POSITION", range(16)), ("PROGRAM", range(9)), ("PITCH", range(128)), ("DURATION", range(1, 65)), ("VELOCITY", range(16)))
    return ["PAD", "BOS", "EOS", "BAR", *(f"{n}_{i}" for n, r in ranges for i in r)]


def merged_notes(raw: bytes) -> tuple[int, list[Note]]:
    """(ticks per beat, notes) of all tracks as one stream, for encoding; only 4/4 meters; notes of no length and unclosed notes are dropped."""
    song = read(raw)
    stream = sorted(((t, k, i, e) for k, track in enumerate(song.tracks) for i, (t, e) in enumerate(ticked(track))), key=lambda x: x[:3])
    notes = [n for n in paired([(t, e) for t, _, _, e in stream], 0, {}) if n.end is not None and n.end > n.start]
    if not notes:
        raise ValueError("NO_NOTES")
    if any(e.kind == "time_signature" and e.data[:2] != (4, 4) for _, _, _, e in stream):
        raise ValueError("NON_4_4_METER")
    return song.ppq, notes


def quantised_notes(raw: bytes) -> list[tuple[int, int, int, int, int, int]]:
    """(bar, position, family, pitch, duration, velocity) in sixteenths, sorted; drums are family 8."""
    ppq, notes = merged_notes(raw)
    step = ppq / 4.0
    rows = []
    for n in notes:
        at = max(0, int(round(n.start / step)))
        long = min(64, max(1, int(round((n.end - n.start) / step))))
        rows.append((at // 16, at % 16, 8 if n.channel == DRUMS else min(7, n.program // 16), n.pitch, long, min(15, n.velocity * 16 // 128)))
    return sorted(rows)


def quantised(binary: DataFrame) -> DataFrame:
    """(path, rows, error): the note rows that sequences.encode() takes."""
    shape = ("bar", "position", "family", "pitch", "duration", "velocity")
    kind = pa.list_(pa.struct([(n, pa.int32()) for n in shape]))
    work = lambda raw: ([dict(zip(shape, r)) for r in quantised_notes(raw)],)
    return binary.select("path", "content").mapInArrow(_each(work, [kind], ["rows"]), "path string, rows array<struct<" + ",".join(f"{n}:int" for n in shape) + ">>, error string")


def write(tracks: list[list[tuple[int, bytes]]], ppq: int = 480) -> bytes:
    """A format-1 file from tracks of (delta, event bytes); for fixtures."""

    def number(n: int) -> bytes:
        out = [n & 127]
        while n := n >> 7:
            out.append(n & 127 | 128)
        return bytes(reversed(out))

    body = b""
    for t in tracks:
        raw = b"".join(number(d) + e for d, e in t) + b"\x00\xff\x2f\x00"
        body += b"MTrk" + struct.pack(">I", len(raw)) + raw
    return b"MThd" + struct.pack(">IHHH", 6, 1, len(tracks), ppq) + body
