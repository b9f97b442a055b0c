"""Standard MIDI file bytes to and from event rows. No Spark in here."""

from __future__ import annotations

import struct
from collections.abc import Iterable

KINDS = {0x8: "note_off", 0x9: "note_on", 0xA: "polytouch", 0xB: "control_change", 0xC: "program_change", 0xD: "aftertouch", 0xE: "pitch_bend"}
STATUS = {name: code for code, name in KINDS.items()}
#: seq, tick, kind, channel, data1, data2, tempo, numerator, denominator, text
Event = tuple[int, int, str, int | None, int | None, int | None, int | None, int | None, int | None, str | None]


class SmfError(ValueError):
    """Bytes that are no MIDI file, with the offset of the trouble."""

    def __init__(self, message: str, offset: int) -> None:
        super().__init__(f"{message} (byte {offset})")
        self.message, self.offset = message, offset


def header(raw: bytes) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(format, ticks per beat, tracks, [(begin, end) of each track's data])."""
    if len(raw) < 14 or raw[:4] != b"MThd":
        raise SmfError("no MThd header", 0)
    size, kind, tracks, division = struct.unpack(">IHHH", raw[4:14])
    if size < 6:
        raise SmfError("header too short", 4)
    if kind > 2:
        raise SmfError("unknown format", 8)
    if kind == 0 and tracks != 1:
        raise SmfError("format 0 must have one track", 10)
    if division & 0x8000 or not division:
        raise SmfError("no ticks per beat", 12)
    at, chunks = 8 + size, []
    while at < len(raw) and len(chunks) < tracks:
        if at + 8 > len(raw):
            raise SmfError("chunk header cut off", at)
        name, length = raw[at : at + 4], struct.unpack(">I", raw[at + 4 : at + 8])[0]
        if at + 8 + length > len(raw):
            raise SmfError("chunk goes past the end", at + 4)
        if name == b"MTrk":
            chunks.append((at + 8, at + 8 + length))
        at += 8 + length
    if len(chunks) != tracks:
        raise SmfError("fewer tracks than announced", min(at, len(raw)))
    return kind, division, tracks, chunks


def _number(raw: bytes, at: int, end: int) -> tuple[int, int]:
    value = 0
    for _ in range(4):
        if at >= end:
            raise SmfError("number cut off", at)
        byte = raw[at]
        at += 1
        value = value << 7 | byte & 0x7F
        if byte < 0x80:
            return value, at
    raise SmfError("number too long", at)


def track_events(raw: bytes, begin: int, end: int) -> Iterable[Event]:
    at, tick, status, seq = begin, 0, 0, 0
    while at < end:
        delta = raw[at]
        if delta < 0x80:
            at += 1
        else:
            delta, at = _number(raw, at, end)
        tick += delta
        if at >= end:
            raise SmfError("event cut off", at)
        if raw[at] >= 0x80:
            status = raw[at]
            at += 1
        elif status < 0x80:
            raise SmfError("no running status", at)
        if status < 0xF0:  # of a channel, as most events are
            kind = KINDS[status >> 4]
            size = 1 if kind in ("program_change", "aftertouch") else 2
            if at + size > end:
                raise SmfError("event cut off", at)
            a, b = raw[at], raw[at + 1] if size == 2 else None
            at += size
            if a > 127 or (b or 0) > 127:
                raise SmfError("data byte out of range", at - size)
            if kind == "note_on" and b == 0:
                kind = "note_off"
            yield seq, tick, kind, status & 0xF, a, b, None, None, None, None
        elif status == 0xFF:
            if at >= end:
                raise SmfError("event cut off", at)
            kind = raw[at]
            size, at = _number(raw, at + 1, end)
            data, at = raw[at : at + size], at + size
            if at > end:
                raise SmfError("meta event cut off", end)
            status = 0
            if kind == 0x2F:
                yield seq, tick, "end_of_track", None, None, None, None, None, None, None
                return
            if kind == 0x51 and size == 3:
                yield seq, tick, "tempo", None, None, None, int.from_bytes(data, "big"), None, None, None
            elif kind == 0x58 and size >= 2:
                yield seq, tick, "time_signature", None, None, None, None, data[0], 1 << min(data[1], 30), None
            elif kind == 0x59 and size == 2:
                yield seq, tick, "key_signature", None, None, None, None, None, None, key_name(data[0] - 256 if data[0] > 127 else data[0], data[1])
            else:
                continue
        elif status in (0xF0, 0xF7):
            size, at = _number(raw, at, end)
            at += size
            if at > end:
                raise SmfError("system message cut off", end)
            status = 0
            continue
        else:
            raise SmfError("event cut off", at)
        seq += 1


# Key names by sharps (positive) or flats (negative).
MAJOR_KEYS = ("Cb", "Gb", "Db", "Ab", "Eb", "Bb", "F", "C", "G", "D", "A", "E", "B", "F#", "C#")
MINOR_KEYS = ("Ab", "Eb", "Bb", "F", "C", "G", "D", "A", "E", "B", "F#", "C#", "G#", "D#", "A#")


def key_name(sharps: int, minor: int) -> str | None:
    if not -7 <= sharps <= 7:
        return None
    return f"{MINOR_KEYS[sharps + 7]} minor" if minor else f"{MAJOR_KEYS[sharps + 7]} major"


def decode(raw: bytes) -> tuple[int, int, list[tuple[int, Event]]]:
    """(format, ticks per beat, [(track, event)]); format 2 counts as 1."""
    kind, division, _, chunks = header(raw)
    return min(kind, 1), division, [(t, e) for t, (a, b) in enumerate(chunks) for e in track_events(raw, a, b)]


def _varlen(value: int) -> bytes:
    if value < 0:
        raise ValueError("ticks go back")
    if value < 1 << 7:
        return bytes((value,))
    if value < 1 << 14:
        return bytes((value >> 7 | 0x80, value & 0x7F))
    return bytes(x | 0x80 for x in _varlen(value >> 7)) + bytes((value & 0x7F,))


def _message(kind: str, channel, data1, data2, tempo, numerator, denominator, text) -> bytes:
    if kind in STATUS:
        status = STATUS[kind] << 4 | int(channel)
        if kind in ("program_change", "aftertouch"):
            return bytes((status, int(data1)))
        return bytes((status, int(data1), int(data2 or 0)))
    if kind == "tempo":
        return b"\xff\x51\x03" + int(tempo).to_bytes(3, "big")
    if kind == "time_signature":
        return bytes((0xFF, 0x58, 4, int(numerator), int(denominator).bit_length() - 1, 24, 8))
    if kind == "key_signature":
        tonic, mode = text.split(" ")
        keys = MINOR_KEYS if mode == "minor" else MAJOR_KEYS
        return bytes((0xFF, 0x59, 2, (keys.index(tonic) - 7) % 256, int(mode == "minor")))
    raise KeyError(kind)


def encode(kind: int, division: int, tracks: list[list[tuple]]) -> bytes:
    """``tracks``: per track (tick, kind, channel, data1, data2, tempo,
    numerator, denominator, text) in writing order."""
    if kind == 0 and len(tracks) != 1:
        raise ValueError("format 0 must have one track")
    out = [b"MThd" + struct.pack(">IHHH", 6, kind, len(tracks), division)]
    for track in tracks:
        body, last = bytearray(), 0
        for at, *event in track:
            tick = int(at)
            body += _varlen(tick - last)
            body += _message(*event)
            last = tick
        body += b"\x00\xff\x2f\x00"
        out.append(b"MTrk" + struct.pack(">I", len(body)) + bytes(body))
    return b"".join(out)
