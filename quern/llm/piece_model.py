"""Reading of SentencePiece model files, and normalisation that keeps the source's places."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Fixed values of the format: the visible space and the mark of invalid input.
SPACE, INVALID = "▁", "�"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        byte = data[at]
        at += 1
        out |= (byte & 127) << shift
        if byte < 128:
            return out, at
        shift += 7


def fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message; values stay raw."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield key >> 3, value


@dataclass
class PieceModel:
    """Pieces, scores and kinds by id, and the normaliser's settings.

    Fields 1 to 3 of the file: pieces, trainer settings, normaliser settings."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True
    space_as_suffix: bool = False
    unk_id: int = 0
    eos_id: int = 2
    unk_surface: str = " ⁇ "

    @classmethod
    def read(cls, path: str) -> PieceModel:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        m = cls()
        for number, value in fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                m.pieces.append(piece)
                m.scores.append(score)
                m.kinds.append(kind)
            elif number == 2:
                for n, v in fields(value):
                    if n == 35:
                        m.byte_fallback = bool(v)
                    elif n == 24:
                        m.space_as_suffix = bool(v)
                    elif n == 40:
                        m.unk_id = v
                    elif n == 44:
                        m.unk_surface = v.decode()
            elif number == 3:
                for n, v in fields(value):
                    if n == 2:
                        m.charsmap = v
                    elif n == 3:
                        m.dummy_prefix = bool(v)
                    elif n == 4:
                        m.remove_extra_spaces = bool(v)
                    elif n == 5:
                        m.escape_spaces = bool(v)
        m.eos_id = next((i for i, (p, k) in enumerate(zip(m.pieces, m.kinds)) if p == "</s>" and k == CONTROL), m.eos_id)
        m.unk_id = next((i for i, k in enumerate(m.kinds) if k == UNKNOWN), m.unk_id)
        return m


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 with offsets of replacements.

    Layout: 4 bytes length of the trie, the trie's 32-bit units, then the replacements, each
    ended by a zero byte."""

    def __init__(self, blob: bytes):
        (n,) = struct.unpack_from("<I", blob)
        self.units = struct.unpack_from(f"<{n // 4}I", blob, 4)
        self.text = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, int] | None:
        """(length of the longest key that starts at ``at``, place of its replacement)."""
        units = self.units
        unit = units[0]
        node = _offset(unit)
        found = None
        for i in range(at, len(data)):
            byte = data[i]
            node ^= byte
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:  # the node has a value: its leaf
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        return found

    def replacement(self, place: int) -> bytes:
        return self.text[place : self.text.index(b"\0", place)]


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 0x200) >> 6)


class Normalizer:
    """Longest-prefix normalisation that records, for each byte of its result and one past its
    end, the byte of the source where it comes from."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.map = CharMap(model.charsmap) if model.charsmap else None
        self.fixed = sorted((p.encode() for p, k in zip(model.pieces, model.kinds) if k == USER_DEFINED), key=len, reverse=True)

    def _next(self, data: bytes, at: int) -> tuple[bytes, int]:
        for piece in self.fixed:  # such pieces pass unchanged
            if data.startswith(piece, at):
                return piece, len(piece)
        if self.map is not None and (hit := self.map.longest(data, at)):
            return self.map.replacement(hit[1]), hit[0]
        lead = data[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at : at + n], n

    def __call__(self, text: str) -> tuple[str, list[int]]:
        m = self.model
        data = text.encode()
        space = SPACE.encode() if m.escape_spaces else b" "
        at, end = 0, len(data)
        if m.remove_extra_spaces:
            while at < end:
                new, n = self._next(data, at)
                if new != b" ":
                    break
                at += n
        if at >= end:
            return "", [0]
        out, places = bytearray(), []
        if m.dummy_prefix and not m.space_as_suffix:
            out += space
            places += [at] * len(space)
        blank = m.remove_extra_spaces  # whether a space has just been written
        while at < end:
            new, n = self._next(data, at)
            if blank:
                new = new.lstrip(b" ")
            for byte in new:
                part = space if byte == 0x20 else bytes((byte,))
                out += part
                places += [at] * len(part)
            if new:
                blank = m.remove_extra_spaces and new.endswith(b" ")
            at += n
        if m.remove_extra_spaces:
            while out.endswith(space):
                at = places[len(out) - len(space)]
                del out[-len(space) :], places[-len(space) :]
        if m.dummy_prefix and m.space_as_suffix:
            out += space
            places += [at] * len(space)
        places.append(at)
        return out.decode(), places
