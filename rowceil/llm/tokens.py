"""Token ids of whole texts by the tokenizers library, with the ids of parts kept between texts.

A byte-level BPE vocabulary never merges across the boundaries of its pre-tokenizer. A text is therefore cut at
places which are such boundaries for certain (before a blank, and before a full stop or comma behind a letter or
digit), every part that has not been seen is encoded by the library, and parts met again reuse their ids. Texts
for which these places are not certain (runs of blanks, runs of marks before a stop, other scripts, the
special token's own string) go to the library whole. Tests hold the ids against the library's for whole texts.
"""

from __future__ import annotations

import array
import os
from collections.abc import Iterable, Iterator

#: Parts kept in each Python worker, about 200 bytes each; when full it starts anew.
KEPT_PARTS = 700_000
#: Characters of the texts that are cut and encoded together.
CHUNK_CHARS = 2_000_000
#: Parts of more bytes are encoded each time they come.
LONG_PART = 64

END_ID = 0
_CUT = "\x00"


def _classes() -> bytes:
    """Byte classes: a letter or digit, blank, comma or stop, other mark, X what sends a text to the library whole."""
    out = bytearray(b"." * 256)
    for c in range(128):
        if chr(c).isalnum():
            out[c] = ord("a")
    for c in (*range(9), *range(11, 32), 127):
        out[c] = ord("X")
    out[9] = ord("X")
    out[10] = out[32] = ord(" ")
    out[ord(",")] = out[ord(".")] = ord(",")
    for c in range(128, 256):
        out[c] = ord("a") if c < 0xC0 or c in (0xC3, 0xC4, 0xC5) else ord("X")
    return bytes(out)


_CLASSES = _classes()
_UNSURE = (b"X", b"  ", b" ,", b",,", b".,")


def _parts(text: str) -> list[str] | None:
    raw = text.encode()
    kind = raw.translate(_CLASSES)
    if any(x in kind for x in _UNSURE) or b"\xc3\x97" in raw or b"\xc3\xb7" in raw or "<|endoftext|>" in text:
        return None
    for c in " \n.,":
        text = text.replace(c, _CUT + c)
    return text.split(_CUT)


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._kept: dict[str, bytes] = {"": b""}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array.array("I", x.ids).tobytes() for x in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunk(self, texts: list[str]) -> list[bytes]:
        kept = self._kept
        cut = [_parts(x) for x in texts]
        new = list({x for parts in cut if parts for x in parts}.difference(kept))
        if len(kept) + len(new) > KEPT_PARTS:
            kept.clear()
            new = list({x for parts in cut if parts for x in parts})
        own: dict[str, bytes] = {}
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            for part, ids in zip(some, self._ids(some), strict=True):
                (kept if len(part) <= LONG_PART else own)[part] = ids
        whole = iter(self._ids([x for x, parts in zip(texts, cut, strict=True) if parts is None]))
        out = []
        for parts in cut:
            if parts is None:
                out.append(next(whole))
            elif own:
                out.append(b"".join([own[x] if x in own else kept[x] for x in parts]))
            else:
                out.append(b"".join(map(kept.__getitem__, parts)))
        return out

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers, without an end id; null is empty."""
        chunk: list[str] = []
        size = 0
        for x in texts:
            chunk.append(x or "")
            size += len(chunk[-1])
            if size > CHUNK_CHARS:
                yield from self._chunk(chunk)
                chunk, size = [], 0
        yield from self._chunk(chunk)


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """name: a file of public_tokenizers, or a path. One encoder for each worker process and file."""
    if name not in _encoders:
        path = name
        if "/" not in name:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _encoders[name] = Encoder(path)
    return _encoders[name]
