"""Splitting texts into the pieces that a byte-level BPE encodes on their own, and encoding each distinct piece once."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex

from ._bytes import Texts, chunks, same_as, span_hash

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The split pattern of byte-level tokenizers of this kind: a fixed value of their format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose classes all Unicode versions agree on; texts with others are split by the library itself.
USUAL = ((0x0000, 0x052F), (0x2010, 0x2060), (0x20A0, 0x20BF), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))


def _ranges(wanted: str) -> str:
    """The usual characters that match ``wanted``, as ranges of a character class."""
    out, begin = [], None
    test = regex.compile(wanted)
    for low, high in USUAL:
        for cp in range(low, high + 2):
            inside = cp <= high and test.match(chr(cp)) is not None
            if inside and begin is None:
                begin = cp
            elif not inside and begin is not None:
                out.append(re.escape(chr(begin)) + "-" + re.escape(chr(cp - 1)))
                begin = None
    return "".join(out)


_UNUSUAL = re.compile("[^" + "".join(f"{chr(a)}-{chr(b)}" for a, b in USUAL) + "]")
_SPLIT = regex.compile(PATTERN)
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


def _classes() -> np.ndarray:
    """The class of each usual character."""
    table = np.zeros(USUAL[-1][1] + 1, np.uint8)
    for kind, wanted in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        test = regex.compile(wanted)
        for low, high in USUAL:
            table[low : high + 1][[test.match(chr(cp)) is not None for cp in range(low, high + 1)]] = kind
    return table


_CLASS = _classes()


def piece_classes(text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The first piece of each class of equal pieces of a text of usual characters, and the class of every piece.

    Pieces are hashed, two bytes a character, then each is compared with the first of its class; None where two differ.
    """
    units = np.frombuffer(text.encode("utf-16-le"), "<u2")
    _, first, which = np.unique(span_hash(units.view(np.uint8), 2 * starts, 2 * ends), return_index=True, return_inverse=True)
    return (first, which) if same_as(units, starts, ends, first[which]) else None


def piece_starts(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pieces of texts of usual characters start, ``PATTERN`` worked out for all places at once.

    ``points`` are the code points of all texts, one after the other, ``begins`` where each text begins. A piece is a run of
    one class; a blank before a run belongs to it; of longer white space before a run, the last character stands apart;
    an apostrophe that starts a piece takes the letters of a contraction.
    """
    n = len(points)
    kind = _CLASS[points]
    head = np.zeros(n + 3, bool)
    head[begins[begins < n]] = True
    start = head[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    inner = ~head[1 : n + 1]
    inner[n - 1 :] = False
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & inner[:-1]) if n > 1 else np.zeros(0, np.int64)
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    mark = np.flatnonzero(start & (points == 0x27))
    mark = mark[(mark + 1 < n) & ~head[mark + 1]]
    padded = np.append(points, [0, 0, 0])
    one, two = padded[mark + 1], np.where(head[mark + 2], 0, padded[mark + 2])
    short = np.isin(one, list(b"stmd"))
    pair = one * 256 + np.where(two < 256, two, 0)
    long = ~short & np.isin(pair, [a * 256 + b for a, b in (b"re", b"ve", b"ll")])
    for found, size in ((mark[short], 2), (mark[long], 3)):
        start[found + 1] = False
        after = found + size
        start[after[after < n]] = True
    return np.flatnonzero(start)


#: Pieces of a blank and letters: side by side they are split again at the blanks.
_JOINABLE = re.compile(f" [{_ranges(r'\p{L}')}]+")
#: Pieces whose codes a worker keeps between texts; others are encoded anew in each group of texts.
KEPT = 200_000
GROUP = 3 << 20


class PieceTable:
    """Codes of pieces as little-endian unsigned 32-bit ids, from ``encode`` of many pieces at once, the library's if none is given."""

    def __init__(self, path: str, encode: Callable[[list[str]], Iterable[bytes]] | None = None, kept: int = KEPT):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.encode = encode or self.by_library
        self.kept = kept
        self.codes: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        # A letter of a vocabulary entry stands for a byte.
        self.lengths = np.zeros(max(described["model"]["vocab"].values()) + 1, np.int64)
        for token, number in described["model"]["vocab"].items():
            self.lengths[number] = len(token)
        found = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, found)) + ")") if found else None
        for text, number in self.special.items():
            self.codes[text] = number.to_bytes(4, "little")

    def pieces(self, text: str) -> list[str]:
        if self.marks and any(m in text for m in self.special):
            parts = self.marks.split(text)
            return [p for k, part in enumerate(parts) for p in ([part] if k % 2 else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if _UNUSUAL.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return _SPLIT.findall(text)

    def by_library(self, pieces: list[str]) -> list[bytes]:
        """Codes of pieces from the library: those of blank and letters in runs as one text, others one by one."""
        found: dict[str, bytes] = {}
        match = _JOINABLE.fullmatch
        words, rest = [], []
        for p in pieces:
            (words if match(p) else rest).append(p)
        for at in range(0, len(words), 1000):
            run = words[at : at + 1000]
            text = "".join(run)
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            raw = np.frombuffer(text.encode(), np.uint8)
            stops = np.append(np.flatnonzero(raw == 0x20)[1:], len(raw))
            reached = np.cumsum(self.lengths[ids])
            ends = np.searchsorted(reached, stops)
            if len(stops) != len(run) or (reached[ends] != stops).any():
                raise ValueError("the library splits words otherwise")
            ends = ((ends + 1) * 4).tolist()
            found.update(zip(run, map(ids.tobytes().__getitem__, map(slice, [0, *ends], ends)), strict=False))
        found.update(zip(rest, (np.array(made.ids, "<u4").tobytes() for made in self.library.encode_batch(rest, add_special_tokens=False)), strict=True))
        return list(map(found.__getitem__, pieces))

    def encoded(self, column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
        """For runs of texts of an Arrow column (null: empty), where each begins and the ids of its texts, as bytes."""
        texts = Texts(column)
        for i, j in chunks(texts, GROUP):
            own = [t.decode() for t in texts[i:j]]
            odd = [k for k, t in enumerate(own) if _UNUSUAL.search(t) or self.marks and self.marks.search(t)]
            split = [self.pieces(own[k]) for k in odd]
            made = [b""] * len(own)
            plain = sorted(set(range(len(own))) - set(odd))
            joined = "".join(own[k] for k in plain)
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            begins = np.concatenate(([0], np.cumsum([len(own[k]) for k in plain]))).astype(np.int64)
            starts = piece_starts(points, begins)
            ends = np.append(starts[1:], len(points))[: len(starts)]
            found = piece_classes(joined, starts, ends)
            if found is None:
                split, odd, plain, joined = [self.pieces(t) for t in own], list(range(len(own))), [], ""
                starts, ends, begins, found = starts[:0], ends[:0], begins[:1], (starts[:0], starts[:0])
            first, which = found
            distinct = [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            new = list(set(distinct).union(*split) - self.codes.keys())
            self.codes.update(zip(new, self.encode(new), strict=True))
            codes = list(map(self.codes.__getitem__, distinct))
            sizes = np.fromiter(map(len, codes), np.int32, len(codes)) // 4
            ids, at = np.frombuffer(b"".join(codes), "<u4"), np.cumsum(sizes, dtype=np.int32) - sizes
            size = sizes[which]
            upto = np.concatenate(([0], np.cumsum(size, dtype=np.int32)))
            place = np.repeat(at[which] - upto[:-1], size)
            place += np.arange(len(place), dtype=np.int32)
            flat = ids[place]
            cuts = upto[np.searchsorted(starts, begins)].tolist()
            for k, a, b in zip(plain, cuts, cuts[1:], strict=False):
                made[k] = flat[a:b].tobytes()
            for k, pieces in zip(odd, split, strict=True):
                made[k] = b"".join(map(self.codes.__getitem__, pieces))
            for piece in new[max(0, self.kept - (len(self.codes) - len(new))) :]:
                del self.codes[piece]
            yield i, made
