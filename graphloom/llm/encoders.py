"""Whole texts to ids with files of the tokenizers library, pieces cached.

Both vocabularies never merge across certain boundaries, so a text is cut there, each distinct piece is encoded by the
library once, and pieces' ids are joined. Where a boundary is not certain a piece is longer, up to the whole text.
"""

from __future__ import annotations

import bisect
import gc
import os
import re
from array import array

import numpy as np

from .common import kept

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task has one core

#: Bounds of one worker's memory, some 200 bytes a piece: short pieces are kept up to a number, long ones only while
#: their batch lasts.
LONG_PIECE = 64
LEARN = 256


class Encoder:
    """ids of texts as little-endian unsigned 32-bit bytes; memory is bounded by `most` pieces of LONG_PIECE."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cache: dict = {}
        self.passing: list = []  # what was learned last and is not to be kept
        self.edge = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.edge[[i for t, i in self.tokenizer.get_vocab().items() if self.at_edge(t)]] = True

    def library(self, texts: list[str]) -> list[bytes]:
        out = []
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            out.append(array("I", e.ids).tobytes())
        return out

    def encode(self, texts: list[str] | list[bytes]) -> list[bytes]:
        if len(self.cache) > self.most:
            self.cache.clear()
        collecting = gc.isenabled()
        gc.disable()  # nothing here forms cycles, and each collection would go through all pieces
        try:
            return self.encoded(texts)
        finally:
            if collecting:
                gc.enable()

    def encoded(self, texts: list[str] | list[bytes]) -> list[bytes]:
        raw = [t if isinstance(t, bytes) else t.encode("utf-8") for t in texts]
        out = self.joined_ids([self.pieces(t) for t in raw])
        if doubt := [i for i, x in enumerate(out) if x is None]:
            for i, ids in zip(doubt, self.joined_ids([self.sure_pieces(raw[i]) for i in doubt], sure=True), strict=True):
                out[i] = ids
        return out

    def joined_ids(self, cut: list[list[bytes]], sure: bool = False) -> list:
        """ids of the texts that were cut into these pieces; None where a piece is not certain to be one."""
        pieces: list = []
        stops = [0]
        for some in cut:
            pieces += some
            stops.append(len(pieces))
        found = list(map(self.cache.get, pieces))
        gaps, doubt = [i for i, x in enumerate(found) if x is None], set()
        if gaps:
            todo = {pieces[i] for i in gaps}
            if not sure and (bad := self.uncertain(todo)):
                todo -= bad
                doubt = {bisect.bisect_right(stops, i) - 1 for i in gaps if pieces[i] in bad}
            learned = self.learned(todo)
            look = learned.get
            for i in gaps:
                found[i] = look(pieces[i])
            self.cache.update(learned)
            for p in self.passing:
                self.cache.pop(p, None)
        return [None if j in doubt else b"".join(found[a:b]) for j, (a, b) in enumerate(zip(stops, stops[1:], strict=False))]

    def learned(self, todo: set) -> dict:
        """ids by piece. Pieces are taken apart where the file always cuts: at line feeds, and after a run of letters."""
        out, split, lines, known = {}, [], [], self.cache
        plain, bare, whole = set(), set(), set()
        for p in todo:
            if p.isalpha():
                plain.add(p)
                continue
            if b"\n" in p and self.lined(p):
                first, *rest = p.split(b"\n")
                parts = [first, *[b" " + x for x in rest]]
                lines.append((p, parts))
                new = [x for x in parts if x not in known]
            else:
                new = (p,)
            for x in new:
                if m := self.plain(x):
                    head, tail = m.groups()
                    if not tail:
                        plain.add(head)
                        continue
                    split.append((x, head, key := self.bare(tail)))
                    if head not in known:
                        plain.add(head)
                    if key not in known:
                        whole.add(key)
                elif self.first(x):
                    bare.add(x)
                else:
                    whole.add(x)
        for words, space in ((list(plain), True), (list(bare), False)):
            for at in range(0, len(words), LEARN):
                out.update(self.together(words[at : at + LEARN]) if space else self.apart(words[at : at + LEARN]))
        whole = list(whole)
        out.update(zip(whole, self.library([self.spell(p) for p in whole]), strict=True))
        new = out.get
        for p, head, key in split:
            out[p] = (new(head) or known[head]) + (new(key) or known[key])
        for p, parts in lines:
            out[p] = self.line_feed.join([new(x) or known[x] for x in parts])
        self.passing = [p for p in whole if len(p) > LONG_PIECE] + [p for p, _ in lines] + [p for p, _, _ in split if len(p) > LONG_PIECE]
        self.passing += [p for words in (plain, bare) for p in words if len(p) > LONG_PIECE]
        return out

    def together(self, words: list) -> dict:
        """Plain words as one text, told apart by the ids that only stand at a word's edge."""
        ids = np.array(self.tokenizer.encode_batch_fast([self.joined(words)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = self.cuts(np.flatnonzero(self.edge[ids]), len(ids))
        assert len(cuts) == len(words) + 1
        raw, cuts = ids.tobytes(), (cuts * 4).tolist()
        return {w: raw[a:b] for w, a, b in zip(words, cuts, cuts[1:], strict=False)}


class SpacedEncoder(Encoder):
    """Byte-level BPE whose pre-tokens start at a space that is followed by a visible character.

    A piece is the text after such a space; a text's first piece is marked by a space, as no other starts with one.
    """

    most = 1_800_000
    # in UTF-8: ASCII, and Latin letters up to U+024F but for the signs U+00D7 and U+00F7
    plain = re.compile(rb"((?:[A-Za-z]|(?!\xc3[\x97\xb7])[\xc3-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+)([!-@\[-`{-~]*)\Z").match
    sure = re.compile(rb" (?=[!-~]|[\xc3-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])")
    visible = frozenset([32, *range(33, 127), *range(0xC3, 0xC9)])  # a piece's first byte; 32 marks a text's first piece
    first = re.compile(rb" (?:[A-Za-z]|(?!\xc3[\x97\xb7])[\xc3-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+\Z").match
    lined = re.compile(rb" ?(?:[!-~]|[\xc3-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+(?:\n(?:[!-~]|[\xc3-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+)+\Z").match
    line_feed = array("I", [198]).tobytes()

    def apart(self, words: list[bytes]) -> dict:
        """Words without a space before them, as lines of one text: a line feed is an id of its own between letters."""
        ids = np.array(self.tokenizer.encode_batch_fast([b"\n".join([w[1:] for w in words]).decode("utf-8")], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.concatenate([[-1], np.flatnonzero(ids == 198), [len(ids)]])
        assert len(cuts) == len(words) + 1
        raw, cuts = ids.tobytes(), cuts.tolist()
        return {w: raw[a * 4 + 4 : b * 4] for w, a, b in zip(words, cuts, cuts[1:], strict=False)}

    @staticmethod
    def at_edge(token: str) -> bool:
        return token.startswith("Ġ")

    @staticmethod
    def cuts(edges: np.ndarray, n: int) -> np.ndarray:
        return np.append(edges, n)

    def uncertain(self, pieces: set) -> set:
        return {p for p in pieces if not p or p[0] not in self.visible}

    def pieces(self, text: bytes) -> list[bytes]:
        return self.marked(text.split(b" "))

    def sure_pieces(self, text: bytes) -> list[bytes]:
        return self.marked(self.sure.split(text))

    def marked(self, out: list[bytes]) -> list[bytes]:
        if out[0]:
            out[0] = b" " + out[0]
            return out
        return out[1:]

    def bare(self, tail: bytes) -> bytes:
        return b" " + tail

    def spell(self, piece: bytes) -> str:
        return (piece[1:] if piece[0] == 32 else b" " + piece).decode("utf-8")

    def joined(self, words: list[bytes]) -> str:
        return (b" " + b" ".join(words)).decode("utf-8")


class WordEncoder(Encoder):
    """BPE with word ends that drops white space: cut at ASCII white space, A-Z lower-cased as the file does itself."""

    most = 900_000
    # Latin letters that no normal form changes; of them only U+0130 has two characters in lower case
    plain = re.compile(rb"((?:[a-z]|(?!\xc3[\x97\xb7]|\xc4\xb0)[\xc3-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+)([!-@\[-`{-~]*)\Z").match

    @staticmethod
    def at_edge(token: str) -> bool:
        return token.endswith("</w>")

    @staticmethod
    def cuts(edges: np.ndarray, n: int) -> np.ndarray:
        return np.concatenate([[0], edges + 1])

    @staticmethod
    def uncertain(pieces: set) -> set:
        return set()

    @staticmethod
    def first(piece: bytes) -> bool:
        return False

    def pieces(self, text: bytes) -> list[bytes]:
        return text.lower().split()

    def bare(self, tail: bytes) -> bytes:
        return tail

    def spell(self, piece: bytes) -> str:
        return piece.decode("utf-8")

    def joined(self, words: list[bytes]) -> str:
        return b" ".join(words).decode("utf-8")


def encoder(kind: type[Encoder], path: str) -> Encoder:
    """One encoder for each Python worker, kept between tasks."""
    return kept((kind, path), lambda: kind(path))
