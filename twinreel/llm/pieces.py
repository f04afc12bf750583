"""Shared by token counting and encoding: how a merge-type vocabulary cuts a text into units.

A merge can only ever join two characters that stand side by side in some vocabulary string.
UNIT cuts only between characters of which no string holds such a pair; `proven_unit` checks
that against the whole vocabulary, and where the proof fails the unit is the whole text. The
proof is made once, on the driver (`prove`); workers get what it found.
"""

from __future__ import annotations

import functools
import hashlib
import re
from typing import NamedTuple

SPACE = "▁"
#: White space belongs to the unit after it; letters and other characters never share a piece.
#: Raised digits count as other characters: strings join them with signs.
UNIT = r" *(?:[^\W\d_²³¹]+|(?:(?! )[\W\d_²³¹])+)| +"


class Proof(NamedTuple):
    """What is proven of a model file, named by its digest."""

    digest: str
    #: no string crosses a unit's boundary
    proven: bool
    #: strings (with plain spaces) that the library encodes alone as one token
    shortcut: frozenset


def _load(path: str):
    """(digest, library, id and score by string, id by byte) of a model file."""
    import sentencepiece

    with open(path, "rb") as file:
        model = file.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    ids, byte_ids = {}, {}
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            ids[piece] = (sp.get_score(i), i)
    return hashlib.sha256(model).hexdigest(), sp, ids, byte_ids


@functools.lru_cache(maxsize=4)
def prove(path: str) -> Proof:
    """Prove the units of a model and find its single tokens; about as large as its vocabulary."""
    digest, sp, ids, _ = _load(path)
    unit, strings = re.compile(UNIT), [p.replace(SPACE, " ") for p in ids]
    # a line break must be a byte, else it cannot keep the dummy prefix from a unit
    if not all(map(unit.fullmatch, strings)) or any("\n" in s for s in strings) or len(sp.encode("\n")) != 2:
        return Proof(digest, False, frozenset())
    alone = zip(strings, sp.encode(["\n" + s for s in strings], num_threads=1), strict=True)
    return Proof(digest, True, frozenset(s for s, found in alone if len(found) == 3))


class Vocabulary:
    """The strings of a sentencepiece model that merges can make: score and id by string."""

    def __init__(self, path: str, proof: Proof):
        digest, self.library, self.ids, self.byte_ids = _load(path)
        if digest != proof.digest:
            raise ValueError(f"{path} is not the model that was proven")
        self.proven, self.shortcut = proof.proven, proof.shortcut
        self.unit = re.compile(UNIT if proof.proven else r"(?s).+")

    def units(self, text: str) -> list[str]:
        """The units of a text in order, with the dummy prefix that the library adds."""
        return self.unit.findall(" " + text.replace(SPACE, " ")) if text else []

    def library_ids(self, units: list[str]) -> list[list[int]]:
        """The library's ids of units standing inside a text.

        Each follows a line break, which is a byte token that nothing merges with; the two
        tokens of the prefix and the line break are cut off again.
        """
        if not self.proven:
            return self.library.encode([u[1:] for u in units], num_threads=1)
        return [x[2:] for x in self.library.encode(["\n" + u for u in units], num_threads=1)]
