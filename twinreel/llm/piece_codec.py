"""SentencePiece encoding and decoding by an agenda of adjacent pairs, checked with the library."""

from __future__ import annotations

import hashlib
import heapq
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, text_batches, worker_state
from .pieces import SPACE, Proof, Vocabulary, prove

#: Entries of each of the two halves of a worker's memory of encoded units (about 100 MB each).
#: A full half becomes the older one; units seen again come back from it.
MEMORY = 400_000
LONG_UNIT = 64
#: Every batch compares one whole text in this many with the library's ids and decode().
WHOLE_TEXTS = 16


def merge(symbols: list[str], score: dict[str, tuple[float, int]]) -> list[str]:
    """Join the adjacent pair of the highest score, the leftmost of equals, until none is left.

    The agenda is a heap of (-score, left position, right position, joined string); an entry is
    stale when one of its two symbols has changed since.
    """
    n = len(symbols)
    get, push, pop = score.get, heapq.heappush, heapq.heappop
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda = []
    for i in range(n - 1):
        joined = symbols[i] + symbols[i + 1]
        hit = get(joined)
        if hit:
            agenda.append((-hit[0], i, i + 1, joined))
    heapq.heapify(agenda)
    while agenda:
        _, a, b, joined = pop(agenda)
        x, y = symbols[a], symbols[b]
        if not x or not y or after[a] != b or len(x) + len(y) != len(joined):
            continue
        symbols[a], symbols[b] = joined, ""
        after[a] = c = after[b]
        if c < n:
            before[c] = a
            wider = joined + symbols[c]
            hit = get(wider)
            if hit:
                push(agenda, (-hit[0], a, c, wider))
        p = before[a]
        if p >= 0:
            wider = symbols[p] + joined
            hit = get(wider)
            if hit:
                push(agenda, (-hit[0], p, a, wider))
    return [s for s in symbols if s]


class Codec:
    def __init__(self, path: str, proof: Proof, memory: int = MEMORY):
        self.vocabulary, self.memory = Vocabulary(path, proof), memory
        self.known: dict[str, tuple[str, int, str, int]] = {}
        self.older: dict[str, tuple[str, int, str, int]] = {}
        #: units that do not decode to themselves, or whose ids are the library's
        self.odd: set[str] = set()
        self.mismatches = 0
        sp, byte_of = self.vocabulary.library, {i: b for b, i in self.vocabulary.byte_ids.items()}
        #: what each id decodes to: text, or a byte
        self.texts = [bytes([byte_of[i]]) if i in byte_of else sp.id_to_piece(i).replace(SPACE, " ") for i in range(sp.get_piece_size())]

    def encode_unit(self, unit: str) -> list[int]:
        ids = self.vocabulary.ids
        unit = unit.replace(" ", SPACE)
        out = []
        for piece in merge(list(unit), ids):
            hit = ids.get(piece)
            if hit:
                out.append(hit[1])
            else:
                out += [self.vocabulary.byte_ids[b] for b in piece.encode()]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, the dummy prefix still on it: runs of bytes are read as UTF-8."""
        pieces = [self.texts[i] for i in ids]
        if all(type(p) is str for p in pieces):
            return "".join(pieces)
        raw = b"".join([p.encode() if type(p) is str else p for p in pieces])
        return raw.decode("utf-8", "replace")

    def learn(self, units: list[str]) -> None:
        """Encode units and check each against the library; its ids count where they differ."""
        for unit, expected in zip(units, self.vocabulary.library_ids(units), strict=True):
            ids = self.encode_unit(unit)
            wrong = int(ids != expected)
            if wrong:
                self.mismatches += 1
                ids = expected
            text = self.decode(ids)
            if wrong or text != unit:
                self.odd.add(unit)
            self.known[unit] = ("," + ",".join(map(str, ids)), len(ids), text, wrong)

    def encode(self, texts: list[str]) -> list[tuple[str, int, str, int]]:
        """(ids joined by commas, their number, decoded text, units set right) of each text."""
        cut = [self.vocabulary.units(t) for t in texts]
        if len(self.known) > self.memory:
            self.known, self.older = {}, self.known
        new = []
        for u in set().union(*cut).difference(self.known):
            if had := self.older.get(u):
                self.known[u] = had
            else:
                new.append(u)
        self.learn(new)
        out = []
        for units in cut:
            hits = list(map(self.known.__getitem__, units))
            ids = "".join([h[0] for h in hits])
            decoded, wrong = (units, 0) if self.odd.isdisjoint(units) else ([h[2] for h in hits], sum([h[3] for h in hits]))
            out.append((ids[1:], ids.count(","), "".join(decoded)[1:], wrong))
        for u in new:
            if len(u) > LONG_UNIT:
                del self.known[u]
                self.odd.discard(u)
        if len(self.odd) > self.memory:
            self.known, self.older, self.odd = {}, {}, set()
        return out

    def checked(self, texts: list[str]) -> list[tuple[str, int, str, int]]:
        out, sp = self.encode(texts), self.vocabulary.library
        some = [i for i, t in enumerate(texts) if zlib.crc32(t.encode()) % WHOLE_TEXTS == 0]
        for i, ids in zip(some, sp.encode([texts[i] for i in some], num_threads=1), strict=True):
            expected = (",".join(map(str, ids)), len(ids), sp.decode(ids))
            if out[i][:3] != expected:
                self.mismatches += 1
                out[i] = (*expected, out[i][3] + 1)
        return out


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, memory: int = MEMORY, remember: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_corrected for each row of docs; no shuffle.

    With keep_text also ids (array<int>) and decoded. Null texts are encoded as empty: no ids,
    empty decoded text. Null ids and repeated rows are ordinary rows; an empty table gives no
    rows. Whole texts of any length; no sampling, no begin or end ids. Every unit is checked
    against the library, and one whole text in WHOLE_TEXTS; where they differ, the library's
    result counts, and n_corrected says in how many places of a text. Other columns are not read.
    memory: encoded units that a worker holds, in each of two halves; with remember=False it drops
    them at the end of each task. Both change the time and memory that it takes, not its rows.
    """
    text_batches(docs.sparkSession)
    proof = prove(model)._replace(shortcut=frozenset())  # every unit goes through the agenda
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_corrected"] + ["ids", "decoded"] * keep_text
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_corrected long" + ", ids array<int>, decoded string" * keep_text

    def encode(batches):
        import pyarrow as pa

        codec = worker_state(f"codec_{proof.digest}_{memory}", lambda: Codec(model, proof, memory))
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                got = codec.checked(part.column(1).to_pylist())
                columns = [
                    part.column(0),
                    pa.array([g[1] for g in got], pa.int64()),
                    pa.array([digest(g[0]) for g in got], pa.string()),
                    pa.array([digest(g[2]) for g in got], pa.string()),
                    pa.array([g[3] for g in got], pa.int64()),
                ]
                if keep_text:
                    ids = [[int(x) for x in g[0].split(",")] if g[0] else [] for g in got]
                    columns += [pa.array(ids, pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)
        if not remember:
            forget()

    return base.mapInArrow(encode, schema)
