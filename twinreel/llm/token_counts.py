"""Token counts with a whole-token shortcut: units that are one token are counted directly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches, worker_state
from .pieces import Proof, Vocabulary, prove

#: Entries of a worker's memory of merged units (about 40 MB); it starts anew beyond that.
MEMORY = 300_000
LONG_UNIT = 64


class Counter(dict):
    """Unit -> number of tokens: 1 for the proven single tokens, else merged by the library."""

    def __init__(self, path: str, proof: Proof):
        self.vocabulary = Vocabulary(path, proof)
        self.reset()

    def reset(self):
        self.clear()
        self.update(dict.fromkeys(self.vocabulary.shortcut, 1))

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.vocabulary.units(t) for t in texts]
        new = list(set().union(*cut).difference(self))
        if len(self) + len(new) > MEMORY + len(self.vocabulary.shortcut):
            self.reset()
            new = list(set().union(*cut).difference(self))
        self.update(zip(new, map(len, self.vocabulary.library_ids(new)), strict=True))
        out = [sum(map(self.__getitem__, units)) for units in cut]
        for u in new:
            if len(u) > LONG_UNIT:
                del self[u]
        return out


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs; no shuffle.

    Null texts count as empty (0 bytes, 0 tokens); null ids and repeated rows are ordinary
    rows; an empty table gives no rows. Texts are never cut. Other columns are not read. Which
    strings are one token is proven here, once; a worker whose model file differs fails.
    """
    text_batches(docs.sparkSession)
    proof = prove(model)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))

    def count(batches):
        import pyarrow as pa

        counter = worker_state(f"counter_{proof.digest}", lambda: Counter(model, proof))
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                n = counter.count(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = base.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
